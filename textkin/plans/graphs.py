"""Pairs, duplicate groups, density clusters, trees and streams as registered plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..operators import graph, minhash, pairs
from ..sources.shared import written
from ..streaming import events as stream
from .catalog import query
from .dialect import DUCK, SPARK, plan, run
from .search import hits, top


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents' token sets and the classes of equal ones, as from keyed and class_names."""
    known = pairs.keyed(pairs.token_sets(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return known, pairs.class_names(known)


def doc_pairs(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    """Pairs of documents' classes of equal words with a Jaccard of `least` or more."""
    return pairs.class_pairs(*doc_classes(spark, sf_dir), least)


#: Oracle CTEs: c(class_id, term), n(class_id, n), j(a, b, score) for all pairs of classes.
JACCARD = f"""s AS (SELECT doc_id AS id, list_sort(list_distinct({DUCK.words("text")})) AS terms FROM documents), g AS (SELECT min(id) AS class_id, terms FROM s WHERE len(terms) > 0 GROUP BY terms),
c AS (SELECT class_id, unnest(terms) AS term FROM g), n AS (SELECT class_id, len(terms) AS n FROM g), m AS (SELECT x.class_id AS a, y.class_id AS b, count(*) AS k FROM c x JOIN c y ON x.term = y.term AND x.class_id < y.class_id GROUP BY 1, 2),
j AS (SELECT a, b, CAST(k AS DOUBLE) / (na.n + nb.n - k) AS score FROM m JOIN n na ON na.class_id = a JOIN n nb ON nb.class_id = b)"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("dup_pairs", f"WITH {JACCARD} SELECT a, b, round(score, 6) AS score FROM j WHERE score >= 0.8")
def dup_pairs(spark, sf_dir):
    return rounded(doc_pairs(spark, sf_dir, 0.8), "score")


@query("jaccard_join", f"WITH {JACCARD} SELECT a, b, round(score, 6) AS score FROM j WHERE score >= 0.6")
def jaccard_join(spark, sf_dir):
    return rounded(doc_pairs(spark, sf_dir, 0.6), "score")


@query("dup_classes", f"WITH {JACCARD} SELECT s.id, g.class_id FROM s JOIN g ON g.terms = s.terms")
def dup_classes(spark, sf_dir):
    sets = pairs.token_sets(table(spark, sf_dir, "documents"), "doc_id", "text")
    return sets.join(pairs.classes(sets), "terms").select("id", "class_id")


MIRRORED = "b2 AS (SELECT a AS id, b AS other, score FROM j WHERE score >= 0.6 UNION ALL SELECT b, a, score FROM j WHERE score >= 0.6), r AS (SELECT id, other, round(score, 6) AS score, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM b2)"


@query("analog_pairs", f"WITH {JACCARD}, {MIRRORED} SELECT id, other, score, rank FROM r WHERE rank <= 100")
def analog_pairs(spark, sf_dir):
    return rounded(pairs.analogs(doc_pairs(spark, sf_dir, 0.6)), "score")


#: As JACCARD, but of all documents with a word: j(a, b, score) for each two of them, copies among them.
OF_DOCUMENTS = f"""s AS (SELECT doc_id AS id, list_distinct({DUCK.words("text")}) AS terms FROM documents), c AS (SELECT id, unnest(terms) AS term FROM s), n AS (SELECT id, len(terms) AS n FROM s),
m AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM c x JOIN c y ON x.term = y.term AND x.id < y.id GROUP BY 1, 2), j AS (SELECT a, b, CAST(k AS DOUBLE) / (na.n + nb.n - k) AS score FROM m JOIN n na ON na.id = a JOIN n nb ON nb.id = b)"""


@query("best_jaccard_match", f"WITH {OF_DOCUMENTS}, {MIRRORED} SELECT id, other, score, rank FROM r WHERE rank = 1")
def best_jaccard_match(spark, sf_dir):
    """The best match of each document among all others, its copies too."""
    known, names = doc_classes(spark, sf_dir)
    return rounded(pairs.best_of_items(pairs.class_pairs(known, names, 0.6), pairs.copies(known, names)), "score")


@query("dup_groups")
def dup_groups(spark, sf_dir):
    """Greedy groups of all documents, copies among them."""
    known, names = doc_classes(spark, sf_dir)
    return pairs.groups_of_items(pairs.greedy_groups(pairs.class_pairs(known, names, 0.6)), pairs.copies(known, names))


COMPONENTS = "e AS (SELECT a, b FROM j WHERE score >= 0.6), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS x, a AS y FROM both_ways UNION SELECT reach.x, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.y), roots AS (SELECT x AS node, min(y) AS root FROM reach GROUP BY x)"


@query("components", f"WITH RECURSIVE {JACCARD}, {COMPONENTS} SELECT node, root FROM roots WHERE node <> root")
def components(spark, sf_dir):
    return graph.connected_components(doc_pairs(spark, sf_dir, 0.6).select("a", "b"))


COSINE, SAMPLES = 0.3, 3
VECTORS = f"v AS (SELECT vec_id AS id, embedding AS e FROM embeddings), x AS (SELECT a.id AS a, b.id AS b, {DUCK.dot('a.e', 'b.e')} / sqrt({DUCK.dot('a.e', 'a.e')} * {DUCK.dot('b.e', 'b.e')}) AS cosine FROM v a JOIN v b ON a.id < b.id), near AS (SELECT * FROM x WHERE cosine >= {COSINE})"


def vector_edges(spark, sf_dir) -> DataFrame:
    return graph.near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", COSINE)


@query("similarity_graph", f"WITH {VECTORS} SELECT a, b, round(cosine, 6) AS cosine FROM near")
def similarity_graph(spark, sf_dir):
    return rounded(vector_edges(spark, sf_dir), "cosine")


DBSCAN = f"""{VECTORS}, w AS (SELECT a, b FROM near UNION SELECT b, a FROM near), core AS (SELECT a AS id FROM w GROUP BY a HAVING count(*) + 1 >= {SAMPLES}), ce AS (SELECT a, b FROM w WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id AS x, id AS y FROM core UNION SELECT reach.x, ce.b FROM reach JOIN ce ON ce.a = reach.y), l AS (SELECT x AS id, min(y) AS label FROM reach GROUP BY x), bo AS (SELECT w.a AS id, min(label) AS label FROM w JOIN l ON l.id = w.b WHERE w.a NOT IN (SELECT id FROM core) GROUP BY w.a), k AS (SELECT * FROM l UNION ALL SELECT * FROM bo)"""


@query("dbscan", f"WITH RECURSIVE {DBSCAN} SELECT v.id, coalesce(label, -1) AS label, label IS NULL AS is_noise FROM v LEFT JOIN k USING (id)")
def dbscan(spark, sf_dir):
    return graph.density_labels(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", COSINE, SAMPLES)


@query("dbscan_noise")
def dbscan_noise(spark, sf_dir):
    """Each noise point of dbscan with the best five members of its nearest clusters."""
    found = written(graph.density_labels(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", COSINE, SAMPLES))
    return rounded(graph.noise_analogs(table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "embedding AS e"), found), "score")


#: Five thresholds at equal steps by four numbers, as the method's grid has; the thresholds begin at dbscan's.
GRID, GRID_SAMPLES, GRID_DEFAULT = (COSINE, 0.35, 0.4, 0.45, 0.5), (2, 3, 4, 5), (0.7, 2)


@query("dbscan_grid")
def dbscan_grid(spark, sf_dir):
    """Clusters, noise and quality for a grid of thresholds, and which cell is chosen."""
    return graph.density_grid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", GRID, GRID_SAMPLES, GRID_DEFAULT)


@query("minhash_lsh")
def minhash_lsh(spark, sf_dir):
    """Pairs of documents' classes of equal words that share a MinHash band and have a Jaccard of .6 or more; dup_classes has the members."""
    return minhash.class_pairs(*doc_classes(spark, sf_dir), 0.6)


def name_pairs(spark, sf_dir) -> DataFrame:
    """(a, b): distinct names that share a word."""
    w = table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return w.select(F.col("p_name").alias("a"), "word").join(w.select(F.col("p_name").alias("b"), "word"), "word").where("a < b").select("a", "b").distinct()


for _name, _kernel in (("indel_ratio", fuzzy.ratio), ("partial_ratio", fuzzy.partial_ratio), ("token_sort_ratio", fuzzy.token_sort_ratio), ("token_set_ratio", fuzzy.token_set_ratio), ("blocks_ratio", fuzzy.blocks_ratio)):

    @query(_name)
    def _(spark, sf_dir, f=_kernel):
        return name_pairs(spark, sf_dir).withColumn("score", fuzzy.kernel(f)("a", "b"))


@query("fuzzy_search")
def fuzzy_search(spark, sf_dir):
    """TF-IDF candidates re-scored by string ratios: .4 cosine + .3 best ratio + .3 plain ratio, five a query."""
    found = run(spark, sf_dir, f"WITH {hits(SPARK)}, c AS ({top('tfidf_hits', 100, 'score >= 0.05e0')}) SELECT qid, id, score, benchmark.text AS q, documents.text AS t FROM c JOIN benchmark ON item_id = qid JOIN documents ON doc_id = id")
    scored = found.withColumn("ratio", fuzzy.kernel(fuzzy.ratio)("q", "t") / 100).withColumn("sorted", fuzzy.kernel(fuzzy.token_sort_ratio)("q", "t") / 100)
    out = scored.withColumn("combined", 0.4 * F.col("score") + 0.3 * F.greatest("ratio", "sorted") + 0.3 * F.col("ratio")).select("qid", "id", "score", "ratio", "combined")
    from pyspark.sql import Window

    return out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("combined").desc(), "id"))).where("rank <= 5")


@plan("tfidf_self_join")
def _(d):
    return f"""WITH i AS (SELECT min(p_partkey) AS id, p_name FROM part GROUP BY p_name), tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, {d.explode(d.words("p_name"))} AS term FROM i) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM i),
r AS (SELECT id, term, tf * (ln((1.0e0 + n) / (1.0e0 + df)) + 1.0e0) AS x FROM tf JOIN df USING (term) CROSS JOIN n), m AS (SELECT id, sqrt(sum(x * x)) AS m FROM r GROUP BY id), w AS (SELECT r.id, term, x / m AS w FROM r JOIN m ON m.id = r.id),
s AS (SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w), 6) AS score FROM w a JOIN w b ON a.term = b.term AND a.id <> b.id GROUP BY a.id, b.id)
SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s WHERE score >= 0.3e0) WHERE k <= 25"""


def edges_of_names(d) -> str:
    """CTEs i(id, name, n) and e(a, b, score): distinct names, and pairs a < b of them by word Jaccard."""
    return f"""i AS (SELECT min(p_partkey) AS id, p_name AS name FROM part GROUP BY p_name), t AS (SELECT DISTINCT id, {d.explode(d.words("name"))} AS term FROM i), n AS (SELECT id, count(*) AS n FROM t GROUP BY id),
m AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM t a JOIN t b ON a.term = b.term AND a.id < b.id GROUP BY a.id, b.id), e AS (SELECT a, b, round(CAST(k AS DOUBLE) / (x.n + y.n - k), 6) AS score FROM m JOIN n x ON x.id = a JOIN n y ON y.id = b),
g AS (SELECT a, b, score FROM e UNION ALL SELECT b, a, score FROM e)"""


@plan("analog_graph")
def _(d):
    return f"WITH {edges_of_names(d)} SELECT a, b, score FROM g"


@plan("graph_stats")
def _(d):
    return f"WITH {edges_of_names(d)} SELECT (SELECT count(*) FROM i) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT round(2.0e0 * count(*) / ((SELECT count(*) FROM i) * ((SELECT count(*) FROM i) - 1)), 6) FROM e) AS density"


@plan("triangles")
def _(d):
    return f"WITH {edges_of_names(d)} SELECT count(*) AS n FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b"


@plan("cluster_sizes")
def _(d):
    return "SELECT label, count(*) AS n FROM embeddings GROUP BY label"


@plan("centroids")
def _(d):
    return f"SELECT label, CAST(pos AS BIGINT) AS pos, round(avg(CAST({d.at('embedding', 'CAST(pos AS INT)')} AS DOUBLE)), 5) AS x FROM (SELECT label, embedding, {d.explode(d.range('1', '64'))} AS pos FROM embeddings) GROUP BY label, pos"


@query("stream_metrics", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def stream_metrics(spark, sf_dir):
    return stream.metrics(spark, sf_dir)


@query("stream_windows")
def stream_windows(spark, sf_dir):
    return stream.windows(spark, sf_dir)


@query("stream_subscriptions", "SELECT client, event_id FROM events JOIN (VALUES ('a', 'click'), ('b', NULL)) AS v(client, wanted) ON wanted IS NULL OR wanted = event_type")
def stream_subscriptions(spark, sf_dir):
    return stream.subscribed(spark, sf_dir, [("a", "click"), ("b", None)])


@query("token_bucket")
def token_bucket(spark, sf_dir):
    return stream.token_bucket(table(spark, sf_dir, "events"), "user_id", 3, 1 / 3600)


@query("stream_events", "SELECT event_id, event_type, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def stream_events(spark, sf_dir):
    return stream.events_seen(spark, sf_dir)


@query("stream_search")
def stream_search(spark, sf_dir):
    """Benchmark texts as a stream of requests against the stored index of documents."""
    from .indexes import built

    t, _ = built(spark, sf_dir)
    source = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    requests = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/benchmark.parque[t]").select(F.col("item_id").alias("qid"), "text")
    return stream.answered(spark, requests, t)


@query("stream_silences")
def stream_silences(spark, sf_dir):
    return stream.silences(spark, sf_dir)


@query("request_batches", "SELECT user_id AS key, CAST(floor(epoch_us(ts) / 100000) AS BIGINT) AS batch, count(*) AS n FROM events GROUP BY 1, 2")
def request_batches(spark, sf_dir):
    return stream.batched(table(spark, sf_dir, "events"), "user_id")
