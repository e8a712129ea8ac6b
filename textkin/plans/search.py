"""Indexes, retrieval methods and fusion of their results, over documents (items) and benchmark (queries).

Postings are joined on the term; queries are the small side, so the term join's output grows with their hits alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, tfidf
from .catalog import query
from .dialect import DUCK, SPARK, plan
from .text import names

K = 5


def tokens(d, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"SELECT {key} AS id, {d.explode(d.words(text))} AS term FROM {table}"


def weights(d) -> str:
    """CTEs: raw tf, smooth idf ln((1+n)/(1+df))+1 and unit-length weights of documents; w(id, term, w)."""
    return f"""
tok AS ({tokens(d)}),
tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, df, ln((1.0e0 + n) / (1.0e0 + df)) + 1.0e0 AS idf FROM df CROSS JOIN n),
raw AS (SELECT tf.id, tf.term, tf * idf AS x FROM tf JOIN idf USING (term)),
norm AS (SELECT id, sqrt(sum(x * x)) AS norm FROM raw GROUP BY id),
w AS (SELECT raw.id, raw.term, x / norm AS w FROM raw JOIN norm USING (id))"""


def query_weights(d) -> str:
    return f"""
qtok AS ({tokens(d, "benchmark", "item_id")}),
qtf AS (SELECT id AS qid, term, count(*) AS tf FROM qtok GROUP BY id, term),
qraw AS (SELECT qid, term, tf * idf AS x FROM qtf JOIN idf USING (term)),
qnorm AS (SELECT qid, sqrt(sum(x * x)) AS norm FROM qraw GROUP BY qid),
qw AS (SELECT qid, term, x / norm AS w FROM qraw JOIN qnorm USING (qid))"""


def hits(d) -> str:
    """CTEs up to tfidf_hits(qid, id, score), rounded so that both engines rank alike."""
    return f"{weights(d)}, {query_weights(d)},\ntfidf_hits AS (SELECT qid, id, round(sum(qw.w * w.w), 6) AS score FROM qw JOIN w USING (term) GROUP BY qid, id)"


def token_hits(d) -> str:
    """CTE tok_hits(qid, id, hits, n, score): distinct query terms found, of the query's distinct terms."""
    return f"""
tq AS (SELECT DISTINCT id AS qid, term FROM ({tokens(d, "benchmark", "item_id")})),
ti AS (SELECT DISTINCT id, term FROM ({tokens(d)})),
nq AS (SELECT qid, count(*) AS n FROM tq GROUP BY qid),
tok_hits AS (SELECT qid, id, hits, n, round(CAST(hits AS DOUBLE) / n, 6) AS score FROM (SELECT qid, id, count(*) AS hits FROM tq JOIN ti USING (term) GROUP BY qid, id) JOIN nq USING (qid))"""


def top(source: str, k: int = K, where: str = "TRUE") -> str:
    return f"SELECT qid, id, score, rank FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {source} WHERE {where}) WHERE rank <= {k}"


@plan("tfidf_search")
def _(d):
    return f"WITH {hits(d)} {top('tfidf_hits', where='score > 0')}"


@plan("tfidf_weights")
def _(d):
    return f"WITH {weights(d)} SELECT id, term, round(w, 6) AS weight FROM w"


@plan("postings")
def _(d):
    return f"SELECT id, term, count(*) AS tf FROM ({tokens(d)}) WHERE length(term) >= 2 GROUP BY id, term"


@plan("inverted_index")
def _(d):
    return f"SELECT term, count(*) AS n_items, min(id) AS first_item, max(id) AS last_item FROM (SELECT DISTINCT id, term FROM ({tokens(d)})) GROUP BY term"


@plan("inverted_index_search")
def _(d):
    return f"""WITH q AS (SELECT id AS qid, term, count(*) AS m FROM ({tokens(d, "benchmark", "item_id")}) GROUP BY id, term), n AS (SELECT qid, sum(m) AS n FROM q GROUP BY qid),
i AS (SELECT DISTINCT id, term FROM ({tokens(d)})), h AS (SELECT qid, id, round(CAST(sum(m) AS DOUBLE) / max(n), 6) AS score FROM q JOIN i USING (term) JOIN n USING (qid) GROUP BY qid, id) {top("h")}"""


@plan("token_id_search")
def _(d):
    return f"""WITH vocab AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) + 3 AS token_id FROM (SELECT term, count(*) AS n FROM ({tokens(d)}) GROUP BY term ORDER BY n DESC, term LIMIT 50000)),
p AS (SELECT id, token_id FROM ({tokens(d)}) JOIN vocab USING (term)), q AS (SELECT id AS qid, token_id FROM ({tokens(d, "benchmark", "item_id")}) JOIN vocab USING (term)),
n AS (SELECT qid, count(*) AS n FROM q GROUP BY qid), pc AS (SELECT id, token_id, count(*) AS m FROM p GROUP BY id, token_id), qc AS (SELECT qid, token_id, count(*) AS m FROM q GROUP BY qid, token_id),
h AS (SELECT qid, id, round(CAST(sum(pc.m * qc.m) AS DOUBLE) / max(n), 6) AS score FROM qc JOIN pc USING (token_id) JOIN n USING (qid) GROUP BY qid, id) {top("h")}"""


@plan("exact_token_match")
def _(d):
    return f"WITH {token_hits(d)} SELECT qid, id, n FROM tok_hits WHERE hits = n"


@plan("partial_token_match")
def _(d):
    return f"WITH {token_hits(d)} {top('tok_hits', where='hits < n AND hits >= greatest(1, floor(n / 2))')}"


@plan("index_and_search")
def _(d):
    return f"""WITH {token_hits(d)}, known AS (SELECT qid, count(*) AS k FROM tq WHERE term IN (SELECT term FROM ti) GROUP BY qid)
SELECT qid, id, hits FROM tok_hits JOIN known USING (qid) WHERE hits = k"""


@plan("token_subsets")
def _(d):
    # each distinct name of two or more words is a query: combinations of two and three of its terms, the 20 best items of each; an item's score for
    # a combination is (size / n) * 1 * 0.7, as it holds all of it, and the best per item is kept
    return f"""WITH base AS (SELECT min(p_partkey) AS qid, p_name AS name FROM part GROUP BY p_name UNION ALL SELECT id, name FROM {names(d)} WHERE id < 0), q AS (SELECT qid, {d.explode(d.distinct(d.words("name")))} AS term FROM base), n AS (SELECT qid, count(*) AS n FROM q GROUP BY qid),
combos AS (SELECT a.qid, 2 AS size, a.term AS a, b.term AS b, b.term AS c FROM q a JOIN q b ON a.qid = b.qid AND a.term < b.term UNION ALL SELECT a.qid, 3, a.term, b.term, c.term FROM q a JOIN q b ON a.qid = b.qid AND a.term < b.term JOIN q c ON c.qid = b.qid AND b.term < c.term),
i AS (SELECT DISTINCT id, {d.explode(d.distinct(d.words("name")))} AS term FROM {names(d)}),
f AS (SELECT combos.qid, size, a, b, c, x.id, row_number() OVER (PARTITION BY combos.qid, size, a, b, c ORDER BY x.id) AS r FROM combos JOIN i x ON x.term = a JOIN i y ON y.term = b AND y.id = x.id JOIN i z ON z.term = c AND z.id = x.id),
h AS (SELECT f.qid, id, max(round(size * 1.0e0 / n * 0.7e0, 6)) AS score FROM f JOIN n ON n.qid = f.qid WHERE r <= 20 GROUP BY f.qid, id) {top("h", 20)}"""


@plan("prefix_search")
def _(d):
    return """WITH p AS (SELECT DISTINCT substr(lower(p_name), 1, 3) AS prefix FROM part)
SELECT prefix, id, score, rank FROM (SELECT prefix, p_partkey AS id, round(3.0e0 / length(p_name), 6) AS score, row_number() OVER (PARTITION BY prefix ORDER BY round(3.0e0 / length(p_name), 6) DESC, p_partkey) AS rank
FROM p JOIN part ON substr(lower(p_name), 1, 3) = prefix) WHERE rank <= 10"""


@plan("prefix_words")
def _(d):
    return f"SELECT DISTINCT term FROM ({tokens(d)}) WHERE term LIKE 'th%'"


@plan("fallback_text")
def _(d):
    return f"""WITH q AS (SELECT DISTINCT lower(p_name) AS q FROM part), h AS (SELECT q, p_partkey AS id, round(CAST(length(q) AS DOUBLE) / length(p_name), 6) AS score FROM q JOIN part ON {d.contains("lower(p_name)", "q")})
SELECT q, id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS r FROM h) WHERE r <= 5"""


@plan("substring_search")
def _(d):
    return f"SELECT doc_id, lang FROM documents WHERE {d.matches('lower(text)', 'tion|heit|mente')}"


def vector_hits(d, least: str) -> str:
    """CTE vec_hits(qid, id, score): cosine of every twentieth vector, a stated query set, with all others."""
    return f"""v AS (SELECT vec_id AS id, embedding AS e, sqrt({d.dot("embedding", "embedding")}) AS norm, label FROM embeddings), vq AS (SELECT id AS qid, e AS qe, norm AS qn FROM v WHERE id % 20 = 0),
vec_hits AS (SELECT qid, id, round({d.dot("e", "qe")} / nullif(norm * qn, 0), 6) AS score FROM v CROSS JOIN vq WHERE id <> qid AND {d.dot("e", "qe")} / nullif(norm * qn, 0) >= {least})"""


for _name, _least in (("vector_search", "0.3e0"), ("spatial_search", "0.0e0"), ("batch_vector_search", "0.2e0")):

    @plan(_name)
    def _(d, least=_least):
        return f"WITH {vector_hits(d, least)} {top('vec_hits', 10)}"


@query("vector_knn", f"WITH {vector_hits(DUCK, '-1.0e0')} {top('vec_hits', 10)}")
def vector_knn(spark, sf_dir):
    """The ten nearest of every twentieth vector, by matrix products; the SQL is that of vector_search without a least cosine."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS v")
    return graph.nearest(v, v.where("id % 20 = 0"), 10)


@plan("cosine_sim")
def _(d):
    return f"SELECT a.vec_id AS a, b.vec_id AS b, round({d.dot('a.embedding', 'b.embedding')} / sqrt({d.dot('a.embedding', 'a.embedding')} * {d.dot('b.embedding', 'b.embedding')}), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def similar(d) -> str:
    # the query itself is dropped after the top k, so at most k - 1 remain
    return f"""WITH {weights(d)}, h AS (SELECT q.id AS qid, w.id, round(sum(q.w * w.w), 6) AS score FROM w q JOIN w USING (term) WHERE q.id % 20 = 0 GROUP BY q.id, w.id)
SELECT qid, id, score FROM ({top("h")}) WHERE qid <> id"""


@query("similar_docs", similar(DUCK))
def similar_docs(spark, sf_dir):
    """The best K by TF-IDF of every twentieth document, itself dropped after them, by matrix products and postings a piece of the queries at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return tfidf.nearest_texts(docs, F.expr(SPARK.words("text")), F.expr("id % 20 = 0"), K).where("qid <> id").select("qid", "id", "score")


@plan("graph_search")
def _(d):
    return f"""WITH v AS (SELECT vec_id AS id, embedding AS e, sqrt({d.dot("embedding", "embedding")}) AS norm FROM embeddings),
h AS (SELECT q.id AS qid, v.id, round({d.dot("q.e", "v.e")} / (q.norm * v.norm), 6) AS score FROM v q JOIN v ON q.id <> v.id WHERE q.id % 20 = 0) {top("h", 5, "score >= 0.3e0")}"""


def both(d) -> str:
    """CTEs: f (token engine) and s (TF-IDF engine), 50 candidates each, and m, their full outer merge by id."""
    return f"""{hits(d)}, {token_hits(d)}, f AS ({top("tok_hits", 50)}), s AS ({top("tfidf_hits", 50)}),
u AS (SELECT qid, id, score AS fs, CAST(NULL AS DOUBLE) AS ss, rank AS fr, CAST(NULL AS BIGINT) AS sr FROM f UNION ALL SELECT qid, id, CAST(NULL AS DOUBLE), score, CAST(NULL AS BIGINT), rank FROM s),
m AS (SELECT qid, id, max(fs) AS fs, max(ss) AS ss, max(fr) AS fr, max(sr) AS sr FROM u GROUP BY qid, id)"""


MEANS = {
    "token_hybrid": "SELECT qid, id, round(0.6e0 * coalesce(fs, 0) + 0.4e0 * coalesce(ss, 0), 6) AS score FROM m",
    "advanced_hybrid": "SELECT qid, id, round((0.4e0 * coalesce(fs, 0) + 0.35e0 * coalesce(ss, 0)) / ((CASE WHEN fs IS NULL THEN 0.0e0 ELSE 0.4e0 END) + (CASE WHEN ss IS NULL THEN 0.0e0 ELSE 0.35e0 END)), 6) AS score FROM m",
}
for _name, _sql in MEANS.items():

    @plan(_name)
    def _(d, sql=_sql):
        return f"WITH {both(d)}, x AS ({sql}) {top('x', 20)}"


@plan("extended_hybrid")
def _(d):
    # exact .4, partial .25, semantic .2, subset .1 and boost .05. A document holds every combination of the query's words among its hits, so its
    # best subset has min(hits, 3) words if it has two or more; the boost is for codes with a digit that both texts have
    return f"""WITH {hits(d)}, {token_hits(d)}, bst AS (SELECT qid, id, least(0.3e0, 0.1e0 * count(*)) AS b FROM tq JOIN ti USING (term) WHERE {d.matches('term', '[0-9]')} GROUP BY qid, id),
x AS (SELECT qid, id, 0.4e0 * max(e) + 0.25e0 * max(p) + 0.2e0 * max(s) + 0.1e0 * max(u) + 0.05e0 * max(bo) AS score FROM (
SELECT qid, id, CASE WHEN hits = n THEN 1.0e0 ELSE 0.0e0 END AS e, CASE WHEN hits < n AND hits >= greatest(1, floor(n / 2)) THEN score ELSE 0.0e0 END AS p, 0.0e0 AS s, CASE WHEN hits >= 2 THEN least(hits, 3) * 1.0e0 / n * 0.7e0 ELSE 0.0e0 END AS u, 0.0e0 AS bo FROM tok_hits
UNION ALL SELECT qid, id, 0.0e0, 0.0e0, score, 0.0e0, 0.0e0 FROM tfidf_hits UNION ALL SELECT qid, id, 0.0e0, 0.0e0, 0.0e0, 0.0e0, b FROM bst) GROUP BY qid, id),
r AS (SELECT qid, id, round(score, 6) AS score FROM x) {top("r", 10, "score > 0")}"""


@plan("engine_confidence")
def _(d):
    return f"WITH {hits(d)}, t AS ({top('tfidf_hits', 50)}) SELECT qid, round(least(1.0e0, 0.6e0 * least(count(*) / 20.0e0, 1.0e0) + 0.4e0 * avg(score)), 5) AS confidence FROM t GROUP BY qid"


@plan("no_hit_rows")
def _(d):
    return f"""WITH {token_hits(d)}, b AS (SELECT qid, max(score) AS score FROM tok_hits WHERE score >= 0.9e0 GROUP BY qid)
SELECT item_id AS qid, coalesce(score, 0.0e0) AS score, CASE WHEN score IS NULL THEN 'not found' ELSE 'found' END AS relation FROM benchmark LEFT JOIN b ON b.qid = item_id"""


@plan("vocabulary")
def _(d):
    return f"""WITH c AS (SELECT term, count(*) AS n FROM ({tokens(d)}) GROUP BY term), t AS (SELECT sum(n) AS total FROM c)
SELECT term, n, row_number() OVER (ORDER BY n DESC, term) + 3 AS token_id FROM (SELECT term, n FROM c CROSS JOIN t WHERE CAST(n AS DOUBLE) / total <= 0.95e0 ORDER BY n DESC, term LIMIT 50000)"""


@plan("word_vocab")
def _(d):
    return f"SELECT term, n, row_number() OVER (ORDER BY n DESC, term) - 1 AS token_id FROM (SELECT term, count(*) AS n FROM ({tokens(d)}) GROUP BY term ORDER BY n DESC, term LIMIT 10000)"


@plan("vectorize_ids")
def _(d):
    return f"""WITH c AS (SELECT term, count(*) AS n FROM ({tokens(d)}) GROUP BY term), voc AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) + 3 AS token_id FROM (SELECT * FROM c WHERE n >= 2 ORDER BY n DESC, term LIMIT 50000)), s AS (SELECT count(*) + 4 AS v FROM voc)
SELECT id, count(*) AS n_tokens, sum(CASE WHEN token_id IS NULL THEN 1 ELSE 0 END) AS n_unknown, round(sum(1.0e0 / (1.0e0 + coalesce(token_id, 1) / CAST(v AS DOUBLE))), 4) AS total_weight FROM (SELECT * FROM ({tokens(d)}) LEFT JOIN voc USING (term)) CROSS JOIN s GROUP BY id"""


@plan("ngram_importance")
def _(d):
    return f"""WITH t AS (SELECT p_partkey AS id, {d.words("p_name")} AS ws FROM part), g AS (SELECT id, {d.explode("ws")} AS term FROM t UNION ALL SELECT id, {d.join("ws")} FROM t WHERE {d.size("ws")} = 2),
tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), n AS (SELECT count(*) AS n FROM part),
raw AS (SELECT id, term, tf * (ln((1.0e0 + n) / (1.0e0 + df)) + 1.0e0) AS x FROM tf JOIN df USING (term) CROSS JOIN n), norm AS (SELECT id, sqrt(sum(x * x)) AS norm FROM raw GROUP BY id)
SELECT term, round(sum(x / norm), 4) AS importance FROM raw JOIN norm USING (id) GROUP BY term"""


@plan("param_join_search")
def _(d):
    return """SELECT o_orderkey, o_orderdate FROM (SELECT DISTINCT o_orderkey, o_orderdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE lower(p_name) LIKE '%a%' AND p_size >= 40) ORDER BY o_orderdate DESC, o_orderkey LIMIT 100"""
