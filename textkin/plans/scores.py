"""Scores of pairs of catalog names, fusion and classification as registered plans; their oracles are written by hand in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions import fuzzy
from ..operators import classify, fusion, pairs, scores
from ..sources.shared import written
from .catalog import query
from .dialect import DUCK, SPARK, run
from .search import both, top

LEAST = 0.2


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def items(spark, sf_dir) -> DataFrame:
    """(id, name, category, brand): the distinct names of part, by their first row, and the fixed names."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    first = part.groupBy(F.col("p_name").alias("name")).agg(F.min(F.col("p_partkey").cast("long")).alias("id"), F.min_by("p_type", "p_partkey").alias("category"), F.min_by("p_brand", "p_partkey").alias("brand"))
    fixed = spark.createDataFrame(list(D.CATALOG), "id long, name string, category string, brand string")
    return first.select("id", "name", "category", "brand").union(fixed)


def candidates(spark, sf_dir, directed: bool = False) -> DataFrame:
    """(a, b, x, y, category_x, ...): pairs of names with a word Jaccard of LEAST or more, from the exact prefix-filter join."""
    i = written(items(spark, sf_dir))
    sets = pairs.token_sets(i, "id", "name").select(F.col("id").alias("class_id"), "terms")
    met = pairs.jaccard_pairs(sets, LEAST).withColumnRenamed("score", "words")
    if directed:
        met = met.union(met.select("b", "a", "words"))
    left = i.select(F.col("id").alias("a"), F.col("name").alias("x"), F.col("category").alias("category_x"), F.col("brand").alias("brand_x"))
    right = i.select(F.col("id").alias("b"), F.col("name").alias("y"), F.col("category").alias("category_y"), F.col("brand").alias("brand_y"))
    return met.join(left, "a").join(right, "b")


def semantic_candidates(spark, sf_dir, directed: bool = False) -> DataFrame:
    return scores.with_semantic(candidates(spark, sf_dir, directed), written(scores.term_vectors(items(spark, sf_dir), "id", "name")))


FIXED = ", ".join(f"({i}, {quoted(n)}, {quoted(c)}, {quoted(b)})" for i, n, c, b in D.CATALOG)
#: Oracle CTEs: i (items) and p (all pairs, brute force).
PAIRS = rf"""i AS (SELECT min(p_partkey) AS id, p_name AS name, arg_min(p_type, p_partkey) AS category, arg_min(p_brand, p_partkey) AS brand FROM part GROUP BY p_name UNION ALL SELECT * FROM (VALUES {FIXED})),
ws AS (SELECT *, list_distinct(regexp_extract_all(lower(name), '[\p{{L}}\p{{N}}_]+')) AS w FROM i),
p AS (SELECT a.id AS a, b.id AS b, a.name AS x, b.name AS y, a.category AS cx, b.category AS cy, a.brand AS bx, b.brand AS by_, len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) AS words
  FROM ws a JOIN ws b ON a.id < b.id WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) >= {LEAST} * len(list_distinct(a.w || b.w)) - 1e-12)"""
DIRECTED = "d AS (SELECT a, b, x, y, cx, cy, bx, by_, words FROM p UNION ALL SELECT b, a, y, x, cy, cx, by_, bx, words FROM p)"


def jaccard_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct({a} || {b})) END"


def words_sql(x: str, pattern: str) -> str:
    return rf"list_filter(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '{pattern}'))"


def any_sql(a: str, b: str, value: str) -> str:
    return f"CASE WHEN list_has_any({a}, {b}) THEN {value} ELSE 0.0 END"


SIZE_SQL = "[Мм][0-9]+[хx][0-9]+|[0-9]+[тt]|[0-9]+[Ww]|[0-9]+[Аа]"
KEY_SQL = " + ".join(
    [
        any_sql(r"regexp_extract_all(upper(x), 'ГОСТ\s*[0-9]+[-0-9]*')", r"regexp_extract_all(upper(y), 'ГОСТ\s*[0-9]+[-0-9]*')", "0.5"),
        any_sql(f"regexp_extract_all(x, '{SIZE_SQL}')", f"regexp_extract_all(y, '{SIZE_SQL}')", "0.3"),
        any_sql(words_sql("x", "[A-Za-zА-Яа-я]{3,}"), words_sql("y", "[A-Za-zА-Яа-я]{3,}"), "0.2"),
    ]
)


@query("key_param_sim", f"WITH {PAIRS} SELECT a, b, round({KEY_SQL}, 6) AS score FROM p")
def key_param_sim(spark, sf_dir):
    return candidates(spark, sf_dir).select("a", "b", F.round(scores.key_parameters(F.col("x"), F.col("y")), 6).alias("score"))


def brand_list(x: str) -> str:
    return "list_filter([" + ", ".join(map(quoted, D.KNOWN_BRANDS)) + f"], lambda b: contains(lower({x}), b))"


@query(
    "brand_sim",
    f"""WITH {PAIRS}, k AS (SELECT *, {brand_list("x")} AS kx, {brand_list("y")} AS ky FROM p)
SELECT a, b, CASE WHEN list_has_any(kx, ky) THEN 1.0 ELSE 0.0 END AS plain,
CASE WHEN (bx <> '' AND bx = by_) OR list_has_any(kx, ky) THEN 1.0 WHEN list_has_any(kx, ['huawei', 'honor']) AND list_has_any(ky, ['huawei', 'honor']) THEN 0.8 ELSE 0.0 END AS advanced FROM k""",
)
def brand_sim(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    advanced = scores.brand_similarity_advanced(F.col("brand_x"), F.col("brand_y"), x, y)
    return candidates(spark, sf_dir).select("a", "b", scores.brand_similarity(x, y).alias("plain"), advanced.alias("advanced"))


def two_numbers(x: str) -> str:
    return rf"list_distinct(list_transform(regexp_extract_all({x}, '[0-9]+\s*[хx]\s*[0-9]+'), lambda m: regexp_replace(m, '\s*[хx]\s*', 'x')))"


def numbers_before(x: str, sign: str) -> str:
    return rf"list_distinct(regexp_extract_all({x}, '([0-9]+)\s*{sign}', 1))"


SIGNS = ("[тt]", "[Ww]", "[Аа]", "[Vv]", "[кг]", "[л]", "[мм]")


def all_numbers(x: str) -> str:
    return "list_distinct(" + " || ".join([two_numbers(x), *(numbers_before(x, s) for s in SIGNS)]) + ")"


def weighted_numbers() -> str:
    sides = [(two_numbers("x"), two_numbers("y"), 0.3)] + [(numbers_before("x", s), numbers_before("y", s), w) for s, w in zip(SIGNS, (0.25, 0.2, 0.15, 0.1))]
    weight = " + ".join(f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {w} ELSE 0.0 END" for a, b, w in sides)
    total = " + ".join(f"{w} * ({jaccard_sql(a, b)})" for a, b, w in sides)
    return f"coalesce(({total}) / nullif({weight}, 0), 0.0)"


@query("param_sim", f"WITH {PAIRS} SELECT a, b, round({jaccard_sql(all_numbers('x'), all_numbers('y'))}, 6) AS plain, round({weighted_numbers()}, 6) AS advanced FROM p")
def param_sim(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    return candidates(spark, sf_dir).select("a", "b", F.round(scores.parameter_similarity(x, y), 6).alias("plain"), F.round(scores.parameter_similarity_advanced(x, y), 6).alias("advanced"))


SIMILAR = " OR ".join(f"(cx = '{k}' AND cy IN ({', '.join(map(quoted, v))})) OR (cy = '{k}' AND cx IN ({', '.join(map(quoted, v))}))" for k, v in D.SIMILAR_CATEGORIES.items())


@query("category_sim", f"WITH {PAIRS} SELECT a, b, CASE WHEN cx = '' OR cy = '' THEN 0.0 WHEN cx = cy THEN 1.0 WHEN {SIMILAR} THEN 0.7 ELSE 0.0 END AS score FROM p")
def category_sim(spark, sf_dir):
    return candidates(spark, sf_dir).select("a", "b", scores.category_similarity(F.col("category_x"), F.col("category_y")).alias("score"))


def group_list(x: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower({x}), {quoted(w)})' for w in ws)} THEN {quoted(g)} END" for g, ws in D.FUNCTIONAL_GROUPS.items()) + "], lambda g: g IS NOT NULL)"


@query("functional_sim", f"WITH {PAIRS} SELECT a, b, round({jaccard_sql(group_list('x'), group_list('y'))}, 6) AS score FROM p")
def functional_sim(spark, sf_dir):
    return candidates(spark, sf_dir).select("a", "b", F.round(scores.functional_similarity(F.col("x"), F.col("y")), 6).alias("score"))


@query("technical_flag", f"WITH {PAIRS} SELECT id, {' OR '.join(f'contains(lower(name), {quoted(w)})' for w in D.TECHNICAL_WORDS)} AS technical FROM i")
def technical_flag(spark, sf_dir):
    return items(spark, sf_dir).select("id", scores.is_technical(F.col("name")).alias("technical"))


BOOST_SQL = " + ".join(f"CASE WHEN regexp_matches(lower(x), '{p}') AND regexp_matches(lower(y), '{p}') THEN {w} ELSE 0.0 END" for p, w in (("гост", 0.1), ("ip[0-9][0-9]", 0.1), ("м[0-9]+[хx][0-9]+", 0.1), ("[0-9]+ ?(мм|кг|бар|шт)", 0.05)))


@query("technical_boost", f"WITH {PAIRS} SELECT a, b, round(least(0.3, {BOOST_SQL}), 6) AS boost FROM p")
def technical_boost(spark, sf_dir):
    return candidates(spark, sf_dir).select("a", "b", F.round(scores.technical_boost(F.col("x"), F.col("y")), 6).alias("boost"))


def terms_of(x: str) -> str:
    return f"list_distinct({words_sql(f'lower({x})', '[а-яёa-z]+')})"


KEY_TERMS = f"CASE WHEN len({terms_of('x')}) = 0 THEN 0.0 ELSE len(list_intersect({terms_of('x')}, {terms_of('y')})) / len({terms_of('x')}) END"


@query("key_term_score", f"WITH {PAIRS}, {DIRECTED} SELECT a, b, round({KEY_TERMS}, 6) AS score FROM d")
def key_term_score(spark, sf_dir):
    return candidates(spark, sf_dir, True).select("a", "b", F.round(scores.key_term_score(F.col("x"), F.col("y")), 6).alias("score"))


@query("numeric_penalty", f"WITH {PAIRS}, {DIRECTED} SELECT a, b, round(CASE WHEN list_has_any({words_sql('x', '[0-9]+')}, {words_sql('y', '[0-9]+')}) THEN 0.5 * (1 - ({KEY_TERMS})) ELSE 0.0 END, 6) AS penalty FROM d")
def numeric_penalty(spark, sf_dir):
    return candidates(spark, sf_dir, True).select("a", "b", F.round(scores.numeric_penalty(F.col("x"), F.col("y")), 6).alias("penalty"))


@query("semantic_enhanced")
def semantic_enhanced(spark, sf_dir):
    df = semantic_candidates(spark, sf_dir, True).withColumn("lexical", fuzzy.kernel(fuzzy.blocks_ratio)(F.lower("x"), F.lower("y")) / 100)
    return df.select("a", "b", F.round(scores.enhanced_semantic(F.col("semantic"), F.col("lexical"), F.col("x"), F.col("y")), 6).alias("score"))


#: Oracle CTE v(id, term, x): unit-length TF-IDF weights of 1- to 3-word terms of items, words of two or more signs.
VECTORS = r"""tw AS (SELECT id, list_filter(regexp_extract_all(lower(name), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 2) AS w FROM i),
tg AS (SELECT id, array_to_string(w[s:s + k - 1], ' ') AS term FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM tw CROSS JOIN (VALUES (1), (2), (3)) AS ks(k) WHERE len(w) >= k)),
tf AS (SELECT id, term, count(*) AS tf FROM tg GROUP BY id, term), idf AS (SELECT term, ln((1 + (SELECT count(*) FROM i)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
rw AS (SELECT id, term, tf * idf AS x FROM tf JOIN idf USING (term)), v AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM rw)"""


@query("pair_cosine", f"WITH {PAIRS}, {VECTORS}, s AS (SELECT a, b, sum(m.x * n.x) AS s FROM p JOIN v m ON m.id = a JOIN v n ON n.id = b AND n.term = m.term GROUP BY a, b) SELECT p.a, p.b, round(coalesce(s, 0.0), 6) AS score FROM p LEFT JOIN s ON s.a = p.a AND s.b = p.b")
def pair_cosine(spark, sf_dir):
    return semantic_candidates(spark, sf_dir).select("a", "b", F.round("semantic", 6).alias("score"))


DBSCAN_SIM = f"""WITH {PAIRS}, {VECTORS}, n AS (SELECT count(*) AS n FROM i), t AS (SELECT term, sum(x) / n AS m, sqrt(greatest(sum(x * x) / n - (sum(x) / n) * (sum(x) / n), 0)) AS s FROM v CROSS JOIN n GROUP BY term, n),
z AS (SELECT i.id, t.term, (coalesce(v.x, 0) - t.m) / CASE WHEN t.s < 1e-9 THEN 1 ELSE t.s END AS z, coalesce(v.x, 0) AS x FROM i CROSS JOIN t LEFT JOIN v ON v.id = i.id AND v.term = t.term),
s AS (SELECT a, b, sum(m.x * o.x) AS cosine, sum(m.z * o.z) / sqrt(sum(m.z * m.z) * sum(o.z * o.z)) AS scaled FROM p JOIN z m ON m.id = a JOIN z o ON o.id = b AND o.term = m.term GROUP BY a, b)
SELECT a, b, round(0.6 * cosine + 0.4 * scaled, 5) AS score FROM s"""


@query("dbscan_sim", DBSCAN_SIM)
def dbscan_sim(spark, sf_dir):
    """.6 cosine + .4 cosine of standard-scaled vectors. Scaling makes vectors dense, but their products are sums over common terms, plus sums of each item and a constant."""
    i = written(items(spark, sf_dir))
    v = written(scores.term_vectors(i, "id", "name").select("id", F.explode("vector").alias("term", "x")))
    n = i.count()
    t = v.groupBy("term").agg((F.sum("x") / n).alias("m"), (F.sum(F.col("x") * F.col("x")) / n).alias("q")).withColumn("var", F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0)))
    t = written(t.select("term", "m", F.when(F.col("var") < 1e-18, 1.0).otherwise(F.col("var")).alias("var")))
    c = t.agg(F.sum(F.col("m") * F.col("m") / F.col("var"))).first()[0]
    w = v.join(t, "term")
    own = w.groupBy("id").agg(F.sum(F.col("m") * F.col("x") / F.col("var")).alias("l"), F.sum(F.col("x") * F.col("x") / F.col("var")).alias("q"))
    own = i.select("id").join(own, "id", "left").na.fill(0.0, ["l", "q"]).withColumn("norm", F.sqrt(F.col("q") - 2 * F.col("l") + c))
    vectors = w.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "x"))).alias("vector"), F.map_from_entries(F.collect_list(F.struct("term", F.col("x") / F.sqrt("var")))).alias("scaled"))
    side = written(own.join(vectors, "id", "left"))
    a, b = (side.select(F.col("id").alias(k), F.struct("l", "norm", "vector", "scaled").alias(f"s{k}")) for k in "ab")
    met = candidates(spark, sf_dir).join(a, "a").join(b, "b")
    scaled = (scores.vector_dot(F.col("sa.scaled"), F.col("sb.scaled")) - F.col("sa.l") - F.col("sb.l") + c) / (F.col("sa.norm") * F.col("sb.norm"))
    return met.select("a", "b", F.round(0.6 * scores.vector_dot(F.col("sa.vector"), F.col("sb.vector")) + 0.4 * scaled, 5).alias("score"))


IMPROVED = f"""WITH {PAIRS}, {DIRECTED}, {VECTORS}, s AS (SELECT a, b, sum(m.x * n.x) AS s FROM d JOIN v m ON m.id = a JOIN v n ON n.id = b AND n.term = m.term GROUP BY a, b),
e AS (SELECT d.*, CASE WHEN words >= 0.4 THEN words ELSE 0 END AS f, CASE WHEN s >= 0.7 THEN s ELSE 0 END AS s,
  len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3)), list_distinct(list_filter(regexp_extract_all(lower(y), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3)))) AS k
  FROM d LEFT JOIN s ON s.a = d.a AND s.b = d.b WHERE words >= 0.4 OR s >= 0.7),
e1 AS (SELECT *, (0.6 * f + 0.4 * s) * CASE WHEN cx <> '' AND cy <> '' AND cx <> cy THEN 0.7 ELSE 1.0 END AS q FROM e),
e2 AS (SELECT *, CASE WHEN k < 1 THEN 0.5 * q ELSE q + least(0.3, 0.05 * k) END AS q2 FROM e1),
e3 AS (SELECT *, CASE WHEN bx = '' OR by_ = '' THEN q2 WHEN lower(bx) = lower(by_) THEN q2 + 0.15 ELSE q2 * 0.9 END AS q3 FROM e2),
o AS (SELECT a AS qid, b AS id, round(least(1.0, q3 + CASE WHEN f > 0 AND s > 0 THEN 0.1 * least(f, s) ELSE 0.0 END), 6) AS score FROM e3)
SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM o WHERE score >= 0.4) WHERE rank <= 20"""


@query("improved_score", IMPROVED.replace("\\\\", "\\"))
def improved_score(spark, sf_dir):
    """Each name's twenty best others: word Jaccard from .4 on as the fuzzy engine, term cosine from .7 on as the semantic one, re-scored."""
    df = semantic_candidates(spark, sf_dir, True).withColumns({"f": F.when(F.col("words") >= 0.4, F.col("words")), "s": F.when(F.col("semantic") >= 0.7, F.col("semantic"))}).where("f IS NOT NULL OR s IS NOT NULL")
    score = scores.improved(F.col("f"), F.col("s"), F.col("x"), F.col("y"), F.col("category_x"), F.col("category_y"), F.col("brand_x"), F.col("brand_y"))
    return fusion.ranked(df.select(F.col("a").alias("qid"), F.col("b").alias("id"), F.round(score, 6).alias("score")).where("score >= 0.4"), 20)


@query("dup_score")
def dup_score(spark, sf_dir):
    out = scores.duplicates(semantic_candidates(spark, sf_dir))
    return out.select("a", "b", "duplicate_type", F.round("score", 6).alias("score"))


@query("dup_main_type")
def dup_main_type(spark, sf_dir):
    return scores.main_duplicate_type(scores.duplicates(semantic_candidates(spark, sf_dir)).where("duplicate_type IS NOT NULL"))


@query("analog_score")
def analog_score(spark, sf_dir):
    """Every name's hundred best analogs of a similarity of .25 or more."""
    out = scores.analogs(semantic_candidates(spark, sf_dir, True)).where("similarity >= 0.25")
    ranked = fusion.ranked(out.select(F.col("a").alias("qid"), F.col("b").alias("id"), F.round("similarity", 6).alias("score"), F.round("confidence", 6).alias("confidence"), "analog_type"), 100)
    return ranked


@query("similarity_bands")
def similarity_bands(spark, sf_dir):
    """Pairs of names by token-sort ratio: from 80 up to 100 and from 70 up to 80."""
    df = candidates(spark, sf_dir).withColumn("ratio", fuzzy.kernel(fuzzy.token_sort_ratio)("x", "y")).where("ratio >= 70 AND ratio < 100")
    return df.select("a", "b", F.round("ratio", 6).alias("ratio"), F.when(F.col("ratio") >= 80, "80-100").otherwise("70-80").alias("band"))


def engines(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The token engine's and the TF-IDF engine's 50 best documents for each benchmark text."""
    from .search import hits, token_hits

    f = run(spark, sf_dir, f"WITH {token_hits(SPARK)} {top('tok_hits', 50)}")
    s = run(spark, sf_dir, f"WITH {hits(SPARK)} {top('tfidf_hits', 50)}")
    return written(f), written(s)


MERGED = both(DUCK)
#: Oracle CTE: an engine's confidence for each query.
CONFIDENCE = "cf AS (SELECT qid, least(1.0, 0.6 * least(count(*) / 20.0, 1.0) + 0.4 * avg(score)) AS c FROM f GROUP BY qid), cs AS (SELECT qid, least(1.0, 0.6 * least(count(*) / 20.0, 1.0) + 0.4 * avg(score)) AS c FROM s GROUP BY qid)"
WEIGHTS = {"fuzzy": 0.4, "semantic": 0.6}
BOTH_FOUND = "CASE WHEN fs IS NOT NULL AND ss IS NOT NULL THEN {} ELSE 0 END"
FUSIONS = {
    "hybrid_weighted": (lambda f, s: fusion.weighted_sum(f, s), f"SELECT qid, id, 0.4 * coalesce(fs, 0) + 0.6 * coalesce(ss, 0) + {BOTH_FOUND.format('0.1 * least(fs, ss)')} AS score FROM (SELECT qid, id, CASE WHEN fs >= 0.5 THEN fs END AS fs, CASE WHEN ss >= 0.4 THEN ss END AS ss FROM m) WHERE fs IS NOT NULL OR ss IS NOT NULL"),
    "fuse_rrf": (lambda f, s: fusion.rank_fusion(f, s), "SELECT qid, id, coalesce(1.0 / (60 + fr), 0) + coalesce(1.0 / (60 + sr), 0) AS score FROM m"),
    "fuse_rrf_weighted": (lambda f, s: fusion.weighted_rank_fusion({"fuzzy": f, "semantic": s}, WEIGHTS), "SELECT qid, id, coalesce(0.4 / (60 + fr), 0) + coalesce(0.6 / (60 + sr), 0) AS score FROM m"),
    "fuse_cascade": (lambda f, s: fusion.cascade(f, s), "SELECT qid, id, CASE WHEN ss >= 0.7 THEN ss WHEN fs >= 0.5 THEN fs * 0.8 ELSE ss END AS score FROM m WHERE ss >= 0.4 OR fs >= 0.5"),
    "fuse_consensus": (lambda f, s: fusion.consensus({"fuzzy": f, "semantic": s}, WEIGHTS), f"SELECT * FROM (SELECT m.qid, m.id, least(1.0, (coalesce(fs * 0.4 * cf.c, 0) + coalesce(ss * 0.6 * cs.c, 0)) / (CASE WHEN fs IS NOT NULL AND ss IS NOT NULL THEN 2 ELSE 1 END) + {BOTH_FOUND.format('0.1')}) AS score FROM m LEFT JOIN cf ON cf.qid = m.qid LEFT JOIN cs ON cs.qid = m.qid) WHERE score >= 0.3"),
    "fuse_confidence": (lambda f, s: fusion.confidence_based({"fuzzy": f, "semantic": s}), "SELECT * FROM (SELECT m.qid, m.id, CASE WHEN fs IS NOT NULL AND cf.c >= 0.3 AND (ss IS NULL OR coalesce(cs.c, 0) < 0.3 OR cf.c >= cs.c) THEN fs WHEN ss IS NOT NULL AND cs.c >= 0.3 THEN ss END AS score FROM m LEFT JOIN cf ON cf.qid = m.qid LEFT JOIN cs ON cs.qid = m.qid) WHERE score IS NOT NULL"),
    "fuse_simple": (lambda f, s: fusion.simple(f, s), f"SELECT qid, id, 0.4 * coalesce(fs, 0) + 0.6 * coalesce(ss, 0) + {BOTH_FOUND.format('0.1')} AS score FROM m"),
    "facade_fallback": (lambda f, s: fusion.facade(f, s), "SELECT qid, id, greatest(coalesce(fs, 0), coalesce(ss, 0)) AS score FROM m WHERE ss >= 0.7 OR fs >= 0.6"),
}
for _name, (_fuse, _sql) in FUSIONS.items():

    @query(_name, f"WITH {MERGED}, {CONFIDENCE}, x AS (SELECT qid, id, round(score, 6) AS score FROM ({_sql})) {top('x', 20)}")
    def _(spark, sf_dir, fuse=_fuse):
        return fusion.ranked(fuse(*engines(spark, sf_dir)).withColumn("score", F.round("score", 6)), 20)


@query(
    "fuse_improved",
    rf"""WITH {MERGED}, e AS (SELECT m.qid, m.id, CASE WHEN fs >= 0.4 THEN fs ELSE 0 END AS f, CASE WHEN ss >= 0.7 THEN ss ELSE 0 END AS s, len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(b.text), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 3)), list_distinct(list_filter(regexp_extract_all(lower(d.text), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 3)))) AS k
FROM m JOIN benchmark b ON b.item_id = m.qid JOIN documents d ON d.doc_id = m.id WHERE fs >= 0.4 OR ss >= 0.7), x AS (SELECT qid, id, round(least(1.0, CASE WHEN k < 1 THEN 0.5 * (0.6 * f + 0.4 * s) ELSE 0.6 * f + 0.4 * s + least(0.3, 0.05 * k) END + CASE WHEN f > 0 AND s > 0 THEN 0.1 * least(f, s) ELSE 0 END), 6) AS score FROM e)
{top("x", 20, "score >= 0.4")}""",
)
def fuse_improved(spark, sf_dir):
    f, s = engines(spark, sf_dir)
    m = fusion.merged(f.where("score >= 0.4"), s.where("score >= 0.7"))
    q = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))
    t = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    none = F.lit("")
    score = scores.improved(F.col("fs"), F.col("ss"), F.col("q"), F.col("t"), none, none, none, none)
    return fusion.ranked(m.join(q, "qid").join(t, "id").select("qid", "id", F.round(score, 6).alias("score")).where("score >= 0.4"), 20)


def named(spark, sf_dir) -> DataFrame:
    """(id, name): all names of part, and the fixed ones."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("name"))
    return part.union(spark.createDataFrame([r[:2] for r in D.CATALOG], "id long, name string"))


def rules_sql() -> str:
    """Oracle CTEs: n(id, t), k(category, size, priority, word), sc(id, category, kw, pt)."""
    words = ", ".join(f"({quoted(c)}, {len(ws)}, {D.CATEGORY_PRIORITY.get(c, 999)}, {quoted(w)})" for c, ws in D.CATEGORY_KEYWORDS.items() for w in ws)
    patterns = ", ".join(f"({quoted(c)}, {len(ps)}, {quoted('[^a-zа-яё0-9_](' + p + ')')})" for c, ps in D.CATEGORY_PATTERNS.items() for p in ps)
    return f"""n AS (SELECT p_partkey AS id, trim(lower(p_name)) AS t FROM part UNION ALL SELECT * FROM (SELECT id, trim(lower(name)) FROM (VALUES {FIXED}) AS z(id, name, category, brand))),
k(category, size, priority, word) AS (VALUES {words}), pt(category, size, pattern) AS (VALUES {patterns}),
u AS (SELECT DISTINCT t FROM n), kh AS (SELECT t, category, priority, count(*) / max(size) AS kw FROM u JOIN k ON contains(t, word) GROUP BY t, category, priority),
ph AS (SELECT t, category, count(*) / max(size) AS ps FROM u JOIN pt ON regexp_matches(' ' || t, pattern) GROUP BY t, category),
sc AS (SELECT t, category, coalesce(priority, (SELECT max(priority) FROM k WHERE k.category = ph.category)) AS priority, coalesce(kw, 0) AS kw, round(0.7 * coalesce(kw, 0) + 0.3 * coalesce(ps, 0), 12) AS score FROM kh FULL JOIN ph USING (t, category)),
mx AS (SELECT t, max(score) AS most FROM sc GROUP BY t), pick AS (SELECT t, category, score FROM (SELECT sc.*, row_number() OVER (PARTITION BY sc.t ORDER BY priority, score DESC, category) AS r FROM sc JOIN mx ON mx.t = sc.t WHERE score > 0 AND most - score < 0.1) WHERE r = 1),
cl AS (SELECT n.id, n.t, CASE WHEN score >= 0.01 THEN category ELSE '{D.DEFAULT_CATEGORY}' END AS category, CASE WHEN score >= 0.01 THEN score ELSE 0.0 END AS confidence FROM n LEFT JOIN pick ON pick.t = n.t)"""


@query("classify", f"WITH {rules_sql()} SELECT id, category, round(confidence, 6) AS confidence FROM cl")
def classified(spark, sf_dir):
    return classify.classified(named(spark, sf_dir), "name").select("id", "category", F.round("confidence", 6).alias("confidence"))


@query("category_stats", f"WITH {rules_sql()} SELECT category, count(*) AS n, round(avg(confidence), 6) AS mean FROM cl GROUP BY category")
def category_stats(spark, sf_dir):
    return classify.classified(named(spark, sf_dir), "name").groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"))


SURE_SQL = "CASE WHEN m = 0 THEN 0.3 " + " ".join(f"WHEN cl.category = '{c}' AND regexp_matches(cl.t, '{'|'.join(ws)}') THEN {v}" for c, (ws, v) in classify.SURE.items()) + " ELSE least(0.85, 0.5 + 0.5 * m / size) END"


@query(
    "classify_enhanced",
    f"""WITH {rules_sql()}, mm AS (SELECT cl.id, count(word) AS m, max(size) AS size, list(word) FILTER (WHERE word IS NOT NULL) AS ws FROM cl LEFT JOIN k ON k.category = cl.category AND contains(t, word) GROUP BY cl.id),
al AS (SELECT t, string_agg(category, ',' ORDER BY r) AS alternatives FROM (SELECT t, category, row_number() OVER (PARTITION BY t ORDER BY round(kw, 12) DESC, category) AS r FROM sc WHERE kw > 0) WHERE r <= 3 GROUP BY t)
SELECT cl.id, cl.category, round(confidence, 6) AS confidence, round({SURE_SQL}, 6) AS validation, coalesce(array_to_string(list_sort(ws), ','), '') AS matched, coalesce(alternatives, '') AS alternatives FROM cl JOIN mm ON mm.id = cl.id LEFT JOIN al ON al.t = cl.t""",
)
def classify_enhanced(spark, sf_dir):
    out = classify.classified(named(spark, sf_dir), "name")
    return out.select("id", "category", F.round("confidence", 6).alias("confidence"), F.round("validation", 6).alias("validation"), F.array_join(F.array_sort("matched_keywords"), ",").alias("matched"), F.array_join("alternatives", ",").alias("alternatives"))
