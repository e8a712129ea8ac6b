"""Stored indexes over a user's own table, and search in them.

    tables = build(df, "id", "text", path)      # once; `load` finds them again
    hits = search(tables, queries, "hybrid", k=10)

An index is a folder of Parquet tables: items, postings, weights (unit-length TF-IDF), terms (document frequency, token id), bands (MinHash),
meta. Queries are a table (qid, text); a search is one plan for all of them and gives (qid, id, score, rank)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import marked, maybe_in, written
from . import fusion, minhash, pairs

TOKEN = r"[\p{L}\p{N}_]+"
#: Of a MinHash search, see minhash.BANDS.
LSH_LEAST = 0.6
TABLES = ("items", "postings", "weights", "terms", "bands")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def tf_of(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.explode(words(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def build(df: DataFrame, id_col: str, text_col: str, path: str, category_col: str | None = None, only: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """Writes the index of df under path and returns its tables: items, and `only` those of the others that the methods meant to be used read (lsh: bands;
    else all). Rows with a null id are left out; null texts are items without terms."""
    spark = df.sparkSession
    category = F.col(category_col).cast("string") if category_col else F.lit(None).cast("string")
    items = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), category.alias("category"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    items.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/items")
    _derive(spark, path, only)
    return load(spark, path, ("items", *only))


def _derive(spark: SparkSession, path: str, only: tuple[str, ...] = TABLES) -> None:
    """The tables that follow from items; postings, weights and terms go together."""
    items = spark.read.parquet(f"{path}/items")
    if "bands" in only:
        minhash.signed(minhash.hashed(pairs.token_sets(items, "id", "text"))).write.mode("overwrite").parquet(f"{path}/bands")
    if not set(only) & {"postings", "weights", "terms"}:
        return
    tf_of(items, "id").write.mode("overwrite").parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    df = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))
    n = items.count()
    df.withColumn("idf", F.ln((1.0 + n) / (1.0 + F.col("df"))) + 1.0).write.mode("overwrite").parquet(f"{path}/terms")
    raw = postings.join(spark.read.parquet(f"{path}/terms").select("term", "idf"), "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("x"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    raw.join(norm, "id").select("id", "term", (F.col("x") / F.col("norm")).alias("w")).write.mode("overwrite").parquet(f"{path}/weights")


def update(df: DataFrame, id_col: str, text_col: str, path: str, version: str, category_col: str | None = None) -> dict[str, DataFrame]:
    """A new index under path/version: rows of df replace or join those of the index at path, unchanged ones (by hash) are skipped. An index
    is never changed in place, so readers of the old one are undisturbed and a lost job leaves it whole."""
    spark = df.sparkSession
    old = spark.read.parquet(f"{path}/items")
    category = F.col(category_col).cast("string") if category_col else F.lit(None).cast("string")
    new = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), category.alias("category"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    changed = new.join(old.select("id", "hash"), ["id", "hash"], "left_anti")
    old.join(changed.select("id"), "id", "left_anti").unionByName(changed).write.mode("overwrite").parquet(f"{path}/{version}/items")
    _derive(spark, f"{path}/{version}")
    return load(spark, f"{path}/{version}")


def load(spark: SparkSession, path: str, tables: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{path}/{t}") for t in tables}


def query_tf(queries: DataFrame) -> DataFrame:
    return tf_of(queries, "qid")


def tfidf(t: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """Cosine of TF-IDF vectors; the queries' side is weighted by the index's own frequencies."""
    q = query_tf(queries).join(t["terms"].select("term", "idf"), "term").select("qid", "term", (F.col("tf") * F.col("idf")).alias("x"))
    norm = q.groupBy("qid").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    q = q.join(norm, "qid").select("qid", "term", (F.col("x") / F.col("norm")).alias("qw"))
    return q.join(t["weights"], "term").groupBy("qid", "id").agg(F.sum(F.col("qw") * F.col("w")).alias("score"))


def inverted(t: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """Hits over the query's tokens, repeats included."""
    q = query_tf(queries)
    n = q.groupBy("qid").agg(F.sum("tf").alias("n"))
    return q.join(t["postings"].select("id", "term"), "term").groupBy("qid", "id").agg(F.sum("tf").alias("hits")).join(n, "qid").select("qid", "id", (F.col("hits") / F.col("n")).alias("score"))


def distinct_hits(t: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    q = query_tf(queries).select("qid", "term")
    n = q.groupBy("qid").agg(F.count("*").alias("n"))
    known = q.join(t["terms"].select("term"), "term", "left_semi").groupBy("qid").agg(F.count("*").alias("known"))
    return q.join(t["postings"], "term").groupBy("qid", "id").agg(F.count("*").alias("hits"), F.sum("tf").alias("tf")).join(n, "qid").join(known, "qid")


def exact(t: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    return distinct_hits(t, queries).where("hits = n").select("qid", "id", F.lit(1.0).alias("score"))


def partial(t: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    return distinct_hits(t, queries).where("hits < n AND hits >= greatest(1, floor(n / 2))").select("qid", "id", (F.col("hits") / F.col("n")).alias("score"))


def full_text(t: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """Items with all of the query's words (a word that no item has makes the query empty), by the sum of 1 + ln tf over 1 + ln of the item's length."""
    length = t["postings"].groupBy("id").agg(F.sum("tf").alias("len"))
    q = query_tf(queries).select("qid", "term")
    n = q.groupBy("qid").agg(F.count("*").alias("n"))
    met = q.join(t["postings"], "term").groupBy("qid", "id").agg(F.count("*").alias("hits"), F.sum(1 + F.ln("tf")).alias("s")).join(n, "qid").where("hits = n")
    return met.join(length, "id").select("qid", "id", (F.col("s") / (1 + F.ln("len"))).alias("score"))


def prefix(t: dict[str, DataFrame], queries: DataFrame, least: int = 2) -> DataFrame:
    """Items with a word that begins with the query text, as a range of terms."""
    q = queries.select("qid", F.lower(F.trim("text")).alias("p")).where(F.length("p") >= least)
    terms = t["terms"].select("term", F.substring("term", 1, least).alias("head"))
    met = q.withColumn("head", F.substring("p", 1, least)).join(terms, "head").where(F.startswith("term", F.col("p")))
    found = met.select("qid", "p", "term").join(t["postings"].select("id", "term"), "term").select("qid", "p", "id").distinct()
    return found.join(t["items"].select("id", "text"), "id").select("qid", "id", (F.length("p") / F.length("text")).alias("score"))


def substring(t: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """Items that contain the query text, found by its three-sign pieces' rarest, then checked; shorter queries are looked for as prefixes of words."""
    q = queries.select("qid", F.lower(F.trim("text")).alias("p")).where(F.length("p") >= 3)
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))
    held = t["items"].where(F.length("text") >= 3).select("id", F.explode(pieces(F.lower("text"))).alias("g"))
    asked = q.select("qid", "p", F.explode(pieces(F.col("p"))).alias("g"))
    wanted = held.join(asked.select("g").distinct(), "g", "left_semi")
    df = wanted.groupBy("g").agg(F.count("*").alias("df"))
    # a piece that no item has leaves its query without answers
    rare = asked.join(df, "g", "left").groupBy("qid", "p").agg(F.min_by("g", F.coalesce("df", F.lit(0))).alias("g"))
    met = rare.join(wanted, "g").join(t["items"].select("id", "text"), "id").where(F.contains(F.lower("text"), F.col("p")))
    return met.select("qid", "id", (F.length("p") / F.length("text")).alias("score"))


def jaccard_of(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def scored_sets(met: DataFrame, t: dict[str, DataFrame], queries: DataFrame, least: float) -> DataFrame:
    q = queries.select("qid", F.array_distinct(words(F.col("text"))).alias("a"))
    d = t["items"].select("id", F.array_distinct(words(F.col("text"))).alias("b"))
    return met.join(q, "qid").join(d, "id").select("qid", "id", jaccard_of(F.col("a"), F.col("b")).alias("score")).where(F.col("score") >= least - 1e-12)


def lsh(t: dict[str, DataFrame], queries: DataFrame, least: float = LSH_LEAST, most: int | None = None) -> DataFrame:
    """Items that share a MinHash band with the query, by their true Jaccard of words, from `least` on; with `most`, at least the best so many of each query.
    Approximate: see minhash.BANDS. Texts of equal words are one class, items or queries; only classes meet, and only those with a query meet others."""
    tag = lambda kind: F.concat(F.lit(kind), F.col("id").cast("string"))
    asked_sets = written(minhash.hashed(pairs.token_sets(queries, "qid", "text")), "zstd")
    asked = written(minhash.signed(asked_sets))
    nodes = t["bands"].withColumns({"node": tag("i"), "asked": F.lit(False)}).drop("id").unionByName(asked.withColumns({"node": tag("q"), "asked": F.lit(True)}).drop("id"))
    # an item's name goes before a query's, so a class with items is named by one
    names = written(nodes.groupBy("k1", "k2", "n").agg(F.min("node").alias("node"), F.max("asked").alias("asked"), F.max(~F.col("asked")).alias("held")))
    reps = maybe_in(nodes.drop("asked"), "node", names.select("node")).withColumnRenamed("node", "id")
    reps = written(reps.withColumn("asked", marked("id", names.where("asked").select("node"))))
    flags = lambda k: names.select(F.col("node").alias(k), F.col("asked").alias(f"asked_{k}"), F.col("held").alias(f"held_{k}"))
    met = minhash.candidates(reps, least, minhash.tasks_of(reps.count())).join(flags("a"), "a").join(flags("b"), "b")
    met = written(met.where("asked_a AND held_b OR asked_b AND held_a"))
    ends = met.select(F.explode(F.array("a", "b")).alias("id"))
    texts = maybe_in(t["items"].select(tag("i").alias("id"), "text"), "id", ends)
    sets = written(minhash.hashed(pairs.token_sets(texts, "id", "text")).union(asked_sets.select(tag("q").alias("id"), "h")), "zstd")
    found = pairs.checked(sets, met.select("a", "b"), least).join(flags("a"), "a").join(flags("b"), "b")
    hits = found.where("asked_a AND held_b").selectExpr("a AS q", "b AS node", "score").union(found.where("asked_b AND held_a").selectExpr("b", "a", "score"))
    hits = written(hits.union(names.where("asked AND held").selectExpr("node", "node", "1.0D")))
    of = lambda signatures: signatures.select("id", "k1", "k2", "n").join(names.select("k1", "k2", "n", "node"), ["k1", "k2", "n"]).select("node", "id")
    members = of(maybe_in(t["bands"], "k1", names.join(hits.select("node").distinct(), "node").select("k1")))
    if most:
        members = members.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("r") <= most).drop("r")
    hits = hits.join(members, "node").select("q", "id", "score")
    if most:
        hits = hits.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.round("score", 6).desc(), "id"))).where(F.col("r") <= most).drop("r")
    return hits.join(of(asked).select(F.col("node").alias("q"), F.col("id").alias("qid")), "q").select("qid", "id", "score")


def jaccard(t: dict[str, DataFrame], queries: DataFrame, least: float = LSH_LEAST) -> DataFrame:
    """The exact form of lsh: the query's n - ceil(least n) + 1 rarest words are probed; what is that similar holds one of them."""
    q = query_tf(queries).select("qid", "term").join(t["terms"].select("term", "df"), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    n = F.count("*").over(Window.partitionBy("qid"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("df", "term"))
    probes = q.withColumn("n", n).withColumn("p", place).where(F.col("p") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1)
    return scored_sets(probes.select("qid", "term").join(t["postings"].select("id", "term"), "term").select("qid", "id").distinct(), t, queries, least)


def fuzzy(t: dict[str, DataFrame], queries: DataFrame, candidates: int = 100, least: float = 0.3) -> DataFrame:
    """TF-IDF candidates from `least` on, at most `candidates` a query, of a string ratio of 60 or a best ratio of 70: .4 cosine + .3 best + .3 ratio."""
    from ..functions import fuzzy as kernels

    met = fusion.ranked(tfidf(t, queries).where(F.col("score") >= least), candidates)
    met = met.join(queries.select("qid", F.lower("text").alias("q")), "qid").join(t["items"].select("id", F.lower("text").alias("t")), "id")
    k = {n: kernels.kernel(f)("q", "t") for n, f in (("ratio", kernels.ratio), ("partial", kernels.partial_ratio), ("sort", kernels.token_sort_ratio), ("set", kernels.token_set_ratio))}
    met = met.withColumns(k).withColumn("best", F.greatest("ratio", "partial", "sort", "set")).where("ratio >= 60 OR best >= 70")
    return met.select("qid", "id", (0.4 * F.col("score") + 0.3 * F.col("best") / 100 + 0.3 * F.col("ratio") / 100).alias("score"))


def semantic(t: dict[str, DataFrame], queries: DataFrame, k: int = 10, least: float = 0.5, category_col: str | None = None) -> DataFrame:
    """Cosine from `least` on, 2 k candidates a query, re-scored by key terms, numbers and the text's blocks. With a column of the queries
    for the category, items of another one are left out, unless no item has it."""
    from ..functions import fuzzy as kernels
    from .scores import enhanced_semantic

    met = tfidf(t, queries).where(F.col("score") >= least)
    if category_col:
        asked = queries.select("qid", F.col(category_col).alias("asked"))
        have = t["items"].select(F.col("category").alias("asked")).distinct().withColumn("_known", F.lit(True))
        met = met.join(asked.join(have, "asked", "left"), "qid").join(t["items"].select("id", "category"), "id").where(F.col("_known").isNull() | (F.col("asked") == F.col("category"))).select("qid", "id", "score")
    met = fusion.ranked(met, 2 * k).join(queries.select("qid", F.col("text").alias("q")), "qid").join(t["items"].select("id", F.col("text").alias("t")), "id")
    met = met.withColumn("lexical", kernels.kernel(kernels.blocks_ratio)(F.lower("q"), F.lower("t")) / 100)
    return met.select("qid", "id", enhanced_semantic(F.col("score"), F.col("lexical"), F.col("q"), F.col("t")).alias("score"))


def hybrid(t: dict[str, DataFrame], queries: DataFrame, strategy: str = "weighted_sum", candidates: int = 50) -> DataFrame:
    """Both engines' best `candidates`, fused."""
    f, s = fusion.ranked(fuzzy(t, queries), candidates), fusion.ranked(tfidf(t, queries), candidates)
    return {"weighted_sum": fusion.weighted_sum, "rank_fusion": fusion.rank_fusion, "cascade": fusion.cascade}[strategy](f, s)


def advanced(t: dict[str, DataFrame], queries: DataFrame, candidates: int = 20) -> DataFrame:
    """The weighted mean over the methods that returned an item."""
    weights = {"exact": 0.6, "partial": 0.4, "prefix": 0.3, "inverted": 0.4, "tfidf": 0.35, "lsh": 0.25, "jaccard": 0.3}
    found = {n: fusion.ranked(METHODS[n](t, queries), candidates) for n in weights}
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return fusion.stacked(found).withColumn("w", F.element_at(w, F.col("engine"))).groupBy("qid", "id").agg((F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("score"))


def fallback(t: dict[str, DataFrame], queries: DataFrame, chain: tuple[str, ...] = ("semantic", "fuzzy", "hybrid", "substring")) -> DataFrame:
    """Each query's results of the first method of the chain that finds any. All are planned; a query's first answer wins, on the cluster."""
    found = reduce(DataFrame.unionByName, [METHODS[n](t, queries).select("qid", "id", "score").withColumn("at", F.lit(k)) for k, n in enumerate(chain)])
    first = found.groupBy("qid").agg(F.min("at").alias("at"))
    return found.join(first, ["qid", "at"]).select("qid", "id", "score")


METHODS = {
    "tfidf": tfidf, "inverted": inverted, "exact": exact, "partial": partial, "fts": full_text, "prefix": prefix, "substring": substring, "lsh": lsh, "jaccard": jaccard,
    "fuzzy": fuzzy, "semantic": semantic, "hybrid": hybrid, "advanced": advanced, "fallback": fallback,
}
#: What suits a kind of query.
ADVICE = {"code": "exact", "short": "prefix", "name": "hybrid", "text": "tfidf", "near copy": "lsh"}


def search(tables: dict[str, DataFrame], queries: DataFrame, method: str = "hybrid", k: int = 10, **options) -> DataFrame:
    """(qid, id, score, rank): the k best of each query by a method of METHODS, ties by id. An unknown method is an error."""
    if method not in METHODS:
        raise ValueError(f"no method {method}; there are {', '.join(METHODS)}")
    options = {"most": k} | options if method == "lsh" else options
    return fusion.ranked(METHODS[method](tables, queries, **options).withColumn("score", F.round("score", 6)).where("score > 0"), k)


def similar(tables: dict[str, DataFrame], ids: DataFrame, method: str = "tfidf", k: int = 10) -> DataFrame:
    """For each id of ids(id) the results of a search by its own text, itself left out after the k best were cut."""
    queries = tables["items"].join(ids.select("id"), "id", "left_semi").select(F.col("id").alias("qid"), "text")
    return search(tables, queries, method, k).where("qid <> id")


def statistics(tables: dict[str, DataFrame]) -> dict[str, int]:
    return {"items": tables["items"].count(), "terms": tables["terms"].count(), "postings": tables["postings"].count(), "categories": tables["items"].select("category").distinct().count()}


class CellIndex:
    """Vectors in the cells of centroids that are fitted on a sample: nearest first by probing a query's best cells, then by exact cosine.

    Fitted on at most SAMPLE vectors, those whose id hashes lowest; every vector is indexed. Cells number about the square root of the rows."""

    SAMPLE = 20_000

    def __init__(self, vectors: DataFrame, id_col: str = "id", vector_col: str = "e", cells: int | None = None, rounds: int = 8, seed: int = 42):
        slim = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("e")).where("e IS NOT NULL")
        n = slim.count()
        cells = cells or max(1, min(4096, int(n**0.5)))
        drawn = slim.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 32)) < int((1 << 32) * min(1.0, self.SAMPLE / max(1, n)))).limit(2 * self.SAMPLE).toPandas().sort_values("id")
        x = np.array(drawn["e"].tolist(), np.float64).reshape(len(drawn), -1)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        rng = np.random.default_rng(seed)
        c = x[rng.permutation(len(x))[: min(cells, len(x))]] if len(x) else x
        for _ in range(rounds if len(x) else 0):
            own = (x @ c.T).argmax(1)
            c = np.array([x[own == k].sum(0) if (own == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        self.centroids = vectors.sparkSession.sparkContext.broadcast(c)
        self.table = written(self._placed(slim, 1))

    def _placed(self, vectors: DataFrame, cells: int) -> DataFrame:
        """(id, e, cell): a row for each of a vector's nearest cells, e at unit length."""
        shared = self.centroids

        def place(batches):
            for b in batches:
                if len(b) and len(shared.value):
                    x = np.array(b["e"].tolist(), np.float64)
                    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                    best = np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :cells]
                    yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), best.shape[1]), "e": list(np.repeat(x, best.shape[1], axis=0)), "cell": best.ravel().astype(np.int32)})

        kind = vectors.schema["id"].dataType.simpleString()
        return vectors.select("id", "e").mapInPandas(place, f"id {kind}, e array<double>, cell int")

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
        """(qid, id, score, rank): the k nearest of each query (id, e) among its `probes` nearest cells, itself left out."""
        q = self._placed(queries, probes).select(F.col("id").alias("qid"), F.col("e").alias("q"), "cell")
        dot = F.aggregate(F.zip_with("q", "e", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        met = q.join(self.table, "cell").where("qid <> id").select("qid", "id", F.round(dot, 6).alias("score"))
        return fusion.ranked(met, k)
