"""Fusion of engines' results: each engine gives (qid, id, score, rank); a fusion gives (qid, id, score).

Engines are stacked and folded by one aggregation on (qid, id), one exchange, instead of a chain of outer joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FUZZY_WEIGHT, SEMANTIC_WEIGHT, LEAST_FUZZY, LEAST_SEMANTIC = 0.4, 0.6, 0.5, 0.4
#: Candidates for full confidence of an engine; engines under LEAST_CONFIDENCE are passed over.
FULL, LEAST_CONFIDENCE, LEAST_CONSENSUS = 20, 0.3, 0.3


def stacked(engines: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select("qid", "id", F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("rank"), F.lit(n).alias("engine")) for n, df in engines.items()])


def of(engine: str, column: str = "score") -> F.Column:
    return F.max(F.when(F.col("engine") == engine, F.col(column)))


def merged(fuzzy: DataFrame, semantic: DataFrame) -> DataFrame:
    """(qid, id, fs, ss, fr, sr): the full outer merge of two engines by item."""
    both = stacked({"fuzzy": fuzzy, "semantic": semantic})
    return both.groupBy("qid", "id").agg(of("fuzzy").alias("fs"), of("semantic").alias("ss"), of("fuzzy", "rank").alias("fr"), of("semantic", "rank").alias("sr"))


def scored(df: DataFrame, score: F.Column) -> DataFrame:
    return df.select("qid", "id", score.alias("score")).where("score IS NOT NULL")


def weighted_sum(fuzzy: DataFrame, semantic: DataFrame) -> DataFrame:
    """.4 fuzzy + .6 semantic of scores from .5 and .4 on, plus .1 of the lesser where both found it and both engines answered."""
    m = merged(fuzzy.where(F.col("score") >= LEAST_FUZZY), semantic.where(F.col("score") >= LEAST_SEMANTIC))
    f, s = F.coalesce("fs", F.lit(0.0)), F.coalesce("ss", F.lit(0.0))
    both = F.col("fs").isNotNull() & F.col("ss").isNotNull()
    return scored(m, FUZZY_WEIGHT * f + SEMANTIC_WEIGHT * s + F.when(both, 0.1 * F.least("fs", "ss")).otherwise(0.0))


def rank_fusion(fuzzy: DataFrame, semantic: DataFrame, k: int = 60) -> DataFrame:
    return scored(merged(fuzzy, semantic), F.coalesce(1 / (k + F.col("fr")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("sr")), F.lit(0.0)))


def weighted_rank_fusion(engines: dict[str, DataFrame], weights: dict[str, float], k: int = 60) -> DataFrame:
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return stacked(engines).groupBy("qid", "id").agg(F.sum(F.coalesce(F.element_at(weight, F.col("engine")), F.lit(0.1)) / (k + F.col("rank"))).alias("score"))


def cascade(fuzzy: DataFrame, semantic: DataFrame) -> DataFrame:
    """Semantic scores from .7 on; else fuzzy ones from .5 on, times .8; else semantic ones from .4 on."""
    f, s = F.col("fs"), F.col("ss")
    return scored(merged(fuzzy, semantic), F.when(s >= 0.7, s).when(f >= LEAST_FUZZY, f * 0.8).when(s >= LEAST_SEMANTIC, s))


def confidences(engines: dict[str, DataFrame], full: int = FULL) -> DataFrame:
    """(qid, engine, confidence): .6 of the share of `full` candidates, at most 1, + .4 of their mean score; at most 1."""
    c = 0.6 * F.least(F.count("*") / full, F.lit(1.0)) + 0.4 * F.avg("score")
    return stacked(engines).groupBy("qid", "engine").agg(F.least(c, F.lit(1.0)).alias("confidence"))


def consensus(engines: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """The mean over the engines that found an item of score x weight x the engine's confidence, + .1 for each engine after the first; at most 1, from .3 on."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    df = stacked(engines).join(confidences(engines), ["qid", "engine"])
    part = F.col("score") * F.coalesce(F.element_at(weight, F.col("engine")), F.lit(0.1)) * F.col("confidence")
    total = df.groupBy("qid", "id").agg(F.least(F.lit(1.0), F.sum(part) / F.count("*") + 0.1 * (F.count("*") - 1)).alias("score"))
    return total.where(F.col("score") >= LEAST_CONSENSUS)


def confidence_based(engines: dict[str, DataFrame]) -> DataFrame:
    """An item's score from the most confident engine (of .3 or more) that found it; of equally confident ones, the first given."""
    place = F.create_map(*[F.lit(x) for k, n in enumerate(engines) for x in (n, k)])
    df = stacked(engines).join(confidences(engines).where(F.col("confidence") >= LEAST_CONFIDENCE), ["qid", "engine"])
    first = F.row_number().over(Window.partitionBy("qid", "id").orderBy(F.col("confidence").desc(), F.element_at(place, F.col("engine"))))
    return df.withColumn("_r", first).where("_r = 1").select("qid", "id", "score")


def simple(fuzzy: DataFrame, semantic: DataFrame) -> DataFrame:
    """.4 fuzzy + .6 semantic, + .1 where both found it."""
    both = F.col("fs").isNotNull() & F.col("ss").isNotNull()
    return scored(merged(fuzzy, semantic), FUZZY_WEIGHT * F.coalesce("fs", F.lit(0.0)) + SEMANTIC_WEIGHT * F.coalesce("ss", F.lit(0.0)) + F.when(both, 0.1).otherwise(0.0))


def facade(fuzzy: DataFrame, semantic: DataFrame) -> DataFrame:
    """Semantic results from .7 on, and fuzzy ones from .6 on that aren't among them; by the greater score."""
    m = merged(fuzzy, semantic)
    s, f = F.coalesce("ss", F.lit(0.0)), F.coalesce("fs", F.lit(0.0))
    return scored(m.where((s >= 0.7) | (f >= 0.6)), F.greatest(s, f))


def ranked(df: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ties by id, with their rank."""
    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "id"))
    return df.withColumn("rank", r).where(F.col("rank") <= k)
