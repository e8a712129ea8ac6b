"""Histogram sort: equal-bytes shards of a total order, in DataFrame functions only.

Rows are ordered by a 63-bit key. Shard j ends where the bytes below the key reach j/shards of all bytes. The probes of
a round cut each interval that still holds an unsettled splitter in 2**DIGIT equal parts; one aggregation counts the
exact bytes below every probe, over all rows. Rounds go on until each splitter is within `tolerance` of its target (a
share of a shard's mean bytes), stands beside the one row that crosses the target, or the key's digits are used up.
Only (interval, bytes, rows) come to the driver: at most shards * 2**DIGIT rows a round. One exchange then deals rows by
(shard, key range), and gives each its slot: rows in earlier ranges of the shard plus its rank in the range.

Rows equal in the whole key lie in one shard, in one range; ties in it are ordered by `order`. Null sizes count as zero, null keys as key 0. An empty table gives an empty
table. Other columns pass through.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

KEY_BITS, DIGIT = 63, 12
#: A key range, in which slots are ranked by one task, aims at so many rows.
RANGE_ROWS = 100_000
#: The ranges' offsets are broadcast up to so many rows (24 bytes each), else joined by a shuffle.
BROADCAST_ROWS = 1 << 16


def splitters(rows: DataFrame, shards: int, tolerance: float = 1e-3) -> list[int]:
    """shards - 1 keys in ascending order; row r lies in the shard numbered by how many of them are <= its key. rows: key, size."""
    found: dict[int, int] = {}
    total = 0
    waiting: dict[int, tuple[int, list[int]]] = {0: (0, list(range(1, shards)))}  # interval's prefix -> bytes before it, splitters inside
    shift = KEY_BITS
    while waiting and shift > 0:
        step = min(DIGIT, shift)
        inside = rows if shift == KEY_BITS else rows.where(F.shiftright("key", shift).isin([*waiting]))
        shift -= step
        got = inside.groupBy(F.shiftright("key", shift).alias("p")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
        cells: dict[int, list] = {}
        for r in sorted(got, key=lambda r: r["p"]):
            cells.setdefault(r["p"] >> step, []).append(r)
        total = total or sum(r["b"] for r in got)
        nearer: dict[int, tuple[int, list[int]]] = {}
        for prefix, (below, wanted) in waiting.items():
            for j in wanted:
                at, target = below, total * j / shards
                for r in cells.get(prefix, []):
                    if at + r["b"] >= target:
                        low, high = target - at, at + r["b"] - target
                        if min(low, high) <= tolerance * total / shards or r["n"] == 1 or shift == 0:
                            found[j] = (r["p"] + (high < low)) << shift
                        else:
                            nearer.setdefault(r["p"], (at, []))[1].append(j)
                        break
                    at += r["b"]
                else:
                    found[j] = (prefix + 1) << (shift + step)
        waiting = nearer
    return [min(found[j], (1 << KEY_BITS) - 1) for j in sorted(found)]


def histogram_shards(df: DataFrame, shards: int, key_col: str, size_col: str, tolerance: float = 1e-3, order: tuple[str, ...] = ()) -> DataFrame:
    """df with shard (from 0) and slot (gapless from 0 in the order of the key, then of `order`)."""
    df = df.drop(*({"shard", "slot"} - {key_col, size_col}))  # a column called like an output is replaced
    rows = df.select(F.coalesce(F.col(key_col), F.lit(0)).alias("key"), F.coalesce(F.col(size_col), F.lit(0)).alias("size"))
    cuts = splitters(rows, shards, tolerance)
    key = F.coalesce(F.col(key_col), F.lit(0))
    n = rows.count()
    bits = min(30, max(8, (max(1, n // RANGE_ROWS)).bit_length() + 1))
    # ranges cut the span that the keys take, so narrow keys such as plain ids are as many tasks as hashes
    span = rows.agg(F.min("key"), F.max("key")).first()
    low, wide = span[0] or 0, max(0, (span[1] or 0) - (span[0] or 0)).bit_length()
    marked = df.withColumn("shard", reduce(add, [(key >= F.lit(c)).cast("int") for c in cuts], F.lit(0))).withColumn("_range", F.shiftright(key - F.lit(low), max(0, wide - bits)))
    counts = marked.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "_range", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = marked.withColumn("_rank", F.row_number().over(Window.partitionBy("shard", "_range").orderBy(key, *order)) - 1)
    small = (1 << bits) + shards <= BROADCAST_ROWS
    return ranked.join(F.broadcast(before) if small else before, ["shard", "_range"]).withColumn("slot", F.col("_before") + F.col("_rank")).drop("_range", "_before", "_rank")


def op4_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of near-equal bytes in a seeded random order of the documents: the key is a hash of id and text."""
    text = F.coalesce("text", F.lit(""))
    sized = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    keyed = written(sized.withColumn("key", F.xxhash64(F.lit(42), "doc_id", "text_crc32").bitwiseAND((1 << 63) - 1)))
    out = histogram_shards(keyed, 24, "key", "size", order=("doc_id",))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
