"""Document fingerprints by consistent weighted sampling.

A text's terms are its words (A-Z lower-cased), weighted by how often they occur. For each of SAMPLES draws and each
term, three variates follow from a hash of the term and the draw alone: r and c from Gamma(2, 1), b uniform. With
t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1), the draw takes the term of least a, and keeps (term, t). Two texts
agree in a draw with a probability equal to their generalised Jaccard similarity, sum(min w) / sum(max w), so the share
of equal draws estimates it. A draw is written as 16 bits, so unlike draws agree by chance once in 65,536.

Null texts are empty texts; a text without words has the empty fingerprint, alike to the empty one only. Equal texts
have equal fingerprints. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, table, written

SAMPLES = 64
#: Terms whose variates a worker remembers, 1 kB each; they are a function of the term, so forgetting changes nothing.
CACHED_TERMS = 40_000
#: Of text in a range of ids, and the most ranges. A range streams through its task, so a large one takes no more memory.
RANGE_BYTES, RANGES = 32 << 20, 16384


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits depend on all input bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    def __init__(self, samples: int = SAMPLES, seed: int = 42):
        self.samples = samples
        steps = np.arange(1, 3 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.steps = _mix(steps + np.uint64(seed)).reshape(3, samples)
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.r, self.b, self.lnc, self.once = (np.empty((CACHED_TERMS, self.samples), np.float32) for _ in range(4))
        self.hash = np.empty(CACHED_TERMS, np.uint64)

    def learn(self, terms: list[bytes]) -> None:
        from xxhash import xxh64_intdigest

        h = np.array([xxh64_intdigest(t, 7) for t in terms], np.uint64)
        at = len(self.place)
        for first in range(0, len(terms), 512):
            own = h[first : first + 512]
            bits = _mix(own[:, None, None] ^ self.steps[None])
            high = ((bits >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-32)
            low = ((bits & np.uint64(0xFFFFFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-32)
            logs = -(np.log(high[:, :2]) + np.log(low[:, :2]))
            to = slice(at + first, at + first + len(own))
            self.r[to], self.lnc[to], self.b[to], self.hash[to] = logs[:, 0], np.log(logs[:, 1]), np.minimum(high[:, 2], np.float32(1 - 2**-24)), own
            self.once[to] = self.lnc[to] - self.r[to] * (1 - self.b[to])
        for k, t in enumerate(terms):
            self.place[t] = at + k

    def part(self, counted: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
        """(least ln a, draw) of some terms."""
        new = [t for t, _ in counted if t not in self.place]
        if len(self.place) + len(new) > CACHED_TERMS:
            self.forget()
            new = [t for t, _ in counted]
        if new:
            self.learn(new)
        at = np.fromiter((self.place[t] for t, _ in counted), np.int64, len(counted))
        w = np.fromiter((n for _, n in counted), np.int64, len(counted))
        lna = self.once[at]
        more = np.flatnonzero(w > 1)
        if len(more):
            r, b = self.r[at[more]], self.b[at[more]]
            t = np.floor(np.log(w[more]).astype(np.float32)[:, None] / r + b)
            lna[more] = self.lnc[at[more]] - r * (t - b + 1)
        pick = lna.argmin(0)
        draws = np.arange(self.samples)
        chosen = at[pick]
        level = np.floor(np.log(w[pick]).astype(np.float32) / self.r[chosen, draws] + self.b[chosen, draws])
        return lna[pick, draws], _mix(self.hash[chosen] ^ level.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint16)

    def signature(self, text: str) -> np.ndarray:
        """SAMPLES draws, or none for a text without words. Terms are taken a slice at a time, so memory is bounded."""
        counted = list(Counter(text.encode("utf-8", "replace").translate(ASCII_LOWER).split()).items())
        least, draws = None, np.empty(0, np.uint16)
        for first in range(0, len(counted), CACHED_TERMS // 4):
            a, d = self.part(counted[first : first + CACHED_TERMS // 4])
            if least is None:
                least, draws = a, d
            else:
                nearer = a < least
                least, draws = np.where(nearer, a, least), np.where(nearer, d, draws)
        return draws


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean()) if len(a) and len(b) else float(len(a) == len(b))


def written_out(draws: np.ndarray) -> str:
    return draws.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each whole text, 4 hex digits a draw."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        sampler = Sampler()
        return texts.fillna("").map(lambda t: written_out(sampler.signature(t)))

    return docs.withColumn(out_col, run(F.col(text_col)))


def edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprint of each text, of the text edited with the next one (descending id, null ids last, then the text's hash;
    the first follows the last), and how alike these are.

    One exchange deals the texts by ranges of ids; a range streams in order, each text beside its next one. The last text
    of a range waits for the first of the next: these two a range, nothing else, are matched afterwards."""
    rows = docs.select(F.col(id_col).alias("order"), F.col(id_col).cast("string").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = F.col("order").desc_nulls_last()
    dealt = rows.repartitionByRange(max(1, min(RANGES, -(-size // RANGE_BYTES))), order).sortWithinPartitions(order, F.xxhash64("text")).select("id", "text")
    kind = docs.schema[id_col].dataType.simpleString()
    shape = "id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string, place int"

    def row(sampler, key, text, own, following, next_own):
        changed = edited(text, following)
        sig = sampler.signature(changed)
        return (key, len(text), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), written_out(own), written_out(sig), likeness(own, sig), likeness(own, next_own), None, None)

    columns = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text", "place"]
    frame = lambda out: pd.DataFrame(out, columns=columns).astype({"n_chars": "Int64", "place": "Int32"})

    def run(batches):
        from pyspark import TaskContext

        sampler, last, place = Sampler(), None, TaskContext.get().partitionId()
        for b in batches:
            out = []
            for key, text in zip(b["id"], b["text"], strict=True):
                own = sampler.signature(text)
                if last is None:
                    out.append((key, None, None, None, None, None, None, text, 2 * place))
                else:
                    out.append(row(sampler, *last, text, own))
                last = (key, text, own)
                if len(out) >= 512:
                    yield frame(out)
                    out = []
            yield frame(out)
        if last is not None:
            yield frame([(last[0], None, None, None, None, None, None, last[1], 2 * place + 1)])

    found = written(dealt.mapInPandas(run, shape))
    ends = found.where("place IS NOT NULL").select("place", "id", "text")
    places = [r[0] for r in ends.select("place").orderBy("place").collect()]  # two a range, so at most 2 * RANGES
    heads = {p: places[(i + 1) % len(places)] for i, p in enumerate(places) if p % 2}
    waiting = ends.where("place % 2 = 1")
    if heads:
        pairs = docs.sparkSession.createDataFrame([(a, b) for a, b in heads.items()], "place int, head int")
        firsts = ends.where("place % 2 = 0").select(F.col("place").alias("head"), F.col("text").alias("following"))
        joined = waiting.join(pairs, "place").join(firsts, "head")
    else:
        joined = waiting.withColumn("following", F.lit(""))

    def finish(batches):
        sampler = Sampler()
        for b in batches:
            yield frame([row(sampler, key, text, sampler.signature(text), following, sampler.signature(following)) for key, text, following in zip(b["id"], b["text"], b["following"], strict=True)])

    done = found.where("place IS NULL").union(joined.select("id", "text", "following").mapInPandas(finish, shape))
    return done.drop("text", "place").withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def op5_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
