"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has 64 bits; two texts are linked if at most `radius` bits differ, and a component is what links
reach. Bits are grouped into `parts` so that correlated bits share a part. For each query fingerprint a dynamic
program gives part i a threshold t_i of -1 or more, with sum(t_i + 1) = radius + 1, at the least estimated number of
candidates: by the general pigeonhole principle, whatever lies within the radius then lies within t_i in some part i,
so probing all values within t_i of the query's value in each part finds every link. Candidates are verified on all bits.

The pipeline's near-duplicates take the same links, of five-word shingles, and check them on whole shingle sets. A similarity of
0.8 is about ten of 64 bits, beyond any radius that a pigeonhole search can afford, so what the radius leaves is found by an exact
prefix-filter join of the sets of what the links haven't joined yet (see alike_components).

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows have equal fingerprints.
A null id never becomes a component's name unless all its ids are null. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, connected_components, free_name, table, written

#: The histogram of a part has at most 2**HIST_BITS cells, whatever the corpus; wider parts are estimated from it.
HIST_BITS = 16
#: A verification costs 1; a probe, which is a shuffled row, as much as so many of them.
PROBE_COST = 4.0
#: An index cell with more fingerprints than this is dealt over several salts.
CELL_ROWS = 4096


def shingle_slices(data: bytes | None, words_per_shingle: int):
    """XXH64 (seed 42) of a UTF-8 text's shingles, repeats included, in their order: arrays of at most 65536."""
    from xxhash import xxh64_intdigest

    joined = b" ".join((data or b"").translate(ASCII_LOWER).split())
    if not joined:
        return
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    k = min(words_per_shingle, len(starts))
    n = len(starts) - k + 1
    for at in range(0, n, 65536):
        stop = min(n, at + 65536)
        yield np.array([xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts[at:stop], ends[at + k - 1 : stop + k - 1], strict=True)], "<u8")


def majority(slices) -> int:
    """The fingerprint of hashes: bit i is set if it is set in over half of them."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in slices:
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(data: bytes | None, words_per_shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text: bit i is set if it is set in over half the shingles' hashes."""
    return majority(shingle_slices(data, words_per_shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(id, text_hash, fp) for each row, fp the fingerprint's bits as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x, words_per_shingle) for x in b["data"]], np.uint64)
            yield pd.DataFrame({"id": b["id"], "text_hash": b["text_hash"], "fp": fp.view(np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).cast("binary").alias("data"))
    return rows.mapInPandas(run, "id string, text_hash long, fp long").select(F.col("id").cast(kind).alias("id"), "text_hash", "fp")


def bit_groups(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits 0..63 in `parts` groups of near-equal size, correlated bits together. together[i, j]: fingerprints with bits i and j."""
    share = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(share, share)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    strength = np.abs(cov / np.outer(sd, sd))
    free, groups = list(range(64)), []
    for g in range(parts):
        width = len(free) // (parts - g)
        block = strength[np.ix_(free, free)] - 2 * np.eye(len(free))
        own = [free[i] for i in sorted(set(divmod(int(block.argmax()), len(free))))][:width]
        while len(own) < width:
            rest = [b for b in free if b not in own]
            own.append(rest[int(strength[np.ix_(rest, own)].mean(1).argmax())])
        groups.append(sorted(own))
        free = [b for b in free if b not in own]
    return groups


def project(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.int64)
    for k, b in enumerate(bits):
        out |= (((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)).astype(np.int64)
    return out


def ball_counts(hist: np.ndarray, radius: int) -> np.ndarray:
    """counts[r, v]: fingerprints whose value lies within r bits of v, r from 0 to radius, of a histogram over 2**k values."""
    exact = [hist.astype(np.float64)] + [np.zeros(len(hist)) for _ in range(radius)]
    values = np.arange(len(hist))
    for b in range(len(hist).bit_length() - 1):
        for r in range(radius, 0, -1):
            exact[r] = exact[r] + exact[r - 1][values ^ (1 << b)]
    return np.cumsum(exact, 0)


def masks(width: int, radius: int) -> list[np.ndarray]:
    """masks[r]: all values of `width` bits with at most r ones."""
    layers, out = [np.zeros(1, np.int64)], []
    for r in range(radius + 1):
        if r:
            layers.append(np.unique(np.concatenate([layers[-1] ^ (1 << b) for b in range(width)])))
        out.append(np.unique(np.concatenate(layers)))
    return out


def allocate(costs: np.ndarray) -> np.ndarray:
    """units[q, i] with a sum of costs.shape[2]-1 for each query q, at least cost. costs[i, q, u]: part i with u units (threshold u-1)."""
    parts, n, most = costs.shape[0], costs.shape[1], costs.shape[2] - 1
    best, picks = np.full((n, most + 1), np.inf), []
    best[:, 0] = 0
    for i in range(parts):
        options = np.full((n, most + 1, most + 1), np.inf)  # [q, sum so far, units for part i]
        for u in range(most + 1):
            options[:, u:, u] = best[:, : most + 1 - u] + costs[i, :, u, None]
        picks.append(options.argmin(2))
        best = options.min(2)
    left, units = np.full(n, most), np.zeros((n, parts), np.int64)
    for i in reversed(range(parts)):
        units[:, i] = picks[i][np.arange(n), left]
        left = left - units[:, i]
    return units


def links(unique: DataFrame, radius: int = 3, parts: int | None = None) -> DataFrame:
    """(a, b) for each two fingerprints of unique.fp (distinct values) at most `radius` bits apart; a pair may repeat.

    The join's condition holds both the order of the two and the exact distance, so it puts out links alone."""
    spark = unique.sparkSession
    if parts is None:  # a part's values should about number the fingerprints
        parts = max(1, min(radius + 1, round(64 / max(8.0, np.log2(max(2, unique.count()))))))

    def pairs_of_bits(batches):
        total = np.zeros((64, 64))
        n = 0
        for b in batches:
            bits = np.unpackbits(b["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        yield pd.DataFrame({"cell": np.arange(4097), "n": np.append(total.ravel(), n).astype(np.int64)})

    rows = unique.select("fp").mapInPandas(pairs_of_bits, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # 4097 rows
    counts = np.zeros(4097)
    counts[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    groups = bit_groups(counts[:4096].reshape(64, 64), int(counts[4096]), parts)
    widths = [len(g) for g in groups]

    def cells(batches):
        hists = [np.zeros(1 << min(w, HIST_BITS), np.int64) for w in widths]
        for b in batches:
            fp = b["fp"].to_numpy(np.int64).view(np.uint64)
            for i, g in enumerate(groups):
                hists[i] += np.bincount(project(fp, g) & ((1 << HIST_BITS) - 1), minlength=len(hists[i]))
        for i, h in enumerate(hists):
            at = np.flatnonzero(h)
            yield pd.DataFrame({"part": np.full(len(at), i), "cell": at, "n": h[at]})

    got = unique.select("fp").mapInPandas(cells, "part int, cell int, n long").groupBy("part", "cell").agg(F.sum("n").alias("n")).toPandas()  # at most parts * 2**HIST_BITS rows
    hists = [np.zeros(1 << min(w, HIST_BITS), np.int64) for w in widths]
    for i in range(parts):
        own = got[got["part"] == i]
        hists[i][own["cell"].to_numpy()] = own["n"].to_numpy()
    shared = spark.sparkContext.broadcast([h.astype(np.int32) if h.max() < 2**31 else h for h in hists])

    def salts(i: int, value: np.ndarray) -> np.ndarray:
        thin = 1 << max(0, widths[i] - HIST_BITS)
        return 1 + shared.value[i][value & ((1 << HIST_BITS) - 1)].astype(np.int64) // (CELL_ROWS * thin)

    def index(batches):
        for b in batches:
            signed = b["fp"].to_numpy(np.int64)
            fp = signed.view(np.uint64)
            for i, g in enumerate(groups):
                v = project(fp, g)
                yield pd.DataFrame({"part": np.full(len(v), i, np.int32), "value": v, "salt": ((fp % np.uint64(1000003)).astype(np.int64) % salts(i, v)).astype(np.int32), "x": signed})

    def probes(batches):
        balls = [ball_counts(h, radius) / (1 << max(0, w - HIST_BITS)) for h, w in zip(shared.value, widths, strict=True)]
        near = [masks(w, radius) for w in widths]
        for whole in batches:
            for b in (whole.iloc[at : at + 4096] for at in range(0, len(whole), 4096)):
                signed = b["fp"].to_numpy(np.int64)
                fp = signed.view(np.uint64)
                values = [project(fp, g) for g in groups]
                costs = np.zeros((parts, len(fp), radius + 2))
                for i, v in enumerate(values):
                    cell = v & ((1 << HIST_BITS) - 1)
                    for u in range(1, radius + 2):
                        costs[i, :, u] = balls[i][u - 1][cell] + PROBE_COST * len(near[i][u - 1])
                units = allocate(costs)
                for i, v in enumerate(values):
                    for u in range(1, radius + 2):
                        own = np.flatnonzero(units[:, i] == u)
                        if not len(own):
                            continue
                        value = (v[own, None] ^ near[i][u - 1][None, :]).ravel()
                        query = np.repeat(signed[own], len(near[i][u - 1]))
                        s = salts(i, value)
                        salt = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s)
                        yield pd.DataFrame({"part": np.full(len(salt), i, np.int32), "value": np.repeat(value, s), "salt": salt.astype(np.int32), "q": np.repeat(query, s)})

    shape = "part int, value long, salt int"
    i = unique.select("fp").mapInPandas(index, f"{shape}, x long").alias("i")
    p = unique.select("fp").mapInPandas(probes, f"{shape}, q long").alias("p")
    same = (F.col("i.part") == F.col("p.part")) & (F.col("i.value") == F.col("p.value")) & (F.col("i.salt") == F.col("p.salt"))
    found = i.join(p, same & (F.col("x") < F.col("q")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("q"))) <= radius))
    return found.select(F.col("x").alias("a"), F.col("q").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, radius: int = 3) -> DataFrame:
    """(id_col, text_hash, fp, fingerprint, component_id), a row for each row of docs.

    Equal fingerprints are one node, however many rows have them. The last join is from rows to distinct fingerprints;
    a fingerprint that a third of the rows have is split by adaptive execution."""
    fps = written(fingerprints(docs, id_col, text_col, words_per_shingle))
    unique = written(fps.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(links(unique, radius)).withColumnRenamed("node", "fp")
    grouped = unique.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = grouped.where("root <> fp").select("root", "least").union(grouped.join(roots.select("root").distinct().withColumnRenamed("root", "fp"), "fp", "left_semi").select(F.col("fp").alias("root"), "least")).groupBy("root").agg(F.min("least").alias("name"))
    named = written(grouped.join(names, "root", "left").select("fp", F.coalesce("name", "least").alias("component_id")))
    return fps.join(named, "fp", "left").select(F.col("id").alias(id_col), "text_hash", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: One text in so many tells which shingles are frequent, and so many of them at most are put in order of frequency.
SAMPLED, LISTED = 8, 200_000
#: Rows whose shingle sets a Python worker holds at a time.
HELD_ROWS = 256
#: Bits of a set's parity: the join compares so many before it puts out a candidate.
PARITY_BITS = 512
#: Leaders that a cell's members are compared with in a round; rounds go on while one joins this share of the components at hand.
LEADERS, WORTH = 4, 0.01
#: Bits of a table that tells which rows may be wanted: 2**MARK_BITS whatever the number of rows, 8 MB. Past some ten
#: million marks it tells little, and more rows are exchanged; what comes out is the same.
MARK_BITS = 26
#: Of a cell's hash so many bits are counted to see which cells may stand twice.
CELL_BITS = 40


def sliced(batches):
    for b in batches:
        yield from (b.iloc[at : at + HELD_ROWS] for at in range(0, len(b), HELD_ROWS))


def shingle_hashes(data: bytes | None, words_per_shingle: int) -> np.ndarray:
    """The set of a text's shingles as ascending hashes, of the whole text."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_slices(data, words_per_shingle)]))


def frequent_shingles(texts: DataFrame, words_per_shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts), hashes ascending: the most frequent shingles of one distinct text in SAMPLED of texts(text_hash, data).

    They only set an order, on which the cost depends, not the links; so a sample and a fixed size do."""

    def run(batches):
        for b in sliced(batches):
            yield pd.DataFrame({"shingle": np.concatenate([np.zeros(0, "<u8"), *(shingle_hashes(x, words_per_shingle) for x in b["data"])]).view(np.int64)})

    sample = texts.where(F.pmod("text_hash", F.lit(SAMPLED)) == 0).dropDuplicates(["text_hash"]).select("data")
    counted = written(sample.mapInPandas(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"))
    sizes = sorted(((r.n, r.shingles) for r in counted.groupBy("n").agg(F.count("*").alias("shingles")).collect()), reverse=True)
    total = np.cumsum([s for _, s in sizes])
    least = min((n for (n, _), upto in zip(sizes, total, strict=True) if upto <= LISTED), default=None)
    got = counted.where(F.lit(False) if least is None else F.col("n") >= least).toPandas()
    hashes, counts = got["shingle"].to_numpy(np.int64).view("<u8"), got["n"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def prefix(hashes: np.ndarray, listed: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first n - ceil(similarity n) + 1 shingles of a set of n in the common order: by listed count (0 elsewhere), then by hash."""
    n = len(hashes)
    if n and len(listed):
        at = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
        rank = np.where(listed[at] == hashes, counts[at], 0)
        hashes = hashes[np.argsort(rank, kind="stable")]
    return hashes[: n - int(np.ceil(similarity * n - 1e-9)) + 1]


def parity_words(hashes: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits as longs, each the parity of the number of hashes that fall on it. Two sets differ in at least as
    many elements as their parities differ in bits, so a difference that is too great is known without the sets."""
    odd = (np.bincount((hashes & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view("<i8")


def bit_table(wanted: DataFrame) -> np.ndarray:
    """2**MARK_BITS bits as longs, those at wanted.place set; put together in pieces of 64 bits, so its size is all that the driver holds."""
    bit = F.expr("shiftleft(1L, CAST(place & 63 AS INT))")
    got = wanted.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    marks = np.zeros(1 << (MARK_BITS - 6), np.int64)
    marks[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return marks


def is_marked(marks: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (marks[place >> 6] >> (place & 63)) & 1 == 1


def maybe_in(rows: DataFrame, place, wanted: DataFrame) -> DataFrame:
    """The rows whose place (a column of longs under 2**MARK_BITS) stands in wanted(place), without an exchange: by a bit table of
    fixed size. As several values may share a place it lets some others through, never fewer."""
    shared = rows.sparkSession.sparkContext.broadcast(bit_table(wanted))

    @F.pandas_udf("boolean")
    def marked(place: pd.Series) -> pd.Series:
        return pd.Series(is_marked(shared.value, place.to_numpy(np.int64)))

    return rows.where(marked(place))


def top_bits(hashed, bits: int) -> F.Column:
    return F.shiftrightunsigned(hashed, 64 - bits)


def shared_cells(fps: DataFrame) -> DataFrame:
    """(node, n, at, cell) for each cell of a node's prefix that another node's prefix has too; fps: (node, shingles, cells), nodes may repeat.

    Nearly all cells stand in one prefix. So first CELL_BITS of each are counted, which is all of the index that is
    exchanged whole; the rows of what was counted twice are then told by a bit table, and settled by an exact join."""
    twice = written(fps.select(F.explode("cells").alias("cell")).groupBy(top_bits("cell", CELL_BITS).alias("c")).agg(F.count("*").alias("n")).where("n > 1").select("c"))

    def kept(batches):
        for b in sliced(batches):
            sizes = np.array([len(x) for x in b["cells"]], np.int64)
            cell = np.concatenate([np.zeros(0, np.int64), *b["cells"]]).astype(np.int64)
            at = np.arange(len(cell)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            stay = is_marked(shared.value, (cell.view("<u8") >> np.uint64(64 - MARK_BITS)).astype(np.int64))
            node, n = (np.repeat(b[c].to_numpy(), sizes)[stay] for c in ("node", "shingles"))
            yield pd.DataFrame({"node": node, "n": n, "at": at[stay].astype(np.int32), "cell": cell[stay]})

    shared = fps.sparkSession.sparkContext.broadcast(bit_table(twice.select(F.shiftright("c", CELL_BITS - MARK_BITS).alias("place"))))
    index = fps.select("node", "shingles", "cells").mapInPandas(kept, "node long, n int, at int, cell long")
    index = written(index.groupBy("cell", "node").agg(F.first("n").alias("n"), F.first("at").alias("at")))
    several = index.groupBy("cell").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("cell")
    return written(index.join(several, "cell", "left_semi"))


def parity_words(hashes: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits as longs, each the parity of the number of hashes that fall on it. Two sets differ in at least as
    many elements as their parities differ in bits, so a difference that is too great is known without the sets."""
    odd = (np.bincount((hashes & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view("<i8")


def maybe_wanted(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of texts with a text_hash of wanted, and few others, without an exchange: by a bit table of fixed size."""
    at = F.shiftrightunsigned("text_hash", 64 - MARK_BITS)
    got = wanted.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(text_hash, {64 - MARK_BITS}) & 63 AS INT))")).alias("bits")).toPandas()
    marks = np.zeros(1 << (MARK_BITS - 6), np.int64)
    marks[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    @F.pandas_udf("boolean")
    def marked(place: pd.Series) -> pd.Series:
        p = place.to_numpy(np.int64)
        return pd.Series((shared.value[p >> 6] >> (p & 63)) & 1 == 1)

    return texts.where(marked(at))


def alike_components(unique: DataFrame, cells: DataFrame, texts: DataFrame, similarity: float, words_per_shingle: int, radius: int = 3) -> DataFrame:
    """(node, root) by links between nodes of unique(node, text_hash, shingles, fp, parity) whose shingle sets are of that similarity or more.

    texts: (text_hash, data); cells: what the sets' prefixes share, as from shared_cells. Every candidate is compared on whole shingle sets. Candidates are, in turn:
    1. nodes whose fingerprints are linked (`links`: bit groups, allocated thresholds, probe, verify);
    2. in rounds, members of a cell and a few leaders of it, picked anew by a hash, where they aren't in one component yet;
    3. all members of a cell that aren't in one component by then.
    The last is an exact prefix-filter join: two such sets share a shingle within both prefixes, and at the first one that
    they share there is room for the overlap that they need behind it; their parities may differ in no more bits than such sets
    in elements. Pairs of one component aren't put out, so a large group of near copies costs a few comparisons a member,
    and components are those of all links. No pair is dropped: 1 and 2 only make 3 small."""

    def alike(batches):
        for b in batches:
            known: dict[int, np.ndarray] = {}
            keep = []
            for a, data_a, data_b in zip(b["a"], b["data_a"], b["data_b"], strict=True):
                if a not in known:
                    known = {a: shingle_hashes(data_a, words_per_shingle)}
                x, y = known[a], shingle_hashes(data_b, words_per_shingle)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield b.loc[keep, ["a", "b"]]

    def sized(x: str, y: str) -> F.Column:
        return (F.col(x) >= similarity * F.col(y) - 1e-9) & (F.col(y) >= similarity * F.col(x) - 1e-9)

    def confirmed(met: DataFrame) -> DataFrame:
        """The links among met(a, b)."""
        left, right = (unique.select(F.col("node").alias(k), F.col("shingles").alias(f"n{k}"), F.col("text_hash").alias(f"text_{k}")) for k in "ab")
        pairs = written(met.join(left, "a").join(right, "b").where(sized("na", "nb")).select("a", "b", "text_a", "text_b"))
        wanted = written(pairs.select(F.explode(F.array("text_a", "text_b")).alias("text_hash")).distinct())
        held = written(maybe_in(texts, top_bits("text_hash", MARK_BITS), wanted.select(top_bits("text_hash", MARK_BITS).alias("place"))).join(wanted, "text_hash", "left_semi").groupBy("text_hash").agg(F.first("data").alias("data")))
        a, b = (held.select(F.col("text_hash").alias(f"text_{k}"), F.col("data").alias(f"data_{k}")) for k in "ab")
        return written(pairs.join(a, "text_a").join(b, "text_b").select("a", "b", "data_a", "data_b").mapInPandas(alike, "a long, b long"))

    def may_link(x: str, y: str, parity: bool = True) -> F.Column:
        need = F.ceil(similarity / (1 + similarity) * (F.col(f"{x}.n") + F.col(f"{y}.n")) - 1e-6)
        room = F.least(F.col(f"{x}.n") - F.col(f"{x}.at"), F.col(f"{y}.n") - F.col(f"{y}.at"))  # positions count from 0
        if not parity:
            return sized(f"{x}.n", f"{y}.n") & (room >= need)
        differ = reduce(add, [F.bit_count(F.get(f"{x}.parity", F.lit(i)).bitwiseXOR(F.get(f"{y}.parity", F.lit(i)))) for i in range(PARITY_BITS // 64)])
        return sized(f"{x}.n", f"{y}.n") & (room >= need) & (differ <= F.col(f"{x}.n") + F.col(f"{y}.n") - 2 * need)

    of_fp = unique.groupBy("fp").agg(F.min("node").alias("first"))
    near = links(of_fp.select("fp"), radius)
    ends = [of_fp.select(F.col("fp").alias(k), F.col("first").alias(f"n{k}")) for k in "ab"]
    near = near.join(ends[0], "a").join(ends[1], "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
    same = unique.join(of_fp, "fp").where("node > first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    found = confirmed(near.union(same).distinct())
    roots = written(connected_components(found))

    # members of a cell meet a few leaders: linear, so in the first round parities, which are most of a row, aren't carried
    parities, turn = unique.select("node", "parity"), 0

    def placed(cells: DataFrame, roots: DataFrame) -> DataFrame:
        """cells that hold more than one component, with each node's; what lies in one component stays there."""
        known = cells.join(roots, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root")
        mixed = known.groupBy("cell").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("cell")
        return known.join(mixed, "cell", "left_semi")

    while True:
        known = placed(cells, roots)
        known = written(known.join(parities, "node") if turn else known)
        cells = known.drop("component", "parity")
        picks = [F.min_by(F.struct(*(c for c in known.columns if c != "cell")), F.xxhash64(F.lit(turn + i), "node")) for i in range(LEADERS)]
        leaders = known.groupBy("cell").agg(F.array_distinct(F.array(*picks)).alias("l")).select("cell", F.explode("l").alias("l")).select("cell", "l.*")
        x, q = known.alias("x"), leaders.alias("q")
        met = x.join(q, (F.col("x.cell") == F.col("q.cell")) & (F.col("x.component") != F.col("q.component")) & may_link("x", "q", turn > 0))
        new = confirmed(met.select(F.least("x.node", "q.node").alias("a"), F.greatest("x.node", "q.node").alias("b")).distinct())
        found = new.count()
        at_hand = known.agg(F.countDistinct("component")).first()[0] if found else 0
        if found:
            roots = written(connected_components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(new)))
        turn += LEADERS
        if found <= WORTH * at_hand:
            break
    known = written(placed(cells, roots).join(parities, "node"))
    x, q = known.alias("x"), known.alias("q")
    met = x.join(q, (F.col("x.cell") == F.col("q.cell")) & (F.col("x.node") < F.col("q.node")) & (F.col("x.component") != F.col("q.component")) & may_link("x", "q"))
    last = confirmed(met.select(F.col("x.node").alias("a"), F.col("q.node").alias("b")).distinct())
    if last.isEmpty():
        return roots
    return connected_components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(last))


def wide_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id_col, text_hash, component_id): as near_duplicates, but linked at a similarity of shingle sets; exact.

    Texts of equal shingle sets are one node, named by the 64-bit hash of the set."""
    kind = docs.schema[id_col].dataType.simpleString()
    text_hash, data = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).cast("binary").alias("data")
    texts = docs.select(text_hash, data)
    order = docs.sparkSession.sparkContext.broadcast(frequent_shingles(texts, words_per_shingle))

    def run(batches):
        from xxhash import xxh64_intdigest

        for b in sliced(batches):
            rows = []
            for x in b["data"]:
                hashes = list(shingle_slices(x, words_per_shingle))
                whole = np.unique(np.concatenate([np.zeros(0, "<u8"), *hashes]))
                fp = np.array([majority(hashes)], np.uint64).view(np.int64)[0]
                rows.append((np.array([xxh64_intdigest(whole.tobytes(), 42)], np.uint64).view(np.int64)[0], len(whole), fp, parity_words(whole), prefix(whole, *order.value, similarity).view(np.int64)))
            node, shingles, fp, parity, cells = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [], [])
            yield pd.DataFrame({"id": b["id"], "text_hash": b["text_hash"], "node": node, "shingles": np.array(shingles, np.int32), "fp": fp, "parity": parity, "cells": cells}, index=b.index)

    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_hash, data)
    shape = "id string, text_hash long, node long, shingles int, fp long, parity array<long>, cells array<long>"
    fps = written(rows.mapInPandas(run, shape).withColumn("id", F.col("id").cast(kind)))
    firsts = [F.first(c).alias(c) for c in ("shingles", "parity")]
    unique = written(fps.drop("cells").groupBy("node").agg(F.min("id").alias("least"), F.min("text_hash").alias("text_hash"), F.min("fp").alias("fp"), *firsts))
    roots = alike_components(unique.drop("least"), shared_cells(fps), texts, similarity, words_per_shingle).withColumnRenamed("node", "n").withColumnRenamed("root", "r")
    grouped = unique.select("node", "least").join(roots, F.col("node") == F.col("n"), "left").select("node", "least", F.coalesce("r", "node").alias("root"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(grouped.join(named, "root").select("node", "component_id"))
    return fps.select("id", "text_hash", "node").join(named, "node").select(F.col("id").alias(id_col), "text_hash", "component_id")


def kept_of(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs less all but the row of the least id of each component; of rows equal in id and text one stays."""
    own = free_name(docs, "_hash")
    stay = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_stays"), F.col("text_hash").alias("_stays_hash"))
    marked = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).alias("m")
    kept = marked.join(stay.alias("s"), F.col(f"m.{id_col}").eqNullSafe(F.col("s._stays")) & (F.col(f"m.{own}") == F.col("s._stays_hash")), "left_semi")
    # texts are exchanged once more only if some row stands several times
    repeated = stay.groupBy("_stays", "_stays_hash").agg(F.count("*").alias("n")).where("n > 1")
    return (kept if repeated.isEmpty() else kept.dropDuplicates([id_col, own])).select(docs.columns)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    return kept_of(docs, wide_near_duplicates(docs.select(id_col, text_col), id_col, text_col, words_per_shingle, similarity), id_col, text_col)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
