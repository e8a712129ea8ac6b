"""The nearest texts by TF-IDF cosine: exact, without a table of the pairs that share a word."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .graph import SINGLE
from .pairs import lists, spread

#: Terms that are multiplied as a matrix, the most frequent; texts that a task compares at a time; queries of the piece that they are compared with.
HEAD, BLOCK, PIECE = 512, 128, 4096
#: Texts whose terms are counted together, and scores that are settled together.
COUNTED, SETTLED = 512, 1 << 13


def term_counts(texts: DataFrame, words: Column) -> DataFrame:
    """(id, h, tf), written: the 64-bit hashes of a text's distinct words, ascending, and how often it has them; texts without a word are left out.
    texts(id, ...) of one id, null too, are one text."""
    hashed = texts.select("id", F.transform(words, lambda t: F.xxhash64(t)).alias("h")).where(F.size("h") > 0)
    twice = written(texts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("twice")))
    if not twice.isEmpty():
        same = F.col("id").eqNullSafe(F.col("twice"))
        merged = hashed.join(twice, same).groupBy("id").agg(F.flatten(F.collect_list("h")).alias("h"))
        hashed = hashed.join(twice, same, "left_anti").union(merged)

    def count(batches):
        for b in (whole.slice(at, COUNTED) for whole in batches for at in range(0, whole.num_rows, COUNTED)):
            flat, sizes = lists(b.column(1))
            own = np.repeat(np.arange(len(sizes)), sizes)
            by = np.lexsort((flat, own))
            flat = flat[by]
            new = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (own[1:] != own[:-1])])
            ends = pa.array(np.searchsorted(own[new], np.arange(len(sizes) + 1)).astype(np.int32))
            h, tf = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (flat[new].view(np.int64), np.diff(np.r_[new, len(flat)]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), h, tf], names=["id", "h", "tf"])

    return written(hashed.mapInArrow(count, f"id {texts.schema['id'].dataType.simpleString()}, h array<long>, tf array<int>"), "zstd")


def nearest_texts(texts: DataFrame, words: Column, asked: Column, k: int) -> DataFrame:
    """(qid, id, score, rank): the k nearest of texts(id, ...) to each of those asked for, itself included, by the cosine of tf * (ln((1 + n) / (1 + df)) + 1)
    of their words, rounded to six places, ties by id; exact. Texts that share no word aren't near.

    Terms of two texts or more are broadcast with their df. Queries are broadcast PIECE or so at a time; a task multiplies its texts' HEAD most frequent terms with
    theirs as a matrix, adds the others by postings, and keeps the best k of a query."""
    spark, rows = texts.sparkSession, texts.count()
    counted = term_counts(texts, words)
    known = counted.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("df")).where("df > 1").toArrow()
    terms, df = (known.column(c).to_numpy() for c in ("h", "df"))
    by = np.argsort(terms.view(np.uint64))
    terms, df = terms.view(np.uint64)[by], df[by].astype(np.int32)
    head = np.sort(terms[np.lexsort((terms, -df))[:HEAD]])
    vocabulary = spark.sparkContext.broadcast((terms, df, head))

    def weights(b, terms, df):
        """(hashes, rows, weights) of a batch's texts."""
        h, sizes = lists(b.column("h"))
        tf = pa.concat_arrays([c.flatten() for c in b.column("tf").chunks]) if isinstance(b.column("tf"), pa.ChunkedArray) else b.column("tf").flatten()
        own, n = np.repeat(np.arange(len(sizes)), sizes), np.ones(len(h))
        if len(terms):
            at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
            n = np.where(terms[at] == h, df[at], 1)
        x = tf.to_numpy() * (np.log((1.0 + rows) / (1.0 + n)) + 1.0)
        return h, own, x / np.sqrt(np.bincount(own, x * x, len(sizes)))[own]

    def parted(h, own, w, head, n_rows):
        """The matrix of the frequent terms' weights, and which entries aren't in it."""
        dense, rest = np.zeros((n_rows, len(head))), np.ones(len(h), bool)
        if len(head):
            at = np.minimum(np.searchsorted(head, h), len(head) - 1)
            rest = head[at] != h
            dense[own[~rest], at[~rest]] = w[~rest]
        return dense, rest

    base = counted.where("id IS NOT NULL")
    asked = base.where(asked)
    base, found, n = base.coalesce(max(2, 2 * spark.sparkContext.defaultParallelism)), None, max(1, -(-asked.count() // PIECE))
    for piece in range(n):
        got = asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == piece).toArrow()
        if not got.num_rows:
            continue
        h, own, w = weights(got, terms, df)
        dense, rest = parted(h, own, w, head, got.num_rows)
        put = np.lexsort((own[rest], h[rest]))
        kinds, first, many = np.unique(h[rest][put], return_index=True, return_counts=True)
        shared = spark.sparkContext.broadcast((got.column("id").to_numpy(), dense, kinds, first, many, own[rest][put].astype(np.int32), w[rest][put]))

        def run(batches, shared=shared):
            terms, df, head = vocabulary.value
            qids, asked, kinds, first, many, of, value = shared.value
            asked32, q = asked.astype(np.float32).T.copy(), len(qids)
            floor = np.full(q, -1.0)
            best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

            def settled(rows):
                at, ids, score = (np.concatenate(c) for c in zip(*rows, strict=True))
                by = np.lexsort((ids, -np.round(score, 6), at))
                at, ids, score = at[by], ids[by], score[by]
                place = np.arange(len(at)) - np.searchsorted(at, np.arange(q))[at]
                full = place == k - 1
                floor[at[full]] = np.round(score[full], 6) - SINGLE - 2e-6
                return [c[place < k] for c in (at, ids, score)]

            blocks = (whole.slice(at, BLOCK) for whole in batches for at in range(0, whole.num_rows, BLOCK))
            for number, b in enumerate(blocks):
                h, own, w = weights(b, terms, df)
                dense, rest = parted(h, own, w, head, b.num_rows)
                sparse = np.zeros(b.num_rows * q)
                if len(kinds):
                    at = np.minimum(np.searchsorted(kinds, h), len(kinds) - 1)
                    hit = np.flatnonzero(rest & (kinds[at] == h))
                    at = at[hit]
                    place = spread(first[at], many[at])
                    sparse = np.bincount(np.repeat(own[hit] * q, many[at]) + of[place], np.repeat(w[hit], many[at]) * value[place], len(sparse))
                sparse = sparse.reshape(b.num_rows, q)
                score = sparse + dense.astype(np.float32) @ asked32
                least = floor
                if not number and b.num_rows > k:
                    least = np.maximum(floor, np.partition(score, -k, axis=0)[-k] - 2 * SINGLE)
                i, j = np.nonzero((score >= least) & (score > 0))
                ids, new = b.column("id").to_numpy(zero_copy_only=False), [best]
                for part in (slice(at, at + SETTLED) for at in range(0, len(i), SETTLED)):
                    x, y = i[part], j[part]
                    new.append([y, ids[x], sparse[x, y] + np.einsum("ij,ij->i", dense[x], asked[y])])
                if len(new) > 1:
                    best = settled(new)
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"qid": qids[best[0]], "id": best[1], "score": best[2]}), preserve_index=False)

        top = written(base.select("id", "h", "tf").mapInArrow(run, "qid long, id long, score double"))
        found = top if found is None else found.union(top)
    if found is None:
        found = spark.createDataFrame([], "qid long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("score", F.round("score", 6)).withColumn("rank", rank).where(F.col("rank") <= k)
