"""Token counts of documents in flat, unindexed token files, by a separator scan.

A flat file is a run of token ids of fixed width, each document ended by the separator's id. It is read in blocks that
begin anywhere. A block's ids are searched for the separator in one vectorised comparison, which gives the documents that
end in it; a document that began in an earlier block lacks the tokens of those blocks after their last separator. That
carry is a segmented prefix scan over the blocks' (has a separator, tokens after the last) pairs, done in two levels: within
runs of RUN blocks, and over the runs, so a file of any size is many tasks. Tokens after a file's last separator are one
more document, unless there are none.

Empty blocks, empty files and empty tables give no rows; a null block counts as an empty one; documents may be empty (0 tokens). Blocks of a file
must hold whole ids. Repeated blocks aren't allowed: (file, block) is a key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

RUN, BLOCK_TOKENS = 4096, 65536
#: Fixed value: the id after the last of the public byte-level vocabulary, free for an end of document.
SEPARATOR = 50256


def read_blocks(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, data) of the flat files under a path that Spark can read, each under 2 GB."""
    step = width * block_tokens

    def cut(batches):
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                for k, at in enumerate(range(0, len(data), step)):
                    yield pd.DataFrame({"file": [name], "block": [k], "data": [data[at : at + step]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cut, "file string, block long, data binary")


def count_tokens(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """(file, block, place, n_tokens): a row for each document, where it ends: the block, and its place among the block's separators from 0.

    The document after a file's last separator has the place -1 in the file's last block."""
    kind = {2: "<u2", 4: "<u4"}[width]

    def scan(batches):
        for b in batches:
            heads, gaps, tails, files, numbers = [], [], [], [], []
            for file, block, data in zip(b["file"], b["block"], b["data"], strict=True):
                ids = np.frombuffer(data or b"", kind)
                ends = np.flatnonzero(ids == separator)
                lengths = np.diff(ends, prepend=-1) - 1
                files.append(file)
                numbers.append(block)
                heads.append(int(lengths[0]) if len(ends) else -1)
                gaps.append(lengths[1:].astype(np.int64))
                tails.append(int(len(ids) - 1 - ends[-1]) if len(ends) else len(ids))
            yield pd.DataFrame({"file": files, "block": numbers, "head": heads, "inner": gaps, "tail": tails})

    seen = written(blocks.select("file", "block", "data").mapInPandas(scan, "file string, block long, head long, inner array<long>, tail long"))
    seen = seen.withColumn("run", F.floor(F.col("block") / RUN))
    in_run = Window.partitionBy("file", "run").orderBy("block")
    # a segment is the blocks from one with a separator up to the next such; its open tokens add up
    marked = seen.withColumn("segment", F.count(F.when(F.col("head") >= 0, 1)).over(in_run.rowsBetween(Window.unboundedPreceding, -1)))
    in_segment = Window.partitionBy("file", "run", "segment").orderBy("block")
    shifted = marked.withColumn("_open", F.when(F.col("head") >= 0, F.lit(0)).otherwise(F.col("tail")))
    # what is open before a block, from inside its run: the tail that opened the segment, and the blocks without a separator since
    opened = marked.where("head >= 0").select("file", "run", (F.col("segment") + 1).alias("segment"), F.col("tail").alias("_start"))
    inside = shifted.join(opened, ["file", "run", "segment"], "left").withColumn("_carry", F.coalesce("_start", F.lit(0)) + F.coalesce(F.sum("_open").over(in_segment.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = inside.groupBy("file", "run").agg(F.max(F.when(F.col("head") >= 0, 1).otherwise(0)).alias("closed"), F.max_by(F.when(F.col("head") >= 0, F.col("tail")).otherwise(F.col("_carry") + F.col("tail")), "block").alias("after"))
    in_file = Window.partitionBy("file").orderBy("run")
    runs = runs.withColumn("part", F.sum("closed").over(in_file)).withColumn("into", F.coalesce(F.sum("after").over(Window.partitionBy("file", "part").orderBy("run")), F.lit(0))).withColumn("into", F.coalesce(F.lag("into").over(in_file), F.lit(0)))
    last = seen.groupBy("file").agg(F.max("block").alias("last"))
    full = inside.join(runs.select("file", "run", "into"), ["file", "run"]).join(last, "file")
    before = F.col("_carry") + F.when(F.col("segment") == 0, F.col("into")).otherwise(0)
    ended = F.when(F.col("head") >= 0, F.concat(F.array(F.col("head") + before), F.col("inner"))).otherwise(F.array().cast("array<bigint>"))
    rest = F.when(F.col("head") >= 0, F.col("tail")).otherwise(before + F.col("tail"))
    docs = full.select("file", "block", F.posexplode(ended).alias("place", "n_tokens"))
    return docs.union(full.where(F.col("block") == F.col("last")).select("file", "block", F.lit(-1).alias("place"), rest.alias("n_tokens")).where("n_tokens > 0"))


def flat_blocks(docs: DataFrame, ranks: str, pattern: str, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(file, block, data, ids): the texts of each task as one flat file of 16-bit ids, with the ids of the documents that end in each block."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast("\n".join(r[0] for r in spark.read.text(ranks if ":" in ranks else f"file://{ranks}", wholetext=True).collect()))

    def run(batches):
        import base64

        import tiktoken
        from pyspark import TaskContext

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value.splitlines() if line)}
        encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        file, block, held, ids = f"part-{TaskContext.get().partitionId():05d}", 0, np.empty(0, np.uint16), []
        ends: list[tuple[int, str]] = []
        at = 0
        for b in batches:
            for key, text in zip(b["id"], b["text"], strict=True):
                ids.append(np.array([*encoder.encode_ordinary(text or ""), separator], np.uint16))
                at += len(ids[-1])
                ends.append((at - 1, key))
                if at - block * BLOCK_TOKENS >= BLOCK_TOKENS:
                    held = np.concatenate([held, *ids])
                    ids = []
                    while len(held) >= BLOCK_TOKENS:
                        limit = (block + 1) * BLOCK_TOKENS
                        yield pd.DataFrame({"file": [file], "block": [block], "data": [held[:BLOCK_TOKENS].tobytes()], "ids": [[k for p, k in ends if p < limit]]})
                        held, ends, block = held[BLOCK_TOKENS:], [e for e in ends if e[0] >= limit], block + 1
        held = np.concatenate([held, *ids]) if ids else held
        if len(held):
            yield pd.DataFrame({"file": [file], "block": [block], "data": [held.tobytes()], "ids": [[k for _, k in ends]]})

    return docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInPandas(run, "file string, block long, data binary, ids array<string>")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens) of all documents: their texts are written as flat files of the public byte-level vocabulary's ids, then scanned."""
    import public_tokenizers

    flat = written(flat_blocks(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    counted = count_tokens(flat.select("file", "block", "data"), SEPARATOR)
    names = flat.select("file", "block", F.posexplode("ids").alias("place", "doc_id"))
    return names.join(counted, ["file", "block", "place"]).select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens")
