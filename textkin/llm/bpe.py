"""BPE encoding and decoding with a contiguous rank array.

The vocabulary file is a public tokenizer's JSON: NFC, white space to one space, lower case; a word is a run of letters,
one digit, or a run of other signs; its UTF-8 bytes are written as printable characters, the last one with a word end.

A short word is merged in place: an array of part boundaries and, beside it, the rank of merging each part with the next.
The least rank is found by a scan, its boundary deleted and the two neighbouring ranks refreshed, until no rank is
left. A word of over SHORT parts does the same merges, in the same order, from a heap of (rank, place), as scanning a
long array again and again would take quadratic time. Ties go to the leftmost pair.

Null texts are empty texts: no ids, empty decoded text. Texts are encoded whole; repeated rows get equal ids; a column called like
an output is replaced, others pass through. An empty table gives an empty table. Special tokens written in a text are those tokens. The vocabulary
is the one broadcast value: its size is the file's, whatever the corpus.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

SHORT, CACHED_WORDS, SLICE_ROWS = 128, 200_000, 256
#: The pattern that splits normalised text into words.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^\p{{White_Space}}\p{{L}}\p{{N}}]+"
NO_RANK = 1 << 62


def byte_signs() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next free one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class RankBPE:
    """Encoder and decoder of one vocabulary file's content."""

    def __init__(self, content: str):
        import regex

        spec = json.loads(content)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(merges)}
        signs = byte_signs()
        self.inner = [vocab.get(s, -1) for s in signs]
        self.last = [vocab.get(s + self.end, -1) for s in signs]
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.marks = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge_short(self, ids: list[int]) -> list[int]:
        rank, none = self.rank, (NO_RANK, -1)
        gain = [rank.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while gain:
            best = min(gain)
            if best[0] == NO_RANK:
                break
            i = gain.index(best)
            ids[i] = best[1]
            del ids[i + 1], gain[i]
            if i < len(gain):
                gain[i] = rank.get((ids[i], ids[i + 1]), none)
            if i:
                gain[i - 1] = rank.get((ids[i - 1], ids[i]), none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        rank, n = self.rank, len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(rank[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], alive[j], after[i] = rank[pair][1], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (p := (ids[a], ids[b])) in rank:
                    heapq.heappush(heap, (rank[p][0], a, p))
        return [x for x, live in zip(ids, alive, strict=True) if live]

    def word(self, w: str) -> tuple[int, ...]:
        data = w.encode("utf-8", "replace")
        ids = [i for i in (*(self.inner[b] for b in data[:-1]), self.last[data[-1]]) if i >= 0]
        return tuple(self.merge_short(ids) if len(ids) <= SHORT else self.merge_long(ids))

    def normal(self, text: str) -> str:
        # lower-casing goes character by character, so a capital sigma never turns into the final form
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        cache = self.cache
        for part in self.marks.split(text or "") if self.marks else [text or ""]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for w in self.words.findall(self.normal(part)):
                ids = cache.get(w)
                if ids is None:
                    if len(cache) >= CACHED_WORDS:
                        cache.clear()
                    ids = self.word(w)
                    if len(w) <= SHORT:
                        cache[w] = ids
                out += ids
        return out

    def decode(self, ids) -> str:
        """The tokens' own strings, joined by one space: this vocabulary names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None) -> DataFrame:
    """docs with the ids of each whole text, and with the text decoded from those ids if decoded_col is given.

    vocabulary is read by Spark, so it may lie in any store."""
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast("\n".join(r[0] for r in spark.read.text(vocabulary if ":" in vocabulary else f"file://{vocabulary}", wholetext=True).collect()))
    docs = docs.drop(ids_col, *([decoded_col] if decoded_col else []))
    fields = [*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded_col, T.StringType())] if decoded_col else [])

    def run(batches):
        bpe = RankBPE(content.value)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(at, SLICE_ROWS)
                ids = [bpe.encode(t) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
                columns = [*b.columns, pa.array(ids, pa.list_(pa.int32()))]
                names = [*b.schema.names, ids_col]
                if decoded_col:
                    columns.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                    names.append(decoded_col)
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, T.StructType(fields))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary or vocabulary_path(), decoded_col="decoded").drop("text")
    listed = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
