"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of its letters' 1- to 3-grams (lower-cased, runs of other characters as one gap), hashed
to CELLS cells: (1 + ln tf) idf, scaled to unit length. Each language has up to `centroids` unit centroids from spherical
k-means. A text goes to the language of the centroid of greatest cosine. The score is the softmax share, over languages,
of their best cosines. A text farther from its centroid than nearly all texts that the centroid was made from is marked
in `rejected`; it keeps its language. Document frequencies cover all training texts; the clustering is fitted on at most
about FIT_TEXTS texts a language, those whose id and text hash lowest; equal rows enter it once.

Null texts and texts without a letter are `und` with score 0. If nothing can be learned, all texts are `und`.
Rows with a null language are never learned from. Texts are read whole; equal ones get equal answers; of languages at equal
cosine the first in order is taken. Other columns don't matter. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, table

CELLS, FIT_TEXTS, CENTROIDS, ROUNDS, SHARPNESS, FAR_QUANTILE = 8192, 800, 3, 12, 25.0, 0.999
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def term_counts(text: str | None) -> np.ndarray | None:
    """How often each cell's n-grams occur; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letter = letters()[points]
    if not letter.any():
        return None
    x = np.where(letter, points, 32)
    x = np.concatenate([[32], x[letter | np.concatenate([[True], letter[:-1]])], [32]]).astype(np.uint32)
    spread = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - (CELLS.bit_length() - 1))).astype(np.int64)
    two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + x[2:] * np.uint32(0x27D4EB2F)
    return sum(np.bincount(spread(h), minlength=CELLS) for h in (x, two, three))


def vectors(counts: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    m = np.array(counts, np.float32)
    seen = m > 0
    m[seen] = 1 + np.log(m[seen])
    m *= idf
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def cluster(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; unit centroids."""
    k = min(k, len(x))
    c = [x[rng.integers(len(x))]]
    while len(c) < k:
        far = np.maximum(1 - (x @ np.array(c).T).max(1), 0) + 1e-9
        c.append(x[rng.choice(len(x), p=far / far.sum())])
    c = np.array(c)
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        c = np.array([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, of: np.ndarray, reach: np.ndarray):
        self.idf, self.langs, self.centroids, self.of, self.reach = idf, langs, centroids, of, reach

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for first in range(0, len(texts), 512):
            own = [(i, c) for i, t in enumerate(texts[first : first + 512], first) if (c := term_counts(t)) is not None]
            if not own or not self.langs:
                continue
            cos = vectors([c for _, c in own], self.idf) @ self.centroids.T
            best = np.stack([cos[:, self.of == j].max(1) for j in range(len(self.langs))], 1)
            share = np.exp(SHARPNESS * (best - best.max(1, keepdims=True)))
            share /= share.sum(1, keepdims=True)
            for (i, _), b, s, c in zip(own, best.argmax(1), share, cos, strict=True):
                lang[i], score[i] = self.langs[b], s[b]
                nearest = np.where(self.of == b, c, -2).argmax()
                rejected[i] = c[nearest] < self.reach[nearest]
        return lang, score, rejected


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_texts: int = FIT_TEXTS, centroids: int = CENTROIDS) -> Model:
    """train: labelled rows. One pass counts document frequencies over all of them, one gathers the bounded sample."""
    train = train.where(F.col(lang_col).isNotNull())

    def frequencies(batches):
        df, n = np.zeros(CELLS, np.int64), 0
        for b in batches:
            for t in b["text"]:
                if (c := term_counts(t)) is not None:
                    df += c > 0
                    n += 1
        yield pd.DataFrame({"cell": np.arange(CELLS + 1), "n": np.append(df, n)})

    got = train.select(F.col(text_col).alias("text")).mapInPandas(frequencies, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # CELLS + 1 rows
    df = np.zeros(CELLS + 1)
    df[got["cell"].to_numpy(int)] = got["n"].to_numpy()
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)
    sizes = {r[0]: r[1] for r in train.groupBy(lang_col).count().collect()}  # a row a language
    drawn = F.xxhash64(F.lit(11), F.col(id_col), F.col(text_col))
    low = F.pmod(drawn, F.lit(1 << 32)) / float(1 << 32)
    limit = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, fit_texts / n)))]) if sizes else F.create_map()
    picked = train.where(low < F.element_at(limit, F.col(lang_col))) if sizes else train.limit(0)
    sample = picked.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), drawn.alias("drawn")).dropDuplicates(["lang", "drawn"])

    def sparse(batches):
        for b in batches:
            for lang, t in zip(b["lang"], b["text"], strict=True):
                if (c := term_counts(t)) is not None:
                    at = np.flatnonzero(c)
                    yield pd.DataFrame({"lang": [lang], "at": [at.astype(np.int32).tobytes()], "n": [c[at].astype(np.int32).tobytes()]})

    rows = sample.select("lang", "text").mapInPandas(sparse, "lang string, at binary, n binary").toPandas()
    langs, cents, of, reach = [], [], [], []
    for lang in sorted(rows["lang"].unique()):
        own = rows[rows["lang"] == lang].sort_values(["at", "n"], key=lambda s: s.map(bytes)).head(2 * fit_texts)
        counts = np.zeros((len(own), CELLS), np.float32)
        for i, (at, n) in enumerate(zip(own["at"], own["n"], strict=True)):
            counts[i, np.frombuffer(at, np.int32)] = np.frombuffer(n, np.int32)
        x = vectors(counts, idf)
        c = cluster(x, centroids, np.random.default_rng(7))
        cos = x @ c.T
        langs.append(lang)
        for j in range(len(c)):
            mine = cos[cos.argmax(1) == j, j]
            cents.append(c[j])
            of.append(len(langs) - 1)
            reach.append(float(np.quantile(mine, 1 - FAR_QUANTILE)) if len(mine) else -1.0)
    return Model(idf, langs, np.array(cents, np.float32).reshape(-1, CELLS), np.array(of, int), np.array(reach))


def identify(docs: DataFrame, model: Model, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """id_cols of docs with lang_pred, score and rejected. The model is broadcast: CELLS floats a centroid."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        lang, score, rejected = shared.value.predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang_pred": lang, "score": score, "rejected": rejected})

    return docs.withColumn("_p", run(F.col(text_col))).select(*id_cols, "_p.*")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = bucket_of(F.col("doc_id")) == 2
    model = fit(docs.where(~held))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model, ["doc_id", "held_out"])
