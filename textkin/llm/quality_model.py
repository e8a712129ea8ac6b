"""Quality classifier by positive-unlabelled learning.

A linear model on bounded features of a whole text: relative frequencies of pairs of neighbouring character classes
(letters by case, digits, other letters, white space, each ASCII sign by itself) and a few shape figures (length, share of
repeated words and lines, word length). It is trained on trusted positives and unlabelled texts by the non-negative
unbiased risk: prior E_p[l(g, 1)] + max(0, E_u[l(g, -1)] - prior E_p[l(g, -1)]) with the logistic loss; where the second
part falls under 0, its gradient is climbed instead. The class prior is estimated from positives and unlabelled texts alone (share_like);
negative labels are never read. Fitted on at most about FIT_TEXTS positives and as many unlabelled texts, those whose ids hash lowest.

Null and empty texts get a score too; texts are read whole, and equal ones score alike. An empty table gives an empty table. Ids
that repeat, or are null, are drawn by their texts too, and equal (id, text) rows enter the fit once, so its bound holds. Without a positive label every score is the prior 0.5. Labels that are null or
outside 0 and 1 aren't used; an id with several labels counts with each. Other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, table

FIT_TEXTS, STEPS, RATE, DECAY, ACCEPT = 2000, 400, 0.03, 1e-4, 0.7
SIDE = 48


def _classes() -> np.ndarray:
    of = np.zeros(256, np.uint8)
    signs = iter(range(8, SIDE))
    for b in range(256):
        c = chr(b)
        of[b] = 4 if b >= 128 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c == " " else 5 if c == "\n" else 6 if c.isspace() or not c.isprintable() else next(signs)
    return of


CLASSES = _classes()
FEATURES = SIDE * SIDE + 8


def features(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    out = np.zeros(FEATURES, np.float32)
    shape = out[SIDE * SIDE :]
    shape[0] = np.log1p(len(data)) / 10
    if len(data) > 1:
        c = CLASSES[data].astype(np.int64)
        out[: SIDE * SIDE] = np.sqrt(np.bincount(c[:-1] * SIDE + c[1:], minlength=SIDE * SIDE) / (len(data) - 1))
    words = (text or "").split()
    lines = [x for x in (text or "").split("\n") if x.strip()]
    if words:
        pairs = list(zip(words, words[1:], strict=False))
        shape[1] = np.log1p(len(words)) / 10
        shape[2] = len(set(words)) / len(words)
        shape[3] = 1 - len(set(pairs)) / max(1, len(pairs))
        shape[4] = 1 - len(set(lines)) / max(1, len(lines))
        shape[5] = len(data) / len(words) / 10
        shape[6] = np.log1p(len(words) / max(1, len(lines))) / 5
    else:
        shape[7] = 1
    return out


class Model:
    def __init__(self, w: np.ndarray, b: float, mean: np.ndarray, scale: np.ndarray, prior: float):
        self.w, self.b, self.mean, self.scale, self.prior = w, b, mean, scale, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.clip((x - self.mean) * self.scale, -8, 8) @ self.w + self.b, -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> Model:
    """Full-batch Adam on the non-negative risk."""
    both = np.concatenate([positive, unlabelled])
    mean, sd = both.mean(0), both.std(0)
    scale = np.where(sd > 1e-6, 1 / np.maximum(sd, 1e-6), 0).astype(np.float32)
    used = np.flatnonzero(scale)
    p, u = (np.clip((x[:, used] - mean[used]) * scale[used], -8, 8).astype(np.float32) for x in (positive, unlabelled))
    w = np.zeros(len(used) + 1, np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    grad = lambda x, s: np.append(x.T @ s, s.sum()) / len(x)
    for t in range(1, steps + 1):
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of_negative = grad(u, su) - prior * grad(p, sp)
        g = prior * grad(p, sp - 1) + of_negative if negative >= 0 else -of_negative
        g[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = (w - RATE / (1 + 3 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    full = np.zeros(len(scale), np.float32)
    full[used] = w[:-1]
    return Model(full, float(w[-1]), mean.astype(np.float32), scale, prior)


def share_like(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """An estimate of the class prior without negatives, by a positive-against-unlabelled model and rows that it wasn't trained on.

    Under a score t lie shares F_u of the unlabelled and F_p of the positives; as F_u = prior F_p + (1 - prior) F_n and F_n is at most 1,
    (1 - F_u) / (1 - F_p) is never under the prior, and reaches it where t parts the classes. So the least such ratio is taken, over
    the scores between the positives' quantiles .005 and .5, where there are rows enough."""
    fold = lambda x, k: (x[np.arange(len(x)) % 2 != k], x[np.arange(len(x)) % 2 == k])
    p, u = [], []
    for k in range(2):
        (p_in, p_out), (u_in, u_out) = fold(positive, k), fold(unlabelled, k)
        if not (len(p_in) and len(p_out) and len(u_in) and len(u_out)):
            return 0.5
        first = train(p_in, u_in, 0.5, STEPS // 3)
        p.append(first.score(p_out))
        u.append(first.score(u_out))
    p, u = np.concatenate(p), np.concatenate(u)
    ratios = [(u > t).mean() / max(1e-9, (p > t).mean()) for t in np.quantile(p, np.linspace(0.005, 0.5, 100))]
    return float(np.clip(min(ratios), 0.05, 0.95))


def lowest(df: DataFrame, by: list[str], most: int, n: int) -> DataFrame:
    """About `most` of n rows, those whose hash of the columns `by` is lowest, rows equal in it once."""
    h = F.xxhash64(F.lit(13), *by)
    low = df.withColumn("_h", h).where(F.pmod("_h", F.lit(1 << 32)) / float(1 << 32) < min(1.0, most / max(1, n)))
    return low.dropDuplicates(["_h"]).drop("_h")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_texts: int = FIT_TEXTS) -> Model | None:
    """docs: the unlabelled web text; labels: (id, label). Neither holds held-out rows."""
    trusted = labels.where(F.col(label_col) == 1).select(id_col)
    n_trusted = trusted.count()
    if not n_trusted:
        return None
    picked = lowest(trusted, [id_col], fit_texts, n_trusted)
    picked_ids = F.broadcast(picked)  # at most about fit_texts ids

    def run(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"positive": b["positive"], "x": [features(t if isinstance(t, str) else None).astype(np.float16).tobytes() for t in b["text"]]})

    text = F.col(text_col).alias("text")
    p = docs.select(id_col, text).join(picked_ids, id_col, "left_semi").dropDuplicates([id_col, "text"]).select(F.lit(True).alias("positive"), "text")
    u = lowest(docs.select(id_col, text), [id_col, "text"], fit_texts, docs.count()).select(F.lit(False).alias("positive"), "text")
    rows = p.union(u).mapInPandas(run, "positive boolean, x binary").toPandas()
    rows = rows.sort_values(["positive", "x"], key=lambda s: s.map(bytes) if s.name == "x" else s)
    x = np.frombuffer(b"".join(rows["x"]), np.float16).astype(np.float32).reshape(-1, FEATURES)
    is_p = rows["positive"].to_numpy(bool)
    if not is_p.any() or is_p.all():
        return None
    return train(x[is_p], x[~is_p], share_like(x[is_p], x[~is_p]))


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with the score of each whole text; the model's few thousand weights are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        if shared.value is None:
            return pd.Series(np.full(len(texts), 0.5))
        parts = [shared.value.score(np.array([features(t if isinstance(t, str) else None) for t in texts.iloc[i : i + 512]])) for i in range(0, len(texts), 512)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(out_col, run(F.col(text_col)))


def fit_on_known(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of all rows that aren't held out."""
    return fit(docs.where(bucket_of(F.col("doc_id")) != 2), labels.where(bucket_of(F.col("doc_id")) != 2))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on_known(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    out = scored(docs, model).select("doc_id", (bucket_of(F.col("doc_id")) == 2).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
