"""Quality classifier: naive Bayes support vectors.

A text becomes the set of its character n-grams (1 to 3, digits folded, hashed into ``DIMS`` columns). Indicators are
scaled by the class log-count ratio of naive Bayes, rows to unit length, and a linear hinge-loss model is fitted by
dual coordinate descent; out-of-fold margins calibrate a logistic curve to the class shares of all labelled rows.

Fitting reads a bounded sample: at most ``SAMPLE`` labelled rows per class, those with the smallest hash of their
doc_id; it runs in one task on feature sets alone. Scoring is one pass over all whole texts, without a shuffle.

Defined cases: null and empty texts have no features and get the calibrated score of the bias; labels that are null
or contradict each other are not learned from; with one class or none the score is that class, or 0.5; equal texts
score equally; a null doc_id is never held out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import text_of

DIMS, SAMPLE, THRESHOLD, EPOCHS, COST, FOLDS, SPAN = 1 << 17, 4000, 0.3, 12, 1.0, 3, 1 << 20
_SHIFT = np.uint32(32 - (DIMS - 1).bit_length())


def features(text: str | None) -> np.ndarray:
    """The sorted columns of a text's n-grams; long texts are taken in overlapping stretches."""
    if not text:
        return np.empty(0, np.int32)
    seen = np.zeros(DIMS, bool)
    for at in range(0, len(text), SPAN):
        c = np.frombuffer(text[max(0, at - 2): at + SPAN].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where((c >= 48) & (c < 58), np.uint32(48), c)
        h = (c + np.uint32(1)) * np.uint32(2654435761)
        seen[h >> _SHIFT] = True
        for _ in range(2):
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(2246822519) + c[len(c) - len(h) + 1:] * np.uint32(3266489917)
            seen[h >> _SHIFT] = True
    return np.flatnonzero(seen).astype(np.int32)


def log_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    count = [np.bincount(np.concatenate([r for r, k in zip(rows, y) if k == s] or [np.empty(0, np.int32)]), minlength=DIMS) + 1.0 for s in (1, -1)]
    return np.log(count[0] / count[0].sum()) - np.log(count[1] / count[1].sum())


def descend(rows: list[np.ndarray], y: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, float]:
    """Linear hinge loss by dual coordinate descent on ratio-scaled unit rows with a bias column: weights, bias.

    The weights come back multiplied by the ratios, so a margin is their sum over the set, over the row's length.
    """
    ratio = log_ratios(rows, y)
    scaled = [v / (np.linalg.norm(v) or 1.0) for v in (ratio[r] for r in rows)]
    square = np.array([1.0 + float(v @ v) for v in scaled])
    alpha, w, b, rng = np.zeros(len(y)), np.zeros(DIMS), 0.0, np.random.default_rng(seed)
    share = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum())) * cost
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            r, v = rows[i], scaled[i]
            gap = y[i] * (float(w[r] @ v) + b) - 1.0
            step = min(max(alpha[i] - gap / square[i], 0.0), share[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[r] += (step * y[i]) * v
                b += step * y[i]
    return np.stack([w * ratio, ratio ** 2]), b


def margins(rows: list[np.ndarray], model: np.ndarray, bias: float) -> np.ndarray:
    return np.array([float(model[0][r].sum()) / max(1e-12, float(model[1][r].sum()) ** 0.5) + bias for r in rows])


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve (Newton steps, a little ridge)."""
    x, t, beta = np.stack([margin, np.ones_like(margin)], 1), (y > 0).astype(float), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (p - t)) + 1e-3 * beta
        beta -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), g)
    return float(max(beta[0], 1e-6)), float(beta[1])


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    got = pd.concat([*batches, pd.DataFrame({"mark": [], "quality": [], "ids": [], "rows": []})]).sort_values(["mark", "quality"], kind="stable")
    rows, y = [np.asarray(r, np.int32) for r in got["ids"]], np.where(got["quality"].to_numpy() > 0, 1, -1)
    if len(set(y)) < 2:
        yield pd.DataFrame({"model": [b""], "bias": [0.0], "slope": [1.0], "offset": [0.0 if not len(y) else 30.0 * y[0]]})
        return
    fold, out = np.arange(len(y)) % FOLDS, np.zeros(len(y))
    for k in range(FOLDS):
        if len(set(y[fold != k])) == 2:
            model, bias = descend([r for r, f in zip(rows, fold) if f != k], y[fold != k])
            out[fold == k] = margins([r for r, f in zip(rows, fold) if f == k], model, bias)
    slope, offset = calibrate(out, y, got["rows"].to_numpy(float))
    model, bias = descend(rows, y)
    yield pd.DataFrame({"model": [model.astype(np.float32).tobytes()], "bias": [bias], "slope": [slope], "offset": [offset]})


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def feature_sets(text: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in text], dtype=object)


def learning_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, quality, mark, rows): the bounded sample; ``rows`` is how many labelled rows a sampled one stands for."""
    learn = (labels.where("quality is not null and doc_id is not null").groupBy("doc_id")
             .agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
             .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
             .select(F.col("doc_id").alias("_id"), (F.col("quality") > 0).cast("int").alias("_quality"), F.xxhash64("doc_id").alias("_mark")))
    share = {r["_quality"]: r["count"] / min(r["count"], sample) for r in learn.groupBy("_quality").count().collect()}
    picked = None
    for side in (0, 1):
        part = learn.where(F.col("_quality") == side).orderBy("_mark", "_id").limit(sample).withColumn("_rows", F.lit(float(share.get(side, 1.0))))
        picked = part if picked is None else picked.union(part)
    # two times ``sample`` rows of a few numbers: safe to send to every task
    # a repeated doc_id teaches with one of its texts, the smallest, so the bound is one of rows too
    rows = docs.select(F.col("doc_id").alias("_doc"), text_of().alias("text"))
    return (rows.join(F.broadcast(picked), F.col("_doc") == F.col("_id")).groupBy("_id", "_quality", "_mark", "_rows").agg(F.min("text").alias("text"))
            .select("text", F.col("_quality").alias("quality"), F.col("_mark").alias("mark"), F.col("_rows").alias("rows")))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The fitted model: a few numbers and 2 x DIMS weights."""
    got = learning_rows(docs, labels, sample).select(feature_sets("text").alias("ids"), "quality", "mark", "rows")
    row = got.repartition(1).mapInPandas(_fit, "model binary, bias double, slope double, offset double").first()
    if row is None:
        return {"model": b"", "bias": 0.0, "slope": 1.0, "offset": 0.0}
    return {"model": bytes(row["model"]), "bias": row["bias"], "slope": row["slope"], "offset": row["offset"]}


def score(model: dict, spark):
    """A column function: text → score in [0, 1]."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def of(text: pd.Series) -> pd.Series:
        m = sent.value
        if not m["model"]:
            return pd.Series(np.full(len(text), 1 / (1 + np.exp(-m["offset"]))))
        table = np.frombuffer(m["model"], np.float32).reshape(2, -1).astype(float)
        margin = margins([features(t) for t in text], table, m["bias"])
        return pd.Series(1 / (1 + np.exp(-np.clip(m["slope"] * margin + m["offset"], -30, 30))))
    return of


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Documents → (doc_id, held_out, score, predicted)."""
    of = score(fit(docs, labels, sample), docs.sparkSession)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return (docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), of("text").alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, all their columns."""
    of = score(fit(docs, labels), docs.sparkSession)
    return docs.where(of("text") >= THRESHOLD)
