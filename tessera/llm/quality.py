"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network with calibrated probabilities.

Every word (and run of other visible characters) falls into a hashed bucket with a sparse random index vector of -1, 0 and 1. Its word vector
adds up the index vectors of its neighbours in the training sample. Words of a notable shape (capitals, digits, mixed, long runs of signs, a word said twice running) also
count as a word of that shape. A document is the mean of its word vectors beside the mean of its shape vectors; short ones are drawn
towards the mean of good documents by a prior of ``PRIOR`` tokens, so that a few words are no evidence. A network of one hidden layer, trained with Adam, gives a logit, and a temperature fitted on held-out documents turns it into a probability.

The model is fitted on at most ``per_class`` labelled documents of each class (seeded digest order); all documents are scored, over whole texts.

Defined cases: without labels of both classes nothing is rejected and probabilities are null; a null or empty text has null probability and is
kept in scoring but has no evidence; null ids and repeated rows give a row each; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.llm.tables import filtered, labelled_sample, table

BUCKETS, DIM, ACTIVE, WINDOW, SHAPES, HIDDEN = 1 << 15, 64, 6, 2, 9, 32
PER_CLASS, THRESHOLD, SEED, PRIOR = 2500, 0.5, 5, 10
SCHEMA = "doc_id long, p_quality double, keep boolean"
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, shape (0: none) and document of every token of a slice."""
    kind = tk.CLASS[data]
    starts, ends, doc = tk.runs(kind, offs)
    bucket = (tk.run_hashes(tk.LOWER[data], starts, ends) % np.uint64(BUCKETS)).astype(np.int32)
    size = ends - starts
    up, digits = (np.concatenate([[0], np.cumsum(m[data])]) for m in (UPPER, DIGIT))
    ups, digits = up[ends] - up[starts], digits[ends] - digits[starts]
    sign = kind[starts] == 2
    shape = np.select([sign & (size > 1), sign, digits > 0, (ups > 1) & (2 * ups > size), ups > 1, ups == 1, size > 14], [1, 2, 3, 4, 5, 6, 7], 0).astype(np.int32)
    again = np.flatnonzero((bucket[1:] == bucket[:-1]) & (doc[1:] == doc[:-1])) + 1
    shape[again] = 8
    return bucket, shape, doc


def index_vectors(rows: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, DIM), np.float32)
    where = rng.random((rows, DIM)).argpartition(ACTIVE, axis=1)[:, :ACTIVE]
    np.put_along_axis(out, where, rng.choice(np.float32([-1, 1]), (rows, ACTIVE)), axis=1)
    return out / np.sqrt(np.float32(ACTIVE))


def pooled(vectors: np.ndarray, shapes: np.ndarray, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean vectors and token counts of the documents of a slice."""
    docs = len(offs) - 1
    bucket, shape, doc = tokens(data, offs)
    count = np.bincount(doc, minlength=docs)
    out = np.zeros((docs, 2 * DIM), np.float32)
    first = np.concatenate([[0], np.cumsum(count)])
    for lo in range(0, docs):
        a, b = first[lo], first[lo + 1]
        for k in range(a, b, 1 << 16):  # long documents by parts, to bound memory
            out[lo, :DIM] += vectors[bucket[k : min(b, k + (1 << 16))]].sum(axis=0)
    out[:, DIM:] = np.bincount(doc * SHAPES + shape, minlength=docs * SHAPES).reshape(docs, SHAPES).astype(np.float32) @ shapes
    return out / np.maximum(count, 1)[:, None].astype(np.float32), count


def drawn(x: np.ndarray, count: np.ndarray, towards: np.ndarray) -> np.ndarray:
    share = (count / (count + PRIOR))[:, None]
    return x * share + towards * (1 - share)


def logits(model: dict, x: np.ndarray) -> np.ndarray:
    z = (x - model["mean"]) / model["std"]
    return np.maximum(z @ model["w1"] + model["b1"], 0) @ model["w2"] + model["b2"]


def chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, seed: int, epochs: int = 40, rate: float = 0.01) -> dict:
    """The network, with a temperature from a fifth of the rows that it was not trained on."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    mean, std = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-4
    z = (x - mean) / std
    p = [rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    weight = np.where(y == 1, 0.5 / max(y[fit].mean(), 1e-6), 0.5 / max(1 - y[fit].mean(), 1e-6))
    for _ in range(epochs):
        fit = rng.permutation(fit)
        for k in range(0, len(fit), 128):
            i = fit[k : k + 128]
            a = z[i] @ p[0] + p[1]
            r = np.maximum(a, 0)
            e = (chance(r @ p[2] + p[3]) - y[i]) * weight[i] / len(i)
            back = np.outer(e, p[2]) * (a > 0)
            grads = [z[i].T @ back + 1e-4 * p[0], back.sum(axis=0), r.T @ e + 1e-4 * p[2], np.array([e.sum()])]
            step += 1
            for j, g in enumerate(grads):
                m[j] += 0.1 * (g - m[j])
                v[j] += 0.001 * (g * g - v[j])
                p[j] -= rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    model = {"mean": mean, "std": std, "w1": p[0], "b1": p[1], "w2": p[2], "b2": p[3]}
    check = held if len(held) else fit
    raw = logits(model, x[check])
    grid = np.exp(np.linspace(np.log(0.25), np.log(20), 60))
    loss = [-(weight[check] * (y[check] * np.log(chance(raw / t) + 1e-12) + (1 - y[check]) * np.log(1 - chance(raw / t) + 1e-12))).mean() for t in grid]
    model["temperature"] = float(grid[int(np.argmin(loss))])
    model["held_out_accuracy"] = float(((raw > 0) == (y[check] == 1)).mean())
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = SEED) -> dict | None:
    """The model as numpy arrays; None without labelled documents of both classes."""
    sample = labelled_sample(docs, labels, "quality", per_class).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    y = sample.column("label").to_numpy().astype(float)
    if len(set(y)) < 2:
        return None
    index = index_vectors(BUCKETS, seed)
    context = np.zeros_like(index)
    parts = list(tk.slices(sample.column("text"), 1 << 20))
    for _, _, data, offs in parts:
        bucket, _, doc = tokens(data, offs)
        for gap in range(1, WINDOW + 1):
            same = np.flatnonzero(doc[gap:] == doc[:-gap])
            left, right = bucket[same], bucket[same + gap]
            for a, b in ((left, right), (right, left)):
                order = np.argsort(a, kind="stable")
                s = a[order]
                first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else []
                if len(s):
                    context[s[first]] += np.add.reduceat(index[b[order]], first, axis=0)
    vectors = index + context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)
    shapes = np.vstack([np.zeros((1, DIM), np.float32), index_vectors(SHAPES - 1, seed + 1)])
    got = [pooled(vectors, shapes, data, offs) for _, _, data, offs in parts]
    x, count = np.vstack([g[0] for g in got]).astype(float), np.concatenate([g[1] for g in got])
    good = x[y == 1].mean(axis=0)
    del sample, context, index, parts, got
    tk.release()
    return train(drawn(x, count, good), y, seed) | {"good": good, "vectors": vectors.astype(np.float32), "shapes": shapes}


def score(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_quality and keep (p_quality at least ``threshold``, or unknown) of every document."""
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("double").alias("p_quality"), F.lit(True).alias("keep"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            p, known, keep = judge(held.value, batch.column(1), threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(p, mask=~known), pa.array(keep)], names=["doc_id", "p_quality", "keep"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def judge(model: dict, texts, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability, whether there is one, and keep, for a batch of texts."""
    got = [pooled(model["vectors"], model["shapes"], data, offs) for _, _, data, offs in tk.slices(texts, 1 << 18)]
    if not got:
        return np.zeros(0), np.zeros(0, bool), np.zeros(0, bool)
    count = np.concatenate([g[1] for g in got])
    x, known = drawn(np.vstack([g[0] for g in got]), count, model["good"]), count > 0
    p = chance(logits(model, x) / model["temperature"])
    return p, known, (p >= threshold) | ~known


def accepted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""
    model = fit(docs, labels, per_class)
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)
    return filtered(docs, lambda texts: pa.array(judge(held.value, texts, threshold)[2]))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, fit(docs, labels, per_class), threshold)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
