"""Toxicity by a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams of lower-cased characters, present or not.  Labelled rows give every feature a log ratio of
its smoothed share among toxic and other documents.  A feature's share in the two classes must differ by MIN_Z standard
errors, else its ratio counts as 0; as many features as pass are used.  Their values are scaled by the ratio, and a
logistic regression with an L2 penalty is fitted on them by stochastic dual coordinate ascent, in one task, as the
sample of a class is bounded.  The constant is set back to the share of toxic ones among all labels.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import boxed, id_remainder, own_names, store, text_or_empty
from cairn.llm.tokens import small

SIZES = (4, 5, 6)
BITS = 20
#: Labelled rows of each class that are learnt from at most, in the order of a hash of their identifier.
SAMPLE = {1: 4000, 0: 6000}
MIN_DOCS, MIN_Z = 3, 3.0
SMOOTHING = 1.0
PENALTY, EPOCHS = 1.0, 40
THRESHOLD = 0.7
#: Characters that are hashed at once.
BLOCK = 1 << 19


def multipliers() -> np.ndarray:
    rng = np.random.default_rng(20_111)
    return rng.integers(1, 1 << 62, size=max(SIZES) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


MULTIPLIERS = multipliers()


def buckets(chars: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram at every place but the last n - 1."""
    if len(chars) < n:
        return np.zeros(0, dtype=np.int32)
    wide = chars.astype(np.uint64)
    h = np.full(len(chars) - n + 1, n, dtype=np.uint64) * MULTIPLIERS[0]
    for k in range(n):
        h += wide[k : k + len(h)] * MULTIPLIERS[k + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def characters(text: str) -> np.ndarray:
    """Lower-cased code points with a space on either side, so that word ends are features too."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def blocks(chars: np.ndarray) -> Iterator[np.ndarray]:
    """Parts that overlap by an n-gram less one, so that a very long text takes little memory at a time."""
    step = BLOCK - max(SIZES) + 1
    for a in range(0, max(1, len(chars) - max(SIZES) + 1), step):
        yield chars[a : a + BLOCK]


SEEN = np.zeros(1 << BITS, dtype=bool)


def present(text: str) -> np.ndarray:
    """The different buckets of a text, in order; blocks are marked one by one."""
    for part in blocks(characters(text)):
        for n in SIZES:
            SEEN[buckets(part, n)] = True
    found = np.flatnonzero(SEEN).astype(np.int32)
    SEEN[found] = False
    return found


def count_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that have a feature, summed over the task."""
    sums = np.zeros((2, 1 << BITS), dtype=np.int32)
    for batch in small(batches):
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
            sums[toxic][present(text)] += 1
    some = np.flatnonzero(sums.any(axis=0)).astype(np.int32)
    for a in range(0, len(some), 1 << 16):
        part = some[a : a + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums[1][part].astype(np.int64)), pa.array(sums[0][part].astype(np.int64))], names=["feature", "pos", "neg"])


def hits(text: str, column: np.ndarray) -> np.ndarray:
    """Columns of the kept features that a text has."""
    found = []
    for part in blocks(characters(text)):
        for n in SIZES:
            at = column[buckets(part, n)]
            found.append(at[at >= 0])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int32)


@dataclass
class Model:
    """column: place of each bucket among the kept features or -1; weight: with the ratio multiplied in."""

    column: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weight[hits(text, self.column)].sum(), -60, 60))))


def fit(rows: list[np.ndarray], toxic: np.ndarray, ratio: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and constant that minimise the logistic losses of all rows plus PENALTY / 2 times the squares of both, on
    features present (columns of `ratio`) scaled by their ratio.  Each step takes one row's dual variable, in an order
    drawn anew each epoch from a fixed seed."""
    w, b = np.zeros(len(ratio)), 0.0
    n = len(rows)
    if not n or toxic.min() == toxic.max():
        share = float(np.clip(toxic.mean() if n else 0.0, 1 / (n + 2), 1 - 1 / (n + 2)))
        return w, float(np.log(share / (1 - share)))
    sign, alpha = np.where(toxic > 0, 1.0, -1.0), np.zeros(n)
    values = [ratio[r] for r in rows]
    curve = [max(1.0, 0.25 + (float(v @ v) + 1) / PENALTY) for v in values]
    rng = np.random.default_rng(12)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(n):
            r, v = rows[i], values[i]
            z = float(np.clip(sign[i] * (w[r] @ v + b), -60, 60))
            step = sign[i] / (1 + np.exp(z)) - alpha[i]
            most = max(most, abs(step))
            move = step / curve[i]
            alpha[i] += move
            w[r] += move / PENALTY * v
            b += move / PENALTY
        if most < 1e-3:
            break
    return w, b


def log_ratio(p: np.ndarray, q: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log ratio of the smoothed shares of the toxic documents (p of n1) and of others (q of n0) that have a feature."""
    return np.log((p + SMOOTHING) / (n1 + 2 * SMOOTHING)) - np.log((q + SMOOTHING) / (n0 + 2 * SMOOTHING))


def prior_shift(counts: dict[int, int]) -> float:
    """What the log-odds of labels by class lose when of each class SAMPLE rows at most are learnt from."""
    if not counts.get(1) or not counts.get(0):
        return 0.0
    taken = {c: min(counts[c], n) for c, n in SAMPLE.items()}
    return float(np.log(counts[1] / counts[0]) - np.log(taken[1] / taken[0]))


def train(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (3, 1)) -> Model:
    """Fit on labelled rows outside the held-out fold.  The sample of labels is bounded by SAMPLE, and so is what is
    broadcast (identifiers); what is collected (features, and the model) is bounded by the number of buckets."""
    spark = docs.sparkSession
    usable = own_names(labels, ["doc_id", "toxic"]).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = usable.where(id_remainder("doc_id", fold[0]) != fold[1]).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    labelled = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in SAMPLE.items()]
    sample = own_names(docs, ["doc_id", "text"]).select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    sample = store(sample.select("doc_id", "toxic", "text"), "toxicity-sample")
    counts = sample.mapInArrow(count_features, "feature int, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    share = (F.col("pos") + F.col("neg") + 1) / F.lit(n1 + n0 + 2.0)
    z = (F.col("pos") / F.lit(max(1.0, n1)) - F.col("neg") / F.lit(max(1.0, n0))) / F.sqrt(share * (1 - share) * F.lit(1 / max(1, n1) + 1 / max(1, n0)))
    kept = counts.where(F.col("pos") + F.col("neg") >= MIN_DOCS).withColumn("z", F.abs(z)).where(F.col("z") >= MIN_Z)
    kept = kept.orderBy("feature").select("feature", "pos", "neg").toArrow()  # 1 << BITS rows at most
    features, p, q = (np.asarray(kept.column(c)) for c in ("feature", "pos", "neg"))
    ratio = log_ratio(p, q, n1, n0)
    column = np.full(1 << BITS, -1, dtype=np.int32)
    column[features] = np.arange(len(features))
    shared = spark.sparkContext.broadcast((column, ratio))

    def reduced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [hits(t, shared.value[0]).astype("<i4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())], names=["doc_id", "toxic", "hits"])

    def fitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "hits", "toxic")), strict=True))
        w, b = fit([np.frombuffer(h, dtype="<i4") for _, h, _ in rows], np.array([t for *_, t in rows], dtype=float), shared.value[1])
        yield pa.RecordBatch.from_arrays([pa.array([(w * shared.value[1]).astype("<f8").tobytes()], pa.binary()), pa.array([b])], names=["weights", "bias"])

    # one task: SAMPLE bounds its rows, and 1 << BITS the features of a row
    model = sample.mapInArrow(reduced, "doc_id long, toxic int, hits binary").repartition(1).mapInArrow(fitted, "weights binary, bias double").first()
    if model is None:  # an empty sample may have no task at all
        w, b = fit([], np.zeros(0), ratio)
    else:
        w, b = np.frombuffer(model["weights"], dtype="<f8"), model["bias"]
    return Model(column, w, float(b) + (prior_shift(labelled) if n1 and n0 else 0.0))


def marked(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (3, 1)) -> DataFrame:
    """row (all columns of docs, whatever their names), score (0 to 1), predicted (1 from THRESHOLD on).

    Labels are learnt from outside the fold (modulus, held-out remainder of crc32 of the identifier); the text alone is
    scored, whole.  A null text is empty and gets the score of the classifier's constant; without labels of both
    classes all scores are the share of toxic ones.  Repeated labels of a document count once, toxic if any is.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fold))
    rows = docs.select(boxed(docs))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            scores = [model.value.score(t or "") for t in batch.column("row").field("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=["row", "score"])

    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def score_documents(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (3, 1)) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text); see marked()."""
    found = marked(own_names(docs, ["doc_id", "text"]), labels, fold)
    return found.select("row.doc_id", "score", "predicted").select("doc_id", (id_remainder("doc_id", fold[0]) == fold[1]).alias("held_out"), "score", "predicted")
