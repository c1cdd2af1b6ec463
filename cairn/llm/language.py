"""Language-model scores: an add-one unigram base and a log-bilinear model trained with noise-contrastive estimation.

Counts of all words of the training rows are aggregated exactly.  The model (bilinear.py) predicts units from the units
before: the end, words with vectors of their own (those seen at least N ** (2/3) / OWN times in N words, so at most
OWN * N ** (1/3) of them, which grows with the corpus), and classes of all other words by their ending, in which a word
has its add-one share.  No word is left out.

Training learns from every place of every training row, once: each row's text tells its round, every partition starts
from the round's parameters, learns from all places of its documents of the round in minibatches, and sends the rows it
changed; their means, weighted by how often each was changed, begin the next round.

Counts of frequent words (a bounded table) are broadcast; those of all other words are joined.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import bilinear
from cairn.llm.common import id_remainder, own_names, store, text_or_empty
from cairn.llm.tokens import small

#: Words whose counts are broadcast, at most (and those with vectors), and their length in bytes, at most.
HEAD, HEAD_BYTES = 1 << 18, 64
#: Different words that a task counts before it sends them on.
FLUSH = 400_000
#: Words with vectors (see above), and the rounds over which the rows are dealt.
OWN, ROUNDS = 64, 2
SLICES = 16
CHANGED = "name string, slice int, rows binary, weights binary, means binary"


def words(text: str | None) -> list[bytes]:
    """UTF-8 words, A-Z lower-cased; bytes.split knows the same six separators."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return batch

    for batch in small(batches):
        for text in batch.column("text").to_pylist():
            counts.update(words(text))
            if len(counts) > FLUSH:
                yield out()
    yield out()


class Model(NamedTuple):
    """What scoring needs.  head: frequent words, with log10(c + 1) and their units (one more of each, at the place -1, for
    other words); class_size: log10(n + v + 1) for the class of a unit; sizes and the gain of the end."""

    vocabulary: bilinear.Vocabulary
    parameters: bilinear.Parameters
    head: list[bytes]
    gain: np.ndarray
    units: np.ndarray
    class_size: np.ndarray
    size: float
    end_gain: float
    n_words: int
    n_docs: int

    def rank(self) -> dict[bytes, int]:
        return Rank(zip(self.head, range(len(self.head)), strict=True))

    def known(self, found: list[bytes], rank: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Place in the head of each word, or -1, and its unit."""
        at = np.fromiter(map(rank.__getitem__, found), dtype=np.int64, count=len(found))
        units = self.units[at]
        other = np.flatnonzero(at < 0)
        units[other] = self.vocabulary.classes[bilinear.endings(map(found.__getitem__, other.tolist()), len(other))]
        return at, units


class Rank(dict):
    """Places of words; -1 for others."""

    def __missing__(self, key: bytes) -> int:
        return -1


def learn_part(shared, round_: int):
    """A partition's round: parameters that it changed, with how often."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        rank, v = model.rank(), model.vocabulary
        trainer = bilinear.Trainer(v, model.parameters, seed=(TaskContext.get().partitionId() << 8) + round_)

        documents = (words(text) for batch in small(batches) for text in batch.column("text").to_pylist())
        trainer.learn(documents, lambda found: model.known(found, rank)[1])
        for name, x in trainer.p.items():
            changed = np.flatnonzero(trainer.touched[name])
            for s in range(SLICES):
                at = changed[changed % SLICES == s]
                if len(at):
                    yield changed_batch(name, s, at, trainer.touched[name][at], x[at])

    return run


def changed_batch(name: str, s: int, at: np.ndarray, weights: np.ndarray, means: np.ndarray) -> pa.RecordBatch:
    parts = [at.astype("<i4"), weights.astype("<f8"), means.astype("<f4")]
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([s], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], names=[f.split()[0] for f in CHANGED.split(", ")])


def add_up(rows, sums: dict[str, np.ndarray], weights: dict[str, np.ndarray], shapes: dict[str, tuple[int, ...]]) -> None:
    """Weighted sums of changed rows."""
    for name, at, w, means in rows:
        if name not in sums:
            sums[name], weights[name] = np.zeros(shapes[name]), np.zeros(shapes[name][0])
        at, w = np.frombuffer(at, dtype="<i4"), np.frombuffer(w, dtype="<f8")
        values = np.frombuffer(means, dtype="<f4").reshape(len(at), *shapes[name][1:])
        sums[name][at] += values * w.reshape(-1, *[1] * (values.ndim - 1))
        weights[name][at] += w


def sum_parts(shapes: dict[str, tuple[int, ...]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        weights: dict[str, np.ndarray] = {}
        for batch in batches:
            add_up(zip(*(batch.column(c).to_pylist() for c in ("name", "rows", "weights", "means")), strict=True), sums, weights, shapes)
        for name, x in sums.items():
            at = np.flatnonzero(weights[name])
            w = weights[name][at]
            yield changed_batch(name, 0, at, w, x[at] / w.reshape(-1, *[1] * (x.ndim - 1)))

    return run


def learn(learnt: DataFrame, counts: DataFrame, train_docs: int, head: int = HEAD, rounds: int = ROUNDS) -> Model:
    """The model of the texts of `learnt`, whose words have these counts.  Collected are words with vectors, sums of the
    ending classes, `head` frequent words and one set of parameters."""
    spark = learnt.sparkSession
    # counts by sixteenths of a power of two: at most a thousand rows, whatever the corpus
    level = F.floor(F.log2("c") * 16).cast("int")
    sizes = {r["level"]: r for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).collect()}
    n_words, v_words = sum(r["n"] for r in sizes.values()), sum(r["v"] for r in sizes.values())
    held, lowest = 0, 0
    for at in sorted(sizes, reverse=True):
        held += sizes[at]["v"]
        lowest = at
        if held > head:
            lowest = at + 1
            break
    short = F.octet_length("word") <= HEAD_BYTES
    owned = short & (F.col("c") >= max(2.0, n_words ** (2 / 3) / OWN))
    frequent = counts.where(owned | ((level >= lowest) & short)).select("word", "c", owned.alias("owned")).toArrow()
    order = sorted(zip(*(frequent.column(c).to_pylist() for c in ("word", "c", "owned")), strict=True), key=lambda x: (-x[1], x[0]))
    tail = F.when(F.octet_length("word") <= bilinear.ENDING_BYTES, F.col("word")).otherwise(F.substring("word", -bilinear.ENDING_BYTES, bilinear.ENDING_BYTES))
    by_class = counts.where(~owned).groupBy((F.crc32(tail) % bilinear.ENDINGS).cast("int").alias("class")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    class_n, class_v = np.zeros(bilinear.ENDINGS), np.zeros(bilinear.ENDINGS)
    for r in by_class:
        class_n[r["class"]], class_v[r["class"]] = r["n"], r["v"]
    v = bilinear.Vocabulary([w for w, _, o in order if o], [c for _, c, o in order if o], class_n, train_docs)
    class_size = np.zeros(len(v))
    class_size[v.classes] = np.log10(class_n + class_v + 1)
    top = [w for w, *_ in order]
    n, types = n_words + train_docs, v_words + (train_docs > 0)
    model = Model(
        v, bilinear.begin(v), top, np.log10(np.array([c for _, c, _ in order] + [0], dtype=np.float64) + 1), np.append(v.units(top), 0), class_size,
        float(np.log10(n + types + 1)), float(np.log10(train_docs + 1)), n_words, train_docs,
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shapes = {name: x.shape for name, x in model.parameters.items()}
    for round_ in range(rounds if train_docs else 0):
        own = learnt.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == round_)
        changed = own.mapInArrow(learn_part(spark.sparkContext.broadcast(model), round_), CHANGED)
        rows = changed.repartition(min(parts, SLICES), "slice").mapInArrow(sum_parts(shapes), CHANGED).collect()  # parameters once
        sums: dict[str, np.ndarray] = {}
        weights: dict[str, np.ndarray] = {}
        add_up([(r["name"], r["rows"], r["weights"], r["means"]) for r in rows], sums, weights, shapes)
        model = model._replace(parameters={k: bilinear.averaged(x, sums[k], weights[k]) if k in sums else x for k, x in model.parameters.items()})
    return model


ROWS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<struct<word:binary,m:int>>"
#: Characters of texts that are scored together, unless one is longer.
TOGETHER = 1 << 20


def score_rows(shared):
    """Everything about a text but its words outside the broadcast counts, which are listed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        rank, scorer = model.rank(), bilinear.Scorer(model.vocabulary, model.parameters)
        row = TaskContext.get().partitionId() << 36
        for batch in small(batches):
            texts = batch.column("text").to_pylist()
            cuts = np.cumsum([len(t) for t in texts]) // TOGETHER
            for a, b in zip(*(lambda x: (x, [*x[1:], len(texts)]))(np.flatnonzero(np.diff(cuts, prepend=-1)).tolist()), strict=True):
                n_tokens, n_known, base, score, tail = score_group(model, rank, scorer, texts[a:b])
                some = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + b - a)), some.column("doc_id"), some.column("held_out"), pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(score), tail],
                    names=[f.split()[0] for f in ROWS.split(", ")],
                )
                row += b - a

    return run


def score_group(model: Model, rank: dict[bytes, int], scorer: bilinear.Scorer, texts: list[str], places: int = 1 << 15):
    """Tokens, known tokens, base and score of each text, and its words outside the head; all texts at once."""
    v, n = model.vocabulary, len(texts)
    lists = [words(t) for t in texts]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    flat = list(itertools.chain.from_iterable(lists))
    at, units = model.known(flat, rank)
    of = np.repeat(np.arange(n), sizes)
    gains, in_class = model.gain[at], v.is_class[units]
    total = lambda x: np.bincount(of, x, minlength=n)
    base = total(gains) + model.end_gain - (sizes + 1) * model.size
    score = total(np.where(in_class, gains - model.class_size[units], 0.0))
    known = total((at >= 0).astype(np.float64)).astype(np.int64) + (model.n_docs > 0)
    other = np.flatnonzero(at < 0)
    rare = Counter(zip(of[other].tolist(), map(flat.__getitem__, other.tolist()), strict=True))  # in the texts' order
    ends = np.cumsum(np.bincount(np.fromiter((i for i, _ in rare), np.int64, len(rare)), minlength=n))
    listed = pa.StructArray.from_arrays([pa.array([w for _, w in rare], pa.binary()), pa.array(rare.values(), pa.int32())], names=["word", "m"])
    tail = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), listed)
    # each text and its end, one after the other
    starts = np.cumsum(sizes + 1) - sizes - 1
    line = np.full(len(flat) + n, v.end, dtype=np.int64)
    line[np.arange(len(flat)) + of] = units
    before = bilinear.contexts(line, starts, v.end)
    found = np.concatenate([scorer.log10(before[a : a + places], line[a : a + places]) for a in range(0, len(line), places)])
    return sizes + 1, known, base, score + np.add.reduceat(found, starts), tail


def score_texts(docs: DataFrame, fold: tuple[int, int] = (7, 2), head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs(doc_id, text).

    Rows outside the fold (modulus, held-out remainder of crc32 of the identifier) are learnt from.  Tokens are words
    and one end; a null text is empty and has the end alone.  Repeated rows are scored each and learnt from each.
    Without training rows all counts are 0.  A stored row number, not the identifier, joins what belongs to a row.
    """
    spark = docs.sparkSession
    rows = own_names(docs, ["doc_id", "text"]).select(
        F.col("doc_id").cast("long").alias("doc_id"), (id_remainder("doc_id", fold[0]) == fold[1]).alias("held_out"), text_or_empty().alias("text")
    )
    learnt = rows.where(~F.col("held_out")).select("text")
    counts = store(learnt.mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "lm-counts")
    model = learn(learnt, counts, rows.where(~F.col("held_out")).count(), head)
    scored_rows = store(rows.mapInArrow(score_rows(spark.sparkContext.broadcast(model)), ROWS), "lm-rows")
    rare = scored_rows.select("row", F.explode("tail").alias("t")).select("row", F.col("t.word").alias("word"), F.col("t.m").alias("m"))
    rare = rare.join(counts, "word").groupBy("row").agg(F.sum(F.col("m") * F.log10(F.col("c") + 1)).alias("gain"), F.sum("m").alias("known"))
    gain = F.coalesce("gain", F.lit(0.0))
    return scored_rows.drop("tail").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.n_words + model.n_docs).cast("long").alias("train_tokens"), (F.col("base") + gain).alias("base_score"), (F.col("score") + gain).alias("score"),
    )
