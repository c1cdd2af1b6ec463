"""Near-duplicates by one-permutation MinHash with optimal densification, banded buckets and star-shaped candidates.

1. A text's set are the 64-bit hashes of its distinct word shingles.  Equal sets form one class.
2. One permutation: the hash range is cut into BINS bins, each bin's least hash is its value; an empty bin takes the
   value of the first non-empty bin in a random order of its own.  BANDS bands of ROWS bins give a class its buckets.
3. Stars: every bucket has a hub, and its classes are candidates of the hub only, so a bucket of n gives n pairs, not
   n squared.  Candidates are confirmed on full sets and linked.
4. Most buckets then lie in one component.  In the others, a class outside the bucket's main component may still have
   a partner there, and no link may be lost.  The classes of these buckets meet by prefixes: of a set of n shingles,
   those that fewest of these classes hold come first, and two sets at the threshold share one of their first
   n - ceil(0.8 n) + 1.  So classes that fill a bucket because they share a passage do not meet: the passage's
   shingles come last, and shingles that one class holds alone meet nobody.  What meets is checked by size and by
   parity bitmaps: MARK_BITS bits, each the parity of how many of a class's shingles fall on it.  Bits that differ
   between two classes are no more than the shingles that only one of them holds, so counting them leaves only pairs
   that may reach the threshold; these are confirmed like the rest.  Neither bound drops a link.
5. Components of the links give the classes of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import boxed, id_key, one_of_each, own_names, store, text_or_empty
from cairn.llm.graph import components
from cairn.llm.tokens import small

SHINGLE, PERCENT = 5, 80
#: A pair at a similarity of 0.8 shares no bucket with probability (1 - 0.8 ** ROWS) ** BANDS, about 1e-7.
ROWS, BANDS = 5, 40
BINS = ROWS * BANDS
MARK_BITS = 1024
#: Bytes of text whose shingles are hashed at once.
BLOCK = 1 << 18
SKETCH = "doc_id long, text_hash long, n_shingles long, print binary, bands array<long>, marks array<long>"


@lru_cache(maxsize=1)
def numbers() -> dict:
    """Fixed random odd multipliers, byte values, bin edges and the densification orders."""
    rng = np.random.default_rng(987_654_321)
    odd = lambda n: rng.integers(0, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(odd(1)[0])
    return {
        "bytes": odd(256),
        "base": np.uint64(base),
        "inverse": np.uint64(pow(base, -1, 1 << 64)),
        "word": odd(1)[0],
        "shingle": odd(64),
        "band": odd(ROWS),
        "edges": np.array([-(-(j << 64) // BINS) for j in range(1, BINS)], dtype=np.uint64),
        "donors": np.stack([rng.permutation(BINS) for _ in range(BINS)]),
    }


@lru_cache(maxsize=2)
def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n."""
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (xor-shifts and odd multiplications)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of the bytes: a polynomial over byte values, from prefix sums."""
    fixed = numbers()
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    step = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    size = 1 << max(16, (len(raw) + 1).bit_length())
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(fixed["bytes"][raw] * powers(int(fixed["base"]), size)[: len(raw)])))
    scaled = (sums[ends] - sums[starts]) * powers(int(fixed["inverse"]), size)[starts]
    return starts, mixed(scaled + (ends - starts).astype(np.uint64) * fixed["word"])


def cut_points(data: bytes) -> Iterator[bytes]:
    """Parts of a long text, cut at white space."""
    at = 0
    while len(data) - at > BLOCK:
        end = at + BLOCK
        while end < len(data) and data[end] not in b"\t\n\v\f\r ":
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def sets_of(texts: list[str], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    fixed = numbers()
    held: list[bytes] = []
    length = 0

    def flush() -> Iterator[np.ndarray]:
        bounds = np.cumsum([0] + [len(b) + 1 for b in held])
        starts, hashes = word_hashes(b" ".join(held))
        cuts = np.searchsorted(starts, bounds)
        for a, b in zip(cuts, cuts[1:]):  # noqa: B905
            yield shingled(hashes[a:b])

    def shingled(w: np.ndarray) -> np.ndarray:
        if not len(w):
            return w
        n = min(size, len(w))
        total = np.full(len(w) - n + 1, n, dtype=np.uint64) * fixed["word"]
        for k in range(n):
            total += w[k : k + len(total)] * fixed["shingle"][k]
        found = np.sort(mixed(total))
        return found[np.concatenate(([True], found[1:] != found[:-1]))]

    for text in texts:
        data = text.encode("utf-8", "surrogatepass").lower()
        if len(data) > BLOCK:
            yield from flush() if held else ()
            held, length = [], 0
            yield shingled(np.concatenate([word_hashes(part)[1] for part in cut_points(data)]))
            continue
        if length + len(data) > BLOCK:
            yield from flush()
            held, length = [], 0
        held.append(data)
        length += len(data) + 1
    if held:
        yield from flush()


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each bin of a sorted set; empty bins take another bin's."""
    fixed = numbers()
    at = np.concatenate(([0], np.searchsorted(hashes, fixed["edges"]), [len(hashes)]))
    filled = at[1:] > at[:-1]
    values = hashes[np.minimum(at[:-1], len(hashes) - 1)]
    if not filled.all():
        empty = np.flatnonzero(~filled)
        donors = fixed["donors"][empty]
        values[empty] = values[donors[np.arange(len(empty)), filled[donors].argmax(axis=1)]]
    return values


def parities(hashes: np.ndarray) -> np.ndarray:
    """MARK_BITS bits of a set, as 64-bit integers."""
    odd = np.bincount((hashes % np.uint64(MARK_BITS)).astype(np.int64), minlength=MARK_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    mixed_rows = mixed(signatures).reshape(len(signatures), BANDS, ROWS) * numbers()["band"]
    return mixed(mixed_rows.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * numbers()["word"]).view(np.int64)


def sketch(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            counts, prints, signatures, marks = [], [], [], []
            for found in sets_of(batch.column("text").to_pylist(), size):
                counts.append(len(found))
                prints.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                if len(found):
                    signatures.append(signature(found))
                marks.append(parities(found))
            keys = band_keys(np.stack(signatures)) if signatures else np.zeros((0, BANDS), dtype=np.int64)
            offsets = np.cumsum([0] + [BANDS if n else 0 for n in counts]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(marks) + 1, dtype=np.int32) * (MARK_BITS // 64)), pa.array(np.concatenate(marks)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), bands, bits], names=["doc_id", "text_hash", "n_shingles", "print", "bands", "marks"])

    return run


def compare(size: int, percent: int):
    """Confirms pairs on full sets.  Rows come in order of b, so the set of a hub is mostly made once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, other = None, None
        for batch in small(batches, 128):
            linked = []
            for own, hub_text in zip(sets_of(batch.column("a_text").to_pylist(), size), batch.column("b_text").to_pylist(), strict=True):
                if hub_text != text:
                    text, (other,) = hub_text, sets_of([hub_text], size)
                at = np.searchsorted(other, own)
                both = int((other[np.minimum(at, len(other) - 1)] == own).sum())
                linked.append(100 * both >= percent * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


def may_link(percent: int, n: str, other_n: str) -> Column:
    """Whether sets of these sizes can be linked at all: the smaller one at most is shared."""
    return (100 + percent) * F.least(n, other_n) >= percent * (F.col(n) + F.col(other_n))


def within_marks(percent: int) -> Column:
    """Whether the parity bitmaps leave enough shingles to share: (n + hub_n - differing bits) / 2 at most."""
    differ = reduce(add, [F.bit_count(F.col("marks")[k].bitwiseXOR(F.col("hub_marks")[k])) for k in range(MARK_BITS // 64)])
    both = F.col("n") + F.col("hub_n")
    return (100 + percent) * (both - differ) >= 2 * percent * both


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links on full sets."""
    of = lambda side: texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"{side}_text"))
    both = pairs.distinct().join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_text", "b_text")
    return store(both.mapInArrow(compare(size, percent), "a long, b long, linked boolean"), "near-links").where("linked").select("a", "b")


def open_classes(members: DataFrame, known: DataFrame) -> DataFrame:
    """rep, n, of, outside: classes of the buckets whose classes, but for the hub that has met them all, are of two or more
    components; outside: whether a class is, in one of them, not of the main component (the least that has links, or the
    least).  Of two classes of one bucket and different components one at least is."""
    whole = known.unionByName(known.select(F.col("component").alias("node"), "component")).distinct()
    rest = members.where(F.col("rep") != F.col("hub")).join(whole, F.col("rep") == F.col("node"), "left")
    rest = rest.select("key", "rep", "n", F.coalesce("component", "rep").alias("of"), F.col("node").isNull().alias("single"))
    found = rest.groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high"), F.min(F.struct("single", "of"))["of"].alias("main"))
    rows = rest.join(found.where(F.col("low") < F.col("high")).select("key", "main"), "key")
    return rows.groupBy("rep").agg(F.first("n").alias("n"), F.first("of").alias("of"), F.bool_or(F.col("of") != F.col("main")).alias("outside"))


def class_sets(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 64):
            sets = [x.view(np.int64) for x in sets_of(batch.column("text").to_pylist(), size)]
            offsets = np.cumsum([0] + [len(x) for x in sets]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["rep", "shingles"])

    return run


def prefixes(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """rep, shingle: the shingles of each text's prefix that another text holds too."""
    each = texts.mapInArrow(class_sets(size), "rep long, shingles array<long>").select("rep", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    each = store(each, "near-shingles")
    held = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).where(F.col("holders") > 1)
    shared = each.join(held, "shingle").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("holders", "shingle"))).alias("some"))  # of one text
    # n - ceil(n * percent / 100) + 1 of all, less those that no other text holds, which come first
    take = F.size("some") - F.floor((F.col("n") * percent + 99) / 100).cast("int") + 1
    return shared.where(take > 0).select("rep", F.explode(F.slice("some", F.lit(1), take)).alias("x")).select("rep", "x.shingle")


def resolve(members: DataFrame, marks: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """node, component of the classes that are linked, from members(key, rep, n, hub, hub_n) of buckets, marks(rep,
    marks) and texts(doc_id, text)."""
    pairs = members.where((F.col("rep") != F.col("hub")) & may_link(percent, "n", "hub_n")).select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    known = components(confirmed(pairs, texts, size, percent), "near-components")
    left = store(open_classes(members, known).join(marks, "rep"), "near-open")
    more = confirmed(meetings(left, texts, size, percent), texts, size, percent)
    if more.isEmpty():
        return known
    # stars that are known stand for the links before
    return components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "near-components")


def meetings(left: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: pairs of left(rep, n, of, outside, marks) of different components that share a shingle of their prefixes and
    may reach the threshold by their sizes and bitmaps."""
    found = prefixes(texts.join(left.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), size, percent)
    found = store(found.join(left, "rep"), "near-prefixes")
    others = found.where("outside").select("shingle", *[F.col(c).alias(f"hub_{c}") for c in ("rep", "n", "of", "marks")])
    met = found.join(others, "shingle").where((F.col("of") != F.col("hub_of")) & may_link(percent, "n", "hub_n") & within_marks(percent))
    return met.select(F.greatest("rep", "hub_rep").alias("a"), F.least("rep", "hub_rep").alias("b"))


def near_rows(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, first_hash of every row of docs(doc_id, text): the class of
    near-duplicates by its least doc_id, and the hash of that row's text.

    A class of equal sets is numbered by its place in the order of its least doc_id, so that one doc_id with several
    texts is no tie.
    """
    rows = own_names(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    sketches = store(rows.mapInArrow(sketch(size), SKETCH), "near-sketches")
    usable = sketches.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    firsts = [F.first(c).alias(c) for c in ("bands", "marks")]
    classes = usable.groupBy("print").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"), F.first("n_shingles").alias("n"), *firsts)
    # numbers follow the range partitions, so their order is that of doc_id
    ordered = classes.select("print", "n", "at.doc_id", "at.text_hash", "bands", "marks").orderBy("doc_id", "text_hash", "print")
    classes = store(ordered.withColumn("rep", F.monotonically_increasing_id()), "near-classes")
    places = classes.select("rep", "n", F.explode(F.array_distinct("bands")).alias("key"))
    shared = places.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.max("rep").alias("high")).where(F.col("hub.rep") < F.col("high"))
    members = store(places.join(shared.select("key", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")), "key"), "near-members")
    wanted = classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "doc_id", "text_hash")
    texts = rows.join(wanted, ["doc_id", "text_hash"]).select(F.col("rep").alias("doc_id"), "text")
    texts = store(texts.groupBy("doc_id").agg(F.first("text").alias("text")), "near-texts")  # repeated rows have one text
    known = resolve(members, classes.select("rep", "marks"), texts, size, percent)
    heads = classes.select(F.col("rep").alias("head"), F.col("doc_id").alias("component_id"), F.col("text_hash").alias("first_hash"))
    named = classes.select("print", "rep").join(known, F.col("rep") == F.col("node"), "left").select("print", F.coalesce("component", "rep").alias("head"))
    named = named.join(heads, "head").select("print", "component_id", "first_hash")
    out = sketches.select("doc_id", "text_hash", "n_shingles", "print").join(named, "print", "left")
    own = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", "text_hash", "n_shingles", F.when(own, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(own, F.col("first_hash")).otherwise(F.col("text_hash")).alias("first_hash"))


def near_classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text).

    Words are lower-cased in A-Z; a text of fewer words than a shingle is one shingle; one without words (or null) is
    linked with nothing, nor is a row without doc_id.  component_id is the least doc_id reachable over links, a row's
    own included.  Of rows repeated with one doc_id, each gets the component of its own text.
    """
    return near_rows(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def near_dedup(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """near_classes with kept: one document of each component, the one that names it."""
    return near_classes(docs, size, percent).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with the columns of docs, whatever their names: the one that names it, and of rows
    repeated with that identifier and text the least by its columns.  A row without identifier stays, as does one
    without words, one of each text."""
    found = near_rows(docs, size, percent)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash"))
    keys = found.where(stays).select(id_key(F.col("doc_id")).alias("row_id"), F.col("text_hash").alias("row_hash")).distinct()
    rows = docs.select(boxed(docs)).select("row", id_key(F.col("row.doc_id").cast("long")).alias("row_id"), F.xxhash64(text_or_empty("row.text")).alias("row_hash"))
    return one_of_each(rows.join(keys, ["row_id", "row_hash"], "left_semi"), ["row_id", "row_hash"])
