"""Packing documents into token sequences by bin completion.

Documents become token ids and an end id, cut only if longer than a sequence.  Groups of pieces, dealt by hash, are
packed by themselves: around the largest piece left, undominated fillings are enumerated one after the other by least
waste, as many as the search asks for; branches whose waste already costs the sequences that the incumbent saves are
pruned; the incumbent at the start is best-fit decreasing, and a packing that meets the bound of the sums is proven and
taken at once.  Otherwise passes allow 0, 1, 2, 4, ... departures from the least waste, until a pass leaves nothing out
(a proof) or SEARCH fillings have been tried.  What lies in badly filled sequences of a group is packed again with
that of other groups.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import own_names, store, text_or_empty
from cairn.llm.tokens import load, small, spliced

CAPACITY = 2048
END_ID = 0
#: Pieces that are packed together at once, and groups whose badly filled sequences are packed again together.
GROUP, REPACK = 4096, 32
#: A sequence with this many places left is repacked.
LOOSE = 32
#: Fillings tried in the search of a group, besides those of its first dive.
SEARCH = 300
#: Characters above which a text is encoded in chunks.
LONG = 1 << 18
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
ID_BITS = 32


class Stock:
    """Pieces left, as counts by length; the bits of `mask` are the lengths there are."""

    def __init__(self, lengths: Iterable[int]):
        self.counts: dict[int, int] = {}
        self.mask = self.items = 0
        for n in lengths:
            self.add(n)

    def add(self, n: int) -> None:
        self.counts[n] = self.counts.get(n, 0) + 1
        self.mask |= 1 << n
        self.items += 1

    def take(self, n: int) -> None:
        self.counts[n] -= 1
        self.items -= 1
        if not self.counts[n]:
            self.mask &= ~(1 << n)

    def largest(self, most: int) -> int:
        """The greatest length there is up to `most`; -1 if none."""
        return (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1 if most >= 0 else -1


def dominated(stock: Stock, have: tuple[int, ...], waste: int) -> bool:
    """Whether another filling does at least as well whatever follows: one that holds, in place of some pieces of this
    one (or of none), a single piece of the stock that is at least their sum and at most that plus the waste."""
    left = stock.mask
    for n in set(have):
        if stock.counts[n] == have.count(n):
            left &= ~(1 << n)
    one = more = 0  # sums of one piece, and of several
    for n in have:
        more |= (more << n) | (one << n)
        one |= 1 << n
    above, reach = 0, 1  # bit a of `above`: a piece of a + 1 to a + waste is left
    if waste:
        above = left >> 1
        while reach < waste:
            step = min(reach, waste - reach)
            above |= above >> step
            reach += step
    return bool(above & (one | more | 1) or left & more)


def fillings(stock: Stock, room: int, most_waste: int) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of the room that waste no more, least waste first, and among those without waste a single
    piece (which dominates all others) or pairs first.  Bits of reach[i] are the sums that the lengths from the i-th on
    can make, so no branch is entered that leads nowhere; they are made only if pairs do not do."""
    if room and stock.mask >> room & 1:
        yield (room,)
        return
    n = stock.largest(room)
    while 2 * n >= room > 0:
        if stock.mask >> (room - n) & 1 and (2 * n != room or stock.counts[n] > 1):
            yield (n, room - n)
        n = stock.largest(n - 1)
    lengths = []
    n = stock.largest(room)
    while n > 0:
        lengths.append((n, min(stock.counts[n], room // n)))
        n = stock.largest(n - 1)
    inside = (1 << (room + 1)) - 1
    reach = [1] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        n, count = lengths[i]
        sums, block = reach[i + 1], 1
        while count > 0:  # shifts by 1, 2, 4, ... pieces
            part = min(block, count)
            sums |= (sums << (n * part)) & inside
            count -= part
            block *= 2
        reach[i] = sums

    def exact(i: int, space: int) -> Iterator[tuple[int, ...]]:
        while space and i < len(lengths):
            n, count = lengths[i]
            i += 1
            for k in range(min(count, space // n), 0, -1):
                if reach[i] >> (space - k * n) & 1:
                    for rest in exact(i, space - k * n):
                        yield (n,) * k + rest
            if not reach[i] >> space & 1:
                return
        if not space:
            yield ()

    for waste in range(min(room, most_waste) + 1):
        if reach[0] >> (room - waste) & 1:
            for have in exact(0, room - waste):
                if (waste or len(have) > 2 or not room) and not dominated(stock, have, waste):
                    yield have


def best_fit(lengths: Iterable[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece into the fullest bin that still takes it."""
    rooms: dict[int, list[list[int]]] = {}
    mask, bins = 0, []
    for n in sorted(lengths, reverse=True):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            bin_ = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, bin_ = capacity, []
            bins.append(bin_)
        bin_.append(n)
        rooms.setdefault(room - n, []).append(bin_)
        mask |= 1 << (room - n)
    return bins


def complete(lengths: list[int], capacity: int, search: int = SEARCH) -> list[list[int]]:
    """Bins of lengths, as few as the search proves or finds."""
    incumbent = best_fit(lengths, capacity)
    bound = -(-sum(lengths) // capacity)
    departures, tried = 0, 0
    while len(incumbent) > bound:
        spare = (len(incumbent) - 1) * capacity - sum(lengths)  # waste that a better packing may have
        found, whole, tried = descend(Stock(lengths), capacity, spare, departures, tried, search)
        if found:
            incumbent = found
        elif whole or tried > search:
            break
        else:
            departures = max(1, 2 * departures)
    return incumbent


def descend(stock: Stock, capacity: int, spare: int, departures: int, tried: int, search: int) -> tuple[list[list[int]] | None, bool, int]:
    """(a packing that wastes no more than spare, or None; whether nothing was left out; fillings tried).  The k-th
    filling around a piece is k departures; the first dive is not counted among the fillings tried."""
    path: list[list] = []  # [largest, its fillings, the one in use, its number]
    waste = used = 0
    whole = True
    while stock.items:
        top = stock.largest(capacity)
        stock.take(top)
        path.append([top, fillings(stock, capacity - top, spare - waste), None, -1])
        while path:
            level = path[-1]
            top, ways, filling, number = level
            if filling is not None:
                for n in filling:
                    stock.add(n)
                waste -= capacity - top - sum(filling)
                used -= number
            number += 1
            tried += departures > 0
            if used + number > departures or tried > search:
                filling, whole = None, False
            else:
                filling = next(ways, None)
            if filling is not None:
                for n in filling:
                    stock.take(n)
                waste += capacity - top - sum(filling)
                used += number
                level[2:] = filling, number
                break
            stock.add(top)
            path.pop()
        if not path:
            return None, whole, tried
    return [[top, *filling] for top, _, filling, _ in path], True, tried


@lru_cache(maxsize=2)
def encoder(path: str):
    """Ids of texts by the vocabulary file, as tokenizers gives them.  Where tiktoken is installed and the file's merges
    are in the order of their ids, its byte-pair engine with the file's own vocabulary gives the same ids several
    times faster.  Texts with an added token's string, huge ones, and files of other kinds go through tokenizers."""
    try:
        import tiktoken
    except ModuleNotFoundError:
        tiktoken = None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    added = [t["content"] for t in spec.get("added_tokens", [])]
    vocab = {k: v for k, v in model["vocab"].items() if k not in added}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec.get("normalizer") and not model.get("ignore_merges")
    ordered = plain and len(vocab) == 256 + len(merges) and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
    fast = None
    if ordered and tiktoken:
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items()}
        words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("from-file", pat_str=words, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        if len(text) > LONG:
            return [i for part in spliced(load(path), text) for i in part]
        if fast and not any(a in text for a in added):
            return fast(text)
        return load(path).encode(text, add_special_tokens=False).ids

    return encode


def pieces_of(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length): whole sequences at the end, and before them what is left over, if anything."""
    first = len(ids) % capacity or min(capacity, len(ids))
    yield 0, first
    for start in range(first, len(ids), capacity):
        yield start, capacity


def to_pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in small(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text), end_id], dtype="<u4")
                rows += [(doc, i, start, n, zlib.crc32(ids[start : start + n].tobytes())) for i, (start, n) in enumerate(pieces_of(ids, capacity))]
            yield arrow(rows, PIECES)

    return run


def arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if k == "int" else pa.int64()) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def assign(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of places in `lengths`.  Pieces that fill a sequence have one each."""
    full = [[i] for i, n in enumerate(lengths) if n == capacity]
    by_length: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        if n < capacity:
            by_length.setdefault(n, []).append(i)
    return full + [[by_length[n].pop() for n in bin_] for bin_ in complete([n for n in lengths if n < capacity], capacity)]


def pack_groups(capacity: int, level: int, loose: int | None):
    """Packs every GROUP rows of a partition.  With `loose`, sequences with so much room get no number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (2 * TaskContext.get().partitionId() + level) << ID_BITS
        held: list[tuple] = []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            rows.sort(key=lambda r: (r[3], r[4], r[0] is not None, r[0] or 0, r[1]))  # the same whatever order they came in
            out = []
            for bin_ in assign([r[3] for r in rows], capacity):
                room = capacity - sum(rows[i][3] for i in bin_)
                at, sequence = 0, number if loose is None or room < loose else None
                number += sequence is not None
                for i in bin_:
                    out.append((*rows[i][:5], sequence, at))
                    at += rows[i][3]
            return arrow(out, PACKED)

        for batch in batches:
            held += zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            while len(held) >= GROUP:
                yield flush(held[:GROUP])
                held = held[GROUP:]
        yield flush(held)

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of docs(doc_id, text) and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty: its document is the end id alone.  Repeated rows are packed each.  An empty table gives no
    row.  Tokenizing runs once; what is shuffled are pieces without their ids, sorted within a partition, so reruns
    pack alike.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = own_names(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    pieces = rows.mapInArrow(to_pieces(path, capacity, end_id), PIECES)
    key = ["doc_id", "piece", "ids_crc32"]
    dealt = pieces.repartition(parts, *key).sortWithinPartitions(F.xxhash64(*key), *key)
    first = store(dealt.mapInArrow(pack_groups(capacity, 0, LOOSE), PACKED), "packing")
    again = first.where(F.col("sequence_id").isNull()).select(*[f.split()[0] for f in PIECES.split(", ")])
    again = again.repartition(-(-parts // REPACK), *key).sortWithinPartitions(F.xxhash64(*key), *key)
    return first.where(F.col("sequence_id").isNotNull()).unionByName(again.mapInArrow(pack_groups(capacity, 1, None), PACKED))
