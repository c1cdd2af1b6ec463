"""Exact deduplication by Patricia tries.

Every batch of rows first merges its equal texts in a trie.  Then length-and-hash partitions insert whole byte strings
into compressed radix tries whose terminal nodes hold the owner (the smallest or largest identifier) and the number of
rows.  A trie over its memory writes its heaviest subtree to a temporary file, as well as what later falls into it,
and works through that file by itself afterwards.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import boxed, id_key, one_of_each, own_names, text_or_empty
from cairn.llm.tokens import small

#: Bytes of text that a trie holds in memory.
TRIE_BYTES = 96 << 20
#: Rows whose texts are Python objects at a time.
ROWS = 2000
#: Bytes counted for a node besides its edge.
NODE_BYTES = 300
MERGED = "n_bytes long, digest binary, body binary, owner long, n long"
OWNERS = "n_bytes long, digest binary, keep_id long, group_size long"
DIGESTS = "n_bytes long, digest binary"


def common_length(a: bytes, b: bytes, at: int) -> int:
    """How many bytes of a agree with b from b's place `at` on."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Node:
    __slots__ = ("children", "edge", "held", "spilled")

    def __init__(self, edge: bytes, held: list | None = None):
        self.edge, self.held, self.children, self.spilled = edge, held, {}, None


class Trie:
    """A compressed radix trie from byte strings to [owner, rows, tag]."""

    def __init__(self, largest: bool, limit: int = TRIE_BYTES, folder: str | None = None):
        self.root, self.largest, self.limit, self.folder, self.bytes = Node(b""), largest, limit, folder, 0
        self.files: list = []

    def better(self, a: int | None, b: int | None) -> int | None:
        if a is None or b is None:
            return b if a is None else a
        return max(a, b) if self.largest else min(a, b)

    def insert(self, key: bytes, owner: int | None, n: int, tag: bytes) -> None:
        node, at = self.root, 0
        while True:
            if node.spilled is not None:
                pickle.dump((key, owner, n, tag), node.spilled)
                return
            if at == len(key):
                if node.held is None:
                    node.held = [owner, n, tag]
                else:
                    node.held[0], node.held[1] = self.better(node.held[0], owner), node.held[1] + n
                return
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], [owner, n, tag])
                self.bytes += len(key) - at + NODE_BYTES
                break
            if not key.startswith(child.edge, at):
                same = common_length(child.edge, key, at)
                upper = Node(child.edge[:same])
                child.edge = child.edge[same:]
                upper.children[child.edge[0]] = child
                node.children[upper.edge[0]] = upper
                self.bytes += NODE_BYTES
                child = upper
            node, at = child, at + len(child.edge)
        while self.bytes > self.limit and self.spill():
            pass

    def weigh(self, node: Node) -> int:
        total, rest = 0, [node]
        while rest:
            x = rest.pop()
            total += len(x.edge) + NODE_BYTES
            rest += x.children.values()
        return total

    def spill(self) -> bool:
        """Write out the heaviest subtree under the first branching; False if nothing there has branches."""
        node, prefix = self.root, b""
        while len(node.children) == 1 and node.held is None:
            (node,) = node.children.values()
            prefix += node.edge
        able = [x for x in node.children.values() if x.spilled is None and x.children]
        if not able:
            return False
        top = max(able, key=self.weigh)
        self.bytes -= self.weigh(top) - len(top.edge) - NODE_BYTES
        file = tempfile.TemporaryFile(dir=self.folder)
        for key, held in self.walk(top, prefix):
            pickle.dump((key, *held), file)
        top.children, top.held, top.spilled = {}, None, file
        self.files.append(file)
        return True

    @staticmethod
    def walk(node: Node, prefix: bytes) -> Iterator[tuple[bytes, list]]:
        rest = [(node, prefix)]
        while rest:
            x, before = rest.pop()
            key = before + x.edge
            if x.held is not None:
                yield key, x.held
            rest += [(c, key) for c in x.children.values()]

    def owners(self) -> Iterator[tuple[bytes, list]]:
        yield from self.walk(self.root, b"")
        self.root = Node(b"")
        for file in self.files:
            file.seek(0)
            part = Trie(self.largest, self.limit, self.folder)
            # a subtree can be as large as the trie that it came from: its own branches are spilled in turn
            while True:
                try:
                    part.insert(*pickle.load(file))
                except EOFError:
                    break
            file.close()
            yield from part.owners()


def folded_texts(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 with A-Z lower-cased (bytes of other characters are never in that range); null is empty."""
    column = (column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    low = bytes(memoryview(data)[at[0] : at[-1]]).lower() if data is not None and len(at) else b""
    at = (at - at[0]).tolist() if len(at) else [0]
    return [low[a:b] for a, b in zip(at, at[1:])]  # noqa: B905


def folded(batch: pa.RecordBatch) -> tuple[list[int | None], list[bytes]]:
    return batch.column("doc_id").to_pylist(), folded_texts(batch.column("text"))


def merge_batches(largest: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, ROWS):
            trie = Trie(largest)
            for owner, body in zip(*folded(batch), strict=True):
                trie.insert(body, owner, 1, b"")
            found = list(trie.owners())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([len(k) for k, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(k).digest() for k, _ in found], pa.binary()),
                    pa.array([k for k, _ in found], pa.binary()),
                    pa.array([h[0] for _, h in found], pa.int64()),
                    pa.array([h[1] for _, h in found], pa.int64()),
                ],
                names=["n_bytes", "digest", "body", "owner", "n"],
            )

    return run


def own_partition(largest: bool, limit: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            trie = Trie(largest, limit, folder)
            for batch in small(batches, ROWS):
                for tag, body, owner, n in zip(*(batch.column(c).to_pylist() for c in ("digest", "body", "owner", "n")), strict=True):
                    trie.insert(body, owner, n, tag)
            rows: list[tuple] = []
            for key, (owner, n, tag) in trie.owners():
                rows.append((len(key), tag, owner, n))
                if len(rows) == 10_000:
                    yield owner_batch(rows)
                    rows = []
            yield owner_batch(rows)

    return run


def owner_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
    columns = zip(*rows, strict=True) if rows else ([] for _ in kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["n_bytes", "digest", "keep_id", "group_size"])


def id_digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches, ROWS):
        ids, bodies = folded(batch)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(b) for b in bodies], pa.int64()), pa.array([hashlib.sha256(b).digest() for b in bodies], pa.binary())],
            names=["doc_id", "row_bytes", "row_digest"],
        )


def row_digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole rows with their length and digest."""
    for batch in small(batches, ROWS):
        bodies = folded_texts(batch.column("row").field("text"))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([len(b) for b in bodies], pa.int64()), pa.array([hashlib.sha256(b).digest() for b in bodies], pa.binary())],
            names=[*batch.schema.names, "row_bytes", "row_digest"],
        )


def text_owners(docs: DataFrame, keep: str = "smallest", limit: int = TRIE_BYTES) -> DataFrame:
    """A row for each different text of docs(doc_id, text): n_bytes, digest (SHA-256 of the folded text), keep_id,
    group_size.  Equal texts meet by length and hash, and are equal only if all their bytes are."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    rows = own_names(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    merged = rows.mapInArrow(merge_batches(keep == "largest"), MERGED)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return merged.repartition(parts, "n_bytes", "digest").mapInArrow(own_partition(keep == "largest", limit), OWNERS)


def exact_groups(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs(doc_id, text).

    Texts are equal when identical after lower-casing A-Z; a null text is empty.  Rows repeated with the identifier
    that stays all count as kept; a null identifier stays only if its group has no other.
    """
    rows = own_names(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    marked = rows.mapInArrow(id_digests, "doc_id long, row_bytes long, row_digest binary")
    out = marked.join(text_owners(docs, keep), (F.col("row_bytes") == F.col("n_bytes")) & (F.col("row_digest") == F.col("digest")))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("row_digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """Of the rows of docs(doc_id, text, ...) with equal texts, the one whose identifier exact_groups keeps, with the
    columns of docs, whatever their names.  If rows with that identifier and text are repeated, one of them stays: the
    least by its columns in their order."""
    rows = docs.select(boxed(docs))
    schema = T.StructType([rows.schema["row"], T.StructField("row_bytes", T.LongType()), T.StructField("row_digest", T.BinaryType())])
    marked = rows.mapInArrow(row_digests, schema).withColumn("row_id", id_key(F.col("row.doc_id").cast("long")))
    owners = text_owners(docs, keep).select(F.col("n_bytes").alias("row_bytes"), F.col("digest").alias("row_digest"), id_key(F.col("keep_id")).alias("row_id"))
    keys = ["row_bytes", "row_digest", "row_id"]  # the identifier is in the key: a large group of copies falls apart
    return one_of_each(marked.join(owners, keys, "left_semi"), keys)
