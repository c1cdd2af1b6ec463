"""Token counts of whole texts; huge documents are encoded in overlapping chunks that are spliced.

The tokenizer first cuts a text into words by an expression that looks ahead but never back, so all cuts after a
place depend on the text from there on alone.  A place where two overlapping chunks both begin a word is therefore a
cut of the whole text if the left chunk is right there: it is, for every word but those its end can still change.
Tokens of the left chunk before that place and of the right one from it on are those of the whole text.  If chunks
share no such place, the overlap is doubled, and the left chunk is grown when the overlap reaches its start.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import own_names, text_or_empty

#: Characters of a chunk and of its overlap with the next.
CHUNK, OVERLAP = 1 << 15, 1 << 9
LIMIT = 512
#: Words at a chunk's end that its cut can have changed.
UNSURE = 3
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a .json (tokenizers) or .model (sentencepiece) file, once a process."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Piece:
    """Tokens of text[start:end], and where its words begin: {place: token}."""

    def __init__(self, tokenizer, text: str, start: int, end: int):
        code = tokenizer.encode(text[start:end], add_special_tokens=False)
        self.start, self.end, self.ids = start, end, code.ids
        self.begins: dict[int, int] = {}
        before: object = ()
        for i, (word, (at, _)) in enumerate(zip(code.word_ids, code.offsets, strict=True)):
            if word is None or word != before:
                self.begins.setdefault(start + at, i)
            before = word

    def sure(self) -> dict[int, int]:
        return dict(list(self.begins.items())[:-UNSURE])


def spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[int]]:
    """The token ids of the whole text, in parts."""
    left, skip = Piece(tokenizer, text, 0, min(chunk, len(text))), 0
    while left.end < len(text):
        width = overlap
        while True:
            begin = max(left.start, left.end - width)
            right = Piece(tokenizer, text, begin, min(len(text), begin + chunk + width))
            shared = [p for p in left.sure() if p in right.begins and left.begins[p] >= skip and p >= begin]
            if shared:
                break
            if begin == left.start:  # nothing to align on: the left chunk grows and is encoded again from its own start
                grown = Piece(tokenizer, text, left.start, min(len(text), left.end + 2 * chunk + width))
                left = grown
                if left.end == len(text):
                    break
            width *= 2
        if not shared:
            break
        place = shared[-1]
        yield left.ids[skip : left.begins[place]]
        left, skip = right, right.begins[place]
    yield left.ids[skip:]


def count_texts(tokenizer, texts: list[str]) -> list[int]:
    if not hasattr(tokenizer, "encode_batch_fast"):
        return [len(x) for x in tokenizer.encode(texts, num_threads=1)] if texts else []
    counts = [0] * len(texts)
    short = [i for i, t in enumerate(texts) if len(t) <= 2 * CHUNK]
    for a in range(0, len(short), 256):
        part = short[a : a + 256]
        for i, code in zip(part, tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
            counts[i] = len(code)
    for i, t in enumerate(texts):
        if len(t) > 2 * CHUNK:
            counts[i] = sum(map(len, spliced(tokenizer, t)))
    return counts


def small(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: few texts are Python strings at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def count_batches(path: str, limit: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in small(batches):
            texts = batch.column("text").to_pylist()
            counts = count_texts(tokenizer, texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs(doc_id, text), as the library of the vocabulary file
    counts them: without added tokens, truncation or padding; special strings inside a text as the library's default.
    A null text is empty (0 tokens).  Files for sentencepiece have no words to align on and are encoded whole.
    """
    text = text_or_empty()
    rows = own_names(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count_batches(path, limit), SCHEMA)
