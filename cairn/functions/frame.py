"""The stored frame of encrypted contents in built-in functions: a nonce, then for each chunk its length (four bytes, little
end first) and its AES-256-GCM ciphertext with the tag.  A chunk's nonce is the frame's, its number XORed into it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of the nonce, of a chunk, of a length, of a tag and of a key.
NONCE, CHUNK, LENGTH, TAG, KEY = 12, 1 << 20, 4, 16, 32


def valid_key(text: Column) -> Column:
    """Whether a key is base64 of 32 bytes."""
    return F.coalesce(F.octet_length(F.try_to_binary(text, F.lit("base64"))) == KEY, F.lit(False))


def byte(n: Column) -> Column:
    return F.lpad(F.hex(n.cast("long")), 2, "0")


def little(n: Column, count: int) -> Column:
    """A number as `count` bytes, the low one first."""
    parts = [byte(F.shiftrightunsigned(n.cast("long"), 8 * j).bitwiseAND(F.lit(255).cast("long"))) for j in range(min(count, 8))]
    return F.unhex(F.concat(*parts, F.lit("00" * max(0, count - 8))))


def chunk_nonce(nonce: Column, number: Column) -> Column:
    """The nonce with the chunk's number, as twelve bytes with the low one first, XORed into it."""
    at = lambda b, j: F.conv(F.hex(F.substring(b, j + 1, 1)), 16, 10).cast("long")
    mark = lambda j: F.shiftrightunsigned(number.cast("long"), 8 * j).bitwiseAND(F.lit(255).cast("long")) if j < 8 else F.lit(0).cast("long")
    return F.unhex(F.concat(*[byte(at(nonce, j).bitwiseXOR(mark(j))) for j in range(NONCE)]))


def encrypted(content: Column, key: Column, nonce: Column, chunk: int = CHUNK) -> Column:
    """The frame of a content; an empty content is the nonce alone."""

    def framed(i: Column) -> Column:
        sealed = F.aes_encrypt(F.substr(content, (i * chunk + 1).cast("int"), F.lit(chunk)), key, F.lit("GCM"), F.lit("DEFAULT"), chunk_nonce(nonce, i))
        body = F.substr(sealed, F.lit(NONCE + 1))
        return F.concat(little(F.octet_length(body), LENGTH), body)

    chunks = F.ceil(F.octet_length(content) / chunk).cast("int")
    numbers = F.when(chunks > 0, F.sequence(F.lit(0), chunks - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(F.transform(numbers, framed), nonce, lambda acc, x: F.concat(acc, x))


def decrypted(frame: Column, key: Column, chunk: int = CHUNK) -> Column:
    """The chunks of a frame in the clear; all but the last have one size, so each one's place is known.  A damaged frame
    is an error."""
    step = chunk + LENGTH + TAG
    nonce, size = F.substring(frame, 1, NONCE), F.octet_length(frame) - NONCE

    def opened(i: Column) -> Column:
        start = NONCE + i * step + LENGTH + 1
        return F.aes_decrypt(F.concat(chunk_nonce(nonce, i), F.substr(frame, start.cast("int"), F.lit(chunk + TAG))), key, F.lit("GCM"))

    chunks = F.ceil(size / step).cast("int")
    return F.transform(F.when(chunks > 0, F.sequence(F.lit(0), chunks - 1)).otherwise(F.array().cast("array<int>")), opened)
