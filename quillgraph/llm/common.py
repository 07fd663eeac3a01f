"""Columns and Arrow helpers that several operators of this subpackage share."""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spaces of the contracts: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the JVM's byte loop, the others a character map."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def hash128(value: Column) -> list[Column]:
    """Two 64-bit hashes with unrelated seeds, so that a collision needs both to agree."""
    return [F.xxhash64(value), F.xxhash64(F.lit(7919), value)]


def words_by_space(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8. bytes.split() and bytes.lower() know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split()


_ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_alnum(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased: ASCII letters and digits and all beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split()


def hash_words(words: list[bytes]) -> np.ndarray:
    """One 64-bit hash for each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` words, dependent on their order; empty if there are fewer words."""
    count = len(word_hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.full(count, np.uint64(n), np.uint64)
    for i in range(n):
        out = mix64(out * _STEP + word_hashes[i : i + count])
    return out


def texts_of(column: pa.ChunkedArray | pa.Array):
    """The column's values one by one, without a copy of the whole batch as Python strings."""
    for value in column:
        yield value.as_py()


@dataclass
class Tokens:
    """The words of a slice of documents in order: a 64-bit hash of each, the place of its document, its first eight bytes and its length."""

    hashes: np.ndarray
    docs: np.ndarray
    heads: np.ndarray
    lengths: np.ndarray

    def starts(self, size: int) -> np.ndarray:
        """A hash of the first ``size`` bytes of each word, unlike that of any word."""
        return mix64(mix64(self.heads & _LOW_BYTES[size]) + np.uint64(size))


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each run of bytes and of its length, eight bytes at a time; its first eight; its length. Seven more bytes follow the last run."""
    eights = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    left = lengths = ends - starts
    heads = eights[starts] & _LOW_BYTES[np.minimum(left, 8)]
    out = mix64(left.astype(np.uint64) * _STEP + heads)
    long = np.flatnonzero(left > 8)
    at, left = starts[long], left[long]
    while len(long):
        at, left = at + 8, left - 8
        out[long] = mix64(out[long] * _STEP + (eights[at] & _LOW_BYTES[np.minimum(left, 8)]))
        more = left > 8
        long, at, left = long[more], at[more], left[more]
    return out, heads, lengths


def tokens_of(batch: pa.RecordBatch, column: str, slice_bytes: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    """The words (as of ``words_alnum``) of slices of the batch with about ``slice_bytes`` of text, or one longer text, read at once."""
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + slice_bytes, "right")) - 1)
        low, high = int(offsets[begin]), int(offsets[end])
        text = bytes(memoryview(texts.buffers()[2])[low:high]) if high > low else b""
        # a space before and eight behind: each word has two edges, and eight bytes can be read from each
        raw = np.frombuffer(b" " + text.translate(_ALNUM) + b" " * 8, np.uint8)
        inside = raw != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        # a word ends where its document does
        cuts = offsets[begin + 1 : end] - low + 1
        cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]])
        if len(cuts):
            edges = np.sort(np.concatenate([edges, cuts, cuts]))
        first, last = edges[::2], edges[1::2]
        docs = np.searchsorted(offsets[begin : end + 1] - low + 1, first, "right") - 1
        hashes, heads, lengths = _run_hashes(raw, first, last)
        yield batch.slice(begin, end - begin), Tokens(hashes, docs, heads, lengths)
        begin = end
