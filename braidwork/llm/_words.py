"""Vectorised word kernels over Arrow string columns.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased text; everything
else separates words. Python never sees a single document: a chunk of texts is one byte buffer, and numpy finds the
word boundaries and hashes of the whole chunk at once. No text is cut short, however long it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CHUNK_BYTES = 1_000_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

_WORD = np.zeros(256, dtype=bool)
_WORD[128:] = True
_WORD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", dtype=np.uint8)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words with good avalanche."""
    x = x.astype(np.uint64, copy=True)
    x += GOLDEN
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """The words of a chunk of n documents. doc is the document of each word; first[d]:first[d + 1] are d's words."""

    n: int
    buffer: np.ndarray
    doc_start: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def text(self, word: int, stop: int | None = None) -> str:
        """From the beginning of one word to the end of another (exclusive index), as it stands in the lower-cased text."""
        last = word if stop is None else stop - 1
        return self.buffer[self.start[word] : self.end[last]].tobytes().decode("utf-8", "replace")


def _load8(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position, little-endian. padded has at least eight bytes after the last position."""
    view = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    return view[at].astype(np.uint64, copy=False)


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def hash_spans(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    padded = np.concatenate([buffer, np.zeros(8, dtype=np.uint8)])
    size = end - start
    out = mix(_load8(padded, start) & _MASK[np.minimum(size, 8)]) ^ mix(size.astype(np.uint64))
    rest = np.flatnonzero(size > 8)
    at = 8
    while len(rest):
        step = _load8(padded, start[rest] + at) & _MASK[np.minimum(size[rest] - at, 8)]
        out[rest] = mix(out[rest] * np.uint64(0x100000001B3) + step)
        at += 8
        rest = rest[size[rest] > at]
    return out


def hash_word(word: str) -> int:
    raw = np.frombuffer(word.encode("utf-8"), dtype=np.uint8)
    return int(hash_spans(raw, np.array([0]), np.array([len(raw)]))[0])


def split_words(texts: pa.Array, lower: bool = True) -> Words:
    """The words of an Arrow string array; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    n = len(texts)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(0, np.zeros(0, np.uint8), np.zeros(1, np.int64), none, none, none, np.zeros(1, np.int64), np.zeros(0, np.uint64))
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    buffer = raw[offsets[0] : offsets[-1]]
    doc_start = offsets - offsets[0]
    inside = _WORD[buffer]
    edge = np.zeros(len(buffer) + 1, dtype=bool)
    edge[doc_start] = True
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    begins = inside & (~before | edge[:-1])
    start = np.flatnonzero(begins)
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, doc_start)
    doc = np.repeat(np.arange(n), np.diff(first))
    return Words(n, buffer, doc_start, start, end, doc, first, hash_spans(buffer, start, end))


def gram_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first words of all runs of k words within one document, and the hashes of the runs."""
    total = len(words.hash)
    if total < k:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    acc = np.zeros(total - k + 1, dtype=np.uint64)
    for j in range(k):
        acc = acc * np.uint64(0x9E3779B185EBCA87) + words.hash[j : total - k + 1 + j]
    at = np.flatnonzero(words.doc[: total - k + 1] == words.doc[k - 1 :])
    return at, mix(acc[at])


def chunks(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about CHUNK_BYTES of text each, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    total = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        limit = (total[begin - 1] if begin else 0) + CHUNK_BYTES
        stop = max(begin + 1, int(np.searchsorted(total, limit, side="right")))
        yield batch.slice(begin, stop - begin)
        begin = stop


def release_memory() -> None:
    """Give memory that isn't used back to the system: workers are kept, and what one task held is not the next one's."""
    pa.default_memory_pool().release_unused()


def map_chunks(df: DataFrame, text: str, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """mapInArrow over slices of bounded size; function turns a slice into rows of the schema, or into None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                made = function(part)
                if made is not None and made.num_rows:
                    yield made
                made = None
            release_memory()

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
