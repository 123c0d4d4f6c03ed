"""Benchmark decontamination by suffix arrays of the training text.

Training text is cut into shards of whole documents (about 1 MB each). Each shard's word suffixes are sorted into a suffix
array, by blocks of four 16-bit word codes, as deep as the shortest match that counts. Every suffix of every benchmark
item is then binary-searched in every shard; all training suffixes in the range found are extended word by word on
64-bit word hashes to the longest verbatim match (verbatim up to case and punctuation). There is no shuffle but the one
that keeps the longest match of each document and item.

The benchmark travels to the executors in slices of at most SLICE_WORDS words (or one item). Each slice is a pass of its own over the
training text, so the size of a benchmark is bounded by time and not by memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import write
from ._words import Words, column, map_chunks, split_words

#: A match counts from this many words on; an item with fewer words counts if all of it matches.
MIN_WORDS = 13
#: Documents aren't removed for items with fewer words than this, which ordinary prose is full of; matches() reports these items too.
LEAST_ITEM = 4
SLICE_WORDS = 2_000_000
_BLOCK = 4
#: Pairs of a training and a test suffix that are looked at at once.
_PAIRS = 1 << 20


@dataclass
class Tests:
    """A slice of benchmark items: word hashes of all, the item of each word, and the id of each item."""

    hash: np.ndarray
    item: np.ndarray
    first: np.ndarray
    ids: np.ndarray

    def starts(self, min_words: int, least_item: int) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes of items with least_item words or more that can match, and how many words of each have to."""
        size = np.diff(self.first)
        need = np.minimum(size, min_words)[self.item]
        left = self.first[self.item + 1] - np.arange(len(self.item))
        at = np.flatnonzero((left >= need) & (size[self.item] >= least_item))
        return at, need[at]

    def broadcast(self, spark: SparkSession):
        """The arrays alone: executors needn't have this package."""
        return spark.sparkContext.broadcast((self.hash, self.item, self.first, self.ids))


def read_tests(benchmark: DataFrame) -> Iterator[Tests]:
    """The benchmark, slice by slice: the driver holds one. Items with a null id or text, or without a word, are left out."""
    ids: list[int] = []
    texts: list[str] = []

    def slice_() -> Tests:
        w = split_words(pa.array(texts, pa.large_string()))
        return Tests(w.hash, w.doc, w.first, np.array(ids, dtype=np.int64))

    size = 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        words = row.text.count(" ") + 1
        if texts and size + words > SLICE_WORDS:
            yield slice_()
            ids, texts, size = [], [], 0
        size += words
        ids.append(row.item_id)
        texts.append(row.text)
    if texts:
        yield slice_()


def _codes(hashes: np.ndarray) -> np.ndarray:
    """Per position the 16-bit codes (never 0) of its word and the next three in one number; 0 beyond the end."""
    code = (hashes >> np.uint64(48)) | np.uint64(1)
    padded = np.concatenate([code, np.zeros(_BLOCK - 1, np.uint64)])
    n = len(code)
    return (padded[:n] << np.uint64(48)) | (padded[1 : n + 1] << np.uint64(32)) | (padded[2 : n + 2] << np.uint64(16)) | padded[3 : n + 3]


def _at(codes: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The block that begins at each position; 0 beyond the end."""
    inside = where < len(codes)
    return np.where(inside, codes[np.minimum(where, max(len(codes) - 1, 0))], 0) if len(codes) else np.zeros(len(where), np.uint64)


def suffix_array(codes: np.ndarray, blocks: int) -> np.ndarray:
    """Word positions in the order of their first `blocks` blocks of four words; only ties are sorted further."""
    order = np.argsort(codes, kind="stable")
    key = codes[order]
    tied = np.zeros(len(order), dtype=bool)
    same = key[1:] == key[:-1]
    for block in range(1, blocks):
        if not same.any():
            break
        tied[:] = False
        tied[1:] |= same
        tied[:-1] |= same
        where = np.flatnonzero(tied)
        group = np.cumsum(np.concatenate([[True], ~same]))[where]
        sub = order[where]
        nxt = _at(codes, sub + _BLOCK * block)
        by = np.lexsort((nxt, group))
        order[where] = sub[by]
        nxt = nxt[by]
        still = np.zeros(len(order) - 1, dtype=bool)
        pair = where[1:] == where[:-1] + 1
        equal = pair & (group[1:] == group[:-1]) & (nxt[1:] == nxt[:-1])
        still[where[:-1][equal]] = True
        same = still
    return order


def _bound(codes: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, depth: int, upper: bool) -> np.ndarray:
    """Binary search of all wanted blocks at once, each in its own range of the suffix array."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        got = _at(codes, order[np.minimum(mid, len(order) - 1)] + depth)
        below = (got <= wanted) if upper else (got < wanted)
        lo = np.where(open_ & below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)
    return lo


def _search(w: Words, tests: Tests, min_words: int, least_item: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All maximal matches: training word, test word, length in words."""
    none = np.zeros(0, dtype=np.int64)
    start, need = tests.starts(min_words, least_item)
    if not len(w.hash) or not len(start):
        return none, none, none
    codes, wanted = _codes(w.hash), _codes(tests.hash)
    order = suffix_array(codes, max(1, min_words // _BLOCK))
    key = codes[order]
    # the first block; of a shorter item only its words count, so all that may follow them is in the range
    rest = (np.uint64(1) << (np.uint64(16) * (_BLOCK - np.minimum(need, _BLOCK)).astype(np.uint64))) - np.uint64(1)
    first = _at(wanted, start)
    lo, hi = np.searchsorted(key, first & ~rest, "left"), np.searchsorted(key, first | rest, "right")
    for block in range(1, max(1, min_words // _BLOCK)):
        on = np.flatnonzero((need >= _BLOCK * (block + 1)) & (lo < hi))
        if not len(on):
            break
        block_wanted = _at(wanted, start[on] + _BLOCK * block)
        a, b = lo[on], hi[on]
        lo[on] = _bound(codes, order, a, b, block_wanted, _BLOCK * block, False)
        hi[on] = _bound(codes, order, a, b, block_wanted, _BLOCK * block, True)
    count = np.maximum(hi - lo, 0)
    some = np.flatnonzero(count)
    found = [(none, none, none)]
    while len(some):
        take = max(1, int(np.searchsorted(np.cumsum(count[some]), _PAIRS, "right")))
        found.append(_extended(w, tests, order, start, need, some[:take], lo, count))
        some = some[take:]
    return tuple(np.concatenate(x) for x in zip(*found))


def _extended(w: Words, tests: Tests, order: np.ndarray, start: np.ndarray, need: np.ndarray, some: np.ndarray, lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal matches of some of the test suffixes, each with all training suffixes of its range."""
    n = count[some]
    which = np.repeat(some, n)
    train = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[some], n)]
    test = start[which]
    # one match is found from all of its suffixes: keep those that no earlier word extends
    inner = (train > 0) & (test > 0)
    before = inner & (w.hash[train - 1] == tests.hash[test - 1]) & (w.doc[train - 1] == w.doc[train]) & (tests.item[test - 1] == tests.item[test])
    which, train, test = which[~before], train[~before], test[~before]
    room = np.minimum(w.first[w.doc[train] + 1] - train, tests.first[tests.item[test] + 1] - test)
    length = np.zeros(len(train), dtype=np.int64)
    live = np.arange(len(train))
    while len(live):
        live = live[length[live] < room[live]]
        live = live[w.hash[train[live] + length[live]] == tests.hash[test[live] + length[live]]]
        length[live] += 1
    good = length >= need[which]
    return train[good], test[good], length[good]


def matches(docs: DataFrame, benchmark: DataFrame, *, min_words: int = MIN_WORDS, least_item: int = 1) -> DataFrame:
    """The longest verbatim match of each document and item: (doc_id, item_id, words, item_word, doc_word, passage).

    item_word and doc_word count words from 0; of equally long matches the first in the item, then in the document. Words
    are compared in lower case without punctuation. Items of fewer than min_words words have to match as a whole; those of fewer than
    least_item are left out. Null and empty texts match nothing; a row with a null doc_id is reported with a
    null doc_id, repeated rows and repeated ids as one. Only doc_id, text and item_id, text are read. An empty
    table on either side gives no rows.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, words long, item_word long, doc_word long, passage string"
    found = spark.createDataFrame([], schema)
    for slice_ in read_tests(benchmark):
        shared = slice_.broadcast(spark)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch | None:
            tests, w = Tests(*shared.value), split_words(column(batch, "text"))
            train, test, length = _search(w, tests, min_words, least_item)
            if not len(train):
                return None
            doc, item = w.doc[train], tests.item[test]
            by = np.lexsort((train, test, -length, item, doc))
            by = by[np.concatenate([[True], (doc[by][1:] != doc[by][:-1]) | (item[by][1:] != item[by][:-1])])]
            train, test, length, doc, item = train[by], test[by], length[by], doc[by], item[by]
            ids = column(batch, "doc_id").cast(pa.int64()).take(pa.array(doc))
            arrays = [ids, pa.array(tests.ids[item]), pa.array(length), pa.array(test - tests.first[item]), pa.array(train - w.first[doc]), pa.array([w.text(a, a + n) for a, n in zip(train, length)], pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "words", "item_word", "doc_word", "passage"])

        found = found.unionAll(map_chunks(docs.select("doc_id", "text"), "text", run, schema))
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("words")).alias("less"), "item_word", "doc_word", "passage")).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.less")).alias("words"), "m.item_word", "m.doc_word", "m.passage")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, min_words: int = MIN_WORDS, least_item: int = LEAST_ITEM) -> DataFrame:
    """The rows of docs without a match, with all their columns whatever they are called. One pass without a shuffle for each slice.

    Rows with a null or empty text stay, rows with a null doc_id are judged by their text. An empty benchmark removes nothing. Items of
    fewer than least_item words remove nothing either: matches() tells where they are.
    """
    clean = docs
    for slice_ in read_tests(benchmark):
        if clean is not docs:  # what another slice left is written, so that no task holds two
            clean = write(clean)
        shared = slice_.broadcast(docs.sparkSession)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            w = split_words(column(batch, "text"))
            good = np.ones(w.n, dtype=bool)
            good[w.doc[_search(w, Tests(*shared.value), min_words, least_item)[0]]] = False
            return batch.filter(pa.array(good))

        clean = map_chunks(clean, "text", run, docs.schema)
    return clean


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op1_decontamination": op1_decontamination}
ORACLE_SQL: dict[str, str] = {}
