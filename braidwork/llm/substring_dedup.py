"""Passages that repeat across documents, by MinHash banding of paragraphs.

Passages are pasted into the middle of other text, so line breaks don't tell where a paragraph begins. A paragraph here is
WINDOW words that begin at an anchor: the word pair with the least hash among any STRIDE consecutive beginnings. Anchors depend
on the words alone, so two documents that share WINDOW + STRIDE - 1 (49) words in a row share a whole paragraph, wherever it stands.

Paragraphs are sets of word pairs. Band hashes of their MinHash values are joined; paragraphs of equal words are one
node, and all nodes of a bucket are compared with each other by the exact Jaccard similarity of their sets. Components of the
nodes are the repeated passages: the document with the least id keeps its copies, the others' are removals, merged to
spans of words and grown on both sides while the words agree with a kept copy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._graph import components
from ._names import unused
from ._pairs import map_groups
from ._store import Table, scratch, write
from ._words import Words, column, map_chunks, mix, split_words
from .near_dedup import BROADCAST_ROWS, among

WINDOW = 26
STRIDE = 24
THRESHOLD = 0.8
#: Share of the paragraph pairs at the threshold that should collide in some band.
RECALL = 0.9
MAX_HASHES = 12
_B = 0x9E3779B185EBCA87


def tune(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most so many hashes that reaches the recall at the threshold; else the surest."""
    all_ = [(b, r) for r in range(1, hashes + 1) for b in range(1, hashes // r + 1)]
    sure = [(b, r) for b, r in all_ if 1 - (1 - threshold**r) ** b >= recall]
    return min(sure, key=lambda x: (-x[1], x[0])) if sure else max(all_, key=lambda x: 1 - (1 - threshold ** x[1]) ** x[0])


BANDS, ROWS = tune()
#: Buckets of more members are compared in parts of about so many; up to FEW members are compared pair by pair.
BLOCK, FEW = 4096, 64
#: A bucket of about this many band rows, counted on one document in SAMPLE, is hot: its statistics are partial sums, and its rows aren't brought
#: together in one task. Either way gives the same result, so what the sample misses costs time only.
HOT_ROWS, SAMPLE = 4_000_000, 64
#: Words by which a copy may have drifted within a paragraph, and the words inside its edges that are looked at to tell.
SHIFT, INSIDE = 2, 4


def _sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each run of k."""
    out, span = x, 1
    while span * 2 <= k:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return out if span == k else np.minimum(out[: len(x) - k + 1], out[k - span : k - span + len(x) - k + 1])


def _runs(w: Words, k: int) -> np.ndarray:
    """A hash of the k words from each word on, by doubling."""
    b = pow(_B, 1, 1 << 64)
    level, span, total = w.hash, 1, None
    done = 0
    power = b
    n = len(w.hash) - k + 1
    while True:
        if k & span:
            part = level[done : done + n]
            total = part.copy() if total is None else total * np.uint64(power) + part
            done += span
        if span * 2 > k:
            return total
        level = level[: len(level) - span] * np.uint64(power) + level[span:]
        span *= 2
        power = power * power % (1 << 64)


def paragraphs(w: Words, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the paragraphs, the hash of each one's words, and the hashes of all word pairs."""
    n = len(w.hash) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    pairs = mix(w.hash[:-1] * np.uint64(_B) + w.hash[1:])
    valid = w.doc[:n] == w.doc[window - 1 :]
    place = np.arange(n, dtype=np.uint64)
    key = (pairs[:n] & ~np.uint64((1 << 28) - 1)) | place  # a chunk has fewer than 2^28 words
    key[~valid] = ~np.uint64(0)
    padded = np.concatenate([key, np.full(stride - 1, ~np.uint64(0))])
    least = _sliding_min(padded, stride)[valid]
    at = np.unique((least & np.uint64((1 << 28) - 1)).astype(np.int64))
    return at, mix(_runs(w, window)[at]), pairs


def band_rows(docs: DataFrame) -> DataFrame:
    """(bucket, content, doc_id, word) of each band of each paragraph."""
    seeds = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w = split_words(column(batch, "text"))
        at, content, pairs = paragraphs(w)
        if not len(at):
            return None
        buckets = []
        for band in range(BANDS):
            bucket = np.full(len(at), band, dtype=np.uint64)
            for seed in seeds[band * ROWS : (band + 1) * ROWS]:
                value = (pairs * seed >> np.uint64(32)).astype(np.uint32)
                bucket = mix(bucket ^ _sliding_min(value, WINDOW - 1)[at])
            buckets.append(bucket)
        ids = column(batch, "doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)[w.doc[at]]
        word = (at - w.first[w.doc[at]]).astype(np.int32)
        arrays = [np.concatenate(buckets).view(np.int64), np.tile(content.view(np.int64), BANDS), np.tile(ids, BANDS), np.tile(word, BANDS)]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["bucket", "content", "doc_id", "word"])

    return map_chunks(docs.select("doc_id", "text").where("doc_id is not null and text is not null"), "text", run, "bucket long, content long, doc_id long, word int")


def shared_rows(docs: DataFrame) -> DataFrame:
    """(bucket, content, doc_id, word, several) of the buckets that more than one document has; several: that more than one content has."""
    rows = band_rows(docs)
    sample = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(SAMPLE)) == 0)
    hot = write(band_rows(sample).groupBy("bucket").count().where(F.col("count") * SAMPLE >= HOT_ROWS).select("bucket"))
    figures = {"lo": F.min("doc_id"), "hi": F.max("doc_id"), "hub": F.min("content"), "top": F.max("content")}
    live = lambda df: df.where("lo <> hi").select("bucket", "content", "doc_id", "word", (F.col("hub") != F.col("top")).alias("several"))
    bucket = Window.partitionBy("bucket")
    together = lambda df: live(df.select("*", *[f.over(bucket).alias(n) for n, f in figures.items()]))
    if not (n := hot.count()):
        return together(rows)
    small = (lambda df: F.broadcast(df)) if n <= BROADCAST_ROWS else (lambda df: df)
    known = write(rows.join(small(hot), "bucket").groupBy("bucket").agg(*[f.alias(x) for x, f in figures.items()]))
    return together(rows.join(small(hot), "bucket", "left_anti")).unionAll(live(rows.join(small(known), "bucket")))


def _sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(content, items): the hashed word pairs of the wanted (content, doc_id, word), read from the texts again."""
    places = Table(wanted.groupBy("doc_id").agg(F.collect_list("word").alias("words")))
    texts = among(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null"), places.df.select("doc_id"), places.df.count())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w = split_words(column(batch, "text"))
        words = column(batch, "words")
        at = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(w.n), np.array([len(x) for x in words.to_pylist()], dtype=np.int64)) if len(words) else np.zeros(0, np.int64)
        at = w.first[doc] + at
        at = at[at + WINDOW <= w.first[doc + 1]]  # a repeated id can have a shorter text
        if not len(at):
            return None
        pairs = mix(w.hash[:-1] * np.uint64(_B) + w.hash[1:])
        items = (pairs[at[:, None] + np.arange(WINDOW - 1)] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * (WINDOW - 1)), pa.array(items.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(mix(_runs(w, WINDOW)[at]).view(np.int64)), lists], names=["content", "items"])

    found = map_chunks(texts.join(places.df, "doc_id"), "text", run, "content long, items array<int>")
    return found.select("content", F.array_distinct("items").alias("items"))


def _all_pairs(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of the same group, of groups of so many rows that lie one behind the other."""
    n = size.sum()
    end = np.repeat(np.cumsum(size), size)
    count = end - np.arange(n) - 1
    u = np.repeat(np.arange(n), count)
    return u, np.arange(len(u)) - np.repeat(np.cumsum(count) - count, count) + u + 1


def _jaccard(items: np.ndarray, size: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of pairs of rows; behind its size each row is padded with the number of the column, below all items."""
    both = np.sort(np.concatenate([items[u], items[v]], axis=1), axis=1)
    common = (both[:, 1:] == both[:, :-1]).sum(1) - (items.shape[1] - np.maximum(size[u], size[v]))
    return common / (size[u] + size[v] - common)


def _forest(items: np.ndarray, size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of alike rows that join the same rows as all the alike pairs do: what is joined already isn't looked for again."""
    n = len(items)
    real = np.arange(items.shape[1]) < size[:, None]
    row = np.nonzero(real)[0]
    _, at, n_of = np.unique(items[real], return_inverse=True, return_counts=True)
    posting, first = row[np.argsort(at, kind="stable")], np.cumsum(n_of) - n_of
    own = np.split(at, np.cumsum(size)[:-1])
    free = np.ones(n, dtype=bool)
    u, v = [], []
    for root in np.argsort(-np.bincount(row, n_of[at], n), kind="stable"):
        todo = [root] if free[root] else []
        free[root] = False
        while todo:
            x = todo.pop()
            common = np.bincount(np.concatenate([posting[first[i] : first[i] + n_of[i]] for i in own[x]]), minlength=n)
            found = np.flatnonzero(free & (common / (size + size[x] - common) >= threshold))
            free[found] = False
            u.append(np.full(len(found), x))
            v.append(found)
            todo += found.tolist()
    return np.concatenate(u), np.concatenate(v)


def _joined(bucket: np.ndarray, items: np.ndarray, size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of alike rows in one bucket, enough of them to join all that are alike; rows are sorted by bucket."""
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    n = np.diff(edge)
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    few = np.flatnonzero((n > 1) & (n <= FEW))
    for part in np.split(few, np.arange(256, len(few), 256)):
        rows = np.concatenate([np.arange(edge[g], edge[g + 1]) for g in part]) if len(part) else np.zeros(0, np.int64)
        a, b = _all_pairs(n[part])
        for at in range(0, len(a), 50_000):
            x, y = rows[a[at : at + 50_000]], rows[b[at : at + 50_000]]
            near = _jaccard(items, size, x, y) >= threshold
            u.append(x[near])
            v.append(y[near])
    for g in np.flatnonzero(n > FEW):
        own = slice(edge[g], edge[g + 1])
        a, b = _forest(items[own], size[own], threshold)
        u.append(a + edge[g])
        v.append(b + edge[g])
    return np.concatenate(u), np.concatenate(v)


def _near(members: DataFrame, where: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Verified pairs (u, v) of the (bucket, content) that share a bucket with another content.

    All members of a bucket are compared with each other, but for those that others have joined already, so the components are
    those of all pairs. The sets travel to the buckets and only the pairs that join come back. A bucket of more than
    BLOCK members is divided, and each two of its parts meet in a task of their own.
    """
    sets = _sets(where.join(members.select("content").distinct(), "content"), docs).dropDuplicates(["content"])
    large = write(members.groupBy("bucket").count().where(F.col("count") > BLOCK).select("bucket", F.ceil(F.col("count") / BLOCK).alias("parts")))
    n = large.count()
    blocks = members.withColumn("block", F.lit(0).cast("long"))
    if n:
        part = F.pmod(F.xxhash64("content"), "parts")
        others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda i: F.least(i, part) * F.col("parts") + F.greatest(i, part))
        split = members.join(F.broadcast(large) if n <= BROADCAST_ROWS else large, "bucket")
        split = split.select("bucket", "content", F.explode(F.array_except(others, F.array(part * F.col("parts") + part))).alias("block"))
        blocks = blocks.join(F.broadcast(large) if n <= BROADCAST_ROWS else large, "bucket", "left_anti").unionByName(split)
    rows = blocks.join(sets, "content").select(F.xxhash64("bucket", "block").alias("bucket"), "content", "items")

    def run(batch):
        lists, content = column(batch, "items"), column(batch, "content").to_numpy(zero_copy_only=False)
        size = lists.value_lengths().to_numpy().astype(np.int64)
        items = np.tile(np.arange(WINDOW - 1) - (1 << 40), (len(size), 1))
        items[np.arange(WINDOW - 1) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        u, v = _joined(column(batch, "bucket").to_numpy(zero_copy_only=False), items, size, threshold)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(content[u], content[v])), pa.array(np.maximum(content[u], content[v]))], names=["u", "v"])

    return map_groups(rows, "bucket", run, "u long, v long")


def _contexts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, word, side, content, context) of the wanted (doc_id, word, side), read from the texts again.

    context holds 32-bit hashes of words, from INSIDE words within the edge of the paragraph (side 0 its beginning, 1 its end) outwards;
    where the text ends the words that are missing are 0.
    """
    places = Table(wanted.groupBy("doc_id").agg(F.collect_list(F.col("word") * 2 + F.col("side")).alias("places")))
    texts = among(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null"), places.df.select("doc_id"), places.df.count())
    reach = np.arange(-INSIDE, STRIDE - 1 + SHIFT)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w = split_words(column(batch, "text"))
        lists = column(batch, "places")
        place = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(w.n), lists.value_lengths().to_numpy(zero_copy_only=False))
        word, side = place // 2, place % 2
        at = w.first[doc] + word
        fits = at + WINDOW <= w.first[doc + 1]  # a repeated id can have a shorter text
        doc, word, side, at = doc[fits], word[fits], side[fits], at[fits]
        if not len(at):
            return None
        spot = np.where(side[:, None] == 1, at[:, None] + WINDOW + reach, at[:, None] - 1 - reach)
        inside = (spot >= w.first[doc][:, None]) & (spot < w.first[doc + 1][:, None])
        context = np.where(inside, (w.hash[np.where(inside, spot, 0)] >> np.uint64(32)).astype("<u4") | np.uint32(1), np.uint32(0)).astype("<u4")
        arrays = [column(batch, "doc_id").take(pa.array(doc)), pa.array(word.astype(np.int32)), pa.array(side.astype(np.int32)), pa.array(mix(_runs(w, WINDOW)[at]).view(np.int64)), pa.array([r.tobytes() for r in context], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "word", "side", "content", "context"])

    return map_chunks(texts.join(places.df, "doc_id"), "text", run, "doc_id long, word int, side int, content long, context binary")


def _agreeing(own: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """How many words outside the edge agree, at the best of SHIFT words of drift; a drift counts where two words inside agree too."""
    n = STRIDE - 1
    out = own[:, INSIDE : INSIDE + n]
    best = np.zeros(len(own), dtype=np.int32)
    for s in range(-SHIFT, SHIFT + 1):
        other = kept[:, INSIDE + s : INSIDE + s + n]
        run = np.logical_and.accumulate((out == other) & (out != 0), axis=1).sum(1)
        if s:
            run = np.where((own[:, INSIDE - 2 : INSIDE] == kept[:, INSIDE + s - 2 : INSIDE + s]).all(1), run, 0)
        best = np.maximum(best, run)
    return best.astype(np.int32)


def _extended(spans: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, begin, end, kept_ids) of the spans, grown on both sides while their words agree with a kept copy.

    A run of equal words that goes on for STRIDE words or more has another paragraph, so no side grows by more than STRIDE - 1.
    """
    edges = spans.select("doc_id", F.posexplode(F.array("first", "last")).alias("side", "at")).select("doc_id", "side", "at.*")
    edges = write(edges)
    copies = edges.select("root", F.col("kept_id").alias("doc_id"), "side").distinct().join(found, ["root", "doc_id"])
    copies = write(copies.select("root", "doc_id", "side", "content", "word"))
    places = edges.select("doc_id", "word", "side").unionAll(copies.select("doc_id", "word", "side")).distinct()
    contexts = write(_contexts(places, docs).distinct())
    key = ["doc_id", "word", "side", "content"]
    own = edges.join(contexts, key)
    kept = copies.join(contexts, key).select("root", F.col("doc_id").alias("kept_id"), "side", F.col("context").alias("kept_context")).distinct()
    both = own.join(kept, ["root", "kept_id", "side"]).select("doc_id", "word", "side", "context", "kept_context")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(column(batch, c).to_pylist()), dtype="<u4").reshape(batch.num_rows, -1) for c in ("context", "kept_context"))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "word"), column(batch, "side"), pa.array(_agreeing(a, b))], names=["doc_id", "word", "side", "more"])

    more = both.mapInArrow(run, "doc_id long, word int, side int, more int").groupBy("doc_id", "word", "side").agg(F.max("more").alias("more"))
    less = more.where("side = 0").select("doc_id", F.col("word").alias("low"), F.col("more").alias("before"))
    more = more.where("side = 1").select("doc_id", F.col("word").alias("high"), F.col("more").alias("behind"))
    plain = spans.select("doc_id", F.col("first.word").alias("low"), F.col("last.word").alias("high"), "kept_ids")
    grown = plain.join(less, ["doc_id", "low"], "left").join(more, ["doc_id", "high"], "left")
    return grown.select("doc_id", (F.col("low") - F.coalesce("before", F.lit(0))).alias("begin"), (F.col("high") + WINDOW + F.coalesce("behind", F.lit(0))).alias("end"), "kept_ids")


def repeated_passages(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, word, words, kept_ids): spans of words that a document with a lesser id has too.

    word counts from 0, kept_ids are the sorted ids of the documents that keep their copies. Rows with a null doc_id or text, and texts of
    fewer than WINDOW words, have no passage. Rows with the same doc_id are one document, and what repeats inside one document
    only is not reported. Of whole copies of documents the least id keeps all. Only doc_id and text are read. An
    empty table gives no rows.
    """
    with scratch() as settle:
        shared = write(shared_rows(docs))
        nodes = write(shared.groupBy("content").agg(F.min(F.struct("doc_id", "word")).alias("at"), F.max("doc_id").alias("last")))
        where = nodes.select("content", "at.doc_id", "at.word")
        members = write(shared.where("several").select("bucket", "content").distinct())
        roots = write(components(_near(members, where, docs, threshold).distinct()))
        found = shared.select("content", "doc_id", "word").distinct()
        # contents that one document has and that are like no other stay out before anything is sorted
        alone = nodes.where("at.doc_id = last").select("content").join(roots.select(F.col("id").alias("content")), "content", "left_anti")
        found = found.join(alone, "content", "left_anti").join(roots.withColumnRenamed("id", "content"), "content", "left")
        found = write(found.select(F.coalesce("root", "content").alias("root"), "doc_id", "word", "content"))
        kept = found.groupBy("root").agg(F.min("doc_id").alias("kept_id"))
        removed = write(found.join(kept, "root").where("doc_id <> kept_id").select("doc_id", "word", "kept_id", "root", "content").distinct())
        order = Window.partitionBy("doc_id").orderBy("word")
        before = F.max("word").over(order.rangeBetween(Window.unboundedPreceding, -1)) + WINDOW
        islands = removed.withColumn("new", F.when(F.col("word") <= before, 0).otherwise(1)).withColumn("island", F.sum("new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
        # equal words of several kept ids are one beginning: count an island once
        islands = islands.groupBy("doc_id", "island", "word").agg(F.collect_set("kept_id").alias("ids"), F.min(F.struct("word", "root", "content", "kept_id")).alias("at"))
        spans = write(islands.groupBy("doc_id", "island").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("kept_ids")))
        grown = _extended(spans, found, docs)
        order = Window.partitionBy("doc_id").orderBy("begin", "end")
        reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        merged = grown.withColumn("new", F.when(F.col("begin") <= reached, 0).otherwise(1)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        spans = merged.groupBy("doc_id", "island").agg(F.min("begin").alias("word"), (F.max("end") - F.min("begin")).alias("words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kept_ids")))).alias("kept_ids"))
        return settle(spans.select("doc_id", "word", "words", "kept_ids"))


def remove_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs with the spans of repeated_passages cut out of their texts; all other columns and rows stay as they are, whatever they are called.

    A cut goes from the first to behind the last word of the span; spans that meet or overlap are one. A document cut to nothing keeps an
    empty text. Rows with a null doc_id or text are left alone, as are spans with a null in them; of rows that repeat a doc_id all
    are cut at the same words. Without passages nothing changes; an empty table gives an empty table.
    """
    cuts, key = unused("cut_spans", docs.columns), unused("cut_id", docs.columns)
    spans = passages.where("doc_id is not null and word is not null and words is not null").groupBy("doc_id")
    spans = spans.agg(F.collect_list(F.struct("word", "words")).alias(cuts)).withColumnRenamed("doc_id", key)
    joined = docs.join(spans, F.col("doc_id") == F.col(key), "left").select(*[F.col(f"`{c}`") for c in docs.columns], cuts)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = column(batch, "text")
        cut = batch.column(batch.num_columns - 1).to_pylist()
        if not any(cut):
            return pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1])
        w = split_words(texts, lower=False)
        out = texts.to_pylist()
        for d, spans_ in enumerate(cut):
            if not spans_ or out[d] is None:
                continue
            raw, base = out[d].encode(), int(w.doc_start[d])
            first, n = int(w.first[d]), int(w.first[d + 1] - w.first[d])
            merged: list[list[int]] = []
            for s in sorted(spans_, key=lambda x: x["word"]):
                begin, end = max(0, s["word"]), min(s["word"] + s["words"], n)
                if merged and begin <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                elif begin < end:
                    merged.append([begin, end])
            kept, at = [], 0
            for begin, end in merged:
                kept.append(raw[at : int(w.start[first + begin]) - base])
                at = int(w.end[first + end - 1]) - base
            out[d] = b"".join([*kept, raw[at:]]).decode("utf-8", "replace")
        at = batch.schema.get_field_index("text")
        arrays = [pa.array(out, c.type) if i == at else c for i, c in enumerate(batch.columns)][:-1]
        return pa.RecordBatch.from_arrays(arrays, names=batch.schema.names[:-1])

    return map_chunks(joined, "text", run, docs.schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
