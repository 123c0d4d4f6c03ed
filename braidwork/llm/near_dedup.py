"""Near-duplicate documents by SetSketch registers (Ertl 2021).

A document is the set of its word bigrams. Each register holds the least of one exponential variable per element, on an
exponential scale: K = floor(1 - log_b(min / RATE)), truncated to 16 bits. Registers of a union are the maxima of the
registers, and the collision probability of a register is close to the Jaccard similarity, so bands of four registers
are a locality-sensitive hash.

Points of all registers of an element come from one Poisson process of m points per unit with a random register each,
so only about ln m points per register are drawn for a whole document, not one per element and register.

Documents with equal sets are one text. Of each band's bucket all members are compared with the least id: estimated from the registers
by joint maximum likelihood, and verified by the exact Jaccard similarity of the bigram sets. Members that fail are compared with
all members of their bucket, set by set within the bucket's tasks, of which only pairs that join two groups come back. Groups are
connected components. At last all texts of a group are compared with each other, again within tasks, to count the links of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ._graph import components
from ._names import unused
from ._pairs import PART, PART_ITEMS, alike, blocks, each_block, forest, map_groups
from ._store import Table, scratch, write
from ._words import Words, column, gram_hashes, map_chunks, mix, split_words

REGISTERS = 80
BAND = 4
BASE = 1.001
RATE = 20.0
THRESHOLD = 0.6
#: A pair whose estimate is this far below the threshold is not verified: about four standard errors of 80 registers.
SLACK = 0.2
#: Id lists up to this many rows are broadcast, larger ones joined by a shuffle; so are texts with their groups.
BROADCAST_ROWS, BROADCAST_TEXTS = 2_000_000, 200_000
_HAS_WORD = r"[A-Za-z0-9]|[^\x00-\x7F]"


def elements(w: Words, gram: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each document, sorted: document and 44-bit hash. A one-word document has its word."""
    at, h = gram_hashes(w, gram)
    doc = w.doc[at]
    short = np.flatnonzero((np.diff(w.first) > 0) & (np.diff(w.first) < gram))
    if len(short):
        at_short = np.concatenate([np.arange(w.first[d], w.first[d + 1]) for d in short])
        doc, h = np.concatenate([doc, w.doc[at_short]]), np.concatenate([h, mix(w.hash[at_short])])
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1)


def set_sketch(n: int, doc: np.ndarray, element: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """n rows of 16-bit registers; all 0 for an empty set."""
    m = registers
    least = np.full(n * m, np.inf)
    size = np.bincount(doc, minlength=n)
    limit = (np.log(m) + 3) / np.maximum(size, 1)
    todo_doc, todo = doc, element
    while len(todo):
        d, seed, x = todo_doc, mix(todo), np.zeros(len(todo))
        while len(d):
            u = ((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            x = x - np.log(u) / m
            live = x < limit[d]
            d, x, seed = d[live], x[live], seed[live]
            seed = mix(seed)
            np.minimum.at(least, d * m + (seed % np.uint64(m)).astype(np.int64), x)
            seed = mix(seed)
        empty = np.isinf(least.reshape(n, m)).any(axis=1)
        again = empty[todo_doc]  # some register got no point below the limit: look further
        todo_doc, todo = todo_doc[again], todo[again]
        limit[empty] *= 2
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least / RATE) / np.log(BASE))
    k[np.isinf(least)] = 0
    return np.clip(k, 0, 65535).astype("<u2").reshape(n, m)


def likely_jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of register rows with known set sizes, by golden-section search."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    scale = (BASE - 1) / BASE

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * scale) / np.log(BASE)

    def loglik(j):
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, 0) + tiny)

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(30):
        c, d = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        left = loglik(c) > loglik(d)
        hi, lo = np.where(left, d, hi), np.where(left, lo, c)
    return (lo + hi) / 2


def _set_hash(n: int, doc: np.ndarray, element: np.ndarray) -> np.ndarray:
    """128 bits of each of n sets; doc is sorted."""
    out = np.zeros((n, 2), dtype="<u8")
    if len(doc):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        for i, s in enumerate((1, 1 << 60)):
            out[doc[first], i] = np.add.reduceat(mix(element ^ np.uint64(s)), first)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, set_hash, sketch) per row with a doc_id and a word. set_hash is 128 bits of the shingle set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = split_words(column(batch, "text"))
        doc, element = elements(w)
        n = np.bincount(doc, minlength=w.n)
        some = np.flatnonzero(n > 0)
        regs = set_sketch(w.n, doc, element)[some]
        whole = _set_hash(w.n, doc, element)[some]
        arrays = [
            column(batch, "doc_id").cast(pa.int64()).take(pa.array(some)),
            pa.array(n[some].astype(np.int64)),
            pa.array([r.tobytes() for r in whole], pa.binary()),
            pa.array([r.tobytes() for r in regs], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "set_hash", "sketch"])

    return map_chunks(docs.select("doc_id", "text").where("doc_id is not null and text is not null"), "text", run, "doc_id long, n long, set_hash binary, sketch binary")


def _bands(reps: DataFrame) -> DataFrame:
    """(bucket, doc_id) for each band of each representative."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(column(batch, "sketch").to_pylist()), dtype="<u8").reshape(batch.num_rows, -1)
            bucket = mix(regs.astype(np.uint64) + np.arange(regs.shape[1], dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            ids = np.repeat(column(batch, "doc_id").to_numpy(zero_copy_only=False), regs.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel().view(np.int64)), pa.array(ids)], names=["bucket", "doc_id"])

    return reps.select("doc_id", "sketch").mapInArrow(run, "bucket long, doc_id long")


def _estimated(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v) whose joint likelihood doesn't rule the threshold out."""
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    joined = pairs.join(side("u"), "u").join(side("v"), "v")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(column(batch, s).to_pylist()), dtype="<u2").reshape(batch.num_rows, -1) for s in ("su", "sv"))
            na, nb = (column(batch, s).to_numpy(zero_copy_only=False).astype(float) for s in ("nu", "nv"))
            keep = np.flatnonzero(likely_jaccard(a, b, na, nb) >= threshold - SLACK)
            yield pa.RecordBatch.from_arrays([column(batch, x).take(pa.array(keep)) for x in ("u", "v")], names=["u", "v"])

    return joined.mapInArrow(run, "u long, v long")


def among(docs: DataFrame, ids: DataFrame, rows: int, how: str = "left_semi") -> DataFrame:
    """docs with (or, by left_anti, without) a doc_id among ids; ids of a known, small number are broadcast."""
    return docs.join(F.broadcast(ids) if rows <= BROADCAST_ROWS else ids, "doc_id", how)


def _sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, items): the hashed shingles of the rows of docs with these ids."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = split_words(column(batch, "text"))
        doc, element = elements(w)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=w.n))]).astype(np.int32)
        sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array((element >> np.uint64(12)).astype(np.uint32).view(np.int32)))
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), sets], names=["doc_id", "items"])

    texts = among(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null"), ids, ids.count())
    return map_chunks(texts, "text", run, "doc_id long, items array<int>")


def _verified(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(u, v, jaccard) of the pairs of at least the threshold, by the sets of hashed shingles; of repeated ids the likest rows count."""
    sets = _sets(write(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()), docs)
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("items").alias(f"i{x}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    shared = F.size(F.array_intersect("iu", "iv"))
    scored = both.select("u", "v", (shared / (F.size("iu") + F.size("iv") - shared)).alias("jaccard"))
    return scored.where(F.col("jaccard") >= threshold).groupBy("u", "v").agg(F.max("jaccard").alias("jaccard"))


def _blocked(members: DataFrame, group: str, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """members (group, doc_id, ...) with block, part and the items of their sets, a row for each block; large groups are divided."""
    sizes = members.join(reps.select("doc_id", "n"), "doc_id").groupBy(group).agg(F.count("*").alias("count"), F.sum("n").alias("items"))
    parts = F.greatest(F.ceil(F.col("count") / PART), F.ceil(F.col("items") / PART_ITEMS))
    large = write(sizes.select(group, parts.alias("parts")).where("parts > 1"))
    sets = _sets(write(members.select("doc_id").distinct()), docs)
    once = sets.groupBy("doc_id").agg(F.min("items").alias("items"))  # a repeated id has one text
    return blocks(members, group, "doc_id", large, large.count() <= BROADCAST_ROWS).drop(group).join(once, "doc_id")


def _rest(failed: DataFrame, shared: DataFrame, reps: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(u, v): pairs that join what the pairs of a failed member of a bucket and any other member of it join."""
    inside = shared.where("doc_id <> hub").select("bucket", "doc_id").join(failed.select("bucket").distinct(), "bucket", "left_semi")
    inside = inside.join(failed.select("bucket", "doc_id", F.lit(True).alias("failed")), ["bucket", "doc_id"], "left")
    rows = _blocked(write(inside.select("bucket", "doc_id", F.col("failed").isNotNull().alias("failed"))), "bucket", reps, docs)

    def run(batch):
        ids, bad = column(batch, "doc_id").to_numpy(zero_copy_only=False), column(batch, "failed").to_numpy(zero_copy_only=False)
        us, vs = [], []
        for rows_, offsets, items, part in each_block(batch):
            if part[0] and (part == part[0]).all():
                continue
            left, right, near = alike(offsets, items, part, threshold)
            near &= bad[rows_][left][:, None] | bad[rows_][right][None, :]
            u, v = forest(left, right, near)
            us.append(ids[rows_][u])
            vs.append(ids[rows_][v])
        if us:
            u, v = np.concatenate(us), np.concatenate(vs)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    return map_groups(rows, "block", run, "u long, v long").distinct()


def _links(texts: DataFrame, reps: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, links): with how many other texts of its group (root) each text (doc_id) is alike; texts without a link have no row."""
    rows = _blocked(texts, "root", reps, docs)

    def run(batch):
        ids, out, n = column(batch, "doc_id").to_numpy(zero_copy_only=False), [], []
        for rows_, offsets, items, part in each_block(batch):
            if part[0] and (part == part[0]).all():
                continue
            left, right, near = alike(offsets, items, part, threshold)
            out.append(ids[rows_][left])
            n.append(near.sum(1))
            if left is not right:
                out.append(ids[rows_][right])
                n.append(near.sum(0))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.concatenate(n).astype(np.int64))], names=["doc_id", "links"])

    return map_groups(rows, "block", run, "doc_id long, links long").groupBy("doc_id").agg(F.sum("links").alias("links"))


def near_duplicates(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kept_id, group_size, links) of all documents in groups of two or more; kept_id, the least doc_id of the group, is its class.

    links is the number of other texts in the group whose similarity to the document's is at least the threshold; texts with equal sets of
    shingles are one text, so whole copies have equal links, 0 where there is no other text. Rows with a null doc_id, a null text or a text
    without a word are in no group. A doc_id that occurs in several rows is one document: of different texts the one with the fewest
    shingles, ties by their hash, stands for it. Only doc_id and text are read, so other columns don't matter. An empty table gives no rows.
    """
    with scratch() as settle:
        rows = sketches(docs)
        table = write(rows.groupBy("doc_id").agg(F.min(F.struct("n", "set_hash", "sketch")).alias("s")).select("doc_id", "s.*"))
        reps = write(table.groupBy("n", "set_hash").agg(F.min_by("sketch", "doc_id").alias("sketch"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))

        # two passes over the band rows, the first with partial sums, instead of a window that would hold a bucket in one task
        hubs = _bands(reps).groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("top")).where("hub <> top").select("bucket", "hub")
        shared = write(_bands(reps).join(hubs, "bucket").select("bucket", "doc_id", "hub"))
        stars = shared.where("doc_id <> hub")
        first = write(_verified(write(_estimated(stars.select(F.col("hub").alias("u"), F.col("doc_id").alias("v")).distinct(), reps, threshold)), docs, threshold))
        # members that are not like the hub of their bucket are compared with all of its members
        failed = write(stars.join(first, (F.col("hub") == F.col("u")) & (F.col("doc_id") == F.col("v")), "left_anti").select("bucket", "doc_id"))
        joined = write(components(first.select("u", "v").unionAll(_rest(failed, shared, reps, docs, threshold))))

        texts = joined.select(F.col("id").alias("doc_id"), "root")
        links = _links(write(texts), reps, docs, threshold)
        live = reps.select("doc_id", "n", "set_hash", "copies").join(texts, "doc_id", "left").join(links, "doc_id", "left").where("copies > 1 or root is not null")
        live = write(live.select("n", "set_hash", "copies", F.coalesce("root", "doc_id").alias("root"), F.coalesce("links", F.lit(0).cast("long")).alias("links")))
        sizes = live.groupBy("root").agg(F.sum("copies").alias("group_size"))
        known = write(live.join(sizes, "root").select("n", "set_hash", "root", "group_size", "links"))
        members = table.select("doc_id", "n", "set_hash").join(F.broadcast(known) if known.count() <= BROADCAST_TEXTS else known, ["n", "set_hash"])
        return settle(members.select("doc_id", F.col("root").alias("kept_id"), "group_size", "links"))


def _standing(rows: DataFrame, size: str, order: str) -> DataFrame:
    """rows with the number of shingles of each text and the hash of its set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = split_words(column(batch, "text"))
        doc, element = elements(w)
        n = np.bincount(doc, minlength=w.n)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(n.astype(np.int64)), pa.array([r.tobytes() for r in _set_hash(w.n, doc, element)], pa.binary())], names=[*batch.schema.names, size, order])

    return map_chunks(rows, "text", run, StructType([*rows.schema.fields, StructField(size, LongType()), StructField(order, BinaryType())]))


def drop_near_duplicates(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each group of near duplicates, all columns as they were and where they were.

    Rows in no group stay. Rows with words that repeat a doc_id are one document and leave one row, the one with the fewest shingles, ties
    by the hash of the set, as in near_duplicates, of equal ones any. Rows with a null doc_id, or without a word in the
    text, all stay. Helper columns take names that docs doesn't have. An empty table gives an empty table.
    """
    with scratch() as settle:
        drop = settle(near_duplicates(docs, threshold=threshold).where("doc_id <> kept_id").select("doc_id"))
        worded = F.col("text").rlike(_HAS_WORD)
        repeated = settle(docs.where(F.col("doc_id").isNotNull() & worded).groupBy("doc_id").count().where("count > 1").select("doc_id"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    gone = unused("gone_id", docs.columns)

    def those(ids: DataFrame) -> DataFrame:
        ids = ids.withColumnRenamed("doc_id", gone)
        return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids

    match = (F.col("doc_id") == F.col(gone)) & worded
    kept = docs.join(those(drop), match, "left_anti")
    if not repeated.count():
        return kept.select(*names)
    size, order, mark = (unused(x, docs.columns) for x in ("row_shingles", "row_hash", "row_of_id"))
    once = kept.join(those(repeated), match, "left_anti").select(*names)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(size, order))
    several = _standing(kept.join(those(repeated), match, "left_semi").select(*names), size, order).withColumn(mark, place).where(F.col(mark) == 1)
    return once.unionAll(several.select(*names))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_near_dedup": op9_near_dedup}
ORACLE_SQL: dict[str, str] = {}
