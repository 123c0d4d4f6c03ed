"""All pairs within groups, compared where the group's sets are: only what pairs add up to leaves the task.

A group of more than PART members, or of more than PART_ITEMS set items, is divided into parts, and each two of its parts meet in a block of
their own; so a task holds two parts at most, however large a group is, and no pair is emitted or left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import column, release_memory

PART, PART_ITEMS = 2048, 1 << 21
#: Vocabulary columns of an incidence matrix at a time.
_COLUMNS = 4096


def map_groups(df: DataFrame, key: str, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over rows that are together by key: function gets batches of whole groups, sorted by key."""

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if column(held[0], key)[0] == column(batch, key)[-1]:
                continue  # all of one group so far
            together = whole(held)
            keys = column(together, key).to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1  # the last group can go on in the next batch
            yield from function(together.slice(0, cut))
            held = [together.slice(cut)]
        if held:
            yield from function(whole(held))
        held.clear()
        release_memory()

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def blocks(members: DataFrame, group: str, member: str, parts: DataFrame, small: bool) -> DataFrame:
    """members with (block, part): each row once for each other part of its group and once for its own; parts is (group, parts) of the large groups."""
    large = F.broadcast(parts) if small else parts
    one = members.join(large.select(group), group, "left_anti").select("*", F.xxhash64(group).alias("block"), F.lit(0).cast("long").alias("part"))
    own = F.pmod(F.xxhash64(member, F.lit(1)), "parts")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda i: F.struct(F.least(i, own).alias("a"), F.greatest(i, own).alias("b")))
    split = members.join(large, group).select(*members.columns, own.alias("part"), F.explode(pairs).alias("meet"))
    split = split.select(*members.columns, F.xxhash64(group, "meet.a", "meet.b").alias("block"), F.when(F.col("meet.a") == F.col("meet.b"), 0).when(F.col("part") == F.col("meet.a"), 1).otherwise(2).cast("long").alias("part"))
    return one.unionByName(split)


def common(offsets: np.ndarray, items: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many items the sets of the rows left and right have in common, as a matrix; row i is items[offsets[i]:offsets[i + 1]]."""
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    _, at, n = np.unique(items, return_inverse=True, return_counts=True)
    shared = n > 1
    number = np.cumsum(shared) - 1
    keep = shared[at]
    row, at = row[keep], number[at[keep]]
    place = [np.full(len(size), -1), np.full(len(size), -1)]
    place[0][left], place[1][right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    total = int(at[-1]) + 1 if len(at) else 0
    same = left is right
    for begin in range(0, total, _COLUMNS):
        lo, hi = np.searchsorted(at, [begin, begin + _COLUMNS])
        r, c = row[lo:hi], at[lo:hi] - begin
        width = min(_COLUMNS, total - begin)
        sides = []
        for p, rows in ((place[0], left), (place[1], right))[: 1 if same else 2]:
            side = np.zeros((len(rows), width), dtype=np.float32)
            mine = p[r] >= 0
            side[p[r[mine]], c[mine]] = 1
            sides.append(side)
        out += sides[0] @ sides[-1].T
    return out


def alike(offsets: np.ndarray, items: np.ndarray, part: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, matrix) of one block: whether the Jaccard similarity of rows left and right is at least the threshold; a row isn't like itself."""
    size = np.diff(offsets)
    if part[0] == 0:
        left = right = np.arange(len(size))
    else:
        left, right = np.flatnonzero(part == 1), np.flatnonzero(part == 2)
    both = common(offsets, items, left, right)
    near = both >= threshold * (size[left][:, None] + size[right][None, :] - both) - 1e-4
    near &= both > 0
    if left is right:
        np.fill_diagonal(near, False)
    return left, right, near


def forest(left: np.ndarray, right: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that join the same rows as all pairs of the matrix do."""
    u, v = [], []
    if left is right:
        free = np.ones(len(left), dtype=bool)
        for root in range(len(left)):
            todo = [root] if free[root] else []
            free[root] = False
            while todo:
                x = todo.pop()
                found = np.flatnonzero(near[x] & free)
                free[found] = False
                u.append(np.full(len(found), left[x]))
                v.append(left[found])
                todo += found.tolist()
    else:
        free_l, free_r = np.ones(len(left), dtype=bool), np.ones(len(right), dtype=bool)
        for root in range(len(left)):
            todo = [(0, root)] if free_l[root] else []
            free_l[root] = False
            while todo:
                side, x = todo.pop()
                found = np.flatnonzero(near[x] & free_r) if side == 0 else np.flatnonzero(near[:, x] & free_l)
                (free_r if side == 0 else free_l)[found] = False
                u.append(np.full(len(found), left[x] if side == 0 else right[x]))
                v.append(right[found] if side == 0 else left[found])
                todo += [(1 - side, y) for y in found.tolist()]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *u]), np.concatenate([none, *v])


def each_block(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, offsets, items, part) of each block of two rows or more in a batch with the columns block, part and items."""
    block = column(batch, "block").to_numpy(zero_copy_only=False)
    part = column(batch, "part").to_numpy(zero_copy_only=False)
    lists = column(batch, "items")
    offsets = lists.offsets.to_numpy()
    items = lists.values.to_numpy(zero_copy_only=False)
    edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
    for a, b in zip(edge[:-1], edge[1:]):
        if b - a > 1:
            yield slice(a, b), offsets[a : b + 1] - offsets[a], items[offsets[a] : offsets[b]], part[a:b]
