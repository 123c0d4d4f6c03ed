"""Trees given by parent ids: validation, closure and fallback paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .guards import _with_guard


def hierarchy_closure(df: DataFrame, id: str, parent: str, *, max_depth: int, node: str = "node_id", ancestor: str = "ancestor_id", depth: str = "depth") -> DataFrame:
    """(node, ancestor, depth) of each node and each of its ancestors up to max_depth; depth 0 is the node itself.

    A parent without a row of its own is an ancestor still. Cycles repeat until max_depth. All steps join with the same
    (id, parent) relation; the depth of the tree bounds the plan, not the number of nodes.
    """
    edges = df.select(F.col(id).alias("child_"), F.col(parent).alias("parent_"))
    level = df.select(F.col(id).alias(node), F.col(id).alias(ancestor), F.lit(0).cast("long").alias(depth), F.col(parent).alias("next_"))
    out = level
    for d in range(1, max_depth + 1):
        up = level.where("next_ is not null").select(node, F.col("next_").alias(ancestor))
        level = up.join(edges, F.col(ancestor) == F.col("child_"), "left").select(node, ancestor, F.lit(d).cast("long").alias(depth), F.col("parent_").alias("next_"))
        out = out.unionByName(level)
    return out.drop("next_")


def _farther(a: DataFrame, b: DataFrame) -> DataFrame:
    """Steps of b behind steps of a; both are (from_, to_)."""
    return a.select("from_", F.col("to_").alias("over_")).join(b.select(F.col("from_").alias("over_"), "to_"), "over_").select("from_", "to_")


def _ancestors(edges: DataFrame, steps: int) -> DataFrame:
    """(from_, to_): each node with its ancestor so many steps up, by doubling: the joins are twice the digits of steps at most, not as many as steps."""
    out = None
    while True:
        if steps % 2:
            out = edges if out is None else _farther(out, edges)
        steps //= 2
        if not steps:
            return out
        edges = _farther(edges, edges)


def require_parent_hierarchy(df: DataFrame, id: str, parent: str, *, order_by: str, max_depth: int) -> DataFrame:
    """df, if every parent has a row, no path is longer than max_depth (cycles are), and each child's order is greater than its parent's."""
    rows = df.select(F.col(id).alias("id_"), F.col(parent).alias("up_"), F.col(order_by).alias("order_"))
    parents = rows.select(F.col("id_").alias("p_id_"), F.col("order_").alias("p_order_"))
    children = rows.where("up_ is not null")
    bad = children.join(parents, F.col("up_") == F.col("p_id_"), "left").where("p_id_ is null or not coalesce(order_ > p_order_, false)").select("id_")
    deep = _ancestors(children.select(F.col("id_").alias("from_"), F.col("up_").alias("to_")), max_depth + 1).select(F.col("from_").alias("id_"))
    return _with_guard(df, bad.unionByName(deep), "HIERARCHY", "missing parent, cycle, too deep, or out of order")


def hierarchy_fallbacks(df: DataFrame, source_id: str, path: str, parents: DataFrame, *, parent_id: str, parent: str, max_steps: int, separator: str = "/") -> DataFrame:
    """(source_id, ordinal, path, fallback_id): ever wider paths of each source.

    Ordinal 0 is the path; each step puts the last id's parent in its place, or drops it where it has none or the parent is in the path.
    fallback_id is the SHA-256 of the joined path, null for the empty path, which is the last.
    """
    up = parents.select(F.col(parent_id).alias("up_id_"), F.col(parent).alias("up_"))
    level = df.select(source_id, F.lit(0).alias("ordinal"), F.col(path).alias("path"))
    out = level
    for step in range(1, max_steps + 1):
        last = F.try_element_at("path", F.lit(-1))
        joined = level.where(F.size("path") > 0).withColumn("last_", last).join(up, F.col("last_") == F.col("up_id_"), "left")
        head = F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
        drop = F.col("up_").isNull() | F.coalesce(F.array_contains(head, F.col("up_")), F.lit(False))
        level = joined.select(source_id, F.lit(step).alias("ordinal"), F.when(drop, head).otherwise(F.array_append(head, F.col("up_"))).alias("path"))
        out = out.unionByName(level)
    return out.withColumn("fallback_id", path_id(F.col("path"), separator))


def path_id(path: Column, separator: str = "/") -> Column:
    return F.when(F.size(path) > 0, F.sha2(F.concat_ws(separator, path), 256))
