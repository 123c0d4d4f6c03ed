"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for all ids of edges (u, v) of longs; root is the least id of the component.

    Loops and repeated edges do no harm; edges with a null end are ignored; no edges give no rows. Each round is written
    to the shared folder, so that lineage stays short and lost executors cost one round; nothing but two numbers
    comes to the driver.
    """
    seen = None
    table = Table(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        state = table.df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == seen or state.n == 0:
            break
        seen = state
        after = Table(_small_star(_large_star(table.df)))
        table.release()
        table = after
    stars = table.df
    return stars.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(stars.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
