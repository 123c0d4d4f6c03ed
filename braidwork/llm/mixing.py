"""Mixing sources to target weights by capped water-filling.

A source of size s (characters) that is read e times gives e * s. Targets share a budget by weight; a source that would have
to be read more than max_epochs times is clamped there, and what it can't give goes to the others in proportion to their
weights, until no other has to be clamped. Sources are clamped in the order of capacity / weight, so the fixed point of that
loop is found in one pass over the sorted sources. Whole repetitions are taken of every document, the fraction
by a seeded hash of the document, so a repeated run gives the same sample whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._names import unused
from ._store import write

#: Production targets: relative weights of named sources; all others share DEFAULT_WEIGHT each.
TARGETS = {"src0": 6.0, "src1": 8.0, "src2": 0.5}
DEFAULT_WEIGHT = 1.0
MAX_EPOCHS = 4.0
SEED = 17
#: Epochs are rounded to this many decimals, so that engines that add doubles in another order agree.
DECIMALS = 6
#: Rates of up to this many sources are broadcast, more are joined by a shuffle.
BROADCAST_SOURCES = 500_000


def epochs(docs: DataFrame, targets: Mapping[str, float], *, default_weight: float = DEFAULT_WEIGHT, max_epochs: float = MAX_EPOCHS, budget: float | None = None) -> DataFrame:
    """(source, chars, weight, epochs, clamped) of each source; the budget is the size of docs unless given.

    A null source is a source of its own with the default weight. Null texts count 0 characters; a source without any
    character has 0 epochs, as has one of weight 0. Negative weights are an error. If all sources are clamped the budget
    isn't reached. An empty table gives no rows. Only source and text are read.
    """
    if default_weight < 0 or max_epochs < 0 or any(w < 0 for w in targets.values()):
        raise ValueError("weights and max_epochs can't be negative")
    named = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in targets.items()], "named string, target double")
    sizes = docs.groupBy("source").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("double").alias("chars"))
    sizes = sizes.join(F.broadcast(named) if len(targets) <= BROADCAST_SOURCES else named, F.col("source") == F.col("named"), "left")
    sizes = sizes.select("source", "chars", F.coalesce("target", F.lit(float(default_weight))).alias("weight"))
    # one row a source: the sorted pass is over as many rows as there are sources, after partial sums
    live = (F.col("chars") > 0) & (F.col("weight") > 0)
    ordered = Window.partitionBy("live").orderBy(F.try_divide(F.col("chars") * max_epochs, "weight"), "source")
    everything = Window.partitionBy(F.lit(0))
    first = sizes.withColumn("live", live).withColumn("total", F.lit(float(budget)) if budget is not None else F.sum("chars").over(everything))
    before = F.coalesce(F.sum(F.col("chars") * max_epochs).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = first.withColumn("level", F.when(F.col("live"), F.try_divide(F.col("total") - before, left)))
    clamped = F.col("live") & (F.col("chars") * max_epochs <= F.col("level") * F.col("weight"))
    level = F.min(F.when(F.col("live") & ~F.col("clamped"), F.struct(F.try_divide(F.col("chars") * max_epochs, "weight"), F.col("source"), F.col("level")))).over(everything)["level"]
    rate = F.when(~F.col("live"), 0.0).when(F.col("clamped"), float(max_epochs)).otherwise(F.least(F.lit(float(max_epochs)), F.try_divide(F.col("water") * F.col("weight"), "chars")))
    return levels.withColumn("clamped", clamped).withColumn("water", level).select("source", "chars", "weight", F.round(rate, DECIMALS).alias("epochs"), "clamped")


def mix(docs: DataFrame, targets: Mapping[str, float] | None = None, *, default_weight: float = DEFAULT_WEIGHT, max_epochs: float = MAX_EPOCHS, budget: float | None = None, seed: int = SEED, copy_column: str | None = None) -> DataFrame:
    """docs with each row as often as its source's epochs say, all columns as they were (and copy_column, 0 for the first copy).

    If docs has a column of that name (in any case) the new one is copy_column_, and so on.

    A row's fraction is decided by the hash of the seed and its doc_id, for a null doc_id by its text: repeated rows share
    one fate. Rows with a null text are sampled like all others. Columns of any other name stay; helper columns
    take names that docs doesn't have. An empty table gives an empty table.
    """
    targets = TARGETS if targets is None else targets
    rates = write(epochs(docs, targets, default_weight=default_weight, max_epochs=max_epochs, budget=budget).select("source", "epochs"))
    rate, copies, source = (unused(n, docs.columns) for n in ("mix_epochs", "mix_copies", "mix_source"))
    rates = rates.select(F.col("source").alias(source), F.col("epochs").alias(rate))
    small = rates.count() <= BROADCAST_SOURCES
    joined = docs.join(F.broadcast(rates) if small else rates, F.col("source").eqNullSafe(F.col(source)))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), "text", F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    number = (F.floor(rate) + F.when(draw < F.col(rate) - F.floor(rate), 1).otherwise(0)).cast("int")
    taken = joined.withColumn(copies, number).where(F.col(copies) > 0)
    names = [F.col(f"`{c}`") for c in docs.columns]
    copy = unused(copy_column, docs.columns) if copy_column else copies
    out = taken.select(*names, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)).alias(copy))
    return out if copy_column else out.drop(copy)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs.select("doc_id", "source", "text"), copy_column="copy").select("doc_id", "source", "copy")


_WEIGHT = "CASE " + " ".join(f"WHEN source = '{s}' THEN {w}::DOUBLE" for s, w in TARGETS.items()) + f" ELSE {DEFAULT_WEIGHT}::DOUBLE END"
QUERIES = {"op2_mixing": op2_mixing}
#: Redistribution round by round, as the definition has it: clamp what is over, share the rest, until nothing is over.
ORACLE_SQL = {
    "op2_mixing": f"""
        WITH RECURSIVE sizes AS (
          SELECT source, coalesce(sum(length(text)), 0)::DOUBLE AS chars, {_WEIGHT} AS weight FROM documents GROUP BY source),
        live AS (SELECT *, row_number() OVER (ORDER BY chars * {MAX_EPOCHS} / weight, source) AS place, sum(chars) OVER () AS budget
          FROM sizes WHERE chars > 0 AND weight > 0),
        rounds(round, clamped, level) AS (
          SELECT 0, 0::BIGINT, (SELECT max(budget) / sum(weight) FROM live)
          UNION ALL
          SELECT round + 1, n.clamped, n.level FROM rounds r, LATERAL (
            SELECT count(*) FILTER (WHERE chars * {MAX_EPOCHS} <= r.level * weight) AS clamped,
              (max(budget) - coalesce(sum(chars * {MAX_EPOCHS}) FILTER (WHERE chars * {MAX_EPOCHS} <= r.level * weight), 0))
                / nullif(sum(weight) FILTER (WHERE chars * {MAX_EPOCHS} > r.level * weight), 0) AS level
            FROM live) n WHERE n.clamped > r.clamped),
        last AS (SELECT arg_max(level, round) AS level FROM rounds),
        rates AS (SELECT source, round(CASE WHEN chars = 0 OR weight = 0 THEN 0
            WHEN (SELECT level FROM last) IS NULL OR chars * {MAX_EPOCHS} <= (SELECT level FROM last) * weight THEN {MAX_EPOCHS}
            ELSE (SELECT level FROM last) * weight / chars END, {DECIMALS}) AS epochs FROM sizes),
        counted AS (SELECT doc_id, d.source, (floor(epochs) + CASE WHEN
            ('0x' || substr(md5('{SEED}/' || coalesce(doc_id::VARCHAR, text, '')), 1, 8))::BIGINT / 4294967296.0 < epochs - floor(epochs)
            THEN 1 ELSE 0 END)::INT AS copies FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source)
        SELECT doc_id, source, unnest(range(copies))::INT AS copy FROM counted""",
}
