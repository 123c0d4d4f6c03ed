"""Tables in and out of files, their schemas, and contracts on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

FORMATS = ("parquet", "orc", "csv", "json", "text", "delta")


class ContractError(ValueError):
    """A relation isn't as its contract says."""


def read(spark: SparkSession, path: str, *, format: str = "parquet", schema: StructType | None = None, streaming: bool = False, **options) -> DataFrame:
    """A relation from files. A stream needs its schema."""
    if format not in FORMATS:
        raise ValueError(f"format is one of {', '.join(FORMATS)}")
    if streaming and schema is None:
        raise ValueError("a stream of files needs a schema")
    reader = (spark.readStream if streaming else spark.read).format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, *, format: str = "parquet", mode: str = "error", partition_by: Sequence[str] = (), **options) -> None:
    writer = df.write.format(format).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def optional_input(spark: SparkSession, df: DataFrame | None, schema: StructType) -> DataFrame:
    """df, or an empty relation of the schema."""
    return spark.createDataFrame([], schema) if df is None else df


def inspect_schema(spark: SparkSession, *, path: str | None = None, table: str | None = None, format: str = "parquet", **options) -> StructType:
    """The schema of files or of a table."""
    if (path is None) == (table is None):
        raise ValueError("path or table, one of them")
    return spark.table(table).schema if table else spark.read.format(format).options(**options).load(path).schema


def schema_source(schema: StructType, name: str = "SCHEMA") -> str:
    """Python that makes the schema."""
    fields = "".join(f"    StructField({f.name!r}, _parse_datatype_string({f.dataType.simpleString()!r}), {f.nullable}),\n" for f in schema.fields)
    return f"from pyspark.sql.types import StructField, StructType, _parse_datatype_string\n\n{name} = StructType([\n{fields}])\n"


def merge_schemas(*schemas: StructType) -> StructType:
    """All fields in order; a later field of the same name takes the earlier one's place."""
    fields: dict[str, StructField] = {}
    for schema in schemas:
        fields |= {f.name: f for f in schema.fields}
    return StructType(list(fields.values()))


def conform(df: DataFrame, schema: StructType, *, mode: str = "strict") -> DataFrame:
    """df with the columns of the schema in their order. strict: no others; allow: others are kept behind; project: others are dropped.

    Missing columns and other types raise. Nullability isn't checked against the data.
    """
    if mode not in ("strict", "allow", "project"):
        raise ValueError("mode is strict, allow or project")
    have = {f.name: f.dataType for f in df.schema.fields}
    wanted = {f.name: f.dataType for f in schema.fields}
    if missing := [n for n in wanted if n not in have]:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    if other := [n for n in wanted if _bare(have[n]) != _bare(wanted[n])]:
        raise ContractError("other types: " + ", ".join(f"{n} is {have[n].simpleString()}, not {wanted[n].simpleString()}" for n in other))
    extra = [n for n in have if n not in wanted]
    if extra and mode == "strict":
        raise ContractError(f"extra columns: {', '.join(extra)}")
    return df.select(*[F.col(f"`{n}`") for n in wanted], *[F.col(f"`{n}`") for n in extra if mode == "allow"])


def _bare(kind) -> str:
    return kind.simpleString()


def from_sources(target: StructType, sources: Mapping[str, DataFrame], joined: DataFrame) -> DataFrame:
    """Each target field from the only source that has it; fields that several sources have or none has are left out."""
    owner = {f.name: [a for a, df in sources.items() if f.name in df.columns] for f in target.fields}
    return joined.select(*[F.col(f"{a[0]}.{n}").alias(n) for n, a in owner.items() if len(a) == 1])


def rename_outputs(outputs: Mapping[str, DataFrame], names: Mapping[str, str]) -> dict[str, DataFrame]:
    """A pipeline's results under other names."""
    return {names.get(n, n): df for n, df in outputs.items()}
