"""JSON, CSV, Variant and geometry columns, and struct fields."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import is_variant_null, parse_json, schema_of_variant, to_variant_object, try_parse_json  # noqa: F401
from pyspark.sql.types import StructType


class Unavailable(NotImplementedError):
    """The installed Spark has no such function, or no provider of it is there."""


def _options(options: Mapping[str, object] | None) -> dict[str, str]:
    return {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in (options or {}).items()}


def from_json(value, *, schema: StructType | str, options: Mapping[str, object] | None = None) -> Column:
    return F.from_json(value, schema, _options(options))


def to_json(value, *, options: Mapping[str, object] | None = None) -> Column:
    return F.to_json(value, _options(options))


def from_csv(value, *, schema: StructType | str, options: Mapping[str, object] | None = None) -> Column:
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) if isinstance(schema, StructType) else schema
    return F.from_csv(value, ddl, _options(options))


def to_csv(value, *, options: Mapping[str, object] | None = None) -> Column:
    return F.to_csv(value, _options(options))


def variant_literal(json_text: str) -> Column:
    return F.parse_json(F.lit(json_text))


def variant_get(value, path: str, *, as_type: str) -> Column:
    return F.variant_get(value, path, as_type)


def try_variant_get(value, path: str, *, as_type: str) -> Column:
    return F.try_variant_get(value, path, as_type)


def with_field(value, name: str, new) -> Column:
    return (F.col(value) if isinstance(value, str) else value).withField(name, new)


def drop_fields(value, *names: str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).dropFields(*names)


def _later(name: str):
    """A function of newer Sparks: passed on where it exists."""

    def call(*args) -> Column:
        if not hasattr(F, name):
            raise Unavailable(f"{name} needs a newer Spark")
        return getattr(F, name)(*args)

    call.__name__ = name
    return call


is_valid_variant = _later("is_valid_variant")
variant_array_append = _later("variant_array_append")
try_variant_array_append = _later("try_variant_array_append")
variant_insert = _later("variant_insert")
try_variant_insert = _later("try_variant_insert")
variant_set = _later("variant_set")
try_variant_set = _later("try_variant_set")
variant_delete = _later("variant_delete")


def _spatial(spark, function: str, *args) -> Column:
    if not spark.catalog.functionExists(function):
        raise Unavailable(f"{function} needs a geometry provider")
    return F.call_function(function, *args)


def geometry_from_wkt(spark, value, *, srid: int) -> Column:
    return _spatial(spark, "ST_GeomFromWKT", value, F.lit(srid))


def geometry_as_wkt(spark, value) -> Column:
    return _spatial(spark, "ST_AsText", value)


def intersects(spark, left, right) -> Column:
    return _spatial(spark, "ST_Intersects", left, right)


def contains(spark, left, right) -> Column:
    return _spatial(spark, "ST_Contains", left, right)


def within(spark, left, right) -> Column:
    return _spatial(spark, "ST_Within", left, right)
