"""JSON members of annotation strings as typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def integer(raw: str, member: str) -> Column:
    return F.expr(f"try_variant_get(try_parse_json({raw}), '$.{member}', 'bigint')")


def double(raw: str, member: str) -> Column:
    """0 where the member is missing."""
    return F.coalesce(F.expr(f"try_variant_get(try_parse_json({raw}), '$.{member}', 'double')"), F.lit(0.0))


def boolean(raw: str, member: str) -> Column:
    """Members that are 0 or 1."""
    return F.coalesce(F.expr(f"try_variant_get(try_parse_json({raw}), '$.{member}', 'int') <> 0"), F.lit(False))


def doubles(raw: str, member: str) -> Column:
    return F.from_json(raw, f"struct<{member}: array<double>>")[member]


def rings(raw: str, member: str) -> Column:
    return F.from_json(raw, f"struct<{member}: array<array<double>>>")[member]


def item(raw: str, member: str, place: int) -> Column:
    """A double in an array, counted from 1; 0 where it is missing."""
    return F.coalesce(F.get_json_object(raw, f"$.{member}[{place - 1}]").cast("double"), F.lit(0.0))


def length(raw: str, member: str) -> Column:
    return F.coalesce(F.json_array_length(F.get_json_object(raw, f"$.{member}")), F.lit(0))
