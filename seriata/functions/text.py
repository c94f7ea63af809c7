"""Parsing of the text side-files: coordinates, manifests, lists, key-value metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_integer_text(s: Column) -> Column:
    """Whether a text is an integer, with a sign and trailing .000 allowed."""
    return s.rlike(r"^[+-]?[0-9]+(\.0*)?$")


def trailing_number(s: Column) -> Column:
    """The last run of digits at the end of a text as a number; null without one."""
    return F.regexp_extract(s, r"([0-9]+)$", 1).try_cast("bigint")


def parse_coordinates(lines: DataFrame, value: str = "value") -> DataFrame:
    """path, mfov_id, tile_id, x, y of coordinate rows 'path x y ...'; mfov and tile numbers of the base name count from 0."""
    row = lines.where(~F.col(value).startswith("#") & (F.trim(value) != "")).select(F.split(F.trim(value), r"\s+").alias("f"))
    path = F.regexp_replace(F.get("f", F.lit(0)), r"\\", "/")
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1), r"^thumbnail_", "")
    parts = F.split(name, "_")
    return row.select(path.alias("path"), (F.get(parts, F.lit(1)).try_cast("int") - 1).alias("mfov_id"), (F.get(parts, F.lit(2)).try_cast("int") - 1).alias("tile_id"), F.get("f", F.lit(1)).try_cast("double").alias("x"), F.get("f", F.lit(2)).try_cast("double").alias("y"))


def parse_parameters(lines: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """key, values of the requested '#key v...' lines."""
    f = F.split(F.trim(F.substring(value, F.lit(2), F.length(value))), r"\s+")
    return lines.where(F.col(value).startswith("#")).select(F.get(f, F.lit(0)).alias("key"), F.transform(F.slice(f, 2, F.size(f)), lambda v: v.try_cast("double")).alias("values")).where(F.col("key").isin(keys))


def parse_key_values(lines: DataFrame, value: str = "value") -> DataFrame:
    """key, rest of lines 'key:rest', split at the first colon."""
    f = F.split(value, ":", 2)
    return lines.where(F.col(value).contains(":")).select(F.trim(F.get(f, F.lit(0))).alias("key"), F.trim(F.get(f, F.lit(1))).alias("rest"))


def parse_numbers(lines: DataFrame, value: str = "value") -> DataFrame:
    """place, number of all integers outside # comments, in order of line and place in it. lines: (line, value)."""
    text = F.regexp_replace(value, r"#.*", "")
    return lines.select("line", F.posexplode(F.regexp_extract_all(text, F.lit(r"([0-9]+)"), F.lit(1))).alias("place", "number")).select("line", "place", F.col("number").cast("long").alias("number"))


def format_coordinates(tiles: DataFrame, path: str = "path", x: str = "x", y: str = "y") -> DataFrame:
    """value: lines 'path x y' with 0 for what is not finite; rows without a path are skipped."""
    number = lambda c: F.format_string("%.6f", F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.col(c)))
    return tiles.where(F.col(path).isNotNull()).select(F.concat_ws(" ", path, number(x), number(y)).alias("value"))
