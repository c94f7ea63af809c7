"""Manifests: which section lies where, and which belong to one experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def experiments(rows: DataFrame, order: str, folder: str) -> DataFrame:
    """rows with experiment: how many times the folder has changed up to a row, from 1.

    A manifest is one small file with an order of its own, so one window over it is enough.
    """
    w = Window.orderBy(order)
    new = F.when(F.lag(folder).over(w).eqNullSafe(F.col(folder)), 0).otherwise(1)
    return rows.withColumn("new_", new).withColumn("experiment", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")


def valid_sections(manifest: DataFrame, excludes: DataFrame, key: str) -> DataFrame:
    """The manifest without excluded sections."""
    return manifest.join(excludes.select(key).distinct(), key, "left_anti")
