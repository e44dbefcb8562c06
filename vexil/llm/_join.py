"""Joins that look up a unique key, however hot some keys are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 1000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, hot_keys: int = HOT, counted: bool = False) -> DataFrame:
    """rows left-joined with table (unique keys, never null); the ``hot_keys`` keys of most weight are broadcast.

    Where weight is the number of a key's rows, no other key then has more than 1 / hot_keys of the rows.
    With ``counted`` the table, which should be materialized, is counted first and broadcast whole if it has no more than ``hot_keys`` rows.
    """
    if counted and table.limit(hot_keys + 1).count() <= hot_keys:
        return rows.join(F.broadcast(table), keys, "left")
    values = [c for c in table.columns if c not in keys]
    hot = table.orderBy(F.col(weight).desc(), *keys).limit(hot_keys)
    tried = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    there = tried.where("__hot").drop("__hot")
    rest = tried.where("__hot is null").drop("__hot", *values).join(table, keys, "left")
    return there.unionByName(rest)
