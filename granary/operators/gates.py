"""Quality gates: named checks as rows (check, expected, actual, ok). A check that compared nothing has failed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(name: str, rows: DataFrame, actual: Column, expected: int = 0) -> DataFrame:
    """One aggregate against one number."""
    return rows.agg(F.coalesce(actual, F.lit(0)).cast("long").alias("actual"), F.count(F.lit(1)).alias("_n")).select(
        F.lit(name).alias("check"), F.lit(expected).cast("long").alias("expected"), "actual", ((F.col("actual") == expected) & (F.col("_n") > 0)).alias("ok")
    )


def all_checks(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def unique(name: str, rows: DataFrame, key: str) -> DataFrame:
    return check(name, rows, F.count(key) - F.countDistinct(key))


def disjoint(rows: DataFrame, split: str, key: str) -> DataFrame:
    """(a, b, shared): how many keys two splits have in common, for all pairs of splits. One shuffle by key; a key gives a row for each
    pair of splits that it is in, and splits are few."""
    names = F.array_sort(F.collect_set(split))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    met = rows.groupBy(key).agg(names.alias("s")).where(F.size("s") > 1)
    return met.select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
