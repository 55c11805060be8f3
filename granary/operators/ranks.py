"""Ranks and running totals without a window over all rows of a group, and joins that spread one key's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS, WAYS = 32, 16


def _equal(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def dealt(rows: DataFrame) -> DataFrame:
    """rows on as many partitions as there are cores, if they are on fewer: a file with a single row group is one task, which is too few
    for work in Python. Tables of many files stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def spread_join(rows: DataFrame, small: DataFrame, on: list[str], by: list[str], how: str = "inner", ways: int = WAYS) -> DataFrame:
    """rows joined to a table with one row for each key. A key may have most of all rows, so each key is dealt over `ways` tasks by the
    hash of `by`, and the table, which has a row for each key only, is copied to them."""
    dealt = rows.withColumn("_way", F.pmod(F.xxhash64(*by), F.lit(ways)).cast("int"))
    return dealt.join(small.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))), [*on, "_way"], how).drop("_way")


def running(rows: DataFrame, group: list[str], value: str, **sums: Column) -> DataFrame:
    """A row for each group and value: the sums over it, `<name>_before` over smaller values, `<name>_all` over the group. Values are
    cut at quantiles of the table, so that a window never holds more than a part of a group."""
    cuts = rows.agg(F.percentile_approx(value, [i / CUTS for i in range(1, CUTS)], 1000)).head()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(value) > c)) if cuts else F.lit(0)
    c = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(*(x.alias(n) for n, x in sums.items())).withColumn("_part", part)
    parts = c.groupBy(*group, "_part").agg(*(F.sum(n).alias(f"_{n}") for n in sums))
    own, upto = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*group, "_part", *(F.coalesce(F.sum(f"_{n}").over(upto), F.lit(0)).alias(f"_{n}_base") for n in sums), *(F.sum(f"_{n}").over(own).alias(f"{n}_all") for n in sums))
    w = Window.partitionBy(*group, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inner = c.select("*", *(F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"_{n}_in") for n in sums))
    met = inner.join(parts, _equal(inner, parts, [*group, "_part"]))
    return met.select(*(inner[n] for n in group), value, *sums, *((F.col(f"_{n}_base") + F.col(f"_{n}_in")).alias(f"{n}_before") for n in sums), *(f"{n}_all" for n in sums))


def hash_rank(rows: DataFrame, strata: list[str], hashed: Column, name: str = "k") -> DataFrame:
    """rows with their place (from 1) by a hash in hexadecimal digits within each stratum. Hashes are even, so that their first two
    digits cut a stratum into 256 parts, each with a window of its own."""
    cut = rows.withColumn("_h", hashed).withColumn("_part", F.substring("_h", 1, 2))
    base = cut.groupBy(*strata, "_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*strata).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select(*strata, "_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_base"))
    inner = cut.withColumn("_in", F.row_number().over(Window.partitionBy(*strata, "_part").orderBy("_h")))
    met = inner.join(base, _equal(inner, base, [*strata, "_part"]))
    return met.select(*(inner[c] for c in rows.columns), (F.col("_base") + F.col("_in")).alias(name))
