"""Profiles and reports: nested keys, text structure, cross tables, rubric data, logs, boards, graph tables, and reports put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.metrics import nearest_rank


def key_presence(rows: DataFrame, json: str, group: list[str]) -> DataFrame:
    """(group, key, n): how many JSON objects of a group have a key at their top."""
    return rows.select(*group, F.explode(F.json_object_keys(F.col(json))).alias("key")).groupBy(*group, "key").agg(F.count(F.lit(1)).alias("n"))


def length_profile(rows: DataFrame, group: list[str], text: str) -> DataFrame:
    """Least, largest and three quantiles of lengths, by nearest rank."""
    x = rows.select(*group, F.length(text).alias("len"))
    ends = x.groupBy(*group).agg(F.min("len").alias("least"), F.max("len").alias("largest"))
    return ends.join(nearest_rank(x, group, "len", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, "round"), group)


def structure_counts(text: Column, patterns: dict[str, str]) -> list[Column]:
    """How often each pattern stands in a text."""
    return [F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p)).cast("long").alias(n) for n, p in patterns.items()]


def cross_table(rows: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n, pct of the row)."""
    n = rows.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(row)), 2))


def rubric_profile(cases: DataFrame, dimensions: list[str]) -> DataFrame:
    """From (split, case_id, rubrics: array of criterion, point, dimension) one row per split: cases, criteria per case (mean, least, most), how
    many points are above, at and below zero, their sums, and criteria of a dimension that is not expected."""
    each = cases.select("split", "case_id", F.size("rubrics").alias("k"), F.explode_outer("rubrics").alias("r"))
    p = F.col("r.point")
    points = each.groupBy("split").agg(
        F.count_if(p > 0).alias("n_plus"), F.count_if(p == 0).alias("n_zero"), F.count_if(p < 0).alias("n_minus"), F.sum(F.when(p > 0, p).otherwise(0)).alias("sum_plus"), F.sum(F.when(p < 0, p).otherwise(0)).alias("sum_minus"),
        F.count_if(~F.col("r.dimension").isin(*dimensions)).alias("n_unexpected"),
    )
    sizes = cases.groupBy("split").agg(F.count(F.lit(1)).alias("n_cases"), F.avg(F.size("rubrics")).alias("k_mean"), F.min(F.size("rubrics")).alias("k_least"), F.max(F.size("rubrics")).alias("k_most"))
    return sizes.join(points, "split")


def scoped_ids(rows: DataFrame, scope: str, key: str) -> DataFrame:
    """(key, n_scopes, n): keys that occur more than once, in how many scopes and rows; only scope and key together tell rows apart."""
    return rows.groupBy(key).agg(F.countDistinct(scope).alias("n_scopes"), F.count(F.lit(1)).alias("n")).where("n > 1")


def answer_report(log: DataFrame, group: list[str], empty_share: float = 0.05) -> DataFrame:
    """From answers (answer, error, output_tokens): good and failed ones, the share of good ones without text, whether that is low enough,
    and quantiles of tokens."""
    good = F.coalesce("error", F.lit("")) == ""
    x = log.groupBy(*group).agg(F.count_if(good).alias("n_ok"), F.count_if(~good).alias("n_err"), F.count_if(good & (F.trim(F.coalesce("answer", F.lit(""))) == "")).alias("n_empty"))
    x = x.withColumn("ok", F.col("n_empty") < empty_share * F.col("n_ok"))
    return x.join(nearest_rank(log.where(good), group, "output_tokens", {"p50": 0.5, "p90": 0.9}, "last"), group, "left")


def stage_board(stages: DataFrame) -> DataFrame:
    """From (stage, lines, expected, marker, rc): done, failed, running, partial or waiting, with what has been made of what is expected."""
    done = F.col("marker") & (F.coalesce("rc", F.lit(0)) == 0) & (F.col("lines") >= F.col("expected"))
    status = F.when(F.coalesce("rc", F.lit(0)) != 0, "failed").when(done, "done").when((F.col("lines") > 0) & F.col("rc").isNull(), "running").when(F.col("lines") > 0, "partial").otherwise("waiting")
    return stages.select("stage", status.alias("status"), F.concat_ws("/", F.col("lines").cast("string"), F.col("expected").cast("string")).alias("progress"))


def statute_registration(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From articles (uid, domain, law_type, status, level, text_full): counts by each of the four columns; and rows, keys that are there again,
    and rows without their whole text."""
    by = F.explode(F.create_map(*(x for c in ("domain", "law_type", "status", "level") for x in (F.lit(c), F.coalesce(c, F.lit(""))))))
    counts = rows.select(by.alias("column", "value")).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), (F.count("uid") - F.countDistinct("uid")).alias("again"), F.count_if(F.coalesce("text_full", F.lit("")) == "").alias("no_text"))
    return counts, whole


def attached(nodes: DataFrame, dimension: DataFrame, key: str, node: str) -> DataFrame:
    """(node, key) for nodes whose key a dimension has; a node without a match gives no edge."""
    return nodes.select(node, key).join(dimension.select(key).distinct(), key, "left_semi").select(node, key)


def assembled(key: str, order: DataFrame, **reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each of `order` with the columns of all reports, null where a report lacks it; and warnings (key, report)."""
    out = reduce(lambda a, name: a.join(reports[name].withColumn(f"_{name}", F.lit(True)), key, "left"), reports, order)
    missing = F.filter(F.array(*(F.when(F.col(f"_{n}").isNull(), F.lit(n)) for n in reports)), lambda x: x.isNotNull())
    warnings = out.select(key, F.explode(missing).alias("report"))
    return out.drop(*(f"_{n}" for n in reports)), warnings


def hottest(nodes: DataFrame, n: int = 20) -> DataFrame:
    return nodes.orderBy(F.col("hotness").desc(), "doc_id").limit(n)


def examples(rows: DataFrame, group: list[str], order: list[str], n: int = 20) -> DataFrame:
    """The first rows of each group, for a report."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def at_most(rows: DataFrame, n: int | None) -> DataFrame:
    """A trial run over some rows only, or all of them."""
    return rows if n is None else rows.limit(n)


def valid_at(rows: DataFrame, cases: DataFrame, key: str, date: str, since: str = "effective_from", until: str = "effective_to") -> DataFrame:
    """cases joined to the version of each key that was in force on their date: since <= date, and until > date or open."""
    return cases.join(rows, key).where((F.col(since) <= F.col(date)) & (F.col(until).isNull() | (F.col(until) > F.col(date))))


def star_links(rows: DataFrame, key: str, hashed: Column) -> DataFrame:
    """(key, hub): rows of equal content that is not empty, and the least of their keys, where there are two or more."""
    from granary.operators.ranks import spread_join

    x = rows.select(key, hashed.alias("_h")).where(F.coalesce("_h", F.lit("")) != "")
    hubs = x.groupBy("_h").agg(F.min(key).alias("hub"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return spread_join(x, hubs, ["_h"], [key]).select(key, "hub").where(F.col(key) != F.col("hub"))
