"""Rule-weighted labels and filters of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_reason(output: Column, asked: Column, least_output: int = 8, least_asked: int = 4, must: str | None = None) -> Column:
    """The first rule that a record fails, or null."""
    out = F.when(F.coalesce(F.length(F.trim(output)), F.lit(0)) == 0, "empty_output").when(F.length(output) < least_output, "short_output")
    out = out.when(F.coalesce(F.length(asked), F.lit(0)) < least_asked, "short_input")
    return out if must is None else out.when(~F.concat(F.coalesce(asked, F.lit("")), output).rlike(must), "no_match")


def vote(signals: DataFrame, order: list[str], least: float = 0.6, default: str = "general") -> DataFrame:
    """From (uid, domain, signal, signal_ord, amount): domain (the most; ties by order), domains (at least a share of the most, in
    order), source (the signal that gave the winner most; ties by signal_ord) and scores. Without a positive score: the default."""
    place = F.create_map(*(x for i, d in enumerate(order) for x in (F.lit(d), F.lit(i))))
    by_signal = signals.groupBy("uid", "domain", "signal").agg(F.sum("amount").alias("amount"), F.min("signal_ord").alias("o"))
    by_domain = by_signal.groupBy("uid", "domain").agg(F.sum("amount").alias("score"), F.max_by("signal", F.struct("amount", -F.col("o"))).alias("source"))
    ranked = by_domain.withColumn("i", place[F.col("domain")]).groupBy("uid").agg(F.max(F.struct("score", -F.col("i"), "domain", "source")).alias("best"), F.collect_list(F.struct("i", "domain", "score")).alias("all"))
    some = F.col("best.score") > 0
    labels = F.transform(F.array_sort(F.filter("all", lambda x: x["score"] >= least * F.col("best.score"))), lambda x: x["domain"])
    return ranked.select(
        "uid",
        F.when(some, F.col("best.domain")).otherwise(default).alias("domain"),
        F.when(some, labels).otherwise(F.array(F.lit(default))).alias("domains"),
        F.when(some, F.col("best.source")).otherwise("fallback").alias("domain_source"),
        F.map_from_entries(F.array_sort(F.transform("all", lambda x: F.struct(x["domain"], x["score"])))).alias("scores"),
    )


def decide(scores: Column, labels: list[str], threshold: float = 0.6, most: int = 2) -> Column:
    """A router's decision from an array of scores: routed, cross (several), or fallback (none, or too many)."""
    n = F.size(F.filter(scores, lambda s: s >= threshold))
    return F.when(n == 0, "fallback").when(n == 1, "routed").when(n < most, "cross").otherwise("fallback")
