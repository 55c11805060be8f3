"""Statistics and scores over answer, rank and label tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.text import choice_letters, is_choice, statute_set, strip
from granary.operators.ranks import dealt, running
from granary.operators.resampling import drawn


def nearest_rank(rows: DataFrame, group: list[str], value: str, shares: dict[str, float], rule: str = "n") -> DataFrame:
    """Quantiles without interpolation. The place in sorted order, from 0: `n` floor(n * q); `capped` the same, at most n - 1;
    `last` floor(q * (n - 1)); `round` q * (n - 1) rounded half to even. From counts by value; no list of values is collected."""
    n = F.col("n_all")
    place = {
        "n": lambda q: F.floor(n * q),
        "capped": lambda q: F.least(n - 1, F.floor(n * q)),
        "last": lambda q: F.floor(F.lit(q) * (n - 1)),
        "round": lambda q: F.bround(F.lit(q) * (n - 1)),
    }[rule]
    upto = F.col("n_before") + F.col("n")
    return running(rows, group, value, n=F.count(F.lit(1))).groupBy(*group).agg(*(F.min(F.when(upto > F.least(n - 1, place(q)), F.col(value))).alias(name) for name, q in shares.items()))


def percentiles(rows: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles with linear interpolation between neighbours, from counts by value."""
    counted = running(rows, group, value, n=F.count(F.lit(1)))
    at = lambda q: F.lit(q) * (F.col("n_all") - 1)
    has = lambda k: F.min(F.when(F.col("n_before") + F.col("n") > k, F.col(value)))
    sides = [x for name, q in shares.items() for x in (has(F.floor(at(q))).alias(f"_{name}_lo"), has(F.ceil(at(q))).alias(f"_{name}_hi"))]
    x = counted.groupBy(*group).agg(F.max("n_all").alias("n_all"), *sides)
    part = lambda q: at(q) - F.floor(at(q))
    return x.select(*group, *((F.col(f"_{name}_lo") + part(q) * (F.col(f"_{name}_hi") - F.col(f"_{name}_lo"))).alias(name) for name, q in shares.items()))


def average_ranks(rows: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """(group, value, rank from 1, ties at their mean), a row for each value."""
    return running(rows, group, value, n=F.count(F.lit(1))).select(*group, value, (F.col("n_before") + (F.col("n") + 1) / 2.0).alias(name), F.col("n_all").alias(f"{name}_n"))


def correlations(rows: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """pearson and spearman by group; null with fewer than two rows or without variance. Rows with both values count. Ranks are those of
    counts by value, and pairs of values are summed up before ranks are joined to them."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    sure = (F.count(F.lit(1)) > 1) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    linear = both.groupBy(*group).agg(F.when(sure, F.corr(x, y)).alias("pearson"))
    pairs = both.groupBy(*group, x, y).agg(F.count(F.lit(1)).alias("_c"))
    ranked = pairs.join(average_ranks(both, group, x, "_rx"), [*group, x]).join(average_ranks(both, group, y, "_ry"), [*group, y])
    dx, dy = F.col("_rx") - (F.col("_rx_n") + 1) / 2.0, F.col("_ry") - (F.col("_ry_n") + 1) / 2.0
    c = F.col("_c")
    s = ranked.groupBy(*group).agg(F.sum(c * dx * dy).alias("xy"), F.sum(c * dx * dx).alias("xx"), F.sum(c * dy * dy).alias("yy"))
    rank = s.select(*group, F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("spearman"))
    return linear.join(rank, group, "left")


def summary(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    return rows.groupBy(*group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"), F.min(value).alias("lo"), F.max(value).alias("hi")
    )


#: Sums that a task holds before it hands them on.
HELD = 4_000_000


def resampled(rows: DataFrame, group: list[str], key: str, iterations: int, seed: str, **values: Column) -> DataFrame:
    """(group, iteration, w, sums of values) of resamples: in each iteration a row counts as often as a Poisson law has it, by the hash of
    seed, iteration and key. So rows need not meet: every task sums up its own, and any engine draws the same. Hashes are made in
    arrays: as expressions, each costs ten times as much. Values are not null."""
    names = list(values)
    each = dealt(rows.select(*group, F.col(key).cast("string").alias("_key"), *(v.cast("double").alias(n) for n, v in values.items())))
    schema = T.StructType([*(each.schema[g] for g in group), T.StructField("iteration", T.IntegerType()), T.StructField("w", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []

        def told() -> Iterator[pa.RecordBatch]:
            for g, x in sums.items():
                columns = [pa.array([v] * iterations, kind) for v, kind in zip(g, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(1, iterations + 1, dtype=np.int32)), pa.array(x[0].astype(np.int64)), *(pa.array(y) for y in x[1:])], [*group, "iteration", "w", *names])

        for batch in batches:
            kinds = [batch.schema.field(g).type for g in group]
            groups = list(zip(*(batch.column(g).to_pylist() for g in group), strict=True)) or [()] * batch.num_rows
            numbers = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            order = sorted(set(groups), key=repr)
            most = max(1, HELD // (iterations * (1 + len(names))))
            for first in range(0, len(order), most):
                now = set(order[first : first + most])
                if len(now | sums.keys()) > most:
                    yield from told()
                    sums.clear()
                for g in now - sums.keys():
                    sums[g] = np.zeros((1 + len(names), iterations))
                places = [i for i, g in enumerate(groups) if g in now]
                keys = batch.column("_key").take(pa.array(places)).to_pylist()
                for at, start, counts in drawn(seed, keys, iterations):
                    x, i = sums[groups[places[at]]], places[at]
                    x[0, start : start + len(counts)] += counts
                    for k, n in enumerate(numbers, 1):
                        x[k, start : start + len(counts)] += counts * n[i]
        yield from told()

    return each.mapInArrow(run, schema).groupBy(*group, "iteration").agg(F.sum("w").alias("w"), *(F.sum(n).alias(n) for n in names)).where("w > 0")


def _interval(means: DataFrame, group: list[str], level: float) -> DataFrame:
    """(group, ci_lo, ci_hi) of resampled means, of which there are as many as iterations in each group."""
    side = (1 - level) / 2
    x = means.groupBy(*group).agg(F.percentile("m", [side, 1 - side]).alias("p"))
    return x.select(*group, F.get("p", F.lit(0)).alias("ci_lo"), F.get("p", F.lit(1)).alias("ci_hi"))


def bootstrap(rows: DataFrame, group: str, key: str, value: str, iterations: int = 10_000, level: float = 0.95, seed: str = "42") -> DataFrame:
    """(group, mean, ci_lo, ci_hi): percentile interval of the mean, over resamples."""
    some = rows.where(F.col(value).isNotNull())
    means = resampled(some, [group], key, iterations, seed, total=F.col(value)).select(group, (F.col("total") / F.col("w")).alias("m"))
    return some.groupBy(group).agg(F.avg(value).alias("mean")).join(_interval(means, [group], level), group)


def paired_bootstrap(rows: DataFrame, key: str, a: str, b: str, iterations: int = 10_000, level: float = 0.95, seed: str = "42") -> DataFrame:
    """One row: the mean gain of b over a, its interval, the share of resamples of centred gains that are as far out (p), wins, ties and losses."""
    some = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(key, (F.col(b) - F.col(a)).alias("d"))
    counts = paired_counts(some.withColumn("_0", F.lit(0.0)), "d", "_0")
    drawn = resampled(some, [], key, iterations, seed, total=F.col("d")).select((F.col("total") / F.col("w")).alias("m"))
    interval = _interval(drawn, [], level)
    far = drawn.crossJoin(F.broadcast(counts.select("diff"))).agg((F.count_if(F.abs(F.col("m") - F.col("diff")) >= F.abs("diff")) + 1).alias("far"))  # one row is sent along
    return counts.crossJoin(F.broadcast(interval)).crossJoin(F.broadcast(far)).select(F.col("diff").alias("gain"), "ci_lo", "ci_hi", (F.col("far") / (iterations + 1)).alias("p"), "win", "tie", "loss")


def score_summary(rows: DataFrame, group: str, key: str, value: str, iterations: int = 10_000) -> DataFrame:
    """n, mean, stdev, least and largest, and the interval of the mean."""
    return summary(rows, [group], value).join(bootstrap(rows, group, key, value, iterations).drop("mean"), group, "left")


def paired_counts(rows: DataFrame, a: str, b: str, near: float = 1e-9) -> DataFrame:
    """wins, ties and losses of a against b, and the mean difference."""
    d = F.col(a) - F.col(b)
    return rows.agg(F.avg(d).alias("diff"), F.count_if(d > near).alias("win"), F.count_if(F.abs(d) <= near).alias("tie"), F.count_if(d < -near).alias("loss"))


def auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """Share of (positive, negative) pairs in which the positive scores more; ties count as lost. By running sums, not by pairs."""
    c = running(rows, [], score, p=F.count_if(F.col(positive)), n=F.count_if(~F.col(positive)))
    s = c.agg(F.sum(F.col("p") * F.col("n_before")).alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return s.select((F.col("won") / (F.col("p") * F.col("n"))).alias("auc"))


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence by characters, row by row in bits."""

    def one(x: str | None, y: str | None) -> int:
        if not x or not y:
            return 0
        at: dict[str, int] = {}
        for i, c in enumerate(x):
            at[c] = at.get(c, 0) | (1 << i)
        full, v = (1 << len(x)) - 1, (1 << len(x)) - 1
        for c in y:
            u = v & at.get(c, 0)
            v = ((v + u) | (v - u)) & full
        return len(x) - v.bit_count()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def rouge_l(prediction: Column, gold: Column, cap: int = 800, beta: float = 1.2) -> Column:
    """ROUGE-L F measure by characters, of heads of `cap` characters without blanks around, to four places."""
    p, g = F.substring(strip(prediction), 1, cap), F.substring(strip(gold), 1, cap)
    n = lcs_length(p, g)
    precision, recall = n / F.length(p), n / F.length(g)
    return F.when(n > 0, F.round((1 + beta * beta) * precision * recall / (recall + beta * beta * precision), 4)).otherwise(0.0)


def rouge_rollup(answers: DataFrame, group: list[str], predicted: str, gold: str, cap: int = 800) -> DataFrame:
    """Over rows with a reference: n, the mean, the upper median, and how many texts were cut."""
    some = answers.where(strip(F.coalesce(gold, F.lit(""))) != "")
    cut = (F.length(F.coalesce(predicted, F.lit(""))) > cap) | (F.length(gold) > cap)
    scored = some.select(*group, rouge_l(F.coalesce(predicted, F.lit("")), F.col(gold), cap).alias("f"), cut.alias("cut"))
    middle = nearest_rank(scored, group, "f", {"f_p50": 0.5})
    sums = scored.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f"), 4).alias("f_mean"), F.count_if("cut").alias("n_truncated"))
    return sums.join(middle, group) if group else sums.crossJoin(F.broadcast(middle))


def choice_accuracy(rows: DataFrame, group: list[str], answer: str, gold: str) -> DataFrame:
    """Of answers to choice questions (gold: one to five letters): n, exact, subset (all of gold is chosen) and unparsed. An answer
    without a letter is wrong."""
    letters = F.array_sort(F.array_distinct(F.filter(F.split(F.upper(strip(F.col(gold))), ""), lambda c: c != "")))
    x = rows.where(is_choice(F.col(gold))).select(*group, choice_letters(F.col(answer)).alias("p"), letters.alias("g"))
    some = F.size("p") > 0
    return x.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((some & (F.col("p") == F.col("g"))).cast("double")), 4).alias("exact"),
        F.round(F.avg((some & (F.size(F.array_except("g", "p")) == 0)).cast("double")), 4).alias("subset"),
        F.count_if(~some).alias("unparsed"),
    )


def hit_rate(rows: DataFrame, group: list[str], answer: str, gold: str) -> DataFrame:
    """Of citations: the mean share of the reference's that an answer has, over rows whose reference has some, and how many those are."""
    x = rows.select(*group, statute_set(F.col(answer)).alias("p"), statute_set(F.col(gold)).alias("g")).where(F.size("g") > 0)
    return x.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.size(F.array_intersect("p", "g")) / F.size("g")), 4).alias("hit_rate"), F.round(F.avg(F.size("g")), 2).alias("avg_gold")
    )


def macro_average(scores: DataFrame, tasks: list[str], row_score: str) -> DataFrame:
    """The mean over tasks of each task's mean, every task counting the same, and how many tasks there are."""
    by_task = scores.where(F.col(row_score).isNotNull()).groupBy(*tasks).agg(F.avg(row_score).alias("m"))
    return by_task.agg(F.avg("m").alias("macro"), F.count(F.lit(1)).alias("n_tasks"))


#: What answers are scored by: name to (answers, group) -> rows.
METRICS: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {
    "accuracy": lambda rows, group: choice_accuracy(rows, group, "answer", "reference"),
    "rouge_l": lambda rows, group: rouge_rollup(rows, group, "answer", "reference"),
    "statute_hit": lambda rows, group: hit_rate(rows, group, "answer", "reference"),
}
#: Metrics of a task if none are named.
TASK_METRICS = {"lexeval": ("accuracy", "rouge_l"), "internal_test": ("rouge_l", "statute_hit"), "lexrubric": ("rouge_l", "statute_hit")}


def score_answers(answers: DataFrame, task: str, metrics: str = "auto", group: tuple[str, ...] = ("split",)) -> dict[str, DataFrame]:
    """The metrics of a task's answers (split, answer, reference, error): `auto`, `all`, or names with commas. Failed answers do not count."""
    names = TASK_METRICS[task] if metrics == "auto" else tuple(METRICS) if metrics == "all" else tuple(m.strip() for m in metrics.split(","))
    good = answers.where(F.coalesce("error", F.lit("")) == "")
    return {name: METRICS[name](good, list(group)) for name in names}


def agreement(judged: DataFrame, case: str, judge: str, score: str) -> DataFrame:
    """(a, b, n, pearson, spearman) for all pairs of judges, in order of their names, over the cases that both judged. A case has few judges."""
    j = judged.select(F.col(case).alias("c"), F.col(judge).alias("j"), F.col(score).cast("double").alias("s"))
    pairs = j.alias("a").join(j.alias("b"), (F.col("a.c") == F.col("b.c")) & (F.col("a.j") < F.col("b.j"))).select(F.col("a.j").alias("a"), F.col("b.j").alias("b"), F.col("a.s").alias("x"), F.col("b.s").alias("y"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).join(correlations(pairs, ["a", "b"], "x", "y"), ["a", "b"])


def rubric_totals(judged: DataFrame) -> DataFrame:
    """From (case_id, split, judge, dimension, point, met): case totals per judge, with what could be had."""
    met = F.when(F.col("met"), F.col("point")).otherwise(0)
    return judged.groupBy("split", "case_id", "judge").agg(
        F.sum(met).alias("total"), F.sum(F.greatest("point", F.lit(0))).alias("max_score"), F.sum(F.least("point", F.lit(0))).alias("min_score")
    )


def rubric_dimensions(judged: DataFrame) -> DataFrame:
    """Points per judge, case and dimension, of criteria that were met."""
    return judged.where("met").groupBy("split", "case_id", "judge", "dimension").agg(F.sum("point").alias("total"))


def rubric_rollup(totals: DataFrame) -> DataFrame:
    """Mean total and share of the maximum, by split and overall: of each case the mean over its judges."""
    cases = totals.groupBy("split", "case_id").agg(F.avg("total").alias("total"), F.max("max_score").alias("max_score"))
    return cases.rollup("split").agg(
        F.count(F.lit(1)).alias("n_cases"), F.avg("total").alias("mean_total"), F.avg(F.when(F.col("max_score") > 0, 100.0 * F.col("total") / F.col("max_score"))).alias("pct")
    )


def judge_rollup(totals: DataFrame, failed: DataFrame) -> DataFrame:
    """(split, judge, n, mean, n_failed) by split and overall: each judge over all cases, where a total that is missing counts as 0; failed:
    (split, case_id) of cases with an answer that could not be read."""
    cases, judges = totals.select("split", "case_id").distinct(), totals.select("judge").distinct()
    every = cases.withColumn("_all", F.lit(1)).join(F.broadcast(judges.agg(F.collect_set("judge").alias("j")).withColumn("_all", F.lit(1))), "_all").select("split", "case_id", F.explode("j").alias("judge"))  # judges are few
    x = every.join(totals.select("split", "case_id", "judge", "total"), ["split", "case_id", "judge"], "left").join(failed.distinct().withColumn("_f", F.lit(1)), ["split", "case_id"], "left")
    sets = x.groupingSets([["split", "judge"], ["judge"]], "split", "judge")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("total", F.lit(0.0))).alias("mean"), F.count("_f").alias("n_failed"))


def ranking_metrics(ranks: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = (5, 10)) -> DataFrame:
    """From ranks (config, query_id, doc_id, rank) and gold (query_id, doc_id): micro recall and hit rate at cuts, MRR at the last."""
    n_gold = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("g"))
    found = ranks.join(gold, ["query_id", "doc_id"])
    per_query = found.groupBy("config", "query_id").agg(*(F.count_if(F.col("rank") <= k).alias(f"f{k}") for k in cuts), F.min("rank").alias("first"))
    all_ = ranks.select("config", "query_id").distinct().join(n_gold, "query_id").join(per_query, ["config", "query_id"], "left")
    last = max(cuts)
    return all_.groupBy("config").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum(F.coalesce(f"f{k}", F.lit(0))) .alias(f"_r{k}") for k in cuts),
        F.sum("g").alias("_g"),
        *(F.avg((F.coalesce(f"f{k}", F.lit(0)) > 0).cast("double")).alias(f"hit{k}") for k in cuts),
        F.avg(F.when(F.col("first") <= last, 1.0 / F.col("first")).otherwise(0.0)).alias(f"mrr{last}"),
    ).select("config", "n", *((F.col(f"_r{k}") / F.col("_g")).alias(f"recall{k}") for k in cuts), *(f"hit{k}" for k in cuts), f"mrr{last}")


def guessed(score: Column, threshold: float) -> Column:
    """Which labels are taken: those at the threshold, or where there are none the first best."""
    return F.when(F.exists(score, lambda s: s >= threshold), F.transform(score, lambda s: s >= threshold)).otherwise(
        F.transform(score, lambda s, i: i == F.array_position(score, F.array_max(score)) - 1)
    )


def multilabel(rows: DataFrame, labels: list[str], threshold: float = 0.6) -> DataFrame:
    """From arrays truth and score in the order of labels: precision, recall and F1 per label; below the threshold the best counts."""
    x = rows.withColumn("_g", guessed(F.col("score"), threshold)).select(F.posexplode(F.arrays_zip(F.col("truth").alias("t"), F.col("_g").alias("g"))).alias("i", "x"))
    c = x.groupBy("i").agg(F.count_if(F.col("x.t") & F.col("x.g")).alias("tp"), F.count_if(~F.col("x.t") & F.col("x.g")).alias("fp"), F.count_if(F.col("x.t") & ~F.col("x.g")).alias("fn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp = F.col("tp")
    return c.select(
        F.element_at(F.array(*map(F.lit, labels)), F.col("i") + 1).alias("label"), "tp", "fp", "fn",
        safe(tp, tp + F.col("fp")).alias("precision"), safe(tp, tp + F.col("fn")).alias("recall"), safe(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1"),
    )


def multilabel_summary(rows: DataFrame, labels: list[str], threshold: float = 0.6) -> DataFrame:
    """One row: exact matches, share of wrong labels, F1 over all labels at once and as the mean of labels; then what a router would do: its
    first choice right, several labels at the threshold (cross), none (low), either of them (fallback), the rest (routed) and how often
    the first choice is right there."""
    per = multilabel(rows, labels, threshold)
    f1 = per.agg((2 * F.sum("tp") / F.greatest(2 * F.sum("tp") + F.sum("fp") + F.sum("fn"), F.lit(1))).alias("micro_f1"), F.avg("f1").alias("macro_f1"))
    best = F.array_position("score", F.array_max("score"))
    x = rows.select(
        (F.col("truth") == guessed(F.col("score"), threshold)).alias("exact"),
        F.size(F.filter(F.zip_with("truth", guessed(F.col("score"), threshold), lambda a, b: a != b), lambda d: d)).alias("wrong"),
        F.element_at("truth", best.cast("int")).alias("top"),
        F.size(F.filter("score", lambda s: s >= threshold)).alias("over"),
    )
    routed = F.col("over") == 1
    share = lambda c: F.avg(c.cast("double"))
    sums = x.agg(
        F.count(F.lit(1)).alias("n"), share(F.col("exact")).alias("exact_match"), (F.sum("wrong") / (F.count(F.lit(1)) * len(labels))).alias("hamming_loss"), share(F.col("top")).alias("top1_acc"),
        share(~routed).alias("fallback_rate"), share(F.col("over") >= 2).alias("cross_rate"), share(F.col("over") == 0).alias("low_rate"), share(routed).alias("routed_cov"),
        F.coalesce(F.avg(F.when(routed, F.col("top").cast("double"))), F.lit(0.0)).alias("routed_acc"),
    )
    return sums.crossJoin(F.broadcast(f1))  # one row each


def confusion(rows: DataFrame, labels: list[str]) -> DataFrame:
    """(truth, guess, n) of the first true label and the first best score."""
    name = lambda i: F.element_at(F.array(*map(F.lit, labels)), F.greatest(i, F.lit(1)).cast("int"))
    return rows.groupBy(name(F.array_position("truth", True)).alias("truth"), name(F.array_position("score", F.array_max("score"))).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def utilisation(rows: DataFrame, group: list[str], weights: str) -> DataFrame:
    """(group, place, mean): element-wise means of vectors."""
    return rows.select(*group, F.posexplode(weights).alias("place", "x")).groupBy(*group, F.col("place").cast("long").alias("place")).agg(F.avg(F.col("x").cast("double")).alias("mean"))


def router_heads(rows: DataFrame, features: str, labels: list[str], truth: str = "truth", iterations: int = 50) -> dict[str, object]:
    """One head for each label: a logistic regression, or the label's share where it is always or never true."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x = rows.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), truth)
    shares = x.agg(*(F.avg(F.element_at(truth, i + 1).cast("double")).alias(n) for i, n in enumerate(labels))).head()
    heads: dict[str, object] = {}
    for i, name in enumerate(labels):
        constant = shares[name] is None or shares[name] in (0.0, 1.0)
        own = x.withColumn("label", F.element_at(truth, i + 1).cast("double"))
        heads[name] = float(shares[name] or 0.0) if constant else LogisticRegression(maxIter=iterations, regParam=0.01).fit(own)
    return heads


def router_scores(rows: DataFrame, features: str, heads: dict[str, object]) -> DataFrame:
    """rows with `score`, an array in the order of the heads."""
    vector = F.col(features).cast("array<double>")

    def one(head: object) -> Column:
        if isinstance(head, float):
            return F.lit(head)
        z = F.aggregate(F.zip_with(vector, F.array(*(F.lit(float(c)) for c in head.coefficients)), lambda a, b: a * b), F.lit(float(head.intercept)), lambda s, v: s + v)
        return 1 / (1 + F.exp(-z))

    return rows.withColumn("score", F.array(*(one(h) for h in heads.values())))


def min_max(rows: DataFrame, group: list[str], value: str, name: str, by: list[str]) -> DataFrame:
    """rows with a value scaled to 0..1 within its group; a constant is 1, a null one half. by: what tells rows of a group apart."""
    from granary.operators.ranks import spread_join

    ends = rows.groupBy(*group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    x = spread_join(rows, ends, group, by)
    scaled = F.when(F.col(value).isNull(), 0.5).when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return x.withColumn(name, scaled).drop("_lo", "_hi")
