"""Queries over answers, judgements, labels and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import labels, metrics, profiles
from granary.plans.catalog_sql import DRAWN, RESAMPLED
from granary.plans.corpus import ANSWERS, letters, over
from granary.plans.registry import REGISTRY, rows_of, table

query = REGISTRY.query


@query("percentiles", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.975), 6) AS p975 FROM events GROUP BY 1")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = metrics.percentiles(table(spark, d, "events"), ["event_type"], "value", {"p25": 0.25, "p50": 0.5, "p975": 0.975})
    return p.select("event_type", *(F.round(c, 6).alias(c) for c in ("p25", "p50", "p975")))


@query("four_quantile_rules", """WITH s AS (SELECT source, list_sort(list(n_chars)) x, count(*) n FROM documents GROUP BY 1)
SELECT source, x[1 + least(n - 1, CAST(floor(n * 0.9) AS BIGINT))] AS by_n, x[1 + CAST(floor(0.9 * (n - 1)) AS BIGINT)] AS by_last, x[1 + CAST(round_even(0.9 * (n - 1), 0) AS BIGINT)] AS by_round FROM s""")
def four_quantile_rules(spark: SparkSession, d: str) -> DataFrame:
    t, out = table(spark, d, "documents"), None
    for name, rule in (("by_n", "capped"), ("by_last", "last"), ("by_round", "round")):
        x = metrics.nearest_rank(t, ["source"], "n_chars", {name: 0.9}, rule)
        out = x if out is None else out.join(x, "source")
    return out


@query("score_intervals", f"""WITH r AS (SELECT s_nationkey g, i, s_acctbal x, {RESAMPLED.format(key="s_suppkey")} AS u FROM supplier, range(1, 2001) t(i)),
m AS (SELECT g, i, sum({DRAWN} * x) / nullif(sum({DRAWN}), 0) AS m FROM r GROUP BY 1, 2), c AS (SELECT g, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m WHERE m IS NOT NULL GROUP BY 1)
SELECT s_nationkey, count(s_acctbal) AS n, round(avg(s_acctbal), 6) AS mean, round(coalesce(stddev_samp(s_acctbal), 0), 6) AS stdev, min(s_acctbal) AS lo, max(s_acctbal) AS hi, round(any_value(c.lo), 6) AS ci_lo, round(any_value(c.hi), 6) AS ci_hi
FROM supplier JOIN c ON g = s_nationkey GROUP BY 1""")
def score_intervals(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.score_summary(table(spark, d, "supplier"), "s_nationkey", "s_suppkey", "s_acctbal", iterations=2000)
    return s.select("s_nationkey", "n", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"), "lo", "hi", F.round("ci_lo", 6).alias("ci_lo"), F.round("ci_hi", 6).alias("ci_hi"))


CHOSEN = f"SELECT id, t AS answer, CASE id % 4 WHEN 0 THEN 'C' WHEN 1 THEN ' ab' WHEN 2 THEN 'B' ELSE 'long answer' END AS reference, CASE WHEN id % 3 = 0 THEN 'x' ELSE 'y' END AS split, '' AS error FROM ({ANSWERS})"


@over("choice_accuracy", CHOSEN, f"""WITH g AS (SELECT split, {letters('coalesce(answer, chr(32))')} AS p, list_sort(string_split(upper(trim(reference)), '')) AS g FROM {{base}} WHERE regexp_matches(trim(reference), '^[A-Fa-f]{{1,5}}$'))
SELECT split, count(*) AS n, round(avg(CASE WHEN len(p) > 0 AND p = g THEN 1.0 ELSE 0 END), 4) AS exact, round(avg(CASE WHEN len(p) > 0 AND list_has_all(p, g) THEN 1.0 ELSE 0 END), 4) AS subset, count(*) FILTER (len(p) = 0) AS unparsed FROM g GROUP BY 1""")
def choice_accuracy(rows: DataFrame) -> DataFrame:
    return metrics.score_answers(rows, "lexeval", "accuracy")["accuracy"]


CITED = "SELECT p_partkey AS id, p_type AS split, '' AS error, '见《' || p_name || '法》第' || CAST(p_size AS STRING) || '条和《乙法》 第 三 条' AS reference, '依《' || p_name || '法》第' || CAST(p_size - p_partkey % 2 AS STRING) || '条' || CASE WHEN p_partkey % 3 = 0 THEN '及《乙法》第三条' ELSE '' END AS answer FROM part"


@over("citation_hits", CITED, "SELECT split, count(*) AS n, round(avg((CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END) / 2.0), 4) AS hit_rate, 2.0 AS avg_gold FROM {base} GROUP BY 1".replace("2.0 AS avg_gold", "CAST(2 AS DOUBLE) AS avg_gold"))
def citation_hits(rows: DataFrame) -> DataFrame:
    return metrics.score_answers(rows, "internal_test", "statute_hit")["statute_hit"]


@over("statute_sets", CITED, "SELECT id, list_sort(['乙法/三', regexp_extract(reference, '《([^》]+)》', 1) || '/' || regexp_extract(reference, '第([0-9]+)条', 1)]) AS cites FROM {base}")
def statute_sets(rows: DataFrame) -> DataFrame:
    from granary.functions.text import statute_set

    return rows.select("id", F.array_sort(F.transform(statute_set(F.col("reference")), lambda x: F.concat_ws("/", x["law"], x["number"]))).alias("cites"))


#: An answer that is the head of its reference: all of it is the longest common subsequence.
HEADS = "SELECT doc_id AS id, lang AS split, text AS reference, substr(text, 1, CAST(1 + n_chars % 900 AS INT)) AS answer, CASE WHEN doc_id % 10 = 0 THEN 'timeout' ELSE '' END AS error FROM documents"
SQL_ROUGE = r"""t AS (SELECT split, trim(reference, ' ' || chr(10) || chr(9) || chr(13)) AS g, trim(answer, ' ' || chr(10) || chr(9) || chr(13)) AS a, length(answer) > 800 OR length(reference) > 800 AS cut FROM {base} WHERE error = ''),
l AS (SELECT split, cut, least(length(g), 800) AS lg, least(length(a), 800) AS la FROM t WHERE g <> ''),
f AS (SELECT split, cut, CASE WHEN la > 0 THEN round((1 + 1.44) * 1.0 * (CAST(la AS DOUBLE) / lg) / (CAST(la AS DOUBLE) / lg + 1.44), 4) ELSE 0 END AS f FROM l)"""


@over("rouge_rollup", HEADS, f"WITH {SQL_ROUGE} SELECT split, count(*) AS n, round(avg(f), 4) AS f_mean, list_sort(list(f))[1 + count(*) // 2] AS f_p50, count(*) FILTER (cut) AS n_truncated FROM f GROUP BY 1")
def rouge_rollup(rows: DataFrame) -> DataFrame:
    return metrics.score_answers(rows, "internal_test", "rouge_l")["rouge_l"]


@query("macro_average", """WITH t AS (SELECT p_type, avg(CASE WHEN p_type < 'M' THEN CAST(p_size > 25 AS INT) ELSE p_retailprice / 2000 END) AS m FROM part GROUP BY 1) SELECT round(avg(m), 9) AS macro, count(*) AS n_tasks FROM t""")
def macro_average(spark: SparkSession, d: str) -> DataFrame:
    """Tasks of two kinds, choices and texts, each counting the same."""
    score = F.when(F.col("p_type") < "M", (F.col("p_size") > 25).cast("double")).otherwise(F.col("p_retailprice") / 2000)
    return metrics.macro_average(table(spark, d, "part").withColumn("s", score), ["p_type"], "s").withColumn("macro", F.round("macro", 9))


LABELLED = "SELECT p_partkey AS id, array(p_size > 25, p_retailprice > 1000, length(p_name) > 10) AS truth, array(p_size / 50.0D, p_retailprice / 2000, 0.55D) AS score FROM part"
SQL_LABELLED = """x AS (SELECT p_partkey AS id, [p_size > 25, p_retailprice > 1000, length(p_name) > 10] AS t, [p_size / 50.0, p_retailprice / 2000, 0.55] AS s FROM part),
b AS (SELECT *, list_position(s, list_max(s)) AS top, len(list_filter(s, lambda v: v >= 0.6)) AS over FROM x), g AS (SELECT *, list_transform(s, lambda v, i: CASE WHEN over > 0 THEN v >= 0.6 ELSE i = top END) AS g FROM b)"""


@query("multilabel_scores", f"""WITH {SQL_LABELLED}, u AS (SELECT unnest(['a', 'b', 'c']) AS label, unnest(t) AS t, unnest(g) AS g FROM g), c AS (SELECT label, count(*) FILTER (t AND g) AS tp, count(*) FILTER (NOT t AND g) AS fp, count(*) FILTER (t AND NOT g) AS fn FROM u GROUP BY 1)
SELECT label, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c""")
def multilabel_scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.multilabel(rows_of(spark, d, LABELLED), ["a", "b", "c"])


@query("multilabel_summary", f"""WITH {SQL_LABELLED}, u AS (SELECT unnest(['a', 'b', 'c']) AS label, unnest(t) AS t, unnest(g) AS g FROM g), c AS (SELECT label, count(*) FILTER (t AND g) AS tp, count(*) FILTER (NOT t AND g) AS fp, count(*) FILTER (t AND NOT g) AS fn FROM u GROUP BY 1),
f AS (SELECT 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS micro_f1, avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) AS macro_f1 FROM c), d AS (SELECT *, CAST(t[top] AS INT) AS hit, over = 1 AS routed FROM g)
SELECT count(*) AS n, round(avg(CAST(t = g AS INT)), 9) AS exact_match, round(avg(len(list_filter(list_zip(t, g), lambda z: z[1] <> z[2])) / 3), 9) AS hamming_loss, round(avg(hit), 9) AS top1_acc, round(avg(CAST(NOT routed AS INT)), 9) AS fallback_rate, round(avg(CAST(over >= 2 AS INT)), 9) AS cross_rate,
  round(avg(CAST(over = 0 AS INT)), 9) AS low_rate, round(avg(CAST(routed AS INT)), 9) AS routed_cov, round(coalesce(avg(hit) FILTER (routed), 0), 9) AS routed_acc, round(any_value(micro_f1), 9) AS micro_f1, round(any_value(macro_f1), 9) AS macro_f1 FROM d, f""")
def multilabel_summary(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.multilabel_summary(rows_of(spark, d, LABELLED), ["a", "b", "c"])
    return s.select("n", *(F.round(c, 9).alias(c) for c in s.columns if c != "n"))


@query("label_confusion", f"WITH {SQL_LABELLED} SELECT ['a', 'b', 'c'][greatest(coalesce(list_position(t, true), 1), 1)] AS truth, ['a', 'b', 'c'][top] AS guess, count(*) AS n FROM b GROUP BY 1, 2")
def label_confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(rows_of(spark, d, LABELLED), ["a", "b", "c"])


@query("router_decisions", f"WITH {SQL_LABELLED} SELECT CASE over WHEN 1 THEN 'routed' ELSE 'fallback' END AS decision, count(*) AS n FROM b GROUP BY 1")
def router_decisions(spark: SparkSession, d: str) -> DataFrame:
    x = rows_of(spark, d, LABELLED).select(labels.decide(F.col("score"), ["a", "b", "c"]).alias("decision"))
    return x.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query("router_heads")
def router_heads(spark: SparkSession, d: str) -> DataFrame:
    """A head for each label over vectors, and how well their decisions do; one label is never true and gets a constant."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.array(F.col("label") % 2 == 0, F.col("label") % 3 == 0, F.lit(False)).alias("truth"))
    heads = metrics.router_heads(e, "embedding", ["even", "third", "never"])
    return metrics.multilabel_summary(metrics.router_scores(e, "embedding", heads), ["even", "third", "never"], 0.5)


LOGGED = "SELECT event_id, event_type AS split, CASE WHEN event_type = 'error' THEN 'failed' ELSE '' END AS error, CASE WHEN event_id % 40 = 0 THEN ' ' ELSE props END AS answer, CAST(floor(value) AS BIGINT) AS output_tokens FROM events"


@over("answer_report", LOGGED, """WITH s AS (SELECT split, count(*) FILTER (error = '') AS n_ok, count(*) FILTER (error <> '') AS n_err, count(*) FILTER (error = '' AND trim(answer) = '') AS n_empty, list_sort(list(output_tokens) FILTER (error = '' AND output_tokens IS NOT NULL)) AS t FROM {base} GROUP BY 1)
SELECT split, n_ok, n_err, n_empty, n_empty < 0.05 * n_ok AS ok, t[1 + CAST(floor(0.5 * (len(t) - 1)) AS BIGINT)] AS p50, t[1 + CAST(floor(0.9 * (len(t) - 1)) AS BIGINT)] AS p90 FROM s""")
def answer_report(rows: DataFrame) -> DataFrame:
    return profiles.answer_report(rows, ["split"])


@query("stage_board", """SELECT n_name AS stage, CASE WHEN n_nationkey % 5 = 4 THEN 'failed' WHEN n_nationkey % 5 = 0 THEN 'done' WHEN n_nationkey % 5 = 1 THEN 'running' WHEN n_nationkey % 5 = 2 THEN 'partial' ELSE 'waiting' END AS status,
  CASE WHEN n_nationkey % 5 = 0 THEN '10/10' WHEN n_nationkey % 5 = 3 THEN '0/10' ELSE '4/10' END AS progress FROM nation""")
def stage_board(spark: SparkSession, d: str) -> DataFrame:
    return profiles.stage_board(rows_of(spark, d, """SELECT n_name AS stage, CASE n_nationkey % 5 WHEN 0 THEN 10 WHEN 3 THEN 0 ELSE 4 END AS lines, 10 AS expected, n_nationkey % 5 = 0 AS marker, CASE n_nationkey % 5 WHEN 4 THEN 1 WHEN 1 THEN NULL ELSE 0 END AS rc FROM nation"""))


RUBRICS = "SELECT o.o_orderstatus AS split, l_orderkey AS case_id, collect_list(struct(CAST(l_linenumber AS STRING) AS criterion, l_quantity - 25 AS point, l_returnflag AS dimension)) AS rubrics FROM lineitem JOIN orders o ON l_orderkey = o_orderkey GROUP BY 1, 2"


@query("rubric_profile", """WITH c AS (SELECT o_orderstatus AS split, l_orderkey AS c, count(*) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), p AS (SELECT o_orderstatus AS split, l_quantity - 25 AS p, l_returnflag AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT split, count(*) AS n_cases, round(avg(k), 9) AS k_mean, CAST(min(k) AS INT) AS k_least, CAST(max(k) AS INT) AS k_most FROM c GROUP BY 1)
SELECT s.*, count(*) FILTER (p > 0) AS n_plus, count(*) FILTER (p = 0) AS n_zero, count(*) FILTER (p < 0) AS n_minus, sum(CASE WHEN p > 0 THEN p ELSE 0 END) AS sum_plus, sum(CASE WHEN p < 0 THEN p ELSE 0 END) AS sum_minus, count(*) FILTER (f NOT IN ('A', 'N')) AS n_unexpected
FROM s JOIN p USING (split) GROUP BY ALL""")
def rubric_profile(spark: SparkSession, d: str) -> DataFrame:
    return profiles.rubric_profile(rows_of(spark, d, RUBRICS), ["A", "N"]).withColumn("k_mean", F.round("k_mean", 9))


@query("scoped_ids", "SELECT turn, count(DISTINCT conv_id) AS n_scopes, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1")
def scoped_ids(spark: SparkSession, d: str) -> DataFrame:
    """Turn numbers are keys only within their conversation."""
    return profiles.scoped_ids(table(spark, d, "conversations"), "conv_id", "turn")


@query("key_presence", "SELECT event_type, key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY 1, 2")
def key_presence(spark: SparkSession, d: str) -> DataFrame:
    return profiles.key_presence(table(spark, d, "events"), "props", ["event_type"])


@query("length_profile", """WITH s AS (SELECT lang, list_sort(list(CAST(length(text) AS INT))) x, count(*) n FROM documents GROUP BY 1)
SELECT lang, x[1] AS least, x[n] AS largest, x[1 + CAST(round_even(0.1 * (n - 1), 0) AS BIGINT)] AS p10, x[1 + CAST(round_even(0.5 * (n - 1), 0) AS BIGINT)] AS p50, x[1 + CAST(round_even(0.9 * (n - 1), 0) AS BIGINT)] AS p90 FROM s""")
def length_profile(spark: SparkSession, d: str) -> DataFrame:
    return profiles.length_profile(table(spark, d, "documents"), ["lang"], "text")


@query("structure_counts", "SELECT page_id, len(regexp_extract_all(html, '<li>')) AS items, len(regexp_extract_all(html, 'href=\"[^\"]*\"')) AS links, len(regexp_extract_all(html, '[0-9]+')) AS numbers FROM pages")
def structure_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", *profiles.structure_counts(F.col("html"), {"items": "<li>", "links": 'href="[^"]*"', "numbers": "[0-9]+"}))


@query("cross_table", "SELECT c_mktsegment, c_nationkey, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY c_mktsegment), 2) AS pct FROM customer GROUP BY 1, 2")
def cross_table(spark: SparkSession, d: str) -> DataFrame:
    return profiles.cross_table(table(spark, d, "customer"), "c_mktsegment", "c_nationkey")


@query("assembled_reports", """WITH a AS (SELECT l_returnflag AS system, avg(l_discount) AS acc FROM lineitem GROUP BY 1), b AS (SELECT o_orderstatus AS system, count(*) AS n FROM orders GROUP BY 1)
SELECT s AS system, round(acc, 9) AS acc, n FROM (SELECT unnest(['A', 'F', 'N', 'X']) AS s) t LEFT JOIN a ON a.system = s LEFT JOIN b ON b.system = s""")
def assembled_reports(spark: SparkSession, d: str) -> DataFrame:
    """One row for each system, with what each report says of it."""
    order = spark.createDataFrame([("A",), ("F",), ("N",), ("X",)], "system string")
    acc = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("system")).agg(F.round(F.avg("l_discount"), 9).alias("acc"))
    n = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("system")).agg(F.count(F.lit(1)).alias("n"))
    return profiles.assembled("system", order, acc=acc, n=n)[0]


@query("missing_reports", "SELECT s AS system, r AS report FROM (SELECT unnest(['A', 'N', 'X', 'F', 'X']) AS s, unnest(['n', 'n', 'n', 'acc', 'acc']) AS r)")
def missing_reports(spark: SparkSession, d: str) -> DataFrame:
    order = spark.createDataFrame([("A",), ("F",), ("N",), ("X",)], "system string")
    acc = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("system")).distinct()
    n = table(spark, d, "orders").select(F.col("o_orderstatus").alias("system")).distinct()
    return profiles.assembled("system", order, acc=acc.where("system <> 'R'"), n=n.where("system = 'F'"))[1]
