"""Queries over logs and events: windows, sessions, what is left to do, judgements; and keys and normal forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators import fingerprints, judging, profiles, records, sampling
from granary.plans.corpus import over
from granary.plans.registry import REGISTRY, rows_of, table
from granary.sources import io
from granary.streaming import events as streams

query = REGISTRY.query


@query("tumbling_windows", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windows that a stream gives, over all events at once."""
    w = streams.tumbling(table(spark, d, "events"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("sliding_windows", "SELECT date_trunc('hour', ts) - to_hours(k) AS hour, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of two hours, one each hour."""
    w = streams.tumbling(table(spark, d, "events"), width="2 hours", slide="1 hour")
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS first, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    w = streams.sessions(table(spark, d, "events"))
    return w.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("first"), "n")


@query("pending_keys", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R')")
def pending_keys(spark: SparkSession, d: str) -> DataFrame:
    """What a log has not done yet; failed rows do not count."""
    log = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return io.pending(table(spark, d, "orders").select("o_orderkey"), log, ["o_orderkey"], "l_returnflag <> 'R'")


@query("merged_nodes", "SELECT c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN 'new' ELSE c_mktsegment END AS kind FROM customer")
def merged_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A node table after a merge: rows with the same key are replaced."""
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))
    return io.upsert(old, table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"), F.lit("new").alias("kind")), ["id"])


@query("last_versions", "SELECT l_orderkey, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1")
def last_versions(spark: SparkSession, d: str) -> DataFrame:
    return records.last_of_each(table(spark, d, "lineitem").select("l_orderkey", "l_shipdate"), ["l_orderkey"], "l_shipdate").select("l_orderkey", "l_shipdate")


@query("files_that_share", "SELECT a.source AS a, b.source AS b, count(DISTINCT a.text) AS n FROM documents a JOIN documents b ON a.text = b.text AND a.source < b.source GROUP BY 1, 2")
def files_that_share(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.repeated_across(table(spark, d, "documents"), F.sha1("text"), F.col("source"))


@query("repeated_keys", "WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag) AS c FROM lineitem GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS n_keys, CAST(sum(n - 1) AS BIGINT) AS extra_rows, count(*) FILTER (c = 1) AS same_content, count(*) FILTER (c > 1) AS other_content FROM g")
def repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.repeated_keys(table(spark, d, "lineitem"), "l_orderkey", F.col("l_returnflag"))


@query("hash_splits", """SELECT doc_id, CASE WHEN CAST(('0x' || substr(sha1('g' || chr(0) || source), 1, 8)) AS BIGINT) / 4294967296.0 < 0.9 THEN 'train' WHEN CAST(('0x' || substr(sha1('g' || chr(0) || source), 1, 8)) AS BIGINT) / 4294967296.0 < 0.95 THEN 'val' ELSE 'test' END AS split FROM documents""")
def hash_splits(spark: SparkSession, d: str) -> DataFrame:
    """Whole groups (sources) in one split each, the same whatever other groups there are."""
    return table(spark, d, "documents").select("doc_id", sampling.split_by_hash(F.col("source"), "g", {"train": 0.9, "val": 0.05, "test": 0.05}).alias("split"))


NORMAL = "SELECT doc_id, replace(replace(text, '. ', '.  ' || chr(9)), ', ', '， ') AS t FROM documents"


@over("normal_forms", NORMAL, r"""SELECT doc_id, md5(trim(regexp_replace(replace(t, '，', ','), '[ \t\r\f\v]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS ws, md5(regexp_replace(replace(t, '，', ','), '[ \t\r\n]', '', 'g')) AS bare,
  md5(lower(regexp_replace(replace(t, '，', ','), '[\s\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e\p{P}]+', '', 'g'))) AS plain, sha1(regexp_replace(t, '[\s\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e\p{P}]+', '', 'g')) AS loose FROM {base}""")
def normal_forms(rows: DataFrame) -> DataFrame:
    """The four normalisers side by side; texts here are in normal form but for wide commas."""
    t = F.col("t")
    return rows.select("doc_id", F.md5(X.norm_ws(t)).alias("ws"), F.md5(X.norm_text(t)).alias("bare"), F.md5(X.normalize_text(t)).alias("plain"), X.loose_hash(t).alias("loose"))


@query("unique_citations", "SELECT p_partkey, p_name || '法/' || p_size || ' 乙法/三' AS cites FROM part")
def unique_citations(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("见《 "), "p_name", F.lit("法》 第 "), F.col("p_size").cast("string"), F.lit(" 条,〈乙法〉第三条,《"), "p_name", F.lit("法》第"), F.col("p_size").cast("string"), F.lit("条"))
    c = F.transform(X.unique_citations(text), lambda x: F.concat_ws("/", x["law"], x["number"]))
    return table(spark, d, "part").select("p_partkey", F.array_join(c, " ").alias("cites"))


CASES = "SELECT CAST(s_suppkey AS STRING) AS case_id, s_name AS question, CAST(s_acctbal AS STRING) AS answer, array(named_struct('criterion', 'short', 'dimension', 'a', 'point', 2.0D), named_struct('criterion', 'longer one', 'dimension', 'b', 'point', -1.0D)) AS rubrics FROM supplier"


@query("judged_cases", """WITH p AS (SELECT CAST(s_suppkey AS VARCHAR) AS case_id, unnest([0, 1]) AS k, s_name || '|' || s_acctbal || '|' || unnest(['short|不是', 'longer one|是']) AS prompt FROM supplier) SELECT case_id, CAST(k AS INT) AS k, length(prompt) % 2 = 0 AS met, true AS ok FROM p""")
def judged_cases(spark: SparkSession, d: str) -> DataFrame:
    """Criteria of cases through a judge that is plugged in; some replies can be read only the second time."""
    asked = judging.prompts(rows_of(spark, d, CASES), "{question}|{answer}|{criterion}|{direction}")
    return judging.judged(asked, "offline", judging.JUDGES["offline"]()).select("case_id", "k", "met", "ok")


@query("trial_rows", "SELECT least(count(*), 50) AS n FROM documents")
def trial_rows(spark: SparkSession, d: str) -> DataFrame:
    """A trial run takes some rows, and any; only how many is told."""
    return profiles.at_most(table(spark, d, "documents"), 50).agg(F.count(F.lit(1)).alias("n"))
