"""All queries outside the llm subpackage, each with its oracle in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators import decontamination, fingerprints, gates, labels, metrics, packing, profiles, records, retrieval, sampling
from granary.plans.catalog_sql import DRAWN, RESAMPLED, simhash_sql
from granary.plans.registry import REGISTRY, table

query = REGISTRY.query


# ---- text functions and keys


@query(
    "content_keys",
    r"""SELECT doc_id, sha1(trim(regexp_replace(replace(text, '　', ' '), '[ \t\r\f\v]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || chr(30) || lang || chr(30)) AS content_sha1,
  source || '__docs:' || doc_id AS uid, substr(sha1('stage4/train' || chr(0) || doc_id), 1, 16) AS hkey FROM documents""",
)
def content_keys(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select(
        "doc_id",
        X.joined_sha1(X.norm_ws(F.col("text")), F.col("lang")).alias("content_sha1"),
        X.record_uid(F.col("source"), F.lit("raw/docs.jsonl"), F.col("doc_id")).alias("uid"),
        X.hash_order("stage4/train", F.col("doc_id").cast("string")).alias("hkey"),
    )


@query("quality_filter_chain", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN length(trim(text)) = 0 THEN 'empty_output' WHEN length(text) < 200 THEN 'short_output'
  WHEN length(source) < 4 THEN 'short_input' WHEN NOT regexp_matches(source || text, 'the') THEN 'no_match' ELSE 'kept' END AS reason FROM documents) GROUP BY reason""")
def quality_filter_chain(spark: SparkSession, d: str) -> DataFrame:
    reason = labels.drop_reason(F.col("text"), F.col("source"), 200, 4, "the")
    return table(spark, d, "documents").select(F.coalesce(reason, F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("scrub_and_anonymise", """SELECT conv_id, turn, regexp_replace(text, 'que|the', '[x]', 'gi') AS scrubbed, 'SYS-' || upper(substr(sha256('42:' || role), 1, 4)) AS anon FROM conversations""")
def scrub_and_anonymise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", X.scrub(F.col("text"), ["the", "que"], "[x]").alias("scrubbed"), X.anonymous_id(F.col("role"), 42).alias("anon"))


@query("tolerant_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def tolerant_json(spark: SparkSession, d: str) -> DataFrame:
    reply = F.concat(F.lit("Here:\n```json\n"), F.replace("props", F.lit("}"), F.lit(",}")), F.lit("\n```"))
    return table(spark, d, "events").select("event_id", F.variant_get(X.tolerant_json(reply), "$.k", "long").alias("k"))


# ---- fingerprints and joins


@query("simhash_documents", f"SELECT doc_id, hash FROM {simhash_sql('documents', 'doc_id', 'text')}")
def simhash_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fingerprints.simhash(F.col("text")).alias("hash"))


BARE = r"regexp_replace(text, '[ \t\r\n　]', '', 'g')"


@query("near_dup_bench_join", f"""WITH d AS (SELECT doc_id, {BARE} AS t FROM documents), i AS (SELECT item_id, {BARE} AS t FROM benchmark), a AS (SELECT * FROM {simhash_sql("(SELECT * FROM d WHERE length(t) >= 8)", "doc_id", "t")}),
b AS (SELECT * FROM {simhash_sql("(SELECT * FROM i WHERE length(t) >= 8)", "item_id", "t")}), m AS (SELECT doc_id, item_id, CAST(bit_count(xor(a.hash, b.hash)) AS INT) AS distance FROM a, b WHERE bit_count(xor(a.hash, b.hash)) <= 3)
SELECT doc_id, item_id, distance FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, item_id) = 1""")
def near_dup_bench_join(spark: SparkSession, d: str) -> DataFrame:
    hashed = lambda name, key: decontamination.fingerprinted(table(spark, d, name).select(key, "text"), "text").select(key, "hash")
    return fingerprints.near_pairs(hashed("documents", "doc_id"), hashed("benchmark", "item_id"), "doc_id", "item_id")


@query("exact_dedup_keep_first", """SELECT doc_id, sha1(text) AS key FROM documents QUALIFY row_number() OVER (PARTITION BY sha1(text) ORDER BY source, doc_id) = 1""")
def exact_dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.keep_first(table(spark, d, "documents").select(F.sha1("text").alias("key"), "doc_id", "source"), "key", "source", "doc_id").select("doc_id", "key")


@query("duplicate_stats", """WITH g AS (SELECT sha1(text) k, count(*) n, count(DISTINCT source) s FROM documents GROUP BY 1)
SELECT count(*) AS n_unique, count(*) FILTER (n > 1) AS dup_groups, CAST(sum(n - 1) AS BIGINT) AS dup_rows, count(*) FILTER (n > 1 AND s > 1) AS cross_source, count(*) FILTER (n > 1 AND s = 1) AS same_source FROM g""")
def duplicate_stats(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.duplicate_stats(table(spark, d, "documents"), F.sha1("text"), F.col("source"))


@query("anti_join_removal", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def anti_join_removal(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.remove(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").where("quality = 0"), "doc_id")


@query("char_jaccard_join", """WITH s AS (SELECT md5(p_name) id, list_distinct(string_split(p_name, '')) x, count(*) n FROM part GROUP BY ALL),
j AS (SELECT a.id AS l, b.id AS r, a.n * b.n AS n_rows, len(list_intersect(a.x, b.x)) AS i, len(a.x) AS la, len(b.x) AS lb FROM s a, s b)
SELECT l, r, n_rows, i / (la + lb - i) AS jaccard FROM j WHERE i / (la + lb - i) > 0.85""")
def char_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    """All links between different names of all parts, and for how many pairs of parts each stands."""
    s = table(spark, d, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).select(F.md5("p_name").alias("id"), "n", fingerprints.char_set(F.col("p_name")).alias("items"))
    links = fingerprints.jaccard_above(s, s, 0.85)
    n = lambda side: s.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"))
    return links.join(n("l"), "l").join(n("r"), "r").select("l", "r", (F.col("n_l") * F.col("n_r")).alias("n_rows"), "jaccard")


# ---- vectors and ranking


@query("vector_top_k", """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) q FROM embeddings WHERE vec_id % 50 = 0), s AS (
  SELECT query_id, vec_id AS doc_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), q) / sqrt(list_dot_product(q, q) * list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS score FROM embeddings, q)
SELECT * , row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def vector_top_k(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), retrieval.normalised(F.col("embedding")).alias("v"))
    q = v.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    return retrieval.vector_search(v, q, 10)


BM25 = """WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') w FROM documents), z AS (SELECT count(*) n, avg(greatest(len(w), 1)) a FROM t),
tf AS (SELECT doc_id, l, term, count(*) f FROM (SELECT doc_id, len(w) l, unnest(w) term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) df FROM tf GROUP BY 1 HAVING count(*) >= 2),
i AS (SELECT doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * l / a)) AS weight FROM tf JOIN df USING (term), z),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS term FROM benchmark),
s AS (SELECT query_id, doc_id, round(sum(weight), 5) AS score FROM q JOIN i USING (term) GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10"""


@query("bm25_search", BM25)
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(retrieval.tokens(F.col("text")))).alias("term"))
    index = retrieval.postings(table(spark, d, "documents"), "doc_id", "text", terms=q)
    return retrieval.top_k(q.join(index, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("weight"), 5).alias("score")), 10)


LISTS = """l AS (SELECT o_custkey AS query_id, 'dense' AS source, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 10
  UNION ALL SELECT o_custkey, 'bm25', o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders QUALIFY rank <= 10)"""


def _lists(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    by = lambda *order: Window.partitionBy("o_custkey").orderBy(*order, "o_orderkey")
    pick = lambda name, w: o.select(F.col("o_custkey").alias("query_id"), F.lit(name).alias("source"), F.col("o_orderkey").alias("doc_id"), F.row_number().over(w).alias("rank")).where("rank <= 10")
    return pick("dense", by(F.col("o_totalprice").desc())).unionByName(pick("bm25", by(F.col("o_orderdate"))))


@query("weighted_rank_fusion", f"WITH {LISTS}, s AS (SELECT query_id, doc_id, sum(CASE source WHEN 'dense' THEN 1.0 ELSE 0.7 END / (10 + rank)) AS score, min(CASE source WHEN 'dense' THEN 0 ELSE 100 END + rank) AS seen FROM l GROUP BY 1, 2) "
       "SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seen) AS rank FROM s")
def weighted_rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    fused = retrieval.fuse(_lists(spark, d), {"dense": 1.0, "bm25": 0.7})
    return fused.withColumn("score", F.round("score", 9))


@query("ranking_metrics", f"""WITH {LISTS}, g AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id FROM orders WHERE o_orderpriority LIKE '1%'), n AS (SELECT query_id, count(*) g FROM g GROUP BY 1),
f AS (SELECT source, l.query_id, count(*) FILTER (rank <= 5) f5, count(*) FILTER (rank <= 10) f10, min(rank) first FROM l JOIN g USING (query_id, doc_id) GROUP BY 1, 2),
a AS (SELECT source, query_id, g, coalesce(f5, 0) f5, coalesce(f10, 0) f10, first FROM (SELECT DISTINCT source, query_id FROM l) JOIN n USING (query_id) LEFT JOIN f USING (source, query_id))
SELECT source AS config, count(*) AS n, sum(f5) / sum(g) AS recall5, sum(f10) / sum(g) AS recall10, avg(CASE WHEN f5 > 0 THEN 1.0 ELSE 0 END) AS hit5, avg(CASE WHEN f10 > 0 THEN 1.0 ELSE 0 END) AS hit10,
  round(avg(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0 END), 9) AS mrr10 FROM a GROUP BY 1""")
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    gold = table(spark, d, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"))
    return metrics.ranking_metrics(_lists(spark, d).withColumnRenamed("source", "config"), gold).withColumn("mrr10", F.round("mrr10", 9))


EDGES = """e AS (SELECT l_orderkey AS s, l_partkey + 10000000 AS t, CASE WHEN l_linenumber = 1 THEN 'NEXT' ELSE 'CITES' END AS kind FROM lineitem)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("start"), (F.col("l_partkey") + 10_000_000).alias("end"), F.when(F.col("l_linenumber") == 1, "NEXT").otherwise("CITES").alias("kind")
    )


@query("graph_expansion", f"WITH {LISTS}, {EDGES}, x AS (SELECT query_id, t AS doc_id, round(max(CASE kind WHEN 'NEXT' THEN 1.0 ELSE 0.5 END / (1 + (rank - 1) / 10.0)), 9) AS score FROM l JOIN e ON doc_id = s WHERE source = 'dense' AND rank <= 10 GROUP BY 1, 2) "
       "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x QUALIFY rank <= 60")
def graph_expansion(spark: SparkSession, d: str) -> DataFrame:
    ranks = _lists(spark, d).where("source = 'dense'").drop("source")
    return retrieval.expand(ranks, _edges(spark, d), {"NEXT": 1.0, "CITES": 0.5}).withColumn("score", F.round("score", 9))


@query("hotness", """WITH c AS (SELECT l_partkey k, count(*) c FROM lineitem GROUP BY 1), n AS (SELECT p_partkey AS doc_id, coalesce(c, 0) AS c, p_size / 50.0 AS r FROM part LEFT JOIN c ON p_partkey = k)
SELECT doc_id, c, round(0.85 * ln(1 + c) / ln(1 + max(c) OVER ()) + 0.15 * r, 6) AS hotness FROM n""")
def hotness(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") / 50.0).alias("rank_norm"))
    return retrieval.hotness(nodes, table(spark, d, "lineitem").select(F.col("l_partkey").alias("end")))


# ---- statistics


@query("nearest_rank_lengths", """WITH s AS (SELECT lang, list_sort(list(n_chars)) x FROM documents GROUP BY 1)
SELECT lang, x[1 + least(len(x) - 1, CAST(floor(len(x) * 0.5) AS INT))] AS p50, x[1 + least(len(x) - 1, CAST(floor(len(x) * 0.9) AS INT))] AS p90 FROM s""")
def nearest_rank_lengths(spark: SparkSession, d: str) -> DataFrame:
    return metrics.nearest_rank(table(spark, d, "documents"), ["lang"], "n_chars", {"p50": 0.5, "p90": 0.9})


@query("rank_correlations", """WITH r AS (SELECT l_returnflag AS g, l_quantity x, l_discount y, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 rx,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0 ry FROM lineitem)
SELECT g, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY g""")
def rank_correlations(spark: SparkSession, d: str) -> DataFrame:
    c = metrics.correlations(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "g"), ["g"], "l_quantity", "l_discount")
    return c.select("g", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query("score_summary", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS stdev, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.summary(table(spark, d, "events"), ["event_type"], "value")
    return s.withColumn("mean", F.round("mean", 6)).withColumn("stdev", F.round("stdev", 6))


@query("bootstrap_interval", f"""WITH r AS (SELECT i, s_acctbal x, {RESAMPLED.format(key="s_suppkey")} AS u FROM supplier, range(1, 10001) t(i)),
m AS (SELECT i, sum({DRAWN} * x) / nullif(sum({DRAWN}), 0) AS m FROM r GROUP BY 1)
SELECT 'all' AS system, round((SELECT avg(s_acctbal) FROM supplier), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS ci_lo, round(quantile_cont(m, 0.975), 6) AS ci_hi FROM m""")
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    """The interval of a mean over 10,000 resamples, which any engine draws alike."""
    b = metrics.bootstrap(table(spark, d, "supplier").withColumn("system", F.lit("all")), "system", "s_suppkey", "s_acctbal")
    return b.select("system", *(F.round(c, 6).alias(c) for c in ("mean", "ci_lo", "ci_hi")))


@query("paired_bootstrap", f"""WITH p AS (SELECT s_suppkey k, s_acctbal - 100 * s_nationkey AS d FROM supplier), o AS (SELECT avg(d) AS o FROM p),
r AS (SELECT i, d, {RESAMPLED.format(key="k")} AS u FROM p, range(1, 2001) t(i)), m AS (SELECT i, sum({DRAWN} * d) / nullif(sum({DRAWN}), 0) AS m FROM r GROUP BY 1)
SELECT round(any_value(o), 6) AS gain, round(quantile_cont(m, 0.025), 6) AS ci_lo, round(quantile_cont(m, 0.975), 6) AS ci_hi, (count(*) FILTER (abs(m - o) >= abs(o)) + 1) / 2001 AS p,
  (SELECT count(*) FROM p WHERE d > 1e-9) AS win, (SELECT count(*) FROM p WHERE abs(d) <= 1e-9) AS tie, (SELECT count(*) FROM p WHERE d < -1e-9) AS loss FROM m, o""")
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").withColumn("a", 100.0 * F.col("s_nationkey"))
    b = metrics.paired_bootstrap(rows, "s_suppkey", "a", "s_acctbal", iterations=2000)
    return b.select(*(F.round(c, 6).alias(c) for c in ("gain", "ci_lo", "ci_hi")), "p", "win", "tie", "loss")


@query("paired_win_tie_loss", """SELECT round(avg(l_quantity - l_linenumber), 6) AS diff, count(*) FILTER (l_quantity - l_linenumber > 1e-9) AS win, count(*) FILTER (abs(l_quantity - l_linenumber) <= 1e-9) AS tie,
  count(*) FILTER (l_quantity - l_linenumber < -1e-9) AS loss FROM lineitem""")
def paired_win_tie_loss(spark: SparkSession, d: str) -> DataFrame:
    return metrics.paired_counts(table(spark, d, "lineitem"), "l_quantity", "l_linenumber").withColumn("diff", F.round("diff", 6))


@query("auc", """WITH x AS (SELECT o_totalprice s, o_orderpriority LIKE '1%' p FROM orders), g AS (SELECT s, count(*) FILTER (p) p, count(*) FILTER (NOT p) n FROM x GROUP BY 1)
SELECT round(sum(p * b) / (sum(p) * sum(n)), 9) AS auc FROM (SELECT p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM g)""")
def auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auc(table(spark, d, "orders").withColumn("pos", F.col("o_orderpriority").like("1%")), "o_totalprice", "pos").select(F.round("auc", 9).alias("auc"))


@query("rouge_l_answers")
def rouge_l_answers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.withColumn("before", F.lag("text").over(w)).where("before IS NOT NULL").select("conv_id", "turn", F.round(metrics.rouge_l(F.col("text"), F.col("before")), 4).alias("rouge_l"))


@query("rubric_rollup", """WITH t AS (SELECT l_returnflag AS split, l_orderkey AS c, l_linestatus AS j, sum(CASE WHEN l_discount >= 0.05 THEN l_quantity ELSE 0 END) total, sum(l_quantity) m FROM lineitem GROUP BY ALL),
c AS (SELECT split, c, avg(total) total, max(m) m FROM t GROUP BY ALL)
SELECT split, count(*) AS n_cases, round(avg(total), 6) AS mean_total, round(avg(CASE WHEN m > 0 THEN 100.0 * total / m END), 6) AS pct FROM c GROUP BY ROLLUP (split)""")
def rubric_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.rubric_rollup(metrics.rubric_totals(_judged(spark, d)))
    return r.withColumn("mean_total", F.round("mean_total", 6)).withColumn("pct", F.round("pct", 6))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("split"), F.col("l_orderkey").alias("case_id"), F.col("l_linestatus").alias("judge"), F.col("l_linenumber").alias("dimension"), F.col("l_quantity").alias("point"), (F.col("l_discount") >= 0.05).alias("met")
    )


@query("rubric_dimensions", """SELECT l_returnflag AS split, l_orderkey AS case_id, l_linestatus AS judge, l_linenumber AS dimension, sum(l_quantity) AS total FROM lineitem WHERE l_discount >= 0.05 GROUP BY ALL""")
def rubric_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rubric_dimensions(_judged(spark, d))


@query("judge_rollup", """WITH t AS (SELECT l_returnflag AS split, l_orderkey AS c, l_linestatus AS j, sum(CASE WHEN l_discount >= 0.05 THEN l_quantity ELSE 0 END) total, max(CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END) f FROM lineitem GROUP BY ALL),
x AS (SELECT c.split, c.c, j.j, coalesce(t.total, 0) total, c.f FROM (SELECT split, c, max(f) f FROM t GROUP BY ALL) c, (SELECT DISTINCT j FROM t) j LEFT JOIN t ON t.split = c.split AND t.c = c.c AND t.j = j.j)
SELECT split, j AS judge, count(*) AS n, round(avg(total), 6) AS mean, CAST(sum(f) AS BIGINT) AS n_failed FROM x GROUP BY GROUPING SETS ((split, j), (j))""")
def judge_rollup(spark: SparkSession, d: str) -> DataFrame:
    failed = table(spark, d, "lineitem").where("l_tax > 0.07").select(F.col("l_returnflag").alias("split"), F.col("l_orderkey").alias("case_id"))
    return metrics.judge_rollup(metrics.rubric_totals(_judged(spark, d)), failed).withColumn("mean", F.round("mean", 6))


@query("min_max_columns", """SELECT s_suppkey, round(CASE WHEN max(s_acctbal) OVER w = min(s_acctbal) OVER w THEN 1.0 ELSE (s_acctbal - min(s_acctbal) OVER w) / (max(s_acctbal) OVER w - min(s_acctbal) OVER w) END, 9) AS scaled
  FROM supplier WINDOW w AS (PARTITION BY s_nationkey)""")
def min_max_columns(spark: SparkSession, d: str) -> DataFrame:
    x = metrics.min_max(table(spark, d, "supplier"), ["s_nationkey"], "s_acctbal", "scaled", ["s_suppkey"])
    return x.select("s_suppkey", F.round("scaled", 9).alias("scaled"))


# ---- samples, labels, gates, packing


@query("stratified_pick", """WITH q AS (SELECT lang, count(*) // 4 AS quota FROM documents GROUP BY 1)
SELECT doc_id, lang FROM documents JOIN q USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY substr(sha1('s' || chr(0) || doc_id), 1, 16)) <= quota""")
def stratified_pick(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "lang")
    quota = t.groupBy("lang").agg(F.floor(F.count(F.lit(1)) / 4).alias("quota"))
    return sampling.pick_per_stratum(t, ["lang"], quota, "s", "doc_id")


@query("quota_allocation", """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), f AS (SELECT source, least(n, 5) AS f, CASE WHEN n > 5 THEN n - 5 ELSE 0 END AS w FROM c), t AS (SELECT (SELECT sum(n) // 2 FROM c) - sum(f) AS rest, sum(w) AS w FROM f),
x AS (SELECT source, f, rest * f.w // t.w AS s, rest * f.w % t.w AS r, rest FROM f, t), k AS (SELECT *, row_number() OVER (ORDER BY r DESC, source) AS k, rest - sum(s) OVER () AS more FROM x) SELECT source, CAST(f + s + CASE WHEN k <= more THEN 1 ELSE 0 END AS BIGINT) AS quota FROM k""")
def quota_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Half of the documents by source: a floor of five each, the rest in proportion to what is left."""
    t = table(spark, d, "documents")
    return sampling.mapped_quota(t, ["source"], t.count() // 2, floor=5)


@query("build_splits", """WITH r AS (SELECT doc_id FROM documents ORDER BY substr(sha1('router' || chr(0) || doc_id), 1, 16) LIMIT 20), x AS (SELECT doc_id, lang, doc_id IN (SELECT doc_id FROM r) AS router FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, router ORDER BY substr(sha1('dev' || chr(0) || doc_id), 1, 16)) k FROM x)
SELECT doc_id, lang, CASE WHEN router THEN 'router' WHEN k <= 5 THEN 'dev' WHEN k <= 10 THEN 'val' WHEN k <= 15 THEN 'test' ELSE 'train' END AS split FROM k""")
def build_splits(spark: SparkSession, d: str) -> DataFrame:
    return sampling.build_splits(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 5, 5, 5, 20)


@query("split_disjointness", """WITH x AS (SELECT l_suppkey k, l_returnflag s FROM lineitem GROUP BY ALL) SELECT a.s AS a, b.s AS b, count(*) AS shared FROM x a JOIN x b USING (k) WHERE a.s < b.s GROUP BY 1, 2""")
def split_disjointness(spark: SparkSession, d: str) -> DataFrame:
    return gates.disjoint(table(spark, d, "lineitem"), "l_returnflag", "l_suppkey")


@query("quality_gates", """SELECT 'ids unique' AS check, CAST(0 AS BIGINT) AS expected, count(doc_id) - count(DISTINCT doc_id) AS actual, count(doc_id) = count(DISTINCT doc_id) AS ok FROM documents
UNION ALL SELECT 'texts present', 0, count(*) FILTER (text IS NULL), count(*) FILTER (text IS NULL) = 0 FROM documents""")
def quality_gates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return gates.all_checks(gates.unique("ids unique", t, "doc_id"), gates.check("texts present", t, F.count_if(F.col("text").isNull())))


@query("weighted_vote", """WITH s AS (SELECT l_orderkey u, l_returnflag d, sum(l_quantity) a FROM lineitem GROUP BY 1, 2), m AS (SELECT u, max(a) m FROM s GROUP BY 1)
SELECT u AS uid, arg_max(d, a * 10 - CASE d WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS domain, list(d ORDER BY CASE d WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) FILTER (a >= 0.6 * m) AS domains FROM s JOIN m USING (u) GROUP BY 1""")
def weighted_vote(spark: SparkSession, d: str) -> DataFrame:
    signals = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("uid"), F.col("l_returnflag").alias("domain"), F.col("l_linestatus").alias("signal"), F.col("l_linenumber").alias("signal_ord"), F.col("l_quantity").alias("amount")
    )
    return labels.vote(signals, ["A", "N", "R"]).select("uid", "domain", "domains")


@query("token_batches")
def token_batches(spark: SparkSession, d: str) -> DataFrame:
    return packing.token_batches(table(spark, d, "documents"), "doc_id", "n_chars", 20_000, 16, shards=4)


# ---- relational queries, as plain SQL that both engines read

REGISTRY.sql("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
  round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus""")
REGISTRY.sql("counts_by_keys", "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source))")
REGISTRY.sql("top_n_counter", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
REGISTRY.sql("length_histogram", """SELECT CASE WHEN n_chars < 500 THEN '0' WHEN n_chars < 2000 THEN '500' WHEN n_chars < 8000 THEN '2000' ELSE '8000' END AS bucket, count(*) AS n, min(n_chars) AS lo, max(n_chars) AS hi FROM documents GROUP BY 1""")
REGISTRY.sql("lookup_join_coalesce", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR(9)), 'unknown') AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'unknown') AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
REGISTRY.sql("set_algebra", """SELECT count(*) AS n, CAST(sum(CASE WHEN a = 1 AND b = 1 THEN 1 ELSE 0 END) AS BIGINT) AS in_both, CAST(sum(CASE WHEN a = 1 AND b = 0 THEN 1 ELSE 0 END) AS BIGINT) AS only_docs, CAST(sum(CASE WHEN a = 0 AND b = 1 THEN 1 ELSE 0 END) AS BIGINT) AS only_labels
  FROM (SELECT doc_id, max(a) AS a, max(b) AS b FROM (SELECT doc_id, 1 AS a, 0 AS b FROM documents UNION ALL SELECT doc_id, 0, 1 FROM labels WHERE toxic = 1) GROUP BY doc_id)""")
REGISTRY.sql("lead_edges", "SELECT conv_id, turn AS start_turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS end_turn FROM conversations")
REGISTRY.sql("version_numbers", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) AS BIGINT) AS version FROM lineitem")
@query("star_links", "SELECT doc_id, hub FROM (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY md5(text)) AS hub FROM documents) WHERE doc_id <> hub AND text <> ''")
def star_links(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return profiles.star_links(t, "doc_id", F.when(F.col("text") != "", F.md5("text")))


REGISTRY.sql("degrees", "SELECT l_partkey, count(*) AS in_degree, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_partkey")
REGISTRY.sql("confusion_matrix", "SELECT quality, CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS toxic, CAST(sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) AS clean FROM labels GROUP BY quality")
REGISTRY.sql("interval_join", """SELECT o.o_orderkey, count(*) AS n FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate >= o.o_orderdate AND l.l_shipdate < o.o_orderdate + INTERVAL 60 DAYS GROUP BY o.o_orderkey""")
REGISTRY.sql("chat_turn_classes", "SELECT kind, count(*) AS n FROM (SELECT conv_id, CASE WHEN sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) = 0 THEN 'none' WHEN sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) = 1 THEN 'single' ELSE 'multi' END AS kind FROM conversations GROUP BY conv_id) GROUP BY kind")
REGISTRY.sql("revenue_by_nation", """SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name""")
REGISTRY.sql("hourly_events", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")


# ---- further operators on the star schema and the text tables


@query("table_line_strip", r"""WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT contains(x, '|')) x FROM documents),
  t AS (SELECT doc_id, CASE WHEN length(text) > 1000 THEN substr(array_to_string(x, chr(10)), 1, 2000) ELSE text END AS t, length(text) > 1000 AS long FROM l) SELECT doc_id, length(t) AS n_kept, sha1(t) AS sha FROM t WHERE NOT long OR length(t) >= 200""")
def table_line_strip(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", records.table_lines_gone(F.col("text")).alias("t")).where("t IS NOT NULL")
    return t.select("doc_id", F.length("t").cast("long").alias("n_kept"), F.sha1("t").alias("sha"))


@query("last_user_message", """WITH a AS (SELECT conv_id, max(turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT c.conv_id, count(*) AS n_before, arg_max(text, turn) AS asked FROM conversations c JOIN a USING (conv_id) WHERE turn < t GROUP BY 1""")
def last_user_message(spark: SparkSession, d: str) -> DataFrame:
    """The messages before the last assistant turn: how many, and the last of them."""
    c = table(spark, d, "conversations")
    last = c.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("t"))
    return c.join(last, "conv_id").where("turn < t").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_before"), F.max_by("text", "turn").alias("asked"))


@query("loose_and_exact_keys", """SELECT source, count(*) AS n, count(DISTINCT sha1(text)) AS n_exact, count(DISTINCT sha1(lower(regexp_replace(text, '[^a-zA-Z]', '', 'g')))) AS n_loose FROM documents GROUP BY 1""")
def loose_and_exact_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(F.sha1("text")).alias("n_exact"), F.countDistinct(F.sha1(F.lower(F.regexp_replace("text", "[^a-zA-Z]", "")))).alias("n_loose")
    )


@query("leak_levels", """WITH t AS (SELECT l_partkey p, l_suppkey s FROM lineitem WHERE l_returnflag <> 'R'), e AS (SELECT l_orderkey, l_linenumber, l_partkey p, l_suppkey s FROM lineitem WHERE l_returnflag = 'R')
SELECT l_orderkey, l_linenumber, CASE WHEN (p, s) IN (SELECT (p, s) FROM t) THEN 'both' WHEN p IN (SELECT p FROM t) THEN 'question' WHEN s IN (SELECT s FROM t) THEN 'answer' ELSE 'clean' END AS level FROM e""")
def leak_levels(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation rows (those returned) by what of them the training rows (all others) hold: the pair, its first part, or its second."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    known, eval_ = rows.where("l_returnflag <> 'R'"), rows.where("l_returnflag = 'R'")
    keys = {"both": ["l_partkey", "l_suppkey"], "question": ["l_partkey"], "answer": ["l_suppkey"]}
    return decontamination.leak_levels(eval_, known, keys, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "level")


@query("text_leak_levels", r"""WITH n AS (SELECT doc_id AS id, lower(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS a, text FROM documents), e AS (SELECT item_id, lower(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS a, text FROM benchmark)
SELECT item_id, CASE WHEN text IN (SELECT text FROM n) THEN 'exact' WHEN a IN (SELECT a FROM n) THEN 'normalised' ELSE 'clean' END AS level FROM e""")
def text_leak_levels(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items that are a training document word by word, or once case and all but letters are gone."""
    keyed = lambda name, *c: table(spark, d, name).select(*c, F.sha1("text").alias("t"), F.sha1(F.lower(F.regexp_replace("text", "[^a-zA-Z]", ""))).alias("n"))
    return decontamination.leak_levels(keyed("benchmark", "item_id"), keyed("documents"), {"exact": ["t"], "normalised": ["n"]}, ["item_id"]).select("item_id", "level")


@query("dense_ceiling", """WITH r AS (SELECT o_custkey q, o_orderkey doc, o_orderpriority LIKE '1%' AS gold, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) k FROM orders)
SELECT q AS query_id, min(CASE WHEN gold THEN k END) AS first_gold, count(*) FILTER (gold AND k <= 3) AS at3, count(*) FILTER (gold) AS n_gold FROM r GROUP BY 1""")
def dense_ceiling(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    gold = F.col("o_orderpriority").like("1%")
    ranked = table(spark, d, "orders").withColumn("k", F.row_number().over(w))
    return ranked.groupBy(F.col("o_custkey").alias("query_id")).agg(
        F.min(F.when(gold, F.col("k"))).cast("long").alias("first_gold"), F.count_if(gold & (F.col("k") <= 3)).alias("at3"), F.count_if(gold).alias("n_gold")
    )


@query("fusion_sweep", f"""WITH {LISTS}, p AS (SELECT k, w FROM (VALUES (5), (10), (60)) a(k), (VALUES (0.5), (0.7), (1.0)) b(w)), g AS (SELECT o_orderkey AS doc_id FROM orders WHERE o_orderpriority LIKE '1%'),
s AS (SELECT k, w, query_id, doc_id, round(sum(CASE source WHEN 'dense' THEN 1.0 ELSE w END / (k + rank)), 9) AS s FROM l, p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY k, w, query_id ORDER BY s DESC, doc_id) AS i FROM s)
SELECT k, CAST(w AS DOUBLE) AS w, count(*) FILTER (i <= 3 AND doc_id IN (SELECT doc_id FROM g)) AS hits FROM r GROUP BY 1, 2""")
def fusion_sweep(spark: SparkSession, d: str) -> DataFrame:
    """A grid of fusion parameters over the same candidates: one join with the parameters, one pass for all of them."""
    grid = spark.createDataFrame([(k, w) for k in (5, 10, 60) for w in (0.5, 0.7, 1.0)], "k int, w double")
    weight = F.when(F.col("source") == "dense", 1.0).otherwise(F.col("w"))
    scored = _lists(spark, d).crossJoin(F.broadcast(grid)).groupBy("k", "w", "query_id", "doc_id").agg(F.round(F.sum(weight / (F.col("k") + F.col("rank"))), 9).alias("s"))
    i = F.row_number().over(Window.partitionBy("k", "w", "query_id").orderBy(F.col("s").desc(), "doc_id"))
    gold = table(spark, d, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("gold"))
    best = scored.withColumn("i", i).where("i <= 3").join(gold, "doc_id", "left")
    return best.groupBy("k", "w").agg(F.count("gold").alias("hits"))


@query("stratified_holdout", """WITH c AS (SELECT doc_id, quality || '-' || toxic AS combo, count(*) OVER (PARTITION BY quality, toxic) n FROM labels), s AS (SELECT doc_id, CASE WHEN n < 20 THEN '__other__' ELSE combo END AS stratum FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY substr(sha1('dev' || chr(0) || doc_id), 1, 16)) k, count(*) OVER (PARTITION BY stratum) n FROM s)
SELECT doc_id, stratum, n >= 2 AND k <= greatest(1, n // 10) AS dev FROM r""")
def stratified_holdout(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of each combination of labels by hash, one at least of two or more; rare combinations are one stratum."""
    return sampling.stratified_holdout(table(spark, d, "labels"), "doc_id", F.concat_ws("-", F.col("quality").cast("string"), F.col("toxic").cast("string")))


@query("trace_rollup", """SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks, list_sort(list(value))[1 + count(*) // 2] AS p50 FROM events GROUP BY 1""")
def trace_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Counts and the upper median per key."""
    e = table(spark, d, "events")
    middle = metrics.nearest_rank(e, ["user_id"], "value", {"p50": 0.5})
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks")).join(middle, "user_id")


REGISTRY.sql("nested_key_profile", "SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN props LIKE '%\"k\"%' THEN 1 ELSE 0 END) AS BIGINT) AS with_k, CAST(min(length(props)) AS BIGINT) AS shortest, CAST(max(length(props)) AS BIGINT) AS longest FROM events GROUP BY event_type")
REGISTRY.sql("backfill_attribute", "SELECT c.c_custkey, coalesce(CASE WHEN c.c_acctbal > 0 THEN c.c_mktsegment END, n.n_name) AS segment FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
REGISTRY.sql("cross_tab_share", "SELECT lang, source, count(*) AS n, round(CAST(100 AS DOUBLE) * count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS pct FROM documents GROUP BY lang, source")
REGISTRY.sql("scoped_id_collisions", "SELECT turn, count(*) AS n, count(DISTINCT conv_id) AS ids FROM conversations GROUP BY turn HAVING count(*) > 1")
REGISTRY.sql("label_sets_by_source", "SELECT d.source, count(*) AS n, avg(CAST(l.quality AS DOUBLE)) AS good, CAST(sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unlabelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source")


@query("source_selection", """SELECT s_suppkey, CASE WHEN s_nationkey > 20 THEN 'grade' WHEN s_acctbal < 0 THEN 'usage' WHEN s_suppkey % 7 = 0 THEN 'skipped' END AS reason FROM supplier""")
def source_selection(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that rejects a source; null where it is taken."""
    rules = [("grade", "s_nationkey > 20"), ("usage", "s_acctbal < 0"), ("skipped", "s_suppkey % 7 = 0")]
    reason = F.expr("CASE " + " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in rules) + " END")
    return table(spark, d, "supplier").select("s_suppkey", reason.alias("reason"))


@query("target_gaps", """WITH t(lang, target) AS (VALUES ('en', 100), ('fr', 200), ('xx', 5)), h AS (SELECT lang, count(*) n FROM documents GROUP BY 1)
SELECT t.lang, CAST(target AS BIGINT) AS target, coalesce(n, 0) AS have, CAST(greatest(0, target - coalesce(n, 0)) AS BIGINT) AS gap, coalesce(n, 0) / target AS ratio FROM t LEFT JOIN h USING (lang)""")
def target_gaps(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.createDataFrame([("en", 100), ("fr", 200), ("xx", 5)], "lang string, target long")
    have = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return targets.join(have, "lang", "left").select("lang", "target", n.alias("have"), F.greatest(F.lit(0).cast("long"), F.col("target") - n).alias("gap"), (n / F.col("target")).alias("ratio"))


@query("vector_threshold_join", """WITH q AS (SELECT vec_id q, CAST(embedding AS DOUBLE[]) e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q, vec_id, round(list_cosine_similarity(e, CAST(embedding AS DOUBLE[])), 6) AS cosine FROM q, embeddings WHERE vec_id <> q)
SELECT q AS query_id, vec_id AS doc_id, cosine FROM s WHERE cosine > 0.2 QUALIFY row_number() OVER (PARTITION BY q ORDER BY cosine DESC, vec_id) = 1""")
def vector_threshold_join(spark: SparkSession, d: str) -> DataFrame:
    """The nearest other vector of each query above a cosine. The queries are the stated set, sent along in blocks."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), retrieval.normalised(F.col("embedding")).alias("v"))
    q = v.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    return retrieval.vector_search(v, q, 1, least=0.2, itself=False).select("query_id", "doc_id", F.col("score").alias("cosine"))


@query("utilisation_mean", """SELECT label, i - 1 AS place, round(avg(embedding[i]), 6) AS mean FROM embeddings, range(1, 65) r(i) WHERE i <= len(embedding) GROUP BY 1, 2""")
def utilisation_mean(spark: SparkSession, d: str) -> DataFrame:
    """Element-wise means of vectors."""
    return metrics.utilisation(table(spark, d, "embeddings"), ["label"], "embedding").withColumn("mean", F.round("mean", 6))


@query("page_facts", """SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, len(regexp_extract_all(html, '<a ')) AS links, len(regexp_extract_all(html, '<p')) AS paragraphs FROM pages""")
def page_facts(spark: SparkSession, d: str) -> DataFrame:
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), n("<a ").alias("links"), n("<p").alias("paragraphs"))


@query("judge_agreement", """WITH j AS (SELECT l_orderkey c, l_linenumber j, avg(l_quantity) s FROM lineitem GROUP BY ALL), p AS (SELECT a.j AS a, b.j AS b, a.s x, b.s y FROM j a JOIN j b USING (c) WHERE a.j < b.j),
r AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM p)
SELECT a, b, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1, 2""")
def judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Correlations of all pairs of judges over the cases that both judged."""
    j = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.avg("l_quantity").alias("s"))
    return metrics.agreement(j, "l_orderkey", "l_linenumber", "s").withColumn("pearson", F.round("pearson", 6)).withColumn("spearman", F.round("spearman", 6))


from granary.plans import corpus, evaluation, graphs, indexes, logs  # noqa: E402, F401  (they register their queries)
