"""Queries over corpora: text functions, records and their labels, decontamination, sources. Chinese texts are made of table columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import lexicon
from granary.functions import text as X
from granary.operators import decontamination, profiles, records, sampling, statutes
from granary.plans.catalog_sql import simhash_sql
from granary.plans.registry import REGISTRY, rows_of, table
from granary.sources import io

query = REGISTRY.query
NL = "chr(10)"


def over(name: str, base: str, oracle: str):
    """Registers a function of the rows of a base query in SQL; {base} in the oracle stands for the same."""

    def add(fn):
        query(name, oracle.replace("{base}", f"({base})"))(lambda spark, d: fn(rows_of(spark, d, base)))
        return fn

    return add


def listed(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"


# ---- text functions

ANSWERS = """SELECT o_orderkey AS id, CASE o_orderkey % 14 WHEN 0 THEN 'C: ' || o_orderpriority WHEN 1 THEN '答案是AB' WHEN 2 THEN 'c: text' WHEN 3 THEN '- C: ' || repeat('long text ', 12) WHEN 4 THEN '答案是c。' || repeat('好', 80)
  WHEN 5 THEN '**B**' WHEN 6 THEN '# D. ' || o_orderpriority WHEN 7 THEN '> a,b' WHEN 8 THEN 'ABCDEFG x' WHEN 9 THEN '' WHEN 10 THEN NULL WHEN 11 THEN 'either A or F?' WHEN 12 THEN '正确选项：bd ' || o_orderpriority ELSE o_orderpriority END AS t FROM orders"""
HEAD, KEY = lexicon.CHOICE_HEAD.replace(r"\s*(?=[:：、,，.。\s]|\z)", r"(?:[:：、,，.。\s]|$)"), lexicon.CHOICE_KEY
_LETTERS = r"""CASE WHEN regexp_matches(trim({t}), '@HEAD') THEN regexp_extract(trim({t}), '@HEAD', 1) WHEN regexp_matches(substr(trim({t}), 1, 400), '@KEY') THEN regexp_extract(substr(trim({t}), 1, 400), '@KEY', 1)
  WHEN length(trim({t})) <= 60 THEN array_to_string(regexp_extract_all(' ' || regexp_replace(trim({t}), '[^A-Za-z]', '  ', 'g') || ' ', ' ([A-F]) ', 1), '') ELSE '' END""".replace("@HEAD", HEAD).replace("@KEY", KEY)


def letters(t: str) -> str:
    """SQL for the letters of an answer."""
    return f"list_sort(list_distinct(list_filter(string_split(upper({_LETTERS.replace('{t}', t)}), ''), lambda c: c <> '')))"


@over("choice_letters", ANSWERS, f"SELECT id, {letters('coalesce(t, chr(32))')} AS letters FROM {{base}}")
def choice_letters(rows: DataFrame) -> DataFrame:
    return rows.select("id", X.choice_letters(F.col("t")).alias("letters"))


TITLED = """SELECT p_partkey AS id, p_brand AS file, CASE p_partkey % 7 WHEN 0 THEN '《' || p_name || '法(2019修正)(2020修订)》' WHEN 1 THEN '《 ' || p_name || '法（试行）》' WHEN 2 THEN '《《' || p_name || '法(2018年修改)》》'
  WHEN 3 THEN p_name || '法[1999废止] ' WHEN 4 THEN p_name || '法（2020年12月修正）' WHEN 5 THEN '《' || p_name || '法》' ELSE p_name || '法' END AS title FROM part"""
L1 = r"replace(replace(regexp_replace(regexp_replace(trim(title), '^《《?|》?》$', '', 'g'), '\s+', '', 'g'), '（', '('), '）', ')')"
L2 = rf"regexp_replace({L1}, '(?:{lexicon.VERSION})+$', '')"


@over("title_versions", TITLED, f"SELECT id, {L1} AS l1, {L2} AS l2 FROM {{base}}")
def title_versions(rows: DataFrame) -> DataFrame:
    l1 = X.strip_wrappers(F.col("title"))
    return rows.select("id", l1.alias("l1"), X.strip_version(l1).alias("l2"))


@over("title_unwrapped", TITLED, f"SELECT id, {L1} AS l1 FROM {{base}}")
def title_unwrapped(rows: DataFrame) -> DataFrame:
    return rows.select("id", X.strip_wrappers(F.col("title"), None).alias("l1"))


@over("title_statistics", TITLED, f"""WITH x AS (SELECT file, trim(title) AS raw, {L1} AS l1, {L2} AS l2 FROM {{base}}), u AS (SELECT file, count(*) AS rows, count(DISTINCT raw) AS raw_unique, count(DISTINCT l1) AS l1_unique, count(DISTINCT l2) AS l2_unique FROM x GROUP BY 1),
g AS (SELECT file, count(*) FILTER (n > 1) AS merged_groups FROM (SELECT file, l2, count(DISTINCT raw) AS n FROM x GROUP BY 1, 2) GROUP BY 1)
SELECT u.*, raw_unique - l1_unique AS merged_l1, l1_unique - l2_unique AS merged_l2, merged_groups, CAST(0 AS BIGINT) AS over_split FROM u JOIN g USING (file)""")
def title_statistics(rows: DataFrame) -> DataFrame:
    return statutes.title_statistics(rows, "file", "title")


@over("title_overlap", TITLED, f"""WITH x AS (SELECT DISTINCT file, unnest(['raw', 'l1', 'l2']) AS level, unnest([trim(title), {L1}, {L2}]) AS t FROM {{base}})
SELECT a.file AS a, b.file AS b, a.level AS level, count(*) AS shared FROM x a JOIN x b ON a.level = b.level AND a.t = b.t AND a.file < b.file GROUP BY ALL""")
def title_overlap(rows: DataFrame) -> DataFrame:
    return statutes.title_overlap(rows, "file", "title")


@over("several_versions", TITLED, f"SELECT l2 AS canonical, count(*) AS n FROM (SELECT DISTINCT trim(title) AS raw, {L2} AS l2 FROM {{base}}) GROUP BY 1 HAVING count(*) > 1")
def several_versions(rows: DataFrame) -> DataFrame:
    return statutes.several_versions(rows, "title")


BROKEN = f"SELECT doc_id, replace(replace(text, '. ', '.' || chr(92) || ' ' || {NL}), ', ', ',  ' || {NL} || {NL} || {NL}) AS t FROM documents"


@over("clean_lines", BROKEN, r"""SELECT doc_id, sha1(trim(regexp_replace(regexp_replace(regexp_replace(t, '\\\s*\n', '', 'g'), '[ \t　]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))) AS sha FROM {base}""")
def clean_lines(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.sha1(X.clean_lines(F.col("t"))).alias("sha"))


@query("sentence_scrub_counts", "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), 'the')) AS BIGINT) AS n_the, CAST(len(regexp_extract_all(lower(text), 'que')) AS BIGINT) AS n_que FROM documents")
def scrub_counts(spark: SparkSession, d: str) -> DataFrame:
    c = X.scrub_counts(F.lower("text"), ["the", "que"])
    return table(spark, d, "documents").select("doc_id", c["the"].cast("long").alias("n_the"), c["que"].cast("long").alias("n_que"))


@query("seeded_order", """SELECT l_orderkey, string_agg(x, ',' ORDER BY sha1('42:' || l_orderkey || chr(0) || x)) AS shown FROM (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS VARCHAR) AS x FROM lineitem) GROUP BY 1""")
def seeded_order(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of a case in an order that only the seed and the case decide."""
    c = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_linenumber").cast("string")).alias("x"))
    return c.select("l_orderkey", F.array_join(X.seeded_order(F.col("x"), "42", F.col("l_orderkey").cast("string")), ",").alias("shown"))


@query("prompt_and_names", """SELECT s_suppkey, '题目：' || s_name || ' 要求：' || CASE WHEN s_acctbal >= 0 THEN '不是' ELSE '是' END AS prompt, replace('org/' || s_name, '/', '__') AS slug, lower(trim(' LexEval ')) || '::case-' || printf('%05d', s_suppkey) AS case_id,
  CASE WHEN s_suppkey < 1 THEN printf('%.1fB', s_suppkey * 1000.0) WHEN s_suppkey * 1000 < 1024 THEN printf('%.1fB', s_suppkey * 1000.0) WHEN s_suppkey * 1000 < 1048576 THEN printf('%.1fKB', s_suppkey * 1000 / 1024.0) ELSE printf('%.1fMB', s_suppkey * 1000 / 1048576.0) END AS size,
  round(100.0 * s_nationkey / 25, 2) AS pct FROM supplier""")
def prompt_and_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("s_name")
    return table(spark, d, "supplier").select(
        "s_suppkey", X.filled("题目：{q} 要求：{d}", q=name, d=X.rubric_direction(F.col("s_acctbal"))).alias("prompt"), X.slug(F.concat(F.lit("org/"), name)).alias("slug"),
        X.case_id(F.lit(" LexEval "), F.col("s_suppkey")).alias("case_id"), X.human_size(F.col("s_suppkey") * 1000).alias("size"), X.percent(F.col("s_nationkey"), F.lit(25)).alias("pct"),
    )


@query("log_progress", """SELECT user_id, CAST(max(event_id) AS VARCHAR) AS last_id, arg_max(CAST(json_extract(props, '$.k') AS VARCHAR), event_id) AS last_rc FROM events GROUP BY 1""")
def log_progress(spark: SparkSession, d: str) -> DataFrame:
    """The last progress and return code in a log whose lines are written over."""
    line = F.concat(F.lit("step ["), F.col("event_id").cast("string"), F.lit("/99] rc="), F.get_json_object("props", "$.k"), F.lit("\r"))
    log = table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("s")))), lambda x: x["s"]), "").alias("log"))
    return log.select("user_id", X.last_match(F.col("log"), r"\[(\d+)/99\]").alias("last_id"), X.last_match(F.col("log"), r"rc=(-?\d+)").alias("last_rc"))


@query("document_texts", "SELECT doc_id, source || ' ' || substr(text, 1, 500) AS t FROM documents")
def document_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.document_text(F.col("source"), F.col("text")).alias("t"))


@query("mix_parser", "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS civil, CAST(c_custkey AS BIGINT) AS criminal FROM customer")
def mix_parser(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("civil="), F.col("c_nationkey").cast("string"), F.lit(", criminal="), F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", X.mix(text).alias("m")).select("c_custkey", F.col("m.civil").alias("civil"), F.col("m.criminal").alias("criminal"))


THOUGHT = "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '<think>a</think>b</think> ' || text WHEN turn % 3 = 1 THEN '<think>open ' || text ELSE text END AS t, text FROM conversations"


@over("think_tags", THOUGHT, "SELECT conv_id, turn, trim(CASE WHEN turn % 3 = 0 THEN 'b</think> ' || text ELSE t END, ' ') AS first, trim(CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN '' ELSE t END, ' ') AS last FROM {base}")
def think_tags(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", X.after_think(F.col("t")).alias("first"), X.after_think(F.col("t"), last=True).alias("last"))


# ---- statutes

SUPPLIED = f"""SELECT s_nationkey AS doc_id, '目 录' || {NL} || '第一章总则' || {NL} || '第二章 分则' || {NL} || {NL} || '第一章总则' || {NL}
  || array_join(transform(array_sort(collect_list(IF(s_suppkey % 2 = 0, struct(s_suppkey AS k, s_name AS n, s_acctbal AS a), NULL))), x -> concat('第', x.k, '条　', x.n, {NL}, '余额 ', x.a, '  ', {NL}, {NL})), '') || '　第二章 分则' || {NL}
  || array_join(transform(array_sort(collect_list(IF(s_suppkey % 2 = 1, struct(s_suppkey AS k, s_name AS n, s_acctbal AS a), NULL))), x -> concat('第', x.k, '条之一 ', x.n, {NL}, '序言', {NL}, '不在条内', {NL})), '') || '附  则' || {NL} || '尾部' AS text FROM supplier GROUP BY 1"""


@query("split_articles", f"""SELECT CAST(s_nationkey AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 2, s_suppkey) AS INT) AS seq, CASE s_suppkey % 2 WHEN 0 THEN '第一章总则' ELSE '第二章 分则' END AS chapter,
  '第' || s_suppkey || CASE s_suppkey % 2 WHEN 0 THEN '条' ELSE '条之一' END AS label, CASE s_suppkey % 2 WHEN 0 THEN s_name || {NL} || '余额 ' || s_acctbal ELSE s_name END AS text FROM supplier""")
def split_articles(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as articles of their nation's statute, with a table of contents, headings with and without a blank, and a preamble in between."""
    return statutes.split_articles(rows_of(spark, d, SUPPLIED), "doc_id", "text").select("doc_id", "seq", "chapter", "label", "text")


STATUTES = """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '刑法修正案' WHEN 1 THEN '关于批准民事诉讼法的决定' WHEN 2 THEN '附件一' WHEN 3 THEN '合同法解释' WHEN 4 THEN '森林公园办法' ELSE '国家安全条例' END AS title,
  CASE p_partkey % 5 WHEN 0 THEN '法律' WHEN 1 THEN '司法解释' WHEN 2 THEN '地方性法规' WHEN 3 THEN '行政法规' ELSE '' END AS type, CASE p_size % 4 WHEN 0 THEN '有效' WHEN 1 THEN ' 已废止' WHEN 2 THEN '失效' ELSE '' END AS status,
  repeat(p_name, p_size) AS text FROM part"""


@over("no_item_reasons", STATUTES, """SELECT id, CASE WHEN contains(title, '修正案') THEN 'AMENDMENT_INSTRUCTION' WHEN contains(title, '附件') THEN 'ANNEX_DOC' WHEN regexp_matches(title, '批准|决议|决定') THEN 'DECISION_OR_RATIFICATION' WHEN length(text) < 200 THEN 'TOO_SHORT_TO_CONTAIN_ARTICLE' ELSE 'FORMAT_UNRECOGNIZED' END AS reason FROM {base}""")
def no_item_reasons(rows: DataFrame) -> DataFrame:
    return rows.select("id", X.no_item_reason(F.col("title"), F.col("text")).alias("reason"))


def first_word(text: str, lists: dict[str, str], domain: bool = True) -> str:
    """SQL for the first domain (or word) of which a text holds a word."""
    cases = " ".join(f"WHEN contains({text}, '{w}') THEN '{k if domain else w}'" for k, words in lists.items() for w in words.split())
    return f"CASE {cases} END"


@over("title_domains", STATUTES, f"SELECT id, coalesce({first_word('title', lexicon.TITLES)}, 'general') AS domain, {first_word('title', lexicon.TITLES, False)} AS keyword, {first_word('title', lexicon.LAW_NAMES)} AS law FROM {{base}}")
def title_domains(rows: DataFrame) -> DataFrame:
    return rows.select("id", X.title_domain(F.col("title")).alias("t"), X.law_domain(F.col("title")).alias("law")).select("id", "t.domain", "t.keyword", "law")


@over("standing_and_types", STATUTES, "SELECT id, CASE WHEN trim(status) IN ('有效', '已修改', '已废止', '尚未生效') THEN trim(status) ELSE '未知' END AS standing FROM {base} WHERE trim(type) IN ('法律', '法律解释', '司法解释', '行政法规')")
def standing_and_types(rows: DataFrame) -> DataFrame:
    return statutes.kept_types(rows).select("id", statutes.standing(F.col("status")).alias("standing"))


@over("dirty_standing", STATUTES, "SELECT trim(status) AS status, count(*) AS n FROM {base} WHERE trim(status) NOT IN ('有效', '已修改', '已废止', '尚未生效') GROUP BY 1")
def dirty_standing(rows: DataFrame) -> DataFrame:
    return statutes.dirty_standing(rows)


HEADED = f"""SELECT p_partkey AS id, p_name || '办法' AS title, '最高法院' || {NL} || '关于' || p_name || '办法的批复' || {NL} || '(2021年5月通过)' || {NL} || '> 法释' || {NL} || {NL} || p_type || '正文' || {NL} || '(末尾)' AS text FROM part"""


@over("without_header", f"SELECT id, replace(title, ' ', '') || '最高法院关于的批复' AS title, replace(text, '关于' || substr(title, 1, length(title) - 2) || '办法的批复' || {NL}, replace(title, ' ', '') || {NL}) AS text FROM ({HEADED})", f"SELECT p_partkey AS id, p_type || '正文' || {NL} || '(末尾)' AS text FROM part")
def without_header(rows: DataFrame) -> DataFrame:
    """Texts without the lines in front that repeat their title, stand in brackets or give a file number."""
    return rows.select("id", X.without_header(F.col("title"), F.col("text")).alias("text"))


@over("whole_documents", f"SELECT CAST(id AS STRING) AS doc_id, title, text FROM ({STATUTES})", """WITH i AS (SELECT CAST(p_partkey AS STRING) AS doc_id FROM part WHERE p_size % 2 = 0)
SELECT doc_id, title, CASE WHEN contains(title, '修正案') THEN 'AMENDMENT_INSTRUCTION' WHEN contains(title, '附件') THEN 'ANNEX_DOC' WHEN regexp_matches(title, '批准|决议|决定') THEN 'DECISION_OR_RATIFICATION' WHEN length(text) < 200 THEN 'TOO_SHORT_TO_CONTAIN_ARTICLE' ELSE 'FORMAT_UNRECOGNIZED' END AS reason,
  CASE WHEN NOT contains(title, '修正案') AND length(trim(text)) >= 60 THEN trim(text) END AS text FROM {base} WHERE doc_id NOT IN (SELECT doc_id FROM i)""")
def whole_documents(rows: DataFrame) -> DataFrame:
    """Statutes without articles (here those of odd size) and what of them stands as a whole."""
    with_items = rows.where((F.length("text") / F.length(F.regexp_replace("text", "^(.+?)\\1*$", "$1"))) % 2 == 0)
    return statutes.whole_documents(rows, with_items)


# ---- records

ASKED = """SELECT 'org/set' AS source_dataset, 'raw/a.jsonl' AS source_file, o_orderkey AS source_index, CAST(o_orderkey AS STRING) AS source_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'sent_pred' WHEN '2-HIGH' THEN 'crime_concept' WHEN '3-MEDIUM' THEN 'exam' WHEN '5-LOW' THEN 'jud_doc_sum' ELSE 'legal_advice' END AS task, '' AS system,
  CASE o_orderkey % 5 WHEN 0 THEN '依照《中华人民共和国刑法》如何量刑' WHEN 1 THEN '《合同法》与《民事诉讼法》的管辖和赔偿' WHEN 2 THEN '起诉 证据 上诉 再审 执行' WHEN 3 THEN '天气如何' ELSE '' END AS instruction,
  CASE o_custkey % 4 WHEN 0 THEN '刑事判决书:盗窃' WHEN 1 THEN '民事判决书:离婚' WHEN 2 THEN '' ELSE '普通文字' END AS input,
  CASE o_custkey % 3 WHEN 0 THEN '依据《劳动法》和《合同法》' WHEN 1 THEN '见《行政诉讼法》' ELSE '无' END AS output, CAST(array() AS ARRAY<STRING>) AS references FROM orders"""
ASKED_DUCK = ASKED.replace("CAST(array() AS ARRAY<STRING>)", "CAST([] AS VARCHAR[])").replace("AS references", 'AS "references"')
SQL_RECORD = f"""b AS ({ASKED_DUCK}), r AS (SELECT *, 'org__set__a:' || source_index AS uid, CASE WHEN instruction <> '' THEN instruction ELSE substr(input, 1, 300) END AS ask,
  regexp_extract_all(instruction || ' ' || CASE WHEN instruction <> '' THEN '' ELSE input END, '《([^《》]+)》', 1) AS q FROM b),
k AS (SELECT *, list_filter(regexp_extract_all(output, '《([^《》]+)》', 1), lambda x: NOT list_contains(q, x)) AS a,
  CASE WHEN task IN ('sent_pred', 'jud_doc_sum') THEN 'case_analysis' WHEN task = 'exam' THEN 'exam' WHEN task = 'crime_concept' THEN 'concept' ELSE 'qa' END AS kind FROM r)"""


@query("build_records", f"""WITH {SQL_RECORD} SELECT uid, kind AS task_kind, ask, list_distinct(q) AS refs_question, a AS refs_answer, sha1(instruction || chr(30) || input || chr(30) || output || chr(30)) AS content_sha1,
  CASE WHEN input = '' THEN '' ELSE sha1(input || chr(30)) END AS case_sha1, CAST(2 AS BIGINT) AS n_messages, CASE WHEN instruction <> '' THEN trim(instruction || chr(10) || input, ' ' || chr(10)) ELSE input END AS asked FROM k""".replace("list_distinct(q)", "q"))
def build_records(spark: SparkSession, d: str) -> DataFrame:
    r = records.build(rows_of(spark, d, ASKED))
    user = F.filter("messages", lambda m: m["role"] == "user")[0]["content"]
    return r.select("uid", "task_kind", "ask", "refs_question", "refs_answer", "content_sha1", "case_sha1", F.size("messages").cast("long").alias("n_messages"), F.trim(user, F.lit(" \n")).alias("asked"))


def _votes() -> str:
    """SQL for (uid, domain, signal, o, amount) of all signals."""
    law = first_word("x", lexicon.LAW_NAMES)
    parts = [
        f"SELECT uid, kind, {law} AS domain, 'statute_ref_in_question' AS signal, 0 AS o, 2.0 AS amount FROM (SELECT uid, kind, unnest(q) AS x FROM k)",
        f"SELECT uid, kind, {law}, 'statute_ref_in_answer', 1, 1.0 FROM (SELECT uid, kind, unnest(a) AS x FROM k)",
        "SELECT uid, kind, CASE " + " ".join(f"WHEN contains(input, '{w}') THEN '{d}'" for w, d in lexicon.DOCUMENT_TYPES) + " END, 'doc_type', 2, 2.5 FROM k",
        "SELECT uid, kind, CASE WHEN task IN ('sent_pred', 'crime_concept') THEN 'criminal' END, 'task_hint', 3, 1.5 FROM k",
        "SELECT uid, kind, CASE WHEN task = 'crime_concept' THEN 'criminal' END, 'crime_concept', 4, 3.0 FROM k",
    ]
    parts += [f"SELECT uid, kind, '{d}', 'topic_keyword', 5, least({most}, {each} * len(list_filter({listed(words)}, lambda w: contains(ask, w)))) FROM k" for d, each, most, words in lexicon.TOPICS]
    return " UNION ALL ".join(parts)


ORDER = "CASE domain WHEN 'criminal' THEN 0 WHEN 'civil' THEN 1 WHEN 'procedural' THEN 2 ELSE 3 END"


@query("labelled_records", f"""WITH {SQL_RECORD}, v AS ({_votes()}), s AS (SELECT uid, domain, signal, min(o) AS o, sum(CASE WHEN kind = 'case_analysis' AND domain = 'procedural' THEN amount * 0.35 ELSE amount END) AS amount FROM v WHERE domain IS NOT NULL AND amount > 0 GROUP BY ALL),
d AS (SELECT uid, domain, sum(amount) AS score, arg_max(signal, amount * 1000 - o) AS source FROM s GROUP BY ALL), m AS (SELECT uid, max(score) AS most FROM d GROUP BY 1),
w AS (SELECT d.uid, arg_max(domain, round(score, 6) * 1000 - {ORDER}) AS domain, arg_max(source, round(score, 6) * 1000 - {ORDER}) AS source, list(domain ORDER BY {ORDER}) FILTER (score >= 0.6 * most) AS domains FROM d JOIN m USING (uid) GROUP BY 1)
SELECT uid, coalesce(w.domain, 'general') AS domain, coalesce(w.domains, ['general']) AS domains, coalesce(w.source, 'fallback') AS domain_source FROM k LEFT JOIN w USING (uid)""")
def labelled_records(spark: SparkSession, d: str) -> DataFrame:
    """Domains of records from all signals: titles cited, kinds of documents, tasks and topics, with the whole word lists."""
    return records.labelled(records.build(rows_of(spark, d, ASKED))).select("uid", "domain", "domains", "domain_source")


RAW = "SELECT 'a/b' AS source_dataset, 'x/fakao_gpt4.json' AS source_file, doc_id AS source_index, source || '-' || CAST(doc_id AS STRING) AS id, text AS input, lang AS output, lang AS instruction, 'legal_advice.json' AS source, '[\"' || lang || '\"]' AS reference, source AS prefix, source AS title, text AS content, lang AS type, source AS contents, lang AS num FROM documents"


@over("adapters", RAW, """SELECT 'triplets' AS adapter, id AS source_id, regexp_replace(id, '-[^-]*$', '') AS task, length(input) > 0 AS has_input, [output] AS refs FROM {base} UNION ALL SELECT 'files_by_task', 'exam-' || source_index, 'exam', length(input) > 0, [] FROM {base}
UNION ALL SELECT 'sources_by_task', 'legal_advice-' || source_index, 'legal_advice', length(input) > 0, [] FROM {base} UNION ALL SELECT 'statute_documents', type || '-' || source_index, 'statute_doc', false, [] FROM {base}
UNION ALL SELECT 'statute_articles', title || '-' || source_index, 'statute_item', false, [] FROM {base}""")
def adapters(rows: DataFrame) -> DataFrame:
    """The same rows through all adapters of the registry."""
    made = None
    for name, fn in records.ADAPTERS.items():
        x = fn(rows).select(F.lit(name).alias("adapter"), "source_id", "task", (F.length("input") > 0).alias("has_input"), F.col("references").alias("refs"))
        made = x if made is None else made.unionByName(x)
    return made


CHATS = "SELECT conv_id, array_sort(collect_list(struct(turn, role, text AS content))) AS m, min(text) AS ask, max(role) AS instruction FROM conversations GROUP BY conv_id"


@query("router_queries", """WITH f AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user' AND trim(text) <> '') AS said, min(text) AS ask FROM conversations GROUP BY 1) SELECT conv_id, sha1(coalesce(said, ask)) AS sha FROM f""")
def router_queries(spark: SparkSession, d: str) -> DataFrame:
    return rows_of(spark, d, CHATS).select("conv_id", F.sha1(records.router_query(F.col("m"), F.col("ask"), F.col("instruction"))).alias("sha"))


@query("until_last_answer", """WITH a AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS t, count(*) AS n FROM conversations GROUP BY 1) SELECT a.conv_id, CAST(CASE WHEN t IS NULL THEN n ELSE (SELECT count(*) FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn < t) END AS BIGINT) AS n_kept FROM a""")
def until_last_answer(spark: SparkSession, d: str) -> DataFrame:
    return rows_of(spark, d, CHATS).select("conv_id", F.size(records.until_last_answer(F.col("m"))).cast("long").alias("n_kept"))


@query("eval_texts", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_type ELSE p_name || chr(10) || p_type END AS t FROM part")
def eval_texts(spark: SparkSession, d: str) -> DataFrame:
    some = lambda c, k: F.when(F.col("p_size") % 3 != k, F.col(c))
    return table(spark, d, "part").select("p_partkey", records.eval_text(some("p_name", 1), some("p_type", 0), F.lit(None).cast("string")).alias("t"))


@query("domains_of_four", """SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'civil' WHEN c_nationkey % 3 = 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 'criminal' ELSE 'general' END ELSE 'general' END AS d4, CASE WHEN c_custkey % 2 = 0 THEN ['lora_a', 'x'] ELSE ['lora_a'] END AS labels FROM customer""")
def domains_of_four(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_nationkey") % 3
    labels = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("Criminal"))).otherwise(F.array(F.lit("criminal"), F.lit("civil")))
    raw = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("a"), F.lit("x"), F.lit("a"))).otherwise(F.array(F.lit("a")))
    return table(spark, d, "customer").select(
        "c_custkey", records.domain4(F.when(k == 0, " Civil ").otherwise("other"), F.when(k == 1, labels).otherwise(F.array(F.lit("unknown")))).alias("d4"), records.canonical_labels(raw, {"a": "lora_a"}).alias("labels")
    )


@query("regrouped_cases", "SELECT o_orderkey, coalesce(c_mktsegment, 'unknown') AS domain FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def regrouped_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("run::"), F.col("o_custkey").cast("string")).alias("case_id"))
    domains = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("uid"), F.col("c_mktsegment").alias("domain"))
    return records.regrouped(rows, domains, "case_id").select("o_orderkey", "domain")


@query("kept_files", "SELECT doc_id FROM documents WHERE (lang, source) NOT IN (SELECT lang, source FROM documents GROUP BY ALL ORDER BY count(*) DESC, lang, source LIMIT 3)")
def kept_files(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.col("lang").alias("source_dataset"), F.col("source").alias("source_file"))
    dropped = t.groupBy("source_dataset", "source_file").count().orderBy(F.col("count").desc(), "source_dataset", "source_file").limit(3)
    return records.kept_files(t, dropped).select("doc_id")


@query("cjk_predicate", "SELECT n_nationkey, n_nationkey % 2 = 0 AS cjk FROM nation")
def cjk_predicate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", records.has_cjk(F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, "法").otherwise("。"))).alias("cjk"))


# ---- decontamination

UNITS = """SELECT c_custkey AS idx, '{"id":"x","name":"' || c_name || '","tags":["' || c_mktsegment || '",{"type":"skip","note":"n"}],"n":3}' AS value FROM customer"""


@over("json_texts", UNITS, "SELECT c_custkey AS idx, c_name || c_mktsegment || 'n' AS text FROM customer")
def json_texts(rows: DataFrame) -> DataFrame:
    return rows.select("idx", decontamination.json_text(F.col("value")).alias("text"))


@over("blacklist_units", UNITS, "SELECT 'cust' AS tag, c_custkey AS idx, sha1(replace(c_name || c_mktsegment || 'n', ' ', '')) AS sha1, CAST(length(replace(c_name || c_mktsegment || 'n', ' ', '')) AS INT) AS n FROM customer")
def blacklist_units(rows: DataFrame) -> DataFrame:
    return decontamination.blacklist(rows, "cust", "value").select("tag", "idx", "sha1", "n")


def _sides(spark: SparkSession, d: str) -> DataFrame:
    rows = rows_of(spark, d, "SELECT 'd' || CAST(doc_id AS STRING) AS uid, text AS q, lang AS a FROM documents UNION ALL SELECT 'b' || CAST(item_id AS STRING), ' ' || text, CASE WHEN item_id % 2 = 0 THEN '' ELSE ' more' END FROM benchmark")
    return decontamination.sides(rows, "uid", F.col("q"), F.col("a"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return decontamination.fingerprinted(table(spark, d, "benchmark").select("item_id", "text"), "text")


BARE = r"regexp_replace({}, '[ \t\r\n　]', '', 'g')"
SQL_HITS = f"""s AS (SELECT 'd' || doc_id AS uid, unnest(['question', 'full']) AS side, unnest([{BARE.format('text')}, {BARE.format('text || lang')}]) AS t FROM documents
  UNION ALL SELECT 'b' || item_id, unnest(['question', 'full']), unnest([{BARE.format('text')}, {BARE.format("text || CASE WHEN item_id % 2 = 0 THEN '' ELSE ' more' END")}]) FROM benchmark),
h AS (SELECT uid, side, item_id FROM s JOIN benchmark ON s.t = {BARE.format('benchmark.text')} AND length(s.t) >= 8)"""


@query("exact_hits", f"WITH {SQL_HITS} SELECT uid, side, 'exact' AS kind, item_id, CAST(0 AS INT) AS distance FROM h")
def exact_hits(spark: SparkSession, d: str) -> DataFrame:
    """Sides of records that are an evaluation item word by word; the benchmark itself is among the records."""
    return decontamination.hits(_sides(spark, d), _items(spark, d), "uid", near=None)


NEAR_SQL = f"""{SQL_HITS}, r AS (SELECT uid || '/' || side AS r, uid, side, t FROM s WHERE length(t) >= 8 AND (uid, side) NOT IN (SELECT (uid, side) FROM h)), i AS (SELECT item_id, {BARE.format('text')} AS t FROM benchmark),
a AS (SELECT * FROM {simhash_sql("r", "r", "t")}), b AS (SELECT * FROM {simhash_sql("(SELECT * FROM i WHERE length(t) >= 8)", "item_id", "t")}),
m AS (SELECT r, item_id, CAST(bit_count(xor(a.hash, b.hash)) AS INT) AS distance FROM a, b WHERE bit_count(xor(a.hash, b.hash)) <= 3 QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, item_id) = 1)"""


@query("near_hits", f"WITH {NEAR_SQL} SELECT uid, side, 'exact' AS kind, item_id, CAST(0 AS INT) AS distance FROM h UNION ALL SELECT uid, side, 'near', item_id, distance FROM m JOIN r USING (r)")
def near_hits(spark: SparkSession, d: str) -> DataFrame:
    return decontamination.hits(_sides(spark, d), _items(spark, d), "uid")


@query("hit_attribution", f"WITH {SQL_HITS} SELECT count(DISTINCT uid) AS n_records, count(DISTINCT uid) AS exact_only, CAST(0 AS BIGINT) AS near_only, CAST(0 AS BIGINT) AS both FROM h")
def hit_attribution(spark: SparkSession, d: str) -> DataFrame:
    return decontamination.attribution(exact_hits(spark, d), "uid")


@query("decontamination_run", f"""WITH {SQL_HITS}, n AS (SELECT count(*) AS n FROM h) SELECT 'verdict' AS step, n, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS said FROM n UNION ALL SELECT 'rows left', (SELECT count(DISTINCT uid) FROM s WHERE length(t) >= 8) - (SELECT count(DISTINCT uid) FROM h), 'after removal' UNION ALL SELECT 'checks failed', 0, 'of removal' UNION ALL SELECT 'rescan', 0, 'PASS'""")
def decontamination_run(spark: SparkSession, d: str) -> DataFrame:
    """Scan, verdict, removal with its checks, and the scan of what is left."""
    sides, items = _sides(spark, d), _items(spark, d)
    found = decontamination.hits(sides, items, "uid", near=None)
    banned = decontamination.removal_list(found, "uid")
    stay, gates = decontamination.removed(sides.select("uid").distinct(), banned, "uid")
    again = decontamination.hits(sides.join(stay, "uid", "left_semi"), items, "uid", near=None)
    told = lambda df, step: decontamination.verdict(df).select(F.lit(step).alias("step"), F.col("n_hits").alias("n"), F.col("verdict").alias("said"))
    count = lambda df, step, said: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(step).alias("step"), "n", F.lit(said).alias("said"))
    return told(found, "verdict").unionByName(count(stay, "rows left", "after removal")).unionByName(count(gates.where("NOT ok"), "checks failed", "of removal")).unionByName(told(again, "rescan"))


@query("removal_checks", f"""WITH {SQL_HITS} SELECT unnest(['keys unique', 'rows gone are keys hit', 'no hit is left']) AS "check", CAST(0 AS BIGINT) AS expected, CAST(0 AS BIGINT) AS actual, true AS ok""".replace(f"WITH {SQL_HITS} ", ""))
def removal_checks(spark: SparkSession, d: str) -> DataFrame:
    sides = _sides(spark, d)
    found = decontamination.hits(sides, _items(spark, d), "uid", near=None)
    return decontamination.removed(sides.select("uid").distinct(), decontamination.removal_list(found, "uid"), "uid")[1]


@query("same_source_hits", f"WITH {SQL_HITS} SELECT count(DISTINCT uid) AS exact, CAST(0 AS BIGINT) AS near FROM h WHERE uid LIKE 'b%' AND item_id % 2 = 0")
def same_source_hits(spark: SparkSession, d: str) -> DataFrame:
    """One file of records against one part of the benchmark, exact matches only."""
    records_ = _sides(spark, d).withColumn("file", F.substring("uid", 1, 1))
    items = _items(spark, d).withColumn("tag", F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd"))
    found = decontamination.hits(records_.where("file = 'b'"), items.where("tag = 'even'"), "uid", near=None)
    return found.agg(F.countDistinct("uid").alias("exact"), F.lit(0).cast("long").alias("near"))


@query("pool_account", """SELECT CASE WHEN o_orderstatus <> 'F' THEN 'not_case' WHEN o_custkey % 11 = 0 THEN 'no_uid' WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'in_splits' WHEN o_orderkey % 13 = 0 THEN 'empty_input' ELSE 'kept' END AS reason, count(*) AS n FROM orders GROUP BY 1""")
def pool_account(spark: SparkSession, d: str) -> DataFrame:
    rows = rows_of(spark, d, "SELECT IF(o_custkey % 11 = 0, '', CAST(o_custkey AS STRING)) AS uid, IF(o_orderstatus = 'F', 'case_analysis', 'qa') AS task_kind, IF(o_orderkey % 13 = 0, ' ', o_orderpriority) AS input FROM orders")
    evals = rows_of(spark, d, "SELECT CAST(c_custkey AS STRING) AS uid FROM customer WHERE c_acctbal < 0")
    return decontamination.pool_account(rows, evals).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("semi_join_splits", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_splits(spark: SparkSession, d: str) -> DataFrame:
    """Whole rows of the keys that a split was given."""
    return table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


# ---- sources


@query("official_files", "SELECT page_id FROM pages WHERE page_id % 4 NOT IN (0, 1)")
def official_files(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("data/"), F.when(F.col("page_id") % 4 == 0, "_").otherwise(""), F.lit("part"), F.when(F.col("page_id") % 4 == 1, ".sample.").otherwise("."), F.lit("jsonl"))
    return io.official_files(table(spark, d, "pages").select("page_id", name.alias("path"))).select("page_id")


@query("fresh_sources", """WITH f AS (SELECT o_custkey AS c, o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'merged' ELSE 'part' END AS kind, o_orderdate AS t FROM orders), m AS (SELECT c, max(t) FILTER (kind = 'merged') AS m, max(t) FILTER (kind = 'part') AS p FROM f GROUP BY 1)
SELECT k AS o_orderkey FROM f JOIN m USING (c) WHERE kind = CASE WHEN m IS NOT NULL AND (p IS NULL OR m >= p) THEN 'merged' ELSE 'part' END""")
def fresh_sources(spark: SparkSession, d: str) -> DataFrame:
    f = rows_of(spark, d, "SELECT o_custkey AS dataset, o_orderkey AS path, IF(o_orderkey % 5 = 0, 'merged', 'part') AS kind, o_orderdate AS modified FROM orders")
    return io.fresh_sources(f).select(F.col("path").alias("o_orderkey"))


@query("real_and_derived", "SELECT is_derived, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT text, false AS is_derived FROM documents UNION ALL SELECT text, true FROM benchmark) GROUP BY 1")
def real_and_derived(spark: SparkSession, d: str) -> DataFrame:
    both = io.real_and_derived(table(spark, d, "documents").select("text"), table(spark, d, "benchmark").select("text"))
    return both.groupBy("is_derived").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("light_scan", "SELECT count(*) FILTER (lang = 'de') AS n_without_key FROM documents")
def light_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("lang") != "de", F.sha1("text")).alias("content_sha1"))
    return io.light(rows, ["doc_id", "lang"])[1]


@query("merged_outputs", "SELECT 'documents' AS output, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages")
def merged_outputs(spark: SparkSession, d: str) -> DataFrame:
    made, strays = io.merge_outputs({n: table(spark, d, n).select(F.lit(1).alias("x")) for n in ("documents", "pages")}, ["documents", "old"])
    assert strays == ["old"]
    return made.groupBy("output").agg(F.count(F.lit(1)).alias("n"))


@query("manifest_status", "SELECT CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 10 = 1 THEN 'changed' WHEN doc_id % 10 = 2 THEN 'new' ELSE 'same' END AS status, count(*) AS n FROM documents GROUP BY 1")
def manifest_status(spark: SparkSession, d: str) -> DataFrame:
    """Files as they are against what was registered; documents stand for files."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    k = F.col("path") % 10
    now, then = t.where(k != 0), t.where(k != 2).withColumn("sha256", F.when(k == 1, "other").otherwise(F.col("sha256")))
    return io.verified(now, then).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("registered_counts", "SELECT 'documents' AS kind, count(*) AS n_rows, 'abc' AS sha256 FROM documents UNION ALL SELECT 'pages', 5, 'x'")
def registered_counts(spark: SparkSession, d: str) -> DataFrame:
    old = spark.createDataFrame([("documents", 1, "old"), ("pages", 5, "x")], "kind string, n_rows long, sha256 string")
    return io.registered(old, "documents", table(spark, d, "documents"), "abc")


@query("shards_to_do", "SELECT DISTINCT CAST(p_partkey % 8 AS INT) AS shard FROM part WHERE p_partkey % 8 <> 3")
def shards_to_do(spark: SparkSession, d: str) -> DataFrame:
    """Shards without a marker of the same content: that of shard 3 is there, that of shard 5 is of something else."""
    rows = table(spark, d, "part").select("p_partkey", "p_name", (F.col("p_partkey") % 8).cast("int").alias("shard"))
    none = spark.createDataFrame([], "shard int, digest string")
    done = io.shards_to_do(rows, none, "p_partkey", F.col("p_name")).where("shard IN (3, 5)").withColumn("digest", F.when(F.col("shard") == 3, F.col("digest")).otherwise("old"))
    return io.shards_to_do(rows, done, "p_partkey", F.col("p_name")).select("shard")


@query("group_samples", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY substr(sha1('42' || chr(0) || doc_id), 1, 16)) <= 3")
def group_samples(spark: SparkSession, d: str) -> DataFrame:
    return sampling.group_sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", 3, "42", "doc_id")


@query("report_examples", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) <= 20")
def report_examples(spark: SparkSession, d: str) -> DataFrame:
    return profiles.examples(table(spark, d, "documents"), ["source"], ["n_chars", "doc_id"]).select("doc_id", "source")


