"""Records of question and answer: adapters of sources, the common record, labels, and what is read from a record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import lexicon
from granary.functions.columns import let
from granary.functions.text import document_type, extract_titles, hits, joined_sha1, law_domain, norm_ws, record_uid, task_kind

Adapter = Callable[[DataFrame], DataFrame]
#: Adapters by name: from a source's own columns to those of `BASE`.
ADAPTERS: dict[str, Adapter] = {}
BASE = ("source_dataset", "source_file", "source_index", "source_id", "task", "system", "instruction", "input", "output", "references")


def adapter(name: str) -> Callable[[Adapter], Adapter]:
    def add(fn: Adapter) -> Adapter:
        ADAPTERS[name] = fn
        return fn

    return add


def _text(rows: DataFrame, name: str) -> Column:
    return norm_ws(F.col(name).cast("string")) if name in rows.columns else F.lit("")


def _base(rows: DataFrame, source_id: Column, task: Column, **texts: Column) -> list[Column]:
    none = F.array().cast("array<string>")
    given = {"system": F.lit(""), "instruction": F.lit(""), "input": F.lit(""), "output": F.lit(""), "references": none} | texts
    return ["source_dataset", "source_file", "source_index", source_id.alias("source_id"), task.alias("task"), *(v.alias(k) for k, v in given.items())]


def _numbered(task: Column) -> Column:
    return F.concat_ws("-", task, F.col("source_index").cast("string"))


def _mapped(table: dict[str, str], value: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[value], F.lit("qa"))


@adapter("triplets")
def triplets(rows: DataFrame) -> DataFrame:
    """id, input, output and perhaps reference (a JSON list of texts): the task is the id up to its last dash."""
    sid = F.coalesce(F.col("id").cast("string"), F.lit(""))
    task = F.when(F.contains(sid, F.lit("-")), F.regexp_replace(sid, "-[^-]*$", "")).otherwise("legal_question_answering")
    extra = {}
    if "reference" in rows.columns:
        listed = F.from_json(F.trim("reference"), "array<string>") if dict(rows.dtypes)["reference"] == "string" else F.col("reference")
        extra["references"] = F.coalesce(F.transform(listed, norm_ws_plain), F.array().cast("array<string>"))
    return rows.select(_base(rows, sid, task, input=_text(rows, "input"), output=_text(rows, "output"), **extra))


def norm_ws_plain(text: Column) -> Column:
    """As `norm_ws` without NFKC, which is not to be had within a lambda."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("　"), F.lit(" ")), r"[ \t\r\f\x0B]+", " "), F.lit(" \t\n\r\u000b\f"))


@adapter("files_by_task")
def files_by_task(rows: DataFrame) -> DataFrame:
    """system, instruction, input, output: the file tells the task."""
    task = _mapped(lexicon.FILE_TASKS, F.element_at(F.split("source_file", "/"), -1))
    return rows.select(_base(rows, _numbered(task), task, **{c: _text(rows, c) for c in ("system", "instruction", "input", "output")}))


@adapter("sources_by_task")
def sources_by_task(rows: DataFrame) -> DataFrame:
    """prefix, instruction, input, output, source: the column `source` tells the task."""
    task = _mapped(lexicon.SOURCE_TASKS, _text(rows, "source"))
    return rows.select(_base(rows, _numbered(task), task, system=_text(rows, "prefix"), **{c: _text(rows, c) for c in ("instruction", "input", "output")}))


@adapter("statute_documents")
def statute_documents(rows: DataFrame) -> DataFrame:
    """title, content and facts of whole statutes, which go along as `statute`."""
    names = {"title": "title", "type": "type", "status": "status", "office": "office", "office_level": "office_level", "office_category": "office_category", "publish_date": "publish_date", "effective_from": "effective_date", "effective_period": "effective_period"}
    statute = F.struct(*(_text(rows, field).alias(name) for name, field in names.items()))
    kind = F.coalesce(F.col("type"), F.lit("law")) if "type" in rows.columns else F.lit("law")
    return rows.select(*_base(rows, _numbered(kind), F.lit("statute_doc"), instruction=_text(rows, "title"), output=_text(rows, "content")), statute.alias("statute"))


@adapter("statute_articles")
def statute_articles(rows: DataFrame) -> DataFrame:
    """title, classification, num, contents of single articles."""
    statute = F.struct(_text(rows, "title").alias("title"), _text(rows, "classification").alias("classification"), _text(rows, "num").alias("article_no"), F.lit("item").alias("level"))
    return rows.select(*_base(rows, _numbered(F.substring(_text(rows, "title"), 1, 20)), F.lit("statute_item"), output=_text(rows, "contents")), statute.alias("statute"))


def build(rows: DataFrame) -> DataFrame:
    """The common record from the columns of `BASE`: what is asked, titles cited, keys, lengths and messages."""
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("system", "instruction", "input", "output")]
    x = rows.select(*(c for c in rows.columns if c not in ("system", "instruction", "input", "output")), *texts)
    x = x.withColumn("ask", F.when(F.col("instruction") != "", F.col("instruction")).otherwise(F.substring("input", 1, 300)))
    asked = extract_titles(F.concat_ws("\n", "instruction", "ask"))
    told = extract_titles(F.concat_ws("\n", "system", "output", F.array_join("references", "\n")))
    user = F.when(F.col("instruction") != "", F.trim(F.concat_ws("\n", "instruction", "input"))).otherwise(F.col("input"))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    said = F.array(F.when(F.col("system") != "", message("system", F.col("system"))), message("user", user), message("assistant", F.col("output")))
    size = F.length("input")
    return x.withColumns({
        "task_kind": task_kind(F.col("task")),
        "refs_question": asked,
        "refs_answer": F.array_except(told, asked),
        "char_len": F.struct(*(F.length(c).alias(c) for c in ("instruction", "input", "output"))),
        "uid": record_uid(F.col("source_dataset"), F.col("source_file"), F.col("source_index")),
        "uid_legacy": F.concat(F.replace("source_dataset", F.lit("/"), F.lit("__")), F.lit(":"), "source_id"),
        "content_sha1": joined_sha1(F.col("instruction"), F.col("input"), F.col("output")),
        "case_sha1": F.when(size > 0, joined_sha1(F.substring(F.col("input"), F.greatest(size - 399, F.lit(1)), F.lit(400)))).otherwise(""),
        "messages": F.filter(said, lambda m: m.isNotNull()),
    })


def domain_signals(records: DataFrame) -> DataFrame:
    """(uid, domain, signal, signal_ord, amount) of built records: titles cited in question and answer, kind of document, task, topics asked
    for. Procedure counts less in tasks that analyse a case."""
    w = lexicon.WEIGHTS
    entry = lambda domain, signal, k, amount: F.struct(domain.alias("domain"), F.lit(signal).alias("signal"), F.lit(k).alias("signal_ord"), amount.cast("double").alias("amount"))
    refs = lambda c, signal, k: F.transform(c, lambda law: entry(law_domain(law), signal, k, F.lit(w[signal])))
    hint = F.create_map(*(F.lit(x) for pair in lexicon.TASK_HINTS.items() for x in pair))[F.col("task")]
    topics = [entry(F.lit(d), "topic_keyword", 5, F.least(F.lit(most), each * hits(F.col("ask"), words))) for d, each, most, words in lexicon.TOPICS]
    single = F.array(
        entry(document_type(F.col("input"))["domain"], "doc_type", 2, F.lit(w["doc_type"])), entry(hint, "task_hint", 3, F.lit(w["task_hint"])),
        entry(F.when(F.col("task") == "crime_concept", F.lit("criminal")), "crime_concept", 4, F.lit(w["crime_concept"])), *topics,
    )
    every = F.concat(refs("refs_question", "statute_ref_in_question", 0), refs("refs_answer", "statute_ref_in_answer", 1), single)
    x = records.select("uid", "task_kind", F.explode(F.filter(every, lambda s: s["domain"].isNotNull() & (s["amount"] > 0))).alias("s")).select("uid", "task_kind", "s.*")
    less = (F.col("task_kind") == "case_analysis") & (F.col("domain") == "procedural")
    return x.select("uid", "domain", "signal", "signal_ord", F.when(less, F.col("amount") * lexicon.CASE_DISCOUNT).otherwise(F.col("amount")).alias("amount"))


def labelled(records: DataFrame) -> DataFrame:
    """records with domain, domains, domain_source and scores; without a signal: general, by fallback."""
    from granary.operators.labels import vote

    voted = vote(domain_signals(records), list(lexicon.DOMAINS), lexicon.LABEL_SHARE)
    x = records.join(voted, "uid", "left")
    return x.withColumns({"domain": F.coalesce("domain", F.lit("general")), "domains": F.coalesce("domains", F.array(F.lit("general"))), "domain_source": F.coalesce("domain_source", F.lit("fallback"))})


def kept_files(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of files that are not on a list (source_dataset, source_file), a small table."""
    return rows.join(dropped.select("source_dataset", "source_file").distinct(), ["source_dataset", "source_file"], "left_anti")


def domain4(domain: Column, domains: Column) -> Column:
    """One of four domains: the record's, else the only one of its labels, else general."""
    four = lambda c: F.when(F.lower(F.trim(c)).isin(*lexicon.DOMAINS), F.lower(F.trim(c)))
    return F.coalesce(four(domain), F.when(F.size(domains) == 1, four(F.get(domains, F.lit(0)))), F.lit("general"))


def router_query(messages: Column, ask: Column, instruction: Column) -> Column:
    """The first thing a user says, else what is asked, else the instruction."""
    said = F.get(F.filter(messages, lambda m: (m["role"] == "user") & (F.trim(m["content"]) != "")), F.lit(0))["content"]
    return F.coalesce(said, *(F.when(F.trim(c) != "", c) for c in (ask, instruction)), F.lit(""))


def eval_text(instruction: Column, text: Column, ask: Column) -> Column:
    """Instruction and input if there are both, else the question, the instruction or the input."""
    a, b, c = (F.trim(F.coalesce(x, F.lit(""))) for x in (instruction, text, ask))
    return F.when((a != "") & (b != ""), F.concat(a, F.lit("\n"), b)).otherwise(F.trim(F.coalesce(F.nullif(c, F.lit("")), F.nullif(a, F.lit("")), b)))


def until_last_answer(messages: Column) -> Column:
    """The messages before the last one of the assistant; without one, all of them."""

    def of(m: Column) -> Column:
        at = F.array_max(F.transform(m, lambda x, i: F.when(x["role"] == "assistant", i)))
        return F.when(at.isNull(), m).otherwise(F.slice(m, F.lit(1), at))

    return let(messages, of)


def canonical_labels(labels: Column, names: dict[str, str]) -> Column:
    """Labels by their canonical names, each once and in order; unknown ones stay."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.array_distinct(F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.coalesce(table[x], x)))


def regrouped(rows: DataFrame, domains: DataFrame, case_id: str) -> DataFrame:
    """rows with the domain (uid, domain) of their case, whose prefix before :: does not count; unknown where there is none."""
    x = rows.withColumn("uid", F.regexp_replace(case_id, "^.*?::", ""))
    return x.join(domains, "uid", "left").withColumn("domain", F.coalesce("domain", F.lit("unknown")))


def table_lines_gone(text: Column, from_: int = 1000, most: int = 2000, least: int = 200) -> Column:
    """Texts over some characters without empty lines and those of tables, cut; null where too little is left. Others as they are."""
    lines = F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~F.contains(x, F.lit("|")))
    cut = let(F.substring(F.array_join(lines, "\n"), 1, most), lambda t: F.when(F.length(t) >= least, t))
    return F.when(F.length(text) > from_, cut).otherwise(text)


def has_cjk(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("[一-鿿]")


def last_of_each(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key: the last by order, as a table that is merged into has it."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
