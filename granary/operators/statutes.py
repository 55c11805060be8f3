"""Legal texts: article splitting, derived tasks, citation edges."""

from __future__ import annotations

from collections.abc import Iterator

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.lexicon import LAW_TYPES, NUMERALS, SELF_NOUNS, STANDING, UNKNOWN
from granary.functions.text import chinese_number, joined_sha1, no_item_reason, strip_version, strip_wrappers, without_header
from granary.operators.ranks import spread_join

#: The least characters of an article's text, and of a document that stands as a whole.
LEAST, LEAST_WHOLE = 4, 60
ITEM = "doc_id string, seq int, part string, chapter string, section string, label string, text string"
_N = f"第[{NUMERALS}]+"
_CONTENTS = re.compile(r"[ \t\u3000]*目[ \t\u3000]*录[ \t\u3000]*$")
_HEADING = re.compile(rf"[ \t\u3000]*(?:{_N}([编章节])|序[ \t\u3000]*言|附[ \t\u3000]*则|目[ \t\u3000]*录)")
_ARTICLE = re.compile(rf"[ \t\u3000]*({_N}条(?:之[〇零一二三四五六七八九十]+)?)[ \t\u3000]*(.*)$")


def _cleaned(text: str) -> str:
    text = re.sub(r"[ \t\u3000]+\n", "\n", re.sub(r"\\\s*\n", "", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _without_contents(lines: list[str]) -> Iterator[str]:
    """The lines without tables of contents: such a one ends at a heading that it has had before, once it has had two, or at a line
    that is no heading."""
    listed: set[str] | None = None
    for line in lines:
        if _CONTENTS.match(line):
            listed = set()
            continue
        if listed is not None:
            bare = re.sub(r"\s+", "", line)
            if not bare:
                continue
            if _HEADING.match(line) and not (len(listed) >= 2 and bare in listed):
                listed.add(bare)
                continue
            listed = None
        yield line


def split_text(text: str) -> list[tuple[int, str | None, str | None, str | None, str, str]]:
    """(seq, part, chapter, section, label, text) of the articles of one document. An article is open from its line to the next article
    or heading; a heading of a part, chapter or section holds until the next one of its level or above."""
    above: list[str | None] = [None, None, None]
    found: list[tuple[list[str | None], str, list[str]]] = []
    body: list[str] | None = None
    for line in _without_contents([x.rstrip() for x in text.split("\n")]):
        if article := _ARTICLE.match(line):
            body = [article[2]]
            found.append((list(above), article[1], body))
        elif heading := _HEADING.match(line):
            body = None
            if heading[1]:
                level = "编章节".index(heading[1])
                above[level:] = [re.sub(r"[ \t\u3000]+", " ", line).strip(), *[None] * (2 - level)]
        elif body is not None and line.strip():
            body.append(line)
    whole = [(path, label, _cleaned("\n".join(lines))) for path, label, lines in found]
    return [(i, *path, label, body) for i, (path, label, body) in enumerate(((p, x, t) for p, x, t in whole if len(t) >= LEAST), 1)]


def split_articles(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per article; a document's lines stay in one row of the input, so that no shuffle is needed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *item) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for item in split_text(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "part", "chapter", "section", "label", "text"])

    return docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, ITEM)


def next_edges(items: DataFrame, doc: str, node: str, *order: str) -> DataFrame:
    """(start, end, doc) between neighbours of a document in order."""
    w = Window.partitionBy(doc).orderBy(*order)
    return items.select(F.col(node).alias("start"), F.lead(node).over(w).alias("end"), F.col(doc).alias("doc")).where("end IS NOT NULL")


def versioned_ids(items: DataFrame, law: str, article: str, uid: str) -> DataFrame:
    """items with provision_id law-aN, further ones of the same number as -v2, -v3 in order of uid."""
    k = F.row_number().over(Window.partitionBy(law, article).orderBy(uid))
    base = F.concat(F.col(law), F.lit("-a"), F.col(article).cast("string"))
    return items.withColumn("_k", k).withColumn("provision_id", F.when(F.col("_k") > 1, F.concat(base, F.lit("-v"), F.col("_k"))).otherwise(base)).drop("_k")


def self_pattern() -> str:
    return rf"(?U)本\s*(?:{SELF_NOUNS})\s*第\s*([{NUMERALS}]+)\s*条"


def named_pattern() -> str:
    return rf"(?U)[《〈]\s*([^《》〈〉]{{2,80}}?)\s*[》〉]\s*第\s*([{NUMERALS}]+)\s*条"


def citations(items: DataFrame, node: str, law: str, text: str) -> DataFrame:
    """(start, law, no, evidence, kind): named citations of other laws, and of the same law's articles."""
    of = lambda pattern: F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0)))).alias("evidence")
    named, own = named_pattern(), self_pattern()
    a = items.select(F.col(node).alias("start"), of(named)).select(
        "start", F.regexp_extract("evidence", named, 1).alias("law"), chinese_number(F.regexp_extract("evidence", named, 2)).alias("no"), "evidence", F.lit("named").alias("kind")
    )
    b = items.select(F.col(node).alias("start"), F.col(law).alias("law"), of(own)).select(
        "start", "law", chinese_number(F.regexp_extract("evidence", own, 1)).alias("no"), "evidence", F.lit("self").alias("kind")
    )
    return a.unionByName(b)


def cited(cites: DataFrame, laws: DataFrame) -> DataFrame:
    """(start, law_id, no, evidence, kind), each once: what citations point at, their names resolved to laws (law_id, law_name)."""
    named = cites.where("kind = 'named' AND no IS NOT NULL").withColumn("name", strip_version(strip_wrappers(F.col("law"))))
    known = resolve_names(named.select("name").distinct(), laws)
    of_named = named.join(known, "name").where("law_id IS NOT NULL").select("start", "law_id", "no", "evidence", "kind")
    own = cites.where("kind = 'self' AND no IS NOT NULL").select("start", F.col("law").alias("law_id"), "no", "evidence", "kind")
    return of_named.unionByName(own).where("start IS NOT NULL AND law_id IS NOT NULL").distinct()


def cites_ends(provisions: DataFrame) -> DataFrame:
    """(law_id, no, end), each once: where citations of a law's number end."""
    return provisions.select("law_id", F.col("article_no").alias("no"), F.col("provision_id").alias("end")).dropna().distinct()


def cites_edges(cites: DataFrame, provisions: DataFrame, laws: DataFrame) -> DataFrame:
    """(start, end, kind, evidence) from citations: law and number looked up among the provisions (provision_id, law_id, article_no), of
    which there may be several. No edge to itself, none twice. Where many cite a number that many have, edges are their product: what only
    counts edges takes `edge_counts` or `edge_summary`."""
    met = cited(cites, laws).join(cites_ends(provisions), ["law_id", "no"])
    return met.where("start <> end").select("start", "end", "kind", "evidence").distinct()


def edge_counts(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """(kind, n): how many edges `cites_edges` makes of starts (`cited`) and ends (`cites_ends`), without making them: the products for each
    law and number, less edges to themselves, less those that several numbers of one citation give again. Only these last are made."""
    key = ["law_id", "no"]
    by = starts.groupBy("kind", *key).agg(F.count(F.lit(1)).alias("n")).join(ends.groupBy(*key).agg(F.count(F.lit(1)).alias("c")), key)
    loops = starts.join(ends.withColumnRenamed("end", "start"), [*key, "start"])
    several = lambda df, *cols: df.groupBy(*cols).agg(F.collect_list(F.struct(*key)).alias("k")).where(F.size("k") > 1).select(*cols, F.inline("k"))
    again = several(starts, "start", "kind", "evidence").join(several(ends, "end"), key).where("start <> end").groupBy("start", "kind", "evidence", "end").agg(F.count(F.lit(1)).alias("n"))
    parts = by.select("kind", (F.col("n") * F.col("c")).alias("n")).unionAll(loops.select("kind", F.lit(-1).cast("long"))).unionAll(again.select("kind", 1 - F.col("n")))
    return parts.groupBy("kind").agg(F.sum("n").alias("n"))


def unknown_ends(starts: DataFrame, ends: DataFrame, ids: DataFrame) -> DataFrame:
    """(n), some rows: their sum is how often a start or an end of the edges that `cites_edges` would make is none of ids (id)."""
    a = edge_counts(starts.join(ids.withColumnRenamed("id", "start"), "start", "left_anti"), ends)
    b = edge_counts(starts, ends.join(ids.withColumnRenamed("id", "end"), "end", "left_anti"))
    return a.select("n").unionAll(b.select("n"))


def edge_summary(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """(kind, n, n_start, n_end, n_evidence): edges, and the different values of each column, as `cites_edges` would have them."""
    key = ["law_id", "no"]
    least = lambda c: (F.min(c).alias("lo"), F.max(c).alias("hi"))
    # A start has an edge unless it is its number's only end; an end has one unless it is its number's only start.
    left = spread_join(starts, ends.groupBy(*key).agg(*least("end")), key, ["start"]).where("lo <> start OR hi <> start")
    right = spread_join(ends, starts.groupBy(*key, "kind").agg(*least("start")), key, ["end"]).where("lo <> end OR hi <> end")
    zero = F.lit(0).cast("long")
    n = edge_counts(starts, ends).select("kind", "n", zero.alias("n_start"), zero.alias("n_end"), zero.alias("n_evidence"))
    a = left.groupBy("kind").agg(F.countDistinct("start").alias("n_start"), F.countDistinct("evidence").alias("n_evidence")).select("kind", zero.alias("n"), "n_start", zero.alias("n_end"), "n_evidence")
    b = right.groupBy("kind").agg(F.countDistinct("end").alias("n_end")).select("kind", zero.alias("n"), zero.alias("n_start"), "n_end", zero.alias("n_evidence"))
    return n.unionByName(a).unionByName(b).groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("n", "n_start", "n_end", "n_evidence"))).where("n > 0")


def looked_up(cites: DataFrame, provisions: DataFrame, laws: DataFrame) -> DataFrame:
    """cites (law, no) with status and provision_id: found (the least of several), not_in_library, or law_unresolved, which is no proof
    that a citation was made up."""
    known = resolve_names(cites.select(strip_version(strip_wrappers(F.col("law"))).alias("name")).distinct(), laws).select("name", "law_id")
    least = provisions.groupBy("law_id", F.col("article_no").alias("no")).agg(F.min("provision_id").alias("provision_id"))
    met = cites.withColumn("name", strip_version(strip_wrappers(F.col("law")))).join(known, "name", "left").join(least, ["law_id", "no"], "left")
    status = F.when(F.col("law_id").isNull(), "law_unresolved").when(F.col("provision_id").isNull(), "not_in_library").otherwise("found")
    return met.select(*cites.columns, status.alias("status"), "provision_id")


def verified(cites: DataFrame, provisions: DataFrame, laws: DataFrame, context: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """cites (query_id, law, no) with what the answer's context (query_id, provision_id) says: found, out_of_ctx, missing or law_unresolved.
    With members, a context is given by groups (query_id, and what names a group) and members has their provisions (the same, and
    provision_id): only provisions that a citation means are looked for, so that no context is written out."""
    x = looked_up(cites, provisions, laws)
    if members is None:
        seen = context.select("query_id", "provision_id").distinct()
    else:
        by = [c for c in members.columns if c != "provision_id"]
        meant = x.where("provision_id IS NOT NULL").select("query_id", "provision_id").distinct()
        seen = meant.join(members, "provision_id").join(context.select("query_id", *by), ["query_id", *by], "left_semi").select("query_id", "provision_id").distinct()
    x = x.join(seen.withColumn("_in", F.lit(True)), ["query_id", "provision_id"], "left")
    verdict = F.when(F.col("status") == "law_unresolved", "law_unresolved").when(F.col("status") == "not_in_library", "missing").when(F.col("_in"), "found").otherwise("out_of_ctx")
    return x.select(*cites.columns, verdict.alias("verdict"), "provision_id")


def refined_queries(queries: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(query_id, query, again): a question with the citations that were not found in its context behind it; again: whether to search once more."""
    open_ = verdicts.where("verdict <> 'found'").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("《"), "law", F.lit("》第"), F.col("no").cast("string"), F.lit("条")))), " ").alias("more"))
    met = queries.join(open_, "query_id", "left")
    return met.select("query_id", F.concat_ws(" ", "query", "more").alias("query"), F.col("more").isNotNull().alias("again"))


#: Which of a row's two texts cite a number, as bits.
IN_SYSTEM, IN_OUTPUT = 1, 2


def gold_keys(rows: DataFrame, provisions: DataFrame, laws: DataFrame) -> DataFrame:
    """From (uid, system, output, input): (uid, input, keys, gold_sys_missing, gold_out_missing, reason). keys: (law_id, no, texts) that the two
    texts cite and the library has, texts as bits; references that it lacks are counted; reason: why a row is no query (no_gold,
    empty_query), else null. A number may have very many provisions, which are not looked at here."""
    key = ["law_id", "no"]
    some = provisions.where("provision_id IS NOT NULL").select("law_id", F.col("article_no").alias("no")).distinct().withColumn("_has", F.lit(True))

    def of(text: str, bit: int) -> DataFrame:
        c = citations(rows.withColumn("_law", F.lit(None).cast("string")), "uid", "_law", text).where("kind = 'named' AND no IS NOT NULL")
        return c.select("start", strip_version(strip_wrappers(F.col("law"))).alias("name"), "no", F.lit(bit).alias("bit"))

    c = of("system", IN_SYSTEM).unionAll(of("output", IN_OUTPUT))
    known = resolve_names(c.select("name").distinct(), laws).select("name", "law_id").where("law_id IS NOT NULL")
    cited_ = c.join(known, "name").groupBy(F.col("start").alias("uid"), *key).agg(F.bit_or("bit").alias("texts"))
    has = F.col("_has").isNotNull()
    lacks = lambda bit: F.count_if(~has & (F.col("texts").bitwiseAND(bit) > 0))
    met = spread_join(cited_, some, key, ["uid"], "left").groupBy("uid").agg(
        F.collect_list(F.when(has, F.struct(*key, "texts"))).alias("keys"), lacks(IN_SYSTEM).alias("gold_sys_missing"), lacks(IN_OUTPUT).alias("gold_out_missing")
    )
    x = rows.select("uid", "input").join(met, "uid", "left").withColumn("_n", F.coalesce(F.size("keys"), F.lit(0)))
    reason = F.when(F.col("_n") <= 0, "no_gold").when(F.trim(F.coalesce("input", F.lit(""))) == "", "empty_query")
    return x.select("uid", "input", "keys", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("gold_sys_missing", "gold_out_missing")), reason.alias("reason"))


def gold_sets(rows: DataFrame, provisions: DataFrame, laws: DataFrame) -> DataFrame:
    """What `gold_keys` gives with gold_sys, gold_out and gold_union, sorted provisions that the two texts cite. Each number's provisions are
    sorted once and come to a row in the last join, after which nothing is shuffled; only a row of several numbers has them put together."""
    key, each = ["law_id", "no"], ("gold_sys", "gold_out", "gold_union")
    x = gold_keys(rows, provisions, laws)
    listed = provisions.groupBy("law_id", F.col("article_no").alias("no")).agg(F.array_sort(F.collect_set("provision_id")).alias("p")).hint("merge")
    none, n = F.array().cast("array<string>"), F.coalesce(F.size("keys"), F.lit(0))
    bits = dict(zip(each, (IN_SYSTEM, IN_OUTPUT, IN_SYSTEM | IN_OUTPUT), strict=True))
    part = lambda bit: F.when(F.col("texts").bitwiseAND(bit) > 0, F.col("p")).otherwise(none)
    cols = ["uid", "input", "gold_sys_missing", "gold_out_missing", "reason"]
    no = x.where(n <= 0).select(*cols, *(none.alias(c) for c in each))
    one = spread_join(x.where(n == 1).select(*cols, F.inline("keys")), listed, key, ["uid"], ways=4).select(*cols, *(part(b).alias(c) for c, b in bits.items()))
    more = x.where(n > 1).dropDuplicates(["uid"]).select("uid", F.inline("keys"))
    union = lambda b: F.array_sort(F.array_distinct(F.flatten(F.collect_list(part(b)))))
    put = spread_join(more, listed, key, ["uid"], ways=4).groupBy("uid").agg(*(union(b).alias(c) for c, b in bits.items()))
    several = x.where(n > 1).select(*cols).join(put, "uid").select(*cols, *each)
    return no.unionAll(one).unionAll(several).select("uid", "input", *each, "gold_sys_missing", "gold_out_missing", "reason")


def gold_account(gold: DataFrame) -> DataFrame:
    """One row of counts over what `gold_keys` gives."""
    kept = F.col("reason").isNull()
    cites = lambda bit: F.exists("keys", lambda k: k["texts"].bitwiseAND(bit) > 0)
    return gold.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(kept).alias("with_gold"), F.count_if(F.col("reason") == "no_gold").alias("no_gold"), F.count_if(F.col("reason") == "empty_query").alias("empty_query"),
        F.count_if(kept & cites(IN_SYSTEM)).alias("tier_a"), F.count_if(kept & cites(IN_OUTPUT)).alias("tier_b"),
        F.sum("gold_sys_missing").cast("long").alias("sys_missing"), F.sum("gold_out_missing").cast("long").alias("out_missing"),
    )


def document_ids(docs: DataFrame, law: str, uid: str, taken: DataFrame) -> DataFrame:
    """docs with provision_id law-doc, further ones as -v2, -v3 in order of uid; numbers that an id of `taken` (provision_id) has already
    are passed over."""
    base = F.concat(F.col(law), F.lit("-doc"))
    used = taken.select(F.regexp_extract("provision_id", "^(.*-doc)(?:-v([0-9]+))?$", 1).alias("_base"), F.coalesce(F.nullif(F.regexp_extract("provision_id", "^(.*-doc)(?:-v([0-9]+))?$", 2), F.lit("")), F.lit("1")).cast("int").alias("k"))
    used = used.where("_base <> ''").groupBy("_base").agg(F.array_sort(F.collect_set("k")).alias("_used"))
    k = F.row_number().over(Window.partitionBy(law).orderBy(uid))
    x = docs.withColumn("_base", base).withColumn("_k", k).join(used, "_base", "left")
    # The k-th free number: each taken one at or below it moves it up by one.
    free = F.aggregate(F.coalesce("_used", F.array().cast("array<int>")), F.col("_k"), lambda at, u: F.when(u <= at, at + 1).otherwise(at))
    y = x.withColumn("_free", free)
    return y.withColumn("provision_id", F.when(F.col("_free") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-v"), F.col("_free")))).drop("_base", "_k", "_used", "_free")


def law_nodes(items: DataFrame) -> DataFrame:
    """From (law_id, law_type, domain, source_dataset, doc_key, raw_title) a row for each law: its type if one standard type is known,
    its sets in order, and how many documents and provisions it has."""
    sets = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    x = items.groupBy("law_id").agg(
        sets("law_type").alias("law_type_raw"), sets("domain").alias("domains"), sets("source_dataset").alias("source_datasets"), F.countDistinct("doc_key").alias("n_docs"),
        F.count(F.lit(1)).alias("n_provisions"), sets("raw_title").alias("raw_name_variants"),
    )
    std = F.filter("law_type_raw", lambda t: t.isin(*LAW_TYPES))
    return x.withColumn("law_type_std", F.when(F.size(std) == 1, std[0]).when(F.size(std) > 1, "多类型").otherwise("未标注"))


def law_articles(items: DataFrame, law: str, number: str) -> DataFrame:
    """For each law its least and largest article, and the numbers in order."""
    return items.where(F.col(number).isNotNull()).groupBy(law).agg(F.min(number).alias("least"), F.max(number).alias("largest"), F.array_sort(F.collect_set(number)).alias("numbers"))


def standing(status: Column) -> Column:
    return F.when(F.trim(status).isin(*STANDING), F.trim(status)).otherwise(UNKNOWN)


def kept_types(docs: DataFrame, kind: str = "type") -> DataFrame:
    """Documents of the types that are split into articles."""
    return docs.where(F.trim(kind).isin(*LAW_TYPES))


def dirty_standing(docs: DataFrame, status: str = "status") -> DataFrame:
    """How often each standing that is not known occurs, before any document is left out."""
    raw = F.trim(F.coalesce(status, F.lit("")))
    return docs.where(~raw.isin(*STANDING)).groupBy(raw.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def whole_documents(docs: DataFrame, with_items: DataFrame, least: int = LEAST_WHOLE) -> DataFrame:
    """From (doc_id, title, text) those without articles (doc_id), with the reason; those that stand as a whole (no amendments, long
    enough without their header) with that text, else null."""
    bare = docs.join(with_items.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("reason", no_item_reason(F.col("title"), F.col("text")))
    body = without_header(F.col("title"), F.col("text"))
    return bare.withColumn("_body", body).select("doc_id", "title", "reason", F.when((F.col("reason") != "AMENDMENT_INSTRUCTION") & (F.length("_body") >= least), F.col("_body")).alias("text"))


def title_statistics(titles: DataFrame, file: str, title: str) -> DataFrame:
    """For each file: different titles as they stand, without wrappers, and without version notes; how many are made one by either step;
    groups of several titles that become one."""
    x = titles.where(F.trim(F.coalesce(title, F.lit(""))) != "").select(F.col(file).alias("file"), F.trim(title).alias("raw")).withColumn("l1", strip_wrappers(F.col("raw")))
    x = x.withColumn("l2", strip_version(F.col("l1")))
    groups = x.groupBy("file", "l2").agg(F.countDistinct("raw").alias("n")).groupBy("file").agg(F.count_if(F.col("n") > 1).alias("merged_groups"))
    split = x.groupBy("file", "raw").agg(F.countDistinct("l2").alias("n")).groupBy("file").agg(F.count_if(F.col("n") > 1).alias("over_split"))
    u = x.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), *(F.countDistinct(c).alias(f"{c}_unique") for c in ("raw", "l1", "l2")))
    made = u.select("*", (F.col("raw_unique") - F.col("l1_unique")).alias("merged_l1"), (F.col("l1_unique") - F.col("l2_unique")).alias("merged_l2"))
    return made.join(groups, "file").join(split, "file")


def title_overlap(titles: DataFrame, file: str, title: str) -> DataFrame:
    """(a, b, level, shared): how many titles two files share, as they stand (raw), without wrappers (l1) and without versions (l2). A
    title gives a row for each pair of files that have it, and files are few."""
    raw = F.trim(F.col(title))
    l1 = strip_wrappers(raw)
    each = titles.select(F.col(file).alias("file"), F.explode(F.create_map(F.lit("raw"), raw, F.lit("l1"), l1, F.lit("l2"), strip_version(l1))).alias("level", "title"))
    by = each.groupBy("level", "title").agg(F.array_sort(F.collect_set("file")).alias("f")).where(F.size("f") > 1)
    pairs = F.flatten(F.transform("f", lambda a: F.transform(F.filter("f", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return by.select("level", F.explode(pairs).alias("p")).groupBy("p.a", "p.b", "level").agg(F.count(F.lit(1)).alias("shared"))


def several_versions(titles: DataFrame, title: str) -> DataFrame:
    """Titles without version notes that stand for more than one title, and for how many."""
    x = titles.select(F.trim(title).alias("raw")).distinct().select("raw", strip_version(strip_wrappers(F.col("raw"))).alias("canonical"))
    return x.groupBy("canonical").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def citation_profile(items: DataFrame, text: str, laws: DataFrame) -> DataFrame:
    """One row: texts with any, named and self citations; citations of either kind; the shares of names that a law has, and of numbers that
    cannot be read."""
    x = items.select(F.monotonically_increasing_id().cast("string").alias("id"), F.lit(None).cast("string").alias("law"), F.col(text).alias("text"))
    n = lambda p: F.regexp_count(F.coalesce("text", F.lit("")), F.lit(p))
    counted = x.select(n(named_pattern()).alias("named"), n(self_pattern()).alias("self"))
    sums = counted.agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("named") + F.col("self") > 0).alias("with_any"), F.count_if(F.col("named") > 0).alias("with_named"), F.count_if(F.col("self") > 0).alias("with_self"),
        F.sum("named").cast("long").alias("n_named"), F.sum("self").cast("long").alias("n_self"),
    )
    c = citations(x, "id", "law", "text").where("kind = 'named'").withColumn("name", strip_version(strip_wrappers(F.col("law"))))
    known = resolve_names(c.select("name").distinct(), laws).select("name", "law_id")
    share = c.join(known, "name", "left").agg(F.avg(F.col("law_id").isNotNull().cast("double")).alias("resolved_share"), F.avg(F.col("no").isNull().cast("double")).alias("unread_share"))
    return sums.crossJoin(F.broadcast(share))  # one row each


def resolve_names(names: DataFrame, laws: DataFrame, shortest: int = 3) -> DataFrame:
    """(name, law_id, status): an exact name wins; else the only law whose name ends with it; else ambiguous or missing. Suffixes
    are joined by equality: each law gives its suffixes, as many as its name is long, so that no theta join is needed."""
    exact = names.join(laws.select(F.col("law_id").alias("e"), F.col("law_name").alias("name")), "name", "left")
    suffix = F.transform(F.sequence(F.lit(2), F.greatest(F.length("law_name") - (shortest - 1), F.lit(2))), lambda i: F.substring("law_name", i, F.length("law_name")))
    ends = laws.select("law_id", F.explode(F.array_distinct(F.filter(suffix, lambda s: F.length(s) >= shortest))).alias("name"))
    one = ends.groupBy("name").agg(F.countDistinct("law_id").alias("n"), F.min("law_id").alias("s"))
    found = exact.join(one, "name", "left")
    return found.select(
        "name",
        F.coalesce("e", F.when(F.col("n") == 1, F.col("s"))).alias("law_id"),
        F.when(F.col("e").isNotNull(), "exact").when(F.col("n") == 1, "suffix").when(F.col("n") > 1, "ambiguous").otherwise("missing").alias("status"),
    )


def derive_tasks(items: DataFrame, shortest_law: int = 4, shortest_text: int = 20) -> DataFrame:
    """From (law, label, chapter, text): recall, locate and structure tasks as (kind, ask, answer), one for each content."""
    long_law, long_text = F.length("title") >= shortest_law, F.length("text") >= shortest_text
    kinds = F.array(
        F.when(long_law & long_text, F.struct(F.lit("recall").alias("kind"), F.concat(F.lit("《"), "title", F.lit("》"), "label").alias("ask"), F.col("text").alias("answer"))),
        F.when(long_law & long_text, F.struct(F.lit("locate").alias("kind"), F.col("text").alias("ask"), F.concat(F.lit("《"), "title", F.lit("》"), "label").alias("answer"))),
        F.when(long_law & F.col("chapter").isNotNull(), F.struct(F.lit("structure").alias("kind"), F.concat(F.lit("《"), "title", F.lit("》"), "label").alias("ask"), F.col("chapter").alias("answer"))),
    )
    named = items.withColumn("title", strip_wrappers(F.col("law"), None))
    rows = named.select("law", "label", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("t")).select("law", "label", "t.*")
    key = joined_sha1(F.col("ask"), F.lit(""), F.col("answer"))
    return rows.withColumn("content_sha1", key).groupBy("content_sha1").agg(F.min(F.struct("law", "label", "kind", "ask", "answer")).alias("x")).select("x.*", "content_sha1")
