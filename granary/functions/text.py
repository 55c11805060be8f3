"""Text normalisers, keys and extractors as column functions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import lexicon
from granary.functions.columns import let


#: Fixed value: texts that are Python's strings at once.
STRINGS = 256


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    parts = (texts.slice(i, STRINGS).to_pylist() for i in range(0, len(texts), STRINGS))
    return pa.concat_arrays([pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in part], pa.string()) for part in parts] or [pa.array([], pa.string())])


def nfkc(text: Column) -> Column:
    """A text in NFKC. Only those with other characters than ASCII go to Python, and of a batch a few at a time."""
    return F.coalesce(_nfkc(F.when(F.octet_length(text) != F.length(text), text)), text)


def norm_ws(text: Column) -> Column:
    """Null to empty, NFKC, runs of blanks (not of newlines) to one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), "　", " "), r"[ \t\r\f\x0B]+", " "), F.lit(" \t\n\r\u000b\f"))


def norm_text(text: Column) -> Column:
    """NFKC without any blanks and line ends: for comparing texts."""
    return F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), r"[ \t\r\n　]", "")


def normalize_text(text: Column) -> Column:
    """Full-width ASCII to half-width, punctuation and blanks dropped, lower case."""
    wide = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
    half = "".join(chr(c) for c in range(0x21, 0x7F))
    return F.lower(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), wide, half), r"[\s\p{Punct}\p{IsPunctuation}　]+", ""))


def loose_hash(text: Column) -> Column:
    """sha1 of the text without blanks and punctuation, case kept."""
    return F.sha1(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Punct}\p{IsPunctuation}]+", ""))


def joined_sha1(*parts: Column) -> Column:
    """sha1 over parts, each with a record separator behind it."""
    return F.sha1(F.concat(*(x for p in parts for x in (F.coalesce(p, F.lit("")), F.lit("\x1e")))))


def record_uid(dataset: Column, file: Column, index: Column) -> Column:
    """dataset__stem:index, so that equal indexes of different files stay apart."""
    stem = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[^.]*$", "")
    return F.concat(F.replace(dataset, F.lit("/"), F.lit("__")), F.lit("__"), stem, F.lit(":"), index.cast("string"))


def hash_order(salt: str, key: Column) -> Column:
    """The first 16 hex digits of sha1(salt NUL key); their order is that of the numbers."""
    return F.substring(F.sha1(F.concat(F.lit(salt), F.lit("\x00"), key)), 1, 16)


def extract_titles(text: Column, shortest: int = 2, longest: int = 40) -> Column:
    """Distinct titles in double angle quotes, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"《([^《》]{{{shortest},{longest}}})》"), F.lit(1)))


def strip(text: Column) -> Column:
    """Without blanks and line ends at both ends, whatever their script."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_wrappers(title: Column, layers: int | None = 5) -> Column:
    """Without outer title quotes (some layers, or all of them), spaces, and with half-width parentheses."""
    t = F.translate(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)[\s\u00A0]+", ""), "（）", "()")
    if layers is None:
        # As many layers as there are both opening and closing marks at the ends.
        n = F.least(F.length(F.regexp_extract(t, "^(《*)", 1)), F.length(F.regexp_extract(t, "(》*)$", 1)))
        return let(F.struct(t.alias("t"), n.alias("n")), lambda x: F.substring(x["t"], x["n"] + 1, F.greatest(F.length(x["t"]) - 2 * x["n"], F.lit(0))))
    for _ in range(layers):
        t = F.regexp_replace(t, r"^《(.*)》$", "$1")
    return t


def strip_version(title: Column) -> Column:
    """Without version notes in brackets at the end, however many follow each other."""
    return strip(F.regexp_replace(title, rf"(?U)(?:{lexicon.VERSION}\s*)+$", ""))


def clean_lines(text: Column) -> Column:
    """Line ends behind a backslash go with it, blanks at line ends go, three line ends or more become two."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\\\s*\n", "")
    return strip(F.regexp_replace(F.regexp_replace(t, r"[ \t\u3000]+\n", "\n"), r"\n{3,}", "\n\n"))


def norm_space(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"[ \t\u3000]+", " "))


def chinese_number(text: Column) -> Column:
    """Chinese or Arabic numerals below ten thousand as an int, null for others; a unit without a digit counts as one."""
    digits = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
    digit = F.create_map(*(x for c, i in digits.items() for x in (F.lit(c), F.lit(i))))
    unit = F.create_map(*(x for c, i in (("十", 10), ("百", 100), ("千", 1000)) for x in (F.lit(c), F.lit(i))))
    read = F.aggregate(
        F.split(text, ""),
        F.struct(F.lit(0).alias("sum"), F.lit(-1).alias("held")),
        lambda s, c: F.when(
            unit[c].isNotNull(),
            F.struct((s["sum"] + F.when(s["held"] > 0, s["held"]).otherwise(1) * unit[c]).alias("sum"), F.lit(-1).alias("held")),
        ).otherwise(F.struct(s["sum"].alias("sum"), F.coalesce(digit[c], F.lit(0)).alias("held"))),
        lambda s: s["sum"] + F.greatest(s["held"], F.lit(0)),
    )
    return F.when(text.rlike(r"^\d+$"), text.cast("int")).when(text.rlike("^[零〇一二两三四五六七八九十百千]+$"), read)


def article_number(label: Column) -> Column:
    """The (article, sub-article) of a label such as 第十二条之一, as a struct of ints."""
    part = lambda g: F.regexp_extract(label, "^第([零〇一二两三四五六七八九十百千\\d]+)条(?:之([一二三四五六七八九十\\d]+))?", g)
    return F.struct(chinese_number(part(1)).alias("no"), F.coalesce(chinese_number(F.nullif(part(2), F.lit(""))), F.lit(0)).alias("sub"))


def after_think(text: Column, last: bool = False) -> Column:
    """What stands behind the first (or the last) closing think tag, or the whole text; also an unclosed one at the head goes."""
    at = F.instr(text, "</think>")
    behind = F.element_at(F.split(text, "</think>"), -1) if last else F.substring(text, at + 8, F.length(text))
    whole = F.regexp_replace(text, r"(?s)^\s*<think>.*$", "") if last else text
    return F.trim(F.when(at > 0, behind).otherwise(whole))


def choice_letters(answer: Column) -> Column:
    """The set of letters A-F that an answer chooses: at its head, behind a key word in its first 400 characters, or loose ones in a short text."""

    def of(t: Column) -> Column:
        head, named = F.regexp_extract(t, f"(?U){lexicon.CHOICE_HEAD}", 1), F.regexp_extract(F.substring(t, 1, 400), lexicon.CHOICE_KEY, 1)
        loose = F.when(F.length(t) <= 60, F.array_join(F.regexp_extract_all(t, F.lit(lexicon.CHOICE_LOOSE), F.lit(1)), ""))
        return F.upper(F.coalesce(F.nullif(head, F.lit("")), F.nullif(named, F.lit("")), loose, F.lit("")))

    return F.array_sort(F.array_distinct(F.filter(F.split(let(strip(F.coalesce(answer, F.lit(""))), of), ""), lambda c: c != "")))


def is_choice(gold: Column) -> Column:
    """Whether a reference answer is one to five letters."""
    return F.coalesce(strip(gold).rlike("^[A-Fa-f]{1,5}$"), F.lit(False))


def tolerant_json(text: Column) -> Column:
    """The JSON value in a reply as a variant: all of it, a fenced block, or the outermost braces or brackets, with trailing commas forgiven."""
    t = F.trim(F.coalesce(text, F.lit("")))
    spans = [t, F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1), F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.regexp_extract(t, r"(?s)(\[.*\])", 1)]
    tries = [F.try_parse_json(F.nullif(x, F.lit(""))) for x in spans]
    tries += [F.try_parse_json(F.nullif(F.regexp_replace(x, r",\s*([}\]])", "$1"), F.lit(""))) for x in spans[1:]]
    return F.coalesce(*tries)


def scrub(text: Column, names: list[str], mark: str = "[已脱敏]") -> Column:
    """Names replaced, whatever their case; longer ones first."""
    import re

    pattern = "(?i)" + "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
    return F.regexp_replace(text, pattern, mark) if names else text


def anonymous_id(name: Column, seed: int) -> Column:
    return F.concat(F.lit("SYS-"), F.upper(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), 1, 4)))


def scaled_log(value: Column, most: Column) -> Column:
    """log1p of a count over log1p of the largest, 0 where there is none."""
    return F.when(most > 0, F.log1p(F.greatest(value, F.lit(0))) / F.log1p(most)).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def first_rule(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first rule (label, pattern) that the text fits."""
    out = None
    for label, pattern in rules:
        out = F.when(text.rlike(pattern), label) if out is None else out.when(text.rlike(pattern), label)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def hits(text: Column, words: str) -> Column:
    """How many of some words (with blanks between them) a text holds, each once."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words.split()[1:]), F.contains(text, F.lit(words.split()[0])).cast("int"))


def domain_by(text: Column, lists: dict[str, str]) -> Column:
    """The first domain of which a text holds a word, or null."""
    out = None
    for domain, words in lists.items():
        some = hits(text, words) > 0
        out = F.when(some, domain) if out is None else out.when(some, domain)
    return out


def law_domain(name: Column) -> Column:
    """The domain of a law's name: procedural, criminal, civil, general, tried in this order; else null."""
    return domain_by(name, lexicon.LAW_NAMES)


def title_domain(title: Column) -> Column:
    """(domain, keyword) of a statute's title: the first word, in the order of the lists, that it holds; else general and null."""
    found = F.array(*(F.when(F.contains(title, F.lit(w)), F.struct(F.lit(d).alias("domain"), F.lit(w).alias("keyword"))) for d, words in lexicon.TITLES.items() for w in words.split()))
    none = F.struct(F.lit("general").alias("domain"), F.lit(None).cast("string").alias("keyword"))
    return F.coalesce(F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0)), none)


def document_type(text: Column) -> Column:
    """(type, domain) of the first kind of document that a text names, or null."""
    out = None
    for name, domain in lexicon.DOCUMENT_TYPES:
        hit, value = F.contains(text, F.lit(name)), F.struct(F.lit(name).alias("type"), F.lit(domain).alias("domain"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def task_kind(task: Column) -> Column:
    kinds = [(t, kind) for kind, tasks in lexicon.TASK_KINDS.items() for t in tasks.split()]
    return F.coalesce(F.create_map(*(F.lit(x) for pair in kinds for x in pair))[task], F.lit("qa"))


def no_item_reason(title: Column, text: Column) -> Column:
    """Why a statute gave no articles."""
    return (
        F.when(F.contains(title, F.lit("修正案")), "AMENDMENT_INSTRUCTION").when(F.contains(title, F.lit("附件")), "ANNEX_DOC")
        .when(title.rlike("批准|决议|决定"), "DECISION_OR_RATIFICATION").when(F.length(text) < 200, "TOO_SHORT_TO_CONTAIN_ARTICLE").otherwise("FORMAT_UNRECOGNIZED")
    )


def without_header(title: Column, text: Column, most: int = 7) -> Column:
    """A text without its first lines (some at most) as long as they are empty, a remark in brackets or behind >, a file number, or part
    of the title or hold it. What counts is the first line that is none of these."""
    bare = lambda x: F.regexp_replace(x, r"(?U)\s+", "")

    def plain(line: Column, whole: Column) -> Column:
        s = strip(line)
        remark = s.rlike(r"^>|^[（(].*[)）]$") | (F.contains(s, F.lit("法释")) & F.contains(s, F.lit("号")))
        same = (whole != "") & (F.contains(whole, bare(s)) | F.contains(bare(s), whole))
        return ~((s == "") | remark | same)

    def of(x: Column) -> Column:
        first = F.array_position(F.transform(F.slice(x["lines"], 1, most), lambda line: plain(line, x["title"])), True)
        at = F.when(first > 0, first).otherwise(most + 1)
        return clean_lines(F.array_join(F.slice(x["lines"], at, F.greatest(F.size(x["lines"]), F.lit(1))), "\n"))

    return let(F.struct(F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"), bare(F.coalesce(title, F.lit(""))).alias("title")), of)


def statute_set(text: Column) -> Column:
    """The set of (law, number as written) of citations like 《law》第n条, in order."""
    return F.array_distinct(cited(text, rf"《([^》\n]{{1,40}}?)》\s*第\s*([零一二三四五六七八九十百千0-9]+)\s*条"))


def unique_citations(answer: Column) -> Column:
    """Citations of an answer as (law, number as written), each once and in order, with blanks and either kind of quotes."""
    return F.array_distinct(cited(answer, rf"(?U)[《〈]\\s*([^《》〈〉]{{2,80}}?)\\s*[》〉]\\s*第\\s*([{lexicon.NUMERALS}]+)\\s*条".replace("\\\\", "\\")))


def cited(text: Column, pattern: str) -> Column:
    """All matches of a pattern with two groups, as (law, number)."""
    t = F.coalesce(text, F.lit(""))
    both = F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)).alias("law"), F.regexp_extract_all(t, F.lit(pattern), F.lit(2)).alias("number"))
    return F.transform(both, lambda x: F.struct(strip(x["law"]).alias("law"), strip(x["number"]).alias("number")))


def filled(template: str, **values: Column) -> Column:
    """A prompt: {name} in a template replaced by values, one after the other."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def rubric_direction(point: Column) -> Column:
    return F.when(point >= 0, "不是").otherwise("是")


def slug(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("__"))


def human_size(n: Column) -> Column:
    """Bytes in units of 1024 with one place."""
    units = ("B", "KB", "MB", "GB", "TB", "PB")
    power = F.least(F.greatest(F.floor(F.log(1024.0, F.greatest(n, F.lit(1)).cast("double")) + 1e-12), F.lit(0)), F.lit(len(units) - 1)).cast("int")
    return let(power, lambda k: F.concat(F.format_string("%.1f", F.bround(n / F.pow(F.lit(1024.0), k), 1)), F.get(F.array(*map(F.lit, units)), k)))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.round(100.0 * part / whole, 2)).otherwise(0.0)


def case_id(dataset: Column, index: Column, raw: Column | None = None) -> Column:
    """dataset::case-id, or with a number of five digits where there is no id."""
    numbered = F.lpad(index.cast("string"), F.greatest(F.lit(5), F.length(index.cast("string"))), F.lit("0"))
    own = F.nullif(raw, F.lit("")) if raw is not None else F.lit(None).cast("string")
    return F.concat(F.lower(F.trim(dataset)), F.lit("::case-"), F.coalesce(own, numbered))


def last_match(log: Column, pattern: str) -> Column:
    """The first group of a pattern's last match in a log whose lines may have been written over, or an empty text."""
    found = F.regexp_extract_all(F.translate(log, "\r\x1b", "\n"), F.lit(pattern), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise("")


def document_text(law: Column, text: Column, most: int = 500) -> Column:
    """What stands for a whole document: its law and the head of its text."""
    return F.concat_ws(" ", law, F.substring(text, 1, most))


def mix(text: Column) -> Column:
    """A map of whole numbers from `a=1,b=2`."""
    return F.transform_values(F.str_to_map(F.regexp_replace(text, r"\s+", ""), F.lit(","), F.lit("=")), lambda _, v: v.cast("long"))


def scrub_counts(text: Column, names: list[str]) -> Column:
    """How often each name stands in a text, whatever its case."""
    import re

    return F.create_map(*(x for n in names for x in (F.lit(n), F.regexp_count(text, F.lit("(?i)" + re.escape(n))))))


def seeded_order(items: Column, seed: str, key: Column) -> Column:
    """An array in an order that its seed, a key and its items decide."""
    return F.transform(F.array_sort(F.transform(items, lambda x: F.struct(F.sha1(F.concat(F.lit(seed + ":"), key, F.lit("\x00"), x)).alias("h"), x.alias("x")))), lambda s: s["x"])
