"""Secret scans: known patterns, and sliding windows of Shannon entropy over candidate strings.

Base kinds are found by pattern. Candidates for the method are maximal runs of one character class (`CLASSES`) that are long
enough; a window slides over each, its counts per character are kept up by adding the character that enters and taking off the
one that leaves, and the entropy follows from the two counts that change. Windows at or over the class's limit are merged to
spans. What the allow list knows, or what lies in a base span, is suppressed: a candidate of a known form (`FORM`), a span in
which no window is without a known word (`WORDS`) in or near it, and one that is mostly a lower-case path (`PATH`), so that what
a long key holds by chance does not hide it.

Spans are in code points, end exclusive. Cases: a null or empty text has none; matches of one kind do not overlap, those of two
kinds may; repeated rows are rows like others; an empty table gives none; of the input only the id and the text are read, so
other columns may have any name. Long texts and long candidates cost time in proportion to their length.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import free_name, let

#: Base kinds in the order in which they are listed: pattern of all matches, and the least that a match must fulfil.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, ACCESS, HEX = 12, r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
#: Of the method: class, pattern of candidates, window, least entropy in bits of a window. Codes of characters are below 128.
CLASSES: tuple[tuple[str, str, int, float], ...] = (
    ("entropy_hex", r"(?<![0-9A-Za-z])[0-9A-F]{24,}(?![0-9A-Za-z])", 24, 2.9),
    ("entropy_base64", r"(?<![A-Za-z0-9+/_-])(?=[a-z+/_-]*[A-Z0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{24,}", 24, 3.9),
    # Without lower-case letters (of base32, 99 % of random keys of 32 characters and more reach the limit), and without digits.
    ("entropy_upper", r"(?<![A-Za-z0-9+/_-])(?=[A-F0-9+/_-]*[G-Z])[A-Z0-9+/_-]{24,}+(?![a-z])", 24, 3.7),
    ("entropy_mixed", r"(?<![A-Za-z0-9+/_-])(?=[a-z+/_-]*[A-Z])(?=[A-Z+/_-]*[a-z])[A-Za-z+/_-]{24,}+(?![0-9])", 24, 3.9),
)
#: Texts that look random and are known not to be secrets: identifiers in UUID form, alphabets, examples, paths.
FORM = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
WORDS = "abcdefghij|0123456789|example|placeholder|sample|dummy|changeme"
PATH = r"/[a-z_-]+(?=/|$)|^[a-z_-]+(?=/)"
#: Places in a block of a running sum, and windows in a stretch of a candidate.
RUN, STRETCH = 256, 512
SPAN = "array<struct<kind:string,start:int,until:int>>"


def running(values: Column, join: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """The sums (or what else joins two) of an array of ints up to and with each place. In blocks: appending copies an array, so
    that no long one is appended to."""
    ints = F.array().cast("array<int>")
    more = lambda s, v: F.when(F.size(s) > 0, join(F.get(s, F.greatest(F.size(s) - 1, F.lit(0))), v)).otherwise(v)
    upto = lambda x: F.aggregate(x, ints, lambda s, v: F.concat(s, F.array(more(s, v))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda k: upto(F.slice(values, k * RUN + 1, F.lit(RUN))))
    both = let(blocks, lambda b: F.struct(b.alias("blocks"), upto(F.transform(b, lambda x: F.get(x, F.size(x) - 1))).alias("totals")))
    joined = lambda x: F.flatten(F.transform(x["blocks"], lambda b, k: F.when(k == 0, b).otherwise(F.transform(b, lambda v: join(F.get(x["totals"], F.greatest(k - 1, F.lit(0))), v)))))
    return F.when(F.size(values) > 0, let(both, joined)).otherwise(ints)


def located(text: Column, pattern: str) -> Column:
    """All matches as an array of (value, start): what a split leaves between them tells where each begins."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gaps"))
    ends = lambda c: running(F.transform(c["m"], lambda m, i: F.length(F.get(c["gaps"], i)) + F.length(m)))
    return let(found, lambda c: let(ends(c), lambda e: F.transform(c["m"], lambda m, i: F.struct(m.alias("value"), (F.get(e, i) - F.length(m)).alias("start")))))


def _kind(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("until")))


def _none() -> Column:
    return F.array().cast(SPAN)


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by kind and start."""
    long_enough = lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= ASSIGN_LEAST
    assign = F.when((F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(ASSIGN), _kind(F.filter(located(text, ASSIGN), long_enough), "assign")).otherwise(_none())
    access = F.when(F.contains(text, F.lit("AKIA")) & text.rlike(ACCESS), _kind(located(text, ACCESS), "access")).otherwise(_none())
    hexes = F.when(text.rlike(HEX), _kind(located(text, HEX), "hex")).otherwise(_none())
    return F.concat(assign, access, hexes)


def entropy_windows(value: Column, window: int, least: float) -> Column:
    """Where windows of a text of ASCII reach an entropy: array of (start, until), overlapping windows merged.

    A window of w characters has an entropy of log2 w - sum / w bits, with the sum of n log2 n over the counts n of its characters.
    When it moves, only the counts of the character that enters and of the one that leaves change, so that the sum is kept up by
    their two steps; how many of each the w - 1 characters in between hold is all that has to be known. Long candidates are cut into
    stretches of STRETCH windows, so that the cost is in proportion to the length."""
    term = [n * math.log2(n) if n else 0.0 for n in range(window + 1)]
    step = F.array(*(F.lit(term[n + 1] - term[n]) for n in range(window)))
    most = window * (math.log2(window) - least + 1e-9)  # of the sum

    def stretch(first: Column) -> Column:
        """Spans of the windows that begin at first and up to STRETCH - 1 places on."""
        return let(F.substring(value, first + 1, F.lit(STRETCH + window - 1)), lambda part: let(moved(part), lambda runs: F.transform(runs, lambda r: F.struct((r["start"] + first).alias("start"), (r["until"] + first).alias("until")))))

    def moved(part: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.array().cast("array<struct<start:int,until:int>>").alias("out"))

        def next_(s: Column, c: Column) -> Column:
            full = s["i"] >= window
            between = F.substring(part, F.greatest(s["i"] - (window - 2), F.lit(1)), F.least(s["i"], F.lit(window - 1)))
            held = lambda m, x: F.length(m) - F.length(F.replace(m, x, F.lit("")))
            gone = F.substring(part, s["i"] - (window - 1), F.lit(1))
            total = let(between, lambda m: s["sum"] + F.get(step, held(m, c)) - F.when(full, F.get(step, held(m, gone))).otherwise(0.0))
            return let(total, lambda t: F.struct(t.alias("sum"), (s["i"] + 1).alias("i"), F.when((s["i"] >= window - 1) & (t <= most), _longer(s["out"], s["i"] - (window - 1), window)).otherwise(s["out"]).alias("out")))

        return F.aggregate(F.split(part, ""), start, next_)["out"]

    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.length(value) - window, F.lit(0)), F.lit(STRETCH)), stretch)
    return let(F.flatten(pieces), _merged)


def _longer(spans: Column, start: Column, window: int) -> Column:
    """Spans with a window more, which the last one takes up if they meet."""
    last = F.get(spans, F.size(spans) - 1)
    grown = F.concat(F.slice(spans, F.lit(1), F.greatest(F.size(spans) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), (start + window).alias("until"))))
    return F.when(last.isNotNull() & (last["until"] >= start), grown).otherwise(F.concat(spans, F.array(F.struct(start.alias("start"), (start + window).alias("until")))))


def _merged(spans: Column) -> Column:
    """Spans in order, with those that meet made one; no span ends before one that begins before it."""
    begins = F.filter(spans, lambda s, i: (i == 0) | (F.get(spans, F.greatest(i - 1, F.lit(0)))["until"] < s["start"]))
    ends = F.filter(spans, lambda s, i: (i == F.size(spans) - 1) | (F.get(spans, i + 1)["start"] > s["until"]))
    return let(ends, lambda e: F.transform(begins, lambda s, i: F.struct(s["start"].alias("start"), F.get(e, i)["until"].alias("until"))))


def _known(value: Column, window: int) -> Column:
    """Whether a span is an example (with a known word and what stands up to a window from it taken out, no window is left), or a path for the most part."""
    near = F.regexp_replace(value, f"(?i)(?:.{{0,{window}}}(?:{WORDS}))+.{{0,{window}}}", " ")
    return ~near.rlike(f"[^ ]{{{window}}}") | (2 * F.length(F.regexp_replace(value, PATH, "")) < F.length(value))


def _high(kind: str, window: int, least: float) -> Callable[[Column], Column]:
    """From a candidate (value, start) to its spans of high entropy in the text, without those that the allow list knows."""
    value = lambda m, w: F.substring(m["value"], w["start"] + 1, w["until"] - w["start"])
    return lambda m: F.transform(
        F.filter(entropy_windows(m["value"], window, least), lambda w: ~_known(value(m, w), window)),
        lambda w: F.struct(F.lit(kind).alias("kind"), (m["start"] + w["start"]).alias("start"), (m["start"] + w["until"]).alias("until")),
    )


def entropy_spans(text: Column, base: Column) -> Column:
    """Spans of the method's classes, without what the allow list or a base span covers."""
    found = []
    for kind, pattern, window, least in CLASSES:

        def wanted(m: Column) -> Column:
            within = F.exists(base, lambda b: (b["start"] <= m["start"]) & (b["until"] >= m["start"] + F.length(m["value"])))
            return ~m["value"].rlike(FORM) & ~within

        found.append(F.when(text.rlike(pattern), F.flatten(F.transform(F.filter(located(text, pattern), wanted), _high(kind, window, least)))).otherwise(_none()))
    return F.concat(*found)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and more: arrays of (kind, start, until) by start, then kind as listed."""
    order = F.create_map(*(x for i, k in enumerate(("assign", "access", "hex", *(c[0] for c in CLASSES))) for x in (F.lit(k), F.lit(i))))

    def by_start(spans: Column) -> Column:
        keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("k"), s["until"].alias("until"), s["kind"].alias("kind"))))
        return F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["until"].alias("until")))

    def both(t: Column) -> Column:
        return let(base_spans(t), lambda b: F.struct(b.alias("base"), entropy_spans(t, b).alias("more")))

    done = docs.select(F.col(doc_id).alias("doc_id"), let(F.coalesce(F.col(text), F.lit("")), both).alias("found"))
    none = F.size("found.base") + F.size("found.more") == 0
    return done.select(
        "doc_id",
        F.when(none, _none()).otherwise(by_start(F.col("found.base"))).alias("base"),
        F.when(none, _none()).otherwise(by_start(F.concat("found.base", "found.more"))).alias("spans"),
    )


def _shown(spans: Column) -> Column:
    """Spans by start, those that overlap made one, of the first one's kind."""
    until = running(F.transform(spans, lambda s: s["until"]), F.greatest)

    def first(u: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(u, F.greatest(i - 1, F.lit(0))))
        each = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), before(i).alias("before")))
        return F.filter(each, lambda s: s["start"] >= s["before"])

    ended = lambda f, u: F.transform(f, lambda s, i: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), F.coalesce(F.get(f, i + 1)["before"], F.array_max(u)).alias("until")))
    return let(until, lambda u: let(first(u), lambda f: ended(f, u)))


def _cut(text: Column, spans: Column) -> Column:
    """The text with [kind] for each span. Pieces are taken from blocks, as taking one from a long text walks all of it."""

    def piece(blocks: Column, at: Column, n: Column) -> Column:
        k = lambda x: F.floor(x / STRETCH).cast("int")
        return F.when(n > 0, F.substring(F.array_join(F.slice(blocks, k(at) + 1, k(at + n - 1) - k(at) + 1), ""), at - k(at) * STRETCH + 1, n)).otherwise("")

    def pieces(blocks: Column) -> Column:
        from_ = lambda i: F.when(i == 0, 0).otherwise(F.get(spans, F.greatest(i - 1, F.lit(0)))["until"])
        head = F.transform(spans, lambda s, i: let(from_(i), lambda at: F.concat(piece(blocks, at, s["start"] - at), F.lit("["), s["kind"], F.lit("]"))))
        rest = let(F.element_at(spans, -1)["until"], lambda at: piece(blocks, at, F.length(text) - at))
        return F.array_join(F.concat(head, F.array(rest)), "")

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)), pieces)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of `scan` replaced in the text by [kind]; all columns stay. Overlapping spans become one."""
    name = free_name(docs.columns, "_spans")
    base = let(F.coalesce(F.col("text"), F.lit("")), lambda t: let(base_spans(t), lambda b: F.concat(b, entropy_spans(t, b))))
    ordered = F.array_sort(F.transform(F.col(name), lambda s: F.struct(s["start"].alias("start"), s["until"].alias("until"), s["kind"].alias("kind"))))
    clean = F.when(F.size(name) == 0, F.col("text")).otherwise(let(let(ordered, _shown), lambda s: _cut(F.col("text"), s)))
    return docs.withColumn(name, base).withColumn("text", clean).drop(name)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["until"].cast("string"))))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
