"""Quality rules as a ledger of bits: each rule is evaluated once, policies and ablations read the bits.

`ledger` gives every document its measurements and one long `failed`, bit b set where rule b fails. `apply_policy` decides by
a versioned mask of rules, `ablate` tells for each rule how many documents it alone rejects; neither looks at a text again.

Cases: a null text counts as empty, with zero counts and no words; empty texts fail `few_words`; repeated rows and ties are
rows like others; an empty table gives none; all columns of the input stay, whatever their names, beside `measures` and `failed`
(an input column of either name is replaced). Long texts cost n log n in their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import SPACE, UPPER, let

#: Rules by bit: name and failure, from the measurements m. Integer arithmetic, so that every engine decides alike.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "m.n_words < 10"),
    ("repeated_words", "100 * m.n_repeat_words > 20 * m.n_words"),
    ("symbols", "100 * m.n_symbols > 30 * m.n_words"),
    ("shouting", "100 * m.n_upper > 50 * m.word_chars"),
    ("exclamations", "100 * m.n_exclaims > 30 * m.n_words"),
    ("duplicate_lines", "100 * m.n_dup_lines > 50 * m.n_lines"),
    ("long_words", "m.word_chars > 25 * m.n_words"),
)
BIT = {name: i for i, (name, _) in enumerate(RULES)}
#: Which rules a policy heeds, by version.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "shouting", "exclamations", "duplicate_lines", "long_words"),
}


def policy_mask(version: str) -> int:
    return sum(1 << BIT[r] for r in POLICIES[version])


def _repeat_words(words: Column, n: int = 5) -> Column:
    """How many words stand in windows of n words that the text holds twice or more."""
    count = F.size(words)
    windows = F.when(
        count >= n,
        F.transform(F.slice(words, F.lit(1), F.greatest(count - (n - 1), F.lit(1))), lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, n)))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = lambda o: F.filter(o, lambda x, i: (F.get(o, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(o, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])))
        places = let(ordered, lambda o: F.sort_array(F.transform(again(o), lambda x: x["i"])))
        return let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(n)), F.lit(n))), F.lit(0), lambda a, b: a + b
            ),
        )

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))


def measures(text: Column) -> Column:
    """A struct of all measurements (long)."""

    def of(t: Column) -> Column:
        words = F.array_remove(F.split(t, f"[{SPACE}]+"), "")
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
        without = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
        of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("again")))
        of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))
        return let(
            F.struct(of_words.alias("w"), of_lines.alias("l")),
            lambda c: F.struct(
                c["w"]["n"].cast("long").alias("n_words"),
                F.length(F.translate(t, " \t\n\u000b\f\r", "")).cast("long").alias("word_chars"),
                without("#*$%&|<>").cast("long").alias("n_symbols"),
                c["l"]["again"].cast("long").alias("n_dup_lines"),
                c["w"]["again"].cast("long").alias("n_repeat_words"),
                c["l"]["n"].cast("long").alias("n_lines"),
                without(UPPER).cast("long").alias("n_upper"),
                without("!").cast("long").alias("n_exclaims"),
            ),
        )

    return let(F.coalesce(text, F.lit("")), of)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `measures` (a struct) and `failed` (a long of failure bits)."""
    measured = docs.withColumn("measures", measures(F.col(text)))
    bits = [F.expr(f"IF({rule.replace('m.', 'measures.')}, {1 << b}L, 0L)") for b, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed)


def apply_policy(ledgered: DataFrame, version: str) -> DataFrame:
    """Adds `kept`: no rule that this version of the policy heeds has failed."""
    return ledgered.withColumn("kept", F.col("failed").bitwiseAND(policy_mask(version)) == 0)


def ablate(ledgered: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: rule, n_failed, n_only (documents that pass once the rule is left out), and n_docs; one
    pass of sums over the bits, with a row per rule."""
    mask = policy_mask(version)
    sums = [F.count(F.lit(1)).alias("n_docs")]
    for name in POLICIES[version]:
        bit = 1 << BIT[name]
        sums.append(F.sum(F.shiftright("failed", BIT[name]).bitwiseAND(1)).alias(f"f_{name}"))
        sums.append(F.sum((F.col("failed").bitwiseAND(mask) == bit).cast("long")).alias(f"o_{name}"))
    rows = F.array(
        *(
            F.struct(F.lit(r).alias("rule"), F.coalesce(f"f_{r}", F.lit(0)).cast("long").alias("n_failed"), F.coalesce(f"o_{r}", F.lit(0)).cast("long").alias("n_only"), "n_docs")
            for r in POLICIES[version]
        )
    )
    return ledgered.agg(*sums).select(F.inline(rows))


def digest(docs: DataFrame, version: str = "v1") -> DataFrame:
    """doc_id, the measurements, base_failed, kept and failed."""
    done = apply_policy(ledger(docs.select("doc_id", "text")).select("doc_id", "measures", "failed"), version)
    return done.select("doc_id", "measures.*", (F.col("failed").bitwiseAND(policy_mask("base")) != 0).alias("base_failed"), "kept", "failed")
