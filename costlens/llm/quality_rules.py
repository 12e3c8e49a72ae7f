"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements and
one failure bit per rule; a policy is a versioned set of rules, so applying another
policy, or asking what a rule costs, never reads a text again.

Defined results: a null text has no words (and fails ``few_words``); repeated rows are judged one by one; an empty table gives
an empty ledger; only the named id and text columns are read, so other columns may
have any names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.llm.common import BLANKS, let, pieces, whole

WINDOW = 5
SYMBOLS = "#*$%&|<>"

# The position of a name is its bit.
RULE_NAMES = ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length")


def _rules(m: Column) -> dict[str, Column]:
    """When a document with measurements ``m`` fails each rule."""
    return {
        "few_words": m["n_words"] < 10,
        "repeated_words": 100 * m["n_repeat_words"] > 20 * m["n_words"],
        "symbols": 2 * m["n_symbols"] > m["n_words"],
        "repeated_lines": (m["n_dup_lines"] >= 3) & (2 * m["n_dup_lines"] > m["n_lines"]),
        "word_length": (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 40 * m["n_words"]),
    }


@dataclass(frozen=True)
class Policy:
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULE_NAMES.index(r) for r in self.rules)


BASE = Policy(1, ("few_words", "repeated_words"))
STANDARD = Policy(2, RULE_NAMES)


def _repeated_words(grams: Column) -> Column:
    """Words inside windows that occur at least twice, from the windows' hashes in order."""
    placed = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(p: Column) -> Column:
        # neighbours in hash order; the ends have none on one side
        same = lambda x, i: F.coalesce(
            x["h"] == F.get(p, i - 1)["h"], F.lit(False)
        ) | F.coalesce(x["h"] == F.get(p, i + 1)["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(p, same), lambda x: x["i"]))

    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(
        let(placed, twice),
        start,
        lambda a, i: F.struct(
            (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")
        ),
        lambda a: a["n"],
    )
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(covered)


def _grams(words: Column) -> Column:
    """Hash of each window of words."""
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    return F.transform(
        starts, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)])
    )


def judged(text: Column) -> Column:
    """A struct of all measurements and ``fail_bits``, each computed once per text.

    It is one expression, so a filter on it doesn't repeat any part of it.
    """
    text = whole(text)
    long = lambda c, name: c.cast("long").alias(name)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(
        pieces(text, BLANKS),
        lambda w: F.struct(
            long(F.size(w), "n_words"), long(let(_grams(w), _repeated_words), "n_repeat_words")
        ),
    )
    by_lines = let(
        lines,
        lambda x: F.struct(
            long(F.size(x), "n_lines"), long(F.size(x) - F.size(F.array_distinct(x)), "n_dup_lines")
        ),
    )
    measured = let(
        F.struct(by_words.alias("w"), by_lines.alias("l")),
        lambda x: F.struct(
            x["w"]["n_words"].alias("n_words"),
            long(F.length(F.regexp_replace(text, BLANKS, "")), "word_chars"),
            long(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), "n_symbols"),
            x["l"]["n_lines"].alias("n_lines"),
            x["l"]["n_dup_lines"].alias("n_dup_lines"),
            x["w"]["n_repeat_words"].alias("n_repeat_words"),
        ),
    )

    def with_bits(m: Column) -> Column:
        rules = _rules(m)
        bits = F.lit(0).cast("long")
        for i, name in enumerate(RULE_NAMES):
            bits = bits + F.when(rules[name], F.lit(1 << i)).otherwise(F.lit(0))
        return F.struct(m.alias("measured"), bits.alias("fail_bits"))

    return let(measured, with_bits)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements plus ``fail_bits``: bit i is set where rule i of RULE_NAMES fails."""
    found = docs.select(F.col(id_col).alias(id_col), judged(F.col(text_col)).alias("j"))
    return found.select(F.col(id_col), "j.measured.*", "j.fail_bits")


def fails(policy: Policy, bits: Column | str = "fail_bits") -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(policy.mask)) != 0


def ablations(ledger: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """Per policy and rule: documents failing it, and those only it rejects.

    Works on the counts of distinct bit patterns, at most 2 ** rules of them.
    """
    patterns = ledger.groupBy("fail_bits").agg(F.count("*").alias("n"))
    cells = [
        F.struct(
            F.lit(p.version).alias("version"),
            F.lit(r).alias("rule"),
            F.lit(p.mask).cast("long").alias("mask"),
            F.lit(1 << RULE_NAMES.index(r)).cast("long").alias("bit"),
        )
        for p in policies
        for r in p.rules
    ]
    each = patterns.select("fail_bits", "n", F.inline(F.array(*cells)))
    failed = F.col("fail_bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("fail_bits").bitwiseAND(F.col("mask")) == F.col("bit")
    return each.groupBy("version", "rule").agg(
        F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only_this"),
    )


def keep_good(docs: DataFrame, policy: Policy = STANDARD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the policy, unchanged and with all their columns."""
    return docs.where(~fails(policy, judged(docs[text_col])["fail_bits"]))
