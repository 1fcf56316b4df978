"""Quality rules: a table of thresholds compiled into one projection of native expressions.

Words are the runs of characters other than U+0020 and U+0009 to U+000D. Every rule is
``factor * measure`` against ``share * base`` in whole numbers, so equal counts give equal
verdicts everywhere. Words, their joined text and the three-word windows are computed once a
row, each bound to a lambda variable; nothing is exploded or shuffled.

Defined cases: a null, empty or blank text has all counts 0, fails the base rule and is not
kept; repeated rows and null ids are judged row by row; other columns pass through ``judge``
unless they bear the name of a measure, which the measure replaces.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words_of

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "it", "that", "for", "on", "with", "as", "was", "by", "be", "at", "this",
    "der", "die", "das", "und", "ist", "nicht", "ein", "zu", "mit", "den", "dem", "von", "sich", "auch", "als", "auf",
    "le", "la", "les", "de", "des", "et", "un", "une", "est", "que", "qui", "dans", "pour", "par", "sur", "du",
    "el", "los", "las", "del", "y", "en", "es", "se", "con", "su", "al", "para", "no",
)
SYMBOLS = "#*$%&|<>"
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """The text passes if factor * measure <= share * base (at_least: >=)."""

    name: str
    measure: str
    factor: int
    share: int
    base: str  # a measure, or "1"
    at_least: bool = False

    def passes(self) -> Column:
        left = F.col(self.measure) * self.factor
        right = F.lit(self.share) if self.base == "1" else F.col(self.base) * self.share
        return left >= right if self.at_least else left <= right

    def sql(self) -> str:
        right = str(self.share) if self.base == "1" else f"{self.base} * {self.share}"
        return f"{self.measure} * {self.factor} {'>=' if self.at_least else '<='} {right}"


#: Base rules: failing one fails the text.
BASE = (
    Rule("enough_words", "n_words", 1, 50, "1", at_least=True),
    Rule("few_repeated_windows", "n_repeat_words", 100, 50, "n_words"),
)
#: The method's own thresholds.
RULES = (
    Rule("not_too_long", "n_words", 1, 1_000_000, "1"),
    Rule("mean_word_at_least_2", "word_chars", 1, 2, "n_words", at_least=True),
    Rule("mean_word_at_most_12", "word_chars", 1, 12, "n_words"),
    Rule("few_symbols", "n_symbols", 10, 1, "n_words"),
    Rule("some_stop_words", "n_stop_words", 100, 4, "n_words", at_least=True),
    Rule("few_repeated_lines", "n_dup_lines", 10, 5, "n_lines"),
)


def measures(text: Column) -> Column:
    """Struct of all counts of a text."""
    text = F.coalesce(text, F.lit(""))

    def of_words(words):
        n = F.size(words)
        joined = F.array_join(words, "")
        grams = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(
            F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("i")))

        def repeated(s):
            pairs = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
            hits = F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))
            return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda i: F.array(i, i + 1, i + 2)))))

        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return let(joined, lambda j: let(lines, lambda ls: F.struct(
            n.cast("long").alias("n_words"),
            F.length(j).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(j, rf"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            F.when(n > WINDOW, let(F.sort_array(grams), repeated)).otherwise(0).cast("long").alias("n_repeat_words"))))

    return let(words_of(text), of_words)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, text_col: str = "text", base=BASE, rules=RULES) -> DataFrame:
    """Adds the measures, base_failed, failed_rules (names) and kept."""
    own = [F.col(f"`{c}`") for c in docs.columns if c not in (*MEASURES, "base_failed", "failed_rules", "kept", "_rule_measures")]
    counted = docs.select(*own, measures(F.col(text_col)).alias("_rule_measures")).select(*own, "_rule_measures.*")
    failed = lambda rs: F.filter(F.array(*(F.when(~r.passes(), F.lit(r.name)) for r in rs)), lambda x: x.isNotNull())
    return (counted.withColumn("base_failed", F.size(failed(base)) > 0)
            .withColumn("failed_rules", failed((*base, *rules)))
            .withColumn("kept", F.size("failed_rules") == 0))
