"""Quality rules: a threshold table compiled into one projection of built-in functions.

Words are runs of characters outside ``[\\x20\\x09-\\x0D]``.  All counts of a
text come from its own row, so nothing shuffles; a text is split once and its
words are reused.  Repeated three-word windows are found by sorting the 64-bit
window hashes of a text, and only in texts that have two equal hashes; no step
is quadratic in a text's length.

Defined results: a null or empty text has no words and fails the base rule;
repeated rows are judged one by one alike; an empty table gives an empty result;
ratios of a text without words are 0.  Only the id and text columns are read, so
further columns cannot clash; ``keep_good`` keeps every column of its input.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import text_table

# Frequent function words of the four languages of the corpus.
STOP_WORDS = tuple(sorted(set((
    "the of and to in a is that for on with as was be this are by or from at "
    "der die das und ist in den von zu mit auf für im nicht ein eine dem des sich auch "
    "le la les de des du et un une est en que dans pour par sur au qui plus pas "
    "el la los las de del y que en un una es por con para se no al lo su").split())))

_WORD = r"([^\x20\x09-\x0D]+)"
_SYMBOL = r"[#*$%&|<>]"


class Rule(NamedTuple):
    """A text fails if ``metric`` is below ``low`` or above ``high``."""

    metric: str
    low: float | None
    high: float | None


#: Metrics as (numerator, denominator) among the counts; a zero denominator counts as 1.
METRICS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "repeat_word_ratio": ("n_repeat_words", "n_words"),
}

#: Production thresholds: they reject junk and leave ordinary prose of any length alone.
RULES = (
    Rule("mean_word_chars", 2.0, 20.0),
    Rule("symbols_per_word", None, 0.10),
    Rule("dup_line_ratio", None, 0.50),
    Rule("stop_word_ratio", 0.02, None),
)


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_repeat_words) per row."""
    words, windows, placed, starts = F.col("words"), F.col("windows"), F.col("placed"), F.col("starts")
    split = text_table(docs, id_col, text_col).select(
        "id", "text", F.regexp_extract_all("text", F.lit(_WORD), F.lit(1)).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(_WORD)).alias("lines"))
    counted = split.select(
        "id", F.size("words").alias("n_words"), F.length(F.array_join("words", "")).alias("word_chars"),
        F.regexp_count("text", F.lit(_SYMBOL)).alias("n_symbols"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).alias("n_stop_words"),
        F.slice(F.transform("words", lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
                F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))).alias("windows"))
    several = F.size(F.array_distinct("windows")) < F.size("windows")
    # Sorted by (hash, position): a window is repeated if a neighbour has its hash.
    sorted_ = counted.withColumn("placed", F.when(several, F.array_sort(
        F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def repeated(x: Column, k: Column) -> Column:
        same = [F.coalesce(x["h"] == F.get(placed, k + d)["h"], F.lit(False)) for d in (-1, 1)]
        return same[0] | same[1]

    found = sorted_.withColumn("starts", F.array_sort(F.transform(F.filter("placed", repeated), lambda x: x["i"])))
    # A start covers three words, or those before the next start.
    covered = F.aggregate(
        F.transform("starts", lambda x, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - x, F.lit(3)))),
        F.lit(0), lambda a, x: a + x)
    return found.select(
        "id", *[F.col(c).cast("bigint").alias(c) for c in
                ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words")],
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def verdict(rules: Sequence[Rule]) -> Column:
    """One boolean expression over the counts: true if no rule of the table is broken."""
    holds = F.lit(True)
    for rule in rules:
        part, whole = METRICS[rule.metric]
        value = F.col(part) / F.greatest(F.col(whole), F.lit(1))
        if rule.low is not None:
            holds = holds & (value >= rule.low)
        if rule.high is not None:
            holds = holds & (value <= rule.high)
    return holds


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts with ``base_failed`` and ``kept``."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return text_counts(docs, id_col, text_col).withColumn("base_failed", base).withColumn(
        "kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The rows that pass, with all their columns: the row itself rides along as the id."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("body"))
    # The row number keeps the filter above the counts: pushed below, it would repeat their expressions inside each other.
    judged = judge(whole, rules, "row", "body").withColumn("at", F.monotonically_increasing_id())
    kept = judged.where("kept AND at >= 0")
    return kept.select(*[F.col("id").getField(c).alias(c) for c in docs.columns])
