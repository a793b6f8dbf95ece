"""I-Match fingerprints over randomised lexicon subsets, in DataFrame operations only.

1. Lexicon: the lower-case words whose document frequency lies in a band (an
   inverse-document-frequency band), counted over all documents.  A word in the
   band is in at least ``low`` of the documents, so the lexicon has at most
   (words per document) / ``low`` entries however many documents there are.  It is
   counted: up to ``max_broadcast`` words it is broadcast, a larger one is joined
   by a shuffle, in which adaptive execution splits frequent words.
2. Every lexicon word has a bit mask that says in which of the random subsets
   it is.  Subsets are of several sizes, so that long and short documents both
   meet some with few of their words.
3. A document keeps its distinct lexicon words; for every subset the hashes of
   its words are combined by exclusive or, in aggregates of fixed size.  This
   stands for sorting the words and hashing the list: words are distinct and the
   result has no order, so equal sets have equal hashes, and unequal ones differ
   but for a chance of 2^-64.  The fingerprint is the list of these hashes.  A
   subset without words of the document has hash 0.  ``likeness`` is the share of equal hashes among the
   subsets that are not empty in both.
4. A text without lexicon words has a fingerprint of the words that it has: one
   hash of all its distinct words, and for the others the least of its
   ``_LEAST`` smallest word hashes in each remainder class.  Without any word,
   the first hash is that of the text.

``with_next`` finds each row's successor in key order without a global sort in
one task: rows are dealt to key ranges, windows run inside a range, and the last
row of a range takes the first row of the next range.  Rows with one key are
dealt by the first 64 characters of their texts; only if these are equal too do
they meet in one range.

Defined results: only a null or empty text has only zeros; two such
fingerprints are alike (1.0), equal ones always are; texts without lexicon
words have equal ones only if their words are the same, and without any word
only if they are equal; rows with
equal keys follow each other in text order; null keys come first; in an empty
table there is nothing; the only row has an empty text as its successor if the
table has one row, since there is none; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.common import stash, text_table
from emberframe.operators.ordinals import grouped_ordinal

#: (chance of a word to be in the subset, number of subsets), at most 63 in all, the bits of a mask; the first has every word
SUBSETS = ((1.0, 1), (0.5, 4), (0.25, 6), (1 / 16, 12), (1 / 64, 14), (1 / 256, 12), (1 / 1024, 8), (1 / 4096, 6))
_SEED = 71
#: Smallest word hashes that are kept of a text in case it has no lexicon words.
_LEAST = 32
#: Characters of a text that tell rows with one key apart when rows are dealt to ranges.
_START = 64


def n_subsets(subsets=SUBSETS) -> int:
    return sum(n for _, n in subsets)


def words_of(text: Column) -> Column:
    """Distinct lower-case words (runs of letters), and always the empty word."""
    return F.array_distinct(F.split(F.lower(F.concat(text, F.lit(" "))), r"[^\p{L}]+"))


def _mask(word: Column, subsets) -> Column:
    """Bit k is set if the word is in subset k."""
    chances = [p for p, n in subsets for _ in range(n)]
    bits = [F.when(F.pmod(F.xxhash64(word, F.lit(_SEED + k)), F.lit(1 << 20)) < int(p * (1 << 20)), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint")
            for k, p in enumerate(chances)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def lexicon(
    docs: DataFrame, low: float = 0.003, high: float = 0.2, least_docs: int = 2, text_col: str = "text", subsets=SUBSETS,
) -> DataFrame:
    """(word, mask) of the words in the band, stored."""
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    n = docs.count()
    seen = texts.select(F.explode(words_of(F.col("text"))).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("df"))
    band = seen.where((F.col("df") >= max(least_docs, low * n)) & (F.col("df") <= max(least_docs, high * n)))
    return stash(band.select("word", _mask(F.col("word"), subsets).alias("mask")), "lexicon")


def _spare(text: Column, words: Column) -> Column:
    """What tells a text without lexicon words: a hash of all its words, or of the text if it has none, and the least word hashes."""
    hashes = F.sort_array(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))
    whole = F.when(F.size(hashes) > 0, F.xxhash64(hashes)).when(text != "", F.xxhash64(text)).otherwise(F.lit(0))
    return F.struct(whole.alias("whole"), F.slice(hashes, 1, _LEAST).alias("least"))


def _spare_prints(spare: Column, n: int) -> Column:
    classes = F.transform(F.sequence(F.lit(0), F.lit(n - 2)), lambda k: F.coalesce(
        F.array_min(F.filter(spare["least"], lambda h: F.pmod(h, F.lit(n - 1)) == k)), F.lit(0).cast("bigint")))
    return F.concat(F.array(spare["whole"]), classes)


def fingerprints(texts: DataFrame, words: DataFrame, keys: list[str], subsets=SUBSETS, max_broadcast: int = 500_000) -> DataFrame:
    """``texts`` (unique key columns, ``text``, and others) with ``prints``, one long per subset, instead of ``text``.

    Only lexicon words, and the empty word, which every text has, are regrouped.
    The other columns go along as grouping columns, so the aggregates are longs.
    """
    spark = words.sparkSession
    n = n_subsets(subsets)
    entries = words.select("word", F.xxhash64("word").alias("h"), "mask").unionByName(spark.sql("SELECT '' AS word, 0L AS h, 0L AS mask"))
    if words.count() <= max_broadcast:
        entries = F.broadcast(entries)
    others = [c for c in texts.columns if c != "text" and c not in keys]
    split = texts.select(*keys, *others, "text", words_of(F.col("text")).alias("words"))
    told = split.select(*keys, *others, _spare(F.col("text"), F.col("words")).alias("spare"), "words")
    exploded = told.select(*keys, *others, "spare", F.explode("words").alias("word"))
    kept = exploded.join(entries, "word").groupBy(*keys, *others, "spare").agg(
        *[F.expr(f"bit_xor(h & -(shiftright(mask, {k}) & 1L))").alias(f"p{k}") for k in range(n)])
    none = reduce(lambda a, b: a & b, [F.col(f"p{k}") == 0 for k in range(n)])
    return kept.select(*keys, *others, F.when(none, _spare_prints(F.col("spare"), n)).otherwise(
        F.array(*[f"p{k}" for k in range(n)])).alias("prints"))


def likeness(a: Column, b: Column) -> Column:
    """Share of subsets with equal hashes among those that are not empty in both; 1 if all are empty."""
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(None).cast("int")).otherwise((x == y).cast("int")))
    told = F.filter(pairs, lambda x: x.isNotNull())
    same = F.aggregate(told, F.lit(0), lambda s, x: s + x)
    return F.when(F.size(told) == 0, F.lit(1.0)).otherwise(same / F.greatest(F.size(told), F.lit(1)))


def as_text(prints: Column) -> Column:
    """Sixteen hexadecimal digits of every hash; equal lists have equal texts."""
    return F.array_join(F.transform(prints, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _cuts(keys: DataFrame, rows_per_range: int, max_ranges: int) -> tuple[int, str]:
    """(number of ranges, JSON list of the keys that start the second range and those after it)."""
    numbered = grouped_ordinal(keys, [], keys.columns, "no", kind="bigint")
    step = max(rows_per_range, -(-keys.count() // max_ranges))
    starts = numbered.where((F.col("no") > 0) & (F.col("no") % step == 0)).select(F.struct(*keys.columns).alias("cut")).distinct()
    found = starts.agg(F.sort_array(F.collect_list("cut")).alias("cuts")).select(F.size("cuts"), F.to_json("cuts")).first()
    return found[0] + 1, found[1]


def _at_or_below(cuts: Column, n: int, key: Column) -> Column:
    """How many of ``n`` sorted cuts are at most ``key``, by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    inside = lambda at: at <= F.lit(n)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        inside(at + step) & (F.get(cuts, F.least(at + step, F.lit(n)) - 1) <= key), at + step).otherwise(at))


def with_next(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 1500, max_ranges: int = 100_000
) -> DataFrame:
    """(range, place, id, text, next_range, next_place, next_text) in key order; the last row is followed by the first.

    Rows are numbered by ``ordinals``, on (key, start of the text) only; every
    ``rows_per_range``-th row, or a later one so that there are at most
    ``max_ranges``, starts a range.  A row finds its range by binary search.
    """
    docs = text_table(docs, id_col, text_col).withColumn("start", F.substring("text", 1, _START))
    ranges, listed = _cuts(docs.select("id", "start"), rows_per_range, max_ranges)
    kind = dict(docs.dtypes)["id"]
    cuts = F.from_json(F.lit(listed), f"array<struct<id:{kind},start:string>>")
    range_of = _at_or_below(cuts, ranges - 1, F.struct("id", "start")) if ranges > 1 else F.lit(0)
    dealt = docs.select(range_of.alias("range"), "id", "text")
    order = Window.partitionBy("range").orderBy(F.col("id").asc_nulls_first(), "text")
    placed = dealt.select(
        "range", F.row_number().over(order).alias("place"), "id", "text", F.lead("text").over(order).alias("after"))
    # The first row of every range: keys and starts first, then the texts of these few.
    begun = docs.select(range_of.alias("range"), "id", "start", "text")
    heads = begun.groupBy("range").agg(F.min(F.struct("id", "start")).alias("least"))
    texts = begun.join(heads, (begun.range == heads.range) & begun.id.eqNullSafe(F.col("least.id")) & (
        begun.start == F.col("least.start")), "left_semi")
    first = stash(texts.groupBy("range").agg(F.min("text").alias("head")), "heads")
    # One row per range, of which there are at most ``max_ranges``.
    around = Window.partitionBy(F.lit(0)).orderBy("range")
    order_of = first.select("range", F.lead("range").over(around).alias("follower"), F.min("range").over(around).alias("lowest"))
    follow = order_of.select("range", F.coalesce("follower", "lowest").alias("next_range")).join(
        first.select(F.col("range").alias("next_range"), "head"), "next_range")
    last = F.col("after").isNull()
    return placed.join(follow, "range", "left").select(
        "range", "place", "id", "text", F.when(last, F.col("next_range")).otherwise(F.col("range")).alias("next_range"),
        F.when(last, F.lit(1)).otherwise(F.col("place") + 1).alias("next_place"),
        F.when(last, F.col("head")).otherwise(F.col("after")).alias("next_text"))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 500_000, **band) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and how alike they are.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next).  Edited: the last floor(n_chars / 2) characters give way to as
    many (or all) from the start of the next document.
    """
    words = lexicon(docs, text_col=text_col, **band)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    follows = with_next(docs, id_col, text_col).select(
        "range", "place", "id", "next_range", "next_place", n.cast("bigint").alias("n_chars"), "text",
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    both = follows.withColumn("edited_sha256", F.sha2("edited", 256)).select(
        "range", "place", F.struct("id", "next_range", "next_place", "n_chars", "edited_sha256").alias("about"),
        F.explode(F.array(F.struct(F.lit(0).alias("form"), F.col("text").alias("text")),
                          F.struct(F.lit(1).alias("form"), F.col("edited").alias("text")))).alias("x"))
    # What is known of a row goes with its own text only.
    flat = both.select("range", "place", "x.form", F.when(F.col("x.form") == 0, F.col("about")).alias("about"), "x.text")
    prints = fingerprints(flat, words, ["range", "place", "form"], max_broadcast=max_broadcast)
    pick = lambda form: F.max(F.when(F.col("form") == form, F.col("prints")))
    rows = stash(prints.groupBy("range", "place").agg(
        F.max("about").alias("about"), pick(0).alias("own"), pick(1).alias("edited")).select("range", "place", "about.*", "own", "edited"), "prints")
    after = rows.select(F.col("range").alias("next_range"), F.col("place").alias("next_place"), F.col("own").alias("following"))
    return rows.join(after, ["next_range", "next_place"]).select(
        "id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))
