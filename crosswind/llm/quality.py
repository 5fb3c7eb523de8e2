"""Line-first quality rules, in DataFrame functions only.

Every line is held against rules on navigation, symbols, shouting, repetition, boilerplate and punctuation; failing lines are
removed. A document goes if a base rule on the whole text fails (too few words, or too many of them inside repeated
three-word windows) or if removing lines takes away more than ``MAX_LOST`` of its word characters.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswind.llm.common import space_words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"
#: A document that loses more than this percentage of its word characters with its failing lines is rejected.
MAX_LOST_PERCENT = 50
#: Lines of at most this many words that hold one of the phrases are boilerplate.
BOILERPLATE_WORDS = 40
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "spdx-license-identifier",
    "terms of use",
    "privacy policy",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "click here",
    "subscribe to our newsletter",
)
#: Lines of fewer words than this have to end like a sentence.
SHORT_LINE = 6
ENDS = ".!?…:;\"'”’»)]"


def let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda variable isn't inlined as a column may be."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern))


def line_fails(line: Column, words: Column) -> Column:
    """Whether a line, given with its words (one at least), breaks a rule. Cheap rules come first: a line that fails one isn't
    held against the rest, and marks are counted only in lines that have any."""
    chars = F.length(F.array_join(words, ""))
    n = F.size(words)
    marks = line.rlike("[|\u00bb\u00b7#*$%&<>!]") & (
        let(_count(line, "[|\u00bb\u00b7]"), lambda k: (k >= 2) & (k * 5 >= n))  # navigation: a separator for five words or fewer
        | let(_count(line, SYMBOLS), lambda k: (k >= 3) & (k * 10 >= chars))
        | let(_count(line, "!"), lambda k: (k >= 3) & (k * 3 >= n))
    )
    return (
        ((n < SHORT_LINE) & ~F.lit(ENDS).contains(F.substring(F.element_at(words, -1), -1, 1)))
        | marks
        | ((n >= 4) & line.rlike("[A-Z]{2}") & (_count(line, "[A-Z]") * 2 > chars))
        | ((n <= BOILERPLATE_WORDS) & let(F.lower(line), lambda low: reduce(or_, (F.contains(low, F.lit(x)) for x in BOILERPLATE))))
        | ((n >= 10) & (F.size(F.array_distinct(words)) * 3 <= n))
    )


#: Up to so many distinct repeated windows are looked for one by one; more by sorting windows with their places.
FEW_REPEATS = 24


def repeat_words(words: Column) -> Column:
    """How many words stand in three-word windows that are found twice or more in the array of words.

    Windows are held against each other as 64-bit hashes: sorted, equal neighbours are repeats; O(n log n).
    """

    def covered(places: Column) -> Column:
        parts = F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1), p + 3) - p))
        return F.aggregate(parts, F.lit(0), lambda a, x: a + x)

    def sorted_places(s: Column) -> Column:
        same = F.filter(s, lambda e, j: F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda e: e["i"]))

    def placed(h: Column) -> Column:
        return F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))

    def repeated(h: Column, again: Column) -> Column:
        few = F.transform(F.filter(placed(h), lambda e: F.array_contains(again, e["h"])), lambda e: e["i"])
        return F.when(F.size(again) == 0, 0).otherwise(let(F.when(F.size(again) <= FEW_REPEATS, few).otherwise(let(F.sort_array(placed(h)), sorted_places)), covered))

    def windows(h1: Column) -> Column:
        n = F.size(h1)
        h2 = F.zip_with(h1, F.slice(h1, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
        return F.slice(F.zip_with(h2, F.slice(h1, F.lit(3), n), lambda a, b: F.xxhash64(a, b)), F.lit(1), n - 2)

    def twice(h: Column) -> Column:
        again = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, j: x == F.get(s, j + 1))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(again, lambda again: repeated(h, again)))

    return F.when(F.size(words) < 4, 0).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h1: let(windows(h1), twice)))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, cleaned text, the counts of the text as it was, base_failed, lost_percent and kept, for every row.

    A null text has no words and is rejected; so is an empty one. The order of rows, repeats and other columns don't matter;
    no shuffle.
    """
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    lines = F.transform(F.split("_text", "\n"), lambda x: F.struct(x.alias("line"), space_words(x).alias("words")))
    # each of these is used more than once, which keeps Spark from computing it again for each use
    rows = rows.select(id_col, "_text", lines.alias("_lines"))
    rows = rows.select(
        id_col,
        F.flatten(F.col("_lines.words")).alias("_words"),
        _count(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        let(F.filter("_lines", lambda x: F.size(x["words"]) > 0)["line"], lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.filter("_lines", lambda x: (F.size(x["words"]) == 0) | ~line_fails(x["line"], x["words"])).alias("_good"),
    )
    rows = rows.select(
        id_col,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        repeat_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.array_join("_good.line", "\n").alias("clean_text"),
        F.length(F.array_join(F.flatten(F.col("_good.words")), "")).alias("_left"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = F.when(F.col("word_chars") == 0, 100).otherwise(F.floor(100 * (F.col("word_chars") - F.col("_left")) / F.greatest(F.col("word_chars"), F.lit(1))))
    rows = rows.withColumns({"base_failed": base, "lost_percent": lost.cast("long")})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("lost_percent") <= MAX_LOST_PERCENT))


def document_verdicts(docs: DataFrame) -> DataFrame:
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_percent")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that stay, with the columns of docs: text without its failing lines, n_chars (where there is one) of that text."""
    kept = docs.withColumn("_judged", F.struct("*"))
    verdict = judged(kept.select(F.col("_judged").alias("row"), F.col("text").alias("body")), "row", "body").filter("kept")
    new = {"text": F.col("clean_text")} | ({"n_chars": F.length("clean_text").cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    return verdict.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))
