"""Line dedup by winnowing, in DataFrame functions only.

A document's lines with something in them are hashed. Of every window of ``MIN_RUN`` consecutive lines the one with the largest
hash (the last of equal ones) is selected; a line that several windows select is one position. Two equal runs of MIN_RUN lines
or more select lines at the same places of either, so positions are joined on the hash of their line, and a hash with a single
position goes out before anything else is made of it. What is left is extended both ways over the neighbouring lines: each
window that selected the position is compared, line by line with 128 bits a line, with those of the other positions. A window
that stands earlier too, by (id, place), is a repeat; repeated windows side by side add up to the whole of a later repeated run,
whose lines are deleted. Where ``long_words`` is given, one or two consecutive lines of so many words together are windows of
their own size besides, so that a long passage on few lines is a run by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswind.llm.common import checkpointed, spread_join
from crosswind.llm.quality import let

MIN_RUN = 3
BLANKS = " \t\r\x0b\x0c"


def line_digests(text: Column, counted: bool = False) -> Column:
    """h and more, 64 bits each, of every line with something in it, blanks at either end aside; words, their number, if counted."""
    full = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")
    words = lambda x: [F.size(F.split(x, f"[{BLANKS}]+")).alias("words")] if counted else []
    return F.transform(full, lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit("more"), x).alias("more"), *words(x)))


def _chosen(part: Column) -> Column:
    """Which place of a window is selected, from 0."""
    return F.array_max(F.transform(part, lambda x, i: F.struct(x["h"].alias("h"), i.alias("i"))))["i"]


def _has_words(part: Column, run: int, least: int) -> Column:
    """Whether a window is one of run lines with least words in all."""
    return (F.size(part) == run) & (F.aggregate(part, F.lit(0), lambda n, x: n + x["words"]) >= least)


def positions(lines: Column, run: int, least: int | None = None) -> Column:
    """The selected lines of an array of digests, each once: print (the hash), place, and around, the lines up to run - 1 before
    and behind it, of which left stand before. Fewer lines than run, but not none, are one window; with least only windows of run
    lines and so many words are, and the print is not that of another run."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(lines) - run, F.lit(0)))
    if least is not None:
        starts = F.filter(starts, lambda start: _has_words(F.slice(lines, start + 1, F.lit(run)), run, least))
    places = F.transform(starts, lambda start: start + _chosen(F.slice(lines, start + 1, F.lit(run))))

    def position(place: Column) -> Column:
        left, h = F.least(place, F.lit(run - 1)), F.get(lines, place)["h"]
        return F.struct((h if least is None else F.xxhash64(h, F.lit(run))).alias("print"), place.alias("place"), left.alias("left"), F.slice(lines, place - left + 1, left + run).alias("around"), F.lit(run).alias("run"))

    return F.transform(F.array_distinct(places), position)


def windows_through(place: Column, left: Column, around: Column, run: int, least: int | None = None) -> Column:
    """The windows that selected a position, told from the lines around it: start and window, all their digests in one."""
    size = F.least(F.lit(run), F.size(around))

    def window(begin: Column) -> Column:
        part = F.slice(around, begin + 1, size)
        own = begin + _chosen(part) == left
        return F.struct((place - left + begin).alias("start"), F.md5(F.concat_ws(",", F.transform(part, lambda x: F.concat_ws(" ", x["h"].cast("string"), x["more"].cast("string"))))).alias("window"), (own if least is None else own & _has_words(part, run, least)).alias("own"))

    every = F.transform(F.sequence(F.lit(0), F.least(left, F.size(around) - size)), window)
    return F.filter(every, lambda x: x["own"])


def repeats(docs: DataFrame, run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = None) -> DataFrame:
    """id, body (the text's hash) and starts, the places among a document's full lines at which a window starts that stands earlier
    too, each with the window's run."""
    text = F.col(text_col)
    runs = [(run, None)] + [(k, long_words) for k in range(1, run) if long_words is not None]
    every = lambda lines: F.concat(*(positions(lines, k, least) for k, least in runs))
    rows = docs.filter(text.isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("body"), let(line_digests(text, long_words is not None), lambda lines: F.when(F.size(lines) > 0, every(lines))).alias("found"))
    rows = checkpointed(rows.select("id", "body", F.explode("found").alias("p")).select("id", "body", "p.*"))
    prints = rows.groupBy("print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    joined = spread_join(rows, checkpointed(prints), "print", "n", F.xxhash64("id", "place"))
    through = F.coalesce(*(F.when(F.col("run") == k, windows_through(F.col("place"), F.col("left"), F.col("around"), k, least)) for k, least in runs))
    windows = joined.select("id", "body", "run", F.explode(through).alias("w")).select("id", "body", "w.start", "run", F.concat_ws(":", "run", "w.window").alias("window"))
    windows = checkpointed(windows)
    first = windows.groupBy("window").agg(F.min(F.struct("id", "body", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = spread_join(windows, checkpointed(first), "window", "n", F.xxhash64("id", "start")).filter(F.struct("id", "body", "start") > F.col("first"))
    return later.groupBy("id", "body").agg(F.collect_set(F.struct("start", "run")).alias("starts"))


def deduplicated(docs: DataFrame, run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = None) -> DataFrame:
    """All columns of docs, the text without later repeated runs, and n_lines and n_removed (lines with something in them).

    A run is one of ``run`` lines or more, or, where long_words is given, of fewer with so many words together. A document of
    fewer lines than run is held against others of just these lines.

    Lines are equal if they are after trimming blanks. Lines without anything else stay. A null text stays null, an empty one
    empty, an empty table gives no rows. Rows equal in id and text are one document; a null id comes before all others. An
    n_lines or n_removed of the input is replaced; other columns may have any name and stay as they are. A document's work is
    linear in its lines.
    """
    found = repeats(docs, run, id_col, text_col, long_words)
    whole = docs.select(F.struct(*docs.columns).alias("row"))
    key = F.struct(F.col(f"row.{id_col}").alias("id"), F.xxhash64(f"row.{text_col}").alias("body"))
    rows = whole.withColumn("key", key).join(found.select(F.struct("id", "body").alias("key"), "starts"), "key", "left")
    text = F.col("row")[text_col]
    rows = rows.withColumn("lines", F.split(text, "\n")).withColumn("full", F.filter(F.transform("lines", lambda x, i: F.when(F.btrim(x, F.lit(BLANKS)) != "", i)), lambda i: i.isNotNull()))
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.slice("full", s["start"] + 1, s["run"]))))
    rows = rows.withColumn("gone", F.coalesce(gone, F.array().cast("array<int>")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.when(F.size("gone") == 0, text).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    new = {text_col: left, "n_lines": F.coalesce(F.size("full"), F.lit(0)).cast("long"), "n_removed": F.size("gone").cast("long")}
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    return rows.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in names))


#: Words that make a passage in a corpus, whatever number of lines it has.
LONG_WORDS = 50


def cleaned(docs: DataFrame) -> DataFrame:
    """The columns of docs, with text deduplicated and n_chars, where there is one, counted anew. Repeated runs of MIN_RUN lines
    go, and those of fewer lines with LONG_WORDS words."""
    rows = deduplicated(docs, long_words=LONG_WORDS)
    extra = [c for c in ("n_lines", "n_removed") if c in docs.columns]
    if extra:  # columns of the input's own
        inner = docs.select("doc_id", "text", F.struct(*docs.columns).alias("whole"))
        rows = deduplicated(inner, long_words=LONG_WORDS).select("text", *(F.col("whole")[c].alias(c) for c in docs.columns if c != "text"))
    return rows.select(*(F.coalesce(F.length("text"), F.lit(0)).cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes))
