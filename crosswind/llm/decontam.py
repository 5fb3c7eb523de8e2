"""Benchmark decontamination: windows of benchmark words that documents contain, by a prefix-filtered join.

A window is contained only if each of its words is, so its necessary prefix is its rarest word (by count over all documents).
Documents are read twice: once for the counts of benchmark words, once for the places of prefix words with the words around
them. Which words to look for is told by a bit map of fixed size, whatever the benchmark's; the words themselves meet in
joins. A place whose left and right context are long enough for the window is verified word by word.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswind.llm.common import checkpointed, slices, spread_join, text_bytes

WIDTH = 10
#: Bits of the maps of words; more words only make the maps less selective.
MAP_BITS = 22
#: Bytes of words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z; all others become spaces.
WORD_BYTES = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in bytes(range(256)).lower())


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def _bit(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & ((1 << MAP_BITS) - 1)


def _bit_map(rows: DataFrame, column: str) -> bytes:
    """A map of the words in a column; at most 2^MAP_BITS numbers reach the driver."""

    @F.pandas_udf("int")
    def bit(w):
        return w.map(lambda x: _bit(x.encode()))

    bits = np.zeros(1 << MAP_BITS, np.uint8)
    bits[rows.select(bit(column).alias("bit")).distinct().toArrow().column(0).to_numpy()] = 1
    return np.packbits(bits).tobytes()


class _Known:
    """Which words a bit map holds, remembered for words seen lately."""

    def __init__(self, bit_map: bytes):
        self.bits, self.seen = np.unpackbits(np.frombuffer(bit_map, np.uint8)), {}

    def among(self, distinct) -> set[bytes]:
        if len(self.seen) > 500_000:
            self.seen.clear()
        seen, bits = self.seen, self.bits
        found = set()
        for w in distinct:
            known = seen.get(w)
            if known is None:
                known = seen[w] = bool(bits[_bit(w)])
            if known:
                found.add(w)
        return found


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id_col, n and words of every distinct window of each item; an item of fewer than width words, but not none, is one."""

    def run(batches):
        for batch in slices(batches, 256):
            ids, found = [], []
            for i, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                own = words(text)
                for w in {tuple(own[k : k + width]) for k in range(max(1, len(own) - width + 1))} if own else ():
                    ids.append(i)
                    found.append([x.decode() for x in w])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(list(map(len, found)), pa.int32()), pa.array(found, pa.list_(pa.string()))], ["item", "n", "words"])

    rows = items.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(run, f"item {dict(rows.dtypes)[id_col]}, n int, words array<string>")


def _counts(docs: DataFrame, bit_map: bytes) -> DataFrame:
    """word and n over all documents, for words in the bit map; counted per task first."""

    def run(batches):
        known, total = _Known(bit_map), Counter()
        for batch in slices(batches, 256):
            here = Counter(w for x in text_bytes(batch.column(0)) for w in words(x))
            for w in known.among(here):
                total[w] += here[w]
            if len(total) > 200_000:
                yield counted(total)
                total.clear()
        yield counted(total)

    def counted(total):
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n_docs"))


def _places(docs: DataFrame, bit_map: bytes, width: int) -> DataFrame:
    """row, doc_id and n_words of every document, and the places of words in the bit map, each with up to width - 1 words on either side."""

    def run(batches):
        known = _Known(bit_map)
        kind = pa.struct([("word", pa.string()), ("place", pa.int32()), ("left", pa.int32()), ("around", pa.list_(pa.string()))])
        for batch in slices(batches, 256):
            own = [words(x) for x in text_bytes(batch.column(2))]
            look = known.among(set().union(*own))
            found = [[{"word": w.decode(), "place": k, "left": min(k, width - 1), "around": [x.decode() for x in ws[max(0, k - width + 1) : k + width]]} for k, w in enumerate(ws) if w in look] for ws in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(len, own)), pa.int64()), pa.array(found, pa.list_(kind))], ["row", "doc_id", "n_words", "places"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, f"row long, doc_id {dict(rows.dtypes)['doc_id']}, n_words long, places array<struct<word:string,place:int,left:int,around:array<string>>>")


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items and items (the ids, sorted as strings) of every row of docs.

    A document word inside any occurrence of a window is hit. Null and empty texts have no words; items without words have no
    windows; repeated rows are documents of their own. Only doc_id and text (item_id and text) are read.
    """
    windows = checkpointed(item_windows(items, width=width))
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    counts = checkpointed(_counts(docs, _bit_map(vocabulary, "word")))
    windows = windows.withColumn("window", F.array_join("words", " "))
    in_words = windows.select("window", "n", F.posexplode("words").alias("offset", "word")).distinct()
    rarest = in_words.join(counts, "word", "left").groupBy("window", "n").agg(F.min(F.struct(F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "word", "offset")).alias("rarest"))
    # a window with a word that no document has isn't in any
    prefixes = checkpointed(rarest.filter("rarest.n_docs > 0").select("window", "n", F.col("rarest.word").alias("word"), F.col("rarest.offset").alias("offset")))
    places = checkpointed(_places(docs, _bit_map(prefixes, "word"), width))
    spots = places.select("row", F.explode("places").alias("p")).select("row", "p.*")
    sought = checkpointed(prefixes.join(counts, "word").select("word", "window", "n", "offset", "n_docs"))
    near = spread_join(spots, sought, "word", "n_docs", F.xxhash64("row", "place"))
    near = near.filter((F.col("offset") <= F.col("left")) & (F.col("left") - F.col("offset") + F.col("n") <= F.size("around")))
    hits = near.filter(F.array_join(F.slice("around", F.col("left") - F.col("offset") + 1, F.col("n")), " ") == F.col("window")).select("row", (F.col("place") - F.col("offset")).alias("start"), "n", "window")
    hits = checkpointed(hits.distinct())
    covered = F.flatten(F.transform(F.collect_set(F.struct("start", "n")), lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))
    words_hit = hits.groupBy("row").agg(F.size(F.array_distinct(covered)).cast("long").alias("n_hit"))
    found = hits.select("row", "window").distinct().join(windows.select("window", "item"), "window").select("row", "item").distinct()
    found = found.groupBy("row").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    rows = places.select("row", "doc_id", "n_words").join(words_hit, "row", "left").join(found, "row", "left")
    return rows.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def document_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    rows = contamination(docs, items)
    return rows.select("doc_id", "n_words", "n_hit", F.greatest("n_items", F.lit(0)).alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without_benchmark(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a hit, with the columns of docs. Rows that share an id (or lack one) stay or go together."""
    bad = contamination(docs, items).filter("n_hit > 0").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti").select(*docs.columns)
