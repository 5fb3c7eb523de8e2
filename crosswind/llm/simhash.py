"""SimHash fingerprints of word shingles, and their near pairs by Golay-code fuzzy hashing.

The binary [23, 12, 7] Golay code is perfect: every 23-bit word is within three bits of exactly one codeword. The keys of a
word are the codewords that the word and its 23 neighbours decode to - one key if the word is within two bits of a codeword,
else six - and two words within two bits of each other always share one.

64 bits make segments of 23, 23 and 18 bits. Of at most four errors at least two segments have two or fewer, so two linked
fingerprints share a key in both segments of one of the three pairs of segments: the pair of keys is the join key, and the
whole distance is then verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswind.llm.common import checkpointed, lower_words, slices, spread_join, text_bytes
from crosswind.llm.components import components

SHINGLE = 4
SEED = 42
MAX_ERRORS = 4
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Fingerprints with one key that one task compares; larger sets are split into blocks, and every two blocks compared.
BLOCK = 1 << 16
#: Fingerprints whose keys one task makes.
FAN_OUT = 1 << 14


def fingerprint(text: bytes | str | None) -> int:
    """Bits that are set in over half the shingle hashes; zero without words."""
    words = lower_words(text.encode() if isinstance(text, str) else text or b"")
    if not words:
        return 0
    data = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(data, SEED)
    raw = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts = [0, *(gaps[: len(words) - SHINGLE] + 1).tolist()]
    ends = [*gaps[SHINGLE - 1 :].tolist(), len(data)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(data[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the lower twelve and the upper eleven bits (the syndrome is linear), and the error of each syndrome."""

    def syndrome(w: np.ndarray) -> np.ndarray:
        w = w.copy()
        for bit in range(22, 10, -1):
            w ^= np.where(w >> bit & 1, GENERATOR << (bit - 11), 0).astype(np.int32)
        return w

    one = [1 << k for k in range(23)]
    pairs = [x | y for i, x in enumerate(one) for y in one[:i]]
    triples = [x | y | z for i, x in enumerate(one) for j, y in enumerate(one[:i]) for z in one[:j]]
    errors = np.array([0, *one, *pairs, *triples], np.int32)
    error = np.zeros(1 << 11, np.int32)
    error[syndrome(errors)] = errors
    return syndrome(np.arange(1 << 12, dtype=np.int32)), syndrome(np.arange(1 << 11, dtype=np.int32) << 12), error


def golay_keys(words: np.ndarray) -> np.ndarray:
    """The keys (12-bit codeword numbers) of 23-bit words, in six columns; -1 where a word has one key only."""
    low, high, error = _syndromes()
    words = words.astype(np.int32)

    def decoded(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = error[low[w & 4095] ^ high[w >> 12]]
        return (w ^ e) >> 11, e  # systematic: the upper twelve bits number the codeword

    code, e = decoded(words)
    keys = np.full((len(words), 6), -1, np.int64)
    keys[:, 0] = code
    far = np.flatnonzero(np.bitwise_count(e.view(np.uint32)) == 3)
    if len(far):
        near = np.sort(np.stack([decoded(words[far] ^ np.int32(1 << k))[0] for k in range(23)], axis=1), axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        keys[far] = near[new].reshape(-1, 6)  # each of them has exactly six
    return keys


def _segment_keys(bits: np.ndarray) -> list[np.ndarray]:
    return [golay_keys(((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int32)) for at, n in SEGMENTS]


def join_keys(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (index into bits, join key): which pair of segments, and the key of either."""
    segments, rows, found = _segment_keys(bits), [], []
    for k, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        x, y = segments[a], segments[b]
        pair = (k << 24 | x[:, :, None] << 12 | y[:, None, :]).reshape(len(bits), -1)
        row, col = np.nonzero(((x[:, :, None] >= 0) & (y[:, None, :] >= 0)).reshape(len(bits), -1))
        rows.append(row)
        found.append(pair[row, col])
    return np.concatenate(rows), np.concatenate(found)


def _segment_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """segment and n: how many of a task's fingerprints have each key of each segment, as k << 12 | key."""
    total = np.zeros(len(SEGMENTS) << 12, np.int64)
    for batch in slices(batches, 8192):
        for k, keys in enumerate(_segment_keys(batch.column(0).to_numpy().view(np.uint64))):
            total += np.bincount((k << 12) + keys[keys >= 0], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["segment", "n"])


def hot_segments(bits: DataFrame) -> np.ndarray:
    """For each segment and key, whether more than BLOCK fingerprints have it: only pairs of such keys can be of as many."""
    counts = bits.select("bits").mapInArrow(_segment_counts, "segment long, n long").groupBy("segment").agg(F.sum("n").alias("n"))
    hot = np.zeros(len(SEGMENTS) << 12, bool)
    hot[[r.segment for r in counts.filter(F.col("n") > BLOCK).collect()]] = True
    return hot


def both_hot(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which join keys are of two segment keys that are hot."""
    first, second = np.array([0, 0, 1])[keys >> 24], np.array([1, 2, 2])[keys >> 24]
    return hot[first << 12 | keys >> 12 & 4095] & hot[second << 12 | keys & 4095]


def spanning(bits: np.ndarray) -> list[tuple[int, int]]:
    """Edges, at most one for each fingerprint, that connect what links of MAX_ERRORS or fewer connect.

    Each fingerprint reached takes in what it links to among those not yet reached, so a dense set takes few passes.
    """
    edges, rest = [], bits
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            near = np.bitwise_count(rest ^ at) <= MAX_ERRORS
            if near.any():
                got, rest = rest[near], rest[~near]
                edges += [(at, x) for x in got]
                todo += list(got)
    return edges


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges within each run of rows of one key, from rows sorted by key; a key may go on in the next batch."""
    kept_key, kept_bits = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in _with_end(batches):
        if batch is not None:
            key = np.concatenate([kept_key, batch.column(0).to_numpy()])
            bits = np.concatenate([kept_bits, batch.column(1).to_numpy().view(np.uint64)])
            other = np.flatnonzero(key != key[-1]) if len(key) else []
            cut = other[-1] + 1 if len(other) else 0
        else:
            key, bits, cut = kept_key, kept_bits, len(kept_key)
        kept_key, kept_bits, key, bits = key[cut:], bits[cut:], key[:cut], bits[:cut]
        if not len(key):
            continue
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        a, b = [], []
        large = sizes > 64
        inside = np.repeat(~large, sizes)
        for gap in range(1, int(sizes[~large].max(initial=1))):
            left = np.flatnonzero((key[gap:] == key[:-gap]) & inside[gap:])
            left = left[np.bitwise_count(bits[left] ^ bits[left + gap]) <= MAX_ERRORS]
            a.append(bits[left])
            b.append(bits[left + gap])
        for start, size in zip(starts[large], sizes[large]):
            if edges := spanning(np.unique(bits[start : start + size])):
                x, y = zip(*edges)
                a.append(np.array(x, np.uint64))
                b.append(np.array(y, np.uint64))
        if a and (n := sum(map(len, a))):
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0) if n else np.empty((0, 2), np.uint64)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64))], ["a", "b"])


def _with_end(batches):
    yield from batches
    yield None


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and bits (the fingerprint as a signed long) of every row; row-wise, no shuffle. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            bits = np.array([fingerprint(x) for x in text_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], [id_col, "bits"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(run, f"{id_col} {dict(rows.dtypes)[id_col]}, bits long")


def links(bits: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints that connect all that links of MAX_ERRORS or fewer bits connect.

    bits: a column ``bits``, each value once. Keys of more than BLOCK fingerprints are dealt to every two of their blocks, so that
    no task holds more than two blocks. Such keys are counted first, among those of two segment keys that each have as many.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8192):
            values = batch.column(0).to_numpy().view(np.uint64)
            rows, keys = join_keys(values)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values[rows].view(np.int64))], ["key", "bits"])

    def link(rows: DataFrame, *by: str) -> DataFrame:
        dealt = rows.repartition(*by).sortWithinPartitions(*by)
        return dealt.select(F.xxhash64(*by).alias("key") if len(by) > 1 else F.col("key"), "bits").mapInArrow(_link_batches, "a long, b long")

    n = bits.count()
    # each fingerprint becomes some 60 rows of 16 bytes: a task's share of them is FAN_OUT fingerprints, whatever a shuffle would merge
    keys = bits.repartition(max(1, -(-n // FAN_OUT)), "bits").mapInArrow(keyed, "key long, bits long")
    if n <= BLOCK:
        return link(keys, "key")
    often = hot_segments(bits)
    if not often.any():
        return link(keys, "key")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(both_hot(batch.column(0).to_numpy(), often)))], ["key"])

    sizes = keys.select("key").mapInArrow(counted, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    large = checkpointed(sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK)))
    if large.isEmpty():
        return link(keys, "key")
    rest = keys.join(large.select("key"), "key", "left_anti")
    hot = keys.join(large, "key").withColumn("own", F.pmod(F.xxhash64("bits"), "blocks"))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "bits")
    return link(rest, "key").union(link(hot, "key", "x", "y"))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, bits and component_id (the smallest id that links reach, its own included) of every row.

    Equal fingerprints count once in the search, with the smallest of their ids; hot ones are thus met before any join. Null
    ids take part but are never a component's id unless all of it is null; repeated rows stay. An empty table gives none.
    """
    rows = checkpointed(fingerprints(docs, id_col, text_col))
    once = checkpointed(rows.groupBy("bits").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("copies")))
    parts = components(links(once.select("bits")))
    named = once.join(parts.withColumnRenamed("node", "bits"), "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    named = checkpointed(named)
    least = checkpointed(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    sizes = checkpointed(spread_join(named.select("bits", "component", "copies"), least, "component", "n", F.col("bits")).select("bits", "component_id", "copies"))
    return spread_join(rows, sizes, "bits", "copies", F.xxhash64(id_col)).select(id_col, "bits", "component_id")


def document_groups(docs: DataFrame) -> DataFrame:
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents whose id is their component's, with the columns of docs; of rows that repeat an id all stay or go.
    Documents without an id stay."""
    keep = grouped(docs).filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").select(*docs.columns).union(docs.filter("doc_id IS NULL"))
