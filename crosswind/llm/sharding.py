"""Shards by a keyed permutation of global row numbers.

A Feistel network over the smallest power of two that holds all row numbers, walked along its cycle until it falls below the
row count, permutes 0..N-1 without a table: ``shard_slot`` computes a row's place and ``row_at`` the row at a place, both
from (number, N, shards, seed) alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 8
#: Buckets in which rows are numbered; their sizes are all that reaches the driver.
BUCKETS = 1024


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A finaliser of 64 bits: two rounds of xor-shift and multiply (wrapping)."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [int(_mix(np.array([r], dtype=np.uint64), (seed * 0x9E3779B97F4A7C15 + 1) % 2**64)[0]) for r in range(ROUNDS)]


def _network(x: np.ndarray, bits: int, keys: list[int], back: bool) -> np.ndarray:
    """One pass over [0, 2**bits): the halves, of bits//2 and the rest, are mixed into each other in turn."""
    low = bits // 2
    low_mask, high_mask = np.uint64((1 << low) - 1), np.uint64((1 << (bits - low)) - 1)
    a, b = x >> np.uint64(low), x & low_mask
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if r % 2:
            b = b ^ (_mix(a, keys[r]) & low_mask)
        else:
            a = a ^ (_mix(b, keys[r]) & high_mask)
    return (a << np.uint64(low)) | b


def permute(numbers: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The place of each row number in the shuffled order of n rows; with back, the row number at each place."""
    x, bits, keys = numbers.astype(np.uint64), max(1, (n - 1).bit_length()), _keys(seed)
    x = _network(x, bits, keys, back)
    while (out := x >= n).any():
        x[out] = _network(x[out], bits, keys, back)
    return x.astype(np.int64)


def shard_slot(number: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    place = int(permute(np.array([number]), n, seed)[0])
    return place % shards, place // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def numbered(df: DataFrame, by: list[str], number: str = "row_number") -> tuple[DataFrame, int]:
    """df's rows of the columns ``by`` with gapless global row numbers from 0, and their count.

    Rows are dealt to buckets by a hash of all of ``by``, counted per bucket, and numbered in a bucket in the order of ``by``.
    Equal rows are first counted into one, so that no key, however common, fills a bucket, and take consecutive numbers.
    """
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(BUCKETS)))
    counts = dict(rows.groupBy("_bucket").agg(F.sum("_copies")).collect())  # a row for each bucket at most
    starts, n = [], 0
    for k in range(BUCKETS):
        starts.append(n)
        n += counts.get(k, 0)
    before = F.sum("_copies").over(Window.partitionBy("_bucket").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_copies")
    offset = F.element_at(F.lit(starts).cast("array<bigint>"), (F.col("_bucket") + 1).cast("int"))
    rows = rows.withColumn("_before", before).withColumn("_first", offset + F.col("_before"))
    return rows.select(*by, F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_copies") - 1)).alias(number)), n


def assign(df: DataFrame, by: list[str], shards: int = 8, seed: int = 20) -> DataFrame:
    """Columns ``by`` of each row with row_number, place, shard and slot.

    Shard sizes differ by one row at most and slots are gapless from 0. Null values in ``by`` are values like others; equal
    rows get places of their own; an empty table gives an empty result.
    """
    rows, n = numbered(df.select(*by), by)

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    rows = rows.withColumn("place", place("row_number"))
    return rows.withColumns({"shard": (F.col("place") % shards).cast("int"), "slot": F.floor(F.col("place") / shards).cast("long")})


def document_shards(docs: DataFrame, shards: int = 8, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    facts = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign(facts, ["doc_id", "size", "text_crc32"], shards, seed)
