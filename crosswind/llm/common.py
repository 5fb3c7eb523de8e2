"""What the text operators share."""

from __future__ import annotations

import gc
import os
import time
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset (tests on one machine) a folder under /tmp."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"/tmp/checkpoints/{os.getpid()}")
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared checkpoint folder and read from there: less than a checkpoint takes where values repeat."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Seconds after which that thread is no longer waited for.
FINALIZED_S = 5


def released(spark: SparkSession) -> None:
    """Has the files of shuffles and checkpoints that nothing refers to any more removed now, not when the driver next happens to
    collect its garbage. Python's references to objects of the JVM go by a thread of their own, which is waited for."""
    gc.collect()
    waiting, until = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None), time.monotonic() + FINALIZED_S
    while waiting and time.monotonic() < until:
        time.sleep(0.01)
    spark.sparkContext._jvm.System.gc()


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of an Arrow column of strings; empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def lower_words(text: bytes) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z: bytes know no other letters and split at no other white space."""
    return text.lower().split()


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def space_words(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+``; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def sized_parts(df: DataFrame, bytes_per_part: int = 32 << 20, text: str = "text") -> int:
    """How many partitions give each about bytes_per_part of text, from a pass over the lengths; at least the session's shuffle partitions."""
    total = df.select(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-total // bytes_per_part))


#: A key with more than this share of the rows is dealt to SPREAD tasks; there are fewer than 1 / HOT such keys, whatever the input.
HOT, SPREAD = 1 / 1000, 64


def spread_join(rows: DataFrame, facts: DataFrame, key: str, n: str, by: Column) -> DataFrame:
    """rows joined to facts, which tells for each key in n how many rows have it; ``by`` deals the rows of hot keys.

    The hot keys - fewer than 1 / HOT by definition - are broadcast to mark rows; their facts are repeated for each of SPREAD salts.
    """
    total = facts.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(facts.filter(F.col(n) > F.lit(total * HOT + SPREAD)).select(key, F.lit(True).alias("hot_key")).distinct())
    salted = rows.withColumn("spread_by", by).join(hot, key, "left")
    salted = salted.withColumn("salt", F.when(F.col("hot_key"), F.pmod("spread_by", F.lit(SPREAD))).otherwise(F.lit(0)).cast("int")).drop("hot_key", "spread_by")
    copies = facts.withColumn("salt", F.explode(F.when(F.col(n) > F.lit(total * HOT + SPREAD), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [key, "salt"]).drop("salt")


#: Rows of a few numbers each that are broadcast at most; with more of them a join shuffles.
SMALL_ROWS = 1 << 20


def only(rows: DataFrame, ids: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys are among ids (distinct, numbers only): broadcast up to SMALL_ROWS, shuffled beyond."""
    return rows.join(F.broadcast(ids) if ids.count() <= SMALL_ROWS else ids, list(keys), "left_semi")
