"""Bars from a stream of trades. The engine itself is batch; this feeds it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(trades: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """ts, symbol and fields of each window, emitted once the watermark has passed it; trades: time, symbol, price, quantity.

    Works on a batch or a streaming frame. Ties of time within a bar go by price and quantity.
    """
    place = F.struct("time", "price", "quantity")
    cells = trades.withWatermark("time", late).groupBy(F.window("time", width).alias("w"), "symbol").agg(
        F.min_by("price", place).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", place).alias("close"),
        F.sum("quantity").alias("volume"), F.try_divide(F.sum(F.col("price") * F.col("quantity")), F.sum("quantity")).alias("vwap"),
    )
    return cells.select(F.col("w.start").alias("ts"), "symbol", "open", "high", "low", "close", "volume", "vwap")
