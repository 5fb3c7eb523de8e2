"""From raw scores to the scores that are judged, on long frames (factor_id, ts, symbol, score and more)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswind.functions.kernels import over_symbol, over_time, winsorized, zscored

FACTOR = ("factor_id",)


@dataclass(frozen=True)
class Preprocess:
    min_coverage: float = 0.5
    winsor: float = 0.02
    normalize: bool = True
    neutralize: bool = False
    lag: int = 0


def preprocessed(scores: DataFrame, config: Preprocess = Preprocess(), eligible: DataFrame | None = None, keys: tuple[str, ...] = FACTOR) -> DataFrame:
    """scores after, in this order: eligibility, coverage, winsorising, z-scores, demeaning, lag.

    eligible: (ts, symbol, eligible); cells that it lacks are not. Coverage is of all symbols, eligible or not.
    """
    df, s = scores, F.col("score")
    if eligible is not None:
        df = df.join(eligible.select("ts", "symbol", F.col("eligible").alias("_eligible")), ["ts", "symbol"], "left")
        df = df.withColumn("score", F.when(F.coalesce("_eligible", F.lit(False)), s)).drop("_eligible")
    w = over_time(keys)
    df = df.withColumn("score", F.when(F.count("score").over(w) / F.count(F.lit(1)).over(w) >= config.min_coverage, s))
    by = (*keys, "ts")
    if config.winsor:
        df = df.withColumn("score", winsorized(s, config.winsor, *by))
    if config.normalize:
        df = df.withColumn("score", zscored(s, *by))
    if config.neutralize:
        df = df.withColumn("score", s - F.avg("score").over(w))
    if config.lag:
        df = df.withColumn("score", F.lag("score", config.lag).over(over_symbol(keys)))
    return df


def coverage(scores: DataFrame, keys: tuple[str, ...] = FACTOR) -> DataFrame:
    """Share of symbols with a score, for each timestamp."""
    return scores.groupBy(*keys, "ts").agg((F.count("score") / F.count(F.lit(1))).alias("coverage"))
