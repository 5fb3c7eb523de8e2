"""Multiple testing and overfitting statistics.

Adjustments and moments are DataFrame aggregates over whole families. What works on the small matrix of one return per bar and
factor - bootstraps, combinatorial splits - takes that matrix (bars by factors) as numpy, collected once per family.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb, e, exp, isnan, lgamma, log, nan, sqrt
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252
EULER = 0.5772156649015329
_NORMAL = NormalDist()


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = exp(a * log(x) + b * log(1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b)) / a
    c, d = 1.0, 1 / max(1e-300, abs(1 - (a + b) * x / (a + 1))) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    h = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + k * d) or 1e-300)
            c = (1 + k / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def ic_pvalue(t: float | None, n: int) -> float:
    """Two-sided p of a t statistic with n - 1 degrees of freedom."""
    if t is None or isnan(t) or n < 2:
        return nan
    v = n - 1
    return incomplete_beta(v / 2, 0.5, v / (v + t * t))


def benjamini_hochberg(p: DataFrame, alpha: float = 0.05, family: str = "family", order: str = "factor_id") -> DataFrame:
    """p (family, factor_id, p) with rank, p_fdr and fdr_reject; a missing p counts as 1."""
    by = Window.partitionBy(family)
    rows = p.withColumn("p", F.coalesce(F.nanvl("p", F.lit(1.0)), F.lit(1.0)))
    rows = rows.withColumns({"rank": F.row_number().over(by.orderBy("p", order)), "_m": F.count(F.lit(1)).over(by)})
    up = F.min(F.col("p") * F.col("_m") / F.col("rank")).over(by.orderBy("rank").rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("p_fdr", F.least(up, F.lit(1.0)))
    return rows.withColumn("fdr_reject", F.col("p_fdr") <= alpha).drop("_m")


def holm(p: DataFrame, alpha: float = 0.05, family: str = "family", order: str = "factor_id") -> DataFrame:
    """p with rank, p_holm and holm_reject."""
    by = Window.partitionBy(family)
    rows = p.withColumn("p", F.coalesce(F.nanvl("p", F.lit(1.0)), F.lit(1.0)))
    rows = rows.withColumns({"rank": F.row_number().over(by.orderBy("p", order)), "_m": F.count(F.lit(1)).over(by)})
    down = F.max(F.col("p") * (F.col("_m") - F.col("rank") + 1)).over(by.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("p_holm", F.least(down, F.lit(1.0)))
    return rows.withColumn("holm_reject", F.col("p_holm") <= alpha).drop("_m")


def return_moments(returns: DataFrame, value: str = "ls", keys: tuple[str, ...] = ("factor_id",)) -> DataFrame:
    """n, sr (per period), skew and kurt (population, not excess) of each factor's returns: all that a deflated Sharpe ratio needs."""
    x = F.col(value)
    return returns.groupBy(*keys).agg(F.count(x).alias("n"), F.try_divide(F.avg(x), F.stddev_samp(x)).alias("sr"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt"))


def expected_max_sharpe(n_trials: int, variance: float) -> float:
    if n_trials <= 1 or not variance > 0:
        return 0.0
    z = _NORMAL.inv_cdf
    return sqrt(variance) * ((1 - EULER) * z(1 - 1 / n_trials) + EULER * z(1 - 1 / (n_trials * e)))


def deflated_sharpe(n: int, sr: float | None, skew: float | None, kurt: float | None, n_trials: int, sr_variance: float | None = None) -> float:
    """Probability that the Sharpe ratio is above what the best of n_trials without skill would have."""
    if n < 3 or sr is None or skew is None or kurt is None or isnan(sr):
        return nan
    inside = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    if inside <= 0:
        return nan
    se = sqrt(inside / (n - 1))
    return _NORMAL.cdf((sr - expected_max_sharpe(n_trials, se * se if sr_variance is None else sr_variance)) / se)


def array_split(n: int, k: int) -> list[tuple[int, int]]:
    """Bounds of k parts of 0..n-1; the first n % k have one more."""
    out, at = [], 0
    for i in range(k):
        size = n // k + (i < n % k)
        out.append((at, at + size))
        at += size
    return out


def fold_of(row, n, k: int):
    """Column: which of k parts row number ``row`` (from 0) of n is in."""
    b, r = F.floor(n / F.lit(k)), n % k
    return F.when(row < r * (b + 1), F.floor(row / (b + 1))).otherwise(r + F.floor((row - r * (b + 1)) / F.greatest(b, F.lit(1)))).cast("int")


def purged_folds(n: int, k: int = 5, horizon: int = 1, embargo: int = 0) -> list[tuple[list[int], list[int]]]:
    """(train, test) indices: training keeps away from a test part by the horizon before and horizon + embargo after."""
    return [([*range(0, max(0, a - horizon)), *range(min(n, b + horizon + embargo), n)], list(range(a, b))) for a, b in array_split(n, k) if b > a]


def cpcv_splits(n: int, groups: int = 6, tests: int = 2, horizon: int = 1, embargo: int = 0) -> list[tuple[list[int], list[int]]]:
    parts, out = array_split(n, groups), []
    for chosen in combinations(range(groups), tests):
        test = [i for g in chosen for i in range(*parts[g])]
        banned = {i for g in chosen for i in range(parts[g][0] - horizon, parts[g][1] + horizon + embargo)}
        out.append(([i for i in range(n) if i not in banned], test))
    return out


def n_backtest_paths(groups: int, tests: int) -> int:
    return comb(groups, tests) * tests // groups


def _sharpes(m: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        sd = m.std(axis=0, ddof=1) if len(m) > 1 else np.full(m.shape[1], nan)
        return np.where(sd > 0, m.mean(axis=0) / sd, nan)


def _overfit(pairs) -> tuple[float, list[float]]:
    """Share of splits in which the best in sample is in the lower half out of sample, and the logits."""
    logits = []
    for train, test in pairs:
        inside, outside = _sharpes(train), _sharpes(test)
        if len(train) < 2 or len(test) < 2 or np.isnan(inside).all() or np.isnan(outside).all():
            continue
        best = int(np.nanargmax(inside))
        rank = (outside <= outside[best]).sum() / (len(outside) + 1)
        rank = min(max(rank, 1e-6), 1 - 1e-6)
        logits.append(log(rank / (1 - rank)))
    return (float(np.mean([x <= 0 for x in logits])) if logits else nan), logits


def pbo_cscv(m: np.ndarray, n_splits: int = 10) -> tuple[float, list[float]]:
    """Probability of backtest overfitting over all ways to take half of the blocks."""
    splits = min(n_splits, len(m)) // 2 * 2
    if splits < 2 or m.shape[1] < 2:
        return nan, []
    parts = array_split(len(m), splits)
    rows = lambda chosen: np.concatenate([m[a:b] for a, b in (parts[g] for g in chosen)])
    return _overfit((rows(c), rows([g for g in range(splits) if g not in c])) for c in combinations(range(splits), splits // 2))


def pbo_cpcv(m: np.ndarray, groups: int = 6, tests: int = 2, horizon: int = 1, embargo: int = 0) -> tuple[float, list[float]]:
    if m.shape[1] < 2:
        return nan, []
    return _overfit((m[train], m[test]) for train, test in cpcv_splits(len(m), groups, tests, horizon, embargo))


def block_moments(returns: DataFrame, blocks: int, value: str = "ls") -> DataFrame:
    """n, total and squares by factor and block of time, which is all that combinatorial splits need of any number of rows."""
    times = returns.select("ts").distinct().withColumns({"_row": F.row_number().over(Window.orderBy("ts")) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})
    rows = returns.join(times.select("ts", fold_of(F.col("_row"), F.col("_n"), blocks).alias("block")), "ts")
    return rows.groupBy("factor_id", "block").agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.sum(F.col(value) * F.col(value)).alias("squares"))


def cscv_ranks(returns: DataFrame, blocks: int = 6, value: str = "ls") -> DataFrame:
    """For every way to take half of the blocks: the factor that is best inside, and its rank outside (a share of factors + 1).

    The moments of blocks - factors by blocks rows - are joined to the splits and summed; no bar is read again.
    """
    spark = returns.sparkSession
    half = [(k, b, b in chosen) for k, chosen in enumerate(combinations(range(blocks), blocks // 2)) for b in range(blocks)]
    splits = spark.createDataFrame(half, "split int, block int, inside boolean")
    sums = block_moments(returns, blocks, value).join(F.broadcast(splits), "block").groupBy("split", "inside", "factor_id").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares")))
    mean = F.col("total") / F.col("n")
    sums = sums.withColumn("sr", F.try_divide(mean, F.sqrt((F.col("squares") - F.col("n") * mean * mean) / (F.col("n") - 1))))
    best = sums.filter("inside").groupBy("split").agg(F.max_by("factor_id", "sr").alias("best"))
    outside = sums.filter("not inside").join(best, "split")
    own = F.max(F.when(F.col("factor_id") == F.col("best"), F.col("sr"))).over(Window.partitionBy("split"))
    return outside.withColumn("_own", own).groupBy("split", "best").agg((F.sum((F.col("sr") <= F.col("_own")).cast("int")) / (F.count(F.lit(1)) + 1)).alias("rank"))


@dataclass(frozen=True)
class PathDistribution:
    n_paths: int
    median: float
    p05: float
    p95: float
    frac_positive: float


def cpcv_paths(returns: np.ndarray, groups: int = 6, tests: int = 2) -> PathDistribution:
    """Annualised Sharpe ratios over the test rows of every split."""
    s = np.array([_sharpes(returns[test][:, None])[0] * sqrt(YEAR) for _, test in cpcv_splits(len(returns), groups, tests)])
    s = s[~np.isnan(s)]
    if not len(s):
        return PathDistribution(0, nan, nan, nan, nan)
    return PathDistribution(len(s), float(np.median(s)), float(np.percentile(s, 5)), float(np.percentile(s, 95)), float((s > 0).mean()))


def _blocks(n: int, block: int | None, n_boot: int, rng) -> np.ndarray:
    block = block or max(1, round(n ** (1 / 3)))
    starts = rng.integers(0, n, size=(n_boot, -(-n // block)))
    return ((starts[:, :, None] + np.arange(block)) % n).reshape(n_boot, -1)[:, :n]


@dataclass(frozen=True)
class Interval:
    estimate: float
    low: float
    high: float


def block_bootstrap(x, statistic="mean", block: int | None = None, n_boot: int = 1000, level: float = 0.95, seed: int = 0) -> Interval:
    """Percentile interval from circular blocks. statistic: mean, sharpe (of a period), or a function of an array."""
    x = np.asarray(x, float)
    x = x[~np.isnan(x)]
    f = {"mean": np.mean, "sharpe": lambda a: _sharpes(a[:, None])[0]}.get(statistic, statistic)
    if len(x) < 3:
        return Interval(nan, nan, nan)
    drawn = [f(x[i]) for i in _blocks(len(x), block, n_boot, np.random.default_rng(seed))]
    return Interval(float(f(x)), float(np.nanpercentile(drawn, 50 * (1 - level))), float(np.nanpercentile(drawn, 50 * (1 + level))))


def _complete(m) -> np.ndarray:
    m = np.asarray(m, float)
    return m[~np.isnan(m).any(axis=1)]


def reality_check(m, n_boot: int = 1000, block: int | None = None, seed: int = 0) -> float:
    """White's p: is the best mean return more than luck?"""
    m = _complete(m)
    if len(m) < 3:
        return nan
    mean, root = m.mean(axis=0), sqrt(len(m))
    drawn = np.array([root * (m[i].mean(axis=0) - mean).max() for i in _blocks(len(m), block, n_boot, np.random.default_rng(seed))])
    return float((drawn >= root * mean.max()).mean())


def superior_ability(m, n_boot: int = 1000, block: int | None = None, seed: int = 0) -> float:
    """Hansen's p, studentised, with models that are clearly worse set aside."""
    m = _complete(m)
    if len(m) < 3:
        return nan
    mean, root, sd = m.mean(axis=0), sqrt(len(m)), m.std(axis=0, ddof=1)
    sd = np.where(sd > 0, sd, nan)
    z = root * mean / sd
    stat = max(0.0, float(np.nanmax(z))) if not np.isnan(z).all() else nan
    kept = np.where(z >= -sqrt(2 * max(log(log(len(m))), 1e-6)), mean, 0.0)
    drawn = np.array([max(0.0, float(np.nanmax(root * (m[i].mean(axis=0) - kept) / sd))) for i in _blocks(len(m), block, n_boot, np.random.default_rng(seed))])
    return float((drawn >= stat).mean())
