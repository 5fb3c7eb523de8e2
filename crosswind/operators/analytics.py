"""What scores are worth: information coefficients, quantile portfolios, turnover, costs and capacity.

Scores are long frames (factor_id, ts, symbol, sym_ord, score, fwd); every measure covers all factors in one plan. Statistics
are annualised by the square root of 252, whatever the bars.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from math import inf, isnan, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosswind.functions.kernels import average_rank, over_symbol, over_time

YEAR = 252
FACTOR = ("factor_id",)


def correlation(x: Column, y: Column) -> Column:
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def sharpe(x: Column) -> Column:
    return F.try_divide(F.avg(x), F.stddev_samp(x)) * sqrt(YEAR)


def ic_series(scores: DataFrame, method: str = "pearson", fwd: str = "fwd", keys: tuple[str, ...] = FACTOR) -> DataFrame:
    """ic of each timestamp with three pairs at least; undefined ones are dropped."""
    pairs = scores.filter(F.col("score").isNotNull() & F.col(fwd).isNotNull()).select(*keys, "ts", F.col("score").alias("x"), F.col(fwd).alias("y"))
    if method == "spearman":
        pairs = pairs.withColumns({c: average_rank(F.col(c), *keys, "ts") for c in "xy"})
    rows = pairs.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("n"), correlation(F.col("x"), F.col("y")).alias("ic"))
    return rows.filter((F.col("n") >= 3) & F.col("ic").isNotNull()).select(*keys, "ts", "ic")


def ic_stats(ics: DataFrame, keys: tuple[str, ...] = FACTOR) -> DataFrame:
    """n, mean_ic, std_ic, ic_ir, t_stat and hit_rate (share of the mean's sign) of each factor."""
    means = ics.withColumn("m", F.avg("ic").over(Window.partitionBy(*keys)))
    rows = means.groupBy(*keys).agg(F.count("ic").alias("n"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.avg((F.signum(F.round("ic", 12)) == F.signum(F.round("m", 12))).cast("double")).alias("hit"))
    rows = rows.withColumn("ic_ir", F.try_divide("mean_ic", "std_ic"))
    return rows.select(*keys, "n", "mean_ic", "std_ic", "ic_ir", (F.col("ic_ir") * F.sqrt("n")).alias("t_stat"), F.when(F.col("mean_ic") != 0, F.col("hit")).alias("hit_rate"))


def ic_decay(scores: DataFrame, horizons: tuple[int, ...] = (1, 2, 3, 5, 10), keys: tuple[str, ...] = FACTOR) -> DataFrame:
    """mean_ic (Spearman) by horizon; scores has fwd_h for each."""
    rows = scores.select(*keys, "ts", "symbol", "score", F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("fwd")) for h in horizons))).alias("h")).select(*keys, "ts", "symbol", "score", "h.*")
    ics = ic_series(rows, "spearman", keys=(*keys, "horizon"))
    return ics.groupBy(*keys, "horizon").agg(F.avg("ic").alias("mean_ic"))


def quantile_buckets(scores: DataFrame, q: int = 5, keys: tuple[str, ...] = FACTOR) -> DataFrame:
    """scores with bucket 0 to q - 1, ties dealt by symbol order; NULL where a timestamp has fewer than q different scores."""
    w = over_time(keys)
    place = F.row_number().over(w.orderBy(F.col("score").asc_nulls_last(), "sym_ord"))
    new = F.when(F.col("score").isNotNull() & (F.col("_different") >= q), F.ceil((F.col("_place") / F.col("_count")) * F.lit(float(q))) - 1)
    rows = scores.withColumns({"_place": place, "_count": F.count("score").over(w), "_different": F.size(F.collect_set("score").over(w))})
    return rows.withColumn("bucket", new.cast("int")).drop("_place", "_count", "_different")


def quantile_returns(buckets: DataFrame, keys: tuple[str, ...] = FACTOR) -> DataFrame:
    """ret by bucket: the mean over time of each timestamp's mean."""
    each = buckets.filter("bucket IS NOT NULL").groupBy(*keys, "ts", "bucket").agg(F.avg("fwd").alias("r"))
    return each.groupBy(*keys, "bucket").agg(F.avg("r").alias("ret"))


def long_short(buckets: DataFrame, q: int = 5, keys: tuple[str, ...] = FACTOR) -> DataFrame:
    """ls: mean of the top bucket less that of the bottom, for timestamps that have both."""
    side = lambda b: F.avg(F.when(F.col("bucket") == b, F.col("fwd")))
    return buckets.groupBy(*keys, "ts").agg((side(q - 1) - side(0)).alias("ls")).filter("ls IS NOT NULL")


def turnover(buckets: DataFrame, q: int = 5, keys: tuple[str, ...] = FACTOR) -> DataFrame:
    """Mean share of the top bucket that is gone a bar later, over bars after a non-empty one."""
    top = F.coalesce(F.col("bucket") == q - 1, F.lit(False))
    rows = buckets.withColumn("_top", top).withColumn("_before", F.lag("_top", 1, False).over(over_symbol(keys)))
    each = rows.groupBy(*keys, "ts").agg(F.sum(F.col("_before").cast("int")).alias("had"), F.sum((F.col("_before") & ~F.col("_top")).cast("int")).alias("left"))
    return each.groupBy(*keys).agg(F.avg(F.when(F.col("had") > 0, F.col("left") / F.col("had"))).alias("turnover"))


def score_autocorr(scores: DataFrame, lag: int = 1, keys: tuple[str, ...] = FACTOR) -> DataFrame:
    rows = scores.withColumn("_before", F.lag("score", lag).over(over_symbol(keys))).filter("score IS NOT NULL AND _before IS NOT NULL")
    each = rows.groupBy(*keys, "ts").agg(correlation(F.col("score"), F.col("_before")).alias("c"))
    return each.groupBy(*keys).agg(F.avg("c").alias("autocorr"))


@dataclass(frozen=True)
class CostModel:
    """Commission and half-spread in basis points of turnover, square-root impact, and borrow a year."""

    commission_bps: float = 1.0
    half_spread_bps: float = 2.0
    impact: float = 0.1
    borrow_bps: float = 50.0
    daily_vol: float = 0.02

    def fixed(self, turnover):
        return (self.commission_bps + self.half_spread_bps) / 1e4 * turnover + self.borrow_bps / 1e4 / YEAR

    def per_period_cost(self, turnover: float, participation: float = 0.0, daily_vol: float | None = None) -> float:
        vol = self.daily_vol if daily_vol is None else daily_vol
        return self.fixed(turnover) + self.impact * vol * sqrt(max(0.0, participation)) * turnover


def capacity(gross: float, adv: list[float], vol: list[float], turnover: float, positions: int, model: CostModel = CostModel()) -> float:
    """Assets at which the cost takes all of the gross return of a period.

    The impact grows with the square root of assets, cost = fixed + c * sqrt(assets), so the answer is ((gross - fixed) / c)^2.
    """
    fixed = model.fixed(turnover)
    if not gross > 0 or fixed >= gross:
        return 0.0
    if turnover == 0 or not adv or any(isnan(v) for v in vol):
        return inf
    if any(not a > 0 for a in adv):
        return 0.0
    c = sum(model.impact * v * sqrt(turnover / positions / a) for a, v in zip(adv, vol)) / len(adv) * turnover
    return inf if c == 0 else ((gross - fixed) / c) ** 2


def cost_sensitivity(stats: DataFrame, levels: tuple[float, ...] = (0.0, 5.0, 10.0, 20.0)) -> DataFrame:
    """Net Sharpe ratio by cost in basis points, from gross (mean of a period), turnover (0.5 where it is undefined) and ann_vol."""
    rows = stats.withColumn("bps", F.explode(F.array(*map(F.lit, map(float, levels)))))
    return rows.withColumn("net_sharpe", F.try_divide((F.col("gross") - F.col("bps") / 1e4 * F.coalesce("turnover", F.lit(0.5))) * YEAR, F.col("ann_vol")))


def adv_profile(panel: DataFrame, bars: int = 63) -> DataFrame:
    """adv (median of volume * close) and vol (of padded returns) of each symbol over the last bars of the panel."""
    recent = panel.select("ts").distinct().orderBy(F.desc("ts")).limit(bars)
    rows = panel.withColumn("_known", F.last("close", ignorenulls=True).over(over_symbol()))
    rows = rows.withColumn("_ret", F.try_divide("_known", F.lag("_known", 1).over(over_symbol())) - 1).join(F.broadcast(recent), "ts")  # at most ``bars`` rows
    return rows.groupBy("symbol").agg(F.median(F.col("volume") * F.col("close")).alias("adv"), F.stddev_samp("_ret").alias("vol"))


def portfolio_stats(scores: DataFrame, q: int = 5, cost_bps: float = 5.0, model: CostModel | None = None, keys: tuple[str, ...] = FACTOR) -> DataFrame:
    """sharpe, ann_return, ann_vol, turnover, spread, monotonicity, gross and sharpe_after_cost of each factor."""
    buckets = quantile_buckets(scores, q, keys)
    ls = long_short(buckets, q, keys)
    base = ls.groupBy(*keys).agg(sharpe(F.col("ls")).alias("sharpe"), F.avg("ls").alias("gross"), F.stddev_samp("ls").alias("_sd"))
    rets = quantile_returns(buckets, keys)
    ranks = rets.withColumn("_rank", average_rank(F.col("ret"), *keys)).groupBy(*keys).agg(correlation(F.col("bucket").cast("double"), F.col("_rank")).alias("monotonicity"), (F.max(F.when(F.col("bucket") == q - 1, F.col("ret"))) - F.max(F.when(F.col("bucket") == 0, F.col("ret")))).alias("spread"))
    rows = base.join(ranks, list(keys), "left").join(turnover(buckets, q, keys), list(keys), "left")
    tau = F.coalesce("turnover", F.lit(0.0))
    cost = model.fixed(tau) if model else F.lit(cost_bps / 1e4) * tau
    return rows.select(*keys, "sharpe", (F.col("gross") * YEAR).alias("ann_return"), (F.col("_sd") * sqrt(YEAR)).alias("ann_vol"), "turnover", "monotonicity", "spread", "gross", (F.try_divide(F.col("gross") - cost, F.col("_sd")) * sqrt(YEAR)).alias("sharpe_after_cost"))


@dataclass(frozen=True)
class PortfolioSpec:
    kind: str = "equal_weight_quantile_long_short"
    quantiles: int = 5
    rebalance: str = "daily"
    gross: float = 1.0

    def to_dict(self) -> dict:
        return asdict(self)


def backtest(scores: DataFrame, q: int = 5, cost_bps: float = 5.0, model: CostModel | None = None, keys: tuple[str, ...] = FACTOR) -> DataFrame:
    """n, total_return, sharpe, max_drawdown, hit_rate and turnover of the long-short portfolio after costs."""
    buckets = quantile_buckets(scores, q, keys)
    rows = long_short(buckets, q, keys).join(turnover(buckets, q, keys), list(keys), "left")
    tau = F.coalesce("turnover", F.lit(0.0))
    rows = rows.withColumn("net", F.col("ls") - (model.fixed(tau) if model else F.lit(cost_bps / 1e4) * tau))
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    # a product from logarithms and the count of signs; once a bar loses all, nothing is left
    growth = 1 + F.col("net")
    equity = F.when(F.min(F.abs(growth)).over(w) == 0, 0.0).otherwise(F.exp(F.sum(F.when(growth != 0, F.log(F.abs(growth)))).over(w)) * F.when(F.sum((growth < 0).cast("int")).over(w) % 2 == 1, -1.0).otherwise(1.0))
    rows = rows.withColumn("equity", equity).withColumn("_fall", F.try_divide("equity", F.max("equity").over(w)) - 1)
    out = rows.groupBy(*keys).agg(F.count("net").alias("n"), F.max_by("equity", "ts").alias("_end"), sharpe(F.col("net")).alias("sharpe"), F.min("_fall").alias("max_drawdown"), F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"), F.first("turnover").alias("turnover"))
    ok = F.col("sharpe").isNotNull()
    return out.select(*keys, "n", F.when(ok, F.col("_end") - 1).alias("total_return"), "sharpe", F.when(ok, F.col("max_drawdown")).alias("max_drawdown"), F.when(ok, F.col("hit_rate")).alias("hit_rate"), "turnover")
