"""Does a factor hold across time, regimes and parameters?"""

from __future__ import annotations

from dataclasses import dataclass
from math import nan

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosswind.functions.kernels import over_symbol, trailing
from crosswind.operators.analytics import ic_series, sharpe
from crosswind.operators.stats import fold_of

FACTOR = ("factor_id",)


def _numbered(ics: DataFrame, keys=FACTOR) -> DataFrame:
    w = Window.partitionBy(*keys)
    return ics.withColumns({"_row": F.row_number().over(w.orderBy("ts")) - 1, "_n": F.count(F.lit(1)).over(w)})


def subperiods(ics: DataFrame, k: int = 4, keys: tuple[str, ...] = FACTOR) -> DataFrame:
    """fold, n and mean_ic of k consecutive parts of each factor's ICs."""
    rows = _numbered(ics, keys).withColumn("fold", fold_of(F.col("_row"), F.col("_n"), k))
    return rows.groupBy(*keys, "fold").agg(F.count("ic").alias("n"), F.avg("ic").alias("mean_ic"))


def stability(folds: DataFrame, keys: tuple[str, ...] = FACTOR) -> DataFrame:
    """mean_ic (over all bars), consistency (share of folds with its sign, a mean of zero counting as positive), worst (the lowest
    fold mean) and stable (a consistency of 0.75 or more, and a mean other than zero). folds: n and mean_ic of each."""
    rows = folds.withColumn("_all", F.sum(F.col("n") * F.col("mean_ic")).over(Window.partitionBy(*keys)) / F.sum("n").over(Window.partitionBy(*keys)))
    same = F.signum(F.round("mean_ic", 12)) == F.when(F.round("_all", 12) < 0, -1.0).otherwise(1.0)
    out = rows.groupBy(*keys).agg(F.max("_all").alias("mean_ic"), F.avg(same.cast("double")).alias("consistency"), F.min("mean_ic").alias("worst"))
    return out.withColumn("stable", (F.col("consistency") >= 0.75) & (F.col("mean_ic") != 0))


def regime_labels(panel: DataFrame, window: int = 20) -> DataFrame:
    """(ts, vol, regime): the market's rolling volatility, cut at its own thirds over the whole sample into low, mid and high."""
    known = panel.withColumn("_known", F.last("close", ignorenulls=True).over(over_symbol()))
    rets = known.withColumn("_ret", F.try_divide("_known", F.lag("_known", 1).over(over_symbol())) - 1)
    w = trailing(window)
    vols = rets.withColumn("_vol", F.when(F.count("_ret").over(w) == window, F.stddev_samp("_ret").over(w)))
    market = vols.groupBy("ts").agg(F.avg("_vol").alias("vol")).filter("vol IS NOT NULL")
    cuts = market.agg(F.percentile("vol", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("cut"))  # one row
    return market.crossJoin(F.broadcast(cuts)).select("ts", "vol", F.when(F.col("vol") <= F.col("cut")[0], "low").when(F.col("vol") <= F.col("cut")[1], "mid").otherwise("high").alias("regime"))


def regime_ics(ics: DataFrame, labels: DataFrame, keys: tuple[str, ...] = FACTOR) -> DataFrame:
    return ics.join(labels.select("ts", "regime"), "ts", "left").filter("regime IS NOT NULL").groupBy(*keys, "regime").agg(F.count("ic").alias("n"), F.avg("ic").alias("mean_ic"))


def _windowed(ics: DataFrame, n_windows: int, min_train: float, keys: tuple[str, ...]) -> DataFrame:
    """ICs behind the training share of each factor's, with the window each is in."""
    rows = _numbered(ics, keys).withColumn("_skip", F.floor(F.col("_n") * F.lit(min_train)))
    rows = rows.filter(F.col("_row") >= F.col("_skip"))
    return rows.withColumn("window", fold_of(F.col("_row") - F.col("_skip"), F.col("_n") - F.col("_skip"), n_windows)).select(*keys, "ts", "ic", "window")


def walk_forward(ics: DataFrame, n_windows: int = 5, min_train: float = 0.3, keys: tuple[str, ...] = FACTOR, ls: DataFrame | None = None) -> DataFrame:
    """window, n, first and last timestamp and mean_ic of the parts behind the training share of each factor's ICs; with ls (the
    long-short returns) also the sharpe of those at the window's timestamps."""
    rows = _windowed(ics, n_windows, min_train, keys)
    more = []
    if ls is not None:
        rows = rows.join(ls, [*keys, "ts"], "left")
        more = [sharpe(F.col("ls")).alias("sharpe")]
    return rows.groupBy(*keys, "window").agg(F.count("ic").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.avg("ic").alias("mean_ic"), *more)


def walk_forward_summary(ics: DataFrame, ls: DataFrame, n_windows: int = 5, min_train: float = 0.3, keys: tuple[str, ...] = FACTOR) -> DataFrame:
    """n_windows, mean_ic, ic_ir, sign_consistency (share of windows with the sign of the mean), worst_window_ic, sharpe and
    stable (0.75 or more) of each factor out of sample."""
    rows = _windowed(ics, n_windows, min_train, keys).join(ls, [*keys, "ts"], "left")
    total = rows.groupBy(*keys).agg(F.avg("ic").alias("mean_ic"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("ic_ir"), sharpe(F.col("ls")).alias("sharpe"))
    each = rows.groupBy(*keys, "window").agg(F.avg("ic").alias("_ic")).join(total, list(keys))
    same = F.signum(F.round("_ic", 12)) == F.when(F.round("mean_ic", 12) < 0, -1.0).otherwise(1.0)
    out = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_windows"), F.first("mean_ic").alias("mean_ic"), F.first("ic_ir").alias("ic_ir"), F.avg(same.cast("double")).alias("sign_consistency"), F.min("_ic").alias("worst_window_ic"), F.first("sharpe").alias("sharpe"))
    return out.withColumn("stable", F.col("sign_consistency") >= 0.75)


def parameter_sensitivity(panel: DataFrame, template: str, params: tuple[int, ...], horizon: int = 1, preprocess=None) -> dict[int, float]:
    """Mean Pearson IC by the value put for {w}; nan for one that doesn't compile. All values run as one family."""
    from crosswind.operators.preprocess import Preprocess, preprocessed
    from crosswind.plans.compiler import check, family_scores
    from crosswind.plans.language import make_factor
    from crosswind.sources.panels import with_forward

    specs, out = [], {p: nan for p in params}
    for p in params:
        try:
            spec = make_factor(str(p), template.replace("{w}", str(p)))
            check(spec.tree)
        except ValueError:
            continue
        specs.append(spec)
    if specs:
        name = f"fwd_{horizon}"
        scores = preprocessed(family_scores(with_forward(panel, horizon), specs, (name,)), preprocess or Preprocess())
        got = ic_series(scores.withColumn("fwd", F.col(name))).groupBy("factor_id").agg(F.avg("ic").alias("m")).collect()
        out |= {int(r["factor_id"]): float(r["m"]) for r in got}
    return out


@dataclass(frozen=True)
class Sensitivity:
    """How the mean IC holds up over the values of a parameter; missing ones don't count."""

    by_parameter: dict
    mean_ic: float
    dispersion: float
    consistency: float

    @property
    def robust(self) -> bool:
        return self.consistency >= 0.75


def sensitivity(by_parameter: dict[int, float]) -> Sensitivity:
    v = np.array([x for x in by_parameter.values() if x == x], float)
    if not len(v):
        return Sensitivity(by_parameter, nan, nan, nan)
    return Sensitivity(by_parameter, float(v.mean()), float(v.std()), float((np.sign(v) == (np.sign(v.mean()) or 1)).mean()))


@dataclass(frozen=True)
class RobustnessReport:
    mean_ic: float
    consistency: float
    worst: float
    stable: bool
    by_regime: dict
    by_parameter: dict

    @property
    def across_regimes(self) -> bool:
        """Two regimes at least, and one sign in all that have one."""
        known = [v for v in self.by_regime.values() if v is not None and v == v]
        return len(known) >= 2 and len({np.sign(v) for v in known if v}) == 1

    @property
    def sensitivity(self) -> Sensitivity:
        return sensitivity(self.by_parameter)

    @property
    def robust_parameters(self) -> bool:
        return self.sensitivity.robust

    @property
    def passes(self) -> bool:
        return self.stable and self.across_regimes and (not self.by_parameter or self.robust_parameters)


def robustness_report(panel: DataFrame, expression: str, template: str | None = None, params: tuple[int, ...] = (), horizon: int = 1) -> RobustnessReport:
    from crosswind.operators.preprocess import preprocessed
    from crosswind.plans.compiler import family_scores
    from crosswind.plans.language import make_factor
    from crosswind.sources.panels import with_forward

    name = f"fwd_{horizon}"
    scores = preprocessed(family_scores(with_forward(panel, horizon), [make_factor("x", expression)], (name,))).withColumn("fwd", F.col(name))
    ics = ic_series(scores).persist()
    s = stability(subperiods(ics)).first()
    regimes = {r["regime"]: r["mean_ic"] for r in regime_ics(ics, regime_labels(panel)).collect()}
    ics.unpersist()
    return RobustnessReport(s["mean_ic"] if s else nan, s["consistency"] if s else nan, s["worst"] if s else nan, bool(s and s["stable"]), regimes, parameter_sensitivity(panel, template, params, horizon) if template else {})
