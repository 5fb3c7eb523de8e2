"""A family of candidates from expressions to decisions, in a few Spark jobs whatever its size."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from math import nan

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswind.operators import analytics, dedup, stats
from crosswind.operators.preprocess import Preprocess, coverage, preprocessed
from crosswind.operators.registry import Registry, as_json
from crosswind.operators.universe import Universe
from crosswind.plans.compiler import check, family_scores
from crosswind.plans.language import CausalityError, FactorSpec
from crosswind.sources.panels import FIELDS, with_forward


class State(str, Enum):
    PROPOSED = "proposed"
    INVALID = "invalid"
    DUPLICATE = "duplicate"
    REJECTED_DEV = "rejected_in_development"
    REJECTED_ROBUSTNESS = "rejected_after_robustness"
    HOLDOUT_PENDING = "holdout_pending"
    REJECTED_HOLDOUT = "rejected_on_holdout"
    RESEARCH_SURVIVOR = "research_survivor"
    HUMAN_APPROVED = "human_approved"
    AUTO_APPROVED = "auto_approved"
    EXPORTED = "exported"


@dataclass(frozen=True)
class Criteria:
    min_abs_mean_ic: float = 0.01
    min_abs_t_stat: float = 2.0
    max_turnover: float = 0.9
    require_fdr_reject: bool = True
    min_dsr: float = 0.6
    max_correlation: float = 0.7


def decide(metrics: dict, duplicate: bool, fdr_reject: bool | None, dsr: float | None, nearest: float | None, rules: Criteria = Criteria()) -> tuple[State, list[str]]:
    """The first gate that fails decides; missing numbers pass (a comparison with nan is never true)."""
    if duplicate:
        return State.DUPLICATE, ["another factor of the family is the same or nearly so"]
    ic, t, gone = (nan if metrics.get(k) is None else metrics[k] for k in ("mean_ic", "ic_t_stat", "turnover"))
    ic, t = abs(ic), abs(t)
    early = [
        (ic < rules.min_abs_mean_ic, f"|mean IC| {ic:.4f} is below {rules.min_abs_mean_ic}"),
        (t < rules.min_abs_t_stat, f"|t| {t:.2f} is below {rules.min_abs_t_stat}"),
        (gone > rules.max_turnover, f"turnover {gone} is above {rules.max_turnover}"),
    ]
    late = [
        (rules.require_fdr_reject and fdr_reject is False, "not significant at the family's false discovery rate"),
        (dsr is not None and dsr < rules.min_dsr, f"deflated Sharpe ratio {dsr} is below {rules.min_dsr}"),
        (nearest is not None and abs(nearest) > rules.max_correlation, f"correlation {nearest} with another factor"),
    ]
    for gates, state in ((early, State.REJECTED_DEV), (late, State.REJECTED_ROBUSTNESS)):
        if reasons := [why for failed, why in gates if failed]:
            return state, reasons
    return State.RESEARCH_SURVIVOR, ["passed the gates of development, significance, deflated Sharpe ratio and novelty; no proof of profit"]


def leaking(panel: DataFrame, specs: list[FactorSpec], cut_share: float = 0.6, tolerance: float = 1e-9) -> list[str]:
    """Ids of the factors whose past changes with the future, sorted: all factors are computed on the panel and on one whose rows
    behind a cut are blown up, and compared on what lies before.

    Both panels go through one plan, told apart by ``side``; cells missing on either side don't count.
    """
    times = panel.agg(F.percentile(F.unix_micros("ts"), F.lit(cut_share)).alias("cut")).first()["cut"]
    if times is None:
        return []
    after = F.unix_micros("ts") > F.lit(int(times))
    blow = lambda c: F.when(after, F.col(c) * (1.5 + F.pmod(F.xxhash64("ts", "symbol", F.lit(c)), F.lit(1000)) / 1000)).otherwise(F.col(c))
    fields = [c for c in FIELDS if c in panel.columns]
    base = panel.select("ts", "symbol", "sym_ord", *fields)
    other = base.select("ts", "symbol", "sym_ord", *(blow(c).alias(c) for c in fields))
    both = base.withColumn("side", F.lit(0)).unionByName(other.withColumn("side", F.lit(1)))
    scores = family_scores(both, specs, keys=("side",)).filter(~after)
    diff = scores.groupBy("factor_id", "ts", "symbol").agg(F.max(F.when(F.col("side") == 0, F.col("score"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("score"))).alias("b"))
    worst = diff.groupBy("factor_id").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("d")).filter(F.col("d") > tolerance).collect()  # a row for each factor
    return sorted(r["factor_id"] for r in worst)


def assert_no_lookahead(panel: DataFrame, specs: list[FactorSpec], cut_share: float = 0.6, tolerance: float = 1e-9) -> None:
    """Raises CausalityError, which names them, if factors look ahead."""
    if worst := leaking(panel, specs, cut_share, tolerance):
        raise CausalityError("look-ahead detected: " + ", ".join(worst))


@dataclass
class Result:
    spec: FactorSpec
    metrics: dict = field(default_factory=dict)
    statistics: dict = field(default_factory=dict)
    state: State = State.PROPOSED
    reasons: list[str] = field(default_factory=list)
    experiment_id: str = ""


@dataclass
class Study:
    family: str
    results: list[Result]
    statistics: dict

    def rows(self) -> list[dict]:
        return [{"factor_id": r.spec.factor_id, "state": r.state.value} | r.metrics | r.statistics for r in self.results]


def _by_factor(df: DataFrame) -> dict[str, dict]:
    return {r["factor_id"]: r.asDict() for r in df.collect()}  # a row for each factor


def evaluate_family(panel: DataFrame, specs: list[FactorSpec], horizon: int = 1, q: int = 5, config: Preprocess = Preprocess(), eligible: DataFrame | None = None, costs: analytics.CostModel = analytics.CostModel()) -> tuple[dict[str, dict], DataFrame, DataFrame]:
    """(metrics by factor, preprocessed scores, long-short returns) of all specs at once."""
    horizons = tuple(sorted({1, 2, 3, 5, 10, horizon}))
    keep = tuple(f"fwd_{h}" for h in horizons)
    scores = preprocessed(family_scores(with_forward(panel, *horizons), specs, keep), config, eligible).withColumn("fwd", F.col(f"fwd_{horizon}")).persist()
    ls = analytics.long_short(analytics.quantile_buckets(scores, q), q).persist()
    ics = _by_factor(analytics.ic_stats(analytics.ic_series(scores, "spearman")))
    port = _by_factor(analytics.portfolio_stats(scores, q, model=costs))
    test = _by_factor(analytics.backtest(scores, q, model=costs))
    auto = _by_factor(analytics.score_autocorr(scores))
    cover = _by_factor(coverage(scores).groupBy("factor_id").agg(F.avg("coverage").alias("coverage")))
    decay: dict[str, dict] = {}
    for r in analytics.ic_decay(scores).collect():
        decay.setdefault(r["factor_id"], {})[r["horizon"]] = r["mean_ic"]
    adv = analytics.adv_profile(panel).collect()
    advs, vols = [r["adv"] for r in adv if r["adv"] is not None], [r["vol"] if r["vol"] is not None else nan for r in adv if r["adv"] is not None]
    out = {}
    for s in specs:
        i, p, b = ics.get(s.factor_id, {}), port.get(s.factor_id, {}), test.get(s.factor_id, {})
        tau = p.get("turnover")
        out[s.factor_id] = {
            "n_periods": i.get("n", 0), "mean_ic": i.get("mean_ic"), "ic_ir": i.get("ic_ir"), "ic_t_stat": i.get("t_stat"), "ic_hit_rate": i.get("hit_rate"),
            "sharpe": p.get("sharpe"), "sharpe_after_cost": p.get("sharpe_after_cost"), "ann_return": p.get("ann_return"), "ann_vol": p.get("ann_vol"), "turnover": tau, "monotonicity": p.get("monotonicity"), "spread": p.get("spread"),
            "coverage": cover.get(s.factor_id, {}).get("coverage"), "autocorr": auto.get(s.factor_id, {}).get("autocorr"),
            "capacity_usd": analytics.capacity(p.get("gross") or nan, advs, vols, 0.5 if tau is None else tau, len(advs), costs),
            "cost_sensitivity": {b_: ((p["gross"] - b_ / 1e4 * (0.5 if tau is None else tau)) * 252 / p["ann_vol"]) if p.get("ann_vol") else None for b_ in (0, 5, 10, 20)},
            "portfolio_spec": analytics.PortfolioSpec(quantiles=q).to_dict(), "portfolio_backtest": {k: v for k, v in b.items() if k != "factor_id"}, "ic_decay": decay.get(s.factor_id, {}),
        }
    return out, scores, ls


def run_family_study(panel: DataFrame, specs: list[FactorSpec], family: str, registry: Registry, horizon: int = 1, n_boot: int = 500, seed: int = 0, rules: Criteria = Criteria(), leakage: bool = True, dataset: str = "", universe: Universe | None = None) -> Study:
    """Evaluates, tests, compares and decides on a family; every candidate, invalid ones too, is recorded and counts as a trial."""
    good, invalid = [], []
    for s in specs:
        try:
            check(s.tree)
            good.append(s)
        except ValueError as x:
            invalid.append((s, str(x)))
    if leakage and good:
        ahead = set(leaking(panel, good))
        invalid += [(s, "look-ahead detected: its past changes with the future") for s in good if s.factor_id in ahead]
        good = [s for s in good if s.factor_id not in ahead]
    metrics, scores, ls = evaluate_family(panel, good, horizon, eligible=universe.eligibility() if universe else None) if good else ({}, None, None)
    mark = universe.fingerprint() if universe else dataset
    row = lambda s, **more: {"family": family, "factor_id": s.factor_id, "expression": s.expression, "expression_hash": s.expression_hash, "generator": s.generator, "parent_id": s.parent_ids[0] if s.parent_ids else None, "dataset_fingerprint": dataset, "universe_fingerprint": mark, "seed": seed} | more
    ids = registry.record([row(s, metrics_json=as_json(metrics[s.factor_id])) for s in good] + [row(s, status=State.INVALID.value, failure_reason=why) for s, why in invalid])
    results = [Result(s, metrics[s.factor_id], experiment_id=i) for s, i in zip(good, ids)] + [Result(s, state=State.INVALID, reasons=[why], experiment_id=i) for (s, why), i in zip(invalid, ids[len(good) :])]
    trials = registry.family_trial_count(family)
    overall = {"trial_count": trials}
    if good:
        names = [s.factor_id for s in good]
        wide = {n: {} for n in names}
        for r in ls.collect():  # a number for each bar and factor
            wide[r["factor_id"]][r["ts"]] = r["ls"]
        common = sorted(set.intersection(*(set(x) for x in wide.values())))
        m = np.array([[wide[n][t] for n in names] for t in common], float).reshape(len(common), len(names))
        overall |= {"pbo": stats.pbo_cscv(m, 8)[0] if len(names) > 1 and len(m) >= 8 else nan, "pbo_cpcv": stats.pbo_cpcv(m)[0] if len(names) > 1 and len(m) >= 12 else nan, "white_rc_p": stats.reality_check(m, n_boot, seed=seed) if len(names) > 1 and len(m) >= 20 else nan, "spa_p": stats.superior_ability(m, n_boot, seed=seed) if len(names) > 1 and len(m) >= 20 else nan}
        spark = panel.sparkSession
        p = spark.createDataFrame([(family, n, stats.ic_pvalue(metrics[n]["ic_t_stat"], metrics[n]["n_periods"])) for n in names], "family string, factor_id string, p double")
        bh, hm = _by_factor(stats.benjamini_hochberg(p)), _by_factor(stats.holm(p))
        moments = _by_factor(stats.return_moments(ls))
        srs = [v["sr"] for v in moments.values() if v["sr"] is not None]
        variance = float(np.var(srs, ddof=1)) if len(srs) > 1 else None
        rho = {(r["a"], r["b"]): r["rho"] for r in dedup.score_correlations(scores).collect()}
        strength = sorted(range(len(good)), key=lambda j: (-round(abs(metrics[names[j]]["mean_ic"] or 0.0), 12), j))
        for place, j in enumerate(strength):
            s, res = good[j], results[j]
            stronger = [good[k] for k in strength[:place]]
            near = {o.factor_id: rho.get((min(o.factor_id, s.factor_id), max(o.factor_id, s.factor_id))) for o in stronger}
            near = {k: v for k, v in near.items() if v is not None}
            top = max(near, key=lambda k: abs(near[k]), default=None)
            duplicate = bool(dedup.syntactic_duplicates(s, stronger)) or any(abs(v) >= rules.max_correlation for v in near.values())
            mom, own = moments.get(s.factor_id, {}), np.array([wide[s.factor_id][t] for t in sorted(wide[s.factor_id])])
            dsr = stats.deflated_sharpe(mom.get("n", 0), mom.get("sr"), mom.get("skew"), mom.get("kurt"), trials, variance)
            ci, paths = stats.block_bootstrap(own, "sharpe", n_boot=2 * n_boot, seed=seed), stats.cpcv_paths(own)
            res.statistics = overall | {"p_value": bh[s.factor_id]["p"], "p_fdr": bh[s.factor_id]["p_fdr"], "fdr_reject": bh[s.factor_id]["fdr_reject"], "p_holm": hm[s.factor_id]["p_holm"], "holm_reject": hm[s.factor_id]["holm_reject"], "dsr": dsr, "ci_low": ci.low, "ci_high": ci.high, "cpcv_median": paths.median, "cpcv_frac_positive": paths.frac_positive, "nearest": top, "nearest_corr": near.get(top), "semantic_family": dedup.classify(s.tree)}
            res.state, res.reasons = decide(res.metrics, duplicate, res.statistics["fdr_reject"], dsr, near.get(top), rules)
        registry.update({r.experiment_id: {"status": r.state.value, "failure_reason": "; ".join(r.reasons), "metrics_json": as_json(r.metrics | r.statistics)} for r in results[: len(good)]})
        scores.unpersist()
        ls.unpersist()
    return Study(family, results, overall)
