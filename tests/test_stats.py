import math

import numpy as np
import pytest

from crosswind.operators import analytics, stats
from crosswind.operators.study import State, decide


def test_p_values_match_known_ones():
    assert stats.ic_pvalue(2.0, 11) == pytest.approx(0.07338803, abs=1e-7)
    assert stats.ic_pvalue(-1.0, 2) == pytest.approx(0.5, abs=1e-9)
    assert stats.ic_pvalue(1.959964, 10**6) == pytest.approx(0.05, abs=1e-5)
    assert math.isnan(stats.ic_pvalue(None, 5))


def test_adjustments_against_definitions(spark):
    rng = np.random.default_rng(1)
    rows = [(f, str(k), float(np.round(rng.random(), 1))) for f in ("a", "b") for k in range(12)] + [("a", "none", None)]
    df = spark.createDataFrame(rows, "family string, factor_id string, p double")
    for family in "ab":
        p = sorted((1.0 if r[2] is None else r[2]) for r in rows if r[0] == family)
        m = len(p)
        bh = [min(1, min(p[j] * m / (j + 1) for j in range(i, m))) for i in range(m)]
        hm = [min(1, max(p[j] * (m - j) for j in range(i + 1))) for i in range(m)]
        got = stats.benjamini_hochberg(df).filter(f"family = '{family}'").orderBy("rank").collect()
        assert [r["p_fdr"] for r in got] == pytest.approx(bh) and all(r["fdr_reject"] == (r["p_fdr"] <= 0.05) for r in got)
        assert [r["p_holm"] for r in stats.holm(df).filter(f"family = '{family}'").orderBy("rank").collect()] == pytest.approx(hm)


def test_splits_and_folds():
    assert stats.array_split(10, 4) == [(0, 3), (3, 6), (6, 8), (8, 10)]
    for train, test in stats.cpcv_splits(60, 6, 2, 2, 3):
        assert not set(train) & {i for t in test for i in range(t - 2, t + 3)}
    assert stats.n_backtest_paths(6, 2) == 5
    for train, test in stats.purged_folds(50, 5, 1, 2):
        assert all(i < test[0] - 1 or i > test[-1] + 3 for i in train)


def test_skill_and_noise():
    rng = np.random.default_rng(3)
    noise = rng.normal(0, 0.01, (240, 10))
    skill = noise.copy()
    skill[:, 0] += 0.004
    assert stats.reality_check(skill, 300) < 0.05 < stats.reality_check(noise, 300)
    assert stats.superior_ability(skill, 300) < 0.05 < stats.superior_ability(noise, 300)
    assert stats.pbo_cscv(skill, 8)[0] < 0.1 and stats.pbo_cpcv(skill)[0] < 0.1
    assert math.isnan(stats.reality_check(noise[:2]))
    ci = stats.block_bootstrap(skill[:, 0], n_boot=300)
    assert ci.low < ci.estimate < ci.high
    assert stats.cpcv_paths(skill[:, 0]).frac_positive > 0.9


def test_deflation_grows_with_trials():
    few, many = (stats.deflated_sharpe(250, 0.1, 0.0, 3.0, n) for n in (1, 1000))
    assert many < few and few == pytest.approx(0.94, abs=0.01)
    assert stats.expected_max_sharpe(1, 1.0) == 0 and math.isnan(stats.deflated_sharpe(2, 0.1, 0, 3, 1))


def test_capacity_solves_the_cost_equation():
    m = analytics.CostModel()
    adv, vol = [1e7, 3e7], [0.02, 0.03]
    a = analytics.capacity(0.002, adv, vol, 0.4, 10, m)
    impact = np.mean([m.impact * v * np.sqrt(0.4 * a / 10 / d) for v, d in zip(vol, adv)]) * 0.4
    assert m.fixed(0.4) + impact == pytest.approx(0.002)
    assert analytics.capacity(0.0, adv, vol, 0.4, 10) == 0 and analytics.capacity(0.01, adv, vol, 0.0, 10) == math.inf
    assert analytics.capacity(0.01, [0.0], [0.02], 0.4, 10) == 0 and analytics.capacity(0.01, adv, [math.nan, 1], 0.4, 10) == math.inf


def test_gates_in_order():
    good = {"mean_ic": 0.05, "ic_t_stat": 4.0, "turnover": 0.2}
    assert decide(good, True, True, 0.9, None)[0] == State.DUPLICATE
    assert decide(good | {"turnover": 0.95}, False, False, 0.1, 0.9)[0] == State.REJECTED_DEV
    assert decide(good, False, False, 0.9, None)[0] == State.REJECTED_ROBUSTNESS
    assert decide(good, False, True, 0.9, 0.1)[0] == State.RESEARCH_SURVIVOR
    assert decide({"mean_ic": math.nan, "ic_t_stat": math.nan}, False, True, math.nan, None)[0] == State.RESEARCH_SURVIVOR


def test_bootstrap_query_keeps_the_defaults():
    import inspect

    from crosswind.plans import catalogue

    source = inspect.getsource(catalogue.bootstrap_tests)
    assert "n_boot" not in source
    assert all(f"stats.{x}(m)" in source for x in ("reality_check", "superior_ability", "pbo_cscv"))
