"""Decisions, gates, contracts, robustness and commands, against the rules they follow."""

import json
from math import nan, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosswind import cli
from crosswind.operators import analytics, dedup, export, generate, registry, robustness, stats, study, universe
from crosswind.plans.language import make_factor
from crosswind.sources import panels


def test_missing_numbers_pass_every_gate():
    for missing in (None, nan):
        state, _ = study.decide({"mean_ic": missing, "ic_t_stat": missing, "turnover": missing}, False, None, missing, missing)
        assert state == study.State.RESEARCH_SURVIVOR
    assert study.decide({"mean_ic": 0.001, "ic_t_stat": None}, False, None, None, None)[0] == study.State.REJECTED_DEV
    assert study.decide({"mean_ic": 0.1, "ic_t_stat": 5.0}, True, True, 1.0, 0.0)[0] == study.State.DUPLICATE


def test_proposals_need_fields_and_no_description():
    whole = {"factor_id": "x", "expression": "ts_mean(close,5)", "economic_hypothesis": "h", "expected_sign": 1, "required_fields": ["close"]}
    assert generate.parse_proposal(json.dumps(whole)).description == ""
    for k in whole:
        with pytest.raises(generate.ProposalError):
            generate.parse_proposal(json.dumps({n: v for n, v in (whole | {"description": "d"}).items() if n != k}))
    assert generate.mutate_horizon(make_factor("p", "ts_mean(close,5)"), 9, "long").factor_id == "p_mlong"


def test_contract_keeps_to_its_frequencies_and_keys():
    factor = {"candidate_id": "c", "expression": "close", "expression_hash": "h", "expected_sign": -1, "max_lookback": 0, "required_fields": ["returns", "close", "volume", "odd"]}
    args = dict(metrics={"sharpe": 0.0, "portfolio_backtest": {"sharpe": 1.5}}, statistics={"fdr_reject": False, "trial_count": 4}, hypothesis=" ", data_provenance={}, created_at="now")
    for own, want in (("daily", "1Day"), ("hourly", "1Day"), ("weekly", "1Day"), ("15Min", "15Min"), ("1Min", "1Min"), ("5Min", "5Min")):
        assert export.to_contract(factor=factor | {"intended_frequency": own}, **args)["frequency"] == want
    got = export.to_contract(factor=factor, **args)
    assert list(got)[:4] == ["bundle_schema_version", "candidate_id", "name", "source_project_version"] and len(got) == 17 and len(got["evaluation_summary"]) == 17
    assert got["required_inputs"] == ["close", "volume"] and got["lookback"] == 1 and got["name"] == "c" and got["economic_hypothesis"] == "(no hypothesis provided)"
    told = got["evaluation_summary"]
    assert told["diagnostic_sharpe"] == 0.0 and told["survives_fdr"] is False and told["portfolio_backtest_sharpe"] == 1.5 and told["mean_ic"] is None
    assert got["approval_status"] == "approved" and export.to_contract(factor=factor, **args, approval_state="proposed")["approval_status"] == "draft"
    assert got["signal_spec"] == {"kind": "expression", "expression": "close", "parameters": {"expected_sign": -1}} and got["universe_assumptions"] == "research-only"


def test_bundle_with_a_file_too_many(tmp_path):
    spec = make_factor("c", "ts_mean(close,5)", economic_hypothesis="why")
    path = export.export_candidate(spec, tmp_path / "b", evaluation_metrics={}, statistics={}, lineage=[], novelty={}, data_provenance={}, report_md="x", approved=True, trial_count=1, holdout_views=0)
    assert export.verify_bundle(path) == [] and export.contract_of(path)["economic_hypothesis"] == "why"
    (path / "more.txt").write_text("x")
    assert export.verify_bundle(path) == ["more.txt isn't listed"]


def test_capacity_is_where_cost_takes_the_return():
    rng = np.random.default_rng(0)
    adv, vol = rng.uniform(1e6, 1e8, 9).tolist(), rng.uniform(0.01, 0.05, 9).tolist()
    model, turnover = analytics.CostModel(), 0.3
    got = analytics.capacity(0.002, adv, vol, turnover, len(adv), model)
    cost = model.fixed(turnover) + np.mean([model.impact * v * sqrt(turnover * got / len(adv) / a) * turnover for a, v in zip(adv, vol)])
    assert cost == pytest.approx(0.002, rel=1e-9)


def test_volumes_profile_has_all_its_returns(spark):
    p = panels.synthetic(spark, 3, 100)
    got = {r["symbol"]: r for r in analytics.adv_profile(p, 63).collect()}
    f = p.toPandas()
    for s, rows in f.sort_values("ts").groupby("symbol"):
        assert got[s]["vol"] == pytest.approx(rows.close.pct_change().tail(63).std(), rel=1e-9)
        assert got[s]["adv"] == pytest.approx((rows.close * rows.volume).tail(63).median(), rel=1e-9)


def test_signs_regimes_and_parameters(spark):
    folds = spark.createDataFrame([("a", 0, 30, 0.1), ("a", 1, 10, -0.2), ("a", 2, 10, 0.3), ("a", 3, 10, 0.1), ("b", 0, 30, -0.1), ("b", 1, 1, 5.0)], "factor_id string, fold int, n long, mean_ic double")
    got = {r["factor_id"]: r for r in robustness.stability(folds).collect()}
    assert got["a"]["consistency"] == 0.75 and got["a"]["worst"] == -0.2 and got["a"]["stable"]
    assert got["b"]["mean_ic"] == pytest.approx(2 / 31) and got["b"]["consistency"] == 0.5 and not got["b"]["stable"]

    def across(*values):
        return robustness.RobustnessReport(0.1, 1.0, 0.1, True, dict(enumerate(values)), {}).across_regimes

    assert not across(0.1) and across(0.1, 0.2) and across(0.1, 0.0) and not across(0.1, -0.1) and not across(0.1, nan) and not across(0.0, 0.0)
    s = robustness.sensitivity({1: 0.1, 2: 0.2, 3: -0.1, 4: 0.3, 5: nan})
    assert s.consistency == 0.75 and s.robust and s.dispersion == pytest.approx(np.std([0.1, 0.2, -0.1, 0.3]))
    assert not robustness.sensitivity({1: nan}).robust


def test_walk_forward_against_pandas(spark):
    import pandas as pd

    rng = np.random.default_rng(2)
    days = pd.bdate_range("2021-01-04", periods=53)
    ic, ls = pd.Series(rng.normal(0.01, 0.1, 53), days), pd.Series(rng.normal(0, 0.01, 53), days).iloc[3:50]
    frame = lambda s, name: spark.createDataFrame(pd.DataFrame({"factor_id": "f", "ts": s.index, name: s.to_numpy()}))
    out = ic.iloc[int(53 * 0.3) :]
    blocks = np.array_split(out.index.to_numpy(), 5)
    sharpe = lambda x: x.mean() / x.std(ddof=1) * sqrt(252)
    rows = robustness.walk_forward(frame(ic, "ic"), ls=frame(ls, "ls")).orderBy("window").collect()
    assert [r["sharpe"] for r in rows] == pytest.approx([sharpe(ls.reindex(b).dropna()) for b in blocks])
    got = robustness.walk_forward_summary(frame(ic, "ic"), frame(ls, "ls")).first()
    means = np.array([ic.loc[b].mean() for b in blocks])
    assert got["mean_ic"] == pytest.approx(out.mean()) and got["ic_ir"] == pytest.approx(out.mean() / out.std()) and got["worst_window_ic"] == pytest.approx(means.min())
    assert got["sign_consistency"] == pytest.approx((np.sign(means) == np.sign(out.mean())).mean()) and got["sharpe"] == pytest.approx(sharpe(ls.reindex(out.index).dropna()))


def test_leak_is_recorded_and_the_family_goes_on(spark, tmp_path, monkeypatch):
    panel = panels.synthetic(spark, 6, 80)
    reg = registry.Registry(spark, str(tmp_path / "reg"))
    monkeypatch.setattr(study, "leaking", lambda panel, specs: ["leak"])
    done = study.run_family_study(panel, [make_factor("leak", "ts_mean(close,5)"), make_factor("good", "ts_returns(close,5)")], "fam", reg, n_boot=20, universe=universe.static_universe(panel))
    states = {r.spec.factor_id: r.state for r in done.results}
    assert states["leak"] == study.State.INVALID and states["good"] != study.State.INVALID and done.statistics["trial_count"] == 2
    rows = {r["factor_id"]: r for r in reg.experiments().collect()}
    assert rows["leak"]["status"] == "invalid" and "look-ahead" in rows["leak"]["failure_reason"] and rows["good"]["universe_fingerprint"] == universe.static_universe(panel).fingerprint()
    assert np.isnan(done.statistics["white_rc_p"]) and np.isnan(done.statistics["spa_p"])


def test_no_factor_of_the_language_leaks(spark):
    specs = [make_factor(str(k), x) for k, x in enumerate(("ts_returns(close,3)", "cs_rank(ts_mean(volume,5))", "ts_ewm(returns,5)", "ts_corr(close,volume,6)"))]
    assert study.leaking(panels.synthetic(spark, 5, 60), specs) == []


def test_universes(spark):
    p = panels.synthetic(spark, 3, 10)
    member = p.select("ts", "symbol", (F.col("symbol") != "SYM01").alias("member"))
    kinds = [universe.static_universe(p), universe.point_in_time_universe(member), universe.research_only(member), universe.stressed_universe(member, p.select("symbol").distinct().withColumn("death", F.lit("2021-01-06").cast("timestamp")))]
    assert [u.kind for u in kinds] == ["static", "point_in_time", "research_only", "survivorship_stressed"] and len({u.fingerprint() for u in kinds}) == 4
    assert universe.point_in_time_universe(member.orderBy("symbol")).fingerprint() == kinds[1].fingerprint()
    got = kinds[1].apply(p.withColumn("score", F.lit(1.0)))
    assert got.filter("score IS NOT NULL").count() == 18 and got.count() == 30
    with pytest.raises(ValueError):
        universe.Universe("x", "odd", member)


def test_chains_loops_and_unknown_parents(spark, tmp_path):
    r = registry.Registry(spark, str(tmp_path / "reg"))
    row = lambda k, parent: {"family": "f", "factor_id": k, "parent_id": parent, "expression": "close", "expression_hash": k}
    r.record([row("a", None), *(row(f"a{k}", f"a{k - 1}" if k else "a") for k in range(9)), row("x", "y"), row("y", "x"), row("z", "x"), row("w", "nobody")])
    got = {g["factor_id"]: (g["generations"], g["root"]) for g in r.generations().collect()}
    assert all(got[f"a{k}"] == (k + 1, "a") for k in range(9)) and got["a"] == (0, "a") and got["w"] == (0, "w")
    assert all(got[k] == (None, None) for k in "xyz")


def test_novelty_names_what_is_alike(spark):
    p = panels.synthetic(spark, 6, 80)
    from crosswind.plans.compiler import family_scores

    specs = [make_factor("a", "ts_returns(close,5)"), make_factor("b", "ts_returns(close,5)"), make_factor("c", "neg(ts_returns(close,5))"), make_factor("d", "ts_mean(volume,5)"), make_factor("e", "add(close,0)")]
    got = dedup.novelty(specs, family_scores(p, specs))
    assert got["a"].same == ["b"] and {n for n, _ in got["a"].alike} == {"b", "c"} and got["c"].nearest[1] == pytest.approx(-1)
    assert not got["d"].duplicate and got["d"].nearest is None and got["d"].family == "volume"
    assert dedup.score_correlations(family_scores(p, specs[:1])).count() == 0


def test_purged_folds_against_their_rule():
    for n, k, h, e in ((23, 5, 2, 3), (4, 6, 1, 0), (10, 1, 0, 0)):
        got = stats.purged_folds(n, k, h, e)
        for train, test in got:
            assert train == [i for i in range(n) if i < test[0] - h or i > test[-1] + h + e]
    assert all(np.isnan(v) for v in (stats.block_bootstrap([1.0, 2.0]).low, stats.block_bootstrap([1.0, 2.0]).estimate))


def test_commands(spark, tmp_path, capsys):
    p = panels.synthetic(spark, 4, 60).toPandas()
    for f in panels.FIELDS:
        p.pivot(index="ts", columns="symbol", values=f).rename_axis("timestamp").to_csv(tmp_path / f"{f}.csv")
    data, reg = ["--csv-dir", str(tmp_path)], str(tmp_path / "reg")
    told = lambda *args: (cli.main(list(args)), capsys.readouterr().out)
    assert json.loads(told("data", "validate", *data)[1])["symbols"] == 4
    assert "mean_ic" in json.loads(told("factor", "evaluate", "ts_returns(close,5)", *data)[1])
    assert json.loads(told("factor", "compare", "close", "neg(close)", *data)[1])["correlation"] == pytest.approx(-1, abs=1e-6)
    assert "passes" in json.loads(told("factor", "robustness", "ts_returns(close,5)", "--template", "ts_returns(close,{w})", "--params", "3,5", *data)[1])
    assert len(json.loads(told("factor", "walkforward", "ts_returns(close,5)", *data)[1])) == 5
    assert len(told("generate", "templates")[1].splitlines()) == 32
    code, out = told("pipeline", "run", "--out", str(tmp_path / "out"), "--registry", reg, "--families", "skewness", *data)
    assert code == 0 and json.loads(out)["families"]["skewness"]["candidates"] == 4 and (tmp_path / "out" / "skewness.html").exists()
    lines = told("experiment", "list", "--registry", reg)[1].splitlines()
    assert len(lines) == 4 and json.loads(told("experiment", "show", lines[0].split("\t")[0], "--registry", reg)[1])["family"] == "skewness"
    spec = make_factor("c", "ts_mean(close,5)")
    path = export.export_candidate(spec, tmp_path / "b", evaluation_metrics={}, statistics={}, lineage=[], novelty={}, data_provenance={}, report_md="x", approved=True, trial_count=1, holdout_views=0)
    assert told("export", "verify", str(path))[0] == 0 and told("export", "bundle", str(path))[0] == 0 and json.loads((tmp_path / "b.v1.json").read_text())["candidate_id"] == "c"
    code, out = told("research-agent", "run", "--registry", str(tmp_path / "agent"), "--families", "skewness", "--budget", "2", *data)
    assert code == 0 and "2 proposed" in out
