import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from crosswind import cli
from crosswind.operators import agent, dedup, export, generate, registry, robustness, study
from crosswind.plans.language import make_factor, parse
from crosswind.sources import panels


def test_registry_counts_updates_lineage_and_holdout(spark, tmp_path):
    r = registry.Registry(spark, str(tmp_path / "reg"))
    assert r.family_trial_count("f") == 0 and r.get("x") is None
    row = {"family": "f", "factor_id": "a", "expression": "close", "expression_hash": "h"}
    a, b = r.record([row, row | {"factor_id": "b", "parent_id": "a", "status": "invalid"}])
    assert r.family_trial_count("f") == 2 and [x["factor_id"] for x in r.lineage(b)] == ["b", "a"]
    r.update({a: {"status": "done"}})
    assert r.get(a)["status"] == "done" and r.list("f", "done").count() == 1
    panel = panels.synthetic(spark, 3, 30)
    gov = registry.HoldoutGovernor(r, registry.split_by_fraction(panel), registry.Budget(3, 1, 1))
    assert gov.locked_test(panel, "f", a, "look").select("ts").distinct().count() == 6
    assert r.get(a)["holdout_viewed"] == 1 and r.holdout_access_count() == 1
    with pytest.raises(registry.BudgetExceeded):
        gov.locked_test(panel, "f")
    with pytest.raises(registry.BudgetExceeded):
        gov.check_candidates("f", 2)
    with pytest.raises(ValueError):
        r.record([{"family": "f"}])


def test_sources(spark, tmp_path):
    p = panels.synthetic(spark, 3, 12)
    pdf = p.toPandas()
    for f in ("close", "volume"):
        pdf.pivot(index="ts", columns="symbol", values=f).rename_axis("timestamp").to_csv(tmp_path / f"{f}.csv")
    got = panels.read_csv_dir(spark, str(tmp_path))
    assert got.count() == 36 and panels.fingerprint(got.select("ts", "symbol", F.round("close", 6).alias("close"))) == panels.fingerprint(p.select("ts", "symbol", F.round("close", 6).alias("close")))
    with pytest.raises(FileNotFoundError):
        panels.read_csv_dir(spark, str(tmp_path / "no"))
    long = p.select(F.col("ts").alias("timestamp"), "symbol", F.lit("close").alias("field"), F.col("close").alias("value"))
    long.write.parquet(str(tmp_path / "long"))
    assert panels.read_long(spark, str(tmp_path / "long")).filter("close IS NOT NULL").count() == 36
    long.union(long.limit(1)).write.parquet(str(tmp_path / "twice"))
    with pytest.raises(ValueError):
        panels.read_long(spark, str(tmp_path / "twice"))
    with sqlite3.connect(tmp_path / "bars.db") as db:
        db.execute("CREATE TABLE market_bars(symbol, timeframe, timestamp, open, high, low, close, volume)")
        db.executemany("INSERT INTO market_bars VALUES (?,?,?,?,?,?,?,?)", [("A", "5Min", "2026-01-05T14:30:00+00:00", 1, 3, 1, 2, 9), ("B", "5Min", "2026-01-05T14:35:00+00:00", 1, 3, 1, 2, 9)])
    bars = panels.read_sqlite_bars(spark, str(tmp_path / "bars.db"))
    assert bars.count() == 4 and bars.filter("vwap = 2").count() == 2
    with pytest.raises(ValueError):
        panels.read_sqlite_bars(spark, str(tmp_path / "bars.db"), "1Min")


def test_generation():
    specs = generate.from_templates()
    assert len(specs) == 32 and len({s.expression_hash for s in specs}) == 32
    child = generate.mutate_horizon(specs[0], 33)
    assert child.expression == "ts_returns(close,33)" and child.parent_ids == ("momentum_5",)
    assert generate.mutate_horizon(make_factor("x", "close"), 5) is None
    assert generate.propose("anything") == generate.propose("anything")
    for raw in ("no", "[]", "{}", json.dumps({"factor_id": "x", "expression": "ts_lead(close,1)", "description": "", "economic_hypothesis": "", "expected_sign": 1})):
        with pytest.raises(generate.ProposalError):
            generate.parse_proposal(raw)


def test_families_by_name():
    for text, family in (("ts_mean(volume,5)", "volume"), ("divide(volume,close)", "liquidity"), ("ts_skew(close,5)", "skewness"), ("ts_zscore(close,5)", "reversal"), ("neg(ts_returns(close,5))", "reversal"), ("neg(ts_returns(close,20))", "momentum"), ("ts_ewm(close,5)", "trend"), ("ts_corr(close,open,5)", "interaction"), ("high-low", "unknown")):
        assert dedup.classify(parse(text)) == family


def test_study_bundle_and_contract(spark, tmp_path):
    panel = panels.synthetic(spark, 8, 120)
    reg = registry.Registry(spark, str(tmp_path / "reg"))
    specs = [make_factor("m", "ts_returns(close,20)"), make_factor("copy", "ts_returns(close,20)"), make_factor("bad", "1+2")]
    done = study.run_family_study(panel, specs, "fam", reg, n_boot=50)
    states = {r.spec.factor_id: r.state for r in done.results}
    assert states["copy"] == study.State.DUPLICATE and states["bad"] == study.State.INVALID and done.statistics["trial_count"] == 3
    r = done.results[0]
    args = dict(evaluation_metrics=r.metrics, statistics=r.statistics, lineage=[], novelty={}, data_provenance={"dataset_fingerprint": "d"}, report_md="# é", trial_count=3, holdout_views=0)
    with pytest.raises(export.ApprovalError):
        export.export_candidate(r.spec, tmp_path / "b", approved=False, **args)
    path = export.export_candidate(r.spec, tmp_path / "b", approved=True, **args)
    assert export.validate_bundle(path).ok
    one = export.contract_of(path)
    assert one == export.contract_of(path) and len(one) == 17 and one["required_inputs"] == ["close"]
    (path / "report.md").write_text("changed", encoding="utf-8")
    assert export.verify_bundle(path) == ["report.md was changed"] and cli.main(["export", "verify", str(path)]) == 1


def test_agent_keeps_off_the_holdout(spark, tmp_path):
    panel = panels.synthetic(spark, 6, 100)
    reg = registry.Registry(spark, str(tmp_path / "reg"))
    a = agent.ResearchAgent(panel, reg, ["skewness"], budget=3)
    last = panel.agg(F.max("ts")).first()[0]
    assert a.panel.agg(F.max("ts")).first()[0] < last
    report = a.run()
    assert report.proposed == 3 and report.holdout_accesses == 0 and reg.family_trial_count("skewness") == 3


def test_robustness_over_parameters(spark):
    panel = panels.synthetic(spark, 6, 80)
    got = robustness.parameter_sensitivity(panel, "ts_returns(close,{w})", (5, 0, 10))
    assert got[0] != got[0] and got[5] == got[5]


def test_command_line(capsys):
    assert cli.main(["factor", "validate", "ts_mean(close,5)"]) == 0
    assert cli.main(["factor", "validate", "ts_lead(close,5)"]) == 1
    assert "INVALID" in capsys.readouterr().out


def test_streamed_bars(spark, tmp_path):
    from crosswind.streaming.bars import bars

    rows = spark.createDataFrame([("2021-01-01 10:00:00", "a", 1.0, 2.0), ("2021-01-01 11:00:00", "a", 3.0, 2.0), ("2021-01-09 11:00:00", "a", 5.0, 1.0)], "time string, symbol string, price double, quantity double").withColumn("time", F.col("time").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = bars(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bars").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("bars").collect()
    assert [(r["open"], r["close"], r["volume"], r["vwap"]) for r in got] == [(1.0, 3.0, 4.0, 2.0)]
