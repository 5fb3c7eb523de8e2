import pytest

import __spark_entry__ as entry
from crosswind.plans import catalogue


@pytest.mark.parametrize("name", ["panel_ohlcv", "ts_ewm", "ts_rank", "cs_winsor", "nested_ts_cs_ts", "preprocess_default", "eligibility_pit", "ic_decay", "quantile_buckets", "portfolio_stats", "backtest", "regime_ic", "walk_forward", "bh", "holm", "pbo_cscv", "cpcv_splits", "dedup_pairs", "data_split", "lineage", "walk_forward_sharpe", "walk_forward_summary", "stability", "param_verdict", "purged_kfold", "pbo_value", "dsr_value", "ic_pvalue", "capacity", "family_metrics", "decisions", "source_long", "source_csv", "registry_trial_counts"])
def test_query_matches_its_sql(same, name):
    same(name)


def test_novelty_matches_its_sql_where_factors_overlap(same):
    same("novelty", "/root/testdata/sf0.01")


def test_every_row_of_the_inventory_has_a_query():
    ops = {q[0] for q in catalogue.sql.EXPRESSIONS}
    assert sum(n.startswith("ts_") for n in ops) == 17 and sum(n.startswith("cs_") for n in ops) == 6 and sum(n.startswith("arith_") for n in ops) == 10
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) - len(catalogue.ORACLE_SQL) == 2


def test_entry_has_a_row(spark):
    row = entry.entry(spark).first()
    assert row["n"] > 50
