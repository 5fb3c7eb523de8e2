import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosswind.functions import kernels
from crosswind.operators.study import assert_no_lookahead
from crosswind.plans.compiler import evaluate
from crosswind.plans.language import CausalityError, make_factor, parse
from crosswind.sources import panels

N = 40


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(5)
    close = pd.DataFrame(np.round(rng.normal(100, 5, (N, 4)), 1), columns=list("abcd"), index=pd.date_range("2021-01-01", periods=N))
    close.iloc[7, 1] = close.iloc[20, 2] = np.nan
    close.iloc[10:16, 3] = 100.0  # a flat window
    volume = pd.DataFrame(rng.integers(1, 9, (N, 4)).astype(float), columns=close.columns, index=close.index)
    return {"close": close, "volume": volume}


@pytest.fixture(scope="module")
def panel(spark, wide):
    rows = [(t.to_pydatetime(), s, k, *(None if np.isnan(w.loc[t, s]) else float(w.loc[t, s]) for w in wide.values())) for k, s in enumerate("abcd") for t in wide["close"].index]
    return spark.createDataFrame(rows, "ts timestamp, symbol string, sym_ord int, close double, volume double").persist()


def computed(panel, **factors):
    got = evaluate(panel, {k: parse(v) for k, v in factors.items()}).toPandas()
    return {k: got.pivot(index="ts", columns="symbol", values=k).astype(float) for k in factors}


def test_rolling_operators_match_pandas(panel, wide):
    c, v, n = wide["close"], wide["volume"], 5
    rolling = c.rolling(n, min_periods=n)
    want = {
        "ts_mean(close,5)": rolling.mean(), "ts_std(close,5)": rolling.std(), "ts_min(close,5)": rolling.min(), "ts_max(close,5)": rolling.max(), "ts_sum(close,5)": rolling.sum(),
        "ts_delay(close,3)": c.shift(3), "ts_delta(close,3)": c - c.shift(3), "ts_returns(close,3)": c / c.shift(3) - 1, "ts_skew(close,5)": rolling.skew(),
        "ts_rank(close,5)": rolling.apply(lambda w: (w <= w[-1]).mean(), raw=True), "ts_argmax(close,5)": rolling.apply(lambda w: n - 1 - w.argmax(), raw=True), "ts_argmin(close,5)": rolling.apply(lambda w: n - 1 - w.argmin(), raw=True),
        "ts_ewm(close,5)": c.ewm(span=5, min_periods=5).mean(), "ts_ewm(close,1)": c.ewm(span=1, min_periods=1).mean(), "ts_cov(close,volume,5)": c.rolling(n).cov(v), "returns": c.ffill().pct_change(),
        "ts_downside_std(ts_delta(close,1),5)": c.diff().where(c.diff() < 0, 0.0).rolling(n).std(),
        "cs_rank(close)": c.rank(axis=1), "cs_percentile(close)": c.rank(axis=1, pct=True), "cs_demean(close)": c.sub(c.mean(axis=1), axis=0), "cs_zscore(close)": c.sub(c.mean(axis=1), axis=0).div(c.std(axis=1), axis=0),
        "cs_winsor(close,0.1)": c.clip(c.quantile(0.1, axis=1), c.quantile(0.9, axis=1), axis=0), "min(close,volume)": np.minimum(c, v), "max(close,volume)": np.maximum(c, v),
        "clip(close,98,101)": c.clip(98, 101), "signed_power(close-100,0.5)": np.sign(c - 100) * np.abs(c - 100) ** 0.5,
    }
    got = computed(panel, **{f"x{k}": e for k, e in enumerate(want)})
    for k, (expression, df) in enumerate(want.items()):
        np.testing.assert_allclose(got[f"x{k}"].to_numpy(), df.to_numpy(), rtol=1e-9, atol=1e-7, err_msg=expression)


def test_flat_windows_and_zero_divisors(panel):
    got = computed(panel, z="ts_zscore(close,5)", r="ts_corr(close,volume,5)", s="ts_skew(close,5)", d="divide(close,volume-volume)")
    assert np.isnan(got["z"].iloc[14, 3]) and np.isnan(got["r"].iloc[14, 3]) and got["s"].iloc[14, 3] == 0 and got["d"].isna().all().all()


def test_one_exchange_for_each_alternation(panel):
    plan = evaluate(panel, {f"x{n}": parse(f"ts_mean(close,{n})+ts_std(volume,{n})") for n in range(2, 9)})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_infinite_values_are_missing_in_windows(spark):
    rows = [(f"2021-01-0{k}", "a", 0, float("inf") if k == 2 else float(k)) for k in range(1, 6)]
    df = spark.createDataFrame(rows, "ts string, symbol string, sym_ord int, close double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [r.v for r in evaluate(df, {"v": parse("ts_mean(close,2)")}).orderBy("ts").collect()]
    assert got == [None, None, None, 3.5, 4.5]


def test_no_operator_looks_ahead(spark):
    panel = panels.synthetic(spark, 4, 60)
    ops = [n for n, o in kernels.OPERATORS.items() if o.kind == "ts"]
    assert len(ops) == 17
    call = {2: "{}(close,5)", 3: "{}(close,volume,5)"}
    assert_no_lookahead(panel, [make_factor(n, call[kernels.OPERATORS[n].arity].format(n)) for n in ops])


def test_a_leak_is_found(spark):
    kernels.register("ts_peek", "ts", 2, lambda x, n, keys: F.lead(x, n).over(kernels.over_symbol(keys)), windows=(1,))
    try:
        with pytest.raises(CausalityError):
            assert_no_lookahead(panels.synthetic(spark, 3, 50), [make_factor("leak", "ts_peek(close,2)")])
    finally:
        del kernels.OPERATORS["ts_peek"]
