"""Registered queries of the factor engine, with their SQL."""

from __future__ import annotations

import statistics
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswind.operators import analytics, dedup, generate, preprocess, registry, robustness, stats, study, universe
from crosswind.plans import catalogue_sql as sql
from crosswind.plans.compiler import evaluate, family_scores
from crosswind.plans.language import make_factor, parse
from crosswind.sources import panels

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            ORACLE_SQL[name] = text
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, and -0 made 0, as in the SQL; what lies half-way is moved up a little, as engines differ there."""
    return df.select(*((F.round(F.col(c) + 3 * 10.0 ** -(places + 2), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def expression_query(name: str, expression: str, text: str, places: int = 6) -> None:
    def run(spark, sf_dir):
        return rounded(evaluate(panels.trade_panel(spark, sf_dir), {"v": parse(expression)}).select("ts", "symbol", "v"), places)

    QUERIES[name], ORACLE_SQL[name] = run, text


for _query in sql.EXPRESSIONS:
    expression_query(*_query)


@query("panel_ohlcv", sql.PANEL_OHLCV)
def panel_ohlcv(spark, sf_dir):
    return rounded(panels.trade_panel(spark, sf_dir))


@query("panel_filled", sql.PANEL_FILLED)
def panel_filled(spark, sf_dir):
    return rounded(panels.filled(panels.trade_panel(spark, sf_dir)))


@query("panel_grid", sql.PANEL_GRID)
def panel_grid(spark, sf_dir):
    p = panels.trade_panel(spark, sf_dir)
    return p.agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("ts").alias("times"), F.countDistinct("symbol").alias("symbols"), F.count("close").alias("filled"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("forward_returns", sql.FORWARD)
def forward_returns(spark, sf_dir):
    return rounded(panels.with_forward(panels.trade_panel(spark, sf_dir), 1, 5).select("ts", "symbol", "fwd_1", "fwd_5"))


@query("subset_by_date", sql.SUBSET)
def subset_by_date(spark, sf_dir):
    p = panels.subset(panels.trade_panel(spark, sf_dir), "1995-01-02", "1996-12-30")
    return rounded(evaluate(p, {"v": parse("ts_mean(close,5)")}).select("ts", "symbol", "v"))


FACTORS = {"momentum": "ts_returns(close,4)", "reversal": "neg(ts_zscore(close,5))", "volume": "cs_rank(divide(volume,ts_mean(volume,5)))"}


def judged(spark, sf_dir, config=preprocess.Preprocess(), eligible=None, horizons=(1,), factors=FACTORS):
    """Long preprocessed scores of a few factors, with forward returns."""
    panel = panels.with_forward(panels.trade_panel(spark, sf_dir), *horizons)
    keep = tuple(f"fwd_{h}" for h in horizons)
    scores = family_scores(panel, [make_factor(k, v) for k, v in factors.items()], keep)
    return preprocess.preprocessed(scores, config, eligible).withColumn("fwd", F.col(keep[0]))


def members(spark, sf_dir):
    """A made-up membership: a symbol is in from the tenth bar of its own order on, apart from every seventh bar."""
    p = panels.trade_panel(spark, sf_dir).select("ts", "symbol", "sym_ord")
    day = F.floor(F.unix_timestamp("ts") / 604800).cast("long")
    return p.select("ts", "symbol", ((day + F.col("sym_ord")) % 7 != 0).alias("member"))


@query("preprocess_default", sql.PREPROCESS)
def preprocess_default(spark, sf_dir):
    return rounded(judged(spark, sf_dir).select("factor_id", "ts", "symbol", "score"))


@query("preprocess_neutral_lagged", sql.PREPROCESS_LAGGED)
def preprocess_lagged(spark, sf_dir):
    return rounded(judged(spark, sf_dir, preprocess.Preprocess(neutralize=True, lag=2)).select("factor_id", "ts", "symbol", "score"))


@query("coverage", sql.COVERAGE)
def coverage_query(spark, sf_dir):
    scores = family_scores(panels.trade_panel(spark, sf_dir), [make_factor(k, v) for k, v in FACTORS.items()])
    return rounded(preprocess.coverage(scores))


@query("eligibility_pit", sql.ELIGIBILITY)
def eligibility_pit(spark, sf_dir):
    return rounded(judged(spark, sf_dir, eligible=universe.eligibility(members(spark, sf_dir))).select("factor_id", "ts", "symbol", "score"))


@query("survivorship", sql.SURVIVORSHIP)
def survivorship(spark, sf_dir):
    panel = panels.trade_panel(spark, sf_dir)
    deaths = panel.select("symbol", "sym_ord").distinct().filter("sym_ord % 5 = 0").select("symbol", F.lit("1996-01-01").cast("timestamp").alias("death"))
    return universe.survivorship_stressed(universe.static(panel), deaths)


def flagship(spark, sf_dir):
    """IC statistics of a momentum factor on the monthly panel."""
    panel = panels.with_forward(panels.trade_panel(spark, sf_dir, "month"), 1)
    scores = family_scores(panel, [make_factor("momentum", "ts_returns(close,4)")], ("fwd_1",))
    return rounded(analytics.ic_stats(analytics.ic_series(preprocess.preprocessed(scores).withColumn("fwd", F.col("fwd_1")), "spearman")))


@query("ic_pearson", sql.IC_PEARSON)
def ic_pearson(spark, sf_dir):
    return rounded(analytics.ic_series(judged(spark, sf_dir)))


@query("ic_spearman", sql.IC_SPEARMAN)
def ic_spearman(spark, sf_dir):
    return rounded(analytics.ic_series(judged(spark, sf_dir), "spearman"))


@query("ic_stats", sql.IC_STATS)
def ic_stats_query(spark, sf_dir):
    return rounded(analytics.ic_stats(analytics.ic_series(judged(spark, sf_dir), "spearman")))


@query("ic_decay", sql.IC_DECAY)
def ic_decay_query(spark, sf_dir):
    return rounded(analytics.ic_decay(judged(spark, sf_dir, horizons=(1, 2, 3, 5, 10))))


@query("quantile_buckets", sql.BUCKETS)
def quantile_buckets(spark, sf_dir):
    return analytics.quantile_buckets(judged(spark, sf_dir)).select("factor_id", "ts", "symbol", "bucket")


@query("quantile_returns", sql.QUANTILE_RETURNS)
def quantile_returns(spark, sf_dir):
    return rounded(analytics.quantile_returns(analytics.quantile_buckets(judged(spark, sf_dir))))


@query("long_short", sql.LONG_SHORT)
def long_short(spark, sf_dir):
    return rounded(analytics.long_short(analytics.quantile_buckets(judged(spark, sf_dir))))


@query("turnover", sql.TURNOVER)
def turnover(spark, sf_dir):
    return rounded(analytics.turnover(analytics.quantile_buckets(judged(spark, sf_dir))))


@query("score_autocorr", sql.AUTOCORR)
def score_autocorr(spark, sf_dir):
    return rounded(analytics.score_autocorr(judged(spark, sf_dir)))


@query("portfolio_stats", sql.PORTFOLIO)
def portfolio_stats(spark, sf_dir):
    return rounded(analytics.portfolio_stats(judged(spark, sf_dir)))


@query("backtest", sql.BACKTEST)
def backtest(spark, sf_dir):
    scores = judged(spark, sf_dir).withColumn("fwd", F.col("fwd") / 1000)  # the table's prices are drawn anew every week
    return rounded(analytics.backtest(scores, cost_bps=0.005))


@query("cost_sensitivity", sql.COSTS)
def cost_sensitivity(spark, sf_dir):
    return rounded(analytics.cost_sensitivity(analytics.portfolio_stats(judged(spark, sf_dir))).select("factor_id", "bps", "net_sharpe"))


@query("adv_profile", sql.ADV)
def adv_profile(spark, sf_dir):
    return rounded(analytics.adv_profile(panels.trade_panel(spark, sf_dir)), 4)


@query("regime_labels", sql.REGIMES)
def regime_labels(spark, sf_dir):
    return rounded(robustness.regime_labels(panels.filled(panels.trade_panel(spark, sf_dir)), 20))


@query("regime_ic", sql.REGIME_IC)
def regime_ic(spark, sf_dir):
    labels = robustness.regime_labels(panels.filled(panels.trade_panel(spark, sf_dir)), 20)
    return rounded(robustness.regime_ics(analytics.ic_series(judged(spark, sf_dir)), labels))


@query("subperiod", sql.SUBPERIOD)
def subperiod(spark, sf_dir):
    return rounded(robustness.subperiods(analytics.ic_series(judged(spark, sf_dir))))


@query("walk_forward", sql.WALK_FORWARD)
def walk_forward(spark, sf_dir):
    return rounded(robustness.walk_forward(analytics.ic_series(judged(spark, sf_dir))))


@query("walk_forward_sharpe", sql.WALK_FORWARD_SHARPE)
def walk_forward_sharpe(spark, sf_dir):
    scores = judged(spark, sf_dir)
    rows = robustness.walk_forward(analytics.ic_series(scores), ls=analytics.long_short(analytics.quantile_buckets(scores)))
    return rounded(rows.select("factor_id", "window", "n", "mean_ic", "sharpe"))


@query("walk_forward_summary", sql.WALK_FORWARD_SUMMARY)
def walk_forward_summary(spark, sf_dir):
    scores = judged(spark, sf_dir)
    return rounded(robustness.walk_forward_summary(analytics.ic_series(scores), analytics.long_short(analytics.quantile_buckets(scores))))


@query("stability", sql.STABILITY)
def stability(spark, sf_dir):
    return rounded(robustness.stability(robustness.subperiods(analytics.ic_series(judged(spark, sf_dir)))))


@query("param_sensitivity", sql.SENSITIVITY)
def param_sensitivity(spark, sf_dir):
    got = robustness.parameter_sensitivity(panels.trade_panel(spark, sf_dir), "ts_mean(close,{w})", (3, 5, 8))
    return rounded(spark.createDataFrame(list(got.items()), "w int, mean_ic double"))


@query("param_verdict", sql.SENSITIVITY_VERDICT)
def param_verdict(spark, sf_dir):
    got = robustness.sensitivity(robustness.parameter_sensitivity(panels.trade_panel(spark, sf_dir), "ts_mean(close,{w})", (3, 5, 8)))
    return rounded(spark.createDataFrame([(got.mean_ic, got.dispersion, got.consistency, got.robust)], "mean_ic double, dispersion double, consistency double, robust boolean"))


def p_values(spark, sf_dir):
    """Made-up p-values, with ties: a family for each nation, a factor for each customer."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select(F.col("c_nationkey").alias("family"), F.col("c_custkey").alias("factor_id"), (F.pow((F.col("c_custkey") * 7919 % 1000) / F.lit(1000.0), F.lit(3.0))).alias("p"))


@query("bh", sql.BH)
def bh(spark, sf_dir):
    return rounded(stats.benjamini_hochberg(p_values(spark, sf_dir)).select("family", "factor_id", "rank", "p_fdr", "fdr_reject"))


@query("holm", sql.HOLM)
def holm(spark, sf_dir):
    return rounded(stats.holm(p_values(spark, sf_dir)).select("family", "factor_id", "rank", "p_holm", "holm_reject"))


@query("dsr_moments", sql.MOMENTS)
def dsr_moments(spark, sf_dir):
    return rounded(stats.return_moments(analytics.long_short(analytics.quantile_buckets(judged(spark, sf_dir)))))


@query("pbo_cscv", sql.CSCV)
def pbo_cscv(spark, sf_dir):
    return rounded(stats.cscv_ranks(analytics.long_short(analytics.quantile_buckets(judged(spark, sf_dir))), 6))


def bars(spark, sf_dir) -> list:
    """The weekly panel's timestamps, which are few whatever the table's size."""
    return sorted(r[0] for r in panels.trade_panel(spark, sf_dir).select("ts").distinct().collect())


@query("purged_kfold", sql.PURGED)
def purged_kfold(spark, sf_dir):
    """Bars in training, by fold."""
    times = bars(spark, sf_dir)
    folds = stats.purged_folds(len(times), 5, 2, 3)
    return spark.createDataFrame([(k, len(train), times[train[0]], times[train[-1]]) for k, (train, _) in enumerate(folds)], "fold int, n_train long, first_ts timestamp, last_ts timestamp")


@query("cpcv_splits", sql.CPCV)
def cpcv_splits(spark, sf_dir):
    """Test and purged training sizes of every combination of two of six groups of bars."""
    splits = stats.cpcv_splits(len(bars(spark, sf_dir)), 6, 2, 2, 3)
    return spark.createDataFrame([(k, len(train), len(test), min(test), max(test)) for k, (train, test) in enumerate(splits)], "split int, n_train long, n_test long, first_test long, last_test long")


def matrix(spark, sf_dir):
    """Long-short returns of the factors, bars by factors, of bars that all have."""
    rows = analytics.long_short(analytics.quantile_buckets(judged(spark, sf_dir))).groupBy("ts").pivot("factor_id", list(FACTORS)).agg(F.first("ls")).dropna().orderBy("ts").toPandas()
    return rows[list(FACTORS)].to_numpy()


@query("pbo_value", sql.PBO)
def pbo_value(spark, sf_dir):
    m = matrix(spark, sf_dir)
    return rounded(spark.createDataFrame([(stats.pbo_cscv(m, 6)[0], len(m))], "pbo double, n long"))


@query("dsr_value", sql.DSR)
def dsr_value(spark, sf_dir):
    rows = stats.return_moments(analytics.long_short(analytics.quantile_buckets(judged(spark, sf_dir)))).collect()  # a row for each factor
    known = [r["sr"] for r in rows if r["sr"] is not None]
    variance = statistics.variance(known) if len(known) > 1 else None
    got = [(r["factor_id"], stats.expected_max_sharpe(3, variance or 0.0), stats.deflated_sharpe(r["n"], r["sr"], r["skew"], r["kurt"], 3, variance)) for r in rows]
    return rounded(spark.createDataFrame(got, "factor_id string, expected_max double, dsr double"), 5)


@query("ic_pvalue", sql.PVALUE)
def ic_pvalue(spark, sf_dir):
    rows = analytics.ic_stats(analytics.ic_series(judged(spark, sf_dir), "spearman")).collect()  # a row for each factor
    return rounded(spark.createDataFrame([(r["factor_id"], stats.ic_pvalue(r["t_stat"], r["n"])) for r in rows], "factor_id string, p double"), 5)


@query("dedup_pairs", sql.DEDUP)
def dedup_pairs(spark, sf_dir):
    return rounded(dedup.score_correlations(judged(spark, sf_dir)))


@query("dedup_nearest", sql.NEAREST)
def dedup_nearest(spark, sf_dir):
    return rounded(dedup.nearest(dedup.score_correlations(judged(spark, sf_dir))))


@query("novelty", sql.NOVELTY)
def novelty(spark, sf_dir):
    """Factors against each other, one of them there twice and one turned round."""
    factors = FACTORS | {"again": FACTORS["momentum"], "against": "neg(ts_returns(close,4))"}
    specs = [make_factor(k, v) for k, v in factors.items()]
    got = dedup.novelty(specs, judged(spark, sf_dir, factors=factors))
    rows = [(n.factor_id, n.family, len(n.same), len(n.alike), n.duplicate) for n in got.values()]
    return spark.createDataFrame(rows, "factor_id string, family string, same long, alike long, duplicate boolean")


@query("capacity", sql.CAPACITY)
def capacity(spark, sf_dir):
    """Assets at which costs take a factor's return, with the panel's volumes: a row of numbers for each factor and symbol."""
    model = analytics.CostModel()
    profile = [(r["adv"], r["vol"]) for r in analytics.adv_profile(panels.trade_panel(spark, sf_dir)).collect()]
    rows = analytics.portfolio_stats(judged(spark, sf_dir)).collect()
    got = [(r["factor_id"], analytics.capacity(abs(r["gross"]), [a for a, _ in profile], [v for _, v in profile], r["turnover"], len(profile), model)) for r in rows]
    return rounded(spark.createDataFrame(got, "factor_id string, capacity_usd double").select("factor_id", F.log10(F.col("capacity_usd") + 1).alias("log_capacity")))


@query("family_metrics", sql.METRICS)
def family_metrics(spark, sf_dir):
    """What a study measures of each factor that has ICs."""
    specs = [make_factor(k, v) for k, v in FACTORS.items()]
    got, scores, ls = study.evaluate_family(panels.trade_panel(spark, sf_dir), specs)
    scores.unpersist()
    ls.unpersist()
    names = ("n_periods", "mean_ic", "ic_t_stat", "sharpe", "turnover", "coverage", "autocorr")
    return rounded(spark.createDataFrame([(k, *(m[n] for n in names)) for k, m in got.items() if m["n_periods"]], "factor_id string, n_periods long, " + ", ".join(f"{n} double" for n in names[1:])))


@query("decisions", sql.DECISIONS)
def decisions(spark, sf_dir):
    """Gates over made-up measures, missing ones among them: a supplier for each candidate."""
    x = F.col("s_acctbal") / 10000
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.when(F.col("s_suppkey") % 7 != 0, x / 10).alias("ic"), (x * 6).alias("t"), F.abs(x).alias("gone"), (F.col("s_suppkey") % 11 == 0).alias("dup"), (F.col("s_suppkey") % 3 != 0).alias("fdr"), F.abs(1 - x).alias("dsr"), F.when(F.col("s_suppkey") % 5 != 0, x * x).alias("near"))

    def decide(frames):
        for f in frames:
            some = lambda v: None if v is None or v != v else v
            f["state"] = [study.decide({"mean_ic": some(r.ic), "ic_t_stat": r.t, "turnover": r.gone}, r.dup, r.fdr, r.dsr, some(r.near))[0].value for r in f.itertuples()]
            yield f[["s_suppkey", "state"]]

    return rows.mapInPandas(decide, "s_suppkey long, state string")


@query("source_long", sql.PANEL_OHLCV)
def source_long(spark, sf_dir):
    """The weekly panel, written as long Parquet and read through that source."""
    folder, p = f"{panels.shared_folder(spark)}/long-{uuid4()}", panels.trade_panel(spark, sf_dir)
    rows = p.select(F.col("ts").alias("timestamp"), "symbol", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in panels.FIELDS))).alias("x")).select("timestamp", "symbol", "x.*")
    rows.write.parquet(folder)
    return rounded(panels.read_long(spark, folder).select("ts", "symbol", "sym_ord", *panels.FIELDS))


@query("source_csv", sql.PANEL_OHLCV)
def source_csv(spark, sf_dir):
    """The weekly panel, written as wide CSV files and read through that source."""
    folder, p = f"{panels.shared_folder(spark)}/wide-{uuid4()}", panels.trade_panel(spark, sf_dir)
    for c in panels.FIELDS:
        p.groupBy(F.col("ts").alias("timestamp")).pivot("symbol").agg(F.first(c)).coalesce(1).write.option("header", True).csv(f"{folder}/{c}.csv")
    return rounded(panels.read_csv_dir(spark, folder).select("ts", "symbol", "sym_ord", *panels.FIELDS))


@query("data_split", sql.SPLIT)
def data_split(spark, sf_dir):
    panel = panels.trade_panel(spark, sf_dir)
    split = registry.split_by_fraction(panel)
    part = F.when(split.condition("train"), "train").when(split.condition("valid"), "valid").otherwise("test")
    return panel.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def recorded(spark, sf_dir) -> registry.Registry:
    """A registry of suppliers as experiments: the family is the nation, the parent the supplier of half the key."""
    r = registry.Registry(spark, f"{panels.shared_folder(spark)}/registry-{uuid4()}")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey").collect()  # candidates are what a user tries
    r.record({"experiment_id": f"e{k}", "family": f"f{n}", "factor_id": str(k), "parent_id": str(k // 2) if k > 1 else None, "expression": "close", "expression_hash": str(k), "seed": 0} for k, n in rows)
    return r


@query("registry_trial_counts", sql.TRIALS)
def registry_trial_counts(spark, sf_dir):
    """Experiments of a registry by family and latest status, after those in debt were rejected."""
    r = recorded(spark, sf_dir)
    debts = spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_acctbal < 0").select("s_suppkey").collect()
    r.update({f"e{k}": {"status": "rejected_in_development"} for (k,) in debts})
    return r.experiments().groupBy("family", "status").agg(F.count(F.lit(1)).alias("trials"))


@query("lineage", sql.LINEAGE)
def lineage(spark, sf_dir):
    """Chains of parents in a registry, each supplier's being the one with half its key."""
    rows = recorded(spark, sf_dir).generations()
    return rows.select(F.col("factor_id").cast("long").alias("start"), F.col("generations").cast("int").alias("generations"), F.col("root").cast("long").alias("root"))


@query("family_study")
def family_study(spark, sf_dir):
    """Decisions on a family of templates over the weekly panel, with its tests and registry: no SQL, as they rest on bootstraps."""
    store = registry.Registry(spark, f"{panels.shared_folder(spark)}/registry-{uuid4()}")
    panel = panels.settled(panels.filled(panels.trade_panel(spark, sf_dir)))
    done = study.run_family_study(panel, generate.from_templates((5, 10)), "templates", store, universe=universe.static_universe(panel))
    names = ("mean_ic", "ic_t_stat", "turnover", "p_value", "p_fdr", "dsr", "pbo", "white_rc_p", "spa_p")
    rows = [(r.spec.factor_id, r.state.value, r.statistics.get("semantic_family"), store_n, *((r.metrics | r.statistics).get(n) for n in names)) for r, store_n in ((r, done.statistics["trial_count"]) for r in done.results)]
    return rounded(spark.createDataFrame(rows, "factor_id string, state string, semantic string, trials long, " + ", ".join(f"{n} double" for n in names)))


@query("bootstrap_tests")
def bootstrap_tests(spark, sf_dir):
    """Interval, White's and Hansen's p and overfitting probabilities of three factors: seeded draws, which SQL can't make."""
    m = matrix(spark, sf_dir)
    ci = stats.block_bootstrap(m[:, 0], "sharpe")
    got = [("ci_low", ci.low), ("ci_high", ci.high), ("white_rc", stats.reality_check(m)), ("spa", stats.superior_ability(m)), ("pbo_cscv", stats.pbo_cscv(m)[0]), ("pbo_cpcv", stats.pbo_cpcv(m)[0]), ("cpcv_median", stats.cpcv_paths(m[:, 0]).median)]
    return rounded(spark.createDataFrame(got, "statistic string, value double"))
