"""DuckDB SQL for the registered queries, written apart from the operators."""

from __future__ import annotations


def panel(grain: str = "week") -> str:
    return f"""
t AS (
  SELECT date_trunc('{grain}', l_shipdate)::TIMESTAMP AS ts, p_brand AS symbol, l_extendedprice / l_quantity AS price, l_quantity AS q, l_extendedprice AS x,
    row_number() OVER (PARTITION BY date_trunc('{grain}', l_shipdate), p_brand ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS a,
    row_number() OVER (PARTITION BY date_trunc('{grain}', l_shipdate), p_brand ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS z
  FROM lineitem JOIN part ON p_partkey = l_partkey
), cells AS (
  SELECT ts, symbol, max(CASE WHEN a = 1 THEN price END) AS open, max(price) AS high, min(price) AS low, max(CASE WHEN z = 1 THEN price END) AS close, sum(q) AS volume, sum(x) / sum(q) AS vwap
  FROM t GROUP BY ts, symbol
), syms AS (SELECT symbol, (row_number() OVER (ORDER BY symbol) - 1)::INT AS sym_ord FROM (SELECT DISTINCT symbol FROM cells)),
p AS (
  SELECT g.ts, s.symbol, s.sym_ord, open, high, low, close, volume, vwap
  FROM (SELECT DISTINCT ts FROM cells) g CROSS JOIN syms s LEFT JOIN cells c ON c.ts = g.ts AND c.symbol = s.symbol
)"""


P = panel()
BYS = "PARTITION BY symbol ORDER BY ts"


def w(n: int) -> str:
    return f"WINDOW w AS ({BYS} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), o AS ({BYS}), c AS (PARTITION BY ts)"


def r(x: str, places: int = 6) -> str:
    return f"round(({x}) + {3 * 10.0 ** -(places + 2)!r}, {places}) + 0.0"


def simple(value: str, n: int = 5, places: int = 6) -> str:
    return f"WITH {P} SELECT ts, symbol, {r(value, places)} AS v FROM p {w(n)}"


def rolling(agg: str, n: int = 5, places: int = 6) -> str:
    return simple(f"CASE WHEN count(close) OVER w = {n} THEN {agg} OVER w END", n, places)


def listed(value: str, n: int = 5) -> str:
    return f"WITH {P}, l AS (SELECT ts, symbol, close AS x, list(close) OVER w AS l, count(close) OVER w AS n FROM p {w(n)}) SELECT ts, symbol, {r(f'CASE WHEN n = {n} THEN {value} END')} AS v FROM l"


def ewm(n: int) -> str:
    keep = 1 - 2 / (n + 1)
    fold = lambda e: f"list_reduce(list_prepend(0.0::DOUBLE, l), lambda a, e: a * {keep!r} + {e})"
    return f"""WITH {P}, l AS (SELECT ts, symbol, list(close) OVER w AS l, count(close) OVER w AS n FROM p WINDOW w AS ({BYS} ROWS UNBOUNDED PRECEDING))
SELECT ts, symbol, {r(f"CASE WHEN n >= {n} THEN {fold('coalesce(e, 0.0)')} / nullif({fold('CASE WHEN e IS NULL THEN 0.0 ELSE 1.0 END')}, 0) END")} AS v FROM l"""


def pairwise(value: str, n: int = 5, places: int = 6) -> str:
    return f"WITH {P}, b AS (SELECT ts, symbol, CASE WHEN close IS NOT NULL AND volume IS NOT NULL THEN close END AS x, CASE WHEN close IS NOT NULL AND volume IS NOT NULL THEN volume END AS y FROM p) SELECT ts, symbol, {r(f'CASE WHEN count(x) OVER w = {n} THEN {value} END', places)} AS v FROM b {w(n)}"


RANK = "CASE WHEN close IS NOT NULL THEN rank() OVER (PARTITION BY ts ORDER BY close ASC NULLS LAST) + (count(close) OVER (PARTITION BY ts, close) - 1) / 2.0 END"
RETURNS = ", k AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS f FROM p)"
SKEWED = "CASE WHEN max(close) OVER w = min(close) OVER w THEN 0.0 ELSE skewness(close) OVER w END"

EXPRESSIONS = [
    ("ts_delay", "ts_delay(close,5)", simple("lag(close, 5) OVER o")),
    ("ts_delta", "ts_delta(close,5)", simple("close - lag(close, 5) OVER o")),
    ("ts_returns", "ts_returns(close,5)", simple("close / nullif(lag(close, 5) OVER o, 0) - 1")),
    ("ts_mean", "ts_mean(close,5)", rolling("avg(close)")),
    ("ts_std", "ts_std(close,5)", rolling("stddev_samp(close)")),
    ("ts_min", "ts_min(close,5)", rolling("min(close)")),
    ("ts_max", "ts_max(close,5)", rolling("max(close)")),
    ("ts_sum", "ts_sum(close,5)", rolling("sum(close)", places=4), 4),
    ("ts_rank", "ts_rank(close,5)", listed("len(list_filter(l, lambda e: e <= x)) / 5.0")),
    ("ts_ewm", "ts_ewm(close,5)", ewm(5)),
    ("ts_corr", "ts_corr(close,volume,5)", pairwise("covar_samp(x, y) OVER w / nullif(stddev_samp(x) OVER w * stddev_samp(y) OVER w, 0)")),
    ("ts_cov", "ts_cov(close,volume,5)", pairwise("covar_samp(x, y) OVER w", places=2), 2),
    ("ts_downside_std", "ts_downside_std(ts_returns(close,1),5)", f"WITH {P}, d AS (SELECT ts, symbol, close / nullif(lag(close) OVER ({BYS}), 0) - 1 AS x FROM p) SELECT ts, symbol, {r('CASE WHEN count(*) OVER w = 5 THEN stddev_samp(CASE WHEN x < 0 THEN x ELSE 0.0 END) OVER w END')} AS v FROM d {w(5)}"),
    ("ts_skew", "ts_skew(close,5)", simple(f"CASE WHEN count(close) OVER w = 5 THEN {SKEWED} END")),
    ("ts_zscore", "ts_zscore(close,5)", simple("CASE WHEN count(close) OVER w = 5 THEN (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) END")),
    ("ts_argmax", "ts_argmax(close,5)", listed("5.0 - list_position(l, list_max(l))")),
    ("ts_argmin", "ts_argmin(close,5)", listed("5.0 - list_position(l, list_min(l))")),
    ("returns_field", "returns", f"WITH {P}{RETURNS} SELECT ts, symbol, {r('f / nullif(lag(f) OVER o, 0) - 1')} AS v FROM k {w(5)}"),
    ("cs_rank", "cs_rank(close)", simple(RANK)),
    ("cs_percentile", "cs_percentile(close)", simple(f"({RANK}) / nullif(count(close) OVER c, 0)")),
    ("cs_zscore", "cs_zscore(close)", simple("(close - avg(close) OVER c) / nullif(stddev_samp(close) OVER c, 0)")),
    ("cs_demean", "cs_demean(close)", simple("close - avg(close) OVER c", places=4), 4),
    ("cs_neutralize", "cs_neutralize(close)", simple("close - avg(close) OVER c", places=4), 4),
    ("cs_winsor", "cs_winsor(close,0.1)", simple("CASE WHEN close IS NOT NULL THEN greatest(quantile_cont(close, 0.1) OVER c, least(quantile_cont(close, 0.9) OVER c, close)) END")),
    ("arith_add", "close + volume", simple("close + volume", places=4), 4),
    ("arith_subtract", "close - open", simple("close - open")),
    ("arith_multiply", "close * volume", simple("close * volume", places=4), 4),
    ("arith_divide", "divide(close, close - open)", simple("close / nullif(close - open, 0)")),
    ("arith_signed_power", "signed_power(close - open, 0.5)", simple("sign(close - open) * pow(abs(close - open), 0.5)")),
    ("arith_abs", "abs(close - open)", simple("abs(close - open)")),
    ("arith_neg", "-close", simple("-close")),
    ("arith_min", "min(close, vwap)", simple("CASE WHEN close IS NOT NULL AND vwap IS NOT NULL THEN least(close, vwap) END")),
    ("arith_max", "max(close, vwap)", simple("CASE WHEN close IS NOT NULL AND vwap IS NOT NULL THEN greatest(close, vwap) END")),
    ("arith_clip", "clip(cs_zscore(close), -1, 1)", f"WITH {P}, z AS (SELECT ts, symbol, (close - avg(close) OVER (PARTITION BY ts)) / nullif(stddev_samp(close) OVER (PARTITION BY ts), 0) AS x FROM p) SELECT ts, symbol, {r('CASE WHEN x IS NOT NULL THEN greatest(-1, least(1, x)) END')} AS v FROM z"),
    ("nested_ts_cs_ts", "ts_mean(cs_rank(ts_returns(close,2)),3)", f"""WITH {P}, a AS (SELECT ts, symbol, close / nullif(lag(close, 2) OVER ({BYS}), 0) - 1 AS x FROM p),
b AS (SELECT ts, symbol, CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY ts ORDER BY x ASC NULLS LAST) + (count(x) OVER (PARTITION BY ts, x) - 1) / 2.0 END AS y FROM a)
SELECT ts, symbol, {r('CASE WHEN count(y) OVER w = 3 THEN avg(y) OVER w END')} AS v FROM b {w(3)}"""),
]

FLD = ("open", "high", "low", "close", "volume", "vwap")
PANEL_OHLCV = f"WITH {P} SELECT ts, symbol, sym_ord, {', '.join(f'{r(c)} AS {c}' for c in FLD)} FROM p"
PANEL_FILLED = f"WITH {P} SELECT ts, symbol, sym_ord, " + ", ".join(f"{r(f'last_value({c} IGNORE NULLS) OVER f')} AS {c}" for c in FLD if c != "volume") + f", {r('coalesce(volume, 0.0)')} AS volume FROM p WINDOW f AS ({BYS} ROWS UNBOUNDED PRECEDING)"
PANEL_GRID = f"WITH {P} SELECT count(*) AS cells, count(DISTINCT ts) AS times, count(DISTINCT symbol) AS symbols, count(close) AS filled, min(ts) AS first_ts, max(ts) AS last_ts FROM p"
FORWARD = f"WITH {P} SELECT ts, symbol, {r('lead(close, 1) OVER o / nullif(close, 0) - 1')} AS fwd_1, {r('lead(close, 5) OVER o / nullif(close, 0) - 1')} AS fwd_5 FROM p {w(1)}"
SUBSET = f"WITH {P}, s AS (SELECT * FROM p WHERE ts BETWEEN TIMESTAMP '1995-01-02' AND TIMESTAMP '1996-12-30') SELECT ts, symbol, {r('CASE WHEN count(close) OVER w = 5 THEN avg(close) OVER w END')} AS v FROM s {w(5)}"

FWDS = ", ".join(f"lead(close, {h}) OVER o / nullif(close, 0) - 1 AS fwd_{h}" for h in (1, 2, 3, 5, 10))
RAW = f"""{P}, f AS (
  SELECT ts, symbol, sym_ord, close / nullif(lag(close, 4) OVER o, 0) - 1 AS momentum,
    CASE WHEN count(close) OVER w = 5 THEN -(close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) END AS reversal,
    volume / nullif(CASE WHEN count(volume) OVER w = 5 THEN avg(volume) OVER w END, 0) AS ratio, {FWDS}
  FROM p {w(5)}
), g AS (
  SELECT *, CASE WHEN ratio IS NOT NULL THEN rank() OVER (PARTITION BY ts ORDER BY ratio ASC NULLS LAST) + (count(ratio) OVER (PARTITION BY ts, ratio) - 1) / 2.0 END AS volume FROM f
), raw AS (
  SELECT 'momentum' AS factor_id, ts, symbol, sym_ord, momentum AS score, fwd_1, fwd_2, fwd_3, fwd_5, fwd_10 FROM g
  UNION ALL SELECT 'reversal', ts, symbol, sym_ord, reversal, fwd_1, fwd_2, fwd_3, fwd_5, fwd_10 FROM g
  UNION ALL SELECT 'volume', ts, symbol, sym_ord, volume, fwd_1, fwd_2, fwd_3, fwd_5, fwd_10 FROM g
)"""
FT = "PARTITION BY factor_id, ts"


def preprocessed(source: str = "raw") -> str:
    return f""", covered AS (
  SELECT * REPLACE (CASE WHEN count(score) OVER ({FT}) * 1.0 / count(*) OVER ({FT}) >= 0.5 THEN score END AS score) FROM {source}
), winsored AS (
  SELECT * REPLACE (CASE WHEN score IS NOT NULL THEN greatest(quantile_cont(score, 0.02) OVER ({FT}), least(quantile_cont(score, 0.98) OVER ({FT}), score)) END AS score) FROM covered
), s AS (
  SELECT * REPLACE ((score - avg(score) OVER ({FT})) / nullif(stddev_samp(score) OVER ({FT}), 0) AS score), fwd_1 AS fwd FROM winsored
)"""


S = RAW + preprocessed()
PREPROCESS = f"WITH {S} SELECT factor_id, ts, symbol, {r('score')} AS score FROM s"
PREPROCESS_LAGGED = f"WITH {S}, d AS (SELECT factor_id, ts, symbol, score - avg(score) OVER ({FT}) AS score FROM s) SELECT factor_id, ts, symbol, {r('lag(score, 2) OVER (PARTITION BY factor_id, symbol ORDER BY ts)')} AS score FROM d"
COVERAGE = f"WITH {RAW} SELECT factor_id, ts, {r('count(score) * 1.0 / count(*)')} AS coverage FROM raw GROUP BY factor_id, ts"
MEMBERS = ", m AS (SELECT ts, symbol, (floor(epoch(ts) / 604800)::BIGINT + sym_ord) % 7 <> 0 AS member FROM p), e AS (SELECT ts, symbol, coalesce(lag(member) OVER (PARTITION BY symbol ORDER BY ts), false) AS eligible FROM m), elig AS (SELECT raw.* REPLACE (CASE WHEN eligible THEN score END AS score) FROM raw LEFT JOIN e USING (ts, symbol))"
ELIGIBILITY = f"WITH {RAW}{MEMBERS}{preprocessed('elig')} SELECT factor_id, ts, symbol, {r('score')} AS score FROM s"
SURVIVORSHIP = f"WITH {P} SELECT ts, symbol, NOT (sym_ord % 5 = 0 AND ts >= TIMESTAMP '1996-01-01') AS member FROM p"

IC = f"""{S}, pairs AS (SELECT factor_id, ts, score AS x, fwd AS y FROM s WHERE score IS NOT NULL AND fwd IS NOT NULL),
ranks AS (
  SELECT factor_id, ts, rank() OVER ({FT} ORDER BY x) + (count(*) OVER ({FT}, x) - 1) / 2.0 AS x, rank() OVER ({FT} ORDER BY y) + (count(*) OVER ({FT}, y) - 1) / 2.0 AS y FROM pairs
)"""
CORR = "covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0)"


def ics(source: str) -> str:
    return f"SELECT factor_id, ts, {CORR} AS ic FROM {source} GROUP BY factor_id, ts HAVING count(*) >= 3 AND {CORR} IS NOT NULL"


IC_PEARSON = f"WITH {IC}, i AS ({ics('pairs')}) SELECT factor_id, ts, {r('ic')} AS ic FROM i"
IC_SPEARMAN = f"WITH {IC}, i AS ({ics('ranks')}) SELECT factor_id, ts, {r('ic')} AS ic FROM i"
IC_STATS = f"""WITH {IC}, i AS ({ics('ranks')}), m AS (SELECT *, avg(ic) OVER (PARTITION BY factor_id) AS m FROM i)
SELECT factor_id, count(*) AS n, {r('avg(ic)')} AS mean_ic, {r('stddev_samp(ic)')} AS std_ic, {r('avg(ic) / stddev_samp(ic)')} AS ic_ir, {r('avg(ic) / stddev_samp(ic) * sqrt(count(*))')} AS t_stat,
  {r('avg(CASE WHEN sign(round(ic, 12)) = sign(round(m, 12)) THEN 1.0 ELSE 0.0 END)')} AS hit_rate FROM m GROUP BY factor_id"""
IC_DECAY = f"""WITH {S}, h AS (""" + " UNION ALL ".join(f"SELECT factor_id, ts, {k} AS horizon, score AS a, fwd_{k} AS b FROM s" for k in (1, 2, 3, 5, 10)) + f"""), pr AS (
  SELECT factor_id, ts, horizon, rank() OVER ({FT}, horizon ORDER BY a) + (count(*) OVER ({FT}, horizon, a) - 1) / 2.0 AS x, rank() OVER ({FT}, horizon ORDER BY b) + (count(*) OVER ({FT}, horizon, b) - 1) / 2.0 AS y
  FROM h WHERE a IS NOT NULL AND b IS NOT NULL
), i AS (SELECT factor_id, horizon, {CORR} AS ic FROM pr GROUP BY factor_id, ts, horizon HAVING count(*) >= 3)
SELECT factor_id, horizon, {r('avg(ic)')} AS mean_ic FROM i WHERE ic IS NOT NULL GROUP BY factor_id, horizon"""

B = f"""{S}, k AS (
  SELECT *, row_number() OVER ({FT} ORDER BY score ASC NULLS LAST, sym_ord) AS place, count(score) OVER ({FT}) AS cnt, count(DISTINCT score) OVER ({FT}) AS different FROM s
), b AS (SELECT *, CASE WHEN score IS NOT NULL AND different >= 5 THEN (ceil((place::DOUBLE / cnt) * 5) - 1)::INT END AS bucket FROM k),
ls AS (
  SELECT factor_id, ts, avg(CASE WHEN bucket = 4 THEN fwd END) - avg(CASE WHEN bucket = 0 THEN fwd END) AS ls FROM b GROUP BY factor_id, ts HAVING ls IS NOT NULL
), q AS (SELECT factor_id, bucket, avg(m) AS ret FROM (SELECT factor_id, ts, bucket, avg(fwd) AS m FROM b WHERE bucket IS NOT NULL GROUP BY factor_id, ts, bucket) GROUP BY factor_id, bucket),
tops AS (SELECT factor_id, ts, symbol, coalesce(bucket = 4, false) AS top FROM b),
before AS (SELECT *, lag(top, 1, false) OVER (PARTITION BY factor_id, symbol ORDER BY ts) AS had FROM tops),
tv AS (
  SELECT factor_id, avg(CASE WHEN h > 0 THEN l * 1.0 / h END) AS turnover
  FROM (SELECT factor_id, ts, count(*) FILTER (WHERE had) AS h, count(*) FILTER (WHERE had AND NOT top) AS l FROM before GROUP BY factor_id, ts) GROUP BY factor_id
)"""
BUCKETS = f"WITH {B} SELECT factor_id, ts, symbol, bucket FROM b"
QUANTILE_RETURNS = f"WITH {B} SELECT factor_id, bucket, {r('ret')} AS ret FROM q"
LONG_SHORT = f"WITH {B} SELECT factor_id, ts, {r('ls')} AS ls FROM ls"
TURNOVER = f"WITH {B} SELECT factor_id, {r('turnover')} AS turnover FROM tv"
AUTOCORR = f"""WITH {S}, a AS (SELECT factor_id, ts, score AS x, lag(score) OVER (PARTITION BY factor_id, symbol ORDER BY ts) AS y FROM s),
i AS (SELECT factor_id, ts, {CORR} AS c FROM a WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY factor_id, ts)
SELECT factor_id, {r('avg(c)')} AS autocorr FROM i GROUP BY factor_id"""
STATS = f"""{B}, gr AS (SELECT factor_id, avg(ls) AS gross, stddev_samp(ls) AS sd FROM ls GROUP BY factor_id),
qr AS (SELECT factor_id, bucket, bucket::DOUBLE AS x, rank() OVER (PARTITION BY factor_id ORDER BY ret) + (count(*) OVER (PARTITION BY factor_id, ret) - 1) / 2.0 AS y, ret FROM q),
mono AS (SELECT factor_id, {CORR} AS monotonicity, max(CASE WHEN bucket = 4 THEN ret END) - max(CASE WHEN bucket = 0 THEN ret END) AS spread FROM qr GROUP BY factor_id),
st AS (SELECT * FROM gr JOIN mono USING (factor_id) JOIN tv USING (factor_id))"""
PORTFOLIO = f"""WITH {STATS} SELECT factor_id, {r('gross / nullif(sd, 0) * sqrt(252)')} AS sharpe, {r('gross * 252')} AS ann_return, {r('sd * sqrt(252)')} AS ann_vol, {r('turnover')} AS turnover,
  {r('monotonicity')} AS monotonicity, {r('spread')} AS spread, {r('gross')} AS gross, {r('(gross - 0.0005 * coalesce(turnover, 0)) / nullif(sd, 0) * sqrt(252)')} AS sharpe_after_cost FROM st"""
COSTS = f"WITH {STATS} SELECT factor_id, bps, {r('(gross - bps / 1e4 * coalesce(turnover, 0.5)) * 252 / nullif(sd * sqrt(252), 0)')} AS net_sharpe FROM st, (VALUES (0.0::DOUBLE), (5.0), (10.0), (20.0)) AS v(bps)"
BACKTEST = f"""WITH {B}, n AS (SELECT ls.factor_id, ts, ls / 1000 - 0.0000005 * coalesce(turnover, 0) AS net, turnover FROM ls JOIN tv USING (factor_id)),
e AS (SELECT *, product(1 + net) OVER (PARTITION BY factor_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM n),
d AS (SELECT *, equity / max(equity) OVER (PARTITION BY factor_id ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS fall FROM e)
SELECT factor_id, count(*) AS n, {r('arg_max(equity, ts) - 1')} AS total_return, {r('avg(net) / stddev_samp(net) * sqrt(252)')} AS sharpe, {r('min(fall)')} AS max_drawdown,
  {r('avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END)')} AS hit_rate, {r('any_value(turnover)')} AS turnover FROM d GROUP BY factor_id"""
ADV = f"""WITH {P}{RETURNS}, recent AS (SELECT DISTINCT ts FROM p ORDER BY ts DESC LIMIT 63), y AS (SELECT k.*, f / nullif(lag(f) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret FROM k), x AS (SELECT * FROM y WHERE ts IN (SELECT ts FROM recent))
SELECT symbol, {r('median(volume * close)', 4)} AS adv, {r('stddev_samp(ret)', 4)} AS vol FROM x GROUP BY symbol"""

REG = """, z AS (
  SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS kn FROM p
), zr AS (SELECT *, kn / nullif(lag(kn) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS rt FROM z),
zv AS (SELECT ts, CASE WHEN count(rt) OVER w = 20 THEN stddev_samp(rt) OVER w END AS vv FROM zr WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
mk AS (SELECT ts, avg(vv) AS vol FROM zv GROUP BY ts HAVING vol IS NOT NULL),
ct AS (SELECT quantile_cont(vol, 1.0 / 3) AS lo, quantile_cont(vol, 2.0 / 3) AS hi FROM mk),
lb AS (SELECT ts, vol, CASE WHEN vol <= lo THEN 'low' WHEN vol <= hi THEN 'mid' ELSE 'high' END AS regime FROM mk, ct)"""
REGIMES = f"WITH {P}{REG} SELECT ts, {r('vol')} AS vol, regime FROM lb"
ICS = f"{IC}, i AS ({ics('pairs')})"
REGIME_IC = f"WITH {ICS}{REG} SELECT factor_id, regime, count(*) AS n, {r('avg(ic)')} AS mean_ic FROM i JOIN lb USING (ts) GROUP BY factor_id, regime"


def fold(row: str, n: str, k: int) -> str:
    """Which of k parts, the first n % k one longer, a row (from 0) is in."""
    b, rest = f"({n} // {k})", f"({n} % {k})"
    return f"(CASE WHEN {row} < {rest} * ({b} + 1) THEN {row} // ({b} + 1) ELSE {rest} + ({row} - {rest} * ({b} + 1)) // greatest({b}, 1) END)::INT"


NUMBERED = f"{ICS}, nb AS (SELECT *, row_number() OVER (PARTITION BY factor_id ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY factor_id) AS n FROM i)"
SUBPERIOD = f"WITH {NUMBERED}, fo AS (SELECT *, {fold('k', 'n', 4)} AS fold FROM nb) SELECT factor_id, fold, count(*) AS n, {r('avg(ic)')} AS mean_ic FROM fo GROUP BY factor_id, fold"
WALK_FORWARD = f"""WITH {NUMBERED}, sk AS (SELECT *, floor(n * 0.3::DOUBLE)::BIGINT AS s FROM nb), fo AS (SELECT *, {fold('(k - s)', '(n - s)', 5)} AS "window" FROM sk WHERE k >= s)
SELECT factor_id, "window", count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, {r('avg(ic)')} AS mean_ic FROM fo GROUP BY factor_id, "window" """
SH = "avg(ls) / nullif(stddev_samp(ls), 0) * sqrt(252)"
WINDOWED = f"""{B}, pairs AS (SELECT factor_id, ts, score AS x, fwd AS y FROM s WHERE score IS NOT NULL AND fwd IS NOT NULL), i AS ({ics('pairs')}),
nb AS (SELECT *, row_number() OVER (PARTITION BY factor_id ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY factor_id) AS n FROM i),
sk AS (SELECT *, floor(n * 0.3::DOUBLE)::BIGINT AS st FROM nb), fo AS (SELECT *, {fold('(k - st)', '(n - st)', 5)} AS wi FROM sk WHERE k >= st),
wl AS (SELECT fo.factor_id, fo.wi, fo.ic, ls.ls FROM fo LEFT JOIN ls ON ls.factor_id = fo.factor_id AND ls.ts = fo.ts)"""
WALK_FORWARD_SHARPE = f"""WITH {WINDOWED} SELECT factor_id, wi AS "window", count(ic) AS n, {r('avg(ic)')} AS mean_ic, {r(SH)} AS sharpe FROM wl GROUP BY factor_id, wi"""
WALK_FORWARD_SUMMARY = f"""WITH {WINDOWED}, tt AS (SELECT factor_id, avg(ic) AS m, avg(ic) / nullif(stddev_samp(ic), 0) AS ir, {SH} AS sh FROM wl GROUP BY factor_id),
ew AS (SELECT factor_id, wi, avg(ic) AS w FROM wl GROUP BY factor_id, wi),
ou AS (SELECT factor_id, count(*) AS n_windows, any_value(m) AS m, any_value(ir) AS ir, any_value(sh) AS sh, min(w) AS worst, avg(CASE WHEN sign(round(w, 12)) = CASE WHEN round(m, 12) < 0 THEN -1 ELSE 1 END THEN 1.0 ELSE 0.0 END) AS c FROM ew JOIN tt USING (factor_id) GROUP BY factor_id)
SELECT factor_id, n_windows, {r('m')} AS mean_ic, {r('ir')} AS ic_ir, {r('c')} AS sign_consistency, {r('worst')} AS worst_window_ic, {r('sh')} AS sharpe, c >= 0.75 AS stable FROM ou"""
STABILITY = f"""WITH {NUMBERED}, fo AS (SELECT *, {fold('k', 'n', 4)} AS fold, avg(ic) OVER (PARTITION BY factor_id) AS m FROM nb),
ef AS (SELECT factor_id, fold, avg(ic) AS f, any_value(m) AS m FROM fo GROUP BY factor_id, fold),
st AS (SELECT factor_id, any_value(m) AS m, min(f) AS worst, avg(CASE WHEN sign(round(f, 12)) = CASE WHEN round(m, 12) < 0 THEN -1 ELSE 1 END THEN 1.0 ELSE 0.0 END) AS c FROM ef GROUP BY factor_id)
SELECT factor_id, {r('m')} AS mean_ic, {r('c')} AS consistency, {r('worst')} AS worst, c >= 0.75 AND m <> 0 AS stable FROM st"""
SENS_RAW = f"""{P}, raw AS (""" + " UNION ALL ".join(f"SELECT '{n}' AS factor_id, ts, symbol, sym_ord, CASE WHEN count(close) OVER w = {n} THEN avg(close) OVER w END AS score, lead(close) OVER o / nullif(close, 0) - 1 AS fwd_1 FROM p {w(n)}" for n in (3, 5, 8)) + ")"
SENSITIVITY = f"""WITH {SENS_RAW}{preprocessed()}, pairs AS (SELECT factor_id, ts, score AS x, fwd AS y FROM s WHERE score IS NOT NULL AND fwd IS NOT NULL), i AS ({ics('pairs')})
SELECT factor_id::INT AS w, {r('avg(ic)')} AS mean_ic FROM i GROUP BY factor_id"""
SENSITIVITY_VERDICT = f"""WITH {SENS_RAW}{preprocessed()}, pairs AS (SELECT factor_id, ts, score AS x, fwd AS y FROM s WHERE score IS NOT NULL AND fwd IS NOT NULL), i AS ({ics('pairs')}),
v AS (SELECT factor_id, avg(ic) AS v FROM i GROUP BY factor_id), m AS (SELECT avg(v) AS m, stddev_pop(v) AS d FROM v),
c AS (SELECT any_value(m) AS m, any_value(d) AS d, avg(CASE WHEN sign(v) = CASE WHEN m < 0 THEN -1 ELSE 1 END THEN 1.0 ELSE 0.0 END) AS c FROM v, m)
SELECT {r('m')} AS mean_ic, {r('d')} AS dispersion, {r('c')} AS consistency, coalesce(c >= 0.75, false) AS robust FROM c"""
PV = "pv AS (SELECT c_nationkey AS family, c_custkey AS factor_id, pow((c_custkey * 7919 % 1000) / 1000.0::DOUBLE, 3.0) AS p FROM customer), rk AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, factor_id) AS rank, count(*) OVER (PARTITION BY family) AS m FROM pv)"
BH = f"WITH {PV}, a AS (SELECT *, least(min(p * m / rank) OVER (PARTITION BY family ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS q FROM rk) SELECT family, factor_id, rank::INT AS rank, {r('q')} AS p_fdr, q <= 0.05 AS fdr_reject FROM a"
HOLM = f"WITH {PV}, a AS (SELECT *, least(max(p * (m - rank + 1)) OVER (PARTITION BY family ORDER BY rank ROWS UNBOUNDED PRECEDING), 1.0) AS q FROM rk) SELECT family, factor_id, rank::INT AS rank, {r('q')} AS p_holm, q <= 0.05 AS holm_reject FROM a"
MOMENTS = f"""WITH {B}, c AS (SELECT *, avg(ls) OVER (PARTITION BY factor_id) AS m FROM ls), mo AS (
  SELECT factor_id, count(*) AS n, any_value(m) AS m, stddev_samp(ls) AS sd, avg(pow(ls - m, 2)) AS m2, avg(pow(ls - m, 3)) AS m3, avg(pow(ls - m, 4)) AS m4 FROM c GROUP BY factor_id)
SELECT factor_id, n, {r('m / nullif(sd, 0)')} AS sr, {r('m3 / pow(m2, 1.5)')} AS skew, {r('m4 / (m2 * m2)')} AS kurt FROM mo"""
# Simpson's rule on [0, x]: the normal and the t distribution have no functions in SQL.
SIMPSON = "CASE WHEN j = 0 OR j = 4000 THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END"
# Fixed value: (1 - g) z(1 - 1/3) + g z(1 - 1/(3e)), g being Euler's constant and z the normal quantile.
MAX_OF_THREE = 0.8528044961506948
DSR = f"""WITH {B}, c AS (SELECT *, avg(ls) OVER (PARTITION BY factor_id) AS m FROM ls), mo AS (
  SELECT factor_id, count(*) AS n, any_value(m) / stddev_samp(ls) AS sr, avg(pow(ls - m, 3)) / pow(avg(pow(ls - m, 2)), 1.5) AS sk, avg(pow(ls - m, 4)) / pow(avg(pow(ls - m, 2)), 2) AS ku FROM c GROUP BY factor_id),
va AS (SELECT sqrt(var_samp(sr)) * {MAX_OF_THREE!r} AS e FROM mo),
zs AS (SELECT factor_id, e, (sr - e) / sqrt((1 - sk * sr + (ku - 1) / 4 * sr * sr) / (n - 1)) AS z FROM mo, va),
ph AS (SELECT factor_id, any_value(e) AS e, 0.5 + any_value(z) / 12000 / sqrt(2 * pi()) * sum({SIMPSON} * exp(-pow(z * j / 4000, 2) / 2)) AS p FROM zs, range(4001) x(j) GROUP BY factor_id)
SELECT factor_id, {r('e', 5)} AS expected_max, {r('p', 5)} AS dsr FROM ph"""
PVALUE = f"""WITH {IC}, i AS ({ics('ranks')}), st AS (SELECT factor_id, abs(avg(ic) / stddev_samp(ic) * sqrt(count(*))) AS t, count(*) - 1 AS v FROM i GROUP BY factor_id),
ph AS (SELECT factor_id, 1 - 2 * any_value(t) / 12000 * exp(lgamma((any_value(v) + 1) / 2.0) - lgamma(any_value(v) / 2.0)) / sqrt(any_value(v) * pi()) * sum({SIMPSON} * pow(1 + pow(t * j / 4000, 2) / v, -(v + 1) / 2.0)) AS p FROM st, range(4001) x(j) GROUP BY factor_id)
SELECT factor_id, {r('p', 5)} AS p FROM ph"""
PBO = f"""WITH {B}, tm AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS k, count(*) OVER () AS n FROM (SELECT ts FROM ls GROUP BY ts HAVING count(*) = 3)),
bl AS (SELECT factor_id, ls, n, {fold('k', 'n', 6)} AS block FROM ls JOIN tm USING (ts)),
cb AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS split, a, b, c FROM range(6) x(a), range(6) y(b), range(6) z(c) WHERE a < b AND b < c),
sr AS (SELECT split, block IN (a, b, c) AS inside, factor_id, avg(ls) / nullif(stddev_samp(ls), 0) AS sr FROM bl, cb GROUP BY ALL),
be AS (SELECT split, arg_max(factor_id, sr) AS best FROM sr WHERE inside GROUP BY split),
ou AS (SELECT sr.split, factor_id, sr, max(CASE WHEN factor_id = best THEN sr END) OVER (PARTITION BY sr.split) AS own FROM sr JOIN be USING (split) WHERE NOT inside),
rk AS (SELECT split, sum(CASE WHEN sr <= own THEN 1.0 ELSE 0.0 END) / (count(*) + 1) AS rank FROM ou GROUP BY split)
SELECT {r('avg(CASE WHEN rank <= 0.5 THEN 1.0 ELSE 0.0 END)')} AS pbo, coalesce((SELECT max(n) FROM bl), 0) AS n FROM rk"""
CSCV = f"""WITH {B}, tm AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM ls)),
bl AS (SELECT factor_id, ls, {fold('k', 'n', 6)} AS block FROM ls JOIN tm USING (ts)),
cb AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS split, a, b, c FROM range(6) x(a), range(6) y(b), range(6) z(c) WHERE a < b AND b < c),
sr AS (SELECT split, block IN (a, b, c) AS inside, factor_id, avg(ls) / nullif(stddev_samp(ls), 0) AS sr FROM bl, cb GROUP BY ALL),
be AS (SELECT split, arg_max(factor_id, sr) AS best FROM sr WHERE inside GROUP BY split),
ou AS (SELECT sr.split, best, factor_id, sr, max(CASE WHEN factor_id = best THEN sr END) OVER (PARTITION BY sr.split) AS own FROM sr JOIN be USING (split) WHERE NOT inside)
SELECT split::INT AS split, best, {r('sum(CASE WHEN sr <= own THEN 1.0 ELSE 0.0 END) / (count(*) + 1)')} AS rank FROM ou GROUP BY split, best"""
PURGED = f"""WITH {P}, tm AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM p)), fo AS (SELECT *, {fold('i', 'n', 5)} AS fold FROM tm),
te AS (SELECT fold, min(i) AS a, max(i) AS b FROM fo GROUP BY fold)
SELECT te.fold, count(*) AS n_train, min(ts) AS first_ts, max(ts) AS last_ts FROM fo, te WHERE i < a - 2 OR i > b + 5 GROUP BY te.fold"""
CPCV = f"""WITH {P}, tm AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM p)), ix AS (SELECT i, {fold('i', 'n', 6)} AS g FROM tm), gr AS (SELECT g, min(i) AS a, max(i) AS b FROM ix GROUP BY g),
cb AS (SELECT row_number() OVER (ORDER BY x.g, y.g) - 1 AS split, x.a AS a1, x.b AS b1, y.a AS a2, y.b AS b2 FROM gr x, gr y WHERE x.g < y.g)
SELECT split::INT AS split, count(*) FILTER (WHERE NOT (i BETWEEN a1 - 2 AND b1 + 5) AND NOT (i BETWEEN a2 - 2 AND b2 + 5)) AS n_train, count(*) FILTER (WHERE i BETWEEN a1 AND b1 OR i BETWEEN a2 AND b2) AS n_test,
  min(a1) AS first_test, max(b2) AS last_test FROM cb, ix GROUP BY split"""
DEDUP = f"""WITH {S}, v AS (SELECT * FROM s WHERE score IS NOT NULL), pr AS (SELECT x.factor_id AS a, y.factor_id AS b, x.score AS x, y.score AS y FROM v x JOIN v y ON x.ts = y.ts AND x.symbol = y.symbol AND x.factor_id < y.factor_id)
SELECT a, b, count(*) AS overlap, {r(f'CASE WHEN count(*) >= 30 THEN {CORR} END')} AS rho FROM pr GROUP BY a, b"""
RHO = f"{S}, v AS (SELECT * FROM s WHERE score IS NOT NULL), pr AS (SELECT x.factor_id AS a, y.factor_id AS b, x.score AS x, y.score AS y FROM v x JOIN v y ON x.ts = y.ts AND x.symbol = y.symbol AND x.factor_id <> y.factor_id), rh AS (SELECT a, b, CASE WHEN count(*) >= 30 THEN {CORR} END AS rho FROM pr GROUP BY a, b)"
NEAREST = f"WITH {RHO} SELECT a AS factor_id, b AS nearest, {r('rho')} AS rho FROM rh WHERE rho IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a ORDER BY abs(rho) DESC, b) = 1"
NOVELTY = f"""WITH {RHO}, al AS (SELECT a, b FROM rh WHERE abs(rho) >= 0.7),
nm(factor_id, family, base) AS (VALUES ('momentum', 'momentum', 'momentum'), ('reversal', 'reversal', 'reversal'), ('volume', 'volume', 'volume'), ('again', 'momentum', 'momentum'), ('against', 'reversal', 'momentum')),
pr2 AS (SELECT x.factor_id, (x.base = y.base AND x.factor_id IN ('momentum', 'again') AND y.factor_id IN ('momentum', 'again'))::BIGINT AS same, (x.base = y.base OR (x.base, y.base) IN (SELECT (a, b) FROM al))::BIGINT AS alike FROM nm x JOIN nm y ON x.factor_id <> y.factor_id),
su AS (SELECT factor_id, sum(same)::BIGINT AS same, sum(alike)::BIGINT AS alike FROM pr2 GROUP BY factor_id)
SELECT factor_id, family, same, alike, same + alike > 0 AS duplicate FROM su JOIN nm USING (factor_id)"""
CAPACITY = f"""WITH {STATS}, kk AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS kn FROM p),
rt AS (SELECT *, kn / nullif(lag(kn) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret FROM kk), la AS (SELECT DISTINCT ts FROM p ORDER BY ts DESC LIMIT 63),
pf AS (SELECT symbol, median(volume * close) AS adv, stddev_samp(ret) AS vol FROM rt WHERE ts IN (SELECT ts FROM la) GROUP BY symbol),
cs AS (SELECT factor_id, abs(any_value(gross)) AS g, 3.0 / 1e4 * any_value(turnover) + 50.0 / 1e4 / 252 AS f, any_value(turnover) * avg(0.1 * vol * sqrt(turnover / (SELECT count(*) FROM pf) / adv)) AS c FROM st, pf GROUP BY factor_id)
SELECT factor_id, {r('log10(1 + CASE WHEN g <= f THEN 0.0 ELSE pow((g - f) / c, 2.0) END)')} AS log_capacity FROM cs"""
METRICS = f"""WITH {STATS}, pairs AS (SELECT factor_id, ts, score AS x, fwd AS y FROM s WHERE score IS NOT NULL AND fwd IS NOT NULL),
ranks AS (SELECT factor_id, ts, rank() OVER ({FT} ORDER BY x) + (count(*) OVER ({FT}, x) - 1) / 2.0 AS x, rank() OVER ({FT} ORDER BY y) + (count(*) OVER ({FT}, y) - 1) / 2.0 AS y FROM pairs), i AS ({ics('ranks')}),
ii AS (SELECT factor_id, count(*) AS n, avg(ic) AS m, avg(ic) / stddev_samp(ic) * sqrt(count(*)) AS t FROM i GROUP BY factor_id),
cv AS (SELECT factor_id, avg(c) AS coverage FROM (SELECT factor_id, ts, count(score) * 1.0 / count(*) AS c FROM s GROUP BY factor_id, ts) GROUP BY factor_id),
au AS (SELECT factor_id, avg(c) AS autocorr FROM (SELECT factor_id, ts, {CORR} AS c FROM (SELECT factor_id, ts, score AS x, lag(score) OVER (PARTITION BY factor_id, symbol ORDER BY ts) AS y FROM s) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY factor_id, ts) GROUP BY factor_id)
SELECT factor_id, n AS n_periods, {r('m')} AS mean_ic, {r('t')} AS ic_t_stat, {r('gross / nullif(sd, 0) * sqrt(252)')} AS sharpe, {r('turnover')} AS turnover, {r('coverage')} AS coverage, {r('autocorr')} AS autocorr
FROM st JOIN ii USING (factor_id) JOIN cv USING (factor_id) JOIN au USING (factor_id)"""
DECISIONS = """SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 'duplicate'
  WHEN (s_suppkey % 7 <> 0 AND abs(x / 10) < 0.01) OR abs(x * 6) < 2.0 OR abs(x) > 0.9 THEN 'rejected_in_development'
  WHEN s_suppkey % 3 = 0 OR abs(1 - x) < 0.6 OR (s_suppkey % 5 <> 0 AND x * x > 0.7) THEN 'rejected_after_robustness' ELSE 'research_survivor' END AS state
FROM (SELECT s_suppkey, s_acctbal / 10000 AS x FROM supplier)"""
SPLIT = f"""WITH {P}, tm AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM p)),
cu AS (SELECT max(CASE WHEN k <= floor(n * 0.6::DOUBLE) - 1 THEN ts END) AS a, max(CASE WHEN k <= floor(n * 0.8::DOUBLE) - 1 THEN ts END) AS b FROM tm)
SELECT CASE WHEN ts <= a THEN 'train' WHEN ts <= b THEN 'valid' ELSE 'test' END AS part, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM p, cu GROUP BY part"""
TRIALS = "SELECT 'f' || s_nationkey AS family, CASE WHEN s_acctbal < 0 THEN 'rejected_in_development' ELSE 'recorded' END AS status, count(*) AS trials FROM supplier GROUP BY ALL"
LINEAGE = """WITH RECURSIVE chain(start, node, depth) AS (
  SELECT s_suppkey, s_suppkey, 0 FROM supplier
  UNION ALL SELECT start, CAST(floor(node / 2) AS BIGINT), depth + 1 FROM chain WHERE node > 1
)
SELECT start, max(depth) AS generations, min(node) AS root FROM chain GROUP BY start"""
