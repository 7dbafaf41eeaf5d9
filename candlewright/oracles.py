"""DuckDB SQL for the screener's queries, put together from common table expressions."""

from __future__ import annotations

_W = "PARTITION BY symbol ORDER BY ts"
_U = f"({_W} ROWS UNBOUNDED PRECEDING)"


def _r4(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.5) / 10000"


def _cols(*names: str) -> str:
    return ", ".join(f"{_r4(n)} AS {n}" for n in names)


def _full(agg: str, x: str, n: int) -> str:
    over = f"({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {over} = {n} THEN {agg}({x}) OVER {over} END"


def _ewm(x: str, alpha: str, least: int) -> str:
    weight = f"pow(1 / (1 - {alpha}), rn)"
    return f"CASE WHEN count({x}) OVER {_U} >= {least} THEN sum(({x}) * {weight}) OVER {_U} / sum(CASE WHEN ({x}) IS NOT NULL THEN {weight} END) OVER {_U} END"


def _ema(period: int, x: str = "close") -> str:
    return _ewm(x, f"(2.0 / {period + 1})", period)


def _latest(x: str) -> str:
    return f"last_value({x} IGNORE NULLS) OVER {_U}"


def _bars(unit: str, name: str = "bars", symbol: str = "CAST(l_suppkey AS VARCHAR)") -> str:
    return f"""{name} AS (
  SELECT {symbol} AS symbol, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS ts, arg_min(px, k) AS open,
         max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS px, (l_shipdate, l_orderkey, l_linenumber) AS k FROM lineitem)
  GROUP BY 1, 2)"""


_DIV = "({}) / nullif({}, 0)".format
_TR = "CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END"

#: Indicators: raw moves, then averages, then what builds on these.
_IND = f"""i0 AS (
  SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS pc, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn,
         (high + low + close) / 3 AS tp
  FROM bars WINDOW w AS ({_W})),
i1 AS (
  SELECT *, {_TR} AS tr, CASE WHEN close > pc THEN close - pc ELSE 0 END AS gain, CASE WHEN close < pc THEN pc - close ELSE 0 END AS loss,
         CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm
  FROM i0),
i2 AS (
  SELECT *, {_ema(9)} AS ema9, {_ema(20)} AS ema20, {_ema(21)} AS ema21, {_ema(50)} AS ema50, {_ema(200)} AS ema200,
         {_ema(12)} - {_ema(26)} AS macd, {_ewm("tr", "(1.0 / 15)", 1)} AS atr14, {_ewm("gain", "(1.0 / 14)", 14)} AS g, {_ewm("loss", "(1.0 / 14)", 14)} AS l,
         {_DIV("100 * (" + _full("sum", "pdm", 20) + ")", _full("sum", "tr", 20))} AS plus_di, {_DIV("100 * (" + _full("sum", "mdm", 20) + ")", _full("sum", "tr", 20))} AS minus_di,
         {_full("avg", "volume", 20)} AS vol_avg20
  FROM i1),
i3 AS (
  SELECT *, {_ema(9, "macd")} AS macd_signal, {_DIV("100 * g", "g + l")} AS rsi14, {_DIV("100 * abs(plus_di - minus_di)", "plus_di + minus_di")} AS dx
  FROM i2),
ind AS (SELECT *, macd - macd_signal AS macd_hist, {_full("avg", "dx", 20)} AS adx FROM i3)"""


def _verdict(table: str, source: str, ok: str, columns: dict[str, str], carried: dict[str, str]) -> str:
    """A detector: windows over complete rows, then each bar takes the last complete row's values."""
    inner = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    mid = ", ".join(f"CASE WHEN ok THEN {v} END AS {k}_" for k, v in carried.items())
    outer = ", ".join(f"{_latest(k + '_')} AS {k}" for k in carried)
    drop = ", ".join(["ok", *columns, *(k + "_" for k in carried)])
    return f"""{table}_a AS (SELECT *, ({ok}) AS ok FROM {source}),
{table}_b AS (SELECT *, {inner} FROM {table}_a WINDOW c AS (PARTITION BY symbol, ok ORDER BY ts)),
{table}_c AS (SELECT *, {mid} FROM {table}_b),
{table} AS (SELECT * EXCLUDE ({drop}), {outer} FROM {table}_c)"""


def _known(*columns: str) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in columns)


_TREND = (
    _verdict("t1", "ind", _known("close", "ema20", "ema50", "adx"), {"n": "row_number() OVER c", "e5": "lag(ema50, 5) OVER c"},
             {"t_known": "n >= 6", "t_score": "CAST(close > ema20 AND ema20 > ema50 AS INT) + CAST(coalesce(ema50 > e5, false) AS INT) + CAST(adx > 20 AS INT)", "t_close": "close"})
    + f""",
trend AS (
  SELECT * EXCLUDE (t_known, t_score, t_close),
         CASE WHEN t_known THEN greatest(t_score - CAST(coalesce(t_close < {_latest("ema200")}, false) AS INT), 0) ELSE 0 END AS trend_score
  FROM t1)"""
)


def _half(lo: int, hi: int, agg: str) -> str:
    return f"{agg} OVER (PARTITION BY symbol, ok ORDER BY ts ROWS BETWEEN {lo} PRECEDING AND {hi} PRECEDING)"


_SETUPS = (
    _verdict("s1", "trend", _known("high", "low", "close", "volume", "vol_avg20"),
             {"n": "row_number() OVER c", "r1": f"{_half(40, 21, 'max(high)')} - {_half(40, 21, 'min(low)')}", "r2": f"{_half(20, 1, 'max(high)')} - {_half(20, 1, 'min(low)')}",
              "v1": _half(40, 21, "avg(volume)"), "v2": _half(20, 1, "avg(volume)"), "pv": _half(20, 1, "max(high)")},
             {"breakout": "coalesce(n >= 50 AND r1 <> 0 AND r2 < r1 * 0.80 AND v1 <> 0 AND v2 < v1 * 0.90 AND close > pv AND vol_avg20 > 0 AND volume > 1.5 * vol_avg20, false)", "bo_pv": "pv"})
    + ",\n"
    + _verdict("s2", "s1", _known("close", "low", "ema20", "volume", "vol_avg20"),
               {"n": "row_number() OVER c", "e5": "lag(ema20, 5) OVER c", "hit": _half(5, 1, "max(CAST(low <= ema20 * 1.02 AS INT))"), "v3": _half(3, 1, "avg(volume)")},
               {"pullback": "coalesce(n >= 10 AND ema20 > e5 AND hit = 1 AND NOT coalesce(vol_avg20 > 0 AND v3 >= vol_avg20 * 0.85, false) AND close > ema20, false)", "pb_pv": "ema20"})
    + """,
s3_0 AS (
  SELECT *, (ema9 IS NOT NULL AND ema21 IS NOT NULL AND volume IS NOT NULL AND vol_avg20 IS NOT NULL AND macd_hist IS NOT NULL) AS okx FROM s2),
s3_1 AS (
  SELECT *, CASE WHEN okx AND lag(ema9) OVER c <= lag(ema21) OVER c AND ema9 > ema21 AND vol_avg20 > 0 AND volume > 1.5 * vol_avg20 THEN ema21 END AS x
  FROM s3_0 WINDOW c AS (PARTITION BY symbol, okx ORDER BY ts)),
"""
    + _verdict("s3", "s3_1", "okx", {"n": "row_number() OVER c", "px": "first_value(x IGNORE NULLS) OVER (PARTITION BY symbol, ok ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"},
               {"continuation": "coalesce(n > 5 AND px IS NOT NULL AND macd_hist > 0, false)", "ec_pv": "px"})
    + f""",
setups AS (
  SELECT * EXCLUDE (breakout, pullback, continuation), coalesce(breakout, false) AS breakout, coalesce(pullback, false) AS pullback, coalesce(continuation, false) AS continuation,
         CASE WHEN breakout THEN 'breakout' WHEN pullback THEN 'pullback' WHEN continuation THEN 'trend_continuation' END AS setup_type,
         CASE WHEN breakout THEN bo_pv WHEN pullback THEN pb_pv WHEN continuation THEN ec_pv END AS pivot_price,
         CAST(coalesce(breakout, false) AS INT) + CAST(coalesce(pullback, false) AS INT) + CAST(coalesce(continuation, false) AS INT) AS n_signals,
         {_latest("atr14")} AS a, {_latest("close")} AS c
  FROM s3),
sig AS (
  SELECT *, round(pivot_price, 2) AS entry_pivot, round(pivot_price - 2 * a, 2) AS stop, round(pivot_price + 3 * a, 2) AS target, round((3 * a) / nullif(2 * a, 0), 2) AS rr, round(a, 2) AS atr,
         coalesce(pivot_price > 0 AND a > 0 AND c <= pivot_price + a, false) AS risk_ok,
         coalesce(rn >= 20 AND avg(close * volume) OVER ({_W} ROWS 19 PRECEDING) > 5e4 AND c > 20, false) AS liquid,
         round(c, 2) AS last_close, nullif(round({_latest("adx")}, 1), 0) AS adx_shown, round(c * {_latest("vol_avg20")}, 0) AS avg_turnover,
         CASE WHEN rn >= 50 THEN round(max(high) OVER ({_W} ROWS 251 PRECEDING), 2) END AS week52_high,
         CASE WHEN rn >= 50 THEN round(min(low) OVER ({_W} ROWS 251 PRECEDING), 2) END AS week52_low
  FROM setups)"""
)

_K = (21, 63, 126)


def _returns(source: str, out: str) -> str:
    return f"{out} AS (SELECT symbol, ts, " + ", ".join(f"close / nullif(lag(close, {k}) OVER w, 0) - 1 AS r{k}" for k in _K) + f" FROM {source} WINDOW w AS ({_W}))"


def _composite(benchmark: bool) -> str:
    terms = {w: f"s.r{k} / nullif(abs(b.r{k}), 0)" if benchmark else f"s.r{k}" for k, w in zip(_K, ("0.20", "0.35", "0.45"), strict=True)}
    total = " + ".join(f"coalesce({w} * ({t}), 0)" for w, t in terms.items())
    weights = " + ".join(f"CASE WHEN ({t}) IS NOT NULL THEN {w} ELSE 0 END" for w, t in terms.items())
    return f"(CAST(0 AS DOUBLE) + {total}) / nullif(CAST(0 AS DOUBLE) + {weights}, 0)"


_BENCH = _bars("week", "bench", "'^BENCH'") + ",\n" + _returns("bench", "br")


def _ranked(source: str, benchmark: bool) -> str:
    join = "LEFT JOIN br b ON s.ts = b.ts" if benchmark else ""
    score = f"CASE WHEN b.ts IS NULL THEN {_composite(False)} ELSE {_composite(True)} END" if benchmark else _composite(False)
    return f"""scored AS (SELECT s.symbol, s.ts, {score} AS rs_score FROM {source} s {join}),
ranked AS (
  SELECT symbol, ts, rs_score, round(rs_score, 4) AS rs_ratio, round(cume_dist() OVER (PARTITION BY ts ORDER BY rs_score) * 100, 1) AS rs_rank
  FROM scored WHERE rs_score IS NOT NULL)"""


_UNIVERSE = "constituents AS (SELECT s_suppkey AS pos, CAST(s_suppkey AS VARCHAR) AS symbol, s_name AS name FROM supplier WHERE s_suppkey % 10 <> 0)"
_EARNINGS = "earnings AS (SELECT DISTINCT CAST(o_custkey % (SELECT count(*) FROM supplier) + 1 AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'P')"
_GATES = "rs_rank >= 60 AND rn >= 60 AND trend_score >= 2 AND setup_type IS NOT NULL AND n_signals >= CASE WHEN rs_rank < 70 THEN 2 ELSE 1 END AND risk_ok"
_SCORE = """CAST(least(10, greatest(1, CASE WHEN rs_rank >= 85 THEN 4 WHEN rs_rank >= 70 THEN 3 WHEN rs_rank >= 60 THEN 2 ELSE 1 END + least(trend_score, 2)
    + CASE WHEN setup_type = 'trend_continuation' THEN 1 ELSE 2 END + CASE WHEN rr >= 2.5 THEN 2 WHEN rr >= 1.5 THEN 1 ELSE 0 END)) AS INT)"""
_RESULT = f"""r.ts, r.symbol, coalesce(n.name, r.symbol) AS name, {_SCORE} AS score, setup_type, rs_rank, trend_score, adx_shown AS adx, entry_pivot, stop, target, rr, atr,
  EXISTS (SELECT 1 FROM earnings e WHERE e.symbol = r.symbol AND e.d BETWEEN {{day}} AND {{day}} + 10) AS earnings_flag,
  last_close, week52_high, week52_low, avg_turnover, setup_type AS signals_triggered, rs_ratio"""

_SIG = f"{_IND},\n{_TREND},\n{_SETUPS}"
_WEEK = f"WITH {_bars('week')}"
def _history(benchmark: bool) -> str:
    return f"""WITH {_bars("week", "every")}, {_UNIVERSE}, {_EARNINGS},
bars AS (SELECT * FROM every SEMI JOIN constituents USING (symbol)), {_SIG},
{_BENCH}, {_returns("bars", "ret")},
liquid_ret AS (SELECT ret.* FROM ret SEMI JOIN (SELECT symbol, ts FROM sig WHERE liquid) l ON ret.symbol = l.symbol AND ret.ts = l.ts),
{_ranked("liquid_ret", benchmark)},
r AS (SELECT sig.*, rs_rank, rs_ratio FROM sig JOIN ranked USING (symbol, ts) WHERE {_GATES}),
results AS (SELECT {_RESULT.format(day="r.ts")} FROM r LEFT JOIN constituents n ON r.symbol = n.symbol),
runs AS (
  SELECT 'run-' || CAST(ts AS VARCHAR) AS id, CASE WHEN ts = max(ts) OVER () THEN 'running' WHEN month(ts) = 12 THEN 'error' ELSE 'done' END AS status, passed, ts
  FROM (SELECT ts, CAST(count(*) AS INT) AS passed FROM results GROUP BY ts))
"""


_HISTORY = _history(True)
_DAY = "DATE '2001-06-04'"
_ASOF = f"""WITH {_bars("week", "every")}, {_UNIVERSE}, {_EARNINGS},
bars AS (SELECT * FROM every SEMI JOIN constituents USING (symbol) WHERE ts BETWEEN DATE '2001-06-04' - 3650 AND DATE '2001-06-04'), {_SIG},
{_BENCH}, {_returns("bars", "ret")},
last_ts AS (SELECT symbol, max(ts) AS ts FROM bars GROUP BY symbol),
verdict AS (SELECT sig.* FROM sig JOIN last_ts USING (symbol, ts)),
one AS (SELECT * FROM br WHERE ts <= DATE '2001-06-04' ORDER BY ts DESC LIMIT 1),
scored AS (
  SELECT s.symbol, {_composite(True)} AS rs_score
  FROM ret s JOIN last_ts t ON s.symbol = t.symbol AND s.ts = t.ts JOIN verdict v ON v.symbol = s.symbol AND v.liquid CROSS JOIN one b),
ranked AS (SELECT symbol, round(rs_score, 4) AS rs_ratio, round(cume_dist() OVER (ORDER BY rs_score) * 100, 1) AS rs_rank FROM scored WHERE rs_score IS NOT NULL),
judged AS (SELECT v.*, rs_rank, rs_ratio FROM verdict v LEFT JOIN ranked USING (symbol))
"""


def _indicator(*names: str) -> str:
    return f"{_WEEK}, {_IND} SELECT symbol, ts, {_cols(*names)} FROM ind"


def _own(name: str, columns: str, *shown: str) -> str:
    return f"{_WEEK}, {_IND}, x AS (SELECT *, {columns} FROM ind) SELECT symbol, ts, {_cols(*shown)} FROM x"


def _detector(name: str, pivot: str) -> str:
    return f"{_WEEK}, {_SIG} SELECT symbol, ts, {name}, {_r4(f'CASE WHEN {name} THEN {pivot} END')} AS {name}_pivot FROM sig"


_EXPECT = """SELECT setup_type, count(*) AS count, round(coalesce(avg(CAST(win AS INT)), 0), 3) AS win_rate,
  round(coalesce(avg(return_pct) FILTER (win), 0), 2) AS avg_win_pct, round(coalesce(avg(return_pct) FILTER (NOT win), 0), 2) AS avg_loss_pct,
  round(coalesce(avg(return_pct) FILTER (win), 0) * coalesce(avg(CAST(win AS INT)), 0) + coalesce(avg(return_pct) FILTER (NOT win), 0) * (1 - coalesce(avg(CAST(win AS INT)), 0)), 2) AS expectancy_pct
FROM trades GROUP BY GROUPING SETS ((setup_type), ())"""
_TRADES = f"""{_WEEK}, {_SIG},
held AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n_all, lead(close, 10) OVER ({_W}) AS exit FROM sig),
trades AS (
  SELECT symbol, ts AS date, setup_type, close AS entry, exit, round(100 * (exit / nullif(close, 0) - 1), 2) AS return_pct, exit / nullif(close, 0) - 1 > 0 AS win
  FROM held WHERE n_all >= 80 AND rn > 60 AND rn + 10 <= n_all AND trend_score >= 2 AND setup_type IS NOT NULL AND exit / nullif(close, 0) IS NOT NULL)
"""
_BARS_OUT = f"SELECT symbol, ts, {_cols('open', 'high', 'low', 'close', 'volume')} FROM bars"
_CHART = f"""WITH {_bars("day", "every")},
bars AS (SELECT * FROM every WHERE ts BETWEEN DATE '2001-06-04' - 400 AND DATE '2001-06-04'), {_IND},
rows AS (SELECT *, CAST(epoch(CAST(ts AS TIMESTAMP)) AS BIGINT) AS time FROM ind)
"""
_FLIP = f"CAST(coalesce(lag(macd_hist) OVER ({_W}) <= 0 AND macd_hist > 0, false) AS INT)"
_BROKE = " OR ".join(f"coalesce(count(*) OVER b{n} = {n} AND (max(high) OVER b{n} - min(low) OVER b{n}) / nullif(min(low) OVER b{n}, 0) < 0.20 AND close > max(high) OVER b{n}, false)" for n in range(20, 41, 5))
_BROKE_W = ", ".join(f"b{n} AS ({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in range(20, 41, 5))


def _points(name: str, *columns: str) -> str:
    """Points of a series as text: the time and each value in hundredths of its four places."""
    cents = " || ':' || ".join(f"CAST(CAST(floor({_r4(c)} * 100 + 0.5) AS BIGINT) AS VARCHAR)" for c in columns)
    return f"coalesce(string_agg(CAST(time AS VARCHAR) || ':' || {cents}, ',' ORDER BY time), '') AS {name}"


def _arithmetic(sql: str) -> str:
    """round(x, n) as plain arithmetic on doubles, ties upwards."""
    while (at := sql.find("round(")) >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        x, _, n = sql[at + 6 : end - 1].rpartition(",")
        power = f"1{'0' * int(n)}.0"
        sql = f"{sql[:at]}(floor(CAST({x} AS DOUBLE) * {power} + 0.5) / {power}){sql[end:]}"
    return sql


_SQL: dict[str, str] = {
    "bars_weekly": f"{_WEEK} {_BARS_OUT}",
    "bars_daily": f"WITH {_bars('day')} {_BARS_OUT}",
    "bars_monthly": f"WITH {_bars('month')} {_BARS_OUT}",
    "ema": _indicator("ema9", "ema20", "ema21", "ema50", "ema200"),
    "ema_blocks": _indicator("ema9", "ema50"),
    "ema_exact": _indicator("ema21"),
    "macd": _indicator("macd", "macd_signal", "macd_hist"),
    "atr": _indicator("atr14"),
    "rsi": _indicator("rsi14"),
    "adx": _indicator("plus_di", "minus_di", "adx"),
    "sma": _own("sma", f"{_full('avg', 'close', 20)} AS sma20", "sma20"),
    "bollinger": _own("bb", f"{_full('avg', 'close', 14)} AS bb_middle, {_full('stddev_pop', 'close', 14)} AS sd, {_full('stddev_pop', 'close', 20)} AS sd20, {_full('avg', 'close', 20)} AS m20", "bb_middle").replace("FROM x", f", {_r4('bb_middle + 2 * sd')} AS bb_upper, {_r4('bb_middle - 2 * sd')} AS bb_lower, {_r4('(bb_middle + 2 * sd) - (bb_middle - 2 * sd)')} AS bb_bandwidth, {_r4('2 * sd20 / nullif(m20, 0)')} AS bb_width FROM x"),
    "stochastic": f"{_WEEK}, k AS (SELECT *, {_DIV('100 * (close - (' + _full('min', 'low', 14) + '))', '(' + _full('max', 'high', 14) + ') - (' + _full('min', 'low', 14) + ')')} AS stoch_k FROM bars), d AS (SELECT *, {_full('avg', 'stoch_k', 3)} AS stoch_d FROM k) SELECT symbol, ts, {_cols('stoch_k', 'stoch_d')} FROM d",
    "obv": f"{_WEEK}, s AS (SELECT *, coalesce(sign(close - lag(close) OVER ({_W})) * volume, 0) AS v FROM bars) SELECT symbol, ts, {_r4(f'sum(v) OVER {_U}')} AS obv FROM s",
    "vwap": f"{_WEEK}, t AS (SELECT *, (high + low + close) / 3 * volume AS tv FROM bars), v AS (SELECT *, {_DIV(_full('sum', 'tv', 20), _full('sum', 'volume', 20))} AS vwap FROM t) SELECT symbol, ts, {_cols('vwap')} FROM v",
    "cci": f"{_WEEK}, t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), m AS (SELECT *, {_full('avg', 'tp', 20)} AS ma, list(tp) OVER ({_W} ROWS 19 PRECEDING) AS every FROM t), a AS (SELECT *, list_sum(list_transform(every, lambda y: abs(y - ma))) / 20 AS away FROM m) SELECT symbol, ts, {_r4('(tp - ma) / (0.015 * CASE WHEN away > 1e-9 * abs(ma) THEN away END)')} AS cci FROM a",
    "psar": f"""WITH RECURSIVE {_bars('week')},
b AS (SELECT *, row_number() OVER w AS k, lag(low) OVER w AS l1, coalesce(lag(low, 2) OVER w, lag(low) OVER w) AS l2, lag(high) OVER w AS h1, coalesce(lag(high, 2) OVER w, lag(high) OVER w) AS h2 FROM bars WINDOW w AS ({_W})),
r AS (
  SELECT symbol, ts, k, 1 AS dir, low AS stop, high AS reach, CAST(0.02 AS DOUBLE) AS pace FROM b WHERE k = 1
  UNION ALL
  SELECT symbol, ts, k, CASE WHEN crossed THEN -dir ELSE dir END, CASE WHEN crossed THEN reach ELSE near END,
         CASE WHEN crossed THEN CASE WHEN dir > 0 THEN low ELSE high END WHEN better THEN best ELSE reach END,
         CASE WHEN crossed THEN CAST(0.02 AS DOUBLE) WHEN better THEN least(pace + CAST(0.02 AS DOUBLE), CAST(0.2 AS DOUBLE)) ELSE pace END
  FROM (
    SELECT *, CASE WHEN dir > 0 THEN low < near ELSE high > near END AS crossed, best * dir > reach * dir AS better
    FROM (
      SELECT b.symbol, b.ts, b.k, dir, reach, pace, low, high, CASE WHEN dir > 0 THEN high ELSE low END AS best,
             CASE WHEN dir > 0 THEN least(stop + pace * (reach - stop), l1, l2) ELSE greatest(stop + pace * (reach - stop), h1, h2) END AS near
      FROM r JOIN b ON b.symbol = r.symbol AND b.k = r.k + 1)))
SELECT symbol, ts, {_r4("stop")} AS sar, dir AS sar_trend FROM r""",
    "range_52w": f"{_WEEK}, x AS (SELECT *, row_number() OVER ({_W}) AS rn, max(high) OVER ({_W} ROWS 251 PRECEDING) AS h, min(low) OVER ({_W} ROWS 251 PRECEDING) AS l FROM bars) SELECT symbol, ts, {_r4('CASE WHEN rn >= 50 THEN h END')} AS year_high, {_r4('CASE WHEN rn >= 50 THEN l END')} AS year_low FROM x",
    "trend": f"{_WEEK}, {_IND}, {_TREND} SELECT symbol, ts, CAST(trend_score AS INT) AS trend_score, trend_score >= 2 AS trend_ok FROM trend",
    "breakout": _detector("breakout", "bo_pv"),
    "pullback": _detector("pullback", "pb_pv"),
    "continuation": _detector("continuation", "ec_pv"),
    "setups": f"{_WEEK}, {_SIG} SELECT symbol, ts, setup_type, n_signals, risk_ok, entry_pivot, stop, target, rr, atr, {_cols('pivot_price')} FROM sig WHERE setup_type IS NOT NULL",
    "liquidity": f"{_WEEK}, {_SIG} SELECT symbol, ts, liquid FROM sig",
    "rs_rank": f"{_WEEK}, {_BENCH}, {_returns('bars', 'ret')}, {_ranked('ret', True)} SELECT symbol, ts, {_cols('rs_score')}, rs_rank FROM ranked",
    "rs_rank_no_benchmark": f"{_WEEK}, {_returns('bars', 'ret')}, {_ranked('ret', False)} SELECT symbol, ts, {_cols('rs_score')}, rs_rank FROM ranked",
    "scan_history": f"{_HISTORY} SELECT * FROM results",
    "scan_history_benchmark_missing": f"{_history(False)} SELECT * EXCLUDE (signals_triggered) FROM results",
    "scan_asof": f"{_ASOF}, r AS (SELECT * FROM judged WHERE {_GATES}) SELECT {_RESULT.format(day=_DAY)} FROM r LEFT JOIN constituents n ON r.symbol = n.symbol",
    "scan_asof_ranked": f"{_ASOF}, r AS (SELECT * FROM judged WHERE {_GATES}), x AS (SELECT {_RESULT.format(day=_DAY)}, pos FROM r LEFT JOIN constituents n ON r.symbol = n.symbol) SELECT symbol, score, rs_rank, setup_type, earnings_flag, CAST(row_number() OVER (ORDER BY score DESC, pos) AS INT) AS place FROM x".replace("2001-06-04", "1996-10-14"),
    "funnel": f"{_ASOF} SELECT count(*) AS total, count_if(liquid) AS liquid, count_if(coalesce(rs_rank >= 60, false)) AS strong, count_if(coalesce(rs_rank >= 60, false) AND rn >= 60 AND trend_score >= 2) AS trending, count_if(coalesce({_GATES}, false)) AS passed FROM judged",
    "trades": f"{_TRADES} SELECT symbol, date, setup_type, {_cols('entry', 'exit')}, return_pct, win FROM trades",
    "expectancy": f"{_TRADES} {_EXPECT}",
    "setup_counts": f"{_HISTORY} SELECT count(*) AS total, count_if(setup_type = 'breakout') AS breakout, count_if(setup_type = 'pullback') AS pullback, count_if(setup_type = 'trend_continuation') AS continuation FROM results",
    "index_snapshot": f"{_WEEK}, l AS (SELECT symbol, close, lag(close) OVER ({_W}) AS prev_close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) SELECT n_name AS sector, CAST(n_nationkey % 10 + 1 AS VARCHAR) AS ticker, {_r4('close')} AS price, {_cols('prev_close')}, {_r4('close - prev_close')} AS change, {_r4('100 * ((close - prev_close) / nullif(prev_close, 0))')} AS pct_change FROM nation LEFT JOIN (SELECT * FROM l WHERE k = 1) l ON l.symbol = CAST(n_nationkey % 10 + 1 AS VARCHAR)",
    "earnings_flag": f"{_WEEK}, {_EARNINGS} SELECT symbol, ts, EXISTS (SELECT 1 FROM earnings e WHERE e.symbol = b.symbol AND e.d BETWEEN b.ts AND b.ts + 10) AS earnings_flag FROM bars b",
    "missing_symbols": f"{_WEEK}, {_UNIVERSE} SELECT symbol, name FROM constituents c WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = c.symbol AND b.ts BETWEEN DATE '2001-12-01' - 10 AND DATE '2001-12-01')",
    "universe": f"WITH {_UNIVERSE} SELECT pos, symbol, name, symbol || '.NS' AS yf_symbol FROM constituents",
    "read_list": f"WITH {_UNIVERSE} SELECT symbol || '.NS' AS yf_symbol FROM constituents UNION SELECT '^BENCH'",
    "latest_results": f"{_HISTORY} SELECT 'run-' || CAST(ts AS VARCHAR) AS run_id, symbol, score, setup_type, rs_rank FROM results WHERE ts = (SELECT max(ts) FROM runs WHERE status = 'done')",
    "sorted_results": f"{_HISTORY} SELECT 'run-' || CAST(ts AS VARCHAR) AS run_id, symbol, score, adx FROM results",
    "run_status": f"{_HISTORY} SELECT id, status, 0 AS total, 0 AS scanned, CASE WHEN status = 'done' THEN passed ELSE 0 END AS passed FROM runs WHERE id = (SELECT min(id) FROM runs)",
    "orphan_results": f"{_HISTORY} SELECT 'run-' || CAST(ts AS VARCHAR) AS run_id, symbol, score FROM results SEMI JOIN (SELECT ts FROM runs WHERE status <> 'error') u USING (ts)",
    "schema_union": f"{_HISTORY} SELECT CAST(s_suppkey AS VARCHAR) AS symbol, s_acctbal AS pe_ratio, NULL AS score, false AS earnings_flag FROM supplier UNION ALL SELECT symbol, NULL, score, earnings_flag FROM results",
    "chart_series": f"{_CHART} SELECT symbol, time, series, value FROM (" + " UNION ALL ".join(f"SELECT symbol, time, '{n}' AS series, {_r4(c)} AS value FROM rows" for c, n in (("ema9", "ema9"), ("ema21", "ema21"), ("ema50", "ema50"), ("rsi14", "rsi"), ("macd_hist", "macd_hist"))) + ") WHERE value IS NOT NULL",
    "chart_nested": f"{_CHART} SELECT symbol, CAST(count(*) AS INT) AS n_candles, " + _points("candles", "open", "high", "low", "close", "volume") + ", " + ", ".join(_points(n, c) for n, c in (("ema9", "ema9"), ("ema21", "ema21"), ("ema50", "ema50"), ("rsi14", "rsi14"), ("macd_hist", "macd_hist"))).replace("AS rsi14", "AS rsi") + " FROM rows GROUP BY symbol",
    "session_ticks": f"SELECT event_type, count(*) AS n, {_r4('sum(value)')} AS value FROM (SELECT *, ts + INTERVAL 330 MINUTE AS t FROM events) WHERE isodow(t) <= 5 AND hour(t) * 60 + minute(t) BETWEEN 555 AND 930 GROUP BY event_type",
    "wide_to_long": f"WITH {_bars('week', symbol='l_linestatus')} {_BARS_OUT}",
    "wide_to_long_all": f"WITH {_bars('week', symbol='l_returnflag')} {_BARS_OUT}",
    "v1_signals": f"""{_WEEK}, {_IND},
k0 AS (SELECT *, (ema9 IS NOT NULL AND ema21 IS NOT NULL AND volume IS NOT NULL AND vol_avg20 IS NOT NULL) AS okx FROM ind),
k1 AS (SELECT *, CASE WHEN okx AND lag(ema9) OVER c <= lag(ema21) OVER c AND ema9 > ema21 AND vol_avg20 > 0 AND volume > 1.5 * vol_avg20 THEN ema21 END AS x FROM k0 WINDOW c AS (PARTITION BY symbol, okx ORDER BY ts)),
{_verdict("k2", "k1", "okx", {"n": "row_number() OVER c", "px": "first_value(x IGNORE NULLS) OVER (PARTITION BY symbol, ok ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"}, {"v1x": "n > 3 AND px IS NOT NULL"})},
k3 AS (SELECT *, {_FLIP} AS flip FROM k2),
k4 AS (
  SELECT symbol, ts, close, ema50, coalesce(v1x, false) AS v1_cross,
         coalesce(max(CAST(rsi14 BETWEEN 40 AND 50 AS INT)) OVER ({_W} ROWS 2 PRECEDING) = 1 AND rsi14 > lag(rsi14) OVER ({_W}), false) AS v1_rsi,
         max(flip) OVER ({_W} ROWS 1 PRECEDING) = 1 AS v1_macd, coalesce(({_BROKE}) AND volume > 1.5 * vol_avg20, false) AS v1_breakout
  FROM k3 WINDOW {_BROKE_W}),
k5 AS (SELECT *, CAST(v1_cross AS INT) + CAST(v1_rsi AS INT) + CAST(v1_macd AS INT) + CAST(v1_breakout AS INT) AS v1_signals FROM k4)
SELECT symbol, ts, v1_cross, v1_rsi, v1_macd, v1_breakout, v1_signals, coalesce(close > ema50, false) AND v1_signals >= 2 AS v1_ok,
       CASE WHEN coalesce(close > ema50, false) AND v1_signals >= 2 THEN v1_signals + 1 END AS v1_score FROM k5""",
    "v1_fundamentals": f"""WITH f AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS symbol, n_name AS sector, CASE WHEN s_acctbal > 0 THEN s_acctbal / 100 END AS pe_ratio, (s_suppkey % 7) / 20 AS revenue_growth
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
m AS (SELECT sector, median(pe_ratio) AS sector_pe_median FROM f GROUP BY sector)
SELECT symbol, sector, {_cols("pe_ratio", "sector_pe_median", "revenue_growth")}, CASE WHEN pe_ratio > 50 THEN 'rising' ELSE 'unknown' END AS promoter_trend,
       CASE WHEN pe_ratio > 50 THEN {_r4("pe_ratio")} END AS promoter_holding
FROM f JOIN m USING (sector) WHERE pe_ratio <= coalesce(sector_pe_median, 30) AND revenue_growth > 0.10""",
}
_SQL["rs_rank_spread"] = f"{_WEEK}, {_returns('bars', 'ret')}, {_ranked('ret', False)}, own AS (SELECT symbol, ts, {_r4('rs_score')} AS rs_score FROM ranked WHERE rs_score IS NOT NULL) SELECT symbol, ts, rs_score, round(cume_dist() OVER (ORDER BY rs_score) * 100, 1) AS rs_rank FROM own"
_SQL |= {f"{name}_split": _SQL[name] for name in ("ema", "obv", "adx", "macd", "psar", "setups")}
ORACLE_SQL = {name: _arithmetic(sql) for name, sql in _SQL.items()}
