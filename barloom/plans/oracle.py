"""DuckDB SQL for the registered queries, written from the definitions, not from the Spark code."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

#: Daily bars; x numbers them from 0 and holds the close before.
BARS = """
bars AS (
  SELECT n_name AS symbol, r_name AS sector, CAST(l_shipdate AS DATE) AS d, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS p, row(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem WHERE l_quantity <> 0)
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3
), x AS (
  SELECT *, row_number() OVER w - 1 AS i, lag(close) OVER w AS pc, count(*) OVER (PARTITION BY symbol) AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)
), t AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM x)"""
WIN = "WINDOW w AS (PARTITION BY symbol ORDER BY d), " + ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (3, 5, 10, 14, 20, 21, 60))
WEEKS = "weeks AS (SELECT symbol, sector, CAST(date_trunc('week', d) AS DATE) AS week, arg_min(open, d) AS open, max(high) AS high, min(low) AS low, arg_max(close, d) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2, 3)"
MACRO = """
days AS (SELECT CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) / 10000 AS vix FROM orders GROUP BY 1),
asset AS (SELECT CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS btc_close FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
macro AS (
  SELECT a.d, btc_close, CASE WHEN count(*) OVER v = 20 THEN avg(btc_close) OVER v END AS btc_sma20, vix
  FROM asset a ASOF LEFT JOIN days b ON a.d >= b.d WINDOW v AS (ORDER BY a.d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
), point AS (SELECT coalesce(arg_max(coalesce(btc_close > btc_sma20, false), d), false) AS btc_above, round(coalesce(arg_max(vix, d), 0), 2) AS vix, round(coalesce(arg_max(btc_close, d), 0), 2) AS btc_price, round(coalesce(arg_max(btc_sma20, d), 0), 2) AS btc_sma20 FROM macro)"""
GRADE = "CASE WHEN {0} >= 80 THEN 'Strong Buy' WHEN {0} >= 60 THEN 'Buy' WHEN {0} >= 40 THEN 'Neutral' WHEN {0} >= 20 THEN 'Caution' ELSE 'Avoid' END"


def _over_bars(name: str, columns: str, before: str = "") -> None:
    ORACLE_SQL[name] = f"WITH {BARS}{before} SELECT symbol, d, {columns} FROM t {WIN}"


ORACLE_SQL["daily_bars"] = f"WITH {BARS} SELECT symbol, sector, d, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars"
ORACLE_SQL["weekly_bars"] = f"WITH {BARS}, {WEEKS} SELECT symbol, sector, week, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM weeks"
ORACLE_SQL["macro"] = f"WITH {MACRO} SELECT d, round(btc_close, 6) AS btc_close, round(btc_sma20, 6) AS btc_sma20, coalesce(btc_close > btc_sma20, false) AS btc_above, round(vix, 6) AS vix FROM macro"
ORACLE_SQL["macro_now"] = f"WITH {MACRO} SELECT * FROM point"
_over_bars("day_change", "round(pc, 6) AS prev_close, round((close - pc) / pc * 100, 4) AS change_pct")
BANDS = ", bb AS (SELECT *, CASE WHEN i >= 19 THEN avg(close) OVER q END AS sma, CASE WHEN i >= 19 THEN round(avg(close) OVER q + 2 * stddev_pop(close) OVER q, 2) END AS bb_upper, CASE WHEN i >= 19 THEN round(avg(close) OVER q - 2 * stddev_pop(close) OVER q, 2) END AS bb_lower FROM t WINDOW q AS (PARTITION BY symbol ORDER BY d ROWS 19 PRECEDING)), bs AS (SELECT *, round((close - bb_lower) / nullif(bb_lower, 0) * 100, 2) AS pct_from_lower FROM bb), bx AS (SELECT *, CASE WHEN bb_lower IS NULL THEN NULL WHEN close < bb_lower THEN 'extreme_oversold' WHEN close > bb_upper THEN 'overbought' WHEN pct_from_lower < 2 THEN 'oversold' ELSE 'normal' END AS bb_signal FROM bs)"
ORACLE_SQL["sma_bbands"] = f"WITH {BARS}{BANDS} SELECT symbol, d, round(sma, 6) AS sma, bb_upper, bb_lower, pct_from_lower, bb_signal FROM bx"
ORACLE_SQL["bb_squeeze"] = f"""WITH {BARS}, s AS (SELECT *, avg(close) OVER w20 AS m, stddev_pop(close) OVER w20 AS sd, CASE WHEN i >= 20 THEN avg(tr) OVER w20 END AS a FROM t {WIN})
SELECT symbol, d, CASE WHEN i < 19 THEN false WHEN a > 0 THEN 4 * sd < 3 * a ELSE true END AS squeeze, CASE WHEN i < 19 OR sd = 0 THEN 0.0 ELSE round(greatest(-1.0, least(1.0, (close - m) / (2 * sd))), 2) END AS bb_pos,
       i >= 19 AND close < m - 2 * sd AS below_lower, i >= 19 AND close < (m - 2 * sd) * 1.03 AS near_lower FROM s"""
_over_bars("atr", "CASE WHEN i >= 14 THEN round(avg(tr) OVER w14, 6) END AS atr")
MF = "CASE WHEN high = low THEN 0.0 ELSE ((close - low) - (high - close)) / (high - low) * volume END"
_over_bars("cmf", f"CASE WHEN i < 20 THEN 0.0 ELSE coalesce(round(sum({MF}) OVER w21 / nullif(sum(volume) OVER w21, 0), 4), 0.0) END AS cmf, CASE WHEN i >= 20 THEN coalesce(round(sum({MF}) OVER w21 / nullif(sum(CASE WHEN high <> low THEN volume ELSE 0.0 END) OVER w21, 0), 4), 0.0) END AS cmf_skip")
TURN = f""", c0 AS (SELECT *, coalesce(round(sum({MF}) OVER w21 / nullif(sum(volume) OVER w21, 0), 4), 0.0) AS c FROM t {WIN}),
c1 AS (SELECT *, CASE WHEN i >= 25 THEN c ELSE 0.0 END AS cmf_now, CASE WHEN i >= 25 THEN lag(c, 5) OVER w ELSE 0.0 END AS cmf_prev FROM c0 {WIN})"""
ORACLE_SQL["cmf_turning"] = f"WITH {BARS}{TURN} SELECT symbol, d, cmf_now, cmf_prev, cmf_prev < -0.02 AND cmf_now > cmf_prev AS turning, cmf_now > 0.02 AS positive FROM c1"
EVSR = """CASE WHEN i < 20 OR avg(tr) OVER w20 = 0 OR avg(volume) OVER w20 = 0 THEN 0.0
  WHEN close = pc THEN least(2 * volume / avg(volume) OVER w20, 5.0)
  ELSE round(volume / avg(volume) OVER w20 / (abs(close - pc) / avg(tr) OVER w20), 2) END"""
_over_bars("evsr", f"round({EVSR}, 6) AS evsr")
UP, DOWN = "sum(CASE WHEN close > pc THEN volume ELSE 0.0 END) OVER w10", "sum(CASE WHEN close < pc THEN volume ELSE 0.0 END) OVER w10"
UPVOL = f"CASE WHEN i < 10 THEN 1.0 WHEN {DOWN} <> 0 THEN round({UP} / {DOWN}, 2) ELSE least({UP}, 5.0) END"
_over_bars("upvol", f"{UPVOL} AS upvol")
MFI = f""", m0 AS (SELECT *, (high + low + close) / 3 AS tp FROM t), m1 AS (SELECT *, lag(tp) OVER w AS ptp FROM m0 {WIN}),
mfi AS (SELECT symbol, d, CASE WHEN i < 14 THEN NULL WHEN sum(CASE WHEN tp <= ptp THEN tp * volume ELSE 0.0 END) OVER w14 = 0 THEN 100.0
  ELSE round(100 - 100 / (1 + sum(CASE WHEN tp > ptp THEN tp * volume ELSE 0.0 END) OVER w14 / sum(CASE WHEN tp <= ptp THEN tp * volume ELSE 0.0 END) OVER w14), 2) END AS mfi FROM m1 {WIN})"""
ORACLE_SQL["mfi"] = f"WITH {BARS}{MFI} SELECT * FROM mfi"
STOCH = f""", s0 AS (SELECT *, CASE WHEN max(high) OVER w14 = min(low) OVER w14 THEN 50.0 ELSE (close - min(low) OVER w14) / (max(high) OVER w14 - min(low) OVER w14) * 100 END AS raw FROM t {WIN}),
s1 AS (SELECT *, avg(raw) OVER w3 AS k FROM s0 {WIN}), stoch AS (SELECT symbol, d, CASE WHEN i >= 19 THEN round(k, 2) END AS stoch_k, CASE WHEN i >= 19 THEN round(avg(k) OVER w3, 2) END AS stoch_d FROM s1 {WIN})"""
ORACLE_SQL["stoch"] = f"WITH {BARS}{STOCH} SELECT * FROM stoch"
OBV = f""", o0 AS (SELECT *, sum(CASE WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0.0 END) OVER (PARTITION BY symbol ORDER BY d ROWS UNBOUNDED PRECEDING) AS obv FROM t),
o1 AS (SELECT *, close - lag(close, 5) OVER w AS p, obv - lag(obv, 5) OVER w AS o FROM o0 {WIN}),
obv AS (SELECT symbol, d, obv, CASE WHEN p IS NULL THEN 0 WHEN p < 0 AND o > 0 THEN 10 WHEN p < 0 AND o < 0 THEN 0 WHEN p > 0 AND o > 0 THEN 5 ELSE 2 END AS obv_points FROM o1)"""
ORACLE_SQL["obv"] = f"WITH {BARS}{OBV} SELECT * FROM obv"
CONTRACTION = "CASE WHEN i >= 19 THEN coalesce((sum(volume) OVER w3 / 3) / nullif(sum(volume) OVER w20 / 20, 0), 1.0) END"
_over_bars("vol_contraction", f"round({CONTRACTION}, 6) AS vol_contraction")
DRAWDOWN = "CASE WHEN i >= 19 AND avg(tr) OVER w14 > 0 THEN abs(close - max(close) OVER w20) / nullif(round(avg(tr) OVER w14, 4), 0) END"
_over_bars("drawdown_atr", f"round({DRAWDOWN}, 6) AS drawdown_atr")
ORACLE_SQL["volume_surge"] = f"""WITH {BARS}, v AS (SELECT symbol, d, volume, CAST(floor(avg(volume) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) AS BIGINT) AS avg_volume FROM t)
SELECT symbol, d, avg_volume, round(volume / nullif(avg_volume, 0), 2) AS volume_ratio, coalesce(round(volume / nullif(avg_volume, 0), 2) >= 1.5, false) AS surge FROM v"""
HVN = """, h0 AS (SELECT a.symbol, a.d, a.i, CAST(round_even(((b.high + b.low + b.close) / 3 / a.close - 1) / 0.005, 0) AS INT) AS k, sum(b.volume ORDER BY b.i) AS v, min(b.i) AS first FROM t a JOIN t b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 59 AND a.i GROUP BY 1, 2, 3, 4),
hvn AS (SELECT symbol, d, CASE WHEN max(i) >= 19 THEN round(arg_max(k, row(v, -first)) * 0.005 * 100, 2) END AS hvn_pct FROM h0 GROUP BY symbol, d)"""
ORACLE_SQL["daily_hvn"] = f"WITH {BARS}{HVN} SELECT * FROM hvn"
_over_bars("forward_returns", ", ".join(f"round((lead(close, {h}) OVER w - close) / close, 6) AS return_{h}d" for h in (5, 10, 20, 30, 60)))


def _smooth(name: str, source: str, value: str, decay: float, gain: float, n: int, seed: str = "mean", start: int = 0) -> str:
    """A CTE (symbol, i, y): y[start + n - 1] = mean (or sum) of n values, then y[t] = decay * y[t - 1] + gain * value[t], as one weighted sum."""
    first = start + n - 1
    share = f"/ {n}.0" if seed == "mean" else ""
    return f"""{name} AS (SELECT a.symbol, a.i, sum(CASE WHEN b.i > {first} THEN {gain!r} * pow({decay!r}, a.i - b.i) * b.{value} ELSE pow({decay!r}, a.i - {first}) * b.{value} {share} END) AS y
FROM {source} a JOIN {source} b ON a.symbol = b.symbol AND b.i BETWEEN {start} AND a.i WHERE a.i >= {first} GROUP BY 1, 2)"""


def _ema(name: str, source: str, n: int, first: bool = False, value: str = "close", start: int = 0) -> str:
    k = 2 / (n + 1)
    return _smooth(name, source, value, 1 - k, k, 1 if first else n, start=start)


def _rsi(name: str, source: str, key: str) -> str:
    """Two CTEs and one named name (symbol, key, rsi)."""
    return f"""{name}_d AS (SELECT *, greatest(close - pc, 0) AS up, greatest(pc - close, 0) AS down FROM {source}),
{_smooth(name + '_g', name + '_d', 'up', 13 / 14, 1 / 14, 14, start=1)}, {_smooth(name + '_l', name + '_d', 'down', 13 / 14, 1 / 14, 14, start=1)},
{name} AS (SELECT d.symbol, d.{key}, d.i, CASE WHEN g.y IS NULL THEN 50.0 WHEN l.y = 0 THEN 100.0 ELSE round(100 - 100 / (1 + g.y / l.y), 2) END AS rsi FROM {name}_d d LEFT JOIN {name}_g g USING (symbol, i) LEFT JOIN {name}_l l USING (symbol, i))"""


def _macd(name: str, source: str, key: str) -> str:
    return f"""{_ema(name + '_f', source, 12, True)}, {_ema(name + '_s', source, 26, True)},
{name}_m AS (SELECT symbol, i, f.y - s.y AS line FROM {name}_f f JOIN {name}_s s USING (symbol, i)), {_ema(name + '_e', name + '_m', 9, True, 'line')},
{name}_h AS (SELECT x.symbol, x.{key}, x.i, CASE WHEN i >= 34 THEN round(line, 4) END AS macd, CASE WHEN i >= 34 THEN round(e.y, 4) END AS signal, CASE WHEN i >= 34 THEN round(line - e.y, 4) END AS hist FROM {source} x JOIN {name}_m USING (symbol, i) JOIN {name}_e e USING (symbol, i)),
{name}_l AS (SELECT *, lag(macd) OVER w AS pm, lag(signal) OVER w AS ps, coalesce(lag(hist) OVER w, 0) AS h1, coalesce(lag(hist, 2) OVER w, 0) AS h2, coalesce(lag(hist, 3) OVER w, 0) AS h3, lag(hist) OVER w AS prev FROM {name}_h WINDOW w AS (PARTITION BY symbol ORDER BY i)),
{name} AS (SELECT *, CASE WHEN pm < ps AND macd > signal THEN 'bullish_cross' WHEN pm > ps AND macd < signal THEN 'bearish_cross' END AS macd_alert,
  CASE WHEN hist IS NULL THEN 2 WHEN h2 > h3 AND h1 > h2 AND hist < 0 THEN 10 WHEN h2 > h3 AND h1 > h2 AND hist > 0 THEN 7 WHEN hist > 0 THEN 5 ELSE 2 END AS convergence_points FROM {name}_l)"""


RSI, MACD = _rsi("rsi", "t", "d"), _macd("md", "t", "d")
ORACLE_SQL["rsi"] = f"WITH {BARS}, {RSI} SELECT symbol, d, rsi FROM rsi"
ORACLE_SQL["macd"] = f"WITH {BARS}, {MACD} SELECT symbol, d, macd, signal, hist FROM md"
ORACLE_SQL["macd_signals"] = f"WITH {BARS}, {MACD} SELECT symbol, d, macd_alert, convergence_points FROM md"
EMAS = f"""{_ema('e20', 't', 20)}, {_ema('e50', 't', 50)}, {_ema('e200', 't', 200)},
ema AS (SELECT t.symbol, t.d, t.i, close, e20.y AS a, e50.y AS b, e200.y AS c FROM t LEFT JOIN e20 USING (symbol, i) LEFT JOIN e50 USING (symbol, i) LEFT JOIN e200 USING (symbol, i)),
stack AS (SELECT *, CASE WHEN c IS NOT NULL THEN CASE WHEN close < a AND a > b AND b > c THEN 10 WHEN close < b AND b > c THEN 7 WHEN close > a AND a > b THEN 5 WHEN a < b THEN 2 ELSE 4 END
  WHEN b IS NOT NULL AND close < a AND a > b THEN 7 ELSE 3 END AS structure_points FROM ema)"""
ORACLE_SQL["ema_stack"] = f"WITH {BARS}, {EMAS} SELECT symbol, d, round(a, 3) AS ema20, round(b, 3) AS ema50, round(c, 3) AS ema200, structure_points FROM stack"
ORACLE_SQL["ema_reclaim"] = f"""WITH {BARS}, {EMAS}, p AS (SELECT *, coalesce(lag(close) OVER w < lag(a) OVER w AND close >= a, false) AS crossed FROM ema {WIN})
SELECT symbol, d, i >= 24 AND close > a AS above, i >= 24 AND bool_or(crossed) OVER w5 AS just_crossed, CASE WHEN i >= 24 THEN round((close - a) / a * 100, 2) ELSE 0.0 END AS distance_pct FROM p {WIN}"""
ORACLE_SQL["macd_hist_scan"] = f"""WITH {BARS}, {_ema('f', 't', 12)}, {_ema('s', 't', 26)}, m AS (SELECT s.symbol, s.i - 25 AS i, f.y - s.y AS line FROM s JOIN f ON s.symbol = f.symbol AND f.i = s.i - 14),
{_ema('e', 'm', 9, False, 'line')}, h AS (SELECT t.symbol, t.d, t.i, CASE WHEN t.i >= 34 THEN round(line - e.y, 6) END AS hist FROM t LEFT JOIN m ON m.symbol = t.symbol AND m.i = t.i - 25 LEFT JOIN e ON e.symbol = t.symbol AND e.i = t.i - 25)
SELECT symbol, d, coalesce(hist, 0.0) AS macd_hist, coalesce(lag(hist) OVER (PARTITION BY symbol ORDER BY d), hist, 0.0) AS macd_hist_prev FROM h"""
ORACLE_SQL["adx"] = f"""WITH {BARS}, p AS (SELECT *, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn FROM t {WIN}),
q AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS pm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS nm FROM p),
{_smooth('a', 'q', 'tr', 13 / 14, 1.0, 14, 'sum', 1)}, {_smooth('b', 'q', 'pm', 13 / 14, 1.0, 14, 'sum', 1)}, {_smooth('c', 'q', 'nm', 13 / 14, 1.0, 14, 'sum', 1)},
di AS (SELECT symbol, i, 100 * b.y / a.y AS p, 100 * c.y / a.y AS m FROM a JOIN b USING (symbol, i) JOIN c USING (symbol, i) WHERE a.y <> 0),
dx AS (SELECT *, avg(CASE WHEN p + m = 0 THEN 0.0 ELSE 100 * abs(p - m) / (p + m) END) OVER (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING) AS adx FROM di)
SELECT t.symbol, t.d, CASE WHEN t.i >= 28 THEN round(adx, 2) ELSE 0.0 END AS adx, CASE WHEN t.i >= 28 THEN round(p, 2) ELSE 0.0 END AS plus_di, CASE WHEN t.i >= 28 THEN round(m, 2) ELSE 0.0 END AS minus_di FROM t LEFT JOIN dx USING (symbol, i)"""
DIVERGENCE = """dv_d AS (SELECT symbol, i, close, greatest(close - pc, 0) AS up, greatest(pc - close, 0) AS down FROM t),
dv_r AS (SELECT a.symbol, a.i, k, sum(CASE WHEN b.i - a.i + 33 <= 14 THEN pow(13.0 / 14, k - 14) / 14 ELSE pow(13.0 / 14, k - (b.i - a.i + 33)) / 14 END * b.up) AS g, sum(CASE WHEN b.i - a.i + 33 <= 14 THEN pow(13.0 / 14, k - 14) / 14 ELSE pow(13.0 / 14, k - (b.i - a.i + 33)) / 14 END * b.down) AS l
  FROM dv_d a CROSS JOIN (SELECT unnest(range(14, 34)) AS k) JOIN dv_d b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 32 AND a.i - 33 + k WHERE a.i >= 33 GROUP BY 1, 2, 3),
dv_v AS (SELECT r.symbol, r.i, k, CASE WHEN l = 0 THEN 100.0 ELSE round(100 - 100 / (1 + g / l), 2) END AS rsi, b.close FROM dv_r r JOIN dv_d b ON r.symbol = b.symbol AND b.i = r.i - 33 + k),
dv AS (SELECT symbol, i, min(close) FILTER (WHERE k >= 24) < min(close) FILTER (WHERE k < 24) AND min(rsi) FILTER (WHERE k >= 24) > min(rsi) FILTER (WHERE k < 24) AS divergence FROM dv_v GROUP BY 1, 2)"""
ORACLE_SQL["rsi_divergence"] = f"WITH {BARS}, {DIVERGENCE} SELECT t.symbol, t.d, coalesce(divergence, false) AS divergence FROM t LEFT JOIN dv USING (symbol, i)"
WEEK_SCORES = f"""{WEEKS}, wx AS (SELECT *, row_number() OVER w - 1 AS i, lag(close) OVER w AS pc FROM weeks WINDOW w AS (PARTITION BY symbol ORDER BY week)), {_rsi('wr', 'wx', 'week')}, {_macd('wm', 'wx', 'week')},
ws AS (SELECT wr.symbol, wr.week, rsi, hist, CASE WHEN wr.i < 13 THEN 1 WHEN rsi < 30 THEN 4 WHEN rsi < 40 THEN 3 WHEN rsi < 50 THEN 2 WHEN rsi >= 70 THEN 0 ELSE 1 END AS rsi_points,
  CASE WHEN hist IS NULL THEN 1 WHEN hist > 0 THEN 4 WHEN hist > coalesce(prev, hist) THEN 3 ELSE 0 END AS macd_points FROM wr JOIN wm USING (symbol, week))"""
#: Of every bar, its week's RSI and histograms with the bar's close as the week's, one step from the closed weeks before it.
_step = lambda name, own, n: f"CASE WHEN w.i = 0 THEN {own} ELSE {name}.y * {1 - 2 / (n + 1)!r} + {own} * {2 / (n + 1)!r} END"
WEEK_TO_DATE = f"""wd0 AS (SELECT t.symbol, t.d, t.close, w.i, p.close AS before FROM t JOIN wx w ON w.symbol = t.symbol AND w.week = date_trunc('week', t.d) LEFT JOIN wx p ON p.symbol = w.symbol AND p.i = w.i - 1),
wd1 AS (SELECT symbol, sum(up) FILTER (WHERE i BETWEEN 1 AND 13) AS up13, sum(down) FILTER (WHERE i BETWEEN 1 AND 13) AS down13 FROM wr_d GROUP BY 1),
wd2 AS (
  SELECT w.*, CASE WHEN w.i = 14 THEN (up13 + greatest(w.close - before, 0)) / 14 WHEN w.i > 14 THEN g.y * 13 / 14 + greatest(w.close - before, 0) / 14 END AS gain,
         CASE WHEN w.i = 14 THEN (down13 + greatest(before - w.close, 0)) / 14 WHEN w.i > 14 THEN l.y * 13 / 14 + greatest(before - w.close, 0) / 14 END AS loss,
         {_step('f', 'w.close', 12)} - {_step('s', 'w.close', 26)} AS line, e.y AS signal, h.hist AS hist_before
  FROM wd0 w JOIN wd1 USING (symbol) LEFT JOIN wr_g g ON g.symbol = w.symbol AND g.i = w.i - 1 LEFT JOIN wr_l l ON l.symbol = w.symbol AND l.i = w.i - 1
  LEFT JOIN wm_f f ON f.symbol = w.symbol AND f.i = w.i - 1 LEFT JOIN wm_s s ON s.symbol = w.symbol AND s.i = w.i - 1
  LEFT JOIN wm_e e ON e.symbol = w.symbol AND e.i = w.i - 1 LEFT JOIN wm_h h ON h.symbol = w.symbol AND h.i = w.i - 1
), wd3 AS (
  SELECT symbol, d, i, CASE WHEN gain IS NULL THEN 50.0 WHEN loss = 0 THEN 100.0 ELSE round(100 - 100 / (1 + gain / loss), 2) END AS rsi,
         CASE WHEN i >= 34 THEN round(line - (signal * 0.8::DOUBLE + line * 0.2::DOUBLE), 4) END AS hist, hist_before
  FROM wd2
), wd AS (
  SELECT symbol, d, CASE WHEN i < 13 THEN 1 WHEN rsi < 30 THEN 4 WHEN rsi < 40 THEN 3 WHEN rsi < 50 THEN 2 WHEN rsi >= 70 THEN 0 ELSE 1 END AS rsi_points,
         CASE WHEN hist IS NULL THEN 1 WHEN hist > 0 THEN 4 WHEN hist > coalesce(hist_before, hist) THEN 3 ELSE 0 END AS macd_points
  FROM wd3
)"""
ORACLE_SQL["weekly_rsi_macd"] = f"WITH {BARS}, {WEEK_SCORES} SELECT * FROM ws"

# scores
LAYERS = f"""{TURN}, l0 AS (SELECT *, round(CAST({EVSR} AS DOUBLE), 12) AS evsr, {UPVOL} AS upvol, cmf_prev < -0.02 AND cmf_now > cmf_prev AS tu, cmf_now > 0.02 AS po FROM c1 {WIN}),
l1 AS (SELECT *, CASE WHEN po AND NOT tu THEN 50 WHEN tu AND NOT po THEN 30 WHEN po AND tu THEN 10 WHEN cmf_now > -0.05 THEN 5 ELSE 0 END AS layer_A, CASE WHEN evsr >= 2.5 THEN 30 WHEN evsr >= 2 THEN 22 WHEN evsr >= 1.5 THEN 15 WHEN evsr >= 1 THEN 8 ELSE 0 END AS layer_B FROM l0)"""


def _score(source: str) -> str:
    return f"""(SELECT *, CAST(least(100, round_even(raw * macro_mult / 80 * 100, 0)) AS INT) AS score, CASE layer_A WHEN 50 THEN 'held_positive' WHEN 30 THEN 'turning' WHEN 10 THEN 'turned' WHEN 5 THEN 'neutral' ELSE 'sell_pressure' END AS cmf_state,
  CASE WHEN evsr >= 2.5 THEN '>=2.5' WHEN evsr >= 2 THEN '>=2.0' WHEN evsr >= 1.5 THEN '>=1.5' WHEN evsr >= 1 THEN '>=1.0' ELSE '<1.0' END AS evsr_tier
  FROM (SELECT *, layer_A + layer_B AS raw, CASE WHEN vix >= 25 THEN 0.8::DOUBLE WHEN btc_above THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS macro_mult FROM {source}))"""


SCAN = f"{BARS}{LAYERS}, {MACRO}, sc AS {_score('(SELECT l1.*, p.btc_above, p.vix FROM l1, point p WHERE l1.i = l1.n - 1 AND l1.i >= 29)')}"
SCAN_COLUMNS = f"symbol, sector, d, round(close, 6) AS close, cmf_now, round(evsr, 6) AS evsr, upvol, layer_A, layer_B, raw, macro_mult, score, {GRADE.format('score')} AS grade, cmf_state, evsr_tier"
ORACLE_SQL["market_scan"] = f"WITH {SCAN} SELECT {SCAN_COLUMNS} FROM sc"
ORACLE_SQL["scan_top15"] = f"WITH {SCAN} SELECT symbol, sector, score, {GRADE.format('score')} AS grade FROM sc ORDER BY score DESC, symbol LIMIT 15"
ORACLE_SQL["scan_bottom10"] = f"WITH {SCAN} SELECT symbol, sector, score, {GRADE.format('score')} AS grade FROM sc ORDER BY score, symbol LIMIT 10"
ORACLE_SQL["sector_rollup"] = f"""WITH {SCAN}, g AS (SELECT sector, CAST(round_even(avg(score), 0) AS INT) AS average, count(*) AS count, string_agg(symbol, ',' ORDER BY symbol) AS tickers FROM sc GROUP BY sector)
SELECT *, CASE WHEN average >= 70 THEN 'Strong' WHEN average >= 55 THEN 'Bullish' WHEN average >= 40 THEN 'Neutral' WHEN average >= 25 THEN 'Bearish' ELSE 'Weak' END AS grade FROM g"""
ORACLE_SQL["layer_champion"] = f"""WITH {SCAN}, g AS (SELECT sector, round_even(avg(score), 0) AS m, CAST(round_even(avg(layer_A), 0) AS INT) AS a, CAST(round_even(avg(layer_B), 0) AS INT) AS b FROM sc GROUP BY sector)
(SELECT 'A' AS layer, sector, a AS points FROM g ORDER BY a DESC, m DESC, sector LIMIT 1) UNION ALL (SELECT 'B', sector, b FROM g ORDER BY b DESC, m DESC, sector LIMIT 1)"""
RETURNS = ", ".join(f"(lead(close, {h}) OVER (PARTITION BY symbol ORDER BY d) - close) / close AS return_{h}d" for h in (5, 10, 20, 30, 60))
SCORED = f"""{BARS}{LAYERS}, {MACRO}, l2 AS (SELECT *, {RETURNS} FROM l1),
sc AS {_score('(SELECT l2.*, coalesce(m.btc_close > m.btc_sma20, false) AS btc_above, coalesce(m.vix, 0) AS vix FROM l2 LEFT JOIN macro m ON m.d = l2.d WHERE l2.i >= 130 AND l2.i >= l2.n - 504)')}"""
ORACLE_SQL["rolling_scores"] = f"WITH {SCORED} SELECT {SCAN_COLUMNS}, CASE WHEN score >= 80 THEN 200.0 WHEN score >= 60 THEN 100.0 WHEN score >= 40 THEN 50.0 ELSE 0.0 END AS buy_target FROM sc"
ORACLE_SQL["score_distribution"] = f"WITH {SCORED} SELECT symbol, count(*) AS n, round(avg(score), 6) AS mean, quantile_cont(score, 0.5) AS median, round(avg(CASE WHEN score >= 61 THEN 1.0 ELSE 0.0 END), 6) AS high_share FROM sc GROUP BY symbol"
HS = (5, 10, 20, 30, 60)
LABELLED = f"""{SCORED}, wh AS (SELECT * FROM sc WHERE {' AND '.join(f'return_{h}d IS NOT NULL' for h in HS)}),
qs AS (SELECT symbol, {', '.join(f'quantile_cont(return_{h}d, 0.01) AS lo{h}, quantile_cont(return_{h}d, 0.99) AS hi{h}' for h in HS)} FROM wh GROUP BY symbol),
la AS (SELECT wh.* REPLACE ({', '.join(f'CASE WHEN return_{h}d BETWEEN lo{h} AND hi{h} THEN return_{h}d END AS return_{h}d' for h in HS)}) FROM wh JOIN qs USING (symbol)),
lg AS ({' UNION ALL '.join(f'SELECT *, {h} AS horizon, return_{h}d AS r FROM la' for h in HS)})"""
ORACLE_SQL["forward_returns_clipped"] = f"WITH {LABELLED} SELECT symbol, d, score, {', '.join(f'round(return_{h}d, 6) AS return_{h}d' for h in HS)} FROM la"


def _stats(least: int) -> str:
    g = lambda c: f"CASE WHEN count(r) >= {least} THEN round({c}, 6) END"
    wins = "avg(CASE WHEN r > 0 THEN 1.0::DOUBLE WHEN r <= 0 THEN 0.0::DOUBLE END)"
    return f"count(r) AS count, {g('avg(r)')} AS avg, {g(wins)} AS winrate, {g(f'avg(r) * {wins}')} AS ev"


BUCKET_LIST = ((0, 10), (11, 20), (21, 30), (31, 40), (41, 50), (51, 60), (61, 75), (76, 100))
BUCKETS = f"""{LABELLED}, bu AS (SELECT *, CASE {' '.join(f"WHEN score BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in BUCKET_LIST)} END AS bucket FROM lg),
gr AS (SELECT symbol, bucket, horizon FROM (SELECT DISTINCT symbol FROM la), (VALUES {', '.join(f"('{a}-{b}')" for a, b in BUCKET_LIST)}) b(bucket), (VALUES {', '.join(f'({h})' for h in HS)}) h(horizon)),
st AS (SELECT symbol, bucket, horizon, count(*) AS bucket_count, {_stats(3)}, CASE WHEN count(r) >= 3 THEN round(quantile_cont(r, 0.5), 6) END AS median, CASE WHEN count(r) >= 3 THEN round(stddev_samp(r), 6) END AS std FROM bu GROUP BY 1, 2, 3),
ba AS (SELECT symbol, bucket, horizon, coalesce(bucket_count, 0) AS bucket_count, coalesce(count, 0) AS count, avg, median, winrate, ev, std FROM gr LEFT JOIN st USING (symbol, bucket, horizon))"""
ORACLE_SQL["bucket_analysis"] = f"WITH {BUCKETS} SELECT * FROM ba"
ORACLE_SQL["sweet_spot"] = f"WITH {BUCKETS} SELECT DISTINCT ON (symbol) symbol, bucket, avg, winrate, ev FROM ba WHERE horizon = 10 AND count >= 5 AND winrate >= 0.5 AND avg > 0 ORDER BY symbol, ev DESC, CAST(split_part(bucket, '-', 1) AS INT)"


def _spearman(names: tuple[str, ...]) -> str:
    parts = " UNION ALL ".join(f"SELECT symbol, '{c}' AS name, horizon, CAST({c} AS DOUBLE) AS x, r FROM lg WHERE r IS NOT NULL" for c in names)
    group = "PARTITION BY symbol, name, horizon"
    return f"""WITH {LABELLED}, p AS ({parts}),
q AS (SELECT *, rank() OVER ({group} ORDER BY x) + (count(*) OVER ({group}, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER ({group} ORDER BY r) + (count(*) OVER ({group}, r) - 1) / 2.0::DOUBLE AS ry, quantile_cont(x, 0.5) OVER ({group}) AS med FROM p)
SELECT symbol, name, horizon, count(*) AS count, CASE WHEN count(*) >= 10 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN round(corr(rx, ry), 4) END AS spearman,
       CASE WHEN count(*) >= 10 THEN round(avg(r) FILTER (WHERE x >= med) - avg(r) FILTER (WHERE x < med), 4) END AS edge FROM q GROUP BY 1, 2, 3"""


ORACLE_SQL["layer_spearman"] = _spearman(("layer_A", "layer_B"))
ORACLE_SQL["indicator_spearman"] = _spearman(("cmf_now", "evsr", "upvol"))
for _name, _tiers in {
    "layer_tiers": "SELECT *, CASE WHEN x <= q33 THEN 'LOW' WHEN x <= q67 THEN 'MID' ELSE 'HIGH' END AS tier FROM p JOIN q USING (symbol, layer)",
    "layer_tiers_compat": "SELECT *, 'LOW' AS tier FROM p JOIN q USING (symbol, layer) WHERE x <= q0 UNION ALL SELECT *, 'MID' FROM p JOIN q USING (symbol, layer) WHERE x > q33 AND x <= q67 UNION ALL SELECT *, 'HIGH' FROM p JOIN q USING (symbol, layer) WHERE x > q100",
}.items():
    ORACLE_SQL[_name] = f"""WITH {LABELLED}, p AS (SELECT symbol, 'A' AS layer, horizon, layer_A AS x, r FROM lg UNION ALL SELECT symbol, 'B', horizon, layer_B, r FROM lg),
q AS (SELECT symbol, layer, quantile_cont(x, 0.0) AS q0, quantile_cont(x, 0.33) AS q33, quantile_cont(x, 0.67) AS q67, quantile_cont(x, 1.0) AS q100 FROM p WHERE horizon = 5 GROUP BY 1, 2), z AS ({_tiers})
SELECT symbol, layer, tier, horizon, count(*) AS tier_count, {_stats(3)} FROM z GROUP BY 1, 2, 3, 4"""
COMBOS = f"""{LABELLED}, md AS (SELECT symbol, quantile_cont(layer_A, 0.5) AS ma, quantile_cont(layer_B, 0.5) AS mb FROM la GROUP BY 1),
fl AS (SELECT symbol, CAST(layer_A >= ma AS INT) AS a_high, CAST(layer_B >= mb AS INT) AS b_high, return_10d AS r FROM la JOIN md USING (symbol)),
co AS (SELECT symbol, a_high, b_high, {_stats(5)} FROM fl WHERE a_high + b_high > 0 GROUP BY 1, 2, 3),
cb AS (SELECT symbol, a_high, b_high, count, round(avg, 4) AS avg_10d, round(winrate, 4) AS wr_10d, round(ev, 4) AS ev_10d FROM co WHERE count >= 5)"""
ORACLE_SQL["layer_combos"] = f"WITH {COMBOS} SELECT * FROM cb"
ORACLE_SQL["best_combos"] = f"WITH {COMBOS} SELECT * FROM cb WHERE ev_10d > 0 ORDER BY ev_10d DESC, symbol, a_high, b_high LIMIT 12"
TIERS = f"""{LABELLED}, p AS (
  SELECT symbol, return_10d AS r, 'cmf_now' AS indicator, CASE WHEN cmf_now <= -0.15 THEN 'strong selling' WHEN cmf_now <= -0.05 THEN 'selling' WHEN cmf_now <= 0.05 THEN 'neutral' WHEN cmf_now <= 0.15 THEN 'buying' ELSE 'strong buying' END AS tier FROM la
  UNION ALL SELECT symbol, return_10d, 'evsr', CASE WHEN evsr <= 1 THEN 'none' WHEN evsr <= 1.5 THEN 'weak' WHEN evsr <= 2 THEN 'medium' WHEN evsr <= 2.5 THEN 'strong' ELSE 'strongest' END FROM la
  UNION ALL SELECT symbol, return_10d, 'upvol', CASE WHEN upvol <= 0.75 THEN 'strong down' WHEN upvol <= 1 THEN 'down' WHEN upvol <= 1.5 THEN 'neutral' WHEN upvol <= 2 THEN 'up' ELSE 'strong up' END FROM la
), it AS (SELECT symbol, indicator, tier, {_stats(3)} FROM p GROUP BY 1, 2, 3)"""
ORACLE_SQL["indicator_tiers"] = f"WITH {TIERS} SELECT * FROM it"
ORACLE_SQL["best_indicator_tiers"] = f"WITH {TIERS} SELECT DISTINCT ON (symbol, indicator) * FROM it WHERE count >= 5 ORDER BY symbol, indicator, ev DESC, tier"
_wins = "avg(CASE WHEN return_10d > 0 THEN 1.0::DOUBLE WHEN return_10d <= 0 THEN 0.0::DOUBLE END)"
ORACLE_SQL["cmf_evsr_cross"] = f"""WITH {LABELLED}
SELECT symbol, cmf_state, NULL AS evsr_tier, count(return_10d) AS count, round(avg(return_10d), 4) AS avg_10d, round({_wins}, 4) AS wr_10d, NULL::DOUBLE AS ev_10d, round(avg(return_20d), 4) AS avg_20d FROM la GROUP BY 1, 2
UNION ALL SELECT symbol, cmf_state, evsr_tier, count(return_10d), CASE WHEN count(return_10d) >= 3 THEN round(avg(return_10d), 4) END, CASE WHEN count(return_10d) >= 3 THEN round({_wins}, 4) END, CASE WHEN count(return_10d) >= 3 THEN round(avg(return_10d) * {_wins}, 4) END, NULL FROM la GROUP BY 1, 2, 3"""
ORACLE_SQL["return_histogram"] = f"""WITH {LABELLED}, s AS (SELECT CASE WHEN score >= 61 THEN 'high' WHEN score <= 40 THEN 'low' END AS side, return_10d AS r FROM la WHERE return_10d IS NOT NULL AND (score >= 61 OR score <= 40)),
e AS (SELECT min(r) AS lo, max(r) AS hi FROM s) SELECT side, CAST(least(39, coalesce(floor((r - lo) / nullif((hi - lo) / 40, 0)), 0)) AS INT) AS bin, count(*) AS n FROM s, e GROUP BY 1, 2"""
EVER = "(PARTITION BY symbol ORDER BY d ROWS UNBOUNDED PRECEDING)"
# cash as a recursion over days, not in closed form
DYNAMIC = f"""RECURSIVE {SCORED}, dy AS MATERIALIZED (SELECT symbol, d, score, close, row_number() OVER (PARTITION BY symbol ORDER BY d) AS k, CASE WHEN score >= 80 THEN 200.0::DOUBLE WHEN score >= 60 THEN 100.0::DOUBLE WHEN score >= 40 THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END AS target FROM sc WHERE close > 0),
cs AS (SELECT symbol, k, least(target, 100.0::DOUBLE) AS buy, 100.0::DOUBLE - least(target, 100.0::DOUBLE) AS cash FROM dy WHERE k = 1
  UNION ALL SELECT dy.symbol, dy.k, least(dy.target, cs.cash + 100), cs.cash + 100 - least(dy.target, cs.cash + 100) FROM cs JOIN dy ON dy.symbol = cs.symbol AND dy.k = cs.k + 1),
pl AS (SELECT symbol, d, score, close, buy, cash, sum(buy / close) OVER {EVER} AS shares, sum(buy / close) OVER {EVER} * close + cash AS portfolio, k * 100.0::DOUBLE AS total_input FROM dy JOIN cs USING (symbol, k))"""
BASELINE = f"""bl AS (SELECT symbol, d, score, close, 100.0::DOUBLE AS buy, 0.0::DOUBLE AS cash, sum(100.0::DOUBLE / close) OVER {EVER} AS shares, sum(100.0::DOUBLE / close) OVER {EVER} * close AS portfolio, row_number() OVER (PARTITION BY symbol ORDER BY d) * 100.0::DOUBLE AS total_input FROM sc WHERE close > 0)"""
PLAN_COLUMNS = "symbol, d, score, round(close, 3) AS close, round(buy, 3) AS buy, round(cash, 3) AS cash, round(shares, 3) AS shares, round(portfolio, 3) AS portfolio, total_input"


def _summary(source: str) -> str:
    return f"""(SELECT symbol, round(arg_max(shares, d), 4) AS shares, round(arg_max(cash, d), 2) AS cash_left, max(total_input) AS total_input, round(arg_max(portfolio, d), 2) AS final_value, round((arg_max(portfolio, d) - max(total_input)) / max(total_input), 4) AS total_return,
  round(max(total_input) / arg_max(shares, d), 4) AS avg_cost, round(min(fall), 4) AS mdd FROM (SELECT *, (portfolio - max(portfolio) OVER {EVER}) / max(portfolio) OVER {EVER} AS fall FROM {source}) GROUP BY symbol)"""


ORACLE_SQL["dca_dynamic"] = f"WITH {DYNAMIC} SELECT {PLAN_COLUMNS} FROM pl"
ORACLE_SQL["dca_baseline"] = f"WITH {SCORED}, {BASELINE} SELECT {PLAN_COLUMNS} FROM bl"
ORACLE_SQL["dca_summary"] = f"WITH {DYNAMIC} SELECT * FROM {_summary('pl')}"
ORACLE_SQL["dca_compared"] = f"WITH {DYNAMIC}, {BASELINE} SELECT symbol, round(a.total_return - b.total_return, 4) AS total_return_diff, round(a.mdd - b.mdd, 4) AS mdd_diff, round(a.avg_cost - b.avg_cost, 4) AS avg_cost_diff FROM {_summary('pl')} a JOIN {_summary('bl')} b USING (symbol)"

# comparisons
BETA = "rt AS (SELECT symbol, d, (close - pc) / pc AS r FROM x WHERE pc IS NOT NULL), be AS (SELECT a.symbol, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(covar_pop(a.r, b.r) / nullif(var_pop(b.r), 0), 3) END AS beta FROM rt a JOIN rt b ON a.d = b.d AND b.symbol = 'NATION_0' GROUP BY 1)"
ORACLE_SQL["beta_by_date"] = f"WITH {BARS}, {BETA} SELECT * FROM be"
ORACLE_SQL["beta_compat"] = f"""WITH {BARS}, la AS (SELECT symbol, close AS last FROM x WHERE i = n - 1), rt AS (SELECT symbol, i, (close - coalesce(pc, last)) / coalesce(pc, last) AS r FROM x JOIN la USING (symbol))
SELECT a.symbol, count(*) AS n, CASE WHEN count(*) >= 30 THEN round(covar_pop(a.r, b.r) / nullif(var_pop(b.r), 0), 3) END AS beta FROM rt a JOIN rt b ON a.i = b.i AND b.symbol = 'NATION_0' GROUP BY 1"""
ORACLE_SQL["btc_corr"] = f"""WITH {BARS}, {MACRO}, o AS (SELECT row_number() OVER (ORDER BY d DESC) AS k, (btc_close - lag(btc_close) OVER (ORDER BY d)) / lag(btc_close) OVER (ORDER BY d) AS m FROM macro),
s AS (SELECT symbol, n - i AS k, (close - pc) / pc AS r FROM x), g AS (SELECT symbol, CASE WHEN count(*) = 30 AND stddev_pop(r) > 0 AND stddev_pop(m) > 0 THEN round(corr(r, m), 3) END AS corr FROM s JOIN o USING (k) WHERE k <= 30 AND r IS NOT NULL AND m IS NOT NULL GROUP BY symbol)
SELECT *, CASE WHEN corr >= 0.7 THEN 'high' WHEN corr >= 0.4 THEN 'moderate' WHEN corr IS NOT NULL THEN 'low' END AS signal FROM g"""
_of = lambda c, a, b: f"CASE WHEN {c} >= {a} THEN 'much stronger' WHEN {c} >= {b} THEN 'stronger' WHEN {c} <= -{a} THEN 'much weaker' WHEN {c} <= -{b} THEN 'weaker' ELSE 'in line' END"
CHANGES = "ch AS (SELECT symbol, round(round((close - pc) / pc * 100, 4), 2) AS change_pct FROM x WHERE i = n - 1)"
ORACLE_SQL["beta_divergence"] = f"""WITH {BARS}, {BETA}, {CHANGES}, mk AS (SELECT max(change_pct) FILTER (WHERE symbol = 'NATION_0') AS m, avg(change_pct) FILTER (WHERE symbol IN ('NATION_1', 'NATION_2')) AS p FROM ch),
v AS (SELECT symbol, change_pct, round(beta * m, 2) AS expected, round(change_pct - round(beta * m, 2), 2) AS divergence, round(p, 2) AS peer_avg, round(change_pct - round(p, 2), 2) AS peer_diff FROM ch JOIN be USING (symbol), mk)
SELECT symbol, expected, divergence, {_of('divergence', 3, 1)} AS signal, peer_avg, peer_diff, {_of('peer_diff', 2, 0.5)} AS peer_signal FROM v"""
ITEMS = f"""{BARS}{MFI}{STOCH}{OBV}{HVN}, {RSI}, {MACD}, {EMAS}, {DIVERGENCE}, {WEEK_SCORES}, {WEEK_TO_DATE},
f AS (SELECT *, {CONTRACTION} AS ratio, CASE WHEN i >= 20 THEN coalesce(round(sum({MF}) OVER w21 / nullif(sum(CASE WHEN high <> low THEN volume ELSE 0.0 END) OVER w21, 0), 4), 0.0) END AS cmf, {DRAWDOWN} AS dd, avg(close) OVER w20 - 2 * stddev_pop(close) OVER w20 AS lower FROM t {WIN}),
items AS (SELECT symbol, f.d, obv_points AS A1, CASE WHEN mfi IS NULL THEN 0 WHEN mfi < 20 THEN 10 WHEN mfi < 30 THEN 7 WHEN mfi < 40 THEN 4 WHEN mfi > 80 THEN 0 ELSE 1 END AS A2,
  CASE WHEN ratio IS NULL THEN 0 WHEN ratio < 0.70 THEN 8 WHEN ratio < 0.85 THEN 5 WHEN ratio < 1 THEN 2 ELSE 0 END AS A3, CASE WHEN cmf > 0.15 THEN 7 WHEN cmf > 0.05 THEN 5 WHEN cmf > -0.05 THEN 2 WHEN cmf > -0.15 THEN 1 WHEN cmf IS NULL THEN 2 ELSE 0 END AS A4,
  convergence_points AS B1, structure_points AS B2, CASE WHEN hvn_pct IS NULL THEN 2 WHEN hvn_pct < -3 THEN 5 WHEN hvn_pct < -1 THEN 4 WHEN hvn_pct < 1 THEN 2 WHEN hvn_pct < 4 THEN 1 ELSE 0 END AS B3,
  CASE WHEN rsi.rsi <= 25 THEN 8 WHEN rsi.rsi <= 30 THEN 7 WHEN rsi.rsi <= 40 THEN 5 WHEN rsi.rsi <= 50 THEN 2 WHEN rsi.rsi >= 70 THEN 0 ELSE 1 END AS C1,
  CASE WHEN stoch_k IS NULL THEN 1 WHEN stoch_k < 20 AND stoch_d < 20 AND stoch_k > stoch_d THEN 7 WHEN stoch_k < 20 AND stoch_d < 20 THEN 4 WHEN stoch_k < 50 AND stoch_k > stoch_d THEN 2 WHEN stoch_k > 80 THEN 0 ELSE 1 END AS C2,
  CASE WHEN divergence THEN 5 ELSE 0 END AS C3, CASE WHEN f.close < lower THEN 7 WHEN lower <= 0 OR (f.close - lower) / lower * 100 < 3 THEN 5 ELSE 2 END AS D1, CASE WHEN dd IS NULL THEN 2 WHEN dd < 1.5 THEN 5 WHEN dd < 2.5 THEN 2 ELSE 0 END AS D2, rsi_points AS E1, macd_points AS E2
  FROM f JOIN obv USING (symbol, d) JOIN mfi USING (symbol, d) JOIN stoch USING (symbol, d) JOIN hvn USING (symbol, d) JOIN rsi USING (symbol, d) JOIN md USING (symbol, d) JOIN stack USING (symbol, d) LEFT JOIN dv ON dv.symbol = f.symbol AND dv.i = f.i JOIN wd ON wd.symbol = f.symbol AND wd.d = f.d WHERE f.i >= 29)"""
ITEMS = ITEMS.replace("items AS (SELECT symbol,", "items AS (SELECT f.symbol,")
ORACLE_SQL["technical_score_items"] = f"WITH {ITEMS} SELECT * FROM items"
ORACLE_SQL["technical_score_total"] = f"WITH {ITEMS}, s AS (SELECT symbol, d, A1 + A2 + A3 + A4 AS layer_A, B1 + B2 + B3 AS layer_B, C1 + C2 + C3 AS layer_C, D1 + D2 AS layer_D, E1 + E2 AS layer_E FROM items), u AS (SELECT *, greatest(0, least(100, layer_A + layer_B + layer_C + layer_D + layer_E)) AS total FROM s) SELECT *, {GRADE.format('total')} AS grade FROM u"
_near_line = lambda m: f"(SELECT DISTINCT ON (symbol) symbol, close AS price_{m}m FROM lk JOIN ln USING (symbol) WHERE abs(epoch_us(ts) - epoch_us(now) + {m} * 60000000::BIGINT) <= 1800000000 ORDER BY symbol, abs(epoch_us(ts) - epoch_us(now) + {m} * 60000000::BIGINT), ts, close)"
LINE_MOMENTUM = f"""lk AS (SELECT n_name AS symbol, CAST(l_shipdate AS TIMESTAMP) + to_minutes(l_orderkey % 1440) AS ts, round(l_extendedprice / l_quantity, 4) AS close FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity <> 0),
ln AS (SELECT symbol, max(ts) AS now, arg_max(close, row(ts, close)) AS current FROM lk GROUP BY 1), la30 AS {_near_line(30)}, la60 AS {_near_line(60)},
lm AS (SELECT symbol, CASE WHEN price_30m > 0 AND price_60m > 0 THEN CASE
    WHEN current < price_30m AND price_30m < price_60m THEN CASE WHEN (current - price_30m) / price_30m * 100 < (price_30m - price_60m) / price_60m * 100 THEN 'accelerating' ELSE 'decelerating' END
    WHEN current > price_30m AND price_30m < price_60m THEN 'decelerating' ELSE 'stable' END ELSE 'stable' END AS momentum FROM ln LEFT JOIN la30 USING (symbol) LEFT JOIN la60 USING (symbol))"""
ORACLE_SQL["safety_margin"] = f"""WITH {BARS}{BANDS}, {RSI}, {BETA}, {CHANGES}, {LINE_MOMENTUM},
mk AS (SELECT max(change_pct) FILTER (WHERE symbol = 'NATION_0') AS m, coalesce(max(change_pct) FILTER (WHERE symbol = 'NATION_1'), 0) > 0 AND coalesce(max(change_pct) FILTER (WHERE symbol = 'NATION_2'), 0) > 0 AS gain FROM ch),
v AS (SELECT bx.*, rsi.rsi, gain, coalesce(momentum, 'stable') AS momentum, coalesce(change_pct, 0) AS c, CASE WHEN coalesce(beta, 0) <> 0 AND coalesce(change_pct, 0) <> 0 THEN round(beta * coalesce(m, 0), 2) ELSE 0.0 END AS ex, coalesce(beta, 0) <> 0 AND coalesce(change_pct, 0) <> 0 AS known
  FROM bx JOIN rsi USING (symbol, d) JOIN ch USING (symbol) LEFT JOIN be USING (symbol) LEFT JOIN lm USING (symbol), mk WHERE bx.i = bx.n - 1 AND sma IS NOT NULL),
u AS (SELECT *, CASE WHEN known THEN round(c - ex, 2) ELSE 0.0 END AS xs, momentum = 'accelerating' AND c < -2 AND gain AS diverges FROM v),
p AS (SELECT *, CASE WHEN rsi <= 25 THEN 4 WHEN rsi <= 30 THEN 3 WHEN rsi <= 40 THEN 2 WHEN rsi <= 50 THEN 1 ELSE 0 END
  + CASE WHEN bb_signal = 'extreme_oversold' THEN 3 WHEN bb_signal = 'oversold' THEN 2 WHEN pct_from_lower < 5 THEN 1 ELSE 0 END
  + CASE WHEN xs <= -5 THEN 3 WHEN xs <= -3 THEN 2 WHEN xs <= -1 THEN 1 ELSE 0 END AS s FROM u),
q AS (SELECT *, CASE WHEN momentum = 'accelerating' THEN greatest(0, s - 1) ELSE s END AS s1 FROM p)
SELECT symbol, d, round(sma, 2) AS sma20, bb_upper, bb_lower, bb_signal, pct_from_lower, ex AS beta_expected_pct, xs AS beta_excess_pct, momentum, diverges,
  CAST(greatest(1, least(10, CASE WHEN diverges THEN greatest(0, s1 - 1) ELSE s1 END)) AS INT) AS attraction FROM q"""

# ticks
TICKS = "tk AS (SELECT event_type AS symbol, ts, round(value, 4) AS close, 1 AS volume FROM events WHERE value IS NOT NULL), nw AS (SELECT symbol, max(ts) AS now, arg_max(close, row(ts, close)) AS current FROM tk GROUP BY 1)"
ORACLE_SQL["volume_profile"] = f"""WITH {TICKS}, g AS (SELECT symbol, current, round(round_even(close / 0.1, 0) * 0.1, 2) AS price, sum(volume) AS v, count(*) AS n, min(ts) AS first FROM tk JOIN nw USING (symbol) WHERE ts >= now - INTERVAL 1440 MINUTE GROUP BY 1, 2, 3),
h AS (SELECT symbol, current, arg_max(price, row(v, -epoch_us(first))) AS poc_price, sum(v)::BIGINT AS vol_recent, sum(n) AS n FROM g GROUP BY 1, 2) SELECT symbol, poc_price, vol_recent, CASE WHEN current < poc_price THEN 'resistance' ELSE 'support' END AS poc_signal FROM h WHERE n >= 5"""
ORACLE_SQL["same_time_volume"] = f"""WITH {TICKS}, r AS (SELECT symbol, ts, now, volume, now - INTERVAL 180 MINUTE AS since FROM tk JOIN nw USING (symbol)),
p AS (SELECT symbol, CAST(ts AS DATE) AS day, sum(volume) AS v FROM r WHERE CAST(ts AS DATE) <> CAST(now AS DATE) AND hour(ts) * 60 + minute(ts) BETWEEN hour(since) * 60 + minute(since) AND hour(now) * 60 + minute(now) GROUP BY 1, 2),
a AS (SELECT symbol, sum(volume)::BIGINT AS vol_recent FROM r WHERE ts >= since GROUP BY 1), b AS (SELECT symbol, floor(avg(v))::BIGINT AS m FROM p GROUP BY 1),
c AS (SELECT symbol, vol_recent, coalesce(m, 0) AS vol_avg, CASE WHEN coalesce(m, 0) > 0 THEN round(vol_recent / m, 2) ELSE 0.0 END AS vol_ratio FROM a LEFT JOIN b USING (symbol)) SELECT *, vol_ratio >= 1.5 AS whale FROM c"""
_near = lambda m: f"(SELECT DISTINCT ON (symbol) symbol, close AS price_{m}m FROM tk JOIN nw USING (symbol) WHERE abs(epoch_us(ts) - epoch_us(now) + {m} * 60000000::BIGINT) <= 1800000000 ORDER BY symbol, abs(epoch_us(ts) - epoch_us(now) + {m} * 60000000::BIGINT), ts, close)"
ORACLE_SQL["nearest_price"] = f"""WITH {TICKS}, a AS {_near(30)}, b AS {_near(60)}, v AS (SELECT symbol, current, price_30m, price_60m, coalesce(price_30m > 0 AND price_60m > 0, false) AS ok FROM nw LEFT JOIN a USING (symbol) LEFT JOIN b USING (symbol)),
u AS (SELECT *, CASE WHEN ok THEN (current - price_30m) / price_30m * 100 ELSE 0.0 END AS c, CASE WHEN ok THEN (price_30m - price_60m) / price_60m * 100 ELSE 0.0 END AS p FROM v)
SELECT symbol, current, price_30m, price_60m, round(c, 2) AS mom_curr, round(p, 2) AS mom_prev, CASE WHEN c < 0 AND p < 0 THEN CASE WHEN c < p THEN 'accelerating' ELSE 'decelerating' END WHEN c > 0 AND p < 0 THEN 'decelerating' ELSE 'stable' END AS momentum FROM u"""
ORACLE_SQL["hourly_bars"] = f"WITH {TICKS} SELECT symbol, date_trunc('hour', ts) AS start, arg_min(close, row(ts, close)) AS open, max(close) AS high, min(close) AS low, arg_max(close, row(ts, close)) AS close, sum(volume)::BIGINT AS volume FROM tk GROUP BY 1, 2"
DAYS = "dy AS (SELECT symbol, CAST(ts AS DATE) AS day, arg_max(close, row(ts, close)) AS last, sum(volume)::BIGINT AS volume FROM tk GROUP BY 1, 2)"
ORACLE_SQL["price_snapshot"] = f"""WITH {TICKS}, {DAYS}, v AS (SELECT *, lag(last) OVER w AS prev_close, CAST(floor(avg(volume) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 6 PRECEDING AND 2 PRECEDING)) AS BIGINT) AS avg_volume, lead(day) OVER w IS NULL AS newest FROM dy WINDOW w AS (PARTITION BY symbol ORDER BY day))
SELECT symbol, last AS current, prev_close, round((last - prev_close) / nullif(prev_close, 0) * 100, 2) AS change_pct, volume AS today_volume, avg_volume FROM v WHERE newest"""
ORACLE_SQL["market_session"] = f"""WITH {TICKS} SELECT symbol, CASE WHEN isodow(ts) > 5 OR hour(ts) * 60 + minute(ts) < 480 THEN 'CLOSED' WHEN hour(ts) * 60 + minute(ts) < 810 THEN 'PRE' WHEN hour(ts) * 60 + minute(ts) < 1200 THEN 'REGULAR' ELSE 'POST' END AS session, count(*) AS n FROM tk GROUP BY 1, 2"""
# the state machine as a recursion over each day's large changes
ORACLE_SQL["alert_hysteresis"] = f"""WITH RECURSIVE {TICKS}, {DAYS}, pv AS (SELECT symbol, day, lag(last) OVER (PARTITION BY symbol ORDER BY day) AS prev FROM dy),
ev AS MATERIALIZED (SELECT *, CAST(ts + INTERVAL 9 HOUR AS DATE) AS kday, hour(ts + INTERVAL 9 HOUR) >= 5 AS closed, row_number() OVER (PARTITION BY symbol, CAST(ts + INTERVAL 9 HOUR AS DATE), hour(ts + INTERVAL 9 HOUR) >= 5 ORDER BY ts, change_pct) AS k FROM (SELECT tk.symbol, ts, round((close - prev) / prev * 100, 2) AS change_pct FROM tk JOIN pv ON pv.symbol = tk.symbol AND pv.day = CAST(ts AS DATE) WHERE prev > 0)
  WHERE abs(change_pct) >= 4 AND isodow(ts) <= 5 AND hour(ts) * 60 + minute(ts) >= 480),
st AS (SELECT symbol, kday, closed, k, ts, change_pct, true AS fired, change_pct > 0 AS up, abs(change_pct) AS top FROM ev WHERE k = 1
  UNION ALL SELECT e.symbol, e.kday, e.closed, e.k, e.ts, e.change_pct, (e.change_pct > 0) <> st.up OR abs(e.change_pct) >= st.top + 1, e.change_pct > 0, CASE WHEN (e.change_pct > 0) <> st.up THEN abs(e.change_pct) WHEN abs(e.change_pct) >= st.top + 1 THEN abs(e.change_pct) ELSE st.top END
  FROM st JOIN ev e ON e.symbol = st.symbol AND e.kday = st.kday AND e.closed = st.closed AND e.k = st.k + 1)
SELECT symbol, kday AS day, ts, change_pct, CASE WHEN up THEN 'up' ELSE 'down' END AS direction FROM st WHERE fired"""
ORACLE_SQL["alert_deferred"] = f"""WITH {BARS}, v AS (SELECT symbol, d, round(round((close - pc) / pc * 100, 4), 2) AS c FROM t)
SELECT symbol, d, CAST(d + 1 AS DATE) AS alert_on, round(c, 1) AS change_pct, round(abs(c), 1) AS abs_pct, CASE WHEN c > 0 THEN 'up' ELSE 'down' END AS direction FROM v WHERE abs(c) >= 4"""
ORACLE_SQL["ledger_state"] = f"""WITH {BARS} SELECT symbol, sum(volume) AS shares, round(sum(volume * close) / nullif(sum(volume), 0), 4) AS avg_price, count(*) FILTER (WHERE d >= DATE '1998-01-01') AS days, 'none' AS note FROM bars GROUP BY symbol"""
ORACLE_SQL["day_totals_once"] = f"WITH {BARS} SELECT d, sum(volume) AS volume, count(*) AS symbols FROM bars GROUP BY d"
ORACLE_SQL["weekly_accumulators"] = f"""WITH {TICKS}, v AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, symbol AS name, ts, close, row_number() OVER (PARTITION BY symbol, date_trunc('week', ts) ORDER BY ts DESC, close DESC) AS k FROM tk)
SELECT week, name, count(*) AS n, round(avg(close), 2) AS average, string_agg(CAST(round(close, 2) AS VARCHAR), ',' ORDER BY k DESC) FILTER (WHERE k <= CASE WHEN name = 'click' THEN 8 ELSE 5 END) AS last FROM v GROUP BY 1, 2"""
ORACLE_SQL["pcr"] = """WITH v AS (SELECT CAST(ts AS DATE) AS day, sum(value) FILTER (WHERE event_type = 'purchase') / nullif(sum(value) FILTER (WHERE event_type = 'click'), 0) AS r FROM events GROUP BY 1)
SELECT day, round(r, 4) AS pcr, CASE WHEN r > 1.2 THEN 'heavy_hedging' WHEN r < 0.5 THEN 'bullish' WHEN r IS NOT NULL THEN 'neutral' END AS signal FROM v"""
ORACLE_SQL["short_pct"] = """WITH v AS (SELECT CAST(l_shipdate AS DATE) AS d, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0)::BIGINT AS short_volume, sum(l_quantity)::BIGINT AS total_volume FROM lineitem GROUP BY 1),
u AS (SELECT *, coalesce(round(short_volume * 100.0::DOUBLE / nullif(total_volume, 0), 1), 0.0) AS short_pct FROM v) SELECT *, CASE WHEN short_pct > 50 THEN 'high_short' ELSE 'normal' END AS signal FROM u"""
TRADES = "tr AS (SELECT o_orderkey AS id, c_name AS filer, CASE WHEN o_orderstatus = 'P' THEN 'Purchase' WHEN o_totalprice >= 100000 THEN 'Sale' END AS trade_type, floor(o_totalprice / 10)::BIGINT AS shares, o_totalprice AS total_value, CAST(o_orderdate AS DATE) AS d FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' OR o_totalprice >= 100000)"
ORACLE_SQL["insider_classify"] = f"WITH {TRADES} SELECT trade_type, CASE WHEN total_value > 0 THEN CASE WHEN total_value >= 1000000 THEN 'large' WHEN total_value >= 100000 THEN 'medium' ELSE 'small' END WHEN shares >= 50000 THEN 'large' WHEN shares >= 5000 THEN 'medium' ELSE 'small' END AS size, count(*) AS n, sum(shares)::BIGINT AS shares, round(sum(total_value), 2) AS total_value FROM tr GROUP BY 1, 2"
ORACLE_SQL["insider_new"] = f"WITH {TRADES}, h AS (SELECT *, left(md5(filer || '|' || trade_type), 12) AS hash FROM tr) SELECT hash, min(id) AS id, arg_min(filer, id) AS filer, arg_min(trade_type, id) AS trade_type, arg_min(d, id) AS d FROM h WHERE d >= DATE '2000-01-01' AND hash NOT IN (SELECT hash FROM h WHERE d < DATE '2000-01-01') GROUP BY hash"
ORACLE_SQL["news_dedup"] = "WITH h AS (SELECT doc_id AS id, lang, left(md5(coalesce(text, '')), 12) AS hash FROM documents) SELECT hash, min(id) AS id, arg_min(lang, id) AS lang FROM h WHERE lang <> 'de' AND hash NOT IN (SELECT hash FROM h WHERE lang = 'de') GROUP BY hash"
ORACLE_SQL["html_excerpt"] = r"""WITH v AS (SELECT page_id, regexp_replace(lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '')), '^www\.', '') AS host, html FROM pages),
b AS (SELECT page_id, host = 'example.net' OR ends_with(host, '.example.net') AS blocked, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ') AS body FROM v)
SELECT page_id, blocked, CASE WHEN NOT blocked THEN substr(array_to_string(list_slice(list_filter(list_transform(string_split(body, '.'), lambda s: trim(s, ' ')), lambda s: length(s) > 40), 1, 6), '. '), 1, 600) END AS excerpt FROM b"""
ORACLE_SQL["app_rank_trend"] = f"""WITH {BARS}, m AS (SELECT symbol, year(d) * 12 + month(d) AS period, sum(volume) AS v FROM bars GROUP BY 1, 2), r AS (SELECT symbol, period, row_number() OVER (PARTITION BY period ORDER BY v DESC, symbol) AS rank FROM m),
p AS (SELECT a.symbol, a.period, a.rank, b.rank AS prev_rank FROM r a LEFT JOIN r b ON a.symbol = b.symbol AND b.period = a.period - 1) SELECT *, CASE WHEN prev_rank - rank >= 3 THEN 'up' WHEN prev_rank - rank <= -3 THEN 'down' ELSE '' END AS trend, rank <= 5 AS in_top FROM p"""
ORACLE_SQL["weighted_cost"] = f"WITH {BARS} SELECT symbol, sum(volume) AS shares, round(sum(volume * close) / nullif(sum(volume), 0), 4) AS avg_price FROM bars GROUP BY 1"
ORACLE_SQL["event_props"] = "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k_class, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2"
ORACLE_SQL["conversation_tails"] = """WITH c AS (SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations), f AS (SELECT conv_id, arg_min(role, row(turn, role)) AS first_role FROM c GROUP BY 1),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role NULLS FIRST, n_chars NULLS FIRST) AS back FROM c) SELECT conv_id, turn, role, n_chars, back, first_role FROM b JOIN f USING (conv_id) WHERE back <= 5"""
ORACLE_SQL["sector_universe"] = f"WITH {BARS}, c AS (SELECT symbol, count(*) AS bars FROM bars GROUP BY 1) SELECT n_name AS symbol, r_name AS sector, coalesce(bars, 0) AS bars FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN c ON c.symbol = n_name"

# dates as text, so that both engines' clients show them alike
_DATES = {
    "week": ("weekly_bars", "weekly_rsi_macd", "weekly_accumulators"),
    "day": ("pcr", "alert_hysteresis"),
    "d": ("daily_bars", "macro", "day_change", "sma_bbands", "bb_squeeze", "atr", "cmf", "cmf_turning", "evsr", "upvol", "mfi", "stoch", "obv", "vol_contraction", "drawdown_atr", "volume_surge", "daily_hvn", "forward_returns", "rsi", "ema_stack", "ema_reclaim", "macd", "macd_signals", "macd_hist_scan", "adx", "rsi_divergence", "market_scan", "rolling_scores", "forward_returns_clipped", "dca_dynamic", "dca_baseline", "technical_score_items", "technical_score_total", "safety_margin", "alert_deferred", "short_pct", "insider_new", "day_totals_once"),
    "alert_on": ("alert_deferred",),
}
for _column, _names in _DATES.items():
    for _name in _names:
        ORACLE_SQL[_name] = f"SELECT * REPLACE (CAST({_column} AS VARCHAR) AS {_column}) FROM ({ORACLE_SQL[_name]})"


def exactly_rounded(sql: str) -> str:
    """sql with round(x, n) spelled out: printed to n places, which goes by the exact value of a double, and read back."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        if sql[at - 1].isalnum() or sql[at - 1] == "_":  # part of another name
            at += 6
            continue
        depth, k, comma = 1, at + 6, None
        while depth:
            depth += (sql[k] == "(") - (sql[k] == ")")
            comma = k if sql[k] == "," and depth == 1 else comma
            k += 1
        n = int(sql[comma + 1 : k - 1])
        sql = f"{sql[:at]}CAST(format('{{:.{n}f}}', CAST({sql[at + 6 : comma]} AS DOUBLE)) AS DOUBLE){sql[k:]}"
    return sql


for _name in ORACLE_SQL:
    ORACLE_SQL[_name] = exactly_rounded(ORACLE_SQL[_name])
