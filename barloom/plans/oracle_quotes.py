"""DuckDB SQL for quotes, notes and summaries, over the tables that the documents are made of; charts are lists here."""

from __future__ import annotations

from barloom.plans.oracle import BASELINE, BARS, BUCKETS, DAYS, DYNAMIC, GRADE, SCAN, SCORED, TICKS, _summary

QUOTE_SQL: dict[str, str] = {}

QUOTES = f"""{TICKS}, {DAYS},
da AS (
  SELECT symbol, day, n, row_number() OVER (PARTITION BY symbol ORDER BY day) AS rn, CASE WHEN n % 7 <> 3 THEN last END AS c, CASE WHEN n % 11 <> 5 THEN volume END AS v
  FROM (SELECT *, day - DATE '1970-01-01' AS n FROM dy)
), mo AS (SELECT symbol, day, n, rn, CAST(day AS TIMESTAMP) + to_hours(n * 5 % 24) + to_minutes(30) AS now, (n * 5 % 24) * 60 + 30 AS minute_now FROM da),
told AS (
  SELECT m.symbol, m.day,
         coalesce(list(b.c ORDER BY b.rn) FILTER (b.c IS NOT NULL), []) AS all_c, coalesce(list(b.c ORDER BY b.rn) FILTER (b.c IS NOT NULL AND b.day < m.day), []) AS old_c,
         coalesce(list(b.v ORDER BY b.rn) FILTER (b.v IS NOT NULL), []) AS all_v, coalesce(list(b.v ORDER BY b.rn) FILTER (b.v IS NOT NULL AND b.day < m.day), []) AS old_v
  FROM mo m JOIN da b ON b.symbol = m.symbol AND b.rn BETWEEN m.rn - 9 AND m.rn GROUP BY 1, 2
), mi AS (
  SELECT symbol, CAST(ts AS DATE) AS day, date_trunc('minute', ts) AS mt, count(*) AS v, CASE WHEN minute(date_trunc('minute', ts)) % 5 <> 0 THEN arg_max(close, row(ts, close)) END AS c
  FROM tk GROUP BY symbol, CAST(ts AS DATE), date_trunc('minute', ts)
), td AS (
  SELECT mo.symbol, mo.day, arg_max(c, mt) FILTER (WHERE c IS NOT NULL) AS minute, sum(v)::BIGINT AS minute_volume FROM mo JOIN mi ON mi.symbol = mo.symbol AND mi.day = mo.day AND mt <= now GROUP BY 1, 2
), q AS (
  SELECT mo.symbol, mo.day, CASE WHEN isodow(mo.day) >= 6 OR minute_now < 480 THEN 'CLOSED' WHEN minute_now < 810 THEN 'PRE' WHEN minute_now < 1200 THEN 'REGULAR' ELSE 'POST' END AS state,
         all_c, old_c, CASE WHEN len(old_c) >= 2 THEN old_c ELSE all_c END AS cs, CASE WHEN len(old_c) >= 2 THEN old_v ELSE all_v END AS vs, minute, coalesce(minute_volume, 0) AS minute_volume
  FROM mo JOIN told USING (symbol, day) LEFT JOIN td USING (symbol, day)
), r AS (
  SELECT *, CAST(coalesce(floor(CASE WHEN len(vs) > 1 THEN list_avg(vs[greatest(1, len(vs) - 5):len(vs) - 1]) ELSE vs[1] END), 0) AS BIGINT) AS volume_avg, coalesce(vs[-1], 0)::BIGINT AS newest
  FROM q WHERE len(old_c) >= 2 OR len(all_c) >= 2
)"""
CHANGE = "CASE WHEN prev_close = 0 THEN 0.0 ELSE round((current - prev_close) / prev_close * 100, 2) END AS change_pct"

QUOTE_SQL["quote_snapshot"] = f"""WITH {QUOTES}, s AS (
  SELECT symbol, day, state, CASE WHEN state = 'CLOSED' OR minute IS NULL THEN round(cs[-1], 2) ELSE round(minute, 2) END AS current, round(cs[-1], 2) AS prev_close,
         CASE WHEN state = 'CLOSED' THEN newest WHEN minute IS NULL THEN 0 ELSE minute_volume END AS volume, volume_avg
  FROM r
) SELECT CAST(day AS VARCHAR) AS day, symbol, state, current, prev_close, {CHANGE}, volume, volume_avg FROM s"""

QUOTE_SQL["quote_snapshot_close"] = f"""WITH {QUOTES}, s AS (SELECT symbol, day, state, round(all_c[-1], 2) AS current, round(all_c[-2], 2) AS prev_close, newest AS volume, volume_avg FROM r)
SELECT CAST(day AS VARCHAR) AS day, symbol, state, current, prev_close, {CHANGE}, volume, volume_avg FROM s"""

QUOTE_SQL["quote_change"] = f"""WITH {QUOTES}, s AS (
  SELECT symbol, day, state, CASE WHEN len(old_c) > 0 THEN old_c[-1] ELSE all_c[-2] END AS p, CASE WHEN state IN ('PRE', 'REGULAR') THEN minute ELSE all_c[-1] END AS c FROM q
) SELECT CAST(day AS VARCHAR) AS day, symbol, state, CASE WHEN p <> 0 AND c <> 0 THEN round((c - p) / p * 100, 2) END AS change_pct FROM s"""

HOLES = f"""{BARS}, h AS (
  SELECT symbol, d, year(d)::INT AS year, (row_number() OVER (PARTITION BY symbol, year(d) ORDER BY d) - 1)::INT AS position, open, CASE WHEN n % 13 <> 1 THEN high END AS high, low,
         CASE WHEN n % 7 <> 3 THEN close END AS close, CASE WHEN n % 11 <> 5 THEN volume END AS volume
  FROM (SELECT symbol, d, open, high, low, close, volume, d - DATE '1970-01-01' AS n FROM bars)
)"""
QUOTE_SQL["close_history"] = f"WITH {HOLES} SELECT symbol, year, position, round(close, 2) AS close FROM h WHERE close IS NOT NULL"
_FILLED = ", ".join(f"coalesce(round({c}, 6), 0.0) AS {c}" for c in ("open", "high", "low", "close"))
QUOTE_SQL["bars_zero_filled"] = f"WITH {HOLES} SELECT symbol, CAST(d AS VARCHAR) AS d, {_FILLED}, coalesce(volume, 0)::BIGINT AS volume FROM h"
QUOTE_SQL["bars_nulls_dropped"] = f"WITH {HOLES} SELECT symbol, CAST(d AS VARCHAR) AS d, {_FILLED}, coalesce(volume, 0)::BIGINT AS volume FROM h WHERE high IS NOT NULL AND close IS NOT NULL"

NOTES = """i AS (
  SELECT doc_id AS k, doc_id // 20 AS feed, CAST(doc_id % 20 AS INT) AS position, 'Item ' || doc_id || ' in ' || coalesce(lang, '') AS title, (doc_id // 20) % 5 <> 4 AS readable FROM documents
), a AS (
  SELECT feed, position, title, readable AND k % 3 = 0 AS skip,
         CASE WHEN NOT readable THEN NULL WHEN k % 10 = 4 THEN 'again ' || k WHEN k % 3 = 0 THEN NULL WHEN k % 4 = 0 THEN '' ELSE 'note ' || k END AS summary,
         CASE WHEN NOT readable THEN NULL WHEN k % 10 = 4 THEN '' WHEN k % 3 = 0 THEN NULL WHEN k % 5 = 0 THEN '' ELSE 'text ' || k END AS translation,
         CASE WHEN NOT readable THEN NULL WHEN k % 10 = 4 THEN 'neutral' WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN 'positive' WHEN k % 7 = 0 THEN 'negative' ELSE 'neutral' END AS sentiment
  FROM i
)"""
QUOTE_SQL["news_notes"] = f"WITH {NOTES} SELECT * FROM a"
QUOTE_SQL["news_shown"] = f"""WITH {NOTES}, s AS (SELECT *, CAST(row_number() OVER (PARTITION BY feed ORDER BY position) AS INT) AS place FROM a WHERE NOT skip AND summary <> '')
SELECT feed, place, title, summary, CASE sentiment WHEN 'positive' THEN '+' WHEN 'negative' THEN '-' ELSE 'o' END AS mark FROM s WHERE place <= 5"""

QUOTE_SQL["score_bars"] = f"WITH {SCAN} SELECT symbol, score, {GRADE.format('score')} AS grade, repeat('█', score // 10) || repeat('░', 10 - score // 10) AS bar FROM sc"
QUOTE_SQL["scan_coverage"] = f"""WITH {SCAN}, g AS (SELECT r_name AS sector, count(score) AS valid, count(*) AS total FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN sc ON sc.symbol = n_name GROUP BY 1)
SELECT *, valid || '/' || total AS label FROM g"""

_PLANS = ", ".join(f"{p}.{c} AS dca_{name}_{c}" for p, name in (("a", "dynamic"), ("b", "baseline")) for c in ("shares", "final_value", "total_return", "mdd"))
QUOTE_SQL["study_summaries"] = f"""WITH {DYNAMIC}, {BASELINE}{BUCKETS.removeprefix(SCORED)},
best AS (SELECT DISTINCT ON (symbol) symbol, bucket, ev FROM ba WHERE horizon = 10 AND count >= 5 AND winrate >= 0.5 AND avg > 0 ORDER BY symbol, ev DESC, CAST(split_part(bucket, '-', 1) AS INT)),
ms AS (SELECT symbol, count(*) AS n_samples, round(avg(score), 2) AS score_mean FROM sc GROUP BY 1)
SELECT ms.symbol, n_samples, score_mean, bucket AS sweet_bucket, ev AS sweet_ev, {_PLANS} FROM ms LEFT JOIN best ON best.symbol = ms.symbol LEFT JOIN {_summary('pl')} a ON a.symbol = ms.symbol LEFT JOIN {_summary('bl')} b ON b.symbol = ms.symbol"""
