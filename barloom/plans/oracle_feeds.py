"""DuckDB SQL for the feeds: what they hold follows from the tables that they are made of, so no document is parsed here."""

from __future__ import annotations

FEED_SQL: dict[str, str] = {}

FEED_SQL["option_chain_pcr"] = """
WITH s AS (
  SELECT CAST(ts AS DATE) AS day,
         coalesce(sum(floor(value * 100)::BIGINT) FILTER (WHERE event_type = 'purchase'), 0)::BIGINT AS puts,
         coalesce(sum(floor(value * 100)::BIGINT) FILTER (WHERE event_type = 'click'), 0)::BIGINT AS calls
  FROM events WHERE event_type IN ('purchase', 'click') GROUP BY 1
), t AS (
  SELECT day, calls, CASE WHEN n % 2 = 0 AND n % 7 <> 0 THEN 1 ELSE 2 END AS source, CASE WHEN n % 2 = 0 AND n % 7 <> 0 THEN puts ELSE 2 * puts END AS puts
  FROM (SELECT *, day - DATE '1970-01-01' AS n FROM s) WHERE calls <> 0
)
SELECT CAST(day AS VARCHAR) AS day, source, round(puts / calls, 3) AS pcr, puts AS total_puts, calls AS total_calls,
       CASE WHEN puts / calls > 1.2 THEN 'heavy_hedging' WHEN puts / calls < 0.5 THEN 'bullish' ELSE 'neutral' END AS signal
FROM t
"""

FEED_SQL["app_ranks"] = """
WITH overall AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part),
brand AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part WHERE p_brand = 'Brand#1')
SELECT CAST(p.p_partkey AS VARCHAR) AS id, o.place AS rank_overall, b.place AS rank_brand
FROM part p LEFT JOIN overall o ON o.p_partkey = p.p_partkey AND o.place <= 200 LEFT JOIN brand b ON b.p_partkey = p.p_partkey AND b.place <= 200
WHERE p_size <= 5
"""

FEED_SQL["filing_links"] = """
WITH e AS (
  SELECT page_id, page_id // 20 AS feed, row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id) - 1 AS position FROM pages
)
SELECT feed, position, 'https://forms.example.com/Archives/edgar/data/' || page_id || '/i' || page_id || '-index.htm' AS href,
       CAST(CAST(DATE '2020-01-01' + CAST(page_id % 1000 AS INT) AS DATE) AS VARCHAR) AS date,
       CASE page_id % 3 WHEN 0 THEN 'http://other.example.com/a' || page_id || '.xml' WHEN 1 THEN 'https://forms.example.com/Archives/x/b' || page_id || '.xml'
            ELSE 'https://forms.example.com/Archives/edgar/data/' || page_id || '/c' || page_id || '.xml' END AS form
FROM e WHERE position < 10 AND page_id % 5 <> 4
"""

FEED_SQL["filing_positions"] = """
WITH c AS (
  SELECT *, row_number() OVER (PARTITION BY c_custkey // 15 ORDER BY c_custkey) AS k FROM customer WHERE c_custkey % 150 <= 120
), f AS (
  SELECT *, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CASE c_custkey % 4 WHEN 0 THEN 'Form13F_InfoTable.xml' WHEN 1 THEN 'form13f.xml' WHEN 3 THEN 'a-infotable.xml' END END AS file
  FROM c WHERE k <= 10 AND c_custkey % 11 <> 0
)
SELECT CASE c_custkey % 3 WHEN 0 THEN 'Unknown' WHEN 1 THEN c_name ELSE c_name || ' Inc' END AS institution,
       CAST(CAST(DATE '2024-06-01' - CAST(c_custkey % 150 AS INT) AS DATE) AS VARCHAR) AS filing_date,
       CASE WHEN c_custkey % 13 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS cik, '000124' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS accession, file,
       CASE WHEN file IS NULL THEN 0 ELSE c_custkey * 7 END AS shares, CASE WHEN file IS NULL THEN 0.0::DOUBLE ELSE floor(abs(c_acctbal)) * 1000 END AS value_usd
FROM f
"""

FEED_SQL["news_items"] = """
SELECT title, 'day ' || doc_id AS date, 'https://news.example.com/' || doc_id AS link, left(md5(title), 12) AS hash
FROM (SELECT doc_id, 'Item ' || doc_id || ' in ' || coalesce(lang, '') AS title, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) AS k FROM documents) WHERE k <= 15
"""

FEED_SQL["insider_forms"] = """
WITH o AS (
  SELECT o_orderkey AS k, o_custkey, c_name, floor(o_totalprice / 10)::BIGINT AS shares, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders JOIN customer ON o_custkey = c_custkey
), t AS (
  SELECT k, o_custkey, c_name, date, substr('PSAGMF', (k % 6 + 1)::INT, 1) AS txn_code, shares, k % 100 + 0.25::DOUBLE AS price, k % 4 = 0 AS disposed FROM o
  UNION ALL SELECT k, o_custkey, c_name, date, 'M', 12, 0.5, k % 2 = 0 FROM o WHERE k % 3 = 0
), u AS (
  SELECT *, CASE WHEN txn_code = 'P' THEN 'Purchase' WHEN txn_code = 'S' THEN 'Sale' WHEN txn_code = 'A' THEN 'Award' WHEN txn_code IN ('M', 'F') AND disposed THEN 'Sale' END AS trade_type FROM t
)
SELECT c_name AS filer, CASE o_custkey % 4 WHEN 0 THEN 'Chief' WHEN 1 THEN 'Director' WHEN 2 THEN '10% Owner' ELSE '' END AS title, trade_type, txn_code, shares, price,
       date, CAST(k AS VARCHAR) AS url, shares * price AS total_value
FROM u WHERE trade_type IS NOT NULL AND shares <> 0
"""
