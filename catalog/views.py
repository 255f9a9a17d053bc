"""Oracle views: the fixture tables as plain SQL over the generated Parquet tables."""

from __future__ import annotations

from .fixtures import HALF_DAY
from .registry import view


@view("fx_ticks")
def _ticks():
    return """SELECT event_id, CAST(ts AS DATE) AS d,
  CAST(240 + 5*CAST(FLOOR((hour(ts)*3600+minute(ts)*60+CAST(FLOOR(second(ts)) AS INT))/450) AS INT) AS INT) AS m,
  concat('T', CAST(user_id % 3 AS VARCHAR)) AS ticker, 100 + value/10 AS px, value AS qty
FROM events"""


@view("fx_all", "fx_ticks")
def _all():
    return """SELECT event_id, d, m, ticker, px, qty FROM fx_ticks
UNION ALL SELECT event_id, d, m, 'SPY', px, qty FROM fx_ticks"""


@view("fx_bars", "fx_all")
def _bars():
    return """SELECT ticker, d, m, min_by(px, event_id) AS open, max(px) AS high, min(px) AS low,
  max_by(px, event_id) AS close, sum(qty) AS volume, count(*) AS trade_count,
  CASE WHEN count(*) > 1 THEN sum(px*qty)/sum(qty) END AS vwap
FROM fx_all GROUP BY ticker, d, m"""


@view("fx_cal")
def _cal():
    return f"""SELECT CAST(r.range AS DATE) AS d, 570 AS open_min,
  CASE WHEN CAST(r.range AS DATE) = DATE '{HALF_DAY}' THEN 780 ELSE 960 END AS close_min
FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 1 DAY) r
WHERE isodow(r.range) < 6 AND CAST(r.range AS DATE) NOT IN (DATE '2024-01-01', DATE '2024-01-15')"""


@view("fx_rth", "fx_bars", "fx_cal")
def _rth():
    return """SELECT b.*, c.open_min, c.close_min FROM fx_bars b JOIN fx_cal c ON b.d = c.d
WHERE b.m >= c.open_min AND b.m < c.close_min"""


@view("fx_revised", "fx_bars")
def _revised():
    return """SELECT *, 0 AS late FROM fx_bars
UNION ALL SELECT ticker, d, m, open, high, low, close + 1, volume, trade_count, vwap, 120 FROM fx_bars WHERE m % 60 = 0"""


@view("fx_daily")
def _daily():
    return """SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS d, min_by(o_totalprice,o_orderkey) AS open,
  max(o_totalprice) AS high, min(o_totalprice) AS low, max_by(o_totalprice,o_orderkey) AS close,
  CAST(count(*) AS DOUBLE) AS volume
FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)"""


@view("fx_news")
def _news():
    return """SELECT d.doc_id AS article_id, CAST((d.doc_id % 1000)*43 AS BIGINT) AS pub_min,
  CAST((d.doc_id % 1000)*43 + 15 AS BIGINT) AS avail_min, d.source AS publisher,
  split_part(d.text, chr(10), 1) AS title, d.text AS description,
  concat('T', CAST(d.doc_id % 3 AS VARCHAR)) AS ticker,
  CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive'
       WHEN l.doc_id IS NOT NULL THEN 'neutral' END AS sentiment
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


# Windows as an independent formulation: a per-window lookup of bars against the calendar grid.
@view("fx_windows", "fx_rth", "fx_cal")
def _windows():
    return """SELECT g.ticker, g.d, g.slot, g.open_min,
  abs(ln(max_by(b.close, b.m) / min_by(b.open, b.m))) AS r_w,
  coalesce(sum(coalesce(b.vwap, b.close) * b.volume), 0) AS dollar_vol,
  CAST(coalesce(sum(b.trade_count), 0) AS BIGINT) AS trade_count,
  count(CASE WHEN b.volume > 0 THEN 1 END) / 3.0 AS active_subbar_fraction,
  CAST(count(b.m) AS BIGINT) AS n_subbars
FROM (SELECT t.ticker, c.d, c.open_min, unnest(generate_series(c.open_min, c.close_min - 15, 15)) AS slot
      FROM (SELECT DISTINCT ticker FROM fx_bars) t, fx_cal c) g
LEFT JOIN fx_rth b ON b.ticker = g.ticker AND b.d = g.d AND b.m >= g.slot AND b.m < g.slot + 15
GROUP BY g.ticker, g.d, g.slot, g.open_min"""
