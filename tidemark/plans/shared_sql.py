"""Shared SQL views for the oracle statements, mirroring sources/views.py."""

from tidemark.plans.registry import cte

cte("prints", """
SELECT event_type AS symbol, ts, event_id AS seq, value AS price,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size
FROM events
""")
cte("moves", """
SELECT *, sign(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq)) AS mv FROM prints
""", ("prints",))
cte("signed_prints", """
SELECT symbol, ts, seq, price, size,
       CAST(coalesce(last_value(nullif(mv, 0) IGNORE NULLS) OVER (
            PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS side
FROM moves
""", ("moves",))


def _ohlcv(freq: str) -> str:
    return f"""
SELECT symbol, time_bucket(INTERVAL '{freq}', ts) AS ts,
       first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
       last(price ORDER BY ts, seq) AS close, sum(size) AS volume, count(*) AS prints
FROM prints GROUP BY 1, 2
"""


def _delta(freq: str) -> str:
    return f"""
SELECT *, delta / nullif(volume, 0) AS delta_pct, volume / nullif(high - low, 0) AS absorption,
       sum(delta) OVER (PARTITION BY symbol ORDER BY ts) AS cum_delta
FROM (SELECT symbol, time_bucket(INTERVAL '{freq}', ts) AS ts,
       first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
       last(price ORDER BY ts, seq) AS close, sum(size) AS volume, count(*) AS prints,
       sum(CASE WHEN side > 0 THEN size ELSE 0 END) AS buy_vol,
       sum(CASE WHEN side < 0 THEN size ELSE 0 END) AS sell_vol,
       sum(CASE WHEN side > 0 THEN size WHEN side < 0 THEN -size ELSE 0 END) AS delta
FROM signed_prints GROUP BY 1, 2)
"""


cte("bars_h1", _ohlcv("1 hour"), ("prints",))
cte("bars_h4", _ohlcv("4 hours"), ("prints",))
cte("bars_d1", _ohlcv("1 day"), ("prints",))
cte("delta_h1", _delta("1 hour"), ("signed_prints",))
cte("delta_m5", _delta("5 minutes"), ("signed_prints",))

cte("trades", """
SELECT p_brand AS symbol, l_returnflag AS sleeve, o_orderpriority AS strategy,
       CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS side, l_quantity AS volume,
       o_orderdate AS entry_ts, l_shipdate AS exit_ts, l_extendedprice / l_quantity AS entry_price,
       l_extendedprice * (l_discount - 0.05) AS gross_pnl, l_extendedprice * l_tax * 0.1 AS costs,
       l_extendedprice * 0.02 AS risk_cash,
       l_extendedprice * (l_discount - 0.05) - l_extendedprice * l_tax * 0.1 AS net_pnl,
       (l_extendedprice * (l_discount - 0.05) - l_extendedprice * l_tax * 0.1) / (l_extendedprice * 0.02) AS r_multiple,
       epoch(l_shipdate - o_orderdate) / 86400.0 AS days_held
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
WHERE l_shipdate > o_orderdate
""")
cte("panel", """
SELECT n_name AS symbol, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS level
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1, 2
""")


def ewm_sql(rows: str, value: str, alpha: str) -> str:
    """Recursive smoothing over `rows` (symbol, rn, ...)."""
    return f"""
SELECT symbol, rn, {value} AS y FROM {rows} WHERE rn = 1
UNION ALL
SELECT r.symbol, r.rn, (1 - {alpha}) * e.y + {alpha} * r.{value} FROM {{self}} e
JOIN {rows} r ON r.symbol = e.symbol AND r.rn = e.rn + 1
"""


def ewm_cte(name: str, rows: str, value: str, alpha: str) -> None:
    cte(name, ewm_sql(rows, value, alpha).format(self=name), (rows,))


for _f in ("h1", "h4", "d1"):
    cte(f"rows_{_f}", f"""
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn,
       greatest(high - low, abs(high - lag(close) OVER (PARTITION BY symbol ORDER BY ts)),
                abs(low - lag(close) OVER (PARTITION BY symbol ORDER BY ts))) AS tr
FROM bars_{_f}
""", (f"bars_{_f}",), materialized=True)
    ewm_cte(f"atr_{_f}_r", f"rows_{_f}", "tr", "(1.0::DOUBLE / 14)")
    cte(f"atr_{_f}", f"""
SELECT b.*, CASE WHEN b.rn >= 14 THEN a.y END AS atr
FROM rows_{_f} b JOIN atr_{_f}_r a ON a.symbol = b.symbol AND a.rn = b.rn
""", (f"rows_{_f}", f"atr_{_f}_r"), materialized=True)
    for _n in (20, 50):
        ewm_cte(f"ema{_n}_{_f}", f"rows_{_f}", "close", f"(2.0::DOUBLE / {_n + 1})")


def t_two_sided_sql(t: str, df: str) -> str:
    """P(|T| > t) by Simpson's rule."""
    return (f"(1 - 2 * (abs({t}) / 6000.0) * (SELECT sum((CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
            f" * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0) - 0.5 * ln({df} * pi())"
            f" - ({df} + 1) / 2.0 * ln(1 + pow({t} * i / 2000.0, 2) / {df}))) FROM range(2001) g(i)))")


def norm_cdf_sql(z: str) -> str:
    return (f"(0.5 + sign({z}) * (abs({z}) / 6000.0) * (SELECT sum((CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
            f" * exp(-pow({z} * i / 2000.0, 2) / 2.0)) FROM range(2001) g(i)) / sqrt(2 * pi()))")
