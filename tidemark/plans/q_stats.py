"""Labels, folds, overfitting statistics, bootstraps and first passage."""

from dataclasses import replace
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import functions as F

from tidemark.operators import folds as FO
from tidemark.operators import labels as LB
from tidemark.operators import overfit as O
from tidemark.operators import passage as PA
from tidemark.operators import resample as RS
from tidemark.operators import signals as R
from tidemark.operators import trades as T
from tidemark.plans.q_screen import trend_rule
from tidemark.plans.registry import cte, query, rounded
from tidemark.plans.shared_sql import norm_cdf_sql
from tidemark.session import materialize
from tidemark.sources import views as V

# --------------------------------------------------------------------- labels

cte("labelled", """
WITH e AS (SELECT t.symbol, t.rn - 1 AS i, t.ts, t.side, t.atr * 2.5 AS sd, b.open AS entry, b.rn - 1 AS entry_i, least(b.rn - 1 + 20, mx.n - 1) AS last
  FROM trend_events t JOIN rows_h1 b ON b.symbol = t.symbol AND b.rn = t.rn + 1 JOIN (SELECT symbol, count(*) AS n FROM rows_h1 GROUP BY symbol) mx ON mx.symbol = t.symbol),
h AS (SELECT e.*, b.rn - 1 AS idx, b.close, CASE WHEN e.side > 0 THEN b.low <= e.entry - sd ELSE b.high >= e.entry + sd END AS sh,
  CASE WHEN e.side > 0 THEN b.high >= e.entry + 2 * sd ELSE b.low <= e.entry - 2 * sd END AS th
  FROM e JOIN rows_h1 b ON b.symbol = e.symbol AND b.rn - 1 BETWEEN e.entry_i AND e.last),
g AS (SELECT symbol, i, ts, side, sd, entry, entry_i, last, min(idx) FILTER (sh OR th) AS hit, arg_min(CASE WHEN sh THEN 'stop' ELSE 'target' END, idx) FILTER (sh OR th) AS what, arg_max(close, idx) AS lc FROM h GROUP BY ALL)
SELECT symbol, i, ts, side, sd AS stop_distance, entry, entry_i, coalesce(hit, last) AS t1, coalesce(what, 'time') AS touched,
  ((CASE what WHEN 'stop' THEN entry - sd * side WHEN 'target' THEN entry + 2 * sd * side ELSE lc END) - entry) * side / sd AS ret FROM g
""", ("trend_events", "rows_h1"), materialized=True)


def labelled(spark, sf):
    bars = V.stored_bars(spark, sf)
    ev = R.signal_events(trend_rule(spark, sf, bars), warmup=65).select("symbol", "ts", "i", "side", "stop_distance")
    return LB.triple_barrier(ev, LB.index_bars(bars), 2.0, 20, event_keys=("ts",))


@query("triple_barrier", """
SELECT symbol, ts, side, round(entry, 6) AS entry, t1 - entry_i AS held, touched, round(ret, 6) + 0.0 AS ret, CASE WHEN ret > 0 THEN 1 ELSE 0 END AS label FROM labelled
""", ("labelled",))
def _(spark, sf):
    d = labelled(spark, sf).withColumn("held", (F.col("t1") - F.col("entry_i")).cast("long"))
    return rounded(d.select("symbol", "ts", "side", "entry", "held", "touched", "ret", "label"))


cte("weighted", """
WITH c AS (SELECT symbol, idx, count(*) AS c FROM (SELECT symbol, unnest(range(entry_i, t1 + 1)) AS idx FROM labelled) GROUP BY ALL),
w AS (SELECT l.symbol, l.i, l.ts, avg(1.0 / c.c) AS w FROM labelled l JOIN c ON c.symbol = l.symbol AND c.idx BETWEEN l.entry_i AND l.t1 GROUP BY ALL)
SELECT *, w * count(*) OVER (PARTITION BY symbol) / sum(w) OVER (PARTITION BY symbol) AS weight FROM w
""", ("labelled",))


@query("sample_weights", "SELECT symbol, ts, round(weight, 6) AS weight FROM weighted", ("weighted",))
def _(spark, sf):
    return rounded(LB.sample_weights(materialize(labelled(spark, sf))).select("symbol", "ts", "weight"))


@query("label_summary", """
SELECT symbol, count(*) AS labels, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive, round(avg(ret), 6) AS mean_r, round(median(ret), 6) AS median_r,
 count(*) FILTER (touched = 'target') AS n_target, count(*) FILTER (touched = 'stop') AS n_stop, count(*) FILTER (touched = 'time') AS n_time,
 avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) < 0.15 OR avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) > 0.85 AS imbalanced FROM labelled GROUP BY symbol
""", ("labelled",))
def _(spark, sf):
    return rounded(LB.label_summary(materialize(labelled(spark, sf))))


# ---------------------------------------------------------------------- folds

cte("spans", """
SELECT l_orderkey, p_brand AS symbol, epoch(l_shipdate)::BIGINT // 86400 AS t0, epoch(l_shipdate)::BIGINT // 86400 + CAST(l_quantity AS BIGINT) AS t1, l_extendedprice AS px,
 l_partkey AS pk, l_suppkey AS sk FROM lineitem JOIN part ON l_partkey = p_partkey
""")


def spans(spark, sf):
    """Label spans in days, pooled over markets in time order."""
    li, p = V.table(spark, sf, "lineitem"), V.table(spark, sf, "part").select("p_partkey", "p_brand")
    t0 = F.unix_date(F.to_date("l_shipdate")).cast("long")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"), t0.alias("t0"), (t0 + F.col("l_quantity").cast("long")).alias("t1"),
        F.col("l_extendedprice").alias("px"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
        F.col("l_orderkey").alias("ok"))


SPAN_ORDER = ["ts", "t1", "px", "pk", "sk", "ok"]


def _blocks(k: int) -> str:
    return f"SELECT *, ntile({k}) OVER (ORDER BY t0, t1, px, pk, sk, l_orderkey) - 1 AS blk, count(*) OVER () AS n FROM spans"


cte("fold5", _blocks(5), ("spans",), materialized=True)
cte("fold5_b", "SELECT blk, min(t0) AS lo, max(t1) AS hi, max(t1) + floor(max(n) * 0.001) AS hie FROM fold5 GROUP BY blk", ("fold5",), materialized=True)
cte("fold5_r", """
SELECT b.blk AS fold, f.t0, f.t1, CASE WHEN f.blk = b.blk THEN 'test' WHEN f.t1 < b.lo OR f.t0 > b.hie THEN 'train' ELSE 'purged' END AS role,
 f.blk <> b.blk AND f.t1 >= b.lo AND f.t0 <= b.hi AS leaks FROM fold5 f, fold5_b b
""", ("fold5", "fold5_b"))


@query("purged_kfold", """
SELECT CAST(fold AS INTEGER) AS fold, role, count(*) AS n, CAST(sum(t0) AS BIGINT) AS t0_sum, min(t0) AS t0_min, max(t1) AS t1_max FROM fold5_r GROUP BY ALL
""", ("fold5_r",))
def _(spark, sf):
    d = FO.purged_kfold(spans(spark, sf), [], SPAN_ORDER, 5, 0.001)
    return d.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("t0").alias("t0_sum"),
                                         F.min("t0").alias("t0_min"), F.max("t1").alias("t1_max"))


@query("leakage_report", """
SELECT round(avg(kept), 6) AS mean_kept, round(avg(naive), 6) AS mean_naive, round(1 - avg(kept) / avg(naive), 6) AS removed_share, CAST(sum(leaks) AS BIGINT) AS leaks, round(avg(span), 6) AS mean_span
FROM (SELECT fold, count(*) FILTER (role = 'train') AS kept, count(*) FILTER (role <> 'test') AS naive, count(*) FILTER (leaks) AS leaks, avg(t1 - t0) AS span FROM fold5_r GROUP BY fold)
""", ("fold5_r",))
def _(spark, sf):
    return rounded(FO.leakage_report(FO.purged_kfold(spans(spark, sf), [], SPAN_ORDER, 5, 0.001), []))


cte("fold6", _blocks(6), ("spans",), materialized=True)
_PAIRS = list(combinations(range(6), 2))


@query("combinatorial_cv", """
WITH b AS (SELECT blk, min(t0) AS lo, max(t1) + floor(max(n) * 0.001) AS hi FROM fold6 GROUP BY blk),
c AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(_PAIRS)) + """) v(path, a, b)),
r AS (SELECT path, CASE WHEN f.blk IN (c.a, c.b) THEN 'test' WHEN (f.t1 < x.lo OR f.t0 > x.hi) AND (f.t1 < y.lo OR f.t0 > y.hi) THEN 'train' ELSE 'purged' END AS role, f.t0
  FROM fold6 f, c JOIN b x ON x.blk = c.a JOIN b y ON y.blk = c.b)
SELECT path, role, count(*) AS n, CAST(sum(t0) AS BIGINT) AS t0_sum FROM r GROUP BY ALL
""", ("fold6",))
def _(spark, sf):
    d = FO.combinatorial(spans(spark, sf), [], SPAN_ORDER, 6, 2, 0.001)
    return d.groupBy("path", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("t0").alias("t0_sum"))


@query("time_split", """
SELECT (SELECT count(*) FROM spans WHERE t1 < 10500) AS train, (SELECT count(*) FROM spans WHERE t0 >= 10500) AS test, count(*) AS total FROM spans
""", ("spans",))
def _(spark, sf):
    d = spans(spark, sf)
    return d.agg(F.sum(F.when(F.col("t1") < 10500, 1).otherwise(0)).alias("train"),
                 F.sum(F.when(F.col("t0") >= 10500, 1).otherwise(0)).alias("test"), F.count(F.lit(1)).alias("total"))


# ----------------------------------------------------------------- statistics

cte("day_returns", """
SELECT o_orderpriority AS strategy, CAST(o_orderdate AS DATE) AS day, (avg(o_totalprice % 1000) - 495) / 20000 AS ret FROM orders GROUP BY ALL
""", materialized=True)


def day_returns(spark, sf):
    """A daily return per strategy."""
    o = V.table(spark, sf, "orders")
    return (o.groupBy(F.col("o_orderpriority").alias("strategy"), F.to_date("o_orderdate").alias("day"))
            .agg(((F.avg(F.col("o_totalprice") % 1000) - 495) / 20000).alias("ret")))


cte("moments", """
SELECT strategy, n, sr, m3 / pow(sd, 3) AS sk, m4 / pow(sd, 4) AS ku, 1 - m3 / pow(sd, 3) * sr + (m4 / pow(sd, 4) - 1) / 4 * sr * sr AS v FROM
(SELECT strategy, count(*) AS n, avg(ret) / stddev_samp(ret) AS sr, stddev_samp(ret) AS sd, avg(pow(ret - mu, 3)) AS m3, avg(pow(ret - mu, 4)) AS m4
 FROM (SELECT *, avg(ret) OVER (PARTITION BY strategy) AS mu FROM day_returns) GROUP BY strategy)
""", ("day_returns",), materialized=True)


@query("psr", f"""
SELECT strategy, n, round(sr, 6) AS sharpe, round(sk, 6) AS skew, round(ku, 6) AS kurt, round({norm_cdf_sql('(sr * sqrt(n - 1) / sqrt(v))')}, 6) + 0.0 AS psr,
 CASE WHEN sr <= 0 THEN 'inf'::DOUBLE ELSE round(1 + v / (sr * sr) * {NormalDist().inv_cdf(0.95) ** 2}, 2) END AS min_track_record FROM moments
""", ("moments",))
def _(spark, sf):
    m = O.return_moments(day_returns(spark, sf), ["strategy"])
    return rounded(O.min_track_record(O.probabilistic_sharpe(m)).drop("sd"), min_track_record=2)


_N = 104
_EMS = (1 - O.EULER) * NormalDist().inv_cdf(1 - 1 / _N) + O.EULER * NormalDist().inv_cdf(1 - 1 / (_N * 2.718281828459045))


@query("deflated_sharpe", f"""
SELECT m.strategy, round(sr, 6) AS sharpe, round(s0, 6) AS sr0, round({norm_cdf_sql('((sr - s0) * sqrt(n - 1) / sqrt(v))')}, 6) + 0.0 AS dsr
FROM moments m, (SELECT sqrt(var_samp(sr)) * {_EMS} AS s0 FROM moments) x
""", ("moments",))
def _(spark, sf):
    m = O.return_moments(day_returns(spark, sf), ["strategy"])
    return rounded(O.deflated_sharpe(m, m, _N).select("strategy", "sharpe", "sr0", "dsr"))


cte("aligned", """
SELECT strategy, day, ret FROM day_returns WHERE day IN (SELECT day FROM day_returns GROUP BY day HAVING count(*) = (SELECT count(DISTINCT strategy) FROM day_returns))
""", ("day_returns",), materialized=True)


@query("variant_matrix", "SELECT strategy, CAST(day AS VARCHAR) AS day, round(ret, 12) AS ret FROM aligned", ("aligned",))
def _(spark, sf):
    return rounded(O.aligned(day_returns(spark, sf), "strategy", "day", "ret").select("strategy", "day", "ret"), 12)


_COMBOS = list(combinations(range(8), 4))
cte("pbo_splits", """
WITH b AS (SELECT day, ntile(8) OVER (ORDER BY day) - 1 AS blk FROM (SELECT DISTINCT day FROM aligned)),
m AS (SELECT strategy, blk, ret FROM aligned JOIN b USING (day)), c AS (SELECT * FROM (VALUES """
    + ", ".join(f"({i}, [{', '.join(map(str, c))}])" for i, c in enumerate(_COMBOS)) + """) v(split, blocks)),
s AS (SELECT split, strategy, avg(ret) FILTER (list_contains(blocks, blk)) / stddev_samp(ret) FILTER (list_contains(blocks, blk)) AS i,
   avg(ret) FILTER (NOT list_contains(blocks, blk)) / stddev_samp(ret) FILTER (NOT list_contains(blocks, blk)) AS o FROM m, c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY i DESC, strategy) AS best, row_number() OVER (PARTITION BY split ORDER BY o, strategy) / (count(*) OVER (PARTITION BY split) + 1.0) AS rk FROM s)
SELECT split, strategy AS winner, i AS is_sr, o AS winner_oos_sr, rk AS oos_rank, ln(rk / (1 - rk)) AS logit FROM r WHERE best = 1
""", ("aligned",), materialized=True)


def splits(spark, sf):
    return O.pbo_splits(O.aligned(day_returns(spark, sf), "strategy", "day", "ret"), 8, "strategy", "day", "ret")


@query("pbo_splits", """
SELECT split, winner, round(is_sr, 6) AS is_sr, round(winner_oos_sr, 6) AS winner_oos_sr, round(oos_rank, 6) AS oos_rank, round(logit, 6) AS logit FROM pbo_splits
""", ("pbo_splits",))
def _(spark, sf):
    return rounded(splits(spark, sf))


@query("pbo", """
SELECT round(p, 6) AS pbo, n AS splits, CASE WHEN p < 0.1 THEN 'selection looks sound' WHEN p < 0.2 THEN 'acceptable' WHEN p < 0.5 THEN 'OVERFIT' ELSE 'SEVERELY OVERFIT' END AS verdict
FROM (SELECT avg(CASE WHEN logit <= 1e-12 THEN 1.0 ELSE 0.0 END) AS p, count(*) AS n FROM pbo_splits)
""", ("pbo_splits",))
def _(spark, sf):
    return rounded(O.pbo(splits(spark, sf)))


@query("walk_forward", """
WITH d AS (SELECT CAST(exit_ts AS DATE) AS day, count(*) AS n, sum(r_multiple) AS s FROM trades GROUP BY 1), f AS (SELECT *, ntile(6) OVER (ORDER BY day) - 1 AS fold FROM d),
g AS (SELECT fold, max(day) AS end_day, sum(sum(n)) OVER (ORDER BY fold) AS n, sum(sum(s)) OVER (ORDER BY fold) AS s FROM f GROUP BY fold)
SELECT CAST(fold AS INTEGER) AS fold, CAST(end_day AS VARCHAR) AS end_day, CAST(n AS BIGINT) AS trades, round(s / n, 6) AS expectancy_r, s / n > 0 AS positive FROM g WHERE fold > 0
""", ("trades",))
def _(spark, sf):
    return rounded(O.walk_forward(T.derived(V.trades(spark, sf))))


GATES = [("trades", ">=", 30), ("expectancy_r", ">=", 0.02), ("cost_drag", "<=", 0.5), ("max_drawdown", "<=", 0.25)]


@query("gates", """
WITH m AS (SELECT strategy, count(*) AS trades, avg(r_multiple) AS expectancy_r, sum(costs) / nullif(sum(gross_pnl) FILTER (gross_pnl > 0), 0) AS cost_drag, 0.1 * count(*) / 10000 AS max_drawdown FROM trades GROUP BY strategy),
g AS (SELECT strategy, trades >= 30 AS a, expectancy_r >= 0.02 AS b, cost_drag <= 0.5 AS c, max_drawdown <= 0.25 AS d FROM m)
SELECT strategy, a AND b AND c AND d AS passed, CAST(a::INT + b::INT + c::INT + d::INT AS BIGINT) AS gates_passed,
 array_to_string(list_filter([CASE WHEN NOT c THEN 'cost_drag' END, CASE WHEN NOT b THEN 'expectancy_r' END, CASE WHEN NOT d THEN 'max_drawdown' END, CASE WHEN NOT a THEN 'trades' END], lambda x: x IS NOT NULL), ',') AS blocked FROM g
""", ("trades",))
def _(spark, sf):
    t = T.derived(V.trades(spark, sf))
    m = t.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("trades"), F.avg("r_multiple").alias("expectancy_r"),
        F.try_divide(F.sum("costs"), F.sum(F.when(F.col("gross_pnl") > 0, F.col("gross_pnl")))).alias("cost_drag"),
        (F.lit(0.1) * F.count(F.lit(1)) / 10000).alias("max_drawdown"))
    return O.gate_verdict(O.gates(m, GATES, ["strategy"]), ["strategy"])


@query("compare_runs", """
WITH m AS (SELECT sleeve, avg(r_multiple) AS expectancy_r, sum(costs) / sum(gross_pnl) FILTER (gross_pnl > 0) AS cost_drag, avg(CASE WHEN r_multiple > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM trades GROUP BY sleeve),
l AS (SELECT 'expectancy_r' AS metric, true AS up, a.expectancy_r AS base, b.expectancy_r AS other FROM m a, m b WHERE a.sleeve = 'A' AND b.sleeve = 'N'
 UNION ALL SELECT 'cost_drag', false, a.cost_drag, b.cost_drag FROM m a, m b WHERE a.sleeve = 'A' AND b.sleeve = 'N' UNION ALL SELECT 'win_rate', true, a.win_rate, b.win_rate FROM m a, m b WHERE a.sleeve = 'A' AND b.sleeve = 'N')
SELECT metric, round(base, 6) AS base, round(other, 6) AS other, CASE WHEN base = other THEN 'tie' WHEN up = (other > base) THEN 'other' ELSE 'base' END AS winner FROM l
""", ("trades",))
def _(spark, sf):
    m = T.derived(V.trades(spark, sf)).groupBy("sleeve").agg(
        F.avg("r_multiple").alias("expectancy_r"),
        (F.sum("costs") / F.sum(F.when(F.col("gross_pnl") > 0, F.col("gross_pnl")))).alias("cost_drag"),
        F.avg(F.when(F.col("r_multiple") > 0, 1.0).otherwise(0.0)).alias("win_rate"))
    return rounded(O.compare_runs(m, "sleeve", "A", "N", {"expectancy_r": True, "cost_drag": False, "win_rate": True}))


cte("scored", """
SELECT event_type AS grp, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS p, CASE WHEN value > 40 THEN 1 ELSE 0 END AS y FROM events
""")


def scored(spark, sf):
    p = F.get_json_object("props", "$.k").cast("double") / 100
    return V.table(spark, sf, "events").select(F.col("event_type").alias("grp"), p.alias("p"),
                                               F.when(F.col("value") > 40, 1).otherwise(0).alias("y"))


@query("calibration_bins", """
SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed, avg(p) - avg(y) > 0.1 AS overconfident FROM scored GROUP BY 1
""", ("scored",))
def _(spark, sf):
    return rounded(O.calibration_report(scored(spark, sf)))


@query("brier_score", """
SELECT grp, count(*) AS n, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(y), 6) AS base_rate, round(avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS kept, round(avg(y) * (1 - avg(y)), 6) AS brier_base FROM scored GROUP BY grp
""", ("scored",))
def _(spark, sf):
    return rounded(O.brier(scored(spark, sf), keys=["grp"]))


# ------------------------------------------------------------ paths and limits

RULES = PA.Rules(50_000, 1_500, 1_000, True, 700, 0.5, 2, 60)
RISKS = [0.5, 1.0]

cte("book_returns", """
SELECT ret, day, row_number() OVER (ORDER BY day) - 1 AS t, count(*) OVER () AS n FROM (SELECT day, avg(ret) * 2 AS ret FROM day_returns GROUP BY day)
""", ("day_returns",), materialized=True)


def book_returns(spark, sf):
    """One daily return series: the mean over strategies."""
    d = day_returns(spark, sf).groupBy("day").agg((F.avg("ret") * 2).alias("ret")).withColumn("book", F.lit("all"))
    return PA.with_period(d, ["book"], ["day"])


def _walk_sql(paths: str, horizon: int) -> str:
    return f"""
WITH e AS (SELECT *, 50000 * exp(sum(ln(1 + k * ret)) OVER (PARTITION BY k, path ORDER BY day)) AS eq FROM {paths}, (VALUES (0.5::DOUBLE), (1.0::DOUBLE)) r(k) WHERE day <= {horizon}),
s AS (SELECT *, coalesce(lag(eq) OVER w, 50000) AS sod, greatest(coalesce(max(eq) OVER (PARTITION BY k, path ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 50000), 50000) AS high FROM e WINDOW w AS (PARTITION BY k, path ORDER BY day))
SELECT *, greatest(max(eq - sod) OVER (PARTITION BY k, path ORDER BY day), 0) AS best FROM s
"""


cte("starts", f"SELECT s.path, b.t - s.path + 1 AS day, b.ret FROM book_returns b JOIN (SELECT t AS path FROM book_returns WHERE t < n - 2) s ON b.t >= s.path AND b.t < s.path + 60", ("book_returns",))
cte("start_walk", _walk_sql("starts", 60), ("starts",))
_OUTCOME = """
SELECT k, path, coalesce(arg_min(ev, day) FILTER (ev IS NOT NULL), 'timeout') AS outcome, CAST(coalesce(min(day) FILTER (ev IS NOT NULL), max(day)) AS BIGINT) AS days FROM
(SELECT *, CASE WHEN sod - eq >= 700 THEN 'daily_limit' WHEN eq <= high - 1000 THEN 'max_loss' WHEN eq - 50000 >= 1500 AND day >= 2 AND best <= 0.5 * (eq - 50000) THEN 'pass' END AS ev FROM {t}) GROUP BY k, path
"""
cte("start_outcome", _OUTCOME.format(t="start_walk"), ("start_walk",), materialized=True)
_TALLY = """
SELECT {k} count(*) AS paths, round(avg((outcome = 'pass')::INT), 6) AS p_pass, round(avg((outcome = 'max_loss')::INT), 6) AS p_max_loss, round(avg((outcome = 'daily_limit')::INT), 6) AS p_daily,
 round(avg((outcome = 'timeout')::INT), 6) AS p_timeout, median(days) FILTER (outcome = 'pass') AS median_days_to_pass FROM {t} GROUP BY k
"""


def start_walk(spark, sf):
    return PA.walk(PA.every_start(book_returns(spark, sf), ["book"], RULES), ["book"], RULES, RISKS)


@query("first_passage", "SELECT k, path, outcome, days FROM start_outcome", ("start_outcome",))
def _(spark, sf):
    return start_walk(spark, sf).drop("book")


@query("first_passage_tally", _TALLY.format(k="k,", t="start_outcome"), ("start_outcome",))
def _(spark, sf):
    return rounded(PA.tally(start_walk(spark, sf), ["book"]).drop("book"))


#: The size of a full study: paths, risk levels, days of an evaluation, days of a year.
PATHS, LEVELS, DAYS, YEAR = 10_000, [1.0, 0.5, 0.25, 0.1, 0.05, 0.025, 0.01], 400, 252
FULL = replace(RULES, max_days=DAYS)
_LEVELS = ", ".join(f"({k}::DOUBLE)" for k in LEVELS)
cte("boot_paths", f"""
SELECT p.path, b.b * 20 + o.o + 1 AS day, r.ret FROM (SELECT p AS path, b, ('0x' || substr(md5('all:' || p || ':' || b), 1, 15))::BIGINT % ((SELECT max(n) FROM book_returns) - 20) AS start
 FROM range({PATHS}) p(p), range({-(-DAYS // 20)}) b(b)) p, (SELECT p AS b FROM range({-(-DAYS // 20)}) r(p)) b, range(20) o(o), book_returns r WHERE b.b = p.b AND r.t = p.start + o.o
""", ("book_returns",), materialized=True)
cte("boot_outcome", f"""
WITH e AS (SELECT k, path, day, 50000 * exp(sum(ln(1 + k * ret)) OVER (PARTITION BY k, path ORDER BY day)) AS eq FROM boot_paths, (VALUES {_LEVELS}) r(k)),
s AS (SELECT *, coalesce(lag(eq) OVER w, 50000) AS sod, greatest(coalesce(max(eq) OVER (PARTITION BY k, path ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 50000), 50000) AS high FROM e WINDOW w AS (PARTITION BY k, path ORDER BY day)),
t AS (SELECT *, greatest(max(eq - sod) OVER (PARTITION BY k, path ORDER BY day), 0) AS best FROM s)
{_OUTCOME.format(t="t")}
""", ("boot_paths",), materialized=True)


def boot(spark, sf):
    return RS.walk(book_returns(spark, sf), ["book"], FULL, LEVELS, PATHS)


@query("block_bootstrap", _TALLY.format(k="k,", t="boot_outcome"), ("boot_outcome",))
def _(spark, sf):
    return rounded(PA.tally(boot(spark, sf), ["book"]).drop("book"))


@query("risk_sweep", """
WITH t AS (SELECT k, avg((outcome = 'pass')::INT) AS p_pass, avg((outcome = 'max_loss')::INT) AS p_max_loss, avg((outcome = 'daily_limit')::INT) AS p_daily, avg((outcome = 'timeout')::INT) AS p_timeout FROM boot_outcome GROUP BY k)
SELECT k, round(p_pass, 6) AS p_pass, round(p_max_loss, 6) AS p_max_loss, round(p_daily, 6) AS p_daily, round(p_timeout, 6) AS p_timeout FROM t ORDER BY p_pass DESC, k DESC LIMIT 1
""", ("boot_outcome",))
def _(spark, sf):
    return rounded(PA.best_risk(PA.tally(boot(spark, sf), ["book"]), ["book"]).drop("book"))


@query("survival", f"""
WITH e AS (SELECT k, path, day, 50000 * exp(sum(ln(1 + k * ret)) OVER (PARTITION BY k, path ORDER BY day)) AS eq FROM boot_paths, (VALUES {_LEVELS}) r(k) WHERE day <= {YEAR}),
s AS (SELECT *, coalesce(lag(eq) OVER w, 50000) AS sod, greatest(coalesce(max(eq) OVER (PARTITION BY k, path ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 50000), 50000) AS high FROM e WINDOW w AS (PARTITION BY k, path ORDER BY day)),
p AS (SELECT k, path, min(day) FILTER (eq <= CASE WHEN high >= 51000 THEN 50000 ELSE high - 1000 END) AS died, count(*) FILTER (eq - sod >= 150) AS wins FROM s GROUP BY k, path)
SELECT k, count(*) AS paths, round(avg((died IS NULL)::INT), 6) AS p_alive, round(avg((died IS NULL AND wins >= 5)::INT), 6) AS p_payable, median(died) AS median_days_alive FROM p GROUP BY k
""", ("boot_paths",))
def _(spark, sf):
    return rounded(RS.survival(book_returns(spark, sf), ["book"], FULL, LEVELS, PATHS, YEAR).drop("book"))


@query("risk_profile", """
WITH e AS (SELECT k, t, k * ret AS r, exp(sum(ln(greatest(1 + k * ret, 1e-300))) OVER (PARTITION BY k ORDER BY t)) AS eq FROM book_returns, (VALUES (0.5::DOUBLE), (1.0::DOUBLE)) v(k)),
d AS (SELECT *, 1 - eq / max(eq) OVER (PARTITION BY k ORDER BY t) AS dd FROM e)
SELECT k, round(stddev_samp(r) * sqrt(252), 6) AS vol, round(max(dd), 6) AS max_dd FROM d GROUP BY k
""", ("book_returns",))
def _(spark, sf):
    return rounded(PA.risk_profile(book_returns(spark, sf), ["book"], RISKS).drop("book"))


cte("mc_draw", """
SELECT d.path, d.step, r.ret FROM (SELECT p.path, s.t AS step, ('0x' || substr(md5('all:' || p.path || ':' || s.t), 1, 15))::BIGINT % s.n AS pick
 FROM range(50) p(path), book_returns s) d JOIN book_returns r ON r.t = d.pick
""", ("book_returns",))


@query("bootstrap_md5", """
WITH l AS (SELECT path, step, sum(ln(1 + ret - 0.0001)) OVER (PARTITION BY path ORDER BY step) AS l FROM mc_draw), f AS (SELECT *, max(l) OVER (PARTITION BY path ORDER BY step) - l AS fall FROM l),
p AS (SELECT path, exp(arg_max(l, step)) - 1 AS final, 1 - exp(-max(fall)) AS dd FROM f GROUP BY path)
SELECT count(*) AS paths, round(median(final), 6) AS median_return, round(quantile_cont(final, 0.05), 6) AS p05_return, round(quantile_cont(dd, 0.95), 6) AS p95_drawdown,
 round(median(dd), 6) AS median_drawdown, round(max(dd), 6) AS worst_drawdown, round(avg((final < 0)::INT), 6) AS prob_loss FROM p
""", ("mc_draw",))
def _(spark, sf):
    return rounded(PA.monte_carlo(book_returns(spark, sf), ["book"], 50, 0.0001).drop("book"))


@query("last5y_sharpe", """
SELECT sleeve, round(coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) * sqrt(252), 6) AS sharpe, count(ret) AS n FROM
(SELECT sleeve, ts, equity / lag(equity) OVER (PARTITION BY sleeve ORDER BY ts) - 1 AS ret FROM equity e WHERE ts >= (SELECT max(ts) FROM equity x WHERE x.sleeve = e.sleeve) - INTERVAL '1825 days') GROUP BY sleeve
""", ("equity",))
def _(spark, sf):
    from pyspark.sql import Window
    eq = T.daily_equity(T.derived(V.trades(spark, sf)), ["sleeve"], 1e9)
    eq = eq.withColumn("_top", F.max("ts").over(Window.partitionBy("sleeve")))
    tail = eq.filter(F.col("ts") >= F.col("_top") - F.expr("INTERVAL 1825 DAYS"))
    s = T.sharpe_by(T.equity_returns(tail, ["sleeve"]), ["sleeve"])
    return rounded(s.select("sleeve", (F.col("sharpe") * 252 ** 0.5).alias("sharpe"), "n"))
