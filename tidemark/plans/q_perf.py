"""Queries of returns, trades, positions and grouped reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof, perf
from tidemark.operators.ranks import percentiles
from tidemark.plans.fixtures import BARS_1H, TICKS, bars_1h, table, ticks
from tidemark.plans.registry import query

R = 6
CURVES = f"{BARS_1H}, curves AS MATERIALIZED (SELECT symbol AS strategy_id, CAST(epoch(ts) AS BIGINT) AS t, close + 100 AS equity FROM bars), rets AS MATERIALIZED (SELECT *, coalesce(equity / lag(equity) OVER (PARTITION BY strategy_id ORDER BY t) - 1, 0) AS ret, (max(equity) OVER (PARTITION BY strategy_id ORDER BY t) - equity) / max(equity) OVER (PARTITION BY strategy_id ORDER BY t) AS dd FROM curves)"


def curves(spark, sf):
    return bars_1h(spark, sf).select(F.col("symbol").alias("strategy_id"), F.unix_seconds("ts").alias("t"), (F.col("close") + 100).alias("equity"))


def rnd(df, *cols):
    return df.withColumns({c: F.round(c, R) for c in cols})


@query("simple_returns", f"WITH {CURVES} SELECT strategy_id, t, round(ret, {R}) AS ret FROM rets")
def simple_returns(spark, sf):
    return rnd(perf.simple_returns(curves(spark, sf)).drop("equity"), "ret")


PERF = "count(*) AS n, arg_min(equity, t) AS e0, arg_max(equity, t) AS e1, avg(ret) AS m, stddev_samp(ret) AS s, stddev_samp(ret) FILTER (ret < 0) AS d, max(dd) AS dd"
OUT = "round(e1 - e0, 4) AS net_profit, round((e1 / e0 - 1) * 100, 4) AS return_pct, round(coalesce(m / nullif(s, 0) * sqrt(8760), 0), 4) AS sharpe, round(CASE WHEN n < 2 OR d = 0 THEN 0 ELSE m / d * sqrt(8760) END, 4) AS sortino, round(dd * 100, 4) AS max_dd_pct, round(coalesce((e1 / e0 - 1) / nullif(dd, 0), 0), 4) AS calmar"


@query("perf_metrics", f"WITH {CURVES}, a AS (SELECT strategy_id, {PERF} FROM rets GROUP BY 1) SELECT strategy_id, {OUT} FROM a")
def perf_metrics(spark, sf):
    return perf.perf_metrics(curves(spark, sf), 8760)


TRADES = f"{BARS_1H}, o AS (SELECT *, coalesce(lag(close > open) OVER w, false) AS on_, row_number() OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)), i AS (SELECT *, n - row_number() OVER (PARTITION BY symbol, on_ ORDER BY ts) AS island FROM o), trades AS MATERIALIZED (SELECT symbol, min(n) AS entry_bar, max(n) AS exit_bar, arg_min(open, ts) AS entry_price, arg_max(close, ts) AS exit_price, arg_max(close, ts) - arg_min(open, ts) AS pnl, 0.1 AS commission FROM i WHERE on_ GROUP BY symbol, island)"


def flagged(spark, sf):
    return bars_1h(spark, sf).withColumn("signal", F.col("close") > F.col("open"))


def trades(spark, sf):
    return perf.signal_episodes(flagged(spark, sf)).withColumn("commission", F.lit(0.1))


@query("signal_episodes", f"WITH {TRADES} SELECT symbol, entry_bar, exit_bar, entry_price, exit_price, round(pnl, {R}) AS pnl FROM trades")
def signal_episodes(spark, sf):
    t = rnd(trades(spark, sf).drop("commission"), "pnl")
    return t.withColumns({c: F.col(c).cast("long") for c in ("entry_bar", "exit_bar")})


@query("trade_metrics", f"WITH {TRADES}, n AS (SELECT *, pnl - commission AS net FROM trades), l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_bar) - row_number() OVER (PARTITION BY symbol, net < 0 ORDER BY entry_bar) AS island FROM n), r AS (SELECT symbol, max(c) AS max_losses FROM (SELECT symbol, island, count(*) AS c FROM l WHERE net < 0 GROUP BY 1, 2) GROUP BY 1) SELECT symbol, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END), {R}) AS win_rate, round(coalesce(sum(net) FILTER (net > 0), 0) / -sum(net) FILTER (net < 0), {R}) AS profit_factor, round(avg(net), {R}) AS mean_trade, count(*) AS n_trades, any_value(max_losses) AS max_losses FROM n JOIN r USING (symbol) GROUP BY symbol")
def trade_metrics(spark, sf):
    return rnd(perf.trade_metrics(trades(spark, sf), "symbol"), "win_rate", "profit_factor", "mean_trade")


@query("annualisation", "SELECT symbol, tf, round(sqrt(CASE WHEN symbol = 'click' THEN b ELSE a END), 6) AS factor FROM (SELECT DISTINCT event_type AS symbol FROM events), (VALUES ('1m', 525600, 98280), ('5m', 105120, 19656), ('15m', 35040, 6552), ('30m', 17520, 3276), ('1h', 8760, 1764), ('2h', 4380, 8760), ('4h', 2190, 504), ('6h', 1460, 8760), ('8h', 1095, 8760), ('12h', 730, 8760), ('1d', 365, 252), ('1w', 52, 52), ('3m', 8760, 8760)) AS v(tf, a, b)")
def annualisation(spark, sf):
    names = F.array(*map(F.lit, (*perf.BARS_A_YEAR_CRYPTO, "3m")))
    s = table(spark, sf, "events").select(F.col("event_type").alias("symbol")).distinct().select("symbol", F.explode(names).alias("tf"))
    return s.withColumn("factor", F.round(perf.annualisation(F.col("tf"), F.col("symbol") == "click"), R))


@query("compound_equity", f"WITH {CURVES} SELECT strategy_id, t, round(1000 * exp(sum(ln(1 + ret)) OVER (PARTITION BY strategy_id ORDER BY t)), 4) AS equity FROM rets")
def compound_equity(spark, sf):
    return perf.compound(perf.simple_returns(curves(spark, sf)).drop("equity"), 1000.0).select("strategy_id", "t", F.round("equity", 4).alias("equity"))


STOPS = f"{TRADES}, e AS (SELECT *, min(n) OVER (PARTITION BY symbol, island) AS episode, high - low AS atr FROM i WHERE on_), l AS (SELECT *, max(high - close * 0.1) OVER w AS fixed, max(close - 1.5 * atr) OVER w AS atr_stop, max(high) OVER w - 1.5 * atr AS chandelier FROM e WINDOW w AS (PARTITION BY symbol, episode ORDER BY n))"


@query("episode_stop_levels", f"WITH {STOPS} SELECT symbol, episode, round(max(fixed), {R}) AS fixed_stop, min(n) FILTER (low <= fixed) AS fixed_breach, min(n) FILTER (low <= atr_stop) AS atr_stop_breach, min(n) FILTER (low <= chandelier) AS chandelier_breach FROM l GROUP BY 1, 2")
def episode_stop_levels(spark, sf):
    rows = perf.episode_bars(flagged(spark, sf)).withColumn("atr", F.col("high") - F.col("low"))
    out = rnd(perf.stop_levels(rows, 10, 1.5), "fixed_stop")
    return out.withColumns({c: F.col(c).cast("long") for c in out.columns if c not in ("symbol", "fixed_stop")})


@query("position_size", f"WITH {TRADES} SELECT symbol, entry_bar, round(greatest(0, least(10000 * 0.01 / abs(entry_price - entry_price * 0.98), 10000 / entry_price, 60)), {R}) AS fixed, round(least(10000 * 0.01 / (3 * (abs(pnl) + 1)), 10000 / entry_price, 60), {R}) AS by_atr, round(least(10000 * least((0.55 - 0.45 / 1.5) * 0.25, 0.05) / abs(entry_price - entry_price * 0.98), 10000 / entry_price, 60), {R}) AS kelly FROM trades")
def position_size(spark, sf):
    t, p = trades(spark, sf), F.col("entry_price")
    out = perf.position_size(t, F.lit(10000.0), 1.0, p * 0.98, F.abs("pnl") + 1, F.lit(0.55), F.lit(1.5), p, atr_multiple=3.0, kelly_share=0.25, most=60.0)
    return rnd(out.select("symbol", F.col("entry_bar").cast("long").alias("entry_bar"), "fixed", "by_atr", "kelly"), "fixed", "by_atr", "kelly")


@query("optimal_f", f"WITH {TRADES}, x AS (SELECT symbol, f / 100.0 AS f, sum(CASE WHEN 1 + f / 100.0 * p / -w > 0 THEN ln(1 + f / 100.0 * p / -w) ELSE -1e9 END) AS l FROM (SELECT symbol, pnl + 2 AS p, min(pnl + 2) OVER (PARTITION BY symbol) AS w FROM trades), range(1, 101) AS r(f) WHERE w < 0 GROUP BY 1, 2) SELECT symbol, CAST(arg_max(f, (l, f)) AS DOUBLE) AS f, round(max(l), 4) AS log_twr FROM x GROUP BY 1")
def optimal_f(spark, sf):
    out = perf.optimal_f(trades(spark, sf).withColumn("pnl", F.col("pnl") + 2), "symbol")
    return out.withColumn("log_twr", F.round("log_twr", 4))


#: The fixture's symbols trade as these markets' symbols.
TRADED = {"click": "BTCUSDT", "view": "AVAXUSDT", "purchase": "XRPUSDT", "signup": "TSLA", "error": "IBM"}
TRADED_SQL = "(VALUES ('click', 'BTCUSDT', 0.005, 0.005, 0.005), ('view', 'AVAXUSDT', 0.015, 0.005, 0.005), ('purchase', 'XRPUSDT', 0.01, 0.005, 0.005), ('signup', 'TSLA', 0.008, 0.003, 0.003), ('error', 'IBM', 0.005, 0.003, 0.003)) AS m(symbol, traded, spread, i1h, other)"


def traded(df):
    return df.withColumn("traded", F.create_map(*[F.lit(x) for kv in TRADED.items() for x in kv])[F.col("symbol")])


@query("slippage_lookup", f"SELECT symbol, traded, timeframe, round(spread + CASE WHEN timeframe = '1h' THEN i1h WHEN timeframe = '1w' THEN other WHEN traded LIKE '%USDT' THEN crypto ELSE stock END, 4)::DOUBLE AS slippage_pct FROM (SELECT DISTINCT event_type AS symbol FROM events) JOIN {TRADED_SQL} USING (symbol), (VALUES ('1m', 0.02, 0.01), ('15m', 0.01, 0.005), ('1h', 0, 0), ('2h', 0.004, 0.003), ('1d', 0.002, 0.001), ('1w', 0, 0)) AS v(timeframe, crypto, stock)")
def slippage_lookup(spark, sf):
    names = F.array(*map(F.lit, ("1m", "15m", "1h", "2h", "1d", "1w")))
    s = table(spark, sf, "events").select(F.col("event_type").alias("symbol")).distinct().select("symbol", F.explode(names).alias("timeframe"))
    return perf.slippage(traded(s), "traded")


STRESS = f"{TRADES}, c AS (SELECT *, pnl - (entry_price + exit_price) * (spread + i1h)::DOUBLE / 100 AS net FROM trades JOIN {TRADED_SQL} USING (symbol)), s AS (SELECT symbol, avg(pnl) / stddev_samp(pnl) AS b, avg(net) / stddev_samp(net) AS a FROM c GROUP BY 1)"


def stressed(spark, sf):
    return perf.slippage_stress(perf.slippage(traded(trades(spark, sf)).withColumn("timeframe", F.lit("1h")), "traded"), "symbol", "timeframe")


@query("slippage_stress", f"WITH {STRESS} SELECT symbol, '1h' AS timeframe, round(b, {R}) AS before, round(a, {R}) AS after, round((b - a) / abs(b) * 100, 4) AS decay_pct, a > 0 AS survived FROM s")
def slippage_stress(spark, sf):
    return rnd(stressed(spark, sf), "before", "after").withColumn("decay_pct", F.round("decay_pct", 4))


@query("slippage_by_tf", f"WITH {STRESS} SELECT '1h' AS timeframe, count(*) FILTER (a > 0) AS survivors, round(avg((b - a) / abs(b) * 100), 4) AS mean_decay FROM s")
def slippage_by_tf(spark, sf):
    return stressed(spark, sf).groupBy("timeframe").agg(F.count_if("survived").alias("survivors"), F.round(F.avg("decay_pct"), 4).alias("mean_decay"))


CRISIS = "p AS (SELECT * FROM (VALUES ('a', 1704240000, 1704758400), ('b', 1705276800, 1705795200)) AS v(name, s, e))"


@query("crisis_replay", f"WITH {CURVES}, {CRISIS}, x AS (SELECT strategy_id, name, t, equity, max(equity) OVER w AS peak, row_number() OVER w AS n FROM curves JOIN p ON t >= s AND t < e WINDOW w AS (PARTITION BY strategy_id, name ORDER BY t)), y AS (SELECT *, 1 - equity / peak AS dd FROM x), z AS (SELECT *, arg_max(n, (dd, -n)) OVER (PARTITION BY strategy_id, name) AS wn, arg_max(peak, (dd, -n)) OVER (PARTITION BY strategy_id, name) AS wp FROM y) SELECT strategy_id, name, round(max(dd), {R}) AS max_dd, min(equity) AS min_equity, round(arg_max(equity, t) / arg_min(equity, t) - 1, {R}) AS ret, min(n - wn) FILTER (n > wn AND equity >= wp) AS recovery FROM z GROUP BY 1, 2")
def crisis_replay(spark, sf):
    p = spark.createDataFrame([("a", 1704240000, 1704758400), ("b", 1705276800, 1705795200)], "name string, start long, end long")
    out = rnd(perf.crisis_replay(asof.period_range_join(curves(spark, sf), p, "t")), "max_dd", "ret")
    return out.withColumn("recovery", F.col("recovery").cast("long"))


@query("drawdown_gate", f"WITH {CURVES}, g AS (SELECT strategy_id, t, dd, bool_or(dd >= 0.45) OVER (PARTITION BY strategy_id ORDER BY t) AS killed, (4 + t % 7) / equity * 100 AS heat_pct, 1 + 100 / equity AS new_gross FROM rets) SELECT strategy_id, t, round(dd, {R}) AS dd, killed, round(heat_pct, {R}) AS heat_pct, round(new_gross, {R}) AS new_gross, CASE WHEN killed THEN 'killed' WHEN dd >= 0.3 THEN 'drawdown' WHEN heat_pct > 8 THEN 'heat' WHEN new_gross > 1.9 THEN 'gross' ELSE 'approved' END AS reason FROM g")
def drawdown_gate(spark, sf):
    c = curves(spark, sf).withColumns({"open_risk": F.lit(4.0), "proposed_risk": (F.col("t") % 7).cast("double"), "gross": F.lit(1.0), "proposed_notional": F.lit(100.0)})
    out = perf.drawdown_gate(c, 30.0, 45.0, 8.0, 1.9)
    return rnd(out.select("strategy_id", "t", "dd", "killed", "heat_pct", "new_gross", "reason"), "dd", "heat_pct", "new_gross")


# --- reports and positions

RUNS = "SELECT c_custkey AS run_id, c_mktsegment AS archetype, concat('N', c_nationkey) AS symbol, CASE WHEN c_custkey % 3 = 0 THEN '1h' ELSE '4h' END AS timeframe, c_acctbal / 1000 AS sharpe FROM customer"


def runs(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("archetype"), F.concat(F.lit("N"), "c_nationkey").alias("symbol"), F.when(F.col("c_custkey") % 3 == 0, "1h").otherwise("4h").alias("timeframe"), (F.col("c_acctbal") / 1000).alias("sharpe"))


@query("group_breakdown", f"SELECT archetype, symbol, timeframe, count(*) AS n, round(avg(sharpe), {R}) AS mean_sharpe FROM ({RUNS}) GROUP BY GROUPING SETS ((archetype), (symbol), (timeframe), ())")
def group_breakdown(spark, sf):
    sets = [["archetype"], ["symbol"], ["timeframe"], []]
    return runs(spark, sf).groupingSets(sets, "archetype", "symbol", "timeframe").agg(F.count("*").alias("n"), F.round(F.avg("sharpe"), R).alias("mean_sharpe"))


@query("metric_histogram", f"WITH r AS ({RUNS}), b AS (SELECT min(sharpe) AS lo, max(sharpe) AS hi FROM r) SELECT CAST(least(floor((sharpe - lo) / (hi - lo) * 30) + 1, 30) AS BIGINT) AS bin, count(*) AS n FROM r, b GROUP BY 1")
def metric_histogram(spark, sf):
    r = runs(spark, sf)
    b = r.agg(F.min("sharpe").alias("lo"), F.max("sharpe").alias("hi"))  # one row
    bin_ = F.least(F.floor((F.col("sharpe") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 30) + 1, F.lit(30))
    return r.crossJoin(F.broadcast(b)).groupBy(bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("box_stats", f"SELECT archetype, timeframe, " + ", ".join(f"round(quantile_cont(sharpe, {q / 4}), {R}) AS q{q}" for q in range(5)) + f" FROM ({RUNS}) GROUP BY 1, 2")
def box_stats(spark, sf):
    p = percentiles(runs(spark, sf), "sharpe", {f"q{q}": q / 4 for q in range(5)}, "archetype", "timeframe")
    return p.select("archetype", "timeframe", *[F.round(f"q{q}", R).alias(f"q{q}") for q in range(5)])


POS = "pos AS (SELECT concat('s', c_nationkey % 4) AS strategy_id, t AS symbol, CASE WHEN c_acctbal > 2000 THEN 1.0 ELSE -2.0 END::DOUBLE AS quantity, 50.0 + c_custkey % 7 AS price, CASE WHEN c_custkey % 3 = 0 THEN 48.0 END AS stop FROM customer JOIN (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT event_type AS t FROM events)) ON c_custkey % 5 = i)"


def positions(spark, sf):
    names = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    c = table(spark, sf, "customer")
    return c.select(F.concat(F.lit("s"), F.col("c_nationkey") % 4).alias("strategy_id"), names[(F.col("c_custkey") % 5).cast("int")].alias("symbol"), F.when(F.col("c_acctbal") > 2000, 1.0).otherwise(-2.0).alias("quantity"), (50.0 + F.col("c_custkey") % 7).alias("price"), F.when(F.col("c_custkey") % 3 == 0, 48.0).alias("stop"))


@query("positions_consolidated", f"WITH {POS} SELECT symbol, sum(quantity) AS net, sum(abs(quantity)) AS gross, sum(CASE WHEN quantity > 0 THEN quantity ELSE 0 END) AS long, sum(CASE WHEN quantity < 0 THEN -quantity ELSE 0 END) AS short, array_to_string(list_sort(list(DISTINCT strategy_id)), ',') AS strategies FROM pos GROUP BY 1")
def positions_consolidated(spark, sf):
    return perf.positions_consolidated(positions(spark, sf))


@query("mark_to_market", f"WITH {TICKS}, {POS}, l AS (SELECT symbol, arg_max(price, (ts, seq)) AS last FROM ticks GROUP BY 1) SELECT strategy_id, round(sum(quantity * (last - price)), {R}) AS unrealised, round(10000 + sum(quantity * (last - price)), {R}) AS equity FROM pos JOIN l USING (symbol) GROUP BY 1")
def mark_to_market(spark, sf):
    p = positions(spark, sf).withColumnRenamed("price", "entry_price")
    return rnd(perf.mark_to_market(p, ticks(spark, sf), 10000.0), "unrealised", "equity")


@query("portfolio_exposure", f"WITH {POS} SELECT strategy_id, round(sum(coalesce(abs(quantity * (price - stop)), abs(quantity * price) * 0.02)), {R}) AS open_risk, sum(abs(quantity * price))::DOUBLE AS gross, sum(quantity * price)::DOUBLE AS net, count(*) AS n_positions FROM pos GROUP BY 1")
def portfolio_exposure(spark, sf):
    return rnd(perf.exposure(positions(spark, sf), "strategy_id"), "open_risk")


@query("duplicate_files", "SELECT concat('p', p_size, '.json') AS name, count(DISTINCT p_brand) AS n_dirs FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def duplicate_files(spark, sf):
    paths = table(spark, sf, "part").select(F.concat(F.lit("root/"), "p_brand", F.lit("/p"), "p_size", F.lit(".json")).alias("path"))
    p = paths.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.element_at(F.split("path", "/"), -2).alias("dir"))
    return p.groupBy("name").agg(F.size(F.collect_set("dir")).cast("long").alias("n_dirs")).where("n_dirs > 1")


@query("batch_completeness", "SELECT c_mktsegment AS file, count(*) AS n_missing FROM (SELECT DISTINCT c_mktsegment FROM customer), range(200) AS r(i) WHERE (c_mktsegment, i) NOT IN (SELECT c_mktsegment, c_custkey % 200 FROM customer WHERE c_custkey % 200 <> 7) GROUP BY 1")
def batch_completeness(spark, sf):
    c = table(spark, sf, "customer").where("c_custkey % 200 <> 7").select(F.col("c_mktsegment").alias("file"), (F.col("c_custkey") % 200).alias("i")).distinct()
    want = c.select("file").distinct().crossJoin(F.broadcast(spark.range(200).withColumnRenamed("id", "i")))  # 200 rows
    return want.join(c, ["file", "i"], "left_anti").groupBy("file").agg(F.count("*").alias("n_missing"))


