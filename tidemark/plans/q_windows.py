"""Queries of the window primitives."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import windows as win
from tidemark.plans.fixtures import BARS_1D, bars_1d, bars_1h
from tidemark.plans.registry import query
from tidemark.plans.sqlsteps import ORDER, RUN, Steps, cross, lag, last, sma

R = 6


def put(name: str, sql: str, make) -> None:
    """Register a column over hourly bars: ``make(bars)`` gives bars with column v."""

    def f(spark, sf):
        rows = make(bars_1h(spark, sf))
        v = F.round("v", R) if dict(rows.dtypes)["v"] == "double" else F.col("v")
        return rows.select("symbol", "ts", v.alias("v"))

    query(name, sql)(f)


def col(name: str, expr: str, column, rounded: bool = True) -> None:
    put(name, Steps().add(v=expr).select(f"symbol, ts, {f'round(v, {R})' if rounded else 'v'} AS v"), lambda b: b.withColumn("v", column()))


UP = f"(close > {lag('open')})"
col("hold_bars", f"max(CASE WHEN volume >= 6 THEN 1 ELSE 0 END) OVER {last(3)} = 1", lambda: win.hold_bars(F.col("volume") >= 6, 3), False)
col("crossover", cross("close", "open"), lambda: win.crossover(F.col("close"), F.col("open")), False)
col("crossunder", cross("close", "open", False), lambda: win.crossunder(F.col("close"), F.col("open")), False)
col("sma", sma("close", 10), lambda: win.sma("close", 10))
col("rolling_min", f"CASE WHEN count(low) OVER {last(10)} = 10 THEN min(low) OVER {last(10)} END", lambda: win.rolling_min("low", 10))
col("rolling_max", f"CASE WHEN count(high) OVER {last(10)} = 10 THEN max(high) OVER {last(10)} END", lambda: win.rolling_max("high", 10))
col("rolling_std", f"CASE WHEN count(close) OVER {last(10)} = 10 THEN stddev_pop(close) OVER {last(10)} END", lambda: win.rolling_std("close", 10, ddof=0))
col("rolling_var", f"CASE WHEN count(close) OVER {last(10)} = 10 THEN var_samp(close) OVER {last(10)} END", lambda: win.rolling_var("close", 10))
WMA = "(" + " + ".join(f"coalesce(lag(close, {k}) OVER {ORDER}, 0) * {4 - k}" for k in range(4)) + ") / (" + " + ".join(f"CASE WHEN rn > {k} THEN {4 - k} ELSE 0 END" for k in range(4)) + ")"
col("wma", WMA, lambda: win.wma("close", 4))
put("ema", Steps().ema("v", "close", 12).select(f"symbol, ts, round(v, {R}) AS v"), lambda b: win.ema(b, "v", "close", 12))
put("ema_sma_seed", Steps().ema("v", "close", 12, True).select(f"symbol, ts, round(v, {R}) AS v"), lambda b: win.ema(b, "v", "close", 12, sma_seed=True))
put("wilder", Steps().true_range().wilder("v", "tr", 14).select(f"symbol, ts, round(v, {R}) AS v"), lambda b: win.atr(b, "v", 14))
put("smma", Steps().wilder("v", "close", 7).select(f"symbol, ts, round(v, {R}) AS v"), lambda b: win.smma(b, "v", "close", 7))


def _wma(x: str, n: int) -> str:
    return "(" + " + ".join(f"coalesce(lag({x}, {k}) OVER {ORDER}, 0) * {n - k}" for k in range(n)) + ") / (" + " + ".join(f"CASE WHEN rn > {k} THEN {n - k} ELSE 0 END" for k in range(n)) + ")"


put("hma", Steps().add(h=f"2 * {_wma('close', 4)} - {_wma('close', 9)}").add(v=_wma("h", 3)).select(f"symbol, ts, round(v, {R}) AS v"), lambda b: win.hma(b, "v", "close", 9))
col("true_range", f"greatest(high - low, coalesce(abs(high - {lag('close')}), 0), coalesce(abs(low - {lag('close')}), 0))", win.true_range)
col("cumulative_vwap", f"sum((high + low + close) / 3 * volume) OVER {RUN} / sum(volume) OVER {RUN}", win.cumulative_vwap)
put("obv", Steps().add(d=f"close - {lag('close')}").add(v=f"sum(CASE WHEN d > 0 THEN volume WHEN d < 0 THEN -volume ELSE 0 END) OVER {RUN}").select("symbol, ts, v"), lambda b: b.withColumn("s", win.obv_step()).withColumn("v", F.sum("s").over(win.ALL())))
PIVOT = "coalesce(count(high) OVER b = 3 AND count(high) OVER a = 2 AND high > max(high) OVER b AND high > max(high) OVER a, false)"
WINDOWS = " WINDOW b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)"
put("pivot_high", Steps().select(f"symbol, ts, {PIVOT} AS v") + WINDOWS, lambda b: b.withColumn("v", win.pivot_high("high", 3, 2)))
put("pivot_low", Steps().select(f"symbol, ts, {PIVOT.replace('high', 'low').replace('>', '<').replace('max', 'min')} AS v") + WINDOWS, lambda b: b.withColumn("v", win.pivot_low("low", 3, 2)))
col("last_state", f"last_value(CASE WHEN volume > 7 THEN 1 WHEN volume < 2 THEN -1 END IGNORE NULLS) OVER {RUN}", lambda: win.last_state(F.when(F.col("volume") > 7, 1).when(F.col("volume") < 2, -1)), False)
PRIOR = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
col("rolling_zscore_prior", f"CASE WHEN count(close) OVER {PRIOR} = 20 AND stddev_samp(close) OVER {PRIOR} > 1e-12 THEN (close - avg(close) OVER {PRIOR}) / stddev_samp(close) OVER {PRIOR} END", lambda: win.zscore_prior("close", 20))
put("rolling_pct_rank", Steps().add(v=f"CASE WHEN rn >= 30 THEN len(list_filter(list(close) OVER {last(30)}, lambda x: x <= close)) / 30.0 END").select(f"symbol, ts, round(v, {R}) AS v"), lambda b: win.pct_rank(b, "v", "close", 30))
col("drawdown", f"(max(close) OVER {RUN} - close) / max(close) OVER {RUN}", lambda: win.drawdown("close"))
col("warmup_false", "rn > 50 AND volume > 5", lambda: win.warm(F.col("volume") > 5, 50), False)


@query("max_streak", Steps().add(f="close > open").add(g=f"rn - row_number() OVER (PARTITION BY symbol, f ORDER BY ts)").select("symbol, f, g, count(*) AS c").replace("WHERE true", "GROUP BY ALL").join(["SELECT symbol, coalesce(max(c) FILTER (f), 0) AS max_streak FROM (", ") GROUP BY symbol"]))
def max_streak(spark, sf):
    return win.max_streak(bars_1h(spark, sf).withColumn("f", F.col("close") > F.col("open")), "f")


@query("cs_momentum_rank", f"WITH {BARS_1D}, m AS (SELECT symbol, ts, lag(close, 21) OVER {ORDER} / lag(close, 252) OVER {ORDER} - 1 AS mom FROM days) SELECT symbol, ts, round(mom, {R}) AS mom, round(percent_rank() OVER (PARTITION BY ts ORDER BY mom), {R}) AS cs_momentum_rank FROM m WHERE mom IS NOT NULL")
def cs_momentum_rank(spark, sf):
    rows = win.cs_momentum_rank(bars_1d(spark, sf), 252, 21)
    return rows.select("symbol", "ts", F.round("mom", R).alias("mom"), F.round("cs_momentum_rank", R).alias("cs_momentum_rank"))
