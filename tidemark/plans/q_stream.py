"""Queries that run Structured Streaming over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.windows import W
from tidemark.plans.fixtures import BARS_1H, bars_1h, ticks
from tidemark.plans.registry import query
from tidemark.plans.sqlsteps import Steps, lag
from tidemark.sources.scratch import folder
from tidemark.streaming import bars as st
from tidemark.streaming import state
from tidemark.streaming.upsert import UpsertTable

R = 6


#: Runs of a query here; each goes on from the checkpoint of the one before.
RUNS = 3


def in_runs(spark, rows, what: str, start) -> None:
    """Write ``rows`` in slices of time to a folder that ``start(stream)`` reads as a stream, and run that to the end after each slice.

    Every run is a restart from the checkpoint, so state, watermark and sink go over from batch to batch.
    """
    path = folder(spark, what)
    lo, hi = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    place = F.least(F.floor((F.unix_micros("ts") - lo) / (hi - lo + 1) * RUNS), F.lit(RUNS - 1))
    sliced = rows.withColumn("slice__", place)
    for k in range(RUNS):
        sliced.where(F.col("slice__") == k).drop("slice__").write.mode("append").parquet(path)
        start(spark.readStream.schema(rows.schema).parquet(path)).trigger(availableNow=True).start().awaitTermination()


def result(spark, rows, what: str, make):
    """The rows that the stream ``make(stream of rows)`` appends to Parquet, with exactly-once commits."""
    path = folder(spark, f"stream-{what}")
    in_runs(spark, rows, what, lambda stream: st.to_parquet(make(stream), path))
    return spark.read.parquet(path)


@query("stream_bars", f"WITH {BARS_1H} SELECT * FROM bars WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES")
def stream_bars(spark, sf):
    return result(spark, ticks(spark, sf), "ticks", lambda s: st.closed_bars(s, "1 hour", "10 minutes"))


@query("stream_dedup", f"WITH {BARS_1H} SELECT symbol, ts, close FROM bars")
def stream_dedup(spark, sf):
    b = bars_1h(spark, sf)
    return result(spark, b.union(b), "bars", lambda s: st.dedup(s, "40 days")).select("symbol", "ts", "close")


def states(spark, sf):
    return result(spark, bars_1h(spark, sf), "state", lambda s: state.indicator_state(s, "1 hour", 12, 14, 3))


_S = Steps().true_range().ema("ema", "close", 12).wilder("atr", "tr", 14).add(d=f"close - {lag('close')}").add(obv="sum(CASE WHEN d > 0 THEN volume WHEN d < 0 THEN -volume ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts)", cr=f"coalesce({lag('close')} <= {lag('ema')} AND close > ema, false)").ema("up", "high", 12).ema("down", "low", 12).add(ssl="coalesce(last_value(CASE WHEN close > up THEN 1 WHEN close < down THEN -1 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0)")


@query("stream_indicator_state", _S.select(f"symbol, ts, round(ema, {R}) AS ema, round(atr, {R}) AS atr, round(obv, {R}) AS obv, ssl", "rn >= 14"))
def stream_indicator_state(spark, sf):
    rows = states(spark, sf).withColumn("rn", F.row_number().over(W()))
    return rows.where("rn >= 14").select("symbol", "ts", *[F.round(c, R).alias(c) for c in ("ema", "atr", "obv")], "ssl")


@query("stream_signal", _S.select("symbol, ts, max(CASE WHEN cr THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS 2 PRECEDING) = 1 AS signal"))
def stream_signal(spark, sf):
    return states(spark, sf).select("symbol", "ts", "signal")


# one symbol of the bars falls silent after two thirds of the time: nothing but the watermark tells
_SILENT = "symbol <> (SELECT max(symbol) FROM bars) OR ts < (SELECT min(ts) + (max(ts) - min(ts)) * 2 / 3 FROM bars)"


@query("stream_gap_alert", f"WITH {BARS_1H}, heard AS (SELECT *, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS n FROM bars WHERE {_SILENT}) SELECT symbol, ts, ts + INTERVAL 90 MINUTES AS due FROM heard WHERE n > ts + INTERVAL 90 MINUTES OR n IS NULL AND ts + INTERVAL 90 MINUTES <= (SELECT max(ts) FROM heard) - INTERVAL 1 HOUR")
def stream_gap_alert(spark, sf):
    b = bars_1h(spark, sf)
    symbol, lo, hi = b.agg(F.max("symbol"), F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    heard = b.where((F.col("symbol") != symbol) | (F.unix_micros("ts") < lo + (hi - lo) * 2 / 3))
    return result(spark, heard, "gaps", lambda s: state.gap_alerts(s, "1 hour", 3_600_000))


@query("stream_positions", "WITH p AS (SELECT event_type AS symbol, ts, event_id, value, CASE WHEN event_id % 2 = 0 THEN value ELSE -value END AS q, 1000 + sum(CASE WHEN event_id % 3 = 0 THEN -value ELSE value / 3 END) OVER w AS equity FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)), k AS (SELECT *, greatest(1000, max(equity) OVER (PARTITION BY symbol ORDER BY ts, event_id)) AS peak FROM p) SELECT symbol, round(sum(q), 4) AS net, round(sum(value), 4) AS gross, count(*) AS n_fills, round(arg_max(equity, (ts, event_id)), 4) AS equity, round(1 - arg_max(equity, (ts, event_id)) / arg_max(peak, (ts, event_id)), 4) AS drawdown, bool_or(1 - equity / peak >= 0.5) AS killed FROM k GROUP BY 1")
def stream_positions(spark, sf):
    t = ticks(spark, sf)
    fills = t.select("symbol", "ts", "seq", F.when(F.col("seq") % 2 == 0, F.col("price")).otherwise(-F.col("price")).alias("quantity"), F.when(F.col("seq") % 3 == 0, -F.col("price")).otherwise(F.col("price") / 3).alias("pnl"))
    path = folder(spark, "stream-positions")
    schema = spark.createDataFrame([], st.KILL_OUT).schema
    table = UpsertTable(spark, path, ["symbol"], schema)
    in_runs(spark, fills, "fills", lambda s: table.sink(st.position_risk(s, 1000.0, 0.5), f"{path}-state"))
    return table.read().select("symbol", "n_fills", "killed", *[F.round(c, 4).alias(c) for c in ("net", "gross", "equity", "drawdown")])
