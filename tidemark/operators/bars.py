"""Time bucketing: ticks to bars, bars to coarser bars, last values by day.

A bar table has symbol, ts (start of the bar), open, high, low, close, volume.
Buckets are closed on the left and labelled by their start; weeks start on
Monday; empty buckets don't exist. Aggregates combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeframes import seconds


def bucket(ts: Column, tf: str) -> Column:
    """Start of the bucket of a timeframe that holds ``ts``."""
    s = seconds(tf)
    if s is None:
        return F.date_trunc("month", ts)
    start = "4 days" if s == 604800 else "0 seconds"  # the epoch was a Thursday
    return F.window(ts, f"{s} seconds", startTime=start)["start"]


def ticks_to_bars(ticks: DataFrame, every: str) -> DataFrame:
    """Bars from (symbol, ts, seq, price, volume); seq orders ticks of one instant."""
    order = F.struct("ts", "seq")
    rows = ticks.withColumn("bar", F.window("ts", every)["start"])
    return rows.groupBy("symbol", F.col("bar").alias("ts")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))


def _fold(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n_base"))


def resample(bars: DataFrame, tf: str, base: str = "1h", drop_tail: bool = False) -> DataFrame:
    """Coarser bars with n_base, the base bars in each. ``drop_tail`` leaves out a symbol's last bar unless it is whole."""
    if seconds(tf) is not None and seconds(tf) <= seconds(base):
        raise ValueError(f"{tf} is not coarser than {base}")
    out = _fold(bars.withColumn("bar", bucket(F.col("ts"), tf)), "symbol", "bar").withColumnRenamed("bar", "ts")
    if drop_tail:
        last = F.col("ts") == F.max("ts").over(Window.partitionBy("symbol"))
        whole = F.lit(False) if seconds(tf) is None else F.col("n_base") >= seconds(tf) // seconds(base)
        out = out.withColumn("keep", ~last | whole).where("keep").drop("keep")
    return out


def resample_all(bars: DataFrame, tfs: list[str]) -> DataFrame:
    """All timeframes in one pass: each row goes to one bucket of each, then one aggregation."""
    each = F.explode(F.array(*[F.struct(F.lit(tf).alias("timeframe"), F.col(f"b{i}").alias("bar")) for i, tf in enumerate(tfs)]))
    rows = bars
    for i, tf in enumerate(tfs):  # one window() a projection: two in one would multiply rows
        rows = rows.withColumn(f"b{i}", bucket(F.col("ts"), tf))
    rows = rows.select("symbol", "ts", "open", "high", "low", "close", "volume", each.alias("x"))
    return _fold(rows.select("*", "x.timeframe", "x.bar"), "symbol", "timeframe", "bar").withColumnRenamed("bar", "ts")


def daily_last(curves: DataFrame, key: str = "symbol", value: str = "close") -> DataFrame:
    """Last value of each day, carried over days without one."""
    day = curves.groupBy(key, F.to_date("ts").alias("day")).agg(F.max_by(value, "ts").alias("last"))
    span = day.groupBy(key).agg(F.min("day").alias("a"), F.max("day").alias("z")).select(key, F.explode(F.sequence("a", "z")).alias("day"))
    w = Window.partitionBy(key).orderBy("day")
    return span.join(day, [key, "day"], "left").withColumn("last", F.last("last", ignorenulls=True).over(w))


def dedup_keep_last(rows: DataFrame, arrival: str, *keys: str) -> DataFrame:
    """The row that arrived last for each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(arrival).desc())
    return rows.withColumn("rn__", F.row_number().over(w)).where("rn__ = 1").drop("rn__")
