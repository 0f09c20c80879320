"""Bars, slow series and strategies derived from the star-schema tables, in Spark and in SQL.

Hourly bars come from ``events`` (symbol: event type, price: value, volume:
count), daily bars from ``lineitem`` joined to ``part`` (symbol: brand, price:
extended price by quantity, volume: quantity), a slow series from ``orders``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.session import importable
from tidemark.operators.bars import ticks_to_bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_to_bars(ticks(spark, sf_dir), "1 hour")


def day_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = li.join(p, li.l_partkey == p.p_partkey)
    seq = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    return rows.select(F.col("p_brand").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.struct(seq.alias("a"), F.col("l_partkey").alias("b"), F.col("l_quantity").alias("c"), F.col("l_extendedprice").alias("d")).alias("seq"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"))


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_to_bars(day_ticks(spark, sf_dir), "1 day")


def slow_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("key"), F.col("o_orderdate").cast("timestamp").alias("ts")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))


TICKS = "ticks AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price, 1.0::DOUBLE AS volume FROM events)"
BARS_1H = (
    "bars AS MATERIALIZED (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,"
    " arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)"
)
BARS_1D = (
    "days AS MATERIALIZED (SELECT p_brand AS symbol, l_shipdate AS ts, arg_min(p, q) AS open, max(p) AS high, min(p) AS low, arg_max(p, q) AS close, sum(l_quantity) AS volume"
    " FROM (SELECT *, l_extendedprice / l_quantity AS p, (l_shipdate, (l_orderkey * 100 + l_linenumber, l_partkey, l_quantity, l_extendedprice)) AS q FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2)"
)
SLOW = "slow AS MATERIALIZED (SELECT o_orderpriority AS key, o_orderdate AS ts, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2)"
W = "(PARTITION BY symbol ORDER BY ts)"


def over(n: int, ahead: int = 0) -> str:
    """SQL window of the last n rows."""
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND {ahead or 'CURRENT ROW'}{' FOLLOWING' if ahead else ''})"
