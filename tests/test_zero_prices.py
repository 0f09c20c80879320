"""Queries over ticks with prices of 0 against their SQL, and rules where a divisor is 0."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions.arithmetic import quotient
from tidemark.operators import quality
from tidemark.operators import windows as win
from tidemark.operators.signals import REGISTRY
from tidemark.plans import catalog

T0 = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """A folder with the events of sf0.01, each 97th and whole hours of some symbols at price 0."""
    path = tmp_path_factory.mktemp("zeros")
    value = "CASE WHEN event_id % 97 = 0 OR (hour(ts) = 13 AND day(ts) % 9 = 0) THEN 0 ELSE value END"
    duckdb.sql(f"COPY (SELECT * REPLACE ({value} AS value) FROM '/root/testdata/sf0.01/events.parquet') TO '{path}/events.parquet'")
    return str(path)


def same_as_sql(spark, path, name):
    df = catalog.queries()[name](spark, path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and got
    return df.columns, got


def test_quotient(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None)], "a double, b double")
    got = [r[0] for r in rows.select(quotient(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [0.5, math.inf, -math.inf] and math.isnan(got[3]) and got[4:] == [None, None]


def test_cross_validation_of_zero_prices(spark, zeros):
    columns, got = same_as_sql(spark, zeros, "cross_validate")
    assert all(math.isnan(r[columns.index("low_pct")]) for r in got)
    bar = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
    ours = spark.createDataFrame([("agrees", T0, 0.0, 2.0, 0.0, 1.0, 1.0), ("fails", T0, 1.0, 2.0, 1.0, 1.0, 1.0)], bar)
    native = spark.createDataFrame([("agrees", T0, 0.0, 2.0, 0.0, 1.0, 1.0), ("fails", T0, 1.0, 2.0, 0.0, 1.0, 1.0)], bar)
    rows = {r.symbol: r for r in quality.cross_validate(ours, native).collect()}
    assert rows["agrees"].passed and math.isnan(rows["agrees"].low_pct) and rows["agrees"].high_pct == 0
    assert not rows["fails"].passed and rows["fails"].low_pct == math.inf


def test_ratio_to_a_low_of_zero(spark, zeros):
    columns, got = same_as_sql(spark, zeros, "long_short_ratio")
    assert 0 < sum(r[columns.index("signal")] for r in got) < len(got)


def test_volatility_regimes_beside_a_low_of_zero(spark, zeros):
    columns, got = same_as_sql(spark, zeros, "volatility_regime")
    assert 0 < sum(r[columns.index("signal")] for r in got) < len(got)


@pytest.mark.parametrize("zone", ["Etc/UTC", "America/New_York"])
@pytest.mark.parametrize("name", ["volatility_regime", "firestorm", "hurst", "pct_rank"])
def test_ranks_and_bands_in_another_time_zone(spark, name, zone):
    """Sessions whose zone isn't called UTC: the same instants and signals as in UTC, also over an hour that comes twice."""
    closes = [100 + (7 * h * h) % 31 for h in range(24 * 40)]
    rows = [(datetime.datetime(2024, 10, 20).timestamp() + 3600 * h, float(c)) for h, c in enumerate(closes)]
    bars = spark.createDataFrame(rows, "s double, close double").select(F.lit("a").alias("symbol"), F.timestamp_seconds("s").alias("ts"), *[(F.col("close") + d).alias(c) for c, d in (("open", 0), ("high", 2), ("low", -2), ("close", 0))], F.lit(1.0).alias("volume"))

    def found():
        df = win.pct_rank(bars, "p", "close", 30) if name == "pct_rank" else REGISTRY[name](bars)
        return sorted(map(str, df.withColumn("ts", F.unix_micros("ts")).collect()))

    want = found()
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert found() == want and len(want) == len(closes)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
