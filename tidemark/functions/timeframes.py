"""Timeframe names, lengths and attributes, as a dimension and as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Canonical key -> (chart name, exchange name, broker name, pandas offset, seconds; a month has none).
TIMEFRAMES = {
    "1m": ("1", "1m", "1Min", "1min", 60),
    "3m": ("3", "3m", None, "3min", 180),
    "5m": ("5", "5m", "5Min", "5min", 300),
    "15m": ("15", "15m", "15Min", "15min", 900),
    "30m": ("30", "30m", "30Min", "30min", 1800),
    "45m": ("45", None, None, "45min", 2700),
    "1h": ("60", "1h", "1Hour", "1h", 3600),
    "4h": ("240", "4h", "4Hour", "4h", 14400),
    "1d": ("D", "1d", "1Day", "1D", 86400),
    "1w": ("W", "1w", "1Week", "1W-MON", 604800),
    "1M": ("M", "1M", "1Month", "1ME", None),
}
#: Other spellings -> key.
ALIASES = {a: k for k, row in TIMEFRAMES.items() for a in (k, *row[:-1]) if a}


def dimension(spark: SparkSession) -> DataFrame:
    """11 rows: timeframe, chart, exchange, broker, pandas, seconds."""
    return spark.createDataFrame([(k, *v) for k, v in TIMEFRAMES.items()], "timeframe string, chart string, exchange string, broker string, pandas string, seconds long")


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v)])


def normalize_timeframe(c: Column) -> Column:
    """Canonical key of any known spelling; null for others."""
    return _map(ALIASES)[c]


def tf_seconds(c: Column) -> Column:
    return _map({k: v[-1] for k, v in TIMEFRAMES.items() if v[-1]})[c]


def tf_to_chart(c: Column) -> Column:
    return _map({k: v[0] for k, v in TIMEFRAMES.items()})[c]


def is_intraday(c: Column) -> Column:
    return F.coalesce(tf_seconds(c) < 86400, F.lit(False))


def partition_scheme(c: Column) -> Column:
    """Files by month up to four hours, by year from a day on."""
    return F.when(is_intraday(c), "monthly").otherwise("yearly")


def seconds(tf: str) -> int | None:
    return TIMEFRAMES[ALIASES[tf]][-1]
