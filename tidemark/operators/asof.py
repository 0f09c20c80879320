"""As-of and range joins of time series, as unions and windows: no nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, values: list[str], by: tuple = ("symbol",), on: str = "ts") -> DataFrame:
    """Left rows with the last right values at or before each time. Right stamps win ties; one shuffle by key.

    ``values`` must not be columns of ``left``.
    """
    a = left.select("*", *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values], F.lit(1).alias("side__"))
    b = right.select(*by, on, *values, F.lit(0).alias("side__"))
    w = Window.partitionBy(*by).orderBy(on, "side__")
    rows = a.unionByName(b, allowMissingColumns=True)
    found = {v: F.last(v, ignorenulls=True).over(w) for v in values}
    return rows.withColumns(found).where("side__ = 1").drop("side__")


def htf_align(base: DataFrame, htf: DataFrame, value: str, seconds: int, key: str = "close_time") -> DataFrame:
    """Coarse values on fine bars: known when the coarse bar closes, or from its label on (``key='label'``, which looks ahead)."""
    ts = F.col("ts") if key == "label" else F.timestamp_seconds(F.unix_seconds("ts") + seconds)
    return asof(base, htf.select("symbol", ts.alias("ts"), F.col(value).alias(f"htf_{value}")), [f"htf_{value}"])


def macro_align(base: DataFrame, slow: DataFrame, keys: list[str], seconds: int = 30 * 86400) -> DataFrame:
    """One column for each key of a long (key, ts, value) table, as of each bar; a key without rows gives nulls.

    There is no key to partition by, so time is cut into stretches of ``seconds``: each is one window, and what
    stretches before it left over is carried in through a table of one row a stretch.
    """
    wide = slow.where(F.col("key").isin(keys)).groupBy("ts").pivot("key", keys).agg(F.first("value"))
    a = base.select("*", *[F.lit(None).cast(wide.schema[k].dataType).alias(k) for k in keys], F.lit(1).alias("side__"))
    rows = a.unionByName(wide.withColumn("side__", F.lit(0)), allowMissingColumns=True).withColumn("stretch__", F.floor(F.unix_seconds("ts") / seconds))
    carry = Window.orderBy("stretch__").rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch of time
    ends = rows.groupBy("stretch__").agg(*[F.max_by(F.col(f"`{k}`"), F.when(F.col(f"`{k}`").isNotNull(), F.col("ts"))).alias(k) for k in keys])
    ends = ends.select("stretch__", *[F.last(F.col(f"`{k}`"), ignorenulls=True).over(carry).alias(f"{k}__before") for k in keys])
    w = Window.partitionBy("stretch__").orderBy("ts", "side__")
    rows = rows.withColumns({k: F.last(F.col(f"`{k}`"), ignorenulls=True).over(w) for k in keys}).where("side__ = 1").join(ends, "stretch__", "left")
    return rows.withColumns({k: F.coalesce(F.col(f"`{k}`"), F.col(f"`{k}__before`")) for k in keys}).drop("side__", "stretch__", *[f"{k}__before" for k in keys])


def macro_align_by_symbol(base: DataFrame, slow: DataFrame, keys: list[str]) -> DataFrame:
    """As ``macro_align`` for many symbols: distinct times are aligned once, then joined to bars, so no stretch holds all bars."""
    times = base.select("ts").distinct()
    return base.join(macro_align(times, slow, keys), "ts", "left")


def macro_enrich(base: DataFrame, slow: DataFrame, keys: list[str], high: str, low: str) -> DataFrame:
    """Aligned series and the ratio of two of them."""
    return macro_align_by_symbol(base, slow, keys).withColumn("credit_spread", F.try_divide(high, low))


def futures_enrich(bars: DataFrame, extra: DataFrame, values: list[str], mode: str = "exact") -> DataFrame:
    """Left join on equal times, then carried forward (stamps off the grid are lost); ``mode='asof'`` loses none."""
    if mode == "asof":
        return asof(bars, extra, values)
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = bars.join(extra.select("symbol", "ts", *values), ["symbol", "ts"], "left")
    return rows.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})


def reference_join(bars: DataFrame, pairs: DataFrame, max_null: float = 0.5) -> DataFrame:
    """Close of each symbol's reference as of each bar; pairs with too few values go."""
    want = bars.join(pairs, "symbol")
    ref = pairs.join(bars.select(F.col("symbol").alias("reference"), "ts", F.col("close").alias("ref_close")), "reference").select("symbol", "reference", "ts", "ref_close")
    rows = asof(want, ref, ["ref_close"], by=("symbol", "reference"))
    share = F.avg(F.col("ref_close").isNull().cast("double")).over(Window.partitionBy("symbol", "reference"))
    return rows.withColumn("null_share", share).where(F.col("null_share") <= max_null).drop("null_share")


def forward_asof(signals: DataFrame, bars: DataFrame, ahead: int, seconds: int = 86400) -> DataFrame:
    """First bar at or after each signal time: its time and close, and the close ``ahead`` bars later; null without such a bar.

    Each stretch of ``seconds`` of a symbol is one window that runs backwards in time, so a row finds its bar among those
    before it. The first bar after a stretch comes from a table of one row a stretch.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    exits = bars.where("symbol is not null and ts is not null").select("symbol", "ts", "close", F.lead("close", ahead).over(w).alias("exit"))
    b = exits.select("symbol", "ts", F.struct(F.col("ts").alias("bar_ts"), F.col("close").alias("entry"), "exit").alias("bar"), F.lit(1).alias("side__"))
    rows = signals.select("symbol", "ts", F.lit(None).cast(b.schema["bar"].dataType).alias("bar"), F.lit(0).alias("side__")).union(b)
    rows = rows.withColumn("stretch__", F.floor(F.unix_seconds("ts") / seconds))
    at = F.col("bar.bar_ts")
    firsts = rows.groupBy("symbol", "stretch__").agg(F.min(at).alias("bar_ts"), F.min_by("bar.entry", at).alias("entry"), F.min_by("bar.exit", at).alias("exit"))
    after = Window.partitionBy("symbol").orderBy(F.desc("stretch__")).rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch of time
    first = F.when(F.col("bar_ts").isNotNull(), F.struct("bar_ts", "entry", "exit"))
    firsts = firsts.where("symbol is not null and stretch__ is not null").select("symbol", "stretch__", F.last(first, ignorenulls=True).over(after).alias("later__"))
    back = Window.partitionBy("symbol", "stretch__").orderBy(F.desc("ts"), F.desc("side__")).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("bar", F.last("bar", ignorenulls=True).over(back)).where("side__ = 0").join(firsts, ["symbol", "stretch__"], "left")
    return found.withColumn("bar", F.coalesce("bar", "later__")).select("symbol", "ts", "bar.bar_ts", "bar.entry", "bar.exit")


#: Ranges that each row is compared with one by one; above, rows and ranges meet by bins.
FEW_RANGES = 64
#: Binned ranges of this many ranges go to all tasks; above, both sides are shuffled by bin.
MOST_RANGES = 100_000
#: A range covers at most 2 ** SPREAD + 1 bins.
SPREAD = 4


def _place(df: DataFrame, column: str, timed: bool) -> Column:
    """A time in microseconds, a date in days, a whole number as it is."""
    kind = dict(df.dtypes)[column]
    if timed:
        return F.unix_micros(F.col(column).cast("timestamp"))
    if kind == "date":
        return F.unix_date(column)
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{column} is {kind}: ranges are of whole numbers, dates or times")
    return F.col(column).cast("long")


def range_join(rows: DataFrame, ranges: DataFrame, at: str, low: str = "start", high: str = "end") -> DataFrame:
    """Rows with each range [low, high) that holds ``at``; columns of both. Null places, null bounds and empty ranges meet nothing.

    A few ranges are compared one by one. More meet by bins: a range lies at a level, the power of two next to its
    length, and covers at most 17 bins of a sixteenth of that; a row has one bin at each level that occurs, of 64 at
    most. So a pair meets in one bin alone, long ranges don't burden short ones, and a crowded bin is an ordinary hot
    join key, which adaptive execution splits.
    """
    n = ranges.limit(MOST_RANGES + 1).count()
    inside = (F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))
    if n <= FEW_RANGES:
        return rows.join(F.broadcast(ranges), inside)
    timed = any("timestamp" in dict(df.dtypes)[c] for df, c in ((rows, at), (ranges, low), (ranges, high)))
    first, last = _place(ranges, low, timed), _place(ranges, high, timed) - 1
    length = _place(ranges, high, timed).cast("double") - _place(ranges, low, timed).cast("double")
    level = F.greatest(F.lit(0), F.ceil(F.log2(length)).cast("int") - SPREAD)
    binned = ranges.where(F.col(low) < F.col(high)).withColumn("level__", level)
    levels = [r[0] for r in binned.select("level__").distinct().collect()]  # 64 at most
    bins = F.sequence(F.call_function("shiftright", first, F.col("level__")), F.call_function("shiftright", last, F.col("level__")))
    binned = binned.withColumn("bin__", F.explode(bins))
    if n <= MOST_RANGES:
        binned = F.broadcast(binned)
    placed = rows.withColumn("level__", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    placed = placed.withColumn("bin__", F.call_function("shiftright", _place(rows, at, timed), F.col("level__")))
    return placed.join(binned, ["level__", "bin__"]).where(inside).drop("level__", "bin__")


def period_range_join(rows: DataFrame, periods: DataFrame, at: str = "ts") -> DataFrame:
    """Rows inside named periods [start, end), however many there are."""
    return range_join(rows, periods, at)


def fold_range_join(rows: DataFrame, folds: DataFrame, at: str = "t") -> DataFrame:
    """Rows in each fold's in-sample or out-of-sample range, with ``part``; a row in both is out of sample."""
    t = F.col(at)
    inside = ((t >= F.col("is_start")) & (t < F.col("is_end"))) | ((t >= F.col("oos_start")) & (t < F.col("oos_end")))
    hull = folds.withColumns({"low__": F.least("is_start", "oos_start"), "high__": F.greatest("is_end", "oos_end")})
    met = range_join(rows, hull, at, "low__", "high__").where(inside).drop("low__", "high__")
    return met.withColumn("part", F.when(t >= F.col("oos_start"), "oos").otherwise("is"))
