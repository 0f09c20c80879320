"""Checks, repairs and filters of bar tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arithmetic import quotient


def W():
    return Window.partitionBy("symbol").orderBy("ts")

ISSUE = "symbol string, severity string, issue_type string, ts timestamp, description string, affected_rows long"
SEVERITY = {"error": 0, "warning": 1, "info": 2}


def _issues(rows: DataFrame, severity: str, kind: str, text: str, ts: str = "ts", n: str = "n") -> DataFrame:
    return rows.select("symbol", F.lit(severity).alias("severity"), F.lit(kind).alias("issue_type"), F.col(ts).alias("ts"), F.lit(text).alias("description"), F.col(n).cast("long").alias("affected_rows"))


def schema_issues(bars: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """One row for each missing or wrongly typed column."""
    kinds = dict(bars.dtypes)
    found = [("missing" if c not in kinds else "type", c) for c, k in wanted.items() if kinds.get(c) != k]
    return bars.sparkSession.createDataFrame(found, "issue string, column_name string")


def timestamp_issues(rows: DataFrame, now: Column, arrival: str) -> DataFrame:
    """Repeated, future and out-of-order stamps."""
    twice = rows.groupBy("symbol", "ts").count().where("count > 1").groupBy("symbol").agg(F.count("*").alias("n"), F.min("ts").alias("ts"))
    later = rows.where(F.col("ts") > now).groupBy("symbol").agg(F.count("*").alias("n"), F.min("ts").alias("ts"))
    back = rows.withColumn("p", F.lag("ts").over(Window.partitionBy("symbol").orderBy(arrival))).where("ts < p").groupBy("symbol").agg(F.count("*").alias("n"), F.min("ts").alias("ts"))
    return _issues(twice, "error", "duplicate_timestamps", "repeated timestamps").union(_issues(later, "error", "future_timestamps", "timestamps in the future")).union(_issues(back, "warning", "unordered", "rows arrive out of order"))


def ohlc_issues(bars: DataFrame) -> DataFrame:
    """High below open or close, low above them, negative volume: counts and first time, in one pass."""
    bad = {
        "high_too_low": F.col("high") < F.greatest("open", "close"),
        "low_too_high": F.col("low") > F.least("open", "close"),
        "negative_volume": F.col("volume") < 0,
    }
    one = bars.groupBy("symbol").agg(*[F.count_if(c).alias(f"n_{k}") for k, c in bad.items()], *[F.min(F.when(c, F.col("ts"))).alias(f"t_{k}") for k, c in bad.items()])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("n"), F.col(f"t_{k}").alias("ts")) for k in bad]))
    return one.select("symbol", each.alias("x")).select("symbol", "x.kind", "x.n", "x.ts").where("n > 0")


def zero_volume(bars: DataFrame, limit: float = 0.01) -> DataFrame:
    share = bars.groupBy("symbol").agg(F.avg(F.when(F.col("volume") == 0, 1.0).otherwise(0.0)).alias("share"))
    return share.withColumn("warn", F.col("share") > limit)


def outliers(bars: DataFrame, limit: float = 0.5) -> DataFrame:
    rows = bars.withColumn("change", F.col("close") / F.lag("close").over(W()) - 1)
    return rows.where(F.abs("change") > limit).select("symbol", "ts", "change")


def gaps(bars: DataFrame, step: int, ignore_weekends: bool = False) -> DataFrame:
    """Breaks of more than 1.5 steps: start, end, seconds, missing bars."""
    rows = bars.select("symbol", "ts", F.lag("ts").over(W()).alias("gap_start"))
    rows = rows.withColumn("duration_s", F.unix_seconds("ts") - F.unix_seconds("gap_start")).where(F.col("duration_s") > 1.5 * step)
    if ignore_weekends:
        rows = rows.where(~F.weekday("gap_start").isin(4, 5))
    return rows.select("symbol", "gap_start", F.col("ts").alias("gap_end"), "duration_s", (F.floor(F.col("duration_s") / step) - 1).alias("missing"))


def fill_gaps(bars: DataFrame, step: int, mode: str = "ffill") -> DataFrame:
    """All steps from first to last bar; new ones carry prices with volume 0 (``ffill``) or are null (``mark``)."""
    span = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("z")).select("symbol", F.explode(F.sequence("a", "z", F.expr(f"INTERVAL {step} SECONDS"))).alias("ts"))
    rows = span.join(bars, ["symbol", "ts"], "left").withColumn("added", F.col("close").isNull())
    if mode == "ffill":
        for c in ("open", "high", "low", "close"):
            rows = rows.withColumn(c, F.last(c, ignorenulls=True).over(W()))
        rows = rows.withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    return rows


def quality_report(bars: DataFrame, step: int) -> DataFrame:
    """Completeness, valid and zero-volume shares, range and gaps of each symbol."""
    valid = (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close")) & (F.col("volume") >= 0)
    rows = bars.groupBy("symbol").agg(
        F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        (100 * F.avg(valid.cast("double"))).alias("valid_pct"), (100 * F.avg((F.col("volume") == 0).cast("double"))).alias("zero_pct"),
    )
    want = (F.unix_seconds("last_ts") - F.unix_seconds("first_ts")) / step + 1
    g = gaps(bars, step).groupBy("symbol").agg(F.count("*").alias("n_gaps"), F.sum("missing").alias("missing"))
    return rows.withColumn("complete_pct", 100 * F.col("n_rows") / want).join(g, "symbol", "left").fillna(0, ["n_gaps", "missing"])


def by_severity(issues: DataFrame) -> DataFrame:
    order = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col("severity")]
    return issues.orderBy(order, "symbol", "issue_type", "ts")


def month_bounds(rows: DataFrame, period: str = "period") -> DataFrame:
    """Rows outside the calendar month that their partition names."""
    return rows.where(F.date_trunc("month", "ts") != F.to_timestamp(F.concat(F.col(period), F.lit("-01")), "yyyy-MM-dd"))


def partition_audit(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each partition with its data's years and the reason to quarantine it, if any."""
    p = rows.groupBy(*keys, "period").agg(F.year(F.min("ts")).alias("y0"), F.year(F.max("ts")).alias("y1"), F.count("*").alias("n_rows"))
    named = F.substring("period", 1, 4).cast("int")
    reason = F.when((F.col("y0") < 2000) | (F.col("y1") > 2100), "year_out_of_range").when((F.col("y0") != named) | (F.col("y1") != named), "year_mismatch")
    return p.withColumn("reason", reason)


def cross_validate(ours: DataFrame, native: DataFrame) -> DataFrame:
    """Largest differences on shared times, and whether they pass: prices within 0.01 %, volume within 1e-9.

    A percentage of a native 0 is NaN where ours is 0 too, which agrees and may pass, and infinite where it isn't, which fails.
    """
    prices = ("open", "high", "low", "close")
    a, b = ({c: F.col(f"{side}.{c}") for c in (*prices, "volume")} for side in "ab")
    pct = {c: quotient(F.abs(a[c] - b[c]), b[c]) * 100 for c in prices}
    worst = [F.max(pct[c]).alias(f"{c}_pct") for c in prices]
    apart = [F.max(F.when((a[c] == 0) & (b[c] == 0), 0.0).otherwise(pct[c])).alias(f"{c}__") for c in prices]
    rows = ours.alias("a").join(native.alias("b"), ["symbol", "ts"]).groupBy("symbol").agg(F.count("*").alias("n_rows"), *worst, F.max(F.abs(a["volume"] - b["volume"])).alias("volume_diff"), *apart)
    return rows.withColumn("passed", (F.greatest(*[f"{c}__" for c in prices]) <= 0.01) & (F.col("volume_diff") <= 1e-9)).drop(*[f"{c}__" for c in prices])


def trim_partial_head(bars: DataFrame, step: int) -> DataFrame:
    """Drop bars before the first whole bucket of a coarser step."""
    first = F.min("ts").over(Window.partitionBy("symbol"))
    return bars.withColumn("whole", F.ceil(F.unix_seconds(first) / step) * step).where(F.unix_seconds("ts") >= F.col("whole")).drop("whole")


def warmup_trim(bars: DataFrame, warmups: DataFrame) -> DataFrame:
    """Drop the longest warm-up (bars times step seconds) from each symbol's start."""
    longest = warmups.agg(F.max(F.col("n_bars") * F.col("seconds")).alias("warm"))  # one row
    first = F.min("ts").over(Window.partitionBy("symbol"))
    return bars.withColumn("first__", first).crossJoin(F.broadcast(longest)).where(F.unix_seconds("ts") >= F.unix_seconds("first__") + F.col("warm")).drop("first__", "warm")


def recent_months(bars: DataFrame, n: int) -> DataFrame:
    last = F.max("ts").over(Window.partitionBy("symbol"))
    return bars.withColumn("last__", last).where(F.col("ts") >= F.add_months(F.to_date("last__"), -n).cast("timestamp")).drop("last__")


def holdout_split(bars: DataFrame, days: int) -> DataFrame:
    """``part``: holdout for the last days of each symbol, train before; to be used before any resampling."""
    last = F.max("ts").over(Window.partitionBy("symbol"))
    return bars.withColumn("part", F.when(F.unix_seconds("ts") > F.unix_seconds(last) - 86400 * days, "holdout").otherwise("train"))


def is_oos_split(rows: DataFrame, share: float = 0.7, least_is: int = 50, least_oos: int = 20) -> DataFrame:
    """``part`` by place in the series; symbols too short for both parts go."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    cut = F.floor(n * share)
    rows = rows.withColumn("n__", n).withColumn("part", F.when(F.row_number().over(W()) <= cut, "is").otherwise("oos"))
    return rows.where((F.floor(F.col("n__") * share) >= least_is) & (F.col("n__") - F.floor(F.col("n__") * share) >= least_oos)).drop("n__")


def maturity_filter(space: DataFrame, maturity: DataFrame, levels: list[str]) -> DataFrame:
    """Search dimensions of given maturity; unlisted ones are experimental."""
    return space.join(maturity, "indicator", "left").withColumn("maturity", F.coalesce("maturity", F.lit("experimental"))).where(F.col("maturity").isin(levels))


def finalist_gate(metrics: DataFrame, max_pbo: float, least_folds: int, max_decay: float = 3.0) -> DataFrame:
    return metrics.where((F.col("pbo") < max_pbo) & (F.col("profitable_folds") >= least_folds) & (F.abs("degradation") < max_decay))
