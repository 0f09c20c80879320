"""Predictive-edge statistics: information coefficients, hit rates, persistence, false-discovery control.

A scored table has one row for each bar, configuration and horizon: the signal
(0 or 1) and the forward return. Signals are computed once and horizons are
exploded, so nothing is computed again for another horizon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats_udf as udf
from tidemark.operators import ranks


def W():
    return Window.partitionBy("symbol").orderBy("ts")


def forward_returns(bars: DataFrame, horizons: list[int], short: bool = False, keep: tuple = ()) -> DataFrame:
    """symbol, ts, horizon, fwd (null at the end of a series)."""
    sign = -1 if short else 1
    bars = bars.withColumns({f"f{h}__": sign * (F.lead("close", h).over(W()) / F.col("close") - 1) for h in horizons})
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"f{h}__").alias("fwd")) for h in horizons]))
    return bars.select("symbol", "ts", *keep, each.alias("x")).select("symbol", "ts", *keep, "x.horizon", "x.fwd")


def spearman(rows: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """keys, ic, n: rank correlation of two columns in each group (``ranks.signal_correlation`` is the one for 0-1 signals)."""
    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    rows = ranks.average_ranks(ranks.average_ranks(rows, "rx__", x, *keys), "ry__", y, *keys)
    return rows.groupBy(*keys).agg(F.corr("rx__", "ry__").alias("ic"), F.count("*").alias("n"))


def split_by_place(rows: DataFrame, share: float = 0.6, *keys: str) -> DataFrame:
    """``part``: train up to ``share`` of all bars by row number over rows with a return, validation after."""
    w = Window.partitionBy(*keys).orderBy("ts")
    all_ = Window.partitionBy(*keys)
    rows = rows.withColumn("cut__", F.floor(F.count("*").over(all_) * share)).where("fwd is not null")
    return rows.withColumn("part", F.when(F.row_number().over(w) <= F.col("cut__"), "train").otherwise("validation")).drop("cut__")


def information_coefficient(scored: DataFrame, least: int = 30, least_signals: int = 3, keys: tuple = ("symbol", "horizon")) -> DataFrame:
    """Spearman correlation of signal and forward return, by train and validation part."""
    parts = split_by_place(scored, 0.6, *keys)
    ic = ranks.signal_correlation(parts, "signal", "fwd", *keys, "part")
    return ic.where((F.col("n") >= least) & (F.col("n_signals") >= least_signals) & F.col("ic").isNotNull())


def ic_p_value(ic: str = "ic", n: str = "n") -> Column:
    """Two-sided p of a rank correlation of n rows, by Student's t."""
    t = F.col(ic) * F.sqrt((F.col(n) - 2) / (1 - F.col(ic) * F.col(ic)))
    return 2 * udf.t_sf(F.abs(t), (F.col(n) - 2).cast("double"))


def edge_stats(scored: DataFrame, bars_per_month: float, keys: tuple = ("symbol", "horizon")) -> DataFrame:
    """Hit rate, mean return with and without the signal, their difference, frequency (a month at least) and ratio.

    The ratio weighs mean gains by the hit rate against mean losses by the miss rate; null without both.
    """
    on, win = F.col("signal") == 1, F.col("fwd") > 0
    rows = scored.where("fwd is not null").groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(on).alias("n_signals"), F.avg(F.when(on, win.cast("double"))).alias("hit_rate"),
        F.avg(F.when(on, F.col("fwd"))).alias("mean_on"), F.avg(F.when(~on, F.col("fwd"))).alias("mean_off"),
        F.avg(F.when(on & win, F.col("fwd"))).alias("gain__"), F.avg(F.when(on & ~win, F.col("fwd"))).alias("loss__"),
    )
    ratio = F.try_divide(F.col("hit_rate") * F.col("gain__"), (1 - F.col("hit_rate")) * F.abs("loss__"))
    return rows.withColumns({"edge": F.col("mean_on") - F.col("mean_off"), "per_month": F.col("n_signals") / F.greatest(F.col("n") / bars_per_month, F.lit(1.0)), "edge_ratio": ratio}).drop("gain__", "loss__")


def ic_stability(scored: DataFrame, size: int, least_signals: int = 5, least_windows: int = 3, keys: tuple = ("symbol", "horizon")) -> DataFrame:
    """Coefficients of consecutive whole windows of ``size`` rows: share above 0, mean, population deviation, 2.5 and 97.5 percentiles.

    Windows with fewer than ``least_signals`` signals or none that varies don't count; series with fewer than ``least_windows`` that count give no row.
    """
    w = Window.partitionBy(*keys).orderBy("ts")
    rows = scored.where("fwd is not null").withColumn("block", F.floor((F.row_number().over(w) - 1) / size))
    ic = ranks.signal_correlation(rows, "signal", "fwd", *keys, "block").where(f"n = {size} and n_signals >= {least_signals} and ic is not null")
    out = ic.groupBy(*keys).agg(F.count("*").alias("n_windows"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"), F.avg("ic").alias("mean_ic"), F.stddev_pop("ic").alias("sd_ic"), F.percentile("ic", 0.025).alias("lo"), F.percentile("ic", 0.975).alias("hi"))
    return out.where(F.col("n_windows") >= least_windows)


def config_average(ics: DataFrame, keys: tuple, config: str = "config") -> DataFrame:
    """Over configurations: mean, share above 0, best with its coefficient (``best_only``: it alone is above 0), deviation, one-sample t and two-sided p."""
    rows = ics.groupBy(*keys).agg(F.avg("ic").alias("mean_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"), F.max_by(config, F.struct("ic", config)).alias("best"), F.max("ic").alias("best_ic"), F.count_if(F.col("ic") > 0).alias("above__"), F.stddev_samp("ic").alias("sd_ic"), F.count("*").alias("n_configs"))
    rows = rows.withColumn("t", F.try_divide(F.col("mean_ic"), F.col("sd_ic") / F.sqrt("n_configs")))
    return rows.withColumns({"p": 2 * udf.t_sf(F.abs("t"), (F.col("n_configs") - 1).cast("double")), "best_only": (F.col("above__") == 1) & (F.col("n_configs") > 1)}).drop("above__")


def finalists(ics: DataFrame, horizon: int, least_ic: float = 0.02, least_positive: float = 0.5, alpha: float = 0.1, config: str = "config") -> DataFrame:
    """Configurations that hold out of sample at one horizon: mean IC above ``least_ic``, share of assets above 0 over ``least_positive``, and one false-discovery-controlled test at least.

    ``ics`` has ``config``, symbol, horizon, ic and n of validation parts; the control runs over all of them at that horizon.
    """
    at = ics.where(F.col("horizon") == horizon).withColumn("p", ic_p_value())
    flagged = ranks.false_discoveries(at, "p", alpha)
    out = flagged.groupBy(config).agg(F.avg("ic").alias("mean_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"), F.count_if("significant").alias("n_significant"), F.countDistinct("symbol").alias("n_assets"))
    return out.where((F.col("mean_ic") > least_ic) & (F.col("positive") > least_positive) & (F.col("n_significant") > 0))


def fdr_bh(tests: DataFrame, p: str, alpha: float, *keys: str) -> DataFrame:
    """Benjamini-Hochberg: ``significant`` up to the last p that lies under its line; none if none does."""
    return ranks.false_discoveries(tests, p, alpha, *keys)


def baseline(bars: DataFrame, horizons: list[int]) -> DataFrame:
    """Mean return over each horizon from entries at every max(horizon, 10)th bar: (horizon, baseline)."""
    n = F.row_number().over(W()) - 1
    rows = forward_returns(bars.withColumn("n__", n), horizons, keep=("n__",)).where("fwd is not null")
    return rows.where(F.pmod("n__", F.greatest("horizon", F.lit(10))) == 0).groupBy("horizon").agg(F.avg("fwd").alias("baseline"))


def persistence(entries: DataFrame, base: DataFrame, least: int = 5) -> DataFrame:
    """Mean, median, hit rate, t and two-sided p of returns from entry to exit by horizon, beside the baseline (see there); horizons with fewer than ``least`` entries give no row."""
    r = F.col("exit") / F.col("entry") - 1
    rows = entries.where("entry > 0").withColumn("r", r).where("r is not null").groupBy("horizon").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.median("r").alias("median"), F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"), F.stddev_samp("r").alias("sd")).where(F.col("n") >= least)
    rows = rows.withColumn("t", F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n")))
    rows = rows.withColumn("p", F.coalesce(2 * udf.t_sf(F.abs("t"), (F.col("n") - 1).cast("double")), F.lit(1.0)))
    return rows.join(base, "horizon", "left").withColumn("excess", F.col("mean") - F.col("baseline"))


def half_life(decay: DataFrame, *keys: str) -> DataFrame:
    """First horizon at which the excess is below half of its peak (null if it never is), for groups whose peak is above 0."""
    rows = decay.withColumn("peak", F.max("excess").over(Window.partitionBy(*keys))).where("peak > 0")
    return rows.groupBy(*keys).agg(F.first("peak").alias("peak"), F.min(F.when(F.col("excess") < F.col("peak") / 2, F.col("horizon"))).alias("half_life"))


def exposure_returns(bars: DataFrame) -> DataFrame:
    """Yesterday's signal times today's log return, and the log return itself."""
    r = F.ln(F.col("close") / F.lag("close").over(W()))
    pos = F.coalesce(F.lag(F.col("signal").cast("double")).over(W()), F.lit(0.0))
    return bars.withColumns({"log_ret": r, "position": pos}).where("log_ret is not null").withColumn("ret", F.col("position") * F.col("log_ret"))


def exposure_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Cumulative return, Sharpe and Sortino a bar, time in market, mean in and out."""
    on = F.col("position") > 0
    out = rows.groupBy(*keys).agg(F.sum("ret").alias("total"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))).alias("d"), F.avg("position").alias("in_market"), F.avg(F.when(on, F.col("log_ret"))).alias("mean_in"), F.avg(F.when(~on, F.col("log_ret"))).alias("mean_out"))
    return out.withColumns({"sharpe": F.try_divide("m", "s"), "sortino": F.try_divide("m", "d")}).drop("m", "s", "d")


def regime_metrics(rows: DataFrame, least: int = 20) -> DataFrame:
    """``exposure_metrics`` by market phase and for all bars, beside those of holding; phases of fewer than ``least`` bars give no row."""
    each = rows.withColumn("regime", F.explode(F.array(F.col("phase"), F.lit("all"))))
    held = each.groupBy("regime").agg(F.count("*").alias("n_bars"), F.sum("log_ret").alias("hold_total"), F.try_divide(F.avg("log_ret"), F.stddev_samp("log_ret")).alias("hold_sharpe")).where(F.col("n_bars") >= least)
    return exposure_metrics(each, "regime").join(held, "regime").withColumn("better", F.col("total") > F.col("hold_total"))
