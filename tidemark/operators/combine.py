"""Regimes, combination of signals into strategies, and their exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import windows as win
from tidemark.operators.asof import asof
from tidemark.operators.bars import resample
from tidemark.operators.windows import W, lag, last_n
from tidemark.functions.timeframes import seconds

#: A signal parameter and its opposite.
OPPOSITES = {"bullish": "bearish", "long": "short", "above": "below", "oversold": "overbought", "up": "down"}
#: Timeframes from fine to coarse, for steps up.
LADDER = ("1m", "3m", "5m", "15m", "30m", "45m", "1h", "4h", "1d", "1w", "1M")
#: Limits of a window's return (%), drawdown (%) and annualised volatility by market.
WINDOW_PRESETS = {"crypto": {"trend": 30.0, "crash": -40.0, "high_vol": 1.0}, "stocks": {"trend": 10.0, "crash": -20.0, "high_vol": 0.30}}


def bar_regime(bars: DataFrame, crash: float = 10.0, high_vol: float = 90.0, trend: float = 25.0, n_adx: int = 14, n_vol: int = 100, n_fall: int = 24) -> DataFrame:
    """First of crash, high_vol, trend_up, trend_down that holds, else range.

    Crash: the close is ``crash`` percent or more under the highest of it and the ``n_fall`` before.
    High volatility: the deviation of log returns over ``n_vol`` bars is at or above the ``high_vol``
    percentile of its last ``n_vol`` values (0 while they are too few). Trends: ADX above ``trend``,
    close above or below its average of 50.
    """
    n = F.row_number().over(W())
    u, d = F.col("high") - lag("high"), lag("low") - F.col("low")
    rows = bars.withColumns({"at__": n, "tr__": F.when(n > 1, win.true_range()), "pd__": F.when(n > 1, F.when((u > d) & (u > 0), u).otherwise(0.0)), "md__": F.when(n > 1, F.when((d > u) & (d > 0), d).otherwise(0.0)), "ret__": F.coalesce(F.ln(F.col("close") / lag("close")), F.lit(0.0))})
    rows = win.linear_scans(rows, {"e__": ("close", 2 / 51, 1)} | {f"w{c}__": (f"{c}__", 1 / n_adx, n_adx) for c in ("tr", "pd", "md")})
    p, m = (F.coalesce(F.when(F.col("wtr__") > 0, 100 * F.col(x) / F.col("wtr__")), F.lit(0.0)) for x in ("wpd__", "wmd__"))
    rows = rows.withColumns({"p__": p, "m__": m})
    dx = F.when(F.col("p__") + F.col("m__") > 0, 100 * F.abs(F.col("p__") - F.col("m__")) / (F.col("p__") + F.col("m__"))).otherwise(0.0)
    rows = win.linear_scan(rows.withColumn("dx__", F.when(F.col("at__") > n_adx, dx)), "adx__", "dx__", 1 / n_adx, n_adx + 1)
    rows = rows.withColumns({"vol__": F.coalesce(win.rolling_std("ret__", n_vol, ddof=0), F.lit(0.0)), "fall__": F.when(F.col("at__") > n_fall, 1 - F.col("close") / F.max("close").over(last_n(n_fall + 1)))})
    rows = win.pct_rank(rows, "rank__", "vol__", n_vol)
    strong, c, e = F.col("adx__") > trend, F.col("close"), F.col("e__")
    regime = F.when(F.col("fall__") >= crash / 100, "crash").when(F.col("rank__") * 100 >= high_vol, "high_vol").when(strong & (c > e), "trend_up").when(strong & (c < e), "trend_down").otherwise("range")
    return rows.withColumn("regime", regime).drop(*[x for x in rows.columns if x.endswith("__")])


def window_regime(rows: DataFrame, market: str = "crypto", bars_a_year: float = 252 * 6) -> DataFrame:
    """Regime of each (symbol, window_start): first of crash (drawdown), trend_up, trend_down (return), high_vol (annualised log volatility), else range; range under ten bars.

    ret and dd are percents, dd is 0 or below; limits are those of ``WINDOW_PRESETS``.
    """
    limit = WINDOW_PRESETS[market]
    w = win.Window.partitionBy("symbol", "window_start").orderBy("ts")
    rows = rows.withColumns({"r__": F.ln(F.col("close") / F.lag("close").over(w)), "dd__": (F.col("close") / F.max("close").over(w.rowsBetween(win.Window.unboundedPreceding, 0)) - 1) * 100})
    out = rows.groupBy("symbol", "window_start").agg(F.count("*").alias("n"), ((F.max_by("close", "ts") / F.min_by("close", "ts") - 1) * 100).alias("ret"), F.min("dd__").alias("dd"), (F.stddev_samp("r__") * bars_a_year**0.5).alias("vol"))
    regime = F.when(F.col("n") < 10, "range").when(F.col("dd") < limit["crash"], "crash").when(F.col("ret") > limit["trend"], "trend_up").when(F.col("ret") < -limit["trend"], "trend_down").when(F.col("vol") > limit["high_vol"], "high_vol").otherwise("range")
    return out.withColumn("regime", regime)


def market_phase(bars: DataFrame, ahead: int = 126, up: float = 0.5, down: float = -0.3) -> DataFrame:
    """Label by the return to come, sideways where there is none: for labels only, it looks ahead by design."""
    f = F.lead("close", ahead).over(W()) / F.col("close") - 1
    return bars.withColumn("phase", F.when(f > up, "bull").when(f < down, "bear").otherwise("sideways"))


def combine_exclusive(signals: DataFrame, least: int = 1, *keys: str) -> DataFrame:
    """All exclusive signals and at least ``least`` optional ones; disabled ones don't count; without optional ones the first part decides."""
    ex, op = F.col("state") == "exclusive", F.col("state") == "optional"
    rows = signals.groupBy("symbol", "ts", *keys).agg(F.coalesce(F.bool_and(F.when(ex, F.col("signal"))), F.lit(True)).alias("a"), F.count_if(op).alias("n"), F.count_if(op & F.col("signal")).alias("k"))
    return rows.select("symbol", "ts", *keys, (F.col("a") & ((F.col("n") == 0) | (F.col("k") >= least))).alias("signal"))


def combine_majority(signals: DataFrame, least: int | None = None, *keys: str) -> DataFrame:
    """At least half (rounded up) of the signals in use, or ``least``."""
    rows = signals.where("state <> 'disabled'").groupBy("symbol", "ts", *keys).agg(F.count_if("signal").alias("k"), F.count("*").alias("n"))
    need = F.lit(least) if least is not None else F.ceil(F.col("n") / 2)
    return rows.select("symbol", "ts", *keys, (F.col("k") >= need).alias("signal"))


def invert_params(configs: DataFrame, *columns: str) -> DataFrame:
    """Opposite direction or mode of each named parameter; values without an opposite stay."""
    both = OPPOSITES | {b: a for a, b in OPPOSITES.items()}
    to = F.create_map(*[F.lit(x) for kv in both.items() for x in kv])
    return configs.withColumns({c: F.coalesce(to[F.col(c)], F.col(c)) for c in columns})


def htf_filter(signals: DataFrame, bars: DataFrame, tf: str, long: bool = True) -> DataFrame:
    """Keep long signals while the last closed coarse bar rose, short ones while it didn't."""
    coarse = resample(bars, tf).select("symbol", F.timestamp_seconds(F.unix_seconds("ts") + seconds(tf)).alias("ts"), (F.col("close") > F.col("open")).alias("bull__"))
    rows = asof(signals, coarse, ["bull__"])
    ok = F.col("bull__") if long else ~F.col("bull__")
    return rows.withColumn("signal", F.coalesce(F.col("signal") & ok, F.lit(False))).drop("bull__")


def optional_range(exclusive: Column, optional: Column) -> list[Column]:
    """Least and most optional signals to require: 1 to 2 with two exclusive ones or more, 1 to 3 with one, 2 to 4 with none, within those there are."""
    lo = F.when(optional == 0, 0).when(exclusive == 0, F.least(F.lit(2), optional)).otherwise(1)
    hi = F.least(F.when(exclusive >= 2, 2).when(exclusive == 1, 3).otherwise(4), optional)
    return [lo.alias("lo"), hi.alias("hi")]


def resolve_timeframe(rows: DataFrame, base: str, steps: str) -> DataFrame:
    """The timeframe ``steps`` above ``base`` on the ladder, at most its top; the top too for an unknown base, unless there is no step."""
    ladder = F.array(*map(F.lit, LADDER))
    place = F.array_position(ladder, F.col(base))
    at = F.least(F.when(place == 0, len(LADDER)).otherwise(place + F.col(steps)), F.lit(len(LADDER)))
    return rows.withColumn("resolved", F.when(F.col(steps) == 0, F.col(base)).otherwise(F.element_at(ladder, at.cast("int"))))


def signal_export(signals: DataFrame) -> DataFrame:
    """Bars where something fires, with what does."""
    return signals.where("signal").groupBy("symbol", "ts").agg(F.array_join(F.array_sort(F.collect_list("indicator")), ",").alias("fired"))


def last_bar_signal(bars: DataFrame) -> DataFrame:
    """Entry on each symbol's last bar; exit if the bar before was on and the last is off."""
    rows = bars.withColumn("p__", F.coalesce(lag("signal"), F.lit(False)))
    return rows.groupBy("symbol").agg(F.max_by("signal", "ts").alias("entry"), F.max_by(F.col("p__") & ~F.col("signal"), "ts").alias("exit"))


def strategy_signals(specs: DataFrame, signals: DataFrame) -> DataFrame:
    """Specs with lists of indicators to one signal each: all of them on."""
    each = specs.select("spec", F.explode("entry").alias("indicator"))
    return each.join(signals, "indicator").groupBy("symbol", "ts", "spec").agg(F.bool_and("signal").alias("signal"))
