"""Entry and exit signals: each function takes bars and adds a BOOLEAN column ``signal``.

All but two are window expressions; recurrences are blocked scans. ``firestorm``
(bands that ratchet) and ``hurst`` (a regression in each window) run blocks of a
symbol in grouped maps. A slow column (funding, open interest, ratios, macro
series) is filled forward before its rule looks at it; one that bars lack gives
False everywhere. Parameters, their ranges and choices are in ``signal_params``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.operators import signal_params
from tidemark.operators import windows as win
from tidemark.operators.windows import ALL, W, lag, last_n

REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def signal(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    REGISTRY[f.__name__] = f
    return f


def register(name: str, f: Callable[..., DataFrame], schema: dict[str, tuple] | None = None) -> None:
    """Add a signal of one's own, with its parameters' schema (see ``signal_params.SCHEMAS``)."""
    REGISTRY[name] = f
    if schema is not None:
        signal_params.SCHEMAS[name] = schema


def compute(name: str, bars: DataFrame, **params) -> DataFrame:
    """A signal by name; an unknown name is a KeyError, an unknown choice a ValueError."""
    if name not in REGISTRY:
        raise KeyError(f"unknown signal {name!r}; there are {', '.join(sorted(REGISTRY))}")
    signal_params.check(name, params)
    return REGISTRY[name](bars, **params)


def _done(rows: DataFrame, raw: Column, hold: int = 1, warmup: int = 0) -> DataFrame:
    """Write ``signal`` and drop helper columns (their names end in __)."""
    rows = rows.withColumn("raw__", win.warm(raw, warmup) if warmup else F.coalesce(raw, F.lit(False)))
    rows = rows.withColumn("signal", win.hold_bars("raw__", hold))
    return rows.drop(*[c for c in rows.columns if c.endswith("__")])


def _filled(bars: DataFrame, name: str) -> DataFrame:
    """``x__``: a slow column with its nulls filled from the bars before."""
    return bars.withColumn("x__", F.last(F.col(name).cast("double"), ignorenulls=True).over(ALL()))


def _absent(bars: DataFrame, *names: str) -> DataFrame | None:
    return None if set(names) <= set(bars.columns) else bars.withColumn("signal", F.lit(False))


def _side(up: bool, a: Column, b: Column) -> Column:
    return a > b if up else a < b


# --- averages and oscillators


@signal
def ash(bars, length=9, smooth=3, mode="rsi", ma_type="ema", signal_mode="bullish"):
    """Bulls and bears smoothed twice; bullish while their distance lies between them and bulls don't fall."""
    d = F.col("close") - lag("close")
    if mode == "rsi":
        up, down = F.greatest(d, F.lit(0.0)), F.greatest(-d, F.lit(0.0))
    elif mode == "stochastic":
        up, down = F.col("close") - F.min("close").over(last_n(length)), F.max("close").over(last_n(length)) - F.col("close")
    else:
        up, down = F.greatest(F.col("high") - lag("high"), F.lit(0.0)), F.greatest(lag("low") - F.col("low"), F.lit(0.0))
    rows = bars.withColumns({"bu__": F.when(lag("close").isNull(), 0.0).otherwise(up) if mode != "stochastic" else up, "be__": F.when(lag("close").isNull(), 0.0).otherwise(down) if mode != "stochastic" else down})
    for n in (length, smooth):
        for c in ("bu__", "be__"):
            if ma_type == "ema":
                rows = win.ema(rows, c + "x__", c, n)
            else:
                rows = rows.withColumn(c + "x__", win.sma(c, n) if ma_type == "sma" else win.wma(c, n))
            rows = rows.drop(c).withColumnRenamed(c + "x__", c)
    u, e = F.col("bu__"), F.col("be__")
    diff = F.abs(u - e)
    return _done(rows, (diff > e) & ~(diff > u) & (u >= lag("bu__")) if signal_mode == "bullish" else diff > u)


@signal
def ssl_channel(bars, length=12, hold_bars=4, direction="long", level=False):
    """Averages of high and low change places by the last break of the close."""
    rows = win.linear_scans(bars, {"eh__": ("high", 2 / (length + 1), 1), "el__": ("low", 2 / (length + 1), 1)})
    state = win.last_state(F.when(F.col("close") > F.col("eh__"), 1).when(F.col("close") < F.col("el__"), -1))
    rows = rows.withColumn("s__", F.coalesce(state, F.lit(0)))
    rows = rows.withColumn("above__", F.when(F.col("s__") < 0, F.col("el__") > F.col("eh__")).otherwise(F.col("eh__") > F.col("el__")))
    above = F.col("above__") if direction == "long" else ~F.col("above__")
    if level:
        return _done(rows, above, hold_bars)
    return _done(rows, above & ~F.coalesce(lag(above), F.lit(False)), hold_bars)


@signal
def ssl_channel_low(bars, length=12, direction="long"):
    """The crossing that ends a position of that direction."""
    return ssl_channel(bars, length, 1, "short" if direction == "long" else "long")


def wavetrend_lines(bars, channel=9, average=12, ma=3):
    """wt1__ and wt2__."""
    rows = bars.withColumn("p__", (F.col("high") + F.col("low") + F.col("close")) / 3)
    rows = win.ema(rows, "esa__", "p__", channel).withColumn("dev__", F.abs(F.col("p__") - F.col("esa__")))
    rows = win.ema(rows, "de__", "dev__", channel)
    rows = rows.withColumn("ci__", F.when(F.col("de__") != 0, (F.col("p__") - F.col("esa__")) / (0.015 * F.col("de__"))).otherwise(0.0))
    rows = win.ema(rows, "wt1__", "ci__", average)
    return rows.withColumn("wt2__", F.avg("wt1__").over(last_n(ma)))


@signal
def wavetrend_reversal(bars, channel_len=9, average_len=12, ma_len=3, ob_level=60.0, os_level=-60.0, hold_bars=3, direction="long"):
    rows = wavetrend_lines(bars, channel_len, average_len, ma_len)
    a, b = F.col("wt1__"), F.col("wt2__")
    pa, pb = F.coalesce(lag("wt1__"), F.lit(0.0)), F.coalesce(lag("wt2__"), F.lit(0.0))
    return _done(rows, (a > b) & (pa <= pb) & (b <= os_level) if direction == "long" else (a < b) & (pa >= pb) & (b >= ob_level), hold_bars)


@signal
def wavetrend_divergence(bars, channel_len=9, average_len=12, ma_len=3, ob_level=60.0, os_level=-60.0, lookback_left=20, lookback_right=1, divergence_length=20, hold_bars=3, direction="long", compat=False):
    """Price and oscillator pivots diverge, or wt1 leaves its extreme. A pivot is known ``lookback_right`` bars later; ``compat`` writes it at the pivot."""
    rows, bullish, length = wavetrend_lines(bars, channel_len, average_len, ma_len), direction == "long", divergence_length
    pivot = win.pivot_low("wt2__", lookback_left, lookback_right) & (F.col("wt2__") <= os_level) if bullish else win.pivot_high("wt2__", lookback_left, lookback_right) & (F.col("wt2__") >= ob_level)
    price = "low" if bullish else "high"
    rows = rows.withColumn("v__", pivot)
    before = W().rowsBetween(Window.unboundedPreceding, -1)
    wt = F.last(F.when(F.col("v__"), F.col("wt2__")), ignorenulls=True).over(before)
    pr = F.last(F.when(F.col("v__"), F.col(price)), ignorenulls=True).over(before)
    div = (F.col("v__") & (F.col(price) < pr) & (F.col("wt2__") > wt)) if bullish else (F.col("v__") & (F.col(price) > pr) & (F.col("wt2__") < wt))
    rows = rows.withColumn("div__", F.coalesce(div, F.lit(False)))
    known = F.col("div__") if compat else F.coalesce(lag("div__", lookback_right), F.lit(False))
    w = W().rowsBetween(-length, -1)
    edge = F.min("wt1__").over(w) if bullish else F.max("wt1__").over(w)
    out = (F.col("wt1__") > edge) & (lag("wt1__") <= edge) if bullish else (F.col("wt1__") < edge) & (lag("wt1__") >= edge)
    return _done(rows, known | F.coalesce(out & (F.row_number().over(W()) > length), F.lit(False)), hold_bars)


@signal
def rsi(bars, period=14, threshold=30.0, mode="oversold", hold_bars=3):
    """The index falls below the threshold (oversold) or rises above it."""
    rows = win.rsi(bars, "r__", "close", period)
    t = F.lit(threshold)
    return _done(rows, win.crossunder(F.col("r__"), t) if mode == "oversold" else win.crossover(F.col("r__"), t), hold_bars)


@signal
def ema_cross(bars, period=21, mode="above", hold_bars=3):
    rows = win.ema(bars, "e__", "close", period, sma_seed=True)
    return _done(rows, win.crossover(F.col("close"), F.col("e__")) if mode == "above" else win.crossunder(F.col("close"), F.col("e__")), hold_bars)


def macd_lines(bars, fast=12, slow=26, smooth=9):
    """Histogram hist__ of the two averages' distance and its own average."""
    rows = win.linear_scans(bars, {"f__": ("close", 2 / (fast + 1), fast), "s__": ("close", 2 / (slow + 1), slow)})
    rows = rows.withColumn("m__", F.col("f__") - F.col("s__"))
    return win.ema(rows, "g__", "m__", smooth, sma_seed=True).withColumn("hist__", F.col("m__") - F.col("g__"))


@signal
def macd(bars, fast=12, slow=26, signal=9, mode="bullish", hold_bars=3):
    rows, zero = macd_lines(bars, fast, slow, signal), F.lit(0.0)
    return _done(rows, win.crossover(F.col("hist__"), zero) if mode == "bullish" else win.crossunder(F.col("hist__"), zero), hold_bars)


@signal
def atr_breakout(bars, period=14, ma_period=50, multiplier=1.5):
    rows = win.atr(bars, "a__", period)
    return _done(rows, F.col("a__") > multiplier * win.sma("a__", ma_period))


@signal
def vwap_cross(bars, mode="above", hold_bars=3):
    rows = bars.withColumn("v__", win.cumulative_vwap())
    return _done(rows, win.crossover(F.col("close"), F.col("v__")) if mode == "above" else win.crossunder(F.col("close"), F.col("v__")), hold_bars)


@signal
def bollinger(bars, period=20, nbdev=2.0, mode="lower", hold_bars=3):
    """Close reaches the lower band from above it, or the upper one from below."""
    sd = win.rolling_std("close", period, ddof=0)
    rows = bars.withColumn("b__", win.sma("close", period) + (-nbdev if mode == "lower" else nbdev) * sd)
    c, b, pc, pb = F.col("close"), F.col("b__"), lag("close"), lag("b__")
    return _done(rows, (c <= b) & (pc > pb) if mode == "lower" else (c >= b) & (pc < pb), hold_bars)


@signal
def roc(bars, period=5, mode="bullish", hold_bars=1):
    return _done(bars, _side(mode == "bullish", F.col("close") / lag("close", period) - 1, F.lit(0.0)), hold_bars, period)


@signal
def donchian(bars, period=20, mode="upper", hold_bars=1):
    """Close at the highest high (lowest low) of the last bars, its own among them; the first ``period`` bars never fire."""
    return _done(bars, F.col("close") >= win.rolling_max("high", period) if mode == "upper" else F.col("close") <= win.rolling_min("low", period), hold_bars, period)


def adx_lines(bars, n=14):
    """adx__ by Wilder's smoothing of range and directional moves."""
    u, d = F.col("high") - lag("high"), lag("low") - F.col("low")
    rows = bars.withColumns({"tr__": win.true_range(), "pd__": F.coalesce(F.when((u > d) & (u > 0), u), F.lit(0.0)), "md__": F.coalesce(F.when((d > u) & (d > 0), d), F.lit(0.0))})
    rows = win.linear_scans(rows, {f"w{c}__": (f"{c}__", 1 / n, n) for c in ("tr", "pd", "md")})
    p, m = (F.when(F.col("wtr__") > 0, 100 * F.col(x) / F.col("wtr__")).otherwise(0.0) for x in ("wpd__", "wmd__"))
    rows = rows.withColumns({"p__": p, "m__": m})
    dx = F.when(F.col("p__") + F.col("m__") > 0, 100 * F.abs(F.col("p__") - F.col("m__")) / (F.col("p__") + F.col("m__"))).otherwise(0.0)
    rows = rows.withColumn("dx__", F.when(F.row_number().over(W()) > n, dx))
    return win.wilder(rows, "adx__", "dx__", n)


@signal
def adx_filter(bars, period=14, threshold=20.0, mode="strong", hold_bars=1):
    x = F.coalesce("adx__", F.lit(0.0))
    return _done(adx_lines(bars, period), x > threshold if mode == "strong" else x <= threshold, hold_bars, 2 * period)


@signal
def ma_crossover(bars, fast_period=10, slow_period=100, mode="bullish", hold_bars=1):
    rows = win.linear_scans(bars, {"f__": ("close", 2 / (fast_period + 1), 1), "s__": ("close", 2 / (slow_period + 1), 1)})
    return _done(rows, _side(mode == "bullish", F.col("f__"), F.col("s__")), hold_bars, max(fast_period, slow_period))


@signal
def squeeze(bars, bb_period=20, bb_mult=2.0, kc_period=20, kc_mult=1.5, mode="bullish", hold_bars=1):
    """First bar after Bollinger bands leave the Keltner channel, with the sign of momentum smoothed over the longer of their lengths."""
    n = max(bb_period, kc_period)
    rows = bars.withColumns({"r__": F.col("high") - F.col("low"), "mid__": win.sma("close", bb_period), "sd__": win.rolling_std("close", bb_period, ddof=0), "mo__": F.col("close") - (win.rolling_max("high", n) + win.rolling_min("low", n)) / 2})
    rows = win.ema(win.linear_scans(rows, {"km__": ("close", 2 / (kc_period + 1), 1), "kr__": ("r__", 2 / (kc_period + 1), 1)}), "mom__", "mo__", n)
    inside = (F.col("mid__") - bb_mult * F.col("sd__") > F.col("km__") - kc_mult * F.col("kr__")) & (F.col("mid__") + bb_mult * F.col("sd__") < F.col("km__") + kc_mult * F.col("kr__"))
    rows = rows.withColumn("on__", F.coalesce(inside, F.lit(False)))
    return _done(rows, ~F.col("on__") & lag("on__") & _side(mode == "bullish", F.col("mom__"), F.lit(0.0)), hold_bars, n)


@signal
def stoch_rsi(bars, rsi_period=14, stoch_period=14, k_smooth=3, d_smooth=3, oversold=20.0, overbought=80.0, mode="oversold", hold_bars=1):
    rows = win.rsi(bars, "r__", "close", rsi_period)
    lo, hi = win.rolling_min("r__", stoch_period), win.rolling_max("r__", stoch_period)
    rows = rows.withColumn("s__", F.when(hi > lo, (F.col("r__") - lo) / (hi - lo) * 100).otherwise(50.0)).withColumn("k__", win.sma("s__", k_smooth)).withColumn("dd__", win.sma("k__", d_smooth))
    a, b = F.col("k__"), F.col("dd__")
    raw = (lag("k__") <= lag("dd__")) & (a > b) & (a < oversold) if mode == "oversold" else (lag("k__") >= lag("dd__")) & (a < b) & (a > overbought)
    return _done(rows, raw, hold_bars, rsi_period + stoch_period + max(k_smooth, d_smooth))


@signal
def ichimoku(bars, tenkan_period=9, kijun_period=26, senkou_period=52, mode="bullish", hold_bars=1):
    mid = lambda n: (win.rolling_max("high", n) + win.rolling_min("low", n)) / 2
    rows = bars.withColumns({"t__": mid(tenkan_period), "k__": mid(kijun_period), "sb__": mid(senkou_period)})
    t, k = F.col("t__"), F.col("k__")
    sa = (t + k) / 2
    raw = (lag("t__") <= lag("k__")) & (t > k) & (F.col("close") > F.greatest(sa, F.col("sb__"))) if mode == "bullish" else (lag("t__") >= lag("k__")) & (t < k) & (F.col("close") < F.least(sa, F.col("sb__")))
    return _done(rows, raw, hold_bars, senkou_period)


@signal
def obv_trend(bars, ma_period=20, mode="bullish", hold_bars=1):
    rows = bars.withColumn("st__", win.obv_step()).withColumn("o__", F.sum("st__").over(ALL()))
    return _done(win.ema(rows, "e__", "o__", ma_period), _side(mode == "bullish", F.col("o__"), F.col("e__")), hold_bars, ma_period)


@signal
def volatility_regime(bars, atr_period=14, lookback=100, threshold=50.0, mode="trending", hold_bars=1):
    """Percentage of the last ``lookback`` average ranges below the present one, against the threshold; from bar ``atr_period + lookback - 1`` (the first is 0) on."""
    rows = win.pct_rank(win.atr(bars, "a__", atr_period), "p__", "a__", lookback, strict=True)
    return _done(rows, _side(mode == "trending", F.col("p__") * 100, F.lit(threshold)), hold_bars, atr_period + lookback - 1)


@signal
def volume_spike(bars, lookback=20, threshold=2.0, mode="bullish", hold_bars=1):
    return _done(bars, (F.col("volume") > threshold * win.sma("volume", lookback)) & _side(mode == "bullish", F.col("close"), F.col("open")), hold_bars, lookback)


@signal
def momentum_divergence(bars, roc_period=14, lookback=20, mode="bullish", hold_bars=3):
    """Extremes of price and rate of change, this window against the one before."""
    bullish = mode == "bullish"
    rows = bars.withColumn("r__", F.coalesce(F.col("close") / lag("close", roc_period) - 1, F.lit(0.0)))
    now, then = last_n(lookback), W().rowsBetween(-(2 * lookback - 1), -lookback)
    f = F.min if bullish else F.max
    price, osc = (f("close").over(now), f("close").over(then)), (f("r__").over(now), f("r__").over(then))
    return _done(rows, _side(not bullish, *price) & _side(bullish, *osc), hold_bars, roc_period + 2 * lookback)


# --- derivatives, macro, cross-asset


def _extreme(name: str, low: str) -> Callable[..., DataFrame]:
    def f(bars, lookback=30, extreme_z=2.0, mode=low, hold_bars=3):
        if (x := _absent(bars, name)) is not None:
            return x
        z = win.zscore_prior("x__", lookback)
        return _done(_filled(bars, name), z < -extreme_z if mode == low else z > extreme_z, hold_bars)

    f.__name__ = name
    f.__doc__ = f"{name} beyond ``extreme_z`` deviations of the values before, below for {low}."
    return signal(f)


funding_rate = _extreme("funding_rate", "reversal_long")
long_short_ratio = _extreme("long_short_ratio", "contrarian_long")
basis = _extreme("basis", "reversal_long")


@signal
def oi_divergence(bars, period=14, mode="bullish", hold_bars=3):
    """Price and open interest move apart: price down and interest up (bullish), or the reverse."""
    if (x := _absent(bars, "open_interest")) is not None:
        return x
    change = lambda c: F.when(lag(c, period) >= 1e-12, F.col(c) / lag(c, period) - 1)
    p, i = change("close"), change("x__")
    return _done(_filled(bars, "open_interest"), (p < 0) & (i > 0) if mode == "bullish" else (p > 0) & (i < 0), hold_bars)


@signal
def taker_volume(bars, lookback=20, threshold=0.55, mode="buy_pressure", hold_bars=1):
    if (x := _absent(bars, "taker_buy_ratio")) is not None:
        return x
    s = win.sma("x__", lookback)
    return _done(_filled(bars, "taker_buy_ratio"), s > threshold if mode == "buy_pressure" else s < 1 - threshold, hold_bars, lookback)


@signal
def vrp(bars, realized_window=20, mode="risk_on", hold_bars=1):
    """Implied variance above (risk_on) or below realised variance of log returns."""
    if (x := _absent(bars, "vix")) is not None:
        return x
    rows = _filled(bars, "vix").withColumn("lr__", F.ln(F.col("close") / lag("close")))
    return _done(rows, _side(mode == "risk_on", F.pow(F.col("x__") / 100, 2) - win.rolling_var("lr__", realized_window) * 252, F.lit(0.0)), hold_bars, realized_window)


@signal
def yield_curve(bars, threshold=0.0, mode="normal", lookback=20, hold_bars=1):
    """Spread above the threshold (normal), below minus its size (inverted) or above its own average (steepening)."""
    if (x := _absent(bars, "yield_spread")) is not None:
        return x
    y = F.col("x__")
    raw = y > threshold if mode == "normal" else y < -abs(threshold) if mode == "inverted" else y > win.sma("x__", lookback)
    return _done(_filled(bars, "yield_spread"), raw, hold_bars, lookback if mode == "steepening" else 0)


@signal
def credit_spread(bars, lookback=20, mode="risk_on", hold_bars=1):
    """The ratio ``credit_spread`` above its average, or, where bars lack it, the spread ``hy_spread`` below its own (risk_on); ``momentum``: the first such bar."""
    column = "credit_spread" if "credit_spread" in bars.columns else "hy_spread"
    if (x := _absent(bars, column)) is not None:
        return x
    rows = _filled(bars, column).withColumn("m__", F.when(F.row_number().over(W()) > lookback, win.sma("x__", lookback)))
    calm = _side((mode != "risk_off") == (column == "credit_spread"), F.col("x__"), F.col("m__"))
    rows = rows.withColumn("calm__", F.coalesce(calm, F.lit(False)))
    raw = F.col("calm__") & ~F.coalesce(lag("calm__"), F.lit(False)) if mode == "momentum" else F.col("calm__")
    return _done(rows, raw, hold_bars, lookback)


@signal
def cs_momentum(bars, rank_threshold=0.5, mode="winners", hold_bars=1):
    if (x := _absent(bars, "cs_momentum_rank")) is not None:
        return x
    r = F.col("x__")
    return _done(_filled(bars, "cs_momentum_rank"), r >= rank_threshold if mode == "winners" else r <= 1 - rank_threshold, hold_bars)


@signal
def cross_asset_momentum(bars, reference_col="ref_close", lookback=24, hold_bars=3, mode="bullish"):
    if (x := _absent(bars, reference_col)) is not None:
        return x
    return _done(bars, _side(mode == "bullish", F.col(reference_col) / lag(reference_col, lookback) - 1, F.lit(0.0)), hold_bars, lookback)


@signal
def cross_asset_momentum_inv(bars, reference_col="ref_close", lookback=24, hold_bars=3, mode="bullish"):
    """The reference falls (bullish) or rises."""
    return cross_asset_momentum(bars, reference_col, lookback, hold_bars, "bearish" if mode == "bullish" else "bullish")


@signal
def vol_scaled_momentum(bars, reference_col="ref_close", lookback=12, vol_window=60, z_threshold=0.5, hold_bars=3, mode="bullish"):
    """The reference's change over ``lookback`` bars, in deviations of such changes over ``vol_window`` bars."""
    if (x := _absent(bars, reference_col)) is not None:
        return x
    rows = bars.withColumn("r__", F.col(reference_col).cast("double") / lag(reference_col, lookback) - 1)
    sd = win.rolling_std("r__", vol_window)
    z = F.when(sd != 0, F.col("r__") / sd)
    return _done(rows, z > z_threshold if mode == "bullish" else z < -z_threshold, hold_bars, max(lookback, vol_window))


@signal
def macro_regime_signal(bars, reference_col="ref_value", z_window=60, z_threshold=1.0, hold_bars=5, mode="risk_on"):
    """A macro value far below its average (risk_on) or far above it."""
    if (x := _absent(bars, reference_col)) is not None:
        return x
    z = win.zscore(reference_col, z_window)
    return _done(bars, z < -z_threshold if mode == "risk_on" else z > z_threshold, hold_bars, z_window)


# --- chart-script extras


@signal
def rsi_bb(bars, n=14, ma=20, width=2.0, up=True, hold_bars=1):
    """RSI crosses its average plus or minus a spread."""
    rows = win.ema(win.rsi(bars, "r__", "close", n), "m__", "r__", ma)
    rows = rows.withColumn("b__", F.col("m__") + (width if up else -width) * win.rolling_std("r__", ma, ddof=0))
    return _done(rows, win.crossover(F.col("r__"), F.col("b__")) if up else win.crossunder(F.col("r__"), F.col("b__")), hold_bars)


@signal
def mtf_ma_stack(bars, lengths=(4, 8, 24), every=True, hold_bars=1):
    """Close above all (or any) of several averages."""
    over = F.array(*[F.coalesce(F.col("close") > win.sma("close", n), F.lit(False)) for n in lengths])
    return _done(bars, F.forall(over, lambda x: x) if every else F.exists(over, lambda x: x), hold_bars)


@signal
def macd_mtf(bars, scales=(1, 2), hold_bars=1):
    """MACD above its average on all time scales."""
    rows = bars
    for s in scales:
        rows = macd_lines(rows, 12 * s, 26 * s, 9 * s).withColumn(f"on{s}__", F.col("hist__") > 0).drop("f__", "s__", "m__", "g__", "hist__")
    raw = F.lit(True)
    for s in scales:
        raw = raw & F.col(f"on{s}__")
    return _done(rows, raw, hold_bars)


@signal
def squeeze_linreg(bars, n=20, up=True, hold_bars=1):
    """End of the regression line of momentum over the last n bars, its sign."""
    rows = bars.withColumns({"mo__": F.col("close") - ((win.rolling_max("high", n) + win.rolling_min("low", n)) / 2 + win.sma("close", n)) / 2, "x__": F.row_number().over(W()).cast("double")})
    slope, intercept = F.regr_slope("mo__", "x__").over(last_n(n)), F.regr_intercept("mo__", "x__").over(last_n(n))
    return _done(rows, win.full(_side(up, intercept + slope * F.col("x__"), F.lit(0.0)), "mo__", n), hold_bars)


@signal
def fibo_ma_cross(bars, lengths=(5, 8, 13, 21), hold_bars=1):
    """Averages in rising order for the first bar."""
    rows = bars
    for n in lengths:
        rows = win.ema(rows, f"e{n}__", "close", n)
    stack = F.lit(True)
    for a, b in zip(lengths, lengths[1:], strict=False):
        stack = stack & (F.col(f"e{a}__") > F.col(f"e{b}__"))
    rows = rows.withColumn("st__", stack)
    return _done(rows, F.col("st__") & ~F.coalesce(lag("st__"), F.lit(False)), hold_bars)


# --- blocks of a symbol in grouped maps

#: Rows of a block of a ratcheting band.
BAND_ROWS = 4096


def firestorm_bands(bars, period=10, multiplier=1.8):
    """up_band, dn_band, trend (1 or -1) and flip (trend changed) of the ratcheting bands.

    A band keeps the better of its new and its last value while the close before stays on its side, else it starts anew; that is no
    linear recurrence, but blocks of it compose: see ``bands``. A symbol's blocks run apart, in three rounds: what each
    does to a band that comes in, the bands of all rows with the trend from either start, the trend that comes in.
    """
    from tidemark.operators import bands

    rows = bars.withColumn("mid__", (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4).withColumn("tr__", win.true_range())
    rows = win.ema(rows, "a__", "tr__", period)
    m = F.col("a__") * multiplier
    # the lower band is the upper one of the negated prices
    rows = rows.select("symbol", "ts", "close", lag("close").alias("before"), (F.col("mid__") - m).alias("up"), (-(F.col("mid__") + m)).alias("dn"), F.row_number().over(W()).alias("k"))
    return bands.ratchet(rows, BAND_ROWS)


@signal
def firestorm(bars, period=10, multiplier=1.8, hold_bars=1, direction="long"):
    rows = bars.join(firestorm_bands(bars, period, multiplier), ["symbol", "ts"])
    return _done(rows, F.col("flip") == (1 if direction == "long" else -1), hold_bars).drop("up_band", "dn_band", "trend", "flip")


def firestorm_tm(bars, period=9, multiplier=0.9, direction="long"):
    """The band as a stop level."""
    return firestorm_bands(bars, period, multiplier).select("symbol", "ts", F.col("up_band" if direction == "long" else "dn_band").alias("stop"))


@signal
def hurst(bars, window=100, mode="trending", threshold_high=0.55, threshold_low=0.45, hold_bars=1):
    """Rescaled-range exponent of the last ``window`` log returns against thresholds.

    Series are cut into blocks, each with the rows before it that its windows need, so that no task holds a whole symbol.
    """
    n = window
    size = max(1024, 4 * n)

    def run(key, t):
        import numpy as np
        import pyarrow as pa

        from tidemark.functions.stats import hurst_exponent

        t = t.sort_by("ts")
        r, own = t["r__"].to_numpy(), t["own__"].to_numpy()
        h = np.full(len(r), np.nan)
        for i in np.flatnonzero(own):
            last = r[max(0, i - n + 1) : i + 1]
            if len(last) == n and not np.isnan(last).any():
                h[i] = hurst_exponent(last)
        return t.select(["symbol", "ts"]).append_column("h", pa.array(h)).filter(pa.array(own)).cast(kinds)

    rows = bars.select("symbol", "ts", F.ln(F.col("close") / lag("close")).alias("r__"), (F.row_number().over(W()) - 1).alias("k__"))
    block = F.floor(F.col("k__") / size)
    # the last rows of a block are also the start of the next one's first windows
    both = F.when(F.pmod("k__", F.lit(size)) >= size - n, F.array(block, block + 1)).otherwise(F.array(block))
    rows = rows.select("symbol", "ts", "r__", block.alias("home__"), F.explode(both).alias("block__")).withColumn("own__", F.col("home__") == F.col("block__"))
    schema = StructType([bars.schema["symbol"], bars.schema["ts"], StructField("h", DoubleType())])
    kinds = to_arrow_schema(schema)
    h = rows.groupBy("symbol", "block__").applyInArrow(run, schema)
    rows = bars.join(h.select("symbol", "ts", F.nanvl("h", F.lit(None).cast("double")).alias("h__")), ["symbol", "ts"])
    x = F.col("h__")
    return _done(rows, x > threshold_high if mode == "trending" else x < threshold_low if mode == "mean_reverting" else (x > threshold_high) | (x < threshold_low), hold_bars, n)
