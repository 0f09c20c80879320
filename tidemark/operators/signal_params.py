"""Parameters of the signals: kind, range or choices, default of a search, step.

``SCHEMAS[signal][parameter]`` is (kind, least, most, default), a fifth value for
a step other than 1 (int) or a hundredth of the range (float), or
("str", choices, default). A signal's own defaults (of its function) differ from
these in a few places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SIDES = ("bullish", "bearish")
HOLD = {k: ("int", 1, k, 1) for k in (5, 6, 10, 20)}
HOLD_3 = {k: ("int", 1, k, 3) for k in (5, 8, 10, 20)}
WAVES = {"channel_len": ("int", 2, 50, 9), "average_len": ("int", 2, 50, 12), "ma_len": ("int", 2, 10, 3), "ob_level": ("float", 20.0, 100.0, 60.0), "os_level": ("float", -100.0, -20.0, -60.0)}
EXTREME = {"lookback": ("int", 10, 100, 30), "extreme_z": ("float", 1.0, 4.0, 2.0, 0.5)}

# Ranges and defaults that a search over these signals has to have.
SCHEMAS: dict[str, dict[str, tuple]] = {
    "ash": {"length": ("int", 3, 30, 9), "smooth": ("int", 1, 10, 3), "mode": ("str", ("rsi", "stochastic", "adx"), "rsi"), "ma_type": ("str", ("ema", "sma", "wma"), "ema"), "signal_mode": ("str", SIDES, "bullish")},
    "firestorm": {"period": ("int", 2, 50, 10), "multiplier": ("float", 0.5, 1.5, 0.9), "hold_bars": HOLD[10]},
    "firestorm_tm": {"period": ("int", 2, 50, 9), "multiplier": ("float", 0.5, 1.2, 0.9)},
    "ssl_channel": {"length": ("int", 2, 150, 12), "hold_bars": ("int", 1, 10, 4)},
    "ssl_channel_low": {"length": ("int", 2, 150, 12)},
    "wavetrend_reversal": {**WAVES, "hold_bars": HOLD_3[20]},
    "wavetrend_divergence": {**WAVES, "lookback_left": ("int", 5, 50, 20), "lookback_right": ("int", 1, 5, 1), "divergence_length": ("int", 5, 50, 20), "hold_bars": HOLD_3[20]},
    "rsi": {"period": ("int", 2, 100, 14), "threshold": ("float", 5.0, 95.0, 30.0), "mode": ("str", ("oversold", "overbought"), "oversold"), "hold_bars": HOLD_3[10]},
    "ema_cross": {"period": ("int", 2, 200, 21), "mode": ("str", ("above", "below"), "above"), "hold_bars": HOLD_3[5]},
    "macd": {"fast": ("int", 2, 40, 12), "slow": ("int", 5, 80, 26), "signal": ("int", 2, 30, 9), "mode": ("str", SIDES, "bullish"), "hold_bars": HOLD_3[8]},
    "atr_breakout": {"period": ("int", 2, 100, 14), "ma_period": ("int", 5, 200, 50), "multiplier": ("float", 0.5, 5.0, 1.5)},
    "vwap_cross": {"mode": ("str", ("above", "below"), "above"), "hold_bars": HOLD_3[10]},
    "bollinger": {"period": ("int", 5, 50, 20), "nbdev": ("float", 0.5, 2.5, 1.0), "mode": ("str", ("lower", "upper"), "lower"), "hold_bars": HOLD_3[5]},
    "roc": {"period": ("int", 2, 40, 5), "mode": ("str", SIDES, "bullish"), "hold_bars": HOLD[6]},
    "donchian": {"period": ("int", 5, 100, 20), "mode": ("str", ("upper", "lower"), "upper"), "hold_bars": HOLD[20]},
    "adx_filter": {"period": ("int", 10, 40, 14), "threshold": ("float", 15.0, 45.0, 25.0), "mode": ("str", ("strong", "weak"), "strong"), "hold_bars": HOLD[5]},
    "ma_crossover": {"fast_period": ("int", 5, 20, 10), "slow_period": ("int", 20, 250, 100), "mode": ("str", SIDES, "bullish"), "hold_bars": HOLD[5]},
    "squeeze": {"bb_period": ("int", 14, 26, 20), "bb_mult": ("float", 1.5, 2.5, 2.0, 0.5), "kc_period": ("int", 14, 26, 20), "kc_mult": ("float", 1.0, 2.0, 1.5, 0.5), "mode": ("str", SIDES, "bullish"), "hold_bars": HOLD[5]},
    "stoch_rsi": {"rsi_period": ("int", 7, 21, 14), "stoch_period": ("int", 7, 21, 14), "oversold": ("float", 10.0, 30.0, 20.0, 5.0), "overbought": ("float", 70.0, 90.0, 80.0, 5.0), "mode": ("str", ("oversold", "overbought"), "oversold"), "hold_bars": HOLD[5]},
    "ichimoku": {"tenkan_period": ("int", 7, 13, 9), "kijun_period": ("int", 20, 35, 26), "senkou_period": ("int", 40, 65, 52), "mode": ("str", SIDES, "bullish"), "hold_bars": HOLD[5]},
    "obv_trend": {"ma_period": ("int", 5, 50, 20), "mode": ("str", SIDES, "bullish"), "hold_bars": HOLD[10]},
    "volatility_regime": {"atr_period": ("int", 7, 30, 14), "lookback": ("int", 50, 200, 100), "threshold": ("float", 20.0, 80.0, 50.0, 5.0), "mode": ("str", ("trending", "ranging"), "trending"), "hold_bars": HOLD[5]},
    "volume_spike": {"lookback": ("int", 10, 50, 20), "threshold": ("float", 1.5, 5.0, 2.0, 0.5), "mode": ("str", SIDES, "bullish"), "hold_bars": HOLD[5]},
    "momentum_divergence": {"roc_period": ("int", 5, 30, 14), "lookback": ("int", 10, 50, 20), "mode": ("str", SIDES, "bullish"), "hold_bars": HOLD_3[10]},
    "funding_rate": {**EXTREME, "mode": ("str", ("reversal_long", "reversal_short"), "reversal_long"), "hold_bars": HOLD_3[10]},
    "oi_divergence": {"period": ("int", 5, 40, 14), "mode": ("str", SIDES, "bullish"), "hold_bars": HOLD_3[10]},
    "long_short_ratio": {**EXTREME, "mode": ("str", ("contrarian_long", "contrarian_short"), "contrarian_long"), "hold_bars": HOLD_3[10]},
    "vrp": {"realized_window": ("int", 10, 60, 20), "mode": ("str", ("risk_on", "risk_off"), "risk_on"), "hold_bars": HOLD[20]},
    "yield_curve": {"threshold": ("float", -0.5, 1.0, 0.0, 0.1), "mode": ("str", ("normal", "inverted", "steepening"), "normal"), "lookback": ("int", 5, 60, 20), "hold_bars": HOLD[20]},
    "credit_spread": {"lookback": ("int", 10, 60, 20), "mode": ("str", ("risk_on", "risk_off", "momentum"), "risk_on"), "hold_bars": HOLD[20]},
    "hurst": {"window": ("int", 50, 300, 100), "mode": ("str", ("trending", "mean_reverting", "any_edge"), "trending"), "threshold_high": ("float", 0.52, 0.65, 0.55, 0.01), "threshold_low": ("float", 0.35, 0.48, 0.45, 0.01), "hold_bars": HOLD[20]},
    "taker_volume": {"lookback": ("int", 5, 50, 20), "threshold": ("float", 0.51, 0.70, 0.55, 0.01), "mode": ("str", ("buy_pressure", "sell_pressure"), "buy_pressure"), "hold_bars": HOLD[10]},
    "basis": {**EXTREME, "mode": ("str", ("reversal_long", "reversal_short"), "reversal_long"), "hold_bars": HOLD_3[10]},
    "cs_momentum": {"rank_threshold": ("float", 0.3, 0.8, 0.5, 0.1), "mode": ("str", ("winners", "losers"), "winners"), "hold_bars": HOLD[20]},
    "cross_asset_momentum": {"lookback": ("int", 1, 60, 24), "hold_bars": HOLD_3[10], "mode": ("str", SIDES, "bullish")},
    "cross_asset_momentum_inv": {"lookback": ("int", 1, 60, 24), "hold_bars": HOLD_3[10], "mode": ("str", SIDES, "bullish")},
    "vol_scaled_momentum": {"lookback": ("int", 3, 60, 12), "vol_window": ("int", 20, 120, 60), "z_threshold": ("float", 0.0, 2.0, 0.5), "hold_bars": HOLD_3[10], "mode": ("str", SIDES, "bullish")},
    "macro_regime_signal": {"z_window": ("int", 20, 252, 60), "z_threshold": ("float", 0.0, 3.0, 1.0), "hold_bars": ("int", 1, 20, 5), "mode": ("str", ("risk_on", "risk_off"), "risk_on")},
}


def default(spec: tuple):
    return spec[2] if spec[0] == "str" else spec[3]


def check(name: str, params: dict) -> None:
    """Refuse values outside a signal's choices and numbers of another kind; ranges bound searches, not calls."""
    for key, value in params.items():
        spec = SCHEMAS.get(name, {}).get(key)
        if spec and spec[0] == "str" and value not in spec[1]:
            raise ValueError(f"{name}: {key} must be one of {', '.join(spec[1])}, not {value!r}")
        if spec and spec[0] != "str" and (isinstance(value, bool) or not isinstance(value, int if spec[0] == "int" else (int, float))):
            raise ValueError(f"{name}: {key} must be {'a whole number' if spec[0] == 'int' else 'a number'}, not {value!r}")


def schema_rows(spark: SparkSession, *names: str) -> DataFrame:
    """The parameters of some signals (or of all) as rows for ``grid.space_from_schema``: signal, name, kind, lo, hi, step, choices, preset."""
    rows = []
    for signal in names or SCHEMAS:
        for key, spec in SCHEMAS[signal].items():
            if spec[0] == "str":
                rows.append((signal, key, "str", None, None, None, list(spec[1]), spec[2]))
            else:
                step = spec[4] if len(spec) > 4 else 1 if spec[0] == "int" else (spec[2] - spec[1]) / 100
                rows.append((signal, key, spec[0], float(spec[1]), float(spec[2]), float(step), None, str(spec[3])))
    return spark.createDataFrame(rows, "signal string, name string, kind string, lo double, hi double, step double, choices array<string>, preset string")
