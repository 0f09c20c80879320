"""Queries of signals, regimes and signal combination."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.arithmetic import quotient
from tidemark.operators import combine
from tidemark.operators import signals as sig
from tidemark.operators import windows as win
from tidemark.plans.fixtures import BARS_1D, BARS_1H, bars_1d, bars_1h, table
from tidemark.plans.registry import query
from tidemark.plans.sqlsteps import ORDER, RUN, Steps, cross, full, lag, last, sma

#: Columns that some signals need beside bars, derived from the bars themselves; slow ones are null between their hours.
EXTRA = {
    "funding_rate": "CASE WHEN hour(ts) % 8 = 0 THEN (close - open) / open END",
    "open_interest": "CASE WHEN hour(ts) % 4 = 1 THEN volume * 100 + close END",
    "long_short_ratio": "CASE WHEN hour(ts) % 3 <> 0 THEN high / low END",
    "taker_buy_ratio": "CASE WHEN hour(ts) % 2 = 0 THEN (close - low) / (high - low + 1) END",
    "basis": "CASE WHEN hour(ts) % 5 <> 2 THEN close - (high + low) / 2 END",
    "vix": "CASE WHEN hour(ts) = 12 THEN 10 + volume END",
    "yield_spread": "CASE WHEN hour(ts) % 6 = 0 THEN (close - open) / 10 END",
    "credit_spread": "CASE WHEN hour(ts) % 12 = 3 THEN high / (open + 1) END",
    "ref_close": "open",
    "ref_value": "volume + high / 100",
}
MORE = f"{BARS_1H}, more AS MATERIALIZED (SELECT *, {', '.join(f'{x} AS {c}' for c, x in EXTRA.items())} FROM bars)"


def more(spark, sf):
    """Bars with the columns of ``EXTRA``; those with a divisor that may be 0 divide as SQL does, not as Spark's ANSI mode."""
    hour, c = F.hour("ts"), F.col
    ratios = {
        "funding_rate": F.when(hour % 8 == 0, quotient(c("close") - c("open"), c("open"))),
        "long_short_ratio": F.when(hour % 3 != 0, quotient(c("high"), c("low"))),
        "taker_buy_ratio": F.when(hour % 2 == 0, quotient(c("close") - c("low"), c("high") - c("low") + 1)),
        "credit_spread": F.when(hour % 12 == 3, quotient(c("high"), c("open") + 1)),
    }
    return bars_1h(spark, sf).select("*", *[ratios.get(name, F.expr(x)).alias(name) for name, x in EXTRA.items()])


def S() -> Steps:
    return Steps(MORE, "more")


def put(name: str, sql: str | None, **params) -> None:
    """Register a signal; parameters that aren't given are its own defaults."""
    query(name, sql)(lambda spark, sf: sig.compute(name, more(spark, sf), **params).select("symbol", "ts", "signal"))


def filled(column: str) -> Steps:
    """``x``: the column with nulls filled from the bars before."""
    return S().add(x=f"last_value({column} IGNORE NULLS) OVER {RUN}")


def _ash() -> str:
    s = S().add(d=f"close - {lag('close')}").ema("u1", "coalesce(greatest(d, 0), 0)", 9).ema("d1", "coalesce(greatest(-d, 0), 0)", 9).ema("u", "u1", 3).ema("e", "d1", 3)
    return s.signal(f"abs(u - e) > e AND NOT abs(u - e) > u AND u >= {lag('u')}")


def _ssl(up: bool, hold: int) -> str:
    s = S().ema("eh", "high", 12).ema("el", "low", 12).add(st="CASE WHEN close > eh THEN 1 WHEN close < el THEN -1 END")
    s.add(hl=f"coalesce(last_value(st IGNORE NULLS) OVER {RUN}, 0)").add(ab="CASE WHEN hl < 0 THEN el > eh ELSE eh > el END")
    return s.signal(f"ab AND NOT coalesce({lag('ab')}, false)" if up else f"NOT ab AND coalesce({lag('ab')}, true)", hold)


def _wt() -> Steps:
    s = S().add(p="(high + low + close) / 3").ema("esa", "p", 9).ema("de", "abs(p - esa)", 9).ema("wt1", "CASE WHEN de <> 0 THEN (p - esa) / (0.015 * de) ELSE 0 END", 12)
    return s.add(wt2=f"avg(wt1) OVER {last(3)}")


put("ash", _ash())
put("ssl_channel", _ssl(True, 4))
put("ssl_channel_low", _ssl(False, 1))
put("wavetrend_reversal", _wt().signal(f"wt1 > wt2 AND coalesce({lag('wt1')}, 0) <= coalesce({lag('wt2')}, 0) AND wt2 <= -20", 3), os_level=-20.0)
B4, AF = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)", "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING)"
BEFORE, TEN = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
DIV = _wt().add(v=f"coalesce(count(wt2) OVER {B4} = 5 AND count(wt2) OVER {AF} = 1 AND wt2 < min(wt2) OVER {B4} AND wt2 < min(wt2) OVER {AF}, false) AND wt2 <= 0")
DIV.add(div=f"coalesce(v AND low < last_value(CASE WHEN v THEN low END IGNORE NULLS) OVER {BEFORE} AND wt2 > last_value(CASE WHEN v THEN wt2 END IGNORE NULLS) OVER {BEFORE}, false)", edge=f"min(wt1) OVER {TEN}", p1=lag("wt1"))
put("wavetrend_divergence", DIV.signal(f"coalesce({lag('div')}, false) OR coalesce(wt1 > edge AND p1 <= edge AND rn > 10, false)", 2), os_level=0.0, lookback_left=5, divergence_length=10, hold_bars=2)
put("rsi", S().rsi("r", 14).add(t="45.0").signal(cross("r", "t", False), 3), threshold=45.0)
put("ema_cross", S().ema("e", "close", 21, True).signal(cross("close", "e"), 3))
MACD = lambda k=1: S().ema("f", "close", 12 * k, True).ema("s", "close", 26 * k, True).ema("g", "f - s", 9 * k, True).add(hist="f - s - g", zero="0.0")
put("macd", MACD().signal(cross("hist", "zero"), 3))
put("atr_breakout", S().true_range().wilder("a", "tr", 14).signal(f"a > 1.05 * ({sma('a', 50)})"), multiplier=1.05)
put("vwap_cross", S().add(v=f"sum((high + low + close) / 3 * volume) OVER {RUN} / sum(volume) OVER {RUN}").signal(cross("close", "v"), 3))
put("bollinger", S().add(b=f"({sma('close', 20)}) - 1.5 * ({full('stddev_pop', 'close', 20)})").signal(f"close <= b AND {lag('close')} > {lag('b')}", 3), nbdev=1.5)
put("roc", S().signal(f"close / {lag('close', 5)} - 1 > 0", 1, 5))
put("donchian", S().signal(f"close >= ({full('max', 'high', 5)})", 1, 5), period=5)


def _adx() -> str:
    n = 14
    s = S().true_range().add(u=f"high - {lag('high')}", d=f"{lag('low')} - low").add(pd="coalesce(CASE WHEN u > d AND u > 0 THEN u END, 0)", md="coalesce(CASE WHEN d > u AND d > 0 THEN d END, 0)")
    s.wilder("wt", "tr", n).wilder("wp", "pd", n).wilder("wm", "md", n).add(p="CASE WHEN wt > 0 THEN 100 * wp / wt ELSE 0 END", m="CASE WHEN wt > 0 THEN 100 * wm / wt ELSE 0 END")
    s.wilder("adx", f"CASE WHEN rn > {n} THEN CASE WHEN p + m > 0 THEN 100 * abs(p - m) / (p + m) ELSE 0 END END", n)
    return s.signal("coalesce(adx, 0) > 8", 1, 2 * n)


put("adx_filter", _adx(), threshold=8.0)
put("ma_crossover", S().ema("f", "close", 10).ema("s", "close", 100).signal("f > s", 1, 100))


def _squeeze() -> str:
    s = S().add(mid=sma("close", 14), sd=full("stddev_pop", "close", 14), mo=f"close - (({full('max', 'high', 22)}) + ({full('min', 'low', 22)})) / 2").ema("km", "close", 22).ema("kr", "high - low", 22).ema("mom", "mo", 22)
    s.add(onn="coalesce(mid - 2 * sd > km - 1.5 * kr AND mid + 2 * sd < km + 1.5 * kr, false)")
    return s.signal(f"NOT onn AND {lag('onn')} AND mom > 0", 1, 22)


put("squeeze", _squeeze(), bb_period=14, kc_period=22)


def _stoch() -> str:
    s = S().rsi("r", 14).add(lo=full("min", "r", 14), hi=full("max", "r", 14)).add(st="CASE WHEN hi > lo THEN (r - lo) / (hi - lo) * 100 ELSE 50 END").add(k=sma("st", 3)).add(dd=sma("k", 3))
    return s.signal(f"{lag('k')} <= {lag('dd')} AND k > dd AND k < 50", 1, 31)


put("stoch_rsi", _stoch(), oversold=50.0)
MID = lambda n: f"(({full('max', 'high', n)}) + ({full('min', 'low', n)})) / 2"
put("ichimoku", S().add(t=MID(9), k=MID(26), sb=MID(52)).signal(f"{lag('t')} <= {lag('k')} AND t > k AND close > greatest((t + k) / 2, sb)", 1, 52))
put("obv_trend", S().add(d=f"close - {lag('close')}").add(o=f"sum(CASE WHEN d > 0 THEN volume WHEN d < 0 THEN -volume ELSE 0 END) OVER {RUN}").ema("e", "o", 20).signal("o > e", 1, 20))
put("volatility_regime", S().true_range().wilder("a", "tr", 14).add(p=f"CASE WHEN count(a) OVER {last(100)} = 100 THEN len(list_filter(list(a) OVER {last(100)}, lambda x: x < a)) / 100.0 END").signal("p * 100 > 50", 1, 113))
put("volume_spike", S().signal(f"volume > 1.3 * ({sma('volume', 20)}) AND close > open", 1, 20), threshold=1.3)
THEN = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING)"
put("momentum_divergence", S().add(r=f"coalesce(close / {lag('close', 14)} - 1, 0)").signal(f"min(close) OVER {last(20)} < min(close) OVER {THEN} AND min(r) OVER {last(20)} > min(r) OVER {THEN}", 3, 54))
Z30 = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"
for _name, _mode, _z in (("funding_rate", "reversal_short", "> 1.5"), ("long_short_ratio", "contrarian_short", "> 1.5"), ("basis", "reversal_long", "< -1.5")):
    put(_name, filled(_name).signal(f"CASE WHEN count(x) OVER {Z30} = 30 AND stddev_samp(x) OVER {Z30} > 1e-12 THEN (x - avg(x) OVER {Z30}) / stddev_samp(x) OVER {Z30} END {_z}", 3), mode=_mode, extreme_z=1.5)
put("oi_divergence", filled("open_interest").signal(f"close / {lag('close', 14)} - 1 < 0 AND x / {lag('x', 14)} - 1 > 0", 3))
put("taker_volume", filled("taker_buy_ratio").signal(f"({sma('x', 20)}) > 0.5", 1, 20), threshold=0.5)
put("vrp", filled("vix").add(lr=f"ln(close / {lag('close')})").signal(f"pow(x / 100, 2) - ({full('var_samp', 'lr', 20)}) * 252 < 0", 1, 20), mode="risk_off")
put("yield_curve", filled("yield_spread").signal(f"x > ({sma('x', 20)})", 1, 20), mode="steepening")
put("credit_spread", filled("credit_spread").add(calm=f"coalesce(x > ({sma('x', 20)}), false) AND rn > 20").signal(f"calm AND NOT coalesce({lag('calm')}, false)", 1, 20), mode="momentum")
put("cross_asset_momentum", S().signal(f"ref_close / {lag('ref_close', 24)} - 1 > 0", 3, 24))
put("cross_asset_momentum_inv", S().signal(f"ref_close / {lag('ref_close', 24)} - 1 < 0", 3, 24))
put("vol_scaled_momentum", S().add(r=f"ref_close / {lag('ref_close', 12)} - 1").signal(f"r / nullif({full('stddev_samp', 'r', 60)}, 0) > 0.5", 3, 60))
put("macro_regime_signal", S().signal(f"(ref_value - ({sma('ref_value', 60)})) / ({full('stddev_samp', 'ref_value', 60)}) < -1", 5, 60))
put("rsi_bb", S().rsi("r", 14).ema("m", "r", 20).add(b=f"m + 1.0 * ({full('stddev_pop', 'r', 20)})").signal(cross("r", "b")), width=1.0)
put("mtf_ma_stack", S().signal(" AND ".join(f"coalesce(close > ({sma('close', n)}), false)" for n in (4, 8, 24))))
put("macd_mtf", S().ema("f1", "close", 12, True).ema("s1", "close", 26, True).ema("g1", "f1 - s1", 9, True).ema("f2", "close", 24, True).ema("s2", "close", 52, True).ema("g2", "f2 - s2", 18, True).signal("f1 - s1 - g1 > 0 AND f2 - s2 - g2 > 0"))
put("squeeze_linreg", S().add(mo=f"close - ((({full('max', 'high', 20)}) + ({full('min', 'low', 20)})) / 2 + ({sma('close', 20)})) / 2", x="CAST(rn AS DOUBLE)").signal(f"CASE WHEN count(mo) OVER {last(20)} = 20 THEN regr_intercept(mo, x) OVER {last(20)} + regr_slope(mo, x) OVER {last(20)} * x > 0 END"))
put("fibo_ma_cross", S().ema("a", "close", 5).ema("b", "close", 8).ema("c", "close", 13).ema("d", "close", 21).add(st="a > b AND b > c AND c > d").signal(f"st AND NOT coalesce({lag('st')}, false)"))
put("hurst", None, window=64, threshold_high=0.6)


@query("cs_momentum", f"WITH {BARS_1D}, m AS (SELECT symbol, ts, lag(close, 5) OVER {ORDER} / lag(close, 40) OVER {ORDER} - 1 AS mom FROM days), r AS (SELECT *, percent_rank() OVER (PARTITION BY ts ORDER BY mom) AS k FROM m WHERE mom IS NOT NULL) SELECT symbol, ts, k >= 0.5 AS signal FROM r")
def cs_momentum(spark, sf):
    return sig.cs_momentum(win.cs_momentum_rank(bars_1d(spark, sf), 40, 5)).select("symbol", "ts", "signal")


def _bands(n: int, m: float) -> Steps:
    f = Steps().true_range().ema("a", "tr", n).add(mid="(open + high + low + close) / 4")
    f.ctes.append(
        f"""r AS (SELECT symbol, rn, ts, close, mid - {m} * a AS up, mid + {m} * a AS dn, 1 AS trend, 0 AS flip FROM {f.at} WHERE rn = 1 UNION ALL
    SELECT symbol, rn, ts, close, up, dn, trend, CASE WHEN trend <> pt THEN trend ELSE 0 END FROM (SELECT s.symbol, s.rn, s.ts, s.close, CASE WHEN r.close > r.up THEN greatest(mid - {m} * a, r.up) ELSE mid - {m} * a END AS up,
      CASE WHEN r.close < r.dn THEN least(mid + {m} * a, r.dn) ELSE mid + {m} * a END AS dn, CASE WHEN r.trend < 0 AND s.close > r.dn THEN 1 WHEN r.trend > 0 AND s.close < r.up THEN -1 ELSE r.trend END AS trend, r.trend AS pt
      FROM r JOIN {f.at} s ON s.symbol = r.symbol AND s.rn = r.rn + 1))"""
    )
    f.at = "r"
    return f


@query("firestorm", _bands(10, 1.8).select("symbol, ts, flip = 1 AS signal").replace("WITH ", "WITH RECURSIVE ", 1))
def firestorm(spark, sf):
    return sig.firestorm(bars_1h(spark, sf)).select("symbol", "ts", "signal")


@query("firestorm_tm", _bands(9, 0.9).select("symbol, ts, round(up, 6) AS stop").replace("WITH ", "WITH RECURSIVE ", 1))
def firestorm_tm(spark, sf):
    return sig.firestorm_tm(bars_1h(spark, sf)).withColumn("stop", F.round("stop", 6))


# --- regimes and combination


def _regime_steps() -> Steps:
    n = 14
    s = Steps().true_range().add(u=f"high - {lag('high')}", d=f"{lag('low')} - low").add(pd="CASE WHEN u > d AND u > 0 THEN u WHEN rn > 1 THEN 0 END", md="CASE WHEN d > u AND d > 0 THEN d WHEN rn > 1 THEN 0 END")
    s.wilder("wt", "CASE WHEN rn > 1 THEN tr END", n).wilder("wp", "pd", n).wilder("wm", "md", n).add(p="CASE WHEN wt > 0 THEN 100 * wp / wt ELSE 0 END", m="CASE WHEN wt > 0 THEN 100 * wm / wt ELSE 0 END")
    s.scan("adx", f"CASE WHEN rn > {n} THEN CASE WHEN p + m > 0 THEN 100 * abs(p - m) / (p + m) ELSE 0 END END", 1 / n, n + 1).ema("e50", "close", 50)
    s.add(ret=f"coalesce(ln(close / {lag('close')}), 0)").add(vol=f"coalesce({full('stddev_pop', 'ret', 100)}, 0)")
    return s.add(vp=f"CASE WHEN count(vol) OVER {last(100)} = 100 THEN len(list_filter(list(vol) OVER {last(100)}, lambda x: x <= vol)) END", fall=f"CASE WHEN rn > 24 THEN 1 - close / max(close) OVER {last(25)} END")


# limits wide enough for the fixture's noisy prices to meet every regime
@query("bar_regime", _regime_steps().select("symbol, ts, CASE WHEN fall >= 0.8 THEN 'crash' WHEN vp >= 90 THEN 'high_vol' WHEN adx > 8 AND close > e50 THEN 'trend_up' WHEN adx > 8 AND close < e50 THEN 'trend_down' ELSE 'range' END AS regime"))
def bar_regime(spark, sf):
    return combine.bar_regime(bars_1h(spark, sf), crash=80.0, trend=8.0).select("symbol", "ts", "regime")


@query("window_regime", f"WITH {BARS_1D}, w AS (SELECT *, date_trunc('quarter', ts) AS q, ln(close / lag(close) OVER (PARTITION BY symbol, date_trunc('quarter', ts) ORDER BY ts)) AS r, close / max(close) OVER (PARTITION BY symbol, date_trunc('quarter', ts) ORDER BY ts) - 1 AS dd FROM days), a AS (SELECT symbol, q, count(*) AS n, (arg_max(close, ts) / arg_min(close, ts) - 1) * 100 AS ret, min(dd) * 100 AS dd, stddev_samp(r) * sqrt(1512) AS vol FROM w GROUP BY 1, 2) SELECT symbol, CAST(q AS DATE) AS window_start, round(ret, 6) AS ret, round(dd, 6) AS dd, round(vol, 6) AS vol, CASE WHEN n < 10 THEN 'range' WHEN dd < -40 THEN 'crash' WHEN ret > 30 THEN 'trend_up' WHEN ret < -30 THEN 'trend_down' WHEN vol > 1.0 THEN 'high_vol' ELSE 'range' END AS regime FROM a")
def window_regime(spark, sf):
    rows = bars_1d(spark, sf).withColumn("window_start", F.to_date(F.date_trunc("quarter", "ts")))
    return combine.window_regime(rows).select("symbol", "window_start", *[F.round(c, 6).alias(c) for c in ("ret", "dd", "vol")], "regime")


@query("market_phase", f"WITH {BARS_1D} SELECT symbol, ts, CASE WHEN f > 0.5 THEN 'bull' WHEN f < -0.3 THEN 'bear' ELSE 'sideways' END AS phase FROM (SELECT *, lead(close, 126) OVER {ORDER} / close - 1 AS f FROM days)")
def market_phase(spark, sf):
    return combine.market_phase(bars_1d(spark, sf)).select("symbol", "ts", "phase")


FLAGS = {"a": f"close > {lag('close', 3)}", "b": "close > open", "c": "volume >= 5", "d": f"high > {lag('high')}"}
LONG = Steps().add(**{k: f"coalesce({v}, false)" for k, v in FLAGS.items()})
LONG.ctes.append(f"long AS (SELECT symbol, ts, 'a' AS indicator, 'exclusive' AS state, a AS signal FROM {LONG.at} UNION ALL SELECT symbol, ts, 'b', 'optional', b FROM {LONG.at} UNION ALL SELECT symbol, ts, 'c', 'optional', c FROM {LONG.at} UNION ALL SELECT symbol, ts, 'd', 'disabled', d FROM {LONG.at})")


def wide(spark, sf):
    b = bars_1h(spark, sf)
    return b.withColumns({k: F.coalesce(F.expr(v.replace(ORDER, "(PARTITION BY symbol ORDER BY ts)")), F.lit(False)) for k, v in FLAGS.items()})


def long(spark, sf):
    states = {"a": "exclusive", "b": "optional", "c": "optional", "d": "disabled"}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("indicator"), F.lit(s).alias("state"), F.col(k).alias("signal")) for k, s in states.items()]))
    return wide(spark, sf).select("symbol", "ts", each.alias("x")).select("symbol", "ts", "x.*")


LONG.at = "long"


@query("combine_exclusive", LONG.select("symbol, ts, coalesce(bool_and(signal) FILTER (state = 'exclusive'), true) AND (count(*) FILTER (state = 'optional') = 0 OR count(*) FILTER (state = 'optional' AND signal) >= 1) AS signal").replace("WHERE true", "GROUP BY symbol, ts"))
def combine_exclusive(spark, sf):
    return combine.combine_exclusive(long(spark, sf), 1)


@query("combine_majority", LONG.select("symbol, ts, count(*) FILTER (signal) >= ceil(count(*) / 2.0) AS signal", "state <> 'disabled'").replace("WHERE state <> 'disabled'", "WHERE state <> 'disabled' GROUP BY symbol, ts"))
def combine_majority(spark, sf):
    return combine.combine_majority(long(spark, sf))


@query("invert_signal_params", "SELECT p_partkey AS config, CASE WHEN p_size % 2 = 0 THEN 'bearish' ELSE 'bullish' END AS mode FROM part WHERE p_size % 3 < 2 UNION ALL SELECT p_partkey, p_type FROM part WHERE p_size % 3 = 2")
def invert_signal_params(spark, sf):
    p = table(spark, sf, "part")
    c = p.select(F.col("p_partkey").alias("config"), F.when(F.col("p_size") % 3 < 2, F.when(F.col("p_size") % 2 == 0, "bullish").otherwise("bearish")).otherwise(F.col("p_type")).alias("mode"))
    return combine.invert_params(c, "mode")


@query("htf_filter", f"WITH {BARS_1H}, d AS (SELECT symbol, date_trunc('day', ts) + INTERVAL 1 DAY AS ts, arg_max(close, ts) > arg_min(open, ts) AS bull FROM bars GROUP BY symbol, date_trunc('day', ts)) SELECT b.symbol, b.ts, coalesce(b.close > b.open AND bull, false) AS signal FROM bars b ASOF LEFT JOIN d ON b.symbol = d.symbol AND b.ts >= d.ts")
def htf_filter(spark, sf):
    b = bars_1h(spark, sf)
    return combine.htf_filter(b.withColumn("signal", F.col("close") > F.col("open")), b, "1d", long=True).select("symbol", "ts", "signal")


@query("optional_range", "SELECT p_brand, CASE WHEN o = 0 THEN 0 WHEN e = 0 THEN least(2, o) ELSE 1 END AS lo, least(CASE WHEN e >= 2 THEN 2 WHEN e = 1 THEN 3 ELSE 4 END, o) AS hi FROM (SELECT p_brand, CAST(count(DISTINCT p_name) FILTER (p_size < 10) AS INT) AS e, CAST(count(DISTINCT p_type) FILTER (p_size > 45) AS INT) AS o FROM part GROUP BY 1)")
def optional_range(spark, sf):
    p = table(spark, sf, "part").groupBy("p_brand").agg(F.countDistinct(F.when(F.col("p_size") < 10, F.col("p_name"))).cast("int").alias("e"), F.countDistinct(F.when(F.col("p_size") > 45, F.col("p_type"))).cast("int").alias("o"))
    return p.select("p_brand", *combine.optional_range(F.col("e"), F.col("o")))


@query("resolve_timeframe", "SELECT base, up, r AS resolved, count(*) AS n FROM (SELECT l_orderkey % 12 AS base_n, CAST(l_linenumber % 3 AS INT) AS up FROM lineitem) JOIN (VALUES (0, '1m', '3m', '5m'), (1, '3m', '5m', '15m'), (2, '5m', '15m', '30m'), (3, '15m', '30m', '45m'), (4, '30m', '45m', '1h'), (5, '45m', '1h', '4h'), (6, '1h', '4h', '1d'), (7, '4h', '1d', '1w'), (8, '1d', '1w', '1M'), (9, '1w', '1M', '1M'), (10, '1M', '1M', '1M'), (11, 'odd', '1M', '1M')) AS v(base_n, base, a, b) USING (base_n) CROSS JOIN LATERAL (SELECT CASE up WHEN 0 THEN base WHEN 1 THEN a ELSE b END AS r) GROUP BY ALL")
def resolve_timeframe(spark, sf):
    names = F.array(*map(F.lit, (*combine.LADDER, "odd")))
    li = table(spark, sf, "lineitem").select(F.element_at(names, (F.col("l_orderkey") % 12 + 1).cast("int")).alias("base"), (F.col("l_linenumber") % 3).cast("int").alias("up"))
    return combine.resolve_timeframe(li, "base", "up").groupBy("base", "up", "resolved").agg(F.count("*").alias("n"))


@query("signal_export", LONG.select("symbol, ts, string_agg(indicator, ',' ORDER BY indicator) AS fired", "signal AND state <> 'disabled'") + " GROUP BY symbol, ts")
def signal_export(spark, sf):
    return combine.signal_export(long(spark, sf).where("state <> 'disabled'"))


@query("last_bar_signal", Steps().add(f="close > open").add(p=lag("f")).select("symbol, arg_max(f, ts) AS entry, arg_max(coalesce(p, false) AND NOT f, ts) AS exit") + " GROUP BY symbol")
def last_bar_signal(spark, sf):
    return combine.last_bar_signal(bars_1h(spark, sf).withColumn("signal", F.col("close") > F.col("open")))


@query("strategy_signal_join", LONG.select("symbol, ts, s.spec, bool_and(signal) AS signal").replace("FROM long", "FROM long JOIN (SELECT * FROM (VALUES ('x', 'a'), ('x', 'b'), ('y', 'b'), ('y', 'c'), ('y', 'd')) AS v(spec, ind)) s ON s.ind = indicator") + " GROUP BY symbol, ts, s.spec")
def strategy_signal_join(spark, sf):
    specs = spark.createDataFrame([("x", ["a", "b"]), ("y", ["b", "c", "d"])], "spec string, entry array<string>")
    return combine.strategy_signals(specs, long(spark, sf))
