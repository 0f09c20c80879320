"""Rules and fixed values against numbers worked out by hand or by plain loops."""

from __future__ import annotations

import datetime
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats, timeframes
from tidemark.operators import asof, combine, edge, grid, overfit, perf
from tidemark.operators import portfolio as pf
from tidemark.operators import signals as sig
from tidemark.operators import windows as win
from tidemark.sources import bars as store

HOUR = datetime.timedelta(hours=1)
T0 = datetime.datetime(2024, 1, 1)


def closes(spark, values, symbol="a"):
    rows = [(symbol, T0 + i * HOUR, v, v * 1.01, v * 0.99, v, 1.0) for i, v in enumerate(map(float, values))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def test_costs_and_bars_a_year(spark):
    rows = [("BTCUSDT", "1h"), ("AVAXUSDT", "1m"), ("XRPUSDT", "3m"), ("EURUSD", "1d"), ("SPY", "1h"), ("TSLA", "15m"), ("IBM", "2h")]
    got = perf.slippage(spark.createDataFrame(rows, "symbol string, timeframe string")).collect()
    assert {(r.symbol, r.timeframe): r.slippage_pct for r in got} == {("BTCUSDT", "1h"): 0.01, ("AVAXUSDT", "1m"): 0.035, ("XRPUSDT", "3m"): 0.015, ("EURUSD", "1d"): 0.012, ("SPY", "1h"): 0.006, ("TSLA", "15m"): 0.013, ("IBM", "2h"): 0.008}
    tf = spark.createDataFrame([("1h", True), ("1h", False), ("12h", False), ("12h", True), ("1M", True)], "tf string, stock boolean")
    got = [r[0] ** 2 for r in tf.select(perf.annualisation(F.col("tf"), F.col("stock"))).collect()]
    assert got == pytest.approx([1764, 8760, 730, 8760, 8760])


def test_timeframe_spellings_and_ladder(spark):
    raw = ["1Min", "5min", "1Hour", "4Hour", "1W-MON", "1ME", "D", "240", "45", "2h", "1m", "1M"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "x string").select(timeframes.normalize_timeframe(F.col("x"))).collect()]
    assert got == ["1m", "5m", "1h", "4h", "1w", "1M", "1d", "4h", "45m", None, "1m", "1M"]
    rows = spark.createDataFrame([("15m", 1), ("1m", 1), ("1m", 2), ("45m", 1), ("1w", 2), ("1M", 1), ("odd", 1), ("odd", 0)], "tf string, up int")
    assert [r.resolved for r in combine.resolve_timeframe(rows, "tf", "up").collect()] == ["30m", "3m", "5m", "1h", "1M", "1M", "1M", "odd"]


def test_optional_ranges(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (0, 3), (0, 9), (1, 2), (1, 9), (2, 1), (5, 9), (3, 0)], "e int, o int")
    got = [tuple(r) for r in rows.select(*combine.optional_range(F.col("e"), F.col("o"))).collect()]
    assert got == [(0, 0), (1, 1), (2, 3), (2, 4), (1, 2), (1, 3), (1, 1), (1, 2), (0, 0)]


def regime_loop(h, l, c):
    """The bar regimes of one series, bar by bar."""
    n = len(c)
    tr, pd_, md = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(1, n):
        tr[i] = max(h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1]))
        u, d = h[i] - h[i - 1], l[i - 1] - l[i]
        pd_[i], md[i] = (u if u > d and u > 0 else 0), (d if d > u and d > 0 else 0)
    s = [x[1:15].sum() for x in (tr, pd_, md)]
    dx, adx, ema, ret = np.zeros(n), np.zeros(n), np.zeros(n), np.r_[0, np.diff(np.log(c))]
    for i in range(14, n):
        if i > 14:
            s = [a - a / 14 + x[i] for a, x in zip(s, (tr, pd_, md))]
        p, m = (100 * s[1] / s[0], 100 * s[2] / s[0]) if s[0] > 0 else (0, 0)
        dx[i] = 100 * abs(p - m) / (p + m) if p + m > 0 else 0
    adx[28] = dx[14:29].mean()
    for i in range(29, n):
        adx[i] = (adx[i - 1] * 13 + dx[i]) / 14
    ema[0] = c[0]
    for i in range(1, n):
        ema[i] = 2 / 51 * c[i] + (1 - 2 / 51) * ema[i - 1]
    vol = np.array([ret[i - 99 : i + 1].std() if i >= 99 else 0.0 for i in range(n)])
    rank = [(vol[i - 99 : i + 1] <= vol[i]).mean() * 100 if i >= 99 else 0 for i in range(n)]
    out = []
    for i in range(n):
        crash = i >= 24 and 1 - c[i] / c[i - 24 : i + 1].max() >= 0.10
        out.append("crash" if crash else "high_vol" if rank[i] >= 90 else "trend_up" if adx[i] > 25 and c[i] > ema[i] else "trend_down" if adx[i] > 25 and c[i] < ema[i] else "range")
    return out


def test_bar_regime_is_the_loop(spark):
    rng = np.random.default_rng(8)
    c = 100 * np.exp(np.cumsum(rng.normal(0, np.r_[np.full(200, 0.004), np.full(150, 0.02), np.full(250, 0.003)]) + np.r_[np.full(400, 0.0), np.full(200, 0.001)]))
    h, l = c * (1 + rng.random(600) * 0.004), c * (1 - rng.random(600) * 0.004)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=600, freq="h"), "open": c, "high": h, "low": l, "close": c, "volume": 1.0}))
    got = [r.regime for r in combine.bar_regime(df).orderBy("ts").collect()]
    assert got == regime_loop(h, l, c) and len(set(got)) == 5


def test_window_regimes_and_phases(spark):
    def regime(values, market="crypto"):
        df = closes(spark, values).withColumn("window_start", F.lit(1))
        return combine.window_regime(df, market).first().regime

    assert regime([100] * 9 + [10]) == "crash" and regime([100, 10]) == "range"  # too few bars
    assert regime(np.linspace(100, 140, 12)) == "trend_up" and regime(np.linspace(100, 65, 12)) == "trend_down"
    assert regime(np.linspace(100, 115, 12)) == "range" and regime(np.linspace(100, 115, 12), "stocks") == "trend_up"
    assert regime([100, 104] * 6) == "high_vol" and regime([100, 100.1] * 6) == "range"
    phases = combine.market_phase(closes(spark, [100, 100, 100, 151, 69, 120]), 3).orderBy("ts").collect()
    assert [r.phase for r in phases] == ["bull", "bear", "sideways", "sideways", "sideways", "sideways"]


@pytest.mark.parametrize("n", [2000, 50_000])
def test_slow_averages_keep_their_history(spark, n):
    """300,000 rows: carries go back over more than a thousand blocks, none is cut."""
    m = 300_000
    df = spark.range(m).select(F.lit("a").alias("symbol"), F.col("id").alias("ts"), (100 + F.sin(F.col("id") / 7000) * 50 + F.pmod(F.xxhash64("id"), F.lit(1000)) / 100).alias("close"))
    pdf = df.select("ts", "close").toPandas().sort_values("ts")
    want = pdf["close"].ewm(span=n, adjust=False).mean().to_numpy()
    for got in (win.ema(df, "e", "close", n), win.linear_scans(df, {"e": ("close", 2 / (n + 1), 1), "fast": ("close", 0.5, 1)})):
        np.testing.assert_allclose(got.select("ts", "e").toPandas().sort_values("ts")["e"].to_numpy(), want, rtol=1e-9)


def test_a_chain_of_links_is_one_cluster(spark):
    names = [f"s{i:03d}" for i in range(230)]
    order = np.random.default_rng(2).permutation(200)
    pairs = [(min(names[a], names[b]), max(names[a], names[b]), -0.9) for a, b in zip(order, order[1:])] + [(names[210], names[211], 0.95), (names[0], names[220], 0.2)]
    spark.sparkContext.setCheckpointDir("/tmp/tidemark-test-checkpoints")
    got = {r.strategy_id: r.cluster for r in pf.clusters(spark.createDataFrame(pairs, "a string, b string, rho double"), spark.createDataFrame([(x,) for x in names], "strategy_id string")).collect()}
    assert all(got[x] == names[0] for x in names[:200]) and got[names[211]] == names[210] and got[names[220]] == names[220] and len(got) == 230


def returns(spark, series):
    return spark.createDataFrame([(c, t, float(x)) for c, xs in series.items() for t, x in enumerate(xs)], "candidate string, t long, ret double")


def test_half_splits_are_those_of_the_definition(spark):
    rng = np.random.default_rng(4)
    series = {k: rng.normal(0.001 * i, 0.01, 67) for i, k in enumerate("abcd")}
    score = {}
    for k, x in series.items():
        for b in range(6):
            part = x[b * 11 : (b + 1) * 11 if b < 5 else 67][1:]
            score[k, b] = part.mean() / part.std(ddof=1)
    logits = []
    for inside in itertools.combinations(range(6), 3):
        mean = lambda k, bs: np.mean([score[k, b] for b in bs])
        best = max(series, key=lambda k: mean(k, inside))
        outside = [b for b in range(6) if b not in inside]
        rank = sorted(series, key=lambda k: mean(k, outside)).index(best) / 3
        w = min(max(rank, 0.01), 0.99)
        logits.append(math.log(w / (1 - w)))
    got = overfit.pbo(returns(spark, series), 6).first()
    assert (got.pbo, got.n_splits) == (np.mean([x <= 0 for x in logits]), 20) and got.mean_logit == pytest.approx(np.mean(logits))
    both = {k: [x[b * 11 : (b + 1) * 11].sum() for b in range(6)] for k, x in series.items()}
    for r in overfit.temporal_pbo(returns(spark, series), 6).collect():
        over = [sum(both[r.candidate][b] for b in c) > 0 and sum(both[r.candidate]) - sum(both[r.candidate][b] for b in c) <= 0 for c in itertools.combinations(range(6), 3)]
        assert (r.temporal_pbo, r.overfit, r.n_splits) == (np.mean(over), sum(over), 20)
    assert overfit.pbo(returns(spark, series), 6, most=7).first().n_splits == 7


def test_alpha_decay_needs_a_sure_slope(spark):
    rng = np.random.default_rng(6)
    unit = rng.normal(0, 1, 25)
    unit = (unit - unit.mean()) / unit.std(ddof=1)
    falling = np.concatenate([(0.9 - 0.1 * i + unit) * 0.01 for i in range(8)])
    noisy = np.concatenate([((0.5 if i % 2 else -0.4) - 0.01 * i + unit) * 0.01 for i in range(8)])
    got = {r.candidate: r for r in overfit.alpha_decay(returns(spark, {"falling": np.r_[falling, 0.009 + 0 * unit[:5]], "noisy": noisy, "short": falling[:50]})).collect()}
    assert got["falling"].status == "decaying" and got["falling"].n_points == 8 and got["noisy"].status == "stable" and got["noisy"].ratio == pytest.approx((0.5 - 0.07) / -0.4)
    assert got["short"].n_points == 2 and got["short"].p is None and got["short"].status == "stable"  # 50 rows are two windows of 25


def test_half_life_counts_from_the_first_horizon(spark):
    rows = [("x", 1, 0.1), ("x", 2, 1.0), ("x", 4, 0.6), ("y", 1, 1.0), ("y", 2, 0.6), ("y", 4, 0.4), ("z", 1, -1.0), ("z", 2, -0.1)]
    got = {r.k: (r.peak, r.half_life) for r in edge.half_life(spark.createDataFrame(rows, "k string, horizon int, excess double"), "k").collect()}
    assert got == {"x": (1.0, 1), "y": (1.0, 4)}


def test_edge_ratio_and_persistence(spark):
    rows = [("a", 1, 1.0, x) for x in (0.02, 0.04, -0.01)] + [("a", 1, 0.0, 0.0)]
    e = edge.edge_stats(spark.createDataFrame(rows, "symbol string, horizon int, signal double, fwd double"), 720.0).first()
    assert e.edge_ratio == pytest.approx((2 / 3 * 0.03) / (1 / 3 * 0.01)) and e.per_month == 3
    base = edge.baseline(closes(spark, range(100, 130)), [2, 12])
    want = {2: np.mean([102 / 100 - 1, 112 / 110 - 1, 122 / 120 - 1]), 12: np.mean([112 / 100 - 1, 124 / 112 - 1])}
    assert {r.horizon: r.baseline for r in base.collect()} == pytest.approx(want)
    entries = spark.createDataFrame([(2, 100.0, 100.0 + x) for x in (1, 2, 3, 4, 5)] + [(12, 1.0, 2.0)] * 4, "horizon int, entry double, exit double")
    p = edge.persistence(entries, base).collect()
    assert len(p) == 1 and p[0].t == pytest.approx(0.03 / (np.std([0.01, 0.02, 0.03, 0.04, 0.05], ddof=1) / 5**0.5)) and p[0].p == pytest.approx(2 * stats.t_sf(p[0].t, 4)) and p[0].excess == pytest.approx(0.03 - want[2])


def test_ic_stability_takes_whole_windows(spark):
    rng = np.random.default_rng(3)
    rows = [("a", 1, T0 + i * HOUR, float(i % 4 == 0), float(rng.normal(0.5 * (i % 4 == 0)))) for i in range(75)]
    got = edge.ic_stability(spark.createDataFrame(rows, "symbol string, horizon int, ts timestamp, signal double, fwd double"), 24).first()
    ics = [pd.DataFrame(rows[k : k + 24])[[3, 4]].corr("spearman").iloc[0, 1] for k in (0, 24, 48)]
    assert got.n_windows == 3 and got.mean_ic == pytest.approx(np.mean(ics)) and got.sd_ic == pytest.approx(np.std(ics))
    assert edge.ic_stability(spark.createDataFrame(rows, "symbol string, horizon int, ts timestamp, signal double, fwd double"), 30).count() == 0  # two windows are too few


def test_finalists_pass_all_three_gates(spark):
    rows = [(c, s, 1, ic, 400) for c, ics in (("good", (0.3, 0.2, -0.01)), ("lucky", (0.3, -0.01, -0.01)), ("weak", (0.03, 0.03, 0.03)), ("low", (0.01, 0.02, 0.3))) for s, ic in zip("xyz", ics)]
    got = edge.finalists(spark.createDataFrame(rows, "config string, symbol string, horizon int, ic double, n long"), 1).collect()
    assert sorted((r.config, r.n_significant) for r in got) == [("good", 2), ("low", 1)]


def test_null_and_rolling_verdicts(spark):
    runs = spark.createDataFrame([(s, p) for s, ps in ((1, (1, 0, 0, 0)), (2, (0, 0, 0, 1))) for p in map(bool, ps)], "seed int, passed boolean")
    got = overfit.null_hit_rate(runs, 3, 4).collect()
    assert {r.seed: r.rate for r in got} == {1: 0.25, 2: 0.25} and got[0].p == pytest.approx(4 * 0.25**3 * 0.75 + 0.25**4) and not got[0].valid
    none = overfit.null_hit_rate(runs.withColumn("passed", F.lit(False)), 3, 4).first()
    assert (none.null_rate, none.p, none.valid) == (0, 0, True)
    windows = [("good", w, f"r{w % 4}", 1.0 + 0.1 * (w % 3), 5.0, 20.0) for w in range(8)] + [("deep", w, f"r{w % 4}", 1.0 + 0.1 * (w % 3), 5.0, 45.0) for w in range(8)]
    windows += [("fading", w, f"r{w % 4}", 2.0 - 0.2 * w + 0.01 * (w % 2), 5.0, 20.0) for w in range(8)] + [("few", w, "r1", 1.0, 5.0, 20.0) for w in range(2)] + [("one", w, "r1", 1.0 + w % 2, 5.0, 20.0) for w in range(8)]
    df = spark.createDataFrame(windows, "method string, window int, regime string, sharpe double, total_return double, max_dd double")
    sides = spark.createDataFrame([("long", 2.0), ("short", -1.0), ("long", 4.0)], "direction string, total_return double")
    got = {r.method: r for r in overfit.rolling_summary(df, sides).collect()}
    assert {m: r.passed for m, r in got.items()} == {"good": True, "deep": False, "fading": False, "few": False, "one": False}
    assert got["good"].p == pytest.approx(1 / 256) and got["fading"].status == "decaying" and got["few"].status == "insufficient" and (got["one"].long, got["one"].short) == (3.0, -1.0)
    assert [m for m, r in got.items() if r.best] == ["deep"]


def test_ruin_and_tails(spark):
    paths = spark.createDataFrame([(0, 0.4, 0.7, 1.0), (1, 0.6, 0.6, 1.0), (2, 2.0, 0.5, -1.0), (3, 1.0, 0.1, 1.0)], "sim int, terminal double, max_dd double, sharpe double")
    got = overfit.summary(paths).first()
    assert (got.ruin, got.p_negative) == (0.25, 0.25) and got.d[2] == pytest.approx(np.percentile([0.7, 0.6, 0.5, 0.1], 99))
    x = np.r_[np.linspace(-0.05, 0.08, 40), -0.01, -0.01, 0.02]
    t = overfit.tail_risk(returns(spark, {"a": x})).first()
    lo, hi = np.percentile(x, [5, 95])
    assert t.tail_ratio == pytest.approx(x[x >= hi].mean() / abs(x[x <= lo].mean())) and t.losing_streak == int((np.linspace(-0.05, 0.08, 40) < 0).sum())


def test_volatility_regimes_are_the_loop(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(0.001, np.r_[np.full(80, 0.004), np.full(80, 0.012), np.full(80, 0.006)])
    vol = np.array([x[i - 60 : i].std(ddof=1) if i >= 60 else np.nan for i in range(240)])
    q1, q3 = np.percentile(vol[60:], [25, 75])
    e = np.cumprod(1 + x)
    dd = 1 - e / np.maximum.accumulate(e)
    name = ["deep_drawdown" if d > 0.05 else "high_vol" if v > q3 else "low_vol" if v < q1 else "normal" for d, v in zip(dd[60:], vol[60:])]
    got = {r.regime: r for r in overfit.vol_regime_perf(returns(spark, {"a": x})).collect()}
    sharpe = {}
    for k in set(name):
        part = x[60:][np.array(name) == k]
        assert got[k].n == len(part)
        sharpe[k] = part.mean() / part.std(ddof=1) if len(part) >= 10 else 0.0
        assert got[k].sharpe == pytest.approx(sharpe[k])
    assert got["normal"].stress_ratio == pytest.approx(sharpe.get("high_vol", 0) / sharpe["normal"])


def test_superiority_sees_a_better_and_a_like_series(spark):
    rng = np.random.default_rng(9)
    bench = rng.normal(0, 0.01, 300)
    rows = returns(spark, {"better": bench + 0.002 + rng.normal(0, 0.004, 300), "same": bench, "worse": bench - 0.002 + rng.normal(0, 0.004, 300), "noise": rng.normal(0, 0.01, 300)})
    b = spark.createDataFrame([(t, float(x)) for t, x in enumerate(bench)], "t long, ret double")
    got = {r.candidate: r for r in overfit.superiority(rows, b, 300).collect()}
    p = {k: r.p for k, r in got.items()}
    assert p["better"] < 0.01 and p["same"] == 1.0 and p["worse"] > 0.9
    for r in got.values():
        assert r.lower <= r.consistent <= r.upper == r.p and (r.excess <= 0 or r.lower == r.upper)
    assert got["worse"].lower < 0.7 < got["worse"].upper  # centred on 0 the drawn means lie around the excess
    assert overfit.superiority(rows.where("t < 9"), b, 50).count() == 0 and overfit.superiority(rows.where("t < 10"), b, 50).count() == 4
    f = {r.candidate: (r.passed_pbo, r.passed_dsr, r.passed_spa) for r in overfit.funnel(rows, b, 2, 8, pbo_limit=1.0, dsr_limit=0.5, reps=300).collect()}
    assert f["better"] == (True, True, True) and f["worse"] == (True, False, False)


@pytest.mark.parametrize("n", [10, 400])
def test_stationary_blocks(spark, n):
    """Every repetition takes n rows; lengths are geometric with the mean of the definition, starts uniform."""
    got = overfit.stationary_blocks(spark.createDataFrame([("a", n)], "candidate string, n long"), 400, 3).toPandas()
    assert (got.groupby("rep")["take"].sum() == n).all() and got["start"].between(0, n - 1).all() and got["rep"].nunique() == 400
    size = int(n**0.5)
    whole = got[got.groupby("rep").cumcount(ascending=False) > 0] if n > 100 else got
    if n > 100:
        assert whole["take"].mean() == pytest.approx(size, rel=0.1) and (whole["take"] == 1).mean() == pytest.approx(1 / size, abs=0.02)
        assert got["start"].mean() == pytest.approx((n - 1) / 2, rel=0.05)


def test_sizes_and_gates(spark):
    t = spark.createDataFrame([(100.0, 98.0, 1.0, 0.6, 1.5), (100.0, 100.0, 0.0, 0.3, 1.0), (100.0, 99.99, 0.001, 1.0, 2.0)], "price double, stop double, atr double, win double, payoff double")
    got = perf.position_size(t, F.lit(10_000.0), 1.0, F.col("stop"), F.col("atr"), F.col("win"), F.col("payoff"), F.col("price"), most_risk_pct=2.0, atr_multiple=4.0, least=0.5, most=80.0).collect()
    assert [(r.fixed, r.by_atr, r.kelly) for r in got] == [(50.0, 25.0, 80.0), (0.0, 0.0, 0.0), (80.0, 80.0, 0.0)]
    c = [("s", i, e) for i, e in enumerate([100.0, 95.0, 85.0, 100.0, 79.0, 100.0])]
    g = spark.createDataFrame([(*r, 4.0, 3.0 + 3 * (r[1] == 3), 1.0, 90.0 + 200 * (r[1] == 1)) for r in c], "strategy_id string, t long, equity double, open_risk double, proposed_risk double, gross double, proposed_notional double")
    got = [r.reason for r in perf.drawdown_gate(g, 15.0, 20.0, 9.0, 2.5).orderBy("t").collect()]
    assert got == ["approved", "gross", "drawdown", "heat", "killed", "killed"]


def test_selection_is_the_greedy_loop(spark):
    rng = np.random.default_rng(21)
    names = [f"s{i}" for i in range(9)]
    x = rng.normal(0.0005, 0.01, (200, 9)) + rng.normal(0, 0.006, (200, 1))
    rows = spark.createDataFrame([(names[j], t, float(x[t, j])) for t in range(200) for j in range(9)], "strategy_id string, t long, ret double")
    kind, market = [f"k{j % 3}" for j in range(9)], [f"m{j // 4}" for j in range(9)]
    st = spark.createDataFrame([(names[j], float(x[:, j].mean() / x[:, j].std(ddof=1)), float(x[:, j].std(ddof=1)), kind[j], market[j]) for j in range(9)], "strategy_id string, sharpe double, vol double, archetype string, market string")
    got = [r.strategy_id for r in pf.select_greedy(st, pf.covariances(rows), pf.correlations(rows), 6, 2, 2, 0.32).orderBy("step").collect()]
    cov, rho = np.cov(x.T), np.abs(np.corrcoef(x.T))
    chosen = [int(np.argmax(x.mean(axis=0) / x.std(axis=0, ddof=1)))]
    while len(chosen) < 6:
        best = None
        for j in range(9):
            s = chosen + [j]
            if j in chosen or sum(kind[i] == kind[j] for i in chosen) >= 2 or sum(market[i] == market[j] for i in chosen) >= 2:
                continue
            if np.mean([rho[a, b] for a, b in itertools.combinations(s, 2)]) > 0.32:
                continue
            ratio = np.sqrt(np.diag(cov)[s]).mean() / np.sqrt(cov[np.ix_(s, s)].sum() / len(s) ** 2)
            best = max(best or (0, 0), (ratio, j))
        if not best:
            break
        chosen.append(best[1])
    assert got == [names[j] for j in chosen] and len(chosen) > 2


def test_hurst_over_blocks_is_the_loop(spark):
    rng = np.random.default_rng(14)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 1500)))
    df = closes(spark, c)
    got = [r.signal for r in sig.hurst(df, window=32, threshold_high=0.6).orderBy("ts").collect()]
    r = np.r_[np.nan, np.diff(np.log(c))]
    assert got == [bool(i >= 32 and stats.hurst_exponent(r[i - 31 : i + 1]) > 0.6) for i in range(1500)]


def test_read_keeps_the_last_bar_and_refuses_an_empty_range(spark, tmp_path):
    path = f"file://{tmp_path}/bars"
    schema = "exchange string, symbol string, timeframe string, period string, ts timestamp, open double, high double, low double, close double, volume double"
    row = lambda close: ("ex", "a", "1h", "2024-01", T0, 1.0, 2.0, 0.5, close, 1.0)
    for close in (1.0, 2.0):
        spark.createDataFrame([row(close)], schema).write.mode("append").partitionBy("exchange", "symbol", "timeframe", "period").parquet(path)
    got = store.read_bars(spark, path, "ex", "a", "1h").collect()
    assert [r.close for r in got] == [2.0]
    with pytest.raises(ValueError, match="no bars"):
        store.read_bars(spark, path, "ex", "a", "1h", "2025-01-01")
    info = store.inventory(spark, path).first()
    assert info.n_files == 2 and info.mb > 0 and info.source.endswith("timeframe=1h")


def test_slow_series_over_stretches_of_time(spark):
    slow = spark.createDataFrame([("x", T0, 1.0), ("x", T0 + 100 * 24 * HOUR, 2.0), ("y", T0 + 3 * HOUR, 5.0)], "key string, ts timestamp, value double")
    base = spark.createDataFrame([(s, T0 + h * HOUR) for s in "ab" for h in (-1, 0, 2, 3, 2399, 2400, 9000)], "symbol string, ts timestamp")
    got = {(r.symbol, int((r.ts - T0) / HOUR)): (r.x, r.y, r.none) for r in asof.macro_align_by_symbol(base, slow, ["x", "y", "none"]).collect()}
    assert all(got["a", h] == got["b", h] == w for h, w in {-1: (None, None, None), 0: (1.0, None, None), 2: (1.0, None, None), 3: (1.0, 5.0, None), 2399: (1.0, 5.0, None), 2400: (2.0, 5.0, None), 9000: (2.0, 5.0, None)}.items())


def test_indicator_combinations_and_importance_threshold(spark):
    c = grid.combinations(spark, {"b": False, "a": True}, [1, 2], [1.5], [50.0, 100.0])
    sets = {tuple(r.indicators) for r in c.collect()}
    assert c.count() == 9 * 2 * 2 * 1 * 2 and len(sets) == 18 and () in sets and ("a:T1+T3", "b") in sets
    t = spark.range(200).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("flat"), (F.col("id") * 2.0).alias("y"))
    assert [r.feature for r in grid.feature_importance(t, [], ["x", "flat"], "y", 2, threshold=0.01).collect()] == ["x"]


def test_importances_of_many_trials_in_small_tasks(spark, monkeypatch):
    """Neither the table's layout nor copies of all its rows change anything, and no task gets many more rows than wanted."""
    monkeypatch.setattr(grid, "TRIALS", 2000)
    n = 24_000
    t = spark.range(n).select((F.col("id") % 7).cast("string").alias("kind"), (F.col("id") * 7919 % 1009).cast("double").alias("x"), F.col("id").cast("double").alias("z")).withColumn("y", F.col("x") * 2 + F.col("z") / 100)
    dealt = grid.weighted(t.coalesce(1), "n__")
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and len(sizes) == 12 and max(sizes) < 2500
    twice = grid.weighted(t.union(t), "n__")
    assert twice.agg(F.count("*"), F.sum("n__"), F.min("n__")).first()[:] == (n, 2.0 * n, 2.0)
    importances = [{r.feature: r.importance for r in grid.feature_importance(rows, ["kind"], ["x", "z"], "y", 2).collect()} for rows in (t.coalesce(1), t.repartition(5))]
    assert importances[0] == importances[1] and sum(importances[0].values()) == pytest.approx(1)
    assert importances[0]["x"] > importances[0]["z"] > importances[0]["kind"]


def test_rebalanced_weights_drift_and_return(spark):
    r = {"a": [0.1, 0.0, 0.0, 0.1, 0.0], "b": [0.0, 0.2, 0.0, 0.0, 0.0]}
    rows = spark.createDataFrame([(k, t, x) for k, v in r.items() for t, x in enumerate(v)], "strategy_id string, t long, ret double")
    w = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "strategy_id string, weight double")
    got = {(x.strategy_id, x.t): (x.equity, x.weight) for x in pf.ensemble_weights(rows, w, 100.0, 3).collect()}
    assert got["a", 0] == pytest.approx((105, 55 / 105)) and got["b", 1] == pytest.approx((115, 60 / 115)) and got["a", 2] == pytest.approx((115, 0.5)) and got["a", 3] == pytest.approx((115 * 1.05, 0.55 / 1.05))
    assert pf.rebalance_bars("weekly", 24) == 168
    c = {(x.strategy_id, x.t): x.contribution for x in pf.ensemble_contributions(rows, w, 100.0).collect()}
    assert c["a", 4] == pytest.approx(50 * 1.21) and c["b", 0] == pytest.approx(50)


# --- signals by their rules


def fired(df, name, **params):
    return [r.signal for r in sig.compute(name, df, **params).orderBy("ts").collect()]


def held(raw, n):
    return [any(raw[max(0, i - n + 1) : i + 1]) for i in range(len(raw))]


def test_bollinger_fires_where_the_close_reaches_a_band(spark):
    # averages of 3 and population deviations of 3, worked out: 10 10 10 | 13 7 | 10 16 4
    values = [10, 10, 10, 13, 7, 10, 16, 4]
    bands = [(np.mean(values[i - 2 : i + 1]), np.std(values[i - 2 : i + 1])) if i >= 2 else (math.nan, math.nan) for i in range(8)]
    lower = [False] * 3 + [values[i] <= bands[i][0] - bands[i][1] and values[i - 1] > bands[i - 1][0] - bands[i - 1][1] for i in range(3, 8)]
    upper = [False] * 3 + [values[i] >= bands[i][0] + bands[i][1] and values[i - 1] < bands[i - 1][0] + bands[i - 1][1] for i in range(3, 8)]
    # bar 4 (7: mean 10, deviation 2.449) and bar 7 (4: mean 10, deviation 4.899) reach the lower band from above it
    assert lower == [False, False, False, False, True, False, False, True] and upper[6]
    df = closes(spark, values)
    assert fired(df, "bollinger", period=3, nbdev=1.0, hold_bars=1) == lower and fired(df, "bollinger", period=3, nbdev=1.0, hold_bars=2) == held(lower, 2)
    assert fired(df, "bollinger", period=3, nbdev=1.0, mode="upper", hold_bars=1) == upper


def test_slow_columns_are_filled_before_their_rule(spark):
    """Values at every third bar; z-scores, changes and averages see the last known one."""
    known = [1.0, None, None, 1.2, None, None, 0.9, None, None, 5.0, None, None, 1.0, None, None]
    filled = pd.Series(known).ffill().to_numpy()
    base = closes(spark, [100, 101, 99, 98, 97, 99, 96, 95, 94, 93, 92, 91, 95, 96, 97])
    rows = spark.createDataFrame([(T0 + i * HOUR, v) for i, v in enumerate(known)], "ts timestamp, v double")
    df = base.join(rows, "ts").drop("v_").withColumnRenamed("v", "x")
    price = np.array([100, 101, 99, 98, 97, 99, 96, 95, 94, 93, 92, 91, 95, 96, 97.0])
    z = [None if i < 4 else (filled[i] - filled[i - 4 : i].mean()) / filled[i - 4 : i].std(ddof=1) if filled[i - 4 : i].std(ddof=1) > 1e-12 else None for i in range(15)]
    for name in ("funding_rate", "basis", "long_short_ratio"):
        got = fired(df.withColumnRenamed("x", name), name, lookback=4, extreme_z=1.4, mode="contrarian_short" if name == "long_short_ratio" else "reversal_short", hold_bars=1)
        assert got == [v is not None and v > 1.4 for v in z] and sum(got) >= 1
    up = [i >= 3 and price[i] < price[i - 3] and filled[i] > filled[i - 3] for i in range(15)]
    assert fired(df.withColumnRenamed("x", "open_interest"), "oi_divergence", period=3, hold_bars=1) == up and any(up)
    mean = [filled[i - 3 : i + 1].mean() if i >= 4 else None for i in range(15)]  # the first four bars are held back, not three
    assert fired(df.withColumnRenamed("x", "taker_buy_ratio"), "taker_volume", lookback=4, threshold=1.0) == [m is not None and m > 1.0 for m in mean]
    assert fired(df.withColumnRenamed("x", "yield_spread"), "yield_curve", lookback=4, mode="steepening") == [m is not None and f > m for f, m in zip(filled, mean)]
    assert fired(df.withColumnRenamed("x", "yield_spread"), "yield_curve", threshold=1.1) == (filled > 1.1).tolist()
    for column, calm in (("credit_spread", lambda f, m: f > m), ("hy_spread", lambda f, m: f < m)):
        on = [m is not None and bool(calm(f, m)) for f, m in zip(filled, mean)]
        assert fired(df.withColumnRenamed("x", column), "credit_spread", lookback=4) == on
        assert fired(df.withColumnRenamed("x", column), "credit_spread", lookback=4, mode="momentum") == [v and not w for v, w in zip(on, [False, *on])]
    logs = np.r_[np.nan, np.diff(np.log(price))]
    real = [np.var(logs[i - 3 : i + 1], ddof=1) * 252 if i >= 4 else math.nan for i in range(15)]
    assert fired(df.withColumnRenamed("x", "vix"), "vrp", realized_window=4, mode="risk_off") == [bool((f / 100) ** 2 - r < 0) for f, r in zip(filled, real)]
    assert fired(df.withColumnRenamed("x", "cs_momentum_rank"), "cs_momentum", rank_threshold=1.0) == (filled >= 1.0).tolist()


def test_scaled_momentum_looks_at_its_reference(spark):
    rng = np.random.default_rng(3)
    ref = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 140)))
    roc = pd.Series(ref) / pd.Series(ref).shift(12) - 1
    z = (roc / roc.rolling(60).std()).to_numpy()
    raw = [bool(i >= 60 and z[i] > 0.5) for i in range(140)]  # nan is not above
    rows = spark.createDataFrame([(T0 + i * HOUR, float(v)) for i, v in enumerate(ref)], "ts timestamp, ref_close double")
    df = closes(spark, np.linspace(100, 50, 140)).join(rows, "ts")
    assert fired(df, "vol_scaled_momentum") == held(raw, 3) and any(raw) and not any(fired(df.drop("ref_close"), "vol_scaled_momentum"))


def test_first_bars_are_held_back(spark):
    df = closes(spark, range(100, 140)).withColumns({"high": F.col("close"), "ref_value": -F.col("close")})
    assert fired(df, "donchian", period=5) == [False] * 5 + [True] * 35
    assert fired(df, "macro_regime_signal", z_window=10, hold_bars=1) == [False] * 10 + [True] * 30
    flat = closes(spark, [100] * 120).withColumns({"high": 100 + F.unix_seconds("ts") % 1000, "low": F.lit(90.0)})
    got = fired(flat, "volatility_regime", atr_period=14, lookback=20, threshold=0.0, mode="trending")
    assert not any(got[:33])  # the first value that counts is at bar 33


def test_schemas_and_unknown_values(spark):
    from inspect import signature

    from tidemark.operators import signal_params

    for name, schema in signal_params.SCHEMAS.items():
        f = sig.REGISTRY.get(name, getattr(sig, name, None))
        assert set(schema) <= set(signature(f).parameters) and len(schema) > 0
        for spec in schema.values():
            assert spec[2] in spec[1] if spec[0] == "str" else spec[1] <= spec[3] <= spec[2]
    assert len(signal_params.SCHEMAS) == 38 and signal_params.default(signal_params.SCHEMAS["rsi"]["threshold"]) == 30.0
    df = closes(spark, range(50))
    for bad in ({"mode": "sideways"}, {"period": 2.5}, {"threshold": "low"}):
        with pytest.raises(ValueError, match="rsi"):
            sig.compute("rsi", df, **bad)
    with pytest.raises(KeyError):
        sig.compute("no such", df)
    sig.register("mine", lambda bars, level=1.0: bars.withColumn("signal", F.col("close") > level), {"level": ("float", 0.0, 2.0, 1.0, 0.5)})
    assert sum(fired(df, "mine", level=40.0)) == 9
    rows = signal_params.schema_rows(spark, "rsi", "squeeze", "mine")
    space = {(r.signal, r.name): r.preset for r in rows.collect()}
    assert space["rsi", "period"] == "14" and space["squeeze", "mode"] == "bullish"
    values = [r.value for r in grid.space_from_schema(rows.where("signal = 'mine'")).collect()]
    assert values == ["0.0", "0.5", "1.0", "1.5", "2.0"]
    assert [r.value for r in grid.space_from_schema(rows.where("signal = 'squeeze' and name = 'bb_period'")).collect()] == [str(k) for k in range(14, 27)]
    del sig.REGISTRY["mine"], signal_params.SCHEMAS["mine"]


def ratchet_loop(level_up, level_dn, close):
    up, dn, trend, out = level_up[0], level_dn[0], 1, []
    for i, c in enumerate(close):
        pu, pd_, before = up, dn, trend
        if i:
            up = max(level_up[i], pu) if close[i - 1] > pu else level_up[i]
            dn = min(level_dn[i], pd_) if close[i - 1] < pd_ else level_dn[i]
            trend = 1 if before == -1 and c > pd_ else -1 if before == 1 and c < pu else before
        out.append((up, dn, trend, trend if trend != before else 0))
    return out


@pytest.mark.parametrize("n,size", [(700, 7), (700, 64), (300_000, 4096)])
def test_bands_over_blocks_are_the_loop(spark, n, size):
    from tidemark.operators import bands

    rng = np.random.default_rng(n + size)
    close = 100 + np.cumsum(rng.normal(0, 1, n))
    close[n // 3 : n // 2] = np.round(close[n // 3 : n // 2])  # ties
    up, dn = np.round(close + rng.normal(-3, 1.5, n), 1), np.round(close + rng.normal(3, 1.5, n), 1)  # at times on the wrong side
    want = ratchet_loop(up, dn, close)
    pdf = pd.DataFrame({"symbol": "a", "ts": np.arange(n), "close": close, "before": np.r_[np.nan, close[:-1]], "up": up, "dn": -dn, "k": np.arange(1, n + 1)})
    df = spark.createDataFrame(pdf).withColumn("before", F.nanvl("before", F.lit(None).cast("double"))).repartition(5)
    got = bands.ratchet(df, size).toPandas().sort_values("ts")
    assert len(got) == n and list(zip(got["up_band"], got["dn_band"], got["trend"], got["flip"], strict=True)) == want and (got["flip"] != 0).sum() > 5


@pytest.mark.parametrize("n,strict", [(5, False), (5, True), (5000, False)])
def test_sliding_ranks_are_the_loop(spark, n, strict, monkeypatch):
    monkeypatch.setattr(win, "RANK_ROWS", 20)
    m = 45_000 if n > 100 else 300
    rng = np.random.default_rng(n)
    x = rng.integers(0, 50 if n < 100 else 10**6, m).astype(float)
    if n < 100:
        x[[40, 41, 150]] = np.nan
    pdf = pd.DataFrame({"symbol": "a", "ts": np.arange(m), "v": x, "other": "o"})
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double"))).repartition(3)
    got = win.pct_rank(df, "p", "v", n, strict).orderBy("ts").toPandas()
    assert got.columns.tolist() == ["symbol", "ts", "v", "other", "p"] and len(got) == m
    at = range(m) if n < 100 else rng.integers(0, m, 300)
    for i in at:
        w = x[i - n + 1 : i + 1] if i >= n - 1 else np.array([np.nan])
        want = math.nan if np.isnan(w).any() else ((w < x[i]) if strict else (w <= x[i])).mean()
        assert got["p"][i] == want or math.isnan(want) and math.isnan(got["p"][i])


# --- ranks and percentiles without sorting a group in one task


@pytest.fixture(scope="module")
def groups(spark):
    """Ties, negative numbers, tiny and huge ones, infinities, a null group, nulls, a group of one value."""
    rng = np.random.default_rng(6)
    rows = [(g, float(v), float(rng.random() < 0.3)) for g in ("a", None) for v in np.r_[rng.normal(0, 1, 400), np.round(rng.normal(0, 3, 400)), rng.normal(0, 1e-9, 50), [1e300, -1e300, math.inf, -math.inf, 0.0, -0.0, 5e-324]]]
    rows += [("same", 2.5, float(i % 2)) for i in range(40)] + [("one", 7.0, 1.0), ("a", None, 1.0)]
    pdf = pd.DataFrame(rows, columns=["g", "v", "s"])
    return pdf, spark.createDataFrame(rows, "g string, v double, s double").repartition(5)


def test_distributed_ranks_are_pandas_ranks(groups):
    from tidemark.operators import ranks

    pdf, df = groups
    want = pdf.dropna(subset=["v"]).assign(r=lambda x: x.groupby("g", dropna=False)["v"].rank())
    got = ranks.average_ranks(df, "r", "v", "g").toPandas()
    key = lambda t: sorted(map(str, zip(t["g"].where(t["g"].notna(), None), t["v"] + 0.0, t["s"], t["r"])))
    assert got.columns.tolist() == ["g", "v", "s", "r"] and key(got) == key(want)
    finite = df.where("abs(v) < 1e299")
    ic = {r.g: (r.ic, r.n, r.n_signals) for r in ranks.signal_correlation(finite, "s", "v", "g").collect()}
    for g, part in pdf[pdf["v"].abs() < 1e299].groupby("g", dropna=False):
        g = None if isinstance(g, float) else g
        assert ic[g][1:] == (len(part), part["s"].sum())
        want_ic = part["s"].rank().corr(part["v"].rank()) if part["v"].nunique() > 1 and part["s"].nunique() > 1 else None
        assert ic[g][0] == (None if want_ic is None else pytest.approx(want_ic, abs=1e-9))
    two = edge.spearman(finite.withColumn("w", F.col("v") * F.col("v")), "v", "w", "g").where("g = 'a'").first()
    part = pdf[(pdf["g"] == "a") & (pdf["v"].abs() < 1e299)]["v"]
    assert two.n == len(part) and two.ic == pytest.approx(part.rank().corr((part * part).rank()), abs=1e-9)


def test_selected_percentiles_are_exact(groups):
    from tidemark.operators import ranks

    pdf, df = groups
    shares = {"lo": 0.0, "p1": 0.01, "q1": 0.25, "mid": 0.5, "q3": 0.75, "hi": 1.0}
    finite = df.where("abs(v) < 1e299")
    got = {r.g: r for r in ranks.percentiles(finite, "v", shares, "g").collect()}
    for g, part in pdf[pdf["v"].abs() < 1e299].groupby("g", dropna=False):
        for name, q in shares.items():
            assert got[None if isinstance(g, float) else g][name] == pytest.approx(np.quantile(part["v"], q), rel=1e-12, abs=1e-15)
    whole = ranks.percentiles(finite, "v", {"mid": 0.5}).collect()
    assert [r.mid for r in whole] == [pytest.approx(pdf[pdf["v"].abs() < 1e299]["v"].median(), rel=1e-12)]
    assert ranks.percentiles(df.limit(0), "v", shares, "g").count() == 0


@pytest.mark.parametrize("keys", [(), ("g",)])
def test_discoveries_are_those_of_the_sorted_list(spark, keys):
    rng = np.random.default_rng(1)
    rows = [(g, float(p), i) for g, k in (("a", 2e-3), ("b", 1.0), (None, 5e-2)) for i, p in enumerate(np.round(rng.random(60) ** 3 * k + (g == "b") * 0.5, 4))] + [("a", None, 99)]
    df = spark.createDataFrame(rows, "g string, p double, i long").repartition(3)
    for alpha in (0.001, 0.05, 0.2):
        got = {(r.g, r.i): r.significant for r in edge.fdr_bh(df, "p", alpha, *keys).collect()}
        for part in [[r for r in rows if not keys or r[0] == g] for g in (("a", "b", None) if keys else ("all",))]:
            ps = sorted(r[1] for r in part if r[1] is not None)
            last = max([p for k, p in enumerate(ps, 1) if p <= k / len(ps) * alpha], default=-1.0)
            assert all(got[r[0], r[2]] == (r[1] is not None and r[1] <= last) for r in part)
        assert len(got) == len(rows)


def test_no_window_holds_a_whole_group(spark, groups):
    """Every window over rows is by bucket; those by group alone run over counts of buckets."""
    from tidemark.operators import ranks

    _, df = groups
    for got in (ranks.average_ranks(df, "r", "v", "g"), ranks.signal_correlation(df, "s", "v", "g"), ranks.percentiles(df, "v", {"m": 0.5}, "g"), edge.fdr_bh(df.withColumnRenamed("v", "p"), "p", 0.1, "g")):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        for line in [x for x in plan.splitlines() if "windowspecdefinition" in x]:
            assert "bucket__" in line


def test_false_rate_of_permuted_bars_by_a_loop(spark):
    """The query over whole tables against ranks and correlations by pandas on the same permuted bars."""
    from tidemark.plans.fixtures import bars_1h
    from tidemark.plans.q_overfit import null_ic

    folder = "/root/testdata/sf0.01"
    got = {r.seed: (r.false_rate, r.n) for r in null_ic(spark, folder).collect()}
    bars, want = bars_1h(spark, folder), {}
    for seed in range(3):
        found = []
        for _, b in overfit.permute_bars(bars, seed).select("symbol", "ts", "close").toPandas().sort_values("ts").groupby("symbol"):
            signal = (b.close / b.close.shift(6) - 1 > 0.2).astype(float).rolling(3, min_periods=1).max()
            for horizon in (2, 4):
                fwd = b.close.shift(-horizon) / b.close - 1
                x, y, cut = signal[fwd.notna()], fwd[fwd.notna()], int(len(b) * 0.6)
                # train and validation: 30 returns, 3 signals and both sides varying
                for i, j in ((x[:cut], y[:cut]), (x[cut:], y[cut:])):
                    if len(i) >= 30 and i.sum() >= 3 and i.nunique() > 1 and j.nunique() > 1:
                        found.append(np.corrcoef(i.rank(), j.rank())[0, 1])
        if found:
            want[seed] = (pytest.approx(np.mean([x > 0.1 for x in found]), abs=1e-6), len(found))
    assert want and got == want


def test_next_bars_across_stretches_of_time(spark):
    """Against a loop: gaps of many stretches, equal times, times before all bars and after, odd keys; and no window looks ahead from each row."""
    rng = np.random.default_rng(5)
    bar_at = {s: sorted(rng.choice(24 * 40, 60, replace=False).tolist()) for s in "ab"}
    rows = [(s, T0 + h * HOUR, float(h), float(h)) for s, hours in bar_at.items() for h in hours] + [(None, T0, 1.0, 1.0), ("a", None, 1.0, 1.0)]
    b = spark.createDataFrame(rows, "symbol string, ts timestamp, close double, open double")
    when = [(s, T0 + h * HOUR / 2) for s in "abc" for h in range(-60, 24 * 100, 7)] + [("a", T0 + bar_at["a"][3] * HOUR)] * 2 + [(None, T0), ("a", None)]
    found = asof.forward_asof(spark.createDataFrame(when, "symbol string, ts timestamp"), b, 3)
    want = []
    for s, t in when:
        hours = bar_at.get(s, []) if t is not None else []
        k = next((i for i, h in enumerate(hours) if T0 + h * HOUR >= t), None)
        want.append((s, t) + ((None,) * 3 if k is None else (T0 + hours[k] * HOUR, float(hours[k]), float(hours[k + 3]) if k + 3 < len(hours) else None)))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()


def test_top_params_fits_in_small_tasks(spark, monkeypatch):
    from tidemark.plans import catalog

    seen, real = [], grid.weighted
    monkeypatch.setattr(grid, "TRIALS", 500)
    monkeypatch.setattr(grid, "weighted", lambda *a: seen.append(real(*a)) or seen[-1])
    assert [tuple(r) for r in catalog.queries()["top_params"](spark, "/root/testdata/sf0.01").collect()] == [("p_size", 1), ("p_retailprice", 2)]
    sizes = seen[0].rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 4 and sum(sizes) == 1998 and max(sizes) < 700
