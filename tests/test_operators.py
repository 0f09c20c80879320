"""Operators against pandas and NumPy, known values and properties."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import asof, bars, combine, edge, grid, overfit, perf, quality
from tidemark.operators import portfolio as pf
from tidemark.operators import signals as sig
from tidemark.operators import windows as win
from tidemark.sources import bars as store


def series(spark, n=600, symbols=("a", "b"), seed=42):
    """Hourly bars of random walks."""
    rng, parts = np.random.default_rng(seed), []
    for s in symbols:
        close = 100 + np.cumsum(rng.normal(0, 1, n)) * 0.5
        open_ = np.r_[100.0, close[:-1]]
        parts.append(pd.DataFrame({"symbol": s, "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "open": open_, "high": np.maximum(open_, close) + rng.random(n), "low": np.minimum(open_, close) - rng.random(n), "close": close, "volume": rng.integers(1, 100, n).astype(float)}))
    pdf = pd.concat(parts, ignore_index=True)
    return pdf, spark.createDataFrame(pdf).repartition(3).cache()


@pytest.fixture(scope="module")
def walk(spark):
    return series(spark)


def by_symbol(pdf, f):
    return pd.concat([pd.Series(f(g).to_numpy(), index=g.index) for _, g in pdf.groupby("symbol")]).sort_index().to_numpy()


def column(df, name):
    return np.array([np.nan if r[name] is None else r[name] for r in df.orderBy("symbol", "ts").select(name).collect()], float)


@pytest.mark.parametrize("n", [2, 5, 12, 50, 200])
def test_ema_is_ewm(walk, n):
    pdf, df = walk
    want = by_symbol(pdf, lambda g: g["close"].ewm(span=n, adjust=False).mean())
    np.testing.assert_allclose(column(win.ema(df, "e", "close", n), "e"), want, rtol=1e-9)


@pytest.mark.parametrize("n", [3, 14])
def test_wilder_is_the_loop(walk, n):
    pdf, df = walk

    def loop(g):
        x = g["close"].to_numpy()
        y = np.full(len(x), np.nan)
        y[n - 1] = x[:n].mean()
        for i in range(n, len(x)):
            y[i] = (y[i - 1] * (n - 1) + x[i]) / n
        return pd.Series(y)

    np.testing.assert_allclose(column(win.wilder(df, "w", "close", n), "w"), by_symbol(pdf, loop), rtol=1e-9)


def test_rolling_is_pandas_rolling(walk):
    pdf, df = walk
    got = df.withColumns({"m": win.sma("close", 20), "s": win.rolling_std("close", 20), "hi": win.rolling_max("high", 20)})
    for c, f in (("m", lambda g: g["close"].rolling(20).mean()), ("s", lambda g: g["close"].rolling(20).std()), ("hi", lambda g: g["high"].rolling(20).max())):
        np.testing.assert_allclose(column(got, c), by_symbol(pdf, f), rtol=1e-9)


def test_hold_is_a_pulse_that_starts_again(walk):
    pdf, df = walk
    got = df.withColumn("h", win.hold_bars(F.col("volume") > 80, 4).cast("double"))

    def loop(g):
        left, out = 0, []
        for v in g["volume"] > 80:
            left = 4 if v else max(0, left - 1)
            out.append(float(left > 0))
        return pd.Series(out)

    assert (column(got, "h") == by_symbol(pdf, loop)).all()


def test_resample_steps_agree(spark, walk):
    _, df = walk
    direct = bars.resample(df, "1d").drop("n_base")
    steps = bars.resample(bars.resample(df, "4h").drop("n_base"), "1d", base="4h").drop("n_base")
    assert direct.exceptAll(steps).count() == 0 == steps.exceptAll(direct).count()
    week = bars.resample(df, "1w").select(F.weekday("ts")).distinct().collect()
    assert [r[0] for r in week] == [0]  # Monday
    with pytest.raises(ValueError):
        bars.resample(df, "1h")


def test_asof_never_reads_the_future(walk):
    _, df = walk
    days = bars.resample(df, "1d")
    rows = asof.htf_align(df, days.withColumn("end", F.unix_seconds("ts") + 86400), "end", 86400)
    assert rows.where(F.col("htf_end") > F.unix_seconds("ts")).count() == 0
    assert asof.htf_align(df, days.withColumn("end", F.unix_seconds("ts") + 86400), "end", 86400, key="label").where(F.col("htf_end") > F.unix_seconds("ts")).count() > 0


def test_results_do_not_depend_on_partitions(spark, walk):
    _, df = walk
    out = []
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append([tuple(r) for r in sig.rsi(df.repartition(5, "volume"), threshold=45.0).orderBy("symbol", "ts").select("symbol", "ts", "signal").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]


@pytest.mark.parametrize("name", sorted(sig.REGISTRY))
def test_signals_are_boolean_and_keep_rows(walk, name):
    _, df = walk
    got = sig.compute(name, df)
    assert dict(got.dtypes)["signal"] == "boolean" and got.count() == df.count() and got.where("signal is null").count() == 0
    assert not [c for c in got.columns if c.endswith("__")]


def test_signals_without_their_column_are_false(walk):
    _, df = walk
    for name in ("funding_rate", "oi_divergence", "vrp", "yield_curve", "credit_spread", "cs_momentum", "cross_asset_momentum"):
        assert sig.compute(name, df).where("signal").count() == 0


def test_fill_and_gaps(spark):
    t = [datetime.datetime(2024, 1, 1, h) for h in (0, 1, 4, 5)]
    df = spark.createDataFrame([("a", x, 1.0, 2.0, 0.5, float(i), 5.0) for i, x in enumerate(t)], "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    assert [tuple(r)[3:] for r in quality.gaps(df, 3600).collect()] == [(10800, 2)]
    f = quality.fill_gaps(df, 3600).orderBy("ts").collect()
    assert [(r.close, r.volume, r.added) for r in f][2:4] == [(1.0, 0.0, True)] * 2
    assert quality.fill_gaps(df, 3600, "mark").where("close is null").count() == 2


def test_store_replaces_only_touched_periods(spark, tmp_path):
    path = f"file://{tmp_path}/bars"
    base = spark.createDataFrame([("ex", "a", "1h", datetime.datetime(2024, m, 1, 5), 1.0, 2.0, 0.5, float(m), 1.0) for m in (1, 2)], "exchange string, symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double")
    store.write_bars(base, path)
    store.write_bars(base.where("close = 2").withColumn("close", F.lit(9.0)), path)
    assert sorted(r.close for r in store.read_bars(spark, path, "ex", "a", "1h").collect()) == [1.0, 9.0]
    with pytest.raises(ValueError):
        store.write_bars(base.drop("volume"), path)


def test_combination_truth_table(spark):
    rows = [("a", 1, "x", "exclusive", True), ("a", 1, "y", "optional", False), ("a", 2, "x", "exclusive", True), ("a", 2, "y", "optional", True), ("a", 3, "x", "exclusive", False), ("a", 3, "y", "optional", True), ("a", 4, "x", "exclusive", True), ("a", 4, "y", "disabled", False)]
    df = spark.createDataFrame(rows, "symbol string, ts long, indicator string, state string, signal boolean")
    assert [r.signal for r in combine.combine_exclusive(df).orderBy("ts").collect()] == [False, True, False, True]
    assert [r.signal for r in combine.combine_majority(df).orderBy("ts").collect()] == [True, True, True, True]


def test_fdr_marks_none_when_none_passes(spark):
    df = spark.createDataFrame([(0.5,), (0.04,), (0.2,)], "p double")
    assert edge.fdr_bh(df, "p", 0.01).where("significant").count() == 0
    assert edge.fdr_bh(df, "p", 0.13).where("significant").count() == 1


def test_distributions():
    assert stats.normal_cdf(1.959963985) == pytest.approx(0.975, abs=1e-9)
    assert stats.t_sf(2.228139, 10) == pytest.approx(0.025, abs=1e-6)
    assert stats.binom_sf(8, 10, 0.5) == pytest.approx(56 / 1024)
    assert stats.binom_sf(0, 5, 0.5) == 1.0 and stats.t_sf(0, 3) == pytest.approx(0.5)


def test_more_trials_lower_the_deflated_sharpe(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(str(c), t, float(rng.normal(0.0005 * c, 0.01))) for c in range(6) for t in range(300)], "candidate string, t long, ret double")
    few, many = ({r.candidate: r.dsr for r in overfit.deflated_sharpe(df, n).collect()} for n in (10, 1000))
    assert all(many[c] <= few[c] for c in few)


def test_overfitting_probability_orders_curves(spark):
    rng = np.random.default_rng(3)
    good = [(str(c), t, float(rng.normal(0.002 * c, 0.01))) for c in range(5) for t in range(400)]
    fake = [(str(c), t, float(rng.normal(0.004 if (t // 50) % 5 == c else -0.001, 0.01))) for c in range(5) for t in range(400)]
    p = [overfit.pbo(spark.createDataFrame(x, "candidate string, t long, ret double")).first().pbo for x in (good, fake)]
    assert p[0] < 0.3 < p[1]


def test_effective_n_of_copies_is_one(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 0.01, 200)
    df = spark.createDataFrame([(f"s{c}", t, float(base[t] + rng.normal(0, 1e-5))) for c in range(5) for t in range(200)], "strategy_id string, t long, ret double")
    n = pf.effective_n(pf.correlations(df), 5).first()
    assert n.effective_n == pytest.approx(1, abs=0.01) and n.effective_n_eigen == pytest.approx(1, abs=0.01)


def test_permutation_keeps_returns(walk):
    _, df = walk
    p = overfit.permute_bars(df, 3)
    r = lambda d: d.withColumn("r", F.round(F.ln(F.col("close") / F.lag("close").over(win.W())), 9)).where("r is not null").select("symbol", "r")
    assert r(p).exceptAll(r(df)).count() == 0
    assert p.where("high < close or low > close").count() == 0


def test_optimal_f_and_streaks(spark):
    t = spark.createDataFrame([("a", i, x, 0.0) for i, x in enumerate([2.0, -1.0, 2.0, -1.0, -1.0, 2.0])], "symbol string, entry_bar long, pnl double, commission double")
    assert perf.optimal_f(t, "symbol").first().f == pytest.approx(0.25)
    m = perf.trade_metrics(t, "symbol").first()
    assert (m.win_rate, m.profit_factor, m.max_losses, m.n_trades) == (0.5, 2.0, 2, 6)


def test_pareto_front(spark):
    rows = [(1, 5.0, 1), (2, 4.0, 2), (3, 3.0, 1), (4, 4.0, 2), (5, 1.0, 9)]
    df = spark.createDataFrame(rows, "id long, sharpe double, trades long")
    assert sorted(r.id for r in grid.pareto(df, "trades", "sharpe").collect()) == [1, 2, 4, 5]


def test_issues_and_trades_of_all_symbols(spark, monkeypatch):
    from tidemark.plans import q_bars, q_overfit

    made = spark.range(600).select(F.format_string("s%04d", "id").alias("symbol"), F.lit(1.0).alias("high"), F.lit(2.0).alias("open"), F.lit(1.0).alias("close"), F.lit(0.0).alias("volume"))
    monkeypatch.setattr(q_bars, "broken", lambda spark, sf: made)
    got = q_bars.issues_sorted(spark, "").collect()
    want = [(s, f"s{i:04d}") for s in ("error", "warning") for i in range(600)]
    assert [(r.severity, r.symbol) for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(1, 1201))
    trades = q_overfit.trade_bootstrap(spark, "/root/testdata/sf0.001").collect()
    assert len({r.symbol for r in trades}) == len(trades) == 5


def dealt(spark, pdf, n=5):
    return spark.createDataFrame(pdf).repartition(n)


@pytest.mark.parametrize("m", [30, 5_000, 1_000_000])
def test_range_join_is_brute_force(spark, m, tmp_path):
    """Lengths from 1 to 100,000, places on both sides of zero, one place that holds a third of the rows, empty ranges, nulls."""
    import duckdb

    rng = np.random.default_rng(m)
    start = rng.integers(-5 * 10**8, 5 * 10**8, m)
    ranges = pd.DataFrame({"r": np.arange(m), "start": start, "end": start + np.exp(rng.uniform(0, np.log(1e5), m)).astype(np.int64) - (np.arange(m) % 7 == 0)})
    ranges.loc[0, ["start", "end"]] = [-6 * 10**8, 6 * 10**8]
    rows = pd.DataFrame({"id": np.arange(6_000), "t": rng.integers(-5 * 10**8, 5 * 10**8, 6_000)})
    rows.loc[:2_000, "t"] = start[5]
    want = duckdb.sql('SELECT count(*), sum(id * (r % 1009))::BIGINT FROM rows JOIN ranges ON t >= start AND t < "end"').fetchall()[0]
    ranges.to_parquet(tmp_path / "r.parquet")
    r = spark.read.parquet(f"file://{tmp_path}/r.parquet").union(spark.createDataFrame([(-1, None, 5), (-2, 1, None)], "r long, start long, end long"))
    t = dealt(spark, rows).union(spark.createDataFrame([(7, None)], "id long, t long"))
    met = asof.range_join(t, r, "t")
    assert met.columns == ["id", "t", "r", "start", "end"]
    got = met.agg(F.count("*"), F.sum(F.col("id") * (F.col("r") % 1009))).first()
    assert tuple(got) == want


def test_range_join_of_times_and_folds(spark):
    """Over the limit of single comparisons as under it; other kinds of places are refused."""
    ts = spark.range(500).select("id", F.timestamp_seconds(F.col("id") * 3600 + 1_700_000_000).alias("ts"))
    periods = spark.range(200).select(F.col("id").alias("p"), F.timestamp_seconds(F.col("id") * 7200 + 1_700_000_000).alias("start"), F.timestamp_seconds(F.col("id") * 9000 + 1_700_003_601).alias("end"))
    want = sorted((i, p) for i in range(500) for p in range(200) if p * 7200 <= i * 3600 < p * 9000 + 3601)
    assert sorted((r.id, r.p) for r in asof.period_range_join(ts, periods).collect()) == want
    folds = spark.range(100).select(F.col("id").alias("fold"), F.col("id").alias("is_start"), (F.col("id") + 10).alias("is_end"), (F.col("id") + 12).alias("oos_start"), (F.col("id") + 15).alias("oos_end"))
    parts = asof.fold_range_join(spark.range(200).withColumnRenamed("id", "t"), folds)
    assert sorted((r.t, r.fold, r.part) for r in parts.collect()) == sorted((f + k, f, "is" if k < 10 else "oos") for f in range(100) for k in (*range(10), 12, 13, 14))
    with pytest.raises(TypeError):
        asof.range_join(ts.withColumn("t", F.lit(1.5)), folds, "t", "is_start", "is_end").count()


def front(points):
    return sorted(i for i, p in enumerate(points) if not np.isnan(p).any() and not ((points >= p).all(1) & (points > p).any(1)).any())


@pytest.mark.parametrize("shape", ["cloud", "arc", "ties"])
def test_pareto_is_brute_force(spark, shape):
    """Signs mixed, equal trials, NaN; on an arc every trial stays."""
    rng = np.random.default_rng(3)
    a = rng.uniform(0, np.pi / 2, 3_000)
    points = {"cloud": rng.normal(0, 100, (3_000, 2)), "arc": np.c_[np.cos(a), np.sin(a)], "ties": rng.integers(-4, 5, (3_000, 2)).astype(float)}[shape]
    points[5, 1] = np.nan
    df = dealt(spark, pd.DataFrame({"id": np.arange(3_000), "x": points[:, 0], "y": points[:, 1]})).union(spark.createDataFrame([(-1, None, 1e9)], "id long, x double, y double"))
    got = grid.pareto(df, "x", "y")
    assert sorted(r.id for r in got.collect()) == front(points)
    assert got.columns == ["id", "x", "y"]


def test_pareto_has_no_window_without_a_key(spark, capsys):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id long, x double, y double")
    grid.pareto(df, "x", "y").explain()
    plan = capsys.readouterr().out
    windows = [line for line in plan.splitlines() if " Window [" in line]
    assert len(windows) == 2 and all("far__" in w.split("windowspec")[-1] for w in windows)


@pytest.mark.parametrize("shape", ["cloud", "sphere", "ties"])
def test_skyline_is_brute_force(spark, shape, monkeypatch, tmp_path):
    """Three measures and blocks of 200, so that many blocks meet."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    monkeypatch.setattr(grid, "BLOCK", 200)
    rng = np.random.default_rng(4)
    g = np.abs(rng.normal(0, 1, (1_500, 3)))
    points = {"cloud": rng.normal(0, 9, (1_500, 3)), "sphere": g / np.sqrt((g * g).sum(1))[:, None], "ties": rng.integers(0, 4, (1_500, 3)).astype(float)}[shape]
    points[9, 2] = np.nan
    df = dealt(spark, pd.DataFrame({"id": np.arange(1_500), "a": points[:, 0], "b": points[:, 1], "c": points[:, 2]}))
    assert sorted(r.id for r in grid.skyline(df, "a", "b", "c").collect()) == front(points)
    assert grid.skyline(df.limit(0), "a", "b").count() == 0


def test_klines_plain_and_in_archives(spark, tmp_path, monkeypatch):
    """The first csv member alone, in chunks; empty members; milliseconds and microseconds; an archive without a csv is an error."""
    import zipfile

    line = lambda t, c: f"{t},1.0,2.5,0.5,{c},10.0,{t},0,3,0,0,0\n"
    monkeypatch.setattr(store, "ROWS", 2)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(line(1_700_000_000_000, 1.5) + line(1_700_000_060_000, 1.6))
    with zipfile.ZipFile(tmp_path / "in" / "b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("CHECKSUM", "x")
        z.writestr("b.csv", "".join(line(1_700_000_120_000_000 + i * 60_000_000, 2 + i / 10) for i in range(5)))
        z.writestr("later.csv", line(1_700_009_000_000, 9.9))
    with zipfile.ZipFile(tmp_path / "in" / "c.zip", "w") as z:
        z.writestr("c.csv", "")
    got = store.read_klines(spark, f"file://{tmp_path}/in").orderBy("ts").select(F.unix_seconds("ts").alias("t"), "close", "volume").collect()
    assert [tuple(r) for r in got] == [(1_700_000_000 + 60 * i, c, 10.0) for i, c in enumerate([1.5, 1.6, 2.0, 2.1, 2.2, 2.3, 2.4])]
    with zipfile.ZipFile(tmp_path / "in" / "d.zip", "w") as z:
        z.writestr("note.txt", "")
    with pytest.raises(Exception, match="no csv in"):
        store.read_klines(spark, f"file://{tmp_path}/in").count()


def test_results_of_any_keys(spark):
    """Keys differ by file; later sections replace earlier ones; broken files give nothing; mixed types become texts."""
    files = [
        ('{"1": {"name": "a", "combination": {"indicators": {"Use RSI": true, "n": 3, "mix": 1}, "requires": {"need": "x", "n": 4}}, "result": {"profit": "−1.234,5 USDT", "trades": 7}}}',),
        ('{"2": {"name": "b", "combination": {"riskManagement": {"stop": 1.5, "mix": "two"}}, "result": {"profit": "none"}}, "3": {"name": null}}',),
        ("not json",),
        (None,),
    ]
    df = store.flatten_results(spark.createDataFrame(files, "json string"))
    assert df.columns == ["id", "name", "Use RSI", "mix", "n", "stop", "need", "profit", "trades"]
    assert dict(df.dtypes)["Use RSI"] == "boolean" and dict(df.dtypes)["n"] == "bigint" and dict(df.dtypes)["mix"] == "string"
    rows = {r.id: r.asDict() for r in df.collect()}
    assert rows["1"] == {"id": "1", "name": "a", "Use RSI": True, "mix": "1", "n": 4, "stop": None, "need": "x", "profit": -1234.5, "trades": 7.0}
    assert (float(rows["2"]["stop"]), rows["2"]["mix"], rows["2"]["profit"], rows["2"]["trades"]) == (1.5, "two", None, None)
    assert set(rows) == {"1", "2", "3"} and all(v is None for k, v in rows["3"].items() if k != "id")
    assert store.flatten_results(spark.createDataFrame([], "json string")).columns == ["id", "name"]


@pytest.mark.parametrize("level", [0.0, 1e6])
def test_pair_products_are_the_join(spark, monkeypatch, level):
    """Many blocks, stretches and chunks of times; gaps, repeated times, nulls, NaN, a constant series, disjoint series."""
    monkeypatch.setattr(pf, "STRATEGIES", 8)
    monkeypatch.setattr(pf, "ROWS", 1_000)
    monkeypatch.setattr(pf, "TIMES", 16)
    rng = np.random.default_rng(11)
    base = rng.normal(0, 1, 200)
    pdf = pd.concat([pd.DataFrame({"strategy_id": f"s{k}", "t": np.arange(200), "ret": level + base * (k % 5) / 4 + rng.normal(0, 1, 200)})[rng.random(200) < 0.8] for k in range(40)])
    pdf = pd.concat([pdf, pdf.iloc[::17].assign(ret=level + 1.0), pd.DataFrame({"strategy_id": "flat", "t": np.arange(200), "ret": 0.1 + level}), pd.DataFrame({"strategy_id": "late", "t": np.arange(900, 950), "ret": 1.0})])
    odd = "strategy_id string, t long, ret double"
    df = dealt(spark, pdf).union(spark.createDataFrame([("s1", 5, None), ("s3", 7, float("nan")), ("only", 7, None), (None, 7, 1.0), ("s2", None, 1.0)], odd)).cache()
    x, y = df.selectExpr("strategy_id a", "t", "ret x"), df.selectExpr("strategy_id b", "t", "ret y")
    lists = x.join(y, "t").where("a < b").groupBy("a", "b").agg(F.collect_list(F.struct(F.col("x").isNotNull() & F.col("y").isNotNull(), "x", "y")).alias("p"))
    want = {}
    for r in lists.collect():
        p = np.array([q[1:] for q in r.p if q[0]], float).reshape(-1, 2)
        d = p - p.mean(0) if len(p) else p
        c, v = (d[:, 0] * d[:, 1]).sum(), np.sqrt((d * d).sum(0).prod())
        want[r.a, r.b] = (len(p), c / (len(p) - 1) if len(p) > 1 else None, c / v if v > 0 else np.nan)
    got = {(r.a, r.b): r.rho for r in pf.correlations(df).collect()}
    cov = {(r.a, r.b): r.cov for r in pf.covariances(df).where("a < b").collect()}
    n = {(r.a, r.b): r.n for r in pf.pair_sums(df).collect()}
    assert set(got) == set(want) == set(cov) == set(n) and len(got) > 800
    for k, w in want.items():
        count, covariance, rho = w
        assert got[k] == pytest.approx(0.0 if np.isnan(rho) or "flat" in k else rho, abs=1e-7), k
        assert n[k] == count
        if covariance is None or np.isnan(covariance):
            assert cov[k] is None
        else:
            assert cov[k] == pytest.approx(covariance, abs=1e-6), k
    assert pf.correlations(df.limit(0)).count() == 0
