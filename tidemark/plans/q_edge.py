"""Queries of predictive-edge statistics and grouped reports on them (2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof, combine, edge, ranks
from tidemark.operators import windows as win
from tidemark.plans.fixtures import BARS_1H, bars_1h
from tidemark.plans import sqlstats
from tidemark.plans.registry import query

R = 6
HORIZONS = [1, 2, 4, 8]
W = "(PARTITION BY symbol ORDER BY ts)"
#: Momentum pulses of three lengths held for three bars, scored at four horizons.
SCORED = (
    f"{BARS_1H}, pulses AS (SELECT *, config, coalesce(close / lag(close, CAST(config AS INT)) OVER (PARTITION BY config, symbol ORDER BY ts) - 1 > 0.2, false) AS raw FROM bars, (VALUES (3), (6), (12)) AS c(config)),"
    " held AS (SELECT *, max(CASE WHEN raw THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY config, symbol ORDER BY ts ROWS 2 PRECEDING)::DOUBLE AS signal FROM pulses),"
    " scored AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT symbol, ts, config, signal, {h} AS horizon, lead(close, {h}) OVER (PARTITION BY config, symbol ORDER BY ts) / close - 1 AS fwd FROM held" for h in HORIZONS) + ")"
)


def scored(spark, sf):
    b = bars_1h(spark, sf)
    each = []
    for n in (3, 6, 12):  # three configurations: columns of one window, then exploded
        raw = F.coalesce(F.col("close") / win.lag("close", n) - 1 > 0.2, F.lit(False))
        b = b.withColumn(f"raw{n}", raw).withColumn(f"sig{n}", win.hold_bars(f"raw{n}", 3).cast("double"))
        each.append(F.struct(F.lit(n).alias("config"), F.col(f"sig{n}").alias("signal")))
    rows = edge.forward_returns(b.withColumn("c", F.array(*each)), HORIZONS, keep=("c",))
    return rows.select("symbol", "ts", "horizon", "fwd", F.explode("c").alias("x")).select("symbol", "ts", "horizon", "fwd", "x.config", "x.signal")


KEYS = ("symbol", "config", "horizon")
K = "symbol, config, horizon"


def rnd(df, *cols):
    return df.withColumns({c: F.round(c, R) for c in cols})


@query("forward_return", f"WITH {SCORED} SELECT symbol, ts, horizon, round(fwd, {R}) AS fwd FROM scored WHERE config = 3")
def forward_return(spark, sf):
    return rnd(edge.forward_returns(bars_1h(spark, sf), HORIZONS), "fwd")


def _ranked(source: str, keys: str) -> str:
    rank = lambda x: f"rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0"
    return f"(SELECT *, {rank('signal')} AS rx, {rank('fwd')} AS ry FROM {source})"


PARTS = f"{SCORED}, cut AS (SELECT *, floor(count(*) OVER (PARTITION BY {K}) * 0.6::DOUBLE) AS c FROM scored), parts AS MATERIALIZED (SELECT *, CASE WHEN row_number() OVER (PARTITION BY {K} ORDER BY ts) <= c THEN 'train' ELSE 'validation' END AS part FROM cut WHERE fwd IS NOT NULL)"
IC = f"{PARTS}, ic AS MATERIALIZED (SELECT * FROM (SELECT {K}, part, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS ic, count(*) AS n, sum(signal) AS n_signals FROM {_ranked('parts', K + ', part')} GROUP BY ALL) WHERE n >= 30 AND n_signals >= 3 AND ic IS NOT NULL)"


def ics(spark, sf):
    return edge.information_coefficient(scored(spark, sf), keys=KEYS)


@query("spearman_ic", f"WITH {IC} SELECT {K}, part, round(ic, {R}) AS ic, n, n_signals FROM ic")
def spearman_ic(spark, sf):
    return rnd(ics(spark, sf), "ic")


@query("edge_stats", f"WITH {SCORED}, e AS (SELECT {K}, count(*) AS n, count(*) FILTER (signal = 1) AS n_signals, avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0 END) FILTER (signal = 1) AS hit_rate, avg(fwd) FILTER (signal = 1) AS mean_on, avg(fwd) FILTER (signal <> 1) AS mean_off, avg(fwd) FILTER (signal = 1 AND fwd > 0) AS gain, avg(fwd) FILTER (signal = 1 AND fwd <= 0) AS loss FROM scored WHERE fwd IS NOT NULL GROUP BY ALL) SELECT {K}, n, n_signals, round(hit_rate, {R}) AS hit_rate, round(mean_on, {R}) AS mean_on, round(mean_off, {R}) AS mean_off, round(mean_on - mean_off, {R}) AS edge, round(n_signals / greatest(n / 720.0, 1), {R}) AS per_month, round(hit_rate * gain / nullif((1 - hit_rate) * abs(loss), 0), {R}) AS edge_ratio FROM e")
def edge_stats(spark, sf):
    return rnd(edge.edge_stats(scored(spark, sf), 720.0, KEYS), "hit_rate", "mean_on", "mean_off", "edge", "per_month", "edge_ratio")


STAB = f"{SCORED}, b AS (SELECT *, (row_number() OVER (PARTITION BY {K} ORDER BY ts) - 1) // 120 AS block FROM scored WHERE fwd IS NOT NULL), bi AS (SELECT {K}, block, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS ic FROM {_ranked('b', K + ', block')} GROUP BY ALL HAVING count(*) = 120 AND sum(signal) >= 5)"


@query("ic_stability", f"WITH {STAB} SELECT {K}, count(*) AS n_windows, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END), {R}) AS positive, round(avg(ic), {R}) AS mean_ic, round(stddev_pop(ic), {R}) AS sd_ic, round(quantile_cont(ic, 0.025), {R}) AS lo, round(quantile_cont(ic, 0.975), {R}) AS hi FROM bi WHERE ic IS NOT NULL GROUP BY ALL HAVING count(*) >= 3")
def ic_stability(spark, sf):
    return rnd(edge.ic_stability(scored(spark, sf), 120, keys=KEYS), "positive", "mean_ic", "sd_ic", "lo", "hi")


AVG = "avg(ic) AS mean_ic, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END) AS positive, arg_max(config, (ic, config)) AS best, max(ic) AS best_ic, count(*) FILTER (ic > 0) = 1 AND count(*) > 1 AS best_only, stddev_samp(ic) AS sd_ic, count(*) AS n_configs"


@query("ic_config_average", f"WITH {IC} SELECT symbol, horizon, part, round(mean_ic, {R}) AS mean_ic, round(positive, {R}) AS positive, best, round(best_ic, {R}) AS best_ic, best_only, round(sd_ic, {R}) AS sd_ic, n_configs, round(t, 4) AS t, round({sqlstats.t_two_sided('t', '(n_configs - 1)')}, 4) AS p FROM (SELECT *, mean_ic / (sd_ic / sqrt(n_configs)) AS t FROM (SELECT symbol, horizon, part, {AVG} FROM ic GROUP BY ALL))")
def ic_config_average(spark, sf):
    return rnd(edge.config_average(ics(spark, sf), ("symbol", "horizon", "part")), "mean_ic", "positive", "best_ic", "sd_ic").withColumns({"t": F.round("t", 4), "p": F.round("p", 4)})


@query("best_config", f"WITH {IC} SELECT symbol, arg_max(config, (ic, config, horizon)) AS config, arg_max(horizon, (ic, config, horizon)) AS horizon, round(max(ic), {R}) AS ic FROM ic WHERE part = 'validation' GROUP BY symbol")
def best_config(spark, sf):
    key = F.struct("ic", "config", "horizon")
    return rnd(ics(spark, sf).where("part = 'validation'").groupBy("symbol").agg(F.max_by("config", key).alias("config"), F.max_by("horizon", key).alias("horizon"), F.max("ic").alias("ic")), "ic")


CROSS = f"{BARS_1H}, p AS (SELECT * FROM (VALUES ('click', 'view'), ('error', 'click'), ('view', 'error')) AS p(symbol, reference)), j AS (SELECT b.symbol, p.reference, b.ts, b.close, r.close AS ref_close FROM bars b JOIN p USING (symbol) ASOF LEFT JOIN bars r ON r.symbol = p.reference AND b.ts >= r.ts), x AS (SELECT symbol, reference, CASE WHEN coalesce(ref_close / lag(ref_close, 6) OVER {W} - 1 > 0, false) THEN 1.0 ELSE 0.0 END::DOUBLE AS signal, lead(close, 4) OVER {W} / close - 1 AS fwd FROM j)"


@query("cross_asset_ic", f"WITH {CROSS}, y AS (SELECT * FROM x WHERE fwd IS NOT NULL) SELECT symbol, reference, round(corr(rx, ry), {R}) AS ic, count(*) AS n, sum(signal) AS n_signals FROM {_ranked('y', 'symbol, reference')} GROUP BY 1, 2")
def cross_asset_ic(spark, sf):
    pairs = spark.createDataFrame([("click", "view"), ("error", "click"), ("view", "error")], "symbol string, reference string")
    rows = asof.reference_join(bars_1h(spark, sf), pairs)
    rows = rows.withColumns({"signal": F.coalesce(F.col("ref_close") / win.lag("ref_close", 6) - 1 > 0, F.lit(False)).cast("double"), "fwd": F.lead("close", 4).over(win.W()) / F.col("close") - 1})
    return rnd(ranks.signal_correlation(rows, "signal", "fwd", "symbol", "reference"), "ic")


ENS = f"{SCORED}, e AS (SELECT a.symbol, a.ts, a.signal AS a, b.signal AS b, a.fwd FROM scored a JOIN scored b ON a.symbol = b.symbol AND a.ts = b.ts AND a.horizon = b.horizon AND a.config = 3 AND b.config = 12 WHERE a.horizon = 4 AND a.fwd IS NOT NULL), m AS (SELECT 'a' AS which, symbol, a AS signal, fwd FROM e UNION ALL SELECT 'b', symbol, b, fwd FROM e UNION ALL SELECT 'a_given_b', symbol, a, fwd FROM e WHERE b = 1 UNION ALL SELECT 'both', symbol, a * b, fwd FROM e)"


@query("ensemble_ic", f"WITH {ENS} SELECT which, symbol, round(CASE WHEN stddev_pop(rx) > 0 THEN corr(rx, ry) END, {R}) AS ic, count(*) AS n, sum(signal) AS n_signals FROM {_ranked('m', 'which, symbol')} GROUP BY 1, 2")
def ensemble_ic(spark, sf):
    s = scored(spark, sf).where("horizon = 4 and fwd is not null").groupBy("symbol", "ts").agg(F.max(F.when(F.col("config") == 3, F.col("signal"))).alias("a"), F.max(F.when(F.col("config") == 12, F.col("signal"))).alias("b"), F.first("fwd").alias("fwd"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("which"), c.alias("signal")) for n, c in (("a", F.col("a")), ("b", F.col("b")), ("a_given_b", F.when(F.col("b") == 1, F.col("a"))), ("both", F.col("a") * F.col("b")))]))
    rows = s.select("symbol", "fwd", each.alias("x")).select("symbol", "fwd", "x.*").where("signal is not null")
    return rnd(ranks.signal_correlation(rows, "signal", "fwd", "which", "symbol"), "ic")


FOR = "(2), (6), (12)"
PERS = f"{BARS_1H}, d AS (SELECT symbol, date_trunc('day', ts) AS ts FROM bars GROUP BY 1, 2 HAVING arg_max(close, ts) > arg_min(open, ts)), n AS ({' UNION ALL '.join(f'SELECT symbol, ts, {h} AS horizon, close, lead(close, {h}) OVER {W} AS later, row_number() OVER {W} - 1 AS i FROM bars' for h in (2, 6, 12))}), e AS (SELECT horizon, n.later / n.close - 1 AS r FROM (SELECT d.symbol, d.ts, h FROM d, (VALUES {FOR}) AS v(h)) d ASOF JOIN n ON d.symbol = n.symbol AND d.h = n.horizon AND d.ts <= n.ts), base AS (SELECT horizon, avg(later / close - 1) AS baseline FROM n WHERE i % greatest(horizon, 10) = 0 AND later IS NOT NULL GROUP BY 1), a AS (SELECT horizon, count(*) AS n, avg(r) AS mean, median(r) AS median, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS hit_rate, stddev_samp(r) AS sd, avg(r) / (stddev_samp(r) / sqrt(count(*))) AS t FROM e WHERE r IS NOT NULL GROUP BY horizon HAVING count(*) >= 5)"


def persisted(spark, sf):
    b = bars_1h(spark, sf)
    d = b.groupBy("symbol", F.date_trunc("day", "ts").alias("ts")).agg((F.max_by("close", "ts") > F.min_by("open", "ts")).alias("up")).where("up").select("symbol", "ts")
    rows = [asof.forward_asof(d, b, h).withColumn("horizon", F.lit(h)) for h in (2, 6, 12)]
    return edge.persistence(rows[0].union(rows[1]).union(rows[2]), edge.baseline(b, [2, 6, 12]))


@query("persistence", f"WITH {PERS} SELECT horizon, n, round(mean, {R}) AS mean, round(median, {R}) AS median, round(hit_rate, {R}) AS hit_rate, round(sd, {R}) AS sd, round(t, 4) AS t, round({sqlstats.t_two_sided('t', '(n - 1)')}, 6) AS p, round(baseline, {R}) AS baseline, round(mean - baseline, {R}) AS excess FROM a JOIN base USING (horizon)")
def persistence(spark, sf):
    return rnd(persisted(spark, sf), "mean", "median", "hit_rate", "sd", "p", "baseline", "excess").withColumn("t", F.round("t", 4))


@query("half_life", f"WITH {SCORED}, e AS (SELECT symbol, config, horizon, avg(fwd) FILTER (signal = 1) - avg(fwd) FILTER (signal <> 1) AS excess FROM scored GROUP BY ALL), p AS (SELECT *, max(excess) OVER (PARTITION BY symbol, config) AS peak FROM e) SELECT symbol, config, round(any_value(peak), {R}) AS peak, min(horizon) FILTER (excess < peak / 2) AS half_life FROM p WHERE peak > 0 GROUP BY 1, 2")
def half_life(spark, sf):
    e = edge.edge_stats(scored(spark, sf), 720.0, KEYS).select(*KEYS, F.col("edge").alias("excess"))
    return rnd(edge.half_life(e, "symbol", "config"), "peak")


#: p-values of the validation coefficients.
TESTS = f"{IC}, tests AS MATERIALIZED (SELECT {K}, ic, n, {sqlstats.t_two_sided('(ic * sqrt((n - 2) / (1 - ic * ic)))', '(n - 2)')} AS p FROM ic WHERE part = 'validation')"


def validated(spark, sf):
    return ics(spark, sf).where("part = 'validation'")


@query("fdr_bh", f"WITH {TESTS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY p) AS k, count(*) OVER (PARTITION BY symbol) AS n_tests FROM tests) SELECT {K}, round(p, {R}) AS p, coalesce(k <= max(CASE WHEN p <= k * 1.0 / n_tests * 0.02 THEN k END) OVER (PARTITION BY symbol), false) AS significant FROM k")
def fdr_bh(spark, sf):
    t = validated(spark, sf).select(*KEYS, edge.ic_p_value().alias("p"))
    return rnd(edge.fdr_bh(t, "p", 0.02, "symbol"), "p")


@query("ic_ranking", f"WITH {IC} SELECT horizon, config, part, round(avg(ic), {R}) AS mean_ic, round(max(ic), {R}) AS best_ic, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END), {R}) AS positive, count(DISTINCT symbol) AS n_assets, count(*) FILTER (ic > 0) AS n_positive, CASE WHEN avg(ic) > 0.02 AND avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END) > 0.5 THEN 'pass' ELSE 'fail' END AS status FROM ic GROUP BY ALL")
def ic_ranking(spark, sf):
    pos = F.avg((F.col("ic") > 0).cast("double"))
    r = ics(spark, sf).groupBy("horizon", "config", "part").agg(F.avg("ic").alias("mean_ic"), F.max("ic").alias("best_ic"), pos.alias("positive"), F.countDistinct("symbol").alias("n_assets"), F.count_if(F.col("ic") > 0).alias("n_positive"))
    return rnd(r.withColumn("status", F.when((F.col("mean_ic") > 0.02) & (F.col("positive") > 0.5), "pass").otherwise("fail")), "mean_ic", "best_ic", "positive")


#: The fixture's prices revert, so pulses are scored as short ones; a gate that some configurations pass and some fail.
GATE = {"horizon": 4, "least_ic": 0.12, "least_positive": 0.5, "alpha": 0.1}


@query("ic_finalists", f"WITH {TESTS.replace('SELECT symbol, config, horizon, ic,', 'SELECT symbol, config, horizon, -ic AS ic,')}, k AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n_tests FROM tests WHERE horizon = {GATE['horizon']}), f AS (SELECT *, coalesce(k <= max(CASE WHEN p <= k * 1.0 / n_tests * {GATE['alpha']} THEN k END) OVER (), false) AS significant FROM k), g AS (SELECT config, avg(ic) AS mean_ic, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END) AS positive, count(*) FILTER (significant) AS n_significant, count(DISTINCT symbol) AS n_assets FROM f GROUP BY 1 HAVING avg(ic) > {GATE['least_ic']} AND avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END) > {GATE['least_positive']} AND count(*) FILTER (significant) > 0) SELECT config, symbol, round(any_value(mean_ic), {R}) AS mean_ic, round(any_value(positive), {R}) AS positive, any_value(n_significant) AS n_significant, any_value(n_assets) AS n_assets, " + ", ".join(f"round(avg(ic) FILTER (horizon = {h}), {R}) AS h{h}" for h in HORIZONS) + " FROM tests JOIN g USING (config) GROUP BY 1, 2")
def ic_finalists(spark, sf):
    v = validated(spark, sf).withColumn("ic", -F.col("ic"))
    p = v.join(edge.finalists(v, **GATE), "config").groupBy("config", "symbol", "mean_ic", "positive", "n_significant", "n_assets").pivot("horizon", HORIZONS).agg(F.avg("ic"))
    return rnd(p.select("config", "symbol", "mean_ic", "positive", "n_significant", "n_assets", *[F.round(F.col(f"`{h}`"), R).alias(f"h{h}") for h in HORIZONS]), "mean_ic", "positive")


EXPO = f"{BARS_1H}, r AS (SELECT symbol, ts, close, open, ln(close / lag(close) OVER {W}) AS log_ret, coalesce(lag(CASE WHEN close > open THEN 1.0 ELSE 0 END) OVER {W}, 0)::DOUBLE AS position FROM bars), x AS (SELECT *, position * log_ret AS ret FROM r WHERE log_ret IS NOT NULL)"
METRICS = f"round(sum(ret), {R}) AS total, round(avg(position), {R}) AS in_market, round(avg(log_ret) FILTER (position > 0), {R}) AS mean_in, round(avg(log_ret) FILTER (NOT position > 0), {R}) AS mean_out, round(avg(ret) / stddev_samp(ret), {R}) AS sharpe, round(avg(ret) / stddev_samp(ret) FILTER (ret < 0), {R}) AS sortino"
M = ("total", "in_market", "mean_in", "mean_out", "sharpe", "sortino")


def exposed(spark, sf):
    return edge.exposure_returns(bars_1h(spark, sf).withColumn("signal", F.col("close") > F.col("open")))


@query("exposure_returns", f"WITH {EXPO} SELECT symbol, {METRICS} FROM x GROUP BY symbol")
def exposure_returns(spark, sf):
    return rnd(edge.exposure_metrics(exposed(spark, sf), "symbol"), *M)


A, B, C = "close > open", f"close > lag(close, 3) OVER {W}", "volume >= 5"
COMBO = f"{BARS_1H}, f AS (SELECT *, {A} AS a, coalesce({B}, false) AS b, {C} AS c FROM bars), u AS (SELECT 'and' AS combo, *, a AND b AND c AS s FROM f UNION ALL SELECT 'or', *, a OR b OR c FROM f UNION ALL SELECT 'two', *, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) >= 2 FROM f), r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY combo, symbol ORDER BY ts)) AS log_ret, coalesce(lag(CASE WHEN s THEN 1.0 ELSE 0 END) OVER (PARTITION BY combo, symbol ORDER BY ts), 0)::DOUBLE AS position FROM u), x AS (SELECT *, position * log_ret AS ret FROM r WHERE log_ret IS NOT NULL)"


@query("combo_signals", f"WITH {COMBO} SELECT combo, symbol, {METRICS} FROM x GROUP BY 1, 2")
def combo_signals(spark, sf):
    b = bars_1h(spark, sf).withColumns({"a": F.expr(A), "b": F.coalesce(F.expr(B), F.lit(False)), "c": F.expr(C)})
    out = None
    for name, s in (("and", "a and b and c"), ("or", "a or b or c"), ("two", "int(a) + int(b) + int(c) >= 2")):
        m = edge.exposure_metrics(edge.exposure_returns(b.withColumn("signal", F.expr(s))), "symbol").withColumn("combo", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return rnd(out, *M)


PHASES = f"{EXPO}, dd AS (SELECT symbol, date_trunc('day', ts) AS day, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2), ph AS (SELECT symbol, day, CASE WHEN f > 0.5 THEN 'bull' WHEN f < -0.3 THEN 'bear' ELSE 'sideways' END AS phase FROM (SELECT *, lead(close, 5) OVER (PARTITION BY symbol ORDER BY day) / close - 1 AS f FROM dd)), y AS (SELECT x.*, phase FROM x ASOF LEFT JOIN ph ON x.symbol = ph.symbol AND x.ts >= ph.day), z AS (SELECT *, phase AS regime FROM y UNION ALL SELECT *, 'all' FROM y)"


@query("regime_edge", f"WITH {PHASES} SELECT regime, {METRICS}, count(*) AS n_bars, round(sum(log_ret), {R}) AS hold_total, round(avg(log_ret) / stddev_samp(log_ret), {R}) AS hold_sharpe, sum(ret) > sum(log_ret) AS better FROM z GROUP BY regime HAVING count(*) >= 20")
def regime_edge(spark, sf):
    b = bars_1h(spark, sf)
    days = b.groupBy("symbol", F.date_trunc("day", "ts").alias("ts")).agg(F.max_by("close", "ts").alias("close"))
    rows = asof.asof(exposed(spark, sf), combine.market_phase(days, 5).select("symbol", "ts", "phase"), ["phase"])
    return rnd(edge.regime_metrics(rows), *M, "hold_total", "hold_sharpe")
