"""Queries of portfolio construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import portfolio as pf
from tidemark.plans import sqlstats
from tidemark.plans.fixtures import BARS_1H, bars_1h, table
from tidemark.plans.registry import query
from tidemark.sources.scratch import folder

R = 6
W = "(PARTITION BY strategy_id ORDER BY t)"
#: Hourly returns of close + 100 at hours that all symbols have.
RETS = f"{BARS_1H}, c0 AS (SELECT symbol AS strategy_id, CAST(epoch(ts) AS BIGINT) AS t, close + 100 AS equity FROM bars), curves AS MATERIALIZED (SELECT * FROM c0 WHERE t IN (SELECT t FROM c0 GROUP BY t HAVING count(*) = (SELECT count(DISTINCT strategy_id) FROM c0))), rets AS MATERIALIZED (SELECT * FROM (SELECT *, equity / lag(equity) OVER {W} - 1 AS ret FROM curves) WHERE ret IS NOT NULL)"
PAIRS = f"{RETS}, prs AS MATERIALIZED (SELECT a.strategy_id AS a, b.strategy_id AS b, a.t, a.ret AS x, b.ret AS y FROM rets a JOIN rets b ON a.t = b.t AND a.strategy_id < b.strategy_id), rho AS MATERIALIZED (SELECT a, b, corr(x, y) AS rho FROM prs GROUP BY 1, 2)"
COV = f"{PAIRS}, cov AS MATERIALIZED (SELECT a, b, covar_samp(x, y) AS cov FROM prs GROUP BY 1, 2 UNION ALL SELECT b, a, covar_samp(x, y) FROM prs GROUP BY 1, 2 UNION ALL SELECT strategy_id, strategy_id, var_samp(ret) FROM rets GROUP BY 1)"


def curves(spark, sf):
    c = bars_1h(spark, sf).select(F.col("symbol").alias("strategy_id"), F.unix_seconds("ts").alias("t"), (F.col("close") + 100).alias("equity"))
    return pf.shared_only(c)


def rets(spark, sf):
    return curves(spark, sf).withColumn("ret", F.col("equity") / F.lag("equity").over(pf.S()) - 1).where("ret is not null").drop("equity")


def names(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("strategy_id")).distinct()


def weights(spark, sf):
    return pf.equal_weights(names(spark, sf))


def rnd(df, *cols, places=R):
    return df.withColumns({c: F.round(c, places) for c in cols})


def checkpointed(spark):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder(spark, "checkpoints"))


@query("pairwise_self_join", f"WITH {PAIRS} SELECT a, b, count(*) AS n, round(sum(x * y), 8) AS xy FROM prs GROUP BY 1, 2")
def pairwise_self_join(spark, sf):
    return pf.pair_sums(rets(spark, sf)).select("a", "b", F.col("n").cast("long").alias("n"), F.round("xy", 8).alias("xy"))


@query("corr_pearson", f"WITH {PAIRS} SELECT a, b, round(rho, {R}) AS rho FROM rho")
def corr_pearson(spark, sf):
    return rnd(pf.correlations(rets(spark, sf)), "rho")


@query("corr_spearman", f"WITH {RETS}, k AS (SELECT *, rank() OVER (PARTITION BY strategy_id ORDER BY ret) + (count(*) OVER (PARTITION BY strategy_id, ret) - 1) / 2.0 AS r FROM rets) SELECT a.strategy_id AS a, b.strategy_id AS b, round(corr(a.r, b.r), {R}) AS rho FROM k a JOIN k b ON a.t = b.t AND a.strategy_id < b.strategy_id GROUP BY 1, 2")
def corr_spearman(spark, sf):
    return rnd(pf.spearman_correlations(rets(spark, sf)), "rho")


DD = f"{RETS}, d AS (SELECT *, (max(equity) OVER {W} - equity) / max(equity) OVER {W} AS dd FROM curves), dr AS MATERIALIZED (SELECT a.strategy_id AS a, b.strategy_id AS b, corr(a.dd, b.dd) AS rho FROM d a JOIN d b ON a.t = b.t AND a.strategy_id < b.strategy_id GROUP BY 1, 2)"


@query("corr_drawdown", f"WITH {DD} SELECT a, b, round(rho, {R}) AS rho FROM dr")
def corr_drawdown(spark, sf):
    return rnd(pf.drawdown_correlations(curves(spark, sf)), "rho")


@query("corr_clusters", f"WITH RECURSIVE {RETS.replace('rets AS', 'rets AS')}, {DD.split(RETS + ', ')[1]}, l AS (SELECT a, b FROM dr WHERE abs(rho) >= 0.05 UNION SELECT b, a FROM dr WHERE abs(rho) >= 0.05), reach AS (SELECT DISTINCT strategy_id AS a, strategy_id AS b FROM curves UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a) SELECT a AS strategy_id, min(b) AS cluster FROM reach GROUP BY 1")
def corr_clusters(spark, sf):
    checkpointed(spark)
    return pf.clusters(pf.drawdown_correlations(curves(spark, sf)), names(spark, sf), 0.05)


@query("effective_n", f"WITH {PAIRS} SELECT round(avg(abs(rho)), {R}) AS mean_abs_rho, round(5 / (1 + 4 * avg(abs(rho))), {R}) AS effective_n, round(25 / (5 + 2 * sum(rho * rho)), {R}) AS effective_n_eigen FROM rho")
def effective_n(spark, sf):
    return rnd(pf.effective_n(pf.correlations(rets(spark, sf)), 5), "mean_abs_rho", "effective_n", "effective_n_eigen")


@query("effective_n_eigen", f"WITH {PAIRS} SELECT round(25 / (5 + 2 * sum(rho * rho)), {R}) AS effective_n_eigen FROM rho")
def effective_n_eigen(spark, sf):
    return effective_n(spark, sf).select("effective_n_eigen")


@query("top_pairs", f"WITH {PAIRS} SELECT a, b, round(rho, {R}) AS rho FROM rho ORDER BY abs(rho) DESC, a, b LIMIT 5")
def top_pairs(spark, sf):
    return rnd(pf.correlations(rets(spark, sf)).orderBy(F.desc(F.abs("rho")), "a", "b").limit(5), "rho")


PORT = f"{RETS}, port AS MATERIALIZED (SELECT t, sum(ret * 0.2) AS ret FROM rets GROUP BY t)"


@query("weights_join", f"WITH {PORT} SELECT t, round(ret, {R}) AS ret FROM port")
def weights_join(spark, sf):
    return rnd(pf.portfolio_returns(rets(spark, sf), weights(spark, sf)), "ret")


@query("weights_equal", "SELECT DISTINCT event_type AS strategy_id, 0.2::DOUBLE AS weight FROM events")
def weights_equal(spark, sf):
    return weights(spark, sf)


def directed(spark, sf):
    return names(spark, sf).withColumn("direction", F.when(F.col("strategy_id") < "f", "long").otherwise("short"))


@query("weights_regime", f"WITH n AS (SELECT DISTINCT event_type AS strategy_id, CASE WHEN event_type < 'f' THEN 0.7 ELSE 0.3 END AS w FROM events) SELECT strategy_id, round(w / sum(w) OVER (), {R})::DOUBLE AS weight FROM n")
def weights_regime(spark, sf):
    return rnd(pf.regime_weights(directed(spark, sf), 0.7), "weight")


@query("diversification_ratio", f"WITH {PORT}, s AS (SELECT sum(s * 0.2) AS sum_vol FROM (SELECT stddev_samp(ret) AS s FROM rets GROUP BY strategy_id)) SELECT round(sum_vol, {R}) AS sum_vol, round(stddev_samp(ret), {R}) AS vol, round(sum_vol / stddev_samp(ret), {R}) AS ratio FROM port, s GROUP BY sum_vol")
def diversification_ratio(spark, sf):
    return rnd(pf.diversification(rets(spark, sf), weights(spark, sf)), "sum_vol", "vol", "ratio")


@query("portfolio_stats", f"WITH {PORT} SELECT round(avg(ret), 8) AS mean, round(stddev_samp(ret), 8) AS vol, round(avg(ret) / stddev_samp(ret), {R}) AS sharpe FROM port")
def portfolio_stats(spark, sf):
    return rnd(rnd(pf.portfolio_stats(rets(spark, sf), weights(spark, sf)), "mean", "vol", places=8), "sharpe")


@query("covariance_table", f"WITH {COV} SELECT a, b, round(cov, 9) AS cov FROM cov")
def covariance_table(spark, sf):
    return rnd(pf.covariances(rets(spark, sf)), "cov", places=9)


def stats(spark, sf):
    s = rets(spark, sf).groupBy("strategy_id").agg((F.avg("ret") / F.stddev_samp("ret")).alias("sharpe"), F.stddev_samp("ret").alias("vol"))
    return s.withColumns({"archetype": F.substring("strategy_id", 1, 1), "market": F.when(F.col("strategy_id") < "p", "x_1h").otherwise("y_1h")})


@query("select_greedy")
def select_greedy(spark, sf):
    r = rets(spark, sf)
    return rnd(pf.select_greedy(stats(spark, sf), pf.covariances(r), pf.correlations(r), 3, 2, 2, 0.9), "ratio")


STATS = "st AS MATERIALIZED (SELECT strategy_id, avg(ret) / stddev_samp(ret) AS sharpe FROM rets GROUP BY 1)"


@query("dedup_correlated", f"WITH RECURSIVE {PAIRS}, {STATS}, o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY sharpe DESC, strategy_id DESC) AS k FROM st), l AS (SELECT a, b FROM rho WHERE abs(rho) > 0.01 UNION SELECT b, a FROM rho WHERE abs(rho) > 0.01), keep AS (SELECT 1::BIGINT AS k, [strategy_id] AS kept FROM o WHERE k = 1 UNION ALL SELECT o.k, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.a = o.strategy_id AND list_contains(keep.kept, l.b)) THEN keep.kept ELSE list_append(keep.kept, o.strategy_id) END FROM keep JOIN o ON o.k = keep.k + 1) SELECT strategy_id, round(sharpe, {R}) AS sharpe FROM st WHERE strategy_id IN (SELECT unnest(kept) FROM keep WHERE k = (SELECT max(k) FROM o))")
def dedup_correlated(spark, sf):
    checkpointed(spark)
    return rnd(pf.dedup_correlated(stats(spark, sf).select("strategy_id", "sharpe"), pf.correlations(rets(spark, sf)), 0.01), "sharpe")


@query("borrow_haircut", f"WITH {RETS}, n AS (SELECT *, CASE WHEN strategy_id >= 'f' THEN ret - 0.001 ELSE ret END AS net FROM rets) SELECT strategy_id, round(avg(ret) / stddev_samp(ret), {R}) AS before, round(avg(net) / stddev_samp(net), {R}) AS after, round(avg(net) / stddev_samp(net) - avg(ret) / stddev_samp(ret), {R}) AS change FROM n GROUP BY 1")
def borrow_haircut(spark, sf):
    return rnd(pf.borrow_haircut(rets(spark, sf).join(directed(spark, sf), "strategy_id"), 0.001), "before", "after", "change")


SHRINK = f"{COV}, x AS (SELECT strategy_id, t, ret - avg(ret) OVER (PARTITION BY strategy_id) AS x FROM rets), f AS (SELECT sum(q) AS top, count(DISTINCT t) AS n FROM (SELECT p.t, (p.x * q.x - cov) ** 2 AS q FROM x p JOIN x q USING (t) JOIN cov ON cov.a = p.strategy_id AND cov.b = q.strategy_id)), g AS (SELECT sum((cov - CASE WHEN a = b THEN m ELSE 0 END) ** 2) AS below FROM cov, (SELECT sum(cov) / 5 AS m FROM cov WHERE a = b))"


@query("shrinkage_intensity", f"WITH {SHRINK} SELECT round(greatest(0, least(1, top / (n * n * below))), {R}) AS alpha FROM f, g")
def shrinkage_intensity(spark, sf):
    return rnd(pf.shrinkage_intensity(rets(spark, sf)), "alpha")


@query("ensemble_static", f"WITH {PORT}, e AS (SELECT t, ret AS all_, ln(1000) + sum(ln(1 + ret)) OVER (ORDER BY t) AS log_equity FROM port) SELECT strategy_id, t, round(all_, {R}) AS ret, round(log_equity, {R}) AS log_equity, round(ln(200) + sum(ln(1 + ret)) OVER {W}, {R}) AS log_contribution FROM rets JOIN e USING (t)")
def ensemble_static(spark, sf):
    r, w = rets(spark, sf), weights(spark, sf)
    out = pf.ensemble_contributions(r, w, 1000.0).join(pf.ensemble_static(r, w, 1000.0), "t")
    return rnd(out, "ret").select("strategy_id", "t", "ret", F.round(F.ln("equity"), R).alias("log_equity"), F.round(F.ln("contribution"), R).alias("log_contribution"))


REB = f"{RETS}, n AS (SELECT *, (row_number() OVER {W} - 1) // 24 AS period FROM rets), g AS (SELECT strategy_id, period, t, exp(sum(ln(1 + ret)) OVER (PARTITION BY strategy_id, period ORDER BY t)) AS g FROM n), s AS (SELECT period, t, sum(g * 0.2) AS g FROM g GROUP BY 1, 2), e AS (SELECT period, exp(coalesce(sum(ln(e)) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS base FROM (SELECT period, arg_max(g, t) AS e FROM s GROUP BY 1))"


@query("ensemble_rebalanced", f"WITH {REB}, w AS (SELECT strategy_id, n.t, row_number() OVER (PARTITION BY strategy_id ORDER BY n.t) % 24 = 0 AS last_, g.g * 0.2 AS own FROM n JOIN g USING (strategy_id, period, t)) SELECT strategy_id, s.t, round(ln(1000) + ln(base) + ln(g), {R}) AS log_equity, round(CASE WHEN last_ THEN 0.2 ELSE own / g END, {R}) AS weight FROM s JOIN e USING (period) JOIN w ON w.t = s.t")
def ensemble_rebalanced(spark, sf):
    out = pf.ensemble_weights(rets(spark, sf), weights(spark, sf), 1000.0, "daily")
    return out.select("strategy_id", "t", F.round(F.ln("equity"), R).alias("log_equity"), F.round("weight", R).alias("weight"))


NOISE = f"tr AS (SELECT trial, strategy_id, 0.2 * (1 + 0.1 * (2 * ({sqlstats.draw('1000003', '1', 'trial', 'strategy_id')} / 1000003.0::DOUBLE) - 1)) AS w FROM range(200) AS r(trial), (SELECT DISTINCT strategy_id FROM rets)), nw AS (SELECT trial, strategy_id, w / sum(w) OVER (PARTITION BY trial) AS w FROM tr), tp AS (SELECT trial, sum(w * m) AS m FROM nw JOIN (SELECT strategy_id, avg(ret) AS m FROM rets GROUP BY 1) USING (strategy_id) GROUP BY 1), vr AS (SELECT x.trial, sum(x.w * y.w * cov) AS v FROM nw x JOIN nw y USING (trial) JOIN cov ON a = x.strategy_id AND b = y.strategy_id GROUP BY 1), wp AS MATERIALIZED (SELECT avg(s) AS mean, stddev_samp(s) AS sd, min(s) AS least, max(s) AS most, stddev_samp(s) / abs(avg(s)) AS cv FROM (SELECT m / sqrt(v) AS s FROM tp JOIN vr USING (trial)))"


@query("weight_perturbation", f"WITH {COV}, {NOISE} SELECT " + ", ".join(f"round({c}, {R}) AS {c}" for c in ("mean", "sd", "least", "most", "cv")) + " FROM wp")
def weight_perturbation(spark, sf):
    return rnd(pf.weight_perturbation(rets(spark, sf), weights(spark, sf), 200), "mean", "sd", "least", "most", "cv")


FALLS = f"port AS MATERIALIZED (SELECT t, sum(ret * 0.2) AS ret FROM rets GROUP BY t), num AS (SELECT row_number() OVER (ORDER BY t) - 1 AS k, ret FROM port), grid AS (SELECT sim, b, n, {sqlstats.draw('n - 23', '1', 'sim', 'b')} AS start FROM (SELECT count(*) AS n FROM num), range(50) AS r(sim), LATERAL (SELECT unnest(range(CAST(ceil(n / 24.0) AS BIGINT))) AS b)), ph AS (SELECT sim, b * 24 + j AS i, exp(sum(ln(1 + ret)) OVER (PARTITION BY sim ORDER BY b * 24 + j)) AS e FROM grid, range(24) AS q(j) JOIN num ON num.k = start + j WHERE b * 24 + j < n), dd AS (SELECT quantile_cont(d, 0.95) AS p95 FROM (SELECT sim, max(1 - e / greatest(1, m)) AS d FROM (SELECT *, max(e) OVER (PARTITION BY sim ORDER BY i) AS m FROM ph) GROUP BY 1))"


@query("stress_verdict", f"WITH {COV}, {NOISE}, {FALLS} SELECT round(cv, {R}) AS cv, round(p95, {R}) AS p95, p95 < 0.5 AND round(cv, {R}) < 0.3 AS passed FROM wp, dd")
def stress_verdict(spark, sf):
    from tidemark.operators.overfit import block_bootstrap

    cv = weight_perturbation(spark, sf).select("cv")
    dd = block_bootstrap(pf.portfolio_returns(rets(spark, sf), weights(spark, sf)), 50, 24).agg(F.percentile("max_dd", 0.95).alias("p95"))
    return cv.crossJoin(dd).select(F.round("cv", R).alias("cv"), F.round("p95", R).alias("p95"), ((F.col("p95") < 0.5) & (F.col("cv") < 0.3)).alias("passed"))  # one row each


@query("portfolio_is_oos", f"WITH {RETS}, p AS (SELECT *, CASE WHEN row_number() OVER {W} <= floor(count(*) OVER (PARTITION BY strategy_id) * 0.7::DOUBLE) THEN 'is' ELSE 'oos' END AS part FROM rets), s AS (SELECT strategy_id, avg(ret) FILTER (part = 'is') / stddev_samp(ret) FILTER (part = 'is') AS a, avg(ret) FILTER (part = 'oos') / stddev_samp(ret) FILTER (part = 'oos') AS b FROM p GROUP BY 1) SELECT strategy_id, round(a, {R}) AS is_sharpe, round(b, {R}) AS oos_sharpe, round(a - b, {R}) AS degradation, b > 0 AS positive FROM s ORDER BY a DESC, strategy_id LIMIT 3")
def portfolio_is_oos(spark, sf):
    n = F.count("*").over(pf.Window.partitionBy("strategy_id"))
    p = rets(spark, sf).withColumn("oos", F.row_number().over(pf.S()) > F.floor(n * 0.7))
    sharpe = lambda c: F.avg(F.when(c, F.col("ret"))) / F.stddev_samp(F.when(c, F.col("ret")))
    s = p.groupBy("strategy_id").agg(sharpe(~F.col("oos")).alias("is_sharpe"), sharpe(F.col("oos")).alias("oos_sharpe"))
    top = s.orderBy(F.desc("is_sharpe"), "strategy_id").limit(3)
    return rnd(top.withColumns({"degradation": F.col("is_sharpe") - F.col("oos_sharpe"), "positive": F.col("oos_sharpe") > 0}), "is_sharpe", "oos_sharpe", "degradation")


@query("candidate_pool", "WITH x AS (SELECT o_orderkey AS trial, o_orderpriority AS study, md5(concat(o_orderstatus, o_custkey % 100)) AS hash, o_totalprice AS value, (o_custkey % 100) / 100.0 AS pbo FROM orders), y AS (SELECT * FROM x WHERE pbo < 0.5 QUALIFY row_number() OVER (PARTITION BY study ORDER BY value DESC, trial) <= 3) SELECT hash, min(trial) AS trial FROM y GROUP BY hash")
def candidate_pool(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("trial"), F.col("o_orderpriority").alias("study"), F.md5(F.concat("o_orderstatus", (F.col("o_custkey") % 100).cast("string"))).alias("hash"), F.col("o_totalprice").alias("value"), ((F.col("o_custkey") % 100) / 100).alias("pbo"))
    w = pf.Window.partitionBy("study").orderBy(F.desc("value"), "trial")
    top = o.where("pbo < 0.5").withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    return top.groupBy("hash").agg(F.min("trial").alias("trial"))
