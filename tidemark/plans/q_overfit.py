"""Queries of walk-forward, overfitting statistics and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof, edge, overfit, perf
from tidemark.operators import portfolio as pf
from tidemark.plans.q_perf import TRADES
from tidemark.plans.fixtures import BARS_1H, bars_1h, table
from tidemark.plans.q_portfolio import PAIRS, RETS, R, rets, rnd
from tidemark.plans.q_portfolio import weights as equal
from tidemark.plans import sqlstats
from tidemark.plans.registry import query

#: Candidates are the hourly strategies; t counts bars from 0.
CAND = f"{RETS}, cand AS MATERIALIZED (SELECT strategy_id AS candidate, row_number() OVER (PARTITION BY strategy_id ORDER BY t) - 1 AS t, ret FROM rets)"
FOLDS = "folds AS (SELECT CAST(i AS INT) AS fold, i * step AS is_start, i * step + 150 AS is_end, i * step + 160 AS oos_start, i * step + 200 AS oos_end FROM (SELECT (max(t) + 1 - 200) // 3 AS step FROM cand), range(4) AS r(i))"
PARTS = f"{CAND}, {FOLDS}, parts AS MATERIALIZED (SELECT candidate, fold, t, ret, CASE WHEN t >= oos_start THEN 'oos' ELSE 'is' END AS part FROM cand JOIN folds ON (t >= is_start AND t < is_end) OR (t >= oos_start AND t < oos_end)), fm AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY is_metric DESC, candidate) = 1 AS best FROM (SELECT candidate, fold, avg(ret) FILTER (part = 'is') / stddev_samp(ret) FILTER (part = 'is') AS is_metric, avg(ret) FILTER (part = 'oos') / stddev_samp(ret) FILTER (part = 'oos') AS oos_metric FROM parts GROUP BY 1, 2))"


def cand(spark, sf):
    r = rets(spark, sf)
    return r.select(F.col("strategy_id").alias("candidate"), (F.row_number().over(pf.S()) - 1).cast("long").alias("t"), "ret")


def folds(spark, sf, anchored=False):
    return overfit.splits(cand(spark, sf), 4, 150, 10, 40, anchored)


def parts(spark, sf):
    return asof.fold_range_join(cand(spark, sf), folds(spark, sf))


@query("wf_splits", f"WITH {CAND}, {FOLDS} SELECT 'rolling' AS mode, * FROM folds UNION ALL SELECT 'anchored', fold, 0, is_end, oos_start, oos_end FROM folds")
def wf_splits(spark, sf):
    a = folds(spark, sf).withColumn("mode", F.lit("rolling"))
    return a.unionByName(folds(spark, sf, anchored=True).withColumn("mode", F.lit("anchored")))


@query("wf_fold_metrics", f"WITH {PARTS} SELECT candidate, fold, round(is_metric, {R}) AS is_metric, round(oos_metric, {R}) AS oos_metric, best FROM fm")
def wf_fold_metrics(spark, sf):
    return rnd(overfit.fold_metrics(parts(spark, sf)), "is_metric", "oos_metric")


@query("wf_oos_curve", f"WITH {PARTS} SELECT candidate, fold, t, round(sum(ln(1 + ret)) OVER (PARTITION BY candidate ORDER BY fold, t), {R}) AS log_equity FROM parts WHERE part = 'oos'")
def wf_oos_curve(spark, sf):
    return overfit.oos_curve(parts(spark, sf), 1.0).select("candidate", "fold", "t", F.round(F.ln("equity"), R).alias("log_equity"))


DEG = "SELECT candidate, round(avg(is_metric / oos_metric) FILTER (oos_metric <> 0), 4) AS degradation, count(*) FILTER (oos_metric > 0) AS profitable_folds FROM fm GROUP BY 1"


@query("wf_degradation", f"WITH {PARTS} {DEG}")
def wf_degradation(spark, sf):
    return rnd(overfit.degradation(overfit.fold_metrics(parts(spark, sf))), "degradation", places=4)


@query("fold_consistency", f"WITH {PARTS} SELECT candidate, profitable_folds FROM ({DEG})")
def fold_consistency(spark, sf):
    return overfit.degradation(overfit.fold_metrics(parts(spark, sf))).select("candidate", "profitable_folds")


def BLK(n, rest=True):
    """Blocks of every candidate; what remains goes to the last one, or goes."""
    b = f"CAST(floor(t / floor(count(*) OVER (PARTITION BY candidate) / {n}.0)) AS INT)"
    return f"{CAND}, blk AS MATERIALIZED (SELECT * FROM (SELECT *, {f'least({b}, {n - 1})' if rest else b} AS block FROM cand) WHERE block < {n})"


def SHARPE(x="ret"):
    return f"CASE WHEN stddev_samp({x}) > 1e-12 THEN avg({x}) / stddev_samp({x}) ELSE 0 END"


PBO = f"{BLK(16)}, sm AS (SELECT candidate, block, {SHARPE()} AS s FROM (SELECT *, row_number() OVER (PARTITION BY candidate, block ORDER BY t) AS i FROM blk) WHERE i > 1 GROUP BY 1, 2), msk AS (SELECT i AS mask FROM range(65536) AS r(i) WHERE bit_count(i) = 8), sh AS (SELECT mask, candidate, avg(s) FILTER ((mask >> block) & 1 = 1) AS a, avg(s) FILTER ((mask >> block) & 1 = 0) AS b FROM sm, msk GROUP BY 1, 2), rk AS (SELECT *, (row_number() OVER (PARTITION BY mask ORDER BY b, candidate) - 1) / (count(*) OVER (PARTITION BY mask) - 1.0) AS w FROM sh), bs AS (SELECT least(greatest(arg_min(w, (-a, candidate)), 0.01), 0.99) AS w FROM rk GROUP BY mask), pbo AS MATERIALIZED (SELECT avg(CASE WHEN ln(w / (1 - w)) <= 0 THEN 1.0 ELSE 0 END) AS pbo, avg(ln(w / (1 - w))) AS mean_logit, count(*) AS n_splits FROM bs)"


@query("pbo_cscv", f"WITH {PBO} SELECT round(pbo, {R}) AS pbo, round(mean_logit, {R}) AS mean_logit, n_splits FROM pbo")
def pbo_cscv(spark, sf):
    return rnd(overfit.pbo(cand(spark, sf)), "pbo", "mean_logit")


@query("temporal_pbo", f"WITH {BLK(8, rest=False)}, p AS (SELECT candidate, block, sum(ret) AS s FROM blk GROUP BY 1, 2), msk AS (SELECT i AS mask FROM range(256) AS r(i) WHERE bit_count(i) = 4), e AS (SELECT candidate, mask, sum(s) FILTER ((mask >> block) & 1 = 1) AS a, sum(s) FILTER ((mask >> block) & 1 = 0) AS b FROM p, msk GROUP BY 1, 2) SELECT candidate, round(avg(CASE WHEN a > 0 AND b <= 0 THEN 1.0 ELSE 0 END), {R}) AS temporal_pbo, count(*) FILTER (a > 0 AND b <= 0) AS overfit, count(*) AS n_splits FROM e GROUP BY 1")
def temporal_pbo(spark, sf):
    return rnd(overfit.temporal_pbo(cand(spark, sf)), "temporal_pbo")


SKEW = "(avg(ret ** 3) - 3 * avg(ret) * avg(ret ** 2) + 2 * avg(ret) ** 3) / stddev_pop(ret) ** 3"
MOM = f'{SHARPE()} AS sr, {SKEW} AS skew, kurtosis_pop(ret) AS kurt, count(*) AS "T"'


def DSR(trials):
    stat = f'((sr - {overfit.expected_max(trials)!r} / sqrt("T")) * sqrt("T" - 1) / sqrt(1 - skew * sr + kurt / 4 * sr * sr))'
    return f'dsr AS MATERIALIZED (SELECT candidate, sr, skew, kurt, "T", {overfit.expected_max(trials)!r} / sqrt("T") AS expected_max, {sqlstats.normal_cdf(stat)} AS dsr FROM (SELECT candidate, {MOM} FROM cand GROUP BY 1))'


@query("dsr", f'WITH {CAND}, {DSR(3)} SELECT candidate, round(sr, {R}) AS sr, round(skew, 4) AS skew, round(kurt, 4) AS kurt, "T", round(expected_max, {R}) AS expected_max, round(dsr, {R}) AS dsr FROM dsr')
def dsr(spark, sf):
    out = overfit.deflated_sharpe(cand(spark, sf), 3)
    return rnd(rnd(out, "sr", "expected_max", "dsr"), "skew", "kurt", places=4)


PORT = "port AS MATERIALIZED (SELECT t, avg(ret) AS ret FROM rets GROUP BY t)"
PDSR = f"pd AS MATERIALIZED (SELECT *, sqrt(greatest((1 - skew * sr + (kurt + 2) / 4 * sr * sr) / (\"T\" - 1), 1e-12)) AS sd FROM (SELECT {MOM.replace(SHARPE(), 'avg(ret) / stddev_samp(ret)')} FROM port))"
PDSR_P = f"CASE WHEN \"T\" < 30 THEN 0 ELSE {sqlstats.normal_cdf(f'((sr - sd * {overfit.expected_max(100)!r}) / sd)')} END"


def portfolio(spark, sf):
    return pf.portfolio_returns(rets(spark, sf), equal(spark, sf))


@query("dsr_portfolio", f'WITH {RETS}, {PORT}, {PDSR} SELECT round(sr, {R}) AS sr, round(skew, {R}) AS skew, round(kurt, {R}) AS kurt, "T", round(sd, {R}) AS sd, round(sd * {overfit.expected_max(100)!r}, {R}) AS expected_max, round({PDSR_P}, {R}) AS dsr FROM pd')
def dsr_portfolio(spark, sf):
    return rnd(overfit.deflated_sharpe_portfolio(portfolio(spark, sf), 100), "sr", "skew", "kurt", "sd", "expected_max", "dsr")


#: Rows are drawn one by one here, without prefix sums.
SPA = (
    "x AS MATERIALIZED (SELECT a.candidate, a.ret - b.ret AS x, row_number() OVER (PARTITION BY a.candidate ORDER BY a.t) - 1 AS k FROM cand a JOIN cand b ON a.t = b.t AND b.candidate = 'click' AND a.candidate <> 'click'), "
    "xm AS (SELECT candidate, count(*) AS n, avg(x) AS excess, 1 / floor(sqrt(count(*))) AS stop, CAST(ceil(count(*) / floor(sqrt(count(*))) + 8 * sqrt(count(*) / floor(sqrt(count(*)))) + 20) AS BIGINT) AS most FROM x GROUP BY 1 HAVING count(*) >= 10), "
    f"bl AS (SELECT candidate, n, most, rep, b, CAST(1 + floor(ln(({sqlstats.draw('1099511627776', '1', chr(39) + 'length' + chr(39), 'rep', 'b')} + 0.5) / 1099511627776) / ln(1 - stop)) AS BIGINT) AS length, {sqlstats.draw('n', '1', 'rep', 'b')} AS start FROM xm, range(1, 201) AS r(rep), LATERAL (SELECT unnest(range(1, most + 1)) AS b)), "
    "cut AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY candidate, rep ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bl), "
    "dr AS (SELECT candidate, rep, (start + j) % n AS k FROM cut, LATERAL (SELECT unnest(range(CAST(CASE WHEN b = most THEN n - before ELSE least(length, n - before) END AS BIGINT))) AS j) WHERE before < n), "
    "ms AS MATERIALIZED (SELECT candidate, rep, avg(x) AS m FROM dr JOIN x USING (candidate, k) GROUP BY 1, 2), sds AS (SELECT candidate, stddev_pop(m) AS sd FROM ms GROUP BY 1), "
    "ps AS (SELECT candidate, any_value(excess) AS excess, any_value(n) AS n, any_value(excess / sd) AS statistic, avg(CASE WHEN m - greatest(excess, 0) >= excess THEN 1.0 ELSE 0 END) AS lower, avg(CASE WHEN m - CASE WHEN excess >= -sd * sqrt(2 * ln(ln(n))) THEN excess ELSE 0 END >= excess THEN 1.0 ELSE 0 END) AS consistent, avg(CASE WHEN m - excess >= excess THEN 1.0 ELSE 0 END) AS upper FROM ms JOIN xm USING (candidate) JOIN sds USING (candidate) GROUP BY 1), "
    "spa AS MATERIALIZED (SELECT *, greatest(lower, consistent, upper) AS p FROM ps)"
)


def versus(spark, sf):
    """Candidates against one of them as the benchmark."""
    c = cand(spark, sf)
    return c.where("candidate <> 'click'"), c.where("candidate = 'click'").select("t", "ret")


@query("spa_test", f"WITH {CAND}, {SPA} SELECT candidate, round(excess, {R}) AS excess, n, round(statistic, {R}) AS statistic, round(lower, {R}) AS lower, round(consistent, {R}) AS consistent, round(upper, {R}) AS upper, round(p, {R}) AS p FROM spa")
def spa_test(spark, sf):
    return rnd(overfit.superiority(*versus(spark, sf), reps=200), "excess", "statistic", "lower", "consistent", "upper", "p")


# limits under which the fixture's noise passes and fails
LIMITS = {"pbo_limit": 0.9, "dsr_limit": 0.2, "alpha": 0.6}


@query("overfit_funnel", f"WITH {PBO.replace('FROM cand)', 'FROM cand WHERE candidate <> ' + chr(39) + 'click' + chr(39) + ')', 1)}, {DSR(3)}, {SPA}, f AS (SELECT candidate, pbo <= {LIMITS['pbo_limit']} AS a, pbo <= {LIMITS['pbo_limit']} AND \"T\" >= 30 AND dsr > {LIMITS['dsr_limit']} AS b, pbo <= {LIMITS['pbo_limit']} AND \"T\" >= 30 AND dsr > {LIMITS['dsr_limit']} AND p < {LIMITS['alpha']} AS c, pbo, dsr, p FROM dsr JOIN spa USING (candidate), pbo) SELECT candidate, round(pbo, {R}) AS pbo, round(dsr, {R}) AS dsr, round(p, {R}) AS spa_p, a AS passed_pbo, b AS passed_dsr, c AS passed_spa, count(*) FILTER (a) OVER () AS n_pbo, count(*) FILTER (b) OVER () AS n_dsr, count(*) FILTER (c) OVER () AS n_spa FROM f")
def overfit_funnel(spark, sf):
    out = overfit.funnel(*versus(spark, sf), n_trials=3, reps=200, **LIMITS)
    n = out.agg(*[F.count_if(f"passed_{k}").alias(f"n_{k}") for k in ("pbo", "dsr", "spa")])
    return rnd(out.crossJoin(n), "pbo", "dsr", "spa_p")  # one row


def BSH(n, source="blk"):
    return f"bs AS MATERIALIZED (SELECT candidate, block, {SHARPE()} AS s FROM {source} GROUP BY 1, 2)"


@query("temporal_cv", f"WITH {BLK(6)}, {BSH(6)} SELECT candidate, count(*) FILTER (s > 0) AS positive, round(avg(s), {R}) AS mean, count(*) FILTER (s > 0) >= 5 AS passed FROM bs GROUP BY 1")
def temporal_cv(spark, sf):
    return rnd(overfit.temporal_cv(cand(spark, sf), 6), "mean")


def SLOPE_P(slope, r2, n):
    return f"CASE WHEN {n} > 2 THEN {sqlstats.t_two_sided(f'sqrt({r2} * ({n} - 2) / (1 - {r2}))', f'({n} - 2)')} END"


DECAY = f"dc AS MATERIALIZED (SELECT *, CASE WHEN abs(f) > 1e-12 THEN l / f ELSE 0 END AS ratio, {SLOPE_P('slope', 'r2', 'n_points')} AS p FROM (SELECT candidate, regr_slope(s, block) AS slope, regr_r2(s, block) AS r2, count(*) AS n_points, arg_min(s, block) AS f, arg_max(s, block) AS l FROM bs GROUP BY 1)), dcs AS MATERIALIZED (SELECT *, CASE WHEN p < 0.10 AND slope < 0 THEN 'decaying' WHEN p < 0.10 AND slope > 0 THEN 'improving' ELSE 'stable' END AS status FROM dc)"


@query("alpha_decay", f"WITH {BLK(8)}, {BSH(8)}, {DECAY} SELECT candidate, round(slope, {R}) AS slope, round(r2, {R}) AS r2, n_points, round(p, {R}) AS p, round(ratio, 4) AS ratio, status FROM dcs")
def alpha_decay(spark, sf):
    return rnd(rnd(overfit.alpha_decay(cand(spark, sf)), "slope", "r2", "p"), "ratio", places=4)


def VOL(source):
    run = "(PARTITION BY candidate ORDER BY t)"
    return f"v0 AS (SELECT *, row_number() OVER {run} AS k, least(60, count(*) OVER (PARTITION BY candidate) // 4) AS w, list(ret) OVER (PARTITION BY candidate ORDER BY t ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS l, exp(sum(ln(1 + ret)) OVER {run}) AS e FROM {source}), v1 AS (SELECT *, 1 - e / max(e) OVER {run} AS dd, list_aggregate(l[-w:], 'stddev_samp') AS vol FROM v0), v AS MATERIALIZED (SELECT * FROM v1 WHERE k > w), vc AS (SELECT candidate, quantile_cont(vol, 0.25) AS lo, quantile_cont(vol, 0.75) AS hi, count(*) AS n_all FROM v GROUP BY 1), vg AS MATERIALIZED (SELECT candidate, CASE WHEN dd > 0.05 THEN 'deep_drawdown' WHEN vol > hi THEN 'high_vol' WHEN vol < lo THEN 'low_vol' ELSE 'normal' END AS regime, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, {SHARPE()} AS sharpe, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS win_rate, count(*) / any_value(n_all) AS share FROM v JOIN vc USING (candidate) GROUP BY 1, 2), vr AS MATERIALIZED (SELECT candidate, regime, n, {', '.join(f'CASE WHEN n >= 10 THEN {c} ELSE 0 END AS {c}' for c in ('mean', 'sd', 'sharpe', 'win_rate', 'share'))} FROM vg), vs AS MATERIALIZED (SELECT candidate, coalesce(bool_and(sharpe > 0) FILTER (n >= 10), true) AS all_positive, coalesce(max(sharpe) FILTER (regime = 'high_vol'), 0) AS h, coalesce(max(sharpe) FILTER (regime = 'normal'), 0) AS m FROM vr GROUP BY 1)"


STRESS = "CASE WHEN abs(m) > 1e-12 THEN h / m ELSE 0 END"


# half of the peak is deep for the fixture's prices
@query("vol_regime_perf", f"WITH {CAND}, {VOL('cand').replace('dd > 0.05', 'dd > 0.5')} SELECT candidate, regime, n, {', '.join(f'round({c}, {R}) AS {c}' for c in ('mean', 'sd', 'sharpe', 'win_rate', 'share'))}, all_positive, round({STRESS}, 4) AS stress_ratio FROM vr JOIN vs USING (candidate)")
def vol_regime_perf(spark, sf):
    return rnd(rnd(overfit.vol_regime_perf(cand(spark, sf), deep=0.5), "mean", "sd", "sharpe", "win_rate", "share"), "stress_ratio", places=4)


def TAIL(source):
    return f"tp AS (SELECT candidate, quantile_cont(ret, 0.05) AS a, quantile_cont(ret, 0.01) AS b, quantile_cont(ret, 0.95) AS c FROM {source} GROUP BY 1), ti AS (SELECT candidate, max(c) AS losing_streak FROM (SELECT candidate, i, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY t) - row_number() OVER (PARTITION BY candidate, ret < 0 ORDER BY t) AS i FROM {source}) WHERE ret < 0 GROUP BY 1, 2) GROUP BY 1), tr AS MATERIALIZED (SELECT candidate, any_value(a) AS var95, any_value(b) AS var99, avg(ret) FILTER (ret <= a) AS cvar95, avg(ret) FILTER (ret <= b) AS cvar99, avg(ret) FILTER (ret >= c) / abs(avg(ret) FILTER (ret <= a)) AS tail_ratio, min(ret) AS worst, max(ret) AS best, avg(CASE WHEN ret < -0.02 THEN 1.0 ELSE 0 END) AS p_loss, {SKEW} AS skew, kurtosis_pop(ret) AS kurt, any_value(losing_streak) AS losing_streak FROM {source} JOIN tp USING (candidate) JOIN ti USING (candidate) GROUP BY 1)"


TAILS = ("var95", "var99", "cvar95", "cvar99", "tail_ratio", "worst", "best", "p_loss")


@query("tail_risk", f"WITH {CAND}, {TAIL('cand')} SELECT candidate, {', '.join(f'round({c}, {R}) AS {c}' for c in TAILS)}, round(skew, 4) AS skew, round(kurt, 4) AS kurt, losing_streak FROM tr")
def tail_risk(spark, sf):
    return rnd(rnd(overfit.tail_risk(cand(spark, sf)), *TAILS), "skew", "kurt", places=4)


ONE = "one AS MATERIALIZED (SELECT 'portfolio' AS candidate, t, ret FROM port), ob AS (SELECT *, CAST(least(floor((row_number() OVER (ORDER BY t) - 1) / floor(count(*) OVER () / 8.0)), 7) AS INT) AS block FROM one)"


@query("portfolio_verdict", f"WITH {PAIRS}, {PORT}, {PDSR}, {ONE}, {BSH(8, 'ob')}, {DECAY}, {VOL('one')}, {TAIL('one')}, en AS (SELECT 25 / (5 + 2 * sum(rho * rho)) AS effective_n FROM rho) SELECT round({PDSR_P}, {R}) AS dsr, {PDSR_P} > 0.95 AS dsr_significant, dcs.status AS decay_status, all_positive, round({STRESS}, 4) AS stress_ratio, round(cvar99, {R}) AS cvar99, round(tail_ratio, {R}) AS tail_ratio, round(effective_n, {R}) AS effective_n, {PDSR_P} > 0.95 AND dcs.status <> 'decaying' AND effective_n >= 5 AND all_positive AS passed FROM pd, dcs, vs, tr, en")
def portfolio_verdict(spark, sf):
    n = pf.effective_n(pf.correlations(rets(spark, sf)), 5).select(F.col("effective_n_eigen").alias("effective_n"))
    out = overfit.portfolio_verdict(portfolio(spark, sf), 100, n)
    return rnd(rnd(out, "dsr", "cvar99", "tail_ratio", "effective_n"), "stress_ratio", places=4)


@query("rolling_windows", "SELECT CAST(s AS DATE) AS start, CAST(s + INTERVAL 6 MONTHS AS DATE) AS \"end\", CAST(s AS DATE) + CAST((date_diff('day', CAST(s AS DATE), CAST(s + INTERVAL 6 MONTHS AS DATE)) // 2) AS INT) >= DATE '1999-01-01' AS oos, n FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 2 MONTHS)) AS s) w JOIN LATERAL (SELECT count(*) AS n FROM orders WHERE o_orderdate >= s AND o_orderdate < s + INTERVAL 6 MONTHS) x ON true WHERE s + INTERVAL 6 MONTHS <= TIMESTAMP '2001-12-31' AND n > 0")
def rolling_windows(spark, sf):
    w = overfit.rolling_windows(spark, "1995-01-01", "2001-12-31", 6, 2, "1999-01-01")
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"))
    return asof.period_range_join(o, w, "d").groupBy("start", "end", "oos").agg(F.count("*").alias("n"))


#: Windows are ten blocks; the equal-weight portfolio's return and deviation in a block make its regime.
METHODS = f"{BLK(10)}, rb AS (SELECT block, avg(ret) AS m, stddev_samp(ret) AS v FROM (SELECT t, any_value(block) AS block, avg(ret) AS ret FROM blk GROUP BY t) GROUP BY 1), rg AS (SELECT block, concat(CASE WHEN m > 0 THEN 'up' ELSE 'down' END, CASE WHEN v > median(v) OVER () THEN '_wild' ELSE '_calm' END) AS regime FROM rb), mt AS MATERIALIZED (SELECT candidate AS method, block AS window_, any_value(regime) AS regime, avg(ret) / stddev_samp(ret) AS sharpe, (exp(sum(ln(1 + ret))) - 1) * 100 AS total_return, max(-ret) * 100 AS max_dd FROM blk JOIN rg USING (block) GROUP BY 1, 2)"


def methods(spark, sf):
    b = overfit.blocks(cand(spark, sf), 10)
    port = b.groupBy("t").agg(F.first("block").alias("block"), F.avg("ret").alias("ret")).groupBy("block").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("v"))
    mid = port.agg(F.median("v").alias("mid"))
    regimes = port.crossJoin(mid).select("block", F.concat(F.when(F.col("m") > 0, "up").otherwise("down"), F.when(F.col("v") > F.col("mid"), "_wild").otherwise("_calm")).alias("regime"))  # one row
    m = b.join(regimes, "block").groupBy(F.col("candidate").alias("method"), F.col("block").alias("window"))
    return m.agg(F.first("regime").alias("regime"), overfit.sharpe().alias("sharpe"), ((F.exp(F.sum(F.log1p("ret"))) - 1) * 100).alias("total_return"), (F.max(-F.col("ret")) * 100).alias("max_dd"))


RS = f"rs AS (SELECT method, count(*) AS n, count(*) FILTER (sharpe > 0) AS k, avg(sharpe) AS mean_sharpe, max(max_dd) AS max_dd, regr_slope(sharpe, window_) AS slope, regr_r2(sharpe, window_) AS r2 FROM mt GROUP BY 1), rr AS (SELECT method, count(*) FILTER (s > 0) AS regimes_positive, count(*) AS regimes FROM (SELECT method, regime, avg(sharpe) AS s FROM mt GROUP BY 1, 2) GROUP BY 1), rp AS (SELECT *, {sqlstats.binom_sf('k', 'n', '0.5::DOUBLE')} AS p, {SLOPE_P('slope', 'r2', 'n')} AS slope_p FROM rs JOIN rr USING (method)), rt AS MATERIALIZED (SELECT *, CASE WHEN n < 3 THEN 'insufficient' WHEN slope_p < 0.10 AND slope < -0.01 THEN 'decaying' WHEN slope_p < 0.10 AND slope > 0.01 THEN 'improving' ELSE 'stable' END AS status FROM rp), sides AS (SELECT coalesce(avg(total_return) FILTER (method <> 'view'), 0) AS long, coalesce(avg(total_return) FILTER (method = 'view'), 0) AS short FROM mt)"


@query("rolling_summary", f"WITH {METHODS}, {RS} SELECT method, n, k, round(mean_sharpe, {R}) AS mean_sharpe, round(max_dd, {R}) AS max_dd, round(slope, {R}) AS slope, round(r2, {R}) AS r2, regimes_positive, regimes, round(p, {R}) AS p, round(slope_p, {R}) AS slope_p, status, row_number() OVER (ORDER BY k / n DESC, method) = 1 AS best, k / n >= 0.75 AND p < 0.05 AND status <> 'decaying' AND max_dd < 40 AND regimes_positive >= 4 AS passed, round(long, {R}) AS long, round(short, {R}) AS short FROM rt, sides")
def rolling_summary(spark, sf):
    m = methods(spark, sf)
    sides = m.select(F.when(F.col("method") == "view", "short").otherwise("long").alias("direction"), "total_return")
    return rnd(overfit.rolling_summary(m, sides), "mean_sharpe", "max_dd", "slope", "r2", "p", "slope_p", "long", "short")


@query("null_hit_rate", f"WITH {BLK(10)}, b AS (SELECT block AS seed, candidate, avg(ln(1 + ret)) > 0 AS passed FROM blk GROUP BY 1, 2), s AS (SELECT seed, avg(CASE WHEN passed THEN 1.0 ELSE 0 END) AS rate, count(*) AS n, count(*) FILTER (passed) AS k FROM b GROUP BY 1), w AS (SELECT sum(k) / sum(n) AS null_rate FROM s) SELECT seed, round(rate, {R}) AS rate, n, k, round(null_rate, {R}) AS null_rate, round(CASE WHEN null_rate > 0 THEN {sqlstats.binom_sf('4', '5', 'null_rate')} ELSE 0 END, {R}) AS p, null_rate < 0.05 AS valid FROM s, w")
def null_hit_rate(spark, sf):
    runs = overfit.blocks(cand(spark, sf), 10).groupBy(F.col("block").alias("seed"), "candidate").agg((F.avg(F.log1p("ret")) > 0).alias("passed"))
    return rnd(overfit.null_hit_rate(runs, 4, 5), "rate", "null_rate", "p")


@query("holdout_scatter", f"WITH {CAND}, s AS (SELECT candidate, avg(ret) FILTER (t < 300) / stddev_samp(ret) FILTER (t < 300) AS a, avg(ret) FILTER (t >= 300) / stddev_samp(ret) FILTER (t >= 300) AS b FROM cand GROUP BY 1) SELECT candidate, round(b - a, {R}) AS shift, round(median(b - a) OVER (), {R}) AS median_shift FROM s")
def holdout_scatter(spark, sf):
    c = cand(spark, sf)
    a = c.where("t < 300").groupBy("candidate").agg(overfit.sharpe().alias("a"))
    s = a.join(c.where("t >= 300").groupBy("candidate").agg(overfit.sharpe().alias("b")), "candidate").withColumn("shift", F.col("b") - F.col("a"))
    m = s.agg(F.median("shift").alias("median_shift"))  # one row
    return rnd(s.crossJoin(m).select("candidate", "shift", "median_shift"), "shift", "median_shift")


@query("metric_consistency", "WITH c AS (SELECT c_acctbal AS x, c_acctbal * (1 + (c_custkey % 7) / 10.0) AS y FROM customer), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM c) SELECT 1 AS k, round(corr(rx, ry), 6) AS ic, count(*) AS n FROM r")
def metric_consistency(spark, sf):
    c = table(spark, sf, "customer").select(F.lit(1).alias("k"), F.col("c_acctbal").alias("x"), (F.col("c_acctbal") * (1 + (F.col("c_custkey") % 7) / 10.0)).alias("y"))
    return rnd(edge.spearman(c, "x", "y", "k"), "ic")


# --- 2.12


def PERMUTED(seed, by=""):
    w = "(PARTITION BY symbol ORDER BY ts)"
    return f"pr AS (SELECT symbol, ts, volume, row_number() OVER {w} AS n, ln(close / lag(close) OVER {w}) AS r, open / close AS o, high / close AS h, low / close AS l, first(close) OVER {w} AS c0 FROM bars), pm AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY {sqlstats.draw(str(1 << 60), str(seed), 'n')}, n) + 1 AS n, r, o, h, l, volume FROM pr WHERE n > 1 UNION ALL SELECT symbol, n, 0, o, h, l, volume FROM pr WHERE n = 1), pc AS (SELECT pr.symbol, ts, pm.volume, o, h, l, c0 * exp(sum(pm.r) OVER (PARTITION BY pr.symbol ORDER BY pr.n)) AS close FROM (SELECT symbol, ts, n, c0 FROM pr) pr JOIN pm USING (symbol, n)), permuted AS MATERIALIZED (SELECT symbol, ts, o * close AS open, greatest(h * close, o * close, close) AS high, least(l * close, o * close, close) AS low, close, volume FROM pc)"


@query("permute_bars", f"WITH {BARS_1H}, {PERMUTED(7)} SELECT symbol, ts, round(ln(close), {R}) AS log_close, {', '.join(f'round({c} / close, {R}) AS {c}' for c in ('open', 'high', 'low'))}, volume FROM permuted")
def permute_bars(spark, sf):
    """Prices by the close, and its logarithm: the fixture's returns compound to any size."""
    p = overfit.permute_bars(bars_1h(spark, sf), 7)
    return p.select("symbol", "ts", F.round(F.ln("close"), R).alias("log_close"), *[F.round(F.col(c) / F.col("close"), R).alias(c) for c in ("open", "high", "low")], "volume")


def flat(paths, *by):
    """Terminal growth as logarithms: it compounds to any size."""
    s = overfit.summary(paths, *by)
    return s.select(*by, *[F.round(F.ln(F.col("t")[i]), R).alias(f"t{i}") for i in range(3)], *[F.round(F.col(c)[i], R).alias(f"{c}{i}") for c, n in (("d", 3), ("s", 2)) for i in range(n)], F.round("ruin", R).alias("ruin"), F.round("p_negative", R).alias("p_negative"))


#: From (by, sim, i, ret): one row a simulation, then percentiles.
def PATHS(by=""):
    return f"ph AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY {by}sim ORDER BY i)) AS e FROM draws), pd2 AS (SELECT *, 1 - e / greatest(1, max(e) OVER (PARTITION BY {by}sim ORDER BY i)) AS dd FROM ph), sims AS (SELECT {by}sim, arg_max(e, i) AS terminal, max(dd) AS max_dd, avg(ret) / stddev_samp(ret) AS sharpe FROM pd2 GROUP BY {by}sim), flat AS (SELECT {by}{', '.join(f"round({'ln' if c == 't' else ''}(quantile_cont({x}, {q})), {R}) AS {c}{i}" for x, c, qs in (('terminal', 't', (0.05, 0.5, 0.95)), ('max_dd', 'd', (0.5, 0.95, 0.99)), ('sharpe', 's', (0.025, 0.975))) for i, q in enumerate(qs))}, round(avg(CASE WHEN terminal < 0.5 THEN 1.0 ELSE 0 END), {R}) AS ruin, round(avg(CASE WHEN sharpe < 0 THEN 1.0 ELSE 0 END), {R}) AS p_negative FROM sims {'GROUP BY ' + by.rstrip(', ') if by else ''})"


def BLOCKS(seed):
    return f"{RETS}, {PORT}, num AS (SELECT row_number() OVER (ORDER BY t) - 1 AS k, ret FROM port), sz AS (SELECT count(*) AS n FROM num), grid AS (SELECT sim, b, n, {sqlstats.draw('n - 23', str(seed), 'sim', 'b')} AS start FROM sz, range(100) AS r(sim), LATERAL (SELECT unnest(range(CAST(ceil(n / 24.0) AS BIGINT))) AS b)), draws AS MATERIALIZED (SELECT sim, b * 24 + j AS i, ret FROM grid, range(24) AS q(j) JOIN num ON num.k = start + j WHERE b * 24 + j < n), {PATHS()}"


@query("trade_bootstrap", f"WITH {TRADES}, num AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY entry_bar) - 1 AS k, pnl / (entry_price + 100) AS ret FROM trades), sz AS (SELECT symbol, count(*) AS n FROM num GROUP BY 1), grid AS (SELECT symbol, sim, i, {sqlstats.draw('n', '1', 'symbol', 'sim', 'i')} AS k FROM sz, range(100) AS r(sim), LATERAL (SELECT unnest(range(n)) AS i)), draws AS MATERIALIZED (SELECT symbol, sim, i, ret FROM grid JOIN num USING (symbol, k)), {PATHS('symbol, ')} SELECT * FROM flat")
def trade_bootstrap(spark, sf):
    t = perf.signal_episodes(bars_1h(spark, sf).withColumn("signal", F.col("close") > F.col("open")))
    return flat(overfit.trade_bootstrap(t.withColumn("ret", F.col("pnl") / (F.col("entry_price") + 100)), 100), "symbol")


@query("block_bootstrap", f"WITH {BLOCKS(1)} SELECT * FROM flat")
def block_bootstrap(spark, sf):
    return flat(overfit.block_bootstrap(portfolio(spark, sf), 100, 24))


@query("bootstrap_ci", f"WITH {BLOCKS(2)} SELECT s0, s1, p_negative FROM flat")
def bootstrap_ci(spark, sf):
    return flat(overfit.block_bootstrap(portfolio(spark, sf), 100, 24, seed=2)).select("s0", "s1", "p_negative")


@query("null_ic")
def null_ic(spark, sf):
    from tidemark.operators.windows import hold_bars, lag

    out = None
    for seed in range(3):
        b = overfit.permute_bars(bars_1h(spark, sf), seed)
        b = b.withColumn("raw", F.coalesce(F.col("close") / lag("close", 6) - 1 > 0.2, F.lit(False))).withColumn("signal", hold_bars("raw", 3).cast("double"))
        ic = edge.information_coefficient(edge.forward_returns(b, [2, 4], keep=("signal",))).withColumn("seed", F.lit(seed))
        out = ic if out is None else out.unionByName(ic)
    return out.groupBy("seed").agg(F.round(F.avg((F.col("ic") > 0.1).cast("double")), R).alias("false_rate"), F.count("*").alias("n"))
