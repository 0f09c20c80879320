"""Walk-forward folds, overfitting statistics and resampling tests.

Candidates are a long table (candidate, t, ret). Random draws are hashes of
(seed, index), so results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import stats_udf as udf
from tidemark.operators.ranks import percentiles

EULER = 0.5772156649015329


def sharpe(x: Column | str = "ret") -> Column:
    return F.try_divide(F.avg(x), F.stddev_samp(x))


def splits(bars: DataFrame, n: int, is_bars: int, gap: int, oos_bars: int, anchored: bool = False) -> DataFrame:
    """Folds with in-sample, gap and out-of-sample ranges spread over all of ``bars`` (t from 0); anchored ones all start at 0.

    The number of bars is one aggregate of the table; with too few of them, or fewer than two folds, there is no fold.
    """
    size = is_bars + gap + oos_bars
    if n < 2:
        raise ValueError("too few folds")
    f = bars.agg((F.max("t") + 1).alias("n_bars")).where(F.col("n_bars") >= size).select(F.floor((F.col("n_bars") - size) / (n - 1)).alias("step"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("fold"))
    start = F.col("fold") * F.col("step")
    f = f.select("fold", (F.lit(0) if anchored else start).cast("long").alias("is_start"), (start + is_bars).alias("is_end"))
    return f.withColumn("oos_start", F.col("is_end") + gap).withColumn("oos_end", F.col("oos_start") + oos_bars)


def fold_metrics(parts: DataFrame) -> DataFrame:
    """(candidate, fold, is_metric, oos_metric, best): Sharpe inside and outside; best marks each fold's in-sample winner."""
    m = parts.groupBy("candidate", "fold").agg(sharpe(F.when(F.col("part") == "is", F.col("ret"))).alias("is_metric"), sharpe(F.when(F.col("part") == "oos", F.col("ret"))).alias("oos_metric"))
    top = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("is_metric"), "candidate"))
    return m.withColumn("best", top == 1)


def oos_curve(parts: DataFrame, capital: float) -> DataFrame:
    """Out-of-sample returns of all folds in one curve a candidate."""
    w = Window.partitionBy("candidate").orderBy("fold", "t").rowsBetween(Window.unboundedPreceding, 0)
    return parts.where("part = 'oos'").withColumn("equity", capital * F.exp(F.sum(F.log1p("ret")).over(w))).select("candidate", "fold", "t", "equity")


def degradation(metrics: DataFrame) -> DataFrame:
    """Mean in-sample to out-of-sample ratio over folds with an outside metric that isn't 0; folds with one above 0."""
    return metrics.groupBy("candidate").agg(F.avg(F.when(F.col("oos_metric") != 0, F.col("is_metric") / F.col("oos_metric"))).alias("degradation"), F.count_if(F.col("oos_metric") > 0).alias("profitable_folds"))


def blocks(rows: DataFrame, n: int, key: str = "candidate", rest: bool = True) -> DataFrame:
    """Consecutive blocks 0 to n - 1 of floor(rows / n) rows of each series; what remains goes to the last block, or goes (``rest`` false)."""
    k = F.row_number().over(Window.partitionBy(key).orderBy("t")) - 1
    size = F.floor(F.count("*").over(Window.partitionBy(key)) / n)
    rows = rows.withColumn("block", F.floor(k / size).cast("int"))
    return rows.withColumn("block", F.least("block", F.lit(n - 1))) if rest else rows.where(F.col("block") < n)


def combos(spark: SparkSession, n: int, most: int | None = None) -> DataFrame:
    """Bit masks with half of n bits (n up to 24); ``most`` of them in hash order if given."""
    if not 2 <= n <= 24:
        raise ValueError("2 to 24 blocks")
    m = spark.range(1 << n).withColumnRenamed("id", "mask").where(F.bit_count("mask") == n // 2)
    return m if most is None else m.orderBy(F.xxhash64("mask")).limit(most)  # a sample of the splits, where the caller asks for one


def _inside() -> Column:
    return F.call_function("shiftright", F.col("mask"), F.col("block")).bitwiseAND(F.lit(1)) == 1


def _or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def pbo(rows: DataFrame, n: int = 16, most: int | None = None) -> DataFrame:
    """Share of half-splits whose in-sample winner ranks in the lower half outside, and the mean logit of its rank.

    A candidate's score in a half is the mean of its blocks' Sharpes (0 where returns don't vary; a block's first
    return belongs to the step into it and is left out). The rank runs from 0 to 1, cut to 0.01 and 0.99. Needs two
    candidates. Blocks are summed once; only block scores meet the masks.
    """
    w = Window.partitionBy("candidate", "block").orderBy("t")
    inner = blocks(rows, n).withColumn("i__", F.row_number().over(w)).where("i__ > 1")
    score = inner.groupBy("candidate", "block").agg(_or_zero(F.when(F.stddev_samp("ret") > 1e-12, sharpe())).alias("s"))
    x = score.crossJoin(F.broadcast(combos(rows.sparkSession, n, most)))  # blocks of candidates by masks: at most 2.7 million masks, set by n alone
    both = x.groupBy("mask", "candidate").agg(F.avg(F.when(_inside(), F.col("s"))).alias("a"), F.avg(F.when(~_inside(), F.col("s"))).alias("b"))
    mask = Window.partitionBy("mask")
    rank = (F.row_number().over(mask.orderBy("b", "candidate")) - 1) / (F.count("*").over(mask) - 1)
    best = both.withColumn("w", rank).groupBy("mask").agg(F.min_by("w", F.struct(-F.col("a"), F.col("candidate"))).alias("w"))
    cut = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("w")))
    logit = F.ln(cut / (1 - cut))
    return best.agg(F.avg((logit <= 0).cast("double")).alias("pbo"), F.avg(logit).alias("mean_logit"), F.count("*").alias("n_splits"))


def temporal_pbo(rows: DataFrame, n: int = 8, most: int | None = None) -> DataFrame:
    """By series: share of all half-splits that are above 0 inside and not outside (a remainder beyond whole blocks goes)."""
    sums = blocks(rows, n, rest=False).groupBy("candidate", "block").agg(F.sum("ret").alias("s"))
    x = sums.crossJoin(F.broadcast(combos(rows.sparkSession, n, most)))  # n blocks of a series by masks
    e = x.groupBy("candidate", "mask").agg(F.sum(F.when(_inside(), F.col("s"))).alias("a"), F.sum(F.when(~_inside(), F.col("s"))).alias("b"))
    over = (F.col("a") > 0) & (F.col("b") <= 0)
    return e.groupBy("candidate").agg(F.avg(over.cast("double")).alias("temporal_pbo"), F.count_if(over).alias("overfit"), F.count("*").alias("n_splits"))


def expected_max(n_trials: int) -> float:
    """Mean of the largest of ``n_trials`` standard normal values."""
    from math import e
    from statistics import NormalDist

    n, ppf = float(max(n_trials, 2)), NormalDist().inv_cdf
    return (1 - EULER) * ppf(1 - 1 / n) + EULER * ppf(1 - 1 / (n * e))


def deflated_sharpe(rows: DataFrame, n_trials: int, key: str = "candidate") -> DataFrame:
    """Probability that each Sharpe beats the best of ``n_trials`` by luck, whose spread is 1 / sqrt(T); 0 for a single trial."""
    m = rows.groupBy(key).agg(_or_zero(F.when(F.stddev_samp("ret") > 1e-12, sharpe())).alias("sr"), F.skewness("ret").alias("skew"), F.kurtosis("ret").alias("kurt"), F.count("*").alias("T"))
    m = m.withColumn("expected_max", expected_max(n_trials) / F.sqrt("T"))
    inner = 1 - F.col("skew") * F.col("sr") + F.col("kurt") / 4 * F.col("sr") * F.col("sr")
    stat = (F.col("sr") - F.col("expected_max")) * F.sqrt(F.col("T") - 1) / F.sqrt(inner)
    return m.withColumn("dsr", F.when((inner < 1e-12) | F.lit(n_trials <= 1), 0.0).otherwise(udf.normal_cdf(stat)))


def deflated_sharpe_portfolio(rows: DataFrame, n_trials: int) -> DataFrame:
    """The portfolio variant: (kurtosis + 2) / 4, and the Sharpe's own deviation scales the expected maximum."""
    m = rows.agg(sharpe().alias("sr"), F.skewness("ret").alias("skew"), F.kurtosis("ret").alias("kurt"), F.count("*").alias("T"))
    var = (1 - F.col("skew") * F.col("sr") + (F.col("kurt") + 2) / 4 * F.col("sr") * F.col("sr")) / (F.col("T") - 1)
    m = m.withColumn("sd", F.sqrt(F.greatest(var, F.lit(1e-12)))).withColumn("expected_max", F.col("sd") * expected_max(n_trials))
    return m.withColumn("dsr", F.when(F.col("T") < 30, 0.0).otherwise(udf.normal_cdf((F.col("sr") - F.col("expected_max")) / F.col("sd"))))


def paired_t(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Mean excess over a benchmark (t, ret) with its t and one-sided p, by candidate."""
    x = rows.join(benchmark.withColumnRenamed("ret", "b"), "t").withColumn("x", F.col("ret") - F.col("b"))
    out = x.groupBy("candidate").agg(F.avg("x").alias("excess"), (F.avg("x") / (F.stddev_samp("x") / F.sqrt(F.count("*")))).alias("t"), F.count("*").alias("n"))
    return out.withColumn("p", udf.t_sf("t", (F.col("n") - 1).cast("double")))


#: Fewer paired returns than this give no verdict.
LEAST_PAIRS = 10
#: Steps of a uniform draw.
UNIT = 1 << 40


def stationary_blocks(m: DataFrame, reps: int, seed: int) -> DataFrame:
    """candidate, rep, start, take: blocks of a stationary bootstrap of each candidate's n rows (columns candidate, n).

    Block lengths are geometric with a mean of sqrt(n), starts are uniform, rows are taken in a circle until there are n.
    A repetition draws more blocks than it can need but for a chance beyond eight deviations, and its last one takes the rest.
    """
    stop = 1 / F.floor(F.sqrt("n"))
    m = m.select("candidate", "n", stop.alias("stop"), F.ceil(F.col("n") * stop + 8 * F.sqrt(F.col("n") * stop) + 20).alias("most"))
    rows = m.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("b", F.explode(F.sequence(F.lit(1).cast("long"), F.col("most"))))
    u = (draw(UNIT, seed, F.lit("length"), F.col("rep"), F.col("b")) + 0.5) / UNIT
    rows = rows.withColumn("length", 1 + F.floor(F.ln(u) / F.ln(1 - F.col("stop"))))
    before = F.coalesce(F.sum("length").over(Window.partitionBy("candidate", "rep").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).where("before < n")
    left = F.col("n") - F.col("before")
    take = F.when(F.col("b") == F.col("most"), left).otherwise(F.least("length", left))
    return rows.select("candidate", "rep", draw(F.col("n"), seed, F.col("rep"), F.col("b")).alias("start"), take.alias("take"), "n")


def superiority(rows: DataFrame, benchmark: DataFrame, reps: int = 1000, seed: int = 1) -> DataFrame:
    """candidate, excess over a benchmark (t, ret), n, statistic, lower, consistent, upper, p: bootstrap tests that the excess isn't above 0.

    Excess returns are drawn in stationary blocks, ``reps`` times; the statistic is the excess by the deviation of the drawn
    means. Each drawn mean is centred, and a p is the share of those that reach the excess. ``lower`` centres on the excess or 0, whichever
    is larger, ``upper`` on the excess, ``consistent`` on the excess too unless it is so far below 0 that it can't matter
    (-sqrt(2 log log n) deviations), then on 0. The largest of the three decides: ``p``. Candidates with fewer than
    ``LEAST_PAIRS`` paired returns have no row. Prefix sums make a block one difference, so a draw is a row, not a block's rows.
    """
    w = Window.partitionBy("candidate").orderBy("t")
    x = rows.join(benchmark.withColumnRenamed("ret", "b__"), "t").withColumn("x", F.col("ret") - F.col("b__"))
    x = x.select("candidate", "x", (F.row_number().over(w) - 1).cast("long").alias("k"), F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    m = x.groupBy("candidate").agg(F.count("*").alias("n"), F.avg("x").alias("excess"), F.sum("x").alias("all")).where(F.col("n") >= LEAST_PAIRS)
    blocks_ = stationary_blocks(m.select("candidate", "n"), reps, seed)
    # a block's sum: the prefix at its end less the one before its start, and the whole series where it goes round
    end, turns = F.pmod(F.col("start") + F.col("take") - 1, F.col("n")), F.floor((F.col("start") + F.col("take") - 1) / F.col("n"))
    sides = F.array(F.struct(end.alias("k"), F.lit(1).alias("sign"), turns.alias("turns")), F.struct((F.col("start") - 1).alias("k"), F.lit(-1).alias("sign"), F.lit(0).cast("long").alias("turns")))
    ends = blocks_.select("candidate", "rep", F.explode(sides).alias("e")).select("candidate", "rep", "e.*")
    met = ends.join(x.select("candidate", "k", "c"), ["candidate", "k"], "left")  # nothing comes before row 0
    sums = met.groupBy("candidate", "rep").agg(F.sum(F.col("sign") * F.coalesce("c", F.lit(0.0))).alias("s"), F.sum("turns").alias("turns"))
    means = sums.join(m, "candidate").select("candidate", "n", "excess", ((F.col("s") + F.col("turns") * F.col("all")) / F.col("n")).alias("m"))
    sd = means.groupBy("candidate").agg(F.stddev_pop("m").alias("sd"))
    z = means.join(sd, "candidate")
    near = F.col("excess") >= -F.col("sd") * F.sqrt(2 * F.ln(F.ln("n")))
    centres = {"lower": F.greatest("excess", F.lit(0.0)), "consistent": F.when(near, F.col("excess")).otherwise(0.0), "upper": F.col("excess")}
    out = z.groupBy("candidate").agg(F.first("excess").alias("excess"), F.first("n").alias("n"), F.first(F.coalesce(F.try_divide("excess", "sd"), F.lit(0.0))).alias("statistic"), *[F.avg((F.col("m") - c >= F.col("excess")).cast("double")).alias(k) for k, c in centres.items()])
    return out.withColumn("p", F.greatest(*centres))


def funnel(rows: DataFrame, benchmark: DataFrame, n_trials: int, n: int = 16, pbo_limit: float = 0.5, dsr_limit: float = 0.95, alpha: float = 0.05, reps: int = 1000) -> DataFrame:
    """Candidates that pass in turn: overfitting of all (PBO at most ``pbo_limit``; a single one passes), deflated Sharpe of 30 returns or more, superiority to the benchmark by its deciding p (none with too few returns).

    One row a candidate with passed_pbo, passed_dsr, passed_spa; each needs the one before.
    """
    d = deflated_sharpe(rows, n_trials)
    several = d.agg(F.count("*").alias("n__"))  # one row each
    both = d.crossJoin(F.broadcast(pbo(rows, n).select("pbo"))).crossJoin(F.broadcast(several)).join(superiority(rows, benchmark, reps).select("candidate", F.col("p").alias("spa_p")), "candidate", "left")
    first = (F.col("n__") < 2) | (F.col("pbo") <= pbo_limit)
    second = first & (F.col("T") >= 30) & (F.col("dsr") > dsr_limit)
    return both.select("candidate", "pbo", "dsr", "spa_p", first.alias("passed_pbo"), second.alias("passed_dsr"), (second & F.coalesce(F.col("spa_p") < alpha, F.lit(False))).alias("passed_spa"))


def temporal_cv(rows: DataFrame, n: int) -> DataFrame:
    """Sharpe by block, and whether all but one are above 0."""
    b = blocks(rows, n).groupBy("candidate", "block").agg(sharpe().alias("sharpe"))
    return b.groupBy("candidate").agg(F.count_if(F.col("sharpe") > 0).alias("positive"), F.avg("sharpe").alias("mean"), (F.count_if(F.col("sharpe") > 0) >= n - 1).alias("passed"))


def _trend(y: str, x: str, name: str = "") -> list[Column]:
    """Aggregates of a linear regression: slope, r2 and rows."""
    return [F.regr_slope(y, x).alias(f"{name}slope"), F.regr_r2(y, x).alias(f"{name}r2"), F.count(y).alias("n_points")]


def _slope_p(slope: str = "slope", r2: str = "r2", n: str = "n_points") -> Column:
    """Two-sided p of a regression's slope."""
    df = F.when(F.col(n) > 2, F.col(n) - 2).cast("double")
    t = F.sqrt(F.try_divide(F.col(r2) * df, 1 - F.col(r2)))
    return F.when(F.col(n) > 2, F.when(F.col(r2) >= 1, 0.0).otherwise(2 * udf.t_sf(t, df)))


def alpha_decay(rows: DataFrame, n: int = 8) -> DataFrame:
    """Sharpe over equal windows of 20 rows or more (fewer windows if there are too few rows), the rest in the last one: slope, r2, p, last by first, status.

    decaying and improving need a slope with p below 0.10, else stable. The ratio is 0 where the first window's Sharpe is.
    """
    key = Window.partitionBy("candidate")
    k, total = F.row_number().over(key.orderBy("t")) - 1, F.count("*").over(key)
    rows = rows.withColumns({"k__": k, "T__": total}).withColumn("w__", F.when(F.floor(F.col("T__") / n) < 20, F.greatest(F.floor(F.col("T__") / 20), F.lit(2))).otherwise(n))
    rows = rows.withColumn("block", F.least(F.floor(F.col("k__") / F.floor(F.col("T__") / F.col("w__"))), F.col("w__") - 1))
    b = rows.groupBy("candidate", "block").agg(_or_zero(F.when(F.stddev_samp("ret") > 1e-12, sharpe())).alias("s"))
    out = b.groupBy("candidate").agg(*_trend("s", "block"), F.min_by("s", "block").alias("first__"), F.max_by("s", "block").alias("last__"))
    out = out.withColumns({"p": _slope_p(), "ratio": F.when(F.abs("first__") > 1e-12, F.col("last__") / F.col("first__")).otherwise(0.0)})
    sure = F.col("p") < 0.10
    return out.withColumn("status", F.when(sure & (F.col("slope") < 0), "decaying").when(sure & (F.col("slope") > 0), "improving").otherwise("stable")).drop("first__", "last__")


def vol_regime_perf(rows: DataFrame, n: int = 60, deep: float = 0.05, least: int = 10) -> DataFrame:
    """Rows, share, mean, deviation, Sharpe and win rate by regime, whether all of ``least`` rows or more have a Sharpe above 0, and the stress ratio.

    deep_drawdown: more than ``deep`` under the peak of compounded returns; else high_vol and low_vol: the deviation of the
    n returns before (a quarter of the series at most) beyond its upper or lower quartile; else normal. A regime of fewer
    rows has 0 everywhere. The stress ratio is high_vol's Sharpe by normal's.
    """
    w = Window.partitionBy("candidate").orderBy("t")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"k__": F.row_number().over(w), "n__": F.least(F.lit(n), F.floor(F.count("*").over(Window.partitionBy("candidate")) / 4)), "e__": F.exp(F.sum(F.log1p("ret")).over(run)), "c__": F.collect_list("ret").over(w.rowsBetween(-n, -1))})
    last = F.slice("c__", F.greatest(F.size("c__") - F.col("n__").cast("int") + 1, F.lit(1)), F.col("n__").cast("int"))
    mean = F.aggregate(last, F.lit(0.0), lambda a, x: a + x) / F.col("n__")
    rows = rows.withColumn("m__", mean).withColumn("vol", F.sqrt(F.aggregate(last, F.lit(0.0), lambda a, x: a + (x - F.col("m__")) * (x - F.col("m__"))) / (F.col("n__") - 1)))
    rows = rows.withColumn("dd__", 1 - F.col("e__") / F.max("e__").over(run)).where("k__ > n__").select("candidate", "ret", "vol", "dd__")
    cut = percentiles(rows, "vol", {"low__": 0.25, "high__": 0.75}, "candidate").join(rows.groupBy("candidate").agg(F.count("*").alias("all")), "candidate")
    rows = rows.join(cut, "candidate")
    regime = F.when(F.col("dd__") > deep, "deep_drawdown").when(F.col("vol") > F.col("high__"), "high_vol").when(F.col("vol") < F.col("low__"), "low_vol").otherwise("normal")
    out = rows.groupBy("candidate", regime.alias("regime")).agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), _or_zero(F.when(F.stddev_samp("ret") > 1e-12, sharpe())).alias("sharpe"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), (F.count("*") / F.first("all")).alias("share"))
    enough = F.col("n") >= least
    out = out.withColumns({c: F.when(enough, F.col(c)).otherwise(0.0) for c in ("mean", "sd", "sharpe", "win_rate", "share")})
    key = Window.partitionBy("candidate")
    of = lambda name: _or_zero(F.max(F.when(F.col("regime") == name, F.col("sharpe"))).over(key))
    stress = F.when(F.abs(of("normal")) > 1e-12, of("high_vol") / of("normal")).otherwise(0.0)
    return out.withColumns({"all_positive": F.min(F.when(enough, F.col("sharpe") > 0).otherwise(F.lit(True))).over(key), "stress_ratio": stress})


def tail_risk(rows: DataFrame) -> DataFrame:
    """Value at risk and its tail mean at 95 and 99 %, mean of the best 5 % by that of the worst, losing streak, worst, best, large losses, skew and excess kurtosis."""
    p = percentiles(rows, "ret", {"p5__": 0.05, "p1__": 0.01, "p95__": 0.95}, "candidate")
    w = Window.partitionBy("candidate").orderBy("t")
    x = rows.withColumns({"lost__": F.col("ret") < 0, "k__": F.row_number().over(w)})
    x = x.withColumn("i__", F.col("k__") - F.row_number().over(Window.partitionBy("candidate", "lost__").orderBy("t")))
    runs = x.where("lost__").groupBy("candidate", "i__").agg(F.count("*").alias("c")).groupBy("candidate").agg(F.max("c").alias("losing_streak"))
    at = rows.join(p, "candidate")
    low, top = (F.avg(F.when(F.col("ret") <= F.col("p5__"), F.col("ret"))), F.avg(F.when(F.col("ret") >= F.col("p95__"), F.col("ret"))))
    out = at.groupBy("candidate").agg(
        F.first("p5__").alias("var95"), F.first("p1__").alias("var99"), low.alias("cvar95"), F.avg(F.when(F.col("ret") <= F.col("p1__"), F.col("ret"))).alias("cvar99"),
        F.when(F.abs(low) > 1e-12, top / F.abs(low)).otherwise(0.0).alias("tail_ratio"), F.min("ret").alias("worst"), F.max("ret").alias("best"), F.avg((F.col("ret") < -0.02).cast("double")).alias("p_loss"), F.skewness("ret").alias("skew"), F.kurtosis("ret").alias("kurt"),
    )
    return out.join(runs, "candidate", "left").withColumn("losing_streak", F.coalesce("losing_streak", F.lit(0)))


def portfolio_verdict(returns: DataFrame, n_trials: int, effective: DataFrame, n_windows: int = 8, least_effective: float = 5.0) -> DataFrame:
    """One row of flags for a portfolio's (t, ret): deflated Sharpe, decay, regimes, tails, ``effective`` (one row, effective_n), and whether all pass."""
    one = returns.withColumn("candidate", F.lit("portfolio"))
    rows = deflated_sharpe_portfolio(returns, n_trials).select("dsr", (F.col("dsr") > 0.95).alias("dsr_significant"))
    for part in (
        alpha_decay(one, n_windows).select(F.col("status").alias("decay_status")),
        vol_regime_perf(one).select("all_positive", "stress_ratio").distinct(),
        tail_risk(one).select("cvar99", "tail_ratio"),
        effective.select("effective_n"),
    ):
        rows = rows.crossJoin(part)  # one row each
    return rows.withColumn("passed", F.col("dsr_significant") & (F.col("decay_status") != "decaying") & (F.col("effective_n") >= least_effective) & F.col("all_positive"))


def rolling_windows(spark: SparkSession, start: str, end: str, months: int, step: int, oos_from: str) -> DataFrame:
    """Windows of ``months`` sliding by ``step`` that end by ``end``; ``oos`` by their midpoint."""
    s = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr(f"INTERVAL {step} MONTHS"))).alias("start"))
    s = s.withColumn("end", F.add_months("start", months)).where(F.col("end") <= F.to_date(F.lit(end)))
    mid = F.date_add("start", (F.datediff("end", "start") / 2).cast("int"))
    return s.withColumn("oos", mid >= F.to_date(F.lit(oos_from)))


def rolling_summary(windows: DataFrame, strategies: DataFrame | None = None) -> DataFrame:
    """By method over (method, window, regime, sharpe, total_return, max_dd): share above 0 with its binomial p, drawdown, slope with p and status, regimes above 0, mean long and short return, best, passed.

    max_dd is in percent. ``strategies`` has (direction, total_return) of strategies in windows. A method passes with 75 % of windows above 0,
    binomial p below 0.05, no decay (slope under -0.01 with p below 0.10; three windows at least), drawdown under 40 % and four
    regimes whose mean Sharpe is above 0. best marks the method with the largest share (the first by name of several).
    """
    by_regime = windows.groupBy("method", "regime").agg(F.avg("sharpe").alias("s")).groupBy("method").agg(F.count_if(F.col("s") > 0).alias("regimes_positive"), F.count("*").alias("regimes"))
    out = windows.groupBy("method").agg(F.count("*").alias("n"), F.count_if(F.col("sharpe") > 0).alias("k"), F.avg("sharpe").alias("mean_sharpe"), F.max("max_dd").alias("max_dd"), *_trend("sharpe", "window")).join(by_regime, "method")
    out = out.withColumns({"p": udf.binom_sf(F.col("k").cast("double"), F.col("n").cast("double"), F.lit(0.5)), "slope_p": _slope_p()})
    sure = F.col("slope_p") < 0.10
    out = out.withColumn("status", F.when(F.col("n") < 3, "insufficient").when(sure & (F.col("slope") < -0.01), "decaying").when(sure & (F.col("slope") > 0.01), "improving").otherwise("stable"))
    share = F.col("k") / F.col("n")
    best = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(share), "method")) == 1  # one row a method
    passed = (share >= 0.75) & (F.col("p") < 0.05) & (F.col("status") != "decaying") & (F.col("max_dd") < 40) & (F.col("regimes_positive") >= 4)
    out = out.withColumns({"best": best, "passed": passed}).drop("n_points")
    if strategies is None:
        return out
    short = F.col("direction") == "short"
    sides = strategies.agg(*[F.coalesce(F.avg(F.when(c, F.col("total_return"))), F.lit(0.0)).alias(n) for n, c in (("long", ~short), ("short", short))])
    return out.crossJoin(sides)  # one row


def null_hit_rate(runs: DataFrame, real_hits: int, real_total: int) -> DataFrame:
    """Pass rate of null runs by seed and over all, and the p that ``real_hits`` of ``real_total`` pass at the null's rate (0 if no null run passes)."""
    by = runs.groupBy("seed").agg(F.avg(F.col("passed").cast("double")).alias("rate"), F.count("*").alias("n"), F.count_if("passed").alias("k"))
    whole = by.agg((F.sum("k") / F.sum("n")).alias("null_rate"))
    whole = whole.withColumn("p", F.when(F.col("null_rate") > 0, udf.binom_sf(F.lit(float(real_hits)), F.lit(float(real_total)), F.col("null_rate"))).otherwise(0.0))
    return by.crossJoin(F.broadcast(whole)).withColumn("valid", F.col("null_rate") < 0.05)  # one row


# --- resampling


def draw(n: Column | int, *parts) -> Column:
    """A number from 0 to n - 1 from an MD5 of its parts, the same in any engine."""
    text = F.concat_ws("-", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n))


def permute_bars(bars: DataFrame, seed: int) -> DataFrame:
    """Shuffle each symbol's log returns and intra-bar ratios together and rebuild prices from bar 0 on."""
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = bars.withColumns({"n": F.row_number().over(w), "r": F.ln(F.col("close") / F.lag("close").over(w)), "o": F.col("open") / F.col("close"), "h": F.col("high") / F.col("close"), "l": F.col("low") / F.col("close")})
    moved = rows.where("n > 1").withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(draw(1 << 60, seed, F.col("n")), "n")) + 1)
    moved = moved.select("symbol", F.col("k").alias("n"), "r", "o", "h", "l", "volume")
    here = rows.select("symbol", "n", "ts", F.first("close").over(w).alias("c0"))
    first = rows.where("n = 1").select("symbol", "n", F.lit(0.0).alias("r"), "o", "h", "l", "volume")
    x = here.join(moved.unionByName(first), ["symbol", "n"])
    x = x.withColumn("close", F.col("c0") * F.exp(F.sum("r").over(Window.partitionBy("symbol").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))))
    x = x.withColumn("open", F.col("o") * F.col("close"))
    return x.select("symbol", "ts", "open", F.greatest(F.col("h") * F.col("close"), "open", "close").alias("high"), F.least(F.col("l") * F.col("close"), "open", "close").alias("low"), "close", "volume")


def _paths(rows: DataFrame, *by: str) -> DataFrame:
    """Per sim, and ``by``: terminal growth and largest drawdown of returns in order of i."""
    w = Window.partitionBy(*by, "sim").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("e", F.exp(F.sum(F.log1p("ret")).over(w)))
    rows = rows.withColumn("dd", 1 - F.col("e") / F.greatest(F.lit(1.0), F.max("e").over(w)))
    return rows.groupBy(*by, "sim").agg(F.max_by("e", "i").alias("terminal"), F.max("dd").alias("max_dd"), sharpe().alias("sharpe"))


def trade_bootstrap(trades: DataFrame, sims: int, seed: int = 1) -> DataFrame:
    """Each symbol's trades drawn with replacement: one row a symbol and simulation. ``trades`` has ret and entry order."""
    numbered = trades.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("entry_bar")) - 1).select("symbol", "k", "ret")
    n = trades.groupBy("symbol").agg(F.count("*").alias("n"))
    grid = n.crossJoin(F.broadcast(trades.sparkSession.range(sims).withColumnRenamed("id", "sim")))  # a row a simulation
    grid = grid.select("symbol", "n", "sim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    return _paths(grid.withColumn("k", draw(F.col("n"), seed, F.col("symbol"), F.col("sim"), F.col("i"))).join(numbered, ["symbol", "k"]), "symbol")


def block_bootstrap(returns: DataFrame, sims: int, size: int, seed: int = 1) -> DataFrame:
    """Contiguous blocks of one portfolio's (t, ret) drawn with replacement; weights come first, so strategies move together."""
    numbered = returns.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("t")) - 1).select("k", "ret").cache()
    n = numbered.count()
    per = -(-n // size)
    grid = returns.sparkSession.range(sims * per).select(F.expr(f"id div {per}").alias("sim"), (F.col("id") % per).alias("b"))
    grid = grid.withColumn("start", draw(max(1, n - size + 1), seed, F.col("sim"), F.col("b"))).select("sim", "b", "start", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("j"))
    rows = grid.select("sim", (F.col("b") * size + F.col("j")).alias("i"), (F.col("start") + F.col("j")).alias("k")).where(F.col("i") < n)
    return _paths(rows.join(numbered, "k"))


def summary(paths: DataFrame, *by: str) -> DataFrame:
    """Percentiles of terminal growth (5, 50, 95), drawdown (50, 95, 99) and Sharpe (2.5, 97.5); shares of sims that end under half (ruin) or with a Sharpe below 0."""
    return paths.groupBy(*by).agg(F.percentile("terminal", [0.05, 0.5, 0.95]).alias("t"), F.percentile("max_dd", [0.5, 0.95, 0.99]).alias("d"), F.avg((F.col("terminal") < 0.5).cast("double")).alias("ruin"), F.percentile("sharpe", [0.025, 0.975]).alias("s"), F.avg((F.col("sharpe") < 0).cast("double")).alias("p_negative"))
