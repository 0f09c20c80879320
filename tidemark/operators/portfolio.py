"""Correlation, covariance, selection and ensembles of strategies.

Returns are a long table (strategy_id, t, ret); matrices are pair tables (a, b, ...)
with a < b, made by products of blocks, so their size is pairs of strategies, not bars.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.overfit import draw
from tidemark.operators.ranks import average_ranks


def S():
    return Window.partitionBy("strategy_id").orderBy("t")


#: Strategies of a block, rows of a block in one stretch of time, and times multiplied at once.
STRATEGIES, ROWS, TIMES = 128, 250_000, 2_048
_SUMS = ("n", "x", "y", "xx", "yy", "xy", "bad")


def pair_sums(rows: DataFrame, value: str = "ret") -> DataFrame:
    """(a, b, n, x, y, xx, yy, xy, bad) for all pairs a < b that share a time: sums over shared times, as of a join on t.

    Strategies are dealt over blocks and times over stretches by hashes; a pair of blocks is one matrix product in each
    stretch, and the products are added up. So a row is copied once a block, not once a strategy, and a task holds two
    blocks of one stretch. ``n`` counts shared times where both have a value, ``bad`` those where one is NaN or infinite, which
    count as 0 in the sums. A strategy's repeated rows of a time count each, as in the join; null keys meet nothing.
    """
    have = rows.where("strategy_id is not null and t is not null")
    size = have.agg(F.count_distinct("strategy_id").alias("k"), F.count("*").alias("n")).first()
    blocks = max(1, -(-size.k // STRATEGIES))
    stretches = max(1, -(-size.n // (blocks * ROWS)))
    dealt = have.select(F.col("strategy_id").alias("id"), "t", F.col(value).cast("double").alias("v"), F.pmod(F.xxhash64("strategy_id"), F.lit(blocks)).alias("block"), F.pmod(F.xxhash64("t"), F.lit(stretches)).alias("stretch"))
    other = F.col("other")
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"one": F.least("block", other), "two": F.greatest("block", other)})
    kind = rows.schema["strategy_id"].dataType.simpleString()

    def side(frame, times):
        """Ids and, for each of the shared times and ids, counts of rows and of values, their sums and squares, and what isn't finite."""
        ids, at = np.unique(frame["id"].to_numpy(), return_inverse=True)
        v, there = frame["v"].to_numpy(float), ~frame["null"].to_numpy(bool)
        finite = there & np.isfinite(v)
        clean = np.where(finite, v, 0.0)
        place = np.searchsorted(times, frame["t"].to_numpy()) * len(ids) + at
        made = [np.ones(len(v)), there.astype(float), clean, clean * clean, (there & ~finite).astype(float)]
        return ids, [np.bincount(place, w, len(times) * len(ids)).reshape(len(times), len(ids)) for w in made]

    def multiply(frame):
        first, second = frame["one"].iloc[0], frame["two"].iloc[0]
        left = frame[frame["block"] == first]
        right = left if first == second else frame[frame["block"] == second]
        times = np.intersect1d(left["t"].to_numpy(), right["t"].to_numpy())
        parts = []
        for i in range(0, len(times), TIMES):
            few = times[i : i + TIMES]
            ids_a, (pa, ma, xa, qa, ba) = side(left[left["t"].isin(few)], few)
            ids_b, (pb, mb, xb, qb, bb) = side(right[right["t"].isin(few)], few)
            sums = [ma.T @ mb, xa.T @ mb, ma.T @ xb, qa.T @ mb, ma.T @ qb, xa.T @ xb, ba.T @ mb + ma.T @ bb]
            shared, ordered = pa.T @ pb > 0, ids_a[:, None] < ids_b[None, :]
            for keep, swap in ((shared & ordered, False), (shared & (ids_b[None, :] < ids_a[:, None]) & (first != second), True)):
                a, b = np.nonzero(keep)
                ids = (ids_b[b], ids_a[a]) if swap else (ids_a[a], ids_b[b])
                order = (0, 2, 1, 4, 3, 5, 6) if swap else range(7)
                parts.append(pd.DataFrame({"a": ids[0], "b": ids[1]} | {n: sums[k][a, b] for n, k in zip(_SUMS, order, strict=True)}))
        return pd.concat(parts).groupby(["a", "b"], as_index=False).sum() if parts else pd.DataFrame(columns=["a", "b", *_SUMS])

    # the null flag travels apart, as pandas writes null and NaN alike
    sent = met.select("one", "two", "stretch", "block", "id", "t", "v", F.col("v").isNull().alias("null"))
    products = sent.groupBy("one", "two", "stretch").applyInPandas(multiply, f"a {kind}, b {kind}, " + ", ".join(f"{n} double" for n in _SUMS))
    return products.groupBy("a", "b").agg(*[F.sum(n).alias(n) for n in _SUMS])


def pair_moments(rows: DataFrame, value: str = "ret") -> DataFrame:
    """(a, b, n, vx, vy, cov): sums of squared and mixed deviations of pairs over shared times; null where a value isn't finite.

    Values are taken from each strategy's mean first, so large levels don't cost digits; a deviation under 1e-12 of what
    is summed is rounding and counts as 0.
    """
    finite = F.when(~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value)) < float("inf")), F.col(value))
    mean = rows.groupBy("strategy_id").agg(F.avg(finite).alias("mean__"))
    s = pair_sums(rows.join(mean, "strategy_id").withColumn(value, F.col(value) - F.coalesce("mean__", F.lit(0.0))), value)
    apart = lambda q, x, y: F.when(F.col("bad") == 0, F.col(q) - F.try_divide(F.col(x) * F.col(y), "n"))
    spread = lambda q, x: F.when(apart(q, x, x) > F.col(q) * 1e-12, apart(q, x, x)).otherwise(F.when(F.col("bad") == 0, F.lit(0.0)))
    return s.select("a", "b", "n", spread("xx", "x").alias("vx"), spread("yy", "y").alias("vy"), apart("xy", "x", "y").alias("cov"))


def correlations(rows: DataFrame, value: str = "ret") -> DataFrame:
    """(a, b, rho): Pearson correlation on shared times, 0 where undefined."""
    rho = F.coalesce(F.try_divide(F.col("cov"), F.sqrt("vx") * F.sqrt("vy")), F.lit(0.0))
    return pair_moments(rows, value).select("a", "b", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho)).alias("rho"))


def shared_only(rows: DataFrame) -> DataFrame:
    """Rows at times that all strategies have."""
    n = rows.select("strategy_id").distinct().agg(F.count("*").alias("all__"))  # one row
    full = rows.groupBy("t").agg(F.count("*").alias("c__")).join(F.broadcast(n), F.col("c__") == F.col("all__")).select("t")
    return rows.join(full, "t")


def spearman_correlations(rows: DataFrame) -> DataFrame:
    return correlations(average_ranks(rows, "rank", "ret", "strategy_id"), "rank")


def drawdown_correlations(curves: DataFrame) -> DataFrame:
    peak = F.max("equity").over(S().rowsBetween(Window.unboundedPreceding, 0))
    return correlations(curves.withColumn("dd", (peak - F.col("equity")) / peak), "dd")


def clusters(pairs: DataFrame, names: DataFrame, least: float = 0.7) -> DataFrame:
    """(strategy_id, cluster): connected components at abs(rho) >= least, cluster named by its first member.

    Each round hooks every cluster to its first neighbour and follows the hooks twice, so rounds
    grow with the logarithm of the longest chain; they end when no link leads out of a cluster.
    The tables have one row a strategy or link.
    """
    edges = pairs.where((F.abs("rho") >= least) & (F.col("a") != F.col("b"))).select("a", "b").distinct().checkpoint()
    label = names.select("strategy_id", F.col("strategy_id").alias("cluster"))

    def renamed(rows, hook, column):
        new = hook.select(F.col("c").alias(column), F.col("p").alias("new__"))
        return rows.join(new, column, "left").withColumn(column, F.coalesce("new__", column)).drop("new__")

    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")).select("c", F.least("c", "m").alias("p"))
        hook = renamed(renamed(hook, hook, "p"), hook, "p").select("c", "p").checkpoint()
        label = renamed(label, hook, "cluster").checkpoint()
        edges = renamed(renamed(edges, hook, "a"), hook, "b").where("a <> b").select("a", "b").distinct().checkpoint()
    return label.select("strategy_id", "cluster")


def effective_n(pairs: DataFrame, n: int) -> DataFrame:
    """N / (1 + (N - 1) mean abs rho), and by eigenvalues: N^2 / sum of squared entries."""
    m, q = F.avg(F.abs("rho")), F.sum(F.col("rho") * F.col("rho"))
    return pairs.agg(m.alias("mean_abs_rho"), (n / (1 + (n - 1) * m)).alias("effective_n"), (n * n / (n + 2 * q)).alias("effective_n_eigen"))


def covariances(rows: DataFrame) -> DataFrame:
    """(a, b, cov) of all ordered pairs, a = b too."""
    p = pair_moments(rows).select("a", "b", F.when(F.col("n") > 1, F.col("cov") / (F.col("n") - 1)).alias("cov"))
    own = rows.groupBy(F.col("strategy_id").alias("a")).agg(F.var_samp("ret").alias("cov")).select("a", F.col("a").alias("b"), "cov")
    return p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "cov")).unionByName(own)


def portfolio_returns(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(t, ret): weights times returns; weights are one row a strategy."""
    return rows.join(weights, "strategy_id").groupBy("t").agg(F.sum(F.col("ret") * F.col("weight")).alias("ret"))


def equal_weights(names: DataFrame) -> DataFrame:
    return names.select("strategy_id", (1 / F.count("*").over(Window.partitionBy(F.lit(1)))).alias("weight"))


def regime_weights(names: DataFrame, long_bias: float) -> DataFrame:
    """Weights biased to long or short strategies, summing to 1; needs direction."""
    w = F.when(F.col("direction") == "long", long_bias).otherwise(1 - long_bias)
    return names.select("strategy_id", (w / F.sum(w).over(Window.partitionBy(F.lit(1)))).alias("weight"))


def diversification(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted volatilities by the portfolio's volatility."""
    own = rows.groupBy("strategy_id").agg(F.stddev_samp("ret").alias("s")).join(weights, "strategy_id").agg(F.sum(F.col("s") * F.col("weight")).alias("sum_vol"))
    port = portfolio_returns(rows, weights).agg(F.stddev_samp("ret").alias("vol"))
    return own.crossJoin(port).withColumn("ratio", F.try_divide("sum_vol", "vol"))  # one row by one row


def portfolio_stats(rows: DataFrame, weights: DataFrame) -> DataFrame:
    return portfolio_returns(rows, weights).agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("vol"), F.try_divide(F.avg("ret"), F.stddev_samp("ret")).alias("sharpe"))


def select_greedy(stats: DataFrame, cov: DataFrame, rho: DataFrame, n: int, per_group: int, per_market: int, max_rho: float) -> DataFrame:
    """Seed by Sharpe, then add the strategy of best diversification ratio (equal weights) under caps.

    ``stats`` has strategy_id, sharpe, vol, archetype, market (asset and timeframe). At most ``per_group`` of an archetype and
    ``per_market`` of a market are taken, and the mean abs(rho) over all pairs taken stays within ``max_rho``. The pair tables are kept;
    each of at most ``n`` steps is one small aggregation over them.
    """
    spark = stats.sparkSession
    first = stats.orderBy(F.desc("sharpe"), "strategy_id").limit(1).collect()
    chosen = [(r["strategy_id"], 0, None) for r in first]
    cov, both = cov.cache(), rho.unionByName(rho.select(F.col("b").alias("a"), F.col("a").alias("b"), "rho")).cache()
    inner = 0.0  # abs(rho) over the pairs taken
    while chosen and len(chosen) < n:
        have = spark.createDataFrame([(c[0],) for c in chosen], "chosen string")
        k = len(chosen) + 1
        taken = stats.join(have, stats.strategy_id == have.chosen)
        inside = cov.join(have, cov.a == have.chosen).drop("chosen").join(have, F.col("b") == F.col("chosen")).agg(F.sum("cov").alias("v")).first()["v"]
        vols = taken.agg(F.sum("vol").alias("s")).first()["s"]
        rest = stats.join(have, stats.strategy_id == have.chosen, "left_anti")
        for column, cap in (("archetype", per_group), ("market", per_market)):
            rest = rest.join(taken.groupBy(column).count().where(F.col("count") >= cap).select(column), column, "left_anti")
        add = cov.join(have, cov.b == have.chosen).groupBy("a").agg(F.sum("cov").alias("c"))
        near = both.join(have, both.b == have.chosen).groupBy("a").agg(F.sum(F.abs("rho")).alias("near"))
        rest = rest.join(add, F.col("strategy_id") == add.a).drop("a").join(near, F.col("strategy_id") == near.a)
        ratio = (F.lit(vols) + F.col("vol")) / k / F.sqrt((F.lit(inside) + 2 * F.col("c") + F.col("vol") * F.col("vol")) / (k * k))
        mean = (F.lit(inner) + F.col("near")) / (k * (k - 1) / 2)
        best = rest.where(mean <= max_rho).select("strategy_id", ratio.alias("r"), "near").orderBy(F.desc("r"), "strategy_id").limit(1).collect()
        if not best:
            break
        chosen.append((best[0]["strategy_id"], k - 1, best[0]["r"]))
        inner += best[0]["near"]
    return spark.createDataFrame(chosen, "strategy_id string, step int, ratio double")


def dedup_correlated(stats: DataFrame, rho: DataFrame, limit: float = 0.9) -> DataFrame:
    """Strategies left when, from the best Sharpe down, each drops its worse peers above the limit."""
    both = rho.unionByName(rho.select(F.col("b").alias("a"), F.col("a").alias("b"), "rho")).where(F.abs("rho") > limit)
    order = F.struct(F.col("sharpe"), F.col("strategy_id"))
    s = stats.select("strategy_id", order.alias("o"))
    worse = both.join(s.select(F.col("strategy_id").alias("a"), F.col("o").alias("oa")), "a").join(s.select(F.col("strategy_id").alias("b"), F.col("o").alias("ob")), "b").where("oa < ob").select(F.col("a").alias("worse"), F.col("b").alias("better")).cache()
    kept = stats.sparkSession.createDataFrame([], "strategy_id string")
    left = stats.select("strategy_id")
    while True:  # each round settles those with no better peer left
        top = left.join(worse.join(left.select(F.col("strategy_id").alias("better")), "better"), F.col("strategy_id") == F.col("worse"), "left_anti").checkpoint()
        if not top.limit(1).count():
            return stats.join(kept, "strategy_id", "left_semi")
        kept = kept.union(top)
        gone = top.union(worse.join(top.select(F.col("strategy_id").alias("better")), "better").select("worse"))
        left = left.join(gone.select("strategy_id"), "strategy_id", "left_anti").checkpoint()


def borrow_haircut(rows: DataFrame, fee: float) -> DataFrame:
    """Sharpe a period before and after a fee on short returns; needs direction."""
    net = F.when(F.col("direction") == "short", F.col("ret") - fee).otherwise(F.col("ret"))
    out = rows.withColumn("net", net).groupBy("strategy_id").agg(F.try_divide(F.avg("ret"), F.stddev_samp("ret")).alias("before"), F.try_divide(F.avg("net"), F.stddev_samp("net")).alias("after"))
    return out.withColumn("change", F.col("after") - F.col("before"))


def shrinkage_intensity(rows: DataFrame) -> DataFrame:
    """alpha = sum over t of |x x' - S|^2 / (T^2 |S - mu I|^2), cut to 0 to 1; from sums alone. Returns must share times."""
    mean = F.avg("ret").over(Window.partitionBy("strategy_id"))
    x = rows.withColumn("x", F.col("ret") - mean).select("strategy_id", "t", "x")
    cov = covariances(rows)
    norms = x.groupBy("t").agg(F.sum(F.col("x") * F.col("x")).alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("q4"), F.count("*").alias("T"))
    left, right = x.select(F.col("strategy_id").alias("a"), "t", F.col("x").alias("xa")), x.select(F.col("strategy_id").alias("b"), "t", F.col("x").alias("xb"))
    cross = left.join(right, "t").groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("p")).join(cov, ["a", "b"]).agg(F.sum(F.col("p") * F.col("cov")).alias("xsx"))
    size = cov.agg(F.sum(F.col("cov") * F.col("cov")).alias("s2"), F.sum(F.when(F.col("a") == F.col("b"), F.col("cov")).otherwise(0.0)).alias("tr"), F.count_if(F.col("a") == F.col("b")).alias("k"))
    one = norms.crossJoin(cross).crossJoin(size)  # one row each
    top = F.col("q4") - 2 * F.col("xsx") + F.col("T") * F.col("s2")
    below = F.col("T") * F.col("T") * (F.col("s2") - F.col("tr") * F.col("tr") / F.col("k"))
    return one.select(F.when(below < 1e-16, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), top / below))).alias("alpha"))


def ensemble_static(rows: DataFrame, weights: DataFrame, capital: float) -> DataFrame:
    """(t, ret, equity) of fixed weights."""
    p = portfolio_returns(rows, weights)
    run = Window.partitionBy(F.lit(1)).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)  # one portfolio
    return p.withColumn("equity", capital * F.exp(F.sum(F.log1p("ret")).over(run)))


def ensemble_contributions(rows: DataFrame, weights: DataFrame, capital: float) -> DataFrame:
    """(strategy_id, t, contribution): each strategy's share of the capital, grown by its own returns."""
    run = S().rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(weights, "strategy_id").select("strategy_id", "t", (capital * F.col("weight") * F.exp(F.sum(F.log1p("ret")).over(run))).alias("contribution"))


def rebalance_bars(every: int | str, bars_per_day: int = 24) -> int:
    """Bars of an interval: a number of them, or daily, weekly (7 days), monthly (30 days)."""
    return every if isinstance(every, int) else bars_per_day * {"daily": 1, "weekly": 7, "monthly": 30}[every]


def ensemble_weights(rows: DataFrame, weights: DataFrame, capital: float, every: int | str, bars_per_day: int = 24) -> DataFrame:
    """Weights drift inside a period of ``every`` bars and are set back at its end: (strategy_id, t, equity of all, weight). Returns must share times.

    The weight at a period's last bar is the one it is set back to.
    """
    size = rebalance_bars(every, bars_per_day)
    n = F.row_number().over(S()) - 1
    rows = rows.withColumns({"n": n, "period": F.floor(n / size)})
    g = F.exp(F.sum(F.log1p("ret")).over(Window.partitionBy("strategy_id", "period").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    each = rows.withColumn("g", g).join(weights, "strategy_id").withColumn("g", F.col("g") * F.col("weight"))
    grown = each.groupBy("period", "t").agg(F.sum("g").alias("all"))
    ends = grown.groupBy("period").agg(F.max_by("all", "t").alias("e"))
    before = Window.partitionBy(F.lit(1)).orderBy("period").rowsBetween(Window.unboundedPreceding, -1)  # one row a period
    ends = ends.select("period", F.exp(F.coalesce(F.sum(F.ln("e")).over(before), F.lit(0.0))).alias("base"))
    out = each.select("strategy_id", "period", "t", "n", "g", "weight").join(grown.join(ends, "period"), ["period", "t"])
    last = F.pmod(F.col("n") + 1, F.lit(size)) == 0
    return out.select("strategy_id", "t", (capital * F.col("base") * F.col("all")).alias("equity"), F.when(last, F.col("weight")).otherwise(F.col("g") / F.col("all")).alias("weight"))


def ensemble_rebalanced(rows: DataFrame, weights: DataFrame, capital: float, every: int | str, bars_per_day: int = 24) -> DataFrame:
    """(t, equity) of ``ensemble_weights``."""
    return ensemble_weights(rows, weights, capital, every, bars_per_day).groupBy("t").agg(F.first("equity").alias("equity"))


def weight_perturbation(rows: DataFrame, weights: DataFrame, trials: int, size: float = 0.1, seed: int = 1) -> DataFrame:
    """Sharpe over trials of weights changed by up to ``size``: mean, deviation, least, most, coefficient of variation.

    Noise is a hash of (seed, trial, strategy). Each trial's Sharpe comes from the mean vector and the covariance table.
    """
    u = draw(1_000_003, seed, F.col("trial"), F.col("strategy_id")) / 1_000_003.0
    t = rows.sparkSession.range(trials).withColumnRenamed("id", "trial").crossJoin(weights)  # trials by strategies: the size of the answer's noise
    t = t.withColumn("w", F.col("weight") * (1 + size * (2 * u - 1)))
    t = t.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("trial"))).select("trial", "strategy_id", "w")
    mean = rows.groupBy("strategy_id").agg(F.avg("ret").alias("m"))
    top = t.join(mean, "strategy_id").groupBy("trial").agg(F.sum(F.col("w") * F.col("m")).alias("m"))
    c = covariances(rows)
    var = t.select("trial", F.col("strategy_id").alias("a"), F.col("w").alias("wa")).join(c, "a").join(t.select("trial", F.col("strategy_id").alias("b"), F.col("w").alias("wb")), ["trial", "b"]).groupBy("trial").agg(F.sum(F.col("wa") * F.col("wb") * F.col("cov")).alias("v"))
    s = top.join(var, "trial").withColumn("sharpe", F.col("m") / F.sqrt("v"))
    return s.agg(F.avg("sharpe").alias("mean"), F.stddev_samp("sharpe").alias("sd"), F.min("sharpe").alias("least"), F.max("sharpe").alias("most"), F.try_divide(F.stddev_samp("sharpe"), F.abs(F.avg("sharpe"))).alias("cv"))
