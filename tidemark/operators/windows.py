"""Window primitives over (symbol, ts): rolling values, recurrences as blocked scans, pivots, states.

Column functions share one window specification, so several of them in one
projection share one sort. ``rolling`` values are null until the window is full.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType


def W():
    return Window.partitionBy("symbol").orderBy("ts")


def ALL():
    return W().rowsBetween(Window.unboundedPreceding, 0)


def last_n(n: int):
    return W().rowsBetween(-(n - 1), 0)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lag(c: Column | str, n: int = 1) -> Column:
    return F.lag(c, n).over(W())


def full(value: Column, c: Column | str, n: int) -> Column:
    return F.when(F.count(c).over(last_n(n)) == n, value)


def sma(c: Column | str, n: int) -> Column:
    return full(F.avg(c).over(last_n(n)), c, n)


def rolling_min(c: Column | str, n: int) -> Column:
    return full(F.min(c).over(last_n(n)), c, n)


def rolling_max(c: Column | str, n: int) -> Column:
    return full(F.max(c).over(last_n(n)), c, n)


def rolling_std(c: Column | str, n: int, ddof: int = 1) -> Column:
    return full((F.stddev_samp if ddof else F.stddev_pop)(c).over(last_n(n)), c, n)


def rolling_var(c: Column | str, n: int) -> Column:
    return full(F.var_samp(c).over(last_n(n)), c, n)


def wma(c: Column | str, n: int) -> Column:
    """Weights 1 to n, the latest heaviest; fewer rows at the start take the last weights."""
    terms = [(F.lag(c, k).over(W()), n - k) for k in range(n)]
    top = sum((F.coalesce(x, F.lit(0.0)) * w for x, w in terms), F.lit(0.0))
    return top / sum((F.when(x.isNotNull(), w).otherwise(0) for x, w in terms), F.lit(0))


def hold_bars(signal: Column | str, n: int) -> Column:
    """True for n bars from each True on."""
    return F.max(F.coalesce(col(signal), F.lit(False))).over(last_n(n))


def crossover(a: Column, b: Column) -> Column:
    return F.coalesce((a > b) & (lag(a) <= lag(b)), F.lit(False))


def crossunder(a: Column, b: Column) -> Column:
    return F.coalesce((a < b) & (lag(a) >= lag(b)), F.lit(False))


def true_range() -> Column:
    c = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.coalesce(F.abs(F.col("high") - c), F.lit(0.0)), F.coalesce(F.abs(F.col("low") - c), F.lit(0.0)))


def cumulative_vwap() -> Column:
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    return F.sum(tp * F.col("volume")).over(ALL()) / F.sum("volume").over(ALL())


def obv_step() -> Column:
    """Volume signed by the direction of the close; its running sum is on-balance volume."""
    d = F.col("close") - lag("close")
    return F.when(d > 0, F.col("volume")).when(d < 0, -F.col("volume")).otherwise(0.0)


def pivot_high(c: str, left: int, right: int) -> Column:
    """Strictly above the bars on both sides; false where a side is short."""
    before, after = W().rowsBetween(-left, -1), W().rowsBetween(1, right)
    whole = (F.count(c).over(before) == left) & (F.count(c).over(after) == right)
    return F.coalesce(whole & (F.col(c) > F.max(c).over(before)) & (F.col(c) > F.max(c).over(after)), F.lit(False))


def pivot_low(c: str, left: int, right: int) -> Column:
    before, after = W().rowsBetween(-left, -1), W().rowsBetween(1, right)
    whole = (F.count(c).over(before) == left) & (F.count(c).over(after) == right)
    return F.coalesce(whole & (F.col(c) < F.min(c).over(before)) & (F.col(c) < F.min(c).over(after)), F.lit(False))


def last_state(c: Column) -> Column:
    """The last value that isn't null."""
    return F.last(c, ignorenulls=True).over(ALL())


def zscore_prior(c: str, n: int) -> Column:
    """Value against the n values before it; null while they are too few or don't vary."""
    w = W().rowsBetween(-n, -1)
    sd = F.stddev_samp(c).over(w)
    return F.when((F.count(c).over(w) == n) & (sd > 1e-12), (F.col(c) - F.avg(c).over(w)) / sd)


def zscore(c: str, n: int) -> Column:
    sd = F.stddev_samp(c).over(last_n(n))
    return full(F.when(sd > 1e-12, (F.col(c) - F.avg(c).over(last_n(n))) / sd), c, n)


#: Rows of a block of a sliding rank at least; a block also gets the rows before it that its windows need.
RANK_ROWS = 4096


def pct_rank(rows: DataFrame, out: str, value: str, n: int, strict: bool = False) -> DataFrame:
    """Add ``out``: the share of the last n values at or below (``strict``: below) the current one; null while they are fewer.

    Each block of a symbol runs apart: its window is a sorted list that a value enters and another leaves, found by
    bisection, so a row costs the logarithm of n and a move of at most n numbers. Rows need symbol and ts.
    """
    size = max(RANK_ROWS, 4 * n)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("k__")
        x, own = t[value].to_pylist(), t["own__"].to_numpy()
        window: list[float] = []
        missing, got = 0, []
        for i, v in enumerate(x):
            if i >= n:
                old = x[i - n]
                if old is None:
                    missing -= 1
                else:
                    del window[bisect_left(window, old)]
            if v is None:
                missing += 1
            else:
                insort(window, v)
            under = None if v is None or missing or i < n - 1 else (bisect_left if strict else bisect_right)(window, v)
            got.append(None if under is None else under / n)
        return t.select(names).append_column(out, pa.array(got, pa.float64())).filter(pa.array(own)).cast(kinds)

    names = rows.columns
    block = F.floor(F.col("k__") / size)
    rows = rows.withColumn("k__", F.row_number().over(W()) - 1)
    # the last rows of a block are also the start of the next one's first windows
    both = F.when(F.pmod("k__", F.lit(size)) > size - n, F.array(block, block + 1)).otherwise(F.array(block))
    rows = rows.withColumns({"home__": block, "block__": F.explode(both)}).withColumn("own__", F.col("home__") == F.col("block__"))
    schema = StructType([StructField(f.name, f.dataType) for f in (*rows.select(*names).schema, StructField(out, DoubleType()))])
    kinds = to_arrow_schema(schema)  # times come in the session's zone, and Spark takes them back in UTC alone
    return rows.groupBy("symbol", "block__").applyInArrow(run, schema)


def drawdown(c: Column | str) -> Column:
    peak = F.max(c).over(ALL())
    return (peak - col(c)) / peak


def warm(signal: Column, n: int) -> Column:
    """False for the first n bars."""
    return (F.row_number().over(W()) > n) & F.coalesce(signal, F.lit(False))


# --- linear recurrences


def linear_scan(rows: DataFrame, out: str, value: Column | str, alpha: float, seed: int = 1, keys: tuple = ("symbol",), order: str = "ts") -> DataFrame:
    """Add ``out``: y = (1 - alpha) y_before + alpha x, from the mean of the first ``seed`` values that aren't null on.

    The recurrence is linear, so it is cut into blocks: running sums inside each,
    one carry a block, and the carries joined back. A window partition holds one
    block once rows are numbered. Null values inside the series count as 0 change
    of the input: the series is taken to have none after its first value.
    """
    q = 1.0 - alpha
    if q <= 0:
        return rows.withColumn(out, col(value))
    size = max(1, min(256, int(600 / -math.log(q))))
    w = Window.partitionBy(*keys).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("x__").over(run)
    rows = rows.withColumn("x__", col(value)).withColumn("n__", n)
    first = F.avg("x__").over(run) if seed > 1 else F.col("x__")
    rows = rows.withColumn("u__", F.when(F.col("n__") == seed, first).when(F.col("n__") > seed, alpha * F.col("x__")))
    at = F.col("n__") - seed
    rows = rows.withColumns({"b__": F.floor(at / size), "k__": F.pmod(at, F.lit(size))})
    inner = Window.partitionBy(*keys, "b__").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("l__", F.pow(F.lit(q), F.col("k__")) * F.sum(F.col("u__") * F.pow(F.lit(q), -F.col("k__"))).over(inner))
    ends = rows.where("u__ is not null").groupBy(*keys, "b__").agg(F.max_by("l__", "k__").alias("c__"))
    rows = rows.join(_carries(ends, {"c__": q**size}, keys, "b__"), [*keys, "b__"], "left")
    y = F.col("l__") + F.pow(F.lit(q), F.col("k__") + 1) * F.coalesce("c__", F.lit(0.0))
    return rows.withColumn(out, F.when(F.col("u__").isNotNull(), y)).drop("x__", "n__", "u__", "b__", "k__", "l__", "c__")


#: Blocks before that a carry sums directly; what lies beyond their weights of e**-41 is below a double's precision.
DIRECT = 64


def _carries(ends: DataFrame, steps: dict[str, float], keys: tuple, block: str) -> DataFrame:
    """Replace each block's end by what blocks before it carry into it: c = e_before + step e_before_that + ...

    Where weights fade within ``DIRECT`` blocks the sum is direct; slower ones
    are blocked again, blocks of blocks, however far back they reach.
    """
    w = Window.partitionBy(*keys).orderBy(block)
    reach = {c: 1 if q < 1e-300 else math.ceil(41 / -math.log(q)) for c, q in steps.items()}
    near, far = ({c: q for c, q in steps.items() if (reach[c] <= DIRECT) == short} for short in (True, False))
    before = {c: sum((F.coalesce(F.lag(c, i + 1).over(w), F.lit(0.0)) * q**i for i in range(reach[c])), F.lit(0.0)) for c, q in near.items()}
    if far:
        size = min(256, *(int(600 / -math.log(q)) for q in far.values()))
        up, place = f"{block}u", f"{block}k"
        inner = Window.partitionBy(*keys, up).orderBy(block)
        # blocks of a series are numbered without gaps from the first on
        ends = ends.withColumn(place, F.row_number().over(w) - 1).withColumns({up: F.floor(F.col(place) / size), place: F.pmod(F.col(place), F.lit(size))})
        run = inner.rowsBetween(Window.unboundedPreceding, 0)
        ends = ends.withColumns({f"{c}i": F.pow(F.lit(q), F.col(place)) * F.sum(F.col(c) * F.pow(F.lit(q), -F.col(place))).over(run) for c, q in far.items()})
        tops = ends.groupBy(*keys, up).agg(*[F.max_by(f"{c}i", place).alias(f"{c}t") for c in far])
        tops = _carries(tops, {f"{c}t": q**size for c, q in far.items()}, keys, up)
        ends = ends.join(tops, [*keys, up], "left")
        # the carry into a block: what its own larger block had before it, and what came into that
        before |= {c: F.coalesce(F.lag(f"{c}i").over(inner), F.lit(0.0)) + F.pow(F.lit(q), F.col(place)) * F.coalesce(f"{c}t", F.lit(0.0)) for c, q in far.items()}
    return ends.withColumns(before).select(*keys, block, *steps)


def linear_scans(rows: DataFrame, specs: dict[str, tuple], keys: tuple = ("symbol",), order: str = "ts") -> DataFrame:
    """Several recurrences of ``linear_scan`` in one pass: out -> (value, alpha, seed), all alphas below 1.

    Blocks are cut by row number, so they share the windows, one aggregation and
    one join. A value must not be null after its first one.
    """
    q = {c: 1.0 - alpha for c, (_, alpha, _) in specs.items()}
    size = max(1, min(256, *(int(600 / -math.log(x)) for x in q.values())))
    w = Window.partitionBy(*keys).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.columns
    rows = rows.withColumns({f"{c}x__": col(v) for c, (v, _, _) in specs.items()})
    rows = rows.withColumns({"r__": F.row_number().over(w) - 1} | {f"{c}n__": F.count(f"{c}x__").over(run) for c in specs} | {f"{c}f__": F.avg(f"{c}x__").over(run) for c, (_, _, seed) in specs.items() if seed > 1})
    rows = rows.withColumns({"b__": F.floor(F.col("r__") / size), "k__": F.pmod(F.col("r__"), F.lit(size))})
    rows = rows.withColumns({f"{c}u__": F.when(F.col(f"{c}n__") == seed, F.col(f"{c}f__" if seed > 1 else f"{c}x__")).when(F.col(f"{c}n__") > seed, alpha * F.col(f"{c}x__")) for c, (_, alpha, seed) in specs.items()})
    inner = Window.partitionBy(*keys, "b__").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"{c}l__": F.pow(F.lit(q[c]), F.col("k__")) * F.sum(F.coalesce(f"{c}u__", F.lit(0.0)) * F.pow(F.lit(q[c]), -F.col("k__"))).over(inner) for c in specs})
    ends = rows.groupBy(*keys, "b__").agg(*[F.max_by(f"{c}l__", "k__").alias(f"{c}c__") for c in specs])
    rows = rows.join(_carries(ends, {f"{c}c__": q[c] ** size for c in specs}, keys, "b__"), [*keys, "b__"], "left")
    y = {c: F.when(F.col(f"{c}u__").isNotNull(), F.col(f"{c}l__") + F.pow(F.lit(q[c]), F.col("k__") + 1) * F.coalesce(f"{c}c__", F.lit(0.0))) for c in specs}
    return rows.withColumns(y).select(*kept, *specs)


def ema(rows: DataFrame, out: str, value: Column | str, n: int, sma_seed: bool = False) -> DataFrame:
    return linear_scan(rows, out, value, 2 / (n + 1), n if sma_seed else 1)


def wilder(rows: DataFrame, out: str, value: Column | str, n: int) -> DataFrame:
    """(before * (n - 1) + x) / n, from the mean of the first n values on."""
    return linear_scan(rows, out, value, 1 / n, n)


def smma(rows: DataFrame, out: str, value: Column | str, n: int) -> DataFrame:
    return linear_scan(rows, out, value, 1 / n, n)


def hma(rows: DataFrame, out: str, value: str, n: int) -> DataFrame:
    """Hull average: the weighted average, over the root of n, of twice the fast minus the slow weighted average."""
    rows = rows.withColumn("h__", 2 * wma(value, n // 2) - wma(value, n))
    return rows.withColumn(out, wma("h__", int(math.sqrt(n)))).drop("h__")


def rsi(rows: DataFrame, out: str, value: str, n: int) -> DataFrame:
    d = F.col(value) - lag(value)
    rows = rows.withColumns({"g__": F.greatest(d, F.lit(0.0)), "f__": F.greatest(-d, F.lit(0.0))})
    rows = linear_scans(rows, {"gain__": (F.when(d.isNotNull(), F.col("g__")), 1 / n, n), "loss__": (F.when(d.isNotNull(), F.col("f__")), 1 / n, n)})
    r = F.when(F.col("loss__") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("gain__") / F.col("loss__")))
    return rows.withColumn(out, F.when(F.col("gain__").isNotNull(), r)).drop("g__", "f__", "gain__", "loss__")


def atr(rows: DataFrame, out: str, n: int) -> DataFrame:
    return wilder(rows, out, true_range(), n)


# --- runs and cross-sections


def max_streak(rows: DataFrame, flag: str) -> DataFrame:
    """Longest run of True for each symbol (0 if none): gaps and islands."""
    n = F.row_number().over(W())
    rows = rows.withColumn("n__", n)
    island = F.col("n__") - F.row_number().over(Window.partitionBy("symbol", flag).orderBy("ts"))
    runs = rows.withColumn("i__", island).groupBy("symbol", flag, "i__").agg(F.count("*").alias("c"))
    return runs.groupBy("symbol").agg(F.coalesce(F.max(F.when(F.col(flag), F.col("c"))), F.lit(0)).alias("max_streak"))


def cs_momentum_rank(rows: DataFrame, far: int, near: int) -> DataFrame:
    """Percentile rank, among symbols of each time, of the return from ``far`` to ``near`` bars ago."""
    rows = rows.withColumn("mom", F.lag("close", near).over(W()) / F.lag("close", far).over(W()) - 1).where("mom is not null")
    return rows.withColumn("cs_momentum_rank", F.percent_rank().over(Window.partitionBy("ts").orderBy("mom")))
