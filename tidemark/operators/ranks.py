"""Ranks, rank correlation, false-discovery control and percentiles of large groups, none of them sorted in one task.

Values are cut into buckets that keep their order and depend on nothing but the
value: 256 to each power of two on either side of zero. A group's buckets are
ranked apart; counts of buckets, a short table, say what lies before each.
Spark reuses the one shuffle by (group, bucket) for both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets to a power of two.
SLICES = 256
_MIDDLE = SLICES * 2048


def bucket(value: Column) -> Column:
    """Order-keeping bucket of a number; equal values share one, NaN comes last, null has none."""
    v = value.cast("double")
    size = lambda x: F.floor(F.log2(x) * SLICES) + _MIDDLE
    top = F.lit(2 * _MIDDLE)
    return F.when(v.isNull(), None).when(F.isnan(v) | (v == float("inf")), top).when(v == float("-inf"), -top).when(v > 0, size(v)).when(v < 0, -size(-v)).otherwise(0).cast("long")


def _before(rows: DataFrame, keys: tuple[str, ...], *sums: str) -> DataFrame:
    """(keys, bucket__) with each sum over the buckets before, of a table with a row a bucket."""
    w = Window.partitionBy(*keys).orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({f"{s}_before": F.coalesce(F.sum(s).over(w), F.lit(0)) for s in sums})


def _meet(a: DataFrame, b: DataFrame, on: tuple[str, ...], how: str = "inner") -> DataFrame:
    """``a`` with the other columns of ``b`` where all of ``on`` are the same, null or not."""
    if not on:
        return a.crossJoin(F.broadcast(b))  # without groups ``b`` is one row
    there = b.withColumnsRenamed({k: f"{k}__r" for k in on})
    same = F.lit(True)
    for k in on:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__r"))
    return a.join(there, same, how).drop(*[f"{k}__r" for k in on])


def dealt(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """``rows`` with ``bucket__``, shuffled by group and bucket; rows with a null value go."""
    return rows.where(F.col(value).isNotNull()).withColumn("bucket__", bucket(F.col(value))).repartition(*keys, "bucket__")


def average_ranks(rows: DataFrame, out: str, value: str, *keys: str) -> DataFrame:
    """Add ``out``: the rank of ``value`` in its group, ties sharing their mean; rows with a null value go."""
    rows = dealt(rows, value, *keys)
    place = Window.partitionBy(*keys, "bucket__")
    ranked = rows.withColumn("local__", F.rank().over(place.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, "bucket__", value)) - 1) / 2)
    counts = _before(rows.groupBy(*keys, "bucket__").agg(F.count("*").alias("c__")), keys, "c__").drop("c__")
    met = _meet(ranked, counts, (*keys, "bucket__"))
    return met.withColumn(out, F.col("local__") + F.col("c___before")).drop("local__", "bucket__", "c___before")


def signal_correlation(rows: DataFrame, signal: str, value: str, *keys: str) -> DataFrame:
    """keys, ic, n, n_signals: rank correlation of a 0-1 signal with a value, null where one doesn't vary.

    The signal's ranks are two numbers, so sums over buckets do: of the value's ranks where the signal is 1, and of their squares.
    """
    rows = dealt(rows.where(F.col(signal).isNotNull()), value, *keys)
    place = Window.partitionBy(*keys, "bucket__")
    local = F.rank().over(place.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, "bucket__", value)) - 1) / 2
    x, r = F.col(signal).cast("double"), F.col("local__")
    parts = rows.withColumn("local__", local).groupBy(*keys, "bucket__").agg(F.count("*").alias("c"), F.sum(x).alias("on"), F.sum(x * r).alias("on_r"), F.sum(r).alias("r"), F.sum(r * r).alias("r2"))
    b = F.col("c_before")
    parts = _before(parts, keys, "c").select(*keys, "c", "on", (F.col("on") * b + F.col("on_r")).alias("on_r"), (F.col("c") * b * b + 2 * b * F.col("r") + F.col("r2")).alias("r2"))
    out = parts.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum("on").alias("n_signals"), F.sum("on_r").alias("on_r"), F.sum("r2").alias("r2"))
    n, n1 = F.col("n"), F.col("n_signals")
    mean = (n + 1) / 2
    # the signal's two ranks lie n / 2 apart, whatever its share
    variance = (F.col("r2") / n - mean * mean) * (n1 * (n - n1) / (n * n))
    ic = F.try_divide((F.col("on_r") - n1 * mean) / n, F.when(variance > 1e-12, F.sqrt(variance)))
    return out.select(*keys, ic.alias("ic"), "n", "n_signals")


def false_discoveries(tests: DataFrame, p: str, alpha: float, *keys: str) -> DataFrame:
    """``tests`` with ``significant``: p at or below the largest that lies under its Benjamini-Hochberg line; null p count in no way."""
    held = dealt(tests.select(*keys, F.col(p).alias("p__")), "p__", *keys)
    counts = held.groupBy(*keys, "bucket__", "p__").agg(F.count("*").alias("c__"))
    upto = Window.partitionBy(*keys, "bucket__").orderBy("p__").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("local__", F.sum("c__").over(upto))
    sums = _before(held.groupBy(*keys, "bucket__").agg(F.count("*").alias("c__")), keys, "c__").drop("c__")
    met = _meet(counts, sums, (*keys, "bucket__")).withColumn("k__", F.col("local__") + F.col("c___before"))
    line = _meet(met, held.groupBy(*keys).agg(F.count("*").alias("n__")), keys)
    last = line.where(F.col("p__") <= F.col("k__") / F.col("n__") * alpha).groupBy(*keys).agg(F.max("p__").alias("last__"))
    # without groups ``last`` is one row too, null where no test passes
    return _meet(tests, last, keys, "left").withColumn("significant", F.coalesce(F.col(p) <= F.col("last__"), F.lit(False))).drop("last__")


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """keys and, by name, exact percentiles of ``value`` (between two values, in proportion); null values count in no way.

    Counts of buckets tell which ones hold the wanted places; only those are ranked.
    """
    held = dealt(rows.select(*keys, F.col(value).cast("double").alias("v__")), "v__", *keys)
    counts = _before(held.groupBy(*keys, "bucket__").agg(F.count("*").alias("c__")), keys, "c__")
    counts = _meet(counts, held.groupBy(*keys).agg(F.count("*").alias("n__")), keys)
    at = {name: (F.col("n__") - 1) * F.lit(float(q)) for name, q in shares.items()}
    want = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in at.values()])))
    inside = F.filter(want, lambda k: (k >= F.col("c___before")) & (k < F.col("c___before") + F.col("c__")))
    places = counts.withColumn("want__", inside).where(F.size("want__") > 0)
    met = _meet(held, places.drop("c__"), (*keys, "bucket__"))
    k = F.row_number().over(Window.partitionBy(*keys, "bucket__").orderBy("v__")) - 1 + F.col("c___before")
    found = met.withColumn("k__", k).where(F.array_contains("want__", F.col("k__"))).select(*keys, "k__", "v__", "n__")
    out = []
    for name, x in at.items():
        low, high = (F.max(F.when(F.col("k__") == side, F.col("v__"))) for side in (F.floor(x), F.ceil(x)))
        rest = F.max(x - F.floor(x))
        out.append(F.when(rest > 0, low * (1 - rest) + high * rest).otherwise(low).alias(name))
    return found.groupBy(*keys).agg(*out)
