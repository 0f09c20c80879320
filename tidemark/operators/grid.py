"""Parameter grids, trial tables, rankings and set operations."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import run_id
from tidemark.operators.overfit import draw
from tidemark.operators.ranks import bucket
from tidemark.sources.scratch import folder


def expand(spark: SparkSession, space: dict[str, list]) -> DataFrame:
    """All combinations of values, one row each, with run_id from its entries."""
    parts = [spark.createDataFrame([(v,) for v in values], [name]) for name, values in space.items()]
    rows = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # value lists: a handful of rows each
    params = F.create_map(*[x for name in space for x in (F.lit(name), F.col(name).cast("string"))])
    return rows.withColumn("run_id", run_id(params))


def size(space: dict[str, list]) -> int:
    n = 1
    for values in space.values():
        n *= len(values)
    return n


def chunks(rows: DataFrame, order: str, per: int) -> DataFrame:
    """Chunk numbers of ``per`` rows in order, without a sort of all rows in one task.

    Rows are dealt to ranges of ``order`` and written with their range's number once, so
    counting and numbering see the same ranges whatever is read again.
    """
    spark = rows.sparkSession
    path = folder(spark, "chunks")
    rows.repartitionByRange(order).withColumn("p__", F.spark_partition_id()).write.parquet(path)
    parts = spark.read.parquet(path)
    n = parts.groupBy("p__").agg(F.count("*").alias("n__"))  # one row a range
    before = n.select(F.col("p__").alias("q__"), F.coalesce(F.sum("n__").over(Window.orderBy("p__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b__"))
    k = F.row_number().over(Window.partitionBy("p__").orderBy(order)) - 1
    return parts.withColumn("k__", k).join(before, F.col("p__") == F.col("q__")).withColumn("chunk", F.floor((F.col("b__") + F.col("k__")) / per)).drop("p__", "q__", "k__", "b__")


def space_from_schema(schema: DataFrame) -> DataFrame:
    """(name, value) from rows of name, lo, hi, step or a list of choices; where a column ``kind`` says int or float, values are written as such."""
    at = lambda i: F.col("lo") + i * F.col("step")
    text = lambda i: at(i).cast("string")
    if "kind" in schema.columns:
        text = lambda i: F.when(F.col("kind") == "int", at(i).cast("long").cast("string")).otherwise(F.round(at(i), 10).cast("string"))
    steps = F.transform(F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo")) / F.col("step") + 1e-9).cast("int")), text)
    return schema.select("name", F.explode(F.coalesce("choices", steps)).alias("value"))


def random_configs(spark: SparkSession, n: int, space: dict[str, list], seed: int = 1) -> DataFrame:
    """n configurations whose values are picked by a hash of (seed, row, name)."""
    pick = lambda name, values: F.element_at(F.array(*map(F.lit, values)), (draw(len(values), seed, F.col("id"), name) + 1).cast("int"))
    return spark.range(n).select(F.col("id").alias("trial"), *[pick(k, v).alias(k) for k, v in space.items()])


def subsets(spark: SparkSession, names: list[str], least: int = 1) -> DataFrame:
    """All subsets of a list as sorted arrays, by bit mask."""
    arr = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(sorted(names))])
    on = F.transform(F.filter(arr, lambda x: F.call_function("shiftright", F.col("id"), x["i"]).bitwiseAND(F.lit(1)) == 1), lambda x: x["n"])
    return spark.range(1 << len(names)).select(F.col("id").alias("mask"), on.alias("members")).where(F.size("members") >= least)


def combinations(spark: SparkSession, indicators: dict[str, bool], counts: list[int], multipliers: list[float], closes: list[float], frames: tuple = ("T1", "T2", "T3")) -> DataFrame:
    """All combinations of indicator states by optional counts, profit multipliers and closing percentages: id, indicators, optional_count, multiplier, close_pct.

    An indicator is off, on, or, where its value says that it has timeframes, on with each set of them (``name:T1+T3``).
    Ids count in mixed radix, so a row follows from its id alone.
    """
    marks = ["+".join(f for i, f in enumerate(frames) if m >> i & 1) for m in range(1, 1 << len(frames))]
    base, picked = 1, []
    for name, timed in sorted(indicators.items()):
        states = [None, name] + [f"{name}:{m}" for m in marks] * timed
        digit = F.pmod(F.call_function("div", F.col("id"), F.lit(base)), F.lit(len(states)))
        picked.append(F.element_at(F.array(*[F.lit(x).cast("string") for x in states]), (digit + 1).cast("int")))
        base *= len(states)
    columns = {"indicators": F.array_compact(F.array(*picked))}
    for column, values in (("optional_count", counts), ("multiplier", multipliers), ("close_pct", closes)):
        digit = F.pmod(F.call_function("div", F.col("id"), F.lit(base)), F.lit(len(values)))
        columns[column] = F.element_at(F.array(*map(F.lit, values)), (digit + 1).cast("int"))
        base *= len(values)
    return spark.range(base).select("id", *[c.alias(n) for n, c in columns.items()])


def pareto(trials: DataFrame, x: str, y: str) -> DataFrame:
    """Trials that none beats in both; equal ones stay or go together, those with a null or NaN measure go.

    Per x only its best y can stay, and only if it exceeds each y over larger x. These prefix maxima are taken in
    order-keeping buckets of x; what lies over a bucket comes from one row a bucket and one a thousand buckets.
    """
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    best = trials.where(known(x) & known(y)).groupBy(F.col(x).alias("x__")).agg(F.max(y).alias("y__"))
    best = best.withColumn("bucket__", bucket(F.col("x__"))).withColumn("far__", F.floor(F.col("bucket__") / 1024)).repartition("far__", "bucket__")
    tops = best.groupBy("far__", "bucket__").agg(F.max("y__").alias("top__"))
    above = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    near = tops.withColumn("near__", F.max("top__").over(above("far__").orderBy(F.desc("bucket__")))).select("far__", "bucket__", "near__")
    far = tops.groupBy("far__").agg(F.max("top__").alias("top__")).agg(F.collect_list(F.struct("far__", "top__")).alias("all__"))  # 2,049 entries at most
    over = F.array_max(F.transform(F.filter("all__", lambda e: e["far__"] > F.col("far__")), lambda e: e["top__"]))
    rows = best.join(near, ["far__", "bucket__"]).crossJoin(F.broadcast(far)).withColumn("within__", F.max("y__").over(above("far__", "bucket__").orderBy(F.desc("x__"))))
    limit = F.greatest("within__", "near__", over)
    front = rows.where(limit.isNull() | (F.col("y__") > limit)).select("x__", "y__")
    return trials.join(front, (F.col(x) == F.col("x__")) & (F.col(y) == F.col("y__"))).drop("x__", "y__")


#: Points of a block in ``skyline``; two blocks are compared in a task.
BLOCK = 20_000


def undominated(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which points no row of ``by`` beats: at least as much everywhere, more somewhere."""
    keep = np.ones(len(points), bool)
    for i in range(0, len(by), 64):
        left = np.flatnonzero(keep)
        if not len(left):
            break
        a, b = points[left][:, None, :], by[None, i : i + 64, :]
        keep[left[((b >= a).all(2) & (b > a).any(2)).any(1)]] = False
    return keep


def skyline(trials: DataFrame, *measures: str) -> DataFrame:
    """Trials that none beats in all measures (more is better); equal ones stay or go together, null or NaN ones go.

    Each task first keeps its own front. What is left is dealt over blocks, and each block meets each other in a task of its
    own, which names the beaten: no task holds more than two blocks, whatever the front's size.
    """
    at = [f"m{i}__" for i in range(len(measures))]
    points = trials.select(*[F.col(m).cast("double").alias(a) for m, a in zip(measures, at, strict=True)]).na.drop().distinct()
    schema = ", ".join(f"{a} double" for a in at)

    def own_front(frames):
        front = np.empty((0, len(at)))
        for frame in frames:
            new = frame[at].to_numpy(float)
            new = new[np.argsort(-new.sum(1))]
            new = new[undominated(new, front)]
            new = new[undominated(new, new)]
            front = np.vstack([front[undominated(front, new)], new])
            if len(front) > BLOCK:
                yield pd.DataFrame(front, columns=at)
                front = front[:0]
        yield pd.DataFrame(front, columns=at)

    fronts = points.mapInPandas(own_front, schema).checkpoint()
    n = max(1, -(-fronts.count() // BLOCK))
    numbers = F.sequence(F.lit(0), F.lit(n - 1))
    block = fronts.withColumn("block__", F.pmod(F.xxhash64(*at), F.lit(n)))
    tested = block.withColumn("other__", F.explode(numbers))
    testers = block.withColumnRenamed("block__", "other__").withColumn("block__", F.explode(numbers))

    def beaten(a, b):
        return a[at][~undominated(a[at].to_numpy(float), b[at].to_numpy(float))]

    gone = tested.groupBy("block__", "other__").cogroup(testers.groupBy("block__", "other__")).applyInPandas(beaten, schema).distinct()
    front = fronts.join(gone, at, "left_anti")
    same = [F.col(m).cast("double") == F.col(a) for m, a in zip(measures, at, strict=True)]
    return trials.join(front, reduce(and_, same), "left_semi")


def penalised(value: Column, trades: Column, least: int = 300) -> Column:
    clean = F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)
    return F.when(trades < least, -10.0).otherwise(clean)


#: Rows that a task of ``feature_importance`` reads from the cached trials, about.
TRIALS = 100_000


def weighted(rows: DataFrame, weight: str) -> DataFrame:
    """Distinct rows with how many there are of each, dealt by hash over tasks of about ``TRIALS`` rows or fewer and sorted in each.

    So what a task holds doesn't grow with the table or with copies, and rows lie the same however the table was read.
    """
    tasks = max(1, -(-rows.count() // TRIALS))
    names = rows.columns
    return rows.groupBy(*names).agg(F.count("*").cast("double").alias(weight)).repartition(tasks, *names).sortWithinPartitions(*names)


def feature_importance(trials: DataFrame, categorical: list[str], numeric: list[str], target: str, rounds: int = 10, threshold: float | None = None) -> DataFrame:
    """(feature, importance) of boosted trees that predict the target; those above ``threshold`` alone if given. Equal trials are one with their number as its weight."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    trials = trials.select(*dict.fromkeys([*categorical, *numeric, target]))
    index = [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep") for c in categorical]
    indexed = Pipeline(stages=index).fit(trials).transform(weighted(trials, "n__"))
    inputs = [f"{c}__i" for c in categorical] + numeric
    model = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="f__"), GBTRegressor(featuresCol="f__", labelCol=target, weightCol="n__", maxIter=rounds, maxDepth=3, seed=1, maxBins=64)]).fit(indexed)
    scores = model.stages[-1].featureImportances.toArray().tolist()
    kept = [x for x in zip(categorical + numeric, scores, strict=True) if threshold is None or x[1] > threshold]
    return trials.sparkSession.createDataFrame(kept, "feature string, importance double")


def mutual_information(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Sum of p ln(p / (p_x p_y)) over binned values."""
    n = rows.count()
    xy = rows.groupBy(x, y).agg(F.count("*").alias("c"))
    xs, ys = xy.groupBy(x).agg(F.sum("c").alias("cx")), xy.groupBy(y).agg(F.sum("c").alias("cy"))
    j = xy.join(xs, x).join(ys, y)
    return j.agg(F.sum(F.col("c") / n * F.ln(F.col("c") * n / (F.col("cx") * F.col("cy")))).alias("mi"))


def top_k(rows: DataFrame, k: int, order: list, *keys: str) -> DataFrame:
    """k rows for each group (or of all, by a partial sort in each task)."""
    if not keys:
        return rows.orderBy(*order).limit(k)
    return rows.withColumn("rn__", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn__") <= k).drop("rn__")


def ranked(rows: DataFrame, k: int, order: list) -> DataFrame:
    """Rank of the best k: cut first, so the numbering sorts k rows alone."""
    return top_k(rows, k, order).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids in one of two tables only, with the side they are on."""
    return a.subtract(b).withColumn("side", F.lit("a")).union(b.subtract(a).withColumn("side", F.lit("b")))
