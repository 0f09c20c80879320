"""Queries of parameter grids, trial tables, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import grid
from tidemark.operators.bars import dedup_keep_last
from tidemark.plans import sqlstats
from tidemark.plans.fixtures import table
from tidemark.plans.registry import query
from tidemark.sources.scratch import folder

R = 6


def space(spark, sf) -> dict:
    """Symbols of the events table by parameter values."""
    symbols = [r[0] for r in table(spark, sf, "events").select("event_type").distinct().orderBy("event_type").collect()]
    return {"symbol": symbols, "n": [7, 14, 21], "mode": ["long", "short"]}


GRID = "g AS (SELECT symbol, n, mode, substr(sha256(concat('mode=', mode, ',n=', n, ',symbol=', symbol)), 1, 16) AS run_id FROM (SELECT DISTINCT event_type AS symbol FROM events), (VALUES (7::BIGINT), (14), (21)) AS a(n), (VALUES ('long'), ('short')) AS b(mode))"


@query("grid_cross_join", f"WITH {GRID} SELECT symbol, n, mode FROM g")
def grid_cross_join(spark, sf):
    return grid.expand(spark, space(spark, sf)).drop("run_id")


@query("grid_expand", f"WITH {GRID} SELECT * FROM g")
def grid_expand(spark, sf):
    return grid.expand(spark, space(spark, sf))


@query("grid_size", "SELECT count(DISTINCT event_type) * 6 AS n FROM events")
def grid_size(spark, sf):
    n = table(spark, sf, "events").agg((F.countDistinct("event_type") * grid.size({"n": [7, 14, 21], "mode": ["long", "short"]})).alias("n"))
    return n


@query("grid_chunk", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk FROM orders")
def grid_chunk(spark, sf):
    return grid.chunks(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1000)


@query("grid_dedup", "SELECT DISTINCT substr(sha256(concat('prio=', o_orderpriority, ',status=', o_orderstatus)), 1, 16) AS run_id FROM orders")
def grid_dedup(spark, sf):
    from tidemark.functions.text import run_id

    o = table(spark, sf, "orders")
    return o.select(run_id(F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("prio"), F.col("o_orderpriority"))).alias("run_id")).dropDuplicates(["run_id"])


@query("space_from_schema", "SELECT p_brand AS name, CAST(v AS VARCHAR) AS value FROM (SELECT p_brand, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1), LATERAL (SELECT unnest(generate_series(lo, hi, 10)) AS v) UNION ALL SELECT 'mode', unnest(['a', 'b'])")
def space_from_schema(spark, sf):
    p = table(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi")).withColumns({"step": F.lit(10), "choices": F.lit(None).cast("array<string>")})
    mode = spark.createDataFrame([("mode", None, None, None, ["a", "b"])], "name string, lo int, hi int, step int, choices array<string>")
    return grid.space_from_schema(p.unionByName(mode))


SYMBOLS = "(SELECT list(s ORDER BY s) AS l FROM (SELECT DISTINCT event_type AS s FROM events))"


@query("random_configs", f"SELECT l[1 + {sqlstats.draw('5', '1', 'i', chr(39) + 'symbol' + chr(39))}] AS symbol, [7, 14, 21][1 + {sqlstats.draw('3', '1', 'i', chr(39) + 'n' + chr(39))}] AS n, ['long', 'short'][1 + {sqlstats.draw('2', '1', 'i', chr(39) + 'mode' + chr(39))}] AS mode, count(*) AS c FROM {SYMBOLS}, LATERAL (SELECT unnest(range((SELECT count(*) FROM orders))) AS i) GROUP BY ALL")
def random_configs(spark, sf):
    """As many configurations as orders; counts of each value."""
    n = table(spark, sf, "orders").count()
    return grid.random_configs(spark, n, space(spark, sf)).groupBy("symbol", "n", "mode").agg(F.count("*").alias("c"))


FRAMES = "(VALUES ('T1'), ('T2'), ('T1+T2'), ('T3'), ('T1+T3'), ('T2+T3'), ('T1+T2+T3')) AS f(f)"


@query("v1_combinations", f"WITH n AS (SELECT s, s < 'f' AS timed FROM (SELECT DISTINCT event_type AS s FROM events)), st AS (SELECT s, NULL AS v FROM n UNION ALL SELECT s, s FROM n UNION ALL SELECT s, s || ':' || f FROM n, {FRAMES} WHERE timed) SELECT concat_ws(',', a.v, b.v, c.v, d.v, e.v) AS indicators, o AS optional_count, m AS multiplier, p AS close_pct FROM (SELECT v FROM st WHERE s = 'click') a, (SELECT v FROM st WHERE s = 'error') b, (SELECT v FROM st WHERE s = 'purchase') c, (SELECT v FROM st WHERE s = 'signup') d, (SELECT v FROM st WHERE s = 'view') e, (VALUES (1), (2)) AS o(o), (VALUES (1.5::DOUBLE), (2.0)) AS m(m), (VALUES (50::DOUBLE), (100)) AS p(p)")
def v1_combinations(spark, sf):
    c = grid.combinations(spark, {x: x < "f" for x in space(spark, sf)["symbol"]}, [1, 2], [1.5, 2.0], [50.0, 100.0])
    return c.select(F.array_join("indicators", ",").alias("indicators"), "optional_count", "multiplier", "close_pct")


@query("v1_batches", "SELECT o_orderkey, k // 200 AS batch, k % 200 + 1 AS place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders)")
def v1_batches(spark, sf):
    b = grid.chunks(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 200).withColumnRenamed("chunk", "batch")
    return b.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy("o_orderkey")).cast("long"))


@query("study_list", "SELECT DISTINCT event_type AS symbol, archetype, direction FROM events, (VALUES ('trend', 'both'), ('revert', 'long')) AS a(archetype, natural_), (VALUES ('long'), ('short')) AS d(direction) WHERE natural_ IN ('both', direction)")
def study_list(spark, sf):
    a = spark.createDataFrame([("trend", "both"), ("revert", "long")], "archetype string, natural string")
    s = table(spark, sf, "events").select(F.col("event_type").alias("symbol")).distinct()
    d = spark.createDataFrame([("long",), ("short",)], "direction string")
    return s.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(d)).where("natural in ('both', direction)").select("symbol", "archetype", "direction")  # fixed lists


@query("strategy_matrix", "SELECT concat_ws('_', b, t, h) AS name, b AS entry, h AS htf FROM (SELECT DISTINCT p_brand AS b FROM part), (SELECT DISTINCT p_type AS t FROM part), (SELECT DISTINCT p_brand AS h FROM part WHERE p_size < 3) WHERE b <> h")
def strategy_matrix(spark, sf):
    p = table(spark, sf, "part")
    b, t, h = p.select(F.col("p_brand").alias("entry")).distinct(), p.select("p_type").distinct(), p.where("p_size < 3").select(F.col("p_brand").alias("htf")).distinct()
    m = b.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(h)).where("entry <> htf")  # distinct brands and types: closed lists
    return m.select(F.concat_ws("_", "entry", "p_type", "htf").alias("name"), "entry", "htf")


TRIALS = "(SELECT o_orderkey AS trial, o_orderpriority AS study, o_totalprice / 1000 AS sharpe, o_custkey % 500 AS trades FROM orders)"


def trials(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("trial"), F.col("o_orderpriority").alias("study"), (F.col("o_totalprice") / 1000).alias("sharpe"), (F.col("o_custkey") % 500).alias("trades"))



def best():
    return [F.desc("sharpe"), F.asc("trial")]


@query("trials_top_n", f"SELECT * FROM {TRIALS} WHERE trades >= 300 QUALIFY row_number() OVER (PARTITION BY study ORDER BY sharpe DESC, trial) <= 5")
def trials_top_n(spark, sf):
    return grid.top_k(trials(spark, sf).where("trades >= 300"), 5, best(), "study")


@query("trials_pareto", f"SELECT * FROM {TRIALS} a WHERE NOT EXISTS (SELECT 1 FROM {TRIALS} b WHERE b.sharpe >= a.sharpe AND b.trades >= a.trades AND (b.sharpe > a.sharpe OR b.trades > a.trades))")
def trials_pareto(spark, sf):
    return grid.pareto(trials(spark, sf), "trades", "sharpe")


@query("penalised_value", f"SELECT trial, CASE WHEN trades < 300 THEN -10 WHEN trial % 10 = 0 THEN 0 ELSE sharpe END::DOUBLE AS value FROM {TRIALS}")
def penalised_value(spark, sf):
    v = F.when(F.col("trial") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("sharpe"))
    return trials(spark, sf).select("trial", grid.penalised(v, F.col("trades")).alias("value"))


def importances(spark, sf):
    p = table(spark, sf, "part").withColumn("y", F.col("p_retailprice") + F.col("p_size") * 10)
    return grid.feature_importance(p, ["p_type"], ["p_size", "p_retailprice"], "y", rounds=5, threshold=0.0)


@query("feature_importance")
def feature_importance(spark, sf):
    return importances(spark, sf).withColumn("importance", F.round("importance", 4))


@query("top_params")
def top_params(spark, sf):
    return grid.ranked(importances(spark, sf), 6, [F.desc("importance"), F.asc("feature")]).select("feature", "rank")


@query("mutual_information", f"WITH x AS (SELECT p_brand AS a, p_size // 10 AS b FROM part), j AS (SELECT a, b, count(*) AS c FROM x GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM x), k AS (SELECT *, sum(c) OVER (PARTITION BY a) AS ca, sum(c) OVER (PARTITION BY b) AS cb FROM j) SELECT round(sum(c / n * ln(c * n / (ca * cb))), {R}) AS mi FROM k, n")
def mutual_information(spark, sf):
    p = table(spark, sf, "part").select("p_brand", F.floor(F.col("p_size") / 10).alias("bin"))
    return grid.mutual_information(p, "p_brand", "bin").withColumn("mi", F.round("mi", R))


# --- 2.14


@query("ranking_top100", f"SELECT trial, sharpe FROM {TRIALS} ORDER BY sharpe DESC, trial LIMIT 100")
def ranking_top100(spark, sf):
    return grid.top_k(trials(spark, sf), 100, best()).select("trial", "sharpe")


@query("finalist_rank", f"SELECT trial, row_number() OVER (ORDER BY sharpe DESC, trial) AS rank FROM {TRIALS} QUALIFY rank <= 50")
def finalist_rank(spark, sf):
    return grid.ranked(trials(spark, sf), 50, best()).select("trial", F.col("rank").cast("long").alias("rank"))


@query("top_positive", f"SELECT trial, sharpe, n_positive FROM (SELECT *, count(*) FILTER (sharpe > 100) OVER () AS n_positive FROM {TRIALS}) WHERE sharpe > 100 ORDER BY sharpe DESC, trial LIMIT 10")
def top_positive(spark, sf):
    t = trials(spark, sf)
    n = t.agg(F.count_if(F.col("sharpe") > 100).alias("n_positive"))  # one row
    return grid.top_k(t.where("sharpe > 100"), 10, best()).crossJoin(n).select("trial", "sharpe", "n_positive")


@query("top_k_per_group", f"SELECT study, trial FROM {TRIALS} QUALIFY row_number() OVER (PARTITION BY study ORDER BY sharpe DESC, trial) <= 3")
def top_k_per_group(spark, sf):
    return grid.top_k(trials(spark, sf), 3, best(), "study").select("study", "trial")


@query("prefer_filled_dedup", "SELECT name, has_result FROM (SELECT p_name AS name, p_size > 25 AS has_result, p_partkey FROM part) QUALIFY row_number() OVER (PARTITION BY name ORDER BY has_result DESC, p_partkey DESC) = 1")
def prefer_filled_dedup(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("name"), (F.col("p_size") > 25).alias("has_result"), F.struct(F.col("p_size") > 25, "p_partkey").alias("o"))
    return dedup_keep_last(p, "o", "name").drop("o")


@query("unfinished_rows", "SELECT p_partkey, concat('{\"name\":\"', p_name, '\",\"params\":{\"brand\":\"', p_brand, '\",\"size\":', p_size, '}}') AS json FROM part WHERE p_size % 7 = 0")
def unfinished_rows(spark, sf):
    done = F.col("p_size") % 7 != 0
    p = table(spark, sf, "part").withColumns({"profit": F.when(done, "1").otherwise(""), "trades": F.when(done, "2")})
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    j = F.to_json(F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("params")))
    return p.where(empty("profit") & empty("trades")).select("p_partkey", j.alias("json"))


@query("set_difference", "SELECT * FROM (SELECT p_partkey AS id, 'a' AS side FROM part EXCEPT SELECT l_partkey, 'a' FROM lineitem WHERE l_linenumber = 2) UNION ALL SELECT * FROM (SELECT l_partkey AS id, 'b' FROM lineitem WHERE l_linenumber = 2 EXCEPT SELECT p_partkey, 'b' FROM part WHERE p_size < 40)")
def set_difference(spark, sf):
    p = table(spark, sf, "part")
    b = table(spark, sf, "lineitem").where("l_linenumber = 2").select(F.col("l_partkey").alias("id"))
    one = grid.set_difference(p.select(F.col("p_partkey").alias("id")), b).where("side = 'a'")
    return one.union(grid.set_difference(p.where("p_size < 40").select(F.col("p_partkey").alias("id")), b).where("side = 'b'"))


@query("union_results", "SELECT p_partkey AS id, p_size AS size, NULL::DOUBLE AS price FROM part WHERE p_size < 10 UNION ALL SELECT p_partkey, NULL, p_retailprice FROM part WHERE p_size > 40")
def union_results(spark, sf):
    p, path = table(spark, sf, "part"), folder(spark, "union")
    p.where("p_size < 10").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")).write.parquet(f"{path}/a")
    p.where("p_size > 40").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price")).write.parquet(f"{path}/b")
    return spark.read.parquet(f"{path}/a").unionByName(spark.read.parquet(f"{path}/b"), allowMissingColumns=True)
