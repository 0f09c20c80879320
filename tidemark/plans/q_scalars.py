"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import stats_udf, text, timeframes
from tidemark.plans import sqlstats
from tidemark.plans.fixtures import table
from tidemark.plans.registry import query

#: Spellings by line number, so that the functions meet known and unknown ones.
SPELLINGS = ["60", "1Hour", "1D", "45min", "1Month", "1W-MON", "odd"]
SPELL_SQL = "(VALUES (1, '60', '1h', 3600, '60', true, 'monthly'), (2, '1Hour', '1h', 3600, '60', true, 'monthly'), (3, '1D', '1d', 86400, 'D', false, 'yearly'), (4, '45min', '45m', 2700, '45', true, 'monthly'), (5, '1Month', '1M', NULL, 'M', false, 'yearly'), (6, '1W-MON', '1w', 604800, 'W', false, 'yearly'), (7, 'odd', NULL, NULL, NULL, false, 'yearly')) AS s(n, raw, key, secs, chart, intra, scheme)"


def spelled(spark, sf):
    words = F.element_at(F.array(*map(F.lit, SPELLINGS)), F.col("l_linenumber"))
    rows = table(spark, sf, "lineitem").where("l_linenumber <= 7").withColumn("raw", words)
    return rows.withColumn("key", timeframes.normalize_timeframe(F.col("raw")))


for _name, _sql, _f in (
    ("normalize_timeframe", "key", lambda k: k),
    ("tf_seconds", "CAST(secs AS BIGINT)", lambda k: timeframes.tf_seconds(k).cast("long")),
    ("tf_to_chart", "chart", timeframes.tf_to_chart),
    ("is_intraday", "intra", timeframes.is_intraday),
    ("partition_scheme", "scheme", timeframes.partition_scheme),
):
    query(_name, f"SELECT raw, {_sql} AS v, count(*) AS n FROM lineitem JOIN {SPELL_SQL} ON s.n = l_linenumber GROUP BY 1, 2")(lambda spark, sf, f=_f: spelled(spark, sf).groupBy("raw", f(F.col("key")).alias("v")).agg(F.count("*").alias("n")))


@query("split_symbol", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat('X', c_nationkey, '/USDT') WHEN 1 THEN concat('X', c_nationkey, '/BTC') WHEN 2 THEN concat('X', c_nationkey, '/ETH') END AS pair FROM customer")
def split_symbol(spark, sf):
    c = table(spark, sf, "customer")
    quote = F.element_at(F.array(*map(F.lit, ("USDT", "BTC", "ETH", "???"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select("c_custkey", text.split_symbol(F.concat(F.lit("X"), "c_nationkey", quote)).alias("pair"))


@query("clean_locale_number", "SELECT c_custkey, c_acctbal AS v FROM customer")
def clean_locale_number(spark, sf):
    c = table(spark, sf, "customer")
    raw = F.translate(F.expr("format_number(c_acctbal, '#,##0.00')"), ",.", ".,")
    return c.select("c_custkey", text.clean_locale_number(F.concat(F.regexp_replace(raw, "-", "−"), F.lit(" USDT"))).alias("v"))


@query("numbers_to_strings", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def numbers_to_strings(spark, sf):
    m = text.numbers_to_strings(F.from_json("props", "map<string,int>"))
    return table(spark, sf, "events").select("event_id", m["k"].alias("k"))


NESTED = "p_partkey, concat('rsi__', p_size % 3) AS name, CAST(p_size AS VARCHAR) AS value"


def nested(spark, sf):
    p = table(spark, sf, "part")
    inner = F.create_map((F.col("p_size") % 3).cast("string"), F.col("p_size").cast("string"))
    return p.withColumn("m", F.create_map(F.lit("rsi"), inner, F.lit("stop"), F.create_map(F.lit("mult"), F.col("p_brand"))))


@query("params_flatten", f"SELECT {NESTED} FROM part UNION ALL SELECT p_partkey, 'stop__mult', p_brand FROM part")
def params_flatten(spark, sf):
    return nested(spark, sf).select("p_partkey", F.explode(text.params_flatten(F.col("m"))).alias("name", "value"))


@query("params_nest", "SELECT p_partkey, 'rsi' AS outer_, CAST(p_size % 3 AS VARCHAR) AS inner_, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'stop', 'mult', p_brand FROM part")
def params_nest(spark, sf):
    flat = nested(spark, sf).withColumn("f", text.params_flatten(F.col("m")))
    rows = flat.select("p_partkey", F.explode(text.params_nest(F.col("f"))).alias("x"))
    return rows.select("p_partkey", F.col("x.outer").alias("outer_"), F.col("x.inner").alias("inner_"), "x.value")


@query("parse_study_name", "SELECT c_custkey, concat('N', c_nationkey) AS symbol, '1h' AS timeframe, CASE WHEN c_custkey % 2 = 0 THEN 'trend' ELSE 'mean_revert_fast' END AS archetype, 'long' AS direction FROM customer")
def parse_study_name(spark, sf):
    name = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit("_1h_"), F.when(F.col("c_custkey") % 2 == 0, "trend").otherwise("mean_revert_fast"), F.lit("_long"))
    return table(spark, sf, "customer").select("c_custkey", text.parse_study_name(name).alias("s")).select("c_custkey", "s.*")


@query("run_id", "SELECT c_custkey, substr(sha256(concat('bal=', c_nationkey, ',seg=', c_mktsegment)), 1, 16) AS run_id FROM customer")
def run_id(spark, sf):
    m = F.create_map(F.lit("seg"), F.col("c_mktsegment"), F.lit("bal"), F.col("c_nationkey").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", text.run_id(m).alias("run_id"))


@query("month_range", "SELECT c, strftime(m, '%Y-%m') AS month FROM (SELECT o_orderpriority AS c, unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH)) AS m FROM orders GROUP BY 1)")
def month_range(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("c")).agg(F.date_trunc("month", F.min("o_orderdate")).alias("a"), F.max("o_orderdate").cast("timestamp").alias("z"))
    return o.select("c", F.explode(F.sequence("a", "z", F.expr("INTERVAL 1 MONTH"))).alias("m")).select("c", F.date_format("m", "yyyy-MM").alias("month"))


@query("year_range", "SELECT DISTINCT o_orderpriority AS c, y FROM (SELECT o_orderpriority, unnest(generate_series(min(year(o_orderdate)), max(year(o_orderdate)))) AS y FROM orders GROUP BY 1)")
def year_range(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("c")).agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("z"))
    return o.select("c", F.explode(F.sequence(F.col("a").cast("long"), F.col("z").cast("long"))).alias("y"))


def balances(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg((F.avg("c_acctbal") / 5000 - 0.9).alias("x"), F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 4500).alias("k"))


BALANCES = "b AS (SELECT c_nationkey, avg(c_acctbal) / 5000 - 0.9 AS x, count(*) AS n, count(*) FILTER (c_acctbal > 4500) AS k FROM customer GROUP BY 1)"


@query("normal_cdf", f"WITH {BALANCES} SELECT c_nationkey, round({sqlstats.normal_cdf('x')}, 6) AS p, 0.0::DOUBLE AS inverse_error FROM b")
def normal_cdf(spark, sf):
    return balances(spark, sf).select("c_nationkey", F.round(stats_udf.normal_cdf("x"), 6).alias("p"), F.round(stats_udf.normal_ppf(stats_udf.normal_cdf("x")) - F.col("x"), 6).alias("inverse_error"))


@query("t_sf", f"WITH {BALANCES} SELECT c_nationkey, round({sqlstats.t_sf('x', '(n - 1)')}, 6) AS p FROM b")
def t_sf(spark, sf):
    return balances(spark, sf).select("c_nationkey", F.round(stats_udf.t_sf("x", (F.col("n") - 1).cast("double")), 6).alias("p"))


@query("binom_sf", f"WITH {BALANCES} SELECT c_nationkey, round({sqlstats.binom_sf('k', 'n', '0.5::DOUBLE')}, 6) AS p FROM b")
def binom_sf(spark, sf):
    return balances(spark, sf).select("c_nationkey", F.round(stats_udf.binom_sf(F.col("k").cast("double"), F.col("n").cast("double"), F.lit(0.5)), 6).alias("p"))
