"""Queries of scans, sinks, data quality, joins and time bucketing."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import asof, bars, overfit, quality
from tidemark.plans.fixtures import BARS_1D, BARS_1H, SLOW, bars_1d, bars_1h, slow_series, table, ticks
from tidemark.plans.registry import query
from tidemark.sources import bars as store
from tidemark.sources.scratch import folder

R = 6
OHLCV = ["open", "high", "low", "close", "volume"]


def stored(spark, sf, timeframe="1h", b=None):
    """Hourly bars written to a new store; its path."""
    path = folder(spark, "bars")
    b = bars_1h(spark, sf) if b is None else b
    store.write_bars(b.select(F.lit("ex").alias("exchange"), "symbol", F.lit(timeframe).alias("timeframe"), "ts", *OHLCV), path)
    return path


# --- 2.1


@query("bars_read", f"WITH {BARS_1H} SELECT symbol, ts, close, volume FROM bars WHERE symbol = 'click' AND ts >= '2024-01-05' AND ts <= '2024-01-20'")
def bars_read(spark, sf):
    return store.read_bars(spark, stored(spark, sf), "ex", "click", "1h", "2024-01-05", "2024-01-20", ("close", "volume"))


@query("bars_write", f"WITH {BARS_1H} SELECT 'ex' AS exchange, symbol, '1h' AS timeframe, strftime(ts, '%Y-%m') AS period, ts, open, high, low, close, volume FROM bars")
def bars_write(spark, sf):
    return spark.read.schema(store.SCHEMA).parquet(stored(spark, sf)).select("exchange", "symbol", "timeframe", "period", "ts", *OHLCV)


@query("bars_inventory", f"WITH {BARS_1H} SELECT 'ex' AS exchange, symbol, '1h' AS timeframe, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows, count(DISTINCT date_trunc('month', ts)) AS n_files, true AS has_mb, concat('exchange=ex/symbol=', symbol, '/timeframe=1h') AS source FROM bars GROUP BY symbol")
def bars_inventory(spark, sf):
    """Sizes depend on the writer, so they are only compared with a bar's 48 bytes."""
    out = store.inventory(spark, stored(spark, sf))
    return out.withColumns({"has_mb": (F.col("mb") > 0) & (F.col("mb") < F.col("n_rows") * 48 / 1e6 + 0.1), "source": F.regexp_extract("source", r"exchange=.*", 0)}).drop("mb")


def archived(rows):
    """(path, content): a zip archive for each symbol and month of kline rows, as ``binaryFile`` would read it."""

    def pack(key, frame):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("readme.txt", "klines")
            z.writestr("klines.csv", frame.drop(columns=["symbol", "month"]).to_csv(index=False, header=False))
        return pd.DataFrame({"path": ["-".join(key) + ".zip"], "content": [out.getvalue()]})

    return rows.groupBy("symbol", "month").applyInPandas(pack, "path string, content binary")


@query("kline_csv_scan", f"WITH {BARS_1H} SELECT ts, open, high, low, close, volume FROM bars")
def kline_csv_scan(spark, sf):
    """Days with an even number come as plain files, the others in archives of a symbol's month."""
    path = folder(spark, "klines")
    rest = ["close_time", "quote_volume", "trades", "buy_base", "buy_quote", "ignore"]
    b = bars_1h(spark, sf).withColumns({"open_time": F.unix_millis("ts"), "month": F.date_format("ts", "yyyy-MM")} | {n: F.lit(0) for n in rest})
    even = F.dayofmonth("ts") % 2 == 0
    b.where(even).select(*store.KLINE).write.csv(path)
    return store.read_klines(spark, path).unionByName(store.klines_of_archives(archived(b.where(~even).select("symbol", "month", *store.KLINE))))


@query("epoch_normalise", "SELECT event_id, ts FROM events")
def epoch_normalise(spark, sf):
    e = table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    raw = F.when(F.col("event_id") % 2 == 0, F.col("us") * 1000).otherwise(F.col("us"))
    return e.select("event_id", store.epoch_normalise(raw).alias("ts"))


@query("json_ohlcv_scan", f"WITH {BARS_1H} SELECT symbol, ts, open, high, low, close, volume FROM bars")
def json_ohlcv_scan(spark, sf):
    b = bars_1h(spark, sf)
    lists = b.groupBy("symbol", F.to_date("ts").alias("d")).agg(F.to_json(F.collect_list(F.array(F.unix_millis("ts").cast("double"), *OHLCV))).alias("json"))
    return store.parse_json_bars(lists, "json", "symbol")


@query("barset_flatten", f"WITH {BARS_1H} SELECT symbol, ts + INTERVAL 5 HOURS AS ts, open, high, low, close, volume FROM bars")
def barset_flatten(spark, sf):
    b = bars_1h(spark, sf)
    twice = b.withColumn("arrival", F.lit(1)).unionByName(b.withColumn("arrival", F.lit(0)).withColumn("close", F.lit(0.0)))
    return store.flatten_barset(twice, "GMT-05:00")


CARDS = "SELECT c_mktsegment AS symbol, '1h' AS timeframe, concat('a', c_nationkey % 3) AS archetype, CASE WHEN c_custkey % 2 = 0 THEN 'long' ELSE 'short' END AS direction, abs(c_acctbal) / 10000 AS pbo, c_custkey AS candidate_id FROM customer"


@query(
    "evidence_scan",
    f"SELECT symbol, timeframe, archetype, direction, pbo, candidate_id, concat_ws('_', symbol, timeframe, archetype, direction) AS label FROM ({CARDS}) WHERE pbo < 0.5 QUALIFY row_number() OVER (PARTITION BY symbol, timeframe, archetype, direction ORDER BY pbo, candidate_id) = 1",
)
def evidence_scan(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("tidemark_customer")
    path = folder(spark, "cards")
    spark.sql(CARDS.replace("FROM customer", "FROM tidemark_customer")).write.json(path)
    cards = spark.read.schema("symbol string, timeframe string, archetype string, direction string, pbo double, candidate_id long").json(path)
    return store.best_evidence(cards, 0.5)


@query(
    "v1_results_flatten",
    'SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_size % 2 = 0 AS "Use RSI", CASE WHEN p_size % 3 = 0 THEN true END AS "Use MACD", CAST(p_size AS BIGINT) AS stop, p_type AS "take profit",'
    " CASE WHEN p_size % 5 <> 0 THEN p_brand END AS requires, CAST(-(p_partkey * 1.5) AS DOUBLE) AS profit, CAST(p_partkey + 1000 AS DOUBLE) AS trades FROM part",
)
def v1_results_flatten(spark, sf):
    p = table(spark, sf, "part")
    profit = F.concat(F.lit("−"), F.regexp_replace(F.format_string("%.1f", F.col("p_partkey") * 1.5), r"\.", ","), F.lit(" USDT"))
    trades = F.regexp_replace((F.col("p_partkey") + 1000).cast("string"), r"(\d)(\d{3})$", "$1.$2")
    indicators = F.struct((F.col("p_size") % 2 == 0).alias("Use RSI"), F.when(F.col("p_size") % 3 == 0, F.lit(True)).alias("Use MACD"), F.lit("first").alias("take profit"))
    risk = F.struct(F.col("p_size").alias("stop"), F.col("p_type").alias("take profit"))
    requires = F.struct(F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("requires"))
    parts = F.struct(indicators.alias("indicators"), risk.alias("riskManagement"), requires.alias("requires"))
    entry = F.create_map(F.col("p_partkey").cast("string"), F.struct(F.col("p_name").alias("name"), parts.alias("combination"), F.struct(profit.alias("profit"), trades.alias("trades")).alias("result")))
    return store.flatten_results(p.select(F.to_json(entry).alias("json"))).withColumn("profit", F.col("profit") + 0)


@query("chunk_results", "SELECT DISTINCT o_custkey % 50 AS chunk_id FROM orders WHERE o_custkey % 50 >= 30")
def chunk_results(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("chunk_id"), "o_totalprice")
    path = folder(spark, "chunks")
    store.append_chunks(o.where("chunk_id < 10"), path)
    store.append_chunks(o.where("chunk_id >= 10 AND chunk_id < 30"), path)
    return store.pending_chunks(spark, o.select("chunk_id").distinct(), path)


@query("trials_scan", "SELECT o_orderkey AS trial_id, o_totalprice AS value, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS rsi__mode FROM orders")
def trials_scan(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("trial_id"), F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("rsi__mode"))
    path = folder(spark, "trials")
    o.where("trial_id % 2 = 0").write.parquet(f"{path}/study=a")
    o.where("trial_id % 2 <> 0").drop("rsi__mode").write.parquet(f"{path}/study=b")
    return store.scan_trials(spark, path, ["trial_id", "value", "rsi__mode"])


@query("csv_summary_sink", f"WITH {BARS_1H} SELECT symbol, count(*) AS n_bars, max(high) AS top FROM bars GROUP BY symbol")
def csv_summary_sink(spark, sf):
    path = folder(spark, "csv")
    store.write_csv(bars_1h(spark, sf).groupBy("symbol").agg(F.count("*").alias("n_bars"), F.max("high").alias("top")), path)
    return spark.read.option("header", "true").schema("symbol string, n_bars long, top double").csv(path)


@query("trade_log_sink", "SELECT event_id, event_type, value FROM events WHERE value > 50")
def trade_log_sink(spark, sf):
    path, e = folder(spark, "log"), table(spark, sf, "events").where("value > 50").select("event_id", "event_type", "value")
    for k in (0, 1):
        store.append_json(e.where(F.col("event_id") % 2 == k), path)
    return spark.read.schema("event_id long, event_type string, value double").json(path)


# --- 2.2


@query("dq_schema", "SELECT 'missing' AS issue, 'funding_rate' AS column_name UNION ALL SELECT 'type', 'volume'")
def dq_schema(spark, sf):
    b = bars_1h(spark, sf)
    return quality.schema_issues(b, {**{c: "double" for c in OHLCV}, "funding_rate": "double", "volume": "long"})


@query(
    "dq_timestamps",
    """WITH x AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS ts, event_id FROM events), f AS (
    SELECT symbol, 'error' AS severity, 'duplicate_timestamps' AS issue_type, 'repeated timestamps' AS description, min(ts) AS ts, count(*) AS n FROM (SELECT symbol, ts FROM x GROUP BY ALL HAVING count(*) > 1) GROUP BY symbol
    UNION ALL SELECT symbol, 'error', 'future_timestamps', 'timestamps in the future', min(ts), count(*) FROM x WHERE ts > '2024-01-25' GROUP BY symbol
    UNION ALL SELECT symbol, 'warning', 'unordered', 'rows arrive out of order', min(ts), count(*) FROM (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY (event_id * 7919) % 100003, event_id) AS p FROM x) WHERE ts < p GROUP BY symbol)
    SELECT symbol, severity, issue_type, ts, description, n AS affected_rows FROM f""",
)
def dq_timestamps(spark, sf):
    x = table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("ts"), F.struct((F.col("event_id") * 7919) % 100003, "event_id").alias("arrival"))
    return quality.timestamp_issues(x, F.lit("2024-01-25").cast("timestamp"), "arrival")


#: Bars with some fields exchanged, so that checks find something.
BROKEN = f"{BARS_1H}, broken AS MATERIALIZED (SELECT symbol, ts, open, CASE WHEN hour(ts) = 3 THEN low ELSE high END AS high, CASE WHEN hour(ts) = 4 THEN high ELSE low END AS low, close, CASE WHEN hour(ts) = 5 THEN -volume WHEN hour(ts) = 6 THEN 0 ELSE volume END AS volume FROM bars)"


def broken(spark, sf):
    h = F.hour("ts")
    b = bars_1h(spark, sf)
    return b.select("symbol", "ts", "open", F.when(h == 3, F.col("low")).otherwise(F.col("high")).alias("high"), F.when(h == 4, F.col("high")).otherwise(F.col("low")).alias("low"), "close", F.when(h == 5, -F.col("volume")).when(h == 6, 0.0).otherwise(F.col("volume")).alias("volume"))


@query(
    "dq_ohlc_logic",
    f"""WITH {BROKEN} SELECT symbol, 'high_too_low' AS kind, count(*) AS n, min(ts) AS ts FROM broken WHERE high < greatest(open, close) GROUP BY symbol
    UNION ALL SELECT symbol, 'low_too_high', count(*), min(ts) FROM broken WHERE low > least(open, close) GROUP BY symbol
    UNION ALL SELECT symbol, 'negative_volume', count(*), min(ts) FROM broken WHERE volume < 0 GROUP BY symbol""",
)
def dq_ohlc_logic(spark, sf):
    return quality.ohlc_issues(broken(spark, sf))


@query("dq_zero_volume", f"WITH {BROKEN} SELECT symbol, round(avg(CASE WHEN volume = 0 THEN 1.0 ELSE 0 END), {R}) AS share, avg(CASE WHEN volume = 0 THEN 1.0 ELSE 0 END) > 0.01 AS warn FROM broken GROUP BY symbol")
def dq_zero_volume(spark, sf):
    return quality.zero_volume(broken(spark, sf)).withColumn("share", F.round("share", R))


@query("dq_outliers", f"WITH {BARS_1H} SELECT symbol, ts, round(change, {R}) AS change FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS change FROM bars) WHERE abs(change) > 0.5")
def dq_outliers(spark, sf):
    return quality.outliers(bars_1h(spark, sf)).withColumn("change", F.round("change", R))


GAPS = "SELECT symbol, p AS gap_start, ts AS gap_end, CAST(epoch(ts) - epoch(p) AS BIGINT) AS duration_s, CAST(floor((epoch(ts) - epoch(p)) / 3600) - 1 AS BIGINT) AS missing FROM (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars) WHERE epoch(ts) - epoch(p) > 5400"


@query("dq_gaps", f"WITH {BARS_1H} {GAPS} AND isodow(p) NOT IN (5, 6)")
def dq_gaps(spark, sf):
    return quality.gaps(bars_1h(spark, sf), 3600, ignore_weekends=True)


FILLED = """span AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM bars GROUP BY symbol),
filled AS MATERIALIZED (SELECT s.symbol, s.ts, last_value(open IGNORE NULLS) OVER w AS open, last_value(high IGNORE NULLS) OVER w AS high, last_value(low IGNORE NULLS) OVER w AS low, last_value(close IGNORE NULLS) OVER w AS close, coalesce(volume, 0) AS volume, close IS NULL AS added
FROM span s LEFT JOIN bars b ON s.symbol = b.symbol AND s.ts = b.ts WINDOW w AS (PARTITION BY s.symbol ORDER BY s.ts))"""


@query("fill_gaps", f"WITH {BARS_1H}, {FILLED} SELECT * FROM filled")
def fill_gaps(spark, sf):
    return quality.fill_gaps(bars_1h(spark, sf), 3600)


@query(
    "quality_report",
    f"""WITH {BROKEN}, g AS (SELECT symbol, count(*) AS n_gaps, sum(missing)::BIGINT AS missing FROM ({GAPS.replace('FROM bars', 'FROM broken')}) GROUP BY symbol), r AS (
    SELECT symbol, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, round(100 * avg(CASE WHEN high >= greatest(open, close) AND low <= least(open, close) AND volume >= 0 THEN 1.0 ELSE 0 END), {R}) AS valid_pct,
      round(100 * avg(CASE WHEN volume = 0 THEN 1.0 ELSE 0 END), {R}) AS zero_pct, round(100 * count(*) / ((epoch(max(ts)) - epoch(min(ts))) / 3600 + 1), {R}) AS complete_pct FROM broken GROUP BY symbol)
    SELECT r.*, coalesce(n_gaps, 0) AS n_gaps, coalesce(missing, 0) AS missing FROM r LEFT JOIN g USING (symbol)""",
)
def quality_report(spark, sf):
    r = quality.quality_report(broken(spark, sf), 3600)
    return r.withColumns({c: F.round(c, R) for c in ("valid_pct", "zero_pct", "complete_pct")})


@query(
    "issues_sorted",
    f"WITH {BROKEN} SELECT symbol, severity, issue_type, row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 0 ELSE 1 END, symbol, issue_type) AS place FROM (SELECT DISTINCT symbol, 'error' AS severity, 'ohlc' AS issue_type FROM broken WHERE high < greatest(open, close) UNION ALL SELECT DISTINCT symbol, 'warning', 'zero' FROM broken WHERE volume = 0)",
)
def issues_sorted(spark, sf):
    b = broken(spark, sf)
    none = F.lit(None).cast("timestamp").alias("ts")
    x = b.where("high < greatest(open, close)").select("symbol", F.lit("error").alias("severity"), F.lit("ohlc").alias("issue_type"), none)
    y = b.where("volume = 0").select("symbol", F.lit("warning").alias("severity"), F.lit("zero").alias("issue_type"), none)
    rows = x.union(y).distinct()
    errors = rows.agg(F.count_if(F.col("severity") == "error").alias("errors"))  # one row; warnings are numbered after the errors
    inside = F.row_number().over(Window.partitionBy("severity").orderBy("symbol", "issue_type"))
    rows = rows.withColumn("inside", inside).crossJoin(F.broadcast(errors)).withColumn("place", (F.col("inside") + F.when(F.col("severity") == "error", 0).otherwise(F.col("errors"))).cast("long"))
    return quality.by_severity(rows).select("symbol", "severity", "issue_type", "place")


@query("write_contract", f"WITH {BARS_1H} SELECT 'volume' AS refused, count(*) AS n_rows FROM bars")
def write_contract(spark, sf):
    b = bars_1h(spark, sf).select(F.lit("ex").alias("exchange"), "symbol", F.lit("1h").alias("timeframe"), "ts", *OHLCV).withColumn("volume", F.col("volume").cast("int"))
    try:
        store.check_contract(b)
        word = "nothing"
    except ValueError as e:
        word = str(e).split(": ")[1]
    return b.agg(F.lit(word).alias("refused"), F.count("*").alias("n_rows"))


@query("month_bounds_check", "SELECT o_orderkey, o_orderdate AS ts, strftime(o_orderdate - INTERVAL (o_orderkey % 10) DAYS, '%Y-%m') AS period FROM orders WHERE date_trunc('month', o_orderdate) <> date_trunc('month', o_orderdate - INTERVAL (o_orderkey % 10) DAYS)")
def month_bounds_check(spark, sf):
    o = table(spark, sf, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    named = F.expr("date_format(date_sub(to_date(ts), cast(o_orderkey % 10 as int)), 'yyyy-MM')")
    return quality.month_bounds(o.withColumn("period", named)).select("o_orderkey", "ts", "period")


@query(
    "partition_audit",
    "SELECT o_orderpriority AS symbol, p AS period, CAST(min(y) AS INT) AS y0, CAST(max(y) AS INT) AS y1, count(*) AS n_rows, CASE WHEN min(y) < 2000 OR max(y) > 2100 THEN 'year_out_of_range' WHEN min(y) <> CAST(p AS INT) OR max(y) <> CAST(p AS INT) THEN 'year_mismatch' END AS reason FROM (SELECT *, year(o_orderdate) AS y, CAST(year(o_orderdate + INTERVAL (o_orderkey % 3) DAYS) AS VARCHAR) AS p FROM orders) GROUP BY 1, 2",
)
def partition_audit(spark, sf):
    o = table(spark, sf, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp")).withColumn("symbol", F.col("o_orderpriority"))
    return quality.partition_audit(o.withColumn("period", F.expr("cast(year(date_add(to_date(ts), cast(o_orderkey % 3 as int))) as string)")), ["symbol"])


@query(
    "cross_validate",
    f"""WITH {BARS_1H}, b AS (SELECT symbol, date_trunc('day', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2),
    n AS (SELECT event_type AS symbol, date_trunc('day', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)
    SELECT symbol, count(*) AS n_rows, max(abs(b.open - n.open) / n.open * 100) AS open_pct, max(abs(b.high - n.high) / n.high * 100) AS high_pct, max(abs(b.low - n.low) / n.low * 100) AS low_pct, max(abs(b.close - n.close) / n.close * 100) AS close_pct, max(abs(b.volume - n.volume)) AS volume_diff, true AS passed
    FROM b JOIN n USING (symbol, ts) GROUP BY symbol""",
)
def cross_validate(spark, sf):
    ours = bars.resample(bars_1h(spark, sf), "1d").drop("n_base")
    return quality.cross_validate(ours, bars.ticks_to_bars(ticks(spark, sf), "1 day"))


@query("trim_partial_head", f"WITH {BARS_1H} SELECT symbol, ts, close FROM (SELECT *, ceil(epoch(min(ts) OVER (PARTITION BY symbol)) / 14400) * 14400 AS w FROM bars) WHERE epoch(ts) >= w")
def trim_partial_head(spark, sf):
    return quality.trim_partial_head(bars_1h(spark, sf), 14400).select("symbol", "ts", "close")


@query("warmup_trim", f"WITH {BARS_1H} SELECT symbol, ts, close FROM (SELECT *, min(ts) OVER (PARTITION BY symbol) AS f FROM bars) WHERE epoch(ts) >= epoch(f) + 20 * 14400")
def warmup_trim(spark, sf):
    warm = spark.createDataFrame([("1h", 50, 3600), ("4h", 20, 14400)], "timeframe string, n_bars long, seconds long")
    return quality.warmup_trim(bars_1h(spark, sf), warm).select("symbol", "ts", "close")


@query("recent_months", f"WITH {BARS_1D} SELECT symbol, ts, close FROM (SELECT *, max(ts) OVER (PARTITION BY symbol) AS m FROM days) WHERE ts >= CAST(CAST(m AS DATE) - INTERVAL 6 MONTHS AS TIMESTAMP)")
def recent_months(spark, sf):
    return quality.recent_months(bars_1d(spark, sf), 6).select("symbol", "ts", "close")


@query("holdout_split", f"WITH {BARS_1H} SELECT symbol, CASE WHEN epoch(ts) > epoch(max(ts) OVER (PARTITION BY symbol)) - 86400 * 7 THEN 'holdout' ELSE 'train' END AS part, ts FROM bars")
def holdout_split(spark, sf):
    return quality.holdout_split(bars_1h(spark, sf), 7).select("symbol", "part", "ts")


@query("is_oos_split", f"WITH {BARS_1H} SELECT symbol, ts, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts) <= floor(n * 0.7::DOUBLE) THEN 'is' ELSE 'oos' END AS part FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM bars) WHERE floor(n * 0.7::DOUBLE) >= 50 AND n - floor(n * 0.7::DOUBLE) >= 20")
def is_oos_split(spark, sf):
    return quality.is_oos_split(bars_1h(spark, sf)).select("symbol", "ts", "part")


@query("maturity_filter", "SELECT p_brand AS indicator, p_name AS param, coalesce(CASE WHEN s < 5 THEN 'stable' WHEN s < 12 THEN 'beta' END, 'experimental') AS maturity FROM (SELECT DISTINCT p_brand, p_name FROM part) LEFT JOIN (SELECT p_brand AS b, min(CAST(substr(p_brand, 7) AS INT)) AS s FROM part WHERE CAST(substr(p_brand, 7) AS INT) < 12 GROUP BY 1) ON b = p_brand WHERE coalesce(CASE WHEN s < 5 THEN 'stable' WHEN s < 12 THEN 'beta' END, 'experimental') IN ('stable', 'experimental')")
def maturity_filter(spark, sf):
    p = table(spark, sf, "part")
    space = p.select(F.col("p_brand").alias("indicator"), F.col("p_name").alias("param")).distinct()
    number = F.substring("p_brand", 7, 9).cast("int")
    levels = p.where(number < 12).select(F.col("p_brand").alias("indicator"), F.when(number < 5, "stable").otherwise("beta").alias("maturity")).distinct()
    return quality.maturity_filter(space, levels, ["stable", "experimental"])


@query("finalist_gate", "SELECT c_custkey AS candidate_id, abs(c_acctbal) / 10000 AS pbo, c_nationkey AS profitable_folds, c_acctbal / 1000 AS degradation FROM customer WHERE abs(c_acctbal) / 10000 < 0.5 AND c_nationkey >= 3 AND abs(c_acctbal / 1000) < 3")
def finalist_gate(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("candidate_id"), (F.abs("c_acctbal") / 10000).alias("pbo"), F.col("c_nationkey").alias("profitable_folds"), (F.col("c_acctbal") / 1000).alias("degradation"))
    return quality.finalist_gate(c, 0.5, 3)


# --- 2.3

DAY = "day AS MATERIALIZED (SELECT symbol, date_trunc('day', ts) AS ts, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2)"


@query("htf_align", f"WITH {BARS_1H}, {DAY} SELECT b.symbol, b.ts, b.close, d.close AS htf_close FROM bars b ASOF LEFT JOIN (SELECT symbol, ts + INTERVAL 1 DAY AS ts, close FROM day) d ON b.symbol = d.symbol AND b.ts >= d.ts")
def htf_align(spark, sf):
    b = bars_1h(spark, sf)
    return asof.htf_align(b, bars.resample(b, "1d"), "close", 86400).select("symbol", "ts", "close", "htf_close")


MACRO = "m AS MATERIALIZED (SELECT ts, max(value) FILTER (key = '1-URGENT') AS k1, max(value) FILTER (key = '5-LOW') AS k2 FROM slow GROUP BY ts), mm AS MATERIALIZED (SELECT ts, last_value(k1 IGNORE NULLS) OVER (ORDER BY ts) AS k1, last_value(k2 IGNORE NULLS) OVER (ORDER BY ts) AS k2 FROM m)"
KEYS = ["1-URGENT", "5-LOW", "none"]


@query("macro_align", f"WITH {BARS_1D}, {SLOW}, {MACRO} SELECT symbol, days.ts, k1 AS \"1-URGENT\", k2 AS \"5-LOW\", NULL::DOUBLE AS none FROM days ASOF LEFT JOIN mm ON days.ts >= mm.ts")
def macro_align(spark, sf):
    return asof.macro_align_by_symbol(bars_1d(spark, sf), slow_series(spark, sf), KEYS).select("symbol", "ts", *[F.col(f"`{k}`") for k in KEYS])


@query("macro_enrich", f"WITH {BARS_1D}, {SLOW}, {MACRO} SELECT symbol, days.ts, round(k1 / k2, {R}) AS credit_spread FROM days ASOF LEFT JOIN mm ON days.ts >= mm.ts")
def macro_enrich(spark, sf):
    rows = asof.macro_enrich(bars_1d(spark, sf), slow_series(spark, sf), KEYS[:2], F.col("`1-URGENT`"), F.col("`5-LOW`"))
    return rows.select("symbol", "ts", F.round("credit_spread", R).alias("credit_spread"))


FUNDING = "funding AS (SELECT event_type AS symbol, date_trunc('hour', ts) + INTERVAL (CASE WHEN day(ts) % 3 = 0 THEN 7 ELSE 0 END) MINUTES AS ts, avg(value) AS funding_rate FROM events WHERE hour(ts) % 8 = 0 GROUP BY 1, 2)"


def funding(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp")).where(F.hour("t") % 8 == 0)
    off = F.when(F.day("t") % 3 == 0, 7).otherwise(0)
    return e.groupBy(F.col("event_type").alias("symbol"), F.timestamp_seconds(F.unix_seconds(F.date_trunc("hour", "t")) + off * 60).alias("ts")).agg(F.avg("value").alias("funding_rate"))


@query("futures_enrich", f"WITH {BARS_1H}, {FUNDING} SELECT b.symbol, b.ts, round(last_value(funding_rate IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.ts), {R}) AS funding_rate FROM bars b LEFT JOIN funding f ON f.symbol = b.symbol AND f.ts = b.ts")
def futures_enrich(spark, sf):
    return asof.futures_enrich(bars_1h(spark, sf), funding(spark, sf), ["funding_rate"]).select("symbol", "ts", F.round("funding_rate", R).alias("funding_rate"))


@query("reference_join", f"WITH {BARS_1H}, p AS (SELECT * FROM (VALUES ('click', 'view'), ('error', 'click'), ('view', 'nothing')) AS p(symbol, reference)), x AS (SELECT b.symbol, p.reference, b.ts, r.close AS ref_close FROM bars b JOIN p USING (symbol) ASOF LEFT JOIN bars r ON r.symbol = p.reference AND b.ts >= r.ts) SELECT symbol, reference, ts, ref_close FROM x QUALIFY avg(CASE WHEN ref_close IS NULL THEN 1.0 ELSE 0 END) OVER (PARTITION BY symbol, reference) <= 0.5")
def reference_join(spark, sf):
    pairs = spark.createDataFrame([("click", "view"), ("error", "click"), ("view", "nothing")], "symbol string, reference string")
    return asof.reference_join(bars_1h(spark, sf), pairs).select("symbol", "reference", "ts", "ref_close")


@query("forward_asof", f"WITH {BARS_1H}, n AS (SELECT symbol, ts, close, lead(close, 4) OVER (PARTITION BY symbol ORDER BY ts) AS later FROM bars), s AS (SELECT DISTINCT event_type AS symbol, ts FROM events WHERE value > 60) SELECT s.symbol, s.ts, n.ts AS bar_ts, n.close AS entry, n.later AS exit FROM s ASOF LEFT JOIN n ON s.symbol = n.symbol AND s.ts <= n.ts")
def forward_asof(spark, sf):
    s = ticks(spark, sf).where("price > 60").select("symbol", "ts").distinct()
    return asof.forward_asof(s, bars_1h(spark, sf), 4)


PERIODS = [("early", "2024-01-03", "2024-01-09"), ("mid", "2024-01-08", "2024-01-15"), ("late", "2024-01-25", "2024-02-25")]
PERIODS_SQL = "p AS (SELECT name, CAST(a AS TIMESTAMP) AS start, CAST(z AS TIMESTAMP) AS \"end\" FROM (VALUES " + ", ".join(f"('{n}', '{a}', '{z}')" for n, a, z in PERIODS) + ") AS p(name, a, z))"


def periods(spark):
    return spark.createDataFrame(PERIODS, "name string, a string, z string").select("name", F.col("a").cast("timestamp").alias("start"), F.col("z").cast("timestamp").alias("end"))


@query("period_range_join", f"WITH {BARS_1H}, {PERIODS_SQL} SELECT symbol, name, count(*) AS n, max(close) AS top FROM bars JOIN p ON ts >= start AND ts < \"end\" GROUP BY 1, 2")
def period_range_join(spark, sf):
    return asof.period_range_join(bars_1h(spark, sf), periods(spark)).groupBy("symbol", "name").agg(F.count("*").alias("n"), F.max("close").alias("top"))


@query("fold_range_join", f"WITH {BARS_1H}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS t FROM bars), f AS (SELECT i AS fold, i * s AS a, i * s + 200 AS b, i * s + 210 AS c, i * s + 300 AS d FROM (SELECT (max(t) + 1 - 300) // 3 AS s FROM t), range(4) AS r(i)) SELECT symbol, CAST(fold AS INT) AS fold, CASE WHEN t >= c THEN 'oos' ELSE 'is' END AS part, count(*) AS n, round(avg(close), {R}) AS mean FROM t JOIN f ON (t >= a AND t < b) OR (t >= c AND t < d) GROUP BY 1, 2, 3")
def fold_range_join(spark, sf):
    b = bars_1h(spark, sf).withColumn("t", F.row_number().over(quality.W()) - 1)
    folds = overfit.splits(b, 4, 200, 10, 90)
    return asof.fold_range_join(b, folds).groupBy("symbol", "fold", "part").agg(F.count("*").alias("n"), F.round(F.avg("close"), R).alias("mean"))


@query("missing_periods", "SELECT symbol, strftime(m, '%Y-%m') AS period FROM (SELECT o_orderpriority AS symbol, unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS m FROM orders GROUP BY 1) EXCEPT SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') FROM orders WHERE month(o_orderdate) % 5 <> 0")
def missing_periods(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    want = o.groupBy("symbol").agg(F.explode(F.sequence(F.date_trunc("month", F.min("ts")), F.date_trunc("month", F.max("ts")), F.expr("INTERVAL 1 MONTH"))).alias("m"))
    have = o.where(F.month("ts") % 5 != 0).select("symbol", F.date_format("ts", "yyyy-MM").alias("period")).distinct()
    return want.select("symbol", F.date_format("m", "yyyy-MM").alias("period")).join(have, ["symbol", "period"], "left_anti")


@query("study_pending", "SELECT p_partkey AS study FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1)")
def study_pending(spark, sf):
    files = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.concat(F.lit("out/poblacion_"), "l_partkey", F.lit(".json")).alias("path"))
    done = files.select(F.regexp_extract("path", r"_(\d+)\.json$", 1).cast("long").alias("study")).distinct()
    return table(spark, sf, "part").select(F.col("p_partkey").alias("study")).join(done, "study", "left_anti")


# --- 2.4


@query("ticks_to_bars", f"WITH {BARS_1H} SELECT * FROM bars")
def ticks_to_bars(spark, sf):
    return bars_1h(spark, sf)


def _resampled(bucket: str) -> str:
    return f"SELECT symbol, {bucket} AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, count(*) AS n_base FROM bars GROUP BY 1, 2"


BUCKETS = {"4h": "time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '1970-01-01')", "1d": "date_trunc('day', ts)", "1w": "date_trunc('week', ts)::TIMESTAMP", "1M": "date_trunc('month', ts)::TIMESTAMP"}


@query("resample_bars", f"WITH {BARS_1H} {_resampled(BUCKETS['1w'])}")
def resample_bars(spark, sf):
    return bars.resample(bars_1h(spark, sf), "1w")


@query("resample_drop_tail", f"WITH {BARS_1H}, r AS ({_resampled(BUCKETS['4h'])}) SELECT * FROM r QUALIFY ts < max(ts) OVER (PARTITION BY symbol) OR n_base >= 4")
def resample_drop_tail(spark, sf):
    return bars.resample(bars_1h(spark, sf), "4h", drop_tail=True)


@query("resample_all", f"WITH {BARS_1H} " + " UNION ALL ".join(f"SELECT '{k}' AS timeframe, * FROM ({_resampled(v)})" for k, v in BUCKETS.items()))
def resample_all(spark, sf):
    return bars.resample_all(bars_1h(spark, sf), list(BUCKETS))


@query("daily_last", f"WITH {BARS_1D}, s AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM days GROUP BY 1) SELECT s.symbol, CAST(s.ts AS DATE) AS day, last_value(close IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY s.ts) AS last FROM s LEFT JOIN days d ON s.symbol = d.symbol AND s.ts = d.ts")
def daily_last(spark, sf):
    return bars.daily_last(bars_1d(spark, sf))


@query("intersect_ts", f"WITH {BARS_1H} SELECT ts FROM bars WHERE symbol = 'click' INTERSECT SELECT ts FROM bars WHERE symbol = 'error'")
def intersect_ts(spark, sf):
    b = bars_1h(spark, sf)
    return b.where("symbol = 'click'").select("ts").intersect(b.where("symbol = 'error'").select("ts"))


@query("dedup_keep_last", "SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_max(value, event_id) AS price FROM events GROUP BY 1, 2")
def dedup_keep_last(spark, sf):
    rows = ticks(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    return bars.dedup_keep_last(rows, "seq", "symbol", "ts").select("symbol", "ts", "price")


