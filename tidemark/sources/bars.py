"""Bar storage, file scans and sinks.

Bars lie in ``exchange/symbol/timeframe/period`` folders as zstd Parquet, sorted
by time, so that partition and row-group statistics prune date ranges.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import clean_locale_number
from tidemark.functions.timeframes import is_intraday
from tidemark.operators.bars import dedup_keep_last

OHLCV = ("open", "high", "low", "close", "volume")
KEYS = ("exchange", "symbol", "timeframe")
SCHEMA = "exchange string, symbol string, timeframe string, period string, ts timestamp, open double, high double, low double, close double, volume double"


def check_contract(bars: DataFrame) -> DataFrame:
    """Refuse bars whose columns or types aren't those of the store."""
    kinds = dict(bars.dtypes)
    wrong = [c for c in OHLCV if kinds.get(c) != "double"] + [c for c in ("ts",) if kinds.get(c) != "timestamp"] + [c for c in KEYS if kinds.get(c) != "string"]
    if wrong:
        raise ValueError(f"missing or wrongly typed columns: {', '.join(wrong)}")
    return bars


def period(ts: Column, timeframe: Column) -> Column:
    return F.when(is_intraday(timeframe), F.date_format(ts, "yyyy-MM")).otherwise(F.date_format(ts, "yyyy"))


def write_bars(bars: DataFrame, path: str, arrival: str | None = None) -> None:
    """Write bars; only the periods they touch are replaced. Of equal (series, ts) the last arrival stays."""
    rows = check_contract(bars)
    if arrival:
        rows = dedup_keep_last(rows, arrival, *KEYS, "ts").drop(arrival)
    rows = rows.withColumn("period", period(F.col("ts"), F.col("timeframe")))
    rows = rows.select(*KEYS, "period", "ts", *OHLCV).repartition(*KEYS, "period").sortWithinPartitions(*KEYS, "period", "ts")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*KEYS, "period").parquet(path)


def read_bars(spark: SparkSession, path: str, exchange: str, symbol: str | None, timeframe: str, start: str | None = None, end: str | None = None, columns: tuple = OHLCV) -> DataFrame:
    """One dataset (or all symbols), optional columns and inclusive dates; the filters prune folders and row groups.

    Of bars with equal time the one written last stays (the newest file's, then its last row). No bar in the range is an error.
    """
    meta = {"when__": "file_modification_time", "file__": "file_path", "row__": "row_index"}
    rows = spark.read.schema(SCHEMA).parquet(path).where((F.col("exchange") == exchange) & (F.col("timeframe") == timeframe))
    if symbol:
        rows = rows.where(F.col("symbol") == symbol)
    if start:
        rows = rows.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("period") >= start[:4]))
    if end:
        rows = rows.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    rows = rows.select("symbol", "ts", *columns, *[F.col(f"_metadata.{x}").alias(n) for n, x in meta.items()])
    if rows.isEmpty():
        raise ValueError(f"no bars of {exchange} {symbol or ''} {timeframe} from {start} to {end}")
    return dedup_keep_last(rows.withColumn("arrival__", F.struct(*meta)), "arrival__", "symbol", "ts").select("symbol", "ts", *columns)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Per dataset: first and last bar, rows, files, megabytes, and the folder it lies in."""
    file = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    rows = spark.read.schema(SCHEMA).parquet(path).select(*KEYS, "ts", file.alias("f"))
    per = rows.groupBy(*KEYS, "f").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_rows"))
    source = F.regexp_replace(F.min("f.path"), r"/period=[^/]*/[^/]*$", "")
    return per.groupBy(*KEYS).agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_files"), (F.sum("f.size") / 1e6).alias("mb"), source.alias("source"))


def epoch_normalise(raw: Column) -> Column:
    """Timestamp from a number in milliseconds, microseconds or nanoseconds, told by its size, row by row."""
    micros = F.when(raw >= 10**18, F.call_function("div", raw, F.lit(1000))).when(raw >= 10**15, raw).otherwise(raw * 1000)
    return F.timestamp_micros(micros.cast("long"))


#: The twelve columns of a kline file, which has no header.
KLINE = ("open_time", *OHLCV, "close_time", "quote_volume", "trades", "buy_base", "buy_quote", "ignore")


def read_klines(spark: SparkSession, path: str) -> DataFrame:
    """Kline files of a folder, plain (``.csv``, or compressed as Spark reads it) and in ``.zip`` archives, to ts and OHLCV."""
    schema = ", ".join(f"{n} {'long' if n in ('open_time', 'close_time', 'trades') else 'double'}" for n in KLINE)
    plain = spark.read.schema(schema).csv(path).where(~F.lower("_metadata.file_name").endswith(".zip"))
    plain = plain.select(epoch_normalise(F.col("open_time")).alias("ts"), *OHLCV)
    return plain.unionByName(klines_of_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.{zip,ZIP}").load(path)))


def klines_of_archives(files: DataFrame) -> DataFrame:
    """Bars in ``.zip`` archives (path, content), the rows of ``binaryFile``: the first ``.csv`` member of each, read as a stream.

    An archive without such a member is an error that names it; an empty member and a null content give no rows. A task holds
    one archive's bytes and ``ROWS`` unpacked rows.
    """
    names = ["open_time", *OHLCV]

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                if content is None:
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    members = [m for m in archive.namelist() if m.lower().endswith(".csv")]
                    if not members:
                        raise ValueError(f"no csv in {path}")
                    if archive.getinfo(members[0]).file_size == 0:
                        continue
                    kinds = {"open_time": "int64"} | dict.fromkeys(OHLCV, "float64")
                    with archive.open(members[0]) as stream:
                        yield from pd.read_csv(stream, header=None, names=list(KLINE), usecols=names, dtype=kinds, chunksize=ROWS, float_precision="round_trip")

    rows = files.select("path", "content").mapInPandas(unpack, "open_time long, " + ", ".join(f"{c} double" for c in OHLCV))
    return rows.select(epoch_normalise(F.col("open_time")).alias("ts"), *OHLCV)


#: Unpacked rows that a task holds at once.
ROWS = 65_536


def parse_json_bars(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """Lists of [ms, open, high, low, close, volume] in JSON to bars; of equal times the last in the list stays."""
    lists = rows.select(*keys, F.posexplode(F.from_json(column, "array<array<double>>")).alias("n", "x"))
    bars = lists.select(*keys, "n", F.timestamp_millis(F.col("x")[0].cast("long")).alias("ts"), *[F.col("x")[i + 1].alias(c) for i, c in enumerate(OHLCV)])
    return dedup_keep_last(bars, "n", *keys, "ts").drop("n")


def flatten_barset(rows: DataFrame, zone: str = "UTC") -> DataFrame:
    """Multi-symbol rows in a local time zone to UTC bars, one for each (symbol, ts), the last arrival."""
    return dedup_keep_last(rows.withColumn("ts", F.to_utc_timestamp("ts", zone)), "arrival", "symbol", "ts").select("symbol", "ts", *OHLCV)


def best_evidence(cards: DataFrame, max_pbo: float) -> DataFrame:
    """Strategy cards below an overfitting probability; the best for each (symbol, timeframe, archetype, direction)."""
    keys = ["symbol", "timeframe", "archetype", "direction"]
    w = Window.partitionBy(*keys).orderBy("pbo", "candidate_id")
    rows = cards.where(F.col("pbo") < max_pbo).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return rows.withColumn("label", F.concat_ws("_", *keys))


#: Where the columns of a result come from, in the order in which later ones replace earlier ones of the same name.
SECTIONS = ("combination.indicators", "combination.riskManagement", "combination.requires", "result")


def flatten_results(files: DataFrame, column: str = "json") -> DataFrame:
    """Nested {id: {name, combination, result}} JSON to one row for each combination: id, name, a column for every key of ``SECTIONS``.

    Keys aren't known beforehand. A column's type is what its values have in common: boolean, bigint, double or decimal, else
    string; texts of ``result`` are numbers in a locale's form, null if none. A missing key and a JSON null are null. The last section
    that has a key counts, and it replaces ``id`` and ``name`` too. Files that aren't JSON objects give no rows. One pass finds
    keys and types (one row a key comes to the driver), a second one fills the columns, sections and keys in order.
    """
    part = "map<string,variant>"
    kind = f"map<string,struct<name:string,combination:struct<indicators:{part},riskManagement:{part},requires:{part}>,result:{part}>>"
    rows = files.select(F.explode(F.from_json(column, kind)).alias("id", "v"))
    found = F.array(*[F.coalesce(F.map_entries(f"v.{s}"), F.array().cast("array<struct<key:string,value:variant>>")) for s in SECTIONS])
    entries = F.flatten(F.transform(found, lambda es, i: F.transform(es, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("section")))))
    keys = rows.select(F.explode(entries).alias("e")).select("e.*").groupBy("key")
    keys = keys.agg(F.min("section").alias("first"), F.max("section").alias("last"), F.schema_of_variant_agg("value").alias("kind")).collect()

    def value(r):
        held = [F.try_element_at(F.col(f"v.{s}"), F.lit(r["key"])) for s in SECTIONS]
        number = clean_locale_number(F.try_variant_get(held[-1], "$", "string"))
        if r["first"] == r["last"] == len(SECTIONS) - 1:
            return F.when(F.schema_of_variant(held[-1]) == "STRING", number).otherwise(F.try_variant_get(held[-1], "$", "double"))
        if r["last"] == len(SECTIONS) - 1:  # a number where the result has the key, the other sections' value elsewhere
            other = [F.try_variant_get(h, "$", "string") for h in held[-2::-1]]
            return F.coalesce(number.cast("string"), *other)
        plain = r["kind"].lower() if r["kind"].split("(")[0] in ("BOOLEAN", "BIGINT", "DOUBLE", "DECIMAL") else "string"
        return F.coalesce(*[F.try_variant_get(h, "$", plain) for h in held[-2::-1]])

    made = {"id": F.col("id"), "name": F.col("v.name")}
    made |= {r["key"]: value(r) for r in sorted(keys, key=lambda r: (r["first"], r["key"]))}
    return rows.select(*[c.alias(n) for n, c in made.items()])


def append_chunks(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("chunk_id").parquet(path)


def pending_chunks(spark: SparkSession, all_chunks: DataFrame, path: str) -> DataFrame:
    """Chunks that have no result yet."""
    return all_chunks.join(spark.read.parquet(path).select("chunk_id").distinct(), "chunk_id", "left_anti")


def scan_trials(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Trial files of several schemas, needed columns only."""
    return spark.read.option("mergeSchema", "true").parquet(path).select(*columns)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", "true").csv(path)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
