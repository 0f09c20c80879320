"""Benchmark decontamination by template canonicalisation, in DataFrame operations alone.

Numbers, names and units become typed placeholders, so a question with other
numbers or names has the same template. A capital after a lower-case word is a
name; one that opens a text, sentence or line, or follows another capital, may be
a name or a plain word, so every text has two templates, one for each reading.
Windows of ``WINDOW`` template words are hash-joined with those of the benchmark. Where a document holds ``COVER`` of an
item's windows, the slots decide: along one alignment each value of the item has
to stand against one value in the document, as it does when a question was
re-parameterised and doesn't when unlike sentences share a template.

Items without a window that can be told from chance, as they are short or almost
all placeholders, are searched word for word instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, prepare

WINDOW, COVER = 8, 0.5
#: Plain words that a benchmark window must have: placeholders alone prove nothing.
PLAIN = 4
#: Benchmark windows up to which their table is broadcast (about 100 MB); a larger one is shuffled.
BROADCAST_WINDOWS = 500_000
#: Unit words that may follow a number.
UNITS = (
    "km", "cm", "mm", "m", "kg", "g", "mg", "lb", "oz", "l", "ml", "s", "ms", "min", "h", "hz", "w", "kw",
    "hours?", "minutes?", "seconds?", "days?", "weeks?", "months?", "years?", "miles?", "meters?", "metres?",
    "dollars?", "euros?", "cents?", "usd", "eur", "percent", "degrees?", "%",
)

_STEPS = (
    (r"(\p{Nd})[.,](\p{Nd})", "$1$2"),  # 1,000 and 2.5 are one number each
    (r"(\p{Nd}+)", "§n$1"),
    (r"(§n\p{Nd}+) ?(" + "|".join(UNITS) + r")([^\p{L}\p{N}]|$)", "$1 §u$2$3"),
    (r"(?<=[\p{Ll},;] )(\p{Lu}\p{L}+)", "§a$1"),  # capitals inside a sentence
    (r"(?<![\p{L}\p{N}§])(\p{Lu}\p{L}+)", "§s$1"),  # other capitals: name or plain word
)


def tagged(text: Column) -> Column:
    """Lower-case words with one blank between; slot words begin with § and a letter for their type, words that may be a name with §s."""
    for pattern, to in _STEPS:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}§%]+", " "))


def template(tagged_text: Column) -> Column:
    """Tagged words without the values of their slots."""
    return F.regexp_replace(tagged_text, r"§([nua])[\p{L}\p{N}%]*", "§$1")


def windows(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` for every window of the text: tagged__ (all words), at__ (first word from 1), hash__.

    Texts of fewer than ``WINDOW`` words, null ones too, have none.
    """
    rows = rows.withColumn("tagged__", tagged(F.col(text).cast("string"))).drop(text)
    readings = F.array(F.regexp_replace("tagged__", "§s", ""), F.regexp_replace("tagged__", "§s", "§a"))
    rows = rows.select(*[c for c in rows.columns if c != "tagged__"], F.posexplode(readings).alias("kind__", "tagged__"))
    rows = rows.withColumn("words__", F.split(template(F.col("tagged__")), " "))
    n = F.size("words__")
    rows = rows.select("*", F.explode(F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1)))).alias("at__"))
    return rows.withColumn("hash__", F.xxhash64("kind__", F.slice("words__", F.col("at__"), F.lit(WINDOW))))


def _plain_words(text: str) -> Column:
    return F.split(F.regexp_replace(tagged(F.col(text).cast("string")), "§[nuas]", ""), " ")


def _word_for_word(docs: DataFrame, items: DataFrame, text: str, small: bool) -> DataFrame:
    """(key__, item__, n_matched, n_windows, n_slots) of texts that hold all words of an item in a row.

    An item of fewer than ``PLAIN`` words has to be the whole text.
    """
    items = items.select("item__", "item_words__", "n_slots", F.size("item_words__").alias("item_n__"), F.least(F.size("item_words__"), F.lit(WINDOW)).alias("probe__"))
    items = items.withColumn("item_hash__", F.xxhash64(F.slice("item_words__", F.lit(1), F.col("probe__"))))
    lengths = [r[0] for r in items.select("probe__").distinct().collect()]  # WINDOW at most
    whole = docs.select("key__", "text__", _plain_words(text).alias("words__")).withColumn("n__", F.size("words__"))
    rows = whole.withColumn("probe_n__", F.explode(F.array(*map(F.lit, lengths))))
    rows = rows.select("*", F.explode(F.when(F.col("n__") >= F.col("probe_n__"), F.sequence(F.lit(1), F.when(F.col("probe_n__") < PLAIN, F.lit(1)).otherwise(F.col("n__") - F.col("probe_n__") + 1)))).alias("at__"))
    rows = rows.withColumn("hash__", F.xxhash64(F.slice("words__", F.col("at__"), F.col("probe_n__"))))
    same = (F.col("hash__") == F.col("item_hash__")) & (F.col("probe_n__") == F.col("probe__"))
    if small:
        met = rows.join(F.broadcast(items), same)
    else:  # places alone are shuffled, and the texts of those that met
        met = rows.select("text__", "at__", "probe_n__", "hash__").distinct().join(items, same).join(whole, "text__")
    met = met.where((F.slice("words__", F.col("at__"), F.col("item_n__")) == F.col("item_words__")) & ((F.col("item_n__") >= PLAIN) | (F.col("item_n__") == F.col("n__"))))
    return met.groupBy("key__", "text__", "item__").agg(F.lit(1).alias("n_matched"), F.max("n_slots").alias("n_slots"), F.lit(1).alias("n_windows"))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """Pairs of a document and a benchmark item it holds: key, item, n_matched, n_windows, n_slots.

    n_matched counts the item's windows found along alignments whose slots are
    consistent; at least ``COVER`` of n_windows are. n_slots counts the item's
    slot values met. An item without a window of ``PLAIN`` plain words matches
    texts that hold all its words in a row and has n_windows 1; if it has fewer
    than ``PLAIN`` words it has to be the whole text. Null and blank texts match nothing; rows that repeat a key with other texts
    are looked at apart and give one pair. Other columns are not read.
    """
    texts, short = _texts(docs, benchmark, key, text, item)
    both = texts.groupBy("key__", "item__", "n_windows").agg(F.max("n_matched").alias("n_matched"), F.max("n_slots").alias("n_slots")).where(F.col("n_matched") >= COVER * F.col("n_windows"))
    if short:
        both = both.groupBy("key__", "item__").agg(*[F.max_by(c, F.struct("n_windows", "n_matched")).alias(c) for c in ("n_matched", "n_windows", "n_slots")])
    return both.select(F.col("key__").alias(key), F.col("item__").alias(item), F.col("n_matched").cast("long"), F.col("n_windows").cast("long"), F.col("n_slots").cast("long"))


def _texts(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str) -> tuple[DataFrame, int]:
    """(key__, text__, item__, n_matched, n_slots, n_windows) of each text that meets an item's windows, however few, or holds a short item; and the number of short items."""
    prepare(docs.sparkSession)
    items = benchmark.select(F.col(item).alias("item__"), F.xxhash64(text).alias("item_text__"), F.col(text))
    own = windows(items, text)
    own = own.where(F.size(F.filter(F.slice("words__", F.col("at__"), F.lit(WINDOW)), lambda w: ~w.startswith("§"))) >= PLAIN)
    own = own.select("item__", "item_text__", F.col("hash__").alias("item_hash__"), F.col("at__").alias("item_at__"), F.col("kind__").alias("item_kind__"), F.slice(F.split("tagged__", " "), F.col("at__"), F.lit(WINDOW)).alias("item_words__"))
    rest = items.join(own.select("item_text__").distinct(), "item_text__", "left_anti").where(F.length(tagged(F.col(text).cast("string"))) > 0)
    slots = F.size(F.array_distinct(F.filter(F.split(tagged(F.col(text).cast("string")), " "), lambda w: w.rlike("^§[nua]"))))
    rest = rest.select("item__", _plain_words(text).alias("item_words__"), slots.alias("n_slots"))
    total = own.groupBy("item__").agg(F.countDistinct("item_at__").alias("n_windows"))
    own = own.drop("item_text__")
    rows = docs.select(F.col(key).alias("key__"), F.xxhash64(text).alias("text__"), F.col(text))
    own_rows, there = windows(rows, text), F.slice(F.split("tagged__", " "), F.col("at__"), F.lit(WINDOW))
    if own.count() <= BROADCAST_WINDOWS:
        own, total = F.broadcast(own), F.broadcast(total)
    else:  # what is shuffled is a window's own words, not the text that it comes from
        own_rows, there = own_rows.select("key__", "text__", "kind__", "at__", "hash__", there.alias("there__")), F.col("there__")
    met = own_rows.join(own, F.col("hash__") == F.col("item_hash__"))
    pairs = F.filter(F.arrays_zip(F.col("item_words__").alias("a"), there.alias("b")), lambda x: x["a"].startswith("§"))
    met = met.select("key__", "text__", "item__", "kind__", (F.col("at__") - F.col("item_at__")).alias("shift__"), "item_at__", pairs.alias("pairs__"))
    # the sets are bounded by an item's length: one alignment meets each of its places once
    lines = met.groupBy("key__", "text__", "item__", "kind__", "shift__").agg(F.collect_set("item_at__").alias("at"), F.array_distinct(F.flatten(F.collect_set("pairs__"))).alias("pairs"))
    slots = F.array_distinct(F.transform("pairs", lambda x: x["a"]))
    lines = lines.where(F.size(slots) == F.size("pairs")).select("key__", "item__", "text__", "at", slots.alias("slots"))
    texts = lines.groupBy("key__", "text__", "item__").agg(F.size(F.array_distinct(F.flatten(F.collect_set("at")))).alias("n"), F.size(F.array_distinct(F.flatten(F.collect_set("slots")))).alias("s"))
    texts = texts.select("key__", "text__", "item__", F.col("n").alias("n_matched"), F.col("s").alias("n_slots")).join(total, "item__")
    if (n := rest.count()):
        texts = texts.unionByName(_word_for_word(rows, rest, text, n <= BROADCAST_WINDOWS))
    return texts, n


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item.

    Rows are told apart by key, null or not, and text: of rows that repeat a key those with clean texts stay.
    Null and blank texts stay, rows that repeat go or stay together, other columns pass; an empty table stays empty.
    """
    texts, _ = _texts(docs, benchmark, key, text, item)
    bad_key, bad_text = free_name(docs, "key"), free_name(docs, "row")
    bad = texts.where(F.col("n_matched") >= COVER * F.col("n_windows")).select(F.col("key__").alias(bad_key), F.col("text__").alias(bad_text)).distinct()
    return docs.join(bad, F.col(key).eqNullSafe(F.col(bad_key)) & (F.xxhash64(text) == F.col(bad_text)), "left_anti")
