"""String, map and JSON column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quote currencies that end a pair's symbol.
QUOTES = ("USDT", "BUSD", "USDC", "TUSD", "BTC", "ETH", "BNB")


def split_symbol(c: Column) -> Column:
    """BTCUSDT to BTC/USDT; null if no known quote ends it."""
    pattern = rf"^(.+?)({'|'.join(QUOTES)})$"
    return F.when(c.rlike(pattern), F.regexp_replace(c, pattern, "$1/$2"))


def clean_locale_number(c: Column) -> Column:
    """Number in text with a Unicode minus, unit suffix, dots for thousands and a decimal comma; null if none."""
    x = F.regexp_replace(F.regexp_replace(c, "[−–]", "-"), r"[^0-9,.\-]", "")
    return F.regexp_replace(F.regexp_replace(x, r"\.", ""), ",", ".").try_cast("double")


def params_flatten(c: Column) -> Column:
    """Map of maps to one map with ``outer__inner`` names."""
    pairs = F.flatten(F.transform(F.map_entries(c), lambda o: F.transform(F.map_entries(o["value"]), lambda i: F.struct(F.concat_ws("__", o["key"], i["key"]).alias("key"), i["value"].alias("value")))))
    return F.map_from_entries(pairs)


def params_nest(c: Column) -> Column:
    """The inverse of ``params_flatten``, as sorted arrays of (outer, inner, value)."""
    return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(F.split(e["key"], "__")[0].alias("outer"), F.split(e["key"], "__")[1].alias("inner"), e["value"].alias("value"))))


def parse_study_name(c: Column) -> Column:
    """SYMBOL_tf_archetype_with_words_direction to a struct."""
    p = F.split(c, "_")
    return F.struct(p[0].alias("symbol"), p[1].alias("timeframe"), F.array_join(F.slice(p, 3, F.size(p) - 3), "_").alias("archetype"), F.element_at(p, -1).alias("direction"))


def run_id(params: Column) -> Column:
    """16 hex digits that depend on a map's entries, not on their order."""
    entries = F.array_sort(F.map_entries(params))
    text = F.concat_ws(",", F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])))
    return F.substring(F.sha2(text, 256), 1, 16)


def numbers_to_strings(c: Column) -> Column:
    return F.transform_values(c, lambda _, v: v.cast("string"))
