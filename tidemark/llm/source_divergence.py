"""Source divergence audit: how far the vocabularies of the sources of one language lie apart.

Terms are runs of letters a to z and of characters beyond ASCII. Inside
``mapInArrow`` whole texts go through Arrow compute functions (``ascii_lower``,
``split_pattern_regex``, ``dictionary_encode``, hash ``group_by``), and only
partial counts leave a task. Spark adds them up by (language, term), and the
terms in enough documents are written as columns. They are dealt into shards of
a language's terms; each shard adds its terms' part of every pair of sources, and
its own best terms of each source, so no task sees a whole vocabulary.

All arithmetic is in whole numbers: with ``count`` occurrences of a term among
the N of V kept terms, a group's p is 1 + floor(10**9 * (count + 2) / (N + 2 * V)),
and two of them differ by floor((p - q)**2 / (p + q)).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Staged, prepare

#: A kept term occurs in so many documents of its language.
LEAST_DOCS = 10
SCALE = 1_000_000_000
#: What stands between terms: ASCII other than letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of partial counts that a task holds before it merges, or passes them on.
HELD_ROWS = 400_000
#: Counts in a shard, about, and entries of a dense stretch inside it.
SHARD_ROWS, DENSE = 50_000, 1 << 20


def batch_counts(batch: pa.RecordBatch) -> pa.Table:
    """lang, source, term, n, docs of one batch of (lang, source, text)."""
    lang, source = (pc.dictionary_encode(batch.column(k)) for k in (0, 1))
    lists = pc.split_pattern_regex(pc.ascii_lower(batch.column(2)), pattern=BETWEEN)
    doc, term = pc.list_parent_indices(lists), pc.list_flatten(lists)
    full = pc.not_equal(term, "")
    doc, term = doc.filter(full), pc.dictionary_encode(term.filter(full))
    by_doc = pa.table({"doc": doc, "term": term.indices}).group_by(["doc", "term"]).aggregate([([], "count_all")])
    width = max(1, len(source.dictionary))
    group = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()
    by_doc = by_doc.append_column("group", pa.array(group[by_doc["doc"].to_numpy()]))
    got = by_doc.group_by(["group", "term"]).aggregate([("count_all", "sum"), ("doc", "count")])
    group = got["group"].to_numpy()
    return pa.table({
        "lang": lang.dictionary.take(pa.array(group // width)), "source": source.dictionary.take(pa.array(group % width)),
        "term": term.dictionary.take(got["term"].combine_chunks()), "n": got["count_all_sum"], "docs": got["doc_count"],
    })


def _merged(held: list[pa.Table]) -> pa.Table:
    got = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return got.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(["lang", "source", "term", "n", "docs"])


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for b in batches:
        held.append(batch_counts(b))
        if sum(t.num_rows for t in held) > HELD_ROWS:
            held = [_merged(held)]
            if held[0].num_rows > HELD_ROWS // 2:
                yield from held.pop().to_batches()
    if held:
        yield from _merged(held).to_batches()


def term_counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, term, source, n of every term in at least ``least`` documents of its language, with n_lang and ``first`` (1 in one row of a term)."""
    text = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = text.mapInArrow(partial_counts, "lang string, source string, term string, n long, docs long")
    # one shuffle serves the sums and both windows
    sums = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    sums = sums.select("lang", "term", "source", "n", F.sum("docs").over(whole).alias("docs"), F.sum("n").over(whole).alias("n_lang"), F.row_number().over(whole.orderBy("source")).alias("k"))
    return sums.where(F.col("docs") >= least).select("lang", "term", "source", "n", "n_lang", (F.col("k") == 1).cast("long").alias("first"))


def scaled(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), exact in 64 bits for totals up to 2 * 10**14: SCALE is taken in two factors."""
    whole, rest = np.divmod((count + 2) * 31_250, total)
    return 1 + whole * 32_000 + rest * 32_000 // total


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def shard_parts(key: tuple, counts: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """One shard's share: (source, item) sums of pairs with source < item, and its ``top`` best terms of each source."""
    groups = groups.sort_by("source")
    sources, n = groups["source"].combine_chunks(), groups["n_group"].to_numpy()
    size, total, n_lang = len(sources), n + 2 * groups["n_kept"].to_numpy(), groups["n_lang"].to_numpy()
    counts = counts.append_column("code", pc.dictionary_encode(counts["term"].combine_chunks()).indices).sort_by("code")
    code, of, seen = counts["code"].to_numpy(), pc.index_in(counts["source"].combine_chunks(), value_set=sources).to_numpy(), counts["n"].to_numpy()
    sums, step, n_terms = np.zeros((size, size), np.int64), max(1, DENSE // max(size, 1)), int(code[-1]) + 1 if len(code) else 0
    for at in range(0, n_terms, step):
        i, j = np.searchsorted(code, (at, at + step))
        dense = np.zeros((min(step, n_terms - at), size), np.int64)
        dense[code[i:j] - at, of[i:j]] = seen[i:j]
        p = scaled(dense, total)
        for a in range(size - 1):
            sums[a, a + 1 :] += distance(p[:, a : a + 1], p[:, a + 1 :]).sum(axis=0)
    a, b = np.triu_indices(size, 1)
    parts = [("pair", sources.take(pa.array(a)), sources.take(pa.array(b)), sums[a, b])]
    if n_terms:
        whole = int(n_lang[0]) + 2 * int(groups["n_kept"][0].as_py())
        p, q = scaled(seen, total[of]), scaled(counts["n_lang"].to_numpy(), np.int64(whole))
        own = pa.table({"of": of, "term": counts["term"], "value": distance(p, q)}).filter(pa.array(p > q))
        own = own.sort_by([("of", "ascending"), ("value", "descending"), ("term", "ascending")])
        of = own["of"].to_numpy()
        own = own.filter(pa.array(np.arange(len(of)) - np.searchsorted(of, of) < top))
        parts.append(("term", sources.take(own["of"].combine_chunks()), own["term"].combine_chunks(), own["value"].to_numpy()))
    lang = key[0].as_py()
    return pa.concat_tables([pa.table({"lang": pa.array([lang] * len(v), pa.string()), "part": pa.array([part] * len(v), pa.string()), "source": s, "item": i, "value": pa.array(v, pa.int64())}) for part, s, i, v in parts])


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (lang, source, text).

    ``pair``: every other source of the language, with the distances of all kept terms summed; ``term``: the ``top``
    terms that the source has more of than its language. Ranks begin at 1, larger values first, then items by bytes.

    Null lang, source or text count as ''. Every group that occurs has its pairs, also one without text or kept
    terms (0 where the language keeps none); a language with one source has none, nor terms. Rows that repeat count each.
    An empty table gives no rows; other columns aren't read.
    """
    prepare(docs.sparkSession)
    stage = Staged("divergence")
    kept = stage(term_counts(docs, least), "kept")
    shards = max(1, -(-kept.count() // SHARD_ROWS))
    # sums by group: as many rows as the result has sources
    held = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum("first").alias("n_kept"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(held, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n_group", "n_lang", "n_kept"])
    groups = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    kept = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"), "term", "source", "n", "n_lang")
    both = kept.groupBy("lang", "shard").cogroup(groups.groupBy("lang", "shard"))
    parts = both.applyInArrow(lambda key, a, b: shard_parts(key, a, b, top), "lang string, part string, source string, item string, value long")
    parts = stage(parts, "parts")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.union(pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    terms = parts.where("part = 'term'").select("lang", "source", "part", "item", "value", rank).where(F.col("rank") <= top)
    return stage.last(pairs.select("lang", "source", "part", "item", "value", rank).union(terms), "ranked")
