"""Repeated passages by a sparse suffix array.

Suffixes start at minimisers: in every ``LEAST - GRAM + 1`` consecutive word
ten-grams the first one of least hash is retained, so each stretch of ``LEAST``
words has one suffix, its own minimiser, and equal stretches have it at the same
place. Suffixes of ten-grams that occur once are left out; the rest are grouped
by their ten-gram.

Two suffixes share ``LEAST`` words or more if for some split they agree in the
words before and the words after. A suffix carries a hash of each split that is
its own (one for every stretch whose minimiser it is, 41 at most), and all rows
with an equal hash meet, whatever sorts between them. Of each stretch the
occurrence of the smallest key is kept, all others are repeats; stretches that
follow each other make up longer passages.

Stretches of a ten-gram with more than about ``PART`` occurrences are grouped by
their own hash instead, first in parts of about ``SLICE`` rows and then across
parts. That gives the same repeats, no group grows with the ten-gram, and small
parts spread a very frequent passage evenly over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Staged, free_name, prepare
from tidemark.llm.words import grams, word_hashes, word_spans

GRAM, LEAST, PART, SLICE = 10, 50, 4000, 32
_SPAN = LEAST - GRAM + 1


def minimisers(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a text, the minimiser of each stretch of ``LEAST`` words, places of retained suffixes and their ten-grams' hashes."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))[0]
    if len(words) < LEAST:
        return words, *[np.zeros(0, np.int64)] * 3
    h = grams(words, GRAM)
    view = np.lib.stride_tricks.sliding_window_view(h, _SPAN)
    own = view.argmin(axis=1) + np.arange(len(view))  # never falls, so a suffix's stretches lie side by side
    at = np.unique(own)
    return words, own, at, h[at].astype(np.int64)


def _anchors(docs: DataFrame) -> DataFrame:
    """(anchor, node, pos) of every text; equal texts once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            parts = []
            for node, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if node not in seen:
                    seen.add(node)
                    _, _, at, anchor = minimisers(t)
                    parts.append(np.stack([anchor, np.full(len(at), node, np.int64), at]))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(parts, axis=1)], names=["anchor", "node", "pos"])

    return docs.select("node", "text").mapInArrow(run, "anchor long, node long, pos long")


def _suffixes(rows: DataFrame) -> DataFrame:
    """(anchor, part, k, node, begin, hashes) from (node, k, text, places: array of (pos, part)): hashes of the suffix's stretches, from begin on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for node, k, t, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words, own, at, anchor = minimisers(t)
                hashes = grams(words, LEAST).astype("<u8")
                first, last = np.searchsorted(own, at), np.searchsorted(own, at, "right")
                where = {int(x): i for i, x in enumerate(at)}
                for p in places:
                    i = where[p["pos"]]
                    out.append((int(anchor[i]), p["part"], k, node, int(first[i]), hashes[first[i] : last[i]].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["anchor", "part", "k", "node", "begin", "hashes"])

    return rows.select("node", "k", "text", "places").mapInArrow(run, "anchor long, part int, k long, node long, begin long, hashes binary")


def resolve(keys: list[tuple], hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each stretch of each row: its row, its place in the row, a row of the text that keeps it, and whether that is another text.

    ``keys`` hold (key is null, key, node); the least of those that share a
    stretch keeps it, also where it comes again inside the same text.
    """
    size = np.array([len(h) for h in hashes])
    flat = np.concatenate(hashes)
    row = np.repeat(np.arange(len(keys)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    texts = {x: i for i, x in enumerate(sorted(set(keys)))}
    rank = np.array([texts[x] for x in keys])
    order = np.lexsort((rank[row], flat))
    sorted_ = flat[order]
    new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    least = row[order][new]
    kept = np.empty(len(flat), np.int64)
    kept[order] = least[np.cumsum(new) - 1]
    one = np.empty(len(texts), np.int64)
    one[rank] = np.arange(len(rank))  # one row for each text
    kept = one[rank[kept]]
    return row, place, kept, rank[row] != rank[kept]


def _compare(suffixes: DataFrame) -> DataFrame:
    """Compare the suffixes of each ten-gram.

    Rows are repeats, with to_k, to_node and the words from begin to end; where
    ``hot`` they are all stretches, for a later comparison, with these null and their hash.
    """
    schema = "anchor long, k long, node long, begin long, end long, to_k long, to_node long, part long, hash long"
    arrow = pa.schema([(c.split()[0], pa.int64()) for c in schema.split(", ")])
    parts = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = suffixes.repartition(parts, "anchor", "part").sortWithinPartitions("anchor", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(rows):
            k, node, begin = ([r[i] for r in rows] for i in (2, 3, 4))
            keys = [(x is None, -1 if x is None else x, y) for x, y in zip(k, node, strict=True)]
            hashes = [np.frombuffer(r[5], "<u8") for r in rows]
            row, place, kept, repeat = resolve(keys, hashes)
            texts = np.array(node)
            null = np.array([x[0] for x in keys])
            number = np.array([x[1] for x in keys])
            start = np.array(begin)[row] + place
            anchor = np.array([r[0] for r in rows])
            where = lambda i: [pa.array(number[i], pa.int64(), mask=null[i]), pa.array(texts[i], pa.int64())]
            put = lambda at, end, to, more: pa.RecordBatch.from_arrays([pa.array(anchor[row[at]], pa.int64()), *where(row[at]), pa.array(start[at], pa.int64()), pa.array(start[end] + LEAST, pa.int64()), *to, *more], schema=arrow)
            hot = np.array([r[6] for r in rows], bool)[row]
            at = np.flatnonzero(repeat & ~hot)
            if len(at):  # stretches side by side with the same keeper are one span
                edge = np.flatnonzero((np.diff(row[at]) != 0) | (np.diff(kept[at]) != 0) | (np.diff(start[at]) != 1))
                first, last = at[np.concatenate(([0], edge + 1))], at[np.concatenate((edge, [len(at) - 1]))]
                yield put(first, last, where(kept[first]), [pa.nulls(len(first), pa.int64())] * 2)
            at = np.flatnonzero(hot)
            if len(at):
                yield put(at, at, [pa.nulls(len(at), pa.int64())] * 2, [pa.array(np.array([r[1] for r in rows])[row[at]], pa.int64()), pa.array(np.concatenate(hashes)[at].view("<i8"), pa.int64())])

        for b in batches:
            new = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            if not new:
                continue
            held += new
            last = held[-1][:2]
            cut = len(held)
            while cut and held[cut - 1][:2] == last:
                cut -= 1
            if cut:
                yield from flush(held[:cut])
                held = held[cut:]
        if held:
            yield from flush(held)

    return rows.select("anchor", "part", "k", "node", "begin", "hashes", "hot").mapInArrow(run, schema)


def _kept_elsewhere(rows: DataFrame, best: DataFrame) -> DataFrame:
    """Spans of ``rows``, single stretches, that other texts keep by ``best``; both in parts of a ten-gram of bounded size.

    A task streams over parts, each part's ``best`` first, and holds those of one part and one batch.
    """
    schema = "k long, node long, begin long, end long, to_k long, to_node long"
    arrow = pa.schema([(c.split()[0], pa.int64()) for c in schema.split(", ")])
    by = ("anchor", "part")
    null = lambda *names: [F.lit(None).cast("long").alias(n) for n in names]
    both = best.select(*by, F.lit(0).alias("side"), "hash", *null("k", "node", "begin"), "to_k", "to_node").union(rows.select(*by, F.lit(1).alias("side"), "hash", "k", "node", "begin", *null("to_k", "to_node")))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(parts, *by).sortWithinPartitions(*by, "side", "node", "begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            both = pa.Table.from_batches([b])
            top = both["side"].to_numpy() == 0
            known, own = both.filter(pa.array(top)), both.filter(pa.array(~top))
            if held is not None:
                known = pa.concat_tables([held, known])
            if known.num_rows and own.num_rows:
                known = known.take(pa.array(np.argsort(known["hash"].to_numpy(), kind="stable")))
                node, begin, h, to, keys = (t[c].to_numpy() for t, c in ((own, "node"), (own, "begin"), (own, "hash"), (known, "to_node"), (known, "hash")))
                m = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                at = np.flatnonzero((keys[m] == h) & (to[m] != node))
                if len(at):  # stretches of a text lie side by side
                    edge = np.flatnonzero((np.diff(node[at]) != 0) | (np.diff(to[m[at]]) != 0) | (np.diff(begin[at]) != 1))
                    first, last = at[np.concatenate(([0], edge + 1))], at[np.concatenate((edge, [len(at) - 1]))]
                    mine, other = own.take(pa.array(first)), known.take(pa.array(m[first]))
                    yield from pa.table([mine["k"], mine["node"], mine["begin"], pa.array(begin[last] + LEAST), other["to_k"], other["to_node"]], schema=arrow).to_batches()
            end = both.slice(both.num_rows - 1).select(by).to_pylist()[0]
            held = known.filter(pa.array((known["anchor"].to_numpy() == end["anchor"]) & (known["part"].to_numpy() == end["part"])))

    return both.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Repeats of passages of ``LEAST`` words or more: key, begin, end (word numbers), kept_id, text_hash; one row for each suffix's span.

    kept_id is the smallest key among all occurrences of a stretch of ``LEAST`` words; that occurrence
    gives no row, nor does a passage that comes again inside its own text. Equal texts of ``LEAST`` words or more repeat whole; rows that
    repeat key and text are one document. Null and short texts give no row. Keys are whole numbers or null; text_hash
    (64 bits of the text) tells rows apart that repeat a key with other texts. Other columns are not read.
    Words are as in ``words``: split at ASCII white space, A-Z in lower case.
    """
    prepare(docs.sparkSession)
    stage = Staged("suffix")
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("text")).where("text is not null").withColumn("node", F.xxhash64("text"))
    anchors = stage(_anchors(rows), "anchors")
    counts = anchors.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1")
    counts = stage(counts.withColumn("parts", F.when(F.col("c") > PART, (F.col("c") / SLICE + 1).cast("int")).otherwise(1)), "counts")
    places = anchors.join(counts, "anchor").select("node", F.struct(F.col("pos"), F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node", "pos"), F.col("parts"))).otherwise(-1).cast("int").alias("part")).alias("place"))
    places = places.groupBy("node").agg(F.collect_set("place").alias("places"))  # bounded by one text's length
    first = rows.groupBy("node").agg(F.min("k").alias("fk"), F.count("*").alias("copies"))
    places = places.join(first, "node").select(F.col("node").alias("pn"), "fk", "places")
    own = rows.join(places, (rows.node == F.col("pn")) & rows.k.eqNullSafe(F.col("fk"))).drop("pn", "fk")
    got = stage(_compare(_suffixes(own).withColumn("hot", F.col("part") >= 0)), "repeats")
    stage.drop(anchors, counts)
    # stretches of ten-grams in parts: the least key of a part, then of all parts, then back to the part's rows, so that no join key has many more than SLICE rows
    hot = got.where("to_node is null")
    of_part = hot.groupBy("anchor", "part", "hash").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "node")).alias("m"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    of_part = stage(of_part, "parts")
    of_all = of_part.groupBy("anchor", "hash").agg(F.min("m").alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    best = of_part.select("anchor", "part", "hash").join(of_all.where("lo < hi").select("anchor", "hash", "m"), ["anchor", "hash"])
    best = best.select("anchor", "part", "hash", F.col("m.k").alias("to_k"), F.col("m.node").alias("to_node"))
    more = stage(_kept_elsewhere(hot, best), "again")
    spans = got.where("to_node is not null").select(more.columns).unionByName(more)
    spans = spans.select(F.col("k").alias(key), "begin", "end", F.col("to_k").alias("kept_id"), F.col("node").alias("text_hash"))
    copies = rows.join(first.where("copies > 1").select(F.col("node").alias("cn"), "fk"), rows.node == F.col("cn")).where(~rows.k.eqNullSafe(F.col("fk")))
    copies = copies.select("k", "text", F.col("fk").alias("kept_id"), "node").transform(_whole, key)
    return stage.last(spans.unionByName(copies), "spans")


def _whole(copies: DataFrame, key: str) -> DataFrame:
    """One span over each whole text of enough words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.array([len(word_spans(t.encode("utf-8", "surrogatepass"))[0]) for t in b.column(1).to_pylist()], np.int64)
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(np.zeros(len(n), np.int64)), pa.array(n), b.column(2), b.column(3)], names=[key, "begin", "end", "kept_id", "text_hash"])
            yield out.filter(pa.array(n >= LEAST))

    return copies.mapInArrow(run, f"`{key}` long, begin long, end long, kept_id long, text_hash long")


def joined_spans(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Maximal repeated stretches: key, begin, end, n_words, kept_ids (sorted); overlapping and touching spans of a text are one."""
    text = Window.partitionBy(key, "text_hash")
    before = F.max("end").over(text.orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("new__", F.coalesce(F.col("begin") > before, F.lit(True)).cast("int"))
    rows = rows.withColumn("part__", F.sum("new__").over(text.orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(key, "text_hash", "part__").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.array_sort(F.collect_set("kept_id")).alias("kept_ids"))
    return out.select(key, "begin", "end", (F.col("end") - F.col("begin")).alias("n_words"), "kept_ids")


def cut_repeats(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the words in ``spans``; texts left without a word after a cut go.

    Spans belong to the rows of their key and text: rows that repeat a key keep their own, all columns stay as they are, null texts too.
    """
    cuts, sk, st, own = (free_name(docs, x) for x in ("spans", "key", "hash", "own"))
    per = spans.groupBy(F.col(key).alias(sk), F.col("text_hash").alias(st)).agg(F.collect_set(F.struct("begin", "end")).alias(cuts))
    rows = docs.withColumn(own, F.xxhash64(F.col(text).cast("string")))
    rows = rows.join(per, F.col(key).cast("long").eqNullSafe(F.col(sk)) & (F.col(own) == F.col(st)), "left").drop(sk, st, own)
    kept = rows.schema
    at, last = docs.columns.index(text), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = [], []
            for t, out in zip(b.column(at).to_pylist(), b.column(last).to_pylist(), strict=True):
                if t is not None and out:
                    raw = t.encode("utf-8", "surrogatepass")
                    begin, end = word_spans(raw)
                    gone = np.zeros(len(raw), bool)
                    for c in out:
                        if c["begin"] < len(begin):
                            gone[begin[c["begin"]] : end[min(c["end"], len(end)) - 1] + 1] = True
                    raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    t = raw.decode("utf-8", "surrogatepass")
                    keep.append(bool(raw.strip()))
                else:
                    keep.append(True)
                texts.append(t)
            cols = [*b.columns]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, kept).drop(cuts)
