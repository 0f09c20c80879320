"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct five-word shingles. All sets are put in one
global order, frequent shingles last by a count sketch of the whole corpus.

* Two sets of n and m shingles link only if 100 * overlap >= 80 * union, that is if
  they share o = ceil(0.8 (n + m) / 1.8). The first n - o + l shingles of the one and
  m - o + l of the other then share at least l; over all m, n - ceil(0.8 n) + l is the prefix.
* Each document takes the l (1 to ``MOST``) whose estimated cost is least: sketched
  list lengths over its prefix, and those by l for verification. A pair must
  share min(l, l') such shingles before it is verified.
* A pair's overlap is at most half of what its sizes leave after the Hamming distance
  of two parity bitmaps (``PARITY`` bits, each the parity of the shingles on it): the
  distance never exceeds the symmetric difference. This is part of the join's condition.
* Equal sets are one node; only one of them in a task is posted.
* Components need no pair inside a group that is linked already. In star
  rounds each list's members are verified against one head, of the least edited in the list, another
  in each round, as long as a share of such pairs links; then every pair across
  components that shares enough is verified. No pair is skipped otherwise, so no
  link between components is lost. Each round names the components of the one before.

Shingle hashes have 64 bits: two texts that differ would need a collision of
2**-64 a pair to count as sharing one more. Sets have 128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Staged, prepare
from tidemark.llm.graph import components, renamed
from tidemark.llm.words import shingles

SHINGLE, PERCENT = 5, 80
#: Counters of the sketch (8 MB), longest multi-match, cost of one verification in list entries.
WIDTH, MOST, VERIFY = 1 << 21, 12, 30
_CHUNK = 16384
#: Bits of a set's parity bitmap.
PARITY = 512
#: Star rounds go on while one of so many of their pairs links.
PAYS = 10
#: Sets that a task knows as posted.
SEEN = 1 << 17
#: Bits of the filter that keeps texts of unpaired documents out of a shuffle (262,144 rows at most).
BITS = 1 << 24


def sketch(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of shingles by the low bits of their hash, over all documents; always ``WIDTH`` numbers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(WIDTH, np.int64), [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                held.append(shingles(t, SHINGLE))
                n += len(held[-1])
                if n > 1_000_000:
                    total += np.bincount((np.concatenate(held) & np.uint64(WIDTH - 1)).astype(np.int64), minlength=WIDTH)
                    held, n = [], 0
        if held:
            total += np.bincount((np.concatenate(held) & np.uint64(WIDTH - 1)).astype(np.int64), minlength=WIDTH)
        rows = np.minimum(total, (1 << 31) - 1).astype("<i4").reshape(-1, _CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["chunk", "counts"])

    def add(key, table):
        total = np.zeros(_CHUNK, np.int64)
        for raw in table["counts"].to_pylist():
            total += np.frombuffer(raw, "<i4")
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select(F.col(text).cast("string")).mapInArrow(partial, "chunk int, counts binary")
    out = np.zeros((WIDTH // _CHUNK, _CHUNK), np.int64)
    for chunk, raw in parts.groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect():
        out[chunk] = np.frombuffer(raw, np.int64)
    return out.ravel()


def prefix(own: np.ndarray, counts: np.ndarray, noise: float) -> tuple[np.ndarray, int]:
    """The prefix of one sorted set, and its number of matches l."""
    n = len(own)
    need = -(-PERCENT * n // 100)
    guess = counts[(own & np.uint64(WIDTH - 1)).astype(np.int64)]
    # counters within what other shingles add say nothing; those shingles go by their hash
    often = np.where(guess > noise, guess, 0)
    order = np.lexsort((own, often))
    most = max(1, min(MOST, need))
    ahead = order[: n - need + most]
    lists = np.cumsum(np.maximum(often[ahead], 1), dtype=np.float64)[n - need :]
    l = np.arange(1, len(lists) + 1)
    best = int(np.argmin(lists + VERIFY * lists / l)) + 1
    return own[ahead[: n - need + best]], best


def row_hash(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text).cast("string"))


def parity(own: np.ndarray) -> list[int]:
    """Parity of the shingles on each of ``PARITY`` bits, as 64-bit integers."""
    odd = np.bincount((own >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").tolist()


def central(own: np.ndarray, counts: np.ndarray, noise: float) -> int:
    """How many of a thousand of a set's shingles the sketch knows as frequent: of near copies, the least edited has most."""
    return int(np.count_nonzero(counts[(own & np.uint64(WIDTH - 1)).astype(np.int64)] > noise) * 1000 // len(own))


def document_sets(docs: DataFrame, counts: Broadcast, noise: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, row (hash of key and text), node and high (128 bits of the set's digest; null for an empty set), n, l, central, bits, prefix (these two null if this task has posted the node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = counts.value, set()
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                own = shingles(t, SHINGLE)
                if not len(own):
                    rows.append((None, None, 0, 0, 0, None, None))
                    continue
                node = set_node(own)
                if node in seen:
                    rows.append((*node, len(own), 0, 0, None, None))
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                ahead, l = prefix(own, known, noise)
                rows.append((*node, len(own), l, central(own, known, noise), parity(own), ahead.astype(np.int64).tolist()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *cols], names=[key, "row", "node", "high", "n", "l", "central", "bits", "prefix"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string"), row_hash(key, text).alias("row")).mapInArrow(run, f"`{key}` {kind}, row long, node long, high long, n long, l int, central int, bits array<long>, prefix array<long>")


def set_nodes(sets: DataFrame, key: str) -> DataFrame:
    """One row per set: node, its row and key (the smallest that isn't null), bits, and the least and greatest upper half of its digest."""
    least = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), F.col("row").alias("row")))
    nodes = sets.where("node is not null").groupBy("node").agg(least.alias("m"), F.first("bits", ignorenulls=True).alias("bits"), F.min("high").alias("lo"), F.max("high").alias("hi"))
    return nodes.select("node", "m.k", "m.row", "bits", "lo", "hi")


def apart(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sets whose node stands for two digests get another: all but the least of them take a hash of both halves."""
    clash = nodes.where("lo < hi").select("node", "lo")
    other = F.when(F.col("high") > F.col("lo"), F.xxhash64("node", "high")).otherwise(F.col("node"))
    return sets.join(clash, "node", "left").withColumn("node", other).drop("lo").select(*sets.columns)


def shared_postings(sets: DataFrame) -> DataFrame:
    """(token, central, node, meta, head, head_meta) of prefix shingles that two nodes or more have; see ``_meta``.

    One shuffle by token; a task streams over sorted postings, drops repeated
    nodes, holds one batch, and passes on lists of two or more with their most central node.
    """
    posts = sets.where("prefix is not null").select(F.posexplode("prefix").alias("at", "token"), (-F.col("central")).cast("long").alias("central"), "node", "n", "l")
    posts = posts.select("token", "central", "node", _meta("n", "at", "l").alias("meta"))
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posts = posts.repartition(parts, "token").sortWithinPartitions("token", "central", "node")
    names = ["token", "central", "node", "meta", "head_central", "head", "head_meta"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((4, 0), np.int64)  # the row before this batch
        head = np.zeros((4, 0), np.int64)  # the first row of its list
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.concatenate((last, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns])), axis=1)
            n_old = last.shape[1]
            same = rows[0, 1:] == rows[0, :-1]
            fresh = np.concatenate(([True], ~(same & (rows[2, 1:] == rows[2, :-1]))))
            start = np.concatenate(([True], ~same))
            first = np.maximum.accumulate(np.where(start, np.arange(rows.shape[1]), 0))
            heads = rows[:, first]
            if n_old:  # the list may have begun before
                heads = np.where(first == 0, head, heads)
            pick = fresh & ~start
            pick[:n_old] = False
            out = np.concatenate((rows[:, pick], heads[1:, pick]))
            if out.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)
            last, head = rows[:, -1:], heads[:, -1:]

    # rows with their list's first node; the first node itself is put back by members()
    return posts.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def members(shared: DataFrame) -> DataFrame:
    """(token, central, node, meta) of all lists, their first nodes included."""
    first = shared.groupBy("token").agg(F.first("head_central").alias("central"), F.first("head").alias("node"), F.first("head_meta").alias("meta"))
    return shared.select("token", "central", "node", "meta").unionByName(first)


def _meta(n: str, at: str, l: str) -> Column:
    """Size of a set, place of the shingle in its order and matches l in one integer: 29, 29 and 4 bits."""
    return F.shiftleft(F.col(n), 33) + F.shiftleft(F.col(at).cast("long"), 4) + F.col(l)


def _size(meta: str) -> Column:
    return F.shiftright(meta, 33)


def _at(meta: str) -> Column:
    return F.shiftright(F.col(meta).bitwiseAND(F.lit((1 << 33) - 1)), 4)


def _l(meta: str) -> Column:
    return F.col(meta).bitwiseAND(F.lit(15))


def _overlap(x: str, y: str) -> Column:
    """Shingles that sets of these sizes must share to link."""
    both = _size(x) + _size(y)
    return F.floor((both * PERCENT + (99 + PERCENT)) / (100 + PERCENT))


def _fits(x: str, y: str) -> Column:
    """Sizes allow the similarity, and on both sides the shingle lies so far ahead that sharing fewer than l such ones leaves too few others."""
    n, m, o, l = _size(x), _size(y), _overlap(x, y), F.least(_l(x), _l(y))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT) & (_at(x) < n - o + l) & (_at(y) < m - o + l)


def _can_overlap(x: str, y: str, xbits: str, ybits: str) -> Column:
    """The parity bitmaps leave room for the overlap that sizes call for."""
    apart = sum((F.bit_count(F.col(xbits)[i].bitwiseXOR(F.col(ybits)[i])) for i in range(PARITY // 64)), F.lit(0))
    return _size(x) + _size(y) - apart >= 2 * _overlap(x, y)


def _bits(ids: DataFrame) -> DataFrame:
    """(word, bits): a filter of row hashes by their low bits, ``BITS`` / 64 rows whatever their number."""
    words = ids.selectExpr(f"cast((row & {BITS - 1}) >> 6 as int) AS word", "shiftleft(1L, cast(row & 63 as int)) AS bit")
    return words.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def set_node(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set's digest as two integers."""
    raw = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def node_texts(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """(node, text) for (node, row, k) in ``ids``, each node's one row.

    Rows are first asked of a bit filter of bounded size, so that texts of
    unpaired documents and of other copies aren't shuffled; a false hit ends at the join.
    """
    rows = docs.select(F.col(key).alias("key__"), row_hash(key, text).alias("row"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("word", F.expr(f"cast((row & {BITS - 1}) >> 6 as int)")).join(F.broadcast(_bits(ids)), "word").where("shiftright(bits, cast(row & 63 as int)) & 1 = 1")
    return rows.select("key__", "row", "text").join(ids, "row").where(F.col("key__").eqNullSafe(F.col("k"))).select("node", "text").dropDuplicates(["node"])


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, stage: Staged, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Written links (a, b) between components ``ac`` and ``bc`` of those pairs of nodes (a, b) whose whole sets link; ``nodes`` has each node's row."""
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = stage(ids.join(nodes.select("node", "row", "k"), "node"), "ids")
    own = stage(node_texts(docs, ids, key, text), "texts")
    left, right = own.select(F.col("node").alias("a"), F.col("text").alias("ta")), own.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb", "ac", "bc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def of(node, text):
            if (x := known.get(node)) is None:
                if len(known) > 64:
                    known.clear()
                x = known[node] = shingles(text, SHINGLE)
            return x

        for b in batches:
            keep = []
            for a, c, ta, tb in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                x, y = of(a, ta), of(c, tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(4), b.column(5)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = stage(rows.mapInArrow(run, "a long, b long"), "links")
    stage.drop(own, ids)
    return links


def _stars(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each node the head it shares most lists with, if more than by chance, as pairs (a, b) with their components; later steps look at whatever this leaves out."""
    pairs = rows.where("comp <> head_comp").where(_fits("meta", "head_meta")).groupBy("head", "node").agg(F.count("*").alias("c"), F.min(F.least(_l("meta"), _l("head_meta"))).alias("l"), F.min("comp").alias("comp"), F.min("head_comp").alias("head_comp"), F.min("meta").alias("meta"), F.min("head_meta").alias("head_meta"))
    pairs = pairs.where((F.col("c") >= F.least(F.lit(2), "l")) & (F.col("c") * 4 >= F.col("l")))
    best = pairs.groupBy("node").agg(F.max(F.struct("c", "head", "head_comp", "comp", "head_meta", "meta")).alias("m"))
    best = best.select(F.col("m.head").alias("a"), F.col("node").alias("b"), F.col("m.head_comp").alias("ac"), F.col("m.comp").alias("bc"), F.col("m.head_meta").alias("am"), F.col("m.meta").alias("bm"))
    best = best.join(nodes.select(F.col("node").alias("a"), F.col("bits").alias("ab")), "a").join(nodes.select(F.col("node").alias("b"), F.col("bits").alias("bb")), "b")
    return best.where(_can_overlap("am", "bm", "ab", "bb")).select("a", "b", "ac", "bc")


def _heads(rest: DataFrame, turn: int) -> DataFrame:
    """For each list of two components or more, a node to hold the others against: by chance, another in each turn, among its most central ones."""
    rank = F.struct((-F.floor(F.col("central") / 50)).alias("central"), F.xxhash64("node", F.lit(turn)).alias("h"), "node", "meta", "comp")
    heads = rest.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(rank).alias("m")).where("lo < hi")
    return heads.select("token", F.col("m.node").alias("head"), F.col("m.meta").alias("head_meta"), F.col("m.comp").alias("head_comp"))


def link_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id (the smallest key reachable by links, its own included), row (``row_hash`` of key and text).

    Null or blank texts have no shingle and link with nothing. Fewer than five
    words are one shingle. Rows with equal sets link; rows that repeat a key are
    separate documents. A null key's component is the smallest key that isn't
    null, if any. Other columns are not read; an empty table gives no row.
    """
    spark, stage = prepare(docs.sparkSession), Staged("jaccard")
    counts = sketch(docs, text)
    noise = float(counts.mean() + 6 * counts.mean() ** 0.5 + 2)
    known = spark.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.int32))
    sets = stage(document_sets(docs, known, noise, key, text), "sets")
    known.destroy()
    nodes = stage(set_nodes(sets, key), "nodes")
    if not nodes.where("lo < hi").isEmpty():
        sets = stage(apart(sets, nodes), "sets")
        nodes = stage(set_nodes(sets, key), "nodes")
    shared = stage(shared_postings(sets), "shared")

    pairs = stage(_stars(shared.withColumns({"comp": F.col("node"), "head_comp": F.col("head")}), nodes), "pairs")
    label = components(verify(pairs, nodes, docs, stage, key, text), stage)
    labels, rest = [label], members(shared).withColumn("comp", F.col("node"))
    for turn in count(1):
        # lists that still hold two components, and another head for each
        got = stage(renamed(rest, label), "members")
        heads = stage(_heads(got, turn), "heads")
        rest = stage(got.join(heads, "token"), "rest")
        pairs = stage(_stars(rest, nodes), "pairs")
        stage.drop(got, heads)
        tried = pairs.count()
        if not tried:
            break
        links = verify(pairs, nodes, docs, stage, key, text)
        found = links.count()
        if found:
            label = components(links, stage)
            labels.append(label)
        if found * PAYS < tried:
            break
        rest = rest.select("token", "central", "node", "meta", "comp")
    # every pair across components
    rest = stage(renamed(rest.select("token", "node", "meta", "comp"), label), "members")
    # a list's largest component on one side: its own pairs are never looked at
    major = rest.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.count("*").alias("comps")).where("comps > 1")
    rest = rest.join(stage(major.select("token", "major"), "major"), "token").join(nodes.select("node", "bits"), "node")
    x = rest.where("comp <> major").select("token", F.col("node").alias("a"), F.col("meta").alias("am"), F.col("comp").alias("ac"), F.col("bits").alias("ab"))
    y = rest.select("token", F.col("node").alias("b"), F.col("meta").alias("bm"), F.col("comp").alias("bc"), F.col("bits").alias("bb"), (F.col("comp") == F.col("major")).alias("big"))
    met = x.join(y, "token").where((F.col("ac") != F.col("bc")) & (F.col("big") | (F.col("a") < F.col("b"))) & _fits("am", "bm") & _can_overlap("am", "bm", "ab", "bb"))
    met = met.withColumn("l", F.least(_l("am"), _l("bm"))).withColumn("swap", F.col("a") > F.col("b"))
    met = met.selectExpr("least(a, b) AS a", "greatest(a, b) AS b", "if(swap, bc, ac) AS ac", "if(swap, ac, bc) AS bc", "l")
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("l").alias("l"), F.min("ac").alias("ac"), F.min("bc").alias("bc"))
    pairs = stage(pairs.where("c >= l").select("a", "b", "ac", "bc"), "pairs")
    if not pairs.isEmpty():
        labels.append(components(verify(pairs, nodes, docs, stage, key, text), stage))
    # the smallest key of each node, then of each component
    comp = nodes.select("node", "k", F.col("node").alias("comp"))
    for label in labels:
        comp = renamed(comp, label)
    comp = stage(comp, "comp")
    least = comp.groupBy("comp").agg(F.min("k").alias("component"))
    found = comp.join(least, "comp").select("node", "component")
    out = sets.select(key, "row", "node", "n").join(found, "node", "left")
    out = out.select(key, F.col("n").alias("n_shingles"), F.coalesce("component", F.col(key)).cast(dict(docs.dtypes)[key]).alias("component_id"), "row")
    return stage.last(out, "found")
