"""Line dedup by exact reference counts and sharded cuckoo filters, open to insertions and deletions of documents.

A ``LineIndex`` has two written tables. ``refs`` counts, for each line key, the
documents that hold it; keys are 128-bit digests. ``filters`` has one cuckoo
filter for each shard of keys, with the keys whose count reaches the threshold.
Inserting or deleting documents adds or subtracts counts, and only keys that
cross the threshold enter or leave the filter of their shard, so a deletion
undoes an insertion.

Documents are filtered where they lie: every line key is looked for in the
filter of its shard. A filter may also take a key that it does not hold; as the
exact table has all keys, those are found when an index is opened and kept
beside the filters, which makes the answers exact. Filters are sent to tasks
only up to ``FILTER_BYTES``; beyond, keys of lines are joined with the exact table.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Staged, prepare

#: Lines of so many documents go.
LEAST_DOCS = 10
BLANKS = b" \t\n\x0b\x0c\r"
#: Entries of a bucket, moves before a filter counts as full, keys of a shard at first, room for more.
SLOTS, MOVES, SHARD_KEYS, ROOM = 4, 500, 50_000, 2
#: Filters of this size in all are sent to tasks.
FILTER_BYTES = 64 << 20
#: Keys that a task counts before it passes them on.
HELD_KEYS = 500_000


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes | None]]:
    """Lines of a text (null: one empty line) and their keys: ASCII blanks stripped, A-Z in lower case, as a digest; None for an empty key."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    return lines, [hashlib.md5(k).digest() if (k := x.strip(BLANKS).lower()) else None for x in lines]


def parts_of(keys: np.ndarray, shards: int, mask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, first bucket and fingerprint (not 0) of keys of 16 bytes."""
    words = keys.view(">u4").reshape(-1, 4).astype(np.uint32)
    return words[:, 0] % np.uint32(shards), words[:, 1] & np.uint32(mask), words[:, 3] | np.uint32(1)


def shard_column(shards: int):
    """The same shard as a column over ``key``."""
    return F.pmod(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long"), F.lit(shards))


def other(bucket, print_, mask: int):
    """A fingerprint's second bucket; from there it leads back to the first."""
    with np.errstate(over="ignore"):
        return bucket ^ ((print_ * np.uint32(0x5BD1E995)) >> np.uint32(7)) & np.uint32(mask)


class CuckooFilter:
    """Fingerprints of 32 bits in buckets of four; each key has two buckets."""

    def __init__(self, table: np.ndarray):
        self.table, self.mask = table, len(table) - 1

    @classmethod
    def empty(cls, keys: int) -> CuckooFilter:
        """Room for twice so many keys."""
        return cls(np.zeros((1 << (max(1, -(-ROOM * keys // SLOTS)) - 1).bit_length(), SLOTS), np.uint32))

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, "<u4").reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.astype("<u4").tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, first, print_ = parts_of(keys, 1, self.mask)
        return first, other(first, print_, self.mask), print_

    def contains(self, keys: np.ndarray) -> np.ndarray:
        a, b, print_ = self._places(keys)
        return ((self.table[a] == print_[:, None]) | (self.table[b] == print_[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """Add keys that aren't in yet; False if one finds no place, and the filter is to be made anew from the exact table."""
        rows, draw = self.table, np.random.Generator(np.random.PCG64(7))
        for a, b, x in zip(*self._places(keys), strict=True):
            for at in (a, b):
                free = np.flatnonzero(rows[at] == 0)
                if len(free):
                    rows[at, free[0]] = x
                    break
            else:
                at = b
                for _ in range(MOVES):
                    k = int(draw.integers(SLOTS))
                    x, rows[at, k] = rows[at, k], x
                    at = other(at, x, self.mask)
                    free = np.flatnonzero(rows[at] == 0)
                    if len(free):
                        rows[at, free[0]] = x
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that are in: one copy of the fingerprint each."""
        for a, b, x in zip(*self._places(keys), strict=True):
            for at in (a, b):
                full = np.flatnonzero(self.table[at] == x)
                if len(full):
                    self.table[at, full[0]] = 0
                    break
            else:
                raise ValueError("a key to delete isn't in the filter")


def as_keys(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)


class LineFilters:
    """All shards' filters, with the keys that they would take wrongly."""

    def __init__(self, filters: dict[int, bytes], shards: int, wrong: frozenset[bytes] = frozenset()):
        self.filters, self.shards, self.wrong = {k: CuckooFilter.load(v) for k, v in filters.items()}, shards, wrong

    def contains(self, keys: list[bytes]) -> list[bool]:
        if not keys:
            return []
        rows = as_keys(keys)
        shard = parts_of(rows, self.shards, 0)[0]
        got = np.zeros(len(rows), bool)
        for s in np.unique(shard).tolist():
            if s in self.filters:
                at = np.flatnonzero(shard == s)
                got[at] = self.filters[s].contains(rows[at])
        return [bool(g) and k not in self.wrong for g, k in zip(got, keys, strict=True)]


def counted(docs: DataFrame, text: str) -> DataFrame:
    """key, n: documents with that line, counted by task; sums of a key are still to be made."""
    schema = pa.schema([("key", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                held.update({k for k in line_keys(t)[1] if k})
                if len(held) > HELD_KEYS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], schema=schema)
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], schema=schema)

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "key binary, n long")


class LineIndex:
    """Counts of line keys and filters of the frequent ones (see the module)."""

    def __init__(self, refs: DataFrame, filters: DataFrame, shards: int, least: int, stage: Staged):
        self.refs, self.filters, self.shards, self.least, self.stage = refs, filters, shards, least, stage

    @classmethod
    def create(cls, spark: SparkSession, least: int = LEAST_DOCS) -> LineIndex:
        """An index of no documents."""
        prepare(spark)
        return cls(spark.createDataFrame([], "key binary, n long"), spark.createDataFrame([], "shard long, filter binary"), 1, least, Staged("lines"))

    def insert(self, docs: DataFrame, text: str = "text") -> LineIndex:
        return self._changed(counted(docs, text))

    def delete(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """Undo the insertion of ``docs``; documents that were never inserted are an error."""
        return self._changed(counted(docs, text).withColumn("n", -F.col("n")))

    def _changed(self, change: DataFrame) -> LineIndex:
        """A new index; this one stays as it is until ``drop``."""
        stage = Staged("lines")
        old = self.refs.select("key", F.lit(0).cast("long").alias("d"), F.col("n").alias("old"))
        both = old.unionByName(change.select("key", F.col("n").alias("d"), F.lit(0).cast("long").alias("old")))
        both = both.groupBy("key").agg(F.sum("old").alias("old"), F.sum("d").alias("d")).select("key", "old", (F.col("old") + F.col("d")).alias("n"))
        rows = stage(both, "refs")
        least, frequent = rows.agg(F.min("n"), F.sum((F.col("n") >= self.least).cast("long"))).first()
        if (least or 0) < 0:
            stage.drop()
            raise ValueError("documents to delete were never inserted")
        refs = rows.where("n > 0").select("key", "n")
        shards = 1 << (max(1, -(-(frequent or 0) // SHARD_KEYS)) - 1).bit_length()
        step = F.when(F.col("n") >= self.least, 1).otherwise(0) - F.when(F.col("old") >= self.least, 1).otherwise(0)
        full = False
        if shards <= self.shards:
            crossed = rows.select("key", step.alias("step")).where("step <> 0").withColumn("shard", shard_column(self.shards))
            filters = stage(self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(_update, "shard long, filter binary"), "filters")
            full = not filters.where("filter is null").isEmpty()
        if shards > self.shards or full:
            shards = max(shards, self.shards * (2 if full else 1))
            filters = stage(refs.where(F.col("n") >= self.least).withColumn("shard", shard_column(shards)).groupBy("shard").applyInArrow(_build, "shard long, filter binary"), "filters")
        return LineIndex(refs, filters, max(shards, self.shards), self.least, stage)

    def opened(self, most: int = FILTER_BYTES) -> LineFilters | None:
        """Filters and their wrong keys, if both are within ``most`` bytes; else None."""
        if (self.filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0) > most:
            return None
        held, shards = {r.shard: bytes(r.filter) for r in self.filters.collect()}, self.shards
        sent = self.refs.sparkSession.sparkContext.broadcast(held)

        def wrong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = LineFilters(sent.value, shards)
            for b in batches:
                yield b.filter(pa.array(f.contains(b.column(0).to_pylist()), pa.bool_()))

        # of as many rare keys as there are, about two in a thousand million come out
        got = self.refs.where(F.col("n") < self.least).select("key").mapInArrow(wrong, "key binary").limit(most // 16 + 1).collect()
        return LineFilters(held, shards, frozenset(bytes(r.key) for r in got)) if len(got) <= most // 16 else None

    def drop(self) -> None:
        """Delete the tables."""
        self.stage.drop()


def _build(key: tuple, rows: pa.Table) -> pa.Table:
    keys, size = as_keys(rows["key"].to_pylist()), rows.num_rows
    while not (f := CuckooFilter.empty(size)).insert(keys):
        size *= 2
    return pa.table({"shard": [key[0].as_py()], "filter": [f.dump()]})


def _update(key: tuple, old: pa.Table, crossed: pa.Table) -> pa.Table:
    """A shard's filter after keys left and entered; null if one found no place."""
    up, down = (as_keys([k for k, s in zip(crossed["key"].to_pylist(), crossed["step"].to_pylist(), strict=True) if s == way]) for way in (1, -1))
    f = CuckooFilter.load(old["filter"][0].as_py()) if old.num_rows else CuckooFilter.empty(max(len(up), 1))
    f.delete(down)
    return pa.table({"shard": [key[0].as_py()], "filter": pa.array([f.dump() if f.insert(up) else None], pa.binary())})


def drop_lines(docs: DataFrame, index: LineIndex, key: str = "doc_id", text: str = "text", most: int = FILTER_BYTES) -> DataFrame:
    """key, text (without the frequent lines), n_lines, n_dropped of documents that are in ``index``.

    A null or empty text is one empty line, which stays: the text comes out empty. Lines whose key is empty stay. Where all
    lines go the text is empty. Rows that repeat come out as often; other columns aren't read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    out = f"`{key}` {rows.schema[0].dataType.simpleString()}, text string, n_lines long, n_dropped long"
    filters = index.opened(most)
    if filters is None:
        rows = _with_hits(rows, key, index)
    else:
        sent = docs.sparkSession.sparkContext.broadcast(filters)
    by_filter = filters is not None
    del filters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = sent.value if by_filter else None
        for b in batches:
            split = [line_keys(t) for t in b.column(1).to_pylist()]
            if by_filter:
                each = list({k for _, keys in split for k in keys if k})
                gone = {k for k, hit in zip(each, filters.contains(each), strict=True) if hit}
                hits = [gone] * len(split)
            else:
                hits = [set(x or ()) for x in b.column(2).to_pylist()]
            kept = [[x for x, k in zip(lines, keys, strict=True) if k not in g] for (lines, keys), g in zip(split, hits, strict=True)]
            n = [len(lines) for lines, _ in split]
            texts = pa.array([b"\n".join(x) for x in kept], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts, pa.array(n, pa.int64()), pa.array([a - len(k) for a, k in zip(n, kept, strict=True)], pa.int64())], names=[key, "text", "n_lines", "n_dropped"])

    return rows.mapInArrow(run, out)


def _with_hits(rows: DataFrame, key: str, index: LineIndex) -> DataFrame:
    """``rows`` with the frequent keys of each text, joined with the exact table: keys of lines travel once a text, texts once."""
    schema = pa.schema([("row", pa.binary()), ("key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(hashlib.md5((t or "").encode("utf-8", "surrogatepass")).digest(), k) for t in b.column(0).to_pylist() for k in {k for k in line_keys(t)[1] if k}]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], schema=schema)

    frequent = index.refs.where(F.col("n") >= index.least).select("key")
    lines = rows.select("text").mapInArrow(run, "row binary, key binary").distinct()
    hits = lines.join(frequent, "key").groupBy("row").agg(F.collect_set("key").alias("hits"))
    row = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return rows.withColumn("row__", row).join(hits, F.col("row__") == F.col("row"), "left").select(F.col(key), "text", "hits")
