"""Merkle manifest of a table: postorder logs written by aligned builders, and proofs addressed in closed form.

Rows are leaves of trees of eight children, one tree for each value of a column;
the trees' roots are the leaves of one more. A builder takes 8**LEVELS leaves
whose first place is a multiple of that, and appends every node to its log when
the node's last child is there, so each subtree is one stretch of the log. The
builders' roots are the leaves of the next layer, until a tree is one node; no
task holds more than a builder's leaves.

A node's place in a log follows from the sizes of complete subtrees (``place``),
so a proof's siblings are read out of the log without an index. Above a builder
all its leaves share one path, which is joined to the log once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import Staged, prepare

FAN = 8
#: Levels of one builder: 4,096 leaves.
LEVELS = 4
_PATH = "array<struct<before:string,after:string>>"


def leaf_digest(*columns: Column | str) -> Column:
    """SHA-256 in lower-case hex of the columns in order, each '-' if null, else its UTF-8 byte count, ':' and its value as text."""
    parts = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def height(n: int) -> int:
    """Levels above n leaves: while several nodes remain, runs of eight become one, a last run of one too."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


def place(level: int, index: np.ndarray, n: int, levels: int) -> np.ndarray:
    """Places in the postorder log of n leaves and ``levels`` levels of the nodes ``index`` of one level.

    Before a node come all nodes on its own and lower levels up to its last leaf, and the nodes of higher levels
    that are complete before its first leaf.
    """
    first, end = index * FAN**level, np.minimum(n, (index + 1) * FAN**level)
    at = -np.ones_like(index)
    for k in range(levels + 1):
        at = at + (-(-end // FAN**k) if k <= level else first // FAN**k)
    return at


def append_log(leaves: list[str], levels: int) -> list[str]:
    """All nodes in the order in which they are complete; what is open at the end is closed level by level."""
    log: list[str] = []
    open_: list[list[str]] = [[] for _ in range(levels + 1)]

    def close(level: int) -> None:
        node = hashlib.sha256("".join(open_[level]).encode()).hexdigest()
        open_[level] = []
        log.append(node)
        open_[level + 1].append(node)

    for leaf in leaves:
        log.append(leaf)
        open_[0].append(leaf)
        for k in range(levels):
            if len(open_[k]) < FAN:
                break
            close(k)
    for k in range(levels):
        if open_[k]:
            close(k)
    return log


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its path give."""
    for before, after in path:
        leaf = hashlib.sha256(f"{before}{leaf}{after}".encode()).hexdigest()
    return leaf


def ranked(rows: DataFrame, order: list[str], stage: Staged, name: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0 inside its ``tree``, by ``order``) and ``n``, the tree's rows.

    Rows are sorted over range partitions and written with their place; one count for each task and tree gives
    where a task's rows begin. Rows equal in all of ``order`` are told apart by where they were read, so they spread too.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order, "tie"]
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    rows = stage(rows.drop("tie").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), name)
    counts = rows.groupBy("tree", "part").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("tree").alias("t"), F.col("part").alias("p"), (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(Window.partitionBy("tree")).alias("n"))
    got = rows.join(starts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("part") == F.col("p")))
    return got.withColumn("pos", F.col("at") + F.col("shift")).drop("t", "p", "part", "at", "shift")


class Forest:
    """Trees over ``leaves`` (tree, pos, n, digest and further columns, which the first layer's logs carry along as ``rows``)."""

    def __init__(self, leaves: DataFrame, stage: Staged, name: str, levels: int):
        self.stage, self.name, self.levels, self.block = stage, name, levels, FAN**levels
        self.kind = leaves.schema["tree"].dataType
        more = [f.name for f in leaves.schema if f.name not in ("tree", "pos", "n", "digest")]
        self.logs = [self._written(leaves, more, 0)]
        most = self.logs[0].agg(F.max("n")).first()[0] or 0
        while most > self.block:
            most = -(-most // self.block)
            up = self.logs[-1].where(F.col("n") > self.block)
            up = up.select("tree", F.col("block").alias("pos"), F.expr(f"(n + {self.block - 1}) div {self.block}").alias("n"), F.col("root").alias("digest"))
            self.logs.append(self._written(up, [], len(self.logs)))

    def _written(self, leaves: DataFrame, more: list[str], layer: int) -> DataFrame:
        """One row a builder: tree, block, n (leaves of the tree in this layer), log (32 bytes a node), root and, if there are any, rows."""
        levels, block = self.levels, self.block
        schema = f"tree {self.kind.simpleString()}, block long, n long, log binary, root string"
        if more:
            schema += f", rows array<{leaves.select(*more).schema.simpleString()}>"

        def build(key: tuple, t: pa.Table) -> pa.Table:
            t, n = t.sort_by("pos"), t["n"][0].as_py()
            log = append_log(t["digest"].to_pylist(), min(levels, height(n)))
            cols = {"tree": t["tree"].slice(0, 1), "block": [key[1].as_py()], "n": [n], "log": [bytes.fromhex("".join(log))], "root": [log[-1]]}
            if more:
                rows = pa.StructArray.from_arrays([t[c].combine_chunks() for c in more], names=more)
                cols["rows"] = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            return pa.table(cols)

        got = leaves.withColumn("block", F.expr(f"pos div {block}")).groupBy("tree", "block").applyInArrow(build, schema)
        return self.stage(got, f"{self.name}-{layer}")

    def roots(self) -> DataFrame:
        """tree, root of every tree: the one log of its last layer."""
        done = [x.where(F.col("n") <= self.block).select("tree", "root") for x in self.logs]
        return reduce(DataFrame.union, done)

    def beneath(self, above: DataFrame) -> DataFrame:
        """The first layer's logs, each with ``path``, the siblings from its root upwards, and the tree's ``subroot`` and ``whole``.

        ``above`` (tree, path, subroot, whole) has a row for each tree. Going down, a log's path is that of its root in the layer above.
        """
        down = None
        for logs in reversed(self.logs):
            got = _met(logs.where(F.col("n") <= self.block), above.withColumn("at", F.lit(0).cast("long")))
            if down is not None:
                got = got.unionByName(_met(logs.where(F.col("n") > self.block), down))
            if logs is not self.logs[0]:
                down = self.spread(got)
        return got

    def spread(self, logs: DataFrame) -> DataFrame:
        """tree, at (the leaf's place), path, subroot, whole of every leaf of logs of a higher layer."""
        levels = self.levels

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for log in opened(batches, levels):
                whole = [path + log.up for path in log.paths()]
                yield _batch(out, [log.tree] * log.m, range(log.first, log.first + log.m), whole, [log.subroot] * log.m, [log.whole] * log.m)

        schema, out = _schemas(logs.sparkSession, f"tree {self.kind.simpleString()}, at long, path {_PATH}, subroot string, whole string")
        return logs.mapInArrow(run, schema)


def _met(logs: DataFrame, paths_: DataFrame) -> DataFrame:
    right = paths_.withColumnsRenamed({"tree": "t", "at": "p"})
    return logs.join(right, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("p"))).drop("t", "p")


def _schemas(spark, ddl: str):
    schema = spark.createDataFrame([], ddl).schema
    return schema, to_arrow_schema(schema)


def _batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


class opened:
    """The logs in Arrow batches (tree, block, n, log, path, subroot, whole, maybe rows), one by one."""

    def __init__(self, batches: Iterator[pa.RecordBatch], levels: int):
        self.batches, self.levels = batches, levels

    def __iter__(self) -> Iterator[opened]:
        for b in self.batches:
            at = {name: b.column(k) for k, name in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                self.tree, n, self.first = at["tree"][i].as_py(), at["n"][i].as_py(), at["block"][i].as_py() * FAN**self.levels
                self.m, self.k = min(n - self.first, FAN**self.levels), min(self.levels, height(n))
                self.log = at["log"][i].as_py().hex()
                self.up = [(x["before"], x["after"]) for x in at["path"][i].as_py()]
                self.subroot, self.whole = at["subroot"][i].as_py(), at["whole"][i].as_py()
                self.rows = at["rows"][i].values if "rows" in at else None
                yield self

    def node(self, level: int) -> list[str]:
        """The nodes of one level."""
        where = place(level, np.arange(-(-self.m // FAN**level)), self.m, self.k).tolist()
        return [self.log[64 * i : 64 * i + 64] for i in where]

    def paths(self) -> Iterator[list[tuple[str, str]]]:
        """For each leaf the siblings before and after it, level by level."""
        rows = [self.node(k) for k in range(self.k)]
        sides = [[("".join(row[j - j % FAN : j]), "".join(row[j + 1 : j - j % FAN + FAN])) for j in range(len(row))] for row in rows]
        for i in range(self.m):
            yield [side[i // FAN**k] for k, side in enumerate(sides)]


class Manifest:
    """The written logs of all trees (``inner``) and of the one tree over their roots (``outer``)."""

    def __init__(self, inner: Forest, outer: Forest, stage: Staged):
        self.inner, self.outer, self.stage = inner, outer, stage

    def root(self) -> DataFrame:
        """One row: root; none for an empty table."""
        return self.outer.roots().select("root")

    def drop(self) -> None:
        """Delete the logs."""
        self.stage.drop()


def build_manifest(leaves: DataFrame, levels: int = LEVELS) -> Manifest:
    """Manifest of ``leaves`` (tree, key, digest and further columns).

    Leaves of a tree ascend by key (null first), equal keys by digest; trees ascend by value (null first, text by
    UTF-8 bytes). Rows that repeat are a leaf each. An empty table has no root.
    """
    prepare(leaves.sparkSession)
    stage = Staged("merkle")
    first = stage(leaves, "leaves")
    order = ranked(first, ["key", "digest"], stage, "ranked")
    inner = Forest(order, stage, "inner", levels)
    # a row for each tree; ranked in the same way, as their number has no bound
    subroots = inner.roots().select(F.lit(0).alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    outer = Forest(ranked(subroots, ["name"], stage, "subroots"), stage, "outer", levels)
    return Manifest(inner, outer, stage)


def extract_proofs(manifest: Manifest, claimed: str = "claimed", siblings: bool = False) -> DataFrame:
    """Every leaf's further columns but ``claimed``, then leaf, subroot, root, proof_sha256, folded_root, verified.

    ``proof_sha256`` is the digest of all siblings from the leaf up to the root, left to right. ``folded_root`` is made of
    the digest in the column ``claimed`` (of the leaf where that is null) and the siblings; ``verified`` says that it is
    the root. With ``siblings`` a column ``proof`` has the siblings before and after on every level.
    """
    inner, outer = manifest.inner, manifest.outer
    spark = inner.logs[0].sparkSession
    levels, tree = inner.levels, inner.kind.simpleString()
    top = outer.roots().select("tree", F.array().cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("root").alias("whole"))
    schema, tops = _schemas(spark, f"tree {tree}, path {_PATH}, subroot string, whole string")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for log in opened(batches, levels):
            yield _batch(tops, log.rows.field("name"), [path + log.up for path in log.paths()], log.node(0), [log.whole] * log.m)

    logs = inner.beneath(outer.beneath(top).mapInArrow(trees, schema))
    carried = [f for f in inner.logs[0].schema["rows"].dataType.elementType if f.name != claimed]
    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in carried] + ["leaf string", "subroot string", "root string", "proof_sha256 string", "folded_root string", "verified boolean"]
    proofs, out = _schemas(spark, ", ".join(ddl + [f"proof {_PATH}"] * siblings))

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for log in opened(batches, levels):
            leaf, tail = log.node(0), "".join(x + y for x, y in log.up)
            proof, folded, whole = [], [], []
            for own, said, path in zip(leaf, log.rows.field(claimed).to_pylist(), log.paths(), strict=True):
                proof.append(hashlib.sha256(("".join(x + y for x, y in path) + tail).encode()).hexdigest())
                folded.append(fold(own if said is None else said, path + log.up))
                if siblings:
                    whole.append(path + log.up)
            m = log.m
            yield _batch(out, *[log.rows.field(f.name) for f in carried], leaf, [log.subroot] * m, [log.whole] * m, proof, folded, [x == log.whole for x in folded], *[whole] * siblings)

    return logs.mapInArrow(prove, proofs)
