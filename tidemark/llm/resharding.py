"""Minimum-cost-flow resharding: from old shard sizes and new capacities, solve the transfers that move the fewest bytes, then rewrite the shards they touch.

Under the ``rows`` law shards hold total // shards rows or one more. An old shard
that is too full sends its smallest rows, so its rows fall into three blocks:
those below the size at the cut, those of that size, and those above it. In the
flow network every block has a free arc to its own shard and an arc at its rows'
size to each other one; each shard has room for its rows and, through one node
that holds the remainder, for one more. The flow decides where the extra rows
stay and which pairs of shards exchange rows, and its cost is the fewest bytes:
blocks that it may split hold rows of one size. The network depends on the
number of shards alone, not on rows.
"""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import byte_length, prepare, shared_folder

#: Rows of one numbering bucket on average.
BUCKET_ROWS = 20_000
#: Blocks of an old shard: rows below the size at the cut, of that size, above it.
BELOW, AT, ABOVE = 0, 1, 2


class Network:
    """Directed graph with capacities and costs; ``solve`` augments along cheapest paths (Dijkstra with potentials)."""

    def __init__(self):
        self.to, self.room, self.cost, self.out = [], [], [], defaultdict(list)

    def arc(self, a, b, room: int, cost: float) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def solve(self, source, sink) -> int:
        sent, height = 0, defaultdict(float)
        while True:
            best, via, todo, tick = {source: 0.0}, {}, [(0.0, 0, source)], 1
            done = set()
            while todo:
                d, _, a = heapq.heappop(todo)
                if a in done:
                    continue
                done.add(a)
                for e in self.out[a]:
                    b = self.to[e]
                    if self.room[e] and b not in done and (x := d + self.cost[e] + height[a] - height[b]) < best.get(b, 1e300):
                        best[b], via[b] = x, e
                        heapq.heappush(todo, (x, tick, b))
                        tick += 1
            if sink not in via:
                return sent
            for a in best:
                height[a] += min(best[a], best[sink])
            for a in list(self.out):
                if a not in best:
                    height[a] += best[sink]
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = self.to[via[at] ^ 1]
            least = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= least
                self.room[e ^ 1] += least
            sent += least

    def flow(self, e: int) -> int:
        return self.room[e ^ 1]


def plan_transfers(blocks: list[tuple[int, int, int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Rows of each block that go to each shard: (old, kind, new, from rank, to rank).

    ``blocks`` has (old shard, kind, rows, bytes). Old shards beyond the new count only send.
    """
    total = sum(n for _, _, n, _ in blocks)
    net, arcs = Network(), {}
    for s in range(shards):
        net.arc(("shard", s), "sink", total // shards, 0)
        net.arc(("shard", s), "extra", 1, 0)
    net.arc("extra", "sink", total % shards, 0)
    for old, kind, n, size in blocks:
        here = ("block", old, kind)
        net.arc("source", here, n, 0)
        for s in range(shards):
            arcs[old, kind, s] = net.arc(here, ("shard", s), n, 0 if s == old else size / n)
    if net.solve("source", "sink") != total:
        raise ValueError("capacities don't hold all rows")
    out = []
    for old, kind, _, _ in blocks:
        rank = 0
        for s in range(shards):
            if got := net.flow(arcs[old, kind, s]):
                out.append((old, kind, s, rank, rank + got))
                rank += got
    return out


def cuts(rows: DataFrame, shards: int) -> DataFrame:
    """(old_shard, cut): the size of the last row that a shard too full must send, its smallest ones first; null for shards that needn't. One row an old shard."""
    sizes = rows.groupBy("old_shard", "size").agg(F.count("*").alias("n"))
    by = Window.partitionBy("old_shard")
    sizes = sizes.withColumns({"upto": F.sum("n").over(by.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)), "rows": F.sum("n").over(by)})
    whole = sizes.agg(F.floor(F.sum("n") / shards).alias("room"))  # one row
    must = F.when(F.col("old_shard") < shards, F.col("rows") - F.col("room")).otherwise(F.col("rows"))
    return sizes.crossJoin(F.broadcast(whole)).withColumn("must", must).groupBy("old_shard").agg(F.min(F.when((F.col("must") > 0) & (F.col("upto") >= F.col("must")), F.col("size"))).alias("cut"))


def numbered(rows: DataFrame, block: list[str], order: list[str], n_buckets: int) -> DataFrame:
    """Number rows from 0 inside each block without sorting a block in one task.

    Rows are dealt to buckets by a hash; counts of (block, bucket) give each
    bucket's first number, and only buckets are sorted.
    """
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(n_buckets)).cast("int"))
    keys = [*block, "bucket"]
    before = Window.partitionBy(*block).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("inside", inside).join(first, keys).withColumn("rank", F.col("first") + F.col("inside")).drop("inside", "first", "bucket")


def reshard(docs: DataFrame, old_shard: Column, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every row in a shard under the ``rows`` law, moving the fewest bytes: shard row counts differ by one at most.

    Columns: row (a struct of all columns of ``docs``), size (UTF-8 bytes and 8; a null text has none), text_crc32,
    old_shard (null counts as 0), shard, slot (from 0 without gaps in each shard). Null and repeated keys are placed like
    others, of equal rows any; an empty table gives no row. ``docs`` is read again in each pass, so it must be
    a table or a plan that gives the same rows each time.
    """
    spark = prepare(docs.sparkSession)
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), (byte_length(text) + 8).alias("size"), F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"), F.xxhash64(*hashed).alias("order"),
    )
    found = [tuple(r) for r in cuts(rows, shards).collect()]  # one row an old shard
    limit = spark.createDataFrame(found, "old_shard int, cut long")
    kind = F.when(F.col("size") < F.col("cut"), BELOW).when(F.col("size") == F.col("cut"), AT).otherwise(ABOVE)
    rows = rows.join(F.broadcast(limit), "old_shard").withColumn("kind", kind).drop("cut")
    blocks = [tuple(r) for r in rows.groupBy("old_shard", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("size")).orderBy("old_shard", "kind").collect()]  # three rows an old shard
    filled, moves = defaultdict(int), []
    for old, which, new, a, b in plan_transfers(blocks, shards):
        moves.append((old, which, new, a, b, filled[new]))
        filled[new] += b - a
    plan = spark.createDataFrame(moves, "old_shard int, kind int, shard int, lo long, hi long, base long")
    n_buckets = max(8, sum(b[2] for b in blocks) // BUCKET_ROWS)
    ranked = numbered(rows, ["old_shard", "kind"], ["order", "text_crc32", "size"], n_buckets)
    # the plan has three rows a pair of shards at most, whatever the input
    out = ranked.join(F.broadcast(plan), ["old_shard", "kind"]).where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return out.select("row", "size", "text_crc32", "old_shard", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))


def rewrite_shards(placed: DataFrame, path: str) -> tuple[DataFrame, set[int]]:
    """Write the shards that gain or lose rows, with whole rows, as ``shard=N`` folders; returns what was written (row, old_shard, slot, shard) and those shards' numbers.

    Rows travel with their places, so keys may be null or repeat, and ``docs`` may have columns of any name.
    """
    moves = placed.where("shard <> old_shard").select("old_shard", "shard").distinct().collect()  # pairs of shards at most
    touched = {s for r in moves for s in r}
    rows = placed.where(F.col("shard").isin(sorted(touched))).select("row", "old_shard", "slot", "shard")
    rows.repartition("shard", F.floor(F.col("slot") / BUCKET_ROWS)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return placed.sparkSession.read.schema(rows.schema).parquet(path), touched


def reshard_and_rewrite(docs: DataFrame, old_shard: Column, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``reshard``, with the touched shards written and their rows read back from them; shards that keep all rows stay as they are.

    Columns: key, size, text_crc32, old_shard, shard, slot.
    """
    placed = reshard(docs, old_shard, shards, key, text)
    written, touched = rewrite_shards(placed, f"{shared_folder(docs.sparkSession).rstrip('/')}/tidemark/shards-{uuid.uuid4().hex}")
    text_of = F.col("row")[text].cast("string")
    size = F.coalesce(F.octet_length(text_of), F.lit(0)).cast("long") + 8
    back = written.select(F.col("row")[key].alias(key), size.alias("size"), F.crc32(F.coalesce(text_of, F.lit("")).cast("binary")).alias("text_crc32"), "old_shard", "shard", "slot")
    still = placed.where(~F.col("shard").isin(sorted(touched))).withColumn(key, F.col("row")[key])
    return back.unionByName(still.select(*back.columns)) if len(touched) < shards else back
