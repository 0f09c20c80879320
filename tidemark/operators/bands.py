"""Bands that ratchet, as a scan over blocks of a symbol.

A band's step takes u to itself while r < u < c (r the new level, c the close
before), else to r. So over a block, u either comes through or the band starts
anew at the first row j with u <= r[j] or u >= c[j], and then ends at a value
that j alone decides. Only rows where r reaches a new maximum or c a new minimum
can be that row: they are a block's summary, and finding u among them applies
the whole block.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

SIDES = ("up", "dn")
LISTS = ("r_at", "r_from", "r_to", "c_at", "c_from", "c_to")


def ends(r: list[float], c: list[float]) -> list[float]:
    """Value at the end of a block of a band that starts anew at each of its rows."""
    n = len(r)
    out = [0.0] * n
    higher: list[int] = []  # rows to the right whose r no row between exceeds, nearest last
    low: list[float] = []  # falling minima of c to the right, nearest last; so they rise
    low_at: list[int] = []
    for j in range(n - 1, -1, -1):
        while higher and r[higher[-1]] < r[j]:
            higher.pop()
        k = bisect_right(low, r[j])  # the last of the minima that r[j] reaches is the nearest
        nxt = min(higher[-1] if higher else n, low_at[k - 1] if k else n)
        out[j] = out[nxt] if nxt < n else r[j]
        higher.append(j)
        while low and low[-1] >= c[j]:
            low.pop()
            low_at.pop()
        low.append(c[j])
        low_at.append(j)
    return out


def summary(r: np.ndarray, c: np.ndarray) -> dict[str, list]:
    """A block as rising maxima of r and falling minima of c: their values, rows and the block's end from there."""
    to = ends(r.tolist(), c.tolist())
    top = np.flatnonzero(np.r_[True, r[1:] > np.maximum.accumulate(r)[:-1]]) if len(r) else np.zeros(0, int)
    low = np.flatnonzero(np.r_[True, c[1:] < np.minimum.accumulate(c)[:-1]]) if len(c) else np.zeros(0, int)
    at = lambda rows: [to[i] for i in rows]
    return dict(zip(LISTS, (r[top].tolist(), top.tolist(), at(top), c[low].tolist(), low.tolist(), at(low)), strict=True))


def through(u: float, block: dict[str, list]) -> float:
    """What a block makes of the band ``u`` that comes in."""
    i = bisect_left(block["r_at"], u)
    j = bisect_left([-x for x in block["c_at"]], -u)
    a = block["r_from"][i] if i < len(block["r_from"]) else None
    b = block["c_from"][j] if j < len(block["c_from"]) else None
    if a is None and b is None:
        return u
    return block["r_to"][i] if b is None or a is not None and a <= b else block["c_to"][j]


def ratchet(rows: DataFrame, size: int) -> DataFrame:
    """symbol, ts, up_band, dn_band, trend, flip from symbol, ts, k (from 1), close, before, up and dn (the levels; dn with its sign changed).

    A null ``before`` starts both bands. The trend begins at 1, turns to 1 when the close is above the last lower
    band and to -1 when it is below the last upper one.
    """
    rows = rows.withColumn("k", F.col("k").cast("long")).withColumn("block", F.floor((F.col("k") - 1) / size))

    def parts(t: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        before = t["before"].to_numpy()
        first = np.isnan(before)
        return {s: (t[s].to_numpy(), np.where(first, -np.inf, before if s == "up" else -before)) for s in SIDES}

    lists = ", ".join(f"{s}_{x} array<{'int' if x.endswith('from') else 'double'}>" for s in SIDES for x in LISTS)

    def summarise(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        got = {f"{s}_{x}": [v] for s, (r, c) in parts(t).items() for x, v in summary(r, c).items()}
        kinds = {n: pa.list_(pa.int32() if n.endswith("from") else pa.float64()) for n in got}
        return pa.table({"symbol": [key[0].as_py()], "block": [key[1].as_py()]} | {n: pa.array(v, kinds[n]) for n, v in got.items()})

    blocks = rows.select("symbol", "block", "k", "before", *SIDES).groupBy("symbol", "block").applyInArrow(summarise, f"symbol string, block long, {lists}")

    def chain(key: tuple, t: pa.Table) -> pa.Table:
        """The bands that come into each block: one step a block."""
        t = t.sort_by("block")
        u, out = {s: 0.0 for s in SIDES}, {s: [] for s in SIDES}
        for x in t.to_pylist():
            for s in SIDES:
                out[s].append(u[s])
                u[s] = through(u[s], {n: x[f"{s}_{n}"] for n in LISTS})
        return pa.table({"symbol": t["symbol"], "block": t["block"]} | {f"{s}_in": pa.array(v, pa.float64()) for s, v in out.items()})

    come = blocks.groupBy("symbol").applyInArrow(chain, "symbol string, block long, up_in double, dn_in double")

    def replay(key: tuple, t: pa.Table) -> pa.Table:
        """Bands of a block's rows, and the trend from either state that may come in."""
        t = t.sort_by("k")
        first, close, level = t["k"][0].as_py() == 1, t["close"].to_pylist(), parts(t)
        band = {}
        for s, (r, c) in level.items():
            u, out = t[f"{s}_in"][0].as_py(), []
            for lo, hi in zip(r.tolist(), c.tolist(), strict=True):
                if not lo < u < hi:
                    u = lo
                out.append(u)
            band[s] = out
        plus, minus, a, b = [], [], 1, -1
        ups, dns = [t["up_in"][0].as_py(), *band["up"]], [-x for x in (t["dn_in"][0].as_py(), *band["dn"])]
        for i, x in enumerate(close):
            if first and not i:
                a = b = 1
            else:
                rise, fall = x > dns[i], x < ups[i]
                a, b = (1 if s < 0 and rise else -1 if s > 0 and fall else s for s in (a, b))
            plus.append(a)
            minus.append(b)
        last = [False] * (len(close) - 1) + [True]
        return pa.table({"symbol": t["symbol"], "ts": t["ts"].cast(kind), "k": t["k"], "up_band": band["up"], "dn_band": dns[1:], "plus": pa.array(plus, pa.int32()), "minus": pa.array(minus, pa.int32()), "last": last})

    met = rows.join(come, ["symbol", "block"])
    ts = rows.schema["ts"].dataType.simpleString()
    kind = to_arrow_type(rows.schema["ts"].dataType)  # times come in the session's zone, and Spark takes them back in UTC alone
    got = met.groupBy("symbol", "block").applyInArrow(replay, f"symbol string, ts {ts}, k long, up_band double, dn_band double, plus int, minus int, last boolean")
    return _trend(got)


def _trend(got: DataFrame) -> DataFrame:
    """Pick ``plus`` or ``minus`` by the state that comes into each block: blocks end in one state (known again), leave it, or turn it (counted)."""
    order = Window.partitionBy("symbol").orderBy("k")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    turns = F.when(F.col("last") & (F.col("plus") < 0) & (F.col("minus") > 0), 1).otherwise(0)
    got = got.withColumn("turns", F.sum(turns).over(upto))
    known = F.last(F.when(F.col("last") & (F.col("plus") == F.col("minus")), F.struct(F.col("plus").alias("v"), F.col("turns").alias("t"))), ignorenulls=True).over(before)
    got = got.withColumns({"known": known, "so_far": F.coalesce(F.lag("turns").over(order), F.lit(0))})
    state = F.coalesce(F.col("known.v"), F.lit(1)) * F.when((F.col("so_far") - F.coalesce(F.col("known.t"), F.lit(0))) % 2 == 0, 1).otherwise(-1)
    got = got.withColumn("trend", F.when(state > 0, F.col("plus")).otherwise(F.col("minus")))
    flip = F.when(F.col("trend") != F.lag("trend").over(order), F.col("trend")).otherwise(0)
    return got.withColumn("flip", flip).select("symbol", "ts", "up_band", "dn_band", "trend", "flip")
