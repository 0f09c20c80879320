"""Structured Streaming: bars, duplicates and positions (indicators and gaps are in ``state``, the sink of totals in ``upsert``).

Event times are TIMESTAMP in a UTC session; watermarks bound the state of every
operator, and keyed state holds a few numbers a symbol instead of its history.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def closed_bars(ticks: DataFrame, every: str, late: str) -> DataFrame:
    """Bars that the watermark has closed; later ticks are dropped. Ticks need symbol, ts, seq, price, volume."""
    order = F.struct("ts", "seq")
    bars = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", every).alias("w")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def dedup(bars: DataFrame, late: str) -> DataFrame:
    """One row for each (symbol, ts) within the watermark."""
    return bars.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "ts"])


def position_totals(fills: DataFrame) -> DataFrame:
    """Running net and gross quantity and fills of each symbol (update or complete mode)."""
    return fills.groupBy("symbol").agg(F.sum("quantity").alias("net"), F.sum(F.abs("quantity")).alias("gross"), F.count("*").alias("n_fills"))


KILL_STATE = "net double, gross double, n_fills long, equity double, peak double, killed boolean"
KILL_OUT = "symbol string, net double, gross double, n_fills long, equity double, drawdown double, killed boolean"


def position_risk(fills: DataFrame, capital: float, kill: float) -> DataFrame:
    """As ``position_totals``, with equity (capital and ``pnl`` so far), its drawdown from the peak, and ``killed``, which stays from the first drawdown of ``kill`` on.

    Fills need symbol, ts, seq, quantity, pnl and are taken by (ts, seq) within a batch; one row a symbol and batch (update mode).
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        net, gross, n, equity, peak, killed = state.get if state.exists else (0.0, 0.0, 0, capital, capital, False)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        curve = equity + rows["pnl"].cumsum()
        tops = curve.cummax().clip(lower=peak)
        killed = bool(killed or ((1 - curve / tops) >= kill).any())
        net, gross, n = net + float(rows["quantity"].sum()), gross + float(rows["quantity"].abs().sum()), n + len(rows)
        equity, peak = float(curve.iloc[-1]), float(tops.iloc[-1])
        state.update((net, gross, n, equity, peak, killed))
        yield pd.DataFrame([(key[0], net, gross, n, equity, 1 - equity / peak, killed)], columns=[c.split()[0] for c in KILL_OUT.split(", ")])

    return fills.groupBy("symbol").applyInPandasWithState(run, KILL_OUT, KILL_STATE, "update", GroupStateTimeout.NoTimeout)  # open positions don't time out


def to_parquet(stream: DataFrame, path: str, mode: str = "append"):
    """A writer of a stream's results to Parquet with exactly-once commits, its state beside them."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", f"{path}-state")
