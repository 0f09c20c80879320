"""Keyed state of bar streams: indicators that go on from bar to bar, and alerts of symbols that fall silent.

Both are ``transformWithState`` processors with one value of state a symbol in
RocksDB and event-time timers. Bars come with a watermark on ``ts``. Rows of a
symbol are taken in time order within a batch; a bar that isn't later than the
symbol's last one (a repeat, or out of order across batches) is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

INDICATORS = "n long, ema double, atr double, obv double, close double, hold int, last long, high double, low double, side int"
OUT = "symbol string, ts timestamp, ema double, atr double, obv double, ssl int, signal boolean"
ALERTS = "symbol string, ts timestamp, due timestamp"


def keyed_store(spark: SparkSession) -> None:
    """State variables and timers need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _sorted(frames: Iterator[pd.DataFrame], last: int | None) -> pd.DataFrame:
    """A batch's bars after ``last`` in time order, one a time, with ``at`` in milliseconds."""
    rows = pd.concat(list(frames))
    rows = rows.assign(at=rows["ts"].astype("datetime64[ms]").astype("int64")).sort_values("at", kind="stable").drop_duplicates("at", keep="last")
    return rows if last is None else rows[rows["at"] > last]


class IndicatorState(StatefulProcessor):
    """EMA, Wilder ATR, OBV, the SSL channel's side and a held cross signal.

    ATR is seeded with the mean of its first ranges, so it grows as a running mean until then. ssl is 1 or -1 by the
    last close beyond the averages of high or low (0 before). A symbol that is silent for ``ttl_ms`` of event time begins anew.
    """

    def __init__(self, n_ema: int, n_atr: int, hold: int, n_ssl: int, ttl_ms: int | None):
        self.n_ema, self.n_atr, self.hold, self.n_ssl, self.ttl_ms = n_ema, n_atr, hold, n_ssl, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("indicators", INDICATORS)

    def handleInputRows(self, key, rows, timerValues):
        s = tuple(self.state.get()) if self.state.exists() else None
        bars, out, step = _sorted(rows, s and s[6]), [], 2 / (self.n_ssl + 1)
        for r in bars.itertuples():
            if s is not None and self.ttl_ms is not None and r.at - s[6] > self.ttl_ms:
                s = None
            if s is None:
                s = (1, r.close, r.high - r.low, 0.0, r.close, 0, r.at, r.high, r.low, 0)
            else:
                n, ema, atr, obv, before, left, _, up, down, side = s
                tr, new = max(r.high - r.low, abs(r.high - before), abs(r.low - before)), ema + 2 / (self.n_ema + 1) * (r.close - ema)
                up, down = up + step * (r.high - up), down + step * (r.low - down)
                left = self.hold if before <= ema and r.close > new else max(0, left - 1)
                atr = (atr * n + tr) / (n + 1) if n < self.n_atr else (atr * (self.n_atr - 1) + tr) / self.n_atr
                s = (n + 1, new, atr, obv + (r.volume if r.close > before else -r.volume if r.close < before else 0.0), r.close, left, r.at, up, down, side)
            side = 1 if r.close > s[7] else -1 if r.close < s[8] else s[9]
            s = (*s[:9], side)
            out.append((key[0], r.ts, s[1], s[2], s[3], side, s[5] > 0))
        if len(bars):
            self.state.update(s)
            if self.ttl_ms is not None:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(int(s[6]) + self.ttl_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


class GapAlerts(StatefulProcessor):
    """One alert for each bar without a next one within ``wait_ms``: when the next bar shows it, or when the watermark passes."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("last", "last long, told boolean")

    def _alert(self, key, times: list[int]) -> pd.DataFrame:
        at = lambda ms: pd.to_datetime(pd.Series(ms, dtype="int64"), unit="ms")
        return pd.DataFrame({"symbol": pd.Series([key[0]] * len(times), dtype=object), "ts": at(times), "due": at([t + self.wait_ms for t in times])})

    def handleInputRows(self, key, rows, timerValues):
        last, told = tuple(self.state.get()) if self.state.exists() else (None, False)
        times = _sorted(rows, last)["at"].tolist()
        found = []
        for t in times:
            if last is not None and t - last > self.wait_ms and not told:
                found.append(last)
            last, told = t, False
        if times:
            self.state.update((last, False))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(last + self.wait_ms)
        yield self._alert(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, told = tuple(self.state.get())
        if not told and last + self.wait_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((last, True))
            yield self._alert(key, [last])

    def close(self) -> None:
        pass


def indicator_state(bars: DataFrame, late: str, n_ema: int, n_atr: int, hold: int, n_ssl: int = 12, ttl_ms: int | None = None) -> DataFrame:
    """symbol, ts, ema, atr, obv, ssl, signal of every bar (see ``IndicatorState``); bars need symbol, ts, high, low, close, volume."""
    keyed_store(bars.sparkSession)
    rows = bars.select("symbol", "ts", "high", "low", "close", "volume").withWatermark("ts", late)
    return rows.groupBy("symbol").transformWithStateInPandas(IndicatorState(n_ema, n_atr, hold, n_ssl, ttl_ms), OUT, "Append", "EventTime" if ttl_ms is not None else "None")


def gap_alerts(bars: DataFrame, late: str, expected_ms: int, times: float = 1.5) -> DataFrame:
    """symbol, ts, due: bars after which nothing came for ``times`` expected steps, the last bar of a silent symbol too (see ``GapAlerts``)."""
    keyed_store(bars.sparkSession)
    return bars.select("symbol", "ts").withWatermark("ts", late).groupBy("symbol").transformWithStateInPandas(GapAlerts(int(times * expected_ms)), ALERTS, "Append", "EventTime")
