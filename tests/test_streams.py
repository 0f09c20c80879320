"""Streams over several batches, each a restart from the checkpoint: state, timers, repeated bars, the sink's replay."""

from __future__ import annotations

import datetime

import pytest

from tidemark.streaming import bars as st
from tidemark.streaming import state
from tidemark.streaming.upsert import UpsertTable

T0 = datetime.datetime(2024, 1, 1)
HOUR = datetime.timedelta(hours=1)
BARS = "symbol string, ts timestamp, high double, low double, close double, volume double"


def bar(symbol, hour, close=1.0):
    close = float(close)
    return (symbol, T0 + hour * HOUR, close + 1, close - 1, close, 2.0)


def run(spark, tmp_path, batches, schema, make, start=None):
    """Give each batch to the stream in a run of its own; the rows in the sink after each."""
    source, sink, seen = str(tmp_path / "in"), str(tmp_path / "out"), []
    for rows in batches:
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(schema).parquet(source))
        (start(stream) if start else st.to_parquet(stream, sink)).trigger(availableNow=True).start().awaitTermination()
        if not start:
            seen.append(sorted(tuple(r) for r in spark.read.parquet(sink).collect()))
    return seen


def test_a_silent_symbol_alerts_when_the_watermark_passes(spark, tmp_path):
    one = [bar("a", h) for h in (0, 1, 2)] + [bar("b", h) for h in (0, 1)] + [bar("c", 0), bar("c", 2)]
    two = [bar("a", h) for h in (3, 4, 5, 5, 1)]  # b and c say nothing; a repeats a bar and brings a late one
    three = [bar("a", 6), bar("b", 7), bar("a", 7)]
    got = run(spark, tmp_path, [one, two, three], BARS, lambda s: state.gap_alerts(s, "1 hour", 3_600_000))
    due = lambda symbol, hour: (symbol, T0 + hour * HOUR, T0 + (hour + 1.5) * HOUR)
    assert got[0] == [due("c", 0)]  # the next bar shows it; at 2 hours with one of delay no watermark passes anything yet
    # watermark 4 hours: b's last bar at 1 and c's at 2 are over their time
    assert got[1] == [due("b", 1), due("c", 0), due("c", 2)]
    # watermark 6 hours: b came back after it was told, a and b are in time, c says nothing more
    assert got[2] == got[1]


def test_indicators_go_on_over_batches(spark, tmp_path):
    rows = [bar(s, h, 100 + (h * 7 % 11) + (3 if s == "b" else 0)) for h in range(30) for s in "ab"]
    make = lambda s: state.indicator_state(s, "1 hour", 5, 4, 2)
    (tmp_path / "one").mkdir()
    whole = run(spark, tmp_path / "one", [rows], BARS, make)[-1]
    (tmp_path / "many").mkdir()
    repeated = [rows[:20], rows[16:41], rows[41:]]  # the second batch brings four bars again
    assert run(spark, tmp_path / "many", repeated, BARS, make)[-1] == whole and len(whole) == 60 and any(r[-1] for r in whole)


def test_state_of_a_silent_symbol_goes(spark, tmp_path):
    batches = [[bar("a", 0, 10.0), bar("a", 1, 20.0)], [bar("b", 20)], [bar("b", 40)], [bar("a", 41, 50.0), bar("b", 41)]]
    got = run(spark, tmp_path, batches, BARS, lambda s: state.indicator_state(s, "1 hour", 3, 3, 1, ttl_ms=10 * 3_600_000))[-1]
    ema = {(r[0], r[1]): r[2] for r in got}
    assert ema["a", T0 + HOUR] == 15.0 and ema["a", T0 + 41 * HOUR] == 50.0  # it begins anew


FILLS = "symbol string, ts timestamp, seq long, quantity double, pnl double"


def test_positions_keep_symbols_of_earlier_batches(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "table"), ["symbol"], spark.createDataFrame([], st.KILL_OUT).schema, buckets=4)
    batches = [[("a", T0, 1, 2.0, -60.0), ("a", T0, 2, -3.0, 5.0)], [("b", T0 + HOUR, 3, 1.0, 1.0)], [("a", T0 + 2 * HOUR, 4, 4.0, 50.0), ("c", T0, 5, 1.0, 0.0)]]
    run(spark, tmp_path, batches, FILLS, lambda s: st.position_risk(s, 100.0, 0.5), lambda s: table.sink(s, str(tmp_path / "state")))
    got = {r.symbol: (r.net, r.gross, r.n_fills, r.equity, r.killed) for r in table.read().collect()}
    assert got == {"a": (3.0, 9.0, 3, 95.0, True), "b": (1.0, 1.0, 1, 101.0, False), "c": (1.0, 1.0, 1, 100.0, False)}


def test_upserts_can_be_replayed(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, v long").schema
    table = UpsertTable(spark, str(tmp_path / "table"), ["k"], schema, buckets=3)
    assert table.read().count() == 0
    rows = lambda *r: spark.createDataFrame(r, schema)
    see = lambda: sorted(tuple(r) for r in table.read().collect() if r.k is not None) + [tuple(r) for r in table.read().collect() if r.k is None]
    table.merge(rows(("a", 1), ("b", 1), (None, 1)), 0)
    table.merge(rows(("b", 2), ("c", 2)), 1)
    after = see()
    assert after == [("a", 1), ("b", 2), ("c", 2), (None, 1)]
    table.merge(rows(("b", 2), ("c", 2)), 1)  # the same batch again
    assert see() == after
    # a batch that fails before its manifest leaves what was there, and can be run again
    commit, table._commit = table._commit, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        table.merge(rows(("a", 3), (None, 3)), 2)
    assert see() == after
    table._commit = commit
    table.merge(rows(("a", 3), (None, 3)), 2)
    table.merge(rows(), 3)  # no rows
    assert see() == [("a", 3), ("b", 2), ("c", 2), (None, 3)]
    for k in range(4, 9):
        table.merge(rows(("d", k)), k)
    assert len(table._manifests()) == 2 and see()[-2] == ("d", 8)
    assert UpsertTable(spark, table.path, ["k"], schema, buckets=3).read().count() == 5
