"""The stream with state against the same visits saved as one batch."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from pricetide import schema
from pricetide.operators.snapshots import daily_snapshots
from pricetide.sources.tables import Tables
from pricetide.streaming import deltas
from test_history import visit

START = dt.datetime(2024, 6, 1, 9)


@pytest.fixture
def tables(spark):
    return Tables(spark, tempfile.mkdtemp(prefix="run-"))


def shown(rows):
    return sorted(map(str, rows.select(*schema.ITEMS_RAW.names).collect()))


def test_late_repeated_and_unordered_visits(spark, tables):
    """Three runs over files that repeat visits, bring older ones, and come in any order, with a restart before each."""
    rng = random.Random(4)
    source, checkpoint = tempfile.mkdtemp(prefix="run-"), tempfile.mkdtemp(prefix="run-")
    every = [
        visit(f"u{rng.randrange(5)}", START + dt.timedelta(days=rng.randrange(4), minutes=rng.randrange(30)), i, title=rng.choice([None, "a \"title\" é"]),
              price=rng.choice([None, (rng.random() * 100, "EUR")]), keyword=rng.choice([None, "k"]))
        for i in range(60)
    ]
    seen = []
    for run in range(3):
        for _ in range(2):
            rows = rng.sample(every, 25)
            seen += rows
            spark.createDataFrame(rows, schema.SNAPSHOT_LOG).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema.SNAPSHOT_LOG).option("maxFilesPerTrigger", 1).parquet(source)
        deltas.save_deltas(stream, tables, checkpoint).awaitTermination()
        want = shown(daily_snapshots(spark.createDataFrame(seen, schema.SNAPSHOT_LOG)))
        assert shown(deltas.items_now(tables)) == want
        if run == 1:
            assert deltas.compact_deltas(tables, at_least=99) == 0
            assert deltas.compact_deltas(tables) >= 4 and deltas.compact_deltas(tables) == 0
            assert shown(tables.items()) == want == shown(deltas.items_now(tables))
    # What the state knows is not appended again, and stored days are not written by the stream.
    spark.createDataFrame(seen, schema.SNAPSHOT_LOG).coalesce(1).write.mode("append").parquet(source)
    before = deltas._finished(tables)
    times = {f: os.stat(os.path.join(r, f)).st_mtime_ns for r, _, fs in os.walk(f"{tables.folder}/items_raw") for f in fs}
    stream = spark.readStream.schema(schema.SNAPSHOT_LOG).parquet(source)
    deltas.save_deltas(stream, tables, checkpoint).awaitTermination()
    new = sorted(set(deltas._finished(tables)) - set(before))
    assert sum(deltas._deltas(tables, [n]).count() for n in new) == 0
    assert times == {f: os.stat(os.path.join(r, f)).st_mtime_ns for r, _, fs in os.walk(f"{tables.folder}/items_raw") for f in fs}


def test_forgotten_visits_change_nothing(spark, tables):
    """With a state that expires at once, repeats are appended again, and the merged days stay the same."""
    source, checkpoint = tempfile.mkdtemp(prefix="run-"), tempfile.mkdtemp(prefix="run-")
    rows = [visit("u", START, 2, title="b"), visit("u", START, 1, title="a"), (None, *visit("u", START, 1)[1:])]
    for _ in range(2):
        spark.createDataFrame(rows, schema.SNAPSHOT_LOG).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema.SNAPSHOT_LOG).parquet(source)
        deltas.save_deltas(stream, tables, checkpoint, remembered_ms=1).awaitTermination()
        assert [r.title for r in deltas.items_now(tables).collect()] == ["b"]
    deltas.compact_deltas(tables)
    assert [r.title for r in tables.items().collect()] == ["b"]
    assert spark.createDataFrame(rows[:1], schema.SNAPSHOT_LOG).select(F.max("scrapedAt")).first()[0] == START


def test_one_call_takes_in_all_urls_of_a_part():
    """Python is called per part of a day, not per url: what a call does for each of its urls, and what it forgets."""
    from types import SimpleNamespace

    import pandas as pd

    state, timers = {}, set()
    last = SimpleNamespace(
        exists=lambda: "v" in state, get=lambda: state["v"], update=lambda v: state.update(v=v), clear=lambda: state.clear())
    visits = deltas.LastVisit(remembered_ms=100)
    visits.init(SimpleNamespace(getValueState=lambda *_: last, registerTimer=timers.add, deleteTimer=timers.remove))

    def put(arrived, *rows):
        batch = pd.DataFrame([(*row, f"{row}") for row in rows], columns=["url", "at", "seq", "visit"]).assign(arrived_ms=arrived)
        halves = iter([batch.iloc[::2], batch.iloc[1::2]]) if len(batch) > 1 else iter([batch])
        return sorted(v for out in visits.handleInputRows(("d", 0), halves, None) for v in out["visit"])

    assert put(0, ("a", 2, 1), ("b", 5, 0), ("a", 2, 2), ("a", 1, 9)) == ["('a', 2, 2)", "('b', 5, 0)"]
    assert put(10, ("a", 2, 2), ("a", 2, 1), ("c", 1, -(2**63))) == [f"('c', 1, {-(2**63)})"]
    assert put(20, ("a", 2, 3), ("c", 1, -(2**63))) == ["('a', 2, 3)"]
    assert timers == {100}
    timers.clear()
    assert list(visits.handleExpiredTimer(("d", 0), None, SimpleNamespace(getExpiryTimeInMs=lambda: 100))) == []
    # b is forgotten, a and c are not.
    assert timers == {120} and put(30, ("b", 1, 1), ("a", 2, 3), ("c", 1, 0)) == ["('b', 1, 1)", "('c', 1, 0)"]
    timers.clear()
    list(visits.handleExpiredTimer(("d", 0), None, SimpleNamespace(getExpiryTimeInMs=lambda: 130)))
    assert not state and not timers


def test_merge_that_broke_off(spark, tables, monkeypatch):
    save = lambda n, day: spark.createDataFrame([visit("u", START + dt.timedelta(days=day), day, title=str(day))], schema.SNAPSHOT_LOG).write.parquet(f"{tables.folder}/deltas/{n}")
    save("s-0", 0)

    def lost(*_):
        raise OSError("executor lost")

    read = Tables._read
    monkeypatch.setattr(Tables, "_read", lambda self, s, *parts: lost() if parts[0] == "merged" else read(self, s, *parts))
    with pytest.raises(OSError):
        deltas.compact_deltas(tables)
    monkeypatch.setattr(Tables, "_read", read)
    save("s-1", 1)
    assert deltas.compact_deltas(tables) == 2 and tables.items().count() == 2
