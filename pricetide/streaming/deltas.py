"""Visits taken in by a stream with state; what is new is appended, and merged into the days by a compaction."""

import hashlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pricetide import schema
from pricetide.functions.dates import utc_day
from pricetide.operators.snapshots import daily_snapshots
from pricetide.sources.tables import Tables

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# How long the last visit of a (url, day) is remembered after it was seen.
REMEMBERED_MS = 48 * 3600 * 1000

# Parts that the urls of a day are kept in: Python is called once per part and micro-batch, not once per url.
PARTS = 64

# A table of (url, at, seq, until): time in microseconds and number of the last visit, and when it is forgotten, in milliseconds.
LAST = T.StructType([T.StructField("table", T.BinaryType()), T.StructField("next", T.LongType())])
ORDERED = ["at", "seq"]


def _packed(known: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    rows = pa.Table.from_pandas(known, preserve_index=False)
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(table: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(table)).read_all().to_pandas()


def _last(rows: pd.DataFrame) -> pd.DataFrame:
    """The row of the last visit of each url. Of equal visits any is as good as the other."""
    return rows.sort_values(ORDERED, kind="stable").drop_duplicates("url", keep="last")


class LastVisit(StatefulProcessor):
    """Hands on the visits that are later than all that were seen of their (url, day), at most one of each per micro-batch.

    The key is a day and a part of its urls. The state is a table with the order of the last visit of each url. A timer
    drops the urls of a day that had no visit for so long, by the times at which micro-batches came in. After that an old
    visit may come out once more, which the merge of the days does not mind.
    """

    def __init__(self, remembered_ms: int = REMEMBERED_MS):
        self.remembered_ms = remembered_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("lasts", LAST)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        stored = self.last.get() if self.last.exists() else None
        new, until = [], {}
        for batch in rows:
            new = [_last(pd.concat([*new, batch[["url", *ORDERED, "visit"]]]))]
            for url, at in batch.groupby("url")["arrived_ms"].max().items():
                until[url] = max(until.get(url, 0), int(at) + self.remembered_ms)
        fresh = new[0]
        seen = pd.DataFrame({"url": list(until), "until": pd.Series(list(until.values()), dtype="int64")})
        fresh = fresh.merge(seen, on="url")
        if stored:
            known = _unpacked(stored[0])
            before = fresh[["url"]].merge(known, on="url", how="left")
            at, seq = fresh["at"].to_numpy(), fresh["seq"].to_numpy()
            old_at, old_seq = (before[name].astype("Int64") for name in ORDERED)
            later = (old_at.isna() | (old_at < at) | ((old_at == at) & (old_seq < seq))).fillna(True).to_numpy(dtype=bool)
            # Urls with nothing later keep their order and are remembered for longer.
            again = known[known["url"].isin(fresh["url"][~later])].drop(columns="until").merge(seen, on="url")
            untouched = known[~known["url"].isin(fresh["url"])]
            fresh = fresh[later]
            kept = pd.concat([untouched, again, fresh.drop(columns="visit")], ignore_index=True)
            self.handle.deleteTimer(stored[1])
        else:
            kept = fresh.drop(columns="visit")
        self._keep(kept)
        if len(fresh):
            yield fresh[["visit"]].reset_index(drop=True)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        known = _unpacked(self.last.get()[0])
        self._keep(known[known["until"] > expiredTimerInfo.getExpiryTimeInMs()])
        yield from ()

    def _keep(self, known: pd.DataFrame) -> None:
        if not len(known):
            self.last.clear()
            return
        following = int(known["until"].min())
        self.handle.registerTimer(following)
        self.last.update((_packed(known[["url", *ORDERED, "until"]]), following))

    def close(self) -> None:
        pass


def save_deltas(
    log: DataFrame, tables: Tables, checkpoint: str, name: str = "stream", remembered_ms: int = REMEMBERED_MS, **trigger: Any
) -> StreamingQuery:
    """Append the visits of each micro-batch that are the last of their (url, day) so far, one folder per batch.

    No stored day is read or rewritten: that is left to `compact_deltas`. The state knows the last visit of the days that
    are still being visited, so repeated and older visits are not written again. A batch that is replayed after a failure
    overwrites its own folder. Visits without url or time are dropped, as they belong to no day. Without `seq`, one is made
    from the fields.
    """
    spark = tables.spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    fields = [field.name for field in schema.SNAPSHOT_LOG]
    if "seq" not in log.columns:
        log = log.withColumn("seq", F.xxhash64(*[name for name in fields if name != "seq"]))
    keyed = log.filter(F.col("url").isNotNull() & F.col("scrapedAt").isNotNull()).select(
        "url", utc_day(F.col("scrapedAt")).alias("day"), F.unix_micros("scrapedAt").alias("at"), F.coalesce("seq", F.lit(-(2**63))).alias("seq"),
        F.to_json(F.struct(*[F.unix_micros("scrapedAt").alias(name) if name == "scrapedAt" else F.col(name) for name in fields])).alias("visit"),
        F.pmod(F.xxhash64("url"), F.lit(PARTS)).alias("part"), F.current_timestamp().alias("arrived"))
    # Visits may be as late as they like: only the clock of their arrival, which is never late, lets state expire.
    keyed = keyed.withColumn("arrived_ms", F.unix_millis("arrived")).withWatermark("arrived", "0 seconds")
    found = keyed.groupBy("day", "part").transformWithStateInPandas(
        LastVisit(remembered_ms), T.StructType([T.StructField("visit", T.StringType())]), "Append", "EventTime")
    packed = T.StructType([T.StructField(f.name, T.LongType()) if f.name == "scrapedAt" else f for f in schema.SNAPSHOT_LOG])

    def append(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.from_json("visit", packed).alias("v")).select("v.*").withColumn("scrapedAt", F.timestamp_micros("scrapedAt"))
        rows.write.mode("overwrite").parquet(f"{tables.folder}/deltas/{name}-{number}")

    return (
        found.writeStream.foreachBatch(append)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _deltas(tables: Tables, names: list[str]) -> DataFrame:
    return tables.spark.read.schema(schema.SNAPSHOT_LOG).parquet(*[f"{tables.folder}/deltas/{name}" for name in names])


def _finished(tables: Tables) -> list[str]:
    return [name for name in tables._names("deltas") if tables._exists("deltas", name, "_SUCCESS")]


def items_now(tables: Tables) -> DataFrame:
    """The stored days with what was appended since; the same rows before and after a compaction."""
    names = _finished(tables)
    if not names:
        return tables.items()
    fields = [field.name for field in schema.SNAPSHOT_LOG]
    return daily_snapshots(tables.items().select(*fields).unionByName(_deltas(tables, names))).select(*schema.ITEMS_RAW.names)


def compact_deltas(tables: Tables, at_least: int = 1) -> int:
    """Merge what was appended into the days, if it is `at_least` so many micro-batches; returns how many it was.

    One merge for all of them: a day is rewritten once, however many batches had visits of it. If it breaks off before
    the folders are gone, the next one merges them again, which changes nothing.
    """
    names = _finished(tables)
    if len(names) < at_least or not names:
        return 0
    # A repeat of a merge that broke off goes on from it only if it is about the same folders.
    which = hashlib.sha256("/".join(sorted(names)).encode()).hexdigest()[:16]
    tables.save_snapshots(_deltas(tables, names), f"compacted-{len(tables._names('saved'))}-{which}")
    for name in names:
        files, path = tables._path("deltas", name)
        files.delete(path, True)
    return len(names)
