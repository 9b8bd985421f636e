"""What the operators of this package share: written tables, slots within groups, the held-out fold."""

from __future__ import annotations

import sys
import types
import uuid

import pricetide
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricetide.session import shared_folder

# The functions that tasks run travel with the job, so that executors need not have the package installed.
cloudpickle.register_pickle_by_value(pricetide)

NO_ID = 2**63 - 1


def kept_in_worker(name: str, make):
    """An object that the tasks of a Python worker share: made once per worker, not per task.

    A worker outlives stages and queries, so it keeps one object only: the next name lets go of the one before.
    """
    held = sys.modules.setdefault("pricetide_worker_objects", types.ModuleType("pricetide_worker_objects")).__dict__
    if held.get("kept_name") != name:
        held.pop("kept", None)
        held["kept"], held["kept_name"] = make(), name
    return held["kept"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(frame: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: later steps start there, also after lost executors."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/pricetide-llm/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_slots(frame: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in the given order; a group may hold any share of the rows.

    The rows are range-sorted by (group, order), so a large group lies in many partitions. What is counted is one row
    per partition and group, of which there are at most partitions + groups: that bounds the broadcast.
    """
    spark = frame.sparkSession
    at, part = "__at", "__part"
    ordered = frame.repartitionByRange(shuffle_partitions(spark), group, *order).sortWithinPartitions(group, *order)
    ordered = stored(ordered.withColumn(at, F.monotonically_increasing_id()))
    ordered = ordered.withColumn(part, F.shiftright(at, 33))
    counts = ordered.groupBy(part, group).agg(F.min(at).alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    counts = counts.select(part, F.col(group).alias("__group"), "__first", "__before")
    joined = ordered.join(F.broadcast(counts), (ordered[part] == counts[part]) & ordered[group].eqNullSafe(counts["__group"]))
    slot = (F.col(at) - F.col("__first") + F.col("__before")).cast("long")
    return joined.select(*[ordered[c] for c in frame.columns], slot.alias(name))


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns labels from; rows without an id are not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(rows: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most `limit` labelled rows outside the held-out fold, as (*rows, label), chosen by a hash of the id.

    This bounds what a model is fitted on, nothing else. Of several labels of an id the largest counts.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return rows.join(F.broadcast(known), "doc_id")
