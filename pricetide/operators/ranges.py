"""Rows in ranges of an order: positions and stretches of a sorted table that no task has to sort as a whole."""

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.session import shared_folder


class Ranges:
    """The rows cut into ranges of `order`, written once, and how many rows each range has.

    Ranges come from a sample, so their number follows `spark.sql.shuffle.partitions` and their sizes are about alike; the
    driver gets one count per range. The order should be total, or equal rows are put in any order.
    """

    def __init__(self, rows: DataFrame, order: list[Column]):
        spark = rows.sparkSession
        number = int(spark.conf.get("spark.sql.shuffle.partitions"))
        path = f"{shared_folder(spark)}/pricetide/ranges/{uuid.uuid4().hex}"
        cut = rows.repartitionByRange(number, *order).sortWithinPartitions(*order)
        cut.withColumns({"range_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()}).write.parquet(path)
        self.rows, self.order = spark.read.parquet(path), order
        found = self.rows.groupBy("range_").agg(F.count(F.lit(1)).alias("n"), F.min("at_").alias("first")).collect()
        self.ranges, self.total = [], 0  # range, rows before it, its number of rows, its first mark
        for row in sorted(found, key=lambda row: row["range_"]):
            self.ranges.append((row["range_"], self.total, row["n"], row["first"]))
            self.total += row["n"]

    def numbered(self, name: str) -> DataFrame:
        """All rows with their position, from 1."""
        spark = self.rows.sparkSession
        shift = spark.createDataFrame([(number, before - first + 1) for number, before, _, first in self.ranges], "range_ int, shift_ long")
        # One row per range.
        placed = self.rows.join(F.broadcast(shift), "range_")
        return placed.withColumn(name, F.col("at_") + F.col("shift_")).drop("range_", "at_", "shift_")

    def stretch(self, skip: int, size: int) -> DataFrame:
        """The rows from position skip + 1 on, `size` at most, read from the ranges that have them."""
        held = [r for r in self.ranges if r[1] < skip + size and skip < r[1] + r[2]]
        if not held:
            return self.rows.limit(0).drop("range_", "at_")
        marks = [(first + max(0, skip - before), first + min(n, skip + size - before)) for _, before, n, first in held]
        inside = F.lit(False)
        for low, high in marks:
            inside = inside | ((F.col("at_") >= low) & (F.col("at_") < high))
        return self.rows.filter(F.col("range_").isin([r[0] for r in held]) & inside).drop("range_", "at_")
