"""Stored tables in buckets of their key: some keys are read and rewritten without the rest."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.session import files_for
from pricetide.sources.tables import Tables

BUCKETS = 64


class Buckets:
    """A table whose rows lie in one folder per hash of their key.

    The hash is taken from the value alone, so a filter on one key becomes a literal that the scan prunes folders by, and
    a change rewrites the folders of the keys it touches. The number of buckets is fixed by the first write: take so many
    that one is a comfortable job. Within a folder rows are sorted by `order` and cut into files by size, so a key with a
    third of all rows is many files, and files and row groups that lack a key are skipped. Rows alike in `order` are cut
    by the hash of `ties`, if given, so that they too may be many files; they are not sorted by it.

    A write is staged first and copied over by dynamic overwrite; `resume` ends a copy that broke off.
    """

    def __init__(self, tables: Tables, name: str, table_schema: T.StructType, key: str, order: list[str], buckets: int = BUCKETS, ties: list[str] = ()):
        self.tables, self.name, self.schema, self.key, self.order, self.ties = tables, name, table_schema, key, order, ties
        marks = [found for found in tables._names(name) if found.startswith("_buckets_")]
        self.exists = bool(marks)
        self.number = int(marks[0].removeprefix("_buckets_")) if marks else buckets

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.number)).cast("int")

    def of(self, keys: DataFrame) -> list[int]:
        """The buckets of the keys in a column named as the key: at most as many as there are."""
        found = keys.select(self.bucket(F.col(self.key)).alias("bucket")).distinct().collect()
        return sorted(row.bucket for row in found)

    def read(self, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        if not self.exists:
            return self.tables.spark.createDataFrame([], self.schema)
        placed = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        rows = self.tables._read(placed, self.name)
        return (rows if only is None else rows.filter(F.col("bucket").isin(only))).drop("bucket")

    def read_key(self, value: str) -> DataFrame:
        """The rows of one key: one folder, and in it the files and row groups that may have the key."""
        if not self.exists:
            return self.read()
        placed = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        rows = self.tables._read(placed, self.name)
        return rows.filter((F.col("bucket") == self.bucket(F.lit(value))) & (F.col(self.key) == value)).drop("bucket")

    def replace(self, rows: DataFrame, touched: list[int], counted: str = "count(1)", reader: str = "", batches: list[str] = ()) -> int:
        """Put the rows in place of the touched buckets, of which they are the whole new contents; returns a count over
        them, taken while they are staged. With the copy the reader has taken in the batches: both happen, or neither."""
        seen = Observation()
        columns = [F.col(field.name).cast(field.dataType) for field in self.schema]
        staged = rows.observe(seen, F.expr(counted).alias("rows")).select(*columns, self.bucket(F.col(self.key)).alias("bucket"))
        listed = [(number, None, None) for number in touched] + [(None, reader, batch) for batch in batches]
        marks = self.tables.spark.createDataFrame(listed, "bucket int, reader string, batch string")
        marks.coalesce(1).write.mode("overwrite").parquet(f"{self.tables.folder}/staged/{self.name}.touched")
        staged.write.mode("overwrite").parquet(f"{self.tables.folder}/staged/{self.name}.rows")
        self._copy()
        return seen.get["rows"]

    def resume(self) -> None:
        """End the copy of a finished stage."""
        if self.tables._exists("staged", f"{self.name}.rows", "_SUCCESS"):
            self._copy()

    def _copy(self, bytes_per_file: int = 256 * 2**20) -> None:
        tables, rows, marks = self.tables, f"staged/{self.name}.rows", f"staged/{self.name}.touched"
        placed = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        staged = tables._read(placed, rows)
        if not self.exists:
            files, mark = tables._path(self.name, f"_buckets_{self.number}")
            files.create(mark).close()
            self.exists = True
        ranges = ["bucket", *self.order, *([F.xxhash64(*self.ties)] if self.ties else [])]
        (
            staged.repartitionByRange(files_for(tables.spark, tables.size(rows), bytes_per_file), *ranges)
            .sortWithinPartitions("bucket", *self.order)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket")
            .parquet(f"{tables.folder}/{self.name}")
        )
        # Buckets without rows are not overwritten but emptied.
        listed = tables.spark.read.parquet(f"{tables.folder}/{marks}").collect()
        touched = {row.bucket for row in listed if row.bucket is not None}
        for row in listed:
            if row.batch is not None:
                tables.take(row.reader, [row.batch])
        filled = {row.bucket for row in staged.select("bucket").distinct().collect()}
        for name in [*(f"{self.name}/bucket={number}" for number in touched - filled), rows, marks]:
            files, path = tables._path(name)
            files.delete(path, True)
