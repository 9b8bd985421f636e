"""The stored tables as parquet folders, and the writes that the nightly job and the crawl make."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pricetide import schema
from pricetide.functions import text
from pricetide.functions.dates import utc_day
from pricetide.functions.money import iso_currency
from pricetide.operators.history import upsert, without_keys
from pricetide.operators.snapshots import daily_snapshots
from pricetide.session import files_for, sized_shuffles

SCHEMAS = {
    "price_history": schema.PRICE_HISTORY,
    "deal_scores": schema.DEAL_SCORES,
    "keywords": schema.KEYWORDS,
    "tracked_urls": schema.TRACKED_URLS,
    "favorites": schema.FAVORITES,
}


# Superseded versions of a table that stay, for readers that began on them.
KEPT_VERSIONS = 3

# More days than this in one batch are taken for wrong clocks.
MOST_DAYS = 36_525


class Tables:
    """Tables under one folder that all executors see.

    `items_raw` is partitioned by day and rewritten day by day. Every other table is replaced as a whole: each write
    goes to a new version folder, and readers take the newest one that was finished, so a job that dies half-way
    leaves the old table in force and can simply be run again. Readers that began on an older version find it for
    KEPT_VERSIONS more writes; then it is deleted. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, *parts: str) -> bool:
        files, path = self._path(*parts)
        return files.exists(path)

    def size(self, name: str) -> int:
        """Bytes stored for a table, all versions included."""
        files, path = self._path(name)
        return files.getContentSummary(path).getLength() if files.exists(path) else 0

    def _names(self, *parts: str) -> list[str]:
        files, path = self._path(*parts)
        return [status.getPath().getName() for status in files.listStatus(path)] if files.exists(path) else []

    def _versions(self, name: str) -> list[int]:
        return sorted(int(found[2:]) for found in self._names(name) if found.startswith("v="))

    def _read(self, table_schema: StructType, *parts: str) -> DataFrame:
        return self.spark.read.schema(table_schema).parquet("/".join((self.folder, *parts)))

    def read(self, name: str) -> DataFrame:
        """The newest finished version; empty where there is none yet."""
        done = [v for v in self._versions(name) if self._exists(name, f"v={v}", "_SUCCESS")]
        if not done:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self._read(SCHEMAS[name], name, f"v={done[-1]}")

    def replace(self, name: str, rows: DataFrame, counted: str = "count(1)") -> int:
        """Write a new version and return a count over its rows, taken while writing."""
        version = max(self._versions(name), default=0) + 1
        seen = Observation()
        columns = [F.col(field.name).cast(field.dataType) for field in SCHEMAS[name]]
        watched = rows.observe(seen, F.expr(counted).alias("rows")).select(*columns)
        watched.write.mode("overwrite").parquet(f"{self.folder}/{name}/v={version}")
        for old in self._versions(name):
            if old < version - KEPT_VERSIONS:
                files, path = self._path(name, f"v={old}")
                files.delete(path, True)
        return seen.get["rows"]

    def stage(self, name: str, rows) -> DataFrame:
        """The rows that `rows()` gives, written under a name; a repeat reads them back instead."""
        if not self._exists("staged", name, "_SUCCESS"):
            rows().write.mode("overwrite").parquet("/".join((self.folder, "staged", name)))
        return self.spark.read.parquet("/".join((self.folder, "staged", name)))

    def items(self) -> DataFrame:
        """All (url, day) rows. Filters on `day` prune folders."""
        if not self._exists("items_raw"):
            return self.spark.createDataFrame([], schema.ITEMS_RAW)
        return self._read(schema.ITEMS_RAW, "items_raw")

    def save_snapshots(self, log: DataFrame, batch: str) -> None:
        """Merge visits into their days. `batch` names the input; saving the same batch again changes nothing.

        Visits without `seq` get one from their fields, so that a repeat orders them alike. The days of the log are
        looked up first, one row per calendar day, and reach the scan of the stored table as literals: of that table
        only these days are read.
        """
        if self._exists("saved", batch):
            return
        fields = [field.name for field in schema.SNAPSHOT_LOG]
        if "seq" not in log.columns:
            log = log.withColumn("seq", F.xxhash64(*[name for name in fields if name != "seq"]))
        days = self._days(log.select(utc_day(F.col("scrapedAt")).alias("day")))
        touched = self.items().filter(F.col("day").isin(days))
        every = log.select(*fields, F.lit(True).alias("fresh")).unionByName(touched.select(*fields, F.lit(False).alias("fresh")))
        with sized_shuffles(self.spark, self._day_bytes(days)):
            self._replace_days(daily_snapshots(every), batch, touched)

    def _days(self, rows: DataFrame) -> list:
        """The distinct days of the rows, refused if they are more than any record of visits can have."""
        found = rows.filter(F.col("day").isNotNull()).distinct().limit(MOST_DAYS + 1).collect()
        if len(found) > MOST_DAYS:
            raise ValueError(f"visits of more than {MOST_DAYS} days: check their times")
        return sorted(row.day for row in found)

    def _day_bytes(self, days: list) -> int:
        return sum(self.size(f"items_raw/day={day}") for day in days)

    def migrate_legacy(self, name: str = "migration") -> int:
        """Rewrite the days that hold legacy values; returns the number of rows changed.

        `name` tells migrations apart. A repeat of one that broke off in its copy goes on from the rows it had
        finished, and gives their count; a repeat of one that was finished gives 0.
        """
        if self._exists("saved", name):
            return 0
        checked = migrated_items(self.items())
        staged = ("merged", name)
        if not self._exists(*staged, "_SUCCESS"):
            days = self._days(checked.filter("changed").select("day"))
            checked = checked.filter(F.col("day").isin(days))
            checked.withColumnRenamed("changed", "fresh").write.mode("overwrite").parquet("/".join((self.folder, *staged)))
        marked = self.spark.read.parquet("/".join((self.folder, *staged)))
        changed = marked.filter("fresh").count()
        self._replace_days(marked, name, marked)
        return changed

    def pending(self, reader: str) -> list[str]:
        """The batches whose changes the reader has not taken in yet."""
        saved, taken = set(self._names("saved")), set(self._names("taken", reader))
        return sorted(name for name in self._names("changes") if name in saved and name not in taken)

    def changes(self, batches: list[str]) -> DataFrame:
        """(url, day, oldKeyword, oldAmount, replaced, number) of the daily rows that the batches brought or replaced. What a
        row is now is in `items`; what it was before them all is said by the change with the smallest number."""
        if not batches:
            return self.spark.createDataFrame([], schema.CHANGES)
        return self.spark.read.schema(schema.CHANGES).parquet(*[f"{self.folder}/changes/{name}" for name in batches])

    def take(self, reader: str, batches: list[str]) -> None:
        """Note that the reader has taken in these batches."""
        for name in batches:
            files, path = self._path("taken", reader, name)
            files.create(path).close()

    def _replace_days(self, rows: DataFrame, batch: str, old: DataFrame, bytes_per_file: int = 256 * 2**20) -> None:
        """Put whole days in place of the stored ones.

        The days are written beside the table first and copied in from there. If the copy breaks off, a repeat starts
        from the finished rows, not from half-replaced days. Before the copy, rows marked `fresh` are listed as changes,
        with the keyword that the stored row had.

        The copy goes by ranges of (day, url), in a number that follows the size written: a large day gets many files,
        small days share a task, and each file holds a narrow range of urls, which scans for one url can skip by.
        """
        done, staged = ("saved", batch), ("merged", batch)
        if self._exists(*done):
            return
        if not self._exists(*staged, "_SUCCESS"):
            rows.write.mode("overwrite").parquet("/".join((self.folder, *staged)))
        if not self._exists("changes", batch, "_SUCCESS"):
            fresh = self.spark.read.parquet("/".join((self.folder, *staged))).filter("fresh").select("url", "day")
            before = old.select(
                "url", "day", F.col("keyword").alias("oldKeyword"), F.col("price.amount").alias("oldAmount"), F.lit(True).alias("replaced")
            )
            listed = fresh.join(before, ["url", "day"], "left").fillna(False, ["replaced"])
            listed.withColumn("number", F.lit(len(self._names("saved"))).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/changes/{batch}")
        (
            self._read(schema.ITEMS_RAW, *staged)
            .repartitionByRange(files_for(self.spark, self.size("/".join(staged)), bytes_per_file), "day", "url")
            .sortWithinPartitions("day", "url")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("day")
            .parquet(f"{self.folder}/items_raw")
        )
        files, path = self._path(*done)
        files.create(path).close()
        files, path = self._path(*staged)
        files.delete(path, True)

    def save_history(self, fresh: DataFrame) -> int:
        """Upsert by url; returns the number of products that came in."""
        return self.replace("price_history", upsert(self.read("price_history"), fresh), "count_if(fresh)")

    def save_scores(self, scores: DataFrame) -> int:
        """The scores of this run, and no others, even if there are none."""
        return self.replace("deal_scores", scores)

    def delete_products(self, dead: DataFrame) -> None:
        """From histories and scores, not from the daily rows."""
        for name in ("price_history", "deal_scores"):
            self.replace(name, without_keys(self.read(name), dead))


def migrated_items(items: DataFrame) -> DataFrame:
    """Currency symbols to ISO codes and image urls to full size; `changed` marks rows that differ."""

    def iso(money):
        code = F.coalesce(iso_currency(money["currency"]), money["currency"])
        return F.when(money.isNotNull(), money.withField("currency", code))

    images = F.when(F.size("images") > 0, text.high_res_images(F.col("images"))).otherwise(F.col("images"))
    new = {"price": iso(F.col("price")), "crossedOutPrice": iso(F.col("crossedOutPrice")), "images": images}
    changed = F.lit(False)
    for name, value in new.items():
        changed = changed | ~value.eqNullSafe(F.col(name))
    return items.withColumn("changed", changed).withColumns(new)
