"""From visits to one row per (url, day), and the newest row of each product."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.dates import utc_day

# Fields of a stored row that describe the product at that moment.
ROW_FIELDS = (
    "title", "price", "crossedOutPrice", "unitPrice", "deliveryDate", "images", "shop", "keyword", "scrapedAt",
)


def _first_row(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key. Spark keeps one row per key and task before it shuffles, however many a key has,
    and reads only the columns that are asked of the result later on."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") == 1).drop("rn")


def daily_snapshots(log: DataFrame) -> DataFrame:
    """The last visit of each (url, day), ordered by (scrapedAt, seq), with all its fields.

    Idempotent, so stored rows can be merged by adding them to the log.
    """
    dated = log.withColumn("day", utc_day(F.col("scrapedAt")))
    return _first_row(dated, ["url", "day"], F.desc("scrapedAt"), F.desc("seq"))


def latest(items: DataFrame, *keys: str, fields=ROW_FIELDS) -> DataFrame:
    """A2, A3: the newest row per key by (day, scrapedAt), null fields kept as they are."""
    names = [name for name in fields if name not in keys]
    return _first_row(items, list(keys), F.desc("day"), F.desc("scrapedAt")).select(*keys, "day", *names)


def usable(products: DataFrame) -> DataFrame:
    """Priced, and not with an empty title. A null title is let through."""
    return products.filter(F.col("price").isNotNull() & (F.col("title").isNull() | (F.col("title") != "")))


def observed_for_keyword(items: DataFrame) -> DataFrame:
    """Usable rows that a keyword search found."""
    return usable(items).filter(F.col("keyword").isNotNull())


def latest_usable(items: DataFrame, *keys: str, fields=ROW_FIELDS) -> DataFrame:
    """Newest row first, usability second: a product whose newest row has no price drops out."""
    return usable(latest(items, *keys, fields=fields))


def top_per_key(rows: DataFrame, key: str, order: list[Column], n: int, spread: str, parts: int = 32) -> DataFrame:
    """The first n rows of each key, as column `rank` from 1.

    In two rounds: first among the rows of (key, hash of `spread`), then among the survivors. A key that holds
    a third of all rows is thus ranked by `parts` tasks, and the last round sees at most n x parts rows of it.
    """
    part = F.pmod(F.xxhash64(spread), F.lit(parts))
    first = Window.partitionBy(key, "part").orderBy(*order)
    second = Window.partitionBy(key).orderBy(*order)
    return (
        rows.withColumn("part", part)
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= n)
        .withColumn("rank", F.row_number().over(second))
        .filter(F.col("rank") <= n)
        .drop("part")
    )
