"""A4, A5: distinct products per keyword over any days, from sketches that are kept up with the saved days."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide import schema
from pricetide.operators.summaries import daily_sketches
from pricetide.session import sized_shuffles
from pricetide.sources.buckets import BUCKETS, Buckets
from pricetide.sources.tables import Tables

READER = "sketches"


def keyword_sketches(tables: Tables, buckets: int = BUCKETS) -> Buckets:
    return Buckets(tables, "keyword_sketches", schema.KEYWORD_SKETCHES, "day", ["day", "keyword"], buckets)


def update_sketches(tables: Tables, buckets: int = BUCKETS) -> None:
    """Make the sketches of the days anew that changed since the last time; a sketch cannot forget a product, but a day
    can. Only these days are read, and only their buckets are read and written. The first run takes in all days."""
    kept = keyword_sketches(tables, buckets)
    kept.resume()
    batches, items = tables.pending(READER), tables.items()
    if not kept.exists:
        if items.isEmpty():
            return
        with sized_shuffles(tables.spark, tables.size("items_raw")):
            kept.replace(daily_sketches(items), list(range(kept.number)), reader=READER, batches=batches)
    elif batches:
        changed = tables.changes(batches).select("day").distinct()
        days = tables._days(changed)
        touched = kept.of(changed)
        stay = kept.read(touched).filter(~F.col("day").isin(days))
        kept.replace(stay.unionByName(daily_sketches(items.filter(F.col("day").isin(days)))), touched, reader=READER, batches=batches)


def sketched_days(tables: Tables, first=None, last=None) -> DataFrame:
    """The stored sketches of the days from `first` to `last`; no bound where there is none given."""
    rows = keyword_sketches(tables).read()
    if first is not None:
        rows = rows.filter(F.col("day") >= F.lit(first))
    return rows if last is None else rows.filter(F.col("day") <= F.lit(last))
