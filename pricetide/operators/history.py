"""Price histories: building, reading and describing them."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide import fixed
from pricetide.functions import arrays, dates, money

ENTRY_FIELDS = ("day", "price", "crossedOutPrice", "unitPrice", "scrapedAt")


def price_history(items: DataFrame, updated_at: Column) -> DataFrame:
    """A1, Q9: one row per product with its dated snapshots in order, unpriced days included.

    Items hold one row per (url, day), so an array is never longer than the number of days on record.
    """
    newest = F.max_by(F.struct("shop", "keyword", "title", "images"), "day")
    return (
        items.groupBy("url")
        .agg(
            newest.alias("newest"),
            F.min("day").alias("firstSeen"),
            F.max("day").alias("lastSeen"),
            F.sort_array(F.collect_list(F.struct(*ENTRY_FIELDS))).alias("history"),
        )
        .select("url", "newest.*", "firstSeen", "lastSeen", "history", updated_at.alias("updatedAt"))
    )


def merged_history(stored: DataFrame, changed: DataFrame, updated_at: Column) -> DataFrame:
    """A1, Q9: stored histories with the daily rows that changed taken in; rows of `price_history`, and `fresh`.

    A changed row takes the place of the entry of its day. The newest row of a product is among the changed ones or it is
    the one the history was built with. Histories without changes stay as they are.
    """
    names = ("shop", "keyword", "title", "images")
    fresh = changed.groupBy("url").agg(
        F.max_by(F.struct(*names), "day").alias("newest"), F.min("day").alias("first"), F.max("day").alias("last"),
        F.collect_list(F.struct(*ENTRY_FIELDS)).alias("entries"),
    )
    old = stored.select("url", F.struct(*[name for name in stored.columns if name != "url"]).alias("old"))
    joined = old.join(fresh, "url", "full")
    days = F.transform("entries", lambda entry: entry["day"])
    kept = F.filter("old.history", lambda entry: ~F.array_contains(days, entry["day"]))
    entries = F.coalesce("entries", F.array().cast(_entry_array()))
    history = F.sort_array(F.concat(F.coalesce(kept, F.array().cast(_entry_array())), entries))
    is_fresh = F.col("last").isNotNull()
    newer = is_fresh & (F.col("old").isNull() | (F.col("last") >= F.col("old.lastSeen")))
    return joined.select(
        "url",
        *[F.when(newer, F.col(f"newest.{name}")).otherwise(F.col(f"old.{name}")).alias(name) for name in names],
        F.least("first", "old.firstSeen").alias("firstSeen"),
        F.greatest("last", "old.lastSeen").alias("lastSeen"),
        F.when(is_fresh, history).otherwise(F.col("old.history")).alias("history"),
        F.when(is_fresh, updated_at).otherwise(F.col("old.updatedAt")).alias("updatedAt"),
        is_fresh.alias("fresh"),
    )


def history_entries(history: DataFrame) -> DataFrame:
    """S3: the long form of stored histories, one row per (url, day)."""
    return history.select("url", F.explode("history").alias("entry")).select("url", "entry.*")


def upsert(stored: DataFrame, fresh: DataFrame, key: str = "url") -> DataFrame:
    """Fresh rows replace stored ones of the same key; other stored rows stay. Fresh rows are marked `fresh`.

    One full join, so that the fresh rows, often the result of a large aggregation by the same key, are computed once
    and need no second shuffle.
    """
    old = stored.select(key, F.struct(*fresh.columns).alias("old"))
    new = fresh.select(key, F.struct("*").alias("new"))
    joined = new.join(old, key, "full")
    return joined.select(F.coalesce("new", "old").alias("row"), F.col("new").isNotNull().alias("fresh")).select(
        "row.*", "fresh"
    )


def without_keys(stored: DataFrame, dropped: DataFrame, key: str = "url") -> DataFrame:
    """Stored rows whose key is not among the dropped ones."""
    return stored.join(dropped.select(key), key, "left_anti")


def projected_entries(history: Column) -> Column:
    """Entries as shown: ISO times, incomplete money nulled."""
    return F.transform(
        F.coalesce(history, F.array().cast(_entry_array())),
        lambda entry: F.struct(
            F.coalesce(dates.iso_day(entry["day"]), F.lit("")).alias("day"),
            money.complete_money(entry["price"]).alias("price"),
            money.complete_money(entry["crossedOutPrice"]).alias("crossedOutPrice"),
            money.complete_unit_price(entry["unitPrice"]).alias("unitPrice"),
            F.coalesce(dates.iso(entry["scrapedAt"]), F.lit("")).alias("scrapedAt"),
        ),
    )


def _entry_array():
    from pyspark.sql import types as T

    from pricetide.schema import HISTORY_ENTRY

    return T.ArrayType(HISTORY_ENTRY)


def price_stats(entries: DataFrame) -> DataFrame:
    """Price range and chart flags per product; min, max and mean are null where nothing is priced."""
    price, crossed_out = F.col("price.amount"), F.col("crossedOutPrice.amount")
    stats = entries.groupBy("url").agg(
        F.min(price).alias("minPrice"),
        F.max(price).alias("maxPrice"),
        F.avg(price).alias("avgPrice"),
        F.count(price).alias("pricedCount"),
        F.bool_or(crossed_out.isNotNull()).alias("hasCrossedOut"),
    )
    return stats.withColumns(
        {
            "chartable": F.col("pricedCount") >= fixed.MIN_CHART_POINTS,
            "showDots": F.col("pricedCount") <= fixed.MAX_DOTTED_POINTS,
        }
    )


def known_currency(price: Column, history: Column) -> Column:
    """The newest price's currency, else that of the first priced entry, else the default."""
    return F.coalesce(
        price["currency"], arrays.first_priced(history)["price"]["currency"], F.lit(fixed.DEFAULT_CURRENCY)
    )


def price_deltas(entries: DataFrame, rows: int = fixed.HISTORY_TABLE_ROWS) -> DataFrame:
    """The newest rows of each product, each with its change against the snapshot before.

    The oldest row shown has no change: the one before it lies outside the table.
    """
    newest_first = Window.partitionBy("url").orderBy(F.desc("day"))
    amount = F.col("price.amount")
    before = F.lead(amount).over(newest_first)
    return (
        entries.withColumn("position", F.row_number().over(newest_first))
        .withColumn("delta", F.when(F.col("position") < rows, amount - before))
        .filter(F.col("position") <= rows)
    )


def recent_history(history: DataFrame, limit: int = fixed.HISTORY_LIMIT_DEFAULT) -> DataFrame:
    """The newest entries of each stored history, with how many there are and how many were left out."""
    low, high = fixed.HISTORY_LIMIT_RANGE
    if not low <= limit <= high:
        raise ValueError(f"limit must lie between {low} and {high}")
    total = F.size("history")
    return history.select(
        "url",
        arrays.newest(F.col("history"), limit).alias("recent"),
        total.alias("totalCount"),
        F.greatest(total - limit, F.lit(0)).alias("omittedCount"),
    )


def filled_prices(entries: DataFrame) -> DataFrame:
    """One row per calendar day from the first to the last snapshot; a price holds until the next one.

    The days of a gap are made from the row before it, so no calendar is joined in.
    """
    by_day = Window.partitionBy("url").orderBy("day")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.coalesce(F.date_sub(F.lead("day").over(by_day), 1), F.col("day"))
    return (
        entries.select(
            "url",
            "day",
            until.alias("until"),
            F.last("price.amount", ignorenulls=True).over(so_far).alias("price"),
            F.last("crossedOutPrice.amount", ignorenulls=True).over(so_far).alias("crossedOut"),
        )
        .select("url", F.explode(F.sequence("day", "until")).alias("day"), "price", "crossedOut")
    )
