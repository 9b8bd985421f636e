"""Sums that scores can be read off, per product, which grow by the days that change."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide import fixed, schema
from pricetide.operators.scoring import STEP, scores_of_newest, trend

SUMS = ("n", "sumX", "sumXX", "sumY", "sumXY", "restY", "restXY")


def _exact(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def _terms(day: Column, amount: Column) -> dict[str, Column]:
    """What one day adds to each sum; nothing if it has no price."""
    x, steps = F.unix_date(day), F.floor(amount * STEP)
    rest = amount - steps / STEP
    return {
        "n": F.when(amount.isNotNull(), 1).otherwise(0).cast("long"),
        "sumX": _exact(F.when(amount.isNotNull(), x)), "sumXX": _exact(F.when(amount.isNotNull(), x.cast("long") * x)),
        "sumY": _exact(steps), "sumXY": _exact(_exact(steps) * x), "restY": rest, "restXY": rest * x,
    }


def _zero(name: str, value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast(schema.PRICE_STATS[name].dataType)).cast(schema.PRICE_STATS[name].dataType).alias(name)


def _newest_priced(recent: Column) -> Column:
    return F.array_max(F.transform(F.filter(recent, lambda e: e["price"]["amount"].isNotNull()), lambda e: e["day"]))


def _trimmed(rows: DataFrame, *more: str) -> DataFrame:
    """Days from 30 before the newest priced one on; of a product without prices, none is needed."""
    kept = F.filter("recent", lambda e: e["day"] >= F.date_sub("newest", fixed.MEAN_WINDOW_DAYS))
    return rows.withColumn("newest", _newest_priced(F.col("recent"))).select(
        "url", "entries", *SUMS, "newest", F.coalesce(kept, F.array().cast(schema.PRICE_STATS["recent"].dataType)).alias("recent"), *more)


def price_stats(entries: DataFrame) -> DataFrame:
    """Rows of PRICE_STATS from the daily rows of products. Sums in whole steps are exact in any order."""
    terms = _terms(F.col("day"), F.col("price.amount"))
    sums = entries.groupBy("url").agg(
        F.count(F.lit(1)).alias("entries"),
        *[_zero(name, F.sum(term)) for name, term in terms.items()],
        F.sort_array(F.collect_list(F.struct("day", "price"))).alias("recent"),
    )
    return _trimmed(sums)


def merged_stats(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored statistics with changed days taken in; rows of PRICE_STATS, and `fresh` and `rebuild`.

    `changes`: one row (url, day, price, replaced, oldAmount) per day that changed, with what it says now, and what it said
    when the sums were stored, if it was there. Old terms are taken off, new ones added. `rebuild` marks products whose newest
    priced day went back: the days before it are no longer at hand.
    """
    new, old = _terms(F.col("day"), F.col("price.amount")), _terms(F.col("day"), F.when(F.col("replaced"), F.col("oldAmount")))
    delta = changes.groupBy("url").agg(
        F.count_if(~F.col("replaced")).alias("entries"),
        *[_zero(name, F.coalesce(F.sum(new[name]), F.lit(0)) - F.coalesce(F.sum(old[name]), F.lit(0))) for name in SUMS],
        F.collect_list(F.struct("day", "price")).alias("days"),
    )
    was = stored.select("url", F.struct("entries", *SUMS, "newest", "recent").alias("was"))
    joined = was.join(delta.select("url", F.struct("entries", *SUMS, "days").alias("d")), "url", "full")
    none = F.array().cast(schema.PRICE_STATS["recent"].dataType)
    changed = F.transform("d.days", lambda e: e["day"])
    stay = F.coalesce(F.filter("was.recent", lambda e: ~F.array_contains(changed, e["day"])), none)
    fresh = F.col("d").isNotNull()
    rows = joined.select(
        "url",
        *[_zero(name, F.coalesce(f"was.{name}", F.lit(0)) + F.coalesce(f"d.{name}", F.lit(0))) for name in ("entries", *SUMS)],
        F.when(fresh, F.sort_array(F.concat(stay, F.coalesce("d.days", none)))).otherwise(F.col("was.recent")).alias("recent"),
        F.col("was.newest").alias("before"),
        fresh.alias("fresh"),
    )
    went_back = F.col("before").isNotNull() & (F.col("newest").isNull() | (F.col("newest") < F.col("before")))
    return _trimmed(rows, "before", "fresh").withColumn("rebuild", went_back).drop("before")


def scores_of_stats(stats: DataFrame, as_of: Column) -> DataFrame:
    """Q10 from stored statistics: the same scores as from all days, within the row."""
    amount = lambda e: e["price"]["amount"]
    steps = lambda e: F.floor(amount(e) * STEP)
    newest = F.element_at(F.filter("recent", lambda e: e["day"] == F.col("newest")), 1)
    month = F.filter("recent", lambda e: (e["day"] < F.col("newest")) & amount(e).isNotNull())
    later = F.size(F.filter("recent", lambda e: e["day"] >= F.col("newest")))
    rows = stats.filter(F.col("newest").isNotNull()).withColumn("now", F.explode(F.array(newest))).withColumn("month", F.explode(F.array(month)))
    total = lambda value: F.aggregate("month", F.lit(0.0), lambda so_far, e: so_far + value(e))
    n, x = F.col("n").cast("decimal(38,0)"), F.col("sumX")
    # n * sumXY - sumX * sumY, and what the rests add; both sums of steps are whole numbers and lose nothing.
    exact = (_exact(n * F.col("sumXY")) - _exact(x * F.col("sumY"))).cast("double") / STEP
    rest = F.col("n") * F.col("restXY") - x.cast("double") * F.col("restY")
    slope = F.try_divide(exact + rest, (_exact(n * F.col("sumXX")) - _exact(x * x)).cast("double"))
    mean = (F.col("sumY").cast("double") / STEP + F.col("restY")) / F.col("n")
    return scores_of_newest(
        rows.select(
            "url", F.col("newest").alias("day"),
            ((total(lambda e: steps(e) / STEP) + total(lambda e: amount(e) - steps(e) / STEP)) / F.nullif(F.size("month"), F.lit(0))).alias("meanPrice30d"),
            (F.col("entries") - later).alias("observations"), F.col("now.price.currency").alias("currency"), F.col("now.price.amount").alias("price"),
            trend(slope, mean).alias("trendDirection"),
        ),
        as_of,
    )
