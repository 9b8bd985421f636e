"""Each product's newest price against its own recent prices."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide import fixed
from pricetide.functions import arrays, dates, money


# Steps of 2^-24: sums of up to 2^29 in these steps are exact.
STEP = 2.0**24


def _coarse(amount: Column) -> Column:
    return F.floor(amount * STEP) / STEP


def feature_rows(entries: DataFrame) -> DataFrame:
    """Every priced observation with the mean of the 30 days before it and the number of observations before it.

    The count takes unpriced observations in, so they are dropped only after the windows. All windows share one
    partitioning and one order: one shuffle by url, one sort.

    The mean is that of the exactly summed prices, as a compensated sum gives it: a plain sum can end one digit off,
    and the rounding to cents then shows it. Each price is split into a part in steps of 2^-24, which adds up exactly,
    and a tiny rest.
    """
    amount = F.col("price.amount")
    coarse = _coarse(amount)
    by_day = Window.partitionBy("url").orderBy(F.unix_date("day"))
    month = by_day.rangeBetween(-fixed.MEAN_WINDOW_DAYS, -1)
    mean = (F.sum(coarse).over(month) + F.sum(amount - coarse).over(month)) / F.nullif(F.count(amount).over(month), F.lit(0))
    earlier = F.count(F.lit(1)).over(by_day.rowsBetween(Window.unboundedPreceding, -1))
    start = F.first("day").over(by_day.rowsBetween(Window.unboundedPreceding, 0))
    return (
        entries.select("url", "day", "price")
        .select(
            "url",
            "day",
            mean.alias("meanPrice30d"),
            earlier.alias("observations"),
            F.date_diff("day", start).alias("dayNumber"),
            F.col("price.currency").alias("currency"),
            amount.alias("price"),
        )
        .filter(F.col("price").isNotNull())
    )


def trend(slope: Column, mean_price: Column) -> Column:
    """Direction of the fitted line, as per cent of the mean price per day."""
    relative = F.try_divide(slope, mean_price) * 100
    return (
        F.when(relative <= -fixed.TREND_THRESHOLD_PCT_PER_DAY, "down")
        .when(relative >= fixed.TREND_THRESHOLD_PCT_PER_DAY, "up")
        .otherwise("stable")
    )


def latest_features(features: DataFrame) -> DataFrame:
    """The newest priced observation of each product and the trend over all of them.

    Feature rows already lie together by url, so this costs no further shuffle.
    """
    fields = ("day", "meanPrice30d", "observations", "currency", "price")
    return (
        features.groupBy("url")
        .agg(
            F.max_by(F.struct(*fields), "day").alias("newest"),
            F.regr_slope("price", "dayNumber").alias("slope"),
            F.avg("price").alias("meanPrice"),
        )
        .select("url", "newest.*", "slope", "meanPrice", trend(F.col("slope"), F.col("meanPrice")).alias("trendDirection"))
    )


def is_fresh(day: Column, as_of: Column) -> Column:
    """The day began no more than two days of 24 hours before `as_of`."""
    return dates.midnight(day) >= as_of - F.expr(f"INTERVAL {24 * fixed.STALE_AFTER_DAYS} HOURS")


def has_enough_history(observations: Column, mean_price: Column) -> Column:
    """P14."""
    return (observations >= fixed.MIN_OBSERVATIONS) & mean_price.isNotNull()


def scores_of_newest(newest: DataFrame, as_of: Column) -> DataFrame:
    """Scores from the newest priced day of each product."""
    mean, price = F.col("meanPrice30d"), F.col("price")
    return newest.filter(is_fresh(F.col("day"), as_of) & has_enough_history(F.col("observations"), mean)).select(
        "url",
        money.deal_score(mean, price).alias("score"),
        money.predicted_price(mean).alias("predictedPrice"),
        price.alias("actualPrice"),
        "currency",
        "trendDirection",
        as_of.alias("computedAt"),
    )


def deal_scores(entries: DataFrame, as_of: Column) -> DataFrame:
    """Q10 from rows: scores of all products with a fresh price and enough history.

    Replaces the stored table as a whole (S5).
    """
    return scores_of_newest(latest_features(feature_rows(entries)), as_of)


def deal_scores_of_histories(history: DataFrame, as_of: Column) -> DataFrame:
    """Q10 from stored histories: the same scores, without a shuffle.

    A history row holds all of its product's days in order, so everything is computed within the row, and only for the
    newest price. Products without a fresh price are dropped before anything is summed: those last seen too long ago
    by their scan, and of the entries only days and prices are kept.
    """
    oldest = dates.utc_day(as_of - F.expr(f"INTERVAL {24 * fixed.STALE_AFTER_DAYS} HOURS"))
    narrow = F.arrays_zip(F.col("history.day"), F.col("history.price")).cast("array<struct<day:date,price:struct<amount:double,currency:string>>>")
    history = history.filter(F.col("lastSeen").isNull() | (F.col("lastSeen") >= oldest)).select("url", narrow.alias("history"))

    def total(array, value):
        return F.aggregate(array, F.lit(0.0), lambda sum_so_far, entry: sum_so_far + value(entry))

    # Exploding an array of one keeps its element a column of its own. Spark would otherwise copy the expression behind
    # it into the filters and the lambdas below and compute it once per entry.
    priced = F.filter("history", lambda entry: entry["price"]["amount"].isNotNull())
    fresh = (
        history.select("url", "history", F.explode(F.array(priced)).alias("priced"))
        .select("url", "history", "priced", F.explode(F.array(arrays.last_or_null(F.col("priced")))).alias("newest"))
        .filter(is_fresh(F.col("newest.day"), as_of))
    )
    day, amount = F.col("newest.day"), lambda entry: entry["price"]["amount"]
    month = F.filter(
        "priced", lambda entry: (entry["day"] < day) & (F.date_diff(day, entry["day"]) <= fixed.MEAN_WINDOW_DAYS)
    )
    before = F.filter("history", lambda entry: entry["day"] < day)
    start = arrays.first_or_null(F.col("priced"))["day"]
    points = F.transform(
        "priced", lambda entry: F.struct(F.date_diff(entry["day"], start).alias("x"), amount(entry).alias("y"))
    )
    summed = (
        fresh.select("url", "newest", month.alias("month"), F.size(before).alias("observations"), points.alias("points"))
        .withColumns(
            {
                "meanPrice30d": (
                    total("month", lambda entry: _coarse(amount(entry)))
                    + total("month", lambda entry: amount(entry) - _coarse(amount(entry)))
                )
                / F.nullif(F.size("month"), F.lit(0)),
                "meanX": total("points", lambda point: point["x"]) / F.size("points"),
                "meanPrice": total("points", lambda point: point["y"]) / F.size("points"),
            }
        )
    )
    x, y = F.col("meanX"), F.col("meanPrice")
    slope = F.try_divide(
        total("points", lambda point: (point["x"] - x) * (point["y"] - y)),
        total("points", lambda point: (point["x"] - x) * (point["x"] - x)),
    )
    newest = summed.select(
        "url", "newest.day", "meanPrice30d", "observations", F.col("newest.price.currency").alias("currency"),
        F.col("newest.price.amount").alias("price"), trend(slope, y).alias("trendDirection"),
    )
    return scores_of_newest(newest, as_of)
