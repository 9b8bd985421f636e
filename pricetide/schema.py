"""Table schemas."""

from pyspark.sql import types as T

MONEY = T.StructType([T.StructField("amount", T.DoubleType()), T.StructField("currency", T.StringType())])
UNIT_PRICE = T.StructType([T.StructField("amount", T.DoubleType()), T.StructField("unit", T.StringType())])

# What a crawl hands over: one row per page visit. `seq` orders visits of the same instant.
SNAPSHOT_FIELDS = [
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("price", MONEY),
    T.StructField("crossedOutPrice", MONEY),
    T.StructField("unitPrice", UNIT_PRICE),
    T.StructField("deliveryDate", T.StringType()),
    T.StructField("images", T.ArrayType(T.StringType())),
    T.StructField("shop", T.StringType()),
    T.StructField("keyword", T.StringType()),
    T.StructField("scrapedAt", T.TimestampType()),
]
SNAPSHOT_LOG = T.StructType(SNAPSHOT_FIELDS + [T.StructField("seq", T.LongType())])

# One row per (url, day).
ITEMS_RAW = T.StructType(
    SNAPSHOT_FIELDS + [T.StructField("seq", T.LongType()), T.StructField("day", T.DateType())]
)

# Daily rows that a batch brought or replaced, with the keyword and price that the replaced row had.
CHANGES = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("day", T.DateType()),
        T.StructField("oldKeyword", T.StringType()),
        T.StructField("oldAmount", T.DoubleType()),
        T.StructField("replaced", T.BooleanType()),
        T.StructField("number", T.LongType()),
    ]
)

# Sums over the priced days of a product: x is the day as a number, y the price in whole steps, the rests are what the
# steps leave. `recent` has all days from 30 before the newest priced one on.
EXACT = T.DecimalType(38, 0)
PRICE_STATS = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("entries", T.LongType()),
        T.StructField("n", T.LongType()),
        *[T.StructField(name, EXACT) for name in ("sumX", "sumXX", "sumY", "sumXY")],
        *[T.StructField(name, T.DoubleType()) for name in ("restY", "restXY")],
        T.StructField("newest", T.DateType()),
        T.StructField("recent", T.ArrayType(T.StructType([T.StructField("day", T.DateType()), T.StructField("price", MONEY)]))),
    ]
)

# The newest row of each (keyword, url), and the runs of three characters of its title.
KEYWORD_PRODUCTS = T.StructType([*SNAPSHOT_FIELDS, T.StructField("day", T.DateType())])
TITLE_GRAMS = T.StructType([T.StructField(name, T.StringType()) for name in ("keyword", "gram", "url")])

# Which products a keyword had on a day, as a sketch.
KEYWORD_SKETCHES = T.StructType(
    [
        T.StructField("day", T.DateType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("products", T.BinaryType()),
        T.StructField("lastScrape", T.TimestampType()),
    ]
)

DELETED = T.StructType([T.StructField("url", T.StringType())])

HISTORY_ENTRY = T.StructType(
    [
        T.StructField("day", T.DateType()),
        T.StructField("price", MONEY),
        T.StructField("crossedOutPrice", MONEY),
        T.StructField("unitPrice", UNIT_PRICE),
        T.StructField("scrapedAt", T.TimestampType()),
    ]
)
PRICE_HISTORY = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("shop", T.StringType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("images", T.ArrayType(T.StringType())),
        T.StructField("firstSeen", T.DateType()),
        T.StructField("lastSeen", T.DateType()),
        T.StructField("history", T.ArrayType(HISTORY_ENTRY)),
        T.StructField("updatedAt", T.TimestampType()),
    ]
)
DEAL_SCORES = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("predictedPrice", T.DoubleType()),
        T.StructField("actualPrice", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("trendDirection", T.StringType()),
        T.StructField("computedAt", T.TimestampType()),
    ]
)
KEYWORDS = T.StructType([T.StructField("keyword", T.StringType()), T.StructField("enabled", T.BooleanType())])
TRACKED_URLS = T.StructType([T.StructField("url", T.StringType()), T.StructField("enabled", T.BooleanType())])
FAVORITES = T.StructType([T.StructField("url", T.StringType()), T.StructField("addedAt", T.TimestampType())])

# An already fetched page.
PAGES = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
    ]
)
