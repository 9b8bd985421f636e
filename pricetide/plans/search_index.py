"""Products by keyword and by runs of characters of their titles, kept up with the saved days."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide import schema
from pricetide.operators import catalog
from pricetide.operators.snapshots import latest, usable
from pricetide.plans.search import ProductQuery, SearchResult, search_totals
from pricetide.session import partitions_for, sized_shuffles
from pricetide.sources.buckets import BUCKETS, Buckets
from pricetide.sources.tables import Tables

READER = "search"
GRAM = 3


def keyword_products(tables: Tables, buckets: int = BUCKETS) -> Buckets:
    return Buckets(tables, "keyword_products", schema.KEYWORD_PRODUCTS, "keyword", ["keyword", "url"], buckets)


def keyword_grams(tables: Tables, buckets: int = BUCKETS) -> Buckets:
    return Buckets(tables, "keyword_grams", schema.TITLE_GRAMS, "keyword", ["keyword", "gram"], buckets, ties=["url"])


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a text without case; none where it has fewer.

    The text is an element of an array here, so that its case is changed once and not for every run.
    """

    def runs(low: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(low) - (GRAM - 1))
        return F.when(F.length(low) >= GRAM, F.array_distinct(F.transform(places, lambda at: F.substr(low, at, F.lit(GRAM)))))

    return F.transform(F.array(F.lower(text)), runs)[0]


def _grams_of(spark: SparkSession, text: str) -> list[str]:
    return spark.sql("SELECT 1").select(grams(F.lit(text))).first()[0] or []


def update_index(tables: Tables, buckets: int = BUCKETS) -> None:
    """Bring the index up to date with the daily rows saved since the last time.

    The index has the newest row of each (keyword, url), usable or not. A changed day may bring a newer row, replace the
    newest one, or take it away, when the product was last found by another keyword that day: then what is newest now is
    looked up in all days, for these pairs alone. Only buckets of keywords that changed rows have or had are read
    and written. The first run indexes all rows. A repeat of a run that broke off gives the same index.
    """
    products, titles = keyword_products(tables, buckets), keyword_grams(tables, buckets)
    products.resume()
    titles.resume()
    batches = tables.pending(READER)
    items = tables.items().filter(F.col("keyword").isNotNull())
    if not products.exists:
        if items.isEmpty():
            return
        touched = list(range(products.number))
        with sized_shuffles(tables.spark, tables.size("items_raw")):
            products.replace(latest(items, "keyword", "url"), touched)
    elif not batches:
        return
    else:
        changes = tables.changes(batches)
        days = tables._days(changes.select("day"))
        replaced = changes.select("url", "day")
        now = items.filter(F.col("day").isin(days)).join(replaced, ["url", "day"], "left_semi").select(*schema.KEYWORD_PRODUCTS.names)
        touched = products.of(now.select("keyword").unionByName(changes.select(F.col("oldKeyword").alias("keyword")).dropna()))
        old = products.read(touched)
        rows = old.join(replaced, ["url", "day"], "left_anti").select(*schema.KEYWORD_PRODUCTS.names).unionByName(now)
        pairs = ["keyword", "url", "day"]
        lost = old.join(replaced, ["url", "day"], "left_semi").select(*pairs).join(now.select(*pairs), pairs, "left_anti")
        # Only a row that took the place of another can be missing: where days only came in, there is nothing to look for.
        if not changes.filter("replaced").isEmpty() and not lost.isEmpty():
            again = items.join(lost.select("keyword", "url"), ["keyword", "url"], "left_semi")
            rows = rows.unionByName(again.select(*schema.KEYWORD_PRODUCTS.names))
        products.replace(latest(rows, "keyword", "url"), touched)
    # Dealt anew, to each core: the buckets that are filled may be fewer, and of different sizes. A title becomes many rows.
    parts = partitions_for(tables.size(products.name), tables.spark.sparkContext.defaultParallelism, 16 * 2**20)
    titled = products.read(touched).select("keyword", "url", "title").repartition(parts, "keyword", "url", "title")
    named = titled.select("keyword", F.explode(grams(F.col("title"))).alias("gram"), "url")
    titles.replace(named, touched, reader=READER, batches=batches)


def indexed_products(tables: Tables, keyword: str, search: str | None = None) -> DataFrame:
    """The usable products of a keyword, and of these, if `search` is given, at least those whose title has it.

    With three characters or more, a title that has the text has all its runs of three: products are those on the lists
    of all of these, which are read for this keyword alone. Whether the text is there is left to the row test.
    """
    rows = keyword_products(tables).read_key(keyword)
    wanted = _grams_of(tables.spark, search) if search else []
    if wanted:
        listed = keyword_grams(tables).read_key(keyword).filter(F.col("gram").isin(wanted))
        found = listed.groupBy("url").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted))
        rows = rows.join(found, "url", "left_semi")
    return usable(rows)


def search_indexed(tables: Tables, scores: DataFrame, keyword: str, query: ProductQuery = ProductQuery()) -> SearchResult:
    """Q1 from the index: one bucket of products, and of titles, whatever else is stored."""
    scored = catalog.with_scores(indexed_products(tables, keyword), scores)
    found = catalog.with_scores(indexed_products(tables, keyword, query.search), scores).filter(catalog.matches(query))
    page = catalog.page_rows(found, query.sort, query.page)
    return SearchResult(catalog.product_summary(page), search_totals(scored, query))
