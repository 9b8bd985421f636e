"""What a crawl visits next."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide import fixed
from pricetide.functions import ids, text
from pricetide.operators.snapshots import top_per_key
from pricetide.operators.summaries import enabled


def known_products(history: DataFrame, n: int = fixed.KNOWN_PRODUCTS_PER_KEYWORD) -> DataFrame:
    """K4: per keyword, the products not seen for longest."""
    listed = history.filter(F.col("keyword").isNotNull()).select("keyword", "url", "lastSeen")
    return top_per_key(listed, "keyword", [F.asc("lastSeen"), F.asc("url")], n, spread="url")


def crawl_frontier(keywords: DataFrame, history: DataFrame, tracked: DataFrame) -> DataFrame:
    """Search pages and known products of the enabled keywords, and all enabled tracked urls.

    Products are cut to their keyword's share before they meet the keyword table, so no large keyword is joined whole.
    """
    wanted = enabled(keywords).select("keyword")
    searches = wanted.select(
        text.search_url(F.col("keyword")).alias("url"), F.lit("SEARCH").alias("label"), "keyword"
    )
    product = F.lit(None).cast("string").alias("label")
    known = known_products(history).join(wanted, "keyword", "left_semi").select("url", product, "keyword")
    direct = enabled(tracked).select("url", product, F.lit(None).cast("string").alias("keyword"))
    return searches.unionByName(known).unionByName(direct)


def dead_products(fetch_log: DataFrame) -> DataFrame:
    """Urls of a fetch log that led away from their product."""
    return fetch_log.filter(ids.is_dead_redirect(F.col("url"), F.col("final_url"))).select("url").distinct()


def next_page_wanted(page: Column) -> Column:
    return page < fixed.MAX_SEARCH_PAGES
