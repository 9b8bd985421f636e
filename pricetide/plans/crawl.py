"""A round of the crawl over the stored tables, from fetched pages to what is to be fetched next."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.operators import extract, frontier, tracking
from pricetide.sources.tables import Tables


def seed(tables: Tables, defaults: DataFrame) -> None:
    """Switch the default keywords on where no keyword is stored yet."""
    keywords = tables.read("keywords")
    if keywords.isEmpty():
        tables.replace("keywords", tracking.seeded(keywords, defaults))


def take_in(tables: Tables, product_pages: DataFrame, batch: str) -> DataFrame:
    """Save what product pages show, delete products whose page is gone, and return links to variants.

    Pages are read once: their fields are written beside the tables and everything else starts from there, a repeat of
    the batch included.
    """
    read = tables.stage(f"pages-{batch}", lambda: extract.product_pages(product_pages))
    tables.save_snapshots(extract.observations(read), f"pages-{batch}")
    dead = frontier.dead_products(product_pages.select("url", "final_url").filter(F.col("final_url").isNotNull()))
    if not dead.isEmpty():
        tables.delete_products(dead)
    return extract.variant_links(read)


def next_requests(tables: Tables, variants: DataFrame | None = None, search_pages: DataFrame | None = None) -> DataFrame:
    """(url, label, keyword, page) of the next round, each url once.

    Search pages and known products of the enabled keywords and the enabled tracked urls, then the links that this
    round's pages gave. Of a url that comes up several times the first of these counts.
    """
    page = F.lit(None).cast("int").alias("page")
    parts = [frontier.crawl_frontier(tables.read("keywords"), tables.read("price_history"), tables.read("tracked_urls")).select("*", page)]
    if variants is not None:
        parts.append(variants.select("url", F.lit(None).cast("string").alias("label"), "keyword", page))
    if search_pages is not None:
        parts.append(extract.search_links(search_pages).select("url", "label", "keyword", "page"))
    ranked = None
    for rank, part in enumerate(parts):
        part = part.withColumn("rank", F.lit(rank))
        ranked = part if ranked is None else ranked.unionByName(part)
    fields = F.struct("rank", "keyword", "page", "label")
    first = ranked.groupBy("url").agg(F.min(fields).alias("first"))
    return first.select("url", "first.label", "first.keyword", "first.page")
