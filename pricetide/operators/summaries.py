"""Counts and lists over keywords, tracked urls and favourites."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide import fixed
from pricetide.functions import arrays, dates, ids, money
from pricetide.operators.catalog import SCORE_FIELDS, deals, product_details, product_summary
from pricetide.operators.snapshots import ROW_FIELDS, latest, latest_usable, observed_for_keyword, top_per_key


def enabled(dimension: DataFrame) -> DataFrame:
    """Rows switched on; a row that does not say is not listed."""
    return dimension.filter(F.col("enabled"))


def is_tracked(enabled_flag):
    """S8, single lookup: a row that does not say counts as tracked."""
    return F.coalesce(enabled_flag, F.lit(True))


def keyword_stats(items: DataFrame) -> DataFrame:
    """A4, A5: distinct priced products and last scrape per keyword. A product counts under every keyword it had.

    Grouped by (keyword, url) first: a keyword with a third of all rows is spread over its products, and the second
    grouping gets one partial sum per task.
    """
    pairs = observed_for_keyword(items).groupBy("keyword", "url").agg(F.max("scrapedAt").alias("scrapedAt"))
    return pairs.groupBy("keyword").agg(
        F.count(F.lit(1)).alias("productCount"), F.max("scrapedAt").alias("lastScrape")
    )


def daily_sketches(items: DataFrame, bits: int = fixed.SKETCH_BITS) -> DataFrame:
    """A4 in parts: a HyperLogLog sketch of the priced products of each (day, keyword); one row of bounded size each."""
    return observed_for_keyword(items).groupBy("day", "keyword").agg(
        F.hll_sketch_agg("url", F.lit(bits)).alias("products"), F.max("scrapedAt").alias("lastScrape")
    )


def approximate_keyword_stats(sketches: DataFrame) -> DataFrame:
    """A4, A5 from the sketches of any set of days: `keyword_stats` but for an error of the counts, of about one in sixty
    with the usual number of bits. Filter the days first to count over a time."""
    return sketches.groupBy("keyword").agg(
        F.hll_sketch_estimate(F.hll_union_agg("products")).alias("productCount"), F.max("lastScrape").alias("lastScrape")
    )


def keyword_summaries(items: DataFrame, keywords: DataFrame) -> DataFrame:
    """Enabled keywords with their counts, and all others that have products."""
    merged = enabled(keywords).select("keyword").join(keyword_stats(items), "keyword", "full")
    return merged.select(
        "keyword",
        F.coalesce("productCount", F.lit(0)).alias("productCount"),
        dates.iso(F.col("lastScrape")).alias("lastScrape"),
    ).orderBy(*keyword_order())


def keyword_order() -> list[Column]:
    """K5: as French readers sort."""
    return [F.collate("keyword", "fr")]


def tracked_order() -> list[Column]:
    """K6: by title, or url where there is none."""
    return [F.collate(F.coalesce("title", "url"), "fr"), F.col("url")]


def deal_order() -> list[Column]:
    """K7: best first, then by url."""
    return [F.desc("dealScore"), F.col("url")]


def keyword_totals(scored: DataFrame, *keys: str) -> DataFrame:
    """Products and deals, whatever the search filters."""
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("keywordTotal"), F.count_if("isDeal").alias("keywordDealCount")
    )


def _deals_now(items: DataFrame, scores: DataFrame) -> DataFrame:
    """Scored deals at their newest snapshot under any keyword.

    Rows meet the scores before the newest one is looked for: both go by url, so the result is the same, and only
    products that are deals get grouped.
    """
    seen = items.filter(F.col("keyword").isNotNull()).join(deals(scores), "url")
    return latest_usable(seen, "url", fields=(*ROW_FIELDS, *SCORE_FIELDS))


def current_deals(items: DataFrame, scores: DataFrame) -> DataFrame:
    """The deals, best first, then by url."""
    return _deals_now(items, scores).orderBy(*deal_order())


def keyword_deals(items: DataFrame, scores: DataFrame) -> DataFrame:
    """All keywords with products, their number of deals and the best three; keywords without deals stay.

    Counts are partial sums. Ranking goes over keyword, url and score alone, with a limit per group before the shuffle;
    only the few urls that come out of it are read with all their fields.
    """
    found = _deals_now(items, scores).select("keyword", "url", "dealScore")
    counts = found.groupBy("keyword").agg(F.count(F.lit(1)).alias("totalDeals"))
    best = top_per_key(found, "keyword", [F.desc("dealScore"), F.asc("url")], fixed.DEALS_SHOWN_PER_KEYWORD, spread="url").select("url", "rank")
    shown = product_summary(_deals_now(items.join(best.select("url"), "url", "left_semi"), scores))
    ranked = shown.join(best, "url").select("keyword", F.struct("rank", F.struct(*shown.columns).alias("deal")).alias("ranked"))
    board = ranked.groupBy("keyword").agg(F.transform(F.sort_array(F.collect_list("ranked")), lambda x: x["deal"]).alias("deals"))
    return (
        keyword_stats(items)
        .select("keyword", "productCount")
        .join(counts, "keyword", "left")
        .join(board, "keyword", "left")
        .select("keyword", "productCount", F.coalesce("totalDeals", F.lit(0)).alias("totalDeals"), F.coalesce("deals", F.array()).alias("deals"))
        .orderBy(F.desc("totalDeals"), F.collate("keyword", "fr"))
    )


def with_deals(dashboard_rows: DataFrame) -> DataFrame:
    """Keywords that have deals."""
    return dashboard_rows.filter(F.col("totalDeals") > 0)


def without_deals(dashboard_rows: DataFrame) -> DataFrame:
    """Keywords that have none."""
    return dashboard_rows.filter(F.col("totalDeals") == 0)


def counters(keywords: DataFrame, history: DataFrame, scores: DataFrame) -> DataFrame:
    """One row of totals. Deals count with or without a keyword."""
    products = history.agg(F.struct(F.count(F.lit(1)).alias("n"), F.max("updatedAt").alias("at")).alias("found"))
    return (
        keywords.sparkSession.range(1)
        .select(
            enabled(keywords).agg(F.count(F.lit(1))).scalar().alias("keywordCount"),
            products.scalar().alias("products"),
            deals(scores).agg(F.count(F.lit(1))).scalar().alias("dealCount"),
        )
        .select("keywordCount", F.col("products.n").alias("productCount"), "dealCount", dates.iso(F.col("products.at")).alias("lastUpdate"))
    )


def tracked_url_summaries(items: DataFrame, tracked: DataFrame) -> DataFrame:
    """Enabled urls with what the newest snapshot says; nulls until there is one."""
    listed = enabled(tracked).select("url")
    newest = latest(
        items.join(listed, "url", "left_semi"), "url", fields=("title", "images", "price", "scrapedAt")
    )
    title = F.nullif(F.col("title"), F.lit(""))
    return listed.join(newest, "url", "left").select(
        ids.product_id(F.col("url")).alias("id"),
        "url",
        title.alias("title"),
        arrays.first_or_null(F.col("images")).alias("image"),
        money.complete_money(F.col("price")).alias("price"),
        dates.iso(F.col("scrapedAt")).alias("lastScrape"),
    ).orderBy(*tracked_order())


def matching_keywords(summaries: DataFrame, typed: str) -> DataFrame:
    """As typed, not trimmed; nothing but blanks lists all."""
    if not typed.strip(fixed.SPACES):
        return summaries
    return summaries.filter(F.contains(F.lower("keyword"), F.lower(F.lit(typed))))


def matching_tracked_urls(summaries: DataFrame, typed: str) -> DataFrame:
    """In the title or the url."""
    if not typed.strip(fixed.SPACES):
        return summaries
    needle = F.lower(F.lit(typed))
    return summaries.filter(
        F.contains(F.lower(F.coalesce("title", F.lit(""))), needle) | F.contains(F.lower("url"), needle)
    )


def favorite_details(items: DataFrame, history: DataFrame, scores: DataFrame, favorites: DataFrame) -> DataFrame:
    """Favourites with their detail, last added first; those never seen are left out.

    One plan for all favourites; the three tables are cut down to them before anything is grouped.
    """
    listed = favorites.select("url")
    cut = [table.join(listed, "url", "left_semi") for table in (items, history, scores)]
    return product_details(*cut).join(favorites, "url").orderBy(F.desc("addedAt"), "url")


def favorite_flags(products: DataFrame, favorites: DataFrame) -> DataFrame:
    """Whether each url is a favourite."""
    marked = favorites.select("url", F.lit(True).alias("isFavorite"))
    return products.select("url").join(marked, "url", "left").withColumn(
        "isFavorite", F.coalesce("isFavorite", F.lit(False))
    )
