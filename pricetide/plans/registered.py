"""Every operator and query as a named job over the given tables, with the same result in SQL where SQL can say it."""

import uuid
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricetide import fixed
from pricetide.functions import arrays, dates, ids, money, text
from pricetide.operators import catalog, extract, frontier, history, price_stats, scoring, snapshots, summaries, tracking
from pricetide.operators.ranges import Ranges
from pricetide.plans import commands, crawl, incremental, nightly, search, search_index, sketches
from pricetide.plans.sql_views import ISO, OFFSET, VIEWS, millionths, outcomes_sql, state_sql
from pricetide.session import shared_folder
from pricetide.sources.sample_views import SampleViews, product_url, visits
from pricetide.sources.tables import Tables, migrated_items
from pricetide.streaming.deltas import compact_deltas, items_now, save_deltas
from pricetide.streaming.snapshots import save_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a job. Integer columns come out as bigint, as in the SQL; those that may be null are made doubles."""

    def register(job: Callable[[SampleViews], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            rows = job(SampleViews(spark, folder))
            small = [c for c, kind in rows.dtypes if kind in ("tinyint", "smallint", "int")]
            return rows.withColumns({c: F.col(c).cast("long") for c in small})

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = f"WITH {VIEWS} SELECT * FROM ({sql})"
        return job

    return register


def as_date(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def as_iso(column: str) -> Column:
    return dates.iso(F.col(column))


def in_millionths(column: str) -> Column:
    return F.floor(F.col(column) * 1000000 + OFFSET).cast("double")


def row_columns():
    return [
        "url", "title", F.col("price.amount").alias("price"), F.col("price.currency").alias("currency"),
        F.col("crossedOutPrice.amount").alias("crossed"), F.col("unitPrice.amount").alias("unit_price"),
        F.col("unitPrice.unit").alias("unit"), F.col("deliveryDate").alias("delivery"),
        arrays.first_or_null(F.col("images")).alias("image"), "keyword", as_iso("scrapedAt").alias("scraped_at"),
    ]


ROW_SQL = f"""url, title, price, CASE WHEN price IS NOT NULL THEN 'EUR' END AS currency, crossed, unit_price,
  CASE WHEN unit_price IS NOT NULL THEN 'L' END AS unit, delivery, image, keyword, strftime(scraped_at, {ISO}) AS scraped_at"""


def dated_columns():
    return [*row_columns(), as_date("day").alias("day"), "seq"]


DATED_SQL = f"{ROW_SQL}, CAST(day AS VARCHAR) AS day, seq"
USABLE = "price IS NOT NULL AND (title IS NULL OR title <> '')"


# Sources and sinks -------------------------------------------------------------------------------------------------


def fresh_tables(views: SampleViews) -> Tables:
    return Tables(views.spark, f"{shared_folder(views.spark)}/pricetide/{uuid.uuid4().hex}")


@query("s1_daily_snapshots", f"SELECT {DATED_SQL} FROM items")
def _(v):
    return v.items().select(*dated_columns())


@query("s2_stored_items", f"SELECT {DATED_SQL} FROM items")
def _(v):
    """Two saves that meet in the same days, read back from the table."""
    tables, log = fresh_tables(v), v.items_log()
    tables.save_snapshots(log.filter(F.col("seq") % 2 == 1), "odd")
    tables.save_snapshots(log.filter(F.col("seq") % 2 == 0), "even")
    return tables.items().select(*dated_columns())


def entry_columns():
    return [
        "url", as_date("day").alias("day"), F.col("price.amount").alias("price"),
        F.col("crossedOutPrice.amount").alias("crossed"), F.col("unitPrice.amount").alias("unit_price"),
        as_iso("scrapedAt").alias("scraped_at"),
    ]


ENTRY_SQL = f"url, CAST(day AS VARCHAR) AS day, price, crossed, unit_price, strftime(scraped_at, {ISO}) AS scraped_at"


@query("s3_history_entries", f"SELECT {ENTRY_SQL} FROM items")
def _(v):
    return v.stored_entries().select(*entry_columns())


def history_columns():
    return [
        "url", "shop", "keyword", "title", as_date("firstSeen").alias("first_seen"), as_date("lastSeen").alias("last_seen"),
        F.size("history").alias("entries"),
    ]


@query(
    "s4_history_upsert",
    """SELECT url, 'amazon' AS shop, CAST(min(day) AS VARCHAR) AS first_seen, CAST(max(day) AS VARCHAR) AS last_seen,
              count(*) AS entries, late AS fresh
       FROM (SELECT url, day, day >= DATE '2024-01-30' AS late, max(day) OVER (PARTITION BY url) AS seen FROM items)
       WHERE late = (seen >= DATE '2024-01-30') GROUP BY url, late""",
)
def _(v):
    """Stored: histories up to a day. Fresh: those built from that day on. Products not seen again keep the stored one."""
    late = F.col("day") >= F.lit("2024-01-30").cast("date")
    stored = history.price_history(v.items().filter(~late), v.as_of())
    merged = history.upsert(stored, history.price_history(v.items().filter(late), v.as_of()))
    return merged.select("url", "shop", *history_columns()[4:], "fresh")


@query(
    "s6_delete_dead_products",
    """SELECT 'history' AS source, url FROM histories WHERE url NOT IN (SELECT url FROM dead)
       UNION ALL SELECT 'scores', url FROM scores WHERE url NOT IN (SELECT url FROM dead)""".replace(
        "(SELECT url FROM dead)",
        "(SELECT url FROM fetch_log GROUP BY url HAVING max(seq) = max(seq) FILTER (final_url = 'https://www.amazon.fr/'))",
    ),
)
def _(v):
    """Dead are products whose last fetch led away."""
    last = F.max_by(F.struct("final_url"), "seq")
    dead = frontier.dead_products(v.fetch_log().groupBy("url").agg(last.alias("r")).select("url", "r.final_url"))
    kept = [
        history.without_keys(table, dead).select(F.lit(name).alias("source"), "url")
        for name, table in (("history", v.history()), ("scores", v.scores()))
    ]
    return kept[0].unionByName(kept[1])


@query(
    "s7_seed_defaults",
    """SELECT 'filled' AS source, keyword, CAST(enabled AS VARCHAR) AS enabled FROM keywords
       UNION ALL SELECT DISTINCT 'empty', keyword, 'true' FROM items_log WHERE keyword IS NOT NULL""",
)
def _(v):
    defaults = v.items_log().filter(F.col("keyword").isNotNull()).select("keyword").distinct()
    filled, empty = v.keywords(), v.keywords().filter(F.lit(False))
    parts = [
        tracking.seeded(table, defaults).select(F.lit(name).alias("source"), "keyword", F.col("enabled").cast("string"))
        for name, table in (("filled", filled), ("empty", empty))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "s8_enabled_rows",
    """SELECT 'listed' AS how, keyword AS key FROM keywords WHERE enabled
       UNION ALL SELECT 'looked_up', keyword FROM keywords WHERE coalesce(enabled, TRUE)
       UNION ALL SELECT 'listed', url FROM tracked_urls WHERE enabled
       UNION ALL SELECT 'looked_up', url FROM tracked_urls WHERE coalesce(enabled, TRUE)""",
)
def _(v):
    parts = []
    for table, key in ((v.keywords(), "keyword"), (v.tracked_urls(), "url")):
        parts.append(summaries.enabled(table).select(F.lit("listed").alias("how"), F.col(key).alias("key")))
        looked_up = table.filter(summaries.is_tracked(F.col("enabled")))
        parts.append(looked_up.select(F.lit("looked_up").alias("how"), F.col(key).alias("key")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def legacy_items(v: SampleViews) -> DataFrame:
    """Items as an older crawl left them: symbols for currencies, thumbnails for images."""
    day = F.dayofmonth("day")
    symbol = F.when(day % 3 == 0, "€").when(day % 3 == 1, "$").otherwise("EUR")
    few = F.when(day % 2 == 0, F.slice("images", 2, 1)).otherwise(F.col("images"))
    return v.items().withColumns(
        {
            "price": F.when(F.col("price").isNotNull(), F.col("price").withField("currency", symbol)),
            "crossedOutPrice": F.when(F.col("crossedOutPrice").isNotNull(), F.col("crossedOutPrice").withField("currency", F.lit("£"))),
            "images": few,
        }
    )


@query(
    "s9_migrate_legacy",
    """SELECT url, CAST(day AS VARCHAR) AS day, CASE WHEN price IS NULL THEN NULL WHEN d % 3 = 1 THEN 'USD' ELSE 'EUR' END AS currency,
              CASE WHEN crossed IS NOT NULL THEN 'GBP' END AS crossed_currency, replace(image, '._AC_US40_', '') AS images,
              d % 2 = 1 OR crossed IS NOT NULL OR (price IS NOT NULL AND d % 3 < 2) AS changed
       FROM (SELECT *, day(day) AS d FROM items)""",
)
def _(v):
    return migrated_items(legacy_items(v)).select(
        "url", as_date("day").alias("day"), F.col("price.currency").alias("currency"),
        F.col("crossedOutPrice.currency").alias("crossed_currency"), F.array_join("images", ",").alias("images"), "changed",
    )


@query("s10_latest_run", f"SELECT strftime(now, {ISO}) AS last_update FROM as_of")
def _(v):
    return v.history().agg(as_iso_max("updatedAt").alias("last_update"))


def as_iso_max(column: str) -> Column:
    return dates.iso(F.max(column))


# Filters and projections -------------------------------------------------------------------------------------------


@query("p1_usable_products", f"SELECT {ROW_SQL} FROM newest WHERE {USABLE}")
def _(v):
    return snapshots.latest_usable(v.items(), "url").select(*row_columns())


@query("p2_observed_for_keyword", f"SELECT {DATED_SQL} FROM items WHERE keyword IS NOT NULL AND {USABLE}")
def _(v):
    return snapshots.observed_for_keyword(v.items()).select(*dated_columns())


def scored_by_keyword(v: SampleViews) -> DataFrame:
    """Newest usable row of every (keyword, url) with its score: what a search in each keyword starts from."""
    keyworded = v.items().filter(F.col("keyword").isNotNull())
    return catalog.with_scores(snapshots.latest_usable(keyworded, "keyword", "url"), v.scores())


def found(v: SampleViews, **params: str) -> DataFrame:
    return scored_by_keyword(v).filter(catalog.matches(search.ProductQuery.from_params(**params)))


def scored_columns():
    return [
        *row_columns(), F.col("dealScore").alias("score"), F.col("predictedPrice").alias("predicted_price"),
        F.col("trendDirection").alias("trend"), F.col("isDeal").alias("is_deal"),
    ]


SCORED_SQL = f"{ROW_SQL}, score, predicted_price, trend, is_deal"


@query("p3_title_search", f"SELECT {SCORED_SQL} FROM scored WHERE contains(lower(title), 'product 1')")
def _(v):
    return found(v, q="  PRODUCT 1 ").select(*scored_columns())


@query("p4_deals_only", f"SELECT {SCORED_SQL} FROM scored WHERE is_deal")
def _(v):
    return found(v, deals="1").select(*scored_columns())


@query("p5_price_band", f"SELECT {SCORED_SQL} FROM scored WHERE price >= 20 AND price <= 60.5")
def _(v):
    return found(v, min="20", max="60.5").select(*scored_columns())


@query(
    "p6_product_summary",
    f"""SELECT rtrim(replace(replace(to_base64(encode(url)), '+', '-'), '/', '_'), '=') AS id, url, keyword, 'amazon' AS shop,
               coalesce(title, '') AS title, image || ' ' || replace(image, '._AC_US40_', '') AS images, price, crossed, unit_price, delivery,
               strftime(scraped_at, {ISO}) AS scraped_at, score, predicted_price, trend, is_deal FROM scored""",
)
def _(v):
    return catalog.product_summary(scored_by_keyword(v)).select(
        "id", "url", "keyword", "shop", "title", F.array_join("images", " ").alias("images"), F.col("price.amount").alias("price"),
        F.col("crossedOutPrice.amount").alias("crossed"), F.col("unitPrice.amount").alias("unit_price"),
        F.col("deliveryDate").alias("delivery"), F.col("scrapedAt").alias("scraped_at"), F.col("dealScore").alias("score"),
        F.col("predictedPrice").alias("predicted_price"), F.col("trendDirection").alias("trend"), F.col("isDeal").alias("is_deal"),
    )


def shown_entry_columns():
    return [
        "e.day", F.col("e.price.amount").alias("price"), F.col("e.crossedOutPrice.amount").alias("crossed"),
        F.col("e.unitPrice.amount").alias("unit_price"), F.col("e.scrapedAt").alias("scraped_at"),
    ]


SHOWN_ENTRY_SQL = f"strftime(day, {ISO}) AS day, price, crossed, unit_price, strftime(scraped_at, {ISO}) AS scraped_at"


@query("p7_history_projection", f"SELECT url, {SHOWN_ENTRY_SQL} FROM items")
def _(v):
    shown = v.history().select("url", F.explode(history.projected_entries(F.col("history"))).alias("e"))
    return shown.select("url", *shown_entry_columns())


@query(
    "p8_p9_p10_c17_deal_figures",
    """SELECT keyword, url, is_deal, discount_ratio, floor((1 - price / crossed) * 100 + 0.5) AS discount_percent,
              floor(score + 0.5) AS badge FROM scored""",
)
def _(v):
    price, crossed_out = F.col("price.amount"), F.col("crossedOutPrice.amount")
    return scored_by_keyword(v).select(
        "keyword", "url", money.is_deal(F.col("dealScore")).alias("is_deal"),
        money.discount_ratio(price, crossed_out).alias("discount_ratio"),
        money.discount_percent(price, crossed_out).cast("double").alias("discount_percent"),
        money.round_half_up(F.col("dealScore")).cast("double").alias("badge"),
    )


def summary_columns():
    return ["keyword", F.col("productCount").alias("products"), F.col("lastScrape").alias("last_scrape")]


KEYWORD_SUMMARIES_SQL = f"""SELECT keyword, coalesce(product_count, 0) AS products, strftime(last_scrape, {ISO}) AS last_scrape
  FROM (SELECT keyword FROM keywords WHERE enabled) FULL JOIN keyword_stats USING (keyword)"""


@query("p11_keyword_list_search", f"SELECT * FROM ({KEYWORD_SUMMARIES_SQL}) WHERE contains(keyword, 'kw_')")
def _(v):
    return summaries.matching_keywords(summaries.keyword_summaries(v.items(), v.keywords()), "KW_").select(*summary_columns())


def tracked_columns():
    return ["url", "id", "title", "image", F.col("price.amount").alias("price"), F.col("lastScrape").alias("last_scrape")]


TRACKED_SQL = f"""SELECT url, rtrim(replace(replace(to_base64(encode(url)), '+', '-'), '/', '_'), '=') AS id, nullif(title, '') AS title,
  image, price, strftime(scraped_at, {ISO}) AS last_scrape FROM (SELECT url FROM tracked_urls WHERE enabled) LEFT JOIN newest USING (url)"""


@query("p12_tracked_list_search", f"SELECT * FROM ({TRACKED_SQL}) WHERE contains(lower(coalesce(title, '')), 't 1') OR contains(lower(url), 't 1')")
def _(v):
    return summaries.matching_tracked_urls(summaries.tracked_url_summaries(v.items(), v.tracked_urls()), "T 1").select(*tracked_columns())


FEATURES_SQL = f"SELECT url, CAST(day AS VARCHAR) AS day, observations, {millionths('mean_30d')} AS mean_30d, price FROM"
NEWEST_FEATURES = f"{FEATURES_SQL} newest_features"


def features_columns():
    return ["url", as_date("day").alias("day"), "observations", in_millionths("meanPrice30d").alias("mean_30d"), "price"]


@query("p13_fresh_products", f"{NEWEST_FEATURES}, as_of WHERE CAST(newest_features.day AS TIMESTAMP) >= now - INTERVAL 48 HOUR")
def _(v):
    newest = scoring.latest_features(scoring.feature_rows(v.entries()))
    return newest.filter(scoring.is_fresh(F.col("day"), v.as_of())).select(*features_columns())


@query("p14_enough_history", f"{NEWEST_FEATURES} WHERE observations >= 5 AND mean_30d IS NOT NULL")
def _(v):
    newest = scoring.latest_features(scoring.feature_rows(v.entries()))
    return newest.filter(scoring.has_enough_history(F.col("observations"), F.col("meanPrice30d"))).select(*features_columns())


@query("p15_dead_redirects", "SELECT seq, url, final_url FROM fetch_log WHERE final_url = 'https://www.amazon.fr/'")
def _(v):
    return v.fetch_log().filter(ids.is_dead_redirect(F.col("url"), F.col("final_url"))).select("seq", "url", "final_url")


# Joins -------------------------------------------------------------------------------------------------------------


@query("j1_products_with_scores", f"SELECT {SCORED_SQL}, sort_score, discount_ratio FROM scored")
def _(v):
    return scored_by_keyword(v).select(*scored_columns(), F.col("sortScore").alias("sort_score"), F.col("discountRatio").alias("discount_ratio"))


def deal_columns():
    return [*row_columns(), F.col("dealScore").alias("score"), F.col("predictedPrice").alias("predicted_price"), F.col("trendDirection").alias("trend")]


DEAL_SQL = f"SELECT {ROW_SQL}, score, predicted_price, trend FROM deal_rows"


@query("j2_k7_current_deals", DEAL_SQL)
def _(v):
    return summaries.current_deals(v.items(), v.scores()).select(*deal_columns())


@query("j3_q4_k5_keyword_summaries", KEYWORD_SUMMARIES_SQL)
def _(v):
    return summaries.keyword_summaries(v.items(), v.keywords()).select(*summary_columns())


@query("j4_q5_k6_tracked_url_summaries", TRACKED_SQL)
def _(v):
    return summaries.tracked_url_summaries(v.items(), v.tracked_urls()).select(*tracked_columns())


@query("j5_tracked_observations", f"SELECT {DATED_SQL} FROM items WHERE url IN (SELECT url FROM tracked_urls WHERE enabled)")
def _(v):
    return v.items().join(summaries.enabled(v.tracked_urls()).select("url"), "url", "left_semi").select(*dated_columns())


def partly_missing(v: SampleViews) -> tuple[DataFrame, DataFrame]:
    """Items without their early days and histories without their late ones, so that each side has gaps."""
    late = F.col("day") >= F.lit("2024-01-29").cast("date")
    return v.items().filter(late), history.price_history(v.items().filter(~late), v.as_of())


def detail_columns():
    return [
        "url", "id", "keyword", "shop", "title", F.array_join("images", " ").alias("images"), F.col("price.amount").alias("price"),
        F.col("crossedOutPrice.amount").alias("crossed"), F.col("unitPrice.amount").alias("unit_price"),
        F.col("deliveryDate").alias("delivery"), F.col("scrapedAt").alias("scraped_at"), F.col("dealScore").alias("score"),
        F.col("predictedPrice").alias("predicted_price"), F.col("trendDirection").alias("trend"), F.col("isDeal").alias("is_deal"),
        F.size("history").alias("entries"), F.col("firstSeen").alias("first_seen"), F.col("lastSeen").alias("last_seen"),
    ]


DETAIL_FIELDS = f"""rtrim(replace(replace(to_base64(encode(url)), '+', '-'), '/', '_'), '=') AS id, 'amazon' AS shop,
  score, predicted_price, trend, coalesce(score, -1) >= 10 AS is_deal"""


@query(
    "j6_c1_product_details",
    f"""WITH early AS (SELECT * FROM items WHERE day < DATE '2024-01-29'), late AS (SELECT * FROM items WHERE day >= DATE '2024-01-29'),
          n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY day DESC) AS r FROM late) WHERE r = 1),
          e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY day DESC) AS r FROM early) WHERE r = 1),
          h AS (SELECT url, min(day) AS first_seen, max(day) AS last_seen, count(*) AS entries FROM early GROUP BY url)
        SELECT url, {DETAIL_FIELDS}, coalesce(n.image, e.image) || ' ' || replace(coalesce(n.image, e.image), '._AC_US40_', '') AS images, coalesce(n.keyword, e.keyword) AS keyword, coalesce(nullif(n.title, ''), e.title, '') AS title,
               coalesce(n.price, e.price) AS price, coalesce(n.crossed, e.crossed) AS crossed, coalesce(n.unit_price, e.unit_price) AS unit_price,
               n.delivery, strftime(coalesce(n.scraped_at, e.scraped_at), {ISO}) AS scraped_at, coalesce(entries, 0) AS entries,
               strftime(first_seen, {ISO}) AS first_seen, strftime(last_seen, {ISO}) AS last_seen
        FROM n FULL JOIN e USING (url) LEFT JOIN h USING (url) LEFT JOIN scores USING (url)""",
)
def _(v):
    return catalog.product_details(*partly_missing(v), v.scores()).select(*detail_columns())


FULL_DETAIL_SQL = f"""SELECT n.url, {DETAIL_FIELDS.replace('(url)', '(n.url)')}, n.image || ' ' || replace(n.image, '._AC_US40_', '') AS images, n.keyword, coalesce(n.title, '') AS title, n.price, n.crossed, n.unit_price, n.delivery,
  strftime(n.scraped_at, {ISO}) AS scraped_at, h.entries, strftime(h.first_seen, {ISO}) AS first_seen, strftime(h.last_seen, {ISO}) AS last_seen
  FROM newest n JOIN histories h ON n.url = h.url LEFT JOIN scores s ON n.url = s.url"""


@query("q2_product_detail", f"{FULL_DETAIL_SQL} WHERE n.url = 'https://www.amazon.fr/dp/U000000007/'")
def _(v):
    url = "https://www.amazon.fr/dp/U000000007/"
    return search.find_product(v.items(), v.history(), v.scores(), url).select(*detail_columns())


@query(
    "q6_j7_favorite_details",
    f"SELECT d.*, strftime(f.added_at, {ISO}) AS added_at FROM ({FULL_DETAIL_SQL}) d JOIN favorites f ON d.url = f.url",
)
def _(v):
    details = summaries.favorite_details(v.items(), v.history(), v.scores(), v.favorites())
    return details.select(*detail_columns(), as_iso("addedAt").alias("added_at"))


@query("q7_j8_is_favorite", "SELECT url, url IN (SELECT url FROM favorites) AS is_favorite FROM newest")
def _(v):
    products = snapshots.latest(v.items(), "url")
    return summaries.favorite_flags(products, v.favorites()).select("url", F.col("isFavorite").alias("is_favorite"))


@query("j9_prune_unscored", "SELECT url FROM histories WHERE url NOT IN (SELECT url FROM scores)")
def _(v):
    return history.without_keys(v.history(), v.scores()).select("url")


def keyword_deals_columns():
    return ["keyword", F.col("productCount").alias("products"), F.col("totalDeals").alias("total_deals")]


BEST_SQL = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY score DESC, url) AS rank,
  count(*) OVER (PARTITION BY keyword) AS total_deals FROM deal_rows) WHERE rank <= 3"""


@query(
    "j10_a11_q3_dashboard_keywords",
    f"""SELECT keyword, product_count AS products, coalesce(b.total_deals, 0) AS total_deals, coalesce(rank, 0) AS rank, b.url, b.score
        FROM keyword_stats LEFT JOIN ({BEST_SQL}) b USING (keyword)""",
)
def _(v):
    board = search.dashboard(v.items(), v.history(), v.scores(), v.keywords())
    return board.keywords.select(*keyword_deals_columns(), F.posexplode_outer("deals").alias("position", "deal")).select(
        "keyword", "products", "total_deals", F.coalesce(F.col("position") + 1, F.lit(0)).alias("rank"), "deal.url",
        F.col("deal.dealScore").alias("score"),
    )


@query(
    "u3_dashboard_split",
    """SELECT keyword, keyword IN (SELECT keyword FROM deal_rows) AS has_deals FROM keyword_stats""",
)
def _(v):
    rows = summaries.keyword_deals(v.items(), v.scores())
    split = [part(rows).select("keyword", F.lit(flag).alias("has_deals"))
             for part, flag in ((summaries.with_deals, True), (summaries.without_deals, False))]
    return split[0].unionByName(split[1])


# Aggregations ------------------------------------------------------------------------------------------------------


@query(
    "a1_q9_price_history",
    """SELECT url, 'amazon' AS shop, keyword, title, CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_seen AS VARCHAR) AS last_seen, entries
       FROM histories""",
)
def _(v):
    return v.history().select(*history_columns())


@query(
    "x1_history_positions",
    f"SELECT {ENTRY_SQL}, row_number() OVER (PARTITION BY url ORDER BY day) AS position FROM items",
)
def _(v):
    return v.history().select("url", F.posexplode("history").alias("at", "e")).select("url", F.col("at") + 1, "e.*").toDF(
        "url", "position", *history.ENTRY_FIELDS
    ).select(*entry_columns(), "position")


@query("a2_latest_per_url", f"SELECT {ROW_SQL} FROM newest")
def _(v):
    return snapshots.latest(v.items(), "url").select(*row_columns())


@query("a3_latest_fields", f"SELECT url, title, image, price, strftime(scraped_at, {ISO}) AS scraped_at FROM newest")
def _(v):
    return snapshots.latest(v.items(), "url", fields=("title", "images", "price", "scrapedAt")).select(
        "url", "title", arrays.first_or_null(F.col("images")).alias("image"), F.col("price.amount").alias("price"),
        as_iso("scrapedAt").alias("scraped_at"),
    )


@query("a4_a5_x8_keyword_stats", f"SELECT keyword, product_count AS products, strftime(last_scrape, {ISO}) AS last_scrape FROM keyword_stats")
def _(v):
    return summaries.keyword_stats(v.items()).select(
        "keyword", F.col("productCount").alias("products"), as_iso("lastScrape").alias("last_scrape")
    )


@query("a6_keyword_totals", "SELECT keyword, count(*) AS products, count(*) FILTER (is_deal) AS deals FROM scored GROUP BY keyword")
def _(v):
    return summaries.keyword_totals(scored_by_keyword(v), "keyword").select(
        "keyword", F.col("keywordTotal").alias("products"), F.col("keywordDealCount").alias("deals")
    )


SEARCH = {"q": "product", "max": "70", "sort": "price_asc", "page": "1"}


def totals_columns():
    return [
        "total", F.col("pageCount").alias("page_count"), F.col("keywordTotal").alias("keyword_total"),
        F.col("keywordDealCount").alias("keyword_deals"),
    ]


TOTALS_SQL = """SELECT count(*) FILTER (contains(lower(title), 'product') AND price <= 70) AS total,
  CAST(ceil(count(*) FILTER (contains(lower(title), 'product') AND price <= 70) / 24.0) AS BIGINT) AS page_count,
  count(*) AS keyword_total, count(*) FILTER (is_deal) AS keyword_deals FROM scored WHERE keyword = 'kw3'"""


@query("a7_search_totals", TOTALS_SQL)
def _(v):
    return search.search_products(v.items(), v.scores(), "kw3", search.ProductQuery.from_params(**SEARCH)).totals.select(*totals_columns())


@query(
    "q1_product_search",
    f"""SELECT url, title, price, score, is_deal, t.* FROM (
          SELECT * FROM scored WHERE keyword = 'kw3' AND contains(lower(title), 'product') AND price <= 70
          ORDER BY price, url LIMIT 24), ({TOTALS_SQL}) t""",
)
def _(v):
    result = search.search_products(v.items(), v.scores(), "kw3", search.ProductQuery.from_params(**SEARCH))
    totals = result.totals.select(F.struct(*totals_columns())).scalar()
    return result.items.select(
        "url", "title", F.col("price.amount").alias("price"), F.col("dealScore").alias("score"), F.col("isDeal").alias("is_deal"),
        totals.alias("totals"),
    ).select("url", "title", "price", "score", "is_deal", "totals.*")


@query(
    "a8_q3_dashboard_counters",
    f"""SELECT (SELECT count(*) FROM keywords WHERE enabled) AS keywords, (SELECT count(*) FROM histories) AS products,
               (SELECT count(*) FROM scores WHERE score >= 10) AS deals, (SELECT strftime(now, {ISO}) FROM as_of) AS last_update""",
)
def _(v):
    return summaries.counters(v.keywords(), v.history(), v.scores()).select(
        F.col("keywordCount").alias("keywords"), F.col("productCount").alias("products"), F.col("dealCount").alias("deals"),
        F.col("lastUpdate").alias("last_update"),
    )


@query("a9_trends", "SELECT url, trend FROM trends")
def _(v):
    newest = scoring.latest_features(scoring.feature_rows(v.entries()))
    return newest.select("url", F.col("trendDirection").alias("trend"))


@query(
    "a9_supplier_trends",
    f"""SELECT url, CASE WHEN r <= -0.5 THEN 'down' WHEN r >= 0.5 THEN 'up' ELSE 'stable' END AS trend, {millionths('slope')} AS slope FROM (
         SELECT url, regr_slope(price, CAST(day - DATE '1992-01-01' AS DOUBLE)) AS slope, slope / avg(price) * 100 AS r FROM supplier_items GROUP BY url)""",
)
def _(v):
    newest = scoring.latest_features(scoring.feature_rows(v.supplier_entries()))
    return newest.select("url", F.col("trendDirection").alias("trend"), in_millionths("slope").alias("slope"))


@query(
    "a10_a12_price_stats",
    f"""SELECT url, min(price) AS low, max(price) AS high, {millionths('avg(price)')} AS mean, count(price) AS priced,
              bool_or(crossed IS NOT NULL) AS has_crossed, count(price) >= 2 AS chartable, count(price) <= 20 AS dots FROM items GROUP BY url""",
)
def _(v):
    return history.price_stats(v.entries()).select(
        "url", F.col("minPrice").alias("low"), F.col("maxPrice").alias("high"), in_millionths("avgPrice").alias("mean"),
        F.col("pricedCount").alias("priced"), F.col("hasCrossedOut").alias("has_crossed"), "chartable", F.col("showDots").alias("dots"),
    )


@query(
    "a11_top_deals_per_keyword",
    f"SELECT keyword, rank, url, score, total_deals FROM ({BEST_SQL})",
)
def _(v):
    rows = summaries.keyword_deals(v.items(), v.scores()).select(
        "keyword", F.col("totalDeals").alias("total_deals"), F.posexplode("deals").alias("at", "deal")
    )
    return rows.select("keyword", "total_deals", (F.col("at") + 1).alias("rank"), "deal.url", F.col("deal.dealScore").alias("score"))


@query("a13_x9_known_currency", "SELECT url, 'EUR' AS currency, min(day)::VARCHAR AS first_priced FROM items GROUP BY url".replace(
    "min(day)::VARCHAR", "CAST(min(day) FILTER (price IS NOT NULL) AS VARCHAR)"))
def _(v):
    first = arrays.first_priced(F.col("history"))["day"]
    newest_price = arrays.last_or_null(F.col("history"))["price"]
    return v.history().select(
        "url", history.known_currency(newest_price, F.col("history")).alias("currency"), as_date(first).alias("first_priced")
    )


# Windows -----------------------------------------------------------------------------------------------------------


@query("w1_w2_w3_feature_rows", f"{FEATURES_SQL} features")
def _(v):
    return scoring.feature_rows(v.entries()).select(*features_columns())


@query(
    "w1_supplier_feature_rows",
    f"""SELECT url, CAST(day AS VARCHAR) AS day, price,
              {millionths("avg(price) OVER (PARTITION BY url ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)")} AS mean_30d,
              row_number() OVER (PARTITION BY url ORDER BY day) - 1 AS observations FROM supplier_items""",
)
def _(v):
    return scoring.feature_rows(v.supplier_entries()).select(*features_columns())


@query("w4_latest_features", NEWEST_FEATURES)
def _(v):
    return scoring.latest_features(scoring.feature_rows(v.entries())).select(*features_columns())


@query(
    "w5_x5_price_deltas",
    """SELECT url, CAST(day AS VARCHAR) AS day, position, price, CASE WHEN position < 15 THEN price - before END AS delta FROM (
         SELECT *, row_number() OVER (PARTITION BY url ORDER BY day DESC) AS position, lag(price) OVER (PARTITION BY url ORDER BY day) AS before
         FROM items) WHERE position <= 15""",
)
def _(v):
    return history.price_deltas(v.entries()).select(
        "url", as_date("day").alias("day"), "position", F.col("price.amount").alias("price"), "delta"
    )


@query(
    "w6_x6_recent_history",
    f"""SELECT {ENTRY_SQL}, total, greatest(total - 7, 0) AS omitted FROM (
          SELECT *, row_number() OVER (PARTITION BY url ORDER BY day DESC) AS rn, count(*) OVER (PARTITION BY url) AS total FROM items) WHERE rn <= 7""",
)
def _(v):
    recent = history.recent_history(v.history(), fixed.HISTORY_LIMIT_FAVORITES)
    return recent.select(
        "url", F.explode("recent").alias("e"), F.col("totalCount").alias("total"), F.col("omittedCount").alias("omitted")
    ).select("url", "e.*", "total", "omitted").select(*entry_columns(), "total", "omitted")


@query(
    "w7_filled_prices",
    """SELECT url, CAST(d AS VARCHAR) AS day,
              last_value(price IGNORE NULLS) OVER (PARTITION BY url ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price,
              last_value(crossed IGNORE NULLS) OVER (PARTITION BY url ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS crossed
       FROM (SELECT url, CAST(unnest(generate_series(CAST(first_seen AS TIMESTAMP), CAST(last_seen AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM histories)
       LEFT JOIN (SELECT url, day AS d, price, crossed FROM items) USING (url, d)""",
)
def _(v):
    return history.filled_prices(v.entries()).select(
        "url", as_date("day").alias("day"), "price", F.col("crossedOut").alias("crossed")
    )


# Orders and pages --------------------------------------------------------------------------------------------------


ORDERS_SQL = {
    "deals": "is_deal DESC, sort_score DESC, price, url", "price_asc": "price, url", "price_desc": "price DESC, url",
    "discount": "discount_ratio DESC, url",
}


@query(
    "k1_first_pages",
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{sort}' AS sort, url, price FROM scored WHERE keyword = 'kw2' ORDER BY {order} LIMIT 24)"
        for sort, order in ORDERS_SQL.items()
    ),
)
def _(v):
    scored = search.scored_products(v.items(), v.scores(), "kw2")
    pages = [
        catalog.page_rows(scored, sort, 1).select(F.lit(sort).alias("sort"), "url", F.col("price.amount").alias("price"))
        for sort in fixed.SORTS
    ]
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3])


@query("k2_second_page", f"SELECT url, price, is_deal FROM scored WHERE keyword = 'kw2' ORDER BY {ORDERS_SQL['deals']} LIMIT 24 OFFSET 24")
def _(v):
    scored = search.scored_products(v.items(), v.scores(), "kw2")
    return catalog.page_rows(scored, "deals", 2).select("url", F.col("price.amount").alias("price"), F.col("isDeal").alias("is_deal"))


@query(
    "k2_page_in_the_middle",
    """SELECT rn, url, price FROM (SELECT *, row_number() OVER (ORDER BY price DESC, url) AS rn, count(*) OVER () AS n FROM scored)
       WHERE (rn - 1) // 24 = n // 48""",
)
def _(v):
    """A page in the middle of all products under all keywords, with the place of each row."""
    scored = scored_by_keyword(v)
    page = scored.count() // 48 + 1
    rows = catalog.page_by_ranges(scored, "price_desc", page, ("url", "keyword"))
    place = F.row_number().over(Window.orderBy(*catalog.sort_order("price_desc"))) + 24 * (page - 1)  # of one page's rows
    return rows.select(place.cast("long").alias("rn"), "url", F.col("price.amount").alias("price"))


@query(
    "k3_page_clamped",
    """SELECT url, price FROM (SELECT *, row_number() OVER (ORDER BY is_deal DESC, sort_score DESC, price, url) AS rn, count(*) OVER () AS n
       FROM scored WHERE keyword = 'kw4') WHERE rn > (n - 1) // 24 * 24""",
)
def _(v):
    result = search.search_clamped(v.items(), v.scores(), "kw4", search.ProductQuery(page=999))
    return result.items.select("url", F.col("price.amount").alias("price"))


def positions(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with the place they have in the whole order."""
    return Ranges(rows, order).numbered("position")


@query("k5_keyword_positions", f"SELECT *, row_number() OVER (ORDER BY keyword COLLATE fr) AS position FROM ({KEYWORD_SUMMARIES_SQL})")
def _(v):
    return positions(summaries.keyword_summaries(v.items(), v.keywords()).select(*summary_columns()), summaries.keyword_order())


@query("k6_tracked_positions", f"SELECT *, row_number() OVER (ORDER BY coalesce(title, url) COLLATE fr, url) AS position FROM ({TRACKED_SQL})")
def _(v):
    return positions(summaries.tracked_url_summaries(v.items(), v.tracked_urls()).select(*tracked_columns()), summaries.tracked_order())


@query("k7_deal_positions", f"SELECT url, score, row_number() OVER (ORDER BY score DESC, url) AS position FROM ({DEAL_SQL})")
def _(v):
    found = summaries.current_deals(v.items(), v.scores()).select("url", "dealScore")
    return positions(found, summaries.deal_order()).withColumnRenamed("dealScore", "score")


KNOWN_SQL = """SELECT * FROM (SELECT keyword, url, last_seen, row_number() OVER (PARTITION BY keyword ORDER BY last_seen, url) AS rank
  FROM histories WHERE keyword IS NOT NULL) WHERE rank <= 150"""


@query("k4_known_products", f"SELECT keyword, url, CAST(last_seen AS VARCHAR) AS last_seen, rank FROM ({KNOWN_SQL})")
def _(v):
    return frontier.known_products(v.history()).select("keyword", "url", as_date("lastSeen").alias("last_seen"), "rank")


@query(
    "u1_q12_x7_crawl_frontier",
    f"""SELECT 'https://www.amazon.fr/s?k=' || keyword AS url, 'SEARCH' AS label, keyword FROM keywords WHERE enabled
        UNION ALL SELECT url, NULL, keyword FROM ({KNOWN_SQL}) WHERE keyword IN (SELECT keyword FROM keywords WHERE enabled)
        UNION ALL SELECT url, NULL, NULL FROM tracked_urls WHERE enabled""",
)
def _(v):
    return frontier.crawl_frontier(v.keywords(), v.history(), v.tracked_urls())


# Scalars over whole tables -----------------------------------------------------------------------------------------


SCORES_SQL = "SELECT url, score, predicted_price, actual_price, currency, trend, strftime(now, " + ISO + ") AS computed_at FROM scores, as_of"


def score_columns():
    return [
        "url", "score", F.col("predictedPrice").alias("predicted_price"), F.col("actualPrice").alias("actual_price"), "currency",
        F.col("trendDirection").alias("trend"), as_iso("computedAt").alias("computed_at"),
    ]


@query("c2_q10_deal_scores", SCORES_SQL)
def _(v):
    return v.scores().select(*score_columns())


@query("q10_scores_of_histories", SCORES_SQL)
def _(v):
    return scoring.deal_scores_of_histories(v.history(), v.as_of()).select(*score_columns())


@query(
    "c3_c4_c16_days_and_ages",
    f"""SELECT seq, CAST(day AS VARCHAR) AS day, strftime(scraped_at, {ISO}) AS iso,
               CASE WHEN m >= 1440 THEN m // 1440 WHEN m >= 60 THEN m // 60 WHEN m > 0 THEN m ELSE 0 END AS age,
               CASE WHEN m >= 1440 THEN 'day' WHEN m >= 60 THEN 'hour' WHEN m > 0 THEN 'minute' ELSE 'now' END AS unit
        FROM (SELECT *, (epoch_ms(now) - epoch_ms(scraped_at)) // 60000 AS m FROM items_log, as_of)""",
)
def _(v):
    age = dates.age(F.col("scrapedAt"), v.as_of())
    return v.items_log().select("seq", "scrapedAt", age.alias("a")).select(
        "seq", as_date(dates.utc_day(F.col("scrapedAt"))).alias("day"), as_iso("scrapedAt").alias("iso"),
        F.col("a.count").alias("age"), F.col("a.unit").alias("unit"),
    )


@query(
    "c5_product_ids",
    """SELECT page_id, rtrim(replace(replace(to_base64(encode(url || '?q=é>~' || page_id)), '+', '-'), '/', '_'), '=') AS id FROM pages""",
)
def _(v):
    return v.table("pages").select(
        "page_id", ids.product_id(F.concat("url", F.lit("?q=é>~"), F.col("page_id").cast("string"))).alias("id")
    )


@query(
    "c6_decoded_ids",
    """SELECT seq, CASE WHEN m IN (0, 6) THEN url END AS url,
              CASE m WHEN 1 THEN 'missing' WHEN 2 THEN 'alphabet' WHEN 3 THEN 'malformed' WHEN 4 THEN 'not_http' WHEN 5 THEN 'too_long' END AS error
       FROM (SELECT event_id AS seq, url, k % 7 AS m FROM ev)""",
)
def _(v):
    k = F.get_json_object("props", "$.k").cast("int") % 7
    url = product_url(F.col("user_id"))
    raw = (
        F.when(k == 1, "").when(k == 2, F.concat(ids.product_id(url), F.lit("=")))
        .when(k == 3, F.concat(ids.product_id(url), F.lit("A")))
        .when(k == 4, ids.product_id(F.concat(F.lit("file:///"), url)))
        .when(k == 5, ids.product_id(F.repeat(url, 60)))
        .otherwise(ids.product_id(url))
    )
    return v.table("events").select(F.col("event_id").alias("seq"), raw.alias("raw")).select(
        "seq", ids.url_of_product_id(F.col("raw")).alias("url"), ids.product_id_error(F.col("raw")).alias("error")
    )


@query(
    "c7_canonical_urls",
    """SELECT seq, CASE WHEN m IN (0, 1, 2, 7) THEN url END AS canonical FROM (SELECT event_id AS seq, url, k % 8 AS m FROM ev)""",
)
def _(v):
    k, code = F.get_json_object("props", "$.k").cast("int") % 8, F.regexp_extract(product_url(F.col("user_id")), fixed.PRODUCT_LINK, 1)
    raw = (
        F.when(k == 0, F.concat(F.lit("https://www.amazon.fr/Some-Title/dp/"), F.lower(code), F.lit("/?ref=xyz")))
        .when(k == 1, F.concat(F.lit("  http://amazon.fr/dp/"), code, F.lit(" ")))
        .when(k == 2, F.concat(F.lit("HTTPS://user@WWW.Amazon.FR:443/a b/été/dp/"), code))
        .when(k == 3, F.concat(F.lit("ftp://amazon.fr/dp/"), code))
        .when(k == 4, F.concat(F.lit("https://www.amazon.de/dp/"), code))
        .when(k == 5, F.concat(F.lit("https://www.amazon.fr/s?k=/dp/"), code))
        .when(k == 6, F.concat(F.lit("amazon.fr/dp/"), code))
        .otherwise(F.concat(F.lit("https://www.amazon.fr/dp/"), code, F.lit("#top")))
    )
    return v.table("events").select(F.col("event_id").alias("seq"), ids.canonical_product_url(raw).alias("canonical"))


@query(
    "c8_search_links",
    """SELECT event_id AS seq, CASE WHEN k % 3 = 0 THEN url ELSE replace(url, '/dp/U', '/gp/u') END AS link FROM ev""",
)
def _(v):
    k, url = F.get_json_object("props", "$.k").cast("int") % 3, product_url(F.col("user_id"))
    raw = F.when(k == 0, F.concat(F.regexp_replace(url, "fr/dp", "fr/-/en/Name/dp"), F.lit("ref=sr_1"))).otherwise(F.replace(url, F.lit("/dp/U"), F.lit("/gp/u")))
    return v.table("events").select(F.col("event_id").alias("seq"), ids.canonical_search_link(raw).alias("link"))


@query(
    "c9_c11_price_texts",
    """SELECT p_partkey, CASE WHEN m < 6 THEN p END AS amount, CASE WHEN m IN (0, 2, 5) THEN 'EUR' WHEN m = 1 THEN 'USD' WHEN m IN (3, 4) THEN 'GBP' END AS currency
       FROM (SELECT p_partkey, p_partkey % 8 AS m, CAST(printf('%.2f', p_retailprice) AS DOUBLE) AS p FROM part)""",
)
def _(v):
    """Prices of the part list, written the ways shops write them; the last two ways have no decimals or no digits."""
    m, number = F.col("p_partkey") % 8, money.round_exact(F.col("p_retailprice"), 2)
    plain = F.replace(F.format_number(number, 2), F.lit(","), F.lit(""))
    spaced = F.translate(F.format_number(number, 2), ",.", " ,")
    written = (
        F.when(m == 0, F.concat(F.translate(plain, ".", ","), F.lit(" €"))).when(m == 1, F.concat(F.lit("$"), plain))
        .when(m == 2, F.concat(spaced, F.lit(" €"))).when(m == 3, F.concat(F.lit("now £"), spaced))
        .when(m == 4, F.concat(F.lit("£ "), plain)).when(m == 5, F.concat(F.lit("price: "), plain, F.lit(" $")))
        .when(m == 6, F.concat(F.floor(number).cast("string"), F.lit(" €"))).otherwise("out of stock")
    )
    price = text.parse_price(written)
    return v.table("part").select("p_partkey", price["amount"].alias("amount"), price["currency"].alias("currency"))


@query(
    "c10_unit_price_texts",
    """SELECT p_partkey, CASE WHEN m < 4 THEN p END AS amount, CASE m WHEN 0 THEN 'l' WHEN 1 THEN '100' WHEN 2 THEN '' WHEN 3 THEN 'kg' END AS unit
       FROM (SELECT p_partkey, p_partkey % 5 AS m, CAST(printf('%.2f', p_retailprice) AS DOUBLE) AS p FROM part)""",
)
def _(v):
    m = F.col("p_partkey") % 5
    number = F.translate(F.replace(F.format_number(money.round_exact(F.col("p_retailprice"), 2), 2), F.lit(","), F.lit("")), ".", ",")
    written = (
        F.when(m == 0, F.concat(F.lit("("), number, F.lit(" €/l)"))).when(m == 1, F.concat(number, F.lit("€ / 100 ml)")))
        .when(m == 2, F.concat(number, F.lit(" €"))).when(m == 3, F.concat(number, F.lit(" € Par  kg )")))
        .otherwise(F.concat(F.lit("$"), number, F.lit("/l")))
    )
    price = text.parse_unit_price(written)
    return v.table("part").select("p_partkey", price["amount"].alias("amount"), price["unit"].alias("unit"))


@query("c12_x3_full_size_images", "SELECT seq, replace(image, '._AC_US40_', '') AS images FROM items_log")
def _(v):
    return v.items_log().select("seq", F.array_join(text.high_res_images(F.col("images")), " ").alias("images"))


@query(
    "c13_keyword_names",
    """SELECT p_partkey, CASE WHEN m = 0 THEN NULL WHEN m = 1 AND length(n) > 100 THEN NULL ELSE n END AS name FROM (
         SELECT p_partkey, p_partkey % 4 AS m, CASE p_partkey % 4 WHEN 1 THEN repeat(p_name, 6) ELSE p_name END AS n FROM part)""",
)
def _(v):
    m = F.col("p_partkey") % 4
    raw = (
        F.when(m == 0, F.lit(" \t\n")).when(m == 1, F.concat(F.repeat("p_name", 6), F.lit(" ")))
        .when(m == 2, F.concat(F.lit("  "), "p_name", F.lit("\n"))).otherwise(F.col("p_name"))
    )
    return v.table("part").select("p_partkey", text.keyword_name(raw).alias("name"))


@query(
    "c14_search_urls",
    """SELECT p_partkey, 'https://www.amazon.fr/s?k=' || replace(replace(replace(replace(replace(
         url_encode(p_name || ' & (é)*!' || chr(39) || '~+' || p_partkey), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*') AS url FROM part""",
)
def _(v):
    name = F.concat("p_name", F.lit(" & (é)*!'~+"), F.col("p_partkey").cast("string"))
    return v.table("part").select("p_partkey", text.search_url(name).alias("url"))


@query(
    "x2_x4_image_lists",
    """SELECT seq, image AS first, replace(image, '._AC_US40_', '') AS last, CAST(2 AS BIGINT) AS known FROM items_log""",
)
def _(v):
    padded = F.array_append(F.col("images"), F.lit(None))
    known = arrays.known_elements(padded)
    return v.items_log().select(
        "seq", arrays.first_or_null(known).alias("first"), arrays.last_or_null(known).alias("last"), F.size(known).alias("known")
    )


# Pages -------------------------------------------------------------------------------------------------------------


SHOWN_PAGES = "pages WHERE page_id % 13 <> 0 AND page_id % 11 <> 10"
PAGE_URL = "'https://www.amazon.fr/dp/P' || lpad(CAST(page_id AS VARCHAR), 9, '0') || '/'"


@query(
    "e1_e2_p16_page_observations",
    f"""SELECT {PAGE_URL} AS url, 'Page ' || page_id AS title, 'Delivered in ' || (page_id % 4) || ' days' AS delivery, 'amazon' AS shop,
               CASE WHEN page_id % 5 = 1 THEN CAST('1' || lpad(CAST(page_id % 1000 AS VARCHAR), 3, '0') || '.' || lpad(CAST(page_id % 100 AS VARCHAR), 2, '0') AS DOUBLE)
                    WHEN page_id % 5 <> 3 THEN CAST(page_id || '.' || lpad(CAST(page_id % 100 AS VARCHAR), 2, '0') AS DOUBLE) END AS price,
               CASE WHEN page_id % 5 = 2 THEN 'USD' WHEN page_id % 5 <> 3 THEN 'EUR' END AS currency,
               CAST(page_id || '.99' AS DOUBLE) AS crossed, CAST(page_id || '.18' AS DOUBLE) AS unit_price,
               CASE WHEN page_id % 3 = 0 THEN 'l' ELSE 'kg' END AS unit, 'https://img.example/images/I/p' || page_id || '.jpg' AS images,
               CASE WHEN page_id % 4 <> 0 THEN 'kw' || (page_id % 7) END AS keyword FROM {SHOWN_PAGES}""",
)
def _(v):
    return extract.observations(extract.product_pages(v.product_pages())).select(
        "url", "title", F.col("deliveryDate").alias("delivery"), "shop", F.col("price.amount").alias("price"),
        F.col("price.currency").alias("currency"), F.col("crossedOutPrice.amount").alias("crossed"),
        F.col("unitPrice.amount").alias("unit_price"), F.col("unitPrice.unit").alias("unit"), F.array_join("images", " ").alias("images"), "keyword",
    )


@query(
    "e3_u2_variant_links",
    f"""SELECT from_url, 'https://www.amazon.fr/dp/' || code || '/' AS url, keyword FROM (
          SELECT DISTINCT {PAGE_URL} AS from_url, unnest(['P' || lpad(CAST((page_id * 7) % 1000000 AS VARCHAR), 9, '0'), 'Q' || lpad(CAST(page_id AS VARCHAR), 9, '0')]) AS code,
                 CASE WHEN page_id % 4 <> 0 THEN 'kw' || (page_id % 7) END AS keyword FROM {SHOWN_PAGES})
        WHERE from_url <> 'https://www.amazon.fr/dp/' || code || '/'""",
)
def _(v):
    return extract.variant_links(extract.product_pages(v.product_pages()))


@query(
    "e4_search_links",
    """SELECT url, 'PRODUCT' AS label, 'kw' || (page_id % 7) AS keyword, CAST(NULL AS DOUBLE) AS page FROM (
         SELECT page_id, unnest(['https://www.amazon.fr/dp/R' || lpad(CAST(page_id AS VARCHAR), 9, '0') || '/',
                                 'https://www.amazon.fr/dp/r' || lpad(CAST(page_id AS VARCHAR), 9, '0') || '/']) AS url FROM pages)
       UNION ALL SELECT 'https://www.amazon.fr/s?k=a&page=' || (page_id % 6 + 2), 'SEARCH', 'kw' || (page_id % 7), page_id % 6 + 2
       FROM pages WHERE page_id % 3 <> 0 AND page_id % 6 + 1 < 5""",
)
def _(v):
    return extract.search_links(v.search_pages()).withColumn("page", F.col("page").cast("double"))


@query("e5_dead_products", "SELECT DISTINCT url FROM fetch_log WHERE final_url = 'https://www.amazon.fr/'")
def _(v):
    return frontier.dead_products(v.fetch_log())


# Tracking ----------------------------------------------------------------------------------------------------------


def shown_state(state: DataFrame) -> DataFrame:
    return state.select("key", F.col("enabled").cast("string").alias("enabled"))


def keyed(table: DataFrame, key: str) -> DataFrame:
    return table.withColumnRenamed(key, "key")


CODE_SQL = """CASE outcome WHEN 'invalid' THEN '{invalid}' WHEN 'conflict' THEN '{conflict}' WHEN 'not_found' THEN '{not_found}' END AS error_code,
  CASE outcome WHEN 'invalid' THEN 400 WHEN 'conflict' THEN 409 WHEN 'not_found' THEN 404 END::DOUBLE AS status"""


def decoded(v: SampleViews, commands: DataFrame) -> DataFrame:
    """Commands with their keys, written once for all the steps of a fold that read them."""
    return fresh_tables(v).stage("commands", lambda: commands)


def outcome_columns():
    return ["seq", "key", "action", "outcome", "error_code", F.col("status").cast("double").alias("status")]


@query(
    "t1_t2_t7_keyword_outcomes",
    f"""SELECT seq, key, action, outcome, {CODE_SQL.format(**tracking.KEYWORD_CODES)} FROM ({outcomes_sql("keyword_commands", "keywords", "keyword")})""",
)
def _(v):
    commands = decoded(v, tracking.keyword_commands(v.keyword_commands()))
    return tracking.tracking_outcomes(commands, keyed(v.keywords(), "keyword"), tracking.KEYWORD_CODES).select(*outcome_columns())


@query("t1_t2_q8_keyword_state", state_sql("keyword_commands", "keywords", "keyword"))
def _(v):
    return shown_state(tracking.tracking_state(tracking.keyword_commands(v.keyword_commands()), keyed(v.keywords(), "keyword")))


@query(
    "t3_t4_t7_url_outcomes",
    f"""SELECT seq, key, action, outcome, CASE WHEN key IS NULL AND action = 'untrack' THEN 'INVALID_PRODUCT_ID' ELSE error_code END AS error_code, status
        FROM (SELECT *, {CODE_SQL.format(**tracking.URL_CODES)} FROM ({outcomes_sql("url_commands", "tracked_urls", "url")}))""",
)
def _(v):
    commands = decoded(v, tracking.url_commands(v.url_commands()))
    return tracking.tracking_outcomes(commands, keyed(v.tracked_urls(), "url"), tracking.URL_CODES).select(*outcome_columns())


@query("t3_t4_q8_url_state", state_sql("url_commands", "tracked_urls", "url"))
def _(v):
    return shown_state(tracking.tracking_state(tracking.url_commands(v.url_commands()), keyed(v.tracked_urls(), "url")))


FAVORITE_OUTCOMES_SQL = """SELECT seq, ts, key, action, k,
  CASE WHEN c.key IS NULL THEN 'invalid' WHEN action = 'remove' THEN 'removed'
       WHEN coalesce(lag(action) OVER (PARTITION BY c.key ORDER BY ts, seq) = 'add', f.url IS NOT NULL) THEN 'already_favorite' ELSE 'added' END AS outcome
  FROM favorite_commands c LEFT JOIN favorites f ON c.key = f.url"""


@query(
    "t5_t6_favorite_outcomes",
    f"""SELECT seq, key, action, outcome, CASE WHEN outcome <> 'invalid' THEN NULL WHEN k = 44 THEN 'INVALID_PRODUCT_ID' ELSE 'INVALID_PRODUCT_URL' END AS error_code,
               CASE WHEN outcome = 'invalid' THEN 400 END::DOUBLE AS status FROM ({FAVORITE_OUTCOMES_SQL})""",
)
def _(v):
    commands = decoded(v, tracking.favorite_commands(v.favorite_commands()))
    return tracking.favorite_outcomes(commands, keyed(v.favorites(), "url")).select(*outcome_columns())


@query(
    "t5_t6_q8_favorite_state",
    f"""SELECT coalesce(f.url, c.key) AS key, strftime(coalesce(added, f.added_at), {ISO}) AS added_at
        FROM favorites f FULL JOIN (
          SELECT key, arg_max(action, seq) AS last, max(CASE WHEN outcome = 'added' THEN ts END) AS added FROM ({FAVORITE_OUTCOMES_SQL})
          WHERE key IS NOT NULL GROUP BY key) c ON f.url = c.key
        WHERE coalesce(last = 'add', TRUE)""",
)
def _(v):
    commands, state = decoded(v, tracking.favorite_commands(v.favorite_commands())), keyed(v.favorites(), "url")
    after = tracking.favorite_state(commands, state)
    return after.select("key", as_iso("addedAt").alias("added_at"))


@query(
    "t5_tracking_from_favorites",
    state_sql("(SELECT key, 'track' AS action, ts, seq FROM favorite_commands WHERE action = 'add' AND key IS NOT NULL)", "tracked_urls", "url"),
)
def _(v):
    commands = tracking.tracking_from_favorites(tracking.favorite_commands(v.favorite_commands()))
    return shown_state(tracking.tracking_state(commands, keyed(v.tracked_urls(), "url")))


# Jobs that write ---------------------------------------------------------------------------------------------------


@query(
    "q11_s5_refine_and_score",
    """SELECT url, CAST(last_seen AS VARCHAR) AS last_seen, entries, score, predicted_price, trend, (SELECT count(*) FROM histories) AS refined,
              (SELECT count(*) FROM scores) AS scored FROM histories LEFT JOIN scores USING (url)""",
)
def _(v):
    """Save, refine and score twice over: first the early visits, then all. The second run replaces the first one's scores."""
    tables, log = fresh_tables(v), v.items_log()
    early = F.col("scrapedAt") < F.lit("2024-01-16").cast("timestamp")
    for batch, part in (("early", log.filter(early)), ("late", log.filter(~early))):
        tables.save_snapshots(part, batch)
        refined, scored = nightly.refine_and_score(tables, part.agg(F.max("scrapedAt")).scalar())
    scores = tables.read("deal_scores").select("url", "score", F.col("predictedPrice").alias("predicted_price"), F.col("trendDirection").alias("trend"))
    return tables.read("price_history").select(
        "url", as_date("lastSeen").alias("last_seen"), F.size("history").alias("entries")
    ).join(scores, "url", "left").withColumns({"refined": F.lit(refined), "scored": F.lit(scored)})


def in_three_nights(v: SampleViews, tables: Tables, night) -> None:
    """Save the visits of three times one after the other, the last of them on days that the others have; `night` follows each."""
    log = v.items_log()
    early, again = F.col("scrapedAt") < F.lit("2024-01-16").cast("timestamp"), F.col("seq") % 10 == 0
    for batch, part in (("early", log.filter(early & ~again)), ("late", log.filter(~early & ~again)), ("again", log.filter(again))):
        tables.save_snapshots(part, batch)
        night(batch)


@query(
    "q1_indexed_search",
    f"""SELECT url, title, price, score, is_deal, t.* FROM (
          SELECT * FROM scored WHERE keyword = 'kw3' AND contains(lower(title), 'product') AND price <= 70
          ORDER BY price, url LIMIT 24), ({TOTALS_SQL}) t""",
)
def _(v):
    """The search of q1 from an index that was brought up to date after each of three saves."""
    tables = fresh_tables(v)
    in_three_nights(v, tables, lambda _: search_index.update_index(tables, buckets=8))
    result = search_index.search_indexed(tables, v.scores(), "kw3", search.ProductQuery.from_params(**SEARCH))
    totals = result.totals.select(F.struct(*totals_columns())).scalar()
    return result.items.select(
        "url", "title", F.col("price.amount").alias("price"), F.col("dealScore").alias("score"), F.col("isDeal").alias("is_deal"),
        totals.alias("totals"),
    ).select("url", "title", "price", "score", "is_deal", "totals.*")


@query(
    "p3_indexed_titles",
    f"""SELECT {ROW_SQL} FROM scored WHERE keyword = 'kw2' AND contains(lower(title), 'duct 1')
        UNION ALL SELECT {ROW_SQL} FROM scored WHERE keyword = 'kw5' AND contains(lower(title), '9')""",
)
def _(v):
    """Titles that have a text of six characters, from the lists of its runs of three, and one of a single character."""
    tables = fresh_tables(v)
    in_three_nights(v, tables, lambda _: search_index.update_index(tables, buckets=8))
    parts = []
    for keyword, text in (("kw2", "DUCT 1"), ("kw5", "9")):
        rows = search_index.indexed_products(tables, keyword, text)
        parts.append(rows.filter(F.contains(F.lower("title"), F.lit(text.lower()))).select(*row_columns()))
    return parts[0].unionByName(parts[1])


@query(
    "a1_q9_refined_by_night",
    f"""SELECT e.*, h.keyword, h.title, CAST(h.first_seen AS VARCHAR) AS first_seen, CAST(h.last_seen AS VARCHAR) AS last_seen, h.entries
        FROM (SELECT {ENTRY_SQL} FROM items) e JOIN histories h USING (url)""",
)
def _(v):
    """Histories brought up to date after each of three saves, from the changed days and buckets alone."""
    tables = fresh_tables(v)
    in_three_nights(v, tables, lambda _: incremental.refine_new(tables, v.as_of(), buckets=8))
    kept = incremental.histories(tables)
    return history.history_entries(kept).select(*entry_columns()).join(
        kept.select(*(c for c in history_columns() if not isinstance(c, str) or c != "shop")), "url")


@query("q10_scores_by_night", SCORES_SQL)
def _(v):
    """Scores from sums that grew with the changed days of three saves."""
    tables = fresh_tables(v)
    in_three_nights(v, tables, lambda _: incremental.update_stats(tables, buckets=8))
    return price_stats.scores_of_stats(incremental.stats_buckets(tables).read(), v.as_of()).select(*score_columns())


@query("a4_sketched_products", f"SELECT keyword, product_count AS products, true AS near, strftime(last_scrape, {ISO}) AS last_scrape FROM keyword_stats")
def _(v):
    """Products of each keyword from daily sketches of three saves, next to the exact count: no more than one in twenty off."""
    tables = fresh_tables(v)
    in_three_nights(v, tables, lambda _: sketches.update_sketches(tables, buckets=8))
    about = summaries.approximate_keyword_stats(sketches.sketched_days(tables)).select("keyword", F.col("productCount").alias("about"), "lastScrape")
    exact = summaries.keyword_stats(v.items()).select("keyword", F.col("productCount").alias("products"))
    near = F.abs(F.col("about") - F.col("products")) * 20 <= F.col("products")
    return exact.join(about, "keyword", "full").select("keyword", "products", near.alias("near"), as_iso("lastScrape").alias("last_scrape"))


DEAD_SQL = "(SELECT url FROM fetch_log GROUP BY url HAVING max(seq) = max(seq) FILTER (final_url = 'https://www.amazon.fr/'))"


@query(
    "s6_deletions_logged",
    f"""SELECT 'history' AS source, url FROM histories WHERE url NOT IN {DEAD_SQL}
        UNION ALL SELECT 'scores', url FROM scores WHERE url NOT IN {DEAD_SQL}
        UNION ALL SELECT 'refined', url FROM histories""",
)
def _(v):
    """Dead products out of histories and scores by a log, and back with the next refine, since their visits are still stored."""
    tables = fresh_tables(v)
    tables.save_snapshots(v.items_log(), "all")
    incremental.refine_and_score_new(tables, v.as_of())
    last = F.max_by(F.struct("final_url"), "seq")
    dead = frontier.dead_products(v.fetch_log().groupBy("url").agg(last.alias("r")).select("url", "r.final_url"))
    incremental.delete_products(tables, dead)
    parts = [
        tables.stage(f"shown_{name}", lambda: rows.select(F.lit(name).alias("source"), "url"))
        for name, rows in (("history", incremental.histories(tables)), ("scores", incremental.scores(tables)))
    ]
    incremental.refine_new(tables, v.as_of())
    return parts[0].unionByName(parts[1]).unionByName(incremental.histories(tables).select(F.lit("refined").alias("source"), "url"))


@query("r1_streamed_snapshots", f"SELECT {DATED_SQL} FROM items")
def _(v):
    tables = fresh_tables(v)
    events = v.table("events").schema
    stream = v.spark.readStream.schema(events).option("pathGlobFilter", "events.parquet").parquet(v.folder)
    save_stream(visits(stream), tables, f"{tables.folder}/stream").awaitTermination()
    return tables.items().select(*dated_columns())


@query(
    "r1_streamed_deltas",
    f"SELECT 'appended' AS how, {DATED_SQL} FROM items UNION ALL SELECT 'compacted', {DATED_SQL} FROM items",
)
def _(v):
    """The stream with state: daily rows as they are with what it appended, and after that was merged."""
    tables = fresh_tables(v)
    events = v.table("events").schema
    stream = v.spark.readStream.schema(events).option("pathGlobFilter", "events.parquet").parquet(v.folder)
    save_deltas(visits(stream), tables, f"{tables.folder}/stream").awaitTermination()
    appended = tables.stage("appended", lambda: items_now(tables))
    compact_deltas(tables)
    parts = [rows.select(F.lit(how).alias("how"), *dated_columns()) for how, rows in (("appended", appended), ("compacted", tables.items()))]
    return parts[0].unionByName(parts[1])


def in_two_parts(raw: DataFrame) -> list[DataFrame]:
    """Commands of a first and of a later time."""
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    return [raw.filter(early), raw.filter(~early)]


@query("q8_keywords_written", state_sql("keyword_commands", "keywords", "keyword"))
def _(v):
    tables = fresh_tables(v)
    tables.replace("keywords", v.keywords())
    for part in in_two_parts(v.keyword_commands()):
        commands.apply_commands(tables, keywords=part)
    return shown_state(keyed(tables.read("keywords"), "keyword"))


@query(
    "q8_t5_urls_written",
    state_sql(
        """(SELECT key, action, ts, seq FROM url_commands
            UNION ALL SELECT key, 'track', ts, seq FROM favorite_commands WHERE action = 'add' AND key IS NOT NULL)""",
        "tracked_urls", "url"),
)
def _(v):
    """Url commands and the tracking that favourites bring about, in one order."""
    tables = fresh_tables(v)
    tables.replace("tracked_urls", v.tracked_urls())
    tables.replace("favorites", v.favorites())
    for urls, favorites in zip(in_two_parts(v.url_commands()), in_two_parts(v.favorite_commands())):
        commands.apply_commands(tables, urls=urls, favorites=favorites)
    return shown_state(keyed(tables.read("tracked_urls"), "url"))


@query(
    "e1_s1_pages_to_items",
    f"""SELECT DISTINCT {PAGE_URL} AS url, 'Page ' || page_id AS title, CAST(page_id || '.99' AS DOUBLE) AS crossed,
               CAST(CAST(make_timestamp(CAST((1704067200 + page_id * 60) AS BIGINT) * 1000000) AS DATE) AS VARCHAR) AS day FROM {SHOWN_PAGES}""",
)
def _(v):
    """Fetched pages, saved as daily rows by a round of the crawl."""
    tables = fresh_tables(v)
    crawl.take_in(tables, v.product_pages(), "1")
    return tables.items().select("url", "title", F.col("crossedOutPrice.amount").alias("crossed"), as_date("day").alias("day"))


@query(
    "q12_crawl_round",
    f"""SELECT DISTINCT url, label, keyword FROM (
          SELECT 'https://www.amazon.fr/s?k=' || keyword AS url, 'SEARCH' AS label, keyword FROM keywords WHERE enabled
          UNION ALL SELECT 'https://www.amazon.fr/dp/Q' || lpad(CAST(page_id AS VARCHAR), 9, '0') || '/', NULL,
            CASE WHEN page_id % 4 <> 0 THEN 'kw' || (page_id % 7) END FROM {SHOWN_PAGES}
          UNION ALL SELECT 'https://www.amazon.fr/dp/P' || lpad(CAST((page_id * 7) % 1000000 AS VARCHAR), 9, '0') || '/', NULL,
            CASE WHEN page_id % 4 <> 0 THEN 'kw' || (page_id % 7) END FROM {SHOWN_PAGES} AND page_id <> (page_id * 7) % 1000000)""",
)
def _(v):
    """What a round asks for next, from stored keywords and the variants on its pages."""
    tables = fresh_tables(v)
    tables.replace("keywords", v.keywords())
    variants = crawl.take_in(tables, v.product_pages(), "1")
    return crawl.next_requests(tables, variants).select("url", "label", "keyword")


@query(
    "x5_last_entries",
    """SELECT url, CAST(day AS VARCHAR) AS day, price, rank FROM (
         SELECT url, day, price, row_number() OVER (PARTITION BY url ORDER BY day DESC) AS rank FROM items) WHERE rank <= 7""",
)
def _(v):
    """The newest entries of each stored history, last one first."""
    shown = v.history().select("url", F.posexplode(arrays.last_n(F.col("history"), fixed.HISTORY_LIMIT_FAVORITES)).alias("at", "e"))
    return shown.select("url", as_date("e.day").alias("day"), F.col("e.price.amount").alias("price"), (F.col("at") + 1).alias("rank"))
