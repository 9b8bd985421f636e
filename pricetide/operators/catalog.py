"""Products with their scores: search, ordering, paging, projection, detail."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide import fixed
from pricetide.functions import arrays, dates, ids, money, text
from pricetide.operators import history as hist
from pricetide.operators.ranges import Ranges
from pricetide.operators.snapshots import ROW_FIELDS, latest

SCORE_FIELDS = ("dealScore", "predictedPrice", "trendDirection")


def score_columns(scores: DataFrame) -> DataFrame:
    return scores.select("url", F.col("score").alias("dealScore"), "predictedPrice", "trendDirection")


def with_scores(products: DataFrame, scores: DataFrame) -> DataFrame:
    """Products with their scores, unscored ones included, and the columns that searches sort and filter by."""
    return products.join(score_columns(scores), "url", "left").withColumns(
        {
            "isDeal": money.is_deal(F.col("dealScore")),
            "sortScore": F.coalesce("dealScore", F.lit(float(fixed.UNSCORED))),
            "discountRatio": money.discount_ratio(F.col("price.amount"), F.col("crossedOutPrice.amount")),
        }
    )


def deals(scores: DataFrame) -> DataFrame:
    """The scores that make a deal."""
    return score_columns(scores).filter(F.col("dealScore") >= fixed.DEAL_SCORE_THRESHOLD)


_PRICE = ("price.amount", False)
# Columns of each order, and whether they go down.
SORT_COLUMNS = {
    "deals": [("isDeal", True), ("sortScore", True), _PRICE],
    "price_asc": [_PRICE],
    "price_desc": [("price.amount", True)],
    "discount": [("discountRatio", True)],
}


def sort_order(sort: str, backwards: bool = False) -> list[Column]:
    """K1: four total orders; each ends on the url."""
    columns = [*SORT_COLUMNS[sort], ("url", False)]
    return [F.desc(name) if down != backwards else F.asc(name) for name, down in columns]


def matches(query) -> Column:
    """The row test of a search."""
    test = F.lit(True)
    if query.search is not None:
        test = test & text.contains_ignoring_case(F.col("title"), query.search)
    if query.deals_only:
        test = test & F.col("isDeal")
    if query.min_price is not None:
        test = test & (F.col("price.amount") >= query.min_price)
    if query.max_price is not None:
        test = test & (F.col("price.amount") <= query.max_price)
    return F.coalesce(test, F.lit(False))


def page_rows(products: DataFrame, sort: str, page: int, total: int | None = None) -> DataFrame:
    """K2: one page in the given order; nothing past the end.

    One lazy plan, however far the page is. Each task keeps the rows up to the page while it sorts, so a page costs
    memory for what lies before it; with `total` known a page in the far half is read from the other end, so the last
    page costs what the first does, and one past the end is not read at all.
    """
    size = fixed.PAGE_SIZE
    skip = (page - 1) * size
    if total is None:
        return products.orderBy(*sort_order(sort)).offset(skip).limit(size)
    size = min(size, total - skip)
    if size <= 0:
        return products.limit(0)
    behind = total - skip - size
    found = products.orderBy(*sort_order(sort, backwards=behind < skip)).offset(min(skip, behind)).limit(size)
    return found.orderBy(*sort_order(sort)) if behind < skip else found


def page_by_ranges(products: DataFrame, sort: str, page: int, key: tuple[str, ...] = ("url",)) -> DataFrame:
    """K2: one page in the given order, wherever it lies: a page in the middle costs what the first one does.

    Only keys and sort columns are cut into ranges and written; the counts of the ranges say which of them has the page, and
    its rows' keys are read from there. `key` names what makes a product one row; it is where the order ends. Nothing is
    lazy here but the page itself.
    """
    names = SORT_COLUMNS[sort]
    narrow = products.select(*key, *[F.col(name).alias(f"sort_{i}") for i, (name, _) in enumerate(names)])
    order = [F.desc(f"sort_{i}") if down else F.asc(f"sort_{i}") for i, (_, down) in enumerate(names)]
    found = Ranges(narrow, [*order, "url", *[k for k in key if k != "url"]]).stretch((page - 1) * fixed.PAGE_SIZE, fixed.PAGE_SIZE)
    # No more rows than a page has.
    page_keys = F.broadcast(found.select(*key))
    return products.join(page_keys, list(key), "left_semi").orderBy(*sort_order(sort), *[k for k in key if k != "url"])


def page_count(total: Column) -> Column:
    return F.ceil(total / fixed.PAGE_SIZE)


def clamp_page(page: int, total: int) -> int:
    """K3: a page past the end becomes the last one; nothing to show is an error."""
    if total == 0:
        raise LookupError("PRODUCT_NOT_FOUND")
    return min(page, -(-total // fixed.PAGE_SIZE))


def product_summary(products: DataFrame, *more: Column) -> DataFrame:
    """The 15 fields of a product as shown, and what else the caller adds."""
    score = money.finite(F.col("dealScore"))
    return products.select(
        ids.product_id(F.col("url")).alias("id"),
        "url",
        "keyword",
        F.coalesce("shop", F.lit(fixed.DEFAULT_SHOP)).alias("shop"),
        F.coalesce("title", F.lit("")).alias("title"),
        arrays.known_elements(F.col("images")).alias("images"),
        money.complete_money(F.col("price")).alias("price"),
        money.complete_money(F.col("crossedOutPrice")).alias("crossedOutPrice"),
        money.complete_unit_price(F.col("unitPrice")).alias("unitPrice"),
        "deliveryDate",
        F.coalesce(dates.iso(F.col("scrapedAt")), F.lit("")).alias("scrapedAt"),
        score.alias("dealScore"),
        money.finite(F.col("predictedPrice")).alias("predictedPrice"),
        money.known_trend(F.col("trendDirection")).alias("trendDirection"),
        money.is_deal(score).alias("isDeal"),
        *more,
    )


def product_details(items: DataFrame, history: DataFrame, scores: DataFrame) -> DataFrame:
    """One detail per product that has a snapshot or a history.

    The newest snapshot leads; the stored history and its last entry fill what it lacks. For a single product or a
    list of them, filter the three inputs by url first.
    """
    newest = latest(items, "url").select("url", F.struct(*ROW_FIELDS).alias("newest"))
    stored = history.select(
        "url",
        F.struct("shop", "keyword", "title", "images", "firstSeen", "lastSeen", "history").alias("stored"),
        arrays.last_or_null(F.col("history")).alias("entry"),
    )
    joined = newest.join(stored, "url", "full").join(score_columns(scores), "url", "left")
    last_seen = dates.midnight(F.col("stored.lastSeen"))
    merged = joined.select(
        "url",
        F.coalesce("newest.keyword", "stored.keyword").alias("keyword"),
        F.coalesce("newest.shop", "stored.shop").alias("shop"),
        F.coalesce(F.nullif(F.col("newest.title"), F.lit("")), F.col("stored.title")).alias("title"),
        F.coalesce(arrays.non_empty(F.col("newest.images")), F.col("stored.images")).alias("images"),
        *[
            F.coalesce(f"newest.{name}", f"entry.{name}").alias(name)
            for name in ("price", "crossedOutPrice", "unitPrice")
        ],
        F.col("newest.deliveryDate").alias("deliveryDate"),
        F.coalesce("newest.scrapedAt", "entry.scrapedAt", F.when(F.col("entry").isNull(), last_seen)).alias("scrapedAt"),
        *SCORE_FIELDS,
        "stored",
    )
    return product_summary(
        merged,
        hist.projected_entries(F.col("stored.history")).alias("history"),
        dates.iso_day(F.col("stored.firstSeen")).alias("firstSeen"),
        dates.iso_day(F.col("stored.lastSeen")).alias("lastSeen"),
    )
