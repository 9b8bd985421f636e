"""Q1, Q2, Q3: product search, product detail and dashboard."""

import math
import re
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide import fixed
from pricetide.operators import catalog, summaries
from pricetide.operators.snapshots import latest_usable


class InvalidProductQuery(ValueError):
    code = "INVALID_PRODUCT_QUERY"


def _float(number: int) -> float:
    """The nearest double; infinite where none is near."""
    try:
        return float(number)
    except OverflowError:
        return math.inf


def _number(text: str) -> float:
    """A number as web forms write it; not a number where it is none."""
    text = text.strip(fixed.SPACES)
    if not text:
        return 0.0
    if re.fullmatch(r"0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+", text):
        return _float(int(text, 0))
    if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", text):
        return float(text)
    return math.nan


@dataclass(frozen=True)
class ProductQuery:
    """A checked search."""

    search: str | None = None
    deals_only: bool = False
    min_price: float | None = None
    max_price: float | None = None
    sort: str = fixed.DEFAULT_SORT
    page: int = 1

    @classmethod
    def from_params(cls, **params: str) -> "ProductQuery":
        unknown = set(params) - {"q", "deals", "min", "max", "sort", "page"}
        if unknown:
            raise InvalidProductQuery(f"unknown parameter: {', '.join(sorted(unknown))}")
        low, high = (cls._price(params.get(name), name) for name in ("min", "max"))
        if low is not None and high is not None and high < low:
            raise InvalidProductQuery("max is below min")
        return cls(
            cls._search(params.get("q")), cls._flag(params.get("deals")), low, high,
            cls._sort(params.get("sort")), cls._page(params.get("page")),
        )

    @staticmethod
    def _search(raw):
        trimmed = (raw or "").strip(fixed.SPACES)
        if len(trimmed.encode("utf-16-le")) // 2 > fixed.MAX_SEARCH_LENGTH:
            raise InvalidProductQuery(f"q is longer than {fixed.MAX_SEARCH_LENGTH} characters")
        return trimmed or None

    @staticmethod
    def _flag(raw):
        words = {None: False, "0": False, "false": False, "1": True, "true": True}
        if raw not in words:
            raise InvalidProductQuery("deals is one of 1, 0, true, false")
        return words[raw]

    @staticmethod
    def _price(raw, name):
        if raw is None or raw == "":
            return None
        value = _number(raw)
        if not (math.isfinite(value) and value >= 0):
            raise InvalidProductQuery(f"{name} is a number from 0")
        return value

    @staticmethod
    def _sort(raw):
        if raw is not None and raw not in fixed.SORTS:
            raise InvalidProductQuery(f"sort is one of {', '.join(fixed.SORTS)}")
        return raw or fixed.DEFAULT_SORT

    @staticmethod
    def _page(raw):
        value = 1.0 if raw is None else _number(raw)
        if not (math.isfinite(value) and value.is_integer() and value >= 1):
            raise InvalidProductQuery("page is a whole number from 1")
        return int(value)


class SearchResult(NamedTuple):
    items: DataFrame
    totals: DataFrame


def scored_products(items: DataFrame, scores: DataFrame, keyword: str) -> DataFrame:
    """The keyword's products at their newest snapshot within that keyword. The keyword test reaches the scan."""
    return catalog.with_scores(latest_usable(items.filter(F.col("keyword") == keyword), "url"), scores)


def search_totals(scored: DataFrame, query: ProductQuery) -> DataFrame:
    """All totals in one aggregation, zeros where the keyword is unknown."""
    total = F.count_if(catalog.matches(query))
    return scored.agg(
        total.alias("total"),
        catalog.page_count(total).alias("pageCount"),
        F.count(F.lit(1)).alias("keywordTotal"),
        F.count_if("isDeal").alias("keywordDealCount"),
    )


def search_products(items: DataFrame, scores: DataFrame, keyword: str, query: ProductQuery = ProductQuery()) -> SearchResult:
    """Q1. `persist` the items and scores given, or read them from tables, when both parts are wanted."""
    scored = scored_products(items, scores, keyword)
    page = catalog.page_rows(scored.filter(catalog.matches(query)), query.sort, query.page)
    return SearchResult(catalog.product_summary(page), search_totals(scored, query))


def search_clamped(items: DataFrame, scores: DataFrame, keyword: str, query: ProductQuery = ProductQuery()) -> SearchResult:
    """Q1 with K3: a page past the end shows the last one. Counts first: the page to sort for depends on it."""
    scored = scored_products(items, scores, keyword)
    totals = search_totals(scored, query)
    counted = totals.first()
    if counted["keywordTotal"] == 0:
        raise LookupError("PRODUCT_NOT_FOUND")
    rows = scored.filter(catalog.matches(query))
    if counted["total"] == 0:
        return SearchResult(catalog.product_summary(rows.limit(0)), totals)
    page = catalog.clamp_page(query.page, counted["total"])
    return SearchResult(catalog.product_summary(catalog.page_rows(rows, query.sort, page, counted["total"])), totals)


def find_product(items: DataFrame, history: DataFrame, scores: DataFrame, url: str) -> DataFrame:
    """Q2: the detail of one product; no row where it was never seen."""
    return catalog.product_details(*(table.filter(F.col("url") == url) for table in (items, history, scores)))


class Dashboard(NamedTuple):
    counters: DataFrame
    keywords: DataFrame


def dashboard(items: DataFrame, history: DataFrame, scores: DataFrame, keywords: DataFrame) -> Dashboard:
    """Q3."""
    return Dashboard(summaries.counters(keywords, history, scores), summaries.keyword_deals(items, scores))
