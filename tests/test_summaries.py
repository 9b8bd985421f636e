"""Orders that a comparison of row sets cannot see, and summaries with gaps."""

import datetime as dt

import pytest

from pricetide import schema
from pricetide.operators import frontier, snapshots, summaries
from pricetide.plans import search
from test_history import visit

DAY = dt.datetime(2024, 6, 1, 9)


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        visit(f"u{i}", DAY, i, title=title, keyword=keyword, price=(5.0, "EUR"), images=[f"i{i}"])
        for i, (title, keyword) in enumerate([("zèbre", "zèbre"), ("eau", "eau"), ("Été", "Été"), ("écran", "écran"), ("ete", "ete"), ("", "blank"), (None, "été")])
    ] + [visit("u1", DAY + dt.timedelta(days=1), 9, title="eau", keyword="autre", price=(4.0, "EUR"))]
    return snapshots.daily_snapshots(spark.createDataFrame(rows, schema.SNAPSHOT_LOG)).persist()


def test_keywords_in_french_order(spark, items):
    keywords = spark.createDataFrame([("vide", True), ("eau", False), ("blank", None)], schema.KEYWORDS)
    rows = summaries.keyword_summaries(items, keywords).collect()
    assert [row.keyword for row in rows] == ["autre", "eau", "écran", "ete", "été", "Été", "vide", "zèbre"]
    counts = {row.keyword: (row.productCount, row.lastScrape) for row in rows}
    assert counts["vide"] == (0, None) and counts["eau"] == (1, "2024-06-01T09:00:00.000Z")
    assert [row.keyword for row in summaries.matching_keywords(summaries.keyword_summaries(items, keywords), "ÉTÉ").collect()] == ["été", "Été"]
    assert summaries.matching_keywords(summaries.keyword_summaries(items, keywords), "  ").count() == 8


def test_tracked_urls(spark, items):
    tracked = spark.createDataFrame([("u0", True), ("u3", True), ("u5", True), ("nothing", True), ("u2", False), ("u4", None)], schema.TRACKED_URLS)
    listed = summaries.tracked_url_summaries(items, tracked)
    assert [(row.url, row.title, row.image) for row in listed.collect()] == [
        ("u3", "écran", "i3"), ("nothing", None, None), ("u5", None, "i5"), ("u0", "zèbre", "i0")
    ]
    assert [row.url for row in summaries.matching_tracked_urls(listed, "U").collect()] == ["u3", "u5", "u0"]


def test_dashboard_order_and_moved_products(spark, items):
    scores = spark.createDataFrame([("u1", 30.0), ("u0", 10.0), ("u3", 9.9), ("u5", 50.0), ("other", 60.0)], "url string, score double").selectExpr(
        "url", "score", "1.0D AS predictedPrice", "'up' AS trendDirection"
    )
    rows = summaries.keyword_deals(items, scores).collect()
    # u1 moved to "autre": its deal is there, yet it still counts as a product of "eau".
    assert [(row.keyword, row.productCount, row.totalDeals) for row in rows] == [
        ("autre", 1, 1), ("zèbre", 1, 1), ("eau", 1, 0), ("écran", 1, 0), ("ete", 1, 0), ("été", 1, 0), ("Été", 1, 0)
    ]
    assert [deal.url for deal in rows[0].deals] == ["u1"] and rows[2].deals == []
    assert summaries.with_deals(summaries.keyword_deals(items, scores)).count() == 2
    empty = spark.createDataFrame([], schema.PRICE_HISTORY)
    found = search.dashboard(items, empty, scores, spark.createDataFrame([("a", None)], schema.KEYWORDS)).counters.first()
    assert found.asDict() == {"keywordCount": 0, "productCount": 0, "dealCount": 4, "lastUpdate": None}


def test_favourites_newest_first(spark, items):
    favorites = spark.createDataFrame([("u0", DAY), ("u1", DAY + dt.timedelta(days=1)), ("never seen", DAY)], schema.FAVORITES)
    empty, scores = spark.createDataFrame([], schema.PRICE_HISTORY), spark.createDataFrame([], schema.DEAL_SCORES)
    rows = summaries.favorite_details(items, empty, scores, favorites).collect()
    assert [(row.url, row.keyword, row.history, row.firstSeen) for row in rows] == [("u1", "autre", [], None), ("u0", "zèbre", [], None)]
    assert search.find_product(items, empty, scores, "never seen").count() == 0


def test_frontier(spark):
    history = spark.createDataFrame(
        [(f"p{i:03}", "k", (DAY - dt.timedelta(days=i)).date()) for i in range(200)] + [("q", "off", DAY.date()), ("n", None, DAY.date())],
        "url string, keyword string, lastSeen date",
    )
    keywords = spark.createDataFrame([("k", True), ("off", False), ("new one", True)], schema.KEYWORDS)
    tracked = spark.createDataFrame([("t", True), ("s", None)], schema.TRACKED_URLS)
    rows = frontier.crawl_frontier(keywords, history, tracked).collect()
    assert sorted(row.url for row in rows if row.label == "SEARCH") == ["https://www.amazon.fr/s?k=k", "https://www.amazon.fr/s?k=new%20one"]
    assert sorted(row.url for row in rows if row.label is None and row.keyword == "k") == [f"p{i:03}" for i in range(50, 200)]
    assert [row.url for row in rows if row.label is None and row.keyword is None] == ["t"]
    none = frontier.crawl_frontier(keywords.filter("false"), history, tracked.filter("false"))
    assert none.count() == 0
