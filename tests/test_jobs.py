"""Commands and crawl rounds over stored tables."""

import datetime as dt
import tempfile

import pytest

from pricetide import schema
from pricetide.functions.ids import product_id
from pricetide.plans import commands, crawl
from pricetide.sources import tables as stored_tables
from pricetide.sources.tables import Tables
from pyspark.sql import functions as F

AT = dt.datetime(2024, 6, 1)
RAW = "raw_key string, action string, ts timestamp, seq long"
URL = "https://www.amazon.fr/dp/B00000000{}/"


@pytest.fixture
def tables(spark):
    return Tables(spark, tempfile.mkdtemp(prefix="run-"))


def raw(spark, *rows):
    return spark.createDataFrame([(key, action, AT + dt.timedelta(minutes=n), n) for n, key, action in rows], RAW)


def ident(spark, url):
    return spark.range(1).select(product_id(F.lit(url))).first()[0]


def test_keyword_commands_are_written(spark, tables):
    first = raw(spark, (1, " savon ", "track"), (2, "savon", "track"), (3, "", "track"), (4, "x", "untrack"))
    outcomes = commands.apply_commands(tables, keywords=first).keywords
    assert [r.outcome for r in outcomes.orderBy("seq").collect()] == ["created", "conflict", "invalid", "not_found"]
    commands.apply_commands(tables, keywords=raw(spark, (5, "savon", "untrack")))
    assert [tuple(r) for r in tables.read("keywords").collect()] == [("savon", False)]
    again = commands.apply_commands(tables, keywords=raw(spark, (6, "savon", "track"))).keywords
    assert [r.outcome for r in again.collect()] == ["reenabled"] and tables.read("keywords").first().enabled


def test_outcomes_outlive_later_writes(spark, tables):
    outcomes = commands.apply_commands(tables, keywords=raw(spark, (1, "savon", "track"))).keywords
    for n in range(stored_tables.KEPT_VERSIONS + 2):
        commands.apply_commands(tables, keywords=raw(spark, (2 + n, "savon", "untrack" if n % 2 == 0 else "track")))
    assert [r.outcome for r in outcomes.collect()] == ["created"]


def test_favorites_track_their_urls_in_order(spark, tables):
    one, two = (ident(spark, URL.format(n)) for n in (1, 2))
    urls = raw(spark, (1, URL.format(1), "track"), (3, one, "untrack"), (6, URL.format(2), "track"))
    favorites = raw(spark, (2, one, "add"), (4, one, "remove"), (5, two, "add"), (7, "###", "add"))
    outcomes = commands.apply_commands(tables, urls=urls, favorites=favorites)
    assert [r.outcome for r in outcomes.urls.orderBy("seq").collect()] == ["created", "untracked", "conflict"]
    assert [r.outcome for r in outcomes.favorites.orderBy("seq").collect()] == ["added", "removed", "added", "invalid"]
    assert {(r.url[-2], r.enabled) for r in tables.read("tracked_urls").collect()} == {("1", False), ("2", True)}
    assert [(r.url[-2], r.addedAt) for r in tables.read("favorites").collect()] == [("2", AT + dt.timedelta(minutes=5))]
    commands.apply_commands(tables, urls=urls, favorites=favorites)  # the same once more
    assert {(r.url[-2], r.enabled) for r in tables.read("tracked_urls").collect()} == {("1", False), ("2", True)}
    assert tables.read("favorites").first().addedAt == AT + dt.timedelta(minutes=5)


def test_old_versions_go_after_a_while(spark, tables):
    for n in range(stored_tables.KEPT_VERSIONS + 3):
        tables.replace("keywords", spark.createDataFrame([(f"k{n}", True)], schema.KEYWORDS))
    assert len(tables._versions("keywords")) == stored_tables.KEPT_VERSIONS + 1
    assert tables.read("keywords").first().keyword == f"k{n}"


def test_crawl_round(spark, tables):
    page = '<b id="productTitle">T</b><div id="twister"><i data-asin="B000000002"></i></div>'
    pages = spark.createDataFrame(
        [(URL.format(1), URL.format(1), page, "k", AT), (URL.format(3), "https://www.amazon.fr/", page, "k", AT)], schema.PAGES)
    crawl.seed(tables, spark.createDataFrame([("k",), ("l",)], "keyword string"))
    crawl.seed(tables, spark.createDataFrame([("m",)], "keyword string"))
    history = spark.createDataFrame([(URL.format(3),) + (None,) * 8], schema.PRICE_HISTORY)
    tables.replace("price_history", history)
    for _ in range(2):  # a repeat changes nothing
        variants = crawl.take_in(tables, pages, "1")
    assert [(r.url, r.title, r.seq is not None) for r in tables.items().collect()] == [(URL.format(1), "T", True)]
    assert tables.read("price_history").count() == 0
    wanted = {(r.url, r.label, r.keyword) for r in crawl.next_requests(tables, variants).collect()}
    assert wanted == {
        ("https://www.amazon.fr/s?k=k", "SEARCH", "k"), ("https://www.amazon.fr/s?k=l", "SEARCH", "l"), (URL.format(2), None, "k")}
