"""Search parameters, orders and pages."""

import pytest
from pyspark.sql import functions as F

from pricetide import fixed
from pricetide.operators import catalog
from pricetide.plans.search import InvalidProductQuery, ProductQuery, scored_products, search_clamped, search_products

ITEMS = "url string, title string, price struct<amount:double,currency:string>, crossedOutPrice struct<amount:double,currency:string>, " \
    "unitPrice struct<amount:double,unit:string>, deliveryDate string, images array<string>, shop string, keyword string, scrapedAt timestamp, day date"
SCORES = "url string, score double, predictedPrice double, trendDirection string"


def test_defaults():
    query = ProductQuery.from_params()
    assert (query.sort, query.page, query.search, query.deals_only, query.min_price, query.max_price) == ("deals", 1, None, False, None, None)


@pytest.mark.parametrize(
    "params, field, value",
    [
        ({"page": "3"}, "page", 3), ({"page": "1e1"}, "page", 10), ({"q": "  savon  "}, "search", "savon"), ({"q": "   "}, "search", None),
        ({"deals": "1"}, "deals_only", True), ({"deals": "true"}, "deals_only", True), ({"deals": "0"}, "deals_only", False),
        ({"deals": "false"}, "deals_only", False), ({"min": "10", "max": "10"}, "max_price", 10.0), ({"min": ""}, "min_price", None),
        ({"q": "a" * 100}, "search", "a" * 100), ({"q": "\ufeff\u3000"}, "search", None),
        ({"q": "\x1csavon"}, "search", "\x1csavon"), ({"sort": "discount"}, "sort", "discount"),
    ],
)
def test_accepted(params, field, value):
    assert getattr(ProductQuery.from_params(**params), field) == value


@pytest.mark.parametrize(
    "params",
    [
        {"sort": "cheapest"}, {"sort": ""}, {"page": "0"}, {"page": "1.5"}, {"page": "deux"}, {"page": ""}, {"min": "-1"}, {"max": "cher"},
        {"max": "Infinity"}, {"deals": "oui"}, {"deals": ""}, {"q": "a" * 101}, {"min": "50", "max": "10"}, {"min": "0x" + 300 * "f"}, {"colour": "red"},
    ],
)
def test_refused(params):
    with pytest.raises(InvalidProductQuery):
        ProductQuery.from_params(**params)


def item(url, amount, title="Savon", day="2024-01-02", keyword="k", crossed=None):
    import datetime as dt

    date = dt.date.fromisoformat(day)
    money = lambda x: None if x is None else (x, "EUR")
    return (url, title, money(amount), money(crossed), None, None, [], "amazon", keyword, dt.datetime.combine(date, dt.time(9)), date)


@pytest.fixture(scope="module")
def shop(spark):
    items = [item(f"u{i:03}", float(i % 10 + 1), crossed=12.0 if i % 3 else None) for i in range(50)]
    items += [
        item("gone", 5.0, day="2024-01-01"), item("gone", None),  # newest row has no price
        item("moved", 5.0, day="2024-01-01"), item("moved", 6.0, keyword="other"),
        item("untitled", 1.0, title=None), item("blank", 1.0, title=""),
    ]
    scores = [(f"u{i:03}", float(i - 5), 9.0, "up") for i in range(0, 50, 2)]
    return spark.createDataFrame(items, ITEMS).persist(), spark.createDataFrame(scores, SCORES).persist()


def test_totals_and_newest_row_rules(shop):
    result = search_products(*shop, "k", ProductQuery.from_params(q="SAVON"))
    totals = result.totals.first()
    # u000-u049, moved (at its row under k) and untitled; gone and blank are unusable. A null title matches no text.
    assert (totals.keywordTotal, totals.total, totals.pageCount) == (52, 51, 3)
    assert totals.keywordDealCount == len([i for i in range(0, 50, 2) if i - 5 >= 10])
    assert search_products(*shop, "nothing").totals.first() == (0, 0, 0, 0)


def ordered(shop, sort):
    scored = {row.url: row.score for row in shop[1].collect()}
    rows = [(f"u{i:03}", float(i % 10 + 1), 12.0 if i % 3 else None) for i in range(50)] + [("moved", 5.0, None), ("untitled", 1.0, None)]
    score = lambda url: scored.get(url, -1.0)
    keys = {
        "deals": lambda r: (-(score(r[0]) >= 10), -score(r[0]), r[1], r[0]), "price_asc": lambda r: (r[1], r[0]),
        "price_desc": lambda r: (-r[1], r[0]), "discount": lambda r: (-(1 - r[1] / r[2] if r[2] else 0.0), r[0]),
    }
    return [row[0] for row in sorted(rows, key=keys[sort])]


@pytest.mark.parametrize("sort", fixed.SORTS)
def test_pages_in_order(shop, sort):
    expected = ordered(shop, sort)
    for page in (1, 2, 3):
        found = [row.url for row in search_products(*shop, "k", ProductQuery(sort=sort, page=page)).items.collect()]
        assert found == expected[(page - 1) * 24 : page * 24]
    last = search_clamped(*shop, "k", ProductQuery(sort=sort, page=99)).items
    assert [row.url for row in last.collect()] == expected[48:]
    # The far half is sorted from the other end.
    second = search_clamped(*shop, "k", ProductQuery(sort=sort, page=2)).items
    assert [row.url for row in second.collect()] == expected[24:48]


@pytest.mark.parametrize("sort", fixed.SORTS)
@pytest.mark.parametrize("total", [None, 52])
def test_far_pages(shop, sort, total):
    scored = scored_products(*shop, "k")
    expected = ordered(shop, sort)
    for page in (2, 3, 4):
        rows = catalog.page_rows(scored, sort, page, total).collect()
        assert [row.url for row in rows] == expected[(page - 1) * 24 : page * 24]


def test_clamp():
    assert catalog.clamp_page(9, 49) == 3 and catalog.clamp_page(2, 49) == 2
    with pytest.raises(LookupError):
        catalog.clamp_page(1, 0)


def test_summary_has_its_fields(shop):
    names = search_products(*shop, "k").items.columns
    assert names == (
        "id url keyword shop title images price crossedOutPrice unitPrice deliveryDate scrapedAt dealScore predictedPrice trendDirection isDeal"
    ).split()
