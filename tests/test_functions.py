"""Column functions on small literal rows."""

import base64
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pricetide import fixed
from pricetide.functions import arrays, dates, ids, money, text


def apply(spark, function, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"n int, x {kind}")
    return [row.y for row in rows.select("n", function(F.col("x")).alias("y")).orderBy("n").collect()]


def encoded(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def test_product_id_round_trip(spark):
    urls = ["https://www.amazon.fr/dp/B0CZ1TL7XK?th=1&psc=1", "https://www.amazon.fr/dp/é/ü?x=" + "y" * 200]
    made = apply(spark, ids.product_id, urls)
    assert made == [encoded(url.encode()) for url in urls]
    assert apply(spark, ids.url_of_product_id, made) == urls


def test_product_id_refused(spark):
    bad = {
        "": "missing", None: "missing", "abc/def": "alphabet", "aHR0cHM6Ly9hYg==": "alphabet", "a" * 2049: "too_long",
        encoded(b"file:///etc/passwd"): "not_http", encoded(b"https://x/\xff\xfe"): "malformed", "aHR0cHM6Ly9hY": "malformed",
        "aHR0c": "malformed", encoded(b"https://ab")[:-1] + "h": "malformed",
    }
    assert apply(spark, ids.product_id_error, bad) == list(bad.values())
    assert apply(spark, ids.url_of_product_id, bad) == [None] * len(bad)


def test_product_id_agrees_with_reencoding(spark):
    """The pattern for sound ids accepts exactly what decodes to UTF-8 http text and encodes back to itself."""
    random.seed(7)
    values = [encoded(b"http://" + bytes(random.choices(range(32, 127), k=random.randint(0, 9)))) for _ in range(60)]
    values += [value[: random.randint(9, len(value))] for value in values]
    values += [value + random.choice("AQgwEIz9-_") for value in values]

    def expected(value):
        try:
            raw = base64.urlsafe_b64decode(value + "=" * (-len(value) % 4))
            url = raw.decode()
        except (ValueError, UnicodeDecodeError):
            return None
        return url if encoded(raw) == value and url.startswith("http://") else None

    assert apply(spark, ids.url_of_product_id, values) == [expected(value) for value in values]


def test_canonical_product_url(spark):
    good = "https://www.amazon.fr/dp/B0ABCDEFGH/"
    cases = {
        "https://www.amazon.fr/Some-Title/dp/b0abcdefgh/?ref=xyz": good,
        "https://amazon.fr/dp/B0ABCDEFGH": good,
        "  https://www.amazon.fr/Titre Produit/dp/B0ABCDEFGH\n": good,
        "https://www.amazon.fr/dp/B0ABCDEFGH/ref=sr_1_1": good,
        "42": None, "": None, None: None, "pas-une-url": None, "ftp://amazon.fr/dp/B0ABCDEFGH": None,
        "https://www.amazon.de/dp/B0ABCDEFGH": None, "https://www.amazon.fr/s?k=lessive": None,
        "https://www.amazon.fr.evil.org/dp/B0ABCDEFGH": None, "https://evil.org/?u=https://www.amazon.fr/dp/B0ABCDEFGH": None,
        "https://www.amazon.fr@evil.org/dp/B0ABCDEFGH": None, "https://www.amazon.fr/x#/dp/B0ABCDEFGH": None,
    }
    good = "https://www.amazon.fr/dp/B0ABCDEFGH/"
    cases |= {
        "https://www.amazon.fr/dp/B0ABCDEFGH/../../s": None, "https://www.amazon.fr/x/../dp/./B0ABCDEFGH?a=/../": good,
        "https://www.amazon.fr/../dp/B0ABCDEFGH": good, "https://www.amazon.fr/dp/B0ABCDEFGH/%2e%2E/b": None,
        "https://www.amazon.fr/a/dp/B0ABCDEFGH/..a/": good, "https://www.amazon.fr/dp/B0ABCDEFGH/x/..": good,
    }
    assert apply(spark, ids.canonical_product_url, cases) == list(cases.values())


def test_prices(spark):
    cases = {
        "12,99 €": (12.99, "EUR"), "€12.99": (12.99, "EUR"), "1 299,00 €": (1299.0, "EUR"), "1 299,50 €": (1299.5, "EUR"),
        "12 €": None, "1,299.00": (1.299, "EUR"), "": None, None: None, "$5.00": (5.0, "USD"), "£ 5.00": (5.0, "GBP"),
        "from £5.10 to £9.90": (5.1, "GBP"), "£ \u202f5.00": (5.0, "GBP"), "EUR 5,00": (5.0, "EUR"),
    }
    found = apply(spark, text.parse_price, cases)
    assert [None if price is None else tuple(price) for price in found] == list(cases.values())


def test_unit_prices(spark):
    cases = {
        "(3,18 €/l)": (3.18, "l"), "3,18 € / 100 ml)": (3.18, "100"), "3,18 €": (3.18, ""), "3.18€ par kg ": (3.18, "kg"), "/l": None, None: None,
    }
    found = apply(spark, text.parse_unit_price, cases)
    assert [None if price is None else tuple(price) for price in found] == list(cases.values())


def test_images(spark):
    cases = {
        "https://m.media/images/I/71abc._AC_US40_.jpg": "https://m.media/images/I/71abc.jpg",
        "https://m.media/images/I/71a+b-c._SX_.x.PNG": "https://m.media/images/I/71a+b-c.PNG",
        "https://m.media/images/I/71abc.jpg": "https://m.media/images/I/71abc.jpg", "http://other/x._1_.jpg": "http://other/x._1_.jpg",
    }
    assert apply(spark, text.high_res_image, cases) == list(cases.values())


def test_keyword_names(spark):
    full = "a" * 100
    cases = {
        "  lessive liquide  ": "lessive liquide", full: full, f" {full} ": full, f" {full}a ": None, "": None, "   ": None, "\t\n": None,
        None: None, " savon﻿": "savon", "😀" * 50: "😀" * 50, "😀" * 51: None,
    }
    assert apply(spark, text.keyword_name, cases) == list(cases.values())


def test_search_url(spark):
    assert apply(spark, text.search_url, ["eau de toilette & co/été (1)"]) == [
        fixed.SEARCH_URL + "eau%20de%20toilette%20%26%20co%2F%C3%A9t%C3%A9%20(1)"
    ]


def test_dead_redirects(spark):
    product, away = "https://www.amazon.fr/dp/b0abcdefgh/", "https://www.amazon.fr/"
    rows = [(product, away, True), (product, product + "?x", False), (away, away, False), (product, away + "ap/signin?x", False)]
    frame = spark.createDataFrame(rows, "a string, b string, dead boolean")
    assert frame.filter(ids.is_dead_redirect(F.col("a"), F.col("b")) != F.col("dead")).count() == 0


def test_rounding_like_python(spark):
    random.seed(3)
    values = [2.675, 0.25, 0.35, 12.25, 12.35, 9.95, 9.949999, -0.04, -7.25] + [random.randint(-9999, 9999) / 40 for _ in range(800)]
    assert apply(spark, lambda x: money.round_exact(x, 1), values, "double") == [round(value, 1) for value in values]
    assert apply(spark, lambda x: money.round_exact(x, 2), values, "double") == [round(value, 2) for value in values]


def test_scores_and_discounts(spark):
    assert apply(spark, money.is_deal, [10.0, 9.99, None, -15.0], "double") == [True, False, False, False]
    assert apply(spark, money.round_half_up, [2.5, -2.5, 0.49999999999999994, None], "double") == [3, -2, 0, None]
    rows = spark.createDataFrame([(8.0, 10.0), (10.0, 8.0), (0.0, 8.0), (8.0, None), (5.0, 0.0)], "p double, c double")
    ratio = money.discount_ratio(F.col("p"), F.col("c"))
    assert [row[0] for row in rows.select(F.round(ratio, 6)).collect()] == [0.2, -0.25, 0.0, 0.0, 0.0]
    percent = money.discount_percent(F.col("p"), F.col("c"))
    assert [row[0] for row in rows.select(percent).collect()] == [20, -25, 100, None, None]
    assert apply(spark, lambda x: money.deal_score(x, F.lit(1.0)), [0.0, None], "double") == [None, None]


def test_incomplete_values(spark):
    rows = spark.createDataFrame([((1.0, "EUR"),), ((1.0, None),), ((None, "EUR"),), (None,)], "m struct<amount:double,currency:string>")
    assert [row[0] is not None for row in rows.select(money.complete_money(F.col("m"))).collect()] == [True, False, False, False]
    assert apply(spark, money.finite, [1.5, float("nan"), float("inf"), None], "double") == [1.5, None, None, None]
    assert apply(spark, money.known_trend, ["up", "stable", "sideways", None]) == ["up", "stable", None, None]


def test_ages(spark):
    now = dt.datetime(2024, 1, 10, 12, 0, 0)
    times = [now - dt.timedelta(seconds=s) for s in (0, 59, 60, 3599, 3600, 86399, 86400, 3 * 86400 + 5)] + [now + dt.timedelta(hours=2), None]
    found = apply(spark, lambda x: dates.age(x, F.lit(now)), times, "timestamp")
    expected = [(0, "now"), (0, "now"), (1, "minute"), (59, "minute"), (1, "hour"), (23, "hour"), (1, "day"), (3, "day"), (0, "now")]
    assert [tuple(age) for age in found[:-1]] == expected and found[-1] is None


def test_arrays(spark):
    images = [["a", None, "b"], [], None]
    assert apply(spark, arrays.known_elements, images, "array<string>") == [["a", "b"], [], []]
    assert apply(spark, arrays.first_or_null, images, "array<string>") == ["a", None, None]
    assert apply(spark, arrays.non_empty, images, "array<string>") == [["a", None, "b"], None, None]
    assert apply(spark, lambda x: arrays.last_n(x, 2), [["1", "2", "3"]], "array<string>") == [["3", "2"]]
    assert apply(spark, lambda x: arrays.without(x, F.lit("b")), [["a", "b", "a", "c"]], "array<string>") == [["a", "c"]]
