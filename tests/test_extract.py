"""Pages written out by hand."""

import datetime as dt

from pricetide import schema
from pricetide.operators import extract

AT = dt.datetime(2024, 6, 1)
URL = "https://www.amazon.fr/dp/B000000001/"


def pages(spark, *htmls, final=URL):
    return spark.createDataFrame([(URL, final, html, "k", AT) for html in htmls], schema.PAGES)


def observe(spark, body):
    return extract.observations(extract.product_pages(pages(spark, f'<html><body><p>x<br>{body}<span id="productTitle">  A title </span></body></html>'))).first()


def test_title_is_needed(spark):
    assert extract.product_pages(pages(spark, "", None, "<p>no title", '<b id="productTitle"> </b>')).count() == 0


def test_dead_page_gives_nothing(spark):
    html = '<b id="productTitle">x</b>'
    assert extract.product_pages(pages(spark, html, final="https://www.amazon.fr/")).count() == 0
    assert extract.product_pages(pages(spark, html, final=None)).count() == 1


def test_fallback_price_only_where_the_first_is_absent(spark):
    fallback = '<span class="a-price"><span class="a-offscreen">3,50 €</span></span>'
    assert observe(spark, fallback).price.amount == 3.5
    first = '<div class="x apex-pricetopay-value"><i><span class="b a-offscreen">2,50&nbsp;€</span></i></div>'
    assert observe(spark, fallback + first).price.amount == 2.5
    empty = '<div class="apex-pricetopay-value"><span class="a-offscreen"> </span></div>'
    assert observe(spark, fallback + empty).price is None
    assert observe(spark, '<span class="a-offscreen">9,50 €</span>').price is None
    row = observe(spark, "")
    assert (row.title, row.price, row.unitPrice, row.deliveryDate, row.images, row.shop, row.keyword) == ("A title", None, None, None, [], "amazon", "k")


def test_unit_price_looks_up_five_levels(spark):
    def nested(levels):
        return "<div>" * levels + '<span class="apex-priceperunit-value">3,18 €</span>' + "</div>" * levels + " / \n l )"

    assert observe(spark, f"<section>{nested(4)}</section>").unitPrice == (3.18, "l")
    assert observe(spark, f"<section>{nested(5)}</section>").unitPrice is None
    assert observe(spark, '<div><span class="apex-priceperunit-value">3,18 €</span> par kg </div>').unitPrice == (3.18, "")


def test_delivery_and_images(spark):
    row = observe(
        spark,
        '<div id="delivery-message"> Livraison\n <b> demain</b> </div><div id="altImages"><img src="https://m/images/I/1._S_.jpg"/>'
        '<ul><li><img src="https://m/images/I/1.jpg"><img><li><img src="https://m/images/I/2._S_.png"></ul></div><img src="https://m/images/I/3.jpg">',
    )
    assert row.deliveryDate == "Livraison demain" and row.images == ["https://m/images/I/1.jpg", "https://m/images/I/2.png"]


def test_variants(spark):
    html = (
        '<b id="productTitle">x</b><i data-asin="OUTSIDE001"></i><div id="twister_x"></div><div id="twisterContainer"><a data-asin="B000000001"></a>'
        '<a data-asin=""></a><a data-asin="B000000002"></a><a data-dp-url="/x/dp/B000000003/ref"></a><a data-dp-url="/dp/B000000002"></a><a data-dp-url="/dp/b1"></a></div>'
    )
    rows = extract.variant_links(extract.product_pages(pages(spark, html))).collect()
    assert sorted(row.url[-11:-1] for row in rows) == ["B000000002", "B000000003"] and {row.keyword for row in rows} == {"k"}


def test_search_page(spark):
    result = '<div data-component-type="s-search-result"><a class="a-link-normal" href="{}">x</a></div>'
    links = ["/n/dp/B000000001/ref=1", "https://www.amazon.fr/dp/B000000001", "/dp/lowercase00", "/gp/x"]
    html = "".join(result.format(link) for link in links) + '<a class="s-pagination-next" href="/s?k=a&amp;page=2">'
    frame = spark.createDataFrame([(html, "k", page) for page in (4, 5)], "html string, keyword string, page int")
    rows = extract.search_links(frame).collect()
    assert sorted({row.url for row in rows if row.label == "PRODUCT"}) == ["https://www.amazon.fr/dp/B000000001/", "https://www.amazon.fr/dp/lowercase00"]
    assert [(row.url, row.page) for row in rows if row.label == "SEARCH"] == [("https://www.amazon.fr/s?k=a&page=2", 5)]


def test_time_follows_the_size_of_a_page():
    import time

    html = '<b id="productTitle">x</b><div id="twister">' + '<p class="a-offscreen" data-asin="B000000001">' * 40_000 + "</div>" + "</i>" * 1000
    start = time.perf_counter()
    fields = extract._product_fields(html)
    assert len(fields[-1]) == 40_000 and time.perf_counter() - start < 4


def test_search_pages_are_read_once(spark):
    frame = spark.createDataFrame([("<a>", "k", 1)], "html string, keyword string, page int")
    plan = extract.search_links(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_few_pages_are_held_at_a_time():
    """A batch of any number of pages leaves as small ones, none of which waits for the others."""
    import pyarrow as pa
    from types import SimpleNamespace

    from pyspark.sql import types as T

    taken = []
    pages = SimpleNamespace(
        columns=["url", "html"], schema=T.StructType([T.StructField("url", T.StringType()), T.StructField("html", T.StringType())]),
        mapInPandas=lambda f, _: f, mapInArrow=lambda f, _: f)
    read = extract._read_in_slices(pages, lambda html: taken.append(html) or (html.upper(), [html]), "title string, variants array<string>")
    batch = pa.RecordBatch.from_pydict({"url": [str(i) for i in range(500)], "html": [f"p{i}" for i in range(500)]})
    out = []
    for part in read(iter([batch])):
        out += part.to_pylist()
        assert len(taken) == len(out)
        assert part.num_rows <= extract.PAGES_AT_ONCE
    assert out == [{"url": str(i), "title": f"P{i}", "variants": [f"p{i}"]} for i in range(500)]
