"""Fetched pages to observations and links.

Selectors need the page's tree, so this is the one place with Python rows: `mapInPandas` or `mapInArrow` over the pages, each
page on its own. It returns texts and attributes as they stand on the page; prices, units, links and image urls are then
parsed by column expressions.
"""

import re
from collections import Counter
from html.parser import HTMLParser
from typing import Iterator

import pandas as pd
import pyarrow as pa
import pricetide
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide import fixed
from pricetide.functions import arrays, ids, text
from pricetide.operators.frontier import next_page_wanted

# The few functions below travel with the job, so that executors need not have the package installed.
cloudpickle.register_pickle_by_value(pricetide)

VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Page(HTMLParser):
    """Elements in document order. Each knows its parent, where its text begins and ends, and the last element below it.

    Tags that a page leaves open make deep trees, so nothing here walks up from every element: what lies inside an
    element is a range of the document order, and open tags are counted.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.attrs, self.parents, self.spans, self.ends = [], [], [], [], []
        self.texts, self.open, self.opened = [], [], Counter()
        self.feed(html or "")
        self.close()
        while self.open:
            self._end()

    def _end(self) -> int:
        element = self.open.pop()
        self.opened[self.tags[element]] -= 1
        self.spans[element][1] = len(self.texts)
        self.ends[element] = len(self.tags)
        return element

    def handle_starttag(self, tag, attrs):
        self.tags.append(tag)
        self.attrs.append({name: value or "" for name, value in attrs})
        self.parents.append(self.open[-1] if self.open else None)
        self.spans.append([len(self.texts), len(self.texts)])
        self.ends.append(len(self.tags))
        if tag not in VOID_TAGS:
            self.open.append(len(self.tags) - 1)
            self.opened[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        while self.opened[tag]:
            if self.tags[self._end()] == tag:
                break

    def handle_data(self, data):
        self.texts.append(data)

    def text(self, element: int) -> str:
        begin, end = self.spans[element]
        return "".join(self.texts[begin:end])

    def ancestors(self, element: int) -> Iterator[int]:
        while (element := self.parents[element]) is not None:
            yield element

    def has_class(self, element: int, name: str) -> bool:
        return name in self.attrs[element].get("class", "").split()

    def find(self, test, inside=None) -> Iterator[int]:
        """Elements that pass `test`, in document order, where asked below one that passes `inside`."""
        reach = 0  # end of what lies below the elements seen so far that pass `inside`
        for element in range(len(self.tags)):
            if (inside is None or element < reach) and test(element):
                yield element
            if inside is not None and inside(element):
                reach = max(reach, self.ends[element])

    def below(self, element: int) -> range:
        return range(element + 1, self.ends[element])

    def with_id(self, *names: str):
        return lambda element: self.attrs[element].get("id") in names

    def with_class(self, name: str):
        return lambda element: self.has_class(element, name)

    def stripped_text(self, elements: Iterator[int]) -> str | None:
        first = next(elements, None)
        return None if first is None else self.text(first).strip()


def _unit_price_text(page: Page) -> str | None:
    found = next(page.find(page.with_class(fixed.UNIT_PRICE_CLASS)), None)
    if found is None:
        return None
    for _, element in zip(range(fixed.UNIT_PRICE_DEPTH), page.ancestors(found)):
        content = " ".join(page.text(element).split())
        if re.search(fixed.UNIT_PRICE_HINT, content, re.IGNORECASE | re.ASCII):
            return content[: fixed.UNIT_PRICE_TEXT_LENGTH]
    return None


def _variant_codes(page: Page) -> list[str]:
    box = next(page.find(page.with_id(*fixed.VARIANT_IDS)), None)
    if box is None:
        return []
    inside = page.below(box)
    named = [page.attrs[element].get("data-asin") for element in inside]
    linked = [re.search(fixed.PRODUCT_LINK, page.attrs[element].get("data-dp-url", "")) for element in inside]
    return [code for code in named if code] + [match[1] for match in linked if match]


def _product_fields(html: str) -> tuple:
    page = Page(html)
    offscreen = page.with_class(fixed.OFFSCREEN_CLASS)
    price = page.stripped_text(page.find(offscreen, page.with_class(fixed.PRICE_CLASS)))
    if price is None:
        price = page.stripped_text(page.find(offscreen, page.with_class(fixed.PRICE_FALLBACK_CLASS)))
    delivery = page.stripped_text(page.find(page.with_id(*fixed.DELIVERY_IDS)))
    thumbnails = page.find(lambda element: page.tags[element] == "img", page.with_id(fixed.THUMBNAILS_ID))
    return (
        page.stripped_text(page.find(page.with_id(fixed.TITLE_ID))) or "",
        price,
        page.stripped_text(page.find(offscreen, page.with_class(fixed.CROSSED_OUT_CLASS))),
        _unit_price_text(page),
        None if delivery is None else " ".join(delivery.split()),
        [src for element in thumbnails if (src := page.attrs[element].get("src"))],
        _variant_codes(page),
    )


def _search_fields(html: str) -> tuple:
    page = Page(html)
    name, value = fixed.RESULT_ATTRIBUTE
    links = page.find(
        lambda element: page.tags[element] == "a"
        and page.has_class(element, fixed.RESULT_LINK_CLASS)
        and "/dp/" in page.attrs[element].get("href", ""),
        lambda element: page.tags[element] == "div" and page.attrs[element].get(name) == value,
    )
    following = next(
        page.find(lambda element: page.tags[element] == "a" and page.has_class(element, fixed.NEXT_PAGE_CLASS)), None
    )
    return (
        [page.attrs[element]["href"] for element in links],
        None if following is None else page.attrs[following].get("href"),
    )


PRODUCT_COLUMNS = (
    "title string, price_text string, crossed_out_text string, unit_price_text string, deliveryDate string, "
    "thumbnails array<string>, variants array<string>"
)
SEARCH_COLUMNS = "links array<string>, next_href string"


def _read(pages: DataFrame, fields, columns: str) -> DataFrame:
    kept = [name for name in pages.columns if name != "html"]
    names = [part.split()[0] for part in columns.split(", ")]
    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in pages.schema if field.name in kept)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([fields(html) for html in batch["html"]], columns=names, index=batch.index)
            yield pd.concat([batch[kept], found], axis=1)

    return pages.mapInPandas(read, f"{schema}, {columns}")


# Pages that are texts and fields in Python at a time; the rest of a batch waits as Arrow buffers.
PAGES_AT_ONCE = 64
ARROW_TYPES = {"string": pa.string(), "array<string>": pa.list_(pa.string())}


def _read_in_slices(pages: DataFrame, fields, columns: str) -> DataFrame:
    kept = [name for name in pages.columns if name != "html"]
    added = [part.split() for part in columns.split(", ")]
    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in pages.schema if field.name in kept)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(at, PAGES_AT_ONCE)
                found = [fields(html) for html in part.column("html").to_pylist()]
                read_columns = [pa.array([row[i] for row in found], ARROW_TYPES[kind]) for i, (_, kind) in enumerate(added)]
                yield pa.RecordBatch.from_arrays([*(part.column(name) for name in kept), *read_columns], [*kept, *(name for name, _ in added)])

    return pages.mapInArrow(read, f"{schema}, {columns}")


def _alive(pages: DataFrame) -> DataFrame:
    return pages.filter(~ids.is_dead_redirect(F.col("url"), F.coalesce("final_url", "url")))


def product_pages(pages: DataFrame) -> DataFrame:
    """The raw fields of product pages that still are one and show a title."""
    return _read_in_slices(_alive(pages), _product_fields, PRODUCT_COLUMNS).filter(F.length("title") > 0)


def observations(read_pages: DataFrame) -> DataFrame:
    """Rows for the snapshot log."""
    return read_pages.select(
        "url",
        "title",
        text.parse_price(F.col("price_text")).alias("price"),
        text.parse_price(F.col("crossed_out_text")).alias("crossedOutPrice"),
        text.parse_unit_price(F.col("unit_price_text")).alias("unitPrice"),
        "deliveryDate",
        text.high_res_images(F.col("thumbnails")).alias("images"),
        F.lit(fixed.DEFAULT_SHOP).alias("shop"),
        "keyword",
        F.col("fetched_at").alias("scrapedAt"),
    )


def variant_links(read_pages: DataFrame) -> DataFrame:
    """The other variants of each product, once each, under the page's keyword."""
    own = F.regexp_extract("url", fixed.PRODUCT_PATH, 1)
    code = F.explode(arrays.without(F.col("variants"), own))
    return read_pages.select("url", "keyword", code.alias("code")).select(
        F.col("url").alias("from_url"),
        F.concat(F.lit(fixed.PRODUCT_URL_PREFIX), "code", F.lit("/")).alias("url"),
        "keyword",
    )


def search_links(pages: DataFrame) -> DataFrame:
    """Product links and the next result page of search pages (`page` counts from 1). Each page is read once."""
    found = _read(pages, _search_fields, SEARCH_COLUMNS)
    absolute = lambda href: F.when(F.startswith(href, F.lit("http")), href).otherwise(
        F.concat(F.lit(fixed.SITE_ROOT), href)
    )

    def link(url, label, page):
        return F.struct(url.alias("url"), F.lit(label).alias("label"), page.cast("int").alias("page"))

    urls = F.array_distinct(F.transform("links", lambda x: ids.canonical_search_link(absolute(x))))
    products = F.transform(urls, lambda url: link(url, "PRODUCT", F.lit(None)))
    following = link(absolute(F.col("next_href")), "SEARCH", F.col("page") + 1)
    wanted = (F.length("next_href") > 0) & next_page_wanted(F.col("page"))
    links = F.when(wanted, F.concat(products, F.array(following))).otherwise(products)
    return found.select(F.explode(links).alias("link"), "keyword").select("link.url", "link.label", "keyword", "link.page")
