"""Positions and stretches of sorted tables against plain sorts."""

import random

import pytest
from pyspark.sql import functions as F

from pricetide import fixed, schema
from pricetide.operators import catalog
from pricetide.operators.ranges import Ranges
from pricetide.plans import search
from test_history import visit
from test_tables import DAY

ROWS = "name string, n long"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    return spark.createDataFrame([(rng.choice([None, "a", "b", "é", "z"]), i) for i in range(500)], ROWS).repartition(5)


def test_positions(rows):
    order = [F.desc("name"), F.col("n")]
    found = {r.n: r.position for r in Ranges(rows, order).numbered("position").collect()}
    want = [r.n for r in rows.orderBy(*order).collect()]
    assert found == {n: i + 1 for i, n in enumerate(want)}


@pytest.mark.parametrize("skip, size", [(0, 1), (0, 500), (499, 24), (123, 45), (500, 5), (77, 0), (480, 100)])
def test_stretches(rows, skip, size):
    order = [F.col("name"), F.col("n")]
    got = [r.n for r in Ranges(rows, order).stretch(skip, size).orderBy(*order).collect()]
    assert got == [r.n for r in rows.orderBy(*order).collect()][skip : skip + size]


def test_french_order(spark):
    words = ["cote", "Côte", "coté", "côté", "kw_1", "kw1", "KW1", "été", "zoo", "Été"]
    rows = spark.createDataFrame([(w, i) for i, w in enumerate(words)], ROWS)
    order = [F.collate("name", "fr"), F.col("n")]
    placed = Ranges(rows, order).numbered("position").orderBy("position").collect()
    assert [r.name for r in placed] == [r.name for r in rows.orderBy(*order).collect()]
    assert [r.name for r in placed][-1] == "zoo" and [r.position for r in placed] == list(range(1, len(words) + 1))


def test_no_rows(spark):
    empty = Ranges(spark.createDataFrame([], ROWS), [F.col("n")])
    assert empty.total == 0 and empty.numbered("p").columns == ["name", "n", "p"] and empty.numbered("p").count() == 0
    assert empty.stretch(0, 24).count() == 0


@pytest.mark.parametrize("sort", sorted(fixed.SORTS))
def test_pages_by_ranges_are_those_of_a_sort(spark, sort):
    rng = random.Random(5)
    log = [visit(f"u{i:03}", DAY, 0, title="t", price=(rng.choice([1.0, 2.0, 3.0]), "EUR"), keyword="k") for i in range(130)]
    items = spark.createDataFrame(log, schema.SNAPSHOT_LOG).withColumn("day", F.to_date("scrapedAt"))
    scores = spark.createDataFrame([(f"u{i:03}", float(rng.randrange(-20, 40))) for i in range(0, 130, 2)], "url string, score double")
    scores = scores.withColumns({"predictedPrice": F.lit(1.0), "trendDirection": F.lit("up")})
    products = search.scored_products(items, scores, "k").cache()
    for page in (1, 3, 6, 7):
        want = [r.url for r in catalog.page_rows(products, sort, page).collect()]
        assert [r.url for r in catalog.page_by_ranges(products, sort, page).collect()] == want
    products.unpersist()
