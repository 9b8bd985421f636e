"""Histories, deletions and the search index kept up with what changed, against the same from all rows."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from pricetide import schema
from pricetide.operators.history import price_history
from pricetide.operators.price_stats import price_stats, scores_of_stats
from pricetide.operators.scoring import deal_scores_of_histories
from pricetide.operators import summaries
from pricetide.plans import incremental, nightly, search, search_index, sketches
from pricetide.sources.buckets import Buckets
from pricetide.sources.tables import Tables
from test_history import visit

START = dt.datetime(2024, 6, 1, 9)
NOW = dt.datetime(2024, 7, 1)


@pytest.fixture
def tables(spark):
    return Tables(spark, tempfile.mkdtemp(prefix="run-"))


def save(tables, rows, batch):
    tables.save_snapshots(tables.spark.createDataFrame(rows, schema.SNAPSHOT_LOG), batch)


def seen(url, day, seq=0, price=10.0, keyword="k", title="a title"):
    return visit(url, START + dt.timedelta(days=day, minutes=seq), seq, title=title, price=None if price is None else (price, "EUR"), keyword=keyword)


def draw(rng, n, days, seq):
    """Visits of few urls, so that they meet on the same days, by keywords that change."""
    return [
        seen(f"u{rng.randrange(12)}", rng.randrange(*days), seq + i, rng.choice([None, 5.0, 7.5, 9.0]), rng.choice([None, "k1", "k2", "k3"]),
             rng.choice([None, "", "Soap bar", "SOAP dish", "ÉTÉ soap", "towel"]))
        for i in range(n)
    ]


def files(tables, name):
    """Files of each bucket, with their times."""
    root = os.path.join(tables.folder, name)
    return {
        bucket: sorted((f, os.stat(os.path.join(root, bucket, f)).st_mtime_ns) for f in os.listdir(os.path.join(root, bucket)))
        for bucket in os.listdir(root) if bucket.startswith("bucket=")
    }


def shown(rows):
    return sorted(map(str, rows.collect()))


def full(tables):
    """Histories of all rows; times of refining aside."""
    return price_history(tables.items(), F.lit(NOW))


def test_refined_histories_equal_those_of_all_rows(tables):
    rng = random.Random(2)
    for night in range(4):
        save(tables, draw(rng, 40, (0, 6) if night == 2 else (3 * night, 3 * night + 5), 100 * night), f"b{night}")
        if night == 1:
            continue  # a night without a run: the next one takes in two batches
        assert incremental.refine_new(tables, F.lit(NOW), buckets=4) > 0
        assert shown(incremental.histories(tables)) == shown(full(tables).select(*schema.PRICE_HISTORY.names))
    assert incremental.refine_new(tables, F.lit(NOW)) == 0


def test_second_night_reads_and_writes_touched_buckets(tables):
    save(tables, [seen(f"u{i}", 0) for i in range(40)], "first")
    assert incremental.refine_new(tables, F.lit(NOW), buckets=16) == 40
    before = files(tables, "history_buckets")
    later = F.lit(dt.datetime(2024, 8, 1))
    save(tables, [seen("u3", 5, price=8.0), seen("u3", 0, seq=9, price=4.0), seen("new", 1)], "second")
    kept = incremental.history_buckets(tables)
    touched = kept.of(tables.spark.createDataFrame([("u3",), ("new",)], "url string"))
    assert incremental.refine_new(tables, later) == 2
    after = files(tables, "history_buckets")
    assert {name for name in after if after[name] != before.get(name)} == {f"bucket={n}" for n in touched}
    rows = {r.url: r for r in incremental.histories(tables).collect()}
    assert len(rows) == 41 and [(e.day.day, e.price.amount) for e in rows["u3"].history] == [(1, 4.0), (6, 8.0)]
    assert {u for u, r in rows.items() if r.updatedAt == dt.datetime(2024, 8, 1)} == {"u3", "new"}
    plan = kept.read(touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    sources = kept.read(touched).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("/")[-2] for r in sources} == {f"bucket={n}" for n in touched}


def test_stale_products_stay_and_scores_follow(tables):
    save(tables, [seen("old", 0)] + [seen("new", d, price=10.0 + d) for d in range(20, 29)], "1")
    as_of = F.lit(START + dt.timedelta(days=29))
    assert incremental.refine_and_score_new(tables, as_of) == nightly.refine_and_score(tables, as_of)
    assert shown(incremental.scores(tables)) == shown(tables.read("deal_scores"))
    save(tables, [seen("new", 29, price=1.0)], "2")
    as_of = F.lit(START + dt.timedelta(days=30))
    assert incremental.refine_and_score_new(tables, as_of) == (1, 1)
    assert {r.url for r in incremental.histories(tables).collect()} == {"old", "new"}
    mine = shown(incremental.scores(tables))
    nightly.refine_and_score(tables, as_of)
    assert mine == shown(tables.read("deal_scores"))


def test_run_that_broke_off_is_repeated(tables, monkeypatch):
    save(tables, [seen(f"u{i}", 0) for i in range(8)], "1")
    incremental.refine_new(tables, F.lit(NOW), buckets=4)
    save(tables, [seen("u1", 1), seen("u9", 1)], "2")

    def lost(self, *_):
        raise OSError("executor lost")

    copy = Buckets._copy
    monkeypatch.setattr(Buckets, "_copy", lost)
    with pytest.raises(OSError):
        incremental.refine_new(tables, F.lit(NOW))
    monkeypatch.setattr(Buckets, "_copy", copy)
    save(tables, [seen("u2", 2)], "3")
    assert incremental.refine_new(tables, F.lit(NOW)) == 1  # the copy is ended first, so only the last batch is left
    assert shown(incremental.histories(tables)) == shown(full(tables))


def test_deletions_are_logged_and_undone_by_visits(tables):
    save(tables, [seen(f"u{i}", d) for i in range(30) for d in (0, 1)], "1")
    incremental.refine_new(tables, F.lit(NOW), buckets=8)
    before = files(tables, "history_buckets")
    dead = tables.spark.createDataFrame([(f"u{i}",) for i in range(10)] + [("u1",), (None,), ("unknown",)], "url string")
    incremental.delete_products(tables, dead)
    assert files(tables, "history_buckets") == before and incremental.deleted(tables).count() == 11
    assert {r.url for r in incremental.histories(tables).collect()} == {f"u{i}" for i in range(10, 30)}
    save(tables, [seen("u3", 2)], "2")
    assert incremental.refine_new(tables, F.lit(NOW)) == 10  # deleted ones come back with all their days, changed or not
    assert shown(incremental.histories(tables)) == shown(full(tables)) and incremental.deleted(tables).count() == 0
    assert incremental.refine_new(tables, F.lit(NOW)) == 0


def test_deletions_are_compacted_by_number(tables):
    save(tables, [seen(f"u{i}", 0) for i in range(30)], "1")
    incremental.refine_new(tables, F.lit(NOW), buckets=4)
    urls = lambda *names: tables.spark.createDataFrame([(n,) for n in names], "url string")
    incremental.delete_products(tables, urls("u1", "u2"), most=4)
    assert incremental.history_buckets(tables).read().count() == 30
    incremental.delete_products(tables, urls("u3", "u4"), most=4)
    assert incremental.history_buckets(tables).read().count() == 26 == incremental.histories(tables).count()
    assert incremental.deleted(tables, "deleted").count() == 0 and incremental.deleted(tables, "removed").count() == 4
    assert incremental.refine_new(tables, F.lit(NOW)) == 4 and incremental.histories(tables).count() == 30


def test_statistics_equal_scores_of_all_days(tables):
    """Random days with and without prices, replaced, added before and after, newest prices taken back."""
    rng = random.Random(3)
    as_of = F.lit(START + dt.timedelta(days=46))
    for night in range(5):
        days = (0, 45) if night < 3 else (40, 47)
        rows = [seen(f"u{rng.randrange(10)}", rng.randrange(*days), 1000 * night + i, rng.choice([None, 9.99, 12.34, 0.1 + rng.random() * 50])) for i in range(120)]
        save(tables, rows, f"b{night}")
        if night == 1:
            continue
        assert incremental.update_stats(tables, buckets=4) > 0
        stats = incremental.stats_buckets(tables).read()
        want = {r.url: r for r in deal_scores_of_histories(full(tables), as_of).collect()}
        mine = {r.url: r for r in scores_of_stats(stats, as_of).collect()}
        assert mine == want and (night < 3 or len(mine) > 3)
        again = {r.url: r for r in price_stats(tables.items()).collect()}
        for r in stats.collect():
            w = again[r.url]
            assert (r.entries, r.n, r.sumX, r.sumXX, r.sumY, r.sumXY, r.newest, r.recent) == (w.entries, w.n, w.sumX, w.sumXX, w.sumY, w.sumXY, w.newest, w.recent)
            assert r.restY == pytest.approx(w.restY, abs=1e-12)
    assert incremental.update_stats(tables) == 0


def test_statistics_take_a_batch_in_once(tables, monkeypatch):
    save(tables, [seen("u", d, price=float(d)) for d in range(1, 9)], "1")
    incremental.update_stats(tables, buckets=2)
    save(tables, [seen("u", 9, price=3.0)], "2")
    take = Tables.take

    def lost(self, *_):
        raise OSError("driver lost")

    monkeypatch.setattr(Tables, "take", lost)
    with pytest.raises(OSError):
        incremental.update_stats(tables)  # copied, but not noted
    monkeypatch.setattr(Tables, "take", take)
    assert incremental.update_stats(tables) == 0  # the copy is made once more, and noted
    assert incremental.stats_buckets(tables).read().first().n == 9


def test_sketches_follow_changed_days(tables):
    """Few products are counted exactly, also after days lost a product to another keyword."""
    rng = random.Random(9)
    for night in range(3):
        save(tables, draw(rng, 50, (0, 5), 100 * night), f"b{night}")
        sketches.update_sketches(tables, buckets=4)
        for first, last in ((None, None), (dt.date(2024, 6, 2), dt.date(2024, 6, 3)), (dt.date(2025, 1, 1), None)):
            items = tables.items()
            if first:
                items = items.filter((F.col("day") >= F.lit(first)) & (F.col("day") <= F.lit(last or dt.date(2030, 1, 1))))
            about = summaries.approximate_keyword_stats(sketches.sketched_days(tables, first, last))
            assert shown(about) == shown(summaries.keyword_stats(items))
    before = files(tables, "keyword_sketches")
    sketches.update_sketches(tables)
    assert files(tables, "keyword_sketches") == before


def test_sketches_of_many_products(spark):
    rows = spark.range(60_000).select(
        F.concat(F.lit("u"), F.col("id") % 40_000).alias("url"), F.lit("t").alias("title"), F.struct(F.lit(1.0).alias("amount"), F.lit("EUR").alias("currency")).alias("price"),
        F.lit("k").alias("keyword"), F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 20).cast("int")).alias("day"), F.current_timestamp().alias("scrapedAt"))
    about = summaries.approximate_keyword_stats(summaries.daily_sketches(rows)).first().productCount
    assert abs(about - 40_000) <= 0.05 * 40_000


def test_emptied_buckets(tables):
    save(tables, [seen("only", 0)], "1")
    incremental.refine_new(tables, F.lit(NOW), buckets=2)
    incremental.delete_products(tables, tables.spark.createDataFrame([("only",)], "url string"), most=1)
    assert incremental.histories(tables).count() == 0 and incremental.history_buckets(tables).read().count() == 0


def test_nothing_saved(tables):
    assert incremental.refine_new(tables, F.lit(NOW)) == 0 and incremental.histories(tables).count() == 0
    search_index.update_index(tables)
    assert search_index.indexed_products(tables, "k", "abc").count() == 0


def test_migrated_days_reach_their_readers(spark, tables):
    row = seen("u", 0)
    save(tables, [row], "1")
    incremental.refine_new(tables, F.lit(NOW), buckets=2)
    legacy = tables.items().withColumn("price", F.struct(F.lit(3.0).alias("amount"), F.lit("€").alias("currency")))
    tables._replace_days(legacy.withColumn("fresh", F.lit(True)), "legacy", tables.items())
    assert tables.migrate_legacy() == 1 and incremental.refine_new(tables, F.lit(NOW)) == 1
    assert incremental.histories(tables).first().history[0].price == (3.0, "EUR")


def test_index_equals_search_over_all_days(tables):
    """Keywords of a product change within a day, so rows also leave the index, and older ones come back."""
    rng = random.Random(7)
    scores = tables.spark.createDataFrame([], schema.DEAL_SCORES)
    for night in range(4):
        save(tables, draw(rng, 40, (0, 8), 100 * night), f"b{night}")
        if night != 1:
            search_index.update_index(tables, buckets=4)
    for keyword in ("k1", "k2", "k3", "none"):
        for params in ({}, {"q": "soap"}, {"q": "é"}, {"q": "ÉTÉ s"}, {"q": "so"}, {"q": "p d", "sort": "price_asc"}, {"q": "x" * 100}, {"min": "6", "page": "2"}):
            query = search.ProductQuery.from_params(**params)
            mine = search_index.search_indexed(tables, scores, keyword, query)
            want = search.search_products(tables.items(), scores, keyword, query)
            assert mine.items.collect() == want.items.collect(), (keyword, params)
            assert mine.totals.collect() == want.totals.collect()


def test_one_keyword_is_one_bucket(tables):
    save(tables, [seen(f"u{i}", 0, keyword=f"k{i % 20}", title=f"soap {i}") for i in range(60)], "1")
    search_index.update_index(tables, buckets=16)
    products = search_index.keyword_products(tables)
    rows = products.read_key("k3")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(keyword), EqualTo(keyword,k3)]" in plan
    assert {r.url for r in rows.collect()} == {"u3", "u23", "u43"}
    before = files(tables, "keyword_products"), files(tables, "keyword_grams")
    save(tables, [seen("u3", 0, seq=5, keyword="k4", title="soap")], "2")
    touched = {f"bucket={n}" for n in products.of(tables.spark.createDataFrame([("k3",), ("k4",)], "keyword string"))}
    search_index.update_index(tables)
    for old, name in zip(before, ("keyword_products", "keyword_grams")):
        new = files(tables, name)
        assert {b for b in new if new[b] != old.get(b)} == touched
    assert {r.url for r in products.read_key("k3").collect()} == {"u23", "u43"}
    assert {r.url for r in search_index.indexed_products(tables, "k4", "soap 2").collect()} == {"u24"}


@pytest.mark.parametrize("text, want", [("", None), ("ab", None), ("abc", ["abc"]), ("aaaa", ["aaa"]), ("AbÉd", ["abé", "béd"]), (None, None)])
def test_runs_of_three_characters(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(search_index.grams(F.col("t"))).first()[0] == want
