"""Stored tables, the nightly job and the stream."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from pricetide import schema
from pricetide.functions import dates
from pricetide.operators import frontier
from pricetide.plans import nightly
from pricetide.session import sized_shuffles
from pricetide.sources.tables import Tables, migrated_items
from pricetide.streaming.snapshots import save_stream
from test_history import visit

DAY = dt.datetime(2024, 6, 1, 9)


@pytest.fixture
def tables(spark):
    return Tables(spark, tempfile.mkdtemp(prefix="run-"))


def log_of(spark, rows):
    return spark.createDataFrame(rows, schema.SNAPSHOT_LOG)


def visits(spark, url, days, price=10.0, seq=0, **fields):
    return [visit(url, DAY + dt.timedelta(days=d), seq, title=url, price=(price, "EUR"), keyword="k", **fields) for d in days]


def stored(tables):
    return {(row.url, row.day.day): row.price.amount for row in tables.items().collect()}


def test_empty_tables(spark, tables):
    assert tables.items().count() == 0 and tables.read("price_history").count() == 0
    assert nightly.refine_and_score(tables, F.lit(DAY)) == (0, 0)
    assert tables.read("price_history").columns == schema.PRICE_HISTORY.names


def test_days_are_merged(spark, tables):
    tables.save_snapshots(log_of(spark, visits(spark, "a", range(3)) + visits(spark, "b", [0])), "1")
    tables.save_snapshots(log_of(spark, visits(spark, "a", [1], 7.0, seq=5) + visits(spark, "c", [1, 5])), "2")
    assert stored(tables) == {("a", 1): 10.0, ("a", 2): 7.0, ("a", 3): 10.0, ("b", 1): 10.0, ("c", 2): 10.0, ("c", 6): 10.0}
    # An older visit that comes in late does not replace a newer one.
    tables.save_snapshots(log_of(spark, visits(spark, "a", [1], 1.0, seq=2)), "3")
    assert stored(tables)[("a", 2)] == 7.0


def test_same_batch_again_changes_nothing(spark, tables):
    batch = log_of(spark, visits(spark, "a", range(2)))
    tables.save_snapshots(batch, "1")
    before = stored(tables)
    tables.save_snapshots(batch, "1")
    assert stored(tables) == before


def test_copy_that_broke_off_is_repeated_from_the_merge(spark, tables, monkeypatch):
    tables.save_snapshots(log_of(spark, visits(spark, "a", range(2))), "1")
    batch = log_of(spark, visits(spark, "b", [0]))

    def lost(self, *parts):
        raise OSError("executor lost")

    read = Tables._read
    monkeypatch.setattr(Tables, "_read", lambda self, s, *parts: lost(self) if parts[0] == "merged" else read(self, s, *parts))
    with pytest.raises(OSError):
        tables.save_snapshots(batch, "2")
    monkeypatch.setattr(Tables, "_read", read)
    # The day was lost half-way through the copy: the finished merge still has its rows.
    spark.createDataFrame([], schema.ITEMS_RAW).write.mode("append").partitionBy("day").parquet(f"{tables.folder}/items_raw")
    tables.save_snapshots(batch, "2")
    assert stored(tables) == {("a", 1): 10.0, ("a", 2): 10.0, ("b", 1): 10.0}


def test_unfinished_version_is_not_read(spark, tables):
    rows = spark.createDataFrame([("k", True)], schema.KEYWORDS)
    assert tables.replace("keywords", rows) == 1
    files, path = tables._path("keywords", "v=2", "part-0.parquet")
    files.create(path).close()
    assert [row.keyword for row in tables.read("keywords").collect()] == ["k"]
    assert tables.replace("keywords", rows.unionByName(rows)) == 2
    assert tables.read("keywords").count() == 2


def test_nightly_job(spark, tables):
    tables.save_snapshots(log_of(spark, visits(spark, "a", range(6)) + visits(spark, "b", range(2))), "1")
    assert nightly.refine_and_score(tables, F.lit(DAY + dt.timedelta(days=5))) == (2, 1)
    first = sorted(map(str, tables.read("price_history").drop("updatedAt").collect()))
    assert nightly.refine(tables, F.lit(DAY + dt.timedelta(days=6))) == 2
    assert sorted(map(str, tables.read("price_history").drop("updatedAt").collect())) == first
    # Ten days on nothing is fresh: the scores go, the histories stay.
    assert nightly.score(tables, F.lit(DAY + dt.timedelta(days=15))) == 0
    assert tables.read("deal_scores").count() == 0 and tables.read("price_history").count() == 2


def test_shuffles_grow_with_the_table(spark, tables):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert tables.size("items_raw") == 0
    tables.save_snapshots(log_of(spark, visits(spark, "a", range(2))), "1")
    assert tables.size("items_raw") > 0
    with sized_shuffles(spark, 100 * 2**40):
        assert spark.conf.get(name) == "819200"
    with sized_shuffles(spark, tables.size("items_raw")):
        assert spark.conf.get(name) == spark.conf.get("spark.sql.shuffle.partitions")
    assert spark.conf.get(name, None) is None


def test_changed_products_only(spark, tables):
    tables.save_snapshots(log_of(spark, visits(spark, "a", range(3)) + visits(spark, "b", range(3))), "1")
    nightly.refine(tables, F.lit(DAY))
    tables.save_snapshots(log_of(spark, visits(spark, "a", [4])), "2")
    changed = spark.createDataFrame([("a",)], "url string")
    assert nightly.refine_changed(tables, changed, F.lit(DAY + dt.timedelta(days=4))) == 1
    rows = {row.url: (len(row.history), row.updatedAt.day) for row in tables.read("price_history").collect()}
    assert rows == {"a": (4, 5), "b": (3, 1)}


def test_dead_products_come_back_with_their_items(spark, tables):
    tables.save_snapshots(log_of(spark, visits(spark, "https://x/dp/A000000001/", range(6)) + visits(spark, "https://x/dp/A000000002/", range(6))), "1")
    nightly.refine_and_score(tables, F.lit(DAY + dt.timedelta(days=5)))
    fetched = spark.createDataFrame([("https://x/dp/A000000001/", "https://x/")] * 2, "url string, final_url string")
    tables.delete_products(frontier.dead_products(fetched))
    assert [row.url[-2] for row in tables.read("price_history").collect()] == ["2"]
    assert [row.url[-2] for row in tables.read("deal_scores").collect()] == ["2"]
    assert tables.items().count() == 12
    assert nightly.refine(tables, F.lit(DAY)) == 2


def test_migration(spark):
    items = log_of(
        spark,
        [
            visit("a", DAY, 1, price=(1.0, "€"), crossedOutPrice=(2.0, "£"), images=["https://m/images/I/1._S_.jpg", "https://m/images/I/1.jpg"]),
            visit("b", DAY, 2, price=(1.0, "EUR"), images=["https://m/images/I/1.jpg"]), visit("c", DAY, 3, images=[]), visit("d", DAY, 4),
        ],
    )
    rows = {row.url: row for row in migrated_items(items).collect()}
    assert rows["a"].changed and rows["a"].price.currency == "EUR" and rows["a"].crossedOutPrice.currency == "GBP"
    assert rows["a"].images == ["https://m/images/I/1.jpg"]
    assert not (rows["b"].changed or rows["c"].changed or rows["d"].changed) and rows["c"].images == [] and rows["d"].images is None


def test_migration_of_the_table(spark, tables):
    rows = [visit("a", DAY, 1, price=(1.0, "€")), visit("b", DAY, 2, price=(1.0, "EUR")), visit("c", DAY + dt.timedelta(days=1), 3, price=(1.0, "$"))]
    tables.save_snapshots(log_of(spark, rows), "1")
    assert tables.migrate_legacy() == 2
    assert sorted((row.url, row.price.currency) for row in tables.items().collect()) == [("a", "EUR"), ("b", "EUR"), ("c", "USD")]
    assert tables.migrate_legacy() == 0 and tables.items().count() == 3
    tables.save_snapshots(log_of(spark, [visit("d", DAY, 4, price=(1.0, "£"))]), "2")
    assert tables.migrate_legacy("again") == 1 and tables.migrate_legacy("again") == 0


def test_migration_that_broke_off_in_its_copy(spark, tables, monkeypatch):
    tables.save_snapshots(log_of(spark, [visit("a", DAY, 1, price=(1.0, "€")), visit("b", DAY, 2, price=(1.0, "EUR"))]), "1")
    read = Tables._read

    def lost(self, table_schema, *parts):
        if parts[0] == "merged":
            raise OSError("executor lost")
        return read(self, table_schema, *parts)

    monkeypatch.setattr(Tables, "_read", lost)
    with pytest.raises(OSError):
        tables.migrate_legacy()
    monkeypatch.setattr(Tables, "_read", read)
    tables.save_snapshots(log_of(spark, [visit("c", DAY + dt.timedelta(days=3), 3, price=(1.0, "EUR"))]), "2")
    assert tables.migrate_legacy() == 1
    assert sorted((row.url, row.price.currency) for row in tables.items().collect()) == [("a", "EUR"), ("b", "EUR"), ("c", "EUR")]


def test_only_the_days_of_the_batch_are_read(spark, tables, capsys, monkeypatch):
    tables.save_snapshots(log_of(spark, visits(spark, "a", range(12))), "1")
    plans = []
    replace = Tables._replace_days
    monkeypatch.setattr(Tables, "_replace_days", lambda self, rows, batch, old: (plans.append(rows), replace(self, rows, batch, old)))
    tables.save_snapshots(log_of(spark, visits(spark, "b", [2, 4])), "2")
    text = plans[0]._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in text.splitlines() if "PartitionFilters" in line]
    assert len(filters) == 1 and "day" in filters[0] and filters[0].count("2024-06-03") + filters[0].count("19877") >= 1, filters
    assert "2024-06-02" not in filters[0]
    assert len(stored(tables)) == 14


def test_another_time_zone(spark, tables):
    zone = spark.conf.get("spark.sql.session.timeZone")
    late = dt.datetime(2024, 1, 5, 2, tzinfo=dt.timezone.utc)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        log = spark.createDataFrame([("a", late.timestamp())], "url string, at double").select(
            "url", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.SNAPSHOT_FIELDS[1:-1]], F.timestamp_seconds("at").alias("scrapedAt"))
        tables.save_snapshots(log, "1")
        assert [row.day for row in tables.items().collect()] == [dt.date(2024, 1, 5)]
        row = tables.items().select(dates.iso(F.col("scrapedAt")).alias("t"), F.unix_seconds(dates.midnight(F.col("day"))).alias("m")).first()
        assert row.t == "2024-01-05T02:00:00.000Z" and row.m == dt.datetime(2024, 1, 5, tzinfo=dt.timezone.utc).timestamp()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_stream_in_batches_and_after_a_restart(spark, tables):
    source, checkpoint = tempfile.mkdtemp(prefix="run-"), tempfile.mkdtemp(prefix="run-")

    def run():
        stream = spark.readStream.schema(schema.SNAPSHOT_LOG).option("maxFilesPerTrigger", 1).parquet(source)
        save_stream(stream, tables, checkpoint).awaitTermination()

    for rows in (visits(spark, "a", range(3)), visits(spark, "a", [1], 8.0, seq=9) + visits(spark, "b", [1])):
        log_of(spark, rows).coalesce(1).write.mode("append").parquet(source)
    run()
    assert stored(tables) == {("a", 1): 10.0, ("a", 2): 8.0, ("a", 3): 10.0, ("b", 2): 10.0}
    log_of(spark, visits(spark, "a", [0], 6.0, seq=9)).coalesce(1).write.mode("append").parquet(source)
    run()
    assert stored(tables)[("a", 1)] == 6.0 and len(stored(tables)) == 4
