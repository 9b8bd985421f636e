"""How the search index is spread over tasks and files."""

import os
import tempfile
from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.plans import search_index
from pricetide.session import files_for
from pricetide.sources.buckets import Buckets
from pricetide.sources.tables import Tables
from test_incremental import save, seen


def test_files_follow_cores_until_they_get_small():
    spark = SimpleNamespace(sparkContext=SimpleNamespace(defaultParallelism=12))
    mb = 2**20
    assert [files_for(spark, n * mb, 256 * mb) for n in (0, 1, 10, 14, 500, 2 * 4096)] == [8, 8, 10, 12, 12, 32]


def test_a_gram_of_many_titles_is_many_files(spark):
    """All titles of one keyword have a run: its list is cut by products, and each file is sorted by keyword and run."""
    tables = Tables(spark, tempfile.mkdtemp(prefix="run-"))
    save(tables, [seen(f"u{i}", 0, title="abc") for i in range(400)], "1")
    search_index.update_index(tables, buckets=2)
    rows = search_index.keyword_grams(tables).read()
    per_file = rows.groupBy(F.input_file_name()).count().collect()
    assert rows.count() == 400 and len(per_file) == 8 and max(r["count"] for r in per_file) < 200
    assert {r.url for r in search_index.indexed_products(tables, "k", "ABC").collect()} == {f"u{i}" for i in range(400)}


def test_runs_are_taken_of_titles_dealt_to_all_cores(spark, monkeypatch):
    """Titles of one keyword, one folder of one file: the rows that are staged come from several tasks."""
    tables = Tables(spark, tempfile.mkdtemp(prefix="run-"))
    tasks = []
    replace = Buckets.replace

    def watched(self, rows: DataFrame, *args, **names):
        if self.name == "keyword_grams":
            tasks.append(rows.select(F.spark_partition_id()).distinct().count())
        return replace(self, rows, *args, **names)

    monkeypatch.setattr(Buckets, "replace", watched)
    monkeypatch.setattr("pricetide.sources.buckets.files_for", lambda *_: 1)
    save(tables, [seen(f"u{i}", 0, title=f"soap {i}") for i in range(100)], "1")
    search_index.update_index(tables, buckets=1)
    assert sum(name.endswith(".parquet") for name in os.listdir(f"{tables.folder}/keyword_products/bucket=0")) == 1
    assert tasks == [8]


def test_rows_that_left_a_keyword_are_looked_up_only_after_replacements(spark, monkeypatch):
    tables = Tables(spark, tempfile.mkdtemp(prefix="run-"))
    save(tables, [seen("u1", 0), seen("u2", 0)], "1")
    search_index.update_index(tables, buckets=2)
    asked, is_empty = [], type(tables.items()).isEmpty
    monkeypatch.setattr(type(tables.items()), "isEmpty", lambda self: asked.append(self.columns) or is_empty(self))
    save(tables, [seen("u1", 1, price=3.0)], "2")
    search_index.update_index(tables)
    assert ["keyword", "url", "day"] not in asked
    save(tables, [seen("u1", 1, seq=9, keyword="other")], "3")
    search_index.update_index(tables)
    assert ["keyword", "url", "day"] in asked
    assert [r.day.day for r in search_index.indexed_products(tables, "k").filter("url = 'u1'").collect()] == [1]
