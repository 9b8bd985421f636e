"""Histories kept in buckets of urls, refined from what changed, with deletions in a log."""

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide import schema
from pricetide.operators.history import merged_history, price_history, without_keys
from pricetide.operators.price_stats import merged_stats, price_stats, scores_of_stats
from pricetide.session import sized_shuffles
from pricetide.sources.buckets import BUCKETS, Buckets
from pricetide.sources.tables import Tables

READER, STATS_READER = "history", "stats"
# Deleted urls are looked up on every read; from so many on they are taken out of the buckets.
MOST_DELETED = 1_000_000


def history_buckets(tables: Tables, buckets: int = BUCKETS) -> Buckets:
    return Buckets(tables, "history_buckets", schema.PRICE_HISTORY, "url", ["url"], buckets)


def _logged(tables: Tables, *logs: str) -> list[str]:
    return [f"{tables.folder}/{log}/{name}" for log in logs for name in tables._names(log) if tables._exists(log, name, "_SUCCESS")]


def deleted(tables: Tables, *logs: str) -> DataFrame:
    """The urls in the deletion logs: `deleted` are still in the buckets, `removed` are not any more."""
    paths = _logged(tables, *(logs or ("deleted", "removed")))
    return tables.spark.read.schema(schema.DELETED).parquet(*paths) if paths else tables.spark.createDataFrame([], schema.DELETED)


def histories(tables: Tables) -> DataFrame:
    """Stored histories without deleted products."""
    rows = history_buckets(tables).read()
    return without_keys(rows, deleted(tables, "deleted")) if _logged(tables, "deleted") else rows


def scores(tables: Tables) -> DataFrame:
    """Stored scores without those of deleted products."""
    rows = tables.read("deal_scores")
    return without_keys(rows, deleted(tables)) if _logged(tables, "deleted", "removed") else rows


def delete_products(tables: Tables, dead: DataFrame, most: int = MOST_DELETED) -> None:
    """One row of the log per dead url; no history and no score is rewritten, until `most` urls have come together."""
    dead.select("url").filter(F.col("url").isNotNull()).distinct().write.parquet(f"{tables.folder}/deleted/{uuid.uuid4().hex}")
    if deleted(tables, "deleted").count() >= most:
        compact(tables)


def compact(tables: Tables) -> None:
    """Take deleted urls out of the buckets that have them. They stay on record until histories are refined."""
    kept = history_buckets(tables)
    kept.resume()
    names = tables._names("deleted")
    gone = deleted(tables, "deleted")
    touched = kept.of(gone)
    gone.distinct().write.parquet(f"{tables.folder}/removed/{uuid.uuid4().hex}")
    kept.replace(without_keys(kept.read(touched), gone), touched)
    _drop(tables, "deleted", names)


def _drop(tables: Tables, log: str, names: list[str]) -> None:
    for name in names:
        files, path = tables._path(log, name)
        files.delete(path, True)


def refine_new(tables: Tables, as_of: Column, buckets: int = BUCKETS) -> int:
    """Q9: bring the histories up to date with the daily rows that were saved since the last time; returns how many
    products were refined. Nothing saved, no write.

    Only the days that changed are read, and only buckets with a changed url are read and written. Products that were
    deleted, and that have visits, come back with all their days, as a refine of all would bring them back; for these
    alone the visits of all days are read. The first run, and only that, builds the histories of all products. A repeat of
    a run that broke off gives the same histories.
    """
    kept = history_buckets(tables, buckets)
    kept.resume()
    batches = tables.pending(READER)
    logs = {log: tables._names(log) for log in ("deleted", "removed")}
    if not kept.exists:
        items = tables.items()
        if items.isEmpty():
            return 0
        with sized_shuffles(tables.spark, tables.size("items_raw")):
            refined = kept.replace(price_history(items, as_of), list(range(kept.number)), reader=READER, batches=batches)
    elif not batches and not any(logs.values()):
        return 0
    else:
        refined = _refine_touched(tables, kept, batches, as_of)
    for log, names in logs.items():
        _drop(tables, log, names)
    return refined


def _refine_touched(tables: Tables, kept: Buckets, batches: list[str], as_of: Column) -> int:
    gone = deleted(tables).distinct()
    some_gone = bool(_logged(tables, "deleted", "removed"))
    keys, changed = gone, tables.items().limit(0)
    if batches:
        changes = tables.changes(batches).select("url", "day").distinct()
        days = tables._days(changes.select("day"))
        changed = tables.items().filter(F.col("day").isin(days)).join(changes, ["url", "day"], "left_semi")
        keys = keys.unionByName(changes.select("url"))
    touched = kept.of(keys)
    old = kept.read(touched)
    if some_gone:
        old = without_keys(old, gone)
        again = tables.items().join(gone, "url", "left_semi")
        changed = without_keys(changed, gone).unionByName(again)
    return kept.replace(merged_history(old, changed, as_of), touched, "count_if(fresh)", READER, batches)


def stats_buckets(tables: Tables, buckets: int = BUCKETS) -> Buckets:
    return Buckets(tables, "price_stats", schema.PRICE_STATS, "url", ["url"], buckets)


def update_stats(tables: Tables, buckets: int = BUCKETS) -> int:
    """Bring the price statistics up to date with the days saved since the last time; returns how many products
    changed. Of the visits only changed days are read, but for products whose newest price was taken back."""
    kept = stats_buckets(tables, buckets)
    kept.resume()
    batches = tables.pending(STATS_READER)
    items = tables.items()
    if not kept.exists:
        if items.isEmpty():
            return 0
        with sized_shuffles(tables.spark, tables.size("items_raw")):
            changed = kept.replace(price_stats(items), list(range(kept.number)), reader=STATS_READER, batches=batches)
    elif not batches:
        return 0
    else:
        listed = tables.changes(batches)
        days = tables._days(listed.select("day"))
        before = listed.groupBy("url", "day").agg(F.min_by(F.struct("replaced", "oldAmount"), "number").alias("before"))
        now = items.filter(F.col("day").isin(days)).select("url", "day", "price")
        changes = now.join(before, ["url", "day"]).select("url", "day", "price", "before.*")
        touched = kept.of(listed)
        merged = merged_stats(kept.read(touched), changes)
        again = merged.filter("rebuild").select("url")
        if not again.isEmpty():
            rebuilt = price_stats(items.join(again, "url", "left_semi")).withColumn("fresh", F.lit(True))
            merged = merged.filter("NOT rebuild").drop("rebuild").unionByName(rebuilt)
        # Sums must not take in a batch twice, so it is noted with the copy.
        changed = kept.replace(merged, touched, "count_if(fresh)", STATS_READER, batches)
    return changed


def score_new(tables: Tables, as_of: Column) -> int:
    """Q10 from the price statistics: a narrow row per product, whatever the length of its history.

    Products with a score are those with a history; deleted ones are left out until they are refined again.
    """
    update_stats(tables)
    stats = stats_buckets(tables).read()
    if _logged(tables, "deleted", "removed"):
        stats = without_keys(stats, deleted(tables))
    return tables.save_scores(scores_of_stats(stats, as_of))


def refine_and_score_new(tables: Tables, as_of: Column) -> tuple[int, int]:
    """Q11 from what changed."""
    return refine_new(tables, as_of), score_new(tables, as_of)
