"""Snapshots, histories and scores against plain loops over random series."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide import schema
from pricetide.operators import history, scoring, snapshots

NOW = dt.datetime(2024, 6, 30, 6, 0)
ENTRIES = "url string, day date, price struct<amount:double,currency:string>, crossedOutPrice struct<amount:double,currency:string>, " \
    "unitPrice struct<amount:double,unit:string>, scrapedAt timestamp"


def entry(url, day, amount, crossed=None):
    money = lambda x: None if x is None else (x, "EUR")
    return (url, day, money(amount), money(crossed), None, dt.datetime.combine(day, dt.time(8)))


def day(ago):
    return NOW.date() - dt.timedelta(days=ago)


def histories(entries):
    """Stored histories of the entries; nothing else about the products is known."""
    unknown = {name: F.lit(None).cast("string") for name in ("shop", "keyword", "title")}
    return history.price_history(entries.withColumns(unknown | {"images": F.array().cast("array<string>")}), F.lit(NOW))


def score_one(rows):
    """Mean of the priced days up to 30 days back, for the newest priced day; None unless scoreable."""
    rows = sorted(rows)
    seen, best = [], None
    for when, amount in rows:
        month = [a for d, a in seen if a is not None and (when - d).days <= 30]
        if amount is not None:
            best = (when, amount, sum(month) / len(month) if month else None, len(seen))
        seen.append((when, amount))
    if best is None or best[3] < 5 or best[2] is None or dt.datetime.combine(best[0], dt.time()) < NOW - dt.timedelta(days=2):
        return None
    priced = [(d, a) for d, a in rows if a is not None]
    x = np.array([(d - priced[0][0]).days for d, _ in priced], float)
    y = np.array([a for _, a in priced])
    relative = np.polyfit(x, y, 1)[0] / y.mean() * 100
    trend = "down" if relative <= -0.5 else "up" if relative >= 0.5 else "stable"
    return (round((best[2] - best[1]) / best[2] * 100, 1), round(best[2], 2), best[1], trend)


def test_scores_of_random_series(spark):
    random.seed(11)
    series = {}
    for i in range(300):
        slope, start = random.choice([-0.3, -0.05, 0, 0.05, 0.3]), random.uniform(5, 50)
        days = random.sample(range(0, 70), random.randint(1, 40))
        if random.random() < 0.7:
            days = list(set(days) | {random.choice([0, 1])})
        series[f"u{i}"] = [
            (day(ago), None if random.random() < 0.2 else round(max(start - slope * ago + random.uniform(-2, 2), 0.5), 2)) for ago in days
        ]
    rows = [entry(url, when, amount) for url, points in series.items() for when, amount in points]
    entries = spark.createDataFrame(rows, ENTRIES).persist()
    expected = {url: score for url, points in series.items() if (score := score_one(points))}
    assert 50 < len(expected) < 300
    for scores in (scoring.deal_scores(entries, F.lit(NOW)), scoring.deal_scores_of_histories(histories(entries), F.lit(NOW))):
        found = {row.url: (row.score, row.predictedPrice, row.actualPrice, row.trendDirection) for row in scores.collect()}
        assert found == expected


@pytest.mark.parametrize(
    "name, points, scored",
    [
        ("five before", [(i, 10.0) for i in range(6)], True),
        ("four before", [(i, 10.0) for i in range(5)], False),
        ("an unpriced one counts", [(0, 10.0), (1, 10.0), (2, None), (3, 10.0), (4, 10.0), (5, 10.0)], True),
        ("gap of 30 days", [(0, 10.0)] + [(i, 10.0) for i in range(30, 35)], True),
        ("gap of 31 days", [(0, 10.0)] + [(i, 10.0) for i in range(31, 36)], False),
        ("newest is one day old", [(i, 10.0) for i in range(1, 7)], True),
        ("newest is two dates back", [(i, 10.0) for i in range(2, 8)], False),
        ("newest unpriced, older priced", [(0, None)] + [(i, 10.0) for i in range(1, 7)], True),
        ("free before", [(0, 10.0)] + [(i, 0.0) for i in range(1, 7)], True),
    ],
)
def test_who_is_scored(spark, name, points, scored):
    frame = spark.createDataFrame([entry("u", day(ago), amount) for ago, amount in points], ENTRIES)
    for scores in (scoring.deal_scores(frame, F.lit(NOW)), scoring.deal_scores_of_histories(histories(frame), F.lit(NOW))):
        found = scores.collect()
        assert len(found) == scored
        if name == "free before":
            assert found[0].score is None  # no score against a mean of zero


def test_two_dates_back_counts_at_midnight(spark):
    frame = spark.createDataFrame([entry("u", day(ago), 10.0) for ago in range(2, 8)], ENTRIES)
    assert scoring.deal_scores(frame, F.lit(dt.datetime.combine(NOW.date(), dt.time()))).count() == 1


def test_trend_limits(spark):
    rows = spark.createDataFrame(
        [(0.5, 100.0, "up"), (-0.5, 100.0, "down"), (0.499, 100.0, "stable"), (1.0, 0.0, "stable"), (None, 5.0, "stable")],
        "slope double, mean double, trend string",
    )
    assert rows.filter(scoring.trend(F.col("slope"), F.col("mean")) != F.col("trend")).count() == 0


def visit(url, at, seq, **fields):
    row = dict.fromkeys((field.name for field in schema.SNAPSHOT_LOG), None) | {"url": url, "scrapedAt": at, "seq": seq} | fields
    return tuple(row[field.name] for field in schema.SNAPSHOT_LOG)


def test_last_visit_of_the_day_wins_with_its_nulls(spark):
    at = dt.datetime(2024, 6, 1, 10)
    log = spark.createDataFrame(
        [
            visit("u", at, 1, title="early", keyword="k", price=(5.0, "EUR")),
            visit("u", at + dt.timedelta(hours=1), 2, title="late"),
            visit("u", at + dt.timedelta(hours=1), 3, title="last"),
            visit("u", dt.datetime(2024, 6, 1, 23, 59, 59), 0, title="end of day", price=(1.0, "EUR")),
            visit("u", dt.datetime(2024, 6, 2), 0, title="next day"),
            visit("v", at + dt.timedelta(hours=1), 2, title="late", keyword="k"),
            visit("v", at + dt.timedelta(hours=1), 3, title=None),
        ],
        schema.SNAPSHOT_LOG,
    )
    once = snapshots.daily_snapshots(log)
    rows = {(row.url, str(row.day)): (row.title, row.keyword, row.price and row.price.amount) for row in once.collect()}
    assert rows == {
        ("u", "2024-06-01"): ("end of day", None, 1.0), ("u", "2024-06-02"): ("next day", None, None), ("v", "2024-06-01"): (None, None, None),
    }
    again = snapshots.daily_snapshots(once.drop("day").unionByName(log))
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))


def test_newest_row_then_usable(spark):
    log = spark.createDataFrame(
        [
            visit("unpriced", dt.datetime(2024, 6, 1), 1, title="t", price=(5.0, "EUR")), visit("unpriced", dt.datetime(2024, 6, 2), 2, title="t"),
            visit("blank", dt.datetime(2024, 6, 1), 3, title="", price=(5.0, "EUR")),
            visit("untitled", dt.datetime(2024, 6, 1), 4, title=None, price=(5.0, "EUR")),
        ],
        schema.SNAPSHOT_LOG,
    )
    assert [row.url for row in snapshots.latest_usable(snapshots.daily_snapshots(log), "url").collect()] == ["untitled"]


def test_history_of_a_product(spark):
    frame = spark.createDataFrame([entry("u", day(ago), amount, 20.0 if ago == 3 else None) for ago, amount in [(3, 15.5), (0, 12.99), (2, None), (7, 15.9)]], ENTRIES)
    whole = frame.select("*", F.lit("amazon").alias("shop"), F.lit("k").alias("keyword"), F.lit("t").alias("title"), F.array(F.lit("i")).alias("images"))
    built = history.price_history(whole, F.lit(NOW))
    row = built.first()
    assert [e.price and e.price.amount for e in row.history] == [15.9, 15.5, None, 12.99]
    assert (row.firstSeen, row.lastSeen) == (day(7), day(0))
    recent = history.recent_history(built, 2).first()
    assert [e.price and e.price.amount for e in recent.recent] == [12.99, None] and (recent.totalCount, recent.omittedCount) == (4, 2)
    with pytest.raises(ValueError):
        history.recent_history(built, 366)

    deltas = history.price_deltas(frame).orderBy("position").collect()
    assert [row.delta and round(row.delta, 2) for row in deltas] == [None, None, -0.4, None]
    stats = history.price_stats(frame).first()
    assert (stats.minPrice, stats.maxPrice, stats.pricedCount, stats.hasCrossedOut, stats.chartable, stats.showDots) == (12.99, 15.9, 3, True, True, True)
    filled = [(str(row.day), row.price, row.crossedOut) for row in history.filled_prices(frame).orderBy("day").collect()]
    assert filled == [
        (str(day(7)), 15.9, None), (str(day(6)), 15.9, None), (str(day(5)), 15.9, None), (str(day(4)), 15.9, None), (str(day(3)), 15.5, 20.0),
        (str(day(2)), 15.5, 20.0), (str(day(1)), 15.5, 20.0), (str(day(0)), 12.99, 20.0),
    ]


def test_deltas_stop_at_the_table_edge(spark):
    frame = spark.createDataFrame([entry("u", day(ago), float(ago)) for ago in range(20)], ENTRIES)
    rows = history.price_deltas(frame).orderBy("position").collect()
    assert len(rows) == 15 and [row.delta for row in rows] == [-1.0] * 14 + [None]


def test_top_per_key_with_a_hot_key(spark):
    random.seed(5)
    rows = [("hot" if random.random() < 0.6 else f"k{random.randint(0, 20)}", f"u{i}", random.randint(0, 50)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k string, url string, n int")
    for size in (1, 3, 150):
        top = snapshots.top_per_key(frame, "k", [F.desc("n"), F.asc("url")], size, spread="url").collect()
        found = {}
        for row in sorted(top, key=lambda r: (r.k, r["rank"])):
            found.setdefault(row.k, []).append(row.url)
        groups = {}
        for key, url, n in sorted(rows, key=lambda r: (-r[2], r[1])):
            groups.setdefault(key, []).append(url)
        assert found == {key: urls[:size] for key, urls in groups.items()}
