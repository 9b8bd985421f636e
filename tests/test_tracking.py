"""Folded commands against a replay one by one."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pricetide.functions import ids
from pricetide.operators import tracking

RAW = "raw_key string, action string, ts timestamp, seq long"
START = dt.datetime(2024, 1, 1)


def random_commands(seed, keys, actions, n=400):
    random.seed(seed)
    # A third of the commands go to one key; several fall into the same second.
    return [
        (keys[0] if random.random() < 0.33 else random.choice(keys), random.choice(actions), START + dt.timedelta(seconds=random.randint(0, 90000)), i)
        for i in range(n)
    ]


def replay(commands, state):
    state, outcomes = dict(state), {}
    for raw, action, ts, seq in sorted(commands, key=lambda c: (c[2], c[3])):
        key = raw.strip()
        if not key:
            outcomes[seq] = "invalid"
        elif action == "track":
            known = key in state
            outcomes[seq] = "created" if not known else "conflict" if state[key] in (True, None) else "reenabled"
            if outcomes[seq] != "conflict":
                state[key] = True
        elif key not in state:
            outcomes[seq] = "not_found"
        else:
            outcomes[seq], state[key] = "untracked", False
    return outcomes, state


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("rows", [1, 7, 50_000])
def test_keywords(spark, seed, rows):
    keys = ["hot", " on", "off ", "unsaid", "idle", "new1", "new2", "  "]
    state = {"on": True, "off": False, "unsaid": None, "idle": None}
    commands = random_commands(seed, keys, ["track", "untrack"], 400 if seed else 12)
    outcomes, after = replay(commands, state)
    frame = tracking.keyword_commands(spark.createDataFrame(commands, RAW))
    stored = spark.createDataFrame(list(state.items()), "key string, enabled boolean")
    judged = tracking.tracking_outcomes(frame, stored, tracking.KEYWORD_CODES, rows)
    assert {row.seq: row.outcome for row in judged.collect()} == outcomes
    assert {row.key: row.enabled for row in tracking.tracking_state(frame, stored).collect()} == after


def test_codes(spark):
    commands = [("a", "track", START, 1), ("a", "track", START, 2), ("b", "untrack", START, 3), (" ", "track", START, 4)]
    frame = tracking.keyword_commands(spark.createDataFrame(commands, RAW))
    stored = spark.createDataFrame([], "key string, enabled boolean")
    rows = tracking.tracking_outcomes(frame, stored, tracking.KEYWORD_CODES).orderBy("seq").collect()
    assert [(row.outcome, row.error_code, row.error_class, row.status) for row in rows] == [
        ("created", None, None, None), ("conflict", "KEYWORD_ALREADY_TRACKED", "conflict", 409),
        ("not_found", "KEYWORD_NOT_FOUND", "not_found", 404), ("invalid", "INVALID_KEYWORD_NAME", "invalid", 400),
    ]


@pytest.mark.parametrize("seed", range(3))
def test_favorites(spark, seed):
    urls = [f"https://www.amazon.fr/dp/B00000000{i}?th=1" for i in range(6)] + ["https://example.org/x"]
    frame = spark.createDataFrame([(url,) for url in urls], "url string")
    names = {row.url: row.id for row in frame.select("url", ids.product_id(F.col("url")).alias("id")).collect()}
    commands = random_commands(seed, [names[url] for url in urls] + ["###"], ["add", "remove"], 300 if seed else 10)
    state = {urls[0]: dt.datetime(2023, 5, 5), urls[1]: dt.datetime(2023, 6, 6), urls[6]: dt.datetime(2023, 7, 7)}

    after, outcomes, tracked = dict(state), {}, set()
    back = {name: url for url, name in names.items()}
    for raw, action, ts, seq in sorted(commands, key=lambda c: (c[2], c[3])):
        url = back.get(raw)
        if url is None or (action == "add" and url == urls[6]):
            outcomes[seq] = "INVALID_PRODUCT_ID" if url is None else "INVALID_PRODUCT_URL"
        elif action == "add":
            outcomes[seq] = "already_favorite" if url in after else "added"
            after.setdefault(url, ts)
            tracked.add(url.split("?")[0] + "/")
        else:
            outcomes[seq] = "removed"
            after.pop(url, None)

    parsed = tracking.favorite_commands(spark.createDataFrame(commands, RAW))
    stored = spark.createDataFrame(list(state.items()), "key string, addedAt timestamp")
    judged = tracking.favorite_outcomes(parsed, stored).persist()
    assert {row.seq: row.error_code or row.outcome for row in judged.collect()} == outcomes
    assert {row.key: row.addedAt for row in tracking.favorite_state(judged, stored).collect()} == after
    assert {row.key for row in tracking.tracking_from_favorites(parsed).collect()} == tracked


def test_seeding(spark):
    defaults = spark.createDataFrame([("a",), ("b",)], "keyword string")
    empty = spark.createDataFrame([], "keyword string, enabled boolean")
    assert sorted(map(tuple, tracking.seeded(empty, defaults).collect())) == [("a", True), ("b", True)]
    filled = spark.createDataFrame([("x", None)], "keyword string, enabled boolean")
    assert list(map(tuple, tracking.seeded(filled, defaults).collect())) == [("x", None)]


def test_a_crowded_hour_is_ordered_in_parts(spark):
    rows = [("hot" if i % 10 else f"k{i}", "track", START + dt.timedelta(milliseconds=3 * i), i) for i in range(20_000)]
    named = tracking.keyword_commands(spark.createDataFrame(rows, RAW))
    parts = tracking._spans(named, 1000).groupBy("key", "span", "part").count().agg(F.max("count"), F.count("*")).first()
    assert parts[0] <= 1100 and parts[1] >= 18
    stored = spark.createDataFrame([], "key string, enabled boolean")
    judged = tracking.tracking_outcomes(named, stored, tracking.KEYWORD_CODES, 1000)
    counts = {row.outcome: row["count"] for row in judged.groupBy("outcome").count().collect()}
    assert counts == {"created": 2001, "conflict": 17_999}


def test_keys_are_worked_out_once(spark):
    """However many filters and keys use a command's key, a plan names the pattern of a product page once per scan."""
    raw = spark.createDataFrame([(None, "add", START, 1)], RAW)
    for decode, folded in ((tracking.url_commands, tracking.tracking_state), (tracking.favorite_commands, tracking.tracking_state)):
        state = spark.createDataFrame([], "key string, enabled boolean")
        plan = folded(decode(raw), state)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("[A-Z0-9]{10}") == 1
