"""Exact search against numpy; shards against what every cut must give."""

import math
import random

import numpy as np
import pytest

from pricetide.llm.queries import QUERIES
from pricetide.llm import inner_products, kd_shards

SCHEMA = "vec_id long, embedding array<float>, length string"


def brute(rows, k):
    fine = {}
    for ident, x, _ in rows:
        if ident is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = [math.floor(float(np.float32(c)) * 64) for c in x]
        fine[ident] = min(fine.get(ident, v), v)
    out = []
    for q in sorted(fine):
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(fine[q], v)), i) for i, v in fine.items() if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


def searched(frame, rows, k=20):
    vectors = inner_products.integer_vectors(frame(rows, SCHEMA))
    return sorted(map(tuple, inner_products.top_k(vectors, vectors.filter("id % 20 = 0"), k).collect()))


def test_search_equals_brute_force(frame, monkeypatch):
    monkeypatch.setattr(inner_products, "BLOCK_ROWS", 64)
    monkeypatch.setattr(inner_products, "QUERY_ROWS", 8)
    rng = np.random.default_rng(1)
    scales = rng.pareto(1.5, 400)[:, None] + 0.1
    rows = [(i, [float(c) for c in v], "x") for i, v in enumerate((rng.normal(0, 0.3, (400, 6)) * scales).astype(np.float32))]
    rows += [(500 + i, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5], "same") for i in range(40)]
    assert searched(frame, rows) == brute(rows, 20)


def test_driver_sees_no_vectors_and_shelves_hold_all_blocks(spark, frame, monkeypatch):
    monkeypatch.setattr(inner_products, "BLOCK_ROWS", 16)
    monkeypatch.setattr(inner_products, "QUERY_ROWS", 8)
    monkeypatch.setattr(inner_products, "SHELVES", 4)
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in v], "x") for i, v in enumerate(rng.normal(0, 0.3, (300, 6)).astype(np.float32))]
    vectors = inner_products.integer_vectors(frame(rows, SCHEMA))
    taken = []
    collect = type(vectors).collect
    monkeypatch.setattr(type(vectors), "collect", lambda self: taken.append(collect(self)) or taken[-1])
    found = inner_products.top_k(vectors, vectors.filter("id % 20 = 0"), 20)
    assert taken and max(map(len, taken)) <= -(-300 // 16) + 1
    monkeypatch.setattr(type(vectors), "collect", collect)
    assert sorted(map(tuple, found.collect())) == brute(rows, 20)


def test_search_with_odd_rows(frame):
    rows = [
        (0, [1.0, 2.0], "a"), (20, None, "b"), (40, [1.0, None], "c"), (60, [float("nan"), 1.0], "d"), (80, [float("inf"), 1.0], "e"),
        (None, [1.0, 1.0], "f"), (1, [1.0, 2.0], "g"), (1, [1.0, 2.0], "g"), (2, [-1.0, -2.0], "h"), (3, [], "i"), (4, [3.0], "j"),
    ]
    assert searched(frame, rows) == brute(rows, 20)
    assert searched(frame, rows[:1]) == []
    assert searched(frame, []) == []


DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string"


def test_shards(frame):
    rng = random.Random(4)
    rows = [(i, "a" * rng.randint(0, 400), rng.choice(["en", "de", None]), rng.choice(["s1", "s2"]), 1, "x") for i in range(700)]
    rows += [(1000 + i, "copy" * 25, "en", "s1", 1, None) for i in range(400)] + [(5000, None, None, None, None, None), (None, "id", "en", "s", 2, "")]
    out = kd_shards.document_shards(frame(rows, DOCS), leaves=8).collect()
    assert sorted((r.doc_id or -1, r.size) for r in out) == sorted((r[0] or -1, len(r[1] or "") + 1) for r in rows)
    sizes = [sum(r.size for r in out if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 0.15 * sum(sizes) / 8  # classes of up to a tenth of a shard are not cut
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_equal_texts_lie_together(spark):
    """On the given documents no group of equal texts is cut, and shards are within four in a hundred of their mean."""
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = QUERIES["op6_kd_tree_shards"](spark, folder).collect()
    of, sizes = {}, [0] * 8
    for r in out:
        of.setdefault(texts[r.doc_id], set()).add(r.shard)
        sizes[r.shard] += r.size
    assert len(out) == len(texts) and all(len(shards) == 1 for shards in of.values())
    assert max(sizes) <= 1.04 * sum(sizes) / 8 and min(sizes) >= 0.96 * sum(sizes) / 8


def test_more_open_nodes_than_a_pass_looks_at(frame, monkeypatch):
    monkeypatch.setattr(kd_shards, "OPEN", 2)
    rows = [(i, "a" * (10 + i), "en", "s", 1, "") for i in range(200)]
    out = kd_shards.document_shards(frame(rows, DOCS), leaves=16).collect()
    assert len({r.shard for r in out}) == 16


def test_very_common_vector(frame):
    """Half of the rows have one vector, which is also the best for all; each is still a row of its own in the result."""
    rows = [(i, [1.0, 2.0, 3.0] if i % 2 else [float(i % 7), 1.0, 0.5], "x") for i in range(300)] + [(20 * i, [1.0, 2.0, 3.0], "q") for i in range(20, 25)]
    assert searched(frame, rows) == brute(rows, 20)


@pytest.mark.parametrize("leaves", [1, 3, 5])
def test_other_numbers_of_leaves(frame, leaves):
    rows = [(i, "a" * (i % 50), "en", "s", 1, "") for i in range(500)]
    out = kd_shards.document_shards(frame(rows, DOCS), leaves=leaves).collect()
    sizes = [sum(r.size for r in out if r.shard == s) for s in range(leaves)]
    assert sum(sizes) == sum(len(r[1]) + 1 for r in rows) and max(sizes) - min(sizes) <= 0.15 * sum(sizes) / leaves


def test_target_bytes_and_repeated_and_empty(frame):
    rows = [(7, "same", "en", "s", 1, "")] * 64
    out = kd_shards.document_shards(frame(rows, DOCS), target=100).collect()
    assert len(out) == 64  # rows equal in everything stay on one side of each cut
    assert kd_shards.document_shards(frame([], DOCS), leaves=8).collect() == []
