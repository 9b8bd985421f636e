"""Fingerprints against sets of paragraphs compared in full, and the order of documents against a plain sort."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from pricetide.llm import fingerprints
from pricetide.llm.queries import QUERIES


def mixed(x, seed):
    m = 2**64
    x = (x ^ seed * 0x9E3779B97F4A7C15 % m) * 0xD6E8FEB86659FD93 % m
    x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % m
    return x ^ x >> 32


def paragraphs(text):
    """One byte after the other."""
    data, parts, start = text.encode(), [], 0
    for i, c in enumerate(data):
        before = 0
        for k in range(1, 5):
            before = before << 8 | (data[i - k] if i >= k else 0)
        if c == 10 or (c == 32 and mixed(before, 1) % fingerprints.CUT_EVERY == 0):
            parts.append(data[start : i + 1])
            start = i + 1
    parts.append(data[start:])
    return Counter(p.strip() for p in parts if p.strip())


def near(one, other):
    union = sum((one | other).values())
    return sum((one & other).values()) / union if union else 1.0


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta,", "epsilon."]) + str(rng.integers(0, 3000)) for _ in range(n))


TEXTS = ["", " \n ", "one", "two words", "line\nline\nline", "x " * 5000, "日本語 text é\r\nmore"]


def digests(*texts):
    return fingerprints.paragraph_digests([t.encode() for t in texts])


def test_digests_are_those_of_paragraphs():
    rng = np.random.default_rng(0)
    texts = TEXTS + [words(rng, 300) + "\n" + words(rng, 40)]
    found, edges = digests(*texts)
    for text, a, b in zip(texts, edges, edges[1:]):
        parts, own = paragraphs(text), found[a:b].tolist()
        assert len(set(own)) == sum(parts.values()) == len(own)
        assert {xxhash.xxh3_64_intdigest(p) for p in parts} <= set(own)


def test_peeling_recovers_the_differences(monkeypatch):
    rng = np.random.default_rng(3)
    draw = lambda k: rng.integers(0, 2**63, k, dtype=np.uint64)
    pairs = [(draw(n), draw(n // 2), draw(c)) for n in (0, 1, 5, 20, 400, 5000) for c in (0, 3000)]
    sides = [[np.concatenate([p[side], p[2]]) for p in pairs] for side in (0, 1)]
    one, other = ((np.concatenate(x), np.cumsum([0, *map(len, x)])) for x in sides)
    for at_once in (2**18, 1):
        monkeypatch.setattr(fingerprints, "CELLS_AT_ONCE", at_once)
        row, found, signs = fingerprints.differences(one, other)
        for i, (left, right, _) in enumerate(pairs):
            assert set(found[(row == i) & (signs > 0)].tolist()) == set(left.tolist())
            assert set(found[(row == i) & (signs < 0)].tolist()) == set(right.tolist())
        assert len(row) == sum(len(p[0]) + len(p[1]) for p in pairs)
    whole = fingerprints.Sketches.of(*one, 2).minus(fingerprints.Sketches.of(*other, 2)).peeled()[3]
    assert whole.tolist()[:2] == [True, True] and not whole[-4:].any()


def test_published_fingerprints():
    rng = np.random.default_rng(5)
    text = "\n".join(words(rng, 12) for _ in range(200))
    lines = text.split("\n")
    lines[17], lines[130] = "a new line", lines[130] + " end"
    sets = digests(text, "\n".join(lines), "", "\n".join(text.split("\n")[::-1]))
    a, b, empty, turned = fingerprints.fingerprints(*sets)
    assert a == turned and len(a) == len(b) == len(empty)
    assert fingerprints.compared(a, b) == pytest.approx(near(paragraphs(text), paragraphs("\n".join(lines))))
    assert fingerprints.compared(a, a) == 1.0 == fingerprints.compared(empty, empty)
    assert fingerprints.compared(a, empty) is None
    n, sketch = fingerprints.Sketches.read(a)
    assert n == sets[1][1] and sketch.written([n]) == [a]


ROWS = [
    (5, "five"), (3, "three\nlines"), (3, "three again"), (-2, None), (9, "x " * 3000), (9, "x " * 3000), (9, "x " * 3000), (None, "no id"),
    (None, ""), (1000, "日本語 😀"), (7, "five"), (2**62, "far")]


def in_order(spark, rows):
    """Rows with the text of the next distinct (id, text)."""
    from pyspark.sql import functions as F

    distinct = sorted({(2**63 - 1 if i is None else i, t or "") for i, t in rows})
    hashes = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in {t for _, t in distinct}], "t string").select("t", F.xxhash64("t")).collect()}
    distinct.sort(key=lambda r: (r[0], hashes[r[1]]))
    after = {r: distinct[(k + 1) % len(distinct)][1] for k, r in enumerate(distinct)}
    return [(str(i), t or "", after[2**63 - 1 if i is None else i, t or ""]) for i, t in rows]


@pytest.mark.parametrize("block_bytes", [None, 1, 100])
def test_next_documents(spark, frame, block_bytes, monkeypatch):
    monkeypatch.setattr(fingerprints, "BATCH", 5000)
    docs = frame([(i, t, 1, True) for i, t in ROWS], "doc_id long, text string, block int, behind boolean")
    out = [(str(r.doc_id), r.text, r.next_text) for r in fingerprints.with_next(docs, block_bytes).collect()]
    assert sorted(out) == sorted(in_order(spark, ROWS))
    assert fingerprints.with_next(docs.filter("false"), block_bytes).collect() == []
    one = fingerprints.with_next(docs.filter("doc_id = 5"), block_bytes).collect()
    assert [tuple(r) for r in one] == [(5, "five", "five")]


def check(out, pairs):
    want = []
    for ident, text, after in pairs:
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        sets = [paragraphs(t) for t in (text, edited, after)]
        want.append((ident, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(near(sets[0], sets[1]), 9), round(near(sets[0], sets[2]), 9)))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in out]
    assert sorted(got) == sorted(want)


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    out = QUERIES["op13_invertible_sketch"](spark, folder).collect()
    check(out, in_order(spark, rows))
    texts = dict(rows)
    by_text = {}
    for r in out:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert (r.near_edited == 1) == (r.n_gained + r.n_lost == 0)
    assert np.mean([r.near_edited for r in out]) > np.mean([r.near_next for r in out]) + 0.2


def test_odd_versions(spark, frame):
    docs = frame([(1, None, "a", "x"), (2, "a\nb", "a\nb", None), (None, "a", "", "y")], "doc_id long, text string, other string, text_print string")
    out = {str(r.doc_id): r for r in fingerprints.compare_versions(docs, ["text", "other"]).collect()}
    assert [out[k].other_near for k in ("1", "2", "None")] == [0.0, 1.0, 0.0]
    assert out["2"].text_print == out["2"].other_print and (out["1"].other_gained, out["None"].other_lost) == (1, 1)
    assert fingerprints.compare_versions(docs.filter("false"), ["text", "other"]).collect() == []
