"""Cuts of the fill-in-middle form against plain string slices, and the texts rebuilt from it."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricetide.llm import fill_middle
from pricetide.llm.queries import QUERIES

TEXTS = [
    None, "", "a", "é", "😀", "plain words only", "日本語 and ascii é̂ 😀😀 tail", "has a <M> marker", "<P>", "ends in <", "<S", "P><<S><", "x" * 100_000,
    "ü" * 70_000, ("a" * 999 + "😀") * 300, "\x00\n\t", "same", "same"]


def marked(text, a, b, form):
    text = text or ""
    if form not in ("psm", "spm") or not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return form, a, b - a, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab<é日😀"), min_size=1, max_size=6), st.data())
def test_index_of_exceptions(texts, data):
    parts = [t.encode() for t in texts]
    starts = np.cumsum([0, *map(len, parts)])
    index = fill_middle.Exceptions(np.frombuffer(b"".join(parts), np.uint8), starts)
    assert index.lengths().tolist() == list(map(len, texts))
    chars = np.array([data.draw(st.integers(0, len(t))) for t in texts])
    places = index.to_bytes(chars)
    assert places.tolist() == [len(t[:c].encode()) for t, c in zip(texts, chars)]
    assert index.to_chars(places).tolist() == chars.tolist()
    places = np.array([data.draw(st.integers(0, len(p))) for p in parts])
    want = [len(p[:k].decode(errors="ignore")) for p, k in zip(parts, places)]
    assert index.to_chars(places).tolist() == want


@pytest.mark.parametrize("unit", ["chars", "bytes"])
def test_forms_of_odd_texts(spark, frame, unit):
    forms = ["psm", "spm", "plain", None, "other"]
    rows = [(i, t, 7919 * i + k, 104729 * (i + 3), forms[(i + k) % 5], "clash") for i, t in enumerate(TEXTS) for k in range(5)]
    rows += [(None, "no id", None, 3, "psm", None)]
    docs = frame(rows, "doc_id long, text string, first long, second long, form string, output string")
    made = fill_middle.fill_in_middle(docs, (F.col("first"), F.col("second")), F.col("form"), unit)
    out = fill_middle.restore(made).collect()
    want = []
    for ident, text, first, second, form, _ in rows:
        whole = text or ""
        size = len(whole) if unit == "chars" else len(whole.encode())
        a, b = sorted((c or 0) % (size + 1) for c in (first, second))
        if unit == "bytes":
            a, b = (len(whole.encode()[:c].decode(errors="ignore")) for c in (a, b))
        name, p, m, output = marked(text, a, b, form)
        sizes = (None, None) if p is None else (len(whole[:a].encode()), len(whole[a:b].encode()))
        want.append((str(ident), len(whole), name, str(p), str(m), str(sizes[0]), str(sizes[1]), output.encode(), whole.encode()))
    got = [
        (str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), str(r.prefix_bytes), str(r.middle_bytes), bytes(r.output), bytes(r.text))
        for r in out]
    assert sorted(got) == sorted(want)
    empty = fill_middle.fill_in_middle(docs.filter("false"), (F.col("first"), F.col("second")), F.col("form"), unit)
    assert fill_middle.restore(empty).collect() == []


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        text = r.text or ""
        digest = hashlib.sha256(f"1:{r.doc_id}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted(c % (len(text) + 1) for c in h[:2])
        form = "plain" if h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        form, p, m, output = marked(text, a, b, form)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((r.doc_id, len(text), form, p, m, sha(output), sha(text)))
    out = QUERIES["op12_exception_index_middle"](spark, folder).collect()
    assert sorted(map(tuple, out)) == sorted(want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
