"""Spans against the patterns as they are stated, and reports by ownership."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from pricetide.llm import secrets

SCHEMA = "doc_id long, text string, lang string, source string, found string, kind int"


def plain(text):
    """Base spans by the stated patterns: find, then drop what fails."""
    keyword = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    out = [(m.start(), 0, m.end()) for m in re.finditer(keyword + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans():
    rng = random.Random(2)
    parts = ["password", "PassWd", "token", "apikey", "API_key", "secret", ":", "=", " ", '"', "abc", "abcdef", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "é", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [(s, k, e) for k, s, e, _ in secrets.candidates(text) if k < 3] == plain(text), text


def test_ownership(spark, frame):
    common, own = "Zx81Qw7Lp0Rt5Yn3Vb6K", "Mn4Bv9Cx2Zq8Wl1Ke7Ju"
    rows = [(i, f"see {common} there", "en", f"s{i % 4}", "f", 1) for i in range(12)]
    rows += [(20 + i, f"{own} é token = {own}", "en", "s1", None, None) for i in range(2)]
    rows += [(30, None, None, None, None, 1), (31, "", "en", "s1", "", 1), (None, "AKIA" + "A" * 16, None, None, "x", 1)]
    rows += [rows[12]]
    out = secrets.find_secrets(frame(rows, SCHEMA), F.col("source"), F.col("lang")).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert all(not r.every and r.n_copied == 1 and r.n_live == 0 for i in range(12) for r in by[i])
    assert len(by[20]) == 2 and [(c.kind, c.start) for c in by[20][0].every] == [(3, 0), (0, 23)]
    assert not by[30][0].every and not by[31][0].every and by[None][0].base[0].kind == 1


def test_repositories_and_owners_decide_together(frame):
    """Many repositories of one owner keep a value live, and so do two owners with one each; six between two do not."""
    values = {"mirrored": "Aa11Bb22Cc33Dd44Ee55", "shared": "Ff66Gg77Hh88Ii99Jj00", "copied": "Kk12Ll34Mm56Nn78Oo90", "famous": "Pp09Qq87Rr65Ss43Tt21"}
    held = {
        "mirrored": [("a", f"r{i}") for i in range(20)], "shared": [("a", "r1"), ("b", "r1")],
        "copied": [("a", f"r{i}") for i in range(5)] + [("b", "r9")], "famous": [("a", "r1"), ("b", "r1"), ("c", "r1")]}
    rows = [(i, f"key {values[name]} end", repository, owner, name, 0) for name in held for i, (owner, repository) in enumerate(held[name])]
    docs = frame(rows, SCHEMA)
    out = secrets.find_secrets(docs.withColumn("doc_id", F.hash("found").cast("long")), F.col("source"), F.concat_ws("/", "source", "lang"))
    names = {r.id: r.found for r in docs.select(F.hash("found").cast("long").alias("id"), "found").distinct().collect()}
    live = {(names[r.doc_id], r.n_live) for r in out.collect()}
    assert live == {("mirrored", 1), ("shared", 1), ("copied", 0), ("famous", 0)}


def test_query_digest(spark, frame, tmp_path):
    from pricetide.llm.queries import QUERIES

    text = "x secret: hunter22 y " + "0a" * 12
    frame([(1, text, "en", "s", "", 0), (2, None, "en", "s", "", 0)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in QUERIES["op3_secret_ownership"](spark, str(tmp_path)).collect()}
    spans = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in plain(text))
    assert spans == "assign:2:18,hex:21:45" and out[1].spans == spans
    assert out[1].base_sha256 == hashlib.sha256(spans.encode()).hexdigest() and out[2].base_sha256 == hashlib.sha256(b"").hexdigest()
