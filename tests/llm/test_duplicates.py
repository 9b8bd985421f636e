"""Near-duplicates against all pairs; repeated lines against the SQL of the query."""

import random

import pytest

from pricetide.llm import graph, line_dedup, minhash

SCHEMA = "doc_id long, text string, a string, rep int, component string"


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Smallest id that links reach, from all pairs; rows of one id are one document."""
    names = sorted({r[0] for r in rows}, key=lambda d: (d is None, d))
    top = {n: n for n in names}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    sets = [(r[0], sets_of(r[1])) for r in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                low, high = sorted((find(a), find(b)), key=lambda d: (d is None, d))
                top[high] = low
    return {n: find(n) for n in names}


def check(frame, rows):
    out = minhash.near_duplicates(frame(rows, SCHEMA)).collect()
    want = brute(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles) for r in out) == sorted((r[0] is None, r[0] or 0, len(sets_of(r[1]))) for r in rows)
    for r in out:
        assert r.component_id == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


def test_near_duplicates(frame):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(6, 150))]
        for copy in range(rng.randint(1, 9)):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((1000 * copy + group, " ".join(text), "x", 1, "y"))
    check(frame, rows)


def test_chain_where_first_and_last_are_far_apart(frame):
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([f"n{j}" for j in range(4 * k)] + base[4 * k :]), "", 1, "") for k in range(25)]
    check(frame, rows)


def test_odd_rows(frame):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [
        (1, None, "", 1, ""), (2, "", "", 1, ""), (3, " \t\n", "", None, ""), (4, "one two", None, 1, ""), (5, "ONE  two", "", 1, None), (6, "one two three", "", 1, ""),
        (7, long, "", 1, ""), (8, long + " more", "", 1, ""), (None, long, "", 1, ""), (9, "same id", "", 1, ""), (9, "other words here", "", 1, ""),
        (10, "other words here", "", 1, ""), (4, "one two", None, 1, ""), (11, "é É x", "", 1, ""), (12, "é É x", "", 1, ""),
    ]
    check(frame, rows)
    assert minhash.near_duplicates(frame([], SCHEMA)).collect() == []


def test_large_group_makes_few_pairs(spark, frame):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(400):
        text = list(base)
        text[rng.randrange(300)] = f"n{k}"
        rows.append((k, " ".join(text), "", 1, ""))
    out = minhash.near_duplicates(frame(rows, SCHEMA)).collect()
    assert {r.component_id for r in out} == {0} and sum(r.kept for r in out) == 1


def test_an_id_with_several_texts_keeps_its_pairs(frame):
    """Two texts of id 5 have near copies between the first and the last member of their buckets, its third has none."""
    long = lambda name, edits=0: " ".join([f"{name}e{k}" for k in range(edits)] + [f"{name}{k}" for k in range(edits, 300)])
    texts = [(1, long("s")), (5, long("t")), (5, long("u")), (5, long("x")), (6, long("t", 5)), (7, long("u", 5)), (9, long("v"))]
    docs = frame([(d, t, "", 1, "") for d, t in texts], SCHEMA)
    members = frame([(b, d, 1, 9) for b, copy in ((1, 6), (2, 7)) for d in (1, 5, copy, 9)], "bucket long, rep long, low long, high long")
    sets = frame(sorted({(d, len(minhash.shingle_set(t))) for d, t in texts}), "rep long, n long")
    found = frame([], "node long, component long")
    pairs = minhash._cross_pairs(members, sets, minhash.full_sets(docs, members), found, 85)
    assert {(r.a, r.b) for r in pairs.collect()} >= {(5, 6), (5, 7)}


def test_thresholds_of_the_sequential_test():
    least = minhash.least_matches(0.85)
    assert len(least) == minhash.BANDS * minhash.ROWS // minhash.BATCH and least == sorted(least)
    rng = random.Random(7)
    lost = 0
    for _ in range(2000):
        equal = [rng.random() < 0.85 for _ in range(minhash.BANDS * minhash.ROWS)]
        lost += any(sum(equal[: (k + 1) * minhash.BATCH]) < need for k, need in enumerate(least))
    assert lost == 0


@pytest.mark.parametrize("percent", range(11, 100))
def test_bands_follow_the_threshold(percent):
    bands, rows = minhash.banding(percent / 100)
    assert bands * rows == minhash.VALUES and (1 - (percent / 100) ** rows) ** bands <= minhash.MISS
    assert percent != 85 or (bands, rows) == (minhash.BANDS, minhash.ROWS)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, frame, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        top[high] = low
    want = {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert {r.node: r.component for r in graph.components(frame(edges, "a long, b long")).collect()} == want
    assert graph.components(frame([], "a long, b long")).collect() == []


def plain_lines(rows, least):
    """Deletes lines by looking for every run of lines among all earlier ones."""
    docs = sorted({(d is None, d, t) for d, t in rows if t}, key=lambda x: (x[0], x[1] or 0))
    seen, out = {}, {}
    for none, d, t in docs:
        lines = t.split("\n")
        bare = [(i, x.strip("\t\x0b\f\r ")) for i, x in enumerate(lines)]
        bare = [(i, x) for i, x in bare if x]
        gone = set()
        for a in range(len(bare)):
            for b in range(a, len(bare)):
                run = bare[a : b + 1]
                words = [len(x.split()) for _, x in run]
                if sum(words) >= least:
                    key = tuple(x for _, x in run)
                    if key in seen:
                        gone |= {i for i, _ in run}
                        if min(sum(words[1:]), sum(words[:-1])) < least:  # blank lines go with a shortest run only
                            gone |= set(range(run[0][0], run[-1][0] + 1))
                    else:
                        seen[key] = True
        out[none, d, t] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_lines(spark, frame):
    rng = random.Random(8)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(25)] + ["", "  ", "\tx y"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    rows += [(100, "a b c d e f g h\na b c d e f g h\n\na b c d e f g h"), (101, None), (102, ""), (103, "\n\n")]
    rows += [(None, rows[3][1]), rows[5]]
    docs = frame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, first int, runs string")
    out = line_dedup.dedup_lines(docs, least_words=8, removed="n_removed")
    assert out.columns == ["doc_id", "text", "first", "runs", "n_removed"]
    # Each row's own text decides what it keeps, so look it up by what a row was.
    kept = line_dedup.dedup_lines(docs.withColumn("was", docs["text"]), least_words=8).collect()
    want = plain_lines(rows, 8)
    assert len(kept) == len(rows)
    for r in kept:
        assert r.text == (want[r.doc_id is None, r.doc_id, r.was] if r.was else r.was), r
    assert line_dedup.dedup_lines(docs.filter("false")).collect() == []
