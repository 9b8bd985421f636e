"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian verification, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import NO_ID, kept_in_worker, stored
from pricetide.llm.graph import components

WORDS = 5
BANDS, ROWS = 24, 5
# Values of a signature; other thresholds cut the same values into other bands.
VALUES = BANDS * ROWS
BATCH = 20
MISS = 1e-6
SEED = 20
# Parts that shingle sets are dealt into to count differences.
PARTS = 128
CACHED_WORDS = 50_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = kept_in_worker("minhash words", dict)
    if len(known) > CACHED_WORDS:
        known.clear()
    out = list(map(known.get, words))
    if None in out:
        for i, h in enumerate(out):
            if h is None:
                h = out[i] = known.get(words[i])
                if h is None:
                    out[i] = known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    return np.array(out, np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words; of all words, if there are fewer; of nothing, none.

    A-Z count as a-z; words are separated by space and the characters 9 to 13.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = min(WORDS, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mixed(out + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = lambda: rng.integers(0, 2**63, VALUES, dtype=np.uint64)
    return draw() * np.uint64(2) + np.uint64(1), draw()


def signature(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest value of each hash function over the set, 32 bits of it."""
    factors, offsets = functions
    out = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(shingles), 2048):  # a part that stays in the cache
        part = shingles[at : at + 2048]
        for i in range(len(factors)):
            low = ((part * factors[i] + offsets[i]) >> np.uint64(32)).min()
            if low < out[i]:
                out[i] = low
    return out


def banding(similarity: float, miss: float = MISS) -> tuple[int, int]:
    """(bands, values in each): the longest bands in which a pair of this similarity agrees nowhere with a chance of
    `miss` at most; bands of one value where none are, below a similarity of 0.11."""
    cuts = [(VALUES // rows, rows) for rows in range(VALUES, 0, -1) if VALUES % rows == 0]
    return next((c for c in cuts if (1 - similarity ** c[1]) ** c[0] <= miss), cuts[-1])


def least_matches(similarity: float, miss: float = MISS) -> list[int]:
    """Least number of equal values after each batch below which a pair is dropped.

    With a uniform prior, m equal of n values give the similarity a Beta(m + 1, n - m + 1) posterior. A pair goes as
    soon as that gives less than `miss` to similarities of at least `similarity`.
    """
    grid = np.linspace(1e-6, 1 - 1e-6, 4001)
    above = grid >= similarity
    out = []
    for n in range(BATCH, VALUES + 1, BATCH):
        least = n
        for m in range(n, -1, -1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid) + lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1)
            density = np.exp(log)
            if density[above].sum() / density.sum() < miss:
                break
            least = m
        out.append(least)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, signature) per row; h1 and h2 identify the set, 0 of both is the empty one."""
    functions = _functions()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf.text:
                s = shingle_set(text)
                data = s.tobytes()
                pair = (np.array([xxhash.xxh3_64_intdigest(data, k) for k in (1, 2)], np.uint64).view(np.int64) if len(s) else (0, 0))
                rows.append((len(s), int(pair[0]), int(pair[1]), signature(s, functions).tobytes() if len(s) else b""))
            out = pd.DataFrame(rows, columns=["n_shingles", "h1", "h2", "signature"], index=pdf.index)
            yield pd.concat([pdf[["doc_id"]], out], axis=1)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id long, n_shingles long, h1 long, h2 long, signature binary")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs (a, b) of class representatives that pass the sequential test on their signatures."""
    least = least_matches(similarity)
    full = pairs.join(sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa")), "a").join(
        sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb")), "b")
    full = full.filter(F.least("na", "nb") >= F.greatest("na", "nb") * (similarity - 1e-9)).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            left = np.frombuffer(b"".join(pdf.sa), np.uint32).reshape(len(pdf), -1)
            right = np.frombuffer(b"".join(pdf.sb), np.uint32).reshape(len(pdf), -1)
            alive, equal = np.arange(len(pdf)), np.zeros(len(pdf), int)
            for k, need in enumerate(least):
                batch = slice(k * BATCH, (k + 1) * BATCH)
                equal[alive] += (left[alive, batch] == right[alive, batch]).sum(1)
                alive = alive[equal[alive] >= need]
            yield pdf.iloc[alive][["a", "b"]]

    return full.mapInPandas(run, "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles, parts): the whole shingle sets of the documents named in `ids` (rep), and a sum over each of
    PARTS parts that shingles fall into by hash."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    rows = rows.join(ids.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingle_set(t) for t in pdf.text]
            parts = [np.bincount((s % np.uint64(PARTS)).astype(int), (s >> np.uint64(40)).astype(float), PARTS).astype(np.int64) for s in sets]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "shingles": [s.tobytes() for s in sets], "parts": parts})

    return rows.mapInPandas(shingled, "doc_id long, shingles binary, parts array<bigint>")


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs whose full shingle sets reach the similarity."""
    both = pairs.join(full.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").join(
        full.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for sa, sb in zip(pdf.sa, pdf.sb, strict=True):
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pdf.loc[keep, ["a", "b"]]

    return both.mapInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of `docs`.

    Documents are linked if their sets of 5-word shingles have at least `percent` of their union in common;
    component_id is the smallest doc_id that links reach. Documents without words are linked with nothing. Repeated
    rows are one document, rows that repeat an id with other texts are one as well, with the links of all its texts.
    A null id sorts behind all others and comes out as null, linked as any other. Other columns are not read.

    Documents of one set are one class, and classes go by their smallest id. A pair is a candidate if it agrees in one
    band of values: 24 bands of 5 at 85 percent, 30 of 4 at 80 (`banding`), so that a pair at the threshold is missed
    once in a million at most, and less above it. In a bucket nobody is paired with everybody: its first member is tested against the others, then its last; members that
    are then still outside the component of the first are paired with those of the rest that a bound leaves
    (`_cross_pairs`). A pair inside a component needs no test, so no link that matters is lost.
    """
    n_bands, n_rows = banding(percent / 100)
    base = stored(signatures(docs))
    rows = base.filter("n_shingles > 0")
    sets = stored(rows.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")))
    # Copies: each row is linked with the representative of its class. Classes of one row need no edge.
    edges = rows.join(sets.select("h1", "h2", "rep"), ["h1", "h2"]).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    edges = stored(edges.distinct())
    bands = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.substring(F.col("signature"), i * (4 * n_rows) + 1, F.lit(4 * n_rows))))
    members = sets.select("rep", bands.alias("band", "values")).select(F.xxhash64("band", "values").alias("bucket"), "rep").distinct()
    groups = members.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high")
    members = stored(members.join(groups, "bucket"))
    full = stored(full_sets(docs, members))
    found = stored(components(edges))
    for hub in ("low", "high"):
        pairs = _apart(members.filter(F.col("rep") != F.col(hub)), hub, found)
        found = _joined(found, _links(pairs.select(F.least("rep", hub).alias("a"), F.greatest("rep", hub).alias("b")), sets, full, percent))
    found = _joined(found, _links(_cross_pairs(members, sets, full, found, percent), sets, full, percent))
    out = base.select("doc_id", "n_shingles").join(found, base["doc_id"] == found["node"], "left")
    component = F.coalesce("component", "doc_id")
    shown = lambda c: F.when(c != NO_ID, c)
    return out.select(
        shown(F.col("doc_id")).alias("doc_id"), "n_shingles", shown(component).alias("component_id"),
        (F.col("doc_id") == component).alias("kept"))


def _cross_pairs(members: DataFrame, sets: DataFrame, full: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket and of different components that may still be links.

    Members outside the component of their bucket's first one meet everybody there who is in another component, but
    for those whom a bound rules out. Let own(x) be the number of shingles that x shares with no one in these buckets.
    Then x and y have o = min(n(x) - own(x), n(y) - own(y)) shingles in common at most, and their similarity is at most
    o / (n(x) + n(y) - o). In a large group of copies with many edits each, the own shingles are the edits, and most
    members fall to the smallest size in the bucket, before any pair is made.

    Second, a link leaves room for d = (n(x) + n(y)) (100 - percent) / (100 + percent) shingles that only one of the two
    has. Each spoils one part of the hashed parts of a set, so at least PARTS - d parts must have equal sums.
    """
    placed = members.select("bucket", "rep", "low").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    home = found.select(F.col("node").alias("low"), F.col("component").alias("home"))
    placed = placed.join(home, "low", "left").withColumn("home", F.coalesce("home", "low"))
    placed = stored(placed.join(sets.select("rep", "n"), "rep").distinct())
    open_buckets = stored(placed.groupBy("bucket").agg(
        F.max(F.col("component") != F.col("home")).alias("open"), F.min("n").alias("least")).filter("open").drop("open"))
    placed = stored(placed.join(open_buckets, "bucket"))
    shingles = full.join(placed.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")

    def one_by_one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ident, data in zip(pdf.doc_id, pdf.shingles, strict=True):
                yield pd.DataFrame({"rep": ident, "shingle": np.frombuffer(data, np.int64)})

    single = shingles.mapInPandas(one_by_one, "rep long, shingle long").groupBy("shingle").agg(
        F.min("rep").alias("rep"), F.max("rep").alias("last")).filter("rep = last")
    own = stored(single.groupBy("rep").agg(F.count("*").alias("own")))
    buckets = placed.groupBy("rep").agg(F.collect_list("bucket").alias("buckets"))  # at most one per band
    parts = full.groupBy(F.col("doc_id").alias("rep")).agg(F.first("parts").alias("parts"), F.count("*").alias("texts"))
    # An id with several texts is judged neither by the parts of one of them nor by the own shingles of all.
    parts = parts.select("rep", "texts", F.when(F.col("texts") == 1, F.col("parts")).alias("parts"))
    placed = placed.join(own, "rep", "left").join(buckets, "rep").join(parts, "rep")
    placed = placed.withColumn("shared", F.col("n") - F.when(F.col("texts") == 1, F.coalesce("own", F.lit(0))).otherwise(0))

    def may_reach(common, n, other):
        return 100 * common >= percent * (n + other - common)

    placed = placed.withColumn("odd", F.col("component") != F.col("home")).filter(
        ~F.col("odd") | may_reach(F.col("shared"), F.col("n"), F.greatest("least", "shared")))
    placed = stored(placed.select("bucket", "rep", "component", "n", "shared", "odd", "buckets", "parts"))
    odd = placed.filter("odd").select(
        "bucket", F.col("rep").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("shared").alias("sx"),
        F.col("buckets").alias("bx"), F.col("parts").alias("px"))
    spoilt = F.floor((F.col("nx") + F.col("n")) * (100 - percent) / (100 + percent))
    equal = F.aggregate(F.zip_with("px", "parts", lambda p, q: (p == q).cast("int")), F.lit(0), lambda a, e: a + e)
    # A pair that shares several buckets is made in one of them.
    both = odd.join(placed, "bucket").filter(
        (F.col("cx") != F.col("component")) & (~F.col("odd") | (F.col("x") < F.col("rep")))
        & may_reach(F.least("sx", "shared"), F.col("nx"), F.col("n"))
        & (F.array_min(F.array_intersect("bx", "buckets")) == F.col("bucket"))
        & ((spoilt >= PARTS) | (F.coalesce(equal, F.lit(PARTS)) >= PARTS - spoilt)))
    return both.select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b"))


def _apart(pairs: DataFrame, hub: str, found: DataFrame) -> DataFrame:
    """Pairs whose two members are in different components so far."""
    for side in ("rep", hub):
        named = found.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
        pairs = pairs.join(named, side, "left").withColumn(f"c_{side}", F.coalesce(f"c_{side}", side))
    return pairs.filter(F.col("c_rep") != F.col(f"c_{hub}"))


def _links(pairs: DataFrame, sets: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The links among candidate pairs."""
    return stored(_confirmed(stored(_verified(pairs.distinct(), sets, percent / 100)), full, percent))


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) with links added: only the components that a link joins are looked at again."""
    ends = links
    for side in ("a", "b"):
        named = found.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
        ends = ends.join(named, side, "left").withColumn(f"c_{side}", F.coalesce(f"c_{side}", side))
    tops = stored(components(ends.select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))))
    moved = found.join(tops.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    fresh = tops.join(found, "node", "left_anti")
    return stored(moved.select("node", F.coalesce("top", "component").alias("component")).unionByName(fresh.select("node", "component")))
