"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, subtracted and peeled between versions."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.common import NO_ID, shuffle_partitions, stored

TABLES = 3
# Cells of each table of a published sketch; a sketch that can't be peeled is tried again with GROWTH times as many.
CELLS = 8
GROWTH = 4
# A line is cut behind one in so many of its words, chosen by the bytes in front.
CUT_EVERY = 8
# Text that one task puts in order, in bytes.
BLOCK_BYTES = 64 * 2**20
# Text handed on at a time, in characters.
BATCH = 2**22
# Cells of each table that are peeled at a time.
CELLS_AT_ONCE = 2**18
# White space that does not count at the ends of a paragraph.
BLANK = b" \t\n\r\x0b\x0c"


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Well spread 64-bit numbers, others for each seed."""
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def paragraph_digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(digests, edges): distinct 64-bit digests of the paragraphs of each UTF-8 text, the second of equal ones told from
    the first; those of text i are digests[edges[i] : edges[i + 1]].

    A paragraph ends at a line feed, and within a line behind a space that the four bytes before it choose, on average
    behind one word in CUT_EVERY. So a change moves no bounds but its own. Paragraphs of white space alone do not count.
    """
    # Four zero bytes in front of each text, so that the bytes before a space are its own.
    data = b"".join(b"\0\0\0\0" + t for t in texts)
    starts = np.cumsum([0, *(len(t) + 4 for t in texts)])
    codes = np.frombuffer(data, np.uint8)
    spaces = np.flatnonzero((codes == 32) | (codes == 10))
    before = np.zeros(len(spaces), np.uint64)
    for k in range(1, 5):
        before = before << np.uint64(8) | codes[spaces - k].astype(np.uint64)
    ends = spaces[(codes[spaces] == 10) | (_mixed(before, 1) % np.uint64(CUT_EVERY) == 0)] + 1
    edges = np.sort(np.concatenate([ends, starts[:-1] + 4, starts[1:]]))
    row = np.where(np.isin(edges[:-1], starts), -1, np.searchsorted(starts, edges[:-1], "right") - 1).tolist()
    found, rows = [], []
    digest = xxhash.xxh3_64_intdigest
    at = edges.tolist()
    for r, a, b in zip(row, at, at[1:], strict=False):
        paragraph = data[a:b].strip(BLANK)
        if paragraph and r >= 0:  # not the zeros in front of a text
            found.append(digest(paragraph))
            rows.append(r)
    digests, of = np.array(found, np.uint64), np.array(rows, np.int64)
    order = np.lexsort((digests, of))
    digests, of = digests[order], of[order]
    new = np.ones(len(digests), bool)
    new[1:] = (digests[1:] != digests[:-1]) | (of[1:] != of[:-1])
    place = np.arange(len(digests))
    repeat = place - np.maximum.accumulate(np.where(new, place, 0))
    digests = np.where(repeat > 0, _mixed(digests + repeat.astype(np.uint64), 2), digests)
    return digests, np.searchsorted(of, np.arange(len(texts) + 1))


def _check(digests: np.ndarray) -> np.ndarray:
    return (_mixed(digests, 3) >> np.uint64(32)).astype(np.uint32)


class Sketches:
    """Sketches of several sets, of the same size each. Their cells hold the number of the digests that fall into them, and
    the sums modulo 2 of these and of their checks; each digest falls into one cell of every table. What two sets have
    in common vanishes when their sketches are subtracted."""

    def __init__(self, sets: int, cells: int, arrays: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        n = sets * TABLES * cells
        self.sets, self.cells = sets, cells
        self.count, self.key, self.check = arrays or (np.zeros(n, np.int32), np.zeros(n, np.uint64), np.zeros(n, np.uint32))

    @classmethod
    def of(cls, digests: np.ndarray, edges: np.ndarray, cells: int) -> Sketches:
        made = cls(len(edges) - 1, cells)
        made.add(digests, np.repeat(np.arange(made.sets), np.diff(edges)), np.ones(len(digests), np.int32))
        return made

    def places(self, digests: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The cell of each digest in each table of its set; sketches of other sizes use other functions."""
        n = np.uint64(self.cells)
        return np.stack([(row * TABLES + t) * self.cells + (_mixed(digests, 16 * self.cells + t) % n).astype(np.int64) for t in range(TABLES)])

    def add(self, digests: np.ndarray, row: np.ndarray, signs: np.ndarray) -> None:
        checks = _check(digests)
        for places in self.places(digests, row):
            np.add.at(self.count, places, signs)
            np.bitwise_xor.at(self.key, places, digests)
            np.bitwise_xor.at(self.check, places, checks)

    def minus(self, other: Sketches) -> Sketches:
        return Sketches(self.sets, self.cells, (self.count - other.count, self.key ^ other.key, self.check ^ other.check))

    def peeled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, digest, sign, whole) of differences: the digests that only the first (1) or only the second (-1) of two sets
        has, and for each set whether these are all. Cells that hold a single digest are peeled off until there are none;
        where cells stay that hold more, the sketch was too small. This empties the sketches."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        most = len(self.count)
        while most > 0:
            single = np.flatnonzero(np.abs(self.count) == 1)
            single = single[_check(self.key[single]) == self.check[single]]
            row, digests = single // (TABLES * self.cells), self.key[single]
            real = (self.places(digests, row) == single).any(0)
            row, digests, signs = row[real], digests[real], self.count[single[real]]
            if not len(row):
                break
            order = np.lexsort((digests, row))
            row, digests, signs = row[order], digests[order], signs[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (digests[1:] != digests[:-1])
            found.append((row[new], digests[new], signs[new]))
            self.add(digests[new], row[new], -signs[new])
            most -= int(new.sum())
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        whole = ~left.reshape(self.sets, -1).any(1)
        none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32))
        row, digests, signs = (np.concatenate(parts) for parts in zip(*found, strict=True)) if found else none
        return row, digests, signs, whole

    def written(self, sizes: np.ndarray) -> list[str]:
        """Of each set the number of its digests and its cells, as text."""
        columns = [a.astype(t).reshape(self.sets, -1) for a, t in ((self.count, "<i4"), (self.key, "<u8"), (self.check, "<u4"))]
        return [
            base64.b64encode(b"".join([int(n).to_bytes(4, "little"), *(c[i].tobytes() for c in columns)])).decode()
            for i, n in enumerate(sizes)]

    @classmethod
    def read(cls, written: str) -> tuple[int, Sketches]:
        data = base64.b64decode(written)
        n = (len(data) - 4) // 16
        count, key, check = (np.frombuffer(data, t, n, 4 + at * n) for t, at in (("<i4", 0), ("<u8", 4), ("<u4", 12)))
        return int.from_bytes(data[:4], "little"), cls(1, n // TABLES, (count.astype(np.int32), key.astype(np.uint64), check.astype(np.uint32)))


def fingerprints(digests: np.ndarray, edges: np.ndarray, cells: int = CELLS) -> list[str]:
    return Sketches.of(digests, edges, cells).written(np.diff(edges))


def likeness(n: int, m: int, differing: int) -> float:
    """What two sets of n and m elements have in common, as a share of their union; two empty ones are alike."""
    union = (n + m + differing) // 2
    return (union - differing) / union if union else 1.0


def compared(one: str, other: str) -> float | None:
    """The likeness of two published fingerprints; None if more paragraphs differ than their cells can tell."""
    (n, a), (m, b) = Sketches.read(one), Sketches.read(other)
    row, _, _, whole = a.minus(b).peeled()
    return likeness(n, m, len(row)) if whole[0] else None


def _chosen(digests: np.ndarray, edges: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(edges)[rows]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return digests[np.repeat(edges[rows] - upto[:-1], sizes) + np.arange(upto[-1])], upto


def differences(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, digest, sign): of sets given by digests and edges, those that only `one` (1) or only `other` (-1) has.

    Sketches that can't be peeled are made anew with more cells. Sizes that can't hold the difference of the two numbers
    of digests are not tried.
    """
    apart = np.abs(np.diff(one[1]) - np.diff(other[1]))
    left, out = np.arange(len(apart)), []
    while len(left):
        tried = left[TABLES * cells >= apart[left]]
        failed = []
        step = max(1, CELLS_AT_ONCE // cells)
        for at in range(0, len(tried), step):
            rows = tried[at : at + step]
            row, digests, signs, whole = Sketches.of(*_chosen(*one, rows), cells).minus(Sketches.of(*_chosen(*other, rows), cells)).peeled()
            good = whole[row]
            out.append((rows[row[good]], digests[good], signs[good]))
            failed.append(rows[~whole])
        left = np.concatenate([left[TABLES * cells < apart[left]], *failed])
        cells *= GROWTH
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32))
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True)) if out else none


def _keys(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Sixteen bytes for each pair of numbers, which sort as the pairs do."""
    out = np.empty((len(ids), 2), ">u8")
    for k, values in enumerate((ids, hashes)):
        out[:, k] = np.asarray(values, np.int64).view(np.uint64) ^ np.uint64(2**63)
    return out.view("S16").ravel()


def block_starts(docs: DataFrame, block_bytes: int | None = None) -> np.ndarray:
    """The first (id, hash of the text) of each block of documents in this order; a block has about `block_bytes` of text.

    Only ids, hashes and sizes are shuffled. The driver gets 16 bytes for each block.
    """
    spark = docs.sparkSession
    narrow = docs.select("id", "hash", F.octet_length("text").alias("size"))
    ordered = narrow.repartitionByRange(shuffle_partitions(spark), "id", "hash").sortWithinPartitions("id", "hash")
    ordered = stored(ordered.withColumn("part", F.spark_partition_id()))
    if not block_bytes:
        total = ordered.agg(F.sum("size")).first()[0] or 0
        block_bytes = min(BLOCK_BYTES, max(2**20, total // (2 * shuffle_partitions(spark))))
    upto = F.sum("size").over(Window.partitionBy("part").orderBy("id", "hash").rowsBetween(Window.unboundedPreceding, -1))
    blocks = ordered.withColumn("block", F.floor(F.coalesce(upto, F.lit(0)) / block_bytes))
    first = blocks.groupBy("part", "block").agg(F.min(F.struct("id", "hash")).alias("first")).select("first.*").distinct().toPandas()
    return np.sort(_keys(first["id"].to_numpy(), first["hash"].to_numpy()))


def with_next(docs: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """(doc_id, text, next_text): each row with the text of the document behind it, in order of id, then hash of the text;
    behind the last one comes the first.

    A null text is an empty one. Rows that repeat id and text are one document here, each with the same next; null ids
    come last. Every text is shuffled once, to the task that has its block; the first row of a block goes to the block
    before it as well.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    starts = block_starts(rows, block_bytes)
    if not len(starts):
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text.alias("next_text"))

    @F.pandas_udf("block int, leads boolean")
    def placed(ids: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        keys = _keys(ids.to_numpy(), hashes.to_numpy())
        block = np.searchsorted(starts, keys, "right") - 1
        return pd.DataFrame({"block": block.astype(np.int32), "leads": starts[block] == keys})

    here = F.struct(F.col("at.block").alias("block"), F.lit(False).alias("behind"))
    before = F.struct(F.pmod(F.col("at.block") - 1, F.lit(len(starts))).alias("block"), F.lit(True).alias("behind"))
    sent = rows.withColumn("at", placed("id", "hash")).withColumn("to", F.explode(F.when(F.col("at.leads"), F.array(here, before)).otherwise(F.array(here))))
    sent = sent.select("to.block", "to.behind", "id", "hash", "text")
    ordered = sent.repartitionById(len(starts), F.col("block")).sortWithinPartitions("block", "behind", "id", "hash")

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, str, str]] = []
        size = 0
        last, times = None, 0  # the document still without a next one: block, id, text; and how many rows it has
        for batch in batches:
            for block, behind, ident, text in zip(*(batch.column(c) for c in ("block", "behind", "id", "text")), strict=True):
                block, behind, ident = block.as_py(), behind.as_py(), ident.as_py()
                text = text.as_py()
                if behind and (last is None or last[0] != block):
                    continue  # one row behind a block is enough
                if not behind and last == (block, ident, text):
                    times += 1
                    continue
                if last is not None:
                    out += [(last[1], last[2], text)] * times
                    size += (len(last[2]) + len(text)) * times
                last, times = (None, 0) if behind else ((block, ident, text), 1)
                if size > BATCH:
                    n = max(1, len(out) * BATCH // size)  # many repeats of a long text are handed on bit by bit
                    yield from (handed_on(out[i : i + n]) for i in range(0, len(out), n))
                    out, size = [], 0
        if out:
            yield handed_on(out)

    def handed_on(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
        ids, texts, nexts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(nexts, pa.string())], ["doc_id", "text", "next_text"])

    found = ordered.select("block", "behind", "id", "text").mapInArrow(followed, "doc_id long, text string, next_text string")
    return found.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def compare_versions(rows: DataFrame, versions: list[str], cells: int = CELLS) -> DataFrame:
    """The rows with fields for each text column of `versions`, the first of which the others are compared with:
    `<name>_print`, its fingerprint, and of the others also `<name>_near`, the likeness, and `<name>_gained` and
    `<name>_lost`, how many paragraphs only it, or only the first, has.

    The paragraphs that differ are recovered from the difference of two sketches, published size first, then larger ones.
    Null texts are empty ones, which are alike; equal texts have equal fingerprints. Columns with these names are replaced.
    """
    names = [versions[0] + "_print"] + [f"{v}_{what}" for v in versions[1:] for what in ("print", "near", "gained", "lost")]
    kinds = ["string"] + [t for _ in versions[1:] for t in ("string", "double", "long", "long")]
    kept = rows.drop(*names)
    passed = [f.name for f in kept.schema if f.name not in versions]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(pc.fill_null(pc.binary_length(batch.column(v)), 0).to_numpy(zero_copy_only=False) for v in versions)
            part = np.cumsum(sizes) // BATCH
            for a, b in zip(edges := np.flatnonzero(np.diff(part, prepend=-1, append=-1)), edges[1:], strict=False):
                yield compare(batch.slice(a, b - a))

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [paragraph_digests([t or b"" for t in batch.column(v).cast(pa.binary()).to_pylist()]) for v in versions]
        sizes = [np.diff(edges) for _, edges in sets]
        made = [pa.array(fingerprints(*sets[0], cells), pa.string())]
        for other, m in zip(sets[1:], sizes[1:], strict=True):
            row, _, signs = differences(sets[0], other, cells)
            lost, gained = (np.bincount(row[signs == sign], minlength=batch.num_rows) for sign in (1, -1))
            near = [likeness(*v) for v in zip(sizes[0].tolist(), m.tolist(), (lost + gained).tolist(), strict=True)]
            made += [pa.array(fingerprints(*other, cells), pa.string()), pa.array(near, pa.float64()), pa.array(gained, pa.int64()), pa.array(lost, pa.int64())]
        return pa.RecordBatch.from_arrays([*(batch.column(p) for p in passed), *made], [*passed, *names])

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name not in versions)
    made = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))
    return kept.mapInArrow(run, f"{given}, {made}" if given else made)


def edited_versions(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edited, next_text, n_chars): each row with the next document's text and an edited version, in which
    the last n_chars / 2 code points, rounded down, are replaced by the first as many of the next document, or all it has."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    return with_next(docs).select(
        "doc_id", "text", F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"), "next_text", n.cast("long").alias("n_chars"))
