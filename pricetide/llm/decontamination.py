"""Benchmark passages in documents: q-gram counts in diagonal bands, the edit budget's bound, banded alignment."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import kept_in_worker, stored

Q = 8
# Edits allowed per character of a passage.
RATE = 0.1
# Shorter passages are found by their exact parts; grams of so few characters would leave no edit.
SHORT = 2 * Q
# Characters of a text that are searched at a time; of neighbouring parts, so many overlap as the longest region has.
PART = 2**18
# Pairs of a passage's and a text's equal grams that are listed one by one; more are counted by ranges.
LISTED = 2**17
# Passages of one block, in characters: what a task holds at a time. More of them make more blocks.
BLOCK_CHARACTERS = 4_000_000

FOUND = "array<struct<item_id:bigint,start:int,end:int,edits:int>>"


def budget(length: int, q: int = Q, rate: float = RATE) -> int:
    """Edits allowed in a passage: a share of its length, but, in one that is not short, so few that a q-gram is left whole."""
    return int(rate * length) if length < SHORT else min(int(rate * length), (length - q) // q)


def least_shared(length: int, q: int = Q, rate: float = RATE) -> int:
    """q-gram lemma: an edit spoils at most q of a passage's length - q + 1 grams."""
    return length - q + 1 - q * budget(length, q, rate)


def case_table() -> np.ndarray:
    """Of each character of the basic plane the one it counts as: its lower case, and a space for white space."""
    out = np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isspace():
            out[i] = 32
        elif len(c.lower()) == 1:
            out[i] = ord(c.lower())
    return out


def plain(text: str, table: np.ndarray) -> np.ndarray:
    """Code points of the text, one per character, without case."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 1 << 16, table[np.minimum(codes, (1 << 16) - 1)], codes)


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    out = np.zeros(n, np.uint32)
    for i in range(q):
        out *= np.uint32(0x01000193)
        out += codes[i : i + n]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA6B)
    return out


class Passages:
    """A block of passages with the places of their q-grams, sorted by hash, and a bit for each hash that occurs."""

    def __init__(self, items: list[tuple[int, str]]):
        self.case = case_table()
        given = [(i, plain(t, self.case)) for i, t in items]
        self.items = [(i, c) for i, c in given if len(c) >= SHORT]
        found = [grams(c) for _, c in self.items]
        self.edits = np.array([budget(len(c)) for _, c in self.items], np.int64)
        self.least = np.array([least_shared(len(c)) for _, c in self.items], np.int64)
        hashes = np.concatenate(found) if found else np.zeros(0, np.uint32)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.repeat(np.arange(len(found)), [len(g) for g in found])[order] if found else np.zeros(0, np.int64)
        self.place = np.concatenate([np.arange(len(g)) for g in found])[order] if found else np.zeros(0, np.int64)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.hashes >> np.uint32(12)] = True
        self.longest = max((len(c) + budget(len(c)) for _, c in given), default=0)
        self.short = [(i, c) for i, c in given if 0 < len(c) < SHORT]
        self.automaton = self.parts_of_short() if self.short else None

    def parts_of_short(self) -> ahocorasick.Automaton:
        """Finds short passages: one with e edits holds one of e + 1 parts of the passage unedited."""
        named: dict[str, list[tuple[int, int, int]]] = {}
        for k, (_, codes) in enumerate(self.short):
            e = budget(len(codes))
            edges = [len(codes) * i // (e + 1) for i in range(e + 2)]
            for a, b in zip(edges, edges[1:], strict=False):
                named.setdefault(characters(codes[a:b]), []).append((k, a, b))
        automaton = ahocorasick.Automaton()
        for part, where in named.items():
            automaton.add_word(part, where)
        automaton.make_automaton()
        return automaton

    def regions(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, lowest diagonal, number of diagonals) of regions in which the item shares enough of its grams.

        Occurrences with up to e edits spread over e + 1 diagonals. Bands begin every e + 1 diagonals and are twice as
        wide, so one of them holds them all; bands that overlap are one region.
        """
        own = grams(codes)
        at = np.flatnonzero(self.bits[own >> np.uint32(12)])
        if not len(at):
            return []
        kinds = np.sort(own[at])
        kinds = kinds[np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1]))]
        low = np.searchsorted(self.hashes, kinds, "left")
        known = (low < len(self.hashes)) & (self.hashes[np.minimum(low, len(self.hashes) - 1)] == kinds)
        kinds, low = kinds[known], low[known]
        if not len(low):
            return []
        many = np.searchsorted(self.hashes, kinds, "right") - low
        # All grams of an item that the text has anywhere; few items have enough of them.
        ends = np.cumsum(many)
        hit = np.repeat(low - (ends - many), many) + np.arange(ends[-1])
        shared = np.bincount(self.item[hit], minlength=len(self.items))
        alive = (shared >= self.least) & (shared > 0)
        if not alive.any():
            return []
        keep = alive[self.item[hit]]
        order = at[np.argsort(own[at], kind="stable")]
        first = np.searchsorted(own[order], kinds, "left")
        times = np.searchsorted(own[order], kinds, "right") - first
        hit, kind = hit[keep], np.repeat(np.arange(len(low)), many)[keep]
        by_item = np.argsort(self.item[hit], kind="stable")
        hit, kind = hit[by_item], kind[by_item]
        out = []
        for i, a, b in _groups(self.item[hit]):
            out += self._item_regions(i, self.place[hit[a:b]], kind[a:b], order, first, times, len(codes))
        return out

    def _item_regions(self, i: int, place: np.ndarray, kind: np.ndarray, order, first, times, n: int) -> list[tuple[int, int, int]]:
        """Regions of one item; `place`: its gram places that the text shares, `kind`: which of the text's grams each is."""
        length = len(self.items[i][1])
        width = int(self.edits[i]) + 1
        zero = -(-length // width)  # bands are counted from diagonal -zero * width on
        bands = zero + n // width + 2
        # The rarest grams are listed, as many pairs as the item and the text are long.
        many = np.bincount(kind)
        pairs = np.sort(many * times[: len(many)])
        upto = np.searchsorted(np.cumsum(pairs), max(LISTED, 4 * (n + length)), "right")
        listed = (many * times[: len(many)])[kind] <= (pairs[upto - 1] if upto else 0)
        counts = np.zeros(bands, np.int64)
        if listed.any():
            p, k = place[listed], kind[listed]
            m = times[k]
            upto = np.cumsum(m)
            text_at = order[np.repeat(first[k] - (upto - m), m) + np.arange(upto[-1])]
            owner = np.repeat(p, m)
            band = (text_at - owner) // width + zero
            # A gram of the item counts once per band, wherever it is found there.
            each = np.unique(np.concatenate([(band - shift) * length + owner for shift in (0, 1)]))
            counts += np.bincount(np.maximum(each // length, 0), minlength=bands)[:bands]
        starts = (np.arange(bands) - zero) * width  # lowest diagonal of each band, 2 * width of them
        others = np.argsort(kind[~listed], kind="stable")
        for k, a, b in _groups(kind[~listed][others]):
            where = np.zeros(n + 1, np.int32)
            where[order[first[k] : first[k] + times[k]] + 1] = 1
            upto = np.cumsum(where, dtype=np.int32)  # of this gram in the text before a place
            for p in place[~listed][others[a:b]]:
                counts += upto[np.clip(starts + p + 2 * width, 0, n)] > upto[np.clip(starts + p, 0, n)]
        enough = np.flatnonzero(counts >= self.least[i])
        if not len(enough):
            return []
        new = np.flatnonzero(np.diff(enough, prepend=-2) > 1)
        lasts = enough[np.append(new[1:] - 1, len(enough) - 1)]
        return [(i, int(starts[f]), int(starts[g] - starts[f]) + 2 * width) for f, g in zip(enough[new], lasts, strict=True)]

    def hits(self, codes: np.ndarray) -> dict[tuple, list[tuple[int, int, int]]]:
        """(edits, end, start) of occurrences of each item in a part of a text."""
        found: dict[tuple, list[tuple[int, int, int]]] = {}
        for i, diagonal, width in self.regions(codes):
            ident, item = self.items[i]
            e = int(self.edits[i])
            start = max(0, diagonal - e)
            part = codes[start : diagonal + width + len(item) + e]
            # In a region narrower than the item all occurrences overlap, so one without edits is the best.
            exact = whole(item, part) if width + 2 * e < len(item) else None
            hits = [exact] if exact else align(item, part, e, diagonal - start, width)
            found.setdefault((ident, item.tobytes()), []).extend((c, start + b, start + a) for c, b, a in hits)
        if self.automaton is not None:
            for end, where in self.automaton.iter(characters(codes)):
                for k, a, b in where:
                    ident, item = self.short[k]
                    e = budget(len(item))
                    diagonal = end + 1 - b
                    start = max(0, diagonal - e)
                    part = codes[start : diagonal + len(item) + e]
                    found.setdefault((ident, item.tobytes()), []).extend((c, start + y, start + x) for c, y, x in align(item, part, e, diagonal - start, 1))
        return found

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, edits): of every item the text holds, its best occurrences that do not overlap."""
        codes = plain(text, self.case)
        found: dict[tuple, set[tuple[int, int, int]]] = {}
        size = max(PART, 2 * self.longest)
        for at in range(0, max(1, len(codes) - self.longest), size):
            for key, hits in self.hits(codes[at : at + size + self.longest]).items():
                found.setdefault(key, set()).update((c, at + b, at + a) for c, b, a in hits)
        out = set()
        for (ident, _), hits in found.items():
            taken: list[tuple[int, int]] = []
            for edits, end, start in sorted(hits):
                i = bisect_left(taken, (start, end))
                if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or end <= taken[i][0]) and start < end:
                    insort(taken, (start, end))
                    out.add((ident, start, end, edits))
        return sorted(out)


def _groups(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, last + 1) of each run of equal values."""
    edges = np.flatnonzero(np.diff(values, prepend=-1, append=-1))
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(values[a]), int(a), int(b)


def characters(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def whole(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int] | None:
    """(0, end, start) of the first occurrence of `item` in `part` without edits."""
    data, wanted, at = part.tobytes(), item.tobytes(), 0
    while (at := data.find(wanted, at)) >= 0:
        if at % 4 == 0:
            return 0, at // 4 + len(item), at // 4
        at += 1
    return None


def align(item: np.ndarray, part: np.ndarray, e: int, low: int, width: int) -> list[tuple[int, int, int]]:
    """(edits, end, start) of the occurrences of `item` in `part` with e edits at most, one for each end, on the diagonals
    from low - e to low + width + e. One row of the band per character of the item."""
    m, n = len(item), len(part)
    first = low - e
    lanes = width + 2 * e + 1
    far = np.int32(m + n + 1)
    columns = first + np.arange(lanes)  # diagonal of each lane
    inside = (columns >= 0) & (columns <= n)
    cost = np.where(inside, 0, far).astype(np.int32)
    begin = columns.astype(np.int32)
    steps = np.arange(lanes, dtype=np.int32)
    padded = np.concatenate([part, [np.uint32(0xFFFFFFFF)]])
    for i in range(1, m + 1):
        j = columns + i  # characters of the part used, per lane
        valid = (j >= 0) & (j <= n)
        used = valid & (j >= 1)
        straight = np.where(used, cost + (padded[np.where(used, j - 1, 0)] != item[i - 1]), far)
        down = np.concatenate([cost[1:], [far]]) + 1  # a character of the item left out
        down_begin = np.concatenate([begin[1:], [0]])
        take = down < straight
        cost = np.where(take, down, straight)
        begin = np.where(take, down_begin, begin)
        cost = np.where(valid, cost, far)
        # Characters of the part that the item lacks: running minimum along the lanes.
        slope = cost - steps
        best = np.minimum.accumulate(slope)
        source = np.maximum.accumulate(np.where(slope == best, steps, 0))
        better = best + steps < cost
        cost = np.where(better & valid, best + steps, cost).astype(np.int32)
        begin = np.where(better, begin[source], begin)
        if cost.min() > e:
            return []
    at = np.flatnonzero(cost <= e)
    return list(zip(cost[at].tolist(), (columns[at] + m).tolist(), begin[at].tolist(), strict=True))


def passage_blocks(benchmark: DataFrame, block_characters: int | None = None) -> Iterator[list[tuple[int, str]]]:
    """The distinct passages in blocks of bounded size, one after the other: neither the driver nor a task holds more than
    one of them. The documents are searched once per block, so the size of the benchmark takes time and not memory."""
    most = block_characters or BLOCK_CHARACTERS
    rows = benchmark.filter(F.col("item_id").isNotNull() & (F.length("text") > 0)).select("item_id", "text").distinct()
    block, size = [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        if block and size + len(r.text) > most:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block:
        yield block


def _searcher(block: list[tuple[int, str]]):
    name = f"passages {xxhash.xxh3_64_hexdigest(repr(block).encode('utf-8', 'surrogatepass'))}"

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        passages = kept_in_worker(name, lambda: Passages(block))
        for series in texts:
            yield pd.Series([
                [dict(zip(("item_id", "start", "end", "edits"), m, strict=True)) for m in passages.matches(t)] if t else [] for t in series])

    return run


def _unused(docs: DataFrame, name: str) -> str:
    """The name, longer if `docs` has a column of that name."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def with_matches(docs: DataFrame, benchmark: DataFrame, column: str) -> DataFrame:
    """The rows of `docs` with an array of (item_id, start, end, edits), start and end in characters of the text, in place
    of a column of that name.

    A passage of m characters is found if some part of the text, without case and with any white space for a space,
    comes from it by at most min(m / 10, (m - 8) / 8) edits, and by m / 10, if it has fewer than 16 characters. Empty
    passages, and those without id, are not searched. Null and empty texts hold nothing; repeated rows are searched
    each; other columns are passed on. Of a benchmark of several blocks each has a pass, and rows are written in between.
    """
    out = docs.withColumn(column, F.from_json(F.lit("[]"), FOUND))
    for k, block in enumerate(passage_blocks(benchmark)):
        found = F.pandas_udf(_searcher(block), FOUND)(F.col("text"))
        out = out.withColumn(column, found) if k == 0 else stored(out).withColumn(column, F.concat(column, found))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edits) of every passage found."""
    hits = with_matches(docs.select("doc_id", "text"), benchmark, "found").select("doc_id", F.explode("found").alias("m"))
    return hits.select("doc_id", F.col("m.item_id"), F.col("m.start"), F.col("m.end"), F.col("m.edits"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without those that hold a passage."""
    column = _unused(docs, "found")
    return with_matches(docs, benchmark, column).filter(F.size(column) == 0).drop(column)
