"""Packing token sequences: linear grouping of large lengths, few-size configurations, best fit for the small ones."""

from __future__ import annotations

import base64
import os
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricetide.llm.common import kept_in_worker, stored, with_slots

# Fixed values of the packed form.
SEQUENCE = 2048
END_ID = 0


class Encoder:
    """Token ids of texts. `tokenizer` is a file of the tokenizers library, `ranks` the same vocabulary as ranks, which
    another library reads several times as fast; texts that name a special token go to the first."""

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.exact = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})

    def ids(self, text: str) -> array:
        if any(token in text for token in self.special):
            return array("I", self.exact.encode(text, add_special_tokens=False).ids)
        return array("I", self.fast.encode_ordinary(text))


def pieces(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, most: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every row: its token ids and the end id, cut where they are more than
    `most`: into pieces of `most` ids, of which the first may be shorter. `ids`: unsigned 32-bit little-endian numbers.

    A null text is empty, and an empty text is one piece that holds the end id. Repeated rows give repeated pieces.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = kept_in_worker(f"encoder {tokenizer}", lambda: Encoder(tokenizer, ranks, pattern))
        for pdf in batches:
            rows = []
            for ident, text in zip(pdf.doc_id, pdf.text, strict=True):
                ids = np.append(np.frombuffer(encoder.ids(text), np.uint32), np.uint32(END_ID)).astype("<u4")
                head = len(ids) % most or most
                edges = [0, *range(head, len(ids) + 1, most)] if len(ids) > most else [0, len(ids)]
                rows += [(ident, k, a, b - a, ids[a:b].tobytes()) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    made = rows.mapInPandas(run, "doc_id string, piece int, start long, length long, ids binary")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def configurations(counts: list[int], sizes: list[int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how often, how many of each size) covering `counts` of a few sizes (descending): again and again the fullest
    configuration that what is left allows, found by dynamic programming over the capacity, as often as it can be used."""
    left, out = list(counts), []
    while any(left):
        best: list[tuple[int, ...] | None] = [None] * (capacity + 1)
        best[0] = (0,) * len(sizes)
        for k, size in enumerate(sizes):
            if not left[k]:
                continue
            for room in range(size, capacity + 1):
                before = best[room - size]
                if best[room] is None and before is not None and before[k] < left[k]:
                    best[room] = (*before[:k], before[k] + 1, *before[k + 1 :])
        chosen = next(b for b in reversed(best) if b is not None)
        times = min(n // c for n, c in zip(left, chosen, strict=True) if c)
        out.append((times, chosen))
        left = [n - times * c for n, c in zip(left, chosen, strict=True)]
    return out


def plan(counts: dict[int, int], capacity: int = SEQUENCE, groups: int = 128, small_below: int = SEQUENCE // 3) -> list[tuple[int, tuple[int, ...]]]:
    """Runs (how many sequences, lengths in each) that hold `counts` pieces of each length.

    Linear grouping: the large lengths, descending, are dealt into `groups` groups of equally many pieces, and each is
    taken for the largest of its group. Configurations of these few sizes are chosen for all pieces; then the actual
    pieces take the places of their group, longest first. That leaves gaps of known size; small pieces go into the
    smallest gap that holds them, longest first, and open sequences of their own when there is none.

    Everything goes by run lengths: at most `capacity` different lengths are seen however many pieces there are.
    """
    large = sorted((length for length in counts if length >= small_below), reverse=True)
    total = sum(counts[length] for length in large)
    sizes, members = [], []  # of each group: its size, and [length, count] of its pieces, longest first
    per = max(1, -(-total // groups))
    room = 0
    for length in large:
        n = counts[length]
        while n:
            if not room:
                sizes.append(length)
                members.append([])
                room = per
            take = min(n, room)
            members[-1].append([length, take])
            n -= take
            room -= take
    merged: dict[int, list] = {}
    for size, own in zip(sizes, members, strict=True):
        merged.setdefault(size, []).extend(own)
    sizes, members = list(merged), list(merged.values())
    filled: list[tuple[int, tuple[int, ...]]] = []
    for times, chosen in configurations([sum(n for _, n in own) for own in members], sizes, capacity):
        left = times
        while left:
            # As many alike sequences as the next lengths of each group last.
            slots, alike = [], left
            for k, c in enumerate(chosen):
                if c:
                    if members[k][0][1] >= c:
                        alike = min(alike, members[k][0][1] // c)
                    else:
                        alike = 1
                    slots.append((k, c))
            lengths = []
            for k, c in slots:
                need = c * alike
                while need:
                    head = members[k][0]
                    take = min(head[1], need)
                    lengths += [head[0]] * (take // alike if alike > 1 else take)
                    head[1] -= take
                    need -= take
                    if not head[1]:
                        members[k].pop(0)
            filled.append((alike, tuple(lengths)))
            left -= alike
    return _best_fit(filled, {k: n for k, n in counts.items() if k < small_below}, capacity)


def _best_fit(filled, small: dict[int, int], capacity: int):
    gaps: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    known: list[int] = []

    def put(count: int, lengths: tuple[int, ...], gap: int) -> None:
        if count:
            if gap not in gaps:
                gaps[gap] = []
                insort(known, gap)
            gaps[gap].append((count, lengths))

    for count, lengths in filled:
        put(count, lengths, capacity - sum(lengths))
    for length in sorted(small, reverse=True):
        n = small[length]
        while n:
            at = bisect_left(known, length)
            if at == len(known):
                fit = capacity // length
                put(n // fit, (length,) * fit, capacity - fit * length)
                put(1 if n % fit else 0, (length,) * (n % fit), capacity - (n % fit) * length)
                break
            gap = known[at]
            count, lengths = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                known.pop(at)
            fit = gap // length
            full = min(count, n // fit)
            put(full, lengths + (length,) * fit, gap - fit * length)
            n -= full * fit
            count -= full
            if count and n:  # the last pieces of this length, in one sequence
                put(1, lengths + (length,) * n, gap - n * length)
                count, n = count - 1, 0
            put(count, lengths, gap)
    return [run for runs in gaps.values() for run in runs]


def best_plan(counts: dict[int, int], capacity: int = SEQUENCE):
    """The plan with the fewest sequences among several bounds between small and large."""
    bounds = [capacity * k // 8 for k in (1, 2, 3, 4, 5)]
    return min((plan(counts, capacity, small_below=max(1, b)) for b in bounds), key=lambda runs: sum(n for n, _ in runs))


def places(runs: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """One row per (run, length in it): rank of its first piece among those of the length, how many there are in each
    sequence and in all, first sequence, and offset of the first in the sequence. Sorted by (length, rank)."""
    rows, taken, first = [], {}, 0
    for count, lengths in runs:
        offset = 0
        for length in dict.fromkeys(lengths):
            each = lengths.count(length)
            rows.append((length, taken.get(length, 0), each, first, offset))
            taken[length] = taken.get(length, 0) + each * count
            offset += each * length
        first += count
    rows.sort()
    names = ("length", "rank", "each", "first", "offset")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def pack(rows: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """`rows` (doc_id, piece, length, ...) with sequence_id and offset: sequences of at most `most`, filled from 0
    without gaps, as few as the plan finds. Empty tables stay empty.

    The driver sees one count per length, of which there are at most `most`, and makes a plan whose size follows the
    number of lengths, not of pieces. Pieces of a length are numbered by a distributed sort and find their place in
    the plan by that number.
    """
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranked = with_slots(rows, "length", ["doc_id", "piece"], "__rank")
    at = places(best_plan(counts, most))
    key = at["length"] * 2**44 + at["rank"]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length, rank = pdf.length.to_numpy(np.int64), pdf["__rank"].to_numpy(np.int64)
            i = np.searchsorted(key, length * 2**44 + rank, side="right") - 1
            copy, within = np.divmod(rank - at["rank"][i], at["each"][i])
            yield pdf.drop(columns="__rank").assign(sequence_id=at["first"][i] + copy, offset=at["offset"][i] + within * length)

    plain = ranked.select(*[F.col(f.name).cast("string") if f.name == "doc_id" else F.col(f.name) for f in rows.schema.fields], "__rank")
    made = plain.mapInPandas(run, columns.replace("`doc_id` bigint", "`doc_id` string") + ", sequence_id long, offset long")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def packed_documents(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, most: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    made = pieces(docs, tokenizer, ranks, pattern, most)
    return pack(stored(made.withColumn("ids_crc32", F.crc32("ids")).drop("ids")), most)
