"""Token alignment between two tokenizers: groups of tokens that end at the same bytes, and the id pairs they link."""

from __future__ import annotations

import base64
import hashlib
import json
import os
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricetide.llm.common import kept_in_worker, stored

# Links of one part, at most about so many different ones per text added up: rows of a part are later scored together.
PART_LINKS = 2**20
# Text that is aligned at a time, in characters, and the links made at a time from it.
SLICE = 2**21
LINKS_AT_ONCE = 2**21
# Groups with more links than this are counted by their distinct ids.
LARGE_GROUP = 4096
# Longer texts are given to the second tokenizer in runs of about so many characters.
LONG = 2**20
# Ids of the second tokenizer take the low bits of a pair.
SHIFT = 32
# What follows an id in the written form of the groups.
SEPARATORS = (b",", b"|", b";")

ROWS = (
    "part string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at array<int>, times array<bigint>, "
    "pairs array<bigint>, docs array<bigint>")
ROW_TYPES = [
    ("part", pa.string()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())), ("pairs", pa.list_(pa.int64())),
    ("docs", pa.list_(pa.int64()))]
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones for themselves, the rest in order from 256."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers with the bytes of each of their ids."""

    def __init__(self, tokenizer: str, ranks: str, pattern: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        exact = Tokenizer.from_file(tokenizer)
        entries = json.loads(exact.to_str())["model"]["vocab"]
        known = byte_characters()
        added = {t.content for t in exact.get_added_tokens_decoder().values()}
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = entry.encode() if entry in added else bytes(known[c] for c in entry)
        # The same vocabulary as ranks, which another library reads several times as fast; no string is special there.
        with open(ranks, "rb") as lines:
            ranked = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.first = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranked, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.b_bytes = []
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_sizes = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_sizes = np.array(list(map(len, self.b_bytes)), np.int64)
        self.ids = max(len(self.a_bytes), len(self.b_bytes))
        self.written = [str(i).encode() + mark for mark in SEPARATORS for i in range(self.ids)]
        # If no piece has a space behind something else, no merge crosses the start of a word.
        pieces = (self.second.id_to_piece(i) for i in range(self.second.get_piece_size()) if not self.second.is_control(i))
        self.apart = not any("▁" in piece.lstrip("▁") for piece in pieces)

    def second_ids(self, text: str) -> list[int]:
        """Ids of the second tokenizer. It holds much more than a text while it reads one, so long ones are cut at spaces
        between words, each of which it puts back in front of the run behind it."""
        if len(text) <= LONG or not self.apart:
            return self.second.encode(text, num_threads=1)
        out, start = [], 0
        while start < len(text):
            space = text.find(" ", start + LONG)
            while space > 0 and text[space - 1].isspace():
                space = text.find(" ", space + 1)
            stop = space if space > 0 else len(text)
            out += self.second.encode(text[start:stop], num_threads=1)
            start = stop + 1 if space > 0 else stop
        return out

    def encoded(self, texts: list[str | None]) -> tuple[list[array], list[array]]:
        """Ids of both for each text; none where there is no text or either does not give the text back.

        Where no space has white space next to it, the second tokenizer reads word by word, and each word of these texts
        once. The first one cuts bytes, so that it can be checked by their number.
        """
        split = [t.split(" ") if t and self.apart else [""] for t in texts]
        names = list(dict.fromkeys(chain.from_iterable(split)))
        words: dict[str, list[int] | None] = dict(zip(names, self.second.encode(names, num_threads=1), strict=True))
        odd = {w for w in names if not w or w[0].isspace() or w[-1].isspace()}
        changed = {w for w, ids in words.items() if b"".join(map(self.b_bytes.__getitem__, ids)) != (" " + w).encode("utf-8", "surrogatepass")}
        first, second = [], []
        for text, each in zip(texts, split, strict=True):
            a, b = array("i", self.first.encode_ordinary(" " + text) if text else ()), array("i")
            if text and odd.isdisjoint(each):
                if changed.isdisjoint(each):
                    b = array("i", chain.from_iterable(map(words.__getitem__, each)))
            elif text:
                b = array("i", self.second_ids(text))
                if b"".join(map(self.b_bytes.__getitem__, b)) != (" " + text).encode("utf-8", "surrogatepass"):
                    b = array("i")
            if not b or self.a_sizes[a].sum() != self.b_sizes[b].sum():
                a, b = array("i"), array("i")
            first.append(a)
            second.append(b)
        return first, second


def _lists(values: list[array]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(values), np.int32))


def _ends(ids: pa.ListArray, sizes: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Of the tokens of all lists: their ids, the list each is from, and the byte they end at, counted over all lists."""
    flat = pc.list_flatten(ids)
    return flat, pc.list_parent_indices(ids), pc.cumulative_sum(pa.array(sizes).take(flat)).to_numpy()


class Aligned:
    """Texts aligned: tokens of both sides one after another over all texts, and the edges of their groups.

    Both sides of a text have the same bytes, so an end counted over all texts names a document and an offset in it;
    a hash join on these keys finds the ends that both sides have, the last of each text among them.
    """

    def __init__(self, pair: Pair, texts: list[str | None]):
        a_lists, b_lists = map(_lists, pair.encoded(texts))
        a, a_doc, a_end = _ends(a_lists, pair.a_sizes)
        b, _, b_end = _ends(b_lists, pair.b_sizes)
        left = pa.table({"end": a_end, "a_at": np.arange(len(a))})
        right = pa.table({"end": b_end, "b_at": np.arange(len(b))})
        common = left.join(right, "end", join_type="inner", use_threads=False).sort_by("a_at")
        self.a, self.b = a.to_numpy(), b.to_numpy()
        self.a_edges = np.concatenate([[0], common["a_at"].to_numpy() + 1])
        self.b_edges = np.concatenate([[0], common["b_at"].to_numpy() + 1])
        self.na, self.nb = np.diff(self.a_edges), np.diff(self.b_edges)
        self.doc = a_doc.to_numpy()[self.a_edges[1:] - 1]
        self.pair, self.n_docs = pair, len(texts)
        self.n_a = pc.list_value_length(a_lists).to_numpy()
        self.n_b = pc.list_value_length(b_lists).to_numpy()

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Values of groups, added up for each text."""
        upto = np.concatenate([[0], np.cumsum(values)])
        edges = np.searchsorted(self.doc, np.arange(self.n_docs + 1))
        return upto[edges[1:]] - upto[edges[:-1]]

    def digests(self) -> list[str]:
        """Of each text the SHA-256 of its groups as `a1,a2|b1;a3|b2,b3`; nothing of a text without tokens."""
        group_a, group_b = np.repeat(np.arange(len(self.na)), self.na), np.repeat(np.arange(len(self.nb)), self.nb)
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + self.b_edges[group_a]] = self.a
        order[np.arange(len(self.b)) + self.a_edges[group_b + 1]] = self.b
        order[self.a_edges[1:] - 1 + self.b_edges[:-1]] += self.pair.ids  # the last of the first side
        order[self.a_edges[1:] + self.b_edges[1:] - 1] += 2 * self.pair.ids  # the last of a group
        upto = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        out = []
        for i, j in zip(upto, upto[1:], strict=False):
            written = b"".join(map(self.pair.written.__getitem__, order[i:j].tolist()))
            out.append(hashlib.sha256(written[:-1]).hexdigest() if written else "")
        return out

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, pair, times) in runs: the id pairs of each group; one entry per occurrence, or with their number."""
        many = self.na * self.nb
        for g in np.flatnonzero(many > LARGE_GROUP):
            x, nx = np.unique(self.a[self.a_edges[g] : self.a_edges[g + 1]], return_counts=True)
            y, ny = np.unique(self.b[self.b_edges[g] : self.b_edges[g + 1]], return_counts=True)
            step = max(1, LINKS_AT_ONCE // len(y))
            for i in range(0, len(x), step):
                pairs = (x[i : i + step, None].astype(np.int64) << SHIFT) | y
                yield np.full(pairs.size, self.doc[g]), pairs.ravel(), (nx[i : i + step, None] * ny).ravel()
        small = np.flatnonzero(many <= LARGE_GROUP)
        upto = np.cumsum(many[small])
        at = 0
        while at < len(small):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LINKS_AT_ONCE, "right")))
            g = small[at:stop]
            n, nb = many[g], self.nb[g]
            of = np.repeat(np.arange(len(g)), n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a = self.a[self.a_edges[g][of] + inner // nb[of]].astype(np.int64)
            b = self.b[self.b_edges[g][of] + inner % nb[of]]
            yield self.doc[g][of], (a << SHIFT) | b, np.ones(len(of), np.int64)
            at = stop

    def distinct_links(self) -> pa.Table:
        """(doc, pair, times): the id pairs of each text with how often they are linked in it."""
        parts = [
            pa.table({"doc": doc, "pair": pair, "times": times}).group_by(["doc", "pair"]).aggregate([("times", "sum")])
            for doc, pair, times in self.links()]
        none = pa.table({"doc": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()), "times_sum": pa.array([], pa.int64())})
        found = pa.concat_tables(parts or [none])
        if len(parts) > 1:  # a text may lie in several runs
            found = found.rename_columns(["doc", "pair", "times"]).group_by(["doc", "pair"]).aggregate([("times", "sum")])
        return found.select(["doc", "pair", "times_sum"]).rename_columns(["doc", "pair", "times"])


class Part:
    """Texts whose links are kept together: a sorted list of their id pairs, and of each text its places in that list."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.doc_ids: list[int | None] = []
        self.columns: list[tuple] = []
        self.links: list[pa.Table] = []
        self.n_links = 0

    def add(self, doc_ids: list[int | None], texts: list[str | None]) -> None:
        aligned = Aligned(self.pair, texts)
        found = aligned.distinct_links()
        doc = pc.add(found["doc"], len(self.doc_ids))
        self.links.append(found.set_column(0, "doc", doc))
        self.n_links += len(found)
        self.columns.append((aligned.n_a, aligned.n_b, aligned.per_doc(np.ones_like(aligned.na)), aligned.per_doc(aligned.na * aligned.nb), aligned.digests()))
        self.doc_ids += doc_ids

    def rows(self, name: str) -> Iterator[pa.RecordBatch]:
        """One row per text, and one with the pairs of the part and on how many of its texts each is."""
        links = pa.concat_tables(self.links).sort_by([("doc", "ascending"), ("pair", "ascending")])
        counts = links.group_by("pair").aggregate([("doc", "count")]).sort_by("pair")
        pairs = counts["pair"].to_numpy()
        at = np.searchsorted(pairs, links["pair"].to_numpy()).astype(np.int32)
        offsets = np.searchsorted(links["doc"].to_numpy(), np.arange(len(self.doc_ids) + 1)).astype(np.int32)
        lists = lambda values: pa.ListArray.from_arrays(offsets, values)
        n_a, n_b, n_groups, n_links = (np.concatenate([c[k] for c in self.columns]) for k in range(4))
        digests = [d for c in self.columns for d in c[4]]
        n = len(self.doc_ids)
        given = {
            "part": [name] * n, "doc_id": self.doc_ids, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links,
            "groups_sha256": digests, "at": lists(at), "times": lists(links["times"].combine_chunks())}
        yield _batch(given, n)
        yield _batch({"part": [name], "pairs": [pairs], "docs": [counts["doc_count"].to_numpy()]}, 1)


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    arrays = [pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in ROW_TYPES]
    return pa.RecordBatch.from_arrays(arrays, [k for k, _ in ROW_TYPES])


def aligned_parts(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, pieces: str) -> DataFrame:
    """Rows of ROWS: of each row of `docs` what its alignment gives by itself, with `at` and `times`, its links as places
    in the pairs of its part; and of each part its `pairs`, and `docs`, on how many of the part's rows each pair is.

    A part is filled by one task from the rows it reads, up to PART_LINKS links, so nothing is shuffled here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = kept_in_worker(f"pair {tokenizer} {pieces}", lambda: Pair(tokenizer, ranks, pattern, pieces))
        part, number, held, size = Part(pair), 0, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                held.append((doc_id.as_py(), text.as_py()))
                size += len(held[-1][1] or "")
                if size >= SLICE:
                    part.add(*map(list, zip(*held, strict=True)))
                    held, size = [], 0
                    if part.n_links >= PART_LINKS:
                        yield from part.rows(f"{TaskContext.get().partitionId()}/{number}")
                        part, number = Part(pair), number + 1
        if held:
            part.add(*map(list, zip(*held, strict=True)))
        if part.doc_ids:
            yield from part.rows(f"{TaskContext.get().partitionId()}/{number}")

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROWS)


def pair_counts(parts: DataFrame) -> DataFrame:
    """(part, at, pair, count, best) for every pair of every part; `count`: on how many rows the two ids are linked,
    in the whole corpus; `best`: no other pair of the first id has more."""
    each = parts.filter("pairs IS NOT NULL").select("part", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "p"))
    each = each.select("part", "at", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = stored(each.groupBy("pair").agg(F.sum("docs").alias("count")))
    first = F.shiftright("pair", SHIFT).alias("first")
    top = counts.groupBy(first).agg(F.max("count").alias("top"))
    marked = counts.select("pair", "count", first).join(top, "first").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    return each.select("part", "at", "pair").join(marked, "pair")


def align_tokenizers(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, pieces: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of `docs`.

    The text with a space in front is cut by a byte-level tokenizer (file, the same vocabulary as ranks, and pattern) and
    the text by a tokenizer of pieces, which adds that space. Bytes where tokens of both end bound the groups; each token
    of one side is linked with each of the other within its group. n_best counts links whose pair is on as many rows of
    the corpus as any pair of their first id, ties included; count_sum adds up these rows over all links.

    Null and empty texts, and texts that either tokenizer changes, have no tokens, zeros, and an empty digest. Repeated
    rows are rows of their own and count each; a null id is passed on; other columns are not read.

    Tasks count pairs of the rows they read; Spark merges these counts and brings them back to each part, of which the
    size is bounded. The text itself is not shuffled.
    """
    parts = stored(aligned_parts(docs, tokenizer, ranks, pattern, pieces))
    counts = pair_counts(parts).select(F.col("part").alias("of"), "at", "count", "best")
    rows = parts.filter("pairs IS NULL").select("part", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times")

    def scored(rows: pa.Table, counts: pa.Table) -> pa.Table:
        place = counts["at"].to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = counts["count"].to_numpy(), counts["best"].to_numpy()
        at, times = rows["at"].combine_chunks(), rows["times"].combine_chunks()
        flat, weight = pc.list_flatten(at).to_numpy(), pc.list_flatten(times).to_numpy()
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(at).to_numpy())])
        sums = [np.concatenate([[0], np.cumsum(weight * values[flat])]) for values in (best, count)]
        n_best, count_sum = (s[edges[1:]] - s[edges[:-1]] for s in sums)
        columns = [rows[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(n_best), pa.array(count_sum), rows["groups_sha256"]]
        return pa.Table.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return rows.groupBy("part").cogroup(counts.groupBy("of")).applyInArrow(scored, COUNTED)
