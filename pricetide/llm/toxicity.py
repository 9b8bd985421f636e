"""Toxicity by a bidirectional gated recurrent network with attention over words and their characters, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import held_out, kept_in_worker, labelled_sample

WINDOW, STRIDE = 64, 32
HIDDEN, PART, ATTENTION = 8, 8, 8
WORD_ROWS, CHARACTER_ROWS = 2**14, 2**13
# Longer words are read in pieces of so many characters.
LONGEST_WORD = 24
EDGES = ".,;:!?\"'()[]{}<>|*&%$#-_"

# What the network is fitted on at most, by default: labelled rows of either class, and characters of each.
TOXIC_ROWS, CLEAN_ROWS, FIT_CHARACTERS = 1500, 3000, 40_000
# Words and runs of characters in fewer fitted texts have no vector of their own.
LEAST_TEXTS = 3
# An epoch has so many steps at least, so that a small sample is learned from as often as a large one.
STEPS = 30
# While it is fitted, the network does without the own vectors of so many words.
DROPPED = 0.5
# Words a worker keeps, and those it looks up at a time beside them.
CACHED_WORDS, AT_ONCE = 40_000, 2**15


def tokens(text: str) -> list[str]:
    words = text.lower().split()
    if max(map(len, words), default=0) > LONGEST_WORD:
        words = [w[i : i + LONGEST_WORD] for w in words for i in range(0, len(w), LONGEST_WORD)]
    return words


def inputs(words: list[str], at_once: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word the row of its own vector, the rows of its runs of three characters, and how many these are."""
    parts = [_inputs(words[i : i + at_once]) for i in range(0, len(words), at_once)]
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def _inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bare = [w.strip(EDGES) or w for w in words]
    codes = np.zeros((len(words), LONGEST_WORD + 2), np.uint32)
    codes[:, 1:-1] = np.array(bare, f"U{LONGEST_WORD}").view(np.uint32).reshape(len(words), LONGEST_WORD)
    size = (codes[:, 1:-1] != 0).sum(1)
    own = np.zeros(len(words), np.uint32)
    for i in range(LONGEST_WORD):
        own = own * np.uint32(0x01000193) + codes[:, 1 + i]
    own = (own ^ (own >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    three = (codes[:, :-2] * np.uint32(0x9E3779B1) + codes[:, 1:-1]) * np.uint32(0x85EBCA77) + codes[:, 2:]
    three = (three ^ (three >> np.uint32(13))) * np.uint32(0xC2B2AE3D)
    mask = np.arange(LONGEST_WORD) < size[:, None]
    rows = np.where(mask, (three >> np.uint32(19)).astype(np.int16), np.int16(CHARACTER_ROWS))  # the last row stays zero
    return (own >> np.uint32(18)).astype(np.int16), rows, np.maximum(size, 1).astype(np.int16)


def window_starts(n: int) -> range:
    """Overlapping windows that cover n words; one, of padding, if there are none."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _summed(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows added up by index."""
    order = np.argsort(index, kind="stable")
    keys, first = np.unique(index[order], return_index=True)
    return keys, np.add.reduceat(rows[order], first)


class Network:
    """Words enter as their own vector and the mean vector of their character runs. One gated unit reads a window
    forwards, one backwards; attention weighs the states, and the weighted mean gives the logit."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        h = HIDDEN
        # What was not seen in fitting says nothing: all vectors begin as zero.
        self.words = np.zeros((WORD_ROWS + 1, PART), np.float32)
        self.characters = np.zeros((CHARACTER_ROWS + 1, PART), np.float32)
        self.own_rows, self.character_rows = np.ones(WORD_ROWS + 1, bool), np.ones(CHARACTER_ROWS + 1, bool)
        self.own_rows[-1] = self.character_rows[-1] = False  # these learn nothing
        self.dense = {
            "W": draw(2 * PART, 6 * h), "b": np.zeros(6 * h, np.float32), "Uf": draw(h, 3 * h), "Ub": draw(h, 3 * h),
            "A": draw(2 * h, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": draw(ATTENTION, 1)[:, 0], "w": draw(2 * h, 1)[:, 0],
            "c": np.zeros(1, np.float32),
        }
        self.first, self.second, self.steps = {}, {}, 0
        self.word_sums, self.character_sums = np.zeros((WORD_ROWS + 1, 1), np.float32), np.zeros((CHARACTER_ROWS + 1, 1), np.float32)

    def learn_only(self, by_word: np.ndarray, by_run: np.ndarray) -> None:
        """Rows that are on fewer than LEAST_TEXTS texts stay zero."""
        self.own_rows &= by_word >= LEAST_TEXTS
        self.character_rows &= by_run >= LEAST_TEXTS

    def vectors(self, own, rows, size) -> np.ndarray:
        return np.concatenate([self.words[own], self.characters[rows].sum(1) / size[:, None]], 1, dtype=np.float32)

    def projected(self, own, rows, size, at_once: int = 4096) -> np.ndarray:
        """What each word adds to the gates of both directions, from row 1 on; row 0 is padding."""
        out = np.zeros((len(own) + 1, 6 * HIDDEN), np.float32)
        for i in range(0, len(own), at_once):
            p = slice(i, i + at_once)
            out[1 + i : 1 + i + at_once] = self.vectors(own[p], rows[p], size[p]) @ self.dense["W"] + self.dense["b"]
        return out

    def _read(self, x, U, mask, keep):
        """States of one direction; x: time, window, gates; mask: time, window, 1."""
        h = HIDDEN
        state, states, kept = np.zeros((x.shape[1], h), np.float32), np.empty((*x.shape[:2], h), np.float32), []
        for t in range(len(x)):
            gates = _sigmoid(x[t, :, : 2 * h] + state @ U[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            n = np.tanh(x[t, :, 2 * h :] + (r * state) @ U[:, 2 * h :])
            if keep:
                kept.append((state, z, r, n))
            state = (state + z * (n - state)) * mask[t]
            states[t] = state
        return states, kept

    def forward(self, table: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logits of windows given as rows (window, time) of `table`, whose row 0 is padding."""
        d, h = self.dense, HIDDEN
        time = index.T
        mask = (time > 0)[:, :, None].astype(np.float32)
        x = table[time]
        ahead, kept_f = self._read(x[:, :, : 3 * h], d["Uf"], mask, keep)
        back, kept_b = self._read(x[::-1, :, 3 * h :], d["Ub"], mask[::-1], keep)
        states = np.concatenate([ahead, back[::-1]], 2)
        seen = np.tanh(states @ d["A"] + d["a"])
        energy = np.where(mask[:, :, 0] > 0, seen @ d["v"], -1e9)
        weight = np.exp(energy - energy.max(0)) * mask[:, :, 0]
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = (weight[:, :, None] * states).sum(0)
        logit = pooled @ d["w"] + d["c"][0]
        return (logit, (x, mask, kept_f, kept_b, states, seen, weight, pooled)) if keep else logit

    def _unread(self, dstates, x, U, mask, kept):
        """Gradients of one direction: of its inputs and of U."""
        h = HIDDEN
        dx, dU, dnext = np.empty_like(x), np.zeros_like(U), np.zeros_like(dstates[0])
        for t in range(len(x) - 1, -1, -1):
            state, z, r, n = kept[t]
            g = (dstates[t] + dnext) * mask[t]
            dn = g * z * (1 - n * n)
            dz = g * (n - state) * z * (1 - z)
            drs = dn @ U[:, 2 * h :].T
            dr = drs * state * r * (1 - r)
            dgates = np.concatenate([dz, dr], 1)
            dx[t, :, : 2 * h], dx[t, :, 2 * h :] = dgates, dn
            dU[:, : 2 * h] += state.T @ dgates
            dU[:, 2 * h :] += (r * state).T @ dn
            dnext = g * (1 - z) + drs * r + dgates @ U[:, : 2 * h].T
        return dx, dU

    def gradients(self, own, rows, size, index, labels, weights):
        """Loss, and gradients of all parameters; index counts the words of own, rows and size from 1."""
        d, h = self.dense, HIDDEN
        vectors = self.vectors(own, rows, size)
        table = np.concatenate([np.zeros((1, 6 * h), np.float32), vectors @ d["W"] + d["b"]])
        logit, (x, mask, kept_f, kept_b, states, seen, weight, pooled) = self.forward(table, index, keep=True)
        p = _sigmoid(logit)
        loss = -(weights * (labels * np.log(p + 1e-7) + (1 - labels) * np.log(1 - p + 1e-7))).sum()
        dlogit = ((p - labels) * weights).astype(np.float32)
        out = {"w": pooled.T @ dlogit, "c": np.array([dlogit.sum()], np.float32)}
        dpooled = dlogit[:, None] * d["w"]
        dweight = (states * dpooled).sum(2)
        denergy = weight * (dweight - (weight * dweight).sum(0))
        dseen = denergy[:, :, None] * d["v"] * (1 - seen * seen)
        out["v"] = np.tensordot(denergy, seen, ([0, 1], [0, 1]))
        out["A"], out["a"] = np.tensordot(states, dseen, ([0, 1], [0, 1])), dseen.sum((0, 1))
        dstates = weight[:, :, None] * dpooled + dseen @ d["A"].T
        dx = np.empty_like(x)
        dx[:, :, : 3 * h], out["Uf"] = self._unread(dstates[:, :, :h], x[:, :, : 3 * h], d["Uf"], mask, kept_f)
        back, out["Ub"] = self._unread(dstates[::-1, :, h:], x[::-1, :, 3 * h :], d["Ub"], mask[::-1], kept_b)
        dx[:, :, 3 * h :] = back[::-1]
        real = index.T.ravel() > 0
        keys, sums = _summed(index.T.ravel()[real], dx.reshape(-1, 6 * h)[real])
        dtable = np.zeros((len(own), 6 * h), np.float32)
        dtable[keys - 1] = sums
        out["W"], out["b"] = vectors.T @ dtable, dtable.sum(0)
        dvectors = dtable @ d["W"].T
        word = _summed(own, dvectors[:, :PART])
        spread = np.repeat(dvectors[:, PART:] / size[:, None], LONGEST_WORD, 0)
        used = rows.ravel() < CHARACTER_ROWS
        character = _summed(rows.ravel()[used], spread[used])
        return loss, out, word, character

    def step(self, own, rows, size, index, labels, weights, rate: float = 0.01) -> float:
        loss, dense, (word_rows, word), (character_rows, character) = self.gradients(own, rows, size, index, labels, weights)
        self.steps += 1
        for k, g in dense.items():
            m = self.first[k] = 0.9 * self.first.get(k, 0) + 0.1 * g
            s = self.second[k] = 0.999 * self.second.get(k, 0) + 0.001 * g * g
            self.dense[k] -= (rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.999**self.steps)) + 1e-8)).astype(np.float32)
        learned = (
            (self.words, self.word_sums, self.own_rows, word_rows, word),
            (self.characters, self.character_sums, self.character_rows, character_rows, character))
        for part, sums, known, at, g in learned:
            at, g = at[known[at]], g[known[at]]
            sums[at] += (g * g).mean(1, keepdims=True)
            part[at] -= 5 * rate * g / (np.sqrt(sums[at]) + 1e-8)
        return float(loss)


class Vocabulary(dict):
    """Numbers words from 1 as they come; `fresh` are those without a row in the table yet. The table has one size."""

    def __init__(self, network: Network):
        super().__init__()
        self.network = network
        self.table = np.zeros((CACHED_WORDS + 2 * AT_ONCE, 6 * HIDDEN), np.float32)
        self.fresh: list[str] = []

    def forget(self) -> None:
        self.clear()
        self.fresh = []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self) + 1
        self.fresh.append(word)
        return at

    def index(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def filled(self) -> np.ndarray:
        if self.fresh:
            need = len(self) + 1
            self.table[need - len(self.fresh) : need] = self.network.projected(*inputs(self.fresh))[1:]
            self.fresh = []
        return self.table


def windows(index: np.ndarray) -> np.ndarray:
    starts = window_starts(len(index))
    padded = np.zeros(starts[-1] + WINDOW, np.int32)
    padded[: len(index)] = index
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def runs(words: list[str]) -> Iterator[list[str]]:
    """The words of a text in runs of AT_ONCE about, which overlap so that they have the windows of the whole text."""
    step = max(STRIDE, AT_ONCE // STRIDE * STRIDE)
    for a in range(0, max(1, len(words) - WINDOW + STRIDE), step):
        yield words[a : a + step + WINDOW - STRIDE]


def document_scores(vocabulary: Vocabulary, texts: list[str]) -> np.ndarray:
    """The highest probability among all windows of each text."""
    logits = np.full(len(texts), -np.inf)
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def read() -> None:
        table, every = vocabulary.filled(), np.concatenate([w for _, w in held])
        found = np.concatenate([vocabulary.network.forward(table, every[i : i + 1024]) for i in range(0, len(every), 1024)])
        np.maximum.at(logits, np.repeat([i for i, _ in held], [len(w) for _, w in held]), found)

    for i, text in enumerate(texts):
        for words in runs(tokens(text)):
            if size + len(words) > 2 * AT_ONCE:
                read()
                held, size = [], 0
            if not held and len(vocabulary) >= CACHED_WORDS:
                vocabulary.forget()
            held.append((i, windows(vocabulary.index(words))))
            size += len(words)
    if held:
        read()
    return _sigmoid(logits)


def seen_rows(docs: list[np.ndarray], own: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """On how many texts each word row and each character row is; `docs`: their windows of words, numbered from 1."""
    by_word, by_run = np.zeros(WORD_ROWS + 1, np.int64), np.zeros(CHARACTER_ROWS + 1, np.int64)
    for found in docs:
        words = np.unique(found)
        words = words[words > 0] - 1
        by_word[np.unique(own[words])] += 1
        by_run[np.unique(rows[words])] += 1
    return by_word, by_run


def fit(texts: list[str], labels: np.ndarray, epochs: int = 8, batch: int = 256, seed: int = 11) -> Network:
    """A network from labelled texts. The first epochs take every window of a toxic text for toxic, up to 8 drawn at
    random; later ones its most suspicious one. Of clean texts the most suspicious and a random window are taken."""
    network = Network()
    if not len(texts) or labels.min() == labels.max():
        network.dense["w"][:] = 0
        p = (labels.sum() + 1) / (len(labels) + 2)
        network.dense["c"][:] = np.log(p / (1 - p))
        return network
    rng = np.random.default_rng(seed)
    names: dict[str, int] = {}
    docs = [windows(np.array([names.setdefault(w, len(names) + 1) for w in tokens(t)], np.int32)) for t in texts]
    own, rows, size = inputs(list(names)) if names else inputs(["x"])
    network.learn_only(*seen_rows(docs, own, rows))
    first = np.cumsum([0, *map(len, docs)])
    every = np.concatenate(docs)
    del docs, names
    for epoch in range(epochs):
        if epoch >= 2:
            table = network.projected(own, rows, size)
            logits = np.concatenate([network.forward(table, every[i : i + 512]) for i in range(0, len(every), 512)])
            del table
        chosen, marks = [], []
        for i, y in enumerate(labels):
            a, b = first[i], first[i + 1]
            if epoch < 2:
                take = a + rng.permutation(b - a)[: 8 if y else 2]
            else:
                top = a + int(logits[a:b].argmax())
                take = [top] if y else [top, rng.integers(a, b)]
            chosen += list(take)
            marks += [y] * len(take)
        chosen, marks = np.array(chosen), np.array(marks, np.float32)
        order = rng.permutation(len(chosen))
        some_rows = int(np.clip(len(order) // STEPS, 16, batch))
        balance = np.where(marks == 1, 0.5 / max(1, marks.sum()), 0.5 / max(1, (1 - marks).sum())).astype(np.float32) * len(marks)
        for at in range(0, len(order), some_rows):
            some = order[at : at + some_rows]
            index = every[chosen[some]]
            used, place = np.unique(index, return_inverse=True)
            place = place.reshape(index.shape)
            if used[0] == 0:
                used = used[1:]
            else:
                place = place + 1
            if not len(used):
                continue
            shown = np.where(rng.random(len(used)) < DROPPED, WORD_ROWS, own[used - 1])
            network.step(shown, rows[used - 1], size[used - 1], place, marks[some], balance[some] / len(some), 0.02 * 0.85**epoch)
    return network


def fitted(
    docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, fit_characters: int = FIT_CHARACTERS
) -> Network:
    """The network, fitted on the driver on a bounded sample: so many labelled rows of either class outside the held-out
    fold, each of `fit_characters` characters at most. Of several labels of an id the largest counts."""
    rows = docs.filter(F.length("text") <= fit_characters).select("doc_id", "text")
    known = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [labelled_sample(rows, known.filter(F.col("toxic") == y), "toxic", n) for y, n in ((1, toxic_rows), (0, clean_rows))]
    sample = drawn[0].unionByName(drawn[1]).orderBy("doc_id", "text").collect()
    return fit([r.text for r in sample], np.array([r.label for r in sample], np.float32))


def score_toxicity(docs: DataFrame, labels: DataFrame, network: Network | None = None) -> DataFrame:
    """The rows of `docs` with `score`: the highest probability over all overlapping windows of the whole text.

    A null or empty text is one window of padding, so it gets the same score everywhere. Repeated rows are scored
    each. Columns other than doc_id and text are passed on; one named `score` is replaced.
    """
    network = network or fitted(docs, labels)
    network.first, network.second = {}, {}
    name = f"toxicity words {xxhash.xxh3_64_hexdigest(network.words.tobytes() + b''.join(v.tobytes() for v in network.dense.values()))}"

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = kept_in_worker(name, lambda: Vocabulary(network))
        for series in texts:
            yield pd.Series(document_scores(vocabulary, [t or "" for t in series]))

    scored = F.pandas_udf(run, "double")
    return docs.withColumn("score", scored(F.col("text")))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scored = score_toxicity(docs.select("doc_id", "text"), labels)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
