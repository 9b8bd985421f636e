"""Packing: exact round trip of the ids, full use of the sequences, plans against their counts."""

import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from pricetide.llm import packing
from pricetide.llm.queries import tokenizer_files

FILES = tokenizer_files()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILES[0])


def test_ids_are_those_of_the_tokenizer(tokenizer):
    encoder = packing.Encoder(*FILES)
    for text in ["", " ", "a  b", "<|endoftext|> x", " a\n b \n\n c", "y z　w q ", "it's WE'LL 12 34a", "éèê ñ ß", "x" * 5000, "日本 🙂"]:
        assert list(encoder.ids(text)) == tokenizer.encode(text, add_special_tokens=False).ids


def test_round_trip(spark, frame, tokenizer):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 900))), "l", 1) for i in range(40)]
    rows += [(100, None, "l", 1), (101, "", None, None), (102, "w " * 7000, "", 1), (None, "no id", "", 1), rows[3]]
    docs = frame(rows, "doc_id long, text string, length string, piece int")
    made = packing.pieces(docs, *FILES).collect()
    found = sorted((str(r.doc_id), r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in made)
    want = []
    for ident, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        head = len(ids) % 2048 or 2048
        cuts = [0, len(ids)] if len(ids) <= 2048 else [0, *range(head, len(ids) + 1, 2048)]
        want += [(str(ident), k, a, ids[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert found == sorted(want)

    packed = packing.packed_documents(docs, *FILES).collect()
    assert Counter((str(r.doc_id), r.piece, r.start, r.length) for r in packed) == Counter((d, k, s, len(ids)) for d, k, s, ids in want)
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(len(ids) for *_, ids in want)
    assert len(sequences) <= -(-total // 2048) + 1
    assert packing.packed_documents(docs.filter("false"), *FILES).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_piece(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 100): rng.choice([1, 2, 7, 500, 10**9]) for _ in range(rng.randint(0, 30))}
    runs = packing.best_plan(counts, 100)
    held = Counter()
    for n, lengths in runs:
        assert n > 0 and sum(lengths) <= 100
        for length in lengths:
            held[length] += n
    assert held == Counter(counts)
    total = sum(k * n for k, n in counts.items())
    assert sum(n for n, _ in runs) <= 1.7 * total / 100 + 2


def test_few_sizes_are_packed_well():
    runs = packing.best_plan({70: 30, 30: 30, 50: 40}, 100)
    assert sum(n for n, _ in runs) == 50
