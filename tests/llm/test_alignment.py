"""Alignment of two tokenizers against a plain version: bytes of both, ends in common, all pairs within a group."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pricetide.llm import alignment
from pricetide.llm.queries import QUERIES, tokenizer_files

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    entry = {i: e for e, i in first.get_vocab().items()}
    visible = {b for b in range(256) if chr(b).isprintable() and b != 32 and b != 0xAD}
    letter, n = {chr(b): b for b in visible}, 256
    for b in range(256):
        if b not in visible:
            letter[chr(n)] = b
            n += 1

    def groups(text):
        if not text:
            return []
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        a_bytes = [bytes(letter[c] for c in entry[i]) for i in a]
        pieces = [second.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            return []
        out, i, j, x, y = [([], [])], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if x <= y and i < len(a):
                x += len(a_bytes[i])
                out[-1][0].append(a[i])
                i += 1
            else:
                y += len(b_bytes[j])
                out[-1][1].append(b[j])
                j += 1
            if x == y:
                out.append(([], []))
        return out[:-1]

    return groups


def expected(rows, groups):
    cut = [groups(text) for _, text in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in cut]
    count = Counter(pair for each in links for pair in each)
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for (ident, _), g, each in zip(rows, cut, links):
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((
            ident, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(each.values()),
            sum(n for p, n in each.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in each.items()),
            hashlib.sha256(written.encode()).hexdigest() if g else ""))
    return out


def shown(rows):
    return sorted((str(r[0]), *r[1:]) for r in rows)


FIELDS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

ODD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "a  b\n\n c\t"), (6, "x\x00y \x7f\x80"), (7, "日本語の 😀😀 é̂ ​"), (8, "▁ under ▁▁bar"),
    (9, "<|endoftext|> <s> </s> <unk> <0x41>"), (None, "no id"), (10, "twice the same"), (10, "twice the same"), (11, " " * 3000),
    (12, "word " * 4000), (13, "   end \r\n"), (14, "ab" * 5000), (15, "0x" + "9f8e7d" * 700), (16, "﻿mark ﬁne Å")]


def test_odd_texts(spark, frame, plain, monkeypatch):
    docs = frame([(i, t, 1, "x") for i, t in ODD], "doc_id long, text string, n_a int, part string")
    out = alignment.align_tokenizers(docs, *tokenizer_files(), PIECES)
    assert out.columns == FIELDS
    assert shown(out.collect()) == shown(expected(ODD, plain))
    assert alignment.align_tokenizers(docs.filter("false"), *tokenizer_files(), PIECES).collect() == []


def test_small_parts_slices_and_runs(spark, frame, plain, monkeypatch):
    docs = frame(ODD, "doc_id long, text string")
    for name, value in (("PART_LINKS", 5), ("SLICE", 40), ("LINKS_AT_ONCE", 7), ("LARGE_GROUP", 3), ("LONG", 50)):
        monkeypatch.setattr(alignment, name, value)
    out = alignment.align_tokenizers(docs, *tokenizer_files(), PIECES)
    assert shown(out.collect()) == shown(expected(ODD, plain))


def test_given_documents(spark, plain):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    out = QUERIES["op11_arrow_alignment"](spark, folder)
    assert out.columns == FIELDS
    assert shown(out.collect()) == shown(expected(rows, plain))


def test_words_are_read_as_in_whole_texts(spark):
    pair = alignment.Pair(*tokenizer_files(), PIECES)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text]
    texts += ["a's b'll 12 3.4 (x) \"y\"", "one\ntwo\n\nthree four.\nfive", "tab\tin word\x1fs \x85x", "ﬁne ́combining ̈marks", "x\u3000y z\u00a0w", "▁ a", "a ▁b c"]
    a, b = pair.encoded(texts)
    pair.apart = False
    assert (a, b) == pair.encoded(texts)


def test_long_texts_are_cut_between_words(monkeypatch):
    pair = alignment.Pair(*tokenizer_files(), PIECES)
    assert pair.apart
    text = "  two  spaces, a word\n and  \t more 日本 語 " * 50 + "x" * 300
    whole = pair.second_ids(text)
    for n in (1, 7, 64):
        monkeypatch.setattr(alignment, "LONG", n)
        assert pair.second_ids(text) == whole
