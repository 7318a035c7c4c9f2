"""Cross-tokenizer alignment against whole tokenizers, one text at a time, and the laws of its fragments."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioscope.llm import alignment
from folioscope.llm.alignment import EMPTY, Fragment, compose
from folioscope.llm.tokens import byte_symbols
from tests.llm.test_texts import ODD, frame, prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """The contract, token by token."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    back = {s: b for b, s in byte_symbols().items()}

    def spell_b(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    docs, links = [], []
    for _, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        sa, sb = [bytes(back[c] for c in first.id_to_token(i)) for i in a], [spell_b(i) for i in b]
        if not text or b"".join(sa) != (" " + text).encode() or b"".join(sb) != (" " + text).encode():
            docs.append((0, 0, ""))
            links.append([])
            continue
        ends = lambda s: [sum(map(len, s[: i + 1])) for i in range(len(s))] if len(s) < 300 else __import__("itertools").accumulate(map(len, s))
        by_a, by_b = dict(zip(ends(sa), range(len(a)))), dict(zip(ends(sb), range(len(b))))
        common, out, i, j = sorted(by_a.keys() & by_b.keys()), [], 0, 0
        for end in common:
            out.append(",".join(map(str, a[i: by_a[end] + 1])) + "|" + ",".join(map(str, b[j: by_b[end] + 1])))
            i, j = by_a[end] + 1, by_b[end] + 1
        docs.append((len(a), len(b), hashlib.sha256(";".join(out).encode()).hexdigest()))
        links.append([(a[by_a[e]], b[by_b[e]]) for e in common])
    count = collections.Counter(x for found in links for x in found)
    best = collections.defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [(d, n_a, n_b, len(x), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), digest)
            for (d, _), (n_a, n_b, digest), x in zip(rows, docs, links)]


def long_rows():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    text = " ".join(rng.choice(words) + rng.choice(["", "", ".", ",\n", "  ", "　", " \x00"]) for _ in range(1500))
    return [(900, text), (901, text), (None, text), (902, "x" * 900 + " y" * 400), (903, "日本語テスト" * 150), (904, " " * 700 + "end" + " " * 80),
            (905, "9" * 333 + " 'll" * 90), (906, text[:900] + "▁" + text[:900]), (907, "   " * 200), (908, "<|endoftext|> <s> </s> <unk>" * 30)]


@pytest.mark.parametrize("chunk", [1 << 16, 300, 37])
def test_alignment(spark, chunk):
    rows = ODD + prose(25) + long_rows() + [(8, "a▁b"), (9, "﻿<s> \x00 ﬁ é"), (10, " ")]
    got = alignment.align(frame(spark, rows), A, B, chunk=chunk)
    assert got.columns[1:] == ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = sorted(((r[0].doc_id, *r[1:]) for r in got.collect()), key=str)
    expected = sorted(brute(rows), key=str)
    assert [f for f, e in zip(found, expected) if f != e] == []
    assert len(found) == len(rows)


def test_alignment_of_nothing(spark):
    assert alignment.align(frame(spark, ODD).where("doc_id < -100"), A, B).count() == 0


def test_many_rounds_of_the_tree(spark, monkeypatch):
    monkeypatch.setattr(alignment, "FAN", 3)
    rows = long_rows()[:4]
    got = alignment.align(frame(spark, rows), A, B, chunk=50).collect()
    assert sorted(((r[0].doc_id, *r[1:]) for r in got), key=str) == sorted(brute(rows), key=str)


TOKENS = st.binary(max_size=2)
PARTS = st.one_of(
    st.builds(lambda a, b: Fragment(-1, a, b, b"", b""), TOKENS, TOKENS),
    st.builds(lambda n, a, b, c, d: Fragment(n, a, b, c, d), st.integers(0, 9), TOKENS, TOKENS, TOKENS, TOKENS))


@settings(max_examples=200, deadline=None)
@given(PARTS, PARTS, PARTS)
def test_fragments_form_a_monoid(x, y, z):
    def both(p, q):
        whole, closed = compose(p[0], q[0])
        return whole, p[1] + q[1] + ([closed] if closed else [])

    x, y, z = (x, []), (y, []), (z, [])
    left, right = both(both(x, y), z), both(x, both(y, z))
    assert left[0] == right[0] and sorted(left[1]) == sorted(right[1])
    assert both((EMPTY, []), x) == x == both(x, (EMPTY, []))


def test_every_link_is_a_numbered_pair():
    own = alignment.aligner(A, B)
    assert len(own.pairs) < 2 * (len(own.a.entries) + len(own.b.entries)) * 8
    assert own.fast is not None
    pieces = [" " + t for _, t in prose(40) if t]
    found = alignment.align_pieces(own, pieces)
    numbers = alignment.link_numbers(own, found.a, found.b)
    assert (own.pairs[numbers] == found.a.ids[found.a.cut] * len(own.b.entries) + found.b.ids[found.b.cut]).all()


def test_the_merges_by_rank_equal_the_whole_tokenizer():
    own = alignment.aligner(A, B)
    texts = [" " + t for _, t in ODD + prose(60) + long_rows() if t]
    assert own.ids(texts)[0] == [own.whole.encode(t, add_special_tokens=False).ids for t in texts]
