"""Text operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import huffman, jaccard, mixing, packing, repetition, suffix
from folioscope.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (-5, "a  b   c \n d\n\n\ne  x\ty"), (-4, None), (-3, ""), (-1, " lead  trail \n"), (-6, "x " * 4000),
    (-2, "It's  <|endoftext|> don't ΑΣ   日本語 テスト é́  ok 'll we 's ½ 123 4a_b\x1cq\x85r "), (None, "no id. no id."), (7, "twice the same"), (7, "twice the same"),
]


def prose(n, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(80)]
    return [(i + 20, " ".join(rng.choice(words) + rng.choice(["", "", ".", ",", ".\n"]) for _ in range(rng.choice([1, 3, 20, 150])))) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    return ODD + prose(60)


def frame(spark, rows, parts=5):
    """With columns whose names the operators use inside."""
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, part int, row string")
    return df.withColumn("digest", F.lit(b"x")).repartition(parts)


@pytest.fixture(scope="module")
def tokenizers():
    found = {}
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        found[name] = Tokenizer.from_file(public_tokenizers.path(name))
        found[name].encode_special_tokens = True
    return found


def ids_of(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_tokenizer(rows, tokenizers, name):
    own = Encoder(public_tokenizers.path(name), entries=50)
    assert own.scheme
    texts = [t for _, t in rows]
    expected = [np.asarray(ids_of(tokenizers[name], t, 0)[:-1], "<u4").tobytes() for t in texts]
    assert own.encode_all(texts) == expected
    assert [own.encode(t) for t in texts] == expected


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    counts = np.r_[0, rng.integers(1, 1000, 300), 10**9]
    lengths = huffman.code_lengths(counts)
    used = lengths[lengths > 0].astype(int)
    assert lengths[0] == 0 and len(used) == 301 and sum(2.0**-used) == 1.0
    heap = sorted(int(c) for c in counts if c)
    total = 0
    while len(heap) > 1:
        a, b, *heap = heap
        total += a + b
        heap = sorted([*heap, a + b])
    assert (lengths * counts).sum() == total
    short = huffman.code_lengths(counts, 9)
    assert short.max() == 9 and sum(2.0 ** -short[short > 0].astype(int)) <= 1.0


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_bits_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n).clip(0, 3000).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=5))
    stream, places = huffman.write_bits(ids, huffman.canonical(lengths)[0], lengths)
    assert huffman.read_bits(stream, places, n, huffman.decode_table(lengths)).tolist() == ids.tolist()


def test_huffman_files(spark, rows, tokenizers, tmp_path, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_TOKENS", 300)
    huffman.encode_corpus(frame(spark, rows), str(tmp_path / "f"), public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in huffman.decode_corpus(spark, str(tmp_path / "f")).collect())
    assert [g[1] for g in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    start, texts = 0, collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    for at, i, n, crc in got:
        ids = ids_of(tokenizers["byte_bpe_50k.json"], texts[i][0], 0)
        assert (at, n, crc) == (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += n


def test_huffman_of_nothing(spark, tmp_path):
    huffman.encode_corpus(frame(spark, [(1, "x")]).where("doc_id < 0"), str(tmp_path / "f"), public_tokenizers.path("byte_bpe_50k.json"))
    assert huffman.decode_corpus(spark, str(tmp_path / "f")).count() == 0


def test_packing(spark, rows, tokenizers):
    found = packing.pack(frame(spark, rows), public_tokenizers.path("word_bpe_49k.json"), longest=64).collect()
    assert sorted(r.sequence_id for r in found) == list(range(len(found)))
    assert all(r.length == 1 << r.bucket and r.length <= 64 and r.offset == 0 and r.ids_crc32 == zlib.crc32(r.ids) for r in found)
    texts, got = collections.Counter(), collections.defaultdict(list)
    for r in found:
        got[r.doc_id].append((r.start, list(np.frombuffer(r.ids, "<u4"))))
    for i, t in rows:
        texts[i] += 1
        ids = ids_of(tokenizers["word_bpe_49k.json"], t, 1)
        pieces = sorted(got[i])[:: sum(j == i for j, _ in rows)]
        assert sum((p for _, p in pieces), []) == ids
    assert packing.pack(frame(spark, rows).where("doc_id < -100"), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_repetition(spark):
    rows = ODD + [(i + 100, t + "\n" + t[:60] + "\n" + t) for i, t in prose(30)] + [(500, "# a|b\n\n# a|b\n \n" * 3)]

    def brute(text):
        text = text or ""
        words, seen, again = WORD.findall(text), set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        grams = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
        inside = {i + j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        five = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
        five_in = {i + j for i in range(len(words) - 4) if five[tuple(words[i:i + 5])] > 1 for j in range(5)}
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside), failed, sum(len(words[i]) for i in five_in)

    got = repetition.repetition(frame(spark, rows)).collect()
    found = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.covered_5) for r in got), key=str)
    assert found == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert not any(r.kept and r.base_failed for r in got)


def shingle_groups(rows, size, percent):
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[j:j + size]) for j in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)]


def near_copies():
    rng = random.Random(9)
    voc = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(voc) for _ in range(rng.choice([1, 2, 3, 5, 20, 60])))) for i in range(60)]
    base = [rng.choice(voc) for _ in range(120)]
    for i in range(60, 120):
        words = base[:]
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(voc)
        rows.append((i, " ".join(words)))
    rows += [(i, " ".join(base[(i - 120) // 3:][:80] + [f"t{(i - 120) // 12}"] * 2)) for i in range(120, 160)]
    return rows + ODD + [(None, "A b C d e f"), (703, "a B c d e f"), (5, rows[5][1]), (704, " \n")]


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_similarity_join(spark, size, percent):
    rows = near_copies()
    got = jaccard.similarity_join(frame(spark, rows), size, percent).select("doc_id", "n_shingles", "component_id")
    expected = shingle_groups(rows, size, percent)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_deduplicate(spark):
    rows = near_copies()
    kept = jaccard.deduplicate(frame(spark, rows)).collect()
    groups = shingle_groups(rows, 5, 80)
    worded = {(c if c is not None else ("alone", d)) for d, n, c in groups if n}
    assert len(kept) == len(worded) + sum(n == 0 for _, n, _ in groups)
    assert kept[0].asDict().keys() == {"doc_id", "text", "part", "row", "digest"}
    assert jaccard.deduplicate(frame(spark, rows).where("doc_id < -100")).count() == 0


def test_divide_skip_finds_what_counting_finds():
    rng = np.random.default_rng(2)
    query = np.unique(rng.integers(0, 400, 120)).astype(np.uint64)
    others = [np.unique(np.r_[rng.choice(query, size=k, replace=False), rng.integers(500, 600, 120 - k)]).astype(np.uint64) for k in range(60, len(query))]
    linked, overlap = jaccard.occurrence_search(query, others, 80)
    both = [len(np.intersect1d(query, o)) for o in others]
    assert overlap == both
    assert linked == [100 * b >= 80 * (len(query) + len(o) - b) for b, o in zip(both, others)]


def removed(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[i:i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, texts):
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                mask[i:i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, mask) if not y)
        runs = sum(1 for i in range(len(mask)) if mask[i] and (i == 0 or not mask[i - 1]))
        out.append((d, len(b), sum(mask), runs, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
    return out


@pytest.mark.parametrize("length,portion", [(20, 32 << 20), (20, 2000), (40, 32 << 20)])
def test_suffix_removal(spark, monkeypatch, length, portion):
    monkeypatch.setattr(suffix, "PORTION_BYTES", portion)
    monkeypatch.setattr(suffix, "BUCKET_BYTES", min(portion // 4, 4 << 20))
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passages = [text(rng.randint(15, 80)) for _ in range(12)]
    rows = [(i, text(rng.randint(0, 60)) + rng.choice(passages) + text(rng.randint(0, 40)) + (rng.choice(passages)[3:40] if i % 3 else "")) for i in range(90)]
    rows += ODD + [(202, "a" * 300), (203, "ab" * 90), (204, rows[3][1]), (205, rows[3][1]), (206, "line one is here\n" * 9)]
    got = suffix.cut_repeats(frame(spark, rows), length).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(removed(rows, length), key=str)


def test_suffix_of_nothing(spark):
    assert suffix.cut_repeats(frame(spark, ODD).where("doc_id < -100"), 20).count() == 0


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11, 13, 17])
def test_difference_sets(q):
    found, v = suffix.difference_set(q), q * q + q + 1
    assert len(found) == q + 1 and len({(a - b) % v for a in found for b in found if a != b}) == v - 1


def test_mixing(spark):
    rows = [(i, "w " * (i % 40), f"s{i % 7 if i % 3 else 0}") for i in range(600)] + [(700, None, None), (701, "a b c", None), (702, "", "s1"), (5, "x y", "s5"), (5, "x y", "s5")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("t")).repartition(4)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size, target, taken = collections.Counter(), {}, collections.Counter()
    for r in got:
        source = r.row.source
        size[source] += r.size
        target[source] = r.target
        taken[source] += r.taken
        assert r.taken <= 2 * r.size and r.taken == r.repeats * r.size
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate([*sorted(s for s in size if s), None])}
    left, free, expected = 1.5 * sum(size.values()), dict(weights), {}
    while True:
        level = left / sum(free.values())
        over = [s for s in free if level * free[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            expected[s] = 2.0 * size[s]
            left -= expected[s]
            del free[s]
    expected |= {s: level * w for s, w in free.items()}
    assert target == pytest.approx(expected)
    assert all(abs(taken[s] - target[s]) <= 20 for s in size)
    again = {(r.doc_id, r.size, r.taken) for r in mixing.mix(df.repartition(9)).collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in got}
    assert mixing.mixed_documents(df).count() == sum(r.repeats for r in got)
    assert mixing.mix(df.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_are_cut_from_their_marks(tokenizers, name):
    """Marks, line ends and accents don't make a word new, and odd white space stays with its unit."""
    own, calls = Encoder(public_tokenizers.path(name)), []
    unit = own._unit
    own._unit = lambda text: calls.append(text) or unit(text)
    texts = ["so größer, größer. größer\ngrößer-größer; größer (größer) 12größer"] * 3
    expected = [np.asarray(ids_of(tokenizers[name], t, 0)[:-1], "<u4").tobytes() for t in texts]
    assert own.encode_all(texts) == expected
    assert not [c for c in calls if "gr" in c] and len(own.tiles) <= 12
    odd = ["a\xa0 b", "a 　b   c", "x\n\ny \n z", "a\x1c b", "don't  we'll", "1 2 3", "H̱ é×é", None, "", " ", "ab\n", "\nab"]
    expected = [np.asarray(ids_of(tokenizers[name], t, 0)[:-1], "<u4").tobytes() for t in odd]
    assert own.encode_all(odd) == expected


def test_stored_ids_take_two_bytes_where_they_fit(spark, rows, tokenizers):
    tokens = huffman._tokenized(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), 0, "doc_id", "text", False)
    wide = huffman._tokenized(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), 1 << 16, "doc_id", "text", False)
    for found, width in ((tokens, 2), (wide, 4)):
        blocks = found.collect()
        assert blocks and all(len(b.ids) == width * b.n_tokens for b in blocks)
    counts = {r.id: r.n for r in huffman.count_ids(tokens).collect()}
    expected = np.unique([i for _, t in rows for i in ids_of(tokenizers["byte_bpe_50k.json"], t, 0)], return_counts=True)
    assert counts == dict(zip(*(x.tolist() for x in expected)))
    assert {r.id: r.n for r in huffman.count_ids(wide).collect()}[1 << 16] == len(rows)
