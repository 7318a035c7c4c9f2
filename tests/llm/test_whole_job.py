"""Nothing of the job is left out: whole samples, tokens, pages, passages and links."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from folioscope.llm import html, jaccard, toxicity
from folioscope.llm.buffers import raw_bytes
from folioscope.llm.tokens import Encoder
from tests.llm.test_texts import WORD, frame, near_copies


def test_field_is_fitted_on_every_document():
    """Words found only in texts late in the alphabet get a weight too."""
    rows = [(f"a{i} plain words vile here", 1) if i % 2 else (f"a{i} plain words here", 0) for i in range(800)]
    rows += [(f"zz{i} plain words rotten here", 1) if i % 2 else (f"zz{i} plain words here", 0) for i in range(400)]
    model = toxicity.fit(rows, {0: 600, 1: 600})
    numbers = toxicity.token_features(*raw_bytes(pa.array(["vile", "rotten", "plain"])))[3]
    vile, rotten, plain = model.weights[numbers].sum(1)
    assert vile > 2 and rotten > 2 and plain < 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_as_loaded(name):
    path = public_tokenizers.path(name)
    plain, own = Tokenizer.from_file(path), Encoder(path, added=True)
    texts = ["a <|endoftext|> b", None, "x<|startoftext|><|endoftext|>", "none of  them", "", "<|endoftext|>", "日本 <|endoftext|>é", "<|ENDOFTEXT|> y"]
    expected = [np.asarray(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert own.encode_all(texts) == expected


def main_texts(spark, bodies):
    rows = [(i, "https://one.example/x", body) for i, body in enumerate(bodies)]
    found = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    return {r.row.page_id: r.text for r in found.collect()}


def test_copies_do_not_cut_other_pages(spark):
    """32 of 40 pages are copies, and then 32 nearly so."""
    page = "<body><div class='box'>Same words here</div><article><p>%s</p></article><i>%s</i></body>"
    own = [f"Story {i} of its own, " + f"told with words {i} " * 10 for i in range(9)]
    for foot in ("", "%d"):
        bodies = [page % (own[8], foot % i if foot else "") for i in range(32)] + [page % (own[i], "") for i in range(8)]
        found = main_texts(spark, bodies)
        assert [found[32 + i] for i in range(8)] == [" ".join(own[i].split()) for i in range(8)]
        assert foot or found[0] == " ".join(own[8].split())


def test_names_inside_an_article_are_a_hint():
    page = """<div class="site-header">top</div><article><div class='article-header'><h1>Title</h1></div><h2 id='social-impact'>Impact</h2>
    <section id='share-prices'><p>Prices</section><p id='notice-periods'>Periods <math><mi>x</mi></math> end<div class='comments'>reader</div></article>"""
    assert html.blocks(html.main_nodes(html.parse(page)), frozenset()) == ["Title", "Impact", "Prices", "Periods x end"]
    assert html.blocks(html.main_nodes(html.parse("<section id='share-prices'><p>Prices</section><div class='site-header'>top")), frozenset()) == ["Prices"]


def test_the_style_tree_confirms_a_hint(spark):
    page = "<article><p>Story %d</p><div class='share'>Send this %d</div></article>"
    found = main_texts(spark, [page % (i, i % 2) for i in range(40)])
    assert all(found[i] == f"Story {i}" for i in range(40))


@pytest.mark.parametrize("block", [1024, 7])
def test_every_link_is_found_once(spark, monkeypatch, block):
    """Counts of links per document against all pairs, also where balls are cut into blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies()
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    linked = lambda a, b: bool(a & b) and 100 * len(a & b) >= 80 * len(a | b)
    expected = [(d, sum(i != j and linked(a, b) for j, b in enumerate(sets))) for i, ((d, _), a) in enumerate(zip(rows, sets))]
    got = jaccard.similarity_join(frame(spark, rows), 5, 80).select("doc_id", "n_links").collect()
    assert max(n for _, n in expected) > 10
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


STORY = "The council met on Monday and spoke for many hours about the new bridge, its price and the people who live beside it. " * 3


def text_of(page):
    return html.page_text(html.parse(page))


def test_deeply_nested_pages():
    deep = "<div>" * 6000 + STORY + "</div>" * 6000
    assert text_of(f"<body>{deep}</body>") == STORY.strip()
    root = html.parse(f"<body><section>{deep}</section></body>")
    section = next(x for x in root.items[0].items)
    assert html.page_text(root, frozenset([section.path])) == STORY.strip()
    assert html.page_text(root, frozenset([section.path]), frozenset([html.text_hash(STORY.strip())])) == ""


@pytest.mark.parametrize("page", [
    f"<div><h1>Bridge</h1><p>{STORY}</p></div><article><h2>Teaser one</h2></article><article><h2>Teaser two</h2></article>",
    f"<div class='post share'><h1>Bridge</h1><p>{STORY}</p></div>",
    f"<form><div class='menu'>Home</div><div class='widget'><h1>Bridge</h1><p>{STORY}</p></div></form>",
    f"<main><h1>Bridge</h1><p>{STORY}</p></main><article>Teaser</article>",
])
def test_the_story_stays(page):
    assert text_of(page) == f"Bridge\n\n{STORY.strip()}"


def test_noise_stays_noise_where_the_page_has_an_article():
    notice = f"<div class='cookie-notice'>{STORY}</div>"
    assert text_of(f"<article><p>Short news.</p></article>{notice}") == "Short news."
    assert text_of(f"<div><p>{STORY}</p></div><div class='comments'>{STORY * 9}</div>") == STORY.strip()
    assert text_of(f"<nav>{STORY}</nav><footer>{STORY}</footer>") == ""
    assert text_of(f"<article><p>Short news.</p></article><form>{STORY}</form>") == "Short news."


def test_entropies_of_a_small_host(spark):
    """Shape and content entropy of every place against the definition."""
    import collections
    import math

    bodies = ["<div><p>one</p><p>two</p></div><i>same</i>", "<div><p>three</p></div><i>same</i>", "<div><p>four</p></div><i>same</i>", "<div></div>"]
    rows = [(i, "https://h.example/", b, "h.example") for i, b in enumerate(bodies)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    trees, _ = html.site_trees(pages)
    seen = collections.defaultdict(list)
    for body in bodies:
        for path, _, _, _, styles, text in html.observations(html.parse(body)):
            seen[path].append((styles, text))

    def entropy(values):
        counts, m = collections.Counter(values).values(), len(values)
        return 1.0 if m == 1 else -sum(n / m * math.log(n / m, m) for n in counts)

    found = {r.path: r for r in trees.collect()}
    assert found.keys() == seen.keys()
    for path, values in seen.items():
        assert found[path].shape == pytest.approx(entropy([s for s, _ in values]), abs=1e-9)
        if any(t for _, t in values):
            assert found[path].content == pytest.approx(entropy([t for _, t in values]), abs=1e-9)
