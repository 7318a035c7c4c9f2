"""Learned operators on held-out rows, vector search against brute force, page extraction, the registered queries."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import collision, html, neighbours, toxicity
from folioscope.llm.labelled import held_out
from folioscope.llm.queries import QUERIES, SQL
from tests.oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"


def labelled(spark, n=400):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioudnrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([5, 40, 200]))]
        toxic, poor = i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["vile", "Rotten!", "filthy,"])
        if poor:
            text = [w + "|#" for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(not poor), int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "no id"), (1, rows[1][1]), (1002, "ok " * 50_000)]
    labels += [(1000, None, None), (None, 1, 0), (5000, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(5)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def judged(found, labels, label, limit):
    rows = found.select(F.col("row.doc_id").alias("doc_id"), "score").where(held_out()).join(labels, "doc_id").where(F.col(label).isNotNull())
    return np.mean([(r.score >= limit) == bool(r[label]) for r in rows.collect()])


def test_toxicity(spark):
    docs, labels = labelled(spark)
    found = toxicity.tag(docs, toxicity.learn(docs, labels))
    assert found.count() == docs.count() and judged(found, labels, "toxic", 0.7) > 0.95
    for r in found.where("predicted = 1").collect():
        assert {r.row.text[i:j].lower() for i, j in r.spans} <= {"vile", "rotten", "filthy"} and r.spans
    assert found.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity.tag(docs.where("doc_id < 0"), toxicity.fit([], {})).count() == 0


def test_messages_equal_a_plain_chain():
    rng = np.random.default_rng(3)
    rows = np.repeat([0, 1, 2], [1, 300, 40])
    scores, moves, start = rng.normal(size=341) * 3, rng.normal(size=(2, 2)), rng.normal(size=2)
    marginal, _, _ = toxicity.forward_backward(scores, rows, moves, start)
    for row in range(3):
        s = scores[rows == row]
        a, b = [np.exp(start) * [1, np.exp(s[0])]], [np.ones(2)]
        for x in s[1:]:
            step = a[-1] @ np.exp(moves) * [1, np.exp(x)]
            a.append(step / step.sum())
        for x in s[:0:-1]:
            step = np.exp(moves) @ (np.array([1, np.exp(x)]) * b[-1])
            b.append(step / step.sum())
        joint = np.array(a) * np.array(b[::-1])
        np.testing.assert_allclose(marginal[rows == row], joint[:, 1] / joint.sum(1), rtol=1e-9)


def test_quality(spark):
    docs, labels = labelled(spark)
    found = neighbours.score(docs, neighbours.learn(docs, labels))
    assert found.count() == docs.count() and judged(found, labels, "quality", 0.5) > 0.95
    assert found.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert neighbours.score(docs.where("doc_id < 0"), neighbours.fit([], {})).count() == 0


def test_held_out(spark):
    import zlib

    rows = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("h", held_out()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_collision_search(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16))
    matrix = centres[rng.integers(20, size=900)] + 0.3 * rng.normal(size=(900, 16))
    matrix[::3] = matrix[0]
    rows = [(i, v.tolist()) for i, v in enumerate(matrix.astype(np.float32))]
    bad = [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [None] * 16), (None, rows[1][1]), (2200, [1.0, 2.0]), (50, rows[50][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x")).repartition(6)
    found = collision.search(collision.build_index(df, 5, shard_rows=250), df.where("vec_id % 50 = 0"), 5).collect()
    x = np.array([v for _, v in rows], float)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    hits = total = 0
    for q in range(0, 900, 50):
        cosine = np.round(unit @ unit[q], 12)
        cosine[q] = -9
        best = np.lexsort((np.arange(900), -cosine))[:5]
        got = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        hits += len({g[1] for g in got} & set(best.tolist()))
        total += 5
        if q % 3 == 0:
            assert [g[1] for g in got] == [i for i in range(0, 30, 3) if i != q][:5]
    assert hits / total >= 0.9
    assert {r.query_id for r in found} == set(range(0, 900, 50))
    none = df.where("vec_id < 0")
    assert collision.search(collision.build_index(none, 5), none, 5).count() == 0


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header>top</header><nav><ul><li>menu</ul></nav>
<div class="cookie-notice">cookies</div><div class="box">same on every page</div><article><h1>Title &amp; more</h1><p>One <b>two<p>three %d<br>four&nbsp;five
<ul><li>a<li>b</ul><form>field<input></form><div class="comments"><p>reader</p></div><script>if(a<b){"</p>"}</script></article><aside>side</aside><footer>end"""


def test_page_blocks():
    text = html.blocks(html.main_nodes(html.parse(PAGE % 1)), frozenset())
    assert text == ["Title & more", "One two", "three 1 four five", "a", "b"]
    assert html.blocks(html.main_nodes(html.parse("plain <i>text</i>")), frozenset()) == ["plain text"]


def test_pages(spark):
    body = "<html><body><div class='box'>Same words here</div><div class='story'><p>Story %s of its own</p></div></body></html>"
    rows = [(i, "https://Host.example/x?y", body % f"no {i}") for i in range(30)] + [(40, None, None), (41, "x", ""), (42, "http://one.example/", "<p>x" * 3000), (0, "https://host.example/x", body % "no 0")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).repartition(4)
    found = {r.row.page_id: r for r in html.main_text(df).collect()}
    assert html.main_text(df).count() == len(rows)
    assert all(found[i].text == f"Story no {i} of its own" and found[i].n_chars == len(found[i].text) for i in range(30))
    assert found[40].text == "" and found[41].n_chars == 0 and found[42].text == "\n\n".join(["x"] * 3000)
    assert html.main_text(df.where("page_id < 0")).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == names and after.dtypes == docs.dtypes, name
        assert name == "mixing" or 0 < after.count() <= before
        docs = spark.createDataFrame(after.collect(), after.schema)
        before = docs.count()
    pieces = corpus_pipeline.pack_sequences(spark, docs, FOLDER)
    assert pieces.agg(F.sum("length")).first()[0] == pieces.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
