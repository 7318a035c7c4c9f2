"""The pipeline's stages on planted cases and on odd tables: nothing, nulls, repeated rows, clashing columns."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import mixing, packing
from tests.llm.test_texts import ODD, frame, prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 3}", len(t or "")) for d, t in rows], COLUMNS).repartition(5)


def invented(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def planted():
    """Texts of their own, of which the first 60 hold one of four passages of 51 to 60 words."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    passages = [invented(rng, words, n) for n in (51, 54, 57, 60)]
    own = [(invented(rng, words, rng.randint(20, 90)), invented(rng, words, rng.randint(20, 90))) for _ in range(120)]
    rows = [(i, f"{a}\n{passages[i % 4]}\n{b}" if i < 60 else f"{a}\n{b}") for i, (a, b) in enumerate(own)]
    return rows, passages, own


def test_shared_passages_of_over_fifty_words_go(spark):
    rows, passages, own = planted()
    found = {r.doc_id: r for r in corpus_pipeline.cut_repeated_strings(spark, documents(spark, rows), "").collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        kept = found[i].text
        assert found[i].n_chars == len(kept)
        if i < 60:
            # What precedes and follows the passage may agree by a byte or two.
            assert all(p not in kept for p in passages) and len(kept) <= len(text) - len(passages[i % 4])
            assert kept.startswith(own[i][0][:-2]) and kept.endswith(own[i][1][2:])
        else:
            assert kept == text


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", ["ngram_jaccard_join", "suffix_array_dedup", "mixing"])
def test_stages_keep_the_columns_and_take_odd_rows(spark, name):
    docs = documents(spark, ODD + prose(30) + [(None, None), (None, None)]).withColumns({"row": F.lit("z"), "key": F.lit(3), "digest": F.lit(b"d"), "size": F.lit(1)})
    found = STAGES[name](spark, docs, "")
    assert found.columns == docs.columns
    rows = found.collect()
    assert rows and all(r.row == "z" and r.key == 3 and r.size == 1 for r in rows)
    assert STAGES[name](spark, docs.where("n_chars < 0"), "").count() == 0


def test_toxicity_stage_on_odd_rows(spark, tmp_path):
    """The stage drops what the planted words mark, and keeps null and empty texts."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, invented(rng, words, 40) + (" vile rotten scum" if i % 4 == 0 else "")) for i in range(400)] + [(1000, None), (1001, ""), (None, "no id"), (1002, "plain"), (1002, "plain")]
    docs = documents(spark, rows).withColumns({"row": F.lit("z"), "score": F.lit(2), "predicted": F.lit(5)})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    found = STAGES["toxicity"](spark, docs, str(tmp_path))
    assert found.columns == docs.columns
    kept = collections.Counter(r.doc_id for r in found.collect())
    assert kept == collections.Counter(d for d, t in rows if "vile" not in (t or ""))
    assert STAGES["toxicity"](spark, docs.where("doc_id < 0"), str(tmp_path)).count() == 0


def test_packing_stage_equals_the_operator(spark):
    docs = frame(spark, ODD)
    found = STAGES["packing"](spark, docs, "")
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = packing.pack(docs, corpus_pipeline.vocabulary("word_bpe_49k.json"), longest=2048, end_id=1, added=True)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()), key=str)
    assert key(found) == key(whole)


def test_mixing_stage_repeats_what_the_mix_takes(spark):
    docs = documents(spark, prose(60))
    taken = {r.row.doc_id: r.repeats for r in mixing.mix(docs).collect()}
    assert collections.Counter(r.doc_id for r in STAGES["mixing"](spark, docs, "").collect()) == collections.Counter(taken)


@pytest.mark.parametrize("rows", [[], ODD + prose(12) + ODD[:3]])
def test_all_stages_in_a_row(spark, tmp_path, rows):
    docs = documents(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(found) == bool(rows)
    by = collections.defaultdict(int)
    for r in found:
        by[r.sequence_id] += r.length
    assert all(n <= 2048 for n in by.values())
