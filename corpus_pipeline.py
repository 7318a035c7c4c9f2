"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import jaccard, mixing, packing, suffix, toxicity
from folioscope.llm.queries import table, vocabulary
from folioscope.session import scratch_path

# Bytes of a string that is cut where it occurs twice. A passage of 50 words has about 300 bytes in the
# languages of the corpus, hardly ever less than these.
PASSAGE_BYTES = 200


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field doesn't call toxic (score below 0.7).

    The field learns from the labels of rows that are not held out, on the raw documents.
    """
    model = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.tag(docs, model).where("predicted = 0").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links on shingles of five words at a similarity of 0.8 or more."""
    return jaccard.deduplicate(docs, size=5, percent=80)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str, length: int = PASSAGE_BYTES) -> DataFrame:
    """Texts without the bytes of any string of ``length`` bytes that occurs elsewhere; ``n_chars`` follows the text.

    Every copy of such a string goes, none is kept: what many documents share is boilerplate. A
    character that loses some of its bytes goes. Documents stay, even where nothing is left.
    """
    found = suffix.cut_repeats(docs, length=length)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    columns = {"text": text, "n_chars": F.coalesce(F.length(text).cast("long"), F.col("row.n_chars"))}
    return found.select(*[columns.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources: 150 % of the words, weights 5, 2, 1 in turn, at most two epochs."""
    return mixing.mixed_documents(docs, share=1.5, weights=(5.0, 2.0, 1.0), max_epochs=2)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 2048 tokens, each a power of two long and from one document."""
    pieces = packing.pack(docs, vocabulary("word_bpe_49k.json"), longest=2048, end_id=1, added=True)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeated_strings),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The field and the tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
