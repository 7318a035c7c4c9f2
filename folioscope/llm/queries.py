"""The queries of this subpackage over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import alignment, collision, html, huffman, jaccard, lexical, mixing, neighbours, packing, repetition, sharding, suffix, toxicity
from folioscope.llm.labelled import held_out
from folioscope.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_toxic_spans_crf")
def op1(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.learn(docs, table(spark, folder, "labels"))
    return toxicity.tag(docs, model).select(
        F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id").alias("held_out"), "score", "predicted", "toxic_tokens", "spans")


@query("op2_huffman_token_ids")
def op2(spark, folder):
    files = scratch_path(spark, "huffman")
    huffman.encode_corpus(table(spark, folder, "documents"), files, vocabulary("byte_bpe_50k.json"), end_id=0, added=True)
    return huffman.decode_corpus(spark, files).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op3_binary_packing")
def op3(spark, folder):
    pieces = packing.pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), longest=2048, end_id=1, added=True)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op4_ngram_jaccard_join")
def op4(spark, folder):
    return jaccard.similarity_join(table(spark, folder, "documents"), size=4, percent=85).select("doc_id", "n_shingles", "component_id")


@query("op5_collision_counting")
def op5(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return collision.search(collision.build_index(vectors, k=5), vectors.where("vec_id % 50 = 0"), k=5)


@query("op6_repetition_coverage")
def op6(spark, folder):
    return repetition.repetition(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_site_style_tree")
def op7(spark, folder):
    return html.main_text(table(spark, folder, "pages")).select("row.page_id", "row.url", "text", "n_chars")


@query("op8_quality_neighbours")
def op8(spark, folder):
    docs = table(spark, folder, "documents")
    space = neighbours.learn(docs, table(spark, folder, "labels"))
    return neighbours.score(docs, space).select(F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id").alias("held_out"), "score", "predicted")


@query("op9_suffix_repeats_removed")
def op9(spark, folder):
    return suffix.cut_repeats(table(spark, folder, "documents"), length=400).select(
        "row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


MIX_SQL = r"""
WITH base AS (
  SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || '#mix') AS hash FROM {docs}
), sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight,
    source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM sized
), levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), final AS (
  SELECT level FROM levels WHERE cap / weight >= level ORDER BY cap / weight, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT level FROM final) * weight), cap) AS target FROM levels
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets
), placed AS (
  SELECT base.*, source_size, target, whole, target - whole * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY base.source ORDER BY hash, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM base JOIN parts ON base.source IS NOT DISTINCT FROM parts.source
), repeated AS (
  SELECT *, CASE WHEN size > 0 THEN least(whole + (2 * earlier + size <= 2 * rest)::INTEGER, 2) ELSE 0 END AS repeats FROM placed
)
"""


@query("op10_capped_water_filling", MIX_SQL.format(docs="documents") + """
SELECT doc_id, size, source_size, target, (repeats * size)::BIGINT AS taken FROM repeated""")
def op10(spark, folder):
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op11_fragment_monoid_alignment")
def op11(spark, folder):
    found = alignment.align(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return found.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


SEARCH_SQL = r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS place,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}') AS terms FROM documents
), docs AS (SELECT doc_id, place, terms, len(terms)::BIGINT AS n FROM split WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS N_docs, sum(n)::BIGINT AS L FROM docs),
asked AS (
  SELECT item_id, row_number() OVER () AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}') AS terms
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
), wanted AS (SELECT item, any_value(item_id) AS item_id, term, count(*)::BIGINT AS times FROM (SELECT item, item_id, unnest(terms) AS term FROM asked) GROUP BY item, term),
words AS (SELECT DISTINCT term FROM wanted),
tf AS (
  SELECT place, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf
  FROM (SELECT place, doc_id, n, unnest(terms) AS term FROM docs) JOIN words USING (term) GROUP BY place, term
), weights AS (
  SELECT term, floor(1000 * ln(((2 * N_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals
), scored AS (
  SELECT item, any_value(item_id) AS item_id, place, any_value(doc_id) AS doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * N_docs) // L))))::BIGINT AS score
  FROM wanted JOIN tf USING (term) JOIN weights USING (term), totals GROUP BY item, place
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""".replace("{term}", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@query("op12_bag_dedup_search", SEARCH_SQL)
def op12(spark, folder):
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


@query("op13_weighted_hash_tree")
def op13(spark, folder):
    found = sharding.shard_documents(table(spark, folder, "documents"), sharding.layout(24), sharding.layout(25))
    return found.select("row.doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
