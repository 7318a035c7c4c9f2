"""Vector search, answer context and keyword search."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog.base import over, query, rounded, table, tx
from folioscope.operators import retrieval
from folioscope.plans.joins import attach_lookup
from folioscope.plans.neighbours import cosine
from folioscope.session import scratch_path

# The queries are the mean vectors of the ten labels, so they come from the whole table.
CENTROIDS = """
SELECT label AS query_id, list(m ORDER BY i) AS q FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m
  FROM embeddings, range(1, 65) AS r(i) GROUP BY label, i) GROUP BY label"""
FOUND = """
SELECT query_id, vec_id, distance, r AS rank FROM (SELECT query_id, vec_id, list_distance(q, embedding::DOUBLE[]) AS distance,
  row_number() OVER (PARTITION BY query_id ORDER BY list_distance(q, embedding::DOUBLE[]), vec_id) AS r
  FROM embeddings, centros) WHERE r <= 5"""


def centroids(spark, d):
    """Mean vector per label, averaged position by position."""
    exploded = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = exploded.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    grouped = means.groupBy("label").agg(ordered.alias("v"))
    return grouped.select(F.col("label").alias("query_id"), F.transform("v", lambda e: e["m"]).alias("embedding"))


def found(spark, d, where=None):
    collection = table(spark, d, "embeddings")
    return retrieval.search(collection, centroids(spark, d), 5, key="vec_id", where=where)


def with_documents(spark, d):
    """Search results with the text and metadata of the document of the same number.

    The scan of the documents is cut to the ids found before any text is moved.
    """
    path = scratch_path(spark, "found")
    found(spark, d).write.parquet(path)
    hits = spark.read.parquet(path)
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("vec_id"), F.col("text").alias("document"), F.to_json(F.struct("lang", "source")).alias("metadata")
    )
    docs = attach_lookup(docs, hits.select("vec_id").distinct(), ["vec_id"], "left_semi")
    return hits.join(docs, "vec_id", "left")


DOCS = """
SELECT f.*, text AS document, '{"lang":"' || lang || '","source":"' || source || '"}' AS metadata
FROM encontrados f LEFT JOIN documents d ON f.vec_id = d.doc_id"""


def searched(body, **more):
    parts = {"centros": CENTROIDS, "encontrados": FOUND, **more}
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in parts.items()) + "\n" + body


@query("r1_documents_added", """
SELECT sha256(text) AS id, count(*) AS copias FROM documents GROUP BY 1""")
def r1(spark, d):
    docs = table(spark, d, "documents").select(F.col("text").alias("document"))
    collection = retrieval.add_documents(retrieval.empty_like(retrieval.with_document_ids(docs)), docs)
    return collection.groupBy("id").agg(F.count("*").alias("copias"))


@query("r2_text_embeddings")
def r2(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return retrieval.embed_texts(docs, "text").select("doc_id", F.size("embedding").alias("dimensiones"), "embedding")


@query("r2_embedding_norms", r"""
SELECT doc_id, 256 AS dimensiones, CASE WHEN regexp_matches(coalesce(text, ''), '[\p{L}\p{N}]') THEN 1.0 ELSE 0.0 END AS norma FROM documents""")
def r2b(spark, d):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return rounded(r2(spark, d).select("doc_id", "dimensiones", norm.alias("norma")), 4)


@query("r3_cosine_similarity", """
WITH centros AS (""" + CENTROIDS + """)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similitud FROM embeddings JOIN centros ON label = query_id""")
def r3(spark, d):
    centres = centroids(spark, d).select(F.col("query_id").alias("label"), F.col("embedding").alias("q"))
    rows = table(spark, d, "embeddings").join(centres, "label")
    return rounded(rows.select("vec_id", cosine(F.col("embedding"), F.col("q")).alias("similitud")), 6)


@query("r4_nearest_documents", searched("SELECT query_id, vec_id, rank, round(distance, 6) AS distance FROM encontrados"))
def r4(spark, d):
    return rounded(found(spark, d), 6)


@query("r5_filtered_search", searched("SELECT query_id, vec_id, rank, round(distance, 6) AS distance FROM filtrados", filtrados="""
SELECT query_id, vec_id, distance, r AS rank FROM (SELECT query_id, vec_id, list_distance(q, embedding::DOUBLE[]) AS distance,
  row_number() OVER (PARTITION BY query_id ORDER BY list_distance(q, embedding::DOUBLE[]), vec_id) AS r
  FROM embeddings, centros WHERE label IN (1, 2, 3)) WHERE r <= 5"""))
def r5(spark, d):
    return rounded(found(spark, d, F.col("label").isin(1, 2, 3)), 6)


@query("r6_documents_by_id", "SELECT doc_id, lang FROM documents WHERE doc_id IN (3, 5, 8)")
def r6(spark, d):
    return retrieval.by_id(table(spark, d, "documents").select("doc_id", "lang"), [3, 5, 8], "doc_id")


@query("r6_document_count", "SELECT count(*) AS documentos FROM documents")
def r6b(spark, d):
    return retrieval.count_documents(table(spark, d, "documents"))


@query("r6_collection_cleared", "SELECT doc_id FROM documents WHERE false")
def r6c(spark, d):
    path = scratch_path(spark, "collection")
    table(spark, d, "documents").select("doc_id").write.parquet(path)
    retrieval.clear(spark, path)
    return spark.read.parquet(path)


@query("r7_documents_deleted", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def r7(spark, d):
    gone = table(spark, d, "labels").where("quality = 0")
    return retrieval.delete_ids(table(spark, d, "documents").select("doc_id"), gone, "doc_id")


@query("r8_context", searched(r"""
SELECT query_id, string_agg('[Documento ' || rank || ']' || chr(10) || coalesce('Metadata: ' || metadata || chr(10), '') ||
  coalesce(document || chr(10), ''), chr(10) ORDER BY rank) AS contexto FROM textos GROUP BY 1""", textos=DOCS))
def r8(spark, d):
    return retrieval.context_blocks(with_documents(spark, d))


@query("r9_confidence", searched("""
SELECT query_id, round(greatest(0, least(1, 1 - avg(distance) / 2)), 6) AS confianza FROM encontrados GROUP BY 1"""))
def r9(spark, d):
    return rounded(retrieval.confidence(found(spark, d), centroids(spark, d)), 6)


@query("r10_sources", searched("""
SELECT query_id, rank, CASE WHEN length(document) > 200 THEN substr(document, 1, 200) || '...' ELSE document END AS content,
  round(1 - distance / 2, 6) AS relevance_score FROM textos""", textos=DOCS))
def r10(spark, d):
    shown = retrieval.sources(with_documents(spark, d))
    return rounded(shown.select("query_id", "rank", "content", "relevance_score"), 6)


@query("r11_keyword_search", over("tx", r"""
SELECT pk, sum(veces)::BIGINT AS aciertos FROM (SELECT pk, termino, count(*) AS veces FROM (SELECT pk,
    unnest(string_split_regex(upper(coalesce(municipio, '') || ' ' || coalesce(nombre_natujur, '')), '[^\p{L}\p{N}_]+')) AS termino
  FROM tx) GROUP BY 1, 2) WHERE termino IN ('NATION_7', 'MUTUO') GROUP BY pk HAVING count(*) = 2"""))
def r11(spark, d):
    index = retrieval.keyword_index(tx(spark, d), "pk", ["municipio", "nombre_natujur"])
    return retrieval.keyword_search(index, "pk", ["nation_7", "mutuo"])
