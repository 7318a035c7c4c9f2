"""Document collection, vector search and answer context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from folioscope.plans.neighbours import nearest_to_queries


def with_document_ids(docs: DataFrame, text: str = "document") -> DataFrame:
    """Fill missing ids with a digest of the text, which a rerun gives again."""
    digest = F.sha2(F.col(text), 256)
    return docs.withColumn("id", F.coalesce(F.col("id").cast("string"), digest) if "id" in docs.columns else digest)


def add_documents(collection: DataFrame, docs: DataFrame) -> DataFrame:
    return collection.unionByName(with_document_ids(docs), allowMissingColumns=True)


def embed_texts(docs: DataFrame, text: str, size: int = 256, name: str = "embedding") -> DataFrame:
    """Hashed term weights of the whole text, scaled to unit length."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    stages = Pipeline(stages=[
        RegexTokenizer(inputCol="__text", outputCol="__tokens", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=size),
        IDF(inputCol="__tf", outputCol="__idf"),
        Normalizer(inputCol="__idf", outputCol="__unit"),
    ])
    ready = docs.withColumn("__text", F.coalesce(text, F.lit("")))
    out = stages.fit(ready).transform(ready)
    return out.select(*docs.columns, vector_to_array("__unit", "float32").alias(name))


def search(
    collection: DataFrame, queries: DataFrame, k: int = 5, key: str = "id", vector: str = "embedding",
    query_key: str = "query_id", query_vector: str = "embedding", where: Column | None = None,
    probes: int | None = None,
) -> DataFrame:
    """``k`` nearest documents of each query; the metadata filter is applied to the scan.

    ``probes`` limits the cells a query looks into; without it the search is exact.
    """
    rows = collection if where is None else collection.where(where)
    return nearest_to_queries(rows, queries, key, vector, query_key, query_vector, k, probes)


def by_id(collection: DataFrame, ids: list, key: str = "id") -> DataFrame:
    return collection.where(F.col(key).isin(ids))


def delete_ids(collection: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Collection without the given ids; the id list is counted before it may be broadcast."""
    from folioscope.plans.joins import attach_lookup

    return attach_lookup(collection, ids.select(key).distinct(), [key], "left_anti")


def count_documents(collection: DataFrame) -> DataFrame:
    return collection.agg(F.count("*").alias("documentos"))


def clear(spark: SparkSession, path: str) -> None:
    """Empty a stored collection; its columns stay."""
    empty_like(spark.read.parquet(path)).write.mode("overwrite").parquet(path)


def empty_like(collection: DataFrame) -> DataFrame:
    return collection.sparkSession.createDataFrame([], collection.schema)


def context_blocks(found: DataFrame, query_key: str = "query_id") -> DataFrame:
    """Numbered blocks with metadata and text per query; a query has ``k`` results at most.

    ``found`` carries ``rank``, ``document`` and ``metadata`` (JSON text or NULL).
    """
    parts = F.concat_ws(
        "\n",
        F.concat(F.lit("[Documento "), F.col("rank").cast("string"), F.lit("]")),
        F.when(F.col("metadata").isNotNull(), F.concat(F.lit("Metadata: "), F.col("metadata"))),
        F.col("document"),
        F.lit(""),
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", parts.alias("part"))))
    blocks = found.groupBy(query_key).agg(ordered.alias("p"))
    return blocks.select(query_key, F.array_join(F.transform("p", lambda x: x["part"]), "\n").alias("contexto"))


def confidence(found: DataFrame, queries: DataFrame, query_key: str = "query_id") -> DataFrame:
    """1 - mean distance / 2 within 0-1 per query, 0 without results."""
    means = found.groupBy(query_key).agg(F.avg("distance").alias("__mean"))
    joined = queries.select(query_key).join(means, query_key, "left")
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("__mean") / 2))
    return joined.select(query_key, F.when(F.col("__mean").isNull(), 0.0).otherwise(value).alias("confianza"))


def sources(found: DataFrame, limit: int = 200) -> DataFrame:
    """Shown excerpt and relevance of every result."""
    text = F.col("document")
    excerpt = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)
    return found.withColumns({"content": excerpt, "relevance_score": 1 - F.col("distance") / 2})


def keyword_index(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Term counts per row over the joined text columns."""
    text = F.upper(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns]))
    terms = df.select(key, F.explode(F.split(text, r"[^\p{L}\p{N}_]+")).alias("termino")).where(F.col("termino") != "")
    return terms.groupBy(key, "termino").agg(F.count("*").alias("veces"))


def keyword_search(index: DataFrame, key: str, words: list[str], n: int | None = None) -> DataFrame:
    """Rows holding every word, most hits first."""
    wanted = sorted({w.upper() for w in words})
    hits = index.where(F.col("termino").isin(wanted)).groupBy(key).agg(
        F.sum("veces").alias("aciertos"), F.count("*").alias("__terms")
    )
    found = hits.where(F.col("__terms") == len(wanted)).drop("__terms")
    return found if n is None else found.orderBy(F.desc("aciertos"), key).limit(n)


