"""The driver's tables as the retrieval model: notebooks by language, sources, passages, messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import sql as S
from tessera.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan that is fewer tasks than there are cores dealt out evenly; larger inputs stay as they are.

    A small file of one row group is one task otherwise, whatever its texts cost."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source for each document: toxic ones are excluded, labelled bad ones failed."""
    labels = table(spark, sf_dir, "labels")
    docs = documents(spark, sf_dir).join(labels, "doc_id", "left")
    title = F.substring_index("text", "\n", 1)
    return docs.select(
        "doc_id",
        F.col("lang").alias("notebook"),
        T.preview(title, 60).alias("title"),
        F.col("source").alias("site"),
        F.octet_length("text").cast("long").alias("bytes"),
        F.size(T.tokens(F.col("text"))).cast("long").alias("words"),
        F.size(F.split("text", "\n")).cast("long").alias("chunk_count"),
        F.when(F.col("quality") == 0, "failed").when(F.col("quality") == 1, "ready").otherwise("partial").alias("status"),
        (F.coalesce("toxic", F.lit(0)) == 0).alias("included"),
    )


SOURCES_SQL = f"""sources AS (
  SELECT d.doc_id, lang AS notebook, {S.preview("string_split(text, chr(10))[1]", 60)} AS title, source AS site,
         strlen(text)::BIGINT AS bytes, len({S.tokens("text")})::BIGINT AS words, len(string_split(text, chr(10)))::BIGINT AS chunk_count,
         CASE quality WHEN 0 THEN 'failed' WHEN 1 THEN 'ready' ELSE 'partial' END AS status, coalesce(toxic, 0) = 0 AS included
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passage for each document, its first line as heading."""
    return passages_of(documents(spark, sf_dir))


def passages_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_id"), "text", T.preview(F.substring_index("text", "\n", 1), 60).alias("heading"), T.token_estimate(F.col("text")).alias("token_count"))


PASSAGES_SQL = f"""passages AS (
  SELECT doc_id AS chunk_id, source AS source_id, text, {S.preview("string_split(text, chr(10))[1]", 60)} AS heading, {S.token_estimate("text")} AS token_count FROM documents)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passage for each line that has text."""
    docs = documents(spark, sf_dir).select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    return docs.where(F.trim("text") != "")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
