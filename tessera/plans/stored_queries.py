"""Queries that write a library of the driver's tables and read it: stored postings and vectors in blocks, changes.

The library is written once for a session and a table folder, under ``spark.checkpoint.dir`` or, on a single machine
without it, under /tmp, and deleted when the driver's Python ends."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ingest
from tessera.operators import retrieval as R
from tessera.operators.store import Store
from tessera.plans import retrieval_queries as Q
from tessera.plans import store_queries
from tessera.plans.views import documents, lines, passages, passages_of, vectors

_made: dict[tuple[str, str, str], Store] = {}
_folders: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, deleted when the driver's Python ends; on a cluster its parent has to be named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/checkpoints"
    if not _folders:
        atexit.register(_forget_all)
    _folders.append((spark, f"{base.rstrip('/')}/tessera-library-{uuid.uuid4().hex}"))
    return _folders[-1][1]


def _forget_all() -> None:
    for spark, path in _folders:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may have ended first
            return


def library(spark: SparkSession, sf_dir: str, purpose: str = "ask", index: bool = True) -> Store:
    """A store of every passage, with its vector where there is one, and, unless it isn't asked for, its index."""
    key = (spark.sparkContext.applicationId, sf_dir, purpose)
    if key not in _made:
        store = Store(spark, scratch(spark))
        # Vectors are what is hashed, so that texts are not sorted for the join.
        rows = passages(spark, sf_dir).join(vectors(spark, sf_dir).hint("shuffle_hash"), "chunk_id", "left").withColumnRenamed("chunk_id", "id")
        # Every passage is a source of its own where one is to be replaced by itself.
        rows = rows.withColumn("source_id", F.col("id").cast("string")) if purpose == "replace" else rows
        ingest.store_passages(store, rows)
        _made[key] = store
    if index and not _made[key].has("posting_blocks"):
        ingest.build_index(_made[key])
    return _made[key]


def stored_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best passages from the stored blocks of the question's terms."""
    best = ingest.index_of(library(spark, sf_dir)).top(Q.TERMS, 20)
    return spark.createDataFrame([(r.chunk_id, round(r.keyword, 6), n) for n, r in enumerate(best, 1)], "chunk_id long, score double, rank int")


def stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage's score from the stored blocks."""
    return ingest.index_of(library(spark, sf_dir)).scores(Q.TERMS).select("chunk_id", F.round("keyword", 6).alias("score"))


def stored_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels from stored blocks, fused."""
    store = library(spark, sf_dir)
    channel = ingest.vectors_of(store).channel(Q._probe(spark, sf_dir))
    chunk_id = store.read("chunks").withColumnRenamed("id", "chunk_id").schema["chunk_id"]
    found = R.fuse(channel, ingest.index_of(store).top(Q.TERMS, 40), 40, chunk_id).rows
    return found.select("chunk_id", F.round("semantic", 6).alias("semantic"), F.round("keyword", 6).alias("keyword"), F.round("fused", 6).alias("fused"))


def stored_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole retrieval from the store: the blocks of both channels, then the passages of the short list by their ids."""
    store, question = library(spark, sf_dir), " ".join(Q.TERMS)
    chunks = store.read("chunks").withColumnRenamed("id", "chunk_id")
    score = lambda c: c.withColumn("effective", F.round(R.lexical_score(question, F.col("text"), F.col("heading"), F.col("token_count"), F.col("fused")), 9))
    out = R.retrieve(chunks, ingest.vectors_of(store), question, Q._probe(spark, sf_dir), R.Settings(budget=12_000), score, index=ingest.index_of(store))
    return out.select("chunk_id", "source_id", F.round("fused", 6).alias("fused"), F.round("effective", 6).alias("effective"), "rank", F.col("used_tokens").cast("long").alias("used_tokens"))


def stored_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores after the texts of one language changed: a change beside the blocks, which stay as they are."""
    store = library(spark, sf_dir, "replace")
    changed = passages_of(documents(spark, sf_dir).where("lang = 'de'"))
    new = changed.withColumnRenamed("chunk_id", "id").withColumn("text", F.concat("text", F.lit(" inand the inand"))).withColumn("source_id", F.col("id").cast("string"))
    ingest.store_passages(store, new.join(store.read("chunks").where("vector is not null").select("id", "vector").hint("shuffle_hash"), "id", "left"))
    return ingest.index_of(store).scores(Q.TERMS).select("chunk_id", F.round("keyword", 6).alias("score"))


def stored_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``upsert_sources`` through a store: changed ones and then new ones are put in, and read over the table."""
    old, changed = store_queries._library(spark, sf_dir)
    store = Store(spark, scratch(spark), buckets=8)
    store.write("sources", old, "id")
    store.upsert("sources", changed)
    return store.upsert("sources", changed.withColumn("id", F.col("id") + 1_000_000_000))


def stored_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of ``replace_chunks`` through a store: those of every fifth document replaced, then of every tenth taken out, folded."""
    rows = lines(spark, sf_dir).select(F.concat_ws(":", "doc_id", "ordinal").alias("chunk_id"), F.col("doc_id").alias("source_id"), F.length("text").cast("long").alias("n_chars"))
    parents = documents(spark, sf_dir).where("doc_id % 5 = 0").select(F.col("doc_id").alias("source_id"))
    new = parents.select(F.concat_ws(":", F.col("source_id"), F.lit("new")).alias("chunk_id"), "source_id", F.lit(0).cast("long").alias("n_chars"))
    store = Store(spark, scratch(spark), buckets=8)
    store.write("chunks", rows, "source_id")
    with store.change() as c:
        c.replace("chunks", new, parents, "source_id", "chunk_id")
    with store.change() as c:
        c.delete("chunks", parents.where("source_id % 10 = 0"), "source_id")
    store.fold("chunks")
    return store.read("chunks").groupBy("source_id").agg(F.count("*").alias("n_chunks"), F.sum("n_chars").alias("n_chars"))


QUERIES = {f.__name__: f for f in (stored_bm25, stored_scores, stored_fusion, stored_retrieve, stored_replace, stored_upserts, stored_children)}


def _owned(sql: str) -> str:
    """The same over the vectors that a passage has: a store keeps no others."""
    return sql.replace("FROM embeddings, probe)", "FROM embeddings JOIN documents ON vec_id = doc_id, probe)")


SQL = {
    "stored_bm25": Q._BASE + ", top AS (SELECT chunk_id, keyword, row_number() OVER (ORDER BY keyword DESC, chunk_id)::INT AS rank FROM bm) SELECT chunk_id, round(keyword, 6) AS score, rank FROM top WHERE rank <= 20",
    "stored_scores": Q.SQL["bm25_all"],
    "stored_fusion": _owned(Q.SQL["rrf_fusion"]),
    "stored_retrieve": _owned(Q.SQL["hybrid_retrieve"]),
    "stored_replace": Q.SQL["index_replace"],
    "stored_upserts": store_queries.SQL["upsert_sources"],
    "stored_children": store_queries.SQL["replace_chunks"],
}
