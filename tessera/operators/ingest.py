"""Ingestion of texts, files and pages: documents, passages and vectors of a batch, stored as one change each.

Failures are rows with a status, not failed jobs. A source that is taken in again
keeps its id (by address or path) and has its passages replaced."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import embedding, keyword_index, passages, vector_index
from tessera.operators.store import Change, Store

MIN_PASTED = 20
# The settings that passages and vectors depend on.
INDEX_SETTINGS = ("embedding_choice", "embedding_model", "chunk_target_tokens", "chunk_overlap_tokens", "heading_in_passages")


def source_id(key: Column) -> Column:
    """A stable id of an address, a path or a text."""
    return F.substring(F.sha2(key.cast("binary"), 256), 1, 32)


def from_texts(texts: DataFrame) -> DataFrame:
    """Sources of (title, text): under twenty characters are failed rows."""
    long_enough = F.length(F.trim("text")) >= MIN_PASTED
    return texts.select(source_id(F.concat_ws("\n", "title", "text")).alias("id"), F.lit("text").alias("kind"), "title", F.lit(None).cast("string").alias("url"), F.when(long_enough, F.col("text")).alias("text"), F.when(~F.coalesce(long_enough, F.lit(False)), "too short").alias("error"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Sources of (url, title, problem, blocks): the first of each address key."""
    keyed = pages.withColumn("key", U.dedupe_key(F.col("url")))
    text = F.array_join(F.transform("blocks", lambda b: F.when(b["kind"] == "heading", F.concat(F.repeat(F.lit("#"), b["level"]), F.lit(" "), b["text"])).otherwise(b["text"])), "\n\n")
    first = keyed.groupBy("key").agg(F.min_by(F.struct("url", "title", "problem", text.alias("text")), "url").alias("p"))
    return first.select(source_id(F.col("key")).alias("id"), F.lit("website").alias("kind"), F.coalesce("p.title", "p.url").alias("title"), "p.url", F.when(F.col("p.problem").isNull(), F.col("p.text")).alias("text"), F.col("p.problem").alias("error"))


def from_files(read: DataFrame) -> DataFrame:
    """Sources of ``sources.files.read``: pages get their marks back."""
    body = F.transform("blocks", lambda b: F.when(b["kind"] == "heading", F.concat(F.repeat(F.lit("#"), b["level"]), F.lit(" "), b["text"])).otherwise(b["text"]))
    text = F.array_join(body, "\n\n")
    return read.select(source_id(F.col("path")).alias("id"), "kind", F.regexp_extract("path", "([^/]*)$", 1).alias("title"), F.col("path").alias("url"), F.when(F.col("error").isNull() & (text != ""), text).alias("text"), F.when(F.col("error").isNotNull() | (text == ""), F.coalesce("error", F.lit("no text"))).alias("error"))


def build(sources: DataFrame, chunking: passages.Chunking = passages.Chunking(), vectors: bool = True) -> tuple[DataFrame, DataFrame]:
    """(sources with counts and status, their passages with vectors). One pass over the texts for each, no join."""
    numbered = sources.withColumn("status", F.when(F.col("text").isNull(), "failed").otherwise("ready"))
    rows = numbered.select("id", "kind", "title", "url", "status", "error", F.octet_length("text").cast("long").alias("bytes"), F.size(T.tokens(F.coalesce("text", F.lit("")))).cast("long").alias("words"), F.sha2("text", 256).alias("checksum"))
    made = passages.with_passages(numbered.where("status = 'ready'"), "id", "text", chunking).withColumnRenamed("doc_id", "source_id")
    chunks = made.select(F.concat_ws(":", "source_id", "ordinal").alias("id"), "source_id", "ordinal", "heading", "page", "start", "end", "token_count", "text")
    return rows, embedding.with_vectors(chunks) if vectors else chunks


def store_batch(store: Store, sources: DataFrame, chunking: passages.Chunking = passages.Chunking(), vectors: bool = True, batch: tuple[str, int] | None = None, also: Callable[[Change], None] | None = None) -> DataFrame:
    """Puts a batch into the store as one change; returns the batch's rows by status.

    Sources are upserted, their texts, passages (with vectors) and postings replaced: readers see all
    of these or none. What is written is the batch's own. ``batch`` (stream, number) is kept with the
    change; ``also`` may add to it."""
    rows, chunks = build(sources, chunking, vectors)
    with store.change(batch) as c:
        written, new = c.stage(rows), c.stage(chunks)
        ids = written.select(F.col("id").alias("source_id"))
        c.replace("chunks", new, ids, "source_id", "id")
        c.replace("content", sources.where(F.col("text").isNotNull()).select(F.col("id").alias("source_id"), "text"), ids, "source_id", None)
        put_postings(c, new, ids)
        c.upsert("sources", written)
        if also:
            also(c)
    return written.groupBy("status").agg(F.count("*").alias("sources"), F.sum("bytes").alias("bytes"), F.sum("words").alias("words"))


def put_postings(c: Change, passages_: DataFrame, sources: DataFrame) -> None:
    """The packed postings of sources (source_id) replaced by those of their passages (id, source_id, text), which lie by source_id already where they are a table's."""
    c.replace("postings", keyword_index.packed(passages_.withColumnRenamed("id", "chunk_id")), sources, "source_id", None, dealt=True)


def store_passages(store: Store, passages_: DataFrame, batch: tuple[str, int] | None = None) -> None:
    """Ready-made passages (id, source_id, text and more) in place of all that their sources had, as one change."""
    with store.change(batch) as c:
        new = c.replace("chunks", passages_, None, "source_id", "id")
        put_postings(c, new, new.select("source_id"))


def build_index(store: Store) -> None:
    """Makes the blocks of the keyword index, and of the vectors' where there are any, from all that the store has, as one change.

    What comes later is read beside the blocks until they are made anew."""
    with store.change() as c:
        c.fold("postings")
        rows = c.read("postings")
        whole = keyword_index.totals(rows).first()
        c.write("posting_blocks", keyword_index.blocks(rows, whole.n, whole.words))
        c.write("posting_totals", store.spark.createDataFrame([(whole.n, whole.words)], "n long, words long"))
        c.follow("postings")
        if "vector" in c.read("chunks").columns:
            c.fold("chunks")
            found = _vectors(c.read("chunks"))
            centres = vector_index.centres_of(found)
            c.write("vector_blocks", vector_index.blocks(found, centres))
            c.write("vector_centres", store.spark.createDataFrame([(i, x) for i, x in enumerate(centres.tolist())], "cell int, centre array<double>"))
            c.follow("chunks")


def _vectors(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("id").alias("chunk_id"), "source_id", "vector")


def index_of(store: Store) -> keyword_index.Index | keyword_index.BlockIndex:
    """The store's keyword index, for ``retrieval.search``: blocks where they were made, else its postings."""
    if not store.has("posting_blocks"):
        rows = keyword_index.unpacked(store.read("postings"))
        return keyword_index.Index(rows, keyword_index.statistics(rows.withColumn("bucket", F.lit(0))))
    put, gone = store.since("postings")
    return keyword_index.BlockIndex(store.read("posting_blocks"), store.read("posting_totals"), store.base("postings"), None if put is None else keyword_index.unpacked(put), gone)


def vectors_of(store: Store) -> DataFrame | vector_index.VectorIndex:
    """The store's vectors, for ``retrieval.search``: blocks where they were made, else all of them."""
    if not store.has("vector_blocks"):
        return _vectors(store.read("chunks"))
    put, gone = store.since("chunks")
    rows = store.read("vector_centres").orderBy("cell").collect()  # vector_index.CENTRES at most
    centres = np.array([r.centre for r in rows]) if rows else np.zeros((0, 0))
    return vector_index.VectorIndex(store.read("vector_blocks"), centres, None if put is None else _vectors(put), gone)


def delete_sources(store: Store, ids: DataFrame) -> None:
    """The sources (source_id) and all that hangs on them taken out, as one change."""
    with store.change() as c:
        c.delete("chunks", ids, "source_id")
        c.delete("content", ids, "source_id")
        c.delete("postings", ids, "source_id")
        c.delete("sources", ids.withColumnRenamed("source_id", "id"), "id")


def reindex(store: Store, texts: DataFrame | None = None, chunking: passages.Chunking = passages.Chunking(), parts: int = 1, token: str | None = None) -> DataFrame:
    """Passages, vectors and postings made anew from texts (id, kind, title, url, text, error), without any given from those stored.

    In several ``parts`` by the id's hash, each a change; with a ``token`` that names this reindexing, one that was cut
    short goes on with the first part that isn't in the store. Returns the counts of the parts done now."""
    if texts is None:
        texts = store.read("sources").select("id", "kind", "title", "url", "error").join(store.read("content").withColumnRenamed("source_id", "id"), "id", "left")
    done = []
    for part in range(parts):
        name = f"reindex {token}"
        if token and store.seen(name, part):
            continue
        mine = texts.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        done.append(store_batch(store, mine, chunking, batch=(name, part) if token else None))
    if not done:
        return store_batch_counts(texts.where("false"))
    return reduce(DataFrame.unionByName, done).groupBy("status").agg(*[F.sum(c).alias(c) for c in ("sources", "bytes", "words")])


def store_batch_counts(rows: DataFrame) -> DataFrame:
    """No counts, in the columns that ``store_batch`` returns."""
    return rows.select(F.lit("").alias("status"), *[F.lit(0).cast("long").alias(c) for c in ("sources", "bytes", "words")])


def needs_reindex(old: DataFrame, new: DataFrame) -> bool:
    """Whether settings (name, value) changed in what passages and vectors depend on."""
    kept = lambda df: df.where(F.col("name").isin(*INDEX_SETTINGS)).select("name", "value")
    return not kept(old).exceptAll(kept(new)).isEmpty() or not kept(new).exceptAll(kept(old)).isEmpty()


def known_source(found: DataFrame, stored: DataFrame) -> DataFrame:
    """``found`` (url, canonical) with the id of the stored source (id, url) that it renews, or null: by canonical address first, else by its own."""
    by = stored.select("id", U.dedupe_key(F.col("url")).alias("key")).groupBy("key").agg(F.min("id").alias("id"))
    first = found.withColumn("c", U.dedupe_key(F.col("canonical"))).withColumn("r", U.dedupe_key(F.col("url")))
    one = first.join(by.select(F.col("key").alias("c"), F.col("id").alias("by_canonical")), "c", "left")
    two = one.join(by.select(F.col("key").alias("r"), F.col("id").alias("by_url")), "r", "left")
    return two.withColumn("known_id", F.coalesce("by_canonical", "by_url")).drop("c", "r", "by_canonical", "by_url")


def from_results(results: DataFrame, pages: DataFrame, most: int) -> DataFrame:
    """Sources of a search's results (position, title, url, snippet) that are web pages and new by their address key,
    the first ``most``, with their pages (url, problem, blocks) where these were fetched; else the failure says so."""
    first = results.where(F.lower("url").rlike("^https?://")).withColumn("key", U.dedupe_key(F.col("url")))
    # A search gives a page of results, so all of them are one small list.
    kept = first.groupBy("key").agg(F.min_by(F.struct("position", "title", "url"), "position").alias("r")).select("key", "r.*").orderBy("position").limit(most)
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n")
    page = pages.join(F.broadcast(kept.select("url")), "url", "left_semi").groupBy("url").agg(F.min(F.struct("problem", text.alias("text"))).alias("p"))
    joined = kept.join(F.broadcast(page), "url", "left")
    return joined.select(source_id(F.col("key")).alias("id"), F.lit("website").alias("kind"), F.coalesce("title", "url").alias("title"), "url", F.when(F.col("p.problem").isNull(), F.col("p.text")).alias("text"), F.when(F.col("p").isNull(), F.lit("not fetched")).otherwise(F.col("p.problem")).alias("error"))


def dispatch(pages: DataFrame | None = None, files: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Sources of every kind as one table: pages, files (of a folder as well) and pasted texts; the first of each id."""
    made = [f(x) for f, x in ((from_pages, pages), (from_files, files), (from_texts, texts)) if x is not None]
    every = reduce(DataFrame.unionByName, made)
    return every.groupBy("id").agg(F.min(F.struct("kind", "title", "url", "text", "error")).alias("s")).select("id", "s.*")
