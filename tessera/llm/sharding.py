"""Two-pass external shuffle into shards, in DataFrame functions alone.

Pass one scatters the records over memory-sized buckets by a seeded hash of the
key and of the record's place in its input task, so that equal keys and equal
texts spread out like any others. Pass two sorts a bucket (so that a repeated
attempt starts from the same order), Fisher-Yates shuffles it with Spark's
seeded ``shuffle`` and writes it to the shared folder. A record's rank in the
shuffled order, bucket by bucket, gives its shard (rank modulo the number of
shards, so counts differ by one at most: the law ``rows``) and its slot there.

The number of buckets follows the summed size, so a task never gathers more
than about ``bucket_bytes`` at once whatever the size of the input. Beyond
``TASKS`` buckets a task has several: its records are sorted by bucket, on disk
where they need be, and gathered a bucket at a time, so neither the number of
tasks nor a task's memory grows with the input.

Cases: a null text has size 1 and the checksum of no bytes; empty and very long
texts are records like any other; a null key is a key. Repeated rows are kept,
each with a slot of its own. Other columns are ignored here, whatever their
names. An empty table gives no rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import few, stored, table

SHARDS, SEED, BUCKET_BYTES = 8, 20_240_229, 32 << 20
#: Tasks of the scatter, which the driver keeps the sizes of.
TASKS = 20_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def external_shuffle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, tasks: int = TASKS) -> DataFrame:
    """(bucket, place, doc_id, text): the records, shuffled within and over the buckets, written once."""
    records = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = records.agg(F.sum(size_of(F.col("text")))).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    drawn = records.withColumn("draw", F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), F.monotonically_increasing_id()))
    tasks = min(tasks, buckets)
    numbered = drawn.withColumn("bucket", F.pmod(F.col("draw"), F.lit(buckets)).cast("int")).withColumn("task", F.col("bucket") % tasks)
    scattered = numbered.repartitionById(tasks, F.col("task"))
    # Sorted where there are many to a task: aggregation then holds one bucket at a time.
    scattered = scattered.sortWithinPartitions("task", "bucket") if tasks < buckets else scattered
    gathered = scattered.groupBy("task", "bucket").agg(F.sort_array(F.collect_list(F.struct("draw", "doc_id", "text"))).alias("all"))
    dealt = gathered.select("bucket", F.posexplode(F.shuffle("all", seed)).alias("place", "row"))
    return stored(dealt.select("bucket", F.col("place").cast("long").alias("place"), "row.doc_id", "row.text"))


def with_shards(shuffled: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Adds shard and slot to rows with bucket and place, by the rank over all buckets.

    Only the buckets' counts meet in one task: a row for each ``bucket_bytes`` of input. They are
    broadcast where their number is small enough, so the records stay where they are read."""
    counts = shuffled.groupBy("bucket").agg(F.count("*").alias("rows"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("begin"))
    rank = F.col("begin") + F.col("place")
    ranked = shuffled.join(few(stored(starts)), "bucket")
    return ranked.withColumn("shard", (rank % shards).cast("int")).withColumn("slot", F.floor(rank / shards).cast("long")).drop("begin")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, its records with their slots."""
    sharded.drop("bucket", "place").write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law ``rows``, from the records as written."""
    written = external_shuffle(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    digests = written.select("bucket", "place", "doc_id", size_of(F.col("text")).alias("size"), crc.alias("text_crc32"))
    return with_shards(digests).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
