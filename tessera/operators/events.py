"""A log of what happened: events as rows of a table that is appended to, kept within a size, and read from its end."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

LEVELS = {"off": 0, "error": 1, "info": 2, "debug": 3}
TAIL, MAX_BYTES = 400, 2 << 20
SCHEMA = "at timestamp, number long, level string, category string, message string"


class EventLog:
    """Events under a folder, a small file for each time that they are written; ``level`` says which are."""

    def __init__(self, spark: SparkSession, path: str, level: str = "error", max_bytes: int = MAX_BYTES):
        self.spark, self.path, self.level, self.max_bytes = spark, path.rstrip("/"), level, max_bytes

    def keeps(self, level: str) -> bool:
        return 0 < LEVELS[level] <= LEVELS[self.level]

    def write(self, *events: tuple[str, str, str]) -> None:
        """(level, category, message) rows, of the levels kept."""
        now = time.time_ns()
        rows = [(now + i, level, category, message) for i, (level, category, message) in enumerate(events) if self.keeps(level)]
        if rows:
            made = self.spark.createDataFrame(rows, "number long, level string, category string, message string")
            made.select(F.timestamp_seconds(F.col("number") / F.lit(1_000_000_000)).alias("at"), "number", "level", "category", "message").coalesce(1).write.mode("append").parquet(self.path)

    def append(self, events: DataFrame) -> None:
        """Events that a job gives as rows (level, category, message), with a ``number`` in their order or numbered as they come."""
        kept = events.where(F.col("level").isin([k for k in LEVELS if self.keeps(k)]))
        numbered = kept if "number" in kept.columns else kept.withColumn("number", F.lit(time.time_ns()) + F.monotonically_increasing_id())
        numbered.select(F.timestamp_seconds(F.col("number") / F.lit(1_000_000_000)).alias("at"), "number", "level", "category", "message").write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def tail(self, most: int = TAIL) -> DataFrame:
        """The last events in order: a top list kept by each task and merged."""
        last = self.read().orderBy(F.desc("number")).limit(most)
        return last.orderBy("number")

    def lines(self, most: int = TAIL) -> list[str]:
        shown = F.concat(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" ["), F.upper("level"), F.lit("] "), "category", F.lit(": "), "message")
        return [r[0] for r in self.tail(most).select(shown).collect()]

    def _files(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [f for f in fs.listStatus(where) if f.getPath().getName().endswith(".parquet")] if fs.exists(where) else []
        return fs, sorted(found, key=lambda f: (f.getModificationTime(), f.getPath().getName()))

    def rotate(self) -> int:
        """Beyond ``max_bytes`` the oldest files go until half of that is left; the number of files deleted."""
        fs, files = self._files()
        size, gone = sum(f.getLen() for f in files), 0
        if size > self.max_bytes:
            for f in files[:-1]:
                if size <= self.max_bytes // 2:
                    break
                size -= f.getLen()
                fs.delete(f.getPath(), False)
                gone += 1
        return gone


class StreamEvents(StreamingQueryListener):
    """Writes what streams do into a log: their start, each batch's rows, their end and its reason."""

    def __init__(self, log: EventLog):
        self.log = log

    def onQueryStarted(self, event):
        self.log.write(("info", "stream", f"{event.name or event.id} started"))

    def onQueryProgress(self, event):
        p = event.progress
        self.log.write(("debug", "stream", f"{p.name or p.id} batch {p.batchId}: {p.numInputRows} rows"))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.log.write(("error", "stream", f"{event.id} failed: {event.exception.splitlines()[0]}") if event.exception else ("info", "stream", f"{event.id} ended"))
