"""What the operators share: table reads, the shared scratch folder, bounded batches."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BREAKS = " \t\n\x0b\x0c\r"
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_UNSET_FOLDER = "/tmp/checkpoints"
#: Rows that may be broadcast, of a few numbers each.
FEW = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent on a single machine, as in tests, a fixed folder
    is used; on a cluster that would be each machine's own disk, so it raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _UNSET_FOLDER
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts lineage and survives the loss of any executor. The folder is
    deleted when the driver's Python ends, as what is read from it is lazy."""
    spark = df.sparkSession
    df.write.parquet(path := scratch(spark))
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    if not _kept:
        atexit.register(_forget_all)
    _kept[path] = out
    return out


_kept: dict[str, DataFrame] = {}


def _forget_all() -> None:
    for df in list(_kept.values()):
        try:
            forget(df)
        except Exception:  # noqa: BLE001 - the session may have ended first
            return


def forget(df: DataFrame) -> None:
    """Delete what ``stored`` wrote; for state that a later round replaced."""
    path = getattr(df, "_tessera_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _kept.pop(path, None)


def few(df: DataFrame, limit: int = FEW) -> DataFrame:
    """The same rows, to be broadcast where their counted number allows it."""
    return F.broadcast(df) if df.count() <= limit else df


def in_batches(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Has Spark pass ``BATCH_ROWS`` rows at a time to Python, not its own 10,000, which for long
    texts are hundreds of megabytes in either process. A setting of the session's owner stays."""

    @wraps(operator)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        conf = df.sparkSession.conf
        if conf.get(_ROWS_SETTING) == "10000":
            conf.set(_ROWS_SETTING, str(BATCH_ROWS))
        return operator(df, *args, **kwargs)

    return run


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``limit`` bytes, one row at least."""
    for batch in batches:
        values = batch.column(column)
        sizes = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if len(sizes) > start:
            yield batch.slice(start)
