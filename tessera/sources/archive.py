"""Notebook archives: ZIPs with a manifest, and passages, vectors, texts and notes as lines of JSON.

An export is a table of archives, each of about ``PART_BYTES``: the rows of all
tables are dealt to parts by a hash of their place, so that neither a large
notebook nor a long conversation makes a large archive, and each task zips its
own. A small notebook is one part. Import reads any number of archives in
tasks, gives every row a new id by its old one and joins the references over:
vectors need their passage, citations of unmapped passages become null."""

from __future__ import annotations

import io
import json
import math
import zipfile
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.render import file_name_with_id

VERSION = 1
MEMBERS = ("sources", "content", "chunks", "embeddings", "sessions", "messages", "notes")
PART_BYTES = 16 << 20
KEYS = {"sources": {"id": "source"}, "content": {"source_id": "source"}, "chunks": {"id": "chunk", "source_id": "source"}, "embeddings": {"chunk_id": "chunk", "source_id": "source"}, "sessions": {"id": "session"}, "messages": {"id": "message", "session_id": "session"}, "notes": {"id": "note"}}


def json_lines(rows: DataFrame) -> DataFrame:
    """A line of JSON for each row, fields in the order of their names."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value"))


def _zipped(title: str, schemas: dict[str, dict]):
    """Sorted rows (part, name, file, value) into one archive for each part; rows with a file are a file of their own."""

    def closed(z: zipfile.ZipFile, counts: dict[str, int]) -> None:
        z.writestr("manifest.json", json.dumps({"version": VERSION, "title": title, "counts": counts, "schemas": schemas}, sort_keys=True))
        z.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for part, mine in groupby(rows, lambda r: r[0]):
            out, counts = io.BytesIO(), dict.fromkeys(schemas, 0)
            z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
            for (name, file), some in groupby(mine, lambda r: r[1:3]):
                with z.open(file or f"{name}.jsonl", "w") as f:
                    for r in some:
                        f.write(r[3].encode() + b"\n")
                        counts[name] += not file
            closed(z, counts)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([out.getvalue()], pa.binary())], names=["part", "content"])

    return run


def export(tables: dict[str, DataFrame], title: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(part, content): the archives of the tables. Notes (id, title, body) are Markdown files as well.

    One pass counts the bytes and a second deals them out; an archive, like a task, holds ``part_bytes``."""
    names = [n for n in MEMBERS if n in tables]
    schemas = {n: json.loads(tables[n].schema.json()) for n in names}
    rows = [json_lines(tables[n]).select(F.lit(n).alias("name"), F.lit("").alias("file"), "value") for n in names]
    if "notes" in tables:
        place = F.concat(F.lit("notes/"), file_name_with_id(F.coalesce("title", F.lit("")), F.col("id").cast("string")), F.lit(".md"))
        rows.append(tables["notes"].select(F.lit("notes").alias("name"), place.alias("file"), F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("value")))
    every = reduce(DataFrame.unionByName, rows)
    parts = max(1, math.ceil((every.agg(F.sum(F.octet_length("value"))).first()[0] or 0) / part_bytes))
    drawn = every.withColumn("part", F.pmod(F.xxhash64("value", F.monotonically_increasing_id()), F.lit(parts)).cast("int"))
    sorted_ = drawn.repartition(parts, "part").sortWithinPartitions("part", "name", "file", "value").select("part", "name", "file", "value")
    return sorted_.mapInArrow(_zipped(title, schemas), "part int, content binary")


def inspect(content: bytes) -> dict:
    """The manifest alone. What is no archive, is another's or has a newer version is refused with the reason."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            manifest = json.loads(z.read("manifest.json"))
    except zipfile.BadZipFile as e:
        raise ValueError(f"the archive could not be read: {e}") from e
    except KeyError as e:
        raise ValueError("not a notebook archive: there is no manifest.json in it") from e
    if not isinstance(manifest, dict) or not {"version", "schemas"} <= set(manifest):
        raise ValueError("not a notebook archive: its manifest.json has no version or schemas")
    if manifest["version"] > VERSION:
        raise ValueError(f"the archive has version {manifest['version']}, newer than {VERSION}")
    return manifest


def members(archives: DataFrame) -> DataFrame:
    """(name, value) of every line of the tables in the archives (content), a batch of lines at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in inspect(content)["schemas"]:
                        if f"{name}.jsonl" not in z.namelist():
                            continue
                        with z.open(f"{name}.jsonl") as f:
                            while lines := f.readlines(4 << 20):
                                yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array([x.decode().rstrip("\n") for x in lines])], names=["name", "value"])

    return archives.select("content").mapInArrow(run, "name string, value string")


def load(archives: DataFrame, schemas: dict[str, StructType] | None = None, staging: str | None = None) -> dict[str, DataFrame]:
    """The archives' tables as they were exported; without ``schemas`` the first archive's manifest has them.

    With a ``staging`` folder the archives are unzipped once into it, a part for each table; without one
    every table that is used unzips them again."""
    if schemas is None:
        first = archives.select("content").first()
        schemas = {n: StructType.fromJson(x) for n, x in inspect(bytes(first.content))["schemas"].items()} if first else {}
    lines = members(archives)
    if staging:
        lines.write.partitionBy("name").parquet(staging)
        lines = archives.sparkSession.read.schema("value string, name string").parquet(staging)
    rows = {n: lines.where(F.col("name") == n).select(F.from_json("value", kind).alias("r")) for n, kind in schemas.items()}
    return {n: df.select(*[F.col("r")[c].alias(c) for c in schemas[n].names]) for n, df in rows.items()}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(content) of archive files under a folder or pattern."""
    return spark.read.format("binaryFile").load(path).select("content")


def remap(tables: dict[str, DataFrame], salt: str) -> dict[str, DataFrame]:
    """The tables with new ids, the same for the same salt; what refers to nothing is left out, citations become null."""
    new = lambda kind, col: F.substring(F.sha2(F.concat_ws(":", F.lit(salt), F.lit(kind), col.cast("string")), 256), 1, 32)
    ids = {name: tables[name].select(F.col("id").cast("string").alias("old")).distinct() for name in tables if "id" in tables[name].columns}
    home = {"source": "sources", "chunk": "chunks", "session": "sessions"}
    out = {}
    for name, df in tables.items():
        for column, kind in KEYS.get(name, {}).items():
            if column != "id" and home.get(kind) in ids:
                known = ids[home[kind]].withColumnRenamed("old", "__old")
                df = df.join(known, F.col(column).cast("string") == F.col("__old"), "left_semi")
            df = df.withColumn(column, new(kind, F.col(column)))
        if name == "messages" and "citations" in df.columns and "chunks" in ids:
            cited = df.select("id", F.posexplode_outer("citations").alias("place", "c")).join(ids["chunks"], F.col("c.chunk_id").cast("string") == F.col("old"), "left")
            fixed = cited.withColumn("c", F.when(F.col("c").isNotNull(), F.col("c").withField("chunk_id", F.when(F.col("old").isNotNull(), new("chunk", F.col("c.chunk_id"))))))
            again = fixed.where("place is not null").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "c"))), lambda x: x["c"]).alias("citations"))
            df = df.drop("citations").join(again, "id", "left")
        out[name] = df
    return out
