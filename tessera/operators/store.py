"""The library store: tables as Parquet folders, upserts, replacement, cascades, checks.

A table with a key is kept in folders by the key's hash. A change writes what it
brings, rows and the keys whose earlier rows are gone, and then one manifest that
names the folders of all tables; readers put the changes over the table
(``with_changes``). So a small change costs its own bytes, whatever the table's size.
``fold`` is the job that writes the changes into the buckets that they touch.

Manifests are numbered, written once and never changed; the largest whole one is
current, and a change takes the number after the largest there is, whole or not. So
readers see all of a change or nothing of it, however many tables it spans, and a
failed write leaves everything as it was and stands in nobody's way. A change may
carry the number of a stream's batch, which is kept with it: a batch that is tried
again finds itself there.

Two writers at once: the second to take a number fails and its change is lost,
as with any store that has one writer."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager
from collections.abc import Iterator

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

SCHEMA_VERSION = 1
#: Columns that an upsert of an existing row leaves as they were.
IMMUTABLE = {
    "notebooks": ("created_at",),
    "sources": ("notebook_id", "kind", "added_at"),
    "sessions": ("created_at", "notebook_id"),
    "messages": ("role", "session_id", "created_at"),
    "notes": ("created_at",),
    "settings": (),
}
#: For each parent, its children and their key.
CHILDREN = {
    "notebooks": (("sources", "notebook_id"), ("chunks", "notebook_id"), ("embeddings", "notebook_id"), ("sessions", "notebook_id"), ("notes", "notebook_id")),
    "sources": (("chunks", "source_id"), ("embeddings", "source_id")),
    "sessions": (("messages", "session_id"),),
}


def last_of_each(rows: DataFrame, key: str, latest: str | None = None) -> DataFrame:
    """A row for each key: that with the largest ``latest``, of equal ones (or without it) the largest in the order of the columns."""
    rest = [c for c in rows.columns if c not in (latest, key)]
    first = [latest] if latest and latest != key else []
    if not rest and not first:
        return rows.distinct()
    # Grouped by the key's own name, so that a join by it takes the partitioning as it is.
    found = rows.groupBy(key).agg(F.max(F.struct(*first, *rest)).alias("__row"))
    return found.select(*[F.col(c) if c == key else F.col("__row")[c].alias(c) for c in rows.columns])


def upsert(old: DataFrame, new: DataFrame, key: str = "id", immutable: tuple[str, ...] = (), latest: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in: existing keys are replaced but for immutable columns.

    A key that ``new`` repeats is put in once, by ``last_of_each``; rows without a key are left out."""
    n, o = last_of_each(new.where(F.col(key).isNotNull()), key, latest).alias("n"), old.alias("o")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    is_new, is_old = F.col(f"n.{key}").isNotNull(), F.col(f"o.{key}").isNotNull()
    pick = lambda c: F.when(is_new & ~(is_old & F.lit(c in immutable)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*[pick(c).alias(c) for c in old.columns])


def _without_repeats(rows: DataFrame, key: str | None) -> None:
    if key and not rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"repeated {key}")


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, parent_key: str, key: str | None) -> DataFrame:
    """``old`` without the children of ``parents`` (also where ``new`` has none) and with ``new``.

    Raises ValueError where ``new`` repeats a key; the old rows then stand."""
    _without_repeats(new, key)
    return old.join(parents.select(parent_key).distinct(), parent_key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


CHANGE = "__change"


def with_changes(base: DataFrame, put: DataFrame | None, gone: DataFrame | None, key: str, immutable: tuple[str, ...] | None = None) -> DataFrame:
    """A table as its changes leave it.

    ``put`` has rows with the number of their change (``CHANGE``), ``gone`` keys of which all rows before their change
    are gone. With ``immutable`` a key has one row, the last, in which these columns are as they first were; without,
    it has those of ``base`` and ``put`` that are not gone. The table itself is only filtered by the changes' keys."""
    columns = base.columns
    immutable = None if immutable is None else tuple(c for c in immutable if c in columns)
    keys = [df.select(key) for df in (put, gone) if df is not None and (df is gone or immutable is not None)]
    if put is None and gone is None:
        return base
    last = None if gone is None else gone.groupBy(key).agg(F.max(CHANGE).alias("__gone"))
    touched = None if not keys else (keys[0] if len(keys) == 1 else keys[0].union(keys[1])).distinct()
    rest = base if touched is None else base.join(touched, key, "left_anti")
    if put is None:
        return rest.select(*columns)
    new = put
    if immutable:
        new = put.unionByName(base.join(touched, key, "left_semi").withColumn(CHANGE, F.lit(0).cast("long")))
    if last is not None:
        new = new.join(last, key, "left").where(F.col(CHANGE) >= F.coalesce("__gone", F.lit(0)))
    if immutable is not None:
        others = [c for c in columns if c != key]
        kept = [F.min_by(F.struct(*immutable), CHANGE).alias("__first")] if immutable else []
        new = new.groupBy(key).agg(F.max_by(F.struct(*others), CHANGE).alias("__last"), *kept) if others else new.select(key).distinct()
        new = new.select(*[F.col(c) if c == key else F.col("__first" if c in immutable else "__last")[c].alias(c) for c in columns])
    return rest.select(*columns).unionByName(new.select(*columns))


def delete_cascade(tables: dict[str, DataFrame], parent: str, gone: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """Tables without the ``gone`` keys (column ``key``) of ``parent`` and without what hangs on these."""
    out = dict(tables)
    ids = gone.select(F.col(key).alias("__id")).distinct()
    out[parent] = out[parent].join(ids, F.col(key) == F.col("__id"), "left_anti")
    for child, column in CHILDREN.get(parent, ()):
        if child in out:
            lost = out[child].join(ids, F.col(column) == F.col("__id"), "left_semi")
            if child in CHILDREN:
                out = {**out, **{k: v for k, v in delete_cascade(out, child, lost).items() if k != child}}
            out[child] = out[child].join(ids, F.col(column) == F.col("__id"), "left_anti")
    return out


def orphans(child: DataFrame, parent: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Rows of ``child`` whose parent isn't there."""
    return child.join(parent.select(F.col(key).alias(column)), column, "left_anti")


def touch(rows: DataFrame, row_id, now: Column, opened: bool, key: str = "id") -> DataFrame:
    """A row's updated_at, and last_opened_at where it was opened, set to ``now``."""
    here = F.col(key) == row_id
    out = rows.withColumn("updated_at", F.when(here, now).otherwise(F.col("updated_at")))
    return out.withColumn("last_opened_at", F.when(here, now).otherwise(F.col("last_opened_at"))) if opened else out


#: Buckets of a table to begin with, and the bytes of one beyond which the table is dealt to twice as many.
BUCKETS = 8
BUCKET_BYTES = 1 << 30
#: Files in row groups of 16 MB, so that a file is several tasks' to read.
WRITTEN = {"compression": "zstd", "parquet.block.size": 16 << 20}


class Store:
    """Versioned tables under one folder, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._manifest()

    def _fs(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _names(self, name: str) -> list[str]:
        fs, where = self._fs(name)
        return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []

    def bytes_of(self, folder: str) -> int:
        fs, where = self._fs(folder)
        return fs.getContentSummary(where).getLength() if fs.exists(where) else 0

    def _read_text(self, name: str) -> str:
        fs, where = self._fs(name)
        stream = fs.open(where)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _numbers(self) -> list[int]:
        """The manifests' numbers, the largest first, whole or not."""
        return sorted((int(n[:-5]) for n in self._names("_manifests") if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def _manifest(self) -> tuple[int, dict]:
        """The number and content of the current manifest; one that isn't whole is passed over."""
        for number in self._numbers():
            try:
                found = json.loads(self._read_text(f"_manifests/{number:012d}.json"))
            except json.JSONDecodeError:
                continue
            if found["schema_version"] > SCHEMA_VERSION:
                raise ValueError(f"the store has schema {found['schema_version']}, newer than {SCHEMA_VERSION}")
            return number, found
        return 0, {"schema_version": SCHEMA_VERSION, "buckets": self.buckets, "tables": {}}

    def _commit(self, number: int, manifest: dict) -> None:
        """A new file, which may not exist already: of two writers one gets the number."""
        fs, where = self._fs(f"_manifests/{number:012d}.json")
        out = fs.create(where, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    @contextmanager
    def change(self, batch: tuple[str, int] | None = None) -> Iterator[Change]:
        """Changes of any number of tables that become visible together, at the end; an error leaves all as it was.

        ``batch`` (stream, number) is kept with the change, for ``seen``."""
        _, manifest = self._manifest()
        number = max(self._numbers(), default=0) + 1
        made = Change(self, manifest)
        yield made
        if batch:
            streams = manifest.setdefault("streams", {})
            streams[batch[0]] = max(batch[1], streams.get(batch[0], -1))
        if made.touched or batch:
            self._commit(number, manifest)

    def seen(self, stream: str, number: int) -> bool:
        """Whether a stream's batch was put in; batches come in order."""
        return number <= self._manifest()[1].get("streams", {}).get(stream, -1)

    def folders(self, table: dict, buckets: list[int] | None = None) -> list[str]:
        return [f"{self.path}/{f}" for b, f in table["folders"].items() if buckets is None or int(b) in buckets]

    def _of(self, schema: StructType, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _base(self, table: dict, buckets: list[int] | None = None) -> DataFrame:
        """A table without its changes."""
        return self._of(StructType.fromJson(table["schema"]), self.folders(table, buckets))

    def _put_and_gone(self, table: dict) -> tuple[DataFrame | None, DataFrame | None]:
        """The rows and keys of a table's changes, with their numbers."""
        schema, changes = StructType.fromJson(table["schema"]), table.get("changes", [])
        number = StructField(CHANGE, LongType())
        found = []
        for kind, fields in (("put", [*schema.fields, number]), ("gone", [f for f in schema.fields if f.name == table["key"]] + [number])):
            paths = [f"{self.path}/{c[kind]}" for c in changes if c.get(kind)]
            found.append(self._of(StructType(fields), paths) if paths else None)
        return found[0], found[1]

    def _rows(self, name: str, table: dict, buckets: list[int] | None = None) -> DataFrame:
        immutable = IMMUTABLE.get(name, ()) if table.get("unique") else None
        return with_changes(self._base(table, buckets), *self._put_and_gone(table), table["key"], immutable)

    def read(self, name: str) -> DataFrame:
        tables = self._manifest()[1]["tables"]
        if name not in tables:
            raise KeyError(name)
        return self._rows(name, tables[name])

    def has(self, name: str) -> bool:
        return name in self._manifest()[1]["tables"]

    def base(self, name: str) -> DataFrame:
        """A table without its changes."""
        return self._base(self._manifest()[1]["tables"][name])

    def since(self, name: str) -> tuple[DataFrame | None, DataFrame | None]:
        """The rows that a table's changes put in and left, and the keys whose rows in the table itself are gone."""
        table = self._manifest()[1]["tables"][name]
        put, gone = self._put_and_gone(table)
        live = None if put is None else with_changes(self._of(StructType.fromJson(table["schema"]), []), put, gone, table["key"])
        return live, None if gone is None else gone.select(table["key"]).distinct()

    def write(self, name: str, rows: DataFrame, key: str | None = None) -> DataFrame:
        with self.change() as c:
            c.write(name, rows, key)
        return self.read(name)

    def upsert(self, name: str, new: DataFrame, key: str = "id", latest: str | None = None) -> DataFrame:
        with self.change() as c:
            c.upsert(name, new, key, latest)
        return self.read(name)

    def sql(self, query: str, args: dict | list | None = None) -> DataFrame:
        """A query over the store's tables by their names, with named (``:x``) or positional (``?``) parameters.

        It is parsed as a part of a query, so a statement that defines or changes something is refused before it runs.
        Its tables are those of one manifest, under names of their own in the session while the query is analysed."""
        _, manifest = self._manifest()
        token, whole = f"s{uuid.uuid4().hex}", {}
        for name, table in manifest["tables"].items():
            self._rows(name, table).createOrReplaceTempView(f"{token}_{name}")
            whole[name] = f"{name} AS (SELECT * FROM {token}_{name})"
        try:
            named = f"WITH {', '.join(whole.values())} " if whole else ""
            return self.spark.sql(f"{named}SELECT * FROM (\n{query}\n)", args)
        except ParseException as e:
            raise ValueError(f"not a query: {query.strip()[:80]}") from e
        finally:
            for name in whole:
                self.spark.catalog.dropTempView(f"{token}_{name}")

    def fold(self, *names: str, bucket_bytes: int = BUCKET_BYTES) -> None:
        """The changes of tables (of all but those that an index follows) written into the buckets they touch."""
        with self.change() as c:
            for name, table in c.manifest["tables"].items():
                if name in names and table.get("followed"):
                    raise ValueError(f"an index follows {name}: it is folded when the index is made anew")
                if name in names or not (names or table.get("followed")):
                    c.fold(name, bucket_bytes)

    def vacuum(self) -> int:
        """Folds changes, deletes older manifests and the folders that the current one doesn't name; returns the number
        of folders. Readers of older manifests must be done."""
        self.fold()
        number, manifest = self._manifest()
        live = {f for t in manifest["tables"].values() for f in t["folders"].values()}
        live |= {c[k] for t in manifest["tables"].values() for c in t.get("changes", []) for k in ("put", "gone") if c.get(k)}
        gone = 0
        for name in [n for n in self._names("") if n != "_manifests"]:
            for version in self._names(name):
                inner = [f"{name}/{version}/{b}" for b in self._names(f"{name}/{version}") if b.startswith("bucket=")]
                dead = [f for f in inner or [f"{name}/{version}"] if f not in live]
                for f in [f"{name}/{version}"] if len(dead) == len(inner or [0]) else dead:
                    fs, where = self._fs(f)
                    fs.delete(where, True)
                gone += len(dead)
        for old in self._names("_manifests"):
            if old.endswith(".json") and int(old[:-5]) < number:
                fs, where = self._fs(f"_manifests/{old}")
                fs.delete(where, False)
        return gone


class Change:
    """What one change writes; ``Store.change`` makes it visible."""

    def __init__(self, store: Store, manifest: dict):
        self.store, self.manifest, self.touched = store, manifest, set()

    def bucket(self, key: str, buckets: int | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets or self.manifest["buckets"])).cast("int")

    def _table(self, name: str) -> dict:
        if name not in self.manifest["tables"]:
            raise KeyError(name)
        return self.manifest["tables"][name]

    def _buckets(self, table: dict) -> int:
        return table.get("buckets") or self.manifest["buckets"]

    def _plain(self, name: str, rows: DataFrame) -> str:
        """Rows written to a folder of their own."""
        version = f"{name}/{uuid.uuid4().hex}"
        rows.write.options(**WRITTEN).parquet(f"{self.store.path}/{version}")
        return version

    def _put(self, name: str, rows: DataFrame, bucket: Column | None, sort: tuple[str, ...] = (), dealt: bool = False) -> dict[str, str]:
        """Writes rows to a new version; the folder of each bucket that has any. Rows that were ``dealt``, as read from another table's buckets, are not shuffled."""
        if bucket is None:
            return {"0": self._plain(name, rows)}
        version = f"{name}/{uuid.uuid4().hex}"
        # Rebalanced, so that a bucket with a third of all rows is more than one task's.
        placed = rows.withColumn("bucket", bucket)
        placed = placed if dealt else placed.hint("rebalance", "bucket")
        placed = placed.sortWithinPartitions("bucket", *sort) if sort else placed
        placed.write.options(**WRITTEN).partitionBy("bucket").parquet(f"{self.store.path}/{version}")
        return {n[len("bucket=") :]: f"{version}/{n}" for n in self.store._names(version) if n.startswith("bucket=")}

    def _add(self, name: str, put: DataFrame | None, gone: DataFrame | None, check: str | None = None, own: bool = False) -> DataFrame | None:
        """Rows and gone keys of a table with their number, which grows with each that the store has taken; returns the rows as written.

        ``check`` is a key that the rows may not repeat; with ``own`` the gone keys are those of the rows."""
        table = self._table(name)
        number, rows = self.manifest.get("operations", 0) + 1, None
        written, schema = {"n": number}, StructType.fromJson(table["schema"])
        if put is not None:
            written["put"] = self._plain(name, put.select(*schema.names).withColumn(CHANGE, F.lit(number).cast("long")))
            rows = self.store._of(schema, [f"{self.store.path}/{written['put']}"])
            _without_repeats(rows, check)
            gone = rows if own else gone
        self.manifest["operations"] = number
        if gone is not None:
            written["gone"] = self._plain(name, gone.select(table["key"]).distinct().withColumn(CHANGE, F.lit(number).cast("long")))
        table.setdefault("changes", []).append(written)
        self.touched.add(name)
        return rows

    def follow(self, name: str) -> None:
        """From now on what an index was made of is folded with the index alone, which reads the changes since."""
        self._table(name)["followed"] = True

    def stage(self, rows: DataFrame) -> DataFrame:
        """Rows written once, for use by several tables of a change; ``vacuum`` deletes them."""
        path = f"{self.store.path}/_staged/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.store.spark.read.schema(rows.schema).parquet(path)

    def read(self, name: str) -> DataFrame:
        """A table as this change has it so far."""
        return self.store._rows(name, self._table(name))

    def has(self, name: str) -> bool:
        return name in self.manifest["tables"]

    def buckets_of(self, rows: DataFrame, key: str, buckets: int | None = None) -> list[int]:
        """The buckets that the keys fall into: as many numbers as there are buckets at most."""
        return [r.b for r in rows.select(self.bucket(key, buckets).alias("b")).distinct().collect()]

    def write(self, name: str, rows: DataFrame, key: str | None = None, sort: tuple[str, ...] = (), buckets: int | None = None, unique: bool = False) -> None:
        """The whole table anew, in as many buckets as its size needs."""
        self._take(name, self._whole(name, rows, key, sort, buckets, unique))

    def _take(self, name: str, table: dict) -> None:
        self.manifest["tables"][name] = table
        self.touched.add(name)

    def _whole(self, name: str, rows: DataFrame, key: str | None, sort: tuple[str, ...] = (), buckets: int | None = None, unique: bool = False, dealt: bool = False) -> dict:
        """A table written, which the change hasn't taken yet."""
        folders = self._put(name, rows, self.bucket(key, buckets) if key else None, sort, dealt)
        if key and (needed := self._needed(folders, buckets or self.manifest["buckets"])) > (buckets or self.manifest["buckets"]):
            buckets, again = needed, self.store._of(rows.schema, [f"{self.store.path}/{f}" for f in folders.values()])
            folders = self._put(name, again, self.bucket(key, buckets), sort)
        return {"key": key, "sort": list(sort), "schema": rows.schema.jsonValue(), "folders": folders, "buckets": buckets, "unique": unique, "changes": [], "followed": bool(self.manifest["tables"].get(name, {}).get("followed"))}

    def upsert(self, name: str, new: DataFrame, key: str = "id", latest: str | None = None) -> None:
        """Rows put in by key; only they are written."""
        rows = last_of_each(new.where(F.col(key).isNotNull()), key, latest)
        if not self.has(name):
            self.write(name, rows, key, unique=True)
            return
        self._keyed(name, key)["unique"] = True
        self._add(name, rows, None)

    def _keyed(self, name: str, key: str) -> dict:
        table = self._table(name)
        if table["key"] != key:
            raise ValueError(f"{name} is kept by {table['key']}, not by {key}")
        return table

    def replace(self, name: str, new: DataFrame, parents: DataFrame | None, parent_key: str, key: str | None, sort: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
        """The parents' children replaced by ``new`` in a table kept by ``parent_key``; ValueError where ``new`` repeats a key.

        Without ``parents`` they are those of ``new``. Returns the new rows as written, so that ``new`` is computed once. ``dealt`` is as in ``_put``."""
        if not self.has(name):
            table = self._whole(name, new, parent_key, sort, dealt=dealt)
            rows = self.store._base(table)
            _without_repeats(rows, key)
            self._take(name, table)
            return rows
        self._keyed(name, parent_key)
        return self._add(name, new, parents, key, parents is None)

    def delete(self, name: str, parents: DataFrame, parent_key: str) -> None:
        """The rows of the parents taken out of a table kept by ``parent_key``."""
        self._keyed(name, parent_key)
        self._add(name, None, parents)

    def _needed(self, folders: dict[str, str], buckets: int, bucket_bytes: int = BUCKET_BYTES) -> int:
        size = sum(self.store.bytes_of(f) for f in folders.values())
        while size > bucket_bytes * buckets:
            buckets *= 2
        return buckets

    def fold(self, name: str, bucket_bytes: int = BUCKET_BYTES) -> None:
        """A table's changes written into the buckets they touch, or into more buckets where these have grown too large."""
        table = self._table(name)
        put, gone = self.store._put_and_gone(table)
        keys = [df.select(table["key"]) for df in (put, gone) if df is not None]
        if not keys:
            return
        buckets = self._needed(table["folders"], self._buckets(table), bucket_bytes)
        sort = tuple(table["sort"])
        if buckets != self._buckets(table):
            self.write(name, self.read(name), table["key"], sort, buckets, bool(table.get("unique")))
            return
        touched = self.buckets_of(keys[0] if len(keys) == 1 else keys[0].union(keys[1]), table["key"], buckets)
        folders = self._put(name, self.store._rows(name, table, touched), self.bucket(table["key"], buckets), sort)
        table["folders"] = {b: f for b, f in table["folders"].items() if int(b) not in touched} | folders
        table["changes"] = []
        self.touched.add(name)
