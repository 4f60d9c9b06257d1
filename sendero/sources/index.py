"""Vector collections as Parquet tables.

A collection is a folder

    data/<write>/b=<bucket>/part-*.parquet    what one write added
    manifests/manifest-<version>.json         which folders make up a version

Rows lie in buckets by the hash of their id.  A write puts its files below a
folder of its own and then publishes the next manifest under a name that must
be free, so of two writers that began on the same version one publishes and
the other gets ``ConcurrentWrite`` and deletes only what it wrote itself.  A
reader holds one manifest: it sees a write whole or not at all.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sendero.functions import fixed
from sendero.sources.schemas import PLACE_METADATA, USER_METADATA, index_schema
from sendero.session import drop_written, write_once

PLACES = "lugares_turisticos"
USERS = "perfiles_usuarios"

# A collection whose buckets pass this many rows on average doubles their
# number (ids are distinct, so no bucket holds much more than the others).
BUCKET_ROWS = 100_000
# A bucket of so many folders is written anew by the next append to it.
BUCKET_FOLDERS = 8
# Versions whose folders are kept, the current one included.
KEPT_VERSIONS = 2


class ConcurrentWrite(RuntimeError):
    """Another writer published the version that this write was to become."""


class _Store:
    """The few file operations of a commit, by Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self._fs = self._path(root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]

    def older(self, folder: str, millis: int) -> list[str]:
        """Names in the folder that nothing has touched since ``millis``."""
        if not self._fs.exists(self._path(folder)):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(folder)) if s.getModificationTime() < millis]

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self._fs.create(self._path(path), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """The text under a name that must be free, whole from the first
        moment; False where the name is taken.  A rename that doesn't
        overwrite is atomic on HDFS; a local one does overwrite, a link doesn't.
        Stores without either need a lock of their own."""
        draft = f"{path}.{uuid.uuid4().hex}"
        self.write(draft, text)
        try:
            if self._fs.getUri().getScheme() == "file":
                local = [unquote(urlparse(self._fs.makeQualified(self._path(p)).toString()).path) for p in (draft, path)]
                try:
                    os.link(*local)
                except FileExistsError:
                    return False
                return True
            files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
            no_overwrite = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            try:
                files.rename(self._path(draft), self._path(path), no_overwrite)
            except Exception:
                if self._fs.exists(self._path(path)):
                    return False
                raise
            return True
        finally:
            self.delete(draft)

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


class VectorIndex:
    """A collection at ``path``.  A write that fails midway leaves it as it
    was; its folder is never named by a manifest and goes with ``vacuum``.

    Upserts write the buckets of their ids anew and leave all others alone;
    appends add a folder to the buckets of the new ids.  The driver holds a
    manifest: one entry for each folder of a bucket, so 10^9 rows make 10^4 to
    10^5 short entries."""

    def __init__(self, spark: SparkSession, path: str, metadata: T.StructType, bucket_rows: int = BUCKET_ROWS):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = index_schema(metadata)
        self.bucket_rows = bucket_rows
        self._files = _Store(spark, self.path)

    # manifests ----------------------------------------------------------------
    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/manifest-{version:08d}.json"

    def _current(self) -> dict | None:
        """The latest manifest: version, buckets (their number), folders
        ([bucket, folder, rows] for each)."""
        names = [n for n in self._files.names(f"{self.path}/manifests") if n.startswith("manifest-") and n.endswith(".json")]
        return json.loads(self._files.read(f"{self.path}/manifests/{max(names)}")) if names else None

    def _publish(self, base: dict | None, buckets: int, folders: list, write: str | None) -> dict:
        """The next manifest after ``base``, or ``ConcurrentWrite``."""
        made = {"version": base["version"] + 1 if base else 1, "buckets": buckets, "folders": folders}
        if not self._files.publish(self._manifest_path(made["version"]), json.dumps(made)):
            if write:
                self._files.delete(f"{self.path}/data/{write}")
            raise ConcurrentWrite(f"version {made['version']} of {self.path} was published by another writer")
        self._retire(made)
        return made

    def _retire(self, current: dict) -> None:
        """Delete the folders that only the version leaving the kept ones
        names.  Its manifest stays as an empty file, so that a late writer
        can't publish under its name; folders no manifest ever named may be
        another writer's unfinished ones and are left alone."""
        leaving = current["version"] - KEPT_VERSIONS
        if leaving < 1:
            return
        old = self._files.read(self._manifest_path(leaving))
        kept = {f for v in range(leaving + 1, current["version"]) for f in self._folders_of(v)}
        kept |= {f for _, f, _ in current["folders"]}
        if old.strip():
            for _, folder, _ in json.loads(old)["folders"]:
                if folder not in kept:
                    self._files.delete(f"{self.path}/data/{folder}")
            self._files.write(self._manifest_path(leaving), "")

    def _folders_of(self, version: int) -> set[str]:
        text = self._files.read(self._manifest_path(version))
        return {f for _, f, _ in json.loads(text)["folders"]} if text.strip() else set()

    def vacuum(self, untouched_before: int) -> list[str]:
        """Delete writes that no kept version names and that began before
        the time (milliseconds): those of writers that died.  The caller
        chooses a time no running write reaches back to."""
        current = self._current()
        if not current:
            return []
        named = set()
        for v in range(max(1, current["version"] - KEPT_VERSIONS + 1), current["version"] + 1):
            named |= {f.split("/")[0] for f in self._folders_of(v)}
        gone = [w for w in self._files.older(f"{self.path}/data", untouched_before) if w not in named]
        for write in gone:
            self._files.delete(f"{self.path}/data/{write}")
        return gone

    # rows -----------------------------------------------------------------------
    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")

    def _rows(self, folders: list) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for _, f, _ in folders])

    def _write(self, rows: DataFrame, buckets: int) -> tuple[str, list]:
        """Write the rows by bucket; (write, [bucket, folder, rows] for each)."""
        write = uuid.uuid4().hex
        at = f"{self.path}/data/{write}"
        try:
            rows.withColumn("b", self._bucket(buckets)).repartition("b").write.partitionBy("b").parquet(at)
        except Exception:
            self._files.delete(at)
            raise
        # Parquet footers and folder names alone; at most one row a bucket.
        schema = T.StructType(self.schema.fields + [T.StructField("b", T.IntegerType())])
        counts = self.spark.read.schema(schema).parquet(at).groupBy("b").count().collect()
        return write, [[r["b"], f"{write}/b={r['b']}", r["count"]] for r in counts]

    def _wanted(self, buckets: int, rows: int) -> int:
        while rows > buckets * self.bucket_rows:
            buckets *= 2
        return buckets

    # S4/S5 ------------------------------------------------------------------
    def exists(self) -> bool:
        return self._current() is not None

    def get_or_create(self) -> "VectorIndex":
        if not self.exists():
            try:
                self._publish(None, 1, [], None)
            except ConcurrentWrite:
                pass  # another writer has created it
        return self

    def read(self) -> DataFrame:
        current = self._current()
        if current is None:
            raise FileNotFoundError(f"no collection at {self.path}")
        return self._rows(current["folders"])

    def count(self) -> int:
        """Rows of the current version, from its manifest."""
        current = self._current()
        if current is None:
            raise FileNotFoundError(f"no collection at {self.path}")
        return sum(n for _, _, n in current["folders"])

    # S6/S7/S8 --------------------------------------------------------------
    def _conform(self, batch: DataFrame) -> DataFrame:
        """The batch in the collection's schema, one row per id: of repeated
        ids the one with the last document, then the last metadata, in order."""
        rows = batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        last = Window.partitionBy("id").orderBy(F.col("document").desc_nulls_last(), F.to_json("metadata").desc_nulls_last())
        return rows.withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") == 1).drop("_rn")

    def _touched(self, ids: DataFrame, buckets: int) -> tuple[set[int], int]:
        """(buckets of the ids, number of ids): one row a bucket comes back."""
        counts = ids.groupBy(self._bucket(buckets).alias("b")).count().collect()
        return {r["b"] for r in counts}, sum(r["count"] for r in counts)

    def upsert(self, batch: DataFrame, remove: DataFrame | None = None) -> None:
        """Keyed merge: rows of ``batch`` replace rows with the same id, and
        ids of ``remove`` (a frame with ``id``) that aren't in the batch go.
        Only buckets with such ids are written anew, unless the collection has
        outgrown their number.  An empty change publishes no version."""
        base = self.get_or_create()._current()
        new = write_once(self._conform(batch), "upsert")
        gone = new.select("id")
        if remove is not None:
            gone = gone.unionByName(remove.select(F.col("id").cast("string").alias("id"))).distinct()
        try:
            touched, n = self._touched(gone, base["buckets"])
            if not n:
                return
            buckets = self._wanted(base["buckets"], sum(r for _, _, r in base["folders"]) + n)
            anew = [f for f in base["folders"] if buckets != base["buckets"] or f[0] in touched]
            rest = [f for f in base["folders"] if not (buckets != base["buckets"] or f[0] in touched)]
            write, added = self._write(self._rows(anew).join(gone, "id", "left_anti").unionByName(new), buckets)
            self._publish(base, buckets, rest + added, write)
        finally:
            drop_written(new)

    def insert_new(self, batch: DataFrame) -> None:
        """Only ids not yet present are added, as one more folder in each of
        their buckets: the cost follows the batch and the ids of its buckets.
        A bucket of many folders is written anew instead.  Nothing is visible
        until all of it is published; a repeated call adds what is missing."""
        base = self.get_or_create()._current()
        rows = write_once(self._conform(batch), "insert")
        try:
            touched, _ = self._touched(rows, base["buckets"])
            there = [f for f in base["folders"] if f[0] in touched]
            new = write_once(rows.join(self._rows(there).select("id"), "id", "left_anti"), "insert-new")
            try:
                touched, n = self._touched(new, base["buckets"])
                if not n:
                    return
                buckets = self._wanted(base["buckets"], sum(r for _, _, r in base["folders"]) + n)
                held = Counter(f[0] for f in base["folders"])
                full = {b for b in touched if held[b] >= BUCKET_FOLDERS} if buckets == base["buckets"] else set(held)
                write, added = self._write(self._rows([f for f in base["folders"] if f[0] in full]).unionByName(new), buckets)
                self._publish(base, buckets, [f for f in base["folders"] if f[0] not in full] + added, write)
            finally:
                drop_written(new)
        finally:
            drop_written(rows)

    def overwrite(self, batch: DataFrame) -> None:
        """Drop and recreate with ``batch``."""
        base = self.get_or_create()._current()
        new = write_once(self._conform(batch), "overwrite")
        try:
            buckets = self._wanted(1, new.count())
            write, added = self._write(new, buckets)
            self._publish(base, buckets, added, write)
        finally:
            drop_written(new)

    def ingest(self, batch: DataFrame, force: bool = False) -> None:
        """Reference ingest: a populated collection is left alone unless
        ``force``; here a populated collection still receives ids it lacks
        (D11), and ``force`` upserts everything (D12: nothing is deleted)."""
        if force:
            self.upsert(batch)
        else:
            self.insert_new(batch)

    # S9 -----------------------------------------------------------------------
    def listing(self) -> DataFrame:
        return self.read().select("metadata.*", F.col("document").alias("documento_indexado"))


def place_index_rows(place_texts: DataFrame, place_vectors: DataFrame) -> DataFrame:
    """V2 rows: id = url, document = N3 text, metadata with defaults."""
    t = place_texts.join(place_vectors, "url_sitio")
    return t.select(
        F.col("url_sitio").alias("id"),
        F.col("documento").alias("document"),
        "embedding",
        F.struct(
            F.coalesce("nombre_sitio", F.lit(fixed.DEFAULT_NAME)).alias("nombre_sitio"),
            F.coalesce("categoria_sitio", F.lit(fixed.DEFAULT_FIELD)).alias("categoria_sitio"),
            F.coalesce("ubicacion", F.lit(fixed.DEFAULT_FIELD)).alias("ubicacion"),
            F.col("url_sitio").alias("url_sitio"),
        ).alias("metadata"),
    )


def user_index_rows(user_rows: DataFrame, user_vectors: DataFrame) -> DataFrame:
    """V3 rows from (id_usuario, nombre, …, resumen_perfil) and vectors."""
    t = user_rows.join(user_vectors, "id_usuario")
    return t.select(
        F.col("id_usuario").alias("id"),
        F.col("resumen_perfil").alias("document"),
        "embedding",
        F.struct(*[F.col(c) for c in USER_METADATA.fieldNames()]).alias("metadata"),
    )


def index_summary(rows: DataFrame) -> DataFrame:
    """Scalar view of index rows for comparisons: metadata, dims and norm."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("id", "document", "metadata.*", F.size("embedding").alias("dims"),
                       F.round(norm, 6).alias("norma"))


__all__ = ["VectorIndex", "PLACES", "USERS", "place_index_rows", "user_index_rows", "index_summary",
           "PLACE_METADATA", "USER_METADATA"]
