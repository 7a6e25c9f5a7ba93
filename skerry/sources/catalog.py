"""The catalog of files: scan of directories, derived columns, immutable versions on disk."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from functools import reduce
from string import ascii_uppercase

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skerry.functions.paths import ascii_lower, base_offset, dir_of, extension_of, name_of

SCAN_SCHEMA = "path string, size bigint, mod bigint, is_dir boolean"
FORMAT_VERSION = 1
LONGEST_PATH = 65_535
#: Change batches beside a base, and the bytes or part of its bytes that they may reach, before a new base is written.
MOST_DELTAS, DELTA_BYTES, DELTA_PART = 16, 32 << 20, 4
#: Folders that a scan is divided into before its tasks start.
SCAN_FOLDERS = 256
# Folder and file names that a scan leaves out (fixed values).
DEFAULT_EXCLUDES = ("$Recycle.Bin", "System Volume Information", "$WinREAgent", "Config.Msi", ".git", "node_modules", "__pycache__", ".cache", "proc", "sys")


class CorruptCatalog(ValueError):
    """The folder is no catalog, is of another format version, or misses parts."""


def derive(scan: DataFrame, stored: bool = False) -> DataFrame:
    """Catalog rows from (path, size, mod, is_dir): missing numbers become 0, names and lower-case twins are added.

    Rows of a ``stored`` version are clean already; they are left as they are, so that filters reach the scan.
    """
    rows = scan.select("path", "size", "mod", "is_dir")
    if not stored:
        rows = scan.select("path", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("mod", F.lit(0)).alias("mod"), F.coalesce("is_dir", F.lit(False)).alias("is_dir"))
        rows = rows.where(F.col("path").isNotNull() & (F.octet_length("path") <= LONGEST_PATH))
    path = F.col("path")
    return rows.select(
        "*",
        name_of(path).alias("name"),
        ascii_lower(path).alias("path_lower"),
        ascii_lower(name_of(path)).alias("name_lower"),
        ascii_lower(dir_of(path)).alias("dir_lower"),
        base_offset(path).alias("base_off"),
        F.octet_length(path).alias("path_len"),
        extension_of(path).alias("ext"),
    )


def with_folders(files: DataFrame) -> DataFrame:
    """Files and the folders above them; a folder has the date of its newest descendant."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    folders = files.where(F.size(parts) > 2).select(F.explode(up).alias("path"), "mod").groupBy("path").agg(F.max("mod").alias("mod"))
    return files.unionByName(folders.select("path", F.lit(0).cast("bigint").alias("size"), "mod", F.lit(True).alias("is_dir")))


def below_excluded(path: Column, excludes: tuple[str, ...]) -> Column:
    """True if any part of a path has an excluded name, in any letter case."""
    names = [x.lower() for x in excludes]
    return F.exists(F.split(F.lower(path), r"[\\/]"), lambda p: p.isin(names)) if names else F.lit(False)


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool) -> None:
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    """Divides the roots into folders, level by level, until there are enough for the tasks; a folder that may not be read
    yields what could be read."""

    def __init__(self, options: dict) -> None:
        self.roots = json.loads(options["roots"])
        self.excludes = {x.lower() for x in json.loads(options.get("excludes", "[]"))}
        self.folders = int(options.get("folders", SCAN_FOLDERS))

    def partitions(self) -> list[InputPartition]:
        shallow: list[InputPartition] = []
        frontier = list(self.roots)
        # Widest first: a listing of the driver is one folder, and it lists at most as many as there will be tasks.
        while frontier and len(shallow) + len(frontier) < self.folders:
            folder = frontier.pop(0)
            shallow.append(_Folder(folder, False))
            frontier += [e.path for e in self._list(folder) if e.is_dir(follow_symlinks=False)]
        return [*shallow, *(_Folder(f, True) for f in frontier)]

    def _list(self, path: str) -> list[os.DirEntry]:
        try:
            with os.scandir(path) as it:
                return [e for e in it if e.name.lower() not in self.excludes and len(os.fsencode(e.path)) <= LONGEST_PATH]
        except OSError:
            return []

    @staticmethod
    def _row(entry: os.DirEntry) -> tuple:
        folder = entry.is_dir(follow_symlinks=False)
        try:
            st = entry.stat(follow_symlinks=False)
            return entry.path, 0 if folder else st.st_size, int(st.st_mtime), folder
        except OSError:
            return entry.path, 0, 0, folder

    def read(self, partition: _Folder) -> Iterator[tuple]:
        if partition.path in self.roots:  # any other folder has a row in the folder above it
            try:
                yield partition.path, 0, int(os.stat(partition.path).st_mtime), True
            except OSError:
                return
        if not partition.deep:
            for e in self._list(partition.path):
                yield self._row(e)
            return
        todo = [partition.path]
        while todo:
            for e in self._list(todo.pop()):
                row = self._row(e)
                yield row
                if row[3]:
                    todo.append(e.path)


class DirectoryScan(DataSource):
    """``spark.read.format('directory_scan')`` with options ``roots`` and ``excludes`` as JSON lists."""

    @classmethod
    def name(cls) -> str:
        return "directory_scan"

    def schema(self) -> str:
        return SCAN_SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def default_roots(system: str = os.name) -> list[str]:
    """The user's folder, else the root; on Windows every drive that can be listed, else ``C:``."""
    if system == "nt":
        return [f"{d}:\\" for d in ascii_uppercase if os.path.isdir(f"{d}:\\")] or ["C:\\"]
    home = os.path.expanduser("~")
    return [home if os.path.isdir(home) else "/"]


def build_catalog(spark: SparkSession, roots: list[str], excludes: tuple[str, ...] = (), use_defaults: bool = True) -> DataFrame:
    """Scan folders in parallel. Roots that are no folders are dropped; overlapping roots give each path once."""
    found = [r for r in dict.fromkeys(os.path.abspath(r) for r in roots) if os.path.isdir(r)]
    if not found:
        raise ValueError("no folder to scan")
    skip = [*(DEFAULT_EXCLUDES if use_defaults else ()), *excludes]
    spark.dataSource.register(DirectoryScan)
    scan = spark.read.format("directory_scan").option("roots", json.dumps(found)).option("excludes", json.dumps(skip)).load()
    return derive(scan.dropDuplicates(["path"]))


def catalog_path(configured: str | None = None) -> str:
    """Where the catalog lives: as configured, else ``SKERRY_CATALOG``, else the user's cache folder."""
    return configured or os.environ.get("SKERRY_CATALOG") or os.path.join(os.path.expanduser("~"), ".cache", "skerry", "catalog")


class CatalogStore:
    """Immutable versions of a catalog in one folder, and a pointer that is replaced in one step.

    A version is a base, sorted by path and written with delta-encoded strings, so shared prefixes cost nothing and a folder
    filter reads few row groups, and the change batches applied since. A batch is as large as what it changes; readers merge
    the batches, and after ``MOST_DELTAS`` of them, or when they grow too large, ``publish`` writes a new base. Readers keep the
    version they opened; old parts stay until ``vacuum``.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _pointer(self) -> dict:
        fs, path = self._fs()
        at = path(f"{self.folder}/CURRENT")
        if not fs.exists(at):
            raise CorruptCatalog(f"{self.folder}: no catalog")
        try:
            stream = fs.open(at)
            try:
                meta = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        except (ValueError, Py4JError) as e:
            raise CorruptCatalog(f"{self.folder}: the pointer cannot be read") from e
        if meta.get("format") != FORMAT_VERSION:
            raise CorruptCatalog(f"{self.folder}: another format version")
        return meta

    def save(self, catalog: DataFrame, roots: list[str] = (), excludes: list[str] = (), created: int | None = None) -> int:
        """Write the next version as a base, then point to it."""
        version = self._next()
        data = f"{self.folder}/v{version:08d}-{uuid.uuid4().hex[:8]}"
        rows = derive(catalog).select("path", "size", "mod", "is_dir")
        (rows.repartitionByRange(F.col("path")).sortWithinPartitions("path").write.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").mode("errorifexists").parquet(data))
        self._point({"version": version, "data": data, "deltas": [], "created": int(time.time()) if created is None else created, "roots": list(roots), "excludes": list(excludes)})
        return version

    def publish(self, ops: DataFrame, created: int | None = None) -> int:
        """Write a change batch (op, path, size, mod, is_dir) beside the base and point to both; the base is not touched."""
        meta = self._pointer()
        data = f"{self.folder}/d{self._next():08d}-{uuid.uuid4().hex[:8]}"
        zero = {"size": F.lit(0), "mod": F.lit(0), "is_dir": F.lit(False)}
        ops.select("op", "path", *[F.coalesce(c, v).alias(c) for c, v in zero.items()]).where(F.octet_length("path") <= LONGEST_PATH).coalesce(1).write.mode("errorifexists").parquet(data)
        version = self._next()
        self._point({**meta, "version": version, "deltas": [*meta.get("deltas", []), data], "created": int(time.time()) if created is None else created})
        if len(meta.get("deltas", [])) + 1 > MOST_DELTAS or self._bytes(self._pointer()["deltas"]) > max(DELTA_BYTES, self._bytes([meta["data"]]) // DELTA_PART):
            return self.compact()
        return version

    def _bytes(self, folders: list[str]) -> int:
        fs, path = self._fs()
        return sum(fs.getContentSummary(path(f)).getLength() for f in folders)

    def size_bytes(self) -> int:
        """Bytes of the current version on disk."""
        meta = self._pointer()
        return self._bytes([meta["data"], *meta.get("deltas", [])])

    def _next(self) -> int:
        try:
            return self._pointer()["version"] + 1
        except CorruptCatalog:
            return 1

    def _point(self, meta: dict) -> None:
        fs, path = self._fs()
        new = path(f"{self.folder}/CURRENT.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"format": FORMAT_VERSION, **meta}).encode()))
        out.close()
        at = path(f"{self.folder}/CURRENT")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark._sc._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(new, at, options)

    def metadata(self) -> dict:
        return self._pointer()

    def load(self) -> DataFrame:
        """The current version with its derived columns."""
        meta = self._pointer()
        fs, path = self._fs()
        for part in (meta["data"], *meta.get("deltas", [])):
            if not fs.exists(path(part + "/_SUCCESS")):
                raise CorruptCatalog(f"{part}: incomplete")
        base = self.spark.read.schema(SCAN_SCHEMA).parquet(meta["data"])
        if not meta.get("deltas"):
            return derive(base, stored=True)
        from skerry.operators.changes import OPS, apply_ops

        batches = [self.spark.read.schema(OPS).parquet(d).withColumn("seq", F.lit(i)) for i, d in enumerate(meta["deltas"], 1)]
        return derive(apply_ops(base, reduce(DataFrame.unionByName, batches)), stored=True)

    def age(self, now: int | None = None) -> int:
        return (int(time.time()) if now is None else now) - self._pointer()["created"]

    def compact(self) -> int:
        """Rewrite the current version as one sorted base; a base without batches is in order already and stays."""
        meta = self._pointer()
        if not meta.get("deltas"):
            return meta["version"]
        return self.save(self.load(), meta["roots"], meta["excludes"], meta["created"])

    def vacuum(self, keep: int = 2) -> int:
        """Delete all bases and batches but those in use and the newest ``keep`` bases; returns how many went."""
        fs, path = self._fs()
        meta = self._pointer()
        used = {os.path.basename(x) for x in (meta["data"], *meta.get("deltas", []))}
        found = sorted(name for s in fs.listStatus(path(self.folder)) if (name := s.getPath().getName())[:1] in "vd")
        bases = [v for v in found if v.startswith("v")]
        kept = {*used, *bases[len(bases) - min(keep, len(bases)) :]}
        old = [v for v in found if v not in kept]
        for v in old:
            fs.delete(path(f"{self.folder}/{v}"), True)
        return len(old)


def read_files(files: DataFrame, largest: int = 16 << 20) -> DataFrame:
    """(path, content) of the files (path, size): only these are opened, each by the task that holds its path.

    Paths are spread by hash, so the files of one folder are read in parallel. A file that is gone or may not be read has no
    row; one that has grown beyond ``largest`` since the scan is not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with open(path, "rb") as f:
                        content = f.read(largest + 1)
                except OSError:
                    continue
                if 0 < len(content) <= largest:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], names=["path", "content"])

    tasks = files.sparkSession.sparkContext.defaultParallelism * 4
    return files.select("path").distinct().repartition(tasks, "path").mapInArrow(work, "path string, content binary")
