"""A streaming source of change notices: folders are listed again and again, and what differs from last time is a notice."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from skerry.sources.catalog import DEFAULT_EXCLUDES

WATCH_SCHEMA = "path string, arrival_ts timestamp, overflow boolean"
#: Notices of one listing; a larger difference is one row with ``overflow``, which asks for a whole scan.
MOST_NOTICES = 65_536


class _Listing:
    """Path -> stamp of everything below the roots; links are files and are not followed."""

    def __init__(self, roots: list[str], excludes: set[str]) -> None:
        self.roots, self.excludes = roots, excludes

    def take(self) -> dict[str, str]:
        out: dict[str, str] = {}
        todo = list(self.roots)
        while todo:
            try:
                with os.scandir(todo.pop()) as it:
                    for e in it:
                        if e.name.lower() in self.excludes:
                            continue
                        try:
                            st = e.stat(follow_symlinks=False)
                        except OSError:
                            continue
                        folder = e.is_dir(follow_symlinks=False)
                        out[e.path] = f"{int(folder)}:{0 if folder else st.st_size}:{st.st_mtime_ns}"
                        if folder:
                            todo.append(e.path)
            except OSError:
                continue
        return out


class _Watcher(SimpleDataSourceStreamReader):
    """The offset is the number of a state file that holds the last listing; replays read the notices stored beside it.

    ``state`` may be a folder of any file system that Arrow knows, so that a restarted driver finds it.
    """

    def __init__(self, options: dict) -> None:
        where = options["state"]
        self.fs, self.folder = pafs.FileSystem.from_uri(where if "://" in where or where.startswith("file:") else "file://" + os.path.abspath(where))
        self.listing = _Listing(json.loads(options["roots"]), {x.lower() for x in json.loads(options.get("excludes", json.dumps(DEFAULT_EXCLUDES)))})
        self.most = int(options.get("most", MOST_NOTICES))
        self.fs.create_dir(self.folder, recursive=True)

    def _write(self, name: str, value) -> None:
        part = f"{self.folder}/{name}.part"
        with self.fs.open_output_stream(part) as f:
            f.write(json.dumps(value).encode())
        self.fs.move(part, f"{self.folder}/{name}")

    def _load(self, name: str):
        with self.fs.open_input_stream(f"{self.folder}/{name}") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:  # noqa: N802
        if self.fs.get_file_info(f"{self.folder}/0.state").type == pafs.FileType.NotFound:
            self._write("0.state", self.listing.take())
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        before, now = self._load(f"{start['n']}.state"), self.listing.take()
        changed = sorted(p for p in before.keys() | now.keys() if before.get(p) != now.get(p))
        if not changed:
            return iter(()), start
        if len(changed) > self.most:
            changed = [None]
        end, stamp = {"n": start["n"] + 1}, time.time()
        self._write(f"{end['n']}.state", now)
        self._write(f"{end['n']}.notices", [stamp, changed])
        return self._rows(stamp, changed), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        for n in range(start["n"] + 1, end["n"] + 1):
            yield from self._rows(*self._load(f"{n}.notices"))

    @staticmethod
    def _rows(stamp: float, paths: list[str | None]) -> Iterator[tuple]:
        at = datetime.fromtimestamp(stamp, timezone.utc)
        return iter([(p, at, p is None) for p in paths])

    def commit(self, end: dict) -> None:
        for info in self.fs.get_file_info(pafs.FileSelector(self.folder)):
            n = info.base_name.partition(".")[0]
            if n.isdigit() and int(n) < end["n"]:
                self.fs.delete_file(info.path)


class DirectoryWatch(DataSource):
    """``spark.readStream.format('directory_watch')`` with options ``roots``, ``excludes`` (JSON lists) and ``state`` (a folder)."""

    @classmethod
    def name(cls) -> str:
        return "directory_watch"

    def schema(self) -> str:
        return WATCH_SCHEMA

    def simpleStreamReader(self, schema) -> _Watcher:  # noqa: N802
        return _Watcher(self.options)


def watch(spark, roots: list[str], state: str, excludes: tuple[str, ...] = DEFAULT_EXCLUDES, most: int = MOST_NOTICES):
    """A stream of (path, arrival_ts, overflow): paths that were made, deleted or changed since the last trigger."""
    spark.dataSource.register(DirectoryWatch)
    name = hashlib.sha1("\0".join(sorted(roots)).encode()).hexdigest()[:12]
    return spark.readStream.format("directory_watch").option("roots", json.dumps(roots)).option("excludes", json.dumps(list(excludes))).option("state", f"{state.rstrip('/')}/{name}").option("most", most).load()
