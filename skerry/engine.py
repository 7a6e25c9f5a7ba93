"""The whole engine behind one object, and the command line on top of it."""

from __future__ import annotations

import sys
import threading
import time
import uuid
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skerry.functions.display import duration_text, size_text
from skerry.operators import grep as grep_ops
from skerry.operators import search, stats
from skerry.operators.grep import Matcher, candidates, text_of_bytes
from skerry.plans.language import SearchPlan, parse, split_flags
from skerry.runtime import cut
from skerry.sources.catalog import DEFAULT_EXCLUDES, CatalogStore, CorruptCatalog, build_catalog, catalog_path, default_roots, read_files
from skerry.sources.watch import watch
from skerry.streaming.updates import Updater

VERSION = "0.1.0"
USAGE = """usage: skerry COMMAND [ARGUMENTS]
  index [FOLDER...] [--exclude A,B] [--all]   scan folders and save the catalog
  find QUERY [-n ROWS] [--sort relevance|newest|largest]
  grep QUERY [-r] [-n ROWS]                   search inside files
  stats                                       counts of the catalog
  pick QUERY                                  the best path only
  watch [--seconds N] [--rounds N]            rebuild the catalog at fixed intervals
  version, help"""


class Engine:
    """Find, grep and maintain one catalog."""

    def __init__(self, spark: SparkSession, folder: str | None = None, hold: bool = False) -> None:
        """``hold`` keeps the current version in the memory of the executors between searches."""
        self.spark = spark
        self.store = CatalogStore(spark, catalog_path(folder))
        self.progress: Observation | None = None
        self.scanned: Observation | None = None
        self._indexing = threading.Lock()
        self.hold = hold
        self._held: tuple[int, DataFrame] | None = None

    def index(self, roots: list[str] | None = None, excludes: tuple[str, ...] = (), use_defaults: bool = True) -> int:
        """Scan, save, and return the new version. ``progress`` tells how many entries the scan has found.

        A call while another one runs waits for it and returns its version: the scan is not repeated.
        """
        waited = self._indexing.locked()
        with self._indexing:
            if waited:
                return self.store.metadata()["version"]
            roots = roots or default_roots()
            self.progress = Observation()
            rows = build_catalog(self.spark, roots, excludes, use_defaults).observe(self.progress, F.count(F.lit(1)).alias("entries"), F.count_if("is_dir").alias("dirs"))
            rows = cut(rows.select("path", "size", "mod", "is_dir"))  # the sort of a version samples its input; folders are listed once
            return self.store.save(rows, roots, [*(DEFAULT_EXCLUDES if use_defaults else ()), *excludes])

    def catalog(self, strict: bool = True) -> DataFrame:
        """The current version. Without ``strict`` a missing or corrupt catalog is built first."""
        try:
            return self._current()
        except CorruptCatalog:
            if strict:
                raise
            self.index()
            return self._current()

    def _current(self) -> DataFrame:
        if not self.hold:
            return self.store.load()
        version = self.store.metadata()["version"]
        if self._held is None or self._held[0] != version:
            rows = self.store.load().persist()
            if self._held is not None:
                self._held[1].unpersist()
            self._held = (version, rows)
        return self._held[1]

    def plan(self, line: str, now: int | None = None, strict: bool = True, **options) -> SearchPlan:
        """A compiled search line; days begin at local midnight."""
        options.setdefault("offset", time.localtime(now).tm_gmtoff)
        return parse(line, now=now, strict=strict, **options)

    def find(self, line: str, n: int = search.FIND_ROWS, sort: str = "relevance", **options) -> DataFrame:
        return search.find(self.catalog(), self.plan(line, **options), n, sort)

    def pick(self, line: str, **options) -> str | None:
        best = self.find(line, 1, **options).first()
        return best.path if best else None

    def total(self, line: str, **options) -> int:
        """How many entries match."""
        return search.total(self.catalog(), self.plan(line, **options)).first().total

    def grep(self, line: str, regex: bool = False, n: int = grep_ops.GREP_ROWS, **options) -> DataFrame:
        """Hits inside the catalog's files; the text words of the line are the pattern.

        Only the files that pass the filters are opened, each path once. ``scanned`` counts them and their bytes once the
        result has been computed.
        """
        p = self.plan(line, **options)
        matcher = Matcher(p.pattern, regex)
        self.scanned = Observation()
        files = read_files(candidates(self.catalog(), p).select("path", "size"), grep_ops.LARGEST_FILE)
        files = files.observe(self.scanned, F.count("content").alias("files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"))
        return grep_ops.grep(files.select("path", text_of_bytes(F.col("content")).alias("text")), matcher, n)

    def hits(self, line: str, regex: bool = False, n: int = grep_ops.GREP_ROWS, batch: int = 200, **options) -> Iterator[list[Row]]:
        """Content hits in batches while the search goes on; a caller that stops taking them ends its jobs."""
        tag = f"skerry-grep-{uuid.uuid4().hex}"
        self.spark.addTag(tag)
        held: list[Row] = []
        try:
            for row in self.grep(line, regex, n, **options).toLocalIterator(prefetchPartitions=True):
                held.append(row)
                if len(held) >= batch:
                    yield held
                    held = []
            if held:
                yield held
        except GeneratorExit:
            self.spark.interruptTag(tag)
            raise
        finally:
            self.spark.removeTag(tag)

    def stats(self) -> DataFrame:
        """(files, dirs, bytes, path_bytes, index_bytes, age, roots, excludes) of the current version."""
        meta = self.store.metadata()
        return stats.stats(self.catalog()).select(
            "*", F.lit(self.store.size_bytes()).cast("bigint").alias("index_bytes"), F.lit(self.store.age()).cast("bigint").alias("age"),
            F.array(*map(F.lit, meta["roots"])).cast("array<string>").alias("roots"), F.array(*map(F.lit, meta["excludes"])).cast("array<string>").alias("excludes"),
        )

    def watch(self, seconds: int = 600, rounds: int | None = None, report=None) -> None:
        """Rebuild at fixed intervals where no change source exists; ``report`` gets (entries before, entries after) of each round."""
        done = 0
        while rounds is None or done < rounds:
            meta = self.store.metadata()
            before = self.catalog().count() if report else 0
            self.index(meta["roots"], tuple(x for x in meta["excludes"] if x not in DEFAULT_EXCLUDES))
            done += 1
            if report:
                report(before, self.progress.get["entries"])
            if rounds is None or done < rounds:
                time.sleep(seconds)

    def follow(self, state_folder: str, once: bool = False, on_minute=None) -> StreamingQuery:
        """Keep the catalog up to date from change notices of its roots; ``on_minute`` gets (minute, batches, versions) of each minute that had any."""
        meta = self.store.metadata()
        excludes = tuple(meta["excludes"])
        scan = lambda: build_catalog(self.spark, meta["roots"], excludes, use_defaults=False)
        tally: Counter = Counter()

        def updated(version: int) -> None:
            minute = int(time.time()) // 60
            for past in sorted(m for m in tally if m < minute):
                if on_minute:
                    on_minute(past, tally[past], version)
                del tally[past]
            tally[minute] += 1

        updater = Updater(self.store, lambda: scan().select("path", "size", "mod", "is_dir"), scan, excludes, self.store.folder, updated)
        return updater.start(watch(self.spark, meta["roots"], f"{state_folder}/state", excludes), f"{state_folder}/checkpoint", once)


def main(args: list[str], spark: SparkSession | None = None, out=None) -> int:
    """Run one command; results go to ``out``, counts and errors to standard error."""
    out = out or sys.stdout
    if not args or args[0] in ("help", "-h", "--help"):
        print(USAGE, file=out)
        return 0
    if args[0] in ("version", "--version"):
        print(VERSION, file=out)
        return 0
    words, flags = split_flags(args[1:], {"n", "sort", "exclude", "catalog", "seconds", "rounds"})
    engine = Engine(spark or SparkSession.builder.getOrCreate(), flags.get("catalog"))
    line, began = " ".join(words), time.time()
    try:
        if args[0] == "index":
            excludes = tuple(x for x in flags.get("exclude", "").split(",") if x)
            print(engine.index(words or None, excludes, "all" not in flags), file=out)
            print(f"{engine.progress.get['entries']} entries in {duration_text(time.time() - began)}", file=sys.stderr)
        elif args[0] == "find":
            rows = engine.find(line, int(flags.get("n", search.FIND_ROWS)), flags.get("sort", "relevance")).orderBy("rank").select("path")
            count = 0
            for r in rows.toLocalIterator():
                print(r.path, file=out)
                count += 1
            print(f"{count} of {engine.total(line)} in {duration_text(time.time() - began)}", file=sys.stderr)
        elif args[0] == "grep":
            hits = engine.grep(line, "r" in flags, int(flags.get("n", grep_ops.GREP_ROWS)))
            found = grep_ops.hit_lines(hits.orderBy("path", "line")).collect()  # at most n rows
            for r in found:
                print(r.out, file=out)
            seen = engine.scanned.get
            print(f"{len(found)} hits, {seen['files']} files and {size_text(seen['bytes'])} read in {duration_text(time.time() - began)}", file=sys.stderr)
        elif args[0] == "stats":
            row, meta = engine.stats().first(), engine.store.metadata()
            for label, value in (("files", row.files), ("folders", row.dirs), ("bytes", row.bytes), ("catalog", f"version {meta['version']}, {size_text(row.index_bytes)}, {duration_text(row.age)} old"), ("roots", ", ".join(row.roots)), ("left out", ", ".join(row.excludes))):
                print(f"{label}: {value}", file=out)
        elif args[0] == "pick":
            print(engine.pick(line) or "", file=out)
        elif args[0] == "watch":
            rounds = int(flags["rounds"]) if "rounds" in flags else None
            engine.watch(int(flags.get("seconds", 600)), rounds, lambda before, after: print(f"{time.strftime('%H:%M')} {after} entries, {after - before:+d}", file=out))
        else:
            print(USAGE, file=sys.stderr)
            return 2
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
