"""Live maintenance with Structured Streaming: change notices become catalog versions."""

from __future__ import annotations

import os
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from skerry.operators.changes import DEBOUNCE_MOST_MS, DEBOUNCE_QUIET_MS, change_ops
from skerry.runtime import cut, shared_folder
from skerry.sources.catalog import CatalogStore, CorruptCatalog, below_excluded

NOTICES = "seq bigint, path string, arrival_ts timestamp"
#: A batch of more paths than this costs more than building the catalog anew.
REBUILD_AT = 200_000
#: How often timers are looked at; the state store that timers need.
TICK_MS = 250
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A catalog older than this is rebuilt at the start; without live notices it is rebuilt at these intervals.
STALE_SECONDS, POLL_SECONDS = 30 * 60, 10 * 60


def accepted(notices: DataFrame, own_folder: str = "", excludes: tuple[str, ...] = ()) -> DataFrame:
    """Notices (path, lost) that concern the catalog: none of its own folder, in any letter case, and none below an excluded name."""
    concerns = ~below_excluded(F.col("path"), excludes)
    if own_folder:
        concerns = concerns & ~F.lower("path").startswith(own_folder.lower())
    return notices.where(F.col("lost") | (F.col("path").isNotNull() & concerns))


@dataclass
class Updater:
    """Applies batches of notices to a stored catalog.

    ``state`` gives the present rows of the file system, ``rebuild`` a whole new catalog. A rebuild runs in the background, one
    at a time; batches that arrive meanwhile are kept and replayed on its result before that is published. Readers keep the
    version they opened. A notice without a path, or with ``overflow``, says that notices were lost, so only a rebuild helps.
    """

    store: CatalogStore
    state: Callable[[], DataFrame]
    rebuild: Callable[[], DataFrame]
    excludes: tuple[str, ...] = ()
    own_folder: str = ""
    on_update: Callable[[int], None] | None = None
    on_rebuild: Callable[[], None] | None = None
    on_error: Callable[[Exception], None] | None = None
    live: bool = True
    clock: Callable[[], float] = time.time
    applied: int = field(default=0, init=False)
    rebuilt: int = field(default=0, init=False)

    def __post_init__(self) -> None:
        self._lock = threading.RLock()
        self._rebuilding: threading.Thread | None = None
        self._again = False
        self._missed: list[DataFrame] = []

    def _published(self, version: int) -> None:
        if self.on_update:
            self.on_update(version)

    def batch(self, notices: DataFrame, _batch_id: int = 0) -> None:
        lost = F.col("path").isNull() if "seq" not in notices.columns else F.lit(False)
        if "overflow" in notices.columns:
            lost = F.coalesce("overflow", F.lit(False))
        pending = cut(accepted(notices.select("path", lost.alias("lost")), self.own_folder, self.excludes).distinct())
        n = pending.limit(REBUILD_AT + 1).count()
        if not n:
            return
        if n > REBUILD_AT or not pending.where("lost").isEmpty():
            self.start_rebuild()
            return
        with self._lock:
            if self._rebuilding is not None:
                self._missed.append(pending.select("path"))
                return
            self._apply(pending.select("path"))

    def _apply(self, pending: DataFrame) -> None:
        ops = cut(change_ops(self.store.load(), pending, self.state(), self.excludes))
        if ops.isEmpty():
            return
        version = self.store.publish(ops, int(self.clock()) if self.live else self.store.metadata()["created"])
        self.applied += 1
        self._published(version)

    def start_rebuild(self) -> None:
        """Rebuild in the background; a call while one runs makes one more follow, however often it comes."""
        with self._lock:
            if self._rebuilding is not None:
                self._again = True
                return
            self._rebuilding = threading.Thread(target=self._rebuild, daemon=True)
        if self.on_rebuild:
            self.on_rebuild()
        self._rebuilding.start()

    def _rebuild(self) -> None:
        try:
            try:
                meta = self.store.metadata()
            except CorruptCatalog:
                meta = {"roots": [], "excludes": list(self.excludes)}
            rows = cut(self.rebuild())
            with self._lock:
                version = self.store.save(rows, meta["roots"], meta["excludes"], int(self.clock()))
                self.rebuilt += 1
                missed, self._missed = self._missed, []
                self._published(version)
                if missed:
                    self._apply(reduce(DataFrame.unionByName, missed).distinct())
        except Exception as e:  # the version in use stays
            if self.on_error is None:
                raise
            self.on_error(e)
        finally:
            with self._lock:
                self._rebuilding, again, self._again = None, self._again, False
            if again:
                self.start_rebuild()

    def wait(self, seconds: float | None = None) -> None:
        """Wait for the rebuild that runs."""
        thread = self._rebuilding
        if thread is not None:
            thread.join(seconds)

    def stale(self, now: int | None = None) -> bool:
        """True if there is no catalog or it is older than half an hour."""
        try:
            return self.store.age(int(self.clock()) if now is None else now) > STALE_SECONDS
        except CorruptCatalog:
            return True

    def tick(self) -> None:
        """What time alone brings about: without live notices the catalog is rebuilt every ten minutes."""
        try:
            due = not self.live and self.store.age(int(self.clock())) >= POLL_SECONDS
        except CorruptCatalog:
            due = True
        if due:
            self.start_rebuild()

    def start(self, notices: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Consume a stream of notices in the batches of ``Debounce``; a stale catalog is rebuilt first.

        With ``once`` all that is present is one batch, as timers do not run on in a stream that ends.
        """
        if self.stale():
            self.start_rebuild()
        if once:
            return notices.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        spark = notices.sparkSession
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        return debounced(notices).writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{TICK_MS} milliseconds").start()


class Debounce(StatefulProcessor):
    """Collects the notices of one catalog and emits them as a batch after 300 ms of quiet, or two seconds after the first.

    The state is the time of the first notice and one entry per pending path. With more than ``most_paths`` of them the paths
    are dropped and one row with ``overflow`` says that the catalog must be rebuilt.
    """

    def __init__(self, quiet_ms: int = DEBOUNCE_QUIET_MS, most_ms: int = DEBOUNCE_MOST_MS, most_paths: int = REBUILD_AT) -> None:
        self.quiet, self.most, self.most_paths = quiet_ms, most_ms, most_paths

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", StructType([StructField("ms", LongType()), StructField("paths", LongType())]))
        self.pending = handle.getMapState("pending", StructType([StructField("path", StringType())]), StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        first, paths = self.first.get() if self.first.exists() else (now, 0)
        for pdf in rows:
            if "overflow" in pdf and pdf["overflow"].any():
                paths = self.most_paths + 1
            for path, n in pdf["path"].value_counts().items():
                if paths > self.most_paths:
                    break
                known = self.pending.containsKey((path,))
                self.pending.updateValue((path,), ((self.pending.getValue((path,))[0] if known else 0) + int(n),))
                paths += not known
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.first.update((first, paths))
        self.handle.registerTimer(min(now + self.quiet, first + self.most))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        import pandas as pd

        first, paths = self.first.get()
        if paths > self.most_paths:
            rows = [(first, None, paths, True)]
        else:
            rows = [(first, path[0], n[0], False) for path, n in self.pending.iterator()]
        self.first.clear()
        self.pending.clear()
        yield pd.DataFrame(rows, columns=["batch_ms", "path", "n", "overflow"])

    def close(self) -> None:
        pass


def debounced(notices: DataFrame, catalog: str = "") -> DataFrame:
    """(batch_ms, path, n, overflow) of a stream of notices of one catalog; batches are those of ``Debounce``."""
    out = StructType([StructField("batch_ms", LongType()), StructField("path", StringType()), StructField("n", LongType()), StructField("overflow", BooleanType())])
    lost = F.coalesce("overflow", F.lit(False)) if "overflow" in notices.columns else F.lit(False)
    rows = notices.select("path", lost.alias("overflow"), F.lit(catalog).alias("catalog")).where("path is not null or overflow")
    return rows.groupBy("catalog").transformWithStateInPandas(Debounce(), out, "Append", "ProcessingTime")


def notice_stream(spark: SparkSession, folder: str, schema: str = NOTICES) -> DataFrame:
    """Files of notices that appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def stream_tally(spark: SparkSession, source: str) -> DataFrame:
    """(minute, n): arrivals per minute, counted by a stream over all files present."""
    folder, name = os.path.split(source.rstrip("/"))
    work = f"{shared_folder(spark)}/tally-{uuid.uuid4().hex}"
    reader = spark.readStream.schema(NOTICES)
    stream = reader.parquet(source) if not source.endswith(".parquet") or _is_folder(spark, source) else reader.option("pathGlobFilter", name).parquet(folder)
    minute = F.floor(F.unix_seconds("arrival_ts") / 60).alias("minute")
    counts = stream.where("arrival_ts is not null").groupBy(minute).agg(F.count("*").alias("n"))

    def keep(batch: DataFrame, _id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/out")

    q = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("minute bigint, n bigint").parquet(f"{work}/out")


def _is_folder(spark: SparkSession, source: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
