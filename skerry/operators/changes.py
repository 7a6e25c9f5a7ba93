"""Application of a batch of change notices to a catalog version.

A notice is only a path. What happened is found by comparing the catalog with the present state of the file system: a path
that is gone takes its subtree with it, a new folder (or one that was a file) is replaced with all below it, anything else
has its own row refreshed. Subtrees are reached by equi-joins on the ancestors of each path, never by prefix comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.runtime import broadcast_if_small, cut
from skerry.sources.catalog import below_excluded

ROW = ["path", "size", "mod", "is_dir"]
PATH_BYTES = 200
DEBOUNCE_QUIET_MS, DEBOUNCE_MOST_MS = 300, 2000


def ancestors(path: Column) -> Column:
    """All folders of a path and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.when(path.startswith("/"), 2).otherwise(1), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def classify(changed: DataFrame, entries: DataFrame, state: DataFrame, excludes: tuple[str, ...] = ()) -> DataFrame:
    """(path, was_dir, is_dir, size, mod, effect) per changed path; effect is remove, walk, retype, refresh or none."""
    once = changed.select("path").where(F.col("path").isNotNull() & ~below_excluded(F.col("path"), excludes)).distinct()
    small = broadcast_if_small(once, PATH_BYTES)
    was = entries.join(small, "path", "left_semi").select("path", F.col("is_dir").alias("was_dir"))
    now = state.join(small, "path", "left_semi").select(*ROW)
    both = once.join(was, "path", "left").join(now, "path", "left")
    effect = (
        F.when(F.col("is_dir").isNull() & F.col("was_dir").isNull(), "none")
        .when(F.col("is_dir").isNull(), "remove")
        .when(F.col("is_dir") & ~F.coalesce("was_dir", F.lit(False)), "walk")
        .when(~F.col("is_dir") & F.coalesce("was_dir", F.lit(False)), "retype")
        .otherwise("refresh")
    )
    return both.withColumn("effect", effect)


def in_subtrees(rows: DataFrame, roots: DataFrame, how: str = "left_semi", strictly: bool = False) -> DataFrame:
    """Rows that lie in one of the subtrees (or, with ``left_anti``, in none)."""
    up = F.explode(ancestors(F.col("path"))).alias("above")
    inside = rows.select("path", up)
    if strictly:
        inside = inside.where("above <> path")
    hit = inside.join(broadcast_if_small(roots.select(F.col("path").alias("above")), PATH_BYTES), "above", "left_semi").select("path").distinct()
    return rows.join(hit, "path", how)


OPS = "op string, path string, size bigint, mod bigint, is_dir boolean"


def change_ops(entries: DataFrame, changed: DataFrame, state: DataFrame, excludes: tuple[str, ...] = ()) -> DataFrame:
    """(op, path, size, mod, is_dir): what a batch does to a catalog, as large as the batch and the folders it walks.

    ``drop`` takes a row away, ``droptree`` a folder with all below it; a ``put`` of the same batch comes after both.
    """
    known = cut(classify(changed, entries, state, excludes))  # as large as the batch; used several times below
    trees = known.where("effect in ('remove', 'walk', 'retype')").select("path")
    walked = in_subtrees(state.select(*ROW).where(~below_excluded(F.col("path"), excludes)), known.where("effect = 'walk'").select("path"))
    # A row of its own below a subtree that is replaced or gone comes with that subtree or not at all.
    free = in_subtrees(known.where("is_dir is not null").select(*ROW), trees, "left_anti", strictly=True)
    puts = walked.unionByName(free).dropDuplicates(["path"]).select(F.lit("put").alias("op"), *ROW)
    bare = [F.lit(None).cast(t).alias(c) for c, t in (("size", "bigint"), ("mod", "bigint"), ("is_dir", "boolean"))]
    drops = known.where("effect <> 'none'").select(F.lit("drop").alias("op"), "path", *bare)
    return puts.unionByName(drops).unionByName(trees.select(F.lit("droptree").alias("op"), "path", *bare))


def apply_ops(base: DataFrame, ops: DataFrame) -> DataFrame:
    """(path, size, mod, is_dir) after batches (seq, op, path, ..), seq from 1 in their order: a row lives if nothing later takes it away."""
    puts = base.select(*ROW, F.lit(0).alias("seq")).unionByName(ops.where("op = 'put'").select(*ROW, "seq"))
    later = broadcast_if_small(ops.where("op <> 'droptree'").groupBy("path").agg(F.max("seq").alias("last")), PATH_BYTES)
    live = puts.join(later, "path", "left").where((F.coalesce("last", F.lit(0)) <= F.col("seq"))).drop("last")
    trees = ops.where("op = 'droptree'").groupBy(F.col("path").alias("above")).agg(F.max("seq").alias("gone"))
    small = cut(trees)
    if small.isEmpty():
        return live.select(*ROW)
    inside = live.select("path", "seq", F.explode(ancestors(F.col("path"))).alias("above")).join(broadcast_if_small(small, PATH_BYTES), "above")
    dead = inside.where("gone > seq").select("path").distinct()
    return live.join(dead, "path", "left_anti").select(*ROW)


def apply_changes(entries: DataFrame, changed: DataFrame, state: DataFrame, excludes: tuple[str, ...] = ()) -> DataFrame:
    """(path, size, mod, is_dir) of the next version; the present one is left as it is."""
    return apply_ops(entries, cut(change_ops(entries, changed, state, excludes).withColumn("seq", F.lit(1))))


#: Milliseconds of a slice in which gaps between notices are found; longer than the quiet time, so a gap spans two at most.
SLICE_MS = 60_000


def debounce_batches(notices: DataFrame) -> DataFrame:
    """(batch_ms, path, n): the batch in which each pending path is applied, named by the time of its first notice.

    A batch is applied after 300 ms without a notice, or before the first notice that comes more than two seconds after the
    first one that is pending. Runs without a quiet gap are found slice by slice of time, so no task orders the stream. The
    distinct times of a run are then walked in order with constant memory, because each batch begins where the last one ended.
    """
    rows = notices.where("path is not null and arrival_ts is not null").select("path", F.unix_millis("arrival_ts").alias("ms"))
    times = rows.select("ms").distinct().withColumn("slice", F.floor(F.col("ms") / SLICE_MS))
    ends = times.groupBy("slice").agg(F.max("ms").alias("end")).select((F.col("slice") + 1).alias("slice"), "end")
    before = F.lag("ms").over(Window.partitionBy("slice").orderBy("ms"))
    gap = F.col("ms") - F.coalesce("before", "end")
    opened = times.withColumn("before", before).join(ends, "slice", "left").withColumn("opens", gap.isNull() | (gap > DEBOUNCE_QUIET_MS))
    # A slice continues the run of an earlier slice until its first gap; runs are named by the slice and time they open in.
    first = opened.groupBy("slice").agg(F.max(F.when(F.col("opens"), F.col("ms"))).alias("opened"), F.min(F.struct("ms", "opens"))["opens"].alias("fresh"))
    heads = first.withColumn("carried", F.last("opened", ignorenulls=True).over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))  # one row a minute
    run = F.coalesce(F.last(F.when(F.col("opens"), F.col("ms")), ignorenulls=True).over(Window.partitionBy("slice").orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)), F.col("carried"))
    marked = opened.join(heads.select("slice", "carried"), "slice").select("ms", run.alias("run"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = start = None
        for b in batches:
            starts = []
            for ms, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if r != run or ms - start > DEBOUNCE_MOST_MS:
                    run, start = r, ms
                starts.append(start)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(starts, pa.int64())], names=["ms", "batch_ms"])

    batches = marked.repartition("run").sortWithinPartitions("run", "ms").mapInArrow(walk, "ms bigint, batch_ms bigint")
    return rows.join(batches, "ms").groupBy("batch_ms", "path").agg(F.count("*").alias("n"))
