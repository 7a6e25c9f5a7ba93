import json
import os
import random
import threading
import time

import pandas as pd
from pyspark.sql import functions as F

from skerry.operators import search
from skerry.operators.changes import debounce_batches
from skerry.plans.language import parse
from skerry.session import Page, Previews, Typing, reference
from skerry.sources.catalog import CatalogStore, build_catalog, derive
from skerry.sources.watch import _Watcher, watch
from skerry.streaming.updates import Debounce, Updater, notice_stream


def test_watch_folder_to_catalog(spark, tmp_path):
    root = tmp_path / "r"
    (root / "old").mkdir(parents=True)
    (root / "old" / "inner.txt").write_text("x")
    (root / "a.txt").write_text("x")
    store = CatalogStore(spark, str(tmp_path / "cat"))
    scan = lambda: build_catalog(spark, [str(root)])
    store.save(scan(), roots=[str(root)])
    updater = Updater(store, lambda: scan().select("path", "size", "mod", "is_dir"), scan)

    def once():
        stream = watch(spark, [str(root)], str(tmp_path / "state"))
        updater.start(stream, str(tmp_path / "ck"), once=True).awaitTermination()

    once()
    (root / "a.txt").unlink()
    os.rename(root / "old", root / "renamed")
    (root / "new" / "deep").mkdir(parents=True)
    (root / "new" / "deep" / "f.txt").write_text("abc")
    (root / "node_modules").mkdir()
    once()
    got = {os.path.relpath(r.path, root): r.size for r in store.load().collect()}
    assert got.keys() == {".", "renamed", "renamed/inner.txt", "new", "new/deep", "new/deep/f.txt"} and got["new/deep/f.txt"] == 3
    version = store.metadata()["version"]
    once()
    assert store.metadata()["version"] == version


class _State:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def clear(self):
        self.value = None


class _Map(dict):
    containsKey, getValue, updateValue = dict.__contains__, dict.__getitem__, dict.__setitem__  # noqa: N815

    def iterator(self):
        return iter(list(self.items()))


class _Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *_):  # noqa: N802
        return _State()

    def getMapState(self, *_):  # noqa: N802
        return _Map()

    def listTimers(self):  # noqa: N802
        return list(self.timers)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.remove(t)

    def registerTimer(self, t):  # noqa: N802
        self.timers.append(t)


class _Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now


def _notices(*paths):
    return iter([pd.DataFrame({"path": list(paths)})])


def test_debounce_timers():
    d, h = Debounce(), _Handle()
    d.init(h)
    list(d.handleInputRows(("",), _notices("/a", "/a", "/b"), _Clock(1000)))
    assert h.timers == [1300]
    for now in range(1200, 3000, 200):
        list(d.handleInputRows(("",), _notices("/a"), _Clock(now)))
    assert h.timers == [3000]
    (out,) = d.handleExpiredTimer(("",), _Clock(3000), None)
    assert sorted(map(tuple, out.values.tolist())) == [(1000, "/a", 11, False), (1000, "/b", 1, False)] and not d.first.exists() and not d.pending


def test_debounce_overflow():
    d, h = Debounce(most_paths=3), _Handle()
    d.init(h)
    list(d.handleInputRows(("",), _notices(*"abcdefgh"), _Clock(0)))
    (out,) = d.handleExpiredTimer(("",), _Clock(300), None)
    assert out["overflow"].tolist() == [True] and out["path"].isna().all() and len(d.pending) == 0


def _walked(times):
    """Batches by the rule itself, one notice at a time."""
    out, start, last = [], None, None
    for t in sorted(times):
        if start is None or t - last > 300 or t - start > 2000:
            start = t
        last = t
        out.append(start)
    return sorted(out)


def test_debounced_batches_follow_the_rule(spark):
    rng = random.Random(1)
    day = 86_400_000
    times = [day - 1500 + i * 130 for i in range(60)]  # a burst over midnight and over two seconds
    at = 5 * day
    for _ in range(3_000):
        at += rng.choice([1, 40, 250, 299, 300, 301, 302, 2000, 61_000])
        times.append(at)
    times += [9 * day + i * 290 for i in range(1_000)]  # one run over several slices
    rows = [(i, f"/p{i % 7}", t) for i, t in enumerate(times)] + [(-1, None, day), (-2, "/x", None)]
    df = spark.createDataFrame(rows, "seq bigint, path string, ms bigint").select("path", F.timestamp_millis("ms").alias("arrival_ts"), F.lit(1).alias("slice"))
    got = debounce_batches(df).groupBy("batch_ms").agg(F.sum("n").alias("n")).collect()
    assert sorted(b for r in got for b in [r.batch_ms] * r.n) == _walked(times)
    assert debounce_batches(df.where("path = 'none'")).count() == 0


FILES = "path string, size bigint, mod bigint, is_dir boolean"


def test_rebuild_replays_what_arrives_meanwhile(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path / "cat"))
    begun, go = threading.Event(), threading.Event()
    state = lambda: spark.createDataFrame([("/r", 0, 1, True), ("/r/b", 2, 2, False)], FILES)

    def rebuild():
        begun.set()
        go.wait(60)
        return spark.createDataFrame([("/r", 0, 1, True), ("/r/a", 1, 1, False)], FILES)

    calls = []
    updater = Updater(store, state, rebuild, own_folder=str(tmp_path), on_rebuild=lambda: calls.append(1), clock=lambda: 5_000)
    assert updater.stale()
    updater.start_rebuild()
    assert begun.wait(60)
    updater.start_rebuild()
    updater.start_rebuild()
    updater.batch(spark.createDataFrame([("/r/a", 1), ("/r/b", 2), (str(tmp_path).upper() + "/cat/x", 3)], "path string, seq bigint"))
    assert updater.applied == 0
    go.set()
    for _ in range(600):
        if len(calls) == 2 and updater.rebuilt == 2:
            break
        time.sleep(0.1)
    updater.wait(60)
    assert (len(calls), updater.rebuilt, updater.applied) == (2, 2, 1)
    updater.batch(spark.createDataFrame([("/r/a", 1), ("/r/b", 2)], "path string, seq bigint"))
    assert sorted(r.path for r in store.load().collect()) == ["/r", "/r/b"] and not updater.stale(5_000 + 1800) and updater.stale(5_000 + 1801)


def test_lost_notices_lead_to_a_rebuild(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path / "cat"))
    rows = spark.createDataFrame([("/r", 0, 1, True)], FILES)
    store.save(rows, created=0)
    now = [600]
    updater = Updater(store, lambda: rows, lambda: rows, live=False, clock=lambda: now[0])
    updater.batch(spark.createDataFrame([(None, True)], "path string, overflow boolean"))
    updater.wait(60)
    assert updater.rebuilt == 1
    updater.tick()
    updater.wait(60)
    assert updater.rebuilt == 1
    now[0] += 600
    updater.tick()
    updater.wait(60)
    assert updater.rebuilt == 2


def test_batches_are_published_beside_the_base(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path / "cat"))
    base = [("/r", 0, 1, True), *((f"/r/f{i}", i, 1, False) for i in range(500)), ("/r/d", 0, 1, True), ("/r/d/x", 1, 1, False), ("/r/d/y", 1, 1, False)]
    store.save(spark.createDataFrame(base, FILES), roots=["/r"])
    data = store.metadata()["data"]
    worlds = [
        [("/r/d", 0, 2, True), ("/r/d/x", 5, 2, False), ("/r/f1", 9, 9, False)],  # notices: f1, d/x, d/y
        [("/r/f1", 9, 9, False)],  # notices: d
        [("/r/d", 7, 3, False), ("/r/f1", 9, 9, False)],  # notices: d, now a file
        [("/r/d", 0, 4, True), ("/r/d/z", 3, 4, False), ("/r/f1", 9, 9, False)],  # notices: d, a folder again
    ]
    want = {r[0]: r[1] for r in base}
    for world, changed, gone, put in zip(worlds, (["/r/f1", "/r/d/x", "/r/d/y"], ["/r/d"], ["/r/d"], ["/r/d"]), (["/r/d/y"], ["/r/d", "/r/d/x"], [], []), ({"/r/f1": 9, "/r/d/x": 5}, {}, {"/r/d": 7}, {"/r/d": 0, "/r/d/z": 3})):
        updater = Updater(store, lambda w=world: spark.createDataFrame(w, FILES), lambda: None)
        updater.batch(spark.createDataFrame([(p,) for p in changed], "path string").withColumn("seq", F.lit(1)))
        for p in gone:
            want.pop(p)
        want.update(put)
        assert {r.path: r.size for r in store.load().collect()} == want
    meta = store.metadata()
    assert meta["data"] == data and len(meta["deltas"]) == 4 and meta["roots"] == ["/r"]
    version = store.compact()
    assert {r.path: r.size for r in store.load().collect()} == want and store.metadata()["deltas"] == [] and version == store.metadata()["version"]
    assert store.vacuum(1) == 5 and store.load().count() == len(want)


def test_a_stream_is_debounced_into_batches(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path / "cat"))
    store.save(spark.createDataFrame([("/r", 0, 1, True), ("/r/a", 1, 1, False)], FILES))
    state = spark.createDataFrame([("/r", 0, 1, True), ("/r/a", 7, 1, False), ("/r/b", 2, 2, False)], FILES)
    notice = lambda *paths: spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "seq bigint, path string").withColumn("arrival_ts", F.current_timestamp()).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    notice("/r/a", "/r/a", "/r/b", None)
    updater = Updater(store, lambda: state, lambda: state)
    query = updater.start(notice_stream(spark, str(tmp_path / "in")), str(tmp_path / "ck"))
    try:
        for _ in range(900):
            if updater.applied or not query.isActive:
                break
            time.sleep(0.1)
    finally:
        query.stop()
    assert updater.applied == 1 and sorted((r.path, r.size) for r in store.load().collect()) == [("/r", 0), ("/r/a", 7), ("/r/b", 2)]


def test_a_large_difference_is_an_overflow(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    reader = lambda: _Watcher({"roots": json.dumps([str(root)]), "state": str(tmp_path / "s"), "most": "3"})
    start = reader().initialOffset()
    for i in range(9):
        (root / f"f{i}").write_text("x")
    rows, end = reader().read(start)
    assert [(p, o) for p, _, o in rows] == [(None, True)] and [o for *_, o in reader().readBetweenOffsets(start, end)] == [True]
    (root / "f0").unlink()
    rows, last = reader().read(end)
    assert [(os.path.basename(p), o) for p, _, o in rows] == [("f0", False)]
    reader().commit(last)
    assert reader().read(last)[1] == last


def test_session_helpers(spark):
    entries = derive(spark.createDataFrame([(f"/d/f{i}.txt", i, i, False) for i in range(30)], "path string, size bigint, mod bigint, is_dir boolean"))
    results = search.find(entries, parse(".txt", now=0), 20)
    assert len(Typing(spark).run(lambda: results)) == 20
    page = Page(20, 5)
    assert (page.move(7), page.offset, page.move(-3), page.offset, page.move(100), page.move(-100), page.offset) == (7, 3, 4, 3, 19, 0, 0)
    assert page.keep(results, "/d/f25.txt") == 4 and page.keep(results, "/none") == 0
    seen = []
    previews = Previews(lambda k: seen.append(k) or k, 2)
    for k in "aabca":
        previews.get(k)
    assert seen == ["a", "b", "c", "a"]
    assert (reference("/a"), reference("/a", 3)) == ("/a", "/a:3")
    assert search.keep_position(results, "/d/f29.txt").select(F.col("position")).first().position == 0
