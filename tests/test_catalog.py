import io
import json
import os

import pytest
from pyspark.sql import functions as F

from skerry.engine import Engine, main
from skerry.operators.snapshots import snapshot_changes
from skerry.sources.catalog import CatalogStore, CorruptCatalog, _Reader, build_catalog, default_roots, derive
from skerry.streaming.updates import Updater, notice_stream

SCHEMA = "snap_id int, path string, size bigint, mod bigint, is_dir boolean, seen_ts timestamp"


@pytest.fixture
def tree(tmp_path):
    for name, body in {
        "src/main.go": b"package main\n", "src/ui/tui.go": b"// TODO render\n", "docs/README.md": b"see TODO list\n",
        "docs/big.bin": b"\x00\x01 TODO", "node_modules/x/tui.js": b"TODO",
    }.items():
        p = tmp_path / "r" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    return str(tmp_path / "r")


def test_scan_save_load_search_grep(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "cat"))
    with pytest.raises(CorruptCatalog):
        engine.catalog()
    assert engine.index([tree]) == 1
    rows = {r.path: r for r in engine.catalog().collect()}
    assert tree in rows and not any("node_modules" in p for p in rows)
    assert rows[f"{tree}/src/main.go"].size == 13 and rows[f"{tree}/src"].is_dir
    for line, best in {"tui": "tui.go", "main go": "main.go", "readme ext:md": "README.md", "is:dir ui": "ui", "^read": "README.md"}.items():
        assert engine.pick(line).endswith("/" + best), line
    assert engine.pick("'tui !ui") is None and engine.pick("size:>1kb") is None
    for word in ("todo", "TODO"):
        assert sorted((os.path.basename(r.path), r.line) for r in engine.grep(word).collect()) == [("README.md", 1), ("tui.go", 1)]
    out = io.StringIO()
    assert main(["find", "tui", "--catalog", str(tmp_path / "cat"), "-n", "1"], spark, out) == 0
    assert out.getvalue().strip().endswith("tui.go")
    assert main(["stats", "--catalog", str(tmp_path / "cat")], spark, out) == 0
    assert main(["find", "is:bogus", "--catalog", str(tmp_path / "cat")], spark, out) == 1


def test_content_search_opens_only_candidates(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "cat"))
    assert engine.index([tree, tree + "/src", tree]) == 1 and engine.progress.get["entries"] == engine.catalog().count()
    hits = engine.grep("todo .go").collect()
    assert [os.path.basename(r.path) for r in hits] == ["tui.go"]
    assert engine.scanned.get == {"files": 2, "bytes": len(b"package main\n// TODO render\n")}
    assert [[os.path.basename(r.path) for r in b] for b in engine.hits("todo", batch=1)] == [["README.md"], ["tui.go"]]
    some = engine.hits("todo", batch=1)
    assert next(some)[0].line == 1 and some.close() is None
    os.unlink(tree + "/src/ui/tui.go")
    assert engine.grep("todo .go").collect() == [] and engine.scanned.get["files"] == 1
    row = engine.stats().first()
    assert row.index_bytes > 0 and row.age >= 0 and row.roots[0] == tree and "node_modules" in row.excludes and engine.total("is:file") == 5 - 1
    out = io.StringIO()
    assert main(["watch", "--rounds", "1", "--seconds", "0", "--catalog", str(tmp_path / "cat")], spark, out) == 0
    assert " entries, -1" in out.getvalue()
    assert main(["stats", "--catalog", str(tmp_path / "cat")], spark, out) == 0 and "left out: " in out.getvalue()


def test_a_held_catalog_follows_its_versions(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "cat"), hold=True)
    engine.index([tree])
    first = engine.catalog()
    assert engine.catalog() is first and engine.pick("tui").endswith("tui.go")
    os.rename(tree + "/src/ui/tui.go", tree + "/src/ui/gui.go")
    engine.index([tree])
    assert engine.pick("'tui.go") is None and engine.pick("gui").endswith("gui.go")
    assert default_roots("nt") == ["C:\\"] and len(default_roots()) == 1


def test_a_deep_folder_is_divided(spark, tmp_path):
    deep = tmp_path / "one" / "two"
    for i in range(40):
        (deep / f"d{i}").mkdir(parents=True)
        (deep / f"d{i}" / "f").write_text("x")
    reader = _Reader({"roots": json.dumps([str(tmp_path)]), "folders": "30"})
    parts = reader.partitions()
    assert 40 <= len(parts) and len({r[0] for p in parts for r in reader.read(p)}) == sum(1 for p in parts for _ in reader.read(p)) == 83
    gone = _Reader({"roots": json.dumps([str(tmp_path / "none")])})
    assert [r for p in gone.partitions() for r in gone.read(p)] == []


def test_engine_follows_notices(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "cat"))
    engine.index([tree])
    engine.follow(str(tmp_path / "w"), once=True).awaitTermination()
    os.unlink(tree + "/docs/README.md")
    with open(tree + "/docs/new.md", "w") as f:
        f.write("new")
    engine.follow(str(tmp_path / "w"), once=True).awaitTermination()
    assert engine.pick("new.md").endswith("new.md") and engine.pick("'readme") is None


def test_overlapping_roots_and_missing_roots(spark, tree):
    rows = build_catalog(spark, [tree, tree + "/src", "/no/such/folder"], excludes=("BIG.BIN",))
    assert rows.count() == rows.select("path").distinct().count()
    assert rows.where(F.col("path").endswith("big.bin")).count() == 0
    with pytest.raises(ValueError):
        build_catalog(spark, ["/no/such/folder"])


def test_versions(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path / "v"))
    one = spark.createDataFrame([("/b", 1, 1, False), ("/a", None, None, None)], "path string, size bigint, mod bigint, is_dir boolean")
    assert store.save(one) == 1
    first = store.load()
    assert store.save(one.where("path = '/b'"), roots=["/"]) == 2
    assert sorted(r.path for r in first.collect()) == ["/a", "/b"]
    assert [r.path for r in store.load().collect()] == ["/b"]
    assert store.compact() == 2 and store.publish(one.selectExpr("'put' as op", "*").where("path = '/a'")) == 3 and store.load().count() == 2
    assert store.compact() == 4 and store.vacuum(1) == 3 and store.load().count() == 2 and store.metadata()["roots"] == ["/"]
    assert derive(spark.createDataFrame([("/" + "ä" * 32_767, 1, 1, False), ("/" + "ä" * 32_768, 1, 1, False)], one.schema)).count() == 1
    (tmp_path / "v" / "CURRENT").write_text("junk")
    with pytest.raises(CorruptCatalog):
        store.load()


def test_stream_of_notices(spark, tmp_path):
    schema = "path string, size bigint, mod bigint, is_dir boolean"
    store = CatalogStore(spark, str(tmp_path / "live"))
    store.save(spark.createDataFrame([("/r", 0, 1, True), ("/r/a", 1, 1, False), ("/r/b", 1, 1, False)], schema))
    state = spark.createDataFrame([("/r", 0, 1, True), ("/r/a", 5, 5, False), ("/r/c", 2, 2, False)], schema)
    notices = spark.createDataFrame([(1, "/r/a"), (2, "/r/b"), (3, "/r/c"), (4, "/own/x"), (5, None)], "seq bigint, path string").withColumn("arrival_ts", F.current_timestamp())
    notices.write.parquet(str(tmp_path / "in"))
    seen = []
    updater = Updater(store, lambda: state, lambda: state, own_folder="/own", on_update=seen.append)
    updater.start(notice_stream(spark, str(tmp_path / "in")), str(tmp_path / "ck"), once=True).awaitTermination()
    assert seen == [2]
    assert sorted((r.path, r.size) for r in store.load().collect()) == [("/r", 0), ("/r/a", 5), ("/r/c", 2)]


def changed(spark, rows, snaps=((1, "2024-01-01"), (2, "2024-01-02"))):
    entries = spark.createDataFrame(rows, "snap_id int, path string, size bigint, mod bigint, is_dir boolean, seen string").withColumn("seen_ts", F.to_timestamp("seen")).withColumn("kind", F.lit(1))
    order = spark.createDataFrame(list(snaps), "snap_id int, t string").withColumn("taken_ts", F.to_timestamp("t"))
    return sorted(tuple(r) for r in snapshot_changes(entries, order, leaf_bits=7).collect())


def test_snapshot_changes_edges(spark):
    rows = [
        (1, "/same", 1, 1, False, "2024-01-01"), (2, "/same", 1, 1, False, "2024-01-09"),
        (1, "/null", None, None, None, None), (2, "/null", 0, 0, False, "2024-01-02"),
        (1, "/gone", 1, 1, False, "2024-01-01"), (2, "/new", 1, 1, False, "2024-01-02"),
        (1, "/dup", 1, 1, False, "2024-01-01"), (1, "/dup", 2, 1, False, "2024-01-03"), (1, "/dup", 2, 1, False, "2024-01-03"), (2, "/dup", 1, 1, False, "2024-01-02"),
        (1, "/late", 1, 1, False, "2024-01-01"), (2, "/late", 9, 1, False, "2023-01-01"), (2, "/late", 1, 1, False, "2024-01-01"),
        (1, "/kind", 0, 1, True, "2024-01-01"), (2, "/kind", 0, 1, False, "2024-01-01"),
        (1, None, 1, 1, False, "2024-01-01"), (7, "/unknown", 1, 1, False, "2024-01-01"),
        (1, "", 1, 1, False, "2024-01-01"), (2, "x" * 100_000, 1, 1, False, "2024-01-01"),
    ]
    ties = [(n, "/tie", v, 1, False, "2024-01-01") for n in (1, 2) for v in ((1, 2, 3) if n == 1 else (3, 1, 2))]
    assert changed(spark, ties) == []
    want = [(2, "", "removed"), (2, "/dup", "changed"), (2, "/gone", "removed"), (2, "/kind", "changed"), (2, "/new", "added"), (2, "x" * 100_000, "added")]
    assert changed(spark, rows) == want
    assert changed(spark, rows, ((2, "2024-01-02"), (1, "2024-01-05")))[1] == (1, "/dup", "changed")
    assert changed(spark, rows, ((1, "2024-01-01"),)) == []
    assert changed(spark, []) == []
    assert {k for *_, k in changed(spark, rows[:1] + rows[6:7], ((1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-03")))} == {"removed"}
