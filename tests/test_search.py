import random

import pytest
from pyspark.sql import functions as F

from skerry.functions import display
from skerry.operators import changes, grep, search, stats
from skerry.operators.score import fuzzy
from skerry.plans.language import parse
from skerry.sources.catalog import derive

NOW = 1_700_000_000
TREE = ["/r", "/r/src", "/r/src/ui", "/r/docs", "/r/photos", "/r/src/main.go", "/r/src/ui/tui.go", "/r/docs/README.md", "/r/docs/AnnualReportFinal.pdf"]


def catalog(spark, paths, size=10, mod=NOW):
    return derive(spark.createDataFrame([(p, size, mod, "." not in p.rsplit("/", 1)[-1]) for p in paths], "path string, size bigint, mod bigint, is_dir boolean"))


def plan(line):
    return parse(line, now=NOW, home="/home/u", cwd="/")


GOLDEN = {
    "tui": {"/r/src/ui/tui.go": 124},
    "main go": {"/r/src/main.go": 299},
    "ui": {"/r/src/ui/tui.go": 86, "/r/src/ui": 124, "/r/docs/AnnualReportFinal.pdf": 32},
    "^read": {"/r/docs/README.md": 123},
    ".go$": {"/r/src/main.go": 47, "/r/src/ui/tui.go": 47},
    "'main": {"/r/src/main.go": 103},
    "photos/": {"/r/photos": 253},
    "rprt": {"/r/docs/AnnualReportFinal.pdf": 95},
    "arf": {"/r/docs/AnnualReportFinal.pdf": 63},
    "go !ui": {"/r/src/main.go": 148},
}


@pytest.mark.parametrize("line", GOLDEN)
def test_points(spark, line):
    got = {r.path: r.key for r in search.find(catalog(spark, TREE), plan(line)).collect()}
    assert got == GOLDEN[line]


def walk(low, text, original):
    """The fuzzy walk as plain loops over bytes."""
    at = 0
    for c in text:
        at = low.find(c, at) + 1
        if not at:
            return None
    start = at
    for c in reversed(text):
        start = low.rfind(c, 0, start)
    points, before, i = 0, None, start
    for c in text:
        i = low.find(c, i)
        points += 16
        if i == 0 or low[i - 1] in "/\\_-. ([":
            points += 12
        elif original[i].isupper() and original[i - 1].islower():
            points += 8
        if before is not None:
            gap = i - before - 1
            points += 10 if gap == 0 else -(4 + min(gap, 20))
        before, i = i, i + 1
    span = at - start
    return points + (30 if span == len(text) else 10 if span <= 2 * len(text) else 0)


def test_fuzzy_equals_plain_loops(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abAB/_. (z'\\$%") for _ in range(rng.randint(0, 24))) for _ in range(400)]
    df = spark.createDataFrame([(t, t.lower()) for t in texts], "o string, low string").cache()
    for pattern in ("a", "ab", "aba", "a.b", "zz", "ba(", "abab", "'", "a'b", "\\", "\\a", "$a", "a%_"):
        got = {r.o: r.s for r in df.select("o", fuzzy("low", "o", pattern).alias("s")).collect()}
        assert got == {t: walk(t.lower(), pattern, t) for t in texts}


def test_folder_boundary_and_dotfiles(spark):
    tree = catalog(spark, ["/x/work/report.pdf", "/x/workshop/report.pdf", "/x/photos", "/x/photos/beach.heic", "/x/repo/.gitignore"])
    names = lambda line: sorted(r.path for r in search.find(tree, plan(line)).collect())
    assert names("/x/work .pdf") == ["/x/work/report.pdf"]
    assert names("is:image") == ["/x/photos/beach.heic"]
    assert names("photos/") == ["/x/photos"]
    assert names(".gitignore") == ["/x/repo/.gitignore"]
    assert names("name/ .pdf") == []
    assert search.find(tree, plan("report"), n=0).count() == 0
    assert search.total(tree, plan("report")).first().total == 2


def test_order_of_ties(spark):
    tree = catalog(spark, ["/b.txt", "/a.txt", "/aa.txt"])
    assert [r.path for r in search.find(tree, plan(".txt")).orderBy("rank").collect()] == ["/a.txt", "/b.txt", "/aa.txt"]


def test_positions_and_runs(spark):
    tree = catalog(spark, ["/r/src/main.go"])
    p = plan("'src ^main go$ !zip")
    row = tree.select(search.match_positions(p).alias("at"), search.highlight_runs(F.col("name"), F.array(F.lit(0), F.lit(1))).alias("runs")).first()
    assert row["at"] == [3, 4, 5, 7, 8, 9, 10, 12, 13]
    assert [(x.text, x.matched) for x in row["runs"]] == [("ma", True), ("in.go", False)]
    assert tree.select(search.match_positions(plan("mg")).alias("at")).first()["at"] == [7, 12]


def hits(spark, files, pattern, regex=False, **options):
    df = spark.createDataFrame(files, "path string, text string")
    return [tuple(r) for r in grep.grep(df, grep.Matcher(pattern, regex), **options).orderBy("path", "line").collect()]


def test_grep(spark):
    files = [("/a", "x\n\t\tsee TODO\r\nnothing"), ("/b", "todo\ntodo"), ("/c", None), ("/d", "")]
    assert hits(spark, files, "TODO") == [("/a", 2, 4, 4, "see TODO")]
    assert [h[:2] for h in hits(spark, files, "todo")] == [("/a", 2), ("/b", 1), ("/b", 2)]
    assert [h[:2] for h in hits(spark, files, "to+do$", True)] == [("/b", 1), ("/b", 2)]
    assert hits(spark, files, "q*", True) == []
    assert len(hits(spark, [("/m", "k\n" * 150)], "k")) == 100
    long = "é" * 300 + "needle" + "y" * 600
    ((_, _, col, size, text),) = hits(spark, [("/l", long)], "needle")
    assert (col, size) == (80, 6) and len(text.encode()) == 400 and text.encode()[col : col + size] == b"needle"
    with pytest.raises(ValueError):
        grep.Matcher("")
    with pytest.raises(ValueError):
        grep.Matcher("a(?=b)", True)


def test_binary_content(spark):
    df = spark.createDataFrame([(b"\x00\x01TODO",), (b"ok \xff\xfe",)], "content binary")
    assert [r.t for r in df.select(grep.text_of_bytes(F.col("content")).alias("t")).collect()][0] is None
    assert df.select(display.valid_utf8(F.col("content")).alias("t")).collect()[1].t == "ok ?"


def test_display(spark):
    sizes = [0, 1023, 1024, 2304, 10752, 5 << 20, 3 << 50]
    df = spark.createDataFrame([(x,) for x in sizes], "n bigint")
    assert [r.s for r in df.select(display.human_size(F.col("n")).alias("s")).collect()] == [display.size_text(x) for x in sizes] == ["0 B", "1023 B", "1.0 KB", "2.2 KB", "10 KB", "5.0 MB", "3.0 PB"]
    ages = [NOW + 5, NOW, NOW - 120, NOW - 7200, NOW - 3 * 86400, NOW - 70 * 86400, NOW - 800 * 86400]
    got = spark.createDataFrame([(x,) for x in ages], "m bigint").select(display.human_age(F.col("m"), NOW).alias("s")).collect()
    assert [r.s for r in got] == ["future", "now", "2m ago", "2h ago", "3d ago", "2mo ago", "2y ago"]
    assert [display.duration_text(x) for x in (1e-6, 5e-4, 0.02, 2.34)] == ["<10µs", "500µs", "20ms", "2.3s"]


def test_category_of_shared_extension(spark):
    rows = stats.with_category(catalog(spark, ["/a.ts", "/b", "/c.weird", "/d.mp4"])).select("path", "category").collect()
    assert {r.path: r.category for r in rows} == {"/a.ts": "code", "/b": "dir", "/c.weird": "other", "/d.mp4": "media"}


def test_preview(spark):
    text = "\n".join(f"l{i}\tx" for i in range(1, 1001))
    df = spark.createDataFrame([("/t", text), ("/e", ""), ("/b", "\x00\x01")], "path string, text string")
    first = {r.key: r for r in stats.preview(df).collect()}
    assert len(first["/t:0"].lines) == 400 and first["/t:0"].lines[0] == "l1    x"
    assert first["/e:0"].note == "empty" and first["/b:0"].note == "binary"
    near = stats.preview(df, line=500).where("key like '/t%'").first()
    assert (near.first_line, near.focus, len(near.lines), near.lines[0]) == (350, 499, 400, "l350    x")


def test_change_batch(spark):
    rows = lambda items: spark.createDataFrame([(p, 1, 1, p.count(".") == 0) for p in items], "path string, size bigint, mod bigint, is_dir boolean")
    before = rows(["/r", "/r/a.txt", "/r/old", "/r/old/inner.txt", "/r/keep", "/r/keep/k.txt", "/r/turn", "/r/turn/x.txt"])
    now = spark.createDataFrame(
        [("/r", 0, 9, True), ("/r/b.txt", 2, 2, False), ("/r/new", 0, 2, True), ("/r/new/deep", 0, 2, True), ("/r/new/deep/f.txt", 3, 2, False), ("/r/keep", 0, 9, True), ("/r/keep/k.txt", 1, 1, False), ("/r/turn", 7, 7, False), ("/r/.git/c", 1, 1, False)],
        "path string, size bigint, mod bigint, is_dir boolean",
    )
    notices = spark.createDataFrame([(p,) for p in ["/r/a.txt", "/r/b.txt", "/r/old", "/r/old/inner.txt", "/r/new", "/r/new/deep/f.txt", "/r/keep", "/r/turn", "/r/.git/c", "/r/b.txt", None]], "path string")
    got = sorted(tuple(r) for r in changes.apply_changes(before, notices, now, (".git",)).collect())
    assert got == [
        ("/r", 1, 1, True), ("/r/b.txt", 2, 2, False), ("/r/keep", 0, 9, True), ("/r/keep/k.txt", 1, 1, False), ("/r/new", 0, 2, True),
        ("/r/new/deep", 0, 2, True), ("/r/new/deep/f.txt", 3, 2, False), ("/r/turn", 7, 7, False),
    ]
    assert before.count() == 8
