"""Counts and sums over a catalog, kinds of files, previews of files and folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions.display import looks_like_text
from skerry.plans.language import KINDS

# Category and sign of each kind of file (fixed values).
CATEGORIES = {"code": ("code", "‹›"), "doc": ("doc", "≡"), "image": ("image", "◩"), "audio": ("media", "♪"), "video": ("media", "♪"), "archive": ("archive", "▣"), "app": ("exec", "⚙")}
FOLDER_SIGN, OTHER_SIGN = "▸", "·"
PREVIEW_BYTES = 4 << 20
PREVIEW_LINES = 400
BEFORE_FOCUS, AFTER_FOCUS = 150, 250
FOLDER_ROWS = 500


def counts(entries: DataFrame) -> DataFrame:
    """(files, dirs)."""
    return entries.agg(F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("dirs"))


def stats(entries: DataFrame) -> DataFrame:
    """(files, dirs, bytes, path_bytes): one pass over the catalog."""
    return entries.agg(
        F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("dirs"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.octet_length("path")), F.lit(0)).alias("path_bytes")
    )


def kind_table(spark: SparkSession) -> DataFrame:
    """(ext, kind, category, sign): one row per extension; an extension of two kinds belongs to the first."""
    rows: dict[str, tuple] = {}
    for kind, names in KINDS.items():
        for ext in names:
            rows.setdefault(ext, (ext, kind, *CATEGORIES[kind]))
    return spark.createDataFrame(list(rows.values()), "ext string, kind string, category string, sign string")


def with_category(entries: DataFrame) -> DataFrame:
    """Entries with ``category`` and ``sign``; the table of kinds is a constant and always broadcast."""
    kinds = F.broadcast(kind_table(entries.sparkSession).drop("kind"))
    joined = entries.join(kinds, "ext", "left")
    return joined.withColumn("category", F.when(F.col("is_dir"), "dir").otherwise(F.coalesce("category", F.lit("other")))).withColumn(
        "sign", F.when(F.col("is_dir"), FOLDER_SIGN).otherwise(F.coalesce("sign", F.lit(OTHER_SIGN)))
    )


def parent_of(path: Column) -> Column:
    """The folder a path lies in, without its separator."""
    return F.regexp_replace(path, r"[\\/][^\\/]*$", "")


def folder_counts(entries: DataFrame) -> DataFrame:
    """(parent, files, dirs) of each folder's direct children."""
    return entries.groupBy(parent_of(F.col("path")).alias("parent")).agg(F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("dirs"))


def folder_listing(entries: DataFrame, folder: str, n: int = FOLDER_ROWS) -> DataFrame:
    """(name, is_dir, size, more): folders first, then by name in lower case; ``more`` counts what is not shown."""
    inside = entries.where(F.col("path").startswith(folder.rstrip("/") + "/")).where(parent_of(F.col("path")) == folder.rstrip("/"))
    shown = inside.select("name", "is_dir", "size").orderBy(F.col("is_dir").desc(), F.lower("name"), "name").limit(n)
    left = inside.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return shown.crossJoin(F.broadcast(left))  # one row


def preview(contents: DataFrame, line: int = 0) -> DataFrame:
    """(key, lines, first_line, focus, note) of files (path, text): the first lines, or those around ``line``."""
    head = F.substring("text", 1, PREVIEW_BYTES)
    note = F.when(F.coalesce(F.octet_length("text"), F.lit(0)) == 0, "empty").when(F.contains(F.substring("text", 1, 8000), F.lit("\x00")) | ~looks_like_text(F.col("text")), "binary").otherwise("")
    lines = F.split(F.replace(F.replace(head, F.lit("\r\n"), F.lit("\n")), F.lit("\t"), F.lit("    ")), "\n", -1)
    count = F.size("lines")
    low = F.greatest(F.lit(0), F.lit(line - 1 - BEFORE_FOCUS)) if line > 0 else F.lit(0)
    length = F.least(count, F.lit(line - 1 + AFTER_FOCUS)) - low if line > 0 else F.least(count, F.lit(PREVIEW_LINES))
    rows = contents.select("path", note.alias("note"), F.when(note == "", lines).otherwise(F.array().cast("array<string>")).alias("lines"))
    return rows.select(
        F.concat_ws(":", "path", F.lit(str(line))).alias("key"),
        F.slice("lines", low + 1, F.greatest(length, F.lit(0))).alias("lines"),
        (low + 1).cast("int").alias("first_line"),
        F.lit(line - 1 if line > 0 else -1).cast("int").alias("focus"),
        "note",
    )


def changes_per_minute(changes: DataFrame) -> DataFrame:
    """(minute, n): arrivals of change notices."""
    return changes.where("arrival_ts is not null").groupBy(F.date_trunc("minute", "arrival_ts").alias("minute")).agg(F.count("*").alias("n"))
