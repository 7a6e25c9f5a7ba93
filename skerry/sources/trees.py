"""File trees over the test tables: the newest snapshot of ``entries``, and the texts of ``documents`` as files.

Each tree has the same meaning as the SQL text beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.runtime import table
from skerry.sources.catalog import derive

#: The fixed present of all registered queries: 2024-02-01 00:00 UTC.
NOW = 1706745600
_DOCUMENT_PATH = """concat('/corpus/', coalesce(source, 'none'), '/', coalesce(lang, 'xx'), '/',
  case when doc_id % 3 = 0 then 'AnnualReport_' when doc_id % 3 = 1 then 'doc-' else '.note' end, lpad(cast(doc_id as varchar(20)), 8, '0'),
  case cast(doc_id % 12 as int) when 0 then '.txt' when 1 then '.md' when 2 then '.go' when 3 then '.py' when 4 then '.pdf' when 5 then '.JPG'
  when 6 then '.mp3' when 7 then '.mp4' when 8 then '.zip' when 9 then '.exe' when 10 then '.tar.gz' else '' end)"""
_DERIVED_SQL = """
  case when regexp_extract(path, '[^\\\\/]+$', 0) = '' then path else regexp_extract(path, '[^\\\\/]+$', 0) end as name"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def derive_sql(source: str) -> str:
    """The derived columns over a table expression of (path, size, mod, is_dir)."""
    return f"""(select *, translate(path, '{UPPER}', '{LOWER}') as path_lower, translate(name, '{UPPER}', '{LOWER}') as name_lower,
  translate(substr(path, 1, length(path) - length(name)), '{UPPER}', '{LOWER}') as dir_lower, strlen(path) - strlen(name) as base_off, strlen(path) as path_len,
  lower(regexp_extract(name, '(?s)^.+\\.([^.]+)$', 1)) as ext from (select *, {_DERIVED_SQL} from {source}))"""


def _snapshot_sql(back: int) -> str:
    return f"""(select path, size, mod, is_dir from (select path, coalesce(size, 0) as size, coalesce(mod, 0) as mod, coalesce(is_dir, false) as is_dir,
  row_number() over (partition by path order by seen_ts desc nulls last, coalesce(size, 0) desc, coalesce(mod, 0) desc, coalesce(is_dir, false) desc) as rn from entries
  where path is not null and snap_id = (select snap_id from snapshots where taken_ts is not null order by taken_ts desc, snap_id desc limit 1 offset {back})) where rn = 1)"""


LATEST_SQL, BEFORE_SQL = derive_sql(_snapshot_sql(0)), derive_sql(_snapshot_sql(1))
DOCUMENTS_SQL = derive_sql(f"(select {_DOCUMENT_PATH} as path, strlen(coalesce(text, '')) as size, 1706745600 - (doc_id * 7919) % 40000000 as mod, false as is_dir from documents)")
CONTENTS_SQL = f"(select {_DOCUMENT_PATH} as path, text from documents where text is not null)"


def snapshot(spark: SparkSession, sf_dir: str, back: int = 0) -> DataFrame:
    """The catalog of the newest snapshot, or of an earlier one: the latest row of each path."""
    order = table(spark, sf_dir, "snapshots").where("taken_ts is not null").orderBy(F.col("taken_ts").desc(), F.col("snap_id").desc()).select("snap_id").offset(back).limit(1)
    wanted = [r.snap_id for r in order.collect()]
    state = F.struct("seen_ts", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("mod", F.lit(0)).alias("mod"), F.coalesce("is_dir", F.lit(False)).alias("is_dir"))
    rows = table(spark, sf_dir, "entries").where(F.col("snap_id").isin(wanted) & F.col("path").isNotNull())
    last = rows.groupBy("path").agg(F.max(state).alias("s"))
    return derive(last.select("path", "s.size", "s.mod", "s.is_dir"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of the documents as files."""
    rows = table(spark, sf_dir, "documents").select(
        F.expr(_DOCUMENT_PATH).alias("path"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"), F.expr("cast(1706745600 - (doc_id * 7919) % 40000000 as bigint)").alias("mod"), F.lit(False).alias("is_dir")
    )
    return derive(rows)


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of the documents as files."""
    return table(spark, sf_dir, "documents").where("text is not null").select(F.expr(_DOCUMENT_PATH).alias("path"), "text")
