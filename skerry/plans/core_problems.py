"""Registered queries of the general data problems, with their DuckDB texts."""

from __future__ import annotations

from skerry.operators.snapshots import change_summary, snapshot_changes
from skerry.runtime import table


def p1_found(spark, sf_dir):
    return snapshot_changes(table(spark, sf_dir, "entries"), table(spark, sf_dir, "snapshots"))


def p1_summary(spark, sf_dir):
    return change_summary(p1_found(spark, sf_dir))


_P1 = """
with o as (select snap_id, row_number() over (order by taken_ts, snap_id) as k from snapshots where taken_ts is not null),
last as (select snap_id, path, coalesce(size, 0) as size, coalesce(mod, 0) as mod, coalesce(is_dir, false) as is_dir
  from (select *, row_number() over (partition by snap_id, path order by seen_ts desc nulls last, coalesce(size,0) desc, coalesce(mod,0) desc, is_dir desc) as rn
        from entries where path is not null) where rn = 1),
e as (select l.*, o.k from last l join o using (snap_id)),
found as (select coalesce(n.k, w.k + 1) as k, coalesce(n.path, w.path) as path,
  case when w.path is null then 'added' when n.path is null then 'removed' else 'changed' end as change_kind
  from e n full join e w on n.path = w.path and n.k = w.k + 1
  where n.path is null or w.path is null or n.size <> w.size or n.mod <> w.mod or n.is_dir <> w.is_dir),
changes as (select o.snap_id, f.path, f.change_kind from found f join o on o.k = f.k where f.k > 1)
"""

QUERIES = {"p1_found": p1_found, "p1_summary": p1_summary}
ORACLE = {
    "p1_found": _P1 + "select snap_id, path, change_kind from changes",
    "p1_summary": _P1 + "select snap_id, change_kind, count(*) as n from changes group by all",
}
