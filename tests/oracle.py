"""Comparison of a registered query with its DuckDB text on the same tables."""

from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(sf_dir).iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, list) else value


def ordered(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=str)


def differences(df, con, sql):
    """(rows only in the query, rows only in the text); both empty if they agree."""
    mine = ordered([tuple(r) for r in df.collect()], df.columns)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = ordered(result.fetchall(), names)
    assert sorted(df.columns) == sorted(names)
    if mine == theirs:
        return [], []
    return [r for r in mine if r not in set(theirs)][:5] or mine[:5], [r for r in theirs if r not in set(mine)][:5]
