"""Percentiles per group over very large columns, with a deterministic bound on the rank error, in mergeable form.

Values are quantized to an ordered universe of ``2**LEVELS`` cells (sign, exponent and ``MANTISSA`` leading bits; values below
``2**(MANTISSA + 1)`` have a cell of their own). A group is a compressed tree of dyadic intervals over that universe: a node
holds a count, and a subtree whose whole count is within the budget ``epsilon * n`` collapses into its root. Trees of separate
portions, days or groups merge by adding the counts of equal nodes, and may be compressed again.

Error. Collapsed subtrees of one compression are disjoint, so it moves a value by less ranks than the largest of them holds.
Merging moves nothing. Every tree carries the ``slack`` it has gathered, the sum of those maxima, and reports it, together with
the largest count of a cell that is wider than one value. A pipeline that compresses ``s`` times gives each step the budget
``epsilon / s``, so the bound is true for every group and at most ``epsilon * n``.

Portions. Rows of a group meet in one task before they are compressed, so small groups need one portion; a group of more than
``PORTION_ROWS`` rows is salted over several tasks, whose trees merge afterwards.

Defined results: NULL values are counted apart and take part in no rank; NULL group keys form a group of their own; ties and
repeated values add counts; an empty table gives no groups; a group whose values are all NULL has no row; only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.paths import extension_of
from skerry.runtime import broadcast_if_small, cut, table

#: Values below ``2**(MANTISSA + 1)`` have a cell of their own.
MANTISSA = 55
LEVELS = 60  # sign and (63 - MANTISSA + 1) * 2**MANTISSA cells
EPSILON = 0.01
PERCENTILES = (0.25, 0.5, 0.75, 0.9, 0.99)
#: Rows of a group that one task compresses.
PORTION_ROWS = 200_000


def cells_of(values: np.ndarray) -> np.ndarray:
    """Cells of signed 64-bit integers; the order of values is kept."""
    negative = values < 0
    v = np.where(negative, ~values, values).astype(np.uint64)
    shift = np.maximum(0, np.frexp(v.astype(np.float64))[1] - MANTISSA - 1).astype(np.uint64)
    # Rounding to float may overstate the exponent by one.
    shift = np.where((shift > 0) & ((v >> shift) < (1 << MANTISSA)), shift - np.uint64(1), shift)
    cell = ((shift << np.uint64(MANTISSA)) + (v >> shift)).astype(np.int64)
    half = 1 << (LEVELS - 1)
    return np.where(negative, half - 1 - cell, half + cell)


def value_of(cell: np.ndarray) -> np.ndarray:
    """The largest value of a cell."""
    half = 1 << (LEVELS - 1)
    negative = cell < half
    c = np.where(negative, half - 1 - cell, cell - half).astype(np.uint64)
    shift = np.where(c < (2 << MANTISSA), 0, (c >> np.uint64(MANTISSA)) - np.uint64(1)).astype(np.uint64)
    low = (c - (shift << np.uint64(MANTISSA))) << shift
    high = low + (np.uint64(1) << shift) - np.uint64(1)
    return np.where(negative, ~low.astype(np.int64), high.astype(np.int64))


def _sum_equal(group: np.ndarray, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((node, group))
    group, node, count = group[order], node[order], count[order]
    first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (node[1:] != node[:-1])]) if len(group) else np.zeros(0, np.int64)
    return group[first], node[first], np.add.reduceat(count, first) if len(first) else count


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, budget: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trees of many groups at once, and the ranks lost by each group.

    ``node`` is numbered as in a heap (root 1, leaves ``2**LEVELS + cell``). The largest subtrees with at most ``budget[group]``
    counts collapse. One walk over the levels keeps, for each subtree, its count and the node that stands for it.
    """
    group, node, count = _sum_equal(group, node, count)
    lost = np.zeros(len(budget), np.int64)
    work = budget[group] > 1
    done = [(group[~work], node[~work], count[~work])]
    group, node, count = group[work], node[work], count[work]
    depth = _level(node)
    order = np.lexsort((node, group, -depth))
    group, node, count, depth = group[order], node[order], count[order], depth[order]
    starts = np.searchsorted(-depth, -np.arange(LEVELS, -2, -1), "left")  # of each level, deepest first
    g = at = total = rep = np.zeros(0, np.int64)  # subtrees of the level above, in order; total -1: too large to collapse
    formed = np.zeros(0, bool)
    for level in range(LEVELS, -1, -1):
        own = slice(starts[LEVELS - level], starts[LEVELS - level + 1])
        g2, at2 = np.r_[g, group[own]], np.r_[at >> 1, node[own]]
        total2, rep2, formed2 = np.r_[total, count[own]], np.r_[rep, node[own]], np.r_[formed, np.zeros(own.stop - own.start, bool)]
        if not len(g2):
            continue
        if own.stop > own.start and len(g):
            order = np.lexsort((at2, g2))
            g2, at2, total2, rep2, formed2 = g2[order], at2[order], total2[order], rep2[order], formed2[order]
        first = np.flatnonzero(np.r_[True, (g2[1:] != g2[:-1]) | (at2[1:] != at2[:-1])])
        members = np.diff(np.r_[first, len(g2)])
        whole = np.add.reduceat(total2, first)
        fits = (np.minimum.reduceat(total2, first) >= 0) & (whole <= budget[g2[first]])
        leave = ~np.repeat(fits, members) & (total2 >= 0)
        done.append((g2[leave], rep2[leave], total2[leave]))
        np.maximum.at(lost, g2[leave & formed2], total2[leave & formed2])
        alone = members == 1
        g, at, total = g2[first], at2[first], np.where(fits, whole, -1)
        rep, formed = np.where(alone, rep2[first], at), np.where(alone, formed2[first], True)
    keep = total >= 0
    done.append((g[keep], rep[keep], total[keep]))
    np.maximum.at(lost, g[keep & formed], total[keep & formed])
    return (*(np.concatenate(x) for x in zip(*done)), lost)


def _level(node: np.ndarray) -> np.ndarray:
    level = np.frexp(node.astype(np.float64))[1].astype(np.int64) - 1
    return level - (node < (np.int64(1) << level))  # rounding to float may overstate it by one


def percentiles_of(group: np.ndarray, node: np.ndarray, count: np.ndarray, groups: int, at: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """(groups x percentiles) values, the upper end of the node in which the rank is reached; and the largest wide cell by group."""
    span = LEVELS - _level(node)
    high = ((node + 1) << span) - 1 - (np.int64(1) << LEVELS)
    order = np.lexsort((span, high, group))
    group, high, count, span = group[order], high[order], count[order], span[order]
    total = np.cumsum(count)
    ends = np.searchsorted(group, np.arange(groups), "right")
    starts = np.searchsorted(group, np.arange(groups), "left")
    before = np.r_[0, total][starts]
    n = np.r_[0, total][ends] - before
    out = np.zeros((groups, len(at)), np.int64)
    for i, q in enumerate(at):
        rank = before + np.maximum(1, np.ceil(q * n)).astype(np.int64)
        out[:, i] = high[np.minimum(np.searchsorted(total, rank), max(0, len(high) - 1))] if len(high) else 0
    wide = np.zeros(groups, np.int64)
    half = np.int64(1) << (LEVELS - 1)
    coarse = (span == 0) & (np.where(high < half, half - 1 - high, high - half) >= (np.int64(2) << MANTISSA))
    np.maximum.at(wide, group[coarse], count[coarse])
    return value_of(out), wide


def _numbered(t: pa.Table, keys: list[str]) -> tuple[np.ndarray, pa.Table]:
    """Group number of each row, and the table of groups in the order of their numbers."""
    number = np.zeros(t.num_rows, np.int64)
    for k in keys:
        codes = pc.dictionary_encode(t[k], null_encoding="encode").combine_chunks()
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        number = np.unique(number * (len(codes.dictionary) + 1) + codes.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1].astype(np.int64)
    first = np.unique(number, return_index=True)[1]
    return number, t.select(keys).take(pa.array(first))


def _tree_rows(groups: pa.Table, g: np.ndarray, node: np.ndarray, count: np.ndarray, slack: np.ndarray) -> pa.Table:
    """Trees as (keys, node, cnt); the slack of a tree stands in a row with node 0, so it adds up like a count."""
    loose = np.flatnonzero(slack)
    g, node, count = np.r_[g, loose], np.r_[node, np.zeros(len(loose), np.int64)], np.r_[count, slack[loose]]
    order = np.argsort(g, kind="stable")
    return groups.take(pa.array(g[order])).append_column("node", pa.array(node[order])).append_column("cnt", pa.array(count[order]))


def _answers(groups: pa.Table, g: np.ndarray, node: np.ndarray, count: np.ndarray, slack: np.ndarray, at: Sequence[float]) -> pa.Table:
    """(keys, n, rank_error, p..) of trees."""
    n = np.bincount(g, weights=count, minlength=groups.num_rows).astype(np.int64)
    p, wide = percentiles_of(g, node, count, groups.num_rows, at)
    out = groups.append_column("n", pa.array(n)).append_column("rank_error", pa.array(slack + wide))
    for i, q in enumerate(at):
        out = out.append_column(_name(q), pa.array(p[:, i]))
    return out


def _name(q: float) -> str:
    return f"p{round(q * 100):02d}"


def _types(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)


def _answer_types(at: Sequence[float]) -> str:
    return "n bigint, rank_error bigint, " + ", ".join(f"{_name(q)} bigint" for q in at)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 100_000) -> Iterator[pa.Table]:
    """Tables of complete groups, of at least ``least`` rows but for the last, from batches sorted by group."""
    held: list[pa.RecordBatch] = []
    rows, limit = 0, least
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < limit:
            continue
        t = pa.Table.from_batches(held)
        number, _ = _numbered(t, keys)
        other = np.flatnonzero(number != number[-1])
        change = int(other[-1]) + 1 if len(other) else 0
        if change:
            yield t.slice(0, change)
            held = t.slice(change).to_batches()
            rows -= change
        limit = max(least, 2 * rows)  # one long group is looked at again only when it has doubled
    if held:
        yield pa.Table.from_batches(held)


def salted(df: DataFrame, keys: list[str], by: Column, portion: int = PORTION_ROWS) -> DataFrame:
    """``df`` with ``salt`` and ``salts``: rows of a group spread by ``by`` over as many salts as it has portions.

    Unchanged if every group has one portion. Only groups of more than one portion are broadcast, so there are at most rows / ``portion`` of them.
    """
    large = cut(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > portion).select(*[F.col(k).alias(f"_{k}") for k in keys], F.ceil(F.col("_n") / portion).cast("int").alias("salts")))
    if large.isEmpty():
        return df
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = df.join(broadcast_if_small(large, 200), match, "left").drop(*[f"_{k}" for k in keys])
    return joined.withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", F.pmod(by, F.col("salts")))


def digest(df: DataFrame, keys: list[str], values: list[str], budget: float = EPSILON / 2, portion: int = PORTION_ROWS, at: Sequence[float] | None = None, last: tuple[list[str], str] | None = None) -> DataFrame:
    """(keys, field, node, cnt): a tree per group, value column and portion; NULL values are left out. One shuffle of the rows.

    With ``at`` also the answers (n, rank_error, p..) of each group that has one portion, whose trees are then left out; no
    merge follows for them, so they have twice the budget.
    With ``last`` = (identity columns, order column) only the latest row of an identity counts; NULL is the earliest.
    """
    rows = df.select(*keys, *(last[0] if last else []), *([F.col(last[1]).alias("_at")] if last else []), *[F.col(v).cast("bigint").alias(v) for v in values])
    identity = F.xxhash64(*last[0]) if last else F.xxhash64(*values, F.monotonically_increasing_id())
    portions = salted(rows, keys, identity, portion)
    salt = [c for c in ("salt", "salts") if c in portions.columns and c not in keys]
    # The only exchange of rows: the aggregate below finds its rows together already.
    portions = portions.repartition(*keys, *salt)
    if last:
        state = F.max(F.struct("_at", *values)).alias("r")
        portions = portions.groupBy(*keys, *salt, *last[0]).agg(state).select(*keys, *salt, *[F.col(f"r.{v}").alias(v) for v in values])
    else:
        portions = portions.select(*keys, *salt, *values)
    portions = portions.sortWithinPartitions(*keys, *salt)
    answer_columns = ["n", "rank_error", *map(_name, at)] if at is not None else []

    def padded(t: pa.Table, names: list[str]) -> pa.Table:
        for c in names:
            if c not in t.column_names:
                t = t.append_column(c, pa.nulls(t.num_rows, pa.int64()))
        return t

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = [*keys, "field", "node", "cnt", *answer_columns]
        for t in _whole_groups(batches, [*keys, *salt]):
            number, groups = _numbered(t, [*keys, *salt])
            single = groups["salts"].to_numpy() == 1 if salt else np.ones(groups.num_rows, bool)
            groups = groups.select(keys)
            for v in values:
                known = pc.is_valid(t[v]).to_numpy()
                g = number[known]
                node = (np.int64(1) << LEVELS) + cells_of(t[v].filter(pa.array(known)).to_numpy())
                size = np.bincount(g, minlength=groups.num_rows)
                g, node, count, lost = compress(g, node, np.ones(len(node), np.int64), np.floor(np.where(single & (at is not None), 2 * budget, budget) * size).astype(np.int64))
                named = groups.append_column("field", pa.array([v] * groups.num_rows))
                if at is not None:
                    ready = single & (size > 0)
                    answers = _answers(named, g, node, count, lost, at).filter(pa.array(ready))
                    yield from padded(answers, order).select(order).to_batches(max_chunksize=50_000)
                    stay = ~ready[g]
                    g, node, count, lost = g[stay], node[stay], count[stay], np.where(ready, 0, lost)
                yield from padded(_tree_rows(named, g, node, count, lost), order).select(order).to_batches(max_chunksize=50_000)

    types = f"{_types(rows, keys)}, field string, node bigint, cnt bigint" + (", " + _answer_types(at) if at is not None else "")
    return portions.mapInArrow(work, types)


def merge(trees: DataFrame, keys: list[str], budget: float = EPSILON / 2, at: Sequence[float] | None = None) -> DataFrame:
    """Trees merged to the groups of ``keys``: again trees, or with ``at`` (keys, n, rank_error, p.. per percentile).

    Equal nodes are added first, with a partial sum before the shuffle, so what reaches the task of a group is bounded by
    the size of its trees and not by the number of rows, and a hot group is as small as any other.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, keys):
            number, groups = _numbered(t, keys)
            node, count = t["node"].to_numpy(), t["cnt"].to_numpy()
            real = node > 0
            slack = np.bincount(number[~real], weights=count[~real], minlength=groups.num_rows).astype(np.int64)
            g, node, count = number[real], node[real], count[real]
            size = np.bincount(g, weights=count, minlength=groups.num_rows)
            g, node, count, lost = compress(g, node, count, np.floor(budget * size).astype(np.int64))
            out = _tree_rows(groups, g, node, count, slack + lost) if at is None else _answers(groups, g, node, count, slack + lost, at)
            yield from out.to_batches(max_chunksize=50_000)

    rows = trees.groupBy(*keys, "node").agg(F.sum("cnt").alias("cnt")).repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(work, f"{_types(trees, keys)}, " + ("node bigint, cnt bigint" if at is None else _answer_types(at)))


def percentiles(df: DataFrame, keys: list[str], values: list[str], at: Sequence[float] = PERCENTILES, epsilon: float = EPSILON, last: tuple[list[str], str] | None = None, portion: int = PORTION_ROWS) -> DataFrame:
    """(keys, field, n, rank_error, p..) with ``rank_error`` at most ``epsilon * n``."""
    first = cut(digest(df, keys, values, epsilon / 2, portion, at, last))
    names = [*keys, "field", "n", "rank_error", *map(_name, at)]
    rest = merge(first.where("node is not null"), [*keys, "field"], epsilon / 2, at)
    return first.where("n is not null").select(*names).unionByName(rest.select(*names))


def catalog_values(entries: DataFrame) -> DataFrame:
    """(snap_id, root, ext, h1, h2, seen_ts, size, mod) of the rows of a catalog; paths travel as 128-bit hashes.

    Both values of a folder are NULL, so that a path whose latest row is a folder has none. A value that is NULL, and a size
    or date of 0 where the date is missing, could not be read and is NULL.
    """
    is_file = ~F.coalesce("is_dir", F.lit(False))
    size, mod = F.coalesce("size", F.lit(0)), F.coalesce("mod", F.lit(0))
    return entries.where("path is not null").select(
        "snap_id", "root", extension_of(F.col("path")).alias("ext"), F.xxhash64("path").alias("h1"), F.xxhash64(F.lit(1), "path").alias("h2"), "seen_ts",
        F.when(is_file & ((size != 0) | (mod != 0)), size).alias("size"), F.when(is_file & (mod != 0), mod).alias("mod"),
    )


GROUP = ["snap_id", "root", "ext"]
VALUES = ["size", "mod"]
LATEST = (["h1", "h2"], "seen_ts")


def p2_percentiles(spark, sf_dir):
    return percentiles(catalog_values(table(spark, sf_dir, "entries")), GROUP, VALUES, last=LATEST)


def p2_rollup(spark, sf_dir):
    """Percentiles of every root over all snapshots and extensions, from the trees of the fine groups alone."""
    fine = digest(catalog_values(table(spark, sf_dir, "entries")), GROUP, VALUES, EPSILON / 2, last=LATEST)
    return merge(fine, ["root", "field"], EPSILON / 2, at=PERCENTILES)


def p2_digest(spark, sf_dir):
    """Counts held by the trees of every snapshot and root, built and merged in two steps."""
    fine = digest(catalog_values(table(spark, sf_dir, "entries")), GROUP, VALUES, EPSILON / 2, last=LATEST)
    trees = merge(fine, ["snap_id", "root", "field"], EPSILON / 2)
    return trees.groupBy("snap_id", "root", "field").agg(F.sum(F.when(F.col("node") > 0, F.col("cnt"))).alias("n"))


def true_ranks(values: DataFrame, answers: DataFrame, keys: list[str], at: Sequence[float] = PERCENTILES) -> DataFrame:
    """(keys, n, within): True if every percentile of a group has its true rank within the reported ``rank_error``, and that within epsilon.

    ``values`` has (keys, value). The exact ranks of an answer are all from (values below it) + 1 to (values not above it).
    """
    match = [values[k].eqNullSafe(F.col(f"_{k}")) for k in keys]
    side = answers.select(*[F.col(k).alias(f"_{k}") for k in keys], "n", "rank_error", *map(_name, at))
    counted = values.join(side, match).groupBy(*[f"_{k}" for k in keys], "n", "rank_error")
    counts = counted.agg(F.count("*").alias("_n"), *[F.sum((F.col("value") < F.col(_name(q))).cast("bigint")).alias(f"_l{i}") for i, q in enumerate(at)], *[F.sum((F.col("value") <= F.col(_name(q))).cast("bigint")).alias(f"_u{i}") for i, q in enumerate(at)])
    ok = (F.col("_n") == F.col("n")) & (F.col("rank_error") <= F.floor(F.lit(EPSILON) * F.col("n")))
    for i, q in enumerate(at):
        rank = F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n")))
        ok = ok & (F.col(f"_l{i}") + 1 - rank <= F.col("rank_error")) & (rank - F.col(f"_u{i}") <= F.col("rank_error"))
    return counts.select(*[F.col(f"_{k}").alias(k) for k in keys], "n", ok.alias("within"))


def exact_values(entries: DataFrame) -> DataFrame:
    """(snap_id, root, ext, field, value) of the latest row of each file, without sketches."""
    rows = catalog_values(entries).groupBy(*GROUP, "h1", "h2").agg(F.max(F.struct("seen_ts", *VALUES)).alias("r"))
    return rows.select(*GROUP, F.inline(F.array(*[F.struct(F.lit(v).alias("field"), F.col(f"r.{v}").alias("value")) for v in VALUES]))).where("value is not null")


def p2_bounds(spark, sf_dir):
    return true_ranks(exact_values(table(spark, sf_dir, "entries")), p2_percentiles(spark, sf_dir), [*GROUP, "field"])


def p2_rollup_bounds(spark, sf_dir):
    return true_ranks(exact_values(table(spark, sf_dir, "entries")).drop("snap_id", "ext"), p2_rollup(spark, sf_dir), ["root", "field"])


def p2_exact(spark, sf_dir):
    """The percentiles of the groups too small for any rank error."""
    return p2_percentiles(spark, sf_dir).where(F.col("n") * EPSILON < 1).drop("rank_error")


_EXT = "lower(regexp_extract(regexp_extract(path, '[^\\\\/]+$'), '^.+\\.([^.]+)$', 1))"
_VALUES_SQL = f"""with l as (select snap_id, path, arg_max({{'root': root, 'size': coalesce(size, 0), 'mod': coalesce(mod, 0), 'is_dir': coalesce(is_dir, false)}}, seen_ts) as r from entries where path is not null group by all),
v as (select snap_id, r.root as root, {_EXT} as ext, 'size' as field, case when r.size <> 0 or r.mod <> 0 then r.size end as value from l where not r.is_dir
union all select snap_id, r.root, {_EXT}, 'mod', case when r.mod <> 0 then r.mod end from l where not r.is_dir)
"""
_AT = ", ".join(f"list_sort(list(value))[greatest(1, cast(ceil({q}::double * count(*)) as bigint))] as {_name(q)}" for q in PERCENTILES)

QUERIES = {f.__name__: f for f in (p2_percentiles, p2_rollup, p2_digest, p2_bounds, p2_rollup_bounds, p2_exact)}
ORACLE = {
    "p2_digest": _VALUES_SQL + "select snap_id, root, field, count(*) as n from v where value is not null group by all",
    "p2_bounds": _VALUES_SQL + "select snap_id, root, ext, field, count(*) as n, true as within from v where value is not null group by all",
    "p2_rollup_bounds": _VALUES_SQL + "select root, field, count(*) as n, true as within from v where value is not null group by all",
    "p2_exact": _VALUES_SQL + f"select snap_id, root, ext, field, count(*) as n, {_AT} from v where value is not null group by snap_id, root, ext, field having count(*) < 100",
}
