"""Differences between full snapshots by comparison of Merkle trees.

Keys are spread over ``2**leaf_bits`` hash ranges. Each snapshot gets one order-free digest per range, digests
of 64 neighbouring ranges roll up into their parent, and the trees of two consecutive snapshots are compared
from the root down. Only rows of leaf ranges whose digests differ are read again and compared one by one.

Defined results:
* several rows of a key in one snapshot: the one with the latest ``seen`` value counts (NULL is earliest), of those that tie the
  one with the greatest hash of its values, in the digests and in the comparison alike;
* NULL numeric values count as 0, a NULL boolean as false, rows with a NULL key or an unknown snapshot are left out;
* a snapshot with a NULL capture time is left out, snapshots captured at the same time are ordered by id;
* the first snapshot has no rows; an empty table or a single snapshot gives an empty result;
* columns other than those named are never read, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.runtime import broadcast_if_small, cut

FANOUT_BITS = 6
#: Keys of a leaf. Smaller leaves cost more digests and spare more rows: with a share c of changed keys, 1 - (1 - c)**LEAF_ROWS are read again.
LEAF_ROWS = 4
RESULT = "snap_id int, path string, change_kind string"


def snapshot_order(snapshots: DataFrame) -> list[int]:
    """Snapshot ids in the order they were captured: metadata of one row per delivery."""
    rows = snapshots.where("snap_id is not null and taken_ts is not null").groupBy("snap_id").agg(F.min("taken_ts").alias("t")).collect()
    return [r.snap_id for r in sorted(rows, key=lambda r: (r.t, r.snap_id))]


def _ordinal(order: list[int]) -> Column:
    return F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (int(s), i)])[F.col("snap_id").cast("int")]


def _rows(entries: DataFrame, order: list[int]) -> DataFrame:
    """The columns compared, with the capture order and the 64-bit range hash of the key. States order by time, then by hash."""
    size, mod, is_dir = F.coalesce("size", F.lit(0)), F.coalesce("mod", F.lit(0)), F.coalesce("is_dir", F.lit(False))
    state = F.struct(F.col("seen_ts").alias("seen"), F.xxhash64(size, mod, is_dir).alias("dig"), size.alias("size"), mod.alias("mod"), is_dir.alias("is_dir"))
    return entries.select(_ordinal(order).alias("ord"), "path", state.alias("state"), F.xxhash64("path").alias("h1")).where("ord is not null and path is not null")


def leaf_bits_for(rows: int, snapshots: int, leaf_rows: int = LEAF_ROWS) -> int:
    """Bits that give about ``leaf_rows`` keys a leaf; follows the size of the table."""
    return max(FANOUT_BITS, (max(1, rows // max(1, snapshots)) // leaf_rows).bit_length())


def leaf_digests(rows: DataFrame, leaf_bits: int) -> DataFrame:
    """(ord, leaf, d1, d2, n): two independent 64-bit digests and the key count of each hash range.

    Keys travel as 128-bit hashes, so this phase never shuffles paths; repeated rows of a key are combined
    before the shuffle, which also tames a single hot key.
    """
    one = rows.select(
        "ord",
        "h1",
        F.xxhash64(F.lit(1), "path").alias("h2"),
        F.struct("state.seen", "state.dig").alias("last"),
    )
    latest = one.groupBy("ord", "h1", "h2").agg(F.max("last").alias("last"))
    return latest.groupBy("ord", F.shiftrightunsigned("h1", 64 - leaf_bits).alias("leaf")).agg(
        F.bit_xor(F.xxhash64("h1", "h2", "last.dig")).alias("d1"),
        F.bit_xor(F.xxhash64(F.lit(2), "last.dig", "h2", "h1")).alias("d2"),
        F.count("*").alias("n"),
    )


def _parents(level: DataFrame) -> DataFrame:
    return level.groupBy("ord", F.shiftrightunsigned("leaf", FANOUT_BITS).alias("leaf")).agg(
        F.bit_xor(F.xxhash64("leaf", "d1", "n")).alias("d1"), F.bit_xor(F.xxhash64(F.lit(3), "leaf", "d2")).alias("d2"), F.sum("n").alias("n")
    )


def _differing(level: DataFrame, pairs: int, above: DataFrame | None = None) -> DataFrame:
    """(pair, leaf) of the nodes that differ between capture order pair-1 and pair; a missing node differs from any.

    With ``above`` only the children of those nodes are compared.
    """
    sides = level.select(F.explode(F.array(F.col("ord"), F.col("ord") + 1)).alias("pair"), "leaf", "ord", F.struct("d1", "d2", "n").alias("d")).where(F.col("pair").between(1, pairs))
    if above is not None:
        sides = sides.withColumn("top", F.shiftrightunsigned("leaf", FANOUT_BITS)).join(above.select("pair", F.col("leaf").alias("top")), ["pair", "top"], "left_semi")
    both = sides.groupBy("pair", "leaf").agg(
        F.max(F.when(F.col("ord") == F.col("pair"), F.col("d"))).alias("now"), F.max(F.when(F.col("ord") < F.col("pair"), F.col("d"))).alias("was")
    )
    return both.where(~F.col("now").eqNullSafe(F.col("was"))).select("pair", "leaf")


def differing_leaves(leaves: DataFrame, leaf_bits: int, pairs: int) -> DataFrame:
    """Walk the trees from the root: the children of equal nodes are never compared."""
    levels = [leaves]
    for _ in range((leaf_bits + FANOUT_BITS - 1) // FANOUT_BITS):
        levels.append(_parents(levels[-1]))
    found = _differing(levels.pop(), pairs)
    while levels:
        found = _differing(levels.pop(), pairs, found)
    return found


def snapshot_changes(entries: DataFrame, snapshots: DataFrame, leaf_bits: int | None = None) -> DataFrame:
    """(snap_id, path, change_kind): keys added, removed or changed between each snapshot and the one before it."""
    spark = entries.sparkSession
    order = snapshot_order(snapshots)
    if len(order) < 2:
        return spark.createDataFrame([], RESULT)
    bits = leaf_bits or leaf_bits_for(entries.count(), len(order))
    rows = _rows(entries, order)
    leaves = cut(leaf_digests(rows, bits))
    dirty = cut(differing_leaves(leaves, bits, len(order) - 1))
    # Each row is the later side of its own pair and the earlier side of the next one.
    sides = rows.select(
        F.explode(F.array(F.col("ord"), F.col("ord") + 1)).alias("pair"), F.shiftrightunsigned("h1", 64 - bits).alias("leaf"), "ord", "path", "state"
    ).join(broadcast_if_small(dirty, 24), ["pair", "leaf"], "left_semi")
    both = sides.groupBy("pair", "path").agg(
        F.max(F.when(F.col("ord") == F.col("pair"), F.col("state"))).alias("now"), F.max(F.when(F.col("ord") < F.col("pair"), F.col("state"))).alias("was")
    )
    same = (F.col("now.size") == F.col("was.size")) & (F.col("now.mod") == F.col("was.mod")) & (F.col("now.is_dir") == F.col("was.is_dir"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~same, "changed")
    ids = F.array(*[F.lit(int(s)) for s in order])
    return both.select(F.element_at(ids, F.col("pair") + 1).alias("snap_id"), "path", kind.alias("change_kind")).where("change_kind is not null")


def change_summary(changes: DataFrame) -> DataFrame:
    """(snap_id, change_kind, n): the size of each kind of change."""
    return changes.groupBy("snap_id", "change_kind").agg(F.count("*").alias("n"))
