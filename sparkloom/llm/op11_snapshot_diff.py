"""Difference of two snapshots with rekeying, over Merkle search trees of key ranges.

Each snapshot becomes a tree: rows in key order, cut wherever the low bits of a key's hash are zero, so that equal
stretches are cut alike in both snapshots whatever stands around them. Four bits cut leaves (16 rows in the mean), four
more each level above, up to the top level, whose cuts (at most about ``TOP``) deal the rows to tasks. A leaf holds its rows' keys, digests and short columns; a node, the hash of its children.

``diff`` descends both trees together, level by level: below a node that has the same keys and hash on both sides
nothing is compared by hash any more. Its leaves are then verified exactly, row for row, before they count as equal, so a
collision of hashes costs time, not rows. The rows of all other leaves are merged by key. Rows that stay without a
partner pair by content: of those alike in the ``content`` columns, the i-th smallest earlier key with the i-th largest
later one. Ranks are counted in parts of the key range and added up, so that no content, however common, is one task's.
Text columns take part as SHA-256 digests (whole texts), and only short rows are shuffled.

Defined cases: null equals only null; a null key is no key: the row takes part by content alone, before all other keys;
of rows that repeat a key, the i-th by value pairs with the i-th; an empty snapshot makes all rows inserts or deletes;
other columns of any name are ignored. Nothing that grows with the input reaches the driver or a broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, sql_parts

#: Most cuts of the top level (expected), bits that one level cuts by, parts of the key range in which contents are ranked.
TOP, BITS, PARTS = 4096, 4, 256
_FIRST = -(2**63)


def _value(df: DataFrame, c: str, wide: list[str]) -> Column:
    v = F.col(f"`{c}`")
    return (F.unhex(F.sha2(v.cast("binary"), 256)) if c in wide else v).alias(f"v{c}")


def _short(df: DataFrame, key: str, columns: list[str], wide: list[str]) -> DataFrame:
    """k, v (the columns, wide ones as digests) and sha, the row's SHA-256."""
    whole = F.concat_ws("\n", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in columns))
    return df.select(F.col(f"`{key}`").cast("long").alias("k"), F.struct(*(_value(df, c, wide) for c in columns)).alias("v"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("sha"))


def _is_cut(bits: int) -> Column:
    return F.xxhash64("k").bitwiseAND(F.lit((1 << bits) - 1)) == 0


@dataclass
class Shape:
    """What both trees must share: the bits that each level cuts by, leaves first, and the cuts of the top level."""

    bits: list[int]
    cuts: list[int]


def shape(old: DataFrame, new: DataFrame, top: int = TOP) -> Shape:
    """Cuts come from the keys of both snapshots, so that ranges are even in both, wherever new keys lie."""
    rows = old.select("k").union(new.select("k")).filter("k IS NOT NULL")
    count = rows.count()
    most = max(BITS, math.ceil(math.log2(max(1, count / top))))
    while True:  # keys would have to be chosen by their hashes to make more
        found = rows.filter(_is_cut(most)).select("k").distinct().limit(4 * top + 1).collect()
        if len(found) <= 4 * top:
            break
        most += 1
    return Shape([*range(BITS, most, BITS), most], sorted(r.k for r in found))


def _path(s: Shape, level: int) -> list[str]:
    return ["r", *(f"s{b}" for b in reversed(s.bits[level:-1]))]


@dataclass
class Tree:
    """``leaves``: path, hash, rows; ``nodes``: path and hash of each level, leaves first; ``extra``: rows that repeat a
    key; ``keyless``: rows without one."""

    shape: Shape
    leaves: DataFrame
    nodes: list[DataFrame]
    extra: DataFrame
    keyless: DataFrame


def tree(rows: DataFrame, s: Shape) -> Tree:
    cuts = np.array(s.cuts, dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(dtype=np.int64), side="right"))

    dealt = rows.filter("k IS NOT NULL").withColumn("r", range_of("k"))
    dealt = dealt.withColumn("i", F.row_number().over(Window.partitionBy("r", "k").orderBy("v")))
    so_far = Window.partitionBy("r").orderBy("k", "i").rowsBetween(Window.unboundedPreceding, 0)
    for b in s.bits[:-1]:
        dealt = dealt.withColumn(f"s{b}", F.coalesce(F.last(F.when(_is_cut(b), F.col("k")), ignorenulls=True).over(so_far), F.lit(_FIRST)))
    dealt = scratch.table(dealt, "dealt")
    path = _path(s, 0)
    leaves = dealt.filter("i = 1").groupBy(*path).agg(F.array_sort(F.collect_list(F.struct("k", "v", "sha"))).alias("rows"))
    leaves = scratch.table(leaves.withColumn("hash", F.xxhash64(F.transform("rows", lambda x: F.struct(x.k, x.sha)))), "leaves")
    nodes = [leaves.select(*path, "hash")]
    for level in range(1, len(s.bits)):
        children = F.array_sort(F.collect_list(F.struct(F.col(path[-1]).alias("s"), "hash")))
        path = _path(s, level)
        nodes.append(nodes[-1].groupBy(*path).agg(F.xxhash64(children).alias("hash")))
    return Tree(s, leaves, nodes, dealt.filter("i > 1").select("k", "i", "r", "v", "sha"), rows.filter("k IS NULL"))


def _equal_leaves(a: Tree, b: Tree) -> DataFrame:
    """path, rows: leaves of both trees that are the same, row for row."""
    s, known, found = a.shape, None, []
    for level in reversed(range(len(s.bits))):
        left, right, path = a.nodes[level], b.nodes[level], _path(s, level)
        if known is not None:  # below equal nodes there is nothing to descend to
            above = _path(s, level + 1)
            left, right = left.join(known, above, "left_anti"), right.join(known, above, "left_anti")
        same = scratch.table(left.join(right, [*path, "hash"]).select(*path), f"same-{level}")
        found.append(a.leaves.join(same, path, "left_semi"))
        if level:
            known = same if known is None else same.unionByName(known.join(a.nodes[level], _path(s, level + 1)).select(*path))
    leaves = found[0]
    for more in found[1:]:
        leaves = leaves.unionByName(more)
    path = _path(s, 0)
    both = leaves.select(*path, "rows").join(b.leaves.select(*path, F.col("rows").alias("later")), path)
    return scratch.table(both.filter("rows = later").select(*path, "rows"), "equal")


def _rest(t: Tree, equal: DataFrame) -> DataFrame:
    """k, i, r, v, sha of the rows outside equal leaves."""
    path = _path(t.shape, 0)
    open_ = t.leaves.join(equal, path, "left_anti").select("r", F.explode("rows").alias("x")).select("x.k", F.lit(1).alias("i"), "r", "x.v", "x.sha")
    return open_.unionByName(t.extra)


def _ranked(rows: DataFrame, columns: list[str], content: list[str], descending: bool) -> DataFrame:
    """Rows without a partner with their rank among those alike in ``content``: counts of the parts before, and the rank in
    the row's own part."""
    same = [F.col(f"v.`v{c}`") for c in content]
    turn = (lambda c: F.col(c).desc_nulls_last()) if descending else (lambda c: F.col(c).asc_nulls_first())
    named = rows.select("*", *(x.alias(f"c{k}") for k, x in enumerate(same)))
    groups = [f"c{k}" for k in range(len(same))]
    before = Window.partitionBy(*groups).orderBy(turn("part")).rowsBetween(Window.unboundedPreceding, -1)
    counts = named.groupBy(*groups, "part").agg(F.count("*").alias("in_part")).withColumn("before", F.coalesce(F.sum("in_part").over(before), F.lit(0)))
    own = named.withColumn("own", F.row_number().over(Window.partitionBy(*groups, "part").orderBy(turn("k"), turn("i"), turn("v"))))
    known = counts.select(*(F.col(g).alias(f"_{g}") for g in groups), F.col("part").alias("_part"), "before")
    on = F.col("part") == F.col("_part")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return own.join(known, on).select(*groups, (F.col("before") + F.col("own")).alias("rank"), "k", "v", "sha")


def _changed(columns: list[str], a: str, b: str) -> Column:
    return F.concat_ws(",", *(F.when(~F.col(f"{a}.`v{c}`").eqNullSafe(F.col(f"{b}.`v{c}`")), F.lit(c)) for c in columns))


def snapshot_diff(earlier: DataFrame, later: DataFrame, key: str, columns: list[str], content: list[str], wide: list[str] | None = None, top: int = TOP) -> DataFrame:
    """Per pair or row without a partner: key (later, else earlier), old_key, op (same, update, rekey, insert, delete),
    changed (differing ``columns``, comma-joined) and row_sha256 (of the later row's columns, joined by line feeds, null as
    ``~``; null for delete). ``key`` is a whole number; ``wide``: text columns compared by their digests."""
    wide = columns[:1] if wide is None else wide
    old, new = (scratch.table(_short(df, key, columns, wide), "rows") for df in (earlier, later))
    s = shape(old, new, top)
    a, b = tree(old, s), tree(new, s)
    equal = _equal_leaves(a, b)
    left = _rest(a, equal).select("k", "i", *(F.col(c).alias(f"{c}0") for c in ("r", "v", "sha")))
    right = _rest(b, equal).select("k", "i", *(F.col(c).alias(f"{c}1") for c in ("r", "v", "sha")))
    merged = scratch.table(left.join(right, ["k", "i"], "full"), "merged")

    width = max(1, -(-(len(s.cuts) + 1) // PARTS))

    def single(side: int, t: Tree) -> DataFrame:
        keyed = merged.filter(f"sha{1 - side} IS NULL").select("k", "i", F.floor(F.col(f"r{side}") / width).alias("part"), F.col(f"v{side}").alias("v"), F.col(f"sha{side}").alias("sha"))
        spread = (-1 - F.pmod(F.xxhash64("v"), F.lit(PARTS))).alias("part")  # before all keys; equal rows in one part
        return keyed.unionByName(t.keyless.select("k", F.lit(0).alias("i"), spread, "v", "sha"))

    names = [f"c{k}" for k in range(len(content))]
    one, two = (_ranked(single(side, t), columns, content, bool(side)) for side, t in ((0, a), (1, b)))
    one = one.select(*(F.col(n).alias(f"e{n}") for n in names), F.col("rank").alias("e"), *(F.col(c).alias(f"{c}0") for c in ("k", "v", "sha")))
    two = two.select(*names, "rank", *(F.col(c).alias(f"{c}1") for c in ("k", "v", "sha")))
    alike = F.col("e") == F.col("rank")
    for n in names:
        alike = alike & F.col(f"e{n}").eqNullSafe(F.col(n))
    pairs = one.join(two, alike, "full")

    def out(df: DataFrame, key: Column, old_key: Column, op: Column, changed: Column, sha: Column) -> DataFrame:
        return df.select(key.alias("key"), old_key.alias("old_key"), op.alias("op"), changed.alias("changed"), F.lower(F.hex(sha)).alias("row_sha256"))

    differs, nothing = _changed(columns, "v0", "v1"), F.lit("")
    has0, has1 = F.col("sha0").isNotNull(), F.col("sha1").isNotNull()
    unchanged = equal.select(F.explode("rows").alias("x"))
    by_key = merged.filter(has0 & has1)
    return (
        out(unchanged, F.col("x.k"), F.col("x.k"), F.lit("same"), nothing, F.col("x.sha"))
        .unionByName(out(by_key, F.col("k"), F.col("k"), F.when(differs == "", "same").otherwise("update"), differs, F.col("sha1")))
        .unionByName(out(
            pairs, F.when(has1, F.col("k1")).otherwise(F.col("k0")), F.col("k0"), F.when(has0 & has1, "rekey").when(has1, "insert").otherwise("delete"),
            F.when(has0 & has1, differs).otherwise(nothing), F.col("sha1"),
        ))
    )


def later_snapshot(docs: DataFrame) -> DataFrame:
    """The later snapshot that the query compares with, by crc32 of the decimal doc_id modulo 25. A null id changes
    nothing."""
    m = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(25))
    key, moved = F.col("doc_id"), -1 - F.col("doc_id")
    keys = F.when(m == 5, F.array(key, moved)).when(m.isin(3, 4), F.array(moved)).otherwise(F.array(key))
    none = F.lit(None).cast("string")
    return docs.select("doc_id", "text", "lang", "source", m.alias("m")).filter("m IS NULL OR m <> 0").select(
        F.explode(keys).alias("doc_id"), F.when(F.col("m") == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(F.col("m") == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("m") == 2, F.col("lang")).when(F.col("m") == 4, none).otherwise(F.col("source")).alias("source"),
    )


SQL = f"""WITH b AS (SELECT doc_id AS k, text, lang, source, {sql_parts.crc32("CAST(doc_id AS VARCHAR)")} % 25 AS m FROM documents),
    z AS (SELECT CASE WHEN m IN (3, 4) THEN -1 - k ELSE k END AS k, CASE WHEN m = 1 THEN coalesce(text, '') || '+' ELSE text END AS text, CASE WHEN m = 2 THEN source ELSE lang END AS lang,
        CASE WHEN m = 2 THEN lang WHEN m = 4 THEN NULL ELSE source END AS source FROM b WHERE m IS DISTINCT FROM 0 UNION ALL SELECT -1 - k, text, lang, source FROM b WHERE m = 5),
    e AS (SELECT b.*, row_number() OVER (PARTITION BY text, lang ORDER BY k) AS i FROM b WHERE k IS NULL OR NOT EXISTS (SELECT 1 FROM z WHERE z.k = b.k)),
    l AS (SELECT z.*, row_number() OVER (PARTITION BY text, lang ORDER BY k DESC) AS i FROM z WHERE k IS NULL OR NOT EXISTS (SELECT 1 FROM b WHERE z.k = b.k)),
    p AS (SELECT b.k AS k0, z.k AS k1, b.text AS t0, z.text AS t1, b.lang AS l0, z.lang AS l1, b.source AS s0, z.source AS s1, 'update' AS op FROM b JOIN z ON b.k = z.k
        UNION ALL SELECT e.k, l.k, e.text, l.text, e.lang, l.lang, e.source, l.source, CASE WHEN e.i IS NULL THEN 'insert' WHEN l.i IS NULL THEN 'delete' ELSE 'rekey' END
        FROM e FULL JOIN l ON e.text IS NOT DISTINCT FROM l.text AND e.lang IS NOT DISTINCT FROM l.lang AND e.i = l.i),
    d AS (SELECT *, CASE WHEN op IN ('insert', 'delete') THEN '' ELSE concat_ws(',', CASE WHEN t0 IS DISTINCT FROM t1 THEN 'text' END, CASE WHEN l0 IS DISTINCT FROM l1 THEN 'lang' END,
        CASE WHEN s0 IS DISTINCT FROM s1 THEN 'source' END) END AS changed FROM p)
SELECT CASE WHEN op = 'delete' THEN k0 ELSE k1 END AS key, k0 AS old_key, CASE WHEN op = 'update' AND changed = '' THEN 'same' ELSE op END AS op, changed,
    CASE WHEN op <> 'delete' THEN sha256(coalesce(t1, '~') || chr(10) || coalesce(l1, '~') || chr(10) || coalesce(s1, '~')) END AS row_sha256 FROM d"""
