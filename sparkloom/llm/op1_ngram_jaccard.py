"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Each text is the set of its distinct 5-word shingles, as 64-bit hashes; two different shingles of the corpus are
taken for one with a probability of about 2**-64 a pair, else all is exact. A count sketch, sized by the corpus up
to 2**BITS counters and summed over all sets, says how common a shingle is; the order (rarity, hash) is the same
everywhere. Where two sets of sizes y <= x reach the threshold t, the first ``x - ceil(t x) + 1`` shingles of the
larger and the first ``y - ceil(2 t y / (1 + t)) + 1`` of the smaller (its *lead*) have one in common, so documents
are joined on these alone. A pair in the list of such a shingle must pass

* the length filter: the smaller set has t of the larger or more,
* the positional filter: what follows the shared shingle in both is enough for the overlap,
* the suffix filter: the parities of the sets' counts over 1024 classes of the hash, and the counts over 64 ranges
  of it, bound the sets' difference from below,

and is then verified once, on the whole sets. Exact copies are one class before the join.

No list and no group of near copies is written out as pairs. First each class meets its neighbours in its lists, by
size and by a hash, and the best of them, as far as the parities tell, give *groups*. All pairs of one group are
verified in cells: its sets are dealt to blocks of like size and bounded weight, a cell takes two blocks, counts their
common shingles as a product of matrices, and gives back for each set the number of its links and the least set that
links lead to. Then the lists that hold sets of
different groups are joined for the pairs between groups, and those pairs, few, are verified one by one. Every pair
that passes the filters thus lies in one cell or in the last join; groups only say which. Lists too long for a task
are cut, by a hash of the document, into a grid of parts for the join.

Cases: null and empty text has no shingles and links with nothing; under five words the whole sequence is
one shingle; rows with null ``doc_id`` take part and are never a component's id (null, where there is no
other); repeated rows are copies; texts of any length are read whole; extra columns are ignored, whatever their
names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, worker

#: The sketch has 2**BITS counters at most (as rarity classes, 32 MB) and moves in SEGMENTS parts.
BITS, SEGMENTS = 25, 64
#: Tasks that fill a sketch each, at most: what they send grows with them.
SKETCHES = 4096
#: A list is cut into SALTS where the sketch counts HOT or more documents for its shingle.
HOT, SALTS = 50_000, 64
#: Members of a list that one part of the last join takes, about.
PART = 2_000
#: Rows of a table that may be broadcast: at about 100 bytes each, 30 MB.
BROADCAST_ROWS = 300_000
#: Documents that a bitmap tells of (fixed by Spark: 4 KB).
BITMAP = 1 << 15
#: A cell's block: sets, or a 64th of its group up to the second number, and shingles, about.
SETS, MOST_SETS, WEIGHT = 256, 2048, 1 << 20
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Hashes(dict):
    """word -> 64-bit hash, bounded; long words, which seldom come again, aren't kept."""

    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 60_000:
                self.clear()
            self[word] = got
        return got


_HASHES = _Hashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """The text's set: distinct n-word shingles as sorted 64-bit hashes."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z alone change case, and white space is the six ASCII characters
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if len(w) < n:
        h = (w * _MULTIPLIERS[np.arange(len(w)) % 5]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(w))
    else:
        m = len(w) - n + 1
        h = w[:m] * _MULTIPLIERS[0]
        for k in range(1, n):
            h = h + w[k : k + m] * (_MULTIPLIERS[k % 5] + np.uint64(2 * (k // 5)))
    return np.unique(_mix(h))


def pack(h: np.ndarray) -> bytes:
    """Byte planes, highest last: those of sorted hashes that hardly change stand together and compress."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def overlap_needed(a, b, percent: int):
    """The least intersection of sets of sizes a and b with 100 * |x & y| >= percent * |x | y|."""
    return -(-percent * (a + b) // (100 + percent))


def sets_table(docs: DataFrame, n: int) -> DataFrame:
    """_rid, doc_id, key, n, copy (128-bit digest of the set, null for the empty one), counts (64 ranges), parity
    (1024 bits) and the set itself; the last three for the first row of each digest in its task only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.starts("op1", _HASHES.clear)
        rid, seen = TaskContext.get().partitionId() << 36, set()
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                size, copy, counts, parity, data = [], [], [], [], []
                for t in b.column(1):
                    h = shingles(t.as_py(), n)
                    digest = xxhash.xxh3_128_digest(h) if len(h) else None
                    first = len(h) > 0 and digest not in seen
                    size.append(len(h))
                    copy.append(digest)
                    if first:
                        seen.add(digest)
                        counts.append(np.minimum(np.bincount((h >> np.uint64(58)).astype(np.int64), minlength=64), 255).astype(np.uint8).tobytes())
                        odd = np.bincount(((h >> np.uint64(20)) & np.uint64(1023)).astype(np.int64), minlength=1024) & 1
                        parity.append(np.packbits(odd.astype(np.uint8)).view("<i8").tolist())
                        data.append(pack(h))
                    else:
                        counts.append(None)
                        parity.append(None)
                        data.append(None)
                rids = pa.array(range(rid, rid + len(size)), pa.int64())
                rid += len(size)
                yield pa.RecordBatch.from_arrays([rids, b.column(0), b.column(2), pa.array(size, pa.int64()), pa.array(copy, pa.binary()), pa.array(counts, pa.binary()), pa.array(parity, pa.list_(pa.int64())), pa.array(data, pa.binary())], names=["_rid", "doc_id", "key", "n", "copy", "counts", "parity", "data"])

    return scratch.table(docs.mapInArrow(run, "_rid long, doc_id long, key string, n long, copy binary, counts binary, parity array<long>, data binary"), "jaccard-sets", batch=256)


def rarity(sets: DataFrame) -> tuple[int, bytes]:
    """The sketch's bits and the class of each counter: 0 for the rarest shingles, growing with the logarithm of
    the count, 255 where it is HOT above the mean. Collected as one byte a counter, 2**BITS at most."""
    held = sets.filter("data IS NOT NULL")
    total = held.agg(F.sum("n")).head()[0] or 0
    bits = min(BITS, max(18, math.ceil(math.log2(total / 64 + 1))))
    shift, width, mean = np.uint64(64 - bits), (1 << bits) // SEGMENTS, max(1.0, total / (1 << bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.starts("op1", _HASHES.clear)
        sums = np.zeros(1 << bits, np.uint32)  # a task has fewer than 2**32 shingles of a kind
        for b in batches:
            for data in b.column(0).to_pylist():
                np.add.at(sums, (unpack(data) >> shift).astype(np.int64), np.uint32(1))
        press = zstandard.ZstdCompressor(level=1)
        least = "<u2" if sums.max() < 1 << 16 else "<u4"
        for k, p in enumerate(sums.reshape(SEGMENTS, -1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([press.compress(p.astype(least).tobytes())], pa.binary())], names=["segment", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = zstandard.ZstdDecompressor().decompress(data)
                part = np.frombuffer(raw, "<u2" if len(raw) == 2 * width else "<u4").astype(np.int64)
                sums[s] = sums[s] + part if s in sums else part
        for s, x in sums.items():
            classes = np.clip(np.round(8 * np.log2((x + 1) / mean)) + 32, 0, 254).astype(np.uint8)
            classes[x >= mean + HOT] = 255
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(classes.tobytes())], pa.binary())], names=["segment", "counts"])

    kind = "segment int, counts binary"
    with scratch.batches(sets.sparkSession, 256):
        rows = held.select("data").coalesce(SKETCHES).mapInArrow(count, kind).repartition(SEGMENTS, "segment").mapInArrow(add, kind).collect()  # SEGMENTS rows, a byte a counter
    parts = {r.segment: zstandard.ZstdDecompressor().decompress(r.counts) for r in rows}
    return bits, b"".join(parts.get(s, bytes(width)) for s in range(SEGMENTS))


def prefixes(sets: DataFrame, sketch, percent: int) -> DataFrame:
    """g, _rid, n, pos, hot for the prefix of each set, rarest first. ``sketch``: the broadcast of ``rarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, classes = sketch.value
        rare, shift = np.frombuffer(classes, np.uint8), np.uint64(64 - bits)
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                gs, hots, many = [], [], []
                for data in b.column(2).to_pylist():
                    h = unpack(data)
                    c = rare[h >> shift]
                    p = len(h) - -(-percent * len(h) // 100) + 1
                    first = np.argsort(c, kind="stable")[:p]  # equal classes stay in the order of the hash
                    gs.append(h[first])
                    hots.append(c[first] == 255)
                    many.append(p)
                if not many:
                    continue
                many = np.array(many)
                pos = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                cols = [np.concatenate(gs).view(np.int64), np.repeat(b.column(0).to_numpy(), many), np.repeat(b.column(1).to_numpy(), many), pos, np.concatenate(hots)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["g", "_rid", "n", "pos", "hot"])

    return sets.filter("data IS NOT NULL").select("_rid", "n", "data").mapInArrow(run, "g long, _rid long, n long, pos long, hot boolean")


def _lead(percent: int) -> Column:
    """Whether a place of the prefix is one of a smaller set's."""
    return F.col("pos") <= F.col("n") - F.ceil(F.lit(2.0 * percent) * F.col("n") / F.lit(100.0 + percent) - F.lit(1e-9))


def _reach(percent: int) -> Column:
    """The size of the largest set of which the positional filter lets this row be the smaller partner; at least n on the lead."""
    return F.floor((F.col("n") - F.col("pos")) * F.lit(100 + percent) / F.lit(percent)).cast("long") - F.col("n")


def _need(percent: int) -> Column:
    return F.ceil((F.lit(percent) * (F.col("n") + F.col("n2"))) / F.lit(100.0 + percent) - F.lit(1e-9))


def _passes(percent: int) -> Column:
    """Length and positional filter of a joined pair (n, pos) and (n2, pos2)."""
    length = F.lit(100) * F.least("n", "n2") >= F.lit(percent) * F.greatest("n", "n2")
    return length & (F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) >= _need(percent))


def _odd_bits() -> Column:
    return sum((F.bit_count(F.get("parity", k).bitwiseXOR(F.get("parity2", k))) for k in range(16)), F.lit(0))


def _parity_passes(percent: int) -> Column:
    """Each hash that only one of two sets has changes one of 1024 parity bits, so the bits that differ are no
    more than the difference of the sets; a suffix filter that the join itself can apply."""
    return _odd_bits() <= F.col("n") + F.col("n2") - 2 * _need(percent)


def _looks_near(percent: int) -> Column:
    """Whether the difference that the parities suggest is about small enough, or they can't tell. It only says
    which pairs are looked at in groups."""
    share = F.lit(1.0) - _odd_bits() / F.lit(512.0)
    apart = F.when(share > 0, F.log(share) / F.lit(math.log(1 - 2 / 1024)))
    may = F.col("n") + F.col("n2") - 2 * _need(percent)
    return _parity_passes(percent) & ((may > 700) | (apart <= F.lit(1.1) * may))


def _paired(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of prefixes in whose list another row may pass the length and positional filter with them: by size, one before
    reaches them or they reach the next. Long lists stay whole. What is derived of a row comes after the exchange."""
    dealt = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("_rid"), F.lit(SALTS))).otherwise(0)).repartition("g", "salt").withColumn("reach", _reach(percent))
    w = Window.partitionBy("g", "salt").orderBy("n", "_rid")
    seen = dealt.withColumns({"earlier": F.max("reach").over(w.rowsBetween(Window.unboundedPreceding, -1)), "later": F.lead("n").over(w)})
    return seen.filter(F.col("hot") | (F.col("earlier") >= F.col("n")) | (F.col("reach") >= F.col("later"))).select(*rows.columns)


#: Partners by which a class may come into a group.
PARTNERS = 3


def _neighbours(lists: DataFrame) -> DataFrame:
    """Directed pairs (rep, rep2): each class with the one before it in its list by size and with the head of the list,
    and with the one before it where classes of like size are shuffled. One exchange serves both orders."""
    cut = lists.withColumns({"salt": F.when(F.col("hot"), F.pmod(F.xxhash64("rep"), F.lit(SALTS))).otherwise(0), "like": F.floor(F.log("n") * 20), "place": F.xxhash64("rep", F.lit(1))})
    by_size, by_hash = Window.partitionBy("g", "salt").orderBy("n", "rep"), Window.partitionBy("g", "salt", "like").orderBy("place", "rep")
    prev, head = F.lag("rep").over(by_size), F.first("rep").over(by_size.rowsBetween(Window.unboundedPreceding, 0))
    seen = cut.withColumns({"prev": prev, "head": head}).withColumn("beside", F.lag("rep").over(by_hash)).select("rep", F.concat(F.array_distinct(F.array("prev", "head")), F.array("beside")).alias("to"))
    # The heads of a long list's parts meet each other.
    parts = cut.filter("hot").withColumns({"lowest": prev.isNull(), "first_alike": F.lag("rep").over(by_hash).isNull()})
    heads = parts.filter("lowest").select("rep", F.array(F.lag("rep").over(Window.partitionBy("g").orderBy("n", "rep"))).alias("to"))
    alike = parts.filter("first_alike").select("rep", F.array(F.lag("rep").over(Window.partitionBy("g", "like").orderBy("place", "rep"))).alias("to"))
    return seen.union(heads).union(alike).select("rep", F.explode("to").alias("rep2")).filter("rep != rep2")


def _groups(lists: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """node, label: classes that are verified against each other, all with all. Any choice is right."""
    hits = _neighbours(lists).groupBy("rep", "rep2").agg(F.count("*").alias("hits"))
    best = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("hits"), "rep2"))
    pairs = hits.withColumn("k", best).filter(F.col("k") <= PARTNERS).select(F.greatest("rep", "rep2").alias("rep"), F.least("rep", "rep2").alias("rep2")).distinct()
    own = sizes.select("rep", "n", "parity")
    pairs = pairs.join(own, "rep").join(own.toDF("rep2", "n2", "parity2"), "rep2")
    near = (F.lit(100) * F.least("n", "n2") >= F.lit(percent) * F.greatest("n", "n2")) & _looks_near(percent)
    return components(pairs.filter(near).select(F.col("rep").alias("a"), F.col("rep2").alias("b")))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _sets_of(sets: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """_rid and data of the wanted sets (column rep). Beyond what is broadcast as rows the sets are told by bitmaps, a bit a document, so
    those that nobody wants are never shuffled."""
    held = sets.filter("data IS NOT NULL").select("_rid", "data")
    wanted = wanted.select(F.col("rep").alias("_rid"))
    if rows <= BROADCAST_ROWS:
        return held.join(F.broadcast(wanted), "_rid", "left_semi")
    bit = F.col("_rid").bitwiseAND(F.lit(BITMAP - 1))
    bits = wanted.groupBy(F.shiftright("_rid", 15).alias("_map")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    bits = scratch.table(bits, "jaccard-bits")
    told = held.withColumn("_map", F.shiftright("_rid", 15)).join(_small(bits, 41 * bits.count()), "_map")  # 4 KB a row
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return told.filter(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1).select("_rid", "data")


def _joined_to(rows: DataFrame, each: DataFrame, key: str) -> DataFrame:
    """Rows with what was aggregated by their key. As a table, that side is broadcast where it is small; else both sides are
    plain shuffles, of which Spark splits a partition that one key fills."""
    each = scratch.table(each, "jaccard-each")
    return rows.join(_small(each, each.count()), key)


def _shared(sets: list[np.ndarray], first: int) -> np.ndarray:
    """Sizes of the intersections of the first sets with the others, or of all with all where there are no others."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    place = np.cumsum(np.concatenate([[True], values[1:] != values[:-1]])) - 1
    twice = np.bincount(place) > 1
    keep = twice[place]
    place, owner = (np.cumsum(twice) - 1)[place[keep]], owner[keep]
    other = first if first < len(sets) else 0
    out = np.zeros((first, len(sets) - other))
    columns = int(twice.sum())
    for lo in range(0, columns, 2048):  # exact: sums of at most 2048 ones
        a, z = np.searchsorted(place, (lo, lo + 2048))
        x = np.zeros((len(sets), min(2048, columns - lo)), np.float32)
        x[owner[a:z], place[a:z] - lo] = 1
        out += x[:first] @ x[other:].T
    return out


def _links_of(a: list[tuple], b: list[tuple], percent: int) -> list[tuple[int, int, int]]:
    """rep, copies of the sets that it links to, least rep that links lead to; for each linked set of a cell. Rows: rep, n, copies, data."""
    rows = [*a, *b]
    sets = [unpack(r[3]) for r in rows]
    n, copies, reps = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 0))
    m, other = len(a), len(a) if b else 0
    both = _shared(sets, m)
    link = 100 * both >= percent * (n[:m, None] + n[None, other:] - both)
    if not b:
        np.fill_diagonal(link, False)
        others = link @ copies
    else:
        others = np.concatenate([link @ copies[m:], copies[:m] @ link])
    root, top = reps.copy(), np.iinfo(np.int64).max
    while True:
        there = np.minimum(root[:m], np.where(link, root[None, other:], top).min(1, initial=top))
        new = np.concatenate([there, np.minimum(root[m:], np.where(link, there[:, None], top).min(0, initial=top))]) if b else there
        if (new == root).all():
            break
        root = new
    return [(int(reps[k]), int(others[k]), int(root[k])) for k in np.flatnonzero(others)]


def _cells(groups: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """rep, label, n, copies and the cells that the set goes to, with the side it stands on."""
    step = math.log(100 / percent) * 1.0001 if percent < 100 else 1e-9  # sets of classes two steps apart fail the length filter
    members = groups.select(F.col("node").alias("rep"), "label").union(groups.select("label", "label").distinct())
    members = scratch.table(members.join(classes.select("rep", "n", "copies"), "rep").withColumn("c", F.floor(F.log("n") / F.lit(step))), "jaccard-members")
    sized = members.groupBy("label", "c").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    sets_of = F.least(F.lit(float(MOST_SETS)), F.greatest(F.lit(float(SETS)), F.col("m") / 64.0))
    blocks = F.ceil(F.greatest(F.col("m") / sets_of, F.col("w") / F.lit(float(WEIGHT))))
    whole = sized.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("c", blocks))).alias("blocks"), F.sum("m").alias("m"), F.sum("w").alias("w"))
    placed = _joined_to(members, whole, "label").withColumn("own", F.col("blocks")[F.col("c")])
    block, number = F.pmod(F.xxhash64("rep"), "own"), F.lit(0).cast("long")

    def cell(c, i, c2, j, side):
        return F.struct(c.alias("c1"), i.alias("b1"), c2.alias("c2"), j.alias("b2"), side.alias("side"))

    def beside(step: int, build) -> Column:
        there = F.try_element_at("blocks", F.col("c") + step)
        return F.when(there.isNotNull(), F.transform(F.sequence(number, there - 1), build)).otherwise(F.array().cast("array<struct<c1:bigint,b1:bigint,c2:bigint,b2:bigint,side:int>>"))

    c, zero, one = F.col("c"), F.lit(0), F.lit(1)
    inside = F.transform(F.sequence(number, F.col("own") - 1), lambda j: cell(c, F.least(block, j), c, F.greatest(block, j), F.when(j < block, one).otherwise(zero)))
    after, before = beside(1, lambda j: cell(c, block, c + 1, j, zero)), beside(-1, lambda j: cell(c - 1, j, c, block, one))
    alone = (F.col("m") <= SETS) & (F.col("w") <= WEIGHT)
    cells = F.when(alone, F.array(cell(number, number, number, number, zero))).otherwise(F.concat(inside, after, before))
    return scratch.table(placed.select("rep", "label", "n", "copies", cells.alias("cells")), "jaccard-cells")


def _linked(groups: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, every: bool) -> DataFrame:
    """rep, others, root of every cell: see ``_links_of``. Where the components alone are wanted, each block first meets itself
    and the first block of its size, which leaves few groups in parts; only those go through their other cells."""
    placed = _cells(groups, classes, percent)
    if every:
        return _verified(placed, sets, percent)
    hub = lambda x: ((x["c1"] == x["c2"]) & ((x["b1"] == x["b2"]) | (x["b1"] == 0))) | ((x["c1"] != x["c2"]) & (x["b1"] == 0) & (x["b2"] == 0))
    first, cut = _verified(placed.withColumn("cells", F.filter("cells", hub)), sets, percent), placed.filter(F.size("cells") > 1)
    if not cut.head(1):
        return first
    found = components(first.filter("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b"))).toDF("rep", "found")
    parts = cut.select("rep", "label").join(_small(found, found.count()), "rep", "left").withColumn("found", F.coalesce("found", "rep"))
    parts = parts.groupBy("label").agg(F.min("found").alias("lo"), F.max("found").alias("hi")).filter("lo != hi").select("label")
    rest = _joined_to(cut, parts, "label").withColumn("cells", F.filter("cells", lambda x: ~hub(x)))
    return first.union(_verified(rest.select(*placed.columns), sets, percent))


def _verified(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    entries = placed.agg(F.sum(F.size("cells") + 1)).head()[0] or 0
    held = sets.filter("data IS NOT NULL").select("_rid", "data") if entries <= BROADCAST_ROWS else _sets_of(sets, placed, entries)
    rows = held.withColumnRenamed("_rid", "rep").join(_small(placed, entries), "rep")
    rows = rows.select("label", F.explode("cells").alias("at"), "rep", "n", "copies", "data").select("label", "at.*", "rep", "n", "copies", "data")
    key = ["label", "c1", "b1", "c2", "b2"]
    dealt = rows.repartition(*key).sortWithinPartitions(*key, "side", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [])
        for whole in batches:
            out = []
            for *own, side, rep, n, copies, data in zip(*(whole.column(k).to_pylist() for k in range(10)), strict=True):
                if own != at:
                    if len(held[0]) + len(held[1]) > 1:
                        out += _links_of(*held, percent)
                    at, held = own, ([], [])
                held[side].append((rep, n, copies, data))
            if out:
                yield _rows(out)
        if len(held[0]) + len(held[1]) > 1 and (out := _links_of(*held, percent)):
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["rep", "others", "root"])

    return scratch.table(dealt.mapInArrow(run, "rep long, others long, root long"), "jaccard-linked", batch=64)


def _between(lists: DataFrame, groups: DataFrame, n_groups: int, sizes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) between groups that pass all filters but the counts by range."""
    tagged = lists.join(_small(groups.withColumnRenamed("node", "rep"), n_groups), "rep", "left").select("g", "hot", "rep", "n", "pos", F.coalesce("label", "rep").alias("label"))
    mixed = {"lo": F.min("label"), "hi": F.max("label"), "m": F.count("*"), "some": F.max(_lead(percent))}
    parts = F.ceil(F.col("m") / F.lit(float(PART))).alias("parts")
    row = [F.col(c) for c in ("g", "rep", "n", "pos", "label")]
    # What a list holds goes to its rows within the one exchange; long lists, which one task should not take, by a join.
    whole = Window.partitionBy("g")
    short = tagged.filter(~F.col("hot")).withColumns({c: x.over(whole) for c, x in mixed.items()}).filter("lo != hi AND some").select(*row, parts)
    long = tagged.filter("hot")
    each = long.groupBy("g").agg(*(x.alias(c) for c, x in mixed.items())).filter("lo != hi AND some").select("g", parts)
    tagged = scratch.table(short.union(_joined_to(long, each, "g").select(*row, "parts")), "jaccard-mixed")
    tagged = tagged.join(sizes.select("rep", "parity"), "rep")
    own, number = F.pmod(F.xxhash64("rep"), "parts"), F.lit(0).cast("long")
    probe = tagged.withColumns({"i": own, "j": F.explode(F.sequence(number, F.col("parts") - 1))}).drop("parts")
    index = tagged.filter(_lead(percent)).withColumns({"j": own, "i": F.explode(F.sequence(number, F.col("parts") - 1))})
    index = index.select("g", "i", "j", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("label").alias("label2"), F.col("parity").alias("parity2"))
    on = [probe[c] == index[c] for c in ("g", "i", "j")]
    before = (F.col("n2") < F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("rep2") < F.col("rep")))
    pairs = probe.join(index, on[0] & on[1] & on[2] & before & (F.col("label") != F.col("label2")) & _passes(percent) & _parity_passes(percent))
    return pairs.select(F.greatest("rep", "rep2").alias("a"), F.least("rep", "rep2").alias("b")).distinct()


def _suffix_filter(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs that the counts by range don't rule out; sizes has rep, n, counts."""
    a, b = (sizes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("counts").alias(f"c_{x}")) for x in "ab")
    rows = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "c_a", "c_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            if p.num_rows:
                x, y = (np.frombuffer(b"".join(p.column(c).to_pylist()), np.uint8).reshape(-1, 64).astype(np.int32) for c in (4, 5))
                na, nb = (p.column(c).to_numpy() for c in (2, 3))
                ok = np.abs(x - y).sum(1) <= na + nb - 2 * overlap_needed(na, nb, percent)
                yield p.select(["a", "b"]).filter(pa.array(ok))

    return rows.mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets reach the threshold. ``pairs`` is a table."""
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    data = scratch.table(_sets_of(sets, wanted, 2 * pairs.count()), "jaccard-wanted", codec="none")
    rows = pairs.join(data.select(F.col("_rid").alias("b"), F.col("data").alias("y")), "b").join(data.select(F.col("_rid").alias("a"), F.col("data").alias("x")), "a").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                p = whole.slice(k, 256)
                ok = []
                for x, y in zip(p.column(2).to_pylist(), p.column(3).to_pylist(), strict=True):
                    shared = len(np.intersect1d(unpack(x), unpack(y), assume_unique=True))
                    ok.append(800 * shared >= percent * (len(x) + len(y) - 8 * shared))
                yield p.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return scratch.table(rows.mapInArrow(run, "a long, b long"), "jaccard-links", batch=64)


#: Links that one task may label: as a dictionary, about 100 MB at most.
FOREST = 400_000


def _forest(edges: DataFrame) -> DataFrame:
    """node, label of a bounded number of links, by union-find in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while up.get(top, top) != top:
                top = up[top]
            while up.get(x, x) != top:
                up[x], x = top, up[x]
            return top

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                u, v = root(u), root(v)
                up[max(u, v)] = min(u, v)
        nodes = sorted(x for x in up if root(x) != x)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(root, nodes), pa.int64())], names=["node", "label"])

    return scratch.table(edges.coalesce(1).mapInArrow(run, "node long, label long"), "forest")


def components(edges: DataFrame, forest: int | None = None) -> DataFrame:
    """node, label (the least node of its component) of every node that isn't a label. Up to ``forest`` links are
    labelled in one task; more go through alternating large and small stars, each step a minimum per node, merged
    on the map side, and a join back on the node, whose long partitions Spark splits."""

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head())

    e = scratch.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "star")
    if e.count() <= (FOREST if forest is None else forest):
        return _forest(e)
    before = state(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least(both).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = least(large)
        small = large.join(low, "u")
        e = scratch.table(small.select("u", F.col("m").alias("v")).union(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "star")
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _joined(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, key: Column | None = None, every: bool = True) -> DataFrame:
    """_rid, doc_id, key, n, label (the least _rid of the component), component_id (its least doc_id) and n_links of every
    row: the other rows that reach the threshold, or with ``every`` false at least one of them, where there are any. The
    label is null for the empty set."""
    spark = docs.sparkSession
    key = F.lit(None).cast("string") if key is None else key
    sets = sets_table(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), key.alias("key")), n)
    classes = sets.filter("n > 0").groupBy("copy").agg(F.min("_rid").alias("rep"), F.first("n").alias("n"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    classes = scratch.table(classes, "jaccard-classes")
    moved = sets.filter("data IS NOT NULL").select("_rid", "copy").join(classes.select("copy", "rep"), "copy").filter("_rid != rep").select("_rid", "rep")
    moved = scratch.table(moved, "jaccard-moved")

    # Lists that hold a pair, by class: first within what the tasks gave, then with copies of other tasks put together.
    sketch = spark.sparkContext.broadcast(rarity(sets))  # 2**BITS bytes at most
    some = _paired(prefixes(sets, sketch, percent), percent)
    some = scratch.table(some, "jaccard-lists", batch=256)
    sketch.destroy()
    lists = some.join(_small(moved, moved.count()), "_rid", "left").select("g", F.coalesce("rep", "_rid").alias("rep"), "n", "pos", "hot")
    lists = scratch.table(lists.distinct(), "jaccard-lists")
    sizes = sets.filter("data IS NOT NULL").select(F.col("_rid").alias("rep"), "n", "counts", "parity")

    groups = _groups(lists, sizes, percent)
    linked = _linked(groups, classes, sets, percent, every)
    pairs = scratch.table(_between(lists, groups, groups.count(), sizes, percent), "jaccard-pairs")
    pairs = scratch.table(_suffix_filter(pairs, sizes, percent), "jaccard-pairs")
    links = _verify(pairs, sets, percent)

    labels = components(links.union(linked.filter("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b"))))
    labels = labels.select(F.col("node").alias("rep"), "label").union(labels.select("label", "label").distinct())
    both = links.select(F.col("a").alias("rep"), F.col("b").alias("to")).union(links.select("b", "a"))
    beyond = both.join(classes.select(F.col("rep").alias("to"), "copies"), "to").select("rep", F.col("copies").alias("others"))
    others = beyond.union(linked.select("rep", "others")).groupBy("rep").agg(F.sum("others").alias("others"))
    info = scratch.table(labels.join(classes.select("rep", "least"), "rep").join(others, "rep", "left"), "jaccard-info")
    info = _joined_to(info, info.groupBy("label").agg(F.min("least").alias("component_id")), "label")
    info = scratch.table(info.select("rep", "label", "component_id", "others"), "jaccard-info")
    ends = classes.join(_small(info, info.count()), "rep", "left").select("copy", F.coalesce("label", "rep").alias("label"), F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    placed = sets.select("_rid", "doc_id", "key", "n", "copy").join(ends, "copy", "left")
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return scratch.table(placed.select("_rid", "doc_id", "key", "n", "label", component.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "jaccard-placed")


def ngram_jaccard(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (other rows whose sets reach the threshold, copies included) of every row."""
    with scratch.passing(docs.sparkSession):
        placed = _joined(docs, n, percent, id_col, text_col)
    return placed.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with one of each component: the one with the smallest id, of repeated rows any one. Documents
    without words all stay."""
    key = F.md5(F.to_json(F.struct(F.col(id_col).alias("i"), F.col(text_col).alias("t"))))
    with scratch.passing(docs.sparkSession):
        placed = _joined(docs, n, percent, id_col, text_col, key, every=False).filter("n_links > 0")
        first = placed.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("key"))
        rows = placed.groupBy("key").agg(F.count("*").alias("rows")).join(first.select("key", F.lit(1).alias("stays")), "key", "left")
        touched = scratch.table(rows.filter("stays IS NULL OR rows > 1").select(F.col("key").alias("k"), F.coalesce("stays", F.lit(0)).alias("stays")), "jaccard-touched")
    seen = touched.agg(F.count("*"), F.sum("stays")).head()
    judged = docs.select(F.struct(*scratch.columns(docs)).alias("row"), key.alias("k")).join(_small(touched, seen[0]), "k", "left")  # two columns: no name can clash
    alone = judged.filter("stays IS NULL").select("row.*")
    return alone.unionByName(judged.filter("stays = 1").dropDuplicates(["k"]).select("row.*")) if seen[1] else alone


#: The join in DuckDB's SQL, over ``documents``: all pairs that share a shingle are counted, for small tables.
SQL = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT r, r AS to_r FROM t UNION SELECT c.r, e.b FROM c JOIN e ON e.a = c.to_r),
least_id AS (SELECT c.r, min(d.doc_id) AS component_id FROM c JOIN t d ON d.r = c.to_r GROUP BY c.r),
links AS (SELECT a AS r, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM t JOIN least_id USING (r) LEFT JOIN n USING (r) LEFT JOIN links USING (r)
"""
