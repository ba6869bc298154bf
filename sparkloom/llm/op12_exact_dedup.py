"""Exact deduplication over an extendible-hash index on shared files.

Texts are equal when identical after each run of white space became one space (null counts as empty). Scan tasks
bring the rows of one text together as far as ``CHUNK`` bytes of distinct texts go: an entry is a text with the ids of
its rows. Entries of more than one row are brought together once more by hash and a salt, so that even a text of a
third of all rows reaches its owner as few entries. An owner task processes one range of hashes (the leading bits):
an extendible-hash directory maps the following bits to buckets of ``CAPACITY`` hashes; an overfull bucket is split,
and the directory doubles where the bucket already uses all its bits. Equal hashes chain, and a text joins the group
of the chain whose bytes are the same, so a collision never merges texts.

The index stays in ``folder``: per range files of text frames, bucket pages and the directory. ``extend`` takes a
later batch: its owners read the buckets that the new hashes meet and rewrite only those that change. What is in
the index stays; of texts new to it, the row with the smallest id.

Defined cases: a null text is the empty text; null ids come after all others, and a group of null ids alone keeps
null; of several rows with the kept id exactly one has ``kept``; an empty table gives no rows; other columns of any
name are ignored. Texts of any length are hashed and compared whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import files, scratch, worker

SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of distinct texts and rows that a scan task holds before its entries go on.
CHUNK, ROWS = 32 << 20, 500_000
#: Parts in which entries of one hash are brought together first.
SALTS = 64
#: Hashes in a bucket; bytes of texts in a frame.
CAPACITY, FRAME = 256, 1 << 20
_RECORD = struct.Struct("<QIQIIqqB")  # hash, file, frame, start, length, kept id, rows, whether the kept id is known
_FOOTER = struct.Struct("<QII")  # address of the directory, its length, the skipped bits
_ALL = (1 << 64) - 1
_LATE = (1, 0)


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def _order(i: int | None) -> tuple[int, int]:
    return _LATE if i is None else (0, i)


class Bucket:
    def __init__(self, depth: int, chains: dict[int, list[list]] | None = None, place: tuple[int, int] | None = None):
        self.depth, self.chains, self.place, self.changed = depth, chains, place, place is None


class Index:
    """The extendible-hash index of one key range; ``name``: the file of its last version, if there is one."""

    def __init__(self, folder: str, skip: int, name: str | None = None):
        self.folder, self.skip, self.depth, self.names = folder, skip, 0, []
        self.slots, self._open, self._frame = [Bucket(0, {})], {}, (None, b"")
        if name:
            self._read_directory(name)

    def _source(self, name: str):
        if name not in self._open:
            store, path = files.shared(self.folder)
            self._open[name] = store.open_input_file(f"{path}/{name}")
        return self._open[name]

    def _read_directory(self, name: str) -> None:
        f = self._source(name)
        at, size, self.skip = _FOOTER.unpack(f.read_at(_FOOTER.size, f.size() - _FOOTER.size))
        plain = zstandard.decompress(f.read_at(size, at))
        count, self.depth = struct.unpack_from("<II", plain)
        names, _, slots = plain[8:].partition(b"\n")
        self.names = names.decode().split(",")
        assert count == len(slots) // 16
        known: dict[tuple, Bucket] = {}
        self.slots = []
        for file, depth, page in struct.iter_unpack("<IIQ", slots):
            self.slots.append(known.setdefault((file, page), Bucket(depth, None, (file, page))))

    def _slot(self, h: int) -> int:
        return ((h << self.skip) & _ALL) >> (64 - self.depth) if self.depth else 0

    def _bucket(self, h: int) -> Bucket:
        b = self.slots[self._slot(h)]
        if b.chains is None:
            file, page = b.place
            f = self._source(self.names[file])
            (size,) = struct.unpack("<I", f.read_at(4, page))
            b.chains = {}
            for r in _RECORD.iter_unpack(zstandard.decompress(f.read_at(size, page + 4))):
                b.chains.setdefault(r[0], []).append(list(r))
        return b

    def chain(self, h: int) -> list[list]:
        """The records of one hash; texts that differ stand one after the other."""
        return self._bucket(h).chains.get(h, [])

    def text(self, record: list) -> bytes:
        key = (record[1], record[2])
        if self._frame[0] != key:
            f = self._source(self.names[record[1]])
            (size,) = struct.unpack("<I", f.read_at(4, record[2]))
            self._frame = (key, zstandard.decompress(f.read_at(size, record[2] + 4)))
        return self._frame[1][record[3] : record[3] + record[4]]

    def touch(self, h: int) -> None:
        self._bucket(h).changed = True

    def add(self, record: list) -> None:
        b = self._bucket(record[0])
        b.chains.setdefault(record[0], []).append(record)
        b.changed = True
        while len(b.chains) > CAPACITY and b.depth < 64 - self.skip:
            b = self._split(b, record[0])

    def _split(self, b: Bucket, h: int) -> Bucket:
        """Two buckets by the next bit, and that of ``h``; the directory doubles first where all its bits are used."""
        if b.depth == self.depth:
            self.slots = [s for s in self.slots for _ in (0, 1)]
            self.depth += 1
        bit = 1 << (63 - self.skip - b.depth)
        two = [Bucket(b.depth + 1, {k: v for k, v in b.chains.items() if bool(k & bit) == side}) for side in (False, True)]
        width = 1 << (self.depth - b.depth)
        at = self._slot(h) // width * width
        self.slots[at : at + width] = [two[0]] * (width // 2) + [two[1]] * (width // 2)
        return two[bool(h & bit)]

    def write(self, out, texts_end: int, own: int) -> None:
        """Pages of changed buckets, the directory and the footer, after the text frames."""
        pages, at = {}, texts_end
        for b in dict.fromkeys(self.slots):
            if b.changed:
                page = zstandard.compress(b"".join(_RECORD.pack(*r) for chain in b.chains.values() for r in chain))
                out.write(struct.pack("<I", len(page)) + page)
                b.place, at = (own, at), at + 4 + len(page)
        for b in self.slots:
            pages[len(pages)] = struct.pack("<IIQ", b.place[0], b.depth, b.place[1])
        plain = struct.pack("<II", len(self.slots), self.depth) + ",".join(self.names).encode() + b"\n" + b"".join(pages.values())
        packed = zstandard.compress(plain)
        out.write(packed + _FOOTER.pack(at, len(packed), self.skip))

    def close(self) -> None:
        for f in self._open.values():
            f.close()


_ENTRY = pa.schema([("h", pa.int64()), ("sha", pa.string()), ("n", pa.int64()), ("first", pa.int64()), ("at", pa.int32()), ("ids", pa.list_(pa.int64())), ("text", pa.binary())])


def _gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of a scan task."""
    worker.starts("op12")
    seen: dict[int, list[tuple]] = {}
    held = rows = 0

    def flush() -> pa.RecordBatch:
        out = []
        for h, chain in seen.items():
            for text, sha, ids in chain:
                at = min(range(len(ids)), key=lambda k: _order(ids[k]))
                out.append((h, sha, len(ids), ids[at], at, ids, text))
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ENTRY, strict=True)], schema=_ENTRY)

    for batch in batches:
        for i, sha, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            chain = seen.setdefault(h, [])
            for known in chain:
                if known[0] == text:
                    known[2].append(i)
                    break
            else:
                chain.append((text, sha, [i]))
                held += len(text)
            rows += 1
            if held >= CHUNK or rows >= ROWS:
                yield flush()
                held = rows = 0
    if seen:
        yield flush()


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):  # few texts at a time as Python objects
            yield from zip(*(c.to_pylist() for c in batch.slice(k, 256).columns), strict=True)


_LEAD = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("winner", pa.int64()), ("members", pa.list_(pa.int64())), ("text", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _joined(group: list, n: int, first: int | None, winner: int, members: list[int]) -> None:
    """Take an entry's rows into ``group``: [rows, first id, entry that holds it, entries]."""
    if (_order(first), winner) < (_order(group[1]), group[2]):
        group[1:3] = [first, winner]
    group[0] += n
    group[3] += members


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of one hash and salt become one for each text."""
    worker.starts("op12")
    for _, rows in groupby(_rows(batches), key=itemgetter(0, 1)):
        chain: list[tuple[bytes, list]] = []
        for h, _, entry, n, first, text in rows:
            group = next((g for known, g in chain if known == text), None)
            if group is None:
                chain.append((text, [n, first, entry, [entry]]))
            else:
                _joined(group, n, first, entry, [entry])
        for text, g in chain:
            yield _batch([(h, *g, text)], _LEAD)


_OWNED = pa.schema([("entry", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("stays", pa.bool_()), ("part", pa.int32()), ("file", pa.string())])


def _owner(folder: str, bits: int):
    """The task of one key range: its index, and what each entry belongs to."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.starts("op12")
        for part, rows in groupby(_rows(batches), key=itemgetter(0)):
            yield from of_range(part, rows)

    def of_range(part: int, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        index, fresh, size, at, out = None, [], 0, 0, []
        with files.new_file(folder, f"range-{part:05d}", ".idx") as (name, file):

            def flush_texts() -> None:
                nonlocal at, size
                if fresh:
                    frame = zstandard.compress(b"".join(fresh))
                    file.write(struct.pack("<I", len(frame)) + frame)
                    at, size = at + 4 + len(frame), 0
                    fresh.clear()

            started = 0
            for (h, is_entry), same in groupby(rows, key=itemgetter(1, 2)):
                if not is_entry:  # the range's row of the manifest comes before its entries
                    index = Index(folder, bits, next(same)[-1])
                    started = len(index.names)
                    index.names.append(name)
                    continue
                if index is None:
                    index = Index(folder, bits)
                    index.names.append(name)
                key = h & _ALL
                chain = [(index.text(r), r, [0, None, -1, []]) for r in index.chain(key)]
                known = len(chain)
                for _, _, _, n, first, winner, members, text, _ in same:
                    group = next((g for seen, _, g in chain if seen == text), None)
                    if group is None:
                        chain.append((text, None, [n, first, winner, list(members)]))
                    else:
                        _joined(group, n, first, winner, members)
                for k, (text, record, (n, first, winner, members)) in enumerate(chain):
                    if not n:
                        continue
                    if k < known:  # what the index holds stays
                        record[6] += n
                        index.touch(key)
                        first, winner = record[5] if record[7] else None, None
                    else:
                        if size >= FRAME:
                            flush_texts()
                        record = [key, started, at, size, len(text), first or 0, n, first is not None]
                        fresh.append(text)
                        size += len(text)
                        index.add(record)
                    out += [(m, first, record[6], m == winner, None, None) for m in members]
                if len(out) >= 10_000:
                    yield _batch(out, _OWNED)
                    out = []
            flush_texts()
            index.write(file, at, started)
            index.close()
        yield _batch([*out, (None, None, None, None, part, name)], _OWNED)

    return run


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {kinds.get(f.type, 'array<long>')}" for f in schema)


def _index(docs: DataFrame, folder: str, known: DataFrame | None, bits: int | None, id_column: str, text_column: str, hashed) -> tuple[DataFrame, DataFrame]:
    text = normalised(f"`{text_column}`")
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), text.alias("t")).select("id", F.sha2("t", 256).alias("sha"), hashed("t").alias("h"), F.col("t").cast("binary").alias("text"))
    entries = scratch.table(rows.mapInArrow(_gather, _ddl(_ENTRY)).withColumn("entry", F.monotonically_increasing_id()), "entries", batch=500)
    if bits is None:  # about 50,000 entries a range
        bits = max(5, (entries.count() // 50_000).bit_length())
    with scratch.batches(docs.sparkSession, 2_000):
        several = entries.filter("n > 1").select("h", F.pmod("entry", F.lit(SALTS)).alias("salt"), "entry", "n", "first", "text")
        several = several.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(_merge, _ddl(_LEAD))
        leads = entries.filter("n = 1").select("h", "n", "first", F.col("entry").alias("winner"), F.array("entry").alias("members"), "text").unionByName(several)
        part = F.shiftrightunsigned("h", 64 - bits).cast("int")
        leads = leads.select(part.alias("part"), "h", F.lit(True).alias("is_entry"), "n", "first", "winner", "members", "text", F.lit(None).cast("string").alias("file"))
        if known is not None:
            before = known.select(
                "part", F.shiftleft(F.col("part").cast("long"), 64 - bits).alias("h"), F.lit(False).alias("is_entry"), *(F.lit(None).cast(t).alias(c) for c, t in leads.dtypes[3:-1]), "file",
            )
            leads = leads.unionByName(before)
        dealt = leads.repartitionById(1 << bits, "part").sortWithinPartitions("part", "is_entry", "h", "winner")
        owned = scratch.table(dealt.mapInArrow(_owner(folder, bits), _ddl(_OWNED)), "owned", batch=2_000)
    manifest = owned.filter("file IS NOT NULL").select("part", "file", F.lit(bits).alias("bits"))
    members = entries.select("entry", "sha", "ids", "at").join(owned.filter("file IS NULL").select("entry", "keep_id", "group_size", "stays"), "entry")
    each = members.select("keep_id", "group_size", "stays", "sha", "at", F.posexplode("ids").alias("k", "id"))
    kept = F.col("stays") & (F.col("k") == F.col("at"))
    return each.select(F.col("id").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256")), manifest


def exact_dedup(docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text", bits: int | None = None, hashed=F.xxhash64) -> DataFrame:
    """Index ``docs`` in the new ``folder``; per row doc_id, keep_id, group_size, kept, text_sha256. ``bits``: leading bits of
    a hash that name its range; ``hashed``: the hash, a signed long of a text column."""
    got, manifest = _index(docs, folder, None, bits, id_column, text_column, hashed)
    manifest.coalesce(1).write.parquet(f"{folder}/manifest-0")
    return got


def extend(docs: DataFrame, folder: str, version: int, id_column: str = "doc_id", text_column: str = "text", hashed=F.xxhash64) -> DataFrame:
    """The same for a later batch against the index as of ``version`` (0 is the first), which becomes the next version.
    ``group_size`` counts the rows of all versions so far."""
    spark = docs.sparkSession
    before = spark.read.schema("part int, file string, bits int").parquet(f"{folder}/manifest-{version}")
    bits = (before.agg(F.max("bits")).head() or [None])[0] or 5
    got, manifest = _index(docs, folder, before, bits, id_column, text_column, hashed)
    manifest.coalesce(1).write.parquet(f"{folder}/manifest-{version + 1}")
    return got


SQL = r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM t"""
