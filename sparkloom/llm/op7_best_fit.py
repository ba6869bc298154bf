"""Best-fit-decreasing packing into id matrices on disk.

Documents are tokenised whole and cut into pieces of at most a sequence; whole-length pieces fill a
sequence each. The others of a block (a bounded number of tokens of one task) go, longest first, to the
open sequence with the least room that is enough. A segment tree over the capacities 0..L tells that room
in log L steps. Blocks are packed apart, so no row is shuffled and memory is bounded by the block.

A block is one Arrow IPC file in the shared folder, a row per sequence: the packed ids, the cumulative
segment lengths, the position ids, which start again at 0 with each segment, and the documents' ids, starts
and token counts. The manifest (file, first sequence, number) is a committed table; files of attempts that
do not count are in no manifest.

Cases: null and empty text is the end id alone; a text longer than a sequence is split without loss, one
longer than a block gives a larger block; repeated rows and null ids are packed each; pieces of equal length keep
their order; columns not named are ignored, whatever their names; an empty table gives an empty table and no file.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files, scratch, worker
from .library_ids import library

SEQUENCE = pa.schema([("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("positions", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("start", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64()))])


class Room:
    """A segment tree over capacities: how many open sequences have a capacity at or below each node."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = self.size + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, seq: int) -> None:
        self.open[capacity].append(seq)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The open sequence with the least capacity of ``need`` or more, and that capacity."""
        node, count = self.size + need, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._add(capacity, -1)
        return self.open[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Sequences as lists of piece numbers; pieces of equal length in their order."""
    room, out = Room(size), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        got = room.take(lengths[k])
        if got:
            seq, capacity = got
            out[seq].append(k)
        else:
            seq, capacity = len(out), size
            out.append([k])
        if capacity > lengths[k]:
            room.put(capacity - lengths[k], seq)
    return out


def write_packed(
    docs: DataFrame, path: str, folder: str, size: int = 1024, end_id: int = 0, pad_id: int = 0, block_tokens: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pack and write; the manifest: file, first_sequence, n_sequences, n_segments, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.starts("ids", library.cache_clear)
        own, part, seqs = library(path), TaskContext.get().partitionId(), 0
        end, kind = array("I", [end_id]).tobytes(), "<u2" if own.own.get_vocab_size() <= 1 << 16 > max(end_id, pad_id) else "<u4"
        held: list[tuple] = []  # doc_id, start, doc_tokens, ids

        def flush() -> pa.RecordBatch:
            nonlocal seqs
            lengths = [len(p[3]) for p in held]
            with files.new_file(folder, f"block-{part:06d}", ".arrow") as (name, out), pa.ipc.new_file(out, SEQUENCE, options=pa.ipc.IpcWriteOptions(compression="zstd")) as sink:
                packed = best_fit_decreasing(lengths, size)
                for k in range(0, len(packed), 1024):
                    rows = []
                    for s in packed[k : k + 1024]:
                        pieces = [held[i] for i in s]
                        own_lengths = [len(p[3]) for p in pieces]
                        ids, pos = np.full(size, pad_id, kind), np.zeros(size, "<u4" if size > 1 << 16 else "<u2")
                        at = 0
                        for p, n in zip(pieces, own_lengths, strict=True):
                            ids[at : at + n], pos[at : at + n] = p[3], np.arange(n)
                            at += n
                        rows.append((ids.tobytes(), [0, *np.cumsum(own_lengths).tolist()], pos.tobytes(), *([p[c] for p in pieces] for c in range(3))))
                    sink.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), SEQUENCE, strict=True)], schema=SEQUENCE))
            row = {"file": [name], "first_sequence": [part << 40 | seqs], "n_sequences": [len(packed)], "n_segments": [len(held)], "n_tokens": [sum(lengths)]}
            seqs += len(packed)
            held.clear()
            return pa.RecordBatch.from_pydict(row)

        tokens = 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(own.ids(text.as_py() or "") + end, "<u4").astype(kind)
                held += [(doc, a, len(ids), ids[a : a + size]) for a in range(0, len(ids), size)]
                tokens += len(ids)
                if tokens >= block_tokens:
                    yield flush()
                    tokens = 0
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return scratch.table(rows.mapInArrow(run, "file string, first_sequence long, n_sequences long, n_segments long, n_tokens long"), "packed-manifest", batch=1024)


def read_packed(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the files back: a row per segment with its place, the digest of its ids and whether its positions start again at 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = files.shared(folder)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "positions_ok"]
        for b in batches:
            for file, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seq = first
                with store.open_input_file(f"{path}/{file}") as f, pa.ipc.open_file(f) as source:
                    for k in range(source.num_record_batches):
                        rows = []
                        for r in source.get_batch(k).to_pylist():
                            cu = r["cu_seqlens"]
                            size = len(r["positions"]) // 2 if len(r["positions"]) <= 2 << 16 else len(r["positions"]) // 4
                            ids = memoryview(np.frombuffer(r["ids"], f"<u{len(r['ids']) // size}").astype("<u4").tobytes())
                            pos = np.frombuffer(r["positions"], f"<u{len(r['positions']) // size}")
                            for d, s, t, a, z in zip(r["doc_id"], r["start"], r["doc_tokens"], cu, cu[1:], strict=False):
                                rows.append((d, s, z - a, zlib.crc32(ids[4 * a : 4 * z]), t, seq, a, bool(pos[a] == 0 and pos[z - 1] == z - a - 1)))
                            seq += 1
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 7 + [pa.bool_()], strict=True)], names=names)

    # A task a file: the manifest is small, the files are not.
    spread = manifest.select("file", "first_sequence").repartition(max(1, manifest.count()), "file")
    return spread.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, positions_ok boolean")
