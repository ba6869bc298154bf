"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' tokens, one after the other. A window is 64 sequences of 1024 tokens and
visits all queues; a queue's quantum is its target share of a window, and what rounding keeps from it (or
gives it early) stays in its deficit counter for the next window. So every window holds its target proportions to
the token, and all sequences are full.

Within its window a queue waits until its deficit covers its next unit: a document (or what the window holds of it), in
stretches of a sequence's length where it is longer. The units of all queues so stand in the order in which their queues' served
shares reach their ends: at each place of a window a queue waits for one unit at most, beside its share of what others wait for. A document is cut
only where its queue's window, a sequence or such a stretch ends.

The deficits between windows need no replay: with weights scaled to whole numbers, the tokens that the first q queues
have been served after w windows are ``w * cum[q] >> SHIFT``, and a queue's deficit is what its exact
share has over that. So any partition takes up at any window with the deficits that all earlier
windows and partitions leave, and a row finds its windows by arithmetic alone. The driver plans *runs*:
stretches of windows in which the same queues have tokens. When a queue runs dry, the windows at the
seam are served one by one and the others' shares grow in proportion. The ids are then shuffled by window, whose groups are all
of one size, whatever the sources' are.

At most QUEUES queues, those of two tokens a window or more, are planned one by one, so the plan is small at any
size. All others share one queue, in which each document stands where its source's own deficit lets it end, as
tokens before its end over the source's weight: the sources of the tail advance side by side, by whole documents.

What is left after the last full sequence is cut into sequences of lengths that are powers of two.

Cases: null and empty text is the end id alone; null and empty source are one queue; repeated rows and
repeated or null ``doc_id`` are packed each; any length of text is cut; columns not named are ignored, whatever their
names; ties in the shared queue go by source and place; an empty table gives an empty table. The order in a queue
is that of the input partitions.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, worker
from .library_ids import library

SHIFT = 20
#: Queues that the driver plans, at most.
QUEUES = 512
#: Tokens of the shared queue that one task puts in order, about.
POOL_PART = 1 << 26
#: Rows that a task gives on at a time.
ROWS = 512
#: Starts of queues in parts that may be broadcast: at about 100 bytes each, 30 MB. With more, the ids are shuffled to them.
BROADCAST_ROWS = 300_000


def tokenised(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, queue_col: str) -> DataFrame:
    """part, queue, doc_id, n, at (tokens of the queue before the row in this part), ids (unsigned 16-bit, or 32 where needed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.starts("ids", library.cache_clear)
        own, part, served = library(path), TaskContext.get().partitionId(), {}
        wide = own.own.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
        end = array("I" if wide else "H", [end_id]).tobytes()
        for whole in batches:
            found = own.many(whole.column(2))
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                queues, n, at, ids = b.column(1).to_pylist(), [], [], []
                for q, got in zip(queues, islice(found, len(queues)), strict=True):
                    ids.append((got if wide else got.astype("<u2")).tobytes() + end)
                    n.append(len(got) + 1)
                    at.append(served.get(q, 0))
                    served[q] = at[-1] + n[-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(n), pa.int32()), b.column(1), b.column(0), pa.array(n, pa.int64()), pa.array(at, pa.int64()), pa.array(ids, pa.binary())],
                    names=["part", "queue", "doc_id", "n", "at", "ids"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(queue_col).cast("string"), F.lit("")).alias("queue"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "part int, queue string, doc_id long, n long, at long, ids binary")


class Plan:
    """Where each queue's tokens go: runs of windows, their weights and what the queues gave before."""

    def __init__(self, totals: list[int], weights: list[float], window: int, size: int):
        q, left, self.window, self.size, self.end = len(totals), list(totals), window, size, sum(totals)
        longest = (1 << 62 - SHIFT) // window  # windows of a run: run * cum stays below 2**62
        starts, cums, given, at = [0], [], [[0] * q], 0

        def run(n: int, cum: list[int]) -> None:
            nonlocal at
            before = [n * c >> SHIFT for c in cum]
            for k in range(q):
                left[k] -= before[k + 1] - before[k]
            at += n
            starts.append(at)
            cums.append(cum)
            given.append([totals[k] - left[k] for k in range(q)])

        while sum(left) >= window:
            live = [k for k in range(q) if left[k]]
            share = self._shares([weights[k] for k in live])
            n = min(longest, *(((left[k] - 1) << SHIFT) // s for k, s in zip(live, share, strict=True)))
            own = dict(zip(live, share, strict=True))
            if n:
                run(n, self._cum([own.get(k, 0) for k in range(q)]))
            else:
                run(1, self._cum([t << SHIFT for t in self._round(left, own)]))
        if sum(left):
            run(1, self._cum([t << SHIFT for t in left]))
        self.start, self.cum, self.given = np.array(starts), np.array(cums or [[0] * (q + 1)], np.int64), np.array(given, np.int64)

    def _shares(self, weights: list[float]) -> list[int]:
        """Quanta in 2**-SHIFT tokens, a token at least, a window in all."""
        all_, one = sum(weights), 1 << SHIFT
        out = [max(one, int(w / all_ * self.window * one)) for w in weights]
        out[out.index(max(out))] += self.window * one - sum(out)
        return out

    def _round(self, left: list[int], share: dict[int, int]) -> list[int]:
        """One window served turn by turn, for queues that run dry in it."""
        out, need = [0] * len(left), self.window
        while need:
            live = [k for k in share if left[k] > out[k]]
            all_, turn = sum(share[k] for k in live), need
            for k in live:
                got = min(left[k] - out[k], max(1, turn * share[k] // all_), need)
                out[k] += got
                need -= got
        return out

    @staticmethod
    def _cum(share: list[int]) -> list[int]:
        out = [0]
        for s in share:
            out.append(out[-1] + s)
        return out

    def find(self, queue: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The window of token ``at`` of its queue."""
        run = np.empty(len(at), np.int64)
        for k in np.unique(queue):
            own = queue == k
            run[own] = np.searchsorted(self.given[:, k], at[own], "right") - 1
        rel, lo, hi = at - self.given[run, queue], self.cum[run, queue], self.cum[run, queue + 1]
        w = np.clip(((rel + 0.5) * (1 << SHIFT) / (hi - lo)).astype(np.int64), 0, self.start[run + 1] - self.start[run] - 1)
        while True:
            high, low = ((w * hi >> SHIFT) - (w * lo >> SHIFT)) > rel, (((w + 1) * hi >> SHIFT) - ((w + 1) * lo >> SHIFT)) <= rel
            if not (high.any() or low.any()):
                return self.start[run] + w
            w += low.astype(np.int64) - high

    def turn(self, queue: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A queue's turn in a window: its first token and the one after its last."""
        run = np.searchsorted(self.start, window, "right") - 1
        w, base, lo, hi = window - self.start[run], self.given[run, queue], self.cum[run, queue], self.cum[run, queue + 1]
        return base + (w * hi >> SHIFT) - (w * lo >> SHIFT), base + ((w + 1) * hi >> SHIFT) - ((w + 1) * lo >> SHIFT)

    def units(self, queue: np.ndarray, at: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        """row, window, start in the row, length, first and length of the queue's turn for each unit of rows at ``at``."""
        first, last = self.find(queue, at), self.find(queue, at + n - 1)
        row, k = _spread(last - first + 1)
        window = first[row] + k
        lo, hi = self.turn(queue[row], window)
        a, z = np.maximum(lo, at[row]), np.minimum(hi, (at + n)[row])
        some = z > a
        row, window, lo, hi, a, z = (x[some] for x in (row, window, lo, hi, a, z))
        piece, k = _spread(-(-(z - a) // self.size))
        start = a[piece] + k * self.size
        return [row[piece], window[piece], start - at[row[piece]], np.minimum(z[piece] - start, self.size), lo[piece], (hi - lo)[piece]]

    def cut(self, place: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        """piece, start in it, length, sequence and offset: stretches at ``place`` of all tokens, cut where sequences end."""
        full, rest = divmod(self.end, self.size)
        ends = full * self.size + np.cumsum([0, *(1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1)])
        seq = lambda p: np.where(p < ends[0], p // self.size, full + np.searchsorted(ends, p, "right") - 1)
        begins = lambda s: np.where(s < full, s * self.size, ends[np.clip(s - full, 0, len(ends) - 1)])
        lowest = seq(place)
        piece, k = _spread(seq(place + length - 1) - lowest + 1)
        own = lowest[piece] + k
        a, z = np.maximum(place[piece], begins(own)), np.minimum((place + length)[piece], begins(own + 1))
        return [piece, a - place[piece], z - a, own, a - begins(own)]


def in_turns(queue: np.ndarray, row_at: np.ndarray, start: np.ndarray, length: np.ndarray, first: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of a window's units, each when its queue's deficit covers it, and the number of the stretch each falls into: units
    of one document that follow each other are one."""
    at = row_at + start
    order = np.lexsort((at, queue, (at + length - first) / turn))
    q, r, a, n = (x[order] for x in (queue, row_at, at, length))
    new = (q[1:] != q[:-1]) | (r[1:] != r[:-1]) | (a[1:] != a[:-1] + n[:-1])
    return order, np.cumsum(np.concatenate([[0], new]))


def _spread(many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each number repeated as often as its count says, and the repetition's number."""
    row = np.repeat(np.arange(len(many)), many)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)


def _side_by_side(rows: DataFrame, tokens: int, span: float) -> DataFrame:
    """The shared queue's rows with their place in it as ``at``: in the order of ``v``, the virtual time of their end."""
    parts = max(1, -(-tokens // POOL_PART))
    rows = rows.withColumn("slot", F.least(F.floor(F.col("v") / F.lit(span) * parts), F.lit(parts - 1)))
    slots = scratch.table(rows.groupBy("slot").agg(F.sum("n").alias("t")), "packing-slots")  # a row for POOL_PART tokens
    before = F.sum("t").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    begun = slots.select("slot", F.coalesce(before, F.lit(0)).alias("begun"))
    own = F.sum("n").over(Window.partitionBy("slot").orderBy("v", "queue", "at").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(F.broadcast(begun) if parts <= BROADCAST_ROWS else begun, "slot")
    return rows.withColumn("at", (F.col("begun") + F.coalesce(own, F.lit(0))).cast("long"))


def pack_mixture(
    docs: DataFrame, path: str, size: int = 1024, end_id: int = 0, targets: dict[str, float] | None = None, alpha: float = 1.0, sequences: int = 64, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text", queue_col: str = "source",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue (and ids).

    The wanted proportions of queues are those of their tokens to the power ``alpha``, or ``targets`` where it names
    them. Queues that run dry leave their share to the others, so every token is packed. A window has ``sequences``
    sequences of ``size`` tokens."""
    window = size * sequences
    rows = scratch.table(tokenised(docs, path, end_id, id_col, text_col, queue_col), "packing-ids", batch=2 * ROWS)
    parts = scratch.table(rows.groupBy("part", "queue").agg(F.sum("n").alias("t")), "packing-parts")
    weight = F.pow(F.col("t").cast("double"), F.lit(alpha))
    queues = parts.groupBy("queue").agg(F.sum("t").alias("t")).withColumn("w", weight)
    total, weights_all = queues.agg(F.sum("t"), F.sum("w")).head()
    queues = queues.withColumn("w", F.col("w") / F.lit(weights_all or 1.0))
    if targets:
        scale = sum(targets.values()) or 1
        queues = queues.withColumn("w", F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, w in targets.items() for x in (k, w / scale))), F.col("queue")), F.col("w")))
    queues = scratch.table(queues, "packing-queues")
    big = queues.filter(F.col("w") * window >= 2).orderBy(F.desc("w"), "queue").limit(QUEUES).collect()
    names, totals, weights = [r.queue for r in big], [r.t for r in big], [r.w for r in big]
    pooled = (total or 0) - sum(totals)
    index = docs.sparkSession.createDataFrame([(k, q) for k, q in enumerate(names)] or [(-1, None)], "k int, queue string")
    tail = queues.join(F.broadcast(index), "queue", "left_anti")
    if pooled:
        w, span = tail.agg(F.sum("w"), F.max(F.col("t") / F.col("w"))).head()
        totals, weights = [*totals, pooled], [*weights, max(w, 2 / window)]
    plan = Plan(totals, weights, window, size)
    before = F.sum("t").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = parts.join(queues.select("queue", "w"), "queue").join(F.broadcast(index), "queue", "left")
    placed = placed.select("part", "queue", "k", "w", F.coalesce(before, F.lit(0)).cast("long").alias("base"))
    rows = rows.join(F.broadcast(placed) if parts.count() <= BROADCAST_ROWS else placed, ["part", "queue"]).withColumn("at", F.col("base") + F.col("at"))
    own = rows.filter("k IS NOT NULL").select("doc_id", "k", "at", "n", "ids", "queue")
    if pooled:
        shared = _side_by_side(rows.filter("k IS NULL").withColumn("v", (F.col("at") + F.col("n")) / F.col("w")), pooled, span)
        own = own.unionByName(shared.select("doc_id", F.lit(len(names)).alias("k"), "at", "n", "ids", "queue"))
    rows = own

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, ROWS):
                b = whole.slice(s, ROWS)
                k, at, n = (b.column(c).to_numpy().astype(np.int64) for c in (1, 2, 3))
                row, window_of, start, length, first, turn = plan.units(k, at, n)
                ids, width = b.column(4).to_pylist(), [len(x) // m for x, m in zip(b.column(4).to_pylist(), n.tolist(), strict=True)]
                part = [ids[r][width[r] * a : width[r] * z] for r, a, z in zip(row.tolist(), start.tolist(), (start + length).tolist(), strict=True)]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(window_of), pa.array(k[row]), pa.array(at[row]), pa.array(start), pa.array(length), pa.array(first), pa.array(turn), b.column(0).take(take), b.column(3).take(take), b.column(5).take(take), pa.array(part, pa.binary())],
                    names=["window", *numbers, "doc_id", "doc_tokens", "queue", "ids"],
                )

    def filled(w: pa.Table) -> pa.Table:
        k, row_at, start, length, first, turn = (w.column(c).to_numpy() for c in numbers)
        order, stretch = in_turns(k, row_at, start, length, first, turn)
        parts = w.column("ids").to_pylist()
        ids = np.concatenate([np.frombuffer(parts[u], f"<u{len(parts[u]) // n}").astype("<u4") for u, n in zip(order.tolist(), length[order].tolist(), strict=True)])
        heads = np.flatnonzero(np.diff(stretch, prepend=-1))
        lengths, head = np.add.reduceat(length[order], heads), order[heads]
        place = np.cumsum(lengths) - lengths
        base = w.column("window")[0].as_py() * window
        piece, into, n, seq, offset = plan.cut(base + place, lengths)
        begin = place[piece] + into
        own = [ids[a:z].tobytes() for a, z in zip(begin.tolist(), (begin + n).tolist(), strict=True)]
        rows = w.select(["doc_id", "doc_tokens", "queue"]).take(pa.array(head[piece]))
        cols = [rows.column(0), pa.array(start[head][piece] + into), pa.array(n), pa.array([zlib.crc32(x) for x in own], pa.int64()), rows.column(1), pa.array(seq), pa.array(offset), rows.column(2)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"]
        if with_ids:
            cols, names = [*cols, pa.array(own, pa.binary())], [*names, "ids"]
        return pa.table(cols, names=names)

    numbers = ["k", "row_at", "start", "length", "first", "turn"]
    with_windows = rows.mapInArrow(units, "window long, " + ", ".join(f"{c} long" for c in numbers) + ", doc_id long, doc_tokens long, queue string, ids binary")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"
    return with_windows.groupBy("window").applyInArrow(filled, schema + (", ids binary" if with_ids else ""))
