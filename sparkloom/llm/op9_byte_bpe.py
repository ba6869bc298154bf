"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Token bytes, read as Latin-1, fill a pyahocorasick automaton, whose matches give the longest token at
each position of a word. The encoder takes the longest token that may follow the last one, falls
back to the token's next shorter prefix that is a token, and where none fits takes back the last
token. Two tokens may stand side by side if merging their joined bytes would give just them; that is
decided by undoing merges on both sides of the seam and remembered by pair. Positions from which
there is no way on are marked, so each is left once and the time is linear in the word.

Cases: null or empty text has no tokens and the digests of the empty string; words of any length
are encoded whole; repeated rows stay; where pairs tie in rank the left one merges first, as the merges have it; ``doc_id`` passes as
it is, null too; other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytebpe, worker

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Seams to remember; a full memory starts afresh.
SEAMS = 1_000_000


class ByteBpe:
    """Encoder and decoder for a rank file, exact merges."""

    def __init__(self, path: str, pattern: str):
        ranks = bytebpe.load_ranks(path)
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            self.table[r] = token
        self.findall = bytebpe.splitter(pattern)
        self.matches = ahocorasick.Automaton()
        for r, token in enumerate(self.table):
            if token:
                self.matches.add_word(token.decode("latin-1"), r)
        self.matches.make_automaton()
        self.length = [len(t) for t in self.table]
        #: The longest proper prefix that is a token, or -1.
        self.shorter = [next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ranks), -1) for t in self.table]
        self.seams: dict[int, bool] = {}
        self.pair: dict[int, int] = {}
        #: The two tokens whose merge makes a token; a single byte stands for itself twice.
        self.parts: list[tuple[int, int]] = [(r, r) for r in range(len(self.table))]
        for r in sorted(ranks.values()):
            if self.length[r] > 1:
                got = self.word(self.table[r])  # with lower ranks only: the pair of r is not known yet
                if len(got) == 2:
                    self.parts[r] = (got[0], got[1])
                    self.pair[got[0] << 32 | got[1]] = r
                self.seams.clear()  # a seam may fall to the pair just learnt
            self.ready = r
        self.ready = len(self.table)
        self.words = bytebpe._Full(lambda w: array("I", self.word(w.encode())).tobytes(), bytebpe.CACHE)
        self.units = bytebpe.Units(self.unit, bytebpe.CACHE)

    ready = -1

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b, joined, leaves just a and b."""
        key = a << 32 | b
        known = self.seams.get(key)
        if known is not None:
            return known
        bound = 1 << 62  # merges from this rank on come too late to cross the seam
        x, y, pair, parts = a, b, self.pair, self.parts
        while True:
            joined = pair.get(x << 32 | y)
            if joined is not None and joined < bound:
                ok = False
                break
            # Undo the later of the two merges; a single byte can't be undone.
            px, py = parts[x], parts[y]
            x_whole, y_whole = px[1] == x and px[0] == x, py[0] == y and py[1] == y
            if x_whole and y_whole:
                ok = True
                break
            if y_whole or (x > y and not x_whole):
                bound, x = x, px[1]  # at equal rank the left one merges first
            else:
                bound, y = y + 1, py[0]
        if len(self.seams) >= SEAMS:
            self.seams.clear()
        self.seams[key] = ok
        return ok

    def word(self, data: bytes) -> list[int]:
        size, length, shorter, top = len(data), self.length, self.shorter, self.ready
        longest = [-1] * size
        for end, r in self.matches.iter(data.decode("latin-1")):
            if r <= top:
                at = end + 1 - length[r]
                if longest[at] < 0 or length[r] > length[longest[at]]:
                    longest[at] = r
        out: list[int] = []
        dead = bytearray(size + 1)
        at, token = 0, longest[0] if size else -1
        while at < size:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if token <= top and not dead[end] and (last < 0 or self.fits(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < size else -1
            else:
                if not out:
                    raise ValueError("a byte is not in the vocabulary")
                dead[at] = 1
                back = out.pop()
                at -= length[back]
                token = shorter[back]
        return out

    def unit(self, unit: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.findall(unit)))

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers in the machine's (little-endian) order."""
        return b"".join(self.units.of(text))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_table(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The operator: doc_id, ids (little-endian unsigned 32-bit, as binary) and the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.starts("op9", codec.cache_clear)
        own = codec(path, pattern)
        for b in batches:
            ids = [own.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())], names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of every row's ids and of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.starts("op9", codec.cache_clear)
        own = codec(path, pattern)
        for b in batches:
            n, a, z = [], [], []
            for t in b.column(1).to_pylist():
                ids = own.encode(t or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                z.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(z, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
