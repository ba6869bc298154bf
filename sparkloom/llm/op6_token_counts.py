"""Token counts by heap-and-linked-list byte-pair merging.

A word's bytes are the first symbols of a doubly linked list. A heap holds its adjacent pairs that
the vocabulary merges, lowest rank first and leftmost among equals; popping a pair that still stands
joins it and offers the two new neighbours. The count is the number of bytes less the number of
merges: no token identifier is made. Counts of words are kept in a cache per worker, bounded in bytes.

Cases: null or empty text counts 0 tokens and 0 bytes; texts of any length count whole; repeated
rows stay; of pairs of equal rank the leftmost merges first; ``doc_id`` passes as it is, null too; other columns are
ignored, whatever their names; an empty table gives
an empty table.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytebpe, worker

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class MergeCounter:
    """Counts the tokens of a .json byte-level vocabulary without making them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        symbols = {s: k for k, s in enumerate({*bytebpe.byte_alphabet().values(), *(a + b for a, b in merges), *(s for m in merges for s in m)})}
        n = self.n = len(symbols)
        #: first symbol * n + second -> (rank, joined symbol); symbols are list indices, not ids.
        self.rank = {symbols[a] * n + symbols[b]: (r, symbols[a + b]) for r, (a, b) in reversed([*enumerate(merges)])}
        self.of_byte = [symbols[c] for _, c in sorted(bytebpe.byte_alphabet().items())]
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])]
        if len(self.special) != len(spec["added_tokens"]):
            raise ValueError("only plain special tokens are supported")
        # The library's own word split: its Unicode tables are the ones that count.
        from tokenizers import Tokenizer

        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.findall = bytebpe.splitter(bytebpe.PATTERN)
        self.words = bytebpe._Full(lambda w: self.word(w.encode()), bytebpe.CACHE)
        self.units = bytebpe.Units(self.unit)

    def word(self, data: bytes) -> int:
        """Tokens of one word: bytes less merges."""
        n, rank = self.n, self.rank.get
        sym = [self.of_byte[b] for b in data]
        size = len(sym)
        after, before = [*range(1, size + 1)], [*range(-1, size - 1)]
        heap = [(got[0], i, sym[i], sym[i + 1], got[1]) for i in range(size - 1) if (got := rank(sym[i] * n + sym[i + 1]))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b, joined = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= size or sym[j] != b:
                continue  # the pair was merged away
            merges += 1
            sym[i], sym[j] = joined, -1
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                if got := rank(joined * n + sym[k]):
                    heapq.heappush(heap, (got[0], i, joined, sym[k], got[1]))
            h = before[i]
            if h >= 0 and (got := rank(sym[h] * n + joined)):
                heapq.heappush(heap, (got[0], h, sym[h], joined, got[1]))
        return size - merges

    def unit(self, unit: str) -> int:
        if max(unit) < "԰":
            words = self.findall(unit)
        else:
            words = [unit[a:b] for _, (a, b) in self.split(unit)]
        return sum(map(self.words.__getitem__, words))

    def count(self, text: str) -> int:
        parts, n = [text], 0
        for s in self.special:  # a special string in a text is one token, as the library has it
            if s in text:
                parts = [q for p in parts for q in p.split(s)]
                n = len(parts) - 1
        return n + sum(sum(self.units.of(p)) for p in parts)


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


@lru_cache(maxsize=2)
def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row. ``path`` is a byte-level
    BPE .json, counted by merging, or a sentencepiece .model, counted by its library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.starts("op6", lambda: (counter.cache_clear(), piece_model.cache_clear()))
        if path.endswith(".model"):
            sp = piece_model(path)
            count = lambda text: len(sp.encode(text, num_threads=1))
        else:
            count = counter(path).count
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
