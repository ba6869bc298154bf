"""Token ids of whole texts as the tokenizers library gives them, unit by unit (see ``bytebpe``).

A word that is new to the cache goes to tiktoken's merger over the same .json vocabulary, several times as
fast a call; that is right where a token's id is the rank of its merge, which is checked when the file is
loaded. Other files, and texts with a special string, go to the tokenizers library itself. ``many`` needs no cache: it
sends the distinct words of some texts to the merger as one text.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import bytebpe

#: Bytes of texts whose words are merged together, about; a longer text goes alone, word by word.
TOGETHER = 1 << 23


def _merger(path: str):
    """tiktoken's encoder for the vocabulary, or None where ids aren't merge ranks."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    order = [vocab["".join(m)] for m in merges]
    kind = spec.get("pre_tokenizer") or {}
    plain = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not spec.get("normalizer") and not spec["model"].get("ignore_merges")
    if not plain or order != sorted(order) or len(vocab) != len(merges) + 256 or min(order, default=256) < 256:
        return None
    back = {c: b for b, c in bytebpe.byte_alphabet().items()}
    ranks = {bytes(back[c] for c in token): i for token, i in vocab.items()}
    return tiktoken.Encoding("own", pat_str=bytebpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class LibraryIds:
    """Ids of a byte-level .json vocabulary, as the library gives them without added special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own, self.merge = Tokenizer.from_file(path), _merger(path)
        self.special = [(t.content, array("I", [i]).tobytes()) for i, t in self.own.get_added_tokens_decoder().items()]
        self.units = bytebpe.Units(self.unit)
        self.size = np.zeros(self.own.get_vocab_size(), np.int64)  # bytes of a token, a character each in the vocabulary
        for token, i in self.own.get_vocab(with_added_tokens=False).items():
            self.size[i] = len(token)

    def by_library(self, text: str) -> bytes:
        return array("I", self.own.encode(text, add_special_tokens=False).ids).tobytes()

    def unit(self, unit: str) -> bytes:
        return array("I", self.merge(unit)).tobytes() if self.merge else self.by_library(unit)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(s in text for s, _ in self.special):
            return self.by_library(text)
        return b"".join(self.units.of(text))

    def many(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text (null: empty), unsigned 32-bit. The distinct words of some texts are merged at once."""
        texts = texts.fill_null("")
        if not self.merge:
            yield from map(self._alone, texts.to_pylist())
            return
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(texts):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOGETHER, "right")))
            yield from self._together(texts.slice(a, z - a)) if ends[z - 1] - (ends[a - 1] if a else 0) <= TOGETHER else [self._alone(texts[a].as_py())]
            a = z

    def _alone(self, text: str) -> np.ndarray:
        return np.frombuffer(self.ids(text), "<u4")

    def _together(self, texts: pa.Array) -> Iterator[np.ndarray]:
        odd = pc.or_(pc.not_equal(pc.utf8_trim(texts, bytebpe.SPACE), texts), pc.equal(texts, ""))
        for part in ("  ", " \n", *(t for t, _ in self.special)):
            odd = pc.or_(odd, pc.match_substring(texts, part))
        odd = odd.to_numpy(zero_copy_only=False).copy()
        words = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n"), " ")
        at, coded = words.offsets.to_numpy().astype(np.int64), words.values.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        heads, known = codes[at[:-1]], coded.dictionary
        # All distinct words go to the merger as one text; bytes tell whose a token is.
        line = pc.starts_with(known, "\n")
        bare = pc.if_else(line, pc.utf8_slice_codeunits(known, 1), known)
        bad = pc.or_(pc.equal(bare, ""), pc.not_equal(pc.utf8_trim(bare, bytebpe.SPACE), bare))
        units = pc.if_else(bad, " x", pc.if_else(line, known, pc.binary_join_element_wise("", known, " ")))
        flat = np.array(self.merge("".join(units.to_numpy(zero_copy_only=False).tolist())), np.int64)
        stops, ends = np.cumsum(self.size[flat]), np.cumsum(pc.binary_length(units).to_numpy(zero_copy_only=False).astype(np.int64))
        upto = np.searchsorted(stops, ends, "right")
        if len(ends) and not np.array_equal(stops[upto - 1], ends):  # a token crosses words, which the pattern rules out
            yield from map(self._alone, texts.to_pylist())
            return
        many, bad = np.diff(upto, prepend=0), bad.to_numpy(zero_copy_only=False)
        # A text's first word has no separator before it.
        firsts = known.take(pa.array(heads)).to_pylist()
        fits = np.array([bool(w) and w[-1] not in bytebpe.SPACE for w in firsts], bool)
        first = [np.frombuffer(self.units.full[w], "<u4") if ok else np.empty(0, "<u4") for w, ok in zip(firsts, fits.tolist(), strict=True)]
        codes[at[:-1]] = len(known) + np.arange(len(heads))
        flat = np.concatenate([flat.astype("<u4"), *first])
        many, bad = np.concatenate([many, np.array([len(x) for x in first], np.int64)]), np.concatenate([bad, ~fits])
        begins, own = np.cumsum(many) - many, many[codes]
        before = np.concatenate([[0], np.cumsum(own)])
        out = flat[np.repeat(begins[codes] - before[:-1], own) + np.arange(before[-1])]
        cut, wrong = before[at], np.add.reduceat(bad[codes], at[:-1]) if len(heads) else []
        k = 0
        for row, is_odd in enumerate(odd.tolist()):
            if is_odd or wrong[k]:
                yield self._alone(texts[row].as_py())
            else:
                yield out[cut[k] : cut[k + 1]]
            k += not is_odd


@lru_cache(maxsize=2)
def library(path: str) -> LibraryIds:
    return LibraryIds(path)
