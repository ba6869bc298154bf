"""Units of text whose tokens do not depend on what stands around them, and caches over them.

The split pattern of the byte-level vocabularies never joins non-space characters with the white
space after them. So a text may be cut after every run of non-space characters, and the tokens of
the text are those of its units, one after the other. Words repeat, so each unit's result is kept
in a bounded cache of the worker and the text costs one dictionary look-up per word.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

import regex

#: The characters that the pattern's \s takes (Unicode White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
_UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_SPACES = frozenset(SPACE)
#: Entries of a cache, and characters of a unit that it keeps: some 100 MB at most. A full cache starts afresh, which
#: costs time and changes no result; longer units seldom come again.
CACHE, LONG = 400_000, 64
#: Fixed value: the pattern by which byte-level .json vocabularies split text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _Uncuttable(Exception):
    """A word of the fast split touches more white space than one separator."""


class _Full(dict):
    """unit -> result."""

    def __init__(self, compute: Callable, limit: int):
        self.compute, self.limit = compute, limit

    def __missing__(self, unit):
        got = self.compute(unit)
        if len(unit) <= LONG:
            if len(self) >= self.limit:
                self.clear()
            self[unit] = got
        return got


class _Words(dict):
    """word, without the separator before it -> result of separator and word."""

    def __init__(self, full: _Full):
        self.compute, self.limit = full.compute, full.limit

    def __missing__(self, word):
        lead = word[:1] == "\n"
        if len(word) <= lead or word[lead] in _SPACES or word[-1] in _SPACES:
            raise _Uncuttable
        got = self.compute(word if lead else " " + word)
        if len(word) <= LONG:
            if len(self) >= self.limit:
                self.clear()
            self[word] = got
        return got


class Units:
    """Gives the results of a text's units, in order; compute(unit) must depend on the unit only."""

    def __init__(self, compute: Callable, limit: int = CACHE):
        self.full = _Full(compute, limit)
        self.words = _Words(self.full)

    def of(self, text: str) -> list:
        if not text:
            return []
        body = text.rstrip(SPACE)
        if not body:
            return [self.full[text]]
        tail = [self.full[text[len(body):]]] if len(body) < len(text) else []
        if " \n" not in body and "  " not in body:
            # One separator before each word: a space, or a line end that stays with its word.
            first, *rest = body.replace("\n", " \n").split(" ")
            if first and first[-1] not in _SPACES:
                try:
                    return [self.full[first], *map(self.words.__getitem__, rest), *tail]
                except _Uncuttable:
                    pass
        return [*map(self.full.__getitem__, _UNIT.findall(body)), *tail]


def load_ranks(path: str) -> dict[bytes, int]:
    """Bytes of each token -> its rank, which is its id, from a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in .json vocabularies of this kind: a byte that prints
    in Latin-1 stands for itself, the others take the characters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: Code points that this version of ``regex`` takes for letters or numbers and the tokenizer libraries,
#: with older Unicode tables, don't (found by trying all code points, as ``later`` does for any other version).
TRIED = "2026.9.29"
LATER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF "
    "10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 "
    "16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 "
    "1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 "
    "1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)


def try_all() -> str:
    """The code points that ``regex`` takes for letters or numbers and the tokenizers library doesn't."""
    from tokenizers import pre_tokenizers

    every, out = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])), []
    for kind, usual in (("L", "a"), ("N", "1")):
        found = regex.findall(rf"\p{{{kind}}}", every)
        split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str("".join(f" {usual}{c}" for c in found))
        ends = {b for _, (_, b) in split}
        out += [c for k, c in enumerate(found) if 3 * k + 2 in ends]  # cut before it
    return "".join(sorted(out))


@lru_cache(maxsize=1)
def later() -> re.Pattern:
    if regex.__version__ == TRIED:
        return re.compile("[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in LATER.split()) + "]")
    return re.compile(f"[{re.escape(try_all())}]")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """The words of a unit, as the libraries split it."""
    findall, newer = regex.compile(pattern).findall, later()

    def split(unit: str) -> list[str]:
        if max(unit) < "\u0530" or not newer.search(unit):
            return findall(unit)
        out, at = [], 0
        for w in findall(newer.sub("\u2603", unit)):
            out.append(unit[at : at + len(w)])
            at += len(w)
        return out

    return split
