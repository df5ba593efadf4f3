"""Token counts by heap-and-linked-list byte-pair merging.

The vocabulary file is a ``tokenizers`` JSON of a BPE with word ends. A text
is normalized and split as the file says; the symbols of each word stand in
a doubly linked list, a heap has the adjacent pairs by rank, and the lowest
rank is merged until none is left. A word's count is its initial symbols
less its merges, so no identifiers are made.

Defined cases: a null or empty text has 0 tokens; texts of any length are
counted whole; a special string inside a text is one token, as the library
has it by default; repeated rows and other columns are left alone.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that the library's split doesn't know as letters or
#: numbers yet, though newer Unicode tables do.
UNKNOWN = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Capitals that the library's lower-casing knows and an older
#: ``str.lower`` doesn't, as first and last code point and the distance.
CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1),
    (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
_LOWER = {"Σ": "σ"} | {chr(c): chr(c + by) for a, b, by in CAPITALS for c in range(a, b + 1)}
_CAPITAL = regex.compile("[" + "".join(_LOWER) + "]")
#: Words whose counts a worker remembers; beyond that it starts anew.
MEMO_WORDS = 1_000_000


class MergeCounter:
    """Counts tokens of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self._check(spec, model)
        self.end = model["end_of_word_suffix"]
        pairs = (m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])
        vocab = model["vocab"]
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.known = set(vocab)
        self.byte_symbol = _byte_symbols()
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"])
        unknown = "".join(f"{chr(a)}-{chr(b)}" for a, b in UNKNOWN)
        known = split["pattern"]["Regex"].replace(r"\p{L}", rf"[\p{{L}}--[{unknown}]]").replace(r"\p{N}", rf"[\p{{N}}--[{unknown}]]")
        #: For parts that aren't ASCII: without the letters that are too new.
        self.split_known = regex.compile(known, regex.V1)
        self.memo: dict[str, int] = {}

    @staticmethod
    def _check(spec: dict, model: dict) -> None:
        """Refuse files whose features this counter doesn't have."""
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = [p["type"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        ok = (
            model["type"] == "BPE"
            and not model["dropout"]
            and not model.get("ignore_merges")
            and not model["byte_fallback"]
            and not model["continuing_subword_prefix"]
            and model["end_of_word_suffix"]
            and kinds == ["NFC", "Replace", "Lowercase"]
            and split == ["Split", "ByteLevel"]
            and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        )
        if not ok:
            raise ValueError("not a word-end BPE file that this counter supports")

    def count(self, text: str) -> int:
        if self.special is None:
            return self._count_plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self._count_plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self._count_plain(text[at:] if at else text)

    def _count_plain(self, text: str) -> int:
        # Final sigma apart, str.lower maps each character by itself, as the file's Lowercase does.
        text = unicodedata.normalize("NFC", text)
        if not text.isascii():
            text = _CAPITAL.sub(lambda m: _LOWER[m[0]], text)
        text = text.lower()
        # No word of the split holds a space, so the parts between spaces count
        # by themselves; most are a single word.
        memo, parts = self.memo, text.split(" ")
        counts = list(map(memo.get, parts))
        if None in counts:
            if len(memo) >= MEMO_WORDS:
                memo.clear()
            for i, n in enumerate(counts):
                if n is None:
                    part = parts[i]
                    counts[i] = sum(map(self._word, (self.split if part.isascii() else self.split_known).findall(part)))
        return sum(counts)

    def _word(self, word: str) -> int:
        n = self.memo.get(word)
        if n is None:
            n = self.merged(word)
            if len(word) <= 64:
                self.memo[word] = n
        return n

    def merged(self, word: str) -> int:
        """Symbols left of one word: the initial ones less the merges."""
        symbols = [self.byte_symbol[b] for b in word.encode("utf-8")]
        symbols[-1] += self.end
        symbols = [s for s in symbols if s in self.known]  # without an unknown token, unknown symbols vanish
        n = len(symbols)
        if n < 2:
            return n
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.ranks
        heap = []
        for i in range(n - 1):
            rank = ranks.get((symbols[i], symbols[i + 1]))
            if rank is not None:
                heap.append((rank, i, symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if symbols[i] == left else -1
            if j < 0 or symbols[j] != right:
                continue  # one of the two has gone into another merge
            symbols[i] = left + right
            symbols[j] = ""
            merges += 1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0:
                    rank = ranks.get((symbols[a], symbols[b]))
                    if rank is not None:
                        heapq.heappush(heap, (rank, a, symbols[a], symbols[b]))
        return n - merges


def _byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: bytes
    that print stand for themselves, the others for code points from 256."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printing else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(text: Column, path: str) -> Column:
    """Tokens of each text; ``path`` is the vocabulary file on the executors."""

    def count(texts: pa.Array) -> pa.Array:
        c = counter(path)
        return pa.array([c.count(t) if t else 0 for t in (x.as_py() for x in texts)], pa.int64())

    return F.arrow_udf(count, "bigint").asNondeterministic()(text)
