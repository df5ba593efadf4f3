"""SentencePiece encoding and decoding by an Aho-Corasick Viterbi.

An automaton over all pieces reads a text once; at each position its output
links give every piece that ends there, the longest first, and each relaxes
the best score of the position: the highest sum of piece scores wins, and of
equal sums the one whose last piece is longest. A character that no piece
covers alone is written as its bytes.

The scores of a unigram file are log probabilities and are used as they are.
Those of a BPE file are whole numbers, its merge ranks, whose sums mean nothing: rank r is
read as the log probability ``-ln(RANK_OFFSET + r)``, by Zipf's law, which no
corpus is needed for. Nothing is trained here. Such a file's own library merges
greedily, so that its pieces differ; the README has figures.

No piece has a space mark after another character (checked when a model is
loaded), so a text falls apart before each run of spaces; a worker remembers
the pieces of recent parts.

Encoding keeps every text whole: a space mark that stands in the text itself is
written as bytes, so that decoding gives back exactly the text, white space and
all. Defined cases: null gives null, an empty text no pieces; texts of any
length are encoded whole; repeated rows and other columns are left alone.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

from mdlake.llm import _kernel as k
from mdlake.llm._shared import bounded_batches

MARK = "▁"
#: Offset of Zipf's law for the ranks of a BPE file.
RANK_OFFSET = 100
#: Parts whose pieces a worker remembers, in each of two generations.
MEMO_PARTS = 150_000


class PieceCoder:
    """Encodes and decodes with the pieces of one model file, and its scores as
    they are (``file``) or as log probabilities where they are ranks (``likely``)."""

    def __init__(self, path: str, scores: str = "file"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no pieces for bytes")
        text = {i: model.id_to_piece(i) for i in normal}
        if any(MARK in t.lstrip(MARK) for t in text.values()):
            raise ValueError("a piece has a space within it")
        score = {i: model.get_score(i) for i in normal}
        if scores == "likely" and all(s.is_integer() for s in score.values()):
            score = {i: -math.log(RANK_OFFSET - s) for i, s in score.items()}
        self.automaton = ahocorasick.Automaton()
        for i, t in text.items():
            self.automaton.add_word(t, (len(t), i, score[i]))
        self.automaton.make_automaton()
        self.letters = frozenset("".join(text.values()))
        #: As much below every piece as the library's penalty for unknown characters.
        self.unknown = min(score.values()) - 10.0
        raw = [b""] * len(ids)
        for i, t in text.items():
            raw[i] = t.replace(MARK, " ").encode("utf-8")
        for b, i in self.bytes.items():
            raw[i] = bytes([b])
        self.flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.length = np.array([len(r) for r in raw], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        """Identifiers of the pieces of a text, int32."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        # Spaces become marks part by part; a mark of the text itself is kept apart as a control character.
        parts = _PARTS.findall(" " + text)
        memo, older = self.memo, self.older
        found = list(map(memo.get, parts))
        if None in found:
            if len(memo) >= MEMO_PARTS:  # a generation: what is still in use moves on
                memo, older = self.memo, self.older = {}, memo
            for i, f in enumerate(found):
                if f is None:
                    part = parts[i]
                    found[i] = f = memo.get(part) or older.get(part) or self.best(part)
                    if len(part) <= 64:
                        memo[part] = f
        return np.frombuffer(b"".join(found), dtype=np.int32)

    def best(self, part: str) -> bytes:
        """The best pieces of one part, as int32 bytes."""
        # A mark of the text becomes a character that neither the part nor a piece has, so that it matches nothing.
        mark = next(c for c in map(chr, range(0x10FFFF, 0, -1)) if c not in part and c not in self.letters) if MARK in part else ""
        s = (part.replace(MARK, mark) if mark else part).replace(" ", MARK)
        n, unknown = len(s), self.unknown
        score = [_NONE] * (n + 1)
        score[0] = 0.0
        back = [(1, -1)] * (n + 1)  # length and identifier of the last piece; -1: bytes
        done, single = 0, False  # positions up to ``done`` are settled; whether a piece is the one character before the next
        for end, (length, piece, value) in self.automaton.iter(s):
            while done < end:  # bytes compete where no piece is a single character
                done += 1
                if not single and score[done - 1] + unknown > score[done]:
                    score[done], back[done] = score[done - 1] + unknown, (1, -1)
                single = False
            c = score[end + 1 - length] + value
            if c > score[end + 1]:
                score[end + 1], back[end + 1] = c, (length, piece)
            if length == 1:
                single = True
        while done < n:
            done += 1
            if not single and score[done - 1] + unknown > score[done]:
                score[done], back[done] = score[done - 1] + unknown, (1, -1)
            single = False
        out, at = [], n
        while at:
            length, piece = back[at]
            if piece >= 0:
                out.append(piece)
            else:
                char = s[at - 1]
                char = MARK if char == mark else " " if char == MARK else char
                out.extend(self.bytes[b] for b in reversed(char.encode("utf-8")))
            at -= length
        return np.array(out[::-1], dtype=np.int32).tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the text that the identifiers spell."""
        if not len(ids):
            return b""
        length = self.length[ids]
        total = np.cumsum(length)
        places = np.repeat(self.start[ids] - (total - length), length) + np.arange(total[-1])
        return self.flat[places].tobytes()[1:]  # without the space that encoding puts first


_NONE = float("-inf")
_PARTS = re.compile(r" +[^ ]*")


@lru_cache(maxsize=2)
def coder(path: str, scores: str = "file") -> PieceCoder:
    return PieceCoder(path, scores)


def encode(text: Column, path: str, scores: str = "likely") -> Column:
    """``array<int>`` of piece identifiers; ``path`` is the model file on the executors."""

    def encoded(texts: pa.Array) -> pa.Array:
        c = coder(path, scores)
        ids = [None if t is None else c.encode(t) for t in (x.as_py() for x in texts)]
        out = pa.array(ids, pa.list_(pa.int32()))
        del ids
        k.release()
        return out

    return F.arrow_udf(encoded, "array<int>").asNondeterministic()(text)


def decode(ids: Column, path: str, scores: str = "likely") -> Column:
    """The texts of arrays of piece identifiers; ``scores`` only names the coder that a worker holds."""

    def decoded(lists: pa.Array) -> pa.Array:
        c = coder(path, scores)
        out = []
        for x in lists:
            out.append(c.decode(x.values.to_numpy()).decode("utf-8", "replace") if x.is_valid else None)
        return pa.array(out, pa.string())

    return F.arrow_udf(decoded, "string").asNondeterministic()(ids)


def encoded(docs, path: str, text: str = "text"):
    """``docs`` without its text, with ``piece_ids``, ``n_pieces`` and
    ``round_trip``: whether decoding gives back exactly the text. They replace
    columns of these names."""
    others = [c for c in docs.columns if c not in (text, "piece_ids", "n_pieces", "round_trip")]
    names = [f"in_{i}" for i in range(len(others))]
    rows = bounded_batches(docs).select(*[F.col(f"`{c}`").alias(n) for c, n in zip(others, names, strict=True)], _coded(F.col(text), path).alias("coded"))
    return rows.select(
        *[F.col(n).alias(c) for c, n in zip(others, names, strict=True)],
        F.col("coded.ids").alias("piece_ids"),
        F.coalesce(F.size("coded.ids"), F.lit(0)).cast("long").alias("n_pieces"),
        F.col("coded.same").alias("round_trip"),
    )


def _coded(text: Column, path: str, scores: str = "likely") -> Column:
    """``struct<ids, same>``: the pieces, and whether they decode to the text. One
    function for both, so that a task holds one coder."""

    def coded(texts: pa.Array) -> pa.Array:
        c = coder(path, scores)
        ids, same = [], []
        for t in (x.as_py() for x in texts):
            found = None if t is None else c.encode(t)
            ids.append(found)
            same.append(t is None or c.decode(found) == t.encode("utf-8"))
        out = pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], names=["ids", "same"])
        del ids
        k.release()
        return out

    return F.arrow_udf(coded, "struct<ids:array<int>,same:boolean>").asNondeterministic()(text)
