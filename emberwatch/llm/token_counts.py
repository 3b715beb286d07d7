"""Token counts of a unigram tokenizer, by a Viterbi pass that keeps no path.

A text is cut in front of each run of spaces, which no vocabulary piece reaches over; the best path
of the text is that of its chunks in a row. In a chunk the Aho-Corasick automaton names, place by
place, all pieces that end there, the longest first; dynamic programming carries the best score to
each place and the number of pieces on that path, nothing else.

The tie rules are those of the tokenizer: of paths with equal scores to one place the one whose last
piece began first stays; a character that is no piece itself may also be left unknown, at the
lowest score less ``UNKNOWN_PENALTY``, and that is tried last. With byte fallback an unknown character counts as
its UTF-8 bytes, else a run of them as one piece.

Chunks' counts are remembered per worker, up to ``REMEMBERED`` of them; a long chunk is worked out
each time, in memory that follows its length.

The vocabulary is read from a sentencepiece model file: pieces, scores, unknown id, byte fallback and
the leading space. The box has no unigram model, so the query reads ``piece_bpe_32k.model`` as one.

Nulls and edges: a null or empty text has no tokens. Repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN_PENALTY = 10.0
SPACE = "▁"

#: Chunks a worker remembers at most; it only saves time.
REMEMBERED = 400_000
SHORT = 64

_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Unigram:
    """Pieces with scores; counts the pieces of the best path through a text."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool, leading_space: bool):
        self.byte_fallback, self.leading_space = byte_fallback, leading_space
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.single = {p for p in pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.known: dict[str, int] = {}

    @classmethod
    def from_file(cls, path: str) -> Unigram:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(model.get_piece_size())
        own = {model.id_to_piece(i): model.get_score(i) for i in size if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))}
        leading = model.encode("a", out_type=str)[0].startswith(SPACE)
        return cls(own, any(map(model.is_byte, size)), leading)

    def chunk(self, text: str) -> int:
        """Pieces on the best path through a chunk."""
        ends: list[list[tuple[int, float]]] = [[] for _ in text]
        if len(self.automaton):
            for end, found in self.automaton.iter(text):
                ends[end].append(found)
        scores, counts, unknowns = [0.0], [0], [False]
        for end, c in enumerate(text):
            best, count, unknown = None, 0, False
            for size, score in ends[end]:
                total = scores[end + 1 - size] + score
                if best is None or total > best:
                    best, count = total, counts[end + 1 - size] + 1
            if c not in self.single:
                total = scores[end] + self.unknown
                if best is None or total > best:
                    best, unknown = total, True
                    if self.byte_fallback:
                        count = counts[end] + len(c.encode())
                    else:
                        count = counts[end] + (not unknowns[end])
            scores.append(best)
            counts.append(count)
            unknowns.append(unknown)
        return counts[-1]

    def count(self, text: str) -> int:
        """Pieces of a whole text."""
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        if self.leading_space:
            text = SPACE + text
        total, known = 0, self.known
        for chunk in _CHUNK.findall(text):
            count = known.get(chunk)
            if count is None:
                count = self.chunk(chunk)
                if len(chunk) <= SHORT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[chunk] = count
            total += count
        return total


@functools.cache
def _unigram(path: str) -> Unigram:
    return Unigram.from_file(path)


def n_tokens(text: Column, path: str) -> Column:
    """The number of tokens of a text under the vocabulary in ``path``."""

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        count = _unigram(path).count
        return pa.array(np.fromiter((count(t.as_py() or "") for t in texts), np.int64, len(texts)))

    return counted(text)


def counted(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_chars and n_tokens of each row of ``docs`` (doc_id, text)."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_chars"),
        n_tokens(text, path).alias("n_tokens"),
    )
