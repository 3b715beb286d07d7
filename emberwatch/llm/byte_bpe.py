"""Byte-level BPE: exact merges in linear time, without running the merges.

A piece's bytes are mapped to Latin-1, so the Aho-Corasick trie of the vocabulary gives the longest
token at any place. Two neighbouring tokens are compatible when merging
their joined bytes gives just these two; a row of tokens is the result of the merges exactly when
all neighbours are compatible. So the encoder walks the piece from longest match to longest
match, falls back to shorter prefixes where neighbours are not compatible, and never visits a
place that failed again. Compatibility is worked out from how the tokens split, and remembered.

Most texts need no pattern: no piece ends in front of white space that follows another character
inside it, so a text may be cut in front of each single space and the cuts be remembered as a
whole. Where white space stands in front of a space, the text is left uncut.

Ids travel packed, as little-endian unsigned 32-bit integers; ``id_list`` unpacks them.

Nulls and edges: a null text, as null ids, counts as empty. Special tokens are ordinary text. An id
outside the vocabulary is an error. Other columns pass through untouched.
"""

from __future__ import annotations

import base64
import functools
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries a worker remembers at most, of chunks, of pieces and of pairs; they only save time.
REMEMBERED = 600_000
#: Longer chunks are rare and not remembered.
SHORT = 64
#: Tokens decoded in one go.
BLOCK_TOKENS = 1 << 20


class Vocabulary:
    """Tokens by rank, their prefixes and how each came from two others."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
        self.tokens = {rank: token.decode("latin-1") for rank, token in ranked}
        self.ids = {token: rank for rank, token in self.tokens.items()}
        self.sizes = {rank: len(token) for rank, token in self.tokens.items()}
        #: The longest token that begins a token; -1 where there is none.
        self.shorter: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.trie = ahocorasick.Automaton()
        self.widest = max(self.sizes.values())
        for rank, token in self.tokens.items():
            self.trie.add_word(token, rank)
            self.shorter[rank] = next((i for n in range(len(token) - 1, 0, -1) if (i := self.ids.get(token[:n])) is not None), -1)
        for rank, token in self.tokens.items():
            self._split(rank, token)
        self._pairs: dict[tuple[int, int], bool] = {}

    def _split(self, rank: int, token: str) -> None:
        """The two lower-ranked tokens whose merge is this one; single bytes have none."""
        left = self.shorter[rank]
        while left >= 0:
            right = self.ids.get(token[self.sizes[left] :])
            if right is not None and left < rank and right < rank and self._meet(left, right):
                self.halves[rank] = (left, right)
                self.merged[left, right] = rank
                return
            left = self.shorter[left]

    def _meet(self, left: int, right: int) -> bool:
        """Whether no merge reaches over the border between two tokens.

        Takes the merges of both back, the latest first. A pair at the border that would have
        been merged before the step just taken back rules the two out.
        """
        before = float("inf")
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            left_halves, right_halves = self.halves.get(left), self.halves.get(right)
            if left_halves and (left > right or not right_halves):
                before, left = left, left_halves[1]
            elif right_halves:
                # of equal merges the one further left goes first, so this border still allows its own rank
                before, right = right + 1, right_halves[0]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            known = self._pairs[left, right] = self._meet(left, right)
        return known

    def _longest(self, text: str, place: int) -> int:
        """The longest token at a place; the trie says how far any token could reach."""
        reach, get = text[place : place + self.widest], self.ids.get
        end = self.trie.longest_prefix(reach)
        while (found := get(reach[:end])) is None:
            end -= 1
        return found

    def encode(self, piece: str) -> list[int]:
        """Token ids of one piece."""
        text = piece.encode().decode("latin-1")
        whole = self.ids.get(text)
        if whole is not None:
            return [whole]
        sizes, shorter, pairs, longest = self.sizes, self.shorter, self._pairs, self._longest
        size = len(text)
        failed: set[int] = set()
        found: list[int] = []
        place, token, last = 0, longest(text, 0), -1
        while True:
            end = place + sizes[token]
            if end not in failed:
                fits = last < 0 or pairs.get((last, token))
                if fits is None:
                    fits = self.compatible(last, token)
                if fits:
                    found.append(token)
                    if end == size:
                        return found
                    place, token, last = end, longest(text, end), token
                    continue
            token = shorter[token]
            if token < 0:
                failed.add(place)
                token = found.pop()
                last = found[-1] if found else -1
                place -= sizes[token]


class Remembered(dict):
    """Packed ids by key; works out what it does not hold, and keeps it while there is room."""

    def __missing__(self, key: str) -> bytes | None:
        found = self.work_out(key)
        if len(key) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = found
        return found


class Pieces(Remembered):
    """Packed ids of a piece."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.encode = vocabulary.encode

    def work_out(self, piece: str) -> bytes:
        ids = self.encode(piece)
        return struct.pack(f"<{len(ids)}I", *ids)


class Chunks(Remembered):
    """Packed ids of what stands between two spaces, together with the first one.

    None marks a chunk that ends in white space, where a text must not be cut.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        super().__init__()
        self.pieces, self.find = Pieces(vocabulary).__getitem__, regex.compile(pattern).findall

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.pieces, self.find(text)))

    def work_out(self, rest: str) -> bytes | None:
        return None if _ends_in_space(rest) else self.packed(" " + rest)


def _ends_in_space(text: str) -> bool:
    return not text or text[-1].isspace()


class Encoder:
    """Texts to packed ids."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(path)
        self.spaced = Chunks(self.vocabulary, pattern)

    def __call__(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        packed = self.spaced.packed
        if first and _ends_in_space(first):
            return packed(text)
        try:
            return packed(first) + b"".join(map(self.spaced.__getitem__, rest))
        except TypeError:
            return packed(text)


@functools.cache
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@functools.cache
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with open(path, "rb") as lines:
        tokens = {int(rank): base64.b64decode(token).decode("latin-1") for token, rank in map(bytes.split, lines)}
    lengths = np.zeros(max(tokens) + 1, np.int64)
    for rank, token in tokens.items():
        lengths[rank] = len(token)
    data = np.frombuffer("".join(tokens[rank] for rank in sorted(tokens)).encode("latin-1"), np.uint8)
    return data, np.cumsum(lengths) - lengths, lengths


def _decoded(packed: bytes, path: str) -> bytes:
    data, begins, lengths = _token_bytes(path)
    ids = np.frombuffer(packed, "<u4")
    if len(ids) and (int(ids.max()) >= len(lengths) or not lengths[ids].all()):
        raise ValueError("an id outside the vocabulary")
    parts = []
    for i in range(0, len(ids), BLOCK_TOKENS):
        own = ids[i : i + BLOCK_TOKENS]
        sizes = lengths[own]
        first = np.cumsum(sizes) - sizes
        parts.append(data[np.repeat(begins[own] - first, sizes) + np.arange(int(sizes.sum()))].tobytes())
    return b"".join(parts)


def encode(text: Column, path: str, pattern: str) -> Column:
    """Packed token ids of a text; ``pattern`` splits it, each match is merged by itself."""

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        encoder = _encoder(path, pattern)
        return pa.array([encoder(t.as_py() or "") for t in texts], pa.binary())

    return packed(text)


def decode(ids: Column, path: str) -> Column:
    """The bytes that packed ids stand for."""

    @F.arrow_udf("binary")
    def unpacked(packed: pa.Array) -> pa.Array:
        return pa.array([_decoded(p.as_py() or b"", path) for p in packed], pa.binary())

    return unpacked(ids)


def id_list(ids: Column) -> Column:
    """Packed ids as an array of integers."""

    @F.arrow_udf("array<int>")
    def listed(packed: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(p.as_py() or b"", "<u4").astype(np.int32) for p in packed], pa.list_(pa.int32()))

    return listed(ids)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, packed ``ids`` and the ``decoded`` bytes of each row of ``docs`` (doc_id, text)."""
    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), encode(F.col("text").cast("string"), path, pattern).alias("ids"))
    return coded.withColumn("decoded", decode(F.col("ids"), path))


def summary(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Counts and digests of ``round_trip``, if asked with the packed ids."""
    return round_trip(docs, path, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(["ids"] if with_ids else []),
    )
