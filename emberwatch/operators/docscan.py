"""Signature conditions on a text or binary column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.functions.text import base64_offset_literals, quote_regex
from emberwatch.operators.predicates import any_of


def strings_found(text: Column, strings: list[str]) -> Column:
    """How many strings of the set occur."""
    total = F.lit(0)
    for s in strings:
        total = total + text.contains(s).cast("int")
    return total


def any_string(text: Column, strings: list[str]) -> Column:
    return strings_found(text, strings) >= 1


def all_strings(text: Column, strings: list[str]) -> Column:
    return strings_found(text, strings) == len(strings)


def n_strings(text: Column, strings: list[str], n: int) -> Column:
    return strings_found(text, strings) >= n


def nocase(text: Column, string: str) -> Column:
    return F.lower(text).contains(string.lower())


def fullword(text: Column, string: str) -> Column:
    """The string with no letter or digit on either side."""
    return text.contains(string) & text.rlike(f"(^|[^A-Za-z0-9]){quote_regex(string)}([^A-Za-z0-9]|$)")


def regex(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def at(text: Column, string: str, offset: int) -> Column:
    return F.substring(text, offset + 1, len(string)) == string


def in_range(text: Column, string: str, first: int, last: int) -> Column:
    """The string starts at an offset within [first, last]."""
    return F.substring(text, first + 1, last - first + len(string)).contains(string)


def count_of(text: Column, string: str) -> Column:
    return F.regexp_count(text, F.lit(quote_regex(string)))


def size_of(text: Column) -> Column:
    return F.octet_length(text)


def magic(content: Column, hex_prefix: str) -> Column:
    return F.substring(content, 1, len(hex_prefix) // 2) == F.unhex(F.lit(hex_prefix))


def encoded_forms(literal: str) -> dict[str, list[str]]:
    """Hex forms of a literal: wide, and base64 at every offset."""
    return {
        "wide": [literal.encode("utf-16-le").hex().upper()],
        "base64": [f.encode().hex().upper() for f in base64_offset_literals(literal.encode())],
    }


def xor_places(content: Column, literal: str) -> Column:
    """Every place where the literal stands xored with one byte, plain text included as key 0: array<struct<at, key>>.

    The xor of neighbouring bytes is the same under every key, so one search for the literal's own
    neighbour xors replaces one search per key; the first byte then tells the key. The literal has two bytes or more.
    """
    wanted = np.frombuffer(literal.encode(), np.uint8)
    if len(wanted) < 2:
        raise ValueError("a literal of one byte is found under some key at every place")
    difference = (wanted[1:] ^ wanted[:-1]).tobytes()

    @F.arrow_udf("array<struct<at:int,key:int>>")
    def places(contents: pa.Array) -> pa.Array:
        column = contents.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        cuts = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        rows, at, keys = [], [], []
        for row in range(len(column)):
            own = data[cuts[row] : cuts[row + 1]]
            steps = (own[1:] ^ own[:-1]).tobytes()
            place = steps.find(difference)
            while place >= 0:
                rows.append(row)
                at.append(place)
                keys.append(int(own[place] ^ wanted[0]))
                place = steps.find(difference, place + 1)
        counts = np.bincount(np.array(rows, np.int64), minlength=len(column)) if rows else np.zeros(len(column), np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        found = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(keys, pa.int32())], names=["at", "key"])
        return pa.ListArray.from_arrays(pa.array(ends), found)

    return F.when(content.isNotNull(), places(content))


def xor_keys(content: Column, literal: str, keys: range = range(1, 256)) -> Column:
    """The keys, of those asked for, under which the literal stands in the bytes, in order."""
    found = F.array_sort(F.array_distinct(F.transform(xor_places(content, literal), lambda p: p["key"])))
    return F.filter(found, lambda k: (k >= keys.start) & (k < keys.stop))


@F.arrow_udf(T.BinaryType())
def xored(contents: pa.Array, keys: pa.Array) -> pa.Array:
    """Bytes xored with a key of their row, which decodes what is encoded so."""
    pairs = zip(contents, keys)
    mixed = [None if c.as_py() is None or k.as_py() is None else (np.frombuffer(c.as_py(), np.uint8) ^ np.uint8(k.as_py())).tobytes() for c, k in pairs]
    return pa.array(mixed, pa.binary())


def encoded(content: Column, literal: str, forms: list[str], keys: range = range(1, 256)) -> Column:
    """Any of the chosen encoded forms, ``wide``, ``base64`` and ``xor``, occurs in the bytes.

    Forms are compared as bytes, so a hit never straddles two bytes.
    """
    known = encoded_forms(literal)
    tests = [content.contains(F.unhex(F.lit(h))) for name in forms if name != "xor" for h in known[name]]
    return any_of(tests + [F.size(xor_keys(content, literal, keys)) > 0] * ("xor" in forms))


#: Bytes whose places are counted in one go.
_BLOCK = 4 << 20


@F.arrow_udf(T.DoubleType())
def entropy(contents: pa.Array) -> pa.Array:
    """Shannon entropy of the bytes in bits; one histogram over (row, byte) for many rows at once."""
    column = contents.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    bits = np.zeros(len(column))
    first = 0
    while first < len(column):
        last = max(int(np.searchsorted(cuts, cuts[first] + _BLOCK, "right")) - 1, first + 1)
        last = min(last, len(column), first + 4096)
        sizes = np.diff(cuts[first : last + 1])
        row = np.repeat(np.arange(last - first) * 256, sizes)
        counts = np.bincount(row + data[cuts[first] : cuts[last]], minlength=256 * (last - first)).reshape(-1, 256)
        share = counts / np.maximum(sizes, 1)[:, None]
        bits[first:last] = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1) + 0.0
        first = last
    return pa.array(bits, mask=np.asarray(contents.is_null()))


def hash_match(documents: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """Documents whose SHA-256 is in the known list."""
    hashed = documents.withColumn("sha256", F.sha2(F.col(text), 256))
    return hashed.join(known.select("sha256").distinct(), "sha256", "left_semi")
