"""Benchmark decontamination by winnowing.

Text and items become words (`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became a-z). A window is
``WINDOW`` item words in a row; an item of fewer words is one window. For windows of m words, k is
half of m, rounded up, and of every m - k + 1 neighbouring k-grams the smallest hash is kept (the
last one among equals). Two texts that share m words share all k-grams of that span, so they keep
the same one there: no shared window escapes. Fingerprints are joined; at a hit, every window
that can hold the shared k-gram is looked up, and the windows found are the extended hit.

Spark chooses how the joins run from the size of the item side; nothing is collected but the set
of window lengths, at most ``WINDOW`` numbers.

Nulls and edges: a null text has no words. Items without words match nothing; without items every
document is clean. Rows that share a doc_id are told apart by their text; repeated rows give
repeated results. A null doc_id is kept as it is. A null item_id is no item.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import text_key, written
from emberwatch.llm.wordhash import LETTERS_DIGITS, Block, blocks, gram_rows, grams, mix

WINDOW = 10

_U = np.uint64
_Arrow = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _k(m: int) -> int:
    return (m + 1) // 2


def _marked(values: np.ndarray, m: int) -> np.ndarray:
    """Hashes of one window length never equal those of another."""
    return mix(values ^ _U(m * 0x9E3779B1)).view(np.int64)


def _winnowed(block: Block, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that the windows of ``m`` words keep."""
    k = _k(m)
    places, _ = gram_rows(block, m)
    values = grams(block.words, k)
    best, at = values[places], places
    for step in range(1, m - k + 1):
        other = values[places + step]
        best, at = np.minimum(best, other), np.where(other <= best, places + step, at)
    kept = np.unique(at)
    return kept, _marked(values[kept], m)


def _rows(ids: pa.Array, key: pa.Array, block: Block, places: np.ndarray, m: int, values: np.ndarray) -> pa.RecordBatch:
    """Places become places within their row."""
    row = block.row[places]
    at = places - block.starts[row]
    take = pa.array(row + block.first)
    lengths = pa.array(np.full(len(row), m, np.int32))
    return pa.RecordBatch.from_arrays(
        [ids.take(take), key.take(take), lengths, pa.array(at.astype(np.int64)), pa.array(values)],
        names=["doc_id", "key", "m", "place", "hash"],
    )


_FOUND = "doc_id long, key long, m int, place long, hash long"


def _fingerprints(lengths: list[int]) -> _Arrow:
    """Fingerprints of each row, and with m = 0 a row that has its number of words as place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, key = batch.column(0), batch.column(1)
            for block in blocks(batch.column(2), LETTERS_DIGITS):
                n = len(block.counts)
                own = key.slice(block.first, n)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(block.first, n), own, pa.array(np.zeros(n, np.int32)), pa.array(block.counts.astype(np.int64)), own],
                    names=["doc_id", "key", "m", "place", "hash"],
                )
                for m in lengths:
                    places, values = _winnowed(block, m)
                    yield _rows(ids, key, block, places, m, values)

    return run


def _item_rows(windows: bool) -> _Arrow:
    """Per item its windows or its fingerprints, at the item's own window length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for block in blocks(batch.column(1), LETTERS_DIGITS):
                length = np.minimum(block.counts, WINDOW)
                for m in np.unique(length[length > 0]).tolist():
                    if windows:
                        places, _ = gram_rows(block, m)
                        values = _marked(grams(block.words, m)[places], m)
                    else:
                        places, values = _winnowed(block, m)
                    own = length[block.row[places]] == m
                    yield _rows(ids, ids, block, places[own], m, values[own])

    return run


def _windows_at_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows that hold a k-gram which hit; ``hits`` has (m, place) pairs of the row."""
    for batch in batches:
        ids, key, hits = batch.column(0), batch.column(1), batch.column(3)
        for block in blocks(batch.column(2), LETTERS_DIGITS):
            n = len(block.counts)
            lists = hits.slice(block.first, n)
            flat = lists.flatten()
            row = np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets)))
            lengths, places = np.asarray(flat.field("m")), np.asarray(flat.field("place"))
            starts = block.starts
            for m in np.unique(lengths).tolist():
                own = lengths == m
                back = np.arange(m - _k(m) + 1)
                first = (places[own][:, None] - back).ravel()
                of = np.repeat(row[own], len(back))
                fits = (first >= 0) & (first + m <= block.counts[of])
                at = np.unique(starts[of[fits]] + first[fits])
                yield _rows(ids, key, block, at, m, _marked(grams(block.words, m)[at], m))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, key, n_words, windows, item_ids.

    ``windows`` lists (place, m): the windows of m words that occur in an item, from their place
    in the document's words; ``item_ids`` the items (item_id, text) they come from, as sorted
    strings. ``key`` is the text's hash.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL")
    item_windows = written(
        items.mapInArrow(_item_rows(True), _FOUND).select(F.col("doc_id").alias("item_id"), "m", "hash").distinct(), "windows"
    )
    lengths = sorted(r.m for r in item_windows.select("m").distinct().collect())
    item_prints = items.mapInArrow(_item_rows(False), _FOUND).select("hash").distinct().withColumn("hit", F.lit(True))

    prints = docs.mapInArrow(_fingerprints(lengths), _FOUND)
    seen = written(prints.join(item_prints, "hash", "left").filter("m = 0 OR hit").drop("hash", "hit"), "hits")

    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key"))
    hits = seen.filter("m > 0").groupBy(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key"))
    hits = hits.agg(F.collect_set(F.struct("m", "place")).alias("hits"))
    around = docs.join(hits, same).select("doc_id", "key", "text", "hits").mapInArrow(_windows_at_hits, _FOUND).distinct()
    found = written(around.join(item_windows.select("hash").distinct(), "hash", "left_semi"), "found")

    by_doc = [F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key")]
    spans = found.groupBy(*by_doc).agg(F.sort_array(F.collect_set(F.struct("place", "m"))).alias("windows"))
    of_items = found.select("doc_id", "key", "hash").distinct().join(item_windows.select("hash", "item_id"), "hash")
    of_items = of_items.groupBy(*by_doc).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    both = spans.join(of_items.withColumnsRenamed({"hit_id": "i", "hit_key": "k"}), F.col("hit_id").eqNullSafe(F.col("i")) & (F.col("hit_key") == F.col("k")))
    counts = seen.filter("m = 0").select("doc_id", "key", F.col("place").alias("n_words"))
    no_windows = F.array().cast("array<struct<place:bigint,m:int>>")
    return counts.join(both, same, "left").select(
        "doc_id",
        "key",
        "n_words",
        F.coalesce("windows", no_windows).alias("windows"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def words_covered(windows: Column) -> Column:
    """How many words lie in any of the sorted windows."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(state: Column, w: Column) -> Column:
        end = w["place"] + w["m"]
        new = F.greatest(F.lit(0).cast("long"), end - F.greatest(state["end"], w["place"]))
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["n"] + new).alias("n"))

    return F.aggregate(windows, start, step, lambda state: state["n"])


def summary(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Counts and digests of ``contamination``."""
    n_hit = words_covered(F.col("windows"))
    return contamination(docs, items).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.size("windows") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a window of an item."""
    found = contamination(docs, items).filter(F.size("windows") > 0)
    found = found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["_id"]) & (text_key(docs["text"]) == found["_key"]), "left_anti")


ORACLE = r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
doc AS (SELECT doc_id, regexp_extract_all(coalesce(t, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
length AS (SELECT DISTINCT least(len(w), 10) AS m FROM item WHERE len(w) > 0),
item_window AS (SELECT DISTINCT item_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda s: array_to_string(w[s:s + m - 1], ' '))) AS g
                FROM (SELECT item_id, w, least(len(w), 10) AS m FROM item WHERE len(w) > 0)),
doc_window AS (SELECT doc_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda s: {'s': s, 'g': array_to_string(w[s:s + m - 1], ' ')})) AS x
               FROM doc, length WHERE len(w) >= m),
hit AS (SELECT d.doc_id, d.m, d.x.s AS s, i.item_id FROM doc_window d JOIN item_window i ON i.m = d.m AND i.g = d.x.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
