"""Ranked lexical search: accumulators of short lists as one bounded iterator among long lists.

1. Items become sets of terms, and items are taken in blocks of so many terms (one block for all but very
   large query sets). Terms are 64-bit hashes: two terms of a block and the texts fall together with a
   probability of about terms of the block x distinct terms of the texts / 2^64.
2. One pass over the whole texts gives each document's length and the places of its item terms in the
   block's dictionary, with their counts; this table is written. A second one sums documents per term,
   documents and terms; these exact totals of all documents give the weights.
3. Tasks turn their documents into posting lists, shard by shard, with every posting's exact share of the score.
   For each item the short lists are summed term at a time into accumulators. Sorted by document, these are
   one more list with a bound, its largest sum. Then documents are taken in order, in windows: only
   lists whose bounds together can still reach the tenth score lead, whole stretches without a posting of
   these are skipped, and the others are probed, the highest bound first, for documents that can still
   get there.
4. The first ``BEST`` of every task are merged, first in salted groups, then per item.

Spark deals documents out; a task holds one shard and ``BEST`` documents per item. To the driver come an item
block's terms (at most ``BLOCK_TERMS`` and one item more) and as many counts, never documents.

Nulls and edges: a null text has no terms, and neither ranks nor counts as a document; so does one without
terms. Items without terms, or whose terms no document has, return nothing; items equal in id and text
count once, items that share an id but not the text are ranked each. Each document row is a document; equal scores go
by doc_id, a null doc_id last. A null item_id is kept. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import LOWER, UPPER, written
from emberwatch.llm.wordhash import LETTERS_DIGITS, Block, blocks, int64_lists

#: Documents per item.
BEST = 10
#: Terms of the items that are searched for in one go.
BLOCK_TERMS = 1 << 20
#: Postings and documents of a shard, at most (a document more).
SHARD_POSTINGS, SHARD_DOCS = 1 << 22, 1 << 16
#: A list of at most this share of the shard's documents is short.
SHORT_SHARE = 1 / 32
#: Documents that are looked at in one go.
WINDOW = 4096
#: Groups that a task's results are merged in first.
SALTS = 64

_Arrow = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


# ---------------------------------------------------------------- terms


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(1), LETTERS_DIGITS):
            parts = [np.unique(w) for w in np.split(block.words, block.starts[1:])]
            counts = np.array([len(p) for p in parts], np.int64)
            ids = batch.column(0).slice(block.first, len(counts))
            yield pa.RecordBatch.from_arrays([ids, int64_lists(np.concatenate(parts), counts)], names=["item_id", "terms"])


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, the item's distinct terms, and ``item``, a number of its own."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    rows = own.mapInArrow(_distinct_terms, "item_id long, terms array<long>").filter(F.size("terms") > 0)
    return written(rows.withColumn("item", F.monotonically_increasing_id()), "items")


class Dictionary:
    """Places of terms in a sorted list, with a table of low bits that turns most other words away."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.mask = np.uint64((1 << max(10, (16 * len(terms)).bit_length())) - 1)
        self.low = np.zeros(int(self.mask) + 1, bool)
        self.low[terms & self.mask] = True

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are terms, and the places of these."""
        maybe = np.flatnonzero(self.low[words & self.mask])
        at = np.searchsorted(self.terms, words[maybe])
        found = self.terms[np.minimum(at, len(self.terms) - 1)] == words[maybe]
        return maybe[found], at[found]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


_POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"


def _postings(terms: np.ndarray) -> _Arrow:
    """Each document's number of terms, and which terms of the dictionary it has, how often."""

    def of(block: Block, dictionary: Dictionary) -> tuple[pa.Array, pa.Array]:
        at, term = dictionary.find(block.words)
        pairs, tf = np.unique(block.row[at] * len(terms) + term, return_counts=True)
        counts = np.bincount(pairs // len(terms), minlength=len(block.counts))
        return _lists(pairs % len(terms), counts), _lists(tf, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = Dictionary(terms)
        for batch in batches:
            for block in blocks(batch.column(1), LETTERS_DIGITS):
                ids = batch.column(0).slice(block.first, len(block.counts))
                found = pa.RecordBatch.from_arrays([ids, pa.array(block.counts.astype(np.int64)), *of(block, dictionary)], names=_NAMES)
                yield found.filter(pa.array(block.counts > 0))

    return run


_NAMES = ["doc_id", "n", "terms", "tfs"]


def _flat(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten())


def _totals(n_terms: int) -> _Arrow:
    """One task's documents per term, and under the places after the last term its documents and its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            total[:n_terms] += np.bincount(_flat(batch.column(1)), minlength=n_terms)
            total[n_terms] += batch.num_rows
            total[n_terms + 1] += np.asarray(batch.column(0)).sum()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["place", "n"])

    return run


def _weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# ---------------------------------------------------------------- search


@dataclass
class Query:
    """What all tasks of a block need: weights per term, each item's terms, and the totals."""

    weights: np.ndarray
    items: np.ndarray
    offsets: np.ndarray
    terms: np.ndarray
    n_docs: int
    n_terms: int


@dataclass
class Best:
    """The best documents of an item so far, in order."""

    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    doc_id: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    no_id: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    @property
    def least(self) -> int:
        """A document needs this score to count, and among equal ones its id decides."""
        return int(self.score[-1]) if len(self.score) == BEST else 1

    def add(self, score: np.ndarray, doc_id: np.ndarray, no_id: np.ndarray) -> None:
        score, doc_id, no_id = (np.concatenate(x) for x in ((self.score, score), (self.doc_id, doc_id), (self.no_id, no_id)))
        order = np.lexsort((doc_id, no_id, -score))[:BEST]
        self.score, self.doc_id, self.no_id = score[order], doc_id[order], no_id[order]


@dataclass
class PostingList:
    """Documents in order, their shares of the score, and the largest share."""

    docs: np.ndarray
    shares: np.ndarray
    bound: int
    at: int = 0

    def next_doc(self) -> int | None:
        return int(self.docs[self.at]) if self.at < len(self.docs) else None


class Shard:
    """Posting lists of some documents, by term."""

    def __init__(self, query: Query, rows: list[tuple[np.ndarray, ...]]):
        ids, no_id, n, counts, terms, tfs = (np.concatenate(x) for x in zip(*rows))
        self.ids, self.no_id, self.n_docs = ids, no_id, len(ids)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
        order = np.argsort(terms, kind="stable")
        terms, self.docs, tfs = terms[order], doc[order], tfs[order].astype(np.int64)
        m = 10 + (90 * n * query.n_docs) // query.n_terms
        self.shares = query.weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[self.docs]))
        self.present, self.starts = np.unique(terms, return_index=True)
        self.ends = np.append(self.starts[1:], len(terms))
        self.bounds = np.maximum.reduceat(self.shares, self.starts) if len(terms) else self.shares

    def lists(self, terms: np.ndarray) -> list[PostingList]:
        """The lists of these terms that can add to a score."""
        if not len(self.present):
            return []
        at = np.searchsorted(self.present, terms)
        at = at[self.present[np.minimum(at, len(self.present) - 1)] == terms] if len(at) else at
        at = at[self.bounds[at] > 0]
        return [PostingList(self.docs[s:e], self.shares[s:e], int(b)) for s, e, b in zip(self.starts[at], self.ends[at], self.bounds[at])]


def accumulated(lists: list[PostingList]) -> PostingList:
    """Term at a time: the lists summed into one."""
    docs = np.concatenate([x.docs for x in lists])
    order = np.argsort(docs, kind="stable")
    docs, first = np.unique(docs[order], return_index=True)
    shares = np.add.reduceat(np.concatenate([x.shares for x in lists])[order], first)
    return PostingList(docs, shares, int(shares.max()))


def _probed(found: PostingList, docs: np.ndarray) -> np.ndarray:
    """A list's shares for ascending documents, reached by searching; the list goes on behind them."""
    at = found.at + np.searchsorted(found.docs[found.at :], docs)
    found.at = int(at[-1])
    there = np.minimum(at, len(found.docs) - 1)
    return np.where(found.docs[there] == docs, found.shares[there], 0)


def search(shard: Shard, terms: np.ndarray, best: Best) -> None:
    """Adds to ``best`` what the shard has for an item, documents in order, skipping what cannot count."""
    lists = shard.lists(terms)
    short = [x for x in lists if len(x.docs) <= shard.n_docs * SHORT_SHARE]
    lists = [x for x in lists if len(x.docs) > shard.n_docs * SHORT_SHARE]
    if short:
        lists.append(accumulated(short))
    lists.sort(key=lambda x: x.bound)
    below = np.cumsum([0, *(x.bound for x in lists)])
    while True:
        # lists before ``lead`` cannot reach the least score on their own
        lead = int(np.searchsorted(below, best.least, "left")) - 1
        if lead >= len(lists):
            return
        starts = [d for x in lists[lead:] if (d := x.next_doc()) is not None]
        if not starts:
            return
        start = min(starts)
        sums = np.zeros(WINDOW, np.int64)
        for x in lists[lead:]:
            end = x.at + int(np.searchsorted(x.docs[x.at :], start + WINDOW))
            sums[x.docs[x.at : end] - start] += x.shares[x.at : end]
            x.at = end
        docs = np.flatnonzero(sums)
        total = sums[docs]
        for i in range(lead - 1, -1, -1):
            able = total + below[i + 1] >= best.least
            docs, total = docs[able], total[able]
            if not len(docs):
                break
            total = total + _probed(lists[i], docs + start)
        able = total >= best.least
        if able.any():
            docs = docs[able] + start
            best.add(total[able], shard.ids[docs], shard.no_id[docs])


_FOUND = "item long, doc_id long, score long"


def _search(query: Query) -> _Arrow:
    """The best documents of a task for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best() for _ in query.items]

        def flush(rows: list) -> None:
            shard = Shard(query, rows)
            for i, own in enumerate(best):
                search(shard, query.terms[query.offsets[i] : query.offsets[i + 1]], own)

        rows, n_docs, n_postings = [], 0, 0
        for batch in batches:
            ids, n, terms, tfs = batch.columns
            flat = _flat(terms)
            counts = np.diff(np.asarray(terms.offsets))
            rows.append((np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), np.asarray(n), counts, flat, _flat(tfs)))
            n_docs, n_postings = n_docs + batch.num_rows, n_postings + len(flat)
            if n_docs >= SHARD_DOCS or n_postings >= SHARD_POSTINGS:
                flush(rows)
                rows, n_docs, n_postings = [], 0, 0
        if rows:
            flush(rows)
        counts = [len(b.score) for b in best]
        if sum(counts):
            ids = pa.array(np.concatenate([b.doc_id for b in best]), mask=np.concatenate([b.no_id for b in best]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(query.items, counts)), ids, pa.array(np.concatenate([b.score for b in best]))], names=["item", "doc_id", "score"]
            )

    return run


def _firsts(rows: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= BEST)


def _searched(docs: DataFrame, own: pa.Table) -> DataFrame | None:
    """The best documents of one block of items; None where the documents have no term at all."""
    items = np.asarray(own["item"])
    lists = own["terms"].combine_chunks()
    hashes = np.ascontiguousarray(_flat(lists)).view(np.uint64)
    dictionary, places = np.unique(hashes, return_inverse=True)
    offsets = np.concatenate([[0], np.cumsum(np.diff(np.asarray(lists.offsets)))])
    postings = written(docs.mapInArrow(_postings(dictionary), _POSTINGS), "postings")
    counted = postings.select("n", "terms").mapInArrow(_totals(len(dictionary)), "place long, n long")
    counted = counted.groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(dictionary) + 2, np.int64)
    total[np.asarray(counted["place"])] = np.asarray(counted["n"])
    n_docs, n_terms = int(total[-2]), int(total[-1])
    if not n_docs:
        return None
    weights = np.array([_weight(n_docs, int(df)) for df in total[:-2]], np.int64)
    found = postings.mapInArrow(_search(Query(weights, items, offsets, places, n_docs, n_terms)), _FOUND)
    return _firsts(found.withColumn("salt", F.spark_partition_id() % SALTS), ["item", "salt"]).drop("rank", "salt")


def ranked(docs: DataFrame, items: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of each item's best documents."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = item_terms(items)
    n_terms = own.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_blocks = max(1, -(-n_terms // block_terms))
    found = None
    for block in range(n_blocks):
        part = own.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block).select("item", "terms").toArrow()
        hits = _searched(texts, part) if part.num_rows else None
        if hits is not None:
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        return own.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return _firsts(found, ["item"]).join(own.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE = f"""
WITH doc AS (SELECT doc_id, w, len(w) AS n FROM (
       SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_TERM}') AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM doc),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM doc) GROUP BY ALL),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY t),
item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_TERM}')) AS t FROM benchmark WHERE text IS NOT NULL),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
           FROM item JOIN tf USING (t) JOIN weight USING (t), total GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= {BEST}
"""
