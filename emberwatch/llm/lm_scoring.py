"""Cross-entropy difference: how much better a target model reads a document than a background model.

Both models are word bigrams over one vocabulary, counted over all documents: the target model over
those labelled as target, the background model over all others. With V words, the loss of w after v is

    -log((count(v, w) + ALPHA) / (count(v) + ALPHA * V))

A document's score is its loss under the target model less that under the background model, per
token; lower is closer to the target. Each document is left out of the counts that it is scored by.
Words are those of the near-duplicate operator, and the first one follows a begin mark.

The loss is a sum over the document's bigrams and their contexts, so each n-gram can be counted and
applied by itself:

* n-grams that many documents have are found first. They are at most ``HOT_KEYS``, so their counts
  are one small table: summed from one number per block of texts, and applied where the texts are read.
* All others go, packed per block of texts, to the bucket of their hash. A bucket has all
  occurrences of its n-grams, so it counts them and gives back a sum per document, block by block.
  No n-gram here is in more than a small share of the documents.

What moves are 5 bytes per n-gram and document; a bucket adds its own bits to the hash. Blocks are
cut from sorted partitions, so a task that runs again makes the same blocks.

V is an approximate distinct count over all documents (relative deviation ``VOCABULARY_RSD``).

Nulls and edges: a null or blank text has no tokens and a null score. A null label, or none, is
background. Rows that share a doc_id are told apart by their text; rows equal in both are scored
alike, as one document with twice the counts. Of two labels of one doc_id the target one counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from emberwatch.llm.common import text_key, written
from emberwatch.llm.wordhash import NOT_SPACE, Block, blocks, mix

ALPHA = 0.01
VOCABULARY_RSD = 0.01
#: N-grams that are treated as frequent: the most frequent ones, in at least this share of documents.
HOT_KEYS = 100_000
HOT_SHARE = 1 / 256
#: Bits of a hash that travel; the bucket is made from the others.
KEY_BITS = 40

_U = np.uint64
_BEGIN = _U(0x1F83D9ABFB41BD6B)
_Arrow = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _ngrams(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, n-gram) pairs: rows, keys, occurrences, and whether the key is a context."""
    words = block.words
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[block.starts[block.counts > 0]] = _BEGIN
    pairs = mix(mix(before) * _U(0xA0761D6478BD642F) + words) & ~_U(1)
    contexts = mix(before) | _U(1)
    rows = np.tile(block.row, 2)
    keys = np.concatenate([pairs, contexts])
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    return rows[first], keys[first], np.diff(first, append=len(keys)), (keys[first] & _U(1)).astype(bool)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block its distinct words (n = 0), and the n-grams that several of its texts have, with how many."""
    for batch in batches:
        for block in blocks(batch.column(0), NOT_SPACE):
            _, keys, _, _ = _ngrams(block)
            keys, n = np.unique(keys, return_counts=True)
            often = n >= max(3, len(block.counts) * HOT_SHARE)
            words = np.unique(block.words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([words, keys[often]]).view(np.int64)),
                    pa.array(np.concatenate([np.zeros(len(words), np.int64), n[often]])),
                ],
                names=["key", "n"],
            )


def _packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


_SENT = "block long, bucket int, keys binary, ends binary, counts binary, rows binary, hot_at binary, hot_n binary, ids binary, texts binary, tokens binary"
_SENT_NAMES = [c.split()[0] for c in _SENT.split(", ")]


def _find(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The place of each key in a sorted table, -1 where it is not."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _deal(hot: np.ndarray, buckets: int) -> _Arrow:
    """Per block a row per bucket that it has something for: the n-grams of its texts, and of the hot ones how many there are.

    ``rows`` has, for each n-gram, twice its text's place in the block, and one more in a target text.
    """
    of_hot = ((hot >> _U(KEY_BITS)) % _U(buckets)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = np.asarray(batch.column(0).fill_null(0)), np.asarray(batch.column(1))
            target = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            for block in blocks(batch.column(3), NOT_SPACE):
                n = len(block.counts)
                own = slice(block.first, block.first + n)
                rows, keys, counts, _ = _ngrams(block)
                at = _find(keys, hot)
                is_hot = at >= 0
                by_side = np.bincount(at[is_hot] * 2 + target[own][rows[is_hot]], counts[is_hot], 2 * len(hot)).astype(np.int64)
                some = np.flatnonzero(by_side)
                some = some[np.argsort(of_hot[some // 2], kind="stable")]
                hot_edges = np.searchsorted(of_hot[some // 2], np.arange(buckets + 1))
                rows, keys, counts = rows[~is_hot], keys[~is_hot], counts[~is_hot].astype(np.int32)
                bucket = ((keys >> _U(KEY_BITS)) % _U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                rows, keys, counts = rows[order], keys[order], counts[order]
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                used = np.flatnonzero((np.diff(edges) > 0) | (np.diff(hot_edges) > 0))
                # one row, if need be an empty one, names the block's texts
                for b in used if len(used) else [0]:
                    part, own_hot = slice(edges[b], edges[b + 1]), some[hot_edges[b] : hot_edges[b + 1]]
                    more = {}
                    if not len(used) or b == used[0]:
                        more = {"ids": ids[own], "texts": texts[own], "tokens": block.counts.astype(np.int64)}
                    yield _sent(
                        number,
                        b,
                        keys=keys[part].astype(np.uint32),
                        ends=(keys[part] >> _U(32)).astype(np.uint8),
                        counts=counts[part],
                        rows=(rows[part] * 2 + target[own][rows[part]]).astype(np.int32),
                        hot_at=own_hot,
                        hot_n=by_side[own_hot],
                        **more,
                    )
                number += 1

    return run


def _sent(block: int, bucket: int, **parts: np.ndarray) -> pa.RecordBatch:
    packed = [pa.array([_packed(parts[c]) if c in parts else None], pa.binary()) for c in _SENT_NAMES[2:]]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), *packed], names=_SENT_NAMES)


def _difference(context: np.ndarray, target: np.ndarray, other: np.ndarray, vocabulary: float) -> np.ndarray:
    """What one occurrence adds to the loss difference, given both counts."""
    mass = np.where(context, ALPHA * vocabulary, ALPHA)
    return np.where(context, 1.0, -1.0) * (np.log(target + mass) - np.log(other + mass))


_SUMS = "block long, rows binary, sums binary, hot_at binary, hot_n binary, ids binary, texts binary, tokens binary"


def _bucket_sums(vocabulary: float) -> Callable[[pa.Table], pa.Table]:
    """All n-grams of a bucket: counts over all blocks, then a sum for each text of a block that has any.

    The last row of the result has the counts of the bucket's hot n-grams.
    """

    def run(table: pa.Table) -> pa.Table:
        get = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
        places = get("rows", np.int32)
        block = np.repeat(np.arange(len(places)), [len(x) for x in places])
        keys = np.concatenate(get("keys", np.uint32)).astype(_U) | np.concatenate(get("ends", np.uint8)).astype(_U) << _U(32)
        counts = np.concatenate(get("counts", np.int32)).astype(np.float64)
        place = np.concatenate(places)
        own = (place & 1).astype(bool)
        values, at = np.unique(keys, return_inverse=True)
        of_target = np.bincount(at, np.where(own, counts, 0), len(values))[at]
        of_other = np.bincount(at, np.where(own, 0, counts), len(values))[at]
        gain = _difference((keys & _U(1)).astype(bool), of_target - np.where(own, counts, 0), of_other - np.where(own, 0, counts), vocabulary)
        # places ascend within a block, so the n-grams of a text are neighbours
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        sums = np.add.reduceat(gain * counts, first) if len(first) else np.zeros(0)
        cuts = np.searchsorted(block[first], np.arange(1, len(places)))
        packed = [[_packed(x) for x in np.split(values, cuts)] for values in (place[first] >> 1, sums)]
        hot, at = np.unique(np.concatenate(get("hot_at", np.int64)), return_inverse=True)
        hot_n = np.bincount(at, np.concatenate(get("hot_n", np.int64)), len(hot)).astype(np.int64)
        last = {"block": [-1], "hot_at": [_packed(hot)], "hot_n": [_packed(hot_n)]}
        rest = ("ids", "texts", "tokens")
        nothing = [None] * len(places)
        rows = {"block": table.column("block").to_pylist(), "rows": packed[0], "sums": packed[1], "hot_at": nothing, "hot_n": nothing}
        rows |= {c: table.column(c).to_pylist() for c in rest}
        kinds = pa.schema([(c, pa.int64() if c == "block" else pa.binary()) for c in rows])
        return pa.table({c: v + last.get(c, [None]) for c, v in rows.items()}, schema=kinds)

    return run


_SCORED = "doc_id long, key long, n_tokens long, rare double"


def _block_sums(table: pa.Table) -> pa.Table:
    """The sums of a block's rows over all buckets."""
    ids, texts, tokens = (next(np.frombuffer(x, np.int64) for x in table.column(c).to_pylist() if x is not None) for c in ("ids", "texts", "tokens"))
    total = np.zeros(len(ids))
    for rows, sums in zip(*(table.column(c).to_pylist() for c in ("rows", "sums")), strict=True):
        total[np.frombuffer(rows, np.int32)] += np.frombuffer(sums)
    return pa.table({"doc_id": ids, "key": texts, "n_tokens": tokens, "rare": total})


def _hot_sums(hot: np.ndarray, of_target: np.ndarray, of_other: np.ndarray, vocabulary: float) -> _Arrow:
    """What the hot n-grams add for each text, as if it were a target document, and if not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2), NOT_SPACE):
                n = len(block.counts)
                rows, keys, counts, context = _ngrams(block)
                at = _find(keys, hot)
                own = at >= 0
                rows, at, counts, context = rows[own], at[own], counts[own], context[own]
                sums = [
                    np.bincount(rows, counts * _difference(context, np.maximum(of_target[at] - a, 0), np.maximum(of_other[at] - b, 0), vocabulary), n).astype(np.float64)
                    for a, b in ((counts, 0), (0, counts))
                ]
                named = [batch.column(i).slice(block.first, n) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*named, *map(pa.array, sums)], names=["doc_id", "key", "as_target", "as_other"])

    return run


def scored(docs: DataFrame, labels: DataFrame, vocabulary: float | None = None) -> DataFrame:
    """doc_id, n_tokens and score of each row of ``docs`` (doc_id, text); target are the doc_ids of ``labels`` with quality 1.

    ``vocabulary`` is V; without it, V is counted.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    # a null id travels as a negative number that no id has
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    docs = docs.select(doc_id.alias("doc_id"), text_key(text).alias("key"), text.alias("text"))
    target = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("target", F.lit(True))

    n_docs = docs.count()
    if not n_docs:
        return spark.createDataFrame([], "doc_id long, n_tokens long, score double")
    seen = Observation()
    survey = docs.select("text").mapInArrow(_survey, "key long, n long")
    survey = survey.observe(seen, F.approx_count_distinct(F.when(F.col("n") == 0, F.col("key")), VOCABULARY_RSD).alias("words"))
    often = written(survey.filter("n > 0"), "often").groupBy("key").agg(F.sum("n").alias("n"))
    rows = often.filter(F.col("n") >= max(3.0, n_docs * HOT_SHARE)).orderBy(F.desc("n"), "key").limit(HOT_KEYS).select("key").toPandas()
    hot = np.sort(rows["key"].to_numpy(np.int64).view(_U))
    vocabulary = float(vocabulary or seen.get["words"])

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # texts and labels meet by doc_id at every size: the blocks below stand on sorted partitions
    flagged = docs.join(target.hint("merge"), "doc_id", "left").select("doc_id", "key", F.coalesce("target", F.lit(False)).alias("target"), "text")
    sent = flagged.sortWithinPartitions("doc_id", "key").mapInArrow(_deal(hot, buckets), _SENT)
    sums = written(sent.groupBy("bucket").applyInArrow(_bucket_sums(vocabulary), _SUMS), "sums")

    # at most two numbers for each hot n-gram
    sides = sums.filter("block = -1").select("hot_at", "hot_n").mapInArrow(_hot_counts, "side long, n long").toPandas()
    both = np.zeros(2 * len(hot))
    both[sides["side"].to_numpy(np.int64)] = sides["n"].to_numpy(np.float64)
    hot_sums = docs.mapInArrow(_hot_sums(hot, both[1::2], both[0::2], vocabulary), "doc_id long, key long, as_target double, as_other double")
    rare = sums.filter("block >= 0").drop("hot_at", "hot_n").groupBy("block").applyInArrow(_block_sums, _SCORED)
    # repeated rows are equal on both sides
    joined = rare.join(hot_sums.dropDuplicates(["doc_id", "key"]), ["doc_id", "key"]).join(target, "doc_id", "left")
    total = F.col("rare") + F.when(F.col("target"), F.col("as_target")).otherwise(F.col("as_other"))
    return joined.select(
        F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias("doc_id"),
        "n_tokens",
        F.when(F.col("n_tokens") > 0, F.round(total / F.col("n_tokens"), 9)).alias("score"),
    )


def _hot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (keys, counts)], names=["side", "n"])
