"""Hard negatives by Four-Russians scoring: exact inner products from subset-sum tables and bit planes.

1. Vectors are whole numbers per component. Rows are packed into blocks; of a block, bit k of eight
   neighbouring components of every row is one byte, so a block is a set of packed bit planes.
2. For each anchor and each group of eight components, a table has the sum of every subset of the anchor's
   eight numbers. A candidate's plane byte is the index into it; the looked-up sums of all groups are
   added, and planes are put together by shifting (the highest plane, the sign, counts negative). The
   result is the exact inner product.
3. Anchor blocks meet every candidate block, and each meeting keeps the first rows only: in the first pass an
   anchor's nearest rows of its label, its positives, and in the second the nearest rows of other labels
   whose score lies in the positive's band. The first of all blocks are then picked in Spark.

Candidates are moved once per pass; anchors are copied to every candidate block. A meeting holds one block
of either kind, whatever the table's size, and returns a bounded number of rows per anchor. Only two counts
come to the driver.

Nulls and edges: rows with a null id, label or vector, or with a null or non-finite component, take no part.
Shorter vectors count as filled up with zeros. Each anchor row has results of its own; rows
with the anchor's id are not "other" rows, all other repeated rows are. Components beyond 64 bits
saturate, and sums wrap as 64-bit numbers do. An empty table has no anchors. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import written

#: A component x becomes ``floor(SCALE * x)``.
SCALE = 256
#: Candidates in a block, at most, and blocks, at least, so that small tables too are many tasks.
BLOCK, LEAST_BLOCKS = 1 << 15, 16
#: Anchors in a block, and anchors scored in one go.
ANCHORS, AT_ONCE = 1024, 64

_Arrow = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def whole_numbers(rows: DataFrame) -> DataFrame:
    """vec_id, label and ``codes``, the components as whole numbers; rows that cannot take part go."""
    x = F.col("embedding").cast("array<double>")
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(x, odd)
    codes = F.transform(x, lambda v: F.floor(v * SCALE).cast("long"))
    return rows.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), codes.alias("codes"))


# ---------------------------------------------------------------- blocks


def _matrix(lists: list[pa.Array]) -> np.ndarray:
    """Rows of numbers as one matrix, filled up with zeros to a multiple of eight columns."""
    counts = np.concatenate([np.diff(np.asarray(a.offsets)) for a in lists]) if lists else np.zeros(0, np.int64)
    width = -(-int(counts.max(initial=0)) // 8) * 8
    out = np.zeros((len(counts), max(width, 8)), np.int64)
    values = np.concatenate([np.asarray(a.flatten()) for a in lists]) if lists else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)] = values
    return out


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> dict[str, list[pa.Array]]:
    found: dict[str, list[pa.Array]] = {n: [] for n in names}
    for batch in batches:
        for n in names:
            found[n].append(batch.column(batch.schema.get_field_index(n)))
    return found


def _longs(arrays: list[pa.Array]) -> np.ndarray:
    return np.concatenate([np.asarray(a, dtype=np.int64) for a in arrays])


def bit_planes(codes: np.ndarray) -> np.ndarray:
    """Bytes (plane, group, row): bit k of eight neighbouring components, in two's complement, the sign last."""
    low, high = int(codes.min(initial=0)), int(codes.max(initial=0))
    n_bits = max((-low - 1).bit_length() if low < 0 else 0, high.bit_length()) + 1
    groups = codes.reshape(len(codes), -1, 8)
    planes = [np.packbits(((groups >> k) & 1).astype(np.uint8), axis=2)[:, :, 0].T for k in range(n_bits)]
    return np.ascontiguousarray(np.stack(planes))


_CANDIDATES = "block int, ids binary, labels binary, planes binary, n_planes int, n_groups int"


def _pack_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a partition as one block, by ascending id."""
    found = _columns(batches, ["vec_id", "label", "codes"])
    if not sum(len(a) for a in found["vec_id"]):
        return
    ids, labels, codes = _longs(found["vec_id"]), _longs(found["label"]), _matrix(found["codes"])
    order = np.argsort(ids, kind="stable")
    planes = bit_planes(codes[order])
    row = [TaskContext.get().partitionId(), ids[order].tobytes(), labels[order].tobytes(), planes.tobytes(), planes.shape[0], planes.shape[1]]
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES[:6])], names=_names(_CANDIDATES))


_TYPES = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


_ANCHORS = "keys binary, anchor_ids binary, anchor_labels binary, codes binary, width int, positives binary, n_positives int"


def _pack_anchors(most: int) -> _Arrow:
    """Anchors in blocks; ``positives`` has (id, score) of up to ``most`` positives of each, none in the first pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _columns(batches, ["key", "vec_id", "label", "codes"] + ["positives"] * bool(most))
        if not sum(len(a) for a in found["key"]):
            return
        keys, ids, labels, codes = _longs(found["key"]), _longs(found["vec_id"]), _longs(found["label"]), _matrix(found["codes"])
        positives, counts = np.zeros((len(keys), most, 2), np.int64), np.zeros(len(keys), np.int32)
        if most:
            rows = [row for a in found["positives"] for row in a.to_pylist()]
            for i, row in enumerate(rows):
                counts[i] = len(row)
                for p in row:
                    positives[i, p["rank"] - 1] = p["vec_id"], p["score"]
        for a in range(0, len(keys), ANCHORS):
            part = slice(a, a + ANCHORS)
            seen = np.concatenate([positives[part].reshape(len(keys[part]), -1), counts[part, None].astype(np.int64)], axis=1)
            row = [x[part].tobytes() for x in (keys, ids, labels, codes)] + [codes.shape[1], seen.tobytes(), most]
            types = [pa.binary()] * 4 + [pa.int32(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=_names(_ANCHORS))

    return run


# ---------------------------------------------------------------- scores


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(group, byte, anchor): the sum of the components whose bit the byte has; bit 7 is a group's first."""
    groups = anchors.reshape(len(anchors), -1, 8)
    table = np.zeros((groups.shape[1], 1, len(anchors)), anchors.dtype)
    for j in range(7, -1, -1):
        table = np.concatenate([table, table + groups[:, :, j].T[:, None, :]], axis=1)
    return table


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Exact inner products (row, anchor) from subset sums and bit planes, by looking up, shifting and adding."""
    groups = min(len(tables), planes.shape[1])
    total = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    found = np.empty_like(total)
    for k in range(len(planes) - 1, -1, -1):
        total <<= 1
        for g in range(groups):
            np.take(tables[g], planes[k, g], axis=0, out=found, mode="clip")
            total += found
        if k == len(planes) - 1:
            np.negative(total, out=total)
    return total


def _number(anchors: np.ndarray, n_planes: int) -> type:
    """32-bit numbers where no sum, not even of sizes, can leave them."""
    most = float(np.abs(anchors.astype(np.float64)).sum(axis=1).max(initial=0)) * 2.0**n_planes
    return np.int32 if most < 2**31 else np.int64


def _firsts(values: np.ndarray, allowed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and rows of the ``n`` highest allowed values of each anchor; of equal ones the first rows."""
    least = np.iinfo(values.dtype).min
    left = np.where(allowed, values, least)
    of, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    every = np.arange(len(left))
    for _ in range(min(n, left.shape[1])):
        best = left.argmax(axis=1)
        found = left[every, best] > least
        if not found.any():
            break
        of.append(every[found])
        at.append(best[found])
        left[every, best] = least
    return np.concatenate(of), np.concatenate(at)


@dataclass
class _Candidates:
    ids: np.ndarray
    labels: np.ndarray
    planes: np.ndarray


@dataclass
class _Anchors:
    keys: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    codes: np.ndarray
    positives: np.ndarray
    counts: np.ndarray


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Candidates, _Anchors]]:
    """The blocks of each joined row; a candidate block is unpacked once for all anchors it meets."""
    last, candidates = None, None
    for batch in batches:
        get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            at = lambda n: get[n][i].as_py()  # noqa: B023, E731
            longs = lambda n: np.frombuffer(at(n), np.int64)  # noqa: B023, E731
            if at("block") != last:
                last, ids = at("block"), longs("ids")
                planes = np.frombuffer(at("planes"), np.uint8).reshape(at("n_planes"), at("n_groups"), len(ids))
                candidates = _Candidates(ids, longs("labels"), planes)
            keys = longs("keys")
            seen = longs("positives").reshape(len(keys), -1)
            positives = seen[:, :-1].reshape(len(keys), at("n_positives"), 2)
            yield candidates, _Anchors(keys, longs("anchor_ids"), longs("anchor_labels"), longs("codes").reshape(len(keys), -1), positives, seen[:, -1])


_POSITIVES = "key long, vec_id long, score long"


def _positive_search(n: int) -> _Arrow:
    """Per anchor the first ``n`` other rows of its label in each candidate block; other labels are never scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for candidates, anchors in _meetings(batches):
            for label in np.unique(anchors.labels):
                own = np.flatnonzero(candidates.labels == label)
                if not len(own):
                    continue
                ids, planes = candidates.ids[own], np.ascontiguousarray(candidates.planes[:, :, own])
                places = np.flatnonzero(anchors.labels == label)
                for a in range(0, len(places), AT_ONCE):
                    part = places[a : a + AT_ONCE]
                    codes = anchors.codes[part]
                    found = np.ascontiguousarray(scores(subset_sums(codes.astype(_number(codes, len(planes)))), planes).T)
                    of, at = _firsts(found, ids[None, :] != anchors.ids[part][:, None], n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchors.keys[part][of]), pa.array(ids[at]), pa.array(found[of, at].astype(np.int64))], names=_names(_POSITIVES)
                    )

    return run


_NEGATIVES = "key long, anchor_id long, positive_rank int, positive_id long, positive_score long, negative_id long, negative_score long"


def _negative_search(n: int, low: int, high: int) -> _Arrow:
    """Per anchor and positive the first ``n`` rows of other labels in each candidate block with a score in the positive's band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for candidates, anchors in _meetings(batches):
            for a in range(0, len(anchors.keys), AT_ONCE):
                part = slice(a, a + AT_ONCE)
                codes = anchors.codes[part]
                found = np.ascontiguousarray(scores(subset_sums(codes.astype(_number(codes, len(candidates.planes)))), candidates.planes).T)
                other = candidates.labels[None, :] != anchors.labels[part][:, None]
                for p in range(anchors.positives.shape[1]):
                    there = anchors.counts[part] > p
                    score = anchors.positives[part, p, 1]
                    # 100 * s within [low * score, high * score] as whole numbers
                    least, most = -(-(low * score) // 100), (high * score) // 100
                    allowed = other & (found >= least[:, None]) & (found <= most[:, None]) & there[:, None]
                    of, at = _firsts(found, allowed, n)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(anchors.keys[part][of]),
                            pa.array(anchors.ids[part][of]),
                            pa.array(np.full(len(of), p + 1, np.int32)),
                            pa.array(anchors.positives[part, p, 0][of]),
                            pa.array(score[of]),
                            pa.array(candidates.ids[at]),
                            pa.array(found[of, at].astype(np.int64)),
                        ],
                        names=_names(_NEGATIVES),
                    )

    return run


# ---------------------------------------------------------------- the two passes


def _met(candidates: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
    """Every anchor block beside every candidate block, by the candidate block's number.

    Several times more partitions than blocks, so that hardly two blocks fall into one task.
    """
    copies = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "*")
    parts = 4 * blocks
    return candidates.repartition(parts, "block").join(copies.repartition(parts, "block").hint("merge"), "block")


def _first(rows: DataFrame, keys: list[str], score: str, ident: str, n: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(ident))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def mined(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """For each anchor and each of its first positives the first negatives in the positive's band.

    ``rows`` are as from ``whole_numbers``; ``anchor`` says which are anchors. Higher scores come first,
    ties by id. A negative has another label and between ``low`` and ``high`` percent of the positive's score.
    """
    rows = rows.select("vec_id", "label", "codes", F.coalesce(anchor, F.lit(False)).alias("_anchor"))
    chosen = rows.filter("_anchor").drop("_anchor").withColumn("key", F.monotonically_increasing_id())
    chosen = written(chosen, "anchors")
    n_rows, n_anchors = rows.count(), chosen.count()
    blocks = max(LEAST_BLOCKS, -(-n_rows // BLOCK))
    packed = rows.drop("_anchor").repartition(blocks).mapInArrow(_pack_candidates, _CANDIDATES)
    candidates = written(packed, "candidates")
    in_blocks = lambda frame, most: frame.repartition(max(1, -(-n_anchors // ANCHORS))).mapInArrow(_pack_anchors(most), _ANCHORS)

    near = _met(candidates, in_blocks(chosen, 0), blocks).mapInArrow(_positive_search(positives), _POSITIVES)
    near = _first(near, ["key"], "score", "vec_id", positives).select("key", F.struct("rank", "vec_id", "score").alias("positive"))
    near = near.groupBy("key").agg(F.array_sort(F.collect_list("positive")).alias("positives"))
    with_positives = written(chosen.join(near, "key"), "anchors")

    far = _met(candidates, in_blocks(with_positives, positives), blocks).mapInArrow(_negative_search(negatives, low, high), _NEGATIVES)
    far = _first(far, ["key", "positive_rank"], "negative_score", "negative_id", negatives)
    return far.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")


#: Of the query: ids divisible by these are anchors, and get the next of so many labels.
EVERY, MISLABELLED, LABELS = 50, 7, 10


def summary(embeddings: DataFrame) -> DataFrame:
    """The query's anchors and labels."""
    ident = F.col("vec_id")
    label = F.when(ident % MISLABELLED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mined(whole_numbers(embeddings).withColumn("label", label), ident % EVERY == 0)


ORACLE = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % {MISLABELLED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS c
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pair AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                list_sum(list_transform(list_zip(a.c, b.c), lambda z: z[1] * z[2]))::BIGINT AS score
         FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
positive AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
                    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank
             FROM pair WHERE same QUALIFY positive_rank <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_rank ORDER BY score DESC, vec_id) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score, positive_rank
FROM positive p JOIN pair n ON n.anchor_id = p.anchor_id AND NOT same
     AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
