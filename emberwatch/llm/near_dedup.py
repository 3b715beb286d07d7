"""Near-duplicate groups: one-permutation MinHash, banded buckets, star-shaped candidate edges.

1. One hash per shingle fills a signature of ``BANDS * ROWS`` bins; an empty bin takes the value of
   a bin that its own fixed permutation of all bins comes to first (optimal densification).
2. Texts with equal shingle sets are one class, which its smallest doc_id stands for.
3. Classes that share a band meet in a bucket. Every member gets one edge, to the bucket's smallest
   member: n - 1 edges, never all pairs.
4. Edges whose set sizes or signatures rule a link out go; the rest is confirmed on the full sets.
5. Stars lose links between members that are both far from the middle. Where the members of a bucket
   are still in several components, the signatures of those outside its largest one are compared
   with the others', in blocks; what the signatures do not rule out is confirmed like the rest.
   No other pair of a bucket can join two components.

Two sets of similarity 0.75 share no band with a probability of 2e-6. A signature rules a pair out
when its estimate is four standard deviations below a link.

Nulls and edges: a null or blank text has no shingles, is a component of its own and kept. A row
without doc_id has a null component, is kept and links nothing. Rows that share a doc_id are judged
each by its own text; where the id is the smallest of both texts' classes, they share what they link to. Columns other than ``doc_id`` and ``text`` are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import written
from emberwatch.llm.wordhash import NOT_SPACE, Block, blocks, gram_rows, grams, int64_lists, mix

SHINGLE = 5
BANDS, ROWS = 48, 5
BINS = BANDS * ROWS
#: A link needs ``100 * intersection >= PERCENT * union``.
PERCENT = 75
#: Standard deviations that an estimate must be off to rule a pair out.
SURE = 4.0
#: Members of a bucket that are compared with as many others in one go.
CHUNK = 4096
#: Pieces that the rows of a class are dealt out to where they learn their component.
SALTS = 1024
#: Size of the filter on document ids: 2^23 bits are 1 MB, whatever it is made from.
FILTER_BITS = 1 << 23

_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)


def _donor_orders() -> np.ndarray:
    """For each bin, the fixed order in which it asks the others for a value."""
    keys = mix(np.arange(BINS * BINS, dtype=_U) + _U(0x51ED27)).reshape(BINS, BINS)
    return np.argsort(keys, axis=1, kind="stable")


_DONORS = _donor_orders()


def shingles(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each row: values by row, their rows, and how many each row has."""
    places, rows = gram_rows(block, SHINGLE)
    values = grams(block.words, SHINGLE)[places]
    short = np.flatnonzero((block.counts > 0) & (block.counts < SHINGLE))
    starts = block.starts
    extra = []
    for n in range(1, SHINGLE):
        of_n = short[block.counts[short] == n]
        extra.append((grams(block.words, n)[starts[of_n]], of_n))
    values = np.concatenate([values, *(v for v, _ in extra)])
    rows = np.concatenate([rows, *(r for _, r in extra)])
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[new], rows[new]
    return values, rows, np.bincount(rows, minlength=len(block.counts))


def _signatures(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The densified signatures, and a byte per bin that is 0 where the bin was empty."""
    bins = ((values >> _U(32)) * _U(BINS)) >> _U(32)
    table = np.full(n * BINS, _EMPTY, _U)
    np.minimum.at(table, rows * BINS + bins.astype(np.int64), mix(values))
    table = table.reshape(n, BINS)
    filled = table != _EMPTY
    marks = np.where(filled, (table % _U(255)).astype(np.uint8) + np.uint8(1), np.uint8(0))
    row, own = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for step in range(BINS):
        if not len(row):
            break
        donor = _DONORS[own, step]
        found = filled[row, donor]
        table[row[found], own[found]] = table[row[found], donor[found]]
        row, own = row[~found], own[~found]
    return table, marks


def _bands(table: np.ndarray) -> np.ndarray:
    cells = table.reshape(len(table), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=_U), cells.shape[:2])
    for i in range(ROWS):
        keys = mix(keys ^ cells[:, :, i])
    return keys


_SIGNED = "doc_id long, n_shingles long, class_1 long, class_2 long, signature binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(1), NOT_SPACE):
            n = len(block.counts)
            values, rows, sizes = shingles(block)
            class_1, class_2 = np.zeros(n, _U), np.zeros(n, _U)
            np.add.at(class_1, rows, values)
            np.add.at(class_2, rows, mix(values ^ _U(0x5A17)))
            table, marks = _signatures(values, rows, n)
            some = sizes > 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(block.first, n),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(class_1.view(np.int64)),
                    pa.array(class_2.view(np.int64)),
                    pa.array([m.tobytes() if s else None for m, s in zip(marks, some, strict=True)], pa.binary()),
                    int64_lists(_bands(table)[some].ravel(), np.where(some, BANDS, 0)),
                ],
                names=["doc_id", "n_shingles", "class_1", "class_2", "signature", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(1), NOT_SPACE):
            values, _, sizes = shingles(block)
            ids = batch.column(0).slice(block.first, len(sizes))
            yield pa.RecordBatch.from_arrays([ids, int64_lists(values, sizes)], names=["doc_id", "shingles"])


def _possible(n_a: np.ndarray, n_b: np.ndarray, marks_a: np.ndarray, marks_b: np.ndarray) -> np.ndarray:
    """Whether sizes and signatures (before densification) leave a link possible.

    The bins that are not empty in both sample the union without putting back, which narrows the
    estimate's spread.
    """
    least = PERCENT / 100
    full = np.maximum(np.count_nonzero(marks_a | marks_b, axis=-1), 1)
    equal = np.count_nonzero((marks_a == marks_b) & (marks_a > 0), axis=-1)
    union = (n_a + n_b) / (1 + least)
    spread = np.sqrt(least * (1 - least) / full * np.maximum(union - full, 1) / union)
    sizes = np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * PERCENT
    return sizes & (equal / full >= least - SURE * spread)


def _marks(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BINS)


def _promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and signatures do not rule out."""

    @F.arrow_udf("boolean")
    def possible(n_a: pa.Array, n_b: pa.Array, marks_a: pa.Array, marks_b: pa.Array) -> pa.Array:
        return pa.array(_possible(np.asarray(n_a), np.asarray(n_b), _marks(marks_a), _marks(marks_b)))

    side = lambda x: classes.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.filter(possible("n_a", "n_b", "s_a", "s_b")).select("a", "b").distinct()


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of the ids.

    A bitmap of hashed ids, of fixed size, keeps most other texts out of the shuffle; the join decides.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bitmap = ids.select(F.bitmap_bucket_number(bit).alias("part"), F.bitmap_bit_position(bit).alias("place"))
    bitmap = bitmap.groupBy("part").agg(F.bitmap_construct_agg("place").alias("bits"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = F.expr("part = bitmap_bucket_number(pmod(xxhash64(doc_id), %d))" % FILTER_BITS)
    near = docs.join(F.broadcast(bitmap), marked).filter(F.getbit(byte, (at % 8).cast("int")) == 1)
    return near.select("doc_id", "text").join(ids, "doc_id", "left_semi")


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    ids = pairs.select(F.col("a").alias("doc_id")).distinct().union(pairs.select(F.col("b").alias("doc_id")).distinct()).distinct()
    ids = written(ids, "ids")
    sets = _among(docs, ids).mapInArrow(_sets, "doc_id long, shingles array<long>")
    with_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b")
    both = with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    return both.filter(shared * 100 >= union * PERCENT).select("a", "b").distinct()


def _compared(block: pa.Table) -> pa.Table:
    """Pairs of a block that a link may join: rows outside the main component with rows of others.

    Two rows that share several buckets are compared in the one of their first shared band.
    """
    names = ("doc_id", "component", "n_shingles", "signature", "bands", "outside")
    order = {name: block.column(name).combine_chunks() for name in names}
    ids, parts, sizes = (np.asarray(order[c]) for c in ("doc_id", "component", "n_shingles"))
    outside = order["outside"].to_numpy(zero_copy_only=False)
    marks, bands = _marks(order["signature"]), np.asarray(order["bands"].flatten()).reshape(-1, BANDS)
    bucket = block.column("bucket")[0].as_py()
    theirs, mine = np.flatnonzero(~outside), np.flatnonzero(outside)
    found: list[np.ndarray] = []
    for i in mine:
        others = theirs[parts[theirs] != parts[i]]
        first = (bands[others] == bands[i]).argmax(axis=1)
        others = others[bands[i, first] == bucket]
        fits = others[_possible(sizes[i], sizes[others], marks[i], marks[others])]
        found.append(np.stack([np.minimum(ids[i], ids[fits]), np.maximum(ids[i], ids[fits])]))
    a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _members(slots: DataFrame) -> DataFrame:
    """The slots (bucket, doc_id) of buckets with several members, each with its bucket's middle and size.

    A bucket is repeated for the salts that its members have, 64 at most, so that a large one is many keys.
    """
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int")
    slots = slots.withColumn("salt", salt)
    mask = F.expr("bit_or(shiftleft(1L, salt))").alias("salts")
    shared = slots.groupBy("bucket").agg(F.min("doc_id").alias("center"), F.count("*").alias("n"), mask).filter("n > 1")
    return slots.join(_salted(shared.withColumn("mask", F.col("salts"))), ["bucket", "salt"]).withColumnRenamed("mask", "salts")


def _salted(buckets: DataFrame) -> DataFrame:
    """``buckets`` once per salt of the bits set in ``salts``."""
    return buckets.withColumn("salt", F.expr("explode(filter(sequence(0, 63), s -> getbit(salts, s) = 1))")).drop("salts")


def _cells(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the buckets with several components, by the blocks in which they are compared.

    The members outside a bucket's largest component are cut into chunks, and so are all of its members,
    which meet each of those chunks. With m members, of them k outside, that is about 2 * k * m / CHUNK
    rows, and m at least. A bucket's middle was compared with all others before.
    """
    at = members.filter("n > 2").join(found, "doc_id", "left")
    of_bucket = ["bucket", "salt", "salts", "doc_id", "n"]
    at = at.select(*of_bucket, (F.col("doc_id") == F.col("center")).alias("middle"), F.coalesce("component_id", "doc_id").alias("component"))
    parts = at.groupBy("bucket", "component").agg(F.count("*").alias("size"), F.max("salts").alias("salts"))
    biggest = F.max(F.struct("size", "component"))
    largest = parts.groupBy("bucket").agg(biggest["component"].alias("main"), (F.sum("size") - biggest["size"]).alias("n_outside"), F.max("salts").alias("salts"))
    rows = at.filter("NOT middle").drop("salts").join(_salted(largest.filter("n_outside > 0")), ["bucket", "salt"])
    chunk = lambda n: F.pmod(F.xxhash64("doc_id"), F.ceil(F.col(n) / CHUNK))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / CHUNK) - 1))
    known = ["bucket", "doc_id", "component"]
    left = rows.filter("component <> main").select(*known, F.lit(True).alias("outside"), chunk("n_outside").alias("row"), every("n").alias("column"))
    right = rows.select(*known, F.lit(False).alias("outside"), every("n_outside").alias("row"), chunk("n").alias("column"))
    return left.unionByName(right)


def _left_open(members: DataFrame, found: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of different components that share a bucket, were not compared yet and may be linked.

    Each row outside its bucket's largest component meets the others in blocks of ``CHUNK`` by
    ``CHUNK`` rows, so a large bucket is many tasks.
    """
    blocks_of = _cells(members, found).join(classes.select("doc_id", "n_shingles", "signature", "bands"), "doc_id")
    return blocks_of.groupBy("bucket", "row", "column").applyInArrow(_compared, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """The smallest id that each node of ``edges`` (a, b) can reach, as (doc_id, component_id), but for that id itself.

    Alternating large and small stars: every node hangs its larger, then its smaller, neighbours
    on the smallest one. Minima come from partial aggregates, so a hub is no group of its own.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "stars")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.union(down.select("u", F.col("m").alias("v"))).distinct(), "stars")
        before, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.groupBy(F.col("u").alias("doc_id")).agg(F.min("v").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(docs.mapInArrow(_sign, _SIGNED), "signed")
    with_id = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["class_1", "class_2", "n_shingles"]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")
    dealt = with_id.groupBy(*same, salt).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    firsts = dealt.groupBy(*same).agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
    firsts = written(firsts, "firsts")
    stands = with_id.join(firsts.select(F.col("first_id").alias("doc_id"), *same), ["doc_id", *same], "left_semi")
    classes = written(stands.dropDuplicates(["doc_id", *same]), "classes")

    slots = classes.select("doc_id", F.explode("bands").alias("bucket"))
    members = written(_members(slots), "members")
    stars = members.filter("doc_id <> center").select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = written(_confirmed(written(_promising(stars, classes), "pairs"), docs), "links")
    found = components(links)

    more = written(_confirmed(written(_left_open(members, found, classes), "pairs"), docs), "links")
    labels = found if more.isEmpty() else components(links.union(more))

    named = firsts.join(labels.withColumnRenamed("doc_id", "first_id"), "first_id", "left")
    # a class is repeated for the salts that its rows have, so no more often than it has rows; one of a single row needs no telling
    named = named.filter("n > 1 OR component_id IS NOT NULL")
    named = named.select(*same, F.explode("salts").alias("salt"), F.coalesce("component_id", "first_id").alias("of_class"))
    result = signed.select("doc_id", *same, salt).join(named, [*same, "salt"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("of_class", "doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    result = result.select("doc_id", "n_shingles", component.alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows of each group that its smallest doc_id stands for."""
    gone = near_duplicates(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


#: The same result from all sets: pairs by shared shingles, then components.
ORACLE = r"""
WITH RECURSIVE
word AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
                                  WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s,
                   len(w) < 5 AS short FROM word),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingle a JOIN shingle b
         ON a.s = b.s AND a.short = b.short AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y
         WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, link.y FROM reach r JOIN link ON r.y = link.x),
part AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN part USING (doc_id) LEFT JOIN size USING (doc_id)
"""
