"""Line dedup: a line found in many documents is dropped from all of them.

Texts split at line feeds; a line's key is the line without white space at its ends, A-Z in lower
case. Each document gives each of its keys once, as two 64-bit hashes; documents per key are
counted, and the keys found in ``LEAST_DOCS`` documents and more are joined back to the documents
that have them. Only hashes move in the counting. A document then drops, by position, its lines
whose key it was told of, and the rest keeps its order.

A key in very many documents is a partial count in every task, and in the join back a skewed key
that Spark splits; no list of a key's documents is ever made.

Rows that share a ``doc_id`` are one document: a key that several of them have counts once. Rows are
counted first; only the rows of repeated ids go through (key, id), and what they count too often is
taken off. A row without ``doc_id`` is a document by itself. Each row keeps its own lines.

Nulls and edges: a null or empty text has one empty line, and its kept text is empty. Keys shorter
than ``LEAST_CHARS`` code points are never dropped. Extra columns of ``docs`` come through
``drop_lines`` as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import LOWER, SPACES, UPPER, ascii_lower, let, packed, text_key, unpacked, written

LEAST_DOCS = 10
LEAST_CHARS = 1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """Both hashes of a line's key; null where the key is too short."""
    bare = F.trim(line, F.lit(SPACES))
    hashes = lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))
    return F.when(F.char_length(bare) >= LEAST_CHARS, let(ascii_lower(bare), hashes))


def _keys(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2: each key of each row once."""
    own = F.array_compact(F.array_distinct(F.transform(_lines(F.col("text")), _key)))
    return docs.select("doc_id", F.explode(own).alias("line")).select("doc_id", "line.h1", "line.h2")


def frequent_lines(docs: DataFrame) -> DataFrame:
    """Hashes of the keys that many documents have."""
    rows = _keys(docs).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") >= LEAST_DOCS)
    ids = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = written(ids.filter("n > 1").select("doc_id"), "repeated")
    again = _keys(docs.join(repeated, "doc_id", "left_semi")).groupBy("doc_id", "h1", "h2").agg((F.count(F.lit(1)) - 1).alias("n"))
    again = again.filter("n > 0").groupBy("h1", "h2").agg(F.sum("n").alias("n_again"))
    n_docs = F.col("n_rows") - F.coalesce("n_again", F.lit(0))
    return rows.join(again, ["h1", "h2"], "left").filter(n_docs >= LEAST_DOCS).select("h1", "h2")


def without_frequent(docs: DataFrame) -> DataFrame:
    """doc_id, row (all columns but the text), n_lines, n_dropped and kept_text of each row of ``docs``."""
    docs = packed(docs)
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    named = docs.select(doc_id.alias("doc_id"), text.alias("text"))
    placed = named.select(
        F.col("doc_id").alias("of_id"),
        text_key(F.col("text")).alias("of_key"),
        F.posexplode(F.transform(_lines(F.col("text")), _key)).alias("place", "line"),
    )
    placed = placed.select("of_id", "of_key", "place", "line.h1", "line.h2").filter("h1 IS NOT NULL")
    gone = placed.join(written(frequent_lines(named), "lines"), ["h1", "h2"])
    gone = gone.groupBy("of_id", "of_key").agg(F.collect_set("place").alias("gone"))

    def without(lines: Column) -> Column:
        stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            F.size("gone").cast("long").alias("n_dropped"),
            F.array_join(F.transform(stays, lambda place: F.get(lines, place)), "\n").alias("kept_text"),
        )

    whole = F.struct(
        F.size(_lines(text)).cast("long").alias("n_lines"),
        F.lit(0).cast("long").alias("n_dropped"),
        F.coalesce(text, F.lit("")).alias("kept_text"),
    )
    result = F.when(F.col("gone").isNull(), whole).otherwise(let(_lines(text), without))
    same = doc_id.eqNullSafe(F.col("of_id")) & (text_key(text) == F.col("of_key"))
    joined = docs.join(gone, same, "left").select("doc_id", "row", F.explode(F.array(result)).alias("result"))
    return joined.select("doc_id", "row", "result.*")


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the frequent lines in ``text``."""
    return unpacked(without_frequent(docs), docs.columns, F.col("kept_text"))


def summary(docs: DataFrame) -> DataFrame:
    """Counts and digests of what stays."""
    found = without_frequent(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH line AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS p
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM line),
many AS (SELECT k FROM keyed WHERE length(k) >= {LEAST_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
marked AS (SELECT keyed.*, many.k IS NOT NULL AS gone FROM keyed LEFT JOIN many ON keyed.k = many.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
