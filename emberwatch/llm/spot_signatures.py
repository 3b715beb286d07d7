"""Document fingerprints by SpotSigs: content words behind common words, compared by pruned Jaccard.

1. A text's words are its runs of letters and digits, A-Z in lower case. ``ANCHORS`` are common words of four
   languages; all other words are content words. Where a content word stands right behind an anchor, the
   anchor and the chain of ``CHAIN`` content words from there on (anchors in between are left out) form a
   signature: 16 hex digits of its MD5. A chain that the text's end cuts off counts as far as it goes.
   A text without any spot, but with words, has one signature, of all its words.
2. The fingerprint is the sorted set of signatures, as one string. The likeness of two fingerprints is
   the Jaccard similarity of the sets, 1 where both are empty.
3. Sets of n and m signatures, n < m, are at most n / m alike. So sets fall into length classes, each class
   reaching up to the first length that the class's shortest set cannot be alike to; a set can only
   be alike to sets of its own and the neighbouring classes (``similar``). Of a set, only the
   n - ceil(least * n) + 1 smallest signatures are looked up, as two sets that are alike share one of these;
   the pairs found are pruned by length, and the rest is compared in full.
4. Equal fingerprints are one class (``classes``), so copies are never paired with each other.

The query's edited text takes its end from the next document by descending id. Only ids are sorted for that:
ids are split into ranges, each range finds its neighbours by a window, and the ranges' edges
are one row each. Texts are moved once, to meet the id behind them, and a third of them once more, to meet the
text in front; no text is sorted among all others, and nothing comes to the driver.

Everything runs as column expressions and joins.

Nulls and edges: a null text counts as empty. Rows equal in id and text are one place in the order and get
equal results; rows that share an id only follow each other by their text's hash. A null id comes last. A
single text follows itself. Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import LOWER, UPPER, ascii_lower, let, text_key, written

#: Common words of English, Spanish, French and German, by language.
ANCHORS = (
    "the of and to a in is that it for was on with as be by this are at from "
    "de la que el en y los se del las un por con no su una para es al lo "
    "le et les des du une pour est par qui dans avec sur pas au "
    "der die und den von zu das mit sich auf für ist im nicht dem ein eine als"
).split()
#: Content words of a chain.
CHAIN = 2
#: Hex digits of a signature.
DIGITS = 16
LEAST = 0.75

_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def signatures(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted set of a text's signatures. Each array is gone through once, so time is linear in the text."""
    common = sorted(set(anchors))
    words = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))
    digest = lambda parts: F.left(F.md5(F.encode(F.array_join(parts, " "), "UTF-8")), F.lit(DIGITS))

    def of_words(own: Column) -> Column:
        # places of the content words, in order; the word in front of one is either content or its anchor
        places = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: ~F.get(own, i).isin(common))
        return let(places, lambda at: of_places(own, at))

    def of_places(own: Column, at: Column) -> Column:
        behind = lambda j: F.get(at, j) - F.when(j == 0, F.lit(-1)).otherwise(F.get(at, j - 1)) > 1
        spots = F.filter(F.sequence(F.lit(0), F.size(at) - 1), behind)
        one = lambda j: digest(
            F.array_compact(F.array(F.get(own, F.get(at, j) - 1), *(F.get(own, F.get(at, j + n)) for n in range(chain))))
        )
        found = F.when(F.size(at) > 0, F.transform(spots, one)).otherwise(F.array().cast("array<string>"))
        whole = F.array(digest(own))
        return let(found, lambda x: F.when(F.size(x) > 0, F.array_sort(F.array_distinct(x))).otherwise(whole))

    nothing = F.array().cast("array<string>")
    return let(words, lambda own: F.when(F.size(own) > 0, of_words(own)).otherwise(nothing))


def fingerprint(found: Column) -> Column:
    return F.array_join(found, "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; equal sets and empty ones are told without comparing signatures."""

    def compared(shared: Column) -> Column:
        return shared / (F.size(a) + F.size(b) - shared)

    differ = let(F.size(F.array_intersect(a, b)), compared)
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(differ)


# ---------------------------------------------------------------- search


def length_class(size: Column, least: float = LEAST) -> Column:
    """Classes so wide that sets two classes apart are less alike than ``least``, whatever they hold."""
    return F.floor(F.log(size) / F.lit(-math.log(least)) + F.lit(1e-9)).cast("int")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, of) for every document, and the distinct sets: of, signatures. ``of`` names a class of equal fingerprints."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.col("text").cast("string")).alias("signatures"))
    rows = written(found.withColumn("of", F.sha2(F.encode(fingerprint(F.col("signatures")), "UTF-8"), 256)), "signatures")
    return rows.select("doc_id", "of"), rows.dropDuplicates(["of"]).select("of", "signatures")


def similar(queries: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """Classes alike by ``least`` and more: of, other, likeness, for every class of ``queries`` and every other one of ``sets``.

    Both have of and signatures, as from ``classes``. Empty sets are alike to none.
    """
    size = F.size("signatures")
    own = lambda frame, names: frame.filter(size > 0).select(
        F.col("of").alias(names[0]), F.col("signatures").alias(names[1]), length_class(size, least).alias("class")
    )
    prefix = lambda name: F.slice(name, F.lit(1), F.size(name) - F.ceil(F.lit(least) * F.size(name) - F.lit(1e-9)).cast("int") + 1)
    near = F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1))
    left, right = own(queries, ("of", "a")), own(sets, ("other", "b"))
    left_keys = left.select("of", F.size("a").alias("n"), F.explode(prefix("a")).alias("signature"), "class")
    left_keys = left_keys.select("of", "n", "signature", near.alias("class"))
    right_keys = right.select("other", F.size("b").alias("m"), F.explode(prefix("b")).alias("signature"), "class")
    pairs = left_keys.join(right_keys, ["class", "signature"])
    pairs = pairs.filter((F.col("of") != F.col("other")) & (F.least("n", "m") >= F.lit(least) * F.greatest("n", "m") - F.lit(1e-9)))
    pairs = pairs.select("of", "other").distinct()
    whole = pairs.join(left.select("of", "a"), "of").join(right.select("other", "b"), "other")
    return whole.select("of", "other", likeness(F.col("a"), F.col("b")).alias("likeness")).filter(F.col("likeness") >= least - 1e-12)


# ---------------------------------------------------------------- the query's edited texts


def following(ids: DataFrame) -> DataFrame:
    """(doc_id, key, next_id, next_key) for distinct (doc_id, key): the next one by descending id, after the last the first.

    Ids are split into ranges, which are written, so that every window holds one range.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("key").desc()]
    ranges = ids.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    rows = written(ranges, "ids").withColumn("own", F.struct("doc_id", "key"))
    inside = Window.partitionBy("range").orderBy(*order)
    placed = rows.select("doc_id", "key", "range", F.lead("own").over(inside).alias("next"), (F.row_number().over(inside) == 1).alias("first"), "own")
    # one row per range: the first of the range behind it
    edges = placed.filter("first").select("range", "own")
    every = Window.orderBy("range")
    wrap = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select("range", F.coalesce(F.lead("own").over(every), F.first("own").over(wrap)).alias("behind"))
    found = placed.join(edges, "range").withColumn("next", F.coalesce("next", "behind"))
    return found.select("doc_id", "key", F.col("next.doc_id").alias("next_id"), F.col("next.key").alias("next_key"))


def _packed(found: Column) -> Column:
    """Signatures as bytes, half as long as their digits; this is what moves."""
    return F.unhex(F.array_join(found, ""))


def _unpacked(packed: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.hex(packed)), F.lit(f".{{{DIGITS}}}"), F.lit(0))


def edited(docs: DataFrame) -> DataFrame:
    """doc_id and text of each row, ``tail``, the start of the next text that replaces its end, and ``next``, that text's signatures.

    Rows go by ``ident``, the id with null as 0, and ``key``, a hash of the text whose lowest bit says that the id is
    null. Both joins are plain equalities over the very same columns of the texts, so one exchange of these serves both.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    zero = F.lit(0).cast("long")
    key = F.shiftleft(text_key(F.col("text")), 1) + F.col("doc_id").isNull().cast("long")
    texts = named.select(F.coalesce("doc_id", zero).alias("ident"), key.alias("key"), "text")
    doc_id = F.when(F.col("key").bitwiseAND(1) == 0, F.col("ident"))
    light = written(texts.select("ident", "key", F.char_length("text").alias("n_chars")).distinct(), "lengths")
    lengths = light.select(F.col("ident").alias("of_ident"), F.col("key").alias("of_key"), "n_chars")
    before = following(light.select(doc_id.alias("doc_id"), "key")).select(
        F.coalesce("doc_id", zero).alias("of_ident"), F.col("key").alias("of_key"), F.coalesce("next_id", zero).alias("ident"), F.col("next_key").alias("key")
    )
    before = before.join(lengths, ["of_ident", "of_key"])
    given = texts.join(before.hint("shuffle_hash"), ["ident", "key"])
    start = F.left("text", F.floor(F.col("n_chars") / 3).cast("int"))
    given = given.select(F.col("of_ident").alias("ident"), F.col("of_key").alias("key"), start.alias("tail"), _packed(signatures(F.col("text"))).alias("next"))
    found = texts.join(given.dropDuplicates(["ident", "key"]), ["ident", "key"])
    return found.select(doc_id.alias("doc_id"), "text", "tail", _unpacked(F.col("next")).alias("next"))


def summary(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike they are."""
    n_chars = F.char_length("text")
    kept = F.left("text", (n_chars - F.floor(n_chars / 3)).cast("int"))
    rows = edited(docs).select("doc_id", "text", F.concat(kept, "tail").alias("edited"), "next")
    rows = rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(signatures(F.col("text")).alias("own"), signatures(F.col("edited")).alias("edited"), F.col("next")))).alias("set"),
    )
    a, b = F.col("set.own"), F.col("set.edited")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(a).alias("fingerprint"),
        fingerprint(b).alias("edited_fingerprint"),
        likeness(a, b).alias("near_edited"),
        likeness(a, F.col("set.next")).alias("near_next"),
    )


ORACLE = f"""
WITH own AS (SELECT doc_id, coalesce(text, '') AS text, lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC) AS behind,
                    first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC) AS top FROM documents),
both_texts AS (SELECT doc_id, text, left(text, length(text) - length(text) // 3) || left(coalesce(behind, top), length(text) // 3) AS edited,
                 coalesce(behind, top) AS following FROM own),
kind AS (SELECT doc_id, 1 AS k, text AS t FROM both_texts UNION ALL SELECT doc_id, 2, edited FROM both_texts UNION ALL SELECT doc_id, 3, following FROM both_texts),
word AS (SELECT doc_id, k, unnest(w) AS w, unnest(range(len(w))) AS i
         FROM (SELECT doc_id, k, regexp_extract_all(translate(t, '{UPPER}', '{LOWER}'), '{_WORD}') AS w FROM kind)),
content AS (SELECT *, lag(i, 1, -1) OVER o AS previous, lead(w) OVER o AS second
            FROM word WHERE NOT list_contains({ANCHORS!r}, w) WINDOW o AS (PARTITION BY doc_id, k ORDER BY i)),
spot AS (SELECT DISTINCT c.doc_id, c.k, left(md5(concat_ws(' ', a.w, c.w, c.second)), {DIGITS}) AS s
         FROM content c JOIN word a ON a.doc_id = c.doc_id AND a.k = c.k AND a.i = c.i - 1 WHERE c.i - c.previous > 1),
whole AS (SELECT doc_id, k, left(md5(string_agg(w, ' ' ORDER BY i)), {DIGITS}) AS s FROM word GROUP BY ALL),
signed AS (SELECT kind.doc_id, kind.k, coalesce(any_value(g.l), list(whole.s) FILTER (whole.s IS NOT NULL), []) AS l
           FROM kind LEFT JOIN (SELECT doc_id, k, list(s ORDER BY s) AS l FROM spot GROUP BY ALL) g USING (doc_id, k)
           LEFT JOIN whole USING (doc_id, k) GROUP BY kind.doc_id, kind.k),
three AS (SELECT a.doc_id, a.l AS a, b.l AS b, c.l AS c FROM signed a JOIN signed b USING (doc_id) JOIN signed c USING (doc_id)
          WHERE a.k = 1 AND b.k = 2 AND c.k = 3)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
       CASE WHEN a = b THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END AS near_edited,
       CASE WHEN a = c THEN 1.0 WHEN len(a) = 0 OR len(c) = 0 THEN 0.0 ELSE len(list_intersect(a, c)) / len(list_distinct(a || c)) END AS near_next
FROM three JOIN both_texts USING (doc_id)
"""
