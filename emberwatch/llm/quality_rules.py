"""Line-first quality rules.

Every line is judged by itself: punctuation (symbols, shouting, separators, crumbs without an end),
navigation (menus, tables of links, the same word again and again) and boilerplate (notices that
sites put on every page, where they make up a good share of the line's words). Failing lines are removed; a document that loses more than ``MOST_LOST``
of its words' characters with them is rejected, and so is one that fails the base rules on its
words. All measures are array and string functions within a row: nothing is shuffled.

Nulls and edges: a null text counts as empty, has no words, fails and is not kept. White space is
``[\\x20\\x09-\\x0D]``. Repeated rows are judged alike; extra columns come through ``cleaned`` as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import SPACES, let, packed, unpacked

WINDOW = 5
LEAST_WORDS = 10
#: Percent of the words that may lie in repeated windows.
MOST_REPEATED = 20
SYMBOLS = "#*$%&|<>"

#: Share of the words' characters that may go with failing lines.
MOST_LOST = 0.3
#: Share of a line's words that may hold a symbol, end in a doubled mark, or repeat the word before.
MOST_MARKED = 0.3
#: Share of a line's words that lie in notices, from which on it is one.
NOTICE_SHARE = 0.2
#: A line of fewer words needs an end mark.
CRUMB_WORDS = 3

#: Notices, in lower case. Fixed wording of common licences and site texts.
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "uses cookies",
    "use of cookies",
    "enable javascript",
    "sign in to",
    "subscribe to our",
    "click here",
    "lorem ipsum",
)

_SPACE = r"[\x20\x09-\x0D]"
_NUMBER = r"^[$#]?[0-9][0-9.,]*%?\z"
_DOUBLED = r"([!?,;:])[!?,;:]+\z|\.\.\.\.\z"
_END_MARK = r"\p{P}\z"


def _words(text: Column) -> Column:
    bare = F.trim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACE + "+"))


def _long(value: Column) -> Column:
    return value.cast("long")


def _chars(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.char_length(w))


def _repeated(words: Column) -> Column:
    """Words that lie in a window of five that the text has twice or more."""

    def windows(w: Column) -> Column:
        starts = F.when(F.size(w) < WINDOW, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(w) - WINDOW))
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + n) for n in range(WINDOW))))

    def covered(hashes: Column) -> Column:
        entries = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(e: Column) -> Column:
            same = lambda x, n: F.coalesce(F.get(e, n)["h"] == x["h"], F.lit(False))
            found = F.filter(e, lambda x, n: same(x, n - 1) | same(x, n + 1))
            return F.sort_array(F.transform(found, lambda x: x["i"]))

        def total(p: Column) -> Column:
            own = F.transform(p, lambda x, n: F.least(F.lit(WINDOW), F.coalesce(F.get(p, n + 1) - x, F.lit(WINDOW))))
            return F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s + x)

        return let(entries, lambda e: let(places(e), total))

    whole = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))
    return let(windows(words), whole)


def _line_fails(line: Column) -> Column:
    """Whether a line with a word fails a rule."""

    def rules(words: Column) -> Column:
        n = F.size(words)
        share = lambda hits: F.size(hits) > n * MOST_MARKED
        symbols = share(F.filter(words, lambda w: w.rlike(r"[#*$%&|<>]") & ~w.rlike(_NUMBER)))
        doubled = share(F.filter(words, lambda w: w.rlike(_DOUBLED)))
        again = (n >= 6) & share(F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.get(words, i) == F.get(words, i - 1)))
        crumb = (n < CRUMB_WORDS) & ~F.rtrim(line).rlike(_END_MARK)
        return symbols | doubled | again | crumb

    def noticed(low: Column) -> Column:
        """Words of the notices in a line."""
        found = F.lit(0)
        for phrase in BOILERPLATE:
            times = F.size(F.split(low, phrase, -1)) - 1
            found = found + F.when(low.contains(phrase), times * len(phrase.split())).otherwise(0)
        return found

    low = F.lower(line)
    any_notice = F.lit(False)
    for phrase in BOILERPLATE:
        any_notice = any_notice | low.contains(phrase)
    notice = any_notice & (let(low, noticed) >= F.size(_words(line)) * NOTICE_SHARE)
    return notice | let(_words(line), rules)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, row (all columns but the text) and ``quality``: the measures, the cleaned text and the verdict."""
    docs = packed(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def of_lines(lines: Column) -> Column:
        """Lines with a word, how many repeat an earlier one, and what stays of the lines."""
        full = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        stays = F.filter(lines, lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | ~_line_fails(x))
        return let(full, lambda f: F.struct((F.size(f) - F.size(F.array_distinct(f))).cast("long").alias("dup"), F.array_join(stays, "\n").alias("clean")))

    def of_words(words: Column) -> Column:
        return F.struct(_long(F.size(words)).alias("n"), _chars(words).alias("chars"), _repeated(words).alias("repeated"))

    parts = F.struct(
        let(_words(text), of_words).alias("words"),
        let(F.split(text, "\n", -1), of_lines).alias("lines"),
        _long(F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).alias("symbols"),
    )
    # a generator keeps the optimizer from copying the measures into what follows
    found = docs.select("doc_id", "row", F.explode(F.array(parts)).alias("_m"))
    clean = F.regexp_replace(F.col("_m.lines.clean"), _SPACE + "+", "")
    n, repeated, chars = F.col("_m.words.n"), F.col("_m.words.repeated"), F.col("_m.words.chars")
    failed = (n < LEAST_WORDS) | (repeated * 100 > n * MOST_REPEATED)
    lost = F.when(chars == 0, F.lit(0.0)).otherwise((chars - F.char_length(clean)) / chars)
    quality = F.struct(
        n.alias("n_words"),
        chars.alias("word_chars"),
        F.col("_m.symbols").alias("n_symbols"),
        F.col("_m.lines.dup").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        failed.alias("base_failed"),
        lost.alias("lost"),
        (~failed & (lost <= MOST_LOST)).alias("kept"),
        F.col("_m.lines.clean").alias("clean_text"),
    )
    return found.select("doc_id", "row", F.explode(F.array(quality)).alias("quality"))


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their failing lines removed from ``text``."""
    return unpacked(measured(docs).filter("quality.kept"), docs.columns, F.col("quality.clean_text"))


def summary(docs: DataFrame) -> DataFrame:
    """The measures and the verdict."""
    found = measured(docs.select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select("doc_id", *(F.col(f"quality.{c}").alias(c) for c in names), F.round("quality.lost", 6).alias("lost"))


#: Words of the notices in a line.
_NOTICED = " + ".join(f"(length(low) - length(replace(low, '{p}', ''))) // {len(p)} * {len(p.split())}" for p in BOILERPLATE)

ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
word AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
gram AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: {{'i': i, 'g': array_to_string(w[i:i + {WINDOW - 1}], ' ')}})) AS x
         FROM word WHERE len(w) >= {WINDOW}),
twice AS (SELECT doc_id, x.g AS g, list(x.i) AS places FROM gram GROUP BY doc_id, x.g HAVING count(*) > 1),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM (SELECT doc_id, unnest(places) AS i FROM twice)) GROUP BY doc_id),
line AS (SELECT doc_id, line, lower(line) AS low, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w
         FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)),
judged AS (SELECT doc_id, line, list_sum(list_transform(w, lambda x: length(x))) AS chars,
    ({_NOTICED}) >= greatest(1, len(w) * {NOTICE_SHARE}::DOUBLE)
    OR len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]') AND NOT regexp_matches(x, '{_NUMBER}'))) > len(w) * {MOST_MARKED}
    OR len(list_filter(w, lambda x: regexp_matches(x, '{_DOUBLED}'))) > len(w) * {MOST_MARKED}
    OR (len(w) >= 6 AND len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) > len(w) * {MOST_MARKED})
    OR (len(w) < {CRUMB_WORDS} AND NOT regexp_matches(rtrim(line), '{_END_MARK}')) AS fails
    FROM line WHERE len(w) > 0),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, coalesce(sum(chars) FILTER (fails), 0) AS lost, sum(chars) AS chars
          FROM judged GROUP BY doc_id),
base AS (SELECT word.doc_id, len(w) AS n_words, coalesce(l.chars, 0)::BIGINT AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
    coalesce(a.n, 0) AS n_repeat_words, CASE WHEN l.chars > 0 THEN l.lost / l.chars ELSE 0.0 END AS lost
    FROM word LEFT JOIN lines l USING (doc_id) LEFT JOIN again a USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
    NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND lost <= {MOST_LOST} AS kept,
    round(lost, 6) AS lost
FROM base
"""
