"""Personal data by generated candidates, boosted trees and calibrated thresholds.

1. Generators propose spans of four kinds: the base patterns, and looser ones (other separators,
   written-out signs, numbers without a plus) that may overlap anything.
2. Base spans are the base patterns' matches that pass their test (parts up to 255, Luhn, number
   of digits). They always stay.
3. Base spans label candidates: one that lies on a base span of its kind is positive; one that lies on
   a base span of another kind, that failed the test of its base pattern, or that is an email without a
   domain's ending, is negative. All others have no label.
4. Boosted trees learn from format and context features of all candidates with a label, and from variants of
   ``SEEDS`` and of all base spans: the span with other separators is positive, the
   same spoilt (no domain ending, a part over 255, a wrong check digit, too few digits or no plus) is negative. So
   every kind has both labels, whatever the table holds. Half of all are held out, by a hash, a variant with its
   span; for each kind the threshold is the lowest one, halfway between two scores, over which at least
   ``PRECISION`` of the held-out candidates are positive, and of those right over it too, as many sure ones
   would make up for some that are all wrong. Candidates of equal features are one row with their
   number, so nothing is sampled and the fit grows with the different rows only. In the fit, the candidates of
   each kind and label weigh the same in sum, as kinds differ widely in how frequent they are.
5. Candidates of the looser generators over their kind's threshold that touch no base span are added; of those
   that overlap, the one with the best score. A match that failed the test of its base pattern is known to be wrong.

Everything runs as column expressions, windows over a document's candidates and the library's own
trees; a text's place is counted in code points from the pieces between matches. The patterns
cannot backtrack into a run, so a text of one long run takes linear time.

Nulls and edges: a null text counts as empty. Rows that share a doc_id are told apart by their text;
repeated rows get equal results. A null doc_id is kept. Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import let, text_key, written

KINDS = ("email", "ip", "card", "phone")

#: Kind and pattern. Possessive forms of the base patterns: their parts share no characters, so they match the same.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?+(?:@|[(\[{](?:at|AT|@)[)\]}])\x20?+[A-Za-z0-9-]++"
    r"(?:(?:\.|\x20?+[(\[{](?:dot|DOT|\.)[)\]}]\x20?+)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:(?:[(\[{]\.[)\]}]|\x20?+\.\x20?+)[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}+[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9])\(?[0-9](?:[\x20()._/-]{0,3}+[0-9]){6,14}+(?![0-9])",
}
#: What a text must contain for a kind's patterns to be tried at all.
_NEEDS = {
    "email": r"@|[(\[{](?:at|AT)[)\]}]",
    "ip": r"[0-9]",
    "card": r"[0-9]",
    "phone": r"[0-9]",
}
#: Words in front of a span that go with its kind.
_HINTS = {
    "email": r"(?i)mail|contact|write to|@",
    "ip": r"(?i)\bip\b|host|server|address|ping",
    "card": r"(?i)card|visa|credit|payment|iban",
    "phone": r"(?i)phone|tel|call|mobile|fax|\+",
}

#: Characters of context on either side.
CONTEXT = 24
PRECISION = 0.99
#: Made-up base spans with what stands before and after; variants are made of these too.
SEEDS = {
    "email": (
        ("mail ", "jo.doe@example.org", " now"),
        ("", "info@site.com", ""),
        ("write to ", "a_b+c@mail.example.net", "."),
        ("and ", "x1@dept.uni.edu", ", so"),
        ("contact: ", "sales@my-shop.co", " or"),
        ("see ", "kim@example.com", " for it"),
    ),
    "ip": (
        ("host ", "10.0.0.1", " up"),
        ("", "192.168.14.7", ""),
        ("from ", "203.0.113.250", ":80"),
        ("ping ", "8.8.4.4", "."),
        ("and ", "172.16.254.3", ", so"),
        ("see ", "198.51.100.42", " for it"),
    ),
    "card": (
        ("card ", "4111 1111 1111 1111", " now"),
        ("", "5500-0000-0000-0004", ""),
        ("pay ", "6011000000000004", "."),
        ("and ", "340000000000009", ", so"),
        ("visa: ", "4012 8888 8888 1881", " or"),
        ("see ", "5105105105105100", " for it"),
    ),
    "phone": (
        ("call ", "+1 (187) 555-8851", " now"),
        ("", "+44 20 7946 0958", ""),
        ("tel ", "+49-30-901820-55", "."),
        ("and ", "+33 1.70.18.99.00", ", so"),
        ("fax: ", "+1 202 555 0143", " or"),
        ("see ", "+81-3-5550-1234", " for it"),
    ),
}
#: An email's ending, also written out.
_DOMAIN = r"[A-Za-z0-9]\.[A-Za-z]{2,}$|(?:dot|DOT|\.)[)\]}]\x20?[A-Za-z]{2,}$"
TREES, DEPTH, SEED = 10, 3, 7
#: Values of a feature that the trees can all be split between; of more values, so many quantiles.
BINS = 1024
#: Rows of different features that one task of the fit takes; no more than these are fitted in the same order each time.
FIT_ROWS = 100_000

_CANDIDATE = "array<struct<kind:int,base:boolean,i:int,gap:int,match:string,before:string,after:string>>"


def _matches(text: Column, number: int, base: bool, pattern: str) -> Column:
    """A generator's matches with the length of what lies in front of each, and their context."""
    nothing = F.array().cast(_CANDIDATE)

    def one(match: Column, i: Column, gaps: Column) -> Column:
        return F.struct(
            F.lit(number).alias("kind"),
            F.lit(base).alias("base"),
            i.alias("i"),
            F.char_length(F.get(gaps, i)).alias("gap"),
            match.alias("match"),
            F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"),
            F.substring(F.get(gaps, i + 1), 1, CONTEXT).alias("after"),
        )

    def placed(matches: Column) -> Column:
        pieces = let(F.split(text, pattern, -1), lambda gaps: F.transform(matches, lambda m, i: one(m, i, gaps)))
        return F.when(F.size(matches) == 0, nothing).otherwise(pieces.cast(_CANDIDATE))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _proposed(text: Column) -> Column:
    """All generators' matches in a text."""
    parts = [
        F.when(text.rlike(_NEEDS[kind]), _matches(text, number, base, patterns[kind])).otherwise(F.array().cast(_CANDIDATE))
        for number, kind in enumerate(KINDS)
        for base, patterns in ((True, BASE), (False, LOOSE))
    ]
    return F.concat(*parts)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _passes(kind: Column, match: Column) -> Column:
    """The test of a base pattern's match."""
    n = F.char_length(_digits(match))
    small = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    tests = {
        "email": F.lit(True),
        "ip": match.rlike(rf"^{small}\.{small}\.{small}\.{small}$"),
        "card": n.between(14, 19) & F.call_function("luhn_check", _digits(match)),
        "phone": n.between(10, 15),
    }
    chosen = F.lit(False)
    for number, name in enumerate(KINDS):
        chosen = F.when(kind == number, tests[name]).otherwise(chosen)
    return chosen


def candidates(docs: DataFrame) -> DataFrame:
    """All proposed spans: doc_id, key (the text's hash), kind, base, start, end, match, before, after, passed."""
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.explode(_proposed(F.col("text"))).alias("c"))
    rows = rows.select("doc_id", "key", "c.*").dropDuplicates(["doc_id", "key", "kind", "base", "i"])
    order = Window.partitionBy("doc_id", "key", "kind", "base").orderBy("i")
    upto, wide = order.rowsBetween(Window.unboundedPreceding, 0), F.char_length("match")
    end = F.sum("gap").over(upto) + F.sum(wide).over(upto)
    rows = rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - wide)
    return rows.withColumn("passed", F.col("base") & _passes(F.col("kind"), F.col("match"))).drop("i", "gap")


def _over_base(rows: DataFrame) -> DataFrame:
    """Adds on_own, on_other: whether a span overlaps a base span of its own or of another kind."""
    by_doc = Window.partitionBy("doc_id", "key")
    before = by_doc.orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    # a frame that grows takes linear time; one that shrinks is worked out anew for each row
    after = by_doc.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1)
    own, other = F.lit(False), F.lit(False)
    for number in range(len(KINDS)):
        is_base = F.col("passed") & (F.col("kind") == number)
        reaches = F.coalesce(F.max(F.when(is_base, F.col("end"))).over(before) > F.col("start"), F.lit(False))
        begins = F.coalesce(F.min(F.when(is_base, F.col("start"))).over(after) < F.col("end"), F.lit(False))
        on = reaches | begins
        own = F.when(F.col("kind") == number, on).otherwise(own)
        other = other | (on & (F.col("kind") != number))
    return rows.withColumns({"on_own": own, "on_other": other})


def _features(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """``rows`` with a column for each feature, and the names of these."""
    match, before, after = F.col("match"), F.col("before"), F.col("after")
    digits = _digits(match)
    count = lambda pattern: F.regexp_count(match, F.lit(pattern)).cast("double")
    flag = lambda test: F.coalesce(test.cast("double"), F.lit(0.0))
    found = {
        "f_digits": F.char_length(digits).cast("double"),
        "f_spaces": count(r"\x20"),
        "f_dashes": count(r"-"),
        "f_dots": count(r"\.|dot|DOT"),
        "f_letters": count(r"[A-Za-z]"),
        "f_other": count(r"[^0-9A-Za-z\x20.@-]"),
        "f_luhn": flag(F.char_length(digits).between(2, 30) & F.call_function("luhn_check", digits)),
        "f_parts": flag(match.rlike(r"^(?:[^0-9]*0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?![0-9])){4}[^0-9]*$")),
        "f_plus": flag(before.endswith("+") | match.startswith("+")),
        "f_sign": flag(match.rlike(r"@|[(\[{](?:at|AT)[)\]}]")),
        "f_domain": flag(match.rlike(_DOMAIN)),
        "f_word_before": flag(before.rlike(r"[0-9A-Za-z]$")),
        "f_word_after": flag(after.rlike(r"^[0-9A-Za-z]")),
    }
    for number, kind in enumerate(KINDS):
        found[f"f_{kind}"] = flag(F.col("kind") == number)
        found[f"f_{kind}_hint"] = flag((F.col("kind") == number) & before.rlike(_HINTS[kind]))
    return rows.withColumns(found), list(found)


def _variants(rows: DataFrame) -> DataFrame:
    """Base spans with other separators, and the same spoilt: kind, label, match, before, after, held. All in linear time."""
    match, before = F.col("match"), F.col("before")
    put = F.regexp_replace
    bare, grouped = _digits(match), lambda digits, mark: put(digits, r"(.{4})(?=.)", f"$1{mark}")
    user, domain = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    first = F.substring_index(domain, ".", 1)
    wrong = F.concat(F.substring(bare, F.lit(1), F.char_length(bare) - 1), F.translate(F.right(bare, F.lit(1)), "0123456789", "1234567890"))
    far, many = put(match, r"(?<![0-9])[0-9]++$", "999"), put(match, r"^[0-9]++", "742")
    number = put(match, r"^\+", "")
    short = F.regexp_extract(number, r"^(?:[^0-9]*+[0-9]){8}", 0)
    signs = ((" (at) ", " (dot) "), ("[at]", "."), (" @ ", "."), ("(at)", "[.]"))
    written_out = lambda domain, at, dot: F.concat(user, F.lit(at), F.replace(domain, F.lit("."), F.lit(dot)))
    forms = {
        "email": [(label, written_out(d, at, dot), before) for label, d in ((1.0, domain), (0.0, first)) for at, dot in signs],
        "ip": [(label, put(ip, r"\.", dot), before) for label, ip in ((1.0, match), (0.0, far), (0.0, many)) for dot in ("[.]", " . ", "(.)")],
        "card": [(label, grouped(digits, mark), before) for label, digits in ((1.0, bare), (0.0, wrong)) for mark in (".", "_", "/")],
        "phone": [
            (label, put(n, r"[\x20().-]+", mark), F.concat(before, F.lit(plus)))
            for label, n, plus in ((1.0, number, "+"), (0.0, short, "+"), (0.0, number, ""))
            for mark in ("/", "_", " / ")
        ],
    }
    made = F.array().cast("array<struct<label:double,match:string,before:string>>")
    for n, kind in enumerate(KINDS):
        own = F.array(*(F.struct(F.lit(label).alias("label"), m.alias("match"), b.alias("before")) for label, m, b in forms[kind]))
        made = F.when(F.col("kind") == n, own).otherwise(made)
    rows = rows.select("kind", "after", "held", F.explode(made).alias("v"))
    return rows.select("kind", "v.label", "v.match", "v.before", "after", "held")


def _labelled(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """All candidates with a label, seeds and variants, counted: kind, label, held, the features, n; and the features' names."""
    no_email = (F.col("kind") == KINDS.index("email")) & ~F.col("match").rlike(_DOMAIN)
    label = F.when(F.col("on_own"), 1.0).when(F.col("on_other") | F.col("base") | no_email, 0.0)
    held = F.xxhash64("doc_id", "key", "start", "end", "base") % 2 != 0
    labelled = rows.withColumns({"label": label, "held": held}).filter("label IS NOT NULL")
    names = ["kind", "label", "match", "before", "after", "held"]
    seeds = [(n, 1.0, match, before, after, place % 2 == 1) for n, kind in enumerate(KINDS) for place, (before, match, after) in enumerate(SEEDS[kind])]
    seeds = rows.sparkSession.createDataFrame(seeds, "kind int, label double, match string, before string, after string, held boolean")
    sources = labelled.filter("passed").select(names).union(seeds)
    found, features = _features(labelled.select(names).union(seeds).union(_variants(sources).select(names)))
    return found.groupBy("kind", "label", "held", *features).agg(F.count(F.lit(1)).alias("n")), features


def _thresholds(checked: DataFrame) -> DataFrame:
    """kind, threshold; from how many of a kind's held-out candidates have each score (n), and how many of these are positive (good)."""
    down = Window.partitionBy("kind").orderBy(F.desc("score"))
    whole = Window.partitionBy("kind")
    checked = checked.withColumns(
        {
            "share": F.least(F.sum("good").over(down) / F.sum("n").over(down), F.col("good") / F.col("n")),
            "negatives": F.sum(F.col("n") - F.col("good")).over(whole),
            "border": (F.col("score") + F.lead("score", 1, 0.0).over(down)) / 2,
        }
    )
    return checked.filter((F.col("share") >= PRECISION) & (F.col("negatives") > 0)).groupBy("kind").agg(F.min("border").alias("threshold"))


def _scored(rows: DataFrame) -> DataFrame:
    """``rows`` with score and threshold."""
    labelled, features = _labelled(rows)
    labelled = written(labelled, "labelled")
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    fit, held = labelled.filter("NOT held"), labelled.filter("held")
    # a row for each kind and label
    totals = fit.groupBy("kind", "label").agg(F.sum("n").alias("total"))
    fit = fit.join(F.broadcast(totals), ["kind", "label"]).withColumn("weight", F.col("n") / F.col("total"))
    n_rows = fit.count()
    fit = assembler.transform(fit.orderBy("kind", "label", *features).coalesce(1 + n_rows // FIT_ROWS))
    # Spark looks for splits in a sample of more rows than the square of the bins
    bins = max(BINS, math.isqrt(n_rows) + 1)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=bins, seed=SEED, weightCol="weight").fit(fit)
    vectors = assembler.transform(_features(rows)[0]).drop(*features)
    score = vector_to_array("probability")[1]

    checked = trees.transform(assembler.transform(held)).select("kind", "label", "n", score.alias("score")).groupBy("kind", "score")
    least = _thresholds(checked.agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")))
    # a row for each kind at most
    return trees.transform(vectors).withColumn("score", score).drop("features", "rawPrediction", "probability", "prediction").join(F.broadcast(least), "kind")


def spans(docs: DataFrame) -> DataFrame:
    """The selected spans of ``docs`` (doc_id, text): doc_id, key, kind, start, end, base, score."""
    rows = written(_over_base(candidates(docs)), "candidates")
    names = ["doc_id", "key", "kind", "start", "end"]
    base = rows.filter("passed").select(*names, F.lit(True).alias("base"), F.lit(1.0).alias("score"))
    added = _scored(rows).filter("NOT base AND NOT on_own AND NOT on_other AND score >= threshold").select(*names, "score")
    order = Window.partitionBy("doc_id", "key").orderBy("start", "end", "kind")
    apart = F.col("start") >= F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    added = added.distinct().withColumn("apart", apart.cast("int"))
    added = added.withColumn("island", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy("doc_id", "key", "island").orderBy(F.desc("score"), "start", F.desc("end"), "kind")
    added = added.withColumn("place", F.row_number().over(best)).filter("place = 1")
    return base.union(added.select(*names, F.lit(False), "score"))


def found_in(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``spans`` (start, kind as a place in KINDS, end, base, score), in order, of each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    by_doc = spans(docs).groupBy(F.col("doc_id").alias("of_id"), F.col("key").alias("of_key"))
    by_doc = by_doc.agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "base", "score"))).alias("spans"))
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (text_key(F.col("text")) == F.col("of_key"))
    nothing = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,base:boolean,score:double>>")
    return docs.join(by_doc, same, "left").select("doc_id", "text", F.coalesce("spans", nothing).alias("spans"))


def summary(docs: DataFrame) -> DataFrame:
    """Counts and digests of ``found_in``; the counts are those of the base spans."""
    kinds = F.array(*map(F.lit, KINDS))

    def listed(found: Column) -> Column:
        return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])))

    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda n: F.size(F.filter(base, lambda s: s["kind"] == n)).cast("long")
    counts = [of_kind(n).alias(f"n_{kind}") for n, kind in enumerate(KINDS)]
    return found_in(docs).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
