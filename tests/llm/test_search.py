"""Fingerprints, hard negatives and lexical search against plain versions, and their edge cases."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from corpus_cases import CLASHING, LONG, ODD_TEXTS, RUN, by_id, documents, table
from pyspark.sql import functions as F

from emberwatch.llm import common, hard_negatives, lexical_search, spot_signatures

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    common.tune_for_texts(spark)
    return documents(spark).select("doc_id", "text")


# fingerprints


def plain_signatures(text):
    words = TERMS.findall(lowered(text))
    digest = lambda parts: hashlib.md5(" ".join(parts).encode()).hexdigest()[: spot_signatures.DIGITS]
    content = [i for i, w in enumerate(words) if w not in spot_signatures.ANCHORS]
    found = set()
    for j, i in enumerate(content):
        if i and words[i - 1] in spot_signatures.ANCHORS:
            found.add(digest([words[i - 1], *(words[x] for x in content[j : j + spot_signatures.CHAIN])]))
    return sorted(found) if found else [digest(words)] if words else []


def plain_likeness(a, b):
    return 1.0 if a == b else len(set(a) & set(b)) / len(set(a) | set(b))


def check_fingerprints(rows, texts):
    """``texts`` are (doc_id, text), distinct ids, as the query orders them."""
    ordered = sorted(texts, key=lambda r: -r[0])
    for (i, text), (_, behind) in zip(ordered, ordered[1:] + ordered[:1]):
        text, behind, row = text or "", behind or "", rows[i]
        k = len(text) // 3
        changed = text[: len(text) - k] + behind[:k]
        a, b, c = (plain_signatures(t) for t in (text, changed, behind))
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (row.fingerprint, row.edited_fingerprint) == ("".join(a), "".join(b))
        assert row.near_edited == pytest.approx(plain_likeness(a, b)) and row.near_next == pytest.approx(plain_likeness(a, c))


def test_fingerprints(docs):
    check_fingerprints(by_id(spot_signatures.summary(docs).collect()), [tuple(r) for r in docs.collect()])


HARD = [(1, None), (2, ""), (3, "the"), (4, "the of THE"), (5, "word"), (6, "the word"), (7, "the big of house é中😀 and the"), (8, LONG), (9, RUN), (10, "the word"), (-4, "😀" * 50)]


def test_fingerprints_of_odd_texts(spark, docs):
    rows = by_id(spot_signatures.summary(table(spark, HARD, CLASHING)).collect())
    check_fingerprints(rows, HARD)
    assert rows[6].fingerprint == rows[10].fingerprint and rows[1].fingerprint == rows[2].fingerprint == ""
    only = spot_signatures.summary(table(spark, [(7, "the one of a kind")])).first()
    assert (only.near_next, only.near_edited < 1) == (1.0, True)


def test_order_goes_over_all_ranges(spark, docs):
    rows = [(i, f"{i}") for i in random.Random(2).sample(range(-(10**12), 10**12), 997)]
    keyed = table(spark, rows).withColumn("key", common.text_key(F.col("text"))).select("doc_id", "key")
    found = {r.doc_id: r.next_id for r in spot_signatures.following(keyed.repartition(7)).collect()}
    ordered = sorted((i for i, _ in rows), reverse=True)
    assert found == dict(zip(ordered, ordered[1:] + ordered[:1]))


def test_similar_fingerprints(spark, docs):
    pick = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    base = [[w for _ in range(40) for w in ("the", pick.choice(words), pick.choice(words))] for _ in range(12)]
    rows = []
    for n, own in enumerate(base):
        for copy in range(8):
            changed = [w if pick.random() > copy / 60 else pick.choice(words) for w in own]
            rows.append((n * 10 + copy, " ".join(changed[: len(changed) - copy * 2])))
    rows += [(900, ""), (901, None), (902, rows[0][1]), (903, "the same"), (904, "the same")]
    members, sets = spot_signatures.classes(table(spark, rows))
    of = {r.doc_id: r.of for r in members.collect()}
    assert of[902] == of[0] and of[903] == of[904] and of[900] == of[901]
    found = {(r.of, r.other): r.likeness for r in spot_signatures.similar(sets, sets).collect()}
    plain = {}
    for i, a in rows:
        for j, b in rows:
            x, y = plain_signatures(a), plain_signatures(b)
            if of[i] != of[j] and x and y and plain_likeness(x, y) >= spot_signatures.LEAST:
                plain[of[i], of[j]] = plain_likeness(x, y)
    assert found == pytest.approx(plain) and len(plain) > 50


# hard negatives


def vectors(spark, rows, extra=()):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for c in extra:
        frame = frame.withColumn(c, frame.label)
    return frame


def plain_negatives(rows):
    own = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    found = []
    for i, v, label in own:
        if i % 50:
            continue
        ranked = sorted((-score(v, w), j, other) for j, w, other in own if j != i)
        for place, (s, j, _) in enumerate([x for x in ranked if x[2] == label][:5], 1):
            band = [(k, -t) for t, k, other in ranked if other != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            found += [(i, j, rank, k, -s, t, place) for rank, (k, t) in enumerate(band, 1)]
    return collections.Counter(found)


def mined(frame):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank"]
    return collections.Counter(tuple(r[n] for n in names) for r in hard_negatives.summary(frame).collect())


def test_scores_are_inner_products():
    pick = np.random.default_rng(1)
    for low, high, width in ((-128, 128, 64), (0, 1, 8), (-1, 1, 16), (-(2**40), 2**40, 24), (5, 9, 40)):
        a, c = pick.integers(low, high, (7, width)), pick.integers(low, high, (50, width))
        planes = hard_negatives.bit_planes(c)
        tables = hard_negatives.subset_sums(a.astype(hard_negatives._number(a, len(planes))))
        assert (hard_negatives.scores(tables, planes) == c @ a.T).all()


@pytest.mark.parametrize("width, scale", [(64, 0.2), (3, 1.0), (12, 40.0)])
def test_hard_negatives(spark, docs, width, scale):
    pick = np.random.default_rng(width)
    # few different numbers, so scores tie
    values = np.round(pick.normal(0, scale, (700, width)) * 8) / 8
    rows = [(int(i), [float(x) for x in v], int(pick.integers(0, 10))) for i, v in zip(pick.permutation(1400)[:700], values)]
    found = mined(vectors(spark, rows, CLASHING))
    assert found == plain_negatives(rows) and sum(found.values()) > 30


def test_hard_negatives_of_odd_rows(spark, docs):
    nan, inf = float("nan"), float("inf")
    rows = [(50, [1.0, 0.5], 1), (51, [1.0, 0.4], 1), (52, [0.8, 0.1], 2), (53, None, 2), (54, [0.9, nan], 2), (55, [inf, 0.0], 2), (57, [None, 1.0], 2), (58, [0.7], 3)]
    rows += [(59, [], 3), (None, [1.0, 1.0], 2), (60, [1.0, 1.0], None), (52, [0.8, 0.1], 2), (50, [1.0, 0.5], 1), (100, [0.0, 0.0], 7), (61, [0.8, 0.1, 9.0], 2)]
    found = mined(vectors(spark, rows))
    assert found == plain_negatives(rows) and found
    assert not mined(vectors(spark, [])) and not mined(vectors(spark, [(50, [1.0], 1)])) and not mined(vectors(spark, [(51, [1.0], 1), (52, [1.0], 2)]))


def test_hot_vector(spark, docs):
    """A third of all rows are one vector with one label."""
    rows = [(i, [0.5, 0.25, 0.0], 4) for i in range(1, 200)] + [(i, [0.4, (i % 9) / 9, 0.1], i % 10) for i in range(200, 600)]
    assert mined(vectors(spark, rows)) == plain_negatives(rows)


# lexical search


def plain_ranking(texts, items):
    counts = [(i, collections.Counter(TERMS.findall(lowered(t)))) for i, t in texts]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    found = []
    for item, text in set(items):
        scored = []
        for i, c in counts:
            m = 10 + (90 * c.total() * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERMS.findall(lowered(text))) if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        found += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:10], 1)]
    return collections.Counter(found)


def ranking(docs, items, **options):
    return collections.Counter(tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in lexical_search.ranked(docs, items, **options).collect())


def items(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, score string")


@pytest.mark.parametrize("settings", [{}, {"WINDOW": 16, "SHORT_SHARE": 0.02}, {"SHARD_DOCS": 40, "WINDOW": 8, "SHORT_SHARE": 0.3}, {"SHORT_SHARE": 1.0}, {"SHORT_SHARE": 0.0}], ids=str)
def test_search(docs, spark, settings, monkeypatch):
    """Skewed words, ties and hot words, with windows and shards of several sizes, in one task."""
    for name, value in settings.items():
        monkeypatch.setattr(lexical_search, name, value)
    pick = random.Random(9)
    words = [f"w{int(300 * pick.random() ** 3)}" for _ in range(3000)]
    texts = [(i, " ".join(pick.choice(words) for _ in range(pick.choice([1, 5, 30, 200])))) for i in range(400)]
    texts += [(i, "w0 same text") for i in range(400, 600)]
    asked = [(i, " ".join(pick.choice(words) for _ in range(12))) for i in range(30)] + [(77, "same w0"), (78, "w0")]
    query = plain_query(asked, texts)
    best = [lexical_search.Best() for _ in asked]
    rows = list(query.rows)
    for a in range(0, len(rows), lexical_search.SHARD_DOCS):
        shard = lexical_search.Shard(query.query, rows[a : a + lexical_search.SHARD_DOCS])
        for i, own in enumerate(best):
            lexical_search.search(shard, query.query.terms[query.query.offsets[i] : query.query.offsets[i + 1]], own)
    found = collections.Counter((asked[i][0], rank, int(d), int(s)) for i, b in enumerate(best) for rank, (d, s) in enumerate(zip(b.doc_id, b.score), 1))
    assert found == plain_ranking(texts, asked)


def plain_query(asked, texts):
    """A query and one-document rows as the operator's tasks see them."""
    own = [sorted(set(TERMS.findall(lowered(t)))) for _, t in asked]
    terms = sorted({t for x in own for t in x})
    place = {t: i for i, t in enumerate(terms)}
    counts = [(i, collections.Counter(TERMS.findall(lowered(t)))) for i, t in texts]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    weights = np.array([lexical_search._weight(n_docs, sum(t in c for _, c in counts)) for t in terms], np.int64)
    offsets = np.cumsum([0, *map(len, own)])
    query = lexical_search.Query(weights, np.arange(len(asked)), offsets, np.array([place[t] for x in own for t in x]), n_docs, n_terms)
    rows = []
    for i, c in counts:
        seen = sorted((place[t], n) for t, n in c.items() if t in place)
        pairs = np.array(seen, np.int32).reshape(-1, 2)
        rows.append((np.array([i]), np.array([False]), np.array([c.total()]), np.array([len(seen)]), pairs[:, 0], pairs[:, 1]))
    return collections.namedtuple("Plain", "query rows")(query, rows)


def test_search_of_documents(docs, spark):
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plain = plain_ranking([tuple(r) for r in docs.collect()], [tuple(r) for r in asked.collect()])
    assert ranking(docs, asked) == plain
    assert ranking(docs, asked, block_terms=100) == plain


def test_search_of_odd_tables(spark, docs):
    asked = [(1, "words the text"), (1, "words the text"), (1, "another text"), (2, None), (3, ""), (4, "!"), (5, "nowhere"), (None, "line LINE Line one"), (6, LONG), (7, RUN)]
    found = ranking(table(spark, ODD_TEXTS, CLASHING), items(spark, asked))
    assert found == plain_ranking(ODD_TEXTS, [a for a in asked if a[1] is not None])
    assert not ranking(table(spark, []), items(spark, asked)) and not ranking(table(spark, ODD_TEXTS), items(spark, []))
    assert not ranking(table(spark, [(1, None), (2, "")]), items(spark, asked))
