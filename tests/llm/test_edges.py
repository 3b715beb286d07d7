"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from collections import Counter

import public_tokenizers
import pytest
from corpus_cases import CLASHING, LONG, ODD_TEXTS, RUN, table

from emberwatch.llm import byte_bpe, common, decontamination, line_dedup, lm_scoring, near_dedup, pii, quality_rules, secret_scan, spot_signatures, token_counts, url_filters

RANKS, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def _items(docs):
    return docs.sparkSession.createDataFrame([(7, "the very same table, word"), (8, None), (9, "!"), (None, "one two three")], "item_id long, text string")


def _labels(docs):
    return docs.sparkSession.createDataFrame([(4, 1, 0), (4, 0, 0), (6, 1, 0), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "pii": pii.summary,
    "line_dedup": line_dedup.summary,
    "lm_scoring": lambda d: lm_scoring.scored(d, _labels(d)),
    "token_counts": lambda d: token_counts.counted(d, PIECES),
    "quality_rules": quality_rules.summary,
    "decontamination": lambda d: decontamination.summary(d, _items(d)),
    "secret_scan": secret_scan.summary,
    "byte_bpe": lambda d: byte_bpe.summary(d, RANKS, public_tokenizers.PATTERN),
    "near_dedup": near_dedup.near_duplicates,
    "spot_signatures": spot_signatures.summary,
}


@pytest.fixture(scope="module")
def results(spark):
    common.tune_for_texts(spark)
    docs = table(spark, ODD_TEXTS, CLASHING)
    return {name: run(docs).collect() for name, run in OPERATORS.items()}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(results, name):
    assert Counter(r.doc_id for r in results[name]) == Counter(i for i, _ in ODD_TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_rows_agree(results, name):
    first, second = (r for r in results[name] if r.doc_id == 10)
    assert first == second


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, empty, name):
    common.tune_for_texts(spark)
    assert OPERATORS[name](empty).collect() == []


def test_values(results):
    at = lambda name, i: next(r for r in results[name] if r.doc_id == i)
    assert (at("line_dedup", 1).n_lines, at("line_dedup", 2).n_lines, at("line_dedup", 8).n_lines) == (1, 1, 4)
    assert at("line_dedup", 6).n_dropped == 0
    assert [at("quality_rules", i).n_words for i in (1, 2, 3, 4)] == [0, 0, 0, 3]
    assert not any(at("quality_rules", i).kept for i in (1, 2, 3))
    assert [at("token_counts", i).n_tokens for i in (1, 2)] == [0, 0]
    assert [at("byte_bpe", i).n_tokens for i in (1, 2)] == [0, 0]
    assert at("lm_scoring", 1).score is None and at("lm_scoring", 4).score is not None
    assert (at("pii", 12).n_email, at("pii", 12).n_ip, at("pii", 12).n_card, at("pii", 12).n_phone) == (1, 1, 1, 1)
    assert at("secret_scan", 12).spans.startswith("assign:")
    hit = at("decontamination", 10)
    assert (hit.n_hit, hit.n_items, hit.contaminated) == (5, 1, True)
    assert not at("decontamination", 4).contaminated


def test_near_groups(results):
    rows = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in results["near_dedup"]]
    # equal words in other case are one set; rows that share an id share what they link to
    assert (5, 1, 4, False) in rows and (4, 1, 4, True) in rows
    assert {c for i, _, c, _ in rows if i in (10, 11) and c != 11} == {10}
    assert [(n, c, k) for i, n, c, k in rows if i is None] == [(9, None, True), (0, None, True)] or [
        (n, c, k) for i, n, c, k in rows if i is None
    ] == [(0, None, True), (9, None, True)]
    assert (2, 0, 2, True) in rows


def test_long_texts(results):
    at = lambda name, i: next(r for r in results[name] if r.doc_id == i)
    assert at("quality_rules", 6).n_words == len(LONG.split()) == at("decontamination", 6).n_words
    assert at("quality_rules", 7).word_chars == len(RUN)
    assert at("line_dedup", 6).n_lines == 9000


def test_url_edges(spark):
    rows = [
        (1, None), (2, ""), (3, "example.org/es/"), (4, "http://EXAMPLE.org/es/x?y#z"), (5, "x://example.org"), (6, "x://notexample.org/es/"),
        (7, "x://a.b.example.org/en/12"), (8, "x://example.org?/es/"), (9, "x://com/de/a"), (9, "x://com/de/a"), (None, "x://y.com/fr/" + "a" * 100_000),
        (10, "x://" + "a." * 20_000 + "org/"), (11, "x://" + "/" * 50_000),
    ]
    pages = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "page_id long, url string, prefix string, rule string, digest string")
    found = [(r.page_id, r.rule, r.verdict) for r in url_filters.judged(pages, url_filters.RULES, default="block").collect()]
    assert Counter(found) == Counter(
        [
            (1, None, "block"), (2, None, "block"), (3, None, "block"), (4, "example.org/es/", "block"), (5, None, "block"), (6, "org/", "allow"),
            (7, "example.org/en/1", "block"), (8, None, "block"), (9, "com/de/", "block"), (9, "com/de/", "block"), (None, "com/fr/", "allow"),
            (10, "org/", "allow"), (11, None, "block"),
        ]
    )
    assert url_filters.judged(pages.limit(0), url_filters.RULES).collect() == []
    assert {r.verdict for r in url_filters.judged(pages, []).collect()} == {"allow"}


def test_url_ties_and_order(spark):
    Rule = url_filters.Rule
    pages = spark.createDataFrame([(1, "x://a.b/cd")], "page_id long, url string")
    pick = lambda *rules: url_filters.judged(pages, rules).first()
    assert pick(Rule("allow", "b", "/cd"), Rule("block", "a.b", "/")).rule == "a.b/"
    assert pick(Rule("allow", "a.b", "/c"), Rule("block", "a.b", "/c")).verdict == "block"
    assert pick(Rule("allow", "b", "/cd"), Rule("block", "a.b", "/c")).rule == "a.b/c"


def test_notice_in_a_long_line(spark):
    prose = " ".join(f"word{i}" for i in range(60))
    one_line = f"{prose} and a click here opens it, {prose.replace('word', 'term')}."
    texts = {1: one_line, 2: f"{one_line}\nMore of the same.", 3: f"{prose}.\nPlease click here to go on.", 4: f"{prose}.\nBy use of this site you accept our Terms of Use and the Privacy Policy of ours."}
    kept = {r.doc_id: r.text for r in quality_rules.cleaned(table(spark, list(texts.items()))).collect()}
    assert kept == {1: texts[1], 2: texts[2], 3: f"{prose}.", 4: f"{prose}."}
