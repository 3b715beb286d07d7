"""The pipeline, stage by stage against brute force, and as a whole."""

import collections
import hashlib
import re

import corpus_pipeline
import pytest
from corpus_cases import CLASHING, ODD_TEXTS, SF, documents, table
from test_brute import brute_components, lowered

from emberwatch.llm import common, quality_rules

SPACES = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def stages(spark):
    """What every stage was given and what it returned, as rows."""
    common.tune_for_texts(spark)
    docs, seen = documents(spark), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = common.written(stage(spark, docs, SF), "stage")
        seen.append((name, docs.collect(), after.collect()))
        if name != "byte-level BPE":
            assert after.columns == columns
        docs = after
    return {name: (before, after) for name, before, after in seen}


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-duplicates", "benchmark decontamination", "byte-level BPE"]


def test_quality(spark, stages):
    before, after = stages["quality rules"]
    kept = {r.doc_id for r in quality_rules.summary(documents(spark)).filter("kept").collect()}
    assert {r.doc_id for r in after} == kept < {r.doc_id for r in before}
    whole = {r.doc_id: r.text.split("\n") for r in before}
    for r in after:
        lines = iter(whole[r.doc_id])
        assert all(x in lines for x in r.text.split("\n")) and r.n_chars == len(r.text)


def test_lines(stages):
    before, after = stages["line dedup"]
    key = lambda x: lowered(x.strip(SPACES))
    having = collections.Counter(k for r in before for k in {key(x) for x in r.text.split("\n")})
    left = {r.doc_id: "\n".join(x for x in r.text.split("\n") if not key(x) or having[key(x)] < 10) for r in before}
    assert {r.doc_id: r.text for r in after} == left
    assert all(r.n_chars == len(r.text) for r in after)


def test_near(stages):
    before, after = stages["near-duplicates"]
    found = brute_components({r.doc_id: r.text for r in before})
    assert sorted(r.doc_id for r in after) == sorted(i for i, (_, c) in found.items() if i == c)


def test_benchmark(spark, stages):
    before, after = stages["benchmark decontamination"]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + min(len(w), 10)]) for i in range(max(len(w) - 9, 1)) if w}
    sizes = {len(w) for w in windows}
    clean = [r.doc_id for r in before if not any(tuple(w[i : i + n]) in windows for w in [words(r.text)] for n in sizes for i in range(len(w) - n + 1))]
    assert sorted(r.doc_id for r in after) == sorted(clean)


def test_tokens(stages):
    before, after = stages["byte-level BPE"]
    texts = {r.doc_id: r.text for r in before}
    assert {r.doc_id for r in after} == set(texts)
    for r in after:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert len(r.ids) == 4 * r.n_tokens


def test_run(spark, stages):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in rows) == sorted((r.doc_id, r.ids_sha256) for r in stages["byte-level BPE"][1])


@pytest.mark.parametrize("rows", [ODD_TEXTS, []], ids=["odd", "empty"])
@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, rows, name, stage):
    """Nulls, empty, long and repeated texts, columns named like the operators' own: kept rows come through whole."""
    docs = table(spark, rows, [*CLASHING, "n_chars", "row", "gone", "kept_text", "clean_text", "of_id", "text_key"])
    after = stage(spark, docs, SF)
    found = after.collect()
    if name == "byte-level BPE":
        assert collections.Counter(r.doc_id for r in found) == collections.Counter(i for i, _ in rows)
        return
    assert after.columns == docs.columns
    assert all(r[c] == "x" for r in found for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    kept = collections.Counter(r.doc_id for r in found)
    assert not kept - collections.Counter(i for i, _ in rows)
    if name in ("line dedup", "benchmark decontamination"):
        assert kept.total() == len(rows)
