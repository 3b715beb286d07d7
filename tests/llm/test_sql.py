"""Operators against their SQL on tables that hold what the driver's tables lack."""

import duckdb
import pyarrow as pa
import pytest
from corpus_cases import table

from emberwatch.llm import common, line_dedup, quality_rules

PROSE = " ".join(f"word{i}" for i in range(60))


def of_sql(sql, rows):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}))
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return {row[names.index("doc_id")]: dict(zip(names, row, strict=True)) for row in found.fetchall()}


NOTICES = [
    f"{PROSE} and a click here opens it, {PROSE}.",
    f"{PROSE}.\nPlease click here to go on.",
    f"{PROSE}.\nBy use of this site you accept our Terms of Use and the Privacy Policy of ours.",
    f"{PROSE}.\nclick here click here " + "and so on we go " * 4,
    "one two three four five six seven click here ten",
    "one two three four five six seven eight click here eleven twelve thirteen fourteen fifteen",
    f"{PROSE}.\n" + "Menu\nHome | About | Contact | Login\n" * 20,
    f"{PROSE}.\nthe the the the the the the",
    None,
]


def test_notices_as_in_the_sql(spark):
    common.tune_for_texts(spark)
    rows = list(enumerate(NOTICES))
    found = {r.doc_id: r.asDict() for r in quality_rules.summary(table(spark, rows)).collect()}
    assert found == of_sql(quality_rules.ORACLE, rows)
    assert found[0]["lost"] == 0 < found[1]["lost"]


@pytest.mark.parametrize("copies, dropped", [(9, 0), (10, 1)])
def test_repeated_rows_are_one_document(spark, copies, dropped):
    """Rows of one id count once in SQL and in the operator; other ids make up the rest."""
    common.tune_for_texts(spark)
    rows = [(7, "Shared line\nown 7")] * 12 + [(100 + i, f" shared LINE\t\nown {i}") for i in range(copies - 1)]
    found = {r.doc_id: r for r in line_dedup.summary(table(spark, rows)).collect()}
    expected = of_sql(line_dedup.ORACLE, sorted(set(rows)))
    assert {i: (r.n_lines, r.n_dropped, r.kept_sha256) for i, r in found.items()} == {
        i: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for i, r in expected.items()
    }
    assert {r.n_dropped for r in found.values()} == {dropped}


def test_rows_without_id_are_documents(spark):
    common.tune_for_texts(spark)
    rows = [(None, f"shared\nown {i}") for i in range(10)]
    assert {r.n_dropped for r in line_dedup.summary(table(spark, rows)).collect()} == {1}


def test_names_with_dots(spark):
    common.tune_for_texts(spark)
    docs = table(spark, [(1, f"{PROSE}."), (2, None)], ["a.b", "c`d", "e f"])
    for result in (line_dedup.drop_lines(docs), quality_rules.cleaned(docs)):
        rows = result.collect()
        assert result.columns == docs.columns and all(r["a.b"] == r["c`d"] == r["e f"] == "x" for r in rows)
