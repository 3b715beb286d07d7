"""op2's trees and thresholds see every candidate that has a label, and variants of every base span, of any length."""

from corpus_cases import by_id, table
from pyspark.sql import functions as F

from emberwatch.llm import pii

N = 1500
TEXTS = [(i, f"host 10.0.{i // 250}.{i % 250} up, see 10.0.{i // 250}.{i % 250 + 300}") for i in range(N)]
LONG = "a." * 20_000 + "b@" + "c." * 20_000 + "org"


def test_no_candidate_is_left_out(spark, monkeypatch):
    fitted = []

    class Recording(pii.GBTClassifier):
        def fit(self, rows, *params):
            columns = rows.columns
            number = F.col("n") if "n" in columns else F.lit(1)
            fitted.append((rows.groupBy("kind", "label").agg(F.sum(number).alias("n")).collect(), self.getMaxBins(), rows.count()))
            return super().fit(rows, *params)

    monkeypatch.setattr(pii, "GBTClassifier", Recording)
    rows = by_id(pii.summary(table(spark, TEXTS)).collect())
    assert all(rows[i].n_ip == 1 for i in range(N))
    counts, bins, n_rows = fitted[0]
    ips = {r.label: r.n for r in counts if r.kind == pii.KINDS.index("ip")}
    # each text has a base span, found by both generators, and one that fails: with variants, positive 2 + 3, negative 1 or 2 + 6; half of all
    assert abs(ips[1.0] - 5 * N / 2) < N / 4 and abs(ips[0.0] - 8 * N / 2) < N
    # Spark takes all rows when it looks for splits
    assert bins**2 >= n_rows


def test_many_sure_spans_do_not_let_wrong_ones_in(spark):
    # kind 1: 3 of 1,003 are wrong, and all of one score; kind 2: 0.5 % of the lower score are wrong; kind 3 has no wrong one
    scores = [(1, 0.875, 1000.0, 1000), (1, 0.625, 0.0, 3), (1, 0.25, 0.0, 5), (2, 0.875, 100.0, 100), (2, 0.625, 199.0, 200), (2, 0.125, 0.0, 9), (3, 0.5, 9.0, 9)]
    found = pii._thresholds(spark.createDataFrame(scores, "kind int, score double, good double, n long")).collect()
    assert {r.kind: r.threshold for r in found} == {1: 0.75, 2: 0.375}


def test_all_labelled_rows_are_counted(spark):
    rows = pii._over_base(pii.candidates(table(spark, TEXTS).select("doc_id", "text")))
    labelled, _ = pii._labelled(rows)
    ips = {r.label: r.n for r in labelled.filter(F.col("kind") == pii.KINDS.index("ip")).groupBy("label").agg(F.sum("n").alias("n")).collect()}
    own = rows.filter(F.col("kind") == pii.KINDS.index("ip"))
    seeds = len(pii.SEEDS["ip"])
    passed, good = own.filter("passed").count(), own.filter("on_own").count()
    bad = own.filter("NOT on_own AND (on_other OR base)").count()
    assert passed == N and ips == {1.0: good + seeds + 3 * (passed + seeds), 0.0: bad + 6 * (passed + seeds)}


def test_variants_of_long_spans(spark):
    ip, phone = "0" * 40_000 + "1.2.3.4", "+1" + " " * 40_000 + "234567890"
    spans = [(0, "email", LONG), (1, "ip", ip), (3, "phone", phone), (0, "email", "x.y@mail.a.org")]
    rows = spark.createDataFrame([(k, m, "", "", False) for k, _, m in spans], "kind int, match string, before string, after string, held boolean")
    made = [(r.kind, r.label, r.match) for r in pii._variants(rows).collect()]
    assert len(made) == 8 + 9 + 9 + 8
    emails = [(label, m) for kind, label, m in made if kind == 0 and len(m) < 100]
    assert (1.0, "x.y (at) mail (dot) a (dot) org") in emails and (1.0, "x.y(at)mail[.]a[.]org") in emails
    assert (0.0, "x.y[at]mail") in emails and (0.0, "x.y (at) mail") in emails
    assert (1, 0.0, "742[.]2[.]3[.]4") in made and (1, 0.0, ip[:-1].replace(".", "[.]") + "999") in made
