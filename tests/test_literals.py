"""Many literals in one pass, and literals under any single-byte key, against plain search."""

import random

import pytest
from pyspark.sql import functions as F

from emberwatch.operators import docscan, signatures
from emberwatch.operators.grams import found_grams, rarest


def test_literals_found_through_grams(spark):
    pick = random.Random(8)
    letters = "aab bc.é😀\n"
    texts = ["".join(pick.choice(letters) for _ in range(pick.choice([0, 3, 40, 400]))) for _ in range(120)] + [None, "", "a\0bcd", "😀" * 9]
    needles = sorted({"".join(pick.choice(letters) for _ in range(pick.randint(1, 7))) for _ in range(150)} | {"a\0bc", "zzzzzz", "😀😀😀😀"})
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {r.id: sorted(r.hits) for r in rows.select("id", signatures.hits(F.col("text"), needles).alias("hits")).collect()}
    assert found == {i: [n for n, x in enumerate(needles) if x in (t or "")] for i, t in enumerate(texts)}
    assert len({n for x in found.values() for n in x}) > 40


def test_no_literals(spark):
    row = spark.createDataFrame([("abcdef",)], "text string")
    assert row.select(found_grams(F.col("text"), []), signatures.hits(F.col("text"), [])).first()[:] == ([], [])
    assert rarest("abc", {}) is None


def test_signatures_against_plain_files(spark):
    pick = random.Random(3)
    words = [f"word{i}" for i in range(40)] + ["ab", "x"]
    rows = [(i, pick.choice(["f", "f", "f", "g", "", None]), " ".join(pick.sample(words, 6))) for i in range(60)]
    events = spark.createDataFrame(rows, "id long, file string, text string")
    many = [signatures.Signature(f"s{i}", pick.choice(words), tuple(pick.sample(words, 4)), pick.randint(1, 4), tuple(pick.sample([*words, "nothing"], i % 3))) for i in range(80)]
    text = signatures.event_text([F.col("text")])
    files = signatures.scan(events, many, "file", text)
    bodies = {}
    for _, file, own in rows:
        bodies.setdefault(file or signatures.NO_FILE, []).append(own)
    plain = set()
    for s in many:
        for file, own in bodies.items():
            has = lambda x: any(x in t for t in own)  # noqa: B023, E731
            literals = [x for x in s.literals if has(x)]
            if has(s.anchor) and not any(map(has, s.exclusions)) and len(literals) >= s.min_matches:
                plain.add((s.rule_id, file, len(own), tuple(literals)))
    found = {(r.rule_id, r.source_file, r.event_count, tuple(r.matched_literals)) for r in files.collect()}
    assert found == plain and len(plain) > 20
    passed = {(s, f) for s, f, *_ in plain}
    alone = signatures.enough_by_itself(events, files, many, "file", text, "id").collect()
    expected = set()
    for s in many:
        for i, file, own in rows:
            literals = tuple(x for x in s.literals if x in own)
            if (s.rule_id, file or signatures.NO_FILE) in passed and len(literals) >= s.min_matches and not any(x in own for x in s.exclusions):
                expected.add((s.rule_id, i, literals))
    assert {(r.rule_id, r.id, tuple(r.event_literals)) for r in alone} == expected and len(alone) == len(expected) > 10


def test_any_single_byte_key(spark):
    plain = [b"some secret text", b"SECRET and secret", b"sec", b"", bytes(range(256)) * 3 + b"secret"]
    rows = [(k * 10 + i, bytearray(b ^ k for b in own), k) for k in (0, 1, 32, 127, 128, 255) for i, own in enumerate(plain)] + [(999, None, 5)]
    frame = spark.createDataFrame(rows, "id long, content binary, key int")
    found = frame.select(
        "id", docscan.xor_places(F.col("content"), "secret").alias("places"), docscan.xor_keys(F.col("content"), "secret").alias("keys"),
        docscan.encoded(F.col("content"), "secret", ["xor"], range(32, 33)).alias("one"), docscan.xored(F.col("content"), F.col("key")).alias("back"),
    )
    for r, (_, content, key) in zip(found.orderBy("id").collect(), sorted(rows, key=lambda x: x[0])):
        if content is None:
            assert r.places is None and r.back is None
            continue
        places = [(i, k) for i in range(len(content)) for k in range(256) if bytes(b ^ k for b in content[i : i + 6]) == b"secret"]
        assert [(p.at, p.key) for p in r.places] == places
        assert r.keys == sorted({k for _, k in places if k}) and r.one == (32 in r.keys)
        assert bytes(r.back) == bytes(b ^ key for b in content)
    with pytest.raises(ValueError):
        docscan.xor_places(F.col("content"), "s")
