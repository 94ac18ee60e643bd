import hashlib

import pytest

from civictopics.llm import digest as dg


def brute(rows):
    rows = sorted(rows, key=lambda r: r[0])
    out = {}
    for (doc_id, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        own, new, nxt = (dg.digest(t.encode()) for t in (text, edited, after))
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), own.tobytes().hex(), new.tobytes().hex(),
                       dg.likeness(own, new), dg.likeness(own, nxt))
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_equal_to_brute_force(spark, parts):
    rows = [(i * 7 % 31, ("été %d, " % i) * (i * i % 23)) for i in range(31)]
    rows[3], rows[4], rows[5] = (rows[3][0], None), (rows[4][0], ""), (rows[5][0], "x" * 60_000)
    df = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, fingerprint string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r[0]: tuple(r[1:]) for r in dg.fingerprints(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == brute(rows)


def test_one_row_no_row_and_repeated_rows(spark):
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in dg.fingerprints(one).collect()] == [
        (5, 8, hashlib.sha256(b"abcdefab").hexdigest())]
    assert dg.fingerprints(one.limit(0)).count() == 0
    twice = one.union(one).union(one.selectExpr("cast(null as long)", "text"))
    assert dg.fingerprints(twice).count() == 3


def test_likeness_is_bounded_and_orders():
    texts = [b"", b"ab", b"the quick brown fox jumps over the lazy dog " * 20, b"completely unrelated 1234567890 !?" * 30]
    for a in texts:
        assert dg.likeness(dg.digest(a), dg.digest(a)) == 1.0
        for b in texts:
            assert 0.0 <= dg.likeness(dg.digest(a), dg.digest(b)) <= 1.0
    near = texts[2][:-80] + b"and something else at the end of it"
    assert dg.likeness(dg.digest(texts[2]), dg.digest(near)) > dg.likeness(dg.digest(texts[2]), dg.digest(texts[3]))
