import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

from civictopics.llm import rollup as ro
from civictopics.llm.common import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
CHANGES = "source string, lang string, tokenizer string, before long, after long, docs int"


def rows(df):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in df.collect()}


@pytest.fixture
def totals(spark, tmp_path):
    return ro.TokenRollup(spark, f"file://{tmp_path}/totals")


def test_signed_changes_and_repeated_batches(spark, totals):
    make = lambda *r: spark.createDataFrame([(*x, 1) for x in r], CHANGES)
    assert totals.totals().count() == 0
    assert totals.apply("a", make(("s", "en", "t1", None, 5), ("s", "en", "t1", None, 7), (None, None, "t1", None, 0)))
    first = {("s", "en", "t1"): (2, 12), (None, None, "t1"): (1, 0)}
    assert rows(totals.totals()) == first
    assert not totals.apply("a", make(("s", "en", "t1", None, 99))) and rows(totals.totals()) == first
    assert totals.apply("b", make(("s", "en", "t1", 5, 3), ("s", "en", "t2", None, 4), (None, None, "t1", 0, None), ("x", "y", "z", None, None)))
    assert rows(totals.totals()) == {("s", "en", "t1"): (2, 10), ("s", "en", "t2"): (1, 4)}
    assert totals.apply("empty", make().limit(0)) and totals.batches() == ["a", "b", "empty"]
    assert rows(totals.totals()) == {("s", "en", "t1"): (2, 10), ("s", "en", "t2"): (1, 4)}
    with pytest.raises(ValueError):
        totals.apply("../x", make())


def test_cut_off_batches_do_not_count(spark, totals, tmp_path):
    change = spark.createDataFrame([("s", "en", "t", None, 5, 1)], CHANGES)
    totals.apply("a", change)
    totals.apply("b", change)
    done = next(p for p in (tmp_path / "totals").iterdir() if p.name.endswith("-b"))
    (done / "_SUCCESS").unlink()
    assert totals.batches() == ["a"] and rows(totals.totals()) == {("s", "en", "t"): (1, 5)}
    assert totals.apply("b", change) and rows(totals.totals()) == {("s", "en", "t"): (2, 10)}


def test_stream_of_changes(spark, totals, tmp_path):
    folder = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([("s", "en", "t", None, i, 1)], CHANGES).coalesce(1).write.mode("append").parquet(folder)
    for _ in range(2):
        stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(folder)
        query = totals.follow(stream, "s", str(tmp_path / "checkpoint"))
        query.processAllAvailable()
        query.stop()
    assert rows(totals.totals()) == {("s", "en", "t"): (3, 3)}


def test_life_of_documents(spark):
    docs = [("s1", "en", "Hello  world, it's me"), ("s1", "en", None), ("s1", None, ""), (None, "de", "Straße " * 9000)] + [("s2", "fr", "copie")] * 40
    df = spark.createDataFrame([(*d, 7, "x") for d in docs], "source string, lang string, text string, tokens int, estimate string")
    library, want, words = Tokenizer.from_file(PATH), Counter(), Counter()
    for source, lang, text in docs:
        want[source, lang] += len(library.encode(text or "", add_special_tokens=False).ids)
        words[source, lang] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    number = Counter((s, lang) for s, lang, _ in docs)
    got = rows(ro.document_totals(df, PATH, "bpe"))
    assert got == {(*k, "bpe"): (number[k], want[k]) for k in number} | {(*k, "words"): (number[k], words[k]) for k in number}
    assert ro.document_totals(df.limit(0), PATH, "bpe").count() == 0


def test_a_version_is_not_written_by_one_task(spark, totals, tmp_path):
    change = spark.createDataFrame([(f"s{i}", "en", "t", None, i, 1) for i in range(200)], CHANGES)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for batch in ("a", "b"):
            assert totals.apply(batch, change)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(len(list(folder.glob("part-*"))) > 1 for folder in (tmp_path / "totals").iterdir())
    assert rows(totals.totals()) == {(f"s{i}", "en", "t"): (2, 2 * i) for i in range(200)}
