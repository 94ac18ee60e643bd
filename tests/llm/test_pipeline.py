import hashlib

import numpy as np
import pytest
from test_simhash import components, slow_fingerprint
from test_linededup import brute as brute_lines
from test_mixing import goals

import corpus_pipeline as cp
from civictopics.llm import bpe
from civictopics.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def raw():
    english, german = "the of and to that with from this", "der die und nicht mit auch von einer"
    out = []
    for i in range(160):
        words = (english if i % 2 else german).split()
        body = "\n".join(" ".join(words[(i * k + j * j) % 8] + (str(i) if j % 3 else "") for j in range(3 + (i + k) % 9)) for k in range(1 + i % 4))
        out.append((i, body, "en" if i % 2 else "de", f"s{i % 5}", len(body)))
    out += [(200, out[9][1], "en", "s1", 1), (201, None, "en", "s1", 0), (202, "42 -- 17", "de", None, 8), (203, "the and of\n" * 40, "en", None, 9)]
    return out


def test_each_stage_by_brute_force(spark):
    docs = spark.createDataFrame(raw(), SCHEMA)
    rows = {name: None for name, _ in cp.STAGES}
    for name, stage in cp.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), stage(spark, docs, "").schema)
        after = [tuple(r) for r in docs.collect()]
        rows[name] = after
        if name != "bpe":
            assert docs.columns == list(cp.COLUMNS)
        if name == "language_id":
            assert sorted(after) == sorted(r for r in before if r[0] not in (201, 202))
        elif name == "line_dedup":
            gone = brute_lines([r[:2] for r in before])
            want = {r[0]: "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone[r[0]]) for r in before}
            assert {r[0]: r[1] for r in after} == want and all(r[4] == len(r[1]) for r in after)
            assert want[200] == "" and len(after) == len(before)
        elif name == "simhash_near_dedup":
            heads = components([r[0] for r in before], [slow_fingerprint(r[1]) for r in before])
            assert sorted(after) == sorted(r for r, h in zip(before, heads) if r[0] == h)
        elif name == "mixing":
            size = {r: len(r[1].split()) for r in before}
            totals = {}
            for r in before:
                totals[r[3]] = totals.get(r[3], 0) + size[r]
            for source, target in goals(totals).items():
                taken = sum(size[r] for r in after if r[3] == source)
                assert abs(taken - target) <= max(size[r] for r in before if r[3] == source) + 1e-6
            assert set(after) <= set(before) and max(after.count(r) for r in before) <= 3
        else:
            encoder = bpe.load(tokenizer_path("byte_bpe_50k.json"))
            texts = {r[0]: r[1] for r in before}
            for r in docs.collect():
                ids = encoder.encode(texts[r.doc_id])
                assert bytes(r.ids) == ids and r.n_tokens == len(np.frombuffer(ids, "<u4"))
                assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


ODD = [(1, None, None, None, None), (None, "a b", None, None, None), (1, None, None, None, None), (3, "", "en", "s", 0),
       (4, "the end " * 9000, "en", "s", 1), (5, "the end", "en", "s", 1), (6, "the end", "en", "s", 1), (6, "der Anfang hier", "de", "s", 1)]


def odd(spark, stage):
    """Sorted results of a stage on odd rows, as texts; an empty table must stay empty."""
    df = spark.createDataFrame([(*r, "more", 1) for r in ODD], SCHEMA + ", copies string, removed int").repartition(2)
    function = dict(cp.STAGES)[stage]
    assert function(spark, df.limit(0), "").count() == 0
    return sorted((tuple(r) for r in function(spark, df, "").collect()), key=repr)


def test_odd_rows_language(spark):
    assert {r[:2] for r in odd(spark, "language_id")} <= {r[:2] for r in ODD if r[1]}


def test_odd_rows_lines(spark):
    left = {(r[0], r[1], r[4]) for r in odd(spark, "line_dedup")}
    # The line of document 4 has the words of documents 5 and 6, which come after it.
    assert left == {(1, None, None), (None, "a b", 3), (3, "", 0), (4, "the end " * 9000, 72000), (5, "", 0), (6, "", 0), (6, "der Anfang hier", 15)}
    assert len(odd(spark, "line_dedup")) == len(ODD)


def test_odd_rows_near_duplicates(spark):
    rows = odd(spark, "simhash_near_dedup")
    prints = [slow_fingerprint(r[1]) for r in ODD]
    heads = components([r[0] for r in ODD], prints)
    assert rows == sorted((r for r, h in zip(ODD, heads) if r[0] == h), key=repr)
    assert (6, "der Anfang hier", "de", "s", 1) in rows and (6, "the end", "en", "s", 1) not in rows


def test_odd_rows_mixing(spark):
    rows = odd(spark, "mixing")
    assert set(rows) <= set(ODD) and rows.count((3, "", "en", "s", 0)) == 1 and max(rows.count(r) for r in ODD) <= 6


def test_odd_rows_bpe(spark):
    rows = odd(spark, "bpe")
    assert len(rows) == len(ODD)
    assert sum(hashlib.sha256(b"").hexdigest() in r for r in rows) == 3
