import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from civictopics.llm import bpe
from civictopics.llm.common import parts, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
HARD = [
    "", " ", "  ", " a", "a  b", "a   b ", "foo \n bar", "foo\n\n bar", "a\n \nb", "it's  we'll", "x" * 3000,
    "ab " * 500, "é   x", "a<|endoftext|> b<|endoftext|>", "<|endoftext|>", "\x1c \x1d a", "日本語 テキスト 123", "🙂 🙂‍",
    "\r\n\t \t\n", "end ", "a  b", "\x00\x01 \x7f", "don't'S",
]


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def mine(text):
    return np.frombuffer(bpe.load(PATH).encode(text), "<u4").tolist()


@pytest.mark.parametrize("text", HARD)
def test_equal_to_the_library(text):
    assert mine(text) == library(text)
    assert bpe.load(PATH).decode(bpe.load(PATH).encode(text)) == LIBRARY.decode(library(text), skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sabtré1,  \x1c"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_equal_to_the_library_on_any_text(text):
    assert mine(text) == library(text)


def test_long_and_short_words_merge_alike():
    encoder = bpe.load(PATH)
    for word in (b"thththethouerhasdelichkeit" * 3, b"aaaaaaaaaaaaaaaaa", bytes(range(90))):
        assert encoder._merge_long([encoder.byte_ids[b] for b in word]) == encoder.merge(word)


def test_round_trip_of_odd_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (2, "", 7), (3, "z" * 20_000 + " x", 7), (None, "Ab  c", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = bpe.round_trip(df, PATH, keep=["doc_id"]).collect()
    assert len(got) == 5 and got[0].asDict() | {"doc_id": 2} == got[1].asDict() == got[2].asDict()
    for row, (_, text, _) in zip(got, rows):
        ids = np.array(library(text or ""), "<u4").tobytes()
        assert (row.n_tokens, row.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), PATH).count() == 0
    back = bpe.decode(bpe.encode(df.drop("n_tokens"), PATH).drop("text"), PATH)
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t, _ in rows)


def test_words_of_many_texts_are_merged_together(monkeypatch):
    encoder = bpe.ByteBpe(PATH)
    random = np.random.default_rng(5)
    words = ["".join(random.choice(list("thernisaéß中0"), random.integers(1, 12))) for _ in range(4000)]
    alone = [np.array(encoder.merge(w.encode()), "<u4").tobytes() for w in words]
    one_by_one = []
    merge = encoder.merge
    monkeypatch.setattr(encoder, "merge", lambda word: one_by_one.append(word) or merge(word))
    assert encoder.merge_many([w.encode() for w in words]) == alone
    texts = [" ".join(words[i : i + 50]) for i in range(0, 4000, 50)] + ["", *HARD]
    monkeypatch.setattr(bpe, "PIECES_AT_A_TIME", 1000)
    monkeypatch.setattr(bpe, "CHARS_AT_A_TIME", 100)
    monkeypatch.setattr(bpe, "REMEMBERED", 900)
    got = encoder.encode_many(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library(t) for t in texts]
    assert len(one_by_one) < 1500 and len(encoder.words) <= 2000
    assert max(map(len, [*encoder.words, *encoder.spaced])) <= bpe.SHORT_WORD


def test_tasks_leave_no_encoder_in_their_worker(spark):
    def held(batches):
        import pyarrow as pa

        from civictopics.llm import bpe

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bpe.load.cache_info().currsize] * batch.num_rows)], names=["n"])

    df = spark.range(40).repartition(4).selectExpr("id", "concat('text ', id) text")
    assert bpe.round_trip(df, PATH).count() == 40 and bpe.encode(df, PATH).agg({"ids": "count"}).first()[0] == 40
    assert {r.n for r in spark.range(40).repartition(4).mapInArrow(held, "n long").collect()} == {0}


def test_a_batch_is_gone_before_the_next_is_read():
    before, held = pa.total_allocated_bytes(), []

    def batches():
        for k in range(3):
            held.append(pa.total_allocated_bytes() - before)
            yield pa.RecordBatch.from_arrays([pa.array([f"{k}-{i}" * 500 for i in range(2500)])], names=["text"])

    seen = []
    for piece in parts(batches()):
        assert piece.num_rows in (500, 1000)
        seen += [t[: t.index("-") + 3] for t in piece.column(0).to_pylist()]
    assert len(seen) == 7500 and seen[0].startswith("0-0") and seen[-1].startswith("2-2")
    assert max(held) < 3_000_000
