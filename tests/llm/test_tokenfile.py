import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from civictopics.llm import idcoder, tokenfile
from civictopics.llm.common import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 65535), st.integers(0, 3)), min_size=1, max_size=200), min_size=1, max_size=6))
def test_blocks_round_trip(blocks):
    blocks = [np.array(b, dtype=np.uint32) for b in blocks]
    coded = idcoder.encode(blocks, 4)
    back = idcoder.decode(coded, [len(b) for b in blocks], 4)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back))
    # A block does not depend on its neighbours.
    assert idcoder.encode(blocks[-1:], 4) == coded[-1:]


def test_predictable_ids_become_short():
    random = np.random.default_rng(1)
    story = np.tile(random.integers(0, 49_000, 40), 100).astype(np.uint32)
    noise = random.integers(0, 49_000, 4000).astype(np.uint32)
    short, long = (len(c) for c in idcoder.encode([story, noise], 4))
    assert short < 1000 < 7000 < long < 9000


def test_groups_are_coded_one_after_another(monkeypatch):
    monkeypatch.setattr(idcoder, "GROUP", 3)
    blocks = [np.arange(n, dtype=np.uint32) % 7 for n in (5, 9, 1, 400, 8, 8, 30)]
    back = idcoder.decode(idcoder.encode(blocks, 4), [len(b) for b in blocks], 4)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back))


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_damage_is_noticed():
    out = io.BytesIO()
    writer = tokenfile.FileWriter(out, 4, block=64)
    for i in range(20):
        writer.add(None if i == 3 else i, np.arange(i * 7, dtype="<u4"))
    writer.close()
    data = out.getvalue()
    docs = list(tokenfile.FileReader(Bytes(data)).documents())
    assert [(d, s, len(i)) for d, s, i in docs] == [(None if i == 3 else i, 7 * i * (i - 1) // 2, 7 * i) for i in range(20)]
    broken = bytearray(data)
    broken[40] ^= 1
    with pytest.raises(ValueError):
        list(tokenfile.FileReader(Bytes(bytes(broken))).documents())
    with pytest.raises(ValueError):
        tokenfile.FileReader(Bytes(data[:-5]))


TEXTS = ["Hello  World's 42!", None, "", "é ÉTÉ\x1cx a b　c", "<|endoftext|> x<|startoftext|>", "w" * 5000, "á b ́c",
         "ΣΑΣ İ", "one two " * 3000, "\n\t", "it's we'll they'd"]


def test_tokens_of_whole_texts():
    found = tokenfile.load(PATH).encode([t or "" for t in TEXTS])
    assert [[*f.tolist(), 2] for f in found] == [library(t) for t in TEXTS]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n'sEÉ́\x1c\x85"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_tokens_of_any_text(text):
    assert [*tokenfile.load(PATH).encode([text])[0].tolist(), 2] == library(text)


@pytest.mark.parametrize("parts", [1, 5])
def test_files_by_brute_force(spark, parts):
    rows = [(100 - i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "last", "x"), (90, "again", "x"), (90, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Start string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = tokenfile.token_files(df, PATH).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(got) == len(rows)
    start = 0
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    by_id = {i: t for i, t, _ in rows if i != 90}
    for row in got:
        assert row.start == start
        start += row.n_tokens
        if row.doc_id != 90:
            ids = library(by_id[row.doc_id])
            assert (row.n_tokens, row.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert tokenfile.token_files(df.limit(0), PATH).count() == 0
