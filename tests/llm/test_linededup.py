import random

import numpy as np
import pytest

from civictopics.llm import linededup as ld

SCHEMA = "doc_id long, text string, doc int, Line string, words string"


def lowered(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)


def brute(rows):
    lines = []
    for doc_id, text in rows:
        for place, line in enumerate(text.split("\n") if text is not None else []):
            words = frozenset(w for w in "".join(" " if c in "\t\v\f\r" else c for c in lowered(line)).split(" ") if w)
            if words:
                lines.append(((doc_id is not None, doc_id or 0, place), words))
    lines.sort(key=lambda x: x[0])
    gone = {}
    for i, (at, words) in enumerate(lines):
        for _, other in lines[:i]:
            if 5 * len(words & other) >= 4 * len(words | other):
                gone.setdefault(at[1] if at[0] else None, []).append(at[2])
                break
    return {doc_id: gone.get(doc_id, []) for doc_id, _ in rows}


def corpus(seed, docs=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [r.choices(vocabulary, k=r.randint(1, 40)) for _ in range(25)]
    rows = []
    for i in range(docs):
        lines = []
        for _ in range(r.randint(0, 6)):
            line = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                line[r.randrange(len(line))] = r.choice(vocabulary + ["Ünic%d" % r.randint(0, 999)])
            r.shuffle(line)
            lines.append(r.choice([" ", "  ", "\t"]).join(line))
        rows.append((r.choice([1, -1]) * (i * 37 % 101), "\n".join(lines)))
    return rows


def report(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    return {r.doc_id: r for r in ld.line_report(df, **more).collect()}


@pytest.mark.parametrize("seed, pages, named", [(1, 4096, 8), (2, 3, 8), (3, 4096, 1)])
def test_equal_to_brute_force(spark, monkeypatch, seed, pages, named):
    """With small pages, frequent words take the third step."""
    monkeypatch.setattr(ld, "NAMED", named)
    rows = corpus(seed)
    got, want = report(spark, rows, page_rows=pages), brute(rows)
    assert {i: r.removed for i, r in got.items()} == want
    assert sum(map(len, want.values())) > 20
    assert all(got[i].n_lines == t.count("\n") + 1 and got[i].n_removed == len(want[i]) for i, t in rows)


def test_odd_texts(spark):
    rows = [(5, None), (6, ""), (7, "\n\n"), (3, "a B c d e\n a b C D E f"), (4, "a b c d e\nx"), (None, "X"), (8, "é É"), (9, "e E\r\ne"),
            (10, "long " + " ".join(f"v{i}" for i in range(9000))), (11, " ".join(f"v{i}" for i in range(9000)) + " long\n" * 3000)]
    got, want = report(spark, rows), brute(rows)
    assert {i: r.removed for i, r in got.items()} == want and want[4] == [0, 1] and want[11][0] == 0
    assert [got[i].n_lines for i in (5, 6, 7)] == [0, 1, 3]
    assert ld.line_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_copies_of_one_line(spark):
    base = [f"b{i}" for i in range(40)]
    rows = [(i, " ".join([*base[: i % 40], f"own{i}", *base[i % 40 + 1 :]])) for i in range(300)]
    got, want = report(spark, rows), brute(rows)
    assert {i: r.removed for i, r in got.items()} == want and sum(map(len, want.values())) == 299


def test_repeated_rows_and_texts_that_stay(spark):
    rows = [(1, "one two three\nfour five"), (1, "one two three\nfour five"), (2, "Four five\nsix seven\n\nsix  seven")]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)
    got = sorted(tuple(r) for r in ld.line_dedup(df).collect())
    assert got == [(1, rows[0][1], 1, "x", "y")] * 2 + [(2, "six seven\n", 1, "x", "y")]


def test_different_texts_of_one_id_keep_their_own_lines(spark):
    texts = ["k1 k2 k3\nk1 k2 k3", "m1 m2\np1 p2 unique line", "k1 k2 k3\nother line here", None, "m2 m1"]
    rows = [(i, t) for i in (None, 7) for t in texts]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)
    got = [(r[0], r[1]) for r in ld.line_dedup(df.repartition(3)).collect()]
    assert len(got) == len(rows)
    # Of each set of words one line stays, under the null id.
    kept = sorted(frozenset(line.split()) for i, t in got if i is None and t for line in t.split("\n") if line.split())
    assert sorted(map(sorted, kept)) == sorted(map(sorted, [{"k1", "k2", "k3"}, {"m1", "m2"}, {"p1", "p2", "unique", "line"}, {"other", "line", "here"}]))
    assert all(not (t or "").split() for i, t in got if i == 7)


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_long_words_of_two_letters_differ(spark, size):
    """The Thue-Morse word and its complement, which polynomial hashes modulo 2^64 take for equal."""
    bits = [bin(i).count("1") & 1 for i in range(size)]
    words = ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]
    rows = [(i, f"{word}\n{word} tail") for i, word in enumerate(words)]
    assert {i: r.removed for i, r in report(spark, rows).items()} == brute(rows) == {0: [], 1: []}


def test_hashes_depend_on_every_byte():
    words = [b"a" * n for n in range(1, 90)] + [b"a" * (n - 1) + b"b" for n in range(1, 90)] + [b"b" + b"a" * (n - 1) for n in range(2, 90)]
    data = b" ".join(words) + bytes(8)
    first = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
    for found in ld.hashed_words(np.frombuffer(data, np.uint8), first, np.array([len(w) for w in words])):
        assert len(set(found.tolist())) == len(set(words))


@pytest.mark.parametrize("size", [1 << 20, 64])
def test_long_texts_in_slices(spark, monkeypatch, size):
    monkeypatch.setattr(ld, "SLICE", size)
    texts = ["one two\nthree\n\nfour five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen\nx y", "\n" * 90 + "end word", "word " * 50]
    plain = np.zeros(ld.RARITY_BUCKETS, dtype=np.uint8)
    got = {(int(s.row[k]), int(s.line[k])): (int(s.size[k]), s.said(k)) for s in ld.sets(texts, plain) for k in range(len(s.row))}
    want = {(i, k): (len(set(line.split())), " ".join(sorted(set(line.split())))) for i, t in enumerate(texts) for k, line in enumerate(t.split("\n")) if line.split()}
    assert got == want


def test_family_just_below_the_threshold(spark):
    """Each two lines share 31 of 41 words: no pair is similar, and the join gives out none."""
    base = [f"b{i}" for i in range(31)]
    rows = [(i, " ".join([*base, *(f"own{i}x{k}" for k in range(5)), "two", "common"])) for i in range(200)]
    rows += [(500, " ".join(base)), (501, " ".join(base[::-1]))]
    got, want = report(spark, rows), brute(rows)
    assert {i: r.removed for i, r in got.items()} == want


def test_filters_never_lose_a_similar_pair():
    r = random.Random(5)
    for _ in range(300):
        n = r.randint(1, 60)
        a = r.sample(range(1000), n)
        b = a[: r.randint(max(1, n * 4 // 5), n)] + r.sample(range(1000, 2000), r.randint(0, n // 5))
        if 5 * len({*a} & {*b}) >= 4 * len({*a} | {*b}):
            x, y = sorted(a), sorted(b)
            length = [int(ld.prefix_length(np.array(len(z)))) for z in (x, y)]
            assert {*x[: length[0]]} & {*y[: length[1]]}
