import collections
import random
import re

import pytest

from civictopics.llm.repetition import FIELDS, measures, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, shortest):
    text = text or ""
    words = WORD.findall(text)
    n, longest, maximal, inside = len(words), 0, 0, [False] * len(words)
    for length in range(shortest, n):
        spots = collections.defaultdict(list)
        for at in range(n - length + 1):
            spots[tuple(words[at : at + length])].append(at)
        found = [where for where in spots.values() if len(where) > 1]
        if not found:
            break
        longest = length
        for where in found:
            for at in where:
                inside[at : at + length] = [True] * length
            before = {words[at - 1] if at else at - 1 for at in where}
            after = {words[at + length] if at + length < n else at for at in where}
            maximal += len(before) > 1 and len(after) > 1
    lines, seen = 0, set()
    for line in text.split("\n"):
        lines += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, sum(inside),
            sum(len(w) for w, i in zip(words, inside) if i), longest, maximal)


def texts(seed):
    draw = random.Random(seed)
    words = ["a", "b", "ab", "é", "#*", "a\x0bb", "x\x85y"]
    out = ["".join(draw.choice(words[: draw.choice([2, 7])]) + draw.choice([" ", " ", "\n", "\t "]) for _ in range(draw.randrange(60)))
           for _ in range(60)]
    return [*out, None, "", " \n\n ", "a " * 40, "x y z " * 9, "a b c d e f g h " * 2, "same line\nsame line\n\n\nother"]


@pytest.mark.parametrize("shortest", [1, 2, 3, 5, 8])
def test_equal_to_brute_force(shortest):
    some = texts(shortest)
    assert list(zip(*measures(some, shortest))) == [brute(t, shortest) for t in some]


def test_texts_do_not_share_repeats():
    once = "one two three four five six seven eight nine ten"
    assert measures([once, once, once], 3)[4] == [0, 0, 0]


def test_verdict(spark):
    clean = " ".join(f"word{i}" for i in range(100))
    line = " ".join(f"line{i}" for i in range(8))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (1, clean), (2, "too short"), (3, None), (4, "again and " * 50),
        (5, f"{clean}\n{line}\n{line}"),                                # one line twice: 16 of 116 words
        (6, f"{passage} {' '.join(f'o{i}' for i in range(500))} {passage}"),  # one repeat of 60 words, 19 %
        (7, f"{' '.join(f'o{i}' for i in range(100))} {' '.join('long' * 9 + str(i % 20) for i in range(40))}"),  # 28 % of words
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, KEPT string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality(df).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (True, False), 5: (False, True),
                   6: (False, False), 7: (False, False)}


def test_columns_copies_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7), (None, "a b", None)], "doc_id long, text string, N_Words int")
    got = quality(df)
    assert got.columns == ["doc_id", "text", *FIELDS, "base_failed", "kept"]
    assert [r["n_words"] for r in got.collect()] == [2, 2, 2]
    assert quality(df.limit(0), keep=["doc_id"]).collect() == []


def test_long_text_counts_whole():
    sentence = " ".join(f"w{i}" for i in range(300_000))
    found = dict(zip(FIELDS, (c[0] for c in measures([f"{sentence} tail {sentence}"]))))
    assert (found["n_words"], found["longest_repeat"], found["n_repeats"]) == (600_001, 300_000, 1)
    assert found["n_repeat_words"] == 600_000
