import math
import random
import re

import pytest

from civictopics.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def goals(sizes, weights=(5, 2, 1), limit=3):
    """Targets by sharing again and again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left, share = total - sum(fixed.values()), sum(weight[s] for s in rest)
        given = {s: left * weight[s] / share for s in rest}
        over = [s for s in rest if given[s] > limit * sizes[s] + 1e-9]
        if not over:
            return fixed | given
        fixed |= {s: float(limit * sizes[s]) for s in over}


def multiplier(sizes, target, scale, limit=3):
    """The same dual solved by halving."""
    low, high = -1e4, 1e4
    for _ in range(300):
        mid = (low + high) / 2
        words = sum(n * min(limit, math.exp(min(50, mid * n / scale))) for n in sizes)
        low, high = (mid, high) if words < target else (low, mid)
    return mid


def checked(spark, rows, schema="doc_id long, text string, source string, SIZE string, copies int"):
    df = spark.createDataFrame(rows, schema)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size = {}
    for row in rows:
        size[row[2]] = size.get(row[2], 0) + len(WORD.findall(row[1] or ""))
    want = goals(size)
    for source, target in want.items():
        mine = [r for r in got if r.source == source]
        assert all(r.source_size == size[source] and math.isclose(r.target, target, abs_tol=1e-6) for r in mine)
        assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in mine)
        assert all(abs(r.copies - r.rate) < 2 for r in mine)
        missing = target - sum(r.taken for r in mine)
        # The shortest document whose copies could still change that way, had it not changed already.
        able = [r.size for r in mine if r.size and (r.copies < 3 if missing > 0 else r.copies > 0) and abs(r.copies - r.rate) < 1]
        assert abs(missing) < min(able, default=target + 1) + 1e-6
        if 0 < target < 3 * size[source]:
            scale = sum(r.size**2 for r in mine) / size[source]
            at = multiplier([r.size for r in mine], target, scale)
            for r in mine:
                assert math.isclose(r.rate, min(3, math.exp(at * r.size / scale)), rel_tol=1e-4)
    return got


def test_targets_and_rates(spark):
    rows = []
    for i in range(400):
        source = "b" if i % 3 else f"s{i % 7}"
        rows.append((i, "w " * (1 + i * i % 97), source, "x", 9))
    first = checked(spark, rows)
    again = mixing.mix(spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string").repartition(7)).collect()
    assert {r.doc_id: r.copies for r in first} == {r.doc_id: r.copies for r in again}


def test_nulls_empty_texts_ties_and_one_long_text(spark):
    rows = [(1, None, "a", "x", 1), (2, "", "a", "x", 1), (3, "one two", None, "x", 1), (3, "one two", None, "x", 1),
            (None, "t " * 5000, "z", "x", 1), (5, "u v", "Z", "x", 1), (6, "é é \x1c", "é", "x", 1)]
    got = checked(spark, rows)
    assert all(r.copies == 1 and r.rate == 1.0 for r in got if r.size == 0)


def test_hot_group_of_copies(spark):
    rows = [(i, "same words here", "hot", "x", 1) for i in range(2000)] + [(5000 + i, "a b c d", "cold", "x", 1) for i in range(50)]
    checked(spark, rows)


@pytest.mark.parametrize("schema", ["doc_id long, text string, source string"])
def test_empty_table(spark, schema):
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0


def test_small_sources_come_near_their_targets(spark):
    """Sizes as uneven as in a corpus: every source within one word in a hundred."""
    draw, rows = random.Random(4), []
    for i in range(1000):
        rows.append((i, "w " * draw.randrange(1, 5000 if i % 50 < 3 else 200), f"src{i % 20}"))
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.01 * mine[0].target
