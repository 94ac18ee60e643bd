import collections
import hashlib
import random
import zlib

import pytest

from civictopics.llm.prefixtrie import SpillingQueue, prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    for conv in own:
        own[conv] = [turn[1:] for turn in sorted(own[conv], key=lambda turn: turn[0])]
    rebuilt = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        rebuilt[conv] = (*own.get(conv - conv % 100, [])[:h], *turns[h:])
    members = collections.defaultdict(list)
    for conv, turns in rebuilt.items():
        for depth in range(len(turns) + 1):
            members[turns[:depth]].append(conv)
    children = collections.Counter(node[:-1] for node in members if node)
    leaves, saved = collections.Counter(), collections.Counter()
    for node, convs in members.items():
        for depth in range(len(node) + 1):
            leaves[node[:depth]] += children[node] == 0
            saved[node[:depth]] += (len(convs) - 1) * (len(node[-1][1]) if node else 0)
    return sorted(
        (min(convs), len(node), min(members[node[:-1]]) if node else -1, len(convs), children[node], leaves[node], saved[node],
         hashlib.sha256(",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(node)).encode()).hexdigest())
        for node, convs in members.items()
    )


def trie(df, **settings):
    rows = prefix_trie(df, **settings).select(COLUMNS).collect()
    return sorted(tuple(-1 if v is None else v for v in row) for row in rows)


def conversations(seed=3):
    draw = random.Random(seed)
    ids = [c for c in [*range(40), 100, 101, 150, 205, 206, *range(300, 330)] if c != 200]
    rows = []
    for c in ids:
        for t in range(draw.choice([1, 2, 3, 7, 30 if c % 7 == 0 else 4])):
            rows.append((c, None if t == 0 and c % 5 == 0 else t, draw.choice(["u", "a", None]) if c % 3 else "u",
                         draw.choice(["x", "yé", "", None]) if c % 4 else "same"))
    return rows


@pytest.mark.parametrize("settings", [{}, {"top_members": 3, "block_depth": 3, "held": 3}, {"top_members": 10**6, "block_depth": 4, "held": 2}])
def test_equal_to_brute_force(spark, settings):
    rows = conversations()
    assert trie(spark.createDataFrame(rows, SCHEMA).repartition(5), **settings) == brute(rows)


def test_conversations_cut_by_the_sort(spark):
    """One conversation holds nearly all rows, so that many ranges begin inside it."""
    rows = [(7, t, "u", f"turn {t % 11}") for t in range(300)] + [(c, t, "u", f"turn {t}") for c in (0, 3, 9) for t in range(6)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie(spark.createDataFrame(rows, SCHEMA).repartition(6), block_depth=50) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_copies_of_one_conversation(spark):
    rows = [(c, t, "u", f"same {t}") for c in range(1, 300) for t in range(4)]
    assert trie(spark.createDataFrame(rows, SCHEMA), top_members=5) == brute(rows)


def test_odd_tables(spark):
    assert trie(spark.createDataFrame([], SCHEMA)) == []
    assert trie(spark.createDataFrame([(None, 0, "u", "x")], SCHEMA)) == []
    long_text = "palavra " * 200_000
    rows = [(5, 0, None, None), (5, 0, None, None), (6, None, "u", long_text), (106, None, "u", long_text), (205, None, "u", "é")]
    assert trie(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    clash = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA + ", depth int, key string, N_convs int")
    assert trie(clash) == brute(rows)


def test_turns_of_one_number_all_count(spark):
    rows = [(8, 1, "u", "a"), (8, 1, "u", "b"), (8, 1, "u", "a"), (9, 1, "u", "b"), (9, 1, "u", "a"), (9, 1, "u", "a")]
    first = trie(spark.createDataFrame(rows, SCHEMA))
    assert first == trie(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3))
    assert max(r[1] for r in first) == 3 - min(zlib.crc32(c) % 6 for c in (b"8", b"9"))


@pytest.mark.parametrize("held", [1, 4, 1000])
def test_queue_keeps_its_order_when_it_spills(held):
    draw, queue, plain = random.Random(held), SpillingQueue(held), []
    for number in range(500):
        if plain and draw.random() < 0.4:
            plain.sort()
            assert queue.head() == plain[0]
            assert queue.pop() == plain.pop(0)
        else:
            message = (draw.randrange(50), "k", number)
            queue.push(message)
            plain.append(message)
    assert [queue.pop() for _ in plain] == sorted(plain)
    assert queue.head() is None
    assert (queue.spills > 0) == (held < 1000)
