import numpy as np
import xxhash

from civictopics.llm import simhash as sh

SCHEMA = "doc_id long, text string, bits int, first string"


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints):
    label = list(range(len(ids)))
    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    return [min((j for j in groups[root(i)] if j is not None), default=None) for i in range(len(ids))]


def test_fingerprints(spark):
    assert sh._bit_counts([3, 1, 1 << 63]).tolist() == [2, 1] + [0] * 61 + [1]
    for text in (None, "", " \n", "One", "one TWO", "a b c", "a b a b a b a b", "É é ÉÉ zz " * 90):
        assert sh.fingerprint(text) == slow_fingerprint(text)
    value = spark.sql("select xxhash64('a b c') h").first().h
    assert sh.fingerprint("A b\tc") == int(np.int64(value).astype(np.uint64))


def test_slices_do_not_matter(monkeypatch):
    text = " ".join(str(i * i % 101) for i in range(900))
    whole = sh.fingerprint(text)
    monkeypatch.setattr(sh, "SLICE", 7)
    assert sh.fingerprint(text) == whole


def test_groups_by_brute_force(spark):
    texts = [f"word{i % 40} and {i % 3} more words of text number {i // 4}" for i in range(120)]
    texts += [None, "", "  ", "long " * 20_000, "long " * 20_001, "Long " * 20_000]
    ids = [None if i == 50 else 1000 - 3 * i for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in zip(ids, texts)], SCHEMA)
    prints = [slow_fingerprint(t) for t in texts]
    want = sorted(zip(map(str, ids), (f"{p:016x}" for p in prints), components(ids, prints)), key=repr)
    got = sorted(((str(r.doc_id), r.fingerprint, r.component_id) for r in sh.near_duplicate_groups(df).collect()), key=repr)
    assert got == want
    assert sh.near_duplicate_groups(df.limit(0)).count() == 0


def test_links_of_close_fingerprints(spark):
    """Many fingerprints around one centre, in cells expanded to pairs and in crowded ones."""
    random = np.random.default_rng(3)
    centre = int(random.integers(0, 1 << 63))
    close = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in random.integers(0, 64, (150, 2))}
    prints = sorted(close | {int(x) for x in random.integers(0, 1 << 63, 50)})
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "bits long")
    pairs = {(a, b) for a, p in zip(signed, prints) for b, q in zip(signed, prints) if a != b and (p ^ q).bit_count() <= 2}
    assert {tuple(r) for r in sh.similar_fingerprints(df, 1000).collect()} == pairs
    chained = {tuple(r) for r in sh.similar_fingerprints(df, 4).collect()}
    assert chained <= pairs and components(signed, prints) == spanned(signed, chained)


def spanned(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return [label[n] for n in nodes]


def test_one_of_each_group_stays(spark):
    df = spark.createDataFrame([(3, "a b c d", 1, "z"), (2, "A b c d", 1, "z"), (5, "quite different words here", 1, "z")], SCHEMA)
    assert sorted(r.doc_id for r in sh.near_dedup(df).collect()) == [2, 5]
