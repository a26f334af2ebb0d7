import random

import numpy as np
import xxhash

from tessera.llm import simhash
from tessera.llm.common import majority_bits


def slow_print(text, n):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) > n else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def slow_groups(prints):
    """Smallest id reachable by links of at most three bits; prints: (id, fingerprint)."""
    ids = [i for i, _ in prints]
    root = dict(zip(ids, ids))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if (a ^ b).bit_count() <= 3 and find(i) != find(j):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in ids}


def make(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(500)]
    texts = []
    for _ in range(n):
        words = rng.choices(vocabulary, k=rng.randint(80, 300))
        texts += [" ".join(words)] * rng.choice([1, 1, 2])
        words[rng.randrange(len(words))] = "Changed"
        texts.append("  ".join(words))
    texts += ["", None, " \n", "one", "One", "one two", "é É", "x " * 3000]
    return [(7 * i, t) for i, t in enumerate(texts)]


def test_op6_against_brute_force(spark):
    docs = make()
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, fp int").repartition(3)).collect()}
    prints = [(i, slow_print(t, 3)) for i, t in docs]
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints}
    assert {i: r.component_id for i, r in got.items()} == slow_groups(prints)


def test_anchors_cover_three_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, len(b), dtype=np.uint64)
    (ra, ka, oa), (rb, kb, ob) = simhash.anchors(a), simhash.anchors(b)
    homes = {(r, k) for r, k, o in zip(ra, ka, oa) if o == 2}
    assert {r for r, k in zip(rb, kb) if (r, k) in homes} == set(range(len(a)))


def test_majority_counts_long_runs():
    h = np.full(100_001, 2**64 - 1, dtype=np.uint64)
    h[:50_000] = 0
    assert majority_bits(h, np.array([100_001, 0]))[0] == 2**64 - 1 and majority_bits(h[:100_000], np.array([100_000]))[0] == 0


def test_keep_one_takes_similar_documents_and_leaves_others(spark):
    rng = random.Random(8)
    vocabulary = ["w%d" % i for i in range(3000)]
    docs, copies, clean = [], [], []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randint(150, 400))
        docs.append((10 * i, " ".join(words)))
        if i % 3 == 0:
            changed = list(words)
            for _ in range(len(words) // 120 + 1):  # about 0.92 similar
                changed[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs.append((10 * i + 1, " ".join(changed)))
            copies.append(10 * i + 1)
        elif i % 3 == 1:
            docs.append((10 * i + 2, " ".join(words)))
            copies.append(10 * i + 2)
        else:
            clean.append(10 * i)
    docs += [(None, docs[0][1]), (9001, None), (9002, "")]
    got = [r.doc_id for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([i for i, _ in docs if i not in copies and i != 9002], key=str)


def shingle_set(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def test_keep_one_leaves_documents_that_share_one_repeated_shingle(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices(["w%d" % j for j in range(5000)], k=rng.choice([80, 360, 1900])) + ["|"] * 200)) for i in range(40)]
    assert max(jaccard(a, b) for (i, a), (j, b) in zip(docs, docs[1:])) < 0.2
    assert simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).count() == 40


def test_keep_one_against_brute_force_around_the_bound(spark):
    """Pairs of one size, and parts of a longer text, at similarities about 0.8; each of its own words."""
    rng = random.Random(11)
    docs, want, similar = [], [], 0
    for i in range(600):
        n = rng.choice([8, 9, 12, 16, 19, 24, 40, 64, 110, 200, 240, 280, 420])
        words = ["%d-%d" % (i, j) for j in range(n)]
        other = list(words)
        if i % 2:
            other = other[: rng.randint(int(0.76 * (n - 4)), int(0.86 * (n - 4)) + 1) + 4]
        else:
            for p in rng.sample(range(n), max(1, round(rng.uniform(0.015, 0.035) * n))):
                other[p] = "changed-%d-%d" % (i, p)
        a, b = " ".join(words), " ".join(other)
        docs += [(2 * i, a), (2 * i + 1, b)]
        near = 5 * len(shingle_set(a) & shingle_set(b)) >= 4 * len(shingle_set(a) | shingle_set(b))
        similar += near
        want += [2 * i] if near else [2 * i, 2 * i + 1]
    assert 100 < similar < 500
    got = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id").collect())
    assert got == want


def test_keep_one_with_ids_of_text_repeated_rows_and_clashing_names(spark):
    a, b = " ".join("a%d" % i for i in range(40)), " ".join("b%d" % i for i in range(40))
    rows = [("d2", a, 1), ("d1", a, 2), ("d1", a, 2), ("d3", b, 3), (None, a, 4), ("d4", None, 5), ("d5", " ", 6), ("d6", "", 7)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id string, text string, _id int, gone int, node int")
    got = simhash.keep_one(df)
    assert got.columns == df.columns and sorted(map(str, (r.doc_id for r in got.collect()))) == ["None", "d1", "d1", "d3", "d4"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_one(empty).collect() == []
