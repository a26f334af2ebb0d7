import random

import numpy as np
import pytest

from tessera.llm import suffixes
from tessera.llm.suffixes import remove_repeats, suffix_array


def brute(docs, length=50):
    """(id, kept, spans) of each row, from the definition."""
    texts = [(i, (t or "").encode()) for i, t in docs]
    least = {}
    for i, t in texts:
        i = float("inf") if i is None else i
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if least[t[p : p + length]] < (float("inf") if i is None else i):
                gone[p : p + length] = [True] * length
        spans, begin = [], None
        for p, g in enumerate([*gone, False]):
            if g and begin is None:
                begin = p
            if not g and begin is not None:
                spans.append((begin, p))
                begin = None
        out.append((i, bytes(c for c, g in zip(t, gone) if not g), tuple(spans)))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = ["ab", "cé", "x", "ünder", "lo", "é", "zz", "the", "a" * 9]
    base = [" ".join(rng.choices(words, k=rng.randint(0, 120))) for _ in range(12)]
    docs = []
    for i in rng.sample(range(1000), 40):
        t = rng.choice(base)
        a, b = sorted((rng.randint(0, len(t)), rng.randint(0, len(t))))
        docs.append((i, rng.choice([t, t[a:b] + rng.choice(base)[a:], "a" * rng.randint(40, 160), "abc" * rng.randint(10, 60), t + "!" + t])))
    return docs + [(None, base[0]), (None, base[0] * 3), (1001, None), (1002, ""), docs[0], (docs[1][0], docs[2][1]), (1003, "x" * 49), (1004, "x" * 50), (1005, "x" * 50)]


@pytest.mark.parametrize("seed,hot,block", [(1, 50_000, 8 << 20), (2, 3, 2000), (3, 50_000, 500)])
def test_against_brute_force(spark, seed, hot, block):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, "n", 0) for i, t in docs], "doc_id long, text string, kept string, id int").repartition(3)
    got = remove_repeats(df, block=block, bucket=1000, hot=hot).collect()
    assert sorted([(r.doc_id, bytes(r.kept), tuple((s.start, s.end) for s in r.spans)) for r in got], key=repr) == brute(docs)
    assert all(r.n_bytes == len(r.kept) + sum(s.end - s.start for s in r.spans) for r in got)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_suffix_array():
    rng = random.Random(5)
    for _ in range(200):
        x = [rng.randint(1, rng.choice([2, 3, 90])) for _ in range(rng.randint(0, 60))]
        assert suffix_array(np.array(x, dtype=np.int64)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_messages_grow_with_the_blocks(spark):
    """The messages of a block are bounded, so their number is in proportion to the corpus."""
    rng = random.Random(3)
    made = []
    for n in (40, 160):
        docs = spark.createDataFrame([(i, "".join(rng.choices("abcdefgh ", k=3000))) for i in range(n)], "doc_id long, text string").repartition(2)
        blocks = suffixes.cut(suffixes.blocks_of(docs, "doc_id", "text", 15_000), "blocks")
        buckets = n * 3000 // 1000
        asked = suffixes.cut(suffixes.ask(blocks, buckets, 50), "asked")
        made.append((blocks.count(), asked.count()))
        assert made[-1][1] == made[-1][0] * -(-buckets // suffixes.width_of(buckets))
    assert all(-(-b // suffixes.width_of(b)) <= suffixes.MESSAGES for b in range(1, 32_768, 111))
