import math
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import hmm
from tessera.llm.hmm import Expected, Model, forward


def tiny(seed=0, states=3, classes=4):
    rng = np.random.default_rng(seed)
    return Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(classes), states).T)


def slow(m, x):
    """Probability of a sequence and expected counts, by summing over all paths."""
    from itertools import product

    total, start, move, emit = 0.0, np.zeros_like(m.start), np.zeros_like(m.move), np.zeros_like(m.emit)
    for path in product(range(len(m.start)), repeat=len(x)):
        p = m.start[path[0]] * m.emit[x[0], path[0]]
        for a, b, c in zip(path, path[1:], x[1:]):
            p *= m.move[a, b] * m.emit[c, b]
        total += p
        start[path[0]] += p
        for a, b in zip(path, path[1:]):
            move[a, b] += p
        for c, s in zip(x, path):
            emit[c, s] += p
    return total, start / total, move / total, emit / total


def test_forward_and_counts_against_all_paths():
    m, rng = tiny(), random.Random(1)
    seqs = sorted(([rng.randrange(4) for _ in range(rng.randint(1, 6))] for _ in range(12)), key=len, reverse=True)
    want = [slow(m, x) for x in seqs]
    arrays = [np.array(x) for x in seqs]
    assert forward(m, arrays) == pytest.approx([math.log10(w[0]) for w in want])
    e = Expected(m)
    e.add(m, arrays)
    for got, i in ((e.start, 1), (e.move, 2), (e.emit, 3)):
        assert got == pytest.approx(sum(w[i] for w in want))


@pytest.mark.parametrize("seam", [1, 2, 3, 5])
def test_counts_do_not_depend_on_seams(seam, monkeypatch):
    m, rng = tiny(3), random.Random(seam)
    seqs = sorted(([rng.randrange(4) for _ in range(rng.randint(1, 8))] for _ in range(9)), key=len, reverse=True)
    want = [slow(m, x) for x in seqs]
    monkeypatch.setattr(hmm, "SEAM", seam)
    monkeypatch.setattr(hmm, "TOKENS", 6)
    e = Expected(m)
    hmm.in_batches(m, e, [np.array(x) for x in seqs])
    for got, i in ((e.start, 1), (e.move, 2), (e.emit, 3)):
        assert got == pytest.approx(sum(w[i] for w in want))


def test_score_against_all_paths(spark, monkeypatch):
    """The whole score of short texts: all paths of the states, and each rare word's share of its class; the level of counts
    that does not fit gives as many words of its own as there is room."""
    import zlib

    rng = np.random.default_rng(8)
    held = {}

    def start(texts, prior, states, **_):
        held["m"] = Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(len(prior)), states).T)
        return held["m"]

    monkeypatch.setattr(hmm, "starting_values", start)
    words = ["aa", "bb", "xing", "ying", "zz", "new", "\u00e9"]
    py = random.Random(3)
    docs = [(i, " ".join(py.choices(words[:5], k=py.randint(0, 5)))) for i in range(40)] + [(900, "new aa ying " * 2), (901, None)]
    got = {r.doc_id: r.score for r in hmm.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), states=2, rounds=0, frequent=3).collect()}
    split = lambda t: (t or "").encode().split() + [b""]
    c = Counter(w for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2 for w in split(t))
    m = held["m"]
    n_own = len(m.emit) - hmm.SUFFIXES
    assert n_own == 3
    own = sorted(c, key=lambda w: (-c[w], w))[:3]
    if c[own[-1]] == sorted(c.values(), reverse=True)[3]:
        pytest.skip("tied counts")
    cls = lambda w: own.index(w) if w in own else 3 + zlib.crc32(w[-3:]) % hmm.SUFFIXES
    mass, kinds = Counter(), Counter()
    for w, k in c.items():
        if w not in own:
            mass[cls(w)] += k
            kinds[cls(w)] += 1
    for i, t in docs:
        x = [cls(w) for w in split(t)]
        want = math.log10(slow(m, x)[0]) + sum(math.log10((c[w] + 1) / (mass[cls(w)] + kinds[cls(w)] + 1)) for w in split(t) if w not in own)
        assert got[i] == pytest.approx(want, abs=1e-9), t


def test_all_counts_alike_still_give_classes(spark):
    """One level of counts larger than there is room for; repeated rows and a very long text."""
    docs = [(i, "w%d v%d" % (i, i)) for i in range(50)] + [(77, "long " * 70_000), (3, "w3 v3"), (3, "w3 v3")]
    got = hmm.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), rounds=1, frequent=10).collect()
    assert len(got) == 53 and all(math.isfinite(r.score) for r in got) and len({round(r.score, 9) for r in got if r.doc_id == 3}) == 1


def test_contract_columns(spark):
    import zlib

    rng = random.Random(6)
    words = ["aa", "Bb", "cé", "dd", "eing", "fing", "\u00a0"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(120)] + [(900, None), (901, "never Seen\x0bwords"), (902, ""), (5, "aa bb")]
    got = hmm.score_texts(spark.createDataFrame([(i, t, 1.5) for i, t in docs], "doc_id long, text string, score double").repartition(3), rounds=1, frequent=5).collect()
    split = lambda t: [w for w in (t or "").encode().lower().split()] + [""]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in docs if not held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    rows = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert rows == sorted((i, held(i), len(split(t)), sum(c[w] > 0 for w in split(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split(t)), 6)) for i, t in docs)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


@pytest.mark.parametrize("frequent", [50, 1000, 3000])
def test_contract_columns_where_a_level_of_counts_does_not_fit(spark, frequent):
    """The level is far larger than its room, so its words are thinned before they are chosen; all others stay known."""
    import zlib

    rng = random.Random(4)
    docs = [(i, " ".join("w%d" % rng.randrange(4000) for _ in range(20))) for i in range(300)]
    got = hmm.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), rounds=0, frequent=frequent).collect()
    split = lambda t: [*t.encode().split(), b""]
    c = Counter(w for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2 for w in split(t))
    n, v = sum(c.values()), len(c)
    rows = sorted((r.doc_id, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert rows == sorted((i, sum(c[w] > 0 for w in split(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split(t)), 6)) for i, t in docs)


def test_the_model_beats_the_base_on_ordered_text(spark):
    """Two moods that alternate rarely: the hidden states should see them, the base cannot."""
    rng = random.Random(9)
    moods = [["a%d" % i for i in range(40)], ["b%d" % i for i in range(40)]]
    docs = [(i, " ".join(rng.choices(moods[i % 2], k=60))) for i in range(300)]
    got = hmm.score_texts(spark.createDataFrame(docs, "doc_id long, text string")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_empty_table(spark):
    assert hmm.score_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
