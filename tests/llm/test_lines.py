import random

import pytest

from tessera.llm import linededup as L
from tessera.llm.common import numbered


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc é", k=rng.randint(0, 20))) for _ in range(2))
        assert L.edit_distance(a, b) == slow_distance(a, b)


M = 2**64 - 1


def slow_mix(x):
    x = (x + 0x9E3779B97F4A7C15) & M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def slow_word(w):
    """The word's bytes as digits of a number in base BASE, mixed with its length."""
    return slow_mix(sum(slow_mix(b) * pow(L.BASE, i, 2**64) for i, b in enumerate(w)) & M ^ len(w))


def slow_print(line):
    """A bit is set if over half of the words' hashes have it; the second, third, ... equal word counts as another one."""
    seen, hashes = {}, []
    for w in line.split():
        n = seen[w] = seen.get(w, -1) + 1
        hashes.append(slow_word(w) if not n else slow_mix((slow_word(w) + n) & M))
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(docs):
    """Kept text by id, from the definition: links of fingerprints within three bits and edit similarity from 0.8."""
    places = []
    for i, t in docs:
        for p, line in enumerate((t or "").encode().split(b"\n")):
            if line.split():
                places.append((i, p, b" ".join(line.lower().split())))
    classes = sorted({x for _, _, x in places})
    prints = [slow_print(c) for c in classes]
    root = list(range(len(classes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(classes)):
        for b in range(a):
            x, y = classes[a].decode(), classes[b].decode()
            if (prints[a] ^ prints[b]).bit_count() <= 3 and slow_distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9:
                root[find(a)] = find(b)
    first = {}
    for i, p, x in sorted(places):
        first.setdefault(find(classes.index(x)), (i, p))
    gone = {(i, p) for i, p, x in places if first[find(classes.index(x))] != (i, p)}
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in docs}


@pytest.mark.parametrize("seed,longest", [(1, 2048), (2, 1)])
def test_against_brute_force(spark, seed, longest, monkeypatch):
    monkeypatch.setattr(L, "LONGEST", longest)
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(60)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(25)]
    docs = []
    for i in range(30):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = rng.choice(base).split()
            if rng.random() < 0.4:
                line[rng.randrange(len(line))] = rng.choice([*words, line[0].upper(), line[0] + "s"])
            lines.append("  ".join(line) if rng.random() < 0.2 else " ".join(line))
            if rng.random() < 0.2:
                lines.append("")
        docs.append((i * 3, "\n".join(lines)))
    docs += [(900 + i, " | ".join(rng.choices(words, k=6))) for i in range(20)]
    docs += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, base[0] + "\n" + base[0].upper() + "\n\n" + base[0])]
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, n_lines int").repartition(3)
    got = L.dedup_lines(df).collect()
    assert {r.doc_id: r.text for r in got} == brute(docs) and len(got) == len(docs)
    assert all(r.n_lines == (0 if (t := dict(docs)[r.doc_id]) is None else t.count("\n") + 1) for r in got)


def test_lines_repeated_rows_long_texts_and_clashing_names(spark):
    long = "\n".join("row %d of the long text" % (i % 50_000) for i in range(60_000)) + "\n" + "y" * 1_200_000
    docs = [(1, "same line here\nsame line here", "a"), (1, "same line here\nsame line here", "b"), (2, "same line here", "c"), (3, long, "d"), (None, "Same  line here\nand more", "e")]
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, of string, _id int, t int, gone int")
    got = {r.of: r for r in L.dedup_lines(df).collect()}
    assert got["e"].text == "Same  line here\nand more" and got["a"].text == got["b"].text == "" and got["c"].text == ""
    assert got["a"].n_removed == 2 and got["d"].n_lines == 60_001 and got["d"]._id == 1 and got["d"].gone == 3
    want = {}
    for p, line in enumerate(long.split("\n")):
        want.setdefault(line, p)
    assert got["d"].text.split("\n")[-1] == "y" * 1_200_000 and got["d"].n_removed >= 60_001 - len(want)
    text = spark.createDataFrame([("b", "one two\nthree"), ("a", "ONE two")], "doc_id string, text string")
    assert {r.doc_id: r.text for r in L.dedup_lines(text).collect()} == {"a": "ONE two", "b": "three"}


def test_words_are_hashed_alike_in_any_chunk(monkeypatch):
    import numpy as np

    rng = random.Random(3)
    words = [bytes(rng.choices(b"abc\xc3", k=rng.choice([1, 5, 9, 40]))) for _ in range(300)]
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    begin = end - [len(w) for w in words]
    want = [slow_word(w) for w in words]
    for chunk in (1 << 20, 64, 8):
        monkeypatch.setattr(L, "_CHUNK", chunk)
        assert L.word_hashes(data, begin, end).tolist() == want


def test_empty_table(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeats_do_not_outweigh_the_rest():
    import numpy as np

    bar = np.uint64(2**64 - 1)
    h = np.array([bar, 1, bar, 2, bar, 5, bar, 7, 7], dtype=np.uint64)
    out = numbered(h, np.array([4, 5]))
    assert out[0] == out[4] == bar and len(set(out[:4].tolist())) == 4 and len(set(out[4:].tolist())) == 5
    assert out[2] == out[6] and numbered(h[:0], np.array([0])).tolist() == []
