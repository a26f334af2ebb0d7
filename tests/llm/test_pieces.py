import random

import numpy as np
import pytest

from tessera.llm import pieces


@pytest.fixture(scope="module")
def v():
    return pieces.vocabulary(pieces.MODEL)


def best_score(v, text):
    """The largest sum of piece scores over all segmentations, by the plain recursion."""
    best = [0.0] + [-np.inf] * len(text)
    for i in range(len(text)):
        for n in range(1, min(v.longest, len(text) - i) + 1):
            hit = v.pieces.get(text[i : i + n])
            gain = hit[1] if hit else v.unknown_score if n == 1 else -np.inf
            best[i + n] = max(best[i + n], best[i] + gain)
    return best[-1]


def score_of(v, ids):
    """Sum of scores; each run of byte pieces for one character counts as one unknown piece."""
    scores = {i: s for i, s in v.pieces.values()}
    raw = {i: b for b, i in v.bytes.items()}
    return sum(scores[i] if i in scores else v.unknown_score if raw[i] & 0xC0 != 0x80 else 0.0 for i in ids)


TEXTS = ["", "a", "  two  spaces ", "Hello world, hello!", "naïve Straße ▁mark▁ ", "日本語テキスト\n\n\tx", "a" * 500, "€" * 300, "ab" * 400 + " z", "\u0000\u0001 x", "🙂🙃 ok"]


def library(v):
    """The public library on the same file, declared a unigram model."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def texts(seed, n=40):
    rng = random.Random(seed)
    words = ["the", "Haus", "naïve", "x", "internationalization", "été", "42", "...", "日本", "🙂"]
    return ["".join(rng.choices("abcd éñ\n", k=rng.randint(1, 200))) for _ in range(n)] + [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(n)]


def test_ids_are_optimal(v):
    for t in TEXTS + texts(2):
        t = t.replace("▁", "")
        ids = v.encode(t).tolist()
        assert t or not ids
        assert not t or score_of(v, ids) == pytest.approx(best_score(v, v.prefix + t.replace(" ", "▁")), abs=1e-6)


def test_scores_are_those_of_the_librarys_lattice(v):
    """The public library's own search over a lattice finds the same sum. Its floats are short, so no text has characters without a piece."""
    lib = library(v)
    cases = [" ".join(t[:80].split()) for t in TEXTS + texts(5)]
    scores = {t: score_of(v, v.encode(t).tolist()) for t in cases if t}
    plain = {t: x for t, x in scores.items() if x > -1e6}
    assert len(plain) > 8
    for t, x in plain.items():
        assert x == pytest.approx(score_of(v, lib.nbest_encode_as_ids(t, 2)[0]), abs=1e-6), t


def test_lanes_windows_and_commits_do_not_change_ids(v, monkeypatch):
    """However the stream is cut, ids are the same; a stretch without a place where paths must converge is committed as they do."""
    cases = TEXTS + texts(3, 10) + ["ab" * 3000 + " tail", "a" * 2000, "".join(random.Random(1).choices("aeiounrst", k=5000))]
    want = [v.encode(t).tolist() for t in cases]
    monkeypatch.setattr(pieces, "ROUND", 5)
    monkeypatch.setattr(pieces, "LANE", 1)
    assert [v.encode(t).tolist() for t in cases] == want
    monkeypatch.setattr(pieces, "LANE", 10**9)
    assert [v.encode(t).tolist() for t in cases] == want
    for t, ids in zip(cases, want):
        assert [i for part in v.windows(t, 64) for i in part.tolist()] == ids


def test_backpointers_are_committed_long_before_the_end(v, monkeypatch):
    """Without places where paths must converge, uncommitted characters stay few."""
    monkeypatch.setattr(pieces, "LANE", 10**9)
    held = []
    real = type(v).commit

    def commit(self, piece, back, start, stop, out):
        held.append(int((stop - start).max()))
        real(self, piece, back, start, stop, out)

    monkeypatch.setattr(type(v), "commit", commit)
    text = "".join(random.Random(1).choices("aeiounrst", k=6000))
    v.encode(text)
    assert len(held) > 6000 // pieces.ROUND and max(held) < 2 * pieces.ROUND


def test_queries_encode_through_the_window(spark, v, monkeypatch):
    """The query's ids are those of the window, for every length of text."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts(7, 5) + ["x" * 3000])], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in pieces.encoded_digest(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == [i for part in v.windows(r.text, 100) for i in part.tolist()]


def test_round_trip(spark, v):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None, TEXTS[3]])], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in pieces.encoded_digest(df).collect()}
    assert len(rows) == len(TEXTS) + 2 and all(r.round_trip and r.n_ids == len(r.ids) for r in rows.values())
    assert rows[len(TEXTS)].ids == [] and rows[3].ids == rows[len(TEXTS) + 1].ids
    coded = pieces.decode(pieces.encode(df))
    assert {r.doc_id: r.decoded for r in coded.collect()} == {i: t or "" for i, t in enumerate([*TEXTS, None, TEXTS[3]])}
    assert pieces.encoded_digest(df.limit(0)).collect() == []
