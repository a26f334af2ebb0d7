"""SentencePiece encoding and decoding by a streaming Viterbi over the piece scores of a public model file.

The ids of a text are those of the segmentation with the largest sum of piece scores (the unigram rule; of equal sums
the one with the longest last piece at every boundary). The installed model file is of BPE kind: its scores are merge
ranks, so the ids are those of the unigram rule on these ranks (as the public library's lattice finds them if the file is
declared a unigram model), not those of the file's own merges.

Characters run through lanes that advance together, one character at a time. A lane keeps the scores of the last
`longest piece` boundaries only, and the backpointers since its last commit; whenever all surviving backpointer paths
pass one boundary, the ids before it are committed. Between two characters that are neighbours in no piece all paths
converge, so lanes begin at such places. Texts are read in windows of WINDOW characters, whatever their length. Characters
without a piece become byte pieces. A leading space marks the text's start, as in the model file; decoding is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
WINDOW = 1 << 18  # characters looked at together
LANE = 128  # characters of a lane, until the next place where paths converge
ROUND = 192  # steps between commits


class Vocabulary:
    """Pieces, scores and byte ids read from a SentencePiece model file."""

    def __init__(self, path: str = MODEL):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.pieces = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type in (1, 4)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == 2), 0)
        self.unknown_score = min((s for _, s in self.pieces.values()), default=0.0) - 10
        self.longest = max(map(len, self.pieces), default=1)
        self.prefix = SPACE if model.normalizer_spec.add_dummy_prefix else ""
        self.out = [b""] * len(model.pieces)
        for p, (i, _) in self.pieces.items():
            self.out[i] = p.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.out[i] = bytes([b])
        self._tables()

    def _tables(self) -> None:
        """The trie of the pieces as a hash table of (node, letter), and the pairs of letters that are neighbours in a piece."""
        letters = sorted({c for p in self.pieces for c in p})
        self.letter = np.zeros(0x110000, dtype=np.int32)  # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        number = {c: i + 1 for i, c in enumerate(letters)}
        nodes: dict[tuple[int, int], int] = {}
        pairs = np.zeros(self.width * self.width // 8 + 1, dtype=np.uint8)
        ends: dict[int, int] = {}
        for p, (piece, _) in self.pieces.items():
            node = 0
            for c in p:
                node = nodes.setdefault((node, number[c]), len(nodes) + 1)
            ends[node] = piece
            for x, y in zip(p, p[1:]):
                at = number[x] * self.width + number[y]
                pairs[at >> 3] |= 1 << (at & 7)
        self.pairs = pairs
        self.none, self.single = len(self.out), len(self.out) + 1  # no piece; a character without a piece
        self.piece_at = np.full(len(nodes) + 1, self.none, dtype=np.int32)
        self.piece_at[list(ends)] = list(ends.values())
        self.score = np.full(len(self.out) + 2, -np.inf)
        for piece, score in self.pieces.values():
            self.score[piece] = score
        self.score[self.single] = self.unknown_score
        size = 1 << max(4, (4 * len(nodes)).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.keys, self.next = np.full(size + 64, -1, dtype=np.int64), np.zeros(size + 64, dtype=np.int32)
        keys = np.array([n * self.width + c for n, c in nodes], dtype=np.int64)
        for key, spot, node in zip(keys.tolist(), self._spot(keys).tolist(), nodes.values()):
            while self.keys[spot] >= 0:
                spot += 1
            self.keys[spot], self.next[spot] = key, node

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The nodes that follow by a letter; 0: none."""
        keys = node * np.int64(self.width) + letter
        spot = self._spot(keys)
        found = self.keys[spot]
        out = np.where(found == keys, self.next[spot], 0)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            spot[todo] += 1
            found = self.keys[spot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.next[spot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out

    def matches(self, x: np.ndarray) -> np.ndarray:
        """By the character a piece ends with and its length (longest first): the piece, or `none`."""
        n, most = len(x), self.longest
        out = np.full((n, most), self.none, dtype=np.int32)
        at = np.flatnonzero(x)
        node = self.step(np.zeros(len(at), dtype=np.int64), x[at])
        for length in range(1, most + 1):
            live = node > 0
            at, node = at[live], node[live]
            out[at + length - 1, most - length] = self.piece_at[node]
            inside = at + length < n
            at, node = at[inside], node[inside]
            if not len(at):
                break
            node = self.step(node.astype(np.int64), x[at + length])
        out[:, -1] = np.where(out[:, -1] == self.none, self.single, out[:, -1])
        return out

    def meets(self, x: np.ndarray) -> np.ndarray:
        """Boundaries (before a character) that no piece crosses."""
        at = x[:-1].astype(np.int64) * self.width + x[1:]
        return np.flatnonzero((self.pairs[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 0) + 1

    def viterbi(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, int]:
        """(piece at each character of x that a piece starts with, -1 elsewhere; boundary up to which all is committed).

        Lanes begin[i] to end[i] cover x in order. All lanes but the last end where paths converge; if the last one's
        end is -1 it goes on after x, and what its paths do not agree on stays uncommitted.
        """
        most = self.longest
        piece = self.matches(x)
        out = np.full(len(x), -1, dtype=np.int32)
        back = np.zeros(len(x), dtype=np.uint8 if most < 256 else np.int32)  # by the character before a boundary: the column of the piece
        open_, end = end[-1] < 0, np.where(end < 0, len(x), end)
        order = np.argsort(begin - end, kind="stable")  # longest first
        at, end = begin[order].copy(), end[order]
        done = at.copy()  # committed up to here
        score = np.full((len(at), ROUND + most), -np.inf)
        score[:, most - 1] = 0.0
        while len(at):
            for t in range(min(ROUND, int((end - at).max()))):
                k = int(np.searchsorted(at - end, -t, side="left"))  # lanes of more than t characters to go
                p = piece[at[:k] + t]
                gain = self.score[p]
                gain += score[:k, t : t + most]
                best = gain.argmax(axis=1)
                back[at[:k] + t] = best
                score[:k, t + most] = gain[np.arange(k), best]
            left = end - at > ROUND
            to = np.where(left, at, end)
            for i in np.flatnonzero(left | (open_ & (end == len(x)))).tolist():
                now = int(min(at[i] + ROUND, end[i]))
                to[i] = self.converged(score[i, now - at[i] : now - at[i] + most], back, now, int(done[i]))
            self.commit(piece, back, done, to, out)
            if open_ and (last := np.flatnonzero(~left & (end == len(x)))).size:
                return_at = int(to[last[0]])
            score[:, :most] = score[:, ROUND : ROUND + most]
            at, end, done, score = (at + ROUND)[left], end[left], to[left], score[left]
        return out, return_at if open_ else len(x)

    def converged(self, scores: np.ndarray, back: np.ndarray, now: int, start: int) -> int:
        """The last boundary that all surviving paths pass; scores: of the last boundaries, up to `now`."""
        live = {now - self.longest + 1 + int(i) for i in np.flatnonzero(scores > -np.inf)}
        live = {max(b, start) for b in live}
        while len(live) > 1:
            far = max(live)
            live.remove(far)
            live.add(far - (self.longest - int(back[far - 1])))
        return live.pop()

    def commit(self, piece: np.ndarray, back: np.ndarray, start: np.ndarray, stop: np.ndarray, out: np.ndarray) -> None:
        """Write the pieces of each path from boundary stop[i] back to start[i]."""
        some = stop > start
        now, start = stop[some].copy(), start[some]
        while len(now):
            column = back[now - 1].astype(np.int64)
            got = piece[now - 1, column]
            now = now - (self.longest - column)
            out[now] = got
            live = now > start
            now, start = now[live], start[live]

    def codes(self, text: str, first: bool = True) -> np.ndarray:
        """Letters of a text; the mark itself is in no piece, so that decoding tells it from a space."""
        c = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        x = self.letter[c]
        x[c == ord(SPACE)] = 0
        x[c == 32] = self.letter[ord(SPACE)]
        return np.concatenate((self.letter[[ord(self.prefix)]], x)) if self.prefix and first else x

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, the number of ids of each); none for null and empty texts."""
        ids: list[np.ndarray] = []
        count = np.zeros(len(texts), dtype=np.int64)
        held: list[tuple[int, str, np.ndarray]] = []
        have = 0

        def whole() -> None:
            nonlocal have
            x = np.concatenate([h[2] for h in held])
            begin = np.cumsum([0, *(len(h[2]) for h in held)])
            out, _ = self.viterbi(x, *self.lanes(x, begin, True))
            raw = "".join((self.prefix and " ") + h[1] for h in held)
            got, at = self.expanded(out, raw)
            owner = np.searchsorted(begin, at, side="right") - 1
            count[[h[0] for h in held]] = np.bincount(owner, minlength=len(held))
            ids.append(got)
            held.clear()
            have = 0

        for i, t in enumerate(texts):
            if not t:
                continue
            if len(t) < WINDOW:
                x = self.codes(t)
                if held and have + len(x) > WINDOW:
                    whole()
                held.append((i, t, x))
                have += len(x)
                continue
            if held:
                whole()
            for part in self.windows(t):
                ids.append(part)
                count[i] += len(part)
        if held:
            whole()
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), count

    def windows(self, text: str, size: int | None = None) -> Iterator[np.ndarray]:
        """Ids of a text of any length, as they are committed; `size` characters are looked at together, more where paths do not converge."""
        size = size or WINDOW
        raw = (self.prefix and " ") + text if text else ""
        begin, width = 0, size
        while begin < len(raw):
            part = raw[begin : begin + width]
            last = begin + len(part) == len(raw)
            x = self.codes(part, False)
            if not begin and self.prefix:
                x[0] = self.letter[ord(self.prefix)]
            out, to = self.viterbi(x, *self.lanes(x, np.array([0, len(x)]), last))
            if not to:
                width *= 2
                continue
            yield self.expanded(out[:to], part[:to])[0]
            begin, width = begin + to, size

    def lanes(self, x: np.ndarray, texts: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of lanes: at texts, and at the first place of each LANE characters where paths converge."""
        free = self.meets(x)
        free = free[np.diff(free // LANE, prepend=-1) != 0]
        begin = np.unique(np.concatenate((texts[:-1], free)))
        begin = begin[begin < len(x)]
        return begin, np.append(begin[1:], len(x) if last else -1)

    def expanded(self, out: np.ndarray, raw: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, place of each) of committed pieces; characters without a piece become their bytes, or the unknown id."""
        at = np.flatnonzero(out >= 0)
        ids = out[at]
        odd = np.flatnonzero(ids == self.single)
        if not len(odd):
            return ids, at
        many = [self.raw(raw[i]) for i in at[odd].tolist()]
        times = np.ones(len(ids), dtype=np.int64)
        times[odd] = [len(m) for m in many]
        spot = np.cumsum(times) - times
        ids, at = np.repeat(ids, times), np.repeat(at, times)
        fill = np.concatenate([np.arange(s, s + len(m)) for s, m in zip(spot[odd].tolist(), many)])
        ids[fill] = np.concatenate([np.array(m, dtype=np.int32) for m in many])
        return ids, at

    def raw(self, text: str) -> list[int]:
        """Byte pieces of a text without a piece, or the unknown id where the model has none."""
        return [self.bytes.get(b, self.unknown) for b in text.encode()]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; none for null and empty texts."""
        return self.encode_all([text])[0]

    def decode(self, ids: Iterable[int] | None) -> str:
        """The text of ids; ids outside the vocabulary stand for nothing."""
        if ids is None:
            return ""
        out = self.out
        text = b"".join([out[i] for i in ids if 0 <= i < len(out)]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def added(df: DataFrame, column: str, schema: str, make: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """df with the columns of `schema`, made from `column` for some rows at a time; columns of these names are replaced."""
    names = [x.split()[0] for x in schema.split(", ")]
    rest = [c for c in df.columns if c not in names]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema)
    (source,) = fresh(df, "source")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.nbytes // max(b.num_rows, 1) + 1
            step = max(1, min(1024, (4 << 20) // size))
            for start in range(0, b.num_rows, step):
                part = b.slice(start, step)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(rest))), *make(part.column(len(rest)))], [*rest, *names])

    return df.select(*rest, F.col(column).alias(source)).mapInArrow(of, f"{kinds}, {schema}" if kinds else schema)


def lists(ids: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """docs with the ids of each whole text; null and empty texts have none. A column named `ids` is replaced."""
    return added(docs, text, f"{ids} array<int>", lambda texts: [lists(*vocabulary(model).encode_all(texts.to_pylist()))])


def decode(rows: DataFrame, ids: str = "ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """rows with the text of each list of ids; null lists give the empty text."""

    def of(column: pa.Array) -> list[pa.Array]:
        v = vocabulary(model)
        return [pa.array([v.decode(x.as_py()) for x in column], pa.string())]

    return added(rows, ids, f"{text} string", of)


def encoded_digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids and whether the decoded ids give the text back, for every document, in one pass.

    Null texts are empty and have no ids. Repeated rows give repeated rows; an empty table gives none; extra columns are
    ignored. A text of any length is encoded through the same window.
    """

    def of(texts: pa.Array) -> list[pa.Array]:
        v = vocabulary(model)
        plain = texts.to_pylist()
        ids, count = v.encode_all(plain)
        ends = np.cumsum(count).tolist()
        same = [v.decode(ids[e - n : e].tolist()) == (t or "") for t, n, e in zip(plain, count.tolist(), ends)]
        return [pa.array(count), lists(ids, count), pa.array(same)]

    return added(docs.select("doc_id", F.col("text").alias("_text")), "_text", "n_ids long, ids array<int>, round_trip boolean", of).drop("_text")


def op9(spark: SparkSession, sf: str) -> DataFrame:
    return encoded_digest(spark.read.parquet(f"{sf}/documents.parquet"))
