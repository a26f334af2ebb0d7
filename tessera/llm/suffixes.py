"""Suffix-array deduplication: each byte covered by a LENGTH-byte string that also starts in a smaller document goes.

A suffix sort of the whole corpus would move several times its bytes, so it is dealt out first. Each window of LENGTH
bytes is known by its minimizer, the 24-byte word of least hash in it; equal windows have equal minimizers. Neighbouring
windows of one minimizer make one string of at most ROW bytes. Minimizers that occur once in the corpus rule their
windows out; the others' strings meet, unique by block, in buckets by minimizer. A bucket builds the suffix array of its
distinct strings by the difference-cover algorithm (triples at positions 1 and 2 modulo 3 are sorted and named, names
are sorted recursively, the remaining suffixes are merged), compares adjacent prefixes of LENGTH bytes, and answers each
block with a bit for each window: does a smaller document hold it? Minimizers with over HOT occurrences send single
windows, dealt by their own hash. Hashes only decide where strings meet; equality is that of bytes.

Texts go in compressed blocks of about BLOCK bytes; blocks and messages are written tables or shuffles, nothing is
collected, and the number of buckets follows the bytes of the corpus. A message is for a stretch of neighbouring buckets,
so a block sends MESSAGES at most and messages grow in proportion to the corpus, until stretches are WIDEST (64 GB of
text); beyond that they grow with the square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

LENGTH = 50
WORD = 24
BLOCK = 8 << 20
BUCKET = 2 << 20  # bytes of the corpus for each bucket
MESSAGES, WIDEST = 256, 128  # messages of a block to buckets; buckets in one message
HOT = 50_000
PIECE = 1 << 21  # windows looked at together
WORDS = 11  # of eight bytes in a row
ROW = 8 * WORDS
NO_ID = np.iinfo(np.int64).max  # a null id: no document is larger
_LOW = np.uint64((1 << 26) - 1)


def pack(x: bytes | np.ndarray) -> bytes:
    return zstandard.compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes(), 3)


def planes(x: np.ndarray) -> bytes:
    """Packed integers, byte by byte of all of them."""
    return pack(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T)


def unplanes(b: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8) if b else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight-byte word at every byte of padded data."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))


def minimizers(data: np.ndarray, ends: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, minimizer's hash) of each string of data[:n], which is padded; ends: of the documents."""
    w = length - WORD + 1
    out: list[tuple[np.ndarray, ...]] = []
    for a in range(0, n, PIECE):
        b = min(a + PIECE, n)
        m = b - a + w - 1
        u = words_at(data[a : b + w + WORD])
        h = mix(mix(mix(u[:m] * np.uint64(0x9E3779B97F4A7C15)) + u[8 : m + 8] * np.uint64(0xC2B2AE3D27D4EB4F)) + u[16 : m + 16] * np.uint64(0x94D049BB133111EB))
        least = (h & ~_LOW) | np.arange(m, dtype=np.uint64)  # of equal hashes the leftmost
        width = 1
        while 2 * width <= w:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < w:
            least = np.minimum(least[: b - a], least[w - width :])
        at = (least & _LOW).astype(np.int64)
        off = np.zeros(b - a + 1, dtype=np.int32)  # windows that would pass a document's end
        first, last = np.searchsorted(ends, (a, b + length), side="right")
        for i in range(int(first), int(min(last + 1, len(ends)))):
            x, y = max(ends[i] - length + 1, ends[i - 1] if i else 0, a), min(int(ends[i]), b)
            if x < y:
                off[x - a] += 1
                off[y - a] -= 1
        valid = np.cumsum(off[:-1]) == 0
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
        start = np.flatnonzero(new)
        if len(start):
            c = np.cumsum(valid)
            count = np.append(c[start[1:] - 1], c[-1]) - c[start] + 1
            out.append((start + a, count, h[at[start]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def rows_of(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Strings of padded data as rows of WORDS words, zero after their end."""
    u = words_at(data)
    rows = np.empty((len(start), WORDS), dtype=np.uint64)
    for j in range(WORDS):
        keep = np.clip(size - 8 * j, 0, 8).astype(np.uint64)
        x = u[np.minimum(start + 8 * j, len(u) - 1)]
        rows[:, j] = np.where(keep == 8, x, x & ((np.uint64(1) << (np.uint64(8) * (keep & np.uint64(7)))) - np.uint64(1)))
    return rows


def row_hash(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(rows.shape[1]):
        h = mix(h + rows[:, j] * np.uint64(0xC2B2AE3D27D4EB4F))
    return h


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def short_key(key: np.ndarray) -> np.ndarray:
    return key & np.uint64((1 << 40) - 1)


@dataclass
class Block:
    data: np.ndarray  # padded by ROW zero bytes
    n: int
    ids: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(ids: bytes, sizes: bytes, texts: bytes) -> Block:
        raw = zstandard.decompress(texts)
        return Block(np.frombuffer(raw + bytes(ROW + WORD), np.uint8), len(raw), np.frombuffer(ids, np.int64), np.cumsum(np.frombuffer(sizes, np.int64)))


def blocks_of(docs: DataFrame, id_col: str, text: str, block: int) -> DataFrame:
    """(block, bytes, ids, sizes, texts): documents packed into compressed blocks, a longer document in one of its own."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        ids: list[int] = []
        texts: list[bytes] = []
        have = 0

        def out() -> pa.RecordBatch:
            nonlocal number, have
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            row = [base + number], [have], [np.array(ids, dtype=np.int64).tobytes()], [sizes.tobytes()], [pack(b"".join(texts))]
            number, have = number + 1, 0
            ids.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["block", "bytes", "ids", "sizes", "texts"])

        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                i, t = i.as_py(), t.as_py() or b""
                if texts and have + len(t) > block:
                    yield out()
                ids.append(NO_ID if i is None else i)
                texts.append(t)
                have += len(t)
        if texts:
            yield out()

    schema = "block long, bytes long, ids binary, sizes binary, texts binary"
    return docs.select(F.col(id_col).cast("long"), F.col(text).cast("binary")).mapInArrow(of, schema)


def runs(x: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


def width_of(buckets: int) -> int:
    """Buckets in one message: so many that a block sends MESSAGES at most, up to WIDEST, which bounds what a task gathers."""
    return max(8, min(WIDEST, -(-buckets // MESSAGES)))


def table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}
    names = [x.strip().split() for x in schema.split(",")]
    return pa.table({n: pa.array([r[i] for r in rows], kinds[k]) for i, (n, k) in enumerate(names)})


ASKED = "stretch int, block long, buckets array<int>, keys array<binary>, counts array<binary>"
ANSWER = "block long, kind int, buckets array<int>, said array<binary>"
STRINGS = "stretch int, block long, buckets array<int>, windows array<binary>, keys array<binary>, least array<binary>, bytes array<binary>"


def message(rows: list[tuple], block: int, width: int, bucket: int, *values: bytes) -> None:
    """Add what a block says to a bucket to its message to the bucket's stretch of `width` buckets; buckets come in order."""
    if not rows or rows[-1][0] != bucket // width:
        rows.append((bucket // width, block, [], *([] for _ in values)))
    for column, v in zip(rows[-1][2:], (bucket, *values)):
        column.append(v)


def by_bucket(t: pa.Table, names: tuple[str, ...], kind: int, f: Callable[..., list[bytes]]) -> pa.Table:
    """Answers to the messages of one stretch: f is called for one bucket after the other with what all blocks sent to it."""
    sent: dict[int, list[tuple]] = {}
    for r in t.to_pylist():
        for b, *values in zip(r["buckets"], *(r[n] for n in names)):
            sent.setdefault(b, []).append((r["block"], *values))
    said: dict[int, tuple[list[int], list[bytes]]] = {}
    for b in sorted(sent):
        blocks, *columns = zip(*sent.pop(b))
        for block, answer in zip(blocks, f(*columns)):
            own = said.setdefault(block, ([], []))
            own[0].append(b)
            own[1].append(answer)
    return table(ANSWER, [(block, kind, *own) for block, own in said.items()])


def answers_of(rows: list[dict], kind: int) -> dict[int, bytes]:
    return {b: x for r in rows if r["kind"] == kind for b, x in zip(r["buckets"], r["said"])}


def ask(blocks: DataFrame, buckets: int, length: int) -> DataFrame:
    """Each block's distinct minimizers with their counts, by bucket."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                number, ids, sizes, texts = (batch.column(c)[r].as_py() for c in ("block", "ids", "sizes", "texts"))
                b = Block.of(ids, sizes, texts)
                key = np.sort(minimizers(b.data, b.ends, b.n, length)[2])
                at = runs(key)
                count = np.minimum(np.diff(np.append(at, len(key))), 255).astype(np.uint8)
                key = key[at]
                to = bucket_of(key, buckets)
                order = np.argsort(to, kind="stable")
                to, key, count = to[order], short_key(key[order]), count[order]
                rows: list[tuple] = []
                edges = np.append(runs(to), len(to))
                for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    k = np.sort(key[x:y] << np.uint64(8) | count[x:y])  # the answer is in this order
                    message(rows, number, width_of(buckets), int(to[x]), planes(k >> np.uint64(8)), pack((k & np.uint64(255)).astype(np.uint8)))
                yield from table(ASKED, rows).to_batches()

    return blocks.mapInArrow(of, ASKED)


def answer(asked: DataFrame, hot: int) -> DataFrame:
    """For each asked minimizer: 0 if it occurs once in the corpus, 1 if more often, 2 if more than `hot` times."""

    def of(keys: tuple[bytes, ...], counts: tuple[bytes, ...]) -> list[bytes]:
        keys = [unplanes(x, "<u8") for x in keys]
        counts = [np.frombuffer(zstandard.decompress(x), np.uint8) for x in counts]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        at = runs(every[order])
        total = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), at)
        said = np.empty(len(every), dtype=np.uint8)
        said[order] = np.repeat((total > 1).astype(np.uint8) + (total > hot), np.diff(np.append(at, len(every))))
        parts = np.split(said, np.cumsum([len(k) for k in keys])[:-1])
        return [pack(p) for p in parts]

    return asked.groupBy("stretch").applyInArrow(lambda t: by_bucket(t, ("keys", "counts"), 1, of), ANSWER)


@dataclass
class Strings:
    """The strings of a block that may be held elsewhere: occurrences in the order of their distinct strings."""

    start: np.ndarray
    windows: np.ndarray
    key: np.ndarray
    bucket: np.ndarray
    id: np.ndarray
    rows: np.ndarray
    first: np.ndarray  # of the occurrences of each distinct string
    least: np.ndarray  # id of each distinct string

    @staticmethod
    def of(b: Block, said: dict[int, bytes], buckets: int, length: int) -> Strings:
        start, windows, key = minimizers(b.data, b.ends, b.n, length)
        to = bucket_of(key, buckets)
        # The answers stand in the order of bucket and short key; keys that share a short key are answered alike.
        order = np.lexsort((key, short_key(key), to))
        same = runs(key[order])
        every = [np.frombuffer(zstandard.decompress(said[i]), np.uint8) for i in sorted(said)]
        level = np.zeros(len(key), dtype=np.uint8)
        level[order] = np.repeat(np.concatenate(every) if every else np.zeros(0, np.uint8), np.diff(np.append(same, len(key))))
        keep = level > 0
        start, windows, key, to, level = start[keep], windows[keep], key[keep], to[keep], level[keep]
        if (level == 2).any():  # single windows
            times = np.where(level == 2, windows, 1)
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            single = np.repeat(level == 2, times)
            start, key, windows = np.repeat(start, times) + step, np.repeat(key, times), np.where(single, 1, np.repeat(windows, times))
            rows = rows_of(b.data, start, windows + length - 1)
            key = np.where(single, row_hash(rows, windows + length - 1), key)
            to = bucket_of(key, buckets)
        else:
            rows = rows_of(b.data, start, windows + length - 1)
        order = np.lexsort((row_hash(rows, windows), key, to))
        start, windows, key, to, rows = start[order], windows[order], key[order], to[order], rows[order]
        id_ = b.ids[np.searchsorted(b.ends, start, side="right")]
        new = np.ones(len(start), dtype=bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1) | (windows[1:] != windows[:-1]) | (key[1:] != key[:-1])
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(id_, first) if len(first) else np.zeros(0, np.int64)
        return Strings(start, windows, key, to, id_, rows, first, least)


def send(blocks: DataFrame, answers: DataFrame, buckets: int, length: int) -> DataFrame:
    """Each block's distinct strings whose minimizers occur more than once, by bucket."""

    def of(mine: pa.Table, said: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        told = answers_of(said.to_pylist(), 1)
        for r in mine.to_pylist():
            s = Strings.of(Block.of(r["ids"], r["sizes"], r["texts"]), told, buckets, length)
            f = s.first
            edges = np.append(runs(s.bucket[f]), len(f))
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
                at = f[x:y]
                size = s.windows[at] + length - 1
                letters = np.ascontiguousarray(s.rows[at]).view(np.uint8).reshape(-1, ROW)[np.arange(ROW) < size[:, None]]
                message(rows, r["block"], width_of(buckets), int(s.bucket[at[0]]), pack(s.windows[at].astype(np.uint8)), planes(s.key[at].astype(np.uint32)), planes(s.least[x:y]), pack(letters))
        return table(STRINGS, rows)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(of, STRINGS)


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Suffix array of an array of positive integers, by the difference cover {1, 2} modulo 3."""
    n = len(x)
    if n < 2:
        return np.arange(n)
    s = np.concatenate((x.astype(np.int64), np.zeros(3, np.int64)))
    top = int(s.max()) + 1
    # Sort the sampled triples and name them.
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    if top < 2_000_000:
        triple = (s[sample] * top + s[sample + 1]) * top + s[sample + 2]
        order = np.argsort(triple, kind="stable")
        new = np.diff(triple[order], prepend=-1) != 0
    else:
        head, tail = s[sample] * top + s[sample + 1], s[sample + 2]
        order = np.lexsort((tail, head))
        new = (np.diff(head[order], prepend=-1) != 0) | (np.diff(tail[order], prepend=-1) != 0)
    name = np.empty(len(sample), dtype=np.int64)
    name[order] = np.cumsum(new)
    # Recurse on the names where they are not unique.
    by_sample = np.argsort(name) if new.all() else suffix_array(name)
    sampled = sample[by_sample]
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    rank[n:] = 0
    # Sort the remaining suffixes by their first letter and the rank of what follows, and merge.
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    wide = n + 4
    rest = rest[np.argsort(s[rest] * wide + rank[rest + 1], kind="stable")]
    if top * top < 2**62 // wide:
        pair = s[:-1] * top + s[1:]
    else:
        pair = np.unique(s[:-1] * top + s[1:], return_inverse=True)[1]
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(s[ones] * wide + rank[ones + 1], s[rest] * wide + rank[rest + 1]) + np.searchsorted(pair[twos] * wide + rank[twos + 2], pair[rest] * wide + rank[rest + 2])
    out = np.empty(n, dtype=np.int64)
    place = before + np.arange(len(rest))
    out[place] = rest
    free = np.ones(n, dtype=bool)
    free[place] = False
    out[free] = sampled
    return out


def least_holders(rows: np.ndarray, windows: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """For each window of the distinct strings, in order: the least id of the strings that hold it."""
    size = windows + length - 1
    letters = np.ascontiguousarray(rows).view(np.uint8).reshape(-1, ROW).astype(np.int16) + 1
    letters = np.concatenate((letters, np.zeros((len(rows), 1), np.int16)), axis=1)
    used = np.arange(ROW + 1) < size[:, None] + 1
    letters[np.arange(len(rows)), size] = 1  # a string's end sorts first
    letters[:, :ROW][np.arange(ROW) < size[:, None]] += 1
    text = letters[used]
    begin = np.cumsum(size + 1) - (size + 1)
    suffixes = suffix_array(text)
    # Windows in the order of the suffix array, and whether each has the prefix of the one before.
    owner = np.repeat(np.arange(len(rows)), size + 1)
    offset = suffixes - begin[owner[suffixes]]
    suffixes = suffixes[offset < windows[owner[suffixes]]]
    flat = np.concatenate(((text - 2).clip(0).astype(np.uint8), np.zeros(ROW, np.uint8)))
    u = words_at(flat)
    new = np.ones(len(suffixes), dtype=bool)
    for j in range(0, length, 8):
        j = min(j, length - 8)
        x = u[suffixes + j]
        same = x[1:] == x[:-1]
        new[1:] = ~same if not j else new[1:] | ~same
    at = np.flatnonzero(new)
    group = np.repeat(np.minimum.reduceat(least[owner[suffixes]], at), np.diff(np.append(at, len(suffixes))))
    out = np.empty(len(text), dtype=np.int64)
    out[suffixes] = group
    return out[(np.arange(ROW + 1) < windows[:, None])[used]]


def resolve(strings: DataFrame, length: int) -> DataFrame:
    """For each string that a block sent, bits of its windows: a document smaller than the block's least holder has it."""

    def of(windows: tuple[bytes, ...], keys: tuple[bytes, ...], least: tuple[bytes, ...], letters: tuple[bytes, ...]) -> list[bytes]:
        windows = [np.frombuffer(zstandard.decompress(x), np.uint8).astype(np.int64) for x in windows]
        key = np.concatenate([unplanes(x, "<u4") for x in keys])
        least = np.concatenate([unplanes(x, "<i8") for x in least])
        sent = [len(w) for w in windows]
        count = np.concatenate(windows)
        size = count + length - 1
        rows = np.zeros((len(count), ROW), dtype=np.uint8)
        rows[np.arange(ROW) < size[:, None]] = np.frombuffer(b"".join(map(zstandard.decompress, letters)), np.uint8)
        rows = rows.view("<u8")
        order = np.lexsort((row_hash(rows, size), key))
        key_, rows_, count_, least_ = key[order], rows[order], count[order], least[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (rows_[1:] != rows_[:-1]).any(axis=1) | (count_[1:] != count_[:-1]) | (key_[1:] != key_[:-1])
        first = np.flatnonzero(new)
        string = np.cumsum(new) - 1
        holder = np.minimum.reduceat(least_, first)
        whole = (np.uint64(1) << count_.astype(np.uint64)) - np.uint64(1)
        mask_ = np.where(holder[string] < least_, whole, np.uint64(0))
        # Minimizers with one distinct string are done; the others' strings are sorted.
        kind = np.cumsum(np.diff(key_[first].astype(np.int64), prepend=-1) != 0) - 1
        many = np.bincount(kind)[kind] > 1
        if many.any():
            at = first[many]
            held = least_holders(rows_[at], count_[at], holder[many], length)
            begin = np.zeros(len(first), dtype=np.int64)
            begin[many] = np.cumsum(count_[at]) - count_[at]
            asks = np.flatnonzero(many[string])
            n = count_[asks]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            smaller = held[np.repeat(begin[string[asks]], n) + step] < np.repeat(least_[asks], n)
            mask_[asks] = np.bitwise_or.reduceat(smaller.astype(np.uint64) << step.astype(np.uint64), np.cumsum(n) - n)
        mask = np.empty(len(order), dtype=np.uint32)
        mask[order] = mask_.astype(np.uint32)
        parts = np.split(mask, np.cumsum(sent)[:-1])
        return [planes(p) for p in parts]

    return strings.groupBy("stretch").applyInArrow(lambda t: by_bucket(t, ("windows", "keys", "least", "bytes"), 2, of), ANSWER)


def covered(b: Block, s: Strings, said: dict[int, bytes], length: int) -> np.ndarray:
    """Which bytes of a block go."""
    mask = np.concatenate([unplanes(said[i], "<u4") for i in sorted(said)]) if said else np.zeros(0, np.uint32)
    string = np.repeat(np.arange(len(s.first)), np.diff(np.append(s.first, len(s.start))))
    own = np.where(s.id > s.least[string], np.uint32(0xFFFFFFFF), mask[string])
    starts = np.zeros(b.n, dtype=bool)
    for j in range(int(s.windows.max(initial=0))):
        hit = (s.windows > j) & ((own >> np.uint32(j)) & np.uint32(1) == 1)
        starts[s.start[hit] + j] = True
    c = np.cumsum(starts, dtype=np.int32)
    c[length:] -= c[:-length].copy()
    return c > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, block: int = BLOCK, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """(id long, n_bytes, kept binary, spans array<struct<start, end>>): every text without its repeated bytes.

    A byte goes if a string of `length` bytes (32 to 55) that covers it also starts in a document with a smaller id.
    Spans are maximal runs of removed bytes, in bytes of the input. Null texts are empty and keep the empty text; a null
    id is larger than all others; rows that repeat an id are not smaller than each other. An empty table gives no
    rows; extra columns are ignored.
    """
    if not 32 <= length <= 55:
        raise ValueError("length: 32 to 55 bytes")
    blocks = cut(blocks_of(docs, id_col, text, block), "blocks")
    total = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // bucket))
    answers = cut(answer(ask(blocks, buckets, length), hot), "minimizers")
    masks = cut(resolve(send(blocks, answers, buckets, length), length), "windows")
    final = "id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>"

    def of(mine: pa.Table, said: pa.Table) -> pa.Table:
        ids, sizes, kept, spans = [], [], [], []
        told = {kind: answers_of(said.to_pylist(), kind) for kind in (1, 2)}
        for r in mine.to_pylist():
            b = Block.of(r["ids"], r["sizes"], r["texts"])
            gone = covered(b, Strings.of(b, told[1], buckets, length), told[2], length)
            begin = 0
            for i, end in zip(b.ids.tolist(), b.ends.tolist()):
                g = gone[begin:end]
                edges = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist() if g.any() else []
                ids.append(None if i == NO_ID else i)
                sizes.append(end - begin)
                kept.append((b.data[begin:end][~g] if edges else b.data[begin:end]).tobytes())
                spans.append([{"start": x, "end": y} for x, y in edges])
                begin = end
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, kind)})

    return blocks.groupBy("block").cogroup(answers.union(masks).groupBy("block")).applyInArrow(of, final).withColumnRenamed("id", id_col)


def op10(spark: SparkSession, sf: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf}/documents.parquet"))
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
