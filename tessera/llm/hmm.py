"""Hidden Markov language model: Baum-Welch counts over all training texts, exact likelihood by scaled forward recursion.

A text is its words and one end token. The STATES hidden states emit classes: each of the commonest tokens, FREQUENT
at most, is a class of its own, all other words are classed by their last three bytes (SUFFIXES classes). A word of such a class
has probability (c + 1) / (C + V + 1) in it, c its count, C and V the class's tokens and distinct words in the training
texts, an unknown word c = 0. So the model's tables are bounded however large the vocabulary is; the vocabulary itself,
with its counts, stays a table that grows with the corpus and is joined.

Starting values come from a bounded sample of whole texts (START_TEXTS and START_TOKENS); then ROUNDS of Baum-Welch add up
expected counts of every training text over all partitions. Texts are whole there too: of a long text the forward state
is kept at seams of SEAM tokens only and each stretch is made again on the way back, so memory is bounded and no
transition is left out. Scores come from the forward recursion over whole texts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, cut, id_hash, sampled

STATES = 8
FREQUENT = 30_000
SUFFIXES = 2_048
ROUNDS = 2
SEAM = 4_096
START_TEXTS = 500
START_TOKENS = 1_000_000
END = b""
BATCH = 1_024
TOKENS = 1_000_000  # in the tables of one batch


def words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased words between \\x20 and \\x09-\\x0D, then the end token."""
    out = (text or b"").lower().split()
    out.append(END)
    return out


def count_words(docs: DataFrame, text: str = "text", most: int = 300_000) -> DataFrame:
    """(w binary, c long): counts of all tokens, added up in each task before they are dealt out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["w", "c"])
            held.clear()
            return b

        for b in batches:
            for t in b.column(0):
                held.update(words(t.as_py()))
                if len(held) > most:
                    yield out()
        if held:
            yield out()

    return docs.select(F.col(text).cast("binary")).mapInArrow(count, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


@dataclass
class Classes:
    """The commonest tokens with their counts, and the totals of the training tokens."""

    place: dict[bytes, int]
    counts: np.ndarray
    total: int
    distinct: int

    def __len__(self) -> int:
        return len(self.place) + SUFFIXES

    def of_rare(self, w: bytes) -> int:
        return len(self.place) + zlib.crc32(w[-3:]) % SUFFIXES


def encode(docs: DataFrame, classes: Classes, id_col: str, text: str) -> DataFrame:
    """For each row: id, held_out, n_tokens, known and base (of frequent tokens), classes as uint16 bytes, rare words and their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(classes)  # at most FREQUENT words
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cl = sent.value
        log = np.log10((cl.counts + 1) / (cl.total + cl.distinct + 1))
        rare = Memo(cl.of_rare)
        get = cl.place.get
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                cols: list[list] = [[] for _ in range(6)]
                for t in b.column(2):
                    ws = words(t.as_py())
                    ids = np.fromiter((get(w, -1) for w in ws), dtype=np.int64, count=len(ws))
                    often = ids >= 0
                    others = [ws[i] for i in np.flatnonzero(~often).tolist()]
                    ids[~often] = [rare[w] for w in others]
                    tf = Counter(others)
                    for c, v in zip(cols, (len(ws), int(often.sum()), float(log[ids[often]].sum()), ids.astype("<u2").tobytes(), list(tf), list(tf.values()))):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", "held_out", "n_tokens", "often", "base", "ids", "rare", "tf"])

    schema = f"id {kind}, held_out boolean, n_tokens long, often long, base double, ids binary, rare array<binary>, tf array<int>"
    return docs.select(F.col(id_col).alias("id"), "held_out", F.col(text).cast("binary")).mapInArrow(of, schema)


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states, states
    emit: np.ndarray  # classes, states


def padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences, longest first, as (time, sequence) and the number alive at each time."""
    n = np.array([len(s) for s in seqs])
    out = np.zeros((n[0], len(seqs)), dtype=np.int64)
    for i, s in enumerate(seqs):
        out[: len(s), i] = s
    return out, np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")


def forward(m: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each sequence (longest first, none empty), by the scaled forward recursion."""
    x, alive = padded(seqs)
    out = np.zeros(len(seqs))
    a = m.start * m.emit[x[0]]
    for t in range(len(x)):
        if t:
            k = alive[t]
            a = (a[:k] @ m.move) * m.emit[x[t, :k]]
        s = a.sum(axis=1)
        a /= s[:, None]
        out[: len(s)] += np.log10(s)
    return out


class Expected:
    """Expected counts of Baum-Welch."""

    def __init__(self, m: Model):
        self.start, self.move, self.emit = np.zeros_like(m.start), np.zeros_like(m.move), np.zeros_like(m.emit)

    def add(self, m: Model, seqs: list[np.ndarray]) -> None:
        """seqs: longest first, none empty."""
        x, alive = padded(seqs)
        states = len(m.start)
        seams = range(0, len(x), SEAM)

        def step(a: np.ndarray | None, t: int) -> tuple[np.ndarray, np.ndarray]:
            k = alive[t]
            f = m.emit[x[t, :k]] * (m.start if a is None else a[:k] @ m.move)
            s = f.sum(axis=1)
            return f / s[:, None], s

        enter: list[np.ndarray | None] = [None]
        a = None
        for t in range(seams[-1]):
            a, _ = step(a, t)
            if (t + 1) % SEAM == 0:
                enter.append(a)
        b = np.ones((x.shape[1], states))
        for begin in reversed(seams):
            end = min(begin + SEAM, len(x))
            width = alive[begin]
            a = enter.pop()
            before, held, scale = a, np.zeros((end - begin, width, states)), np.ones((end - begin, width))
            for t in range(begin, end):
                a, s = step(a, t)
                held[t - begin, : len(a)], scale[t - begin, : len(a)] = a, s
            for t in range(end - 1, begin - 1, -1):
                k = alive[t]
                held[t - begin, :k] *= b[:k]  # from here on the state's share, no more the forward value
                if t:
                    e = m.emit[x[t, :k]] * b[:k] / scale[t - begin, :k, None]
                    self.move += ((held[t - begin - 1] if t > begin else before)[:k].T @ e) * m.move
                    b[:k] = e @ m.move.T
            if not begin:
                self.start += held[0].sum(axis=0)
            live = np.arange(width)[None, :] < alive[begin:end, None]
            ids, g = x[begin:end, :width][live], held[live]
            for s in range(states):
                self.emit[:, s] += np.bincount(ids, weights=g[:, s], minlength=len(self.emit))

    def model(self, prior: np.ndarray, strength: float = 100.0) -> Model:
        """Parameters from the counts; emissions are smoothed towards the classes' own shares, so none is zero."""
        start = self.start + 1
        move = self.move + 1
        emit = (self.emit + strength * prior[:, None]) / (self.emit.sum(axis=0) + strength)
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit)


def classes_of(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, dtype="<u2").astype(np.int64)


def in_batches(m: Model, e: Expected, seqs: list[np.ndarray]) -> None:
    seqs = sorted(seqs, key=len, reverse=True)
    i = 0
    while i < len(seqs):
        n = len(seqs[i])
        many = max(1, min(BATCH, TOKENS // min(n, SEAM), 4 * TOKENS // n))
        e.add(m, seqs[i : i + many])
        i += many


def starting_values(texts: list[bytes], prior: np.ndarray, states: int, rounds: int = 8, seed: int = 5) -> Model:
    """Baum-Welch on a bounded sample of whole texts, from states that lean to the words of different texts."""
    rng = np.random.default_rng(seed)
    seqs = [classes_of(t) for t in texts]
    emit = np.repeat(prior[:, None], states, axis=1)
    for s in range(states):
        for i in rng.choice(len(seqs), min(5, len(seqs)), replace=False) if seqs else ():
            emit[:, s] += np.bincount(seqs[i], minlength=len(prior)) / (5 * len(seqs[i]))
    emit /= emit.sum(axis=0)
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    m = Model(np.full(states, 1 / states), move, emit)
    for _ in range(rounds if seqs else 0):
        e = Expected(m)
        in_batches(m, e, seqs)
        m = e.model(prior, 20.0)
    return m


def baum_welch(rows: DataFrame, m: Model, prior: np.ndarray) -> Model:
    """One round over all rows (ids binary): expected counts are added up by class across partitions."""
    sent = rows.sparkSession.sparkContext.broadcast(m)
    states, classes = len(m.start), len(m.emit)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Expected(sent.value)
        held: list[np.ndarray] = []
        have = 0
        for b in batches:
            for ids in b.column(0):
                held.append(classes_of(ids.as_py()))
                have += len(held[-1])
                if have >= 2 * TOKENS:
                    in_batches(sent.value, e, held)
                    held, have = [], 0
        if held:
            in_batches(sent.value, e, held)
        whole = np.concatenate((e.emit, e.move, e.start[None, :]))
        at = np.flatnonzero(whole.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(whole[at, s]) for s in range(states))], ["at", *(f"s{s}" for s in range(states))])

    schema = "at long, " + ", ".join(f"s{s} double" for s in range(states))
    got = rows.select("ids").mapInArrow(expect, schema).groupBy("at").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(states))).toPandas()  # a row for each class and state at most
    e = Expected(m)
    whole = np.zeros((classes + states + 1, states))
    whole[got["at"].to_numpy()] = got[[f"s{s}" for s in range(states)]].to_numpy()
    e.emit, e.move, e.start = whole[:classes], whole[classes : classes + states], whole[-1]
    return e.model(prior)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; texts are whole.

    Learns from rows whose crc32(id as text) mod 7 is not 2 (a null id counts as the empty text). Null texts are empty:
    they have the end token only. Repeated rows count as often as they stand there; an empty table gives no rows; extra
    columns are ignored. Without a training text every word is unknown and the states emit all classes alike.
    """
    spark = docs.sparkSession
    docs = docs.select(id_col, text, (id_hash(F.col(id_col)) % 7 == 2).alias("held_out"))
    counts = cut(count_words(docs.where("not held_out"), text), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("c")).first()
    # The frequent words are those of the highest classes of counts; the last class that has room gives a sample by hash.
    level = F.floor(F.log2("c") * 64)
    edge, have, part = None, 0, None
    for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():  # at most 64 * 63 rows
        if have + r.n > frequent:
            part = r
            break
        have += r.n
        edge = r.level
    top = counts.where(level >= edge).collect() if edge is not None else []  # at most `frequent` rows
    others = counts.where(level < edge) if edge is not None else counts
    if part is not None and have < frequent:
        more = cut(sampled(counts.where(level == part.level), frequent - have, part.n, "w").select("w", "c"), "filling")
        top += more.collect()
        # The sample is thinned before it is sorted, so no bound on the hash tells its words from the others.
        others = counts.where(level <= part.level).join(F.broadcast(more.select("w")), "w", "left_anti")
    top = sorted(top, key=lambda r: (-r.c, r.w))
    classes = Classes({bytes(r.w): i for i, r in enumerate(top)}, np.array([r.c for r in top], dtype=np.float64), total, distinct)
    suffix = lambda w: (F.crc32(F.substring(w, -3, 3)) % SUFFIXES).cast("int")
    sums = others.groupBy(suffix(F.col("w")).alias("suffix")).agg(F.sum("c").alias("cs"), F.count("c").alias("vs")).collect()  # at most SUFFIXES rows
    mass = np.zeros(SUFFIXES)
    below = np.ones(SUFFIXES)
    for r in sums:
        mass[r.suffix] = r.cs
        below[r.suffix] = r.cs + r.vs + 1
    prior = np.concatenate((classes.counts, mass)) + 0.5
    prior /= prior.sum()

    rows = cut(encode(docs, classes, id_col, text).withColumn("row", F.monotonically_increasing_id()), "encoded")
    learn = rows.where("not held_out")
    so_far = Window.orderBy(F.xxhash64("row"), "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of START_TEXTS rows at most
    sample = sampled(learn.select("ids", "n_tokens", "row"), START_TEXTS, learn.count(), "row").withColumn("so_far", F.sum("n_tokens").over(so_far)).where(F.col("so_far") <= START_TOKENS).select("ids").collect()
    m = starting_values([bytes(r.ids) for r in sample], prior, states)
    for _ in range(rounds if total else 0):
        m = baum_welch(learn, m, prior)
    sent = spark.sparkContext.broadcast(m)  # (FREQUENT + SUFFIXES) x STATES doubles at most

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = [np.frombuffer(x.as_py(), dtype="<u2") for x in b.column(1)]
            order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
            out = np.zeros(len(seqs))
            i = 0
            while i < len(order):
                n = max(1, min(BATCH, 4_000_000 // len(seqs[order[i]])))
                part = order[i : i + n]
                out[part] = forward(sent.value, [seqs[j] for j in part])
                i += n
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["row", "states_score"])

    hidden = rows.select("row", "ids").mapInArrow(likelihood, "row long, states_score double")
    # Words outside the frequent ones: none of them has more than 1/FREQUENT of the tokens, so their join has no hot key.
    rare = rows.select("row", F.explode(F.arrays_zip(F.col("rare").alias("w"), F.col("tf").alias("tf"))).alias("x")).select("row", F.col("x.w").alias("w"), F.col("x.tf").alias("tf"))
    lows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(below)], "suffix int, below double")
    c = F.coalesce("c", F.lit(0))
    of_rare = (
        rare.join(others, "w", "left").withColumn("suffix", suffix(F.col("w"))).join(F.broadcast(lows), "suffix").groupBy("row")
        .agg(F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("rare_known"), F.sum(F.col("tf") * F.log10((c + 1) / F.lit(float(total + distinct + 1)))).alias("rare_base"), F.sum(F.col("tf") * F.log10((c + 1) / F.col("below"))).alias("rare_score"))
    )
    zero = lambda x: F.coalesce(x, F.lit(0))
    return (
        rows.select("row", "id", "held_out", "n_tokens", "often", "base").join(hidden, "row").join(of_rare, "row", "left")
        .select(
            F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("often") + zero(F.col("rare_known"))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base") + zero(F.col("rare_base"))).alias("base_score"), (F.col("states_score") + zero(F.col("rare_score"))).alias("score"),
        )
    )


def op3(spark: SparkSession, sf: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf}/documents.parquet"))
