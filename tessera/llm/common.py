"""Helpers shared by the operators: cut lineage, vectorised hashing, tiles and components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, one is made for a local session; a cluster must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Paths of the tables that cut() wrote in this session and discard() has not removed, by the frame that reads them.
_WRITTEN: WeakKeyDictionary = WeakKeyDictionary()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete tables written by cut(), once all that was made from them is itself written."""
    for df in frames:
        path = _WRITTEN.pop(df, None) if df is not None else None
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_hash(col) -> F.Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def sampled(df: DataFrame, n: int, total: int, *key) -> DataFrame:
    """n rows (all, if fewer) of `total`, in the order of a hash of a key that differs from row to row.

    Rows are thinned by that hash before they are sorted, so about n rows are sorted and sent in all, not n by partition.
    """
    share = min(1.0, (1.25 * n + 200) / max(total, 1))
    place = F.xxhash64(*key)
    return df.where(F.pmod(place, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(place, *key).limit(n)


def hex64(col) -> F.Column:
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of uint64."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: For each byte, its bits spread over the eight bytes of a uint64.
SPREAD = np.array([sum(((b >> j) & 1) << (8 * j) for j in range(8)) for b in range(256)], dtype=np.uint64)


def majority_bits(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """SimHash of consecutive runs of 64-bit hashes: bit set when over half the run's hashes have it; an empty run gives 0."""
    out = np.zeros(len(lengths), dtype=np.uint64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    n = lengths[full].astype(np.int64)
    begins = np.concatenate(([0], np.cumsum(n)[:-1]))
    parts = (n + 254) // 255  # a byte lane holds sums up to 255
    first = np.concatenate(([0], np.cumsum(parts)[:-1]))
    within = np.arange(parts.sum()) - np.repeat(first, parts)
    cuts = np.repeat(begins, parts) + 255 * within
    octets = np.ascontiguousarray(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    bits = np.empty((len(full), 64), dtype=bool)
    for k in range(8):
        lanes = np.add.reduceat(SPREAD[octets[:, k]], cuts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        bits[:, 8 * k : 8 * k + 8] = 2 * sums > n[:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which 64-bit fingerprints differ. Signed ones are counted as they are stored, not by absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64)


class Memo(dict):
    """A bounded cache of a function of one argument."""

    def __init__(self, f: Callable, most: int = 200_000):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.f(key)
        return value


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (node, smallest node of its component) that link the same nodes as the given pairs."""
    parent: dict[int, int] = {}
    for a, b in zip(left.tolist(), right.tolist()):
        ra = a
        while (p := parent.setdefault(ra, ra)) != ra:
            ra = p
        rb = b
        while (p := parent.setdefault(rb, rb)) != rb:
            rb = p
        low, high = (ra, rb) if ra < rb else (rb, ra)
        parent[high] = low
        parent[a] = parent[b] = low
    nodes, roots = [], []
    for x in parent:
        r = x
        while parent[r] != r:
            r = parent[r]
        if r != x:
            nodes.append(x)
            roots.append(r)
    return np.array(nodes, dtype=np.int64), np.array(roots, dtype=np.int64)


def numbered(h: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of consecutive runs in which the second, third, ... equal hash of a run is made another one, so that no
    repeated feature outweighs all others in a majority."""
    if not len(h):
        return h
    run = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    key = splitmix(h ^ splitmix(run))
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    out = h.copy()
    if not len(twice):
        return out
    # The few whose low bits are those of a repeated key are put in order.
    some = np.zeros(1 << 20, dtype=bool)
    low = np.uint64(len(some) - 1)
    some[(twice & low).astype(np.int64)] = True
    at = np.flatnonzero(some[(key & low).astype(np.int64)])
    order = at[np.argsort(key[at], kind="stable")]
    key = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    again = np.flatnonzero(place)
    out[order[again]] = splitmix(h[order[again]] + place[again].astype(np.uint64))
    return out


TABLE_BITS = 26  # of a table of wanted hashes: 8 MB, whatever the corpus


def in_table(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which uint64 hashes a table of bits may contain."""
    s = h & np.uint64((1 << TABLE_BITS) - 1)
    return (table[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1) == 1


def table_of(hashes: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray] = lambda b: splitmix(b.column(0).to_numpy().view(np.uint64))) -> np.ndarray:
    """A table of 2**TABLE_BITS bits with one set for each row's hash, or-ed across partitions.

    With it rows are looked for where they stand, and only those that may be wanted are dealt out; a join then drops what
    is not. A fuller table rules fewer rows out, the result stays the same.
    """

    def ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (TABLE_BITS - 6), dtype=np.uint64)
        for b in batches:
            s = of(b) & np.uint64((1 << TABLE_BITS) - 1)
            np.bitwise_or.at(table, (s >> np.uint64(6)).astype(np.int64), np.uint64(1) << (s & np.uint64(63)))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at].view(np.int64))], ["word", "ones"])

    got = hashes.mapInArrow(ones, "word int, ones long").groupBy("word").agg(F.bit_or("ones").alias("ones")).toArrow()  # 2**(TABLE_BITS - 6) rows at most
    table = np.zeros(1 << (TABLE_BITS - 6), dtype=np.uint64)
    table[got["word"].to_numpy()] = got["ones"].to_numpy().view(np.uint64)
    return table


def pairs_of_runs(key: np.ndarray, longest: int, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i < j) of equal neighbours in sorted keys, some at a time, for runs of at most `longest`."""
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(key)))
    last = np.repeat(np.where(size <= longest, first + size, 0), size)
    width = np.maximum(last - np.arange(len(key)) - 1, 0)
    rows = np.flatnonzero(width)
    total = np.cumsum(width[rows])
    done = 0
    while done < len(rows):
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + most, side="right")))
        left, n = rows[done:stop], width[rows[done:stop]]
        yield np.repeat(left, n), np.repeat(left + 1, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        done = stop


TILE = 512


def tiles(rows: DataFrame, name: str) -> DataFrame:
    """Deal rows (key, role, ...) to tiles of about TILE by TILE rows so that no key becomes one large task.

    role 0: stands on the left, 1: on the right, 2: on both sides. Every left row meets every right row of its key in
    exactly one tile (key, ti, tj). Rows of small keys stay as they are; those of large keys are replicated once for
    each block of the other side. `rows` is read twice, so it should be cheap to make or a written table.
    """
    side = rows.groupBy("key").agg(
        F.sum(F.when(F.col("role") != 1, 1).otherwise(0)).alias("nl"),
        F.sum(F.when(F.col("role") != 0, 1).otherwise(0)).alias("nr"),
    )
    hot = cut(side.where((F.col("nl") > 2 * TILE) | (F.col("nr") > 2 * TILE)).where("nl > 0 and nr > 0"), f"{name}-hot")
    split = rows.join(
        hot.select("key", F.ceil(F.col("nl") / TILE).alias("bl"), F.ceil(F.col("nr") / TILE).alias("br")), "key", "left"
    )
    rest = [c for c in rows.columns if c not in ("key", "role")]
    spot = F.xxhash64(*rest)
    tile = F.when(
        F.col("bl").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("ti"), F.lit(0).cast("long").alias("tj"), F.col("role")))
    ).otherwise(
        F.concat(
            F.when(F.col("role") != 1, F.transform(F.sequence(F.lit(0).cast("long"), F.col("br") - 1), lambda j: F.struct(F.pmod(spot, F.col("bl")).cast("long").alias("ti"), j.alias("tj"), F.lit(0).alias("role")))).otherwise(F.array()),
            F.when(F.col("role") != 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("bl") - 1), lambda i: F.struct(i.alias("ti"), F.pmod(spot, F.col("br")).cast("long").alias("tj"), F.lit(1).alias("role")))).otherwise(F.array()),
        )
    )
    out = split.select("key", *rest, F.explode(tile).alias("t")).select("key", "t.ti", "t.tj", "t.role", *rest)
    return out.repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj")


def tile_pairs(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """For rows sorted into tiles: (table, left rows, right rows), for all pairs of a tile's left and right rows."""
    held: list[pa.RecordBatch] = []

    def work(t: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        role = t["role"].to_numpy()
        group = starts_of(t)
        left, right = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        begin = np.searchsorted(group[right], group[left], side="left")
        width = np.searchsorted(group[right], group[left], side="right") - begin
        total = np.cumsum(width)
        done = 0
        while done < len(left):
            base = total[done - 1] if done else 0
            stop = max(done + 1, int(np.searchsorted(total, base + most, side="right")))
            n = width[done:stop]
            pl = np.repeat(left[done:stop], n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pr = right[np.repeat(begin[done:stop], n) + offset]
            ok = (pl < pr) | ((pl != pr) & ((role[pl] != 2) | (role[pr] != 2)))
            yield t, pl[ok], pr[ok]
            done = stop

    def starts_of(t: pa.Table) -> np.ndarray:
        k, i, j = (t[c].to_numpy() for c in ("key", "ti", "tj"))
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        return np.cumsum(new)

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) < 4096:
            continue
        t = pa.Table.from_batches(held)
        last = int(np.searchsorted(g := starts_of(t), g[-1]))  # the last tile may go on
        if last:
            yield from work(t.slice(0, last).combine_chunks())
            held = t.slice(last).combine_chunks().to_batches()
    if held:
        yield from work(pa.Table.from_batches(held).combine_chunks())


EDGES = 250_000  # that stars() links at a time


def stars(edges: DataFrame) -> DataFrame:
    """Edges (a long, b long; a > b) that link the same nodes: those of each partition, EDGES at a time, as pairs of a
    node and the smallest node it is linked to."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            held.clear()
            nodes, roots = forest(t["a"].to_numpy(), t["b"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= EDGES:
                yield from out()
        if held:
            yield from out()

    return edges.select("a", "b").mapInArrow(link, "a long, b long")


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a long, b long): (node, root), root the smallest node of the component.

    Each round points every node to its smallest neighbour, follows pointers by doubling and contracts the edges to
    edges between roots, so rounds grow with the logarithm of the size. Before each round the edges of a partition
    become stars, which leaves fewer edges and shorter paths. Every state is a written table;
    nothing is collected, and joins on a hub read plain tables, so adaptive execution can split them.
    """
    spark = edges.sparkSession
    e = cut(stars(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), name)
    result = None
    while not e.isEmpty():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("root")), name)
        while True:
            up = m.select(F.col("node").alias("root"), F.col("root").alias("up"))
            n = cut(m.join(up, "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), name)
            discard(m)
            moved = not n.where("moved").isEmpty()
            m = n
            if not moved:
                break
        to = lambda c: m.select(F.col("node").alias(c), F.col("root").alias("r" + c))
        last, e = e, cut(
            stars(e.join(to("a"), "a").join(to("b"), "b").where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct()),
            name,
        )
        discard(last)
        if result is None:
            result = m
        else:
            up = m.select(F.col("node").alias("root"), F.col("root").alias("up"))
            last, result = result, cut(result.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), name)
            discard(last, m)
    discard(e)
    return spark.createDataFrame([], "node long, root long") if result is None else result
