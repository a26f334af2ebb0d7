"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample (SAMPLE vectors); every row is then assigned to its leaf. A query walks the tree
through a priority queue of nodes ordered by cosine to their centres and visits leaves in that order. How many leaves
is calibrated, at every table size: for CALIBRATION queries the exact neighbours are found by blocks over all rows, and
visits widen until the share of them found reaches TARGET. Neighbouring leaves make bundles of bounded size (a larger
leaf is dealt to several), queries are sent once to each bundle that holds a leaf they visit, and a bundle keeps the
running k nearest of a query over all its leaves. Scores are cosines of the original vectors in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, sampled

SAMPLE = 16_384
LEAF_ROWS = 384
BRANCHES = 8
CALIBRATION = 256
TARGET = 0.96
BLOCK = 512
K = 5
QUERIES = 4096  # that share one copy of a bundle
BUNDLE_BYTES = 32 << 20  # of vectors in doubles
BUNDLES, MIN_ROWS = 32, 64  # bundles of small tables, and their least rows


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of each row pair in doubles; a pair's value does not depend on the block it is in."""
    dot = (q * v).sum(axis=1)
    return dot / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))


def block_top(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of each query's k nearest rows of a block, own id excluded, ties to smaller ids."""
    k_ = min(k, len(v))
    rough = unit(q) @ unit(v).T
    rough[qid[:, None] == vid[None, :]] = -np.inf
    kth = np.partition(rough, len(v) - k_, axis=1)[:, len(v) - k_]
    a, b = np.nonzero(rough >= np.maximum(kth - 1e-9, -2.0)[:, None])
    exact = np.concatenate([cosines(q[a[i : i + 65536]], v[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)])
    order = np.lexsort((vid[b], -exact, a))
    a, b, exact = a[order], b[order], exact[order]
    first = np.searchsorted(a, a)
    keep = np.arange(len(a)) - first < k
    return a[keep], b[keep], exact[keep]


@dataclass
class Tree:
    """Nodes in order of creation; children of a leaf are empty. Leaves are numbered by node."""

    centres: np.ndarray
    children: list[list[int]] = field(default_factory=list)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf node of each unit row: at each node the child with the nearest centre."""
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = node
                continue
            best = np.argmax(x[rows] @ self.centres[kids].T, axis=1)
            todo += [(kids[j], rows[best == j]) for j in range(len(kids)) if (best == j).any()]
        return out

    def in_order(self) -> list[int]:
        """Leaves from left to right."""
        out, todo = [], [0]
        while todo:
            node = todo.pop()
            todo += self.children[node][::-1]
            if not self.children[node]:
                out.append(node)
        return out

    def best_bins(self, near: list[float], most: int, rows: dict[int, int], least_rows: int) -> list[int]:
        """Leaves in best-bin-first order, at least `most` of them and as many as hold `least_rows` rows. near: cosine to each node."""
        queue, out, seen = [(0.0, 0)], [], 0
        while queue and (len(out) < most or seen < least_rows):
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for c in self.children[node]:
                    heapq.heappush(queue, (-near[c], c))
            else:
                out.append(node)
                seen += rows.get(node, 0)
        return out


def grow(sample: np.ndarray, total: int, leaf_rows: int = LEAF_ROWS, branches: int = BRANCHES, seed: int = 11) -> Tree:
    """A tree of spherical k-means splits over unit rows, until leaves stand for about leaf_rows of `total` rows."""
    rng = np.random.default_rng(seed)
    centres, children = [np.zeros(sample.shape[1])], [[]]
    todo = [(0, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) * total <= leaf_rows * len(sample) or len(rows) < 4 * branches:
            continue
        x = sample[rows]
        c = x[rng.choice(len(x), branches, replace=False)]
        for _ in range(10):
            own = np.argmax(x @ c.T, axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            c = np.where(np.bincount(own, minlength=branches)[:, None] > 0, unit(sums), c)
        own = np.argmax(x @ c.T, axis=1)
        used = [j for j in range(branches) if (own == j).any()]
        if len(used) < 2:
            continue  # one direction only: its rows are spread over blocks instead
        for j in used:
            children[node].append(len(centres))
            centres.append(c[j])
            children.append([])
            todo.append((len(centres) - 1, rows[own == j]))
    return Tree(np.array(centres), children)


def usable(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(vec_id, v) of vectors that take part: not null, not zero, all components finite."""
    v = F.col(vec)
    ok = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def stack(column: pd.Series) -> np.ndarray:
    """Vectors in doubles, each scaled by a power of two to a largest component under one, which leaves cosines as they are."""
    x = np.stack(column.to_numpy()).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


class Nearest:
    """A running list of each query's k nearest."""

    def __init__(self, k: int, most: int = 500_000):
        self.k, self.most, self.parts, self.held = k, most, [], 0

    def add(self, *columns: np.ndarray) -> None:
        """columns: query id, vector id, score, and others."""
        self.parts.append(columns)
        self.held += len(columns[0])
        if self.held > self.most:
            best = self.best()
            self.parts, self.held = [best], 0

    def best(self) -> tuple[np.ndarray, ...]:
        columns = [np.concatenate(x) for x in zip(*self.parts)]
        order = np.lexsort((columns[1], -columns[2], columns[0]))
        columns = [c[order] for c in columns]
        q = columns[0]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        return tuple(c[keep] for c in columns)


def search_one(base: DataFrame, asked: DataFrame, k: int, target: float, kind: str) -> DataFrame | None:
    """search() among vectors (vec_id, v) of one dimension; asked: written, one row for each id."""
    spark = base.sparkSession
    # Of equal vectors the k + 1 smallest ids decide all answers, so no vector has more rows than these.
    same = Window.partitionBy("v").orderBy("vec_id")
    base = cut(base.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1).drop("_n"), "vectors")
    total, n_calls = base.count(), asked.count()
    if not total or not n_calls:
        return None
    picked = sampled(base, SAMPLE, total, "vec_id", "v").toPandas()
    tree = grow(unit(stack(picked.v)), total)
    sent = spark.sparkContext.broadcast(tree)  # fitted on the sample: at most SAMPLE centres

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(leaf=sent.value.assign(unit(stack(b.v))))

    rows = cut(base.mapInPandas(leaves, f"vec_id long, v {kind}, leaf long").withColumn("spot", F.monotonically_increasing_id()), "leaves")
    count = {r.leaf: r.n for r in rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each leaf of the tree

    # Calibration: exact neighbours of a bounded set of queries, by blocks over all rows.
    few = sampled(asked, CALIBRATION, n_calls, "vec_id").toPandas()
    cq, cid = stack(few.v), few.vec_id.to_numpy()

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Nearest(k)
        for b in batches:
            for i in range(0, len(b), 8 * BLOCK):
                part = b.iloc[i : i + 8 * BLOCK]
                vid = part.vec_id.to_numpy()
                a, c, s = block_top(cid, cq, vid, stack(part.v), k)
                best.add(cid[a], vid[c], s, part.leaf.to_numpy()[c])
        if best.parts:
            yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score", "leaf"), best.best())))

    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    truth = rows.mapInPandas(exact, "query_id long, vec_id long, score double, leaf long").withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).toPandas()
    near = (unit(cq) @ tree.centres.T).tolist()
    place = {int(c): {leaf: i for i, leaf in enumerate(tree.best_bins(near[j], len(tree.children), count, 0))} for j, c in enumerate(cid)}
    needed = np.array([place[q][leaf] + 1 for q, leaf in zip(truth.query_id, truth.leaf)], dtype=np.int64)
    visits = 1
    while visits < len(tree.children) and len(needed) and (needed <= visits).mean() < target:
        visits += 1

    # Leaves that stand together in the tree make a bundle; a leaf larger than a bundle is dealt to several.
    most = max(1, min(BUNDLE_BYTES // (8 * tree.centres.shape[1]), max(MIN_ROWS, -(-total // BUNDLES))))
    spread: dict[int, tuple[int, int]] = {}  # by leaf: first bundle, number of bundles
    bundle, held = 0, 0
    for leaf in tree.in_order():
        n = count.get(leaf, 0)
        if held and held + n > most:
            bundle, held = bundle + 1, 0
        parts = max(1, -(-n // most))
        spread[leaf] = (bundle, parts)
        bundle, held = (bundle + parts, 0) if parts > 1 else (bundle, held + n)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = sent.value
        for b in batches:
            if not len(b):
                continue
            at, bundles, leaves = [], [], []
            for i, c in enumerate((unit(stack(b.v)) @ t.centres.T).tolist()):
                to: dict[int, list[int]] = {}
                for leaf in t.best_bins(c, visits, count, 64 * k):
                    if leaf in count:
                        first, parts = spread[leaf]
                        for j in range(first, first + parts):
                            to.setdefault(j, []).append(leaf)
                at += [i] * len(to)
                bundles += to
                leaves += to.values()
            yield pd.DataFrame({"vec_id": b.vec_id.to_numpy()[at], "v": b.v.to_numpy()[at], "bundle": np.array(bundles, dtype=np.int64), "leaves": leaves})

    tasks = max(min(2 * BUNDLES, n_calls), -(-n_calls // QUERIES))
    calls = cut(asked.repartition(tasks).mapInPandas(visit, f"vec_id long, v {kind}, bundle long, leaves array<long>"), "visits")
    # A bundle is copied once for each QUERIES queries that visit it.
    blocks = {r.bundle: -(-r.n // QUERIES) for r in calls.groupBy("bundle").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each bundle
    asks = spark.createDataFrame(list(blocks.items()), "bundle long, nq long")
    homes = spark.createDataFrame([(leaf, *x) for leaf, x in spread.items()], "leaf long, first long, parts long")
    left = calls.join(F.broadcast(asks), "bundle").select("bundle", F.pmod(F.xxhash64("vec_id"), F.col("nq")).alias("bq"), "vec_id", "v", "leaves")
    right = rows.join(F.broadcast(homes), "leaf").select((F.col("first") + F.pmod("spot", F.col("parts"))).alias("bundle"), "vec_id", "v", "leaf")
    right = right.join(F.broadcast(asks), "bundle").select("bundle", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("bq"), "vec_id", "v", "leaf")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        best = Nearest(k)
        if len(a) and len(b):
            b = b.sort_values("leaf", kind="stable")
            qid, q, vid, v, leaf = a.vec_id.to_numpy(), stack(a.v), b.vec_id.to_numpy(), stack(b.v), b.leaf.to_numpy()
            n = a.leaves.map(len).to_numpy()
            wants = np.concatenate(a.leaves.to_numpy())
            order = np.argsort(wants, kind="stable")
            wants, who = wants[order], np.repeat(np.arange(len(a)), n)[order]
            for x in np.unique(leaf).tolist():
                i, j = np.searchsorted(leaf, (x, x + 1))
                own = who[slice(*np.searchsorted(wants, (x, x + 1)))]
                step = max(1, 4_000_000 // (j - i))
                for s in range(0, len(own), step):
                    part = own[s : s + step]
                    y, z, score = block_top(qid[part], q[part], vid[i:j], v[i:j], k)
                    best.add(qid[part][y], vid[i:j][z], score)
        out = best.best() if best.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), out)))

    key = ["bundle", "bq"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, "query_id long, vec_id long, score double")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(df: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec: str = "embedding", target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, both given as (id, vector).

    Rows with the query's own id are no candidates. Vectors that are null, zero or hold null or non-finite components
    take no part, as queries or candidates, nor do rows with a null id. Vectors of several dimensions are searched each
    among those of its own dimension, one dimension after the other. Rows that repeat an id are separate candidates; a
    repeated query id counts once, by its least vector. Empty tables give no rows. Extra columns are ignored.
    """
    spark = df.sparkSession
    base = usable(df, id_col, vec)
    asked = cut(usable(queries, id_col, vec).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    found = []
    for r in sorted(asked.select(F.size("v").alias("n")).distinct().collect()):  # the dimensions of the queries, one as a rule
        of = lambda x: x.where(F.size("v") == r.n)
        one = search_one(of(base), of(asked), k, target, df.schema[vec].dataType.simpleString())
        if one is not None:
            found.append(one)
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def op2(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0))
