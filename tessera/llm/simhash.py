"""SimHash near-duplicates by anchor points of a covering code.

Two 64-bit fingerprints at most three bits apart have a 32-bit half that differs in one bit at most. Anchors are the
codewords of the perfect Hamming [31,26] code over each half's low 31 bits (covering radius 1; the half's last bit is
free). A fingerprint's home is the one codeword within the covering radius; it is replicated to every codeword within
covering radius plus threshold (1 + 1 = 2), at most 16 in each half. So of two linked fingerprints one's replica meets
the other at its home in some half. Distinct fingerprints are compared per anchor in tiles of bounded size, a tile's
links leave as a spanning forest, and components are found over fingerprints; copies never make pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, components, cut, differing, discard, forest, fresh, hex64, in_table, majority_bits, splitmix, table_of, tile_pairs, tiles

DISTANCE = 3


def shingle_hashes(text: bytes, n: int) -> list[int]:
    """XXH64 (seed 42) of each n-word shingle of A-Z lower-cased text, repeats included."""
    words = text.lower().split()  # splits at \x20 and \x09-\x0D only, as bytes do
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - n + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist())]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 3) -> DataFrame:
    """(id, fp long) for every row; null texts count as empty, and texts without words have fingerprint 0."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, held, lengths = [], [], []
            have = 0

            def flush() -> None:
                nonlocal have
                h = np.concatenate(held) if held else np.zeros(0, np.uint64)
                prints.append(majority_bits(h, np.array(lengths, dtype=np.int64)))
                held.clear()
                lengths.clear()
                have = 0

            for t in b.column(1):
                h = np.array(shingle_hashes(t.as_py() or b"", n), dtype=np.uint64)
                held.append(h)
                lengths.append(len(h))
                have += len(h)
                if have > 400_000:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(prints).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text).cast("binary")).mapInArrow(of, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def _syndromes() -> np.ndarray:
    """By byte place and value: xor of the places (1 to 31) of the bits set."""
    t = np.zeros((4, 256), dtype=np.uint32)
    for k in range(4):
        for v in range(256):
            s = 0
            for j in range(8):
                place = 8 * k + j + 1
                if v >> j & 1 and place <= 31:
                    s ^= place
            t[k, v] = s
    return t


_SYNDROME = _syndromes()
#: By syndrome: the flips that lead to codewords, the single bit first, then the 15 pairs of bits.
_FLIPS = np.array(
    [[0] * 16] + [[1 << (s - 1)] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s] for s in range(1, 32)],
    dtype=np.uint32,
)


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, role) of each replica of uint64 fingerprints; role 2: at home, which compares with all, 1: only compared with."""
    rows, keys, roles = [], [], []
    for half in (0, 1):
        w = ((fp >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)).astype(np.uint32)
        s = np.zeros(len(w), dtype=np.uint32)
        for k in range(4):
            s ^= _SYNDROME[k, (w >> np.uint32(8 * k)) & np.uint32(255)]
        words = (w[:, None] ^ _FLIPS[s]).astype(np.int64) | (np.int64(half) << np.int64(31))
        use = np.ones(words.shape, dtype=bool)
        use[s == 0, 1:] = False  # a codeword has no other within two bits
        r, c = np.nonzero(use)
        rows.append(r)
        keys.append(words[r, c])
        roles.append(np.where(c == 0, 2, 1).astype(np.int32))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(roles)


def links(prints: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the links of each tile, over distinct fingerprints (fp long)."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            row, key, role = anchors(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(role), pa.array(fp[row])], ["key", "role", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, left, right in tile_pairs(batches):
            fp = t["fp"].to_numpy()
            a, b = fp[left], fp[right]
            near = differing(a, b) <= DISTANCE
            near &= a != b
            x, y = forest(a[near], b[near])
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    rows = prints.select("fp").mapInArrow(replicate, "key long, role int, fp long")
    return tiles(rows, "anchors").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 3) -> DataFrame:
    """(id, fingerprint hex, component_id: smallest id reachable over links of at most DISTANCE bits) for every row.

    Ids name documents: rows that repeat an id share its component. Null ids are never the smallest, so a component
    of null ids only has a null id. Texts without words (null, empty) have fingerprint 0 and are linked like any other.
    An empty table gives no rows; extra columns are ignored.
    """
    own = cut(fingerprints(docs, id_col, text, n), "simhash")
    prints = cut(own.groupBy("fp").agg(F.min(id_col).alias("least")), "prints")
    roots = components(links(prints), "near")
    members = cut(prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "members")
    least = cut(members.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of_print = cut(members.join(least, "root").select("fp", "component_id"), "of-print")
    return own.join(of_print, "fp").select(id_col, hex64(F.col("fp")).alias("fingerprint"), "component_id")


#: Similar documents: their Jaccard similarity over sets of shingles, as a fraction.
SIMILAR = (4, 5)
#: Words of the wide fingerprint and the bits of its 256 that may differ before the sets are compared. It only spares
#: comparisons: pairs at 0.8 differ in 39 bits on average in long texts (standard deviation 6), in 48 for 4 shingles inside
#: 5, so texts of FEW shingles have a wider bound.
WIDE = 4
WIDE_DISTANCE = 72
FEW, FEW_DISTANCE = 16, 90
#: Shingles up to which a text's keys are a prefix of its shingles, which no pair at SIMILAR escapes; shingles and parts of a partial print.
PREFIX = 240
PART_SHINGLES = 4
PARTS = 24
_WIDE_BITS = ", ".join(f"f{i} long" for i in range(WIDE))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two arrays of distinct shingles is SIMILAR or more; empty ones are alike."""
    top, base = SIMILAR
    both = len(np.intersect1d(a, b, assume_unique=True))
    return base * both >= top * (len(a) + len(b) - both)


def candidate_keys(h: np.ndarray) -> np.ndarray:
    """Keys of a document's distinct shingle hashes, sorted; documents at SIMILAR share one.

    Of n shingles in a common order, the first n - ceil(0.8 n) + 1 hold one in common with any similar set. Longer
    texts have partial prints instead, which are equal where no shingle of a part differs: the shingles are dealt to
    2**k parts by their hash, for the two k around PART_SHINGLES in a part, so documents of nearly equal sizes have a k
    in common; of each k the first PARTS parts are kept. Sizes at which a similar text may be on either side have both.
    """
    top, base = SIMILAR
    out = []
    if 0 < len(h) <= PREFIX:
        out.append(splitmix(h[: len(h) - -(-top * len(h) // base) + 1] ^ np.uint64(0x5E7)))
    if base * len(h) >= top * PREFIX:
        low = max(0, int(np.floor(np.log2(max(len(h) / PART_SHINGLES, 1)))))
        for k in (low, low + 1):
            part = splitmix(h) & np.uint64((1 << k) - 1)
            mine, p = h[part < PARTS], part[part < PARTS].astype(np.int64)
            order = np.argsort(p, kind="stable")
            at = np.flatnonzero(np.diff(p[order], prepend=-1))
            if len(at):
                sums = np.add.reduceat(splitmix(mine[order] ^ np.uint64(k)), at)
                out.append(splitmix(sums + p[order][at].astype(np.uint64)))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, dtype=np.int64)


def wide_prints(docs: DataFrame, id_col: str, text: str, n: int, only: np.ndarray | None = None) -> DataFrame:
    """(id, s1 and s2: a digest of the set of shingles, n: its size, f0 to f3, keys) for every row.

    The four SimHashes count each distinct shingle once. With `only`, a table of id hashes, the shingles themselves stand
    in place of the keys, for the rows whose id the table may contain.
    """
    sets = only is not None
    sent = docs.sparkSession.sparkContext.broadcast(only)  # 2**TABLE_BITS bits

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if sets:
                whole = whole.filter(pa.array(in_table(sent.value, splitmix(whole.column(2).to_numpy().view(np.uint64)))))
            for start in range(0, whole.num_rows, 200):
                b = whole.slice(start, 200)
                held = [np.unique(np.array(shingle_hashes(t.as_py() or b"", n), dtype=np.uint64)) for t in b.column(1)]
                h, lengths = np.concatenate(held), np.array([len(x) for x in held], dtype=np.int64)
                digest = np.frombuffer(b"".join(xxhash.xxh128_digest(x.tobytes()) for x in held), dtype="<i8").reshape(-1, 2)
                prints = [majority_bits(h if not i else splitmix(h + np.uint64(i)), lengths).view(np.int64) for i in range(WIDE)]
                last = pa.array([x.tobytes() for x in held], pa.binary()) if sets else pa.array([candidate_keys(x) for x in held], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(lengths), *map(pa.array, prints), last], ["id", "s1", "s2", "n", *(f"f{i}" for i in range(WIDE)), "shingles" if sets else "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text).cast("binary"), *([F.xxhash64(id_col)] if sets else [])).mapInArrow(of, f"id {kind}, s1 long, s2 long, n long, {_WIDE_BITS}, {'shingles binary' if sets else 'keys array<long>'}")


def near_pairs(t: pa.Table, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a tile that sizes and wide prints do not rule out."""
    node, n = t["node"].to_numpy(), t["n"].to_numpy()
    top, base = SIMILAR
    ok = (base * np.minimum(n[left], n[right]) >= top * np.maximum(n[left], n[right])) & (node[left] != node[right])
    left, right = left[ok], right[ok]
    bits = np.zeros(len(left), dtype=np.int64)
    for i in range(WIDE):
        f = t[f"f{i}"].to_numpy()
        bits += differing(f[left], f[right])
    ok = bits <= np.where(n[left] <= FEW, FEW_DISTANCE, WIDE_DISTANCE)
    return left[ok], right[ok]


def candidate_links(prints: DataFrame) -> DataFrame:
    """(a, b): a spanning forest, by tile, of the pairs of prints that share a key and may be similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, left, right in tile_pairs(batches):
            node = t["node"].to_numpy()
            left, right = near_pairs(t, left, right)
            x, y = forest(node[left], node[right])
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    columns = ["n", *(f"f{i}" for i in range(WIDE))]
    rows = prints.select(F.explode(F.array_distinct("keys")).alias("key"), F.lit(2).alias("role"), "node", *columns)
    shared = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "shared-keys")
    return tiles(cut(rows.join(shared, "key"), "keys"), "keys").mapInArrow(compare, "a long, b long")


def similar_links(rows: DataFrame) -> DataFrame:
    """(a, b): links of similarity SIMILAR or more that connect, by tile, what such links connect in a group of candidates.

    rows: (key: the group, role, node, n, f0 to f3, shingles). Pairs already connected in a tile are not compared again.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, left, right in tile_pairs(batches):
            node, sets = t["node"].to_numpy(), t["shingles"]
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while (p := parent.setdefault(x, x)) != x:
                    parent[x] = x = parent[p]
                return x

            read = Memo(lambda i: np.frombuffer(sets[i].as_buffer(), dtype="<u8"))
            a, b = [], []
            for i, j in zip(*map(np.ndarray.tolist, near_pairs(t, left, right))):
                x, y = root(int(node[i])), root(int(node[j]))
                if x != y and alike(read[i], read[j]):
                    parent[max(x, y)] = min(x, y)
                    a.append(int(node[i]))
                    b.append(int(node[j]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return tiles(rows, "sets").mapInArrow(compare, "a long, b long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5) -> DataFrame:
    """docs without those that are not the smallest id of their group of near-duplicates.

    Groups are connected by links between documents whose sets of n-word shingles have a Jaccard similarity of 0.8 or
    more. Candidates are found by 64-bit fingerprints at most DISTANCE bits apart, at anchor points, and by shared
    keys; those that hang together form a group of candidates, in which the sets themselves are compared. Rows with
    null ids stay; rows that repeat an id are one document and stay or go together. Texts without words are copies of
    each other. An empty table gives no rows. Ids may be of any type that has an order; all columns pass through.
    """
    docs_ = docs.where(F.col(id_col).isNotNull())
    columns = ["s1", "s2"]
    bits = [f"f{i}" for i in range(WIDE)]
    own = cut(wide_prints(docs_, id_col, text, n), "wide")
    prints = cut(own.groupBy(*columns).agg(F.min("id").alias("least"), *(F.first(c).alias(c) for c in ("n", *bits, "keys"))).withColumn("node", F.monotonically_increasing_id()), "wide-prints")
    narrow = cut(prints.groupBy(F.col("f0").alias("fp")).agg(F.min("node").alias("node")), "narrow")
    of = lambda c: narrow.select(F.col("fp").alias(c), F.col("node").alias(f"n{c}"))
    anchored = links(narrow).join(of("a"), "a").join(of("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    equal = prints.join(narrow.select(F.col("fp").alias("f0"), F.col("node").alias("b")), "f0").where("node <> b").select(F.col("node").alias("a"), "b")
    candidates = components(candidate_links(prints).unionAll(anchored).unionAll(equal), "candidates")
    groups = cut(prints.select(*columns, "least", "node").join(candidates, "node"), "groups")
    # The sets of these documents alone, made again from their texts where they stand.
    sets = wide_prints(docs_, id_col, text, n, table_of(groups.select(F.xxhash64("least")))).withColumnRenamed("id", "least").dropDuplicates(["least", *columns])
    rows = cut(sets.join(groups, ["least", *columns]).select(F.col("root").alias("key"), F.lit(2).alias("role"), "node", "n", *bits, "shingles"), "sets")
    roots = components(similar_links(rows), "near")
    of_print = cut(prints.select(*columns, "least", "node").join(roots, "node", "left").select(*columns, "least", F.coalesce("root", "node").alias("root")), "of-print")
    keep = of_print.join(of_print.groupBy("root").agg(F.min("least").alias("keep")), "root").select(*columns, "keep")
    (gone_id,) = fresh(docs, "gone")
    gone = cut(own.select("id", *columns).join(keep, columns).where(F.col("keep") < F.col("id")).select(F.col("id").alias(gone_id)).distinct(), "gone")
    discard(own, prints, narrow, candidates, groups, rows, roots, of_print)
    # What goes grows with the documents, so it is dealt out at every size and never broadcast.
    return docs.join(gone.hint("merge"), F.col(id_col) == F.col(gone_id), "left_anti")


def op6(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))
