"""Fuzzy line deduplication: one occurrence of each group of equal or nearly equal lines stays.

A line is normalised to its A-Z lower-cased words. Equal normalised lines form a class. Classes are linked if the
SimHashes of their words (each repeat of a word in a line a feature of its own, so that the bars of a menu don't make
all menus alike) differ in DISTANCE bits at most and the edit similarity of the normalised lines is SIMILAR or
more. Fingerprints are cut into five blocks; with three bits off, two blocks agree, so they meet on one of ten pairs
of blocks. A first join compares fingerprints only and finds those that have a partner; lines are fetched for these
alone, from the texts where they stand, verified in tiles of bounded size (pairs already connected in a tile are not
verified again), and connected groups are found over classes. Of a group the occurrence with the smallest (document,
place) stays. Three bits of 64 are few: README has the share of similar lines that this finds, by length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, differing, discard, fresh, in_table, majority_bits, numbered, pairs_of_runs, splitmix, table_of, tile_pairs, tiles

DISTANCE = 3
SIMILAR = 0.8
KEYS = 1_000_000  # of fingerprints for each bucket
LONGEST = 2048  # fingerprints of one key that a bucket compares by itself
_WIDTHS = (13, 13, 13, 13, 12)
_SHIFTS = (0, 13, 26, 39, 52)
_PAIRS = [(i, j) for i in range(5) for j in range(i + 1, 5)]
#: By the set of equal blocks: the first pair of blocks that agrees, or -1.
_FIRST = np.array([next((t for t, (i, j) in enumerate(_PAIRS) if s >> i & 1 and s >> j & 1), -1) for s in range(32)])


def normalised(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def block(fp: np.ndarray, i: int) -> np.ndarray:
    return (fp.view(np.uint64) >> np.uint64(_SHIFTS[i])) & np.uint64((1 << _WIDTHS[i]) - 1)


def pair_keys(fp: np.ndarray) -> np.ndarray:
    """The ten keys of each fingerprint: (fingerprint, pair of blocks)."""
    b = [block(fp, i) for i in range(5)]
    return np.stack([(np.uint64(t) << np.uint64(52)) | (b[i] << np.uint64(13)) | b[j] for t, (i, j) in enumerate(_PAIRS)], axis=1).astype(np.int64)


def meets(key: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs of fingerprints within DISTANCE whose first agreeing pair of blocks is the key's, so that each pair counts once."""
    near = differing(x, y) <= DISTANCE
    same = np.zeros(len(x), dtype=np.int64)
    for i in range(5):
        same |= (block(x ^ y, i) == 0).astype(np.int64) << i
    return near & (_FIRST[same] == key >> 52)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit-parallel columns."""
    n = 0
    most = min(len(a), len(b))
    while n < most and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    n = 0
    most = min(len(a), len(b))
    while n < most and a[-1 - n] == b[-1 - n]:
        n += 1
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    mask, high = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = mask, 0, len(a)
    for c in b:
        eq = places.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(horizontal | plus) & mask)
        down = plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up = ((up << 1) | 1) & mask
        down = (down << 1) & mask
        plus = down | (~(vertical | up) & mask)
        minus = up & vertical
    return score


def similar(a: bytes, b: bytes) -> bool:
    x, y = a.decode("utf-8", "replace"), b.decode("utf-8", "replace")
    longest = max(len(x), len(y))
    allowed = longest - SIMILAR * longest + 1e-9
    return abs(len(x) - len(y)) <= allowed and edit_distance(x, y) <= allowed


#: The hash of a word is that of its bytes' values as the digits of a number in this base, modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_VALUE = splitmix(np.arange(256, dtype=np.uint64))
_GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_CHUNK = 1 << 20


def _powers(base: int) -> np.ndarray:
    out = np.full(_CHUNK + 1, base, dtype=np.uint64)
    out[0] = 1
    return out.cumprod(dtype=np.uint64)


_UP, _DOWN = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word data[begin:end], by sums over chunks of words; a word longer than a chunk has its own sum."""
    out = np.empty(len(begin), dtype=np.uint64)
    i = 0
    while i < len(begin):
        at = begin[i]
        j = max(i + 1, int(np.searchsorted(end, at + _CHUNK, side="right")))
        if end[j - 1] - at > _CHUNK:
            h = 0
            for b in data[at : end[i]].tobytes()[::-1]:
                h = (h * BASE + int(_VALUE[b])) & (2**64 - 1)
            out[i] = h
        else:
            part = data[at : end[j - 1]]
            total = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_VALUE[part] * _UP[: len(part)], out=total[1:])
            out[i:j] = (total[end[i:j] - at] - total[begin[i:j] - at]) * _DOWN[begin[i:j] - at]
        i = j
    return splitmix(out ^ (end - begin).astype(np.uint64))


def edges(texts: pa.Array) -> np.ndarray:
    """Where each text of a binary column begins in its data, and the end."""
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def bytes_of(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The texts of a binary column one after the other, and where each begins, with the end; nulls are empty."""
    at, data = edges(texts), texts.buffers()[2]
    return (data.slice(at[0], at[-1] - at[0]).to_pybytes() if data is not None else b""), at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to about `most` bytes of a binary column; a longer text is alone."""
    for b in batches:
        at = edges(b.column(column))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
            yield b.slice(i, j - i)
            i = j


def lines_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, digest of 128 bits, fingerprint) of every line with words."""
    raw, at = bytes_of(texts)
    data = np.frombuffer(raw.lower(), dtype=np.uint8)
    gap = _GAP[data]
    edge = np.ones(len(data) + 1, dtype=bool)  # before this byte a word may begin, or one ends
    edge[1:-1] = gap[:-1]
    edge[at] = True
    letter = ~gap
    begin = np.flatnonzero(letter & edge[:-1])
    edge[:-1] |= gap
    end = np.flatnonzero(letter & edge[1:]) + 1
    if not len(begin):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.reshape(0, 2), none
    newline = np.flatnonzero(data == 10)
    text = np.searchsorted(at[1:], begin, side="right")
    place = np.searchsorted(newline, begin) - np.searchsorted(newline, at[text])
    new = np.ones(len(begin), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin)) - 1
    # Words with one space after each.
    size = end - begin
    stop = np.cumsum(size + 1)
    neat = np.full(int(stop[-1]), 32, dtype=np.uint8)
    neat[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[letter]
    view = memoryview(neat)
    digest = b"".join([xxhash.xxh128_digest(view[a:b]) for a, b in zip((stop[first] - size[first] - 1).tolist(), (stop[last] - 1).tolist())])
    lengths = last - first + 1
    fp = majority_bits(numbered(word_hashes(data, begin, end), lengths), lengths).view(np.int64)
    return text[first], place[first], np.frombuffer(digest, dtype="<i8").reshape(-1, 2), fp


def occurrences(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, t, pos, h1, h2, fp) of every line with words: t the text's hash, h1 and h2 the normalised line's, fp its SimHash."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            row, pos, two, fp = lines_of(b.column(2))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(pos.astype(np.int32)), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), pa.array(fp)], ["id", "t", "pos", "h1", "h2", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), F.col(text).cast("binary")).mapInArrow(of, f"id {kind}, t long, pos int, h1 long, h2 long, fp long")


def spots(k: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Hashes of places in the table of wanted lines."""
    return splitmix(k.view(np.uint64) ^ splitmix(pos.astype(np.uint64)))


def fetched(docs: DataFrame, wanted: DataFrame, id_col: str, text: str) -> DataFrame:
    """(cid, line): the normalised lines at wanted (cid, k: hash of id and text hash, pos).

    The wanted places make a table of bits of a fixed size, so texts are read where they are and only lines that it may
    contain are dealt out; the join drops those that are not wanted.
    """

    sent = docs.sparkSession.sparkContext.broadcast(table_of(wanted.select("k", "pos"), lambda b: spots(b.column(0).to_numpy(), b.column(1).to_numpy())))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            k = b.column(0).to_numpy()
            raw, at = bytes_of(b.column(1))
            newline = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10)
            lines = np.searchsorted(newline, at[1:]) - np.searchsorted(newline, at[:-1]) + 1
            row = np.repeat(np.arange(len(k)), lines)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(lines) - lines, lines)
            hit = np.flatnonzero(in_table(sent.value, spots(k[row], pos)))
            breaks = np.append(newline, len(raw))
            nth = np.searchsorted(newline, at[:-1])[row[hit]] + pos[hit]  # the newline that ends the line, if its text does not
            begin = np.where(pos[hit] == 0, at[row[hit]], breaks[nth - 1] + 1)
            end = np.minimum(breaks[nth], at[row[hit] + 1])
            yield pa.RecordBatch.from_arrays([pa.array(k[row[hit]]), pa.array(pos[hit].astype(np.int32)), pa.array([normalised(raw[x:y]) for x, y in zip(begin.tolist(), end.tolist())], pa.binary())], ["k", "pos", "line"])

    lines = docs.select(F.xxhash64(F.col(id_col), F.xxhash64(text)).alias("k"), F.col(text).cast("binary")).mapInArrow(fetch, "k long, pos int, line binary")
    return lines.join(wanted.select("cid", "k", "pos"), ["k", "pos"]).select("cid", "line").dropDuplicates(["cid"])


def with_partner(prints: DataFrame, count: int) -> DataFrame:
    """(key, fp) of distinct fingerprints that have another within DISTANCE at the key.

    Fingerprints go to buckets of keys in packed arrays. Keys with more fingerprints than a bucket should compare are
    handed on and compared in tiles.
    """
    buckets = max(1, -(-10 * count // KEYS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            fp = np.concatenate(held)
            held.clear()
            for t, key in enumerate(pair_keys(fp).T):
                to = (splitmix(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                at = np.flatnonzero(np.diff(to[order], prepend=-1))
                parts = np.split(fp[order], at[1:])
                yield pa.RecordBatch.from_arrays([pa.array(to[order][at], pa.int32()), pa.array([t] * len(at), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["bucket", "t", "fps"])

        for b in batches:
            held.append(b.column(0).to_numpy())
            if sum(map(len, held)) > 500_000:
                yield from out()
        if held and sum(map(len, held)):
            yield from out()

    def meet(x: pa.Table) -> pa.Table:
        kinds = x["t"].to_numpy()
        keys, fps, hot = [], [], []
        for t in np.unique(kinds).tolist():
            fp = np.frombuffer(b"".join(x["fps"][int(i)].as_py() for i in np.flatnonzero(kinds == t)), np.int64)
            key = pair_keys(fp)[:, t]
            order = np.argsort(key, kind="stable")
            key, fp = key[order], fp[order]
            found = np.zeros(len(fp), dtype=bool)
            for left, right in pairs_of_runs(key, LONGEST):
                ok = meets(key[left], fp[left], fp[right])
                found[left[ok]] = found[right[ok]] = True
            new = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            size = np.diff(np.append(new, len(key)))
            many = np.repeat(size > LONGEST, size)
            keep = found | many
            keys.append(key[keep])
            fps.append(fp[keep])
            hot.append(many[keep])
        return pa.table({"key": np.concatenate(keys), "fp": np.concatenate(fps), "hot": np.concatenate(hot)})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, left, right in tile_pairs(batches):
            fp, key = t["fp"].to_numpy(), t["key"].to_numpy()
            ok = (fp[left] != fp[right]) & meets(key[left], fp[left], fp[right])
            rows = np.unique(np.concatenate((left[ok], right[ok])))
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(fp[rows])], ["key", "fp"])

    dealt = prints.select("fp").mapInArrow(deal, "bucket int, t int, fps binary")
    met = cut(dealt.groupBy("bucket").applyInArrow(meet, "key long, fp long, hot boolean"), "met")
    large = tiles(met.where("hot").select("key", F.lit(2).alias("role"), "fp"), "blocks").mapInArrow(compare, "key long, fp long")
    return met.where("not hot").select("key", "fp").unionAll(large)


def verified(rows: DataFrame) -> DataFrame:
    """(a, b) class ids linked by fingerprint and edit similarity; rows: (key, role, fp, cid, line)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, left, right in tile_pairs(batches):
            fp, key, cid = (t[c].to_numpy() for c in ("fp", "key", "cid"))
            ok = (cid[left] != cid[right]) & meets(key[left], fp[left], fp[right])
            lines = t["line"]
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while (p := parent.setdefault(x, x)) != x:
                    parent[x] = x = parent[p]
                return x

            a, b = [], []
            for i, j in zip(left[ok].tolist(), right[ok].tolist()):
                x, y = root(int(cid[i])), root(int(cid[j]))
                if x != y and similar(lines[i].as_py(), lines[j].as_py()):
                    parent[max(x, y)] = min(x, y)
                    a.append(int(cid[i]))
                    b.append(int(cid[j]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return tiles(rows, "lines").mapInArrow(compare, "a long, b long")


def surplus_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, t, gone): places of the lines to be removed from the documents with this id and this text hash."""
    occ = cut(occurrences(docs, id_col, text), "occurrences")
    spot = F.struct("id", "t", "pos")
    classes = cut(occ.groupBy("h1", "h2").agg(F.min(spot).alias("first"), F.count(F.lit(1)).alias("n"), F.min("fp").alias("fp")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    prints = cut(classes.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "line-prints")

    shared = prints.where("n > 1").select(F.shiftright("fp", 0).alias("fp"))  # different lines of one fingerprint
    low = lambda i: F.expr(f"shiftrightunsigned(fp, {_SHIFTS[i]})").bitwiseAND((1 << _WIDTHS[i]) - 1)
    first_key = F.call_function("shiftleft", low(0), F.lit(13)).bitwiseOR(low(1))
    partners = cut(with_partner(prints, prints.count()).union(shared.select(first_key.alias("key"), "fp")).distinct(), "partners")
    wanted = cut(partners.join(classes.select("fp", "cid", F.xxhash64("first.id", "first.t").alias("k"), F.col("first.pos").alias("pos")), "fp"), "wanted")
    lines = fetched(docs, wanted.select("cid", "k", "pos").distinct(), id_col, text)
    rows = cut(wanted.select("key", "fp", "cid").join(lines, "cid").select("key", F.lit(2).alias("role"), "fp", "cid", "line"), "verify")
    groups = components(verified(rows), "line-groups").withColumnRenamed("node", "cid")

    linked = cut(classes.join(groups, "cid").select("h1", "h2", "first", "root"), "linked")
    keepers = cut(linked.groupBy("root").agg(F.min("first").alias("keep")), "keepers")
    single = classes.where("n > 1").join(groups.select("cid"), "cid", "left_anti").select("h1", "h2", F.col("first").alias("keep"))
    repeated = cut(linked.join(keepers, "root").select("h1", "h2", "keep").union(single), "repeated")
    gone = occ.join(repeated, ["h1", "h2"]).where(~spot.eqNullSafe(F.col("keep")))
    out = cut(gone.groupBy("id", "t").agg(F.collect_set("pos").alias("gone")), "gone-lines")
    discard(occ, classes, prints, partners, wanted, rows, linked, keepers, repeated)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with surplus lines taken out of `text`, and n_lines and n_removed.

    Lines end at newlines; lines without words always stay. Null texts stay null and have no lines. Rows that repeat
    an id and its text are one document: they keep the same lines. A null id comes before all others. An empty table
    gives no rows. Columns of docs named n_lines or n_removed are replaced; all others pass through, whatever their names.
    """
    base = docs.drop("n_lines", "n_removed")
    of, t, gone = fresh(base, "of", "t", "gone")
    found = surplus_lines(docs, id_col, text).withColumnsRenamed({"id": of, "t": t, "gone": gone})
    lines = F.split(text, "\n")
    # What goes grows with the documents, so it is dealt out at every size and never broadcast.
    out = base.join(found.hint("merge"), F.col(id_col).eqNullSafe(F.col(of)) & (F.xxhash64(text) == F.col(t)), "left")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n")
    return (
        out.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)))
        .withColumn("n_removed", F.coalesce(F.size(gone), F.lit(0)))
        .withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept))
        .select(*base.columns, "n_lines", "n_removed")
    )


def op7(spark: SparkSession, sf: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
