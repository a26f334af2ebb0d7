"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Texts are lower-cased words. A mask keeps 6 of 10 neighbouring words; the kept words' hash is a seed. Seeds of
documents that a bit table of the benchmark's seeds may contain are joined to the benchmark's seeds, and around each
hit the aligned words are compared: a document holds an item if some window of WINDOW aligned words around a hit (the
whole item if it is shorter) has at least 80 % equal words. All masks keep their first and last word, so one look-up in
a table of such word pairs rules most places out before any seed is made. Tables grow with the benchmark up to a bound;
what passes them without being a seed is dropped by the join. Up to BROADCAST_SEEDS seeds go to every executor, so hits
stay where they are; more are dealt out with a salt, so a seed that a third of all documents hold is spread over tasks.

These masks leave a seed whole for every pattern of changed words in a window of WINDOW words, but not in shorter
items. Those have masks of their own over the whole item: it is cut into two blocks more than it may have changed
words, and each pair of blocks is a mask.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh

SPAN = 10
MASKS = [(0, 1, 2, 5, 7, 9), (0, 2, 3, 4, 8, 9), (0, 1, 4, 6, 8, 9), (0, 3, 5, 6, 7, 9)]
WINDOW = 13
SIMILAR = 0.8
TABLE_BITS = (16, 23)  # of each bit table, by the number of its hashes: 8 KB to 1 MB
BROADCAST_SEEDS = 50_000  # of 300 bytes at most: 15 MB; more are dealt out, each SALTS times
SALTS = 16


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks over an item of n < WINDOW words; one at least stays whole if 80 % of the words are equal."""
    wrong = n // 5
    if not wrong:
        return [tuple(range(n))]
    edges = [n * b // (wrong + 2) for b in range(wrong + 3)]
    blocks = [tuple(range(a, b)) for a, b in zip(edges, edges[1:])]
    return [x + y for x, y in combinations(blocks, 2)]


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words of a text, in order; none for null texts."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def at(h: Column, i) -> Column:
    return F.get(h, i)


def seed(h: Column, i, mask: tuple[int, ...], number: int) -> Column:
    return F.xxhash64(F.lit(number), *(at(h, i + o) for o in mask))


def ends(h: Column, i) -> Column:
    return F.xxhash64(at(h, i), at(h, i + SPAN - 1))


def bit_table(hashes: DataFrame, n: int) -> tuple[Column, int]:
    """A constant array of longs with a bit set for each of the n hashes of the column h, and the bits of a place in it."""
    low, high = TABLE_BITS
    bits = min(high, max(low, (32 * n).bit_length()))
    s = F.col("h").bitwiseAND((1 << bits) - 1)
    words = hashes.groupBy(F.shiftright(s, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), s.bitwiseAND(63).cast("int"))).alias("b")).collect()  # 2**(bits - 6) rows at most
    table = [0] * (1 << (bits - 6))
    for r in words:
        table[r.w] = r.b
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>"), bits


def maybe(table: tuple[Column, int], hash_: Column) -> Column:
    longs, bits = table
    s = hash_.bitwiseAND((1 << bits) - 1)
    return F.getbit(F.get(longs, F.shiftright(s, 6).cast("int")), s.bitwiseAND(63).cast("int")) == 1


def met(hits: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """hits with the seeds of their hash h; n: the number of seeds."""
    if n <= BROADCAST_SEEDS:
        return hits.join(F.broadcast(seeds), "h")
    salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return hits.withColumn("salt", F.pmod(F.xxhash64("id", "p"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"])


def places(n: Column, span: int = SPAN) -> Column:
    """The starts of all spans in n words."""
    return F.when(n >= span, F.sequence(F.lit(0), n - span)).otherwise(F.array().cast("array<int>"))


def around(h: Column, i: Column) -> Column:
    """The words that windows around a span at i can cover; null where there is none."""
    return F.transform(F.sequence(F.lit(SPAN - WINDOW), F.lit(WINDOW - 1)), lambda j: F.when(i + j >= 0, at(h, F.greatest(i + j, F.lit(0)))))


def find_short(docs: DataFrame, bench: DataFrame, id_col: str, text: str) -> DataFrame | None:
    """(id, item) of the benchmark's items of fewer than WINDOW words that documents hold; None if it has no such items."""
    bench = bench.where(F.col("n") < WINDOW)
    lengths = sorted(r.n for r in bench.select("n").distinct().collect())  # fewer than WINDOW rows
    if not lengths:
        return None
    ways = [(n, m, 100 * n + k) for n in lengths for k, m in enumerate(short_masks(n))]
    own = F.filter(F.array(*(F.when(F.col("n") == n, seed(F.col("g"), F.lit(0), m, number)) for n, m, number in ways)), lambda h: h.isNotNull())
    seeds = cut(bench.select("item", "n", F.col("g").alias("theirs"), F.explode(own).alias("h")), "short-seeds")
    n_seeds = seeds.count()
    table = bit_table(seeds.select("h"), n_seeds)
    d = F.col("d")
    once = F.monotonically_increasing_id
    found = lambda n, m, number: F.transform(F.filter(places(F.size(d), n), lambda i: maybe(table, seed(d, i, m, number))), lambda i: F.struct(i.alias("p"), seed(d, i, m, number).alias("h"), F.slice(d, i + 1, n).alias("ours")))
    hits = (
        docs.select(F.col(id_col).alias("id"), word_hashes(F.col(text)).alias("d"), once().alias("m1"))
        .select("id", "m1", F.explode(F.array_distinct(F.concat(*(found(*w) for w in ways)))).alias("x"))
        .select("id", "m1", "x.p", "x.h", "x.ours")
        .where("m1 >= 0")
    )
    equal = F.aggregate(F.zip_with("ours", "theirs", lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda c, x: c + x)
    holds = (F.size("ours") == F.col("n")) & (equal >= F.ceil(F.col("n") * SIMILAR))
    return met(hits, seeds, n_seeds).where(holds).select("id", "item")


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, items): for each id whose text holds benchmark items, their sorted ids.

    Items without words take no part, as do items with null texts; of items under five words all words must be equal. Repeated items with one id count once;
    rows that repeat a document id are joined in one answer; null ids are an id of their own. Empty tables give no rows.
    """
    bench = cut(items.select(F.col(item_col).alias("item"), word_hashes(F.col(text)).alias("g")).withColumn("n", F.size("g")).where(F.col("n") > 0).distinct(), "bench")
    short = find_short(docs, bench, id_col, text)
    g = F.col("g")
    spans = bench.where(F.col("n") >= WINDOW).select("item", "n", "g", F.explode(places(F.col("n"))).alias("i"))
    ways = lambda h, i: [F.struct(F.lit(k).alias("k"), seed(h, i, m, k).alias("h")) for k, m in enumerate(MASKS)]
    i = F.col("i")
    seeds = cut(spans.select("item", "n", "i", ends(g, i).alias("e"), around(g, i).alias("theirs"), F.explode(F.array(*ways(g, i))).alias("s")).select("item", "n", "i", "e", "theirs", "s.h"), "seeds")
    n_seeds = seeds.count()
    pairs, full = bit_table(seeds.select(F.col("e").alias("h")), n_seeds), bit_table(seeds.select("h"), n_seeds)
    d = F.col("d")
    # The ids made on the way keep the optimizer from moving later filters below the arrays, which would make them
    # again for each place that is looked up.
    once = F.monotonically_increasing_id
    hits = (
        docs.select(F.col(id_col).alias("id"), word_hashes(F.col(text)).alias("d"), once().alias("m1"))
        .select("id", "d", "m1", F.filter(places(F.size(d)), lambda i: maybe(pairs, ends(d, i))).alias("at"), once().alias("m2"))
        .select("id", "d", "m1", "m2", F.explode("at").alias("p"))
        .select("id", "d", "p", "m1", "m2", F.explode(F.filter(F.array(*(seed(d, F.col("p"), m, k) for k, m in enumerate(MASKS))), lambda h: maybe(full, h))).alias("h"))
        .select("id", "p", "h", around(d, F.col("p")).alias("ours"), "m1", "m2")
        .where("m1 >= 0 and m2 >= 0")
    )
    # A window of L words around the span, whole in the item and the document: it starts s words before or at the hit.
    length = F.least(F.col("n"), F.lit(WINDOW))
    base = WINDOW - SPAN  # place of the hit in ours and theirs
    equal = lambda s: F.aggregate(F.sequence(F.lit(0), length - 1), F.lit(0), lambda c, j: c + F.when(F.get("ours", s + j + base) == F.get("theirs", s + j + base), 1).otherwise(0))
    inside = lambda s: (i + s >= 0) & (i + s + length <= F.col("n")) & F.get("ours", s + base).isNotNull() & F.get("ours", s + base + length - 1).isNotNull()
    holds = F.exists(F.sequence(SPAN - length, F.lit(0)), lambda s: inside(s) & (equal(s) >= F.ceil(length * SIMILAR)))
    held = met(hits, seeds, n_seeds).where(holds).select("id", "item")
    held = held if short is None else held.unionAll(short)
    return held.groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumnRenamed("id", id_col)


def mark(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, contaminated, n_items, items for every row of docs.

    Nulls, repeated rows and empty tables as in find_items: a null or empty text holds nothing, each repeated row has the
    answer of its id, an empty docs gives no rows, with an empty benchmark nothing is contaminated. Extra columns are ignored.
    """
    ids = docs.select(id_col)
    (own,) = fresh(ids, "own")
    found = cut(find_items(docs, items, id_col, text, item_col).withColumnsRenamed({id_col: own}).withColumnRenamed("items", own + "_items"), "found")
    got = F.col(own + "_items")
    return ids.join(found, F.col(id_col).eqNullSafe(F.col(own)), "left").select(
        id_col, got.isNotNull().alias("contaminated"), F.coalesce(F.size(got), F.lit(0)).alias("n_items"), F.coalesce(got, F.array().cast(found.schema[own + "_items"].dataType)).alias("items")
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id") -> DataFrame:
    """docs, with all their columns, without the rows whose id holds a benchmark item.

    Null and empty texts hold nothing and stay, unless another row of their id holds an item; rows that repeat an id, the
    null id among them, stay or go together. An empty docs gives no rows; with an empty benchmark all rows stay.
    """
    (own,) = fresh(docs, "own")
    found = cut(find_items(docs, items, id_col, text, item_col).select(F.col(id_col).alias(own)), "found")
    return docs.join(found, F.col(id_col).eqNullSafe(F.col(own)), "left_anti")


def op5(spark: SparkSession, sf: str) -> DataFrame:
    return mark(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
