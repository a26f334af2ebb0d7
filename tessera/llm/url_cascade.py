"""URL filter: a cascade of Bloom filters that is exact over all keys the corpus can ask for.

A url asks for the keys suffix-of-host + prefix-of-path, for the label counts and path lengths that the rules have.
Level 0 of a cascade encodes the listed keys; level 1 the corpus's other keys that pass level 0; level 2 the listed
keys that pass level 1; and so on until none is left. A key is listed exactly if the first level that lacks it is odd.
Filters are built from bits that are or-ed across partitions. They are sized before they are built; where one would
be larger than `max_filter_bytes`, the same verdicts come from a shuffled join instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, fresh, splitmix

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
DEFAULT_VERDICT = "allow"


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray


def spots(h1: np.ndarray, h2: np.ndarray, level: int, j: int, bits: int) -> np.ndarray:
    salt = splitmix(np.array([level * 64 + j], dtype=np.uint64))[0]
    return splitmix(h1.view(np.uint64) ^ salt ^ splitmix(h2.view(np.uint64) + salt)) % np.uint64(bits)


def has(lv: Level, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    ok = np.ones(len(h1), dtype=bool)
    for j in range(lv.hashes):
        s = spots(h1, h2, level, j, lv.bits)
        ok &= (lv.words[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1) == 1
    return ok


def listed(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Membership: the count of levels passed before the first that lacks the key is odd."""
    passed = np.zeros(len(h1), dtype=np.int64)
    live = np.arange(len(h1))
    for i, lv in enumerate(levels):
        live = live[has(lv, h1[live], h2[live], i)]
        passed[live] += 1
    return passed % 2 == 1


class FilterTooLarge(ValueError):
    pass


def filter_of(keys: DataFrame, level: int, rate: float, max_filter_bytes: int) -> Level | None:
    """A Bloom filter of keys (h1, h2); None if there are no keys."""
    n = keys.count()
    if not n:
        return None
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    if bits > 8 * max_filter_bytes:
        raise FilterTooLarge(f"{n} keys need {bits // 8} bytes; the bound is {max_filter_bytes}")
    hashes = max(1, round(bits / n * math.log(2)))

    def ones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = np.zeros(bits // 64 + 1, dtype=np.uint64)
        for b in batches:
            for j in range(hashes):
                s = spots(b.h1.to_numpy(), b.h2.to_numpy(), level, j, bits)
                np.bitwise_or.at(words, (s >> np.uint64(6)).astype(np.int64), np.uint64(1) << (s & np.uint64(63)))
        at = np.flatnonzero(words)
        yield pd.DataFrame({"word": at, "ones": words[at].view(np.int64)})

    words = np.zeros(bits // 64 + 1, dtype=np.uint64)
    got = keys.mapInPandas(ones, "word long, ones long").groupBy("word").agg(F.bit_or("ones").alias("ones")).toArrow()  # max_filter_bytes / 8 rows at most
    words[got["word"].to_numpy()] = got["ones"].to_numpy().view(np.uint64)
    return Level(bits, hashes, words)


def passing(keys: DataFrame, lv: Level, level: int) -> DataFrame:
    """The keys that a level contains. The filter goes out as a broadcast of a size checked when it was built."""
    sent = keys.sparkSession.sparkContext.broadcast(lv)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[has(sent.value, b.h1.to_numpy(), b.h2.to_numpy(), level)]

    return keys.mapInPandas(keep, keys.schema)


def build_cascade(positive: DataFrame, negative: DataFrame, first_rate: float = 2**-10, max_filter_bytes: int = 64 << 20) -> list[Level]:
    """Levels that tell positive from negative keys; both are (h1, h2). negative is read once, through level 0."""
    lv = filter_of(positive, 0, first_rate, max_filter_bytes)
    levels: list[Level] = []
    own, other = positive, None
    while lv is not None:
        levels.append(lv)
        i = len(levels) - 1
        source = negative if other is None else other
        left = cut(passing(source, lv, i).distinct(), "cascade")
        own, other = left, own
        lv = filter_of(own, i + 1, 0.5, max_filter_bytes)
        if len(levels) > 200:
            raise ValueError("two keys share both hashes")
    return levels


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """host: after the first `://` up to / ? # or end, A-Z lower-cased; path: from there up to ? # or end; both empty without `://`."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substr(F.col(url), F.instr(url, "://") + 3)), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", path)


def asked(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """The keys a url asks for, longest first (of equal length, the longer host first)."""
    parts = F.split(host, r"\.")
    suffix = lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")
    one = [
        F.when((F.size(parts) >= n) & (F.char_length(path) >= m) & (host != ""), F.struct((F.char_length(suffix(n)) + m).alias("n"), F.char_length(suffix(n)).alias("h"), F.concat(suffix(n), F.substring(path, 1, m)).alias("key")))
        for n in labels
        for m in lengths
    ]
    return F.transform(F.reverse(F.array_sort(F.array_compact(F.array(*one)))), lambda x: x["key"])


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", first_rate: float = 2**-10, max_filter_bytes: int = 64 << 20
) -> DataFrame:
    """pages with host, path, rule and verdict; rules: (host, path, action).

    The longest rule that fits wins (of two equally long, the one with the longer host); without one, rule is null and
    the verdict DEFAULT_VERDICT. Null urls and urls without `://` have empty host and path and fit no rule. Repeated
    pages are judged alike; an empty table gives no rows; if rules repeat a key, its first action by name holds.
    Columns of pages named like the added ones are replaced.
    """
    spark = pages.sparkSession
    rules = cut(
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
        .where("host is not null and host <> ''")
        .groupBy("host", "path").agg(F.min("action").alias("action"))
        .select(F.concat("host", "path").alias("key"), "action", F.size(F.split("host", r"\.")).alias("labels"), F.char_length("path").alias("length")),
        "rules",
    )
    shape = rules.agg(F.collect_set("labels").alias("a"), F.collect_set("length").alias("b")).first()
    out = with_host_and_path(pages.drop("host", "path", "rule", "verdict"), url)
    if not shape.a:
        return out.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(DEFAULT_VERDICT))
    keys = asked(F.col("host"), F.col("path"), sorted(shape.a), sorted(shape.b))
    hashes = lambda k: (F.xxhash64(k), F.xxhash64(k, F.lit("~")))
    pair = lambda df: df.select(*(h.alias(n) for h, n in zip(hashes(F.col("key")), ("h1", "h2"))))
    try:
        # Only keys that pass the rules' own filter are dealt out; those that are rules themselves are no negatives, which
        # an aggregation of both tells.
        universe = pair(out.select(F.explode(keys).alias("key")))
        first = filter_of(pair(rules), 0, first_rate, max_filter_bytes)
        both = passing(universe, first, 0).withColumn("own", F.lit(0)).unionAll(pair(rules).withColumn("own", F.lit(1)))
        others = cut(both.groupBy("h1", "h2").agg(F.max("own").alias("own")).where("own = 0").select("h1", "h2"), "universe")
        is_rule = build_cascade(pair(rules), others, first_rate, max_filter_bytes)
        is_block = build_cascade(pair(rules.where("action = 'block'")), pair(rules.where("action <> 'block'")), first_rate, max_filter_bytes)
    except FilterTooLarge:
        return judge_by_join(out, keys, rules)
    sent = spark.sparkContext.broadcast((is_rule, is_block))

    @F.pandas_udf("int")
    def winner(a: pd.Series, b: pd.Series) -> pd.Series:
        """The place of the first key that is a rule, from 1, negative if it allows; 0: none."""
        n = a.map(len).to_numpy()
        if not n.sum():
            return pd.Series(np.zeros(len(n), dtype=np.int32))
        h1, h2 = (np.concatenate(x.to_numpy()).astype(np.int64) for x in (a, b))
        levels, blocks = sent.value
        at = np.flatnonzero(listed(levels, h1, h2))
        row = np.repeat(np.arange(len(n)), n)
        rows, first = np.unique(row[at], return_index=True)
        hit = at[first]
        place = hit - (np.cumsum(n) - n)[rows] + 1
        out = np.zeros(len(n), dtype=np.int32)
        out[rows] = np.where(listed(blocks, h1[hit], h2[hit]), place, -place)
        return pd.Series(out)

    held, at = fresh(out, "held", "at")
    out = out.withColumn(held, keys).withColumn(at, winner(F.transform(held, lambda k: F.xxhash64(k)), F.transform(held, lambda k: F.xxhash64(k, F.lit("~")))))
    return (
        out.withColumn("rule", F.when(F.col(at) != 0, F.element_at(held, F.abs(at))))
        .withColumn("verdict", F.when(F.col(at) > 0, "block").when(F.col(at) < 0, "allow").otherwise(DEFAULT_VERDICT))
        .drop(held, at)
    )


def judge_by_join(out: DataFrame, keys: Column, rules: DataFrame) -> DataFrame:
    """The same verdicts by a shuffled join over distinct hosts and paths, for rule lists beyond any filter's bound."""
    (w,) = fresh(out, "w")
    asked_for = out.select("host", "path").distinct().select("host", "path", F.posexplode(keys).alias("at", "key"))
    won = asked_for.join(rules.select("key", "action"), "key").groupBy("host", "path").agg(F.min(F.struct("at", "key", "action")).alias(w))
    return (
        out.join(won, ["host", "path"], "left")
        .withColumn("rule", F.col(w)["key"])
        .withColumn("verdict", F.when(F.col(w).isNull(), DEFAULT_VERDICT).when(F.col(w)["action"] == "block", "block").otherwise("allow"))
        .drop(w)
    )


def op1(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge_urls(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    case = lambda value: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(h, p, a)}'" for h, p, a in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    return f"""
WITH r AS (SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, {case(lambda h, p, a: h + p)} END AS rule, {case(lambda h, p, a: a)} ELSE '{DEFAULT_VERDICT}' END AS verdict FROM u"""


SQL1 = _sql()
