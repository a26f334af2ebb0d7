"""The engine's queries over the test tables, and the SQL that says what each must return."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plans.spec import compile_spec
from .plans.sqlparser import parse
from .session import Database
from .sources import advisor, ecc, storage
from .streaming import Cursor

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def shared(spark: SparkSession) -> str:
    """A new folder in the one that all executors share; a cluster must name it, a local session may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", named := "/tmp/checkpoints")
    return f"{named.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A test table; lineitem and part with null-bearing columns derived from their flags and sizes."""
    df = spark.read.parquet(f"{sf}/{table}.parquet")
    if table == "lineitem":
        df = df.withColumns({"flag": F.nullif("l_returnflag", F.lit("R")), "qty": F.nullif("l_quantity", F.lit(1.0)), "price": F.col("l_extendedprice").cast("decimal(18,2)")})
    if table == "part":
        df = df.withColumn("size0", F.nullif("p_size", F.lit(1)))
    return df


VIEWS = {
    "lineitem": "(SELECT *, nullif(l_returnflag, 'R') AS flag, nullif(l_quantity, 1.0) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem)",
    "part": "(SELECT *, nullif(p_size, 1) AS size0 FROM part)",
}


def sql(name: str, text: str, oracle: str | None = None, finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Register a query given as the engine's SQL; the oracle is the same text unless the dialects differ."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = parse(text)
        out = compile_spec(load(spark, sf, s.table), s.spec)
        return finish(out) if finish else out

    QUERIES[name] = run
    table = parse(text).table
    ORACLES[name] = (oracle or text).replace(f"FROM {table}", f"FROM {VIEWS[table]}", 1) if table in VIEWS else oracle or text


def other(name: str, oracle: str | None = None):
    """Register a query given as a function."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


upper, lower = (f"translate({{}}, '{a}', '{b}')" for a, b in ((LOWER, UPPER), (UPPER, LOWER)))
two = lambda *names: lambda df: df.withColumns({n: F.col(n).cast("double") for n in names})

# Scans and projection
sql("scan_full", "SELECT * FROM nation")
sql("scan_projection", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
sql("project_alias", "SELECT o_orderkey AS k, o_orderstatus AS status FROM orders")

# Predicates
sql("filter_eq", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
sql("filter_lt", "SELECT o_orderkey FROM orders WHERE o_totalprice < 50000")
sql("filter_gt", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 48")
sql("filter_le", "SELECT c_custkey FROM customer WHERE c_acctbal <= -500.5")
sql("filter_ge", "SELECT o_orderkey FROM orders WHERE o_orderpriority >= '3'")
sql("filter_ne_null", "SELECT l_orderkey, l_linenumber, flag FROM lineitem WHERE flag != 'A'", "SELECT l_orderkey, l_linenumber, flag FROM lineitem WHERE flag <> 'A' OR flag IS NULL")
sql("filter_is_null", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE flag IS NULL")
sql("filter_is_not_null", "SELECT l_orderkey, l_linenumber, flag FROM lineitem WHERE flag IS NOT NULL")
sql("filter_in", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (1, 7, 42, 100)")
sql("filter_not_in", "SELECT p_partkey, size0 FROM part WHERE size0 NOT IN (2, 3, NULL)", "SELECT p_partkey, size0 FROM part WHERE size0 NOT IN (2, 3) AND size0 IS NOT NULL")
sql("filter_between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000.5")
sql("filter_dnf", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000 OR o_orderstatus = 'F' AND o_custkey < 50")
sql("filter_parentheses", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_orderstatus = 'P') AND o_totalprice > 200000")
sql("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%'")
sql("filter_not_like", "SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%a%'")
sql("filter_like_backslash", "SELECT p_partkey FROM part WHERE p_name LIKE '%\\%'")
sql("filter_string_number", "SELECT p_partkey FROM part WHERE p_name != 42", "SELECT p_partkey FROM part")

# The predicate list over files
for key, (column, op, value) in {"eq": ("l_quantity", "=", 25), "ne": ("l_quantity", "!=", 25), "gt": ("l_quantity", ">", 45), "ge": ("l_discount", ">=", 0.09), "lt": ("l_extendedprice", "<", 2000), "le": ("l_linenumber", "<=", 1)}.items():
    other(f"pred_{key}", f"SELECT l_orderkey, l_partkey, {column} FROM lineitem WHERE {column} {op} {value}")(
        lambda spark, sf, p=(column, op, value): storage.query(spark, f"{sf}/lineitem.parquet", [p], ["l_orderkey", "l_partkey", p[0]])
    )


@other("pred_conj", "SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'A' AND l_discount < 0.03")
def pred_conj(spark, sf):
    return storage.query(spark, f"{sf}/lineitem.parquet", [("l_quantity", ">", 25), ("l_returnflag", "=", "A"), ("l_discount", "<", 0.03)], ["l_orderkey", "l_returnflag"])


@other("pred_offset_past_end", "SELECT n_nationkey FROM nation LIMIT 0")
def pred_offset_past_end(spark, sf):
    return storage.query(spark, f"{sf}/nation.parquet", [], ["n_nationkey"], offset=1000)


# Scalar functions
sql("fn_upper", "SELECT doc_id, UPPER(text) AS u FROM documents", f"SELECT doc_id, {upper.format('text')} AS u FROM documents")
sql("fn_lower", "SELECT doc_id, LOWER(text) AS l FROM documents", f"SELECT doc_id, {lower.format('text')} AS l FROM documents")
sql("fn_length", "SELECT doc_id, LENGTH(text) AS n, LENGTH(n_chars) AS same FROM documents", "SELECT doc_id, strlen(text) AS n, n_chars AS same FROM documents")

# Aggregation
sql("agg_count_star", "SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag")
sql("agg_count_col", "SELECT l_linestatus, COUNT(flag) AS n FROM lineitem GROUP BY l_linestatus")
sql("agg_sum", "SELECT l_returnflag, SUM(l_linenumber) AS s, SUM(price) AS p FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(SUM(l_linenumber) AS BIGINT) AS s, CAST(SUM(price) AS DOUBLE) AS p FROM lineitem GROUP BY l_returnflag", two("p"))
sql("agg_avg", "SELECT l_linestatus, AVG(qty) AS a FROM lineitem GROUP BY l_linestatus")
sql("agg_min", "SELECT l_returnflag, MIN(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag")
sql("agg_max", "SELECT l_returnflag, MAX(qty) AS m FROM lineitem GROUP BY l_returnflag")
sql("agg_minmax_string", "SELECT p_brand, MIN(p_name) AS a, MAX(p_name) AS b FROM part GROUP BY p_brand")
sql("agg_multi", "SELECT l_returnflag, SUM(l_quantity) AS s, COUNT(*) AS n, MIN(l_discount) AS a, MAX(l_tax) AS b, AVG(l_quantity) AS m FROM lineitem GROUP BY l_returnflag")
sql("agg_count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n, SUM(DISTINCT l_linenumber) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
sql("agg_global", "SELECT COUNT(*) AS n, MIN(o_totalprice) AS a, MAX(o_orderdate) AS b FROM orders")
sql("agg_global_empty", "SELECT COUNT(*) AS n, SUM(o_custkey) AS s FROM orders WHERE o_orderkey < 0", "SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s FROM orders WHERE o_orderkey < 0")
sql("group_by_one", "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment")
sql("group_by_multi", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("group_by_null_key", "SELECT flag, COUNT(*) AS n FROM lineitem GROUP BY flag")
sql("group_by_alias", "SELECT UPPER(p_name) AS u, COUNT(*) AS n FROM part GROUP BY u", f"SELECT {upper.format('p_name')} AS u, COUNT(*) AS n FROM part GROUP BY 1")
sql("group_by_no_agg", "SELECT p_brand, p_type FROM part GROUP BY p_brand, p_type")
sql("group_scalar_key", "SELECT LOWER(c_mktsegment) AS s, COUNT(*) AS n FROM customer GROUP BY c_mktsegment", f"SELECT {lower.format('c_mktsegment')} AS s, COUNT(*) AS n FROM customer GROUP BY c_mktsegment")
sql("group_order_limit", "SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 10 OFFSET 2")
sql("having_count", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 14")
sql("having_sum", "SELECT l_suppkey, SUM(l_quantity) AS q FROM lineitem GROUP BY l_suppkey HAVING l_quantity > 15000", "SELECT l_suppkey, SUM(l_quantity) AS q FROM lineitem GROUP BY l_suppkey HAVING SUM(l_quantity) > 15000")
sql("having_alias", "SELECT p_brand, MAX(p_size) AS m, MIN(p_size) AS a FROM part GROUP BY p_brand HAVING m >= 50 AND a = 1")

# Sort, limit, distinct
sql("sort_asc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50")
sql("sort_desc", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 50")
sql("sort_multi", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment DESC, c_nationkey, c_custkey LIMIT 70")
sql("sort_nulls", "SELECT p_partkey, size0 FROM part ORDER BY size0, p_partkey LIMIT 60", "SELECT p_partkey, size0 FROM part ORDER BY size0 NULLS FIRST, p_partkey LIMIT 60")
sql("sort_alias", "SELECT p_partkey, LENGTH(p_name) AS n FROM part ORDER BY n DESC, p_partkey LIMIT 40", "SELECT p_partkey, strlen(p_name) AS n FROM part ORDER BY n DESC, p_partkey LIMIT 40")
sql("limit_n", "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 17")
sql("limit_zero", "SELECT event_id FROM events LIMIT 0")
sql("limit_offset", "SELECT event_id FROM events ORDER BY event_id LIMIT 20 OFFSET 35")
sql("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
sql("distinct_one", "SELECT DISTINCT p_brand FROM part")
sql("distinct_multi", "SELECT DISTINCT p_type, size0 FROM part")
sql("distinct_scalar", "SELECT DISTINCT UPPER(event_type) AS t FROM events", f"SELECT DISTINCT {upper.format('event_type')} AS t FROM events")


# Storage
@other("peek_schema", "SELECT * FROM (VALUES (1, 'o_orderkey', 'bigint'), (2, 'o_custkey', 'bigint'), (3, 'o_orderstatus', 'string'), (4, 'o_totalprice', 'double'), (5, 'o_orderdate', 'timestamp_ntz'), (6, 'o_orderpriority', 'string')) AS t(ordinal, name, type)")
def peek_schema(spark, sf):
    found = storage.peek(spark, f"{sf}/orders.parquet")["columns"]
    return spark.createDataFrame([(i, n, k) for i, (n, k, _) in enumerate(found, 1)], "ordinal int, name string, type string")


@other("write_roundtrip", "SELECT * FROM events")
def write_roundtrip(spark, sf):
    storage.write(load(spark, sf, "events"), path := shared(spark), manifest=True)
    storage.verify(spark, path)
    return storage.read(spark, path, check=True)


for codec in ("none", "snappy", "lz4", "zstd", "gzip"):
    @other(f"write_codec_{codec}", "SELECT * FROM part")
    def write_codec(spark, sf, codec=codec):
        storage.write(spark.read.parquet(f"{sf}/part.parquet"), path := shared(spark), codec=codec)
        return storage.read(spark, path, check=True)


@other("write_encodings", "SELECT event_id, user_id, event_type FROM events")
def write_encodings(spark, sf):
    df = load(spark, sf, "events")
    kinds = {"event_id": "DELTA", "user_id": "BIT_PACKED", "event_type": "DICT"}
    storage.write(df.select(*(F.col(c).alias(c, metadata={"encoding": e}) for c, e in kinds.items())), path := shared(spark))
    return storage.read(spark, path, check=True)


@other("prune_sorted", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 48")
def prune_sorted(spark, sf):
    storage.write(spark.read.parquet(f"{sf}/lineitem.parquet"), path := shared(spark), sort_by=["l_quantity"])
    return storage.query(spark, path, [("l_quantity", ">", 48)], ["l_orderkey", "l_quantity"])


@other("scan_partition")
def scan_partition(spark, sf):
    return storage.read_partition(load(spark, sf, "orders"), 0)


@other("scan_chunk", "SELECT * FROM orders")
def scan_chunk(spark, sf):
    return storage.read_chunk(spark, f"{sf}/orders.parquet", 0)


@other("out_json", "SELECT CAST(json_object('n_nationkey', n_nationkey, 'n_name', n_name, 'n_regionkey', n_regionkey) AS VARCHAR) AS line FROM nation")
def out_json(spark, sf):
    return load(spark, sf, "nation").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))


# Encoding advice, in the order of event_id
_BITS = "CASE WHEN {0} = 0 THEN 0 ELSE length(bin({0})) END"
_PROFILE = (
    "WITH v AS (SELECT 'user_id' AS \"column\", 8 AS width, event_id, user_id AS v FROM events UNION ALL SELECT 'event_id', 8, event_id, event_id FROM events UNION ALL SELECT 'bucket', 4, event_id, CAST(event_id // 500 AS INTEGER) FROM events),"
    ' s AS (SELECT *, v - lag(v) OVER (PARTITION BY "column" ORDER BY event_id) AS d FROM v),'
    ' p AS (SELECT "column", CAST(count(*) AS BIGINT) AS n, any_value(width) AS width, min(v) AS least, max(v) AS most, CAST(1 + count(*) FILTER (d <> 0) AS BIGINT) AS runs, least(0, min(d)) AS least_step, greatest(0, max(d)) AS most_step FROM s GROUP BY 1),'
    f" b AS (SELECT *, CAST({_BITS.format('(most - least)')} AS INTEGER) AS bits, CAST(CASE WHEN least_step < 0 AND most_step > 0 THEN 0 ELSE {_BITS.format('greatest(-least_step, most_step)')} END AS INTEGER) AS delta_bits FROM p),"
    " z AS (SELECT *, n * width AS plain, CAST(width + 1 + (n * bits + 7) // 8 AS BIGINT) AS bit_packed, CASE WHEN delta_bits > 0 THEN CAST(2 + width + (n * delta_bits + 7) // 8 AS BIGINT) END AS delta, CASE WHEN runs < n THEN CAST(4 + runs * (width + 4) AS BIGINT) END AS rle FROM b)"
)
_CHOICE = "CASE WHEN rle < least(plain, coalesce(delta, plain)) THEN 'RLE' WHEN delta < plain THEN 'DELTA' ELSE 'PLAIN' END AS choice"


def _advice(spark, sf):
    df = load(spark, sf, "events").withColumn("bucket", F.floor(F.col("event_id") / 500).cast("int"))
    return advisor.profile_rows(df, ["user_id", "event_id", "bucket"], "event_id")


@other("enc_stats", f'{_PROFILE} SELECT "column", n, width, least, most, bits, plain, bit_packed FROM z')
def enc_stats(spark, sf):
    return _advice(spark, sf).select("column", "n", "width", "least", "most", "bits", "plain", "bit_packed")


@other("enc_advisor", f'{_PROFILE} SELECT "column", plain, bit_packed, delta, rle, {_CHOICE} FROM z')
def enc_advisor(spark, sf):
    return _advice(spark, sf).select("column", "plain", "bit_packed", "delta", "rle", "choice")


@other("enc_delta_candidates", f'{_PROFILE} SELECT "column", delta_bits, delta FROM z WHERE delta IS NOT NULL')
def enc_delta_candidates(spark, sf):
    return _advice(spark, sf).where("delta is not null").select("column", "delta_bits", "delta")


@other("enc_rle_runs", f'{_PROFILE} SELECT "column", runs, rle FROM z')
def enc_rle_runs(spark, sf):
    return _advice(spark, sf).select("column", "runs", "rle")


@other("enc_dict_candidates", "SELECT c AS \"column\", e AS encoding FROM (SELECT unnest(['p_name', 'p_brand', 'p_type']) AS c, unnest([CASE WHEN count(DISTINCT p_name) > 1 AND count(DISTINCT p_name) <= count(*) / 4 THEN 'DICT' ELSE 'PLAIN' END, CASE WHEN count(DISTINCT p_brand) > 1 AND count(DISTINCT p_brand) <= count(*) / 4 THEN 'DICT' ELSE 'PLAIN' END, CASE WHEN count(DISTINCT p_type) > 1 AND count(DISTINCT p_type) <= count(*) / 4 THEN 'DICT' ELSE 'PLAIN' END]) AS e FROM part)")
def enc_dict_candidates(spark, sf):
    return advisor.checkpoint_choice(load(spark, sf, "part").select("p_name", "p_brand", "p_type"))


@other("enc_checkpoint_choice", f"SELECT c AS \"column\", e AS encoding FROM (SELECT unnest(['o_orderkey', 'o_orderstatus', 'o_totalprice', 'o_orderpriority']) AS c, unnest([CASE WHEN {_BITS.format('(max(o_orderkey) - min(o_orderkey))')} BETWEEN 1 AND 24 THEN 'BIT_PACKED' ELSE 'PLAIN' END, CASE WHEN count(DISTINCT o_orderstatus) > 1 AND count(DISTINCT o_orderstatus) <= count(*) / 4 THEN 'DICT' ELSE 'PLAIN' END, 'PLAIN', CASE WHEN count(DISTINCT o_orderpriority) > 1 AND count(DISTINCT o_orderpriority) <= count(*) / 4 THEN 'DICT' ELSE 'PLAIN' END]) AS e FROM orders)")
def enc_checkpoint_choice(spark, sf):
    return advisor.checkpoint_choice(load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))


# Tables that change
def database(spark: SparkSession, sf: str) -> Database:
    db = Database(spark, shared(spark))
    nation = load(spark, sf, "nation")
    db._table("nation").create(T.StructType(nation.schema.fields))
    db.table("nation").append(nation)
    return db


def mutation(name: str, oracle: str, *statements: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        db = database(spark, sf)
        for s in statements:
            db.exec(s)
        return db.exec("SELECT * FROM nation")

    QUERIES[name], ORACLES[name] = run, oracle


mutation("dml_insert", "SELECT * FROM nation UNION ALL SELECT 100, 'ATLANTIS', 9 UNION ALL SELECT 101, NULL, NULL", "INSERT INTO nation VALUES (100, 'ATLANTIS', '9'), (101, NULL, 'x')")
mutation("dml_update", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'it''s' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 2 THEN 7 ELSE n_regionkey END AS n_regionkey FROM nation", "UPDATE nation SET n_name = 'it''s', n_regionkey = 7 WHERE n_regionkey = 2")
mutation("dml_delete", "SELECT * FROM nation WHERE NOT (n_regionkey = 1 OR n_nationkey > 20)", "DELETE FROM nation WHERE n_regionkey = 1 OR n_nationkey > 20")
mutation("ddl_add_column", "SELECT *, CASE WHEN n_nationkey < 3 THEN 1.5 END AS w FROM nation".replace("1.5 END", "CAST(1.5 AS DOUBLE) END"), "ALTER TABLE nation ADD COLUMN w DOUBLE", "UPDATE nation SET w = 1.5 WHERE n_nationkey < 3")
mutation("ddl_drop_column", "SELECT n_nationkey, n_name FROM nation", "ALTER TABLE nation DROP COLUMN n_regionkey")
mutation("snapshot_restore", "SELECT * FROM nation", ".snapshot before", "DELETE FROM nation", "DROP TABLE nation", ".restore before")
mutation("rollback", "SELECT * FROM nation", ".checkpoint", "DELETE FROM nation WHERE n_nationkey < 10", "ROLLBACK")
mutation("transaction_rollback", "SELECT * FROM nation", "BEGIN", "UPDATE nation SET n_name = 'x'", "ROLLBACK")
mutation("checkpoint_compact", "SELECT * FROM nation UNION ALL SELECT 50, 'Z', 0", "INSERT INTO nation VALUES (50, 'Z', 0)", ".checkpoint")


@other("recover_reopen", "SELECT * FROM nation WHERE n_nationkey <> 3")
def recover_reopen(spark, sf):
    db = database(spark, sf)
    db.exec("DELETE FROM nation WHERE n_nationkey = 3")
    return Database(spark, db.path).exec("SELECT * FROM nation")


@other("stream_select", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3")
def stream_select(spark, sf):
    """The rows of a cursor over a table of fixed size."""
    df = load(spark, sf, "nation")
    s = parse("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3")
    with Cursor(compile_spec(df, s.spec)) as c:
        return spark.createDataFrame(c.fetchall(), "n_nationkey int, n_name string")


@other("ecc_roundtrip")
def ecc_roundtrip(spark, sf):
    df = load(spark, sf, "part").select("p_partkey", "p_name")
    coded = ecc.protect(df, "p_name").withColumn("coded", F.expr("concat(substring(coded, 1, 40), unhex('FF00FF00'), substring(coded, 45))"))
    return ecc.repair(coded).select("p_partkey", "p_name", F.col("repaired").cast("string").alias("repaired"), "errors")


@other("ecc_values", "SELECT p_partkey, p_name AS repaired, TRUE AS in_bounds FROM part")
def ecc_values(spark, sf):
    return ecc_roundtrip(spark, sf).select("p_partkey", "repaired", F.col("errors").between(0, 16).alias("in_bounds"))


@other("ecc_files", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def ecc_files(spark, sf):
    storage.write(load(spark, sf, "nation"), path := shared(spark), rs=True)
    ecc.repair_files(spark, path)
    return storage.read(spark, path)


FLAGSHIP = "SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag ORDER BY l_returnflag"
sql("flagship", FLAGSHIP)
