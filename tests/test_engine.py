"""Rules that the catalogue's queries don't show: errors, nulls, recovery, repair, cursors and the shell."""

import asyncio
import io
import random

import pytest

from tessera import BadArgs, BadSchema, Corrupt, Database, NotFound, Op, Or, Pred, query
from tessera.cli import Shell, main, show
from tessera.errors import Conflict
from tessera.plans.sqlparser import parse, split_script
from tessera.sources import advisor, ecc, storage
from tessera.sources.files import Files


@pytest.fixture
def db(spark, tmp_path):
    d = Database(spark, str(tmp_path / "db"))
    d.exec("CREATE TABLE people (name TEXT, age I32 NOT NULL BIT_PACKED, salary F64)")
    d.executemany("INSERT INTO people VALUES (?, ?, ?)", [("alice", 30, 80000), ("bob", "25.9", "55000"), ("charlie", 30, 90000.5), (None, 41, None)])
    return d


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_coercion_and_nulls(db):
    assert rows(db.exec("SELECT * FROM people WHERE name = 'bob'")) == [("bob", 25, 55000.0)]
    assert rows(db.exec("SELECT age FROM people WHERE name != 'bob'")) == [(30,), (30,), (41,)]
    assert rows(db.exec("SELECT age FROM people WHERE name NOT IN ('bob', NULL)")) == [(30,), (30,)]
    assert rows(db.exec("SELECT age FROM people WHERE name NOT LIKE 'a%' OR salary IS NULL")) == [(25,), (30,), (41,)]
    assert rows(db.exec("SELECT age FROM people WHERE name = 42")) == [] and len(rows(db.exec("SELECT age FROM people WHERE name != 42"))) == 4
    assert rows(db.exec("SELECT age, COUNT(salary) AS n, AVG(salary) AS a FROM people GROUP BY age HAVING n < 1")) == [(41, 0, None)]
    db.exec("INSERT INTO people VALUES ('9007199254740993', 1, 'abc')")
    assert rows(db.exec("SELECT salary FROM people WHERE name = '9007199254740993'")) == [(None,)]


@pytest.mark.parametrize("sql", [
    "SELECT nothing FROM people", "SELECT * FROM people WHERE nothing IS NULL", "SELECT name, COUNT(*) FROM people", "SELECT name, age FROM people GROUP BY name",
    "UPDATE people SET nothing = 1", "UPDATE people SET age = NULL", "INSERT INTO people VALUES (1, 2)", "INSERT INTO people VALUES ('x', NULL, 1)",
    "ALTER TABLE people DROP COLUMN nothing", "ALTER TABLE people ADD COLUMN name TEXT", "ALTER TABLE people ADD COLUMN z TEXT NOT NULL", "CREATE TABLE people (a INT)",
    "SELECT DISTINCT name FROM people ORDER BY age",
])
def test_schema_errors(db, sql):
    with pytest.raises(BadSchema):
        db.exec(sql)


@pytest.mark.parametrize("sql", [
    "SELECT name age FROM people", "SELECT * FROM people OFFSET 1 LIMIT 2", "SELECT * FROM people WHERE age = NULL", "SELECT * FROM people LIMIT -1", "CREATE TABLE t (a VARCHAR(3))",
    "SELECT SUM(*) FROM people", "SELECT * FROM people WHERE age = ?", "SELECT * FROM people WHERE age = 99999999999999999999", "DELETE people", ".nothing", "SELECT * FROM people; x", "SELECT ~ FROM people",
])
def test_syntax_errors(db, sql):
    with pytest.raises(BadArgs):
        db.exec(sql)


def test_parse():
    s = parse("select distinct UPPER(a) as u, b from t where a='it''s' and (b<-5 or b between 1 and 2.5) order by u desc limit 3 offset 1;")
    assert s.spec.distinct and s.spec.limit == 3 and s.spec.offset == 1 and s.spec.where.parts[0] == Pred("a", Op.EQ, "it's")
    assert s.spec.where.parts[1] == Or((Pred("b", Op.LT, -5), Pred("b", Op.BETWEEN, (1, 2.5))))
    assert split_script("-- note\nSELECT 'a;b' FROM t; .tables\n;") == ["SELECT 'a;b' FROM t", ".tables"]


def test_random_conditions_against_python(spark):
    rng = random.Random(3)
    data = [(rng.choice([None, *range(6)]), rng.choice([None, "a", "b", "ab", "%"])) for _ in range(200)]
    df = spark.createDataFrame(data, "v int, s string")

    def holds(p, row):
        x = row[0] if p.column == "v" else row[1]
        if p.op is Op.NE:
            return x is None or x != p.value
        if x is None:
            return False
        return {Op.EQ: lambda: x == p.value, Op.LT: lambda: x < p.value, Op.GE: lambda: x >= p.value, Op.NOT_IN: lambda: x not in p.value, Op.IN: lambda: x in p.value}[p.op]()

    for _ in range(12):
        preds = [Pred(c := rng.choice("vs"), o := rng.choice([Op.EQ, Op.NE, Op.LT, Op.GE, Op.IN, Op.NOT_IN]), (lambda v: (v,) if o in (Op.IN, Op.NOT_IN) else v)(rng.randrange(6) if c == "v" else rng.choice(["a", "b", "%"]))) for _ in range(3)]
        got = query(df).where(Or.of(preds[0], preds[1]), preds[2]).to_df().collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(repr(r) for r in data if (holds(preds[0], r) or holds(preds[1], r)) and holds(preds[2], r))


def test_versions_snapshots_and_recovery(db, spark):
    before = db.exec("SELECT * FROM people")
    db.snapshot("one")
    db.exec("ALTER TABLE people DROP COLUMN salary")
    db.exec("ALTER TABLE people ADD COLUMN salary F64")
    assert rows(db.exec("SELECT salary FROM people")) == [(None,)] * 4
    db.exec("DELETE FROM people WHERE age = 30")
    assert before.count() == 4 and db.exec("SELECT * FROM people").count() == 2
    # A session that is lost between writing rows and the log leaves a folder and a draft, which are not read.
    t = db.table("people")
    t._store(t.read(), t.state())
    Files(spark, t.path).create("log/lost.draft", "{")
    again = Database(spark, db.path)
    assert again.exec("SELECT * FROM people").count() == 2 and again.vacuum() >= 1
    again.restore("one")
    assert rows(again.exec("SELECT * FROM people")) == rows(before) and again.list_snapshots() == ["one"]
    again.exec("DROP TABLE people")
    with pytest.raises(NotFound):
        Database(spark, db.path).exec("SELECT * FROM people")


def test_transactions(db):
    db.exec("BEGIN")
    db.exec("DELETE FROM people")
    assert Database(db.spark, db.path).exec("SELECT * FROM people").count() == 4
    db.exec("COMMIT")
    assert db.table("people").state().op == "checkpoint" and db.exec("SELECT * FROM people").count() == 0
    db.exec("INSERT INTO people VALUES ('x', 1, 1)")
    db.exec("ROLLBACK")
    assert db.exec("SELECT * FROM people").count() == 0


def test_storage(spark, tmp_path):
    df = spark.range(2000).selectExpr("id", "concat('s', id % 7) AS s")
    with pytest.raises(BadArgs):
        storage.write(df.select(df.id.alias("id", metadata={"encoding": "DELTA"})), str(tmp_path / "x"), codec="none")
    with pytest.raises(NotFound):
        storage.read(spark, str(tmp_path / "nothing"))
    path = tmp_path / "t"
    storage.write(df, str(path), codec="none", partitions=1, manifest=True)
    assert storage.verify(spark, str(path))["rows"] == 2000 and storage.peek(spark, str(path))["rows"] == 2000
    file = next(path.glob("*.parquet"))
    raw = bytearray(file.read_bytes())
    raw[len(raw) // 3] ^= 0xFF
    file.write_bytes(raw)
    (path / f".{file.name}.crc").unlink()
    spark.catalog.clearCache()
    with pytest.raises(Corrupt):
        storage.verify(spark, str(path))


def test_pushdown(spark, tmp_path):
    storage.write(spark.range(1000).selectExpr("id", "id AS other"), str(tmp_path / "p"))
    plan = storage.query(spark, str(tmp_path / "p"), [("id", ">", 990)], ["id"])._jdf.queryExecution().toString()
    assert "GreaterThan(id,990)" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_repair():
    raw = bytes(range(256)) * 9
    coded = bytearray(ecc.protect_bytes(raw))
    assert ecc.repair_bytes(bytes(coded)) == (raw, 0)
    n = len(coded) // ecc.SIZE
    for i in range(16 * n):  # a burst: sixteen bytes of every codeword
        coded[700 + i] ^= 1 + i % 255
    assert ecc.repair_bytes(bytes(coded)) == (raw, 16 * n)
    coded[700 + 16 * n] ^= 5
    with pytest.raises(Corrupt):
        ecc.repair_bytes(bytes(coded))


def test_many_damaged_codewords_are_repaired_together(monkeypatch):
    """Every value has errors; the steps of the decoder must not grow with the values, and each value keeps its own verdict."""
    calls = []
    monkeypatch.setattr(ecc, "mul", lambda *a, f=ecc.mul: calls.append(1) or f(*a))
    rng = random.Random(7)
    raws = [rng.randbytes(rng.choice([0, 5, 12, 215, 216, 700])) for _ in range(300)]
    coded, want = [], []
    for i, c in enumerate(map(bytearray, ecc.protect_all(raws))):
        n = len(c) // ecc.SIZE
        wrong = i % 21  # of one codeword; those of a value stand every n bytes
        for place in rng.sample(range(ecc.SIZE), wrong):
            c[place * n + n - 1] ^= rng.randrange(1, 256)
        coded.append(bytes(c))
        want.append((raws[i], wrong) if wrong <= 16 else (None, -1))
    ecc.repair_all(coded[:30])
    calls.clear()
    assert ecc.repair_all([*coded, None, b"", b"abc"]) == [*want, (None, 0), (None, -1), (None, -1)]
    assert len(calls) < len(coded)


@pytest.mark.parametrize("values,choice", [([3 * i for i in range(500)], "DELTA"), ([500 - i for i in range(500)], "DELTA"), ([42] * 400, "RLE"), ([i // 100 for i in range(900)], "RLE"), ([37 * i % 251 for i in range(1000)], "PLAIN"), ([None] * 5, "PLAIN"), ([2**63 - 1 - i for i in range(9)], "DELTA")])
def test_encoding_choice(spark, values, choice):
    df = spark.createDataFrame(list(enumerate(values)), "o long, v long").repartition(3)
    assert advisor.profile(df, "v", "o").choice() == choice


def test_cursors_and_shell(db, capsys, tmp_path):
    with db.cursor("SELECT name FROM people WHERE age < ? ORDER BY name", [40]) as c:
        assert c.fetchone().name == "alice" and [r.name for r in c.fetchmany(1)] == ["bob"] and len(c.fetchall()) == 1 and c.rowcount == 3

    async def names():
        return [r.name async for r in await db.cursor_async("SELECT name FROM people WHERE name LIKE '%b%'")]

    assert asyncio.run(names()) == ["bob"]
    out = io.StringIO()
    shell = Shell(db.spark, db.path, "csv", out=out)
    assert shell.run_all(["SELECT name, age FROM people WHERE age = 25", ".tables", ".quit", "SELECT x FROM y"]) == 0
    assert out.getvalue() == "name,age\nbob,25\ntable\npeople\n"
    script = tmp_path / "s.sql"
    script.write_text("-- note\nINSERT INTO people VALUES ('it''s', 7, NULL);\nSELECT name FROM people WHERE age = 7;")
    assert main([db.path, "-f", str(script), "-json"], db.spark) == 0 and capsys.readouterr().out == '{"name":"it\'s"}\n'
    assert main([db.path, "-c", "SELECT nothing FROM people"], db.spark) == 1


def test_a_table_made_in_a_transaction_appears_with_its_commit(spark, tmp_path):
    a, b = Database(spark, str(tmp_path)), Database(spark, str(tmp_path))
    a.exec("BEGIN")
    a.exec("CREATE TABLE t (x I32)")
    a.exec("INSERT INTO t VALUES (1)")
    assert [r.x for r in a.exec("SELECT * FROM t").collect()] == [1] and a.tables() == ["t"] and b.tables() == []
    a.exec("ROLLBACK")
    assert a.tables() == [] == Database(spark, str(tmp_path)).tables()
    a.exec("BEGIN")
    a.exec("CREATE TABLE t (x I32)")
    a.exec("INSERT INTO t VALUES (2)")
    a.exec("COMMIT")
    assert [r.x for r in Database(spark, str(tmp_path)).exec("SELECT * FROM t").collect()] == [2]


def test_a_commit_on_an_old_version_is_a_conflict(spark, tmp_path):
    a, b = Database(spark, str(tmp_path)), Database(spark, str(tmp_path))
    a.exec("CREATE TABLE t (x I32)")
    a.exec("INSERT INTO t VALUES (1)")
    a.exec("BEGIN")
    a.exec("INSERT INTO t VALUES (2)")
    b.exec("INSERT INTO t VALUES (3)")
    with pytest.raises(Conflict):
        a.exec("COMMIT")
    assert sorted(r.x for r in a.exec("SELECT * FROM t").collect()) == [1, 3]
    a.exec("INSERT INTO t VALUES (4)")
    a.exec("DROP TABLE t")
    a.exec("CREATE TABLE t (y I32)")
    assert b.exec("SELECT * FROM t").columns == ["y"]


def test_json_lines_of_the_shell_keep_nulls(spark):
    out = io.StringIO()
    show(spark.createDataFrame([(1, None)], "a int, b string"), out, "json")
    assert out.getvalue() == '{"a":1,"b":null}\n'


def test_damaged_files_are_put_right(spark, tmp_path):
    path = tmp_path / "t"
    storage.write(spark.range(5000).selectExpr("id", "concat('name ', id) AS name"), str(path), partitions=2, rs=True)
    want = storage.fingerprint(spark.read.parquet(str(path)))
    files = sorted(path.glob("*.parquet"))
    raw = bytearray(files[0].read_bytes())
    for i in range(100, 140):
        raw[i] ^= 0x5A
    for crc in path.glob(".*.crc"):
        crc.unlink()
    files[0].write_bytes(raw)
    assert ecc.repair_files(spark, str(path)) == 40 and ecc.repair_files(spark, str(path)) == 0
    assert storage.fingerprint(storage.read(spark, str(path))) == want
    assert storage.read_chunk(spark, str(path), 0).count() + storage.read_chunk(spark, str(path), 1).count() == 5000
    for crc in path.glob(".*.crc"):
        crc.unlink()
    files[1].write_bytes(bytes(len(files[1].read_bytes())))
    with pytest.raises(Corrupt):
        ecc.repair_files(spark, str(path))
