"""The session against DuckDB on the registered queries, and by hand."""

import itertools
import os

import duckdb
import pytest

from tessera import queries as Q
from tessera.plans.parser import SqlError
from tessera.session import Session

DATA = "/root/testdata/sf0.001"


def canonical(rows):
    def one(v):
        return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_registered(spark, duck, name):
    got = Q.QUERIES[name](spark, DATA)
    r = duck.execute(Q.ORACLES[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(got.columns)
    assert canonical(got.select(*[f"`{c}`" for c in cols]).collect()) == canonical(r.fetchall())


@pytest.fixture
def s(spark):
    s = Session(spark)
    s.run_script(
        """
        CREATE TABLE parent (id INTEGER PRIMARY KEY, name VARCHAR(20));
        INSERT INTO parent VALUES (1, 'a'), (2, 'b'), (3, NULL);
        COMMIT
        """
    )
    return s


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


VALUES = [None, 1, 2, 3]


@pytest.mark.parametrize("which", ["ALL", "ANY"])
def test_quantified_comparisons_by_brute_force(spark, which):
    """All sets of up to two values, all left sides, all operators, as one query each."""
    s = Session(spark)
    sets = [c for n in range(3) for c in itertools.combinations_with_replacement(VALUES, n)]
    s.register("v", spark.createDataFrame([(i, x) for i, c in enumerate(sets) for x in c], "g int, y int"))
    s.register("q", spark.createDataFrame([(i, x) for i in range(len(sets)) for x in VALUES], "g int, x int"))
    ops = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b}
    for op, f in ops.items():
        got = s.query(f"SELECT g, x, CASE WHEN x {op} {which} (SELECT y FROM v WHERE v.g = q.g) THEN 1 WHEN NOT (x {op} {which} (SELECT y FROM v WHERE v.g = q.g)) THEN 0 END AS r FROM q" if op not in ("=", "<>") else f"SELECT g, x, 1 AS r FROM q WHERE x {op} {which} (SELECT y FROM v WHERE v.g = q.g)")
        want = []
        for i, c in enumerate(sets):
            for x in VALUES:
                parts = [None if x is None or y is None else f(x, y) for y in c]
                if which == "ALL":
                    t = False if False in parts else None if None in parts else True
                else:
                    t = True if True in parts else None if None in parts else False
                if op in ("=", "<>"):
                    want += [(i, x, 1)] if t else []
                else:
                    want.append((i, x, None if t is None else int(t)))
        assert rows(got) == sorted(want, key=repr), op


def test_star_after_using_and_natural(spark):
    s = Session(spark)
    s.run_script("CREATE TABLE l (a INTEGER, k INTEGER); CREATE TABLE r (b INTEGER, k INTEGER); INSERT INTO l VALUES (1, 7), (2, 8); INSERT INTO r VALUES (5, 7), (6, 9)")
    assert s.query("SELECT * FROM l NATURAL JOIN r").columns == ["k", "a", "b"]
    assert rows(s.query("SELECT * FROM l FULL JOIN r USING (k)")) == [(7, 1, 5), (8, 2, None), (9, None, 6)]
    assert rows(s.query("l LEFT JOIN r ON l.k = r.k")) == [(1, 7, 5, 7), (2, 8, None, None)]


@pytest.mark.parametrize("sql", ["SELECT k FROM l, r", "SELECT l.a FROM l x", "SELECT l.* FROM l AS x", "SELECT nothing FROM l", "SELECT * FROM l UNION SELECT a FROM l", "SELECT a FROM", "SELECT 1 1"])
def test_errors(spark, sql):
    s = Session(spark)
    s.run_script("CREATE TABLE l (a INTEGER, k INTEGER); CREATE TABLE r (b INTEGER, k INTEGER)")
    with pytest.raises(Exception):  # noqa: B017
        s.query(sql)


def test_three_valued_predicates(s):
    assert rows(s.query("SELECT id FROM parent WHERE name = 'a' IS UNKNOWN")) == [(3,)]
    assert rows(s.query("SELECT id FROM parent WHERE NOT (name = 'a')")) == [(2,)]
    assert rows(s.query("SELECT id FROM parent WHERE (name, id) <> ('a', 2)")) == [(1,), (2,), (3,)]


def test_parameters(s):
    assert rows(s.query("SELECT id FROM parent WHERE id > ? AND name = ?", [0, "b"])) == [(2,)]


def test_literal_quotes_and_backslashes(s):
    assert s.query("SELECT 'it''s' AS a, 'c:\\d' AS b FROM parent WHERE id = 1").first()[:] == ("it's", "c:\\d")


def test_insert_defaults_and_degree(s):
    s.run_script("CREATE TABLE d (a INTEGER DEFAULT 5, b VARCHAR(5) DEFAULT 'x'); INSERT INTO d DEFAULT VALUES; INSERT INTO d (b) VALUES ('y')")
    assert rows(s.query("SELECT * FROM d")) == [(5, "x"), (5, "y")]
    with pytest.raises(SqlError):
        s.execute("INSERT INTO d VALUES (1)")


@pytest.mark.parametrize("bad", ["INSERT INTO parent VALUES (1, 'again')", "INSERT INTO parent VALUES (NULL, 'x')", "UPDATE parent SET id = 2"])
def test_primary_key(s, bad):
    with pytest.raises(SqlError):
        s.execute(bad)
    assert len(rows(s.query("SELECT * FROM parent"))) == 3  # the statement left nothing behind


def test_check_lets_unknown_pass(s):
    s.run_script("CREATE TABLE c (x INTEGER CHECK (x > 0)); INSERT INTO c VALUES (1), (NULL)")
    with pytest.raises(SqlError):
        s.execute("INSERT INTO c VALUES (0)")


ACTIONS = {"NO ACTION": None, "CASCADE": "cascade", "SET NULL": "null", "SET DEFAULT": "default"}


@pytest.mark.parametrize("action", ACTIONS)
@pytest.mark.parametrize("event", ["DELETE", "UPDATE"])
def test_referential_actions(s, event, action):
    s.run_script(f"CREATE TABLE child (id INTEGER PRIMARY KEY, pid INTEGER DEFAULT 3 REFERENCES parent ON {event} {action}); INSERT INTO child VALUES (10, 1), (11, 2), (12, NULL)")
    change = "DELETE FROM parent WHERE id = 1" if event == "DELETE" else "UPDATE parent SET id = 9 WHERE id = 1"
    if action == "NO ACTION":
        with pytest.raises(SqlError):
            s.execute(change)
        assert (1,) in rows(s.query("SELECT id FROM parent"))
        return
    s.execute(change)
    first = {"CASCADE": [] if event == "DELETE" else [(10, 9)], "SET NULL": [(10, None)], "SET DEFAULT": [(10, 3)]}[action]
    assert rows(s.query("SELECT * FROM child")) == sorted([*first, (11, 2), (12, None)], key=repr)


def test_grandchildren_and_self_reference(s):
    s.run_script(
        """
        CREATE TABLE child (id INTEGER PRIMARY KEY, pid INTEGER REFERENCES parent ON DELETE CASCADE);
        CREATE TABLE grandchild (id INTEGER PRIMARY KEY, pid INTEGER REFERENCES child ON DELETE SET NULL);
        INSERT INTO child VALUES (10, 1), (11, 2); INSERT INTO grandchild VALUES (100, 10), (101, 11);
        DELETE FROM parent WHERE id = 1
        """
    )
    assert rows(s.query("SELECT * FROM grandchild")) == [(100, None), (101, 11)]
    s.run_script("CREATE TABLE tree (id INTEGER PRIMARY KEY, up INTEGER REFERENCES tree ON DELETE CASCADE); INSERT INTO tree VALUES (1, NULL), (2, 1), (3, 2), (4, NULL); DELETE FROM tree WHERE id = 1")
    assert rows(s.query("SELECT id FROM tree")) == [(4,)]


def test_match_partial_foreign_key(s):
    s.run_script("CREATE TABLE p2 (a INTEGER, b INTEGER, PRIMARY KEY (a, b)); INSERT INTO p2 VALUES (1, 1); CREATE TABLE c2 (a INTEGER, b INTEGER, FOREIGN KEY (a, b) REFERENCES p2 MATCH PARTIAL); INSERT INTO c2 VALUES (1, NULL), (NULL, NULL)")
    with pytest.raises(SqlError):
        s.execute("INSERT INTO c2 VALUES (2, NULL)")


def test_deferred_constraints(s):
    s.run_script("CREATE TABLE k (id INTEGER, pid INTEGER, CONSTRAINT later FOREIGN KEY (pid) REFERENCES parent INITIALLY DEFERRED); INSERT INTO k VALUES (1, 77); INSERT INTO parent VALUES (77, 'z'); COMMIT; INSERT INTO k VALUES (2, 78)")
    with pytest.raises(SqlError):
        s.execute("COMMIT")
    assert rows(s.query("SELECT id FROM k")) == [(1,)]


def test_rollback_and_read_only(s):
    s.run_script("DELETE FROM parent; ROLLBACK")
    assert len(rows(s.query("SELECT * FROM parent"))) == 3
    s.execute("SET TRANSACTION READ ONLY")
    with pytest.raises(SqlError):
        s.execute("DELETE FROM parent")


def test_view_check_option(s):
    s.run_script("CREATE VIEW low AS SELECT id, name FROM parent WHERE id < 10 WITH CHECK OPTION; INSERT INTO low VALUES (4, 'd')")
    with pytest.raises(SqlError):
        s.execute("INSERT INTO low VALUES (40, 'd')")
    assert rows(s.query("SELECT id FROM low")) == [(1,), (2,), (3,), (4,)]


def test_grants(s):
    s.run_script("CREATE USER bob; GRANT SELECT ON parent TO bob")
    s.user = "bob"
    assert s.query("SELECT * FROM parent").count() == 3
    with pytest.raises(SqlError):
        s.execute("DELETE FROM parent")


def test_alter_and_drop(s):
    s.run_script("ALTER TABLE parent ADD COLUMN x INTEGER DEFAULT 8; ALTER TABLE parent DROP COLUMN name; CREATE TABLE ch (pid INTEGER REFERENCES parent)")
    assert rows(s.query("SELECT * FROM parent")) == [(1, 8), (2, 8), (3, 8)]
    with pytest.raises(SqlError):
        s.execute("DROP TABLE parent RESTRICT")
    s.execute("DROP TABLE parent CASCADE")


def test_functions_and_procedures(s):
    s.run_script(
        """
        CREATE FUNCTION twice(a INTEGER) RETURNS INTEGER RETURN a * 2;
        CREATE FUNCTION top() RETURNS INTEGER BEGIN DECLARE r INTEGER; SELECT max(id) INTO r FROM parent; IF r > 2 THEN RETURN r; ELSE RETURN 0; END IF; END;
        CREATE PROCEDURE walk(OUT total INTEGER)
        BEGIN
          DECLARE a INTEGER; DECLARE c CURSOR FOR SELECT id FROM parent ORDER BY id;
          DECLARE ret CURSOR WITH RETURN FOR SELECT name FROM parent;
          SET total = 0; OPEN c; FETCH c INTO a;
          WHILE SQLSTATE <> '02000' DO SET total = total + a; FETCH c INTO a; END WHILE;
          CLOSE c; OPEN ret;
        END
        """
    )
    assert rows(s.query("SELECT twice(id) FROM parent")) == [(2,), (4,), (6,)]
    assert s.query("VALUES (top())").first()[0] == 3
    results = s.run_script("DECLARE t INTEGER; CALL walk(t)")[-1]
    assert s._variable("t")[1] == 6 and results[0].count() == 3


def test_a_loop_without_progress_is_stopped(s):
    s.execute("CREATE PROCEDURE idle() BEGIN DECLARE n INTEGER DEFAULT 4; WHILE n > 1 DO SET n = 4; END WHILE; END")
    with pytest.raises(SqlError):
        s.execute("CALL idle()")


def test_a_long_loop_ends(s):
    s.execute("CREATE FUNCTION total(top INTEGER) RETURNS INTEGER BEGIN DECLARE i INTEGER DEFAULT 0; DECLARE t INTEGER DEFAULT 0; REPEAT SET i = i + 1; SET t = t + i; UNTIL i >= top END REPEAT; RETURN t; END")
    assert s.query("VALUES (total(12000))").first()[0] == 12000 * 12001 // 2
    assert rows(s.query("SELECT total(id) FROM parent")) == [(1,), (3,), (6,)]


def test_scrolling_cursor_and_labels(s):
    s.run_script("DECLARE x INTEGER; DECLARE c SCROLL CURSOR FOR SELECT id FROM parent ORDER BY id; OPEN c; FETCH LAST FROM c INTO x")
    assert s._variable("x")[1] == 3
    s.execute("FETCH ABSOLUTE 2 FROM c INTO x")
    assert s._variable("x")[1] == 2
    s.run_script("outer: LOOP SET x = x + 1; IF x > 5 THEN LEAVE outer; END IF; ITERATE outer; END LOOP outer")
    assert s._variable("x")[1] == 6


def test_compat_habits(spark):
    s = Session(spark, compat=True)
    s.run_script("CREATE TABLE t (n INTEGER, c VARCHAR(9)); INSERT INTO t VALUES (1, 'Red'), (NULL, 'red  '), (2, 'Blue')")
    assert s.query("SELECT * FROM t WHERE c = 'RED'").count() == 2
    assert s.query("SELECT count(n) AS k, count(*) AS m FROM t").first()[:] == (3, 3)
    assert s.query("SELECT c FROM t WHERE c LIKE 'r%'").count() == 2
    assert s.query("SELECT 1 AS x FROM t WHERE n = 1 AND (1, 2) < (1, 3)").count() == 0
    assert s.query("SELECT n FROM t UNION SELECT n + 1 FROM t").count() == 4
    with pytest.raises(SqlError):
        s.query("SELECT n FROM t UNION SELECT CAST(n AS FLOAT) FROM t")
    assert Session(spark).query("VALUES (1) UNION ALL VALUES (2.5)").count() == 2


def test_backup(s, tmp_path):
    s.execute(f"BACKUP CATALOG TO '{tmp_path}/b'")
    assert s.spark.read.parquet(f"{tmp_path}/b/parent.parquet").count() == 3


def test_information_schema(s):
    s.execute("CREATE TABLE ch (pid INTEGER CONSTRAINT to_parent REFERENCES parent ON DELETE CASCADE)")
    got = s.query("SELECT constraint_name, delete_rule FROM INFORMATION_SCHEMA.referential_constraints")
    assert rows(got) == [("to_parent", "CASCADE")]
    for name in "tables columns schemata users routines sequences key_column_usage table_constraints check_constraints table_privileges column_privileges domains parameters type_info".split():
        s.query(f"SELECT * FROM INFORMATION_SCHEMA.{name}").count()


def test_whole_tables_are_compared(spark):
    """These queries keep every row of the table they read."""
    import duckdb

    from tessera.queries import ORACLES, QUERIES

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("lineitem", "orders", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    whole = {"project_arith": "lineitem", "fn_cast": "lineitem", "udf_sql": "lineitem", "join_inner_using": "orders JOIN customer ON o_custkey = c_custkey", "view_expand": "(SELECT DISTINCT o_custkey FROM orders)"}
    for name, rows in whole.items():
        n = con.execute(f"SELECT count(*) FROM {rows}").fetchone()[0]
        assert QUERIES[name](spark, folder).count() == n == len(con.execute(ORACLES[name]).fetchall()), name


def test_privileges_hold(s):
    s.run_script("CREATE USER bob PASSWORD 'x'; CREATE USER eve; CREATE TABLE pay (who INTEGER, sum_ INTEGER); INSERT INTO pay VALUES (1, 9); GRANT SELECT (who), UPDATE (who) ON pay TO bob; COMMIT")
    for wrong in ("CONNECT TO 'db' USER 'bob'", "CONNECT TO 'db' USER 'bob' PASSWORD 'y'", "CONNECT TO 'db' USER 'nobody'"):
        with pytest.raises(SqlError):
            s.execute(wrong)
    s.execute("CONNECT TO 'db' USER 'bob' PASSWORD 'x'")
    assert rows(s.query("SELECT who FROM pay")) == [(1,)]
    for refused in ("SELECT sum_ FROM pay", "UPDATE pay SET sum_ = 1", "DELETE FROM pay", "INSERT INTO pay VALUES (1, 1)", "GRANT DELETE ON pay TO bob", "GRANT SELECT (who) ON pay TO eve", "DROP TABLE pay", "ALTER TABLE pay ADD COLUMN z INTEGER", "CREATE USER mal", "ALTER USER eve SET PASSWORD 'z'"):
        with pytest.raises(Exception):
            out = s.execute(refused)
            if out is not None and not isinstance(out, int):
                out.collect()
    s.execute("UPDATE pay SET who = 5")
    s.execute("ALTER USER bob SET PASSWORD 'new'")
    s.run_script("COMMIT; DISCONNECT; GRANT SELECT ON pay TO bob WITH GRANT OPTION; CONNECT TO 'db' USER 'bob' PASSWORD 'new'; GRANT SELECT ON pay TO eve; COMMIT; CONNECT TO 'db' USER 'eve'")
    assert s.query("SELECT sum_ FROM pay").count() == 1
    s.execute("DISCONNECT")
    with pytest.raises(SqlError):
        s.execute("REVOKE SELECT ON pay FROM bob RESTRICT")
    s.run_script("REVOKE SELECT ON pay FROM bob CASCADE; CONNECT TO 'db' USER 'eve'")
    with pytest.raises(SqlError):
        s.query("SELECT who FROM pay")


def test_catalogs(s):
    s.run_script("CREATE CATALOG other; COMMIT")
    assert s.query("SELECT * FROM parent").count() == 3
    s.run_script("OPEN CATALOG other; CREATE TABLE only_here (a INTEGER); INSERT INTO only_here VALUES (1)")
    with pytest.raises(SqlError):
        s.query("SELECT * FROM parent")
    s.execute("CLOSE CATALOG other")
    assert s.query("SELECT * FROM parent").count() == 3 and s.query("SELECT * FROM other.s.only_here").count() == 1
    s.execute("DROP CATALOG other")
    with pytest.raises(SqlError):
        s.query("SELECT * FROM other.s.only_here")


def test_sequences_draw_for_each_row(s):
    s.run_script("CREATE SEQUENCE q STARTING AT 7")
    s.explain("SELECT NEXT_SEQUENCE(q) FROM parent")
    assert rows(s.query("SELECT NEXT_SEQUENCE(q) * 10 + 0 AS a FROM parent")) == [(70,), (80,), (90,)]
    assert len({x for r in s.query("SELECT NEXT_SEQUENCE(q), NEXT_SEQUENCE(q), LATEST_SEQUENCE(q) FROM parent").collect() for x in r}) == 6
    assert s.query("VALUES (NEXT_SEQUENCE(q))").first()[0] == 16


def test_plans_without_nested_loops(spark):
    """NOT IN and MATCH PARTIAL neither broadcast nor loop once Spark may not broadcast by size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("anti_not_in", "anti_not_in_subset", "anti_not_in_null", "match_partial", "match_unique"):
            plan = Q.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
            assert "Broadcast" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_inserts_append_parts(s):
    for i in range(5):
        s.execute(f"INSERT INTO parent (id) VALUES ({100 + i})")
    assert len(s.table("parent").parts) >= 5 and s.query("SELECT * FROM parent").count() == 8
    with pytest.raises(SqlError):
        s.execute("INSERT INTO parent (id) VALUES (101)")
    s.execute("GARBAGE COLLECT CATALOG db1")
    assert len(s.table("parent").parts) == 1 and s.query("SELECT * FROM parent").count() == 8


def test_administration(s):
    s.run_script("CREATE INDEX by_id ON parent (id); REBUILD INDEX by_id; CANCEL; KILL 3")
    assert s.query("SELECT * FROM parent").count() == 3
    for name in "sysCatalog sysSchema sysAuth sysTable sysColumn sysConstraint sysConstraintColumn sysDomain sysIndex sysIndexColumn sysRoutine sysGenerator sysTablePrivilege sysTableColumnPrivilege sysTransaction sysServer sysStatus".split():
        assert s.query(f"SELECT * FROM CATALOG_DEFINITION_SCHEMA.{name}").columns
    s.execute("SHUTDOWN")


def test_client(spark):
    from tessera import client

    with client.connect(spark, DATA) as con:
        cur = con.cursor().execute("SELECT r_regionkey, r_name FROM region WHERE r_regionkey > ? ORDER BY 1", (2,))
        assert [d[0] for d in cur.description] == ["r_regionkey", "r_name"]
        assert cur.fetchone()[0] == 3 and len(cur.fetchmany(5)) == 1 and cur.fetchone() is None
        cur.execute("CREATE TABLE t (a INTEGER, b VARCHAR(9))")
        assert cur.executemany("INSERT INTO t VALUES (?, ?)", [(1, "x"), (2, None)]).rowcount == 2
        assert sorted(cur.execute("SELECT a, b FROM t")) == [(1, "x"), (2, None)]
        cur.execute("CREATE PROCEDURE both(IN n INTEGER) BEGIN DECLARE c CURSOR WITH RETURN FOR SELECT a FROM t WHERE a >= n; OPEN c; END")
        cur.callproc("both", (2,))
        assert cur.fetchall() == [(2,)] and cur.nextset() is None
    with pytest.raises(SqlError):
        con.cursor()
