"""DataFrame-level operators against their SQL forms or by hand."""

import itertools

import pytest
from pyspark.sql import functions as F

from tessera.functions import overlaps, position, row_compare, trim
from tessera.operators.relation import Relation


def rows(r):
    return sorted(map(tuple, r.df.collect()), key=repr)


@pytest.fixture(scope="module")
def pair(spark):
    v = [None, 1, 2]
    left = spark.createDataFrame([(a, b) for a in v for b in v], "a int, b int")
    right = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, None)], "x int, y int")
    return Relation(left), Relation(right)


@pytest.mark.parametrize("mode", ["SIMPLE", "PARTIAL", "FULL"])
@pytest.mark.parametrize("unique", [False, True])
def test_match(pair, mode, unique):
    left, right = pair
    want = []
    for r in rows(left):
        keys = rows(right)
        if mode == "SIMPLE" and None in r or r == (None, None):
            want.append(r)
            continue
        if mode == "FULL" and None in r:
            continue
        n = sum(all(p is None or p == q for p, q in zip(r, k)) for k in keys)
        if n == 1 if unique else n:
            want.append(r)
    assert rows(left.match(["a", "b"], right, ["x", "y"], mode, unique)) == sorted(want, key=repr)


def test_union_join_and_set_operations(spark):
    a = Relation(spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, s string"))
    b = Relation(spark.createDataFrame([(2, 9)], "k int, n int"))
    assert len(a.union_join(b).columns) == 4 and len(rows(a.union_join(b))) == 4
    assert rows(a.set_operation("EXCEPT", b, corresponding=True)) == [(1,)]
    assert rows(a.set_operation("EXCEPT", b, all_rows=True, by=["k"])) == [(1,), (2,)]
    assert rows(a.set_operation("INTERSECT", b, corresponding=True)) == [(2,)]
    assert a.natural_join(b).columns == ["k", "s", "n"]
    assert not a.is_unique(["k"]) and b.is_unique()


def test_order_places_nulls(spark):
    r = Relation(spark.createDataFrame([(1,), (None,), (2,)], "k int"))
    assert [x[0] for x in r.order("k").df.collect()] == [1, 2, None]
    assert [x[0] for x in r.order(("k", False)).df.collect()] == [None, 2, 1]


@pytest.mark.parametrize("op", ["=", "<>", "<", "<=", ">", ">="])
def test_row_compare(spark, op):
    v = [None, 1, 2]
    d = spark.createDataFrame(list(itertools.product(v, repeat=4)), "a int, b int, c int, d int")
    got = d.select("*", row_compare(op, [F.col("a"), F.col("b")], [F.col("c"), F.col("d")]).alias("r")).collect()
    for r in got:
        if None in (r.a, r.b, r.c, r.d):
            continue
        x, y = (r.a, r.b), (r.c, r.d)
        assert r.r == {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def test_scalars(spark):
    d = spark.createDataFrame([("  ab ", "b", 1, 5, 4, 9)], "s string, t string, p int, q int, r int, u int")
    got = d.select(trim(F.col("s")), trim(F.col("s"), "LEADING"), position(F.col("t"), F.col("s")), overlaps(F.col("p"), F.col("q"), F.col("u"), F.col("r"))).first()
    assert got[:] == ("ab", "ab ", 4, True)


def test_compare_all(spark):
    r = Relation(spark.createDataFrame([(1,), (5,), (None,)], "x int"))
    o = Relation(spark.createDataFrame([(2,), (3,)], "y int"))
    assert rows(r.compare_all("x", ">", o, "y")) == [(5,)]
    assert len(rows(r.compare_all("x", ">", o.where("y > 9"), "y"))) == 3
