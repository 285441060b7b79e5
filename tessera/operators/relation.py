"""Relations as a fluent DataFrame wrapper, for callers who build plans
without SQL text. Each method is a composition of built-in operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.parser import SqlError
from ..plans.render import quote


def _all(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


class Relation:
    def __init__(self, df: DataFrame):
        self.df = df

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    # ------------------------------------------------------ project and filter
    def where(self, cond) -> Relation:
        """Rows for which the condition is TRUE."""
        return Relation(self.df.where(cond))

    def select(self, *cols) -> Relation:
        return Relation(self.df.select(*cols))

    def rename(self, *names: str) -> Relation:
        """A correlation name's column list."""
        return Relation(self.df.toDF(*names))

    def distinct(self) -> Relation:
        return Relation(self.df.distinct())

    def order(self, *keys: str | tuple[str, bool]) -> Relation:
        """Sorts by (column, ascending): nulls after others, or before them descending."""
        out = []
        for k in keys:
            name, up = (k, True) if isinstance(k, str) else k
            out.append(F.col(quote(name)).asc_nulls_last() if up else F.col(quote(name)).desc_nulls_first())
        return Relation(self.df.orderBy(*out))

    # ------------------------------------------------------------------- joins
    def common(self, other: Relation) -> list[str]:
        low = {c.lower() for c in other.columns}
        return [c for c in self.columns if c.lower() in low]

    def natural_join(self, other: Relation, how: str = "inner") -> Relation:
        """Joins on the common columns, shown once and first; without any it is
        the product."""
        keys = self.common(other)
        return Relation(self.df.join(other.df, keys, how) if keys else self.df.crossJoin(other.df))

    def join(self, other: Relation, on=None, using: Sequence[str] = (), how: str = "inner") -> Relation:
        if using:
            return Relation(self.df.join(other.df, list(using), how))
        return Relation(self.df.crossJoin(other.df) if on is None else self.df.join(other.df, on, how))

    def union_join(self, other: Relation) -> Relation:
        """Both relations' rows, each padded with nulls for the other's columns."""
        pad = lambda names: [F.lit(None).alias(n) for n in names]
        left = self.df.select("*", *pad(other.columns))
        right = other.df.select(*pad(self.columns), *[F.col(quote(c)) for c in other.columns])
        return Relation(left.union(right))

    def semi(self, other: Relation, on) -> Relation:
        return Relation(self.df.join(other.df, on, "left_semi"))

    def anti(self, other: Relation, on) -> Relation:
        return Relation(self.df.join(other.df, on, "left_anti"))

    # --------------------------------------------------------- predicates as joins
    def match(self, cols: Sequence[str], other: Relation, keys: Sequence[str], mode: str = "SIMPLE", unique: bool = False) -> Relation:
        """Rows of which (cols) MATCH [UNIQUE] [PARTIAL | FULL] (keys of other).

        SIMPLE and FULL become an equi-join to the distinct keys, aggregated
        first. PARTIAL compares the columns that are not null: one equi-join for
        each null pattern, instead of comparing all pairs."""
        left = [F.col("l." + quote(c)) for c in cols]
        names = [f"_k{i}" for i in range(len(cols))]
        base = other.df.select(*[F.col(quote(k)).alias(n) for k, n in zip(keys, names)])
        some, every = reduce(lambda a, b: a | b, [c.isNull() for c in left]), _all([c.isNull() for c in left])

        def found(df: DataFrame, used: list[int]) -> DataFrame:
            counted = base.groupBy(*[names[i] for i in used]).agg(F.count(F.lit(1)).alias("_n"))
            if unique:
                counted = counted.where("_n = 1")
            return df.alias("l").join(counted, _all([left[i] == F.col(names[i]) for i in used]), "left_semi")

        d = self.df.alias("l")
        everything = list(range(len(cols)))
        if mode == "SIMPLE":
            return Relation(d.where(some).unionByName(found(self.df, everything)))
        out = d.where(every)
        if mode == "FULL":
            return Relation(out.unionByName(found(self.df, everything)))
        for pattern in range(1, 1 << len(cols)):  # the columns that are not null
            used = [i for i in everything if pattern >> i & 1]
            part = self.df.alias("l").where(_all([left[i].isNotNull() if i in used else left[i].isNull() for i in everything]))
            out = out.unionByName(found(part, used))
        return Relation(out)

    def is_unique(self, cols: Sequence[str] | None = None) -> bool:
        """Whether no two rows agree on (non-null) columns."""
        names = [quote(c) for c in cols or self.columns]
        return self.df.where(_all([F.col(n).isNotNull() for n in names])).groupBy(*names).count().where("count > 1").isEmpty()

    def compare_all(self, value: str, op: str, other: Relation, column: str) -> Relation:
        """Rows with value op ALL (column of other): one aggregate, joined as a
        single row; its fields decide under three-valued logic."""
        c = F.col("_s")
        s = other.df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count(quote(column)).alias("k"), F.min(quote(column)).alias("lo"), F.max(quote(column)).alias("hi")).alias("_s"))
        x = F.col(quote(value))
        holds = {"=": (x == c["lo"]) & (x == c["hi"]), "<>": None, "<": x < c["lo"], "<=": x <= c["lo"], ">": x > c["hi"], ">=": x >= c["hi"]}[op]
        if holds is None:
            raise SqlError("<> ALL is an anti join: use anti()")
        return Relation(self.df.join(F.broadcast(s)).where((c["n"] == 0) | (holds & (c["k"] == c["n"]))).drop("_s"))  # broadcast of one row

    # ------------------------------------------------------------ set operations
    def set_operation(self, op: str, other: Relation, all_rows: bool = False, corresponding: bool = False, by: Sequence[str] = ()) -> Relation:
        """UNION, EXCEPT or INTERSECT, by position or by CORRESPONDING columns."""
        a, b = self.df, other.df
        if corresponding or by:
            names = list(by) or self.common(other)
            if not names:
                raise SqlError("CORRESPONDING without common columns")
            a, b = a.select(*map(quote, names)), b.select(*map(quote, names))
        if len(a.columns) != len(b.columns):
            raise SqlError(f"{op}: the sides differ in degree")
        if op == "UNION":
            both = a.union(b)
            return Relation(both if all_rows else both.distinct())
        if op == "EXCEPT":
            return Relation(a.exceptAll(b) if all_rows else a.subtract(b))
        return Relation(a.intersectAll(b) if all_rows else a.intersect(b))

    # --------------------------------------------------------------- aggregation
    def group(self, keys: Sequence[str], aggregates: dict[str, Column], having: str | Column | None = None) -> Relation:
        g = self.df.groupBy(*map(quote, keys)) if keys else self.df.groupBy()
        out = g.agg(*[c.alias(n) for n, c in aggregates.items()])
        return Relation(out.where(having) if having is not None else out)
