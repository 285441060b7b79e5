"""A SQL-92 session on Spark: catalog, queries, table changes, constraints,
transactions and routines.

Tables are immutable DataFrame versions: a change builds the next version as
a plan over the current one, settles it as Parquet in the shared folder and
swaps it in. Transactions and statement atomicity are swaps of the table map.
Constraints are validation queries that run after a statement or at COMMIT.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.parser import Parser, SqlError, nodes, rewrite
from .plans.render import SUBQUERIES, Renderer, has_aggregate, quote, spark_type, string
from .plans.statements import StatementParser
from .psm import Routines, literal
from .sources import store

_serial = count(1)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@dataclass(frozen=True)
class Table:
    name: str
    df: DataFrame
    columns: tuple = ()  # dicts: name, type, default, not_null
    constraints: tuple = ()
    owner: str = "DEFAULT"
    schema: str = "DEFAULT_SCHEMA"
    temporary: bool = False
    keep_rows: bool = True
    parts: tuple = ()  # folders whose rows ``df`` reads, if it reads nothing else


@dataclass
class View:
    query: tuple
    columns: list | None
    check: str | None = None
    owner: str = "DEFAULT"


PRIVILEGES = ("SELECT", "INSERT", "UPDATE", "DELETE", "REFERENCES")
MAX_PARTS = 64  # of a table: more are written anew as one


@dataclass(frozen=True)
class Grant:
    """``columns`` empty: on the whole object. ``option``: may be passed on."""

    grantee: str
    privilege: str
    target: str
    columns: tuple
    option: bool
    grantor: str


@dataclass
class Catalog:
    files: dict[str, str] = field(default_factory=dict)  # tables not read yet: the folder each lies in
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, View] = field(default_factory=dict)
    domains: dict = field(default_factory=dict)
    sequences: dict = field(default_factory=dict)
    schemas: dict = field(default_factory=lambda: {"default_schema": "DEFAULT"})
    indexes: dict = field(default_factory=dict)
    routines: dict = field(default_factory=dict)
    users: dict = field(default_factory=lambda: {"default": None})
    grants: set = field(default_factory=set)

    def copy(self) -> Catalog:
        return Catalog(**{k: v.copy() for k, v in self.__dict__.items() if k != "sequences"} | {"sequences": self.sequences})  # sequences outlive a rollback


class Session(Routines):
    """``compat`` keeps the older engine's habits: text compared without case
    and trailing blanks, AVG over all rows of a group, COUNT(x) of all rows,
    rows compared item by item."""

    def __init__(self, spark: SparkSession, compat: bool = False, user: str = "DEFAULT"):
        super().__init__()
        self.spark, self.compat, self.user = spark, compat, user
        self.schema, self.sqlstate = "DEFAULT_SCHEMA", "00000"
        self.prefix = f"s{os.getpid()}_{next(_serial)}_"
        self.catalog, self.catalogs = "DB1", {"db1": None}  # the open one is self.now
        self.now = Catalog()
        self.saved = self.now.copy()
        self.deferred: dict[str, bool] = {}  # SET CONSTRAINTS of this transaction
        self.touched: set[str] = set()
        self.read_only, self.drawing = False, True
        self.known: dict[int, str] = {}
        self.renderer = Renderer(self._columns, self._view, self._resolve, compat, self._domain, literal)

        self.renderer.storage = self._storage

    # --------------------------------------------------------------- catalog
    def load(self, folder: str, names=TABLES) -> Session:
        """Makes ``folder/name.parquet`` known for each name; a file is opened when a statement names its table."""
        self.now.files |= {n.lower(): folder for n in names}
        self.saved = self.now.copy()
        return self

    def everything(self) -> dict[str, Table]:
        """All tables of the catalog, those not read yet included."""
        for n in list(self.now.files):
            self.table(n)
        return self.now.tables

    def register(self, name: str, df: DataFrame, owner: str | None = None, parts: tuple = ()) -> None:
        if self.compat:
            df = df.select(*[F.expr(f"{quote(c)} COLLATE UTF8_LCASE_RTRIM").alias(c) if t == "string" else F.col(quote(c)) for c, t in df.dtypes])
        self.now.tables[name.lower()] = Table(name, df, tuple({"name": c, "type": None, "default": None, "not_null": False} for c in df.columns), owner=owner or self.user, schema=self.schema, parts=parts)

    def exists(self, key: str) -> bool:
        return key in self.now.tables or key in self.now.files

    def table(self, name) -> Table:
        if isinstance(name, tuple) and len(name) > 2 and name[-3].lower() != self.catalog.lower():
            other = self.catalogs.get(name[-3].lower())
            if other is None or name[-1].lower() not in other.tables:
                raise SqlError(f"no table {'.'.join(name)}")
            return other.tables[name[-1].lower()]
        name = name[-1] if isinstance(name, tuple) else name
        key = name.lower()
        if key not in self.now.tables and key in self.now.files:
            folder = self.now.files.pop(key)
            self.register(key, store.read_table(self.spark, folder, key), "DEFAULT", () if self.compat else (store.table_path(folder, key),))
            for c in (self.saved,):  # it was there before this transaction
                if c.files.pop(key, None):
                    c.tables[key] = self.now.tables[key]
        if key not in self.now.tables:
            raise SqlError(f"no table {name}")
        return self.now.tables[key]

    def _view(self, parts) -> str:
        """What Spark calls a table, or the text of a view. Columns that the
        user holds no privilege on are out of sight."""
        name = parts[-1].lower()
        if len(parts) > 1 and parts[-2].lower() in ("information_schema", "catalog_definition_schema"):
            from .metadata import relation

            df = relation(self, name, parts[-2].lower())
        elif name in self.now.views and not self.exists(name):
            v = self.now.views[name]
            seen = self._allowed("SELECT", name, v.owner, None)
            with self._acting_as(v.owner):
                text = self.renderer.query(v.query)
            shown = f"(SELECT * FROM ({text})" + (f" AS v({', '.join(map(quote, v.columns))}))" if v.columns else ")")
            return shown if seen is None else f"(SELECT {', '.join(map(quote, seen))} FROM {shown})"
        else:
            t = self.table(parts)
            seen = self._allowed("SELECT", name, t.owner, None)
            df = t.df if seen is None else t.df.select(*[quote(_named(t, c)) for c in seen])
            if seen is not None:
                name += "_" + "_".join(seen)
        return self._named_view(name, df)

    def _named_view(self, name: str, df: DataFrame) -> str:
        key = f"{name}_{id(df)}"
        if key not in self.known:
            self.known[key] = f"{self.prefix}{len(self.known)}"
            df.createOrReplaceTempView(self.known[key])
        self.known[key + "_df"] = df  # keeps the id taken
        return quote(self.known[key])

    def _columns(self, sql: str) -> list[str]:
        return self.spark.sql(sql).columns

    def _storage(self, sql: str) -> list[str]:
        """How the older engine stores each column: integers, other numbers by
        kind, text, days, moments and bytes apart."""
        whole = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "big integer", "float": "float", "double": "float"}
        return [whole.get(k, "decimal" if k.startswith("decimal") else "text" if k.startswith("string") else k) for _, k in self.spark.sql(sql).dtypes]

    def _domain(self, parts):
        d = self.now.domains.get(parts[-1].lower())
        if d is None:
            raise SqlError(f"no type or domain {parts[-1]}")
        self._allow("USAGE", parts[-1].lower(), d["owner"])
        return d["type"]

    def _type(self, t):
        return self._domain(t[1]) if t[0] == "DOMAIN" else t

    # ------------------------------------------------------------ privileges
    def _acting_as(self, owner: str):
        return _Acting(self, owner)

    def _is(self, owner: str) -> bool:
        return self.user.lower() in (owner.lower(), "default")

    def _grants(self, privilege: str, name: str):
        mine = (self.user.lower(), "public")
        return [g for g in self.now.grants if g.grantee in mine and g.privilege == privilege and g.target == name]

    def _allowed(self, privilege: str, name: str, owner: str, columns, option: bool = False):
        """None if the user holds a privilege on the whole object, or on all of
        ``columns``; without these the columns it holds it on. Else an error."""
        if self._is(owner):
            return None
        held = [g for g in self._grants(privilege, name) if g.option or not option]
        if any(not g.columns for g in held):
            return None
        some = {c for g in held for c in g.columns}
        if columns is not None and columns and {c.lower() for c in columns} <= some:
            return None
        if columns is None and some and not option:
            return sorted(some)
        raise SqlError(f"{self.user} lacks {privilege} on {name}")

    def _allow(self, privilege: str, name: str, owner: str, columns=()) -> None:
        self._allowed(privilege, name, owner, columns)

    def _own(self, owner: str, what: str) -> None:
        if not self._is(owner):
            raise SqlError(f"{self.user} does not own {what}")

    # --------------------------------------------------------------- queries
    def query(self, sql: str, params=()) -> DataFrame:
        """The result of a query as a DataFrame; nothing runs yet."""
        p = Parser(sql)
        tree = p.query()
        p.take(";")
        if not p.end():
            raise SqlError(f"unexpected {p.toks[p.at][1]!r} after the query")
        return self._frame(self._bind(tree, params))

    def explain(self, sql: str) -> str:
        """The Spark SQL that a query becomes. Draws from no sequence."""
        self.drawing = False
        try:
            return self.renderer.query(Parser(sql).query())
        finally:
            self.drawing = True

    def _frame(self, tree) -> DataFrame:
        return self.spark.sql(self.renderer.query(self._numbered(tree)))

    def _sequence(self, parts) -> list:
        s = self.now.sequences.get(parts[-1].lower())
        if s is None:
            raise SqlError(f"no sequence {parts[-1]}")
        return s

    def _numbered(self, tree):
        """NEXT_SEQUENCE in the select list of a query with tables draws for each
        row: the rows settle with their place in each partition, partitions get
        ranges by their counts, and the rest of each item is worked out around it."""
        outer = None
        if tree[0] == "query" and tree[1][0] == "select":
            outer, tree = tree, tree[1]
        drawn = lambda x: any(n[:2] == ("sequence", "NEXT_SEQUENCE") for n in nodes(x))
        if tree[0] != "select" or not tree[3] or not drawn([i[1] for i in tree[2]]):
            return tree if outer is None else outer
        if tree[1] or tree[5] or tree[6] or any(i[1][0] == "star" for i in tree[2]) or has_aggregate([i[1] for i in tree[2]]):
            raise SqlError("NEXT_SEQUENCE stands beside columns of single rows only")
        inner, uses, last = [], {}, {}

        def walk(e):
            if isinstance(e, list):
                return [walk(x) for x in e]
            if e[0] == "sequence":
                name = e[2][-1].lower()
                held = uses.setdefault(name, [])
                if e[1] == "NEXT_SEQUENCE":
                    held.append(len(held))
                    last[name] = ("col", ("numbered", f"s_{name}_{held[-1]}"))
                return last.get(name, e)
            if not drawn(e) and not any(n[0] == "sequence" for n in nodes(e)):
                if e[0] in ("lit", "value", "param"):
                    return e
                inner.append(("item", e, f"c{len(inner)}"))
                return ("col", ("numbered", inner[-1][2]))
            return tuple(walk(x) if isinstance(x, (tuple, list)) and x and isinstance(x[0], (tuple, str)) and not (e[0] == "cast" and x is e[2]) else x for x in e)

        items = [("item", walk(e), a or (e[1][-1] if e[0] == "col" else None)) for _, e, a in tree[2]]
        base = self._frame(("select", False, inner or [("item", ("lit", "num", "1"), "c0")], tree[3], tree[4], None, None, None))
        rows = store.settle(base.withColumn("place", F.monotonically_increasing_id()), "numbered")
        part = F.shiftright("place", 33)
        sizes = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each task
        starts, total = [], 0
        for p, n in sizes:
            starts.append((p, total))
            total += n
        before = self.spark.createDataFrame(starts, "part long, before long")
        rows = rows.withColumn("part", part).join(F.broadcast(before), "part", "left")
        nth = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
        for name, held in uses.items():
            if held:
                s = self._sequence((name,))
                rows = rows.withColumns({f"s_{name}_{k}": F.lit(s[0]) + nth * len(held) + k for k in held})
                if total:
                    s[:] = [s[0] + total * len(held), s[0] + total * len(held) - 1]
        view = f"{self.prefix}n{next(_serial)}"
        rows.createOrReplaceTempView(view)
        out = ("select", False, items, [("derived", ("spark", f"SELECT * FROM {view}"), "numbered", None)], None, None, None, tree[7])
        return out if outer is None else (outer[0], out, *outer[2:])

    def _bind(self, tree, params):
        if not params:
            return tree
        return rewrite(tree, lambda n: ("value", params[n[1]]) if n and n[0] == "param" else n)

    def execute(self, sql: str, params=()):
        """Runs one statement: a DataFrame for a query, the number of rows for a
        change, a list of DataFrames for CALL, else None."""
        p = StatementParser(sql)
        stmts = p.script()
        if len(stmts) != 1:
            raise SqlError("execute() takes one statement")
        return self.run(self._bind(stmts[0], params))

    def run_script(self, sql: str) -> list:
        return [self.run(s) for s in StatementParser(sql).script()]

    def run(self, stmt):
        """One parsed statement, atomically."""
        before, touched = self.now.copy(), set(self.touched)
        try:
            return getattr(self, "do_" + stmt[0])(*stmt[1:])
        except Exception:
            if stmt[0] not in ("commit", "rollback"):
                self.now, self.touched = before, touched
            raise

    def do_query_stmt(self, q):
        if q[0] == "select" and q[7]:
            return self.select_into(q)
        return self._frame(q)

    # ---------------------------------------------------------- table changes
    def _settled(self, t: Table, df: DataFrame) -> None:
        """Makes ``df`` the next version of a table."""
        if self.read_only:
            raise SqlError("the transaction is read only")
        cols = [F.col(quote(c)).cast(k) if k != dict(df.dtypes).get(c) else F.col(quote(c)) for c, k in t.df.dtypes]
        df = store.settle(df.select(*[x.alias(c) for x, (c, _) in zip(cols, t.df.dtypes)]), t.name.lower())
        self.now.tables[t.name.lower()] = replace(t, df=df, parts=() if self.compat else (store.path_of(df),))
        self.touched.add(t.name.lower())

    def _default(self, t: Table, column: str) -> str:
        default = self._default_tree(t, column)
        return "NULL" if default is None else self.renderer.expr(default)

    def _default_tree(self, t: Table, column: str):
        c = next((c for c in t.columns if c["name"].lower() == column.lower()), None)
        if c is None:
            raise SqlError(f"no column {column} in {t.name}")
        default = c["default"]
        if default is None and c["type"] and c["type"][0] == "DOMAIN":
            default = self.now.domains[c["type"][1][-1].lower()]["default"]
        return default

    def do_insert(self, name, cols, q) -> int:
        if name[-1].lower() in self.now.views:
            return self._insert_view(name, cols, q)
        t = self.table(name)
        names = [c["name"] for c in t.columns]
        target = cols or names
        self._allow("INSERT", t.name.lower(), t.owner, target)
        for c in target:
            self._default(t, c)  # it exists
        if q is None:
            text = "SELECT " + ", ".join(f"{self._default(t, c)} AS {quote(c)}" for c in names)
        elif q[0] == "values":
            given = {c.lower() for c in target}
            rows = []
            for r in q[1]:
                if len(r) != len(target):
                    raise SqlError("INSERT: the row's degree differs from the column list")
                put = {c.lower(): self._default(t, c) if e[0] == "default" else self.renderer.expr(e) for e, c in zip(r, target)}
                rows.append([put[c.lower()] if c.lower() in given else self._default(t, c) for c in names])
            kinds = dict(t.df.dtypes)
            text = " UNION ALL ".join("SELECT " + ", ".join(f"CAST({e} AS {kinds[c]}) AS {quote(c)}" for e, c in zip(r, names)) for r in rows)
        else:
            q = self._numbered(q)
            if len(self._columns(self.renderer.query(q))) != len(target):
                raise SqlError("INSERT: the query's degree differs from the column list")
            given = {c.lower() for c in target}
            items = [("item", ("col", ("s", c)) if c.lower() in given else self._default_tree(t, c) or ("lit", "null", "NULL"), c) for c in names]
            text = self.renderer.query(self._numbered(("select", False, items, [("derived", q, "s", target)], None, None, None, None)))
        new = store.settle(self.spark.sql(text).select(*[self._stored(c, k) for c, k in t.df.dtypes]), t.name.lower())
        n = new.count()
        self._appended(t, new)
        self._check({t.name.lower()}, new=new)
        return n

    def _appended(self, t: Table, new: DataFrame) -> None:
        """Adds settled rows to a table as one more part; nothing else is written
        but for a table of very many parts, which becomes one."""
        if self.read_only:
            raise SqlError("the transaction is read only")
        if t.parts and len(t.parts) < MAX_PARTS:
            parts = (*t.parts, store.path_of(new))
            self.now.tables[t.name.lower()] = replace(t, df=store.read_parts(self.spark, t.df.schema, parts), parts=parts)
            self.touched.add(t.name.lower())
        else:
            self._settled(t, t.df.unionByName(new))

    def _stored(self, c, kind):
        x = F.col(quote(c))
        if self.compat and kind.startswith("decimal"):  # excess digits are cut, not rounded
            p, s = kind[8:-1].split(",")
            x = F.expr(f"CAST(CAST({quote(c)} * CAST(1e{s} AS double) AS bigint) / CAST(1e{s} AS double) AS {kind})")
        return x.cast(kind).alias(c)

    def _insert_view(self, name, cols, q) -> int:
        v = self.now.views[name[-1].lower()]
        body = v.query
        if body[0] != "select" or len(body[3]) != 1 or body[3][0][0] != "rel" or body[5] or any(i[1][0] not in ("col", "star") for i in body[2]):
            raise SqlError("the view is not updatable")
        base = body[3][0][1]
        names = [i[1][1][-1] for i in body[2]] if body[2][0][1][0] == "col" else [c["name"] for c in self.table(base).columns]
        shown = v.columns or names
        real = [names[[s.lower() for s in shown].index(c.lower())] for c in cols] if cols else names
        outside = ("select", False, [("item", ("lit", "num", "1"), "x")], [("rel", base, None, None)], ("is", "TRUE", True, body[4]), None, None, None) if v.check and body[4] is not None else None
        before = self._frame(outside).count() if outside else 0
        n = self.do_insert(base, real, q)
        if outside and self._frame(outside).count() > before:
            raise SqlError("a new row lies outside the view (CHECK OPTION)")
        return n

    def do_delete(self, name, cond) -> int:
        t = self.table(name)
        self._allow("DELETE", t.name.lower(), t.owner)
        where = f"({self.renderer.expr(cond)}) IS TRUE" if cond is not None else "TRUE"
        wide = store.settle(self.spark.sql(f"SELECT *, {where} AS `_hit` FROM {self._named_view(t.name, t.df)} AS {quote(t.name)}"), t.name.lower())
        n = wide.where("_hit").count()
        self._change(t.name.lower(), wide.select(F.struct(*map(quote, t.df.columns)).alias("old"), F.when(~F.col("_hit"), F.struct(*map(quote, t.df.columns))).alias("new")))
        self._check(self.touched)
        return n

    def do_update(self, name, sets, cond) -> int:
        t = self.table(name)
        self._allow("UPDATE", t.name.lower(), t.owner, [c for c, _ in sets])
        kinds = dict(t.df.dtypes)
        values = {}
        for c, e in sets:
            value = self._default(t, c) if e[0] == "default" else self.renderer.expr(e)
            values[_named(t, c)] = value
        where = f"({self.renderer.expr(cond)}) IS TRUE" if cond is not None else "TRUE"
        old = f"named_struct({', '.join(f'{string(c)}, {quote(c)}' for c in kinds)})"
        # values are computed from the row, only where it is hit
        nexts = ", ".join(f"CASE WHEN `_hit` THEN CAST({v} AS {kinds[c]}) END AS {quote('_n_' + c)}" for c, v in values.items())
        marked = f"SELECT *, {where} AS `_hit` FROM {self._named_view(t.name, t.df)} AS {quote(t.name)}"
        wide = self.spark.sql(f"SELECT *, {nexts}, {old} AS `_old` FROM ({marked}) AS {quote(t.name)}")
        new = F.struct(*[F.when(F.col("_hit"), F.col(quote("_n_" + c))).otherwise(F.col(quote(c))).alias(c) if c in values else F.col(quote(c)) for c in kinds])
        wide = store.settle(wide.select(F.col("_hit"), F.col("_old").alias("old"), new.alias("new")), t.name.lower())
        n = wide.where("_hit").count()
        self._change(t.name.lower(), wide.select("old", "new"))
        self._check(self.touched)
        return n

    def _change(self, name: str, pairs: DataFrame) -> None:
        """Applies (old, new) rows of a table, new null for a deleted row, and
        then the referential actions of the tables that point to it, until none moves a row."""
        waiting = [(name, pairs)]
        while waiting:
            waiting.extend(self._apply(*waiting.pop()))

    def _apply(self, name: str, pairs: DataFrame):
        """One table's change; yields the changes it asks for elsewhere."""
        t = self.now.tables[name]
        self._settled(t, pairs.where("new is not null").select("new.*"))
        for child, c in self._references(name):
            keys = c["ref_cols"]
            moved = pairs.where(~F.col("old").eqNullSafe(F.col("new"))).select(*[F.col(f"old.{quote(k)}").alias(f"_o{i}") for i, k in enumerate(keys)], *[F.col(f"new.{quote(k)}").alias(f"_k{i}") for i, k in enumerate(keys)], F.col("new").isNull().alias("_gone"))
            same = F.lit(True)
            for i in range(len(keys)):
                same = same & F.col(f"_o{i}").eqNullSafe(F.col(f"_k{i}"))
            actions = {True: c["delete"], False: c["update"]}
            if all(a in ("NO ACTION", "RESTRICT") for a in actions.values()):
                continue
            moved = moved.where(F.col("_gone") | ~same).distinct()
            ct = self.now.tables[child]
            row = F.struct(*map(quote, ct.df.columns))
            on = None
            for i, k in enumerate(c["cols"]):
                e = F.col(quote(_named(ct, k))) == F.col(f"_o{i}")
                on = e if on is None else on & e
            joined = ct.df.join(moved, on, "left")

            def after(action, by_update):
                if action == "CASCADE":
                    if not by_update:
                        return F.lit(None).cast(joined.select(row.alias("r")).schema["r"].dataType)
                    put = {_named(ct, k): F.col(f"_k{i}") for i, k in enumerate(c["cols"])}
                elif action == "SET NULL":
                    put = {_named(ct, k): F.lit(None) for k in c["cols"]}
                elif action == "SET DEFAULT":
                    put = {_named(ct, k): F.expr(self._default(ct, k)) for k in c["cols"]}
                else:
                    return row
                kinds = dict(ct.df.dtypes)
                return F.struct(*[put[x].cast(kinds[x]).alias(x) if x in put else F.col(quote(x)) for x in ct.df.columns])

            hit = F.col("_gone").isNotNull()
            new = F.when(hit & F.col("_gone"), after(actions[True], False)).when(hit, after(actions[False], True)).otherwise(row)
            nxt = store.settle(joined.select(row.alias("old"), new.alias("new")), child)
            if not nxt.where(~F.col("old").eqNullSafe(F.col("new"))).isEmpty():
                yield child, nxt

    def _references(self, name: str):
        for child, t in list(self.now.tables.items()):
            for c in t.constraints:
                if c["kind"] == "fk" and c["ref"][-1].lower() == name:
                    yield child, c

    # ------------------------------------------------------------ constraints
    def violations(self, name: str, c: dict, new: DataFrame | None = None) -> DataFrame:
        """The rows (or keys) that break a constraint of a table; with ``new``
        only those that rows just added to it break."""
        t = self.table(name)
        if new is not None:
            cols = [quote(x) for x in c["cols"]] if c["kind"] in ("pk", "unique") else []
            t = replace(t, df=_of_keys(t.df, new, cols) if cols else new)
        if c["kind"] in ("pk", "unique"):
            cols = [quote(x) for x in c["cols"]]
            full = " AND ".join(f"{x} IS NOT NULL" for x in cols)
            twice = t.df.where(full).groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
            if c["kind"] == "pk":
                twice = twice.unionByName(t.df.where(f"NOT ({full})").select(*cols))
            return twice
        if c["kind"] == "check":
            return self.spark.sql(f"SELECT * FROM {{rows}} AS {quote(t.name)} WHERE NOT ({self.renderer.expr(c['check'])})", rows=t.df)
        if c["kind"] == "not_null":
            return t.df.where(F.col(quote(c["cols"][0])).isNull())
        ref = self.table(c["ref"])
        cols = ", ".join(quote(x) for x in c["cols"])
        if c["match"] != "PARTIAL":
            on = None
            for a, b in zip(c["cols"], c["ref_cols"]):
                e = F.col("_c." + quote(a)) == F.col("_p." + quote(b))
                on = e if on is None else on & e
            null = [F.col("_c." + quote(x)).isNull() for x in c["cols"]]
            some, every = null[0], null[0]
            for x in null[1:]:
                some, every = some | x, every & x
            orphans = t.df.alias("_c").join(ref.df.alias("_p"), on, "left_anti")
            return orphans.where(~some) if c["match"] == "SIMPLE" else orphans.where(~every)
        match = ("match", ("row", [("col", (x,)) for x in c["cols"]]) if len(c["cols"]) > 1 else ("col", (c["cols"][0],)), False, c["match"], ("select", False, [("item", ("col", (x,)), None) for x in c["ref_cols"]], [("rel", (ref.name,), None, None)], None, None, None, None))
        return self.spark.sql(f"SELECT {cols} FROM {{rows}} AS {quote(t.name)} WHERE NOT ({self.renderer.expr(match)})", rows=t.df)

    def _constraints(self, names):
        for n, t in self.now.tables.items():
            own = [{"kind": "not_null", "cols": [c["name"]], "name": f"{c['name']} NOT NULL", "deferred": False, "deferrable": False} for c in t.columns if c["not_null"]]
            for c in t.columns:
                if c["type"] and c["type"][0] == "DOMAIN":
                    for e in self.now.domains[c["type"][1][-1].lower()]["checks"]:
                        own.append({"kind": "check", "name": f"{c['name']} domain", "deferred": False, "deferrable": False, "check": rewrite(e, lambda x, c=c: ("col", (c["name"],)) if x[0] == "col" and x[1][-1].upper() == "VALUE" else x)})
            for c in [*t.constraints, *own]:
                if n in names or c["kind"] == "fk" and c["ref"][-1].lower() in names:
                    yield n, c

    def _waits(self, c) -> bool:
        named = (c["name"] or "").lower()
        return c["deferrable"] and self.deferred.get(named, self.deferred.get("*", c["deferred"]))

    def _check(self, names, everything: bool = False, new: DataFrame | None = None) -> None:
        """All constraints of some tables in one query. ``new``: the rows that
        one table gained; what was there before, and what points to it, holds still."""
        due = [(n, c) for n, c in self._constraints(set(names)) if everything or not self._waits(c)]
        if new is not None:
            looks = lambda c: c["kind"] == "check" and any(x[0] in SUBQUERIES for x in nodes(c["check"]))
            due = [(n, c) for n, c in due if n in names or looks(c)]
        broken = None
        with self._acting_as("DEFAULT"):
            for i, (n, c) in enumerate(due):
                rows = self.violations(n, c, None if new is None or looks(c) else new).limit(1).select(F.lit(i).alias("i"))
                broken = rows if broken is None else broken.unionAll(rows)
        found = None if broken is None else broken.first()
        if found is not None:
            n, c = due[found["i"]]
            raise SqlError(f"constraint {c['name'] or c['kind']} of {n} is violated")

    # ----------------------------------------------------------- transactions
    def do_commit(self):
        try:
            self._check(self.touched, everything=True)
        except SqlError:
            self.do_rollback()
            raise
        for n, t in list(self.now.tables.items()):
            if not t.keep_rows:
                self.now.tables[n] = replace(t, df=t.df.where("false"))
        self.saved = self.now.copy()
        self._transaction_over()

    def do_rollback(self):
        self.now = self.saved.copy()
        self._transaction_over()

    def _transaction_over(self):
        self.touched, self.deferred, self.read_only = set(), {}, False

    def do_set_constraints(self, names, deferred):
        for n in names or ["*"]:
            self.deferred[n.lower()] = deferred
        if not deferred:
            self._check(self.touched)

    def do_set_transaction(self, modes):
        self.read_only = "READ ONLY" in modes

    def do_connect(self, target, user, password=None):
        known = (user or "DEFAULT").lower()
        if known not in self.now.users:
            raise SqlError(f"no user {user}")
        if self.now.users[known] is not None and self.now.users[known] != password:
            raise SqlError("the password is wrong")
        self.user = user or "DEFAULT"

    def do_disconnect(self):
        self.do_rollback()
        self.user = "DEFAULT"

    def do_set_schema(self, name):
        self.schema = name

    # -------------------------------------------------------------------- DDL
    def do_create_schema(self, name, owner):
        self.now.schemas[name[-1].lower()] = owner or self.user

    def do_create_user(self, name, password):
        self._own("DEFAULT", "the list of users")
        self.now.users[name[-1].lower()] = password

    def do_alter_user(self, name, password):
        if name[-1].lower() not in self.now.users:
            raise SqlError(f"no user {name[-1]}")
        self._own(name[-1], f"user {name[-1]}")
        self.now.users[name[-1].lower()] = password

    def do_create_catalog(self, name, _):
        self._own("DEFAULT", "the list of catalogs")
        if name[-1].lower() in self.catalogs:
            raise SqlError(f"{name[-1]} exists")
        self.catalogs[name[-1].lower()] = Catalog()

    def do_open_catalog(self, name):
        """Makes another catalog the current one; the transaction ends."""
        if name.lower() not in self.catalogs:
            raise SqlError(f"no catalog {name}")
        if name.lower() != self.catalog.lower():
            self.do_commit()
            self.catalogs[self.catalog.lower()] = self.now
            self.catalog, self.now = name.upper(), self.catalogs[name.lower()]
            self.catalogs[name.lower()] = None
            self.saved = self.now.copy()

    def do_close_catalog(self, name):
        if name.lower() == self.catalog.lower():
            self.do_open_catalog("DB1")

    def do_create_table(self, name, cols, cons, temp, keep):
        key = name[-1].lower()
        if self.exists(key) or key in self.now.views:
            raise SqlError(f"{name[-1]} exists")
        lows = [c["name"].lower() for c in cols]
        if len(set(lows)) < len(lows):
            raise SqlError("a column name repeats")
        schema = ", ".join(f"{quote(c['name'])} {spark_type(self._type(c['type']))}" for c in cols)
        df = self.spark.createDataFrame([], schema)
        if self.compat:
            df = df.select(*[F.expr(f"{quote(c)} COLLATE UTF8_LCASE_RTRIM").alias(c) if t == "string" else F.col(quote(c)) for c, t in df.dtypes])
        self.now.tables[key] = Table(name[-1], df, tuple(cols), (), self.user, name[-2] if len(name) > 1 else self.schema, temp, keep)
        for c in cons:
            self._add_constraint(key, c)

    def _add_constraint(self, key, c):
        t = self.now.tables[key]
        for x in c.get("cols", []):
            _named(t, x)
        if c["kind"] == "fk":
            ref = self.table(c["ref"])
            self._allow("REFERENCES", ref.name.lower(), ref.owner, c["ref_cols"] or ())
            keys = [k["cols"] for k in ref.constraints if k["kind"] in ("pk", "unique")]
            if c["ref_cols"] is None:
                pk = next((k["cols"] for k in ref.constraints if k["kind"] == "pk"), None)
                if pk is None:
                    raise SqlError(f"{ref.name} has no primary key")
                c = c | {"ref_cols": pk}
            elif sorted(map(str.lower, c["ref_cols"])) not in [sorted(map(str.lower, k)) for k in keys]:
                raise SqlError("REFERENCES needs a unique key")
            if len(c["ref_cols"]) != len(c["cols"]):
                raise SqlError("FOREIGN KEY and REFERENCES differ in degree")
        c = c | {"name": c["name"] or f"{key}_{c['kind']}_{len(t.constraints) + 1}"}
        self.now.tables[key] = replace(t, constraints=(*t.constraints, c))

    def do_create_view(self, name, cols, q, check):
        shown = self._columns(self.renderer.query(q))
        if cols and len(cols) != len(shown):
            raise SqlError("the view's column list differs in degree")
        self.now.views[name[-1].lower()] = View(q, cols, check, self.user)

    def do_create_domain(self, name, t, default, checks):
        self.now.domains[name[-1].lower()] = {"type": t, "default": default, "checks": checks, "owner": self.user}

    def do_create_sequence(self, name, start):
        self.now.sequences[name[-1].lower()] = [start, None]

    def do_create_index(self, name, table, cols):
        t = self.table(table)
        self._own(t.owner, t.name)
        self.now.indexes[name[-1].lower()] = (t.name, [_named(t, c) for c in cols])  # Parquet statistics serve lookups

    def do_drop(self, what, name, behaviour):
        key = name[-1].lower()
        where = {"TABLE": "tables", "VIEW": "views", "DOMAIN": "domains", "SEQUENCE": "sequences", "SCHEMA": "schemas", "INDEX": "indexes", "USER": "users"}.get(what, "routines")
        held = getattr(self.now, where)
        if what == "CATALOG":
            self._own("DEFAULT", "the list of catalogs")
            if self.catalogs.get(key) is None:
                raise SqlError(f"{name[-1]} is open or unknown")
            del self.catalogs[key]
            return
        if what == "TABLE":
            self.table(key)
        if key not in held:
            raise SqlError(f"no {what.lower()} {name[-1]}")
        owner = held[key]
        owner = {"USER": "DEFAULT", "SCHEMA": owner, "SEQUENCE": self.user}.get(what) or (self.table(owner[0]).owner if what == "INDEX" else owner.owner if what in ("TABLE", "VIEW") else owner["owner"])
        self._own(owner, name[-1])
        if what == "TABLE":
            users = [(n, c) for n, c in self._references(key) if n != key]
            views = [v for v, d in self.now.views.items() if any(n[0] == "rel" and n[1][-1].lower() == key for n in nodes(d.query))]
            if behaviour == "RESTRICT" and (users or views):
                raise SqlError(f"{name[-1]} is in use")
            for n, c in users:
                t = self.now.tables[n]
                self.now.tables[n] = replace(t, constraints=tuple(x for x in t.constraints if x is not c))
            for v in views:
                del self.now.views[v]
        if what == "SCHEMA":
            inside = [n for n, t in self.now.tables.items() if t.schema.lower() == key]
            if inside and behaviour == "RESTRICT":
                raise SqlError(f"schema {name[-1]} is not empty")
            for n in inside:
                del self.now.tables[n]
        if what == "DOMAIN" and behaviour == "RESTRICT" and any(c["type"] and c["type"][0] == "DOMAIN" and c["type"][1][-1].lower() == key for t in self.now.tables.values() for c in t.columns):
            raise SqlError(f"domain {name[-1]} is in use")
        del held[key]

    def do_alter(self, table, what, arg, extra):
        t = self.table(table)
        self._own(t.owner, t.name)
        key = t.name.lower()
        if what == "add_column":
            kind = spark_type(self._type(arg["type"]))
            self.now.tables[key] = replace(t, columns=(*t.columns, arg), df=t.df.withColumn(arg["name"], F.expr("NULL" if arg["default"] is None else self.renderer.expr(arg["default"])).cast(kind)), parts=())
            for c in extra:
                self._add_constraint(key, c)
        elif what == "drop_column":
            name = _named(t, arg)
            if any(name.lower() in map(str.lower, c.get("cols", [])) for c in t.constraints) and extra != "CASCADE":
                raise SqlError(f"a constraint uses {name}")
            self.now.tables[key] = replace(t, columns=tuple(c for c in t.columns if c["name"] != name), df=t.df.drop(name), parts=(), constraints=tuple(c for c in t.constraints if name.lower() not in map(str.lower, c.get("cols", []))))
        elif what == "default":
            name = _named(t, arg)
            self.now.tables[key] = replace(t, columns=tuple(c | {"default": extra} if c["name"] == name else c for c in t.columns))
        elif what == "add_constraint":
            self._add_constraint(key, arg)
        else:
            if arg.lower() not in [c["name"].lower() for c in t.constraints]:
                raise SqlError(f"no constraint {arg}")
            self.now.tables[key] = replace(t, constraints=tuple(c for c in t.constraints if c["name"].lower() != arg.lower()))
        self._check({key})

    def _target(self, kind, target) -> str:
        """The owner of what a privilege is on."""
        key = target[-1].lower()
        if kind == "DOMAIN":
            return self.now.domains[key]["owner"] if key in self.now.domains else self.table(key).owner
        if kind in ("FUNCTION", "PROCEDURE", "ROUTINE") or key in self.now.routines and not self.exists(key):
            if key not in self.now.routines:
                raise SqlError(f"no routine {target[-1]}")
            return self.now.routines[key]["owner"]
        return self.now.views[key].owner if key in self.now.views and not self.exists(key) else self.table(target).owner

    def _spelled(self, kind, privileges):
        every = {"DOMAIN": ("USAGE",), "FUNCTION": ("EXECUTE",), "PROCEDURE": ("EXECUTE",), "ROUTINE": ("EXECUTE",)}.get(kind, PRIVILEGES)
        for p, cols in privileges:
            for x in every if p == "ALL" else (p,):
                yield x, tuple(sorted(c.lower() for c in cols or ()))

    def do_grant(self, privileges, kind, target, who, option, _):
        owner, key = self._target(kind, target), target[-1].lower()
        for p, cols in self._spelled(kind, privileges):
            self._allowed(p, key, owner, cols, option=True)
            for w in who:
                self.now.grants.add(Grant(w.lower(), p, key, cols, option, self.user.lower()))

    def do_revoke(self, privileges, kind, target, who, option, behaviour):
        """Takes back what the user granted (the owner: what anyone did). What
        depends on it goes as well, or is an error under RESTRICT."""
        owner, key = self._target(kind, target), target[-1].lower()
        lost = [(w.lower(), p, cols) for p, cols in self._spelled(kind, privileges) for w in who]
        lost = [(*x, None if self._is(owner) else self.user.lower()) for x in lost]
        while lost:
            w, p, cols, by = lost.pop()
            for g in list(self.now.grants):
                if (g.grantee, g.privilege, g.target) != (w, p, key) or by not in (None, g.grantor):
                    continue
                if cols and g.columns and not set(cols) & set(g.columns):
                    continue
                self.now.grants.discard(g)
                left = tuple(c for c in g.columns if c not in cols) if cols and g.columns else ()
                if left:
                    self.now.grants.add(replace(g, columns=left))
                if option:
                    self.now.grants.add(replace(g, option=False))
                if not self._passes(w, p, key, owner):
                    then = [(x.grantee, p, cols, w) for x in self.now.grants if x.grantor == w and (x.privilege, x.target) == (p, key)]
                    if then and behaviour == "RESTRICT":
                        raise SqlError("other privileges depend on it")
                    lost.extend(then)

    def _passes(self, who, privilege, key, owner) -> bool:
        """Whether a user may still pass a privilege on."""
        return who == owner.lower() or any(g.option and (g.grantee, g.privilege, g.target) == (who, privilege, key) for g in self.now.grants)

    # ----------------------------------------------------------- administration
    def do_showtrans(self):
        return self.spark.createDataFrame([(self.user, self.schema, sorted(self.touched), self.read_only)], "user_name string, schema_name string, touched array<string>, read_only boolean")

    def do_backup(self, folder):
        self._own("DEFAULT", "the catalog")
        store.backup({n: t.df for n, t in self.everything().items()}, folder)

    def do_cancel(self, _):
        """Stops the Spark jobs that run now; a number names no single one, as
        one session runs one statement at a time."""
        self.spark.sparkContext.cancelAllJobs()

    do_kill = do_cancel

    def do_shutdown(self):
        """Ends the session: what is not committed is rolled back."""
        self._own("DEFAULT", "the server")
        self.do_disconnect()

    def do_rebuild_index(self, name):
        """Writes the indexed table anew, ordered by the index's columns, so that
        the files' statistics tell its values apart."""
        key = name[-1].lower()
        if key not in self.now.indexes:
            raise SqlError(f"no index {name[-1]}")
        t = self.table(self.now.indexes[key][0])
        self._own(t.owner, t.name)
        self._settled(t, t.df.sortWithinPartitions(*map(quote, self.now.indexes[key][1])))

    def do_garbage_collect(self, _):
        """Writes each table of several parts as one."""
        for t in list(self.now.tables.values()):
            if len(t.parts) > 1:
                self._settled(t, t.df)

    def do_debug(self, what, arg):
        if what == "PLAN":
            self._frame(arg).explain("formatted")
        else:
            self.printed.append(self.value(arg))

    # ------------------------------------------------------- what names stand for
    def _resolve(self, node):
        kind = node[0]
        if kind == "niladic":
            w = node[1]
            if w in ("USER", "CURRENT_USER", "SESSION_USER", "SYSTEM_USER", "CURRENT_AUTHID"):
                return string(self.user)
            if w == "CURRENT_CATALOG":
                return string(self.catalog)
            if w == "CURRENT_SCHEMA":
                return string(self.schema)
            if w == "SQLSTATE":
                return string(self.sqlstate)
            return {"CURRENT_DATE": "current_date()", "CURRENT_TIME": "date_format(current_timestamp(), 'HH:mm:ss')", "CURRENT_TIMESTAMP": "CAST(current_timestamp() AS timestamp_ntz)"}[w]
        if kind == "sequence":
            s = self._sequence(node[2])
            if node[1] == "NEXT_SEQUENCE":
                if not self.drawing:
                    return str(s[0])
                s[:] = [s[0] + 1, s[0]]
            if s[1] is None:
                raise SqlError("no value was drawn yet")
            return str(s[1])
        return self.resolve_routine(node)


def _named(t: Table, column: str) -> str:
    for c in t.columns:
        if c["name"].lower() == column.lower():
            return c["name"]
    raise SqlError(f"no column {column} in {t.name}")


class _Acting:
    """For a while the session acts for another user."""

    def __init__(self, session: Session, user: str):
        self.session, self.user = session, user

    def __enter__(self):
        self.before, self.session.user = self.session.user, self.user

    def __exit__(self, *_):
        self.session.user = self.before


def _of_keys(df: DataFrame, new: DataFrame, cols: list[str]) -> DataFrame:
    """The rows of ``df`` whose key one of the new rows has, nulls included."""
    keys = new.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(cols)]).distinct()
    same = None
    for i, c in enumerate(cols):
        e = df[c].eqNullSafe(F.col(f"_k{i}"))
        same = e if same is None else same & e
    return df.join(keys, same, "left_semi")
