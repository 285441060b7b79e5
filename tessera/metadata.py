"""INFORMATION_SCHEMA relations, built from a session's catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .plans.parser import SqlError

#: The types offered to clients.
TYPE_NAMES = "CHARACTER;CHARACTER VARYING;NUMERIC;DECIMAL;INTEGER;SMALLINT;BIGINT;FLOAT;REAL;DOUBLE PRECISION;DATE;TIME;TIMESTAMP;BINARY LARGE OBJECT;CHARACTER LARGE OBJECT".split(";")
LONG = {"CHAR": "CHARACTER", "VARCHAR": "CHARACTER VARYING", "DOUBLE": "DOUBLE PRECISION", "BLOB": "BINARY LARGE OBJECT", "CLOB": "CHARACTER LARGE OBJECT"}


def _type_name(session, t, column) -> str:
    if column["type"] is None:
        return dict(t.df.dtypes)[column["name"]].upper()
    name = session._type(column["type"])[0]
    return LONG.get(name, name)


def _keys(session, kinds):
    for t in session.now.tables.values():
        for c in t.constraints:
            if c["kind"] in kinds:
                yield t, c


def _privileges(session):
    for t in session.now.tables.values():
        for p in ("SELECT", "INSERT", "UPDATE", "DELETE", "REFERENCES"):
            yield "_SYSTEM", t.owner, t, p, (), "YES"
    for g in sorted(session.now.grants, key=repr):
        if g.target in session.now.tables:
            yield g.grantor.upper(), g.grantee, session.now.tables[g.target], g.privilege, g.columns, "YES" if g.option else "NO"


def relation(session, name: str, schema: str = "information_schema") -> DataFrame:
    """One relation by its lower-case name."""
    if schema == "catalog_definition_schema":
        return system_table(session, name)
    now = session.now
    session.everything()
    kind_word = {"pk": "PRIMARY KEY", "unique": "UNIQUE", "fk": "FOREIGN KEY", "check": "CHECK"}

    def tables():
        for t in now.tables.values():
            yield session.catalog, t.schema, t.name, "LOCAL TEMPORARY" if t.temporary else "BASE TABLE"
        for v in now.views:
            yield session.catalog, session.schema, v, "VIEW"

    def columns():
        for t in now.tables.values():
            for i, c in enumerate(t.columns, 1):
                yield session.catalog, t.schema, t.name, c["name"], i, None if c["default"] is None else session.renderer.expr(c["default"]), "NO" if c["not_null"] else "YES", _type_name(session, t, c)

    def unique_of(t, c):
        ref = session.table(c["ref"])
        return next(k["name"] for k in ref.constraints if k["kind"] in ("pk", "unique") and sorted(map(str.lower, k["cols"])) == sorted(map(str.lower, c["ref_cols"])))

    found = {
        "information_schema_catalog_name": ("catalog_name string", [(session.catalog,)]),
        "type_info": ("type_name string", [(n,) for n in TYPE_NAMES]),
        "sql_languages": ("sql_language_source string, sql_language_year string, sql_language_conformance string", [("ISO 9075", "1992", "ENTRY")]),
        "schemata": ("catalog_name string, schema_name string, schema_owner string", [(session.catalog, s, o) for s, o in now.schemas.items()]),
        "tables": ("table_catalog string, table_schema string, table_name string, table_type string", list(tables())),
        "columns": ("table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, column_default string, is_nullable string, data_type string", list(columns())),
        "domains": ("domain_catalog string, domain_schema string, domain_name string, data_type string", [(session.catalog, session.schema, d, LONG.get(v["type"][0], v["type"][0])) for d, v in now.domains.items()]),
        "domain_constraints": ("constraint_name string, domain_name string", [(f"{d}_check_{i}", d) for d, v in now.domains.items() for i, _ in enumerate(v["checks"], 1)]),
        "key_column_usage": ("constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int", [(c["name"], t.schema, t.name, x, i) for t, c in _keys(session, ("pk", "unique", "fk")) for i, x in enumerate(c["cols"], 1)]),
        "table_constraints": ("constraint_name string, table_schema string, table_name string, constraint_type string, is_deferrable string, initially_deferred string", [(c["name"], t.schema, t.name, kind_word[c["kind"]], "YES" if c["deferrable"] else "NO", "YES" if c["deferred"] else "NO") for t, c in _keys(session, kind_word)]),
        "check_constraints": ("constraint_name string, check_clause string", [(c["name"], session.renderer.expr(c["check"])) for _, c in _keys(session, ("check",))]),
        "referential_constraints": ("constraint_name string, unique_constraint_name string, match_option string, update_rule string, delete_rule string", [(c["name"], unique_of(t, c), "NONE" if c["match"] == "SIMPLE" else c["match"], c["update"], c["delete"]) for t, c in _keys(session, ("fk",))]),
        "table_privileges": ("grantor string, grantee string, table_name string, privilege_type string, is_grantable string", [(a, b, t.name, p, o) for a, b, t, p, cols, o in _privileges(session) if not cols]),
        "column_privileges": ("grantor string, grantee string, table_name string, column_name string, privilege_type string, is_grantable string", [(a, b, t.name, c, p, o) for a, b, t, p, cols, o in _privileges(session) for c in (cols or [x["name"] for x in t.columns]) if p != "DELETE"]),
        "active_transactions": ("user_name string, read_only boolean", [(session.user, session.read_only)]),
        "users": ("user_name string", [(u,) for u in now.users]),
        "routines": ("routine_name string, routine_type string, data_type string", [(r["name"], r["what"], r["returns"][0] if r["returns"] else None) for r in now.routines.values()]),
        "parameters": ("routine_name string, ordinal_position int, parameter_mode string, parameter_name string, data_type string", [(r["name"], i, p[0], p[1], p[2][0]) for r in now.routines.values() for i, p in enumerate(r["params"], 1)]),
        "routine_privileges": ("grantee string, routine_name string, privilege_type string", [(g.grantee, g.target, g.privilege) for g in sorted(now.grants, key=repr) if g.target in now.routines] + [(r["owner"], r["name"], "EXECUTE") for r in now.routines.values()]),
        "sequences": ("sequence_name string, next_value bigint", [(s, v[0]) for s, v in now.sequences.items()]),
        "views": ("table_name string, check_option string", [(n, v.check or "NONE") for n, v in now.views.items()]),
    }
    if name not in found:
        raise SqlError(f"no relation INFORMATION_SCHEMA.{name}")
    schema, rows = found[name]
    return session.spark.createDataFrame(rows, schema)


#: The codes that system tables hold for referential actions.
ACTIONS = {"NO ACTION": 0, "RESTRICT": 0, "CASCADE": 1, "SET NULL": 2, "SET DEFAULT": 3}


def system_table(session, name: str) -> DataFrame:
    """One table of CATALOG_DEFINITION_SCHEMA, numbered afresh from the catalog."""
    now = session.now
    tables = session.everything()
    schemas = {s: i for i, s in enumerate(sorted({*now.schemas, *(t.schema.lower() for t in tables.values())}), 1)}
    users = {u: i for i, u in enumerate(sorted(now.users), 1)}
    number = {n: i for i, n in enumerate(sorted([*tables, *now.views]), 1)}
    column = {(n, c["name"].lower()): i for i, (n, c) in enumerate(((n, c) for n in sorted(tables) for c in tables[n].columns), 1)}
    constraints = [(n, c) for n in sorted(tables) for c in tables[n].constraints]

    def constraint_rows():
        for i, (n, c) in enumerate(constraints, 1):
            parent = number[c["ref"][-1].lower()] if c["kind"] == "fk" else 0
            yield i, c["name"], {"pk": "PRIMARY KEY", "unique": "UNIQUE", "fk": "FOREIGN KEY", "check": "CHECK"}[c["kind"]], number[n], parent, c.get("match"), ACTIONS.get(c.get("update"), 0), ACTIONS.get(c.get("delete"), 0), "Y" if c["deferred"] else "N", "Y" if c["deferrable"] else "N"

    def constraint_columns():
        for i, (n, c) in enumerate(constraints, 1):
            sides = [("C", n, c.get("cols", []))] + ([("P", c["ref"][-1].lower(), c["ref_cols"])] if c["kind"] == "fk" else [])
            for side, of, cols in sides:
                for k, x in enumerate(cols, 1):
                    yield i, side, column[of, x.lower()], k

    found = {
        "syscatalog": ("catalog_id int, catalog_name string", [(1, session.catalog.lower())]),
        "sysschema": ("schema_id int, catalog_id int, schema_name string, auth_id int", [(i, 1, s.upper(), users.get(now.schemas.get(s, "default").lower(), 0)) for s, i in schemas.items()]),
        "sysauth": ("auth_id int, auth_name string", [(i, u.upper()) for u, i in users.items()]),
        "systable": ("table_id int, schema_id int, table_name string, table_type string, auth_id int", [(number[n], schemas[t.schema.lower()], t.name.upper(), "B", users.get(t.owner.lower(), 0)) for n, t in tables.items()] + [(number[n], schemas[session.schema.lower()], n.upper(), "V", users.get(v.owner.lower(), 0)) for n, v in now.views.items()]),
        "syscolumn": ("column_id int, table_id int, column_name string, position int, type string, nullable string", [(column[n, c["name"].lower()], number[n], c["name"].upper(), k, _type_name(session, t, c), "N" if c["not_null"] else "Y") for n, t in tables.items() for k, c in enumerate(t.columns, 1)]),
        "sysconstraint": ("constraint_id int, constraint_name string, rule_type string, FK_child_table_id int, FK_parent_table_id int, FK_match_type string, FK_on_update_action int, FK_on_delete_action int, initially_deferred string, `deferrable` string", list(constraint_rows())),
        "sysconstraintcolumn": ("constraint_id int, parent_or_child_table string, column_id int, column_sequence int", list(constraint_columns())),
        "sysdomain": ("domain_name string, type string", [(d.upper(), v["type"][0]) for d, v in now.domains.items()]),
        "sysindex": ("index_name string, table_id int", [(i.upper(), number[t.lower()]) for i, (t, _) in now.indexes.items()]),
        "sysindexcolumn": ("index_name string, column_id int, column_sequence int", [(i.upper(), column[t.lower(), c.lower()], k) for i, (t, cols) in now.indexes.items() for k, c in enumerate(cols, 1)]),
        "sysroutine": ("routine_name string, routine_type string", [(r["name"].upper(), r["what"]) for r in now.routines.values()]),
        "sysgenerator": ("generator_name string, next_value bigint", [(s.upper(), v[0]) for s, v in now.sequences.items()]),
        "systableprivilege": ("table_id int, grantee string, privilege string, grant_option string", [(number[t.name.lower()], b, p, o) for _, b, t, p, cols, o in _privileges(session) if not cols]),
        "systablecolumnprivilege": ("table_id int, column_name string, grantee string, privilege string, grant_option string", [(number[t.name.lower()], c, b, p, o) for _, b, t, p, cols, o in _privileges(session) for c in cols]),
        "systransaction": ("user_name string, read_only boolean, touched int", [(session.user, session.read_only, len(session.touched))]),
        "sysserver": ("server_name string, version string", [("tessera", session.spark.version)]),
        "sysstatus": ("name string, value string", [("tables", str(len(tables))), ("open catalog", session.catalog), ("user", session.user)]),
    }
    if name not in found:
        raise SqlError(f"no relation CATALOG_DEFINITION_SCHEMA.{name}")
    kinds, rows = found[name]
    return session.spark.createDataFrame(rows, kinds)
