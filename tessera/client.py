"""A connection and cursor client in the manner of Python's database interface."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession

from .plans.parser import SqlError
from .session import Session

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"
Error = DatabaseError = ProgrammingError = SqlError


def connect(spark: SparkSession, folder: str | None = None, user: str = "DEFAULT", password: str | None = None) -> Connection:
    """A connection to a new session, with the tables of ``folder``."""
    session = Session(spark)
    if folder:
        session.load(folder)
    session.do_connect("", user, password)
    return Connection(session)


class Connection:
    def __init__(self, session: Session):
        self.session, self.closed = session, False

    def cursor(self) -> Cursor:
        if self.closed:
            raise SqlError("the connection is closed")
        return Cursor(self)

    def commit(self) -> None:
        self.session.do_commit()

    def rollback(self) -> None:
        self.session.do_rollback()

    def close(self) -> None:
        if not self.closed:
            self.session.do_disconnect()
        self.closed = True

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, kind, *_) -> None:
        self.rollback() if kind else self.commit()
        self.close()


class Cursor:
    """Rows come partition by partition as they are fetched; only fetchall()
    brings a whole result to the client."""

    arraysize = 1

    def __init__(self, connection: Connection):
        self.connection, self.rowcount = connection, -1
        self.description: list[tuple] | None = None
        self._rows: Iterator = iter(())
        self._more: list[DataFrame] = []

    def _show(self, df: DataFrame) -> None:
        self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in df.schema]
        self._rows = df.toLocalIterator()

    def execute(self, sql: str, params: Sequence = ()) -> Cursor:
        out = self.connection.session.execute(sql, tuple(params))
        self.description, self._rows, self.rowcount, self._more = None, iter(()), -1, []
        if isinstance(out, DataFrame):
            self._show(out)
        elif isinstance(out, list):
            self._more = out
            self.nextset()
        elif isinstance(out, int):
            self.rowcount = out
        return self

    def executemany(self, sql: str, rows: Sequence[Sequence]) -> Cursor:
        total = 0
        for r in rows:
            self.execute(sql, r)
            total += max(0, self.rowcount)
        self.rowcount = total
        return self

    def callproc(self, name: str, params: Sequence = ()) -> Sequence:
        self.execute(f"CALL {name}({', '.join('?' * len(params))})", params)
        return params

    def nextset(self) -> bool | None:
        if not self._more:
            return None
        self._show(self._more.pop(0))
        return True

    def fetchone(self) -> tuple | None:
        row = next(self._rows, None)
        return None if row is None else tuple(row)

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        return [tuple(r) for _, r in zip(range(size or self.arraysize), self._rows)]

    def fetchall(self) -> list[tuple]:
        return [tuple(r) for r in self._rows]

    def __iter__(self) -> Iterator[tuple]:
        return map(tuple, self._rows)

    def close(self) -> None:
        self._rows = iter(())
