"""Table files: reading a folder of Parquet tables, settled versions, backups."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_temporary: dict[str, str] = {}
_written: dict = {}  # table versions in a named folder, and the context that wrote each


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors
    share; a temporary one only where a local master leaves it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _temporary:
        _temporary[app] = tempfile.mkdtemp(prefix="tessera-tables-")
        atexit.register(shutil.rmtree, _temporary[app], True)
    return _temporary[app]


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes a table version and reads it back, which ends its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_clear)
    _written[path] = df.sparkSession.sparkContext
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def _clear() -> None:
    """At the driver's end: versions live as long as the sessions that made them."""
    for path, sc in _written.items():
        try:
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM is gone
            return


def path_of(df: DataFrame) -> str:
    """Where ``settle`` wrote a table version."""
    return df._settled_at


def read_parts(spark: SparkSession, schema, parts) -> DataFrame:
    """One scan over several folders of one table."""
    return spark.read.schema(schema).parquet(*parts)


def table_path(folder: str, name: str) -> str:
    return f"{folder}/{name}.parquet"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(folder, name))


def backup(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes every table of a catalog as ``folder/name.parquet``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
