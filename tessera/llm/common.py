"""Shared plumbing: the shared staging folder, table reads, Arrow text access."""

from __future__ import annotations

import atexit
import pickle
import shutil
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: \x20 and \x09-\x0D.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dirs: dict[str, str] = {}
_paths: dict = {}  # staged folders that still stand, and the context that wrote each


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for
    local masters that leave it unset (tests)."""
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _local_dirs[app], True)
    return _local_dirs[app]


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without
    recomputing ``df``, and several consumers share one computation. The
    shuffle files of the finished write are of no more use and go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    if not _paths:
        atexit.register(_clear)
    _paths[path] = spark.sparkContext
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def _delete(sc, path: str) -> None:
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def released(df: DataFrame) -> None:
    """Deletes what ``staged`` wrote for ``df``, once nothing reads it any more."""
    path = df._staged_at
    _delete(_paths.pop(path), path)


def _clear() -> None:
    """At the driver's end: what results were read from until then."""
    for path, sc in list(_paths.items()):
        try:
            _delete(sc, path)
        except Exception:  # the JVM is gone, or the folder
            return


def shipped(spark: SparkSession, value):
    """A broadcast of ``value`` that workers without this package can open:
    its class travels in the bytes, as functions do."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(held):
    return pickle.loads(held.value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col, mod: int):
    """crc32(id as text) mod ``mod``; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` lacks (names compare without case)."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name
