"""Bounded, documented training samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod


def held_out(col, mod: int, remainder: int):
    return crc_mod(col, mod) == remainder


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, remainder: int, max_rows: int) -> DataFrame:
    """(doc_id, text, label): at most ``max_rows`` labelled documents outside
    the held-out fold, those of least hash of their id, one row an id (that of the least text).

    Labels other than 0 and 1 are ignored; an id labelled twice counts as its
    largest label. Only the picked ids (at most ``max_rows``) are broadcast,
    so the texts are filtered where they are read, without a shuffle."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), mod, remainder))
    ids = ids.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
