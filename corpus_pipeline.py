"""The corpus pipeline: five of the training-data operators in a row.

Each stage takes (spark, docs, sf_dir) and returns what the next one works on,
written as Parquet in between. Whole texts are read, however long; further columns are
kept, whatever their names. All but the last return the columns of
``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, linededup, packing, simhash, toxicity
from tessera.llm.common import released, staged, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7. The lexicon is learned
    from the labelled ones among ``docs`` outside the held-out fold. Null and
    empty texts stay; equal rows share their fate; without labels nothing goes."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines cut out, as op9 does; n_chars follows the
    text. All rows stay, null and empty texts as they are."""
    gone = unused(docs, "lines_gone")
    out = linededup.dedup_lines(docs, removed_col=gone)
    return out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies: sets of
    five-word shingles with a Jaccard similarity of at least 0.8. Null, empty and
    wordless texts are one group. Rows without an id, and rows that repeat the kept id, stay."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and wordless texts stay;
    without a benchmark all do."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences: a row for each piece, of 0
    tokens for null and empty texts; rows without an id are packed like others."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("decontamination", decontaminate), ("packing", pack)]

#: SQL can express neither the automata nor the edit distance; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; an empty table gives an empty result."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            released(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
