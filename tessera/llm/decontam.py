"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a text with up to ``rate`` times its length in edits.
Cut into one piece more than that budget, at least one piece occurs unchanged:
an Aho-Corasick automaton finds the pieces, and Myers' bit-parallel edit
distance verifies the stretch of text around each hit. Texts and items are
compared as lower-case words joined by single blanks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

RATE = 0.08
BLOCK_CHARS = 1_000_000  # benchmark text that one pass over the documents carries
_WORDS = re.compile(r"\w+")


def normal(text: str | None) -> str:
    return " ".join(_WORDS.findall(text.lower())) if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(start, piece) of ``budget + 1`` near-equal parts."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(cuts[i], item[cuts[i] : cuts[i + 1]]) for i in range(budget + 1)]


def myers(pattern_bits: dict[str, int], m: int, text: str) -> int:
    """Least edit distance between a pattern of ``m`` characters and any
    substring of ``text``. ``pattern_bits`` has the positions of each character."""
    if not m:
        return 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, here = full, 0, m
    best = here
    get = pattern_bits.get
    for c in text:
        eq = get(c, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (~(diag | plus) & full)
        down = plus & diag
        if up & top:
            here += 1
        elif down & top:
            here -= 1
            if here < best:
                best = here
        up = (up << 1) & full  # row 0 is free: a match may start anywhere
        down = (down << 1) & full
        plus = down | (~(diag | up) & full)
        minus = up & diag
    return best


class Matcher:
    """Finds items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items, hits = {}, {}
        for key, (item_id, text) in enumerate(items):
            t = normal(text)
            if not t:
                continue
            budget = int(len(t) * rate)
            bits: dict[str, int] = {}
            for i, c in enumerate(t):
                bits[c] = bits.get(c, 0) | 1 << i
            self.items[key] = (item_id, len(t), budget, bits)
            for at, p in pieces(t, budget):
                # without a budget the whole item is sought, at word bounds
                hits.setdefault(p if budget else f" {t} ", []).append((key, at if budget else -1))
        self.automaton = ahocorasick.Automaton()
        for p, owners in hits.items():
            self.automaton.add_word(p, (len(p), owners))
        if len(self.automaton):
            self.automaton.make_automaton()

    def find(self, text: str | None) -> Iterator[tuple[int, int]]:
        """(item id, least distance) of every item within its budget."""
        t = normal(text)
        if not t or not len(self.automaton):
            return
        t = f" {t} "
        spans: dict[int, list[list[int]]] = {}
        for end, (n, owners) in self.automaton.iter(t):
            for key, at in owners:
                _, m, budget, _ = self.items[key]
                lo = max(0, end - n + 1 - at - budget)
                hi = lo + m + 2 * budget + 1
                held = spans.setdefault(key, [])
                if held and lo <= held[-1][1]:  # hits come by end: overlapping stretches merge
                    held[-1][0], held[-1][1] = min(lo, held[-1][0]), max(hi, held[-1][1])
                else:
                    held.append([lo, hi])
        for key, held in spans.items():
            item_id, m, budget, bits = self.items[key]
            best = budget + 1
            for lo, hi in held:
                best = min(best, myers(bits, m, t[lo:hi])) if budget else 0
                if not best:
                    break
            if best <= budget:
                yield item_id, best


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded size, read one partition at a time."""
    held, size = [], 0
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size >= block_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance: each test item that a document row holds
    within the item's budget, with the least distance.

    One pass over ``docs`` for each block of the benchmark; nothing is
    shuffled. Null or wordless texts and items match nothing; repeated rows
    are reported each; item ids used for several texts count for each. An
    item too short for a budget must occur exactly, at word bounds."""
    spark = docs.sparkSession
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, distance int"
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = None
    for block in blocks(benchmark, block_chars):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            m = Matcher(held.value, rate)
            for b in batches:
                ids, items, dist = [], [], []
                for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    for item, n in m.find(t):
                        ids.append(d)
                        items.append(item)
                        dist.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("doc_id").type), pa.array(items, item_type), pa.array(dist, pa.int32())], names=["doc_id", "item_id", "distance"])

        found = src.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a test item; all columns. Further
    benchmark blocks filter what earlier ones kept, within the same tasks.

    Null, empty and wordless texts stay, as nothing matches them; texts are
    searched whole, however long; equal rows share their fate; null items and ids
    of ``benchmark`` are left out; an empty benchmark keeps all rows and an empty
    ``docs`` gives an empty result."""
    at = docs.columns.index(text_col)
    for block in blocks(benchmark, block_chars):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, held=held):
            m = Matcher(held.value, rate)
            for b in batches:
                yield b.filter(pa.array([next(m.find(t), None) is None for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
