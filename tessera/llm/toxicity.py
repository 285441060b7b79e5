"""Toxicity by a weighted lexicon.

Texts are folded (case, look-alike letters, digit substitutions) and matched
by an Aho-Corasick automaton over whole words. A match inside an exception
phrase does not count. The weights of the matches, damped when a term repeats,
are normalised by text length and put through a fitted sigmoid. Weights are
log odds of a term's document frequency in toxic against other documents. All
words that are telling enough become terms: only the sample is bounded.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from math import exp, log, log1p, log2

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import opened, shipped
from .nbsvm import platt
from .training import held_out, labelled_sample

MAX_TRAIN = 12000  # labelled rows that the lexicon is learned from
LEAST_DOCS, LEAST_WEIGHT = 4, 3.0  # of a term: toxic documents that have it, and log odds
SMOOTH = 0.1  # added to document counts
LEAST_EXCEPTION = 3  # clean documents of an exception phrase, which no toxic one may have

#: Look-alike letters (Cyrillic, Greek, full-width) and the Latin letter each stands for.
LOOK_ALIKES = dict(zip("аӏвсԁеһіјкӏмнорԛѕтԝхуαβεηικνορτυχωｏｅａｉ", "aibcdehijkimhopqstwxyabeniknoptuxwoeai"))
#: Digits and signs written for letters. l and 1 both fold to i.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i"}

FOLD = {ord(k): v for k, v in (LOOK_ALIKES | SUBSTITUTES).items()}
FOLD |= {c: " " for c in range(128) if not chr(c).isalnum() and c not in FOLD}
FOLD |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}  # invisible characters


def fold(text: str) -> str:
    """Folded text: every word preceded by one blank."""
    return " " + " ".join(text.lower().translate(FOLD).split())


@dataclass
class Lexicon:
    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)  # phrases in which a term does not count
    slope: float = 1.0
    offset: float = -4.0

    def automaton(self):
        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(fold(t) + " ", (len(fold(t)) + 1, t, w))
        for p in self.exceptions:
            a.add_word(fold(p) + " ", (len(fold(p)) + 1, None, 0.0))
        if len(a):
            a.make_automaton()
        return a

    def strength(self, text: str, automaton) -> float:
        """Sum of the damped weights of the matches, over the log of the length."""
        if not text or not len(automaton):
            return 0.0
        folded = fold(text) + " "
        hits, spans = [], []
        for end, (n, term, weight) in automaton.iter(folded):
            (hits if term is not None else spans).append((end - n + 1, end, term, weight))
        if not hits:
            return 0.0
        times: Counter = Counter()
        weights = {}
        spans.sort()
        at, reach = 0, -1  # hits and spans both by start: the furthest end of spans begun so far
        for start, end, term, weight in sorted(hits, key=lambda h: h[:2]):
            while at < len(spans) and spans[at][0] <= start:
                reach = max(reach, spans[at][1])
                at += 1
            if end <= reach:
                continue
            times[term] += 1
            weights[term] = weight
        total = sum(weights[t] * (1 + log(n)) for t, n in times.items())
        return total / log2(folded.count(" ") + 16)

    def score(self, text: str, automaton) -> float:
        x = self.slope * log1p(max(0.0, self.strength(text, automaton))) + self.offset
        return 1 / (1 + exp(-min(max(x, -30.0), 30.0)))


def words(text: str) -> set[str]:
    """The distinct words of a folded text."""
    return set(fold(text).split())


def log_odds(a: float, b: float, toxic: int, clean: int) -> float:
    """Weight of a word in ``a`` of ``toxic`` and ``b`` of ``clean`` documents."""
    return log((a + SMOOTH) / (toxic + 1)) - log((b + SMOOTH) / (clean + 1))


def choose_terms(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """The words, by (toxic, clean) document counts, that are frequent and telling enough."""
    weight = {t: log_odds(a, b, toxic, clean) for t, (a, b) in sorted(counts.items()) if a >= LEAST_DOCS}
    return {t: w for t, w in weight.items() if w >= LEAST_WEIGHT}


def _marks(batches):
    """Adds a key that near copies mostly share: the least hash of the text's word triples."""
    digest = xxhash.xxh64_intdigest
    for b in batches:
        keys = []
        for t in b.column("text").to_pylist():
            w = t.split()
            keys.append(min((digest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0) >> 1)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], names=[*b.schema.names, "copy_key"])


def _term_counts(batches):
    toxic: Counter = Counter()
    clean: Counter = Counter()
    for b in batches:
        for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
            (toxic if y else clean).update(words(t))
        if len(clean) + len(toxic) > 500_000:
            yield _count_batch(toxic, clean)
            toxic, clean = Counter(), Counter()
    yield _count_batch(toxic, clean)


def _count_batch(toxic, clean):
    terms = list(toxic | clean)
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], names=["term", "a", "b"])


def _contexts(terms):
    """Pairs of words that hold a term, for clean and toxic texts."""

    def run(batches):
        for b in batches:
            out: Counter = Counter()
            for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                w = fold(t).split()
                held = [x in terms for x in w]
                out.update({(f"{w[i]} {w[i + 1]}", y) for i in range(len(w) - 1) if held[i] or held[i + 1]})
            pairs = list(out.items())
            yield pa.RecordBatch.from_arrays([pa.array([p for (p, _), _ in pairs], pa.string()), pa.array([n if y else 0 for (_, y), n in pairs], pa.int64()), pa.array([0 if y else n for (_, y), n in pairs], pa.int64())], names=["term", "a", "b"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 3, remainder: int = 1, max_train: int = MAX_TRAIN) -> Lexicon:
    """Learns terms, exception phrases and the sigmoid from at most
    ``max_train`` labelled rows outside the held-out fold. Near copies in the
    sample count once. Null texts count as empty; rows without a label or an id
    teach nothing; with no toxic row no term is learned and all scores are low."""
    s = labelled_sample(docs, labels, label, mod, remainder, max_train)
    kind = s.schema["doc_id"].dataType.simpleString()
    s = s.select("doc_id", "label", "text").mapInArrow(_marks, f"doc_id {kind}, label int, text string, copy_key long")
    s = s.groupBy("copy_key", "label").agg(F.min(F.struct("doc_id", "text")).alias("x")).select("label", "x.text").persist()
    try:
        sizes = {r["label"]: r["n"] for r in s.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        sums = (F.sum("a").alias("a"), F.sum("b").alias("b"))
        toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
        odds = F.log((F.col("a") + SMOOTH) / (toxic + 1)) - F.log((F.col("b") + SMOOTH) / (clean + 1))
        got = s.mapInArrow(_term_counts, "term string, a long, b long").groupBy("term").agg(*sums).where((F.col("a") >= LEAST_DOCS) & (odds >= LEAST_WEIGHT - 1e-6)).collect()
        terms = choose_terms({r["term"]: (r["a"], r["b"]) for r in got}, toxic, clean)
        pairs = s.mapInArrow(_contexts(frozenset(terms)), "term string, a long, b long").groupBy("term").agg(*sums).where((F.col("b") >= LEAST_EXCEPTION) & (F.col("a") == 0))
        lexicon = Lexicon(terms, sorted(r["term"] for r in pairs.collect()))
        held = shipped(s.sparkSession, lexicon)

        def strengths(batches):
            lex = opened(held)
            a = lex.automaton()
            for b in batches:
                x = [log1p(max(0.0, lex.strength(t, a))) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), b.column("label")], names=["x", "label"])

        got = s.mapInArrow(strengths, "x double, label int").toArrow().sort_by([("x", "ascending"), ("label", "ascending")])  # of the sample
    finally:
        s.unpersist()
    y = got["label"].to_pylist()
    if len(set(y)) == 2:
        lexicon.slope, lexicon.offset = platt(got["x"].to_pylist(), y)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, cut: float = 0.7, mod: int = 3, remainder: int = 1, text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= ``cut``):
    one row per input row. Null, empty and matchless texts get the least score.
    Texts are scored whole, however long; equal rows score equally; an empty
    table gives an empty result. Columns besides doc_id and the text are ignored."""
    held = shipped(docs.sparkSession, lexicon)

    def run(batches):
        lex = opened(held)
        a = lex.automaton()
        for b in batches:
            s = [lex.score(t, a) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    src = docs.select("doc_id", held_out(F.col("doc_id"), mod, remainder).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= cut).cast("int"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, cut: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``cut``.
    Null and empty texts stay, as they score least."""
    held = shipped(docs.sparkSession, lexicon)
    at = docs.columns.index(text_col)

    def run(batches):
        lex = opened(held)
        a = lex.automaton()
        for b in batches:
            yield b.filter(pa.array([lex.score(t or "", a) < cut for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
