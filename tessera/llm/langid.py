"""Language identification by a byte convolutional network.

A fixed-length window of bytes goes through filters of several widths over
one-hot bytes, a maximum over positions, a rectifier and a softmax layer.
Training is plain numpy (Adam on cross-entropy); gradients of a filter only
reach the window position that won the maximum. A text's prediction averages
the log-probabilities of all its windows, weighted by their length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, opened, shipped
from .training import held_out

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
MAX_TRAIN = 4000  # documents the network is trained on
MAX_LANGS = 1000
WINDOWS_EACH = 3  # windows of each, at positions drawn by the id
UNKNOWN = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def windows(text: bytes, size: int = WINDOW) -> np.ndarray:
    """Consecutive windows of a text; the last is filled up with zero bytes."""
    n = max(1, -(-len(text) // size))
    return np.frombuffer(text.ljust(n * size, b"\0"), np.uint8).reshape(n, size)


@dataclass
class Network:
    langs: list[str]
    filters: list[np.ndarray]  # one (width, 256, FILTERS) table for each width
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def compile(self) -> None:
        """Sums the tables of neighbouring bytes, so that a lookup covers two."""
        self.tables = []
        for t in self.filters:
            w = len(t)
            pairs = [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1).astype(np.float32) for j in range(0, w - 1, 2)]
            self.tables.append((pairs, t[-1].astype(np.float32) if w % 2 else None, w))

    def log_probs(self, wins: np.ndarray) -> np.ndarray:
        """Log-probabilities of each window; compile() must have been called."""
        out = []
        for at in range(0, len(wins), 64):
            x = wins[at : at + 64].astype(np.intp)
            two = (x[:, :-1] << 8) | x[:, 1:]
            n, peaks = x.shape[1], []
            for pairs, single, w in self.tables:
                m = n - w + 1
                a = pairs[0].take(two[:, :m], axis=0, mode="clip")
                for k in range(1, len(pairs)):
                    a += pairs[k].take(two[:, 2 * k : 2 * k + m], axis=0, mode="clip")
                if single is not None:
                    a += single.take(x[:, w - 1 : w - 1 + m], axis=0, mode="clip")
                peaks.append(a.max(axis=1))
            h = np.maximum(np.concatenate(peaks, axis=1) + self.bias, 0)
            z = h @ self.dense + self.dense_bias
            z -= z.max(axis=1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(out)

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        """Language and its probability; und and 0 for texts without a letter."""
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return lang, score
        held: list[tuple[int, np.ndarray, int]] = []
        size = 0
        for i, t in enumerate(texts):
            if t and has_letter(t):
                w = windows(t)
                held.append((i, w, len(t)))
                size += len(w)
                if size >= 1024:
                    self._flush(held, lang, score)
                    held, size = [], 0
        self._flush(held, lang, score)
        return lang, score

    def _flush(self, held, lang, score):
        if not held:
            return
        lp = self.log_probs(np.concatenate([w for _, w, _ in held]))
        at = 0
        for i, w, n in held:
            part, at = lp[at : at + len(w)], at + len(w)
            weight = np.full(len(w), float(WINDOW))
            weight[-1] = n - WINDOW * (len(w) - 1)
            z = (part * weight[:, None]).sum(axis=0) / n
            p = np.exp(z - z.max())
            p /= p.sum()
            best = int(p.argmax())
            lang[i], score[i] = self.langs[best], float(p[best])


def fit(wins: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 4, batch: int = 64, rate: float = 0.02, seed: int = 0) -> Network:
    """Trains the network on windows and language indices."""
    rng = np.random.default_rng(seed)
    c, f = len(langs), FILTERS
    params = [rng.normal(0, 0.1, (w, 256, f)) for w in WIDTHS] + [np.zeros(f * len(WIDTHS)), rng.normal(0, 0.1, (f * len(WIDTHS), c)), np.zeros(c)]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = len(y) / (c * np.maximum(1, np.bincount(y, minlength=c)))  # languages count alike
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            pick = order[at : at + batch]
            x, t = wins[pick], y[pick]
            n, size = x.shape
            peaks, where = [], []
            for k, w in enumerate(WIDTHS):
                a = sum(params[k][j][x[:, j : size - w + 1 + j]] for j in range(w))
                where.append(a.argmax(axis=1))
                peaks.append(np.take_along_axis(a, where[-1][:, None, :], 1)[:, 0])
            pre = np.concatenate(peaks, axis=1) + params[-3]
            h = np.maximum(pre, 0)
            z = h @ params[-2] + params[-1]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), t] -= 1
            p *= weight[t][:, None] / n
            grads = [np.zeros_like(q) for q in params]
            grads[-2], grads[-1] = h.T @ p, p.sum(axis=0)
            dh = (p @ params[-2].T) * (pre > 0)
            grads[-3] = dh.sum(axis=0)
            rows = np.arange(n)[:, None]
            for k, w in enumerate(WIDTHS):
                d = dh[:, k * f : (k + 1) * f]
                for j in range(w):
                    np.add.at(grads[k][j], (x[rows, where[k] + j], np.arange(f)[None, :]), d)
            step += 1
            for q, g, a, b in zip(params, grads, m1, m2):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Network(langs, params[: len(WIDTHS)], *params[len(WIDTHS) :])


def train(docs: DataFrame, mod: int = 4, remainder: int = 2, max_train: int = MAX_TRAIN) -> Network:
    """Learns from text and lang of at most ``max_train`` documents outside the
    held-out fold, those of least hash of their id within each language in
    turn (so that rare languages are seen), WINDOWS_EACH windows of each. Rows
    without a text, a language or an id outside the fold teach nothing. More than
    MAX_LANGS languages are an error, as the network has an output for each."""
    src = docs.select("doc_id", "lang", F.col("text").cast("binary").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id"), mod, remainder))
    langs = sorted(r["lang"] for r in src.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not langs:
        return Network([], [], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    each = max(1, max_train // len(langs))
    draw = F.xxhash64("doc_id")
    # a threshold on the hash, from the counts, keeps each language near its share; limit() sets the bound
    sizes = {r["lang"]: r["n"] for r in src.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.create_map(*[x for l in langs for x in (F.lit(l), F.lit(min(1.0, 1.3 * each / sizes[l])))])
    low = (draw.bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / float(1 << 53)) < F.element_at(share, F.col("lang"))
    sample = src.where(low).select("doc_id", "lang", "text", crc_mod(F.col("doc_id"), 1 << 31).alias("at"))

    def cut(batches):
        for b in batches:
            lang, win, key = [], [], []
            for t, l, at in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), b.column("at").to_pylist()):
                for k in range(WINDOWS_EACH if len(t) > WINDOW else 1):
                    spot = xxhash.xxh32_intdigest(str(at), k) % max(1, len(t) - WINDOW + 1)
                    lang.append(l)
                    win.append(t[spot : spot + WINDOW])
                    key.append(xxhash.xxh32_intdigest(t, k))
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(win, pa.binary()), pa.array(key, pa.int64())], names=["lang", "win", "key"])

    got = sample.mapInArrow(cut, "lang string, win binary, key long").orderBy("key", "win").limit(2 * WINDOWS_EACH * max_train).toArrow()
    code = {l: i for i, l in enumerate(langs)}
    y = np.array([code[l] for l in got["lang"].to_pylist()], np.int64)
    return fit(np.concatenate([windows(w) for w in got["win"].to_pylist()]), y, langs)


def identify(docs: DataFrame, network: Network, mod: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per input row.

    Null texts and those without a letter get ``und`` and score 0. If nothing
    could be learned all rows do. All windows of a text count, however long it
    is; equal rows are answered equally; an empty table gives an empty result.
    Columns besides doc_id and text are ignored."""
    held = shipped(docs.sparkSession, network)

    def run(batches):
        net = opened(held)
        net.compile()
        for b in batches:
            lang, score = net.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    src = docs.select("doc_id", held_out(F.col("doc_id"), mod, remainder).alias("held_out"), F.col("text").cast("binary").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
