"""Quality classifier: a linear support vector machine on n-gram indicators
scaled by their class log-count ratios, fitted by dual coordinate descent."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import opened, shipped
from .training import held_out, labelled_sample

BITS = 18
MAX_TRAIN = 8000  # labelled rows that the model is fitted on
TOKEN = r"\w+|[^\w\s]+"


def _spread(h: np.ndarray, bits: int) -> np.ndarray:
    return (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def grams(text: str, bits: int = BITS) -> np.ndarray:
    """Sorted distinct hashed indicators of a text's word and punctuation
    n-grams: single tokens, pairs, tokens seen 4 or 16 times, and the share of
    tokens that are new to the text, in eighths (loops and copied lines)."""
    words = re.findall(TOKEN, text)
    if not words:
        return np.zeros(0, np.int32)
    digest = xxhash.xxh64_intdigest
    known = {w: digest(w) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    one, times = np.unique(h, return_counts=True)
    marks = [one, h[:-1] * np.uint64(31) + h[1:], one[times >= 4] + np.uint64(1), one[times >= 16] + np.uint64(2), np.array([8 * len(one) // len(words) + 3], np.uint64)]
    return np.unique(_spread(np.concatenate(marks), bits)).astype(np.int32)


@dataclass
class Model:
    ratio: np.ndarray  # log-count ratio of each indicator
    weight: np.ndarray  # weight times ratio
    bias: float
    slope: float  # score = sigmoid(slope * margin + offset)
    offset: float

    def margin(self, idx: np.ndarray) -> float:
        if not len(idx):
            return self.bias
        r = self.ratio[idx]
        return float(self.weight[idx].sum() / max(np.sqrt((r * r).sum()), 1e-6) + self.bias)

    def score(self, idx: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(idx) + self.offset, -30, 30))))


def log_count_ratio(rows, y, dims: int, alpha: float = 1.0) -> np.ndarray:
    count = [np.full(dims, alpha), np.full(dims, alpha)]
    for idx, label in zip(rows, y):
        count[label][idx] += 1
    return np.log(count[1] / count[1].sum() * count[0].sum() / count[0])


def dual_descent(rows, y, ratio, c: float = 1.0, epochs: int = 12, seed: int = 0):
    """Hinge loss with an L2 penalty: each step solves one sample's dual
    variable in closed form and keeps w in step. Classes weigh the same."""
    sign = np.where(np.asarray(y) == 1, 1.0, -1.0)
    n, pos = len(sign), max(1, int((sign > 0).sum()))
    cap = np.where(sign > 0, c * n / (2 * pos), c * n / (2 * max(1, n - pos)))
    xs = []
    for idx in rows:
        r = ratio[idx]
        xs.append(r / max(np.sqrt((r * r).sum()), 1e-6))
    q = np.array([float((x * x).sum()) + 1.0 for x in xs])  # 1 for the bias
    w, b, a = np.zeros(len(ratio)), 0.0, np.zeros(n)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(n):
            g = sign[i] * (float(w[rows[i]] @ xs[i]) + b) - 1.0
            new = min(max(a[i] - g / q[i], 0.0), cap[i])
            if new != a[i]:
                step = (new - a[i]) * sign[i]
                w[rows[i]] += step * xs[i]
                b += step
                a[i] = new
    return w, b


def platt(margins, y, steps: int = 50):
    """Sigmoid through (margin, label) with smoothed targets, by Newton steps."""
    m, y = np.asarray(margins, float), np.asarray(y, float)
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    s, o = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(s * m + o, -30, 30)))
        d, h = p - t, p * (1 - p) + 1e-9
        g = np.array([(d * m).sum(), d.sum()])
        hess = np.array([[(h * m * m).sum() + 1e-6, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        s, o = s - step[0], o - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(float(s), 1e-3), float(o)


def fit(rows: list[np.ndarray], y: list[int], bits: int = BITS) -> Model:
    """A model; the sigmoid is fitted on a fifth that a first fit left out.
    With one class or no rows every score is that class's share."""
    dims = 1 << bits
    y = [int(v) for v in y]
    if len(set(y)) < 2:
        share = (sum(y) + 1) / (len(y) + 2)
        return Model(np.zeros(dims), np.zeros(dims), 0.0, 1.0, float(np.log(share / (1 - share))))
    fold = np.arange(len(y)) % 5 == 0
    slope, offset = 2.0, 0.0
    inner = [i for i in range(len(y)) if not fold[i]]
    outer = [i for i in range(len(y)) if fold[i]]
    if len({y[i] for i in inner}) == 2 and len({y[i] for i in outer}) == 2:
        ir, iy = [rows[i] for i in inner], [y[i] for i in inner]
        r = log_count_ratio(ir, iy, dims)
        w, b = dual_descent(ir, iy, r)
        part = Model(r, w * r, b, 1.0, 0.0)
        slope, offset = platt([part.margin(rows[i]) for i in outer], [y[i] for i in outer])
    r = log_count_ratio(rows, y, dims)
    w, b = dual_descent(rows, y, r)
    return Model(r.astype(np.float32), (w * r).astype(np.float32), b, slope, offset)


def _gram_batches(batches):
    for b in batches:
        found = pa.array([grams(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), found], names=["doc_id", "label", "grams"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 5, remainder: int = 0, max_train: int = MAX_TRAIN) -> Model:
    """Fits on at most ``max_train`` labelled rows outside the held-out fold.
    Null texts count as empty; labels other than 0 and 1 and rows without an
    id teach nothing; of several texts of one id the least is taken; without
    labelled rows every score is 0.5."""
    sample = labelled_sample(docs, labels, label, mod, remainder, max_train)
    kind = sample.schema["doc_id"].dataType.simpleString()
    got = sample.select("doc_id", "label", "text").mapInArrow(_gram_batches, f"doc_id {kind}, label int, grams array<int>").toArrow()
    order = sorted(range(got.num_rows), key=lambda i, ids=got["doc_id"].to_pylist(): (xxhash.xxh32_intdigest(str(ids[i])), ids[i]))
    values = got["grams"].to_pandas().to_list()
    y = got["label"].to_pylist()
    return fit([np.asarray(values[i], np.int32) for i in order], [y[i] for i in order])


def score(docs: DataFrame, model: Model, cut: float = 0.3, mod: int = 5, remainder: int = 0) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= ``cut``):
    one row per input row. Null and empty texts get the score of a text
    without n-grams. Texts are read whole, however long; equal rows score
    equally; an empty table gives an empty result. Columns besides doc_id and
    text are ignored."""
    held = shipped(docs.sparkSession, model)

    def run(batches):
        m = opened(held)
        for b in batches:
            s = [m.score(grams(t or "")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    src = docs.select("doc_id", held_out(F.col("doc_id"), mod, remainder).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= cut).cast("int"))
