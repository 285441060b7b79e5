"""Repeated byte strings across documents by a run-length suffix index.

Every ``length``-byte string (window) is routed by its minimizer, the 16-byte
gram of least hash in it; windows in a row with one minimizer form a stretch.
Equal strings have equal minimizers, so what repeats meets under one minimizer.
Stretches travel as pairs of hashes first: of equal stretches only the one of the
smallest document goes on, and of several different stretches under one minimizer
only those need bytes that agree with another one around it as far as a shared window
must (16-bit hashes of these contexts travel along, so that chance meetings of 16 bytes,
which grow faster than the corpus, end there). Those stretches go into run-length indexes (a Burrows-Wheeler
transform kept in runs, with the text place sampled at both ends of each run),
and every stretch that has a smaller document beside it is streamed through as
a query: its matching statistics say where at least ``length`` bytes match, and
in which block of the index; a window goes if the block holds a smaller document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, staged

U = np.uint64
LENGTH = 50
GRAM = 16
POSITION = U(19)  # low bits of a gram's hash that its place in a chunk takes
BINS = 4  # contexts of a stretch: one for each quarter of the places that a window can have around its minimizer
PIECE = 40  # windows of a stretch at most; longer ones (of one repeated letter, say) are cut
CHUNK = 1 << 18  # bytes of a text whose hashes are held at a time
PACK = 1 << 16  # short texts are hashed together up to so many bytes
SLICE_BYTES = 8 << 20  # bytes of texts, or of stretches, that a task works on at a time
UNIT_BYTES = 1 << 19  # stretches indexed together: whole minimizers, from about this many bytes on
#: A minimizer expected in more stretches than this, or than a millionth of all, is cut into single windows.
COMMON = 4096
SAMPLE_HITS = 64  # times that such a minimizer is expected in the sample of texts that finds it
LAST = np.iinfo(np.int64).max  # stands for a null id: no document is later
BARRIER = 0xFF  # never a byte of UTF-8
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse mod 2^64


# ------------------------------------------------------------------ minimizers
def eight_bytes(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on (zeros after the end), the first lowest."""
    a = np.concatenate((text, np.zeros(7, np.uint8))).astype(U)
    for s in (1, 2, 4):
        a = a[:-s] | (a[s:] << U(8 * s))
    return a


def gram_hashes(text: bytes, k: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each k-byte gram (k a multiple of 8)."""
    a = eight_bytes(np.frombuffer(text, np.uint8))
    n = len(text) - k + 1
    h = np.zeros(n, U)
    for j in range(0, k, 8):
        h ^= a[j : j + n]
        h *= U(BASE)
        h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse, mod 2^64."""
    if n not in _tables:
        up, down = (np.full(n, x, U) for x in (BASE, pow(BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _tables[n] = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    return _tables[n]


def stretches(text: bytes, length: int = LENGTH, common: np.ndarray | None = None, k: int = GRAM, contexts: bool = False) -> np.ndarray:
    """Rows (minimizer's hash, hash of the stretch's bytes, first window, end
    of windows), as integers, of a text's stretches in order. Stretches of minimizers in
    ``common`` (sorted) are cut into windows, routed by their own hashes.

    With ``contexts`` a fifth row: BINS hashes of 16 bits, the first lowest. A window's
    anchor is the leftmost place of its minimizer, at one of ``length - k + 1`` offsets;
    the hash of a bin of offsets is of the bytes around the anchor that all windows with
    such an offset hold, and 0 if the stretch has no such window. Stretches that share a
    window agree in a bin that is not 0 for either. All are 0 if anchors differ within the stretch."""
    return stretches_of([text], length, common, k, contexts)[1]


def stretches_of(texts: list[bytes], length: int = LENGTH, common: np.ndarray | None = None, k: int = GRAM, contexts: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of several texts: which text each is of, and their rows as above."""
    found = [_stretches(*pack, length, common, k, contexts) for pack in _packs(texts, length)]
    if not found:
        return np.zeros(0, np.int64), np.zeros((4 + contexts, 0), np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found], axis=1)


def _packs(texts: list[bytes], length: int):
    """(bytes, their texts, places in these) of chunks of long texts and of short texts together."""
    held, owner, place, size = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), CHUNK):
            part = text[at : at + CHUNK + length - 1]
            if held and size + len(part) > PACK:
                yield held, owner, place
                held, owner, place, size = [], [], [], 0
            held.append(part)
            owner.append(i)
            place.append(at)
            size += len(part)
    if held:
        yield held, owner, place


def _stretches(held, owner, place, length, common, k, contexts):
    up, down = powers(CHUNK + length)
    ends = np.cumsum([len(x) for x in held])
    starts = ends - np.fromiter(map(len, held), np.int64, len(held))
    h = gram_hashes(b"".join(held), k)
    n = int(ends[-1]) - length + 1
    m, span, s = (h >> POSITION << POSITION) | np.arange(len(h), dtype=U), length - k + 1, 1
    while 2 * s <= span:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    if s < span:
        m = np.minimum(m[:n], m[span - s : span - s + n])
    m, anchor = m >> POSITION, m
    edge = np.concatenate(([True], m[1:] != m[:-1]))
    edge[starts] = True
    edge[ends[:-1] - length + 1] = True  # windows from here on reach into the next text
    lo = np.flatnonzero(edge)
    hi = np.append(lo[1:], n)
    nth = np.searchsorted(starts, lo, side="right") - 1
    if len(held) > 1:
        whole = lo + length <= ends[nth]
        lo, hi, nth = lo[whole], hi[whole], nth[whole]
    most = np.full(len(lo), PIECE)
    if common is not None and len(common):
        most[_held(m[lo], common)] = 1
    if (hi - lo > most).any():
        cuts = -(-(hi - lo) // most)
        step = (np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * np.repeat(most, cuts)
        lo, hi, nth, most = np.repeat(lo, cuts) + step, np.repeat(hi, cuts), np.repeat(nth, cuts), np.repeat(most, cuts)
        hi = np.minimum(hi, lo + most)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(h * up[: len(h)], dtype=U)))
    key = (sums[hi + (length - k)] - sums[lo]) * down[lo] + (hi - lo).astype(U) * U(0xC2B2AE3D27D4EB4F)
    key = (key ^ (key >> U(32))) * U(0xD6E8FEB86659FD93)
    key ^= key >> U(29)
    base = (np.array(place) - starts)[nth]
    rows = [np.where(most == 1, key, m[lo]).view(np.int64), key.view(np.int64), lo + base, hi + base]
    if contexts:
        rows.append(_contexts(anchor[lo], anchor[hi - 1], lo, hi, sums, down, length, k))
    return np.array(owner)[nth], np.stack(rows)


def _contexts(anchor, last, lo, hi, sums, down, length, k) -> np.ndarray:
    place = (anchor & ((U(1) << POSITION) - U(1))).astype(np.int64)
    least, most, top = place - hi + 1, place - lo, len(sums) - 1
    edge, out = [(length - k + 1) * j // BINS for j in range(BINS + 1)], np.zeros(len(lo), U)
    for j, (a, b) in enumerate(zip(edge, edge[1:])):
        x, y = np.maximum(place - a, 0), np.minimum(place + length - b + 2 - k, top)  # grams of the bytes
        hashed = ((sums[y] - sums[x]) * down[x] * U(0xD6E8FEB86659FD93)) >> U(48)
        out |= np.where((least < b) & (most >= a), np.maximum(hashed, U(1)), U(0)) << U(16 * j)
    return np.where(anchor == last, out, U(0)).view(np.int64)


def _held(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values the sorted array ``known`` has."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


# ------------------------------------------------------------- run-length index
def sorted_suffixes(text: np.ndarray, length: int):
    """Suffix order of barrier-ended stretches, barriers ranked by place, and
    for each row whether it shares ``length`` bytes with the row before."""
    n, first = len(text), 6
    wide = np.concatenate((text, np.full(first, BARRIER, np.uint8))).astype(U)
    key, open_ = np.zeros(n, U), np.ones(n, bool)
    for j in range(first):  # six bytes, nothing past a barrier
        c = wide[j : j + n]
        key = (key << U(8)) | np.where(open_, c, U(0))
        open_ &= c != BARRIER
    # suffixes that end in these bytes rank by their stretch as well
    stretch = np.cumsum(text == BARRIER) - (text == BARRIER)
    tie = np.where(open_, 0, stretch + 1).astype(U)
    if int(stretch[-1]) < 0xFFFF:
        key = (key << U(16)) | tie
        sa = np.argsort(key)
        new = key[sa][1:] != key[sa][:-1]
    else:
        sa = np.lexsort((tie, key))
        new = (key[sa][1:] != key[sa][:-1]) | (tie[sa][1:] != tie[sa][:-1])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.cumsum(np.concatenate(([0], new)))
    places, span, partial = np.arange(n), first, None
    while True:
        if span <= length < 2 * span:
            partial, here = rank.copy(), span
        top = int(rank.max())
        if top == n - 1 and partial is not None:
            break
        if top < n - 1:
            key = rank[:n] * (n + 1) + rank[np.minimum(places + span, n)] + 1
            sa = np.argsort(key)
            k = key[sa]
            rank[sa] = np.cumsum(np.concatenate(([0], k[1:] != k[:-1])))
        span *= 2
    i, j = sa[1:], sa[:-1]
    off = length - here
    same = (partial[i] == partial[j]) & (partial[np.minimum(i + off, n)] == partial[np.minimum(j + off, n)])
    return sa, np.concatenate(([False], same))


class RunLengthIndex:
    """Run-length Burrows-Wheeler index of stretches of bytes, each of one
    document. Kept: the runs, the text places of both ends of each, the blocks
    of rows that share ``length`` bytes with the least document of each, and
    the bytes of the text, eight at a time, that match lengths are read off."""

    def __init__(self, held: list[bytes], docs: np.ndarray, length: int = LENGTH):
        sep = bytes([BARRIER])
        text = np.frombuffer(sep.join(held) + sep, np.uint8)
        n, self.length = len(text), length
        self.rows = n
        sa, same = sorted_suffixes(text, length)
        last = text[sa - 1]  # the byte before each suffix
        # a row after a barrier is a run of its own: no match steps past the start of a stretch
        self.run_start = np.flatnonzero(np.concatenate(([True], (last[1:] != last[:-1]) | (last[1:] == BARRIER))))
        self.run_byte = last[self.run_start].astype(np.int64)
        size = np.diff(np.append(self.run_start, n))
        self.run_last = self.run_start + size - 1
        self.head_place, self.tail_place = sa[self.run_start], sa[self.run_last]
        order = np.argsort(self.run_byte, kind="stable")
        self.run_first = np.empty(len(size), np.int64)  # row that the first row of a run steps to
        self.run_first[order] = np.cumsum(size[order]) - size[order]
        self.by_byte = self.run_byte[order] * len(size) + order  # runs by byte, for the nearest one of a byte
        self.words = eight_bytes(text)
        self.block_start = np.flatnonzero(~same)
        owner = np.cumsum(text == BARRIER) - (text == BARRIER)
        self.block_least = np.minimum.reduceat(np.asarray(docs, np.int64)[owner[sa]], self.block_start)

    def _common(self, place: np.ndarray, query: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes (up to ``most``) that the text at each place shares with the
        query at ``at``; both are given as eight bytes from each place on."""
        got, live, done = np.zeros(len(place), np.int64), np.flatnonzero(most > 0), 0
        while len(live):
            x = self.words[np.minimum(place[live] + done, self.rows - 1)] ^ query[np.minimum(at[live] + done, len(query) - 1)]
            same = (np.bitwise_count((x & (~x + U(1))) - U(1)) >> 3).astype(np.int64)  # of the lowest bytes
            got[live] = done + same
            done += 8
            live = live[(same == 8) & (most[live] > done)]
        return np.minimum(got, most)

    def _jump(self, run, c, size, query, at):
        """Where a match goes on that the byte ``c`` before it does not extend:
        the nearer end of the nearest runs of ``c`` above and below, whichever
        matches longer. Gives run, row and length before the step; -1 for no run."""
        n = len(self.run_start)
        below = np.searchsorted(self.by_byte, c * n + run)
        down, above = np.minimum(below, n - 1), np.maximum(below - 1, 0)
        has_down = (below < n) & (self.by_byte[down] // n == c)
        has_above = (below > 0) & (self.by_byte[above] // n == c)
        down, above = self.by_byte[down] % n, self.by_byte[above] % n
        m_down = np.where(has_down, self._common(self.head_place[down], query, at, np.where(has_down, size, 0)), -1)
        m_above = np.where(has_above, self._common(self.tail_place[above], query, at, np.where(has_above, size, 0)), -1)
        lower = m_down >= m_above
        got = np.where(lower, down, above)
        row = np.where(lower, self.run_start[down], self.run_last[above])
        return np.where(has_down | has_above, got, -1), row, np.maximum(m_down, m_above)

    def matching_statistics(self, query: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of barrier-ended queries the length of the longest
        match that starts there (``length`` if it is longer), and a row of the
        index that has it. All queries stream at once, from their ends leftwards."""
        ends = np.cumsum(sizes + 1) - 1
        order = np.argsort(-sizes, kind="stable")
        ends, down = ends[order], -sizes[order]
        length, rows, words = np.zeros(len(query), np.int64), np.zeros(len(query), np.int64), eight_bytes(query)
        row, got = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for t in range(1, int(sizes.max(initial=0)) + 1):
            m = int(np.searchsorted(down, -t, side="right"))  # queries of t bytes or more
            row, got, place = row[:m], got[:m], ends[:m] - t
            c = query[place].astype(np.int64)
            run = np.searchsorted(self.run_start, row, side="right") - 1
            miss = np.flatnonzero(self.run_byte[run] != c)
            if len(miss):
                run[miss], row[miss], got[miss] = self._jump(run[miss], c[miss], got[miss], words, place[miss] + 1)
            row, got = np.where(run >= 0, self.run_first[run] + row - self.run_start[run], 0), np.where(run >= 0, np.minimum(got + 1, self.length), 0)
            length[place], rows[place] = got, row
        return length, rows

    def least_documents(self, rows: np.ndarray) -> np.ndarray:
        """The smallest document that holds the ``length`` bytes at each row."""
        return self.block_least[np.searchsorted(self.block_start, rows, side="right") - 1]


def repeated(group: np.ndarray, held: list[bytes], docs: np.ndarray, length: int = LENGTH):
    """(stretch, first byte, end) of the runs of bytes under windows that a
    stretch of the same group and of a smaller document holds as well. Groups
    come together; one stretch has one document."""
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(heads, len(group)))
    low, high = (np.repeat(f.reduceat(docs, heads), size) for f in (np.minimum, np.maximum))
    known, asked = np.flatnonzero(docs < high), np.flatnonzero(docs > low)
    if not len(asked):
        return np.zeros((3, 0), np.int64)
    index = RunLengthIndex([held[i] for i in known], docs[known], length)
    sep = bytes([BARRIER])
    query = np.frombuffer(sep.join([held[i] for i in asked]) + sep, np.uint8)
    sizes = np.fromiter((len(held[i]) for i in asked), np.int64, len(asked))
    ends = np.cumsum(sizes + 1)
    match, rows = index.matching_statistics(query, sizes)
    at = np.flatnonzero(match >= length)
    owner = np.searchsorted(ends, at, side="right")
    goes = index.least_documents(rows[at]) < docs[asked][owner]
    at, owner = at[goes], owner[goes]
    if not len(at):
        return np.zeros((3, 0), np.int64)
    first = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(owner) > 0)))
    a, b, o = at[first], at[np.append(np.flatnonzero(first)[1:] - 1, len(at) - 1)], owner[first]
    base = ends[o] - sizes[o] - 1
    return np.stack([asked[o], a - base, b - base + length])


# ---------------------------------------------------------------------- stages
def _ids(column) -> np.ndarray:
    return column.fill_null(int(LAST)).to_numpy(zero_copy_only=False)


def _slices(batch, column: str = "text"):
    """The batch in parts of about SLICE_BYTES of the column."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _each(batch, step: int = 32):
    """The batch's rows as Python values, a few at a time: their blobs are large."""
    for at in range(0, batch.num_rows, step):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns))


def _rows(keys: np.ndarray, *values: np.ndarray):
    """The distinct keys in order, and for each array the bytes of each key's values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    ends = np.append(cut[1:], len(keys)).tolist()
    out = []
    for v in values:
        blob = np.ascontiguousarray(v[order]).tobytes()
        w = v.dtype.itemsize
        out.append([blob[w * a : w * b] for a, b in zip(cut.tolist(), ends)])
    return keys[cut], out


def _bucket(mh: np.ndarray, n: int) -> np.ndarray:
    return (mh.view(U) % U(n)).astype(np.int64)


def _batch(schema: str, *columns):
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    n = next(len(c) for c in columns if c is not None)
    arrays = [pa.nulls(n, kinds[k]) if c is None else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[f for f, _ in fields])


def _sampled(length):
    """(minimizer, texts that have it) of each batch."""

    def run(batches):
        for b in batches:
            for part in _slices(b):
                text, (mh, *_) = stretches_of([t or b"" for t in part.column("text").to_pylist()], length)
                order = np.lexsort((text, mh))
                text, mh = text[order], mh[order]
                once = np.concatenate(([True], (text[1:] != text[:-1]) | (mh[1:] != mh[:-1])))[: len(mh)]
                mh, n = np.unique(mh[once], return_counts=True)
                yield _batch("mh long, n long", mh, n)

    return run


OFFER = "bucket long, doc long, mh binary, sk binary, docs binary, contexts binary"
TOLD = "doc long, gone binary, want binary"


def _offer(n_buckets, length, common):
    """What a slice of texts knows of stretches: to the stretch's bucket goes
    its least document here, once; documents after it learn that it goes."""

    def run(batches):
        known = np.frombuffer(common, U)
        for b in batches:
            for part in _slices(b):
                least: dict[int, tuple[int, bytes]] = {}  # of equal texts the one of smallest id
                for d, k1, t in zip(_ids(part.column("doc_id")).tolist(), part.column("k1").to_pylist(), part.column("text").to_pylist()):
                    if t and len(t) >= length and (k1 not in least or d < least[k1][0]):
                        least[k1] = d, t
                if not least:
                    continue
                which, (mh, sk, _, _, around) = stretches_of([t for _, t in least.values()], length, known, contexts=True)
                doc = np.array([d for d, _ in least.values()], np.int64)[which]
                order = np.lexsort((doc, sk))
                mh, sk, doc, around = mh[order], sk[order], doc[order], around[order]
                first = np.concatenate(([True], sk[1:] != sk[:-1]))
                low = np.repeat(doc[first], np.diff(np.append(np.flatnonzero(first), len(sk))))
                later = (doc > low) & np.concatenate(([True], (sk[1:] != sk[:-1]) | (doc[1:] != doc[:-1])))
                if later.any():
                    docs, (gone,) = _rows(doc[later], sk[later])
                    yield _batch(OFFER, (docs.view(U) % U(n_buckets)).astype(np.int64), docs, None, gone, None, None)
                # half of a minimizer's hash does here: what meets by chance is told apart where bytes meet
                half = ((mh[first].view(U) * U(BASE)) >> U(32)).astype(np.uint32)
                keys, (mhs, sks, ids, arounds) = _rows(_bucket(mh[first], n_buckets), half, sk[first], doc[first], around[first])
                yield _batch(OFFER, keys, None, mhs, sks, ids, arounds)

    return run


def _several(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries (sorted by group) are in a group of several documents."""
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    return np.repeat(np.minimum.reduceat(doc, heads) < np.maximum.reduceat(doc, heads), np.diff(np.append(heads, len(group))))


def _agreeing(mh: np.ndarray, doc: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Which stretches may share a window with one of another document: all under a minimizer (they
    come together) that has one without contexts, else those that agree in a context."""
    heads = np.flatnonzero(np.concatenate(([True], mh[1:] != mh[:-1])))
    out = np.repeat(np.minimum.reduceat((around != 0).astype(np.int8), heads) == 0, np.diff(np.append(heads, len(mh))))
    for j in range(BINS):
        key = (around.view(U) >> U(16 * j)) & U(0xFFFF)
        at = np.flatnonzero(key != 0)
        if len(at):
            key = (mh[at].astype(U) << U(16)) | key[at]
            order = np.argsort(key, kind="stable")
            out[at[order[_several(key[order], doc[at[order]])]]] = True
    return out


def _compare(batches):
    """Per bucket: which documents lose a whole stretch to a smaller one, and which
    are to send stretches because others share the minimizer and a context of it."""

    def settle(parts):
        mh, sk, doc, around = (np.concatenate([np.frombuffer(p[i], np.int64 if i else np.uint32) for p in parts]) for i in range(4))
        order = np.argsort(mh, kind="stable")
        m = mh[order]
        edge = np.concatenate(([True], m[1:] != m[:-1], [True]))
        order = order[~(edge[1:] & edge[:-1])]  # minimizers offered once need nothing
        if not len(order):
            return None
        mh, sk, doc, around = mh[order], sk[order], doc[order], around[order]
        order = np.lexsort((doc, sk, mh))
        mh, sk, doc, around = mh[order], sk[order], doc[order], around[order]
        first = np.concatenate(([True], (mh[1:] != mh[:-1]) | (sk[1:] != sk[:-1])))
        low = np.repeat(doc[first], np.diff(np.append(np.flatnonzero(first), len(sk))))
        gone = doc > low
        gdoc, (gsk,) = _rows(doc[gone], sk[gone])
        mh, sk, doc, around = mh[first], sk[first], doc[first], around[first]
        several = np.flatnonzero(_several(mh, doc))
        if len(several):
            several = several[_agreeing(mh[several], doc[several], around[several])]
        wdoc, (wsk,) = _rows(doc[several], sk[several])
        return _batch(TOLD, np.concatenate([gdoc, wdoc]), gsk + [None] * len(wdoc), [None] * len(gdoc) + wsk)

    parts, now = [], None
    for b in batches:  # sorted by bucket
        whole = b.filter(pc.is_valid(b.column("doc")))
        if whole.num_rows:
            yield _batch(TOLD, whole.column("doc"), whole.column("sk"), None)
        for bucket, doc, *rest in _each(b):
            if doc is not None:
                continue
            if bucket != now and parts:
                if (out := settle(parts)) is not None:
                    yield out
                parts = []
            now = bucket
            parts.append(rest)
    if parts and (out := settle(parts)) is not None:
        yield out


SENT = "bucket long, doc long, k1 long, spans binary, mh binary, sk binary, docs binary, keys binary, at binary, n binary, s binary"


def _among(owner: np.ndarray, sk: np.ndarray, told: list) -> tuple[np.ndarray, np.ndarray]:
    """Which of the (owner, stretch) pairs the owner was told, and a number for each pair of those."""
    each = [np.frombuffer(b"".join(x), np.int64) for x in told]
    theirs, whose = np.concatenate(each), np.repeat(np.arange(len(each)), [len(x) for x in each])
    known = np.unique(theirs)
    at = np.searchsorted(known, sk)
    pair = at * len(each) + owner
    out = _held(sk, known)
    out[out] = _held(pair[out], np.sort(np.searchsorted(known, theirs) * len(each) + whose))
    return out, pair


def _send(n_buckets, length, common):
    """The spans of a text that are known to go, and the bytes of the stretches it was asked for."""

    def run(batches):
        known = np.frombuffer(common, U)
        for b in batches:
            for part in _slices(b):
                texts, gone, want = (part.column(c).to_pylist() for c in ("text", "gone", "want"))
                doc, k1 = _ids(part.column("doc_id")), part.column("k1").to_numpy()
                owner, (mh, sk, lo, hi) = stretches_of(texts, length, known)
                out, _ = _among(owner, sk, gone)
                if out.any():
                    o, spans = _merged(owner[out], lo[out], hi[out] + length - 1)
                    yield _batch(SENT, (k1[o].view(U) % U(n_buckets)).astype(np.int64), doc[o], k1[o], spans, *[None] * 7)
                ask, pair = _among(owner, sk, want)
                ask = np.flatnonzero(ask & ~out)
                _, once = np.unique(pair[ask], return_index=True)
                n = np.zeros(len(ask), np.int64)  # a stretch that repeats here sends its bytes once
                n[once] = (hi - lo)[ask[once]] + length - 1
                reach, at = np.cumsum(n), 0
                while at < len(ask):
                    end = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + SLICE_BYTES // 4, side="right")))
                    x, y = ask[at:end], n[at:end]
                    blobs = [texts[i][a : a + w] for i, a, w in zip(owner[x].tolist(), lo[x].tolist(), y.tolist())]
                    yield sent(np.stack([mh[x], sk[x], doc[owner[x]], k1[owner[x]], lo[x], y]), blobs)
                    at = end

    def sent(cols, blobs):
        keys, found = _rows(_bucket(cols[0], n_buckets), *cols, np.arange(cols.shape[1]))
        s = [b"".join([blobs[i] for i in np.frombuffer(x, np.int64).tolist()]) for x in found.pop()]
        return _batch(SENT, keys, None, None, None, *found, s)

    return run


def _merged(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Of spans sorted by group (numbers from 0 on) and start: the groups, and each one's merged spans."""
    if not len(group):
        return group, []
    far = int(hi.max()) + 1
    hi = np.maximum.accumulate(hi + group * far) - group * far
    first = np.concatenate(([True], (group[1:] != group[:-1]) | (lo[1:] > hi[:-1])))
    flat = np.stack([lo[first], hi[np.append(np.flatnonzero(first)[1:] - 1, len(lo) - 1)]], axis=1)
    group, cut = np.unique(group[first], return_index=True)
    blob = flat.astype(np.int64).tobytes()
    return group, [blob[16 * a : 16 * b] for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(flat)])]


def _spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Merged (start, end) pairs, flat; touching spans become one."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order]) if len(hi) else hi
    first = np.concatenate(([True], lo[1:] > hi[:-1])) if len(lo) else np.zeros(0, bool)
    last = np.append(np.flatnonzero(first)[1:] - 1, len(lo) - 1) if len(lo) else np.zeros(0, int)
    return np.stack([lo[first], hi[last]], axis=1).astype(np.int64).ravel()


FOUND = "doc long, k1 long, spans binary"


def _match(length):
    """Per bucket: the spans that the run-length indexes find."""

    def settle(parts):
        mh, sk, doc, k1, at, n = (np.concatenate([np.frombuffer(p[i], np.int64) for p in parts]) for i in range(6))
        blob = b"".join(p[6] for p in parts)
        start = np.cumsum(n) - n
        order = np.lexsort((-n, doc, sk, mh))
        first = np.concatenate(([True], sk[order][1:] != sk[order][:-1]))
        pick = order[first]  # one entry of each stretch, with its bytes and its document
        held = [blob[a : a + b] for a, b in zip(start[pick].tolist(), n[pick].tolist())]
        reach = np.cumsum(n[pick])
        heads = np.flatnonzero(np.concatenate(([True], mh[pick][1:] != mh[pick][:-1])))
        found, here = [], 0
        while here < len(pick):  # units of whole minimizers
            end = int(np.searchsorted(reach, (reach[here - 1] if here else 0) + UNIT_BYTES, side="right"))
            nth = np.searchsorted(heads, max(end, here + 1))
            end = int(heads[nth]) if nth < len(heads) else len(pick)
            got = repeated(mh[pick[here:end]], held[here:end], doc[pick[here:end]], length)
            got[0] += here
            found.append(got)
            here = end
        which, a, b = np.concatenate(found, axis=1)
        # every place of the stretch's document that has it
        stretch = np.empty(len(order), np.int64)
        stretch[order] = np.cumsum(first) - 1
        by = np.argsort(stretch, kind="stable")
        starts = np.searchsorted(stretch[by], which)
        times = np.searchsorted(stretch[by], which, side="right") - starts
        entry = by[np.repeat(starts, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)]
        lo, hi = at[entry] + np.repeat(a, times), at[entry] + np.repeat(b, times)
        order = np.lexsort((lo, k1[entry], doc[entry]))
        entry, lo, hi = entry[order], lo[order], hi[order]
        d, k = doc[entry], k1[entry]
        head = np.concatenate(([True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])))[: len(d)]
        _, spans = _merged(np.cumsum(head) - 1, lo, hi)
        return _batch(FOUND, d[head], k[head], spans)

    def run(batches):
        parts, now = [], None
        for b in batches:  # sorted by bucket
            known = b.filter(pc.is_valid(b.column("doc")))
            if known.num_rows:
                yield known.select(["doc", "k1", "spans"])
            for bucket, doc, _, _, *rest in _each(b):
                if doc is not None:
                    continue
                if bucket != now and parts:
                    yield settle(parts)
                    parts = []
                now = bucket
                parts.append(rest)
        if parts:
            yield settle(parts)

    return run


CUT = "doc_id long, k1 long, gone long, spans long, kept string"


def _cut(batches):
    for b in batches:
        rows: list = [[], [], []]
        for text, found in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            flat = np.concatenate([np.frombuffer(x, np.int64) for x in found]).reshape(-1, 2)
            spans = _spans(flat[:, 0], flat[:, 1]).reshape(-1, 2).tolist()
            kept, at = hashlib.sha256(), 0
            for x, y in spans:
                kept.update(text[at:x])
                at = y
            kept.update(text[at:])
            rows[0].append(sum(y - x for x, y in spans))
            rows[1].append(len(spans))
            rows[2].append(kept.hexdigest())
        yield _batch(CUT, b.column("doc_id"), b.column("k1"), *rows)


# -------------------------------------------------------------------- operator
def common_minimizers(keyed: DataFrame, total: int, length: int, common: int = COMMON) -> bytes:
    """The minimizers expected in more than ``common`` stretches, or in more
    than a millionth of all, from a sample of texts: a million at the most or
    thereabouts, as sorted bytes. They only steer how the work is dealt out."""
    most = max(common, int(total) // (18 * 1_000_000))
    if total < 18 * most:
        return b""
    share = min(1.0, SAMPLE_HITS / most)
    sample = keyed.where(F.pmod(F.xxhash64("k1", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)))
    got = sample.select("text").mapInArrow(_sampled(length), "mh long, n long").groupBy("mh").agg(F.sum("n").alias("n")).where(F.col("n") >= most * share).select("mh").toArrow()
    return np.sort(got["mh"].to_numpy().view(U)).tobytes()


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 32 << 20, common: int = COMMON) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per input row.

    Removes each byte covered by a ``length``-byte string that also starts in
    a document of smaller id. Rows of one id count as one document and do not
    remove from each other; null ids count as one document after all others;
    ids must be numbers and are compared as long integers. Texts are UTF-8.
    Null texts are empty. Texts under
    ``length`` bytes lose nothing; texts of any length and of one repeated
    letter are cut into stretches of bounded size. Other columns are ignored; an empty table
    gives an empty result. ``length`` is at least 32. ``bucket_bytes`` of text
    are compared together; ``common`` bounds how many stretches of one minimizer are
    (a million minimizers may exceed it, each by at most a millionth of all)."""
    if length < 2 * GRAM:
        raise ValueError("length is too small for the minimizer's gram")
    text = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit("").cast("binary"))
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))).alias("doc_id"), text.alias("text"))
    keyed = src.withColumn("k1", F.xxhash64("text"))
    raw = staged(keyed.select("doc_id", "k1", F.length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "bytes")
    total = raw.agg(F.sum("n_bytes")).first()[0] or 0
    # equal texts: all but those of the smallest id are covered throughout
    first = raw.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    slim = staged(raw.join(first.select("sha", "first_id"), "sha", "left").withColumn("is_copy", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))).drop("first_id"), "bytes")
    released(raw)

    buckets = max(16, -(-int(total) // bucket_bytes))
    hot = common_minimizers(keyed, total, length, common)
    offers = keyed.where(F.length("text") >= length).mapInArrow(_offer(buckets, length, hot), OFFER).repartition("bucket").sortWithinPartitions("bucket")
    told = staged(offers.mapInArrow(_compare, TOLD), "bytes")
    told_each = told.groupBy("doc").agg(F.collect_list("gone").alias("gone"), F.collect_list("want").alias("want"))
    asked = slim.where(f"not is_copy and n_bytes >= {length}").select("doc_id", "k1").distinct().join(told_each.withColumnRenamed("doc", "doc_id"), "doc_id")
    sent = keyed.join(asked, ["doc_id", "k1"]).select("doc_id", "k1", "text", "gone", "want").mapInArrow(_send(buckets, length, hot), SENT)
    found = staged(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_match(length), FOUND), "bytes")
    released(told)

    spans = found.groupBy(F.col("doc").alias("doc_id"), "k1").agg(F.collect_list("spans").alias("spans"))
    cut = keyed.join(spans, ["doc_id", "k1"]).select("doc_id", "k1", "text", "spans").mapInArrow(_cut, CUT).dropDuplicates(["doc_id", "k1"])
    all_gone = F.col("is_copy") & (F.col("n_bytes") >= length)
    pick = lambda copy, other, none: F.when(all_gone, copy).otherwise(F.coalesce(F.col(other), none))
    return slim.join(cut, ["doc_id", "k1"], "left").select(
        F.when(F.col("doc_id") != int(LAST), F.col("doc_id")).alias("doc_id"),
        "n_bytes",
        pick(F.col("n_bytes"), "gone", F.lit(0).cast("long")).alias("n_removed"),
        pick(F.lit(1).cast("long"), "spans", F.lit(0).cast("long")).alias("n_spans"),
        pick(F.sha2(F.lit("").cast("binary"), 256), "kept", F.col("sha")).alias("kept_sha256"),
    )
