"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints that differ in at most ``max_diff`` bits agree on ``spare`` of
``max_diff + spare`` bit blocks. Each choice of ``spare`` blocks is one top node family
of the index: its mask and the shared pattern under it name a node, and a
pair of close fingerprints meets under at least one node, so routing by node
loses no link. Within a node, fingerprints are sorted by Gray rank; runs of
neighbours become leaves and runs of leaves upper nodes, each holding the bits
on which all below it agree and which no node above already holds. A search
adds up differing bits from the root down and drops a whole node as soon as
the sum passes ``max_diff``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, staged, unused
from .components import connected_components

SEED = 42
LEAF, FANOUT = 16, 8
#: Largest number of fingerprints under one top node that one task indexes;
#: larger nodes are dealt out as pairs of slices that cover every pair.
NODE_ROWS = 16384
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---------------------------------------------------------------- fingerprints
def fingerprint(text: bytes | None, width: int = 4) -> int:
    """The SimHash of one UTF-8 text over its shingles' XXH64; 0 if it has no word."""
    words = text.lower().split() if text else []  # bytes: folds A-Z and splits at \x20, \x09-\x0D only
    if not words:
        return 0
    flat = b" ".join(words)
    k = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    lo, hi = starts[:k].tolist(), ends[-k:].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, k, 1 << 15):  # bounded scratch however long the text
        h = np.array([digest(flat[a:b], SEED) for a, b in zip(lo[at : at + (1 << 15)], hi[at : at + (1 << 15)])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > k, bitorder="little").view("<u8")[0])


def _fingerprint_batches(width):
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return run


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null or wordless texts have 0."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(_fingerprint_batches(width), f"doc_id {kind}, fp long")


# ------------------------------------------------------------ the index itself
def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order."""
    r = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def _agree(ands, ors, starts):
    """Mask and pattern of the bits on which each run of members agrees."""
    a, o = np.bitwise_and.reduceat(ands, starts), np.bitwise_or.reduceat(ors, starts)
    return a, o


class GrayForest:
    """One tree for each group of Gray-sorted codes, all of the same height."""

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        self.codes, n = codes, len(codes)
        heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.append(heads, n))
        self.levels = []  # from the leaves up: starts, ends (into the level below), mask, pattern
        starts_of, counts, ands, ors, first = heads, sizes, codes, codes, True
        while True:
            step = LEAF if first else FANOUT
            per = -(-counts // step)
            total = int(per.sum())
            owner = np.repeat(np.arange(len(per)), per)
            nth = np.arange(total) - np.repeat(np.cumsum(per) - per, per)
            starts = starts_of[owner] + nth * step
            ends = np.minimum(starts + step, (starts_of + counts)[owner])
            ands, ors = _agree(ands, ors, starts)
            self.levels.append((starts, ends, ~(ands ^ ors), ands))
            starts_of, counts, first = np.cumsum(per) - per, per, False
            if (per == 1).all():
                break
        # what a node holds beyond the nodes above it
        self.own = []
        for k, (starts, ends, mask, pat) in enumerate(self.levels):
            if k + 1 < len(self.levels):
                s, e, up, _ = self.levels[k + 1]
                above = up[np.repeat(np.arange(len(s)), e - s)]
                self.own.append(mask & ~above)
            else:
                self.own.append(mask)
        self.root_of = np.repeat(np.arange(len(sizes)), sizes)  # group of each code

    def _spans(self, level: int) -> np.ndarray:
        """Index after the last code below each node of a level."""
        ends = self.levels[0][1]
        for k in range(1, level + 1):
            ends = ends[self.levels[k][1] - 1]
        return ends

    def links(self, max_diff: int, block: int = 2048, decide=None) -> np.ndarray:
        """A spanning forest of all pairs within ``max_diff`` bits inside a
        group: for each code the index of its representative. ``decide(i, js)``
        says which of such pairs are links, if not all are."""
        codes, n = self.codes, len(self.codes)
        root = np.arange(n)
        top = len(self.levels) - 1
        spans = [self._spans(k) for k in range(top + 1)]
        for at in range(0, n, block):
            # a node whose members all share one representative is skipped by queries that share it too
            same = []
            lo = hi = root
            for starts, _, _, _ in self.levels:
                lo, hi = np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts)
                same.append(np.where(lo == hi, lo, -1))
            q = np.arange(at, min(at + block, n))
            node, acc = self.root_of[q], np.zeros(len(q), np.uint8)
            for k in range(top, -1, -1):
                starts, ends, _, pat = self.levels[k]
                acc = acc + np.bitwise_count((codes[q] ^ pat[node]) & self.own[k][node])
                keep = (acc <= max_diff) & (spans[k][node] > q + 1) & (same[k][node] != root[q])
                q, node, acc = q[keep], node[keep], acc[keep]
                if not len(q):
                    break
                if k:
                    reps = ends[node] - starts[node]
                    q, acc = np.repeat(q, reps), np.repeat(acc, reps)
                    node = np.repeat(starts[node] - np.cumsum(reps) + reps, reps) + np.arange(len(q))
            else:
                starts, ends, mask, _ = self.levels[0]
                for part in range(0, len(q), 1 << 16):
                    pq, pn, pa_ = q[part : part + (1 << 16)], node[part : part + (1 << 16)], acc[part : part + (1 << 16)]
                    reps = ends[pn] - starts[pn]
                    qq = np.repeat(pq, reps)
                    m = np.repeat(starts[pn] - np.cumsum(reps) + reps, reps) + np.arange(len(qq))
                    d = np.repeat(pa_, reps) + np.bitwise_count((codes[qq] ^ codes[m]) & np.repeat(~mask[pn], reps))
                    hit = (d <= max_diff) & (m > qq)
                    qq, m = qq[hit], m[hit]
                    if decide is None:
                        root = _unite(root, qq, m)
                        continue
                    for own in np.split(np.arange(len(qq)), np.flatnonzero(qq[1:] != qq[:-1]) + 1):
                        own = own[root[qq[own]] != root[m[own]]]  # what is linked already need not be decided
                        if len(own):
                            own = own[decide(int(qq[own[0]]), m[own])]
                            root = _unite(root, qq[own], m[own])
        return root


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of a[i] and b[i]; root maps each index to its class's smallest."""
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        if not live.any():
            break
        a, b = a[live], b[live]
        lo, hi = np.minimum(ra[live], rb[live]), np.maximum(ra[live], rb[live])
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _node_links(max_diff):
    def flush(key, codes, ids):
        """Edges (member, representative) among Gray-sorted codes, grouped by key."""
        if len(codes) < 2:
            return None
        edge = (key[1:] != key[:-1]).any(axis=1)
        group = np.concatenate(([0], np.cumsum(edge)))
        keep = np.bincount(group)[group] > 1
        if not keep.any():
            return None
        codes, group, ids = codes[keep], group[keep], ids[keep]
        root = GrayForest(codes, group).links(max_diff)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["a", "b"])

    def run(batches):
        held, size = [], 0
        for b in batches:  # sorted by node and Gray rank
            if not b.num_rows:
                continue
            held.append((np.stack([b.column(c).to_numpy() for c in ("family", "pattern", "cell")], axis=1), b.column("fp").to_numpy().view(np.uint64), b.column("id").to_numpy()))
            size += b.num_rows
            if size >= 200_000:  # index whole nodes; the last one may go on
                key, code, ids = (np.concatenate(parts) for parts in zip(*held))
                cut = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1 if (key[0] != key[-1]).any() else 0
                if cut and (out := flush(key[:cut], code[:cut], ids[:cut])) is not None:
                    yield out
                held, size = [(key[cut:], code[cut:], ids[cut:])], len(code) - cut
        if size and (out := flush(*(np.concatenate(parts) for parts in zip(*held)))) is not None:
            yield out

    return run


def _rank_column(c):
    for s in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, s))
    return c


def _blocks(mask: int, n: int) -> list[int]:
    """The bits of ``mask`` in ``n`` near-equal blocks."""
    bits = [1 << i for i in range(64) if mask >> i & 1]
    return [sum(bits[len(bits) * i // n : len(bits) * (i + 1) // n]) for i in range(n)]


def top_masks(max_diff: int, spare: int = 2) -> list[int]:
    """Masks of ``spare`` of ``max_diff + spare`` near-equal bit blocks."""
    return [sum(c) for c in combinations(_blocks((1 << 64) - 1, max_diff + spare), spare)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def node_edges(nodes: DataFrame, max_diff: int, node_rows: int = NODE_ROWS, masks: list[int] | None = None) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of rows within
    ``max_diff`` bits under one top node. Columns of ``nodes``: family (int),
    pattern, fp and id (a long that stands for the row in edges). ``masks`` has
    the bits that each family's pattern holds: nodes of over ``node_rows`` then
    get a second level, of ``max_diff + 1`` blocks of the other bits, one of which
    a close pair shares. What is larger still is dealt out as pairs of slices."""

    def sized(x):
        return staged(x.groupBy("family", "pattern").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash")

    sizes = sized(nodes)
    held = nodes.join(sizes, ["family", "pattern"])
    if masks and not sizes.where(F.col("n") > node_rows).isEmpty():
        below = F.array(*[F.array(*[F.lit(_signed(b)).cast("long") for b in _blocks(~m & ((1 << 64) - 1), max_diff + 1)]) for m in masks])
        large = held.where(F.col("n") > node_rows).select("family", "fp", "id", F.col("pattern").alias("top"), F.posexplode(F.get(below, F.col("family"))).alias("nth", "mask"))
        large = large.select((F.lit(len(masks)) + F.col("family") * (max_diff + 1) + F.col("nth")).cast("int").alias("family"), F.xxhash64("top", F.col("fp").bitwiseAND(F.col("mask"))).alias("pattern"), "fp", "id")
        large = large.join(sized(large), ["family", "pattern"])
        held = held.where(F.col("n") <= node_rows).select("family", "pattern", "fp", "id", "n").unionByName(large.select("family", "pattern", "fp", "id", "n"))
    held = held.withColumn("m", F.ceil(F.col("n") / F.lit(node_rows)).cast("int")).withColumn("s", F.pmod(F.xxhash64("id", "family"), F.col("m")).cast("int"))
    # a node of m slices becomes m(m+1)/2 pairs of slices; most have m = 1
    cells = held.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    cells = cells.withColumn("cell", (F.least("s", "t") * F.col("m") + F.greatest("s", "t")).cast("long"))
    dealt = cells.repartition("family", "pattern", "cell").withColumn("rank", _rank_column(F.col("fp")).bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
    dealt = dealt.sortWithinPartitions("family", "pattern", "cell", "rank").select(F.col("family").cast("long").alias("family"), "pattern", "cell", "fp", "id")
    return dealt.mapInArrow(_node_links(max_diff), "a long, b long")


def hamming_edges(fps: DataFrame, max_diff: int = 4, spare: int = 2, node_rows: int = NODE_ROWS) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of rows of ``fps``
    (column fp, which stands for the row) within ``max_diff`` bits."""
    masks = top_masks(max_diff, spare)
    patterns = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks])
    nodes = fps.select("fp", F.col("fp").alias("id"), F.posexplode(patterns).alias("family", "pattern"))
    return node_edges(nodes, max_diff, node_rows, masks)


# -------------------------------------------------------------------- operator
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_diff: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per input row.

    component_id is the smallest doc_id reachable over links of at most
    ``max_diff`` differing bits, the row's own included.
    Null, empty and wordless texts have fingerprint zero and link like any
    other. Rows that repeat a doc_id stay as rows. Null ids are never the
    smallest unless all ids of the component are null (then component_id is
    null). Texts are read whole, however long. Other columns are ignored; an
    empty table gives an empty result."""
    marks = staged(with_fingerprints(docs, id_col, text_col, width), "simhash")
    fps = staged(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "simhash")
    comp = connected_components(hamming_edges(fps, max_diff))
    linked = fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").where("n > 1 or label is not null").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    linked = staged(linked, "simhash")
    released(fps)
    least = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    lookup = linked.join(least, "label").select("fp", "component_id", F.lit(True).alias("found"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return marks.join(lookup, "fp", "left").select("doc_id", hexed, F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


# ------------------------------------------------------------- exact similarity
#: Top node families for word-shingle sets: bands of rows of minima. Sets of Jaccard similarity 0.8 share a node with
#: probability 1 - (1 - 0.8^5)^20 = 0.9996. (Masks of 64 bits hold too few bits to be nodes at the radius below.)
BANDS, BAND_ROWS = 20, 5
#: Bits that fingerprints under one node may differ in. Sets of similarity 0.8 have a cosine of 0.89: 9.7 of 64 bits
#: differ on average, with a deviation of 2.9.
RADIUS = 22
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles (and 64 a text) of one candidate group that one task compares; larger groups are dealt as pairs of slices.
CELL_WEIGHT = 1 << 21


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """The sorted distinct XXH64 of a text's shingles; empty if it has no word."""
    words = text.lower().split() if text else []
    k = max(1, len(words) - width + 1) if words else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(k)), np.uint64, k))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of minima of a non-empty set."""
    low = np.full(BANDS * BAND_ROWS, ALL)
    for at in range(0, len(hashes), 4096):
        low = np.minimum(low, (hashes[None, at : at + 4096] * MULTIPLIERS[:, None]).min(axis=1))
    low = (low ^ (low >> np.uint64(29))) * MULTIPLIERS[::-1]
    key = (low ^ (low >> np.uint64(32))).reshape(BANDS, BAND_ROWS).sum(axis=1, dtype=np.uint64)
    return key * MULTIPLIERS[0]


def _mark_batches(width):
    def run(batches):
        for b in batches:
            fps, ids, sizes, bands = [], [], [], []
            for text in b.column("text").to_pylist():
                hashes = shingle_set(text, width)
                fps.append(fingerprint(text, width))
                ids.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                sizes.append(len(hashes))
                bands.append(band_keys(hashes).view(np.int64) if len(hashes) else np.empty(0, np.int64))
            made = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (ids, fps)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *made, pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_key", "id", "fp", "size", "bands"])

    return run


def exact_links(sets: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    """A spanning forest of all pairs of sets of Jaccard similarity 0.8 or
    more among those whose fingerprints the index finds within RADIUS bits: for
    each set the index of its representative."""
    order = np.argsort(gray_rank(codes), kind="stable")
    sizes = np.array([len(sets[i]) for i in order])
    _, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    marked = np.zeros(len(flat), bool)

    def decide(i, js):
        close = 5 * np.minimum(sizes[js], sizes[i]) >= 4 * np.maximum(sizes[js], sizes[i])
        out = np.zeros(len(js), bool)
        j = js[close]
        if not len(j):
            return out
        own = flat[starts[i] : starts[i] + sizes[i]]
        marked[own] = True
        reps = sizes[j]
        heads = np.cumsum(reps) - reps
        held = flat[np.repeat(starts[j] - heads, reps) + np.arange(int(reps.sum()))]
        common = np.add.reduceat(marked[held].astype(np.int64), heads)
        marked[own] = False
        out[close] = 9 * common >= 4 * (sizes[i] + sizes[j])  # common / (sum - common) >= 0.8
        return out

    found = GrayForest(codes[order], np.zeros(len(order), np.int64)).links(RADIUS, decide=decide)
    root = np.empty(len(order), np.int64)
    root[order] = order[found]
    return root


def _exact_batches(width):
    def flush(held):
        ids = np.array([h[0] for h in held])
        root = exact_links([h[1] for h in held], np.array([h[2] for h in held], np.uint64))
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["a", "b"])

    def run(batches):
        key, held = None, []
        for b in batches:  # sorted by group and cell
            for group, cell, i, text, fp in zip(*(b.column(c).to_pylist() for c in ("label", "cell", "id", "text", "fp"))):
                if (group, cell) != key:
                    if len(held) > 1:
                        yield flush(held)
                    key, held = (group, cell), []
                held.append((i, shingle_set(text, width), fp % (1 << 64)))
        if len(held) > 1:
            yield flush(held)

    return run


def similar_edges(texts: DataFrame, width: int = 5, cell_weight: int = CELL_WEIGHT) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of texts of one
    candidate group (label) with shingle sets of Jaccard similarity 0.8 or
    more. Columns: label, id, size, fp and text."""
    weigh = texts.groupBy("label").agg(F.ceil(F.sum(F.col("size") + 64) / F.lit(cell_weight)).cast("int").alias("m"))
    held = texts.join(weigh, "label").withColumn("s", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    cells = held.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    cells = cells.withColumn("cell", (F.least("s", "t") * F.col("m") + F.greatest("s", "t")).cast("long"))
    dealt = cells.select("label", "cell", "id", "text", "fp").repartition("label", "cell").sortWithinPartitions("label", "cell", "id")
    return dealt.mapInArrow(_exact_batches(width), "a long, b long")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, cell_weight: int = CELL_WEIGHT) -> DataFrame:
    """doc_id, component_id: one row per input row, the smallest doc_id over
    links of shingle-set Jaccard similarity 0.8 or more.

    The Gray index, with bands of minima as its top nodes, finds the groups
    that may hold links; inside a group it finds the pairs, and the sets
    themselves decide each link. Equal sets, those of wordless texts included,
    always link. Null texts are empty. Null ids are never the smallest unless
    all ids of the component are null. Other columns are ignored; an empty
    table gives an empty result."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    marks = staged(src.mapInArrow(_mark_batches(width), f"doc_id {kind}, text_key long, id long, fp long, size long, bands array<long>"), "similar")
    sets = marks.groupBy("id").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.min(F.struct("text_key", "fp")).alias("text"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    sets = staged(sets.select("id", "first_id", "n", "text.*", "size", "bands"), "similar")
    nodes = sets.where("size > 0").select("id", "fp", F.posexplode("bands").alias("family", "pattern"))
    groups = connected_components(node_edges(nodes, RADIUS)).withColumnRenamed("node", "id")
    members = staged(groups.join(sets.select("id", "text_key", "size", "fp"), "id"), "similar")
    texts = staged(src.select("text_key", "text").join(members, "text_key").dropDuplicates(["id"]).select("label", "id", "size", "fp", "text"), "similar")
    comp = connected_components(similar_edges(texts, width, cell_weight)).withColumnRenamed("node", "id")
    linked = sets.select("id", "first_id", "n").join(comp, "id", "left").where("n > 1 or label is not null").select("id", "first_id", F.coalesce("label", "id").alias("label"))
    linked = staged(linked, "similar")
    for done in (sets, members, texts):
        released(done)
    least = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    lookup = linked.join(least, "label").select("id", "component_id", F.lit(True).alias("found"))
    return marks.select("doc_id", "id").join(lookup, "id", "left").select("doc_id", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``docs`` without all but the document of smallest id of each component.

    Links are texts whose sets of ``width``-word shingles have a Jaccard
    similarity of at least 0.8, compared exactly among candidates.
    Null, empty and wordless texts are one group. Rows that repeat the kept id all
    stay, as do rows with a null id; an empty table gives an empty result. All
    columns of ``docs`` are returned."""
    found = similar_components(docs, id_col, text_col, width).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    mark = unused(docs, "gone")
    found = found.withColumnRenamed("gone", mark)
    return docs.join(found, docs[id_col] == found[mark], "left_anti")
