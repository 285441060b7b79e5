import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import components, simhash


def slow_fingerprint(text, width=4):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in folded + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            words += [now] if now else []
            now = ""
        else:
            now += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(keys, near):
    label = np.array(keys)
    while True:
        new = np.array([label[near[i]].min() for i in range(len(label))])
        if (new == label).all():
            return label
        label = new


TEXTS = ["", "one", "a b c", "a b c d", "The QUICK brown\x0bfox\x0cjumps  over", "Éa b c d e É", "x " * 50, "a\u00a0b c d e f"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("seed", range(12))
def test_forest_finds_the_components_of_all_links(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 700))
    codes = rng.integers(0, 2**63, max(1, n // int(rng.integers(2, 60))), dtype=np.uint64)[rng.integers(0, max(1, n // 60), n) % max(1, n // 60)]
    for _ in range(5):
        codes = codes ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    group = np.sort(rng.integers(0, 5, n))
    order = np.lexsort((simhash.gray_rank(codes), group))
    codes, group = codes[order], group[order]
    near = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4) & (group[:, None] == group[None, :])
    assert (simhash.GrayForest(codes, group).links(4, block=50) == slow_components(range(n), near)).all()


def test_gray_rank_orders_neighbours():
    r = np.arange(256, dtype=np.uint64)
    codes = r ^ (r >> np.uint64(1))
    assert (simhash.gray_rank(codes) == r).all()


@pytest.mark.parametrize("node_rows", [7, 40, 16384])
def test_links_against_all_pairs(spark, node_rows):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    codes = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for b in base] + [rng.integers(0, 2**63, 60, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    got = components.connected_components(simhash.hamming_edges(df, 4, node_rows=node_rows)).collect()
    signed = codes.view(np.int64)
    want = slow_components(signed, np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4)
    label = {int(s): int(s) for s in signed} | {r.node: r.label for r in got}
    assert [label[int(s)] for s in signed] == want.tolist()


def test_whole_operator(docs):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(20):
        text = [words[i] for i in rng.integers(0, 300, 150)]
        for _ in range(4):
            copy = list(text)
            copy[int(rng.integers(0, 150))] = "changed"
            rows.append((len(rows), " ".join(copy)))
    rows += [(500, ""), (501, None), (502, " \n"), (503, "alone here")]
    got = {r.doc_id: r[1:] for r in simhash.near_duplicates(docs(rows)).collect()}
    codes = np.array([slow_fingerprint(t) for _, t in rows], np.uint64)
    want = slow_components([i for i, _ in rows], np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4)
    assert got == {i: (format(int(c), "016x"), int(w)) for (i, _), c, w in zip(rows, codes, want)}


def test_odd_input(odd, spark):
    got = simhash.near_duplicates(odd.withColumn("fp", F.lit(1)).withColumn("label", F.lit(2))).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == by[2].component_id == by[6].component_id == 1
    assert by[4].component_id == 3 and by[1].fingerprint == "0" * 16
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 5, 5, 7]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(50))
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def words_set(text, width=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


@pytest.mark.parametrize("cell_weight", [500, simhash.CELL_WEIGHT])
def test_near_copies_follow_exact_jaccard(docs, cell_weight):
    """Pairs on both sides of 0.8, short texts, a group of many near copies."""
    rng = np.random.default_rng(17)
    rows = [(0, None), (1, " "), (2, "two words"), (3, "two  words")]
    for k in range(160):
        size = int(rng.choice([12, 20, 60, 150, 400]))
        text = [f"w{i}" for i in rng.integers(0, 5000, size)]
        copy, n = list(text), max(1, int(size * rng.uniform(0.02, 0.2)))
        copy[size // 2 : size // 2 + n] = [f"x{i}" for i in rng.integers(0, 5000, n)]
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(copy if k % 2 else text[: size - n]))]
    hot = [f"h{i}" for i in rng.integers(0, 5000, 120)]
    for _ in range(60):
        copy = list(hot)
        for i in rng.integers(0, 120, int(rng.integers(1, 4))):
            copy[i] = f"y{rng.integers(0, 5000)}"
        rows.append((len(rows), " ".join(copy)))
    sets = [words_set(t) for _, t in rows]
    near = np.array([[similar(a, b) for b in sets] for a in sets])
    want = slow_components([i for i, _ in rows], near)
    got = dict(simhash.similar_components(docs(rows), cell_weight=cell_weight).collect())
    assert [got[i] for i, _ in rows] == want.tolist()
    assert 40 < sum(near[i, i + 1] for i in range(4, 324, 2)) < 120


def test_recall_at_the_threshold(docs):
    """Pairs just above 0.8, one changed stretch each, at the shipped setting."""
    rng = np.random.default_rng(8)
    rows, over, under = [], [], []
    for k in range(400):
        size = int(rng.choice([60, 200, 400]))
        text = [f"w{i}" for i in rng.integers(0, 5000, size)]
        copy, n = list(text), (size - 4) // 9 - 4 if k % 4 else size // 8
        copy[size // 2 : size // 2 + n] = [f"x{i}" for i in rng.integers(0, 5000, n)]
        pair = " ".join(text), " ".join(copy)
        (over if similar(*map(words_set, pair)) else under).append(len(rows))
        rows += [(len(rows), pair[0]), (len(rows) + 1, pair[1])]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs(rows)).collect()}
    assert len(over) > 100 and sum(i + 1 not in kept for i in over) >= 0.99 * len(over)
    assert all(i in kept for i in range(0, len(rows), 2)) and all(i + 1 in kept for i in under)
