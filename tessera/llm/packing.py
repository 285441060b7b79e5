"""Best-fit packing into sequences of several permitted lengths.

Documents become pieces of at most the largest length. Within a shard, pieces
go longest first into the open bin with the least room that still takes them.
If none does, a bin is opened, of the permitted size that costs least for each
token it would come to hold: that of the piece and of the largest pieces still
to come that fit in turn. So sizes mix within one shard as its lengths
ask for. In the end every bin is cut down to the least permitted length that
holds its contents. The outcomes of opening only sizes up to one limit are
tried as well; the cheapest counts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS

SIZES = (512, 1024, 2048, 4096)
OVERHEAD = 32  # cost of a sequence besides its length, in tokens
SHARD_PIECES = 100_000  # pieces packed together
MOST_TASKS = 100_000


class Left:
    """The pieces still to come, by length."""

    def __init__(self, lengths: list[int], most: int):
        self.times = [0] * (most + 1)
        for n in lengths:
            self.times[n] += 1
        self.mask = sum(1 << n for n, k in enumerate(self.times) if k)  # bit n is set if some piece has length n

    def take(self, n: int) -> None:
        self.times[n] -= 1
        if not self.times[n]:
            self.mask ^= 1 << n

    def filled(self, room: int) -> int:
        """Tokens of the largest pieces that fit in turn."""
        load, mask = 0, self.mask
        while room:
            mask &= (1 << (room + 1)) - 1
            if not mask:
                break
            n = mask.bit_length() - 1
            k = min(self.times[n], room // n)
            load, room, mask = load + k * n, room - k * n, mask ^ (1 << n)
        return load


def cheapest(n: int, left: Left, sizes: list[int], overhead: int) -> int:
    """The size to open for a piece of ``n`` tokens: least cost, once cut down, for each token held."""
    best = None
    for s in sizes:
        if n <= s:
            load = n + left.filled(s - n)
            rate = (next(x for x in sizes if load <= x) + overhead) / load, s
            best = rate if best is None or rate < best else best
    return best[1]


def best_fit(lengths: list[int], sizes: list[int], overhead: int, limit: int | None = None) -> tuple[list[int], list[int]]:
    """Bin of each length (given longest first) and the bins' loads. Bins are
    opened at the least cost, or at ``limit`` where that suffices."""
    room: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]  # bins by free tokens
    left = Left(lengths, sizes[-1]) if limit is None else None
    free = 0  # bit r is set if some bin has r tokens free
    loads, caps, where = [], [], []
    for n in lengths:
        if left:
            left.take(n)
        fits = free >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                free ^= 1 << r
        else:
            k = len(loads)
            loads.append(0)
            caps.append(cheapest(n, left, sizes, overhead) if left else limit if n <= limit else next(s for s in sizes if n <= s))
        loads[k] += n
        where.append(k)
        r = caps[k] - loads[k]
        if not room[r]:
            free |= 1 << r
        room[r].append(k)
    return where, loads


def plan(lengths: list[int], sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD) -> tuple[list[int], list[int]]:
    """Bin of each length (given longest first) and the bins' final sizes."""
    sizes = sorted(sizes)
    best = None
    for limit in (None, *reversed(sizes)):
        where, loads = best_fit(lengths, sizes, overhead, limit)
        caps = [next(s for s in sizes if n <= s) for n in loads]
        cost = sum(caps) + overhead * len(caps)
        if best is None or cost < best[0]:
            best = cost, where, caps
    return best[1], best[2]


def _packer(sizes, overhead):
    names = ["shard", "doc_id", "piece", "first_token", "n_tokens"]

    def flush(held):
        """Packs the pieces of one shard."""
        rows = pa.Table.from_batches(held).combine_chunks()
        lengths = [n + 1 for n in rows["n_tokens"].to_pylist()]  # one end-of-text token each
        where, caps = plan(lengths, sizes, overhead)
        offset, at = [], [0] * len(caps)
        for k, n in zip(where, lengths):
            offset.append(at[k])
            at[k] += n
        base = rows["shard"][0].as_py() << 32
        cols = [pa.array([base + k for k in where], pa.int64()), pa.array([caps[k] for k in where], pa.int32()), *(rows[c].combine_chunks() for c in names[1:]), pa.array(offset, pa.int32())]
        return pa.Table.from_arrays(cols, names=["bin_id", "capacity", *names[1:], "bin_offset"]).to_batches()

    def run(batches):
        held, shard = [], None
        for b in batches:  # by shard, longest first
            ids = b.column("shard").to_numpy()
            at = 0
            while at < len(ids):
                if held and ids[at] != shard:
                    yield from flush(held)
                    held = []
                shard = ids[at]
                end = at + int((ids[at:] == shard).sum())
                held.append(b.slice(at, end - at))
                at = end
        if held:
            yield from flush(held)

    return run


def pack(docs: DataFrame, length=None, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, id_col: str = "doc_id", text_col: str = "text", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """bin_id, capacity, doc_id, piece, first_token, n_tokens, bin_offset: one
    row for each piece of each input row.

    ``length`` is a column of token counts (default: words of the text). A
    piece takes one token more for its end mark, so an empty or null text
    still has a piece, of 0 tokens; a longer document is cut at multiples of
    the largest size less one. Pieces are dealt into shards of about
    ``shard_pieces`` by the hash of id and piece; the order within a shard is
    total but for equal rows, so bins are the same in every run over one
    layout of the input. Rows with null or repeated ids are packed like others; those
    of an id on more than ``shard_pieces`` rows are dealt over several shards by
    their place in the input. An empty table gives an empty result. Other columns are ignored."""
    n = F.coalesce((length if length is not None else F.regexp_count(F.col(text_col), F.lit(WORD_CLASS + "+"))).cast("long"), F.lit(0))
    most = max(sizes) - 1
    times = docs.groupBy(F.col(id_col).alias("doc_id")).agg(F.count(F.lit(1)).alias("times"))
    # at most a row for each ``shard_pieces`` rows of the input
    many = times.where(F.col("times") > shard_pieces).select(F.col("doc_id").alias("many_id"), F.ceil(F.col("times") / F.lit(shard_pieces)).alias("parts"))
    rows, spread = docs.count(), not many.isEmpty()
    src = docs.select(F.col(id_col).alias("doc_id"), n.alias("n"), F.monotonically_increasing_id().alias("part") if spread else F.lit(0).cast("long").alias("part"))
    if spread:
        src = src.join(F.broadcast(many), F.col("doc_id").eqNullSafe(F.col("many_id")), "left")
        src = src.select("doc_id", "n", F.coalesce(F.pmod(F.xxhash64("part"), F.col("parts")), F.lit(0)).alias("part"))
    cut = src.select("doc_id", "n", "part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / most).cast("long") - 1))).alias("piece"))
    cut = cut.select("doc_id", "part", "piece", (F.col("piece") * most).alias("first_token"), F.least(F.lit(most), F.col("n") - F.col("piece") * most).cast("long").alias("n_tokens"))
    shards = max(1, -(-rows // shard_pieces))
    dealt = cut.select(F.pmod(F.xxhash64("doc_id", "piece", "part"), F.lit(shards)).alias("shard"), "doc_id", "piece", "first_token", "n_tokens")
    dealt = dealt.repartition(min(shards, MOST_TASKS), "shard").sortWithinPartitions("shard", F.col("n_tokens").desc(), "doc_id", "piece")
    kind = dealt.schema["doc_id"].dataType.simpleString()
    piece = dealt.schema["piece"].dataType.simpleString()
    return dealt.mapInArrow(_packer(tuple(sorted(sizes)), overhead), f"bin_id long, capacity int, doc_id {kind}, piece {piece}, first_token long, n_tokens long, bin_offset int")
