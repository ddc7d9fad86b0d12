"""Best-fit packing of documents into sequences, after a reduction by dominance (Martello and Toth).

A piece of a document counts by its length alone, and lengths are whole numbers up to the size of a sequence. So the whole instance is
a histogram of at most `size` counts, whatever the number of documents; it is packed in bulk, and the
outcome is, for each length, runs of piece numbers with the sequence and offset at which each run begins.

1. Dominance: for the longest piece left, a set of at most three pieces that takes part in some optimal packing, as every other set
   with this piece is no better, is fixed for good. Sets that fill a sequence are found on the way.
2. Best fit decreasing packs the rest: each piece goes into the fullest sequence that still takes it.
"""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.llm.encoding import CACHED_WORDS, encoder
from patchlake.llm.shared import kept, ranked, slices, text_or_empty

PIECE = "key long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(df: DataFrame, key: str, text: str, tokenizer: str, end_id: int, size: int, with_ids: bool = False, cached_words: int = CACHED_WORDS) -> DataFrame:
    """Token ids of each text and `end_id`; those of more than `size` ids are cut into pieces of `size`, the last
    may be shorter. Null and empty texts are one piece, the end id."""
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), text_or_empty(text).alias("text"))
    schema = PIECE + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches):
        coder, end = encoder(tokenizer, most=cached_words), np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches, 1024):
            out = []
            for k, ids in zip(batch["key"].to_pylist(), coder.encode(batch["text"].to_pylist())):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    out.append((k, n, at // 4, len(own) // 4, zlib.crc32(own), *([np.frombuffer(own, "<i4")] if with_ids else [])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds[: len(names)]], names=names)

    return rows.mapInArrow(cut, schema)


class Lengths:
    """How many pieces of each length are left, and the few questions asked about them."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size = size
        self.n = np.zeros(size + 1, dtype=np.int64)
        for length, n in counts.items():
            self.n[length] = n

    def take(self, pieces: tuple[int, ...], times: int) -> None:
        for x in pieces:
            self.n[x] -= times

    def without(self, length: int) -> np.ndarray:
        n = self.n.copy()
        n[length] -= 1
        return n

    def bulk(self, pieces: tuple[int, ...]) -> int:
        """So often may the set be fixed at once: while three of each length stay, all answers stay as they are."""
        return max(1, min((int(self.n[x]) - 3) // pieces.count(x) for x in pieces))


def dominating_set(left: Lengths, j: int) -> tuple[int, ...] | None:
    """A set with one piece of length `j`, the longest left, that dominates every set with it; None if none is proven."""
    n, room = left.without(j), left.size - j
    present = np.flatnonzero(n)
    smallest = np.repeat(present[:3], np.minimum(n[present[:3]], 3))[:3]
    k = int((np.cumsum(smallest) <= room).sum())
    if k == 0:
        return (j,)
    best = int(present[present <= room].max())
    if k == 1 or best == room:
        return (j, best)
    if k > 2:
        return None
    # at most two more fit: the fullest pair
    low = present[present <= room]
    partner = np.searchsorted(low, room - low, side="right") - 1
    pairs = [(int(a + low[p]), int(max(a, low[p])), int(min(a, low[p]))) for a, p in zip(low, partner) if p >= 0 and (low[p] != a or n[a] > 1)]
    pairs += [(int(a + low[p - 1]), int(a), int(low[p - 1])) for a, p in zip(low, partner) if p >= 1 and low[p] == a and n[a] == 1]
    total, a, b = max(pairs)
    if best >= total:
        return (j, best)
    if best != a:
        return None
    # a is the longest that fits: the pair dominates if nothing between a and b can stand in for both
    between = np.repeat(low[(low >= b) & (low <= a)], np.minimum(n[low[(low >= b) & (low <= a)]], 4))[::-1].tolist()
    between.remove(a)
    inner = [x for x in between if x > b]  # all but one copy of a, and what lies between
    if len(inner) <= 1 or inner[-1] + inner[-2] > room:
        return (j, a, b)
    return None


def packing_plan(counts: dict[int, int], size: int) -> tuple[dict[int, list[tuple]], dict]:
    """Runs for each length, as (low, high, sequence, in each, offset): the pieces numbered low to high - 1 lie
    from that sequence on, so many in each, from that offset on. And figures: sequences, fixed by dominance, lower bound."""
    left = Lengths(counts, size)
    groups: list[tuple[int, tuple[int, ...]]] = []  # (sequences, lengths in each)
    changed = True
    while changed:
        changed = False
        for j in np.flatnonzero(left.n)[::-1].tolist():
            while left.n[j] > 0 and (fixed := dominating_set(left, j)) is not None:
                times = int(left.n[j]) if len(fixed) == 1 else left.bulk(fixed)
                left.take(fixed, times)
                groups.append((times, fixed))
                changed = True
    n_fixed = sum(m for m, _ in groups)
    # best fit decreasing; open sequences by the room that is left in them
    open_by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for length in np.flatnonzero(left.n)[::-1].tolist():
        todo = int(left.n[length])
        while todo:
            room = min((r for r, held in open_by_room.items() if r >= length and held), default=None)
            if room is None:
                each = min(size // length, todo)
                many = todo // each
                open_by_room[size - each * length].append((many, (length,) * each))
                todo -= many * each
                continue
            many, held = open_by_room[room].pop()
            each = min(room // length, todo)
            use = min(many, todo // each)
            if use < many:
                open_by_room[room].append((many - use, held))
            open_by_room[room - each * length].append((use, held + (length,) * each))
            todo -= use * each
    groups += [g for held in open_by_room.values() for g in held]
    runs: dict[int, list[tuple]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for many, held in groups:
        offset = 0
        for length in dict.fromkeys(held):
            each = held.count(length)
            runs[length].append((used[length], used[length] + many * each, sequence, each, offset))
            used[length] += many * each
            offset += each * length
        sequence += many
    tokens = sum(k * v for k, v in counts.items())
    return dict(runs), {"sequences": sequence, "fixed": n_fixed, "lower_bound": -(-tokens // size)}


def packed(pieces: DataFrame, size: int, length: str = "length", order: tuple[str, ...] = ("key", "piece", "ids_crc32")) -> DataFrame:
    """Add sequence_id and offset (long). `pieces` is read three times and has to be cheap or kept; lengths are 1 to `size`.

    Pieces of one length are numbered by `order`; such equal in all of it may swap places. However many pieces have one length,
    they are numbered in parts. An empty table stays empty. Columns with the added names are replaced.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy(F.col(length).alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = packing_plan(counts, size)
    numbered = ranked(pieces.drop("sequence_id", "offset"), sum(counts.values()), [length], list(order), "_number")
    # at most `size` rows, with runs as many as there are distinct fillings: bounded by `size`, not by the documents
    table = pieces.sparkSession.createDataFrame(list(runs.items()), "_length long, _runs array<struct<low:long,high:long,sequence:long,each:long,offset:long>>")
    hit = F.get(F.filter("_runs", lambda r: (F.col("_number") >= r["low"]) & (F.col("_number") < r["high"])), 0)
    rows = numbered.join(F.broadcast(table), F.col(length) == F.col("_length")).withColumn("_hit", hit)
    at = F.col("_number") - F.col("_hit.low")
    return rows.select(
        *[F.col(f"`{c}`") for c in pieces.columns if c not in ("sequence_id", "offset")],
        (F.col("_hit.sequence") + F.floor(at / F.col("_hit.each"))).alias("sequence_id"),
        (F.col("_hit.offset") + F.pmod(at, F.col("_hit.each")) * F.col(length)).alias("offset"),
    )


def packed_documents(df: DataFrame, key: str, text: str, tokenizer: str, end_id: int, size: int, with_ids: bool = False, cached_words: int = CACHED_WORDS) -> DataFrame:
    """Pieces of all documents with their places: key, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    return packed(kept(cut_pieces(df, key, text, tokenizer, end_id, size, with_ids, cached_words)), size)
