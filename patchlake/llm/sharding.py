"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a ring; a row goes to the shard of the first point at or after its own. A shard
takes no more rows than its bound, and what comes beyond goes on clockwise to the next shard with room. The
bounds add up to the rows, so counts differ by one at most, and only rows beyond a bound leave their home.

Rows never meet on the driver: it sees a count per arc of the ring, of which there are shards x virtual nodes.
"""

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake.llm.shared import ranked

RING = 1 << 60  # points are the first 15 hexadecimal digits of an md5
CELLS = 4096


def ring(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(point, shard) in order of the ring."""
    return sorted((int(hashlib.md5(f"shard {s} point {v}".encode()).hexdigest()[:15], 16), s) for s in range(shards) for v in range(virtual))


def _point(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _arc(point: Column, points: list[int]) -> Column:
    """Index of the first point at or after `point`, 0 after the last: a look into a cell, then at the few points in it."""
    first = [bisect_left(points, c * (RING // CELLS)) for c in range(CELLS + 1)]
    cell = F.shiftright(point, 48).cast("int")
    starts, all_points = (F.from_json(F.lit(json.dumps(x)), kind) for x, kind in ((first, "array<int>"), (points, "array<bigint>")))
    low, high = F.element_at(starts, cell + 1), F.element_at(starts, cell + 2)
    smaller = F.size(F.filter(F.slice(all_points, low + 1, high - low), lambda p: p < point))
    return (low + smaller) % len(points)


def plan(counts: dict[int, int], owners: list[int], shards: int) -> list[dict]:
    """Cut the rows of each arc into runs: {arc, low, high, shard, slot}. The run's rows, by their number in the
    arc, go to `shard`, from `slot` on. Rows go home first; then what is left goes clockwise, arc by arc."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    load, runs, left = [0] * shards, [], {}

    def take(arc: int, low: int, rows: int, shard: int) -> int:
        n = min(rows, room[shard])
        if n:
            runs.append({"arc": arc, "low": low, "high": low + n, "shard": shard, "slot": load[shard]})
            room[shard] -= n
            load[shard] += n
        return low + n

    for arc in sorted(counts):
        low = take(arc, 0, counts[arc], owners[arc])
        if low < counts[arc]:
            left[arc] = low
    for arc, low in left.items():
        at = arc
        while low < counts[arc]:
            at = (at + 1) % len(owners)
            low = take(arc, low, counts[arc] - low, owners[at])
    return runs


def sharded(df: DataFrame, key: str, tie: list[str], shards: int, virtual: int = 128) -> DataFrame:
    """Add shard (int), slot (long, gapless from 0 in each shard) and moved (not in its home shard).

    `key` decides where a row stands on the ring; `tie` columns tell rows with equal keys apart. Null keys
    stand where an empty string does. Rows equal in all of them may swap places with each other. However many
    rows share a key, they are spread: their arc is full and they go on clockwise. An empty table stays empty.
    `df` is read three times and has to be cheap or kept; columns named as the added ones are replaced.
    """
    nodes = ring(shards, virtual)
    points, owners = [p for p, _ in nodes], [s for _, s in nodes]
    names = [c for c in df.columns if c not in ("shard", "slot", "moved")]
    ties = [f"_tie{i}" for i in range(len(tie))]
    # the row travels as one column, so that its names can't clash with those used here
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    placed = df.select(row, _point(F.col(f"`{key}`")).alias("_point"), *[F.col(f"`{c}`").alias(t) for c, t in zip(tie, ties)])
    placed = placed.withColumn("_arc", F.transform(F.array("_point"), lambda p: _arc(p, points))[0])
    counts = {r["_arc"]: r["n"] for r in placed.groupBy("_arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    numbered = ranked(placed, sum(counts.values()), ["_arc"], ["_point", *ties], "_number")
    by_arc: list[list[tuple]] = [[] for _ in nodes]
    for r in plan(counts, owners, shards):
        by_arc[r["arc"]].append((r["high"], r["low"], r["shard"], r["slot"], r["shard"] != owners[r["arc"]]))
    # at most a run per arc and shard; a literal, sorted by arc, so that no join is needed
    runs = df.sparkSession.createDataFrame(
        [(arc, sorted(x)) for arc, x in enumerate(by_arc)],
        "_arc int, _runs array<struct<high:long,low:long,shard:int,slot:long,moved:boolean>>",
    )
    hit = F.get(F.filter("_runs", lambda r: (F.col("_number") >= r["low"]) & (F.col("_number") < r["high"])), 0)
    rows = numbered.join(F.broadcast(runs), "_arc").withColumn("_hit", hit)
    return rows.select(
        "_row.*",
        F.col("_hit.shard").alias("shard"),
        (F.col("_hit.slot") + F.col("_number") - F.col("_hit.low")).alias("slot"),
        F.col("_hit.moved").alias("moved"),
    )
