"""Exact nearest chunks by inner product.

A grid of cells is laid over the queries and the chunks of a group: a query goes to one row of cells, a chunk to one column. How many
rows and columns a group has follows from its counts, so a cell is of a set size however large its group, small groups are one
cell each, and each row is copied as often as its own group's grid is wide, and no more. In a cell the queries are held as one matrix, the
chunks stream by in blocks, and only the best of each query are kept. Pairs are never emitted.

Blocks that can't reach a query are not multiplied with it. A block is cut into parts around a few of its own vectors; no vector of
a part scores more than the query's score with the part's centre and its length times the part's radius. Where that is below the
worst of the k best so far, the part is passed over for this query. The result is exact; how much is saved depends on how the vectors cluster.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake import fixed
from patchlake.functions import vectors
from patchlake.functions.frames import computed, exploded, null_safe_join, partitioned, runs_of
from patchlake.operators.batches import embed_queries

CHUNK_BLOCK = 4096
#: About as many queries, which a task holds, and chunks, which stream by, make a cell.
CELL_QUERIES, CELL_CHUNKS = 4096, 131_072
#: A group of more rows of cells than the first has fewer of them, each of up to so many times the queries: chunks are copied once per row.
MANY_ROWS, TALLER = 64, 4
#: Pairs of queries and chunks that are compared at a time.
MOST_PAIRS = CELL_QUERIES * CHUNK_BLOCK
#: Parts that a block of chunks is cut into, of about this many rows at least.
PARTS, PART_ROWS = 32, 32
#: Scores are kept as floats: a bound closer than this to a score does not rule anything out.
SLACK = 1e-5
#: Error of a product of unit vectors in single precision, per element.
ROUNDING = 2.5e-7
#: Up to so many pairs of queries and chunks, a block is not cut into parts.
FEW_PAIRS = 65_536


def normalized(df: DataFrame, vector: str = "embedding") -> DataFrame:
    measured = computed(df, _norm=vectors.norm(F.col(vector)))
    return measured.withColumn(vector, vectors.normalize(F.col(vector), F.col("_norm"))).drop("_norm")


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best scores of each row; equal scores go to the lower column."""
    k = min(k, scores.shape[1])
    floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    rows, columns = np.nonzero(scores >= floor[:, None])
    order = np.lexsort((columns, -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[rank < k], columns[rank < k]


def _parts(block: np.ndarray) -> list[np.ndarray]:
    """Places of the rows of each part, in order; a row goes to the one of some evenly picked rows that it is closest to."""
    n = min(PARTS, len(block) // PART_ROWS)
    if n < 2:
        return [np.arange(len(block))]
    picked = block[np.arange(n) * len(block) // n]
    label = (block @ picked.T - (picked**2).sum(axis=1) / 2).argmax(axis=1)
    return [np.flatnonzero(label == one) for one in np.unique(label)]


class _Cell:
    """The queries of one cell, and the best chunks seen so far for each."""

    def __init__(self, key: tuple, k: int):
        self.key, self.k = key, k
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.matrix: np.ndarray | None = None
        self.found: list[tuple] = []
        self.full = False  # whether every query has k chunks
        self.pruned = True  # whether `found` holds no more than the k best of each
        self.pairs = self.skipped = 0  # of queries with parts of blocks

    def add_queries(self, *part: np.ndarray) -> None:
        self.parts.append(part)

    def add_chunks(self, block: np.ndarray, idx: np.ndarray, file: np.ndarray) -> None:
        if self.matrix is None:
            if not self.parts:
                return
            self.matrix, self.idx, self.file = (np.concatenate(x) for x in zip(*self.parts))
            self.narrow = self.matrix.astype(np.float32)
            self.lengths = np.linalg.norm(self.matrix, axis=1)
            self.worst = np.full(len(self.matrix), -np.inf)  # score of the k-th best so far
        most = max(MOST_PAIRS // len(self.matrix), 1)
        for at in range(0, len(block), most):
            self._add_block(block[at : at + most], idx[at : at + most], file[at : at + most])

    def _add_block(self, block: np.ndarray, idx: np.ndarray, file: np.ndarray) -> None:
        for rows in _parts(block) if len(self.matrix) * len(block) > FEW_PAIRS else [np.arange(len(block))]:
            self._compare(block[rows], idx[rows], file[rows])

    def _compare(self, vectors: np.ndarray, idx: np.ndarray, file: np.ndarray) -> None:
        centre = vectors.mean(axis=0)
        radius = np.sqrt(((vectors - centre) ** 2).sum(axis=1).max())
        near = np.flatnonzero(self.matrix @ centre + self.lengths * radius + SLACK >= self.worst)
        self.pairs += len(self.matrix)
        self.skipped += len(self.matrix) - len(near)
        if not len(near):
            return
        rows, columns, scores = self._above(near, vectors) if self.full else self._top(near, vectors)
        self.found.append((near[rows], idx[columns], file[columns], scores))
        self.pruned = False
        if not self.full or sum(len(x[0]) for x in self.found) > 4 * self.k * len(self.matrix) or len(self.found) == 64:
            self._prune()

    def _top(self, near: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        asked = self.matrix if len(near) == len(self.matrix) else self.matrix[near]
        scores = (asked @ vectors.T).astype(np.float32)
        rows, columns = _best(scores, self.k)
        return rows, columns, scores[rows, columns]

    def _above(self, near: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Only pairs that reach the worst of the k best are of use. Which may do so is found in single precision, with room for its
        error, and the few that do are worked out in full. Where they are many, as among copies, the k best are taken as before."""
        asked = self.narrow if len(near) == len(self.matrix) else self.narrow[near]
        floor = (self.worst[near] - SLACK - ROUNDING * vectors.shape[1]).astype(np.float32)
        reached = np.flatnonzero(asked @ vectors.T.astype(np.float32) >= floor[:, None])  # a search in two dimensions takes several times as long
        if len(reached) > 4 * self.k * len(near):
            return self._top(near, vectors)
        rows, columns = np.divmod(reached, len(vectors))
        scores = np.einsum("ij,ij->i", self.matrix[near[rows]], vectors[columns]).astype(np.float32)
        kept = scores >= self.worst[near[rows]]
        return rows[kept], columns[kept], scores[kept]

    def _prune(self) -> None:
        rows, idx, file, score = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((idx, -score, rows))
        sorted_rows = rows[order]
        order = order[np.arange(len(rows)) - np.searchsorted(sorted_rows, sorted_rows) < self.k]
        self.found = [(rows[order], idx[order], file[order], score[order])]
        rows, *_, score = self.found[0]
        last = np.flatnonzero(np.append(rows[1:] != rows[:-1], True)) if len(rows) else np.zeros(0, int)
        full = last[np.diff(last, prepend=-1) == self.k]
        self.worst[rows[full]] = score[full]
        self.full, self.pruned = len(full) == len(self.matrix), True

    def result(self) -> tuple[np.ndarray, ...] | None:
        """For each pair that was kept: query, chunk, whether both are of one file, score."""
        if not self.found:
            return None
        if not self.pruned:
            self._prune()
        rows, idx, file, score = self.found[0]
        own = [a is not None and a == b for a, b in zip(self.file[rows], file)]
        return self.idx[rows], idx, np.array(own, dtype=bool), score


def _with_grid(
    queries: DataFrame, chunks: DataFrame, group: list[str], cell_size: tuple[int, int], grid: tuple[int, int] | None = None, most_queries: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both with the rows and columns of their group's grid. Rows are counted without a look at their vectors, and only groups that are larger
    than a cell are joined with their number of cells: where there is none, nothing is joined."""
    if grid:
        return tuple(df.withColumns({"_rows": F.lit(grid[0]), "_columns": F.lit(grid[1])}) for df in (queries, chunks))
    sides = list(zip((queries, chunks), cell_size, ("_rows", "_columns")))
    if most_queries:
        rows = F.lit(-(-most_queries // cell_size[0]))
        queries, chunks, sides = queries.withColumn("_rows", rows), chunks.withColumn("_rows", rows), sides[1:]
    for df, size, name in sides:
        full = F.count("*") / size
        cells = F.ceil(F.greatest(F.least(full, F.lit(MANY_ROWS)), full / TALLER) if name == "_rows" else full).cast("int").alias(name)
        large = df.groupBy(*group).agg(cells).where(F.col(name) > 1)
        if not group or large.isEmpty():
            known = F.lit(1 if group else max(df.agg(cells).first()[0], 1))  # one row of a number
            queries, chunks = queries.withColumn(name, known), chunks.withColumn(name, known)
        else:
            queries, chunks = (null_safe_join(one, large, group, "left").withColumn(name, F.coalesce(name, F.lit(1))) for one in (queries, chunks))
    return queries, chunks


def nearest(
    queries: DataFrame,
    chunks: DataFrame,
    group: list[str],
    k: int = fixed.TOP_K,
    exclude_own_file: bool = False,
    overfetch: int = fixed.OVERFETCH,
    chunk_block: int = CHUNK_BLOCK,
    cell_size: tuple[int, int] = (CELL_QUERIES, CELL_CHUNKS),
    grid: tuple[int, int] | None = None,
    most_queries: int | None = None,
    counted: tuple[Accumulator, Accumulator] | None = None,
) -> DataFrame:
    """The k best chunks of every query within its group: group, query_idx, chunk_idx, score, rank.

    Queries have `query_idx`, `embedding` and, to leave out their own file, `file_path`; chunks have
    `chunk_idx`, `file_path` and `embedding`. The indexes are whole numbers, unique in their group.
    Vectors are normalized here. Scores are kept as floats and ties go to the lower chunk_idx.

    With `exclude_own_file`, overfetch * k chunks are fetched before the own file's are dropped, so a
    file that owns most of the nearest chunks can leave a query with fewer than k. A task holds the queries of one cell at a time, so
    `cell_size` (queries, chunks; TALLER times the queries where they are many) has to fit a worker; both inputs are counted by group first, unless a `grid` (rows, columns) is
    given for all groups. With `most_queries`, a bound of a group's queries, these are not counted, as where they come from a model. Null groups
    are groups like others.
    `counted` are two accumulators of the session: pairs of a query with a part of a block, and how many of these were passed over.
    """
    fetched = k * overfetch if exclude_own_file else k
    own_file = F.col("file_path") if exclude_own_file else F.lit(None).cast("string")

    queries, chunks = _with_grid(queries, chunks, group, cell_size, grid, most_queries)
    queries, chunks = queries.where(F.size("embedding") > 0), chunks.where(F.size("embedding") > 0)

    def copies(n: str, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)

    left = queries.select(
        *group, F.pmod(F.xxhash64("query_idx"), F.col("_rows")).cast("int").alias("_row"), copies("_columns", "_column"),
        F.lit(0).alias("side"), F.col("query_idx").alias("idx"), own_file.alias("file"), "embedding",
    )
    right = chunks.select(
        *group, copies("_rows", "_row"), F.pmod(F.xxhash64("chunk_idx"), F.col("_columns")).cast("int").alias("_column"),
        F.lit(1).alias("side"), F.col("chunk_idx").alias("idx"), F.col("file_path").alias("file"), "embedding",
    )
    both = left.unionByName(right)
    index_type = both.schema["idx"].dataType
    fields = [*[both.schema[name] for name in group], T.StructField("query_idx", index_type)]
    fields += [T.StructField("chunk_idx", index_type), T.StructField("own", T.BooleanType())]
    fields += [T.StructField("score", T.FloatType())]
    cell = [*group, "_row", "_column"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Cell | None = None
        ready: list[tuple[tuple, tuple]] = []

        def close() -> None:
            if held is None:
                return
            if counted:
                counted[0].add(held.pairs)
                counted[1].add(held.skipped)
            if (rows := held.result()) is not None:
                ready.append((held.key, rows))

        def given(kinds: pa.Schema) -> pa.RecordBatch:
            """The rows of the cells that are done, in one batch."""
            n = [len(rows[0]) for _, rows in ready]
            arrays = [pa.array([value for (key, _), m in zip(ready, n) for value in [key[i]] * m], kinds.field(name).type) for i, name in enumerate(group)]
            types = [kinds.field("idx").type, kinds.field("idx").type, pa.bool_(), pa.float32()]
            arrays += [pa.array(np.concatenate([rows[i] for _, rows in ready]), kind, from_pandas=i < 2) for i, kind in enumerate(types)]
            ready.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[*group, "query_idx", "chunk_idx", "own", "score"])

        kinds = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = batch.schema
            ends, flat = batch["embedding"].offsets.to_numpy(), batch["embedding"].values.to_numpy(zero_copy_only=False)
            idx, file = (batch[name].to_numpy(zero_copy_only=False) for name in ("idx", "file"))
            starts = runs_of(batch, [*cell, "side"])
            # cells are often small: vectors of one length are scaled all at once
            unit = vectors.unit_rows(flat, ends) if (np.diff(ends) == ends[1] - ends[0]).all() else None
            for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
                key, is_chunk = tuple(batch[name][start].as_py() for name in cell), batch["side"][start].as_py()
                if held is None or key != held.key:
                    close()
                    held = _Cell(key, fetched)
                for at in range(start, stop, chunk_block):
                    to = min(at + chunk_block, stop)
                    rows = vectors.unit_rows(flat, ends[at : to + 1]) if unit is None else unit[at:to]
                    (held.add_chunks if is_chunk else held.add_queries)(rows, idx[at:to], file[at:to])
            if ready:
                yield given(kinds)
        close()
        if ready:
            yield given(kinds)

    found = partitioned(both, *cell).sortWithinPartitions(*cell, "side", "idx").mapInArrow(run, T.StructType(fields))

    order = Window.partitionBy(*group, "query_idx").orderBy(F.desc("score"), "chunk_idx")
    best = found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= fetched)
    if exclude_own_file:
        best = best.where(~F.col("own"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(*group, "query_idx", "chunk_idx", "score", "rank")


def find_by_name(
    chunks: DataFrame,
    group: list[str],
    names: list[str],
    k: int = fixed.TOP_K,
    embed: Callable[[list[str]], list[list[float]]] | None = None,
) -> DataFrame:
    """Chunks whose name holds one of the names, in any case; first k by chunk_idx, score 1.

    Names without any such chunk in a group are searched by meaning, if a model is given.
    """
    wanted = F.array(*[F.lit(name) for name in names])
    matched = F.filter(wanted, lambda one: F.contains(F.lower("name"), F.lower(one)))
    hits = exploded(chunks.where(F.col("name") != ""), [*group, "chunk_idx"], matched, "query")
    order = Window.partitionBy(*group, "query").orderBy("chunk_idx")
    by_name = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        *group, "query", "chunk_idx", F.lit(1.0).cast("float").alias("score"), "rank"
    )
    if embed is None:
        return by_name
    numbered = F.posexplode(wanted).alias("query_idx", "query")
    groups = chunks.select(*group).distinct() if group else chunks.sparkSession.range(1).select()
    found = hits.select(*group, "query").distinct().withColumn("_found", F.lit(True))
    unmatched = null_safe_join(groups.select(*group, numbered), found, [*group, "query"], "left").where("_found is null").drop("_found")
    # the distinct names are few, as they are parameters: each is embedded once, whatever the number of groups
    meant = unmatched.select("query").distinct().withColumn("_text", F.concat(F.lit("function "), F.col("query")))
    asked = unmatched.join(embed_queries(meant, "_text", embed), "query")
    found = null_safe_join(nearest(asked, chunks, group, k, most_queries=len(names)), unmatched, [*group, "query_idx"])
    return by_name.unionByName(found.select(*group, "query", "chunk_idx", "score", "rank"))
