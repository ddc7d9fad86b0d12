"""Token-aware batches for the embedding model, and the embedding calls.

Batches are filled in order: a text that would exceed the token limit, or that finds the batch full,
starts the next one. That makes every batch depend on all before it, so a large group is cut into
blocks:

1. For each block, on its own: if a batch starts at row e of the block, at which row of the next
   block does the first batch there start, and how many batches start in between? A batch has at most
   `max_items` rows, so only the first `max_items` rows of a block can be the first start.
2. These small tables are chained, FAN blocks at a time, to give each block its true first start.
3. Each block numbers its rows.

The first block of a group starts with a batch, so groups of one block take step 3 only. No task holds
more than one block of rows or FAN tables, but for one short list of chained tables per group: one
table for BLOCK * FAN = 8 million rows.
"""

import itertools
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake import fixed
from patchlake.functions import text
from patchlake.functions.frames import computed, exploded, map_groups, null_safe_join, partitioned, runs_of, whole_runs
from patchlake.functions.vectors import unit_rows

BLOCK = 16384
FAN = 512


def _next_starts(tokens: np.ndarray, own: int, max_tokens: int, max_items: int) -> np.ndarray:
    """For a batch that starts at row i, the row at which the next one starts."""
    upto = np.concatenate([[0], np.cumsum(tokens)])
    rows = np.arange(own)
    too_many_tokens = np.searchsorted(upto, upto[:own] + max_tokens, side="right") - 1
    return np.minimum(np.maximum(too_many_tokens, rows + 1), np.minimum(rows + max_items, len(tokens)))


def batch_starts(tokens: np.ndarray, max_tokens: int = fixed.BATCH_TOKENS, max_items: int = fixed.BATCH_ITEMS) -> list[int]:
    """The rows at which batches start, over all rows of a group in order."""
    nexts, starts, at = _next_starts(tokens, len(tokens), max_tokens, max_items).tolist(), [], 0
    while at < len(tokens):
        starts.append(at)
        at = nexts[at]
    return starts


def _own_rows(df: DataFrame, group: list[str], pos: str, tokens: str, block: int) -> DataFrame:
    narrow = df.select(*group, F.col(pos).cast("long").alias("_pos"), F.col(tokens).cast("long").alias("_tokens"))
    return narrow.withColumn("_block", F.floor(F.col("_pos") / block))


def _seen_rows(own: DataFrame, block: int, max_items: int) -> DataFrame:
    """Rows by block; the first rows of a block are also given to the one before, which has to look ahead."""
    home = F.col("_block")
    seen_by = F.when((F.col("_pos") % block < max_items) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    return own.withColumn("_block", F.explode(seen_by))


def _fields(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [df.schema[name] for name in names]


def _long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def token_batches(
    df: DataFrame,
    group: list[str],
    pos: str,
    tokens: str,
    max_tokens: int = fixed.BATCH_TOKENS,
    max_items: int = fixed.BATCH_ITEMS,
    block: int = BLOCK,
) -> DataFrame:
    """Batch number, from 0, of every (group, pos). `pos` numbers the rows of a group from 0 without gaps.

    The rows are read several times, so they should come from a table.
    """
    block = max(block, max_items)

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        number = int(part["_block"].iloc[0])
        own = int((part["_pos"] < (number + 1) * block).sum())
        nexts = _next_starts(part["_tokens"].to_numpy(), own, max_tokens, max_items).tolist()
        exits, counts = [0] * own, [0] * own
        for i in range(own - 1, -1, -1):
            after = nexts[i]
            exits[i], counts[i] = (exits[after], counts[after] + 1) if after < own else (after - own, 1)
        missing = max(0, max_items - own)  # a short block is the last one: nothing starts behind its end
        first = part[group].iloc[[0]].reset_index(drop=True)
        return first.assign(
            _block=number,
            exits=[exits[:max_items] + [0] * missing],
            counts=[counts[:max_items] + [0] * missing],
        )[[*group, "_block", "exits", "counts"]]

    long_array = T.ArrayType(T.LongType())
    table_type = T.StructType(
        [*_fields(df, group), _long("_block"), T.StructField("exits", long_array), T.StructField("counts", long_array)]
    )
    start = {"_entry": F.lit(0).cast("long"), "_base": F.lit(0).cast("long")}
    own = _own_rows(df, group, pos, tokens, block)
    first = _numbered(own.where(F.col("_block") == 0).withColumns(start), group, max_tokens, max_items, block)
    rows = _seen_rows(own, block, max_items)
    large = rows.where(F.col("_block") == 1).select(*group).distinct()
    tables = map_groups(null_safe_join(rows, large, group, "left_semi"), [*group, "_block"], ["_pos"], chain, table_type)
    entries = _entries(tables, group, max_items).where(F.col("_block") > 0)
    placed = null_safe_join(own.where(F.col("_block") > 0), entries, [*group, "_block"])
    later = _numbered(placed, group, max_tokens, max_items, block)
    return first.unionByName(later).withColumnRenamed("_pos", pos)


def _numbered(placed: DataFrame, group: list[str], max_tokens: int, max_items: int, block: int) -> DataFrame:
    """Batch of every row, given the first start in its block and the number of batches before that.

    A block's counts become one array; it is walked once, and the starts give ranges of rows.
    """
    keys = [*group, "_block", "_entry", "_base"]
    rows = F.array_sort(F.collect_list(F.struct("_pos", "_tokens")))
    blocks = placed.groupBy(*keys).agg(F.transform(rows, lambda row: row["_tokens"]).alias("counts"))
    blocks = blocks.withColumns({"_from": F.col("_block") * block, "_last": F.col("_block") * block + F.size("counts") - 1})
    blocks = computed(blocks, starts=F.expr(f"""aggregate(slice(counts, cast(_entry as int) + 1, size(counts)),
        named_struct('starts', cast(array() as array<bigint>), 'at', _from + _entry, 'items', 0L, 'n', 0L),
        (acc, t) -> if(acc.items = 0 or acc.n + t > {max_tokens} or acc.items >= {max_items},
            named_struct('starts', array_append(acc.starts, acc.at), 'at', acc.at + 1, 'items', 1L, 'n', t),
            named_struct('starts', acc.starts, 'at', acc.at + 1, 'items', acc.items + 1, 'n', acc.n + t)),
        acc -> acc.starts)"""))
    # Rows ahead of the first start still belong to the batch before it.
    blocks = computed(blocks, starts=F.expr("if(_entry > 0, concat(array(_from), starts), starts)"))
    spans = F.expr("""transform(starts, (s, j) -> named_struct(
        'rows', sequence(s, coalesce(get(starts, j + 1) - 1, _last)), 'batch', _base - if(_entry > 0, 1, 0) + j))""")
    return exploded(exploded(blocks, group, spans), [*group, "batch"], F.col("rows"), "_pos").select(*group, "_pos", "batch")


_WALK = """aggregate(kids,
    named_struct('at', _entry, 'n', _base,
                 'seen', cast(array() as array<struct<_block:bigint,_entry:bigint,_base:bigint>>)),
    (acc, k) -> named_struct('at', get(k.exits, acc.at), 'n', acc.n + get(k.counts, acc.at),
        'seen', array_append(acc.seen, named_struct('_block', k._block, '_entry', acc.at, '_base', acc.n))),
    acc -> acc.seen)"""


def _entries(tables: DataFrame, group: list[str], max_items: int) -> DataFrame:
    """First start (`_entry`) and number of batches before it (`_base`) of every block."""

    def gathered(parts: DataFrame, *keys: Column) -> DataFrame:
        kids = F.array_sort(F.collect_list(F.struct("_block", "exits", "counts"))).alias("kids")
        return parts.groupBy(*group, *keys).agg(kids)

    families = gathered(tables, F.floor(F.col("_block") / FAN).alias("_family"))
    through = F.expr(
        f"""transform(sequence(0, {max_items - 1}), e -> aggregate(kids,
            named_struct('at', cast(e as bigint), 'n', 0L),
            (acc, k) -> named_struct('at', get(k.exits, acc.at), 'n', acc.n + get(k.counts, acc.at))))"""
    )
    chained = computed(families, t=through).select(
        *group, F.col("_family").alias("_block"), F.col("t.at").alias("exits"), F.col("t.n").alias("counts")
    )
    top = gathered(chained).withColumns({"_entry": F.lit(0).cast("long"), "_base": F.lit(0).cast("long")})
    known = top.select(*group, F.inline_outer(F.expr(_WALK))).withColumnRenamed("_block", "_family")
    return null_safe_join(families, known, [*group, "_family"]).select(*group, F.inline_outer(F.expr(_WALK)))


def embed_texts(
    df: DataFrame,
    group: list[str],
    pos: str,
    source: str,
    embed: Callable[[list[str]], list[list[float]]],
    size: int = fixed.EMBEDDING_SIZE,
    max_tokens: int = fixed.BATCH_TOKENS,
    max_items: int = fixed.BATCH_ITEMS,
    tokens: str | None = None,
) -> DataFrame:
    """Embed the texts in token-aware batches, one model call per batch.

    Adds `batch`, `embedding`, `embed_ok` and `embed_seconds`. The texts of a failed call get zeros.
    The input should be a table, as it is read several times. With `tokens`, a column of the tokens of
    each cut text, the texts themselves are read once, for the calls. Save the result before it is used more
    than once, or the model is called again.
    """
    cut = df.withColumn("_text", text.truncate(F.col(source)))
    counted = df if tokens else cut.withColumn("_n", text.tokens(F.col("_text")))
    numbered = token_batches(counted, group, pos, tokens or "_n", max_tokens, max_items)
    return embed_batches(null_safe_join(cut.select(*group, pos, "_text"), numbered, [*group, pos]), group, pos, embed, size)


class ModelCalls:
    """Calls of a model for whole batches of texts, and what they give as Arrow arrays."""

    def __init__(self, embed: Callable[[list[str]], list[list[float]]], size: int, unit: bool):
        self.embed, self.size, self.unit = embed, size, unit

    def _call(self, texts: list[str]) -> tuple[list[list[float]] | np.ndarray, bool, float]:
        begin = time.monotonic()
        try:
            vectors = self.embed(texts)
            if not _is_matrix(vectors):
                vectors = [list(map(float, vector)) for vector in vectors]
            ok = len(vectors) == len(texts)
        except Exception:  # a failed call is a result here
            ok = False
        return vectors if ok else [[0.0] * self.size] * len(texts), ok, time.monotonic() - begin

    def __call__(self, texts: list[str], spans: list[tuple[int, int]]) -> list[pa.Array]:
        """Vector, success and seconds for each text; a span of texts is one call."""
        calls = [self._call(texts[a:b]) for a, b in spans]
        sizes = [n for found, _, _ in calls for n in ([found.shape[1]] * len(found) if _is_matrix(found) else map(len, found))]
        ends = np.cumsum([0, *sizes]).astype("int32")
        with np.errstate(over="ignore"):
            flat = [found.ravel() if _is_matrix(found) else np.fromiter(itertools.chain.from_iterable(found), dtype="float64") for found, _, _ in calls]
            flat = np.concatenate(flat).astype("float32")
            if self.unit and len(flat):
                cuts = [ends] if len(set(sizes)) == 1 else [ends[k : k + 2] for k in range(len(sizes))]
                flat = np.concatenate([unit_rows(flat, some).ravel() for some in cuts]).astype("float32")
        lengths = [b - a for a, b in spans]
        facts = [pa.array(np.repeat(np.array([one[k] for one in calls], dtype=kind), lengths)) for k, kind in ((1, bool), (2, float))]
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), *facts]


def _is_matrix(vectors: object) -> bool:
    return isinstance(vectors, np.ndarray) and vectors.ndim == 2 and vectors.dtype.kind == "f"


VECTOR_FIELDS = [
    T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("embed_ok", T.BooleanType()), T.StructField("embed_seconds", T.DoubleType()),
]


def embed_batches(
    ready: DataFrame, group: list[str], pos: str, embed: Callable[[list[str]], list[list[float]]], size: int = fixed.EMBEDDING_SIZE,
    keep: list[str] = (), source: Column | None = None, unit: bool = False,
) -> DataFrame:
    """One model call for each `batch` of a group, with the texts in `_text` by `pos`. Columns in `keep` go along, so that
    what is known of a text needs no join with its vector. With `source`, the texts are made of the other columns where the call is, and
    do not travel beside what they are made of. With `unit`, vectors are scaled as nearest.normalized does.

    A batch of the model is put together from the Arrow batches that hold its rows; one at a time is held. The model may give its vectors
    as lists or as the rows of a matrix of floats, which is taken as it is.
    """
    keys, kept = [*group, "batch"], [*group, pos, *keep, "batch"]
    fields = [*_fields(ready, kept[:-1]), _long("batch")]
    out_type = T.StructType([*fields, *VECTOR_FIELDS])

    calls = ModelCalls(embed, size, unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in whole_runs(batches, keys):
            rows = pa.Table.from_batches(parts).combine_chunks()
            for batch in rows.to_batches():
                texts = batch["_text"].to_pylist()
                starts = runs_of(batch, keys)
                arrays = [*[batch[name] for name in kept], *calls(texts, list(zip(starts, [*starts[1:], len(texts)])))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(field.name for field in VECTOR_FIELDS)])

    rows = partitioned(ready, *keys).sortWithinPartitions(*keys, pos)
    rows = rows.select(*kept, "_text") if source is None else rows.select(*kept, source.alias("_text"))
    return rows.mapInArrow(run, out_type)


def embed_queries(df: DataFrame, source: str, embed: Callable[[list[str]], list[list[float]]], out: str = "embedding") -> DataFrame:
    """Embed one text per call, as searches do. A failed call gives null, and so no matches; so does a null, without a call."""
    kept = [name for name in df.columns if name != source]
    out_type = T.StructType([*_fields(df, kept), T.StructField(out, T.ArrayType(T.FloatType()))])
    cut = df.withColumn(source, text.truncate(F.col(source)))

    def one(value: str) -> list[float] | None:
        try:
            return list(map(float, embed([value])[0]))
        except Exception:  # a failed call is a result here
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([None if value is None else one(value) for value in batch[source].to_pylist()], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(batch[name] for name in kept), found], names=[*kept, out])

    return cut.select(*kept, source).mapInArrow(run, out_type)


def embedding_calls(embedded: DataFrame, group: list[str]) -> DataFrame:
    """One row per model call: size, seconds and success, as the metric points need them."""
    return embedded.groupBy(*group, "batch").agg(
        F.count("*").alias("batch_size"), F.first("embed_seconds").alias("duration"), F.first("embed_ok").alias("success")
    )
