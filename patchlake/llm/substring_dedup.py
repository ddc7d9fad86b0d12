"""Repeated spans of words, by compaction of a de Bruijn graph.

A window of consecutive words is an edge of the graph, between its first and its last words but one. Of the edges only those that stand in several
documents matter, with all their places and their source, the place where they come first. A path is a run of such edges of which each
follows the one before at all of its places: nothing branches off inside, so wherever its first edge stands, the whole path stands. Paths
instead of edges are joined to the documents, and the words at each place are checked against those at the source by a fingerprint. A
path that fails the check (two windows have one hash) is taken apart into its edges, which are told apart by their words.

Most windows stand in one document and never leave it. Every window of `window` words holds the same smallest one of its short runs of
words wherever it stands (its anchor); only anchors are counted over all documents, about one for seven windows, and only windows whose
anchor stands in several documents become edges. Windows that come again in their own document are found there.

The documents are dealt once, by a number of their own, into a bucketed table that later steps join without moving texts.
"""

import uuid
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlake.llm.shared import kept, shared_folder
from patchlake.llm.shingles import _mixed, _word_hashes

#: A null id comes after all others.
LAST = 2**63 - 1
_SLAB = 1_000_000  # characters of text that are hashed at once
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, x in enumerate((_BASE, _BACK)):
            steps = np.full(max(n, 2 * _SLAB // 5), x, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    power, back = _powers(len(hashes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power, dtype=np.uint64)])
    return _mixed((sums[k:] - sums[:-k]) * back[: len(hashes) - k + 1])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _slabs(texts: list[str]):
    """(first text, texts) with a bounded number of characters, one text at least."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > _SLAB:
            yield at, texts[at:k]
            at, size = k, 0
        size += len(text) + 1
    if at < len(texts):
        yield at, texts[at:]


def windows(texts: list[str], window: int, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every window of words of each text: the text's place, the window's start, its hash and its anchor."""
    raw = [t.encode() for t in texts]
    hashes, starts = _word_hashes(b"\n".join(raw) + b"\n")
    first = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in raw]))
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    whole = rolled(hashes, window)
    anchors = _least(rolled(hashes, short), window - short + 1)
    inside = owner[: len(whole)] == owner[window - 1 :] if len(whole) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    return owner[at], at - first[owner[at]], whole[at], anchors[at]


def _again(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of windows whose hash stands in their text before, and the first such place."""
    order = np.lexsort((hashes, owner))  # stable: earlier starts first
    same = np.concatenate([[False], (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])])
    first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))] if len(order) else order
    return order[same], first[same]


def _spans(starts: list[int], window: int) -> list[tuple[int, int]]:
    """(start, words) that windows at these starts cover, joined where they overlap."""
    out: list[list[int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + window)
        else:
            out.append([s, s + window])
    return [(a, b - a) for a, b in out]


def _table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(rid, key, doc, words, n, fp): each row with its words joined by one space, dealt by a number of its own into a bucketed table."""

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode().split() for t in batch["text"].to_pylist()]
            joined = [b" ".join(t) for t in texts]
            prints = [blake2b(t, digest_size=16).digest() for t in joined]
            n = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["rid"], batch["key"], pa.array(joined, pa.binary()).cast(pa.string()), n, pa.array(prints, pa.binary())], names=["rid", "key", "words", "n", "fp"])

    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"words_{uuid.uuid4().hex}"
    made = rows.mapInArrow(run, "rid long, key long, words string, n long, fp binary").repartition(parts, "rid")
    made.write.bucketBy(parts, "rid").option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name).withColumn("doc", F.coalesce("key", F.lit(LAST)))


def _anchors(texts: DataFrame, window: int, short: int) -> DataFrame:
    """(rid, anchor): distinct anchors of each row; and (rid, start, words) of what comes again in its own row."""

    def run(batches):
        for batch in batches:
            rid = batch["rid"].to_numpy()
            words = batch["words"].to_pylist()
            for at, some in _slabs(words):
                owner, start, whole, anchor = windows(some, window, short)
                new = np.ones(len(owner), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
                o, a = owner[new], anchor[new]
                order = np.lexsort((a, o))
                o, a = o[order], a[order]
                new = np.ones(len(o), bool)
                new[1:] = (a[1:] != a[:-1]) | (o[1:] != o[:-1])
                o, a = rid[at + o[new]], a[new].view(np.int64)
                empty = pa.nulls(len(o), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(o), pa.array(a), empty, empty], names=["rid", "anchor", "start", "length"])
                later, first = _again(owner, whole)
                held: dict[int, list[int]] = {}
                split: dict[int, list[str]] = {}
                for s, f in zip(later.tolist(), first.tolist()):
                    k = int(owner[s])
                    if k not in split:
                        split = {k: some[k].split(" ")}  # one text at a time; they come in order
                    own, x, y = split[k], int(start[s]), int(start[f])
                    if own[x : x + window] == own[y : y + window]:
                        held.setdefault(k, []).append(x)
                found = [(int(rid[at + k]), s, n) for k, starts in held.items() for s, n in _spans(starts, window)]
                if found:
                    o, s, n = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()), pa.nulls(len(o), pa.int64()), pa.array(s, pa.int32()), pa.array(n, pa.int32())], names=["rid", "anchor", "start", "length"])

    return texts.select("rid", "words").mapInArrow(run, "rid long, anchor long, start int, length int")


def _edges(texts: DataFrame, window: int, short: int) -> DataFrame:
    """(edge, rid, doc, start): of windows whose anchor is one of the row's `anchors`, each one's first place in the row."""

    def run(batches):
        for batch in batches:
            rid, doc = batch["rid"].to_numpy(), batch["doc"].to_numpy()
            words = batch["words"].to_pylist()
            for at, some in _slabs(words):
                owner, start, whole, anchor = windows(some, window, short)
                lists = batch["anchors"].slice(at, len(some))
                of = np.repeat(np.arange(len(some)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                salt = _mixed(np.arange(len(some), dtype=np.uint64))
                wanted = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) ^ salt[of]
                some_of = np.isin(anchor ^ salt[owner], wanted)
                owner, start, whole = owner[some_of], start[some_of], whole[some_of]
                later, _ = _again(owner, whole)
                first = np.ones(len(owner), bool)
                first[later] = False
                o = at + owner[first]
                yield pa.RecordBatch.from_arrays([pa.array(whole[first].view(np.int64)), pa.array(rid[o]), pa.array(doc[o]), pa.array(start[first].astype(np.int32))], names=["edge", "rid", "doc", "start"])

    return texts.select("rid", "doc", "words", "anchors").mapInArrow(run, "edge long, rid long, doc long, start int")


def _checked(texts: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """Places (path, rid, doc, start, length in edges, source) with a fingerprint `fp` of the words there."""
    struct = F.struct("path", "start", "length", "source")
    listed = places.groupBy("rid").agg(F.collect_list(struct).alias("places"))  # not more than the row has words

    def run(batches):
        for batch in batches:
            for rid, doc, words, found in zip(*(batch[c].to_pylist() for c in ("rid", "doc", "words", "places"))):
                own = words.split(" ")
                prints = [blake2b(" ".join(own[p["start"] : p["start"] + p["length"] + window - 1]).encode(), digest_size=16).digest() for p in found]
                n = len(found)
                columns = [pa.array([p[c] for p in found], kind) for c, kind in (("path", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("source", pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([rid] * n, pa.int64()), pa.array([doc] * n, pa.int64()), pa.array(prints, pa.binary())], names=["path", "start", "length", "source", "rid", "doc", "fp"])

    joined = texts.join(listed, "rid").select("rid", "doc", "words", "places")
    return kept(joined.mapInArrow(run, "path long, start int, length int, source boolean, rid long, doc long, fp binary"))


def _repeated(texts: DataFrame, rows: DataFrame, window: int, short: int) -> DataFrame:
    """(rid, start, length in words) of all that comes earlier in another of `rows`, or in the row itself. `rows` has (rid)."""
    own = texts.join(rows, "rid", "left_semi")
    found = kept(_anchors(own, window, short))
    inside = found.where("anchor is null").select("rid", "start", "length")
    anchors = found.where("anchor is not null").select("anchor", "rid")
    several = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("anchor")
    wanted = anchors.join(several, "anchor").groupBy("rid").agg(F.collect_list("anchor").alias("anchors"))  # not more than the row has words
    edges = kept(_edges(texts.join(wanted, "rid"), window, short))
    # where an edge stands, and where one that always follows it would stand, are told by hashes of all places together
    places = lambda step: F.bit_xor(F.xxhash64(F.col("rid"), F.col("start") + step))
    source = F.min(F.struct("doc", "start", "rid")).alias("source")
    graph = edges.groupBy("edge").agg(F.count(F.lit(1)).alias("rows"), places(0).alias("here"), places(1).alias("after"), source).where("rows > 1")
    graph = graph.select("edge", "rows", "here", "after", "source.rid", "source.doc", "source.start")
    along = Window.partitionBy("rid").orderBy("start")  # one row's edges
    before = [F.lag(c).over(along) for c in ("start", "rows", "after")]
    goes_on = (before[0] + 1 == F.col("start")) & (before[1] == F.col("rows")) & (before[2] == F.col("here"))
    runs = graph.withColumn("head", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("head").over(along))
    paths = runs.groupBy("rid", "run").agg(F.min(F.struct("start", "edge")).alias("first"), F.count(F.lit(1)).cast("int").alias("length"))
    paths = kept(paths.select(F.monotonically_increasing_id().alias("path"), F.col("first.edge").alias("edge"), "length", F.col("rid").alias("s_rid"), F.col("first.start").alias("s_start")))

    def at_all_places(paths: DataFrame) -> DataFrame:
        is_source = (F.col("rid") == F.col("s_rid")) & (F.col("start") == F.col("s_start"))
        return edges.join(paths, "edge").select("path", "rid", "doc", "start", "length", is_source.alias("source"))

    checked = _checked(texts, kept(at_all_places(paths)), window)
    sources = checked.where("source").select("path", F.col("fp").alias("s_fp"), F.col("doc").alias("s_doc"), F.col("start").alias("s_start"))
    met = checked.where("not source").join(sources, "path")
    failed = kept(met.where("fp <> s_fp").select("path").distinct())
    later = (F.col("doc") > F.col("s_doc")) | (F.col("start") > F.col("s_start"))  # rows of one id: one is not before the other
    good = met.where("fp = s_fp").where(later).join(failed, "path", "left_anti").select("rid", "start", (F.col("length") + window - 1).alias("length"))
    # paths that failed: edge by edge, of each text of a window its first place is the source
    single = paths.join(failed, "path").select("path", "s_rid", "s_start", "length")
    single = single.join(graph.select(F.col("rid").alias("s_rid"), F.col("start").alias("e_start"), "edge"), "s_rid")
    single = single.where("e_start >= s_start and e_start < s_start + length").select("edge", F.col("edge").alias("path"), F.lit(1).alias("length"), F.lit(None).cast("long").alias("s_rid"), F.lit(None).cast("int").alias("s_start"))
    places = at_all_places(single).withColumn("source", F.lit(False))
    apart = _checked(texts, places, window)
    firsts = apart.groupBy("path", "fp").agg(F.min(F.struct("doc", "start")).alias("first"))
    more = apart.join(firsts, ["path", "fp"]).where(F.struct("doc", "start") > F.col("first")).select("rid", "start", F.lit(window).alias("length"))
    return inside.unionByName(good).unionByName(more)


def deduplicated(df: DataFrame, key: str, text: str, window: int = 20, short: int = 8) -> DataFrame:
    """For each row: key, n_words, n_removed and kept, its words without repeated spans, joined by one space.

    Words are runs without ASCII white space. A word goes if a window of `window` words that covers it stands earlier too: in a row of smaller
    key, or earlier in the same row. That is judged on the input, so the first place of a passage stays whole. Null and empty texts have no
    words, texts of fewer than `window` words lose none. A null key comes after all others. Rows of one key, repeated rows too, are places in
    one document: what begins at the same word in both stays in both, what begins later in one goes there. Repeated rows come back as often as they are there. Other columns
    are not read, texts are taken whole. Of rows with the same words only the first is looked at; the rest go whole.
    """
    texts = _table(df, key, text)
    rows = texts.select("rid", "doc", "n", "fp")
    firsts = rows.where(F.col("n") >= window).groupBy("fp").agg(F.min(F.struct("doc", "rid")).alias("first"))
    roles = kept(rows.join(firsts, "fp").select("rid", F.col("first.rid").alias("first"), (F.col("doc") > F.col("first.doc")).alias("copy")))
    spans = _repeated(texts, roles.where("rid = first").select("rid"), window, short)
    listed = spans.groupBy("rid").agg(F.collect_list(F.struct("start", "length")).alias("spans"))  # not more than the row has words
    same = roles.where("rid <> first and not copy")  # further rows of one key and one text
    listed = kept(listed)
    listed = listed.unionByName(same.select("rid", "first").join(listed.withColumnRenamed("rid", "first"), "first").select("rid", "spans"))
    side = listed.select("rid", "spans", F.lit(False).alias("copy"))
    side = side.unionByName(roles.where("copy").select("rid", F.lit(None).cast("array<struct<start:int,length:int>>").alias("spans"), "copy"))

    def run(batches):
        for batch in batches:
            removed, left = [], []
            for words, n, spans, copy in zip(*(batch[c].to_pylist() for c in ("words", "n", "spans", "copy"))):
                if copy:
                    removed.append(n)
                    left.append("")
                elif not spans:
                    removed.append(0)
                    left.append(words)
                else:
                    own, out, at = words.split(" "), [], 0
                    for s in sorted(spans, key=lambda s: s["start"]):
                        if s["start"] > at:
                            out += own[at : s["start"]]
                        at = max(at, s["start"] + s["length"])
                    out += own[at:]
                    removed.append(n - len(out))
                    left.append(" ".join(out))
            yield pa.RecordBatch.from_arrays([batch["key"], batch["n"], pa.array(removed, pa.int64()), pa.array(left, pa.string())], names=["key", "n_words", "n_removed", "kept"])

    joined = texts.select("rid", "key", "words", "n").join(side, "rid", "left")
    return joined.select("key", "words", "n", "spans", "copy").mapInArrow(run, "key long, n_words long, n_removed long, kept string")
