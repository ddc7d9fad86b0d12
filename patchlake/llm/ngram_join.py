"""N-gram Jaccard join by a token-group matrix, and the groups of near copies that it leads to.

Equal sets are one node. Nodes that are alike are put into groups first, around leaders, and checked exactly. The matrix then holds,
for each group, the union of its members' leading tokens; a node's overlap with a whole group is bounded by the number and
places of the tokens that it finds there, and only groups whose bound is high enough are opened and compared member by member. So a
large group of near copies is met as one row per token, and no pairs within it are made.

Leading tokens: with all sets in one order of tokens, two sets that link share a token among the first
n - ceil(t n) + 1 of each. The order is by how many documents hold a token, common ones last; it is taken from counts of tokens
that are frequent in some part of the input. Any order gives the same links, this one makes few candidates.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake.llm.shared import kept, slices
from patchlake.llm.shingles import fingerprint, shingle_sets

#: Tokens with a count of their own; the most frequent stay. Bounds what each task is sent (16 bytes each).
FREQUENT_TOKENS = 500_000
#: Nodes in a group, at most about; so many sets, twice, are held by a task.
GROUP_SIZE = 64
_SLAB = 400_000  # tokens that a task counts at once
#: Nodes whose sets are compared, up to which their list is sent to all tasks; beyond it is joined by a shuffle.
MOST_BROADCAST = 500_000


def _sets_and_counts(df: DataFrame, words: int) -> DataFrame:
    """(key, n, fp) of each row; and (token, rows) of tokens that many rows of a slab hold."""

    def run(batches):
        held, docs = [], 0

        def frequent():
            if not held:
                return pa.RecordBatch.from_pydict({"key": [], "n": [], "fp": [], "token": [], "rows": []}, schema)
            token, n = np.unique(np.concatenate(held), return_counts=True)
            some = n >= max(4, docs // 500)
            none = [None] * int(some.sum())
            return pa.RecordBatch.from_arrays([pa.array(none, pa.int64())] * 2 + [pa.array(none, pa.binary()), pa.array(token[some].view(np.int64)), pa.array(n[some].astype(np.int64))], schema=schema)

        for batch in slices(batches):
            values, ends = shingle_sets(batch["text"].to_pylist(), words)
            prints = [fingerprint(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(np.diff(ends)), pa.array(prints, pa.binary()), none, none], schema=schema)
            held.append(values)
            docs += batch.num_rows
            if sum(map(len, held)) > _SLAB:
                yield frequent()
                held, docs = [], 0
        yield frequent()

    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("token", pa.int64()), ("rows", pa.int64())])
    return df.mapInArrow(run, "key long, n long, fp binary, token long, rows long")


def _leading(df: DataFrame, words: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, n, fp, tokens): the leading tokens of each row's set, in order. Sets too small to link with another have none."""
    shared = df.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        token, rows = shared.value
        for batch in slices(batches):
            values, ends = shingle_sets(batch["text"].to_pylist(), words)
            found = np.minimum(np.searchsorted(token, values), max(len(token) - 1, 0))
            count = np.where(token[found] == values, rows[found], 0) if len(token) else np.zeros(len(values), np.int64)
            prints, out, sizes = [], [], []
            for a, b in zip(ends[:-1], ends[1:]):
                own, c, n = values[a:b], count[a:b], b - a
                prints.append(fingerprint(own))
                most = n - (percent * n + 99) // 100 + 1 if n * (100 - percent) >= percent else 0
                out.append((own[np.argsort(c, kind="stable")] if c.any() else own)[:most])
                sizes.append(len(out[-1]))
            tokens = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(tokens))
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(np.diff(ends)), pa.array(prints, pa.binary()), lists], names=["key", "n", "fp", "tokens"])

    return df.mapInArrow(run, "key long, n long, fp binary, tokens array<long>")


def _may_link(percent: int, na: Column, pa_: Column, nb: Column, pb: Column) -> Column:
    """Exact bound at a common token with places pa_ and pb: what can still be common reaches what is needed."""
    need = (na + nb) * percent / (100 + percent) - 1e-6
    return (na * 100 >= nb * percent) & (nb * 100 >= na * percent) & (F.least(na - pa_, nb - pb) >= need)


def _spare(percent: int, n: Column, other: Column) -> Column:
    """A set of n tokens that links with one of `other` tokens has so many of its leading tokens in common at least, by its own
    length: those in front of the k-th common one are k - 1 common ones and what it may have alone."""
    leading = n - F.floor((n * percent + 99) / 100) + 1
    return leading - n + (n + other) * percent / (100 + percent)


def _least_common(percent: int, na: Column, nb: Column) -> Column:
    """Leading tokens that two sets that link have in common, at least. An exact bound."""
    return F.least(_spare(percent, na, nb), _spare(percent, nb, na)) - 1e-6


def _held(wanted: DataFrame, nodes: DataFrame, df: DataFrame, words: int) -> DataFrame:
    """(node, held): the whole sets of the wanted nodes, each from the text of one of its rows."""
    wanted = kept(wanted.join(nodes.select("node", F.col("key").alias("_key"), "fp"), "node"))
    side = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted
    texts = df.join(side, F.col("key").eqNullSafe(F.col("_key"))).select("node", "fp", "text")

    def sets(batches):
        for batch in slices(batches):
            values, ends = shingle_sets(batch["text"].to_pylist(), words)
            own = [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
            # rows of one key may have other texts
            same = pa.array([fingerprint(x) == fp for x, fp in zip(own, batch["fp"].to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array([x.tobytes() for x in own], pa.binary())], names=["node", "held"]).filter(same)

    return texts.mapInArrow(sets, "node long, held binary").groupBy("node").agg(F.first("held").alias("held"))


def _links(percent: int, x: np.ndarray, y: np.ndarray) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _linked_pairs(pairs: DataFrame, nodes: DataFrame, df: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose whole sets link."""
    held = _held(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, df, words)

    def check(batches):
        for batch in batches:
            ok = [_links(percent, np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch["held_a"], batch["held_b"])]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.select("a", "b").join(held.select(F.col("node").alias("b"), F.col("held").alias("held_b")), "b")
    both = both.join(held.select(F.col("node").alias("a"), F.col("held").alias("held_a")), "a")
    return kept(both.mapInArrow(check, "a long, b long"))


def _linked_groups(opened: DataFrame, members: DataFrame, nodes: DataFrame, df: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between members of the opened pairs of groups (ga, gb), or within a group opened with itself.
    Nodes of one component, known or found on the way, are not compared again."""
    sides = opened.select(F.explode(F.array_distinct(F.array("ga", "gb"))).alias("grp"), "ga", "gb")
    inside = sides.join(members.select("node", "grp", "component"), "grp").select("ga", "gb", "grp", "node", "component")
    rows = inside.join(_held(inside.select("node").distinct(), nodes, df, words), "node").select("ga", "gb", "grp", "node", "component", "held")

    def compare(inside: bool, held: list) -> list[tuple[int, int]]:
        root = {c: c for *_, c, _ in held}

        def find(c):
            while root[c] != c:
                c = root[c]
            return c

        found = []
        sets = [(g, node, c, np.frombuffer(h, np.uint64)) for g, node, c, h in held]
        for i, (g, node, c, x) in enumerate(sets):
            for h, other, d, y in sets[i + 1 :]:
                if (g == h) == inside and (u := find(c)) != (v := find(d)) and _links(percent, x, y):
                    root[u] = v
                    found.append((node, other))
        return found

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        pair, held = None, []  # one pair of groups at a time; sets stay where they arrived

        def links(pair, held):
            found = compare(pair[0] == pair[1], held)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            keys = [batch[c].to_pylist() for c in ("ga", "gb", "grp", "node", "component")]
            for k, (ga, gb, grp, node, component) in enumerate(zip(*keys)):
                if (ga, gb) != pair:
                    if held:
                        yield links(pair, held)
                    pair, held = (ga, gb), []
                held.append((grp, node, component, batch["held"][k].as_buffer()))
            held = [(g, n, c, h.to_pybytes() if isinstance(h, pa.Buffer) else h) for g, n, c, h in held]  # the batch itself goes
        if held:
            yield links(pair, held)

    return kept(rows.repartition("ga", "gb").sortWithinPartitions("ga", "gb", "grp", "node").mapInArrow(run, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the ends of `edges` (a, b); the component is its smallest node.

    Alternating steps that hang each node's larger, then smaller, neighbours under its smallest, until nothing changes."""
    edges = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    sign = F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))
    state = edges.agg(F.count(F.lit(1)), sign).first()
    while state[0]:
        both = edges.union(edges.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.least(F.min("m"), F.col("v")).alias("low"))
        large = both.join(least, "v").where("m > v").select(F.col("m").alias("v"), F.col("low").alias("m")).where("v <> m").distinct()
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low, "v").select(F.greatest("m", "low").alias("v"), F.least("m", "low").alias("m")).where("v <> m").union(low.select("v", F.col("low").alias("m"))).distinct()
        edges = kept(small)
        now = edges.agg(F.count(F.lit(1)), sign).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("v").alias("node"), F.col("m").alias("component")).union(edges.select(F.col("m"), F.col("m")).distinct())


def near_copies(df: DataFrame, key: str, text: str, words: int = 5, percent: int = 80) -> DataFrame:
    """For each row: key, n_shingles (size of its set) and component_id, the smallest key reachable by links.

    Two rows link when their sets' intersection is at least `percent` hundredths of the union. Equal sets link. Empty sets (null or
    empty texts, or white space only) link with nothing: their component is their own key. Null keys are passed over in
    the minimum, and null only where a component has no other; repeated rows come back as often as they are there. Other
    columns are not read. Keys are whole numbers. Texts are taken whole, and no group is held by one task.
    """
    docs = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    first = kept(_sets_and_counts(docs, words))
    rows = first.where("fp is not null").select("key", "n", "fp")
    counted = first.where("token is not null").groupBy("token").agg(F.sum("rows").alias("rows"))
    common = counted.orderBy(F.desc("rows"), "token").limit(FREQUENT_TOKENS).toPandas()
    token, count = common["token"].to_numpy(np.int64).view(np.uint64), common["rows"].to_numpy(np.int64)
    order = np.argsort(token)
    leading = _leading(docs, words, percent, (token[order], count[order])).where("n > 0")
    nodes = leading.groupBy("fp").agg(F.min("key").alias("key"), F.first("n").cast("int").alias("n"), F.first("tokens").alias("tokens"))
    nodes = kept(nodes.withColumn("node", F.monotonically_increasing_id()))
    entries = nodes.select(F.explode(F.transform("tokens", lambda t, i: F.struct(t.alias("token"), i.alias("place")))).alias("e"), "node", "n")
    entries = entries.select("e.token", "node", "n", "e.place")
    meeting = entries.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("token")
    shared = kept(entries.join(meeting, "token"))
    # around leaders: for each token the node in which it comes first, for each node the leader that it meets most often
    leaders = shared.groupBy("token").agg(F.min(F.struct("place", "node", "n")).alias("leader"))
    met = shared.join(leaders, "token").where(F.col("node") != F.col("leader.node")).groupBy("node", "n", "leader.node", "leader.n").agg(
        F.count(F.lit(1)).alias("met"), F.max(_may_link(percent, F.col("n"), F.col("place"), F.col("leader.n"), F.col("leader.place"))).alias("may")
    ).toDF("node", "n", "leader", "leader_n", "met", "may")
    least = _least_common(percent, F.col("n"), F.col("leader_n"))
    best = met.where(F.col("may") & (F.col("met") * 2 >= least)).groupBy("node").agg(F.max(F.struct((F.col("met") >= least).alias("likely"), "met", "leader")).alias("best"))
    best = kept(best.select("node", "best.*"))
    links = _linked_pairs(best.where("likely").select(F.col("leader").alias("a"), F.col("node").alias("b")), nodes, docs, words, percent)
    linked = kept(components(links))
    # groups: components; nodes that met one leader often, but do not link with it; all others alone. Large ones are cut up
    placed = shared.select("node").distinct().join(linked, "node", "left").join(best.select("node", "leader"), "node", "left")
    placed = placed.select("node", F.coalesce("component", "node").alias("component"), F.coalesce("component", "leader", "node").alias("base"), F.col("component").isNotNull().alias("one"))
    sizes = placed.groupBy("base", "one").agg(F.count(F.lit(1)).alias("members"))
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / GROUP_SIZE))
    # nodes that others do not share a group with keep their number, so that groups have one number of 64 bits
    grp = F.when(F.col("members") == 1, F.xxhash64(F.col("node"))).otherwise(F.xxhash64("base", "one", block))
    members = kept(placed.join(sizes, ["base", "one"]).select("node", "component", "one", grp.alias("grp"), "members"))
    # the matrix: one row per token and group, with what bounds the overlap of any two members
    matrix = shared.join(members, "node").groupBy("token", "grp").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("place").alias("place"), F.min(F.when(F.col("one"), F.col("component"))).alias("component")
    )
    several = matrix.groupBy("token").agg(F.count(F.lit(1)).alias("groups")).where("groups > 1").select("token")
    matrix = kept(matrix.join(several, "token"))
    a, b = (matrix.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("grp", "low", "high", "place", "component")]) for side in "ab")
    size = (F.col("high_a") * 100 >= F.col("low_b") * percent) & (F.col("high_b") * 100 >= F.col("low_a") * percent)
    other = F.coalesce(F.col("component_a") != F.col("component_b"), F.lit(True))
    need = (F.col("low_a") + F.col("low_b")) * percent / (100 + percent) - 1e-6
    early = F.least(F.col("high_a") - F.col("place_a"), F.col("high_b") - F.col("place_b")) >= need
    wide = F.when((F.col("low_a") < F.col("high_a")) | (F.col("low_b") < F.col("high_b")), 1).otherwise(0)  # sizes between round otherwise
    least = F.least(_spare(percent, F.col("high_a"), F.col("low_b")), _spare(percent, F.col("high_b"), F.col("low_a"))) - wide - 1e-6
    # first by the place of the first common token, a row per token that is early in both; then by the number of common tokens
    early_pairs = a.join(b, "token").where((F.col("grp_a") < F.col("grp_b")) & size & other & early)
    early_pairs = kept(early_pairs.groupBy(F.col("grp_a").alias("ga"), F.col("grp_b").alias("gb")).agg(F.min(least).alias("least")))
    union = matrix.groupBy("grp").agg(F.collect_set("token").alias("tokens"))  # bounded by the size of a group
    both = early_pairs.join(union.toDF("ga", "tokens_a"), "ga").join(union.toDF("gb", "tokens_b"), "gb")
    opened = both.where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= F.col("least")).select("ga", "gb")
    alone = members.where(~F.col("one") & (F.col("members") > 1)).select(F.col("grp").alias("ga"), F.col("grp").alias("gb")).distinct()
    more = _linked_groups(kept(opened.union(alone)), members, nodes, docs, words, percent)
    final = components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    owned = nodes.select("node", "fp", "key").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = owned.groupBy("component").agg(F.min("key").alias("component_id"))
    named = owned.join(names, "component").select("fp", "component_id")
    full = rows.where("n > 0").join(named, "fp").select("key", F.col("n").alias("n_shingles"), "component_id")
    return full.union(rows.where("n = 0").select("key", F.col("n"), F.col("key")))
