"""Main text of web pages: nearest-URL page differencing, guided by the markup.

Within each host pages are put in order of their path and paired with their neighbours. The text lines of both are aligned by
their longest common subsequence; lines that both have are the site's and not the page's, and are deleted.

Differencing alone does not give the article: copies of an article on one host would lose it whole, and menus or
adverts that differ from page to page would stay. So markup decides where it says something: lines in menus, headers, footers, forms
and the like always go, and lines inside an article or main element always stay. See the README for figures.
"""

import hashlib
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from patchlake.llm.shared import kept
from patchlake.llm.url_filters import host_and_path

BOILER, OPEN, ARTICLE = 0, 1, 2
#: Pages with lines to delete, up to which their list is sent to every task; beyond it is joined by a shuffle.
MOST_BROADCAST = 100_000
#: A page that shares more of its text with another is a copy of it.
MOST_SHARED = 0.9

_TOKEN = re.compile(
    # a tag ends before the next "<" outside of quotes, so that a page of tags that are never closed is read once
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']+|\"[^\"]*\"|'[^']*')*+)>|<[!?][^<>]*>|[^<]+|<",
    re.S | re.I,
)
#: Elements whose content is no text of the page. Of those that are never closed only some run to the end of the page.
_SKIPPED = {t: re.compile(rf"</{t}(?=[\s/>])[^<>]*>", re.I) for t in "script style noscript template iframe svg textarea select object math canvas title".split()}
_TO_THE_END = frozenset("script style textarea title".split())
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILER_TAGS = frozenset("nav header footer aside form button dialog menu head".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
_BOILER_NAMES = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager comment comments disqus reply replies share sharing social related recommended newsletter subscribe signup login popup modal "
    "overlay widget toolbar masthead copyright legal disclaimer search skip".split()
)
_DENIALS = frozenset("no not non without with has hide hidden".split())
_TALK = frozenset("comment comments disqus reply replies".split())
_NEVER_BY_NAME = frozenset("html body main article".split())
#: An element with this share of a page's text is its main part, whatever its class says.
MAIN_SHARE = 0.75
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_OPENERS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


def _is_boiler(tag: str, attributes: str) -> bool:
    """By tag, role, or aria-hidden."""
    if tag in _BOILER_TAGS:
        return True
    for name, a, b, c in _ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        value, name = (a or b or c).lower(), name.lower()
        if (name == "role" and value in _BOILER_ROLES) or (name == "aria-hidden" and value == "true"):
            return True
    return False


def _share_to_lift(tag: str, attributes: str, in_article: bool) -> float:
    """0 if no class or id names boilerplate; else the share of a page's text from which on such a name is not believed. Names that deny,
    or tell what else is there (no-sidebar, with-sidebar), name nothing, and the page itself and its main parts are no boilerplate."""
    share = 0.0
    if tag in _NEVER_BY_NAME or "=" not in attributes:
        return share
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for token in (a or b or c).lower().split():
                words = set(re.split(r"[^a-z]+", token))
                if not words & _DENIALS and (words & _BOILER_NAMES or (not in_article and words & {"header", "footer"})):
                    share = max(share, 1.0 if words & _TALK or words <= _BOILER_NAMES else MAIN_SHARE)
    return share


class _Tree:
    """The elements of a page that lines can be in; each is told by a number and knows the one that holds it."""

    def __init__(self):
        self.held_by: list[int] = [-1]
        self.tag: list[str] = [""]
        self.boiler: list[bool] = [False]
        self.article: list[bool] = [False]
        self.in_article: list[bool] = [False]
        self.named: list[int | None] = [None]  # number of one that is boilerplate by name

    def add(self, inside: int, tag: str, boiler: bool, article: bool, named: int | None) -> int:
        self.held_by.append(inside)
        self.tag.append(tag)
        self.boiler.append(boiler)
        self.article.append(article)
        self.in_article.append(article or self.in_article[inside])
        self.named.append(named)
        return len(self.tag) - 1

    def zones(self, lifted=()) -> list[int]:
        """Of the lines right in each element. Names whose numbers are in `lifted` count for nothing."""
        state = [(False, True, False, False)]  # any boilerplate, headers only, an article outside of it, a heading
        zones = [OPEN]
        for k in range(1, len(self.tag)):
            any_boiler, headers, article, heading = state[self.held_by[k]]
            if self.boiler[k] or (self.named[k] is not None and self.named[k] not in lifted):
                any_boiler, headers = True, headers and self.tag[k] == "header"
            elif not any_boiler:
                article = article or self.article[k]
            heading = heading or self.tag[k] in _HEADINGS
            state.append((any_boiler, headers, article, heading))
            if any_boiler and article and heading and headers:
                zones.append(ARTICLE)  # the title of an article in its own header
            else:
                zones.append(BOILER if any_boiler else ARTICLE if article else OPEN)
        return zones


def lines(page: str | None) -> list[tuple[str, int]]:
    """The page's blocks of text in order, each with BOILER, ARTICLE (inside an article or main element) or OPEN.

    White space in a block is one space, character references are decoded, and blocks without text are left out. Elements
    that are not closed end with what holds them; a page that breaks off ends there. An element whose class or id names
    boilerplate, but that holds MAIN_SHARE of the text outside other boilerplate (all of it, for comments and names in full), is none.
    The time grows with the page's length, however deep or broken its markup is."""
    out: list[tuple[str, int]] = []  # text, element
    held: list[str] = []
    tree = _Tree()
    stack: list[int] = [0]
    open_tags: Counter = Counter()
    shares: list[float] = []  # of elements named like boilerplate, in which the name is not believed

    def flush():
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, stack[-1]))

    def pop():
        open_tags[tree.tag[stack.pop()]] -= 1

    page = page or ""
    at, unclosed = 0, set()
    while m := _TOKEN.match(page, at):
        at = m.end()
        token = m[0]
        tag = m[2]
        if tag is None:
            if token[0] != "<" or token == "<":
                held.append(token)
            continue
        tag = tag.lower()
        if tag in _SKIPPED and not m[1]:
            if tag in _TO_THE_END or not (m[3].endswith("/") or tag in unclosed):
                end = _SKIPPED[tag].search(page, at)
                if end or tag in _TO_THE_END:
                    at = end.end() if end else len(page)
                else:
                    unclosed.add(tag)
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in _VOID and tag != "hr":
            continue
        if tag not in _INLINE:
            flush()
        if m[1]:
            while open_tags[tag]:
                last = tree.tag[stack[-1]]
                pop()
                if last == tag:
                    break
            continue
        if tag in _OPENERS and tree.tag[stack[-1]] == "p":
            pop()
        if tag in ("li", "td", "th", "tr", "dd", "dt", "option") and tree.tag[stack[-1]] == tag:
            pop()
        if (tag in _INLINE and tag != "span") or tag == "hr" or m[3].endswith("/"):
            continue
        boiler = _is_boiler(tag, m[3])
        main = tag in ("article", "main") or ("role" in m[3] and re.search(r"role\s*=\s*[\"']?main\b", m[3]) is not None)
        share = 0.0 if boiler or main else _share_to_lift(tag, m[3], tree.in_article[stack[-1]])
        if tag == "span" and not (boiler or share) and not open_tags["span"]:
            continue
        if tag == "span" and (boiler or share):
            flush()
        if share:
            shares.append(share)
        stack.append(tree.add(stack[-1], tag, boiler, main and not boiler, len(shares) - 1 if share else None))
        open_tags[tag] += 1
    flush()
    if shares:
        believed = tree.zones(range(len(shares)))
        size = [0] * len(tree.tag)
        for text, k in out:
            if believed[k] != BOILER:
                size[k] += len(text)
        for k in range(len(size) - 1, 0, -1):
            size[tree.held_by[k]] += size[k]
        inside = [0] * len(shares)
        for k, n in enumerate(tree.named):
            if n is not None:
                inside[n] = size[k]
        zones = tree.zones({n for n, share in enumerate(shares) if inside[n] and inside[n] >= share * size[0]})
    else:
        zones = tree.zones()
    return [(text, zones[k]) for text, k in out]


def common_lines(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Places in a and in b of a longest common subsequence.

    After common ends are taken off, a row of the table of lengths is one number with a bit per line of b (Hyyrö's method), so the time
    does not depend on how many lines are equal. Rows are kept at every so many lines only, and those between are made again on the way back."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    marks: dict[int, bytearray] = {}
    wanted = set(x)
    for j, line in enumerate(y):
        if line in wanted:
            marks.setdefault(line, bytearray(len(y) // 8 + 1))[j >> 3] |= 1 << (j & 7)
    bits = {line: int.from_bytes(m, "little") for line, m in marks.items()}
    full = (1 << len(y)) - 1

    def after(row: int, line: int) -> int:
        met = row & bits.get(line, 0)
        return ((row + met) | (row - met)) & full

    step = math.isqrt(len(x)) + 1
    rows = [full]
    row = full
    for i, line in enumerate(x if bits else (), 1):
        row = after(row, line)
        if i % step == 0:
            rows.append(row)
    pairs: list[tuple[int, int]] = []
    i, j = (len(x), len(y)) if bits else (0, 0)
    block: list[bytes] = []
    first = -1  # the row that `block` begins with

    def is_set(r: int, c: int) -> int:
        return block[r - first][c >> 3] >> (c & 7) & 1

    while i and j:
        if first < 0 or i - 1 < first:
            first = (i - 1) // step * step
            row = rows[first // step]
            block = [row.to_bytes(len(y) // 8 + 1, "little")]
            for line in x[first:i]:
                row = after(row, line)
                block.append(row.to_bytes(len(y) // 8 + 1, "little"))
        if is_set(i, j - 1):
            j -= 1
        elif not is_set(i - 1, j - 1):
            i -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    pairs.reverse()
    tail = range(high, 0, -1)
    return (
        [*range(low), *(low + i for i, _ in pairs), *(len(a) - t for t in tail)],
        [*range(low), *(low + j for _, j in pairs), *(len(b) - t for t in tail)],
    )


def _pairs(keys: DataFrame) -> DataFrame:
    """Add `pair`: two pages that follow each other in a host's order of paths, or three at the end of an odd number.

    Pages are sorted into ranges, numbered within a range, and the ranges' counts are added up per host, so that
    no host is held by one task."""
    ranges = kept(keys.repartitionByRange("host", "path", "key").withColumn("part", F.spark_partition_id()))
    counts = ranges.groupBy("host", "part").agg(F.count(F.lit(1)).alias("_rows"))
    host = Window.partitionBy("host")
    before = host.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("host", "part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"), F.sum("_rows").over(host).alias("_total"))
    inside = Window.partitionBy("host", "part").orderBy("path", "key")
    rows = ranges.withColumn("_place", F.row_number().over(inside) - 1).join(starts, ["host", "part"])
    rank = F.floor((F.col("_start") + F.col("_place")) / 2)
    return rows.withColumn("pair", F.least(rank, F.greatest(F.floor(F.col("_total") / 2) - 1, F.lit(0)))).drop("part", "_place", "_start", "_total")


def shared_lines(df: DataFrame, url: str, page: str) -> DataFrame:
    """(key, deleted): for pages that share OPEN lines with the pages that they are paired with, the places of those lines. A page
    of three is compared with both others. Pages of a host that have the same lines are one page here, at the first of their paths. `key` is the hash of url and html, so that repeated rows are one page."""
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = df.select(_key(url, page).alias("key"), host.alias("host"), path.alias("path"), F.col(f"`{page}`").cast("string").alias("page"))
    schema = "key binary, host string, path string, same binary, hashes array<long>, sizes array<int>, open array<int>"

    def cut(batches):
        for batch in batches:
            cuts = [lines(p) for p in batch["page"].to_pylist()]
            hashes = [[xxh64_intdigest(t) - (1 << 63) for t, _ in c] for c in cuts]
            same = [hashlib.blake2b(np.array([h, [z for _, z in c]], "<i8").tobytes(), digest_size=16).digest() for h, c in zip(hashes, cuts)]
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["host"], batch["path"], pa.array(same, pa.binary()), pa.array(hashes, pa.list_(pa.int64())),
                 pa.array([[0 if z == BOILER else len(t) for t, z in c] for c in cuts], pa.list_(pa.int32())),
                 pa.array([[i for i, (_, z) in enumerate(c) if z == OPEN] for c in cuts], pa.list_(pa.int32()))],
                names=["key", "host", "path", "same", "hashes", "sizes", "open"],
            )

    marked = kept(rows.where("host <> ''").mapInArrow(cut, schema).dropDuplicates(["key"]))
    first = marked.groupBy("host", "same").agg(F.min(F.struct("path", "key")).alias("first")).select("host", "first.path", "first.key")
    paired = marked.join(_pairs(first).select("key", "pair"), "key")

    def differ(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if held and (held[0].host, held[0].pair) != (row.host, row.pair):
                    out += _differences(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=["host", "same", "deleted"])
        yield pd.DataFrame(_differences(held), columns=["host", "same", "deleted"])

    dealt = paired.repartition("host", "pair").sortWithinPartitions("host", "pair", "path", "key")
    deleted = kept(dealt.mapInPandas(differ, "host string, same binary, deleted array<int>"))
    if deleted.count() <= MOST_BROADCAST:
        deleted = F.broadcast(deleted)
    return marked.select("key", "host", "same").join(deleted, ["host", "same"]).select("key", "deleted")


def _differences(pages: list) -> list[tuple[str, bytes, list[int]]]:
    """What a page shares with one other is not deleted where that is nearly all of its text: then it is a copy, and not the site."""
    free = [set(p.open) for p in pages]
    gone = [set() for _ in pages]

    def nearly_all(k: int, places: set[int]) -> bool:
        return sum(int(pages[k].sizes[i]) for i in places) > MOST_SHARED * sum(map(int, pages[k].sizes))

    for i in range(len(pages)):
        for j in range(i + 1, len(pages)):
            for k, places in zip((i, j), common_lines(list(pages[i].hashes), list(pages[j].hashes))):
                own = free[k].intersection(places)
                if not nearly_all(k, own):
                    gone[k] |= own
    return [(p.host, bytes(p.same), sorted(g)) for k, (p, g) in enumerate(zip(pages, gone)) if g and not nearly_all(k, g)]


def _key(url: str, page: str):
    return F.unhex(F.sha2(F.concat_ws("\x00", F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("\x01")), F.coalesce(F.col(f"`{page}`").cast("string"), F.lit("\x01"))), 256))


def extracted(df: DataFrame, url: str, page: str, out: str = "text") -> DataFrame:
    """Add the main text: blocks in page order, one line each. All other columns stay; one named `out` is replaced.

    That is all blocks outside boilerplate elements, less those outside article and main elements that the differencing deletes. Null and empty pages and pages without
    text have an empty one. Pages without a host (null or broken urls) are not paired. Pages with equal url and html
    count as one and get the same text. Ties in the order of paths go by the hash of the page. An empty table stays empty.
    """
    deleted = kept(shared_lines(df, url, page))
    if deleted.count() <= MOST_BROADCAST:
        deleted = F.broadcast(deleted)
    names = [c for c in df.columns if c != out]
    joined = df.select(*[F.col(f"`{c}`") for c in names], _key(url, page).alias("_page_key")).join(deleted.toDF("_page_key", "_page_lines"), "_page_key", "left")

    def main_text(pages: pd.Series, gone: pd.Series) -> pd.Series:
        texts = []
        for p, g in zip(pages, gone):
            cut = lines(p)
            g = set() if g is None else set(np.asarray(g).tolist())
            texts.append("\n".join(t for i, (t, z) in enumerate(cut) if z == ARTICLE or (z == OPEN and i not in g)))
        return pd.Series(texts, dtype=object)

    udf = F.pandas_udf(main_text, "string").asNondeterministic()
    return joined.select(*[F.col(f"`{c}`") for c in names], udf(F.col(f"`{page}`").cast("string"), "_page_lines").alias(out))
