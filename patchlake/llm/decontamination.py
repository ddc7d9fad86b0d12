"""Benchmark decontamination by pigeonhole edit matching.

A test item may differ from a passage by an error budget of k edits. Cut into k + 1 pieces, one piece at least is
then found unchanged. An automaton of all pieces runs over each text once; where a piece is found, the passage
around it is compared with the whole item by Myers' bit-parallel distance. Short items, which stand inside of other words by
chance, have to begin and end where words do.
"""

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake.llm.shared import kept

MATCHES = "array<struct<item_id:long,distance:int,start_word:int,end_word:int>>"
#: Characters of items that one pass over the documents looks for. More items mean more passes.
CHARS_PER_PASS = 8_000_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def normal_form(text: str | None) -> str:
    """Lower case; ASCII marks and white space become single spaces."""
    return b" ".join((text or "").encode().translate(_TABLE).split()).decode().lower()


@dataclass
class Item:
    item_id: int
    text: str
    budget: int
    masks: dict[str, int] = field(default_factory=dict)
    grams: list[str] = field(default_factory=list)

    def __post_init__(self):
        for i, c in enumerate(self.text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.grams = [self.text[i : i + 4] for i in range(0, len(self.text) - 3, 4)]

    def pieces(self) -> list[tuple[int, str]]:
        """(place, text) of budget + 1 pieces as even as can be."""
        n, parts = len(self.text), self.budget + 1
        cuts = [n * i // parts for i in range(parts + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]

    def may_match(self, window: str) -> bool:
        """Of the grams of four that lie side by side in the item, an edit spoils one at most."""
        missing = 0
        for gram in self.grams:
            if gram not in window:
                missing += 1
                if missing > self.budget:
                    return False
        return True


def distance_in(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance between a pattern of length m and any part of the text, and where that part first ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
    return best, end


def edits(a: str, b: str, most: int) -> int:
    """Edit distance of two short strings, or most + 1 if it is larger."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def between_borders(item: Item, body: str, at: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the whole words of `body` around the place `at` that are closest to an item, within its budget; of
    equally close ones the first to end, then the longest."""
    m, k, n = len(item.text), item.budget, len(body)
    best = None
    for start in range(max(0, at - k), min(n, at + k + 1)):
        if body[start] == " " or (start and body[start - 1] != " "):
            continue
        for end in range(max(start + 1, start + m - k), min(n, start + m + k) + 1):
            if body[end - 1] != " " and (end == n or body[end] == " "):
                d = edits(item.text, body[start:end], k)
                if d <= k and (best is None or (d, end, start) < (best[0], best[2], best[1])):
                    best = (d, start, end)
    return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float, border_below: int):
        import ahocorasick

        self.border_below = border_below

        self.items: list[Item] = []
        where: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normal_form(text)
            if not text:
                continue
            item = Item(item_id, text, int(rate * len(text)))
            for place, piece in item.pieces():
                where.setdefault(piece, []).append((len(self.items), place))
            self.items.append(item)
        self.automaton = ahocorasick.Automaton()
        for piece, found in where.items():
            self.automaton.add_word(piece, (len(piece), found))
        if where:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[dict]:
        if not self.items or not text:
            return []
        body = normal_form(text)
        best: dict[int, tuple[int, int, int]] = {}
        tried = set()
        for end, (length, found) in self.automaton.iter(body):
            for number, place in found:
                at = end - length + 1 - place
                if (number, at) in tried or (number in best and best[number][0] == 0):
                    continue
                tried.add((number, at))
                item = self.items[number]
                m, k = len(item.text), item.budget
                if m < self.border_below:
                    found_here = between_borders(item, body, at)
                    if found_here and (number not in best or (found_here[0], found_here[2], found_here[1]) < (best[number][0], best[number][2], best[number][1])):
                        best[number] = found_here
                    continue
                low = max(0, at - k)
                window = body[low : max(0, at + m + k)]
                if window[at - low : at - low + m] == item.text:
                    best[number] = (0, at, at + m)
                    continue
                if not item.may_match(window):
                    continue
                d, stop = distance_in(item.masks, m, window)
                if d <= k and (number not in best or (d, low + stop) < (best[number][0], best[number][2])):
                    turned = {c: int(f"{x:0{m}b}"[::-1], 2) for c, x in item.masks.items()}
                    _, back = distance_in(turned, m, window[:stop][::-1])
                    best[number] = (d, low + stop - back, low + stop)
        rows = [{"item_id": self.items[n].item_id, "distance": d, "start_word": body.count(" ", 0, a), "end_word": body.count(" ", 0, b) + 1} for n, (d, a, b) in best.items()]
        return sorted(rows, key=lambda r: (r["item_id"], r["distance"], r["start_word"]))


def _blocks(benchmark: DataFrame, item: str, text: str):
    """The items, in blocks of about CHARS_PER_PASS characters; one block at a time is on the driver."""
    items = benchmark.select(F.col(f"`{item}`").cast("long").alias("item"), F.col(f"`{text}`").cast("string").alias("text")).where("item is not null and text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // CHARS_PER_PASS)
    for b in range(blocks):
        yield [(r["item"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).orderBy("item", "text").collect()]


def matched(df: DataFrame, text: str, benchmark: DataFrame, item: str = "item_id", item_text: str = "text", rate: float = 0.1, border_below: int = 40, out: str = "matches") -> DataFrame:
    """Add the test items that a text holds: item_id, distance, and the words from start_word up to end_word, counted from 0 in
    the normal form. All other columns stay; one named `out` is replaced.

    An item's budget is `rate` of its characters, rounded down. Its best place is given, the first of equals. An item whose normal form has
    fewer than `border_below` characters has to begin and end where words do, also one of a single short word; null items and
    items without letters or digits are found nowhere. Items of the same text are all reported.
    Null, empty and other texts without a match have an empty array; texts are searched whole. Rows stand alone, so
    repeated rows get the same answer and empty tables stay empty. The items are asked in blocks of bounded size, each in a pass of its own
    over all rows: the driver and each worker hold one block. What a pass has found is written before the next begins.
    """
    def searching(items: list[tuple[int, str]]) -> Column:
        held: list[Matcher] = []  # made by each task, once

        def search(texts: pd.Series) -> pd.Series:
            if not held:
                held.append(Matcher(items, rate, border_below))
            return pd.Series([held[0].matches(t) for t in texts], dtype=object)

        return F.pandas_udf(search, MATCHES).asNondeterministic()(F.col(f"`{text}`").cast("string"))

    done = None
    for items in _blocks(benchmark, item, item_text):
        found = searching(items)
        done = df.withColumn(out, found) if done is None else kept(done).withColumn(out, F.concat(F.col(f"`{out}`"), found))
    return df.withColumn(out, F.array().cast(MATCHES)) if done is None else done
