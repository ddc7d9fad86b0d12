"""Groups of spelling variants among the words of a corpus: pairs at most one edit apart, by blocked Gram matrices.

A word is the vector of its letter counts. One replaced letter moves it by a squared distance of two, one inserted or deleted letter by
one, so only pairs at most two apart can be near. Squared distances of a block of words come from one NumPy product, |x|^2 + |y|^2 - 2xy.

Blocks are kept small without losing a pair: the letters are dealt over four classes, an edit touches at most two of them, so near words
agree in the counts of some two classes. A block holds the words of one length, and those one letter shorter, that agree in such two classes;
a word stands in a block for each of the six pairs of classes and both lengths. A block of too many words is cut into chunks, and each pair of
chunks is a block of its own, so that no block is held by one task. Pairs that the product keeps are verified letter by letter.
"""

import re
from collections import Counter
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.llm.shared import kept
from patchlake.llm.shingles import _mixed

#: Words of a block before it is cut up.
CHUNK = 512
_SLAB = 160  # rows of small blocks that share one product
_HELD = 200_000  # distinct words that a task counts before it hands them on
_DIMS, _CLASSES = 90, 4
_PAIRS = list(combinations(range(_CLASSES), 2))
_CLASS = np.array([0] * _DIMS)
for _at, _letter in enumerate("etaoinshrdlucmfwypvbgkjqxz"):
    _CLASS[ord(_letter) - 97] = (0, 1, 2, 3, 3, 2, 1, 0)[_at % 8]
_CLASS[26:] = np.arange(64) % _CLASSES
_WEIGHT = _mixed(np.arange(_DIMS, dtype=np.uint64) + np.uint64(3))


def words_of(text: str, least: int) -> list[str]:
    """Runs of letters of at least so many; A-Z count as a-z, other letters stay."""
    return re.findall(r"[a-zÀ-ÿ]{%d,}" % least, text.encode().lower().decode())


def word_counts(df: DataFrame, key: str, text: str, least_length: int = 7, least_count: int = 2, change: Callable[[int | None], Callable[[str], str]] | None = None) -> DataFrame:
    """(word, n): the runs of letters A-Z, a-z, U+00C0 to U+00FF in all texts, of `least_length` letters and `least_count` occurrences
    at least. A-Z count as a-z. Null and empty texts have none; repeated rows count as often as they are there; other columns are not read.

    `change`, given a row's key, returns a function that is applied to each distinct run of the row before it is counted; it may
    shorten runs but not lengthen them. Tasks count their own words first, `_HELD` distinct ones at a time."""

    def run(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for k, one in zip(batch["key"], batch["text"]):
                if not one.is_valid:
                    continue
                found = Counter(words_of(one.as_py(), least_length))
                if change is not None:
                    made = change(k.as_py())
                    for word, n in found.items():
                        word = made(word)
                        if len(word) >= least_length:
                            held[word] += n
                else:
                    held.update(found)
                if len(held) > _HELD:
                    yield out()
                    held.clear()
        yield out()

    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and the length of each word."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(w) for w in words], np.int64)


def letter_counts(words: list[str]) -> np.ndarray:
    """A row per word: how often it has each letter. Letters outside of a-z share 64 places by their code point."""
    codes, lengths = _codes(words)
    dims = np.where((codes >= 97) & (codes < 123), codes.astype(np.int64) - 97, 26 + codes.astype(np.int64) % 64)
    owner = np.repeat(np.arange(len(words)), lengths)
    return np.bincount(owner * _DIMS + dims, minlength=len(words) * _DIMS).reshape(len(words), _DIMS)


def _class_hashes(counts: np.ndarray) -> np.ndarray:
    """For each word and class of letters, a hash of its counts in the class."""
    return np.stack([_mixed((counts[:, _CLASS == c] * _WEIGHT[_CLASS == c]).sum(1, dtype=np.uint64) + np.uint64(c)) for c in range(_CLASSES)], axis=1)


def _cell(left: np.ndarray, right: np.ndarray, pair, lengths: np.ndarray) -> np.ndarray:
    return _mixed(left * np.uint64(3) + right * np.uint64(5) + pair + _mixed(lengths))


def _placed(words: DataFrame) -> DataFrame:
    """(cell, short, word, n): every word in the cells where its near words are; short where it is one letter shorter than the cell's words."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                words = batch["word"].to_pylist()
                counts = letter_counts(words).astype(np.uint64)
                own = _class_hashes(counts)
                lengths = counts.sum(1)
                for p, (a, b) in enumerate(_PAIRS):
                    for short in (0, 1):
                        cell = _cell(own[:, a], own[:, b], np.uint64(p), lengths + np.uint64(short))
                        yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array([bool(short)] * len(words)), batch["word"], batch["n"]], names=["cell", "short", "word", "n"])

    return words.mapInArrow(run, "cell long, short boolean, word string, n long")


def _one_edit(a: np.ndarray, b: np.ndarray, alen: np.ndarray, blen: np.ndarray) -> np.ndarray:
    """For rows of code points padded with zeros, where b is as long as a or one longer: do they differ by exactly one edit?"""
    width = b.shape[1]
    inside = np.arange(width) < alen[:, None]
    differs = (a != b) & inside
    moved = (a != np.concatenate([b[:, 1:], np.zeros((len(b), 1), b.dtype)], axis=1)) & inside
    first = np.where(differs.any(1), differs.argmax(1), alen)
    last = np.where(moved.any(1), width - 1 - moved[:, ::-1].argmax(1), -1)
    return np.where(alen == blen, differs.sum(1) == 1, last < first)


def near_pairs(words: list[str], cell: np.ndarray, short: np.ndarray, a: np.ndarray, b: np.ndarray, chunk: np.ndarray, slabs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of places in `words` that are near, each once for every block in which they meet, and the number of the first pair of
    classes in which they agree. `slabs` are ranges of whole blocks; one product each."""
    counts = letter_counts(words).astype(np.float32 if max(map(len, words)) < 1500 else np.float64)
    lengths = counts.sum(1)
    square = np.einsum("ij,ij->i", counts, counts)
    found = []
    for start, end in slabs:
        block = counts[start:end]
        half = square[start:end] / 2 - 1
        # squared distances of two at most: |x|^2 / 2 - 1 + |y|^2 / 2 <= xy
        i, j = np.nonzero(block @ block.T >= half[:, None] + (half + 1))
        found.append((i + start, j + start))
    i, j = (np.concatenate(x) for x in zip(*found))
    # i is the longer word of two, or the earlier one; both of a block; of two chunks, one of each
    fits = ~short[i] & (cell[i] == cell[j]) & np.where(short[j], lengths[i] == lengths[j] + 1, (i < j) & (lengths[i] == lengths[j]))
    fits &= (a[i] == a[j]) & (b[i] == b[j]) & np.where(a[i] == b[i], True, chunk[i] != chunk[j])
    i, j = i[fits], j[fits]
    codes, sizes = _codes(words)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 4096):
        x, y = j[at : at + 4096], i[at : at + 4096]  # the shorter word first
        width = int(sizes[y].max())
        if width > 200:  # long words, one by one
            keep[at : at + 4096] = [near(words[s], words[t]) for s, t in zip(x, y)]
            continue
        place = np.arange(width)
        one, two = (np.where(place < sizes[z][:, None], codes[np.minimum(starts[z][:, None] + place, len(codes) - 1)], 0) for z in (x, y))
        keep[at : at + 4096] = _one_edit(one, two, sizes[x], sizes[y])
    i, j = i[keep], j[keep]
    member = (_CLASS[:, None] == np.arange(_CLASSES)).astype(np.float32)
    touched = (counts[i] != counts[j]).astype(np.float32) @ member > 0
    return i, j, np.stack([~touched[:, p] & ~touched[:, q] for p, q in _PAIRS], axis=1).argmax(1)


def near(x: str, y: str) -> bool:
    """Do two words differ by exactly one inserted, deleted or replaced letter?"""
    if abs(len(x) - len(y)) > 1 or x == y:
        return False
    if len(x) > len(y):
        x, y = y, x
    p = next((k for k, (s, t) in enumerate(zip(x, y)) if s != t), len(x))
    return x[p + (len(x) == len(y)) :] == y[p + 1 :]


def _neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n): for each word with near words, how many, and the most frequent one, part by part."""
    cells = kept(_placed(words))
    large = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > CHUNK).select("cell", F.ceil(F.col("rows") / CHUNK).cast("int").alias("chunks"))
    cut = cells.join(large, "cell", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    blocks = cut.select("cell", "short", "word", "n", "chunk", other)
    blocks = blocks.select("cell", "short", "word", "n", "chunk", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"))

    def compared(rows: pa.Table, slabs: list[tuple[int, int]]):
        words = rows["word"].to_pylist()
        cell, short, chunk, a, b, n = (rows[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("cell", "short", "chunk", "a", "b", "n"))
        i, j, p = near_pairs(words, cell, short.astype(bool), a, b, chunk, slabs)
        # two words that agree in several pairs of classes count in the cell of the first; the cell tells by which they met
        counts = letter_counts([words[k] for k in i]).astype(np.uint64)
        own = _class_hashes(counts)
        at = np.arange(len(p))
        left, right = np.array(_PAIRS)[p].T
        first = _cell(own[at, left], own[at, right], p.astype(np.uint64), counts.sum(1)).view(np.int64) == cell[i]
        i, j = i[first], j[first]
        column = rows["word"].combine_chunks()
        to, near = pa.array(np.concatenate([i, j])), np.concatenate([j, i])
        return pa.RecordBatch.from_arrays([column.take(to), column.take(pa.array(near)), pa.array(n[near], pa.int64())], names=["word", "near", "near_n"])

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            cell, a, b = (rows[c].combine_chunks().to_numpy() for c in ("cell", "a", "b"))
            bounds = np.flatnonzero((cell[1:] != cell[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            slabs, at = [], 0
            while len(bounds) and at < bounds[-1]:
                k = np.searchsorted(bounds, at + _SLAB, "right") - 1  # as many whole blocks as fit, one at least
                end = int(bounds[k]) if k >= 0 and bounds[k] > at else int(bounds[np.searchsorted(bounds, at, "right")])
                slabs.append((at, end))
                at = end
            if slabs:
                yield compared(rows.slice(0, at), slabs)
            held = rows.slice(at)  # the last block may go on
        if held is not None and held.num_rows:
            yield compared(held, [(0, held.num_rows)])

    dealt = blocks.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b")
    pairs = dealt.mapInArrow(run, "word string, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """For distinct words and their counts (word, n): word, form, root, n, n_near, form_n.

    Two words are near if they differ by exactly one inserted, deleted or replaced letter; n_near is how many near words a word has. Its
    form is its near word of largest n (of equal ones the smallest in code-point order) if that n is at least `ratio` times its own, else
    null; form_n is the form's n. root follows forms to the last, and is the word itself where there is no form. A chain of forms has at
    most as many steps as n has digits, with a ratio of ten. Null words go; words are taken as distinct. An empty table gives none.

    A word has at most as many near words as there are edits of it, so no group by a word grows with the corpus."""
    words = kept(words.where("word is not null").select("word", F.col("n").cast("long").alias("n")))
    found = words.join(_neighbours(words), "word", "left")
    has = F.col("near_n") >= F.col("n") * ratio
    found = kept(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")))
    roots = kept(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = kept(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    out = found.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
