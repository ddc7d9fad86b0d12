"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

Statistics of a text are counted in Arrow batches next to the data. The trees are fitted on a bounded sample of
labelled documents, flattened into numpy arrays of nodes, and score a batch of rows in one step per level.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counted for every text; the base rule looks at these alone.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Inputs of the trees, and how the score has to go with each: 1 up, -1 down, 0 free.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_char": -1, "dup_lines": -1, "repeat_words": -1, "distinct_words": 0,
    "upper_per_char": 0, "digits_per_char": 0, "bangs_per_char": -1, "words_per_line": 0, "top_word": 0, "marks_per_word": 0, "non_ascii": 0,
}
_SPACE, _SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
_UPPER, _DIGITS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?"


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words that lie in a window of so many words (a power of two) that is found twice or more in the text, the first one included."""
    if len(words) <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    span = 1
    while span < window:  # names of windows twice as long, made from pairs of names
        pairs = ids[:-span] * (int(ids.max()) + 1) + ids[span:]
        _, ids = np.unique(pairs, return_inverse=True)
        span *= 2
        if ids.max() + 1 == len(ids):
            return 0
    hit = np.flatnonzero(np.bincount(ids)[ids] > 1)
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def statistics(text: str | None) -> list[float]:
    """COUNTS, then FEATURES, of one text. A null text counts as an empty one; all ratios of nothing are 0."""
    text = text or ""
    raw = text.encode()
    less = lambda marks: len(raw) - len(raw.translate(None, marks))
    words = raw.split()  # space, and 0x09 to 0x0D
    lines = [line for line in raw.split(b"\n") if line.strip()]
    chars, n = len(text) - less(_SPACE), len(words)
    repeated, dup = repeated_words(words), len(lines) - len(set(lines))
    common = np.unique(np.array([hash(w) for w in words], dtype=np.int64), return_counts=True)[1] if n else np.zeros(0)
    symbols, c, w = less(_SYMBOLS), max(chars, 1), max(n, 1)
    return [
        n, chars, symbols, dup, repeated,
        float(np.log1p(n)), chars / w, symbols / c, dup / max(len(lines), 1), repeated / w, len(common) / w,
        less(_UPPER) / c, less(_DIGITS) / c, less(b"!") / c, n / max(len(lines), 1), float(common.max(initial=0)) / w, less(_MARKS) / w, (len(raw) - len(text)) / c,
    ]


@dataclass(frozen=True)
class Trees:
    """All trees in one set of arrays. A node without children (`feature` -1) is its own child, so that going down
    `depth` times from the roots ends at the leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality for each row."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            below = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(below, self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 10, smooth: float = 1.0) -> Trees:
    """Boosted trees for log-loss. A split of a constrained feature has to keep the order of its two values, and
    the middle of them bounds all values below, so that the score never goes the wrong way. With one class only, or no rows, there are
    no splits and the score is the log-odds of that class, smoothed."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1) if len(x) else np.zeros(x.shape, int)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots, score = [], np.full(len(y), base)

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        value = float(np.clip(g[rows].sum() / (h[rows].sum() + smooth), low, high))
        nodes.append([-1, 0.0, me, me, value * rate])
        gain, best = 1e-6, None
        if level < depth and len(rows) >= 2 * least:
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                sums = np.stack([np.bincount(code[rows, f], weights=w, minlength=len(cut) + 1).cumsum() for w in (g[rows], h[rows], np.ones(len(rows)))])
                gl, hl, nl = sums[:, :-1]
                gt, ht, nt = sums[:, -1]
                vl, vr = (np.clip(a / (b + smooth), low, high) for a, b in ((gl, hl), (gt - gl, ht - hl)))
                fits = (nl >= least) & (nt - nl >= least) & (monotone[f] * (vr - vl) >= 0)
                gains = np.where(fits, gl**2 / (hl + smooth) + (gt - gl) ** 2 / (ht - hl + smooth) - gt**2 / (ht + smooth), 0)
                k = int(gains.argmax())
                if gains[k] > gain:
                    gain, best = gains[k], (f, k, float(vl[k]), float(vr[k]))
        if best is None:
            step[rows] = value * rate
            return me
        f, k, vl, vr = best
        middle, m = (vl + vr) / 2, monotone[f]
        below = code[rows, f] <= k
        left = grow(rows[below], level + 1, middle if m < 0 else low, middle if m > 0 else high)
        right = grow(rows[~below], level + 1, middle if m > 0 else low, middle if m < 0 else high)
        nodes[me] = [f, float(cuts[f][k]), left, right, 0.0]
        return me

    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        g, h, step = y - p, p * (1 - p), np.zeros(len(y))
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
        score += step
    f, t, a, b, v = zip(*nodes) if nodes else ((), (), (), (), ())
    return Trees(np.array(f, int), np.array(t, float), np.array(a, int), np.array(b, int), np.array(v, float), np.array(roots, int), depth, base)


_STATISTICS = ", ".join([f"{c} long" for c in COUNTS] + [f"{f} double" for f in FEATURES])


def _frame(texts: pd.Series) -> pd.DataFrame:
    made = pd.DataFrame(np.array([statistics(t) for t in texts], dtype=float).reshape(len(texts), -1), columns=[*COUNTS, *FEATURES])
    return made.astype(dict.fromkeys(COUNTS, "int64"))


def fit(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int = 20_000) -> Trees:
    """Fit on labelled documents: at most `most` of the labels, those of the smallest hash of their key, so that
    the sample is bounded, even and the same each time. Labels that are null, or without a document, are left out;
    a document with several labels counts once for each. Of several rows with one key the one whose text has the smallest hash is taken."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_key"), "_key", "_y").limit(most).withColumn("_label", F.monotonically_increasing_id())
    texts = documents.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))
    measure = F.pandas_udf(_frame, _STATISTICS)
    joined = texts.join(F.broadcast(chosen), "_key").groupBy("_key", "_y", "_label").agg(F.min(F.struct(F.xxhash64("_text"), "_text")).alias("_one"))
    rows = joined.select("_key", "_y", measure("_one._text").alias("s")).select("_key", "_y", "s.*")
    sample = rows.toPandas().sort_values(["_key", "_y", *FEATURES])  # `most` rows, each with these few numbers
    return fit_trees(sample[list(FEATURES)].to_numpy(float), sample["_y"].to_numpy(float), list(FEATURES.values()))


def judged(df: DataFrame, text: str, trees: Trees, least_score: float = 0.0, out: str = "quality") -> DataFrame:
    """Add a struct `out` of COUNTS, base_failed, score and kept; all other columns stay, and one of that name is replaced.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows of 8. kept: not base_failed,
    and log-odds of at least `least_score`. Null and empty texts have counts of 0 and fail. Texts are taken whole.
    Each row stands alone, so repeated rows are judged alike and an empty table stays empty.
    """

    def judge(texts: pd.Series) -> pd.DataFrame:
        made = _frame(texts)
        failed = (made["n_words"] < 20) | (100 * made["n_repeat_words"] > 30 * made["n_words"])
        score = trees.score(made[list(FEATURES)].to_numpy(float))
        return made[COUNTS].assign(base_failed=failed, score=score, kept=~failed & (score >= least_score))

    schema = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"
    # not deterministic, as far as the optimizer goes: else a filter on the outcome runs the statistics once more
    return df.withColumn(out, F.pandas_udf(judge, schema).asNondeterministic()(F.col(f"`{text}`").cast("string")))
