"""Sets of word shingles as sorted 64-bit hashes, worked out for many texts at once."""

from hashlib import blake2b

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix64: spreads every bit over all others."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = _mixed(np.arange(256, dtype=np.uint64)) | np.uint64(1)


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the byte at which it starts."""
    data = np.frombuffer(raw, dtype=np.uint8)
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    weight = _mixed(np.arange(int(lengths.max()) + 1, dtype=np.uint64) + np.uint64(1000)) | np.uint64(1)
    sums = np.add.reduceat(_LETTER[data[inside[1:-1]]] * weight[place], first)
    return _mixed(sums + lengths.astype(np.uint64)), starts


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, one after the other and sorted in each, and where each text's begin (one
    more entry than texts). A-Z count as a-z; words are cut at ASCII white space. Fewer than `words` words make one
    shingle of all of them; a text without words, or null, has none."""
    values, counts = [], []
    held: list[bytes] = []
    size = 0
    for k, text in enumerate(texts):
        held.append((text or "").encode().lower())
        size += len(held[-1]) + 1
        if size > 4_000_000 or k == len(texts) - 1:
            some, n = _sets(held, words)
            values.append(some)
            counts.append(n)
            held, size = [], 0
    if not values:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(values), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def _sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, starts = _word_hashes(b"\n".join(texts) + b"\n")
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(starts, bounds)  # each text's first word
    n_words = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), n_words)
    factor = _mixed(np.arange(words, dtype=np.uint64) + np.uint64(7)) | np.uint64(1)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    sums = np.zeros(len(hashes), np.uint64)
    for j in range(words):
        sums += padded[j : j + len(hashes)] * factor[j]
    sums = _mixed(sums)
    last = np.minimum(np.arange(len(hashes)) + words - 1, len(hashes) - 1)
    whole = (owner[last] == owner) & (np.arange(len(hashes)) + words <= len(hashes)) if len(hashes) else np.zeros(0, bool)
    sums, owner = sums[whole], owner[whole]
    short = np.flatnonzero((n_words > 0) & (n_words < words))
    if len(short):
        made = np.array([_mixed(np.array([(hashes[first[k] : first[k + 1]] * factor[: n_words[k]]).sum(dtype=np.uint64) + np.uint64(n_words[k])]))[0] for k in short], dtype=np.uint64)
        order = np.argsort(np.concatenate([owner, short]), kind="stable")
        sums, owner = np.concatenate([sums, made])[order], np.concatenate([owner, short])[order]
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, b in zip(ends[:-1], ends[1:]):
        sums[a:b].sort()
    fresh = np.ones(len(sums), bool)
    fresh[1:] = (sums[1:] != sums[:-1]) | (owner[1:] != owner[:-1])
    return sums[fresh], np.bincount(owner[fresh], minlength=len(texts))


def fingerprint(values: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return blake2b(values.tobytes(), digest_size=16).digest()
