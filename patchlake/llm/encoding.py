"""Token ids of whole texts by the tokenizers library, with a cache of words in each Python worker."""

import os
import re
import sys
import types

import numpy as np

_MARK = re.compile(rb"[.,](?<=[a-z].)(?=[ \n])")
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([.,!?;:%#*$&|]*)")


#: Words that a worker's cache holds, some 200 bytes each. Fewer cost time and change no result.
CACHED_WORDS = 1_000_000


def encoder(path: str, word_wise: bool = True, most: int = CACHED_WORDS) -> "Encoder":
    """The encoder of this Python process, so that its cache outlives a task. It is held by a module of its own, as the
    globals of functions that travel with their code are made anew for each task."""
    held = vars(sys.modules.setdefault("patchlake_encoders", types.ModuleType("patchlake_encoders")))
    if (name := f"{path} {word_wise} {most}") not in held:
        held[name] = Encoder(path, word_wise, most)
    return held[name]


class Encoder:
    """`word_wise`: the tokenizer drops white space and no token reaches over it, so that a text's ids are those
    of its words, and a word is encoded once and then looked up. It also lower-cases, and ends words with a
    suffix. Else texts are handed to the library whole.

    The cache is emptied when it holds `most` words; that costs time and changes no result."""

    def __init__(self, path: str, word_wise: bool = True, most: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        from tokenizers import Tokenizer

        self.tokenizer, self.word_wise, self.most = Tokenizer.from_file(path), word_wise, most
        self.words: dict[bytes, bytes] = {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or "</w>"
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[bytes]) -> None:
        """Words of letters are encoded many at a time, and their ids cut where a token ends a word. Those with marks behind
        the letters are made from both parts."""
        known = self.words
        letters = {w for w in words if w.isalpha()}  # ASCII
        rest, parts = [], []
        for word in words - letters:
            m = _PLAIN.fullmatch(word.decode().lower())
            if m is None:
                rest.append(word)
                continue
            core, marks = m[1].encode(), m[2].encode()
            parts.append((word, core, marks))
            if core not in known:
                letters.add(core)
            if marks and marks not in known:
                rest.append(marks)
        order = list(letters)
        for at in range(0, len(order), 1000):
            some = order[at : at + 1000]
            ids = np.array(self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False).ids, dtype="<u4")
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cuts) == len(some):
                flat, start = ids.tobytes(), 0
                for word, end in zip(some, cuts):
                    known[word] = flat[start:end]
                    start = end
            else:
                known.update(zip(some, self._plain([x.decode() for x in some])))
        rest = list(set(rest))
        known.update(zip(rest, self._plain([x.decode() for x in rest])))
        for word, core, marks in parts:
            known[word] = known[core] + known[marks] if marks else known[core]

    def encode(self, texts: list[str | None], slice_bytes: int = 2_000_000) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; nothing for a null or empty text."""
        if not self.word_wise:
            return self._plain([x or "" for x in texts])
        out: list[bytes] = []
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= slice_bytes:
                out += self._encode(held)
                held, size = [], 0
        return out + self._encode(held)

    def _encode(self, texts: list[str]) -> list[bytes]:
        # special tokens are found before letters are lowered; words are cut at ASCII white space, and in front of a mark that
        # stands between a letter and white space
        whole = [k for k, text in enumerate(texts) if "<|" in text]
        cut = [[] if "<|" in text else _MARK.sub(rb" \g<0>", text.encode().lower()).split() for text in texts]
        new = set().union(*cut) - self.words.keys()
        if len(self.words) + len(new) > self.most:
            self.words.clear()
            new = set().union(*cut)
        self._learn(new)
        get = self.words.__getitem__
        out = [b"".join(map(get, words)) for words in cut]
        for k, ids in zip(whole, self._plain([texts[k] for k in whole])):
            out[k] = ids
        return out
