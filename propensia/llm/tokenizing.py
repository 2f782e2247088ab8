"""Token ids of whole texts with a stored public vocabulary.

White space ends every token of the vocabularies used here, they lower-case, and a full stop or comma after a letter is a
token of its own. So a block of texts is cut into words without their last stop or comma, each distinct one is encoded
once, and the ids of all texts are gathered from those.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from propensia.llm.tokens import Block, span_hashes, spans

MOST_WORDS = 300_000
JOINED = 200
_ALNUM = np.array([b < 0x80 and chr(b).isalnum() for b in range(256)])


class WordIds:
    """Words (UTF-8, without white space) to their ids; keeps the words of late, at most twice ``MOST_WORDS``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        (self.bar,) = self.tokenizer.encode("|", add_special_tokens=False).ids
        self.stops = [self._one(s) for s in (".", ",")]

    def _one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, found: list[bytes]) -> None:
        """Many words in few calls: they are joined by bars, whose id then parts the ids."""
        plain = [w for w in found if b"|" not in w]
        texts = [" | ".join(x.decode() for x in plain[i : i + JOINED]) for i in range(0, len(plain), JOINED)]
        for i, done in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            group, ids = plain[i * JOINED : (i + 1) * JOINED], np.array(done.ids, "<u4")
            cuts = np.flatnonzero(ids == self.bar)
            if len(cuts) != len(group) - 1:
                raise ValueError("the vocabulary has no token for a bar alone")
            raw, edges = ids.tobytes(), [0, *(cuts * 4 + 4).tolist(), len(ids) * 4 + 4]
            for word, a, b in zip(group, edges, edges[1:]):
                self.new[word] = raw[a : b - 4]
        for word in found:
            if b"|" in word:
                self.new[word] = self._one(word.decode())

    def many(self, found: list[bytes]) -> list[bytes]:
        if len(self.new) > MOST_WORDS:
            self.old, self.new = self.new, {}
        missing = []
        for word in found:
            if word not in self.new:
                if word in self.old:
                    self.new[word] = self.old[word]
                else:
                    missing.append(word)
        if missing:
            self._encode(missing)
        out = [self.new[w] for w in found]
        return out

    def block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a block, and each row's bounds in them."""
        raw = block.data.tobytes()
        data, starts, ends = spans(block, lower=b"<|" not in raw)  # names of special tokens keep their case
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(block.rows + 1, np.int64)
        last, before = data[ends - 1], data[np.maximum(ends - 2, 0)]
        stop = np.where(last == ord("."), 1, np.where(last == ord(","), 2, 0)) * (_ALNUM[before] & (ends - starts > 1))
        cores = ends - (stop > 0)
        _, first, inverse = np.unique(span_hashes(data, starts, cores), return_index=True, return_inverse=True)
        text = data.tobytes()
        known = self.many([text[a:b] for a, b in zip(starts[first].tolist(), cores[first].tolist())]) + self.stops
        flat = np.frombuffer(b"".join(known), "<u4")
        sizes = np.array([len(x) for x in known]) >> 2
        places = np.cumsum(sizes) - sizes
        unit_at = np.arange(len(starts)) + np.cumsum(stop > 0) - (stop > 0)
        units = np.empty(len(starts) + int((stop > 0).sum()), np.int64)
        units[unit_at] = inverse
        units[unit_at[stop > 0] + 1] = len(first) + stop[stop > 0] - 1
        n = sizes[units]
        edges = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(edges[-1]) + np.repeat(places[units] - edges[:-1], n)]
        rows = np.searchsorted(starts, block.bounds)
        return ids, edges[np.append(unit_at, len(units))[rows]]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
