"""Byte-pair encoding and decoding with a stored public vocabulary.

A text goes the way its tokenizer file states: names of special tokens are cut out, the rest is normalised and cut into
words by the file's pattern. Words are merged by contiguous rank arrays: the parts of a word and the rank of each part
with the next lie side by side; the array is scanned for its minimum, the boundary there is deleted and the ranks on both
sides are refreshed, until no two neighbours can be merged. Words that are new to a task are merged together, one row of
an array each. Scanning is quadratic, so words of over ``SHORT`` bytes take their minima from a heap, with the same result.

Each row is encoded where it lies: no shuffle. A task keeps the ids of the words of late, at most twice ``CACHED``.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from propensia.llm.tokens import LOWER, Block, blocks, span_hashes

CACHED = 100_000
BLOCK_BYTES = 1 << 20
SHORT = 64
WIDTHS = (4, 8, 12, 16, 24, 32, 64)
MERGED_ROWS = 1 << 14
SPECIAL, WHOLE = b"\xff", b"\xfe"  # no text holds these bytes
LONG_TEXT = 1 << 20
NONE = 1 << 62
MASK = (1 << 32) - 1
#: fixed value: a pattern whose words hold no white space, so that texts may be cut there first
SPACELESS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: fixed value: the words of a byte-level tokenizer without a pattern of its own
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is visible, else one past 255."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, unseen = [], 256
    for b in range(256):
        letters.append(chr(b if b in shown else unseen))
        unseen += b not in shown
    return letters


def _lower(text: str) -> str:
    """Lower case character by character: a final sigma is not told apart."""
    return text.replace("Σ", "σ").lower()


def _steps(spec: dict | None) -> list[Callable[[str], str]]:
    if spec is None:
        return []
    kind = spec["type"]
    if kind == "Sequence":
        return [step for part in spec["normalizers"] for step in _steps(part)]
    if kind in ("NFC", "NFD", "NFKC", "NFKD"):
        return [partial(unicodedata.normalize, kind)]
    if kind == "Lowercase":
        return [_lower]
    if kind == "Replace":
        pattern = spec["pattern"].get("Regex") or re.escape(spec["pattern"]["String"])
        return [partial(regex.compile(pattern).sub, spec["content"].replace("\\", r"\\"))]
    raise ValueError(f"normalizer {kind} is not supported")


def _pattern(spec: dict) -> str:
    """The pattern whose matches are a text's words."""
    if spec["type"] == "ByteLevel" and spec["use_regex"] and not spec["add_prefix_space"]:
        return BYTE_LEVEL_WORDS
    parts = spec.get("pretokenizers", [])
    if [p["type"] for p in parts] == ["Split", "ByteLevel"]:
        split, level = parts
        if split["invert"] and split["behavior"] == "Removed" and not level["use_regex"] and not level["add_prefix_space"]:
            return split["pattern"]["Regex"]
    raise ValueError(f"words by {spec} are not supported")


_CLASS = np.array([3 if b >= 0x80 else 0 if b in b"\x20\x09\x0a\x0b\x0c\x0d" else 1 if chr(b).isalpha() else 4 if chr(b).isdigit() else 2 for b in range(256)], np.uint8)


def units(block: Block, names: Iterable[bytes] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of ``SPACELESS`` in a block's plain stretches between white space; other stretches are units as a whole.

    Stretches with a byte over 0x7F or a special name are not plain. Returns the bytes (plain ones lower-cased), each unit's
    first byte and the byte after it, and whether it is a word.
    """
    raw = block.data
    kinds = np.zeros(len(raw) + 1, np.uint8)
    kinds[:-1] = _CLASS[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[block.bounds[:-1]] = True  # a stretch never spans two rows
    inside = kinds > 0
    stretch = inside & (first | ~np.concatenate([[False], inside[:-1]]))
    number = np.cumsum(stretch) - 1  # of the stretch that a byte lies in
    odd = np.zeros(int(stretch.sum()) + 1, bool)
    odd[number[kinds == 3]] = True
    whole = raw.tobytes()
    for name in names:
        at = whole.find(name)
        while at >= 0:
            odd[number[at]] = True
            at = whole.find(name, at + 1)
    plain = inside & ~odd[number]
    before = np.concatenate([[0], kinds[:-1]])
    start = stretch | (plain & ((kinds != before) | (kinds == 4)))
    data = np.where(plain[:-1], LOWER[raw], raw)
    marks = np.flatnonzero(plain[:-1] & (raw == ord("'")) & start[:-1])
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    for ending in ENDINGS:
        n = len(ending)
        met = marks[np.all([padded[np.minimum(marks + 1 + i, len(data) + 1)] == c for i, c in enumerate(ending)], axis=0)]
        met = met[(number[np.minimum(met + n, len(data))] == number[met])]
        start[met + 1] = False
        after = met + 1 + n
        start[after[plain[np.minimum(after, len(data))]]] = True
    starts = np.flatnonzero(start)
    stop = ~inside
    stop[block.bounds[1:]] = True
    edges = np.flatnonzero(start | stop)
    return data, starts, edges[np.searchsorted(edges, starts, "right")], plain[starts]


class Bpe:
    """A tokenizer file with a byte-level BPE model; files that ask for more are refused with a ValueError."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        asked = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or asked:
            raise ValueError(f"a BPE model without {asked} is needed")
        names = spec["added_tokens"]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in names):
            raise ValueError("only plain special tokens are supported")
        self.path, self.steps, self.words = path, _steps(spec["normalizer"]), regex.compile(_pattern(spec["pre_tokenizer"]))
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner, self.last = [vocabulary[c] for c in letters], [vocabulary[c + suffix] for c in letters]
        self.pairs: dict[int, int] = {}  # two parts to the rank and the id of their merge
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocabulary[a] << 32 | vocabulary[b]] = rank << 32 | vocabulary[a + b]
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in names}
        self.cut = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)).join("()")) if names else None
        keys = np.array(sorted(self.pairs), np.int64)
        self.keys, self.values = np.append(keys, MASK << 31), np.array([self.pairs[k] for k in keys.tolist()] + [NONE])
        self.inner_ids, self.last_ids = np.array(self.inner), np.array(self.last)
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.usual: set[str] = set()
        self.names = {SPECIAL + name.encode(): ids for name, ids in self.special.items()}
        self.spaceless = self.words.pattern == SPACELESS and all(n.isascii() and not regex.search(r"\s", n) for n in self.special)
        self.tokens = {i: t for t, i in vocabulary.items()} | {t["id"]: t["content"] for t in names}
        decoder = spec["decoder"] and spec["decoder"]["type"]
        if decoder not in (None, "ByteLevel"):
            raise ValueError(f"decoder {decoder} is not supported")
        self.byte = {c: b for b, c in enumerate(letters)}
        self.raw = None
        if decoder:
            own = {t["id"] for t in names}
            self.raw = {i: t.encode() if i in own else bytes(self.byte[c] for c in t) for i, t in self.tokens.items()}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.values[at], NONE)

    def merge_rows(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words as rows of bytes to their ids; the method of ``merge`` for all rows at once."""
        n, width = raw.shape
        cols, rows = np.arange(width), np.arange(n)
        parts = np.where(cols < sizes[:, None], self.inner_ids[raw], -1)
        parts[rows, sizes - 1] = self.last_ids[raw[rows, sizes - 1]]
        ranks = np.full((n, width + 1), NONE)
        pair = np.nonzero(cols[1:] < sizes[:, None])
        ranks[pair] = self._ranks(parts[pair], parts[pair[0], pair[1] + 1])
        out, left, live = parts.copy(), sizes.copy(), rows
        parts = np.hstack([parts, np.full((n, 1), -1)])
        while len(live):
            at = ranks.argmin(1)
            least = ranks[np.arange(len(at)), at]
            go = least < NONE
            if not go.all():
                out[live[~go]] = parts[~go, :width]
                left[live[~go]] = sizes[~go]
                parts, ranks, sizes, live, at, least = parts[go], ranks[go], sizes[go], live[go], at[go], least[go]
            me = np.arange(len(at))
            parts[me, at] = least & MASK
            parts[:, :-1] = np.where(cols > at[:, None], parts[:, 1:], parts[:, :-1])
            ranks[:, :-1] = np.where(cols >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            sizes = sizes - 1
            for here in (at - 1, at):
                met = me[(here >= 0) & (here + 1 < sizes)]
                ranks[met, here[met]] = self._ranks(parts[met, here[met]], parts[met, here[met] + 1])
        return out, left

    def _merge_words(self, found: list[bytes]) -> None:
        """New words, lower-cased and of plain letters, into the store."""
        sizes = np.array([len(w) for w in found])
        order, low = np.argsort(sizes, kind="stable"), 0
        for width in WIDTHS:
            mine = order[(sizes[order] > low) & (sizes[order] <= width)]
            for i in range(0, len(mine), MERGED_ROWS):
                chosen = [found[k] for k in mine[i : i + MERGED_ROWS].tolist()]
                raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in chosen), np.uint8).reshape(-1, width)
                ids, left = self.merge_rows(raw, sizes[mine[i : i + MERGED_ROWS]])
                for word, row, n in zip(chosen, ids.astype("<u4"), left.tolist()):
                    self.new[word] = row[:n].tobytes()
            low = width
        for k in order[sizes[order] > SHORT].tolist():
            self.new[found[k]] = self._word(found[k])

    def many(self, found: list[bytes], plain: list[bool]) -> list[bytes]:
        """Ids of units (see ``units``), those not in store merged together."""
        if len(self.new) > CACHED:
            self.old, self.new = self.new, {}
        keys = [unit if word else WHOLE + unit for unit, word in zip(found, plain)]
        missing, whole = {}, {}
        for unit, key, word in zip(found, keys, plain):
            if not self._stored(key):
                if word:
                    missing[unit] = None
                else:
                    whole[key] = pieces = self.pieces(unit.decode())
                    missing.update((w, None) for w in pieces if w not in self.names and not self._stored(w))
        self._merge_words(list(missing))
        for key, pieces in whole.items():
            self.new[key] = b"".join([self.names.get(w) or self.new[w] for w in pieces])
        out = [self.new[key] for key in keys]
        for key in [*missing, *whole]:
            if len(key) > SHORT:
                del self.new[key]
        return out

    def _stored(self, word: bytes) -> bool:
        """Whether the word is in the store, where its use keeps it."""
        if word in self.new:
            return True
        if word not in self.old:
            return False
        self.new[word] = self.old[word]
        return True

    def block(self, block: Block) -> list[bytes]:
        """Ids of each row of a block."""
        if not self.spaceless:
            return [self.encode(block.data[a:b].tobytes().decode()) for a, b in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist())]
        data, starts, ends, plain = units(block, [n.encode() for n in self.special])
        if not len(starts):
            return [b""] * block.rows
        _, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        text = data.tobytes()
        known = self.many([text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], plain[first].tolist())
        flat = np.frombuffer(b"".join(known), "<u4")
        sizes = np.array([len(x) for x in known]) >> 2
        places = np.cumsum(sizes) - sizes
        n = sizes[inverse]
        edges = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(edges[-1]) + np.repeat(places[inverse] - edges[:-1], n)].tobytes()
        cuts = (edges[np.searchsorted(starts, block.bounds)] * 4).tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def cut_words(self, text: str) -> Iterable[str]:
        """Normalised words. Characters newer than Python's tables are left to the tokenizer library's tables."""
        if not text.isascii() and not self.usual.issuperset(text):
            if any(unicodedata.category(c) == "Cn" for c in set(text)):
                own = library(self.path)
                text = own.normalizer.normalize_str(text) if own.normalizer else text
                return (bytes(self.byte[c] for c in w).decode() for w, _ in own.pre_tokenizer.pre_tokenize_str(text))
            self.usual.update(text)
        for step in self.steps:
            text = step(text)
        return self.words.findall(text) if len(text) < LONG_TEXT else (m[0] for m in self.words.finditer(text))

    def pieces(self, text: str) -> list[bytes]:
        """Normalised words of a text, and names of special tokens behind a byte that no word holds."""
        if self.cut is None or not any(name in text for name in self.special):
            return [w.encode() for w in self.cut_words(text)]
        found = []
        for i, part in enumerate(self.cut.split(text)):
            found.extend([SPECIAL + part.encode()] if i % 2 else [w.encode() for w in self.cut_words(part)])
        return found

    def merge(self, parts: list[int]) -> list[int]:
        """The parts of a short word after all merges, lowest rank first, of equal ranks the left one."""
        pairs = self.pairs
        ranks = [pairs.get(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            at = ranks.index(least)
            parts[at] = least & MASK
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = pairs.get(parts[at - 1] << 32 | parts[at], NONE)
            if at < len(ranks):
                ranks[at] = pairs.get(parts[at] << 32 | parts[at + 1], NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same for a long word: neighbours are linked, and a heap holds what can be merged."""
        pairs, n = self.pairs, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found, i, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (found := pairs.get(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            found, i, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or parts[j] != right or pairs.get(parts[i] << 32 | right) != found:
                continue
            parts[i], parts[j], after[i] = found & MASK, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < n and (new := pairs.get(parts[a] << 32 | parts[b])) is not None:
                    heapq.heappush(heap, (new, a, parts[b]))
        return [p for p in parts if p >= 0]

    def _word(self, word: bytes) -> bytes:
        parts = [self.inner[b] for b in word]
        parts[-1] = self.last[word[-1]]
        return np.array(self.merge(parts) if len(parts) <= SHORT else self.merge_long(parts), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return self.many([text.encode()], [False])[0] if text else b""

    def decode(self, ids: list[int]) -> str:
        """The text of ids, names of special tokens included; ids without a token are passed over."""
        known = self.tokens if self.raw is None else self.raw
        try:
            found = list(map(known.__getitem__, ids))
        except KeyError:
            found = [known[i] for i in ids if i in known]
        return " ".join(found) if self.raw is None else b"".join(found).decode(errors="replace")


@lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def _ids(raw: list[bytes], packed: bool) -> pa.Array:
    if packed:
        return pa.array(raw, pa.binary())
    bounds = np.cumsum([0, *[len(r) >> 2 for r in raw]])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def _encoded(path: str, column: int, kept: int, into: str, packed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        for batch in batches:
            rows = batch.select(range(kept))
            for block in blocks(batch.column(column), BLOCK_BYTES):
                yield rows.slice(block.first, block.rows).append_column(into, _ids(coder.block(block), packed))

    return run


def _decoded(path: str, column: str, into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        for batch in batches:
            packed = pa.types.is_binary(batch.schema.field(column).type)
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                ids = rows.column(column).to_pylist()
                texts = [coder.decode(np.frombuffer(i, "<u4").tolist() if packed else [x for x in i if x is not None]) if i else "" for i in ids]
                yield rows.append_column(into, pa.array(texts, pa.string()))

    return run


def encode(
    docs: DataFrame, vocabulary: str, text_col: str = "text", into: str = "ids", packed: bool = False, keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all if not given) with the token ids of every text in column ``into``, without special tokens added.

    Ids are an array of int, or with ``packed`` binary: little-endian unsigned 32-bit integers, as token files hold them.
    ``vocabulary`` is the path of a tokenizer file that every executor can read.

    Null and empty texts have no ids (an empty array). Every row is encoded on its own, repeated rows and ids included; no
    rows give no rows. A column named ``into`` is replaced. A text is whole in one task's memory; a single word of n
    letters takes about 300 n bytes. Two different words of a block of texts are one with a chance of 2^-64 a pair.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != into]
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(into, kind)])
    read = [*keep, text_col] if text_col not in keep else keep
    return docs.select(*read).mapInArrow(_encoded(vocabulary, read.index(text_col), len(keep), into, packed), schema)


def decode(rows: DataFrame, vocabulary: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids_col`` (array of int, or packed) in column ``into``; special tokens are kept.

    Null and empty ids give an empty text; null elements and ids without a token are passed over. All other columns
    are kept; one named ``into`` is replaced. No rows give no rows.
    """
    rows = rows.drop(into)
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())])
    return rows.mapInArrow(_decoded(vocabulary, ids_col, into), schema)
