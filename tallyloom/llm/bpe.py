"""Token ids of whole texts by a public word-level BPE vocabulary, many words at a time.

A text's ids are those of its pre-tokens one after the other, so each distinct pre-token of a slice is
merged once, together with all others of its length. Texts with characters beyond Latin-1, or with the
text of a special token, go to the tokenizers library itself; the ids are the library's either way.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tallyloom.llm import bytescan
from tallyloom.llm.wordcache import WordCache

_SPACE, _LETTER, _DIGIT, _OTHER, _LATER = 0, 1, 2, 3, 4
_NONE = np.int32(2**31 - 1)
#: Longer pre-tokens are left to the library, whose cost does not grow with the square of the length.
LONGEST = 256


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return out


class WordBpe(WordCache):
    """Encodes with the vocabulary file at `path`, as encode(text, add_special_tokens=False) would."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        letters = _byte_letters()
        self._inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self._final = np.array([vocab[letters[b] + "</w>"] for b in range(256)], np.int32)
        keys = np.array([vocab[a] * 65536 + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.int32)
        self._made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        #: Ranks of two bytes side by side, the second within a word or at its end.
        both = np.stack([self._inner, self._final])
        self._byte_ranks = self._rank(self._inner[None, :, None], both[:, None, :])
        self._forget()
        self._special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]).encode() or b"(?!)")

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * 65536 + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], _NONE)

    def _merge(self, ids: np.ndarray, ranks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of equal length in; (row numbers, their final ids) out. Each round merges, in every row
        still open, the leftmost pair of lowest rank, so all open rows stay equally long."""
        rows = np.arange(len(ids))
        while len(rows):
            if ids.shape[1] == 1:
                yield rows, ids
                return
            at = ranks.argmin(1)
            each = np.arange(len(rows))
            best = ranks[each, at]
            done = best == _NONE
            if done.any():
                yield rows[done], ids[done]
                rows, ids, ranks, at, best = (x[~done] for x in (rows, ids, ranks, at, best))
                each = np.arange(len(rows))
                if not len(rows):
                    return
            ids[each, at] = self._made[best]
            take = np.arange(ids.shape[1] - 1)[None, :] + (np.arange(ids.shape[1] - 1)[None, :] > at[:, None])
            ids = np.take_along_axis(ids, take, 1)
            if ids.shape[1] == 1:
                continue
            gone = np.arange(ranks.shape[1] - 1)[None, :]
            ranks = np.take_along_axis(ranks, gone + (gone >= at[:, None]), 1)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < ids.shape[1] - 1)
            ranks[left, at[left] - 1] = self._rank(ids[left, at[left] - 1], ids[left, at[left]])
            ranks[right, at[right]] = self._rank(ids[right, at[right]], ids[right, at[right] + 1])

    def _distinct(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each given pre-token, concatenated, and how many each has."""
        n, sizes = len(starts), ends - starts
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            if size > LONGEST:
                for r in rows:
                    text = data[starts[r] : ends[r]].tobytes().decode()
                    found.append((np.array([r]), np.array([self.library.encode(text, add_special_tokens=False).ids], np.int32)))
                continue
            raw = data[starts[rows][:, None] + np.arange(size)[None, :]]
            ids = self._inner[raw]
            ids[:, -1] = self._final[raw[:, -1]]
            ranks = self._byte_ranks[0][raw[:, :-1], raw[:, 1:]]
            ranks[:, -1:] = self._byte_ranks[1][raw[:, -2:-1], raw[:, -1:]] if size > 1 else ranks[:, -1:]
            found += [(rows[k], out) for k, out in self._merge(ids, ranks)]
        counts = np.zeros(n, np.int64)
        for rows, ids in found:
            counts[rows] = ids.shape[1]
        offsets = np.cumsum(counts) - counts
        pool = np.zeros(int(counts.sum()), np.int32)
        for rows, ids in found:
            pool[offsets[rows][:, None] + np.arange(ids.shape[1])[None, :]] = ids
        return pool, counts

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yield (first row, ids of the rows that follow, one after the other, row offsets into them)."""
        for at, _, data, offsets in bytescan.slices(texts):
            yield at, *self._slice(data, offsets)

    def _slice(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        data, kinds, odd = _classified(raw)
        slow = np.zeros(n, bool)
        slow[np.searchsorted(offsets, odd, "right") - 1] = True
        slow[[np.searchsorted(offsets, m.start(), "right") - 1 for m in self._special.finditer(raw.tobytes())]] = True
        begin = np.ones(len(data), bool)
        begin[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
        follows = np.flatnonzero(kinds == _LATER)
        begin[follows] = False
        kinds[follows] = kinds[follows - 1]
        wrong = follows[follows + 1 < len(data)] + 1  # the byte after a two-byte letter
        begin[wrong] = (kinds[wrong] != kinds[wrong - 1]) | (kinds[wrong] == _DIGIT)
        begin[wrong[kinds[wrong] == _LATER]] = False
        begin[offsets[:-1][offsets[:-1] < len(data)]] = True
        self._contractions(data, kinds, begin, offsets)
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))
        kept = kinds[starts] != _SPACE
        starts, ends = starts[kept], ends[kept]
        if len(starts):
            hashes = bytescan.span_hashes(data, starts, ends)
            ids, run = self._ids(hashes, data, starts, ends)
            at = run[np.searchsorted(starts, offsets)]
        else:
            ids, at = np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        if not slow.any():
            return ids, at
        parts = np.split(ids, at[1:-1])
        for r in np.flatnonzero(slow):
            text = raw[offsets[r] : offsets[r + 1]].tobytes().decode()
            parts[r] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _contractions(self, data: np.ndarray, kinds: np.ndarray, begin: np.ndarray, offsets: np.ndarray) -> None:
        """An apostrophe that starts a pre-token takes s, t, m, d, re, ve or ll behind it along."""
        marks = np.flatnonzero((data == 0x27) & begin)
        if not len(marks):
            return
        row_end = offsets[1:][np.searchsorted(offsets[1:], marks, "right")]
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        a = np.where(marks + 1 < row_end, padded[marks + 1], 0)
        b = np.where(marks + 2 < row_end, padded[marks + 2], 0)
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((b == 0x65) & ((a == 0x72) | (a == 0x76))) | ((a == 0x6C) & (b == 0x6C))
        for chosen, size in ((one, 2), (two, 3)):
            p = marks[chosen]
            begin[p + 1] = False
            after = p + size
            after = after[after < len(data)]
            if size == 3:
                begin[p + 2] = False
            begin[after] |= kinds[after] != _LATER


_ASCII = np.full(256, _OTHER, np.uint8)
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_ASCII[[*range(0x30, 0x3A)]] = _DIGIT
_ASCII[[0x20, *range(0x09, 0x0E)]] = _SPACE
# Second bytes of U+0080 to U+00BF and U+00C0 to U+00FF.
_AFTER_C2 = np.full(256, _OTHER, np.uint8)
_AFTER_C2[[0xAA, 0xB5, 0xBA]] = _LETTER
_AFTER_C2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _DIGIT
_AFTER_C2[[0x85, 0xA0]] = _SPACE
_AFTER_C3 = np.full(256, _LETTER, np.uint8)
_AFTER_C3[[0x97, 0xB7]] = _OTHER


def _classified(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, the kind of each, and places of bytes outside Latin-1."""
    data = raw.copy()
    data[(raw >= 0x41) & (raw <= 0x5A)] += 0x20
    kinds = _ASCII[raw]
    lead2, lead3 = np.flatnonzero(raw == 0xC2), np.flatnonzero(raw == 0xC3)
    kinds[lead2], kinds[lead3] = _AFTER_C2[raw[lead2 + 1]], _AFTER_C3[raw[lead3 + 1]]
    kinds[lead2 + 1] = kinds[lead3 + 1] = _LATER
    second = raw[lead3 + 1]
    data[lead3[(second <= 0x9E) & (second != 0x97)] + 1] += 0x20
    return data, kinds, np.flatnonzero((raw > 0xC3))


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    """One encoder per worker process and file."""
    return WordBpe(path)
