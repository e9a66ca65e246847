"""Ids of words that occur again and again: each distinct word is encoded once and then looked up."""

from __future__ import annotations

import numpy as np

#: A worker keeps the ids of about so many words between slices, then starts anew.
KNOWN = 200_000


class WordCache:
    """Subclasses say how distinct words are encoded: _distinct(data, starts, ends) -> (ids, counts)."""

    def _forget(self) -> None:
        self._known: dict[int, int] = {}
        self._pool, self._from = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _places(self, hashes: list[int], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where each word's ids are kept; those met for the first time are encoded."""
        if len(self._known) > KNOWN:
            self._forget()
        place = np.array([self._known.get(h, -1) for h in hashes], np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            pool, counts = self._distinct(data, starts[new], ends[new])
            place[new] = len(self._known) + np.arange(len(new))
            self._known.update(zip([hashes[k] for k in new], place[new].tolist(), strict=True))
            self._from = np.concatenate([self._from, len(self._pool) + np.cumsum(counts)])
            self._pool = np.concatenate([self._pool, pool])
        return place

    def _ids(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all given words, one after the other, and how many there are before each word and in all."""
        values, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = self._places(values.tolist(), data, starts[first], ends[first])[which]
        sizes = self._from[place + 1] - self._from[place]
        run = np.cumsum(sizes)
        ids = self._pool[np.repeat(self._from[place] - (run - sizes), sizes) + np.arange(int(run[-1]))]
        return ids, np.concatenate([[0], run])
