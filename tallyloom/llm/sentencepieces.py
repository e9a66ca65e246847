"""Encoding and decoding with the pieces of a public SentencePiece model, by batched Viterbi.

A text, with a space put in front, is cut into words (a run of spaces and what follows it); no piece reaches
over such a border, so words are independent and each distinct one is segmented once. Words of equal length
advance together: for every end position the hashes of all substrings that end there are looked up among the
sorted piece keys, and the best sum of scores and its last piece are kept. Where no piece fits, a byte piece does,
at BYTE_PENALTY below the worst score. Of equal sums the one with the longest last piece wins.

The result is the segmentation with the largest score sum, which for models trained by merging need not be the one
that merging gives. Decoding inverts encoding for every valid text.

Nulls: a NULL text is empty and has no pieces; a NULL doc_id is kept. Repeated rows give a row each, an empty table
none. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import bytescan
from tallyloom.llm.packing import vocabulary_path
from tallyloom.llm.wordcache import WordCache

MODEL = "piece_bpe_32k.model"
BYTE_PENALTY = 10.0


class PieceViterbi(WordCache):
    """Best-score segmentation with the pieces of the model file at `path`."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        #: What each id stands for; control ids stand for nothing.
        self.bytes: list[bytes] = [b""] * n
        self._byte_ids = np.full(256, model.unk_id(), np.int32)
        plain, scores = [], []
        for k in range(n):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                value = int(piece[3:5], 16)
                self.bytes[k], self._byte_ids[value] = bytes([value]), k
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                self.bytes[k] = piece.replace("▁", " ").encode()
                plain.append(k)
                scores.append(model.get_score(k))
        self.longest = max(len(self.bytes[k]) for k in plain)
        keys = np.array([self._key(self.bytes[k]) for k in plain], np.uint64)
        order = np.argsort(keys)
        self._keys, self._key_ids = keys[order], np.array(plain, np.int32)[order]
        self._scores = np.array(scores)[order]
        #: Whether any key has these leading bits; most substrings are no piece and stop here.
        self._maybe = np.zeros(1 << 21, bool)
        self._maybe[self._keys >> np.uint64(43)] = True
        self._byte_score = min(s for s in scores if s > -1e8) - BYTE_PENALTY
        self._sizes = np.array([len(b) for b in self.bytes], np.int64)
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._all = np.frombuffer(b"".join(self.bytes), np.uint8)
        self._forget()

    @staticmethod
    def _key(piece: bytes) -> int:
        return int(bytescan.Substrings(np.frombuffer(piece, np.uint8)).hashes(np.array([0]), np.array([len(piece)]))[0])

    def _viterbi(self, subs: bytescan.Substrings, data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For words of one length: last piece's id and its length for the best way to every position."""
        n = len(starts)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        piece, back = np.zeros((n, size + 1), np.int32), np.zeros((n, size + 1), np.int64)
        rows = np.arange(n)
        for end in range(1, size + 1):
            begin = np.arange(max(0, end - self.longest), end)  # the longest piece first
            keys = subs.hashes((starts[:, None] + begin).ravel(), np.repeat(starts + end, len(begin)))
            near = np.flatnonzero(self._maybe[keys >> np.uint64(43)])
            place = np.minimum(np.searchsorted(self._keys, keys[near]), len(self._keys) - 1)
            right = self._keys[place] == keys[near]
            at = np.zeros(len(keys), np.int64)
            score = np.full(len(keys), -np.inf)
            at[near[right]], score[near[right]] = place[right], self._scores[place[right]]
            at, score = at.reshape(n, -1), score.reshape(n, -1) + best[:, begin]
            pick = score.argmax(1)
            top = score[rows, pick]
            spelled = best[:, end - 1] + self._byte_score
            use_byte = spelled > top
            best[:, end] = np.where(use_byte, spelled, top)
            piece[:, end] = np.where(use_byte, self._byte_ids[data[starts + end - 1]], self._key_ids[at[rows, pick]])
            back[:, end] = np.where(use_byte, 1, end - begin[pick])
        return piece, back

    def _distinct(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        subs, sizes = bytescan.Substrings(data), ends - starts
        found: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
        for size in np.unique(sizes):
            of_size = np.flatnonzero(sizes == size)
            step = max(1, 200_000 // int(size))
            for k in range(0, len(of_size), step):
                words = of_size[k : k + step]
                piece, back = self._viterbi(subs, data, starts[words], int(size))
                at, open_ = np.full(len(words), size), np.arange(len(words))
                while len(open_):
                    found.append(np.stack([words[open_], at[open_], piece[open_, at[open_]]], 1))
                    at[open_] -= back[open_, at[open_]]
                    open_ = open_[at[open_] > 0]
        steps = np.concatenate(found)
        steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
        return steps[:, 2].astype(np.int32), np.bincount(steps[:, 0], minlength=len(starts)).astype(np.int64)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yield (first row, ids of the rows that follow, one after the other, row offsets into them)."""
        for at, _, raw, offsets in bytescan.slices(texts):
            full = np.diff(offsets) > 0
            data = np.insert(raw, offsets[:-1][full], 0x20)
            offsets = offsets + np.concatenate([[0], np.cumsum(full)])
            if not len(data):
                yield at, np.zeros(0, np.int32), offsets
                continue
            space = data == 0x20
            begin = space.copy()
            begin[1:] &= ~space[:-1]
            begin[offsets[:-1][full]] = True
            starts = np.flatnonzero(begin)
            ends = np.append(starts[1:], len(data))
            ids, run = self._ids(bytescan.span_hashes(data, starts, ends), data, starts, ends)
            yield at, ids, run[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes; the space in front is taken off again."""
        sizes = self._sizes[ids]
        run = np.cumsum(sizes)
        if not len(ids):
            return b""
        return self._all[np.repeat(self._starts[ids] - (run - sizes), sizes) + np.arange(int(run[-1]))].tobytes()[1:]


@lru_cache(maxsize=2)
def pieces(path: str) -> PieceViterbi:
    """One encoder per worker process and model."""
    return PieceViterbi(path)


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and ids of every document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces(vocabulary_path(model))
        for batch in batches:
            for at, ids, offsets in encoder.encode(batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(offsets) - 1), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows of ids; bytes that are no UTF-8 are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = pieces(vocabulary_path(model))
        for batch in batches:
            texts = [decoder.decode(np.array(x or [], np.int64)).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per document row: number of pieces, of byte pieces, CRC-32 of the ids, and whether decoding gives the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces(vocabulary_path(model))
        spelled = np.zeros(len(encoder.bytes), bool)
        spelled[encoder._byte_ids] = True
        names = ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"]
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for at, ids, offsets in encoder.encode(texts):
                rows = []
                for k in range(len(offsets) - 1):
                    own = ids[offsets[k] : offsets[k + 1]]
                    text = (texts[at + k].as_py() or "").encode()
                    rows.append((keys[at + k], len(own), int(spelled[own].sum()), zlib.crc32(own.astype("<u4").tobytes()), encoder.decode(own) == text))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean")
