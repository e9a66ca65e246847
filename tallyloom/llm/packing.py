"""Best-fit packing of tokenised documents into sequences of a fixed length.

A document's ids, closed by an end id, are cut only where they exceed a sequence. Pieces are dealt at
random into groups of about GROUP, and each group is packed by best-fit decreasing: pieces from the
longest down, each into the open sequence with the least room that still holds it, found in a segment
tree over the possible rooms. Sequences of a group that stay underfull give their pieces back; those are
dealt into new groups and packed again, so the loss is one sequence or so in each of the few last groups.
A group is bounded by construction, so no task grows with the input.

Nulls: a NULL text is empty and packs as the end id alone; a NULL doc_id is kept. Repeated rows are packed
each on its own. An empty table gives no rows. Only doc_id and the text are read; other columns, whatever
their names, play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.bpe import word_bpe
from tallyloom.llm.common import Workspace, spread_group

VOCABULARY = "word_bpe_49k.json"
LENGTH = 4096
END_ID = 1
GROUP = 4096
#: A sequence with more free places than this gives its pieces to the second round.
UNDERFULL = 16

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary_path(name: str) -> str:
    """A file of the public vocabularies by its name, or a path as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """One row per piece: doc_id, number, first id's place in the document, length, CRC-32 of its ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_bpe(vocabulary_path(vocabulary))
        tail = np.array([end_id], "<u4")
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, ids, offsets in encoder.encode(batch.column(1)):
                wide = ids.astype("<u4")
                rows = []
                for k in range(len(offsets) - 1):
                    own = np.concatenate([wide[offsets[k] : offsets[k + 1]], tail])
                    for n, start in enumerate(range(0, len(own), length)):
                        part = own[start : start + length]
                        rows.append((keys[at + k], n, start, len(part), zlib.crc32(part.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


class _OpenRooms:
    """Which rooms, 0 to `most`, some open sequence has: a segment tree of counts, least room first."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, sequence) with the least room of at least `need`."""
        node, count = need + self.leaves, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, offset in it, and room left in that sequence, for each length."""
    n = len(lengths)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    rooms: list[int] = []
    tree = _OpenRooms(capacity)
    for k in np.argsort(-lengths, kind="stable"):
        need = int(lengths[k])
        found = tree.take(need)
        room, bin_ = found if found else (capacity, len(rooms))
        if not found:
            rooms.append(capacity)
        sequence[k], offset[k] = bin_, capacity - room
        rooms[bin_] = room - need
        if room - need:
            tree.add(room - need, bin_)
    return sequence, offset, np.array(rooms, np.int64)[sequence]


def _packed(rows: DataFrame, length: int, group: int, sign: int) -> DataFrame:
    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "piece", "start"], kind="stable", ignore_index=True)
        sequence, offset, room = best_fit_decreasing(part["length"].to_numpy(), length)
        ids = sign * ((int(key[0]) << 24) + sequence + 1)
        return part.drop(columns="group_no").assign(sequence_id=ids, offset=offset, room=room)

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    schema = f"{names}, sequence_id long, offset long, room long"
    return spread_group(rows, group, "group_no").groupBy("group_no").applyInPandas(pack, schema)


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, vocabulary: str = VOCABULARY, group: int = GROUP, text: str = "text") -> DataFrame:
    """All documents as pieces with their sequence_id and offset; every sequence is gapless from 0."""
    work = Workspace(docs.sparkSession, "packing", wide=True)
    rows = work.keep(pieces(docs, length, end_id, vocabulary, text), "pieces")
    first = work.keep(_packed(rows, length, group, 1), "first")
    full = F.col("room") <= UNDERFULL
    again = work.keep(first.where(~full).drop("sequence_id", "offset", "room"), "again")
    second = _packed(again, length, group, -1)
    return first.where(full).unionByName(second).drop("room")
