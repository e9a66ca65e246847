"""Vector codes: each part of a vector becomes the number of its nearest codebook entry, found by ball k-means.

Vectors become integers, floor(scale * x), and are cut into equal parts; each part position has a codebook of its own.
A round assigns all parts to their nearest entries and moves every entry to the floor of its parts' mean.

The parts of one entry form a ball around it, whose radius is the distance of its farthest part. An entry more than two
radii away cannot be nearer to any of them: the others are the ball's neighbours. A part whose own distance is below
half the distance to the nearest neighbour lies in the stable core and keeps its entry without a further look. The
rest lies in rings: between half the distance to the k-th neighbour and half that to the next, only the first k
neighbours are candidates. All tests compare whole numbers (4 d^2 with D^2), so they are exact, ties included. Balls
are taken per batch of rows, inside the task that holds them: a part of a ball has a smaller radius, so fewer
neighbours, and needs no pass of its own.

Every round is one pass over a stored table that carries each vector and its present code: a task assigns its rows and
adds up sums and counts per entry, which leave it as one row. The driver gets entries x (width + parts) sums a
round, a number that does not grow with the table, and sends back the new entries. The last pass keeps codes and errors.

Nulls and other vectors: rows whose vector is NULL, empty or holds NULL or non-finite components take no part, nor do
those of another length than most (ties: the shorter). A NULL vec_id or label is kept. The first entries are the vectors
of the smallest vec_ids (rows that share one: by vector), NULL last; with fewer vectors there are fewer entries.
Ties of distance go to the smaller entry; an entry without parts stays. A width that the number of parts does not
divide makes parts that differ by one component. Components of 2**27 or more after scaling end the run with an error:
their distances would not fit 64 bits. An empty table gives no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Workspace
from tallyloom.llm.vectors import matrix, usable
from tallyloom.operators.joins import lookup_join

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
_LARGEST = 1 << 27


def cuts(width: int, parts: int) -> list[slice]:
    """The components of each part."""
    return [slice(width * k // parts, width * (k + 1) // parts) for k in range(parts)]


def _squares(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    gap = x - entry
    return (gap * gap).sum(1)


def all_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each row, squared distance, and number of distances computed; no entry is left out."""
    squares = np.stack([_squares(x, entry) for entry in book], 1) if len(book) else np.zeros((len(x), 1), np.int64)
    own = squares.argmin(1)
    return own, squares[np.arange(len(x)), own], len(x) * len(book)


def ball_entries(x: np.ndarray, book: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The same result from the entries that the rows held before."""
    code, least = held.copy(), _squares(x, book[held])
    done = len(x)
    between = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
    order = np.argsort(held, kind="stable")
    borders = np.searchsorted(held[order], np.arange(len(book) + 1))
    for entry in range(len(book)):
        ball = order[borders[entry] : borders[entry + 1]]
        if not len(ball):
            continue
        reach = 4 * least[ball]
        near = np.flatnonzero(between[entry] <= reach.max())
        near = near[near != entry]
        near = near[np.argsort(between[entry][near], kind="stable")]
        ring = np.searchsorted(between[entry][near], reach, "right")  # 0: in the stable core
        for k, other in enumerate(near[: int(ring.max())].tolist()):
            some = ball[ring > k]
            squares = _squares(x[some], book[other])
            done += len(some)
            better = (squares < least[some]) | ((squares == least[some]) & (other < code[some]))
            code[some[better]], least[some[better]] = other, squares[better]
    return code, least, done


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, and how vectors are scaled and cut."""

    entries: tuple[np.ndarray, ...]
    scale: int

    def sha256(self) -> str:
        numbers = [str(c) for book in self.entries for entry in book.tolist() for c in entry]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes (rows by parts) stand for."""
        return np.concatenate([book[codes[:, k]] for k, book in enumerate(self.entries)], 1) / self.scale


def _assigned(v: np.ndarray, held: np.ndarray | None, books: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes (rows by parts), error of each row, and distances computed."""
    code, error, done = np.zeros((len(v), len(books)), np.uint8), np.zeros(len(v), np.int64), 0
    for k, where in enumerate(cuts(v.shape[1], len(books))):
        x = v[:, where]
        own, squares, n = all_entries(x, books[k]) if held is None else ball_entries(x, books[k], held[:, k].astype(np.int64))
        code[:, k] = own
        error += squares
        done += n
    return code, error, done


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as one binary value each."""
    width = rows.shape[1] * rows.itemsize
    offsets = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix_of(column: pa.Array, kind) -> np.ndarray:
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def _whole(column: pa.Array, scale: int) -> np.ndarray:
    v = np.floor(matrix(column) * scale)
    if len(v) and np.abs(v).max() >= _LARGEST:
        raise ValueError(f"a vector component is {_LARGEST // scale} or more in size; distances would not fit 64 bits")
    return v.astype(np.int32)


def _pass(source: DataFrame, books: tuple[np.ndarray, ...], read: Callable, label: str) -> DataFrame:
    """Assign all rows; every task adds one row with its sums and counts of all entries and its number of distances."""
    width, parts, entries = sum(b.shape[1] for b in books), len(books), len(books[0])
    where = cuts(width, parts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, done = np.zeros((entries, width), np.int64), np.zeros((entries, parts), np.int64), 0
        names = ["vec_id", "label", "v", "code", "error", "sums"]
        kinds = None
        for batch in batches:
            if not batch.num_rows:
                continue
            v, held = read(batch)
            wide = v.astype(np.int64)
            code, error, n = _assigned(wide, held, books)
            done += n
            for k in range(parts):
                order = np.argsort(code[:, k], kind="stable")
                used, first = np.unique(code[order, k], return_index=True)
                sums[used, where[k]] += np.add.reduceat(wide[order][:, where[k]], first, axis=0)
                counts[:, k] += np.bincount(code[:, k], minlength=entries)
            kinds = batch.column(0).type, batch.column(1).type
            none = pa.nulls(len(v), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(v), _binary(code), pa.array(error), none], names=names)
        if kinds:
            total = pa.array([[*sums.ravel().tolist(), *counts.ravel().tolist(), done]], pa.list_(pa.int64()))
            empty = [pa.nulls(1, kind) for kind in (*kinds, pa.binary(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, total], names=names)

    return source.mapInArrow(scan, f"vec_id long, label {label}, v binary, code binary, error long, sums array<long>")


def _moved(books: tuple[np.ndarray, ...], sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    where = cuts(sums.shape[1], len(books))
    return tuple(
        np.where(counts[:, k, None] > 0, sums[:, where[k]] // np.maximum(counts[:, k, None], 1), book) for k, book in enumerate(books)
    )


def train(
    table: DataFrame, work: Workspace, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[Codebooks, DataFrame, list[int]]:
    """The codebooks after the last round, stored rows (vec_id, label, v, code, error) coded with them, and the number of
    distances computed in each pass."""
    if not 1 <= entries <= 256:
        raise ValueError("a code holds 1 to 256 entries")
    label = table.schema["label"].dataType.simpleString() if "label" in table.columns else "string"
    given = usable(table).select(F.col("vec_id").cast("long"), F.col("label") if "label" in table.columns else F.lit(None).cast("string").alias("label"), "embedding")
    size = given.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = size["n"] if size else 0
    given = given.where(F.size("embedding") == width)
    chosen = given.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).collect()
    start = np.floor(np.array([r[0] for r in chosen], float).reshape(len(chosen), width) * scale).astype(np.int64)
    books = tuple(start[:, where] for where in cuts(width, parts))
    source, read, done, held = given, lambda batch: (_whole(batch.column(2), scale), None), [], None
    for n in range(rounds + 1):
        coded = work.keep(_pass(source, books, read, label), f"pass-{n}")
        if held:
            work.drop(held)
        held = f"pass-{n}"
        totals = coded.where("sums IS NOT NULL").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
        flat = np.zeros(len(start) * (width + parts) + 1, np.int64)
        for r in totals:
            flat[r["pos"]] = r["n"]
        done.append(int(flat[-1]))
        rows = coded.where("v IS NOT NULL").drop("sums")
        if n < rounds and len(start):
            sums, counts = flat[: len(start) * width].reshape(len(start), width), flat[len(start) * width : -1].reshape(len(start), parts)
            books = _moved(books, sums, counts)
        source = rows.select("vec_id", "label", "v", "code")
        read = lambda batch: (_matrix_of(batch.column(2), np.int32), _matrix_of(batch.column(3), np.uint8))
    return Codebooks(books, scale), rows, done


def compress(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code (two hexadecimal digits a part), error, label_error and the SHA-256 of all entries."""
    work = Workspace(table.sparkSession, "vector-codes")
    books, rows, _ = train(table, work, parts, entries, rounds, scale)
    per_label = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = lookup_join(rows.select("vec_id", "label", "code", "error"), per_label, ["label"], null_safe=True)
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
