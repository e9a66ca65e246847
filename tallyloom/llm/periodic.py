"""Runs of repeated word sequences, found with a dictionary of basic factors.

A run is a stretch of a text's words with smallest period q, at least max(LEAST, 2 q) words long, that no
neighbouring word extends keeping that period.

Dictionary: every word sequence of 1, 2, 4, ... words that its document holds more than once gets a number, a
sequence of 2 s words by the numbers of its halves; one that occurs once is dropped there, and with it all
longer ones around it, so most places leave after a few doublings.

Proposals: a run of period q, s <= q < 2 s, repeats its first s words q words later. Occurrences of one
sequence at most s / 2 apart form an arithmetic progression, whose difference is their own, smaller period, so
both ends of q lie in different progressions of that sequence, of which at most three follow within 2 s. At the
start of a run the words before the two places differ, and in the inside of a progression they are known to agree;
so only the first member of one of the two progressions can be there. That leaves a number of proposals in
proportion to the text, each a start and a period. The dictionary then says in one comparison a level how far both
places agree. Of runs with one start and end the smallest period stays.

Whole documents are worked on by Arrow batches, slices of short texts together and a long text by itself: memory is
4 bytes a word and level of the longest text. Nothing is shuffled.

Words are told apart by 64-bit hashes within their document. Nulls: a NULL text is empty; a NULL doc_id is kept (and
plants nothing). Empty texts have no runs. Repeated rows are rows of their own. An empty table gives no rows. Ties
of the longest run go to the smallest start, then period. Other columns pass through untouched; those with
the names of results (`n_words`, `runs`, `collapsed`) are left out of `examine` and replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import bytescan
from tallyloom.operators.joins import computed_once

LEAST = 12

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def _repeated(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key occurs more than once, by key and place, and the numbers of their keys."""
    order = np.argsort(keys, kind="stable")
    first = np.ones(len(keys), bool)
    first[1:] = keys[order][1:] != keys[order][:-1]
    twice = ~first
    twice[:-1] |= ~first[1:]
    return places[order[twice]], (np.cumsum(first) - 1)[twice]


def _counting(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of every range, one range after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def _proposed(places: np.ndarray, names: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in different progressions of one sequence, `size` to 2 `size` apart, one of them a first member."""
    edge = np.ones(len(places), bool)
    edge[1:] = (names[1:] != names[:-1]) | (places[1:] - places[:-1] > size // 2)
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(places)) - 1
    lefts, rights = [], []
    for ahead in (1, 2, 3):
        a, b = np.arange(len(first) - ahead), np.arange(ahead, len(first))
        near = (names[first[a]] == names[first[b]]) & (places[first[b]] - places[last[a]] < 2 * size)
        a, b = a[near], b[near]
        sizes = last[a] - first[a] + 1
        lefts.append(places[_counting(first[a], sizes)])
        rights.append(np.repeat(places[first[b]], sizes))
        sizes = last[b] - first[b]
        lefts.append(np.repeat(places[first[a]], sizes))
        rights.append(places[_counting(first[b] + 1, sizes)])
    left, right = np.concatenate(lefts), np.concatenate(rights)
    fits = (right - left >= size) & (right - left < 2 * size)
    return left[fits], right[fits]


def runs_of(words: np.ndarray, borders: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs, by start and period.

    `words` holds one key a word; `borders` the places where documents begin, and the end. Keys must differ between documents."""
    n = len(words)
    places = np.arange(n)
    end = np.repeat(borders[1:], np.diff(borders))
    opens = np.zeros(n + 1, bool)
    opens[borders] = True
    levels: list[np.ndarray] = []
    starts, seconds = [], []
    size = 1
    at, names = _repeated(words, places)
    while len(at):
        level = -1 - places.astype(np.int32)  # a sequence that occurs once equals no other
        level[at] = names
        levels.append(level)
        i, j = _proposed(at, names, size)
        maximal = opens[i] | (words[i - 1] != words[j - 1])
        starts.append(i[maximal])
        seconds.append(j[maximal])
        at = np.sort(at)
        at = at[at + 2 * size <= end[at]]
        at = at[level[at + size] >= 0]
        at, names = _repeated(level[at].astype(np.int64) * n + level[at + size], at)
        size *= 2
    if not starts:
        return (np.zeros(0, np.int64),) * 3
    i, j = np.concatenate(starts), np.concatenate(seconds)
    agreed = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = j + agreed < end[i]
        a, b = np.where(inside, i + agreed, 0), np.where(inside, j + agreed, 0)
        agreed += (inside & (levels[k][a] == levels[k][b])).astype(np.int64) << k
    period = j - i
    length = agreed + period
    long = length >= np.maximum(least, 2 * period)
    i, length, period = i[long], length[long], period[long]
    order = np.lexsort((period, length, i))
    i, length, period = i[order], length[order], period[order]
    fresh = np.ones(len(i), bool)
    fresh[1:] = (i[1:] != i[:-1]) | (length[1:] != length[:-1])
    i, length, period = i[fresh], length[fresh], period[fresh]
    order = np.lexsort((period, i))
    return i[order], length[order], period[order]


def _collapsed(text: bytes, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words of a text that no run holds after its first period, joined by one space."""
    words = text.split()  # bytes split at ASCII white space only
    if not len(start):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return b" ".join(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


_RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _examined(texts: pa.Array, least: int) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """Of each slice of texts: number of words, runs, and the collapsed text."""
    for _, _, data, offsets in bytescan.slices(texts):
        first, last, before = bytescan.words(data, offsets, _IS_WORD)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
        keys = bytescan.mixed(bytescan.span_hashes(data, first, last) + row.astype(np.uint64) * np.uint64(bytescan.BASES[0]))
        start, length, period = runs_of(keys, before, least)
        cuts = np.searchsorted(start, before)
        start = start - before[row[start]] if len(start) else start
        kept = []
        for k in range(len(offsets) - 1):
            own = slice(cuts[k], cuts[k + 1])
            kept.append(_collapsed(data[offsets[k] : offsets[k + 1]].tobytes(), start[own], length[own], period[own]))
        runs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"])
        yield pa.array(np.diff(before)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), runs), pa.array(kept, pa.binary()).cast(pa.string())


def examine(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """All rows with the columns n_words, runs (by start, then period) and collapsed (the text without what runs repeat)."""
    passed = [c for c in docs.columns if c not in ("text", "n_words", "runs", "collapsed")]
    at = len(passed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for n_words, runs, collapsed in _examined(batch.column(at), least):
                some = batch.slice(row, len(n_words))
                row += len(n_words)
                yield pa.RecordBatch.from_arrays([*some.columns[:at], n_words, runs, collapsed], names=[*batch.schema.names[:at], "n_words", "runs", "collapsed"])

    given = docs.select(*passed, "text")
    result = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema[:at]), "n_words bigint", f"runs {_RUNS}", "collapsed string"])
    return given.mapInArrow(scan, result)


def collapse(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The same rows and columns, every text without what its runs repeat. Texts without runs stay as they are; n_chars is
    refreshed."""
    text, runs, collapsed = "text", "runs", "collapsed"
    own = {c: f"_given_{k}" for k, c in enumerate(docs.columns) if c != text}
    found = examine(docs.withColumnsRenamed(own).withColumn("_given_text", F.col(text)), least)
    cut = F.when(F.size(runs) > 0, F.col(collapsed)).otherwise(F.col("_given_text"))
    columns = {c: F.col(own[c]) for c in own} | {text: cut}
    if "n_chars" in own:
        columns["n_chars"] = F.when(F.size(runs) > 0, F.length(collapsed)).otherwise(F.col(own["n_chars"])).cast(docs.schema["n_chars"].dataType)
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def stretched(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document (by the CRC-32 of its number) repeats words of its own up to its end.

    With h that checksum, g = h div 10 and n words, each word i >= a becomes word a + (i - a) % p of the given text, where
    a = g % n and p = 1 + (n - a) div (3 + g % 8)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", _whole(h, F.lit(10)).alias("g"), (h % 10 == 0).alias("chosen"))
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    worded = computed_once(chosen, words=F.when(F.col("chosen"), split))
    n = F.size("words")
    placed = worded.withColumn("a", F.when(n > 0, (F.col("g") % n).cast("int"))).withColumn("p", (1 + _whole(n - F.col("a"), 3 + F.col("g") % 8)).cast("int"))
    a, p = F.col("a"), F.col("p")
    repeated = F.transform(F.sequence(F.lit(0), n - a - 1), lambda x: F.get("words", a + x % p))
    text = F.when(a.isNotNull(), F.array_join(F.concat(F.slice("words", F.lit(1), a), repeated), " ")).otherwise(F.col("text"))
    return placed.select("doc_id", text.alias("text"))


def digest(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per document row: number of runs, the longest one, and SHA-256 of all runs and of the collapsed text."""
    runs = F.col("runs")
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("shortness"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    found = computed_once(examine(docs.select("doc_id", "text"), least), best=best)
    length, period = -F.col("best.shortness"), F.col("best.period")
    return found.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        _whole(1000 * length, period).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _whole(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)
