"""Removal of every byte covered by a long string that starts more than once in the corpus.

A distributed form of prefix-free parsing. Triggers cut each text into phrases: a position triggers if its
rolling hash of GRAM bytes is the smallest among those of some LENGTH-byte string around it, so every string of
LENGTH bytes holds at least one trigger, and the same strings hold the same ones. The strings whose first smallest
hash is one trigger start side by side; together they span its phrase, and a phrase stands for all of them.

Dictionary: equal phrases (by a 128-bit hash) are counted; a phrase that occurs twice or more repeats as a whole.
Parse: two occurrences of a string in different phrases agree on its trigger and on at least half of the rest of
it before or behind the trigger. Those two contexts of a phrase are hashed; only phrases that share one with a
different phrase are opened, and the LENGTH-byte strings inside are compared, context by context. A context with more than
OPEN_LIMIT different phrases is not brought to one task; its strings are counted as rows of their own instead.

Copies are therefore settled by counting their phrases, map-side first, and bytes travel for the rims of repeats
only. Strings never cross documents; text is taken as UTF-8 bytes.

Nulls: a NULL text is empty; a NULL doc_id is kept. Repeated rows are places of their own, so all of a long
repeated row goes. Texts shorter than LENGTH keep everything. An empty table gives no rows. `dedup` passes all other
columns through and refreshes n_chars. Cuts inside a character drop what is left of it from the rebuilt text
(`dedup`); the digests (`removed`) are of the bytes. Rows are numbered once and written with their numbers; all jobs
read that copy, since a later plan may cut the input into other partitions and would number the rows anew.

Passages that texts share are shorter than LENGTH if they have few words. `reported` counts them beside what is removed, by
winnowing: of every NEIGHBOURS grams of GRAM_WORDS words that follow each other in a text the one of the least hash is chosen, so
texts that share GRAM_WORDS + NEIGHBOURS - 1 words in a row have chosen one of the same grams, and a gram that two rows chose
is one of GRAM_WORDS words that both have. Words are what stands between white space, as it is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import bytescan
from tallyloom.llm.common import Workspace
from tallyloom.operators.joins import lookup_join

LENGTH, GRAM, OPEN_LIMIT = 400, 32, 4096
PIECE = 128  # phrases whose strings, or rows whose texts, are looked at together
GRAM_WORDS, NEIGHBOURS = 32, 19
# Bits of a place in what is parsed together; the same for all slices, so that equal hashes are told apart alike everywhere.
_PLACE_BITS = np.uint64(21)
_MOST = np.uint64(np.iinfo(np.uint64).max)
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


def _first_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Sliding minimum over `width` keys, by running minima from both ends of blocks of that width."""
    pad = (-len(keys)) % width
    blocks = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    n = len(keys) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _windows(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int, int]]:
    """Bytes, row offsets, where the bytes begin in the slice, and the range of starts that count: a slice as it is, and one
    long row by windows that overlap so far that every string has its phrase's contexts in the window it starts in."""
    n, step = len(data), bytescan.SLICE_BYTES
    if len(offsets) > 2 or n <= 2 * step:
        yield data, offsets, 0, 0, n
        return
    for a in range(0, n, step):
        low, high = max(a - length, 0), min(a + step + 2 * length, n)
        yield data[low:high], np.array([0, high - low]), low, a - low, min(a + step, n) - low


def phrases(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, since: int, until: int) -> dict[str, np.ndarray]:
    """Of the strings that start in [since, until): row, first string's place, number of strings, trigger's place, and hashes of
    each phrase. A phrase that the range cuts becomes two, which share its contexts."""
    n = len(data) - length + 1
    if n <= 0:
        return {}
    one, two = bytescan.Substrings(data), bytescan.Substrings(data, bytescan.BASES[1])
    places = np.arange(len(data) - gram + 1)
    keys = (one.hashes(places, places + gram) >> _PLACE_BITS << _PLACE_BITS) | places.astype(np.uint64)
    trigger = (_first_least(keys, length - gram + 1) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = places[:n] + length <= offsets[1:][row]
    inside[:since] = False
    inside[until:] = False
    begin = np.ones(n, bool)
    begin[1:] = (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(begin)
    last = np.append(first[1:], n)
    first, last = first[inside[first]], last[inside[first]]
    row, trigger = row[first], trigger[first]
    end = last - 1 + length
    # A string of `length` bytes has this many bytes at least before or behind its trigger.
    half = (length - gram + 1) // 2
    left, right = np.maximum(trigger - half, offsets[row]), np.minimum(trigger + gram + half, offsets[row + 1])
    head, tail = one.hashes(left, trigger + gram), one.hashes(trigger, right)
    head = np.where(trigger - left == half, head | np.uint64(1), np.uint64(0))
    tail = np.where(right - trigger - gram == half, tail & ~np.uint64(1), np.uint64(0))
    return {
        "row": row, "lo": first - offsets[row], "n": last - first, "at": trigger - first,
        "h1": one.hashes(first, end), "h2": two.hashes(first, end), "head": head, "tail": tail,
    }


_PHRASES = "rid long, lo long, n int, h1 long, h2 long, head long, tail long"


def _parsed(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy()
            for at, _, whole, borders in bytescan.slices(batch.column(1)):
                for data, offsets, low, since, until in _windows(whole, borders, length):
                    p = phrases(data, offsets, length, gram, since, until)
                    if p:
                        columns = [pa.array(rid[at + p["row"]]), pa.array(low + p["lo"]), pa.array(p["n"].astype(np.int32))]
                        columns += [pa.array(p[k].view(np.int64)) for k in ("h1", "h2", "head", "tail")]
                        yield pa.RecordBatch.from_arrays(columns, names=["rid", "lo", "n", "h1", "h2", "head", "tail"])

    return rows.select("rid", "text").mapInArrow(parse, _PHRASES)


def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of every wanted phrase of a text, once for each of its contexts."""
    for batch in batches:
        for at, to, data, offsets in bytescan.slices(batch.column(1)):
            rid, wanted = batch.column(0).slice(at, to - at).to_pylist(), batch.column(2).slice(at, to - at).to_pylist()
            out = [(w["context"], w["many"], rid[k], w["lo"], int(offsets[k]) + w["lo"], w["n"] - 1 + length) for k in range(to - at) for w in wanted[k]]
            # A text that is full of repeats is cut out many times over.
            for some in range(0, len(out), 8 * PIECE):
                *columns, starts, sizes = zip(*out[some : some + 8 * PIECE], strict=True)
                parts = pa.array([data[a : a + n].tobytes() for a, n in zip(starts, sizes, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), parts], names=["context", "many", "rid", "lo", "bytes"])


def _strings(parts: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all strings inside the given phrases: phrase number, place in it, and two hashes."""
    wide = parts.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets) - length + 1
    phrase = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(phrase)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start = offsets[phrase] + place
    one, two = bytescan.Substrings(data), bytescan.Substrings(data, bytescan.BASES[1])
    return phrase, place, one.hashes(start, start + length), two.hashes(start, start + length)


def _in_pieces(parts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """`_strings` of PIECE phrases at a time; the other arrays that it takes are as long as the piece."""
    for at in range(0, len(parts), PIECE):
        phrase, place, one, two = _strings(parts.slice(at, PIECE), length)
        yield (phrase + at).astype(np.int32), place.astype(np.int32), one, two


def _spans(rid: np.ndarray, place: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of neighbouring string places as byte intervals."""
    order = np.lexsort((place, rid))
    rid, place = rid[order], place[order]
    begin = np.ones(len(rid), bool)
    begin[1:] = (rid[1:] != rid[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(begin)
    last = np.append(first[1:], len(rid)) - 1
    return pa.RecordBatch.from_arrays([pa.array(rid[first]), pa.array(place[first]), pa.array(place[last] + length)], names=["rid", "a", "b"])


def _opened(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Intervals of strings that occur in two or more of a context's phrases."""
    for run in bytescan.runs(batches, ["context"]):
        if run.num_rows > 1:
            phrase, place, one, two = (np.concatenate(x) for x in zip(*_in_pieces(run.column("bytes"), length), strict=True))
            order = np.lexsort((two, one))
            same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
            twice = np.zeros(len(one), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            if twice.any():
                phrase, place = phrase[twice], place[twice]
                yield _spans(run.column("rid").to_numpy()[phrase], run.column("lo").to_numpy()[phrase] + place, length)


def _listed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for phrase, place, one, two in _in_pieces(batch.column("bytes"), length):
            rid, lo = batch.column("rid").to_numpy()[phrase], batch.column("lo").to_numpy()[phrase]
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(lo + place), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["rid", "place", "h1", "h2"])


def repeats(rows: DataFrame, work: Workspace, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(rid, spans: array of (a, b)): byte intervals, overlaps included, of stored rows (rid, text) that repeat."""
    parsed = work.keep(_parsed(rows, length, gram), "parsed")
    book = parsed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times"), F.min("rid").alias("rid"), F.max("head").alias("head"), F.max("tail").alias("tail"))
    book = work.keep(book, "book")
    contexts = book.select(F.explode(F.array("head", "tail")).alias("context")).where("context <> 0")
    shared = work.keep(contexts.groupBy("context").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "shared")
    listed = book.select("h1", "h2", "times", "rid", F.explode(F.array("head", "tail")).alias("context")).where("context <> 0")
    opened = lookup_join(listed, shared, ["context"], "inner").select("h1", "h2", "times", "rid", "context", "many")
    # What a phrase stands for: all its occurrences if it repeats, else the one place that is to be opened.
    marks = opened.groupBy("h1", "h2", "rid").agg(F.collect_list(F.struct("context", "many")).alias("contexts"))
    marks = work.keep(marks, "marks")
    twice = book.where("times > 1").select("h1", "h2", F.lit(True).alias("twice"))
    whole = work.keep(lookup_join(parsed.select("rid", "lo", "n", "h1", "h2"), twice, ["h1", "h2"], "left_semi").select("rid", F.col("lo").alias("a"), (F.col("lo") + F.col("n") - 1 + length).alias("b")), "whole")
    # One occurrence of each phrase to open, in the smallest row that holds it; its first place there.
    spots = lookup_join(parsed.select("rid", "lo", "n", "h1", "h2"), marks, ["h1", "h2", "rid"], "inner")
    spots = spots.groupBy("h1", "h2", "rid", "n").agg(F.min("lo").alias("lo"), F.first("contexts").alias("contexts"))
    wanted = spots.select("rid", F.inline("contexts"), "lo", "n").groupBy("rid").agg(F.collect_list(F.struct("lo", "n", "context", "many")).alias("wanted"))
    wanted = work.keep(wanted, "wanted")
    work.drop("parsed", "book", "shared", "marks")
    texts = rows.select("rid", "text").join(wanted, "rid")
    cut = texts.mapInArrow(lambda b: _cut_out(b, length), "context long, many long, rid long, lo long, bytes binary")
    cut = work.keep(cut, "cut")
    few, many = cut.where(F.col("many") <= OPEN_LIMIT), cut.where(F.col("many") > OPEN_LIMIT)
    rims = few.repartition("context").sortWithinPartitions("context").mapInArrow(lambda b: _opened(b, length), "rid long, a long, b long")
    strings = many.dropDuplicates(["rid", "lo"]).select("rid", "lo", "bytes").mapInArrow(lambda b: _listed(b, length), "rid long, place long, h1 long, h2 long")
    again = strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    hot = lookup_join(strings, again, ["h1", "h2"], "left_semi").select("rid", F.col("place").alias("a"), (F.col("place") + length).alias("b"))
    spans = whole.unionByName(rims).unionByName(hot)
    return work.keep(spans.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")


def _without(data: bytes, spans: list) -> tuple[bytes, int, int]:
    """What stays, how many bytes go, and in how many runs; overlapping and touching spans are one run."""
    kept, at, runs = [], 0, 0
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if a > at or not runs:
            kept.append(data[at:a])
            runs += 1
        at = max(at, b)
    kept.append(data[at:])
    rest = b"".join(kept)
    return rest, len(data) - len(rest), runs


def _numbered(docs: DataFrame, work: Workspace, name: str = "rid") -> DataFrame:
    """A stored copy of the rows with their numbers. Numbers hold the partition, so they must never be worked out twice."""
    return work.keep(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def chosen_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every gram that is chosen, each once for a row."""
    starts, ends, before = bytescan.words(data, offsets, _WORD)
    n = len(starts) - GRAM_WORDS + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.arange(n)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    inside = row[:n] == row[GRAM_WORDS - 1 :]
    grams = np.where(inside, bytescan.Substrings(bytescan.span_hashes(data, starts, ends)).hashes(first, first + GRAM_WORDS), _MOST)
    # Least of each window, and of a gram's windows the one whose least is largest: it is chosen if that is its own.
    edge = np.full(NEIGHBOURS - 1, _MOST)
    least = _first_least(np.concatenate([edge, grams, edge]), NEIGHBOURS)
    mine = inside & (~_first_least(~least, NEIGHBOURS) == grams)
    row, grams = row[:n][mine], grams[mine]
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    return row[new], grams[new]


def passages(rows: DataFrame, work: Workspace) -> DataFrame:
    """(rid, n_passages): how many of its chosen grams another of the stored rows (rid, text) has chosen too, of rows with any."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy()
            for at, _, data, offsets in bytescan.slices(batch.column(1)):
                row, grams = chosen_grams(data, offsets)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(rid[at + row]), pa.array(grams.view(np.int64))], names=["rid", "gram"])

    grams = work.keep(rows.select("rid", "text").mapInArrow(choose, "rid long, gram long"), "grams")
    shared = grams.groupBy("gram").agg(F.min("rid").alias("first"), F.max("rid").alias("last")).where("first < last").select("gram")
    found = lookup_join(grams, shared, ["gram"], "left_semi").groupBy("rid").agg(F.count(F.lit(1)).alias("n_passages"))
    found = work.keep(found, "passages")
    work.drop("grams")
    return found


def _digested(rows: DataFrame, work: Workspace, length: int) -> DataFrame:
    """rid, doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is left, one row per stored row (rid, doc_id, text)."""
    found = repeats(rows, work, length)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, text, spans in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                kept, gone, n = _without(text.as_py().encode(), spans)
                out.append((rid.as_py(), gone, n, hashlib.sha256(kept).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["rid", "n_removed", "n_spans", "kept_sha256"])

    cut = rows.select("rid", "text").join(found, "rid").mapInArrow(digest, "rid long, n_removed long, n_spans long, kept_sha256 string")
    whole = rows.select("rid", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    none = F.lit(0).cast("long")
    return whole.join(work.keep(cut, "digests"), "rid", "left").select(
        "rid", "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")
    )


def _texts(docs: DataFrame, work: Workspace) -> DataFrame:
    return _numbered(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), work)


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is left, one row per document row."""
    work = Workspace(docs.sparkSession, "suffix", wide=True)
    return _digested(_texts(docs, work), work, length).drop("rid")


def reported(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`removed`, and n_passages: shared passages of many words, whatever their bytes."""
    work = Workspace(docs.sparkSession, "suffix", wide=True)
    rows = _texts(docs, work)
    shared = passages(rows, work)
    digests = _digested(rows, work, length).join(shared, "rid", "left")
    return digests.withColumn("n_passages", F.coalesce("n_passages", F.lit(0).cast("long"))).drop("rid")


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The same rows and columns with repeated stretches cut out of their texts."""
    work = Workspace(docs.sparkSession, "suffix", wide=True)
    number, spans = "_suffix_rid", "_suffix_spans"
    rows = _numbered(docs, work, number)
    found = repeats(rows.select(F.col(number).alias("rid"), F.coalesce("text", F.lit("")).alias("text")), work, length)
    joined = rows.join(found.withColumnsRenamed({"rid": number, "spans": spans}), number, "left").select(*docs.columns, spans)
    at, last = docs.columns.index("text"), len(docs.columns)
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The caller's job sends batches as large as it likes.
        for batch in (whole.slice(k, PIECE) for whole in batches for k in range(0, whole.num_rows, PIECE)):
            texts, found_ = batch.column(at).to_pylist(), batch.column(last).to_pylist()
            columns = list(batch.columns[:last])
            sizes = columns[chars].to_pylist() if chars is not None else None
            for k, these in enumerate(found_):
                if these:
                    texts[k] = _without(texts[k].encode(), these)[0].decode(errors="ignore")
                    if sizes is not None:
                        sizes[k] = len(texts[k])
            columns[at] = pa.array(texts, columns[at].type)
            if sizes is not None:
                columns[chars] = pa.array(sizes, columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:last])

    return joined.mapInArrow(cut, docs.schema)
