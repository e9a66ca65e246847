"""Sharding, periodic runs and vector codes against SQL, brute force and their own promises."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import compare, duck
from tallyloom.llm import periodic, queries, sharding, vector_codes
from tallyloom.llm.common import Workspace

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


# --- sharding -----------------------------------------------------------------------------------------
DOCS = "doc_id long, text string, shard string, _number string, size string"
ODD_DOCS = [
    (1, "a", "x", "y", "z"), (1, "a", "x", "y", "z"), (2, None, None, None, None), (3, "", "x", "y", "z"), (None, "b", "x", "y", "z"),
    (None, None, "x", "y", "z"), (-4, "ü" * 5, "x", "y", "z"), (5, "long " * 200_000, "x", "y", "z"),
]


def test_sharding_equals_sql(spark, con):
    findings, *_, rows = compare(spark, con, SF, queries.op11_rendezvous, queries.statements()["op11_rendezvous"])
    assert findings == {} and rows == 1000


def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = sharding.shard_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    moved = [r for r in rows if r["grown_shard"] != r["shard"]]
    assert all(r["grown_shard"] == 8 for r in moved) and 0.06 < len(moved) / len(rows) < 0.17
    for shard in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots))) and len(slots) > 80


def test_a_shard_gets_its_share_of_the_weight_and_gives_up_only_its_own(spark):
    keys = spark.range(40_000).withColumn("shard", F.lit("caller's"))
    weights = {0: 1.0, 1: 2.0, 2: 5.0, 3: 0.0}
    share = {r["shard"]: r["count"] / 40_000 for r in sharding.assign(keys, ["id"], weights).groupBy("shard").count().collect()}
    assert set(share) == {0, 1, 2} and all(abs(share[s] - weights[s] / 8) < 0.01 for s in share)
    lost = sharding.moves(keys, ["id"], weights, {0: 1.0, 2: 5.0}).collect()
    assert {r["from_shard"] for r in lost} == {1} and {r["to_shard"] for r in lost} == {0, 2}
    heavier = sharding.moves(keys, ["id"], weights, weights | {0: 2.0}).collect()
    assert {r["to_shard"] for r in heavier} == {0}


def test_sharding_of_odd_rows(spark):
    rows = sharding.shard_documents(spark.createDataFrame(ODD_DOCS, DOCS)).collect()
    assert len(rows) == len(ODD_DOCS)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ODD_DOCS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(spark.range(1), ["id"], {0: 0.0})


def test_a_key_with_a_third_of_all_rows_is_numbered_by_many_tasks(spark):
    docs = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    work = Workspace(spark, "test")
    narrow = work.keep(docs.select("doc_id", F.lit(0).alias("shard"), F.monotonically_increasing_id().alias("_number")), "narrow")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        slots = sharding.slots(narrow, ["doc_id"], work)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["slot"] for r in slots.collect()) == list(range(30_000))
    dealt = spark.read.parquet(work.path("dealt")).where("doc_id = 7").groupBy("_task").count().collect()
    assert len(dealt) > 1


def test_shards_are_written_whole(spark, tmp_path):
    docs = spark.createDataFrame(ODD_DOCS, DOCS)
    sharding.write(docs, ["doc_id"], {0: 1.0, 1: 1.0}, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ODD_DOCS) and {r["shard"] for r in back.select("shard").distinct().collect()} <= {0, 1}


# --- periodic runs --------------------------------------------------------------------------------------
def brute_runs(words, least):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 2 * q):
                found[i, length] = min(q, found.get((i, length), q))
            i = max(j, i + 1)
    return sorted(((i, length, q) for (i, length), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    pick = random.Random(5)
    for _ in range(1500):
        docs = []
        for _ in range(pick.randint(1, 4)):
            n, letters = pick.randint(0, 90), pick.choice([1, 2, 2, 3, 5, 40])
            words = [pick.randrange(letters) for _ in range(n)]
            if n and pick.random() < 0.6:
                a, p = pick.randrange(n), pick.randint(1, n)
                words = [*words[:a], *(words[a + (i - a) % min(p, n - a)] for i in range(a, n))]
            docs.append(words)
        least = pick.choice([2, 4, 12])
        keys = np.array([hash((k, w)) for k, words in enumerate(docs) for w in words], np.int64)
        borders = np.cumsum([0, *map(len, docs)])
        got = list(zip(*(x.tolist() for x in periodic.runs_of(keys, borders, least)), strict=True))
        expected = [(i + int(borders[k]), n, q) for k, words in enumerate(docs) for i, n, q in brute_runs(words, least)]
        assert got == expected


def brute_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]
    runs = brute_runs(words, 12)
    gone = {k for i, length, q in runs for k in range(i + q, i + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{i},{length},{q}\n" for i, length, q in runs)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc_id, len(runs), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_periodic_query_equals_brute_force_over_the_whole_table(spark):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = queries.op12_periodic_runs(spark, SF)
    assert got.columns == names
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted(brute_digest(*d) for d in docs if len(d["text"] or "") < 6000)
    short = {e[0] for e in expected}
    rows = sorted(tuple(r) for r in got.collect())
    assert len(rows) == len(docs) and [r for r in rows if r[0] in short] == expected
    assert len(short) > 0.9 * len(docs) and sum(e[1] > 0 for e in expected) > 50


ODD_TEXTS = [
    (7, None, 1), (8, "", 0), (9, " \t\n", 3), (None, "la " * 20, 60), (10, "x y " * 12, 48), (11, "a b " * 6, 24), (11, "a b " * 6, 24), (12, "  a", 3),
    *[(k, " ".join(f"w{j % (k % 7 + 1)}" for j in range(k)), 5) for k in range(20, 90)],
]


def test_periodic_runs_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string, n_chars int")
    got = Counter(tuple(r) for r in periodic.digest(periodic.stretched(docs)).collect())
    assert got == Counter(brute_digest(i, t) for i, t, _ in ODD_TEXTS)
    assert periodic.digest(periodic.stretched(spark.createDataFrame([], docs.schema))).count() == 0


def test_collapse_keeps_columns_and_texts_without_runs(spark):
    rows = [(1, "so so " * 10 + "end", 7, "r", "c", "g"), (2, "no  run here", 12, "r", "c", "g"), (3, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, runs string, collapsed string, _given_text string")
    got = {r["doc_id"]: r for r in periodic.collapse(docs).collect()}
    assert periodic.collapse(docs).schema == docs.schema
    assert got[1]["text"] == "so end" and got[1]["n_chars"] == 6 and got[1]["runs"] == "r" and got[1]["_given_text"] == "g"
    assert tuple(got[2]) == rows[1] and tuple(got[3]) == rows[2]


def test_a_very_long_text(spark):
    """12 MB: a plain part, one word again and again, and a passage of 100,000 words three times."""
    plain = " ".join(f"p{k}" for k in range(500_000))
    passage = " ".join(f"q{k}" for k in range(100_000))
    docs = spark.createDataFrame([(1, f"{plain} {'so ' * 700_000}{passage} {passage} {passage}")], "doc_id long, text string")
    row = periodic.examine(docs).select("n_words", "runs", F.length("collapsed").alias("n")).first()
    assert row["n_words"] == 1_500_000
    assert [tuple(r) for r in row["runs"]] == [(500_000, 700_000, 1), (1_200_000, 300_000, 100_000)]
    assert row["n"] == len(plain) + len(passage) + 4


# --- vector codes -----------------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, label int, code string, error string"


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[int(np.floor(4096 * float(np.float32(x)))) for x in r[1]] for r in kept]
    width = len(whole[0]) // parts
    cut = [[v[k * width : (k + 1) * width] for v in whole] for k in range(parts)]
    books = [[list(x) for x in part[:entries]] for part in cut]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            held = [nearest(x, books[k])[1] for x in cut[k]]
            for e in range(len(books[k])):
                mine = [x for x, h in zip(cut[k], held, strict=True) if h == e]
                if mine:
                    books[k][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    ends = [[nearest(cut[k][n], books[k]) for k in range(parts)] for n in range(len(kept))]
    errors = [sum(d for d, _ in e) for e in ends]
    by_label = Counter()
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] += e
    mark = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{k:02x}" for _, k in e), err, by_label[r[2]], mark) for r, e, err in zip(kept, ends, errors, strict=True))


def shown(rows):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in rows)


def test_vector_codes_equal_sql(spark, con):
    findings, *_, rows = compare(spark, con, SF, queries.op13_ball_kmeans, queries.statements()["op13_ball_kmeans"])
    assert findings == {} and rows == 500


def test_vector_codes_of_odd_rows(spark):
    pick = random.Random(3)
    coarse = lambda: [float(pick.randint(-2, 2)) / 4096 for _ in range(16)]  # noqa: E731 - few values, so distances tie
    rows = [(k, coarse(), pick.choice([1, 2, None]), "c", "e") for k in range(300)]
    rows += [(500, None, 1, "c", "e"), (501, [], 1, "c", "e"), (502, [None, *[0.5] * 15], 1, "c", "e"), (503, [float("nan")] * 16, 1, "c", "e")]
    rows += [(504, [float("-inf"), *[0.0] * 15], 1, "c", "e"), (None, coarse(), 2, "c", "e"), (7, coarse(), 2, "c", "e"), rows[9], (505, [0.0] * 16, None, "c", "e")]
    got = vector_codes.compress(spark.createDataFrame(rows, VECTORS)).collect()
    assert shown(got) == brute_codes(rows)
    few = rows[:5]
    assert shown(vector_codes.compress(spark.createDataFrame(few, VECTORS)).collect()) == brute_codes(few)
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    mixed = [*rows[:40], (900, [1.0, 2.0], 1, "c", "e")]
    assert shown(vector_codes.compress(spark.createDataFrame(mixed, VECTORS)).collect()) == brute_codes(rows[:40])
    uneven = vector_codes.compress(spark.createDataFrame([(k, [float(k)] * 13, 1, "c", "e") for k in range(30)], VECTORS)).collect()
    assert len(uneven) == 30 and all(len(r["code"]) == 16 for r in uneven)


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="distances would not fit"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 16, 1, "c", "e")], VECTORS)).count()


def test_balls_spare_distances_and_keep_the_assignment():
    draw = np.random.default_rng(2)
    centres = draw.integers(-2000, 2000, (16, 8))
    x = centres[draw.integers(0, 16, 5000)] + draw.integers(-60, 60, (5000, 8))
    held, *_ = vector_codes.all_entries(x, centres)
    book = centres + draw.integers(-20, 20, centres.shape)
    code, least, done = vector_codes.ball_entries(x, book, held)
    plain, squares, everything = vector_codes.all_entries(x, book)
    assert (code == plain).all() and (least == squares).all() and done < everything / 4
    wrong = draw.integers(0, 16, 5000)  # any entries held before give the same result
    assert (vector_codes.ball_entries(x, book, wrong)[0] == plain).all()


def test_training_and_decoding(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    books, rows, done = vector_codes.train(vectors, Workspace(spark, "test"))
    given = {r["vec_id"]: r["embedding"] for r in vectors.collect()}
    errors = []
    for r in rows.collect():
        back = books.decode(np.frombuffer(r["code"], np.uint8)[None, :])[0]
        errors.append(np.square(back - np.array(given[r["vec_id"]])).sum())
    spread = np.square(np.stack(list(given.values())) - np.stack(list(given.values())).mean(0)).sum(1).mean()
    assert np.mean(errors) < 0.8 * spread and len(done) == 7 and max(done[1:]) <= done[0]


def test_topk_drops_pairs_of_blocks_and_chunks(spark, monkeypatch):
    """Tight clusters: most pairs of a block and a chunk never meet, ties and repeated ids included; results equal brute force."""
    import numpy as np
    from pyspark.sql import functions as F

    from tallyloom.llm import topk

    for name, value in (("CHUNK", 100), ("BLOCK", 16), ("GROUP", 3), ("STEP", 8), ("PIVOTS", 12), ("FIRST", 400), ("SUB", 7)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((12, 16)) * 3
    v = np.float32(centres[np.arange(1200) % 12] + rng.standard_normal((1200, 16)) * 0.05)
    v[300:600] = v[300]
    ids = np.arange(1200)
    ids[-1] = 7
    rows = spark.createDataFrame([(int(k), [float(x) for x in row]) for k, row in zip(ids, v)], "vec_id long, embedding array<float>")
    seen = []
    monkeypatch.setattr(topk.Workspace, "keep", lambda self, frame, name, keep=topk.Workspace.keep: seen.append((name, keep(self, frame, name))) or seen[-1][1])
    found = {tuple(r) for r in topk.search(rows, F.col("vec_id") % 20 == 0).collect()}
    whole = np.floor(64 * v.astype(float))
    expected = set()
    for n in np.flatnonzero(ids % 20 == 0):
        score = whole @ whole[n]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[n]][:20]
        expected |= {(int(ids[n]), k + 1, int(ids[j]), int(score[j])) for k, j in enumerate(order)}
    assert found == expected
    kept = dict(seen)
    assert kept["pairs"].count() < 0.6 * kept["chunk_boxes"].count() * kept["block_boxes"].count()
