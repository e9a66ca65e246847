"""Each operator against a brute-force version on small fixtures full of odd rows."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tallyloom.llm import bytescan, license_scan, neardup, ngram_join, packing, pii, sentencepieces, suffix, token_counts, topk, toxicity
from tallyloom.llm.bpe import word_bpe
from tallyloom.llm.common import Workspace
from tallyloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, length long"


def prose(rng, n):
    return " ".join("".join(rng.choices(["th", "er", "on", "an", "re", "he", "in", "é"], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base, passage = prose(rng, 220), prose(rng, 130)
    near = base.split()
    near[100] = "changed"
    odd = [None, "", " \n\t", "one two", "one two", "x" * 900, "a b " * 400, "é" * 450, "\x00weird\x1c<|endoftext|> it's don't", "日本語 ☃ ▁ "]
    more = [base, base, base, " ".join(near), base.upper(), passage + " " + prose(rng, 40), prose(rng, 30) + " " + passage, prose(rng, 3000)]
    personal = [
        "mail a.b@c.de and x@y or me@h-1.example.org. +1 (234) 555-6789 call",
        "card 4111 1111 1111 1111 not 4111 1111 1111 1112, ip 10.0.0.1 and 300.1.1.1 and 1.2.3.4.5 0001.2.3.255",
        'token = "9c8b45435718dcc700c184a7e303cdc712345678"',
    ]
    legal = [
        "Released under the MIT License. mit-license MIT license mit license",
        "Licensed under the GNU General Public License, version 3. CC BY-NC 4.0; Apache   License",
    ]
    return odd + more + personal + legal


@pytest.fixture(scope="module")
def docs(spark, texts, tmp_path_factory):
    rows = [(k, t, "en", "src0" if k % 3 else None, len(t or ""), -1) for k, t in enumerate(texts)]
    rows += [(None, "a row without an id " * 3, None, None, None, None), rows[10]]
    path = str(tmp_path_factory.mktemp("docs") / "docs")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_library():
    encoder = word_bpe(packing.vocabulary_path(packing.VOCABULARY))
    rng = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", " ", "\n", "A", "É", "ß", "×", "1", "²", "ª", "&&", " ", "\x85", "<|endoftext|>", "the", "日", "İ", "🙂", "µ", "\x00"]
    some = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)] + [None, "b" * 700]
    got = {}
    for at, ids, offsets in encoder.encode(pa.array(some, pa.string())):
        got |= {at + k: ids[offsets[k] : offsets[k + 1]].tolist() for k in range(len(offsets) - 1)}
    assert [got[k] for k in range(len(some))] == [encoder.library.encode(t or "", add_special_tokens=False).ids for t in some]


def test_packing(docs, none, texts):
    library = word_bpe(packing.vocabulary_path(packing.VOCABULARY)).library
    rows = packing.pack(docs, length=512).collect()
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r["length"] for r in rows)
    assert len(places) <= -(-total // 512) + 1
    for k, t in enumerate(texts):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        own = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == k})
        assert own == [(n, s, len(ids[s : s + 512]), zlib.crc32(ids[s : s + 512].tobytes())) for n, s in enumerate(range(0, len(ids), 512))]
    assert packing.pack(none).count() == 0


def test_best_fit_takes_the_tightest_room():
    sequence, offset, room = packing.best_fit_decreasing(np.array([6, 5, 4, 5, 10]), 10)
    assert sorted(Counter(sequence).values()) == [1, 2, 2] and set(room) == {0}


def test_token_counts_replay_and_signs(spark, docs, none):
    counts = token_counts.count_tokens(docs).cache()
    rollup = token_counts.Rollup(spark)
    assert rollup.totals().count() == 0
    assert rollup.commit("a", token_counts.inserts(counts, "v1"))
    assert not rollup.commit("a", token_counts.inserts(counts, "v1"))
    rollup.commit("b", token_counts.deletes(counts.where("doc_id = 10"), "v1"))
    rollup.commit("c", token_counts.inserts(token_counts.count_tokens(none), "v1"))
    expected = Counter()
    for r in counts.collect():
        if r["doc_id"] != 10:
            expected[r["source"], r["lang"]] += r["n_tokens"]
    assert {(r["source"], r["lang"]): r["n_tokens"] for r in rollup.totals().collect()} == dict(expected)
    assert sum(r["n_docs"] for r in rollup.totals().collect()) == docs.count() - 2


def test_a_named_rollup_is_opened_again(spark):
    """Another driver's object sees the committed batches, takes none twice and leaves out one that was cut off."""
    one = [("a", "en", "v1", 1, 10)]
    changes = spark.createDataFrame(one, "source string, lang string, tokenizer_version string, n_docs long, n_tokens long")
    name = f"again {random.random()}"
    first = token_counts.Rollup(spark, name)
    assert first.commit("load/1 é", changes) and first.commit("load/2", changes)
    cut_off = first._work.path(token_counts.BATCH + token_counts._safe("load/3"))
    changes.write.parquet(cut_off)
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{cut_off}/_SUCCESS")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, False)
    second = token_counts.Rollup(spark, name)
    assert not second.commit("load/1 é", changes)
    assert [(r["n_docs"], r["n_tokens"], r["n_batches"]) for r in second.totals().collect()] == [(2, 20, 2)]
    assert second.commit("load/3", changes) and first.totals().first()["n_tokens"] == 30
    assert token_counts.Rollup(spark, name + "x").totals().count() == 0


def test_plain_license_names(spark):
    cases = {
        "GNU Lesser General Public License Version 2.1": "lgpl-2.1",
        "Mozilla Public License 2.0": "mpl-2.0",
        "BSD 3-Clause License": "bsd-3-clause",
        "License: EPL-2.0": "epl-2.0",
        "Apache License Version 2.0": "apache,apache-2.0",
        "the MIT License": "mit",
        "released under the Mozilla Public License 2.0": "mpl-2.0",
        "Komm mit zum Gipfel, replace the apache helicopter": "",
        "": "",
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(rows).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def test_license_base(docs, none, texts):
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    for k, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at, labels = [], set()
        for phrase, label in license_scan.BASE:
            p = phrase.split()
            found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert "gpl-3" in got[len(texts) - 1]["labels"]
    assert len(license_scan.rules()) > 200 and license_scan.scan(none).count() == 0


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    given = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v, d: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v, d: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v, d: 12 <= len(d) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v, d: 9 <= len(d) <= 15),
    )
    out = [(m.start(), n, m.end(), kind) for n, (kind, rx, ok) in enumerate(given) for m in re.finditer(rx, t) if ok(m[0], re.sub("[^0-9]", "", m[0]))]
    return sorted(out)


def test_pii_base_and_redaction(docs, none, texts):
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    clean = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    for k, t in enumerate(texts):
        spans = base_spans(t or "")
        line = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        assert got[k]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [got[k][f"n_{kind}"] for kind in pii.KINDS] == [sum(s[3] == kind for s in spans) for kind in pii.KINDS]
        if not got[k]["spans"]:
            assert clean[k]["text"] == t
        else:
            assert base_spans(clean[k]["text"]) == [] and "[" in clean[k]["text"]
    assert pii.redact(docs).columns == docs.columns and pii.find(none).count() == 0


def test_pii_adds_what_base_formats_lack(spark):
    rng = random.Random(11)
    n = lambda k: "".join(rng.choices("0123456789", k=k))
    key = lambda: "".join(rng.choices("ghjkmnpqrstuvwxyzGHJKMNPQRSTUVWXYZ23456789", k=31)) + "7"
    rows, personal, plain = [], [], []
    for k in range(900):
        cue = rng.random() < 0.5
        local = f"0{1 + k % 9}{n(2)} {1 + k % 9}{n(6)}"
        wanted = [
            ("number", "", f"({2 + k % 8}{n(2)}) {n(3)}-{n(4)}"), ("number", "", f"{n(3)}-{n(2)}-{n(4)}"), ("number", "tel " if cue else "", local),
            ("address", "", f"jo{k} [at] host{k % 7} [dot] org"), ("secret", "token = " if cue else "", key()),
        ]
        kind, before, value = wanted[k % 5]
        other = [f"20{n(2)}-0{1 + k % 9}-1{k % 10} 1{k % 10}:3{k % 10}", f"{1 + k % 9}.{n(3)}.{n(3)}.{n(3)}", "-".join(["part", "of", "a", "long", "name", n(1), "here"])][k % 3]
        text = f"{prose(rng, 6)} {before}{value} {prose(rng, 5)} x {other} y"
        at = text.index(value)
        personal.append((k, f"{kind}:{at}:{at + len(value)}", k % 5, bool(before)))
        at = text.index(other)
        plain.append((k, at, at + len(other)))
        rows.append((k, text, "en", "s", len(text), 1))
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.find(docs).collect()}
    found = Counter((form, cue) for k, span, form, cue in personal if span in got[k])
    of = Counter((form, cue) for _, _, form, cue in personal)
    assert all(found[x] == of[x] for x in of if x[0] in (0, 1, 3) or x[1]), (found, of)
    assert all(found[x] >= 0.8 * of[x] for x in of), (found, of)
    wrong = sum(any(int(a) < end and start < int(b) for _, a, b in (x.split(":") for x in got[k] if x)) for k, start, end in plain)
    assert wrong <= 0.02 * len(plain), wrong


def test_pii_unlabelled_shapes_are_not_personal():
    score = np.array([2.0] * 300 + [1.0] * 300)
    y = np.array([1.0, 0.0] * 150 + [0.0] * 290 + [1.0] * 10)
    chance = pii.chances(score, y)
    assert (chance[:300] > 0.98).all() and (chance[300:] < 0.1).all()


def test_boosted_trees_learn_a_rule():
    x = np.random.default_rng(0).random((600, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(float)
    start, trees = pii.boosted(x, y)
    score = start + pii.RATE * sum(pii._value(t, x) for t in trees)
    assert ((score > 0) == (y == 1)).mean() > 0.97


def test_toxicity(spark, none):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        words = prose(rng, 60).split()
        if bad:
            for _ in range(rng.randint(3, 9)):
                words.insert(rng.randint(0, 60), rng.choice(["vile", "rotten", "nasty"]))
        rows.append((k, " ".join(words), "en", "s", 1, 1))
        labels.append((k, 1, int(bad)))
    table = spark.createDataFrame([*rows, (None, None, None, None, None, None)], DOCS)
    known = spark.createDataFrame([x for x in labels if x[0] % 2 == 0] + [(None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table, known)
    out = toxicity.score(table, model).collect()
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] % 2]
    assert all(not r["rejected"] for r in held)
    held = [r for r in out if r["doc_id"] is not None]
    wrong = sum(r["rejected"] != (r["doc_id"] % 4 == 0) for r in held)
    assert wrong <= 4 and all(0 <= r["expected_severity"] <= 3 for r in out)
    stay = toxicity.clean(table, model)
    assert stay.columns == table.columns and stay.count() == len(out) - sum(r["rejected"] for r in out)
    nothing = toxicity.fit(none, known)
    assert toxicity.clean(table, nothing).count() == table.count()
    grades = np.array([0, 1, 2, 3] * 50)
    w, thresholds = toxicity.cumulative_link(grades[:, None] * 1.0, grades)
    assert w[0] > 0 and (np.diff(thresholds) > 0).all()


VECTORS = "vec_id long, embedding array<float>, label int, score double"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = []
    centres = rng.standard_normal((60, 32))
    for k in range(900):
        v = centres[rng.integers(60)] + rng.standard_normal(32) * (0.05 if k % 3 else 0.6)
        rows.append((k, [float(x) for x in v / np.linalg.norm(v)], int(k % 2), 0.0))
    rows += [(1000 + k, rows[k][1], rows[k][2], 0.0) for k in range(0, 40, 2)]
    bad = [(2000, None, 1, 0.0), (2020, [], 1, 0.0), (2040, [float("nan")] * 32, 1, 0.0), (2060, [0.0] * 32, 1, 0.0), (2080, rows[0][1], None, 0.0), (2100, [None] + [1.0] * 31, 0, 0.0)]
    return spark.createDataFrame([(k, v, c, s) for k, v, c, s in rows + bad], VECTORS), rows, bad


def test_topk(spark, vectors):
    table, rows, _ = vectors
    ids = np.array([r[0] for r in rows] + [2060, 2080])
    v = np.floor(64 * np.array([np.float32(r[1]) for r in rows] + [np.zeros(32), np.float32(rows[0][1])], float))
    expected = set()
    for n in np.flatnonzero(ids % 20 == 0):
        score = v @ v[n]
        order = [j for j in np.lexsort((ids, -score)) if j != n][:20]
        expected |= {(int(ids[n]), k + 1, int(ids[j]), int(score[j])) for k, j in enumerate(order)}
    from pyspark.sql import functions as F

    assert {tuple(r) for r in topk.search(table, F.col("vec_id") % 20 == 0).collect()} == expected
    assert topk.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_neardup(vectors):
    table, rows, bad = vectors
    x = np.array([np.float32(r[1]) for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label, ids = np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
    close = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(close, False)
    got = {r["vec_id"]: r for r in neardup.near_duplicates(table).collect()}
    assert len(got) == len(rows) + len(bad)
    found = sum(got[int(i)]["n_links"] for i in ids)
    assert found >= 0.97 * close.sum() and all(got[int(i)]["n_links"] <= n for i, n in zip(ids, close.sum(1), strict=True))
    assert all(got[b[0]]["n_links"] == 0 and got[b[0]]["kept"] for b in bad)
    assert neardup.near_duplicates(table.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 480)]
    parent = list(range(500))

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert all(r["component"] == top(r["v"]) for r in got)


@pytest.mark.parametrize("parts", [None, 4])
def test_ngram_join(docs, none, texts, spark, parts, monkeypatch):
    if parts:  # hot blocks: few sets a part, and no shingle is put last
        monkeypatch.setattr(ngram_join, "TILE", parts)
        monkeypatch.setattr(ngram_join, "MEET", parts)
        monkeypatch.setattr(ngram_join, "_frequent", lambda docs: np.zeros(0, np.uint64))
    rng = random.Random(9)
    base = prose(rng, 120).split()
    more = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(120)] = f"w{rng.randrange(10**6)}"
        more.append((100 + k, " ".join(words), None, None, None, None))
    table = docs.unionByName(spark.createDataFrame(more, DOCS))
    all_texts = dict(enumerate(texts)) | {r[0]: r[1] for r in more}
    sets = {}
    for d, t in all_texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    rows = ngram_join.classes(table).collect()
    assert len(rows) == table.count()
    assert all((r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), top(r["doc_id"])) for r in rows if r["doc_id"] is not None)
    assert ngram_join.classes(none).count() == 0


def test_ngram_join_of_ids_that_repeat_with_other_texts(spark):
    """Classes are those of the rows' texts: a second text under an id neither hides nor joins the first one's links."""
    rng = random.Random(9)
    near = lambda t: " ".join([*t.split()[:-1], "changed"])
    a, b, c = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (1, b), (2, near(b)), (5, c), (3, near(c)), (5, near(a)), (5, ""), (7, "x"), (6, "x"), (1, a)]
    got = Counter(tuple(r) for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect())
    assert got == Counter([(1, 1), (1, 1), (2, 1), (5, 3), (3, 3), (5, 1), (5, 5), (7, 6), (6, 6), (1, 1)])
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, kept)) == sorted([(1, a), (1, b), (3, near(c)), (5, ""), (6, "x")])


def test_parts_of_a_hot_block_meet_once_in_bounded_groups(spark, monkeypatch):
    """Sets outside the largest component meet all others once, those inside it never one another; no group holds the block."""
    monkeypatch.setattr(ngram_join, "MEET", 16)
    sizes = {1: (300, 1), 2: (200, 150), 3: (12, 5)}  # block: (sets, those of the largest component)
    rows = [(b, 1000 * b + k, n, max(inside, 1), 0 if k < inside else 1000 * b + k, 0 if inside > 1 else 1000 * b) for b, (n, inside) in sizes.items() for k in range(n)]
    still = spark.createDataFrame(rows, "block long, rep long, size long, most long, component long, largest long")
    groups: dict[tuple, list] = {}
    for r in ngram_join._meetings(still).collect():
        groups.setdefault((r["block"], r["tile"], r["across"]), []).append(r)
    assert max(map(len, groups.values())) <= 90
    met = Counter()
    for (block, tile, across), members in groups.items():
        for i, x in enumerate(members):
            for y in members[:i]:
                if (tile == across or x["part"] != y["part"]) and x["component"] != y["component"]:
                    met[min(x["rep"], y["rep"]), max(x["rep"], y["rep"])] += 1
                assert block == 3 or x["component"] or y["component"] or x["part"] == y["part"]
    wanted = {(1000 * b + i, 1000 * b + j) for b, (n, inside) in sizes.items() for j in range(n) for i in range(j) if j >= max(inside, 1)}
    assert set(met) == wanted and set(met.values()) == {1}


def test_two_trees_of_unlike_height_find_what_one_finds():
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 2**62, 60, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[:45], rng.integers(0, 2**62, 15, dtype=np.uint64)])) if k % 3 else np.unique(rng.integers(0, 2**62, 50, dtype=np.uint64)) for k in range(330)]
    bits = np.zeros((len(sets), ngram_join.WORDS * 64), bool)
    for k, s in enumerate(sets):
        bits[k, (s % np.uint64(ngram_join.WORDS * 64)).astype(int)] = True
    words, sizes = np.packbits(bits, axis=1).view(np.uint64), np.array([len(s) for s in sets])

    def part(low, high):
        n = high - low
        return ngram_join._Part(pa.RecordBatch.from_arrays(
            [pa.array(np.arange(low, high)), pa.array(sizes[low:high]), pa.array(np.arange(low, high)), pa.array([w.tobytes() for w in words[low:high]], pa.binary()), pa.array([0] * n)],
            names=["rep", "n", "component", "bits", "part"],
        ))

    def pairs(one, two):
        return {tuple(sorted((int(one.rep[a]), int((two or one).rep[b])))) for found in one.links(60, two) for a, b in found.T}

    for cut in (1, 10, 300):
        low, high = part(0, cut), part(cut, len(sets))
        assert pairs(low, None) | pairs(high, None) | pairs(low, high) == pairs(part(0, len(sets)), None)


def test_unlike_blocks_stay(spark):
    """Sums of 48-bit hashes are equal for the first two pairs; the third has the members of the first."""
    from pyspark.sql import functions as F

    pairs = {1: (4718, 10781), 2: (5994, 10595), 3: (10781, 4718)}
    found = spark.createDataFrame([(b, r, 2) for b, pair in pairs.items() for r in pair], "block long, rep long, size long")
    masks = found.groupBy("block").agg(F.sum(F.xxhash64("rep").bitwiseAND(0xFFFFFFFFFFFF)).alias("mark"))
    assert masks.select("mark").distinct().count() == 1
    assert {r["block"] for r in ngram_join._unlike(found).collect()} == {1, 2}


def test_signature_tree_loses_nothing():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**62, 40, dtype=np.uint64)) for _ in range(80)]
    sets += [np.concatenate([s[:36], rng.integers(0, 2**62, 4, dtype=np.uint64)]) for s in sets[:40]]
    bits = np.zeros((len(sets), ngram_join.WORDS * 64), bool)
    for k, s in enumerate(sets):
        bits[k, (s % np.uint64(ngram_join.WORDS * 64)).astype(int)] = True
    words = np.packbits(bits, axis=1).view(np.uint64)
    pairs = {(int(a), int(b)) for x, y in ngram_join._Tree(words, np.array([len(s) for s in sets])).pairs(75) for a, b in zip(x, y, strict=True)}
    assert pairs >= {(k, 80 + k) for k in range(40)} and len(pairs) < 200


def test_parity_sketch_never_overstates_differences():
    rng = np.random.default_rng(4)
    whole = np.unique(rng.integers(0, 1 << 64, 900, np.uint64, endpoint=False))
    for left, right in ((0, 0), (0, 1), (300, 310), (0, 400), (899, 899), (5, 890)):
        a, b = whole[: len(whole) - left], whole[right:]
        apart = ngram_join._differences(*(pa.scalar(ngram_join._parity(s), pa.binary()) for s in (a, b)))
        assert apart <= len(np.setxor1d(a, b))
    other = np.unique(rng.integers(0, 1 << 64, 900, np.uint64, endpoint=False))
    unlike = ngram_join._differences(*(pa.scalar(ngram_join._parity(s), pa.binary()) for s in (whole, other)))
    assert (100 + 75) * unlike > (100 - 75) * (len(whole) + len(other))


@pytest.mark.parametrize(("limit", "slice_bytes"), [(256, 1 << 19), (1, 1 << 19), (256, 700)])
def test_suffix(docs, none, texts, limit, slice_bytes, monkeypatch):
    """A small limit counts all strings of shared contexts as rows; small slices cut long texts into windows."""
    monkeypatch.setattr(suffix, "OPEN_LIMIT", limit)
    monkeypatch.setattr(bytescan, "SLICE_BYTES", slice_bytes)
    stored = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    seen = Counter(t[i : i + 400] for _, t in stored for i in range(len(t) - 399))
    expected = Counter()
    for d, t in stored:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        expected[d, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(tuple(r) for r in suffix.removed(docs).collect()) == expected
    if limit > 1:
        out = suffix.dedup(docs)
        assert out.columns == docs.columns and out.count() == docs.count()
        assert suffix.removed(none).count() == 0


@pytest.mark.parametrize("slice_bytes", [1 << 19, 700])
def test_suffix_reports_passages_of_few_bytes(spark, slice_bytes, monkeypatch):
    """Passages of 51 words have under 400 bytes, so nothing goes; they are counted. Shared runs of fewer than 32 words are not, nor are
    those that repeat in one text only."""
    monkeypatch.setattr(bytescan, "SLICE_BYTES", slice_bytes)
    rng = random.Random(3)
    words = lambda n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8))) for _ in range(n)]
    texts, shared = [], set()
    for k in range(120):
        passage = words(51 if k % 3 == 0 else 31 if k % 3 == 1 else 40)
        for _ in range(2):
            own = [*words(rng.randint(0, 90)), *passage, *words(rng.randint(0, 90))] if k % 3 < 2 else [*words(9), *passage, *words(60), *passage]
            shared.update([len(texts)] if k % 3 == 0 else [])
            texts.append(" ".join(own))
            passage = words(40) if k % 3 == 2 else passage
    texts += [None, "", "one word", " ".join(words(32)), *[" ".join(words(400))] * 2]
    shared.update([len(texts) - 1, len(texts) - 2])
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string")
    rows = suffix.reported(docs).collect()
    assert {r["doc_id"] for r in rows if r["n_passages"] > 0} == shared | {None} and len(rows) == len(texts) + 1
    small = [r for r in rows if r["doc_id"] is not None and 0 < r["doc_id"] < 240 and r["doc_id"] in shared]
    assert len(small) == 79 and all(r["n_removed"] == 0 for r in small)
    want = Counter(tuple(r) for r in suffix.removed(docs).collect())
    assert Counter(tuple(r)[:5] for r in rows) == want and suffix.reported(docs.limit(0)).count() == 0


def test_windows_of_a_long_text_and_whole_slices_agree():
    """Strings of a text cut into windows are those of the same text in one piece, and every string is in one phrase."""
    rng = np.random.default_rng(6)
    text = rng.integers(97, 100, 9000, np.uint8)
    text[5000:8000] = text[1000:4000]
    whole = suffix.phrases(text, np.array([0, 9000]), 400, 32, 0, 9000)
    before = bytescan.SLICE_BYTES
    bytescan.SLICE_BYTES = 1000
    try:
        parts = [(low, suffix.phrases(d, o, 400, 32, a, b)) for d, o, low, a, b in suffix._windows(text, np.array([0, 9000]), 400)]
    finally:
        bytescan.SLICE_BYTES = before
    listed = lambda low, p: [(int(low + lo + k), int(low + lo + at), int(h), int(t)) for lo, n, at, h, t in zip(p["lo"], p["n"], p["at"], p["head"], p["tail"], strict=True) for k in range(n)]
    strings = sorted(x for low, p in parts for x in listed(low, p))
    assert strings == sorted(listed(0, whole)) and [s[0] for s in strings] == list(range(8601)) and len(parts) == 9


def test_suffix_of_a_text_of_twenty_megabytes(spark):
    """Two long texts that share their middle: it goes from both, nothing else does."""
    rng = np.random.default_rng(8)
    letters = lambda n: rng.integers(97, 123, n, np.uint8).tobytes().decode()
    middle = letters(3_000_000)
    texts = [letters(9_000_000) + middle + letters(8_000_000), letters(1000) + middle]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix.removed(docs).collect()}
    for k, t in enumerate(texts):
        kept = hashlib.sha256(t.replace(middle, "").encode()).hexdigest()
        assert (got[k]["n_removed"], got[k]["n_spans"], got[k]["kept_sha256"]) == (3_000_000, 1, kept)


def test_span_hashes_do_not_depend_on_slices(monkeypatch):
    data = np.random.default_rng(1).integers(0, 3, 5000, np.uint8)
    starts = np.arange(0, 4990, 7)
    ends = starts + np.arange(len(starts)) % 7
    ends[100] = starts[100] + 6
    whole = bytescan.Substrings(data).hashes(starts, ends)
    monkeypatch.setattr(bytescan, "SLICE_BYTES", 64)
    assert (bytescan.span_hashes(data, starts, ends) == whole).all()


def test_suffix_numbers_rows_once(spark, docs, monkeypatch):
    """Every job after a stored frame cuts its scan otherwise, as when an executor was lost or has joined."""
    order = lambda rows: sorted(map(str, rows))
    digests, texts = order(suffix.removed(docs).collect()), order(suffix.dedup(docs).collect())
    keep, turns = suffix.Workspace.keep, []

    def cut_anew(self, *args, **named):
        out = keep(self, *args, **named)
        turns.append(spark.conf.set("spark.sql.files.maxPartitionBytes", ("1k", "64m")[len(turns) % 2]))
        return out

    monkeypatch.setattr(suffix.Workspace, "keep", cut_anew)
    try:
        assert order(suffix.removed(docs).collect()) == digests and order(suffix.dedup(docs).collect()) == texts
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(turns) > 10


def test_sentencepieces(docs, none, texts):
    encoded = sentencepieces.encode(docs)
    back = {r["doc_id"]: r["text"] for r in sentencepieces.decode(encoded).collect()}
    assert all(back[k] == (t or "") for k, t in enumerate(texts))
    assert all(r["round_trip"] for r in sentencepieces.digest(docs).collect())
    assert sentencepieces.digest(none).count() == 0
    v = sentencepieces.pieces(packing.vocabulary_path(sentencepieces.MODEL))
    score = {v.bytes[k]: s for k, s in zip(v._key_ids.tolist(), v._scores.tolist(), strict=True)}
    for t in ("hello wörld", "  two  spaces", "日本☃"):
        b = (" " + t).encode()
        best = [0.0] + [-np.inf] * len(b)
        for end in range(1, len(b) + 1):
            best[end] = max([best[end - 1] + v._byte_score] + [best[s] + score[b[s:end]] for s in range(end) if b[s:end] in score])
        ids = next(v.encode(pa.array([t])))[1]
        assert abs(sum(score.get(v.bytes[i], v._byte_score) if i not in set(v._byte_ids.tolist()) else v._byte_score for i in ids.tolist()) - best[-1]) < 1e-6


def test_runs_cross_batches():
    batches = [pa.RecordBatch.from_pydict({"k": k}) for k in ([1, 1, 2], [2], [], [2, 3])]
    assert [r.column("k").to_pylist() for r in bytescan.runs(iter(batches), ["k"])] == [[1, 1], [2, 2, 2], [3]]


def test_stages_keep_columns(spark, docs, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, rows, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        rows = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert rows.columns == docs.columns
    ids = [r["doc_id"] for r in rows.collect()]
    assert len(ids) == len(set(ids)) and 11 not in ids and 10 in ids and None in ids


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_pii_trees_see_every_candidate(spark):
    """A fit counts the candidates of all documents, not of the 5,000 it once looked at, and grows the tree that one array of all would give."""
    rng = random.Random(5)
    rows = [(k, f"order 0{k % 10}{k:07d} of page", "en", "s", 1, 1) for k in range(5600)]
    docs = spark.createDataFrame(rows, DOCS)
    shapes = pii._shapes(docs)
    assert shapes.selectExpr("cast(sum(n) AS long)").first()[0] == 5600
    x = np.round(np.array([[rng.random() for _ in pii.FEATURES] for _ in range(400)]), 2)
    y = ((x[:, 1] > 0.5) & (x[:, 2] < 0.7)).astype(float)
    p = 0.3
    frame = spark.createDataFrame([(*map(float, r), float(v), 1.0, float(np.log(p / (1 - p)))) for r, v in zip(x, y)], [*pii.FEATURES, "y", "n", "score"])
    same = pii._tree(x, y - p, np.full(400, p * (1 - p)), pii.DEPTH)
    assert np.allclose(pii._value(pii._grown(frame), x), pii._value(same, x))


def test_strings_of_a_hot_context_take_little_memory():
    """Arrays of the work on strings are as long as a piece of a context's phrases, not as all of them."""
    rng = random.Random(5)
    base = bytes(rng.choices(range(97, 123), k=700))
    parts = [base[:350] + bytes(rng.choices(range(97, 123), k=8)) + base[358:] for _ in range(3000)]
    parts += [parts[7][1:], parts[9][2:]]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(parts)), pa.array(range(len(parts))), pa.array([50] * len(parts)), pa.array(parts, pa.binary())], names=["context", "rid", "lo", "bytes"])
    tracemalloc.start()
    got = [r for b in suffix._opened(iter([batch]), 400) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    strings = sum(len(p) - 399 for p in parts)
    assert peak < 80 * strings, (peak, strings)
    places = defaultdict(list)
    for k, p in enumerate(parts):
        for a in range(len(p) - 399):
            places[p[a : a + 400]].append((k, 50 + a))
    want = {x for found in places.values() if len(found) > 1 for x in found}
    assert {(r["rid"], a) for r in got for a in range(r["a"], r["b"] - 399)} == want and len(want) > 600


def test_wide_workspaces_send_small_batches(spark, monkeypatch):
    """Whole texts go to workers in small batches while frames are stored, and the session's settings are as before."""
    count = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)
    rows = spark.range(9000, numPartitions=1).mapInArrow(count, "n long")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    assert [r["n"] for r in Workspace(spark, "plain").keep(rows, "a").collect()] == [9000]
    assert max(r["n"] for r in Workspace(spark, "wide", wide=True).keep(rows, "a").collect()) == 2000
    assert spark.conf.get(key) == before and spark.conf.get(key, None) is None
    spark.conf.set(key, 500)
    try:
        assert max(r["n"] for r in Workspace(spark, "own", wide=True).keep(rows, "a").collect()) == 500
        assert spark.conf.get(key) == "500"
    finally:
        spark.conf.unset(key)
    made = []
    monkeypatch.setattr(suffix, "Workspace", lambda *a, **k: made.append(Workspace(*a, **k)) or made[-1])
    wide = "x" * 3000
    big = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit(wide).alias("text"))
    seen = big.mapInArrow(count, "n long")
    assert max(r["n"] for r in Workspace(spark, "bytes", wide=True).keep(seen, "a").collect()) * len(wide) < 2 * (4 << 20)
    assert suffix.removed(big.limit(3)).count() == 3 and all(w.wide for w in made) and made
