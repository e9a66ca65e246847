"""Personal data: base formats, then boosted trees over high-recall candidates; SQL functions only.

Base spans are the four fixed formats with their validity tests. Beyond them, loose generators propose
overlapping candidates (long digit groups, key-like tokens, spelled-out addresses). A candidate that overlaps no
base span is added if it has evidence of its own, or if gradient-boosted trees score its shape (length, share of
digits, separators, neighbours, ...) at or above the threshold of its kind. Evidence is what such candidates can have:
a cue word before them (phone, account, token = ...), a telling format (3-3-4 or 3-2-4 digits, four groups of
four that pass the Luhn test), an address with [at] spelled out. The trees are nested CASE expressions, so scoring
stays in the same projection: one row in, one row out, no shuffle.

Fitting uses the candidates of all documents; those that overlap a base span or have a telling format are decided
without trees and left out. Candidates with the same features are counted as one row, stored once. A level of a tree is
one aggregate over these rows: sums per node, feature and value, of which there are as many as lengths and shares can
differ, whatever the number of documents. Only these sums, the scores' counts in steps of 1 / STEPS and the trees are on the
driver. No table holds labels for personal data, so the label is a cue word, and no feature shows it.
Trees are fitted on two thirds of the candidates. Candidates without a cue are unlabelled, not negative: on the other
third the rate of cues at a score, over the mean of that rate where there is a cue, is the chance that a candidate
of this score is personal. Each kind gets the lowest threshold at which the mean of these chances is PRECISION or
more, or none, in which case only evidence selects. This takes cues to be as common in all shapes of a kind's
personal data that evidence does not settle.

Nulls: a NULL text is empty. A NULL doc_id is kept. Repeated rows each give a row, an empty table none (with
no candidates to fit on, only base spans and evidence are reported). Only doc_id and text are read by `find`; `redact`
changes text and n_chars and passes all other columns through.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Workspace
from tallyloom.llm.native import found, no_spans
from tallyloom.operators.joins import computed_once

PRECISION = 0.98
ROUNDS, DEPTH, RATE = 20, 3, 0.3
#: Standard errors by which rates of cues must differ to count as different.
APART = 2.5
#: Scores are told apart in steps of 1 / STEPS where thresholds are set.
STEPS = 1024

# Fixed values of the contract: kinds in order, and their formats. Possessive forms of the given patterns; an
# e-mail or address can only start where a run of its characters starts, or where the last match ended.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What the method adds: (kind, generator, cheap test that a text can hold a match).
GENERATORS = (
    ("number", r"(?:(?<![0-9])|\G)\(?[0-9][0-9\x20()./:-]{6,40}[0-9]", r"[0-9][0-9\x20()./:-]{6}"),
    ("secret", r"(?:(?<![A-Za-z0-9_/+-])|\G)(?=[A-Za-z_/+-]{0,40}[0-9])[A-Za-z0-9_/+-]{20,200}+", r"[A-Za-z0-9_/+-]{20}"),
    ("address", r"[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\)|@)\x20?[A-Za-z0-9-]{1,64}+(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]{2,24}+){1,4}+", r"\[at\]|\(at\)|@"),
)
ADDED = tuple(kind for kind, _, _ in GENERATORS)
#: Evidence. Words before an assigned secret, and before numbers that identify someone; telling formats; what is a date or time.
ASSIGNED = r"(?i)(?:token|key|secret|password|passwd|pwd)\s*[=:]\s*[\"']?$"
PERSONAL = r"(?i)\b(?:(?:tele)?phone|tel|call|fax|card|account|ssn|iban|mail|contact)(?:\x20(?:no|nr|number))?\W{0,3}$"
GROUPS_334, GROUPS_324 = r"^(?:1[ .-])?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
CARD_GROUPS = r"^[0-9]{4}([ ./-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"
MOMENT = r":|(?<![0-9])[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}(?![0-9])|(?<![0-9])[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}(?![0-9])"
AT, DOT = r"\x20?(?:\[at\]|\(at\))\x20?", r"\x20?(?:\[dot\]|\(dot\))\x20?"
SPELLED = r"(?:\[at\]|\(at\)).*(?:\[dot\]|\(dot\))|\[at\]\x20?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"


def _base(kind: str) -> Column:
    """Valid spans of one kind, or none where a plain test shows that there cannot be any."""
    text = F.col("text")
    test = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}[kind]
    spans = F.coalesce(F.when(test, found(text, PATTERNS[kind])), no_spans())
    digits = lambda s: F.regexp_replace(s["value"], "[^0-9]", "")
    if kind == "ip":
        part = "0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]|(?<=0))"
        return F.filter(spans, lambda s: s["value"].rlike(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        return F.filter(spans, lambda s: F.length(digits(s)).between(12, 19) & luhn(digits(s)))
    if kind == "phone":
        return F.filter(spans, lambda s: F.length(digits(s)).between(9, 15))
    return spans


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test; false for none."""
    turned = F.split(F.reverse(digits), "")
    doubled = F.transform(turned, lambda d, i: F.when(i % 2 == 1, d.try_cast("int") * 2 - F.when(d.try_cast("int") > 4, 9).otherwise(0)).otherwise(d.try_cast("int")))
    total = F.aggregate(F.filter(doubled, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x)
    return (F.length(digits) > 0) & (total % 10 == 0)


_SPAN = "array<struct<start:int,no:int,end:int,kind:string>>"


def _ordered(kinds: dict[str, Column], order: tuple[str, ...]) -> Column:
    """All spans as (start, no, end, kind), by start, then kind as listed."""

    def as_kind(k: str, spans_: Column) -> Column:
        made = F.transform(spans_, lambda s: F.struct(s["start"].alias("start"), F.lit(order.index(k)).alias("no"), s["end"].alias("end"), F.lit(k).alias("kind")))
        return made.cast(_SPAN)

    return F.array_sort(F.concat(*[as_kind(k, c) for k, c in kinds.items()]))


def with_base(docs: DataFrame) -> DataFrame:
    """Every row with `base`: valid base spans in order; text NULLs become empty."""
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return computed_once(rows, base=_ordered({k: _base(k) for k in KINDS}, KINDS))


def _share(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]", "")).cast("double")


def _before(text: Column, start: Column) -> Column:
    return F.substring(text, F.greatest(start - 24, F.lit(0)) + 1, F.least(start, F.lit(24)))


def _cued(text: Column, kind: str, span: Column) -> Column:
    """Whether a word before a candidate says that it is personal; also the label that trees learn."""
    value, before = span["value"], _before(text, span["start"])
    if kind == "secret":
        return before.rlike(ASSIGNED)
    if kind == "address":
        return before.rlike(PERSONAL)
    return before.rlike(PERSONAL) & F.length(F.regexp_replace(value, "[^0-9]", "")).between(7, 19) & ~value.rlike(MOMENT)


def _telling(kind: str, span: Column) -> Column:
    """Whether a candidate's format alone says that it is personal."""
    value = span["value"]
    if kind == "secret":
        return F.lit(False)
    if kind == "address":
        return value.rlike(SPELLED)
    return value.rlike(GROUPS_334) | value.rlike(GROUPS_324) | (value.rlike(CARD_GROUPS) & luhn(F.regexp_replace(value, "[^0-9]", "")))


def _features(text: Column, kind_no: int, span: Column) -> dict[str, Column]:
    """What trees see: nothing of the evidence; a spelled-out address counts as if it had its signs."""
    value, start = span["value"], span["start"]
    if ADDED[kind_no] == "address":
        value = F.regexp_replace(F.regexp_replace(value, AT, "@"), DOT, ".")
    before = _before(text, start)
    after = F.substring(text, span["end"] + 1, F.lit(2))
    size = F.greatest(F.length(value), F.lit(1)).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        "generator": F.lit(float(kind_no)),
        "size": size,
        "digits": _share(value, "0-9"),
        "digit_share": _share(value, "0-9") / size,
        "hex_share": _share(value, "0-9a-f") / size,
        "upper_share": _share(value, "A-Z") / size,
        "spaces": _share(value, r"\x20"),
        "dots": _share(value, "."),
        "dashes": _share(value, "-"),
        "slashes": _share(value, "/:"),
        "brackets": _share(value, "()"),
        "quads": flag(value.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")),
        "after_plus": flag(before.rlike(r"\+[0-9 (]{0,6}$")),
        "after_letter": flag(before.rlike(r"\p{L}$")),
        "before_letter": flag(after.rlike(r"^\p{L}")),
        "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
    }


FEATURES = (
    "generator", "size", "digits", "digit_share", "hex_share", "upper_share", "spaces", "dots", "dashes", "slashes", "brackets", "quads",
    "after_plus", "after_letter", "before_letter", "quoted",
)


def with_candidates(rows: DataFrame) -> DataFrame:
    """Rows of `with_base` with `candidates`: (start, end, kind, known, cued, telling, x: features)."""
    text = F.col("text")

    def described(no: int, kind: str, pattern: str, test: str) -> Column:
        spans_ = F.coalesce(F.when(text.rlike(test), found(text, pattern)), no_spans())
        return F.transform(spans_, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"),
            F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])).alias("known"),
            F.coalesce(_cued(text, kind, s), F.lit(False)).alias("cued"), F.coalesce(_telling(kind, s), F.lit(False)).alias("telling"),
            F.struct(*[c.alias(n) for n, c in _features(text, no, s).items()]).alias("x")))

    return computed_once(rows, candidates=F.concat(*[described(no, *g) for no, g in enumerate(GENERATORS)]))


def _cuts(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ten quantiles of values in order that occur `sizes` times, interpolated as np.quantile does."""
    ends = np.cumsum(sizes)
    at = (ends[-1] - 1) * np.linspace(0.05, 0.95, 10)
    low = np.floor(at)
    below, above = (values[np.searchsorted(ends, k, side="right")] for k in (low, np.minimum(low + 1, ends[-1] - 1)))
    return np.unique(below + (above - below) * (at - low))


def _split(sums: dict[int, np.ndarray]):
    """The best split of a node as (feature, cut, sums left, sums right), or None. `sums` has, per feature, a row of value, number of
    candidates, first and second derivatives for each of its values, in order."""
    best, choice = None, None
    for f, table in sorted(sums.items()):
        total = table[:, 1:].sum(axis=0)
        if best is None:
            best = total[1] ** 2 / (total[2] + 1.0) + 1e-6
        upto = np.cumsum(table[:, 1:], axis=0)
        for cut in _cuts(table[:, 0], table[:, 1]):
            k = int(np.searchsorted(table[:, 0], cut, side="right"))
            if k in (0, len(table)):
                continue
            left, right = upto[k - 1], total - upto[k - 1]
            gain = left[1] ** 2 / (left[2] + 1.0) + right[1] ** 2 / (right[2] + 1.0)
            if gain > best:
                best, choice = gain, (f, float(cut), left, right)
    return choice


def _leaf(sums: np.ndarray) -> float:
    return float(sums[1] / (sums[2] + 1.0))


def _tree(x: np.ndarray, slope: np.ndarray, weight: np.ndarray, depth: int):
    """A regression tree on first and second derivatives: a leaf value, or (feature, cut, left, right)."""
    leaf = _leaf(np.array([len(x), slope.sum(), weight.sum()]))
    if depth == 0 or len(x) < 20:
        return leaf
    sums = {}
    for f in range(x.shape[1]):
        values, group = np.unique(x[:, f], return_inverse=True)
        sums[f] = np.column_stack([values, *[np.bincount(group, w) for w in (np.ones(len(x)), slope, weight)]])
    choice = _split(sums)
    if choice is None:
        return leaf
    f, cut, *_ = choice
    left = x[:, f] <= cut
    return f, cut, _tree(x[left], slope[left], weight[left], depth - 1), _tree(x[~left], slope[~left], weight[~left], depth - 1)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    return np.where(x[:, f] <= cut, _value(low, x), _value(high, x))


def boosted(x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    """Start value and trees for the log-odds of y."""
    share = min(max(float(y.mean()), 0.01), 0.99)
    start = float(np.log(share / (1 - share)))
    score, trees = np.full(len(y), start), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        tree = _tree(x, y - p, p * (1 - p), DEPTH)
        trees.append(tree)
        score = score + RATE * _value(tree, x)
    return start, trees


def _rates(hits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rates of groups in order, never rising: neighbours are pooled until each rate is clearly below the one before."""
    hits, sizes = hits.astype(float).tolist(), sizes.astype(float).tolist()
    pooled = [1] * len(hits)
    while len(hits) > 1:
        h, n = np.array(hits), np.array(sizes)
        rate, both = h / n, (h[1:] + h[:-1]) / (n[1:] + n[:-1])
        apart = (rate[:-1] - rate[1:]) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n[1:] + 1 / n[:-1]))
        k = int(np.argmin(apart))
        if apart[k] >= APART:
            break
        for part in (hits, sizes, pooled):
            part[k] += part.pop(k + 1)
    return np.repeat(np.array(hits) / np.array(sizes), pooled)


def _chances(hits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """`chances` of groups of equal score, given their cues and sizes."""
    if not hits.any():
        return np.zeros(len(hits))
    rate = _rates(hits, sizes)
    return np.minimum(1.0, rate / np.average(rate, weights=hits))


def chances(score: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The chance of each candidate, by falling score, to be personal, if cues y stand at a fixed share of those."""
    first = np.append(0, np.flatnonzero(np.diff(score)) + 1)
    sizes = np.diff(np.append(first, len(score)))
    return np.repeat(_chances(np.add.reduceat(y, first), sizes), sizes)


def _case(tree, x: dict[str, Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, cut, low, high = tree
    return F.when(x[FEATURES[f]] <= cut, _case(low, x)).otherwise(_case(high, x))


class Model:
    """Trees and one threshold per added kind (None: the kind is never selected)."""

    def __init__(self, start: float = 0.0, trees: list | None = None, thresholds: dict[str, float] | None = None):
        self.start, self.trees, self.thresholds = start, trees or [], thresholds or {}

    def score(self, x: Column) -> Column:
        return reduce(lambda a, t: a + F.lit(RATE) * _case(t, x), self.trees, F.lit(self.start))

    def selects(self, c: Column) -> Column:
        if not self.trees or not self.thresholds:
            return F.lit(False)
        limit = reduce(lambda e, kv: F.when(c["kind"] == kv[0], F.lit(kv[1])).otherwise(e), self.thresholds.items(), F.lit(None).cast("double"))
        return F.coalesce(self.score(c["x"]) >= limit, F.lit(False))


def _shapes(docs: DataFrame) -> DataFrame:
    """The candidates that trees decide, counted by features, cue and whether they are held back: n of each."""
    rows = with_candidates(with_base(docs.select("doc_id", "text"))).select("doc_id", F.inline("candidates")).where("NOT known AND NOT telling")
    held = F.pmod(F.xxhash64("doc_id", "start", "kind"), F.lit(3)) == 0
    return rows.groupBy(held.alias("held"), F.col("cued").cast("double").alias("y"), *[F.col("x")[n].alias(n) for n in FEATURES]).agg(F.count("*").cast("double").alias("n"))


def _grown(rows: DataFrame):
    """One tree on scored shapes, `_tree` level by level: (feature, cut, left, right) or a leaf value."""
    x = {n: F.col(n) for n in FEATURES}
    p = 1 / (1 + F.exp(-F.col("score")))
    derived = rows.select(*FEATURES, "n", (F.col("n") * (F.col("y") - p)).alias("slope"), (F.col("n") * p * (1 - p)).alias("weight"))
    nodes: dict[int, object] = {}  # by heap number: a leaf value, or (feature, cut)
    open_nodes, leaves = [1], {}

    def tree(k: int, end):
        node = nodes.get(k)
        return (*node, tree(2 * k, end), tree(2 * k + 1, end)) if isinstance(node, tuple) else end(k)

    for _ in range(DEPTH):
        at = _case(tree(1, float), x).cast("int")
        values = derived.select(at.alias("node"), "n", "slope", "weight", F.posexplode(F.array(*FEATURES)).alias("f", "value")).where(F.col("node").isin(open_nodes))
        sums = values.groupBy("node", "f", "value").agg(F.sum("n"), F.sum("slope"), F.sum("weight")).collect()
        table = np.array([tuple(r) for r in sums], float).reshape(-1, 6)
        table = table[np.lexsort((table[:, 2], table[:, 1], table[:, 0]))]
        grown = []
        for k in open_nodes:
            own = table[table[:, 0] == k]
            by_feature = {f: own[own[:, 1] == f][:, 2:] for f in range(len(FEATURES))}
            total = by_feature[0][:, 1:].sum(axis=0)
            leaves.setdefault(k, _leaf(total))
            choice = _split(by_feature) if total[0] >= 20 else None
            if choice is not None:
                f, cut, left, right = choice
                nodes[k] = (f, cut)
                leaves |= {2 * k: _leaf(left), 2 * k + 1: _leaf(right)}
                grown += [2 * k, 2 * k + 1]
        open_nodes = grown
        if not open_nodes:
            break
    return tree(1, leaves.__getitem__)


def _boosted(work: Workspace, shapes: DataFrame, share: float) -> tuple[float, list, DataFrame]:
    """`boosted` on the shapes that are not held back: start value, trees, and all shapes with their score."""
    share = min(max(share, 0.01), 0.99)
    start = float(np.log(share / (1 - share)))
    scored, trees = shapes.withColumn("score", F.lit(start)), []
    for k in range(ROUNDS):
        trees.append(_grown(scored.where("NOT held")))
        after = scored.withColumn("score", F.col("score") + F.lit(RATE) * _case(trees[-1], {n: F.col(n) for n in FEATURES}))
        after.write.parquet(work.path(f"scored-{k}"))
        scored = work.spark.read.schema(after.schema).parquet(work.path(f"scored-{k}"))
        work.drop(f"scored-{k - 1}")
    return start, trees, scored


def fit(docs: DataFrame) -> Model:
    """Fit on the candidates of all documents, as described above."""
    work = Workspace(docs.sparkSession, "pii-fit")
    shapes = work.keep(_shapes(docs), "shapes")
    counted = {r["held"]: r for r in shapes.groupBy("held").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("cues")).collect()}
    if sum(r["n"] for r in counted.values()) < 60 or False not in counted:
        work.drop("")
        return Model()
    start, trees, scored = _boosted(work, shapes, counted[False]["cues"] / counted[False]["n"])
    step = F.floor(F.col("score") * STEPS)
    found_ = scored.where("held").groupBy("generator", step.alias("step")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("cues")).collect()
    work.drop("")
    thresholds = {}
    for no, kind in enumerate(ADDED):
        own = sorted((r for r in found_ if r["generator"] == no), key=lambda r: -r["step"])
        if not own:
            continue
        sizes, hits = np.array([r["n"] for r in own]), np.array([r["cues"] for r in own])
        precise = np.flatnonzero(np.cumsum(_chances(hits, sizes) * sizes) / np.cumsum(sizes) >= PRECISION)
        if len(precise) and np.cumsum(hits)[precise[-1]] >= 5:
            thresholds[kind] = own[precise[-1]]["step"] / STEPS
    return Model(start, trees, thresholds)


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """Every row with `base` and `spans`: base spans, and candidates with evidence or selected by their shape that overlap none of them."""
    rows = with_candidates(with_base(docs))
    chosen = lambda kind: F.filter("candidates", lambda c: (c["kind"] == kind) & ~c["known"] & (c["cued"] | c["telling"] | model.selects(c)))
    added = _ordered({kind: chosen(kind) for kind in ADDED}, (*KINDS, *ADDED))
    return computed_once(rows, spans=F.array_sort(F.concat("base", added))).drop("candidates")


def _text(spans_: str) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Counts, a digest of the base spans, and all spans, one row per document row."""
    rows = spans(docs.select("doc_id", "text"), model or fit(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(_text("base"), 256).alias("base_sha256"), _text("spans").alias("spans"))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The same rows with every span replaced by its kind in brackets; overlapping spans become one."""
    rows = spans(docs.withColumns({"_row_text": F.col("text")}), model or fit(docs))
    kind = "array<struct<start:int,no:int,end:int,kind:string>>"
    last = lambda a: F.element_at(a, -1)
    merged = F.aggregate(
        "spans",
        F.array().cast(kind),
        lambda a, s: F.when((F.size(a) > 0) & (s["start"] < last(a)["end"]), F.concat(
            F.slice(a, 1, F.size(a) - 1),
            F.array(F.struct(last(a)["start"].alias("start"), last(a)["no"].alias("no"), F.greatest(last(a)["end"], s["end"]).alias("end"), last(a)["kind"].alias("kind"))),
        )).otherwise(F.concat(a, F.array(s))),
    )
    rows = computed_once(rows, merged=merged)
    before = lambda i: F.coalesce(F.get("merged", i - 1)["end"], F.lit(0))
    parts = F.transform("merged", lambda s, i: F.concat(F.substring("text", before(i) + 1, s["start"] - before(i)), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    tail = F.substring("text", before(F.size("merged")) + 1, F.length("text"))
    clean = F.when(F.size("merged") > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(F.col("_row_text"))
    out = rows.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("merged") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
