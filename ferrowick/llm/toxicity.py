"""Operator 5: toxicity, a counterfactual-regularised linear classifier.

A document's features are its distinct words and word beginnings, hashed. The labelled sample is
bounded (``max_train``, one row for each id); its features are counted in Spark, and the model's size is a parameter as its
sample's: of the features of at least ``min_count`` texts, those ``max_features`` reach the driver that tell the classes apart
best (of equal ones the lower hash). It fits a logistic model on about four fifths of the sample, chosen by the ids' hash, and sets the
threshold on the rest. For each labelled text that names a group of
people, the same text with the terms swapped for others of their kind is added and the squared
change of the score is penalised, so that a mention as such says nothing.

Defined results: a null or empty text scores as the bias alone; a text of any length is scored whole, in pieces of
whole texts of about a megabyte together; a score equal to the threshold is toxic; of several texts of a labelled id the least teaches, of several labels the largest; rows with a null id are scored like
others; repeated rows are each scored; without labels, or with one class only, every score is 0.0 or the
class's share and nothing is flagged unless every label is toxic; an empty table gives an empty result.
Further columns are ignored; the result has the id, ``toxicity`` and ``is_toxic``, or for
``without_toxic`` the input's columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrowick.llm import _text as tx
from ferrowick.llm._session import hash_share, labelled

BITS = 20
PREFIXES = (4, 5, 6)
#: Kinds of group terms; a term is swapped for the others of its tuple.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual"), ("transgender", "cisgender"), ("immigrants", "natives", "refugees"), ("old", "young"), ("disabled", "abled"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("noirs", "blancs"), ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("negros", "blancos"),
)
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


@dataclass
class ToxicityModel:
    """Weights by hashed feature, and the score from which a document is toxic."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    bias: float = -50.0
    threshold: float = 0.5

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        known = self.weights != 0
        for first, end, data, offsets in tx.chunks(texts):
            rows, features = _features(data, offsets, known)
            np.add.at(out, rows + first, self.weights[features])
            del end
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def _features(data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hashed feature) pairs, of the known features only if these are given."""
    starts, ends, rows = tx.words(data, offsets, _WORD)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = tx.window_hashes(data, lower=True)
    found = []
    for n in (None, *PREFIXES):
        pick = slice(None) if n is None else np.flatnonzero(ends - starts >= n)
        h = hashes(starts[pick], ends[pick] if n is None else starts[pick] + n) ^ np.uint64(0 if n is None else 0x9E3779B97F4A7C15 * n & (1 << 64) - 1)
        bucket = (h >> np.uint64(64 - BITS)).astype(np.int64)
        at = rows[pick]
        if known is not None:
            hit = known[bucket]
            bucket, at = bucket[hit], at[hit]
        found.append((at << BITS) | bucket)
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def swap_terms(text: str, step: int = 1, kinds: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> str:
    """The text with every group term replaced by the one ``step`` further in its kind, or the text itself."""
    other = {term: kind[(i + step) % len(kind)] for kind in kinds for i, term in enumerate(kind)}
    return re.sub(r"\w+", lambda m: other.get(m[0].lower(), m[0]), text)


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, np.ndarray] = {c: np.zeros(1 << BITS, np.int32) for c in (0, 1)}
    for b in batches:
        label = b.column(1).to_numpy(zero_copy_only=False) > 0
        for first, _, data, offsets in tx.chunks(b.column(0)):
            rows, features = _features(data, offsets)
            toxic = label[rows + first]
            for c in (0, 1):
                counts[c] += np.bincount(features[toxic == bool(c)], minlength=1 << BITS).astype(np.int32)
    at = np.flatnonzero(counts[0] + counts[1])
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0][at].astype(np.int64)), pa.array(counts[1][at].astype(np.int64))], ["f", "n0", "n1"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = 20_000, max_features: int = 4096, min_count: int = 5, l2: float = 1e-3, counterfactual: float = 1.0, kinds: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> ToxicityModel:
    """Fit on at most ``max_train`` labelled documents. ``counterfactual`` weighs the penalty on changes of the score under a swap of group terms."""
    sample = labelled(docs, labels, id_col, text_col, label_col, max_train)
    sizes = dict(sample.groupBy("fw_label").count().collect())
    n0, n1 = sizes.get(0, 0), sum(n for c, n in sizes.items() if c > 0)
    if not n0 or not n1:
        return ToxicityModel(bias=50.0 if n1 else -50.0)
    counts = sample.select("fw_text", "fw_label").mapInArrow(_class_counts, "f int, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n, a, b = float(n0 + n1), F.col("n1"), F.col("n0")
    # Pearson's statistic of feature against class
    chi = F.pow(a * F.lit(float(n0)) - b * F.lit(float(n1)), 2) * n / (F.lit(float(n0) * n1) * (a + b) * (F.lit(n) - a - b + 0.5))
    names = [r.f for r in counts.where(a + b >= min_count).orderBy(chi.desc(), "f").limit(max_features).select("f").collect()]
    known = np.zeros(1 << BITS, np.int32) - 1
    known[names] = np.arange(len(names))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            versions = [list(dict.fromkeys([t := text or "", *(swap_terms(t, step, kinds) for step in (1, 2))])) for text in b.column(0).to_pylist()]
            parts: list[list[int]] = []
            for first, end, data, offsets in tx.chunks(pa.array([x for v in versions for x in v], pa.string())):
                rows, features = _features(data, offsets, known >= 0)
                cut = np.searchsorted(rows, np.arange(end - first + 1))
                parts += [known[features[cut[r] : cut[r + 1]]].tolist() for r in range(end - first)]
            each = iter(parts)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([[next(each) for _ in v] for v in versions], pa.list_(pa.list_(pa.int32())))], ["y", "held", "x"])

    rows = sample.select("fw_text", "fw_label", hash_share("fw_id", 0.2, 7).alias("held")).mapInArrow(rows_of, "y int, held boolean, x array<array<int>>").toArrow()  # at most max_train rows
    return _fit(rows.column("y").to_numpy() > 0, rows.column("held").to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0, bool), rows.column("x").to_pylist(), np.array(names, np.int64), l2, counterfactual)


def _sparse(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.repeat(np.arange(len(lists)), sizes), np.fromiter((f for x in lists for f in x), np.int64, int(sizes.sum()))


def _fit(y: np.ndarray, held: np.ndarray, texts: list[list[list[int]]], names: np.ndarray, l2: float, counterfactual: float, steps: int = 300) -> ToxicityModel:
    if not (~held).any():  # too few texts for a share aside
        held = ~held
    y, texts, aside, y_aside = y[~held], [t for t, h in zip(texts, held, strict=True) if not h], [t[0] for t, h in zip(texts, held, strict=True) if h], y[held]
    d, n = len(names), len(y)
    rows, cols = _sparse([t[0] for t in texts])
    pairs = [(t[0], x) for t in texts for x in t[1:]]
    a_rows, a_cols = _sparse([a for a, _ in pairs])
    b_rows, b_cols = _sparse([b for _, b in pairs])
    w, bias, m, v = np.zeros(d), np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3)), np.zeros(d + 1), np.zeros(d + 1)
    of = lambda r, c, size: np.bincount(r, w[c], size)
    for t in range(1, steps + 1):
        gap = 1 / (1 + np.exp(-np.clip(of(rows, cols, n) + bias, -60, 60))) - y
        grad = np.bincount(cols, gap[rows], d) / n + l2 * w
        if pairs:
            change = of(a_rows, a_cols, len(pairs)) - of(b_rows, b_cols, len(pairs))
            grad += 2 * counterfactual / len(pairs) * (np.bincount(a_cols, change[a_rows], d) - np.bincount(b_cols, change[b_rows], d))
        g = np.append(grad, gap.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * (1 - t / (steps + 1))
        w, bias = w - step[:-1], bias - step[-1]
    w[np.abs(w) < 1e-3] = 0
    weights = np.zeros(1 << BITS, np.float32)
    weights[names] = w
    r, c = _sparse(aside)
    return ToxicityModel(weights, float(bias), _threshold(1 / (1 + np.exp(-np.clip(of(r, c, len(aside)) + bias, -60, 60))), y_aside))


def _threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap between scores at which the F1 measure on texts held out is best; 0.5 without both classes, or where the best is to flag all."""
    if not y.any() or y.all():
        return 0.5
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(y[order])
    last = np.append(s[1:] != s[:-1], True)
    f1 = np.where(last, 2 * hits / (np.arange(1, len(s) + 1) + y.sum()), 0)
    best = int(np.argmax(f1))
    if s[best] == s[-1]:  # nothing tells the classes apart
        return 0.5
    below = s[best + 1]
    return float(np.sqrt(s[best] * max(below, 1e-9)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, toxicity, is_toxic) of every row; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the corpus
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.score(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(s >= shared.value.threshold)], [id_col, "toxicity", "is_toxic"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, toxicity double, is_toxic boolean")


def without_toxic(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text") -> DataFrame:
    """The rows that the model doesn't flag, with all their columns; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.score(b.column(at)) < shared.value.threshold))

    return docs.mapInArrow(run, docs.schema)
