"""Operator 1: quality classifier.

Every document is described by ``STATISTICS`` (lengths, character classes, repetition of words, lines and
word triples). Standardised, they are mapped to random Fourier features z = sqrt(2/D) cos(Wx + b), whose products
approximate a Gaussian kernel. Each partition of the labelled sample sums z z' and z y; Spark adds the
sums, and the driver solves the D equations of ridge regression. Isotonic regression on labelled texts held out
(pool adjacent violators) turns ridge scores into probabilities.

Scoring is one pass without shuffle. The sample is bounded by ``max_train``, one row for each id; all else covers every document.

Defined results: a null or empty text is scored by its statistics, all of them 0; a text of any length is described
whole; equal scores have equal quality, and a quality equal to the threshold is kept; of several texts of a labelled id the least
teaches, of several labels the largest; without labels the
quality is null and every document is kept; with labels of one class it is that class everywhere; repeated rows are each
scored; an empty table gives an empty result. Further columns are ignored: the result has the id, ``score``,
``quality`` and ``keep`` only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrowick.llm import _text as tx
from ferrowick.llm._session import cut_lineage, hash_share, labelled

STATISTICS = (
    "log_bytes", "letters", "digits", "upper", "high", "ascii_punctuation", "odd_symbols", "blanks", "log_words", "mean_word", "sd_word", "long_words",
    "short_words", "bare_words", "distinct_words", "repeated_triples", "log_lines", "distinct_lines", "log_mean_line", "ended_lines", "shouted_words",
)
_LETTER, _DIGIT, _UPPER, _HIGH, _PUNCTUATION, _ODD, _END = (np.zeros(256, np.int64) for _ in range(7))
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1
_DIGIT[48:58] = 1
_UPPER[65:91] = 1
_HIGH[128:] = 1
_PUNCTUATION[33:48] = _PUNCTUATION[58:65] = _PUNCTUATION[91:97] = _PUNCTUATION[123:127] = 1
_ODD[[ord(c) for c in "#$%&*|!<>{}[]\\^~=_@"]] = 1
_END[[ord(c) for c in ".!?:;\"')"]] = 1
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many distinct hashes each row has."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    return np.bincount(r[tx.first_of_runs(h) | tx.first_of_runs(r)], minlength=n)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; nulls and empty texts have zeros."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for first, end, data, offsets in tx.chunks(texts):
        n = end - first
        size = np.diff(offsets)

        def count(kind: np.ndarray, data: np.ndarray = data, offsets: np.ndarray = offsets) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(kind[data])])[offsets])

        letters = count(_LETTER)
        starts, ends, rows = tx.words(data, offsets)
        words = np.bincount(rows, minlength=n)
        length = (ends - starts).astype(float)
        mean = _ratio(np.bincount(rows, length, n), words)
        hashes = tx.window_hashes(data, lower=True)
        word = hashes(starts, ends)
        upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
        bare = np.concatenate([[0], np.cumsum(_LETTER[data])])
        triple = np.flatnonzero(rows[2:] == rows[:-2]) if len(rows) > 2 else np.zeros(0, np.int64)
        triples = np.bincount(rows[triple], minlength=n)
        l_starts, l_ends, l_rows = tx.words(data, offsets, _NOT_NEWLINE)
        lines = np.bincount(l_rows, minlength=n)
        x = out[first:end]
        x[:, 0] = np.log1p(size)
        for i, value in enumerate((letters, count(_DIGIT), count(_UPPER), count(_HIGH), count(_PUNCTUATION), count(_ODD), count(tx.SPACE.astype(np.int64)))):
            x[:, 1 + i] = _ratio(value, size)
        x[:, 8] = np.log1p(words)
        x[:, 9] = np.log1p(mean)
        x[:, 10] = np.log1p(np.sqrt(np.maximum(_ratio(np.bincount(rows, length**2, n), words) - mean**2, 0)))
        x[:, 11] = _ratio(np.bincount(rows[length > 14], minlength=n), words)
        x[:, 12] = _ratio(np.bincount(rows[length < 4], minlength=n), words)
        x[:, 13] = _ratio(np.bincount(rows[bare[ends] == bare[starts]], minlength=n), words)
        x[:, 14] = _ratio(_distinct(rows, word, n), words)
        x[:, 15] = np.where(triples > 0, 1 - _ratio(_distinct(rows[triple], hashes(starts[triple], ends[triple + 2]), n), triples), 0)
        x[:, 16] = np.log1p(lines)
        x[:, 17] = _ratio(_distinct(l_rows, hashes(l_starts, l_ends), n), lines)
        x[:, 18] = np.log1p(_ratio(size, lines))
        x[:, 19] = _ratio(np.bincount(l_rows[_END[data[np.maximum(l_ends - 1, 0)]] > 0], minlength=n) if len(l_rows) else np.zeros(n), lines)
        x[:, 20] = _ratio(np.bincount(rows[(upper[ends] - upper[starts]) > 1], minlength=n), words)
    return out


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the knots and values of the rising step function nearest to y; equal scores are one block."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(scores[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][1] == s:
            blocks[-1][2] += v
            blocks[-1][3] += 1
        else:
            blocks.append([s, s, v, 1])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, high, total, n = blocks.pop()
            blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + total, blocks[-1][3] + n]
    return np.array([x for b in blocks for x in b[:2]]), np.array([b[2] / b[3] for b in blocks for _ in range(2)])


@dataclass
class QualityModel:
    """Standardisation, random features, ridge weights and the calibration; of the features' size whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    phase: np.ndarray
    ridge: np.ndarray | None = None
    offset: float = 0.0
    knots: np.ndarray | None = None
    values: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / len(self.phase)) * np.cos(((x - self.mean) / self.scale) @ self.w + self.phase)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.offset) if self.ridge is None else self.features(x) @ self.ridge + self.offset

    def calibrated(self, scores: np.ndarray) -> np.ndarray:
        return np.clip(scores, 0, 1) if self.knots is None else np.interp(scores, self.knots, self.values)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = statistics(b.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1), b.column(2)], ["x", "y", "held"])


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 20_000, n_features: int = 256, bandwidth: float = 4.0, l2: float = 1e-3, held_out: float = 0.3, seed: int = 11) -> QualityModel | None:
    """Fit on at most ``max_train`` labelled documents, a share ``held_out`` of them for the calibration; None without labels."""
    sample = labelled(docs, labels, id_col, text_col, label_col, max_train)
    rows = cut_lineage(sample.select("fw_text", F.greatest("fw_label", F.lit(0)).cast("double").alias("y"), hash_share("fw_id", held_out, 5).alias("held")).mapInArrow(_described, "x array<double>, y double, held boolean"))
    moments = rows.select(F.posexplode("x"), "y").groupBy("pos").agg(F.avg("col").alias("mean"), F.stddev_pop("col").alias("sd"), F.avg("y").alias("y")).orderBy("pos").collect()  # a row for each statistic
    if not moments:
        return None
    rng, d = np.random.default_rng(seed), len(STATISTICS)
    model = QualityModel(np.array([r["mean"] for r in moments]), np.array([max(r.sd, 1e-6) for r in moments]), rng.normal(0, 1 / bandwidth, (d, n_features)), rng.uniform(0, 2 * np.pi, n_features), offset=float(moments[0].y))
    if moments[0].y in (0.0, 1.0):
        return model
    center = model.offset

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_features, n_features + 1))
        for b in batches:
            z = model.features(b.column(0).flatten().to_numpy().reshape(-1, d))
            total[:, :-1] += z.T @ z
            total[:, -1] += z.T @ (b.column(1).to_numpy() - center)
        i, j = np.nonzero(np.triu(np.ones_like(total)))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    cells = rows.where(~F.col("held")).select("x", "y").mapInArrow(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    normal = np.zeros((n_features, n_features + 1))
    normal[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["v"].to_numpy()
    left = np.triu(normal[:, :-1])
    left = left + np.triu(left, 1).T
    n = max(rows.where(~F.col("held")).count(), 1)
    model.ridge = np.linalg.solve(left + l2 * n / n_features * np.eye(n_features), normal[:, -1])
    aside = rows.where("held").select("x", "y").toArrow()  # a share of max_train rows
    if aside.num_rows:
        model.knots, model.values = isotonic(model.scores(np.array(aside["x"].to_pylist())), aside["y"].to_numpy())
    return model


def score_quality(docs: DataFrame, model: QualityModel | None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, score, quality, keep) of every row; one pass, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    if model is None:
        return docs.select(F.col(id_col), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("quality"), F.lit(True).alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.scores(statistics(b.column(1)))
            q = shared.value.calibrated(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(q), pa.array(q >= threshold)], [id_col, "score", "quality", "keep"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, quality double, keep boolean")
