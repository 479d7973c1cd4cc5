"""Operator 3: benchmark decontamination by edit distance.

Texts and test items are normalised (lower case, runs of white space as one blank). An item of m characters
may be found with up to k = floor(``rate`` * m) edits, an item of few characters with none. By the pigeonhole principle one of k + 1
pieces of the item then occurs unchanged: all pieces are sought in one pass over a text by an automaton. Items that share a
piece, such as the opening of a questionnaire, all have a hit where it occurs; one edit changes at most ``GRAM`` of an item's runs of
GRAM characters, so a hit stands only if at most k * GRAM of the item's distinct runs are missing round it, counted for all items
at once from an inverted list. Round the hits left Myers' bit-parallel algorithm computes the least edit distance between the item
and a part of the text.

The documents are read once and not shuffled. The items are broadcast, at most ``slice_chars`` characters
at a time, about 60 bytes of a Python worker's memory each: a larger benchmark is taken in as many passes as it needs.

Defined results: null, empty and blank texts match nothing; items that are null or blank match nothing; items with equal texts are each
reported; of an item found in several places the least distance is reported, once; a text of any length is searched whole; a row
with a null id is reported with it; repeated rows are reported as often; empty tables give an empty result.
Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ferrowick.llm import _text as tx

RATE, SLICE_CHARS = 0.07, 4_000_000
GRAM = 5
#: Characters of a text whose runs are gathered together, for all hits in them.
SPAN = 1024
_automata: list[tuple[object, "Matcher"]] = []


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str) -> int:
    """The least edit distance between the pattern and any part of the text."""
    m = len(pattern)
    top, full = 1 << (m - 1), (1 << m) - 1
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | (1 << i)
    up, down, score, best = full, 0, m, m
    for c in text:
        x = eq.get(c, 0)
        diag = x | down
        x |= ((x & up) + up) ^ up
        plus, minus = down | (full & ~(x | up)), up & x
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best = score
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(diag | plus)), plus & diag
    return best


def _grams(text: str) -> np.ndarray:
    """Hashes of the distinct runs of GRAM characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes) - GRAM + 1
    return np.unique(tx.code_hashes(codes)(np.arange(n), np.arange(n) + GRAM)) if n > 0 else np.zeros(0, np.uint64)


def _spread(bounds: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the lists named, bounds[i] to bounds[i + 1] for list i, and how many each has."""
    counts = bounds[lists + 1] - bounds[lists]
    return np.arange(counts.sum()) + np.repeat(bounds[lists] - (np.cumsum(counts) - counts), counts), counts


class Matcher:
    """All items' pieces in one automaton, and their runs of GRAM characters in inverted lists."""

    def __init__(self, items: list[tuple[object, str]], rate: float) -> None:
        self.items = [(key, text, int(rate * len(text))) for key, text in items]
        number: dict[str, int] = {}
        of, item, offset = [], [], []
        for i, (_, text, k) in enumerate(self.items):
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                of.append(number.setdefault(text[a:b], len(number)))
                item.append(i)
                offset.append(a)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for piece, n in number.items():
            self.automaton.add_word(piece, n)
        if number:
            self.automaton.make_automaton()
        self.any = bool(number)
        order = np.argsort(of, kind="stable")
        self.item_of, self.offset_of = np.array(item, np.int64)[order], np.array(offset, np.int64)[order]
        self.of_piece = np.searchsorted(np.array(of, np.int64)[order], np.arange(len(number) + 1))
        self.length = np.fromiter(map(len, number), np.int64, len(number))
        self.size = np.array([len(text) for _, text, _ in self.items], np.int64)
        self.budget = np.array([k for _, _, k in self.items], np.int64)
        grams = [_grams(text) for _, text, _ in self.items]
        self.distinct = np.array([len(g) for g in grams], np.int64)
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        owner = np.repeat(np.arange(len(grams), dtype=np.int32), self.distinct)
        self.owner, first = owner[order], tx.first_of_runs(flat[order])
        self.gram = flat[order][first]
        self.at = np.append(np.flatnonzero(first), len(flat))

    def _near(self, grams: np.ndarray) -> np.ndarray:
        """How many of each item's distinct runs are among these."""
        where = np.searchsorted(self.gram, grams)
        where = where[(where < len(self.gram)) & (self.gram[np.minimum(where, len(self.gram) - 1)] == grams)] if len(self.gram) else where[:0]
        return np.bincount(self.owner[_spread(self.at, where)[0]], minlength=len(self.items))

    def _standing(self, item: np.ndarray, start: np.ndarray, text: str) -> np.ndarray:
        """Which hits have enough of their item's runs round them."""
        keep = np.ones(len(item), bool)
        low = np.maximum(start - self.budget[item], 0) // SPAN
        high = np.maximum(start + self.size[item] + self.budget[item], 0) // SPAN
        span = (low << 32) | high
        order = np.argsort(span, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(span[order])) + 1):
            a, z = int(low[own[0]]), int(high[own[0]])
            found = self._near(_grams(text[a * SPAN : (z + 1) * SPAN]))[item[own]]
            keep[own] = self.distinct[item[own]] - found <= GRAM * self.budget[item[own]]
        return keep

    def find(self, raw: str | None, *, first: bool = False) -> list[tuple[object, int]]:
        """(item's key, least distance) of the items found in a text; ``first``: of one at most."""
        text = normalised(raw)
        if not self.any or not text:
            return []
        hits = np.array(list(self.automaton.iter(text)), np.int64)
        if not len(hits):
            return []
        end, piece = hits.T
        places, counts = _spread(self.of_piece, piece)
        # an item's pieces that occur beside each other name one start
        pairs = np.unique((self.item_of[places] << 32) + (np.repeat(end + 1 - self.length[piece], counts) - self.offset_of[places] + (1 << 31)))
        which, starts = pairs >> 32, (pairs & 0xFFFFFFFF) - (1 << 31)
        stand = self._standing(which, starts, text)
        which, starts = which[stand], starts[stand]
        found: list[tuple[object, int]] = []
        if not len(which):
            return found
        cuts = np.flatnonzero(tx.first_of_runs(which))
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(which)], strict=True):
            key, item, k = self.items[which[a]]
            best = 0 if item in text else self._least(item, k, text, starts[a:z].tolist()) if k else 1
            if best <= k:
                found.append((key, best))
                if first:
                    break
        return found

    @staticmethod
    def _least(item: str, k: int, text: str, starts: list[int]) -> int:
        best, lo, hi = k + 1, starts[0] - k, starts[0] + k
        for s in [*starts[1:], None]:
            if s is not None and s - k <= hi + 1:
                hi = s + k
                continue
            best = min(best, myers(item, text[max(0, lo) : max(0, hi + len(item))]))
            if s is not None:
                lo, hi = s - k, s + k
        return best


def _matcher(shared: Broadcast, rate: float) -> Matcher:
    """The automaton of a broadcast list of items, built once by each Python worker; the list is held, so another cannot take its place in memory."""
    if not _automata or _automata[0][0] is not shared.value:
        _automata[:] = [(shared.value, Matcher(shared.value, rate))]
    return _automata[0][1]


def _slices(docs: DataFrame, items: DataFrame, item_col: str, item_text_col: str, slice_chars: int) -> list[Broadcast]:
    clean = items.select(F.col(item_col).alias("k"), F.col(item_text_col).alias("t")).where(F.length("t") > 0)
    total = clean.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = -(-total // slice_chars)
    out = []
    for p in range(parts):
        got = clean.where(F.pmod(F.xxhash64("t", "k"), F.lit(parts)) == p).collect()  # about slice_chars characters
        out.append(docs.sparkSession.sparkContext.broadcast([(r.k, n) for r in got if (n := normalised(r.t))]))
    return out


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(id, item, distance) of every document and item that it holds within the item's error budget."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{item_col}` {items.schema[item_col].dataType.simpleString()}, distance int"
    key_type = to_arrow_schema(items.select(item_col).schema).field(0).type

    def search(shared: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = _matcher(shared, rate)
                rows = [(i, key, d) for i, text in enumerate(b.column(1)) for key, d in m.find(text.as_py())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int32())), pa.array([r[1] for r in rows], key_type), pa.array([r[2] for r in rows], pa.int32())], [id_col, item_col, "distance"])

        return docs.select(id_col, text_col).mapInArrow(run, schema)

    parts = [search(s) for s in _slices(docs, items, item_col, item_text_col, slice_chars)]
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def without_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """The rows that hold no item, with all their columns; one pass for each slice of the benchmark, no shuffle."""
    at, schema = docs.columns.index(text_col), docs.schema

    def drop(rows: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = _matcher(shared, rate)
                yield b.filter(pa.array([not m.find(text.as_py(), first=True) for text in b.column(at)], pa.bool_()))

        return rows.mapInArrow(run, schema)

    return reduce(drop, _slices(docs, items, item_col, item_text_col, slice_chars), docs)
