"""Operator 10: language identification by language-bitmask n-gram filters.

For each language its ``per_language`` most frequent n-grams of words (bytes, lower case, with the word's bounds) are
entered in a Bloom filter. The filters are bit-sliced: position p of all of them is one bitmask, a bit for each
language, so that the AND of an n-gram's k masks is the set of all languages that contain it. A document's hits are
popcounts per language. A filter of fill f answers falsely at a rate f^k, so h hits of n stand for
(h - n f^k) / (1 - f^k) true ones; the language of the most decides, ties by name.

The profile is counted on at most about ``max_train`` documents of each language, by Spark. The model's size is a parameter as
its sample's: of the n-grams that occur ``min_count`` times in the sample, each language's ``per_language`` most frequent (of equally
frequent ones the lower hash) are entered, so the filters' size is set by the languages, not by the corpus. Scoring is one pass without shuffle.

Defined results: a text of any length is scored whole; null and empty texts and texts without a word have language ``und`` and score 0; documents
without a language teach nothing; without any teacher all are ``und``; repeated rows are each scored; an
empty table gives an empty result. Further columns are ignored: the result has the id, ``language``,
``score`` and ``n_grams`` only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrowick.llm import _text as tx

SIZES = (3, 4)
_WORD = np.zeros(256, bool)
_WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def n_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and 64-bit hashes of the n-grams of all words, of SIZES bytes, and of all whole words."""
    starts, ends, rows = tx.words(data, offsets, _WORD)
    hashes = tx.window_hashes(data, lower=True)
    found_rows, found = [rows], [hashes(starts, ends) ^ np.uint64(0x5A5A)]
    for n in SIZES:
        count = np.maximum(ends - starts - n + 1, 0)
        total = np.cumsum(count)
        at = np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - count), count)
        h = hashes(at, at + n)
        first = np.repeat(starts, count) == at
        h[first] ^= np.uint64(0xF1F1F1)  # at the word's start it's another n-gram
        found_rows.append(np.repeat(rows, count))
        found.append(h ^ np.uint64(0x77 * n))
    return np.concatenate(found_rows), np.concatenate(found)


@dataclass
class LanguageFilters:
    """Bit-sliced Bloom filters: masks[p] has a bit for each language whose filter has bit p set, in words of 64 languages."""

    languages: list[str]
    masks: np.ndarray
    hashes: int = 4

    @classmethod
    def of(cls, profiles: dict[str, np.ndarray], bits_per_gram: int = 12, hashes: int = 4) -> LanguageFilters:
        names = sorted(profiles)
        most = max((len(p) for p in profiles.values()), default=1)
        size = 1 << max(10, int(np.ceil(np.log2(max(most * bits_per_gram, 1)))))
        out = cls(names, np.zeros((size, max(1, -(-len(names) // 64))), np.uint64), hashes)
        for i, name in enumerate(names):
            out.masks[np.unique(out.positions(profiles[name])), i // 64] |= np.uint64(1 << (i % 64))
        return out

    def positions(self, grams: np.ndarray) -> np.ndarray:
        """Hashes by n-grams: the positions of each, by double hashing."""
        step = tx.mix(grams ^ np.uint64(0x9E37)) | np.uint64(1)
        return np.array([((grams + np.uint64(i) * step) >> np.uint64(20)) & np.uint64(len(self.masks) - 1) for i in range(self.hashes)]).astype(np.int64)

    def containing(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram the bitmask of all languages that contain it."""
        at = self.positions(grams)
        found = self.masks[at[0]]
        for p in at[1:]:
            found = found & self.masks[p]
        return found

    def false_rates(self) -> np.ndarray:
        fill = [((self.masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.languages))]
        return np.array(fill) ** self.hashes

    def corrected(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The corrected share of each text's n-grams in each language, and their number."""
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for first, end, data, offsets in tx.chunks(texts):
            rows, grams = n_grams(data, offsets)
            n = end - first
            total[first:end] = np.bincount(rows, minlength=n)
            masks = self.containing(grams)
            for i in range(len(self.languages)):
                hits[first:end, i] = np.bincount(rows[(masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) == 1], minlength=n)
        false = self.false_rates()
        return np.maximum(hits / np.maximum(total, 1)[:, None] - false, 0) / (1 - false), total


def fit_languages(docs: DataFrame, *, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", max_train: int = 4_000, per_language: int = 20_000, min_count: int = 3) -> LanguageFilters:
    """Profiles from at most about ``max_train`` documents of each language, chosen by the hash of the id; their whole texts count."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}  # a row for each language
    if not sizes:
        return LanguageFilters.of({})
    names = sorted(sizes)
    share = F.create_map(*[F.lit(x) for name in names for x in (name, min(1.0, max_train / sizes[name]))])[F.col(lang_col)]
    chosen = known.where(F.pmod(F.xxhash64(F.lit(3), F.col(id_col).cast("string"), F.col(text_col)), F.lit(1_000_003)) < share * 1_000_003)
    code = F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name, i)])[F.col(lang_col)]

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(keys: list[np.ndarray], langs: list[np.ndarray]) -> pa.RecordBatch:
            t = pa.table({"lang": np.concatenate(langs), "gram": np.concatenate(keys).view(np.int64)}).group_by(["lang", "gram"]).aggregate([([], "count_all")])
            return pa.RecordBatch.from_arrays([t["lang"].combine_chunks(), t["gram"].combine_chunks(), t["count_all"].combine_chunks()], ["lang", "gram", "n"])

        keys: list[np.ndarray] = []
        langs: list[np.ndarray] = []
        held = 0
        for b in batches:
            lang = b.column(0).to_numpy()
            for first, _, data, offsets in tx.chunks(b.column(1)):
                rows, grams = n_grams(data, offsets)
                keys.append(grams)
                langs.append(lang[rows + first])
                held += len(grams)
                if held > 4_000_000:
                    yield counted(keys, langs)
                    keys, langs, held = [], [], 0
        if held:
            yield counted(keys, langs)

    counts = chosen.select(code.cast("int").alias("lang"), F.col(text_col)).mapInArrow(grams_of, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= per_language).select("lang", "gram").toArrow()  # at most per_language rows a language
    lang, gram = top["lang"].to_numpy(), top["gram"].to_numpy().view(np.uint64)
    return LanguageFilters.of({name: gram[lang == i] for i, name in enumerate(names)})


def identify(docs: DataFrame, filters: LanguageFilters, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.05) -> DataFrame:
    """(id, language, score, n_grams) of every row; one pass, no shuffle. A best share below ``least`` is ``und``."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # of the profiles' size, whatever the corpus
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, "und"], object)
        for b in batches:
            shares, total = shared.value.corrected(b.column(1))
            best = shares.argmax(1) if shares.shape[1] else np.zeros(len(total), np.int64)
            score = shares.max(1) if shares.shape[1] else np.zeros(len(total))
            unknown = (total == 0) | (score < least)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[np.where(unknown, len(names) - 1, best)], pa.string()), pa.array(np.where(total == 0, 0, score)), pa.array(total)], [id_col, "language", "score", "n_grams"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, language string, score double, n_grams long")
