"""Timing of batches: queries in chunks, each chunk one search; a query's latency is its chunk's time by the chunk's size."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrowick.operators.index import Index
from ferrowick.operators.search import SearchOptions, search_batch


@dataclass(frozen=True)
class Timing:
    chunks: list[tuple[int, float]]
    """Queries and seconds of each chunk."""

    @property
    def qps(self) -> float:
        seconds = sum(s for _, s in self.chunks)
        return sum(n for n, _ in self.chunks) / seconds if seconds else 0.0

    def percentile_us(self, p: float) -> float:
        """The element at min(floor(p n), n - 1) of the sorted latencies, in microseconds."""
        each = sorted(x for n, s in self.chunks for x in [s / n * 1e6] * n)
        return each[min(int(p * len(each)), len(each) - 1)] if each else 0.0


def measure(index: Index, queries: DataFrame, options: SearchOptions = SearchOptions(), *, chunk: int = 0, repeat: int = 1) -> Timing:
    """Time the searches of (qid, query) in chunks by the hash of qid, of about ``chunk`` queries; 0 is one chunk."""
    total = queries.count()
    parts = max(1, -(-total // chunk)) if chunk > 0 else 1
    found = []
    for _ in range(repeat):
        for part in range(parts):
            own = queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part)
            n = own.count() if parts > 1 else total
            if not n:
                continue
            start = time.perf_counter()
            search_batch(index, own, options).write.format("noop").mode("overwrite").save()
            found.append((n, time.perf_counter() - start))
    return Timing(found)


def summary(index: Index, timing: Timing, *, threads: int, chunk: int = 0, mode: str = "latency") -> DataFrame:
    """One row: threads, mode, qps, p50_us, p95_us, p99_us, throughput_chunk."""
    row = (threads, mode, timing.qps, *(timing.percentile_us(p) for p in (0.5, 0.95, 0.99)), chunk)
    return index.postings.sparkSession.createDataFrame([row], "threads int, mode string, qps double, p50_us double, p95_us double, p99_us double, throughput_chunk int")
