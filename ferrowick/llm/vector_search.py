"""Operator 4: exact top-k search by KD-trees.

The queries are a stated set of the rows themselves; each is answered against all rows. Coordinates are turned to the principal axes
of a bounded sample, which changes no distance but lets few axes tell near from far. Equal vectors are one entry with its k + 1
least ids, so that a vector repeated any number of times is no larger than another. The space is cut into shards of about ``shard_rows``
entries by median splits found on the sample. Each shard is a KD-tree: median splits of the widest side down to leaves of ``LEAF``
entries, every node with the tight box of its own entries. A query is first answered in its own shard. Its kth distance then
prunes: a tree over the shards' boxes sends it only to the shards that are not farther, and there it begins with that
distance. A tree is walked best first, by the least distance from box to query, for a block of neighbouring queries at a time,
each with its own kth distance; a block ends when no box is nearer than any kth distance. Distances that can matter are
computed from the differences of the coordinates as given, in double precision.

What reaches the driver is the sample and, for each shard, a box of at most ``ROUTE_AXES`` axes: about 300 bytes for ``shard_rows`` entries.

Defined results: neighbours are ordered by distance, then id, and never the row itself; with fewer than k others all are
given; null ids, null vectors and vectors with a null, NaN or infinite element are no queries and no neighbours, nor are
those of another than the most frequent length (of several the shortest); rows that repeat an id are one vector, the least in
array order; distinct ids with equal vectors are at distance 0; vectors of any length are taken whole; an empty table gives an empty
result. Further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ferrowick.llm._session import bounded, cut_lineage

LEAF, BLOCK = 256, 256
ROUTE_AXES = 16
#: Of every so many ids one is a query of the registered query.
EVERY = 20


def _gap(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances from queries to a box."""
    gap = np.maximum(np.maximum(low - q, q - high), 0)
    return np.einsum("ij,ij->i", gap, gap)


class KDTree:
    """Median splits with tight boxes. Boxes are of turned coordinates ``y``, distances of the vectors ``x``; entry i stands for the ids ``ids[at[i] : at[i + 1]]``."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray, at: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(x))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.kids: list[tuple[int, int] | None] = []
        self.span: list[tuple[int, int]] = []
        stack = [(0, len(x), -1, 0)] if len(x) else []
        while stack:
            a, b, parent, side = stack.pop()
            part = y[order[a:b]]
            low, high = part.min(0), part.max(0)
            node = len(self.kids)
            self.low.append(low)
            self.high.append(high)
            self.span.append((a, b))
            self.kids.append(None)
            if parent >= 0:
                left, right = self.kids[parent] or (-1, -1)
                self.kids[parent] = (node, right) if side == 0 else (left, node)
            axis = int(np.argmax(high - low))
            if b - a > leaf and high[axis] > low[axis]:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, axis], mid, kind="introselect")]
                stack += [(a, a + mid, node, 0), (a + mid, b, node, 1)]
        self.x = x[order]
        self.ids = ids
        self.first, self.many = at[:-1][order], np.diff(at)[order]
        self.norms = np.einsum("ij,ij->i", self.x, self.x)
        self.most = float(self.norms.max()) if len(x) else 0.0

    def search(self, q: np.ndarray, turned: np.ndarray, k: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, neighbour id, squared distance) of up to k neighbours each, not farther than ``kth``; a query that is an entry finds itself."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if self.kids and len(q):
            for at in self._blocks(turned):
                rows, found, d2 = self._block(q[at], turned[at], k, kth[at].copy())
                out.append((at[rows], found, d2))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))  # type: ignore[return-value]

    def _blocks(self, q: np.ndarray) -> Iterator[np.ndarray]:
        """Queries near each other, by splitting them as the tree's entries are."""
        stack = [np.arange(len(q))]
        while stack:
            at = stack.pop()
            part = q[at]
            spread = part.max(0) - part.min(0)
            axis = int(np.argmax(spread))
            if len(at) <= BLOCK or spread[axis] == 0:
                for i in range(0, len(at), BLOCK):
                    yield at[i : i + BLOCK]
                continue
            mid = len(at) // 2
            order = np.argpartition(part[:, axis], mid)
            stack += [at[order[:mid]], at[order[mid:]]]

    def _block(self, q: np.ndarray, turned: np.ndarray, k: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        norms = np.einsum("ij,ij->i", q, q)
        # turning rounds in the last digits, so a box is let go only beyond them
        slack = 1e-10 * (norms + self.most) + 1e-300
        rows, found, d2 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        first = _gap(self.low[0], self.high[0], turned)
        heap: list[tuple[float, int, np.ndarray]] = [(float((first - slack).min()), 0, first)]
        while heap:
            least, node, bound = heapq.heappop(heap)
            if least > kth.max():
                break
            live = np.flatnonzero(bound <= kth + slack)
            if not len(live):
                continue
            kids = self.kids[node]
            if kids is not None:
                for child in kids:
                    far = np.full(len(q), np.inf)
                    far[live] = _gap(self.low[child], self.high[child], turned[live])
                    heapq.heappush(heap, (float((far - slack).min()), child, far))
                continue
            a, b = self.span[node]
            near = norms[live][:, None] + self.norms[a:b] - 2 * (q[live] @ self.x[a:b].T)
            i, j = np.nonzero(near <= (kth + 10 * slack)[live][:, None])
            if not len(i):
                continue
            gap = q[live[i]] - self.x[a + j]
            exact, many = np.einsum("ij,ij->i", gap, gap), self.many[a + j]
            ids = self.ids[np.arange(many.sum()) + np.repeat(self.first[a + j] - (np.cumsum(many) - many), many)]
            rows = np.concatenate([rows, np.repeat(live[i], many)])
            found = np.concatenate([found, ids])
            d2 = np.concatenate([d2, np.repeat(exact, many)])
            order = np.lexsort((found, d2, rows))
            rows, found, d2 = rows[order], found[order], d2[order]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            keep = (rank < k) & (d2 <= kth[rows])
            full = keep & (rank == k - 1)
            kth[rows[full]] = d2[full]
            rows, found, d2 = rows[keep], found[keep], d2[keep]
        return rows, found, d2


Splits = list[tuple[int, float, int, int]]


def top_splits(x: np.ndarray, shards: int) -> Splits:
    """Median splits of a sample into ``shards`` cells: (axis, value, left, right), children as node numbers, cells as -1 - number."""
    nodes: Splits = []
    cells = iter(range(shards))

    def grow(part: np.ndarray, n: int) -> int:
        spread = np.ptp(part, 0) if len(part) else np.zeros(1)
        if n == 1 or not spread.max() > 0:
            return -1 - next(cells)
        axis = int(np.argmax(spread))
        value = float(np.quantile(part[:, axis], (n // 2) / n))
        at = len(nodes)
        nodes.append((axis, value, 0, 0))
        below = part[:, axis] <= value
        nodes[at] = (axis, value, grow(part[below], n // 2), grow(part[~below], n - n // 2))
        return at

    grow(x, shards)
    return nodes


def assign(x: np.ndarray, nodes: Splits) -> np.ndarray:
    """Each vector's cell."""
    at = np.zeros(len(x), np.int64) if nodes else np.full(len(x), -1)
    axis, value, left, right = (np.array([n[i] for n in nodes]) for i in range(4))
    while (open_ := np.flatnonzero(at >= 0)).size:
        node = at[open_]
        at[open_] = np.where(x[open_, axis[node]] <= value[node], left[node], right[node])
    return -1 - at


class Router:
    """The boxes of all cells under those of the splits above them; an empty cell has none."""

    def __init__(self, nodes: Splits, boxes: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        self.nodes, self.boxes = nodes, dict(boxes)  # cells by number, splits by -1 - number
        for i in range(len(nodes) - 1, -1, -1):  # children come after their parents
            under = [b for c in nodes[i][2:] if (b := self.boxes.get(-1 - c)) is not None]
            if under:
                self.boxes[-1 - i] = (np.min([b[0] for b in under], 0), np.max([b[1] for b in under], 0))

    def route(self, turned: np.ndarray, reach: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, rows) of the cells other than its own that are within a row's reach."""
        stack = [(0 if self.nodes else -1, np.arange(len(turned)))]
        while stack:
            node, rows = stack.pop()
            box = self.boxes.get(-1 - node)
            if box is None:
                continue
            near = rows[_gap(*box, turned[rows, : len(box[0])]) <= reach[rows]]
            if node >= 0:
                stack += [(child, near) for child in self.nodes[node][2:] if len(near)]
            elif len(near := near[own[near] != -1 - node]):
                yield -1 - node, near


def _matrix(column: pa.Array | pa.ChunkedArray, d: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, d).astype(np.float64)


def _packed(x: np.ndarray) -> pa.Array:
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def _axes(sample: np.ndarray) -> np.ndarray:
    """Orthogonal axes, those of most variance first."""
    centred = sample - sample.mean(0)
    return np.ascontiguousarray(np.linalg.eigh(centred.T @ centred)[1][:, ::-1])


def nearest(vectors: DataFrame, k: int = 10, *, queries: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 16_384, max_sample: int = 20_000) -> DataFrame:
    """(id, rank, neighbor_id, distance) of the k nearest others of every row for which ``queries`` holds (by default of all), exact."""
    spark = vectors.sparkSession
    # single precision is moved as such, and computed with in double
    single = isinstance(vectors.schema[vector_col].dataType, ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, FloatType)
    kind, name = (np.float32, "float") if single else (np.float64, "double")
    asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{name}>").alias("v"), asked.alias("asked")).where("id is not null and v is not null and size(v) > 0").where(~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    rows = cut_lineage(clean.groupBy("id").agg(F.min("v").alias("v"), F.max("asked").alias("asked")))
    schema = "query long, rank int, neighbor_id long, distance double"
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None or k < 1:
        return spark.createDataFrame([], schema).withColumnRenamed("query", id_col)
    d, n = length.d, length["count"]
    rows = rows.where(F.size("v") == d)
    sample = np.array(bounded(rows, "id", max_sample).orderBy("id").select("v").toArrow()["v"].to_pylist(), np.float64)
    turn = _axes(sample)
    nodes = top_splits(sample @ turn, max(1, -(-n // shard_rows)))
    # of each vector its k + 1 least ids, cut before the shuffle too: no group is gathered
    least = rows.select("id", "v", F.row_number().over(Window.partitionBy("v").orderBy("id")).alias("r")).where(F.col("r") <= k + 1)
    entries = least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    # a vector that is asked for many times is searched once
    wanted = rows.where("asked").select("id", "v")
    distinct = wanted.groupBy("v").agg(F.min("id").alias("q"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, d)
            yield pa.RecordBatch.from_arrays([pa.array(assign(x.astype(np.float64) @ turn, nodes).astype(np.int32)), b.column(1), _packed(x), b.column(2)], ["shard", "q", "v", "ids"])

    kinds = "shard int, q long, v binary, ids array<long>"
    placed = cut_lineage(entries.select("v", F.lit(None).cast("long").alias("q"), "ids").mapInArrow(place, kinds))
    home = cut_lineage(distinct.select("v", "q", F.lit(None).cast("array<long>").alias("ids")).mapInArrow(place, kinds))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each shard first its entries (kth is -1), then the queries sent to it, a batch at a time. Out come (query, d2, id) and, of entries at home, the shard's box."""
        shard, held, tree = None, [], None
        names = ["shard", "q", "d2", "id", "box"]
        for b in batches:
            numbers = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])).tolist() if len(numbers) else []
            for a, z in zip(cuts, [*cuts[1:], len(numbers)], strict=True):
                if numbers[a] != shard:
                    shard, held, tree = numbers[a], [], None
                part = b.slice(a, z - a)
                kth = part.column(4).to_numpy()
                own = int((kth < 0).sum())  # they come first
                if own:
                    held.append(part.slice(0, own))
                part, kth = part.slice(own), kth[own:]
                if len(kth) and held:
                    if tree is None:
                        x = np.concatenate([_matrix(h.column(2), d, kind) for h in held])
                        lists = pa.concat_arrays([h.column(3) for h in held])
                        sizes = lists.value_lengths().to_numpy()
                        tree = KDTree(x, x @ turn, lists.flatten().to_numpy(), np.append(0, np.cumsum(sizes)))
                    x = _matrix(part.column(2), d, kind)
                    r, found, d2 = tree.search(x, x @ turn, k + 1, kth)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), shard, np.int32)), part.column(1).take(pa.array(r)), pa.array(d2), pa.array(found), pa.nulls(len(r), pa.binary())], names)

    def box_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A box for each shard that a batch has entries of."""
        for b in batches:
            number, y = b.column(0).to_numpy(), _matrix(b.column(1), d, kind) @ turn[:, :ROUTE_AXES]
            order = np.argsort(number, kind="stable")
            cuts = np.flatnonzero(np.diff(number[order])) + 1
            parts = [y[i] for i in np.split(order, cuts) if len(i)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(number).astype(np.int32)), pa.array([p.min(0).tolist() for p in parts], pa.list_(pa.float64())), pa.array([p.max(0).tolist() for p in parts], pa.list_(pa.float64()))], ["shard", "low", "high"])

    def answered(sent: DataFrame) -> DataFrame:
        """(q, d2, id) of queries (shard, q, v, kth) in the shards that they are sent to."""
        both = placed.select("shard", "q", "v", "ids", F.lit(-1.0).alias("kth")).unionByName(sent.select("shard", "q", "v", F.lit(None).cast("array<long>").alias("ids"), "kth"))
        return both.repartition(min(len(nodes) + 1, 4096), "shard").sortWithinPartitions("shard", "kth").mapInArrow(visit, "shard int, q long, d2 double, id long, box binary").select("q", "d2", "id")

    best = Window.partitionBy("q").orderBy("d2", "id")
    top = lambda df: df.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    found = answered(home.withColumn("kth", F.lit(float("inf"))))
    if nodes:
        found = cut_lineage(found)  # at most k + 1 rows a query
        sides = placed.select("shard", "v").mapInArrow(box_of, "shard int, low array<double>, high array<double>")
        each = sides.select("shard", F.posexplode(F.arrays_zip("low", "high"))).groupBy("shard", "pos").agg(F.min("col.low").alias("low"), F.max("col.high").alias("high"))
        # a row for each shard
        boxes = {r.shard: (np.array([p.low for p in r.s]), np.array([p.high for p in r.s])) for r in each.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("pos", "low", "high"))).alias("s")).collect()}
        shared = spark.sparkContext.broadcast(Router(nodes, boxes))
        kth = found.groupBy("q").agg(F.max("d2").alias("kth"), F.count(F.lit(1)).alias("n")).select("q", F.when(F.col("n") == k + 1, F.col("kth")).otherwise(float("inf")).alias("kth"))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, reach, own = _matrix(b.column(2), d, kind), b.column(3).to_numpy(), b.column(0).to_numpy()
                y = x @ turn[:, :ROUTE_AXES]
                slack = 1e-10 * (np.einsum("ij,ij->i", x, x) + np.where(np.isfinite(reach), reach, 0)) + 1e-300
                for number, go in shared.value.route(y, reach + slack, own):
                    at = pa.array(go)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(go), number, np.int32)), b.column(1).take(at), b.column(2).take(at), pa.array(reach[go])], ["shard", "q", "v", "kth"])

        away = home.join(kth, "q", "left").select("shard", "q", "v", F.coalesce("kth", F.lit(float("inf"))).alias("kth")).mapInArrow(route, "shard int, q long, v binary, kth double")
        found = found.union(answered(away))
    lists = top(found).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("d2", "id"))).alias("best"))
    # every row that asks has the answer of its vector, less itself
    each = wanted.join(distinct, "v").select("id", "q").join(lists, "q").select("id", F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k).alias("best"))
    return each.select("id", F.posexplode("best")).select(F.col("id").alias(id_col), (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias("neighbor_id"), F.round(F.sqrt("col.d2"), 6).alias("distance"))


#: DuckDB's form of the registered query, by all pairs of a query and a row.
ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.e, b.e) AS dist FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id)
SELECT vec_id, rank::INT AS rank, neighbor_id, round(dist, 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 12), neighbor_id) AS rank FROM p) WHERE rank <= 10
"""
