"""Measures of ranked retrieval from judgements (qid, doc_id, rel) and runs (qid, doc_id, rank, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrowick.operators.ranges import running_before

DEFAULT = ("ndcg_cut.10", "recall.1000", "map", "recip_rank")


def mrr_cut(qrels: DataFrame, run: DataFrame, cutoff: int = 10) -> DataFrame:
    """One row: the mean reciprocal of the first relevant rank up to ``cutoff``, over all judged queries; 0 where a run has none."""
    relevant = qrels.where("rel > 0").select("qid", "doc_id").distinct()
    first = run.where(F.col("rank") <= cutoff).join(relevant, ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("first"))
    return qrels.select("qid").distinct().join(first, "qid", "left").agg(F.coalesce(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), F.lit(0.0)).alias(f"mrr_cut_{cutoff}"))


def per_query(qrels: DataFrame, run: DataFrame, cut: int = 10, depth: int = 1000) -> DataFrame:
    """(qid, ndcg_cut_<cut>, recall_<depth>, map, recip_rank) of the queries in both; a run is ordered by score, then by doc_id as text, both falling."""
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id").cast("string").desc())
    ranked = run.select("qid", "doc_id", F.row_number().over(order).alias("place"))
    judged = qrels.groupBy("qid", "doc_id").agg(F.max("rel").alias("rel"))
    hits = ranked.join(judged, ["qid", "doc_id"], "left").withColumn("good", F.coalesce(F.col("rel") > 0, F.lit(False)))
    hits = hits.withColumn("before", F.sum(F.col("good").cast("int")).over(Window.partitionBy("qid").orderBy("place")))
    gain = lambda rel, place: rel / F.log2(place + 1)
    sums = hits.groupBy("qid").agg(
        F.sum(F.when(F.col("good") & (F.col("place") <= cut), gain(F.col("rel"), F.col("place")))).alias("dcg"),
        F.sum(F.when(F.col("good") & (F.col("place") <= depth), 1)).alias("recalled"),
        F.sum(F.when(F.col("good"), F.col("before") / F.col("place"))).alias("precision"),
        F.min(F.when(F.col("good"), F.col("place"))).alias("first"),
    )
    best = Window.partitionBy("qid").orderBy(F.col("rel").desc())
    ideal = judged.withColumn("place", F.row_number().over(best)).groupBy("qid").agg(F.sum(F.when((F.col("rel") > 0) & (F.col("place") <= cut), gain(F.col("rel"), F.col("place")))).alias("ideal"), F.count_if(F.col("rel") > 0).alias("relevant"))

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.coalesce(F.col(a) / F.col(b), F.lit(0.0))).otherwise(0.0)

    return sums.join(ideal, "qid").select("qid", share("dcg", "ideal").alias(f"ndcg_cut_{cut}"), share("recalled", "relevant").alias(f"recall_{depth}"), share("precision", "relevant").alias("map"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("recip_rank"))


def evaluate(qrels: DataFrame, run: DataFrame, metrics: tuple[str, ...] = DEFAULT) -> DataFrame:
    """One row of means, with mrr_cut_10 and num_queries always. ``ndcg_cut.N`` and ``recall.N`` take any N."""
    wanted: dict[str, list[int]] = {"ndcg_cut": [], "recall": [], "map": [], "recip_rank": []}
    for m in metrics:
        name, _, n = m.partition(".")
        if name not in wanted or (name in ("ndcg_cut", "recall")) != bool(n):
            raise ValueError(f"no metric {m}")
        wanted[name].append(int(n or 0))
    cuts, depths, parts = wanted["ndcg_cut"] or [10], wanted["recall"] or [1000], []
    for i in range(max(len(cuts), len(depths))):  # the default metrics take one pass
        per = per_query(qrels, run, cuts[min(i, len(cuts) - 1)], depths[min(i, len(depths) - 1)])
        names = [f"{name}_{n}" if n else name for name, ns in wanted.items() for n in (ns[i : i + 1])]
        parts.append(per.agg(*[F.avg(c).alias(c) for c in names])) if names else None
    both = run.select("qid").distinct().join(qrels.select("qid").distinct(), "qid").agg(F.count(F.lit(1)).alias("num_queries"))
    return reduce(lambda a, b: a.crossJoin(b), [*parts, mrr_cut(qrels, run), both])  # each one row


def percentiles(rows: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(p, value): the element at min(floor(p n), n - 1) of the sorted values.

    Values are counted first, so the running sum is over distinct values; exact at any size."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    upto = running_before(counts, "c", ["value"], "before").crossJoin(counts.agg(F.sum("c").alias("n"))).withColumn("upto", F.col("before") + F.col("c"))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in shares])).alias("p")
    at = upto.select("value", "upto", "n", wanted).where(F.col("upto") > F.least(F.floor(F.col("p") * F.col("n")), F.col("n") - 1))
    return at.groupBy("p").agg(F.min("value").alias("value"))
