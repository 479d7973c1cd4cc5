"""Session helpers: the shared folder and bounded, reproducible samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrowick.operators.lineage import cut_lineage, delete, delete_at_end, shared_folder, written

__all__ = ["bounded", "cut_lineage", "delete", "delete_at_end", "hash_share", "labelled", "shared_folder", "written"]


def hash_share(key: str | Column, share: float, salt: int = 0) -> Column:
    """True for about this share of the keys, chosen by their hash: the same ones whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col(key) if isinstance(key, str) else key), F.lit(1_000_003)) < F.lit(int(min(1.0, share) * 1_000_003))


def bounded(df: DataFrame, key: str, most: int, salt: int = 0) -> DataFrame:
    """df when it has at most ``most`` rows, else a hash sample of about 97 % of ``most``, and never of more."""
    n = df.count()
    if n <= most:
        return df
    # the limit holds where chance takes more, and where many rows have one key
    return df.where(hash_share(key, 0.97 * most / n, salt)).limit(most)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int) -> DataFrame:
    """(fw_id, fw_text, fw_label) of at most ``max_train`` labelled documents, one row for each id: of several labels of an id the largest counts, of several texts the least."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("fw_id")).agg(F.max(F.col(label_col).cast("int")).alias("fw_label"))
    own = bounded(own, "fw_id", max_train)
    # the side broadcast has at most max_train rows, whatever the corpus
    found = docs.select(F.col(id_col).alias("fw_id"), F.col(text_col).alias("fw_text")).join(F.broadcast(own), "fw_id")
    return cut_lineage(found.groupBy("fw_id", "fw_label").agg(F.min("fw_text").alias("fw_text")).select("fw_id", "fw_text", "fw_label"))
