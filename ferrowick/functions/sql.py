"""The main functions as SQL functions of a session; SQL bodies, so Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "tokenize(text STRING) RETURNS ARRAY<STRING>": "transform(regexp_extract_all(coalesce(text, ''), '([A-Za-z0-9]+)', 1), t -> lower(t))",
    "bm25_idf(n DOUBLE, df DOUBLE) RETURNS DOUBLE": "ln((n - df + 0.5D) / (df + 0.5D) + 1.0D)",
    "bm25_tf_norm(tf DOUBLE, dl DOUBLE, avgdl DOUBLE) RETURNS DOUBLE": "tf * 2.2D / (tf + 1.2D * (0.25D + 0.75D * dl / avgdl))",
    "varbyte_length(v BIGINT) RETURNS INT": "1 + int(v >= 128) + int(v >= 16384) + int(v >= 2097152) + int(v >= 268435456)",
}


def register(spark: SparkSession) -> None:
    """Make FUNCTIONS known to the session."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
