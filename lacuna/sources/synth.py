"""A mixed table of any size for benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.hashing import stream_key, uniform


def synth_mixed(spark: SparkSession, n: int = 100_028, seed: int = 0) -> DataFrame:
    """Two multi-category columns (3 and 4 values), 8 binaries, 10 uniforms and a label."""
    u = lambda i: uniform(stream_key(F.col("id"), seed + i))
    return spark.range(n).select(
        "id",
        F.floor(u(1) * 3).cast("int").alias("multicatA"),
        *[(u(10 + i) < 0.5).cast("int").alias(f"bin{i}") for i in range(8)],
        F.floor(u(2) * 4).cast("int").alias("multicatB"),
        *[u(30 + i).alias(f"ctn{i}") for i in range(10)],
        (u(3) < 0.5).cast("int").alias("label"),
    )
