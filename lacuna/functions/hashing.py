"""Seeded draws from integer arithmetic.

A 32-bit xor-shift-multiply hash written with BIGINT operators only, so that the same draw can be
written in any SQL engine, does not depend on partitioning and survives task retries. Streams
(columns, replicates, patterns) differ by a hashed salt that is xor-ed into the key, so they do not
overlap however many rows there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

M = 4294967296
K = 73244475


def mix32(key: Column) -> Column:
    """Hash a non-negative BIGINT to [0, 2**32)."""
    m = key.cast("bigint")
    m = m.bitwiseXOR(F.shiftrightunsigned(m, 32)) % F.lit(M)
    for _ in range(2):
        m = (m.bitwiseXOR(F.shiftright(m, 16)) * F.lit(K)) % F.lit(M)
    return m.bitwiseXOR(F.shiftright(m, 16))


def salt(stream: int) -> int:
    """The same hash of a driver-side number."""
    m = stream % M
    for _ in range(2):
        m = ((m ^ (m >> 16)) * K) % M
    return m ^ (m >> 16)


def stream_key(id_col: Column, stream: int) -> Column:
    """Key of the draw for one row in one stream."""
    return id_col.cast("bigint").bitwiseXOR(F.lit(salt(stream)))


def uniform(key: Column) -> Column:
    """A double in [0, 1)."""
    return mix32(key) / F.lit(float(M))


def stream_uniforms(df: DataFrame, id_col: str, streams: dict[str, int]) -> DataFrame:
    """Add one uniform column per name, each evaluated once and then referred to by name."""
    return df.withColumns(
        {name: uniform(stream_key(F.col(id_col), s)) for name, s in streams.items()}
    )


def with_uniform53(df: DataFrame, key: str, salt_col: Column, name: str) -> DataFrame:
    """Add a uniform double with 53 random bits from a 64-bit key and a 32-bit salt column.

    High and low halves of the key are hashed one after the other, for tables beyond 2**32 rows.
    Stages are separate projections: inlining them would multiply the expression.
    """
    out = df.withColumn("__hi", mix32(salt_col.bitwiseXOR(F.shiftrightunsigned(F.col(key), 32))))
    lane = F.col("__hi").bitwiseXOR(F.col(key) % F.lit(M))
    out = out.withColumn("__a", mix32(lane))
    out = out.withColumn("__b", mix32(F.col("__a").bitwiseXOR(F.lit(salt(53)))))
    bits = F.shiftright("__a", 5) * F.lit(67108864) + F.shiftright("__b", 6)
    return out.withColumn(name, bits / F.lit(9007199254740992.0)).drop("__hi", "__a", "__b")
