"""Fitted transforms and metric sums on streams.

A fitted imputer is a projection, so it applies to a stream as it is. Metric states are sums, so
scoring batches one by one and merging equals scoring the whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lacuna.operators.metrics import merge_states, metric_states
from lacuna.schema import FeatureSchema
from lacuna.session import new_table_path


def run_to_table(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Process what is available into a parquet table of the shared folder and read it back.

    With the ``path`` of an earlier run, the query goes on with the state and the table it left.
    """
    spark = stream.sparkSession
    path = path or new_table_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    folder, _, pattern = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def apply_fitted(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    return run_to_table(transform(stream), name)


def score_stream(
    stream: DataFrame, to_frame: Callable[[DataFrame], DataFrame], schema: FeatureSchema, by: list[str] = ()
) -> DataFrame:
    """Merged metric states of all batches; each batch appends its own states once."""
    path = new_table_path(stream.sparkSession, "stream-states")

    def add(batch: DataFrame, number: int) -> None:
        # Overwriting the folder of the batch number makes a replayed batch count once.
        metric_states(to_frame(batch), schema, list(by)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(add)
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return merge_states(stream.sparkSession.read.parquet(path).drop("batch"), list(by))
