"""Files: parquet, Arrow (feather) and CSV, read-through preparation, split tables and metric rows."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.schema import FeatureSchema
from lacuna.sources.arrow_files import register

METRIC_SCHEMA = (
    "run_id string, split string, feature_space string, filter_subgroup string, reduction string, "
    "feature_type string, metric_name string, predictor string, aggregate_type string, step int, val double"
)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_feather(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Arrow files: ranges of record batches per task, only the columns of ``schema`` (see ``arrow_files``)."""
    register(spark)
    reader = spark.read.format("arrowfiles")
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_feather(df: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Arrow files written by the tasks that hold the rows, to storage all tasks reach."""
    register(df.sparkSession)
    df.write.format("arrowfiles").mode(mode).save(folder)


def read_or_build(spark: SparkSession, path: str, build: Callable[[], tuple[DataFrame, FeatureSchema]]) -> tuple[DataFrame, FeatureSchema]:
    """The prepared table and its schema if already written, else build, write and read back."""
    if not path_exists(spark, f"{path}/schema"):
        df, schema = build()
        write_table(df, f"{path}/data")
        write_schema(spark, schema, f"{path}/schema")
    return spark.read.parquet(f"{path}/data"), read_schema(spark, f"{path}/schema")


def write_table(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_schema(spark: SparkSession, schema: FeatureSchema, path: str) -> None:
    spark.createDataFrame([(schema.to_json(),)], "schema string").write.mode("overwrite").parquet(path)


def read_schema(spark: SparkSession, path: str) -> FeatureSchema:
    return FeatureSchema.from_json(spark.read.parquet(path).first()["schema"])


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """Imputed rows with their label, partitioned by split: later steps prune to what they read."""
    write_table(df, path, [split])


def write_evaluation(data: DataFrame, truth: DataFrame, schema: FeatureSchema, semi_observed: bool, path: str) -> None:
    """What the evaluation step needs: both roles, column types and whether training had gaps."""
    spark = data.sparkSession
    write_table(data, f"{path}/data")
    write_table(truth, f"{path}/truth")
    write_schema(spark, schema, f"{path}/schema")
    spark.createDataFrame([(semi_observed,)], "semi_observed boolean").write.mode("overwrite").parquet(f"{path}/facts")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_metrics(df: DataFrame, path: str, **context) -> None:
    """Append metric rows; context fills the columns the frame does not have."""
    wanted = df.sparkSession.createDataFrame([], METRIC_SCHEMA).schema
    cells = []
    for f in wanted:
        if f.name in df.columns:
            value = F.col(f.name)
        else:
            value = F.lit(context.get(f.name))
        cells.append(value.cast(f.dataType).alias(f.name))
    df.select(*cells).write.mode("append").parquet(path)


@contextmanager
def timed(spark: SparkSession, path: str, name: str, **context):
    """Append the seconds a block took as a metric row."""
    start = time.time()
    yield
    row = spark.createDataFrame([(name, time.time() - start)], "metric_name string, val double")
    append_metrics(row, path, **context)
