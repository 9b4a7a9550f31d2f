"""Operators with state: several batches, rows out of order, late rows and restarts."""

import datetime as dt

from pyspark.sql import functions as F

from lacuna.operators import metrics as M
from lacuna.schema import FeatureSchema
from lacuna.session import new_table_path
from lacuna.streaming import stateful as ST
from lacuna.streaming.incremental import run_to_table

START = dt.datetime(2024, 1, 1)
SCHEMA = "e string, at timestamp, x double, s string, i int"


def day(n):
    return START + dt.timedelta(days=n)


def row(e, n, x=None, s=None, i=None):
    return (e, day(n), x, s, i)


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_locf_over_batches_and_a_restart(spark):
    path, out = new_table_path(spark, "in"), new_table_path(spark, "out")
    first = [[row("a", 1, 1.0, "p"), row("a", 3, None, "q", 7), row("b", 2, None)], [row("a", 2, None, None, 5), row("b", 4, 4.5), row(None, 3, 3.0)]]
    second = [[row("a", 6), row(None, 5, None, "z")], [row("a", 5, 2.0), row("b", 7, None, "r"), row("a", 1, 99.0)], [row("c", 100)]]
    run = lambda: run_to_table(ST.locf_stream(source(spark, path), "e", "at", ["x", "s", "i"], "3 days"), "locf", out)
    for rows in first:
        write(spark, path, rows)
    early = {(r.e, r.at) for r in run().collect()}
    assert early == set()  # the newest row is of day 4, so rows before day 1 are due
    for rows in second:
        write(spark, path, rows)
    got = sorted(map(tuple, run().collect()), key=lambda r: (r[0] or "", r[1]))
    want = [
        (None, day(3), 3.0, None, None), (None, day(5), 3.0, "z", None),
        ("a", day(1), 1.0, "p", None), ("a", day(2), 1.0, "p", 5), ("a", day(3), 1.0, "q", 7), ("a", day(5), 2.0, "q", 7), ("a", day(6), 2.0, "q", 7),
        ("b", day(2), None, None, None), ("b", day(4), 4.5, None, None), ("b", day(7), 4.5, "r", None),
    ]
    assert got == want  # the second value of a's day 1 came after the watermark had passed it


def test_missing_share(spark):
    path = new_table_path(spark, "in")
    write(spark, path, [row("a", 3, 1.0), row("a", 4, None, "s"), row("b", 11, 2.0)])
    write(spark, path, [row("b", 9, None), row("b", 12)])
    write(spark, path, [row("a", 30, 1.0)])
    write(spark, path, [row("a", 31)])
    write(spark, path, [row("late", 4, 1.0), row("b", 24, 5.0)])  # day 4 lies in a closed window, day 24 in an open one
    write(spark, path, [row(None, 90)])
    shares = run_to_table(ST.missing_share_stream(source(spark, path), "at", ["x", "s"], "7 days", "6 days"), "share")
    got = {((r.window_start - START).days, r.feature): (r.n, r.missing) for r in shares.collect()}
    assert got == {
        (3, "x"): (3, 2), (3, "s"): (3, 2), (10, "x"): (2, 1), (10, "s"): (2, 2), (24, "x"): (2, 0), (24, "s"): (2, 2), (31, "x"): (1, 1), (31, "s"): (1, 1)
    }
    assert all(r.missing_share == r.missing / r.n for r in shares.collect())


def test_metrics_go_on_after_a_restart(spark):
    schema = FeatureSchema(ids=("id",), continuous=("x",), binary=("b",), order=("x", "b"))
    df = spark.range(60).select(
        "id", (F.col("id") % 2).alias("g"),
        F.struct((F.col("id") * 0.5).alias("x"), (F.col("id") % 3 == 0).cast("int").alias("b")).alias("truth"),
        F.struct((F.col("id") * 0.5 + 1).alias("x"), (F.col("id") % 2 == 0).cast("int").alias("b")).alias("pred"),
        F.struct((F.col("id") % 4 == 0).alias("x"), (F.col("id") % 5 == 0).alias("b")).alias("missing"),
    )
    folder, path = new_table_path(spark, "scored"), new_table_path(spark, "states")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet
    for lo, hi in ((0, 20), (20, 45)):
        df.filter(F.col("id").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(folder)
    part = ST.metrics_stream(stream(folder), schema, ["g"], path)
    assert part.agg(F.sum("n")).first()[0] == 2 * 45
    df.filter("id >= 45").coalesce(1).write.mode("append").parquet(folder)
    got = M.metrics_long(ST.metrics_stream(stream(folder), schema, ["g"], path), ["g"])
    want = M.score_imputation(df, schema, ["g"])
    key = lambda out: sorted((r.g, r.filter_subgroup, r.reduction, r.feature_type, r.metric_name, round(r.val, 9)) for r in out.collect())
    assert key(got) == key(want)


def test_closing_row(spark):
    df = spark.createDataFrame([row("a", 1, 1.0), row("b", 5)], SCHEMA)
    assert [tuple(r) for r in ST.closing_row(df, "at", "10 days").collect()] == [(None, day(15), None, None, None)]
