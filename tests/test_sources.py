import json

import pytest
from pyspark.sql import functions as F

from lacuna.operators import joins as J
from lacuna.operators import metrics as M
from lacuna.operators.transforms import MinMaxScaler
from lacuna.session import materialize, shared_dir
from lacuna.sources import files as FI
from lacuna.sources.loader import FeatureSource
from lacuna.sources.synth import synth_mixed
from lacuna.streaming.incremental import read_stream, run_to_table, score_stream
from tests.data import SCHEMA, frames, wrong


def test_feather_round_trip(spark, tmp_path):
    df = spark.range(20).selectExpr("id", "id * 0.5 as x", "cast(id as string) as s")
    FI.write_feather(df, str(tmp_path / "f"))
    back = FI.read_feather(spark, str(tmp_path / "f"), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_arrow_files_split_by_record_batch(spark, tmp_path):
    df = spark.range(5000).selectExpr("id", "IF(id % 7 = 0, NULL, id * 0.5) AS x", "cast(id AS string) AS s", "array(id, NULL) AS a", "timestamp_micros(id) AS at", "cast(id AS int) AS i")
    folder = str(tmp_path / "f")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        FI.write_feather(df.coalesce(1), folder)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    (manifest,) = (tmp_path / "f" / "_manifest").glob("*.json")
    (listed,) = json.loads(manifest.read_text())["files"]
    assert listed["batches"] == 50 and listed["rows"] == 5000
    read = spark.read.format("arrowfiles").option("task_bytes", listed["bytes"] // 10).load(folder)
    assert read.rdd.getNumPartitions() >= 10 and read.schema.names == df.schema.names
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, df.collect()))
    some = spark.read.format("arrowfiles").schema("i long, id long").load(folder)  # fewer, in another order, one cast
    assert sorted(map(tuple, some.collect())) == [(k, k) for k in range(5000)]
    one = FI.read_feather(spark, f"{folder}/{listed['name']}", "x double")
    assert one.filter("x IS NULL").count() == 715
    with pytest.raises(Exception, match="no column"):
        FI.read_feather(spark, folder, "other long").collect()


def test_arrow_files_of_lost_attempts_are_not_read(spark, tmp_path):
    folder = tmp_path / "f"
    df = spark.range(10)
    FI.write_feather(df, str(folder))
    stray = next(folder.glob("part-*.arrow"))
    (folder / "part-stray.arrow").write_bytes(stray.read_bytes())
    FI.write_feather(spark.range(10, 15), str(folder), "append")
    assert sorted(r.id for r in FI.read_feather(spark, str(folder)).collect()) == list(range(15))
    FI.write_feather(spark.range(3), str(folder))
    assert sorted(r.id for r in FI.read_feather(spark, str(folder), "id long").collect()) == [0, 1, 2]
    FI.write_feather(df.limit(0), str(tmp_path / "empty"))
    back = FI.read_feather(spark, str(tmp_path / "empty"))
    assert back.columns == ["id"] and back.count() == 0
    with pytest.raises(Exception, match="FileNotFound|not found|absent"):
        FI.read_feather(spark, str(tmp_path / "absent"))


def test_read_or_build_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return frames(spark)[0], SCHEMA

    for _ in range(2):
        df, schema = FI.read_or_build(spark, str(tmp_path / "prep"), build)
    assert len(calls) == 1 and schema == SCHEMA and df.count() == 6


def test_metric_rows_and_splits(spark, tmp_path):
    path = str(tmp_path / "metrics")
    df = spark.createDataFrame([("RMSE", 0.5)], "metric_name string, val double")
    FI.append_metrics(df, path, split="test", step=3)
    with FI.timed(spark, path, "epoch_duration_sec", split="train"):
        pass
    got = {r.metric_name: (r.split, r.step) for r in spark.read.parquet(path).collect()}
    assert got == {"RMSE": ("test", 3), "epoch_duration_sec": ("train", None)}
    FI.write_splits(frames(spark)[0], str(tmp_path / "splits"))
    read = spark.read.parquet(str(tmp_path / "splits")).filter("split = 'val'")
    assert {r.id for r in read.collect()} == {2, 3}
    FI.write_evaluation(*frames(spark), SCHEMA, True, str(tmp_path / "eval"))
    assert FI.read_schema(spark, str(tmp_path / "eval/schema")) == SCHEMA
    FI.write_csv(read, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_feature_source_labels(spark):
    data, _ = frames(spark)
    labelled = data.withColumn("y", (F.col("id") % 2).cast("int"))
    by_name = FeatureSource(labelled, ["id"], "y", ["age", "weight"], split_col="split", onehot_prefixes=["fries"])
    by_position = FeatureSource(labelled, ["id"], len(labelled.columns) - 1, split_col="split")
    apart = FeatureSource(data, ["id"], labelled.select("id", "y"), split_col="split")
    want = sorted(map(tuple, labelled.select("id", "y").collect()))
    for source in (by_name, by_position, apart):
        assert sorted(map(tuple, source.labels().collect())) == want
    schema = by_name.schema()
    assert schema.onehot == {"fries": ("fries_s", "fries_m", "fries_l")} and schema.binary == ("ismale",)
    sub = FeatureSource(labelled, ["id"], "y", subgroup={"ismale": 1}).table()
    assert sub.count() == 3 and "ismale" not in sub.columns


def test_synthetic_table(spark):
    df = synth_mixed(spark, 1000)
    assert len(df.columns) == 22 and df.count() == 1000
    assert df.select("multicatB").distinct().count() == 4


def test_streams_equal_batch(spark, tmp_path):
    data, truth = frames(spark)
    frame = J.scoring_frame(truth, wrong(spark), data, ["id"], SCHEMA.features)
    frame.repartition(3).write.parquet(str(tmp_path / "frame"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "frame"))
    merged = M.metrics_long(score_stream(stream, lambda b: b, SCHEMA))
    whole = M.metrics_long(M.metric_states(frame, SCHEMA))
    key = ["filter_subgroup", "reduction", "feature_type", "metric_name"]
    a, b = ([tuple(r) for r in x.orderBy(*key).collect()] for x in (merged, whole))
    assert [r[:4] for r in a] == [r[:4] for r in b]
    assert [r[4] for r in a] == pytest.approx([r[4] for r in b])
    data.write.parquet(str(tmp_path / "data"))
    model = MinMaxScaler.fit(data, ["age"])
    out = run_to_table(model.transform(read_stream(spark, str(tmp_path / "data") + "/*.parquet")), "scaled")
    assert sorted(r.age or -1 for r in out.collect()) == sorted(r.age or -1 for r in model.transform(data).collect())


class _Session:
    """Just enough of a session to name its folder."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder}
        self.sparkContext = self
        self.master = master

    def getConf(self):
        return self.conf


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(_Session("spark://host", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        shared_dir(_Session("spark://host"))
    assert materialize(spark.range(5), "x").count() == 5
