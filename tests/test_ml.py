"""Estimators in pipelines, saved and loaded models, the mixed imputer and tuning."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from lacuna.operators import knn, ml
from lacuna.operators.tuning import GRIDS, candidates, masked_score, tune_imputer
from lacuna.schema import FeatureSchema

SCHEMA = FeatureSchema(ids=("id",), continuous=("a", "b"), binary=("yes",), onehot={"c": ("c_x", "c_y", "c_z")}, split="split", order=("a", "b", "yes", "c_x", "c_y", "c_z"))


def table(spark, n=240):
    """b follows a, yes and the group follow a too; every third cell or so is hidden."""
    u = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) / 1000.0
    truth = spark.range(n).select("id", u(1).alias("a")).withColumns({"b": F.col("a") * 2 + u(2) / 50, "yes": (F.col("a") > 0.5).cast("int"), "g": F.floor(F.col("a") * 3).cast("int")})
    truth = truth.select("id", F.when(F.col("id") % 4 == 0, "val").when(F.col("id") % 4 == 1, "test").otherwise("train").alias("split"), "a", "b", "yes", *[(F.col("g") == i).cast("int").alias(f"c_{k}") for i, k in enumerate("xyz")])
    hide = lambda c, s: F.when(u(s) >= 0.25, F.col(c)).alias(c)
    data = truth.select("id", "split", "a", hide("b", 5), hide("yes", 6), *[hide(f"c_{k}", 7) for k in "xyz"])
    return data, truth


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_saved_models_transform_alike(spark, tmp_path):
    data, _ = table(spark)
    coded = data.withColumn("word", F.when(F.col("id") % 5 > 0, F.format_string("w%d", F.col("id") % 3)))
    made = [
        ml.MinMaxScale(inputCols=["a", "b"]),
        ml.OneHotEncode(inputCols=["word"]),
        ml.SimpleImpute(inputCols=["b"], modeCols=["yes"], onehotGroups={"c": ["c_x", "c_y", "c_z"]}),
        ml.KnnImpute(inputCols=["a", "b"], k=3, weights="distance"),
        ml.KnnImpute(inputCols=["yes", "c_x"], codes=True),
        ml.MixedImpute(ml.KnnImpute(k=3), ml.SimpleImpute(), ["a", "b"], ["yes"], SCHEMA.onehot),
    ]
    for i, estimator in enumerate(made):
        model = estimator.fit(coded)
        model.write().save(str(tmp_path / f"m{i}"))
        back = type(model).load(str(tmp_path / f"m{i}"))
        assert back.uid == model.uid and rows(back.transform(coded)) == rows(model.transform(coded))
        assert type(model).__name__ == type(estimator).__name__ + "Model" and back.getInputCols() == model.getInputCols()
        with pytest.raises(Exception, match="exists"):
            model.write().save(str(tmp_path / f"m{i}"))


def test_pipeline_round_trip(spark, tmp_path):
    data, _ = table(spark)
    stages = [ml.MixedImpute(ml.SimpleImpute(), ml.KnnImpute(codes=True), ["a", "b"], ["yes"], SCHEMA.onehot), ml.MinMaxScale(inputCols=["a", "b"])]
    model = Pipeline(stages=stages).fit(data)
    model.write().overwrite().save(str(tmp_path / "p"))
    back = PipelineModel.load(str(tmp_path / "p"))
    out = back.transform(data)
    assert rows(out) == rows(model.transform(data)) and out.columns == data.columns
    assert out.filter(" OR ".join(f"{c} IS NULL" for c in out.columns)).isEmpty()
    assert out.filter("c_x + c_y + c_z <> 1").isEmpty()
    first = ml.MinMaxScale(inputCols=["a", "b"])
    first.write().save(str(tmp_path / "e"))
    assert ml.MinMaxScale.load(str(tmp_path / "e")).getInputCols() == ["a", "b"]


def test_mixed_imputer_takes_any_pair_and_param_grids(spark):
    data, truth = table(spark)
    knn = ml.KnnImpute(k=2)
    mixed = ml.MixedImpute(knn, None, ["a", "b"], ["yes"], SCHEMA.onehot)
    out = mixed.fit(data).transform(data)
    assert out.filter("b IS NULL").isEmpty() and out.filter("yes IS NULL").count() == data.filter("yes IS NULL").count()
    grid = ParamGridBuilder().addGrid(knn.k, [1, 5]).build()
    one, five = (mixed.fit(data, p).transform(data) for p in grid)
    assert not one.exceptAll(five).isEmpty()
    assert one.join(data.filter("b IS NOT NULL").select("id", F.col("b").alias("was")), "id").filter("b <> was").isEmpty()


def test_tuning_picks_the_best_candidate_and_refits(spark):
    data, truth = table(spark)
    make = lambda p: ml.MixedImpute(ml.KnnImpute(**p), ml.KnnImpute(codes=True), ["a", "b"], ["yes"], SCHEMA.onehot)
    grid = [{"k": 100}, *candidates({"k": [3], "weights": ["uniform", "distance"]})]
    tuned = tune_imputer(make, grid, data, truth, SCHEMA, parallelism=2)
    scores = dict((repr(p), s) for p, s in tuned.scores)
    assert tuned.best != {"k": 100} and scores[repr(tuned.best)] == max(scores.values()) and len(scores) == 3
    donors = tuned.model.stages["numeric"].tables["donors"]
    assert donors.count() == data.filter("split <> 'test'").count()
    assert tune_imputer(make, grid, data, None, SCHEMA).best == {"k": 100}
    ties = tune_imputer(make, grid, data, truth, SCHEMA, score=lambda *_: 1.0)
    assert ties.best == {"k": 100}
    none = tune_imputer(make, grid, data, truth, SCHEMA, score=lambda filled, *_: None)
    assert none.best == {"k": 100} and [s for _, s in none.scores] == [None] * 3
    with pytest.raises(ValueError):
        tune_imputer(make, [], data, truth, SCHEMA)


def test_candidates_share_one_search(spark, monkeypatch):
    data, truth = table(spark)
    make = lambda p: ml.MixedImpute(ml.KnnImpute(**p), ml.KnnImpute(codes=True), ["a", "b"], ["yes"], SCHEMA.onehot)
    grid = candidates({"k": [1, 3, 9], "weights": ["uniform", "distance"]})
    searches, found = [], knn._found
    monkeypatch.setattr(knn, "_found", lambda *a: searches.append(1) or found(*a))
    together = tune_imputer(make, grid, data, truth, SCHEMA)
    assert len(searches) == 2  # numbers and codes
    alone = tune_imputer(make, grid, data, truth, SCHEMA, score=lambda *a: masked_score(*a))
    assert len(searches) == 2 + 2 * len(grid) and together.best == alone.best
    assert [s for _, s in together.scores] == pytest.approx([s for _, s in alone.scores])


def test_candidates_share_fits_and_compare_codes(spark, monkeypatch):
    from lacuna.operators import tuning

    data, truth = table(spark)
    make = lambda p: ml.MixedImpute(ml.KnnImpute(**p), ml.KnnImpute(codes=True), ["a", "b"], ["yes"], SCHEMA.onehot)
    grid = candidates({"k": [1, 3], "weights": ["uniform", "distance"]})
    fits, schemas, fit, metric = [], [], ml.KnnImpute._fit, tuning.tune_metric
    monkeypatch.setattr(ml.KnnImpute, "_fit", lambda self, df: fits.append(1) or fit(self, df))
    monkeypatch.setattr(tuning, "tune_metric", lambda frame, schema, by: schemas.append(schema) or metric(frame, schema, by))
    tune_imputer(make, grid, data, truth, SCHEMA)
    assert len(fits) == 4  # numbers and codes, of the candidates and of the best one
    assert [s.onehot for s in schemas] == [{}]  # no arg-max over members in every term of every candidate


def test_truth_beside_the_data_scores_as_a_table(spark):
    """Ids that repeat pair each row of the one side with each of the other; rows without id have no partner."""
    data, truth = table(spark)
    odd = lambda df, b: df.unionByName(df.filter("id % 16 = 0").withColumn("b", F.lit(b))).withColumn("id", F.when(F.col("id") % 20 != 8, F.col("id")))
    both = odd(data, 0.25).withColumn("n", F.monotonically_increasing_id()).join(odd(truth, 1.5).select("id", F.struct(*SCHEMA.features).alias("truth")), "id")
    both = both.drop("n").localCheckpoint()
    make = lambda p: ml.MixedImpute(ml.KnnImpute(**p), ml.KnnImpute(codes=True), ["a", "b"], ["yes"], SCHEMA.onehot)
    grid = candidates({"k": [1, 4], "weights": ["uniform", "distance"]})
    beside = tune_imputer(make, grid, both, "truth", SCHEMA)
    apart = tune_imputer(make, grid, both.drop("truth"), both.select("id", "truth.*"), SCHEMA)
    assert [s for _, s in beside.scores] == pytest.approx([s for _, s in apart.scores])
    assert tune_imputer(make, grid, both, "truth", SCHEMA, score=lambda *a: masked_score(*a)).best == apart.best


def test_rows_without_gaps_are_spread(spark):
    df = spark.range(1000).selectExpr("id", "id * 1.0D AS a", "IF(id % 10 = 0, NULL, id * 2.0D) AS b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = knn.knn_impute(df, ["a", "b"], "id", df, 1)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 1000 and max(sizes) < 600


def test_grids():
    assert candidates({}) == [{}] and len(candidates(GRIDS["knn"])) == 6 and len(candidates(GRIDS["mice"])) == 6


def test_training_rows_are_spread(spark, monkeypatch):
    from lacuna.operators import predict as P

    monkeypatch.setattr(P, "TRAIN_ROWS", 100)
    df = spark.range(0, 1000, 1, 1).selectExpr("id", "cast(id % 2 as int) as label", "id % 2 + id % 3 as x", "'train' as split")
    weighted = P.balanced_weights(df, "label")  # not shuffled by label
    assert "BroadcastHashJoin" in weighted._jdf.queryExecution().executedPlan().toString()
    seen = []
    make = P.make_classifier

    def spied(*args, **params):
        clf = make(*args, **params)
        fit = clf._fit
        clf._fit = lambda rows: (seen.append(rows.rdd.getNumPartitions()), fit(rows))[1]
        clf.copy = lambda extra=None: clf
        return clf

    monkeypatch.setattr(P, "make_classifier", spied)
    out = P.fit_predict(df, ["x"], "lr")
    assert seen == [10] and out.count() == 1000
