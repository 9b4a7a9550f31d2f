"""Discretisation, nearest neighbours and chained regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from lacuna.functions.hashing import salt
from lacuna.operators.autoencoder import AutoencoderImputer
from lacuna.operators.autoencoder import swap_noise as swap
from lacuna.operators.discretize import mdl_bins as fit_mdl
from lacuna.operators.impute_simple import deck_stream, hot_deck
from lacuna.operators.joins import self_joined
from lacuna.operators.knn import knn_impute
from lacuna.operators.mice import ChainedImputer, pool_copies
from lacuna.operators.ml import KnnImpute, MinMaxScale, MixedImpute, SimpleImpute
from lacuna.operators.transforms import MinMaxScaler
from lacuna.operators.tuning import GRIDS, candidates, tune_imputer
from lacuna.plans import sql as S
from lacuna.plans import tables as T
from lacuna.plans.q_transform import BOUNDS, CTN, _scale, imputed_sql, train
from lacuna.plans.registry import query
from lacuna.schema import FeatureSchema
from lacuna.session import materialize, new_table_path


@query()
def mdl_bins(spark, d):
    """Share of the rows per learned bin."""
    df = T.mixed(spark, d)
    bins = fit_mdl(train(df), CTN, "label")
    binned = bins.transform(df.select("id", *CTN))
    names = [n for ns in bins.names().values() for n in ns]
    cells = F.array(*[F.struct(F.lit(n).alias("bin"), F.col(f"`{n}`").alias("hit")) for n in names])
    return binned.select(F.inline(cells)).groupBy("bin").agg(F.sum("hit").alias("n"))


_SC = f"{BOUNDS.replace('FROM oh', 'FROM mixed')}, sc AS (SELECT id, split, {', '.join(_scale(c) for c in CTN)} FROM mixed, bounds)"


_MEAN_OF = "list_avg(list_transform({near}, lambda p: p.v))"
_WEIGHTED = (
    "CASE WHEN min(d) = 0 THEN avg(v) FILTER (WHERE d = 0) ELSE sum(v / sqrt(d)) FILTER (WHERE d > 0) / sum(1 / sqrt(d)) FILTER (WHERE d > 0) END"
)


def _knn_sql(f: str, k: int, weighted: bool = False) -> str:
    both = {c: f"(q.{c} IS NOT NULL AND x.{c} IS NOT NULL)" for c in CTN if c != f}
    dist = " + ".join(f"CASE WHEN {b} THEN (q.{c} - x.{c}) * (q.{c} - x.{c}) ELSE 0 END" for c, b in both.items())
    n = " + ".join(f"CASE WHEN {b} THEN 1 ELSE 0 END" for b in both.values())
    near = f"min({{'d': ({dist}) * 3 / ({n}), 'v': x.{f}}}, {k})"
    of = near if weighted else _MEAN_OF.format(near=near)
    found = (
        f"SELECT q.id, {of} AS fill FROM sc q JOIN sc x ON "
        f"q.{f} IS NULL AND x.{f} IS NOT NULL AND x.split = 'train' AND ({' OR '.join(both.values())}) GROUP BY q.id"
    )
    if weighted:
        one = f"SELECT id, p.d AS d, p.v AS v FROM (SELECT id, unnest(fill) AS p FROM ({found}))"
        found = f"SELECT id, {_WEIGHTED} AS fill FROM ({one}) GROUP BY id"
    return f"n_{f} AS ({found})"


def _filled_sql(weighted: bool = False, k: int = 5) -> str:
    near = ", ".join(_knn_sql(c, k, weighted) for c in CTN)
    means = f"m AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in CTN)} FROM sc WHERE split = 'train')"
    out = ", ".join(f"round(coalesce({c}, n_{c}.fill, m_{c}), 6) AS {c}" for c in CTN)
    joins = " ".join(f"LEFT JOIN n_{c} ON sc.id = n_{c}.id" for c in CTN)
    return f"WITH {S.MIXED}, {_SC}, {near}, {means} SELECT sc.id, {out} FROM sc CROSS JOIN m {joins}"


def _knn(spark, d, weights):
    df = T.mixed(spark, d).select("id", "split", *CTN)
    scaled = MinMaxScaler.fit(train(df), CTN).transform(df)
    out = knn_impute(scaled, CTN, "id", train(scaled), k=5, weights=weights)
    return out.select("id", *[F.round(c, 6).alias(c) for c in CTN])


@query(_filled_sql())
def impute_knn(spark, d):
    return _knn(spark, d, "uniform")


@query(_filled_sql(weighted=True))
def impute_knn_distance(spark, d):
    """Neighbours weigh by the inverse of their distance; exact matches outweigh all others."""
    return _knn(spark, d, "distance")


_CATS = ["recent", "priority", "segment"]


def _nearest_code_sql(f: str) -> str:
    """One neighbour per distinct vector, ties to the smaller code."""
    both = {c: f"(q.{c} IS NOT NULL AND x.{c} IS NOT NULL)" for c in _CATS if c != f}
    dist = " + ".join(f"CASE WHEN {b} THEN (q.{c} - x.{c}) * (q.{c} - x.{c}) ELSE 0 END" for c, b in both.items())
    n = " + ".join(f"CASE WHEN {b} THEN 1 ELSE 0 END" for b in both.values())
    keys = ", ".join(f"q.{c}" for c in _CATS)
    return (
        f"n_{f} AS (SELECT {keys}, arg_min(x.{f}, (({dist}) * 3::DOUBLE / ({n}), x.{f})) AS fill "
        f"FROM (SELECT DISTINCT {', '.join(_CATS)} FROM cd) q JOIN (SELECT DISTINCT {', '.join(_CATS)} FROM cd WHERE split = 'train') x "
        f"ON q.{f} IS NULL AND x.{f} IS NOT NULL AND ({' OR '.join(both.values())}) GROUP BY {keys})"
    )


def _same(f: str) -> str:
    return " AND ".join(f"cd.{c} IS NOT DISTINCT FROM n_{f}.{c}" for c in _CATS)


@query(
    f"WITH {S.MIXED}, seg AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS code FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)), "
    f"cd AS (SELECT id, split, recent, CAST(priority AS INTEGER) - 1 AS priority, code AS segment FROM mixed LEFT JOIN seg ON segment = s), "
    f"{', '.join(map(_nearest_code_sql, _CATS))}, m AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in _CATS)} FROM cd WHERE split = 'train') "
    f"SELECT cd.id, " + ", ".join(f"coalesce(cd.{c}::DOUBLE, n_{c}.fill::DOUBLE, round(m_{c}, 6)) AS {c}" for c in _CATS)
    + " FROM cd CROSS JOIN m " + " ".join(f"LEFT JOIN n_{c} ON {_same(c)}" for c in _CATS)
)
def impute_knn_categorical(spark, d):
    """One nearest neighbour on category codes; distinct code vectors are few."""
    df = T.mixed_pair(spark, d).select("id", "split", "data.recent", "data.priority", "data.segment")
    cats = _CATS
    return knn_impute(df, cats, "id", train(df), k=1).select("id", *[F.round(c, 6).alias(c) for c in cats])


@query()
def impute_mice(spark, d):
    """Rounds of ridge regressions on the scaled numeric columns, until they settle or ten are done."""
    df = T.mixed(spark, d).select("id", "split", *CTN)
    scaled = MinMaxScaler.fit(train(df), CTN).transform(df)
    model = ChainedImputer.fit(train(scaled), "id", CTN, max_iter=10)
    return model.transform(scaled)


@query()
def impute_mice_categorical(spark, d):
    df = T.mixed_pair(spark, d).select("id", "split", "data.recent", "data.priority", "data.segment")
    model = ChainedImputer.fit(train(df), "id", [], ["recent", "priority", "segment"])
    return model.transform(df)


@query()
def impute_mice_forest(spark, d):
    """Random forests with predictive-mean matching."""
    df = T.mixed(spark, d).select("id", "split", *CTN)
    scaled = MinMaxScaler.fit(train(df), CTN).transform(df)
    model = ChainedImputer.fit(train(scaled), "id", CTN, learner="forest")
    return model.transform(scaled)


_GRID = candidates(GRIDS["knn"])


def _tuned_sql() -> str:
    """Scores on the val rows: MAAPE of each filled column, and the share of wrong codes."""
    base = _filled_sql(False, 5)
    head = base[: base.index(", n_")]  # the tables up to the scaled rows
    truth = f"struth AS (SELECT id, split, {', '.join(_scale(c) for c in CTN)}, recent, CAST(priority AS INTEGER) - 1 AS priority, segment FROM mixed_truth, bounds)"
    codes = (
        "seg AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS code FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)), "
        "cd AS (SELECT id, split, recent, CAST(priority AS INTEGER) - 1 AS priority, code AS segment FROM mixed LEFT JOIN seg ON segment = s), "
        + ", ".join(map(_nearest_code_sql, _CATS))
        + ", modes AS (SELECT " + ", ".join(f"(SELECT {c} FROM cd WHERE split = 'train' AND {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1) AS o_{c}" for c in _CATS) + ")"
    )
    wrong = [
        f"(SELECT avg(CASE WHEN coalesce(n_{c}.fill, o_{c}) = t.{'code' if c == 'segment' else c} THEN 0.0 ELSE 1.0 END) FROM cd CROSS JOIN modes "
        f"LEFT JOIN n_{c} ON {_same(c)} JOIN (SELECT * FROM struth LEFT JOIN seg ON segment = s) t ON t.id = cd.id WHERE cd.split = 'val' AND cd.{c} IS NULL)"
        for c in _CATS
    ]
    rows, tables = [], []
    for g, params in enumerate(_GRID):
        for c in CTN:
            tables.append(_knn_sql(c, params["k"], params["weights"] == "distance").replace(f"n_{c} AS", f"n{g}_{c} AS", 1))
        off = [
            f"(SELECT avg(atan(abs((t.{c} - coalesce(f.fill, m_{c})) / (t.{c} + 1e-10))) * 2 / pi()) FROM sc CROSS JOIN m LEFT JOIN n{g}_{c} f ON f.id = sc.id "
            f"JOIN struth t ON t.id = sc.id WHERE sc.split = 'val' AND sc.{c} IS NULL)"
            for c in CTN
        ]
        rows.append(f"SELECT {params['k']} AS k, '{params['weights']}' AS weights, round(-(({' + '.join(off)}) / 3 + ({' + '.join(wrong)}) / 3), 6) AS score")
    means = f"m AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in CTN)} FROM sc WHERE split = 'train')"
    scores = f"scores AS ({' UNION ALL '.join(rows)})"
    return (
        f"{head}, {truth}, {codes}, {', '.join(tables)}, {means}, {scores} "
        "SELECT *, row_number() OVER (ORDER BY score DESC, k, weights DESC) = 1 AS best FROM scores"
    )


@query(_tuned_sql())
def impute_tuned(spark, d):
    """Nearest neighbours for numbers (six candidates) and codes, tuned on the hidden cells of the val rows."""
    rows = materialize(T.onehot_pair(spark, d), "tuning")
    pair = self_joined(rows, ["id"], [[c for c in rows.columns if c not in ("id", "truth")], ["truth"]])
    scaler = MinMaxScaler.fit(train(pair), CTN)
    true = {c: F.col(f"truth.{c}") for c in T.MIXED_SCHEMA.features}
    scaled = F.struct(*[(scaler.scale(c, v) if c in CTN else v).alias(c) for c, v in true.items()])
    data = scaler.transform(pair).withColumn("truth", scaled)

    def make(params):
        return MixedImpute(KnnImpute(**params), KnnImpute(codes=True), CTN, ["recent"], T.MIXED_SCHEMA.onehot)

    tuned = tune_imputer(make, _GRID, data, "truth", T.MIXED_SCHEMA)
    rows = [(p["k"], p["weights"], round(s, 6), p == tuned.best) for p, s in tuned.scores]
    return spark.createDataFrame(rows, "k int, weights string, score double, best boolean")


@query(f"WITH {S.BOTH_OH}, {BOUNDS}, {imputed_sql('oh', "AND split = 'train'")} SELECT id, split, {', '.join(f'round({_scale(c).rsplit(" AS ", 1)[0]}, 9) AS {c}' for c in CTN)}, {', '.join(c for c in S.FEATS if c not in CTN)} FROM imp, bounds")
def ml_pipeline(spark, d):
    """Simple fills and scaling as a Spark ML pipeline, fitted, saved, loaded and applied."""
    df = T.mixed_onehot(spark, d)
    stages = [SimpleImpute(inputCols=CTN, modeCols=["recent"], onehotGroups={g: list(c) for g, c in T.MIXED_SCHEMA.onehot.items()}), MinMaxScale(inputCols=CTN)]
    path = new_table_path(spark, "ml-pipeline")
    Pipeline(stages=stages).fit(train(df)).write().save(path)
    out = PipelineModel.load(path).transform(df)
    return out.select("id", "split", *[F.round(c, 9).alias(c) if c in CTN else c for c in S.FEATS])


COPIES = 5


def _deck_sql() -> str:
    """The completed copies, column after column, as ``deck`` (copy, feature, v)."""
    parts = []
    for j, c in enumerate(CTN):
        seen = f"(SELECT {c} AS v, row_number() OVER (ORDER BY id) - 1 AS j FROM mixed WHERE {c} IS NOT NULL)"
        for k in range(COPIES):
            source = f"(SELECT {salt(deck_stream(0, k, j))}::BIGINT AS salt, id AS i, (SELECT count({c}) FROM mixed) AS n FROM mixed WHERE {c} IS NULL)"
            parts.append(f"SELECT {k} AS copy, '{c}' AS feature, {c} AS v FROM mixed WHERE {c} IS NOT NULL")
            parts.append(f"SELECT {k}, '{c}', o.v FROM {S.drawn_rows(source)} d JOIN {seen} o ON o.j = d.j")
    return " UNION ALL ".join(parts)


@query(
    f"""WITH {S.MIXED}, deck AS ({_deck_sql()}),
    e AS (SELECT feature, copy, avg(v) AS m, var_samp(v) / count(v) AS w FROM deck GROUP BY 1, 2),
    p AS (SELECT feature, count(*) AS copies, avg(m) AS mean, avg(w) AS within, var_samp(m) AS between_copies FROM e GROUP BY 1)
    SELECT feature, copies, round(mean, 6) AS mean, round(sqrt(within), 6) AS within_sd, round(sqrt(between_copies), 6) AS between_sd,
      round(sqrt(within + (1 + 1.0::DOUBLE / copies) * between_copies), 6) AS total_sd FROM p"""
)
def pooled_copies(spark, d):
    """Five completions by drawn donors, pooled: mean, and deviation within and between the copies."""
    pooled = pool_copies(hot_deck(T.mixed(spark, d).select("id", *CTN), "id", CTN, COPIES), CTN)
    sds = {f"{c}_sd": F.round(F.sqrt(c), 6) for c in ("within", "between", "total")}
    return pooled.select("feature", "copies", F.round("mean", 6).alias("mean"), *[v.alias(k) for k, v in sds.items()])


@query()
def impute_mice_boosted(spark, d):
    """Boosted trees with matching, two completed copies."""
    df = T.mixed(spark, d).select("id", "split", *CTN)
    return ChainedImputer.fit(train(df), "id", CTN, learner="boosted", copies=2).transform(df)


def _fill_report(method: str, data, truth, filled, columns: list[str]):
    """Of the filled cells of each column: how many there are, changed, left, out of range, and whether the
    error is at most 1.15 times that of the simple fill (mean or mode of the train rows; the columns are independent)."""
    keys = ["id"]
    simple = {c: (F.avg(c) if c in CTN else F.mode(c, True)).cast("double").alias(c) for c in columns}
    base = train(data).agg(*simple.values(), *[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]).first()
    side = lambda df, name: df.select(*keys, F.struct(*columns).alias(name))
    rows = side(data, "data").join(side(truth, "truth"), keys).join(side(filled, "out"), keys)
    cells = []
    for c in columns:
        old, new, want = F.col(f"data.{c}"), F.col(f"out.{c}").cast("double"), F.col(f"truth.{c}").cast("double")
        error = (lambda x: F.pow(x - want, F.lit(2.0))) if c in CTN else (lambda x: (x != want).cast("double"))
        cells.append(F.struct(
            F.lit(c).alias("feature"), old.isNull().cast("bigint").alias("filled"), (old.isNotNull() & (old.cast("double") != new)).cast("bigint").alias("changed"),
            new.isNull().cast("bigint").alias("left"), F.lit(c not in CTN).__and__(~new.between(base[f"lo_{c}"], base[f"hi_{c}"])).cast("bigint").alias("outside"),
            F.when(old.isNull(), error(new)).alias("e"), F.when(old.isNull(), error(F.lit(base[c]))).alias("e0"),
        ))
    long = rows.select(F.inline(F.array(*cells)))
    sums = [F.sum(x).alias(x) for x in ("filled", "changed", "left", "outside")]
    return long.groupBy("feature").agg(*sums, (F.sum("e") <= 1.15 * F.sum("e0")).alias("near_simple")).withColumn("method", F.lit(method))


@query(
    f"WITH {S.MIXED} "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS method, '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS filled, 0::BIGINT AS changed, 0::BIGINT AS \"left\", 0::BIGINT AS outside, true AS near_simple FROM mixed"
        for m, cs in (("mice", CTN), ("mice_categorical", _CATS)) for c in cs
    )
)
def chained_fill_report(spark, d):
    """The chains of ``impute_mice`` and ``impute_mice_categorical`` against the truth, on the original scale."""
    pair = T.mixed_pair(spark, d)
    data, truth = pair.select("id", "split", "data.*"), pair.select("id", "truth.*")
    parts = []
    for method, columns in (("mice", CTN), ("mice_categorical", _CATS)):
        mine = data.select("id", "split", *columns)
        scaler = MinMaxScaler.fit(train(mine), CTN) if method == "mice" else None
        scaled = scaler.transform(mine) if scaler else mine
        numeric, codes = (CTN, []) if scaler else ([], _CATS)
        out = ChainedImputer.fit(train(scaled), "id", numeric, codes).transform(scaled)
        if scaler:  # observed cells as they were, not scaled to and fro
            back = scaler.inverse(out).select("id", *[F.col(c).alias(f"f_{c}") for c in columns])
            out = mine.join(back, "id").select("id", *[F.coalesce(c, f"f_{c}").alias(c) for c in columns])
        parts.append(_fill_report(method, mine, truth, out, columns))
    return parts[0].unionByName(parts[1])


def _autoencoder(spark, d, preset, **changes):
    df = T.mixed_onehot(spark, d)
    scaled = MinMaxScaler.fit(train(df), CTN).transform(df)
    model = AutoencoderImputer.preset(preset, T.MIXED_SCHEMA, **changes)
    return scaled, model.fit(scaled)


@query()
def impute_ae(spark, d):
    scaled, model = _autoencoder(spark, d, "dae")
    return model.transform(scaled)


@query()
def impute_ae_discretized(spark, d):
    """Bins instead of continuous values, missing groups as uniform probabilities, then back."""
    from lacuna.operators.encode import uniform_probability

    df = T.mixed_onehot(spark, d)
    bins = fit_mdl(train(df), CTN, "label")
    schema = T.MIXED_SCHEMA.after_discretize(bins.names())
    mapped = bins.transform(df)
    groups = {**schema.onehot, **schema.bins}
    model = AutoencoderImputer.preset("ap_new", schema)
    soft = uniform_probability(mapped.select("id", "split", *[F.col(f"`{c}`") for c in schema.features]), groups, ["recent"])
    model.fit(soft, mapped)
    return bins.inverse(model.transform(mapped), df.columns)


@query()
def impute_vae(spark, d):
    df = T.mixed(spark, d).select("id", "split", "label", *CTN)
    scaled = MinMaxScaler.fit(train(df), CTN).transform(df)
    schema = FeatureSchema(ids=("id",), continuous=tuple(CTN), label="label", split="split", order=tuple(CTN))
    model = AutoencoderImputer.preset("vae", schema, hidden_layers=[2])
    return model.fit(scaled).transform(scaled)


@query(f"WITH {S.BOTH_OH} SELECT count(*) AS n, 0::BIGINT AS changed, 0::BIGINT AS missing FROM oh")
def ae_transform_keeps_observed(spark, d):
    """Observed cells changed and cells still missing: none."""
    scaled, model = _autoencoder(spark, d, "batchswap")
    filled = model.transform(scaled).select("id", F.struct(*T.MIXED_SCHEMA.features).alias("out"))
    both = scaled.join(filled, "id")
    changed, missing = F.lit(0), F.lit(0)
    for c in T.MIXED_SCHEMA.features:
        changed = changed + F.coalesce(F.col(c) != F.col(f"out.{c}"), F.lit(False)).cast("int")
        missing = missing + F.col(f"out.{c}").isNull().cast("int")
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum(changed).alias("changed"), F.sum(missing).alias("missing"))


def _swap_sql(j: int, c: str) -> str:
    numbers = f"(SELECT id, {salt(4001 + 2 * j)}::BIGINT AS salt, id AS i, (SELECT count(*) FROM numbered) AS n FROM mixed_truth)"
    return (
        f"s{j} AS (SELECT d.id, x.{c} AS v FROM {S.drawn_rows(numbers)} d JOIN numbered x ON x.row_no = d.j "
        f"WHERE {S.u(S.key('d.id', 4000 + 2 * j))} < 0.3)"
    )


@query(
    f"WITH {S.TRUTH}, numbered AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS row_no FROM mixed_truth), "
    + ", ".join(_swap_sql(j, c) for j, c in enumerate(CTN))
    + " SELECT t.id, " + ", ".join(f"CASE WHEN s{j}.id IS NULL THEN t.{c} ELSE s{j}.v END AS {c}" for j, c in enumerate(CTN))
    + " FROM mixed_truth t " + " ".join(f"LEFT JOIN s{j} ON t.id = s{j}.id" for j in range(len(CTN)))
)
def swap_noise(spark, d):
    return swap(T.mixed_truth(spark, d).select("id", *CTN), CTN, 0.3)
