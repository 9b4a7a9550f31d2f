"""Feature maps and imputers as Spark ML estimators, with models that are saved and loaded.

They can be stages of a ``Pipeline``, take ``Params`` and grids of them, and persist like any Spark ML
model: numbers go into the metadata, tables (the donors of nearest neighbours) next to it as Parquet.
Fits are those of the operators they wrap.
"""

from __future__ import annotations

from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators.encode import categories_of, combine_onehots, onehot, uncombine_onehots
from lacuna.operators.impute_simple import SimpleImputer
from lacuna.operators.knn import knn_impute, knn_impute_all
from lacuna.operators.transforms import MinMaxScaler
from lacuna.schema import FeatureSchema


class _StateWriter(MLWriter):
    def __init__(self, instance: "StateModel"):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        m = self.instance
        extra = {"state": m.state, "tables": sorted(m.tables), "stages": sorted(m.stages)}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata=extra)
        for name, table in m.tables.items():
            table.write.parquet(f"{path}/{name}")
        for name, stage in m.stages.items():
            stage.write().save(f"{path}/{name}")


class _StateReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> "StateModel":
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        tables = {n: self.sparkSession.read.parquet(f"{path}/{n}") for n in metadata["tables"]}
        stages = {n: DefaultParamsReader.loadParamsInstance(f"{path}/{n}", self.sparkSession) for n in metadata["stages"]}
        model = self.kind(metadata["state"], tables, stages)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class StateModel(Model, HasInputCols, MLReadable, MLWritable):
    """A fitted model: ``state`` can be written as JSON, ``tables`` as Parquet, ``stages`` are models."""

    def __init__(self, state: dict[str, Any] | None = None, tables: dict[str, DataFrame] | None = None, stages: dict[str, Model] | None = None):
        super().__init__()
        self.state, self.tables, self.stages = state or {}, tables or {}, stages or {}

    def write(self) -> MLWriter:
        return _StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StateReader(cls)


class _Fit(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    def _made(self, model: StateModel) -> StateModel:
        """With this estimator's params and id, as Spark's own estimators do."""
        return self._copyValues(model._resetUid(self.uid) or model)


class MinMaxScale(_Fit):
    """``inputCols`` to [0, 1] by their range."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "MinMaxScaleModel":
        return self._made(MinMaxScaleModel({"bounds": MinMaxScaler.fit(dataset, self.getInputCols()).bounds}))


class MinMaxScaleModel(StateModel):
    def scaler(self) -> MinMaxScaler:
        return MinMaxScaler({c: tuple(b) for c, b in self.state["bounds"].items()})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.scaler().transform(dataset)

    def inverse(self, df: DataFrame) -> DataFrame:
        return self.scaler().inverse(df)


class OneHotEncode(_Fit):
    """``inputCols`` to indicators ``{column}_{category}`` of the categories seen."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "OneHotEncodeModel":
        return self._made(OneHotEncodeModel({"categories": categories_of(dataset, self.getInputCols())}))


class OneHotEncodeModel(StateModel):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return onehot(dataset, self.getInputCols(), self.state["categories"])


class SimpleImpute(_Fit):
    """Mean of ``inputCols``; most frequent value of ``modeCols``; whole groups of ``onehotGroups``."""

    modeCols = Param(Params._dummy(), "modeCols", "columns that take their most frequent value", TypeConverters.toListString)
    onehotGroups = Param(Params._dummy(), "onehotGroups", "member lists of one-hot groups, by name")

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, modeCols: list[str] | None = None, onehotGroups: dict | None = None):
        super().__init__()
        self._setDefault(inputCols=[], modeCols=[], onehotGroups={})
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "SimpleImputeModel":
        groups = {g: tuple(cols) for g, cols in self.getOrDefault("onehotGroups").items()}
        schema = FeatureSchema(ids=(), continuous=tuple(self.getInputCols()), categorical=tuple(self.getOrDefault("modeCols")), onehot=groups)
        return self._made(SimpleImputeModel({"fill": SimpleImputer.fit(dataset, schema).fill}))


class SimpleImputeModel(StateModel):
    modeCols, onehotGroups = SimpleImpute.modeCols, SimpleImpute.onehotGroups

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return SimpleImputer(FeatureSchema(ids=()), self.state["fill"]).transform(dataset)


class KnnImpute(_Fit):
    """Mean of the ``k`` nearest rows of the table it was fitted on; with ``codes`` the code of the nearest
    one, and the most frequent code where there is none."""

    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", TypeConverters.toString)
    codes = Param(Params._dummy(), "codes", "whether the columns hold category codes", TypeConverters.toBoolean)
    idCol = Param(Params._dummy(), "idCol", "column that tells rows apart", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, k: int = 5, weights: str = "uniform", codes: bool = False, idCol: str = "id"):
        super().__init__()
        self._setDefault(k=5, weights="uniform", codes=False, idCol="id")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "KnnImputeModel":
        cols = self.getInputCols()
        fill = F.mode if self.getOrDefault("codes") else (lambda c, _: F.avg(c))
        rest = dataset.agg(*[fill(c, True).cast("double").alias(c) for c in cols]).first().asDict()
        return self.fitted(rest, dataset)

    def fitted(self, rest: dict[str, float | None], dataset: DataFrame) -> "KnnImputeModel":
        return self._made(KnnImputeModel({"rest": dict(rest)}, {"donors": dataset.select(*self.getInputCols())}))


class KnnImputeModel(StateModel):
    k, weights, codes, idCol = KnnImpute.k, KnnImpute.weights, KnnImpute.codes, KnnImpute.idCol

    def choice(self) -> tuple[int, str]:
        return (1, "uniform") if self.getOrDefault("codes") else (self.getOrDefault("k"), self.getOrDefault("weights"))

    def columns(self) -> tuple:
        """What models have in common that can be applied together."""
        return self.getInputCols(), self.getOrDefault("codes"), self.state["rest"]

    def transform_all(self, models: list["KnnImputeModel"], dataset: DataFrame, name: str) -> DataFrame:
        """The rows once per model, its number as ``name``, from one search. This one and the ``models`` are
        fitted on the same rows, to fill numbers in the same columns."""
        choices = [m.choice() for m in models]
        return knn_impute_all(dataset, self.getInputCols(), self.tables["donors"], choices, name, rest=self.state["rest"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        codes = self.getOrDefault("codes")
        k, weights = self.choice()
        out = knn_impute(dataset, self.getInputCols(), self.getOrDefault("idCol"), self.tables["donors"], k, weights, rest=self.state["rest"])
        return out.withColumns({c: F.col(c).cast(dataset.schema[c].dataType) for c in self.getInputCols()}) if codes else out


class MixedImpute(_Fit):
    """Two imputers as one: ``numeric`` fills ``inputCols``, ``categorical`` fills ``binaryCols`` and the
    codes of the one-hot groups, which are given back as indicators.

    Both are estimators whose ``inputCols`` (and, for the categorical one, ``modeCols`` where it has
    them) are set here, or None to leave their columns alone. A parameter map may hold the params of
    either.
    """

    binaryCols = Param(Params._dummy(), "binaryCols", "two-valued columns", TypeConverters.toListString)
    onehotGroups = Param(Params._dummy(), "onehotGroups", "member lists of one-hot groups, by name")

    def __init__(self, numeric: Estimator | None = None, categorical: Estimator | None = None, inputCols: list[str] = (), binaryCols: list[str] = (), onehotGroups: dict | None = None):
        super().__init__()
        self.numeric, self.categorical = numeric, categorical
        groups = {g: list(c) for g, c in (onehotGroups or {}).items()}
        self._set(inputCols=list(inputCols), binaryCols=list(binaryCols), onehotGroups=groups)

    def copy(self, extra: dict | None = None) -> "MixedImpute":
        new = super().copy(extra)
        new.numeric, new.categorical = (e and e.copy(extra) for e in (self.numeric, self.categorical))
        return new

    def fits_with(self, others: list[Estimator]) -> bool:
        """Whether the fits differ in k and weights of nearest neighbours only, which no fit depends on."""
        if not all(isinstance(e, MixedImpute) and isinstance(e.numeric, KnnImpute) and isinstance(e.categorical, KnnImpute) for e in others):
            return False
        alike = lambda e: (e.getInputCols(), e.getOrDefault("binaryCols"), e.getOrDefault("onehotGroups"), e.numeric.getOrDefault("codes"), e.categorical.getOrDefault("codes"))
        return all(alike(e) == alike(self) for e in others)

    def fit_all(self, others: list["MixedImpute"], dataset: DataFrame) -> list["MixedImputeModel"]:
        """The fits of ``others``, of which ``fits_with`` holds, from the aggregates of this one."""
        mine, coded = self.fit(dataset), combine_onehots(dataset, self.getOrDefault("onehotGroups"))

        def fitted(name: str, estimator: KnnImpute) -> KnnImputeModel:
            stage = mine.stages[name]
            return estimator.copy({estimator.inputCols: stage.getInputCols()}).fitted(stage.state["rest"], coded)

        return [e._made(MixedImputeModel({}, {}, {n: fitted(n, x) for n, x in (("numeric", e.numeric), ("categorical", e.categorical))})) for e in others]

    def _fit(self, dataset: DataFrame) -> "MixedImputeModel":
        groups = self.getOrDefault("onehotGroups")
        coded = combine_onehots(dataset, groups)
        stages = {}
        if self.numeric is not None:
            stages["numeric"] = self.numeric.copy({self.numeric.inputCols: self.getInputCols()}).fit(coded)
        if self.categorical is not None:
            names = [*self.getOrDefault("binaryCols"), *groups]
            where = self.categorical.modeCols if self.categorical.hasParam("modeCols") else self.categorical.inputCols
            stages["categorical"] = self.categorical.copy({where: names}).fit(coded)
        return self._made(MixedImputeModel({}, {}, stages))


class MixedImputeModel(StateModel):
    binaryCols, onehotGroups = MixedImpute.binaryCols, MixedImpute.onehotGroups

    def _transform(self, dataset: DataFrame) -> DataFrame:
        groups = self.getOrDefault("onehotGroups")
        out = combine_onehots(dataset, groups)
        for name in ("numeric", "categorical"):
            if name in self.stages:
                out = self.stages[name].transform(out)
        return uncombine_onehots(out, groups, dataset.columns)

    def shares_with(self, models: list[Model]) -> bool:
        """Whether models fitted on the same rows can be applied together: they differ in k and weights of the
        numeric neighbours only."""
        if not all(isinstance(m, MixedImputeModel) and set(m.stages) == {"numeric", "categorical"} for m in models):
            return False
        if not all(isinstance(s, KnnImputeModel) for m in models for s in m.stages.values()):
            return False
        alike = lambda m: (m.getOrDefault("binaryCols"), m.getOrDefault("onehotGroups"), *(m.stages[s].columns() for s in ("numeric", "categorical")), m.stages["categorical"].choice())
        return not self.stages["numeric"].getOrDefault("codes") and all(alike(m) == alike(self) for m in models)

    def transform_all(self, models: list["MixedImputeModel"], dataset: DataFrame, name: str) -> DataFrame:
        """The rows once per model, its number as ``name``; codes are filled once."""
        return uncombine_onehots(self.codes_all(models, dataset, name), self.getOrDefault("onehotGroups"), [*dataset.columns, name])

    def codes_all(self, models: list["MixedImputeModel"], dataset: DataFrame, name: str) -> DataFrame:
        """``transform_all`` with the codes of the one-hot groups in place of their indicators."""
        out = self.stages["categorical"].transform(combine_onehots(dataset, self.getOrDefault("onehotGroups")))
        return self.stages["numeric"].transform_all([m.stages["numeric"] for m in models], out, name)
