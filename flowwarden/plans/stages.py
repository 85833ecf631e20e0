"""The forest as a stage of a ``pyspark.ml`` pipeline.

    model = Pipeline(stages=[BehaviorForest(key="event_id")]).fit(rows)
    model.write().save(path)
    PipelineModel.load(path).transform(rows)
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from flowwarden import schema as S
from flowwarden.plans import training as Tr


class _Shared(Params):
    key = Param(Params._dummy(), "key", "column whose values are unique", TypeConverters.toString)
    timeCol = Param(Params._dummy(), "timeCol", "event time column", TypeConverters.toString)
    keep = Param(Params._dummy(), "keep", "columns that the result carries beside the key", TypeConverters.toListString)

    def __init__(self, *args) -> None:
        super().__init__(*args)
        self._setDefault(key="event_id", timeCol="@timestamp", keep=[])

    def kept(self) -> list[str]:
        return list(dict.fromkeys([self.getOrDefault(self.key), *self.getOrDefault(self.keep)]))


class BehaviorForest(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Fits vocabulary, scaling, forest and threshold on cleaned rows; see ``training.fit``."""

    contamination = Param(Params._dummy(), "contamination", "share of anomalies", TypeConverters.toFloat)
    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    rowsPerTree = Param(Params._dummy(), "rowsPerTree", "rows a tree is grown from", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the samples and cuts", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, key="event_id", timeCol="@timestamp", keep=None, contamination=S.CONTAMINATION, trees=S.TREES,
                 rowsPerTree=S.ROWS_PER_TREE, seed=S.SEED) -> None:
        super().__init__()
        self._setDefault(contamination=S.CONTAMINATION, trees=S.TREES, rowsPerTree=S.ROWS_PER_TREE, seed=S.SEED)
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._set(**given)

    def _fit(self, dataset: DataFrame) -> BehaviorForestModel:
        get = self.getOrDefault
        state, _ = Tr.fit(dataset, get(self.key), get(self.timeCol), get(self.contamination), get(self.trees),
                          get(self.rowsPerTree), get(self.seed))
        return self._copyValues(BehaviorForestModel(state))


class _StateWriter(MLWriter):
    def __init__(self, model: BehaviorForestModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        """The state is committed as a whole before the description that a pipeline looks for."""
        self.model.state.save(path)
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)


class _StateReader(MLReader):
    def load(self, path: str) -> BehaviorForestModel:
        described = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = BehaviorForestModel(Tr.Model.load(self.sparkSession, path))
        model._resetUid(described["uid"])
        DefaultParamsReader.getAndSetParams(model, described)
        return model


class BehaviorForestModel(Model, _Shared, MLReadable, MLWritable):
    """Adds score, prediction and flag to rows, with the key and the columns to keep."""

    def __init__(self, state: Tr.Model | None = None) -> None:
        super().__init__()
        self.state = state

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return Tr.score(dataset, self.state, self.kept(), self.getOrDefault(self.timeCol))

    def write(self) -> MLWriter:
        return _StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StateReader()


def load_forest(spark: SparkSession, path: str) -> BehaviorForestModel:
    """A saved model without a pipeline around it."""
    return BehaviorForestModel.read().session(spark).load(path)
