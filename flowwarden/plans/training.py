"""From raw rows to a stored, evaluated model."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden import schema as S
from flowwarden.operators import clean as C
from flowwarden.operators import evaluate as V
from flowwarden.operators import features as X
from flowwarden.operators import forest as M
from flowwarden.plans import versions
from flowwarden.plans.ranking import exact_quantile
from flowwarden.plans.storage import materialize

PARTS = "_parts"
TABLES = ("vocabulary", "scaler", "nodes")


@dataclass
class Model:
    """Fitted state: small tables and a few numbers."""

    vocabulary: DataFrame
    scaler: DataFrame
    nodes: DataFrame
    offset: float
    rows_per_tree: int = S.ROWS_PER_TREE
    metadata: dict | None = None

    def save(self, path: str) -> None:
        """Write all parts to a folder of their own, then commit that folder as the model's newest version.

        A reader gets the version before or this one, never parts of both; the
        version before stays for readers that are at it.
        """
        spark = self.nodes.sparkSession
        number = versions.next_number(spark, path)
        folder = f"{PARTS}/{number:012d}-{uuid.uuid4().hex}"
        for name in TABLES:
            getattr(self, name).write.parquet(f"{path}/{folder}/{name}")
        state = {"folder": folder, "offset": self.offset, "rows_per_tree": self.rows_per_tree,
                 "metadata": json.loads(json.dumps(self.metadata or {}, default=str))}
        if not versions.commit(spark, path, number, state):
            raise RuntimeError(f"another writer saved version {number} of {path}")
        older = [n for n in versions.numbers(spark, path) if n < number][-1:]
        versions.forget_before(spark, path, *(older or [number]))
        for name in versions.children(spark, f"{path}/{PARTS}"):
            if int(name.split("-")[0]) < (older or [number])[0]:
                versions.remove(spark, f"{path}/{PARTS}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Model":
        newest = versions.current(spark, path)
        if newest is None:
            raise FileNotFoundError(f"no model was saved to {path}")
        state = newest[1]
        tables = [spark.read.parquet(f"{path}/{state['folder']}/{name}") for name in TABLES]
        return Model(*tables, state["offset"], state["rows_per_tree"], state["metadata"])


def model_columns() -> list[str]:
    return X.allowed_features()


def _check_keep(keep: list[str]) -> None:
    """A kept column would be scaled, or read unscaled, if a model column had its name."""
    both = sorted(set(keep) & set(model_columns()))
    if both:
        raise ValueError(f"rename the kept columns that are model columns too: {both}")


def prepare_features(df: DataFrame, vocabulary: DataFrame, scaler: DataFrame, keep: list[str],
                     ts: str = "@timestamp") -> DataFrame:
    return X.scale(X.feature_table(df, vocabulary, keep, ts), scaler)


def score(df: DataFrame, model: Model, keep: list[str], ts: str = "@timestamp") -> DataFrame:
    """Decision score and prediction per row, with the ``keep`` columns."""
    _check_keep(keep)
    table = prepare_features(df, model.vocabulary, model.scaler, keep, ts)
    raw = M.score_samples(table, model.nodes, model_columns(), model.rows_per_tree)
    return M.apply_offset(raw, model.offset).select(
        *keep, "anomaly_score", "prediction", "is_anomaly")


def fit(cleaned: DataFrame, key: str = "event_id", ts: str = "@timestamp",
        contamination: float = S.CONTAMINATION, trees: int = S.TREES,
        rows_per_tree: int = S.ROWS_PER_TREE, seed: int = S.SEED,
        keep: list[str] = ()) -> tuple[Model, DataFrame]:
    """Fit on cleaned rows.  Returns the model and the scored training rows.

    The scores are written once to the shared folder; the threshold, summary
    and evaluation all read that small table.
    """
    _check_keep([key, *keep])
    started = time.time()
    columns = model_columns()
    vocabulary = materialize(X.fit_vocabulary(cleaned), "vocabulary")
    kept = list(dict.fromkeys([key, *keep]))
    table = X.feature_table(cleaned, vocabulary, kept, ts)
    scaler = materialize(X.fit_scaler(table, columns), "scaler")
    scaled = X.scale(table, scaler)
    total = cleaned.count()
    # A tree cannot get more rows than there are; depth and expected path follow what it gets.
    rows_per_tree = max(1, min(rows_per_tree, total))
    nodes = materialize(M.fit_nodes(scaled, columns, key, trees, rows_per_tree, seed, total), "nodes")
    fitted = time.time()
    raw = materialize(
        M.score_samples(scaled, nodes, columns, rows_per_tree).select(*kept, "raw_score"), "scores")
    offset = exact_quantile(raw, "raw_score", contamination)
    scored = M.apply_offset(raw, offset).drop("raw_score")
    summary = V.score_summary(scored).first().asDict()
    metadata = {
        "n_features": len(columns), "contamination": contamination, "n_estimators": trees,
        "max_samples": rows_per_tree, "seed": seed, "fit_seconds": fitted - started, **summary,
    }
    return Model(vocabulary, scaler, nodes, offset, rows_per_tree, metadata), scored


def train(df: DataFrame, key: str = "event_id", ts: str = "@timestamp", **params):
    """Check, clean, derive features, fit, score and evaluate against the block label."""
    if not C.is_valid(df):
        raise ValueError("no rows to train on")
    cleaned = C.clean(df, ts)
    model, scored = fit(V.derive_label(cleaned), key, ts, keep=["label"], **params)
    judged = scored.withColumn("predicted", (F.col("prediction") == -1).cast("int"))
    return model, judged, evaluation_record(judged)


def evaluation_record(judged: DataFrame) -> DataFrame:
    """One row of metrics and counts for predictions with labels."""
    area = V.auc_roc(judged).scalar()
    record = V.binary_metrics(judged)
    c = F.col
    return record.select(
        "*", area.alias("auc_roc"),
        (c("tn") + c("fp") + c("fn") + c("tp")).alias("test_samples"),
        (c("fn") + c("tp")).alias("test_anomalies"),
        (c("fp") + c("tp")).alias("predicted_anomalies"),
    )
