"""Queries: the forest, its scores and their evaluation; streaming windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from flowwarden import schema as S
from flowwarden.catalog.behavior import AGGREGATES, DAY, SIZE, SLIDE, WINDOWS, with_fw
from flowwarden.catalog.registry import i8, query, r6, stamp
from flowwarden.catalog.tables import fw, fw_volume
from flowwarden.operators import evaluate as V
from flowwarden.operators import features as X
from flowwarden.operators import forest as M
from flowwarden.plans import detection as D
from flowwarden.plans import training as Tr
from flowwarden.plans.ranking import exact_quantile
from flowwarden.plans.storage import materialize, new_path
from flowwarden.streaming import jobs as J

# ---- a deterministic score, label and prediction per row ----
SCORE = "(CAST(event_id * 7919 % 2003 AS DOUBLE) / CAST(2003 AS DOUBLE) - CAST(0.35 AS DOUBLE))"
JUDGED_SQL = f""", judged AS (SELECT event_id, {SCORE} AS anomaly_score, {SCORE} < 0 AS is_anomaly,
  CASE WHEN action = 'block' THEN 1 ELSE 0 END AS label, CASE WHEN {SCORE} < -0.1 THEN 1 ELSE 0 END AS predicted FROM fw)"""


def judged(spark, sf):
    rows = V.derive_label(fw(spark, sf)).withColumn("anomaly_score", F.expr(SCORE))
    return rows.withColumns({"is_anomaly": F.col("anomaly_score") < 0,
                             "predicted": (F.col("anomaly_score") < -0.1).cast("int")})


def with_judged(body: str) -> str:
    return with_fw(JUDGED_SQL + " " + body)


CELLS_SQL = """, cells AS (SELECT count(*) FILTER (label = 0 AND predicted = 0) AS tn,
  count(*) FILTER (label = 0 AND predicted = 1) AS fp, count(*) FILTER (label = 1 AND predicted = 0) AS fn,
  count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) AS total FROM judged)"""


@query("score_summary", with_judged(f"""SELECT {i8('count(*)')} AS n_samples,
  {i8('count(*) FILTER (is_anomaly)')} AS anomaly_count, {r6('count(*) FILTER (is_anomaly) / CAST(count(*) AS DOUBLE)')} AS anomaly_ratio,
  {r6('min(anomaly_score)')} AS min_score, {r6('avg(anomaly_score)')} AS mean_score,
  {r6('max(anomaly_score)')} AS max_score, {r6('stddev_pop(anomaly_score)')} AS std_score FROM judged"""))
def score_summary(spark, sf):
    return V.score_summary(judged(spark, sf))


@query("normalize_labels", with_judged(f"""SELECT event_id, {i8('label')} AS label FROM judged"""))
def normalize_labels(spark, sf):
    signed = judged(spark, sf).select("event_id", F.when(F.col("label") == 1, -1).otherwise(1).alias("label"))
    return V.normalize_labels(signed)


@query("confusion_matrix", with_judged(CELLS_SQL + " UNION ALL ".join(
    f"SELECT '{c}' AS cell, {i8(c)} AS n, {r6(f'{c} * 100.0 / total')} AS percent FROM cells"
    for c in ("tn", "fp", "fn", "tp"))))
def confusion_matrix(spark, sf):
    return V.confusion_matrix(judged(spark, sf))


METRICS_SQL = f"""{i8('tn')} AS tn, {i8('fp')} AS fp, {i8('fn')} AS fn, {i8('tp')} AS tp,
  {r6('tp / CAST(tp + fp AS DOUBLE)')} AS precision, {r6('tp / CAST(tp + fn AS DOUBLE)')} AS recall,
  {r6('2 * tp / CAST(2 * tp + fp + fn AS DOUBLE)')} AS f1_score, {r6('(tp + tn) / CAST(total AS DOUBLE)')} AS accuracy"""


@query("binary_metrics", with_judged(f"{CELLS_SQL} SELECT {METRICS_SQL} FROM cells"))
def binary_metrics(spark, sf):
    return V.binary_metrics(judged(spark, sf))


AUC_SQL = """, per AS (SELECT anomaly_score AS s, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
  FROM judged GROUP BY anomaly_score),
 ranked AS (SELECT *, sum(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) - neg AS neg_above FROM per),
 area AS (SELECT sum(pos * (neg_above + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc FROM ranked)"""


@query("auc_roc", with_judged(f"{AUC_SQL} SELECT {r6('auc')} AS auc_roc FROM area"))
def auc_roc(spark, sf):
    return V.auc_roc(judged(spark, sf))


@query("evaluation_record", with_judged(f"""{CELLS_SQL}{AUC_SQL} SELECT {METRICS_SQL}, {r6('auc')} AS auc_roc,
  {i8('total')} AS test_samples, {i8('fn + tp')} AS test_anomalies, {i8('fp + tp')} AS predicted_anomalies
FROM cells CROSS JOIN area"""))
def evaluation_record(spark, sf):
    return Tr.evaluation_record(judged(spark, sf))


@query("classification_report", with_judged(f"""{CELLS_SQL}, c AS (
  SELECT 'Normal' AS k, tn AS hit, fn AS wrong, fp AS missed, total FROM cells
  UNION ALL SELECT 'Anomaly', tp, fp, fn, total FROM cells),
 m AS (SELECT k, hit, hit / CAST(hit + wrong AS DOUBLE) AS p, hit / CAST(hit + missed AS DOUBLE) AS r,
   2 * hit / CAST(2 * hit + wrong + missed AS DOUBLE) AS f, hit + missed AS n, total FROM c)
SELECT k AS class, {r6('p')} AS precision, {r6('r')} AS recall, {r6('f')} AS f1_score, {i8('n')} AS support FROM m
UNION ALL SELECT 'accuracy', {r6('sum(hit) / CAST(max(total) AS DOUBLE)')}, {r6('sum(hit) / CAST(max(total) AS DOUBLE)')},
  {r6('sum(hit) / CAST(max(total) AS DOUBLE)')}, {i8('max(total)')} FROM m
UNION ALL SELECT 'macro avg', {r6('avg(p)')}, {r6('avg(r)')}, {r6('avg(f)')}, {i8('max(total)')} FROM m
UNION ALL SELECT 'weighted avg', {r6('sum(p * n) / sum(n)')}, {r6('sum(r * n) / sum(n)')}, {r6('sum(f * n) / sum(n)')},
  {i8('max(total)')} FROM m"""))
def classification_report(spark, sf):
    return V.classification_report(judged(spark, sf))


def _histogram_sql(bins: int, by: str | None) -> str:
    key = f"{by}, " if by else ""
    out = f"{i8('g.' + by)} AS {by}, " if by else ""
    same = f"AND c.{by} = g.{by}" if by else ""
    return with_judged(f""", g AS (SELECT {key}min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM judged {'GROUP BY ' + by if by else ''}),
 c AS (SELECT {'j.' + by + ', ' if by else ''}least(CAST(floor((anomaly_score - lo) / (hi - lo) * {bins}) AS BIGINT), {bins - 1}) AS bin, count(*) AS n
   FROM judged j JOIN g ON {f'j.{by} = g.{by}' if by else 'true'} GROUP BY ALL)
SELECT {out}{i8('b.bin')} AS bin, {r6(f'lo + b.bin * ((hi - lo) / {bins})')} AS lower,
  {r6(f'lo + (b.bin + 1) * ((hi - lo) / {bins})')} AS upper, {i8('coalesce(c.n, 0)')} AS n
FROM g CROSS JOIN range({bins}) b(bin) LEFT JOIN c ON c.bin = b.bin {same}""")


@query("score_histogram", _histogram_sql(50, None))
def score_histogram(spark, sf):
    return V.score_histogram(judged(spark, sf))


@query("score_histogram_by_label", _histogram_sql(30, "label"))
def score_histogram_by_label(spark, sf):
    return V.score_histogram(judged(spark, sf), bins=30, by="label")


@query("contamination_cut", with_judged(f"""SELECT event_id, {r6('anomaly_score - (SELECT quantile_cont(anomaly_score, 0.07) FROM judged)')} AS anomaly_score,
  {i8('CASE WHEN anomaly_score < (SELECT quantile_cont(anomaly_score, 0.07) FROM judged) THEN -1 ELSE 1 END')} AS prediction FROM judged"""))
def contamination_cut(spark, sf):
    rows = judged(spark, sf).select("event_id", F.col("anomaly_score").alias("raw_score"))
    return M.apply_offset(rows, exact_quantile(rows, "raw_score", S.CONTAMINATION)).select(
        "event_id", "anomaly_score", "prediction")


# ---- a fixed toy forest, small enough to write out in SQL ----
TOY_FEATURES = ["length", "ttl", "dst_port"]
TOY_NODES = [  # tree, node, feature, threshold, depth, size
    (0, 0, 0, 700.0, 0, 8), (0, 1, 1, 62.5, 1, 5), (0, 2, -1, 0.0, 1, 3), (0, 3, -1, 0.0, 2, 2), (0, 4, -1, 0.0, 2, 3),
    (1, 0, 2, 1024.0, 0, 8), (1, 1, -1, 0.0, 1, 6), (1, 2, 2, 20000.0, 1, 2), (1, 5, -1, 0.0, 2, 1), (1, 6, -1, 0.0, 2, 1),
]


def _c(n: int) -> str:
    return {1: "0.0", 2: "1.0"}.get(n, f"(2 * (ln({n - 1}) + 0.5772156649) - 2.0 * {n - 1} / {n})")


def toy_paths_sql() -> str:
    """The toy forest's score of a row with ``length, ttl, dst_port``."""
    return f"""-pow(2.0, -((
  CASE WHEN length <= 700 THEN CASE WHEN ttl <= 62.5 THEN 2 + {_c(2)} ELSE 2 + {_c(3)} END ELSE 1 + {_c(3)} END +
  CASE WHEN dst_port <= 1024 THEN 1 + {_c(6)} ELSE 2 + {_c(1)} END) / 2.0) / {_c(8)})"""


@query("toy_forest_scores", with_fw(f"SELECT event_id, {r6(toy_paths_sql())} AS raw_score FROM fw"))
def toy_forest_scores(spark, sf):
    nodes = spark.createDataFrame(pd.DataFrame(
        TOY_NODES, columns=["tree", "node", "feature", "threshold", "depth", "size"]))
    return M.score_samples(fw(spark, sf), nodes, TOY_FEATURES, 8).select("event_id", "raw_score")


# ---- the trained forest ----
def stored(spark, sf):
    return materialize(fw(spark, sf, "@timestamp").repartition("event_id"), "rows")


def feature_rows(spark, sf):
    rows = fw(spark, sf)
    return X.feature_table(rows, X.fit_vocabulary(rows), ["event_id"], "ts")


@query("iforest_nodes")
def iforest_nodes(spark, sf):
    return M.fit_nodes(feature_rows(spark, sf), Tr.model_columns(), "event_id")


@query("iforest_tree_checks", f"""SELECT {i8('t')} AS tree, {i8('1')} AS all_rows_end_in_leaves, {i8('1')} AS binary_tree,
  {i8('1')} AS within_depth, {i8('1')} AS within_rows FROM range({S.TREES}) r(t)""")
def iforest_tree_checks(spark, sf):
    """Every trained tree: leaves hold the root's rows, inner nodes have two children, limits hold."""
    leaf = F.col("feature") < 0
    kept = F.sum(F.when(leaf, F.col("size")).otherwise(0))
    root = F.max(F.when(F.col("node") == 0, F.col("size")))
    return iforest_nodes(spark, sf).groupBy("tree").agg(
        (kept == root).alias("all_rows_end_in_leaves"),
        (F.count("*") == 2 * F.sum(leaf.cast("int")) - 1).alias("binary_tree"),
        (F.max("depth") <= 8).alias("within_depth"), (root <= S.ROWS_PER_TREE).alias("within_rows"))


@query("iforest_score_checks", with_fw(f"SELECT event_id, {i8('1')} AS in_range, {i8('1')} AS agrees FROM fw"))
def iforest_score_checks(spark, sf):
    """Every row once, its score in range and its prediction the score's sign."""
    c = F.col
    return iforest_scores(spark, sf).select(
        "event_id", c("anomaly_score").between(-1, 1).alias("in_range"),
        (((c("prediction") == -1) == (c("anomaly_score") < 0)) & (c("is_anomaly") == (c("anomaly_score") < 0))).alias("agrees"))


@query("train_model_checks", with_fw(f"""SELECT {i8('count(*)')} AS test_samples, {i8("count(*) FILTER (action = 'block')")} AS test_anomalies,
  {i8(f'ceil((count(*) - 1) * {S.CONTAMINATION})')} AS below_threshold FROM fw"""))
def train_model_checks(spark, sf):
    """Rows and labels of the evaluation, and as many anomalies as lie below the interpolated quantile."""
    return train_model(spark, sf).select(
        "test_samples", "test_anomalies", F.col("predicted_anomalies").alias("below_threshold"))


@query("model_roundtrip", with_fw(f"""SELECT {i8('count(*)')} AS n_samples, {i8(str(len(S.MODEL_FEATURES)))} AS n_features,
  {i8(str(S.TREES))} AS n_estimators, {i8(f'least({S.ROWS_PER_TREE}, count(*))')} AS max_samples, {i8('count(*)')} AS equal_scores FROM fw"""))
def model_roundtrip(spark, sf):
    """A saved and reloaded model scores every row as before."""
    rows = stored(spark, sf)
    model, scored = Tr.fit(rows)
    path = new_path(spark, "model")
    model.save(path)
    loaded = Tr.Model.load(spark, path)
    again = Tr.score(rows, loaded, ["event_id"]).select("event_id", F.col("anomaly_score").alias("again"))
    equal = scored.join(again, "event_id").filter(F.abs(F.col("anomaly_score") - F.col("again")) < 1e-12)
    kept = ("n_samples", "n_features", "n_estimators", "max_samples")
    return equal.agg(F.count("*").alias("equal_scores")).select(
        *[F.lit(int(loaded.metadata[k])).alias(k) for k in kept], "equal_scores")


@query("score_window_checks", with_fw(f""", {WINDOWS} SELECT {i8('count(*)')} AS n, {i8('sum(total_connections)')} AS connections
  FROM (SELECT count(*) AS total_connections FROM win GROUP BY ws, src_ip HAVING count(*) >= {S.MIN_ROWS_PER_IP})"""))
def score_window_checks(spark, sf):
    """Every eligible window has a score."""
    return score_windows(spark, sf).filter(F.col("anomaly_score").isNotNull()).agg(
        F.count("*").alias("n"), F.sum("total_connections").alias("connections"))


@query("iforest_scores")
def iforest_scores(spark, sf):
    return Tr.fit(stored(spark, sf))[1]


@query("model_metadata")
def model_metadata(spark, sf):
    """Fitted, saved, loaded again, and its record read back."""
    model, _ = Tr.fit(stored(spark, sf))
    path = new_path(spark, "model")
    model.save(path)
    record = Tr.Model.load(spark, path).metadata
    kept = ("n_samples", "n_features", "n_estimators", "max_samples", "contamination", "anomaly_ratio",
            "min_score", "mean_score", "max_score", "std_score")
    return spark.createDataFrame([tuple(float(record[k]) for k in kept)], [*kept])


@query("train_model")
def train_model(spark, sf):
    return Tr.train(fw(spark, sf, "@timestamp"))[2]


@query("iforest_scores_volume")
def iforest_scores_volume(spark, sf):
    rows = fw_volume(spark, sf, "@timestamp")
    keyed = rows.withColumn("row_key", F.xxhash64(*rows.columns))
    # Only a table that is read in few parts has to be spread over the tasks.
    if keyed.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        keyed = keyed.repartition("row_key")
    return Tr.fit(materialize(keyed, "rows"), "row_key")[1]


@query("score_windows")
def score_windows(spark, sf):
    rows = stored(spark, sf)
    model, _ = Tr.fit(rows)
    return D.score_windows(rows, model, "@timestamp", SIZE, SLIDE, order=["@timestamp", "event_id"])


# ---- streaming windows agree with the batch ones ----
@query("stream_windows", with_fw(f""", {WINDOWS} SELECT {stamp('ws')} AS window_start, {stamp('ws + INTERVAL 3 DAY')} AS window_end,
  src_ip, {AGGREGATES}, {r6(f'count(*) / {3.0 * DAY}')} AS connection_rate FROM win GROUP BY ws, src_ip"""))
def stream_windows(spark, sf):
    path = new_path(spark, "stream")
    fw(spark, sf).write.parquet(f"{path}/in")
    rows = J.tail_table(spark, f"{path}/in", fw(spark, sf).schema)
    J.upsert_windows(J.behavior_stream(rows, "ts", SIZE, SLIDE), f"{path}/out", f"{path}/state").awaitTermination()
    return J.latest_windows(spark, f"{path}/out").drop("avg_data_length", "first_row")
