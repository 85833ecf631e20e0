"""How well scores and predictions match the labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.plans.joins import checked_left_join
from flowwarden.plans.ranking import running_sums

LEAK_NOTE = "the label is an input of the model; figures on the training rows are not a forecast"


def derive_label(df: DataFrame, action: str = "action") -> DataFrame:
    return df.withColumn("label", F.coalesce(F.col(action) == "block", F.lit(False)).cast("int"))


def normalize_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Labels from {−1, 1} become {1, 0}; others are left as they are."""
    signed = df.agg(F.bool_and(F.col(label).isin(-1, 1))).scalar()
    return df.withColumn(label, F.when(signed, (F.col(label) == -1).cast("int"))
                         .otherwise(F.col(label)).cast("int"))


def seeded_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42):
    """Train and test rows by a hash of the key, the same on any cluster."""
    part = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000))
    cut = int(test_share * 10_000)
    return df.filter(part >= cut), df.filter(part < cut)


def _cells(label: str, predicted: str) -> list[Column]:
    y, p = F.col(label), F.col(predicted)
    return [
        F.count(F.when((y == a) & (p == b), 1)).alias(name)
        for name, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    ]


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def confusion_counts(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.agg(*_cells(label, predicted))


def confusion_matrix(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row per cell with its count and percentage of all rows."""
    counts = confusion_counts(df, label, predicted).withColumn(
        "total", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    long = counts.unpivot(["total"], ["tn", "fp", "fn", "tp"], "cell", "n")
    return long.select("cell", "n", (_share(F.col("n"), F.col("total")) * 100).alias("percent"))


def binary_metrics(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and accuracy with the four counts; no positives give 0."""
    c = F.col
    counts = confusion_counts(df, label, predicted)
    return counts.select(
        "tn", "fp", "fn", "tp",
        _share(c("tp"), c("tp") + c("fp")).alias("precision"),
        _share(c("tp"), c("tp") + c("fn")).alias("recall"),
        _share(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1_score"),
        _share(c("tp") + c("tn"), c("tn") + c("fp") + c("fn") + c("tp")).alias("accuracy"),
    )


def auc_roc(df: DataFrame, score: str = "anomaly_score", label: str = "label") -> DataFrame:
    """Area under the curve of the negated score, ties at half weight; 0 with one class only.

    Rows are counted per distinct score first; the running count over the
    distinct scores is spread over tasks.
    """
    c = F.col
    per_score = df.filter(c(score).isNotNull()).groupBy(c(score).cast("double").alias("s")).agg(
        F.count(F.when(c(label) == 1, 1)).alias("pos"),
        F.count(F.when(c(label) == 0, 1)).alias("neg"),
    )
    ranked = running_sums(per_score, "s", {"neg_upto": "neg"})
    # A positive is ranked right against every negative with a higher score.
    wins = F.sum(c("pos").cast("double") * (F.lit(0.5) * c("neg") - c("neg_upto")))
    positives, negatives = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    return ranked.agg(F.coalesce(F.try_divide(
        wins + positives * negatives, positives * negatives), F.lit(0.0)).alias("auc_roc"))


def classification_report(df: DataFrame, label: str = "label", predicted: str = "predicted",
                          names: tuple[str, str] = ("Normal", "Anomaly")) -> DataFrame:
    """Per class, then accuracy, macro and weighted averages."""
    c = F.col
    counts = confusion_counts(df, label, predicted)
    parts = counts
    for i, (hit, wrong, missed) in enumerate((("tn", "fn", "fp"), ("tp", "fp", "fn"))):
        parts = parts.withColumns({
            f"p{i}": _share(c(hit), c(hit) + c(wrong)),
            f"r{i}": _share(c(hit), c(hit) + c(missed)),
            f"f{i}": _share(2 * c(hit), 2 * c(hit) + c(wrong) + c(missed)),
            f"n{i}": c(hit) + c(missed),
        })
    total = c("n0") + c("n1")
    accuracy = _share(c("tn") + c("tp"), total)

    def line(name: str, p: Column, r: Column, f: Column, n: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1_score"), n.cast("bigint").alias("support"))

    def macro(x: str) -> Column:
        return (c(f"{x}0") + c(f"{x}1")) / 2

    def weighted(x: str) -> Column:
        return _share(c(f"{x}0") * c("n0") + c(f"{x}1") * c("n1"), total)

    lines = [line(names[i], c(f"p{i}"), c(f"r{i}"), c(f"f{i}"), c(f"n{i}")) for i in (0, 1)]
    lines.append(line("accuracy", accuracy, accuracy, accuracy, total))
    lines.append(line("macro avg", macro("p"), macro("r"), macro("f"), total))
    lines.append(line("weighted avg", weighted("p"), weighted("r"), weighted("f"), total))
    return parts.select(F.inline(F.array(*lines)))


def score_summary(df: DataFrame, score: str = "anomaly_score",
                  is_anomaly: str = "is_anomaly") -> DataFrame:
    anomalies = F.count(F.when(F.col(is_anomaly), 1))
    return df.agg(
        F.count("*").alias("n_samples"), anomalies.alias("anomaly_count"),
        _share(anomalies, F.count("*")).alias("anomaly_ratio"),
        F.min(score).alias("min_score"), F.avg(score).alias("mean_score"),
        F.max(score).alias("max_score"), F.stddev_pop(score).alias("std_score"),
    )


def score_histogram(df: DataFrame, score: str = "anomaly_score", bins: int = 50,
                    by: str | None = None) -> DataFrame:
    """Equal-width bins over the score range (per group with ``by``), empty bins included.

    The last bin holds the maximum; a constant column gets a range of width 1
    around its value.
    """
    keys = [by] if by else []
    rows = df.filter(F.col(score).isNotNull()).select(*keys, F.col(score).cast("double").alias("s"))
    edges = rows.groupBy(*keys).agg(F.min("s").alias("a"), F.max("s").alias("b")).select(
        *keys,
        F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("low"),
        F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("high"),
    )
    if by:
        # Groups are few (labels); beyond the bound the rows are salted, so no group meets in one task.
        named = edges.withColumnRenamed(by, "_by")
        placed = checked_left_join(rows.filter(F.col(by).isNotNull()), named, [(by, "_by")]).drop("_by")
        low, high = F.col("low"), F.col("high")
    else:
        placed = rows
        low, high = edges.select("low").scalar(), edges.select("high").scalar()
    place = F.floor((F.col("s") - low) / (high - low) * bins)
    counts = placed.groupBy(*keys, F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count("*").alias("n"))
    grid = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("high") - F.col("low")) / bins
    return grid.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("low") + F.col("bin") * width).alias("lower"),
        (F.col("low") + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
