"""Toxicity by two Kneser-Ney models, one per class, with shared backoff counts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwarden.llm.text import NOT_WORD, hash_words, materialize, mix64, text_of, sealed

PER_CLASS = 2000
OVERSAMPLE = 4
# Weight of the squares of the regression's weights (of standardised features), chosen by folds of training rows.
RIDGE = 1.0
# Discounts of counts of 1, 2 and more where the counts of counts do not give them.
DISCOUNTS = (0.75, 1.0, 1.25)
RUNS = (1, 4, 12)
FEATURES = 2 * (len(RUNS) + 1)
THRESHOLD = 0.3
_START = np.uint64(1)


@dataclass
class ClassModels:
    """Counts of the two classes (column 0 ordinary, 1 toxic), and how a likelihood ratio becomes a score."""

    words: np.ndarray       # sorted word hashes
    context: np.ndarray     # what the pairs that it begins count, by class
    follow: np.ndarray      # of these, what is left to the backoff, by class
    both: np.ndarray        # what the pairs that it begins count in both classes together, and what of it is left to the backoff
    before: np.ndarray      # distinct words before it, by class
    pairs: np.ndarray       # sorted hashes of word pairs
    pair_count: np.ndarray  # distinct words before the pair, by class
    totals: np.ndarray      # per class: distinct pairs, and what of them is left to the backoff
    shared_totals: tuple[float, float, float]  # both classes together: the same, and the number of words
    discounts: dict[str, tuple[float, float, float]]  # of counts of 1, 2 and more: n0, n1, ns of pairs, b0, b1, bs of words
    prior: float
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def _tokens(text: str) -> np.ndarray:
    return hash_words(text.encode("utf-8"), lower=True, cut=NOT_WORD)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(first) + second)


def _pairs(batches):
    for batch in batches:
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            own = _tokens(text)
            if len(own):
                led = np.concatenate([np.full(2, _START), own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), int(toxic), np.int32)), *(pa.array(led[k:k + len(own)].view(np.int64)) for k in range(3))],
                    ["toxic", "u", "v", "w"])


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What counts of 1, 2 and more lose, from how many counts are 1, 2, 3 and 4 (Chen and Goodman)."""
    if not (n1 and n2 and n3):
        return DISCOUNTS
    y = n1 / (n1 + 2 * n2)
    return tuple(min(most, max(0.1, k - (k + 1) * y * more / own)) for k, own, more, most in ((1, n1, n2, 1.0), (2, n2, n3, 2.0), (3, n3, n4, 3.0)))


def _lost(count: np.ndarray, discount: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *discount])[np.minimum(count, 3).astype(np.int64)]


def _lost_of(column: str, discount: tuple[float, float, float]) -> Column:
    n = F.col(column)
    return F.when(n >= 3, discount[2]).when(n == 2, discount[1]).when(n == 1, discount[0]).otherwise(0.0)


def log_ratio(m: ClassModels, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token: log-likelihood under the toxic model less that under the ordinary one; then the same without context and without shared counts.

    The shared backoff bounds what a word of one class tells, however often it was met; the second ratio grows with its count.
    """
    first = np.concatenate([np.full(1, _START), own[:-1]])
    at, known = _find(m.words, own)
    before = np.where(known[:, None], m.before[at], 0) if len(m.words) else np.zeros((len(own), 2))
    shared = before.sum(axis=1)
    n_shared, left, n_words = m.shared_totals
    low = (shared - _lost(shared, m.discounts["bs"]) + left / (n_words + 1)) / n_shared
    ctx, seen = _find(m.words, first)
    two, paired = _find(m.pairs, _pair(first, own))
    pair = np.where(paired[:, None], m.pair_count[two], 0) if len(m.pairs) else np.zeros((len(own), 2))
    common = np.where(seen[:, None], m.both[ctx], 0) if len(m.words) else np.zeros((len(own), 2))
    together = pair.sum(axis=1)
    together -= _lost(together, m.discounts["ns"])
    out, alone = [], []
    for c in (0, 1):
        n_pairs, left = m.totals[c]
        kept = before[:, c] - _lost(before[:, c], m.discounts[f"b{c}"])
        uni = (kept + left * low) / n_pairs
        alone.append(np.log((kept + left / (n_words + 1)) / n_pairs))
        times = np.where(seen, m.context[ctx, c], 0) if len(m.words) else np.zeros(len(own))
        back = np.where(seen, m.follow[ctx, c], 0) if len(m.words) else 0
        mid = np.where(common[:, 0] > 0, (together + common[:, 1] * uni) / np.maximum(common[:, 0], 1), uni)
        bi = (pair[:, c] - _lost(pair[:, c], m.discounts[f"n{c}"]) + back * mid) / np.maximum(times, 1)
        out.append(np.log(np.where(times > 0, bi, mid)))
    return out[1] - out[0], alone[1] - alone[0]


def features(m: ClassModels, own: np.ndarray) -> np.ndarray:
    """Of both log ratios: the mean per word of the text, and of its most toxic runs of some lengths."""
    out = []
    for ratio in log_ratio(m, own):
        total = np.concatenate([[0.0], np.cumsum(ratio)])
        widths = [min(r, len(ratio)) for r in RUNS]
        out += [ratio.mean(), *((total[w:] - total[:-w]).max() / w for w in widths)]
    return np.array(out)


def _features(batches, shared):
    for batch in batches:
        found = [(int(label), features(shared.value, own).tolist())
                 for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()) if len(own := _tokens(text))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.list_(pa.float64()))], ["toxic", "x"])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of a logistic regression with intercept, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.clip(np.linalg.solve(curve, slope), -5, 5)
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        per_class: int = PER_CLASS, seed: int = 23) -> ClassModels:
    """Learns from at most ``per_class`` labelled rows of each class, first in a seeded hash order of their ids.

    Four fifths of them are counted (whole texts), the rest fix how log ratios
    become scores, at the class shares of all labelled rows.  Several labels of
    one id count as the largest; null ids, null labels and ids without a text are left out.
    """
    labels = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        (F.max(label_col) > 0).cast("int").alias("toxic"))
    labels = materialize(labels, "labels")
    n_rows, n_toxic = labels.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = (n_toxic + 0.5) / (n_rows + 1)
    # Rows are thinned by their hash before the few that are wanted of each class are ranked.
    share = F.when(F.col("toxic") == 1, min(1.0, OVERSAMPLE * per_class / max(n_toxic, 1))).otherwise(
        min(1.0, OVERSAMPLE * per_class / max(n_rows - n_toxic, 1)))
    thinned = labels.where(F.pmod(F.xxhash64(F.lit(seed + 2), "id"), F.lit(1 << 40)) < share * float(1 << 40))
    order = W.partitionBy("toxic").orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    sample = materialize(thinned.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_class).select(
        "id", "toxic", (F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(5)) == 0).alias("aside")), "label-sample")
    texts = materialize(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(
        F.broadcast(sample), "id").select("toxic", "aside", "text"), "labelled-texts")

    pairs = texts.where("not aside").select("toxic", "text").mapInArrow(_pairs, "toxic int, u long, v long, w long")
    # A pair counts once for each word that it follows, so copies of a text add nothing.
    pairs = pairs.groupBy("u", "v", "w").agg(F.max(1 - F.col("toxic")).alias("n0"), F.max("toxic").alias("n1"))
    pairs = materialize(pairs.groupBy("v", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "word-pairs")
    pairs = pairs.withColumn("ns", F.col("n0") + F.col("n1"))

    def counts_of_counts(table: DataFrame, *names: str) -> dict[str, tuple[float, float, float]]:
        row = table.agg(*[F.count(F.when(F.col(n) == k, 1)).alias(f"{n}_{k}") for n in names for k in (1, 2, 3, 4)]).first()
        return {n: discounts(*(row[f"{n}_{k}"] for k in (1, 2, 3, 4))) for n in names}

    lost = counts_of_counts(pairs, "n0", "n1", "ns")
    by_first = pairs.groupBy(F.col("v").alias("word")).agg(
        F.sum("n0").alias("c0"), F.sum("n1").alias("c1"), F.sum(_lost_of("n0", lost["n0"])).alias("f0"), F.sum(_lost_of("n1", lost["n1"])).alias("f1"),
        F.sum("ns").alias("cs"), F.sum(_lost_of("ns", lost["ns"])).alias("fs"))
    by_second = pairs.groupBy(F.col("w").alias("word")).agg(
        F.sum((F.col("n0") > 0).cast("int")).alias("b0"), F.sum((F.col("n1") > 0).cast("int")).alias("b1"))
    words = materialize(by_first.join(by_second, "word", "full").na.fill(0).withColumn("bs", F.col("b0") + F.col("b1")), "word-counts")
    lost |= counts_of_counts(words, "b0", "b1", "bs")
    sums = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in ("b0", "b1", "bs")],
                     *[F.coalesce(F.sum(_lost_of(c, lost[c])), F.lit(0.0)).alias("v" + c) for c in ("b0", "b1", "bs")],
                     F.count(F.when(F.col("bs") > 0, 1)).alias("n_words")).first()
    all_words, all_pairs = words.toArrow(), pairs.toArrow()

    def columns(table: pa.Table, *names: str) -> np.ndarray:
        return np.column_stack([table.column(n).to_numpy() for n in names]).astype(np.float32)

    key = all_words.column("word").to_numpy().view(np.uint64)
    rank = np.argsort(key)
    pair_key = _pair(all_pairs.column("v").to_numpy().view(np.uint64), all_pairs.column("w").to_numpy().view(np.uint64))
    pair_rank = np.argsort(pair_key)
    model = ClassModels(
        key[rank], columns(all_words, "c0", "c1")[rank], columns(all_words, "f0", "f1")[rank], columns(all_words, "cs", "fs")[rank], columns(all_words, "b0", "b1")[rank],
        pair_key[pair_rank], columns(all_pairs, "n0", "n1")[pair_rank],
        np.array([[max(sums["b0"], 1), max(sums["vb0"], 1)], [max(sums["b1"], 1), max(sums["vb1"], 1)]]),
        (max(sums["bs"], 1), max(sums["vbs"], 1), sums["n_words"]), lost, prior, np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = texts.where("aside").select("toxic", "text").mapInArrow(lambda b: _features(b, shared), "toxic int, x array<double>").limit(2 * per_class).toArrow()
    x, y = np.array(held.column("x").to_pylist(), float).reshape(-1, FEATURES), held.column("toxic").to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        model.centre, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
        model.weights = _logistic((x - model.centre) / model.scale, y, weight)
    else:
        model.weights = np.array([np.log(prior / (1 - prior)), *np.zeros(FEATURES)])
    return model


def _scores(batches, shared, text_col: str, keep: list[str]):
    m = shared.value
    for batch in batches:
        out = []
        for text in batch.column(text_col).to_pylist():
            own = _tokens(text) if text else []
            if len(own):
                z = m.weights[0] + ((features(m, own) - m.centre) / m.scale) @ m.weights[1:]
                out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            else:
                out.append(float(m.prior))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.float64())], [*keep, "score"])


def toxicity(docs: DataFrame, model: ClassModels, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The input rows with ``score`` (0 to 1, higher is likelier toxic) and ``predicted`` (1 at ``threshold`` or more).

    The log-likelihoods of the whole text under both models are divided by its
    number of words, for the text and for its worst run of words.  Null texts and
    texts without words get the share of toxic rows among the labels.  Repeated
    rows get equal scores, an empty table gives no rows, other columns pass
    through (the two result names are replaced).
    """
    docs, inner, keep = sealed(docs, ("score", "predicted"))
    names = [inner[c] for c in keep]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[n] for n in names), T.StructField("score", T.DoubleType())])
    rows = docs.select(*names).mapInArrow(partial(_scores, shared=shared, text_col=inner[text_col], keep=names), schema)
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int")).toDF(*keep, "score", "predicted")
