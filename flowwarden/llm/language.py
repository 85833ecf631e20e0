"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwarden.llm.text import mix64, sealed

DIMS = 8192
SAMPLE_ROWS = 1600
CLUSTERS = 3
REJECT_SHARE = 0.6
# A centroid accepts this share of the rows set aside (one of ASIDE), less a margin; cosines grow with
# the length, so beginnings of these lengths are looked at each by itself, where there are at least so many rows.
QUANTILE, ASIDE, LEAST_ROWS = 0.02, 4, 20
BANDS = (6, 20, 60, 200, 700, 2500, 10_000, 40_000)
# Rows are thinned by their hash to this many times the rows wanted before any are ranked.
OVERSAMPLE = 4
UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


@dataclass
class Centroids:
    """Weights of the dimensions, unit centroids, their languages, and the low cosine of each by length of text."""

    idf: np.ndarray
    centre: np.ndarray
    lang: list[str]
    low: np.ndarray  # centroids x BANDS


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def counts(text: str | None) -> np.ndarray | None:
    """How often each hashed letter sequence of length one to three occurs; None without letters.

    Everything but letters counts as a space, and runs of spaces as one.
    """
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return None
    keep = letter | np.concatenate([[False], letter[:-1]])
    code = np.where(letter, code, np.uint32(32))[keep].astype(np.uint64)
    code = np.concatenate([np.full(1, 32, np.uint64), code, np.full(1, 32, np.uint64)])
    two = code[:-1] << np.uint64(21) | code[1:]
    out = np.bincount((mix64(code) & np.uint64(DIMS - 1)).astype(np.int64), minlength=DIMS)
    out += np.bincount((mix64(two | np.uint64(1 << 62)) & np.uint64(DIMS - 1)).astype(np.int64), minlength=DIMS)
    three = two[:-1] << np.uint64(21) | code[2:]
    out += np.bincount((mix64(three | np.uint64(1 << 63)) & np.uint64(DIMS - 1)).astype(np.int64), minlength=DIMS)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _vectors(batches, text_col: str, lang_col: str):
    """Logarithms of the counts of whole texts."""
    for batch in batches:
        for lang, text in zip(*(batch.column(c).to_pylist() for c in (lang_col, text_col))):
            found = counts(text)
            if found is not None:
                yield pa.RecordBatch.from_pydict({"lang": [lang], "vector": [np.log1p(found).astype(np.float16).tobytes()]})


def _cosines(batches, shared, text_col: str, lang_col: str):
    """The nearest centroid of a text's own language and its cosine, for beginnings of every length and for the whole text."""
    idf, centres = shared.value
    for batch in batches:
        rows = []
        for lang, text in zip(*(batch.column(c).to_pylist() for c in (lang_col, text_col))):
            fits = [k for k, b in enumerate(BANDS) if len(text) >= b]
            # The whole text stands at the longest length that it reaches.
            for k, part in [(k, text[:BANDS[k]]) for k in fits] + [(fits[-1] if fits else 0, text)]:
                found = counts(part)
                if found is not None and lang in centres:
                    near = (_unit((np.log1p(found) * idf)[None, :]) @ centres[lang].T)[0]
                    rows.append((lang, k, int(near.argmax()), float(near.max())))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["lang", "band", "best", "cosine"])


def _clusters(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Spherical k-means with k-means++ starts; clusters of one row go, if others are left."""
    rng = np.random.default_rng(seed)
    centre = [rows[int(np.argmax(rows @ rows.mean(axis=0)))]]
    while len(centre) < min(k, len(rows)):
        far = np.maximum(1 - (rows @ np.array(centre).T).max(axis=1), 0) ** 2
        if far.sum() < 1e-9:
            break
        centre.append(rows[rng.choice(len(rows), p=far / far.sum())])
    centres = np.array(centre)
    for _ in range(rounds):
        near = np.argmax(rows @ centres.T, axis=1)
        centres = _unit(np.array([rows[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(len(centres))]))
    size = np.bincount(np.argmax(rows @ centres.T, axis=1), minlength=len(centres))
    return centres[size > 1] if (size > 1).any() else centres[:1]


def _low(cosines: list[np.ndarray], nearest: list[np.ndarray], n: int) -> np.ndarray:
    """Of each centroid of a language the low quantile by band; a band or centroid of few rows shares its language's or the next band's."""
    out = np.full((n, len(BANDS)), np.nan)
    for k, (near, best) in enumerate(zip(cosines, nearest)):
        for j in range(n):
            own = near[best == j] if (best == j).sum() >= LEAST_ROWS else near
            if len(own):
                out[j, k] = np.quantile(own, QUANTILE, method="higher")
    for row in out:
        known = np.flatnonzero(~np.isnan(row))
        row[:] = np.interp(np.arange(len(BANDS)), known, row[known]) if len(known) else 0.0
    return out


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_rows: int = SAMPLE_ROWS, clusters: int = CLUSTERS, seed: int = 11) -> Centroids:
    """Learns centroids from at most ``sample_rows`` labelled rows, equally many per language.

    The rows of a language come first in the order of a seeded hash of their
    identifier; their whole texts are read.  One of four is set aside: the
    centroids come from the others, and beginnings of those set aside, and their
    whole texts, tell what cosines are to be expected at which length.  Only count
    vectors of the rows that make the centroids reach the driver, one of fixed
    length each; of the rows set aside tasks return cosines.  Rows without language
    or without letters are not used; without any row the model knows no language.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    held = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).limit(sample_rows).collect()
    if not held:
        return Centroids(np.zeros(DIMS, np.float32), np.zeros((0, DIMS), np.float32), [], np.zeros((0, len(BANDS))))
    each = max(1, sample_rows // len(held))
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    share = F.create_map(*[F.lit(x) for r in held for x in (r["lang"], min(1.0, OVERSAMPLE * each / r["n"]))])
    thinned = rows.where(F.pmod(F.xxhash64(h), F.lit(1 << 40)) < share[F.col(lang_col)] * float(1 << 40))
    order = W.partitionBy("lang").orderBy("h", "id")
    ids = (thinned.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), h.alias("h"))
           .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each).select("id", (F.col("rank") % ASIDE == 0).alias("aside")).collect())
    aside = [r["id"] for r in ids if r["aside"]]

    def of(chosen: list) -> DataFrame:
        found = labelled.where(F.col(id_col).isin(chosen) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
        return found.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    got = of([r["id"] for r in ids if not r["aside"]]).mapInArrow(
        partial(_vectors, text_col="text", lang_col="lang"), "lang string, vector binary").limit(sample_rows).collect()
    names = np.array([r["lang"] for r in got])
    tf = np.array([np.frombuffer(r["vector"], np.float16) for r in got], np.float32).reshape(-1, DIMS)
    del got
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))) + 1).astype(np.float32)
    tf *= idf
    tf /= np.maximum(np.linalg.norm(tf, axis=1, keepdims=True), 1e-12)
    found = {str(name): _clusters(tf[names == name], clusters) for name in sorted(set(names))}
    shared = spark.sparkContext.broadcast((idf, found))
    told = of(aside).mapInArrow(partial(_cosines, shared=shared, text_col="text", lang_col="lang"),
                                "lang string, band int, best int, cosine double").limit(sample_rows * (len(BANDS) + 1)).toPandas()
    centre, lang, low = [], [], []
    for name, centres in found.items():
        near = [told[(told["lang"] == name) & (told["band"] == k)] for k in range(len(BANDS))]
        centre += list(centres)
        lang += [name] * len(centres)
        low.append(_low([x["cosine"].to_numpy() for x in near], [x["best"].to_numpy() for x in near], len(centres)))
    return Centroids(idf, np.array(centre, np.float32).reshape(-1, DIMS), lang, np.concatenate(low) if low else np.zeros((0, len(BANDS))))


def _predict(batches, shared, text_col: str, keep: list[str], reject_share: float):
    model: Centroids = shared.value
    for batch in batches:
        lang, score, reject = [], [], []
        texts = batch.column(text_col)
        for begin in range(0, len(texts), 64):
            found = [counts(t) for t in texts[begin:begin + 64].to_pylist()]
            filled = [i for i, f in enumerate(found) if f is not None] if model.lang else []
            name, near, out = [UNKNOWN] * len(found), [0.0] * len(found), [True] * len(found)
            if filled:
                close = _unit(np.log1p(np.array([found[i] for i in filled], np.float32)) * model.idf) @ model.centre.T
                for i, row, j in zip(filled, close, close.argmax(axis=1)):
                    name[i], near[i] = model.lang[j], float(min(1.0, max(0.0, row[j])))
                    # A letter is in three sequences.
                    length = np.log(max(1, found[i].sum() / 3))
                    out[i] = bool(row[j] < reject_share * np.interp(length, np.log(BANDS), model.low[j]))
            lang += name
            score += near
            reject += out
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(reject, pa.bool_())],
            [*keep, "lang_pred", "score", "rejected"])


def identify(docs: DataFrame, model: Centroids, text_col: str = "text", reject_share: float = REJECT_SHARE) -> DataFrame:
    """The input rows with ``lang_pred``, ``score`` (cosine to the nearest centroid) and ``rejected``.

    Whole texts are counted.  A text is rejected when it is farther from its
    nearest centroid than nearly all rows set aside were at its length: cosine
    below ``reject_share`` times the low quantile of that centroid.  ``lang_pred`` is then
    still the nearest language.  Null texts and texts without a letter get
    ``und``, score 0, and are rejected; so does everything if the model knows no
    language.  Repeated rows get equal results, an empty table gives no rows,
    other columns pass through (the three result names are replaced).
    """
    fresh = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    docs, inner, keep = sealed(docs, [f.name for f in fresh])
    names = [inner[c] for c in keep]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    work = partial(_predict, shared=shared, text_col=inner[text_col], keep=names, reject_share=reject_share)
    done = docs.select(*names).mapInArrow(lambda b: work(b), T.StructType([*(docs.schema[n] for n in names), *fresh]))
    return done.toDF(*keep, *[f.name for f in fresh])
