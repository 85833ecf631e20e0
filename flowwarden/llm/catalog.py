"""The registered queries of this subpackage, with production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden.llm import (
    bpe, exact, fingerprint, jaccard, language, lines, mixer, mixing, negatives, ownership, substring, toxicity, whitening,
)
from flowwarden.llm.text import text_of
from flowwarden.plans.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/documents.parquet")


@query("op9_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op9(spark, sf_dir):
    return exact.exact_dedup(documents(spark, sf_dir), keep="largest")


@query("op3_line_dedup", rf"""
    WITH split AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
    host AS (SELECT source, count(DISTINCT text) AS total FROM split GROUP BY source),
    used AS (SELECT source, text, trim(unnest(ls), ' ' || chr(9) || chr(13)) AS line FROM split),
    bad AS (SELECT u.source, u.line FROM used u JOIN host h ON u.source IS NOT DISTINCT FROM h.source WHERE u.line <> ''
            GROUP BY u.source, u.line, h.total
            HAVING count(DISTINCT u.text) >= {lines.MIN_PAGES} AND count(DISTINCT u.text) / h.total > {lines.RATIO}),
    pos AS (SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM split),
    kept AS (SELECT p.doc_id, count(*) AS n_lines, count(*) FILTER (b.line IS NOT NULL) AS n_dropped,
                    string_agg(p.line, chr(10) ORDER BY p.i) FILTER (b.line IS NULL) AS t
             FROM pos p LEFT JOIN bad b ON b.source IS NOT DISTINCT FROM p.source
                  AND b.line = trim(p.line, ' ' || chr(9) || chr(13)) GROUP BY p.doc_id)
    SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped,
           sha256(coalesce(k.t, '')) AS kept_sha256
    FROM documents d LEFT JOIN kept k USING (doc_id)""")
def op3(spark, sf_dir):
    found = lines.line_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(text_of("text"), 256).alias("kept_sha256"))


# The tree of the mixture: sources are dealt to four domains by their number.
MIX_WEIGHTS = {"domain": {"d0": 3, "d1": 2, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}
MIX_FRACTION = (9, 10)
MIX_EPOCHS = 2
MIX_SEED = 17


def mix_levels() -> dict:
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]{1,9})$", 1).try_cast("int")
    return {"domain": F.concat(F.lit("d"), F.pmod(number, F.lit(4)).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def mixed(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs, mix_levels(), MIX_WEIGHTS, MIX_FRACTION, MIX_EPOCHS, MIX_SEED)


def _weight_sql(level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS[level].items()) + " ELSE 1 END"


def _level_sql(name: str, level: str, parents: list[str], above: str) -> str:
    """Shares the budget of each parent among its children, as far as each can use it."""
    path = [*parents, level]
    whole = f"PARTITION BY {', '.join(parents)}" if parents else ""
    fill = f"({whole} ORDER BY c / w, {level} ROWS UNBOUNDED PRECEDING)"
    join = f"JOIN {above} USING ({', '.join(parents)})" if parents else f"CROSS JOIN {above}"
    return f"""
    {name}_n AS (SELECT {', '.join(path)}, sum(cap)::HUGEINT AS c, any_value({_weight_sql(level)})::HUGEINT AS w FROM leaves GROUP BY {', '.join(path)}),
    {name}_s AS (SELECT n.*, b, sum(c) OVER {fill} - c AS c0, sum(w) OVER ({whole}) - sum(w) OVER {fill} + w AS wl FROM {name}_n n {join}),
    {name}_f AS (SELECT *, c * wl <= w * (b - c0) AS ok FROM {name}_s),
    {name}_o AS (SELECT *, b - coalesce(sum(c) FILTER (ok) OVER ({whole}), 0) AS bo, sum(w) FILTER (NOT ok) OVER ({whole}) AS wo,
                 coalesce(sum(w) FILTER (NOT ok) OVER {fill}, 0) AS wu FROM {name}_f),
    {name} AS (SELECT {', '.join(path)}, CASE WHEN ok THEN c ELSE wu * bo // wo - (wu - w) * bo // wo END::HUGEINT AS b FROM {name}_o)"""


MIX_SQL = rf"""
    WITH base AS (SELECT doc_id, coalesce('d' || (TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS INT) % 4), '(none)') AS domain,
                  coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
    docs AS (SELECT * FROM base WHERE n_tokens > 0),
    leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, {MIX_EPOCHS} * sum(n_tokens) AS cap FROM docs GROUP BY ALL),
    root AS (SELECT least(sum(tokens) * {MIX_FRACTION[0]} // {MIX_FRACTION[1]}, sum(cap))::HUGEINT AS b FROM leaves),
    {_level_sql("l1", "domain", [], "root").strip()},
    {_level_sql("l2", "lang", ["domain"], "l1").strip()},
    {_level_sql("l3", "source", ["domain", "lang"], "l2").strip()},
    plan AS (SELECT domain, lang, source, (b // tokens)::BIGINT AS whole, (b % tokens)::BIGINT AS rest FROM leaves JOIN l3 USING (domain, lang, source)),
    placed AS (SELECT *, md5('{MIX_SEED}:' || whole || ':' || doc_id) AS place FROM docs JOIN plan USING (domain, lang, source)),
    started AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place ROWS UNBOUNDED PRECEDING) - n_tokens AS start FROM placed),
    used AS (SELECT *, greatest(0, least(n_tokens, rest - start)) AS part FROM started)
    SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, whole + (part > 0)::BIGINT AS copies,
           (whole * n_tokens + part)::BIGINT AS tokens_used FROM used WHERE whole + (part > 0)::BIGINT > 0"""


@query("op10_mix_sources", MIX_SQL)
def op10(spark, sf_dir):
    found = mixed(documents(spark, sf_dir))
    return found.select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"),
                        F.col("mix_source").alias("source"), "n_tokens", "copies", "tokens_used")


def fold(every: int):
    """The remainder that tells held-out rows from training rows."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(every))


def language_model(docs: DataFrame) -> language.Centroids:
    return language.fit(docs.where(fold(3) != 1))


@query("op5_language_id")
def op5(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = language.identify(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def encoded(docs: DataFrame) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    vocabulary = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = bpe.encode(docs.select("doc_id", "text"), vocabulary, public_tokenizers.PATTERN).select("doc_id", "ids")
    return bpe.decode(ids, vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query("op7_byte_bpe")
def op7(spark, sf_dir):
    return encoded(documents(spark, sf_dir))


@query("op2_fingerprints")
def op2(spark, sf_dir):
    return fingerprint.edit_likeness(documents(spark, sf_dir))


@query("op8_substring_dedup")
def op8(spark, sf_dir):
    found = substring.substring_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op1_ngram_jaccard")
def op1(spark, sf_dir):
    return jaccard.jaccard_components(documents(spark, sf_dir))


@query("op4_toxicity")
def op4(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(fold(4) != 2))
    return toxicity.toxicity(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "score", "predicted")


@query("op6_lm_score")
def op6(spark, sf_dir):
    found = mixer.lm_scores(documents(spark, sf_dir).select("doc_id", "text"), fold(10) != 0)
    return found.select("doc_id", (fold(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/embeddings.parquet")


@query("op11_hard_negatives", """
    WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
          FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5""")
def op11(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(embeddings(spark, sf_dir), F.col("vec_id") % 100 == 0, moved)


def owner_of() -> Column:
    """The site of a document owns it."""
    return F.col("source")


def repository_of() -> Column:
    """The part of a site in one language stands for a repository."""
    return F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))


@query("op12_secret_scan")
def op12(spark, sf_dir):
    found = ownership.scan_secrets(documents(spark, sf_dir), owner_of(), repository_of())
    return ownership.digests(found)


@query("op13_whitening")
def op13(spark, sf_dir):
    found = whitening.whiten(embeddings(spark, sf_dir))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))
