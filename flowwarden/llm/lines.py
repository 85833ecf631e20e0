"""Boilerplate lines, found by how many pages of a host carry them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.text import checked_broadcast, materialize, sealed

RATIO = 0.1
MIN_PAGES = 5
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _mark(line: Column) -> Column:
    """What identifies a line: two hashes and the length of its trimmed text."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.struct(F.xxhash64(bare).alias("a"), F.hash(bare).alias("b"), F.length(bare).alias("n"))


def line_shares(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """For every host and line: ``pages`` that contain it, ``total`` pages of the host, and ``share``.

    A page is a distinct text of the host, so copies of one page count once.
    Lines are compared without blanks at their ends; empty lines are not counted.
    """
    pages = docs.where(F.col(text_col).isNotNull()).select(
        F.col(host_col).alias("host"), F.col(text_col).alias("t"),
        F.xxhash64(text_col).alias("p1"), F.xxhash64(F.col(text_col), F.lit(1)).alias("p2"))
    total = pages.select("host", "p1", "p2").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    marks = F.array_distinct(F.filter(F.transform(_lines(F.col("t")), _mark), lambda m: m["n"] > 0))
    counts = (pages.select("host", "p1", "p2", F.explode(marks).alias("line")).distinct()
              .groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")))
    small = checked_broadcast(total := materialize(total, "host-totals"))
    same = counts["host"].eqNullSafe(total["host"])
    return (counts.join(total if small is None else small, same).drop(total["host"])
            .withColumn("share", F.col("pages") / F.col("total")))


def line_dedup(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, id_col: str = "doc_id",
               host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The input rows with boilerplate lines taken out of the text, and ``n_lines``, ``n_dropped``.

    A line goes when more than ``ratio`` of its host's pages contain it and at
    least ``min_pages`` do (so that the few pages of a small host are safe).
    The lines to drop are at most (lines per page / ratio) per host; they are
    broadcast only if few in all, else joined on (host, salt), which splits a hot host.

    Null text stays null with zero lines; a null host is a host of its own.
    A text of which every line goes becomes empty.  Repeated rows stay, all
    other columns pass through (``n_lines`` and ``n_dropped`` are replaced), an
    empty table gives no rows.
    """
    docs, inner, keep = sealed(docs, ("n_lines", "n_dropped"))
    shares = line_shares(docs, inner[host_col], inner[text_col])
    drop = materialize(
        shares.where((F.col("share") > ratio) & (F.col("pages") >= min_pages))
        .groupBy("host").agg(F.collect_list("line").alias("__drop")).withColumnRenamed("host", "__host"), "boilerplate")
    rows = docs.select(*[inner[c] for c in keep])
    host = F.col(inner[host_col])
    few = checked_broadcast(drop.select(F.explode("__drop")))
    if few is not None:
        joined = rows.join(F.broadcast(drop), host.eqNullSafe(F.col("__host")), "left")
    else:
        salted = drop.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__by", F.pmod(F.xxhash64(inner[id_col], F.length(inner[text_col])), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, host.eqNullSafe(F.col("__host")) & (F.col("__by") == F.col("__salt")), "left")
    text = F.col(inner[text_col])
    hit = F.col("__drop").isNotNull()
    left = F.when(hit, F.filter(_lines(text), lambda x: ~F.array_contains(F.col("__drop"), _mark(x))))
    joined = joined.withColumn("__left", left)
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).cast("long")
    kept = F.when(hit & text.isNotNull(), F.array_join("__left", "\n")).otherwise(text)
    dropped = F.when(hit & text.isNotNull(), n_lines - F.size("__left")).otherwise(0).cast("long")
    return joined.select(*[(kept if c == text_col else F.col(inner[c])).alias(c) for c in keep],
                         n_lines.alias("n_lines"), dropped.alias("n_dropped"))
