"""Exact duplicates by a tree-merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.text import materialize, text_of

FAN = 16


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                fan: int = FAN) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Every input partition gives a sorted run of (digest, smallest identifier,
    rows).  Runs are merged ``fan`` at a time, round after round, until one is
    left; each merge keeps one entry per digest.  The winner then goes back the
    same way, from each merged run to the runs it came from, so no task ever
    holds more of one group of copies than one partition had.  An entry is
    identified by SHA-256 and verified by a second hash and the length.

    Null text counts as empty.  ``keep`` is ``smallest`` or ``largest``.  A null
    identifier ranks below every other, and of repeated rows (same identifier
    and text) one stays.  An empty table gives no rows; other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    text = text_of(text_col)
    entries = materialize(docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.xxhash64(text).alias("check"), F.octet_length(text).alias("size"),
    ), "digests")
    entries = entries.withColumn("run", F.shiftright("row", 33))
    key = ["digest", "check", "size"]
    level = entries.groupBy(*key, "run").agg(
        best(F.struct((F.col("id").isNull() if keep == "smallest" else F.col("id").isNotNull()).alias("rank"), "id", "row")).alias("best"),
        F.count(F.lit(1)).alias("n"))
    levels = [materialize(level.sortWithinPartitions("run", "digest"), "runs")]
    runs = levels[0].agg(F.max("run")).first()[0] or 0
    while runs > 0:
        merged = levels[-1].withColumn("run", F.floor(F.col("run") / fan).cast("long")).groupBy(*key, "run").agg(
            best("best").alias("best"), F.sum("n").alias("n"))
        levels.append(merged)
        runs //= fan
    won = levels[-1].select(*key, "run", "best", "n")
    for below in reversed(levels[:-1]):
        up = won.select(*key, F.col("run").alias("parent"), "best", "n")
        won = (below.select(*key, "run", F.floor(F.col("run") / fan).cast("long").alias("parent"))
               .join(up, [*key, "parent"]).select(*key, "run", "best", "n"))
    return entries.join(won, [*key, "run"]).select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
