"""Secret scans that weigh candidates by how many repositories and owners hold them.

A credential belongs to one owner; a value that many owners hold is an example
copied from a manual.  Patterns find candidates in each text, hashes of their
values are counted over the whole corpus, and the counts tell the two apart.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.text import materialize, text_of
from flowwarden.plans.joins import checked_left_join

# The patterns and least lengths of the contract, kinds in the order that spans of one start take.
ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss](?:[Ww][Oo][Rr][Dd]|[Ww][Dd]))|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
# What no pattern names but may be a credential: a long run that mixes letters and digits without a break.
LOOSE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SEGMENT = re.compile(r"[A-Za-z0-9]{16,}")
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "placeholder", "xxxx", "your", "0123456789", "abcdef", "test")
KINDS = ("assign", "access", "hex", "reused", "owned")
LIVE_BITS = 3.0
LEAST_DISTINCT = 8
WIDE_OWNERS = 3
WIDE_REPOSITORIES = 8

SPAN = "struct<kind:string,start:int,end:int,hash:string,live_looking:boolean>"


def looks_live(value: str, bits: float = LIVE_BITS) -> bool:
    """Whether a value has the spread of characters of a random one and names no placeholder."""
    counts = Counter(value)
    if len(counts) < LEAST_DISTINCT:
        return False
    low = value.lower()
    if any(p in low for p in PLACEHOLDERS):
        return False
    n = len(value)
    return math.log2(n) - sum(c * math.log2(c) for c in counts.values()) / n >= bits


def _mixed(value: str) -> bool:
    return any(sum(c.isdigit() for c in s) >= 2 and sum(c.isalpha() for c in s) >= 2 for s in SEGMENT.findall(value))


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """Kind, start, end and value of all candidates, by start and kind; ``loose`` ones overlap no others."""
    found = [("assign", *m.span(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        found += [(kind, *m.span(), m.group()) for m in pattern.finditer(text) if m.end() - m.start() >= LEAST[kind]]
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    at, reach = 0, 0
    loose = []
    for m in LOOSE.finditer(text):
        while at < len(found) and found[at][1] < m.end():
            reach = max(reach, found[at][2])
            at += 1
        if reach <= m.start() and _mixed(m.group()):
            loose.append(("loose", *m.span(), m.group()))
    return found + loose


def _scan(bits: float):
    """Candidates of each text."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                   ("hash", pa.string()), ("live_looking", pa.bool_())]))
        for batch in batches:
            rows = []
            for text in batch["text"]:
                rows.append([{"kind": k, "start": a, "end": b, "hash": xxhash.xxh3_128_hexdigest(v.encode()),
                              "live_looking": looks_live(v, bits)} for k, a, b, v in candidates(text.as_py())])
            yield pa.record_batch([batch["row"], batch["id"], batch["owner"], batch["repository"], pa.array(rows, kind)],
                                  ["row", "id", "owner", "repository", "found"])
    return of


def owner_counts(found: DataFrame) -> DataFrame:
    """``hash``, ``n_owners``, ``n_repositories``, ``n_texts`` and ``named`` (some candidate of a named kind).

    ``found`` has one row per candidate: ``hash``, ``kind``, ``owner``,
    ``repository``, ``row``.  Each step counts what the one before it made
    distinct, so a value that a third of all texts hold is summed before it moves.
    """
    by_text = found.groupBy("hash", "owner", "repository", "row").agg(F.max(F.col("kind") != "loose").alias("named"))
    by_repository = by_text.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"), F.max("named").alias("named"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("n"), F.max("named").alias("named"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("r").alias("n_repositories"),
                                        F.sum("n").alias("n_texts"), F.max("named").alias("named"))


def scan_secrets(docs: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text",
                 live_bits: float = LIVE_BITS, wide_owners: int = WIDE_OWNERS,
                 wide_repositories: int = WIDE_REPOSITORIES) -> DataFrame:
    """One row per input row: id and ``spans``, an array of candidates by start, then kind.

    A span has ``kind``, ``start`` and ``end`` (code points, end exclusive),
    ``hash`` of its value, ``n_owners``, ``n_repositories``, ``n_texts`` and a
    ``verdict``: ``example`` when at least ``wide_owners`` owners or
    ``wide_repositories`` repositories hold the value, or it does not look
    random; ``live`` when it looks random and one owner holds it; else ``shared``.

    Spans of the named kinds (assign, access, hex) always stay.  Long mixed runs
    without a name are added where the corpus speaks for them: ``reused`` when
    the value is named elsewhere and is no example, ``owned`` when it is live.

    Null text counts as empty and has no spans.  A null owner is one owner, a null
    repository one repository of its owner.  Repeated rows are rows of their own,
    rows without id too.  An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                       F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
                       F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scanned = materialize(rows.mapInArrow(
        _scan(live_bits), f"row long, id {kind}, owner string, repository string, found array<{SPAN}>"), "candidates")
    each = scanned.select("row", "owner", "repository", F.explode("found").alias("s")).select("row", "owner", "repository", "s.*")
    counts = materialize(owner_counts(each), "owners").withColumnRenamed("hash", "h")
    known = checked_left_join(each.drop("owner", "repository"), counts, [("hash", "h")])
    wide = (F.col("n_owners") >= wide_owners) | (F.col("n_repositories") >= wide_repositories) | ~F.col("live_looking")
    verdict = F.when(wide, "example").when(F.col("n_owners") == 1, "live").otherwise("shared")
    named = F.when(F.col("kind") != "loose", F.col("kind")).when(F.col("named") & (F.col("verdict") != "example"), "reused").when(
        F.col("verdict") == "live", "owned")
    known = known.withColumn("verdict", verdict).withColumn("kind", named).where(F.col("kind").isNotNull())
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    spans = known.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        "start", place.alias("place"), "end", "kind", "hash", "verdict", "n_owners", "n_repositories", "n_texts"))).alias("spans"))
    spans = spans.select(F.col("row").alias("r"), F.transform("spans", lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hash"].alias("hash"),
        s["verdict"].alias("verdict"), s["n_owners"].alias("n_owners"), s["n_repositories"].alias("n_repositories"),
        s["n_texts"].alias("n_texts"))).alias("spans"))
    joined = scanned.select("row", "id").join(spans, F.col("row") == F.col("r"), "left")
    nothing = F.array().cast(spans.schema["spans"].dataType)
    return joined.select(F.col("id").alias(id_col), F.coalesce("spans", nothing).alias("spans"))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind and verdict, and the spans as text, of the rows of :func:`scan_secrets`."""
    base = F.filter("spans", lambda s: s["kind"].isin(*LEAST))
    written = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counted = lambda field, value: F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")
    return found.select(
        id_col, *[counted("kind", k).alias(f"n_{k}") for k in KINDS], F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"), *[counted("verdict", v).alias(f"n_{v}") for v in ("live", "shared", "example")])
