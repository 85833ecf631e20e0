"""Document fingerprints: one-permutation MinHash, densified, low bits only; all in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowwarden.llm.text import materialize, text_of

SHINGLE = 5
BIN_BITS = 8
LOW_BITS = 4
DIRECT_PROBES = 6
_WHITE = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, words: int = SHINGLE) -> Column:
    """Hashes of all runs of ``words`` words, lower case; of the whole sequence if it is shorter."""
    bare = F.btrim(F.lower(text), F.lit(_WHITE))
    hashes = F.transform(F.split(bare, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))

    def run(h: Column) -> Column:
        def at(i: Column) -> Column:
            return F.xxhash64(*[F.get(h, i + k) for k in range(words)])
        return F.when(F.size(h) < words, F.array(F.xxhash64(h))).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0))), at))

    return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(let(hashes, run))


def fingerprint(text: Column, words: int = SHINGLE, bin_bits: int = BIN_BITS) -> Column:
    """``2 ** bin_bits`` hexadecimal digits, each the four low bits of one bin's smallest hash; ``''`` without words.

    Each hash is used once: its high bits choose the bin.  An empty bin takes
    the value of another one, found by probing all bins in an order drawn from
    the empty bin's number alone (optimal densification), so equal sets agree
    in it and the likeness stays unbiased.
    """
    bins = 1 << bin_bits

    def bin_of(x: Column) -> Column:
        return F.shiftrightunsigned(x, 64 - bin_bits).cast("int")

    def probe(j: Column, attempt: Column) -> Column:
        low = F.lit(bins - 1).cast("long")
        seed = F.xxhash64(F.lit(29), j)
        step = F.shiftrightunsigned(seed, 32).bitwiseOR(F.lit(1).cast("long")).bitwiseAND(low)
        return (seed.bitwiseAND(low) + step * attempt).bitwiseAND(low).cast("int")

    def later(values: Column, j: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(DIRECT_PROBES), F.lit(bins - 1)), F.lit(None).cast("bigint"),
                           lambda found, a: F.coalesce(found, F.get(values, probe(j, a))))

    def filled(values: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda j: F.coalesce(
            F.get(values, j), *[F.get(values, probe(j, F.lit(a))) for a in range(DIRECT_PROBES)], later(values, j)))

    def digits(values: Column) -> Column:
        return F.array_join(F.transform(filled(values), lambda v: F.substring(
            F.lit("0123456789abcdef"), v.bitwiseAND(F.lit(15).cast("long")).cast("int") + 1, 1)), "")

    def from_smallest(smallest: Column) -> Column:
        table = F.map_from_arrays(F.transform(smallest, bin_of), smallest)
        return let(table, lambda m: let(
            F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda j: F.element_at(m, j)), digits))

    def from_sorted(ordered: Column) -> Column:
        return let(F.filter(ordered, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(ordered, i - 1)))), from_smallest)

    hashes = shingle_hashes(text, words)
    return let(F.sort_array(hashes), lambda h: F.when(F.size(h) == 0, F.lit("")).otherwise(from_sorted(h)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two fingerprints, 0 to 1.

    The share of equal digits, corrected for digits that are equal by chance.
    Without words on both sides 1, on one side 0.
    """
    equal = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda same: same))
    chance = 1.0 / (1 << LOW_BITS)
    share = (equal / F.length(a) - F.lit(chance)) / F.lit(1 - chance)
    return F.when((a == "") & (b == ""), F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_chars`` and ``fingerprint`` of the whole text.

    Null text counts as empty.  Rows are independent: repeated rows give equal
    fingerprints, an empty table none, and other columns are ignored.
    """
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias(id_col), F.length(text).cast("long").alias("n_chars"), fingerprint(text).alias("fingerprint"))


def followers(keys: DataFrame) -> DataFrame:
    """``keys`` (id, h, n; distinct) with the key that follows in descending order of id, the last followed by the first.

    The rows are range-partitioned by id; only the first row of each partition
    is looked at across partitions.  Null ids come last, equal ids are ordered by hash.
    """
    down = [F.col("id").desc_nulls_last(), F.col("h"), F.col("n")]
    placed = materialize(keys.orderBy(*down).withColumn("part", F.spark_partition_id()), "key-order")
    inside = W.partitionBy("part").orderBy(*down)
    me = F.struct("id", "h", "n")
    placed = placed.withColumn("next", F.lead(me).over(inside)).withColumn("place", F.row_number().over(inside))
    edge = W.orderBy("part")
    edges = placed.where("place = 1").select("part", me.alias("head"))
    whole = edge.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    edges = edges.select(F.col("part").alias("edge_part"), F.coalesce(F.lead("head").over(edge), F.first("head").over(whole)).alias("head"))
    return placed.join(F.broadcast(edges), F.col("part") == F.col("edge_part")).select(
        "id", "h", "n", F.coalesce("next", "head").alias("next")).select(
        "id", "h", "n", F.col("next.id").alias("next_id"), F.col("next.h").alias("next_h"))


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last third (rounded down) replaced by as much of the
    beginning of the next text in descending order of id.  Columns: id,
    ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``.

    Each text is fingerprinted once and moved once by its key; what the text
    before it needs of it (a third of that text's length) is moved once more.

    Null text counts as empty.  A lone text is followed by itself; rows with
    equal id are ordered by text hash; repeated rows (same id and text) share
    one place and give equal rows; null ids come last.  An empty table gives no
    rows; other columns are ignored.
    """
    text = text_of(text_col)
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    own = materialize(base.select("id", "h", F.length("text").alias("n"), fingerprint(F.col("text")).alias("fp")), "fingerprints")
    order = followers(own.select("id", "h", "n").distinct())
    order = materialize(order, "followers")

    def same(left: DataFrame, a: str, b: str, right: DataFrame) -> Column:
        return left[a].eqNullSafe(right["id"]) & (left[b] == right["h"])

    asked = order.select(F.col("id").alias("to_id"), F.col("h").alias("to_h"), F.col("next_id"), F.col("next_h"), F.floor(F.col("n") / 3).cast("int").alias("k"))
    heads = asked.join(base, same(asked, "next_id", "next_h", base)).select(
        "to_id", "to_h", "k", F.substring(F.col("text"), F.lit(1), F.col("k")).alias("head")).dropDuplicates(["to_id", "to_h"])
    edited = base.join(heads, base["id"].eqNullSafe(heads["to_id"]) & (base["h"] == heads["to_h"])).select(
        "id", "h", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - F.col("k")), "head").alias("edited"))
    edited = edited.select("id", "h", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fp"))
    prints = own.dropDuplicates(["id", "h"])
    nexts = order.join(prints, same(order, "next_id", "next_h", prints)).select(
        order["id"].alias("own_id"), order["h"].alias("own_h"), order["n"].alias("own_n"), prints["fp"].alias("next_fp"))
    pair = nexts.join(prints, same(nexts, "own_id", "own_h", prints)).select("own_id", "own_h", "own_n", "fp", "next_fp")
    out = edited.join(pair, edited["id"].eqNullSafe(pair["own_id"]) & (edited["h"] == pair["own_h"]))
    return out.select(F.col("id").alias(id_col), F.col("own_n").cast("long").alias("n_chars"), "edited_sha256",
                      F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"),
                      likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
