"""N-gram Jaccard join: overlaps by a blocked sparse product, pairs bounded by their sizes."""

from __future__ import annotations

import hashlib
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowwarden.llm import sieve
from flowwarden.llm.graph import components
from flowwarden.llm.text import checked_broadcast, grams, hash_words, materialize, mix64, text_of

SHINGLE = 5
PERCENT = 75
COMMON_SHARE = 10
KEYS_KEPT = 200_000
CHUNK = 1_000_000
BLOCK = 1 << 16
MOST_COUNTED = 65535
LEAST_BITS, MOST_BITS = 20, 24
# Which shingles of prefixes are repeated is asked of their upper 48 bits, in parts of some 2 ** 18 shingles at 128 a text.
CUT = 16
PART_BITS = 20


def shingles(raw: bytes, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    words = hash_words(raw, lower=True)
    if not len(words):
        return words
    return np.unique(grams(words, min(size, len(words))) ^ np.uint64(0 if len(words) >= size else len(words)))


def sequence_key(raw: bytes) -> bytes:
    """What texts with the same words in the same order share."""
    return hashlib.md5(b" ".join(raw.lower().split())).digest()


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane: the high bytes of small ones are zero, and pack to nothing when stored."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _from_planes(held: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(held, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _pack(own: np.ndarray) -> bytes:
    """Sorted hashes as the steps between them."""
    return _planes(np.diff(own, prepend=np.uint64(0)))


def _unpack(held: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(held, np.uint64), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts that are mostly 0, 1 or 2, in some two bits each."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 15, 9, zlib.Z_RLE)
    return packer.compress(_planes(counts)) + packer.flush()


def _unpack_counts(held: bytes) -> np.ndarray:
    return _from_planes(zlib.decompress(held), np.uint16)


def _crowd_slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(hashes ^ np.uint64(0x5EED)) >> np.uint64(64 - bits)).astype(np.int64)


def _profile(batches, bits: int, size: int):
    """A row per text (id, key, n), then the partition's shingle counts by slot, in blocks."""
    crowd = np.zeros(1 << bits, np.uint16)
    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field("id").type
        keys, sizes = [], []
        for text in batch.column("text"):
            raw = text.as_py().encode("utf-8")
            own = shingles(raw, size)
            at = _crowd_slot(own, bits)
            seen = crowd[at]
            crowd[at] = seen + (seen < MOST_COUNTED)
            keys.append(sequence_key(raw) if len(own) else None)
            sizes.append(len(own))
        n = len(keys)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
            ["id", "key", "n", "block", "crowd"])
    used = [b for b in range(len(crowd) // BLOCK) if crowd[b * BLOCK:(b + 1) * BLOCK].any()]
    for b in used:
        held = _pack_counts(crowd[b * BLOCK:(b + 1) * BLOCK])
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([b], pa.int32()), pa.array([held], pa.binary())],
            ["id", "key", "n", "block", "crowd"])


def _levels(batches):
    """Sums the blocks of all partitions; keeps the logarithm of each count."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, counts in zip(batch.column("block").to_pylist(), batch.column("crowd")):
            more = _unpack_counts(counts.as_py())
            held[b] = held[b] + more if b in held else more.astype(np.uint32)
    for b, counts in held.items():
        level = np.floor(np.log2(counts + 1) * 2).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["block", "level"])


def common(n: int) -> int:
    """How many shingles the prefixes of two sets share at least, if they are alike enough and the smaller has ``n``."""
    return 1 + n // COMMON_SHARE


def _prefix(own: np.ndarray, levels: np.ndarray, bits: int, percent: int) -> np.ndarray:
    """The rarest shingles of a set, in one order for all texts.

    A partner lacks at most n - ceil(percent * n / 100) of the n shingles.  With
    ``common(n)`` more than that in the prefix, the prefixes of two such sets
    share at least ``common`` of the smaller size.
    """
    n = len(own)
    keep = n - -(-percent * n // 100) + common(n)
    # The set is sorted, so a stable order of the levels alone is enough.
    return own[np.argsort(levels[_crowd_slot(own, bits)], kind="stable")[:keep]]


def _prefix_parts(batches, shared, bits: int, part_bits: int, size: int, percent: int):
    """The shingles of prefixes, cut to their upper bits and sorted, in a row per part; a shingle of two texts or more twice."""
    held, keys, total = [], set(), 0

    def flush():
        # In place, as an executor runs several of these at once.
        value = np.concatenate(held)
        held.clear()
        value >>= np.uint64(CUT)
        value.sort()
        value = value[np.concatenate([np.ones(min(2, len(value)), bool), value[2:] != value[:-2]])]
        parts = (value >> np.uint64(64 - CUT - part_bits)).astype(np.int32)
        first = np.concatenate([[0], np.flatnonzero(parts[1:] != parts[:-1]) + 1])
        return pa.RecordBatch.from_arrays(
            [pa.array(parts[first]), pa.array([_pack(x) for x in np.split(value, first[1:])], pa.binary())], ["part", "held"])

    for batch in batches:
        for text in batch.column("text"):
            raw = text.as_py().encode("utf-8")
            key = sequence_key(raw)
            if key in keys:
                continue
            keys.add(key)
            own = shingles(raw, size)
            if len(own):
                held.append(_prefix(own, shared.value, bits, percent))
                total += len(held[-1])
            if total >= CHUNK:
                yield flush()
                keys, total = set(), 0
    if total:
        yield flush()


def _repeated(table: pa.Table) -> pa.Table:
    """The shingles of a part that occur twice or more."""
    value = np.sort(np.concatenate([_unpack(x.as_py()) for x in table.column("held")]))
    value = np.unique(value[1:][value[1:] == value[:-1]])
    return pa.table({"part": pa.array(table.column("part")[:1].to_pylist(), pa.int32()), "n": pa.array([len(value)], pa.int64()),
                     "held": pa.array([value.tobytes()], pa.binary())})


def _sets(batches, levels, table, bits: int, table_bits: int, part_bits: int, size: int, percent: int):
    """Of each text that may have a partner: its possibly shared prefix, the places of it in the order, and its whole set.

    Of texts with the same words, the first that a task meets speaks for all.
    """
    keys: set[bytes] = set()
    for batch in batches:
        node, n, prefix, place, blob = [], [], [], [], []
        for id_, text in zip(batch.column("id").to_pylist(), batch.column("text")):
            raw = text.as_py().encode("utf-8")
            key = sequence_key(raw)
            if key in keys:
                continue
            if len(keys) >= KEYS_KEPT:
                keys.clear()
            keys.add(key)
            own = shingles(raw, size)
            first = _prefix(own, levels.value, bits, percent)
            cut = first >> np.uint64(CUT)
            places = sieve.part_slots(cut, cut >> np.uint64(64 - CUT - part_bits), part_bits, table_bits)
            at = np.flatnonzero(sieve.held(table.value, places, len(cut)))
            first = first[at]
            if len(own) and len(first) >= common(-(-percent * len(own) // 100)):
                node.append(id_)
                n.append(len(own))
                prefix.append(first.view(np.int64))
                place.append(at.astype(np.int32))
                blob.append(_pack(own))
        yield pa.RecordBatch.from_arrays(
            [pa.array(node, batch.schema.field("id").type), pa.array(n, pa.int64()), pa.array(prefix, pa.list_(pa.int64())),
             pa.array(place, pa.list_(pa.int32())), pa.array(blob, pa.binary())], ["node", "n", "prefix", "place", "blob"])


def _overlaps(batches):
    for batch in batches:
        both = []
        for a, b in zip(batch.column("blob_a"), batch.column("blob_b")):
            x, y = _unpack(a.as_py()), _unpack(b.as_py())
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            both.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(both, pa.int64())], ["a", "b", "na", "nb", "both"])


def _measured(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Exact overlap of each pair (a, b); ``linked`` and the Jaccard distance.

    The sets of the pairs are picked by a broadcast of the pairs if they are few
    (checked), so only sets that are in a pair are moved, under a key of their
    own per pair; more pairs are joined with all sets.
    """
    whole = sets.select("node", "n", "blob")
    pairs = materialize(pairs.select("a", "b"), f"{name}-pairs")
    few = checked_broadcast(pairs)
    chosen = pairs if few is None else few

    def side(mine: str) -> DataFrame:
        return whole.join(chosen, F.col("node") == F.col(mine)).select(
            "a", "b", F.col("n").alias(f"n{mine}"), F.col("blob").alias(f"blob_{mine}"))

    both = side("a").join(side("b"), ["a", "b"])
    kind = pairs.schema["a"].dataType.simpleString()
    found = both.mapInArrow(_overlaps, f"a {kind}, b {kind}, na long, nb long, both long")
    union = F.col("na") + F.col("nb") - F.col("both")
    return materialize(found.select("a", "b", (100 * F.col("both") >= percent * union).alias("linked"), (1 - F.col("both") / union).alias("far")), name)


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join what is joined by all links between the texts of ``sets``.

    1. Sparse product, one column block against its first row: every n-gram's
       texts are paired with the smallest of them only.  A text keeps the
       partner that it shares most prefix n-grams with, and is measured against
       it.  Texts linked to one partner form a star around it.  Texts that stay
       alone try again, with the largest, and then in the order of a hash.
    2. Product of the stars: two stars are paired at an n-gram if it may be the
       first, in the order of rarity, of all that two of their members share: its
       place in either set leaves enough n-grams for a partner of the other's
       size.  The centres are measured.
    3. The Jaccard distance is a metric, so members of two stars can only be
       linked if the centres are no farther apart than the limit and their two
       distances together.  Of such stars the members that meet in the same way
       are measured one by one, unless their stars are joined already.
    """
    limit = 1 - percent / 100
    # The first texts of an n-gram in all three orders are taken in one pass; of the hash only itself moves.
    hashed = F.xxhash64("node")
    post = sets.select("node", "n", F.explode("prefix").alias("s"))
    same = Window.partitionBy("s")
    met = post.select("node", "n", hashed.alias("own"), F.min("node").over(same).alias("h0"), F.max("node").over(same).alias("h1"),
                      F.min(hashed).over(same).alias("h2"))
    head, hash_ = F.col("p.head"), F.col("p.hash")
    none = F.lit(None).cast(sets.schema["node"].dataType)
    turns = [F.struct(F.lit(0).alias("turn"), F.col("h0").alias("head"), F.lit(None).cast("long").alias("hash")),
             F.struct(F.lit(1).alias("turn"), F.col("h1").alias("head"), F.lit(None).cast("long").alias("hash")),
             F.struct(F.lit(2).alias("turn"), none.alias("head"), F.col("h2").alias("hash"))]
    shared = (met.where((F.col("h0") != F.col("h1"))).select("node", "n", "own", F.explode(F.array(*turns)).alias("p"))
              .where(F.coalesce(head != F.col("node"), hash_ != F.col("own")))
              .groupBy("node", "n", F.col("p.turn").alias("turn"), head.alias("head"), hash_.alias("hash")).agg(F.count(F.lit(1)).alias("k")))
    shared = shared.where(F.col("k") >= 1 + F.expr(f"((n * {percent} + 99) div 100) div {COMMON_SHARE}"))
    best = materialize(shared.groupBy("node", "turn").agg(F.max_by(F.struct("head", "hash"), F.struct("k", -F.col("head"), -F.col("hash"))).alias("p"))
                       .select("node", "turn", "p.head", "p.hash"), "heads")
    names = sets.groupBy(hashed.alias("hash")).agg(F.min("node").alias("name"))
    stars = None
    for turn in range(3):
        asked = best.where(F.col("turn") == turn)
        if stars is not None:
            asked = asked.join(stars.select("node"), "node", "left_anti")
            asked = asked.join(stars.select(F.col("star").alias("node")), "node", "left_anti")
        if turn == 2:
            asked = asked.join(names, "hash").select("node", F.col("name").alias("head"))
        tried = _measured(asked.select(F.col("node").alias("a"), F.col("head").alias("b")), sets, percent, "stars")
        found = tried.where("linked").select(F.col("a").alias("node"), F.col("b").alias("star"), "far")
        stars = found if stars is None else stars.unionByName(found)
    stars = materialize(stars, "star-links")
    member = materialize(sets.select("node", "n").join(stars, "node", "left").select(
        "node", "n", F.coalesce("star", "node").alias("star"), F.coalesce("far", F.lit(0.0)).alias("far")), "members")
    # A centre may belong to another star itself; two stars with one part are joined already.
    above = member.select(F.col("node").alias("centre"), F.col("star").alias("up")).groupBy("centre").agg(F.min("up").alias("part"))
    size = member.groupBy("star").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("far").alias("reach"),
                                      F.count(F.lit(1)).alias("many"))
    size = materialize(size.join(above, size["star"] == above["centre"], "left").select(
        "star", "least", "most", "reach", "many", F.coalesce("part", "star").alias("part")), "star-sizes")

    # All that two sets share comes, in the order of rarity, not before the first n-gram that they share, so a place
    # says how large a partner may be that is alike enough and meets this n-gram first.
    def places(of: DataFrame, *more: str) -> DataFrame:
        """The n-grams of the sets in ``of`` (stored: node and ``more``), with their largest partners.  Sets are not moved if ``of`` is short (checked)."""
        few = checked_broadcast(of)
        return sets.select("node", "prefix", "place", F.col("n").alias("own")).join(of if few is None else few, "node").select(
            "node", *more, "own", F.explode(F.arrays_zip("prefix", "place")).alias("p")).select(
            "node", *more, F.col("p.prefix").alias("s"), F.expr(f"(100 * own - {100 + percent} * p.place) div {percent}").alias("top"))

    least = materialize(member.select("node", "star").join(size.select("star", "least"), "star"), "member-stars")
    columns = places(least, "star", "least").where(F.col("top") >= F.expr(f"(least * {percent} + 99) div 100")).select("s", "star", "top")
    # Moved once, by n-gram: what follows needs no other order.
    columns = columns.repartition("s").groupBy("s", "star").agg(F.max("top").alias("top"))
    columns = columns.withColumn("k", F.count(F.lit(1)).over(same)).where("k > 1").drop("k")
    columns = materialize(columns.join(size, "star"), "star-columns")
    x, y = columns.alias("x"), columns.alias("y")
    pairs = (x.join(y, F.col("x.s") == F.col("y.s"))
             .where((F.col("x.star") < F.col("y.star")) & (F.col("x.part") != F.col("y.part"))
                    & (F.col("y.least") <= F.col("x.top")) & (F.col("x.least") <= F.col("y.top"))
                    & (100 * F.col("x.most") >= percent * F.col("y.least")) & (100 * F.col("y.most") >= percent * F.col("x.least")))
             .select(F.col("x.star").alias("a"), F.col("y.star").alias("b")).distinct())
    centres = _measured(pairs, sets, percent, "centres")
    sure = stars.select(F.col("node").alias("a"), F.col("star").alias("b")).union(centres.where("linked").select("a", "b"))

    parts = components(sure)
    reach = size.select("star", "reach", "many")
    near = (centres.where("not linked").join(reach.select(F.col("star").alias("a"), F.col("reach").alias("ra"), F.col("many").alias("ma")), "a")
            .join(reach.select(F.col("star").alias("b"), F.col("reach").alias("rb"), F.col("many").alias("mb")), "b")
            .where((F.col("ra") + F.col("rb") > 0) & (F.col("far") <= limit + F.col("ra") + F.col("rb") + 1e-9)))
    near = (near.join(parts.select(F.col("node").alias("a"), F.col("component").alias("pa")), "a", "left")
            .join(parts.select(F.col("node").alias("b"), F.col("component").alias("pb")), "b", "left")
            .where(F.coalesce("pa", "a") != F.coalesce("pb", "b")))
    # The smaller star is spread over its n-grams first.
    swap = F.col("ma") > F.col("mb")

    def either(this: str, other: str):
        return F.when(swap, F.col(this)).otherwise(F.col(other))

    near = near.select(either("b", "a").alias("a"), either("a", "b").alias("b"), either("ra", "rb").alias("rb"), F.col("far").alias("apart"))
    near = materialize(near, "near-stars")
    slack = F.lit(limit + 1e-9)
    # Members meet at an n-gram that may be the first of what they share, as stars do.
    asked = near.select(F.col("a").alias("star")).union(near.select("b")).distinct()
    at = places(materialize(member.join(asked, "star", "left_semi"), "asked-members"), "star", "far", "n")
    xs = near.join(at.select(F.col("star").alias("a"), F.col("node").alias("x"), F.col("far").alias("fx"), F.col("n").alias("nx"), "s",
                             F.col("top").alias("tx")), "a").where(F.col("apart") <= slack + F.col("fx") + F.col("rb"))
    ys = at.select(F.col("star").alias("b"), F.col("node").alias("y"), F.col("far").alias("fy"), F.col("n").alias("ny"), "s", F.col("top").alias("ty"))
    wanted = (xs.join(ys, ["b", "s"]).where((F.col("apart") <= slack + F.col("fx") + F.col("fy"))
                                            & (F.col("ny") <= F.col("tx")) & (F.col("nx") <= F.col("ty")))
              .select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    more = _measured(wanted, sets, percent, "member-pairs")
    return sure.union(more.where("linked").select("a", "b"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                       percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Two texts link when 100 * |A n B| >= ``percent`` * |A u B| for their sets of
    ``size``-word shingles (ASCII lower case; a shorter text is one shingle).
    Texts with the same words are one node, so copies are never paired.

    A node's prefix (its rarest shingles, of which any partner shares one) is
    compared, not its whole set.  How rare a shingle is comes from hashed
    counts over all rows; they order the shingles, so their size changes the
    work, not the result.

    Null and empty texts have no shingles and are their own component.  Rows
    without id take part in no link and get a null component.  Rows that share
    an id are one document: a link of any of their texts counts.  Repeated rows
    give equal rows, an empty table none; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    n_rows = rows.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * n_rows).bit_length()))
    part_bits = min(PART_BITS, ((128 * n_rows) >> 18).bit_length() + 1)
    profile = materialize(rows.mapInArrow(partial(_profile, bits=bits, size=size),
                                          f"id {kind}, key binary, n long, block int, crowd binary"), "profile")
    crowd = profile.where("block is not null").select("block", "crowd").repartition("block").mapInArrow(_levels, "block int, level binary").collect()
    levels = np.zeros(1 << bits, np.uint8)
    for r in crowd:
        levels[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = np.frombuffer(r["level"], np.uint8)
    order = spark.sparkContext.broadcast(levels)
    texts = profile.where("block is null").select("id", "key", "n")
    nodes = texts.where("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("node"))
    nodes = materialize(nodes, "nodes")

    parts = rows.select("text").mapInArrow(lambda b: _prefix_parts(b, order, bits, part_bits, size, percent), "part int, held binary")
    repeated = materialize(parts.groupBy("part").applyInArrow(_repeated, "part int, n long, held binary"), "prefixes")
    held, held_bits = sieve.build_parts(repeated, part_bits)
    table = spark.sparkContext.broadcast(held)
    sets = materialize(rows.where("id is not null").mapInArrow(
        lambda b: _sets(b, order, table, bits, held_bits, part_bits, size, percent), f"node {kind}, n long, prefix array<long>, place array<int>, blob binary"), "sets")
    parts = components(_links(sets, percent).union(
        texts.join(nodes, "key").where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))))
    parts = parts.withColumnRenamed("node", "id")
    return texts.join(parts, "id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
