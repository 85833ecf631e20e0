"""Lookups by address: longest network prefix, and host names as of a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.functions import enrich as E
from flowwarden.operators.enrich import _is_external
from flowwarden.plans.joins import checked_left_join
from flowwarden.plans.storage import materialize

# How long a found and a failed name are believed, in seconds.
HIT_SECONDS, FAILED_SECONDS = 3600, 300
BUCKET_SECONDS = 3600
PLACE = ["country", "city", "lat", "lon"]


def split_network(network: Column) -> tuple[Column, Column]:
    """Prefix length and prefix of ``a.b.c.d/length``; null for anything else."""
    bits = F.get(F.split(network, "/"), F.lit(1)).try_cast("int")
    start = E.ip_to_long(F.get(F.split(network, "/"), F.lit(0)))
    fits = bits.between(0, 32) & start.isNotNull()
    # Shifts take a plain number, so the prefix is cut by division.
    return F.when(fits, bits), F.when(fits, F.floor(start / F.pow(F.lit(2.0), F.lit(32) - bits)).cast("long"))


def longest_prefix(addresses: DataFrame, networks: DataFrame, address: str, fields: list[str] = PLACE) -> DataFrame:
    """``(address, _place)`` for each address (a number) that lies in a network of ``a.b.c.d/length``.

    An address has one key per prefix length in use (33 at most), so this is an
    equi join whatever the width of the networks; of the networks that hold an
    address the longest wins, and of the same network twice the smallest fields.
    A network that does not read as such is left out.
    """
    bits, prefix = split_network(F.col("network"))
    nets = networks.select(bits.alias("_bits"), prefix.alias("_prefix"), F.struct(*fields).alias("_place")).filter("_prefix IS NOT NULL")
    nets = materialize(nets.groupBy("_bits", "_prefix").agg(F.min("_place").alias("_place")), "networks")
    lengths = sorted(r[0] for r in nets.select("_bits").distinct().collect())
    keys = F.array(*[F.struct(F.lit(n).alias("bits"), F.shiftright(F.col(address), 32 - n).alias("prefix")) for n in lengths])
    if not lengths:
        keys = F.array().cast("array<struct<bits:int,prefix:bigint>>")
    each = addresses.filter(F.col(address).isNotNull()).select(address, F.explode(keys).alias("k")).select(
        address, F.col("k.bits").alias("_at"), F.col("k.prefix").alias("_key"))
    found = checked_left_join(each, nets, [("_at", "_bits"), ("_key", "_prefix")]).filter("_place IS NOT NULL")
    return found.groupBy(address).agg(F.max_by("_place", "_bits").alias("_place"))


def add_location_by_prefix(df: DataFrame, networks: DataFrame, ip: str = "src_ip", out: str = "source",
                           destination: bool = False) -> DataFrame:
    """Location struct of external addresses from networks that may lie in one another.

    ``networks`` has ``network`` (``a.b.c.d/length``) and ``country, city, lat,
    lon``.  Each distinct address is looked up once; every row gets at most one
    location, null where no network holds its address.
    """
    keyed = df.withColumn("_addr", F.when(_is_external(ip, destination), E.ip_to_long(F.col(ip))))
    placed = materialize(longest_prefix(keyed.select("_addr").distinct(), networks, "_addr"), "places")
    table = placed.withColumnRenamed("_addr", "_known")
    return checked_left_join(keyed, table, [("_addr", "_known")]).withColumn(out, F.col("_place")).drop("_addr", "_known", "_place")


def name_periods(lookups: DataFrame, hit_seconds: int, failed_seconds: int, bucket_seconds: int) -> DataFrame:
    """Per address and bucket of time: the lookups that count there, in order of time.

    A lookup is listed in the few buckets until the longer of the two times has
    passed, since for that long it hides those before it, expired or not; nothing
    has to be carried further.
    """
    c = F.col
    once = lookups.filter("ip IS NOT NULL AND looked_up_at IS NOT NULL").groupBy("ip", "looked_up_at").agg(F.min("hostname").alias("_name"))
    at = F.unix_micros("looked_up_at")
    lasts = F.when(c("_name").isNull(), F.lit(failed_seconds)).otherwise(F.lit(hit_seconds)).cast("long")
    timed = once.select("ip", "_name", at.alias("_from"), (at + lasts * 1_000_000).alias("_until"))
    width = bucket_seconds * 1_000_000
    hides = max(hit_seconds, failed_seconds) * 1_000_000
    listed = timed.withColumn("_bucket", F.explode(F.sequence(F.floor(c("_from") / width), F.floor((c("_from") + hides) / width))))
    return listed.groupBy(c("ip").alias("_ip"), c("_bucket").alias("_of")).agg(
        F.sort_array(F.collect_list(F.struct("_from", "_until", "_name"))).alias("_names"))


def add_hostname_asof(df: DataFrame, lookups: DataFrame, ip: str = "src_ip", ts: str = "@timestamp", out: str = "src_hostname",
                      internal: bool = False, destination: bool = False, hit_seconds: int = HIT_SECONDS,
                      failed_seconds: int = FAILED_SECONDS, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Host names of external addresses as they were known at each row's time.

    ``lookups`` has ``ip, hostname, looked_up_at``; a null name is a lookup that
    failed.  The newest lookup at or before a row's time counts, until it
    expires: a name after ``hit_seconds``, a failure after ``failed_seconds``.
    Without a name the address stands for it; internal addresses get null
    unless ``internal`` is set, rows without time their address.

    Rows meet the lookups of their address and bucket of time only, in a join
    that spreads hot keys; an address with many rows is split by time, and no
    window sorts its rows.
    """
    external = F.col(ip).isNotNull() if internal else _is_external(ip, destination)
    stamp = F.unix_micros(F.col(f"`{ts}`").cast("timestamp"))
    keyed = df.withColumns({"_key": F.when(external, F.col(ip)), "_time": stamp}).withColumn(
        "_bucket", F.floor(F.col("_time") / (bucket_seconds * 1_000_000)))
    table = materialize(name_periods(lookups, hit_seconds, failed_seconds, bucket_seconds), "names")
    joined = checked_left_join(keyed, table, [("_key", "_ip"), ("_bucket", "_of")])
    past = F.filter("_names", lambda n: n["_from"] <= F.col("_time"))
    newest = F.try_element_at(past, F.lit(-1))
    name = F.when(newest["_until"] > F.col("_time"), newest["_name"])
    return joined.withColumn(out, F.when(F.col("_key").isNotNull(), F.coalesce(name, F.col("_key")))).drop(
        "_key", "_time", "_bucket", "_ip", "_of", "_names")
