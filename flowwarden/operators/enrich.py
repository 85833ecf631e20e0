"""Names, tags and identifiers per connection, and lookups by address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.functions import enrich as E
from flowwarden.plans.joins import checked_left_join

TAG_INPUTS = ["src_ip", "dst_ip", "src_port", "dst_port", "length", "data_length",
              "tcp_flags", "ttl", "action"]


def add_service(df: DataFrame, port: str = "dst_port") -> DataFrame:
    c = F.col(port)
    return df.withColumns({
        "service_name": E.service_name(c),
        "service_tags": E.tags(*E.service_tag_rules(c)),
    })


def add_tags(df: DataFrame, out: str = "tags") -> DataFrame:
    """Append every rule's tag to the tag array (made if there is none)."""
    found = E.tags(*E.all_tag_rules({c: F.col(c) for c in TAG_INPUTS}))
    if out in df.columns:
        found = F.concat(F.coalesce(F.col(out), F.array().cast("array<string>")), found)
    return df.withColumn(out, found)


def remove_tags(df: DataFrame, names: list[str], tags: str = "tags") -> DataFrame:
    return df.withColumn(tags, F.array_except(F.col(tags), F.array(*[F.lit(n) for n in names])))


def enrich_connections(df: DataFrame, ts: str = "@timestamp") -> DataFrame:
    """All row rules at once: one projection, no shuffle."""
    c = F.col
    service = add_service(df).withColumns({
        "tcp_state": E.tcp_state(c("tcp_flags")),
        "suspected_os": E.suspected_os(c("ttl")),
        "src_is_private": E.is_private(c("src_ip")),
        "dst_is_private": E.is_private(c("dst_ip")),
        "session_id": E.session_id(c("src_ip"), c("dst_ip"), c("src_port"), c("dst_port"),
                                   c("proto_name")),
        "flow_id": E.flow_id(c("src_ip"), c("dst_ip"), c("proto_name")),
        "packet_timestamp_ms": E.epoch_millis(c(ts)),
        "packet_efficiency": E.packet_efficiency(c("data_length"), c("length")),
    })
    return add_tags(service)


def count_tags(df: DataFrame, tags: str = "tags") -> DataFrame:
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def flow_summary(df: DataFrame) -> DataFrame:
    """Connections and bytes per flow; the digest is taken once per flow, not per row."""
    flows = (
        df.filter("src_ip is not null and dst_ip is not null and proto_name is not null")
        .groupBy("src_ip", "dst_ip", "proto_name")
        .agg(F.count("*").alias("connections"), F.sum("length").alias("bytes"))
    )
    return flows.select(
        E.flow_id(F.col("src_ip"), F.col("dst_ip"), F.col("proto_name")).alias("flow_id"),
        "src_ip", "dst_ip", "proto_name", "connections", "bytes",
    )


def _is_external(ip: str, destination: bool) -> Column:
    """Sources and destinations have rules of their own for what is external."""
    scope = E.destination_scope(F.col(ip)) if destination else E.source_scope(F.col(ip))
    return F.coalesce(scope, F.lit("")) == ("external_dest" if destination else "external_source")


def add_hostname(df: DataFrame, names: DataFrame, ip: str = "src_ip",
                 out: str = "src_hostname", internal: bool = False, destination: bool = False) -> DataFrame:
    """Host names of external addresses from a supplied ``ip, hostname`` table.

    ``destination`` applies the destinations' rule: broadcast and multicast are not external.

    Addresses without an entry keep the address as their name; internal ones
    get null unless ``internal`` is set.
    """
    external = F.col(ip).isNotNull() if internal else _is_external(ip, destination)
    table = names.groupBy(F.col("ip").alias("_ip")).agg(F.min("hostname").alias("_name"))
    keyed = df.withColumn("_key", F.when(external, F.col(ip)))
    joined = checked_left_join(keyed, table, [("_key", "_ip")])
    return joined.withColumn(
        out, F.when(F.col("_key").isNotNull(), F.coalesce("_name", "_key"))
    ).drop("_key", "_ip", "_name")


def add_location(df: DataFrame, networks: DataFrame, ip: str = "src_ip",
                 out: str = "source", prefix_bits: int = 16, destination: bool = False) -> DataFrame:
    """Location struct of external addresses by network range (``destination``: see :func:`add_hostname`).

    ``networks`` has ``net_start, net_end`` (numbers, inclusive, not overlapping)
    and ``country, city, lat, lon``.  Both sides are cut at the same address
    prefix, so the range test runs inside an equi join, never as a nested loop.
    """
    shift = 32 - prefix_bits
    table = networks.select(
        F.explode(F.sequence(F.shiftright("net_start", shift), F.shiftright("net_end", shift)))
        .alias("_prefix"),
        F.col("net_start").alias("_start"), F.col("net_end").alias("_end"),
        F.struct("country", "city", "lat", "lon").alias("_place"),
    )
    external = _is_external(ip, destination)
    keyed = df.withColumn("_addr", F.when(external, E.ip_to_long(F.col(ip)))).withColumn(
        "_net", F.shiftright("_addr", shift)
    )
    joined = checked_left_join(
        keyed, table, [("_net", "_prefix")], F.expr("_addr BETWEEN _start AND _end")
    )
    return joined.withColumn(out, F.col("_place")).drop(
        "_addr", "_net", "_prefix", "_start", "_end", "_place"
    )
