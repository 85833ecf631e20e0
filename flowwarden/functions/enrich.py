"""Column rules that name, tag and identify one connection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowwarden import schema as S


def _none() -> Column:
    return F.lit(None).cast("string")


def tags(*rules: Column) -> Column:
    """An array of the tags whose rule gave one."""
    return F.array_compact(F.array(*rules))


def _in_registered(port: Column) -> Column:
    return port.between(*S.REGISTERED_RANGE)


def service_name(port: Column) -> Column:
    rule = F.when(port.isNull(), _none())
    for name, numbers, _ in S.SERVICES:
        rule = rule.when(port.isin(numbers), name)
    return (
        rule.when(_in_registered(port), "Registered Port")
        .when(port >= S.DYNAMIC_START, "Dynamic/Private Port")
        .otherwise("Other")
    )


def service_tag_rules(port: Column) -> list[Column]:
    listed = [n for _, numbers, _ in S.SERVICES for n in numbers]
    rules = [
        F.when(port.isin(numbers), tag)
        for _, numbers, names in S.SERVICES
        for tag in names
    ]
    rules.append(F.when(_in_registered(port) & ~port.isin(listed), "registered_port"))
    rules.append(F.when(port >= S.DYNAMIC_START, "ephemeral_port"))
    return rules


def potential_scan(src_port: Column, dst_port: Column) -> Column:
    return F.coalesce((src_port > 1024) & (dst_port < 1024), F.lit(False))


def nonstandard_dns(dst_port: Column, dst_ip: Column) -> Column:
    return F.coalesce((dst_port == 53) & ~dst_ip.rlike(S.KNOWN_RESOLVERS), F.lit(False))


def packet_size_tag(length: Column) -> Column:
    return F.when(length > 1400, "large_packet").when(length < 100, "small_packet")


def tcp_state(flags: Column) -> Column:
    return (
        F.when(flags == "S", "SYN")
        .when(flags.contains("F"), "FIN")
        .when(flags.contains("R"), "RST")
        .when(flags == "SA", "SYN-ACK")
    )


def tcp_state_tag(flags: Column) -> Column:
    state = tcp_state(flags)
    return (
        F.when(state == "SYN", "tcp_syn").when(state == "FIN", "tcp_fin")
        .when(state == "RST", "tcp_reset").when(state == "SYN-ACK", "tcp_synack")
    )


def suspected_os(ttl: Column) -> Column:
    return (
        F.when(ttl.between(60, 64), "Linux/Unix")
        .when(ttl.between(124, 128), "Windows")
        .when(ttl.between(252, 255), "Network Device")
        .when(ttl < 30, "Suspicious Low TTL")
    )


def action_tag(action: Column) -> Column:
    return F.when(action == "block", "blocked").when(action == "pass", "allowed")


def is_private(ip: Column) -> Column:
    return F.coalesce(ip.rlike(S.PRIVATE_IP), F.lit(False))


def source_scope(ip: Column) -> Column:
    return F.when(ip.rlike(S.PRIVATE_IP), "internal_source").when(
        (ip != "0.0.0.0") & (ip != ""), "external_source"
    )


def destination_scope(ip: Column) -> Column:
    return F.when(ip.rlike(S.PRIVATE_IP), "internal_dest").when(
        ~ip.rlike(S.NOT_EXTERNAL_DEST) & (ip != ""), "external_dest"
    )


def keyed_digest(**fields: Column) -> Column:
    """SHA-256 over ``|name|value`` pairs in name order, closed by ``|``.

    The layout the public log-shipper fingerprint filter uses when it joins
    several fields.  A missing value counts as empty text.
    """
    parts = [
        F.concat(F.lit(f"|{name}|"), F.coalesce(fields[name].cast("string"), F.lit("")))
        for name in sorted(fields)
    ]
    return F.sha2(F.concat(*parts, F.lit("|")), 256)


def session_id(src_ip: Column, dst_ip: Column, src_port: Column, dst_port: Column,
               proto: Column) -> Column:
    needed = src_ip.isNotNull() & dst_ip.isNotNull() & src_port.isNotNull() & dst_port.isNotNull()
    return F.when(needed, keyed_digest(
        src_ip=src_ip, dest_ip=dst_ip, src_port=src_port, dest_port=dst_port, protocol=proto))


def flow_id(src_ip: Column, dst_ip: Column, proto: Column) -> Column:
    needed = src_ip.isNotNull() & dst_ip.isNotNull() & proto.isNotNull()
    return F.when(needed, keyed_digest(src_ip=src_ip, dest_ip=dst_ip, protocol=proto))


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def packet_efficiency(data_length: Column, length: Column) -> Column:
    return F.when(
        length > 0, F.round(F.try_divide(data_length, length) * 100, 2)
    )


def ip_to_long(ip: Column) -> Column:
    """Dotted IPv4 text as a number; null for anything else."""
    parts = F.split(ip, r"\.")
    total = F.lit(0).cast("bigint")
    for i in range(4):
        total = total * 256 + F.get(parts, F.lit(i)).try_cast("bigint")
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), total)


def all_tag_rules(c: dict[str, Column]) -> list[Column]:
    """Every tag rule in the order the tags are appended."""
    return [
        *service_tag_rules(c["dst_port"]),
        F.when(potential_scan(c["src_port"], c["dst_port"]), "potential_scan"),
        F.when(nonstandard_dns(c["dst_port"], c["dst_ip"]), "non_standard_dns"),
        packet_size_tag(c["length"]),
        tcp_state_tag(c["tcp_flags"]),
        F.when(c["ttl"] < 30, "suspicious_ttl"),
        action_tag(c["action"]),
        source_scope(c["src_ip"]),
        destination_scope(c["dst_ip"]),
        F.when(packet_efficiency(c["data_length"], c["length"]) < 20, "high_overhead"),
    ]
