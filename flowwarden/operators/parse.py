"""Raw syslog lines to typed rows.  One projection each, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden import schema as S
from flowwarden.functions import parsing as P

HEADER_FAILURE = "_parse_failure_header"


def _note(fits):
    return F.when(fits, F.array().cast("array<string>")).otherwise(F.array(F.lit(HEADER_FAILURE)))


def parse_header(df: DataFrame, message: str = "message") -> DataFrame:
    """The strict header.  Keeps the raw line and tags lines that do not fit.

    The pattern runs once per line; the groups are picked from its result.
    """
    found = df.withColumn("_head", P.captures(F.col(message), P.STRICT_HEADER, len(P.STRICT_GROUPS)))
    fits = F.coalesce(F.size("_head") > 1, F.lit(False))
    columns = [
        F.when(fits, P.captured(F.col("_head"), i)).alias(name)
        for i, name in enumerate(P.STRICT_GROUPS)
    ]
    return found.select(
        *df.columns, F.col(message).alias("raw_message"), *columns, _note(fits).alias("tags"))


def parse_header_relaxed(df: DataFrame, message: str = "message",
                         bsd_fallback: bool = True) -> DataFrame:
    """The relaxed header, then (by default) the BSD one for lines it does not fit."""
    line = F.col(message)
    names = ["syslog_pri", "log_time", "hostname", "program", "pid", "payload"]
    found = df.withColumn("_head", P.captures(line, P.WHOLE_LINE + P.RELAXED_HEADER, 7))
    is_relaxed = F.coalesce(F.size("_head") > 1, F.lit(False))
    second = P.captures(line, P.WHOLE_LINE + P.BSD_HEADER, 6) if bsd_fallback else F.array(line)
    found = found.withColumn("_bsd", F.when(~is_relaxed, second))
    is_bsd = F.coalesce(F.size("_bsd") > 1, F.lit(False))

    def pick(i: int):
        first = P.captured(F.col("_head"), 6 if i == 5 else i)
        if i == 4:  # the process id stands in brackets or as a word of its own
            first = F.coalesce(first, P.captured(F.col("_head"), 5))
        value = F.when(is_relaxed, first).when(is_bsd, P.captured(F.col("_bsd"), i))
        return F.trim(value) if i == 5 else value

    form = F.when(is_relaxed, "rfc5424").when(is_bsd, "bsd")
    return found.select(
        *df.columns, line.alias("raw_message"),
        *[pick(i).alias(name) for i, name in enumerate(names)],
        form.alias("header_form"), _note(is_relaxed | is_bsd).alias("tags"))


def ipv4_only(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Keep payloads whose IP version is 4; a missing version drops the row."""
    return df.filter(F.col(payload).rlike(P.FIRST_LINE + "^" + P.IPV4_PAYLOAD))


def parse_filterlog(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The 29 positional fields as text, empty ones null."""
    parts = df.withColumn("_parts", P.payload_fields(F.col(payload)))
    return parts.select(
        *df.columns, *[P.payload_field(F.col("_parts"), n).alias(n) for n in S.FILTERLOG_FIELDS])


def convert_types(df: DataFrame) -> DataFrame:
    """Typed fields; a bad number is null.

    Lines of every protocol share one column order, so ports are kept for the
    protocols that have them and TCP fields for TCP.
    """
    proto = F.lower(F.col("proto_name"))
    changed = {}
    for name in S.FILTERLOG_FIELDS:
        value = P.typed(F.col(name), name)
        if name in S.PORT_FIELDS:
            value = F.when(proto.isin(S.PORT_PROTOCOLS), value)
        elif name in S.TCP_FIELDS:
            value = F.when(proto == "tcp", value)
        changed[name] = value
    changed["tcp_flags"] = F.upper(changed["tcp_flags"])
    return df.withColumns(changed).withColumnRenamed("window", "tcp_window")


def assign_time(df: DataFrame, text: str = "log_time", out: str = "@timestamp",
                zone: str = "UTC") -> DataFrame:
    return df.withColumn(out, P.iso_time(F.col(text), zone))


def assign_time_fallback(df: DataFrame, year: int, text: str = "log_time",
                         out: str = "@timestamp", zone: str = P.LOG_TIME_ZONE) -> DataFrame:
    """ISO 8601 first, then the BSD form of the given year in the given zone."""
    return df.withColumn(
        out, F.coalesce(P.iso_time(F.col(text), zone), P.bsd_time(F.col(text), year, zone))
    )


def drop_work_fields(df: DataFrame) -> DataFrame:
    return df.drop("message", "raw_message", "payload", "log_time", "syslog_pri", *S.WORK_FIELDS)


def rename_aliases(df: DataFrame, aliases: dict[str, str] = S.FIELD_ALIASES) -> DataFrame:
    """Older field names to the canonical ones."""
    return df.withColumnsRenamed({k: v for k, v in aliases.items() if k in df.columns})


def parse_lines(df: DataFrame, message: str = "message") -> DataFrame:
    """Raw lines to accepted IPv4 rows: header, early filter, fields, time, types.

    The header pattern runs once per line.  A filter on its groups would be
    pushed below them and run the pattern again, so lines are kept by exploding
    an array that holds the groups or nothing.
    """
    found = df.withColumn("_head", P.captures(F.col(message), P.STRICT_HEADER, len(P.STRICT_GROUPS)))
    payload = P.captured(F.col("_head"), P.STRICT_GROUPS.index("payload"))
    wanted = (F.size("_head") > 1) & payload.rlike(P.FIRST_LINE + "^" + P.IPV4_PAYLOAD)
    nothing = F.array().cast("array<array<string>>")
    kept = found.select(*df.columns, F.explode(F.when(wanted, F.array("_head")).otherwise(nothing)).alias("_head"))
    headed = kept.select(*df.columns, F.col(message).alias("raw_message"),
                         *[P.captured(F.col("_head"), i).alias(name) for i, name in enumerate(P.STRICT_GROUPS)])
    return drop_work_fields(assign_time(convert_types(parse_filterlog(headed))))


def parse_errors(df: DataFrame, message: str = "message") -> DataFrame:
    """The raw lines whose header does not fit, with their tags."""
    bad = parse_header(df, message).filter(F.array_contains("tags", HEADER_FAILURE))
    return bad.select(*df.columns, "tags")


OUTCOMES = ("accepted", "rejected", "other version")


def classify_lines(df: DataFrame, message: str = "message") -> DataFrame:
    """Every raw line once: its ``outcome``, and the typed fields of the accepted ones.

    The header pattern runs once per line, whatever its outcome, so one pass
    serves both the accepted rows and the lines set aside; the columns of the input stay.
    """
    headed = parse_header(df, message)
    right = F.coalesce(F.col("payload").rlike(P.FIRST_LINE + "^" + P.IPV4_PAYLOAD), F.lit(False))
    told = F.when(F.array_contains("tags", HEADER_FAILURE), "rejected").when(right, "accepted").otherwise("other version")
    rows = assign_time(convert_types(parse_filterlog(headed.withColumn("outcome", told))))
    # The line itself is wanted for what is set aside.
    return rows.withColumn("_line", F.col(message)).transform(drop_work_fields).withColumnRenamed("_line", message)


def route_programs(df: DataFrame, program: str = "program") -> DataFrame:
    return df.withColumn("log_type", P.log_type(F.col(program)))


def parse_dhcp(df: DataFrame, payload: str = "payload") -> DataFrame:
    return df.withColumns(P.dhcp_fields(F.col(payload)))


def parse_vpn(df: DataFrame, payload: str = "payload") -> DataFrame:
    return df.withColumns(P.vpn_fields(F.col(payload)))
