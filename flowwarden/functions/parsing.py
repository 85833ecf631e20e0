"""Column rules that take a raw syslog line apart.

Lines that do not fit yield nulls, never errors: extraction gives null instead
of an empty match, and every conversion is a ``try_`` one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowwarden import schema as S

# --------------------------------------------------------------------------
# Line layouts.
# --------------------------------------------------------------------------
ISO_TIME = (
    r"\d{4}-\d{2}-\d{2}[T ]\d{2}:?\d{2}(?::?\d{2}(?:[.,]\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?"
)
BSD_TIME = r"[A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2}"
IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
# Eight groups, or fewer around a double colon; six groups alone are a hardware address.
_GROUP = "[0-9A-Fa-f]{1,4}"
IPV6 = f"(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}(?::{_GROUP})*)?::(?:{_GROUP}(?::{_GROUP})*)?)"
ADDRESS = f"(?:{IPV6}|{IPV4})"

# <pri>1 time host program pid - - rest
STRICT_HEADER = rf"^<([1-9]\d*)>1 ({ISO_TIME}) ([0-9A-Za-z][0-9A-Za-z.-]*) (\w+) ([+-]?\d+) - - (.*)"
WHOLE_LINE = "^.*?"  # put before a header that may start later in the line
STRICT_GROUPS = ["syslog_pri", "log_time", "hostname", "program", "pid", "payload"]

# The ninth payload field is the IP version.
IPV4_PAYLOAD = r"(?:[^,\n]*,){8}[ \t]*4[ \t]*(?:[,\n]|$)"
# A line feed ends what a header reads; the text after it stays in the raw line only.
FIRST_LINE = "(?d)"
REST = r"[\s\S]*"

# Version, pid, message id and structured data may each be missing.
RELAXED_HEADER = (
    rf"<([1-9]\d*)>(?:[1-9]\d* )?({ISO_TIME}) (\S+) ([^\s\[]+)(?:\[([1-9]\d*)\])? "
    r"(?:([1-9]\d*) \S+ (?:-|\[\S*\]) |\S* \S* )(.*)"
)
# <pri>Mon d HH:mm:ss host program[pid]: rest
BSD_HEADER = rf"<([1-9]\d*)>({BSD_TIME}) (\S+) ([^\s\[:]+)(?:\[([1-9]\d*)\])?: (.*)"

# Tried in this order; the first that fits wins.
DHCP_FORMS = [
    (rf"DHCP(\w+) (?:on|from) ({ADDRESS})", ["dhcp_action", "dhcp_ip"]),
    (rf"DHCP(\w+) for ({ADDRESS})", ["dhcp_action", "dhcp_ip"]),
    (rf"DHCP(\w+) on (\S+) to ({ADDRESS})", ["dhcp_action", "dhcp_interface", "dhcp_server"]),
]
VPN_FORM = rf"({ADDRESS}):(\d+) (.*)"
LOG_TIME_ZONE = "Asia/Ho_Chi_Minh"
MARK, ESCAPE = "\u0001", "\u0002"


def capture(text: Column, pattern: str, group: int) -> Column:
    """A captured group, null when the pattern or an optional group is absent."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def captures(text: Column, pattern: str, groups: int) -> Column:
    """All groups of a whole-line pattern as an array, from one pass of the pattern.

    A line that does not fit gives an array with a single item.  The groups are
    set apart by a mark, so a mark in the line itself is escaped first and put
    back by :func:`captured`: no character of a line can look like a fit.
    """
    escaped = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}e")), F.lit(MARK), F.lit(f"{ESCAPE}m"))
    joined = MARK.join(f"${i + 1}" for i in range(groups))
    return F.split(F.regexp_replace(escaped, FIRST_LINE + pattern + REST, joined), MARK, groups)


def captured(found: Column, index: int) -> Column:
    """One group of :func:`captures`, null when empty."""
    group = F.get(found, F.lit(index))
    plain = F.replace(F.replace(group, F.lit(f"{ESCAPE}m"), F.lit(MARK)), F.lit(f"{ESCAPE}e"), F.lit(ESCAPE))
    return F.nullif(F.when(F.contains(group, F.lit(ESCAPE)), plain).otherwise(group), F.lit(""))


def payload_fields(payload: Column) -> Column:
    """The comma-separated fields as an array: trimmed, empty ones null."""
    return F.transform(F.split(payload, ","), lambda x: F.nullif(F.trim(x), F.lit("")))


def payload_field(fields: Column, name: str) -> Column:
    """One of :func:`payload_fields` by name; a short line lacks the later ones."""
    return F.get(fields, F.lit(S.FILTERLOG_FIELDS.index(name)))


def typed(value: Column, name: str) -> Column:
    if name in S.LONG_FIELDS:
        return value.try_cast("bigint")
    if name in S.INT_FIELDS:
        return value.try_cast("int")
    return value


def iso_time(text: Column, zone: str = "UTC") -> Column:
    """ISO 8601 time; ``zone`` applies only where the text names no offset."""
    stamp = F.try_to_timestamp(F.regexp_replace(text, ",", "."))
    has_offset = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.rlike(r"[T ]\d{2}")
    return F.when(has_offset, stamp).otherwise(F.to_utc_timestamp(stamp, zone))


def bsd_time(text: Column, year: int, zone: str = LOG_TIME_ZONE) -> Column:
    """``Mon d HH:mm:ss`` has no year and no zone: both are arguments."""
    full = F.concat(F.lit(f"{year} "), F.regexp_replace(text, r"\s+", " "))
    return F.to_utc_timestamp(F.try_to_timestamp(full, F.lit("yyyy MMM d HH:mm:ss")), zone)


def log_type(program: Column) -> Column:
    return (
        F.when(program == "filterlog", "firewall")
        .when(program.isin("dhcpd", "dhclient"), "dhcp")
        .when(program.contains("openvpn"), "vpn")
        .when(program.isin("php-fpm", "nginx"), "web_gui")
        .otherwise("system")
    )


def dhcp_fields(message: Column) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for name in ("dhcp_action", "dhcp_ip", "dhcp_interface", "dhcp_server"):
        rule = None
        for pattern, groups in DHCP_FORMS:
            value = (
                capture(message, pattern, groups.index(name) + 1)
                if name in groups else F.lit(None).cast("string")
            )
            fits = message.rlike(pattern)
            rule = F.when(fits, value) if rule is None else rule.when(fits, value)
        out[name] = rule
    any_form = message.rlike("|".join(pattern for pattern, _ in DHCP_FORMS))
    out["dhcp_message"] = F.when(~any_form, message)
    return out


def vpn_fields(message: Column) -> dict[str, Column]:
    fits = message.rlike(VPN_FORM)
    return {
        "vpn_client_ip": capture(message, VPN_FORM, 1),
        "vpn_client_port": capture(message, VPN_FORM, 2),
        "vpn_message": F.when(fits, capture(message, VPN_FORM, 3)).otherwise(message),
    }
