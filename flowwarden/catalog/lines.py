"""Queries: parsing raw lines, enrichment, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwarden import schema as S
from flowwarden.catalog.registry import flag, i8, query, r6, stamp
from flowwarden.catalog.tables import fw, load, with_fw
from flowwarden.functions import enrich as E
from flowwarden.functions import parsing as G
from flowwarden.operators import clean as C
from flowwarden.operators import enrich as N
from flowwarden.operators import lookups as K
from flowwarden.operators import parse as P
from flowwarden.plans.storage import materialize, new_path
from flowwarden.sources import readers, writers
from flowwarden.streaming import jobs as J
from flowwarden.streaming.counters import Totals

# ---- raw lines: 29 fields behind a header; some damaged, some of version 6 ----
PAYLOAD_SQL = """concat_ws(',', CAST(event_id % 90 AS VARCHAR(20)), '', '', CAST(1000000000 + event_id % 500 AS VARCHAR(20)),
  'em1', reason, action, dir, CASE WHEN event_id % 40 = 39 THEN '6' ELSE '4' END, '0x0', '', CAST(ttl AS VARCHAR(10)),
  CAST(event_id AS VARCHAR(20)), '0', 'DF', CASE proto_name WHEN 'tcp' THEN '6' WHEN 'udp' THEN '17' ELSE '1' END,
  proto_name, CAST(length AS VARCHAR(10)), src_ip, dst_ip, CAST(src_port AS VARCHAR(10)),
  CASE WHEN event_id % 61 = 0 THEN 'x' ELSE CAST(dst_port AS VARCHAR(10)) END, CAST(data_length AS VARCHAR(10)),
  coalesce(tcp_flags, ''), CAST(event_id * 31 AS VARCHAR(20)), '', coalesce(CAST(tcp_window AS VARCHAR(10)), ''), '',
  'mss;sackOK;TS')"""
LINE_SQL = f"""CASE WHEN event_id % 50 = 49 THEN concat('damaged ', CAST(event_id AS VARCHAR(20)), ' ', proto_name)
  ELSE concat('<134>1 ', {{iso}}, '+00:00 fw1.example.net filterlog 98188 - - ', {PAYLOAD_SQL}) END"""
SPARK_TIMES = {"iso": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")", "bsd": "date_format(ts, 'MMM d HH:mm:ss')"}
DUCK_TIMES = {"iso": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')", "bsd": "strftime(ts, '%b %-d %H:%M:%S')"}
LINES_DUCK = f"lines AS (SELECT event_id, {LINE_SQL.format(**DUCK_TIMES)} AS message FROM fw)"


def _duck(pattern: str) -> str:
    return pattern.replace("'", "''")


def cap(text: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({text}, '{_duck(pattern)}', {group}), '')"


HEADER_DUCK = "heads AS (SELECT *, " + ", ".join(
    f"{cap('message', G.STRICT_HEADER, i + 1)} AS {n}" for i, n in enumerate(G.STRICT_GROUPS)) + " FROM lines)"
FIELDS_DUCK = "fields AS (SELECT *, " + ", ".join(
    f"nullif(trim(string_split(payload, ',')[{i + 1}]), '') AS \"{n}\"" for i, n in enumerate(S.FILTERLOG_FIELDS)
) + " FROM heads WHERE string_split(payload, ',')[9] = '4')"


def with_lines(body: str) -> str:
    return with_fw(f", {LINES_DUCK}, {HEADER_DUCK}, {FIELDS_DUCK} {body}")


def raw_lines(spark, sf):
    return fw(spark, sf).selectExpr("event_id", f"{LINE_SQL.format(**SPARK_TIMES)} AS message")


@query("parse_rfc5424", with_lines(f"""SELECT event_id, {', '.join(G.STRICT_GROUPS)},
  CASE WHEN payload IS NULL THEN '{P.HEADER_FAILURE}' ELSE '' END AS tags FROM heads"""))
def parse_rfc5424(spark, sf):
    return P.parse_header(raw_lines(spark, sf)).select("event_id", *G.STRICT_GROUPS, "tags")


@query("ipv4_only", with_lines("SELECT event_id, payload FROM heads WHERE string_split(payload, ',')[9] = '4'"))
def ipv4_only(spark, sf):
    return P.ipv4_only(P.parse_header(raw_lines(spark, sf))).select("event_id", "payload")


@query("parse_filterlog", with_lines("SELECT event_id, " + ", ".join(
    f'"{n}"' for n in S.FILTERLOG_FIELDS) + " FROM fields"))
def parse_filterlog(spark, sf):
    rows = P.ipv4_only(P.parse_header(raw_lines(spark, sf)))
    return P.parse_filterlog(rows).select("event_id", *S.FILTERLOG_FIELDS)


def _typed_duck(n: str) -> str:
    e = f'"{n}"'
    if n in S.LONG_FIELDS or n in S.INT_FIELDS:
        e = f"TRY_CAST({e} AS BIGINT)"
    if n in S.PORT_FIELDS:
        e = f"CASE WHEN proto_name IN ('tcp', 'udp') THEN {e} END"
    elif n in S.TCP_FIELDS:
        e = f"CASE WHEN proto_name = 'tcp' THEN {e} END"
    return f"{e} AS {'tcp_window' if n == 'window' else chr(34) + n + chr(34)}"


@query("parse_typed", with_lines("SELECT " + ", ".join(
    [_typed_duck(n) for n in S.FILTERLOG_FIELDS if n not in S.WORK_FIELDS]) +
    f""", hostname, program, pid, event_id,
  {stamp("strptime(log_time, '%Y-%m-%dT%H:%M:%S.%f+00:00')")} AS "@timestamp" FROM fields"""))
def parse_typed(spark, sf):
    rows = P.parse_lines(raw_lines(spark, sf))
    return rows.select("event_id", *S.filterlog_schema().fieldNames())


@query("parse_errors", with_lines(f"""SELECT event_id, message, '{P.HEADER_FAILURE}' AS tags
FROM heads WHERE payload IS NULL"""))
def parse_errors(spark, sf):
    return P.parse_errors(raw_lines(spark, sf))


# ---- every line is accepted, of another version, or rejected ----
ODD_SQL = f"""CASE event_id % 23 WHEN 1 THEN concat('junk ', chr(1), ' line') WHEN 2 THEN concat({LINE_SQL}, ',', chr(1))
  WHEN 3 THEN concat({LINE_SQL}, chr(10), 'second, line') WHEN 4 THEN '' WHEN 5 THEN NULL
  WHEN 6 THEN concat('<134>1 ', {{iso}}, '+00:00 fw1 filterlog 98188 - - 5,,,100') WHEN 7 THEN concat({LINE_SQL}, ',', chr(2), 'e')
  WHEN 8 THEN concat(chr(1), {LINE_SQL}) ELSE {LINE_SQL} END"""
_FITS = f"coalesce(regexp_matches(message, '{_duck(G.STRICT_HEADER)}'), false)"
_WANTED = f"regexp_matches(message, '{_duck(G.STRICT_HEADER.removesuffix('(.*)') + G.IPV4_PAYLOAD)}')"


@query("parse_accounting", with_fw(f""", odd AS (SELECT event_id, {ODD_SQL.format(**DUCK_TIMES)} AS message FROM fw),
  told AS (SELECT event_id, message, CASE WHEN NOT {_FITS} THEN 'rejected' WHEN {_WANTED} THEN 'accepted' ELSE 'other version' END AS outcome FROM odd)
SELECT outcome, {i8('count(*)')} AS n, {i8('sum(event_id)')} AS ids FROM told GROUP BY outcome
UNION ALL SELECT 'input', {i8('count(*)')}, {i8('sum(event_id)')} FROM told
UNION ALL SELECT 'last payload', {i8('count(*)')}, {i8("sum(length(regexp_extract(message, '" + _duck(G.STRICT_HEADER) + "', 6)))")} FROM told WHERE outcome = 'accepted'"""))
def parse_accounting(spark, sf):
    """Three outcomes that add up to the input, and the length of the accepted payloads."""
    # The lines are made once: every part below reads them, and a filter moved below them would make them again.
    rows = materialize(fw(spark, sf).selectExpr("event_id", f"{ODD_SQL.format(**SPARK_TIMES)} AS message"), "lines")
    headed = P.parse_header(rows)
    fits = headed.filter(~F.array_contains("tags", P.HEADER_FAILURE))
    accepted = P.ipv4_only(fits)
    other = fits.filter(~F.coalesce(F.col("payload").rlike(G.FIRST_LINE + "^" + G.IPV4_PAYLOAD), F.lit(False)))
    parts = [("rejected", P.parse_errors(rows)), ("accepted", P.parse_lines(rows)), ("other version", other), ("input", rows)]
    out = None
    for name, part in parts:
        one = part.agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).select(F.lit(name).alias("outcome"), "n", "ids")
        out = one if out is None else out.unionByName(one)
    last = accepted.agg(F.count("*").alias("n"), F.sum(F.length("payload")).alias("ids"))
    return out.unionByName(last.select(F.lit("last payload").alias("outcome"), "n", "ids"))


# ---- mixed programs and header forms ----
MIXED_SQL = """CASE event_id % 9
  WHEN 0 THEN concat('<134>1 ', {iso}, '+07:00 fw1 filterlog 98188 - - 5,,,100,em1,match,', action)
  WHEN 1 THEN concat('<134>', {bsd}, ' fw1 filterlog[123]: 5,,,100,em1,match,', action)
  WHEN 2 THEN concat('<30>', {iso}, ' fw1 dhcpd - - DHCP', CASE event_id % 2 WHEN 0 THEN 'ACK on ' ELSE 'OFFER from ' END, src_ip, ' to 00:aa via em1')
  WHEN 3 THEN concat('<30>', {bsd}, ' fw1 dhcpd: DHCPREQUEST for ', CASE WHEN event_id % 5 = 0 THEN 'fe80::a1' ELSE src_ip END, ' from 00:11:22:33:44:55 via em1')
  WHEN 4 THEN concat('<30>', {bsd}, ' fw1 dhclient[77]: DHCPDISCOVER on em0 to ', dst_ip, ' port 67')
  WHEN 5 THEN concat('<29>', {bsd}, ' fw1 openvpn[88]: ', CASE WHEN event_id % 5 = 0 THEN '2001:db8::1' ELSE src_ip END, ':', CAST(src_port AS VARCHAR(10)), ' TLS handshake ', proto_name)
  WHEN 6 THEN concat('<29>1 ', {iso}, 'Z fw1 openvpn-server 5 - - Initialization of ', proto_name, ' done')
  WHEN 7 THEN concat('<190>', {bsd}, ' fw1 ', CASE event_id % 2 WHEN 0 THEN 'nginx' ELSE 'php-fpm[9]' END, ': request from ', src_ip)
  ELSE CASE WHEN event_id % 2 = 0 THEN concat('no header ', proto_name) ELSE concat('<13>', {bsd}, ' fw1 sshd[5]: lease pool of ', src_ip) END END"""
MIXED_DUCK = f"mixed AS (SELECT event_id, ts, {MIXED_SQL.format(**DUCK_TIMES)} AS message FROM fw)"
NAMES = ["syslog_pri", "log_time", "hostname", "program", "pid", "payload"]


def _relaxed_duck(i: int) -> str:
    if i == 4:
        return f"coalesce({cap('message', G.RELAXED_HEADER, 5)}, {cap('message', G.RELAXED_HEADER, 6)})"
    e = cap("message", G.RELAXED_HEADER, 7 if i == 5 else i + 1)
    return f"trim({e})" if i == 5 else e


RELAXED_DUCK = ("relaxed AS (SELECT *, regexp_matches(message, '" + _duck(G.RELAXED_HEADER) + "') AS is_relaxed, "
                "regexp_matches(message, '" + _duck(G.BSD_HEADER) + "') AS is_bsd, "
                + ", ".join(f"{_relaxed_duck(i)} AS r_{n}" for i, n in enumerate(NAMES)) + ", "
                + ", ".join(f"{cap('message', G.BSD_HEADER, i + 1)} AS b_{n}" for i, n in enumerate(NAMES))
                + " FROM mixed)")
HEADED_DUCK = ("headed AS (SELECT event_id, ts, " + ", ".join(
    f"CASE WHEN is_relaxed THEN r_{n} WHEN is_bsd THEN b_{n} END AS {n}" for n in NAMES)
    + ", CASE WHEN is_relaxed THEN 'rfc5424' WHEN is_bsd THEN 'bsd' END AS header_form FROM relaxed)")


def with_mixed(body: str) -> str:
    return with_fw(f", {MIXED_DUCK}, {RELAXED_DUCK}, {HEADED_DUCK} {body}")


def mixed_lines(spark, sf):
    return fw(spark, sf).selectExpr("event_id", f"{MIXED_SQL.format(**SPARK_TIMES)} AS message")


def headed(spark, sf):
    return P.parse_header_relaxed(mixed_lines(spark, sf))


@query("parse_syslog_relaxed", with_mixed("SELECT event_id, " + ", ".join(
    f"CASE WHEN is_relaxed THEN r_{n} END AS {n}" for n in NAMES) + " FROM relaxed"))
def parse_syslog_relaxed(spark, sf):
    return P.parse_header_relaxed(mixed_lines(spark, sf), bsd_fallback=False).select("event_id", *NAMES)


@query("parse_syslog_fallback", with_mixed(f"""SELECT event_id, {', '.join(NAMES)}, header_form,
  CASE WHEN header_form IS NULL THEN '{P.HEADER_FAILURE}' ELSE '' END AS tags FROM headed"""))
def parse_syslog_fallback(spark, sf):
    return headed(spark, sf).select("event_id", *NAMES, "header_form", "tags")


@query("parse_time_fallback", with_mixed(f"""SELECT event_id, {stamp('''CASE WHEN header_form = 'bsd'
  THEN date_trunc('second', ts) - INTERVAL 7 HOUR WHEN log_time LIKE '%Z' THEN ts
  WHEN header_form = 'rfc5424' THEN ts - INTERVAL 7 HOUR END''')} AS at_utc FROM headed"""))
def parse_time_fallback(spark, sf):
    return P.assign_time_fallback(headed(spark, sf), 2024, out="at_utc").select("event_id", "at_utc")


TYPE_SQL = """CASE WHEN program = 'filterlog' THEN 'firewall' WHEN program IN ('dhcpd', 'dhclient') THEN 'dhcp'
  WHEN contains(program, 'openvpn') THEN 'vpn' WHEN program IN ('php-fpm', 'nginx') THEN 'web_gui' ELSE 'system' END"""


@query("log_type_counts", with_mixed(f"SELECT {TYPE_SQL} AS log_type, {i8('count(*)')} AS n FROM headed GROUP BY ALL"))
def log_type_counts(spark, sf):
    return P.route_programs(headed(spark, sf)).groupBy("log_type").agg(F.count("*").alias("n"))


FORMS = [_duck(p) for p, _ in G.DHCP_FORMS]


@query("parse_dhcp", with_mixed(f"""SELECT event_id, payload,
  CASE WHEN regexp_matches(payload, '{FORMS[0]}') THEN regexp_extract(payload, '{FORMS[0]}', 1)
    WHEN regexp_matches(payload, '{FORMS[1]}') THEN regexp_extract(payload, '{FORMS[1]}', 1)
    WHEN regexp_matches(payload, '{FORMS[2]}') THEN regexp_extract(payload, '{FORMS[2]}', 1) END AS dhcp_action,
  CASE WHEN regexp_matches(payload, '{FORMS[0]}') THEN regexp_extract(payload, '{FORMS[0]}', 2)
    WHEN regexp_matches(payload, '{FORMS[1]}') THEN regexp_extract(payload, '{FORMS[1]}', 2) END AS dhcp_ip,
  nullif(regexp_extract(payload, '{FORMS[2]}', 2), '') AS dhcp_interface,
  nullif(regexp_extract(payload, '{FORMS[2]}', 3), '') AS dhcp_server,
  CASE WHEN NOT regexp_matches(payload, '{'|'.join(FORMS)}') THEN payload END AS dhcp_message
FROM headed WHERE program IN ('dhcpd', 'dhclient', 'sshd')"""))
def parse_dhcp(spark, sf):
    rows = headed(spark, sf).filter(F.col("program").isin("dhcpd", "dhclient", "sshd"))
    return P.parse_dhcp(rows).select("event_id", "payload", "dhcp_action", "dhcp_ip", "dhcp_interface",
                                     "dhcp_server", "dhcp_message")


@query("parse_vpn", with_mixed(f"""SELECT event_id, {cap('payload', G.VPN_FORM, 1)} AS vpn_client_ip,
  {cap('payload', G.VPN_FORM, 2)} AS vpn_client_port,
  CASE WHEN regexp_matches(payload, '{_duck(G.VPN_FORM)}') THEN {cap('payload', G.VPN_FORM, 3)} ELSE payload END AS vpn_message
FROM headed WHERE contains(program, 'openvpn')"""))
def parse_vpn(spark, sf):
    rows = headed(spark, sf).filter(F.col("program").contains("openvpn"))
    return P.parse_vpn(rows).select("event_id", "vpn_client_ip", "vpn_client_port", "vpn_message")


# ---- enrichment ----
SERVICE_SQL = """CASE WHEN dst_port = 53 THEN 'DNS' WHEN dst_port = 80 THEN 'HTTP' WHEN dst_port = 443 THEN 'HTTPS'
  WHEN dst_port = 22 THEN 'SSH' WHEN dst_port IN (20, 21) THEN 'FTP' WHEN dst_port IN (25, 465, 587) THEN 'SMTP'
  WHEN dst_port = 3389 THEN 'RDP' WHEN dst_port IN (139, 445) THEN 'SMB'
  WHEN dst_port BETWEEN 1024 AND 49151 THEN 'Registered Port' WHEN dst_port >= 49152 THEN 'Dynamic/Private Port'
  ELSE 'Other' END"""
SERVICE_TAGS_SQL = """CASE dst_port WHEN 53 THEN ['dns_traffic'] WHEN 80 THEN ['web_traffic']
  WHEN 443 THEN ['web_traffic', 'encrypted_traffic'] WHEN 22 THEN ['ssh_traffic'] WHEN 20 THEN ['ftp_traffic']
  WHEN 21 THEN ['ftp_traffic'] WHEN 25 THEN ['email_traffic'] WHEN 465 THEN ['email_traffic']
  WHEN 587 THEN ['email_traffic'] WHEN 3389 THEN ['rdp_traffic'] WHEN 139 THEN ['smb_traffic']
  WHEN 445 THEN ['smb_traffic'] ELSE CASE WHEN dst_port BETWEEN 1024 AND 49151 THEN ['registered_port']
  WHEN dst_port >= 49152 THEN ['ephemeral_port'] ELSE [] END END"""
SCAN_SQL = "coalesce(src_port > 1024 AND dst_port < 1024, false)"
DNS_SQL = f"coalesce(dst_port = 53 AND NOT regexp_matches(dst_ip, '{S.KNOWN_RESOLVERS}'), false)"
SIZE_SQL = "CASE WHEN length > 1400 THEN 'large_packet' WHEN length < 100 THEN 'small_packet' END"
STATE_SQL = """CASE WHEN tcp_flags = 'S' THEN 'SYN' WHEN contains(tcp_flags, 'F') THEN 'FIN'
  WHEN contains(tcp_flags, 'R') THEN 'RST' WHEN tcp_flags = 'SA' THEN 'SYN-ACK' END"""
OS_SQL = """CASE WHEN ttl BETWEEN 60 AND 64 THEN 'Linux/Unix' WHEN ttl BETWEEN 124 AND 128 THEN 'Windows'
  WHEN ttl BETWEEN 252 AND 255 THEN 'Network Device' WHEN ttl < 30 THEN 'Suspicious Low TTL' END"""
SRC_SQL = f"""CASE WHEN regexp_matches(src_ip, '{S.PRIVATE_IP}') THEN 'internal_source'
  WHEN src_ip <> '0.0.0.0' AND src_ip <> '' THEN 'external_source' END"""
DST_SQL = f"""CASE WHEN regexp_matches(dst_ip, '{S.PRIVATE_IP}') THEN 'internal_dest'
  WHEN NOT regexp_matches(dst_ip, '{S.NOT_EXTERNAL_DEST}') AND dst_ip <> '' THEN 'external_dest' END"""
EFFICIENCY_SQL = "CASE WHEN length > 0 THEN round(CAST(data_length AS DOUBLE) / length * 100, 2) END"
SESSION_SQL = """sha256(concat('|dest_ip|', dst_ip, '|dest_port|', dst_port, '|protocol|', proto_name,
  '|src_ip|', src_ip, '|src_port|', src_port, '|'))"""
FLOW_SQL = "sha256(concat('|dest_ip|', dst_ip, '|protocol|', proto_name, '|src_ip|', src_ip, '|'))"


def _rule(name: str, sql: str, make):
    @query(name, with_fw(f"SELECT event_id, {sql} FROM fw"))
    def run(spark, sf):
        made = make(F.col)
        return fw(spark, sf).select("event_id", *[c.alias(n) for n, c in made.items()])
    return run


_rule("service_name", f"{SERVICE_SQL} AS service_name", lambda c: {"service_name": E.service_name(c("dst_port"))})
_rule("service_tags", f"array_to_string(list_sort({SERVICE_TAGS_SQL}), ',') AS service_tags",
      lambda c: {"service_tags": E.tags(*E.service_tag_rules(c("dst_port")))})
_rule("tag_potential_scan", f"{flag(SCAN_SQL)} AS potential_scan",
      lambda c: {"potential_scan": E.potential_scan(c("src_port"), c("dst_port"))})
_rule("tag_nonstandard_dns", f"{flag(DNS_SQL)} AS non_standard_dns",
      lambda c: {"non_standard_dns": E.nonstandard_dns(c("dst_port"), c("dst_ip"))})
_rule("tag_packet_size", f"{SIZE_SQL} AS size_tag", lambda c: {"size_tag": E.packet_size_tag(c("length"))})
_rule("tcp_state", f"{STATE_SQL} AS tcp_state", lambda c: {"tcp_state": E.tcp_state(c("tcp_flags"))})
_rule("suspected_os", f"{OS_SQL} AS suspected_os", lambda c: {"suspected_os": E.suspected_os(c("ttl"))})
_rule("ip_scope", f"{SRC_SQL} AS src_scope, {DST_SQL} AS dst_scope",
      lambda c: {"src_scope": E.source_scope(c("src_ip")), "dst_scope": E.destination_scope(c("dst_ip"))})
_rule("private_flags", f"{flag(f'''regexp_matches(src_ip, '{S.PRIVATE_IP}')''')} AS src_is_private, "
      f"{flag(f'''regexp_matches(dst_ip, '{S.PRIVATE_IP}')''')} AS dst_is_private",
      lambda c: {"src_is_private": E.is_private(c("src_ip")), "dst_is_private": E.is_private(c("dst_ip"))})
_rule("session_id", f"{SESSION_SQL} AS session_id", lambda c: {"session_id": E.session_id(
    c("src_ip"), c("dst_ip"), c("src_port"), c("dst_port"), c("proto_name"))})
_rule("flow_id", f"{FLOW_SQL} AS flow_id",
      lambda c: {"flow_id": E.flow_id(c("src_ip"), c("dst_ip"), c("proto_name"))})
_rule("packet_ts_ms", f"{i8('epoch_us(ts) // 1000')} AS packet_timestamp_ms",
      lambda c: {"packet_timestamp_ms": E.epoch_millis(c("ts"))})
_rule("packet_efficiency", f"{EFFICIENCY_SQL} AS packet_efficiency",
      lambda c: {"packet_efficiency": E.packet_efficiency(c("data_length"), c("length"))})

TAGS_SQL = f"""list_filter(list_concat({SERVICE_TAGS_SQL}, [
  CASE WHEN {SCAN_SQL} THEN 'potential_scan' END, CASE WHEN {DNS_SQL} THEN 'non_standard_dns' END, {SIZE_SQL},
  CASE {STATE_SQL} WHEN 'SYN' THEN 'tcp_syn' WHEN 'FIN' THEN 'tcp_fin' WHEN 'RST' THEN 'tcp_reset'
    WHEN 'SYN-ACK' THEN 'tcp_synack' END,
  CASE WHEN ttl < 30 THEN 'suspicious_ttl' END,
  CASE action WHEN 'block' THEN 'blocked' WHEN 'pass' THEN 'allowed' END, {SRC_SQL}, {DST_SQL},
  CASE WHEN {EFFICIENCY_SQL} < 20 THEN 'high_overhead' END]), lambda x: x IS NOT NULL)"""


@query("tag_counts", with_fw(f"""SELECT tag, {i8('count(*)')} AS n FROM (
  SELECT unnest({TAGS_SQL}) AS tag FROM fw) q WHERE tag <> 'allowed' GROUP BY tag"""))
def tag_counts(spark, sf):
    return N.count_tags(N.remove_tags(N.add_tags(fw(spark, sf)), ["allowed"]))


@query("enrich_connections", with_fw(f"""SELECT event_id, {SERVICE_SQL} AS service_name, {STATE_SQL} AS tcp_state,
  {OS_SQL} AS suspected_os, {SESSION_SQL} AS session_id, array_to_string(list_sort({TAGS_SQL}), ',') AS tags FROM fw"""))
def enrich_connections(spark, sf):
    return N.enrich_connections(fw(spark, sf), "ts").select(
        "event_id", "service_name", "tcp_state", "suspected_os", "session_id", "tags")


@query("flow_summary", with_fw(f"""SELECT {FLOW_SQL} AS flow_id, src_ip, dst_ip, proto_name,
  {i8('count(*)')} AS connections, {i8('sum(length)')} AS bytes FROM fw GROUP BY src_ip, dst_ip, proto_name"""))
def flow_summary(spark, sf):
    return N.flow_summary(fw(spark, sf))


# Host names from the customers, networks from the nations.
HOST_SQL = """SELECT concat('203.', CAST(FLOOR(c_custkey / 64000) % 256 AS INT), '.', CAST(FLOOR(c_custkey / 250) % 256 AS INT), '.', c_custkey % 250) AS ip,
  concat(lower(replace(c_name, '#', '-')), '.example.net') AS hostname FROM {customer} WHERE c_custkey % 2 = 0"""
NET_SQL = """SELECT CAST(3405774848 + n_nationkey * 8 AS BIGINT) AS net_start,
  CAST(3405774848 + n_nationkey * 8 + 5 AS BIGINT) AS net_end, n_name AS country, r_name AS city,
  CAST(n_nationkey AS DOUBLE) AS lat, CAST(n_regionkey AS DOUBLE) AS lon
  FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"""


@query("enrich_hostname", with_fw(f""", hosts AS ({HOST_SQL.format(customer='customer')})
SELECT event_id, fw.src_ip, CASE WHEN {SRC_SQL} = 'external_source' THEN coalesce(h.hostname, fw.src_ip) END AS src_hostname
FROM fw LEFT JOIN (SELECT ip, min(hostname) AS hostname FROM hosts GROUP BY ip) h ON h.ip = fw.src_ip"""))
def enrich_hostname(spark, sf):
    hosts = spark.sql(HOST_SQL, customer=load(spark, sf, "customer"))
    return N.add_hostname(fw(spark, sf), hosts).select("event_id", "src_ip", "src_hostname")


@query("enrich_geo", with_fw(f""", nets AS ({NET_SQL.format(nation='nation', region='region')}),
 addr AS (SELECT event_id, src_ip, CASE WHEN {SRC_SQL} = 'external_source' THEN
   CAST(string_split(src_ip, '.')[1] AS BIGINT) * 16777216 + CAST(string_split(src_ip, '.')[2] AS BIGINT) * 65536
   + CAST(string_split(src_ip, '.')[3] AS BIGINT) * 256 + CAST(string_split(src_ip, '.')[4] AS BIGINT) END AS a FROM fw)
SELECT event_id, src_ip, country, city, {r6('lat')} AS lat, {r6('lon')} AS lon
FROM addr LEFT JOIN nets ON a BETWEEN net_start AND net_end"""))
def enrich_geo(spark, sf):
    nets = spark.sql(NET_SQL, nation=load(spark, sf, "nation"), region=load(spark, sf, "region"))
    return N.add_location(fw(spark, sf), nets).select("event_id", "src_ip", "source.*")


# Destinations of every kind: outside, broadcast, multicast, link-local, inside.
DEST_SQL = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '224.0.0.5' WHEN 1 THEN '0.0.0.0' WHEN 2 THEN 'fe80::1' WHEN 3 THEN dst_ip
  ELSE src_ip END AS dst_ip FROM {fw}"""


@query("enrich_hostname_dst", with_fw(f""", dst AS ({DEST_SQL.format(fw='fw')}), hosts AS ({HOST_SQL.format(customer='customer')})
SELECT event_id, dst_ip, CASE WHEN {DST_SQL} = 'external_dest' THEN coalesce(h.hostname, dst_ip) END AS dst_hostname
FROM dst LEFT JOIN (SELECT ip, min(hostname) AS hostname FROM hosts GROUP BY ip) h ON h.ip = dst_ip"""))
def enrich_hostname_dst(spark, sf):
    hosts = spark.sql(HOST_SQL, customer=load(spark, sf, "customer"))
    return N.add_hostname(spark.sql(DEST_SQL, fw=fw(spark, sf)), hosts, "dst_ip", "dst_hostname", destination=True)


@query("enrich_geo_dst", with_fw(f""", dst AS ({DEST_SQL.format(fw='fw')}), nets AS ({NET_SQL.format(nation='nation', region='region')}),
 addr AS (SELECT event_id, dst_ip, CASE WHEN {DST_SQL} = 'external_dest' THEN
   CAST(string_split(dst_ip, '.')[1] AS BIGINT) * 16777216 + CAST(string_split(dst_ip, '.')[2] AS BIGINT) * 65536
   + CAST(string_split(dst_ip, '.')[3] AS BIGINT) * 256 + CAST(string_split(dst_ip, '.')[4] AS BIGINT) END AS a FROM dst)
SELECT event_id, dst_ip, country, city, {r6('lat')} AS lat, {r6('lon')} AS lon
FROM addr LEFT JOIN nets ON a BETWEEN net_start AND net_end"""))
def enrich_geo_dst(spark, sf):
    nets = spark.sql(NET_SQL, nation=load(spark, sf, "nation"), region=load(spark, sf, "region"))
    placed = N.add_location(spark.sql(DEST_SQL, fw=fw(spark, sf)), nets, "dst_ip", "destination", destination=True)
    return placed.select("event_id", "dst_ip", "destination.*")


# ---- networks inside networks, names that expire ----
NESTED_SQL = """SELECT concat('203.0.0.', n_nationkey * 8, '/29') AS network, n_name AS country, 'block' AS city,
    CAST(n_nationkey AS DOUBLE) AS lat, CAST(1 AS DOUBLE) AS lon FROM {nation}
  UNION ALL SELECT concat('203.0.0.', n_nationkey * 8, '/27'), n_name, 'wider', CAST(n_nationkey AS DOUBLE), CAST(2 AS DOUBLE)
    FROM {nation} WHERE n_nationkey % 4 = 0
  UNION ALL SELECT CASE r_regionkey WHEN 0 THEN '203.0.0.0/24' WHEN 1 THEN '203.0.0.0/16' WHEN 2 THEN '203.0.0.16/28'
    WHEN 3 THEN '203.0.1.0/25' ELSE '203.0.0.0/33' END, r_name, 'region', CAST(r_regionkey AS DOUBLE), CAST(3 AS DOUBLE) FROM {region}
  UNION ALL SELECT '203.0.0.32/29', 'AAA', 'again', CAST(0 AS DOUBLE), CAST(4 AS DOUBLE) FROM {region}"""


@query("enrich_geo_nested", with_fw(f""", nets AS ({NESTED_SQL.format(nation='nation', region='region')}),
 sized AS (SELECT *, CAST(string_split(network, '/')[2] AS BIGINT) AS bits, string_split(string_split(network, '/')[1], '.') AS p FROM nets),
 cut AS (SELECT *, ((CAST(p[1] AS BIGINT) * 16777216 + CAST(p[2] AS BIGINT) * 65536 + CAST(p[3] AS BIGINT) * 256 + CAST(p[4] AS BIGINT))
   // CAST(pow(2, 32 - bits) AS BIGINT)) AS prefix FROM sized WHERE bits <= 32),
 addr AS (SELECT event_id, src_ip, CASE WHEN {SRC_SQL} = 'external_source' THEN
   CAST(string_split(src_ip, '.')[1] AS BIGINT) * 16777216 + CAST(string_split(src_ip, '.')[2] AS BIGINT) * 65536
   + CAST(string_split(src_ip, '.')[3] AS BIGINT) * 256 + CAST(string_split(src_ip, '.')[4] AS BIGINT) END AS a FROM fw)
SELECT event_id, src_ip, country, city, {r6('lat')} AS lat, {r6('lon')} AS lon FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY bits DESC, country) AS rn
  FROM addr LEFT JOIN cut ON a // CAST(pow(2, 32 - bits) AS BIGINT) = prefix) q WHERE rn = 1"""))
def enrich_geo_nested(spark, sf):
    nets = spark.sql(NESTED_SQL, nation=load(spark, sf, "nation"), region=load(spark, sf, "region"))
    return K.add_location_by_prefix(fw(spark, sf), nets).select("event_id", "src_ip", "source.*")


# A source is looked up at some of its events; every third lookup fails.
LOOKUP_SQL = """SELECT src_ip AS ip, CASE WHEN event_id % 3 <> 0 THEN concat('h', event_id % 7, '.example.net') END AS hostname,
  ts AS looked_up_at FROM {fw} WHERE event_id % 5 = 0"""
NAME_HIT, NAME_FAILED = 36 * 3600, 6 * 3600


@query("enrich_hostname_asof", with_fw(f""", looked AS ({LOOKUP_SQL.format(fw='fw')}),
 once AS (SELECT ip, looked_up_at, min(hostname) AS hostname FROM looked GROUP BY ip, looked_up_at)
SELECT event_id, src_ip, CASE WHEN {SRC_SQL} = 'external_source' THEN coalesce(CASE WHEN o.looked_up_at +
  to_seconds(CASE WHEN hostname IS NULL THEN {NAME_FAILED} ELSE {NAME_HIT} END) > fw.ts THEN hostname END, src_ip) END AS src_hostname
FROM fw ASOF LEFT JOIN once o ON fw.src_ip = o.ip AND fw.ts >= o.looked_up_at"""))
def enrich_hostname_asof(spark, sf):
    rows = fw(spark, sf)
    looked = spark.sql(LOOKUP_SQL, fw=rows)
    named = K.add_hostname_asof(rows, looked, ts="ts", hit_seconds=NAME_HIT, failed_seconds=NAME_FAILED, bucket_seconds=86_400)
    return named.select("event_id", "src_ip", "src_hostname")


LINES_PER_FILE, FILES_PER_BATCH = 250_000, 24


@query("parse_stream_counts", with_fw(f""", odd AS (SELECT event_id, {ODD_SQL.format(**DUCK_TIMES)} AS message FROM fw),
  told AS (SELECT event_id, CASE WHEN NOT {_FITS} THEN 'rejected' WHEN {_WANTED} THEN 'accepted' ELSE 'other version' END AS outcome FROM odd)
SELECT outcome, {i8('count(*)')} AS counted, {i8("CASE WHEN outcome = 'other version' THEN 0 ELSE count(*) END")} AS written,
  {i8("CASE WHEN outcome = 'other version' THEN 0 ELSE sum(event_id) END")} AS ids FROM told GROUP BY outcome
UNION ALL SELECT 'read', {i8('count(*)')}, {i8("count(*) FILTER (outcome <> 'other version')")},
  {i8("sum(event_id) FILTER (outcome <> 'other version')")} FROM told"""))
def parse_stream_counts(spark, sf):
    """Lines parsed as a stream in several batches: what is counted, and what is in the two tables."""
    base = new_path(spark, "parse-stream")
    rows = fw(spark, sf).selectExpr("event_id", f"{ODD_SQL.format(**SPARK_TIMES)} AS message")
    # Files of at most so many lines, however many there are, and half of the files or a fixed number in a batch.
    files = max(4, -(-load(spark, sf, "events").count() // LINES_PER_FILE))
    rows.repartition(files, "event_id").write.parquet(f"{base}/in")
    totals = Totals(spark, f"{base}/totals")
    stream = J.tail_table(spark, f"{base}/in", rows.schema, max_files=min(files // 2, FILES_PER_BATCH))
    running = J.parse_stream(stream, f"{base}/ok", f"{base}/bad", f"{base}/state", totals)
    running.awaitTermination()
    counted = totals.table(["read", "accepted", "rejected", "other_version"]).drop("query", "last_batch")
    counted = counted.withColumnRenamed("other_version", "other version").unpivot([], counted.columns[:3] + ["other version"], "outcome", "counted")
    written = [spark.read.parquet(f"{base}/{f}").select("event_id", F.lit(o).alias("outcome")) for f, o in (("ok", "accepted"), ("bad", "rejected"))]
    kept = written[0].unionByName(written[1]).rollup("outcome").agg(F.count(F.lit(1)).alias("written"), F.sum("event_id").alias("ids"))
    kept = kept.withColumn("outcome", F.coalesce("outcome", F.lit("read")))
    return counted.join(kept, "outcome", "left").na.fill(0, ["written", "ids"])


# ---- sources and sinks ----
EXPORT_SQL = f"""SELECT event_id, {stamp('ts')} AS "@timestamp",
  CASE WHEN event_id % 7 = 0 THEN concat(src_port, ',', src_port + 1) ELSE CAST(src_port AS VARCHAR) END AS src_port,
  CAST(dst_port AS VARCHAR) AS dst_port, action, CAST(ttl AS VARCHAR) AS ttl FROM fw"""


@query("scan_ndjson", with_fw(EXPORT_SQL))
def scan_ndjson(spark, sf):
    """Export rows (arrays, and a column mixing arrays and scalars) written and read back."""
    path = new_path(spark, "export")
    rows = fw(spark, sf)
    lists = rows.select(F.to_json(F.struct(
        "event_id", F.array(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).alias("@timestamp"),
        F.array("action").alias("action"), F.array(F.col("ttl").cast("string")).alias("ttl"),
        F.when(F.col("event_id") % 7 == 0, F.array("src_port", F.col("src_port") + 1))
        .otherwise(F.array("src_port")).alias("src_port"), F.array("dst_port").alias("dst_port"))).alias("value"))
    scalars = F.regexp_replace("value", r'"dst_port":\[(\d+)\]', r'"dst_port":$1')
    lists.select(F.when(F.length("value") % 2 == 0, scalars).otherwise(F.col("value")).alias("value")).write.text(path)
    text = [T.StructField(n, T.StringType()) for n in ("@timestamp", "src_port", "dst_port", "action", "ttl")]
    read = readers.read_ndjson(spark, path, T.StructType([T.StructField("event_id", T.LongType()), *text]))
    flat = C.normalize_json_text(read, [f.name for f in text])
    return flat.withColumn("@timestamp", F.try_to_timestamp("@timestamp"))


HIT_NAMES = ["action", "src_ip", "dst_port", "options"]


@query("flatten_hits", with_fw("""SELECT event_id, action, src_ip,
  CASE WHEN event_id % 3 <> 1 AND event_id % 5 = 0 THEN concat('["', dst_port, '","', dst_port + 1, '"]')
    ELSE CAST(dst_port AS VARCHAR) END AS dst_port, CAST(NULL AS VARCHAR) AS options FROM fw"""))
def flatten_hits(spark, sf):
    c = F.col
    port = F.when(c("event_id") % 5 == 0, F.array(c("dst_port"), c("dst_port") + 1)).otherwise(F.array("dst_port"))
    lists = F.struct(F.array("action").alias("action"), F.array("src_ip").alias("src_ip"),
                     port.alias("dst_port"), F.array().cast("array<string>").alias("options"))
    flat = F.struct("action", "src_ip", "dst_port")
    hit = (F.when(c("event_id") % 3 == 0, F.to_json(F.struct(lists.alias("fields"))))
           .when(c("event_id") % 3 == 1, F.to_json(F.struct(flat.alias("_source"))))
           .otherwise(F.to_json(lists)))
    return readers.flatten_hits(fw(spark, sf).select("event_id", hit.alias("hit")), HIT_NAMES)


CURSOR = ("2024-01-10 00:00:00", 1_000)


@query("incremental_fetch", with_fw(f"""SELECT event_id, {stamp('ts')} AS ts, src_ip, action FROM fw
WHERE (ts, event_id) > (TIMESTAMP '{CURSOR[0]}', {CURSOR[1]}) ORDER BY ts, event_id LIMIT 200"""))
def incremental_fetch(spark, sf):
    return readers.fetch_after(fw(spark, sf), *CURSOR, S.FETCH_ROWS, ts="ts").select(
        "event_id", "ts", "src_ip", "action")


@query("bootstrap_checkpoint", with_fw(f"SELECT {stamp('max(ts)')} AS checkpoint FROM fw"))
def bootstrap_checkpoint(spark, sf):
    return readers.newest_time(fw(spark, sf), "ts")


@query("fetch_stats", with_fw(f""", b AS (SELECT * FROM fw WHERE (ts, event_id) > (TIMESTAMP '{CURSOR[0]}', {CURSOR[1]})
  ORDER BY ts, event_id LIMIT 200)
SELECT {i8('count(*)')} AS last_batch_size, {stamp('max(ts)')} AS checkpoint,
  {i8('(SELECT count(*) FROM fw)')} AS total_available FROM b"""))
def fetch_stats(spark, sf):
    rows = fw(spark, sf)
    return readers.fetch_stats(rows, readers.fetch_after(rows, *CURSOR, S.FETCH_ROWS, ts="ts"), "ts")


@query("fetch_stats_stream", with_fw(f"""SELECT {i8('count(*)')} AS total_fetched, {stamp('max(ts)')} AS checkpoint FROM fw"""))
def fetch_stats_stream(spark, sf):
    """Totals of a stream that reads one file per batch."""
    path = new_path(spark, "totals")
    rows = fw(spark, sf)
    rows.repartition(5, "event_id").write.parquet(f"{path}/in")
    stream = J.tail_table(spark, f"{path}/in", rows.schema, max_files=1)
    J.count_batches(stream, f"{path}/counts", f"{path}/state", "ts").awaitTermination()
    return J.stream_stats(spark, f"{path}/counts").select("total_fetched", "checkpoint")


@query("daily_partition_counts", with_fw(f"""SELECT strftime(ts, '%Y-%m-%d') AS event_date, {i8('count(*)')} AS n,
  {i8('sum(length)')} AS bytes FROM fw GROUP BY ALL"""))
def daily_partition_counts(spark, sf):
    path = new_path(spark, "daily")
    writers.write_daily(fw(spark, sf), path, "ts")
    return spark.read.parquet(path).groupBy("event_date").agg(
        F.count("*").alias("n"), F.sum("length").alias("bytes"))


@query("stream_tail", with_fw(f"""SELECT 'firewall' AS type, action, {i8('count(*)')} AS n
FROM (SELECT event_type AS action FROM events) q GROUP BY ALL"""))
def stream_tail(spark, sf):
    """The events table followed as a stream until it is used up, appended to files."""
    events = load(spark, sf, "events")
    path = new_path(spark, "tail")
    rows = J.tail_table(spark, sf, events.schema, "events.parquet").select(
        F.lit("firewall").alias("type"), F.col("event_type").alias("action"))
    J.write_table(rows, f"{path}/rows", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/rows").groupBy("type", "action").agg(F.count("*").alias("n"))


@query("stream_lines", with_lines(f"""SELECT proto_name, action, {i8('count(*)')} AS n,
  {i8("sum(TRY_CAST(length AS BIGINT))")} AS bytes FROM fields GROUP BY ALL"""))
def stream_lines(spark, sf):
    """Raw lines followed from a folder and parsed as they arrive."""
    path = new_path(spark, "lines")
    raw_lines(spark, sf).select("message").write.text(f"{path}/in")
    rows = P.parse_lines(J.tail_lines(spark, f"{path}/in")).select("proto_name", "action", "length")
    J.write_table(rows, f"{path}/rows", f"{path}/state", kind="json").awaitTermination()
    read = spark.read.schema("proto_name string, action string, length int").json(f"{path}/rows")
    return read.groupBy("proto_name", "action").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
