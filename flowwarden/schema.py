"""Record layouts and the fixed values every rule refers to."""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# The positions of the 29 comma-separated payload fields.
# --------------------------------------------------------------------------
FILTERLOG_FIELDS = [
    "rule_number", "sub_rule_number", "anchor", "tracker", "real_interface",
    "reason", "action", "dir", "ip_version", "tos", "ecn", "ttl", "id",
    "offset", "flags", "proto_id", "proto_name", "length", "src_ip", "dst_ip",
    "src_port", "dst_port", "data_length", "tcp_flags", "sequence_number",
    "ack", "window", "urg", "options",
]

# Names used by older exports of the same log, and ours.
FIELD_ALIASES = {
    "syslog_hostname": "hostname",
    "syslog_program": "program",
    "syslog_pid": "pid",
    "sub_rule": "sub_rule_number",
    "interface": "real_interface",
    "direction": "dir",
    "protocol_id": "proto_id",
    "protocol": "proto_name",
    "dest_ip": "dst_ip",
    "dest_port": "dst_port",
    "sequence": "sequence_number",
    "window": "tcp_window",
}

# Which payload fields carry numbers.
LONG_FIELDS = ["rule_number", "tracker", "ttl", "id", "offset", "window"]
INT_FIELDS = ["ip_version", "proto_id", "length", "src_port", "dst_port", "data_length"]
# Work fields that do not leave the parser.
WORK_FIELDS = ["sub_rule_number", "anchor"]

# Ports exist for these protocols only; flags and sequence numbers for TCP only.
PORT_PROTOCOLS = ["tcp", "udp"]
PORT_FIELDS = ["src_port", "dst_port", "data_length"]
TCP_FIELDS = ["tcp_flags", "sequence_number", "ack", "window", "urg", "options"]


def filterlog_schema() -> T.StructType:
    """The typed table a parsed and accepted line becomes."""
    head = [
        T.StructField("@timestamp", T.TimestampType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("program", T.StringType()),
        T.StructField("pid", T.StringType()),
    ]
    body = []
    for name in FILTERLOG_FIELDS:
        if name in WORK_FIELDS:
            continue
        kind = (
            T.LongType() if name in LONG_FIELDS
            else T.IntegerType() if name in INT_FIELDS
            else T.StringType()
        )
        body.append(T.StructField("tcp_window" if name == "window" else name, kind))
    return T.StructType(head + body)


def training_index_schema() -> T.StructType:
    """Declared types of the training index (only the fields that can be computed)."""
    return T.StructType([
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("action", T.StringType()),
        T.StructField("direction", T.StringType()),
        T.StructField("proto", T.StringType()),
        T.StructField("src_is_private", T.BooleanType()),
        T.StructField("dst_is_private", T.BooleanType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("tcp_flags", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ])


def block_event_schema() -> T.StructType:
    """One row of the append-only block table."""
    return T.StructType([
        T.StructField("ip", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("event_at", T.TimestampType()),
    ])


# --------------------------------------------------------------------------
# Columns a table must have before it is cleaned, by group.
# --------------------------------------------------------------------------
REQUIRED_COLUMNS = {
    "behavioral": ["src_port", "dst_port", "proto_name", "action", "dir"],
    "temporal": ["@timestamp"],
    "packet": ["length", "ttl"],
    "context": ["src_ip", "dst_ip"],
}
REQUIRED_TYPES = {
    "src_port": "double", "dst_port": "double", "length": "double", "ttl": "double",
    "@timestamp": "timestamp",
}

# Which columns each cleaning step touches.
NUMERIC_COLUMNS = ["src_port", "dst_port", "length", "ttl", "id", "data_length", "offset", "tracker"]
LOWERED_COLUMNS = ["action", "proto_name", "dir"]
CRITICAL_COLUMNS = ["action", "proto_name", "@timestamp"]
CONSTANT_FILLS = {"src_port": 0, "dst_port": 0, "dir": "unknown"}
MEDIAN_COLUMNS = ["length", "ttl", "data_length"]
CLIPPED_COLUMNS = ["src_port", "dst_port", "length", "ttl"]
TRIMMED_TEXT_COLUMNS = ["action", "proto_name", "dir", "reason"]
TRIMMED_IP_COLUMNS = ["src_ip", "dst_ip"]
IQR_FACTOR = 3.0

# --------------------------------------------------------------------------
# Port groups.
# --------------------------------------------------------------------------
HIGH_RISK_PORTS = [21, 22, 23, 25, 80, 443, 445, 3389, 8080, 3306, 5432, 1433]
WEB_PORTS = [80, 443, 8080, 8443]
DATABASE_PORTS = [3306, 5432, 1433, 27017]
PEAK_HOURS = [9, 10, 11, 14, 15, 16]

# Service name and tags per destination port; ports not listed
# fall into the registered, dynamic or other range.
SERVICES = [
    ("DNS", [53], ["dns_traffic"]),
    ("HTTP", [80], ["web_traffic"]),
    ("HTTPS", [443], ["web_traffic", "encrypted_traffic"]),
    ("SSH", [22], ["ssh_traffic"]),
    ("FTP", [20, 21], ["ftp_traffic"]),
    ("SMTP", [25, 465, 587], ["email_traffic"]),
    ("RDP", [3389], ["rdp_traffic"]),
    ("SMB", [139, 445], ["smb_traffic"]),
]
REGISTERED_RANGE = (1024, 49151)
DYNAMIC_START = 49152

# Address patterns.
PRIVATE_IP = r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[0-1])\.)"
PRIVATE_OR_LOOPBACK_IP = r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[0-1])\.|127\.)"
NOT_EXTERNAL_DEST = r"^(224\.|0\.0\.0\.0|fe80|ff02)"
KNOWN_RESOLVERS = r"^(10\.0\.1\.1|8\.8\.8\.8|8\.8\.4\.4|1\.1\.1\.1|1\.0\.0\.1)"

# --------------------------------------------------------------------------
# Detection thresholds.
# --------------------------------------------------------------------------
SEVERITY_BANDS = [("CRITICAL", -0.5), ("HIGH", -0.3), ("MEDIUM", -0.1)]
SEVERITY_FLOOR = "LOW"
ALT_SEVERITY_BANDS = [("CRITICAL", -0.4), ("HIGH", -0.3), ("MEDIUM", -0.2), ("LOW", -0.1)]
ALT_SEVERITY_FLOOR = "INFO"
SEVERITY_ORDER = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
BLOCK_SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM"]
ALERT_SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM"]
ALERTS_PER_MINUTE = 10

WINDOW_SECONDS = 60
SLIDE_SECONDS = 20
MIN_ROWS_PER_IP = 5
FETCH_SECONDS = 5
FETCH_ROWS = 200

MANY_PORTS = 50
BURST_RATE = 5.0
HIGH_DROP_RATIO = 0.7
HIGH_RISK_RATIO = 0.5

CONTAMINATION = 0.07
TREES = 200
ROWS_PER_TREE = 256
SEED = 42

# Column names that must not reach the model, and name parts
# that mark a column as derived from an address.
FORBIDDEN_FEATURES = [
    "src_ip", "dst_ip", "src_ip_count", "dst_ip_count", "src_unique_dst",
    "src_block_ratio", "same_subnet", "src_ip_entropy", "dst_ip_entropy",
]
ADDRESS_NAME_PARTS = ["src_ip", "dst_ip", "ip_count", "ip_entropy", "subnet"]

# The model columns in model order.
MODEL_FEATURES = [
    "hour_sin", "hour_cos", "day_sin", "day_cos",
    "is_weekend", "is_business_hour", "is_night", "is_peak_hour",
    "src_port", "dst_port", "src_is_wellknown", "dst_is_wellknown",
    "src_is_registered", "dst_is_registered", "src_is_dynamic", "dst_is_dynamic",
    "dst_is_high_risk", "port_diff", "port_range_span",
    "is_sequential_port", "dst_is_web_service", "dst_is_db_service",
    "is_tcp", "is_udp", "is_icmp", "tcp_blocked", "udp_blocked", "icmp_blocked",
    "tcp_inbound", "tcp_outbound", "udp_inbound",
    "length", "ttl",
    "packet_size_tiny", "packet_size_small", "packet_size_medium", "packet_size_large",
    "packet_size_norm", "ttl_is_linux", "ttl_is_windows", "ttl_is_suspicious",
    "ttl_normalized", "data_ratio",
    "is_blocked", "is_passed", "is_inbound", "is_outbound",
    "inbound_blocked", "outbound_blocked", "reason_is_match",
    "tcp_flag_s", "tcp_flag_a", "tcp_flag_f", "tcp_flag_r", "tcp_flag_p", "tcp_flag_u",
    "tcp_syn_only", "tcp_fin_only", "tcp_null_scan", "tcp_xmas_scan",
    "window_is_zero", "window_is_max",
    "action_encoded", "proto_name_encoded", "dir_encoded",
]
ENCODED_COLUMNS = ["action", "proto_name", "dir", "reason"]
