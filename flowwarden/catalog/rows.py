"""Queries: cleaning, features, profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowwarden import schema as S
from flowwarden.catalog.registry import flag, i8, query, r6, stamp
from flowwarden.catalog.tables import fw, load, with_fw
from flowwarden.operators import clean as C
from flowwarden.operators import features as X
from flowwarden.operators import profile as P
from flowwarden.plans import ranking as R

# ---- dirty rows: missing numbers, padded and upper-case text, copies ----
DIRTY_COLUMNS = """event_id, ts,
  CASE WHEN event_id % 29 = 3 THEN concat(' ', src_ip, ' ') ELSE src_ip END AS src_ip, dst_ip,
  CASE WHEN event_id % 37 = 5 THEN NULL WHEN event_id % 41 = 7 THEN 'n/a' ELSE CAST(src_port AS VARCHAR(10)) END AS src_port,
  CASE WHEN event_id % 43 = 5 THEN NULL ELSE CAST(dst_port AS VARCHAR(10)) END AS dst_port,
  CASE WHEN event_id % 53 = 1 THEN NULL ELSE proto_name END AS proto_name,
  CASE WHEN event_id % 59 = 2 THEN NULL WHEN event_id % 7 = 0 THEN concat(upper(action), ' ') ELSE action END AS action,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE dir END AS dir, reason,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(length AS VARCHAR(10)) END AS length,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(ttl AS VARCHAR(10)) END AS ttl,
  CASE WHEN event_id % 17 = 1 THEN 'bad' ELSE CAST(data_length AS VARCHAR(10)) END AS data_length,
  lower(tcp_flags) AS tcp_flags"""
DIRTY_SQL = f"""dirty AS (SELECT {DIRTY_COLUMNS} FROM fw
  UNION ALL SELECT {DIRTY_COLUMNS} FROM fw WHERE event_id % 97 = 0)"""
TYPED_SQL = """typed AS (SELECT event_id, ts, src_ip, dst_ip,
  TRY_CAST(trim(src_port) AS DOUBLE) AS src_port, TRY_CAST(trim(dst_port) AS DOUBLE) AS dst_port,
  lower(proto_name) AS proto_name, lower(action) AS action, lower(dir) AS dir, reason,
  TRY_CAST(trim(length) AS DOUBLE) AS length, TRY_CAST(trim(ttl) AS DOUBLE) AS ttl,
  TRY_CAST(trim(data_length) AS DOUBLE) AS data_length, upper(tcp_flags) AS tcp_flags
  FROM (SELECT DISTINCT * FROM dirty) q)"""
FILLED_SQL = """filled AS (SELECT * REPLACE (coalesce(src_port, 0) AS src_port, coalesce(dst_port, 0) AS dst_port,
  coalesce(dir, 'unknown') AS dir) FROM typed
  WHERE action IS NOT NULL AND proto_name IS NOT NULL AND ts IS NOT NULL)"""
IMPUTED_SQL = """imputed AS (SELECT * REPLACE (
  coalesce(length, (SELECT quantile_cont(length, 0.5) FROM filled)) AS length,
  coalesce(ttl, (SELECT quantile_cont(ttl, 0.5) FROM filled)) AS ttl,
  coalesce(data_length, (SELECT quantile_cont(data_length, 0.5) FROM filled)) AS data_length) FROM filled)"""


def _bounds(c: str) -> str:
    return f"""(SELECT quantile_cont({c}, 0.25) - 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM imputed) AS lo_{c},
  (SELECT quantile_cont({c}, 0.75) + 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM imputed) AS hi_{c}"""


BOUNDS_SQL = "bounds AS (SELECT " + ",\n".join(_bounds(c) for c in S.CLIPPED_COLUMNS) + ")"
CLIPPED_SQL = "clipped AS (SELECT imputed.* REPLACE (" + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, lo_{c}), hi_{c}) END AS {c}"
    for c in S.CLIPPED_COLUMNS) + ") FROM imputed CROSS JOIN bounds)"
CLEANED_SQL = """cleaned AS (SELECT * REPLACE (lower(trim(action)) AS action, lower(trim(proto_name)) AS proto_name,
  lower(trim(dir)) AS dir, lower(trim(reason)) AS reason, trim(src_ip) AS src_ip, trim(dst_ip) AS dst_ip)
  FROM clipped)"""
STEPS = [DIRTY_SQL, TYPED_SQL, FILLED_SQL, IMPUTED_SQL, BOUNDS_SQL, CLIPPED_SQL, CLEANED_SQL]
DIRTY_OUT = "event_id, {ts} AS ts, src_ip, dst_ip, src_port, dst_port, proto_name, action, dir, reason, length, ttl, data_length, tcp_flags".format(ts=stamp("ts"))
TYPED_OUT = f"""event_id, {stamp('ts')} AS ts, src_ip, dst_ip, {r6('src_port')} AS src_port, {r6('dst_port')} AS dst_port,
  proto_name, action, dir, reason, {r6('length')} AS length, {r6('ttl')} AS ttl, {r6('data_length')} AS data_length, tcp_flags"""


def with_dirty(steps: int, body: str) -> str:
    return with_fw(", " + ",\n".join(STEPS[:steps]) + " " + body)


def dirty(spark, sf, ts="ts"):
    rows = fw(spark, sf).selectExpr(*_split(DIRTY_COLUMNS))
    copies = rows.filter("event_id % 97 = 0")
    return rows.unionAll(copies).withColumnRenamed("ts", ts)


def _split(text: str) -> list[str]:
    """Top-level commas of a select list."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


def typed(spark, sf):
    return C.coerce_types(C.dedup_rows(dirty(spark, sf)), "ts")


def filled(spark, sf):
    return C.fill_defaults(C.drop_incomplete(typed(spark, sf), ["action", "proto_name", "ts"]))


@query("validate_schema", with_fw(f"""SELECT event_id, {i8('src_port')} AS src_port, proto_name, action, dir,
  CAST(NULL AS VARCHAR) AS "@timestamp", CAST(NULL AS DOUBLE) AS dst_port, CAST(NULL AS DOUBLE) AS length,
  CAST(NULL AS DOUBLE) AS ttl, CAST(NULL AS VARCHAR) AS src_ip, CAST(NULL AS VARCHAR) AS dst_ip FROM fw"""))
def validate_schema(spark, sf):
    return C.validate_schema(fw(spark, sf).select("event_id", "src_port", "proto_name", "action", "dir"))


@query("normalize_arrays", with_fw("""SELECT event_id,
  CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN concat(src_port, ',', src_port + 1)
    ELSE CAST(src_port AS VARCHAR) END AS src_port,
  CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN concat(action, ',', dir) ELSE action END AS action,
  dst_ip FROM fw"""))
def normalize_arrays(spark, sf):
    def lists(a, b):
        return (F.when(F.col("event_id") % 10 == 0, F.array().cast("array<string>"))
                .when(F.col("event_id") % 10 == 1, F.array(a.cast("string"), b.cast("string")))
                .otherwise(F.array(a.cast("string"))))
    rows = fw(spark, sf).select(
        "event_id", lists(F.col("src_port"), F.col("src_port") + 1).alias("src_port"),
        lists(F.col("action"), F.col("dir")).alias("action"), "dst_ip")
    return C.normalize_arrays(rows)


@query("dedup_rows", with_dirty(1, f"SELECT DISTINCT {DIRTY_OUT} FROM dirty"))
def dedup_rows(spark, sf):
    return C.dedup_rows(dirty(spark, sf))


@query("dedup_lineitem", f"""SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, {i8('l_linenumber')} AS l_linenumber,
  {r6('l_quantity')} AS l_quantity, {stamp('l_shipdate')} AS l_shipdate FROM lineitem""")
def dedup_lineitem(spark, sf):
    return C.dedup_rows(load(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"))


@query("coerce_types", with_dirty(2, f"SELECT {TYPED_OUT} FROM typed"))
def coerce_types(spark, sf):
    return typed(spark, sf)


@query("drop_incomplete", with_dirty(2, f"""SELECT {TYPED_OUT} FROM typed
WHERE action IS NOT NULL AND proto_name IS NOT NULL AND ts IS NOT NULL"""))
def drop_incomplete(spark, sf):
    return C.drop_incomplete(typed(spark, sf), ["action", "proto_name", "ts"])


@query("fill_defaults", with_dirty(3, f"SELECT {TYPED_OUT} FROM filled"))
def fill_defaults(spark, sf):
    return filled(spark, sf)


@query("impute_median", with_dirty(4, f"SELECT {TYPED_OUT} FROM imputed"))
def impute_median(spark, sf):
    return C.impute_median(filled(spark, sf))


@query("clip_iqr", with_dirty(6, f"SELECT {TYPED_OUT} FROM clipped"))
def clip_iqr(spark, sf):
    return C.clip_iqr(C.impute_median(filled(spark, sf)))


@query("outlier_counts", with_dirty(5, " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {i8(f'count(*) FILTER ({c} < lo_{c} OR {c} > hi_{c})')} AS outliers "
    "FROM imputed CROSS JOIN bounds" for c in S.CLIPPED_COLUMNS)))
def outlier_counts(spark, sf):
    return C.outlier_counts(C.impute_median(filled(spark, sf)))


@query("normalize_text", with_dirty(7, f"SELECT {TYPED_OUT} FROM cleaned"))
def normalize_text(spark, sf):
    return C.clean(dirty(spark, sf, "@timestamp")).withColumnRenamed("@timestamp", "ts")


@query("clean_stats", with_dirty(7, """SELECT CAST((SELECT count(*) FROM dirty) AS BIGINT) AS total_records,
  CAST((SELECT count(*) FROM dirty) - (SELECT count(*) FROM cleaned) AS BIGINT) AS records_removed,
  CAST((SELECT count(*) FROM cleaned) AS BIGINT) AS final_records"""))
def clean_stats(spark, sf):
    rows = dirty(spark, sf, "@timestamp")
    return C.clean_stats(rows, C.clean(rows))


NULLABLE = ["event_id", "src_ip", "src_port", "dst_port", "proto_name", "action", "dir", "length", "ttl",
            "data_length", "tcp_flags"]


@query("null_counts", with_dirty(2, " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {i8(f'count(*) FILTER ({c} IS NULL)')} AS nulls FROM typed" for c in NULLABLE)))
def null_counts(spark, sf):
    return C.null_counts(typed(spark, sf).select(*NULLABLE))


@query("null_counts_present", "SELECT * FROM (" + with_dirty(2, " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {i8(f'count(*) FILTER ({c} IS NULL)')} AS nulls FROM typed"
    for c in NULLABLE)) + ") q WHERE nulls > 0")
def null_counts_present(spark, sf):
    return C.null_counts(typed(spark, sf).select(*NULLABLE), only_present=True)


@query("action_distribution", with_fw(f"""SELECT action AS value, {i8('count(*)')} AS n,
  {r6('count(*) * 100.0 / (SELECT count(*) FROM fw)')} AS percent FROM fw GROUP BY action"""))
def action_distribution(spark, sf):
    return C.value_distribution(fw(spark, sf), "action")


@query("top_protocols", with_fw(f"""SELECT proto_name AS value, {i8('count(*)')} AS n,
  {r6('count(*) * 100.0 / (SELECT count(*) FROM fw)')} AS percent FROM fw GROUP BY proto_name
  ORDER BY n DESC, value LIMIT 5"""))
def top_protocols(spark, sf):
    return C.value_distribution(fw(spark, sf), "proto_name", top=5)


@query("sample_rows", with_fw(f"""SELECT {stamp('ts')} AS ts, action, src_ip, dst_ip, {i8('src_port')} AS src_port,
  {i8('dst_port')} AS dst_port, proto_name, {i8('length')} AS length FROM fw ORDER BY ts, event_id LIMIT 5"""))
def sample_rows(spark, sf):
    return C.sample_rows(fw(spark, sf), ["ts", "event_id"], [
        "ts", "action", "src_ip", "dst_ip", "src_port", "dst_port", "proto_name", "length"])


# ---- features ----
PEAK = ", ".join(map(str, S.PEAK_HOURS))
RISK = ", ".join(map(str, S.HIGH_RISK_PORTS))
WEB = ", ".join(map(str, S.WEB_PORTS))
DB = ", ".join(map(str, S.DATABASE_PORTS))
TEMPORAL_SQL = {
    "hour": i8("hour(ts)"), "day_of_week": i8("isodow(ts) - 1"),
    "hour_sin": r6("sin(2 * pi() * hour(ts) / 24)"), "hour_cos": r6("cos(2 * pi() * hour(ts) / 24)"),
    "day_sin": r6("sin(2 * pi() * (isodow(ts) - 1) / 7)"), "day_cos": r6("cos(2 * pi() * (isodow(ts) - 1) / 7)"),
    "is_weekend": flag("isodow(ts) >= 6"), "is_business_hour": flag("hour(ts) BETWEEN 8 AND 17"),
    "is_night": flag("hour(ts) >= 22 OR hour(ts) <= 6"), "is_peak_hour": flag(f"hour(ts) IN ({PEAK})"),
}
PORT_SQL = {
    "src_is_wellknown": flag("src_port <= 1023"), "dst_is_wellknown": flag("dst_port <= 1023"),
    "src_is_registered": flag("src_port BETWEEN 1024 AND 49151"),
    "dst_is_registered": flag("dst_port BETWEEN 1024 AND 49151"),
    "src_is_dynamic": flag("src_port > 49151"), "dst_is_dynamic": flag("dst_port > 49151"),
    "dst_is_high_risk": flag(f"dst_port IN ({RISK})"), "port_diff": i8("abs(dst_port - src_port)"),
    "port_range_span": i8("greatest(src_port, dst_port) - least(src_port, dst_port)"),
    "is_sequential_port": flag("src_port % 100 = 0 OR dst_port % 100 = 0"),
    "dst_is_web_service": flag(f"dst_port IN ({WEB})"), "dst_is_db_service": flag(f"dst_port IN ({DB})"),
}
PROTOCOL_SQL = {
    **{f"is_{p}": flag(f"proto_name = '{p}'") for p in ("tcp", "udp", "icmp")},
    **{f"{p}_blocked": flag(f"proto_name = '{p}' AND action = 'block'") for p in ("tcp", "udp", "icmp")},
    "tcp_inbound": flag("proto_name = 'tcp' AND dir = 'in'"),
    "tcp_outbound": flag("proto_name = 'tcp' AND dir = 'out'"),
    "udp_inbound": flag("proto_name = 'udp' AND dir = 'in'"),
}
PACKET_SQL = {
    "packet_size_tiny": flag("length <= 64"), "packet_size_small": flag("length BETWEEN 65 AND 512"),
    "packet_size_medium": flag("length BETWEEN 513 AND 1024"), "packet_size_large": flag("length > 1024"),
    "packet_size_norm": r6("length / 1500.0"), "ttl_is_linux": flag("ttl = 64"),
    "ttl_is_windows": flag("ttl IN (127, 128)"), "ttl_is_suspicious": flag("ttl < 30 OR ttl > 200"),
    "ttl_normalized": r6("ttl / 255.0"), "data_ratio": r6("data_length / (length + 1.0)"),
}
CONNECTION_SQL = {
    "is_blocked": flag("action = 'block'"), "is_passed": flag("action = 'pass'"),
    "is_inbound": flag("dir = 'in'"), "is_outbound": flag("dir = 'out'"),
    "inbound_blocked": flag("dir = 'in' AND action = 'block'"),
    "outbound_blocked": flag("dir = 'out' AND action = 'block'"), "reason_is_match": flag("reason = 'match'"),
}
TRANSPORT_SQL = {
    **{f"tcp_flag_{c.lower()}": flag(f"contains(tcp_flags, '{c}')") for c in "SAFRPU"},
    "tcp_syn_only": flag("tcp_flags = 'S'"), "tcp_fin_only": flag("tcp_flags = 'F'"),
    "tcp_null_scan": flag("coalesce(tcp_flags, '') IN ('', 'nan', 'None')"),
    "tcp_xmas_scan": flag("contains(tcp_flags, 'F') AND contains(tcp_flags, 'P') AND contains(tcp_flags, 'U')"),
    "window_is_zero": flag("coalesce(tcp_window, 0) = 0"), "window_is_max": flag("tcp_window >= 65535"),
}
ALL_SQL = {**TEMPORAL_SQL, **PORT_SQL, **PROTOCOL_SQL, **PACKET_SQL, **CONNECTION_SQL, **TRANSPORT_SQL}


def columns_sql(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in exprs.items())


def _group(name: str, exprs: dict[str, str], add, extra: str = "", keep=()):
    @query(name, with_fw(f"SELECT event_id, {extra}{columns_sql(exprs)} FROM fw"))
    def run(spark, sf):
        return add(fw(spark, sf)).select("event_id", *keep, *exprs)
    return run


_group("features_temporal", TEMPORAL_SQL, lambda df: X.add_temporal(df, "ts"))
_group("features_port", PORT_SQL, X.add_ports, f"{i8('src_port')} AS src_port, {i8('dst_port')} AS dst_port, ",
       ("src_port", "dst_port"))
_group("features_protocol", PROTOCOL_SQL, X.add_protocol)
_group("features_packet", PACKET_SQL, X.add_packet, f"{i8('length')} AS length, {i8('ttl')} AS ttl, ", ("length", "ttl"))
_group("features_connection", CONNECTION_SQL, X.add_connection)
_group("features_transport", TRANSPORT_SQL, X.add_transport)
_group("features_all", ALL_SQL, lambda df: X.add_all(df, "ts"))


def _code(c: str, source: str = "fw") -> str:
    return (f"coalesce((SELECT code FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM "
            f"(SELECT DISTINCT {c} AS v FROM {source}) d) e WHERE e.v = {c}), -1)")


CODES_SQL = {f"{c}_encoded": i8(_code(c)) for c in S.ENCODED_COLUMNS}


@query("label_encode", with_fw(f"SELECT event_id, {columns_sql(CODES_SQL)} FROM fw"))
def label_encode(spark, sf):
    rows = fw(spark, sf)
    return X.encode(rows, X.fit_vocabulary(rows)).select("event_id", *CODES_SQL)


@query("label_encode_unseen", with_fw(f"""SELECT event_id, {columns_sql(
    {f'{c}_encoded': i8(_code(c, "(SELECT * FROM fw WHERE dst_port < 80 AND proto_name <> 'icmp')"))
     for c in S.ENCODED_COLUMNS})} FROM fw"""))
def label_encode_unseen(spark, sf):
    rows = fw(spark, sf)
    known = X.fit_vocabulary(rows.filter("dst_port < 80 AND proto_name <> 'icmp'"))
    return X.encode(rows, known).select("event_id", *CODES_SQL)


@query("vocabulary_large", f"""SELECT column_name, value, {i8('row_number() OVER (PARTITION BY column_name ORDER BY value) - 1')} AS code
FROM (SELECT DISTINCT 'l_shipdate' AS column_name, {stamp('l_shipdate')} AS value FROM lineitem
  UNION SELECT DISTINCT 'l_returnflag', l_returnflag FROM lineitem) q""")
def vocabulary_large(spark, sf):
    rows = load(spark, sf, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("l_shipdate"), "l_returnflag")
    return X.fit_vocabulary(rows, ["l_shipdate", "l_returnflag"])


def _model_sql() -> dict[str, str]:
    raw = {**ALL_SQL, **CODES_SQL, "src_port": "src_port", "dst_port": "dst_port", "length": "length", "ttl": "ttl"}
    return {c: f"coalesce({r6(raw[c])}, 0.0)" for c in S.MODEL_FEATURES}


@query("feature_matrix", with_fw(f"SELECT event_id, {columns_sql(_model_sql())} FROM fw"))
def feature_matrix(spark, sf):
    rows = fw(spark, sf)
    return X.feature_table(rows, X.fit_vocabulary(rows), ["event_id"], "ts")


SCALED = ["src_port", "dst_port", "length", "ttl", "data_length"]


@query("standardize", with_fw("SELECT event_id, " + ", ".join(
    f"round((CAST({c} AS DOUBLE) - (SELECT avg({c}) FROM fw)) / coalesce(nullif((SELECT stddev_pop({c}) FROM fw), 0), 1), 6) AS {c}"
    for c in SCALED) + " FROM fw"))
def standardize(spark, sf):
    rows = fw(spark, sf).select("event_id", *SCALED)
    return X.scale(rows, X.fit_scaler(rows, SCALED))


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("standardize_lineitem", "SELECT l_orderkey, " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem), 6) AS {c}"
    for c in LINE_NUMBERS) + " FROM lineitem")
def standardize_lineitem(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_orderkey", *LINE_NUMBERS)
    return X.scale(rows, X.fit_scaler(rows, LINE_NUMBERS))


@query("clip_iqr_lineitem", "WITH b AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS z_{c}" for c in LINE_NUMBERS
) + " FROM lineitem) SELECT l_orderkey, " + ", ".join(
    f"round(least(greatest({c}, a_{c} - 0.25 * (z_{c} - a_{c})), z_{c} + 0.25 * (z_{c} - a_{c})), 6) AS {c}"
    for c in LINE_NUMBERS) + " FROM lineitem CROSS JOIN b")
def clip_iqr_lineitem(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_orderkey", *LINE_NUMBERS)
    return C.clip_iqr(rows, LINE_NUMBERS, 0.25)


# ---- profiling ----
PROFILED = ["event_id", "src_ip", "dst_port", "proto_name", "action", "dir", "reason", "length", "tcp_flags", "tcp_window"]
KINDS = {"event_id": "bigint", "src_ip": "string", "dst_port": "int", "proto_name": "string", "action": "string",
         "dir": "string", "reason": "string", "length": "int", "tcp_flags": "string", "tcp_window": "int"}


def _profile_sql(source: str) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS column_name, '{KINDS[c]}' AS type, {i8('count(*)')} AS n_rows,
  {i8(f'count(*) - count({c})')} AS nulls, {r6(f'(count(*) - count({c})) * 100.0 / count(*)')} AS null_percent,
  {i8(f'count(DISTINCT {c})')} AS distinct_values,
  (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {source}
    WHERE {c} IS NOT NULL ORDER BY v LIMIT 2) q) AS sample_values FROM {source}""" for c in PROFILED)


@query("profile_columns", with_fw(_profile_sql("fw")))
def profile_columns(spark, sf):
    return P.profile_columns(fw(spark, sf).select(*PROFILED))


@query("profile_warnings", f"""SELECT * FROM (
  SELECT 'text' AS column_name, 'long text' AS warning, {i8('max(length(text))')} AS largest FROM documents
  UNION ALL SELECT 'lang', 'long text', {i8('max(length(lang))')} FROM documents
  UNION ALL SELECT 'source', 'long text', {i8('max(length(source))')} FROM documents) q WHERE largest > 100
UNION ALL SELECT 'words', 'holds arrays', {i8("max(len(string_split(text, ' ')))")} FROM documents""")
def profile_warnings(spark, sf):
    docs = load(spark, sf, "documents")
    return P.profile_warnings(docs.select("text", "lang", "source", F.split("text", " ").alias("words")))


def _shape_sql(c: str, kind: str) -> str:
    if kind == "text":
        rule = f"CASE WHEN {c} IS NULL THEN 'null' WHEN length({c}) > 100 THEN 'very long text' WHEN length({c}) > 50 THEN 'long text' ELSE 'text' END"
    else:
        rule = f"CASE WHEN {c} IS NULL THEN 'null' WHEN {c} > 65535 THEN 'large number' ELSE 'number' END"
    return f"SELECT '{c}' AS field, {rule} AS shape FROM documents"


@query("field_shapes", "SELECT field, shape, CAST(count(*) AS BIGINT) AS n FROM (" + " UNION ALL ".join([
    _shape_sql("doc_id", "n"), _shape_sql("text", "text"), _shape_sql("lang", "text"), _shape_sql("n_chars", "n"),
    """SELECT 'lines' AS field, CASE WHEN len(x) = 0 THEN 'empty array' WHEN len(x) = 1 THEN 'single-item array'
  WHEN len(x) <= 3 THEN 'short array' ELSE 'long array' END AS shape
  FROM (SELECT string_split(text, chr(10)) AS x FROM documents) q"""]) + ") s GROUP BY field, shape")
def field_shapes(spark, sf):
    docs = load(spark, sf, "documents")
    return P.field_shapes(docs.select("doc_id", "text", "lang", "n_chars", F.split("text", "\n").alias("lines")))


@query("profile_diff", with_fw(f""", cut AS (SELECT * FROM fw WHERE proto_name = 'tcp'),
 a AS ({_profile_sql('fw')}), b AS ({_profile_sql('cut')})
SELECT coalesce(a.column_name, b.column_name) AS column_name, a.type AS before_type, a.n_rows AS before_n_rows,
  a.nulls AS before_nulls, a.distinct_values AS before_distinct_values, b.type AS after_type,
  b.n_rows AS after_n_rows, b.nulls AS after_nulls, b.distinct_values AS after_distinct_values
FROM a FULL OUTER JOIN b ON a.column_name = b.column_name"""))
def profile_diff(spark, sf):
    rows = fw(spark, sf).select(*PROFILED)
    return P.profile_diff(rows, rows.filter("proto_name = 'tcp'"))


# ---- exact quantiles at any number of distinct values ----
@query("quantile_lineitem", f"SELECT {r6('quantile_cont(l_extendedprice, 0.07)')} AS cut FROM lineitem")
def quantile_lineitem(spark, sf):
    cut = R.exact_quantile(load(spark, sf, "lineitem"), "l_extendedprice", 0.07)
    return load(spark, sf, "lineitem").agg(F.lit(cut).alias("cut"))
