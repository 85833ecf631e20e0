"""Edges of the row rules on hand-written tables."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from flowwarden import schema as S
from flowwarden.functions import detect as Dt
from flowwarden.functions import enrich as E
from flowwarden.functions import values as V
from flowwarden.operators import behavior as B
from flowwarden.operators import blocklist as L
from flowwarden.operators import clean as C
from flowwarden.operators import detect as D
from flowwarden.operators import evaluate as Ev
from flowwarden.operators import features as X
from flowwarden.operators import forest as M
from flowwarden.operators import parse as P
from flowwarden.sources import readers, writers

TCP = ("<134>1 2024-03-05T18:30:00.250000+02:00 fw1.example.net filterlog 411 - - "
       "12,,,1770000123,em1,match,block,in,4,0x0,,64,9,0,DF,6,tcp,52,192.0.2.10,198.51.100.20,"
       "50001,8443,0,S,,77001,4096,,")
UDP = TCP.replace("6,tcp,52", "17,udp,52").replace("8443,0,S,,77001,4096,,", "53,12")
ICMP = TCP.replace("6,tcp,52", "1,icmp,52").replace("50001,8443,0,S,,77001,4096,,", "request,7,9")


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "message string")


def column(spark, kind, values, rule):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", rule(F.col("v")).alias("x")).orderBy("i").collect()]


def test_parse_tcp_line(spark):
    r = P.parse_lines(lines(spark, TCP)).first()
    assert (r.src_ip, r.src_port, r.dst_port, r.tcp_flags, r.tcp_window) == (
        "192.0.2.10", 50001, 8443, "S", 4096)
    assert r["@timestamp"] == dt.datetime(2024, 3, 5, 16, 30, 0, 250000)
    assert r.tracker == 1770000123 and r.ttl == 64 and r.tos == "0x0" and r.ecn is None
    parsed = P.parse_lines(lines(spark, TCP))
    declared = {f.name: f.dataType for f in S.filterlog_schema().fields}
    assert {f.name: f.dataType for f in parsed.schema.fields} == declared


def test_ports_and_flags_only_where_the_protocol_has_them(spark):
    udp, icmp = P.parse_lines(lines(spark, UDP, ICMP)).orderBy(F.desc("proto_name")).collect()
    assert (udp.src_port, udp.dst_port, udp.data_length, udp.tcp_flags) == (50001, 53, 12, None)
    assert (icmp.src_port, icmp.dst_port, icmp.data_length, icmp.tcp_window) == (None, None, None, None)


def test_version_6_dropped_and_damaged_lines_set_aside(spark):
    v6 = TCP.replace(",in,4,", ",in,6,")
    df = lines(spark, TCP, v6, "garbage", "")
    assert P.parse_lines(df).count() == 1
    assert {r.message for r in P.parse_errors(df).collect()} == {"garbage", ""}


def test_short_line_and_bad_numbers_give_nulls(spark):
    short = TCP.split(",198.51")[0]
    bad = TCP.replace(",50001,", ",x,")
    a, b = P.parse_lines(lines(spark, short, bad)).orderBy(F.col("dst_ip").asc_nulls_first()).collect()
    assert a.dst_ip is None and a.dst_port is None
    assert b.src_port is None and b.dst_port == 8443


def test_header_forms(spark):
    df = P.parse_header_relaxed(lines(
        spark, TCP, "<134>Dec  4 14:06:23 fw1 filterlog[123]: 77,,,8", "<30>2025-12-24T14:06:23Z fw1 dhcpd - - hello you",
        "nothing"))
    got = [(r.header_form, r.program, r.pid, r.payload) for r in df.collect()]
    assert got[0][:3] == ("rfc5424", "filterlog", "411") and got[0][3].startswith("12,,,1770000123")
    assert got[1] == ("bsd", "filterlog", "123", "77,,,8")
    assert got[2] == ("rfc5424", "dhcpd", None, "hello you")
    assert got[3] == (None, None, None, None)


def test_two_time_forms(spark):
    df = spark.createDataFrame([("Dec  4 14:06:23",), ("2025-12-04T14:06:23",), ("2025-12-04T14:06:23Z",), ("x",)],
                               "log_time string")
    got = [r.t for r in P.assign_time_fallback(df, 2025, out="t").collect()]
    local = dt.datetime(2025, 12, 4, 7, 6, 23)
    assert got == [local, local, dt.datetime(2025, 12, 4, 14, 6, 23), None]


def test_array_values(spark):
    assert column(spark, "array<string>", [[], ["a"], ["a", None], None, [None]], V.unwrap_array) == [
        None, "a", "a,None", None, None]
    assert column(spark, "string", ["[443]", "443", "[1,2]", "[]", None], V.unwrap_json_text) == [
        "443", "443", "1,2", None, None]


def test_private_edges(spark):
    ips = ["10.0.0.1", "172.15.0.1", "172.16.0.1", "172.31.9.9", "172.32.0.1", "192.168.1.1", "100.1.1.1", None]
    assert column(spark, "string", ips, E.is_private) == [True, False, True, True, False, True, False, False]
    assert column(spark, "string", ["0.0.0.0", "", None, "8.8.8.8"], E.source_scope) == [None, None, None, "external_source"]
    assert column(spark, "string", ["224.0.0.1", "fe80::1", "8.8.8.8"], E.destination_scope) == [None, None, "external_dest"]


def test_state_and_service_order(spark):
    assert column(spark, "string", ["S", "FPA", "RA", "SA", "A", None], E.tcp_state) == [
        "SYN", "FIN", "RST", "SYN-ACK", None, None]
    assert column(spark, "int", [3389, 1023, 1024, 49151, 49152, None], E.service_name) == [
        "RDP", "Other", "Registered Port", "Registered Port", "Dynamic/Private Port", None]
    assert column(spark, "string", ["1.2.3.4", "x", "1.2.3", None], E.ip_to_long) == [16909060, None, None, None]


def test_ids_equal_iff_keys_equal(spark):
    df = spark.createDataFrame([("a", "b", 1, 2, "tcp"), ("a", "b", 1, 2, "tcp"), ("a", "b", 2, 1, "tcp"),
                                ("a", None, 2, 1, "tcp")], "s string, d string, sp int, dp int, p string")
    ids = [r.x for r in df.select(E.session_id(*[F.col(c) for c in ("s", "d", "sp", "dp", "p")]).alias("x")).collect()]
    assert ids[0] == ids[1] != ids[2] and ids[3] is None


def test_severity_edges(spark):
    assert column(spark, "double", [-0.51, -0.5, -0.3, -0.1, 0.0, None], Dt.severity) == [
        "CRITICAL", "HIGH", "MEDIUM", "LOW", "LOW", None]


def test_clip_edges(spark):
    same = spark.createDataFrame([(5.0,)] * 9 + [(100.0,), (None,)], "x double")
    clipped = [r.x for r in C.clip_iqr(same, ["x"]).collect()]
    assert clipped.count(5.0) == 10 and clipped.count(None) == 1  # zero spread flattens the column
    wide = spark.createDataFrame([(float(i),) for i in range(20)] + [(1e6,)], "x double")
    once = C.apply_bounds(wide, C.fit_bounds(wide, ["x"]))
    bounds = C.fit_bounds(wide, ["x"])
    again = C.apply_bounds(once, bounds)
    assert sorted(r.x for r in once.collect()) == sorted(r.x for r in again.collect())


def test_clean_keeps_rows_and_upper_flags(spark):
    df = spark.createDataFrame(
        [("1", "BLOCK ", "TCP", None, "fpu", "2024-01-01T00:00:00Z"), ("2", None, "tcp", "in", "S", "2024-01-01T00:00:00Z"),
         ("3", "pass", "udp", "in", None, "not a time"), ("4", "pass", "udp", "in", None, "2024-01-01T00:00:00Z")],
        "id string, action string, proto_name string, dir string, tcp_flags string, `@timestamp` string")
    rows = {int(r.id): r for r in C.clean(df).collect()}
    assert set(rows) == {1, 4}
    assert (rows[1].action, rows[1].dir, rows[1].tcp_flags, rows[1].src_port) == ("block", "unknown", "FPU", 0.0)
    flags = X.add_transport(C.clean(df)).filter("id = 1").first()
    assert flags.tcp_xmas_scan == 1 and flags.tcp_flag_f == 1


def test_feature_null_rules(spark):
    df = spark.createDataFrame([(None, None, None, None, None, None, None, None, None, None)],
                               "`@timestamp` timestamp, src_port int, dst_port int, proto_name string, action string, "
                               "dir string, length int, ttl int, tcp_flags string, tcp_window int")
    vocabulary = X.fit_vocabulary(df)
    r = X.feature_table(df, vocabulary).first().asDict()
    assert list(r) == S.MODEL_FEATURES and len(r) == 65
    assert r["tcp_null_scan"] == 1 and r["window_is_zero"] == 1
    assert not any(v is None or math.isnan(v) for v in r.values())


def test_port_features(spark):
    df = spark.createDataFrame([(0, 1023), (1024, 49151), (49152, 200), (None, 80)], "src_port int, dst_port int")
    rows = X.add_ports(df).collect()
    assert [r.src_is_wellknown for r in rows] == [1, 0, 0, 0]
    assert [r.dst_is_registered for r in rows] == [0, 1, 0, 0]
    assert [r.is_sequential_port for r in rows] == [1, 0, 1, 0]
    assert rows[3].port_diff is None and rows[3].port_range_span == 0


def test_scaling(spark):
    df = spark.createDataFrame([(float(i), 7.0) for i in range(10)], "a double, b double")
    out = X.scale(df, X.fit_scaler(df, ["a", "b"]))
    s = out.agg(F.avg("a"), F.stddev_pop("a"), F.max("b")).first()
    assert abs(s[0]) < 1e-12 and abs(s[1] - 1) < 1e-12 and s[2] == 0.0


def test_reported_metrics(spark):
    cells = {(0, 0): 418754, (0, 1): 29, (1, 0): 46247, (1, 1): 34970}
    df = spark.createDataFrame([(y, p, n) for (y, p), n in cells.items()], "label int, predicted int, n int")
    rows = df.select("label", "predicted", F.explode(F.sequence(F.lit(1), "n"))).drop("col")
    m = Ev.binary_metrics(rows).first()
    assert (m.tn, m.fp, m.fn, m.tp) == (418754, 29, 46247, 34970)
    assert [round(x, 5) for x in (m.precision, m.recall, m.f1_score)] == [0.99917, 0.43057, 0.60181]
    assert round(m.accuracy, 6) == 0.907448


def test_auc_edges(spark):
    df = spark.createDataFrame([(-1.0, 1), (-1.0, 0), (0.5, 0), (0.7, 1)], "anomaly_score double, label int")
    assert Ev.auc_roc(df).first()[0] == pytest.approx((0.5 + 1 + 0 + 0) / 4)
    one = df.filter("label = 1")
    assert Ev.auc_roc(one).first()[0] == 0.0
    assert Ev.binary_metrics(one.withColumn("predicted", F.lit(0))).first().precision == 0.0


def test_labels(spark):
    signed = spark.createDataFrame([(-1,), (1,), (1,)], "label int")
    assert [r.label for r in Ev.normalize_labels(signed).collect()] == [1, 0, 0]
    binary = spark.createDataFrame([(0,), (1,)], "label int")
    assert [r.label for r in Ev.normalize_labels(binary).collect()] == [0, 1]


def test_constant_histogram(spark):
    df = spark.createDataFrame([(2.0,)] * 3, "anomaly_score double")
    rows = Ev.score_histogram(df, bins=10).orderBy("bin").collect()
    assert len(rows) == 10 and rows[0].lower == 1.5 and rows[5].n == 3


def test_block_list_is_idempotent(spark):
    at = dt.datetime(2024, 1, 1)
    want = spark.createDataFrame([("1.1.1.1 ", "HIGH", "r", -0.4, at), ("1.1.1.1", "HIGH", "r", -0.4, at), ("", "HIGH", "r", -0.4, at)],
                                 "ip string, severity string, reason string, score double, event_at timestamp")
    empty = spark.createDataFrame([], S.block_event_schema())
    first = L.block_events(empty, want)
    assert first.count() == 1
    assert L.block_events(first, want).count() == 0
    assert L.block_status(first, want).first().status == "already blocked"
    freed = first.unionByName(L.unblock_events(first, spark.createDataFrame(
        [("1.1.1.1", dt.datetime(2024, 1, 2))], "ip string, event_at timestamp")))
    assert L.current_blocks(freed).count() == 0 and L.block_count(freed).first()[0] == 0
    assert not L.table_exists(spark, "no_such_table")


def test_block_rules(spark):
    found = spark.createDataFrame([("10.0.0.1", True, -0.6, "CRITICAL"), ("9.9.9.9", True, -0.2, "MEDIUM"), ("9.9.9.8", True, 0.0, "LOW")],
                                  "ip string, is_anomaly boolean, anomaly_score double, severity string")
    assert D.block_decisions(found).count() == 2
    assert D.block_decisions(found, auto_block=False).count() == 0
    assert [r.ip for r in D.block_decisions(found, protect_private=True).collect()] == ["9.9.9.9"]
    r = D.block_decisions(found, min_severity="HIGH").first()
    assert r.reason == "Anomaly detected (Score: -0.600, Severity: CRITICAL)"


def test_window_edges(spark):
    base = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = [("a", "d1", 80, base + dt.timedelta(seconds=s)) for s in (0, 19, 20, 59, 60)]
    df = spark.createDataFrame(
        [(i, t, p, x, "tcp", "block", "in", "match", 40, 0, 64, "S", 1, 5000) for i, t, p, x in rows] + [
            (None, "d", 1, base, "tcp", "pass", "in", "match", 40, 0, 64, "S", 1, 1)],
        "src_ip string, dst_ip string, dst_port int, ts timestamp, proto_name string, action string, dir string, "
        "reason string, length int, data_length int, ttl int, tcp_flags string, tcp_window int, src_port int")
    got = {r.window_start: r for r in B.ip_behavior(df, "ts").collect()}
    assert got[base].total_connections == 4 and got[base + dt.timedelta(seconds=20)].total_connections == 3
    assert got[base].packet_length_std == 0.0 and got[base].connection_rate == pytest.approx(4 / 60)
    assert got[base + dt.timedelta(seconds=60)].packet_length_std is None
    assert sum(r.total_connections for r in got.values()) == 15
    counts = {r.window_start: r.n for r in B.window_counts(df, "ts").collect()}
    assert counts == {k: v.total_connections for k, v in got.items()}
    with pytest.raises(ValueError):
        B.ip_behavior(df, "ts", 50, 20)


def test_row_without_time_counts_as_now(spark):
    df = spark.createDataFrame([("a", None), (None, None)], "src_ip string, ts timestamp")
    rows = B.event_time(df, "ts").collect()
    assert len(rows) == 1 and rows[0].ts is not None


def test_cursor_keeps_rows_of_the_same_time(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, t) for i in range(5)], "event_id long, `@timestamp` timestamp")
    first = readers.fetch_after(df, "2023-01-01", -1, 3)
    cursor = readers.next_cursor(first)
    rest = readers.fetch_after(df, *cursor, 3)
    assert [r.event_id for r in rest.collect()] == [3, 4]


def test_readers_and_writers(spark, tmp_path):
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": "1"}\nnot json\n')
    with pytest.raises(Exception):
        readers.read_ndjson(spark, str(bad), "a string").collect()
    empty = tmp_path / "empty.jsonl"
    empty.write_text("\n")
    with pytest.raises(ValueError):
        readers.read_ndjson(spark, str(empty), "a string")
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    writers.write_clean(df, str(tmp_path / "t.csv"))
    assert spark.read.csv(str(tmp_path / "t.csv"), header=True).first().b == "x"
    writers.write_clean(df, str(tmp_path / "t.parquet"))
    assert spark.read.parquet(str(tmp_path / "t.parquet")).count() == 1
    with pytest.raises(ValueError):
        writers.write_clean(df, str(tmp_path / "t.pkl"))
    writers.append_ndjson(df, str(tmp_path / "n"))
    writers.append_ndjson(df, str(tmp_path / "n"))
    assert spark.read.json(str(tmp_path / "n")).count() == 2


def test_address_columns_do_not_reach_the_model(spark):
    with pytest.raises(ValueError):
        M.check_no_address_columns(["length", "src_ip_count"])
    assert X.allowed_features(["length", "src_ip"]) == ["length"]
