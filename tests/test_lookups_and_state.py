"""Lookups, merged profiles and saved models beside plain references, with difficult rows."""

import datetime as dt
import ipaddress
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowwarden.catalog.tables import fw
from flowwarden.functions import parsing as G
from flowwarden.operators import lookups as K
from flowwarden.operators import parse as P
from flowwarden.operators import profile as Pr
from flowwarden.plans import joins, stages, versions
from flowwarden.plans import training as Tr
from flowwarden.plans.storage import new_path
from flowwarden.streaming import jobs as J
from flowwarden.streaming.counters import Totals

SF = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 1)


# --- networks ------------------------------------------------------------------------
@pytest.mark.parametrize("most", [joins.MAX_BROADCAST_ROWS, 2])
def test_longest_prefix(spark, monkeypatch, most):
    """Nested networks, equal ones and broken ones against the standard library; every row once."""
    monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", most)
    monkeypatch.setattr(joins.checked_left_join, "__defaults__", (None, most, 4))
    rng = random.Random(2)
    nets = {"0.0.0.0/0", "8.8.8.8/32", "9.0.0.0/8"}
    for _ in range(80):
        bits = rng.choice([9, 12, 17, 20, 24, 27, 31])
        nets.add(str(ipaddress.ip_network((rng.choice([8, 9, 203]) << 24 | rng.getrandbits(24), bits), strict=False)))
    nets -= {"0.0.0.0/0"} if most == 2 else set()
    rows = [(n, f"c{i}", "x", 1.0, 2.0) for i, n in enumerate(sorted(nets))]
    broken = [("9.1.2.3/40", "bad", "x", 0.0, 0.0), ("text", "bad", "x", 0.0, 0.0), (None, "bad", "x", 0.0, 0.0), ("9.0.0.0/8", "zz", "x", 1.0, 2.0)]
    table = spark.createDataFrame(rows + broken, "network string, country string, city string, lat double, lon double")
    addresses = [str(ipaddress.ip_address(rng.choice([8, 9, 203]) << 24 | rng.getrandbits(24))) for _ in range(200)] + ["8.8.8.8"] * 300
    odd = ["10.1.1.1", "0.0.0.0", "", None, "fe80::1", "9.1", "9.9.9.9"]
    df = spark.createDataFrame([(i, a, "clash") for i, a in enumerate(addresses + odd)], "i int, src_ip string, country string")
    got = {r.i: r.source and r.source.country for r in K.add_location_by_prefix(df, table).collect()}
    assert len(got) == len(addresses) + len(odd)
    known = sorted(((ipaddress.ip_network(n), c) for n, c, *_ in rows), key=lambda x: -x[0].prefixlen)

    def by_hand(a):
        try:
            ip = ipaddress.IPv4Address(a)
        except (ValueError, TypeError):
            return None
        return None if ip.is_private and not a.startswith("203") or a == "0.0.0.0" else next((c for n, c in known if ip in n), None)

    assert got == {i: by_hand(a) for i, a in enumerate(addresses + odd)}
    assert K.add_location_by_prefix(df, table.limit(0)).filter("source IS NOT NULL").count() == 0
    assert K.add_location_by_prefix(df.limit(0), table).count() == 0


# --- names as of a time --------------------------------------------------------------
def test_names_as_of_a_time(spark):
    """Found and failed names expire; the newest lookup counts; every row once."""
    rng = random.Random(4)
    at = lambda s: START + dt.timedelta(seconds=s)
    looked = [(f"9.0.0.{rng.randrange(4)}", rng.choice([None, "a.net", "b.net"]), at(rng.randrange(40_000))) for _ in range(120)]
    looked += [("9.0.0.9", None, at(100)), ("9.0.0.9", "tie.net", at(100)), ("9.0.0.9", "also.net", at(100)), (None, "x", at(1)), ("9.0.0.1", "x", None)]
    times = [rng.randrange(-1000, 50_000) for _ in range(400)]
    rows = [(i, f"9.0.0.{rng.randrange(5)}", at(t)) for i, t in enumerate(times)]
    rows += [(1000 + k, "9.0.0.9", at(s)) for k, s in enumerate((99, 100, 3699, 3700))] + [(2000, "10.0.0.1", at(1)), (2001, None, at(1)), (2002, "9.0.0.9", None)]
    df = spark.createDataFrame(rows, "i int, src_ip string, `@timestamp` timestamp")
    got = {r.i: r.src_hostname for r in K.add_hostname_asof(
        df, spark.createDataFrame(looked, "ip string, hostname string, looked_up_at timestamp"), bucket_seconds=1000).collect()}

    def by_hand(ip, t):
        if ip is None or ip.startswith("10."):
            return None
        past = [(w, n is not None, n) for i, n, w in looked if i == ip and w is not None and t is not None and w <= t]
        if not past:
            return ip
        last = max(w for w, *_ in past)
        name = min((n for w, _, n in past if w == last and n), default=None)
        return name if name and t < last + dt.timedelta(seconds=3600) else ip

    assert got == {i: by_hand(ip, t) for i, ip, t in rows}
    assert [got[1000 + k] for k in range(4)] == ["9.0.0.9", "also.net", "also.net", "9.0.0.9"]
    empty = spark.createDataFrame([], "ip string, hostname string, looked_up_at timestamp")
    assert K.add_hostname_asof(df, empty, internal=True).filter("src_hostname <=> src_ip").count() == len(rows)


# --- one parse, counted --------------------------------------------------------------
def test_parse_stream_reads_a_batch_once(spark):
    base = new_path(spark, "parse")
    head = "<134>1 2025-01-02T03:04:05Z fw1 filterlog 7 - - "
    line = head + "1,,,5,em1,match,block,in,4,0x0,,64,0,0,DF,6,tcp,40,192.0.2.1,198.51.100.2,4000,443,0,S,1,,100,,"
    lines = [line] * 5 + ["junk", None, "", line.replace(",4,", ",6,", 1)] * 3
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, message string")
    df.write.parquet(f"{base}/in")
    totals = Totals(spark, f"{base}/totals")
    for _ in range(2):  # the second run finds nothing new
        running = J.parse_stream(J.tail_table(spark, f"{base}/in", df.schema), f"{base}/ok", f"{base}/bad", f"{base}/state", totals)
        running.awaitTermination()
        if running.recentProgress and running.recentProgress[-1].numInputRows:
            assert sum(p.numInputRows for p in running.recentProgress) == len(lines)
    assert totals.read(running.id) == {"read": 17, "accepted": 5, "rejected": 9, "other_version": 3}
    ok = spark.read.parquet(f"{base}/ok")
    assert ok.count() == 5 and ok.filter("src_ip = '192.0.2.1' AND event_date = '2025-01-02'").count() == 5
    bad = spark.read.parquet(f"{base}/bad")
    assert sorted(r.i for r in bad.collect()) == [5, 6, 7, 9, 10, 11, 13, 14, 15] and bad.filter("tags[0] = '_parse_failure_header'").count() == 9


def test_classified_lines_have_the_fields_of_parsed_ones(spark):
    from flowwarden.catalog.lines import raw_lines
    rows = raw_lines(spark, SF)
    once = P.classify_lines(rows).filter("outcome = 'accepted'")
    twice = P.parse_lines(rows)
    assert sorted(map(str, once.select(*twice.columns).collect())) == sorted(map(str, twice.collect()))
    assert G.STRICT_GROUPS and set(P.OUTCOMES) == {r[0] for r in P.classify_lines(rows).select("outcome").distinct().collect()}


# --- profiles that merge -------------------------------------------------------------
def test_sketches_keep_their_bounds(spark):
    """Distinct values and ranks after a merge of 40 days, some of them without values."""
    n = 60_000
    df = spark.range(n).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("day"), F.col("id").alias("unique"),
        (F.col("id") % 97).cast("int").alias("few"), F.when(F.col("id") % 40 > 30, F.col("id") * 0.5).alias("late"),
        F.lit(None).cast("double").alias("never"), F.array(F.col("id") % 5).alias("list"), F.col("id").alias("a.b"))
    sketches = Pr.day_sketches(df, F.col("day"), ["unique", "few", "late", "never", "list", "a.b"])
    path = new_path(spark, "sketches")
    Pr.write_day_sketches(sketches, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 40 * 6
    got = {r.column_name: r for r in Pr.merge_sketches(stored, [0.1, 0.5, 0.9]).collect()}
    for name, want in (("unique", n), ("few", 97), ("late", n * 9 // 40), ("never", 0), ("list", 5), ("a.b", n)):
        assert abs(got[name].distinct_values - want) <= 0.05 * want
        assert got[name].n_rows == n and got[name].days == 40
    assert got["never"].nulls == n and got["never"].quantiles is None and got["list"].quantiles is None and got["late"].null_percent == 77.5
    for q, v in zip([0.1, 0.5, 0.9], got["unique"].quantiles):
        assert abs(v / n - q) < 0.02
    week = Pr.diff_merged(Pr.merge_sketches(stored.filter("day < '2024-01-08'")), Pr.merge_sketches(stored.filter("day >= '2024-01-08'")))
    rows = {r.column_name: (r.before_n_rows, r.after_n_rows) for r in week.collect()}
    assert rows["few"] == (n * 7 // 40, n * 33 // 40)
    assert Pr.merge_sketches(stored.limit(0)).count() == 0


# --- saved models --------------------------------------------------------------------
def small_model(spark, offset):
    nodes = spark.createDataFrame([(0, 0, -1, 0.0, 0, 1)], "tree int, node int, feature int, threshold double, depth int, size int")
    vocabulary = spark.createDataFrame([("action", f"v{offset}", 0)], "column_name string, value string, code int")
    scaler = spark.createDataFrame([("length", float(offset), 1.0)], "column_name string, mean double, std double")
    return Tr.Model(vocabulary, scaler, nodes, float(offset), 1, {"at": START})


def parts_of(model):
    return (model.offset, model.scaler.first()[1], model.vocabulary.first()[1])


def test_a_reader_never_sees_half_a_model(spark, monkeypatch):
    path = new_path(spark, "model")
    with pytest.raises(FileNotFoundError):
        Tr.Model.load(spark, path)
    small_model(spark, 1).save(path)
    early = Tr.Model.load(spark, path)

    def ends(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions, "commit", ends)
        with pytest.raises(KeyboardInterrupt):
            small_model(spark, 2).save(path)
    assert parts_of(Tr.Model.load(spark, path)) == (1.0, 1.0, "v1")
    small_model(spark, 3).save(path)
    assert parts_of(Tr.Model.load(spark, path)) == (3.0, 3.0, "v3")
    assert parts_of(early) == (1.0, 1.0, "v1")  # still readable: one version back
    small_model(spark, 4).save(path)
    assert parts_of(Tr.Model.load(spark, path)) == (4.0, 4.0, "v4") and len(versions.numbers(spark, path)) == 2


def test_stage_parameters_survive(spark):
    rows = fw(spark, SF, "@timestamp")
    stage = stages.BehaviorForest(key="event_id", keep=["src_ip"], trees=5, rowsPerTree=32)
    path = new_path(spark, "stage")
    stage.write().save(f"{path}/estimator")
    again = stages.BehaviorForest.load(f"{path}/estimator")
    assert again.getOrDefault("trees") == 5 and again.kept() == ["event_id", "src_ip"]
    model = again.fit(rows)
    model.write().save(f"{path}/model")
    loaded = stages.load_forest(spark, f"{path}/model")
    assert loaded.uid == model.uid and loaded.kept() == ["event_id", "src_ip"]
    assert loaded.transform(rows).columns == ["event_id", "src_ip", "anomaly_score", "prediction", "is_anomaly"]
    assert np.isclose(loaded.state.offset, model.state.offset) and loaded.state.nodes.count() == model.state.nodes.count()
