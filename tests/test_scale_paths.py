"""The ways taken for large or skewed data give the same rows as the simple ones."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowwarden.catalog import models
from flowwarden.catalog.tables import fw
from flowwarden.operators import behavior as B
from flowwarden.operators import enrich as N
from flowwarden.operators import features as X
from flowwarden.operators import forest as M
from flowwarden.plans import joins as J
from flowwarden.plans import ranking as R
from flowwarden.plans import training as Tr
from flowwarden.plans.detection import detect, score_windows
from flowwarden.plans.storage import new_path

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_salted_join_equals_broadcast(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    table = spark.createDataFrame([(i, f"n{i}") for i in range(40)], "key long, name string")
    small = J.checked_left_join(left, table, [("k", "key")])
    large = J.checked_left_join(left, table, [("k", "key")], max_rows=5, salts=4)
    assert rows_of(small) == rows_of(large) and large.count() == 3000


def test_large_table_is_neither_broadcast_nor_repeated(spark, monkeypatch):
    """A table past the bound is joined by sorting though its size is taken for small; only heavy keys have parts."""
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, F.col("id") % 50).alias("k"))
    table = spark.range(40).select(F.col("id").alias("key"), F.concat(F.lit("n"), "id").alias("name"))
    small = J.checked_left_join(left, table, [("k", "key")])
    monkeypatch.setattr(J, "HEAVY_ROWS", 500)
    large = J.checked_left_join(left, table, [("k", "key")], max_rows=5, salts=4)
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
    assert rows_of(small) == rows_of(large) and large.count() == 3000
    spread, repeated = J.spread_heavy(left, table, [("k", "key")], 4)
    assert repeated.count() == 40 + 3
    salts = {r.k: r.n for r in spread.groupBy("k").agg(F.count_distinct("_salt").alias("n")).collect()}
    assert salts.pop(0) == 4 and salts.pop(None) == 4 and set(salts.values()) == {1}


def test_many_names_of_destinations_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(J.checked_left_join, "__defaults__", (None, 5, 4))
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(["203.0.0.7", "224.0.0.5", None, "10.0.0.1", "203.0.9.9", "203.0.0.7"])], "i int, dst_ip string")
    names = spark.range(30).select(F.concat(F.lit("203.0.0."), "id").alias("ip"), F.concat(F.lit("h"), "id").alias("hostname"))
    named = N.add_hostname(rows, names, "dst_ip", "dst_hostname", destination=True)
    assert "strategy=merge" in named._jdf.queryExecution().optimizedPlan().toString()
    assert {r.i: r.dst_hostname for r in named.collect()} == {0: "h7", 1: None, 2: None, 3: None, 4: "203.0.9.9", 5: "h7"}


def test_running_sums(spark):
    rng = random.Random(1)
    data = [(float(v), rng.randint(0, 9)) for v in rng.sample(range(10_000), 2_000)]
    df = spark.createDataFrame(data, "v double, n long")
    got = {r.v: r.s for r in R.running_sums(df, "v", {"s": "n"}, rows_per_part=7).collect()}
    total, want = 0, {}
    for v, n in sorted(data):
        total += n
        want[v] = total
    assert got == want


@pytest.mark.parametrize("level", [0.0, 0.07, 0.25, 0.5, 1.0])
def test_exact_quantile_on_every_path(spark, monkeypatch, level):
    rng = np.random.default_rng(3)
    # A third of the rows hold one value.
    data = np.concatenate([rng.normal(size=2000), np.zeros(1000)])
    df = spark.createDataFrame([(float(x),) for x in data] + [(None,)], "x double")
    want = float(np.quantile(data, level))
    assert R.exact_quantile(df, "x", level) == pytest.approx(want)
    monkeypatch.setattr(R, "SMALL_DOMAIN", 2)
    assert R.exact_quantile(df, "x", level) == pytest.approx(want)
    assert R.quantiles(df, ["x"], [level])["x"][0] == pytest.approx(want)


def test_quantiles_of_many_columns_in_three_passes(spark, monkeypatch):
    """Few and many distinct values, nulls, one value, none at all: exact, and one pass of each kind for all of them."""
    rng = np.random.default_rng(5)
    n = 4000
    data = {"many": rng.normal(size=n), "few": rng.integers(0, 3, n).astype(float), "ports": rng.integers(0, 65536, n).astype(float),
            "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n) * 50), "same": np.full(n, 2.5)}
    rows = [tuple(float(data[c][i]) for c in data) + (None, None if i % 3 else float(i)) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in [*data, "none", "a.b"]))
    levels = [0.0, 0.05, 0.25, 0.5, 0.6, 0.75, 1.0]
    want = {c: [float(np.quantile(data[c], q)) for q in levels] for c in data}
    want |= {"none": [None] * len(levels), "a.b": [float(np.quantile(np.arange(0, n, 3), q)) for q in levels]}
    passes = []
    for name in ("_count_around", "_look_inside"):
        run = getattr(R, name)
        monkeypatch.setattr(R, name, lambda *a, run=run, name=name: passes.append(name) or run(*a))
    got = R.quantiles(df, [*want], levels)
    assert all(got[c] == (want[c] if c == "none" else pytest.approx(want[c])) for c in want)
    assert passes == ["_count_around", "_look_inside"]
    monkeypatch.setattr(R, "SMALL_DOMAIN", 1)
    monkeypatch.setattr(R, "SKETCH", 60)
    again = R.quantiles(df, [*want], levels)
    assert all(again[c] == (want[c] if c == "none" else pytest.approx(want[c])) for c in want) and len(passes) > 3
    monkeypatch.setattr(R, "MOST_ROUNDS", 0)
    last = R.quantiles(df, ["many", "hot"], [0.3, 0.5])
    assert last["many"] == pytest.approx([float(np.quantile(data["many"], q)) for q in (0.3, 0.5)])


def test_large_vocabulary_is_joined(spark, monkeypatch):
    df = fw(spark, SF)
    vocabulary = X.fit_vocabulary(df.filter("dst_port < 80"))
    names = ["event_id", "action_encoded", "proto_name_encoded", "dir_encoded", "reason_encoded"]
    literal = X.encode(df, vocabulary).select(*names)
    monkeypatch.setattr(X, "MAX_LITERAL_VOCABULARY", 1)
    assert rows_of(literal) == rows_of(X.encode(df, vocabulary).select(*names))


def test_large_vocabulary_is_ranked_in_parts(spark, monkeypatch):
    df = spark.range(3000).select(F.concat(F.lit("v"), F.col("id") % 700).alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    want = rows_of(X.fit_vocabulary(df, ["a", "b"]))
    monkeypatch.setattr(X, "MAX_SORTED_AT_ONCE", 5)
    assert rows_of(X.fit_vocabulary(df, ["a", "b"])) == want


def test_behaviour_of_a_hot_source(spark):
    """One source holds most rows; the result equals counting by hand."""
    rng = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = [("hot" if rng.random() < 0.7 else f"ip{rng.randint(0, 9)}", f"d{rng.randint(0, 30)}", rng.choice([22, 80, 9999, None]),
             base + dt.timedelta(seconds=rng.randint(0, 300)), rng.randint(40, 1500)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, dst_port int, ts timestamp, length int").withColumns({
        "proto_name": F.lit("tcp"), "action": F.lit("pass"), "src_port": F.lit(5), "ttl": F.lit(64), "data_length": F.lit(1)})
    got = {(r.window_start, r.src_ip): r for r in B.ip_behavior(df, "ts").collect()}
    groups = {}
    for r in rows:
        pane = base + dt.timedelta(seconds=(r[3] - base).seconds // 20 * 20)
        for back in range(3):
            groups.setdefault((pane - dt.timedelta(seconds=20 * back), r[0]), []).append(r)
    assert set(got) == set(groups)
    for key, members in groups.items():
        g = got[key]
        ports = [m[2] for m in members if m[2] is not None]
        sizes = [m[4] for m in members]
        assert g.total_connections == len(members)
        assert g.unique_dst_ips == len({m[1] for m in members}) and g.unique_dst_ports == len(set(ports))
        if len(ports) > 1:
            assert g.dst_port_diversity == pytest.approx(np.std(ports, ddof=1))
        if len(sizes) > 1:
            assert g.packet_length_std == pytest.approx(np.std(sizes, ddof=1))


def planted(spark, parts):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    x[:20] += 12
    data = [(i, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(data, "key long, a double, b double, c double").repartition(parts)


def test_forest_is_the_same_under_any_partitioning(spark):
    one = M.fit_nodes(planted(spark, 1), ["a", "b", "c"], "key", trees=12, rows_per_tree=64)
    many = M.fit_nodes(planted(spark, 8), ["a", "b", "c"], "key", trees=12, rows_per_tree=64)
    assert rows_of(one) == rows_of(many)
    assert one.select("tree").distinct().count() == 12
    assert one.filter("node = 0").agg(F.min("size"), F.max("size")).first() == (64, 64)
    assert one.agg(F.max("depth")).first()[0] <= 6


def test_small_input_gives_every_tree_all_rows(spark):
    few = planted(spark, 2).filter("key < 30")
    nodes = M.fit_nodes(few, ["a", "b", "c"], "key", trees=5, rows_per_tree=64)
    assert [r["size"] for r in nodes.filter("node = 0").collect()] == [30] * 5


def test_planted_outliers_rank_first(spark):
    df = planted(spark, 4)
    nodes = M.fit_nodes(df, ["a", "b", "c"], "key", trees=100, rows_per_tree=128)
    scored = M.score_samples(df, nodes, ["a", "b", "c"], 128)
    worst = {r.key for r in scored.orderBy("raw_score").limit(20).collect()}
    assert len(worst & set(range(20))) >= 18


def test_path_lengths_of_a_hand_built_tree(spark):
    nodes = spark.createDataFrame(
        [(0, 0, 0, 0.5, 0, 4), (0, 1, -1, 0.0, 1, 3), (0, 2, -1, 0.0, 1, 1)], M.NODE_SCHEMA)
    df = spark.createDataFrame([(0.0,), (1.0,), (None,)], "x double")
    got = [r.raw_score for r in M.score_samples(df, nodes, ["x"], 4).collect()]
    c = [float(M.average_path(n)) for n in (3, 4)]
    low, high = -2 ** (-(1 + c[0]) / c[1]), -2 ** (-1 / c[1])
    assert got == pytest.approx([low, high, low])


def test_train_save_load_and_detect(spark):
    rows = fw(spark, SF, "@timestamp")
    model, judged, record = Tr.train(rows, trees=20, rows_per_tree=64)
    share = judged.agg(F.avg(F.col("is_anomaly").cast("int"))).first()[0]
    assert abs(share - 0.07) < 0.01
    r = record.first()
    assert r.test_samples == 1000 and 0 <= r.auc_roc <= 1
    path = new_path(spark, "model")
    model.save(path)
    again = Tr.Model.load(spark, path)
    a = Tr.score(rows, model, ["event_id"])
    b = Tr.score(rows, again, ["event_id"])
    assert rows_of(a) == rows_of(b)
    scored = score_windows(rows, again, "@timestamp", 3 * 86_400, 86_400, order=["@timestamp", "event_id"])
    assert scored.filter("total_connections < 5").count() == 0
    found, blocks = detect(scored, severities=["LOW", "MEDIUM"])
    assert found.count() == scored.filter("is_anomaly").count() == blocks.count()


def test_table_read_in_many_parts_is_not_moved_before_the_forest(spark, tmp_path, monkeypatch):
    """Rows of a table in many files are stored as they are read; few files are spread, rows and keys are the same."""
    plans = []

    class Seen(Exception):
        pass

    def stop(df, name):
        plans.append(df)
        raise Seen

    monkeypatch.setattr(models, "materialize", stop)
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    for files, sub in ((2 * spark.sparkContext.defaultParallelism, "many"), (1, "one")):
        rows.repartition(files).write.parquet(f"{tmp_path}/{sub}/lineitem.parquet")
        spark.conf.set("spark.sql.files.openCostInBytes", "128MB")
        try:
            with pytest.raises(Seen):
                models.iforest_scores_volume(spark, f"{tmp_path}/{sub}")
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")
        moved = "RepartitionByExpression" in plans[-1]._jdf.queryExecution().optimizedPlan().toString()
        assert moved == (sub == "one")
    assert rows_of(plans[0]) == rows_of(plans[1])


@pytest.mark.parametrize("limit", [1, 2, 3, 5, 40])
def test_scores_of_forests_of_every_depth(spark, limit):
    """The path of each row through trees of no, one, two and more levels, followed node by node."""
    rng = random.Random(limit)
    data = [(i, rng.random(), float(rng.randint(0, 3)), rng.choice([None, 1.0, 2.5])) for i in range(300)]
    df = spark.createDataFrame(data, "k long, a double, b double, c double")
    nodes = M.fit_nodes(df, ["a", "b", "c"], "k", trees=6, rows_per_tree=limit).toPandas()
    table = {(r.tree, r.node): r for r in nodes.itertuples()}
    got = {r.k: r.raw_score for r in M.score_samples(df, spark.createDataFrame(nodes), ["a", "b", "c"], max(limit, 2)).collect()}
    trees = sorted(nodes["tree"].unique())
    for k, *x in data:
        ends = []
        for t in trees:
            node = 0
            while (r := table[t, node]).feature >= 0:
                node = 2 * node + 1 + ((x[r.feature] or 0.0) > r.threshold)
            ends.append(r.depth + M.average_path(r.size))
        assert abs(got[k] + 2 ** (-sum(ends) / len(trees) / M.average_path(max(limit, 2)))) < 1e-12


def test_windows_count_destinations_without_a_row_per_combination(spark):
    """Distinct counts with nulls and repeats; destinations and ports are not multiplied by windows before they are combined."""
    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    data = [(start + dt.timedelta(seconds=rng.randrange(300)), rng.choice(["a", "b"]), rng.choice([None, "x", "y", "z"]), rng.choice([None, 22, 80, 443]),
             "tcp", "pass", 1, 2, 3, 4) for _ in range(120)] + [(start, "c", None, None, "tcp", "pass", 1, 2, 3, 4)] * 2
    names = ["ts", "src_ip", "dst_ip", "dst_port", "proto_name", "action", "src_port", "length", "ttl", "data_length"]
    df = spark.createDataFrame(data, "ts timestamp, src_ip string, dst_ip string, dst_port int, proto_name string, action string, src_port int, length int, ttl int, data_length int")
    assert df.columns == names
    found = B.ip_behavior(df, "ts", 60, 20)
    want = {}
    for r in df.collect():
        pane = int(r.ts.timestamp()) // 20 * 20
        for back in range(3):
            dsts, ports = want.setdefault((pane - 20 * back, r.src_ip), (set(), set()))
            dsts.update([r.dst_ip] if r.dst_ip else [])
            ports.update([r.dst_port] if r.dst_port else [])
    assert {(int(r.window_start.timestamp()), r.src_ip): (r.unique_dst_ips, r.unique_dst_ports) for r in found.collect()} == {
        k: (len(d), len(p)) for k, (d, p) in want.items()}
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    whole = {r.src_ip: (r.unique_dst_ips, r.unique_dst_ports) for r in B.ip_behavior_global(df, 60, "ts").collect()}
    assert whole == {"a": (3, 3), "b": (3, 3), "c": (0, 0)}
