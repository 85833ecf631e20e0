"""Snapshots and changes of the block log: same state, few files, safe to end anywhere."""

import datetime as dt
import os
import random
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from flowwarden.operators import blocklist as L
from flowwarden.plans import versions
from flowwarden.plans.storage import new_path
from flowwarden.streaming.blocklog import BLOCK_LOG_SCHEMA, BlockLog

FIELDS = pa.schema([("ip", pa.string()), ("action", pa.string()), ("severity", pa.string()), ("reason", pa.string()),
                    ("score", pa.float64()), ("event_at", pa.timestamp("us", "UTC")), ("origin", pa.string()), ("batch", pa.int64())])
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def event(rng, origin=None, batch=None, addresses=40):
    return {"ip": f" 10.0.0.{rng.randrange(addresses)}", "action": rng.choice(["block", "block", "unblock"]), "severity": "HIGH",
            "reason": "r", "score": -0.1, "event_at": START + dt.timedelta(seconds=rng.randrange(200)), "origin": origin, "batch": batch}


def put(path, folder, rows):
    os.makedirs(f"{path}/{folder}", exist_ok=True)
    pq.write_table(pa.Table.from_pylist(rows, FIELDS), f"{path}/{folder}/part-0.parquet")


def folded(rows):
    """The blocks that all events together leave, without Spark."""
    newest = {}
    for r in rows:
        key = (r["event_at"], r["action"])
        if r["ip"].strip() not in newest or key > newest[r["ip"].strip()]:
            newest[r["ip"].strip()] = key
    return {ip for ip, (_, action) in newest.items() if action == "block"}


def blocked(log, **kw):
    return {r.ip for r in L.current_blocks(log.events(**kw)).collect()}


def test_a_thousand_batches(spark):
    """State and number of files after 1,000 batches of two streams and some events by hand."""
    path, rng = new_path(spark, "log"), random.Random(1)
    log, every = BlockLog(spark, path), 100
    origins = [str(uuid.UUID(int=k)) for k in (1, 2)]
    rows, most = [], 0
    for n in range(1000):
        origin = origins[n % 2]
        new = [event(rng, origin, n // 2) for _ in range(rng.randrange(4))]
        put(path, f"{origin}-{n // 2}", new)
        if n % 97 == 0:
            hand = [event(rng)]
            pq.write_table(pa.Table.from_pylist(hand, FIELDS), f"{path}/part-{n}.parquet")
            new += hand
        rows += new
        if n % 20 == 19:
            log.compact(every)
            most = max(most, len(log.history().inputFiles()))
    assert blocked(log) == folded(rows)
    assert most <= every + 25
    # What was merged two versions ago is gone, and two snapshots are kept.
    assert len(versions.children(spark, path)) <= 2 * (every + 25)
    assert len(versions.children(spark, f"{path}/_snapshots")) == 2
    assert len(versions.numbers(spark, path)) == 2


def test_last_batch_is_not_merged(spark):
    """The events of a batch that may be retried stay apart, and a retry does not see them."""
    path, rng = new_path(spark, "log"), random.Random(2)
    log, origin = BlockLog(spark, path), str(uuid.uuid4())
    rows = {n: [event(rng, origin, n) for _ in range(5)] for n in range(6)}
    for n, r in rows.items():
        put(path, f"{origin}-{n}", r)
    assert log.compact(1)
    assert blocked(log) == folded(sum(rows.values(), []))
    assert blocked(log, origin=origin, before=5) == folded(sum([rows[n] for n in range(5)], []))
    fresh = log.spark.createDataFrame([("10.9.9.9", "block", "HIGH", "again", -0.4, START)], "ip string, action string, severity string, reason string, score double, event_at timestamp")
    log.write_batch(fresh, origin, 5)
    assert blocked(log) == folded(sum([rows[n] for n in range(5)], [])) | {"10.9.9.9"}
    assert not log.compact(1)  # nothing closed is left


@pytest.mark.parametrize("step", ["commit", "remove", "forget_before"])
def test_ended_anywhere(spark, monkeypatch, step):
    """A compaction that ends before or after its commit changes no state, and the next one goes on."""
    path, rng = new_path(spark, "log"), random.Random(3)
    log, origin = BlockLog(spark, path), str(uuid.uuid4())
    rows = []
    for n in range(12):
        new = [event(rng, origin, n) for _ in range(4)]
        rows += new
        put(path, f"{origin}-{n}", new)
        if n == 5:
            assert log.compact(1)

    def ends(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions, step, ends)
        with pytest.raises(KeyboardInterrupt):
            log.compact(1)
    assert blocked(log) == folded(rows)
    for n in range(12, 15):
        new = [event(rng, origin, n) for _ in range(4)]
        rows += new
        put(path, f"{origin}-{n}", new)
        log.compact(1)
        assert blocked(log) == folded(rows)


def test_two_at_once(spark, monkeypatch):
    """Of two compactions with the same number one is committed; the other leaves nothing behind."""
    path, rng = new_path(spark, "log"), random.Random(4)
    log, origin = BlockLog(spark, path), str(uuid.uuid4())
    rows = []
    for n in range(4):
        rows.append(event(rng, origin, n))
        put(path, f"{origin}-{n}", rows[-1:])
    write = versions.commit

    def late(spark_, where, number, record):
        monkeypatch.setattr(versions, "commit", write)
        assert log.compact(1)  # the other one, in between
        return write(spark_, where, number, record)

    monkeypatch.setattr(versions, "commit", late)
    assert not log.compact(1)
    assert blocked(log) == folded(rows) and len(versions.children(spark, f"{path}/_snapshots")) == 1


def test_half_a_record_is_none(spark):
    path = new_path(spark, "v")
    assert versions.current(spark, path) is None and versions.children(spark, path) == []
    assert versions.commit(spark, path, 1, {"a": 1}) and not versions.commit(spark, path, 1, {"a": 2})
    versions.write_text(spark, versions.record_path(path, 2), '{"a": ')
    assert versions.current(spark, path) == (1, {"a": 1}) and versions.next_number(spark, path) == 3


def test_empty_log(spark):
    log = BlockLog(spark, new_path(spark, "log"))
    assert log.history().count() == 0 and log.history().schema == BLOCK_LOG_SCHEMA
    assert not log.compact(1) and L.block_count(log.events()).first()[0] == 0
    L.append_events(spark.createDataFrame([("1.1.1.1", "block", None, None, None, START)], "ip string, action string, severity string, reason string, score double, event_at timestamp"), log.path)
    assert log.compact(1) and log.events().filter(F.col("ip") == "1.1.1.1").count() == 1
