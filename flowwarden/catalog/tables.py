"""The driver's tables seen as firewall logs, in SQL both engines accept.

``{events}`` and ``{lineitem}`` stand for the source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowwarden.plans.session import tune

FW_SQL = """
WITH e AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
  FROM {events}),
f AS (
  SELECT *, CASE WHEN k % 10 < 7 THEN 'tcp' WHEN k % 10 < 9 THEN 'udp' ELSE 'icmp' END AS proto_name,
         40 + CAST(FLOOR(value * 10) AS INT) % 1461 AS length
  FROM e)
SELECT event_id, ts,
  CASE WHEN user_id % 3 = 0
       THEN concat('203.', CAST(FLOOR(user_id / 64000) % 256 AS INT), '.', CAST(FLOOR(user_id / 250) % 256 AS INT), '.', user_id % 250)
       ELSE concat('192.168.', CAST(FLOOR(user_id / 250) % 256 AS INT), '.', user_id % 250) END AS src_ip,
  concat('192.168.81.', event_id * 7 % 29) AS dst_ip,
  CAST(49152 + event_id * 13 % 16384 AS INT) AS src_port,
  CAST(CASE k % 12 WHEN 0 THEN 22 WHEN 1 THEN 53 WHEN 2 THEN 80 WHEN 3 THEN 443 WHEN 4 THEN 3389
              WHEN 5 THEN 445 WHEN 6 THEN 3306 WHEN 7 THEN 8443 WHEN 8 THEN 25 WHEN 9 THEN 21
              ELSE 1024 + k * 331 END AS INT) AS dst_port,
  proto_name,
  CASE WHEN event_type = 'error' OR (event_type = 'signup' AND k > 50) THEN 'block' ELSE 'pass' END AS action,
  CASE WHEN event_type = 'purchase' THEN 'out' ELSE 'in' END AS dir,
  CASE WHEN k % 17 = 0 THEN 'short' WHEN k % 13 = 0 THEN 'fragment' ELSE 'match' END AS reason,
  length,
  CAST(FLOOR(length / 3) AS INT) AS data_length,
  CASE k % 6 WHEN 0 THEN 64 WHEN 1 THEN 128 WHEN 2 THEN 255 WHEN 3 THEN 127 WHEN 4 THEN 20 ELSE 61 END AS ttl,
  CASE WHEN proto_name <> 'tcp' THEN NULL
       ELSE CASE k % 9 WHEN 0 THEN 'S' WHEN 1 THEN 'A' WHEN 2 THEN 'SA' WHEN 3 THEN 'F' WHEN 4 THEN 'R'
                       WHEN 5 THEN 'P' WHEN 6 THEN 'FPA' WHEN 7 THEN 'FPU' ELSE 'RA' END END AS tcp_flags,
  CASE WHEN proto_name <> 'tcp' THEN NULL
       ELSE CASE k % 5 WHEN 0 THEN 64240 WHEN 1 THEN 65535 WHEN 2 THEN 8192 WHEN 3 THEN 29200 ELSE 0 END END AS tcp_window
FROM f
"""

# The same columns from the larger table, for volume.
FW_VOLUME_SQL = """
WITH f AS (
  SELECT *, CAST(l_partkey % 100 AS INT) AS k,
         CAST(FLOOR(l_extendedprice) AS BIGINT) AS cents,
         CASE WHEN l_partkey % 10 < 7 THEN 'tcp' WHEN l_partkey % 10 < 9 THEN 'udp' ELSE 'icmp' END AS proto_name
  FROM {lineitem})
SELECT l_orderkey * 10 + l_linenumber AS event_id, l_shipdate AS ts,
  concat('203.', CAST(FLOOR(l_suppkey / 64000) % 256 AS INT), '.', CAST(FLOOR(l_suppkey / 250) % 256 AS INT), '.', CAST(l_suppkey % 250 AS INT)) AS src_ip,
  concat('192.168.81.', CAST(l_orderkey % 250 AS INT)) AS dst_ip,
  CAST(1024 + cents % 64000 AS INT) AS src_port,
  CAST(CASE k % 12 WHEN 0 THEN 22 WHEN 1 THEN 53 WHEN 2 THEN 80 WHEN 3 THEN 443 WHEN 4 THEN 3389
              WHEN 5 THEN 445 WHEN 6 THEN 3306 WHEN 7 THEN 8443 WHEN 8 THEN 25 WHEN 9 THEN 21
              ELSE 1024 + l_partkey % 64000 END AS INT) AS dst_port,
  proto_name,
  CASE WHEN l_returnflag = 'R' THEN 'block' ELSE 'pass' END AS action,
  CASE WHEN l_linestatus = 'F' THEN 'in' ELSE 'out' END AS dir,
  CASE WHEN k % 17 = 0 THEN 'short' WHEN k % 13 = 0 THEN 'fragment' ELSE 'match' END AS reason,
  CAST(40 + cents % 1461 AS INT) AS length,
  CAST(cents % 500 AS INT) AS data_length,
  CASE k % 6 WHEN 0 THEN 64 WHEN 1 THEN 128 WHEN 2 THEN 255 WHEN 3 THEN 127 WHEN 4 THEN 20 ELSE 61 END AS ttl,
  CASE WHEN proto_name <> 'tcp' THEN NULL
       ELSE CASE k % 9 WHEN 0 THEN 'S' WHEN 1 THEN 'A' WHEN 2 THEN 'SA' WHEN 3 THEN 'F' WHEN 4 THEN 'R'
                       WHEN 5 THEN 'P' WHEN 6 THEN 'FPA' WHEN 7 THEN 'FPU' ELSE 'RA' END END AS tcp_flags,
  CASE WHEN proto_name <> 'tcp' THEN NULL
       ELSE CASE k % 5 WHEN 0 THEN 64240 WHEN 1 THEN 65535 WHEN 2 THEN 8192 WHEN 3 THEN 29200 ELSE 0 END END AS tcp_window
FROM f
"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fw(spark: SparkSession, sf_dir: str, ts: str = "ts") -> DataFrame:
    df = spark.sql(FW_SQL, events=load(spark, sf_dir, "events"))
    return df.withColumn("ts", df["ts"].cast("timestamp")).withColumnRenamed("ts", ts)


def fw_volume(spark: SparkSession, sf_dir: str, ts: str = "ts") -> DataFrame:
    df = spark.sql(FW_VOLUME_SQL, lineitem=load(spark, sf_dir, "lineitem"))
    return df.withColumn("ts", df["ts"].cast("timestamp")).withColumnRenamed("ts", ts)


FW_DUCK = FW_SQL.format(events="events").strip()
FW_VOLUME_DUCK = FW_VOLUME_SQL.format(lineitem="lineitem").strip()


def with_fw(body: str) -> str:
    """SQL over ``fw`` for the other engine."""
    return f"WITH fw AS ({FW_DUCK}) {body}"
