"""Packets and alerts as deterministic projections of an `events` table, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PACKETS_SQL = """
WITH b AS (
  SELECT event_id AS n, user_id AS u, event_type AS e, CAST(floor(value) AS BIGINT) AS v,
         user_id % 10 AS p, CAST(floor(user_id / 10) AS BIGINT) % 2 AS h FROM {events}),
c AS (
  SELECT n, p, e, v,
    n * 2500 + CAST(floor(n / 5000) AS BIGINT) * 400000000 AS ts_us,
    CASE WHEN p = 9 THEN concat('10.0.9.', CAST(u % 40 AS STRING))
         ELSE concat('10.0.', CAST(p AS STRING), '.', CAST(h + 1 AS STRING)) END AS isrc,
    CASE WHEN p IN (0, 8) THEN '192.168.1.10' ELSE '192.168.1.1' END AS idst,
    CASE WHEN p = 6 THEN NULL WHEN p = 5 THEN 0 WHEN p = 1 THEN 1024 + (n * 7) % 60000
         WHEN p IN (2, 3, 4, 9) THEN 50000 + n % 1000
         WHEN p = 7 THEN 45000 + CAST(floor(n / 10) AS BIGINT) % 40 ELSE 40000 + u % 100 END AS isport,
    CASE WHEN p = 6 THEN NULL WHEN p = 5 THEN 0 WHEN p IN (1, 7) THEN 80
         WHEN p IN (2, 3, 4, 9) THEN 1 + n % 1000 WHEN p = 8 THEN 53 ELSE 443 END AS idport,
    CASE WHEN p = 8 THEN 'UDP' WHEN p = 5 THEN 'ICMP' WHEN p = 6 THEN NULL ELSE 'TCP' END AS proto,
    CASE WHEN p IN (1, 2, 9) THEN 2 WHEN p = 4 THEN 16 WHEN p = 7 THEN 24
         WHEN p = 3 THEN CASE n % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 41 END
         WHEN p = 0 THEN CASE e WHEN 'signup' THEN 2 WHEN 'click' THEN 16 WHEN 'error' THEN 17 ELSE 24 END END AS flags,
    p = 6 AS frag,
    (p IN (0, 8) AND e IN ('view', 'purchase')) AS rev FROM b)
SELECT 'events' AS capture, n AS pkt_no, ts_us,
  CASE WHEN rev THEN idst ELSE isrc END AS src, CASE WHEN rev THEN isrc ELSE idst END AS dst,
  CAST(CASE WHEN rev THEN idport ELSE isport END AS INT) AS sport, CAST(CASE WHEN rev THEN isport ELSE idport END AS INT) AS dport,
  CAST(flags AS INT) AS flags, CAST(CASE WHEN proto = 'TCP' THEN CASE WHEN flags IN (24) THEN v ELSE 0 END END AS INT) AS payload_len,
  proto, CAST(54 + v AS INT) AS frame_len, 4 AS ip_version, frag, p AS profile FROM c
"""

ALERTS_SQL = """
SELECT event_id,
  concat('10.0.0.', CAST(user_id % 20 AS STRING)) AS src,
  concat('192.168.1.', CAST(user_id % 4 AS STRING)) AS dst,
  CASE event_type WHEN 'click' THEN 'port_scan' WHEN 'view' THEN 'slow_scan' WHEN 'purchase' THEN 'brute_force'
                  WHEN 'error' THEN 'dos' ELSE 'anomaly' END AS kind,
  1704067200000000 + event_id * 4000000 AS t_us,
  CASE WHEN event_type IN ('click', 'purchase', 'error') THEN round(value - floor(value), 2) END AS confidence,
  event_id % 3 = 0 AS notified,
  concat('cap', CAST(event_id % 5 AS STRING)) AS capture
FROM {events}
"""

#: Alerts of many small networks: bursts of 400, two hours apart, with some hosts that networks share and some that aren't known.
SITES_SQL = """
SELECT event_id,
  CASE WHEN event_id % 47 = 0 THEN 'multiple' ELSE concat('10.', CAST(user_id % 8 AS STRING), '.0.', CAST(user_id % 7 AS STRING)) END AS src,
  CASE WHEN event_id % 53 = 0 THEN 'unknown' WHEN event_id % 211 = 0 THEN '192.168.9.9'
       ELSE concat('192.168.', CAST(user_id % 8 AS STRING), '.', CAST(event_id % 3 AS STRING)) END AS dst,
  CASE event_type WHEN 'click' THEN 'port_scan' WHEN 'view' THEN 'slow_scan' WHEN 'purchase' THEN 'brute_force'
                  WHEN 'error' THEN 'dos' ELSE 'anomaly' END AS kind,
  1704067200000000 + event_id * 4000000 + CAST(floor(event_id / 400) AS BIGINT) * 7200000000 AS t_us,
  CASE WHEN event_type IN ('click', 'purchase', 'error') THEN round(value - floor(value), 2) END AS confidence,
  event_id % 3 = 0 AS notified,
  concat('cap', CAST(event_id % 5 AS STRING)) AS capture
FROM {events}
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet relation: capture, pkt_no, ts_us, src, dst, sport, dport, flags, payload_len, proto, frame_len, ip_version, frag."""
    return spark.sql(PACKETS_SQL, events=events(spark, sf_dir))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert relation: event_id, src, dst, kind, t_us, confidence, notified, capture."""
    return spark.sql(ALERTS_SQL, events=events(spark, sf_dir))


def site_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As alerts, of many networks."""
    return spark.sql(SITES_SQL, events=events(spark, sf_dir))
