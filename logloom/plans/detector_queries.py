"""Detector queries: header rows with the number of linked events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detectors
from .adapter import load_events
from .catalog import query


def _counted(found: detectors.Detection, *columns: str) -> DataFrame:
    """Threat rows with their link count; the two must agree with ``event_count``."""
    linked = found.links.groupBy("threat_id").agg(F.count("*").alias("linked"))
    return found.threats.join(linked, "threat_id").select("threat_id", "severity", *columns, "event_count", "linked")


def _slot(width: str) -> str:
    return f"time_bucket(INTERVAL {width}, \"timestamp\", TIMESTAMP '1970-01-01')"


def _fan_sql(prefix: str, key: str, other: str, minimum: int, where: str = "true") -> str:
    return f"""SELECT '{prefix}-' || {key} || '-' || strftime(slot, '%Y%m%d%H%M%S') AS threat_id,
    CASE WHEN d >= {2 * minimum} THEN 'High' ELSE 'Medium' END AS severity, d AS distinct_count, n AS event_count, n AS linked
  FROM (SELECT {key}, {_slot("'6' HOUR")} AS slot, count(DISTINCT {other}) AS d, count(*) AS n FROM ev WHERE {where} GROUP BY ALL)
  WHERE d >= {minimum}"""


@query("det_scanning", _fan_sql("SCAN", "source", "destination", 5), "ev")
def det_scanning(spark, sf_dir):
    return _counted(detectors.scanning(load_events(spark, sf_dir), "6 hours", 5), "distinct_count")


@query("det_lateral", _fan_sql("LATERAL", "destination", "source", 3, "source LIKE '10.%'"), "ev")
def det_lateral(spark, sf_dir):
    return _counted(detectors.lateral_movement(load_events(spark, sf_dir), "6 hours", 3), "distinct_count")


@query("det_beaconing", """, g AS (SELECT source, destination, epoch_us("timestamp") // 1000 AS ms,
    epoch_us("timestamp") // 1000 - lag(epoch_us("timestamp") // 1000) OVER (PARTITION BY source, destination ORDER BY "timestamp") AS gap FROM ev),
  p AS (SELECT source, destination, count(gap) AS gap_count, count(*) AS n, avg(gap) AS m, stddev_pop(gap) AS s FROM g GROUP BY ALL)
  SELECT 'BEACON-' || source || '-' || destination AS threat_id, 'High' AS severity, gap_count, round(s / m, 6) AS variation,
    n AS event_count, n AS linked FROM p WHERE gap_count >= 2 AND s / m <= 0.3""", "ev")
def det_beaconing(spark, sf_dir):
    found = detectors.beaconing(load_events(spark, sf_dir), max_variation=0.3, min_gaps=2)
    return _counted(found, "gap_count", "variation").withColumn("variation", F.round("variation", 6))


@query("det_exfil", f""", v AS (SELECT source, {_slot("'6' HOUR")} AS slot, sum(CAST(bytes AS DECIMAL(18, 2)))::DOUBLE AS total_bytes,
    count(*) AS n FROM ev WHERE destination LIKE '203.%' GROUP BY ALL)
  SELECT 'EXFIL-' || source || '-' || strftime(slot, '%Y%m%d%H%M%S') AS threat_id, 'High' AS severity, total_bytes, n AS event_count, n AS linked
  FROM v WHERE total_bytes > (SELECT quantile_disc(total_bytes, 0.95) FROM v)""", "ev")
def det_exfil(spark, sf_dir):
    return _counted(detectors.exfiltration(load_events(spark, sf_dir), "6 hours", 0.95), "total_bytes")


@query("det_failed_burst", """, f AS (SELECT *, CASE WHEN date_diff('microsecond', lag("timestamp") OVER w, "timestamp") < 21600000000
      THEN 0 ELSE 1 END AS fresh FROM ev WHERE event_type = 'alert' WINDOW w AS (PARTITION BY source ORDER BY "timestamp")),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY source ORDER BY "timestamp") AS sid FROM f)
  SELECT 'BURST-' || source || '-' || strftime(min("timestamp"), '%Y%m%d%H%M%S') AS threat_id, CASE WHEN count(*) >= 6 THEN 'High' ELSE 'Medium' END AS severity,
    strftime(max("timestamp"), '%Y-%m-%d %H:%M:%S.%f') AS session_end_text, count(*) AS event_count, count(*) AS linked
  FROM s GROUP BY source, sid HAVING count(*) >= 3""", "ev")
def det_failed_burst(spark, sf_dir):
    found = detectors.failed_burst(load_events(spark, sf_dir), F.col("event_type") == "alert", 21600, 3)
    return _counted(found, "session_end").withColumn(
        "session_end_text", F.date_format("session_end", "yyyy-MM-dd HH:mm:ss.SSSSSS")).drop("session_end")


@query("det_rare", """, v AS (SELECT 'remote_port' AS attribute, CAST(remote_port AS VARCHAR) AS value FROM ev WHERE remote_port IS NOT NULL
    UNION ALL SELECT 'process_name', process_name FROM ev),
  c AS (SELECT attribute, value, count(*) AS n FROM v GROUP BY ALL)
  SELECT 'RARE-' || attribute || '-' || value AS threat_id, 'Low' AS severity, round(n / t, 6) AS share, n AS event_count, n AS linked
  FROM c JOIN (SELECT attribute, sum(n) AS t FROM c GROUP BY 1) USING (attribute) WHERE n / t < 0.02""", "ev")
def det_rare(spark, sf_dir):
    found = detectors.rare_values(load_events(spark, sf_dir), ["remote_port", "process_name"], 0.02)
    return _counted(found, "share").withColumn("share", F.round("share", 6))


@query("det_ioc", """, i AS (SELECT '203.0.113.' || (70 + n_nationkey) AS indicator, n_name AS ioc_type FROM nation)
  SELECT 'IOC-' || indicator AS threat_id, 'High' AS severity, ioc_type, count(*) AS event_count, count(*) AS linked
  FROM ev JOIN i ON destination = indicator GROUP BY indicator, ioc_type""", "ev")
def det_ioc(spark, sf_dir):
    """The nations stand for a list of known-bad addresses."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    indicators = nations.select(
        F.concat(F.lit("203.0.113."), F.lit(70) + F.col("n_nationkey")).alias("indicator"), F.col("n_name").alias("ioc_type"))
    return _counted(detectors.ioc_matches(load_events(spark, sf_dir), indicators, ["source", "destination"]), "ioc_type")


SEQUENCE_LIMIT = 6 * 3600


def attack_stages():
    kind = F.col("event_type")
    return [
        ("connect", (kind == "netconn") & F.col("destination").startswith("203.")),
        ("execute", kind == "process"),
        ("fail", kind == "alert"),
    ]


DET_SEQUENCE_SQL = """, a AS (SELECT * FROM ev WHERE event_type = 'netconn' AND destination LIKE '203.%'),
  b AS (SELECT a.event_id AS e1, a.hostname, a."timestamp" AS t1, min(x."timestamp") AS t2 FROM a JOIN ev x ON x.hostname = a.hostname
    AND x.event_type = 'process' AND x."timestamp" > a."timestamp" GROUP BY ALL),
  c AS (SELECT b.*, min(y."timestamp") AS t3 FROM b JOIN ev y ON y.hostname = b.hostname AND y.event_type = 'alert'
    AND y."timestamp" > t2 GROUP BY ALL)
  SELECT 'SEQ-' || c.hostname || '-' || e1 AS threat_id, c.hostname, e1 || ',' || x.event_id || ',' || y.event_id AS related_events
  FROM c JOIN ev x ON x.hostname = c.hostname AND x."timestamp" = t2 AND x.event_type = 'process'
  JOIN ev y ON y.hostname = c.hostname AND y."timestamp" = t3 AND y.event_type = 'alert'
  WHERE epoch_us(t3) - epoch_us(t1) <= 21600000000"""


@query("det_sequence", DET_SEQUENCE_SQL, "ev")
def det_sequence(spark, sf_dir):
    found = detectors.sequences(load_events(spark, sf_dir), attack_stages(), SEQUENCE_LIMIT)
    return found.select("threat_id", "hostname", F.array_join("related_events", ",").alias("related_events"))


@query("det_command_line", """, h AS (SELECT event_id, hostname, 'encoded-command' AS rule FROM ev WHERE command_line LIKE 'powershell.exe -enc %'
    UNION ALL SELECT event_id, hostname, 'hidden-window' FROM ev WHERE command_line LIKE '%-WindowStyle Hidden%')
  SELECT 'CMD-' || rule || '-' || hostname AS threat_id, 'High' AS severity, rule, count(*) AS event_count, count(*) AS linked FROM h GROUP BY ALL""", "ev")
def det_command_line(spark, sf_dir):
    return _counted(detectors.command_lines(load_events(spark, sf_dir)), "rule")


@query("det_persistence", r""", h AS (SELECT event_id, hostname, 'command' AS rule FROM ev WHERE command_line LIKE 'schtasks /create%'
    UNION ALL SELECT event_id, hostname, 'registry' FROM ev WHERE registry_key LIKE '%\CurrentVersion\Run\%')
  SELECT 'PERSIST-' || rule || '-' || hostname AS threat_id, 'Medium' AS severity, rule, count(*) AS event_count, count(*) AS linked FROM h GROUP BY ALL""", "ev")
def det_persistence(spark, sf_dir):
    return _counted(detectors.persistence(load_events(spark, sf_dir)), "rule")
