"""The driver's ``events`` table in the shape of a security event log, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.severity import default_severity

_TYPES = {"error": "alert", "click": "process", "view": "netconn", "signup": "regmod", "purchase": "filemod"}


def event_name() -> Column:
    return F.concat(F.lit("evt-"), F.col("event_id"))


def shape_events(raw: DataFrame, *others: str) -> DataFrame:
    """The events, and the columns ``others`` behind them.

    What many columns use is a column first, so that it is worked out once for a row.
    """
    named = F.coalesce(*[F.when(F.col("event_type") == old, new) for old, new in _TYPES.items()], F.col("event_type"))
    raw = raw.withColumns({"_k": F.get_json_object("props", "$.k").cast("int"), "_kind": named})
    user, k, kind = F.col("user_id"), F.col("_k"), F.col("_kind")
    command = (
        F.when(k == 11, F.concat(F.lit("powershell.exe -enc QQ"), user))
        .when(k == 12, F.lit("powershell.exe -WindowStyle Hidden -File job.ps1"))
        .when(k == 13, F.concat(F.lit("schtasks /create /tn task"), user))
        .otherwise(F.concat(F.lit("app.exe --level "), k)))
    registry = F.when(k < 10, F.concat(F.lit("HKLM\\Software\\CurrentVersion\\Run\\app"), k)).otherwise(
        F.concat(F.lit("HKCU\\Software\\App\\opt"), k))
    port = F.when(k == 7, 4444).when(k < 4, 8080).otherwise(443)
    return raw.select(
        event_name().alias("event_id"),
        F.col("event_id").alias("event_no"),
        F.col("ts").alias("timestamp"),
        kind.alias("event_type"),
        F.col("event_type").alias("action"),
        F.concat(F.lit("proc-"), user % 40, F.lit(".exe")).alias("process_name"),
        F.concat(F.lit("host-"), user % 25).alias("hostname"),
        F.concat(F.lit("user-"), user).alias("username"),
        F.concat(F.lit("10.0.1."), user % 40).alias("source"),
        F.when(k < 70, F.concat(F.lit("10.0.2."), k)).otherwise(F.concat(F.lit("203.0.113."), k)).alias("destination"),
        F.col("value").alias("bytes"),
        k.alias("k"),
        default_severity(kind).alias("severity"),
        F.when(kind == "process", command).alias("command_line"),
        F.when(kind == "regmod", registry).alias("registry_key"),
        F.when(kind == "netconn", port).alias("remote_port"),
        *others,
    )


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


EV = r"""ev AS (
  SELECT *,
    CASE event_type WHEN 'process' THEN 3 WHEN 'netconn' THEN 4 WHEN 'filemod' THEN 3 WHEN 'regmod' THEN 3
      WHEN 'alert' THEN 8 ELSE 1 END AS severity,
    CASE WHEN event_type = 'process' THEN CASE k WHEN 11 THEN 'powershell.exe -enc QQ' || user_id
      WHEN 12 THEN 'powershell.exe -WindowStyle Hidden -File job.ps1' WHEN 13 THEN 'schtasks /create /tn task' || user_id
      ELSE 'app.exe --level ' || k END END AS command_line,
    CASE WHEN event_type = 'regmod' THEN CASE WHEN k < 10 THEN 'HKLM\Software\CurrentVersion\Run\app' || k
      ELSE 'HKCU\Software\App\opt' || k END END AS registry_key,
    CASE WHEN event_type = 'netconn' THEN CASE WHEN k = 7 THEN 4444 WHEN k < 4 THEN 8080 ELSE 443 END END AS remote_port
  FROM (SELECT 'evt-' || event_id AS event_id, event_id AS event_no, ts AS "timestamp",
      CASE event_type WHEN 'error' THEN 'alert' WHEN 'click' THEN 'process' WHEN 'view' THEN 'netconn'
        WHEN 'signup' THEN 'regmod' WHEN 'purchase' THEN 'filemod' ELSE event_type END AS event_type,
      event_type AS action, 'proc-' || (user_id % 40) || '.exe' AS process_name, 'host-' || (user_id % 25) AS hostname,
      'user-' || user_id AS username, '10.0.1.' || (user_id % 40) AS source,
      CASE WHEN k < 70 THEN '10.0.2.' || k ELSE '203.0.113.' || k END AS destination,
      value AS bytes, k, user_id
    FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)))"""
