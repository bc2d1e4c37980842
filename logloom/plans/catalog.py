"""Registry of queries, each next to the SQL that gives the same rows on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapter import EV

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
_PARTS: dict[str, tuple[str, tuple[str, ...]]] = {}

# name -> (names it builds on, definition)
CTES: dict[str, tuple[list[str], str]] = {
    "ev": ([], EV),
    "ordered": (["ev"], 'ordered AS (SELECT *, row_number() OVER (ORDER BY "timestamp", event_id) - 1 AS ord FROM ev)'),
    "ce": (["ordered"], """ce AS (
  SELECT o.*, c.chunk_idx FROM ordered o
  JOIN (SELECT unnest(range(0, (SELECT CASE WHEN count(*) <= 50 THEN 1
      ELSE CAST(ceil((count(*) - 50) / 40.0) AS BIGINT) + 1 END FROM ev))) AS chunk_idx) c
    ON o.ord >= c.chunk_idx * 40 AND o.ord < c.chunk_idx * 40 + 50)"""),
    "hits": (["ce"], r"""hits AS (
  SELECT chunk_idx, ord, event_id, 1 AS rule, 'Failed Activity' AS threat_type, hostname AS "key" FROM ce
    WHERE event_type IN ('alert', 'blocked')
  UNION ALL SELECT chunk_idx, ord, event_id, 2, 'Outbound Connection', hostname FROM ce
    WHERE event_type = 'netconn' AND destination LIKE '203.%'
  UNION ALL SELECT chunk_idx, ord, event_id, 3, 'Suspicious Execution', hostname FROM ce
    WHERE command_line LIKE 'powershell%'
  UNION ALL SELECT chunk_idx, ord, event_id, 4, 'Persistence', hostname FROM ce
    WHERE command_line LIKE 'schtasks /create%' OR registry_key LIKE '%CurrentVersion%Run%'
  UNION ALL SELECT chunk_idx, ord, event_id, 5, 'Noisy Process', process_name FROM ce
    WHERE event_type IN ('alert', 'blocked'))"""),
    "groups": (["hits"], """groups AS (
  SELECT *, row_number() OVER (PARTITION BY chunk_idx ORDER BY rule, "key") - 1 AS pos FROM (
    SELECT chunk_idx, rule, threat_type, "key", count(*) AS n, arg_min(event_id, ord) AS first_event FROM hits
    GROUP BY ALL HAVING rule <> 5 OR count(*) >= 2))"""),
    "raw_threats": (["groups"], """raw_threats AS (
  SELECT chunk_idx, pos, rule, "key", n, threat_type,
    CASE WHEN rule = 2 AND n = 1 THEN '' WHEN rule = 1 THEN 'THREAT-' || "key" || '-' || first_event
      ELSE 'THREAT-' || (chunk_idx + 1) || '-' || (pos + 1) END AS threat_id,
    CASE WHEN rule = 4 AND n = 1 THEN NULL WHEN n >= 3 THEN 'Critical' WHEN n = 2 OR rule = 3 THEN 'High'
      WHEN rule = 2 THEN 'Medium' ELSE 'Low' END AS severity,
    CASE WHEN rule = 1 THEN CASE WHEN n >= 2 THEN 'High' ELSE 'Medium' END WHEN rule = 2 THEN 'Low'
      WHEN rule = 3 THEN 'High' WHEN rule = 5 THEN 'Medium' END AS confidence,
    threat_type || ' on ' || "key" || ', ' || n || ' event(s) from ' || first_event ||
      CASE WHEN rule = 3 THEN ' with a command line that hides its window or carries an encoded payload' ELSE '' END ||
      '. Slice ' || (chunk_idx + 1) || '.' AS description
  FROM groups)"""),
    "raw_links": (["groups", "hits"], """raw_links AS (
  SELECT g.chunk_idx, g.pos, h.ord, h.event_id FROM hits h JOIN groups g USING (chunk_idx, rule, "key"))"""),
    "pattern_groups": (["ce"], """pattern_groups AS (
  SELECT *, row_number() OVER (PARTITION BY chunk_idx ORDER BY destination) - 1 AS pos FROM (
    SELECT chunk_idx, destination, count(*) AS n FROM ce GROUP BY ALL HAVING count(*) >= 2))"""),
    "raw_patterns": (["pattern_groups"], """raw_patterns AS (
  SELECT chunk_idx, pos, 'PATTERN-' || (chunk_idx + 1) || '-' || (pos + 1) AS pattern_id,
    CASE WHEN destination LIKE '203.%' THEN 'Repeated outbound contact' ELSE 'Repeated internal contact' END AS pattern_type,
    'Destination ' || destination || ' met ' || n || ' times.' AS description
  FROM pattern_groups)"""),
    "raw_pattern_links": (["pattern_groups", "ce"], """raw_pattern_links AS (
  SELECT g.chunk_idx, g.pos, ce.ord, ce.event_id FROM ce JOIN pattern_groups g USING (chunk_idx, destination))"""),
    "threats": (["raw_threats"], """threats AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY threat_id ORDER BY chunk_idx, pos) AS rn FROM (
      SELECT * REPLACE (CASE WHEN coalesce(threat_id, '') = '' THEN 'gen-' || chunk_idx || '-' || pos ELSE threat_id END
        AS threat_id) FROM raw_threats)) WHERE rn = 1)"""),
    "links": (["threats", "raw_links"], """links AS (
  SELECT t.threat_id, t.chunk_idx, t.pos, l.ord, l.event_id FROM raw_links l JOIN threats t USING (chunk_idx, pos))"""),
    "patterns": (["raw_patterns"], "patterns AS (SELECT * FROM raw_patterns)"),
    "pattern_links": (["patterns", "raw_pattern_links"], """pattern_links AS (
  SELECT p.pattern_id, l.ord, l.event_id FROM raw_pattern_links l JOIN patterns p USING (chunk_idx, pos))"""),
}


def sql(body: str, *needs: str) -> str:
    """``body`` behind the definitions it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in CTES[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    return f"WITH {', '.join(CTES[n][1] for n in order)}\n{body}" if order else body


def query(key: str, body: str | None = None, *needs: str):
    """Register a query and, where SQL can say it, its equivalent."""

    def register(run: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = run
        if body is not None:
            _PARTS[key] = (body, needs)
        return run

    return register


def oracle_sql() -> dict[str, str]:
    return {key: sql(body, *needs) for key, (body, needs) in _PARTS.items()}


def stamp(column: Column | str) -> Column:
    """Timestamp as text with microseconds, the same on both sides of a comparison."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def stamp_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"
