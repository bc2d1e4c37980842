"""Row shapes shared by sources, scoring and findings."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in names])


# Event records as read: every scalar as text, typed later by the normaliser.
RAW_EVENT = strings(
    "event_id", "timestamp", "event_type", "severity", "process_name", "process_pid",
    "parent_name", "parent_id", "hostname", "username", "command_line", "source",
    "destination", "action", "bytes", "remote_ip", "remote_port", "protocol", "file_path",
    "file_operation", "registry_key", "registry_operation", "ioc_match", "ioc_type",
)

FLOW = strings("source", "destination", "action")

THREAT = T.StructType([
    T.StructField("threat_id", _S),
    T.StructField("threat_type", _S),
    T.StructField("related_events", T.ArrayType(_S)),
    T.StructField("severity", _S),
    T.StructField("confidence", _S),
    T.StructField("description", _S),
])
PATTERN = T.StructType([
    T.StructField("pattern_id", _S),
    T.StructField("pattern_type", _S),
    T.StructField("related_events", T.ArrayType(_S)),
    T.StructField("description", _S),
])
PROPOSED_CHAIN = T.StructType([
    T.StructField("chain_id", _S),
    T.StructField("description", _S),
    T.StructField("events", T.ArrayType(_S)),
    T.StructField("severity", _S),
    T.StructField("techniques", T.ArrayType(_S)),
])
FINDINGS = T.StructType([
    T.StructField("identified_threats", T.ArrayType(THREAT)),
    T.StructField("suspicious_patterns", T.ArrayType(PATTERN)),
    T.StructField("potential_attack_chains", T.ArrayType(PROPOSED_CHAIN)),
    T.StructField("risk_assessment", strings("overall_risk_level", "reasoning")),
    T.StructField("recommendations", T.ArrayType(_S)),
    T.StructField("limitations", T.ArrayType(_S)),
])
SUMMARY = T.StructType([
    T.StructField("conclusion", _S),
    T.StructField("confidence", _S),
    T.StructField("attack_summary", _S),
    T.StructField("key_indicators", T.ArrayType(_S)),
    T.StructField("false_positives", T.ArrayType(_S)),
    T.StructField("reasoning", _S),
    T.StructField("limitations", T.ArrayType(_S)),
])

# One stored analysis result (a chunk result or the aggregate).
PERFORMANCE = T.StructType([
    T.StructField("api_calls", T.LongType()),
    T.StructField("total_api_calls", T.LongType()),
    T.StructField("total_tokens", T.DoubleType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("total_duration_seconds", T.DoubleType()),
    T.StructField("input_file_size_gb", T.DoubleType()),
])
RESULT = T.StructType([
    *FINDINGS.fields,
    T.StructField("chunk_count", T.LongType()),
    T.StructField("performance", PERFORMANCE),
])

GPU = T.StructType([
    T.StructField("name", _S),
    T.StructField("memory_used_percent", T.DoubleType()),
    T.StructField("utilization_percent", T.DoubleType()),
    T.StructField("memory_allocated_mb", T.DoubleType()),
    T.StructField("memory_reserved_mb", T.DoubleType()),
])

PROCESS = T.StructType([
    *strings("id", "process_name", "process_pid", "hostname", "username", "command_line", "path",
             "parent_id", "parent_name", "start_time", "last_update", "process_md5", "webui_link").fields,
    T.StructField("events", T.ArrayType(strings("event_type", "timestamp", "detail"))),
])


def _valued(*attributes: str) -> T.StructType:
    return strings("_VALUE", *[f"_{a}" for a in attributes])


# Windows event: children of System with the attributes they may carry.
WINDOWS_EVENT = T.StructType([
    T.StructField("System", T.StructType([
        T.StructField("Provider", _valued("Name", "Guid", "EventSourceName")),
        T.StructField("EventID", _valued("Qualifiers")),
        T.StructField("Version", _S),
        T.StructField("Level", _S),
        T.StructField("Task", _S),
        T.StructField("Opcode", _S),
        T.StructField("Keywords", _S),
        T.StructField("TimeCreated", _valued("SystemTime")),
        T.StructField("EventRecordID", _S),
        T.StructField("Correlation", _valued("ActivityID", "RelatedActivityID")),
        T.StructField("Execution", _valued("ProcessID", "ThreadID")),
        T.StructField("Channel", _S),
        T.StructField("Computer", _S),
        T.StructField("Security", _valued("UserID")),
    ])),
    T.StructField("EventData", T.StructType([
        T.StructField("Data", T.ArrayType(_valued("Name"))),
    ])),
])
