"""They have to equal the published behaviour for results to agree."""

# Default severity by event type.
DEFAULT_SEVERITY = {
    "process": 3,
    "netconn": 4,
    "filemod": 3,
    "regmod": 3,
    "moduleload": 2,
    "childproc": 3,
    "crossproc": 5,
    "remotethread": 7,
    "tamper": 8,
    "blocked": 7,
    "alert": 8,
}
DEFAULT_SEVERITY_OTHER = 1

# Telemetry severity words.
TEXT_SEVERITY = {
    "low": 1, "medium": 2, "high": 3, "critical": 4,
    "info": 1, "warning": 2, "error": 3, "fatal": 4,
    "informational": 1, "important": 2, "urgent": 3, "emergency": 4,
    "1": 1, "2": 2, "3": 3, "4": 4,
}
TEXT_SEVERITY_OTHER = 1

# Threat severity labels, most severe first.
THREAT_SEVERITY = {"High": 3, "Medium": 2, "Low": 1}

# Standard field -> names it may have in telemetry, first present wins.
FIELD_SYNONYMS = {
    "timestamp": ["timestamp", "time", "@timestamp", "event_time", "timeGenerated"],
    "event_type": ["event_type", "type", "eventType", "category", "event.type"],
    "process_name": ["process_name", "process", "image", "ImageName", "process.name", "ProcessName"],
    "process_id": ["process_id", "pid", "ProcessId", "process.pid"],
    "hostname": ["hostname", "host", "Computer", "device_name", "agent.hostname"],
    "username": ["username", "user", "User", "user.name", "UserName"],
    "command_line": ["command_line", "commandline", "CommandLine", "process.command_line"],
    "parent_process_name": ["parent_process_name", "parent_name", "ParentProcessName", "parent.name"],
    "parent_process_id": ["parent_process_id", "parent_pid", "ppid", "ParentProcessId", "parent.pid"],
    "severity": ["severity", "alert_severity", "Severity", "severity_level"],
}

# Event id fallbacks, in order.
EVENT_ID_FALLBACKS = ["event_id", "id", "EventID", "_id"]

# Header words that mark a comma-separated file as an event log.
CSV_HEADER_WORDS = ["timestamp", "event_type", "process", "pid", "hostname", "user"]

# Line and attribute patterns of the text formats.
SYSLOG_START = r"\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
SYSLOG_LINE = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:]+):\s+(.*)$"
SYSLOG_QUOTED_PAIR = r'([^=\s]+)\s*=\s*"([^"]*)"'
SYSLOG_PLAIN_PAIR = r"([^=\s]+)\s*=\s*(\S+)"
ATTRIBUTE_PAIR = r"([^=\s]+)=(\S+)(?:\s|$)"

# Lone bracket lines that the tolerant line reader skips.
BRACKET_LINES = ["[", "]", "{", "}", "[{", "}]"]

# Price in USD per 1,000 tokens (provider, model, input, output).
PRICES = [
    ("anthropic", "claude-3-7-sonnet-20250219", 0.015, 0.075),
    ("anthropic", "claude-3-opus", 0.03, 0.15),
    ("anthropic", "claude-3-5-sonnet", 0.01, 0.05),
    ("anthropic", "default", 0.015, 0.075),
    ("deepseek", "deepseek-chat", 0.0020, 0.0060),
    ("deepseek", "deepseek-coder", 0.0025, 0.0075),
    ("deepseek", "default", 0.0020, 0.0060),
    ("deepseek_local", "default", 0.0, 0.0),
    ("default", "default", 0.01, 0.05),
]
INPUT_TOKEN_SHARE = 0.7
OUTPUT_TOKEN_SHARE = 0.3

# Limits of the configured runs.
CHUNK_SIZE = 50
CHUNK_OVERLAP = 10
PROMPT_BUDGET = 25000
MAX_RETRIES = 3
CHARS_PER_TOKEN = 4
DETECT_SAMPLE_CHARS = 10000

# Upper ends of the limitation bands.
LIMITATION_BANDS = [
    (0.25, "Minimal limitation"),
    (0.5, "Moderate limitation"),
    (0.75, "Significant limitation"),
]
LIMITATION_TOP = "Severe limitation"

# Sentences and layouts of the results, word for word, with places for values.
RISK_REASONING = "Based on %d identified threats%s (%d high, %d medium, %d low severity)."
RISK_CHUNKS = " across %d data chunks"
CHAIN_COURSE = "The attack chain involves %s, beginning with %s and progressing to %s."
SUMMARY_CHAIN = "Analysis identified a %s severity attack chain involving %d connected threats. %s"
SUMMARY_NOTHING = "No significant threats identified in the analyzed data."
SUMMARY_UNCLEAR = "Analysis identified %d potential threats but no clear attack patterns were established."
SUMMARY_SEVERE = "Analysis identified %d high severity threats including %s. However, no clear attack chain was established."
EVENTS_HEADER = "NETWORK FLOW DATA (%d total events)\n\n"
EVENT_LAYOUT = "Event %d (ID: %s)\nTime: %s\nSource: %s\nDestination: %s\nAction: %s\n\n"
CONCLUSION_NOTHING = "No significant threats detected"
CONCLUSION_BROKEN = "Analysis complete but summary parsing failed"
REPLY_WITHOUT_JSON = "No JSON found in response"
ALL_CHUNKS_FAILED = "All chunks failed to process"
