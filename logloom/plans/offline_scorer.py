"""A scorer that needs no model: reports the failed actions it finds in a prompt."""

from __future__ import annotations

import json
import re

_EVENT = re.compile(r"\(ID: ([^)]*)\)\n[^\n]*\n[^\n]*\n[^\n]*\nAction: (\S+)")
_SLICE = re.compile(r"slice number (\d+)")


def failed_action_scorer(prompt: str) -> str:
    failed = [event for event, action in _EVENT.findall(prompt) if action == "error"]
    number = _SLICE.search(prompt).group(1)
    threat = {
        "threat_id": f"THREAT-{number}-1", "threat_type": "Failed Activity", "related_events": failed,
        "severity": "High" if len(failed) >= 15 else "Low", "confidence": "High", "description": "Failed actions.",
    }
    body = {"identified_threats": [threat] if failed else [], "suspicious_patterns": [],
            "risk_assessment": {"overall_risk_level": threat["severity"], "reasoning": "counted"},
            "recommendations": [], "limitations": []}
    return f"Counted failures:\n{json.dumps(body)}\nDone."


def summary_scorer(prompt: str) -> str:
    """Counts the threat and limitation lines of a prompt, or adds up the counts of earlier parts."""
    body_lines = prompt.split("\n\n")[2].split("\n")
    threats = sum(line.startswith("    - Threat: ") for line in body_lines)
    limits = sum(line.startswith("- Context ") for line in body_lines)
    for part in re.findall(r"^- Part \d+: (\d+) threat lines, (\d+) limitation lines", prompt, re.MULTILINE):
        threats, limits = threats + int(part[0]), limits + int(part[1])
    body = {"conclusion": f"{threats} threat lines, {limits} limitation lines", "confidence": "Medium", "attack_summary": "",
            "key_indicators": [], "false_positives": [], "reasoning": "", "limitations": []}
    return json.dumps(body)
