"""Alert payloads and their delivery. A payload shows the first findings at or above a confidence, in finding order."""

from __future__ import annotations

import json
import logging
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..operators.findings import visible
from ..operators.rules import read_records

log = logging.getLogger(__name__)


def _head(run: dict) -> str:
    return f"Findings: {run.get('findings_total', 0)} total, critical {run.get('findings_critical', 0)}, high {run.get('findings_high', 0)}, medium {run.get('findings_medium', 0)}, low {run.get('findings_low', 0)}; {run.get('issues_scanned', 0)} records, {run['status']}, {run.get('duration_secs', 0.0):.1f} s"


def slack(run: dict, rows: list[dict], total: int) -> dict:
    lines = ["*Secret scan complete*", _head(run), *(f"{r['severity']}: `{r['rule_id']}` <{r['issue_url']}|{r['issue_key']}>" for r in rows[:10])]
    return {"text": "\n".join(lines + ([f"... and {total - 10} more"] if total > 10 else []))}


def teams(run: dict, rows: list[dict], total: int) -> dict:
    lines = [_head(run), *(f"- {r['severity']} `{r['rule_id']}` [{r['issue_key']}]({r['issue_url']})" for r in rows[:10])]
    return {"@type": "MessageCard", "@context": "https://schema.org/extensions", "summary": f"Secret scan: {run.get('findings_total', 0)} findings", "title": "Secret scan complete", "text": "  \n".join(lines)}


def webhook(run: dict, rows: list[dict], total: int) -> dict:
    return {"scan_run": run, "findings_count": total, "findings": rows[:20]}


@dataclass(frozen=True)
class Channel:
    """Where to, and what is said. The endpoint never appears in an error."""

    name: str
    endpoint: str
    payload: Callable[[dict, list[dict], int], dict]


def channels(config: dict) -> list[Channel]:
    """Channels of a strict configuration: unknown keys are errors."""
    known = {"slack": ("webhook_url", slack), "teams": ("webhook_url", teams), "webhook": ("url", webhook)}
    if unknown := set(config) - {*known, "min_confidence"}:
        raise ValueError(f"alerts: unknown key {sorted(unknown)[0]}")
    out = []
    for name, (key, payload) in known.items():
        if (own := config.get(name)) is not None:
            if set(own) != {key} or not str(own[key]).strip():
                raise ValueError(f"alerts: {name} takes {key} and nothing else")
            out.append(Channel(name, own[key], payload))
    if str(config.get("min_confidence", "medium")).strip().lower() not in fixed.CONFIDENCES:
        raise ValueError("alerts: min_confidence is no level")
    if not out:
        raise ValueError("alerts: no channel is configured (slack, teams or webhook)")
    return out


def read_alerts(path: str) -> dict:
    """A YAML or JSON configuration on the driver, checked."""
    try:
        config = read_records(path) or {}
    except (OSError, ValueError) as error:
        raise ValueError(f"alerts: {path}: {error}") from error
    if not isinstance(config, dict):
        raise ValueError(f"alerts: {path} holds no configuration")
    channels(config)
    return config


def payloads(found: DataFrame, run: dict, config: dict) -> list[tuple[Channel, dict]]:
    """What each channel is sent; at most twenty rows come to the driver."""
    floor = str(config.get("min_confidence", "medium")).strip().lower()
    total = found.where(C.rank(F.col("confidence"), fixed.CONFIDENCES) >= fixed.CONFIDENCES.index(floor)).count()
    rows = [r.asDict() for r in visible(found, floor, 20).select("rule_id", "severity", "confidence", "issue_key", "issue_url", "field_path", "redacted_secret").collect()]
    return [(c, c.payload(run, rows, total)) for c in channels(config)]


def deliver(messages: list[tuple[Channel, dict]], timeout: float = 10.0, post: Callable[[str, bytes, float], int] | None = None) -> dict[str, bool]:
    """Sends every message at once; failures are logged by channel name and never raised."""

    def default(url: str, body: bytes, seconds: float) -> int:
        request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            return answer.status

    def one(message: tuple[Channel, dict]) -> tuple[str, bool]:
        channel, payload = message
        try:
            done = 200 <= (post or default)(channel.endpoint, json.dumps(payload).encode(), timeout) < 300
        except Exception as error:  # noqa: BLE001  an alert never ends a scan
            log.warning("alert %s failed: %s", channel.name, type(error).__name__)
            return channel.name, False
        return channel.name, done

    with ThreadPoolExecutor(max(1, len(messages))) as pool:
        return dict(pool.map(one, messages))
