"""Incremental scans: a high-water mark that is trusted only for the very same question."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


@dataclass(frozen=True)
class Checkpoint:
    """What a successful scan leaves behind. The next one looks back from its start, so that nothing that changed while it ran is missed."""

    finished_at: str
    query: str
    origin: str
    status: str = "success"
    version: int = 2
    started_at: str | None = None


def read_checkpoint(path: str) -> Checkpoint | None:
    """The checkpoint, or None (meaning a full scan) where there is none that can be read."""
    try:
        return Checkpoint(**json.loads(Path(path).read_text(encoding="utf-8")))
    except (OSError, ValueError, TypeError):
        return None


def write_checkpoint(path: str, checkpoint: Checkpoint, incremental: bool) -> bool:
    """Leaves a checkpoint behind an incremental scan that succeeded; says whether it did."""
    if not incremental or checkpoint.status != "success":
        return False
    Path(path).parent.mkdir(parents=True, exist_ok=True, mode=0o700)
    Path(path).write_text(json.dumps(asdict(checkpoint)), encoding="utf-8")
    return True


def window_start(checkpoint: Checkpoint | None, query: str, origin: str, now: datetime) -> datetime | None:
    """Since when rows have to be read; None for all of them."""
    if checkpoint is None or checkpoint.version != 2 or checkpoint.status != "success" or checkpoint.origin != origin or checkpoint.query.split() != query.split():
        return None
    try:
        at = datetime.fromisoformat(checkpoint.started_at or checkpoint.finished_at)
    except ValueError:
        return None
    if at.tzinfo is None or at > now:
        return None
    return (at - timedelta(minutes=fixed.OVERLAP_MINUTES)).astimezone(UTC)


def since(rows: DataFrame, updated: Column, start: datetime | None) -> DataFrame:
    """Rows updated since a minute; a plain comparison, which is pushed into the scan."""
    return rows if start is None else rows.where(updated >= F.lit(start.replace(second=0, microsecond=0)))
