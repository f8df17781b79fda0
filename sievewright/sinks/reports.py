"""Report formats. Rows are shaped, sorted and written on the executors; a report's file is joined from their part files.

The table and the summary, whose lines are quoted or laid out for a reader, are read a partition at a time.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.findings import rule_levels
from ..sources.stages import drop_path, workdir

CSV = ("finding_id", "issue_key", "issue_url", "field_path", "rule_id", "severity", "confidence", "redacted_secret", "secret_hash", "snippet", "detected_at", "source_type", "status", "first_seen", "times_seen", "external_validation")
FREE_TEXT = ("issue_key", "issue_url", "field_path", "redacted_secret", "snippet")
SARIF = "https://json.schemastore.org/sarif-2.1.0.json"
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


class UnknownFormat(ValueError):
    """A report format that isn't in the catalogue."""


def json_rows(found: DataFrame) -> DataFrame:
    """One JSON object per finding; what is null or an empty list of references is left out."""
    slim = found.drop("seg_ord", "detector_ord", "rule_ord", "hit_ord").withColumn("references", F.when(F.size("references") > 0, F.col("references")))
    return slim.select(F.to_json(F.struct(*sorted(c for c in slim.columns if c != "ord")), {"ignoreNullFields": "true"}).alias("value"), "ord")


def csv_rows(found: DataFrame) -> DataFrame:
    """The 16 columns of the table report, cells made harmless."""
    ext = F.when(F.col("external_validation").isNotNull(), F.concat(F.lit("valid="), F.col("external_validation.valid").cast("string"), F.lit("@"), F.col("external_validation.source"))).otherwise(F.lit(""))
    cell = lambda c: ext.alias(c) if c == "external_validation" else (C.csv_field(F.col(c)) if c in FREE_TEXT else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c)
    return found.select(*map(cell, CSV))


def sarif_results(found: DataFrame) -> DataFrame:
    """One result as JSON for each finding, in finding order."""
    level = F.coalesce(*(F.when(F.col("severity") == s, F.lit(v)) for s, v in LEVELS.items()), F.lit("note"))
    tags = F.array_compact(F.array(F.col("source_type"), F.col("status"), F.when(_live(), F.lit("live-validated"))))
    artifact = F.struct(
        F.col("issue_url").alias("uri"), F.struct(F.lit("Tracker entry in which the value stands").alias("text")).alias("description"),
        F.struct(F.lit("record").alias("artifactKind"), F.col("issue_key").alias("issueKey"), F.col("field_path").alias("fieldPath")).alias("properties"),
    )
    more = F.struct("finding_id", "issue_key", "field_path", "confidence", "status", "secret_hash", "detected_at", "first_seen", "times_seen", "external_validation", tags.alias("tags"))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.concat_ws(": ", "rule_id", "redacted_secret").alias("text")).alias("message"), F.array(F.struct(F.struct(artifact.alias("artifactLocation")).alias("physicalLocation"))).alias("locations"), more.alias("properties"))
    return found.select(F.to_json(result, {"ignoreNullFields": "false"}).alias("value"), "ord")


def _live() -> Column:
    return F.coalesce(F.col("external_validation.valid"), F.lit(False))


def defectdojo_rows(found: DataFrame) -> DataFrame:
    """The columns of a tracker import, one row per finding."""
    primary = F.when(F.size("locations") > 0, F.get("locations", F.lit(0))["issue_key"]).otherwise(F.col("issue_key"))
    label = F.when(F.col("status") == "falsepositive", "false-positive").otherwise(F.col("status"))
    ext = F.col("external_validation")
    said = [("Rule: ", "rule_id"), ("\nIssue: ", "issue_key"), (" (", "issue_url"), (")\nField: ", "field_path"), (" (", "source_type"), (")\nDetected secret: ", "redacted_secret"), ("\nSnippet: ", "snippet"), ("\nConfidence: ", "confidence"), ("\nSecret hash (sha256): ", "secret_hash"), ("\nDetected at: ", "detected_at"), ("\nStatus: ", label), ("\nScanner version: ", "scanner_version")]
    description = F.concat(*(x for before, value in said for x in (F.lit(before), F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit("")))))
    seen = F.when(F.col("first_seen").isNotNull() & F.col("times_seen").isNotNull(), F.concat(F.lit("\nFirst seen: "), "first_seen", F.lit("\nTimes seen: "), F.col("times_seen").cast("string")))
    checked = F.when(ext.isNotNull(), F.concat(F.lit("\nExternal validation: valid="), ext["valid"].cast("string"), F.lit(" (source: "), F.coalesce(ext["source"], F.lit("")), F.lit(", checked_at: "), F.coalesce(ext["checked_at"], F.lit("")), F.lit(")")))
    return found.select(
        F.concat_ws(" in ", "rule_id", "issue_key").alias("title"), F.initcap("severity").alias("severity"), F.concat(description, F.coalesce(seen, F.lit("")), F.coalesce(checked, F.lit(""))).alias("description"), F.col("detected_at").alias("date"),
        F.lit("Others may know this value: withdraw it, put a new one in its place, and take it out of the tracker with all its earlier versions.").alias("mitigation"), F.col("issue_url").alias("references"), F.col("issue_key").alias("file_path"),
        (~F.col("status").isin("closed", "resolved", "falsepositive")).alias("active"), _live().alias("verified"), (F.col("status") == "falsepositive").alias("false_p"), F.lit(False).alias("duplicate"), F.lit(True).alias("static_finding"),
        F.concat(C.fingerprint(F.col("secret_hash"), F.col("rule_id"), primary), F.lit("#0")).alias("unique_id_from_tool"),
        F.array_join(F.array_compact(F.array(F.lit("secret-scanner"), F.col("source_type"), F.concat(F.lit("status:"), label), F.when(_live(), F.lit("live-validated")))), ",").alias("tags"), "ord",
    )


def incomplete(run: dict) -> tuple[str, str] | None:
    """Level and text of what a report says about a run that didn't finish."""
    read, asked, errors = (run.get(key, 0) for key in ("issues_scanned", "issues_total", "errors_total"))
    if run["status"] == "partial":
        return "warning", f"Some of the input was left out ({read} records of {asked}, {errors} errors) and may hold more than is listed here."
    if run["status"] == "failed":
        return "error", f"The run broke off after {read} records of {asked} with {errors} errors; nothing follows from what it does not list."
    return None


def _joined(rows: DataFrame, path: Path, head: str = "", before: str = "", tail: str = "") -> None:
    """A report file out of texts (value) in finding order, each on a line of its own, with ``before`` in front of all but the first.

    The executors sort and write the texts as part files in the shared folder; those are joined by their bytes, so no row comes to the driver's Python.
    """
    spark = rows.sparkSession
    folder = f"{workdir(spark)}/report-{uuid.uuid4().hex}"
    rows.sort(F.col("ord").asc_nulls_last()).select(F.concat(F.lit(before), "value").alias("value")).write.text(folder)
    java = spark.sparkContext._jvm
    files = java.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted(((f.getPath().getName(), f) for f in files.listStatus(java.org.apache.hadoop.fs.Path(folder)) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda x: x[0])
    path.write_text(head, encoding="utf-8")
    out = java.java.io.FileOutputStream(str(path.absolute()), True)
    try:
        for i, (_, part) in enumerate(parts):
            held = files.open(part.getPath())
            try:
                if i == 0:
                    held.seek(len(before.encode()))
                java.org.apache.hadoop.io.IOUtils.copyBytes(held, out, 1 << 16, False)
            finally:
                held.close()
    finally:
        out.close()
        drop_path(spark, folder)
    with path.open("a", encoding="utf-8") as end:
        end.write(tail)


def write_json(found: DataFrame, run: dict, path: Path) -> None:
    _joined(json_rows(found), path, f'{{"scan_run": {json.dumps(run)}, "findings": [\n', ",", "]}\n")


def write_ndjson(found: DataFrame, run: dict, path: Path) -> None:
    _joined(json_rows(found), path)


def write_csv(found: DataFrame, run: dict, path: Path) -> None:
    import csv

    with path.open("w", encoding="utf-8", newline="") as out:
        rows = csv.writer(out)
        rows.writerow(CSV)
        rows.writerows(tuple(r) for r in csv_rows(found.sort(F.col("ord").asc_nulls_last())).toLocalIterator())


def write_sarif(found: DataFrame, run: dict, path: Path) -> None:
    rules = [{"id": r["rule_id"], "name": r["rule_id"], "shortDescription": {"text": f"A value of the form {r['rule_id']}"}, "defaultConfiguration": {"level": r["level"]}} for r in rule_levels(found).orderBy(F.col("ord").asc_nulls_last()).collect()]  # one row per rule
    said = incomplete(run)
    invocation = {"executionSuccessful": said is None, "startTimeUtc": run.get("started_at"), "endTimeUtc": run.get("finished_at"), **({"toolExecutionNotifications": [{"level": said[0], "message": {"text": said[1]}}]} if said else {})}
    tool = {"driver": {"name": "sievewright", "version": run.get("scanner_version", ""), "rules": rules}}
    head = f'{{"$schema": "{SARIF}", "version": "2.1.0", "runs": [{{"tool": {json.dumps(tool)}, "invocations": [{json.dumps(invocation)}], "results": [\n'
    _joined(sarif_results(found), path, head, ",", "]}]}\n")


def write_defectdojo(found: DataFrame, run: dict, path: Path) -> None:
    rows = defectdojo_rows(found).withColumn("tags", F.split("tags", ","))
    _joined(rows.select(F.to_json(F.struct(*(c for c in rows.columns if c != "ord"))).alias("value"), "ord"), path, '{"findings": [\n', ",", "]}\n")


def _summary(found: DataFrame, run: dict) -> Iterator[str]:
    yield f"Scan {run.get('scan_id', '')}: {run['status']}, {run.get('issues_scanned', 0)} records, {run.get('comments_scanned', 0)} comments, {run.get('errors_total', 0)} errors"
    yield from (f"  {s}: {run.get(f'findings_{s}', 0)}" for s in LEVELS)
    shown = found.orderBy(F.col("ord").asc_nulls_last()).select("severity", "rule_id", *(C.terminal(F.col(c)).alias(c) for c in ("issue_key", "field_path", "redacted_secret", "snippet")))
    for r in shown.toLocalIterator():
        yield f"[{r['severity']}] {r['rule_id']} {r['issue_key']} {r['field_path']} {r['redacted_secret']}\n    {r['snippet']}"


def summary(found: DataFrame, run: dict) -> str:
    """A text for a terminal; what others wrote can't steer it."""
    return "\n".join(_summary(found, run)) + "\n"


def write_summary(found: DataFrame, run: dict, path: Path) -> None:
    with path.open("w", encoding="utf-8") as out:
        out.writelines(f"{line}\n" for line in _summary(found, run))


FORMATS: dict[str, tuple[str, Callable[[DataFrame, dict, Path], None]]] = {
    "json": ("json", write_json),
    "ndjson": ("ndjson", write_ndjson),
    "csv": ("csv", write_csv),
    "sarif": ("sarif", write_sarif),
    "defectdojo": ("defectdojo.json", write_defectdojo),
    "summary": ("txt", write_summary),
}


def formats(names: str) -> list[str]:
    """The formats of a comma-separated list in the order given, each once; ``all`` stands for all."""
    out: list[str] = []
    for name in (n.strip().lower() for n in names.split(",")):
        if name != "all" and name not in FORMATS:
            raise UnknownFormat(name or "blank")
        out.extend(n for n in (FORMATS if name == "all" else [name]) if n not in out)
    return out


def secure_join(base: Path, *parts: str) -> Path:
    """base with plain components below it; anything that could lead elsewhere is refused."""
    for part in parts:
        pieces = PurePosixPath(part).parts
        if len(pieces) != 1 or pieces[0] in ("..", ".", "/") or "\\" in part or "\0" in part:
            raise ValueError(f"not a plain path component: {part!r}")
    return base.joinpath(*parts)


def project_segment(query: str) -> str:
    """The folder of a nested report: the one project that a query names by ``=`` or ``in (...)``, ``_multi`` for several, ``_default`` for none.

    Only letters, digits, ``_`` and ``-`` of a name are kept, so that no query leads out of the report folder.
    """
    said = re.search(r"(?i)(?<![A-Za-z0-9])project(?![A-Za-z0-9])\s*(?:=(.*)|in(?![A-Za-z0-9])\s*\(+([^)]*))?", query, re.S)
    if not said or (said[1] is None and said[2] is None):
        return "_default"
    names = [re.match(r"[A-Za-z0-9_-]*", part.strip().lstrip('"'))[0] for part in ([said[1]] if said[1] is not None else said[2].split(","))]
    names = [name for name in names if name]
    return "_default" if not names else names[0] if len(names) == 1 else "_multi"


def report_path(base: str, extension: str, at: datetime, project: str | None = None) -> Path:
    """Flat by date and time, or below project and date."""
    day, time = at.strftime("%Y-%m-%d"), at.strftime("%H-%M-%S")
    path = secure_join(Path(base), project, day, f"{time}_report.{extension}") if project else secure_join(Path(base), f"{day}T{time}_report.{extension}")
    path.parent.mkdir(parents=True, exist_ok=True, mode=0o700)
    return path


def write_reports(found: DataFrame, run: dict, names: str, base: str, at: datetime, project: str | None = None) -> list[Path]:
    """Every format asked for; findings are evaluated once and read for each."""
    found = found.persist()
    try:
        out = []
        for name in formats(names):
            extension, write = FORMATS[name]
            out.append(report_path(base, extension, at, project))
            write(found, run, out[-1])
        return out
    finally:
        found.unpersist()


def metrics_json(run: dict) -> str:
    return json.dumps({"scan_id": run.get("scan_id"), "status": run["status"], "issues_scanned": run.get("issues_scanned", 0), "findings_total": run.get("findings_total", 0), "findings_by_severity": {s: run.get(f"findings_{s}", 0) for s in LEVELS}, "errors_total": run.get("errors_total", 0), "duration_secs": run.get("duration_secs", 0.0)}, indent=2)


def metrics_prometheus(run: dict) -> str:
    """Eight gauges; informational findings have none of their own."""
    label = f'{{scan_id="{run.get("scan_id", "")}"}}'
    names = [("issues_scanned", "issues_scanned"), ("findings_total", "findings_total"), *((f"findings_{s}", f"findings_{s}") for s in ("critical", "high", "medium", "low")), ("errors_total", "errors_total")]
    lines = [f"sievewright_{name}{label} {run.get(key, 0)}" for name, key in names]
    return "\n".join([*lines, f"sievewright_duration_seconds{label} {run.get('duration_secs', 0.0):.1f}"]) + "\n"
