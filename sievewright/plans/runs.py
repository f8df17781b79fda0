"""Named queries over whole runs: what was not read, counters, reports, metrics, alerts, allowlists, user rules and the streaming scan, and the SQL that each must equal."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scanner
from ..functions import columns as C
from ..functions import fixed
from ..operators import allowlist, store
from ..operators import findings as N
from ..operators import scan as S
from ..operators.rules import Rule, rule_set
from ..sinks import alerts, reports
from ..sources.stages import Stages
from ..sources.tables import table
from ..streaming import scan as stream
from .catalogue import BASE, ENTROPY_SQL, FINGERPRINT_SQL, HITS_SQL, NOW, customer_segments, found, segments

# ------------------------------------------------------------------ inputs


def threads_and_pages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, landed comments, landed bodies): a record for each conversation, with its first turn in the payload, and one for each page, with an attachment.

    Not all is at hand: a third of the pages is no JSON, another third lacks its body, and some conversations their last turn.
    """
    turns, pages = table(spark, sf, "conversations"), table(spark, sf, "pages")
    key, page = F.concat(F.lit("CONV-"), "conv_id").alias("issue_key"), F.concat(F.lit("PAGE-"), "page_id").alias("issue_key")
    ends = turns.groupBy("conv_id").agg(F.count("*").alias("total"), F.max("turn").alias("last"), F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("first"))
    thread = F.struct("total", F.lit(0).alias("startAt"), F.array(F.struct(F.col("first").alias("body"))).alias("comments"))
    file = F.struct(F.concat("page_id", F.lit(".txt")).alias("filename"), F.lit("text/plain").alias("mimeType"), F.lit(100).alias("size"), F.lit("/x").alias("content"))
    fields = F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(F.to_json(F.struct(F.col("html").alias("description"), F.array(file).alias("attachment"))))
    records = ends.select(key, F.to_json(F.struct(thread.alias("comment"))).alias("fields")).unionByName(pages.select(page, fields.alias("fields")))
    held = turns.join(ends.select("conv_id", "last"), "conv_id").where("turn > 0 AND NOT (conv_id % 5 = 2 AND turn = last)")
    return records, held.select(key, F.col("turn").alias("pos"), F.to_json(F.struct(F.col("text").alias("body"))).alias("comment")), pages.where("page_id % 3 = 1").select(page, F.lit(0).cast("long").alias("pos"), F.col("html").alias("text"))


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return N.merged(found(spark, sf))


#: The finding that stands for a secret and rule: the first by record and place.
FIRST_SQL = f"""{HITS_SQL},
f AS (SELECT *, row_number() OVER (PARTITION BY secret_hash, rule_id ORDER BY issue_key, coalesce(TRY_CAST(regexp_extract(field_path, '\\[([0-9]+)\\]', 1) AS BIGINT), 0)) AS n,
  count(DISTINCT (issue_key, field_path, source_type)) OVER (PARTITION BY secret_hash, rule_id) AS places FROM hits),
o AS (SELECT *, '{BASE}/browse/' || issue_key AS url FROM f WHERE n = 1)"""
_cell = lambda x: f"CASE WHEN regexp_matches({x}, '^\\s*[=+\\-@]') THEN '''' || {x} ELSE {x} END"

# ------------------------------------------------------------------ queries


def unread_parts(spark, sf):
    """What a run over conversations and pages could not read, record by record."""
    texts, _ = scanner.text_segments(scanner.Config(url=BASE, scan_attachments=True), *threads_and_pages(spark, sf))
    return texts.where("error IS NOT NULL").select("issue_key", "error")


def run_counters(spark, sf):
    """Status and counters of that run, from its record."""
    config = scanner.Config(url=BASE, auth="none", query="project in (CONV, PAGE)", scan_attachments=True, dry_run=True, store=f"{Stages(spark).root}/store")
    run = scanner.run(spark, config, *threads_and_pages(spark, sf), datetime.fromisoformat(NOW)).run
    names = ("errors_total", "issues_scanned", "issues_total", "comments_scanned", "attachments_scanned", "attachments_skipped", "attachments_failed", "attachment_bytes")
    return spark.createDataFrame([(run["status"], *(int(run[n]) for n in names))], ", ".join(["status string", *(f"{n} long" for n in names)]))


def report_json(spark, sf):
    """The JSON report's findings, read back from their text."""
    at = {"rule_id": "rule_id", "secret_hash": "secret_hash", "severity": "severity", "confidence": "confidence", "redacted_secret": "redacted_secret", "issue_key": "issue_key", "issue_url": "issue_url", "field_path": "field_path", "source_type": "source_type", "status": "status", "first_place": "locations[0].field_path", "username": "username"}
    value = reports.json_rows(merged(spark, sf)).select("value")
    return value.select(*(F.get_json_object("value", f"$.{path}").alias(name) for name, path in at.items()), F.json_array_length(F.get_json_object("value", "$.locations")).cast("long").alias("places"))


def report_sarif(spark, sf):
    """The SARIF report's results, read back from their text."""
    at = {"rule_id": "ruleId", "level": "level", "message": "message.text", "uri": "locations[0].physicalLocation.artifactLocation.uri", "field_path": "locations[0].physicalLocation.artifactLocation.properties.fieldPath", "tags": "properties.tags", "status": "properties.status"}
    return reports.sarif_results(merged(spark, sf)).select(*(F.get_json_object("value", f"$.{path}").alias(name) for name, path in at.items()))


def report_csv(spark, sf):
    """The columns of the table report but those of the snippet and the finding's own id."""
    return reports.csv_rows(merged(spark, sf)).drop("finding_id", "snippet")


def report_defectdojo(spark, sf):
    """The tracker import's fields beside the description."""
    return reports.defectdojo_rows(merged(spark, sf)).drop("description", "mitigation", "ord")


def metrics_lines(spark, sf):
    """Both forms of a run's metrics, as names and values."""
    run = {**N.tally(found(spark, sf)).first().asDict(), "scan_id": "s", "status": "success", "issues_scanned": segments(spark, sf).select("issue_key").distinct().count(), "errors_total": 0}
    rows = [("prometheus", line.split("{")[0].removeprefix("sievewright_"), float(line.split()[-1])) for line in reports.metrics_prometheus(run).splitlines()]
    told = json.loads(reports.metrics_json(run))
    rows += [("json", name, float(told[name])) for name in ("issues_scanned", "findings_total", "errors_total")] + [("json", f"findings_{s}", float(n)) for s, n in told["findings_by_severity"].items()]
    return spark.createDataFrame(rows, "form string, name string, value double")


def alert_lines(spark, sf):
    """What each channel is told, line by line."""
    ordered = merged(spark, sf).withColumn("ord", F.struct("secret_hash", "rule_id"))
    config = {"slack": {"webhook_url": "https://x.example"}, "teams": {"webhook_url": "https://x.example"}, "webhook": {"url": "https://x.example"}, "min_confidence": "High"}
    rows = []
    for channel, payload in alerts.payloads(ordered, {"status": "success"}, config):
        lines = {"slack": lambda p: p["text"].split("\n")[2:], "teams": lambda p: p["text"].split("  \n")[1:], "webhook": lambda p: [f"{r['rule_id']} {r['issue_key']} {r['redacted_secret']}" for r in p["findings"]]}[channel.name](payload)
        rows += [(channel.name, n, line) for n, line in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "channel string, n long, line string")


def _token(custkey: int) -> str:
    return f"ghp_{hashlib.sha256(str(custkey).encode()).hexdigest()[:36]}"


def allowlist_predicates(spark, sf):
    """Every predicate of an allowlist and its scope, the first that matches giving the reason."""
    entries = allowlist.compile_entries([
        {"rule_id": "gitlab_token", "field": "customfield_10001", "reason": "field"}, {"rule_id": "generic_password_assignment", "field": "customfield", "reason": "no such field"}, {"project_key": "PAGE", "reason": "project"}, {"issue_key": "CUST-5", "reason": "issue"},
        {"pattern": "^ghp_[0-4]", "reason": "pattern"}, {"value": _token(10), "reason": "value"}, {"sha256": f"SHA256:{hashlib.sha256(_token(15).encode()).hexdigest()}", "reason": "digest"}, {"rule_id": "aws_access_key_id"},
    ])
    every = S.scan(segments(spark, sf), allowlist=entries, drops=True).where("drop_reason IS NULL OR drop_reason LIKE 'allowlisted%'")
    return every.groupBy("rule_id", F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def user_rules(spark, sf):
    """Built-in rules overlaid by a user's: one replaced, one switched off, one new, and a least confidence."""
    own = [Rule.from_record(r) for r in (
        {"rule_id": "gitlab_token", "regex": r"\bglpat-[A-Za-z0-9_-]{20}\b", "severity": "LOW", "confidence": "High", "denylist": ["AB"], "unknown": 1}, {"rule_id": "github_token", "regex": "x", "enabled": False},
        {"rule_id": "customer_login", "regex": r"user=(Customer#[0-9]+)", "capture_group": 1, "min_digits": 9, "severity": "odd", "confidence": "medium"},
    )]
    every = S.scan(customer_segments(spark, sf), rule_set(own), floor="medium", drops=True).where("drop_reason IS NULL OR drop_reason IN ('denylist', 'min_confidence')")
    return every.groupBy("rule_id", "severity", F.coalesce("drop_reason", "confidence").alias("outcome")).agg(F.count("*").alias("n"))


def levels_and_queries(spark, sf):
    """Levels parsed as rule files and alerts do, and queries narrowed to a minute."""
    word = F.element_at(F.array(*map(F.lit, ("HIGH", "odd", "Low", "info", "Medium"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    at = F.timestamp_add("HOUR", F.col("n_nationkey"), F.lit(datetime(2026, 1, 2, 3, 4, 5)))
    query = C.normalize_query(F.concat(F.lit("  project  =\n "), "n_name", F.lit("\t")))
    return table(spark, sf, "nation").select("n_nationkey", C.parse_severity(word).alias("severity"), C.parse_confidence(word).alias("confidence"), C.parse_level(word, ("low", "high")).alias("level"), C.rank(C.parse_severity(word), fixed.SEVERITIES).cast("long").alias("rank"), query.alias("query"), C.narrow_query(query, at).alias("narrowed"))


def streaming_states(spark, sf):
    """All segments as a stream, a few files at a time; a record's segments come together and their texts are whole. The stored table that is left."""
    stages = Stages(spark)
    landed = f"{stages.root}/landed"
    segments(spark, sf, max_kb=None).repartition(6, "issue_key").write.parquet(landed)
    schema = "issue_key string, seg_ord long, field_path string, text string, source_type string"
    query = stream.run(stream.read_segments(spark, landed, schema, 2), f"{stages.root}/table", BASE, f"{stages.root}/checkpoint")
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return stream.stored(spark, f"{stages.root}/table").select("fingerprint", "issue_key", "rule_id", "status", "times_seen")


QUERIES = {f.__name__: f for f in (unread_parts, run_counters, report_json, report_sarif, report_csv, report_defectdojo, metrics_lines, alert_lines, allowlist_predicates, user_rules, levels_and_queries, streaming_states)}

_lost = """SELECT 'PAGE-' || page_id AS issue_key, CASE page_id % 3 WHEN 0 THEN 'record: no JSON' ELSE 'attachment: not at hand' END AS error FROM pages WHERE page_id % 3 <> 1
        UNION ALL SELECT 'CONV-' || conv_id, 'comments: 1 not at hand' FROM conversations WHERE conv_id % 5 = 2 GROUP BY conv_id HAVING count(*) > 1"""
_level = "CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END"
_severities = tuple(reversed(fixed.SEVERITIES))
ORACLES: dict[str, str] = {
    "unread_parts": _lost,
    "run_counters": f"""WITH e AS ({_lost}), c AS (SELECT count(DISTINCT conv_id) AS convs, count(*) AS turns FROM conversations), p AS (SELECT count(*) AS pages, count(*) FILTER (page_id % 3 = 1) AS read, count(*) FILTER (page_id % 3 = 2) AS lost FROM pages)
        SELECT CASE WHEN (SELECT count(*) FROM e) > 0 THEN 'partial' ELSE 'success' END AS status, (SELECT count(*) FROM e) AS errors_total, convs + pages AS issues_scanned, convs + pages AS issues_total,
        turns - (SELECT count(*) FROM e WHERE issue_key LIKE 'CONV%') AS comments_scanned, read AS attachments_scanned, 0::BIGINT AS attachments_skipped, lost AS attachments_failed, 100 * read AS attachment_bytes FROM c, p""",
    "report_json": f"""WITH {FIRST_SQL} SELECT rule_id, secret_hash, severity, confidence, redacted_secret, issue_key, url AS issue_url, field_path, source_type, 'new' AS status, field_path AS first_place, NULL::VARCHAR AS username, places FROM o""",
    "report_sarif": f"""WITH {FIRST_SQL} SELECT rule_id, {_level} AS level, rule_id || ': ' || redacted_secret AS message, url AS uri, field_path, '["' || source_type || '","new"]' AS tags, 'new' AS status FROM o""",
    "report_csv": f"""WITH {FIRST_SQL} SELECT issue_key, url AS issue_url, {_cell("field_path")} AS field_path, rule_id, severity, confidence, {_cell("redacted_secret")} AS redacted_secret, secret_hash, '2026-01-02T00:00:00Z' AS detected_at, source_type, 'new' AS status, '' AS first_seen, '' AS times_seen, '' AS external_validation FROM o""",
    "report_defectdojo": f"""WITH {FIRST_SQL} SELECT rule_id || ' in ' || issue_key AS title, upper(severity[1:1]) || severity[2:] AS severity, '2026-01-02T00:00:00Z' AS date, url AS "references", issue_key AS file_path, true AS active, false AS verified, false AS false_p, false AS duplicate, true AS static_finding,
        {FINGERPRINT_SQL} || '#0' AS unique_id_from_tool, 'secret-scanner,' || source_type || ',status:new' AS tags FROM o""",
    "metrics_lines": f"""WITH {HITS_SQL}, c AS (SELECT (SELECT count(DISTINCT issue_key) FROM seg) AS issues_scanned, count(*) AS findings_total, 0 AS errors_total, 0 AS duration_seconds, {", ".join(f"count(*) FILTER (severity = '{s}') AS findings_{s}" for s in _severities)} FROM hits),
        l AS (SELECT name, value::DOUBLE AS value FROM (UNPIVOT (SELECT columns(*)::DOUBLE FROM c) ON columns(*) INTO NAME name VALUE value))
        SELECT 'prometheus' AS form, name, value FROM l WHERE name <> 'findings_info' UNION ALL SELECT 'json', name, value FROM l WHERE name <> 'duration_seconds'""",
    "alert_lines": f"""WITH {FIRST_SQL}, v AS (SELECT severity, rule_id, url, issue_key, redacted_secret, row_number() OVER (ORDER BY secret_hash, rule_id) AS n, count(*) OVER () AS total FROM o WHERE confidence = 'high')
        SELECT 'slack' AS channel, n, severity || ': `' || rule_id || '` <' || url || '|' || issue_key || '>' AS line FROM v WHERE n <= 10 UNION ALL SELECT 'slack', n, '... and ' || (total - 10) || ' more' FROM v WHERE n = 11
        UNION ALL SELECT 'teams', n, '- ' || severity || ' `' || rule_id || '` [' || issue_key || '](' || url || ')' FROM v WHERE n <= 10 UNION ALL SELECT 'webhook', n, rule_id || ' ' || issue_key || ' ' || redacted_secret FROM v WHERE n <= 20""",
    "allowlist_predicates": f"""WITH {HITS_SQL} SELECT rule_id, CASE WHEN rule_id = 'gitlab_token' AND field_path = 'customfield_10001' THEN 'allowlisted: field' WHEN issue_key LIKE 'PAGE-%' THEN 'allowlisted: project' WHEN issue_key = 'CUST-5' THEN 'allowlisted: issue'
        WHEN regexp_matches(value, '^ghp_[0-4]') THEN 'allowlisted: pattern' WHEN value = 'ghp_' || sha256('10')[1:36] THEN 'allowlisted: value' WHEN value = 'ghp_' || sha256('15')[1:36] THEN 'allowlisted: digest' WHEN rule_id = 'aws_access_key_id' THEN 'allowlisted' ELSE 'kept' END AS reason, count(*) AS n FROM hits GROUP BY ALL""",
    "user_rules": f"""WITH {HITS_SQL}, u AS (SELECT rule_id, CASE rule_id WHEN 'gitlab_token' THEN 'low' ELSE severity END AS severity, CASE WHEN rule_id = 'gitlab_token' AND contains(lower(value), 'ab') THEN 'denylist' WHEN confidence = 'low' THEN 'min_confidence' ELSE confidence END AS outcome FROM hits WHERE source_type = 'customfield' AND rule_id <> 'github_token'
          UNION ALL SELECT 'customer_login', 'medium', CASE WHEN {ENTROPY_SQL} > 3.5 THEN 'high' ELSE 'medium' END FROM (SELECT c_name AS value FROM customer WHERE c_custkey % 5 = 1)) SELECT rule_id, severity, outcome, count(*) AS n FROM u GROUP BY ALL""",
    "levels_and_queries": """SELECT n_nationkey, CASE WHEN lower(w) IN ('info', 'low', 'medium', 'high', 'critical') THEN lower(w) ELSE 'medium' END AS severity, CASE WHEN lower(w) IN ('low', 'medium', 'high') THEN lower(w) ELSE 'low' END AS confidence, CASE WHEN lower(w) IN ('low', 'high') THEN lower(w) END AS level,
        [3, 2, 1, 0, 2][n_nationkey % 5 + 1]::BIGINT AS rank, 'project = ' || n_name AS query, '(project = ' || n_name || ') AND updated >= "' || strftime(TIMESTAMP '2026-01-02 03:04:05' + to_hours(n_nationkey), '%Y-%m-%d %H:%M') || '"' AS narrowed
        FROM (SELECT *, ['HIGH', 'odd', 'Low', 'info', 'Medium'][n_nationkey % 5 + 1] AS w FROM nation)""",
    "streaming_states": f"""WITH {HITS_SQL}, every AS (SELECT issue_key, field_path, rule_id, secret_hash FROM hits
          UNION ALL SELECT issue_key, field_path, 'credential_pair', 'sha256:' || sha256(unnest(regexp_extract_all(text, '\\b[a-z][a-z0-9+.-]*://([^:\\s/@]+):([^@\\s/]+)@', 2))) FROM seg
          UNION ALL SELECT 'CUST-' || c_custkey, 'customfield_10001', 'credential_pair', 'sha256:' || sha256(sha256(c_custkey::VARCHAR)[1:20]) FROM customer WHERE c_custkey % 5 = 1)
        SELECT {FINGERPRINT_SQL} AS fingerprint, issue_key, rule_id, CASE WHEN count(DISTINCT field_path) > 1 THEN 'recurring' ELSE 'new' END AS status, count(DISTINCT field_path)::INTEGER AS times_seen FROM every GROUP BY issue_key, rule_id, secret_hash""",
}
