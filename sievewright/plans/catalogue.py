"""Named queries over the fixture tables and the SQL that each must equal.

Every query reads its whole tables. Arrays and structs are given as text, as the comparison sorts rows by value.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..operators import findings as N
from ..operators import pairs as P
from ..operators import scan as S
from ..operators import segments as G
from .. import scanner
from ..operators import store
from ..operators.rules import BUILTIN, rule_set
from ..sinks import reports
from ..sources.stages import Stages
from ..sources.tables import table

BASE = "https://tracker.example"
NOW = "2026-01-02T00:00:00+00:00"
ASSIGNMENT = r"(?i)\b(password|passwd|pwd|secret|token|api[_-]?key)\b\s*[:=]\s*['\"]?([^\s<>{}'\"]{8,})['\"]?"

# ------------------------------------------------------------------ inputs


def token_text(customer: DataFrame) -> DataFrame:
    """Customers with a text that holds a token, a key or a pair, by key."""
    h = F.sha2(F.col("c_custkey").cast("string"), 256)
    left = lambda n: F.substring(h, 1, n)
    kind = F.col("c_custkey") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("note ghp_"), left(36), F.lit(" end")))
        .when(kind == 1, F.concat(F.lit("user="), F.col("c_name"), F.lit("\n"), F.lit("password="), left(20)))
        .when(kind == 2, F.concat(F.lit("glpat-"), left(20), F.lit(" x")))
        .when(kind == 3, F.concat(F.lit("key AKIA"), F.translate(F.upper(left(16)), "0189", "GHIJ")))
        .otherwise(F.concat(F.lit("postgres://svc:"), left(16), F.lit("@db.internal/app")))
    )
    return customer.select("c_custkey", text.alias("text"))


def segments(spark: SparkSession, sf: str, max_kb: int | None = 2048) -> DataFrame:
    """Documents, conversations, pages and token texts as segments."""
    one = G.raw_segment(table(spark, sf, "documents"), F.concat(F.lit("DOC-"), "doc_id"), F.lit("description"), F.col("text"), max_kb=max_kb)
    two = G.raw_segment(table(spark, sf, "conversations"), F.concat(F.lit("CONV-"), "conv_id"), F.concat(F.lit("comment.comments["), "turn", F.lit("].body")), F.col("text"), order=F.col("turn"), max_kb=max_kb)
    three = G.raw_segment(table(spark, sf, "pages"), F.concat(F.lit("PAGE-"), "page_id"), F.concat(F.lit("attachment["), "page_id", F.lit(".html]")), F.col("html"), max_kb=max_kb)
    four = G.raw_segment(token_text(table(spark, sf, "customer")), F.concat(F.lit("CUST-"), "c_custkey"), F.lit("customfield_10001"), F.col("text"), max_kb=max_kb)
    return one.unionByName(two).unionByName(three).unionByName(four)


TOKENS_SQL = """
tokens AS (SELECT c_custkey, CASE c_custkey % 5
  WHEN 0 THEN 'note ghp_' || h[1:36] || ' end'
  WHEN 1 THEN 'user=' || c_name || chr(10) || 'password=' || h[1:20]
  WHEN 2 THEN 'glpat-' || h[1:20] || ' x'
  WHEN 3 THEN 'key AKIA' || translate(upper(h[1:16]), '0189', 'GHIJ')
  ELSE 'postgres://svc:' || h[1:16] || '@db.internal/app' END AS text
  FROM (SELECT *, sha256(c_custkey::VARCHAR) AS h FROM customer))"""
SEGMENTS_SQL = f"""{TOKENS_SQL},
seg AS (SELECT 'DOC-' || doc_id AS issue_key, 'description' AS field_path, text, 'description' AS source_type FROM documents
  UNION ALL SELECT 'CONV-' || conv_id, 'comment.comments[' || turn || '].body', text, 'comment' FROM conversations
  UNION ALL SELECT 'PAGE-' || page_id, 'attachment[' || page_id || '.html]', html, 'attachment' FROM pages
  UNION ALL SELECT 'CUST-' || c_custkey, 'customfield_10001', text, 'customfield' FROM tokens)"""


def _sql_regex(rule_id: str) -> tuple[str, int]:
    rule = next(r for r in BUILTIN if r.rule_id == rule_id)
    return (ASSIGNMENT if rule_id == "generic_password_assignment" else rule.regex).replace("'", "''"), rule.capture_group


#: Rules that the fixtures hold matches of.
PRESENT = ("aws_access_key_id", "github_token", "gitlab_token", "db_url_credentials", "generic_password_assignment")
_words = "|".join(fixed.PLACEHOLDERS_CONTAINED)
_raw = "\n  UNION ALL ".join(
    f"SELECT issue_key, field_path, source_type, '{r}' AS rule_id, '{next(b for b in BUILTIN if b.rule_id == r).severity}' AS severity, '{next(b for b in BUILTIN if b.rule_id == r).confidence}' AS base, text, unnest(regexp_extract_all(text, '{_sql_regex(r)[0]}', {_sql_regex(r)[1]})) AS value FROM seg" for r in PRESENT
)
ENTROPY_SQL = "(SELECT -sum(n / length(value) * log2(n / length(value))) FROM (SELECT count(*)::DOUBLE AS n FROM (SELECT unnest(string_split(value, '')) AS c) GROUP BY c))"
#: Matches of the four rules whose drops are counted, whatever becomes of them.
_dropped = " UNION ALL ".join(f"SELECT '{r}' AS rule_id, text, unnest(regexp_extract_all(text, '{_sql_regex(r)[0]}', {_sql_regex(r)[1]})) AS value FROM seg" for r in ("aws_secret_access_key", "aws_access_key_id", "github_token", "gitlab_token"))


def _hits_sql(seg: str) -> str:
    """Hits that pass their rules, scored. Matches of assignments hold a context word themselves; other texts lie within the window."""
    return f"""{seg},
raw AS ({_raw}),
scored AS (SELECT *, {ENTROPY_SQL} AS h, rule_id = 'generic_password_assignment' OR regexp_matches(lower(text), '{"|".join(fixed.CONTEXT_WORDS)}') AS ctx FROM raw),
hits AS (SELECT issue_key, field_path, source_type, rule_id, severity,
  CASE WHEN base = 'high' THEN CASE WHEN ctx OR h > 3.5 THEN 'high' ELSE 'medium' END
       ELSE CASE WHEN ctx AND h > 3.5 THEN 'high' WHEN ctx OR h > 3.5 THEN 'medium' ELSE 'low' END END AS confidence,
  'sha256:' || sha256(value) AS secret_hash, value[1:2] || '...' || value[-2:] AS redacted_secret, value, text
  FROM scored WHERE NOT regexp_matches(lower(value), '{_words}')
    AND (rule_id <> 'generic_password_assignment' OR (h >= 2 AND regexp_matches(value, '[0-9]')))
    AND (rule_id <> 'aws_access_key_id' OR regexp_matches(value, '^.{{4}}[A-Z2-7]{{16}}$')))"""


HITS_SQL = _hits_sql(SEGMENTS_SQL)
E2E_SQL = f"""{TOKENS_SQL.lstrip()}, cust AS (SELECT 'CUST-' || c_custkey AS issue_key, c_custkey AS c, c_name AS name, sha256(c_custkey::VARCHAR) AS h FROM customer),
seg AS (SELECT 'CUST-' || c_custkey AS issue_key, 'description' AS field_path, text, 'description' AS source_type FROM tokens
  UNION ALL SELECT issue_key, 'comment.comments[1].body', 'glpat-' || h[21:40] || ' x', 'comment' FROM cust WHERE c % 3 = 0
  UNION ALL SELECT issue_key, 'attachment[' || c || '.env]', 'user=' || name || chr(10) || 'password=' || h[41:60], 'attachment' FROM cust WHERE c % 7 = 0)"""
FINGERPRINT_SQL = "'fp:' || sha256(secret_hash || chr(31) || rule_id || chr(31) || issue_key)"


def hits(spark: SparkSession, sf: str) -> DataFrame:
    return S.scan(segments(spark, sf), spread=True)


def found(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of rules alone, with a fixed time."""
    return N.findings(hits(spark, sf), spark.createDataFrame([], S.FINDINGS), BASE, F.to_timestamp(F.lit(NOW)))


def customer_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The token texts of all customers alone."""
    return G.raw_segment(token_text(table(spark, sf, "customer")), F.concat(F.lit("CUST-"), "c_custkey"), F.lit("customfield_10001"), F.col("text"))


# ------------------------------------------------------------------ queries


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets over all segments: rule, preview, and in how many records each is found."""
    return hits(spark, sf).groupBy("rule_id", "severity", "secret_hash", "redacted_secret").agg(F.countDistinct("issue_key").alias("issues"), F.count("*").alias("hits"))


def segments_union(spark, sf):
    return segments(spark, sf).select("issue_key", "field_path", "source_type", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha"))


def segment_truncate(spark, sf):
    text = C.truncate_bytes(F.col("text"), 1000)
    return table(spark, sf, "documents").select("doc_id", F.octet_length(text).alias("n_bytes"), F.startswith(F.col("text"), text).alias("is_prefix"), (F.octet_length("text") - F.octet_length(text) > 0).alias("was_cut"))


def json_leaf_walk(spark, sf):
    nation = table(spark, sf, "nation").alias("n").join(table(spark, sf, "region").alias("r"), F.col("n.n_regionkey") == F.col("r.r_regionkey"))
    fields = F.to_json(F.struct(F.col("n.n_name").alias("name"), F.col("n.n_nationkey").alias("id"), F.struct(F.array(F.col("r.r_name"), F.col("n.n_name")).alias("list"), F.lit("").alias("blank")).alias("area")))
    return G.walk(nation.select(F.concat(F.lit("NAT-"), "n.n_nationkey").alias("issue_key"), fields.alias("fields"))).select("issue_key", "seg_ord", "field_path", "text", "source_type")


def rule_generic_password(spark, sf):
    rules = [r for r in rule_set() if r.rule_id == "generic_password_assignment"]
    return S.scan(segments(spark, sf), rules).select("issue_key", "severity", "confidence", "secret_hash", "redacted_secret")


def rule_aws_secret_context(spark, sf):
    rules = [r for r in rule_set() if r.rule_id == "aws_secret_access_key"]
    docs = table(spark, sf, "documents").where(F.col("text").rlike("\\b[A-Za-z0-9/+]{40}\\b"))
    keys = F.regexp_extract_all("text", F.lit("\\b[A-Za-z0-9/+]{40}\\b"), F.lit(0))
    with_key = docs.select("doc_id", F.explode(keys).alias("key")).select("doc_id", F.concat(F.lit("aws_secret = "), "key").alias("text"))
    return S.scan(G.raw_segment(with_key, F.concat(F.lit("DOC-"), "doc_id"), F.lit("description"), F.col("text")), rules).select("issue_key", "rule_id", "confidence", "secret_hash")


def rule_scan_all(spark, sf):
    return hits(spark, sf).select("issue_key", "field_path", "source_type", "rule_id", "severity", "confidence", "secret_hash", "redacted_secret")


def drop_reasons(spark, sf):
    """The first filter that each 40-character word of the token texts and documents fails."""
    rules = [r for r in rule_set() if r.rule_id in ("aws_secret_access_key", "aws_access_key_id", "github_token", "gitlab_token")]
    every = [type(r)(**{**{f: getattr(r, f) for f in r.__dataclass_fields__}, "hint": ""}) for r in rules]
    out = S.scan(segments(spark, sf), every, drops=True).groupBy("rule_id", F.coalesce("drop_reason", F.lit("kept")).alias("reason"))
    return out.agg(F.count("*").alias("n"))


def confidence_adjust(spark, sf):
    """The whole truth table of confidence over rows of lineitem."""
    rows = table(spark, sf, "lineitem")
    base = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("l_orderkey") % 3 + 1).cast("int"))
    got = C.adjust_confidence(base, F.col("l_partkey") % 2 == 0, F.col("l_suppkey") % 2 == 0, F.col("l_linenumber") == 7)
    return rows.groupBy(base.alias("base"), got.alias("confidence")).agg(F.count("*").alias("n"))


def entropy_by_value(spark, sf):
    return token_text(table(spark, sf, "customer")).select("c_custkey", F.round(C.shannon(F.col("text")), 6).alias("entropy"))


def secret_hash_fingerprint(spark, sf):
    one = hits(spark, sf)
    return one.select("issue_key", "rule_id", "secret_hash", C.fingerprint(F.col("secret_hash"), F.col("rule_id"), F.col("issue_key")).alias("fingerprint"), C.merge_key(F.col("secret_hash"), F.col("rule_id")).alias("merge_key"))


def redact_preview(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", C.redact(F.col("c_name")).alias("name"), C.redact(F.col("c_mktsegment").substr(1, 7)).alias("segment"))


def snippet_masked(spark, sf):
    rows = S.scan(customer_segments(spark, sf))
    return rows.select("issue_key", "rule_id", "snippet", "match_start", "match_end")


def pairs_url(spark, sf):
    return P.url_pairs(segments(spark, sf)).select("issue_key", "username", "password_hash", "redacted_password")


def pairs_proximity(spark, sf):
    return P.detect(segments(spark, sf)).where(F.col("rule_ord") == P.FORMS.index("proximity")).select("issue_key", "username", F.col("secret_hash").alias("password_hash"))


def pairs_json(spark, sf):
    rows = table(spark, sf, "customer")
    h = F.sha2(F.col("c_custkey").cast("string"), 256)
    text = F.to_json(F.struct(F.col("c_name").alias("user"), F.substring(h, 1, 20).alias("password"), F.substring(h, 1, 20).alias("pass"), F.col("c_name").alias("username")))
    return P.detect(G.raw_segment(rows, F.concat(F.lit("CUST-"), "c_custkey"), F.lit("description"), text)).select("issue_key", "username", F.col("secret_hash").alias("password_hash"))


def proximity_band_join(spark, sf):
    left = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("l_line"), (F.col("l_partkey") * 7).alias("l_at"))
    right = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("r_line"), (F.col("l_partkey") * 7).alias("r_at"))
    near = P.band_join(left, right, "l_orderkey", "l_at", "r_at", fixed.PAIR_DISTANCE).where("l_line < r_line")
    return near.select("l_orderkey", "l_line", "r_line", F.abs(F.col("l_at") - F.col("r_at")).alias("distance"))


def allowlist_anti(spark, sf):
    entries = spark.createDataFrame([(1, "project", "CUST"), (2, "rule", "gitlab_token")], "position int, kind string, value string")
    one = hits(spark, sf)
    meets = ((F.col("kind") == "project") & (C.project_key(F.col("issue_key")) == F.col("value")) & (F.col("rule_id") == "github_token")) | ((F.col("kind") == "rule") & (F.col("rule_id") == F.col("value")))
    return one.join(F.broadcast(entries), meets, "left_anti").groupBy("rule_id").agg(F.count("*").alias("n"))


def findings_cap(spark, sf):
    grouped = hits(spark, sf).withColumn("issue_key", F.concat(F.lit("P-"), F.substring("secret_hash", 8, 1))).withColumn("seg_ord", F.conv(F.substring("secret_hash", 8, 15), 16, 10).cast("long"))
    return N.capped(grouped, 5).select("issue_key", "rule_id", "secret_hash")


def dedup_merge(spark, sf):
    one = N.merged(found(spark, sf))
    return one.select("secret_hash", "rule_id", F.array_join(F.array_sort(F.transform("locations", lambda p: F.concat_ws("|", p["issue_key"], p["field_path"], p["source_type"]))), ",").alias("places"), F.size("locations").cast("long").alias("n_places"))


def severity_tally(spark, sf):
    return N.tally(found(spark, sf))


def comments_counter(spark, sf):
    return N.comments_scanned(segments(spark, sf))


def attachment_gate(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.attachment_verdict(F.concat(F.regexp_extract("url", "[^/]*$", 0), F.element_at(F.array(*map(F.lit, (".env", ".zip", "", ".JSON", ".unknown"))), (F.col("page_id") % 5 + 1).cast("int"))), F.lit(None).cast("string")).alias("verdict"))


def attachment_budget(spark, sf):
    rows = table(spark, sf, "pages").select(F.concat(F.lit("HOST-"), F.col("page_id") % 7).alias("issue_key"), F.col("page_id").alias("pos"), F.concat("page_id", F.lit(".log")).alias("name"), F.lit("text/plain").alias("mime"), F.octet_length("html").cast("long").alias("size"), F.lit("/x").alias("url"), F.lit(BASE).alias("base"))
    return G.budgeted(rows, 8192, 20, 40_000).select("issue_key", "pos", "outcome")


def same_origin(spark, sf):
    rows = table(spark, sf, "pages")
    return rows.select("page_id", C.origin(F.col("url")).alias("origin"), C.same_origin(F.col("url"), F.lit("https://thther.example.org")).alias("same"))


def incremental_window(spark, sf):
    start = F.lit("2024-01-10 11:55:00").cast("timestamp")
    return table(spark, sf, "events").where(F.col("ts") >= start).groupBy("event_type").agg(F.count("*").alias("n"))


def _scans(spark, sf):
    """Two scans of all segments: all but the issues of mod 1, then all but those of mod 2; keys of mod 3 aren't scanned again. Hits and the first scan's table are written once."""
    stages, mod = Stages(spark), F.regexp_extract("issue_key", "([0-9]+)$", 1).cast("long") % 5
    one = stages.keep(found(spark, sf), "hits")
    keys = segments(spark, sf).select("issue_key").distinct()
    live, empty = spark.createDataFrame([], store.LIVE), spark.createDataFrame([], store.STORED)
    table1, _ = store.reconcile(N.merged(one.where(mod != 1)), empty, keys, live, "scan-1", "2026-01-01T00:00:00+00:00")
    stored, again = stages.keep(table1, "stored"), keys.where(mod != 3)
    current = stages.keep(N.merged(one.where(~mod.isin(2, 3))), "current")
    return current, stored, again, live, stages.keep(store.matched(current, stored, again), "matched")


def reconcile_states(spark, sf):
    current, stored, keys, live, both = _scans(spark, sf)
    after, _ = store.reconcile(current, stored, keys, live, "scan-2", NOW, both)
    return after.select("fingerprint", "issue_key", "status", "first_seen", "last_seen", "times_seen", "closed_at")


def reconcile_report(spark, sf):
    current, stored, keys, live, both = _scans(spark, sf)
    _, report = store.reconcile(current, stored, keys, live, "scan-2", NOW, both)
    return report.groupBy("status", "rule_id").agg(F.count("*").alias("n"), F.sum("times_seen").cast("long").alias("times"))


def live_validation(spark, sf):
    current, stored, keys, _, both = _scans(spark, sf)
    labels = table(spark, sf, "labels").groupBy((F.col("doc_id") % 1000).alias("k")).agg(F.max("toxic").alias("toxic"))
    h = token_text(table(spark, sf, "customer")).where("c_custkey % 5 = 0")
    live = h.join(labels, F.col("c_custkey") == F.col("k")).select(C.secret_hash(F.substring("text", 6, 40)).alias("secret_hash"), (F.col("toxic") == 0).alias("valid"), F.lit("labels").alias("source"), F.lit(NOW).alias("checked_at"))
    _, report = store.reconcile(current, stored, keys, live, "scan-2", NOW, both)
    return report.where("status <> 'closed'").groupBy("rule_id", "severity", "confidence", F.coalesce("external_validation.valid", F.lit(False)).alias("valid")).agg(F.count("*").alias("n"))


def sarif_rule_levels(spark, sf):
    return N.rule_levels(N.merged(found(spark, sf))).select("rule_id", "level")


def csv_sanitize(spark, sf):
    text = F.concat(F.element_at(F.array(F.lit("=1+1 "), F.lit(" @x "), F.lit("\x1b[31mred\x1b[0m "), F.lit("plain ")), (F.col("c_custkey") % 4 + 1).cast("int")), F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", C.csv_field(text).alias("cell"))


def defectdojo_rows(spark, sf):
    return reports.defectdojo_rows(N.merged(found(spark, sf))).select("title", "severity", "active", "verified", "unique_id_from_tool", "tags")


def alert_topn(spark, sf):
    ordered = N.merged(found(spark, sf)).withColumn("ord", F.struct("secret_hash", "rule_id"))
    return N.visible(ordered, "high", 10).select("secret_hash", "rule_id", "confidence")


def scan_run_e2e(spark, sf):
    """A whole run over records with payload, later comments and attachments, rules and pairs, merged and reconciled with an empty store."""
    h, rows = F.sha2(F.col("c_custkey").cast("string"), 256), token_text(table(spark, sf, "customer")).join(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey")
    key, name = F.concat(F.lit("CUST-"), "c_custkey").alias("issue_key"), F.concat("c_custkey", F.lit(".env"))
    comment = F.struct(F.lit(2).alias("total"), F.lit(0).alias("startAt"), F.array(F.struct(F.concat(F.lit("see "), "c_name").alias("body"))).alias("comments"))
    listed = F.array(F.struct(name.alias("filename"), F.lit("text/plain").alias("mimeType"), F.lit(100).alias("size"), F.lit("/x").alias("content")), F.struct(F.lit("a.zip").alias("filename"), F.lit("").alias("mimeType"), F.lit(1).alias("size"), F.lit("/y").alias("content")))
    records = rows.select(key, F.to_json(F.struct(F.col("text").alias("description"), comment.alias("comment"), listed.alias("attachment"))).alias("fields"))
    later = rows.where("c_custkey % 3 = 0").select(key, F.lit(1).cast("long").alias("pos"), F.to_json(F.struct(F.concat(F.lit("glpat-"), F.substring(h, 21, 20), F.lit(" x")).alias("body"))).alias("comment"))
    bodies = rows.where("c_custkey % 7 = 0").select(key, F.lit(0).cast("long").alias("pos"), F.concat(F.lit("user="), "c_name", F.lit("\npassword="), F.substring(h, 41, 20)).alias("text"))
    config = scanner.Config(url=BASE, auth="none", query="project = CUST", scan_attachments=True, dry_run=True, store=f"{Stages(spark).root}/store")
    done = scanner.run(spark, config, records, later, bodies, datetime.fromisoformat(NOW))
    return done.findings.select("rule_id", "secret_hash", "severity", "confidence", "status", "issue_key", "field_path", "source_type", "username", "times_seen", F.size("references").cast("long").alias("n_references"))


def github_checksum(spark, sf):
    """Tokens made with a right and with a wrong checksum."""
    body = F.substring(F.sha2(F.col("c_custkey").cast("string"), 256), 1, 30)
    digits = [F.substring(F.lit(fixed.BASE62), (F.floor(F.crc32(F.encode(body, "UTF-8")) / F.lit(62**k)) % 62 + 1).cast("int"), F.lit(1)) for k in range(5, -1, -1)]
    token = F.concat(F.lit("ghp_"), body, F.when(F.col("c_custkey") % 2 == 0, F.concat(*digits)).otherwise(F.lit("000000")))
    return table(spark, sf, "customer").select("c_custkey", C.github_checksum_ok(token).alias("ok"))


QUERIES = {f.__name__: f for f in (flagship, segments_union, segment_truncate, json_leaf_walk, rule_generic_password, rule_aws_secret_context, rule_scan_all, drop_reasons, confidence_adjust, entropy_by_value, secret_hash_fingerprint, redact_preview, snippet_masked, pairs_url, pairs_proximity, pairs_json, proximity_band_join, allowlist_anti, findings_cap, dedup_merge, severity_tally, comments_counter, attachment_gate, attachment_budget, same_origin, incremental_window, reconcile_states, reconcile_report, live_validation, sarif_rule_levels, csv_sanitize, defectdojo_rows, alert_topn, github_checksum, scan_run_e2e)}

_state = f"""{HITS_SQL},
f AS (SELECT issue_key, rule_id, secret_hash, regexp_extract(issue_key, '([0-9]+)$', 1)::BIGINT % 5 AS m, {FINGERPRINT_SQL} AS fingerprint, count(DISTINCT field_path) AS k FROM hits GROUP BY ALL)"""
_first, _then = "2026-01-01T00:00:00+00:00", NOW
ORACLES: dict[str, str] = {
    "flagship": f"WITH {HITS_SQL} SELECT rule_id, severity, secret_hash, redacted_secret, count(DISTINCT issue_key) AS issues, count(*) AS hits FROM hits GROUP BY ALL",
    "segments_union": f"WITH {SEGMENTS_SQL} SELECT issue_key, field_path, source_type, sha256(coalesce(text, '')) AS text_sha FROM seg",
    "segment_truncate": """SELECT doc_id, strlen(t)::INTEGER AS n_bytes, starts_with(text, t) AS is_prefix, strlen(text) > strlen(t) AS was_cut FROM (
        SELECT doc_id, text, CASE WHEN strlen(text) <= 1000 THEN text ELSE (SELECT max(text[1:k]) FROM (SELECT unnest(range(240, 1001)) AS k) WHERE strlen(text[1:k]) <= 1000) END AS t FROM documents)""",
    "json_leaf_walk": """SELECT 'NAT-' || n_nationkey AS issue_key, o::BIGINT AS seg_ord, p AS field_path, t AS text, 'customfield' AS source_type FROM (
        SELECT n_nationkey, unnest([0, 1, 2, 3]) AS o, unnest(['area.blank', 'area.list[0]', 'area.list[1]', 'name']) AS p, unnest(['', r_name, n_name, n_name]) AS t FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    "rule_generic_password": f"WITH {HITS_SQL} SELECT issue_key, severity, confidence, secret_hash, redacted_secret FROM hits WHERE rule_id = 'generic_password_assignment'",
    "rule_aws_secret_context": f"""SELECT 'DOC-' || doc_id AS issue_key, 'aws_secret_access_key' AS rule_id, 'high' AS confidence, 'sha256:' || sha256(value) AS secret_hash FROM (
        SELECT doc_id, unnest(regexp_extract_all(text, '\\b[A-Za-z0-9/+]{{40}}\\b')) AS value FROM documents) WHERE {ENTROPY_SQL} >= 3 AND length(regexp_replace(value, '[^0-9]', '', 'g')) >= 3 AND NOT regexp_matches(lower(value), '{_words}')""",
    "rule_scan_all": f"WITH {HITS_SQL} SELECT issue_key, field_path, source_type, rule_id, severity, confidence, secret_hash, redacted_secret FROM hits",
    "confidence_adjust": """SELECT base, CASE WHEN p OR base = 'low' THEN 'low' WHEN base = 'high' THEN CASE WHEN a OR b THEN 'high' ELSE 'medium' END
        ELSE CASE WHEN a AND b THEN 'high' WHEN a OR b THEN 'medium' ELSE 'low' END END AS confidence, count(*) AS n
        FROM (SELECT ['low', 'medium', 'high'][l_orderkey % 3 + 1] AS base, l_partkey % 2 = 0 AS a, l_suppkey % 2 = 0 AS b, l_linenumber = 7 AS p FROM lineitem) GROUP BY ALL""",
    "entropy_by_value": f"WITH {TOKENS_SQL} SELECT c_custkey, round({ENTROPY_SQL.replace('value', 'text')}, 6) AS entropy FROM tokens",
    "secret_hash_fingerprint": f"WITH {HITS_SQL} SELECT issue_key, rule_id, secret_hash, {FINGERPRINT_SQL} AS fingerprint, secret_hash || ':' || rule_id AS merge_key FROM hits",
    "redact_preview": "SELECT c_custkey, CASE WHEN length(c_name) < 8 THEN '[REDACTED]' ELSE c_name[1:2] || '...' || c_name[-2:] END AS name, '[REDACTED]' AS segment FROM customer",
    "snippet_masked": f"""WITH {HITS_SQL} SELECT issue_key, rule_id, replace(text, value, '[REDACTED:' || rule_id || ']') AS snippet, (CASE WHEN rule_id = 'generic_password_assignment' THEN strpos(text, 'password=') ELSE strpos(text, value) END - 1)::INTEGER AS match_start, (strpos(text, value) - 1 + strlen(value))::INTEGER AS match_end FROM hits WHERE source_type = 'customfield'""",
    "pairs_url": f"WITH {SEGMENTS_SQL} SELECT issue_key, 'svc' AS username, 'sha256:' || sha256(p) AS password_hash, p[1:2] || '...' || p[-2:] AS redacted_password FROM (SELECT issue_key, unnest(regexp_extract_all(text, '\\b[a-z][a-z0-9+.-]*://([^:\\s/@]+):([^@\\s/]+)@', 2)) AS p FROM seg)",
    "pairs_proximity": f"WITH {TOKENS_SQL} SELECT 'CUST-' || c_custkey AS issue_key, c_name AS username, 'sha256:' || sha256(sha256(c_custkey::VARCHAR)[1:20]) AS password_hash FROM customer WHERE c_custkey % 5 = 1",
    "pairs_json": "SELECT 'CUST-' || c_custkey AS issue_key, c_name AS username, 'sha256:' || sha256(sha256(c_custkey::VARCHAR)[1:20]) AS password_hash FROM customer",
    "proximity_band_join": "SELECT a.l_orderkey, a.l_linenumber AS l_line, b.l_linenumber AS r_line, abs(a.l_partkey * 7 - b.l_partkey * 7) AS distance FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND abs(a.l_partkey * 7 - b.l_partkey * 7) <= 200",
    "allowlist_anti": f"WITH {HITS_SQL} SELECT rule_id, count(*) AS n FROM hits WHERE NOT (rule_id = 'gitlab_token' OR (rule_id = 'github_token' AND split_part(issue_key, '-', 1) = 'CUST')) GROUP BY rule_id",
    "dedup_merge": f"WITH {HITS_SQL} SELECT secret_hash, rule_id, string_agg(DISTINCT p, ',' ORDER BY p) AS places, count(DISTINCT p) AS n_places FROM (SELECT *, issue_key || '|' || field_path || '|' || source_type AS p FROM hits) GROUP BY ALL",
    "severity_tally": f"WITH {HITS_SQL} SELECT count(*) AS findings_total, {', '.join(f"count(*) FILTER (severity = '{s}') AS findings_{s}" for s in reversed(fixed.SEVERITIES))} FROM hits",
    "comments_counter": "SELECT count(DISTINCT (conv_id, turn)) AS comments_scanned FROM conversations",
    "attachment_gate": "SELECT page_id, ['keep', 'skip', 'skip', 'keep', 'skip'][page_id % 5 + 1] AS verdict FROM pages",
    "same_origin": "SELECT page_id, regexp_extract(url, '^(https?)://', 1) || '://' || regexp_extract(url, '://([^/]+)', 1) || CASE WHEN starts_with(url, 'https') THEN ':443' ELSE ':80' END AS origin, starts_with(url, 'https://thther.example.org/') AS same FROM pages",
    "incremental_window": "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10 11:55:00' GROUP BY ALL",
    "reconcile_states": f"""WITH {_state} SELECT fingerprint, issue_key,
        CASE WHEN m = 2 THEN 'closed' WHEN m IN (0, 4) OR k > 1 THEN 'recurring' ELSE 'new' END AS status, CASE m WHEN 1 THEN '{_then}' ELSE '{_first}' END AS first_seen, CASE m WHEN 3 THEN '{_first}' ELSE '{_then}' END AS last_seen,
        (CASE WHEN m IN (0, 4) THEN 2 * k ELSE k END)::INTEGER AS times_seen, CASE m WHEN 2 THEN '{_then}' END AS closed_at FROM f""",
    "reconcile_report": f"""WITH {_state}, merged AS (SELECT rule_id, CASE WHEN bool_or(m <> 1) THEN 'recurring' ELSE 'new' END AS status, sum(CASE WHEN m = 1 THEN k ELSE k * (k + 1) END) AS times FROM f WHERE m NOT IN (2, 3) GROUP BY secret_hash, rule_id),
        told AS (SELECT status, rule_id, times FROM merged UNION ALL SELECT 'closed', rule_id, k FROM f WHERE m = 2) SELECT status, rule_id, count(*) AS n, sum(times)::BIGINT AS times FROM told GROUP BY ALL""",
    "live_validation": f"""WITH {_state}, l AS (SELECT doc_id % 1000 AS k, max(toxic) = 0 AS valid FROM labels GROUP BY 1),
        g AS (SELECT secret_hash, hits.rule_id, any_value(severity) AS severity, any_value(confidence) AS confidence FROM hits JOIN f USING (issue_key, rule_id, secret_hash) WHERE m IN (0, 1, 4) GROUP BY ALL),
        v AS (SELECT 'sha256:' || sha256(text[6:45]) AS secret_hash, l.valid FROM tokens JOIN l ON c_custkey = l.k WHERE c_custkey % 5 = 0), w AS (SELECT g.*, coalesce(valid, false) AS ok FROM g LEFT JOIN v USING (secret_hash))
        SELECT rule_id, CASE WHEN ok THEN 'critical' ELSE severity END AS severity, CASE WHEN ok THEN 'high' ELSE confidence END AS confidence, ok AS valid, count(*) AS n FROM w GROUP BY ALL""",
    "sarif_rule_levels": f"WITH {HITS_SQL} SELECT rule_id, CASE WHEN bool_or(severity IN ('critical', 'high')) THEN 'error' WHEN bool_or(severity = 'medium') THEN 'warning' ELSE 'note' END AS level FROM hits GROUP BY rule_id",
    "csv_sanitize": "SELECT c_custkey, ['''=1+1 ', ''' @x ', 'red ', 'plain '][c_custkey % 4 + 1] || c_name AS cell FROM customer",
    "alert_topn": f"WITH {HITS_SQL} SELECT secret_hash, rule_id, max(confidence) AS confidence FROM hits WHERE confidence = 'high' GROUP BY ALL ORDER BY secret_hash, rule_id LIMIT 10",
    "defectdojo_rows": f"""WITH {HITS_SQL}, o AS (SELECT *, min(issue_key) OVER (PARTITION BY secret_hash, rule_id) AS k FROM hits)
        SELECT DISTINCT rule_id || ' in ' || k AS title, upper(severity[1:1]) || severity[2:] AS severity, true AS active, false AS verified, 'fp:' || sha256(secret_hash || chr(31) || rule_id || chr(31) || k) || '#0' AS unique_id_from_tool, 'secret-scanner,' || source_type || ',status:new' AS tags FROM o WHERE issue_key = k""",
    "drop_reasons": f"""WITH {SEGMENTS_SQL}, m AS ({_dropped}),
        r AS (SELECT rule_id, CASE WHEN rule_id = 'aws_secret_access_key' AND {ENTROPY_SQL} < 3 THEN 'min_entropy' WHEN regexp_matches(lower(value), '{_words}') THEN 'placeholder'
          WHEN rule_id = 'aws_secret_access_key' AND length(regexp_replace(value, '[^0-9]', '', 'g')) < 3 THEN 'min_digits'
          WHEN rule_id = 'aws_secret_access_key' AND NOT regexp_matches(lower(text), 'aws_secret_access_key|aws secret|aws_secret|secret access key') THEN 'context_keywords'
          WHEN rule_id = 'aws_access_key_id' AND NOT regexp_matches(value, '^.{{4}}[A-Z2-7]{{16}}$') THEN 'validator' ELSE 'kept' END AS reason FROM m)
        SELECT rule_id, reason, count(*) AS n FROM r GROUP BY ALL""",
    "findings_cap": f"""WITH {HITS_SQL}, p AS (SELECT 'P-' || secret_hash[8:8] AS issue_key, rule_id, secret_hash, row_number() OVER (PARTITION BY secret_hash[8:8] ORDER BY ('0x' || secret_hash[8:22])::BIGINT, list_position([{", ".join(f"'{b.rule_id}'" for b in BUILTIN)}], rule_id)) AS n FROM hits)
        SELECT issue_key, rule_id, secret_hash FROM p WHERE n <= 5""",
    "attachment_budget": """WITH RECURSIVE a AS (SELECT 'HOST-' || page_id % 7 AS k, page_id AS pos, strlen(html)::BIGINT AS size, row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) AS n FROM pages),
        r AS (SELECT DISTINCT k, 0::BIGINT AS n, 0::BIGINT AS used, 0::BIGINT AS files, NULL::BIGINT AS pos, NULL::VARCHAR AS outcome FROM a
          UNION ALL SELECT k, n, used + CASE WHEN o = 'scan' THEN size ELSE 0 END, files + CASE WHEN o = 'scan' THEN 1 ELSE 0 END, pos, o FROM (
            SELECT a.k, a.n, a.pos, a.size, r.used, r.files, CASE WHEN r.files >= 20 THEN 'stop' WHEN a.size > 8192 THEN 'skip' WHEN r.used >= 40000 THEN 'over' WHEN a.size > 40000 - r.used THEN 'failed' ELSE 'scan' END AS o FROM r JOIN a ON a.k = r.k AND a.n = r.n + 1))
        SELECT k AS issue_key, pos, outcome FROM r WHERE n > 0""",
    "scan_run_e2e": f"""WITH {_hits_sql(E2E_SQL)}, pairs AS (SELECT issue_key, 'description' AS field_path, 'description' AS source_type, name AS username, h[1:20] AS password FROM cust WHERE c % 5 = 1
          UNION ALL SELECT issue_key, 'description', 'description', 'svc', h[1:16] FROM cust WHERE c % 5 = 4 UNION ALL SELECT issue_key, 'attachment[' || c || '.env]', 'attachment', name, h[41:60] FROM cust WHERE c % 7 = 0)
        SELECT rule_id, secret_hash, severity, confidence, 'new' AS status, issue_key, field_path, source_type, NULL::VARCHAR AS username, 1::INTEGER AS times_seen, CASE rule_id {" ".join(f"WHEN '{b.rule_id}' THEN {len(b.references)}" for b in BUILTIN)} END::BIGINT AS n_references FROM hits
        UNION ALL SELECT 'credential_pair', 'sha256:' || sha256(password), 'high', 'high', 'new', issue_key, field_path, source_type, username, 1, 0 FROM pairs""",
    "github_checksum": "SELECT c_custkey, c_custkey % 2 = 0 AS ok FROM customer",
}
