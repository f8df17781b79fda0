"""Column functions, segments, state and sinks."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from sievewright.functions import columns as C
from sievewright.operators import findings, incremental, scan, segments, store
from sievewright.sinks import alerts, reports
from sievewright.sources import fetching, records


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_identity_formats(spark):
    digest = one(spark, C.secret_hash(F.lit("abc")))
    assert digest == "sha256:ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad" == scan.secret_hash("abc")
    assert one(spark, C.fingerprint(F.lit(digest), F.lit("r"), F.lit("K-1"))).startswith("fp:")
    assert one(spark, C.merge_key(F.lit(digest), F.lit("r"))) == f"{digest}:r"


@pytest.mark.parametrize("value", ["", "short", "exactly8", "пароль-секрет", "a" * 30, "9f8e7d6c5b4a"])
def test_columns_equal_the_kernel(spark, value):
    assert one(spark, C.redact(F.lit(value))) == scan.redact(value)
    assert one(spark, C.marker_for(F.lit("rule"), F.lit(value))) == scan.marker_for("rule", value)
    assert abs(one(spark, C.shannon(F.lit(value))) - scan.shannon(value)) < 1e-9
    assert one(spark, C.is_placeholder(F.lit(value))) == scan.is_placeholder(value)


@pytest.mark.parametrize(("path", "kind"), [("comment.comments[0].body", "comment"), ("x.comment", "comment"), ("attachment[a]", "attachment"), ("description.content[0]", "description"), ("summary", "customfield")])
def test_paths(spark, path, kind):
    assert one(spark, C.classify_path(F.lit(path))) == kind


@pytest.mark.parametrize(("text", "limit", "cut"), [("abc", 2, "ab"), ("aж", 2, "a"), ("日本", 5, "日"), ("😀b", 3, ""), ("ok", 9, "ok")])
def test_truncation_keeps_characters_whole(spark, text, limit, cut):
    assert one(spark, C.truncate_bytes(F.lit(text), limit)) == cut


@pytest.mark.parametrize(("text", "clean"), [("\x1b[2Kgone", "gone"), ("a\x1b]52;c;xx\x07b", "ab"), ("=1+1", "'=1+1"), ("  @x", "'  @x"), ("a\nb", "ab"), ("plain é", "plain é"), ("\x9b31mred", "red")])
def test_cells_are_harmless(spark, text, clean):
    assert one(spark, C.csv_field(F.lit(text))) == clean


@pytest.mark.parametrize(("name", "mime", "verdict"), [("a.env", None, "keep"), ("a.zip", "text/plain", "skip"), ("Dockerfile", None, "keep"), ("x", "application/json; charset=utf-8", "keep"), ("", "text/plain", "skip"), ("dir\\b.PEM", None, "keep"), ("noext", None, "skip")])
def test_attachment_gate(spark, name, mime, verdict):
    assert one(spark, C.attachment_verdict(F.lit(name), F.lit(mime).cast("string"))) == verdict


@pytest.mark.parametrize(("url", "same"), [("/x", True), ("https://t.example:443/a", True), ("http://t.example/a", False), ("//evil.example/a", False), ("", False), ("https://evil.example/a", False), ("javascript:alert(1)", False)])
def test_same_origin(spark, url, same):
    assert one(spark, C.same_origin(F.lit(url), F.lit("https://t.example"))) is same


def test_walk_orders_leaves_by_key(spark):
    fields = json.dumps({"b": ["x", {"z": "1", "a": ""}], "a": "s", "n": 3, "none": None, "B": "upper"})
    rows = segments.walk(spark.createDataFrame([("K-1", fields), ("K-2", None), ("K-3", "{bad")], "issue_key string, fields string")).orderBy("seg_ord").collect()
    assert [(r["field_path"], r["text"]) for r in rows] == [("B", "upper"), ("a", "s"), ("b[0]", "x"), ("b[1].a", ""), ("b[1].z", "1")]


def test_comment_paging(spark):
    recs = spark.createDataFrame([("K-1", json.dumps({"comment": {"total": 5, "startAt": 0, "comments": [{"body": "a"}, {"body": "b"}]}})), ("K-2", "{}")], "issue_key string, fields string")
    comments = spark.createDataFrame([(k, i, f"c{i}") for k in ("K-1", "K-2") for i in range(7)], "issue_key string, pos int, body string")
    got = segments.later_comments(recs, comments).collect()
    assert sorted(r["field_path"] for r in got) == [f"comment.comments[{i}].body" for i in (2, 3, 4)]


def test_budget_is_sequential(spark):
    rows = [("K", i, f"{i}.log", "", s, "/x", "https://t.example") for i, s in enumerate([60, 50, 30, 20, 5])]
    got = segments.budgeted(spark.createDataFrame(rows, "issue_key string, pos int, name string, mime string, size long, url string, base string"), 100, 20, 100)
    assert [r["outcome"] for r in got.orderBy("pos").collect()] == ["scan", "failed", "scan", "failed", "scan"]


HIT = "issue_key string, seg_ord long, field_path string, text string, source_type string"


def found(spark, rows):
    segs = spark.createDataFrame([(k, 0, p, "token = " + t + "9f8e7d6c5b4a3210", "description") for k, p, t in rows], HIT)
    hits = scan.scan(segs)
    return findings.merged(findings.findings(hits, hits.limit(0), "https://t.example/", F.lit("2026-01-01").cast("timestamp")))


LIVE = "secret_hash string, valid boolean, source string, checked_at string"


def test_reconcile_states(spark):
    empty, none = spark.createDataFrame([], store.STORED), spark.createDataFrame([], LIVE)
    keys = spark.createDataFrame([("A-1",), ("B-1",), ("C-1",)], "issue_key string")
    one_ = found(spark, [("A-1", "d", "a"), ("A-1", "e", "a"), ("B-1", "d", "b"), ("C-1", "d", "c")])
    table, report = store.reconcile(one_, empty, keys, none, "s1", "2026-01-01")
    first = {r["issue_key"]: (r["status"], r["times_seen"]) for r in table.collect()}
    assert first == {"A-1": ("recurring", 2), "B-1": ("new", 1), "C-1": ("new", 1)}
    assert {r["status"] for r in report.collect()} == {"new"}
    two = found(spark, [("A-1", "d", "a")])
    valid = two.select("secret_hash", F.lit(True).alias("valid"), F.lit("x").alias("source"), F.lit("t").alias("checked_at"))
    table, report = store.reconcile(two, table, keys.where("issue_key <> 'C-1'"), valid, "s2", "2026-01-02")
    second = {r["issue_key"]: (r["status"], r["times_seen"], r["closed_at"]) for r in table.collect()}
    assert second == {"A-1": ("recurring", 3, None), "B-1": ("closed", 1, "2026-01-02"), "C-1": ("new", 1, None)}
    told = {r["issue_key"]: r for r in report.collect()}
    assert (told["A-1"]["severity"], told["A-1"]["status"], told["A-1"]["times_seen"]) == ("critical", "recurring", 3)
    assert told["B-1"]["status"] == "closed" and "C-1" not in told


def test_cap_counts_kept_hits_only(spark):
    segs = spark.createDataFrame([("K", i, "d", f"token = value{i}x9f8e7d6c5b", "description") for i in range(9)], HIT)
    assert findings.capped(scan.scan(segs), 4).count() == 4


def test_checkpoint_is_trusted_only_for_the_same_question(tmp_path):
    now = datetime(2026, 1, 2, tzinfo=UTC)
    good = incremental.Checkpoint("2026-01-01T12:00:00+00:00", "project = A", "https://t")
    assert incremental.window_start(good, "project  =  A", "https://t", now) == datetime(2026, 1, 1, 11, 55, tzinfo=UTC)
    for other in (None, incremental.Checkpoint("2027-01-01T12:00:00+00:00", "project = A", "https://t"), incremental.Checkpoint("nonsense", "project = A", "https://t"), incremental.Checkpoint(good.finished_at, good.query, good.origin, "partial")):
        assert incremental.window_start(other, "project = A", "https://t", now) is None
    path = str(tmp_path / "state" / "c.json")
    assert incremental.read_checkpoint(path) is None
    assert incremental.write_checkpoint(path, good, True) and incremental.read_checkpoint(path) == good
    assert not incremental.write_checkpoint(path, good, False)


def test_reports(spark, tmp_path):
    merged = found(spark, [("A-1", "d", "a"), ("B-1", "d", "b")])
    run = {**findings.tally(merged).first().asDict(), "scan_id": "s", "status": "partial", "issues_scanned": 1, "issues_total": 2, "errors_total": 1, "duration_secs": 1.25}
    paths = reports.write_reports(merged, run, "csv,all", str(tmp_path), datetime(2026, 1, 1, tzinfo=UTC), "PROJ")
    assert [p.name.split("_report.")[1] for p in paths] == ["csv", "json", "ndjson", "sarif", "defectdojo.json", "txt"]
    whole = "".join(p.read_text() for p in paths)
    assert "9f8e7d6c5b4a3210" not in whole
    sarif = json.loads(paths[3].read_text())["runs"][0]
    assert {r["ruleId"] for r in sarif["results"]} == {r["id"] for r in sarif["tool"]["driver"]["rules"]}
    assert sarif["invocations"][0]["toolExecutionNotifications"][0]["level"] == "warning"
    assert reports.metrics_prometheus(run).count("\n") == 8 and "1.2" in reports.metrics_prometheus(run)
    for bad in ("../x", "a/b", "..", ""):
        with pytest.raises(ValueError):
            reports.secure_join(tmp_path, bad)
    with pytest.raises(reports.UnknownFormat):
        reports.formats("csv,pdf")


def test_alerts_never_raise_nor_show_endpoints(spark, caplog):
    merged = found(spark, [("A-1", "d", "a")])
    run = {"status": "success", "findings_total": 1}
    messages = alerts.payloads(merged, run, {"slack": {"webhook_url": "https://secret.example/hook"}, "webhook": {"url": "https://secret.example/2"}, "min_confidence": "high"})

    def post(url, body, timeout):
        raise OSError(url)

    assert alerts.deliver(messages, post=post) == {"slack": False, "webhook": False}
    assert "secret.example" not in caplog.text
    with pytest.raises(ValueError):
        alerts.channels({"slack": {"url": "x"}})


def test_retry_policy():
    assert fetching.backoff(0, 401) is None and fetching.backoff(0, 404) is None and fetching.backoff(2, 500) is None
    assert fetching.backoff(0, 429, "7") == 7 and fetching.backoff(1, 503) == 1.0 and fetching.backoff(0, None) == 0.5 and fetching.backoff(0, 429, "900") == 60
    assert fetching.retry_after("Thu, 01 Jan 1970 00:00:10 GMT", 4) == 6
    assert fetching.auth_header("t", "a@b") == {"Authorization": "Basic YUBiOnQ="}


def test_landed_pages(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"total": 1, "issues": [{"id": 7, "key": "K-1", "fields": {"a": "b"}}]}))
    row = records.landed_pages(spark, str(tmp_path)).first()
    assert (row["issue_key"], row["id"], json.loads(row["fields"])) == ("K-1", "7", {"a": "b"})
