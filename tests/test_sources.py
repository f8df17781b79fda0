"""The paged source against a small server, landed comment pages, and the probe."""

import json
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from sievewright import scanner
from sievewright.functions import columns as C
from sievewright.sources import fetching, records


@pytest.fixture(scope="module")
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            query = {k: v[0] for k, v in parse_qs(url.query).items()}
            asked.append((url.path, query, self.headers.get("Authorization")))
            if url.path.endswith("/serverInfo"):
                answer = {"version": "9.1"}
            elif url.path.endswith("/missing"):
                self.send_error(404)
                return
            else:
                start, size = int(query["startAt"]), int(query["maxResults"])
                answer = {"total": 7, "issues": [{"key": f"K-{i}", "id": i, "fields": {"summary": f"text {i}"}} for i in range(start, min(7, start + size))]}
            body = json.dumps(answer).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    made = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", asked
    made.shutdown()


@pytest.mark.parametrize(("most", "keys"), [(0, 7), (5, 5), (100, 7)])
def test_pages_are_planned_and_read_in_parts(server, most, keys):
    base, asked = server
    reader = records.RecordReader({"url": f"{base}/search", "query": "project = A", "pageSize": "3", "maxRecords": str(most), "fields": "summary, comment", "token": "t"})
    pages = reader.partitions()
    rows = [row for page in pages for row in reader.read(page)]
    assert len(pages) == -(-keys // 3) and [r[0] for r in rows] == [f"K-{i}" for i in range(keys)]
    assert json.loads(rows[1][2]) == {"summary": "text 1"}
    path, query, header = asked[-1]
    assert (path, query["jql"], query["fields"], header) == ("/search", "project = A", "summary,comment", "Bearer t")


def test_the_source_is_read_through_spark(spark, server):
    spark.dataSource.register(records.RecordSource)
    frame = spark.read.format("paged-records").options(url=f"{server[0]}/search", query="q", pageSize="2").load()
    assert {r["issue_key"] for r in frame.collect()} == {f"K-{i}" for i in range(7)} and frame.rdd.getNumPartitions() == 4


@pytest.fixture
def no_records(spark, monkeypatch):
    """The source before a tracker that shows no record, without a server."""

    class Nothing:
        def json(self, url):
            return {"total": 0, "issues": []}

    class Source(records.RecordSource):
        def reader(self, schema):
            made = records.RecordReader(self.options)
            made.server = Nothing()
            return made

    kept = records.RecordSource
    monkeypatch.setattr(records, "RecordSource", Source)
    monkeypatch.setattr(fetching.Server, "probe", lambda self: {})
    spark.dataSource.register(Source)
    yield
    spark.dataSource.register(kept)


def test_a_query_without_records_is_read_through_spark(spark, no_records):
    frame = spark.read.format("paged-records").options(url="http://tracker.invalid/search", query="q", pageSize="2", concurrency="2").load()
    assert frame.columns == ["issue_key", "id", "fields"] and frame.collect() == []


def test_a_run_without_records_succeeds(spark, no_records, tmp_path):
    config = scanner.Config(url="http://tracker.invalid", auth="none", query="q", incremental=True, scan_attachments=True, state_dir=str(tmp_path / "state"), report_dir=str(tmp_path / "reports"))
    done = scanner.run(spark, config)
    assert (done.run["status"], done.run["issues_scanned"], done.run["errors_total"]) == ("success", 0, 0)
    assert done.findings.count() == 0 and (tmp_path / "state" / "checkpoint.json").exists()


def test_probe_and_failures(server):
    assert fetching.Server(server[0]).probe()["version"] == "9.1"
    with pytest.raises(RuntimeError, match="404"):
        fetching.Server(server[0], pause=lambda _: None).json(f"{server[0]}/missing")


def test_landed_comment_pages(spark, tmp_path):
    for key, start in (("K-1", 0), ("K-1", 2), ("K-2", 5)):
        folder = tmp_path / f"issue_key={key}"
        folder.mkdir(exist_ok=True)
        (folder / f"{start}.json").write_text(json.dumps({"startAt": start, "total": 9, "comments": [{"body": f"{key} {start + i}"} for i in range(2)]}))
    got = records.landed_comments(spark, str(tmp_path)).collect()
    assert sorted((r["issue_key"], r["pos"], json.loads(r["comment"])["body"]) for r in got) == [("K-1", i, f"K-1 {i}") for i in range(4)] + [("K-2", i, f"K-2 {i}") for i in (5, 6)]


def test_queries_and_levels(spark):
    row = spark.range(1).select(
        C.normalize_query(F.lit("  project  =\n A ")).alias("plain"), C.narrow_query(F.lit("project = A"), F.lit(datetime(2026, 1, 2, 3, 4, 5))).alias("narrow"),
        C.parse_severity(F.lit("HIGH")).alias("s"), C.parse_severity(F.lit("odd")).alias("s0"), C.parse_confidence(F.lit("Medium")).alias("c"), C.parse_confidence(F.lit("odd")).alias("c0"), C.parse_level(F.lit("LOW"), ("low", "high")).alias("l"), C.parse_level(F.lit("odd"), ("low", "high")).alias("l0"), C.rank(F.lit("critical"), ("info", "low", "medium", "high", "critical")).alias("r"),
    ).first()
    assert (row["plain"], row["narrow"]) == ("project = A", '(project = A) AND updated >= "2026-01-02 03:04"')
    assert (row["l"], row["l0"]) == ("low", None)
    assert (row["s"], row["s0"], row["c"], row["c0"], row["r"]) == ("high", "medium", "medium", "low", 4)
