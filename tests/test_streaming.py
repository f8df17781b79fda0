"""The streaming scan over landed files, run until nothing is left."""

import os
import shutil

import duckdb
import pytest

from sievewright.plans import runs
from sievewright.streaming import scan

SCHEMA = "issue_key string, seg_ord long, field_path string, text string, source_type string"


def test_batches_reconcile_and_rewrite_only_what_they_touch(spark, tmp_path):
    landed, table = str(tmp_path / "in"), str(tmp_path / "table")

    def land(*rows):
        spark.createDataFrame([(key, 0, "description", text, "description") for key, text in rows], SCHEMA).coalesce(1).write.mode("append").parquet(landed)
        query = scan.run(scan.read_segments(spark, landed, spark.createDataFrame([], SCHEMA).schema), table, "https://t.example", str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
        return {r["issue_key"]: (r["status"], r["times_seen"]) for r in scan.stored(spark, table).collect()}

    a = ("A-1", "token = value9f8e7d6c5b4a")
    assert land(a, *((f"B-{i}", f"token = other{i}f8e7d6c5b4a") for i in range(9))) == {"A-1": ("new", 1), **{f"B-{i}": ("new", 1) for i in range(9)}}
    assert land(a)["A-1"] == ("recurring", 2)
    assert sum(n.startswith("bucket=") for n in os.listdir(f"{table}/1")) == 1
    told = land(("A-1", "nothing left"))
    assert told["A-1"] == ("closed", 2) and told["B-3"] == ("new", 1)
    # a batch that is run again starts from what was before it
    before = scan.Buckets(spark, table).folders(1)
    shutil.rmtree(f"{table}/2")
    assert {r["issue_key"]: r["times_seen"] for r in scan.stored(spark, table).collect()}["A-1"] == 2 and len(before) >= 5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_texts_are_used_to_their_ends(spark, tmp_path):
    """Pairs behind 64 KiB and behind 2 MiB of a text, and more of them than a record's cap, against the query's SQL."""
    url = lambda i: f"see https://svc{i}:pw{i}f8e7d6c5b4a@db.internal/app\n"
    texts = ["word " * 20_000 + url(1), "long word\n" * 300_000 + url(2) + "token = value9f8e7d6c5b4a", "".join(url(i) for i in range(5000)), url(3)]
    for name in ("customer", "conversations", "pages"):
        os.symlink(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    for name in ("customer", "conversations", "pages", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet{'/*.parquet' if name == 'documents' else ''}'")
    expected = con.execute(f"SELECT fingerprint, issue_key, rule_id, status, times_seen FROM ({runs.ORACLES['streaming_states']})").fetchall()
    found = [tuple(r) for r in runs.streaming_states(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(expected)
    pairs = [r[1] for r in found if r[2] == "credential_pair" and r[1].startswith("DOC-")]
    assert [pairs.count(f"DOC-{i}") for i in range(4)] == [1, 1, 5000, 1]
