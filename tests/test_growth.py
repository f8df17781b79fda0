"""Work that has to grow no faster than its input."""

import json
import math
import time

from pyspark.sql import functions as F

from sievewright import scanner
from sievewright.operators import pairs, rules, scan, segments
from sievewright.sources.stages import Stages
from sievewright.streaming import scan as stream

LISTED = "issue_key string, pos long, name string, mime string, size long, url string, base string"


def one_by_one(sizes, per_file, count, total):
    used, files, out = 0, 0, []
    for size in sizes:
        known = used is not None and size is not None
        out.append("stop" if files >= count else "skip" if size is not None and size > per_file else "over" if used is not None and used >= total else "failed" if known and size > total - used else "scan")
        if out[-1] == "scan":
            files, used = files + 1, used + size if known else None
    return out


def test_budget_equals_the_rule_one_by_one(spark):
    shapes = {"falling": [2000 - i for i in range(1900)], "mixed": [(i * 7919) % 400 for i in range(3000)], "null": [90, None, 5000, 3, 4, 60] * 9, "negative": [100, 90, -50, 80, -9, 70] * 9, "zero": [0, 0, 7] * 20, "none": [9000] * 5}
    rows = [(k, 3 * i, f"{i}.log", "", s, "/x", "https://t.example") for k, sizes in shapes.items() for i, s in enumerate(sizes)]
    listed = spark.createDataFrame(rows, LISTED)
    for limits in ((1500, 20, 1000), (5000, 3, 100), (5000, 20, 0), (5000, 0, 10)):
        got = {(r["issue_key"], r["pos"]): r["outcome"] for r in segments.budgeted(listed, *limits).collect()}
        assert got == {(k, 3 * i): o for k, sizes in shapes.items() for i, o in enumerate(one_by_one(sizes, *limits))}


def test_budget_of_a_record_with_very_many_attachments(spark):
    listed = spark.range(60_000).select(F.lit("K").alias("issue_key"), F.col("id").alias("pos"), F.lit("a.log").alias("name"), F.lit("").alias("mime"), F.lit(101).cast("long").alias("size"), F.lit("/x").alias("url"), F.lit("https://t.example").alias("base"))
    began = time.monotonic()
    assert [tuple(r) for r in segments.budgeted(listed, 200, 20, 1000).groupBy("outcome").count().orderBy("outcome").collect()] == [("failed", 59_991), ("scan", 9)]
    assert time.monotonic() - began < 40


def test_a_search_for_words_lets_through_what_the_hints_do(spark):
    built_in = rules.rule_set()
    words = [w for rule in built_in for w in (*rule.literals, *rule.marks)]
    odd = [c for word in ("password", "passwd", "secret", "token", "api_key", "apikey", "api-key") for c in (word.upper(), word.replace("s", "ſ"), word.replace("k", "K"), word.replace("i", "İ"), word.replace("i", "ı"))]
    tails = ["", "=abcdefgh1", " : x", "ABCDEFGHIJKLMNOP", "12345678:x", " KEY-----\n-----END RSA PRIVATE KEY-----", "svc:pw@db/x"]
    texts = [f"{before}{word}{tail}" for word in [*words, *odd, "aws secret", "AWS_ſecret", "secret-access-key", "12345678", "{", "  {"] for tail in tails for before in ("", "é straße ", "İ")]
    rows = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "text string")
    hinted = rows.where(F.col("text").rlike(rules.prefilter(built_in)))
    passed = rows.where(rules.could_match(F.col("text"), built_in))
    matched = {t for t in texts if any(next(scan.matches(rule, t), None) for rule in built_in)}
    assert len(matched) > 100 and matched <= {r["text"] for r in passed.collect()} <= {r["text"] for r in hinted.collect()}
    assert {r["text"] for r in rows.where(rules.could_match(F.col("text"), [r for r in built_in if "(?i" in r.hint])).collect()} == {r["text"] for r in rows.where(F.col("text").rlike(rules.prefilter([r for r in built_in if "(?i" in r.hint]))).collect()}
    paired = rows.where(F.col("text").rlike(pairs.HINT))
    assert {r["text"] for r in rows.where(pairs.could_pair(F.col("text"))).collect()} == {r["text"] for r in paired.collect()}


def test_hits_are_looked_for_by_all_cores(spark):
    few = spark.range(1, 200, 1, 1).select(F.concat(F.lit("K-"), "id").alias("issue_key"), F.lit(0).cast("long").alias("seg_ord"), F.lit("d").alias("field_path"), F.concat(F.lit("token = x9f8e7d6c5b4a"), "id").alias("text"), F.lit("description").alias("source_type"))
    for found in (scan.scan(few), pairs.detect(few.withColumn("text", F.concat(F.lit("postgres://svc:pw"), "issue_key", F.lit("@db/x"))))):
        assert found.count() == 199 and found.select(F.spark_partition_id().alias("p")).distinct().count() >= 4


def test_pairs_are_handed_on_in_parts_and_cut_by_a_cap_alone(spark, monkeypatch):
    text = "".join(f"a://u{i}:pw{i}@h\n" for i in range(700)) + "user=abc\npassword=def\n"
    rows = spark.createDataFrame([(f"K-{i}", 0, "d", t, "description") for i, t in enumerate((text, "user=a\npassword=b", text))], "issue_key string, seg_ord long, field_path string, text string, source_type string")
    places = lambda found: sorted(tuple(r) for r in found.select("issue_key", "rule_ord", "hit_ord", "username").collect())
    whole = places(pairs.detect(rows))
    assert whole == sorted([("K-1", 1, 0, "a"), *((f"K-{k}", int(n == 700), n, f"u{n}" if n < 700 else "abc") for k in (0, 2) for n in range(701))])
    for cap in (1, 300, 5000):
        assert places(pairs.detect(rows, cap=cap)) == [r for r in whole if r[2] < cap]
    monkeypatch.setattr(pairs, "ROWS", 3)
    assert places(pairs.detect(rows)) == whole


def test_payloads_are_read_once_for_comments_and_attachments(spark):
    fields = json.dumps({"comment": {"total": 3, "startAt": 0, "comments": [{"body": "a"}]}, "attachment": [{"filename": f"{i}.log", "size": 9, "content": "/x"} for i in range(3)]})
    records = spark.createDataFrame([(f"K-{i}", fields) for i in range(5)] + [("K-9", "no json"), ("K-8", None)], "issue_key string, fields string")
    comments = spark.createDataFrame([(f"K-{i}", i % 3, json.dumps({"body": "b"})) for i in range(5)], "issue_key string, pos long, comment string")
    bodies = spark.createDataFrame([(f"K-{i}", i % 3, "text") for i in range(4)], "issue_key string, pos long, text string")
    config = scanner.Config(url="https://t.example", scan_attachments=True)
    plain, kept = (scanner.text_segments(config, records, comments, bodies, keep) for keep in (segments.as_it_is, Stages(spark).keep))
    plan = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" in plan(plain[0]) and "get_json_object" not in plan(kept[0]) and "get_json_object" not in plan(kept[1])
    for one, other in zip(plain, kept, strict=True):
        assert sorted(map(repr, one.select(*sorted(one.columns)).collect())) == sorted(map(repr, other.select(*sorted(one.columns)).collect()))


def test_a_batch_of_one_file_is_dealt_to_all_cores(spark, tmp_path, monkeypatch):
    spark.range(1, 200, 1, 1).select(F.concat(F.lit("K-"), F.col("id") % 90).alias("issue_key"), F.lit(0).cast("long").alias("seg_ord"), F.lit("d").alias("field_path"), F.lit("token = x9f8e7d6c5b4a").alias("text"), F.lit("description").alias("source_type")).write.parquet(str(tmp_path / "in"))
    told, process = [], stream.process
    monkeypatch.setattr(stream, "process", lambda batch, *rest: told.append(batch.groupBy(F.input_file_name().alias("f")).agg(F.collect_set("issue_key").alias("keys")).collect()) or process(batch, *rest))
    query = stream.run(stream.read_segments(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), str(tmp_path / "table"), "https://t.example", str(tmp_path / "checkpoint"))
    assert query.awaitTermination(120) and len(told) == 1 and len(told[0]) >= 4
    keys = [key for row in told[0] for key in row["keys"]]
    assert len(keys) == len(set(keys)) == 90


def test_texts_of_one_row_group_are_searched_by_all_cores(spark, tmp_path):
    rows = spark.range(1, 400, 1, 1).select(F.concat(F.lit("K-"), "id").alias("issue_key"), F.lit(0).cast("long").alias("seg_ord"), F.lit("d").alias("field_path"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("token = x9f8e7d6c5b4a"), "id")).otherwise(F.lit("nothing")).alias("text"), F.lit("description").alias("source_type"))
    rows.write.parquet(str(tmp_path / "in"))
    one = spark.read.parquet(str(tmp_path / "in"))
    plan = scan.scan(one, spread=True)._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.lower().partition("repartition")
    assert below and "spark_partition_id" in above and "spark_partition_id" not in below and "contains" not in below
    found = scan.scan(one, spread=True)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() >= 4
    assert sorted(map(repr, found.collect())) == sorted(map(repr, scan.scan(one).collect())) and found.count() == 199


def test_few_values_are_masked_as_many_are():
    few, text = [("x9f8e7d6", "a"), ("9f8e", "b"), ("", "c")], "k x9f8e7d6 9f8e x9f8e7d6 é 0a1b2c3d"
    more = few + [(f"not in it {i}", "d") for i in range(9)]
    one, other = scan.Masker(text.encode(), few), scan.Masker(text.encode(), more)
    assert one.automaton is None and other.automaton is not None and one.near(text) == other.near(text) == [("x9f8e7d6", "a"), ("9f8e", "b")]
    assert one.snippet(2, 10, "a", "x9f8e7d6") == other.snippet(2, 10, "a", "x9f8e7d6")
    for value in ("abcabc12", "éa" * 120, "ab1" * 200):
        assert abs(scan.shannon(value) + sum(value.count(c) / len(value) * math.log2(value.count(c) / len(value)) for c in set(value))) < 1e-9
