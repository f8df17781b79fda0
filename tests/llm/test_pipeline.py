"""Every stage of the pipeline on a table with all odd cases, against brute force."""

import collections
import random

import pytest
from pyspark.sql import functions as F
from test_documents import by, linked_components, verdicts, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from sievewright.llm import mixing, secrets, tokens  # noqa: E402
from sievewright.llm.common import Stages  # noqa: E402
from sievewright.llm.queries import tokenizer  # noqa: E402

STAGE = dict(corpus_pipeline.STAGES)


def test_the_stages_are_five_and_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "secret scans", "source mixing", "best-fit packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_quality_rules_keep_what_the_verdict_keeps(spark, docs, rows):
    got = STAGE["quality rules"](spark, docs, "")
    assert got.dtypes == docs.dtypes
    expected = verdicts([(r[0], r[1], r[2], r[3]) for r in rows])
    assert by(got, "doc_id", "text") == collections.Counter((r[0], r[1]) for r, kept in zip(rows, expected, strict=True) if kept)


def test_one_document_of_each_group_stays(spark, docs, rows):
    got = STAGE["n-gram Jaccard join"](spark, docs, "")
    assert got.dtypes == docs.dtypes
    counts = linked_components(rows, 5, 80)
    components = {(doc, component) for doc, n, component in counts.elements() if n}
    leaders = collections.Counter(r["doc_id"] for r in got.collect() if words(r["text"]))
    assert set(leaders) == {component for _, component in components}
    assert sum(leaders.values()) == len({component for _, component in components}) + (leaders[7] - 1 if leaders[7] > 1 else 0)
    lonely = [r for r in rows if not words(r[1])]
    assert sum(not words(r["text"]) for r in got.collect()) == len(lonely)


def test_secrets_are_replaced_and_nothing_else(spark, docs, rows):
    got = STAGE["secret scans"](spark, docs, "")
    assert got.dtypes == docs.dtypes and got.count() == len(rows)
    found = docs.select("doc_id", "text", secrets.findings(F.col("text"), F.col("source"), secrets.forest(spark)).alias("f")).collect()
    expected = collections.Counter()
    for r in found:
        text = r["text"]
        for value in sorted({f["value"] for f in r["f"] if f["secret"]}, key=lambda v: (-len(v), v)):
            text = text.replace(value, "[REDACTED]")
        expected[r["doc_id"], text] += 1
    assert by(got, "doc_id", "text") == expected


def test_mixing_repeats_rows_as_often_as_it_takes_them(spark, docs):
    got = STAGE["source mixing"](spark, docs, "")
    assert got.dtypes == docs.dtypes
    taken = collections.Counter()
    for r in mixing.mix(docs, Stages(spark)).collect():
        taken[r["doc_id"], r["source"], r["size"]] += r["copies"]
    assert collections.Counter((r["doc_id"], r["source"], len(words(r["text"]))) for r in got.collect()) == +taken


def test_mixing_of_rows_that_differ_in_text_alone_is_the_same_every_time(spark):
    rng = random.Random(1)
    made = [(5, " ".join(rng.choices("abcdefgh", k=10)), "a") for _ in range(40)] + [(i, "b " * 12, "b") for i in range(30)]
    first = None
    for parts in (1, 4):
        docs = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(parts)
        told = by(STAGE["source mixing"](spark, docs, ""), "doc_id", "text")
        first = first or told
        assert told == first


def test_packing_places_every_token_once(spark, docs, rows):
    ids = tokens.ByteIds(tokenizer("byte_bpe_50k.json"))
    pieces = STAGE["best-fit packing"](spark, docs, "").collect()
    assert sum(r["length"] for r in pieces) == sum(len(ids.whole(r[1] or "")) + 1 for r in rows)
    bins = collections.defaultdict(list)
    for r in pieces:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for inside in bins.values():
        inside.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(inside, inside[1:], strict=False)) and inside[0][0] == 0 and sum(inside[-1]) <= 1024


def test_every_stage_takes_an_empty_table(spark, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, "").count() == 0, name
