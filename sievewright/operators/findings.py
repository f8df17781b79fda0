"""From hits to findings: union, caps, merging of duplicates, and tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import columns as C
from ..functions import fixed

ORDER = ("seg_ord", "detector_ord", "rule_ord", "hit_ord")
VERSION = "1.0.0"


def capped(hits: DataFrame, cap: int | None = fixed.FINDINGS_PER_ISSUE) -> DataFrame:
    """The first ``cap`` hits of each record in scan order, all if there is none; what was dropped before doesn't count."""
    if cap is None:
        return hits.where(F.col("drop_reason").isNull())
    place = F.row_number().over(W.partitionBy("issue_key").orderBy(*ORDER))
    return hits.where(F.col("drop_reason").isNull()).withColumn("_n", place).where(F.col("_n") <= cap).drop("_n")


def findings(rule_hits: DataFrame, pair_hits: DataFrame, base_url: str, now: Column | None = None, cap: int | None = fixed.FINDINGS_PER_ISSUE) -> DataFrame:
    """Rule and pair hits of all records as findings. finding_id and detected_at vary from run to run unless ``now`` is given."""
    whole = capped(rule_hits.unionByName(pair_hits), cap)
    stamp = F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ssXXX")
    place = F.struct("issue_key", "field_path", "source_type")
    return whole.select(
        F.uuid().alias("finding_id") if now is None else F.sha2(F.concat_ws("/", "issue_key", *(F.col(c).cast("string") for c in ORDER)), 256).alias("finding_id"),
        "issue_key", F.concat(F.lit(f"{base_url.rstrip('/')}/browse/"), "issue_key").alias("issue_url"), "field_path", "rule_id", "severity", "confidence", "redacted_secret", "secret_hash", "snippet",
        stamp.alias("detected_at"), F.lit(VERSION).alias("scanner_version"), F.array(place).alias("locations"), "source_type", F.lit("new").alias("status"), "username", "references",
        F.lit(None).cast("string").alias("first_seen"), F.lit(None).cast("int").alias("times_seen"), F.lit(None).cast("struct<valid:boolean,source:string,checked_at:string>").alias("external_validation"), *ORDER,
    )


def merged(found: DataFrame) -> DataFrame:
    """One finding for each secret and rule: the first one's fields, and the distinct locations in the order they were first seen.

    Hits of one place are combined before those of one secret, so a secret repeated in one place stays one entry; the input is read once.
    """
    order = F.struct("issue_key", *ORDER)
    scalars = [c for c in found.columns if c not in ("locations", "secret_hash", "rule_id", *ORDER)]
    rows = found.select("secret_hash", "rule_id", order.alias("_o"), F.struct(*scalars).alias("_fields"), F.explode("locations").alias("_place"))
    places = rows.groupBy("secret_hash", "rule_id", "_place").agg(F.min("_o").alias("_o"), F.min_by("_fields", "_o").alias("_fields"))
    whole = places.groupBy("secret_hash", "rule_id").agg(F.min_by("_fields", "_o").alias("_first"), F.min("_o").alias("ord"), F.transform(F.sort_array(F.collect_list(F.struct("_o", "_place"))), lambda x: x["_place"]).alias("locations"))
    return whole.select("_first.*", "secret_hash", "rule_id", "locations", "ord")


def locations(found: DataFrame) -> DataFrame:
    """A row per location; a finding without any stands at its own place."""
    own = F.array(F.struct("issue_key", "field_path", "source_type"))
    return found.withColumn("location", F.explode(F.when(F.size("locations") == 0, own).otherwise(F.col("locations"))))


def tally(found: DataFrame) -> DataFrame:
    """One row: findings in all and per severity."""
    return found.agg(F.count("*").alias("findings_total"), *(F.count_if(F.col("severity") == s).alias(f"findings_{s}") for s in reversed(fixed.SEVERITIES)))


def comments_scanned(segments: DataFrame) -> DataFrame:
    """One row: comments seen, each counted once however many texts it has."""
    head = F.regexp_extract("field_path", "^(.*?\\.body)", 1)
    return segments.where("source_type = 'comment'").agg(F.countDistinct("issue_key", F.when(head == "", F.col("field_path")).otherwise(head)).alias("comments_scanned"))


def scan_run(found: DataFrame, segments: DataFrame, attachments: DataFrame | None, facts: dict) -> DataFrame:
    """The one-row record of a run: facts of the driver (ids, times, errors) beside counts taken from the data.

    The parts have one row each, so joining them makes one row.
    """
    run = tally(found).join(comments_scanned(segments), F.lit(True)).join(segments.agg(F.countDistinct("issue_key").alias("issues_scanned")), F.lit(True))
    if attachments is not None:
        counts = attachments.agg(*(F.count_if(F.col("outcome").isin(*o)).alias(f"attachments_{n}") for o, n in ((("scan",), "scanned"), (("skip", "over"), "skipped"), (("failed",), "failed"))), F.coalesce(F.sum(F.when(F.col("outcome") == "scan", F.col("size"))), F.lit(0)).alias("attachment_bytes"))
        run = run.join(counts, F.lit(True))
    run = run.withColumns({k: F.lit(v) for k, v in facts.items()})
    errors = F.lit(facts.get("errors_total", 0))
    return run.withColumn("status", F.when(F.lit(bool(facts.get("cancelled"))) | (errors > 0), "partial").otherwise("success"))


def rule_levels(found: DataFrame) -> DataFrame:
    """Per rule the most severe report level of its findings, in the order rules are first met."""
    level = {"critical": 0, "high": 0, "medium": 1, "low": 2, "info": 2}
    rank = F.coalesce(*(F.when(F.col("severity") == s, F.lit(r)) for s, r in level.items()), F.lit(2))
    worst = found.groupBy("rule_id").agg(F.min(rank).alias("r"), F.min("ord").alias("ord"))
    return worst.select("rule_id", F.element_at(F.array(*map(F.lit, ("error", "warning", "note"))), F.col("r") + 1).alias("level"), "ord")


def visible(found: DataFrame, floor: str = "medium", top: int = 10) -> DataFrame:
    """The first findings at or above a confidence, in finding order."""
    return found.where(C.rank(F.col("confidence"), fixed.CONFIDENCES) >= fixed.CONFIDENCES.index(floor)).orderBy(F.col("ord").asc_nulls_last()).limit(top)
