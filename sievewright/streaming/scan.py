"""The batch scan as a streaming query: every micro-batch is scanned, merged and reconciled with the stored table."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import scanner
from ..functions import fixed
from ..operators import allowlist, findings, pairs, rules, scan, store
from ..operators.store import Buckets
from ..sources import records as sources
from ..sources.stages import Stages


def read_segments(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    """New segment files as a stream; the number of files bounds a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def process(segments: DataFrame, base_url: str, rules=None, allowlist=(), floor: str = "low") -> DataFrame:
    """Merged findings of a set of segments, all of each record."""
    return findings.merged(findings.findings(scan.scan(segments, rules, allowlist, floor), pairs.detect(segments, floor), base_url, cap=None))


def dealt(segments: DataFrame) -> DataFrame:
    """A batch dealt out to all cores, each record's segments together: few files, or few row groups in them, leave its texts to a few tasks."""
    return segments.repartition(2 * segments.sparkSession.sparkContext.defaultParallelism, "issue_key")


def stored(spark: SparkSession, table: str) -> DataFrame:
    """The stored table as the last complete micro-batch left it."""
    buckets = Buckets(spark, table)
    return buckets.read(buckets.folders())


def run(segments: DataFrame, table: str, base_url: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts the query. ``table`` is the folder of ``Buckets``."""
    spark = segments.sparkSession
    buckets = Buckets(spark, table)

    def one(batch: DataFrame, number: int) -> None:
        stages = Stages(spark)
        batch = stages.keep(dealt(batch), "batch")
        found, keys = stages.keep(process(batch, base_url), "found"), batch.select("issue_key").distinct()
        folders = buckets.folders(number)
        names, live = buckets.touched(found, keys, folders), spark.createDataFrame([], store.LIVE)
        after, _ = store.reconcile(found, buckets.read(folders, names), keys, live, f"batch-{number}", datetime.now(UTC).isoformat(timespec="seconds"))
        buckets.write(after, number)
        stages.clear()

    writer = segments.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_records(spark: SparkSession, config: scanner.Config, **options: str) -> DataFrame:
    """Updated records of a query as a stream, each version once.

    Batches overlap by some minutes, so a version of a record (its key and time of update) that comes again within them is dropped by state
    that a watermark bounds. ``options`` are the source's, such as ``since``.
    """
    spark.dataSource.register(sources.RecordSource)
    asked = scanner.record_options(config, " ".join(config.query.split())) | options
    rows = spark.readStream.format("paged-records").options(**asked).load().select("issue_key", "fields", F.get_json_object("fields", "$.updated").alias("updated"))
    at = F.coalesce(F.try_to_timestamp("updated"), F.current_timestamp())
    return rows.withColumn("at", at).withWatermark("at", f"{2 * fixed.OVERLAP_MINUTES} minutes").dropDuplicatesWithinWatermark(["issue_key", "updated"])


def run_records(spark: SparkSession, config: scanner.Config, checkpoint: str, available_now: bool = True, **options: str) -> StreamingQuery:
    """Starts the scan of a stream of records into the tables of ``config.store_path()``.

    Every micro-batch is a whole scan of its records: later comments and attachments are fetched, findings are merged and reconciled with the stored
    buckets and validations, and a row of the batch is added to the scans. Of records with unread parts nothing is closed.
    """
    tables = store.Store(spark, config.store_path())
    rule_list = rules.rule_set(rules.read_rules(config.rules) if config.rules else ())
    allowed = allowlist.read_allowlist(config.allowlist) if config.allowlist else []

    def one(batch: DataFrame, number: int) -> None:
        stages, now = Stages(spark), datetime.now(UTC)
        stamp = now.isoformat(timespec="seconds")
        records = stages.keep(batch.select("issue_key", "fields"), "records")
        (whole, _, found), failed = scanner.sliced(config, records, None, None, True, now, rule_list, allowed, stages)
        found = stages.keep(findings.merged(found), "merged")
        unread = whole.where("error IS NOT NULL").select("issue_key").distinct().withColumn("unread", F.lit(True))
        keys = records.select("issue_key").distinct().join(unread, "issue_key", "left").select("issue_key", F.col("unread").isNull().alias("complete"))
        folders = tables.findings.folders(number)
        names = tables.findings.touched(found, keys, folders)
        after, _ = store.reconcile(found, tables.findings.read(folders, names), keys, tables.read("live_validations"), f"batch-{number}", stamp)
        tables.findings.write(after, number)
        row = (f"batch-{number}", stamp, datetime.now(UTC).isoformat(timespec="seconds"), "partial" if failed else "success", config.url, config.query, records.count(), found.count())
        tables.replace("scans", store.audit(tables.read("scans"), spark.createDataFrame([row], store.SCANS)))
        stages.clear()

    writer = read_records(spark, config, **options).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
