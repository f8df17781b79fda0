"""State between scans: reconciling current findings with stored ones, as one pure function over tables.

``reconcile`` takes the current findings, the stored table, the scanned keys and the external validations, and
gives the new stored table and the report. Nothing is updated in place: the caller writes the new snapshot (``Store``),
which makes a run that failed half-way repeatable. Rows of buckets that a scan doesn't touch are neither read for it nor written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.stages import Stages
from .findings import VERSION, locations

STORED = "fingerprint string, secret_hash string, rule_id string, issue_key string, issue_url string, field_path string, source_type string, severity string, confidence string, redacted_secret string, snippet string, username string, locations_json string, references_json string, status string, first_seen string, last_seen string, times_seen int, scan_id_first string, scan_id_last string, closed_at string"
LIVE = "secret_hash string, valid boolean, source string, checked_at string"
SCANS = "scan_id string, started_at string, finished_at string, status string, origin string, query string, issues_scanned long, findings_total long"
TABLES = {"findings": STORED, "live_validations": LIVE, "scans": SCANS}
PLACES = "array<struct<issue_key: string, field_path: string, source_type: string>>"
EXTERNAL = "struct<valid: boolean, source: string, checked_at: string>"


#: Hexadecimal digits of a fingerprint that name its bucket of the stored table.
DIGITS = 2


class Buckets:
    """The stored findings: buckets of fingerprints, each in the latest scan (or micro-batch) that changed it.

    A scan writes the buckets that it touches into a folder of its own (``<number>/bucket=<digits>``) and reads every bucket from
    the folders before it. So one that is run again overwrites what it wrote and starts from the same state, none
    rewrites buckets that it doesn't change, and one that fails half-way (no ``_SUCCESS``) leaves the state before it.
    """

    def __init__(self, spark: SparkSession, path: str, digits: int = DIGITS):
        self.spark, self.path, self.digits = spark, path.rstrip("/"), digits
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        where = self._path(path)
        return [f.getPath().getName() for f in self._files.listStatus(where)] if self._files.exists(where) else []

    def folders(self, before: int | None = None) -> dict[str, str]:
        """bucket: its folder, from the complete batches before one (all of them by default)."""
        out = {}
        for number in sorted(int(n) for n in self._names(self.path)):
            names = self._names(f"{self.path}/{number}")
            if (before is None or number < before) and "_SUCCESS" in names:
                out.update({n.removeprefix("bucket="): f"{self.path}/{number}/{n}" for n in names if n.startswith("bucket=")})
        return out

    def read(self, folders: dict[str, str], names: list[str] | None = None) -> DataFrame:
        """The rows of all buckets, or of those named; columns that an older folder lacks are null."""
        paths = [path for name, path in folders.items() if names is None or name in names]
        return self.spark.read.schema(STORED).parquet(*paths) if paths else self.spark.createDataFrame([], STORED)

    def touched(self, found: DataFrame, keys: DataFrame, folders: dict[str, str]) -> list[str]:
        """The buckets, at most 16 ** DIGITS, of what was found and of what is stored open for the scanned records."""
        known = self.read(folders).where("status <> 'closed'").join(keys, "issue_key", "left_semi")
        return [r["b"] for r in expanded(found).select(self.bucket().alias("b")).union(known.select(self.bucket())).distinct().collect()]

    def bucket(self) -> Column:
        return F.substring("fingerprint", 4, self.digits)

    def write(self, after: DataFrame, number: int) -> None:
        columns = [c.split(" ")[0] for c in STORED.split(", ")]
        after.select(*columns, self.bucket().alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{number}")

    def tidy(self, number: int) -> None:
        """Folders of buckets that were superseded before scan ``number`` - 1 go; readers of the state before may still be there."""
        needed = {*self.folders().values(), *self.folders(number).values()}
        for old in self._names(self.path):
            for name in self._names(f"{self.path}/{old}") if int(old) < number else ():
                if name.startswith("bucket=") and f"{self.path}/{old}/{name}" not in needed:
                    self._files.delete(self._path(f"{self.path}/{old}/{name}"), True)


class Store:
    """The tables of past scans below one folder; a missing table is empty, so opening creates nothing that could be half there.

    Findings lie in ``Buckets``, of which a scan writes those that it touches. The small tables (validations, scans) are Parquet snapshots: a
    snapshot is a folder of its own and becomes the table when it is complete (its ``_SUCCESS`` file), so a failed scan leaves the last one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path(self.path))
        self.findings = Buckets(spark, f"{self.path}/findings")

    def snapshots(self, name: str) -> list[int]:
        where = self._path(f"{self.path}/{name}")
        numbers = [int(f.getPath().getName()) for f in self._files.listStatus(where)] if self._files.exists(where) else []
        return sorted(n for n in numbers if self._files.exists(self._path(f"{self.path}/{name}/{n}/_SUCCESS")))

    def read(self, name: str) -> DataFrame:
        """The table as the last complete scan left it, in its own columns; those that an older one lacks are null."""
        if name == "findings":
            return self.findings.read(self.findings.folders())
        known = self.snapshots(name)
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}/{known[-1]}") if known else self.spark.createDataFrame([], TABLES[name])

    def replace(self, name: str, frame: DataFrame) -> None:
        """Writes the next snapshot of a small table; the one before stays for readers, older ones go."""
        known = self.snapshots(name)
        frame.select(*(c.split(" ")[0] for c in TABLES[name].split(", "))).write.mode("overwrite").parquet(f"{self.path}/{name}/{(known or [0])[-1] + 1}")
        for old in known[:-1]:
            self._files.delete(self._path(f"{self.path}/{name}/{old}"), True)

    def affected(self, found: DataFrame, keys: DataFrame) -> DataFrame:
        """The stored rows of the buckets that a scan can change: all that ``reconcile`` needs, and all that ``merge`` writes again."""
        folders = self.findings.folders()
        return self.findings.read(folders, self.findings.touched(found, keys, folders))

    def merge(self, after: DataFrame) -> None:
        """Writes the buckets that ``reconcile`` gives for ``affected`` rows; the others stay where they are."""
        number = (self.snapshots("findings") or [0])[-1] + 1
        self.findings.write(after, number)
        self.findings.tidy(number)


def expanded(found: DataFrame) -> DataFrame:
    """A row per location with its fingerprint."""
    at = F.col("location.issue_key")
    return locations(found).select("*", at.alias("at_key"), C.fingerprint(F.col("secret_hash"), F.col("rule_id"), at).alias("fingerprint"))


def matched(current: DataFrame, stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """fingerprint, k, new, old, in_scope, complete: one full outer join of current locations and stored rows; all of ``reconcile`` reads from it."""
    columns = [c.split(" ")[0] for c in STORED.split(", ")]
    whole = F.col("complete") if "complete" in scanned.columns else F.lit(True)
    keys = scanned.groupBy(F.col("issue_key").alias("_key")).agg(F.bool_and(whole).alias("complete"))
    old = stored.select(*columns).join(keys, F.col("issue_key") == F.col("_key"), "left").select("fingerprint", F.struct(*columns).alias("old"), F.col("_key").isNotNull().alias("in_scope"), F.coalesce("complete", F.lit(False)).alias("complete"))
    row = F.struct("secret_hash", "rule_id", F.col("at_key").alias("issue_key"), "issue_url", F.col("location.field_path").alias("field_path"), F.col("location.source_type").alias("source_type"), "severity", "confidence", "redacted_secret", "snippet", "username", F.to_json(F.array("location")).alias("locations_json"), F.to_json(F.coalesce("references", F.array().cast("array<string>"))).alias("references_json"))
    met = expanded(current).groupBy("fingerprint").agg(F.count("*").cast("int").alias("k"), F.max_by(row, F.struct("ord", "location")).alias("new"))
    return met.join(old, "fingerprint", "full")


def reconcile(current: DataFrame, stored: DataFrame, scanned: DataFrame, live: DataFrame, scan_id: str, now: str, both: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(stored table after the scan, report of current and newly closed findings).

    A fingerprint met k times at once counts k sightings: a new one is stored as recurring with times_seen k if
    k > 1, an old one gains k. Rows of records that were not scanned stay as they are; rows of scanned records
    that were not met again are closed, but for records that ``scanned`` marks as not ``complete``: what was not read may still be there. ``both`` is what ``matched`` gives, where the caller has written it; it is written once here otherwise, as
    table and report read it several times.
    """
    both = Stages(current.sparkSession).keep(matched(current, stored, scanned), "matched") if both is None else both
    met, known = F.col("new").isNotNull(), F.col("old").isNotNull() & F.col("in_scope")
    closing = ~met & known & F.col("complete") & (F.col("old.status") != "closed")

    # the table
    after = {
        "status": F.when(met, F.when(known | (F.col("k") > 1), "recurring").otherwise("new")).when(closing, "closed").otherwise(F.col("old.status")),
        "first_seen": F.coalesce(F.when(~met | known, F.col("old.first_seen")), F.lit(now)),
        "last_seen": F.when(met | closing, F.lit(now)).otherwise(F.col("old.last_seen")),
        "times_seen": F.when(met, F.coalesce(F.when(known, F.col("old.times_seen")), F.lit(0)) + F.col("k")).otherwise(F.col("old.times_seen")).cast("int"),
        "scan_id_first": F.coalesce(F.when(~met | known, F.col("old.scan_id_first")), F.lit(scan_id)),
        "scan_id_last": F.when(met | closing, F.lit(scan_id)).otherwise(F.col("old.scan_id_last")),
        "closed_at": F.when(closing, F.lit(now)).when(~met, F.col("old.closed_at")),
    }
    columns = [c.split(" ")[0] for c in STORED.split(", ")]
    table = both.select("fingerprint", *(after.get(c, F.when(met, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) if c != "fingerprint" else None).alias(c) for c in columns if c != "fingerprint"))

    # the report
    times = F.coalesce(F.when(known, F.col("old.times_seen") + 1), F.lit(1)) * F.col("k")
    history = both.where(met).groupBy(F.col("new.secret_hash").alias("secret_hash"), F.col("new.rule_id").alias("rule_id")).agg(F.min(F.coalesce(F.when(known, F.col("old.first_seen")), F.lit(now))).alias("h_first"), F.sum(times).cast("int").alias("h_times"))
    valid = live.select("secret_hash", F.struct(F.col("valid").cast("boolean").alias("valid"), "source", "checked_at").alias("ext"))
    told = current.drop("first_seen", "times_seen", "external_validation", "status").join(history, ["secret_hash", "rule_id"]).join(valid, "secret_hash", "left")
    confirmed = F.coalesce(F.col("ext.valid"), F.lit(False))
    told = told.withColumns({
        "severity": F.when(confirmed, "critical").otherwise(F.col("severity")), "confidence": F.when(confirmed, "high").otherwise(F.col("confidence")),
        "status": F.when(F.col("h_first") < now, "recurring").otherwise("new"), "first_seen": F.col("h_first"), "times_seen": F.col("h_times"), "external_validation": F.col("ext"),
    }).drop("h_first", "h_times", "ext")
    gone = both.where(closing).select("old.*").join(valid, "secret_hash", "left")
    ended = gone.select(
        F.sha2(F.concat_ws("/", F.lit(scan_id), "fingerprint"), 256).alias("finding_id"), "issue_key", "issue_url", "field_path", "rule_id", "severity", "confidence", "redacted_secret", "secret_hash", "snippet",
        F.col("last_seen").alias("detected_at"), F.lit(VERSION).alias("scanner_version"), F.coalesce(F.from_json("locations_json", PLACES), F.array().cast(PLACES)).alias("locations"), "source_type", F.lit("closed").alias("status"), "username",
        F.coalesce(F.from_json("references_json", "array<string>"), F.array().cast("array<string>")).alias("references"), "first_seen", "times_seen", F.col("ext").cast(EXTERNAL).alias("external_validation"),
    )
    return table, told.withColumn("external_validation", F.col("external_validation").cast(EXTERNAL)).unionByName(ended, allowMissingColumns=True)


def audit(scans: DataFrame, run: DataFrame) -> DataFrame:
    """The scans table with a run added; a scan_id met again keeps the origin and query it was first stored with."""
    fixed_columns = ["origin", "query"]
    rest = [c for c in scans.columns if c not in ("scan_id", *fixed_columns)]
    both = run.alias("n").join(scans.alias("o"), "scan_id", "left")
    new = both.select("scan_id", *(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in fixed_columns), *(F.col(f"n.{c}").alias(c) for c in rest))
    return scans.join(run, "scan_id", "left_anti").select(*scans.columns).unionByName(new.select(*scans.columns))
