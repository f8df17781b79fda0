"""From records to text segments: the rows that detectors read."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import columns as C
from ..functions import fixed


_surrogate = re.compile("[\ud800-\udfff]")


def leaves(value: object, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, text) of every string in a JSON value: keys in sorted order, elements by index. A string with an escaped lone surrogate is no text."""
    stack = [(path, value)]
    while stack:
        at, item = stack.pop()
        if isinstance(item, str):
            if not _surrogate.search(item):
                yield at, item
        elif isinstance(item, dict):
            stack.extend((f"{at}.{k}" if at else k, item[k]) for k in sorted((k for k in item if not _surrogate.search(k)), key=lambda k: k.encode(), reverse=True))
        elif isinstance(item, list):
            stack.extend((f"{at}[{i}]", item[i]) for i in range(len(item) - 1, -1, -1))


WALKED = "issue_key string, seg_ord long, field_path string, text string, error string"


def walk_all(records: DataFrame, root: str = "", max_kb: int = 2048, key: str | None = None) -> DataFrame:
    """Segments of records (issue_key, fields as JSON text), below ``root``; a column ``root`` gives each row its own. ``key`` names the one part that is walked.

    Null JSON and null parts give no segments; empty strings give empty segments. What can't be read gives one row with an ``error`` and no text.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, text, at in zip(batch["issue_key"], batch["fields"], batch["root"], strict=True):
                try:
                    value = json.loads(text) if text is not None else None
                except (ValueError, RecursionError) as error:  # no JSON, or nested beyond what can be read
                    rows.append((name, None, at, None, f"record: {'too deep' if isinstance(error, RecursionError) else 'no JSON'}"))
                    continue
                if key is not None:
                    value = value.get(key) if isinstance(value, dict) else None
                rows.extend((name, i, path, leaf, None) for i, (path, leaf) in enumerate(leaves(value, at)))
            yield pd.DataFrame(rows, columns=["issue_key", "seg_ord", "field_path", "text", "error"]).astype({"seg_ord": "Int64"})

    own = F.col("root") if "root" in records.columns else F.lit(root).alias("root")
    walked = records.select("issue_key", "fields", own).mapInPandas(each, WALKED)
    return walked.withColumn("text", C.truncate_bytes(F.col("text"), max_kb * 1024)).withColumn("source_type", C.classify_path(F.col("field_path")))


def walk(records: DataFrame, root: str = "", max_kb: int = 2048, key: str | None = None) -> DataFrame:
    """``walk_all`` without the errors: unreadable JSON gives no segments."""
    return walk_all(records, root, max_kb, key).where("error IS NULL").drop("error")


def raw_segment(rows: DataFrame, issue_key: Column, path: Column, text: Column, kind: Column | None = None, order: Column | None = None, max_kb: int | None = 2048) -> DataFrame:
    """One segment per row, its text cut like any other, or whole if there is no limit."""
    text = text if max_kb is None else C.truncate_bytes(text, max_kb * 1024)
    return rows.select(issue_key.alias("issue_key"), (F.lit(0) if order is None else order).cast("long").alias("seg_ord"), path.alias("field_path"), text.alias("text"), (C.classify_path(path) if kind is None else kind).alias("source_type"))


def union(payload: DataFrame, comments: DataFrame, attachments: DataFrame) -> DataFrame:
    """All segments, numbered per record: payload first, then later comment pages, then attachments. Rows with an ``error`` follow those."""
    parts = [part.withColumn("_origin", F.lit(i)) for i, part in enumerate((payload, comments, attachments))]
    whole = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    last = [F.col("error").isNotNull()] if "error" in whole.columns else []
    place = F.row_number().over(W.partitionBy("issue_key").orderBy(*last, "_origin", "seg_ord", "field_path")) - 1
    return whole.withColumn("seg_ord", place.cast("long")).drop("_origin")


def comment_paging(fields: Column) -> Column:
    """struct(total, next): what the payload says of its comments, zeros where it says nothing."""
    total = F.coalesce(F.get_json_object(fields, "$.comment.total").cast("long"), F.lit(0).cast("long"))
    start = F.coalesce(F.get_json_object(fields, "$.comment.startAt").cast("long"), F.lit(0).cast("long"))
    held = F.coalesce(F.json_array_length(F.get_json_object(fields, "$.comment.comments")).cast("long"), F.lit(0).cast("long"))
    return F.struct(total.alias("total"), F.when(total > 0, start + held).otherwise(F.lit(0).cast("long")).alias("next"))


def as_it_is(frame: DataFrame, name: str) -> DataFrame:
    """In place of ``Stages.keep``, where a table that is read several times is not written."""
    return frame


def paged_records(records: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = as_it_is) -> DataFrame:
    """issue_key, next and total of the records whose payload doesn't hold all of their comments. ``keep`` writes what payloads say, before it is looked at."""
    said = keep(records.select("issue_key", comment_paging(F.col("fields")).alias("page")), "paging")
    return said.where("page.next < page.total").select("issue_key", "page.next", "page.total")


def _wanted(comments: DataFrame, paged: DataFrame) -> DataFrame:
    """The comments that records still need, up to the paging bound."""
    bound = F.least(F.col("total"), F.col("next") + fixed.COMMENT_PAGE * fixed.COMMENT_PAGES)
    return comments.join(paged, "issue_key").where((F.col("pos") >= F.col("next")) & (F.col("pos") < bound))


def later_comments(records: DataFrame, comments: DataFrame, max_kb: int = 2048, paged: DataFrame | None = None) -> DataFrame:
    """Segments of comments (issue_key, pos, and body, or comment as JSON text) beyond those that a record's payload holds, up to the paging bound. ``paged`` is ``paged_records``, if it is at hand.

    A plain body is one segment; a comment as JSON is walked like a field, so a structured body gives the same paths as in the payload.
    A comment that can't be read is a row with an error.
    """
    joined = _wanted(comments, paged_records(records) if paged is None else paged)
    path = F.format_string("comment.comments[%d].body", F.col("pos"))
    if "comment" in comments.columns:
        walked = walk_all(joined.select("issue_key", F.col("comment").alias("fields"), path.alias("root")), max_kb=max_kb, key="body")
        place = F.regexp_extract("field_path", "^comment\\.comments\\[([0-9]+)\\]", 1).cast("long")
        return walked.withColumn("seg_ord", place * F.lit(1 << 20) + F.col("seg_ord"))  # comments in order of place, each in order of its walk
    return raw_segment(joined, F.col("issue_key"), path, F.col("body"), F.lit("comment"), F.col("pos"), max_kb).withColumn("error", F.lit(None).cast("string"))


def missing_comments(records: DataFrame, comments: DataFrame | None, paged: DataFrame | None = None) -> DataFrame:
    """(issue_key, error) of the records some of whose comments were not read.

    Fetched comments say so themselves, by a row with an ``error``: a thread that ends early lost comments in the meantime. Of landed ones every place has to be
    there, up to the paging bound; without a table of them, all are missing.
    """
    if comments is not None and "error" in comments.columns:
        return comments.where("error IS NOT NULL").select("issue_key", "error")
    paged = paged_records(records) if paged is None else paged
    wanted = F.least(F.col("total") - F.col("next"), F.lit(fixed.COMMENT_PAGE * fixed.COMMENT_PAGES)).cast("long")
    if comments is None:
        return paged.select("issue_key", F.format_string("comments: %d not at hand", wanted).alias("error"))
    held = _wanted(comments, paged).groupBy("issue_key").agg(F.countDistinct("pos").alias("held"))
    short = wanted - F.coalesce("held", F.lit(0))
    return paged.join(held, "issue_key", "left").where(short > 0).select("issue_key", F.format_string("comments: %d not at hand", short).alias("error"))


def listed_attachments(records: DataFrame, base: str) -> DataFrame:
    """The attachments that records list in their payload: issue_key, pos, name, mime, size, url, base.

    Every entry is read by itself. One without a name or a link, or with a size that is no whole number, is malformed; the others are not touched by it.
    """
    each = F.from_json(F.get_json_object("fields", "$.attachment"), "array<string>")
    listed = records.select("issue_key", F.posexplode(each).alias("pos", "a")).select("issue_key", F.col("pos").cast("long").alias("pos"), *(F.get_json_object("a", f"$.{key}").alias(name) for name, key in (("name", "filename"), ("mime", "mimeType"), ("said", "size"), ("url", "content"))))
    size = F.expr("try_cast(said AS BIGINT)")
    return listed.select("issue_key", "pos", "name", "mime", F.coalesce(size, F.lit(0)).alias("size"), "url", F.lit(base).alias("base"), (F.col("name").isNull() | F.col("url").isNull() | (F.col("said").isNotNull() & size.isNull())).alias("malformed"))


def gated_by(listed: DataFrame, per_file: int) -> DataFrame:
    """Attachments with what the gate says in ``_gate``."""
    bad = F.col("malformed") if "malformed" in listed.columns else F.lit(False)
    return listed.withColumn("_gate", gate(per_file, bad))


def gate(per_file: int, malformed: Column) -> Column:
    """What decides on an attachment (name, mime, size, url, base) before its body is asked for: failed, skip, or null."""
    kept = C.attachment_verdict(F.col("name"), F.col("mime"))
    return F.when(malformed, "failed").when(kept == "skip", "skip").when(~C.same_origin(F.col("url"), F.col("base")), "skip").when(F.col("size") > per_file, "skip")


def attached(listed: DataFrame, bodies: DataFrame | None, per_file: int, max_kb: int = 2048, keep: Callable[[DataFrame, str], DataFrame] = as_it_is) -> tuple[DataFrame, DataFrame]:
    """(segments, attachments with their outcome): the bodies that the gate and the budgets let through.

    Landed bodies (issue_key, pos, text) are judged by the sizes that records list; one that should be scanned and isn't at hand has
    failed, with an error. Fetched ones (``fetching.bodies``) come with their outcome, size and error. ``keep`` writes the list and what the
    budgets say of it, as each is read several times.
    """
    if bodies is not None and "outcome" in bodies.columns:
        met = listed.drop("size").join(bodies.withColumnRenamed("bytes", "size"), ["issue_key", "pos"])
    else:
        gated = keep(budgeted(keep(gated_by(listed, per_file), "listed"), per_file), "budgeted")
        text = bodies.select("issue_key", "pos", "text") if bodies is not None else gated.select("issue_key", "pos", F.lit(None).cast("string").alias("text"))
        met = gated.join(text, ["issue_key", "pos"], "left")
        lost = (F.col("outcome") == "scan") & F.col("text").isNull()
        met = met.withColumn("error", F.when(lost, "attachment: not at hand")).withColumn("outcome", F.when(lost, "failed").otherwise(F.col("outcome")))
    return raw_segment(met.where("outcome = 'scan'"), F.col("issue_key"), attachment_path(F.col("name")), F.col("text"), F.lit("attachment"), F.col("pos"), max_kb), met.drop("text")


def attachment_path(name: Column) -> Column:
    """A segment's path for an attachment: one line, at most 128 characters of its name."""
    clean = F.trim(F.substring(F.translate(C.terminal(F.coalesce(name, F.lit(""))), "\n\r\t", "   "), 1, 128))
    return F.concat(F.lit("attachment["), F.when(clean == "", "unnamed").otherwise(clean), F.lit("]"))


#: Places of a record whose attachments are thinned together.
STRETCH = 1024


def budgeted(attachments: DataFrame, per_file: int, count: int = fixed.ATTACHMENTS_PER_ISSUE, total: int = fixed.ATTACHMENT_BYTES) -> DataFrame:
    """attachments (issue_key, pos, name, mime, size, url, base) with ``outcome``: skip, over, failed, stop or scan.

    A sequential rule: a body larger than what is left fails and uses up nothing, so a later, smaller one may
    still fit. What is left never grows, so a body that is taken has had all smaller ones before it taken too: one with ``count`` of those before it
    is out. That thins each stretch of places by itself; what is left of a record is folded in order of place, with no more in hand than what it takes.
    """
    rows = attachments if "_gate" in attachments.columns else gated_by(attachments, per_file)
    asked = rows.where(F.col("_gate").isNull()).select("issue_key", F.struct("pos", F.col("size").cast("long").alias("size")).alias("item"))
    inf = F.lit((1 << 63) - 1)

    def thin(acc: Column, x: Column) -> Column:
        odd = x["size"].isNull() | (x["size"] < 0)  # after these, more may be left than before
        few = F.size(acc["least"]) < count
        keep = odd | few | (x["size"] < F.element_at(acc["least"], -1))
        least = F.when(odd, F.array().cast("array<bigint>")).when(keep, F.slice(F.sort_array(F.concat(acc["least"], F.array(x["size"]))), 1, count)).otherwise(acc["least"])
        return F.struct(least.alias("least"), F.when(keep, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        over = F.coalesce(acc["used"] >= total, F.lit(False))
        took = (F.size(acc["taken"]) < count) & ~over & ~F.coalesce(x["size"] > total - acc["used"], F.lit(False))
        used = F.when(took, acc["used"] + x["size"]).otherwise(acc["used"])
        at = lambda name, now: F.coalesce(acc[name], F.when(took & now, x["pos"].cast("long")))
        return F.struct(used.alias("used"), F.when(took, F.concat(acc["taken"], F.array(x["pos"].cast("long")))).otherwise(acc["taken"]).alias("taken"), at("stop", F.size(acc["taken"]) + 1 >= count).alias("stop"), at("over", used >= total).alias("over"))

    items, nothing = F.sort_array(F.collect_list("item")), F.lit(None).cast("long")
    stretches = asked.groupBy("issue_key", F.floor(F.col("item.pos") / STRETCH).alias("_stretch")).agg(items.alias("items"))
    thinned = stretches.select("issue_key", F.explode(F.aggregate("items", F.struct(F.array().cast("array<bigint>").alias("least"), F.array().cast("array<struct<pos:bigint,size:bigint>>").alias("kept")), thin)["kept"]).alias("item"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("taken"), nothing.alias("stop"), nothing.alias("over"))
    folded = thinned.groupBy("issue_key").agg(items.alias("items")).select("issue_key", F.aggregate("items", start, step).alias("_f"))
    behind = lambda name: F.col("pos") > F.coalesce(F.col(f"_f.{name}"), inf)
    outcome = F.when(F.lit(count <= 0) | behind("stop"), "stop").when(F.col("_gate").isNotNull(), F.col("_gate")).when(F.lit(total <= 0) | behind("over"), "over").when(F.array_contains("_f.taken", F.col("pos").cast("long")), "scan").otherwise("failed")
    return rows.join(folded, "issue_key", "left").withColumn("outcome", outcome).drop("_gate", "_f")


def read_bodies(spark, path: str, max_bytes: int) -> DataFrame:
    """Landed attachment bodies: path, text (lossy UTF-8) of at most ``max_bytes``, and whether they were cut."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.make_valid_utf8(F.substring("content", 1, max_bytes).cast("string")).alias("text"), (F.col("length") > max_bytes).alias("truncated"))
