"""Exact duplicates by an extendible-hash index whose pages lie in shared files.

A text's key is a prefix of its digest. The index is a directory over the leading bits of keys, which doubles where a full
bucket is as deep as it, and buckets, each a range of keys with one owner task. In a bucket, texts with one key form a
chain, in which only equal bytes make two texts the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, maybe_among

#: Characters that don't count: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: Bits of a key, at most those of 15 hexadecimal digits.
KEY_BITS = 60
#: Entries that a bucket holds before it is split. Beyond MOST_BUCKETS of them, buckets hold more instead: the directory goes to
#: every task, and owners read their buckets in order of keys, so no bucket needs to fit in memory.
CAPACITY, MOST_BUCKETS = 1024, 1 << 14
#: Bytes of texts that a task combines before it sends them on.
COMBINED = 32 << 20

ENTRY = "key long, n long, points long, place long, digest binary, text string"
PAGE = "bucket int, key long, chain int, n long, points long, place long, digest binary"
#: The place of a null id in the order of ids.
LAST = 2**63 - 1


def normalised(text: Column) -> Column:
    """A text without its white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def keyed(docs: DataFrame, bits: int, *more: str) -> DataFrame:
    """key, digest, points and place (-doc_id) of every row, and ``more`` columns. The greatest (points, place) is the row that stays."""
    bare = docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("points"), normalised(F.col("text")).alias("text"))
    hexed = bare.withColumn("hexed", F.sha2("text", 256))
    key = F.shiftright(F.conv(F.substring("hexed", 1, 15), 16, 10).cast("long"), 60 - bits)
    return hexed.select(key.alias("key"), F.unhex("hexed").alias("digest"), "points", (-F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).alias("place"), *more)


def directory(cells: np.ndarray, capacity: int) -> np.ndarray:
    """The directory over counts of keys by their leading bits (a power of two of cells): each slot's bucket, by ordinal in order of keys.

    It begins as one slot with one bucket. A bucket with too many keys is split by its next bit; one that is as deep as the
    directory doubles it first. Where the cells are told apart no further, a bucket keeps what it has.
    """
    deepest = len(cells).bit_length() - 1
    before = np.concatenate(([0], np.cumsum(cells)))
    slots, depth, waiting = np.zeros(1, np.int64), 0, [(0, 0)]  # a bucket is (prefix, local depth), and named by its first cell
    for prefix, local in waiting:
        wide = deepest - local
        if local == deepest or before[(prefix + 1) << wide] - before[prefix << wide] <= capacity:
            continue
        if local == depth:
            slots, depth = np.repeat(slots, 2), depth + 1
        half = depth - local - 1
        slots[(2 * prefix + 1) << half : (2 * prefix + 2) << half] = (2 * prefix + 1) << (wide - 1)
        waiting += [(2 * prefix, local + 1), (2 * prefix + 1, local + 1)]
    return np.unique(slots, return_inverse=True)[1]


class Chains:
    """Texts by key: a key's chain holds its different texts, each with what its rows have in common."""

    def __init__(self):
        self.by_key: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, key: int, n: int, points: int, place: int, digest: bytes, text: str) -> None:
        chain = self.by_key.setdefault(key, [])
        raw = text.encode()
        for link in chain:
            if link[4] == raw:
                link[0], (link[1], link[2]) = link[0] + n, max((link[1], link[2]), (points, place))
                return
            if link[3] == digest:
                raise ValueError("two texts have one SHA-256 digest")
        chain.append([n, points, place, digest, raw])
        self.bytes += len(raw) + 200

    def taken(self) -> pd.DataFrame:
        """All entries; none are left."""
        rows = [(key, n, points, place, digest, raw.decode()) for key, chain in self.by_key.items() for n, points, place, digest, raw in chain]
        self.by_key, self.bytes = {}, 0
        return pd.DataFrame(rows, columns=["key", "n", "points", "place", "digest", "text"])


def combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One entry for each text that a task meets, so that thousands of copies are sent once."""
    chains = Chains()
    for batch in batches:
        for key, digest, points, place, text in zip(batch["key"], batch["digest"], batch["points"], batch["place"], batch["text"], strict=True):
            chains.add(key, 1, points, place, digest, text)
            if chains.bytes > COMBINED:
                yield chains.taken()
    yield chains.taken()


def owned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """An owner task: entries of its buckets in order of keys, those of keys that occur once first, and the pages that they make."""
    now, alone, chains, rows = (0, -1), False, Chains(), []
    columns = [c.split(" ")[0] for c in PAGE.split(", ")]

    def close() -> None:
        rows.extend((*now, place, *link[:4]) for place, link in enumerate(chains.by_key.pop(now[1], ())))

    for batch in batches:
        for bucket, key, n, points, place, digest, text in zip(*(batch[c] for c in ("bucket", "key", "n", "points", "place", "digest", "text")), strict=True):
            if (bucket, key) != now:
                close()
                now, alone = (bucket, key), text is None
                if alone:
                    rows.append((bucket, key, 0, n, points, place, digest))
            if not alone:  # else the filter let a text through whose key occurs once
                chains.add(key, n, points, place, digest, text)
        if rows:
            yield pd.DataFrame(rows, columns=columns)
            rows.clear()
    close()
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def index(docs: DataFrame, rows: DataFrame, stages: Stages, bits: int, capacity: int) -> DataFrame:
    """The index's pages for ``docs``, whose ``keyed`` rows are at hand: one entry per different text.

    Texts are read again and sent only where their key occurs more than once, and one of each from each task.
    """
    whole = rows.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("points", "place", "digest")).alias("of"))
    keys, seen = stages.kept(whole, "keys", {"keys": F.count("*"), "repeated": F.count_if(F.col("n") > 1)})
    capacity = max(capacity, -(-seen["keys"] // MOST_BUCKETS))
    depth = min(bits, (16 * seen["keys"] // capacity).bit_length())
    counted = keys.groupBy(F.shiftright("key", bits - depth).cast("int").alias("cell")).agg(F.count("*").alias("n")).collect()  # at most 32 * MOST_BUCKETS
    cells = np.zeros(1 << depth, np.int64)
    for cell, n in counted:
        cells[cell] = n
    slots = directory(cells, capacity)
    known = docs.sparkSession.createDataFrame(pd.DataFrame({"slot": np.arange(len(slots), dtype="int64"), "bucket": slots.astype("int32")}))
    alone = keys.where("n = 1").select("key", "n", "of.points", "of.place", "of.digest", F.lit(None).cast("string").alias("text"))
    texts = maybe_among(keyed(docs, bits, "text"), "key", keys.where("n > 1").select(F.col("key").alias("wanted")), "wanted", seen["repeated"])
    entries = alone.unionByName(texts.mapInPandas(combined, ENTRY))
    slot = F.shiftright("key", bits - (len(slots).bit_length() - 1))
    placed = entries.withColumn("slot", slot).join(F.broadcast(known), "slot").drop("slot")
    return placed.repartitionByRange("bucket").sortWithinPartitions("bucket", "key", F.col("text").isNotNull()).mapInPandas(owned, PAGE)


def exact_groups(docs: DataFrame, stages: Stages, bits: int = KEY_BITS, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Texts are equal when their bytes are, after all white space is deleted; null is empty. Of equal texts the row with the most
    code points stays, then the one with the smallest doc_id (a null one last); rows that repeat both are told the same. An empty
    table gives an empty result. Copies are combined before anything is shuffled by key, and the rows of one text meet their entry
    in a join of two written tables, which Spark can split.
    """
    rows = stages.keep(keyed(docs, bits, "doc_id"), "keyed")
    pages = stages.keep(index(docs, rows, stages, bits, capacity), "pages")
    kept = pages.select("digest", F.col("n").alias("group_size"), F.col("points").alias("_points"), F.col("place").alias("_place"))
    met = rows.join(kept, "digest")
    keep_id = F.when(F.col("_place") != -LAST, -F.col("_place"))
    return met.select("doc_id", keep_id.alias("keep_id"), "group_size", ((F.col("points") == F.col("_points")) & (F.col("place") == F.col("_place"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, stages: Stages) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows with one id and text, one."""
    verdict = exact_groups(docs, stages).where("kept").select(F.col("doc_id").alias("_id"), "text_sha256").distinct()
    named = docs.withColumn("_sha", F.sha2(normalised(F.col("text")), 256)).withColumn("_points", F.char_length(F.coalesce("text", F.lit(""))))
    met = named.join(verdict, named["doc_id"].eqNullSafe(verdict["_id"]) & (named["_sha"] == verdict["text_sha256"]), "left_semi")
    best = met.groupBy("doc_id", "_sha").agg(F.max_by(F.struct(*docs.columns), "_points").alias("row"))
    return best.select("row.*")
