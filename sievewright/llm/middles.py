"""Fill-in-middle transformation: texts cut at two ranks of units, which an indexable skip list turns into code points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StructField, StructType

CUTS = StructType([StructField(name, LongType()) for name in ("n", "first", "second")])
MARKERS = ("<P>", "<S>", "<M>")


class Towers:
    """Which nodes reach which express lane: the same for every text, so a worker computes them once and lets them grow.

    A node reaches the next lane with a chance of a quarter, decided by a hash of its ordinal. ``lanes[k]`` has the ordinals
    on lane k + 1 (the head, 0, is on all), ``below[k]`` their places among the nodes of the lane below.
    """

    def __init__(self):
        self.size, self.lanes, self.below = 0, [], []

    def reach(self, n: int) -> None:
        """Make sure that ordinals up to ``n`` have their heights."""
        if n <= self.size:
            return
        self.size = max(2 * self.size, n, 4096)
        mixed = np.arange(1, self.size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        self.lanes, self.below, on = [], [], np.arange(self.size + 1, dtype=np.int32)
        while len(on) > 4:
            up = np.flatnonzero(np.r_[True, mixed[on[1:] - 1] & np.uint64(3) == 0]).astype(np.int32)
            mixed >>= np.uint64(2)
            self.below.append(up)
            on = on[up]
            self.lanes.append(on)


_towers = Towers()


class SkipList:
    """An indexable skip list over the units of one text.

    Lane 0 links every unit to the next, each express lane only the nodes that reach it. A link carries two widths: the units
    and the code points that it leaps over. ``ends`` are the code points before the end of each unit.
    """

    def __init__(self, ends: np.ndarray):
        self.n = len(ends)
        _towers.reach(self.n)
        places = np.concatenate(([0], ends))
        self.units, self.points, self.below = [np.ones(self.n, np.int32)], [np.diff(places)], []
        for lane, below in zip(_towers.lanes, _towers.below, strict=True):
            on = lane[: np.searchsorted(lane, self.n, "right")]
            if len(on) < 2:
                break
            self.units.append(np.diff(on))
            self.points.append(np.diff(places[on]))
            self.below.append(below)

    def before(self, rank: int) -> int:
        """The code points of the first ``rank`` units: lanes are left downwards where the next link would leap too far."""
        at = units = points = 0
        for lane in range(len(self.units) - 1, -1, -1):
            wide, long = self.units[lane], self.points[lane]
            while at < len(wide) and units + wide[at] <= rank:
                units, points, at = units + int(wide[at]), points + int(long[at]), at + 1
            if lane:
                at = int(self.below[lane - 1][at])
        return points


def unit_ends(text: str) -> np.ndarray:
    """Where each unit of a text ends: a unit is white space and the word behind it; white space behind the last word is one too."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    word = (points != 0x20) & ((points < 0x09) | (points > 0x0D))
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    return np.append(ends, len(points)) if len(points) else ends


@pandas_udf(CUTS)
def cuts(text: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Units of a text, and the code points before its two cuts, at ranks ``a`` and ``b`` modulo one more than the units."""
    rows = []
    for t, x, y in zip(text, a, b, strict=True):
        units = SkipList(unit_ends(t))
        low, high = sorted((int(x) % (units.n + 1), int(y) % (units.n + 1)))
        rows.append((units.n, units.before(low), units.before(high)))
    return pd.DataFrame(rows, columns=["n", "first", "second"]).astype("int64")


def drawn(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits for a document: the first groups of eight digits of a SHA-256 in hexadecimal."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made from: a text with a marker is plain, so each marker stands in an output once."""
    prefix, suffix, middle = markers
    cut = lambda x, mark: (F.substring_index(x, mark, 1), F.substring_index(x, mark, -1))
    head, mid = cut(output, middle)
    before, last = cut(head, suffix)
    psm = F.concat(F.substring_index(before, prefix, -1), mid, last)
    before, last = cut(head, prefix)
    spm = F.concat(last, mid, F.substring_index(before, suffix, -1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row of ``docs``.

    All choices come from ``seed`` and the doc_id: ``percent`` of the documents are transformed, ``spm_percent`` of those with
    the suffix first. A text that is null, empty or holds a marker stays plain and has no lengths. Rows with one doc_id are cut at
    the same ranks, modulo their units; a null doc_id counts as an empty one; an empty table gives an empty result.
    No row needs another: nothing is shuffled, and texts go to Python only to be counted.
    """
    ends = [(a, b[i:]) for a in markers for b in markers for i in range(len(b)) if a != b or i]
    if len(set(markers)) < 3 or any(a.startswith(end) or end.startswith(a) for a, end in ends):
        raise ValueError(f"markers overlap: {', '.join(markers)}")
    h1, h2, h3, h4 = drawn(F.col("doc_id"), seed)
    text = F.coalesce("text", F.lit(""))
    marked = [F.contains(F.col("text"), F.lit(m)) for m in markers]
    plain = (F.col("text") == "") | marked[0] | marked[1] | marked[2] | (h3 % 100 >= percent)
    cut = docs.select("doc_id", text.alias("text")).withColumn("cut", cuts("text", h1, h2))
    formed = cut.withColumn("form", F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm"))
    first, second = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    parts = formed.select("*", F.substr("text", F.lit(1), first).alias("p"), F.substr("text", first + 1, second - first).alias("m"), F.substr("text", second + 1).alias("s"))
    prefix, suffix, middle = map(F.lit, markers)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(prefix, "p", suffix, "s", middle, "m")).otherwise(F.concat(suffix, "s", prefix, "p", middle, "m"))
    length = lambda value: F.when(F.col("form") != "plain", value)
    return parts.select("doc_id", F.col("cut.n").alias("n"), "form", length(F.col("cut.first")).alias("prefix_chars"), length(F.col("cut.second") - F.col("cut.first")).alias("middle_chars"), output.alias("output"))
