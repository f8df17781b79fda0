"""Exact Jaccard links between documents' word shingles, by a grouped prefix join.

Two sets of shingles with Jaccard similarity t or more share an element among the first ``n - ceil(t * n) + 1`` of each,
in any order common to all. The order used puts frequent shingles last, so that documents which merely share a
passage seldom become candidates.

* Documents with equal sets form one class; classes of equal size and prefix form one group. Only groups are posted under
  their prefix elements; a worker posts a group once however many copies it reads.
* Pairs of groups pass a size filter, a position filter (the first shared element bounds the overlap) and a bitmap filter: every
  element flips one of BITS bits, so the bitmaps of two sets differ in at most as many bits as the sets differ in elements. A
  group holds the bits that all its members have and those that any has; bits that all of one group and none of
  the other have bound every pair of members from below.
* First pass: every member of a group is held against the group's first class, every group's first class against that of the
  nearest leader and of the nearest of the BEFORE groups just before it in one of its buckets (by position, size and id; nearest by a
  64-bit sketch first, then by bitmap). A bucket's leader is the group in which the bucket's element comes first: of a group of near
  copies the most typical. Components of those links stand for what is already connected.
* Merging: the members of a group that lie in one component are a unit. Units of a large bucket are dealt by a hash to slots of SLOT
  units on average, and those of different components that meet in a slot are compared; of two components the nearest such pair is
  verified. Two large components with many links between them become one here, by work in proportion to the bucket.
* Second pass: in every bucket the units outside its main component
  are paired with all units of other components, those of the same group included; pairs that pass the filters are
  expanded to their members, which pass the bitmap filter again and are verified. Any link between components appears here, so none is
  lost; pairs inside a component, which would grow with the square of a group of near copies, are never formed.

How frequent shingles are is learned from all documents: chunks of documents report shingles that occur in several of
them, those counts are added, and their logarithms are written into a table of LEVELS hashed cells, one byte each (a fixed bound). The
table changes only the order, so what it says never changes the result. Buckets of frequent shingles are salted in the first pass, each
anew, so that groups which one bucket parts meet in another; in the second, a bucket is on both sides of a plain inner join, which Spark
splits where it is skewed.

Sets and prefixes are told apart by 128-bit digests; shingles are compared by 64-bit hashes when candidates are made, and links are
verified on the texts' shingles themselves.

Defined results: null and empty texts have no shingles and stay alone; a text with fewer words than a shingle
is one shingle; repeated rows each get a row; a null doc_id takes part and counts as no id (its component takes
the smallest other id, or null); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Stages, id_in, id_out, maybe_among, row_key, words
from .components import components

#: Cells of the table of frequencies, of a byte each, and cells in one of its rows.
LEVELS, CELLS = 1 << 24, 1 << 14
#: Shingles of a counting chunk, and the documents of it that must share a shingle for it to be reported.
CHUNK, REPORTED = 4_000_000, 2
#: Bits of a set's bitmap, as so many longs.
BITS, LONGS = 512, 8
#: Groups just before it in a bucket among which the first pass looks for one like it. It decides only what the second pass is left with.
BEFORE = 16
#: Units that meet in a slot of a large bucket, on average, and the groups from which on a bucket is large. It decides only what the second pass is left with.
SLOT = 16
#: Logarithm of a frequency from which on a bucket is salted.
SALTED = 10
#: Postings of a frequent shingle in one task, on average.
PART = 50_000


def shingle_words(text: str | None) -> list[bytes]:
    """Lower-cased (A to Z only) words; bytes.split knows just the six ASCII spaces."""
    return text.encode().lower().split() if text else []


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """The distinct k-word shingles as sorted 64-bit hashes; a shorter text is one shingle of its own kind."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - k + 1
    out = each[:n].copy()
    for j in range(1, k):
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += each[j : n + j]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def exact_shingles(words: list[bytes], k: int) -> set[bytes]:
    """The distinct shingles themselves."""
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def digest(content: bytes, n: int = 0) -> tuple[int, int]:
    """A 128-bit digest as two signed longs."""
    raw = hashlib.blake2b(content, digest_size=16, salt=n.to_bytes(8, "little")).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def repeated(chunk: np.ndarray) -> pa.RecordBatch:
    """The shingles that occur REPORTED times or more in a chunk, and how often; sorts the chunk."""
    chunk.sort()
    same = np.zeros(len(chunk) + 1, bool)  # as the one before
    np.equal(chunk[1:], chunk[:-1], out=same[1:-1])
    edges = np.flatnonzero(same[1:] != same[:-1])  # the first and the last place of every run of two or more
    counts = edges[1::2] - edges[::2] + 1
    often = counts >= REPORTED
    return pa.RecordBatch.from_arrays([pa.array(chunk[edges[::2][often]].view(np.int64)), pa.array(counts[often], pa.int64())], names=["shingle", "n"])


def frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """The logarithm of how often a shingle was counted over all documents, by hashed cell (the largest where several meet)."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a chunk is one array that is sorted where it lies: a worker holds it once
        held, n = np.empty(CHUNK, np.uint64), 0
        for batch in batches:
            for text in batch.column("text"):
                own = shingles(shingle_words(text.as_py()), k)
                if n + len(own) > len(held):
                    yield repeated(held[:n])
                    n = 0
                if len(own) > len(held):
                    held = np.empty(len(own), np.uint64)
                held[n : n + len(own)] = own
                n += len(own)
        if n:
            yield repeated(held[:n])

    def rows(group: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros(CELLS, np.uint8)
        np.maximum.at(cells, group["cell"].to_numpy(), group["level"].to_numpy().astype(np.uint8))
        return pd.DataFrame({"row": group["row"].iloc[:1], "cells": [cells.tobytes()]})

    sums = docs.select("text").mapInArrow(report, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    at = F.col("shingle").bitwiseAND(F.lit(LEVELS - 1))
    levels = sums.groupBy(F.shiftright(at, 14).cast("int").alias("row"), at.bitwiseAND(F.lit(CELLS - 1)).cast("int").alias("cell")).agg(F.max(F.floor(F.log2("n"))).cast("int").alias("level"))
    table = np.zeros(LEVELS, np.uint8)
    for r in levels.groupBy("row").applyInPandas(rows, "row int, cells binary").collect():  # at most LEVELS / CELLS rows of CELLS bytes
        table[r["row"] * CELLS : (r["row"] + 1) * CELLS] = np.frombuffer(r["cells"], np.uint8)
    return table


def bitmap(elements: np.ndarray) -> np.ndarray:
    """BITS bits as longs: a bit is set if an odd number of elements fall on it."""
    odd = np.bincount((elements >> np.uint64(50)).astype(np.int64) & (BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


#: A set's bitmap as columns.
MAP = [f"b{i}" for i in range(LONGS)]


def profiles(docs: DataFrame, k: int, percent: int, table: Broadcast) -> DataFrame:
    """doc_id, row_key, n, digests of set (d1, d2) and group (g1, g2), bitmap, light and prefix of every document.

    A worker gives the bitmap of a set and the prefix of a group once; they are null where it gave them before.
    """

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[tuple[int, int]] = set()
        levels, none = table.value, (None,) * LONGS
        for batch in batches:
            rows = []
            for doc, key, text in zip(batch["doc_id"], batch["row_key"], batch["text"], strict=True):
                own = shingles(shingle_words(text), k)
                n = len(own)
                if not n:
                    rows.append((doc, key, 0, None, None, None, None, *none, None, None))
                    continue
                level = levels[(own & np.uint64(LEVELS - 1)).astype(np.int64)]
                first = np.lexsort((own, level))[: prefix_size(n, percent)]
                prefix = own[first].view(np.int64)
                whole, group = digest(own.tobytes()), digest(prefix.tobytes(), n)
                bits, posted = none if whole in met else bitmap(own).tolist(), group in met
                met |= {whole, group}
                rows.append((doc, key, n, *whole, *group, *bits, None if posted else int((level[first] < SALTED).sum()), None if posted else prefix))
            out = pd.DataFrame(rows, columns=["doc_id", "row_key", "n", "d1", "d2", "g1", "g2", *MAP, "light", "prefix"], dtype=object)
            yield out.astype({"doc_id": "int64", "row_key": "int64", "n": "int64", **dict.fromkeys(("d1", "d2", "g1", "g2", *MAP), "Int64"), "light": "Int32"})

    longs = ", ".join(f"{c} long" for c in ("d1", "d2", "g1", "g2", *MAP))
    made = docs.select(id_in(), "row_key", "text").mapInPandas(profile, f"doc_id long, row_key long, n long, {longs}, light int, prefix array<long>")
    return made.withColumn("doc_id", id_out())


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose texts have the similarity, held against each other shingle by shingle."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            linked = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb"), strict=True):
                if a != last:
                    last, own = a, exact_shingles(shingle_words(ta.as_py()), k)
                other = exact_shingles(shingle_words(tb.as_py()), k)
                both = len(own & other)
                linked.append(100 * both >= percent * (len(own) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    left = texts.select(F.col("cls").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("cls").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "ta", "tb").mapInArrow(hold, "a long, b long")


def jaccard_components(docs: DataFrame, stages: Stages, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``; also row_key (a hash of id and text) and group (null without shingles)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row_key"))
    table = docs.sparkSession.sparkContext.broadcast(frequencies(docs, k))  # LEVELS bytes
    own, counted = stages.kept(profiles(docs, k, percent, table), "profiles", {"n": F.count("*")})
    table.destroy()

    # classes get short ids, a group the id of its first class; the ids are fixed as they are written
    firsts = [F.max(c).alias(c) for c in ("n", "g1", "g2", *MAP)]
    sets = own.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("first_doc"), F.min("row_key").alias("first_key"), *firsts)
    sets = stages.keep(sets.withColumn("cls", F.monotonically_increasing_id()), "sets")
    groups = sets.groupBy("g1", "g2").agg(F.min("cls").alias("grp"), F.count("*").alias("members"), F.max(reduce(Column.bitwiseXOR, map(F.col, MAP))).alias("sketch"), *_bounds())
    posts = own.where("prefix is not null").groupBy("g1", "g2").agg(F.max("n").cast("int").alias("n"), F.max("light").alias("light"), F.first("prefix").alias("prefix"))
    groups = stages.keep(groups.join(posts, ["g1", "g2"]), "groups")
    slim = stages.keep(own.select("doc_id", "row_key", "n", "d1", "d2"), "rows")
    classes = stages.keep(sets.join(groups.select("g1", "g2", "grp"), ["g1", "g2"]).drop("g1", "g2"), "classes")
    stages.drop(own, sets)

    # buckets with more than one set
    parts = max(1, -(-counted["n"] // PART))
    posted = groups.select("grp", "n", "light", "sketch", (F.col("members") > 1).alias("several"), F.posexplode("prefix").alias("pos", "shingle"))
    posted = posted.select("shingle", "grp", "n", "pos", "sketch", "several", F.when(F.col("pos") >= F.col("light"), F.pmod(F.xxhash64("grp", "shingle"), F.lit(parts)).cast("int") + 1).otherwise(0).alias("part"))
    bucket, here = W.partitionBy("shingle", "part").orderBy("pos", "n", "grp"), F.struct("grp", "n", "pos")
    seen = F.collect_list(F.struct("sketch", "grp", "n", "pos")).over(bucket.rowsBetween(-BEFORE, -1))
    shared = posted.withColumns({"leader": F.first(here).over(bucket.rowsBetween(W.unboundedPreceding, 0)), "seen": seen, "more": F.lead("grp").over(bucket), "large": (F.col("part") > 0) | (F.row_number().over(bucket) > SLOT)})
    shared = shared.where("size(seen) > 0 or more is not null or several or (part > 0 and %d > 1)" % parts)
    near = F.array_min(F.transform("seen", lambda o: F.struct(F.bit_count(o["sketch"].bitwiseXOR(F.col("sketch"))).alias("differ"), o["grp"].alias("grp"), o["n"].alias("n"), o["pos"].alias("pos"))))
    near = F.when(near.isNotNull(), F.struct(near["grp"].alias("grp"), near["n"].alias("n"), near["pos"].alias("pos")))
    shared = stages.keep(shared.select("shingle", "grp", "n", "pos", "large", "leader", near.alias("near")), "buckets")

    # first pass: groups against the nearest leader and the nearest group before, members against their group's first
    other = shared.select("grp", "n", "pos", F.inline(F.array(F.struct(F.lit(0).alias("kind"), F.col("leader").alias("o")), F.struct(F.lit(1).alias("kind"), F.col("near").alias("o"))))).select("*", F.col("o.n").alias("o_n"), F.col("o.pos").alias("o_pos"))
    likely = other.where((F.col("grp") != F.col("o.grp")) & _passes("n", "pos", "o_n", "o_pos", percent)).select("grp", "n", "kind", F.col("o.grp").alias("o"), "o_n").distinct()
    bounds = groups.select("grp", *LOW, *HIGH)
    likely = likely.join(bounds.hint("merge"), "grp").join(bounds.select(F.col("grp").alias("o"), *(F.col(c).alias(f"o_{c}") for c in (*LOW, *HIGH))).hint("merge"), "o")
    likely = likely.withColumn("differ", _apart("", "o_")).where(_close("n", "o_n", F.col("differ"), percent))
    best = likely.groupBy("grp", "kind").agg(F.min_by("o", F.struct("differ", "o")).alias("o"))
    inner = classes.where("cls <> grp").select(F.col("grp").alias("a"), F.col("cls").alias("b"))
    links = _linked(best.select(F.col("o").alias("a"), F.col("grp").alias("b")).union(inner).distinct(), docs, classes, stages, k, percent)
    labels = components(links, stages)
    placed = classes.join(labels.hint("merge").withColumnRenamed("id", "cls"), "cls", "left").withColumn("comp", F.coalesce("label", "cls")).drop("label")
    placed = stages.keep(placed, "placed")
    stages.drop(links)
    placed = _merged(shared, placed, docs, classes, stages, k, percent)

    # second pass: all that lies in one bucket but not yet in one component
    pairs = _across(shared, placed, stages, percent)
    found = _linked(pairs, docs, classes, stages, k, percent)
    joined = _joined(found, placed, stages)
    stages.drop(found, shared)

    final = placed.join(joined.withColumnRenamed("id", "comp"), "comp", "left").select("d1", "d2", "first_doc", F.coalesce("label", "comp").alias("label"))
    least = final.groupBy("label").agg(F.min("first_doc").alias("component"))
    of = final.join(least, "label").select("d1", "d2", "component", F.col("label").alias("group"))
    return slim.join(of, ["d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "row_key", "group")


#: Bits that all sets of a group, and that any of them, have.
LOW, HIGH = [f"low{i}" for i in range(LONGS)], [f"high{i}" for i in range(LONGS)]


def _bounds() -> list[Column]:
    return [F.bit_and(b).alias(low) for b, low in zip(MAP, LOW, strict=True)] + [F.bit_or(b).alias(high) for b, high in zip(MAP, HIGH, strict=True)]


def _apart(x: str, y: str) -> Column:
    """Bits in which any set of one group differs from any of another, from the groups' bounds."""
    total = F.lit(0)
    for low, high in zip(LOW, HIGH, strict=True):
        one = F.col(x + low).bitwiseAND(F.bitwise_not(F.col(y + high)))
        total = total + F.bit_count(one.bitwiseOR(F.col(y + low).bitwiseAND(F.bitwise_not(F.col(x + high)))))
    return total


def _merged(shared: DataFrame, placed: DataFrame, docs: DataFrame, classes: DataFrame, stages: Stages, k: int, percent: int) -> DataFrame:
    """``placed`` after components that meet in a slot of a large bucket and are linked there became one; a unit is stood for by its first class."""
    large, counted = stages.kept(shared.where("large").select("shingle").distinct(), "large", {"n": F.count("*")})
    if not counted["n"]:
        return placed
    units = placed.groupBy("grp", "comp").agg(F.min(F.struct("cls", *MAP)).alias("first")).select("grp", "comp", "first.*")
    sides = stages.keep(shared.select("shingle", "grp", "n", "pos").join(large, "shingle", "left_semi").join(units.hint("merge"), "grp"), "sides")
    marks = sides.groupBy("shingle").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.ceil(F.count("*") / SLOT).alias("slots"))
    marks = stages.keep(marks.where("c0 <> c1").select("shingle", "slots"), "marks")  # written, so that the join with them can be split
    dealt = sides.join(marks, "shingle").withColumn("slot", F.pmod(F.xxhash64("shingle", "cls"), "slots"))
    side = lambda tag: dealt.select("shingle", "slot", *(F.col(c).alias(f"{tag}{c}") for c in ("cls", "n", "pos", "comp", *MAP)))
    differ = _differing("x_", "y_")
    met = side("x_").join(side("y_").hint("merge"), ["shingle", "slot"]).where((F.col("x_comp") < F.col("y_comp")) & _passes("x_n", "x_pos", "y_n", "y_pos", percent) & _close("x_n", "y_n", differ, percent))
    nearest = met.groupBy("x_comp", "y_comp").agg(F.min(F.struct(differ.alias("differ"), "x_cls", "y_cls")).alias("pair"))
    links = _linked(nearest.select(F.col("pair.x_cls").alias("a"), F.col("pair.y_cls").alias("b")), docs, classes, stages, k, percent)
    joined = _joined(links, placed, stages).withColumnRenamed("id", "comp")
    merged = stages.keep(placed.join(joined.hint("merge"), "comp", "left").withColumn("comp", F.coalesce("label", "comp")).drop("label"), "placed")
    stages.drop(large, sides, marks, links, placed)
    return merged


def _joined(links: DataFrame, placed: DataFrame, stages: Stages) -> DataFrame:
    """(id, label) of the components that links between classes join."""
    comp = lambda end: placed.select(F.col("cls").alias(end), F.col("comp").alias(f"c{end}"))
    return components(links.join(comp("a").hint("merge"), "a").join(comp("b").hint("merge"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")), stages)


def _across(shared: DataFrame, placed: DataFrame, stages: Stages, percent: int) -> DataFrame:
    """Pairs (a, b) of classes in different components that pass the filters, from units (a group's members in one component) that meet in a bucket."""
    units = placed.groupBy("grp", "comp").agg(*_bounds())
    sides = shared.select("shingle", "grp", "n", "pos").join(placed.select("grp", "comp").distinct().hint("merge"), "grp")
    place = F.col("pos").cast("long") * F.lit(1 << 40) + F.pmod("grp", F.lit(1 << 40))
    marks = sides.groupBy("shingle").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min_by("comp", place).alias("main")).where("c0 <> c1").select("shingle", "main")
    sides = sides.join(marks.hint("merge"), "shingle").join(units.hint("merge"), ["grp", "comp"])
    sides = stages.keep(sides, "sides")
    side = lambda tag, rows: rows.select("shingle", *(F.col(c).alias(f"{tag}{c}") for c in ("grp", "n", "pos", "comp", "main", *LOW, *HIGH)))
    # of two units outside the main component, one order of the pair is enough
    once = (F.col("x_comp") != F.col("y_comp")) & ((F.col("y_comp") == F.col("y_main")) | (F.col("x_comp") < F.col("y_comp")))
    met = side("x_", sides.where("comp <> main")).join(side("y_", sides), "shingle").where(once & _passes("x_n", "x_pos", "y_n", "y_pos", percent))
    met = met.where(_close("x_n", "y_n", _apart("x_", "y_"), percent)).select("x_grp", "x_comp", "y_grp", "y_comp").distinct()
    member = lambda tag, name: placed.select(F.col("grp").alias(f"{tag}grp"), F.col("comp").alias(f"{tag}comp"), F.col("cls").alias(name), F.col("n").alias(f"{tag}n"), *(F.col(b).alias(f"{tag}{b}") for b in MAP))
    expanded = met.join(member("x_", "a").hint("merge"), ["x_grp", "x_comp"]).join(member("y_", "b").hint("merge"), ["y_grp", "y_comp"])
    return expanded.where(_close("x_n", "y_n", _differing("x_", "y_"), percent)).select("a", "b").distinct()


def one_of_each(docs: DataFrame, stages: Stages, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest doc_id stays; rows without words all stay."""
    found = jaccard_components(docs, stages, k, percent)
    stays = found.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"].alias("_key")).select("_key")
    stays = stays.union(found.where(F.col("group").isNull()).select("row_key")).distinct()
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), row_key(docs).alias("_key"))
    # repeated rows share a key; without words they all stay
    first = F.row_number().over(W.partitionBy("_key").orderBy(F.lit(1)))
    empty = F.size(words(F.col("_row.text"))) == 0
    return keyed.join(stays, "_key", "left_semi").withColumn("_n", first).where((F.col("_n") == 1) | empty).select("_row.*")


def _passes(n, pos, m, at, percent: int) -> Column:
    """Sizes that may be similar, and enough elements behind a first shared one at ``pos`` and ``at`` (from 0)."""
    n, pos, m, at = map(F.col, (n, pos, m, at))
    return (100 * n >= percent * m) & (100 * m >= percent * n) & ((100 + percent) * F.least(n - pos, m - at) >= percent * (n + m))


def _differing(x: str, y: str) -> Column:
    """Bits in which two bitmaps differ: no more than the elements in which the sets do."""
    total = F.lit(0)
    for b in MAP:
        total = total + F.bit_count(F.col(x + b).bitwiseXOR(F.col(y + b)))
    return total


def _close(n: str, m: str, differ: Column, percent: int) -> Column:
    """Whether sets of these sizes that differ in so many elements at least can still be similar enough."""
    n, m = F.col(n), F.col(m)
    return (100 + percent) * (n + m - differ) >= 2 * percent * (n + m)


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, stages: Stages, k: int, percent: int) -> DataFrame:
    """The pairs of classes that hold, of candidates; only texts of classes in a pair are moved."""
    pairs = stages.keep(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted, counted = stages.kept(classes.select("cls", "first_key", "d1", "d2").join(ids.hint("merge"), "cls", "left_semi"), "wanted", {"n": F.count("*")})
    texts = stages.keep(_texts(docs, wanted, counted["n"], k), "texts")
    links = stages.keep(verified(pairs, texts, k, percent), "links")
    stages.drop(pairs, wanted, texts)
    return links


def _texts(docs: DataFrame, wanted: DataFrame, n: int, k: int) -> DataFrame:
    """(cls, text): a text of each wanted class. Where keys of rows meet, the digest tells which is meant."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeated rows share a key and so meet in one task
        for batch in batches:
            right = []
            for cls, d1, d2, text in zip(*(batch.column(c).to_pylist() for c in ("cls", "d1", "d2")), batch.column("text"), strict=True):
                right.append(cls not in seen and digest(shingles(shingle_words(text.as_py()), k).tobytes()) == (d1, d2))
                if right[-1]:
                    seen.add(cls)
            yield batch.select(["cls", "text"]).filter(pa.array(right, pa.bool_()))

    rows = maybe_among(docs.where("text is not null").select("row_key", "text"), "row_key", wanted, "first_key", n)
    met = rows.join(wanted.hint("merge"), F.col("row_key") == F.col("first_key"))
    return met.select("cls", "d1", "d2", "text").mapInArrow(own, "cls long, text string")
