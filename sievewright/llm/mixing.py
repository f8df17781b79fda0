"""Mixing sources to target token shares by entropy balancing.

Among all rates ``0 <= r <= MOST`` that give each source its target number of words, entropy balancing takes
those that stay closest (in relative entropy, document by document) to taking each document once. Its convex
dual has one multiplier per source, and its optimum tilts documents exponentially by size:
``r = min(MOST, exp(multiplier * size / mean size))``. Safeguarded Newton steps find all multipliers together.
Each step is one aggregation over (source, size) cells; a source has as many cells as it has distinct sizes,
which document lengths bound and the number of documents does not.

Rates become whole copies per cell: the sum over a source's cells, in order of size, is rounded so that each
running total is within one copy; a bounded set of cells then repairs what is left of the word total. Within
a cell the copies go to documents by rank of a hash, ranks being counted in salted parts so that a cell with a
third of all rows is never sorted in one task.

Everything is a DataFrame expression: no Python runs on the executors.

Defined results: null text has size 0 and takes 0 words; a null source is a source of its own and comes last;
repeated rows are documents of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import row_key, words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
STEPS = 40
#: Newton stops when every source is this close to its target, relative to it.
CLOSE = 1e-9
#: Documents of one salted part of a cell, on average.
PART = 500
#: Rungs of the repair ladder: geometric size classes with this ratio, this many steps.
RUNG, REPAIRS = 1.15, 3


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, row_key and size in words."""
    return docs.select("doc_id", "source", row_key().alias("row_key"), F.size(words(F.col("text"))).cast("long").alias("size"))


def targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, mean_size and target, from a table with one row per source.

    Resharing the excess of capped sources by weight until none is above its cap ends at one water level:
    target = min(most * size, weight * level). Sources in order of cap over weight fill up first, so running
    sums give the level. These windows run over one row per source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    one = totals.withColumn("weight", cycle).withColumn("cap", most * F.col("source_size"))
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filling = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    two = one.withColumns({"budget": share * F.sum("source_size").over(everything), "weights": F.sum("weight").over(everything)})
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    three = two.withColumn("place", F.row_number().over(filling)).withColumn("level", level).withColumn("open", F.col("weight") * F.col("level") < F.col("cap"))
    first = F.min(F.when(F.col("open"), F.struct("place", "level"))).over(everything)  # from the first open source on, all are
    final = first["level"]
    return three.select("source", "source_size", "n_docs", F.least(F.col("cap"), F.coalesce(F.col("weight") * final, F.col("cap"))).alias("target"))


def rate(multiplier: Column, size: Column, mean: Column, most: float = MOST) -> Column:
    """The tilted rate; a multiplier of null stands for a source at its cap."""
    return F.when(multiplier.isNull(), F.lit(most)).otherwise(F.least(F.lit(most), F.exp(multiplier * size / mean)))


def solve(cells: DataFrame, plan: DataFrame, stages, most: float = MOST) -> DataFrame:
    """plan with each source's multiplier. cells: source, size, n. Each Newton step is one job on the executors.

    The words taken rise with the multiplier, so every step also narrows a bracket, and a Newton step that
    leaves the bracket is replaced by its middle. Each step's table is written, which keeps plans short; how many sources are
    not yet close comes with that job.
    """
    at_cap = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    mean = F.col("source_size") / F.greatest(F.col("n_docs"), F.lit(1))
    now = plan.select("source", "source_size", "n_docs", "target", F.greatest(mean, F.lit(1.0)).alias("mean"), F.when(~at_cap, F.lit(0.0)).alias("m"), F.lit(-1e3).alias("lo"), F.lit(1e3).alias("hi"), F.lit(None).cast("double").alias("error"))
    open_ = {"left": F.count_if(F.col("m").isNotNull() & (F.col("error").isNull() | (F.col("error") > CLOSE)))}
    now, seen = stages.kept(now, "multipliers", open_)
    for _ in range(STEPS):
        if not seen["left"]:
            break
        joined = cells.alias("c").join(now.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("s.*", "c.size", "c.n")
        z = F.col("size") / F.col("mean")
        tilt = rate(F.col("m"), F.col("size"), F.col("mean"), most)
        words_here = F.col("n") * F.col("size")
        same = [F.max(c).alias(c) for c in now.columns if c != "source"]
        told = joined.groupBy("source").agg(*same, F.sum(words_here * tilt).alias("got"), F.sum(F.when(tilt < most, words_here * tilt * z).otherwise(0.0)).alias("slope"))
        lo, hi = F.when(F.col("got") < F.col("target"), F.col("m")).otherwise(F.col("lo")), F.when(F.col("got") >= F.col("target"), F.col("m")).otherwise(F.col("hi"))
        told = told.withColumns({"lo": F.coalesce(lo, "lo"), "hi": F.coalesce(hi, "hi"), "error": F.abs(F.col("got") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))})
        newton = F.col("m") + F.when(F.col("slope") > 0, (F.col("target") - F.col("got")) / F.col("slope"))
        inside = F.when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        told = told.withColumn("m", F.when(F.col("m").isNotNull(), F.when(F.col("error") > CLOSE, inside).otherwise(F.col("m"))))
        told = told.withColumn("error", F.when(F.col("hi") - F.col("lo") < 1e-12, F.lit(0.0)).otherwise(F.coalesce(F.col("error"), F.lit(0.0))))
        before = now
        now, seen = stages.kept(told.select(*now.columns), "multipliers", open_)
        stages.drop(before)
    return now


def round_cells(cells: DataFrame, solved: DataFrame, stages, most: float = MOST) -> DataFrame:
    """source, size, n, copies: whole copies for each cell, and the source's columns.

    Windows run over the cells of a source; documents with one size share a cell.
    """
    joined = cells.alias("c").join(solved.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("s.*", F.col("c.size").alias("size"), F.col("c.n").alias("n"))
    exact = F.col("n") * F.when(F.col("size") > 0, rate(F.round("m", 8), F.col("size"), F.col("mean"), most)).otherwise(0.0)  # rounded: sums of doubles differ in the last place between runs
    upto = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, 0)
    running = joined.withColumn("exact", exact).withColumn("upto", F.round(F.sum("exact").over(upto)))
    copies = F.col("upto") - F.coalesce(F.lag("upto").over(W.partitionBy("source").orderBy("size")), F.lit(0.0))
    limited = F.least(F.greatest(copies, F.lit(0.0)), most * F.col("n")).cast("long")
    return _repaired(running.withColumn("copies", limited), stages, most)


def _repaired(cells: DataFrame, stages, most: float) -> DataFrame:
    """cells with the copies of a few cells changed, so that each source's words come close to its target.

    Each pass takes one candidate cell per geometric size class, so at most about 100 per source whatever the
    input, and walks them from large to small, adding (or taking away) a copy wherever it fits into what is left.
    """
    for k in range(REPAIRS):
        cells = stages.keep(cells, "copies")
        missing = cells.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("missing"))
        known = cells.alias("c").join(missing.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select("c.*", "missing")
        room = F.when(F.col("missing") > 0, most * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        usable = known.where((F.col("size") > 0) & (room > 0) & (F.col("size") <= 2 * F.abs(F.col("missing"))))
        rung = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(RUNG)))
        best = usable.withColumn("room", room).groupBy("source", rung.alias("rung")).agg(F.max_by(F.struct("size", "room"), F.struct(F.xxhash64(F.lit(k), "size"), "size")).alias("cell"), F.max("missing").alias("missing"))
        ladder = best.groupBy("source").agg(F.reverse(F.sort_array(F.collect_list("cell"))).alias("cells"), F.max("missing").alias("missing"))
        start = F.struct(F.abs(F.col("missing")).alias("left"), F.array().cast("array<struct<size:bigint,by:bigint>>").alias("chosen"))

        def walk(acc: Column, cell: Column) -> Column:
            fits = F.floor(acc["left"] / cell["size"])
            by = F.least(fits, F.floor(cell["room"])).cast("long")
            # the last rung may overshoot if that leaves less than it found
            by = F.when((by == 0) & (F.abs(acc["left"] - cell["size"]) < acc["left"]) & (cell["size"] <= 2), F.lit(1).cast("long")).otherwise(by)
            return F.struct((acc["left"] - by * cell["size"]).alias("left"), F.concat(acc["chosen"], F.array(F.struct(cell["size"].alias("size"), by.alias("by")))).alias("chosen"))

        moves = ladder.select("source", F.signum("missing").cast("long").alias("sign"), F.explode(F.aggregate("cells", start, walk)["chosen"]).alias("move")).select(F.col("source").alias("_s"), F.col("move.size").alias("_z"), (F.col("sign") * F.col("move.by")).alias("_by")).where("_by <> 0")
        cells = cells.join(moves, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")), "left").withColumn("copies", F.col("copies") + F.coalesce(F.col("_by"), F.lit(0))).drop("_s", "_z", "_by")
    return cells


def deal(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """docs (doc_id, row_key, source, size) with source_size, target, copies and taken.

    In a cell with n documents and k copies each gets k // n, and the k % n with the lowest hashes one more. Parts of
    a cell are counted first; only the part in which the last extra copy falls is ranked by row.
    """
    mark = F.xxhash64(F.lit("mix"), F.col("doc_id"))
    joined = docs.alias("d").join(cells.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.size") == F.col("c.size")))
    known = joined.select("d.doc_id", "d.row_key", "d.source", "d.size", F.col("c.source_size").alias("source_size"), F.col("c.target").alias("target"), F.col("c.n").alias("n"), F.col("c.copies").alias("k"))
    parts = F.ceil(F.col("n") / PART)
    known = known.withColumn("mark", mark).withColumn("part", F.pmod(F.shiftright("mark", 8), parts))
    counts = known.where("k % n > 0").groupBy("source", "size", "part").agg(F.count("*").alias("rows"))
    ahead = F.coalesce(F.sum("rows").over(W.partitionBy("source", "size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("ahead", ahead)
    placed = known.alias("d").join(counts.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")) & (F.col("d.part") == F.col("p.part")), "left").select("d.*", F.col("p.ahead").alias("ahead"))
    rank = F.row_number().over(W.partitionBy("source", "size", "part").orderBy("mark", "doc_id", "row_key"))
    extra = F.col("k") % F.col("n")
    copies = F.floor(F.col("k") / F.col("n")) + F.when((extra > 0) & (F.coalesce(F.col("ahead"), F.lit(0)) + rank <= extra), 1).otherwise(0)
    return placed.withColumn("copies", copies.cast("long")).select("doc_id", "row_key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, stages, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for every row of docs."""
    sized = stages.keep(sizes(docs), "sizes")
    cells = stages.keep(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    totals = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    solved = solve(cells, targets(totals, weights, share, most), stages, most)
    rounded = stages.keep(round_cells(cells, solved, stages, most), "copies")
    return deal(sized, rounded)


def applied(docs: DataFrame, stages) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it."""
    wanted = mix(docs, stages).groupBy(F.col("row_key").alias("_key")).agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), row_key(docs).alias("_key"))
    one = keyed.join(wanted, "_key").withColumn("_n", F.row_number().over(W.partitionBy("_key").orderBy(F.lit(1)))).where("_n = 1")  # repeated rows share a key and their copies
    return one.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("_row.*")
