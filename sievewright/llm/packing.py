"""Best-fit packing by minimum bin slack.

The heuristic needs to know only how many pieces there are of each length. Per bin, starting from the longest
piece left, a subset-sum over the available lengths (one big-integer bitset per length considered) finds the
fullest combination that fits; the combination is removed as often as the counts allow, all those bins being
alike, so the driver handles at most ``capacity`` counts however many pieces there are. The patterns say which
ranks of each length go to which sequences; pieces learn their rank in two steps, by part and within a part.

Defined results: null text is an empty document (its end id alone); documents with null ids are packed;
repeated rows are packed each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tokens import document_pieces

#: Pieces that are ranked in one task, on average.
PART = 500


def fullest(counts: np.ndarray, room: int) -> list[int]:
    """The lengths, at most counts[length] of each, whose sum is the largest that fits into ``room``.

    ``reach[k]`` has bit s set if lengths before the k-th (long ones first) give the sum s. Copies are added by
    binary splitting. Stops as soon as the bin can be filled; reading back takes from the last length to the first.
    """
    reach, lengths = [1], []
    mask = (1 << (room + 1)) - 1
    for size in range(min(room, len(counts) - 1), 0, -1):
        if not counts[size]:
            continue
        bits, left, step = reach[-1], min(int(counts[size]), room // size), 1
        while left:
            take = min(step, left)
            bits |= (bits << (size * take)) & mask
            left, step = left - take, step * 2
        reach.append(bits)
        lengths.append(size)
        if bits >> room & 1:
            break
    total, chosen = reach[-1].bit_length() - 1, []
    for k in range(len(lengths), 0, -1):
        while not reach[k - 1] >> total & 1:
            total -= lengths[k - 1]
            chosen.append(lengths[k - 1])
    return chosen


def patterns(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths in a bin, number of such bins), until no piece is left."""
    counts, out = counts.copy(), []
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            bin_ = [longest, *fullest(counts, capacity - longest)]
            counts[longest] += 1
            sizes, needs = np.unique(bin_, return_counts=True)
            times = int((counts[sizes] // needs).min())
            counts[sizes] -= needs * times
            out.append((bin_, times))
    return out


def slots(found: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number of ranks, first sequence, offset): where the pieces of a length go, rank by rank."""
    used: dict[int, int] = {}
    out, first = [], 0
    for sizes, times in found:
        offset = 0
        for size in sizes:
            out.append((size, used.get(size, 0), times, first, offset))
            used[size] = used.get(size, 0) + times
            offset += size
        first += times
    return out


def pack(docs: DataFrame, tokenizer: str, stages, capacity: int = 1024, end: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for every piece of every document."""
    pieces = stages.keep(document_pieces(docs, tokenizer, capacity, end), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # one row per length: at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    table = slots(patterns(counts, capacity))
    spark = docs.sparkSession
    schema = "size long, rank_from long, ranks long, sequence_from long, offset long"
    # one row per length and pattern; adjoining ranks, so at most one for each of the patterns of a length
    places = stages.keep(spark.createDataFrame(table, schema) if table else spark.createDataFrame([], schema), "slots")
    sizes = spark.createDataFrame([(n, max(1, -(-int(counts[n]) // PART))) for n in range(1, capacity + 1)], "of long, parts long")
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    marked = pieces.join(F.broadcast(sizes), F.col("length") == F.col("of")).withColumn("mark", key).withColumn("part", F.pmod("mark", "parts"))  # ``sizes`` has ``capacity`` rows
    heads = marked.groupBy("length", "part").agg(F.count("*").alias("rows"))
    ahead = F.coalesce(F.sum("rows").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heads = heads.withColumn("ahead", ahead).select(F.col("length").alias("_n"), F.col("part").alias("_p"), "ahead")
    within = F.row_number().over(W.partitionBy("length", "part").orderBy("mark", "doc_id", "piece", "start"))
    ranked = marked.join(heads, (F.col("length") == F.col("_n")) & (F.col("part") == F.col("_p"))).withColumn("rank", F.col("ahead") + within - 1)
    return _placed(ranked, places).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _placed(ranked: DataFrame, places: DataFrame) -> DataFrame:
    """Each piece's slot: the slots of a length as one sorted array, searched by rank."""
    lists = places.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("rank_from", "ranks", "sequence_from", "offset"))).alias("slots"))
    joined = ranked.join(F.broadcast(lists), F.col("length") == F.col("size"))
    slot = F.get(F.filter("slots", lambda s: (s["rank_from"] <= F.col("rank")) & (F.col("rank") < s["rank_from"] + s["ranks"])), F.lit(0))
    return joined.withColumn("slot", slot).withColumns({"sequence_id": F.col("slot.sequence_from") + F.col("rank") - F.col("slot.rank_from"), "offset": F.col("slot.offset")})
