"""Approximate nearest neighbours by multiprobe p-stable hashing.

Unit vectors are hashed by ``floor((a . x + b) / w)`` with Gaussian ``a``, several such values to a table's bucket. A query
visits its own bucket in every table and then perturbed ones, in the order of their estimated success: by the
sum of squared distances to the bucket walls that a perturbation crosses, following a template that is worked
out once from the expected distances. What the tables give is merged and ranked by the exact cosine.

1. Equal vectors are one point that carries its ``k + 1`` smallest ids: no answer can hold others of them.
2. Hash values, width, tables and probes are fitted on a bounded sample (FIT_QUERIES queries with their true neighbours among all
   points, FIT_ROWS points): of the settings that find the share ``RECALL`` of those neighbours, the one with the least work.
3. Every point is posted once a table under its bucket, and buckets are dealt to shelves by their key. A shelf with many points,
   as of a full bucket, is split, and only its own visitors go to all parts of it.
4. A query goes to the shelves that hold buckets it visits, once each, with the list of buckets. A shelf looks the buckets up and
   computes cosines of what is in them, and of nothing else; the best ``k`` of each query leave it and are merged.
5. A query that was given fewer than ``k`` points in all is held against every point, in blocks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors
of different lengths are not compared; rows that share the query's id are its own and are no candidates; ties go to the
smaller id; rows with null ids take no part; a repeated query id asks once; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Stages

SEED, RECALL = 11, 0.97
#: What the setting is fitted on, at most.
FIT_QUERIES, FIT_ROWS = 64, 2048
#: Settings that are tried: hash values of a bucket, widths, tables, and the most probes of a table.
HASHES, WIDTHS, TABLES, PROBES = (6, 8, 10, 12, 16, 20), (0.6, 1.0, 1.6, 2.4), (8, 16), 512
#: Work of a probe against that of a cosine.
PROBE_COST = 4.0
#: Postings of a shelf, on average; queries of a shelf that are held in one task; points of a block.
SHELF, QUERIES, BLOCK = 8192, 2048, 4096


@dataclass(frozen=True)
class Setting:
    """What a table of buckets looks like, and the shares that the fit found: of true neighbours, and of points that a query is given (a point counts once a table)."""

    hashes: int
    width: float
    tables: int
    probes: int
    recall: float = 1.0
    share: float = 1.0


@cache
def template(hashes: int, probes: int) -> np.ndarray:
    """probes x 2*hashes zeros and ones: which of the sorted wall distances each perturbation crosses, best first.

    The j-th smallest of the 2k distances has the expected square given below; rank j and rank 2k - 1 - j are the two walls
    of one coordinate, so a set holds at most one of them.
    """
    k, m = hashes, 2 * hashes
    j = np.arange(1, m + 1)
    expected = np.where(j <= k, j * (j + 1) / (4 * (k + 1) * (k + 2)), 1 - (m + 1 - j) / (k + 1) + (m + 1 - j) * (m + 2 - j) / (4 * (k + 1) * (k + 2)))
    rows, heap = [np.zeros(m, np.int64)], [(float(expected[0]), (0,))]
    while heap and len(rows) < probes:
        cost, chosen = heapq.heappop(heap)
        if all(m - 1 - c not in chosen for c in chosen):
            row = np.zeros(m, np.int64)
            row[list(chosen)] = 1
            rows.append(row)
        last = chosen[-1]
        if last + 1 < m:
            heapq.heappush(heap, (cost - float(expected[last]) + float(expected[last + 1]), (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + float(expected[last + 1]), (*chosen, last + 1)))
    return np.array(rows)


@cache
def functions(dim: int, table: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, offsets and the odd multipliers that fold a bucket's values into one key."""
    rng = np.random.default_rng([SEED, dim, table])
    directions, offsets = rng.normal(size=(dim, max(HASHES))), rng.uniform(0, 1, max(HASHES))
    fold = rng.integers(-(2**62), 2**62, max(HASHES), dtype=np.int64) | 1
    return directions[:, :hashes], offsets[:hashes] * width, fold[:hashes]


def buckets(points: np.ndarray, table: int, setting: Setting) -> np.ndarray:
    """The bucket's key of every unit vector."""
    directions, offsets, fold = functions(points.shape[1], table, setting.hashes, setting.width)
    return np.floor((points @ directions + offsets) / setting.width).astype(np.int64) @ fold + np.int64(table)


def visits(queries: np.ndarray, table: int, setting: Setting) -> np.ndarray:
    """queries x probes: the buckets that each query visits, in order of estimated success."""
    directions, offsets, fold = functions(queries.shape[1], table, setting.hashes, setting.width)
    at = (queries @ directions + offsets) / setting.width
    floor = np.floor(at)
    inside = at - floor
    walls = np.concatenate([inside**2, (1 - inside) ** 2], axis=1)
    moves = np.concatenate([-fold, fold])
    delta = moves[np.argsort(walls, axis=1, kind="stable")]
    return (floor.astype(np.int64) @ fold + np.int64(table))[:, None] + delta @ template(setting.hashes, setting.probes).T


def fitted(queries: np.ndarray, answers: list[np.ndarray], points: np.ndarray, total: int) -> Setting:
    """The setting with the least work for a query among ``total`` points, of those that find the share RECALL of the answers; else the one that finds most."""
    best = None
    if not len(queries):
        return Setting(HASHES[0], WIDTHS[-1], TABLES[0], 1)
    whose = np.repeat(np.arange(len(queries)), [len(a) for a in answers])
    true = np.concatenate(answers)
    for hashes in HASHES:
        for width in WIDTHS:
            setting = Setting(hashes, width, max(TABLES), PROBES)
            when, given = np.full((max(TABLES), len(true)), PROBES), np.zeros((max(TABLES), PROBES))
            for table in range(max(TABLES)):
                asked = visits(queries, table, setting)
                match = asked[whose] == buckets(true, table, setting)[:, None]
                when[table] = np.where(match.any(axis=1), match.argmax(axis=1), PROBES)
                names, counts = np.unique(buckets(points, table, setting), return_counts=True)
                place = np.minimum(np.searchsorted(names, asked), len(names) - 1)
                given[table, : asked.shape[1]] = np.where(names[place] == asked, counts[place], 0).mean(axis=0)
            upto = given.cumsum(axis=1) / len(points)
            for tables in TABLES:
                first = np.sort(when[:tables].min(axis=0))
                need = int(first[min(len(first) - 1, int(np.ceil(RECALL * len(first))) - 1)]) + 1
                probes = min(need, PROBES)
                recall, share = float((first < probes).mean()), float(upto[:tables, probes - 1].sum())
                found = Setting(hashes, width, tables, probes, round(recall, 4), round(share, 4))
                rank = (recall < RECALL, -recall if recall < RECALL else 0.0, tables * probes * PROBE_COST + share * total)
                if best is None or rank < best[0]:
                    best = (rank, found)
    return best[1]


def search_shelf(points: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """query_id, id, score: each query's best k of the points in the buckets that it visits here, exactly.

    points: key, ids, unit; asked: query_id, own vector, keys. A point met in several buckets counts once.
    """
    order = np.argsort(points["key"].to_numpy(), kind="stable")
    names, starts = np.unique(points["key"].to_numpy()[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    rows, ids = np.stack(points["embedding"].to_numpy()), points["ids"].to_numpy()
    lengths, first = np.sqrt(np.einsum("ij,ij->i", rows, rows)), np.array([i[0] for i in ids])
    out: list[tuple[int, int, float]] = []
    for query, vector, keys in zip(asked["query_id"], asked["embedding"], asked["keys"], strict=True):
        place = np.minimum(np.searchsorted(names, keys), len(names) - 1)
        place = np.unique(place[names[place] == keys])
        if len(place):
            met = np.concatenate([order[starts[p] : ends[p]] for p in place])
            met = met[np.unique(first[met], return_index=True)[1]]  # a point stands in a bucket of each table
            score = scores(rows[met], lengths[met], np.asarray(vector, float))
            out.extend((query, i, s) for i, s in best_of(query, score, [ids[m] for m in met], k))
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def scores(rows: np.ndarray, lengths: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines, each from its own two vectors alone, so that equal rows have equal scores wherever they are computed."""
    return np.einsum("ij,j->i", rows, query) / (lengths * np.sqrt(np.einsum("j,j->", query, query)))


def best_of(query: int, score: np.ndarray, ids: list, k: int) -> list[tuple[int, float]]:
    """The k best (id, score) without the query's own id; ties to the smaller id. Points give their ids in order."""
    kth = np.partition(score, len(score) - k - 1)[len(score) - k - 1] if len(score) > k + 1 else -np.inf  # one more than k: the query's own point may be among them
    near = [(-float(score[m]), i) for m in np.flatnonzero(score >= kth) for i in ids[m] if i != query]
    return [(i, -s) for s, i in heapq.nsmallest(k, near)]


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    doubles = vector.cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite & F.exists(doubles, lambda x: x != 0), F.lit(False))


FOUND = "query_id long, vec_id long, score double"
NOTHING = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})


def exhaustive(points: DataFrame, asked: DataFrame, n: int, k: int) -> DataFrame:
    """Each asked query's best k of every block of points: asked queries are a stated set against all points, in blocks."""
    blocks = max(1, -(-n // BLOCK))
    left = points.withColumn("block", F.pmod(F.xxhash64("embedding"), F.lit(blocks)).cast("int"))
    right = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(block: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(block) and len(some):
            rows = np.stack(block["embedding"].to_numpy())
            lengths, ids = np.sqrt(np.einsum("ij,ij->i", rows, rows)), block["ids"].tolist()
            for query, vector in zip(some["query_id"], some["embedding"], strict=True):
                out.extend((query, i, s) for i, s in best_of(query, scores(rows, lengths, np.asarray(vector, float)), ids, k))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return left.groupBy("dim", "block").cogroup(right.groupBy("dim", "block")).applyInPandas(search, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fit(points: DataFrame, asked: DataFrame, n: int, k: int) -> dict[int, Setting]:
    """A setting for every vector length, from at most FIT_QUERIES queries and FIT_ROWS points in all."""
    dice = F.xxhash64(F.lit("fit"), "embedding")
    some = asked.orderBy(F.xxhash64(F.lit("fit"), "query_id"), "query_id").limit(FIT_QUERIES)
    told = some.collect()
    near = exhaustive(points, asked.sparkSession.createDataFrame(told, asked.schema), n, k) if told else None
    true = ranked(near, k).select("query_id", F.col("vec_id").alias("_id")).join(points.select(F.explode("ids").alias("_id"), "embedding"), "_id").select("query_id", "embedding").collect() if told else []
    rows = points.orderBy(dice, "embedding").limit(FIT_ROWS).select("dim", "embedding").collect()
    unit = lambda x: np.asarray(x, float) / np.linalg.norm(x)
    answers: dict[int, list] = {}
    for r in true:
        answers.setdefault(r["query_id"], []).append(unit(r["embedding"]))
    out = {}
    for dim in sorted({r["dim"] for r in told}):
        own = [r for r in told if r["dim"] == dim and r["query_id"] in answers]
        sample = np.array([unit(r["embedding"]) for r in rows if r["dim"] == dim] or [unit(r["embedding"]) for r in own])
        out[dim] = fitted(np.array([unit(r["embedding"]) for r in own]), [np.array(answers[r["query_id"]]) for r in own], sample, n)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, stages: Stages, k: int = 5, settings: dict[int, Setting] | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest rows; both tables hold (vec_id, embedding).

    ``settings`` gives the tables' shape by vector length; where it is None it is fitted.
    """
    part = lambda frame: frame.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    least = part(vectors).groupBy("embedding", "vec_id").count().withColumn("place", F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    points = least.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("embedding"))
    points, counted = stages.kept(points, "points", {"n": F.count("*")})
    asked, asking = stages.kept(part(queries).groupBy(F.col("vec_id").alias("query_id"), "embedding").count().select("query_id", "embedding", F.size("embedding").alias("dim")), "queries", {"n": F.count("*")})
    n = counted["n"]
    settings = fit(points, asked, n, k) if settings is None else settings
    shelves = max(1, -(-n * max((s.tables for s in settings.values()), default=1) // SHELF))

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, Setting]]:
        for batch in batches:
            for dim, some in batch.groupby("dim"):
                if dim in settings:
                    rows = np.stack(some["embedding"].to_numpy())
                    yield some, rows / np.linalg.norm(rows, axis=1)[:, None], settings[dim]

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some, unit, setting in dealt(batches):
            for table in range(setting.tables):
                key = buckets(unit, table, setting)
                yield some.assign(key=key, shelf=key % shelves)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some, unit, setting in dealt(batches):
            keys = np.concatenate([visits(unit, table, setting) for table in range(setting.tables)], axis=1)
            for at, own in enumerate(keys):
                own = own[np.argsort(own % shelves, kind="stable")]
                shelf, starts = np.unique(own % shelves, return_index=True)
                yield some.iloc[np.full(len(shelf), at)].assign(shelf=shelf, keys=np.split(own, starts[1:]))

    posted = stages.keep(points.mapInPandas(post, "embedding array<double>, ids array<long>, dim int, key long, shelf long"), "postings")
    asks = stages.keep(asked.mapInPandas(ask, "query_id long, embedding array<double>, dim int, shelf long, keys array<long>"), "visits")
    # a shelf with many points is dealt over salts, and its queries go to all of them; one with many queries over rounds, and its points go to all of those
    load = posted.groupBy("dim", "shelf").agg(F.ceil(F.count("*") / SHELF / 2).cast("int").alias("salts")).join(asks.groupBy("dim", "shelf").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("rounds")), ["dim", "shelf"])
    load = stages.keep(load, "load")
    upto = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = posted.join(load, ["dim", "shelf"]).select("embedding", "ids", "key", "dim", "shelf", F.pmod(F.xxhash64("embedding"), "salts").cast("int").alias("salt"), upto("rounds").alias("round"))
    right = asks.join(load, ["dim", "shelf"]).select("query_id", "embedding", "keys", "dim", "shelf", upto("salts").alias("salt"), F.pmod(F.xxhash64("query_id"), "rounds").cast("int").alias("round"))

    def search(shelf: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        return search_shelf(shelf, some, k) if len(shelf) and len(some) else NOTHING

    key = ["dim", "shelf", "salt", "round"]
    best = stages.keep(ranked(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, FOUND), k), "nearest")
    served = best.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    short, rest = stages.kept(asked.join(served, "query_id", "left_anti"), "short", {"n": F.count("*")})
    if not rest["n"]:
        return best
    return best.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(ranked(exhaustive(points, short, n, k), k))
