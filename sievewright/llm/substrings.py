"""Removal of long passages that an earlier document has, by prefix-partitioned suffix trees.

A passage counts from ``LENGTH`` words on, and a suffix is a document from some word on. Two suffixes meet in an internal node at
least that deep exactly if they begin with the same LENGTH words.

1. Suffixes are split by their prefixes: the key of a suffix is its anchor, the run of ``STEM`` words with the least hash among
   its first LENGTH words. Suffixes that meet in a deep node have equal prefixes and so equal anchors, and neighbouring
   suffixes mostly share theirs, so one row carries a run of suffixes and their words once.
2. Anchors that lie in one distinct text only have no deep node below them. Anchors of at least two texts are marked in
   a bitmap sized by their number, which workers hold while they read the documents again; only runs with marked anchors are kept.
3. Runs are gathered by anchor into groups of some TREE bytes. A task sorts the suffixes of its group by their words (prefix
   doubling), takes the common prefix lengths of neighbours, and cuts the order wherever they are below LENGTH: what stays together
   lies below one deep internal node, the words common to it being a maximal repeat. Words are compared themselves.
4. An anchor with more than SPLIT suffixes is split by a longer prefix, all LENGTH words, by their 128-bit digest. Such a prefix is
   one deep node already, with any number of suffixes; those are combined before they are shuffled.
5. Each suffix below a deep node with an earlier document marks its first LENGTH words. Marked words leave the text.

Documents with equal words are one text: all but the earliest lose all words at once, and only one takes part above.

Defined results: null and empty texts have no words and keep none; a null doc_id counts as later than any other; rows that
share a doc_id are one document to each other (neither is earlier); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, filter_bits, maybe_among

LENGTH, STEM = 50, 8
#: Bytes of the runs in one tree's group, on average, and suffixes of an anchor from which on it is split by a longer prefix.
TREE, SPLIT = 4 << 20, 20_000
#: Nodes at most that are broadcast: those that have more than this share of all suffixes of such anchors.
HEAVY = 10_000
LATEST = 2**63 - 1


def stems(words: list[bytes]) -> np.ndarray:
    """Hashes of the runs of STEM words, by their first word."""
    out, size = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), 1
    while size < STEM:
        mixed = (out[:-size] ^ (out[:-size] >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + out[size:]
        out, size = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), 2 * size
    return out


def anchors(own: np.ndarray) -> np.ndarray:
    """For every suffix of LENGTH words or more the place of its anchor (the first of the least hashes), from the document's stems."""
    inside = np.lib.stride_tricks.sliding_window_view(own, LENGTH - STEM + 1)
    return np.arange(len(inside)) + inside.argmin(axis=1)


def text_id(words: list[bytes]) -> tuple[str, str]:
    """The SHA-256 of the words joined by one space, and 128 bits of it as an id."""
    digest = hashlib.sha256(b" ".join(words)).hexdigest()
    return digest, digest[:32]


def _split(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def read(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, sha, cls and the distinct anchors of every row; a worker gives the anchors of equal texts once."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = _split(text)
                sha, cls = text_id(words)
                found = None
                if len(words) >= LENGTH and cls not in seen:
                    seen.add(cls)
                    own = stems(words)
                    found = np.unique(own[anchors(own)]).view(np.int64)
                rows.append((doc, len(words), sha, cls, found))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "sha", "cls", "anchors"]).astype({"doc_id": "int64"})

    return docs.mapInPandas(each, "doc_id long, n_words long, sha string, cls string, anchors array<long>")


def runs(docs: DataFrame, shared: list, bits: int) -> DataFrame:
    """anchor, doc, cls, start, count, words: runs of suffixes with one marked anchor. Of equal texts a worker gives the earliest it has met."""
    marks = np.zeros(bits // 8, np.uint8)
    for row in shared:
        marks[(row["of"] - 1) * 4096 : row["of"] * 4096] = np.frombuffer(row["map"], np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(marks)  # at most MOST_BITS

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, earliest = held.value, {}
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = _split(text)
                if len(words) < LENGTH:
                    continue
                cls = text_id(words)[1]
                if earliest.get(cls, LATEST + 1) <= doc:
                    continue
                earliest[cls] = doc
                own = stems(words)
                at = anchors(own)
                starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                keys = own[at[starts]]
                bit = (keys & np.uint64(bits - 1)).astype(np.int64)
                marked = (known[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
                ends = np.append(starts[1:], len(at))
                out.extend((int(key), doc, cls, start, end - start, b" ".join(words[start : end + LENGTH - 1]).decode()) for key, start, end, m in zip(keys.view(np.int64), starts.tolist(), ends.tolist(), marked, strict=True) if m)
            yield pd.DataFrame(out, columns=["anchor", "doc", "cls", "start", "count", "words"]).astype(dict.fromkeys(("anchor", "doc", "start", "count"), "int64"))

    return docs.mapInPandas(each, "anchor long, doc long, cls string, start long, count long, words string")


def sorted_suffixes(words: list[list[str]], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, place in it, common prefix length with the one before) of the first ``counts`` suffixes of every run, in the order of their first LENGTH words.

    Ranks of runs of 1, 2, 4, ... words come from pairs of ranks of half as many; a run's end is a word of its own kind.
    Common prefix lengths are read from the same ranks, from long to short, and are exact up to 2 * LENGTH.
    """
    ids: dict[str, int] = {}
    numbers = np.concatenate([np.array([ids.setdefault(w, len(ids)) for w in own] + [-i - 1]) for i, own in enumerate(words)])
    begins = np.cumsum([0] + [len(own) + 1 for own in words])
    rank = np.unique(numbers, return_inverse=True)[1].astype(np.int64)
    ladder, size = [rank], 1
    pair = lambda r, by: np.unique(r * (len(r) + 2) + np.append(r[by:] + 1, np.zeros(min(by, len(r)), np.int64)), return_inverse=True)[1].astype(np.int64)
    while 2 * size <= LENGTH:
        ladder.append(pair(ladder[-1], size))
        size *= 2
    full = pair(ladder[-1], LENGTH - size)
    run = np.repeat(np.arange(len(words)), counts)
    place = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begins[run] + place
    order = np.argsort(full[at], kind="stable")
    at, common = at[order], np.zeros(len(at), np.int64)
    for k in range(len(ladder) - 1, -1, -1):
        for _ in range(2 if k == len(ladder) - 1 else 1):
            a, b = np.minimum(at[:-1] + common[1:], len(rank) - 1), np.minimum(at[1:] + common[1:], len(rank) - 1)
            common[1:] += np.where(ladder[k][a] == ladder[k][b], 1 << k, 0)
    return run[order], place[order], common


def subtree(group: pd.DataFrame) -> pd.DataFrame:
    """doc, cls, pos: the suffixes of a group that lie below a deep internal node with an earlier document."""
    run, place, common = sorted_suffixes([w.split(" ") for w in group["words"]], group["count"].to_numpy())
    doc, cls, pos = group["doc"].to_numpy()[run], group["cls"].to_numpy()[run], group["start"].to_numpy()[run] + place
    nodes = np.flatnonzero(common < LENGTH)
    first = np.repeat(np.minimum.reduceat(doc, nodes), np.diff(np.append(nodes, len(doc))))
    later = doc > first
    return pd.DataFrame({"doc": doc[later], "cls": cls[later], "pos": pos[later]})


def long_prefixes(rows: DataFrame) -> DataFrame:
    """f1, f2, doc, cls, pos: every suffix of the runs with the digest of its first LENGTH words."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, cls, start, count, text in zip(batch["doc"], batch["cls"], batch["start"], batch["count"], batch["words"], strict=True):
                raw = text.encode()
                edges = np.flatnonzero(np.frombuffer(b" " + raw + b" ", np.uint8) == 32).tolist()
                for i in range(count):
                    digest = xxhash.xxh3_128_intdigest(raw[edges[i] : edges[i + LENGTH] - 1])
                    out.append(((digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63), doc, cls, start + i))
            yield pd.DataFrame(out, columns=["f1", "f2", "doc", "cls", "pos"]).astype(dict.fromkeys(("f1", "f2", "doc", "pos"), "int64"))

    return rows.mapInPandas(each, "f1 long, f2 long, doc long, cls string, pos long")


def remove_repeats(docs: DataFrame, stages: Stages) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the remaining text, null where nothing or everything went) for every row."""
    kind = docs.schema["doc_id"].dataType
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LATEST)).alias("doc_id"), "text")
    rows = stages.keep(read(docs), "rows")
    marks = rows.where("anchors is not null").select("cls", F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b")
    marks, marked = stages.kept(marks.select("anchor"), "marks", {"n": F.count("*")})
    bits = filter_bits(marked["n"])
    bit = (F.col("anchor").bitwiseAND(F.lit(bits - 1)) + 1).alias("bit")  # the last bits, as of an unsigned number; Spark counts from one
    shared = marks.select(bit).groupBy(F.bitmap_bucket_number("bit").alias("of")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map")).collect()  # at most MOST_BITS
    found, size = stages.kept(runs(docs, shared, bits), "runs", {"bytes": F.sum(F.octet_length("words").cast("long"))})
    stages.drop(marks)

    often = found.groupBy("anchor").agg(F.sum("count").alias("n")).where(F.col("n") > SPLIT).select("anchor")
    often = stages.keep(often, "often")  # at most one for each SPLIT suffixes
    trees = max(1, -(-(size["bytes"] or 0) // TREE))
    short = found.join(often, "anchor", "left_anti").withColumn("tree", F.pmod(F.xxhash64("anchor"), F.lit(trees)))
    below = short.groupBy("tree").applyInPandas(subtree, "doc long, cls string, pos long")
    many, suffixes = stages.kept(long_prefixes(found.join(often, "anchor", "left_semi")), "long-prefixes", {"n": F.count("*")})
    nodes = stages.keep(many.groupBy("f1", "f2").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1"), "nodes")
    # the fullest nodes, HEAVY at most, are told to every task, so that none gathers their suffixes; the others are met by a shuffle
    full = F.col("n") > max(SPLIT, suffixes["n"] // HEAVY)
    heavy, rest = F.broadcast(nodes.where(full)), nodes.where(~full)
    for met in (many.join(heavy, ["f1", "f2"]), many.join(heavy, ["f1", "f2"], "left_anti").join(rest, ["f1", "f2"])):
        below = below.unionByName(met.where(F.col("doc") > F.col("first")).select("doc", "cls", "pos"))
    removed, cuts = stages.kept(below.groupBy("doc", "cls").agg(F.collect_set("pos").alias("at")), "removed", {"n": F.count("*")})  # one row of at most all its words per document
    stages.drop(found, many)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, cls, at, text in zip(batch["doc"], batch["cls"], batch["at"], batch["text"], strict=True):
                words = _split(text)
                if text_id(words)[1] != cls:  # another row with the same doc_id
                    continue
                edges = np.zeros(len(words) + 1, np.int32)
                np.add.at(edges, at, 1)
                np.add.at(edges, np.minimum(np.asarray(at) + LENGTH, len(words)), -1)
                gone = np.cumsum(edges[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                out.append((doc, cls, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield pd.DataFrame(out, columns=["_doc", "_cls", "n_cut", "cut_sha", "kept"]).astype({"_doc": "int64", "n_cut": "int64"})

    texts = maybe_among(docs, "doc_id", removed, "doc", cuts["n"]).distinct()
    done = texts.join(removed, F.col("doc_id") == F.col("doc")).mapInPandas(cut, "_doc long, _cls string, n_cut long, cut_sha string, kept string")
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("first"))
    joined = rows.select("doc_id", "n_words", "sha", "cls").join(first, "sha").join(done, (F.col("doc_id") == F.col("_doc")) & (F.col("cls") == F.col("_cls")), "left")
    copy = (F.col("n_words") >= LENGTH) & (F.col("first") < F.col("doc_id"))
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select(
        F.when(F.col("doc_id") != LATEST, F.col("doc_id")).cast(kind).alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(~copy, F.col("kept")).alias("kept"),
    )
