"""Spelling variants: words next to each other by one edit, found through pairs of trie nodes.

The vocabulary's prefixes are the nodes of a trie, its suffixes those of a trie of reversed words; both are numbered. A word and
one of its positions give the pair (node of the prefix before it, node of the suffix behind it), with the position's character
skipped, or with nothing between. Words that share a pair of skipped positions differ in one character; a skipped and an
unskipped pair that are equal lead from a word to one that is shorter by that character. A join on two integers is exact,
and no pair is shared by more words than the alphabet has characters, and one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, Stages, id_in

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
_lower = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
#: Characters of different words that a task combines before it sends them on.
COMBINED = 8 << 20


def word_counts(docs: DataFrame, least_chars: int, every: int) -> DataFrame:
    """(word, n) of at least ``least_chars`` code points: runs of letters, with A to Z lower-cased, and one code point deleted where ``every`` divides a checksum of id and run."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, held = Counter(), 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                start = zlib.crc32(b":" if doc == NO_ID else f"{doc}:".encode())
                for run, n in Counter(RUNS.findall(text)).items():
                    word = run.lower() if run.isascii() else run.translate(_lower)
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least_chars:
                        held += 0 if word in counts else len(word) + 20
                        counts[word] += n
                if held > COMBINED:
                    yield pd.DataFrame(counts.items(), columns=["word", "n"])
                    counts, held = Counter(), 0
        yield pd.DataFrame(counts.items(), columns=["word", "n"])

    parts = docs.select(id_in(), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def shared(a: str, b: str) -> int:
    """How many code points two words have in common at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


class Numbering:
    """Numbers of the nodes of a trie, as its words come in order: ``nodes[d]`` is the node of the last word's first ``d`` code points."""

    def __init__(self, next_node: int, word: str = "", nodes: list[int] | None = None):
        self.next, self.word, self.nodes = next_node, word, nodes or [0]

    def add(self, word: str) -> list[int]:
        old = shared(self.word, word)
        fresh = self.next + len(word) - old
        self.nodes = [*self.nodes[: old + 1], *range(self.next, fresh)]
        self.next, self.word = fresh, word
        return self.nodes


def trie_nodes(words: DataFrame, stages: Stages, name: str) -> DataFrame:
    """``words`` (word, and other columns) with ``rank``, a word's place in order from 0, and ``nodes``, the numbers of its prefixes' nodes.

    Words are sorted by range. A first pass numbers every range by itself and gives its ends: a row for each range, from which the
    driver tells each range where its numbers begin and which nodes it shares with the words before. The second pass numbers.
    """
    spark = words.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = stages.keep(words.repartitionByRange(ranges, "word").withColumn("part", F.spark_partition_id()), name)
    dealt = ordered.repartition(ranges, "part").sortWithinPartitions("part", "word")

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, first, n, run, rows = None, "", 0, None, []
        close = lambda: rows.append((part, first, run.word, n, run.next - 1, run.nodes)) if run else None
        for batch in batches:
            for of, word in zip(batch["part"], batch["word"], strict=True):
                if of != part:
                    close()
                    part, first, n, run = of, word, 0, Numbering(1)
                run.add(word)
                n += 1
        close()
        yield pd.DataFrame(rows, columns=["part", "first", "last", "n", "fresh", "nodes"])

    told, rank, last = {}, 0, Numbering(1)
    for r in sorted(dealt.select("part", "word").mapInPandas(ends, "part int, first string, last string, n long, fresh long, nodes array<long>").collect()):
        old = shared(last.word, r["first"])
        told[r["part"]] = (rank, last.next, last.word, last.nodes)
        # by itself the range took numbers from 1 on, the first of them for nodes that it shares
        nodes = [0 if x == 0 else last.nodes[x] if x <= old else last.next + x - old - 1 for x in r["nodes"]]
        rank, last = rank + r["n"], Numbering(last.next + r["fresh"] - old, r["last"], nodes)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at, run = None, 0, None
        for batch in batches:
            ranks, nodes = [], []
            for of, word in zip(batch["part"], batch["word"], strict=True):
                if of != part:
                    part, (at, *start) = of, told[of]
                    run = Numbering(*start)
                ranks.append(at)
                nodes.append(run.add(word))
                at += 1
            yield batch.drop(columns="part").assign(rank=ranks, nodes=nodes)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    return dealt.mapInPandas(number, f"{fields}, rank long, nodes array<long>")


def node_pairs(words: DataFrame, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """(words with their ids, pairs): for each word (word, n) and place a pair (a, b) of nodes, ``skip`` if the character there is left out.

    ``lone`` marks a skipped character unlike the one before it: deleting any of a row of like characters gives one word.
    An id is a word's place in code-point order.
    """
    forward = stages.keep(trie_nodes(words, stages, "words").withColumnRenamed("rank", "id"), "prefixes")
    turned = trie_nodes(forward.select(F.reverse("word").alias("word"), "id"), stages, "turned")
    backward = stages.keep(turned.select("id", F.col("nodes").alias("back")), "suffixes")
    both = forward.join(backward, "id").withColumn("chars", F.split("word", "")).withColumn("size", F.char_length("word"))
    get = lambda of, i: F.get(of, i)
    at = lambda skip, i, behind: F.struct(F.get("nodes", i).alias("a"), F.get("back", behind).alias("b"), F.lit(skip).alias("skip"), (F.lit(skip) & ((i == 0) | (get("chars", i) != get("chars", i - 1)))).alias("lone"))
    skipped = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: at(True, i, F.col("size") - i - 1))
    between = F.transform(F.sequence(F.lit(0), F.col("size")), lambda i: at(False, i, F.col("size") - i))
    return forward.select("id", "word", "n"), both.select("id", "n", F.explode(F.concat(skipped, between)).alias("p")).select("id", "n", "p.*")


def near_words(pairs: DataFrame) -> DataFrame:
    """(id, near, near_n): every word next to every other one that it differs from by one character inserted, deleted or replaced, once."""
    left = pairs.where("skip").select("a", "b", "id", "n", "lone")
    right = pairs.select("a", "b", F.col("id").alias("near"), F.col("n").alias("near_n"), F.col("skip").alias("replaced"))
    met = left.join(right, ["a", "b"]).where("id <> near AND (replaced OR lone)")
    there = F.struct("id", "near", "near_n")
    back = F.struct(F.col("near").alias("id"), F.col("id").alias("near"), F.col("n").alias("near_n"))
    return met.select(F.explode(F.when(F.col("replaced"), F.array(there)).otherwise(F.array(there, back))).alias("e")).select("e.*")


def roots(forms: DataFrame, stages: Stages) -> DataFrame:
    """(id, root) of words with a form (id, form): forms are followed by doubling, in a number of rounds that grows with the logarithm of the longest way.

    A form is at least twice as frequent as its word, so no way is longer than the logarithm of the largest count, and none is a ring.
    """
    now, seen = stages.kept(forms.select("id", F.col("form").alias("root")), "roots", {"moved": F.count("*")})
    while seen["moved"]:
        onward = now.select(F.col("id").alias("root"), F.col("root").alias("further"))
        before = now
        now, seen = stages.kept(now.join(onward, "root", "left").select("id", F.coalesce("further", "root").alias("root"), "further"), "roots", {"moved": F.count("further")})
        stages.drop(before)
        now = _without(now, "further")
    return now


def _without(frame: DataFrame, column: str) -> DataFrame:
    """A kept table without one of its columns."""
    less = frame.drop(column)
    less.kept_at = frame.kept_at
    return less


def spelling_groups(docs: DataFrame, stages: Stages, least_chars: int = 5, least_n: int = 3, ratio: int = 2, every: int = 97) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs`` with enough code points and occurrences.

    A word's form is its most frequent near word (the smallest in code-point order, if several) where that occurs at least ``ratio``
    times as often. A null text has no words, a null doc_id counts as an empty one, repeated rows count repeatedly, and an empty
    table gives an empty result. Counts are combined in the tasks that read, so that frequent words are not shuffled one by one.
    """
    counts = word_counts(docs, least_chars, every).where(F.col("n") >= least_n)
    words, pairs = node_pairs(counts, stages)
    # words come in order, so the smallest id is the smallest word
    best = near_words(stages.keep(pairs, "pairs")).groupBy("id").agg(F.count("*").alias("n_near"), F.max(F.struct(F.col("near_n").alias("n"), (-F.col("near")).alias("id"))).alias("best"))
    told = stages.keep(words.select("id", "n").join(best, "id", "left").select("id", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("best.n") >= ratio * F.col("n"), F.struct((-F.col("best.id")).alias("form"), F.col("best.n").alias("form_n"))).alias("f")).select("id", "n_near", "f.form", "f.form_n"), "forms")
    last = roots(told.where("form IS NOT NULL"), stages)
    named = lambda of, name: words.select(F.col("id").alias(of), F.col("word").alias(name))
    known = told.join(last, "id", "left").withColumn("root", F.coalesce("root", "id")).withColumnsRenamed({"form": "_form", "root": "_root"})
    return words.join(known, "id").join(named("_form", "form"), "_form", "left").join(named("_root", "root"), "_root").select("word", "form", "root", "n", "n_near", "form_n")
