"""Quality rules with thresholds learned per language and source from mergeable quantile sketches.

The sketch of a metric is a histogram over logarithmic buckets: each value falls into bucket
``ceil(log(value / LEAST) / log(GAMMA))``, so a quantile read from it is within 1 % of a true one. Adding
counts merges two sketches exactly, in any order; that gives map-side combination for hot sources. A group's
sketch is its own counts plus those of PRIOR documents distributed as its language's and of PRIOR distributed as all rows, whatever
the group's size: a small group leans on the others, a large one on itself, and nothing switches in between. A document is rejected where a
metric lies beyond the fence of its own group: the median, and REACH times the mean of how far the quantiles TAIL lie above it. Fences
have the scale of what they fence: rates that are mostly zero have their tail's, and no metric has a least or a usual value. Where less than
a hundredth of a blended sketch is above its median, whatever is above it lies beyond.

Everything is a DataFrame expression: no Python runs on the executors.

Defined results: null text has no words (and so fails the base rule); null language or source forms a group
of its own; a group with no document that passes the base rule has no thresholds (all its rows have failed); repeated rows each get a row;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import words

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
#: Ratio between bucket bounds, and the least value told from zero.
GAMMA, LEAST = 1.02, 1e-4
#: Documents that a group's language, and that all rows, add to the group's own; and the parts in which such fractions are counted.
PRIOR, PARTS = 100, 1_000_000
#: The quantiles that tell a group's tail, and how many times their mean distance from the median is still within.
TAIL, REACH = (0.75, 0.9, 0.95, 0.98, 0.99), 1.5
METRICS = ("symbol_rate", "dup_line_rate", "repeat_rate", "mean_word")


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more, from the array of window hashes by position."""

    def spread(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(pairs: Column) -> Column:
        same = lambda p, other: F.coalesce(other["h"] == p["h"], F.lit(False))
        kept = F.transform(pairs, lambda p, k: F.when(same(p, F.get(pairs, k + 1)) | ((k > 0) & same(p, F.get(pairs, F.greatest(k - 1, F.lit(0))))), p["i"]))
        return F.sort_array(F.filter(kept, lambda i: i.isNotNull()))

    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  a name for a value inside one expression
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    full = let(let(pairs, repeated), spread)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(full)


def base_counts(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, the columns to carry, and base_failed.

    Word windows are compared by 64-bit hashes of 64-bit word hashes within one document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    one = docs.select("doc_id", "lang", "source", *carry, words(F.col("text")).alias("_w"), lines.alias("_l"), (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    two = one.select(
        "doc_id", "lang", "source", *carry, "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    last = F.size("_h") - WINDOW
    windows = F.transform(F.slice("_h", F.lit(1), F.greatest(last + 1, F.lit(0))), lambda h, i: F.xxhash64(h, *(F.get(F.col("_h"), i + k) for k in range(1, WINDOW))))
    three = two.select("doc_id", "lang", "source", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", windows.alias("_win"))
    four = three.select("*", _covered(F.col("_win")).cast("long").alias("n_repeat_words")).drop("_win")
    return four.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _metrics(counts: DataFrame) -> dict[str, Column]:
    lines = F.col("n_lines") if "n_lines" in counts.columns else F.col("n_words")  # counts made elsewhere may lack lines
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbol_rate": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(lines, F.lit(1)),
        "repeat_rate": F.col("n_repeat_words") / n,
        "mean_word": F.col("word_chars") / n,
    }


def sketch(counts: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): one mergeable histogram per group and metric, of documents that pass the base rule."""
    bucket = lambda x: F.when(x <= LEAST, F.lit(0)).otherwise(F.ceil(F.log(x / LEAST) / math.log(GAMMA)).cast("int"))
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), bucket(x).alias("bucket")) for m, x in _metrics(counts).items()))
    return counts.where(~F.col("base_failed")).select("lang", "source", F.inline(pairs)).groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of coarser groups, by adding counts."""
    return sketches.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def histograms(sketches: DataFrame, *by: str) -> DataFrame:
    """A row per group: ``h``, its sketches as an array of (metric, bucket, n), in PARTS of a document. A sketch has some hundred buckets, however much it counts."""
    return sketches.groupBy(*by).agg(F.collect_list(F.struct("metric", "bucket", (F.col("n") * PARTS).alias("n"))).alias("h"))


def prior(sketches: DataFrame, *by: str) -> DataFrame:
    """A row per group: ``h`` for PRIOR documents distributed as the group's, in PARTS of a document."""
    scaled = sketches.withColumn("n", F.floor(PRIOR * PARTS * F.col("n") / F.sum("n").over(W.partitionBy(*by, "metric"))).cast("long"))
    return scaled.groupBy(*by).agg(F.collect_list(F.struct("metric", "bucket", "n")).alias("h"))


def fence(h: Column, metric: str) -> Column:
    """The upper fence of a metric, read from an array of (metric, bucket, n) that may name a bucket several times; null if it has none."""
    own = F.sort_array(F.transform(F.filter(h, lambda x: x["metric"] == metric), lambda x: F.struct(x["bucket"].alias("bucket"), x["n"].alias("n"))))
    shares = (0.5, *TAIL)

    def read(own: Column) -> Column:
        total = F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x["n"])
        start = F.struct(F.lit(0).cast("long").alias("upto"), *(F.lit(None).cast("int").alias(f"q{i}") for i in range(len(shares))))

        def step(acc: Column, x: Column) -> Column:
            upto = acc["upto"] + x["n"]
            return F.struct(upto.alias("upto"), *(F.coalesce(acc[f"q{i}"], F.when(upto >= share * acc["total"], x["bucket"])).alias(f"q{i}") for i, share in enumerate(shares)), acc["total"].alias("total"))

        start = F.struct(*(start[f] for f in ("upto", *(f"q{i}" for i in range(len(shares))))), total.alias("total"))
        return F.aggregate(own, start, step)

    value = lambda bucket: F.when(bucket == 0, F.lit(0.0)).otherwise(LEAST * F.pow(F.lit(GAMMA), bucket.cast("double")))
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    told = let(let(own, read), lambda q: F.array(*(value(q[f"q{i}"]) for i in range(len(shares)))))
    above = lambda v: F.aggregate(F.slice(v, 2, len(TAIL)), F.lit(0.0), lambda a, x: a + x - v[0]) / len(TAIL)
    return F.when(F.size(own) > 0, let(told, lambda v: v[0] + REACH * above(v)))


def thresholds(counts: DataFrame, stages) -> DataFrame:
    """lang, source and the fences that hold for that group.

    The sketches of a group, of its language and of all rows meet in one row, where they are read together: none is copied to the others' rows in a table.
    """
    sketches = stages.keep(sketch(counts), "sketches")
    language = prior(merge(sketches, "lang"), "lang").withColumnsRenamed({"lang": "_lang", "h": "near"})
    held = (F.size("h") >= 0).alias("_held")  # what all rows of both sides have in common
    every = prior(merge(sketches)).select(held, F.col("h").alias("far"))  # one row, of a few thousand buckets at most
    groups = histograms(sketches, "lang", "source").select("*", held).join(language, F.col("lang").eqNullSafe(F.col("_lang")))
    return groups.join(F.broadcast(every), "_held").select("lang", "source", F.concat("h", "near", "far").alias("h")).select("lang", "source", *(fence(F.col("h"), m).alias(f"{m}_max") for m in METRICS))


def judge(counts: DataFrame, stages) -> DataFrame:
    """counts with the group's thresholds and ``kept``."""
    limits = stages.keep(thresholds(counts, stages), "thresholds").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = counts.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    passed = F.lit(True)
    for name, x in _metrics(counts).items():
        passed = passed & F.coalesce(x <= F.col(f"{name}_max"), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & passed).drop("_lang", "_source")


def quality(docs: DataFrame, stages, *carry: str) -> DataFrame:
    """One row per row of ``docs``: counts, base rule, thresholds, verdict and columns to carry. Texts are read once."""
    return judge(stages.keep(base_counts(docs, *carry), "counts"), stages)


def passing(docs: DataFrame, stages) -> DataFrame:
    """The rows of ``docs`` whose verdict is kept, with their columns as they were."""
    packed = docs.select("doc_id", "lang", "source", "text", F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    return quality(packed, stages, "_row").where("kept").select("_row.*")
