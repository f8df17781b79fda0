"""Fill-in-middle against a plain version with regular expressions."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import middles

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plainly(doc_id, text, seed=42, percent=50, spm=80, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in marks) or h[2] % 100 >= percent:
        return doc_id, n, "plain", None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"{marks[0]}{p}{marks[1]}{s}{marks[2]}{m}" if form == "psm" else f"{marks[1]}{s}{marks[0]}{p}{marks[2]}{m}"
    return doc_id, n, form, len(p), len(m), out


ODD = ["<P>", "a <S> b", "x<M", "<", "<<P", "P> a <", "  nbsp   em", "\x1c\x1d a \x85 b", "  lead", "trail \t\n", "\U0001f600 \U0001f600\n\U0001f600", "é a", "\x00 a\x00"]


def test_every_row(spark, docs, rows, no_docs):
    more = [(1000 + i, t, None, None, 0, None, None, None) for i, t in enumerate(ODD * 12)]
    frame = docs.unionByName(spark.createDataFrame(more, docs.schema))
    for told in ({}, {"percent": 100, "spm_percent": 0, "seed": 7}):
        got = middles.fill_in_middle(frame, **told)
        expected = [plainly(r[0], r[1], told.get("seed", 42), told.get("percent", 50), told.get("spm_percent", 80)) for r in [*rows, *more]]
        assert collections.Counter(map(tuple, got.collect())) == collections.Counter(expected)
        assert {e[2] for e in expected} >= ({"plain", "psm"} if told else {"plain", "psm", "spm"})
        back = got.select("doc_id", middles.restored(F.col("output"), F.col("form")).alias("text"))
        assert collections.Counter(map(tuple, back.collect())) == collections.Counter((r[0], r[1] or "") for r in [*rows, *more])
    assert middles.fill_in_middle(no_docs).count() == 0


def test_other_markers_and_those_that_overlap(spark, docs, rows):
    marks = ("[pre]", "[suf]", "[mid]")
    got = middles.fill_in_middle(docs, percent=100, markers=marks)
    back = got.select("doc_id", middles.restored(F.col("output"), F.col("form"), marks).alias("text"))
    assert collections.Counter(map(tuple, back.collect())) == collections.Counter((r[0], r[1] or "") for r in rows)
    for bad in (("aXa", "b", "c"), ("<P", "P>", "<M>"), ("x", "x", "y"), ("ab", "b", "c")):
        with pytest.raises(ValueError):
            middles.fill_in_middle(docs, markers=bad)


def test_lanes_reach_every_rank(monkeypatch):
    rng = random.Random(3)
    for n in (0, 1, 2, 5, 100, 4096, 4097, 30_000):
        ends = np.cumsum([rng.randrange(1, 30) for _ in range(n)]).astype(np.int64)
        units = middles.SkipList(ends)
        for rank in {0, n, *(rng.randrange(n + 1) for _ in range(200))}:
            assert units.before(rank) == (int(ends[rank - 1]) if rank else 0)
    assert len(units.units) >= 6  # lanes thin out by four
    assert all(len(a) > 2 * len(b) for a, b in zip(units.units[:4], units.units[1:5], strict=True))
    assert all(a.sum() <= n for a in units.units)


def test_descent_takes_few_links():
    class Counted(list):
        seen = 0

        def __getitem__(self, i):
            Counted.seen += 1
            return super().__getitem__(i)

    units = middles.SkipList(np.arange(1, 200_001, dtype=np.int64) * 3)
    units.units = [Counted(x.tolist()) for x in units.units]
    for rank in range(0, 200_001, 9973):
        Counted.seen = 0
        assert units.before(rank) == 3 * rank
        assert Counted.seen < 300  # lanes of a quarter each: not the rank
