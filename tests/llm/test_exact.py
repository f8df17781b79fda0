"""Exact duplicates and their index against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from sievewright.llm import exact
from sievewright.llm.common import Stages


def plainly(rows):
    bare = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    order = lambda r: (-len(r[1] or ""), float("inf") if r[0] is None else r[0])
    groups = collections.defaultdict(list)
    for r in rows:
        groups[bare(r[1])].append(r)
    return collections.Counter(
        (r[0], best[0], len(of), order(r) == order(best), hashlib.sha256(t.encode()).hexdigest()) for t, of in groups.items() for best in [min(of, key=order)] for r in of
    )


def got(frame):
    return collections.Counter(map(tuple, frame.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))


@pytest.fixture(scope="module")
def copies(rows):
    rng = random.Random(8)
    texts = ["ab c", "a bc", "abc", " a\tb\x0b\x0cc\r\n", "a\xa0bc", "a\x1cbc", "ABC", "é", "é", "\x00", ""]
    more = [(1000 + i, rng.choice(texts), None, None, 0, None, None, None) for i in range(300)]
    return [*rows, *more, *((2000 + i, f"single {i}", None, None, 0, None, None, None) for i in range(500))]


@pytest.mark.parametrize(("bits", "capacity"), [(60, 1024), (60, 4), (5, 16), (1, 1), (12, 7)])
def test_groups(spark, docs, copies, bits, capacity):
    """Short keys make chains of many texts; small buckets make a deep directory."""
    frame = spark.createDataFrame(copies, docs.schema).repartition(5)
    assert got(exact.exact_groups(frame, Stages(spark), bits, capacity)) == plainly(copies)


def test_nothing_and_one_text(spark, docs, no_docs):
    assert exact.exact_groups(no_docs, Stages(spark)).count() == 0
    one = [(i, "same text" + " " * (i % 3), None, None, 0, None, None, None) for i in range(50)]
    assert got(exact.exact_groups(spark.createDataFrame(one, docs.schema), Stages(spark))) == plainly(one)


def test_rows_that_stay(spark, docs, rows):
    left = exact.without_copies(docs, Stages(spark))
    assert left.columns == docs.columns
    expected = {(d, sha) for (d, _, _, kept, sha), _ in plainly(rows).items() if kept}
    found = [(r["doc_id"], hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", r["text"] or "").encode()).hexdigest()) for r in left.collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_directory_doubles_where_buckets_are_full():
    assert exact.directory(np.array([5]), 1).tolist() == [0]
    assert exact.directory(np.array([1, 1, 1, 1]), 4).tolist() == [0]
    assert exact.directory(np.array([9, 1, 1, 1]), 4).tolist() == [0, 1, 2, 2]  # only the full half goes deeper
    assert exact.directory(np.array([0, 0, 0, 0, 0, 0, 0, 9]), 4).tolist() == [0, 0, 0, 0, 1, 1, 2, 3]
    rng = random.Random(4)
    for _ in range(40):
        cells = np.array([rng.randrange(4) for _ in range(256)])
        slots = exact.directory(cells, 20)
        wide = 256 // len(slots)
        assert (np.diff(slots) >= 0).all() and (np.diff(slots) <= 1).all() and slots[0] == 0
        held = collections.Counter(np.repeat(slots, wide).repeat(cells).tolist())
        assert all(n <= 20 for n in held.values())
        assert len(slots) == 1 or any(len(set(slots[i : i + 2])) == 2 for i in range(0, len(slots), 2))  # no deeper than its deepest bucket


def test_equal_digests_of_different_texts_end_the_run():
    chains = exact.Chains()
    chains.add(1, 1, 5, -1, b"d", "one")
    chains.add(1, 1, 3, -2, b"e", "two")
    chains.add(1, 1, 9, -3, b"d", "one")
    assert [link[:3] for link in chains.by_key[1]] == [[2, 9, -3], [1, 3, -2]]
    with pytest.raises(ValueError, match="digest"):
        chains.add(1, 1, 5, -1, b"d", "three")


def test_tasks_send_on_what_is_full(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(exact, "COMBINED", 1000)
    batch = pd.DataFrame({"key": [1, 1, 2, 3, 4, 5, 1], "digest": [b"a", b"a", b"b", b"c", b"d", b"e", b"a"], "points": range(7), "place": [0] * 7, "text": ["x" * 300, "x" * 300, "y" * 300, "z" * 300, "u" * 300, "v", "x" * 300]})
    sent = list(exact.combined(iter([batch])))
    assert len(sent) > 1
    assert sum(f["n"].sum() for f in sent) == 7
