"""Spelling variants against brute force over all pairs of words."""

import collections
import itertools
import random
import re
import zlib

import pytest

from sievewright.llm import spelling
from sievewright.llm.common import Stages


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plainly(rows, least_chars=5, least_n=3, ratio=2, every=97):
    counts = collections.Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{word}".encode())
            if h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_n}
    near = collections.defaultdict(list)
    for a, b in itertools.combinations(words, 2):
        if abs(len(a) - len(b)) < 2 and one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return collections.Counter((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def got(frame):
    return collections.Counter(map(tuple, frame.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def varied(seed):
    rng = random.Random(seed)
    letters = "abABéÉÿ×"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(60)] + ["aaaaaa", "aaaaa", "aaaaaaa", "aabba", "abaab"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = rng.choice(stems[: rng.randrange(1, len(stems)) + 1])
            if rng.random() < 0.3:
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]])
            words.append(w)
        rows.append((i, rng.choice([" ", "-", "1", "·"]).join(words), None, None, 0, None, None, None))
    return rows


@pytest.mark.parametrize("told", [{}, {"every": 5, "least_n": 1, "least_chars": 3}])
def test_words(spark, docs, rows, told):
    every = [*rows, *varied(2), (9001, "z" * 700 + " " + "z" * 700, "", "", 0, "", "", ""), (9002, "z" * 700 + " " + "z" * 699, "", "", 0, "", "", "")]
    every += [(9100 + i, "hello " * (i < 4) + "Hellos " * (i < 12) + "hellost", None, None, 0, None, None, None) for i in range(40)]
    frame = spark.createDataFrame(every, docs.schema).repartition(3)
    expected = plainly(every, **told)
    assert got(spelling.spelling_groups(frame, Stages(spark), **told)) == expected
    assert any(form and root != form for _, form, root, *_ in expected)  # forms of forms


def test_nothing(spark, no_docs, docs):
    assert spelling.spelling_groups(no_docs, Stages(spark)).count() == 0
    bare = spark.createDataFrame([(1, None, None, None, 0, None, None, None), (2, "1 2 abc", None, None, 0, None, None, None)], docs.schema)
    assert spelling.spelling_groups(bare, Stages(spark)).count() == 0
    lone = spark.createDataFrame([(i, "hello", None, None, 0, None, None, None) for i in range(3)], docs.schema)
    assert got(spelling.spelling_groups(lone, Stages(spark), every=10**12)) == {("hello", None, "hello", 3, 0, None): 1}


def test_long_ways_to_a_root(spark):
    forms = spark.createDataFrame([(i, i + 1) for i in range(37)] + [(100, 3), (101, 37)], "id long, form long")
    assert {tuple(r) for r in spelling.roots(forms, Stages(spark)).collect()} == {(i, 37) for i in [*range(37), 100, 101]}


def test_nodes_stand_for_prefixes(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(400)})
    made = spelling.trie_nodes(spark.createDataFrame([(w,) for w in words], "word string").repartition(7), Stages(spark), "t").collect()
    assert [r["word"] for r in sorted(made, key=lambda r: r["rank"])] == words
    assert sorted(r["rank"] for r in made) == list(range(len(words)))
    prefix = {}
    for r in made:
        for d, node in enumerate(r["nodes"]):
            assert prefix.setdefault(node, r["word"][:d]) == r["word"][:d]
    assert len(prefix) == len(set(prefix.values()))  # one number for each prefix
    assert sorted(prefix) == list(range(len(prefix)))  # without gaps


def test_tasks_send_on_what_is_full(spark, monkeypatch):
    rows = [(i, f"word{chr(97 + i % 26)} hello there", None, None, 0, None, None, None) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, a string, b string, c long, d string, e string, f string").coalesce(1)
    monkeypatch.setattr(spelling, "COMBINED", 40)
    counts = dict(map(tuple, spelling.word_counts(frame, 5, 10**12).collect()))
    assert counts["hello"] == 60 and counts["there"] == 60
