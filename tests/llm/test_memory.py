"""What a worker holds in memory at once, whatever the number of texts and words."""

import collections
import random
import tracemalloc

import pyarrow as pa
from sievewright.llm import jaccard, tokens


class Caught(Exception):
    pass


class Docs:
    """Stands for a table, and keeps what would run in its tasks."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = lambda batch: [dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)) for b in run(iter([batch]))]
        raise Caught

    def mapInPandas(self, run, schema):
        self.run = lambda batch: [dict(zip(b["shingle"], b["n"], strict=True)) for b in run(iter([batch.to_pandas()]))]
        raise Caught


def peak(work):
    """What ``work`` gives, and the most bytes that it took."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_counting_shingles_holds_a_chunk_once(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(2500)) for _ in range(100)]
    texts += [texts[0], texts[0], texts[1], None, "", "one"]
    monkeypatch.setattr(jaccard, "CHUNK", 260_000)
    docs = Docs()
    try:
        jaccard.frequencies(docs, 3)
    except Caught:
        pass
    found, most = peak(lambda: docs.run(pa.RecordBatch.from_pydict({"text": texts})))
    counts = collections.Counter(x for t in texts for x in jaccard.shingles(jaccard.shingle_words(t), 3).view("int64").tolist())
    assert found == [{x: n for x, n in counts.items() if n > 1}]
    assert most < 2 * 8 * jaccard.CHUNK


def test_counting_takes_texts_of_more_shingles_than_a_chunk(monkeypatch):
    texts = [" ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(8)), " ".join(f"b{i}" for i in range(8)), None]
    monkeypatch.setattr(jaccard, "CHUNK", 20)
    docs = Docs()
    try:
        jaccard.frequencies(docs, 3)
    except Caught:
        pass
    found = collections.Counter()
    for part in docs.run(pa.RecordBatch.from_pydict({"text": texts})):
        found.update(part)
    assert sorted(found.values()) == [2] * 6


def test_words_remembered_for_packing_are_bounded():
    ids = tokens._Ids(lambda word: [1, 2], " ")
    told, most = peak(lambda: sum(len(ids[f"word{i}"]) for i in range(600_000)))
    assert told == 600_000 * 8
    assert most < 60_000_000
