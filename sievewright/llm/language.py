"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased, everything but letters becomes a space, and each run of two to four bytes of its UTF-8 form
falls into one of ``BUCKETS`` buckets. A bucket has an embedding; the embeddings of a text's runs are averaged
and a linear layer with softmax gives the languages. Both layers are trained by stochastic gradient descent in
numpy on a bounded sample of labelled rows: SAMPLE rows and SAMPLE_BYTES of text, the same number for every language as far as it has them.
A language is learned if a row of it is among those. A temperature is fitted on rows kept apart, and the
score below which a prediction is rejected is the lowest that keeps the wanted precision there.

Workers hold the embeddings, of fixed size, and a row of WIDTH weights for each learned language (SAMPLE at most);
whole texts are read, in batches, with bounded memory.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every text where no
labelled row can be learned from; a null doc_id is not held out and not learned from; repeated rows each get a row; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import id_in, id_out, row_key

BUCKETS, WIDTH = 1 << 16, 16
#: What a model learns from at most, over all languages: rows, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 4000, 64 << 20
EPOCHS, RATE, SEED = 4, 1.0, 3
PRECISION = 0.99
UNKNOWN = "und"

_not_letters = re.compile(r"[\W\d_]+")


def runs(text: str) -> np.ndarray:
    """The buckets of a text's runs of two, three and four bytes."""
    raw = np.frombuffer((" " + _not_letters.sub(" ", text.lower()).strip() + " ").encode(), np.uint8).astype(np.uint32)
    out, packed = [], raw
    for k in (1, 2, 3):
        if len(raw) <= k:
            break
        packed = packed[:-1] | (raw[k:] << np.uint32(8 * k))
        out.append((packed * np.uint32(2654435761) + np.uint32(k)) * np.uint32(2246822519) >> np.uint32(16))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    reject: float

    def raw(self, text: str) -> np.ndarray:
        found = runs(text)
        return self.embeddings[found].mean(axis=0) @ self.weights + self.bias if len(found) else self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        chances = softmax(self.raw(text) / self.temperature)
        best = int(chances.argmax())
        return self.languages[best], float(chances[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], langs: list[str], apart: list[bool]) -> Model:
    """A model from labelled texts; rows that are ``apart`` fit the temperature and the rejection only."""
    names = sorted(set(langs))
    rng = np.random.default_rng(SEED)
    embeddings, weights, bias = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32), np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)
    rows = [(text, names.index(lang)) for text, lang, out in zip(texts, langs, apart, strict=True) if not out and has_letter(text)]
    # whole texts and one line of each, so that short texts are learned too
    lines = [(max(text.split("\n")[::2], key=len), at) for text, at in rows]
    examples = []
    for text, at in rows + [x for x in lines if has_letter(x[0])]:
        found, counts = np.unique(runs(text), return_counts=True)
        examples.append((found, (counts / counts.sum()).astype(np.float32), at))
    total, done = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            found, share, at = examples[i]
            rate = RATE * (1 - done / total)
            done += 1
            hidden = share @ embeddings[found]
            error = softmax(hidden @ weights + bias)
            error[at] -= 1
            back = weights @ error
            weights -= rate * np.outer(hidden, error)
            bias -= 0.1 * rate * error
            embeddings[found] -= (rate * len(found) ** 0.5) * np.outer(share, back)
    model = Model(names, embeddings, weights, bias, 1.0, 0.0)
    held = [(model.raw(text), names.index(lang)) for text, lang, out in zip(texts, langs, apart, strict=True) if out and has_letter(text)]
    if held:
        scores, truth = np.array([s for s, _ in held]), np.array([t for _, t in held])
        loss = lambda t: -np.log(softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
        chances = softmax(scores / model.temperature)
        order = np.argsort(-chances.max(axis=1), kind="stable")
        right = np.cumsum((chances.argmax(axis=1) == truth)[order]) / np.arange(1, len(order) + 1)
        enough = np.flatnonzero(right >= PRECISION)
        model.reject = float(chances.max(axis=1)[order[enough[-1]]]) if len(enough) else 1.0
    return model


def fold() -> Column:
    """crc32(doc_id as text) mod 5."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def sample(docs: DataFrame) -> list:
    """Labelled rows that are not held out, spread evenly over the languages, chosen by a hash of the id, within SAMPLE and SAMPLE_BYTES."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 0))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE).collect()
    if not counts:
        return []
    each, dice = max(SAMPLE // len(counts), 1), F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30))
    shares = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, 1.5 * each / r["count"] + 4.0 / r["count"]) * (1 << 30))) for r in counts], "_of string, _share long")
    key = row_key().alias("key")
    slim = known.select("lang", dice.alias("dice"), key, F.octet_length("text").alias("bytes"))  # no text moves
    drawn = slim.join(F.broadcast(shares), F.col("lang") == F.col("_of")).where(F.col("dice") < F.col("_share")).select("lang", "dice", "key", "bytes")  # at most SAMPLE rows of shares
    rank = F.row_number().over(W.partitionBy("lang").orderBy("dice", "key"))
    rows = drawn.withColumn("rank", rank).where(F.col("rank") <= each).orderBy("rank", "dice", "key").limit(SAMPLE).collect()  # ids and sizes only
    chosen, left = [], SAMPLE_BYTES
    for r in rows:
        if r["bytes"] <= left:
            chosen.append(r["key"])
            left -= r["bytes"]
    texts = known.where(row_key().isin(chosen)).select("doc_id", "text", "lang", fold().alias("fold"), key).dropDuplicates(["key"])
    return texts.collect()


def fit(docs: DataFrame) -> Model:
    """A model from the labelled rows of ``docs``; of the folds 1 to 4, the first calibrates."""
    rows = sorted(sample(docs), key=lambda r: (r["doc_id"], r["text"], r["lang"]))
    if not rows:
        return Model([], np.zeros((BUCKETS, WIDTH), np.float32), np.zeros((WIDTH, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    learned = {r["lang"] for r in rows if r["fold"] != 1}  # a language met in the calibrating fold alone is learned from that
    return train([r["text"] for r in rows], [r["lang"] for r in rows], [r["fold"] == 1 and r["lang"] in learned for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted (false where the score calls for rejection) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS + SAMPLE rows of WIDTH floats at most

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            found = [own.predict(text) for text in batch["text"]]
            score = np.array([s for _, s in found], dtype=np.float64)
            name = [n for n, _ in found]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": name, "score": score, "accepted": (score >= own.reject) & np.array([n != UNKNOWN for n in name], dtype=bool)})

    rows = docs.select(id_in(), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(predict, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean").withColumn("doc_id", id_out().cast(kind))
