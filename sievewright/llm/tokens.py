"""Token counts through a digest cache, and token ids for packing.

Both tokenizers split a text into pieces that never merge with each other: no vocabulary entry of the piece
model has a space mark after another character or holds a line feed, and the byte-level model splits by its
pattern first. So a worker keeps what it has learned about single words (up to a bound) and encodes only words
it has not met. Texts in which that split is not plain (other white space, doubled spaces, special strings)
are encoded whole by the library.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, id_in, id_out

#: Words whose count, and words whose ids, a worker remembers at most (twice as many with those at a line's start). Workers outlive
#: a query and take what they remember along.
REMEMBERED, REMEMBERED_IDS = 600_000, 300_000
#: A row for each piece of a document.
PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

_models: dict = {}


class _Counts(dict):
    """Words to token counts of the piece model; a missing word is encoded, and kept while there is room."""

    def __init__(self, encode, first: str):
        super().__init__()
        self.encode, self.first = encode, first

    def __missing__(self, word: str) -> int:
        n = len(self.encode(word)) if self.first else len(self.encode("x\n" + word)) - self.fixed
        if len(self) < REMEMBERED:
            self[word] = n
        return n


class PieceCounter:
    """Token counts of texts exactly as sentencepiece gives them."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.plain = not any(re.search("[^▁]▁|\n", self.model.id_to_piece(i)) for i in ids) and self.count("a b") == self.count("a") + self.count("b")
        # after a line feed there is no space mark before a word
        self.spaced, self.bare = _Counts(self.model.encode, "▁"), _Counts(self.model.encode, "")
        self.bare.fixed = self.count("x\n")
        self.odd = re.compile("  |^ | $|▁|\n | \n").search

    def count(self, text: str) -> int:
        return len(self.model.encode(text))

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if not self.plain or self.odd(text):
            return self.count(text)
        first, *lines = text.split("\n")
        words = first.split(" ") if first else []
        total = (sum(map(self.spaced.__getitem__, words)) if words else 1) + len(lines)  # before a leading line feed the space mark stands alone
        for line in lines:
            if line:
                head, *words = line.split(" ")
                total += self.bare[head]
                if words:
                    total += sum(map(self.spaced.__getitem__, words))
        return total


class _Ids(dict):
    """Words to their ids, as little-endian unsigned 32-bit numbers."""

    def __init__(self, encode, before: str):
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(self.before + word), dtype="<u4").tobytes()
        if len(self) < REMEMBERED_IDS:
            self[word] = ids
        return ids


class ByteIds:
    """Token ids of texts exactly as tokenizers gives them without added special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        encode = self._ordinary(path) or self.whole
        self.spaced, self.bare = _Ids(encode, " "), _Ids(encode, "")
        self.feed = np.array(self.whole("\n"), dtype="<u4").tobytes()
        specials = [re.escape(t.content) for t in self.model.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([r"[^\S \n]", r"\s\s", *specials])).search

    def whole(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def _ordinary(self, path: str):
        """The same vocabulary through a faster library where its rank file lies beside and agrees; else None."""
        import base64
        import os

        ranks = path.removesuffix(".json") + ".tiktoken"
        if not os.path.exists(ranks):
            return None
        import tiktoken
        from public_tokenizers import PATTERN

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        probe = "It's 12 o'clock — naïve über-façade, 日本 tokens!\n\tx  y ..."
        return fast if fast(probe) == self.whole(probe) else None

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.odd(text):
            return np.array(self.whole(text), dtype="<u4").tobytes()
        parts: list[bytes] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                parts.append(self.feed)
            if line:
                head, *words = line.split(" ")
                if head:
                    parts.append(self.bare[head])
                parts.extend(map(self.spaced.__getitem__, words))
        return b"".join(parts)


def model(kind, path: str):
    """A worker's own copy of a tokenizer."""
    if (kind, path) not in _models:
        _models[kind, path] = kind(path)
    return _models[kind, path]


def version(path: str) -> str:
    """A digest of the tokenizer file: counts of another version never answer for this one."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache as (tokenizer, digest, n_tokens); empty where nothing has been appended yet."""
    schema = "tokenizer string, digest string, n_tokens long"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of ``docs``.

    Content is normalised to the form that the tokenizer itself sees (null becomes empty, nothing else), and
    keyed by the SHA-256 digests of that content and of the tokenizer file. Digests found in the cache are
    answered from it; of the others, one row each is encoded and appended to ``cache``. Among rows with equal
    content the encoded one is that with the smallest doc_id, so texts move once, by a key that spreads copies.

    Repeated rows each get their count; a null doc_id is kept; an empty table gives an empty result.
    A task that is run again encodes again, and the append is one atomic write.
    """
    spark = docs.sparkSession
    kind = version(tokenizer)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    known = read_cache(spark, cache).where(F.col("tokenizer") == kind).select("digest", "n_tokens")
    # copies are combined before anything is shuffled by digest
    missing = keyed.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("first")).join(known, "digest", "left_anti")
    texts = docs.select(F.sha2(text, 256).alias("digest"), F.coalesce("doc_id", F.lit(-1)).alias("first"), text.alias("text"))
    wanted = texts.join(missing, ["digest", "first"]).select("digest", "text")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, seen = model(PieceCounter, tokenizer), set()
        for batch in batches:
            fresh = [(d, t) for d, t in zip(batch["digest"], batch["text"], strict=True) if not (d in seen or seen.add(d))]  # repeated rows mostly meet here
            yield pd.DataFrame({"tokenizer": kind, "digest": [d for d, _ in fresh], "n_tokens": np.array([count(t) for _, t in fresh], dtype="int64")})

    # repeated rows may be read by different tasks, and two writers may append at once: a digest has one count
    fresh = wanted.mapInPandas(encode, "tokenizer string, digest string, n_tokens long").groupBy("tokenizer", "digest").agg(F.max("n_tokens").alias("n_tokens"))
    fresh.write.mode("append").parquet(cache)
    # written, so that both sides of the join are plain tables and Spark can split the rows of a frequent text
    every = Stages(spark).keep(read_cache(spark, cache).where(F.col("tokenizer") == kind).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return keyed.join(every, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def document_pieces(docs: DataFrame, tokenizer: str, length: int, end: int) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32: each document's ids and its end id, cut at ``length``.

    Only documents beyond ``length`` are cut; then all pieces are full but the first.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, last = model(ByteIds, tokenizer), int(end).to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                all_ids = ids(text.as_py()) + last
                n = len(all_ids) // 4
                at, piece, size = 0, 0, (n - 1) % length + 1
                while at < n:
                    rows.append((doc, piece, at, size, zlib.crc32(all_ids[4 * at : 4 * (at + size)])))
                    at, piece, size = at + size, piece + 1, length
            yield pa.RecordBatch.from_arrays([pa.array([row[at] for row in rows], field.type) for at, field in enumerate(PIECE)], schema=PIECE)

    made = docs.select(id_in(), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return made.withColumn("doc_id", id_out())
