"""Shared helpers: tables, words, ids and membership filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stages import Stages, workdir  # noqa: F401  shared by the modules beside
from ..sources.tables import table  # noqa: F401

#: Words are maximal runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


#: What stands for a null id inside Python, where a column with nulls would turn into floating point and lose digits.
NO_ID = -(2**63)


def id_in(column: str = "doc_id") -> Column:
    """An id for Python: a long that is never null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID)).alias(column)


def id_out(column: str = "doc_id") -> Column:
    """An id from Python, null again where it was."""
    return F.when(F.col(column) != NO_ID, F.col(column)).alias(column)


#: Bits of a membership filter, sized by the keys it holds: never more than 16 MB, which is broadcast. Beyond some ten million
#: keys it lets more and more rows through, and the join behind it does the rest.
LEAST_BITS, MOST_BITS, BITS_A_KEY = 1 << 20, 1 << 27, 12


def filter_bits(keys: int) -> int:
    """The bits of a membership filter for so many keys: a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * max(keys, 1) - 1).bit_length()))


def maybe_among(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str, keys: int) -> DataFrame:
    """``rows`` without most of those whose key is not among the ``keys`` wanted ones, and with all whose key is.

    The filter is a bitmap in rows of 4 KB, at most MOST_BITS / 32768 of them, so that it can be broadcast.
    """
    bits = filter_bits(keys)
    marks = wanted.select(F.pmod(F.xxhash64(wanted_key), F.lit(bits)).alias("bit"))
    bitmaps = marks.groupBy(F.bitmap_bucket_number("bit").alias("of")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    tested = rows.withColumn("_bit", F.pmod(F.xxhash64(key), F.lit(bits))).join(F.broadcast(bitmaps), F.bitmap_bucket_number("_bit") == F.col("of"))
    place = F.bitmap_bit_position("_bit").cast("int")
    byte = F.conv(F.hex(F.substring("map", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return tested.where(byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), place % 8 + 1)) != 0).drop("_bit", "of", "map")


def row_key(docs: DataFrame | None = None) -> Column:
    """A 64-bit hash of a row's id and text, null or not: what decisions about rows are joined back by."""
    column = F.col if docs is None else docs.__getitem__
    return F.xxhash64(column("doc_id").cast("long"), column("text"))
