"""Bitmaps of fixed size: which keys may be in a set, without shuffling the rows asked about.

A bitmap has `bits` bits, 2**26 (8 MB) at most, in pages of 32768 bits (4 KB), so it may
be broadcast whatever the size of the data. A bit set by chance only means that an exact
test follows for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored

BITS, PAGE = 1 << 22, 32_768


def bitmap(keys: DataFrame, bits: int = BITS) -> DataFrame:
    """The bitmap of column k: one row for each page that has a bit set."""
    assert bits % PAGE == 0 and bits <= 1 << 26
    slot = keys.select(F.pmod(F.xxhash64("k"), F.lit(bits)).alias("slot"))
    page = slot.groupBy(F.floor(F.col("slot") / PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col("slot") % PAGE).alias("map"))
    return stored(page, "bitmap")


def repeated(keys: DataFrame, bits: int = BITS) -> DataFrame:
    """The bitmap of the keys k that occur more than once."""
    return bitmap(keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), bits)


def in_bitmap(df: DataFrame, key: Column, pages: DataFrame, bits: int, name: str) -> DataFrame:
    """df with a boolean column `name`: whether the key's bit is set."""
    page, cell = free_name(df, "page", "map")
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    small = F.broadcast(pages.select(F.col("page").alias(page), F.col("map").alias(cell)))
    place = (slot % PAGE).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(cell), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.getbit(byte, place % 8), F.lit(0)) == 1
    return df.join(small, F.floor(slot / PAGE) == F.col(page), "left").withColumn(name, bit).drop(page, cell)


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells documents apart by id and text, as ids may be null or repeated; null texts count as empty."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary")))


def drop_rows(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """docs without the rows whose row_key is in column k of gone. Only rows whose bit is set are shuffled."""
    maybe, other = free_name(docs, "maybe_gone", "gone_key")
    key = row_key(F.col(id_col), F.col(text_col))
    gone = stored(gone.select("k").distinct(), "gone")
    marked = in_bitmap(docs, key, bitmap(gone, bits), bits, maybe)
    left = marked.filter(F.col(maybe)).join(gone.withColumnRenamed("k", other), key == F.col(other), "left_anti")
    return marked.filter(~F.col(maybe)).unionByName(left).select(*docs.columns)


def keep_one(docs: DataFrame, repeated: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """docs with one of the rows that share a row_key in column k of repeated. Only rows whose bit is set are shuffled."""
    maybe, key = free_name(docs, "maybe_again", "again_key")
    marked = in_bitmap(docs, row_key(F.col(id_col), F.col(text_col)), bitmap(repeated, bits), bits, maybe)
    once = marked.filter(F.col(maybe)).withColumn(key, row_key(F.col(id_col), F.col(text_col))).dropDuplicates([key])
    return marked.filter(~F.col(maybe)).select(*docs.columns).unionByName(once.select(*docs.columns))
