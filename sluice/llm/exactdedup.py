"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

The texts' lengths are counted first. Texts whose length occurs again are hashed over a
prefix; those whose prefix occurs again, and no others, are hashed in full. Which lengths
and prefixes occur again is passed on as a bitmap of fixed size (`bits`, 2**26 at most,
8 MB), so no text is shuffled to find out: a bit set by chance costs one more full hash
and changes no result. Groups are counted before they are shuffled, and a group of any
size stays a count and a largest id.

Null texts count as empty. Texts are equal when identical after lower-casing A-Z only.
Of equal texts the largest id stays (null ids count as smallest). Rows that repeat both
id and text are one document: `mark` marks all of them as kept, and `deduplicate` leaves
one of them. An empty table gives an empty result; other columns, whatever their names,
are carried by `deduplicate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmaps import BITS, in_bitmap, repeated
from .common import free_name, stored

PREFIX = 64


def normalised(text: Column) -> Column:
    """Null as empty, A-Z lower-cased, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _survivors(docs: DataFrame, text_col: str, bits: int, name: str) -> DataFrame:
    """docs with a boolean column: both its length and its prefix occur again."""
    length = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    head = F.xxhash64(length, normalised(F.substring(F.col(text_col), 1, PREFIX)))
    same_length, _ = free_name(docs, "same_length", name)
    lengths = repeated(docs.select(length.alias("k")), bits)
    first = in_bitmap(docs, length, lengths, bits, same_length)
    heads = repeated(first.filter(same_length).select(head.alias("k")), bits)
    return in_bitmap(first, head, heads, bits, name).withColumn(name, F.col(name) & F.col(same_length)).drop(same_length)


def _classes(ids: DataFrame) -> DataFrame:
    """(digest, doc_id) rows to one row per digest that occurs again, counted by id first."""
    counted = ids.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    classes = counted.groupBy("digest").agg(F.max(F.struct("doc_id", "n")).alias("top"), F.sum("n").alias("group_size")).filter("group_size > 1")
    # Stored, so that the join below has plain exchanges on both sides, which Spark splits where a group is hot.
    return stored(classes.select("digest", F.col("top.doc_id").alias("keep_id"), F.col("top.n").alias("top_rows"), "group_size"), "copies")


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, digests: bool = False) -> DataFrame:
    """One row per row of docs, dropped ones too: doc_id, keep_id, group_size, kept.

    With digests, also text_sha256 of every normalised text, which reads all texts in full.
    """
    base = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    full = [_digest(F.col("text")).alias("full")] if digests else []
    rows = _survivors(base, "text", bits, "again").select("doc_id", "again", F.when(F.col("again"), _digest(F.col("text"))).alias("digest"), *full)
    classes = _classes(rows.filter("again").select("digest", "doc_id"))
    # Rows without a digest join nothing; a key of their own spreads them over all tasks.
    own = F.coalesce(F.col("digest"), F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("string").cast("binary"))
    found = rows.withColumn("digest", own).join(classes, "digest", "left")
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        *([F.lower(F.hex("full")).alias("text_sha256")] if digests else []),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """The rows of docs that stay, with all their columns. Only texts that may have copies are shuffled."""
    again, digest, keep, top = free_name(docs, "again", "digest", "keep_id", "top_rows")
    rows = _survivors(docs, text_col, bits, again)
    maybe = rows.filter(again).withColumn(digest, _digest(F.col(text_col)))
    classes = _classes(maybe.select(F.col(digest).alias("digest"), F.col(id_col).alias("doc_id")))
    small = classes.select(F.col("digest").alias(digest), F.col("keep_id").alias(keep), F.col("top_rows").alias(top))
    # Losers go before the join that carries texts: their ids differ from the id that stays.
    joined = maybe.join(small, digest, "left").filter(F.col(top).isNull() | F.col(id_col).eqNullSafe(F.col(keep)))
    once = joined.filter(F.coalesce(F.col(top), F.lit(1)) == 1).select(*docs.columns)
    several = joined.filter(F.col(top) > 1).dropDuplicates([digest]).select(*docs.columns)
    return rows.filter(~F.col(again)).select(*docs.columns).unionByName(once).unionByName(several)
