"""Exact deduplication by progressive refinement, in column functions alone.

Rows are told apart by length; those whose length others share by a hash of a
short prefix; those that share that too by the full hash.  What survives a level
is marked in a table of bits, sixty-four to a row; it has at most ``WORDS`` rows
whatever the input, so it may be broadcast and texts need no shuffle.  Two keys
in one bit only cost a hash more: the last level decides.  Beyond some tens of
millions of groups the bits fill up and more rows than needed are hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.llm.common import boxed, lower_ascii, written
from placewise.operators.common import hot_keys, skew_join

PREFIX_CHARS = 64
#: A row of the bit table is two longs; the broadcast has at most so many rows.
WORDS = 1 << 20
BITS = 64


def _slot(key: Column) -> Column:
    return F.pmod(key, F.lit(WORDS * BITS))


def _marks(keys: DataFrame, name: str) -> DataFrame:
    """The bit table of a column ``key``."""
    placed = keys.select(_slot(F.col("key")).alias("slot"))
    bits = placed.select(
        F.expr(f"slot DIV {BITS}").alias("_word"), F.expr(f"shiftleft(1L, CAST(slot % {BITS} AS int))").alias("bit")
    )
    return written(bits.groupBy("_word").agg(F.bit_or("bit").alias("_bits")), name)


def _survivors(rows: DataFrame, marks: DataFrame, key: Column, name: str) -> DataFrame:
    """``rows`` with a boolean: whether the bit of ``key`` is set.  A null key has none."""
    keyed = rows.withColumn("_at", _slot(key))
    joined = keyed.join(F.broadcast(marks), F.expr(f"_at DIV {BITS}") == F.col("_word"), "left")
    found = F.expr(f"(shiftright(_bits, CAST(_at % {BITS} AS int)) & 1) = 1")
    return joined.withColumn(name, F.coalesce(found, F.lit(False))).drop("_at", "_word", "_bits")


def refined(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_prefix`` and ``_hash``.

    ``_prefix`` is the prefix hash of rows whose length others share, ``_hash``
    the full hash of those that share length and prefix; both are null for rows
    known to be alone before.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    length = F.octet_length(value)
    lengths = docs.groupBy(length.alias("length")).count().where("count > 1").select(F.xxhash64("length").alias("key"))
    by_length = _survivors(docs, _marks(lengths, "lengths"), F.xxhash64(length), "_shared")
    prefix = F.when(F.col("_shared"), F.xxhash64(length, lower_ascii(F.substring(value, 1, PREFIX_CHARS))))
    prefixed = by_length.withColumn("_prefix", prefix).drop("_shared")
    # Short rows of survivors, counted before they are shuffled.
    prefixes = prefixed.where("_prefix IS NOT NULL").groupBy(F.col("_prefix").alias("key")).count().where("count > 1")
    marked = _survivors(prefixed, _marks(prefixes, "prefixes"), F.col("_prefix"), "_shared")
    return marked.withColumn("_hash", F.when(F.col("_shared"), F.sha2(lower_ascii(value), 256))).drop("_shared")


def duplicate_groups(docs: DataFrame, **carried: Column) -> DataFrame:
    """One row per document, kept or not: doc_id, the carried columns, keep_id, group_size, kept.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty.  Of equal texts the row with the largest doc_id stays, a null doc_id
    being the smallest; of rows that tie in that too, one stays.
    """
    rows = docs.select("doc_id", "text", *[c.alias(n) for n, c in carried.items()])
    narrow = written(
        refined(rows).drop("text", "_prefix").withColumn("_rid", F.monotonically_increasing_id()), "refined"
    )
    groups = written(
        narrow.where("_hash IS NOT NULL")
        .groupBy("_hash")
        .agg(F.count("*").alias("_n"), F.max(F.struct("doc_id", "_rid")).alias("_keep"))
        .where("_n > 1"),
        "groups",
    )
    # Rows known to be alone have no hash; they pass beside the join, where they would all meet in one task.
    alone = narrow.where("_hash IS NULL").select(
        "doc_id", *carried, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    # A large group is spread over as many salts as it would fill partitions.
    hot = hot_keys(groups, ["_hash"], "_n")
    shared = skew_join(narrow.where("_hash IS NOT NULL"), groups, ["_hash"], "left", hot=hot)
    single = F.col("_n").isNull()
    return alone.unionByName(
        shared.select(
            "doc_id",
            *carried,
            F.when(single, F.col("doc_id")).otherwise(F.col("_keep.doc_id")).alias("keep_id"),
            F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
            (single | (F.col("_rid") == F.col("_keep._rid"))).alias("kept"),
        )
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns.  Rules as in ``duplicate_groups``.

    Rows known to be alone pass without a shuffle.  Of a group, every task
    passes on its best row only.  An empty table gives an empty one.
    """
    rows = refined(boxed(docs, text=F.col("text"), doc_id=F.col("doc_id"))).drop("text", "_prefix")
    alone = rows.where("_hash IS NULL").select("_row")
    # A struct is never null, so rows with a null doc_id count too.
    best = F.max_by("_row", F.struct("doc_id")).alias("_row")
    return alone.unionByName(rows.where("_hash IS NOT NULL").groupBy("_hash").agg(best).select("_row")).select("_row.*")
