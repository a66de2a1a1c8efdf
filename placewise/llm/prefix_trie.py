"""Trie of shared conversation prefixes by collapsing whole sequences.

Texts are hashed where they are read and never shuffled for longer than it
takes to put turns in order.  A prefix is named by its depth and 128 bits that
grow with every turn.  Conversations with one name at their full depth are one
weighted sequence; a sequence that is a proper prefix of another is found by an
anti-join with the names above all turns, and the others are the leaves.  Every
prefix of the distinct sequences, weighted, is a node.

No conversation is held whole: its turns stand in blocks of ``BLOCK`` places,
running values are taken per block, and what precedes a block is joined to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.llm.common import ship, written
from placewise.operators.common import hot_keys, skew_join

#: Places of a conversation that one task takes at most.
BLOCK = 1 << 16
#: Ids written as one text on the way to a digest.
ID_RUN = 1 << 14
NAME = ["depth", "p1", "p2"]


def _block(place: Column) -> Column:
    return F.floor(place / F.lit(BLOCK)).cast("long")


def _spread(df: DataFrame, length: str) -> DataFrame:
    """Each row once per block of its conversation, with ``block``."""
    return df.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), _block(F.greatest(F.col(length), F.lit(1)) - 1))))


def running(rows: DataFrame, key: str, place: str, values: dict[str, str], fn) -> DataFrame:
    """``rows`` with the running ``fn`` (F.sum or F.bit_xor) of each value, by ``place`` within ``key``.

    A window never spans more than one block; the totals of the blocks before are
    joined, for the keys that have several.
    """
    rows = rows.withColumn("block", _block(F.col(place)))
    inside = Window.partitionBy(key, "block").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(F.col(key).alias("_key"), F.col("block").alias("_block")).agg(*[fn(v).alias(f"_t_{n}") for n, v in values.items()])
    starts = totals.select("_key", "_block", *[fn(f"_t_{n}").over(before).alias(f"_s_{n}") for n in values]).where(
        F.col(f"_s_{next(iter(values))}").isNotNull()
    )
    local = rows.withColumns({n: fn(v).over(inside) for n, v in values.items()})
    joined = local.join(starts, (F.col(key) == F.col("_key")) & (F.col("block") == F.col("_block")), "left")
    two = (lambda a, b: a.bitwiseXOR(b)) if fn is F.bit_xor else (lambda a, b: a + b)
    return joined.withColumns({n: two(F.col(n), F.coalesce(f"_s_{n}", F.lit(0))) for n in values}).drop(
        "block", "_key", "_block", *[f"_s_{n}" for n in values]
    )


# -- turns in order -----------------------------------------------------------------


def _places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, and the place of a row among those of its key there."""
    from pyspark import TaskContext

    part, last, held = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        at = np.arange(len(keys))
        place = at - np.maximum.accumulate(np.where(first, at, 0))
        if last is not None and keys[0] == last:
            run = len(keys) if first[1:].sum() == 0 else int(np.flatnonzero(first)[1])
            place[:run] += held
        last, held = keys[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(keys), part, dtype=np.int64)), pa.array(place.astype(np.int64))],
            names=[*batch.schema.names, "_part", "_place"],
        )


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 0, h1, h2, chars): the turns in order, their role and text as 128 bits.

    Order: turn (null first), then role, then text; null roles and texts are
    empty.  Rows with a null conv_id belong to no conversation and are left out.
    Rows are dealt by ranges of (conv_id, turn), so the turns of one conversation
    may lie in many partitions.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")
    )
    dealt = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    thin = dealt.select(
        "conv_id",
        F.xxhash64(F.lit(1), "role", "text").alias("h1"),
        F.xxhash64(F.lit(2), "role", "text").alias("h2"),
        F.char_length("text").cast("long").alias("chars"),
    )
    placed = written(ship(thin).mapInArrow(_places, "conv_id long, h1 long, h2 long, chars long, _part long, _place long"), "turns")
    counts = placed.groupBy(F.col("conv_id").alias("_c"), F.col("_part").alias("_p")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("_c").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_c", "_p", F.sum("n").over(before).alias("_start")).where("_start IS NOT NULL")
    # At most one conversation goes on from an earlier partition into each: no more rows than partitions.
    joined = placed.join(F.broadcast(starts), (F.col("conv_id") == F.col("_c")) & (F.col("_part") == F.col("_p")), "left")
    return joined.select("conv_id", (F.col("_place") + F.coalesce("_start", F.lit(0))).alias("place"), "h1", "h2", "chars")


def rebuilt(turns: DataFrame, heads: int = 6, group: int = 100) -> tuple[DataFrame, DataFrame]:
    """(turns, members): each conversation with its first turns replaced by those of the first of its hundred.

    Conversation c loses its first h turns, h = crc32 of its number modulo
    ``heads``, and gets the first h turns of c - c % ``group`` (all if that has
    fewer, none if there is no such conversation).
    """
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    plan = counts.select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h")
    )
    known = counts.select(F.col("conv_id").alias("_base"), F.col("n").alias("_n"))
    # A base serves at most ``group`` conversations.
    plan = written(
        plan.join(known, F.col("base") == F.col("_base"), "left").select(
            "conv_id", "n", "base", "h", F.least("h", F.coalesce("_n", F.lit(0))).alias("given")
        ),
        "rebuild-plan",
    )
    columns = ["conv_id", "place", "h1", "h2", "chars"]
    first = turns.where((F.col("conv_id") % group == 0) & (F.col("place") < heads)).withColumnRenamed("conv_id", "_base")
    given = plan.where("given > 0").join(first, (F.col("base") == F.col("_base")) & (F.col("place") < F.col("given"))).select(columns)
    blocks = _spread(plan.where("n > h").select(F.col("conv_id").alias("_c"), "n", "h", "given"), "n").withColumnRenamed("block", "_b")
    own = (
        turns.join(blocks, (F.col("conv_id") == F.col("_c")) & (_block(F.col("place")) == F.col("_b")))
        .where("place >= h")
        .withColumn("place", F.col("place") - F.col("h") + F.col("given"))
        .select(columns)
    )
    return given.unionByName(own), plan.select("conv_id")


# -- the trie -----------------------------------------------------------------------


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, chars): the name of every prefix, and of the one above; written."""
    steps = turns.withColumns({f"e{i}": F.xxhash64(F.lit(i), "place", "h1", "h2") for i in (1, 2)})
    grown = running(steps, "conv_id", "place", {"p1": "e1", "p2": "e2"}, F.bit_xor)
    above = [F.col(f"p{i}").bitwiseXOR(F.col(f"e{i}")).alias(f"q{i}") for i in (1, 2)]
    return written(grown.select("conv_id", (F.col("place") + 1).alias("depth"), "p1", "p2", *above, "chars"), "prefixes")


def sequences(rows: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ends, distinct): the name of every conversation's whole sequence, and the weighted distinct sequences."""
    last = rows.groupBy(F.col("conv_id").alias("_c")).agg(F.max(F.struct(*NAME)).alias("last"))
    ends = written(
        members.join(last, F.col("conv_id") == F.col("_c"), "left").select(
            "conv_id", *[F.coalesce(f"last.{c}", F.lit(0).cast("long")).alias(c) for c in NAME]
        ),
        "ends",
    )
    return ends, ends.groupBy(*NAME).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id"))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one name in a row as texts of at most ``ID_RUN`` ids."""
    names = ["depth", "p1", "p2", "first", "ids"]
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        ids = batch.column(3).to_pylist()
        starts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [len(ids)]])
        cuts = [c for a, b in zip(starts[:-1], starts[1:]) for c in range(a, b, ID_RUN)]
        runs = [",".join(map(str, ids[a:b])) for a, b in zip(cuts, [*cuts[1:], len(ids)])]
        yield pa.RecordBatch.from_arrays([*[pa.array(k[cuts]) for k in keys], pa.array([ids[c] for c in cuts], pa.int64()), pa.array(runs, pa.string())], names=names)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the runs of one name, comma-joined; carried from batch to batch."""
    now, digest = None, None
    for batch in batches:
        out = []
        for *key, _, run in zip(*[c.to_pylist() for c in batch.columns]):
            if key != now:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(run.encode())
            else:
                digest.update(b"," + run.encode())
        yield _digest_rows(out)
    if now is not None:
        yield _digest_rows([(*now, digest.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    types = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[*NAME, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256): SHA-256 of the numbers that end there, ascending, comma-joined.

    A name with very many ends is spread over ranges of ids first; one task then
    reads long texts of ids, one after the other, and holds none of them.
    """
    dealt = ends.select(*NAME, "conv_id").repartitionByRange(*NAME, "conv_id").sortWithinPartitions(*NAME, "conv_id")
    runs = ship(dealt).mapInArrow(_runs, "depth long, p1 long, p2 long, first long, ids string")
    held = runs.repartition(*[F.col(c) for c in NAME]).sortWithinPartitions(*NAME, "first")
    return held.mapInArrow(_digests, "depth long, p1 long, p2 long, ends_sha256 string")


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, place, h1, h2, chars); ``members`` lists every conv_id.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.  Without a member there is
    no node, not even the root.
    """
    rows = prefixes(turns)
    ends, distinct = sequences(rows, members)
    distinct = written(distinct, "sequences")
    # Whole sequences only from here on: the turns of one conversation stand for all that are alike.
    kept = _spread(distinct.select(F.col("conv_id").alias("_c"), "weight", F.col("depth").alias("_n")), "_n").withColumnRenamed("block", "_b")
    whole = written(
        rows.join(kept, (F.col("conv_id") == F.col("_c")) & (_block(F.col("depth") - 1) == F.col("_b"))).drop("_c", "_b", "_n"), "whole"
    )
    upper = whole.select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).distinct()
    leaves = written(distinct.join(upper, NAME, "left_anti").select("conv_id", "depth"), "leaves")
    ending = _spread(leaves.select(F.col("conv_id").alias("_c"), F.col("depth").alias("_n")), "_n").withColumnRenamed("block", "_b")
    marked = written(
        whole.join(ending, (F.col("conv_id") == F.col("_c")) & (_block(F.col("depth") - 1) == F.col("_b")), "left")
        .withColumn("leaf", F.col("_c").isNotNull())
        .drop("_c", "_b", "_n"),
        "marked",
    )
    owner = F.min(F.when(F.col("leaf"), F.col("conv_id"))).alias("owner")
    measures = [F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count_if("leaf").alias("n_leaves"), owner]
    below = marked.groupBy(*NAME).agg(*measures, F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.max("chars").alias("chars"))
    ended = leaves.select(F.col("conv_id").alias("_c"))
    zero = F.lit(0).cast("long")
    root = (
        distinct.join(ended, F.col("conv_id") == F.col("_c"), "left")
        .withColumn("leaf", F.col("_c").isNotNull())
        .agg(*measures)
        .where("conv_id IS NOT NULL")
        .select("*", *[zero.alias(c) for c in (*NAME, "q1", "q2", "chars")])
    )
    nodes = written(below.unionByName(root).withColumn("value", (F.col("n_convs") - 1) * F.col("chars")), "nodes")

    children = written(
        nodes.where("depth > 0")
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
        .agg(F.count("*").alias("n_children")),
        "children",
    )
    # What a subtree saves: the values of its nodes, each counted at the least leaf below it.  A leaf owns the lower
    # end of its path, so the totals of the leaves below a node lack nothing and exceed it by what its owner holds above.
    totals = nodes.groupBy("owner").agg(F.sum("value").alias("total")).where("total > 0")
    gains = leaves.join(totals, F.col("conv_id") == F.col("owner")).select(F.col("conv_id").alias("_c"), F.col("depth").alias("_n"), "total")
    gained = marked.join(
        _spread(gains, "_n").withColumnRenamed("block", "_b"), (F.col("conv_id") == F.col("_c")) & (_block(F.col("depth") - 1) == F.col("_b"))
    )
    sums = gained.groupBy(*NAME).agg(F.sum("total").alias("total")).unionByName(
        gains.agg(F.sum("total").alias("total")).select(*[zero.alias(c) for c in NAME], "total")
    )
    held = running(nodes, "owner", "depth", {"upto": "value"}, F.sum)
    named = held.join(sums, NAME, "left").join(children, NAME, "left").join(end_digests(ends), NAME, "left")
    lookup = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    crowds = hot_keys(children.withColumnRenamed("n_children", "n").select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), "n"), ["depth", "q1", "q2"])
    linked = skew_join(named, lookup, ["depth", "q1", "q2"], "left", hot=crowds)
    return linked.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves",
        (F.coalesce("total", F.lit(0)) - F.col("upto") + F.col("value")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
