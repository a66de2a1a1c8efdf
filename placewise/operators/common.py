"""Building blocks that keep hot keys and large groups distributed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from placewise.session import checkpointed

SALTS = 16
BUCKETS_PER_OCTAVE = 4096
_BUCKET_ZERO = 1100 * BUCKETS_PER_OCTAVE


#: A key is never called hot for less than this share of the rows, so at most 100,000 are.
LEAST_HOT_SHARE = 1e-5


def partitions_of(spark: SparkSession) -> int:
    """Partitions a shuffle of this session starts with."""
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    return int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or usual)


def hot_keys(counts: DataFrame, on: Sequence[str], n: str = "n") -> DataFrame:
    """Keys with more rows than a partition's fair share, and ``salts``, the shares each holds, given the rows per key.

    There are at most as many as partitions, and never more than 100,000.
    """
    share = max(1 / partitions_of(counts.sparkSession), LEAST_HOT_SHARE)
    least = counts.agg(F.sum(n) * share).scalar()
    return counts.where(F.col(n) >= least).select(*on, F.ceil(F.col(n) / least).cast("int").alias("salts"))


#: A lookup is broadcast up to this size, counted uncompressed.
BROADCAST_BYTES = 32 << 20


def _value_bytes(value: Column, kind: T.DataType) -> Column:
    """About the bytes one value takes, eight at least."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 8
    if isinstance(kind, T.StructType):
        return reduce(lambda a, b: a + b, [_value_bytes(value[f.name], f.dataType) for f in kind.fields], F.lit(8).cast("long"))
    if isinstance(kind, T.ArrayType):
        each = F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + _value_bytes(x, kind.elementType))
        return F.coalesce(each, F.lit(0).cast("long")) + 8
    return F.lit(8).cast("long")


def table_bytes(df: DataFrame) -> int:
    """About the bytes the rows of ``df`` take in memory."""
    one = reduce(lambda a, b: a + b, [_value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])
    return df.agg(F.sum(one)).first()[0] or 0


def skew_join(
    big: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    null_safe: Sequence[str] = (),
    hot: DataFrame | None = None,
    table: bool = False,
    condition: Column | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Inner or left equi-join that spreads hot keys of ``big`` over ``salts`` partitions.

    ``lookup`` has few rows per key.  With ``table``, it is a written table or
    as cheap to read: if it takes at most BROADCAST_BYTES it is broadcast.
    Otherwise both sides are shuffled.  Where ``hot`` names the hot keys (see
    ``hot_keys``), only those are repeated, as often as the key fills
    partitions; else every row is, once per salt.
    The merge hint keeps the repeated side from being broadcast on the strength
    of its compressed size.  The salt depends on the row and its partition
    alone, so a retried task makes the same choice; NULL keys are spread too.
    """
    if table and table_bytes(lookup) <= BROADCAST_BYTES:
        named = lookup.withColumnsRenamed({c: f"_on_{i}" for i, c in enumerate(on)})
        tests = [
            big[c].eqNullSafe(F.col(f"_on_{i}")) if c in null_safe else big[c] == F.col(f"_on_{i}")
            for i, c in enumerate(on)
        ] + ([condition] if condition is not None else [])
        joined = big.join(F.broadcast(named), reduce(lambda a, b: a & b, tests), how)
        return joined.drop(*[f"_on_{i}" for i in range(len(on))])
    rest = [c for c in lookup.columns if c not in on]
    content = F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in big.columns])
    copies = F.sequence(F.lit(0), F.lit(salts - 1))
    left, right = big, lookup
    if hot is None:
        left = left.withColumn("_salt", F.pmod(content, F.lit(salts)).cast("int"))
    else:
        left = _mark_hot(left, hot, on, null_safe)
        loose = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on if c not in null_safe], F.lit(False))
        spans = F.when(loose, partitions_of(big.sparkSession)).otherwise(F.col("_salts"))
        left = left.withColumn("_salt", F.pmod(content, spans).cast("int")).drop("_salts")
        right = _mark_hot(right, hot, on, null_safe)
        copies = F.sequence(F.lit(0), F.col("_salts") - 1)
    right = right.select(
        *[F.col(c).alias(f"_on_{i}") for i, c in enumerate(on)], *rest, F.explode(copies).alias("_lookup_salt")
    ).hint("merge")
    tests = [F.col("_salt") == F.col("_lookup_salt")]
    for i, c in enumerate(on):
        key = F.col(f"_on_{i}")
        tests.append(left[c].eqNullSafe(key) if c in null_safe else left[c] == key)
    if condition is not None:
        tests.append(condition)
    joined = left.join(right, reduce(lambda a, b: a & b, tests), how)
    return joined.drop("_salt", "_lookup_salt", *[f"_on_{i}" for i in range(len(on))])


def _mark_hot(df: DataFrame, hot: DataFrame, on: Sequence[str], null_safe: Sequence[str]) -> DataFrame:
    """Adds ``_salts``: the partitions a row's key is spread over, one unless it is hot."""
    named = hot.select(*[F.col(c).alias(f"_h_{i}") for i, c in enumerate(on)], F.col("salts").alias("_hot_salts"))
    tests = []
    for i, c in enumerate(on):
        key = F.col(f"_h_{i}")
        tests.append(df[c].eqNullSafe(key) if c in null_safe else df[c] == key)
    # At most 100,000 rows, see hot_keys.
    marked = df.join(F.broadcast(named), reduce(lambda a, b: a & b, tests), "left")
    return marked.withColumn("_salts", F.coalesce("_hot_salts", F.lit(1))).drop(
        "_hot_salts", *[f"_h_{i}" for i in range(len(on))]
    )


def lookup_by_group(df: DataFrame, keys: Sequence[str], agg: Column, name: str) -> DataFrame:
    """One aggregate per group, put back on every row of the group.

    Aggregate plus join, not a window: the aggregate combines before its
    shuffle and counts the rows too, so the join spreads only groups that are hot
    and repeats only their lookup rows.
    """
    known = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    found = known.groupBy(*keys).agg(agg.alias(name), F.count("*").alias("_rows"))
    return skew_join(df, found.drop("_rows"), keys, "left", hot=hot_keys(found, keys, "_rows"))


def semi_join_codes(df: DataFrame, codes: DataFrame, key: str = "postal_code") -> DataFrame:
    return df.join(codes.select(key).distinct(), key, "left_semi")


def order_bucket(value: Column) -> Column:
    """Whole number that never falls as ``value`` rises: 4096 steps per doubling.

    It depends on the value alone, so each use of it agrees on every executor,
    and a group has at most some thousands of buckets however many rows it has.
    """
    size = F.floor(F.log2(F.abs(value)) * F.lit(float(BUCKETS_PER_OCTAVE))) + F.lit(_BUCKET_ZERO)
    return F.when(value == 0, F.lit(0).cast("bigint")).otherwise(size * F.signum(value).cast("bigint"))


def grouped_quantile(
    df: DataFrame, keys: Sequence[str], value: str, q: float = 0.5, name: str | None = None
) -> DataFrame:
    """Exact interpolated quantile per group, one row per group with a value.

    Equal values are counted before the shuffle; bucket counts tell which one
    or two buckets hold the wanted ranks; only those buckets are ordered.  No
    group is ever sorted or held whole in one task.
    """
    name = name or value
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    rows = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_n")).withColumn("_b", order_bucket(F.col("_v")))
    by_bucket = rows.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    running = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    if not keys:
        running = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(F.lit(0))
    targets = (
        by_bucket.withColumn("_upto", F.sum("_n").over(running))
        .withColumn("_at", (F.sum("_n").over(whole) - 1) * F.lit(float(q)))
        .withColumn("_lo", F.floor("_at"))
        .withColumn("_hi", F.ceil("_at"))
        .withColumn("_before", F.col("_upto") - F.col("_n"))
        .where(
            ((F.col("_lo") >= F.col("_before")) & (F.col("_lo") < F.col("_upto")))
            | ((F.col("_hi") >= F.col("_before")) & (F.col("_hi") < F.col("_upto")))
        )
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_tb"), "_before", "_at", "_lo", "_hi")
    )
    same = reduce(
        lambda a, b: a & b,
        [rows[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)],
        F.col("_b") == F.col("_tb"),
    )
    ranked = rows.join(targets, same)
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.withColumn("_end", F.col("_before") + F.sum("_n").over(inside)).withColumn(
        "_begin", F.col("_end") - F.col("_n")
    )

    def at(rank: str) -> Column:
        return F.max(F.when((F.col(rank) >= F.col("_begin")) & (F.col(rank) < F.col("_end")), F.col("_v")))

    picked = ranked.groupBy(*keys).agg(at("_lo").alias("_vlo"), at("_hi").alias("_vhi"), F.max(F.col("_at") - F.col("_lo")).alias("_f"))
    return picked.select(*keys, (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_f")).alias(name))


def grouped_medians(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Median of several columns per group in one pass over a long form."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(v).alias("_name"), F.col(v).cast("double").alias("_value")) for v in values])
    )
    long = df.select(*keys, pairs.alias("_p")).select(*keys, "_p._name", "_p._value")
    medians = grouped_quantile(long, [*keys, "_name"], "_value")
    wide = [F.max(F.when(F.col("_name") == v, F.col("_value"))).alias(v) for v in values]
    groups = df.select(*keys).distinct()
    return groups.join(medians.groupBy(*keys).agg(*wide), list(keys), "left")


def rank_table(df: DataFrame, col: str, name: str = "rank") -> DataFrame:
    """Each value with its mean rank from 1 and its number of rows ``n``, without one global sort.

    Values are counted first; ranks run within a bucket and start from the
    count of all lower buckets.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    counts = counts.withColumn("_b", order_bucket(F.col(col).cast("double")))
    buckets = counts.groupBy("_b").agg(F.sum("n").alias("_bn"))
    lower = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("_b", F.coalesce(F.sum("_bn").over(lower), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_b").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_start") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return counts.join(starts, "_b").select(col, (first + (F.col("n") + 1) / F.lit(2.0)).alias(name), "n")


def add_rank(df: DataFrame, ranks: DataFrame, col: str) -> DataFrame:
    """Puts a written ``rank_table`` on the rows."""
    return skew_join(df, ranks.drop("n"), [col], "left", hot=hot_keys(ranks, [col]), table=True)


def average_rank(df: DataFrame, col: str, name: str = "rank") -> DataFrame:
    """Rank from 1, ties sharing their mean rank."""
    return add_rank(df, checkpointed(rank_table(df, col, name)), col)


def running_best(
    events: DataFrame, groups: Sequence[str], key: str, order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Largest ``value`` strictly before each row by (key, *order) within ``groups``.

    Split by the buckets of ``key``: a short running maximum over one row per
    bucket, and a running maximum inside each bucket.
    """
    e = events.withColumn("_b", order_bucket(F.col(key).cast("double")))
    tops = e.groupBy(*groups, "_b").agg(F.max(value).alias("_top"))
    part = list(groups) or [F.lit(0)]
    lower = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = tops.select(*groups, "_b", F.max("_top").over(lower).alias("_start"))
    inside = Window.partitionBy(*groups, "_b").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        e.withColumn("_here", F.max(value).over(inside))
        .join(starts, [*groups, "_b"])
        .withColumn(name, F.greatest("_start", "_here"))
        .drop("_b", "_start", "_here")
    )


def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """First row by ``order`` of each key; NULL keys are equal.

    ``min_by`` combines before the shuffle, so a key with many copies never
    lands whole in one task.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(*([order] if isinstance(order, str) else order))
    first = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, rank).alias("_row"))
    return first.select("_row.*")


def preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def ordered_output(df: DataFrame, cols: Sequence[str | Column]) -> DataFrame:
    return df.orderBy(*cols)


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def drop_technical_columns(df: DataFrame, parts: Sequence[str] = ("id", "gml", "geometry_wkt")) -> DataFrame:
    return df.select([c for c in df.columns if not any(p in c for p in parts)])


def rename_recode(
    df: DataFrame, renames: dict[str, str] | None = None, codes: dict[str, dict] | None = None
) -> DataFrame:
    """Renames columns, then maps coded columns; a code without a text gives NULL."""
    out = df.withColumnsRenamed(renames or {})
    for column, texts in (codes or {}).items():
        choice = F.lit(None).cast("string")
        for code, text in texts.items():
            choice = F.when(F.col(column) == code, text).otherwise(choice)
        out = out.withColumn(column, choice)
    return out


def hash_split(df: DataFrame, key: str, train_share: float = 0.7, name: str = "split") -> DataFrame:
    """train / test by a hash of ``key``: stable, and no shuffle."""
    draw = F.conv(F.substring(F.md5(F.col(key)), 1, 8), 16, 10).cast("bigint")
    return df.withColumn(name, F.when(draw < F.lit(int(train_share * 2**32)), "train").otherwise("test"))
