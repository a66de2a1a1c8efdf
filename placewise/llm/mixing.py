"""Mixing sources to target weights by Poisson replication.

The mean repetition rate of a source is its target share over its own share.
Every document draws its number of copies from a Poisson distribution with that
mean, by inverting the distribution at a number hashed from the document, so a
rerun or a retried task draws the same.  Copies are then put in a global order
of hashes.  All steps are column functions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.llm.common import boxed, hash60, text_key, written

SEED = "mix-1"
#: A source's weight is its size to this power where none is given.
TEMPERATURE = 0.5
#: A mean above this is drawn as a sum of independent draws with equal means not above it.
MEAN_PER_DRAW = 16
#: Terms of the distribution kept; beyond them less than 1e-17 remains at the largest mean.
TERMS = 80


def _size() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)) + 1


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """(source, rate, draws, cdf): mean copies per document of each source, and the distribution of one draw.

    Sizes are bytes of text plus one; the expected size of the mix is that of
    the input.  With ``weights``, sources not named get weight 0.
    """
    sizes = docs.groupBy("source").agg(F.sum(_size()).alias("size"))
    if weights is None:
        weight = F.pow("size", F.lit(TEMPERATURE))
    else:
        named = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.lit(None)
        weight = F.coalesce(F.element_at(named, F.col("source")) if weights else F.lit(0.0), F.lit(0.0)).cast("double")
    sizes = written(sizes.select("source", "size", weight.alias("weight")), "sizes")
    total = sizes.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    if not total["weight"]:
        rate = F.lit(0.0)
    else:
        rate = F.round(F.col("weight") / F.lit(float(total["weight"])) * F.lit(float(total["size"])) / F.col("size"), 6)
    rated = sizes.select("source", rate.alias("rate"))
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN_PER_DRAW)).cast("int")
    rated = rated.select("source", "rate", draws.alias("draws"), (F.col("rate") / draws).alias("mean"))
    first = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("c"))

    def term(state: Column, j: Column) -> Column:
        p = state["p"] * F.col("mean") / j
        return F.struct(p.alias("p"), F.concat(state["c"], F.array(F.element_at(state["c"], -1) + p)).alias("c"))

    steps = F.sequence(F.lit(1), F.lit(TERMS))
    return rated.select("source", "rate", "draws", F.aggregate(steps, first, term, lambda s: s["c"]).alias("cdf"))


def copies(docs: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """(_row, source, rate, copies, copy, shuffle_key): one row per copy, not yet in order.

    A null source is a source of its own, null ids and texts count as empty.
    Rows equal in id and text draw the same number.  Sources of weight 0 and an
    empty table give no copies.
    """
    # One row per source, written: Catalyst broadcasts it if it is small and shuffles otherwise.
    table = written(rates(docs, weights), "rates").withColumnsRenamed({"source": "_source"})
    drawn = F.md5(F.concat_ws("|", F.lit(SEED), text_key(F.col("doc_id")), F.coalesce("text", F.lit(""))))
    rows = boxed(docs, source=F.col("source"), _key=drawn)
    joined = rows.join(table, F.col("source").eqNullSafe(F.col("_source")))

    def draw(i: Column) -> Column:
        u = hash60(F.concat_ws("|", F.col("_key"), i.cast("string"))) / F.lit(float(1 << 60))
        return F.size(F.filter("cdf", lambda c: c <= u))

    count = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("draws")), draw), F.lit(0), lambda a, x: a + x)
    counted = joined.withColumn("copies", F.when(F.col("rate") > 0, count).otherwise(F.lit(0)).cast("long"))
    # explode() drops documents drawn zero times.
    spread = counted.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    order = F.md5(F.concat_ws("|", F.col("_key"), F.lit("copy"), F.col("copy").cast("string")))
    return spread.select("_row", "source", "rate", "copies", "copy", order.alias("shuffle_key"))


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """The copies with the columns of ``docs``, in one global random order."""
    return copies(docs, weights).orderBy("shuffle_key").select("_row.*")
