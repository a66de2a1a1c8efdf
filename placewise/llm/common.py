"""Helpers of the training-data operators: written stages, hashes, components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(df: DataFrame) -> DataFrame:
    """``df``, after this package has been given to the executors, once per application.

    Functions that run in Python workers are named by module, so the workers
    must have the modules.  The archive is made on the driver, which serves it.
    """
    context = df.sparkSession.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="placewise-")) / "placewise_modules.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return df


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark)}/placewise-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    A lost executor then costs a re-read, and Catalyst knows the size of what
    it joins.  The schema is given, so an empty table reads back as one.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boxed(docs: DataFrame, **columns: Column) -> DataFrame:
    """Every row whole in ``_row`` beside the given columns.

    Columns of the input then never clash with an operator's own.
    """
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), *[c.alias(n) for n, c in columns.items()])


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    # lower() changes other letters too; a text of ASCII bytes alone has none.
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def hash60(text: Column) -> Column:
    """The first 15 hex digits of the MD5 as a whole number, which SQL engines agree on."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def least_hashes(rows: DataFrame, key: Column, n_rows: int, wanted: int) -> DataFrame:
    """The ``wanted`` rows with the least hash ``key`` (a long).

    A threshold set from the number of rows leaves little more than those, so
    only they are sorted and only they go to the task that cuts them off.
    """
    share = min(1.0, 1.2 * wanted / max(n_rows, 1) + 1e-9) if n_rows > wanted else 1.0
    top = min(-(1 << 63) + int(share * (1 << 64)), (1 << 63) - 1)
    ordered = rows.withColumn("_order", key).where(F.col("_order") <= F.lit(top))
    return ordered.orderBy("_order").limit(wanted).drop("_order")


def text_key(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(text_key(doc_id)), F.lit(parts)).cast("int")


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a ``written`` table that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/placewise-llm/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


def _compared(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the least node reachable.

    Alternating large-star and small-star steps: each points a node's
    neighbours at the least of them.  A step is one aggregate, combined before
    its shuffle, and one join, so the neighbours of a node are never gathered.
    The edges are written after each round; a few rounds suffice, as they grow
    with the logarithm of the widest component.
    """

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        # pairs (u, v), u != v.  Large: both directions.  Small: u > v only.
        if larger:
            pairs = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        joined = pairs.join(least, F.col("u") == F.col("_u"))
        if larger:
            moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                least.select(F.col("_u").alias("u"), F.col("m").alias("v"))
            )
        return moved.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    current = written(
        edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = _compared(current)
    while before[0]:
        after = written(star(star(current, True), False), "edges")
        drop_written(current)
        current, seen = after, _compared(after)
        if seen == before:
            break
        before = seen
    # Every remaining edge leads straight to its component's least node.
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
