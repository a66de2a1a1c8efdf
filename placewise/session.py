"""Session settings, the shared work folder, and stage tables.

Stage tables are how long lineages are cut here: a stage is written once as
Parquet below the shared folder and read back.  A lost executor then costs a
re-read, not a recomputation, and the on-disk size of a stage is what Catalyst
compares with ``spark.sql.autoBroadcastJoinThreshold`` when it picks a join.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


PARTITION_BYTES = 256 * 1024**2


def shuffle_partitions(input_bytes: int) -> int:
    """Reduce tasks to start from for an input of this size: about 256 MB each.

    Adaptive execution merges small ones but never makes more, so a large run
    has to begin with enough.
    """
    return max(200, min(100_000, -(-input_bytes // PARTITION_BYTES)))


def build_session(
    app: str = "placewise", master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
        # Stage files are far smaller than their rows: join sizes are judged on the rows.
        .config("spark.sql.sources.fileCompressionFactor", "10")
    )
    if input_bytes:
        builder = (
            builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(shuffle_partitions(input_bytes)))
            .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(PARTITION_BYTES))
            .config("spark.sql.files.maxPartitionBytes", str(PARTITION_BYTES))
        )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="placewise-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def remove_folder(spark: SparkSession, folder: str) -> None:
    system, path = _file_system(spark, folder)
    system.delete(path, True)


_RUN_TABLES: dict[str, dict[str, str]] = {}


def run_folder(spark: SparkSession) -> str:
    """Folder of this run's stage tables; it goes when the run's JVM ends, or with ``drop_stages``."""
    app = spark.sparkContext.applicationId
    folder = f"{shared_dir(spark)}/placewise/{app}"
    if app not in _RUN_TABLES:
        _RUN_TABLES[app] = {}
        system, path = _file_system(spark, folder)
        system.mkdirs(path)
        system.deleteOnExit(path)
    return folder


def drop_stages(spark: SparkSession) -> None:
    """Drops all stage tables of this run and deletes their files."""
    folder = run_folder(spark)
    for name in _RUN_TABLES.pop(spark.sparkContext.applicationId):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    remove_folder(spark, folder)


def reuse_or_build(
    spark: SparkSession,
    name: str,
    build: Callable[[], DataFrame],
    rebuild: bool = False,
    partition_by: Sequence[str] = (),
    bucket_by: Sequence[str] = (),
    rows_per_file: int = 0,
    open_files: int = 0,
) -> DataFrame:
    """Table ``name``: read it if it exists, else build, write and read it.

    Every build has a folder of its own, and the name is given to it only when
    all files are there: a build that fails leaves the table as it was.  With
    ``bucket_by`` rows are dealt to as many buckets as a shuffle has partitions
    and sorted there, so that later joins on those columns move nothing.  With
    ``rows_per_file`` files end after so many rows: rows that pack well but cost
    much to read are then shared out among more tasks.  With ``open_files`` a
    task that deals rows to folders keeps so many files open and sorts its rows
    by folder only if there are more.
    """
    if rebuild or not spark.catalog.tableExists(name):
        folder = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
        df = build()
        if bucket_by:
            buckets = bucket_count(spark)
            df = df.repartition(buckets, *bucket_by)
            writer = df.write.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
        else:
            writer = df.write
        fresh = f"{name}_{uuid.uuid4().hex[:8]}"
        writer = writer.format("parquet").option("path", folder).option("maxRecordsPerFile", rows_per_file)
        with _setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(open_files) if open_files else None):
            (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(fresh)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")
        known = _RUN_TABLES[spark.sparkContext.applicationId]
        if name in known:
            remove_folder(spark, known[name])
        known[name] = folder
    return spark.table(name)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str | None) -> Iterator[None]:
    """The SQL setting ``key`` is ``value`` meanwhile; None leaves it as it is."""
    before = spark.conf.get(key, None)
    if value is not None:
        spark.conf.set(key, value)
    try:
        yield
    finally:
        if value is not None:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def bucket_count(spark: SparkSession) -> int:
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    return int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or usual)


def input_manifest(spark: SparkSession, *paths: str) -> str:
    """Digest of the names, sizes and times of all files below ``paths``; another one once a file is rewritten.

    Spark lists the files; none is opened, and one row reaches the driver.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    mark = F.xxhash64("path", "length", "modificationTime")
    row = files.agg(F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.sum(mark.cast("decimal(20,0)")).alias("s")).first()
    return hashlib.md5(f"{row['n']}|{row['x']}|{row['s']}".encode()).hexdigest()


def stage_prefix(*parts: object) -> str:
    """Table-name prefix that is the same for the same inputs and parameters."""
    text = "|".join(repr(p) for p in parts)
    stem = re.sub(r"[^a-z0-9]+", "_", str(parts[0]).lower()).strip("_")[-24:]
    return f"pw_{stem}_{hashlib.md5(text.encode()).hexdigest()[:8]}"
