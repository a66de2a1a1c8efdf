"""Tables kept by month between runs, of which only changed months are built anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewise.session import remove_folder, shared_dir


def month_marks(rows: DataFrame, month: str) -> DataFrame:
    """(month, n, x, s): count and two order-free digests of the rows of each month."""
    mark = F.xxhash64(*[F.col(c) for c in rows.columns])
    digests = [F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.sum(mark.cast("decimal(20,0)")).cast("string").alias("s")]
    return rows.groupBy(F.col(month).cast("int").alias("month")).agg(*digests)


def _read(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(schema).parquet(folder)


_MARKS = "month int, n long, x long, s string"


class MonthlyTable:
    """``build`` of ``rows``, partitioned by month below the shared folder and kept between runs.

    ``build`` must work on each month by itself: its result has a column
    ``month`` and holds for any set of months what it holds for each.  Sums over
    longer windows are sums of its rows.  ``name`` should tell all else that
    ``build`` depends on.
    """

    def __init__(self, spark: SparkSession, name: str, rows: DataFrame, build: Callable[[DataFrame], DataFrame], month: str = "prch_mnth_id") -> None:
        self.spark, self.rows, self.build, self.month = spark, rows, build, month
        self.folder = f"{shared_dir(spark)}/placewise-kept/{name}"
        self.rebuilt: list[int] = []

    def refresh(self) -> MonthlyTable:
        """Builds the months whose rows are not those of the last refresh, and drops months that have none any more.

        One pass over the rows finds them.  Marks of such months are withdrawn
        first and given back last: a run that ends in between builds them again.
        """
        spark = self.spark
        now = {r["month"]: tuple(r) for r in month_marks(self.rows.where(F.col(self.month).isNotNull()), self.month).collect()}
        kept = _read(spark, f"{self.folder}/marks", _MARKS)
        before = {r["month"]: tuple(r) for r in kept.collect()} if kept is not None else {}
        same = {m: mark for m, mark in now.items() if before.get(m) == mark}
        self.rebuilt = sorted(set(now) - set(same))
        if len(same) == len(before) and not self.rebuilt:
            return self
        self._mark(same)
        if not before:  # a first run, or one whose marks were lost
            remove_folder(spark, f"{self.folder}/rows")
        for month in (set(before) | set(now)) - set(same):
            remove_folder(spark, f"{self.folder}/rows/month={month}")
        if self.rebuilt:
            built = self.build(self.rows.where(F.col(self.month).isin(self.rebuilt)))
            built.write.mode("append").partitionBy("month").parquet(f"{self.folder}/rows")
        self._mark(now)
        return self

    def _mark(self, marks: dict[int, tuple]) -> None:
        self.spark.createDataFrame(sorted(marks.values()), _MARKS).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/marks")

    def read(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """The rows of the months asked for; other months' folders are not opened."""
        schema = self.build(self.rows.where(F.lit(False))).schema
        found = _read(self.spark, f"{self.folder}/rows", schema)
        rows = self.spark.createDataFrame([], schema) if found is None else found.select(*schema.names)
        if first is not None:
            rows = rows.where(F.col("month") >= first)
        return rows if last is None else rows.where(F.col("month") <= last)
