"""Card files, the gazetteer, CSV tables and outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from placewise.session import reuse_or_build  # noqa: F401  (re-exported)

# The layouts of the inputs, and texts that stand for a missing value.
GEONAMES_COLUMNS = (
    "country_code", "postal_code", "place_name", "admin_name1", "admin_code1", "admin_name2",
    "admin_code2", "admin_name3", "admin_code3", "latitude", "longitude", "accuracy",
)
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
CARD_COLUMNS = {
    "pymt_crd_acct_num_raw": "string",
    "prch_mnth_id": "int",
    "prch_dt": "date",
    "tran_id_gmt_tm": "int",
    "mrch_catg_cd": "int",
    "cp_flag": "int",
    "transaction_type": "string",
    "mrch_ctry_cd": "int",
    "mrch_nm_raw": "string",
    "mrch_city_nm_raw": "string",
    "mrch_postal_code": "string",
    "cs_tran_amt": "decimal(18,2)",
    "pstl_cd_enr": "string",
    "issr_ctry_cd": "string",
    "crd_typ_nm": "string",
    "prod_id_pltfrm_cd_vcis": "string",
}
#: Bits of a row id of Spark that number the rows of one task.
ROW_BITS = 33
LENIENT = ("prch_dt", "tran_id_gmt_tm")
PRICE_COLUMNS = ("avg_price_m2", "median_price_m2")


def card_columns(cards: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Card rows with declared types.  A column that has its type already is left
    untouched, so that a filter on it still reaches the Parquet scan."""
    have = dict(cards.dtypes)
    picked = []
    for name in columns or CARD_COLUMNS:
        kind = CARD_COLUMNS[name]
        if have[name] == kind:
            picked.append(F.col(name))
        elif name in LENIENT:
            picked.append(F.col(name).try_cast(kind).alias(name))
        else:
            picked.append(F.col(name).cast(kind).alias(name))
    return cards.select(*picked)


def scan_card_tx(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    return card_columns(spark.read.parquet(path), columns)


def read_geonames(spark: SparkSession, path: str) -> DataFrame:
    """Headerless tab file, or a folder of them; ``row_no`` rises in order of path and line.

    The texts a missing value is written as become NULL; a quote is plain text.
    Spark reads large files first, so its own row ids rise within a block of a
    file only; the place of the block, by path and offset, goes before them.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in GEONAMES_COLUMNS])
    raw = spark.read.csv(path, sep="\t", schema=schema, quote="", encoding="UTF-8")
    cols = [F.when(~F.col(c).isin(*MISSING_TEXTS), F.col(c)).alias(c) for c in GEONAMES_COLUMNS]
    block = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")]
    # One short row per block of the files.
    in_order = Window.partitionBy(F.lit(0)).orderBy("_path", "_start")
    blocks = raw.select(*block).distinct().withColumn("_block", F.row_number().over(in_order).cast("long"))
    in_block = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        raw.select(*cols, *block, in_block.alias("_row"))
        .join(blocks, ["_path", "_start"])
        .withColumn("latitude", F.col("latitude").try_cast("double"))
        .withColumn("longitude", F.col("longitude").try_cast("double"))
        .withColumn("row_no", F.shiftleft("_block", ROW_BITS) + F.col("_row"))
        .drop("_path", "_start", "_block", "_row")
    )


def read_csv_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    sep: str = ",",
    encoding: str = "UTF-8",
    line_breaks: bool = False,
) -> DataFrame:
    """CSV with a header under a declared schema; a byte-order mark is dropped.

    Quoted fields may hold the separator and doubled quotes.  ``line_breaks``
    allows line breaks in them too, at the price of one task per file.
    """
    return spark.read.csv(
        path, header=True, schema=schema, sep=sep, quote='"', escape='"', encoding=encoding, multiLine=line_breaks
    )


def read_price_stats(spark: SparkSession, path: str) -> DataFrame:
    """Price table whose separator is ``;`` or ``,`` and whose decimals may use a comma."""
    header = spark.read.text(path).first()
    sep = ";" if header and ";" in header[0] else ","
    raw = spark.read.csv(path, sep=sep, header=True)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    prices = [F.replace(F.col(c), F.lit(","), F.lit(".")).try_cast("double").alias(c) for c in PRICE_COLUMNS]
    return raw.select("postal_code", *prices)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Writes a table; CSV gets a header and doubled quotes, as it is read back."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.csv(path, header=True, quote='"', escape='"')
    else:
        writer.format(fmt).save(path)
