"""Small tables with everything that may go wrong, and brute-force answers."""

from __future__ import annotations

import random
import zlib

import duckdb

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "fp string, length int, kept int, host string, content string, slot string, shard string, copy string, hash string, rank int"
)
EXTRA = ("x", 7, 8, "h", "c", "s", "sh", "cp", "ha", 9)


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def odd_rows() -> list[tuple]:
    long = words(9000, 1)
    rows = [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, "   \n\t ", "en", "a"),
        (4, "One", "en", None),
        (5, words(60, 2) + "\n" + words(30, 3), "en", "a"),
        (6, words(60, 2).upper() + "\n" + words(30, 3), "en", "a"),
        (6, words(60, 2).upper() + "\n" + words(30, 3), "en", "a"),
        (7, long, "de", "b"),
        (8, long + " x", "de", "b"),
        (None, words(40, 4), "en", "b"),
        (None, None, "en", "b"),
        (9, "again and again and again and again and again and again and again and again and again and again", "en", "b"),
        (10, "<|endoftext|> é ΑΣ #*$ <|im_end|>\n\n" + words(25, 5), "fr", "b"),
        (11, words(40, 4), "en", "a"),
        (12, "日本 語  かな\r\n x" + words(30, 6), "ja", "c"),
    ]
    return [(i, t, lang, s, len(t) if t else 0, *EXTRA) for i, t, lang, s in rows]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def write(df, folder, name="documents") -> str:
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def twin(sql: str, **tables: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    columns = sorted(d[0] for d in found.description)
    names = [d[0] for d in found.description]
    return columns, sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)


def rows_of(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def crc(data: bytes) -> int:
    return zlib.crc32(data)
