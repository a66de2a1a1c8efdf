"""Quality rules with cross-document line frequency, in column functions alone.

Every text is measured once into a short row: counts for the base rules, and
hash and words of each normalised line.  Lines are counted by distinct texts
per host, so copies of a text count once.  A line in more than a share of the
host's texts, and in more than a few, is boilerplate and is removed from all of
them.  A document is rejected if most of its words go with such lines, or if
fewer words are left than a document must have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.llm.common import boxed, hash60, lower_ascii, written

MIN_WORDS = 20
WINDOW = 8
#: Percent of words in windows found twice or more.
MAX_REPEATED = 30
#: A line in more distinct texts of a host than this, and in more than this percent of them, is boilerplate.
MAX_TEXTS, MAX_SHARE = 10, 10
#: Percent of a document's words in removed lines beyond which it is depleted.
MAX_REMOVED = 80
#: What parts words, and the signs that count as symbols.
SPACE = r"[\x20\x09-\x0D]+"
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _repeated(words: Column) -> Column:
    """Words in windows of eight that are found twice or more in the text."""
    none = F.lit(0).cast("long")

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), none.alias("n"))
        step = lambda a, p: F.struct(
            (p + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - p)).alias("n")
        )
        return F.aggregate(F.array_sort(places), start, step, lambda a: a["n"])

    def found_again(ordered: Column) -> Column:
        twice = lambda e, k: (e["h"] == F.get(ordered, k - 1)["h"]) | (e["h"] == F.get(ordered, k + 1)["h"])
        return covered(F.transform(F.filter(ordered, lambda e, k: F.coalesce(twice(e, k), F.lit(False))), lambda e: e["p"]))

    def of_hashes(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(_let(ordered, found_again))

    def of_words(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return F.when(F.size(w) < WINDOW + 1, none).otherwise(_let(windows, of_hashes))

    return _let(words, of_words)


def _line_hash(line: Column) -> Column:
    return F.xxhash64(lower_ascii(F.trim(F.regexp_replace(line, SPACE, " "))))


def _lines(text: Column) -> Column:
    """The lines of a text that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)


def measured(rows: DataFrame) -> DataFrame:
    """The columns of ``rows`` but text and source, the base counts, host, content key and line hashes.

    A null text has no words and counts as empty.
    """
    others = [c for c in rows.columns if c not in ("text", "source")]
    text = F.coalesce("text", F.lit(""))
    split = rows.select(
        *others,
        F.xxhash64("source").alias("host"),
        hash60(text).alias("content"),
        _words(text).alias("words"),
        _lines(text).alias("lines"),
        F.char_length(F.translate(text, _SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    hashed = F.transform("lines", lambda x: F.struct(_line_hash(x).alias("hash"), F.size(_words(x)).alias("words")))
    counted = split.select(
        *others,
        "host",
        "content",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).alias("n_repeat_words"),
        hashed.alias("lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def frequent_lines(texts: DataFrame, max_texts: int = MAX_TEXTS, max_share: int = MAX_SHARE) -> DataFrame:
    """(host, hash) of the lines in more than ``max_texts`` distinct texts of a host and more than ``max_share`` percent of them."""
    seen = texts.select("host", "content", F.explode(F.array_distinct("lines.hash")).alias("hash"))
    # Lines in a few texts go before hosts are looked at.
    counted = seen.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") > max_texts)
    # Only hosts of so many texts that the share decides; one short row each.
    hosts = written(texts.groupBy("host").agg(F.count("*").alias("texts")).where(max_share * F.col("texts") > 100 * max_texts), "hosts")
    wide = F.col("texts").isNull() | (100 * F.col("n") > max_share * F.col("texts"))
    return counted.join(hosts, "host", "left").where(wide).select("host", "hash")


def removed_lines(base: DataFrame, max_texts: int = MAX_TEXTS, max_share: int = MAX_SHARE) -> DataFrame:
    """(host, content, n_words, base_failed, removed, hashes) per distinct text that loses lines.

    ``removed`` counts the words lost, ``hashes`` lists the lines.
    """
    texts = written(
        base.groupBy("host", "content").agg(
            F.first("lines").alias("lines"), F.first("n_words").alias("n_words"), F.first("base_failed").alias("base_failed")
        ),
        "texts",
    )
    frequent = written(frequent_lines(texts, max_texts, max_share), "frequent")
    every = texts.select("host", "content", "n_words", "base_failed", F.inline("lines"))
    # Written, so Catalyst broadcasts the frequent lines if they are few and else splits the skewed side.
    lost = every.join(frequent, ["host", "hash"])
    return lost.groupBy("host", "content").agg(
        F.first("n_words").alias("n_words"),
        F.first("base_failed").alias("base_failed"),
        F.sum("words").alias("removed"),
        F.collect_set("hash").alias("hashes"),
    )


def _depleted() -> Column:
    """For texts that lose lines: too much is gone, or too little is left."""
    return (100 * F.col("removed") > MAX_REMOVED * F.col("n_words")) | (F.col("n_words") - F.col("removed") < MIN_WORDS)


def quality_rules(docs: DataFrame, max_texts: int = MAX_TEXTS, max_share: int = MAX_SHARE) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, removed_words, kept.

    ``kept`` is false where the base rules fail or the document is depleted.  A
    null source is a host of its own.  Repeated rows get the same verdict; an
    empty table gives no row.
    """
    base = written(measured(docs.select("doc_id", "text", "source")), "measured")
    lost = written(removed_lines(base, max_texts, max_share).select("host", "content", "removed"), "lost")
    joined = base.join(lost, ["host", "content"], "left").withColumn("removed", F.coalesce("removed", F.lit(0)))
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.col("removed").cast("long").alias("removed_words"),
        (~F.col("base_failed") & ~_depleted()).alias("kept"),
    )


def quality_filter(docs: DataFrame, max_texts: int = MAX_TEXTS, max_share: int = MAX_SHARE) -> DataFrame:
    """The documents kept, with all their columns, without the lines removed.

    Where lines go, ``text`` is what remains and ``n_chars``, if there is such a
    column, its length; all else stays as it is.
    """
    base = written(measured(docs.select("text", "source")).drop("word_chars", "n_symbols", "n_dup_lines"), "measured")
    lost = removed_lines(base, max_texts, max_share)
    failed = base.where("base_failed").select("host", "content").distinct()
    verdicts = written(
        lost.where("NOT base_failed")
        .select("host", "content", _depleted().alias("rejected"), "hashes")
        .unionByName(failed.select("*", F.lit(True).alias("rejected"), F.expr("CAST(array() AS array<bigint>)").alias("hashes"))),
        "verdicts",
    ).withColumnsRenamed({"host": "_host", "content": "_content"})
    rows = boxed(docs, host=F.xxhash64("source"), content=hash60(F.coalesce("text", F.lit(""))))
    # Verdicts grow with the table, so they are never broadcast: one plan at every size.
    joined = rows.join(
        verdicts.hint("merge"), (F.col("host") == F.col("_host")) & (F.col("content") == F.col("_content")), "left"
    ).where("NOT coalesce(rejected, false)")
    stay = F.filter(F.split("_row.text", "\n"), lambda x: ~F.array_contains("hashes", _line_hash(x)))
    less = F.size("hashes") > 0
    cleaned = joined.withColumn("_text", F.when(less, F.array_join(stay, "\n")).otherwise(F.col("_row.text")))
    columns = []
    for c in docs.columns:
        value = F.col("_row")[c]
        if c == "text":
            value = F.col("_text")
        elif c == "n_chars":
            value = F.when(less, F.char_length("_text").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return cleaned.select(*columns)
