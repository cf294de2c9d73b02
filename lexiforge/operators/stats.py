"""Corpus statistics per split: counts, mean / exact percentiles of length, character vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.text import chars

SPLITS = ("train", "valid", "test")
STAT_COLUMNS = ("num_records", "avg_len", "p50_len", "p95_len", "vocab_size_char")


def record_text(df: DataFrame) -> Column:
    """The text a record is measured by: ``text`` if present, else ``src``, else ''."""
    parts = [F.col(c) for c in ("text", "src") if c in df.columns]
    return F.coalesce(*parts, F.lit(""))


def corpus_stats(df: DataFrame, split_col: str = "split", text: Column | None = None,
                 splits: Sequence[str] | None = None) -> DataFrame:
    """One row per split with the five statistics as doubles.

    Two plain hash aggregations, each reduced map-side: rows per (split, length), from
    which mean and exact percentiles follow with the row counts as frequencies, and the
    distinct (split, character) pairs.  With ``splits`` every listed split gets a row,
    zeros when empty.
    """
    t = text if text is not None else record_text(df)
    lengths = df.groupBy(F.col(split_col).alias("split"), F.length(t).alias("_len")).agg(F.count(F.lit(1)).alias("_n"))
    counted = F.when(F.col("_len").isNotNull(), F.col("_n")).otherwise(0)
    by_length = lengths.groupBy("split").agg(
        F.sum(counted).cast("double").alias("num_records"),
        (F.sum(F.col("_len") * F.col("_n")) / F.sum(counted)).alias("avg_len"),
        F.percentile("_len", F.lit(0.5), F.col("_n")).alias("p50_len"),
        F.percentile("_len", F.lit(0.95), F.col("_n")).alias("p95_len"),
    )
    letters = (df.select(F.col(split_col).alias("split"), F.explode(F.array_distinct(chars(t))).alias("_c")).distinct()
               .groupBy("split").agg(F.count(F.lit(1)).cast("double").alias("vocab_size_char")))
    same = by_length["split"].eqNullSafe(letters["split"])
    out = (by_length.join(letters, same, "left").select(by_length["split"], *STAT_COLUMNS[:4], F.coalesce("vocab_size_char", F.lit(0.0)).alias("vocab_size_char")))
    if splits is not None:
        wanted = df.sparkSession.createDataFrame([(s, i) for i, s in enumerate(splits)], "split string, _ord int")
        out = (F.broadcast(wanted).join(out, "split", "left")
               .select("split", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in STAT_COLUMNS]))
    return out


def length_histogram(df: DataFrame, group_col: str, text: Column | None = None, unit: str = "char") -> DataFrame:
    """Frequency of record lengths per group (code points, or whitespace words)."""
    t = text if text is not None else record_text(df)
    if unit == "word":
        from lexiforge.functions.text import words

        length = F.size(words(t))
    else:
        length = F.length(t)
    return (df.select(F.col(group_col).alias(group_col), length.cast("long").alias("length"))
            .groupBy(group_col, "length").agg(F.count(F.lit(1)).alias("n")))


def split_row_counts(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows per split (records, i.e. samples x tasks for a generated dataset)."""
    return df.groupBy(F.col(split_col).alias("split")).agg(F.count(F.lit(1)).alias("row_count"))
