"""Character and byte tokenizers as table operators, plus vocabularies and round-trip audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.text import bytes_to_text, chars, col_, utf8_bytes

KINDS = ("char", "byte")


def tokens(text, kind: str = "char", lowercase: bool = False) -> Column:
    if kind == "char":
        return chars(text, lowercase)
    if kind == "byte":
        return utf8_bytes(text, lowercase)
    raise ValueError(f"Unsupported tokenizer type '{kind}'")


def detokenize(toks, kind: str = "char", strict: bool = True) -> Column:
    if kind == "char":
        return F.array_join(col_(toks), "")
    if kind == "byte":
        return bytes_to_text(toks, strict)
    raise ValueError(f"Unsupported tokenizer type '{kind}'")


def tokenize(df: DataFrame, field: str, kind: str = "char", lowercase: bool = False) -> DataFrame:
    """Add ``{field}_tokens`` and ``{field}_n_tokens``; null text stays null."""
    toks = tokens(F.col(field), kind, lowercase)
    return (df.withColumn(f"{field}_tokens", F.when(F.col(field).isNotNull(), toks))
              .withColumn(f"{field}_n_tokens", F.size(F.col(f"{field}_tokens"))))


def vocab(df: DataFrame, field: str, kind: str = "char", lowercase: bool = False) -> DataFrame:
    """Sorted distinct tokens with their 0-based position as ``id``.

    Rows are reduced to their distinct characters before the shuffle, so the exchange
    carries a few dozen values per row; byte vocabularies are derived from the distinct
    characters (the bytes of a text are the bytes of its characters).  The result is
    bounded by the size of the alphabet (<= 1.1M code points, <= 256 bytes), which is
    what makes the final single ordered numbering safe.
    """
    distinct_chars = (df.select(F.explode(F.array_distinct(chars(F.col(field), lowercase))).alias("token"))
                      .distinct())
    if kind == "char":
        toks = distinct_chars
    elif kind == "byte":
        toks = distinct_chars.select(F.explode(utf8_bytes(F.col("token"))).alias("token")).distinct()
    else:
        raise ValueError(f"Unsupported tokenizer type '{kind}'")
    return toks.withColumn("id", (F.row_number().over(Window.orderBy("token")) - 1).cast("int"))


def roundtrip_audit(df: DataFrame, field: str, key_cols: list[str]) -> DataFrame:
    """Per row: do char and byte tokenization both invert exactly?

    Each token array is made once a row: it is a column of its own, which later columns read.
    """
    t = F.col(field)
    made = df.select(*key_cols, t, tokens(t, "char").alias("_chars"), tokens(t, "byte").alias("_bytes"))
    back = made.select(
        *key_cols, t, F.size("_chars").alias("n_chars"), F.size("_bytes").alias("n_bytes"),
        detokenize("_chars", "char").alias("_from_chars"), detokenize("_bytes", "byte", strict=False).alias("_from_bytes"))
    return back.select(
        *key_cols, "n_chars", "n_bytes",
        (F.col("_from_chars") == t).cast("int").alias("char_ok"),
        F.coalesce((F.col("_from_bytes") == t).cast("int"), F.lit(0)).alias("byte_ok"),
        F.md5("_from_bytes").alias("text_md5"),
    )
