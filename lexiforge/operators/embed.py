"""Fixed random embeddings keyed by token, summaries, and mean token embeddings per text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.draws import uniform
from lexiforge.functions.hashing import ordered_hash

# Default token lists (41 characters, or 10 words).
DEFAULT_CHAR_TOKENS = list("abcdefghijklmnopqrstuvwxyz0123456789 .,!?")
DEFAULT_WORD_TOKENS = ["the", "a", "an", "to", "and", "of", "in", "is", "you", "it"]


def fixed_embeddings(tokens: DataFrame, dim: int, seed: int, token_col: str = "token") -> DataFrame:
    """(token, values ARRAY<FLOAT>): values uniform in [-1, 1), each a keyed draw of
    (seed, token, d), so the table is order-independent and built in parallel."""
    if dim <= 0:
        raise ValueError("dim must be positive")
    vals = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                       lambda d: (uniform(seed, F.col(token_col), d) * 2.0 - 1.0).cast("float"))
    return tokens.select(F.col(token_col).alias("token"), vals.alias("values"))


def value_line(values) -> F.Column:
    """Exact text form of float32 values: floor(v * 1e9) as integers."""
    return F.concat_ws(",", F.transform(values, lambda v: F.floor(v.cast("double") * 1e9).cast("string")))


def embedding_summary(emb: DataFrame) -> DataFrame:
    """Token count, min/max dimension and an order-defined hash (by token) of the rows.
    Embedding tables are vocabulary-sized, so one group per table is bounded."""
    line = F.concat(F.col("token"), F.lit("\t"), value_line(F.col("values")))
    return emb.select("token", line.alias("line"), F.size("values").alias("d")).agg(
        F.count(F.lit(1)).alias("tokens"), F.min("d").alias("min_dim"), F.max("d").alias("max_dim"),
        ordered_hash("token", "line").alias("embeddings_hash"))


def mean_embeddings(df: DataFrame, key_cols: list[str], tokens_col: str, emb: DataFrame, dim: int) -> DataFrame:
    """Average embedding of each row's tokens (tokens without a vector are skipped).

    Tokens are counted per key before the join, so a vector is fetched once per distinct token
    of a row; one weighted aggregate per dimension follows.  Every key of ``df`` stays: without a
    known token ``n_tokens`` is 0 and ``mean`` null."""
    counted = (df.select(*key_cols, F.explode_outer(tokens_col).alias("token"))
               .groupBy(*key_cols, "token").agg(F.count(F.lit(1)).alias("_n")))
    j = counted.join(emb, "token", "left").withColumn("_n", F.when(F.col("values").isNotNull(), F.col("_n")).otherwise(0))
    aggs = [F.sum(F.element_at("values", d + 1).cast("double") * F.col("_n")).alias(f"_s{d}") for d in range(dim)]
    out = j.groupBy(*key_cols).agg(F.sum("_n").alias("n_tokens"), *aggs)
    mean = F.array(*[F.col(f"_s{d}") / F.col("n_tokens") for d in range(dim)])
    return out.select(*key_cols, "n_tokens", F.when(F.col("n_tokens") > 0, mean).alias("mean"))
