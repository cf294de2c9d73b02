"""Lexicons: per-domain vocabularies from data, seeded shuffle, dense positions, hashes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.functions.canon import canonical_line

WORDS_HELD = 200_000  # different words that a task holds while it counts


def domain_counts(df: DataFrame, domain_col: str, text_col: str, lowercase: bool = True) -> DataFrame:
    """(domain, word, n): all words of each domain, counted in the tasks first."""
    t = F.lower(F.col(text_col)) if lowercase else F.col(text_col)
    texts = df.select(F.col(domain_col).alias("domain"), t.alias("text"))
    schema = T.StructType([T.StructField("domain", texts.schema["domain"].dataType), T.StructField("word", T.StringType()),
                           T.StructField("n", T.LongType())])
    return texts.mapInArrow(_word_counts, schema).groupBy("domain", "word").agg(F.sum("n").alias("n"))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(domain, word, n) of a task's texts; a word may come again once WORDS_HELD others have been met."""
    def rows() -> pa.RecordBatch:
        domains = pa.array([d for d, c in counts.items() for _ in c], kind)
        return pa.RecordBatch.from_arrays([domains, pa.array([w for c in counts.values() for w in c], pa.string()),
                                           pa.array([n for c in counts.values() for n in c.values()], pa.int64())], names=["domain", "word", "n"])

    counts: dict = {}
    held, kind = 0, None
    for batch in batches:
        kind = batch.column(0).type
        for domain, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):  # one text at a time becomes a Python string
            found = counts.setdefault(domain, Counter())
            held -= len(found)
            found.update((text.as_py() or "").split())
            held += len(found)
            if held >= WORDS_HELD:
                yield rows()
                counts, held = {}, 0
    if held:
        yield rows()


def domain_vocabulary(df: DataFrame, domain_col: str, text_col: str, top_n: int, lowercase: bool = True) -> DataFrame:
    """Top-``top_n`` words per domain by frequency (ties: word order) with their 1-based rank.

    Words are counted with partial aggregation on (domain, word), so a domain that holds
    most of the text is spread over many tasks; the rank filter lets Spark keep only the
    top rows of each task before the per-domain shuffle (window group limit), so a hot
    domain sends at most top_n rows per task to its final sort.
    """
    counts = domain_counts(df, domain_col, text_col, lowercase)
    w = Window.partitionBy("domain").orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def normalise_entries(entries: DataFrame) -> DataFrame:
    """Entries need ``token`` or ``value``; ``token`` is taken from ``value`` when absent.
    Rows with neither are returned separately by ``entry_violations``."""
    cols = entries.columns
    token = F.coalesce(*[F.col(c) for c in ("token", "value") if c in cols])
    return entries.withColumn("token", token).where(F.col("token").isNotNull())


def entry_violations(entries: DataFrame) -> DataFrame:
    cols = entries.columns
    token = F.coalesce(*[F.col(c) for c in ("token", "value") if c in cols])
    return entries.where(token.isNull()).withColumn("rule", F.lit("entry_without_token"))


def shuffle_positions(entries: DataFrame, lexicon_col: str, order_col: str, seed: int, shuffle: bool = True,
                      bounded: bool = False) -> DataFrame:
    """Dense 0-based ``pos`` per lexicon: by a keyed random key when shuffling (a pure
    function of seed, lexicon and original position), else by the original position.

    ``bounded`` (top-n lexicons, curated lists of known size) numbers each lexicon with
    one window; otherwise the distributed dense index is used, so a lexicon of any size
    is numbered by many tasks.
    """
    key = (F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(lexicon_col).cast("string"), F.col(order_col).cast("string")))
           if shuffle else F.lit(""))
    keyed = entries.withColumn("_key", key)
    if bounded:
        w = Window.partitionBy(lexicon_col).orderBy("_key", F.col(order_col))
        return keyed.withColumn("pos", (F.row_number().over(w) - 1).cast("long")).drop("_key")
    from lexiforge.operators.indexing import dense_index

    return dense_index(keyed, ["_key", order_col], [lexicon_col], "pos").drop("_key")


def lexicon_summary(entries: DataFrame, lexicon_col: str, entry_cols: list[str], mode: str = "exact") -> DataFrame:
    """Per lexicon: entry count and a hash of its entries in ``pos`` order (entries are
    canonical objects with sorted keys).

    ``exact``: SHA-256 of the JSON list of entries, the single-pass definition (one
    lexicon per task; for bounded lexicons).  ``tree``: the three-level tree hash over
    the entry lines by position, for lexicons of any size.
    """
    lines = entries.select(lexicon_col, "pos", canonical_line(entries, entry_cols).alias("line"))
    counts = lines.groupBy(lexicon_col).agg(F.count(F.lit(1)).alias("entries"))
    if mode == "tree":
        from lexiforge.functions.hashing import tree_hash

        return counts.join(tree_hash(lines, [lexicon_col], "pos", "line", "lexicon_hash"), lexicon_col)
    if mode != "exact":
        raise ValueError(f"unknown hash mode {mode}")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    payload = F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["line"]), ","), F.lit("]"))
    return lines.groupBy(lexicon_col).agg(F.count(F.lit(1)).alias("entries"), F.sha2(payload, 256).alias("lexicon_hash"))
