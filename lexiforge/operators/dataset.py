"""Dataset fingerprints, manifests and validation.

A dataset is a DataFrame of records with a ``split`` column and an integer ordinal that
fixes record order within the split.  Canonical lines (sorted-key compact JSON) are
hashed per split, split hashes are combined in split order into the dataset hash, and
validation compares recomputed hashes with declared ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.canon import canonical_line
from lexiforge.functions.hashing import exact_hash, ordered_hash, tree_hash
from lexiforge.operators.stats import SPLITS

# The manifest fields the dataset contract requires.
MANIFEST_FIELDS = ("dataset_name", "timestamp_utc", "git_rev", "config_path", "config_hash", "code_hash",
                   "splits", "format", "split_hashes", "dataset_hash", "seed", "grammar_file", "row_counts", "stats")
# Per-task record layout (required and forbidden fields).
TASK_FIELDS = {
    "lm": (("id", "task", "text", "meta"), ("src", "tgt", "label")),
    "seq2seq": (("id", "task", "src", "tgt", "meta"), ("text", "label")),
    "cls": (("id", "task", "text", "label", "meta"), ("src", "tgt")),
}
RECORD_COLUMNS = ("id", "task", "text", "src", "tgt", "label", "meta")


def with_canonical_line(df: DataFrame, record_cols: Sequence[str], name: str = "line") -> DataFrame:
    return df.withColumn(name, canonical_line(df, list(record_cols)))


def split_hashes(df: DataFrame, ordinal_col: str, line_col: str = "line", split_col: str = "split",
                 mode: str = "tree") -> DataFrame:
    """(split, split_hash, num_records).  mode 'tree' spreads a split over many tasks;
    'exact' is the single-pass definition (one split in one task, for bounded splits)."""
    d = df.withColumnRenamed(split_col, "split") if split_col != "split" else df
    if mode == "tree":
        h = tree_hash(d, ["split"], ordinal_col, line_col, "split_hash")
    elif mode == "exact":
        h = exact_hash(d, ["split"], ordinal_col, line_col, "split_hash")
    else:
        raise ValueError(f"unknown hash mode {mode}")
    counts = d.groupBy("split").agg(F.count(F.lit(1)).alias("num_records"))
    return h.join(counts, "split")


def split_order(split: Column, order: Sequence[str] | None) -> Column:
    """Position of a split: declared order when given (train, valid, test), else by name."""
    if not order:
        return split
    m = F.create_map(*[x for i, s in enumerate(order) for x in (F.lit(s), F.lit(f"{i:09d}"))])
    return F.coalesce(m[split], F.concat(F.lit("~"), split))


def dataset_hash(hashes: DataFrame, order: Sequence[str] | None = SPLITS) -> DataFrame:
    """One row: SHA-256 of the newline-joined split hashes in split order (a handful of rows)."""
    return (hashes.select(split_order(F.col("split"), order).alias("_o"), "split_hash")
            .agg(ordered_hash("_o", "split_hash").alias("dataset_hash")))


def _filtered_hash(order: Column, value: Column, keep: Column) -> Column:
    """Aggregate: SHA-256 of the newline-joined values of the rows where ``keep`` holds,
    in ``order`` (null structs are skipped by ``collect_list``)."""
    pairs = F.array_sort(F.collect_list(F.when(keep, F.struct(order.alias("o"), value.alias("v")))))
    return F.sha2(F.array_join(F.transform(pairs, lambda x: x["v"]), "\n"), 256)


def with_dataset_hash(hashes: DataFrame, order: Sequence[str] | None = SPLITS) -> DataFrame:
    """Attach the dataset hash to every split row (a window over the handful of split rows)."""
    o = split_order(F.col("split"), order)
    pairs = F.array_sort(F.collect_list(F.struct(o.alias("o"), F.col("split_hash").alias("v"))).over(Window.partitionBy()))
    return hashes.withColumn("dataset_hash", F.sha2(F.array_join(F.transform(pairs, lambda x: x["v"]), "\n"), 256))


def validate_hashes(declared: DataFrame, computed: DataFrame, order: Sequence[str] | None = SPLITS) -> DataFrame:
    """Compare declared (split, split_hash) with recomputed ones.

    One row per split with status ok / mismatch / missing (declared, not found) /
    undeclared (found, not declared), and one ``__dataset__`` row comparing the dataset
    hash of the declared splits, recomputed in split order, with the declared one.
    """
    d = declared.select("split", F.col("split_hash").alias("declared_hash"))
    c = computed.select("split", F.col("split_hash").alias("computed_hash"))
    j = d.join(c, "split", "full_outer")
    status = (F.when(F.col("declared_hash").isNull(), "undeclared")
              .when(F.col("computed_hash").isNull(), "missing")
              .when(F.col("declared_hash") == F.col("computed_hash"), "ok").otherwise("mismatch"))
    per_split = j.select("split", status.alias("status"), "declared_hash", "computed_hash")
    o = split_order(F.col("split"), order)
    declared_present = F.col("declared_hash").isNotNull()
    both = declared_present & F.col("computed_hash").isNotNull()
    sums = j.agg(_filtered_hash(o, F.col("declared_hash"), declared_present).alias("declared_hash"),
                 _filtered_hash(o, F.col("computed_hash"), both).alias("computed_hash"))
    ds = sums.select(
        F.lit("__dataset__").alias("split"),
        F.when(F.col("computed_hash").isNull(), "missing")
         .when(F.col("declared_hash") == F.col("computed_hash"), "ok").otherwise("mismatch").alias("status"),
        "declared_hash", "computed_hash")
    return per_split.unionByName(ds)


def schema_violations(records: DataFrame) -> DataFrame:
    """Counts per rule of records breaking the per-task layout, the id format or the
    split/task agreement between id, columns and meta.  Every rule gets a row."""
    checks: list[tuple[str, Column]] = []
    task = F.col("task")
    checks.append(("unknown_task", ~task.isin(*TASK_FIELDS)))
    for t, (req, forb) in TASK_FIELDS.items():
        for f in req:
            checks.append((f"{t}_missing_{f}", (task == t) & F.col(f).isNull()))
        for f in forb:
            checks.append((f"{t}_forbidden_{f}", (task == t) & F.col(f).isNotNull()))
    checks.append(("id_format", ~F.col("id").rlike(r"^[^-]+-[^-]+-[0-9]{6,}$")))
    checks.append(("id_split_task", F.col("id") != F.format_string("%s-%s-%06d", F.col("split"), task,
                                                                   F.col("sample_index"))))
    checks.append(("meta_split", F.col("meta.split") != F.col("split")))
    sums = records.agg(*[F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(f"r{i}")
                         for i, (_, c) in enumerate(checks)])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(f"r{i}"), F.lit(0)).alias("violations"))
                      for i, (n, _) in enumerate(checks)])
    return sums.select(F.explode(pairs).alias("r")).select("r.rule", "r.violations")


def completeness(manifests: DataFrame, fields: Sequence[str] = MANIFEST_FIELDS) -> DataFrame:
    """Per manifest: share of required fields present (non-null); columns absent from the
    table count as missing."""
    present = [F.col(f).isNotNull().cast("int") if f in manifests.columns else F.lit(0) for f in fields]
    total = present[0]
    for p in present[1:]:
        total = total + p
    return manifests.select("dataset_name", (total / F.lit(float(len(fields)))).alias("completeness"))


def reproducibility(runs: DataFrame) -> DataFrame:
    """Runs (config_hash, run_id, dataset_hash) -> per config: runs, distinct hashes and
    the share of runs that produced the most frequent hash."""
    per = runs.groupBy("config_hash", "dataset_hash").agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy("config_hash").agg(
        F.sum("_n").alias("runs"), F.count(F.lit(1)).alias("distinct_hashes"),
        (F.max("_n") / F.sum("_n")).alias("reproducibility"))


def manifest_violations(manifests: DataFrame) -> DataFrame:
    """Structure rules over a table of manifests, one row per rule with its count:
    split_hashes missing or not a JSON object, no splits declared, dataset hash missing,
    tokenizer_hash present but empty."""
    parsed = F.from_json(F.col("split_hashes"), "map<string,string>")
    checks = [
        ("split_hashes_missing", F.col("split_hashes").isNull()),
        ("split_hashes_not_mapping", F.col("split_hashes").isNotNull() & parsed.isNull()),
        ("no_splits_declared", parsed.isNotNull() & (F.size(parsed) == 0)),
        ("dataset_hash_missing", F.col("dataset_hash").isNull()),
    ]
    if "tokenizer_hash" in manifests.columns:
        checks.append(("tokenizer_hash_empty", F.col("tokenizer_hash") == ""))
    else:
        checks.append(("tokenizer_hash_empty", F.lit(False)))
    sums = manifests.agg(*[F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(f"r{i}")
                           for i, (_, c) in enumerate(checks)])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(f"r{i}"), F.lit(0)).alias("violations"))
                      for i, (n, _) in enumerate(checks)])
    return sums.select(F.explode(pairs).alias("r")).select("r.rule", "r.violations")
