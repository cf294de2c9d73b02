"""Deterministic record generation from a template grammar.

The sample space is ``spark.range`` per split; every column of a sample is a pure function
of (seed, split, index) through keyed draws, so generation is embarrassingly parallel,
retry-safe and identical under any partitioning.  The grammar is data: a small template
table and entity value pools that may be lexicon-sized (they are joined, not collected).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.functions.draws import uniform
from lexiforge.functions.hashing import ordered_hash, tree_hash
from lexiforge.operators.alias import alias_choice, alias_table
from lexiforge.operators.indexing import dense_index
from lexiforge.operators.noise import NoiseConfig, add_noise
from lexiforge.operators.sizes import broadcast_if_small

TASKS = ("lm", "seq2seq", "cls")
# Label rules of the classification task, first substring match wins.
LABEL_RULES = (("found", "found"), ("lost", "lost"), ("traded", "traded"))
DEFAULT_LABEL = "unknown"
# The entities whose values form the sequence-to-sequence target "item -> location".
TARGET_ENTITIES = ("item", "location")
BROADCAST_ROWS = 1_000_000


@dataclass
class Grammar:
    """templates: (template_index INT, template STRING, weight DOUBLE nullable);
    entities: (entity STRING, value STRING[, weight DOUBLE]); entity_order: declaration order."""

    templates: DataFrame
    entities: DataFrame
    entity_order: Sequence[str]
    label_rules: Sequence[tuple[str, str]] = field(default=LABEL_RULES)

    def template_counts(self) -> tuple[int, int]:
        """(templates, weighted templates) in one small job."""
        r = self.templates.agg(F.count(F.lit(1)).alias("n"), F.count("weight").alias("w")).first()
        return r["n"], r["w"]


def entity_pools(grammar: Grammar) -> DataFrame:
    """Distinct values per entity with a dense 0-based ``pos`` (value order) and pool size ``n``.

    Pools within BROADCAST_ROWS values are numbered by one window per entity; larger pools
    by the distributed dense index (range slices plus offsets)."""
    cols = ["entity", "value"] + (["weight"] if "weight" in grammar.entities.columns else [])
    vals = grammar.entities.select(*cols).dropDuplicates(["entity", "value"])
    sizes = vals.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    if largest <= BROADCAST_ROWS:
        # every pool is within the checked bound: one window per entity numbers it
        w = Window.partitionBy("entity").orderBy("value")
        pooled = vals.withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
    else:
        pooled = dense_index(vals, ["value"], ["entity"], "pos")
    return pooled.join(F.broadcast(sizes), "entity")


def sample_space(spark: SparkSession, splits: Sequence[tuple[str, int]], rows_per_partition: int = 2_000_000) -> DataFrame:
    """(split, split_pos, sample_index) for every split; partitions scale with the count."""
    parts = []
    for pos, (name, count) in enumerate(splits):
        if count <= 0:
            raise ValueError(f"split {name} must have a positive count")
        n_part = max(spark.sparkContext.defaultParallelism, math.ceil(count / rows_per_partition))
        n_part = min(n_part, count)
        parts.append(spark.range(0, count, 1, n_part)
                     .select(F.lit(name).alias("split"), F.lit(pos).alias("split_pos"),
                             F.col("id").alias("sample_index")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def weighted_choice(samples: DataFrame, u_col: str, choices: DataFrame, order_col: str, weight_col: str) -> DataFrame:
    """Join each sample to the choice k whose cumulative-weight interval [lo, hi) holds
    u * total (the bisect rule of ``random.choices``).

    For choice tables of a size known to be small, such as templates: one window adds the weights up, and an
    interval ends where the next one begins.  Pools of any size take `alias.alias_choice`.
    """
    order = Window.orderBy(order_col)
    cum = choices.where(F.col(weight_col) > 0).withColumn(
        "_lo", F.coalesce(F.sum(weight_col).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    cum = cum.withColumn("_hi", F.coalesce(F.lead("_lo").over(order), F.lit(float("inf"))))
    total = choices.where(F.col(weight_col) > 0).agg(F.sum(weight_col)).first()[0]  # a single scalar
    table = F.broadcast(cum.select("_lo", "_hi", *[F.col(c).alias("_c_" + c) for c in choices.columns]))
    s = samples.withColumn("_x", F.col(u_col) * F.lit(total))
    picked = s.join(table, (F.col("_lo") <= F.col("_x")) & (F.col("_x") < F.col("_hi")), "left")
    return picked.select(*samples.columns, *[F.col("_c_" + c).alias(c) for c in choices.columns])


def choose_templates(samples: DataFrame, grammar: Grammar, seed: int) -> DataFrame:
    n_templates, n_weighted = grammar.template_counts()
    if n_templates == 0:
        raise ValueError("grammar has no templates")
    s = samples.withColumn("_u_t", uniform(seed, F.col("split"), F.col("sample_index"), "template"))
    t = grammar.templates.select("template_index", "template", "weight")
    if n_weighted:
        out = weighted_choice(s, "_u_t", t.select("template_index", "template", F.col("weight").cast("double")),
                              "template_index", "weight")
        return out.drop("_u_t", "weight")
    idx = t.select("template_index", "template",
                   (F.row_number().over(Window.orderBy("template_index")) - 1).cast("long").alias("_tpos"))
    s = s.withColumn("_tpos", F.floor(F.col("_u_t") * F.lit(n_templates)).cast("long"))
    return s.join(F.broadcast(idx), "_tpos").drop("_tpos", "_u_t")


def choose_entities(samples: DataFrame, grammar: Grammar, pools: DataFrame, seed: int) -> DataFrame:
    """One draw per entity that occurs in the chosen template; value column ``v_<entity>``."""
    weighted = "weight" in pools.columns
    sizes = {r["entity"]: r["n"] for r in pools.groupBy("entity").agg(F.max("n").alias("n")).collect()}
    out = samples
    for e in grammar.entity_order:
        if e not in sizes:
            raise ValueError(f"entity {e} has no values")
        present = F.col("template").contains("{" + e + "}")
        u = uniform(seed, F.col("split"), F.col("sample_index"), "entity", e)
        pool = pools.where(F.col("entity") == e)
        if weighted:
            slots = alias_table(pool, "value", "weight", bounded=sizes[e] <= BROADCAST_ROWS)
            out = alias_choice(out.withColumn("_u_e", F.when(present, u)), "_u_e", slots, name=f"v_{e}").drop("_u_e")
            continue
        pool = pool.select(F.col("pos").alias(f"_p_{e}"), F.col("value").alias(f"v_{e}"))
        pool = broadcast_if_small(pool)
        out = out.withColumn(f"_p_{e}", F.when(present, F.floor(u * F.lit(sizes[e])).cast("long")))
        out = out.join(pool, f"_p_{e}", "left").drop(f"_p_{e}")
    return out


def fill_templates(df: DataFrame, grammar: Grammar) -> DataFrame:
    """Replace every ``{entity}`` in declaration order; presence is tested on the template."""
    text = F.col("template")
    for e in grammar.entity_order:
        ph = "{" + e + "}"
        text = F.when(F.col("template").contains(ph), F.replace(text, F.lit(ph), F.col(f"v_{e}"))).otherwise(text)
    return df.withColumn("clean_text", text)


def label_expr(template: Column, rules: Sequence[tuple[str, str]]) -> Column:
    out = None
    for needle, label in rules:
        out = (F.when(template.contains(needle), F.lit(label)) if out is None
               else out.when(template.contains(needle), F.lit(label)))
    return out.otherwise(F.lit(DEFAULT_LABEL)) if out is not None else F.lit(DEFAULT_LABEL)


def grammar_hash(grammar: Grammar, pools: DataFrame | None = None) -> DataFrame:
    """One-row frame ``grammar_rev``: hash of the template lines (by index) followed by one
    tree hash per entity pool (by position), in entity declaration order."""
    pools = pools if pools is not None else entity_pools(grammar)
    t_lines = grammar.templates.select(
        F.lit(0).alias("_g"), "template_index",
        F.to_json(F.struct("template", "template_index", "weight")).alias("line"))
    t_hash = t_lines.groupBy("_g").agg(ordered_hash("template_index", "line").alias("h")).select(
        F.lit(-1).alias("_k"), "h")
    order = F.create_map(*[x for i, e in enumerate(grammar.entity_order) for x in (F.lit(e), F.lit(i))])
    e_lines = pools.select("entity", "pos", F.to_json(F.struct("entity", "value")).alias("line"))
    e_hash = tree_hash(e_lines, ["entity"], "pos", "line", "h").select(order[F.col("entity")].alias("_k"), "h")
    both = t_hash.unionByName(e_hash).withColumn("_g", F.lit(0))
    return both.groupBy("_g").agg(ordered_hash("_k", "h").alias("grammar_rev")).drop("_g")


def generate(spark: SparkSession, grammar: Grammar, splits: Sequence[tuple[str, int]], seed: int,
             tasks: Sequence[str] = TASKS, noise: NoiseConfig = NoiseConfig(),
             synonyms: DataFrame | None = None, pools: DataFrame | None = None,
             rev: str | None = None, extra_meta: dict[str, str] | None = None) -> DataFrame:
    """Records with the union schema: id, task, split, sample_index, ord, text, src, tgt,
    label, meta{grammar_rev, seed, split, template_index}.  ``ord`` orders records within a
    split (index-major, then task list order) and drives the split hash.  ``pools`` and
    ``rev`` may be passed in when already computed for this grammar (see entity_pools,
    grammar_hash).  ``extra_meta`` adds provenance fields to ``meta`` (e.g. the hashes of
    the tokenizer, lexicon or embedding table used), so they enter every record's hash."""
    for t in tasks:
        if t not in TASKS:
            raise ValueError(f"Unsupported task '{t}'")
    pools = pools if pools is not None else entity_pools(grammar)
    rev = rev if rev is not None else grammar_hash(grammar, pools).first()["grammar_rev"]
    samples = sample_space(spark, splits)
    chosen = choose_entities(choose_templates(samples, grammar, seed), grammar, pools, seed)
    filled = fill_templates(chosen, grammar)
    noisy = add_noise(filled, "clean_text", [seed, F.col("split"), F.col("sample_index")], noise,
                      out_col="noisy_text", synonyms=synonyms)
    ents = set(grammar.entity_order)
    if all(e in ents for e in TARGET_ENTITIES):
        target = F.coalesce(F.concat(*[x for e in TARGET_ENTITIES[:1] for x in (F.col(f"v_{e}"), F.lit(" -> "))],
                                     F.col(f"v_{TARGET_ENTITIES[1]}")), F.col("clean_text"))
    else:
        target = F.col("clean_text")
    label = label_expr(F.col("template"), grammar.label_rules)
    fan = noisy.select("*", F.posexplode(F.array(*[F.lit(t) for t in tasks])).alias("task_pos", "task"))
    n_tasks = len(tasks)
    task = F.col("task")
    return fan.select(
        F.format_string("%s-%s-%06d", F.col("split"), task, F.col("sample_index")).alias("id"),
        task.alias("task"),
        "split", "split_pos", "sample_index",
        (F.col("sample_index") * n_tasks + F.col("task_pos")).alias("ord"),
        F.when(task.isin("lm", "cls"), F.col("noisy_text")).alias("text"),
        F.when(task == "seq2seq", F.col("noisy_text")).alias("src"),
        F.when(task == "seq2seq", target).alias("tgt"),
        F.when(task == "cls", label).alias("label"),
        F.struct(F.lit(rev).alias("grammar_rev"), F.lit(seed).cast("long").alias("seed"),
                 F.col("split").alias("split"), F.col("template_index").cast("int").alias("template_index"),
                 *[F.lit(v).cast("string").alias(k) for k, v in sorted((extra_meta or {}).items())]
                 ).alias("meta"),
    )


def grammar_violations(grammar: Grammar) -> DataFrame:
    """Data-quality checks of a grammar as one row per rule with its violation count.

    Rules: an entity with no values; no templates; a template placeholder with no entity;
    some but not all templates weighted; a negative weight; weights whose total is not
    positive.
    """
    spark = grammar.templates.sparkSession
    t = grammar.templates
    ents = grammar.entities.groupBy("entity").agg(F.count("value").alias("n_values"))
    declared = spark.createDataFrame([(e,) for e in grammar.entity_order], "entity string")
    empty_entities = declared.join(ents, "entity", "left").where(F.coalesce(F.col("n_values"), F.lit(0)) == 0)
    placeholders = (t.select("template_index", F.explode(F.regexp_extract_all("template", F.lit(r"\{([^{}]+)\}"), 1))
                             .alias("entity")).distinct())
    unknown = placeholders.join(F.broadcast(declared), "entity", "left_anti")
    wstats = t.agg(F.count(F.lit(1)).alias("n"), F.count("weight").alias("n_w"),
                   F.sum(F.when(F.col("weight") < 0, 1).otherwise(0)).alias("n_neg"),
                   F.sum("weight").alias("total"))
    rules = wstats.select(
        F.explode(F.array(
            F.struct(F.lit("no_templates").alias("rule"), F.when(F.col("n") == 0, 1).otherwise(0).cast("long").alias("violations")),
            F.struct(F.lit("weights_count").alias("rule"),
                     F.when((F.col("n_w") > 0) & (F.col("n_w") != F.col("n")), 1).otherwise(0).cast("long").alias("violations")),
            F.struct(F.lit("negative_weight").alias("rule"), F.col("n_neg").cast("long").alias("violations")),
            F.struct(F.lit("weights_total").alias("rule"),
                     F.when((F.col("n_w") > 0) & ~(F.coalesce(F.col("total"), F.lit(0.0)) > 0), 1).otherwise(0).cast("long").alias("violations")),
        )).alias("r")).select("r.*")
    counts = (empty_entities.select(F.lit("empty_entity").alias("rule"))
              .unionByName(unknown.select(F.lit("unknown_placeholder").alias("rule")))
              .groupBy("rule").agg(F.count(F.lit(1)).alias("violations")))
    names = spark.createDataFrame([("empty_entity",), ("unknown_placeholder",)], "rule string")
    counted = names.join(counts, "rule", "left").select("rule", F.coalesce("violations", F.lit(0)).cast("long").alias("violations"))
    return rules.unionByName(counted)
