"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over the given tables.

Every computed column carries an explicit alias that its oracle SQL repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.canon import canonical_line
from lexiforge.functions.draws import uniform
from lexiforge.functions.hashing import ordered_hash, rank_tree_hash, tree_hash
from lexiforge.functions.text import UNK
from lexiforge.functions.text import chars as _chars
from lexiforge.operators import alias, bpe, embed, stats, tokenize, wordpiece
from lexiforge.operators import dataset as ds
from lexiforge.operators import generate as gen
from lexiforge.operators import lexicon as lex
from lexiforge.operators import noise as nz
from lexiforge.operators import registry as reg
from lexiforge.operators.noise import NoiseConfig
from lexiforge.operators.stats import corpus_stats
from lexiforge.sources.tables import table
from lexiforge.streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


def _round_doubles(df: DataFrame, cols, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


# --- statistics --------------------------------------------------------------------------

@register("length_stats_by_lang")
def length_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = stats.corpus_stats(docs, split_col="lang", text=F.col("text"))
    return _round_doubles(out, stats.STAT_COLUMNS)


@register("length_histogram")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return stats.length_histogram(docs, "lang", F.col("text"))


@register("word_length_histogram")
def word_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return stats.length_histogram(docs, "source", F.col("text"), unit="word")


# --- basic tokenizers ----------------------------------------------------------------------

@register("char_vocab")
def char_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.vocab(table(spark, sf_dir, "documents"), "text", "char")


@register("byte_vocab")
def byte_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.vocab(table(spark, sf_dir, "documents"), "text", "byte")


@register("char_tokenize")
def char_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = tokenize.tokenize(table(spark, sf_dir, "conversations"), "text", "char", lowercase=True)
    return conv.select("conv_id", "turn", F.col("text_n_tokens").alias("n_tokens"),
                       F.md5(F.array_join("text_tokens", " ")).alias("tokens_md5"))


@register("byte_tokenize")
def byte_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tokenize.tokenize(table(spark, sf_dir, "pages"), "html", "byte")
    toks = F.col("html_tokens")
    return pages.select(
        "page_id", F.col("html_n_tokens").alias("n_bytes"),
        F.aggregate(toks, F.lit(0).cast("long"), lambda acc, b: acc + b).alias("bytes_sum"),
        F.md5(F.array_join(F.transform(toks, lambda b: b.cast("string")), " ")).alias("bytes_md5"))


@register("detokenize_roundtrip")
def detokenize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.roundtrip_audit(table(spark, sf_dir, "documents"), "text", ["doc_id"])


# --- generation ----------------------------------------------------------------------------


# The example grammar's templates and relative weights, and its entity order.
TEMPLATES = [
    (0, "{person} found a {item} at the {location}.", 0.5),
    (1, "{person} lost a {item} in the {location}.", 0.3),
    (2, "{person} traded a {item} near the {location}.", 0.2),
]
ENTITY_ORDER = ("person", "item", "location")
# Seed and noise probabilities of the example dataset configuration.
GEN_SEED = 13
GEN_NOISE = NoiseConfig(drop_prob=0.02, typo_prob=0.01)


def table_grammar(spark: SparkSession, sf_dir: str) -> gen.Grammar:
    """Template grammar whose entity pools are columns of the warehouse tables:
    person <- customer names, item <- part names, location <- nation names."""
    templates = spark.createDataFrame(TEMPLATES, "template_index int, template string, weight double")
    ents = (table(spark, sf_dir, "customer").select(F.lit("person").alias("entity"), F.col("c_name").alias("value"))
            .unionByName(table(spark, sf_dir, "part").select(F.lit("item").alias("entity"), F.col("p_name").alias("value")))
            .unionByName(table(spark, sf_dir, "nation").select(F.lit("location").alias("entity"), F.col("n_name").alias("value"))))
    return gen.Grammar(templates, ents, ENTITY_ORDER)


def table_splits(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    """80/10/10 split of one sample per part row (the sample count grows with the tables)."""
    n = table(spark, sf_dir, "part").count()
    train, valid = n * 8 // 10, n // 10
    return [("train", train), ("valid", valid), ("test", n - train - valid)]


def grammar_state(spark: SparkSession, sf_dir: str):
    """Grammar, its checkpointed entity pools and its hash."""
    g = table_grammar(spark, sf_dir)
    pools = gen.entity_pools(g)
    return g, pools, gen.grammar_hash(g, pools).first()["grammar_rev"]


def generated(spark: SparkSession, sf_dir: str, tasks=gen.TASKS) -> DataFrame:
    g, pools, rev = grammar_state(spark, sf_dir)
    return gen.generate(spark, g, table_splits(spark, sf_dir), GEN_SEED, tasks, GEN_NOISE, pools=pools, rev=rev)


@register("generate_lm")
def generate_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark, sf_dir, ("lm",)).select(
        "id", "split", "sample_index", "text", F.col("meta.template_index").alias("template_index"))


@register("generate_seq2seq")
def generate_seq2seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark, sf_dir, ("seq2seq",)).select(
        "id", "split", "sample_index", "src", "tgt", F.col("meta.template_index").alias("template_index"))


@register("generate_cls")
def generate_cls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark, sf_dir, ("cls",)).select(
        "id", "split", "sample_index", "text", "label", F.col("meta.template_index").alias("template_index"))


@register("template_mix")
def template_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table_grammar(spark, sf_dir)
    s = gen.choose_templates(gen.sample_space(spark, table_splits(spark, sf_dir)), g, GEN_SEED)
    return s.groupBy("split", "template_index").agg(F.count(F.lit(1)).alias("n"))


def weighted_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity pools with weights from the tables; one nation holds 0.99 of its pool's weight."""
    first = F.col("n_nationkey") == 0
    return (table(spark, sf_dir, "customer").select(F.lit("person").alias("entity"), F.col("c_name").alias("value"), (1 + F.col("c_custkey") % 97).cast("double").alias("weight"))
            .unionByName(table(spark, sf_dir, "part").select(F.lit("item"), F.concat_ws("#", "p_partkey", "p_name"), F.col("p_size").cast("double")).toDF("entity", "value", "weight"))
            .unionByName(table(spark, sf_dir, "nation").select(F.lit("location"), F.col("n_name"), F.when(first, 2376.0).otherwise(1.0)).toDF("entity", "value", "weight")))


@register("weighted_entities")
def weighted_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each value is drawn, one draw of every entity per order, by an alias table per entity."""
    slots = alias.alias_table(weighted_pools(spark, sf_dir), "value", "weight", ["entity"])
    draws = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(*[F.lit(e) for e in ENTITY_ORDER])).alias("entity"))
    draws = draws.withColumn("u", uniform(GEN_SEED, F.col("o_orderkey"), F.col("entity")))
    picked = alias.alias_choice(draws, "u", slots, ["entity"], "value")
    return picked.groupBy("entity", "value").agg(F.count(F.lit(1)).alias("n"))


@register("grammar_hash")
def grammar_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gen.grammar_hash(table_grammar(spark, sf_dir))


@register("grammar_violations")
def grammar_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gen.grammar_violations(table_grammar(spark, sf_dir))


# --- noise ---------------------------------------------------------------------------------


NOISE_SEED = 7
# The synonym parameter table for the synonym noise query (word, synonym).
SYNONYMS = [("des", "les"), ("le", "la"), ("la", "le"), ("et", "ou"), ("une", "un"), ("un", "une"),
            ("the", "a"), ("and", "or"), ("der", "die"), ("el", "la")]


def _noised(spark: SparkSession, sf_dir: str, cfg: NoiseConfig) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = nz.add_noise(docs, "text", [NOISE_SEED, F.col("doc_id")], cfg, out_col="noisy")
    return out.select("doc_id", F.length("noisy").alias("n_chars"), F.md5("noisy").alias("text_md5"))


@register("noise_drop")
def noise_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noised(spark, sf_dir, NoiseConfig(drop_prob=1.0))


@register("noise_typo")
def noise_typo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noised(spark, sf_dir, NoiseConfig(typo_prob=1.0))


@register("noise_swap")
def noise_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noised(spark, sf_dir, NoiseConfig(swap_prob=1.0))


@register("noise_all_steps")
def noise_all_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noised(spark, sf_dir, NoiseConfig(drop_prob=0.5, typo_prob=0.5, swap_prob=0.5))


@register("noise_synonym")
def noise_synonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    syn = spark.createDataFrame(SYNONYMS, "word string, synonym string")
    out = nz.add_noise(conv, "text", [NOISE_SEED, F.col("conv_id"), F.col("turn")],
                       NoiseConfig(synonym_prob=0.5), out_col="noisy", synonyms=syn)
    return out.select("conv_id", "turn", F.md5("noisy").alias("text_md5"))


# --- canonical lines, hashes, validation, manifests ----------------------------------------


DOC_COLUMNS = ("doc_id", "lang", "n_chars", "source", "text")


def _doc_lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").alias("split"),
                       canonical_line(docs, list(DOC_COLUMNS)).alias("line"))


def _tampered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with the text of every toxic-labelled document redacted to ''."""
    docs = table(spark, sf_dir, "documents")
    toxic = (table(spark, sf_dir, "labels").where(F.col("toxic") == 1).select("doc_id").distinct()
             .withColumn("_toxic", F.lit(True)))
    return (docs.join(toxic, "doc_id", "left")
            .withColumn("text", F.when(F.col("_toxic"), F.lit("")).otherwise(F.col("text"))).drop("_toxic"))


@register("canonical_lines")
def canonical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _doc_lines(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", F.sha2("line", 256).alias("line_sha"))


@register("split_hash")
def split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.split_hashes(_doc_lines(table(spark, sf_dir, "documents")), "doc_id")


@register("dataset_hash")
def dataset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.dataset_hash(split_hash(spark, sf_dir), order=None)


@register("validate_hashes")
def validate_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = ds.split_hashes(_doc_lines(table(spark, sf_dir, "documents")), "doc_id")
    computed = ds.split_hashes(_doc_lines(_tampered_documents(spark, sf_dir)), "doc_id")
    return ds.validate_hashes(declared, computed, order=None)


def _generated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark, sf_dir, gen.TASKS)


@register("generated_manifest")
def generated_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split of the generated dataset: row count, split hash, statistics, and the
    dataset hash over train, valid, test (the manifest body, one row per split)."""
    from lexiforge.session import scratch_path

    # records feed three aggregations (hashes, statistics, counts): generate them once, into the shared folder
    path = scratch_path(spark, "generated-records")
    ds.with_canonical_line(_generated_records(spark, sf_dir), ds.RECORD_COLUMNS).write.parquet(path)
    recs = spark.read.parquet(path)
    hashes = ds.split_hashes(recs, "ord")
    st = corpus_stats(recs, splits=stats.SPLITS)
    out = ds.with_dataset_hash(hashes.withColumnRenamed("num_records", "row_count").join(st, "split"))
    return _round_doubles(out, stats.STAT_COLUMNS)


@register("schema_violations")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.schema_violations(_generated_records(spark, sf_dir))


@register("manifest_completeness")
def manifest_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest per document source (its splits are the languages); share of the
    required manifest fields each one fills."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", "source", "lang", canonical_line(docs, list(DOC_COLUMNS)).alias("line"))
    per_split = tree_hash(lines, ["source", "lang"], "doc_id", "line", "split_hash").join(
        docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")), ["source", "lang"])
    manifests = per_split.groupBy("source").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "split_hash"))))).alias("split_hashes"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "n"))))).alias("row_counts"),
        ordered_hash("lang", "split_hash").alias("dataset_hash"),
        F.count(F.lit(1)).alias("splits"),
    ).select(F.col("source").alias("dataset_name"), F.lit("parquet").alias("format"), "splits", "split_hashes",
             "row_counts", "dataset_hash", F.lit(None).cast("long").alias("seed"),
             F.lit(None).cast("string").alias("grammar_file"))
    return _round_doubles(ds.completeness(manifests), ["completeness"])


REPEATED_BUILDS = 3


@register("run_reproducibility")
def run_reproducibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated builds of the documents' dataset hash, each under another partitioning, appended to a run table.

    Lines are hashed where they are read; only the digests are dealt anew, over numbers of partitions that follow the input.
    """
    from lexiforge.session import scratch_path

    docs = table(spark, sf_dir, "documents")
    config_hash = F.sha2(F.lit("documents|source|doc_id|tree"), 256)
    runs, parts = scratch_path(spark, "runs"), docs.rdd.getNumPartitions()
    for run_id in range(REPEATED_BUILDS):
        digests = _doc_lines(docs).select("split", "doc_id", F.sha2("line", 256).alias("line"))
        dealt = digests.repartition((run_id + 1) * parts + run_id)
        built = ds.dataset_hash(ds.split_hashes(dealt, "doc_id"), order=None)
        built.select(config_hash.alias("config_hash"), F.lit(run_id).alias("run_id"), "dataset_hash").write.mode("append").parquet(runs)
    history = spark.read.parquet(runs)
    rates = _round_doubles(ds.reproducibility(history), ["reproducibility"])
    return rates.join(history.groupBy("config_hash").agg(F.min("dataset_hash").alias("dataset_hash")), "config_hash")


# --- learned tokenizer (BPE) ---------------------------------------------------------------


BPE_MIN_FREQ = 2
BPE_VOCAB_SIZE = 10_000  # the declared vocabulary: training ends when it is full or no pair is left
BPE_CHECKED_VOCAB_SIZE = 160  # of the same queries once more, where recursive SQL can still follow every merge
BPE_SMALL_VOCAB_SIZE = 40  # below it: the vocabulary is cut within the alphabet


def bpe_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.training_units(table(spark, sf_dir, "documents"), "text", lowercase=True)


def bpe_model(spark: SparkSession, sf_dir: str, vocab_size: int = BPE_VOCAB_SIZE) -> bpe.BpeModel:
    """BPE model trained to ``vocab_size`` on the lowercased words of ``documents``."""
    return bpe.train(bpe_units(spark, sf_dir), vocab_size, BPE_MIN_FREQ)


@register("bpe_word_counts")
def bpe_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_units(spark, sf_dir).select(F.col("unit").alias("word"), "freq")


@register("bpe_nfc_word_counts")
def bpe_nfc_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training units of NFC-normalised text."""
    units = bpe.training_units(table(spark, sf_dir, "documents"), "text", lowercase=True, normalize="NFC")
    return units.select(F.col("unit").alias("word"), "freq")


@register("bpe_alphabet")
def bpe_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    a = bpe.alphabet(bpe_units(spark, sf_dir))
    ids = a.withColumn("id", F.row_number().over(Window.orderBy("symbol")).cast("int"))
    unk = spark.createDataFrame([(UNK, 0)], "symbol string, id int")
    return unk.unionByName(ids)


@register("bpe_pair_stats")
def bpe_pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.pair_stats(bpe.symbol_arrays(bpe_units(spark, sf_dir)))


@register("bpe_best_pair")
def bpe_best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.best_pair(bpe.pair_stats(bpe.symbol_arrays(bpe_units(spark, sf_dir))), BPE_MIN_FREQ)


def register_sizes(name: str):
    """Register a query (spark, sf_dir, vocabulary size) at the declared vocabulary, and at the checked one."""
    def deco(fn):
        REGISTRY[name] = lambda spark, sf_dir: fn(spark, sf_dir, BPE_VOCAB_SIZE)
        REGISTRY[f"{name}_{BPE_CHECKED_VOCAB_SIZE}"] = lambda spark, sf_dir: fn(spark, sf_dir, BPE_CHECKED_VOCAB_SIZE)
        return fn

    return deco


@register_sizes("bpe_train")
def bpe_train(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    return bpe_model(spark, sf_dir, size).merges_frame(spark)


@register_sizes("bpe_vocab")
def bpe_vocab(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    return bpe_model(spark, sf_dir, size).vocab_frame(spark)


@register("bpe_vocab_small")
def bpe_vocab_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_model(spark, sf_dir, BPE_SMALL_VOCAB_SIZE).vocab_frame(spark)


@register_sizes("bpe_table_check")
def bpe_table_check(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    return bpe.table_check(bpe_model(spark, sf_dir, size).merges_frame(spark))


def _encoded_conversations(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    return bpe.apply_tokenizer(table(spark, sf_dir, "conversations"), ["text"], bpe_model(spark, sf_dir, size))


@register_sizes("bpe_encode")
def bpe_encode(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    enc = _encoded_conversations(spark, sf_dir, size)
    return enc.select("conv_id", "turn", F.size("text_tokens").alias("n_tokens"),
                      F.md5(F.array_join("text_tokens", " ")).alias("tokens_md5"))


@register_sizes("bpe_ids")
def bpe_ids(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    enc = _encoded_conversations(spark, sf_dir, size)
    ids = F.col("text_ids")
    return enc.select("conv_id", "turn",
                      F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("ids_sum"),
                      F.md5(F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")).alias("ids_md5"))


@register_sizes("oov_rate")
def oov_rate(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """Share of tokens mapped to <unk>, per conversation role."""
    model = bpe_model(spark, sf_dir, size)
    enc = bpe.apply_tokenizer(table(spark, sf_dir, "conversations"), ["text"], model)
    return bpe.oov_rates(enc, "role", "text", model)


@register("bpe_apply_counts")
def bpe_apply_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenized records per role; any model counts the same, so the smallest is taken."""
    return bpe.tokenized_counts(_encoded_conversations(spark, sf_dir, BPE_SMALL_VOCAB_SIZE), ["text"], "role")


# --- learned tokenizer (WordPiece) ---------------------------------------------------------


WORDPIECE_VOCAB_SIZE = 240
WORDPIECE_MIN_FREQ = 20


def wordpiece_model(spark: SparkSession, sf_dir: str) -> wordpiece.WordPieceModel:
    return wordpiece.train(bpe_units(spark, sf_dir), WORDPIECE_VOCAB_SIZE, WORDPIECE_MIN_FREQ)


@register("wordpiece_train")
def wordpiece_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece_model(spark, sf_dir).merges_frame(spark)


@register("wordpiece_vocab")
def wordpiece_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece_model(spark, sf_dir).vocab_frame(spark)


@register("wordpiece_encode")
def wordpiece_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest-match tokens of ``conversations``."""
    model = wordpiece_model(spark, sf_dir)
    enc = table(spark, sf_dir, "conversations").withColumn("e", wordpiece.encoded("text", model))
    return enc.select("conv_id", "turn", F.size("e.tokens").alias("n_tokens"),
                      F.aggregate("e.ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids_sum"),
                      F.md5(F.array_join("e.tokens", " ")).alias("tokens_md5"))


# --- lexicons ------------------------------------------------------------------------------


LEXICON_TOP_N = 25
LEXICON_SEED = 11


@register("domain_lexicon")
def domain_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lex.domain_vocabulary(table(spark, sf_dir, "documents"), "source", "text", LEXICON_TOP_N)
    return v.select(F.col("domain").alias("source"), F.col("rank").cast("long").alias("rank"), "word", "n")


def _lexicon_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of each source, numbered by the distributed dense index."""
    v = lex.domain_counts(table(spark, sf_dir, "documents"), "source", "text")
    entries = lex.normalise_entries(v.select("domain", F.col("word").alias("value"), F.col("n").alias("count")))
    return lex.shuffle_positions(entries, "domain", "token", LEXICON_SEED)


@register("lexicon_shuffle")
def lexicon_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _lexicon_entries(spark, sf_dir)
    return e.select(F.col("domain").alias("source"), "pos", "token")


@register("lexicon_summary")
def lexicon_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _lexicon_entries(spark, sf_dir)
    return lex.lexicon_summary(e, "domain", ["count", "token", "value"], mode="tree").withColumnRenamed("domain", "source")


# --- embeddings ----------------------------------------------------------------------------


EMB_DIM = 16
EMB_SEED = 5


def _char_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = tokenize.vocab(table(spark, sf_dir, "documents"), "text", "char", lowercase=True).select("token")
    return embed.fixed_embeddings(toks, EMB_DIM, EMB_SEED)


@register("fixed_embeddings")
def fixed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _char_embeddings(spark, sf_dir)
    return e.select("token", F.size("values").alias("dim"),
                    F.round(F.element_at("values", 1).cast("double"), 6).alias("v0"),
                    F.md5(embed.value_line(F.col("values"))).alias("values_md5"))


@register("embedding_summary")
def embedding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.embedding_summary(_char_embeddings(spark, sf_dir))


@register("mean_embeddings")
def mean_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _chars(F.col("text"), lowercase=True).alias("toks"))
    m = embed.mean_embeddings(docs, ["doc_id"], "toks", _char_embeddings(spark, sf_dir), EMB_DIM)
    digest = F.md5(F.concat_ws(",", F.transform("mean", lambda v: F.floor(v * 1e6 + 0.5).cast("string"))))
    return m.select("doc_id", "n_tokens", F.round(F.element_at("mean", 1), 6).alias("mean0"), digest.alias("mean_md5"))


# --- registry ------------------------------------------------------------------------------


# Creation stamps of the registry example (existing rows, incoming batch).
REG_CREATED_OLD = "2026-01-01T00:00:00+00:00"
REG_CREATED_NEW = "2026-12-01T00:00:00+00:00"


@register("registry_upsert")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry of per-source datasets, upserted with the redacted copy's hashes and with
    new per-language datasets (their names derived from the path)."""
    from pyspark.sql import Window

    old = ds.split_hashes(_doc_lines(table(spark, sf_dir, "documents")), "doc_id")
    existing = old.select(
        (F.row_number().over(Window.orderBy("split")) - 1).cast("long").alias("pos"),
        F.concat(F.lit("datasets/"), "split").alias("path"), F.col("split").alias("name"),
        F.col("split_hash").alias("manifest_hash"), F.lit(REG_CREATED_OLD).alias("created_utc"))
    red = ds.split_hashes(_doc_lines(_tampered_documents(spark, sf_dir)), "doc_id")
    by_lang = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("split"),
                                                       canonical_line(table(spark, sf_dir, "documents"),
                                                                      list(DOC_COLUMNS)).alias("line"))
    langs = ds.split_hashes(by_lang, "doc_id")
    incoming = (red.select(F.concat(F.lit("datasets/"), "split").alias("path"), F.col("split").alias("mname"),
                           "split_hash", F.lit(0).alias("grp"))
                .unionByName(langs.select(F.concat(F.lit("datasets/lang="), "split").alias("path"),
                                          F.lit(None).cast("string").alias("mname"), "split_hash", F.lit(1).alias("grp"))))
    incoming = incoming.select(
        F.row_number().over(Window.orderBy("grp", "path")).alias("seq"), "path",
        reg.entry_name(F.col("mname"), F.col("path")).alias("name"),
        F.col("split_hash").alias("manifest_hash"), F.lit(REG_CREATED_NEW).alias("created_utc"))
    return reg.upsert(existing, incoming)


# --- streaming -----------------------------------------------------------------------------


@register("stream_stats")
def stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stream.stream_stats(spark, f"{sf_dir.rstrip('/')}/documents.parquet", "lang", "text")
    return _round_doubles(out, stats.STAT_COLUMNS)


@register("stream_tokenize")
def stream_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.stream_char_tokens(spark, f"{sf_dir.rstrip('/')}/conversations.parquet", ["conv_id", "turn"], "text")


@register_sizes("bpe_tokenizer_hash")
def bpe_tokenizer_hash(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    return bpe.tokenizer_hash(bpe_model(spark, sf_dir, size), spark)


@register("manifest_violations")
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure rules over one manifest per document source, whose tokenizer hash is the
    trained tokenizer's for sources whose every document is labelled, else empty."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", "source", "lang", canonical_line(docs, list(DOC_COLUMNS)).alias("line"))
    per_split = tree_hash(lines, ["source", "lang"], "doc_id", "line", "split_hash")
    labelled = (docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("_l", F.lit(1)),
                          "doc_id", "left")
                .groupBy("source").agg(F.min(F.coalesce("_l", F.lit(0))).alias("all_labelled")))
    small = bpe_model(spark, sf_dir, BPE_SMALL_VOCAB_SIZE)  # the rules ask for a hash, not for a large vocabulary
    tok = bpe.tokenizer_hash(small, spark).first()["tokenizer_hash"]  # one scalar
    manifests = (per_split.groupBy("source").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "split_hash"))))).alias("split_hashes"),
        ordered_hash("lang", "split_hash").alias("dataset_hash"))
        .join(labelled, "source")
        .select("source", "split_hashes", "dataset_hash",
                F.when(F.col("all_labelled") == 1, F.lit(tok)).otherwise(F.lit("")).alias("tokenizer_hash")))
    return ds.manifest_violations(manifests)


@register_sizes("stream_bpe_encode")
def stream_bpe_encode(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """The trained tokenizer applied to ``conversations`` read as a stream."""
    model = bpe_model(spark, sf_dir, size)
    src = stream.source(spark, f"{sf_dir.rstrip('/')}/conversations.parquet")
    enc = bpe.apply_tokenizer(src, ["text"], model, add_ids=False)
    out = enc.select("conv_id", "turn", F.size("text_tokens").alias("n_tokens"),
                     F.md5(F.array_join("text_tokens", " ")).alias("tokens_md5"))
    return stream.run_append(out, "stream-bpe")


@register("dataset_write_validate")
def dataset_write_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated dataset written as JSON Lines with its manifest under the shared
    checkpoint folder, read back from the files and validated against the manifest."""
    from lexiforge.session import scratch_path
    from lexiforge.sources import io

    out = scratch_path(spark, "generated-dataset")
    io.write_dataset(_generated_records(spark, sf_dir), out, "jsonl", "table_grammar")
    return io.validate_dataset(spark, out)


@register_sizes("bpe_train_lines")
def bpe_train_lines(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """Merges learned with whole lowercased texts as units (spaces and newlines are
    symbols, merges may cross words), on ``conversations``."""
    units = bpe.training_units(table(spark, sf_dir, "conversations"), "text", lowercase=True, unit="line")
    return bpe.train(units, size, BPE_MIN_FREQ, unit="line").merges_frame(spark)


# --- sparse ordinals, corpus files, mixed formats, registry store --------------------------


TREE_FANOUT = 64
SPARSE_STEP = 1_000_003  # ordinals this far apart: no bucket of ordinals would hold two of them
CORPUS_LIMIT_SHARE = 3  # the corpus scan takes the first third of the accepted texts


@register("sparse_tree_hash")
def sparse_tree_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of every source's documents by rank, their ordinals spread over the 64-bit range."""
    lines = _doc_lines(table(spark, sf_dir, "documents")).withColumn("ordinal", F.col("doc_id") * SPARSE_STEP * SPARSE_STEP)
    return rank_tree_hash(lines, ["split"], ["ordinal"], "line", "split_hash", TREE_FANOUT).withColumnRenamed("split", "source")


@register("embeddings_tree_hash")
def embeddings_tree_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of the whole table of embeddings: one line a vector, in the order of vec_id, in bounded nodes."""
    e = table(spark, sf_dir, "embeddings")
    line = F.concat_ws(":", "vec_id", embed.value_line(F.col("embedding")))
    return rank_tree_hash(e.select("vec_id", line.alias("line")), [], ["vec_id"], "line", "embeddings_hash", TREE_FANOUT)


@register("corpus_file_units")
def corpus_file_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training units of JSON Lines files written from ``documents`` (some rows without a text), scanned up to a limit."""
    from lexiforge.session import scratch_path
    from lexiforge.sources import corpus

    docs = table(spark, sf_dir, "documents")
    out = scratch_path(spark, "corpus-files")
    text = F.when(F.col("doc_id") % 7 == 3, F.lit(None)).otherwise(F.col("text"))
    docs.select("doc_id", text.alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.json(out)
    limit = docs.where("doc_id % 7 <> 3 and text is not null").count() // CORPUS_LIMIT_SHARE
    texts = corpus.scan_texts(spark, out, "text", limit)
    units = bpe.training_units(texts, "text", lowercase=True)
    return units.select(F.col("unit").alias("word"), "freq")


@register("mixed_format_stats")
def mixed_format_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the generated dataset with its training split as JSON Lines and the others as Parquet."""
    from lexiforge.session import scratch_path
    from lexiforge.sources import corpus, io

    out = scratch_path(spark, "mixed-dataset")
    recs = _generated_records(spark, sf_dir)
    io.write_records(recs.where("split = 'train'"), out, "jsonl", "append")
    io.write_records(recs.where("split <> 'train'"), out, "parquet", "append")
    return _round_doubles(corpus_stats(corpus.read_splits(spark, out, stats.SPLITS), splits=stats.SPLITS), stats.STAT_COLUMNS)


@register("registry_commits")
def registry_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per document source, made by several writers at once; the committed registry's rows."""
    from concurrent.futures import ThreadPoolExecutor

    from lexiforge.operators.registry_store import RegistryStore
    from lexiforge.session import scratch_path

    base = scratch_path(spark, "registry")
    hashes = ds.split_hashes(_doc_lines(table(spark, sf_dir, "documents")), "doc_id").select("split", "split_hash").collect()  # one row a source

    def commit(row) -> int:
        inc = spark.createDataFrame([(0, f"datasets/{row['split']}", row["split"], row["split_hash"], REG_CREATED_NEW)],
                                    "seq long, path string, name string, manifest_hash string, created_utc string")
        return RegistryStore(spark, base).upsert(inc)

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(commit, hashes))
    return RegistryStore(spark, base).load().select("path", "name", "manifest_hash")


HELD_OUT = 10  # one document of so many is scored and not learned from


@register("oov_heldout")
def oov_heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language of the held-out split, the share of words never seen in the training split; both are read
    from one written dataset, and the words seen are a table that is joined."""
    from lexiforge.functions.text import words
    from lexiforge.session import scratch_path

    out = scratch_path(spark, "held-out")
    docs = table(spark, sf_dir, "documents")
    split = F.when(F.col("doc_id") % HELD_OUT == 0, "valid").otherwise("train")
    docs.select("lang", "text", split.alias("split")).write.partitionBy("split").parquet(out)
    rows = spark.read.parquet(out)
    seen = bpe.training_units(rows.where("split = 'train'"), "text", lowercase=True).select(F.col("unit").alias("word"), F.lit(1).alias("seen"))
    held = rows.where("split = 'valid'").select("lang", F.explode(words(F.lower("text"))).alias("word")).groupBy("lang", "word").count()
    out = held.join(seen, "word", "left").groupBy("lang").agg(
        F.sum("count").alias("n_words"), F.sum(F.when(F.col("seen").isNull(), F.col("count")).otherwise(0)).alias("n_oov"))
    return out.withColumn("oov_rate", F.round(F.col("n_oov") / F.col("n_words"), 6))


STREAM_FILES = 8


@register(f"stream_restart_{BPE_CHECKED_VOCAB_SIZE}")
def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` in several files, tokenized as a stream that is stopped midway and started again."""
    from lexiforge.session import scratch_path

    files = scratch_path(spark, "stream-files")
    spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").repartition(STREAM_FILES, "conv_id", "turn").write.parquet(files)
    model = bpe_model(spark, sf_dir, BPE_CHECKED_VOCAB_SIZE)
    enc = bpe.apply_tokenizer(stream.source(spark, files + "/", max_files=1), ["text"], model, add_ids=False)
    rows = enc.select("conv_id", "turn", F.size("text_tokens").alias("n_tokens"), F.md5(F.array_join("text_tokens", " ")).alias("tokens_md5"))
    out, counted = stream.run_with_restart(rows, "stream-restart", STREAM_FILES // 2, {
        "rows": F.count(F.lit(1)), "tokens": F.sum(F.greatest("n_tokens", F.lit(0)))})
    return out.select("*", F.lit(counted["rows"]).cast("long").alias("rows_observed"), F.lit(counted["tokens"]).cast("long").alias("tokens_observed"))


# --- artifact sinks and provenance ----------------------------------------------------------


def _stored_artifact(spark: SparkSession, df: DataFrame, kind: str, order_cols: list[str], line=None) -> DataFrame:
    """Written, loaded again by its manifest, and verified: one row."""
    from lexiforge.session import scratch_path
    from lexiforge.sources import artifacts

    out = scratch_path(spark, f"artifact-{kind}")
    artifacts.save(df, out, kind, order_cols, line)
    rows = artifacts.load(spark, out, line).count()
    return artifacts.verify(spark, out, line).select("kind", "rows", "content_hash", (F.col("verified") & (F.col("rows") == rows)).alias("verified"))


@register("tokenizer_artifact")
def tokenizer_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = bpe_model(spark, sf_dir, BPE_CHECKED_VOCAB_SIZE).vocab_frame(spark)
    return _stored_artifact(spark, vocab, "tokenizer", ["id"])


@register("embedding_artifact")
def embedding_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.col("token"), F.lit("\t"), embed.value_line(F.col("values")))
    return _stored_artifact(spark, _char_embeddings(spark, sf_dir), "embedding", ["token"], line)


@register("lexicon_artifact")
def lexicon_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _lexicon_entries(spark, sf_dir).select(F.col("domain").alias("source"), "pos", "token", "count")
    return _stored_artifact(spark, entries, "lexicon", ["source", "pos"])


@register("provenance_check")
def provenance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, the tokenizer made from them, conversations encoded with it and a manifest of those, after
    the tokenizer was made again with one token more: it has changed, what was made with it is stale."""
    from lexiforge.operators import provenance

    def whole(df: DataFrame, key: list[str], line) -> str:
        return rank_tree_hash(df.select(*key, line.alias("line")), [], key, "line").first()["hash"]

    docs, conv = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    made = {"documents": whole(docs, ["doc_id"], canonical_line(docs, list(DOC_COLUMNS))),
            "conversations": whole(conv, ["conv_id", "turn"], F.to_json(F.struct("conv_id", "role", "text", "turn")))}
    models = {size: bpe_model(spark, sf_dir, size) for size in (BPE_SMALL_VOCAB_SIZE, BPE_SMALL_VOCAB_SIZE + 1)}
    hashes = {size: bpe.tokenizer_hash(m, spark).first()["tokenizer_hash"] for size, m in models.items()}
    enc = bpe.apply_tokenizer(conv, ["text"], models[BPE_SMALL_VOCAB_SIZE])
    made["tokenizer"] = hashes[BPE_SMALL_VOCAB_SIZE]
    made["encoded"] = whole(enc, ["conv_id", "turn"], F.to_json(F.struct("conv_id", "text_ids", "turn")))
    made["statistics"] = whole(length_stats_by_lang(spark, sf_dir), ["split"], F.to_json(F.struct("split", "num_records")))
    made["manifest"] = made["encoded"]
    edges = [(a, b, made[b]) for a, b in (("tokenizer", "documents"), ("encoded", "tokenizer"), ("encoded", "conversations"),
                                          ("manifest", "encoded"), ("statistics", "documents"))]
    now = {**made, "tokenizer": hashes[BPE_SMALL_VOCAB_SIZE + 1]}
    frame = lambda d: spark.createDataFrame(list(d.items()), provenance.HASHES)
    return provenance.check(spark.createDataFrame(edges, provenance.EDGES), frame(made), frame(now))
