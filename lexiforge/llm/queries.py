"""Registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import chain_dedup, conversation_repair, decontaminate, fm_quality, hash_forest, jaccard_join, langid, mixing, pii, secret_scan, spelling_groups, suffix_dedup, token_counts
from lexiforge.llm.common import documents


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(documents(spark, sf_dir))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir)).withColumn("repeats", F.col("n_removed") > 0)


def op2_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return hash_forest.search(vectors, vectors.where("vec_id % 20 = 0"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op9_chain_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_dedup.repeats(documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secret_scan.report(docs, secret_scan.train(secret_scan.samples_of(docs)))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    return conversation_repair.report(conversation_repair.damaged(rows))


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.variants(documents(spark, sf_dir))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.report(docs, pii.train(docs))


REGISTRY = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_hash_forest": op2_hash_forest,
    "op3_mix_sources": op3_mix_sources,
    "op4_language_id": op4_language_id,
    "op5_quality_fm": op5_quality_fm,
    "op6_decontaminate": op6_decontaminate,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_token_counts": op8_token_counts,
    "op9_chain_dedup": op9_chain_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling_groups": op12_spelling_groups,
    "op13_pii": op13_pii,
}

ORACLES = {
    "op7_jaccard_join": r"""WITH RECURSIVE
        w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END) AS g
              FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 90 * (nx.n + ny.n - shared)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x)
        SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b)::BIGINT AS component_id
        FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    # crc32 of the document's number and the word, byte by byte; near words by what one deletion leaves of each
    "op12_spelling_groups": r"""WITH RECURSIVE
        bits AS (SELECT n, n::UBIGINT AS c, 0 AS k FROM range(256) t(n)
                 UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END::UBIGINT, k + 1 FROM bits WHERE k < 8),
        tab AS MATERIALIZED (SELECT n::INTEGER AS n, c FROM bits WHERE k = 8),
        run AS MATERIALIZED (SELECT doc_id, w, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS h FROM (
                SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY 1, 2),
        crc AS (SELECT w, n, h, 4294967295::UBIGINT AS c, 0 AS pos FROM run
                UNION ALL SELECT w, crc.n, h, xor(crc.c >> 8, tab.c), pos + 1 FROM crc
                JOIN tab ON tab.n = (xor(crc.c, ('0x' || substr(h, 2 * pos + 1, 2))::UBIGINT) & 255)::INTEGER WHERE 2 * pos < length(h)),
        done AS (SELECT w, n, xor(c, 4294967295) AS c FROM crc WHERE 2 * pos = length(h)),
        word AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (
                SELECT CASE WHEN c % 97 = 0 THEN substr(w, 1, (c % length(w))::INTEGER) || substr(w, (c % length(w))::INTEGER + 2) ELSE w END AS word, n FROM done)
                GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
        less AS (SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail
                 FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
        near AS (SELECT a.word AS x, b.word AS y FROM less a JOIN less b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
                 UNION SELECT l.word, w.word FROM less l JOIN word w ON w.word = l.head || l.tail
                 UNION SELECT w.word, l.word FROM less l JOIN word w ON w.word = l.head || l.tail),
        best AS (SELECT x, count(*) AS n_near, max(b.n) AS m FROM near JOIN word b ON b.word = y GROUP BY 1),
        form AS MATERIALIZED (SELECT a.word, a.n, coalesce(n_near, 0)::BIGINT AS n_near, f.form, CASE WHEN f.form IS NOT NULL THEN m END AS form_n
                 FROM word a LEFT JOIN best ON x = a.word
                 LEFT JOIN (SELECT near.x, min(y) AS form FROM near JOIN best ON best.x = near.x JOIN word b ON b.word = y AND b.n = m GROUP BY 1) f
                   ON f.x = a.word AND m >= 2 * a.n),
        walk AS (SELECT word, word AS root, 0 AS k FROM form UNION ALL SELECT w.word, f.form, k + 1 FROM walk w JOIN form f ON f.word = w.root WHERE f.form IS NOT NULL)
        SELECT form.word, form, arg_max(root, k) AS root, any_value(n) AS n, any_value(n_near) AS n_near, any_value(form_n)::HUGEINT AS form_n
        FROM form JOIN walk ON walk.word = form.word GROUP BY 1, 2""",
}
