"""DuckDB SQL equivalents of the registered queries (tables are pre-registered views)."""

from __future__ import annotations

from lexiforge.functions.hashing import tree_hash_sql

ORACLES: dict[str, str] = {}

ORACLES["length_stats_by_lang"] = """
WITH r AS (SELECT lang AS split, text FROM documents),
lens AS (
  SELECT split, count(*)::DOUBLE AS num_records,
         round(avg(length(text)), 6) AS avg_len,
         round(quantile_cont(length(text), 0.5), 6) AS p50_len,
         round(quantile_cont(length(text), 0.95), 6) AS p95_len
  FROM r GROUP BY split),
voc AS (
  SELECT split, count(DISTINCT c)::DOUBLE AS vocab_size_char
  FROM (SELECT split, unnest(string_split(text, '')) AS c FROM r) WHERE c <> '' GROUP BY split)
SELECT lens.split, num_records, avg_len, p50_len, p95_len,
       coalesce(voc.vocab_size_char, 0.0) AS vocab_size_char
FROM lens LEFT JOIN voc USING (split)
"""

ORACLES["length_histogram"] = """
SELECT lang, length(text)::BIGINT AS length, count(*)::BIGINT AS n FROM documents GROUP BY 1, 2
"""

WS = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
# DuckDB (RE2) whitespace class equal to Python's str.split() separators.


def words_sql(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{WS}'), lambda w: w <> '')"


ORACLES["word_length_histogram"] = f"""
SELECT source, len({words_sql('text')})::BIGINT AS length, count(*)::BIGINT AS n FROM documents GROUP BY 1, 2
"""

ORACLES["char_vocab"] = """
SELECT token, (row_number() OVER (ORDER BY token) - 1)::INTEGER AS id
FROM (SELECT DISTINCT c AS token FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '')
"""

ORACLES["byte_vocab"] = """
SELECT token, (row_number() OVER (ORDER BY token) - 1)::INTEGER AS id
FROM (SELECT DISTINCT ('0x' || h)::INTEGER AS token
      FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents))
"""

ORACLES["char_tokenize"] = """
WITH t AS (SELECT conv_id, turn, list_filter(string_split(lower(text), ''), lambda c: c <> '') AS toks FROM conversations)
SELECT conv_id, turn, len(toks)::INTEGER AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_md5 FROM t
"""

ORACLES["byte_tokenize"] = """
WITH b AS (SELECT page_id,
                  list_transform(regexp_extract_all(hex(encode(html)), '..'), lambda h: ('0x' || h)::INTEGER) AS bs
           FROM pages)
SELECT page_id, len(bs)::INTEGER AS n_bytes, coalesce(list_sum(bs), 0)::BIGINT AS bytes_sum,
       md5(array_to_string(bs, ' ')) AS bytes_md5
FROM b
"""

ORACLES["detokenize_roundtrip"] = """
SELECT doc_id, length(text)::INTEGER AS n_chars, octet_length(encode(text))::INTEGER AS n_bytes,
       (array_to_string(string_split(text, ''), '') = text)::INTEGER AS char_ok,
       (decode(unhex(hex(encode(text)))) = text)::INTEGER AS byte_ok,
       md5(text) AS text_md5
FROM documents
"""


# --- generation ----------------------------------------------------------------------------



def u_sql(*keys: str) -> str:
    """Keyed uniform draw, same definition as lexiforge.functions.draws.uniform."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 13))::BIGINT / 4503599627370496.0)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _grammar_ctes() -> str:
    from lexiforge.plans.queries import TEMPLATES

    rows = ", ".join(f"({i}, {_q(t)}, {w}::DOUBLE)" for i, t, w in TEMPLATES)
    return f"""
tpl(template_index, template, weight) AS (VALUES {rows}),
tcum AS (SELECT *, coalesce(sum(weight) OVER (ORDER BY template_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS lo
         FROM tpl WHERE weight > 0),
tc AS (SELECT *, lo + weight AS hi, sum(weight) OVER () AS total FROM tcum),
ent AS (SELECT DISTINCT 'person' AS entity, c_name AS value FROM customer
        UNION SELECT DISTINCT 'item', p_name FROM part
        UNION SELECT DISTINCT 'location', n_name FROM nation),
pool AS (SELECT entity, value, (row_number() OVER (PARTITION BY entity ORDER BY value) - 1)::BIGINT AS pos,
                count(*) OVER (PARTITION BY entity) AS n FROM ent)"""


def _generate_sql(task: str) -> str:
    from lexiforge.plans.queries import GEN_NOISE, GEN_SEED

    seed = str(GEN_SEED)
    k = [seed, "split", "sample_index"]
    ents = ("person", "item", "location")
    ent_cols, ent_joins = [], []
    for e in ents:
        pos = (f"CASE WHEN contains(template, '{{{e}}}') THEN floor({u_sql(*k, _q('entity'), _q(e))} * "
               f"(SELECT max(n) FROM pool WHERE entity = '{e}'))::BIGINT END")
        ent_cols.append(f"{pos} AS p_{e}")
        ent_joins.append(f"LEFT JOIN pool pe_{e} ON pe_{e}.entity = '{e}' AND pe_{e}.pos = st.p_{e}")
    fill = "template"
    for e in ents:
        fill = f"CASE WHEN contains(template, '{{{e}}}') THEN replace({fill}, '{{{e}}}', v_{e}) ELSE {fill} END"
    drop_p, typo_p = GEN_NOISE.drop_prob, GEN_NOISE.typo_prob
    label = ("CASE WHEN contains(template, 'found') THEN 'found' WHEN contains(template, 'lost') THEN 'lost' "
             "WHEN contains(template, 'traded') THEN 'traded' ELSE 'unknown' END")
    sel = {
        "lm": "text",
        "seq2seq": "text AS src, coalesce(v_item || ' -> ' || v_location, clean) AS tgt",
        "cls": f"text, {label} AS label",
    }[task]
    return f"""
WITH {_grammar_ctes()},
cnt AS (SELECT count(*) AS n FROM part),
splits AS (SELECT 'train' AS split, n * 8 // 10 AS c FROM cnt
           UNION ALL SELECT 'valid', n // 10 FROM cnt
           UNION ALL SELECT 'test', n - n * 8 // 10 - n // 10 FROM cnt),
s AS (SELECT split, unnest(range(c)) AS sample_index FROM splits),
st AS (SELECT s.split, s.sample_index, tc.template_index, tc.template, {', '.join(ent_cols)}
       FROM s JOIN tc ON tc.lo <= {u_sql(*k, _q('template'))} * tc.total
                     AND {u_sql(*k, _q('template'))} * tc.total < tc.hi),
sv AS (SELECT st.*, {', '.join(f'pe_{e}.value AS v_{e}' for e in ents)} FROM st {' '.join(ent_joins)}),
f AS (SELECT *, {fill} AS clean FROM sv),
d AS (SELECT *, CASE WHEN {u_sql(*k, _q('drop'))} < {drop_p} AND length(clean) >= 2 THEN
            substring(clean, 1, floor({u_sql(*k, _q('drop_at'))} * length(clean))::BIGINT)
            || substring(clean, floor({u_sql(*k, _q('drop_at'))} * length(clean))::BIGINT + 2)
          ELSE clean END AS t1 FROM f),
y AS (SELECT *, floor({u_sql(*k, _q('typo_at'))} * (length(t1) - 1))::BIGINT AS ti FROM d),
n AS (SELECT *, CASE WHEN {u_sql(*k, _q('typo'))} < {typo_p} AND length(t1) >= 2 THEN
            substring(t1, 1, ti) || substring(t1, ti + 2, 1) || substring(t1, ti + 1, 1) || substring(t1, ti + 3)
          ELSE t1 END AS text FROM y)
SELECT format('{{}}-{{}}-{{:06d}}', split, '{task}', sample_index) AS id, split, sample_index::BIGINT AS sample_index,
       {sel}, template_index::INTEGER AS template_index
FROM n
"""


for _t in ("lm", "seq2seq", "cls"):
    ORACLES[f"generate_{_t}"] = _generate_sql(_t)


def _template_mix_sql() -> str:
    from lexiforge.plans.queries import GEN_SEED

    k = [str(GEN_SEED), "split", "sample_index"]
    return f"""
WITH {_grammar_ctes()},
cnt AS (SELECT count(*) AS n FROM part),
splits AS (SELECT 'train' AS split, n * 8 // 10 AS c FROM cnt
           UNION ALL SELECT 'valid', n // 10 FROM cnt
           UNION ALL SELECT 'test', n - n * 8 // 10 - n // 10 FROM cnt),
s AS (SELECT split, unnest(range(c)) AS sample_index FROM splits)
SELECT split, tc.template_index::INTEGER AS template_index, count(*)::BIGINT AS n
FROM s JOIN tc ON tc.lo <= {u_sql(*k, _q('template'))} * tc.total AND {u_sql(*k, _q('template'))} * tc.total < tc.hi
GROUP BY 1, 2
"""


ORACLES["template_mix"] = _template_mix_sql()


def _grammar_hash_sql() -> str:
    ents = ("person", "item", "location")
    order = " ".join(f"WHEN '{e}' THEN {i}" for i, e in enumerate(ents))
    return f"""
WITH {_grammar_ctes()},
el AS (SELECT entity, pos, to_json({{'entity': entity, 'value': value}})::VARCHAR AS line FROM pool),
eh AS {tree_hash_sql('el', ['entity'], 'pos', 'line', 'h')},
th AS (SELECT -1 AS k, sha256(string_agg(to_json({{'template': template, 'template_index': template_index, 'weight': weight}})::VARCHAR,
                                          chr(10) ORDER BY template_index)) AS h FROM tpl),
allh AS (SELECT k, h FROM th UNION ALL SELECT CASE entity {order} END AS k, h FROM eh)
SELECT sha256(string_agg(h, chr(10) ORDER BY k)) AS grammar_rev FROM allh
"""


ORACLES["grammar_hash"] = _grammar_hash_sql()


def _grammar_violations_sql() -> str:
    return f"""
WITH {_grammar_ctes()},
decl(entity) AS (VALUES ('person'), ('item'), ('location')),
ph AS (SELECT DISTINCT template_index, unnest(regexp_extract_all(template, '\\{{([^{{}}]+)\\}}', 1)) AS entity FROM tpl),
w AS (SELECT count(*) AS n, count(weight) AS n_w, sum(CASE WHEN weight < 0 THEN 1 ELSE 0 END) AS n_neg,
             sum(weight) AS total FROM tpl)
SELECT 'no_templates' AS rule, (CASE WHEN n = 0 THEN 1 ELSE 0 END)::BIGINT AS violations FROM w
UNION ALL SELECT 'weights_count', (CASE WHEN n_w > 0 AND n_w <> n THEN 1 ELSE 0 END)::BIGINT FROM w
UNION ALL SELECT 'negative_weight', n_neg::BIGINT FROM w
UNION ALL SELECT 'weights_total', (CASE WHEN n_w > 0 AND NOT coalesce(total, 0) > 0 THEN 1 ELSE 0 END)::BIGINT FROM w
UNION ALL SELECT 'empty_entity', count(*)::BIGINT FROM decl WHERE entity NOT IN (SELECT entity FROM ent)
UNION ALL SELECT 'unknown_placeholder', count(*)::BIGINT FROM ph WHERE entity NOT IN (SELECT entity FROM decl)
"""


ORACLES["grammar_violations"] = _grammar_violations_sql()


# --- noise ---------------------------------------------------------------------------------

def _noise_sql(drop: float, typo: float, swap: float) -> str:
    from lexiforge.plans.queries import NOISE_SEED

    k = [str(NOISE_SEED), "doc_id"]
    steps = ["t0 AS (SELECT doc_id, text AS t FROM documents)"]
    cur = "t0"
    i = 0
    if drop > 0:
        i += 1
        at = f"floor({u_sql(*k, _q('drop_at'))} * length(t))::BIGINT"
        steps.append(f"""t{i} AS (SELECT doc_id, CASE WHEN {u_sql(*k, _q('drop'))} < {drop} AND length(t) >= 2
            THEN substring(t, 1, {at}) || substring(t, {at} + 2) ELSE t END AS t FROM {cur})""")
        cur = f"t{i}"
    if typo > 0:
        i += 1
        at = f"floor({u_sql(*k, _q('typo_at'))} * (length(t) - 1))::BIGINT"
        steps.append(f"""t{i} AS (SELECT doc_id, CASE WHEN {u_sql(*k, _q('typo'))} < {typo} AND length(t) >= 2
            THEN substring(t, 1, {at}) || substring(t, {at} + 2, 1) || substring(t, {at} + 1, 1) || substring(t, {at} + 3)
            ELSE t END AS t FROM {cur})""")
        cur = f"t{i}"
    if swap > 0:
        i += 1
        at = f"floor({u_sql(*k, _q('swap_at'))} * (len({words_sql('t')}) - 1))::BIGINT"
        steps.append(f"""w{i} AS (SELECT doc_id, t, {words_sql('t')} AS ws, {at} AS wpos FROM {cur})""")
        steps.append(f"""v{i} AS (SELECT *, ws[wpos + 1] AS wa, ws[wpos + 2] AS wb FROM w{i})""")
        steps.append(f"""t{i} AS (SELECT doc_id, CASE WHEN {u_sql(*k, _q('swap'))} < {swap} AND len(ws) >= 2
            THEN array_to_string(list_transform(ws, lambda w, j: CASE WHEN j - 1 = wpos THEN wb
                                                                   WHEN j - 1 = wpos + 1 THEN wa ELSE w END), ' ')
            ELSE t END AS t FROM v{i})""")
        cur = f"t{i}"
    return f"WITH {', '.join(steps)} SELECT doc_id, length(t)::INTEGER AS n_chars, md5(t) AS text_md5 FROM {cur}"


ORACLES["noise_drop"] = _noise_sql(1.0, 0, 0)
ORACLES["noise_typo"] = _noise_sql(0, 1.0, 0)
ORACLES["noise_swap"] = _noise_sql(0, 0, 1.0)
ORACLES["noise_all_steps"] = _noise_sql(0.5, 0.5, 0.5)


def _synonym_sql() -> str:
    from lexiforge.plans.queries import NOISE_SEED, SYNONYMS

    k = [str(NOISE_SEED), "conv_id", "turn"]
    rows = ", ".join(f"({_q(a)}, {_q(b)})" for a, b in SYNONYMS)
    return f"""
WITH syn(word, synonym) AS (VALUES {rows}),
sl AS (SELECT word, list_sort(list(DISTINCT synonym)) AS syns FROM syn GROUP BY word),
c AS (SELECT conv_id, turn, text, {words_sql('text')} AS ws FROM conversations),
g AS (SELECT *, ({u_sql(*k, _q('synonym'))} < 0.5 AND len(ws) > 0) AS gate,
             floor({u_sql(*k, _q('synonym_at'))} * len(ws))::BIGINT AS wpos FROM c),
j0 AS (SELECT g.*, sl.syns FROM g LEFT JOIN sl ON g.gate AND sl.word = g.ws[g.wpos + 1]),
j AS (SELECT *, syns[floor({u_sql(*k, _q('synonym_pick'))} * len(syns))::BIGINT + 1] AS pick FROM j0)
SELECT conv_id, turn,
       md5(CASE WHEN syns IS NOT NULL THEN
             array_to_string(list_transform(ws, lambda w, i: CASE WHEN i - 1 = wpos
                 THEN pick ELSE w END), ' ')
           ELSE text END) AS text_md5
FROM j
"""


ORACLES["noise_synonym"] = _synonym_sql()


# --- canonical lines, hashes, validation, manifests ----------------------------------------

DOC_JSON = "to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source, 'text': text})::VARCHAR"

ORACLES["canonical_lines"] = f"SELECT doc_id, sha256({DOC_JSON}) AS line_sha FROM documents"

_SPLIT_HASH = f"""
WITH l AS (SELECT source AS split, doc_id, {DOC_JSON} AS line FROM documents),
h AS {tree_hash_sql('l', ['split'], 'doc_id', 'line', 'split_hash')},
c AS (SELECT source AS split, count(*)::BIGINT AS num_records FROM documents GROUP BY 1)
SELECT h.split, split_hash, num_records FROM h JOIN c USING (split)
"""
ORACLES["split_hash"] = _SPLIT_HASH
ORACLES["dataset_hash"] = f"SELECT sha256(string_agg(split_hash, chr(10) ORDER BY split)) AS dataset_hash FROM ({_SPLIT_HASH})"

ORACLES["validate_hashes"] = f"""
WITH tox AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
t AS (SELECT d.doc_id, CASE WHEN x.doc_id IS NOT NULL THEN '' ELSE d.text END AS text, d.lang, d.n_chars, d.source
      FROM documents d LEFT JOIN tox x USING (doc_id)),
l1 AS (SELECT source AS split, doc_id, {DOC_JSON} AS line FROM documents),
l2 AS (SELECT source AS split, doc_id, {DOC_JSON} AS line FROM t),
d AS {tree_hash_sql('l1', ['split'], 'doc_id', 'line', 'declared_hash')},
c AS {tree_hash_sql('l2', ['split'], 'doc_id', 'line', 'computed_hash')},
j AS (SELECT coalesce(d.split, c.split) AS split, declared_hash, computed_hash FROM d FULL OUTER JOIN c ON d.split = c.split)
SELECT split, CASE WHEN declared_hash IS NULL THEN 'undeclared' WHEN computed_hash IS NULL THEN 'missing'
                   WHEN declared_hash = computed_hash THEN 'ok' ELSE 'mismatch' END AS status,
       declared_hash, computed_hash FROM j
UNION ALL
SELECT '__dataset__', CASE WHEN ch IS NULL THEN 'missing' WHEN dh = ch THEN 'ok' ELSE 'mismatch' END, dh, ch
FROM (SELECT sha256(string_agg(declared_hash, chr(10) ORDER BY split)) AS dh,
             sha256(string_agg(computed_hash, chr(10) ORDER BY split) FILTER (WHERE declared_hash IS NOT NULL)) AS ch FROM j)
"""

ORACLES["manifest_completeness"] = """
SELECT DISTINCT source AS dataset_name, round(6.0 / 14.0, 6) AS completeness FROM documents
"""

ORACLES["run_reproducibility"] = f"""
WITH l AS (SELECT source AS split, doc_id, sha256({DOC_JSON}) AS line FROM documents),
h AS {tree_hash_sql('l', ['split'], 'doc_id', 'line', 'split_hash')},
runs AS (SELECT run_id, (SELECT sha256(string_agg(split_hash, chr(10) ORDER BY split)) FROM h) AS dataset_hash FROM range(3) t(run_id)),
per AS (SELECT dataset_hash, count(*) AS n FROM runs GROUP BY 1)
SELECT sha256('documents|source|doc_id|tree') AS config_hash, sum(n)::BIGINT AS runs, count(*)::BIGINT AS distinct_hashes,
       round(max(n) / sum(n), 6)::DOUBLE AS reproducibility, min(dataset_hash) AS dataset_hash FROM per
"""


def _generated_union_sql() -> str:
    parts = []
    for t in ("lm", "seq2seq", "cls"):
        cols = {"lm": "id, split, sample_index, text, NULL AS src, NULL AS tgt, NULL AS label, template_index",
                "seq2seq": "id, split, sample_index, NULL AS text, src, tgt, NULL AS label, template_index",
                "cls": "id, split, sample_index, text, NULL AS src, NULL AS tgt, label, template_index"}[t]
        pos = {"lm": 0, "seq2seq": 1, "cls": 2}[t]
        parts.append(f"SELECT '{t}' AS task, {pos} AS task_pos, {cols} FROM ({_generate_sql(t)})")
    return " UNION ALL ".join(parts)


def _generated_manifest_sql() -> str:
    from lexiforge.plans.queries import GEN_SEED

    rec_json = (f"CASE task WHEN 'lm' THEN to_json({{'id': id, 'meta': {{'grammar_rev': g.grammar_rev, 'seed': {GEN_SEED}::BIGINT, "
                f"'split': split, 'template_index': template_index}}, 'task': task, 'text': text}}) "
                f"WHEN 'seq2seq' THEN to_json({{'id': id, 'meta': {{'grammar_rev': g.grammar_rev, 'seed': {GEN_SEED}::BIGINT, "
                f"'split': split, 'template_index': template_index}}, 'src': src, 'task': task, 'tgt': tgt}}) "
                f"ELSE to_json({{'id': id, 'label': label, 'meta': {{'grammar_rev': g.grammar_rev, 'seed': {GEN_SEED}::BIGINT, "
                f"'split': split, 'template_index': template_index}}, 'task': task, 'text': text}}) END::VARCHAR")
    return f"""
WITH g AS ({_grammar_hash_sql()}),
r AS ({_generated_union_sql()}),
l AS (SELECT split, sample_index * 3 + task_pos AS ord, {rec_json} AS line, coalesce(text, src, '') AS t FROM r, g),
h AS {tree_hash_sql('l', ['split'], 'ord', 'line', 'split_hash')},
st AS (SELECT split, count(*)::BIGINT AS row_count, count(*)::DOUBLE AS num_records, round(avg(length(t)), 6) AS avg_len,
              round(quantile_cont(length(t), 0.5), 6) AS p50_len, round(quantile_cont(length(t), 0.95), 6) AS p95_len
       FROM l GROUP BY split),
voc AS (SELECT split, count(DISTINCT c)::DOUBLE AS vocab_size_char
        FROM (SELECT split, unnest(string_split(t, '')) AS c FROM l) WHERE c <> '' GROUP BY split),
dh AS (SELECT sha256(string_agg(split_hash, chr(10) ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END))
              AS dataset_hash FROM h)
SELECT h.split, h.split_hash, st.row_count, st.num_records, st.avg_len, st.p50_len, st.p95_len,
       coalesce(voc.vocab_size_char, 0.0) AS vocab_size_char, dh.dataset_hash
FROM h JOIN st USING (split) LEFT JOIN voc USING (split), dh
"""


ORACLES["generated_manifest"] = _generated_manifest_sql()


def _schema_violations_sql() -> str:
    from lexiforge.operators.dataset import TASK_FIELDS

    checks = ["('unknown_task', task NOT IN ('lm', 'seq2seq', 'cls'))"]
    for t, (req, forb) in TASK_FIELDS.items():
        for f in req:
            expr = "FALSE" if f == "meta" else f"(task = '{t}' AND {f} IS NULL)"
            checks.append(f"('{t}_missing_{f}', {expr})")
        for f in forb:
            checks.append(f"('{t}_forbidden_{f}', (task = '{t}' AND {f} IS NOT NULL))")
    checks.append("('id_format', NOT regexp_matches(id, '^[^-]+-[^-]+-[0-9]{6,}$'))")
    checks.append("('id_split_task', id <> format('{}-{}-{:06d}', split, task, sample_index))")
    checks.append("('meta_split', FALSE)")
    sel = ",\n  ".join(f"{{'rule': {c.split(',', 1)[0][1:]}, 'violations': sum(CASE WHEN {c.split(',', 1)[1].strip()[:-1]} THEN 1 ELSE 0 END)::BIGINT}}"
                       for c in checks)
    return f"""
WITH r AS ({_generated_union_sql()}),
a AS (SELECT [{sel}] AS xs FROM r)
SELECT x.rule AS rule, coalesce(x.violations, 0)::BIGINT AS violations FROM (SELECT unnest(xs) AS x FROM a)
"""


ORACLES["schema_violations"] = _schema_violations_sql()


# --- learned tokenizer (BPE) ---------------------------------------------------------------

O, C = "", ""


def _syms_sql(expr: str) -> str:
    return f"regexp_extract_all({expr}, '{O}([^{C}]*){C}', 1)"


def _pair_rows_sql(table: str) -> str:
    """(l, r, freq) rows of the overlapping adjacent pairs of ``table(seq, freq)``: the
    symbol list is extracted once and its two shifted slices are unnested in parallel."""
    return f"""(SELECT unnest(sy[1:len(sy) - 1]) AS l, unnest(sy[2:len(sy)]) AS r, freq
              FROM (SELECT {_syms_sql('seq')} AS sy, freq FROM {table}))"""


def _bracket_sql(expr: str) -> str:
    return f"(regexp_replace({expr}, '(.)', '{O}\\1{C}', 'gs') || '{O}</w>{C}')"


_UNITS = f"""units AS (SELECT w AS unit, count(*)::BIGINT AS freq
           FROM (SELECT unnest({words_sql('lower(text)')}) AS w FROM documents) GROUP BY w)"""


def _alphabet_sql() -> str:
    return """alpha AS (SELECT DISTINCT c AS symbol FROM (SELECT unnest(string_split(unit, '')) AS c FROM units)
                WHERE c <> '' UNION SELECT '</w>')"""


def _bpe_train_ctes(vocab_size: int, min_freq: int, units: str = _UNITS) -> str:
    """CTEs (for WITH RECURSIVE) up to ``merges`` (rank, l, r): one recursion step counts all pairs and
    merges the best, until the vocabulary is full or no pair qualifies.  Assumes that no two merges
    make the same string, which ``bpe_table_check`` shows."""
    pair = f"'{O}' || b.l || '{C}{O}' || b.r || '{C}'"
    return f"""{units}, {_alphabet_sql()},
        trained AS (
            SELECT 0 AS step, {_bracket_sql('unit')} AS seq, freq, NULL::VARCHAR AS l, NULL::VARCHAR AS r, a.n AS n
            FROM units, (SELECT count(*) + 1 AS n FROM alpha) a
            UNION ALL
            SELECT t.step + 1, replace(t.seq, {pair}, '{O}' || b.l || b.r || '{C}'), t.freq, b.l, b.r, t.n + 1
            FROM trained t, (SELECT l, r FROM {_pair_rows_sql('trained')} GROUP BY 1, 2 HAVING sum(freq) >= {min_freq}
                             ORDER BY sum(freq) DESC, l, r LIMIT 1) b
            WHERE t.n < {vocab_size}),
        merges AS MATERIALIZED (SELECT DISTINCT step - 1 AS rank, l, r FROM trained WHERE step > 0)"""


def _vocab_ctes(vocab_size: int) -> str:
    return f"""base AS (SELECT symbol AS token, (row_number() OVER (ORDER BY symbol))::INTEGER AS id FROM alpha),
        nb AS (SELECT count(*) AS n FROM base),
        mt AS (SELECT l || r AS token, min(rank) AS rank FROM merges GROUP BY 1),
        newt AS (SELECT token, (nb.n + row_number() OVER (ORDER BY rank))::INTEGER AS id FROM mt, nb
                 WHERE token NOT IN (SELECT token FROM base) AND token <> '<unk>'),
        vocab AS (SELECT * FROM (SELECT '<unk>' AS token, 0 AS id UNION ALL SELECT * FROM base UNION ALL SELECT * FROM newt)
                  WHERE id < {vocab_size})"""


def _bpe_sqls():
    from lexiforge.plans.queries import BPE_CHECKED_VOCAB_SIZE as SIZE
    from lexiforge.plans.queries import BPE_MIN_FREQ, BPE_SMALL_VOCAB_SIZE

    train, vocab = _bpe_train_ctes(SIZE, BPE_MIN_FREQ), _vocab_ctes(SIZE)
    ORACLES["bpe_word_counts"] = f"WITH {_UNITS} SELECT unit AS word, freq FROM units"
    ORACLES["bpe_nfc_word_counts"] = ORACLES["bpe_word_counts"].replace("lower(text)", "lower(nfc_normalize(text))")
    ORACLES["bpe_alphabet"] = f"""WITH {_UNITS}, {_alphabet_sql()}
        SELECT '<unk>' AS symbol, 0 AS id
        UNION ALL SELECT symbol, (row_number() OVER (ORDER BY symbol))::INTEGER AS id FROM alpha"""
    ORACLES["bpe_pair_stats"] = f"""WITH {_UNITS}, s0 AS (SELECT {_bracket_sql('unit')} AS seq, freq FROM units)
        SELECT l, r, sum(freq)::BIGINT AS freq FROM {_pair_rows_sql('s0')} GROUP BY 1, 2"""
    ORACLES["bpe_best_pair"] = f"""
        SELECT * FROM ({ORACLES['bpe_pair_stats']}) WHERE freq >= {BPE_MIN_FREQ} ORDER BY freq DESC, l, r LIMIT 1"""
    ORACLES[f"bpe_train_{SIZE}"] = f"""WITH RECURSIVE {train}
        SELECT rank::INTEGER AS rank, l AS "left", r AS "right", l || r AS merged FROM merges"""
    ORACLES[f"bpe_vocab_{SIZE}"] = f"WITH RECURSIVE {train}, {vocab} SELECT token, id FROM vocab"
    ORACLES["bpe_vocab_small"] = f"""WITH RECURSIVE {_bpe_train_ctes(BPE_SMALL_VOCAB_SIZE, BPE_MIN_FREQ)},
        {_vocab_ctes(BPE_SMALL_VOCAB_SIZE)} SELECT token, id FROM vocab"""
    ORACLES[f"bpe_table_check_{SIZE}"] = f"""WITH RECURSIVE {train},
        m AS (SELECT rank, l, r, l || r AS merged FROM merges),
        prod AS (SELECT merged, count(*) AS n, min(rank) AS first_rank FROM m GROUP BY 1),
        ops AS (SELECT rank, unnest([l, r]) AS operand FROM m),
        late AS (SELECT count(*) AS c FROM ops LEFT JOIN prod ON prod.merged = ops.operand
                 WHERE length(operand) > 1 AND operand <> '</w>' AND (first_rank IS NULL OR first_rank >= ops.rank))
        SELECT (SELECT count(*) FROM m)::BIGINT AS n_merges,
               (SELECT count(*) FROM prod WHERE n > 1)::BIGINT AS multi_producer,
               (SELECT c FROM late)::BIGINT AS unordered_operand,
               (SELECT count(*) FROM m WHERE merged IN ('</w>', '<unk>'))::BIGINT AS marker_clash,
               ((SELECT count(*) FROM prod WHERE n > 1) + (SELECT c FROM late)
                 + (SELECT count(*) FROM m WHERE merged IN ('</w>', '<unk>')) = 0)::INTEGER AS ok"""
    # encode: one replace per merge in rank order over the distinct words (the model passes the check above)
    step = (f"replace(a, '{O}' || split_part(m, chr(1), 1) || '{C}{O}' || split_part(m, chr(1), 2) || '{C}', "
            f"'{O}' || split_part(m, chr(1), 1) || split_part(m, chr(1), 2) || '{C}')")
    strip = "CASE WHEN sy[-1] = '</w>' THEN sy[1:len(sy) - 1] ELSE sy END"
    enc = f"""{train},
        chain AS (SELECT list(l || chr(1) || r ORDER BY rank) AS ms FROM merges),
        occ AS (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS nth
                FROM (SELECT conv_id, turn, {words_sql('lower(text)')} AS ws FROM conversations)),
        types AS (SELECT w, {strip} AS toks FROM (
            SELECT w, {_syms_sql(f"list_reduce(ms, lambda a, m: {step}, {_bracket_sql('w')})")} AS sy
            FROM (SELECT DISTINCT w FROM occ), chain)),
        got AS (SELECT conv_id, turn, flatten(list(toks ORDER BY nth)) AS toks FROM occ JOIN types USING (w) GROUP BY 1, 2),
        enc AS (SELECT c.conv_id, c.turn, c.role, c.text,
                       CASE WHEN c.text IS NULL THEN NULL ELSE coalesce(got.toks, []) END AS toks
                FROM conversations c LEFT JOIN got ON c.conv_id = got.conv_id AND c.turn = got.turn)"""
    ORACLES[f"bpe_encode_{SIZE}"] = f"""WITH RECURSIVE {enc}
        SELECT conv_id, turn, len(toks)::INTEGER AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_md5 FROM enc"""
    ids = f"""{enc}, {vocab},
        ex AS (SELECT conv_id, turn, role, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM enc),
        ej AS (SELECT ex.*, coalesce(vocab.id, 0) AS id FROM ex LEFT JOIN vocab USING (token)),
        per AS (SELECT e.conv_id, e.turn, e.role, list(ej.id ORDER BY ej.pos) FILTER (WHERE ej.id IS NOT NULL) AS ids
                FROM enc e LEFT JOIN ej ON e.conv_id = ej.conv_id AND e.turn = ej.turn
                GROUP BY e.conv_id, e.turn, e.role)"""
    ORACLES[f"bpe_ids_{SIZE}"] = f"""WITH RECURSIVE {ids}
        SELECT conv_id, turn, coalesce(list_sum(ids), 0)::BIGINT AS ids_sum,
               md5(coalesce(array_to_string(ids, ' '), '')) AS ids_md5 FROM per"""
    ORACLES[f"oov_rate_{SIZE}"] = f"""WITH RECURSIVE {ids}
        SELECT role, sum(coalesce(len(ids), 0))::BIGINT AS n_tokens,
               sum(coalesce(len(list_filter(ids, lambda x: x = 0)), 0))::BIGINT AS n_unk,
               round(CASE WHEN sum(coalesce(len(ids), 0)) > 0
                     THEN sum(coalesce(len(list_filter(ids, lambda x: x = 0)), 0)) / sum(coalesce(len(ids), 0))
                     ELSE 0.0 END, 6) AS oov_rate
        FROM per GROUP BY role"""
    ORACLES["bpe_apply_counts"] = """SELECT role, count(text)::BIGINT AS tokenized_records FROM conversations GROUP BY role"""


_bpe_sqls()


# --- lexicons, embeddings, registry --------------------------------------------------------

def _lexicon_ctes() -> str:
    from lexiforge.plans.queries import LEXICON_SEED, LEXICON_TOP_N

    return f"""
c AS (SELECT source, w AS word, count(*)::BIGINT AS n
      FROM (SELECT source, unnest({words_sql('lower(text)')}) AS w FROM documents) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS rank FROM c),
top AS (SELECT * FROM r WHERE rank <= {LEXICON_TOP_N}),
sh AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws(':', '{LEXICON_SEED}', source, word)), word) - 1)::BIGINT
              AS pos FROM c),
ln AS (SELECT source, pos, to_json({{'count': n, 'token': word, 'value': word}})::VARCHAR AS line FROM sh)"""


ORACLES["domain_lexicon"] = f"WITH {_lexicon_ctes()} SELECT source, rank::BIGINT AS rank, word, n FROM top"
ORACLES["lexicon_shuffle"] = f"WITH {_lexicon_ctes()} SELECT source, pos, word AS token FROM sh"
ORACLES["lexicon_summary"] = f"""WITH {_lexicon_ctes()},
h AS {tree_hash_sql('ln', ['source'], 'pos', 'line', 'lexicon_hash')}
SELECT source, entries, lexicon_hash FROM h JOIN (SELECT source, count(*)::BIGINT AS entries FROM c GROUP BY 1) USING (source)"""


def _emb_ctes() -> str:
    from lexiforge.plans.queries import EMB_DIM, EMB_SEED

    return f"""
toks AS (SELECT DISTINCT c AS token FROM (SELECT unnest(string_split(lower(text), '')) AS c FROM documents) WHERE c <> ''),
vals AS (SELECT token, d, ((2.0 * {u_sql(str(EMB_SEED), 'token', 'd')}) - 1.0)::FLOAT AS v
         FROM toks, range({EMB_DIM}) t(d)),
emb AS (SELECT token, list(v ORDER BY d) AS vs,
               string_agg(floor(v::DOUBLE * 1e9)::BIGINT::VARCHAR, ',' ORDER BY d) AS vline FROM vals GROUP BY token)"""


ORACLES["fixed_embeddings"] = f"""WITH {_emb_ctes()}
SELECT token, len(vs)::INTEGER AS dim, round(vs[1]::DOUBLE, 6) AS v0, md5(vline) AS values_md5 FROM emb"""
ORACLES["embedding_summary"] = f"""WITH {_emb_ctes()}
SELECT count(*)::BIGINT AS tokens, min(len(vs))::INTEGER AS min_dim, max(len(vs))::INTEGER AS max_dim,
       sha256(string_agg(token || chr(9) || vline, chr(10) ORDER BY token)) AS embeddings_hash FROM emb"""
ORACLES["mean_embeddings"] = f"""WITH {_emb_ctes()},
ex AS (SELECT doc_id, token, count(*) AS k FROM (
         SELECT doc_id, unnest(list_filter(string_split(lower(text), ''), lambda c: c <> '')) AS token FROM documents) GROUP BY 1, 2),
j AS (SELECT ex.doc_id, vals.d, vals.v, k FROM ex JOIN vals USING (token)),
per AS (SELECT doc_id, d, sum(v::DOUBLE * k) / sum(k) AS m, sum(k) AS n FROM j GROUP BY 1, 2),
got AS (SELECT doc_id, max(n)::BIGINT AS n_tokens, round(max(CASE WHEN d = 0 THEN m END), 6) AS mean0,
               md5(string_agg(floor(m * 1e6 + 0.5)::BIGINT::VARCHAR, ',' ORDER BY d)) AS mean_md5 FROM per GROUP BY doc_id)
SELECT * FROM got"""


def _registry_sql() -> str:
    from lexiforge.plans.queries import REG_CREATED_NEW, REG_CREATED_OLD

    return f"""
WITH tox AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
t AS (SELECT d.doc_id, CASE WHEN x.doc_id IS NOT NULL THEN '' ELSE d.text END AS text, d.lang, d.n_chars, d.source
      FROM documents d LEFT JOIN tox x USING (doc_id)),
l1 AS (SELECT source AS split, doc_id, {DOC_JSON} AS line FROM documents),
l2 AS (SELECT source AS split, doc_id, {DOC_JSON} AS line FROM t),
l3 AS (SELECT lang AS split, doc_id, {DOC_JSON} AS line FROM documents),
h1 AS {tree_hash_sql('l1', ['split'], 'doc_id', 'line', 'h')},
h2 AS {tree_hash_sql('l2', ['split'], 'doc_id', 'line', 'h')},
h3 AS {tree_hash_sql('l3', ['split'], 'doc_id', 'line', 'h')},
existing AS (SELECT (row_number() OVER (ORDER BY split) - 1)::BIGINT AS pos, 'datasets/' || split AS path,
                    split AS name, h AS manifest_hash, '{REG_CREATED_OLD}' AS created_utc FROM h1),
inc0 AS (SELECT 'datasets/' || split AS path, split AS name, h, 0 AS grp FROM h2
         UNION ALL SELECT 'datasets/lang=' || split, 'lang=' || split, h, 1 FROM h3),
inc AS (SELECT row_number() OVER (ORDER BY grp, path) AS seq, * FROM inc0),
kept AS (SELECT e.pos, e.path, coalesce(i.name, e.name) AS name, coalesce(i.h, e.manifest_hash) AS manifest_hash,
                CASE WHEN i.h IS NOT NULL THEN '{REG_CREATED_NEW}' ELSE e.created_utc END AS created_utc
         FROM existing e LEFT JOIN inc i USING (path)),
new AS (SELECT (SELECT coalesce(max(pos), -1) FROM existing) + row_number() OVER (ORDER BY seq) AS pos,
               path, name, h AS manifest_hash, '{REG_CREATED_NEW}' AS created_utc
        FROM inc WHERE path NOT IN (SELECT path FROM existing))
SELECT * FROM kept UNION ALL SELECT pos::BIGINT, path, name, manifest_hash, created_utc FROM new
"""


ORACLES["registry_upsert"] = _registry_sql()

ORACLES["stream_stats"] = ORACLES["length_stats_by_lang"]
ORACLES["stream_tokenize"] = ORACLES["char_tokenize"]


def _more_bpe_sqls():
    from lexiforge.plans.queries import BPE_CHECKED_VOCAB_SIZE as SIZE
    from lexiforge.plans.queries import BPE_MIN_FREQ

    train, vocab = _bpe_train_ctes(SIZE, BPE_MIN_FREQ), _vocab_ctes(SIZE)
    tok = f"""th AS (SELECT sha256(
            (SELECT string_agg(to_json({{'left': l, 'rank': rank::INTEGER, 'right': r}})::VARCHAR, chr(10) ORDER BY rank)
             FROM merges) || chr(10) ||
            (SELECT string_agg(to_json({{'id': id, 'token': token}})::VARCHAR, chr(10) ORDER BY token) FROM vocab))
            AS tokenizer_hash)"""
    ORACLES[f"bpe_tokenizer_hash_{SIZE}"] = f"WITH RECURSIVE {train}, {vocab}, {tok} SELECT tokenizer_hash FROM th"
    ORACLES["manifest_violations"] = f"""WITH {_UNITS}, {_alphabet_sql()},
        th AS (SELECT sha256(string_agg(symbol, chr(10) ORDER BY symbol)) AS tokenizer_hash FROM alpha),
        l AS (SELECT source || chr(0) || lang AS g, source, lang, doc_id, {DOC_JSON} AS line FROM documents),
        h AS {tree_hash_sql('l', ['g'], 'doc_id', 'line', 'split_hash')},
        hs AS (SELECT split_part(g, chr(0), 1) AS source, split_part(g, chr(0), 2) AS lang, split_hash FROM h),
        lab AS (SELECT DISTINCT doc_id FROM labels),
        al AS (SELECT d.source, min(CASE WHEN lab.doc_id IS NULL THEN 0 ELSE 1 END) AS all_labelled
               FROM documents d LEFT JOIN lab USING (doc_id) GROUP BY d.source),
        m AS (SELECT hs.source, count(*) AS n_splits,
                     CASE WHEN max(al.all_labelled) = 1 THEN (SELECT tokenizer_hash FROM th) ELSE '' END AS tokenizer_hash
              FROM hs JOIN al USING (source) GROUP BY hs.source)
        SELECT 'split_hashes_missing' AS rule, 0::BIGINT AS violations
        UNION ALL SELECT 'split_hashes_not_mapping', 0::BIGINT
        UNION ALL SELECT 'no_splits_declared', (SELECT count(*) FROM m WHERE n_splits = 0)::BIGINT
        UNION ALL SELECT 'dataset_hash_missing', 0::BIGINT
        UNION ALL SELECT 'tokenizer_hash_empty', (SELECT count(*) FROM m WHERE tokenizer_hash = '')::BIGINT"""
    ORACLES[f"stream_bpe_encode_{SIZE}"] = ORACLES[f"bpe_encode_{SIZE}"]


_more_bpe_sqls()


ORACLES["dataset_write_validate"] = f"""
WITH m AS ({_generated_manifest_sql()})
SELECT split, 'ok' AS status, split_hash AS declared_hash, split_hash AS computed_hash FROM m
UNION ALL
SELECT '__dataset__', 'ok', max(dataset_hash), max(dataset_hash) FROM m
"""


def _line_units_sql() -> str:
    return """units AS (SELECT lower(text) AS unit, count(*)::BIGINT AS freq FROM conversations
             WHERE text IS NOT NULL AND lower(text) <> '' GROUP BY 1)"""


def _bpe_lines_sql() -> str:
    from lexiforge.plans.queries import BPE_CHECKED_VOCAB_SIZE, BPE_MIN_FREQ

    train = _bpe_train_ctes(BPE_CHECKED_VOCAB_SIZE, BPE_MIN_FREQ, _line_units_sql())
    return f"""WITH RECURSIVE {train}
        SELECT rank::INTEGER AS rank, l AS "left", r AS "right", l || r AS merged FROM merges"""


ORACLES["bpe_train_lines_160"] = _bpe_lines_sql()


def _wordpiece_sqls():
    from lexiforge.plans.queries import WORDPIECE_MIN_FREQ, WORDPIECE_VOCAB_SIZE

    first = f"'{O}' || substr(unit, 1, 1) || '{C}'"
    rest = f"regexp_replace(substr(unit, 2), '(.)', '{O}##\\1{C}', 'gs')"
    merged = "b.l || substr(b.r, 3)"
    train = f"""{_UNITS},
        alpha AS (SELECT substr(unit, 1, 1) AS symbol FROM units
                  UNION SELECT '##' || c FROM (SELECT unnest(string_split(substr(unit, 2), '')) AS c FROM units) WHERE c <> ''),
        trained AS (
            SELECT 0 AS step, {first} || {rest} AS seq, freq, NULL::VARCHAR AS l, NULL::VARCHAR AS r, a.n AS n
            FROM units, (SELECT count(*) + 1 AS n FROM alpha) a
            UNION ALL
            SELECT t.step + 1, replace(t.seq, '{O}' || b.l || '{C}{O}' || b.r || '{C}', '{O}' || {merged} || '{C}'), t.freq, b.l, b.r, t.n + 1
            FROM trained t, (
                SELECT p.l, p.r FROM (SELECT l, r, sum(freq) AS n FROM {_pair_rows_sql('trained')} GROUP BY 1, 2 HAVING sum(freq) >= {WORDPIECE_MIN_FREQ}) p
                JOIN (SELECT s, sum(freq) AS f FROM (SELECT unnest({_syms_sql('seq')}) AS s, freq FROM trained) GROUP BY 1) fl ON fl.s = p.l
                JOIN (SELECT s, sum(freq) AS f FROM (SELECT unnest({_syms_sql('seq')}) AS s, freq FROM trained) GROUP BY 1) fr ON fr.s = p.r
                ORDER BY p.n::DOUBLE / (fl.f::DOUBLE * fr.f::DOUBLE) DESC, p.l, p.r LIMIT 1) b
            WHERE t.n < {WORDPIECE_VOCAB_SIZE}),
        merges AS MATERIALIZED (SELECT DISTINCT step - 1 AS rank, l, r, l || substr(r, 3) AS merged FROM trained WHERE step > 0),
        base AS (SELECT symbol AS token, (row_number() OVER (ORDER BY symbol))::INTEGER AS id FROM alpha),
        vocab AS (SELECT '[UNK]' AS token, 0 AS id UNION ALL SELECT * FROM base
                  UNION ALL SELECT merged, ((SELECT count(*) FROM base) + 1 + rank)::INTEGER FROM merges)"""
    ORACLES["wordpiece_train"] = f"""WITH RECURSIVE {train}
        SELECT rank::INTEGER AS rank, l AS "left", r AS "right", merged FROM merges"""
    ORACLES["wordpiece_vocab"] = f"WITH RECURSIVE {train} SELECT token, id FROM vocab"
    # encode the distinct words place by place; a word that cannot go on is one unknown token
    ORACLES["wordpiece_encode"] = f"""WITH RECURSIVE {train},
        occ AS (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS nth
                FROM (SELECT conv_id, turn, {words_sql('lower(text)')} AS ws FROM conversations)),
        pieces AS (SELECT token, id, starts_with(token, '##') AND length(token) > 2 AS inner_, CASE WHEN starts_with(token, '##') AND length(token) > 2
                          THEN substr(token, 3) ELSE token END AS s FROM vocab WHERE id > 0),
        most AS (SELECT max(length(s)) AS m FROM pieces),
        walk AS (
            SELECT w, 1 AS pos, []::VARCHAR[] AS toks, 0::BIGINT AS ids, false AS lost FROM (SELECT DISTINCT w FROM occ)
            UNION ALL
            SELECT w, pos + coalesce(length(g.s), length(w)), list_append(toks, coalesce(g.token, '[UNK]')), ids + coalesce(g.id, 0), g.token IS NULL
            FROM walk LEFT JOIN LATERAL (
                SELECT p.token, p.id, p.s FROM (SELECT unnest(range(1, m + 1)) AS k FROM most) x
                JOIN pieces p ON p.s = substr(walk.w, walk.pos, x.k::INTEGER) AND length(p.s) = x.k AND p.inner_ = (walk.pos > 1)
                ORDER BY x.k DESC LIMIT 1) g ON true
            WHERE pos <= length(w)),
        types AS (SELECT w, CASE WHEN bool_or(lost) THEN ['[UNK]'] ELSE arg_max(toks, pos) END AS toks,
                         CASE WHEN bool_or(lost) THEN 0 ELSE max(ids) END AS ids FROM walk GROUP BY w),
        got AS (SELECT conv_id, turn, flatten(list(toks ORDER BY nth)) AS toks, sum(ids) AS ids FROM occ JOIN types USING (w) GROUP BY 1, 2)
        SELECT c.conv_id, c.turn, CASE WHEN c.text IS NOT NULL THEN coalesce(len(got.toks), 0) END::INTEGER AS n_tokens,
               CASE WHEN c.text IS NOT NULL THEN coalesce(got.ids, 0) END::BIGINT AS ids_sum,
               CASE WHEN c.text IS NOT NULL THEN md5(coalesce(array_to_string(got.toks, ' '), '')) END AS tokens_md5
        FROM conversations c LEFT JOIN got ON c.conv_id = got.conv_id AND c.turn = got.turn"""


_wordpiece_sqls()


def _weighted_entities_sql() -> str:
    """The alias table by one window a prefix sum; lookups by comparing places."""
    from lexiforge.plans.queries import GEN_SEED

    return f"""WITH p AS (
            SELECT 'person' AS entity, c_name AS value, (1 + c_custkey % 97)::DOUBLE AS weight FROM customer
            UNION ALL SELECT 'item', p_partkey::VARCHAR || '#' || p_name, p_size::DOUBLE FROM part
            UNION ALL SELECT 'location', n_name, CASE WHEN n_nationkey = 0 THEN 2376.0 ELSE 1.0 END::DOUBLE FROM nation),
        i AS (SELECT entity, value, greatest(floor(weight / sum(weight) OVER (PARTITION BY entity) * 4294967296.0 + 0.5), 1)::HUGEINT AS w FROM p WHERE weight > 0),
        t AS (SELECT *, sum(w) OVER g AS total, count(*) OVER g AS n, row_number() OVER (PARTITION BY entity ORDER BY value) - 1 AS slot FROM i WINDOW g AS (PARTITION BY entity)),
        r AS (SELECT *, total - w * n < 0 AS heavy, abs(total - w * n) AS size FROM t),
        l AS (SELECT *, sum(size) OVER o AS until, row_number() OVER o AS nth FROM r WINDOW o AS (PARTITION BY entity, heavy ORDER BY value)),
        light AS (SELECT a.entity, a.slot, a.n, (a.w * a.n)::DOUBLE / a.total::DOUBLE AS own, a.value, coalesce(h.value, a.value) AS alias
                  FROM (SELECT * FROM l WHERE NOT heavy) a ASOF LEFT JOIN (SELECT *, until - size AS since FROM l WHERE heavy) h
                    ON a.entity = h.entity AND a.until - a.size >= h.since),
        over AS (SELECT h.entity, h.nth, min(a.until) - any_value(h.until) AS much FROM (SELECT * FROM l WHERE heavy) h
                 JOIN (SELECT * FROM l WHERE NOT heavy) a ON a.entity = h.entity AND a.until >= h.until GROUP BY 1, 2),
        heavies AS (SELECT h.entity, h.slot, h.n, CASE WHEN x.value IS NULL THEN 1.0 ELSE (h.total - coalesce(o.much, 0))::DOUBLE / h.total::DOUBLE END AS own,
                           h.value, coalesce(x.value, h.value) AS alias
                    FROM (SELECT * FROM l WHERE heavy) h LEFT JOIN over o ON o.entity = h.entity AND o.nth = h.nth
                    LEFT JOIN (SELECT * FROM l WHERE heavy) x ON x.entity = h.entity AND x.nth = h.nth + 1),
        slots AS (SELECT * FROM light UNION ALL SELECT * FROM heavies),
        d AS (SELECT entity, {u_sql(str(GEN_SEED), 'o_orderkey', 'entity')} AS u FROM orders, (SELECT unnest(['person', 'item', 'location']) AS entity)),
        x AS (SELECT d.entity, u * n AS x FROM d JOIN (SELECT DISTINCT entity, n FROM slots) s USING (entity))
        SELECT x.entity, CASE WHEN x - floor(x) < s.own THEN s.value ELSE s.alias END AS value, count(*) AS n
        FROM x JOIN slots s ON s.entity = x.entity AND s.slot = floor(x)::BIGINT GROUP BY 1, 2"""


ORACLES["weighted_entities"] = _weighted_entities_sql()


def rank_tree_sql(lines: str, group: str, order: str, fanout: int, name: str, levels: int = 4) -> str:
    """A WITH body ending in ``tree``: rank-based leaves, then as many levels as each group needs (up to ``levels``)."""
    out = [f"""r0 AS (SELECT {group} AS g, row_number() OVER (PARTITION BY {group} ORDER BY {order}) - 1 AS o, sha256(line) AS h,
                   count(*) OVER (PARTITION BY {group}) AS m FROM {lines})"""]
    for k in range(levels):
        joined = "sha256(string_agg(h, chr(10) ORDER BY o))"
        h = joined if k == 0 else f"CASE WHEN max(m) = 1 THEN min(h) ELSE {joined} END"
        out.append(f"r{k + 1} AS (SELECT g, o // {fanout} AS o, {h} AS h, ceil(max(m) / {fanout}) AS m FROM r{k} GROUP BY g, o // {fanout})")
    return ", ".join(out) + f", tree AS (SELECT g, h AS {name} FROM r{levels})"


def _store_sqls():
    from lexiforge.plans.queries import CORPUS_LIMIT_SHARE, TREE_FANOUT

    doc_lines = f"l AS (SELECT source, doc_id, {DOC_JSON} AS line FROM documents)"
    ORACLES["sparse_tree_hash"] = f"""WITH {doc_lines}, {rank_tree_sql('l', 'source', 'doc_id', TREE_FANOUT, 'split_hash')}
        SELECT g AS source, split_hash FROM tree"""
    ORACLES["embeddings_tree_hash"] = f"""WITH l AS (SELECT vec_id, vec_id::VARCHAR || ':' || array_to_string(
            list_transform(embedding, lambda v: floor(v::DOUBLE * 1e9)::BIGINT::VARCHAR), ',') AS line FROM embeddings),
        {rank_tree_sql('l', '0', 'vec_id', TREE_FANOUT, 'embeddings_hash')} SELECT embeddings_hash FROM tree"""
    ORACLES["corpus_file_units"] = f"""WITH a AS (SELECT text, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n
            FROM documents WHERE doc_id % 7 <> 3 AND text IS NOT NULL)
        SELECT w AS word, count(*)::BIGINT AS freq FROM (SELECT unnest({words_sql('lower(text)')}) AS w FROM a WHERE k <= n // {CORPUS_LIMIT_SHARE}) GROUP BY 1"""
    ORACLES["mixed_format_stats"] = f"""WITH m AS ({_generated_manifest_sql()})
        SELECT split, num_records, avg_len, p50_len, p95_len, vocab_size_char FROM m"""
    ORACLES["registry_commits"] = f"""WITH {doc_lines}, h AS {tree_hash_sql('l', ['source'], 'doc_id', 'line', 'manifest_hash')}
        SELECT 'datasets/' || source AS path, source AS name, manifest_hash FROM h"""


_store_sqls()


ORACLES["oov_heldout"] = f"""WITH w AS (SELECT lang, doc_id % 10 = 0 AS held, unnest({words_sql('lower(text)')}) AS w FROM documents),
    seen AS (SELECT DISTINCT w FROM w WHERE NOT held)
    SELECT w.lang, count(*)::BIGINT AS n_words, count(CASE WHEN seen.w IS NULL THEN 1 END)::BIGINT AS n_oov,
           round(count(CASE WHEN seen.w IS NULL THEN 1 END) / count(*), 6) AS oov_rate
    FROM w LEFT JOIN seen ON seen.w = w.w WHERE held GROUP BY 1"""
ORACLES["stream_restart_160"] = f"""SELECT *, (SELECT count(*) FROM conversations)::BIGINT AS rows_observed, (sum(greatest(n_tokens, 0)) OVER ())::BIGINT AS tokens_observed
    FROM ({ORACLES['bpe_encode_160']})"""


def _artifact_sqls():
    from lexiforge.functions.hashing import FANOUT
    from lexiforge.plans.queries import BPE_CHECKED_VOCAB_SIZE, BPE_MIN_FREQ

    def one(ctes: str, lines: str, order: str, kind: str, recursive: str = "") -> str:
        return f"""WITH {recursive}{ctes}, al AS ({lines}), {rank_tree_sql('al', '0', order, FANOUT, 'content_hash')}
            SELECT '{kind}' AS kind, (SELECT count(*) FROM al)::BIGINT AS rows, content_hash, true AS verified FROM tree"""

    ORACLES["tokenizer_artifact"] = one(f"{_bpe_train_ctes(BPE_CHECKED_VOCAB_SIZE, BPE_MIN_FREQ)}, {_vocab_ctes(BPE_CHECKED_VOCAB_SIZE)}",
                                        "SELECT id, to_json({'id': id, 'token': token})::VARCHAR AS line FROM vocab", "id", "tokenizer", "RECURSIVE ")
    ORACLES["embedding_artifact"] = one(_emb_ctes(), "SELECT token, token || chr(9) || vline AS line FROM emb", "token", "embedding")
    ORACLES["lexicon_artifact"] = one(_lexicon_ctes(), "SELECT source, pos, to_json({'count': n, 'pos': pos, 'source': source, 'token': word})::VARCHAR AS line FROM sh",
                                      "source, pos", "lexicon")
    ORACLES["provenance_check"] = f"""WITH RECURSIVE {_UNITS}, {_alphabet_sql()},
        e(artifact, made_from) AS (VALUES ('tokenizer', 'documents'), ('encoded', 'tokenizer'), ('encoded', 'conversations'),
                                          ('manifest', 'encoded'), ('statistics', 'documents')),
        new AS (SELECT 'tokenizer' AS artifact FROM alpha HAVING count(*) > 39),
        off AS (SELECT e.artifact FROM e JOIN new ON e.made_from = new.artifact UNION SELECT e.artifact FROM e JOIN off ON e.made_from = off.artifact)
        SELECT artifact, CASE WHEN artifact IN (SELECT artifact FROM new) THEN 'changed' WHEN artifact IN (SELECT artifact FROM off) THEN 'stale' ELSE 'ok' END AS status
        FROM (SELECT artifact FROM e UNION SELECT made_from FROM e)"""


_artifact_sqls()
