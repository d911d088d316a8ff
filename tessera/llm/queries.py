"""The operators' queries with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.shared import table


def op1_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.telephony import telephony_digest

    return telephony_digest(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.url_filter import judge

    rules = spark.sql(f"SELECT * FROM VALUES {RULES} AS r(host, path, action)")
    return judge(table(spark, sf_dir, "pages"), rules)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substring_dedup import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tessera.llm.mixing import mix_documents

    return mix_documents(table(spark, sf_dir, "documents")).withColumn("mix_rate", F.round("mix_rate", 6))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import learn, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontamination import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.chat import conversation_digest, format_turns

    said = "<|im_end|><|im_start|>assistant ok"
    probe = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_digest(format_turns(turns.unionByName(probe)))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.minhash import Likeness, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), Likeness(size=3, percent=85))


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_files import token_digest

    return token_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_lm_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffix_tree import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


RULES = "('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')"

_OP2_SQL = rf"""
WITH cut AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rhost, rpath, action) AS (VALUES {RULES}),
numbered AS (SELECT row_number() OVER () AS k, * FROM cut),
best AS (
  SELECT k, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM numbered JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM numbered LEFT JOIN best USING (k)
"""

_OP4_SQL = """
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weighed AS (SELECT *, pow(n::DOUBLE, 0.7) AS w FROM sizes),
rates AS (SELECT source, 1.0::DOUBLE * (SELECT sum(n) FROM sizes)::DOUBLE * w / (SELECT sum(w) FROM weighed) / n AS rate FROM weighed),
ks AS (SELECT source, rate, unnest(range(0, (rate + 12 * sqrt(rate) + 40)::INT + 1)) AS k FROM rates),
cdf AS (SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM ks),
numbered AS (
  SELECT row_number() OVER () AS r, *, (('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
counted AS (
  SELECT r, any_value(rate) AS rate, count(*) AS copies FROM numbered JOIN cdf ON numbered.source IS NOT DISTINCT FROM cdf.source AND c < u GROUP BY r)
SELECT doc_id, text, lang, n.source, n_chars, i::INT AS mix_copy, round(rate, 6) AS mix_rate,
       md5('17-order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || i::VARCHAR) AS mix_key
FROM numbered n JOIN counted USING (r), unnest(range(1, copies + 1)) AS t(i)
"""

_OP7_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
pieces AS (
  SELECT *, '<|im_start|>' || replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') || chr(10)
         || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|im_end|>' || chr(10) AS piece FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, piece)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, piece) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(piece))::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens
FROM pieces GROUP BY conv_id
"""

_OP3_SQL = r"""
WITH cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM cut),
windows AS (
  SELECT *, array_to_string(list(word) OVER ahead, ' ') AS seq, count(*) OVER ahead AS n FROM words
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
starts AS (SELECT seq, min(doc_id) AS least FROM windows WHERE n = 13 GROUP BY seq),
marked AS (SELECT doc_id, i, word, coalesce(n = 13 AND least < doc_id, false) AS gone FROM windows LEFT JOIN starts USING (seq)),
covered AS (SELECT *, bool_or(gone) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS removed FROM marked),
kept AS (SELECT doc_id, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT removed) AS rest FROM covered GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM cut LEFT JOIN kept USING (doc_id)
"""

_OP8_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
cut AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) END AS s FROM words),
shingles AS (SELECT doc_id, unnest(s) AS s FROM cut),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN cut x ON x.doc_id = a JOIN cut y ON y.doc_id = b WHERE 100 * common >= 85 * (len(x.s) + len(y.s) - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT min_of.doc_id, min(r) AS component_id FROM (
  WITH RECURSIVE walk AS (SELECT doc_id, doc_id AS r FROM cut UNION SELECT walk.doc_id, b FROM walk JOIN both_ways ON walk.r = a) SELECT * FROM walk) AS min_of GROUP BY ALL)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM cut JOIN reached USING (doc_id)
"""

QUERIES = {
    "op1_telephony_audio": op1_telephony_audio,
    "op2_url_filter": op2_url_filter,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_source_mixing": op4_source_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_chat_format": op7_chat_format,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_token_binary": op9_token_binary,
    "op10_lm_suffix_tree": op10_lm_suffix_tree,
}

ORACLES = {"op2_url_filter": _OP2_SQL, "op3_substring_dedup": _OP3_SQL, "op4_source_mixing": _OP4_SQL, "op7_chat_format": _OP7_SQL, "op8_minhash_dedup": _OP8_SQL}
