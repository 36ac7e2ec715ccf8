"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphledger.llm import align_tokens, byte_bpe, chain_dedup, chat_prefix, context_mixing, cube_mix, dart_minhash, decontaminate, fill_middle, suffix_dedup, toxicity, vp_search, weak_quality
from glyphledger.llm.common import crc_mod5, read


def op1_vp_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read(spark, sf_dir, "embeddings")
    return vp_search.search(base, F.col("vec_id") % 20 == 0)


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(read(spark, sf_dir, "documents"), crc_mod5("doc_id") == 1)


def op3_suffix_array_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, read(spark, sf_dir, "benchmark"))
    return decontaminate.summarize(found.drop("text")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return weak_quality.score(docs, weak_quality.learn(docs))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(read(spark, sf_dir, "documents"))


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.classes(read(spark, sf_dir, "documents"))


def op7_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_dedup.repeated_passages(read(spark, sf_dir, "documents"))


def op8_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod5("doc_id") == 0
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"), ~held_out)
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_mix.mix(read(spark, sf_dir, "documents"))


def op10_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_prefix.read_back(chat_prefix.expand(rows))


def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens.digest(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.digest(byte_bpe.decode(encoded, ranks))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.fill_in_middle(read(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_vp_tree_search, op2_context_mixing, op3_suffix_array_leaks, op4_weak_quality, op5_suffix_array_dedup, op6_dart_minhash, op7_collinear_chains, op8_lexicon_toxicity, op9_cube_mix, op10_prefix_targets, op11_align_tokens, op12_byte_bpe, op13_fill_middle)}


def _escaped(x: str) -> str:
    x = f"replace({x}, '\\', '\\\\')"
    for mark in chat_prefix.CONTROL:
        x = f"replace({x}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return x


_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: The other queries have none: their classes, searches, models and draws are beyond SQL, or (op5) too slow in it; tests
#: hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_suffix_array_leaks": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0) AS t),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM iw) AS l ON len(w) >= n) AS t),
hit AS (SELECT dw.r, dw.i, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) AS t GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit) AS t GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.r = pos.r LEFT JOIN its ON d.r = its.r""",
    "op10_prefix_targets": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_escaped("role")}) + length({_escaped("text")}) + {len(chat_prefix.TURN + chat_prefix.BODY + chat_prefix.END)}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
    "op13_fill_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || h[i:i + 7] AS BIGINT)) AS r FROM d),
k AS (SELECT doc_id, text, w, CAST(len(w) AS BIGINT) AS n, r[1] % (len(w) + 1) AS x, r[2] % (len(w) + 1) AS y,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT doc_id, text, n, form, array_to_string(w[1:least(x, y)], '') AS p, array_to_string(w[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(w[greatest(x, y) + 1:], '') AS s FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM c""",
}
