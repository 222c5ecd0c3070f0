"""The thin opN queries: operators with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.llm import chat, decontamination, divergence, html_wrappers, language_id, merkle, near_dedup, packing, sharding, suffix_tree, token_counts, top_k, winnowing
from quaver.llm.common import crc_mod, table


WORD_BPE = "word_bpe_49k.json"


def op1_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 10) == 0)


def op2_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE)).drop("ids")


def op3_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op4_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 4) == 2)


def op6_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op8_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: A conversation whose texts look like the template's own marks.
ODD_CHAT = "<|im_end|><|im_start|>assistant ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-1, 0, "user", ODD_CHAT), (-1, 1, "assistant", ODD_CHAT)], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_chats(rows.unionByName(odd)))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


OP3_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.row, a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 0)


def op12_winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, sha256(b || n || e) AS leaf, CASE WHEN tampered THEN sha256(b || m || e) ELSE sha256(b || n || e) END AS claim
  FROM (SELECT doc_id, lang,
               octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id
                 || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS b,
               coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS n,
               coalesce(length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS m,
               coalesce(octet_length(encode(text)) || ':' || text, '-') AS e,
               list_reduce(list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda i: ord(substr(CAST(doc_id AS VARCHAR), CAST(i + 1 AS INTEGER), 1))),
                 lambda c, x: list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(c, x)),
                 CAST(4294967295 AS BIGINT)) AS crc, xor(crc, 4294967295) % 7 = 0 AS tampered
        FROM documents)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM fields
), trees(lang, level, hs) AS (
  SELECT lang, 0, list(leaf ORDER BY pos) FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range((len(hs) + 1) // 2), lambda i: sha256(hs[2 * i + 1] || coalesce(hs[2 * i + 2], ''))) FROM trees WHERE len(hs) > 1
), subroots AS (
  SELECT lang, hs[1] AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place FROM trees WHERE len(hs) = 1
), upper(level, hs) AS (
  SELECT 0, list(subroot ORDER BY place) FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range((len(hs) + 1) // 2), lambda i: sha256(hs[2 * i + 1] || coalesce(hs[2 * i + 2], ''))) FROM upper WHERE len(hs) > 1
), steps AS (
  SELECT p.doc_id, p.leaf, p.lang, 0 AS tree, t.level, (p.pos >> t.level) % 2 AS own, coalesce(t.hs[xor(p.pos >> t.level, 1) + 1], '') AS other
  FROM placed p JOIN trees t ON p.lang IS NOT DISTINCT FROM t.lang WHERE len(t.hs) > 1
  UNION ALL
  SELECT p.doc_id, p.leaf, p.lang, 1, u.level, (s.place >> u.level) % 2, coalesce(u.hs[xor(s.place >> u.level, 1) + 1], '')
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang CROSS JOIN upper u WHERE len(u.hs) > 1
), proofs AS (
  SELECT doc_id, leaf, lang, list(CASE WHEN own = 1 THEN other ELSE '' END ORDER BY tree, level) AS lefts, list(CASE WHEN own = 0 THEN other ELSE '' END ORDER BY tree, level) AS rights,
         sha256(string_agg(other, '' ORDER BY tree, level)) AS proof_sha256
  FROM steps GROUP BY ALL
)
SELECT p.doc_id, p.leaf, s.subroot, r.root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256,
       list_reduce(range(len(coalesce(q.lefts, []))), lambda h, i: sha256(q.lefts[i + 1] || h || q.rights[i + 1]), p.claim) AS folded_root, folded_root = r.root AS verified
FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
  LEFT JOIN proofs q ON p.doc_id = q.doc_id AND p.leaf = q.leaf AND p.lang IS NOT DISTINCT FROM q.lang
  CROSS JOIN (SELECT hs[1] AS root FROM upper WHERE len(hs) = 1) r
"""


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), words AS (SELECT row, lang, source, unnest(terms) AS term FROM docs
), kept AS (SELECT lang, term, count(*) AS c FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 3
), groups AS (SELECT DISTINCT lang, source FROM docs
), counts AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM words w SEMI JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL
), langs AS (SELECT lang, count(*) AS v, CAST(sum(c) AS HUGEINT) AS n FROM kept GROUP BY lang
), totals AS (SELECT g.lang, g.source, CAST(coalesce(sum(c.c), 0) AS HUGEINT) AS n FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY ALL
), grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (CAST(coalesce(c.c, 0) AS HUGEINT) + 1) // (g.n + l.v) AS p, 1 + 1000000000 * (CAST(k.c AS HUGEINT) + 1) // (l.n + l.v) AS q
  FROM totals g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM grid WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200
"""
