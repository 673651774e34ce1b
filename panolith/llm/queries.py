"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panolith.llm import bpe, chat, exact_dedup, language_id, line_dedup, lm_score, minhash, packing, prefix_trie, sharding, simhash, spelling, topk
from panolith.llm.tables import table

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    awkward = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(awkward).alias("text"))
    out = chat.format_chats(rows.unionByName(probe))
    read = out.select("conv_id", "valid", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars", "valid")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"), PIECE_VOCABULARY)


def op8_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_groups(table(spark, sf_dir, "documents")).drop("uid")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = language_id.Models(language_id.training_sample(docs))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))
    return language_id.identify(docs, models).withColumn("held_out", held_out)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), base=c - c % 5, keep=F.crc32(c.cast("string").cast("binary")) % 9)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


OP3_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (
  SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
         max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
         count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
  FROM documents)
"""

_BROKEN = "replace(text, '\\', '\\\\')"
for _c in chat.TEMPLATE.controls:
    _BROKEN = f"replace({_BROKEN}, '{_c}', '{_c[0]}\\{_c[1:]}')"
_MARKS = " ".join(f"WHEN '{k}' THEN {len(t.open) + len(t.close)}" for k, t in chat.TEMPLATE.turns.items())
_OTHER = sum(map(len, chat.TEMPLATE.other))

OP2_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
parts AS (
  SELECT *, CASE WHEN role IN ('system', 'user', 'assistant') THEN role[1:1] ELSE 'x' END AS letter,
         {len(chat.TEMPLATE.between)} + length({_BROKEN})
         + CASE role {_MARKS} ELSE {_OTHER} + length({_BROKEN.replace("(text,", "(role,")}) END AS chars
  FROM rows),
whole AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
         string_agg(letter, '' ORDER BY turn, role, text) AS letters,
         CAST(sum(chars) AS BIGINT) AS formatted_chars
  FROM parts GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars,
       sha256(learnt) AS loss_sha256, formatted_chars, regexp_full_match(letters, 's?(ua)+') AS valid
FROM whole
"""

OP8_SQL = """
WITH ready AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM ready q JOIN ready c ON q.vec_id % 50 = 0 AND q.rid <> c.rid),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) > 2 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words),
postings AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM postings x JOIN postings y ON x.h = y.h AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM sets s JOIN least ON a = s.doc_id
"""

_CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS tab
  FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) t(i)))"""


def _crc32(codes: str) -> str:
    """SQL for the crc32 of a list of bytes, beside the table ``crc_table``."""
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295)"


OP12_SQL = f"""
WITH {_CRC_TABLE},
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS t FROM turns GROUP BY conv_id),
plans AS (
  SELECT conv_id, t, conv_id - conv_id % 5 AS base, {_crc32("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))")} % 9 AS h
  FROM own, crc_table),
rebuilt AS (
  SELECT p.conv_id, list_concat(coalesce(b.t[1:p.h], []), p.t[p.h + 1:]) AS t FROM plans p LEFT JOIN own b ON b.conv_id = p.base),
prefixes AS (
  SELECT conv_id, d, t[1:d] AS p, t[1:d - 1] AS parent, len(t) = d AS ended FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, p, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM prefixes GROUP BY d, p),
children AS (SELECT d - 1 AS d, parent AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY d, parent),
counted AS (
  SELECT nodes.*, coalesce(n, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * octet_length(encode(p[d].text)) ELSE 0 END AS worth
  FROM nodes LEFT JOIN children USING (d, p)),
below AS (
  SELECT x.d, x.p, count(*) FILTER (v.n_children = 0) AS n_leaves, sum(v.worth) AS saved
  FROM counted v JOIN prefixes x ON x.conv_id = v.conv_id AND x.d <= v.d GROUP BY x.d, x.p)
SELECT c.conv_id, c.d AS depth, u.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN below USING (d, p) LEFT JOIN nodes u ON c.d > 0 AND u.d = c.d - 1 AND u.p = c.parent
"""

OP13_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents) GROUP BY doc_id, w),
hashed AS (
  SELECT w, n, CASE WHEN doc_id IS NULL THEN 1 ELSE {_crc32("flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [195, CAST(ord(x) AS BIGINT) - 64] END))")} END AS h
  FROM runs, crc_table WHERE length(w) >= 6),
counted AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY word),
vocabulary AS (SELECT word, n, length(word) AS l FROM counted WHERE length(word) >= 6 AND n >= 5),
gaps AS (
  SELECT word, n, l, i, substr(word, 1, CAST(i AS INTEGER) - 1) || substr(word, CAST(i AS INTEGER) + 1) AS rest
  FROM (SELECT *, unnest(range(1, l + 1)) AS i FROM vocabulary)),
inserted AS (SELECT DISTINCT g.word AS long, g.n AS long_n, v.word AS short, v.n AS short_n FROM gaps g JOIN vocabulary v ON v.word = g.rest),
near AS (
  SELECT x.word, y.word AS other, y.n FROM gaps x JOIN gaps y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION ALL SELECT long, short, short_n FROM inserted UNION ALL SELECT short, long, long_n FROM inserted),
best AS (SELECT word, count(*) AS n_near, min({{'less': -n, 'other': other}}) AS b FROM near GROUP BY word),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 5 * v.n THEN b.other END AS form, CASE WHEN -b.less >= 5 * v.n THEN -b.less END AS form_n
  FROM vocabulary v LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, walk.at AS root
FROM forms f JOIN walk USING (word) JOIN forms e ON e.word = walk.at AND e.form IS NULL
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_chat": op2_chat,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sharding": op4_sharding,
    "op5_bpe": op5_bpe,
    "op6_packing": op6_packing,
    "op7_lm_score": op7_lm_score,
    "op8_maxscore": op8_maxscore,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
    "op11_minhash": op11_minhash,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL: dict[str, str] = {"op2_chat": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op8_maxscore": OP8_SQL, "op11_minhash": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_spelling": OP13_SQL}
