"""Registered queries of the corpus operators and their checking SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.llm import credentials, linktrust, lshforest, middles, packing, qgrams, repetition, rotation, simhash, simple8b, slots, spelling, suffixes, tokens
from panelflow.plans.staging import checkpoint_root, stage
from panelflow.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(ship_package(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_repetition_coverage")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition.judge(docs, keep=["doc_id"])


@query("op3_virtual_slots", sql=None)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slots.records(table(spark, sf_dir, "documents"))
    kept = f"{checkpoint_root(spark)}/slot-map-{uuid.uuid4().hex}"
    slots.first_map(slots.slot_sizes(rows), 16).write.parquet(f"{kept}/version=1")
    slots.rebalance(spark.read.parquet(f"{kept}/version=1"), 16).write.parquet(f"{kept}/version=2")
    placed = slots.place(rows, spark.read.parquet(f"{kept}/version=2"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(2).alias("map_version")
    )


@query("op5_link_trust")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linktrust.judge(table(spark, sf_dir, "pages"))


@query("op6_linked_secrets")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return credentials.find(docs, ["doc_id"]).drop("text_key")


@query("op10_perspective_rotation", sql="""
WITH placed AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, block ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1) // 256 AS piece
  FROM (SELECT *, CAST(floor(coalesce(turn, 0) / 256) AS BIGINT) AS block FROM conversations)),
views AS (
  SELECT p.*, s.role AS assistant FROM placed p JOIN (SELECT DISTINCT conv_id, block, piece, role FROM placed WHERE role <> 'system') s
  ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND p.block = s.block AND p.piece = s.piece),
shown AS (
  SELECT conv_id, block, piece, assistant, turn, role, text, coalesce(role = assistant, false) AS own,
    '<|im_start|>' || CASE WHEN coalesce(role = assistant, false) THEN 'assistant' WHEN role = 'system' THEN role
      ELSE 'user name=' || replace(coalesce(role, 'unknown'), '<|', '< |') END || chr(10) AS head,
    replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' AS body FROM views),
counted AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER w - length(body) - 1 AS first FROM shown
  WINDOW w AS (PARTITION BY conv_id, block, piece, assistant ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING))
SELECT conv_id, block, piece, assistant, count(*) AS n_turns,
  string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text,
  string_agg(CASE WHEN own THEN CAST(first AS VARCHAR) || ':' || CAST(first + length(body) AS VARCHAR) END, ',' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS mask,
  CAST(sum(CASE WHEN own THEN length(body) ELSE 0 END) AS BIGINT) AS mask_chars
FROM counted GROUP BY conv_id, block, piece, assistant
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotation.rotate(table(spark, sf_dir, "conversations"))


@query("op7_simple8b")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_root(spark)}/simple8b-{uuid.uuid4().hex}"
    simple8b.write(table(spark, sf_dir, "documents"), path, tokens.default_path(), end_id=1)
    return simple8b.summary(spark.read.parquet(path))


@query("op9_sum_of_squares_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokens.default_path()))


@query("op1_qgram_lemma")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return qgrams.mark(docs, table(spark, sf_dir, "benchmark"), ["doc_id"])


@query("op2_lsh_forest")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lshforest.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_grams")


@query("op4_suffix_sort")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.find(table(spark, sf_dir, "documents"))


@query("op11_seekable_frames", sql="""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (
  SELECT *, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(d, 9, 8) AS BIGINT) % (n + 1) AS y,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
c AS (SELECT *, substr(text, 1, least(x, y)) AS p, substr(text, least(x, y) + 1, abs(x - y)) AS m, substr(text, greatest(x, y) + 1) AS s FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(x, y) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(x - y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM c
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = stage(middles.store(table(spark, sf_dir, "documents")), "frames")
    return middles.digests(middles.rearrange(stored))


@query("op12_deletion_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(table(spark, sf_dir, "documents"))


@query("op13_reduced_alphabet", sql="""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY doc_id, run),
bytes AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
bits AS (
  SELECT *, [CAST(4294967295 AS BIGINT)] || flatten([[(b >> k) & 1 for k in [0, 1, 2, 3, 4, 5, 6, 7]] for b in
    [CAST('0x' || substr(x, CAST(i AS BIGINT), 2) AS BIGINT) for i in range(1, length(x), 2)]]) AS f FROM bytes),
-- CRC-32, a bit at a time.
crcs AS (SELECT *, xor(list_reduce(f, lambda c, bit: xor(c >> 1, CAST(3988292384 AS BIGINT) * (xor(c, bit) & 1))), 4294967295) AS h FROM bits),
spelt AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM crcs),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.less = b.word),
near AS (SELECT word, count(*) AS n_near, min((-other_n, other)) AS best FROM pairs GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * w.n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * w.n THEN -best[1] END AS form_n
  FROM words w LEFT JOIN near USING (word)),
walk AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT walk.word, form FROM walk JOIN formed ON walk.root = formed.word WHERE form IS NOT NULL),
ends AS (SELECT walk.word, walk.root FROM walk JOIN formed ON walk.root = formed.word WHERE form IS NULL)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"))
