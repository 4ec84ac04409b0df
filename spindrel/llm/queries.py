"""The registered queries of the training-data operators and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balltree, chat, fmindex, linededup, mixing, multiindex, packing, pfp, simhash, toxicity
from .common import read


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(toxicity.crc_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op4_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pfp.dedup(read(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return done.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fmindex.dedup(read(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return done.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_k(read(spark, sf_dir, "embeddings"), every=50, k=5)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.neighbours(read(spark, sf_dir, "embeddings"), every=20, k=20)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")


#: A conversation of control strings only, which formatting must bring back as it is.
PROBE = "</s>[INST] ok [/INST]"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    back = chat.read_back(chat.format_chats(turns.unionByName(probe)))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    learned = F.concat_ws("", "learned")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


#: A text as the template writes it: backslashes doubled, then each control string broken.
_ESCAPED = r"""replace(replace(replace(replace(replace(replace(replace(replace({0}, '\', '\\'),
  '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<s>', '<\s>'),
  '</s>', '<\/s>'), '<|endoftext|>', '<\|endoftext|>')"""

OP6_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS learned,
         CAST(sum(length('<s>[INST][/INST]</s>') + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM g
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * length(regexp_replace(coalesce(text, ''), '[^0-9!?#$%&@*<>{}|~_=+]', '', 'g'))
           / greatest(length(coalesce(text, '')), 1)) AS weight,
         (CAST(CAST('0x' || substr(md5('42' || chr(31) || coalesce(CAST(doc_id AS VARCHAR), chr(0))), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
           / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS w,
             3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
                 sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM l),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             least(floor(t.target / greatest(t.source_size, 1)), 3)::BIGINT AS whole,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.weight, d.doc_id, d.size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN before + size / 2.0 <= target - whole * source_size AND whole < 3 AND size > 0 THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM o
"""

def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.per_document(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.concat_ws(",", F.transform("removed", lambda i: i.cast("string"))).alias("removed_lines"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(s))) AS line, unnest(s) AS said FROM (SELECT doc_id, string_split(lower(text), chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(said, '[^\x20\x09-\x0D]+'))) AS t FROM l),
n AS (SELECT * FROM w WHERE len(t) > 0),
c AS (SELECT t, len(t) AS n, min(struct_pack(d := doc_id, l := line)) AS first, row_number() OVER (ORDER BY t) AS id FROM n GROUP BY t),
e AS (SELECT id, n, first, unnest(t) AS word FROM c),
p AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, any_value(b.first) AS late, count(*) AS o
      FROM (SELECT word FROM e GROUP BY word HAVING count(*) > 1) AS f JOIN e a USING (word) JOIN e b ON a.word = b.word AND a.first < b.first
       AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4
      GROUP BY a.id, b.id HAVING count(*) * 9 >= (any_value(a.n) + any_value(b.n)) * 4),
g AS (SELECT n.doc_id, n.line, struct_pack(d := n.doc_id, l := n.line) <> c.first OR c.id IN (SELECT b FROM p) AS gone FROM n JOIN c ON n.t = c.t),
d AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
             coalesce(string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FILTER (gone), '') AS removed_lines FROM g GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed_lines, '') AS removed_lines
FROM documents LEFT JOIN d USING (doc_id)
"""

QUERIES = {"op1_simhash": op1_simhash, "op2_toxicity": op2_toxicity, "op3_topk": op3_topk, "op4_bytes": op4_bytes, "op5_packing": op5_packing, "op6_chat": op6_chat, "op7_neighbours": op7_neighbours, "op8_words": op8_words, "op9_mixing": op9_mixing, "op10_lines": op10_lines}
ORACLE_SQL = {"op3_topk": OP3_SQL, "op6_chat": OP6_SQL, "op9_mixing": OP9_SQL, "op10_lines": OP10_SQL}
