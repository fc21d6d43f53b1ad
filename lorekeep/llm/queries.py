"""The registered queries of this subpackage, over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import (
    centroids, chat_format, decontaminate, exact_dedup, lm_scoring, mixing, quality, simhash_dedup, substring_dedup, suffix_dedup, token_alignment, token_counts, toxicity,
)
from lorekeep.llm.common import table


#: Where the public vocabularies are installed.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCABULARY_A, VOCABULARY_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), VOCABULARY)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted; every result is read back from the output."""
    records = chat_format.conversation_records(table(spark, sf_dir, "conversations"))
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(said).alias("prompt"), F.lit(said).alias("completion"))
    both = records.unionByName(extra, allowMissingColumns=True)
    out = chat_format.format_turns(chat_format.canonical_turns(both)).withColumn("back", chat_format.read_turns(F.col("formatted")))
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat_format.read_loss(F.col("formatted"), F.col("loss_mask"))
    return out.withColumn("loss", loss).select(
        "conv_id",
        F.size("back").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


_CONTROL_SQL = r"[<\[]\\*(?:/?s>|/?INST\]|</?SYS>>|\|[A-Za-z_]{1,32}\|>)"

OP2_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROL_SQL}')) AS body,
    length(role) + len(regexp_extract_all(role, '{_CONTROL_SQL}')) + 2 * (length(role) - length(replace(replace(role, '%', ''), chr(10), ''))) AS head
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat_format.START)} + head + 1 + body + {len(chat_format.END)}) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents that are labelled as good. Background: all documents."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_lines(table(spark, sf_dir, "documents"))


OP8_SQL = f"""
WITH cut AS (
  SELECT doc_id, string_split(regexp_replace(text, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)) AS said FROM documents WHERE text IS NOT NULL
), parts AS (
  SELECT doc_id, unnest(said) AS part, generate_subscripts(said, 1) AS place FROM cut
), placed AS (
  SELECT doc_id, place, regexp_extract_all(lower(part), '\\S+') AS words, length(part) AS chars,
    CAST(coalesce(sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start"
  FROM parts
), units AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS unit, "start", "start" + chars AS "end", len(words) AS n_words, array_to_string(words, ' ') AS said
  FROM placed WHERE len(words) > 0
), pairs AS (
  SELECT b.doc_id, b.unit, b.n_words, a.doc_id AS keep_doc_id, a.unit AS keep_unit
  FROM units b JOIN units a ON a.said = b.said AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.unit < b.unit)
), lines AS (
  SELECT *, unit - row_number() OVER (PARTITION BY doc_id, keep_doc_id, unit - keep_unit ORDER BY unit) AS run FROM pairs
), summed AS (
  SELECT *, sum(n_words) OVER (PARTITION BY doc_id, keep_doc_id, unit - keep_unit, run) AS together FROM lines
), gone AS (
  SELECT doc_id, unit, min((keep_doc_id, keep_unit)) AS kept FROM summed WHERE together >= {substring_dedup.RUN_WORDS} GROUP BY doc_id, unit
)
SELECT u.doc_id, u.unit, u."start", u."end", u.n_words, kept[1] AS keep_doc_id, kept[2] AS keep_unit
FROM gone g JOIN units u ON g.doc_id = u.doc_id AND g.unit = u.unit
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = quality.ratings_from_labels(table(spark, sf_dir, "labels"))
    return quality.grade(table(spark, sf_dir, "documents"), ratings)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_groups(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def _rounds_sql(rounds: int) -> str:
    """CTEs d0, a0, c1, d1, ...: distances, assignments and centroids of each round; c0 is there."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""d{i} AS (
  SELECT x.r, c.cluster, CAST(sum((x.x - c.x) * (x.x - c.x)) AS BIGINT) AS distance FROM parts x JOIN c{i} c ON x.i = c.i GROUP BY x.r, c.cluster
), a{i} AS MATERIALIZED (
  SELECT r, cluster, distance FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1
)""")
        if i < rounds:
            out.append(f"""s{i} AS (
  SELECT a.cluster, x.i, CAST(sum(x.x) AS HUGEINT) AS s, count(*) AS n FROM a{i} a JOIN parts x ON a.r = x.r GROUP BY a.cluster, x.i
), c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, c.i, CAST(CASE WHEN s.n IS NULL THEN c.x ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS BIGINT) AS x
  FROM c{i} c LEFT JOIN s{i} s ON c.cluster = s.cluster AND c.i = s.i
)""")
    return ",\n".join(out)


OP11_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {centroids.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.DIMENSIONS}
), parts AS MATERIALIZED (
  SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept
), first AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS cluster, r FROM kept QUALIFY cluster < {centroids.CENTROIDS}
), c0 AS MATERIALIZED (
  SELECT f.cluster, p.i, p.x FROM first f JOIN parts p ON f.r = p.r
), {_rounds_sql(centroids.ROUNDS)}, digests AS (
  SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{centroids.ROUNDS} GROUP BY cluster
)
SELECT k.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, d.centroid_sha256
FROM a{centroids.ROUNDS} a JOIN kept k ON a.r = k.r JOIN digests d ON a.cluster = d.cluster
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), VOCABULARY_A, VOCABULARY_B)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes of each document, and the digest of the rest."""
    out = suffix_dedup.remove_repeated(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = f"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {suffix_dedup.NO_ID}) AS rank, hex(encode(coalesce(text, ''))) AS said FROM documents
), windows AS (
  SELECT r, rank, p, substring(said, 2 * p + 1, {2 * suffix_dedup.LENGTH}) AS s
  FROM (SELECT r, rank, said, unnest(range(0, greatest(0, length(said) // 2 - {suffix_dedup.LENGTH - 1}))) AS p FROM texts)
), starts AS (
  SELECT r, p FROM (SELECT r, p, rank, min(rank) OVER (PARTITION BY s) AS least FROM windows) WHERE least < rank
), spans AS MATERIALIZED (
  SELECT r, min(p) AS b, max(p) + {suffix_dedup.LENGTH} AS e
  FROM (SELECT *, sum(gap) OVER (PARTITION BY r ORDER BY p) AS span FROM (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= {suffix_dedup.LENGTH} THEN 0 ELSE 1 END AS gap FROM starts))
  GROUP BY r, span
), between AS (
  SELECT r, b, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS a FROM spans
  UNION ALL SELECT t.r, length(t.said) // 2, coalesce((SELECT max(e) FROM spans s WHERE s.r = t.r), 0) FROM texts t
), kept AS (
  SELECT t.r, string_agg(substring(t.said, 2 * a + 1, 2 * (b - a)), '' ORDER BY b, a) AS said FROM between JOIN texts t ON between.r = t.r GROUP BY t.r
)
SELECT t.doc_id, CAST(length(t.said) // 2 AS BIGINT) AS n_bytes, CAST(length(t.said) // 2 - length(k.said) // 2 AS BIGINT) AS n_removed,
  (SELECT count(*) FROM spans s WHERE s.r = t.r) AS n_spans, sha256(unhex(k.said)) AS kept_sha256
FROM texts t JOIN kept k ON t.r = k.r
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_chat_format": op2_chat_format,
    "op3_toxicity": op3_toxicity,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_decontaminate": op5_decontaminate,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_mixing": op7_mixing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality": op9_quality,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_centroids": op11_centroids,
    "op12_token_alignment": op12_token_alignment,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": OP2_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op11_centroids": OP11_SQL,
    "op13_suffix_dedup": OP13_SQL,
}
