"""One query per operator over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pupilage.llm import alignment, chat, edits, lattice, licenses, packing, periodic, quality, sharding, simhash, suffix, toxicity, voronoi
from pupilage.llm.texts import held_out


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.digests(table(spark, folder, "documents"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = toxicity.scores(docs, toxicity.fit(docs, table(spark, folder, "labels")), "doc_id")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = quality.scores(docs, quality.fit(docs, table(spark, folder, "labels")), "doc_id")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as files of a tree: /source/lang, with every 97th document named as a license file."""
    docs = table(spark, folder, "documents")
    name = F.when(F.col("doc_id") % 97 == 0, F.concat(F.lit("LICENSE-"), "doc_id")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    deep = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/"), (F.col("doc_id") % 50).cast("string"))).otherwise(F.lit(""))
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), deep, F.lit("/"), name)
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"))


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.placements(table(spark, folder, "documents"), shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], given.schema)
    return chat.read_back(chat.formatted(given.unionAll(added)))


def op8_lattice(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, folder, "embeddings"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash.grouped(table(spark, folder, "documents"), shingle=4, limit=4)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return edits.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_cross_tokenizer(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return alignment.linked(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.digests(periodic.scan(periodic.planted(table(spark, folder, "documents"))))


def op13_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return voronoi.top_k(rows, rows.filter(F.col("vec_id") % 50 == 0))


QUERIES = {
    "op1_suffix_array": op1_suffix_array,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_license_scan": op5_license_scan,
    "op6_sharding": op6_sharding,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_lattice": op8_lattice,
    "op9_simhash": op9_simhash,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_cross_tokenizer": op11_cross_tokenizer,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_exact_top_k": op13_exact_top_k,
}
#: Queries that SQL can express.
ORACLES: dict[str, str] = {
    "op7_chat_formatting": r"""
        WITH given AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
        measured AS (
            SELECT *,
                   CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9
                             ELSE 16 + length(role) + len(regexp_extract_all(role, '[\\>]')) END AS marks,
                   len(regexp_extract_all(text, '<</?SYS>>|\[/?INST\]|</?s>|<role:|</role>|\\')) AS escapes
            FROM given)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(marks + length(text) + escapes)::BIGINT AS formatted_chars
        FROM measured GROUP BY conv_id""",
    "op8_lattice": """
        WITH RECURSIVE whole AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0
              AND len([x FOR x IN embedding IF x <> 0]) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM whole a JOIN whole b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.93),
        reached(a, b) AS (
            SELECT vec_id, vec_id FROM embeddings
            UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
        found AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a)
        SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = found.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM found""",
    "op13_exact_top_k": """
        WITH given AS (
            SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.v, x.v) AS BIGINT) AS score
            FROM given q JOIN given x ON x.vec_id <> q.vec_id
            WHERE q.vec_id % 50 = 0),
        ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
}
