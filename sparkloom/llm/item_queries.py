"""Problems 5, 6 and 7 on ``risk_items``, ``review_states`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.llm.packing import container_fill, pack_texts
from sparkloom.llm.splitting import cut_sections, split_oversized
from sparkloom.llm.topn import top_n
from sparkloom.sources.tables import table


def p5_found(spark, sf_dir):
    return top_n(table(spark, sf_dir, "risk_items"), table(spark, sf_dir, "risk_type_alias")).select("risk_id")


def p5_ranked(spark, sf_dir):
    return top_n(table(spark, sf_dir, "risk_items"), table(spark, sf_dir, "risk_type_alias"))


def p6_found(spark, sf_dir):
    return cut_sections(split_oversized(table(spark, sf_dir, "review_states")))


def p6_pieces(spark, sf_dir):
    return split_oversized(table(spark, sf_dir, "review_states")).drop("cut_files")


def p6_joined(spark, sf_dir):
    """Every oversized diff put together again from its pieces; no more than the diff meets in one group."""
    pieces = split_oversized(table(spark, sf_dir, "review_states"))
    new = F.substring("piece", F.col("overlap") + 1, F.lit(1 << 30))
    joined = pieces.groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", new.alias("new")))).alias("parts"), F.max(F.length("piece")).alias("longest"))
    return joined.select("review_id", F.md5(F.array_join("parts.new", "")).alias("text_md5"), (F.col("longest") <= 4000).alias("fits"))


def p7_texts(spark, sf_dir):
    """Texts by how often they were placed, each once in a container or in parts that follow one another."""
    placed = pack_texts(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_parts").alias("n_parts"), F.count_distinct("part_no").alias("n_distinct"))
    return placed.select("doc_id", ((F.col("n") == F.col("n_parts")) & (F.col("n") == F.col("n_distinct"))).alias("is_whole"))


def p7_containers(spark, sf_dir):
    return pack_texts(table(spark, sf_dir, "documents"))


def p7_fill(spark, sf_dir):
    return container_fill(pack_texts(table(spark, sf_dir, "documents")))


_RANKED = """
WITH read AS (SELECT risk_id, nullif(regexp_replace(replace(trim(file_path), '\\', '/'), '^(\\./+)+', ''), '') AS file_path,
                     a.risk_type, coalesce(confidence, 0.5) AS confidence, line_number.start::BIGINT AS start, line_number."end" AS last, created_at
              FROM risk_items i JOIN risk_type_alias a ON a.written_type = i.risk_type),
latest AS (SELECT * FROM read WHERE file_path IS NOT NULL AND NOT isnan(confidence) AND confidence BETWEEN 0 AND 1 AND start >= 1 AND start <= last
           QUALIFY row_number() OVER (PARTITION BY risk_id ORDER BY created_at DESC NULLS LAST, confidence DESC, start, file_path DESC, risk_type DESC) = 1),
ranked AS (SELECT risk_id, file_path, risk_type, confidence, start,
                  row_number() OVER (PARTITION BY file_path, risk_type ORDER BY confidence DESC, start, risk_id)::INTEGER AS rank FROM latest)
"""

QUERIES = {"p5_found": p5_found, "p5_ranked": p5_ranked, "p6_found": p6_found, "p6_pieces": p6_pieces, "p6_joined": p6_joined, "p7_texts": p7_texts, "p7_containers": p7_containers, "p7_fill": p7_fill}
SQL = {
    "p6_joined": """WITH latest AS (SELECT review_id, diff_context AS d FROM review_states
                QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY updated_at DESC NULLS LAST, diff_context DESC NULLS LAST) = 1)
SELECT review_id, md5(d) AS text_md5, true AS fits FROM latest WHERE length(d) > 4000""",
    "p7_texts": r"SELECT doc_id, true AS is_whole FROM documents WHERE regexp_matches(text, '\S')",
    "p5_found": _RANKED + "SELECT risk_id FROM ranked WHERE rank <= 3",
    "p5_ranked": _RANKED + "SELECT risk_id, file_path, risk_type, confidence, start, rank FROM ranked WHERE rank <= 3",
    "p6_found": r"""
WITH latest AS (SELECT review_id, diff_context AS d FROM review_states
                QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY updated_at DESC NULLS LAST, diff_context DESC NULLS LAST) = 1),
lines AS (SELECT review_id, unnest(string_split(d, chr(10))) AS line, generate_subscripts(string_split(d, chr(10)), 1) AS n,
                 len(string_split(d, chr(10))) AS n_lines FROM latest WHERE d IS NOT NULL),
numbered AS (SELECT *, count(*) FILTER (starts_with(line, 'diff --git ') OR starts_with(line, 'diff --cc '))
                    OVER (PARTITION BY review_id ORDER BY n) AS file_no FROM lines)
SELECT review_id, file_no::INTEGER AS file_no FROM numbered WHERE file_no > 0
GROUP BY review_id, file_no HAVING sum(length(line) + CASE WHEN n < n_lines THEN 1 ELSE 0 END) > 4000""",
}
