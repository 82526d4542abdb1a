"""Queries of the operators of this subpackage, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.clusters import cluster, describe
from lodestone.llm.history import admit, admit_batches
from lodestone.llm.leakage import leaks, without_leaks
from lodestone.llm.mixing import mixture
from lodestone.llm.near_duplicates import near_pairs
from lodestone.llm.neighbours import neighbours
from lodestone.llm.quality import STATS, profile, text_types
from lodestone.session import table


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "file_record"), table(spark, sf_dir, "encoding_profile")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(*_vectors(spark, sf_dir)).select("record_a", "record_b")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(*_vectors(spark, sf_dir))


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, links, medoid and most typical members of each part of each cluster."""
    return describe(*_vectors(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(*_vectors(spark, sf_dir)).select("record_id", "neighbour_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admit(*_vectors(spark, sf_dir), grow=False)[0]


def p7_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of p7_found, from batches admitted one by one against a stored history."""
    return admit_batches(*_vectors(spark, sf_dir))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("item_id", "doc_id")


def p8_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest verbatim match of each leaked item in each document, and where."""
    return _leaks(spark, sf_dir)


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that remain when those with leaks are removed."""
    return without_leaks(table(spark, sf_dir, "documents"), _leaks(spark, sf_dir)).select("doc_id")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document in the mixture, in its global random order."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_target"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share, size and repeats of every source."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_target"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_types(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_word")).where("kind <> 'prose'").select("doc_id", "kind")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality statistics of every document."""
    return profile(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_word")).select("doc_id", *STATS)


#: Contents with a valid vector, and the cosines of those of one profile: by brute force.
_CONTENTS = """
WITH RECURSIVE valid AS (
  SELECT record_id, file_id, r.profile_id, vector::DOUBLE[] AS v FROM file_record r JOIN encoding_profile p USING (profile_id)
  WHERE state = 'ready' AND vector IS NOT NULL AND len(vector) = dimensions AND file_id IS NOT NULL),
unit AS (SELECT * FROM valid WHERE NOT isnan(list_inner_product(v, v)) AND abs(list_inner_product(v, v) - 1) <= 1e-5),
content AS (SELECT profile_id, file_id, min(record_id)::BIGINT AS id, arg_min(v, record_id) AS v FROM unit GROUP BY ALL),
pair AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM content a JOIN content b ON a.profile_id = b.profile_id AND a.id < b.id)
"""
#: Records one after another: what is accepted so far goes from step to step as a list.
_ADMISSION = """
WITH RECURSIVE valid AS (
  SELECT record_id, r.profile_id, vector::DOUBLE[] AS v FROM file_record r JOIN encoding_profile p USING (profile_id)
  WHERE state = 'ready' AND vector IS NOT NULL AND len(vector) = dimensions),
unit AS (SELECT * FROM valid WHERE NOT isnan(list_inner_product(v, v)) AND abs(list_inner_product(v, v) - 1) <= 1e-5),
near AS (SELECT a.record_id AS a, b.record_id AS b FROM unit a JOIN unit b ON a.profile_id = b.profile_id AND a.record_id <> b.record_id AND list_cosine_similarity(a.v, b.v) >= 0.95
  UNION SELECT a.record_id, b.record_id FROM file_record a JOIN file_record b ON a.file_id = b.file_id AND a.record_id <> b.record_id),
conflict AS (SELECT a, list(b::BIGINT) AS others FROM near GROUP BY a),
line AS MATERIALIZED (SELECT record_id::BIGINT AS record_id, row_number() OVER (ORDER BY batch_no, record_id) AS n, coalesce(others, []) AS others FROM file_record LEFT JOIN conflict ON a = record_id),
step AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS record_id, NULL::BIGINT AS match_id, []::BIGINT[] AS accepted
UNION ALL
  SELECT l.n, l.record_id, list_min(list_intersect(l.others, s.accepted)), CASE WHEN len(list_intersect(l.others, s.accepted)) = 0 THEN list_append(s.accepted, l.record_id) ELSE s.accepted END
  FROM step s JOIN line l ON l.n = s.n + 1)
SELECT record_id, match_id FROM step WHERE match_id IS NOT NULL
"""
SQL = {
    "p7_found": _ADMISSION,
    "p7_batches": _ADMISSION,
    "p2_found": _CONTENTS + "SELECT a AS record_a, b AS record_b FROM pair WHERE s >= 0.95",
    "p3_found": _CONTENTS
    + """, link AS (SELECT a, b FROM pair WHERE s >= 0.6 UNION ALL SELECT b, a FROM pair WHERE s >= 0.6),
reach AS (SELECT a AS id, a AS root FROM link UNION SELECT l.b, r.root FROM reach r JOIN link l ON l.a = r.id),
label AS (SELECT id, min(root) AS root FROM reach GROUP BY 1)
SELECT root AS cluster_id, id AS record_id FROM label QUALIFY count(*) OVER (PARTITION BY root) >= 3""",
    "p4_found": _CONTENTS
    + """, both_ AS (SELECT a AS record_id, b AS neighbour_id, round(s, 6) AS s FROM pair UNION ALL SELECT b, a, round(s, 6) FROM pair)
SELECT record_id, neighbour_id FROM both_ WHERE s >= 0.6 QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY s DESC, neighbour_id) <= 5""",
}
QUERIES = {
    "p2_found": p2_found, "p3_found": p3_found, "p3_clusters": p3_clusters, "p4_found": p4_found, "p7_found": p7_found, "p7_batches": p7_batches, "p8_found": p8_found, "p8_matches": p8_matches,
    "p8_clean": p8_clean, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_statistics": p10_statistics,
}
