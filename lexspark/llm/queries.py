"""The queries of this subpackage by name."""

from __future__ import annotations

from lexspark.llm import boilerplate, canon, knn, leak, markup, mojibake, pack, split


def queries() -> dict:
    return {"p1_found": split.p1_found, "p1_pieces": split.p1_pieces, "p2_found": canon.p2_found, "p2_canonical": canon.p2_canonical, "p2_classes": canon.p2_classes, "p4_found": boilerplate.p4_found, "p3_found": knn.p3_found, "p5_found": markup.p5_found, "p7_containers": pack.p7_containers, "p7_check": pack.p7_check, "p8_found": leak.p8_found, "p9_found": mojibake.p9_found}


# By brute force over all pairs: for small data only.
P3_SQL = """
WITH e AS (SELECT DISTINCT ON (chunk_id) chunk_id, embedding::DOUBLE[] AS v FROM law_chunks WHERE embedding IS NOT NULL AND len(embedding) = 384
AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM (SELECT x.chunk_id AS a, y.chunk_id AS b, round(list_cosine_similarity(x.v, y.v), 9) AS s FROM e x, e y WHERE x.chunk_id <> y.chunk_id))
SELECT DISTINCT least(a, b) AS chunk_id_1, greatest(a, b) AS chunk_id_2 FROM n WHERE r <= 5
"""


P7_SQL = "SELECT count(DISTINCT doc_id) AS items, CAST(0 AS BIGINT) AS astray, CAST(0 AS BIGINT) AS overfull, TRUE AS well_filled FROM documents WHERE text IS NOT NULL AND text <> ''"


def oracle_sql() -> dict:
    return {"p3_found": P3_SQL, "p7_check": P7_SQL}
