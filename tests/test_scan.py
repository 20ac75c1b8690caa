"""Search of many queries without postings: the rows of the search by postings, and no more disk than the input asks for."""

import os
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators import retrieval as R
from lexspark.operators import scan
from lexspark.plans import catalog
from lexspark.runtime import ensure_checkpoint_dir, shared_path

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(5)
    word = ["管理權人", "防火", "設備A1", "罰鍰", "檢修 EVO-814", "申報", "水幕噴頭", "應由", "x", "47", "所稱管理權人，指", "所稱設備：", "\x00", "𠀀"]
    rows = [(i, i // 9, i, rng.choice(["第3條", "第 三 條", "一、", None, "第4-1條"]), rng.choice([None, "第一章 總則", "罰則"]), "".join(rng.choice(word) for _ in range(rng.randrange(14)))) for i in range(1, 400)]
    ch = spark.createDataFrame(rows, "chunk_id long, version_id long, seq int, article_label string, heading string, content string")
    v = spark.createDataFrame([(i, i, 1, None) for i in range(45)], "version_id long, law_id long, version_no int, metadata_json string")
    laws = spark.createDataFrame([(i, ["消防設備管理辦法", "消防設備作業要點", "水幕噴頭認可基準", "水幕噴頭認可基準細則", "申報法"][i % 5] + "甲乙丙丁"[i % 4], "甲", "u") for i in range(45)], "law_id long, title string, category string, source_url string")
    return R.current_chunks(ch, v, laws).cache()


def asked(spark):
    q = ["管理權人的設備", "何謂管理權人", "請問消防設備管理辦法甲第三條？", "水幕噴頭認可基準細則乙第4條之1", "x 47 EVO-814", "是否包含水幕噴頭與設備A1？", "？", "ｑｑ", "ｑｑ定義", "罰則", "申報法丙的所有罰鍰", "防火管理人 不同場所 遴用", "第3條", "a", "", "應由" * 60 + "申報防火罰鍰"]
    return spark.createDataFrame(list(enumerate(q)), "query_id long, query string")


@pytest.mark.parametrize("embed", [R.md5_embedding, None])
def test_same_rows_as_by_postings(spark, chunks, embed):
    cols = ["query_id", "pos", "chunk_id", "vector_score", "lexical_score", "hybrid_score", "law_title", "content", "retrieval_mode"]
    old = R.hybrid_topk(asked(spark), R.build_index(chunks, embed=embed), 8, embed=embed).select(*cols).orderBy("query_id", "pos").collect()
    new = scan.hybrid_topk(asked(spark), R.build_index(chunks, postings=False), 8, embed=embed).select(*cols).orderBy("query_id", "pos").collect()
    assert len(old) > 100 and new == old
    few = [sorted(map(tuple, f(asked(spark), i, 3, candidates=5, embed=embed).select(*cols).collect())) for f, i in ((R.hybrid_topk, R.build_index(chunks, embed=embed)), (scan.hybrid_topk, R.build_index(chunks, postings=False)))]
    assert few[0] == few[1]


def test_blocks_leave_no_candidate_out(spark, chunks, monkeypatch):
    """Small blocks, guesses that hold and guesses that don't: always the k best by BM25."""
    q = asked(spark).unionByName(chunks.select((F.col("chunk_id") + 100).alias("query_id"), F.coalesce("content", F.lit("")).alias("query")))
    want = q.select("query_id", X.match_terms(F.col("query")).alias("terms")).orderBy("query_id").collect()
    vocabulary, path = shared_path(spark, "vocabulary"), shared_path(spark, "numbers")
    q.select(F.lit("term").alias("kind"), F.explode(X.match_terms(F.col("query"))).alias("value")).distinct().write.parquet(vocabulary)
    scan._rows_of_numbers(chunks, vocabulary, path, R.md5_embedding)
    v = scan._vocabulary(vocabulary)
    ids = np.concatenate([t.column("chunk_id").to_numpy() for _, t in scan._blocks(path, ["chunk_id"])])
    terms = [np.array([v.terms[x] for x in r.terms], np.int64) for r in want]
    index = R.write_postings(chunks, "chunk_id", list(R.INDEXED))
    for first, block, k in ((8, 16, 7), (50, 64, 30), (1_000, 1_000, 5), (40, 200, 300)):
        monkeypatch.setattr(scan, "FIRST", first)
        monkeypatch.setattr(scan, "BLOCK", block)
        best = {}
        for r in R.bm25_topk(q, index, k).collect():
            best.setdefault(r.query_id, set()).add(r.doc)
        found = scan._candidates(path, terms, len(v.terms), k)
        assert {r.query_id: set(ids[at].tolist()) for r, at in zip(want, found) if len(at)} == best, (first, block, k)


def test_routed_search_writes_no_multiple_of_its_input(spark):
    size = sum(os.path.getsize(f"{DATA}/{t}.parquet") for t in ("laws", "law_versions", "law_chunks", "eval_cases"))
    at = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    used = lambda: sum(f.stat().st_size for f in at.rglob("*") if f.is_file())
    before = used()
    assert catalog.queries()["routed_md5_search"](spark, DATA).count() > 3_000
    assert used() - before < 4 * size
