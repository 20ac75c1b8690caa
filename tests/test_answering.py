import json

import pytest
from pyspark.sql import functions as F

from lexspark.operators import answering as G

HIT = "query_id long, place long, chunk_id long, law_id long, law_title string, version_no int, article_label string, heading string, content string, source_url string, hybrid_score double, retrieval_mode string"


@pytest.fixture(scope="module")
def data(spark):
    q = spark.createDataFrame([(1, "甲"), (2, "乙"), (3, "丙"), (4, "最新消防法")], "query_id long, query string")
    h = spark.createDataFrame([(i, 1, i, 1, "法", 1, "第1條", None, f"文{i}", "u", 0.9, "hybrid") for i in (1, 2, 4)], HIT)
    return q, h


def rows(df):
    return {r.query_id: r for r in df.collect()}


def test_statuses(spark, data):
    q, h = data

    def complete(p):
        if "retry_instruction" in p:
            return "完整了 [1]。"
        return "斷" if "文1" in p else "沒有引用。" if "文2" in p else {"content": "好 [1]。", "done": False, "done_reason": "length"}

    r = rows(G.answer_questions(q, h, complete))
    assert {i: (x.answer_status, x.retry_count, x.citations) for i, x in r.items()} == {1: ("ok", 1, [1]), 2: ("llm_error", 0, None), 3: ("no_evidence", None, None), 4: ("ok", 1, [1])}
    assert {x.web_search_status for x in r.values()} == {"disabled"} and r[2].answer is None
    assert {x.answer_status for x in rows(G.answer_questions(q, h, None)).values()} == {"llm_disabled", "no_evidence"}

    def fails(p):
        raise ConnectionError("x")

    assert rows(G.answer_questions(q, h, fails))[1].error == "ConnectionError: x"


def test_web_first_and_after_an_answer_that_lacks(spark, data):
    q, h = data
    asked = []

    def search(queries):
        asked.append(sorted(r.query_id for r in queries.collect()))
        return queries.where("query_id <> 3").select("query_id", F.lit(1).cast("long").alias("place"), F.lit("題").alias("title"), F.lit("https://x").alias("url"), F.lit("網頁").alias("content"), F.lit(None).cast("string").alias("source_date"), F.lit(None).cast("string").alias("source_date_label"))

    def complete(p):
        return "依網頁 [2]。" if "網頁補充" in p.split("<evidence>")[1] else "無法確認 [1]。" if "文1" in p else "好 [1]。"

    r = rows(G.answer_questions(q, h, complete, search))
    assert asked == [[3, 4], [1]]
    assert {i: (x.web_search_status, x.citations) for i, x in r.items()} == {1: ("used", [2]), 2: ("not_needed", [1]), 3: ("no_results", None), 4: ("used", [2])}
    j = {k: json.loads(v.response) for k, v in rows(G.responses(G.answer_questions(q, h, complete, search), h)).items()}
    assert j[1]["web"][0]["url"] == "https://x" and j[1]["hits"][0]["chunk_id"] == 1 and j[3]["answer_status"] == "no_evidence"


def test_limits(spark, tmp_path):
    m = spark.createDataFrame([("a",), ("b",), ("c",)], "model string")

    def client(name):
        if name == "c":
            raise TimeoutError
        return {"llm.context_length": 8192} if name == "a" else {}

    assert {r.model: r.found_context for r in G.probe_context(m, client).collect()} == {"a": 8192, "b": None, "c": None}
    p = spark.createDataFrame([("a", 4096, 8192), ("b", 16384, None)], "model string, context_tokens int, found_context int")
    assert G.longest_context(p).first().context_tokens == 16384
    G.write_json(p, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
