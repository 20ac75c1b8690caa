import pytest
from pyspark.sql import functions as F

from lexspark.operators import evidence as E
from lexspark.operators import retrieval as R
from lexspark.operators import selection as S
from lexspark.functions import text as X

PENALTY = "第33條 第34條 第35條 第35-1條 第35-2條 第36條 第37條 第38條 第39條 第40條 第41條 第41-1條 第42條 第42-1條 第42-2條 第42-3條 第42-4條 第43條 第43-1條 第43-2條 第44條".split()
ACT = [("第1條", None, "為預防火災、搶救災害及緊急救護，以維護公共安全。"), ("第2條", None, "本法所稱管理權人，係指依法令或契約對各該場所具有實際支配管理權者。"), ("第3條", None, "本法所稱主管機關：在中央為內政部；在直轄市為直轄市政府；在縣（市）為縣（市）政府。"), ("第13條", None, "管理權人應依規定設置消防安全設備並負責維護。")]
ACT += [(x, "第六章 罰則", f"{x} 違反本法規定者，處新臺幣一萬元以下罰鍰。") for x in PENALTY] + [("第45條", "第六章 罰則", "第45條 （刪除）")]
RULE = [("一、", None, "各級消防主管機關應辦理年度查核，並彙整執行成果。")]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, 1, i, a, h, c) for i, (a, h, c) in enumerate(ACT, 1)] + [(100, 2, 1, *RULE[0])]
    ch = spark.createDataFrame(rows, "chunk_id long, version_id long, seq int, article_label string, heading string, content string")
    v = spark.createDataFrame([(1, 1, 1, None), (2, 2, 1, None)], "version_id long, law_id long, version_no int, metadata_json string")
    laws = spark.createDataFrame([(1, "消防法", "甲", "u1"), (2, "消防主管機關作業規定", "甲", "u2")], "law_id long, title string, category string, source_url string")
    return R.current_chunks(ch, v, laws).cache()


@pytest.fixture(scope="module")
def index(chunks):
    return R.build_index(chunks)


def ask(spark, *q):
    return spark.createDataFrame([(i, x) for i, x in enumerate(q)], "query_id long, query string")


def test_hybrid(spark, index):
    q = ask(spark, "管理權人消防安全設備", "請說明消防法規定義的管理權人", "請說明消防法規的主管機關?")
    h = {(r.query_id, r.pos): r for r in R.search(q, index, 3).collect()}
    assert h[0, 1].article_label == "第13條" and h[1, 1].article_label == "第2條" and h[2, 1].article_label == "第3條"
    full = {(r.query_id, r.pos): r for r in R.hybrid_topk(q, index, 3).collect()}
    assert full[1, 1].lexical_score >= 0.85 and full[2, 1].lexical_score == 1.0 and full[0, 1].vector_score > 0


def test_trigram_backend(spark, index):
    r = R.hybrid_topk(ask(spark, "管理權人應依規定設置消防安全設備"), index, 1, weight=0.72, lexical="trigram").first()
    assert r.article_label == "第13條" and 0 < r.lexical_score <= 1


def test_exact_and_missing_article(spark, index):
    r = R.search(ask(spark, "消防法第四十二條之一", "消防法第99條"), index, 8).collect()
    assert [(x.query_id, x.article_label, x.retrieval_mode, x.hybrid_score) for x in r] == [(0, "第42-1條", "exact_article", 1.0)]


def test_section(spark, chunks):
    scope = spark.createDataFrame([(1, "消防法", "罰則")], "query_id long, title string, heading_term string")
    r = [x.article_label for x in R.section_search(scope, chunks).orderBy("seq").collect()]
    assert r == PENALTY


def test_titles(spark):
    t = spark.createDataFrame([("消防法",), ("消防法施行細則",), ("甲乙丙丁戊己設置管理辦法",)], "title string")
    got = {(r.query_id, r.title) for r in R.matched_titles(ask(spark, "消防法施行細則第3條", "無", "請問甲乙丙丁戊己設置規定"), t).collect()}
    assert (0, "消防法施行細則") in got and len([g for g in got if g[0] == 0]) == 1 and not [g for g in got if g[0] == 1]


def test_bm25_edges(spark):
    d = spark.createDataFrame([(1, "防火管理", "x"), (2, "防火管理人", "x"), (3, None, "x"), (4, "", "x")], "id long, t string, term string")
    index = R.write_postings(d, "id", ["t"], buckets=3)
    r = R.bm25_topk(ask(spark, "防火管理", "", "無關"), index, 5).orderBy("rank").collect()
    assert [(x.query_id, x.doc) for x in r] == [(0, 1), (0, 2)]
    assert R.bm25_topk(ask(spark, "甲"), R.write_postings(d.limit(0), "id", ["t"]), 5).count() == 0
    assert R.bm25_topk(ask(spark), index, 5).count() == 0


def test_many_terms_are_shuffled_alike(spark, index, monkeypatch):
    q = ask(spark, "管理權人消防安全設備", "罰鍰")
    few = sorted(map(tuple, R.bm25_topk(q, index, 5).collect()))
    monkeypatch.setattr(R, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, R.bm25_topk(q, index, 5).collect())) == few and len(few) == 10


def test_queries_without_candidates_meet_all_provisions(spark, index):
    r = R.hybrid_topk(ask(spark, "？", "ｑｑ定義"), index, 3).orderBy("query_id", "pos").collect()
    assert [x.query_id for x in r] == [0, 0, 0, 1, 1, 1] and [x.chunk_id for x in r[:3]] == [1, 2, 3]
    assert {x.article_label for x in r if x.query_id == 1 and x.lexical_score == 0.55} == {"第2條", "第3條"}


def test_embedders(spark, chunks):
    calls = []

    def client(texts):
        calls.append(len(texts))
        return [[1.0, 0.0] if "罰" in t else [0.0, 1.0] for t in texts]

    embed = R.remote_embedding(client, 2)
    r = R.hybrid_topk(ask(spark, "罰鍰"), R.build_index(chunks, embed=embed), 2, embed=embed).collect()
    assert all(x.vector_score == 1.0 for x in r)
    with pytest.raises(Exception, match="wanted of 3 numbers"):
        chunks.select(R.remote_embedding(client, 3)(F.col("content"))).collect()

def test_evaluate(spark):
    hits = spark.createDataFrame([(1, "消防法施行細則", "第 3 條"), (2, "甲", None)], "query_id long, law_title string, article_label string")
    cases = spark.createDataFrame([(1, "消防法", "第3條"), (2, "乙", None), (3, "丙", "第1條")], "query_id long, expected_law string, expected_article string")
    assert tuple(R.evaluate(hits, cases).first()) == (3, 0.333333, 0.5)


def test_embedding(spark):
    v = ask(spark, "甲乙丙", "甲 乙丙", "").select(R.hash_embedding(F.col("query")).alias("v")).collect()
    assert v[0].v == v[1].v and abs(sum(x * x for x in v[0].v) - 1) < 1e-5 and not any(v[2].v) and len(v[0].v) == 384


HIT = "query_id long, pos long, chunk_id long, law_id long, law_title string, version_no int, article_label string, heading string, content string, source_url string, hybrid_score double"


def hits(spark, laws, **kw):
    return spark.createDataFrame([(1, i, i, law, kw.get("title", lambda x: f"法{x}")(law), 1, f"第{i}條", None, kw.get("content", lambda j: f"文{j}")(i), f"u{law}", 1 - i / 100) for i, law in enumerate(laws, 1)], HIT)


def greedy(laws, k):
    slots, out, seen, n = min(k, max(1, (3 * k + 3) // 4)), [], set(), {}
    for i, law in enumerate(laws):
        if law not in seen and len(out) < slots:
            out.append(i)
            seen.add(law)
    for i in out:
        n[laws[i]] = 1
    for i, law in enumerate(laws):
        if i not in out and n.get(law, 0) < 2 and len(out) < k:
            out.append(i)
            n[law] = n.get(law, 0) + 1
    return (out + [i for i in range(len(laws)) if i not in out])[:k]


def test_diversity_against_the_greedy(spark):
    import random

    rng = random.Random(2)
    for k in (1, 3, 4, 8):
        laws = [rng.randrange(5) for _ in range(20)]
        got = [r.chunk_id - 1 for r in S.diverse_topk(hits(spark, laws), k).orderBy("place").collect()]
        assert got == greedy(laws, k), (k, laws)


def test_dedupe(spark):
    h = spark.createDataFrame([(1, 1, 1, 1, "a", 1, "第 1 條", None, "甲 乙", "u", 1.0), (1, 2, 2, 1, "a", 1, "第1條", "", "甲乙", "u", 0.9), (1, 3, 3, 1, "a", 1, None, None, "甲乙", "u", 0.8), (1, 4, 4, 1, "a", 1, None, None, "甲乙", "u", 0.7)], HIT)
    assert [r.chunk_id for r in S.dedupe(h).orderBy("pos").collect()] == [1, 3, 4]


def test_rerank(spark):
    h = hits(spark, range(6), content=lambda i: "應由負責" if i == 6 else "文")
    assert [r.chunk_id for r in S.rerank_candidates(h, 2, 4).orderBy("slot").collect()] == [1, 2, 6, 3]
    ids = spark.createDataFrame([('雜 {"ranked_chunk_ids": [5, 999, "5", true, 2]} 尾',), ("無",)], "a string").select(S.ranked_ids(F.col("a")).alias("x")).collect()
    assert ids[0].x == [5, 999, 2] and ids[1].x is None
    order = spark.createDataFrame([(1, 5, 1), (1, 2, 2)], "query_id long, chunk_id long, rank int")
    assert [r.chunk_id for r in S.rerank(h, order, 4).orderBy("place").collect()] == [5, 2, 1, 3]


def test_context_and_gate(spark):
    h = S.diverse_topk(hits(spark, [1, 1, 2]), 3)
    c = S.evidence_context(h).first().context
    assert "[1]\n法規：法1 版本：1 來源：u1" in c and "來源：同 [1]" in c
    q = ask(spark, "a", "b", "c").withColumn("query_id", F.col("query_id") + 1)
    modes = spark.createDataFrame([(1, 0.0, "structural_section"), (2, 0.2, "exact_article")], "query_id long, hybrid_score double, retrieval_mode string")
    assert {r.query_id: r.needs_web for r in S.needs_web(modes, q).collect()} == {1: False, 2: True, 3: True}


def test_coverage(spark):
    title = lambda law: {1: "甲要點", 2: "乙規則", 3: "丙法"}.get(law, f"要點{law}")
    h = hits(spark, [1, 1, 1, 4, 5, 6, 7, 8, 9, 10, 2, 3], title=title)
    q = spark.createDataFrame([(1, "乙規則相關規定？")], "query_id long, query string")
    t = spark.createDataFrame([(1, "乙規則")], "query_id long, title string")
    none = h.limit(0).withColumn("facet", F.lit("x")).withColumn("facet_no", F.lit(1))
    r = [x.law_title for x in S.with_coverage(h, none, q, t, 8).orderBy("place").collect()]
    assert r[0] == "乙規則" and r[1] == "丙法" and len(r) == 8


def test_ranked_hits_and_coverage(spark, index):
    q = ask(spark, "消防法第13條", "管理權人是否包含主管機關、預防火災？", "消防安全設備", "消防法的所有罰則", "管理權人與主管機關的差異")
    r = E.answer_evidence(q, index, 3).collect()
    by = {}
    for x in sorted(r, key=lambda x: (x.query_id, x.place)):
        by.setdefault(x.query_id, []).append(x)
    assert [(x.article_label, x.mode, x.complete) for x in by[0]] == [("第13條", "exact_article", None)]
    shown = "".join(x.content for x in by[1])
    assert len(by[1]) == 3 and "主管機關" in shown and "預防火災" in shown and by[1][0].mode == "hybrid"
    assert len(by[2]) == 3 and [x.article_label for x in by[3]] == PENALTY
    assert all((x.complete, x.total_matches, x.scope_law_title, x.scope_heading) == (True, len(PENALTY), "消防法", "第六章 罰則") for x in by[3])


def test_reranker_and_its_failures(spark, index):
    q = ask(spark, "管理權人與主管機關的差異")
    base = [x.chunk_id for x in E.ranked_hits(q, index, 3).orderBy("place").collect()]
    said = []

    def complete(prompt):
        said.append(prompt)
        ids = [int(line[1 : line.index("]")]) for line in prompt.split("\n") if line.startswith("[")]
        return f'好的：{{"ranked_chunk_ids": [{ids[2]}, 99999, {ids[0]}]}}'

    got = [x.chunk_id for x in E.ranked_hits(q, index, 3, complete=complete).orderBy("place").collect()]
    assert got == [base[2], base[0], base[1]]

    def broken(prompt):
        raise TimeoutError

    assert [x.chunk_id for x in E.ranked_hits(q, index, 3, complete=broken).orderBy("place").collect()] == base
    assert [x.chunk_id for x in E.ranked_hits(q, index, 3, complete=lambda p: "不知道").orderBy("place").collect()] == base


def test_web_evidence(spark):
    q = spark.createDataFrame([(1, "請查詢滅焰毯認可基準的中央主管機關公告"), (2, "最新消防法"), (3, "民國100年的公告，內政部"), (4, "設備是否包含滅焰毯？")], "query_id long, query string")
    first = spark.createDataFrame([(1, 1, "預告「滅焰毯認可基準修正」", "https://a.gov.example/1", "舊"), (1, 2, "外", "https://evil.example/1", "x"), (2, 1, "甲", "https://a.gov.example/2", "修正日期：民國110年13月1日 修正日期：民國110年2月1日"), (2, 2, "乙", "https://a.gov.example/3", "公告日期 2023/5/6"), (4, 1, "無關", "https://a.gov.example/4", "x"), (4, 2, "滅焰毯", "https://a.gov.example/5", "y")], "query_id long, pos int, title string, url string, content string")
    f = {r.query_id: r.followup for r in E.followups(q, first, ["gov.example"]).collect()}
    assert f == {1: "滅焰毯認可基準修正 內政部 修正 最新 site:gov.example", 2: "最新消防法 現行 修正日期"}
    focused = spark.createDataFrame([(2, 1, "丙", "https://a.gov.example/3", "公告日期 2023/5/6"), (2, 2, "丁", "http://a.gov.example/9", "x")], first.schema)
    fetched = spark.createDataFrame([("https://a.gov.example/1", " ", "發布日期：113年1月2日 全文")], "url string, title string, content string")
    r = {(x.query_id, x.place): x for x in E.web_results(q, first, focused, fetched, ["gov.example"]).collect()}
    assert {k: v.url[-1] for k, v in r.items()} == {(1, 1): "1", (2, 1): "3", (2, 2): "2", (4, 1): "5"}
    assert (r[1, 1].source_date, r[1, 1].source_date_label, r[2, 1].title, r[2, 2].source_date) == ("2024-01-02", "發布日期", "丙", "2021-02-01")
    local = spark.createDataFrame([(2, 1), (2, 2)], "query_id long, place long")
    c = {x.query_id: x.context for x in E.web_context(E.web_results(q, first, focused, fetched, ["gov.example"]), local).collect()}
    assert c[2].startswith("[3] 官方網頁補充資料\n標題：丙") and "[4]" in c[2] and "來源日期（公告日期）：2023-05-06" in c[2] and c[1].startswith("[1]")
