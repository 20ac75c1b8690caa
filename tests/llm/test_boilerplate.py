import numpy as np

from lexspark.llm import boilerplate as B

PAGE = '<html><head><title>站</title></head><body><header><ul><li><a href="/">首頁</a><li>English</ul></header><main><p>法規名稱：甲乙設置規則<p>發布日期：民國102年8月25日<p>主管機關：防護總署<p>第1條 管理權人應定期檢測，並檢附紀錄。&amp;<p>公告欄應載明：首頁、最新消息及下載專區之位置。<p>第2條 （刪除）</main><footer>瀏覽人次：12<br>© 2020 某法規資料庫 All Rights Reserved.</footer></body></html>'
PLAIN = "某法規資料庫\n首頁 > 登入 > 法規內容\n甲乙設置規則\n發布日期：民國102年8月25日\n主管機關：防護總署\n第1條 管理權人應定期檢測，並檢附紀錄。\n某法規資料庫\n第 2/3 頁　列印時間：113/01/02\n第2條 違反者處罰鍰。\n回首頁\n瀏覽人次：5"


def test_body():
    m = B.Crf.load()
    assert B.body(PAGE, True, m).split("\n") == ["法規名稱：甲乙設置規則", "發布日期：民國102年8月25日", "主管機關：防護總署", "第1條 管理權人應定期檢測，並檢附紀錄。&", "公告欄應載明：首頁、最新消息及下載專區之位置。", "第2條 （刪除）"]
    assert B.body(PLAIN, False, m).split("\n") == ["甲乙設置規則", "發布日期：民國102年8月25日", "主管機關：防護總署", "第1條 管理權人應定期檢測，並檢附紀錄。", "第2條 違反者處罰鍰。"]
    assert B.body("首頁\n登入\n回首頁", False, m) is None and B.body("", True, m) is None and B.body("<p", True, m) is None


def test_fit_learns_and_viterbi_is_best():
    pages = [([["x"] if k == 3 else ["y"] for k in y], y) for y in ([0, 1, 2, 3, 3, 0], [0, 0, 1, 2, 3, 0], [1, 2, 3, 0, 0]) * 10]
    m = B.fit(pages, rounds=60)
    assert all(y == m.decode(f) for f, y in pages)
    rng = np.random.default_rng(0)
    r = B.Crf(["a", "b"], rng.normal(size=(2, 4)), rng.normal(size=(5, 5)))
    feats = [["a"], ["b"], ["a", "b"], []]
    e = r.scores(feats)
    best = max(np.ndindex(4, 4, 4, 4), key=lambda y: r.t[4, y[0]] + sum(e[i, k] for i, k in enumerate(y)) + sum(r.t[a, b] for a, b in zip(y, y[1:])) + r.t[y[-1], 4])
    assert list(best) == r.decode(feats)


def test_accuracy_on_layouts_left_out_of_the_fit(spark):
    labelled = B.training_pages(spark, "/root/testdata/sf0.01")
    parts = B.left_out(labelled, 2)
    assert sum(n for _, n, _, _ in parts) == len(labelled) > 100 and all(kinds > 3 for kinds, *_ in parts)
    assert all(block_share >= 0.99 and page_share >= 0.9 for _, _, block_share, page_share in parts)


def test_batches_label_as_single_pages_do():
    m = B.Crf.load()
    pages = [B.blocks(PAGE, True), B.blocks(PLAIN, False), [], B.blocks("首頁", False), B.blocks(PLAIN + "\n" + PLAIN, False)]
    assert np.allclose(m.emissions(pages), np.vstack([m.scores(B.features(p)) for p in pages if p]))
    assert [y.tolist() for y in m.label(pages)] == [m.decode(B.features(p)) for p in pages]
    assert m.label([]) == [] and [len(y) for y in m.label([[], []])] == [0, 0]


def test_sentences_at_the_end_are_the_laws():
    m = B.Crf.load()
    for last in ("A & B 兩棟合計 100% 計算。", "代碼｜名稱｜數量 3 | 5 | 7。", "a<b 時取 b；a>b 時取 a。"):
        assert B.body(PLAIN.replace("\n回首頁", f"\n{last}\n回首頁"), False, m).split("\n")[-1] == last


def test_blocks_of_broken_html():
    assert B.blocks("<!-- a > b --><p title='x>y'>甲<script>if (a<b) c</script>乙<br>丙 &lt;p&gt;<li>丁", True) == [(t, B._path(p)) for t, p in (("甲乙", ("p",)), ("丙 <p>", ("p",)), ("丁", ("p", "li")))]
    assert [t for t, _ in B.blocks("<head><title>x</title><body>a < b <b", True)] == ["a < b <b"]
    assert B.blocks("<script>x", True) == []


def test_table(spark):
    df = spark.createDataFrame([(1, PAGE, "text/html; charset=utf-8", "b"), (1, PAGE, "text/html; charset=utf-8", "b"), (2, PLAIN, "text/plain", "b"), (3, None, "text/html", "b"), (4, "", None, "b"), (5, "首頁\n登入", None, "b")], "page_id long, text string, content_type string, body string")
    assert {r.page_id for r in B.main_bodies(df).collect()} == {1, 2} and B.main_bodies(df).count() == 2
    assert B.main_bodies(df.limit(0)).count() == 0
