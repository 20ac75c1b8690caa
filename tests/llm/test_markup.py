import pytest

from lexspark.llm import markup as M
from lexspark.llm.markup import Flow, clean_texts, labelled, markup_pieces, read


def parts(t):
    return [(k, v) for k, v in read(t)[1] if k != "text"]


def test_markdown():
    t = "# 甲 #\n乙乙\n=====\n文**粗**字[連](https://a.example/1)`碼`。\n\n+ 項*一*\n+ 項二\n\n計算式為 $V = \\frac{n^2}{3}$ 。\n\n```python\nif a < 3:\n    b(1)\n```\n\n$$\nF = 2\n$$"
    assert parts(t) == [("heading", "甲"), ("heading", "乙乙"), ("list_item", "項一"), ("list_item", "項二"), ("formula", "V = \\frac{n^2}{3}"), ("code", "if a < 3:\n    b(1)"), ("formula", "F = 2")]
    assert ("text", "文粗字連碼。") in read(t)[1]


def test_wiki():
    t = "= 甲 =\n==乙==\n# 項[[條文6|一]]\n* '''項'''二\n<syntaxhighlight lang=\"python\">\nif a > 1:\n</syntaxhighlight>\n<math>F = k</math>\n[https://a.example/1 連]結\n[[Category:類]]"
    assert parts(t) == [("heading", "甲"), ("heading", "乙"), ("list_item", "項一"), ("list_item", "項二"), ("code", "if a > 1:"), ("formula", "F = k")]


def test_html():
    t = '<h1 id="s">甲</h1>\n<p>文<b>粗</b>&amp;<a href="https://a.example">連</a></p>\n<pre><code>if a &gt; 1:\n    b</code></pre>\n<div class="math">\\[F = k\\]</div>\n<ol><li>項<i>一</i><br/>續\n<li>項二</ol>'
    assert parts(t) == [("heading", "甲"), ("code", "if a > 1:\n    b"), ("formula", "F = k"), ("list_item", "項一續"), ("list_item", "項二")]


def test_tex():
    t = "\\documentclass{article}\n\\begin{document}\n\\section*{甲}\n文\\textbf{粗}{\\bf 體}\\href{https://a.example}{連}\n\\begin{itemize}\n  \\item 項\\emph{一}\n  \\item 100\\% 二\n\\end{itemize}\n\\begin{verbatim}\nif a > 1:\n\\end{verbatim}\n\\begin{equation}\nF = k\n\\end{equation}\n\\end{document}"
    assert parts(t) == [("heading", "甲"), ("list_item", "項一"), ("list_item", "100% 二"), ("code", "if a > 1:"), ("formula", "F = k")]


@pytest.mark.parametrize("t", ["A & B 兩棟合計 100% 計算。", "型號 A_12_B 與 #7 櫃併用。", "a<b 時取 b；a>b 時取 a。", "費用以 NT$500 至 NT$2,000 計，* 號者另計。", "路徑 D:\\倉儲\\名冊 之檔案。", "註[1]：同表[2]。", "代碼｜名稱 3 | 5 | 7。", "一、甲\n（溫度 < 60℃ 且壓力 > 5 公斤者）", ""])
def test_plain_stays(t):
    assert labelled(t) == [] and read(t)[0] is False


def test_residue_in_plain_text():
    for t in ("第1條 甲<br>乙。", "第1條 甲&nbsp;&nbsp;乙。", "<!--3-->第1條", "甲\\\\乙\\hfill{}", "甲{{nowrap|乙}}。", "費用**由單位負擔。**"):
        has, p = read(t)
        assert has and not any(c in "".join(v for _, v in p) for c in "<>&{}*\\")


def test_flow_is_a_minimum_cut():
    g = Flow(4)
    g.edge(2, 0, 3.0)
    g.edge(0, 1, 1.0, 1.0)
    g.edge(1, 3, 2.0)
    assert g.source_side(2, 3) == {2, 0}


def test_tables(spark):
    df = spark.createDataFrame([(1, "# 甲\n## 乙", "k"), (1, "# 甲\n## 乙", "k"), (2, "無", "k"), (3, None, "k"), (4, "", "k"), (5, "* 項\n" * 300, "k")], "version_id long, raw_text string, piece string")
    m = markup_pieces(df, "version_id", "raw_text")
    assert sorted(map(tuple, m.collect())) == [(1, "heading", "乙"), (1, "heading", "甲"), (1, "markup", ""), (5, "list_item", "項"), (5, "markup", "")]
    c = {r.record_id: (r.has_markup, len(r.parts)) for r in clean_texts(df, "version_id", "raw_text").collect()}
    assert c == {1: (True, 2), 2: (False, 1), 5: (True, 300)}
    assert markup_pieces(df.limit(0), "version_id", "raw_text").count() == 0


def test_the_cut_decides_place_by_place(monkeypatch):
    plain = [f"第{n}行是普通文字。" for n in range(120)]
    text = "\n".join(["**標題**", *plain[:60], "* 號者為必填欄位說明", *plain[60:]])
    markup, content = M.cut(text)
    assert [x[2] for x in markup] == ["strong"] and [x[2] for x in content] == ["star"]
    has, parts = M.read(text)
    assert has and ("text", "* 號者為必填欄位說明") in parts and ("text", "標題") in parts
    assert [k for k, _ in parts] == ["text"] * 122
    # among others of its kind the same line is a list item
    listed = "\n".join(["**標題**", "* 甲", "* 號者為必填欄位說明", "* 乙", *plain])
    assert ("list_item", "號者為必填欄位說明") in M.read(listed)[1]
    # without the cut, every place would be converted
    monkeypatch.setattr(M, "cut", lambda t: ([x[:4] for x in M.candidates(t)], []))
    assert ("list_item", "號者為必填欄位說明") in M.read(text)[1]


def test_content_keeps_its_signs_beside_markup():
    for sign in ("價格為NT$9，另收$8", "C# 與 F# 併用", "a<b 時取 b", "3 * 4 * 5", "\U000f0041與* 併用"):
        text = "== 標題 ==\n" + "文字。\n" * 50 + sign + "\n" + "文字。\n" * 50
        assert ("text", sign) in M.read(text)[1]


def test_long_templates():
    long = "字" * 5_000
    assert M.read(f"== 標題 ==\n{{{{模板|{long}}}}}\n")[1] == [("heading", "標題"), ("text", long)]


ONE_OF_EACH = {
    "tag": "甲<br>乙", "comment": "<!--3-->甲", "entity": "甲&amp;乙", "fence": "甲\n~~~python\nif a > 1:\n~~~\n乙", "atx": "# 甲", "setext": "甲\n---", "strong": "**甲**", "emphasis": "*甲*", "tick": "`甲`",
    "link": "[甲](/a)", "star": "+ 甲", "number": "1. 甲", "title": "== 甲 ==", "quotes": "''甲''", "wikilink": "[[甲]]", "extlink": "[https://a.example 甲]", "template": "{{甲}}",
    "environment": "\\begin{document}", "command": "\\item 甲", "group": "{\\bf 甲}", "newline": "甲\\\\", "escape": "100\\%", "display": "$$甲$$", "inline": "$x^2$",
}


def test_no_mark_is_left_unread():
    assert set(ONE_OF_EACH) == {k for k, *_ in M.MARKS}
    for kind, t in ONE_OF_EACH.items():
        assert kind in {x[2] for x in M.candidates(t)} and M._MAYBE.search(t), kind


def test_fences_of_tildes_alone_are_found(spark, tmp_path):
    t = ONE_OF_EACH["fence"]
    assert read(t) == (True, [("text", "甲"), ("code", "if a > 1:"), ("text", "乙")])
    spark.createDataFrame([(1, t), (2, "甲~乙"), (3, None)], "version_id long, raw_text string").write.parquet(f"{tmp_path}/law_versions.parquet")
    pages = [(1, t, "text/markdown", 200), (2, t, "text/html; charset=utf-8", 200), (3, t, "text/plain", 200), (4, t, "text/markdown", 404), (5, t, "application/x-latex", 200)]
    spark.createDataFrame(pages, "page_id long, text string, content_type string, status_code int").write.parquet(f"{tmp_path}/fetched_pages.parquet")
    found = sorted(map(tuple, M.p5_found(spark, str(tmp_path)).collect()))
    assert found == [(tbl, i, k, v) for tbl, i in (("fetched_pages", 1), ("fetched_pages", 5), ("law_versions", 1)) for k, v in (("code", "ifa>1:"), ("markup", ""))]
