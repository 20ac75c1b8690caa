from pyspark.sql import functions as F

from lexspark.sources import html as H

LIST = '<html><body><a href="LawDetail.aspx?lsid=FL001&amp;ldate=1">1. 消防法</a><a href="/lawdetail.aspx?LSID=fl001">消防法</a><a href="LawDetail.aspx?lsid=FL2">（廢）舊法</a><a href="javascript:void(0)">選單</a><a href="https://other.example/law?lsid=3">他站</a><a href="LawDetail.aspx?lsid=FL4">甲規則</a><a href="files/a.pdf">附表</a><iframe src="/download?id=1"></iframe></body></html>'
PAGE = "<html><head><title>站</title><script>x</script></head><body><header>頁首</header><nav>選單</nav><h1>甲規則</h1><main><p>第1條 " + "甲" * 120 + "<p>第2條 乙</main><footer>尾</footer></body></html>"


def pages(spark, *rows):
    return spark.createDataFrame([(i, f"https://law.example/list/{i}", h) for i, h in enumerate(rows)], "page_id long, url string, html string")


def test_links(spark):
    p = pages(spark, LIST, None, "")
    r = [(x.title, x.source_key) for x in H.law_links(p).orderBy("pos").collect()]
    assert r == [("消防法", "lsid:FL001"), ("甲規則", "lsid:FL4")]
    assert sorted(x.link for x in H.attachments(p).collect()) == ["https://law.example/download?id=1", "https://law.example/list/files/a.pdf"]


def test_text_and_title(spark):
    r = pages(spark, PAGE, "<p>短", None).select(H.page_text(F.col("html")).alias("t"), H.page_title(F.col("html")).alias("n")).collect()
    assert r[0].t == "第1條 " + "甲" * 120 + "\n第2條 乙" and r[0].n == "甲規則" and r[1].t == "短" and r[2].t is None


def test_selectors():
    root = H.parse('<div id="a" class="x y"><p>1</p><ul><li class="x">2</li><li data-k="v">3</li></ul></div><p class="x">4</p>')
    said = lambda q: [n.text().strip() for n in root.select(q)]
    assert said("p") == ["1", "4"] and said("div.x.y#a p") == ["1"] and said("div li.x, p.x") == ["2", "4"]
    assert said("div > li") == [] and said("div > ul > li") == ["2", "3"] and said("[data-k]") == said('li[data-k="v"]') == ["3"] and said("[data-k=w]") == []
    assert root.first("h1") is None and said("*.x > p") == ["1"]
