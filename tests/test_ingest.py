import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexspark.functions import urls as U
from lexspark.operators import ingest as I
from lexspark.operators import versioning as V
from lexspark.sources import readers

AT = dt.datetime(2024, 1, 1)
BODY = "<html><head><title>站</title></head><body><main><h1>甲規則</h1><p>法規名稱：甲規則</p><p>發布日期：民國100年1月2日</p><p>第1條 管理權人應定期檢測並檢附紀錄。</p><p>第2條 違反者處罰鍰。</p>{}</main></body></html>"
PAGE = "page_id long, source_key string, url string, html string, fetched_at timestamp_ntz"


def pages(spark, *rows):
    return spark.createDataFrame([(i, f"k{i}", f"https://a.example/law.aspx?lsid=FL{i}", h, AT) for i, h in rows], PAGE)


def reader():
    def read(content, cap):
        text = content.removeprefix(b"%PDF-").decode()
        return ([text], None) if len(text) < 100 else (None, "too many pages")

    return read  # a function of a function travels to the workers by value


def test_parsed_laws(spark):
    r = {x.page_id: x for x in I.parsed_laws(pages(spark, (1, BODY.format("")), (2, None), (3, "<p>無</p>"))).collect()}
    assert (r[1].title, r[1].n_chunks, r[1].first_label, r[1].last_label, r[1].meta.published_date) == ("甲規則", 2, "第1條", "第2條", "民國100年1月2日")
    assert len(r[1].content_hash) == 64 and set(r) == {1, 3} and r[3].n_chunks == 1


def test_attachments_one_page_deep(spark):
    links = '<a href="/file/a.pdf">附</a><a href="/file_list.aspx">列</a><a href="/file/x.doc">文</a><a href="https://b.example/file.pdf">外</a><a href="/file/long.pdf">長</a><a href="/file/bad.pdf">壞</a>'
    site = {
        "/file/a.pdf": ("application/pdf", b"%PDF-" + "甲".encode() * 20),
        "/file_list.aspx": ("text/html", '<a href="/GetFile.ashx?id=1">一</a><a href="/file/a.pdf">同</a><a href="/file_list2.aspx">又</a>'.encode()),
        "/GetFile.ashx?id=1": ("application/octet-stream", b"%PDF-" + "乙".encode() * 20),
        "/file_list2.aspx": ("text/html", b'<a href="/file/deep.pdf">x</a>'),
        "/file/x.doc": ("application/msword", b"x"),
        "/file/long.pdf": ("application/pdf", b"%PDF-" + b"x" * 200),
    }

    def get(url):
        return site[url.removeprefix("https://a.example")]

    got = I.expanded_attachments(pages(spark, (1, BODY.format(links))), get, reader()).orderBy("no").collect()
    assert [(x.label, (x.text or "")[:1], x.reason) for x in got] == [("a.pdf", "甲", None), ("GetFile.ashx", "乙", None), ("file_list2.aspx", "", "no PDF"), ("x.doc", "", "no PDF"), ("long.pdf", "", "too many pages"), ("bad.pdf", "", "KeyError: '/file/bad.pdf'")]

    def refuses(url):
        raise readers.Blocked("403")

    with pytest.raises(Exception, match="403"):
        I.expanded_attachments(pages(spark, (1, BODY.format(links))), refuses, reader()).collect()


def test_ingest_twice(spark):
    t = V.empty_tables(spark)

    def get(url):
        return "application/pdf", b"%PDF-" + "附件文字".encode() * 6

    one = pages(spark, (1, BODY.format('<a href="/file/a.pdf">附</a>')), (2, BODY.format("").replace("甲", "乙")), (3, "<p>短</p>"))
    report, added = I.ingest_pages(one, t["laws"], t["law_versions"], get, reader())
    assert {r.source_key: (r.status, r.reason) for r in report.collect()} == {"k1": ("inserted", None), "k2": ("inserted", None), "k3": ("error", "too short")}
    laws, versions, chunks = (added[n].cache() for n in ("laws", "law_versions", "law_chunks"))
    v = {r.raw_text.split("\n")[0]: r for r in versions.collect()}
    assert v["甲規則"].raw_text.endswith("附件：a.pdf\n" + "附件文字" * 6) and '"parsed":1' in v["甲規則"].metadata_json and chunks.count() == 5
    full = versions.withColumn("is_current", F.lit(True))

    def never(url):
        raise AssertionError(url)

    report, more = I.ingest_pages(one, laws, full, never, reader())
    assert {r.source_key: r.status for r in report.collect()} == {"k1": "unchanged", "k2": "unchanged", "k3": "error"}
    assert [more[n].count() for n in more] == [0, 0, 0]
    report, more = I.ingest_pages(one, laws, full, never, reader(), revision=9)
    assert {r.status for r in report.collect()} == {"reprocess_required", "error"}
    changed = pages(spark, (1, BODY.format("<p>第3條 新增。</p>")))
    report, more = I.ingest_pages(changed, laws, full, get, reader())
    assert [(r.status, r.version_no) for r in report.collect()] == [("inserted", 2)] and more["laws"].count() == 0 and more["law_chunks"].count() == 3


def test_letters(spark):
    eid = "A00001,內授消,1120000001,20230506"
    table = "<table><tr><td>發文字號：</td><td>第1120000001號</td></tr><tr><td>主旨</td><td>" + "旨" * 60 + "</td></tr><tr><td>說明</td><td>" + "說" * 3000 + "</td></tr></table>"
    lines = "<div>1120000001</div><p>主旨：</p><p>" + "旨" * 50 + "</p><p>說明</p><p>" + "說" * 50 + "</p><p>又</p>"
    src = spark.createDataFrame([(1, eid, table), (2, eid, lines), (3, eid, lines.replace("1120000001", "9")), (4, eid, "<p>1120000001</p><p>主旨</p><p>短</p>"), (5, eid, None)], "page_id long, eid string, html string")
    d = I.letters(src).cache()
    r = {x.page_id: x for x in d.collect()}
    assert {k: x.reason for k, x in r.items()} == {1: None, 2: None, 3: "another number", 4: "too short"} and r[1].title == "消防署函釋（1120000001）"
    assert [s.label for s in r[2].sections] == ["主旨", "說明"] and r[2].sections[1].value.endswith("\n又") and r[1].meta == {"發文字號": "第1120000001號"}
    c = I.letter_chunks(d.where("page_id = 1")).orderBy("seq").collect()
    assert [x.article_label for x in c] == ["主旨", "說明 1", "說明 2"] and c[2].content.startswith("發文字號：第1120000001號\n")
    v = I.letter_versions(d.where("page_id = 1")).first()
    assert v.source_key == f"fint:{eid}" and len(v.content_hash) == 64
    dates = spark.createDataFrame([(eid,), ("A,b,1,20231301",), ("x",)], "e string").select(I.letter_date(F.col("e")).alias("d")).collect()
    assert [x.d for x in dates] == ["民國112年5月6日", None, None]


def test_pdf_checks_and_store(tmp_path):
    assert I.pdf_page_checks(["第 112 號 " + "字" * 20, "字" * 25], "112")[1] is None
    assert I.pdf_page_checks(["字" * 25], "112")[1] == "another number" and I.pdf_page_checks(["112" + "字" * 25, " "], "112")[1] == "no text on page 2"
    a, b = I.store_file(b"x", str(tmp_path)), I.store_file(b"x", str(tmp_path))
    assert a == b and len(list(tmp_path.iterdir())) == 1


def test_urls(spark):
    u = ["HTTP://A.example:8080/P?b=2&A=x%20y*~", "https://a.example/GNFA/x.aspx?LSID=fl1&ldate=2020", "https://a.example/x"]
    r = spark.createDataFrame([(x,) for x in u], "u string").select(U.source_key(F.col("u")).alias("k"), U.print_url(F.col("u")).alias("p")).collect()
    assert [x.k for x in r] == ["http://a.example:8080/P?a=x+y%2A~&b=2", "lsid:FL1", "https://a.example/x"]
    assert [x.p for x in r] == [None, "https://a.example/print.aspx?lsid=FL1&ldate=2020", None]
    assert U.category_urls([" a1", "A2", "a1", ""], {"A1": "u1", "A2": "u2"}) == ["u1", "u2"]
    for bad in ([], [" "], ["A9"]):
        with pytest.raises(ValueError):
            U.category_urls(bad, {"A1": "u1"})
