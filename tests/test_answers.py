from pyspark.sql import functions as F

from lexspark.functions import answers as A
from lexspark.functions.udtf import register


def test_directive(spark):
    r = spark.createDataFrame([(" /WEB 問題 ",), ("/website",), ("/web",), ("",)], "q string").select(A.web_request(F.col("q"), F.lit("auto")).alias("x")).collect()
    assert [(x.x.query, x.x.mode) for x in r] == [("問題", "force"), ("/website", "auto"), (None, "force"), (None, "auto")]


def test_checks(spark):
    rows = [("完整。", True, "stop"), ("完整。", True, "LENGTH"), ("- 甲", True, None), ("", True, None), ("沒有句尾但是這一行很長", True, None), ("見[1]** ", True, None), ("完整。", False, None)]
    r = spark.createDataFrame(rows, "a string, d boolean, r string").select(A.is_incomplete(F.col("a"), F.col("d"), F.col("r")).alias("x")).collect()
    assert [x.x for x in r] == [False, True, True, True, False, False, True]
    assert spark.range(1).select(A.admits_lack(F.lit("依現有內容無法確認。")).alias("x")).first().x


def test_limits(spark):
    p = spark.createDataFrame([("m", "x" * 3200), ("other", "")], "model string, prompt string")
    prof = spark.createDataFrame([("m", 16384, 4096, 4096)], "model string, context_tokens int, output_tokens int, found_context int")
    r = {x.model: x for x in A.token_limits(p, prof).collect()}
    assert (r["m"].effective_output, r["m"].context_tokens) == (384, 4096) and r["other"].effective_output == 2048


def test_limits_of_many_models(spark):
    n = 20_100
    prof = spark.range(n).selectExpr("concat('m', id) AS model", "16384 AS context_tokens", "100 AS output_tokens", "CAST(NULL AS INT) AS found_context")
    r = A.token_limits(prof.select("model", F.lit("x").alias("prompt")), prof).where("configured_output = 100")
    assert r.count() == n


def test_links(spark):
    r = spark.createDataFrame([("<見[1]與[3]>", [1])], "a string, c array<int>").select(A.link_citations(F.col("a"), F.col("c")).alias("x")).first().x
    assert r == '&lt;見<a href="#evidence-1">[1]</a>與[3]&gt;'
    name = "a" * 64 + ".pdf"
    m = f'{{"local_pdf_name": "{name}", "pdf_page_count": 3}}'
    rows = [(m, "第2頁"), (m, "第2頁 1"), (m, "第4頁"), (m, "頁"), (None, "第1頁"), ("{", "第1頁")]
    got = [x.x for x in spark.createDataFrame(rows, "m string, l string").select(A.pdf_link(F.col("m"), F.col("l")).alias("x")).collect()]
    assert got == [f"/app/static/local-pdfs/{name}#page=2"] * 2 + [None] * 4
    u = "https://law.example/FINT/Qry04.aspx?EID=A00001%2CX%2C1130000001%2C20240102"
    got = [x.x for x in spark.createDataFrame([(u,), (u.replace("https", "http"),), (u + "&EID=2",), (u + "#a",), (u[:-1],), ("x",)], "u string").select(A.letter_id(F.col("u"), "law.example", "/fint/qry04.aspx").alias("x")).collect()]
    assert got == ["A00001,X,1130000001,20240102", None, None, None, None, None]
    assert spark.range(1).select(A.page_lines(F.lit("列印時間：1\n a  b\n1/3\nhttps://x.example/y\n")).alias("x")).first().x == "a b"


def test_table_function(spark):
    register(spark)
    r = spark.sql("SELECT * FROM char_windows('abcdefghij', 4, 1)").collect()
    assert [(x.begins_at, x.piece) for x in r] == [(0, "abcd"), (3, "defg"), (6, "ghij")]
