import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.functions import urls as U


def one(spark, fn, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


@pytest.mark.parametrize(("label", "canonical"), [("第四十二條", "第42條"), ("第 四十二 條 之 一", "第42-1條"), ("第9-1條", "第9-1條"), ("第一〇五條", "第105條"), ("第一百零五條", "第105條"), ("第十條", "第10條"), ("第1之2條之3", None), ("一、", None), ("", None), (None, None), ("第一萬二千條", "第12000條")])
def test_labels(spark, label, canonical):
    assert one(spark, X.canonical_label, label) == canonical


def test_hints(spark):
    assert one(spark, X.article_hint, "消防法第四十二條之一怎麼罰") == "第42-1條"
    assert one(spark, X.article_hint, "第三條與第五條") is None


def test_query_normalization(spark):
    assert one(spark, X.normalize_query, "  請再次協助說明，消防法 　第6條？！ ") == "消防法 第6條"
    assert one(spark, X.normalize_query, "請問請問") == "請問"


def test_terms(spark):
    assert one(spark, X.lexical_terms, "防火管理 A12 防火x") == ["防火", "火管", "管理", "防火管", "火管理", "a12", "防火x"]
    assert one(spark, X.lexical_terms, "") == []
    m = one(spark, X.match_terms, "防火管理")
    assert m[0] == "防火管理" and set(m) == {"防火管理", "防火管", "火管理", "防火", "火管", "管理"}
    assert one(spark, X.focus_terms, "管理權人是否包含自衛編組與避難引導嗎") == ["自衛編組", "避難引導"]
    assert one(spark, X.facets, "甲乙？丙丁是否包括戊己") == ["甲乙", "丙丁是否包括戊己", "戊己"]
    assert one(spark, X.defined_terms, "本法所稱管理權人，係指甲。所稱主管機關：乙") == ["管理權人", "主管機關"]


def test_intents(spark):
    assert one(spark, X.is_definition_query, "消防法規的主管機關") and not one(spark, X.is_definition_query, "管理權人的義務")
    assert one(spark, X.is_exhaustive_query, "列出全部罰則") and not one(spark, X.is_exhaustive_query, "第3條全部")
    assert one(spark, X.section_heading, "列出全部罰則") == "罰則"
    assert one(spark, X.asks_announcement, "內政部公告的設備") and one(spark, X.asks_latest_law, "最新消防法")
    assert one(spark, X.is_comparison_query, "設計人與監造人的權限有何差異")
    assert one(spark, X.expand_query, "怎麼處罰") == "怎麼處罰 " + X.PENALTY_WORDS


def test_deleted(spark):
    assert one(spark, X.is_deleted, "第45條", "第45條 （刪除）") and not one(spark, X.is_deleted, "第45條", "第45條 刪除本款")
    assert one(spark, X.is_deleted, None, "刪除")


def test_dates(spark):
    assert one(spark, X.roc_date, "公告日期：民國113年11月29日") == dt.date(2024, 11, 29)
    assert one(spark, X.roc_date, "生效日期：113/1/1") is None and one(spark, X.roc_date, "發布日期 113/13/40 修正日期 2020-02-03") == dt.date(2020, 2, 3)


def test_budget_and_citations(spark):
    assert one(spark, X.token_estimate, "") == 1 and one(spark, X.token_estimate, "字字") == 2
    df = spark.createDataFrame([(4096, 3200, "見[2]與[1]、[2]", 2)], "c int, p int, a string, n int")
    r = df.select(X.output_tokens(F.lit(2048), F.col("c"), F.col("p")).alias("o"), X.citations(F.col("a"), F.col("n")).alias("x"), X.citations(F.col("a"), F.lit(1)).alias("y"), X.citations(F.lit("無"), F.lit(3)).alias("z")).first()
    assert (r.o, r.x, r.y, r.z) == (384, [2, 1], None, None)


def test_lines(spark):
    assert one(spark, X.clean_lines, "　a  b \r\n\n列印時間：1\n回首頁\n回首頁面") == ["a b", "回首頁面"]


def test_urls(spark):
    assert one(spark, U.source_key, "https://x.example/Law.aspx?LSID=fl001&ldate=2020") == one(spark, U.source_key, "https://x.example/law.aspx?a=1&lsid=FL001") == "lsid:FL001"
    assert one(spark, U.source_key, "https://x.example/Show?id=7") == "/show?id=7"
    assert one(spark, U.source_key, "HTTPS://X.example/P?b=2&a=1") == "https://x.example/P?a=1&b=2"
    ok = lambda u: one(spark, lambda c: U.allowed(c, ("gov.example",)), u)
    assert ok("https://law.gov.example/x") and ok("https://gov.example") and not ok("https://gov.example.evil.example") and not ok("http://gov.example") and not ok("https://u@gov.example") and not ok("nonsense")


def test_grams(spark):
    assert one(spark, lambda c: X.grams(c, 2), "a字\U000e0100b\n𠮷") == ["a字", "字\U000e0100", "\U000e0100b", "b\n", "\n𠮷"]
    assert one(spark, lambda c: X.grams(c, 2), "a") == [] and one(spark, lambda c: X.grams(c, 1), "") == []
