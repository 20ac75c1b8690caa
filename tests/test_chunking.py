from pyspark.sql import functions as F

from lexspark.operators import chunking as C


def seg(spark, text):
    df = spark.createDataFrame([(1, text, "x")], "id long, t string, seq string")
    return [(r.article_label, r.heading, r.content) for r in C.segment(df, "id", "t").orderBy("seq").collect()]


def test_articles(spark):
    t = "法規名稱：甲\n第一章 總則\n第 1 條　甲。\n續甲。\n第二章\n第1-1條 乙，並準用\n第六條第一項所定之程序。\n第三節 丙\n第二條\n丁。"
    assert seg(spark, t) == [("第1條", "第一章 總則", "第1條 甲。\n續甲。"), ("第1-1條", "第二章", "第1-1條 乙，並準用\n第六條第一項所定之程序。"), ("第二條", "第三節 丙", "第二條\n丁。")]


def test_hierarchy_of_points(spark):
    t = "前言\n一、受理申報\n1. 甲\n續\n2. 乙\n二、複查工作\n（四）注意事項\n說明\n1、丙\n三、結尾"
    assert seg(spark, t) == [("1.", "一、受理申報", "1. 甲\n續"), ("2.", "一、受理申報", "2. 乙"), ("1、", "二、複查工作 / （四）注意事項", "1、丙"), ("三、", None, "三、結尾")]


def test_flat_points_and_plain(spark):
    assert seg(spark, "壹、甲\n貳、乙") == [("壹、", None, "壹、甲"), ("貳、", None, "貳、乙")]
    assert seg(spark, "只有\n文字") == [(None, None, "只有\n文字")]
    assert seg(spark, "") == [] and seg(spark, None) == []
    long = seg(spark, "字" * 6100)
    assert [len(c) for *_, c in long] == [1800, 1800, 1800, 1240]


def test_heading_path_against_a_loop(spark):
    import random

    rng = random.Random(5)
    marks = {1: "一、x", 2: "（一）y", 3: "1.z"}
    for _ in range(6):
        levels = [rng.choice([1, 2, 3]) for _ in range(25)]
        want, path = [], {}
        for i, lv in enumerate(levels):
            path = {k: v for k, v in path.items() if k < lv}
            nxt = levels[i + 1] if i + 1 < len(levels) else None
            if len(set(levels)) > 1 and nxt is not None and nxt > lv:
                path[lv] = marks[lv] + str(i)
            else:
                want.append((" / ".join(path[k] for k in sorted(path)) or None, marks[lv] + str(i)))
        assert [(h, c) for _, h, c in seg(spark, "\n".join(marks[lv] + str(i) for i, lv in enumerate(levels)))] == want


def test_windows(spark):
    f = lambda n: [len(x) for x in spark.range(1).select(C.char_windows(F.lit("x" * n), 100, 10).alias("w")).first().w]
    assert f(100) == [100] and f(101) == [100, 11] and f(190) == [100, 100] and f(0) == [0]
    g = lambda n: [len(x) for x in spark.range(1).select(C.stride_windows(F.lit("x" * n)).alias("w")).first().w]
    assert g(2600) == [2600] and g(2601) == [2600, 101] and g(5050) == [2600, 2550, 50]


def test_stored_text(spark):
    df = spark.createDataFrame([(1, "第1條 甲。\n\n附件：表.pdf\n一、乙\n二、丙\n附件：圖\n只有字")], "id long, t string")
    r = [(x.seq, x.article_label, x.heading, x.content) for x in C.segment_stored(df, "id", "t").orderBy("seq").collect()]
    assert r == [(0, "第1條", None, "第1條 甲。"), (1, "一、", "附件：表.pdf", "一、乙"), (2, "二、", "附件：表.pdf", "二、丙"), (3, "附件1", "附件：圖", "只有字")]


def test_attached_documents_stay_rows(spark):
    rows = [("a", 3, "一、乙\n二、丙"), ("a", 1, "第1條 甲。\n附件：圖"), ("a", 20, "只有字\n附件：末"), ("a", 4, ""), ("b", 9, "第1條 丁。"), (None, 5, "戊")]
    df = spark.createDataFrame(rows, "k string, i long, t string")
    got = C.segment_attached(df, "k", "i", "t")
    joined = spark.createDataFrame([("a", "第1條 甲。\n附件：圖\n\n附件：3\n一、乙\n二、丙\n\n附件：20\n只有字\n附件：末"), ("b", "第1條 丁。")], "k string, t string")
    want = sorted(map(str, C.segment_stored(joined, "k", "t").collect()))
    assert sorted(map(str, got.collect())) == want and len(want) == 5
    many = spark.range(3000).select(F.lit("k").alias("k"), F.col("id").alias("i"), F.lit("字" * 50).alias("t"))
    assert C.segment_attached(many, "k", "i", "t").agg(F.max("seq"), F.max(F.length("content"))).first()[:] == (2999, 50)


def test_metadata_and_hash(spark):
    t = "法規名稱：甲規則（113/03/14 發布）\n主管機關：內政部\n第1條 甲。"
    df = spark.createDataFrame([(1, t), (2, "列印時間：113/1/1\n" + t), (3, t + "乙。")], "doc long, t string")
    m = df.select("doc", C.metadata(F.col("t")).alias("meta"), C.title(F.col("t")).alias("title"))
    a = m.where("doc = 1").first()
    assert (a.title, a.meta.published_date, a.meta.authority, a.meta.amended_date) == ("甲規則", "113/03/14", "內政部", None)
    h = {r.doc: r.content_hash for r in C.semantic_hash(m, C.segment(df, "doc", "t")).collect()}
    assert h[1] == h[2] != h[3]
