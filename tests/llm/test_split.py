import random

import pytest

from lexspark.llm import split as S
from lexspark.llm.split import beginnings, number, part_beginnings, pieces, split_texts

LAW = "法規名稱：甲規則\n第一章 總則\n第 1 條　為預防災害，特訂定本規則。\n第2條\xa0管理人應備有下列：\n一、甲。\n二、乙，並準用\n第 1 條第二項所定之程序。\n第3-1條 與鄰棟相通者，應通報。\n第十二條之一 （刪除）"


def test_article_beginnings():
    assert [x for _, x in beginnings(LAW, False)] == ["第1條", "第2條", "第3-1條", "第十二條之一"]


def test_points_where_there_are_no_articles():
    t = "主管機關：甲\n一、第一。\n二、應備：\n一、甲。\n二、乙。\n三、丙，並依附表\n六、七所列項目辦理。\n三、第三。\n（一）子。\n四、第四。"
    assert [x for _, x in beginnings(t, False)] == ["一、", "二、", "三、", "四、"]


def test_content_without_its_own_label():
    t = "四、應備下列：\n一、甲。\n（一）子。\n⼆､乙，並依第\n七點之規定。\n三、丙。"
    assert [x for _, x in beginnings(t, True)] == ["一、", "⼆､", "三、"]
    assert beginnings("", True) == [] and beginnings("無", False) == []


def test_numbers():
    assert [number(x) for x in ("三", "十", "十二", "一百零五", "一〇五", "２０", "二十三")] == [3, 10, 12, 105, 105, 20, 23]


@pytest.mark.parametrize("seed", range(20))
def test_pieces_are_whole(seed):
    rng = random.Random(seed)
    t = "".join(rng.choice(["字", "。", "\n", "第3條 ", "一、", "（一）", "長" * 50, "\n第 5 條　"]) for _ in range(rng.randrange(1, 900)))
    limit, overlap = rng.choice([(1800, 180), (100, 10), (50, 0), (30, 29)])
    p = pieces(t, limit, overlap)
    assert all(b - a <= limit for a, b in p) and p[0][0] == 0 and p[-1][1] == len(t)
    assert all(x[1] - overlap == y[0] or x[1] - overlap < 0 for x, y in zip(p, p[1:])) and t == t[p[0][0] : p[0][1]] + "".join(t[x[1] : y[1]] for x, y in zip(p, p[1:]))


def test_cuts_at_boundaries():
    t = "\n".join(f"第{i}條 " + "字" * 700 for i in range(1, 9))
    own = [a + 180 * (n > 0) for n, (a, b) in enumerate(pieces(t))]
    assert all(t[o:].startswith("第") for o in own)


def test_tables(spark):
    long = "\n".join(f"第{i}條 " + "字" * 400 for i in range(1, 9))
    df = spark.createDataFrame([(1, long, 5), (1, long, 5), (2, "短", 5), (3, None, 5), (4, "", 5), (5, "字" * 5000, 5)], "version_id long, raw_text string, item_id int")
    s = split_texts(df, "version_id", "raw_text")
    assert {r.item_id for r in s.collect()} == {1, 5} and s.groupBy("item_id", "piece_no").count().where("count > 1").count() == 0
    assert part_beginnings(df, "version_id", "raw_text", False).count() == 8
    assert split_texts(df.limit(0), "version_id", "raw_text").count() == 0
    with pytest.raises(ValueError):
        split_texts(df, "version_id", "raw_text", 10, 10)


def test_tree():
    t = "前言\n第一章 總則\n第1條 甲：\n一、子。\n二、丑：\n一、內。\n（一）細。\n三、寅。\n第2條 乙"
    shown = lambda n: (n.label.strip(), [shown(k) for k in n.kids])
    assert shown(S.parse(t)) == ("", [("", []), ("第一章", [("", []), ("第1條", [("", []), ("一、", []), ("二、", [("", []), ("一、", [("", []), ("（一）", [])])]), ("三、", [])]), ("第2條", [])])])
    root = S.parse("四、應備：\n一、甲。\n二、乙。", True)
    assert root.label == "四、" and [x for _, x in S.content_parts(root)] == ["一、", "二、"]


def test_siblings_are_merged_and_only_oversized_nodes_descended_into():
    t = "\n".join(["第1條 " + "甲" * 20, "第2條 " + "乙" * 20, "第3條 " + "\n".join(f"{n}、" + "丙" * 30 + "。" for n in "一二三四"), "第4條 " + "丁" * 20])
    own = [t[a:b] for a, b in pieces(t, 80, 0)]
    assert "".join(own) == t and all(len(x) <= 80 for x in own)
    assert own[0].startswith("第1條") and "第2條" in own[0] and [x[0] for x in own[1:]] == ["第", "三", "第"]


def test_letters_keep_their_marks():
    t = "e\u0301" * 1_000
    assert all((b - a) % 2 == 0 for a, b in pieces(t, 101, 0)) and all(b - a <= 101 for a, b in pieces(t, 101, 0))
    family = "\U0001f468\u200d\U0001f469\u200d\U0001f467"
    assert all((b - a) % len(family) == 0 for a, b in pieces(family * 100, 101, 0))
    assert [b - a for a, b in pieces("a" + "\u0301" * 250, 100, 0)] == [100, 100, 51]  # one letter beyond the limit


def test_found_rows_come_with_the_pieces(spark, monkeypatch):
    long = "\n".join(f"第{i}條 " + "字" * 400 for i in range(1, 9))
    df = spark.createDataFrame([(1, long)], "version_id long, raw_text string")
    rows = split_texts(df, "version_id", "raw_text").orderBy("piece_no").collect()
    assert [p.label for r in rows for p in r.parts] == [f"第{i}條" for i in range(1, 9)]
    assert all(r.own_from <= p.at < r.begins_at + len(r.piece) and long.startswith(p.label, p.at) for r in rows for p in r.parts)
    # without the packing there are no rows
    monkeypatch.setattr(S, "split_texts", lambda d, *a, **k: split_texts(d, "version_id", "raw_text").limit(0))
    assert part_beginnings(df, "version_id", "raw_text", False).count() == 0
