import pytest

from lexspark.llm.canon import Canonical, Trie, by_table, canonicalize, look_classes, same_look, vocabulary

PAIRS = [("第８條", "第8條"), ("ＰＶＣ‐671", "PVC-671"), ("Е́lan", "Élan"), ("re\u0301sume\u0301", "résumé"), ("⽔上餐\u200b廳", "水上餐廳"), ("138°C", "138℃"), ("56\u00a0ΜΩ", "56 MΩ"), ("六、甲", "六、甲"), ("一､乙｡", "一、乙。"), ("\u6f22\ufe00", "漢")]


@pytest.mark.parametrize(("a", "b"), PAIRS)
def test_same_look(a, b):
    for c in (Canonical([]), Canonical(["résumé", "第8條", "水上餐廳", "PVC-671", "Élan"])):
        assert c.text(a) == c.text(b) == by_table(a)


@pytest.mark.parametrize(("a", "b"), [("10²", "102"), ("½", "1/2"), ("①", "1"), ("甲。", "甲"), ("A", "a"), ("已", "己"), ("Ω", "O")])
def test_other_look(a, b):
    assert by_table(a) != by_table(b)


def test_automaton():
    t = Trie(["résumé", "第8條", "條文"])
    assert t.match("re\u0301ѕu\u00adme\u0301") == "résumé" and t.match("第\u200e８條") == "第8條"
    assert t.match("第9條") is None and t.match("第9條", budget=1) == "第8條" and t.match("") is None


@pytest.mark.parametrize(
    ("typed", "meant"),
    [("c1ause", "clause"), ("ρυmρ", "pump"), ("υalve", "valve"), ("2O3", "203"), ("l00", "100"), ("sаfeτy", "safety"), ("MTΒ−7", "MTB-7"), ("色碼2O3型", "色碼203型"), ("Ｉ0", "I0"), ("ρ", "ρ"), ("κλ", "κλ"), ("x0y", "x0y"), ("0O0", "0O0")],
)
def test_the_vocabulary_decides_what_no_table_can(typed, meant):
    words = ["203", "100", "clause", "valve", "pump", "safety", "MTB-7", "uaIve"]
    assert Canonical(words).text(typed) == meant
    if meant in words or "203" in meant:  # without the automaton's words the table leaves them apart
        assert Canonical([]).text(typed) == by_table(typed) != meant


def test_ties_go_to_the_more_frequent_word():
    assert Canonical(["call", "cail"]).text("caιl") == "call" and Canonical(["cail", "call"]).text("caιl") == "cail"
    assert Canonical(["l0I", "101"]).text("l0I") == "l0I"  # a word as it stands costs nothing


def test_pairs(spark):
    rows = [("a", 1, 1, "第8條"), ("a", 1, 2, "第８條"), ("a", 1, 2, "第８條"), ("a", 2, 3, "第８條"), ("a", 1, 4, "第9條"), ("a", 1, 5, None), ("a", 1, 6, "第8條"), ("b", 1, 7, "第8條"), ("a", 1, 8, ""), ("a", 1, 9, "\u200b")]
    df = spark.createDataFrame(rows, "field_name string, scope long, id long, t string").selectExpr("*", "1 as look", "2 as s1")
    assert sorted(tuple(r)[1:] for r in same_look(df).collect()) == [(1, 2), (2, 6), (8, 9)]
    assert same_look(df.limit(0)).count() == 0


def test_texts(spark):
    df = spark.createDataFrame([(1, "Ａ\u200b", "x"), (2, None, "x"), (3, "", "x"), (4, "字" * 20000 + "１", "x")], "id long, t string, canonical string")
    assert {r.id: r.canonical for r in canonicalize(df).collect()} == {1: "A", 2: None, 3: "", 4: "字" * 20000 + "1"}
    assert vocabulary(df.select("t").where("t is not null")) == []


def test_hot_class_pairs_only_unlike_spellings(spark):
    df = spark.range(3000).selectExpr("'a' as field_name", "1L as scope", "id", "case when id < 3 then '第８條' else '第8條' end as t")
    assert same_look(df, words=[]).count() == 3 * 2997


def test_classes_count_their_links_however_large(spark):
    df = spark.range(1_000_000).selectExpr("'a' as field_name", "1L as scope", "id", "case when id < 400000 then '（刪除）' when id < 400003 then '(刪除)' else concat('第', id, '條') end as t")
    c = look_classes(df, words=[])
    assert {tuple(r) for r in c.groupBy("links").count().collect()} == {(3, 400_000), (400_000, 3)} and c.select("look").distinct().count() == 1
    assert c.limit(0).count() == 0 and look_classes(df.where("id = 1"), words=[]).count() == 0


def test_blocks_give_the_same_pairs(spark):
    df = spark.range(300).selectExpr("'a' as field_name", "1L as scope", "id", "element_at(array('第８條', '第8條', '第 8條', '第　8條'), cast(id % 4 as int) + 1) as t")
    assert same_look(df, words=[], block=7).count() == same_look(df, words=[]).count() == 2 * 75 * 75
