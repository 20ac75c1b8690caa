import pytest

from lexspark.llm.mojibake import is_lost, repair, restore, restore_texts

ZH = "第1條　管理權人應於每年3月5日前提出維護契約書，逾期視為未定期檢測。"
EN = "A “charging bay” means any space of more than 31 m² — the café isn’t one; at least 90 °C."


@pytest.mark.parametrize("read", ["latin-1", "mac_roman", "gb18030", "cp932"])
def test_utf8_read_as(read):
    try:
        bad = ZH.encode().decode(read)
    except UnicodeDecodeError:
        pytest.skip("not decodable")
    assert restore(bad) == (True, ZH)


def test_big5_read_as_others():
    for read in ("latin-1", "gb18030"):
        assert restore(ZH.encode("cp950").decode(read)) == (True, ZH)


def test_nested_layers():
    twice = ZH.encode().decode("latin-1").encode().decode("latin-1")
    assert restore(twice) == (True, ZH)


def test_english():
    assert restore(EN.encode().decode("latin-1")) == (True, EN)
    assert restore(EN.encode().decode("mac_roman")) == (True, EN)


def test_single_lines():
    bad = ZH.encode().decode("latin-1")
    assert restore(f"{ZH}\n{bad}\n{EN}") == (True, f"{ZH}\n{ZH}\n{EN}")


@pytest.mark.parametrize("good", ["subject to § 47", "at least 90 °C", "a café", "cafés: café, café, café", "El Señor", "façade", "créée", "±6", "à la carte, café"])
def test_single_signs(good):
    for read in ("latin-1", "cp1252"):
        try:
            bad = good.encode().decode(read)
        except UnicodeDecodeError:
            continue
        assert restore(bad) == (True, good)
        assert restore(f"{EN}\n{bad}") == (True, f"{EN}\n{good}")


def test_single_sign_read_twice():
    twice = "at least 90 °C".encode().decode("latin-1").encode().decode("latin-1")
    assert restore(f"{EN}\n{twice}") == (True, f"{EN}\nat least 90 °C")


def test_leading_letters_in_order_stay():
    for t in ("NESCAFÉ®", "5 Å – 7 Å", "ÂGE § 4", "“5 Å”", "Ã is a letter", "the Â", "É°"):
        assert restore(t) == (False, t) and repair(t) is None


def test_in_order_stays():
    for t in (ZH, EN, "®Façade ±6% £72 Ça ÂGE ß Ø59 µm ﾃｽﾄ", "résumé naïve Ångström 42 ℃ 5 MΩ", "真的嗎??", "菌菇培養室"):
        assert restore(t) == (False, t) and repair(t) is None


def test_lost_characters():
    bad = ZH.encode().decode("gbk", "replace")
    assert restore(bad) == (True, None)
    assert restore(ZH.encode("ascii", "replace").decode()) == (True, None)
    assert is_lost("����109�") and not is_lost("ok?")


def test_table(spark):
    bad = ZH.encode().decode("latin-1")
    rows = [(1, bad, 0), (1, bad, 0), (2, ZH, 0), (3, None, 0), (4, "", 0), (5, bad * 400, 0), (None, bad, 0), (6, "壞����", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored int")
    assert sorted(map(tuple, restore_texts(df).collect())) == [(1, ZH), (5, ZH * 400), (6, None)]
    assert restore_texts(df.limit(0)).count() == 0


CLEAN = {
    "ru": "Привет мир, это обычный текст. В МОСКВЕ №5 — «большой» дом; МегаФон™ и 😀 улыбка ☺. Объём ёлки: 25 %.",
    "uk": "Це звичайний український текст: їжак, ґанок, європейська мова й об'єкт.",
    "sr": "Ово је обичан текст на српском језику са љубављу и њежно џепом.",
    "el": "Καλημέρα κόσμε, αυτό είναι ένα απλό κείμενο. Η τιμή είναι 25 €.",
    "ko": "한국어 문장입니다. 안녕하세요 여러분, 대한민국(大韓民國)의 PC방 이야기.",
    "ja": "これは普通の日本語の文章です。駅の前で働く人々は気持ちが良いと込めて言った。カタカナも使う。",
    "zh-Hans": "这是一个普通的简体中文句子，说明国家发展与经济问题。我们应该认真对待这个问题。",
    "zh-Hant": "這是一個普通的繁體中文句子，說明國家發展與經濟問題。",
    "ar": "هذا نص عادي باللغة العربية ويجب ألا يتغير.",
    "he": "זהו טקסט רגיל בעברית שאסור לשנות.",
    "th": "นี่คือข้อความภาษาไทยธรรมดาที่ไม่ควรเปลี่ยนแปลง",
    "hi": "यह हिंदी में एक सामान्य पाठ है जिसे नहीं बदलना चाहिए।",
    "vi": "Đây là một văn bản tiếng Việt bình thường và không được thay đổi.",
    "tr": "Bu, değiştirilmemesi gereken sıradan bir Türkçe metindir.",
    "fr": "Voilà un texte français ordinaire, où l'été côtoie l'hiver : « ça va ? » Œuvre.",
    "pl": "Zażółć gęślą jaźń – zwykły polski tekst.",
}


@pytest.mark.parametrize("lang", sorted(CLEAN))
def test_clean_texts_in_living_scripts_stay(lang):
    text = CLEAN[lang]
    for t in (text, text * 3, *text.split(". "), *text.split(" "), f"{ZH}\n{text}", f"{text}\n{EN}"):
        assert restore(t) == (False, t)


@pytest.mark.parametrize("lang", sorted(set(CLEAN) - {"vi"}))
def test_utf8_in_living_scripts_comes_back(lang):
    text = CLEAN[lang]
    for read in ("latin-1", "koi8-r", "cp437"):
        assert restore(text.encode().decode(read)) == (True, text)


def test_any_number_of_layers():
    bad = ZH
    for _ in range(6):
        bad = bad.encode().decode("latin-1")
        assert restore(bad) == (True, ZH)


def test_utf8_goes_before_accidents_of_other_encodings():
    # C2 A7 and C2 B0 are ideographs in Big5, CC A3 is a combining dot in UTF-8.
    for good, read in (("subject to § 42", "cp1252"), ("withstand 707 °C", "mac_roman"), ("The São series", "cp1252"), ("The São series", "latin-1")):
        bad = good.encode().decode(read)
        assert restore(f"{EN}\n{bad}") == (True, f"{EN}\n{good}")
