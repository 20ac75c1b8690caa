import random

from lexspark.llm.fold import drop_line_numbers, fold_char, fold_texts
from lexspark.llm.leak import Matcher, WuManber, find_leaks, held

ZH = "惟船塢協理簽認隔離結果前無人倉道之隔振座一律視同待修測試監督兼管玻璃天橋與冰品地窖時回壓閥各備40件色碼AFS91第125號案隔振座於隔離途中斷裂"
EN = "Whenever a relay comb of the folding hatch drifts by 24.2 mm, it is resealed first and flushed 31 hours later. Answer: only if the damper seat was rotated."


def leaks(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, t string, item_id long")
    p = spark.createDataFrame(items, "item_id long, passage string, lang string, doc_id long")
    return sorted(map(tuple, find_leaks(d, p).collect()))


def test_whole_partly_and_not(spark):
    items = [(1, ZH, "zh", 0), (2, EN, "en", 0)]
    docs = [
        (1, "前文。" + ZH + "後文。", "a", 9),
        (2, "x" + ZH[:30] + "y", "a", 9),  # 30 of 67 letters
        (3, ZH[:25], "a", 9),  # under two fifths
        (4, ZH[30:50] + "隔" + ZH[:20], "a", 9),  # out of order: one stretch counts
        (5, EN.upper().replace(" ", "  \n"), "a", 9),
        (6, "　".join(ZH), "a", 9),
        (7, "".join(c + "\u200b" for c in ZH), "a", 9),
        (8, ZH[:19] + "錯" + ZH[20:39] + "錯" + ZH[40:59] + "錯" + ZH[60:], "a", 9),  # no stretch of 20
        (9, None, "a", 9), (10, "", "a", 9), (1, "前文。" + ZH + "後文。", "a", 9),
    ]
    assert leaks(spark, docs, items) == [(1, 1), (2, 1), (5, 2), (6, 1), (7, 1)]


def test_line_numbers_and_width(spark):
    numbered = "\n".join(f"({i}) {ZH[i * 12 : i * 12 + 12]}" for i in range(6))
    wide = "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in ZH)
    assert leaks(spark, [(1, numbered, "", 0), (2, wide, "", 0)], [(5, ZH, "zh", 0)]) == [(1, 5), (2, 5)]
    assert drop_line_numbers("7\n8 片") == "7\n8 片"


def test_empty(spark):
    assert leaks(spark, [], [(1, ZH, "zh", 0)]) == []
    assert leaks(spark, [(1, ZH, "", 0)], []) == []
    assert leaks(spark, [(1, ZH, "", 0)], [(1, None, None, 0), (2, "", "zh", 0), (3, "，。", "zh", 0)]) == []


def test_against_brute_force():
    rng = random.Random(3)
    alphabet = "甲乙丙丁ab"
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    items = [(i, make(70), "zh") for i in range(8)]
    texts = []
    for i in range(120):
        p = rng.choice(items)[1]
        a, b = sorted(rng.sample(range(70), 2))
        texts.append(make(rng.randrange(30)) + p[a:b] + make(rng.randrange(30)))
    got = set(Matcher(items, {"*": 20, "en": 40}, 0.4).find(texts))
    want = set()
    for n, t in enumerate(texts):
        for i, p, _ in items:
            runs = []
            for s in range(len(p)):
                for d in range(len(t)):
                    if p[s] == t[d] and (s == 0 or d == 0 or p[s - 1] != t[d - 1]):
                        k = 0
                        while s + k < len(p) and d + k < len(t) and p[s + k] == t[d + k]:
                            k += 1
                        if k >= 20:
                            runs.append((s, d, k))
            if held(runs, 20) >= 28:
                want.add((n, i))
    assert got == want and want


def test_wu_manber_finds_all():
    import numpy as np

    rng = np.random.default_rng(1)
    text = rng.integers(2, 6, 5000).astype(np.uint32)
    patterns = np.stack([text[i : i + 10] for i in range(0, 3000, 97)])
    got = set(zip(*(x.tolist() for x in WuManber(patterns).search(text))))
    want = {(p, i) for p in range(len(patterns)) for i in range(4991) if (text[i : i + 10] == patterns[p]).all()}
    assert got == want


def test_fold():
    assert fold_char("Ａ") == "a" and fold_char("。") == "" and fold_char("㎜") == "mm"
    a, ends = fold_texts(["Ab，㎜", "", "1"])
    assert [chr(c) for c in a] == ["a", "b", "m", "m", "\x01", "\x01", "1", "\x01"] and ends.tolist() == [4, 5, 7]


def test_repetitive_texts_take_no_quadratic_time():
    import time

    m = Matcher([(1, "字" * 200, "zh"), (2, "零" * 25 + ZH + "零" * 25 + EN, "zh")], {"*": 20, "en": 40}, 0.4)
    t0 = time.time()
    assert m.find(["字" * 300_000, "字" * 79, "字" * 80, "零" * 100_000 + ZH[:20] + "零" * 100_000]) == [(0, 1), (2, 1)]
    assert m.find(["零" * 1000 + ZH + "零" * 1000]) == [(0, 2)] and time.time() - t0 < 20


def test_blocks_from_the_shared_folder(spark):
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯") for _ in range(n))
    items = [(i, make(60), "zh") for i in range(60)]
    docs = [(i, make(30) + items[i][1][: 20 + i] + make(30) + items[59 - i][1][10:40]) for i in range(60)]
    d, p = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string, lang string")
    one, many = (sorted(map(tuple, find_leaks(d, p, per_block=k).collect())) for k in (20_000, 7))
    assert one == many and len(one) > 60


def test_shifts_stay_long_with_many_patterns():
    import numpy as np

    rng = np.random.default_rng(0)
    letters = np.minimum(rng.zipf(1.3, 3_000_000), 3_000).astype(np.uint32) + 20_000
    for n in (1_000, 100_000):
        w = WuManber(letters[: n * 10].reshape(n, 10))
        text = letters[1_500_000:]
        ends = np.arange(w.m - 1, len(text), 7)
        s = w.shift[w._block([text[ends - (w.b - 1 - i)] for i in range(w.b)])]
        assert s.mean() > 0.7 * (w.m - w.b + 1)
