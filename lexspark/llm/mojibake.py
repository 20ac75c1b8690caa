"""Problem 9: texts decoded with the wrong character encoding.

Method: round-trip repair. Text is encoded again under a candidate legacy encoding and strictly decoded as the intended one, as
often as layers are nested; the result is accepted when a garbling cost drops. The cost knows living scripts: words in letters of one
script, and ideographs common in one language, cost nothing, so that text in order is never read anew. UTF-8 read as cp1252 or Latin-1 may cost little (one
sign in a line): a strict round trip through these needs no more than a drop. Where no whole text comes back, the same is tried line
by line. A line whose cost falls only when undecodable bytes are left out has lost characters: its document is affected, but
has no original any more.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings a text may have been read in, and those its bytes may have been written in.
READ_AS = ("cp1252+", "latin-1", "gb18030", "gbk", "cp932", "mac_roman", "cp437", "cp950", "big5hkscs", "cp1251", "koi8-r", "euc_kr", "euc_jp")
MEANT_AS = ("utf-8", "cp950", "big5hkscs", "gb18030", "cp932")
#: Readings followed from one layer to the next (the cheapest). Layers have no bound: they end when two in a row make nothing better.
BEAM = 3
#: Cost from which a text is looked at, and what a reading other than UTF-8 (which hardly ever decodes by accident) costs beforehand.
SUSPECT, DOUBT = 0.5, 0.3
#: Cost that must go for each character beyond ASCII: strange signs here and there in good text are no reason to read all of it anew.
DROP = 0.12

_PLAIN = set("、。，；：？！「」『』（）《》〈〉〔〕【】…—－．／％＋＝＜＞～·‧“”‘’„‚–«»№€¿¡℃Ω°²³½×±§™®©•＄＆＠＃＊｜・　\n\t\r")
_C1 = {c: c for c in range(0x80, 0xA0)}


def _sloppy() -> tuple[dict[int, int], dict[int, int]]:
    """cp1252 whose five free bytes are the control characters of Latin-1."""
    to = {}
    for byte in range(256):
        try:
            to[ord(bytes([byte]).decode("cp1252"))] = byte
        except UnicodeDecodeError:
            to[byte] = byte
    return to, {v: k for k, v in to.items()}


_TO1252, _FROM1252 = _sloppy()

_NEXT = "[" + re.escape("".join(chr(c) for c in range(0x80, 0xC0)) + "".join(chr(c) for c, b in _TO1252.items() if 0x80 <= b < 0xA0)) + "]"
#: UTF-8 of one character, read as cp1252 or Latin-1: a leading character and its continuations.
_UTF8 = re.compile(f"[\xc2-\xdf]{_NEXT}|[\xe0-\xef]{_NEXT}{{2}}|[\xf0-\xf4]{_NEXT}{{3}}")


def encode(text: str, as_: str, errors: str = "strict") -> bytes:
    if as_ == "cp1252+":
        return text.translate(_TO1252 | ({c: _TO1252.get(c, c) for c in range(0x80, 0xA0)})).encode("latin-1", errors)
    return text.encode(as_, errors)


def _level(raw: bytes | None, common: tuple[int, int], rest: tuple[int, int]) -> float:
    """0 for the lead bytes of a standard's common ideographs, 0.6 for those of its others, 1 for what it doesn't hold."""
    if raw is None or len(raw) != 2:
        return 1.0
    return 0.0 if common[0] <= raw[0] <= common[1] else 0.6 if rest[0] <= raw[0] <= rest[1] else 1.0


def _in(ch: str, codec: str) -> bytes | None:
    try:
        return ch.encode(codec)
    except UnicodeEncodeError:
        return None


@lru_cache(maxsize=1 << 16)
def han_cost(ch: str) -> tuple[float, float, float, float]:
    """How rare an ideograph is in traditional, simplified, Japanese and Korean text, by the levels of Big5, GB 2312, JIS X 0208 and KS X 1001."""
    return (
        _level(_in(ch, "big5"), (0xA4, 0xC8), (0xC9, 0xF9)),
        _level(_in(ch, "gb2312"), (0xB0, 0xD7), (0xD8, 0xF7)),
        _level(_in(ch, "shift_jis"), (0x88, 0x98), (0x99, 0xEA)),
        0.3 if _in(ch, "euc_kr") else 1.0,
    )


def _script(o: int) -> str:
    """The script of a letter that is written in words of its own: Greek, Cyrillic, Hangul and others; empty for all else."""
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "g"
    if 0x400 <= o < 0x530:
        return "c"
    if 0xAC00 <= o < 0xD7A4:
        return "h"
    return "o" if 0x530 <= o < 0x1100 or 0x1780 <= o < 0x1800 or 0xFB1D <= o < 0xFE00 or 0xFE70 <= o < 0xFEFF else ""


@lru_cache(maxsize=1 << 16)
def char_cost(ch: str) -> float:
    """How little a character belongs in any text: 0 not at all strange, 2 certainly broken. Ideographs are judged in their text, see ``cost``."""
    o = ord(ch)
    if o < 0x80:
        return 0.0 if ch in "\n\t\r" or o >= 0x20 and o != 0x7F else 1.5
    if o == 0xFFFD:
        return 2.0
    if ch in _PLAIN:
        return 0.05
    if 0x4E00 <= o <= 0x9FFF:
        return min(han_cost(ch))
    kind = unicodedata.category(ch)
    if kind in ("Co", "Cc", "Cn", "Cs"):
        return 1.5
    if o in (0x200B, 0x200C, 0x200D, 0x200E, 0x2060, 0xFEFF, 0xAD, 0xA0, 0x3000, 0x202F, 0x2002, 0x2009):
        return 0.1
    if 0xFF01 <= o <= 0xFF5E:
        return 0.05
    if 0x3041 <= o < 0x3100:
        return 0.0
    if (0xC0 <= o <= 0x24F or 0x1E00 <= o < 0x1F00) and kind[0] == "L":
        return 0.2 if o < 0x100 else 0.3
    if 0x300 <= o < 0x370 and kind == "Mn":
        return 0.4
    return 0.0 if kind[0] in "LMN" and _script(o) else 1.0


# Letters of Cyrillic alphabets beyond the Russian one. A word uses those of one alphabet.
_CYRILLIC = ("іїєґўІЇЄҐЎ", "ђјљњћџЂЈЉЊЋЏ", "ѓѕјљњќџЃЅЈЉЊЌЏ")
_MORE = re.compile("[\u0400\u0402-\u040f\u0450\u0452-\u052f]")
_WORD = re.compile(r"[^\W\d_]+")
_MARKED = re.compile(r"[À-ɏ]{2,}")
_TOUCH = re.compile(r"[a-z][一-鿿]|[一-鿿][a-z]")
_HAN = re.compile(r"[一-鿿]+")


def _words(text: str) -> float:
    """What is strange in words of scripts with letters: scripts mixed, small letters before capitals, letters of several alphabets."""
    total = 0.0
    for m in _WORD.finditer(text):
        w = m[0]
        if w.isascii():
            continue
        kinds = "".join("l" if ord(c) < 0x250 or 0x1E00 <= ord(c) < 0x1F00 else "k" if 0x2E80 <= ord(c) < 0xA000 else _script(ord(c)) or "x" for c in w)
        if not re.search("[gcho]", kinds):
            continue
        # Endings and Latin names touch in Hangul, and ideographs may stand beside it now and then.
        total += sum(0.5 if {a, b} == {"h", "k"} else 1.0 for a, b in zip(kinds, kinds[1:]) if a != b and {a, b} != {"h", "l"})
        if "c" in kinds:
            total += 0.7 * len(re.findall("[а-яѐ-џґ](?=[А-ЯЀ-ЏҐ])", w))
            more = set(_MORE.findall(w))
            if more and not any(more <= set(a) for a in _CYRILLIC):
                total += 0.5 * len(_MORE.findall(w))
        if kinds == "g":
            total += 0.3
    return total


def cost(text: str) -> float:
    """Garbling cost: characters that belong in no text, ideographs that are rare in the one language that suits them best, and strange neighbours.

    A word in letters of one living script costs nothing. Ideographs are traditional, simplified, Japanese (where kana stand
    among them) or Korean (among Hangul), whichever costs least for the whole text.
    """
    if text.isascii() and text.isprintable():
        return 0.0
    count = Counter(text)
    total, han, lang = 0.0, 0, [0.0, 0.0, 0.0, 0.0]
    kana = hangul = latin = letters = 0
    for c, n in count.items():
        o = ord(c)
        if 0x4E00 <= o <= 0x9FFF:
            han += n
            for i, x in enumerate(han_cost(c)):
                lang[i] += n * x
            continue
        total += n * char_cost(c)
        kana += n * (0x3041 <= o < 0x3100 and o != 0x30FB)
        hangul += n * (0xAC00 <= o < 0xD7A4)
        latin += n * (o < 0x250 and c.isalpha())
        letters += n * (o >= 0x370 and c not in _PLAIN and bool(_script(o)))
    japanese = kana >= 0.15 * (kana + han)
    total += min(lang[:2] + [lang[2]] * japanese + [lang[3]] * (hangul >= 0.3 * (hangul + han))) if han else 0.0
    if kana and not japanese:
        total += 0.5 * kana
    total += 0.7 * sum(len(m) - 1 for m in _MARKED.findall(text)) + 0.4 * len(_TOUCH.findall(text))
    if han and latin > 4 * han:  # an ideograph or two in Latin text
        total += 0.5 * sum(len(m) for m in _HAN.findall(text) if len(m) <= 2)
    return total + (_words(text) if letters else 0.0)


def _attempts(text: str) -> Iterator[tuple[str, bool]]:
    """(another reading, whether its bytes are UTF-8), by strict round trips."""
    for read in READ_AS:
        try:
            raw = encode(text, read)
        except UnicodeEncodeError:
            continue
        for meant in MEANT_AS:
            if meant == read or (read, meant) in (("gbk", "gb18030"), ("cp950", "big5hkscs"), ("big5hkscs", "cp950")):
                continue
            try:
                yield raw.decode(meant), meant == "utf-8"
            except UnicodeDecodeError:
                continue


def _signs(text: str) -> str | None:
    """The text before UTF-8 was read as cp1252 or Latin-1, by strict round trips of all of it that leave no strange character and cost less.

    Only single characters count: letters with marks in a row are no sign of garbling where the bytes fit. Every trip makes the
    text shorter, so they end.
    """
    found = None
    while _UTF8.search(text):
        try:
            t = encode(text, "cp1252+").decode("utf-8")
        except UnicodeError:
            break
        if any(map(_strange, t)) or sum(map(char_cost, t)) >= sum(map(char_cost, text)):
            break
        text = found = t
    return found


def repair(text: str) -> str | None:
    """The text before it was read wrongly, through any number of layers; None if no round trip makes it better."""
    found = _trips(text)
    return _signs(text if found is None else found) or found


def _drop(text: str) -> float:
    return max(0.4, DROP * sum(ord(c) > 0x7F for c in text))


def _trips(text: str) -> str | None:
    """A layer by itself need not lower the cost (twice-encoded text halves at first); the result of all of them must, by half. A
    reading replaces the one before it where it saves 0.4, and ``DROP`` for each character beyond ASCII."""
    start = cost(text)
    if start < SUSPECT:
        return None
    seen, layer, best, found, idle = {text}, [(text, 0.0)], start, None, 0
    while layer and idle < 2 and best >= SUSPECT:
        tries: dict[str, tuple[float, float]] = {}
        for x, doubt in layer:
            for t, sure in _attempts(x):
                if t not in seen:
                    d = doubt if sure else max(doubt, DOUBT)
                    tries[t] = min(tries.get(t, (9e9, 0.0)), (cost(t) + d, d))
        seen |= tries.keys()
        layer = [(t, tries[t][1]) for t in sorted(tries, key=lambda t: (tries[t], t))[:BEAM]]
        idle += 1
        if layer and best - tries[layer[0][0]][0] >= _drop(text if found is None else found):
            best, found, idle = tries[layer[0][0]][0], layer[0][0], 0
    return found if best <= 0.5 * start else None


def is_lost(line: str) -> bool:
    """Whether the line is wrongly read text of which characters are gone.

    The marks of undecodable bytes stand in it, or question marks in their place (at least four, two of them together, and nothing
    else beyond ASCII), or a round trip that leaves out a few broken bytes gives text in order with characters beyond ASCII.
    """
    if "�" in line:
        return True
    if "??" in line and line.count("?") >= 4 and line.isascii():
        return line.count("?") >= 0.3 * len(line.replace(" ", ""))
    now = cost(line)
    if now < 1.2 or now < 0.12 * len(line):
        return False
    for read in READ_AS:
        raw = encode(line, read, "ignore")
        t = raw.decode("utf-8", "ignore")
        if len(t.encode()) >= 0.9 * len(raw) >= 0.7 * len(line) and sum(ord(c) > 0x7F for c in t) >= 0.3 * len(t) and cost(t) < 0.05 * len(t):
            return True
    return False


def restore(text: str) -> tuple[bool, str | None]:
    """(affected, original): original is None where characters of it are lost."""
    whole = repair(text)
    if whole is not None and not any(map(_strange, whole)) and "�" not in whole:
        return True, whole
    lines = re.split(r"(\n)", text)
    fixed, lost = False, False
    for i in range(0, len(lines), 2):
        line = lines[i]
        if not line or "??" not in line and cost(line) < SUSPECT and not _UTF8.search(line):
            continue
        good = repair(line)
        if good is not None:
            lines[i], fixed = good, True
            lost |= "�" in good
        elif is_lost(line):
            lost = fixed = True
    if whole is not None and (lost or not fixed or cost(whole) < cost("".join(lines))):
        return True, None if "�" in whole else whole
    return fixed, None if lost else "".join(lines)


def _strange(ch: str) -> bool:
    return char_cost(ch) >= 1.0


_table: np.ndarray | None = None


def suspects(texts: list[str]) -> np.ndarray:
    """Which texts hold a strange character, two question marks in a row, or two neighbouring ones beyond ASCII that are neither ideographs nor their signs."""
    global _table
    if _table is None:
        _table = np.full(0x110000, -1, np.int8)
    raw = np.frombuffer(("\n".join(t.replace("\n", " ") for t in texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    got = _table[raw]
    if (got < 0).any():
        for c in np.unique(raw[got < 0]).tolist():
            _table[c] = 2 if char_cost(chr(c)) >= SUSPECT or char_cost(chr(c)) == 0 and (_script(c) or 0x3041 <= c < 0x3100) else 3 if c == 0x3F else 0x80 <= c < 0x2300
        got = _table[raw]
    ends = np.flatnonzero(raw == 10)
    look = (got == 2) | ((got & 1 == 1) & np.r_[got[1:] == got[:-1], False])
    return np.add.reduceat(look.astype(np.int64), np.r_[0, ends[:-1] + 1]) > 0


def restore_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, restored``: every document with wrongly decoded text and its original text, null where characters are lost.

    Null and empty texts, and texts in order, give no row; a row delivered again gives one; texts are processed whole; extra
    columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).where("doc_id is not null and t is not null and t <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                out = [(ids[i], *restore(texts[i])) for i in np.flatnonzero(suspects(texts)).tolist()]
                out = [(i, r) for i, affected, r in out if affected]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], names=["doc_id", "restored"])

    return src.mapInArrow(run, "doc_id long, restored string").distinct()


def p9_found(spark, sf_dir: str) -> DataFrame:
    """Documents with wrongly decoded text, and the hash of the original."""
    r = restore_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return r.select("doc_id", F.coalesce(F.sha2("restored", 256), F.lit("")).alias("restored_hash"))
