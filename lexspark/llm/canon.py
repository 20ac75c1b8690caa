"""Problem 2: one form for texts that look the same.

Method: vocabulary trie and weighted edit automaton. The corpus' own words, in canonical spelling and by frequency, make a trie; the
automaton reads a token along it. An unseen character costs nothing, nor does a character with one look-alike, nor a letter with its
marks apart. A sign that looks like several letters (Greek ρ, υ, ι; in words that mix them l, I, 1 and |, O and 0) goes along with
each of them at a small weight; any other difference costs more than the budget. The cheapest word wins, then the more frequent one:
so the vocabulary decides what no table can (``c1ause`` is ``clause``, ``νalve`` is ``valve``, ``l0`` in nothing known stays).
Tokens without a match are normalized by the table, character by character.

Texts whose characters are all canonical already are passed on as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.runtime import cut

#: Words of the trie at most, and letters of a word.
VOCABULARY, WORD = 20_000, 24
#: What a sign that looks like several letters costs the automaton, what any other difference costs, and what a match may cost.
UNSURE, EDIT, BUDGET = 0.1, 1.0, 0.9

# Characters that are not seen.
_UNSEEN = frozenset([0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFEFF, 0xFFA0, *range(0x180B, 0x1810), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), *range(0xE0000, 0xE1000)])
# Letters of other scripts, and signs, that look as these.
_LOOKS = {
    "ΑАᎪ": "A", "ΒВ": "B", "СϹ": "C", "ΕЕ": "E", "Ԍ": "G", "ΗН": "H", "ΙІӀ": "I", "Ј": "J", "ΚКK": "K", "ΜМ": "M", "ΝԴ": "N", "ΟО": "O", "ΡР": "P", "Ԛ": "Q", "Ѕ": "S", "ΤТ": "T", "Ѵ": "V", "Ԝ": "W", "ΧХ": "X", "ΥҮ": "Y", "ΖꓜᏃ": "Z",
    "аɑ": "a", "сϲ": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "јϳ": "j", "оο": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵν": "v", "ԝ": "w", "х": "x", "уγ": "y",
    "‐‑": "-",
}
# Signs that look like other letters too, or like letters only where the word says so.
_ALIKE = {
    "ι": "il", "κ": "k", "ρ": "p", "τ": "t", "υ": "uv", "χ": "x", "η": "n", "ω": "w", "σ": "o", "ν": "v", "γ": "y", "к": "k", "т": "t", "м": "m", "н": "h", "в": "b", "г": "r", "п": "n", "и": "u",
    "ա": "w", "ո": "n", "ս": "u", "օ": "o", "հ": "h", "ց": "g", "զ": "q", "Տ": "S", "Օ": "O", "Լ": "L", "Ս": "U", "Ⲟ": "O", "ⲟ": "o", "ɡ": "g", "ɩ": "il", "ı": "i", "ł": "l", "−": "-", "–": "-", "ⅼ": "l",
    "l": "I1", "I": "l1", "1": "lI", "|": "lI1", "O": "0", "0": "O", "o": "0",
}
_LOOK = {ord(c): v for k, v in _LOOKS.items() for c in k}
#: Kinds of compatibility characters that are seen to differ from their plain ones.
_SEEN = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>")


@lru_cache(maxsize=1 << 17)
def canonical_char(ch: str) -> str:
    """The table: what stands for a character."""
    if ord(ch) in _UNSEEN:
        return ""
    if ch in "\n\r\t":
        return "\n" if ch != "\t" else " "
    if ch.isspace() or unicodedata.category(ch) == "Zs":
        return " "
    kind = unicodedata.decomposition(ch).split(" ")[0]
    plain = ch if kind in _SEEN else unicodedata.normalize("NFKC", ch)
    if plain != ch and len(plain) == 1 and unicodedata.decomposition(plain).split(" ")[0] in _SEEN:
        return plain
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", plain).translate(_LOOK))


def by_table(text: str) -> str:
    """The canonical form of any text by the table alone."""
    return unicodedata.normalize("NFC", "".join(map(canonical_char, text.replace("\r\n", "\n"))))


class Trie:
    """Words in canonical spelling, the most frequent first, and the automaton that reads tokens along them."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for rank, w in enumerate(words):
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node.setdefault("", (rank, w))

    def match(self, token: str, budget: float = BUDGET) -> str | None:
        """The word that the token spells at a cost within the budget: the cheapest, then the most frequent."""
        states = [(self.root, 0.0, 0, "")]  # node, cost, position, letter that the token's marks may still change
        best = None
        seen = set()
        while states:
            node, cost, i, held = states.pop()
            if cost > budget or (id(node), cost, i, held) in seen:
                continue
            seen.add((id(node), cost, i, held))
            c = canonical_char(token[i]) if i < len(token) else None
            if c == "":  # not seen: costs nothing
                states.append((node, cost, i + 1, held))
                continue
            if held:
                whole = unicodedata.normalize("NFC", held + c) if c else ""
                if len(whole) == 1:  # the mark belongs to the letter before
                    states.append((node, cost, i + 1, whole))
                elif held in node:
                    states.append((node[held], cost, i, ""))
                continue
            if c is None:
                if "" in node and (best is None or (cost, node[""]) < best):
                    best = (cost, node[""])
                if cost + EDIT <= budget:
                    states += [(child, cost + EDIT, i, "") for k, child in node.items() if k]
                continue
            for form, more in ((c, 0.0), *((x, UNSURE) for x in _ALIKE.get(token[i], ""))):
                step = node
                for x in form[:-1]:
                    step = step.get(x) if step else None
                if step is not None and cost + more <= budget:
                    states.append((step, cost + more, i + 1, form[-1]))
            if cost + EDIT <= budget:
                states.append((node, cost + EDIT, i + 1, ""))
                states += [(child, cost + EDIT, i + 1, "") for k, child in node.items() if k]
                states += [(child, cost + EDIT, i, "") for k, child in node.items() if k]
        return best[1][1] if best else None


_TOKEN = re.compile(r"[^\s　，。、；：？！（）,.;:?!()]+")
_CLEAN = re.compile(r"[\n -~、。《》「」『』°Ω²³½¼¾①-⑳À-ÖØ-öø-ɏ㐀-䶿一-鿿]*")
#: Signs and letters of ASCII mixed as in no word or number.
_MIXED = re.compile(r"[a-z][01|][a-z]|(?<![A-Za-z0-9])[01|][a-z]{2}|[0-9][OlI|](?![A-Za-z])|(?<![A-Za-z0-9])[OlI|][0-9]")
_RUNS = re.compile(r"[㐀-䶿一-鿿]+|[^㐀-䶿一-鿿]+")


class Canonical:
    """Texts to their canonical form: tokens by the automaton where it knows them, else by the table."""

    def __init__(self, words: list[str]):
        self.words, self.trie = words, None
        self.known: dict[str, str] = {}

    def token(self, t: str) -> str:
        if _CLEAN.fullmatch(t) and not _MIXED.search(t):
            return t
        got = self.known.get(t)
        if got is None:
            if self.trie is None:
                self.trie = Trie(self.words)
            # Words of letters and digits stand between ideographs without a space.
            got = "".join(by_table(run) if (word := self.trie.match(run)) is None else word for run in _RUNS.findall(t))
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[t] = got
        return got

    def text(self, s: str) -> str:
        if _CLEAN.fullmatch(s) and not _MIXED.search(s):
            return s
        out, at = [], 0
        for m in _TOKEN.finditer(s):
            if m.start() > at:
                out.append(by_table(s[at : m.start()]))
            out.append(self.token(m.group()))
            at = m.end()
        out.append(by_table(s[at:]))
        # A mark at a token's start, an unseen character or a space before it: composed only where it stands behind its letter.
        return unicodedata.normalize("NFC", "".join(out))


def vocabulary(texts: DataFrame, size: int = VOCABULARY, word: int = WORD) -> list[str]:
    """The ``size`` most frequent words of letters and digits, of at most ``word`` of them, over all texts (column ``t``).

    In canonical spelling, the most frequent first. Ideographs need none: no sign looks like several of them.
    """
    tokens = texts.select(F.explode(F.regexp_extract_all("t", F.lit(f"[A-Za-z0-9À-ɏ-]{{2,{word}}}"), F.lit(0))).alias("w"))
    top = tokens.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(size)
    return list(dict.fromkeys(by_table(r.w) for r in top.collect()))


def canonicalize(texts: DataFrame, text_col: str = "t", into: str = "canonical", words: list[str] | None = None) -> DataFrame:
    """All rows with the canonical form of a text in column ``into``.

    Null stays null and empty stays empty; a text of unseen characters only becomes empty. Other columns are kept as they are (a
    column of the name ``into`` is replaced).
    """
    words = vocabulary(texts.select(F.col(text_col).alias("t")).where("t is not null")) if words is None else words
    rest = texts.drop(into)
    if "__text" in rest.columns:
        raise ValueError("the column name __text is taken")
    given = rest.withColumn("__text", F.col(text_col).cast("string"))
    schema = given.drop("__text").schema.add(into, "string")
    canon = Canonical(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            form = pa.array([None if s is None else canon.text(s) for s in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], form], names=[*b.schema.names[:-1], into])

    return given.mapInArrow(run, schema)


def look_classes(texts: DataFrame, words: list[str] | None = None) -> DataFrame:
    """``field_name, scope, id, look, spelled, links``: every record whose text looks like another one's without being equal to it.

    ``look`` names the class of all texts that look the same, ``spelled`` the text itself; ``links`` is the number of records of the
    class that are spelled otherwise. One row a record, whatever the size of its class: this is the form for large classes.
    ``texts`` has ``field_name, scope, id, t``; texts of the same scope are compared. Null texts look like nothing; rows delivered
    again count once. Only digests are shuffled; spellings are counted before they are.
    """
    words = vocabulary(texts.select("t").where("t is not null")) if words is None else words
    canon = Canonical(words)
    schema = pa.schema([("field_name", pa.string()), ("scope", pa.int64()), ("id", pa.int64()), ("look", pa.binary()), ("spelled", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(3).to_pylist()
            digest = lambda s: blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([digest(canon.text(s)) for s in raw], pa.binary()), pa.array([digest(s) for s in raw], pa.binary())], schema=schema)

    src = texts.select("field_name", F.col("scope").cast("long").alias("scope"), F.col("id").cast("long").alias("id"), "t").where("t is not null and id is not null")
    forms = cut(src.mapInArrow(run, "field_name string, scope long, id long, look binary, spelled binary"))  # texts are read once, two digests a record kept
    key = ["field_name", "scope", "look"]
    mixed = forms.groupBy(*key).agg(F.min("spelled").alias("lo"), F.max("spelled").alias("hi")).where("lo <> hi").select(*key)
    some = cut(forms.join(mixed, key, "left_semi").distinct())
    n = some.groupBy(*key, "spelled").agg(F.count("*").alias("n"))
    links = n.join(n.groupBy(*key).agg(F.sum("n").alias("all")), key).select(*key, "spelled", (F.col("all") - F.col("n")).alias("links"))
    return some.join(links, [*key, "spelled"]).select("field_name", "scope", "id", "look", "spelled", "links")


def same_look(texts: DataFrame, words: list[str] | None = None, block: int = 2_000) -> DataFrame:
    """``field_name, id_1, id_2``: pairs of different texts of one field and scope that look the same, id_1 < id_2.

    The pairs of ``look_classes``, for who needs them one by one. Unlike spellings are paired first, then blocks of at most about
    ``block`` records of each, then the records: copies of one spelling are never set against each other, and a large class is
    spread over its pairs of blocks.
    """
    key = ["field_name", "scope", "look"]
    some = cut(look_classes(texts, words).select(*key, "spelled", "id"))
    sizes = some.groupBy(*key, "spelled").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    # Copies of a spelling get their block by their id; the number of blocks goes to them as a small row for each spelling.
    placed = some.join(sizes, [*key, "spelled"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = lambda s, x: sizes.select(*key, F.col("spelled").alias(s), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(x))
    unlike = spread("s1", "x1").join(spread("s2", "x2"), key).where("s1 < s2")
    a = placed.select(*key, F.col("spelled").alias("s1"), F.col("part").alias("x1"), F.col("id").alias("a"))
    b = placed.select(*key, F.col("spelled").alias("s2"), F.col("part").alias("x2"), F.col("id").alias("b"))
    pairs = unlike.join(a, [*key, "s1", "x1"]).join(b, [*key, "s2", "x2"]).where("a <> b")
    return pairs.select("field_name", F.least("a", "b").alias("id_1"), F.greatest("a", "b").alias("id_2")).distinct()


def p2_texts(spark, sf_dir: str) -> DataFrame:
    chunks, cases = spark.read.parquet(f"{sf_dir}/law_chunks.parquet"), spark.read.parquet(f"{sf_dir}/eval_cases.parquet")
    two = chunks.select(
        F.explode(
            F.array(
                F.struct(F.lit("content").alias("field_name"), F.lit(0).cast("long").alias("scope"), F.col("chunk_id").alias("id"), F.col("content").alias("t")),
                F.struct(F.lit("article_label").alias("field_name"), F.col("version_id").alias("scope"), F.col("chunk_id").alias("id"), F.col("article_label").alias("t")),
            )
        ).alias("x")
    ).select("x.*")
    return two.unionByName(cases.select(F.lit("query").alias("field_name"), F.lit(0).cast("long").alias("scope"), F.col("case_id").alias("id"), F.col("query").alias("t")))


def p2_found(spark, sf_dir: str) -> DataFrame:
    """Pairs of chunks' contents, of labels in one version, and of queries, that look the same without being equal."""
    return same_look(p2_texts(spark, sf_dir))


def p2_canonical(spark, sf_dir: str) -> DataFrame:
    """Every content, label and query in its canonical form."""
    return canonicalize(p2_texts(spark, sf_dir)).select("field_name", "id", "canonical").distinct()


def p2_classes(spark, sf_dir: str) -> DataFrame:
    """Every content, label and query that looks like another without being equal, with its class and number of links."""
    c = look_classes(p2_texts(spark, sf_dir))
    return c.select("field_name", "id", F.hex("look").alias("class_id"), "links").distinct()
