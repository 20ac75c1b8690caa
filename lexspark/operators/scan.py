"""Hybrid search of many queries at once, without postings: provisions are read as rows of numbers, block by block.

With as many queries as laws, each term of each query meets each of its postings, and each candidate its wide provision: as joins
they outgrow the input many times. Here each provision is written once with what the queries' own words need of it (terms as
numbers, vector, article, terms it defines), and each task takes a share of the queries over all blocks. Nothing but the best k of
each query leaves a task; memory is bounded by a block and the candidates of a share.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators import retrieval as R
from lexspark.runtime import cut, read_batches, read_rows, shared_path

#: Provisions of the first and of the largest block: small blocks first give the scores that later ones must reach.
FIRST, BLOCK = 8_192, 32_768
#: Queries that a task takes at most, cells of a table of queries by terms, pairs that are listed and scored at once.
SHARE, CELLS, LISTED, PAIRS = 4_000, 1 << 25, 1 << 20, 1 << 13
#: Provisions whose texts are read at once.
ROWS = 2_000
_FIELDS = ("content", "heading", "title", "label")
_WHOLE = re.compile("[㐀-鿿A-Za-z0-9]+")
_ROW = "chunk_id long, dl long, terms array<int>, tfs array<int>, content array<int>, heading array<int>, title array<int>, law int, article int, defined array<string>, text string, cv array<double>"


class _Vocabulary:
    """The queries' terms, titles and articles as numbers (places in sorted order), the same in every task."""

    def __init__(self, path: str):
        t = read_rows(path)
        by: dict[str, list[str]] = {"term": [], "law": [], "article": []}
        for kind, value in zip(t.column("kind").to_pylist(), t.column("value").to_pylist()):
            by[kind].append(value)
        # Only tokens and their runs can stand in a provision's terms.
        self.terms = {x: i for i, x in enumerate(sorted(x for x in by["term"] if _WHOLE.fullmatch(x)))}
        self.laws, self.articles = ({x: i for i, x in enumerate(sorted(by[k]))} for k in ("law", "article"))
        short = sorted((sum(ord(ch) << 16 * i for i, ch in enumerate(x)), i) for x, i in self.terms.items() if len(x) <= 3)
        self.keys, self.ids = np.array([k for k, _ in short] or [0], np.int64), np.array([i for _, i in short] or [-1], np.int64)
        self.used = np.zeros(1 << 16, bool)
        self.used[[ord(ch) for x in self.terms if len(x) <= 3 for ch in x]] = True


_KNOWN: dict[str, _Vocabulary] = {}


def _vocabulary(path: str) -> _Vocabulary:
    """The vocabulary of one search; a worker keeps it."""
    if path not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[path] = _Vocabulary(path)
    return _KNOWN[path]


def _lists(key: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets by row, values, counts) of keys ``row * size + value``: each row's distinct values in order."""
    key, count = np.unique(key, return_counts=True)
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(key // size, minlength=n), out=offsets[1:])
    return offsets, (key % size).astype(np.int32), count.astype(np.int32)


def _numbered(texts: list[str], v: _Vocabulary) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray] | np.ndarray]:
    """Of rows of four fields in small letters: the number of index terms (``dl``), the known ones, and the known lexical terms by field.

    Index terms and lexical terms are those of ``X.index_terms`` and ``X.lexical_terms``, found for the whole batch at once.
    """
    n, size = len(texts) // len(_FIELDS), max(1, len(v.terms))
    joined = "\n" + "\n".join(texts) + "\n\n\n"
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts) + 2), [1, *(len(t) + 1 for t in texts), 2]) - 1
    letter = ((code >= 48) & (code <= 57)) | ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122))
    inside = letter | ((code >= 0x3400) & (code <= 0x9FFF))
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    length, letters = end - begin, np.concatenate([[0], np.cumsum(letter)])
    mixed = letters[end] > letters[begin]
    all_terms = 3 * length - 3 + (length == 1) + (length > 3)  # runs of one, two and three, and the token
    dl = np.bincount(owner[begin] // 4, weights=all_terms, minlength=n).astype(np.int64)
    known = v.used[np.minimum(code, 0xFFFF)] & inside
    one = np.flatnonzero(known)
    two = one[known[one + 1]]
    three = two[known[two + 2]]
    at, ids = [], []
    for pos, key in ((one, code[one]), (two, code[two] | code[two + 1] << 16), (three, code[three] | code[three + 1] << 16 | code[three + 2] << 32)):
        place = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        ok = v.keys[place] == key
        at.append(pos[ok])
        ids.append(v.ids[place[ok]])
    whole = np.flatnonzero((length > 3) | mixed)
    of = np.fromiter((v.terms.get(joined[a:b], -1) for a, b in zip(begin[whole].tolist(), end[whole].tolist())), np.int64, len(whole))
    whole, of = whole[of >= 0], of[of >= 0]
    long = length[whole] > 3
    place, term = np.concatenate([*at, begin[whole[long]]]), np.concatenate([*ids, of[long]])
    out = {"dl": dl, "terms": _lists(owner[place] // 4 * size + term, n, size)}
    place, term = np.concatenate(at[1:]), np.concatenate(ids[1:])
    pure = ~mixed[np.searchsorted(begin, place, "right") - 1] if len(place) else np.zeros(0, bool)
    place, term = np.concatenate([place[pure], begin[whole[mixed[whole]]]]), np.concatenate([term[pure], of[mixed[whole]]])
    for i, f in enumerate(_FIELDS[:3]):
        own = owner[place] % 4 == i
        out[f] = _lists(owner[place[own]] // 4 * size + term[own], n, size)
    return out


def _rows_of_numbers(docs: DataFrame, vocabulary: str, path: str, embed: Callable[[Column], Column]) -> None:
    """Writes each provision with what the queries of a vocabulary need of it."""

    def run(batches):
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            v = _vocabulary(vocabulary)
            fields = [b.column(f"_{f}").to_pylist() for f in _FIELDS]
            x = _numbered([t for row in zip(*fields) for t in row], v)
            lists = lambda name, i=1: pa.ListArray.from_arrays(pa.array(x[name][0]), pa.array(x[name][i]))
            number = lambda name, known: pa.array([known.get(t, -1) for t in b.column(name).to_pylist()], pa.int32())
            cols = [b.column("chunk_id"), pa.array(x["dl"]), lists("terms"), lists("terms", 2), *(lists(f) for f in _FIELDS[:3]), number("law_title", v.laws), number("article", v.articles)]
            cols += [b.column(c) for c in ("defined", "text", "cv")]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _ROW.split(", ")])

    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    text = F.concat_ws("\n", F.coalesce("law_title", F.lit("")), F.coalesce("heading", F.lit("")), F.coalesce("article_label", F.lit("")), "content")
    rows = docs.select(
        "chunk_id", "law_title", embed(text).cast("array<double>").alias("cv"), low("content").alias("_content"), low("heading").alias("_heading"), low("law_title").alias("_title"), low("article_label").alias("_label"),
        X.canonical_label(F.col("article_label")).alias("article"), F.coalesce(X.defined_terms(F.col("content")), F.array().cast("array<string>")).alias("defined"),
        F.lower(F.concat_ws(" ", "law_title", "article_label", "heading", "content")).alias("text"),
    )
    rows.mapInArrow(run, _ROW).write.parquet(path)


def _blocks(path: str, columns: list[str]) -> Iterator[tuple[int, pa.Table]]:
    """(number of rows before, block): all rows in an order that is the same every time; blocks grow up to ``BLOCK`` rows."""
    base, want, held, n = 0, FIRST, [], 0
    for b in read_batches(path, columns):
        while n + b.num_rows >= want:
            held.append(b.slice(0, want - n))
            b = b.slice(want - n)
            yield base, pa.Table.from_batches(held).combine_chunks()
            base, held, n, want = base + want, [], 0, min(BLOCK, 2 * want)
        if b.num_rows:
            held.append(b)
            n += b.num_rows
    if n:
        yield base, pa.Table.from_batches(held).combine_chunks()


def _list(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a list column."""
    a = t.column(name).combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    offsets = a.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], a.flatten().to_numpy(zero_copy_only=False)


def _gather(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the values of the rows one after another, bounds of each row in them)."""
    length = offsets[rows + 1] - offsets[rows]
    bounds = np.concatenate([[0], np.cumsum(length)])
    return np.arange(bounds[-1]) + np.repeat(offsets[rows] - bounds[:-1], length), bounds


def _half_up(x: np.ndarray) -> np.ndarray:
    low = np.floor(x)
    return (low + (x - low >= 0.5)).astype(np.int64)


def _weights(path: str, size: int) -> tuple[np.ndarray, float, int]:
    """The weight of each term by its number of provisions, the mean length of all provisions and their number."""
    n = total = 0
    df = np.zeros(size, np.int64)
    for _, t in _blocks(path, ["dl", "terms"]):
        n, total = n + t.num_rows, total + int(t.column("dl").to_numpy().sum())
        df += np.bincount(_list(t, "terms")[1], minlength=size)
    return np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 1e-6), total / max(1, n), n


def _candidates(path: str, asked: list[np.ndarray], size: int, k: int, guess: bool = True) -> list[np.ndarray]:
    """The places of the k best rows of each query by BM25 (of equals the smaller id first).

    A sum holds the weights in whole 1e-9 and, in its last seven bits, how many terms were found. From the second block on, terms
    whose weights together can't lift a row to the k best are added only to rows that another term was found in, and that can reach it.
    What the k best reach is guessed from the first block, a sample; a query for which fewer than k rows reach the guess is searched
    again without.
    """
    idf, mean, n = _weights(path, size)
    none = np.zeros(0, np.int64)
    top = [(none, none, none)] * len(asked)
    need = np.ones(len(asked), np.int64)
    guessed = np.zeros(len(asked), np.int64)
    pick = np.zeros(size, bool)
    sample = int(1.25 * k * FIRST / max(1, n)) + 12
    for base, t in _blocks(path, ["chunk_id", "dl", "terms", "tfs"]):
        doc, dl = t.column("chunk_id").to_numpy(), t.column("dl").to_numpy()
        (offsets, term), tf = _list(t, "terms"), _list(t, "tfs")[1]
        row = np.repeat(np.arange(len(doc)), np.diff(offsets))
        w = idf[term]
        w *= tf * (R.K1 + 1)
        w /= (R.K1 * (1 - R.B + R.B * dl / mean))[row] + tf
        w *= 1e9
        w += 0.5
        w = w.astype(np.int64)
        w *= 128
        w += 1
        del dl, tf
        order = np.argsort(term.astype(np.uint16) if size < 1 << 16 else term, kind="stable")
        row, weight = row[order], w[order]
        del order
        start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=size))])
        most = np.zeros(size, np.int64)
        if len(weight):
            held = np.flatnonzero(np.diff(start))
            most[held] = np.maximum.reduceat(weight, start[held])
        acc = np.zeros(len(doc), np.int64)
        for i, terms in enumerate(asked):
            terms = terms[most[terms] > 0]
            if not len(terms):
                continue
            terms = terms[np.argsort(-most[terms], kind="stable")]
            rest = np.concatenate([np.cumsum(most[terms][::-1])[::-1], [0]])  # what the terms from here on give at most
            if rest[0] < need[i]:
                continue
            first = int(np.argmax(rest < max(1, need[i] // 2)))  # at half, few rows are left for the others
            ends = list(zip(start[terms].tolist(), start[terms + 1].tolist()))
            acc.fill(0)
            for a, b in ends[:first]:
                np.add.at(acc, row[a:b], weight[a:b])
            some = np.flatnonzero(acc >= max(1, need[i] - rest[first]))
            if first < len(terms):
                later = terms[first:]
                if 4 * len(some) * (len(term) // len(doc) + 1) < int((start[later + 1] - start[later]).sum()):
                    pick[later] = True
                    places, bounds = _gather(offsets, some)
                    sums = np.concatenate([[0], np.cumsum(np.where(pick[term[places]], w[places], 0))])
                    pick[later] = False
                    got = acc[some] + sums[bounds[1:]] - sums[bounds[:-1]]
                else:
                    for a, b in ends[first:]:
                        np.add.at(acc, row[a:b], weight[a:b])
                    got = acc[some]
                some, got = some[got >= need[i]], got[got >= need[i]]
            else:
                got = acc[some]
            s, ids, at = (np.concatenate([a, b]) for a, b in zip(top[i], (((got >> 7) + 500) // 1_000, doc[some], some + base)))
            if len(s) > k:
                best = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                best = best[np.lexsort((ids[best], -s[best]))[:k]]
                s, ids, at = s[best], ids[best], at[best]
            if len(s) == k:
                need[i] = max(need[i], (int(s.min()) * 1_000 - 500) * 128)
            if not base and guess and n > len(doc) and sample < len(s):
                guessed[i] = np.partition(s, len(s) - sample)[len(s) - sample]
                need[i] = max(need[i], (guessed[i] * 1_000 - 500) * 128)
            top[i] = (s, ids, at)
    out = [at for _, _, at in top]
    again = [i for i in np.flatnonzero(guessed) if len(out[i]) < k or top[i][0].min() < guessed[i]]
    for i, at in zip(again, _candidates(path, [asked[i] for i in again], size, k, False) if again else []):
        out[i] = at
    return out


def _pairs(n: int, top: np.ndarray, law_q: np.ndarray, span: np.ndarray, by_law: np.ndarray, bare: np.ndarray, words: list[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """(queries, rows, first query, table of the queries from it by terms) of the pairs to score in a block of n rows, some at a time.

    Pairs are those of ``top`` (query * n + row, sorted), the rows of the laws a query means, and all rows for ``bare`` queries.
    """
    each = np.bincount(top // n, minlength=len(words)) + np.bincount(law_q, weights=span[1] - span[0], minlength=len(words)).astype(np.int64) + bare * n
    before = np.concatenate([[0], np.cumsum(each)])
    q0 = 0
    while q0 < len(words):
        q1 = min(len(words), q0 + max(1, CELLS // size), max(q0 + 1, int(np.searchsorted(before, before[q0] + LISTED, "right")) - 1))
        a, b = np.searchsorted(law_q, [q0, q1])
        places, bounds = _gather(np.ravel(span[:, a:b], "F"), np.arange(0, 2 * (b - a), 2)) if b > a else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        i, j = np.searchsorted(top, [q0 * n, q1 * n])
        every = q0 + np.flatnonzero(bare[q0:q1])
        key = np.unique(np.concatenate([top[i:j], np.repeat(law_q[a:b], np.diff(bounds)) * n + by_law[places], np.add.outer(every * n, np.arange(n)).ravel()]))
        if len(key):
            has = np.zeros((q1 - q0, size), bool)
            for x in range(q0, q1):
                has[x - q0, words[x]] = True
            for at in range(0, len(key), PAIRS):
                yield key[at : at + PAIRS] // n, key[at : at + PAIRS] % n, q0, has
        q0 = q1


def _best(path: str, queries: pa.Table, v: _Vocabulary, k: int, candidates: int, permille: int) -> dict[str, np.ndarray]:
    """The k best rows of each query of a share by vectors and words together."""
    ids = queries.column("query_id").to_numpy()
    size = max(1, len(v.terms))
    numbers = lambda name, known: [np.array([known[x] for x in xs if x in known], np.int64) for xs in queries.column(name).to_pylist()]
    found = _candidates(path, numbers("terms", v.terms), size, candidates)
    side = queries.column("qs").to_pylist()
    words = [np.array([v.terms[x] for x in s["terms"] if x in v.terms], np.int64) for s in side]
    n_words = np.array([len(s["terms"]) for s in side], np.float64)
    article = np.array([v.articles.get(s["article"], -2) for s in side], np.int64)
    laws = numbers("titles", v.laws)
    defines, focus = np.array([s["defines"] for s in side], bool), np.array([bool(s["focus"]) for s in side], bool)
    qv = np.ascontiguousarray(np.array(queries.column("qv").to_pylist(), np.float64).reshape(len(ids), -1).T)
    pair_q, pair_at = np.repeat(np.arange(len(ids)), [len(x) for x in found]), np.concatenate([np.zeros(0, np.int64), *found])
    order = np.argsort(pair_at, kind="stable")
    pair_q, pair_at = pair_q[order], pair_at[order]
    bare = np.array([not len(a) and not len(b) for a, b in zip(found, laws)], bool)  # nothing of them stands anywhere: all rows, unless a title has some
    out = {c: np.zeros(0, t) for c, t in (("q", np.int64), ("chunk_id", np.int64), ("vm", np.int64), ("lm", np.int64), ("hm", np.int64))}
    columns = ["chunk_id", "content", "heading", "title", "law", "article", "defined", "cv"] + ["text"] * bool(focus.any())
    law_q, law_of = np.repeat(np.arange(len(ids)), [len(x) for x in laws]), np.concatenate([np.zeros(0, np.int64), *laws])
    named_keys = np.sort(law_q * (len(v.laws) + 1) + law_of)
    for base, t in _blocks(path, columns):
        n = t.num_rows
        law, doc = t.column("law").to_numpy().astype(np.int64), t.column("chunk_id").to_numpy()
        by_law = np.argsort(law, kind="stable")
        span = np.stack([np.searchsorted(law[by_law], law_of), np.searchsorted(law[by_law], law_of, "right")])
        lo, hi = np.searchsorted(pair_at, [base, base + n])
        key_top = np.sort(pair_q[lo:hi] * n + pair_at[lo:hi] - base)
        fields = {f: _list(t, f) for f in _FIELDS[:3]}
        own_article, defined = t.column("article").to_numpy(), t.column("defined").combine_chunks()
        n_defined = np.diff(_list(t, "defined")[0])
        cv = np.ascontiguousarray(_list(t, "cv")[1].reshape(n, -1).T)
        for q, d, q0, has in _pairs(n, key_top, law_q, span, by_law, bare, words, size):
            lex = np.where(article[q] == own_article[d], 1.0, 0.0)
            for f, share in (("content", 1.0), ("heading", 0.9), ("title", 0.8)):
                places, bounds = _gather(fields[f][0], d)
                hit = np.concatenate([[0], np.cumsum(has[np.repeat(q - q0, np.diff(bounds)), fields[f][1][places]])])  # of each row's known terms, those of its query
                lex = np.maximum(lex, (hit[bounds[1:]] - hit[bounds[:-1]]) / n_words[q] * share)
            for i in np.flatnonzero(defines[q] & (n_defined[d] > 0)):
                s = side[q[i]]
                lex[i] = max(lex[i], 1.0 if any(x in s["run"] for x in defined[d[i]].as_py()) else 0.55 if s["explicit"] else 0.0)
            if focus.any():
                for i in np.flatnonzero(focus[q]):
                    body = t.column("text")[int(d[i])].as_py()
                    if any(x in body for x in side[q[i]]["focus"]):
                        lex[i] = 1.0
            name = q * (len(v.laws) + 1) + law[d]
            if len(named_keys):
                named = (law[d] >= 0) & (named_keys[np.minimum(np.searchsorted(named_keys, name), len(named_keys) - 1)] == name)
                lex = lex + np.where(named, R.TITLE_BOOST, 0.0)
            # Added place by place, as the vectors' product is elsewhere.
            vec = np.add.reduce(qv[:, q] * cv[:, d], axis=0)
            vm, lm = _half_up(np.clip(vec, 0.0, 1.0) * 1e6), _half_up(np.minimum(lex, 1.0) * 1e6)
            new = {"q": q, "chunk_id": doc[d], "vm": vm, "lm": lm, "hm": (vm * permille + lm * (1_000 - permille) + 500) // 1_000}
            out = {c: np.concatenate([x, new[c]]) for c, x in out.items()}
            order = np.lexsort((out["chunk_id"], -out["hm"], out["q"]))
            pos = np.arange(len(order)) - np.searchsorted(out["q"][order], out["q"][order])
            keep = order[pos < k]
            out = {c: x[keep] for c, x in out.items()}
    pos = np.arange(len(out["q"])) - np.searchsorted(out["q"], out["q"]) + 1
    return {"query_id": ids[out["q"]], "chunk_id": out["chunk_id"], "vector_score": out["vm"] / 1e6, "lexical_score": out["lm"] / 1e6, "hybrid_score": out["hm"] / 1e6, "pos": pos}


def hybrid_topk(queries: DataFrame, index: R.Index, k: int, candidates: int = R.CANDIDATES, weight: float = R.HASH_WEIGHT, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of ``retrieval.hybrid_topk`` for many queries: reads the index's provisions, no postings and no vectors.

    ``embed`` makes the vectors of queries and provisions.
    """
    spark, embed, permille = index.spark, embed or R.hash_embedding, round(weight * 1_000)
    docs = index.table("docs")
    q = cut(queries).select("query_id", X.normalize_query(F.col("query")).alias("query")).withColumn("lex", X.expand_query(F.col("query")))
    titles = R.longest_titles(cut(R.title_matches(q, index.table("titles")))).groupBy("query_id").agg(F.collect_set("title").alias("titles"))
    none = F.array().cast("array<string>")
    asked = q.select("query_id", embed(F.col("query")).cast("array<double>").alias("qv"), X.query_side(F.col("lex")).alias("qs"), F.coalesce(X.match_terms(F.col("lex")), none).alias("terms"))
    asked_path, vocabulary, path = (shared_path(spark, x) for x in ("asked", "vocabulary", "numbers"))
    asked.join(titles, "query_id", "left").withColumn("titles", F.coalesce("titles", none)).write.parquet(asked_path)
    asked = spark.read.parquet(asked_path)
    kind = lambda name, c: asked.select(F.lit(name).alias("kind"), F.explode(c).alias("value"))
    known = kind("term", F.array_union("terms", "qs.terms")).union(kind("law", F.col("titles"))).union(kind("article", F.array_compact(F.array("qs.article"))))
    known.where("value is not null").distinct().coalesce(1).write.parquet(vocabulary)
    _rows_of_numbers(docs, vocabulary, path, embed)

    def run(batches):
        if held := [b for b in batches if b.num_rows]:
            best = _best(path, pa.Table.from_batches(held), _vocabulary(vocabulary), k, candidates, permille)
            yield pa.RecordBatch.from_pydict(best)

    shares = max(spark.sparkContext.defaultParallelism, -(-asked.count() // SHARE))
    found = asked.repartition(shares).mapInArrow(run, "query_id long, chunk_id long, vector_score double, lexical_score double, hybrid_score double, pos long")
    return found.join(docs, "chunk_id").withColumn("retrieval_mode", F.lit("hybrid"))
