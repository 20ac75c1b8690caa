"""Index, lexical and vector retrieval for batches of queries: every operator takes a table of queries.

The index is a set of tables in one folder, written once and read by every search: postings by bucket of the term with each
document's length, document frequencies, the corpus' statistics, and the provisions with their vectors and what scoring needs of
them. A search reads the buckets of its terms and the provisions that are candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from lexspark.functions import text as X
from lexspark.runtime import cut, read_rows, shared_path, tasks

K1, B = 1.2, 0.75
#: Candidates by BM25, weight of the hash vectors, gain for a matched title.
CANDIDATES, HASH_WEIGHT, TITLE_BOOST = 300, 0.30, 0.12
#: Terms of queries (query and term, some 60 bytes each) up to which they are broadcast to the postings.
BROADCAST_TERMS = 500_000
#: Parts of a bucket of postings.
SPREAD = 16
#: Columns of a provision that its index terms come from.
INDEXED = ("law_title", "article_label", "heading", "content")


def current_chunks(chunks: DataFrame, versions: DataFrame, laws: DataFrame, vectors: bool = False) -> DataFrame:
    """The chunks of each law's newest version with its version and law; rows delivered again count once."""
    w = Window.partitionBy("law_id").orderBy(F.desc("version_no"), F.desc("version_id"))
    v = versions.select("version_id", "law_id", "version_no", "metadata_json").dropDuplicates(["version_id"])
    newest = v.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    law = laws.select("law_id", F.regexp_replace("title", r"(?U)^\s+|\s+$", "").alias("law_title"), "category", "source_url").dropDuplicates(["law_id"])
    cols = ["chunk_id", "version_id", "seq", "article_label", "heading", "content"] + ["embedding"] * vectors
    full = chunks.select(*cols).join(newest, "version_id").join(law, "law_id")
    return full.repartition(tasks(chunks.sparkSession), "chunk_id").dropDuplicates(["chunk_id"])  # one exchange for both


def source_type(category: Column, own: str = "消防署函釋") -> Column:
    return F.when(category == own, "nfa_interpretation").otherwise("law")


def postings(docs: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """``term, doc, tf``: how often each index term occurs in each document's columns."""
    one = docs.select(F.col(id_col).alias("doc"), F.explode(F.concat(*(X.index_terms(F.coalesce(c, F.lit(""))) for c in text_cols))).alias("term"))
    return one.groupBy("term", "doc").agg(F.count("*").alias("tf"))


def doc_lengths(docs: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """``doc, dl``: the number of index terms of each document."""
    return docs.select(F.col(id_col).alias("doc"), F.size(F.concat(*(X.index_terms(F.coalesce(c, F.lit(""))) for c in text_cols))).cast("long").alias("dl"))


#: Columns of the tables that are laid out by bucket (without rows they have no files).
_TABLES = {"postings": "doc long, term string, dl long, tf long, bucket int", "terms": "term string, df long, bucket int"}


class Index:
    """The tables of an index in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._buckets: int | None = None

    @property
    def buckets(self) -> int:
        if self._buckets is None:
            self._buckets = self.table("stats").first()["buckets"]
        return self._buckets

    def table(self, name: str) -> DataFrame:
        """``postings`` (term, doc, tf, dl, bucket), ``terms`` (term, df, bucket), ``stats`` (n, avgdl, buckets), of provisions ``docs`` and ``titles``."""
        read = self.spark.read.schema(_TABLES[name]) if name in _TABLES else self.spark.read
        return read.parquet(f"{self.path}/{name}")


def bucket_of(term: Column, buckets: Column | int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("int")


def write_postings(docs: DataFrame, id_col: str, text_cols: list[str], path: str | None = None, buckets: int | None = None) -> Index:
    """Postings, document frequencies and statistics of the documents' index terms, under ``path`` (else in the shared folder).

    Postings are laid out by bucket of the term, each bucket in ``SPREAD`` parts by document: a document has a term once, so no term
    can hold more than a small share of all rows, and one that every document has is spread over that many tasks.
    """
    spark = docs.sparkSession
    n = tasks(spark)
    index = Index(spark, path or shared_path(spark, "index"))
    buckets = buckets or max(16, n)
    words = docs.select(F.col(id_col).cast("long").alias("doc"), F.concat(*(X.index_terms(F.coalesce(c, F.lit(""))) for c in text_cols)).alias("terms"))
    one = words.select("doc", F.size("terms").cast("long").alias("dl"), F.explode("terms").alias("term"))
    tf = one.groupBy("doc", "term", "dl").agg(F.count("*").alias("tf")).withColumn("bucket", bucket_of(F.col("term"), buckets))
    tf.repartition(n, "bucket", F.pmod(F.xxhash64("doc"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{index.path}/postings")
    df = index.table("postings").groupBy("bucket", "term").agg(F.count("*").alias("df"))
    df.repartition(n, "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{index.path}/terms")
    lengths = docs.select("dl") if "dl" in docs.columns else words.select(F.size("terms").cast("long").alias("dl"))
    lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{index.path}/stats")
    return index


def build_index(chunks: DataFrame, path: str | None = None, embed: Callable[[Column], Column] | None = None, postings: bool = True) -> Index:
    """The index of provisions as of ``current_chunks``: postings of all their columns, and ``docs`` with their vectors and terms.

    ``embed`` makes the vectors (``cv``) from a provision's title, heading, label and content; without it hash vectors. Without
    ``postings`` there are only the provisions and titles, enough for ``search`` with ``scan.hybrid_topk``.
    """
    index = Index(chunks.sparkSession, path or shared_path(chunks.sparkSession, "index"))
    if not postings:
        chunks.write.parquet(f"{index.path}/docs")
        index.table("docs").select(F.col("law_title").alias("title")).distinct().coalesce(tasks(index.spark)).write.parquet(f"{index.path}/titles")
        return index
    text = F.concat_ws("\n", F.coalesce("law_title", F.lit("")), F.coalesce("heading", F.lit("")), F.coalesce("article_label", F.lit("")), "content")
    dl = F.size(F.concat(*(X.index_terms(F.coalesce(c, F.lit(""))) for c in INDEXED))).cast("long")
    full = chunks.withColumns({"dl": dl, "cv": (embed or hash_embedding)(text), "ps": X.provision_side(F.col("law_title"), F.col("article_label"), F.col("heading"), F.col("content"))})
    full.write.parquet(f"{index.path}/docs")
    docs = index.table("docs")
    docs.select(F.col("law_title").alias("title")).distinct().coalesce(tasks(index.spark)).write.parquet(f"{index.path}/titles")
    return write_postings(docs.select("chunk_id", *INDEXED, "dl"), "chunk_id", list(INDEXED), index.path)


def _wanted(queries: DataFrame, index: Index) -> tuple[DataFrame, list[int], bool]:
    """(``query_id, term, bucket``, the buckets that the terms lie in, whether the terms are few enough to be broadcast).

    The buckets are at most as many as the index has. They and the number of terms come from one job.
    """
    want = queries.select("query_id", F.explode(X.match_terms(F.col("query"))).alias("term")).distinct()
    want = want.withColumn("bucket", bucket_of(F.col("term"), index.buckets))
    seen = want.agg(F.collect_set("bucket").alias("buckets"), F.count("*").alias("n")).first()
    return want, sorted(seen["buckets"]), seen["n"] <= BROADCAST_TERMS


def bm25_topk(queries: DataFrame, index: Index, k: int, wanted: tuple[DataFrame, list[int], bool] | None = None) -> DataFrame:
    """``query_id, doc, score, rank``: the k best documents of each query by BM25 over its terms; of equals the smaller id first.

    ``queries`` has ``query_id, query``. Only the buckets of the queries' terms are read from the index, no text. A query without
    terms, or whose terms stand nowhere, gives no rows.
    """
    want, buckets, few = wanted or _wanted(queries, index)
    near = lambda name: index.table(name).where(F.col("bucket").isin(buckets))
    known = want.join(near("terms"), ["bucket", "term"])
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    known = known.crossJoin(F.broadcast(index.table("stats"))).select("query_id", "bucket", "term", "avgdl", idf.alias("idf"))  # one row of statistics
    weight = F.col("idf") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # Whole numbers (of 1e-9) add up the same in any order.
    scored = near("postings").join(F.broadcast(known), ["bucket", "term"]) if few else near("postings").hint("merge").join(known, ["bucket", "term"])
    scored = scored.select("query_id", "doc", F.round(weight * 1e9).cast("long").alias("w"))
    hits = scored.groupBy("query_id", "doc").agg(F.round(F.sum("w") / 1e9, 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    """Scalar product of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 where either is all zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


_BLOCKS: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}


def _query_blocks(path: str, block: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The queries' ids and unit vectors from the shared folder, in blocks; a worker keeps those of one search."""
    if path not in _BLOCKS:
        _BLOCKS.clear()
        t = read_rows(path)
        ids = t.column("query_id").to_numpy()
        q = np.array(t.column("vector").to_pylist(), dtype=np.float64).reshape(len(ids), -1)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        _BLOCKS[path] = [(ids[i : i + block], q[i : i + block]) for i in range(0, len(ids), block)]
    return _BLOCKS[path]


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, block: int = 2_000) -> DataFrame:
    """``query_id, doc, score, rank``: the k most similar vectors of each query vector, by matrix products block by block.

    ``queries`` has ``query_id, vector``; they are written to the shared folder, where tasks read them, and all their blocks go over
    ``vectors`` (``doc, vector``) in one scan, which keeps k rows a query and batch. A query isn't its own neighbour where the ids
    are equal. Of equals the smaller id first.
    """
    path = shared_path(queries.sparkSession, "queries")
    queries.select("query_id", "vector").write.parquet(path)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.array(pdf["vector"].tolist(), dtype=np.float64)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            doc = pdf["doc"].to_numpy()
            take = np.argsort(doc, kind="stable")
            for ids, q in _query_blocks(path, block):
                s = np.round(q @ v.T, 6)
                s[ids[:, None] == doc[None, :]] = -9
                best = np.argsort(-s[:, take], axis=1, kind="stable")[:, :k]
                a = np.repeat(np.arange(len(ids)), best.shape[1])
                b = take[best.ravel()]
                ok = s[a, b] > -2
                yield pd.DataFrame({"query_id": ids[a[ok]], "doc": doc[b[ok]], "score": s[a[ok], b[ok]]})

    out = vectors.mapInPandas(run, "query_id long, doc long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def hash_embedding(c: Column, dim: int = 384) -> Column:
    """Signed counts of a text's runs of one to three characters in ``dim`` buckets (BLAKE2b), of length 1.

    Every run is hashed once a batch; a text's counts are added up at once.
    """

    @pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, int] = {}

        def code(g: str) -> int:
            x = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
            known[g] = y = (x % dim + 1) * (-1 if x >> 63 else 1)
            return y

        def one(t: str | None) -> np.ndarray:
            s = "".join((t or "").lower().split())
            runs = [*s, *map("".join, zip(s, s[1:])), *map("".join, zip(s, s[1:], s[2:]))]
            at = np.fromiter((known.get(g) or code(g) for g in runs), np.int64, len(runs))
            v = np.bincount(np.abs(at) - 1, np.sign(at), dim)
            return (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)

        return texts.map(one)

    return embed(c)


def md5_embedding(c: Column, dim: int = 64) -> Column:
    """The same idea with MD5, in doubles, as SQL can do it (``hash_embedding_md5`` gives its places one by one).

    A run is a number of up to three signs of 21 bits (code points from 1 on); of each thousand texts every distinct one is hashed once.
    """

    @pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        out: list[np.ndarray] = []
        for i in range(0, len(texts), 1_000):
            tidy = ["".join((t or "").lower().split()) for t in texts.iloc[i : i + 1_000]]
            size = np.array([len(t) for t in tidy])
            code = np.frombuffer("".join(tidy).encode("utf-32-le"), np.uint32).astype(np.int64) + 1
            row, left = np.repeat(np.arange(len(tidy)), size), np.repeat(np.cumsum(size), size) - np.arange(len(code))
            two, three = np.flatnonzero(left >= 2), np.flatnonzero(left >= 3)
            runs = np.concatenate([code, code[two] << 21 | code[two + 1], code[three] << 42 | code[three + 1] << 21 | code[three + 2]])
            keys, at = np.unique(runs, return_inverse=True)
            signs = np.stack([keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF], 1).tolist()
            hashed = np.array([int(hashlib.md5("".join(chr(x - 1) for x in run if x).encode()).hexdigest()[:8], 16) for run in signs], np.int64)
            place, sign = (hashed % dim)[at], np.where(hashed >> 31, -1, 1)[at]
            v = np.bincount(np.concatenate([row, row[two], row[three]]) * dim + place, sign, len(tidy) * dim).reshape(-1, dim)
            norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
            out += list(v / np.where(norm > 0, norm, 1.0))
        return pd.Series(out)

    return embed(c)


def remote_embedding(client: Callable[[list[str]], list[list[float]]], dim: int, batch: int = 64) -> Callable[[Column], Column]:
    """An embedder for ``build_index`` and ``hybrid_topk`` behind a client that is passed in; a wrong number or length of vectors is an error."""

    @pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(texts), batch):
            part = [t or "" for t in texts.iloc[i : i + batch]]
            got = client(part)
            if len(got) != len(part) or any(len(v) != dim for v in got):
                raise ValueError(f"{len(part)} texts gave {len(got)} vectors, wanted of {dim} numbers each")
            out += [np.asarray(v, np.float32) for v in got]
        return pd.Series(out)

    return embed


def hash_embedding_md5(docs: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """``doc, bucket, value``: the same idea with MD5, all inside SQL; buckets of value 0 are left out."""
    t = X.squash(F.lower(F.col(text_col)))
    g = docs.select(F.col(id_col).alias("doc"), F.explode(F.concat(X.grams(t, 1), X.grams(t, 2), X.grams(t, 3))).alias("g"))
    h = F.conv(F.substring(F.md5("g"), 1, 8), 16, 10).cast("long")
    sums = g.groupBy("doc", (h % dim).alias("bucket")).agg(F.sum(F.when(F.shiftright(h, 31) == 1, -1).otherwise(1)).alias("s")).where("s <> 0")
    norm = F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy("doc")))
    return sums.select("doc", "bucket", F.round(F.col("s") / norm, 6).alias("value"))


def title_matches(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """``query_id, title``: the titles that a query contains, or whose long key its own key contains.

    ``titles`` has ``title``. Titles and queries meet by the first characters of the title (three) or key (six) among the query's
    runs of that length; what meets is then confirmed.
    """
    q = queries.select("query_id", "query", X.title_key(X.normalize_query(F.col("query"))).alias("qk")).where("query is not null")
    q = q.withColumn("run", F.explode(F.array_distinct(F.concat(X.grams(F.col("query"), 3), X.grams(F.col("qk"), 6)))))
    t = titles.select("title").where("title is not null").distinct().withColumn("tk", X.title_key(F.col("title")))
    t = t.withColumn("run", F.explode(F.array_compact(F.array(F.when(F.length("title") >= 3, F.substring("title", 1, 3)), F.when((F.length("title") >= 3) & (F.length("tk") >= 6), F.substring("tk", 1, 6))))))
    inside = F.contains(F.col("query"), F.col("title")) | ((F.length("tk") >= 6) & F.contains(F.col("qk"), F.col("tk")))
    return q.join(t, "run").where(inside).select("query_id", "title").distinct()


def longest_titles(matches: DataFrame) -> DataFrame:
    """Without the titles that another title of the same query contains."""
    other = matches.select("query_id", F.col("title").alias("other"))
    within = matches.join(other, "query_id").where((F.col("title") != F.col("other")) & F.contains("other", F.col("title"))).select("query_id", "title")
    return matches.join(within.distinct(), ["query_id", "title"], "left_anti")


def matched_titles(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """``query_id, title``: the titles that a query means, the longest only."""
    return longest_titles(title_matches(queries, titles))


def article_scope(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """``query_id, title, article``: the queries that name one article of one law."""
    named = longest_titles(cut(title_matches(queries, titles))).groupBy("query_id").agg(F.min("title").alias("title"), F.count("*").alias("c")).where("c = 1").drop("c")
    return queries.select("query_id", X.article_hint(F.col("query")).alias("article")).where("article is not null").join(named, "query_id")


def exact_article(scope: DataFrame, chunks: DataFrame) -> DataFrame:
    """The provisions that a scope (``query_id, title, article``) names, with all scores 1, by law and order."""
    own = chunks.withColumn("canonical", F.coalesce(X.canonical_label(F.col("article_label")), X.squash(F.col("article_label"))))
    return own.join(scope, (own.law_title == scope.title) & (own.canonical == scope.article)).select("query_id", *chunks.columns, F.lit(1.0).alias("hybrid_score"), F.lit("exact_article").alias("retrieval_mode"))


def section_search(scope: DataFrame, chunks: DataFrame) -> DataFrame:
    """All provisions under the heading that a scope (``query_id, title, heading_term``) names, deleted ones apart; no top-k."""
    hit = (chunks.law_title == scope.title) & F.contains(chunks.heading, scope.heading_term)
    return chunks.join(scope, hit).where(~X.is_deleted(F.col("article_label"), F.col("content"))).select("query_id", *chunks.columns, F.lit("structural_section").alias("retrieval_mode"))


def _sparse(v: Column) -> Column:
    """The places and values of a vector that aren't 0."""
    return F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x"))), lambda p: p["x"] != 0)


def _without_candidates(asked: DataFrame, index: Index, wanted: tuple[DataFrame, list[int], bool], titles: DataFrame, k: int, permille: int) -> DataFrame | None:
    """``query_id, chunk_id``: the best k of all provisions for queries whose terms and titles stand nowhere; None if there are none.

    Nothing of such a query stands in a text, so a provision's words count only by defining something where the query asks for
    definitions; all else is the vectors' product, taken batch by batch with k rows kept a query.
    """
    want, buckets, _ = wanted
    hit = want.join(index.table("terms").where(F.col("bucket").isin(buckets)), ["bucket", "term"]).select("query_id").union(titles.select("query_id")).distinct()
    if asked.select("query_id").join(hit, "query_id", "left_anti").isEmpty():
        return None
    path = shared_path(index.spark, "lost")
    asked.join(hit, "query_id", "left_anti").select("query_id", "qv", (F.col("qs.defines") & F.col("qs.explicit")).alias("defines")).write.parquet(path)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            q = read_rows(path)
            doc = pdf["chunk_id"].to_numpy()
            v = np.array(pdf["cv"].tolist(), dtype=np.float64)
            for i in range(0, len(q), 2_000):
                part = q.slice(i, 2_000)
                vec = np.rint(np.clip(np.array(part.column("qv").to_pylist(), dtype=np.float64) @ v.T, 0, 1) * 1e6).astype(np.int64)
                lex = 550_000 * np.outer(part.column("defines").to_numpy(zero_copy_only=False), pdf["defined"].to_numpy()).astype(np.int64)
                s = (vec * permille + lex * (1_000 - permille) + 500) // 1_000
                order = np.argsort(doc, kind="stable")
                best = order[np.argsort(-s[:, order], axis=1, kind="stable")[:, :k]]
                yield pd.DataFrame({"query_id": np.repeat(part.column("query_id").to_numpy(), best.shape[1]), "chunk_id": doc[best.ravel()], "s": np.take_along_axis(s, best, 1).ravel()})

    found = index.table("docs").select("chunk_id", "cv", (F.size("ps.defined") > 0).alias("defined")).mapInPandas(run, "query_id long, chunk_id long, s long")
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), "chunk_id")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query_id", "chunk_id")


def hybrid_topk(queries: DataFrame, index: Index, k: int, candidates: int = CANDIDATES, weight: float = HASH_WEIGHT, embed: Callable[[Column], Column] | None = None, lexical: str = "bm25", only: DataFrame | None = None) -> DataFrame:
    """The k best provisions of each query by words and vectors together; of equals the smaller id first.

    ``queries`` has ``query_id, query``. Candidates are the best by BM25 and all provisions of the laws that the query means; a query
    without either is scored against all. ``embed`` makes the queries' vectors and must be the index's. ``lexical="trigram"`` scores
    by shared runs of three characters instead of words, without the gain for titles. ``only`` (``query_id, law_title``) keeps a
    query's hits to one law.
    """
    docs, permille = index.table("docs"), round(weight * 1_000)
    by_words = lexical != "trigram"
    q = queries.select("query_id", X.normalize_query(F.col("query")).alias("query")).withColumn("lex", X.expand_query(F.col("query")))
    # What the queries alone give is computed once: a row a query, read by every step below.
    asked = cut(q.withColumns({"qv": (embed or hash_embedding)(F.col("query")), "qs": X.query_side(F.col("lex")), "qt": X.trigrams(F.col("lex"))}))
    titles = matched_titles(asked, index.table("titles"))
    wanted = _wanted(asked.select("query_id", F.col("lex").alias("query")), index)
    top = bm25_topk(asked, index, candidates, wanted).select("query_id", F.col("doc").alias("chunk_id"))
    by_title = docs.select("chunk_id", "law_title").join(titles, docs.law_title == titles.title).select("query_id", "chunk_id")
    pairs = top.withColumn("named", F.lit(False)).unionByName(by_title.withColumn("named", F.lit(True)))
    if (rest := _without_candidates(asked, index, wanted, titles, k, permille)) is not None:
        pairs = pairs.unionByName(rest.withColumn("named", F.lit(False)))
    pairs = pairs.groupBy("query_id", "chunk_id").agg(F.max("named").alias("named"))
    sides = asked.select("query_id", _sparse(F.col("qv")).alias("qv"), "qs", "qt")
    full = pairs.join(docs.hint("merge"), "chunk_id").join(sides, "query_id")  # wide rows: never a broadcast
    if only is not None:
        full = full.join(only.select("query_id", "law_title"), ["query_id", "law_title"], "left_semi")
    # Few of a query's places aren't 0; the vectors have length 1.
    product = F.aggregate("qv", F.lit(0.0), lambda s, p: s + p["x"] * F.get("cv", p["i"]).cast("double"))
    vec = F.greatest(F.lit(0.0), F.least(F.lit(1.0), product))
    if by_words:
        lex = F.least(F.lit(1.0), X.lexical_score(F.col("qs"), F.col("ps")) + F.when(F.col("named"), TITLE_BOOST).otherwise(0.0))
    else:
        lex = F.greatest(*(X.set_similarity(X.trigrams(c), F.col("qt")) for c in (F.col("content"), F.col("law_title"), F.concat("law_title", F.coalesce("article_label", F.lit(""))))))
    # Scores are whole millionths: they weigh and compare the same everywhere.
    scored = full.withColumns({"vm": F.round(vec * 1e6).cast("long"), "lm": F.round(lex * 1e6).cast("long")})
    mixed = F.floor((F.col("vm") * permille + F.col("lm") * (1_000 - permille) + 500) / 1_000) / 1e6
    scored = scored.withColumns({"vector_score": F.col("vm") / 1e6, "lexical_score": F.col("lm") / 1e6, "hybrid_score": mixed}).drop("qv", "cv", "named", "qs", "qt", "ps", "vm", "lm")
    w = Window.partitionBy("query_id").orderBy(F.desc("hybrid_score"), "chunk_id")
    return scored.withColumn("pos", F.row_number().over(w).cast("long")).where(F.col("pos") <= k).withColumn("retrieval_mode", F.lit("hybrid"))


def search(queries: DataFrame, index: Index, k: int = 8, hybrid: Callable[..., DataFrame] = hybrid_topk, **options) -> DataFrame:
    """Routed search: exact provisions where a query names one article of one law (also when there is none), else hybrid.

    ``hybrid`` is ``hybrid_topk``, or ``scan.hybrid_topk`` for very many queries.
    """
    docs = index.table("docs")
    scope = cut(article_scope(queries, index.table("titles")))  # a row a query at most
    cols = ["query_id", "chunk_id", "law_id", "law_title", "version_no", "article_label", "heading", "content", "source_url", "hybrid_score", "retrieval_mode", "pos"]
    w = Window.partitionBy("query_id").orderBy("law_title", "seq", "chunk_id")
    exact = exact_article(scope, docs).withColumn("pos", F.row_number().over(w).cast("long")).where(F.col("pos") <= k)
    rest = queries.join(scope.select("query_id"), "query_id", "left_anti")
    return exact.select(*cols).unionByName(hybrid(rest, index, k, **options).select(*cols))


def evaluate(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: cases, and the shares of them whose law, and law and article, are among the hits.

    ``cases`` has ``query_id, expected_law, expected_article``; the article's share counts cases with an article, and is null if
    there are none.
    """
    norm = lambda c: F.lower(X.squash(F.coalesce(c, F.lit(""))))
    j = cases.join(hits.select("query_id", "law_title", "article_label"), "query_id", "left")
    law = F.contains(norm(F.col("law_title")), norm(F.col("expected_law")))
    art = law & (norm(F.col("article_label")) == norm(F.col("expected_article")))
    per = j.groupBy("query_id").agg(F.max(F.coalesce(law, F.lit(False))).alias("law_hit"), F.max(F.when(norm(F.col("expected_article")) != "", F.coalesce(art, F.lit(False)))).alias("article_hit"))
    return per.agg(F.count("*").alias("cases"), F.round(F.avg(F.col("law_hit").cast("int")), 6).alias("law_hit_rate"), F.round(F.avg(F.col("article_hit").cast("int")), 6).alias("article_hit_rate"))
