"""Sources and sinks: evaluation cases, saved files, snapshots, and the boundary to the network behind a client that is passed in."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = "query string, expected_law string, expected_article string"


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from a JSON array, with ids by order of text."""
    rows = spark.read.schema(CASES).json(path, multiLine=True)
    return rows.select(F.xxhash64("query", "expected_law", "expected_article").alias("query_id"), "*")


def saved_pages(spark: SparkSession, path: str, cap: int = 25_000_000) -> DataFrame:
    """``url, html, size, reason``: saved HTML files; a file beyond ``cap`` bytes isn't read and says so in ``reason``."""
    f = spark.read.format("binaryFile").load(path)
    fits = F.col("length") <= cap
    return f.select(F.col("path").alias("url"), F.when(fits, F.decode("content", "UTF-8")).alias("html"), F.col("length").alias("size"), F.when(~fits, "too large").alias("reason"))


def pdf_pages(content: bytes, cap: int = 200) -> tuple[list[str] | None, str | None]:
    """(the pages' texts, why there are none): of a PDF with at most ``cap`` pages, by the optional library pypdf."""
    import io

    from pypdf import PdfReader

    if not content.startswith(b"%PDF-"):
        return None, "no PDF"
    try:
        reader = PdfReader(io.BytesIO(content))
        if len(reader.pages) > cap:
            return None, "too many pages"
        return [p.extract_text() or "" for p in reader.pages], None
    except Exception as e:  # noqa: BLE001 - a broken file is a row with a reason
        return None, f"unreadable: {type(e).__name__}"


def joined_pages(pages: list[str]) -> str:
    """Pages as one text, with at most one empty line in a row."""
    return re.sub(r"\n{3,}", "\n\n", "\n".join(pages)).strip()


def saved_pdfs(spark: SparkSession, path: str, cap: int = 25_000_000, pages: int = 200, least: int = 20, read: Callable[[bytes, int], tuple[list[str] | None, str | None]] = pdf_pages) -> DataFrame:
    """``path, size, text, pages, reason``: the texts of saved PDF files; every file has a row, those without a text a reason."""
    f = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.when(F.col("length") <= cap, F.col("content")).alias("content"))

    def run(batches):
        for pdf in batches:
            rows = []
            for p, n, c in zip(pdf["path"], pdf["size"], pdf["content"]):
                got, why = (None, "too large") if c is None else read(bytes(c), pages)
                text = joined_pages(got) if got else None
                if got is not None and len(text or "") < least:
                    text, why = None, "no text to be found in it"
                rows.append((p, n, text, None if got is None else len(got), why))
            yield pd.DataFrame(rows, columns=["path", "size", "text", "pages", "reason"]).astype({"pages": "Int32"})

    return f.mapInPandas(run, "path string, size long, text string, pages int, reason string")


class TooLarge(Exception):
    """A download beyond its cap."""


def capped(blocks: Iterable[bytes], cap: int = 25_000_000, declared: int | None = None) -> bytes:
    """A download's bytes, given up as soon as it is declared or seen to be larger than ``cap``."""
    if declared is not None and declared > cap:
        raise TooLarge(f"{declared} bytes")
    out = bytearray()
    for b in blocks:
        out += b
        if len(out) > cap:
            raise TooLarge(f"more than {cap} bytes")
    return bytes(out)


@dataclass(frozen=True)
class Page:
    url: str
    text: str
    content_type: str
    status_code: int
    retry_after: float | None = None


class Blocked(Exception):
    """The site refuses further requests (403 or 429), or for ``retry_after`` seconds."""

    def __init__(self, text: str, retry_after: float | None = None):
        super().__init__(text)
        self.retry_after = retry_after


def decoded(body: bytes, content_type: str = "") -> str:
    """A page's text: in the charset that its content type or its own head names, else UTF-8, else Big5, else what can be read."""
    named = re.search(r"charset=[\"']?([\w-]+)", content_type, re.I) or re.search(rb"charset=[\"']?([\w-]+)", body[:2_048], re.I)
    first = named[1] if named and isinstance(named[1], str) else named[1].decode() if named else None
    for charset in (first, "utf-8", "cp950"):
        try:
            return body.decode(charset) if charset else body.decode("utf-8")
        except (LookupError, UnicodeDecodeError):
            continue
    return body.decode("utf-8", "replace")


def one_page(get: Callable[[str], Page], url: str, cap: int = 1_000_000) -> Page:
    """One page by one request of a client that follows nothing: a refusal, a redirect, no HTML or too large a page is an error."""
    page = get(url)
    if page.status_code in (403, 429):
        raise Blocked(f"{page.status_code}: {url}", page.retry_after)
    if 300 <= page.status_code < 400:
        raise ValueError(f"redirected: {url}")
    if page.status_code != 200:
        raise ValueError(f"{page.status_code}: {url}")
    if not re.match(r"(?:text/html|application/xhtml\+xml)\b", page.content_type, re.I):
        raise ValueError(f"no HTML but {page.content_type}: {url}")
    if len(page.text.encode()) > cap:
        raise TooLarge(url)
    return page


def fetch_with_retry(get: Callable[[str], Page], url: str, attempts: int = 3, delay: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Page:
    """One page through a client that is passed in: waits before each request, tries again after timeouts only, stops when refused."""
    for n in range(1, attempts + 1):
        sleep(delay)
        try:
            page = get(url)
        except (TimeoutError, ConnectionError):
            if n == attempts:
                raise
            sleep(min(5.0, 0.7 * 2 ** (n - 1)))
            continue
        if page.status_code in (403, 429):
            raise Blocked(f"{page.status_code}: {url}", page.retry_after)
        return page
    raise AssertionError


def prefer(pages: DataFrame, order: tuple[str, ...] = ("print", "detail")) -> DataFrame:
    """One page a law: of its representations (``source_key, kind, status_code, text``) the first in order that was fetched well."""
    from pyspark.sql.window import Window

    rank = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    w = Window.partitionBy("source_key").orderBy(rank, "url")
    good = pages.where("status_code = 200 and text is not null")
    return good.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def _states(spark: SparkSession, root: str) -> list[tuple[int, str, bool, list[str]]]:
    """(number, folder, whether it is whole, its tables) of all committed states, in order; a state without its content yet doesn't count."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/_states")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    out = []
    for f in fs.listStatus(at):
        stream = fs.open(f.getPath())
        try:
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if text.endswith("\n"):
            kind, names, stamp = text.strip().split(" ", 2)
            out.append((int(f.getPath().getName()), stamp, kind == "whole", names.split(",")))
    return sorted(out)


def _commit(spark: SparkSession, root: str, stamp: str, whole: bool, names: Iterable[str]) -> int:
    """Makes a written folder the newest state: a numbered file that only one writer can make. A second writer of a number fails."""
    jvm = spark.sparkContext._jvm
    n = max((s[0] for s in _states(spark, root)), default=0) + 1
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/_states/{n:012d}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(at, False)
    try:
        out.write(f"{'whole' if whole else 'more'} {','.join(names)} {stamp}\n".encode())
    finally:
        out.close()
    return n


def write_snapshot(tables: dict[str, DataFrame], root: str, stamp: str) -> str:
    """All tables of one state under ``root/stamp``; the state counts from the moment its number is written, so readers see all of it or none.

    No earlier state is touched: a crash at any point leaves the one before it current.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{root}/{stamp}/{name}")
    _commit(spark, root, stamp, True, tables)
    return f"{root}/{stamp}"


def append_snapshot(tables: dict[str, DataFrame], root: str, stamp: str) -> str:
    """Rows that are added to the tables of the current state: only these are written."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{root}/{stamp}/{name}")
    _commit(spark, root, stamp, False, tables)
    return f"{root}/{stamp}"


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the current state, with ``state``: the last whole state and what was added since, by number."""
    states = _states(spark, root)
    since = max((i for i, s in enumerate(states) if s[2]), default=None)
    if since is None:
        raise FileNotFoundError(f"no state under {root}")
    parts = [spark.read.parquet(f"{root}/{stamp}/{name}").withColumn("state", F.lit(n)) for n, stamp, _, names in states[since:] if name in names]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_laws(spark: SparkSession, root: str) -> DataFrame:
    """The laws of the current state: of several rows of a key the last added."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("source_key").orderBy(F.desc("state"))
    return read_snapshot(spark, root, "laws").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "state")
