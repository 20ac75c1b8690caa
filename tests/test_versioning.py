import datetime as dt

from pyspark.sql import functions as F

from lexspark.operators import versioning as V
from lexspark.sources import readers
from lexspark.streaming.ingest import upsert_stream

AT = dt.datetime(2024, 1, 1)
LAW = "law_id long, source_key string, title string, category string, source_url string, created_at timestamp_ntz, updated_at timestamp_ntz"
VER = "version_id long, law_id long, version_no int, content_hash string, raw_text string, metadata_json string, is_current boolean, fetched_at timestamp_ntz"
INC = "source_key string, title string, source_url string, content_hash string, raw_text string, metadata_json string, fetched_at timestamp_ntz"


def state(spark, versions):
    laws = spark.createDataFrame([(1, "k1", "甲", None, "u", AT, None), (2, "k2", "乙", "消防署函釋", "u", AT, None)], LAW)
    return laws, spark.createDataFrame([(i, law, n, h, "t", m, False, AT) for i, law, n, h, m in versions], VER)


def inc(spark, *rows):
    return spark.createDataFrame([(k, "新", "u2", h, "t", '{"parser_revision": 3}', AT) for k, h in rows], INC)


def status(spark, versions, *rows):
    return {r.source_key: (r.status, r.version_no) for r in V.upsert_status(inc(spark, *rows), *state(spark, versions)).collect()}


def test_status(spark):
    v = [(1, 1, 1, "a", '{"parser_revision": 3}'), (2, 1, 2, "b", '{"parser_revision": 3}'), (3, 2, 1, "c", '{"parser_revision": true}')]
    assert status(spark, v, ("k1", "b"), ("k2", "c"), ("k3", "x")) == {"k1": ("unchanged", 2), "k2": ("reprocess_required", 1), "k3": ("inserted", 1)}
    assert status(spark, v, ("k1", "a")) == {"k1": ("inserted", 3)}  # a text that came back is a new version


def test_apply(spark):
    laws, versions = state(spark, [(1, 1, 1, "a", None), (2, 1, 2, "b", None)])
    l2, v2 = V.apply_upsert(inc(spark, ("k1", "a"), ("k3", "x")), laws, versions)
    assert sorted(r.title for r in l2.collect()) == ["乙", "新", "新"] and l2.count() == 3
    flags = [(r.version_no, r.is_current) for r in v2.where("law_id = 1").orderBy("version_no").collect()]
    assert flags == [(1, False), (2, False), (3, True)] and v2.where("is_current").count() == 2


def test_reprocess(spark):
    laws, versions = state(spark, [(1, 1, 1, "a", '{"parser_revision": 2, "x": "y"}'), (2, 2, 1, "c", None)])
    assert [(r.law_id, r.stored_revision) for r in V.reprocess(versions, laws).collect()] == [(1, 2)]
    new = V.reprocess(versions, laws, apply=True).first()
    assert new.version_no == 1 and '"parser_revision":"3"' in new.metadata_json and '"x":"y"' in new.metadata_json


def test_cascade_and_report(spark):
    laws, versions = state(spark, [(1, 1, 1, "a", None), (2, 2, 1, "c", None)])
    chunks = spark.createDataFrame([(1, 1), (2, 2)], "chunk_id long, version_id long")
    out = V.delete_laws(laws.where("law_id = 1"), laws, versions, chunks)
    assert [x.count() for x in out] == [1, 1, 1]
    r = {x.category: (x.total, x.inserted, x.error) for x in V.crawl_report(spark.createDataFrame([("A", "inserted"), ("A", "error"), ("B", "inserted")], "category string, status string")).collect()}
    assert r == {"A": (2, 1, 1), "B": (1, 1, 0), None: (3, 2, 1)}


def test_conversations(spark):
    conv = spark.createDataFrame([(1, "甲", AT), (2, "乙", AT + dt.timedelta(days=1))], "conversation_id long, title string, created_at timestamp_ntz")
    msg = spark.createDataFrame([(1, 1, "user", "q", None, AT + dt.timedelta(days=3))], "message_id long, conversation_id long, role string, content string, response_json string, created_at timestamp_ntz")
    assert [r.conversation_id for r in V.last_activity(conv, msg).collect()] == [1, 2]
    ex = spark.createDataFrame([(1, "問", "答", None, AT)], "conversation_id long, query string, answer string, response_json string, at timestamp_ntz")
    assert [(r.message_id, r.role) for r in V.append_exchange(msg, ex).orderBy("message_id").collect()] == [(1, "user"), (2, "user"), (3, "assistant")]
    t = spark.createDataFrame([("字" * 50,), ("  a \n b ",), ("",)], "q string").select(V.conversation_title(F.col("q")).alias("t")).collect()
    assert [r.t for r in t] == ["字" * 37 + "…", "a b", "新對話"]
    p = spark.createDataFrame([(20,), (21,), (0,), (None,)], "v int").select(V.preference(F.col("v")).alias("p")).collect()
    assert [r.p for r in p] == [20, 8, 8, 8]


def test_stream_is_idempotent(spark, tmp_path):
    laws, versions = state(spark, [(1, 1, 1, "a", None)])
    root, src = str(tmp_path / "state"), str(tmp_path / "in")
    readers.write_snapshot({"laws": laws, "law_versions": versions}, root, "start")
    inc(spark, ("k1", "b"), ("k9", "z")).write.parquet(src)
    for n in range(2):
        q = upsert_stream(spark.readStream.schema(INC).parquet(src), root, str(tmp_path / f"ckpt{n}"))
        q.awaitTermination(120)
        assert q.exception() is None
    assert len(readers._states(spark, root)) == 2  # the second run added nothing
    assert spark.read.parquet(f"{root}/{readers._states(spark, root)[1][1]}/law_versions").count() == 2  # only what is new is written
    v = V.derive_current(readers.read_snapshot(spark, root, "law_versions"))
    assert {r.source_key: r.title for r in readers.read_laws(spark, root).collect()}["k9"] == "新"
    chunks = readers.read_snapshot(spark, root, "law_chunks")
    assert chunks.join(v.where("is_current"), "version_id", "left_semi").count() == 2
    assert sorted((r.version_no, r.content_hash, r.is_current) for r in v.collect()) == [(1, "a", False), (1, "z", True), (2, "b", True)]


def test_fetching():
    calls = []

    def get(url):
        calls.append(url)
        if len(calls) < 3:
            raise TimeoutError
        return readers.Page(url, "x", "text/html", 200)

    assert readers.fetch_with_retry(get, "u", sleep=lambda s: None).text == "x" and len(calls) == 3
    import pytest

    with pytest.raises(readers.Blocked):
        readers.fetch_with_retry(lambda u: readers.Page(u, "", "", 403), "u", sleep=lambda s: None)


def test_a_crash_leaves_the_state_before(spark, tmp_path, monkeypatch):
    import pytest

    root = str(tmp_path / "s")
    one = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(FileNotFoundError):
        readers.read_snapshot(spark, root, "t")
    readers.write_snapshot({"t": one}, root, "a")

    def crash(*a):
        raise KeyboardInterrupt

    commit = readers._commit
    monkeypatch.setattr(readers, "_commit", crash)
    with pytest.raises(KeyboardInterrupt):
        readers.write_snapshot({"t": one.union(one)}, root, "b")
    assert readers.read_snapshot(spark, root, "t").count() == 1
    monkeypatch.setattr(readers, "_commit", commit)
    readers.append_snapshot({"t": one}, root, "c")
    assert readers.read_snapshot(spark, root, "t").count() == 2
    readers.write_snapshot({"t": one}, root, "d")
    assert readers.read_snapshot(spark, root, "t").count() == 1
    # two writers of one number: the second fails
    monkeypatch.setattr(readers, "_states", lambda *a: [(2, "c", True, ["t"])])
    with pytest.raises(Exception, match="exist"):
        readers.append_snapshot({"t": one}, root, "e")
    # a number whose content isn't there yet doesn't count
    monkeypatch.undo()
    (tmp_path / "s" / "_states" / "000000000009").write_text("whole half")
    assert readers.read_snapshot(spark, root, "t").count() == 1


def test_early_unchanged(spark):
    meta = '{"parser_revision": 3, "attachments": {"parsed": 1}}'
    laws = spark.createDataFrame([(i, f"k{i}", "甲", None, "u", AT, None) for i in range(1, 6)], LAW)
    v = [(1, 1, 2, "h", "本文", meta), (2, 2, 1, "h", "本文\n\n附件：a.pdf\n附", meta), (3, 3, 1, "h", "本文", '{"parser_revision": 3}'), (4, 4, 1, "h", "本文", meta.replace("3", "2")), (5, 5, 1, "h", "本文又", meta)]
    versions = spark.createDataFrame([(i, law, n, h, t, m, False, AT) for i, law, n, h, t, m in v], VER)
    body = spark.createDataFrame([(f"k{i}", "本文") for i in range(1, 7)], "source_key string, body string")
    assert {r.source_key: (r.status, r.version_no) for r in V.unchanged_early(body, laws, versions).collect()} == {"k1": ("unchanged", 2), "k2": ("unchanged", 1), "k4": ("reprocess_required", 1)}
    assert [(r.version_no, r.is_current) for r in V.version_list(versions, laws.where("law_id = 1")).collect()] == [(2, True)]


def test_chunks_and_vectors_of_new_versions(spark):
    laws, versions = state(spark, [])
    rows = inc(spark, ("k1", "x")).withColumn("raw_text", F.lit("第1條 甲\n第2條 乙\n\n附件：a.pdf\n第一頁"))
    changed, added = V.upsert_rows(rows, laws, versions)
    assert [r.title for r in changed.collect()] == ["新"]
    c = V.version_chunks(added, lambda t: F.array(F.length(t).cast("float")), changed).orderBy("seq").collect()
    assert [(r.article_label, r.heading, len(r.embedding)) for r in c] == [("第1條", None, 1), ("第2條", None, 1), ("附件1", "附件：a.pdf", 1)] and len({r.chunk_id for r in c}) == 3


def test_preferences_and_conversations(spark):
    import pytest

    t = V.empty_tables(spark)
    p = V.save_preference(V.save_preference(t["preferences"], "n", 5), "n", 7)
    assert [tuple(r) for r in p.collect()] == [("n", 7)]
    for bad, error in ((True, TypeError), (0, ValueError), (21, ValueError), ("8", TypeError)):
        with pytest.raises(error):
            V.save_preference(p, "n", bad)
    conv = spark.createDataFrame([(1, "甲", AT), (2, "乙", AT)], V.SCHEMAS["conversations"])
    msg = spark.createDataFrame([(1, 1, "user", "q", None, AT)], V.SCHEMAS["messages"])
    assert {r.conversation_id: r.title for r in V.rename_conversation(conv, 2, "  丙  丁 ").collect()} == {1: "甲", 2: "丙 丁"}
    with pytest.raises(ValueError):
        V.rename_conversation(conv, 2, "  ")
    assert [x.count() for x in V.delete_conversations(conv.where("conversation_id = 1"), conv, msg)] == [1, 0]


def test_files_have_rows_and_reasons(spark, tmp_path):
    import pytest

    for name, content in (("a.pdf", b"%PDF-" + b"x" * 30), ("b.pdf", b"nothing"), ("c.pdf", b"%PDF-" + b"x" * 500), ("d.pdf", b"%PDF-scan")):
        (tmp_path / name).write_bytes(content)

    def read(c, cap):
        return (None, "no PDF") if not c.startswith(b"%PDF-") else ([""], None) if c.endswith(b"scan") else (["甲" * 20, "", "", "", "乙"], None)

    r = {x.path[-5:]: x for x in readers.saved_pdfs(spark, str(tmp_path), cap=100, read=read).collect()}
    assert r["a.pdf"].text == "甲" * 20 + "\n\n乙" and {k: x.reason for k, x in r.items()} == {"a.pdf": None, "b.pdf": "no PDF", "c.pdf": "too large", "d.pdf": "no text to be found in it"}
    h = {x.url[-5:]: x.reason for x in readers.saved_pages(spark, str(tmp_path), cap=100).collect()}
    assert h["c.pdf"] == "too large" and h["a.pdf"] is None
    assert readers.capped([b"ab", b"c"], 3) == b"abc"
    for args in (([b"ab", b"cd"], 3), ([b""], 3, 4)):
        with pytest.raises(readers.TooLarge):
            readers.capped(*args)
