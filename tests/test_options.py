import pytest

from lexspark.options import Options
from lexspark.sources import readers


def test_options():
    assert Options().top_k == 8 and Options.from_env(env={"LEXSPARK_TOP_K": " 5 ", "LEXSPARK_WEB_GATE": "0.5", "LEXSPARK_ATTEMPTS": ""}) == Options(top_k=5, web_gate=0.5)
    for bad, error in (({"top_k": 0}, ValueError), ({"top_k": True}, TypeError), ({"vector_weight": 1.5}, ValueError), ({"attempts": 2.0}, TypeError)):
        with pytest.raises(error):
            Options(**bad)
    with pytest.raises(ValueError):
        Options.from_env(env={"LEXSPARK_TOP_K": "many"})


def test_one_page_and_its_charset():
    page = lambda status=200, kind="text/html; charset=utf-8", text="x", after=None: lambda u: readers.Page(u, text, kind, status, after)
    assert readers.one_page(page(), "u").text == "x"
    with pytest.raises(readers.Blocked) as e:
        readers.one_page(page(429, after=30.0), "u")
    assert e.value.retry_after == 30.0
    for bad in (page(302), page(500), page(kind="application/pdf")):
        with pytest.raises(ValueError):
            readers.one_page(bad, "u")
    with pytest.raises(readers.TooLarge):
        readers.one_page(page(text="x" * 11), "u", cap=10)
    assert readers.decoded("中文".encode("cp950"), "text/html; charset=big5") == readers.decoded("中文".encode("cp950")) == readers.decoded("中文".encode()) == "中文"
    assert readers.decoded(b'<meta charset="utf-8">' + "中".encode(), "text/html") == '<meta charset="utf-8">中' and readers.decoded(b"\xff\xff\xff", "x; charset=nope")
