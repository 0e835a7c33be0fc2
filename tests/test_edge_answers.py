"""Inputs that once gave wrong answers."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import answers, listings, replies
from tessera.sources import archive, html


class Said(answers.Provider):
    def __init__(self, *replies_):
        self.replies, self.seen = list(replies_), []

    def stream(self, system, user):
        self.seen.append(user)
        yield self.replies.pop(0)


class Results(answers.SearchProvider):
    def __init__(self, *rows):
        self.rows = rows

    def search(self, query, limit):
        return [dict(zip(("title", "url", "snippet"), r, strict=False)) for r in self.rows]


def found(spark, said, *rows):
    return [(r.url, r.reason) for r in answers.discover(Said("a query", said), Results(*rows), "topic", spark).orderBy("position").collect()]


def test_picks_are_places_in_the_list_shown(spark):
    rows = [("none", ""), ("B", "https://b.example/one", "about b"), ("C", "https://c.example/two")]
    assert found(spark, "2 | why", *rows) == [("https://c.example/two", "why")] and found(spark, "1 | x\n3 | invented", *rows) == [("https://b.example/one", "x")]
    same = [("A", "https://a.example/x"), ("A again", "http://www.a.example/x/"), ("B", "https://b.example/y")]
    assert found(spark, "2 | kept\n2 | again", *same) == [("https://b.example/y", "kept")]
    assert found(spark, "NONE", *same) == []
    p = Said("q", "1 | ok")
    answers.discover(p, Results(*rows), "the decline", spark).collect()
    assert "the decline" in p.seen[-1] and "about b" in p.seen[-1] and "1. B" in p.seen[-1] and "none" not in p.seen[-1].split("\n\n")[1]


def test_no_results_are_reported_not_raised(spark):
    assert answers.discover(Said("q", "1 | x"), Results(), "nothing", spark).collect() == []


def test_long_reasons_are_cut_at_a_space():
    (_, reason), = replies.choices("1 | " + "word " * 60, 3, 3)
    assert len(reason) <= 141 and reason.endswith("word…")
    assert replies.choices("1 - short", 3, 3) == [(1, "short")]


def test_unread_pages_leave_a_notice_and_their_snippet(spark):
    results = spark.createDataFrame([(1, "http://a", "sa", None), (2, "http://b", "sb", None), (5, "http://c", "sc", None)], "position int, url string, snippet string, content string")
    pages = spark.createDataFrame([("http://a", "long " * 90, None), ("http://b", None, "status 500")], "url string, text string, problem string")
    got = {r.position: r.content for r in answers.enrich(results, pages).collect()}
    assert got[1].startswith("long long") and got[2] == "sb" and got[5] is None
    assert "status 500" in answers.enrich_notice(results, pages)
    assert answers.enrich_notice(results.where("position = 1"), pages) is None and "not fetched" in answers.enrich_notice(results, pages.where("url = 'http://a'"))


def test_numbers_of_any_length_sort_by_value(spark):
    titles = ["x 1000000000000000000000009", "x 1000000000000000000000001", "x 007", "x 7", "X 10", "x 0", "x 00", "y 1", "x"]
    df = spark.createDataFrame(list(enumerate(titles)), "doc_id long, title string")
    assert [titles[r.doc_id] for r in listings.sort_sources(df, "title").collect()] == ["x", "x 0", "x 00", "x 007", "x 7", "X 10", "x 1000000000000000000000001", "x 1000000000000000000000009", "y 1"]


def test_notes_of_one_long_title_are_files_of_their_own(spark):
    notes = spark.createDataFrame([(f"id{i}", "T" * 100, f"body {i}") for i in range(3)] + [("n/x", None, "b")], "id string, title string, body string")
    names = [n for r in archive.export({"notes": notes}, "L").collect() for n in zipfile.ZipFile(io.BytesIO(r.content)).namelist() if n.endswith(".md")]
    assert len(set(names)) == len(names) == 4 and all(len(n) <= len("notes/.md") + 80 for n in names)


def test_foreign_archives_are_refused_with_a_reason():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("something-else.txt", "not ours")
    with pytest.raises(ValueError, match="manifest.json"):
        archive.inspect(out.getvalue())
    with pytest.raises(ValueError, match="could not be read"):
        archive.inspect(b"A" * 5000)
    with pytest.raises(ValueError, match="could not be read"):
        archive.inspect(out.getvalue()[: len(out.getvalue()) // 2])


def test_archives_are_unzipped_once_with_a_staging_folder(spark, tmp_path):
    tables = {"sources": spark.createDataFrame([("s1", "T")], "id string, title string"), "notes": spark.createDataFrame([("n1", "a", "b")], "id string, title string, body string"), "chunks": spark.createDataFrame([], "id string, source_id string, text string")}
    back = archive.load(archive.export(tables, "L"), staging=str(tmp_path / "lines"))
    assert {n: list(map(tuple, df.collect())) for n, df in back.items()} == {n: list(map(tuple, df.collect())) for n, df in tables.items()}
    assert "MapInArrow" not in back["notes"]._jdf.queryExecution().toString()


PROSE = "<p>" + "Words of prose, as they go. " * 9 + "</p>"


def test_one_page_does_not_end_the_job(spark, monkeypatch):
    pages = spark.createDataFrame([(1, f"<body><![foo[ x ]]>{PROSE}</body>"), (2, f"<body>{PROSE}</body>"), (3, "<![ y")], "page_id long, html string")
    got = {r.page_id: (r.problem, len(r.blocks)) for r in html.with_pages(pages).collect()}
    assert got == {1: (None, 1), 2: (None, 1), 3: ("too little text", 0)}
    monkeypatch.setattr(html, "extract", lambda h: 1 / 0)
    assert html.extract_or_say("x").problem == "unreadable page: ZeroDivisionError"


def test_tails_go_by_runs():
    block = lambda t, kind="paragraph": html.Block(kind, t, 0, "")
    prose = [block("A sentence that is long enough to be no furniture at all, whatever stands near it, as it goes on and on. " + str(i)) for i in range(6)]
    tail = [block("tiny"), block("tiny too"), block("All rights reserved")]
    assert html.trim_tail(prose + tail) == prose + tail[:1] and html.trim_tail(tail) == tail and html.trim_tail([]) == []
    assert html.trim_tail(prose + tail[:1]) == prose + tail[:1]
