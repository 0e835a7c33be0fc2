import json

from pyspark.sql import functions as F

from tessera.functions import render
from tessera.sources import search

PAGE = """<div class="result"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example%2Fx&amp;rut=1">First &amp; <b>best</b></a>
<a class="result__snippet" href="x">What it <b>says</b>.</a><a class="result__url">a.example</a></div>
<a class="result__a" href="https://b.example/">Second</a><a class="result__a" href="https://a.example/x">Again</a>"""


def test_page_results():
    got = [(r.title, r.url, r.snippet, round(r.score, 2), r.site) for r in search.page_results(PAGE, 5)]
    assert got == [("First & best", "https://a.example/x", "What it says.", 1.0, "a.example"), ("Second", "https://b.example/", "", 0.94, "b.example")]
    assert len(search.page_results(PAGE, 1)) == 1 and search.page_results("", 3) == []


def test_instant_answers():
    data = {
        "Heading": "H", "AbstractText": "An abstract", "AbstractURL": "https://w.example/H",
        "Results": [{"Text": "Official site", "FirstURL": "https://o.example"}],
        "RelatedTopics": [{"Text": "One - detail", "FirstURL": "https://1.example"}, {"Name": "G", "Topics": [{"Text": "In group", "FirstURL": "https://g.example"}, {"Text": "self", "FirstURL": "https://duckduckgo.com/c/x"}]}, {"Text": "Two", "FirstURL": "https://2.example"}, {"Text": "no link"}],
    }
    got = [(r.title, r.url, round(r.score, 2)) for r in search.instant_answers(json.dumps(data), "q", 9)]
    assert got == [("H", "https://w.example/H", 1.0), ("Official site", "https://o.example", 0.95), ("One", "https://1.example", 0.8), ("In group", "https://g.example", 0.75), ("Two", "https://2.example", 0.78)]


def test_listings_and_text(spark):
    df = spark.createDataFrame([('{"models":[{"name":"b"},{"name":"a"},{}]}', '{"data":[{"id":"z"},{"id":"y"}]}')], "t string, d string")
    r = df.select(search.model_names(F.col("t"), "tags").alias("t"), search.model_names(F.col("d"), "data").alias("d")).first()
    assert (r.t, r.d) == (["a", "b"], ["y", "z"])
    blocks = spark.createDataFrame([([("heading", "T", 2), ("paragraph", "words", 0), ("list_item", "i", 0), ("paragraph", " ", 0), ("code", "c", 0)],)], "b array<struct<kind:string,text:string,level:int>>")
    assert blocks.select(render.document_text(F.col("b"))).first()[0] == "\n## T\n\n\nwords\n\n- i\n```\nc\n```"
    names = spark.createDataFrame([('a/b: "c"', "q", ["[Source 1] R"]), (" ", "q", [])], "n string, q string, c array<string>")
    got = names.select(render.file_name(F.col("n")), render.note_of_answer(F.col("q"), F.lit("A."), F.col("c")), render.front_matter({"title": F.col("q"), "url": F.lit(None)})).collect()
    assert [tuple(x) for x in got] == [("a-b- -c-", "# q\n\nA.\n\n## Sources\n\n- [Source 1] R", "---\ntitle: q\n---\n"), ("untitled", "# q\n\nA.", "---\ntitle: q\n---\n")]
    p = spark.createDataFrame([(3, "u"), (None, "u"), (None, "")], "p int, u string")
    assert [x[0] for x in p.select(render.location(F.col("p"), F.col("u"), F.lit("pdf"))).collect()] == ["page 3", "u", "pdf"]
