import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import labels, records
from tessera.functions.dates import parse_date
from tessera.operators import answers, ingest, listings, passages
from tessera.operators.retrieval import NoSources, Settings, keyword_scores
from tessera.operators.store import Store, touch, upsert
from tessera.sources import archive, html, models
from tessera.streaming.incremental import ingest_stream


def test_dates(spark):
    rows = ["2024-03-05T09:00:00Z", "2024-03-05T09:00:00.123+01:00", "Tue, 05 Mar 2024 09:00:00 +0000", "March 5, 2024", "Mar 5, 2024", "5 March 2024", "2024/03/05", "20240305", "2024-03-05 is the day", "3 days ago", "soon", "", None]
    now = F.lit("2024-03-08 00:00:00").cast("timestamp")
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r[0] for r in df.select(F.unix_seconds(parse_date(F.col("t"), now))).collect()]
    day = 1709596800
    assert got == [1709629200, 1709625600, 1709629200, *[day] * 6, day, None, None, None]


def test_labels(spark):
    df = spark.createDataFrame([("qwen3:8b", 429), ("gpt-oss:120b", 200), ("nomic-embed", 500), ("tiny-1.5B", 404)], "name string, status int")
    size = labels.parameter_size(F.col("name"))
    got = df.select(size, labels.context_window(size), labels.is_embedding_model(F.col("name")), labels.failure_of(F.col("status")), labels.budget_for(labels.context_window(size))["tokens"]).collect()
    assert [tuple(r) for r in got] == [("8B", 32768, False, "rate limited", 10000), ("120B", 131072, False, None, 24000), (None, 8192, True, "unavailable", 4000), ("1.5B", 8192, False, "rejected", 4000)]
    body = spark.createDataFrame([('{"error":{"message":"m"}}',), ('{"error":"e"}',), ("plain",)], "b string")
    assert [r[0] for r in body.select(labels.failure_message(F.col("b"))).collect()] == ["m", "e", "plain"]
    n = spark.createDataFrame([(1,), (1500,), (2_500_000,)], "n long")
    assert [tuple(r) for r in n.select(labels.byte_size(F.col("n")), labels.plural(F.col("n"), "word")).collect()] == [("1 bytes", "1 word"), ("1.5 kB", "1,500 words"), ("2.5 MB", "2,500,000 words")]
    f = spark.createDataFrame([(True, True, 0, False), (False, True, 2, True), (False, False, 0, False)], "s boolean, l boolean, c int, t boolean")
    assert [len(r[0]) for r in f.select(labels.follow_ups(F.col("s"), F.col("l"), F.col("c"), F.col("t"))).collect()] == [2, 3, 1]


TEXT = "# Topic\n" + " ".join(f"Sentence {i} speaks of the permits and how they were delayed in the office." for i in range(60))


def test_ingest_and_reingest(spark, tmp_path):
    store = Store(spark, str(tmp_path / "lib"))
    texts = spark.createDataFrame([("a", TEXT), ("b", "short"), ("c", None)], "title string, text string")
    first = {r.status: r.sources for r in ingest.store_batch(store, ingest.from_texts(texts)).collect()}
    assert first == {"ready": 1, "failed": 2}
    n = store.read("chunks").count()
    assert n > 1 and store.read("chunks").where("size(vector) = 384").count() == n
    ingest.store_batch(store, ingest.from_texts(texts), passages.Chunking(maximum=120))
    assert store.read("chunks").count() > n and store.read("sources").count() == 3
    assert store.vacuum() >= 1 and store.read("chunks").count() > n
    again = Store(spark, str(tmp_path / "lib"))
    assert again.read("sources").count() == 3
    # The stored index answers as the passages do.
    found = {r.chunk_id: round(r.keyword, 9) for r in ingest.index_of(again).scores(["permits", "office"]).collect()}
    chunks = again.read("chunks").withColumnRenamed("id", "chunk_id")
    assert found == {r.chunk_id: round(r.keyword, 9) for r in keyword_scores(chunks, ["permits", "office"]).collect()} and found
    sizes = {r.id: r.words for r in again.read("sources").collect()}
    ingest.reindex(again, chunking=passages.Chunking(maximum=120))
    assert {r.id: r.words for r in again.read("sources").collect()} == sizes and ingest.index_of(again).scores(["permits"]).count() == again.read("chunks").count()
    ingest.delete_sources(again, again.read("sources").where("title = 'a'").select(F.col("id").alias("source_id")))
    assert again.read("chunks").count() == 0 and again.read("sources").count() == 2 and ingest.index_of(again).scores(["permits"]).count() == 0
    number, manifest = again._manifest()
    again._commit(number + 1, manifest | {"schema_version": 99})
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "lib"))
    t = touch(spark.createDataFrame([(1, "x", "y"), (2, "x", "y")], "id long, updated_at string, last_opened_at string"), 1, F.lit("now"), True)
    assert sorted(t.collect()) == [(1, "now", "now"), (2, "x", "y")]


def test_a_change_is_whole_or_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "lib"), buckets=8)
    rows = lambda *x: spark.createDataFrame(list(x), "id string, v long")
    store.write("a", rows(*[(f"k{i}", i) for i in range(40)]), "id")
    store.write("b", rows(("x", 1)))
    with pytest.raises(RuntimeError), store.change() as c:
        c.upsert("a", rows(("k1", -1)))
        c.write("b", rows(("y", 2)))
        raise RuntimeError("the driver is lost between tables")
    assert store.read("a").where("v < 0").count() == 0 and store.read("b").first().id == "x"
    # A manifest that was cut short is passed over, and its number isn't taken again by accident.
    number, manifest = store._manifest()
    fs, where = store._fs(f"_manifests/{number + 1:012d}.json")
    out = fs.create(where, False)
    out.write(bytearray(b'{"schema'))
    out.close()
    assert store._manifest()[0] == number and store.read("a").count() == 40
    with pytest.raises(Exception, match="exist"):
        store._commit(number, manifest)


def test_a_small_change_rewrites_its_buckets_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "lib"), buckets=16)
    rows = lambda *x: spark.createDataFrame(list(x), "id string, v long")
    store.write("a", rows(*[(f"k{i}", i) for i in range(200)]), "id")
    before = store._manifest()[1]["tables"]["a"]["folders"]
    store.upsert("a", rows(("k7", -7), ("k7", -9), ("new", 0)), latest="v")
    after = store._manifest()[1]["tables"]["a"]["folders"]
    assert sum(before[b] != after[b] for b in before) <= 2 and len(before) == 16
    got = {r.id: r.v for r in store.read("a").collect()}
    assert len(got) == 201 == store.read("a").count() and got["k7"] == -7 and got["new"] == 0
    with store.change() as c:
        c.replace("a", rows(), rows(("k3", 0)), "id", "id")
    assert store.read("a").count() == 200 and store.vacuum() >= 2 and store.read("a").count() == 200
    one = upsert(rows(("a", 1), ("b", 2)), rows(("a", 5), ("a", 3), (None, 1), ("c", 4)))
    assert sorted(one.collect()) == [("a", 5), ("b", 2), ("c", 4)]


def test_pages_are_taken_once(spark):
    page = "<html><title>T</title><body><p>" + "Words of prose, as they go. " * 9 + "</p></body></html>"
    pages = spark.createDataFrame([(1, "http://www.a.example/x/", page), (2, "https://a.example/x?utm_source=f", page), (3, "https://a.example/y", "")], "page_id long, url string, html string")
    read = html.with_pages(pages).join(pages.select("page_id", "url"), "page_id")
    rows = ingest.from_pages(read).collect()
    assert len(rows) == 2 and sum(r.error is None for r in rows) == 1


class Canned(answers.Provider):
    def __init__(self, text, fail=False):
        self.text, self.fail, self.seen = text, fail, ""

    def stream(self, system, user):
        self.seen = user
        yield self.text
        if self.fail:
            raise ConnectionError("gone")


def test_answer(spark):
    chunks = spark.createDataFrame([("c1", "s1", "The permits were delayed by the reorganisation of the office.", "Permits", 20), ("c2", "s2", "Museum funding rose in the spring of that year.", None, 20)], "chunk_id string, source_id string, text string, heading string, token_count long")
    titles = spark.createDataFrame([("s1", "Report", "page 3"), ("s2", "News", None)], "source_id string, title string, location string")
    p = Canned("They were delayed [source 1], see [Source 7].", fail=True)
    out = answers.answer(p, "Why were permits delayed?", chunks, titles, settings=Settings(floor=0.0))
    assert (out.text, out.cited, out.invented, out.passages) == ("They were delayed [source 1], see.", ["[Source 1]"], ["[Source 7]"], 1)
    assert "[Source 1] Report — page 3\nSection: Permits\n" in p.seen and "Museum" not in p.seen
    cards = answers.study(Canned("Q: one?\nA: two [Source 1]"), "flashcards", chunks, titles, focus="permits delayed")
    assert [(c.front, c.marker) for c in cards] == [("one?", "[Source 1]")]
    with pytest.raises(ConnectionError):
        answers.answer(Canned("", fail=True), "permits", chunks, titles)


def test_answer_with_web_scope_and_model(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"s{i}", f"Permits number {i} were delayed by the office.", None, 20) for i in range(6)], "chunk_id string, source_id string, text string, heading string, token_count long")
    titles = spark.createDataFrame([(f"s{i}", f"Report {i}", None) for i in range(6)], "source_id string, title string, location string")
    web = spark.createDataFrame([(1, "W", "http://w", "Web words of permits.")], "position int, title string, url string, content string")
    p = Canned("1: 2\n2: 9\n3: 1")
    some = spark.createDataFrame([("s1",), ("s2",), ("s4",)], "source_id string")
    out = answers.answer(p, "Why were permits delayed?", chunks, titles, settings=Settings(floor=0.0), eligible=some, web=web, model_rerank=True, history="User: hm")
    assert out.passages == 3 and not out.notices and "[Web 1] W — http://w" in p.seen and "CONVERSATION SO FAR" in p.seen
    assert p.seen.index("Report 2") < p.seen.index("Report 1") < p.seen.index("Report 4")
    broken = answers.answer(Canned("hm"), "Why were permits delayed?", chunks, titles, settings=Settings(floor=0.0), model_rerank=True, vectors=chunks, query_vector=lambda q: 1 / 0)
    assert len(broken.notices) == 2 and broken.passages == 6
    with pytest.raises(NoSources):
        answers.answer(p, "permits", chunks, titles, eligible=some.where("false"))
    seen = []

    class Counting(Canned):
        def stream(self, system, user):
            seen.append(user.count("[Source "))
            return super().stream(system, user)

    many = spark.createDataFrame([(f"c{i}-{j}", f"s{i}", f"Report words {i} {j} go here and there.", None, 20) for i in range(10) for j in range(8)], "chunk_id string, source_id string, text string, heading string, token_count long")
    names = spark.createDataFrame([(f"s{i}", f"Report {i}", None) for i in range(10)], "source_id string, title string, location string")
    answers.study(Counting("x"), "comparison", many, names, Settings(results=60))
    assert answers.tool_settings("comparison", Settings(results=60), 10).per_source == 6 and seen[0] <= 60


class Found(answers.SearchProvider):
    def search(self, query, limit):
        self.query = query
        return [{"title": "T", "url": "http://a.example/tag/x"}, {"title": "U", "url": "https://www.a.example/story?utm_source=q"}, {"title": "V", "url": "https://a.example/story"}, {"title": "none", "url": ""}]


def test_discovery_and_dispatch(spark):
    f = Found()
    assert [(r.position, r.reason) for r in answers.discover(Canned("2 | a report"), f, "permits", spark).collect()] == [(2, "a report")] and f.query == "2 | a report"
    assert [r.position for r in answers.discover(None, f, "permits", spark).collect()] == [1, 2]
    assert answers.suggested_query(Canned("I cannot help with that"), "q") == "q" and answers.suggested_query(Canned("a\nb"), "q") == "q"
    blocks = "array<struct<kind:string,text:string,level:int>>"
    results = spark.createDataFrame([(1, "T", "http://a/x", "s"), (2, "U", "https://a/x", "s"), (3, "V", "ftp://b", "s"), (4, "W", "https://c", "s")], "position int, title string, url string, snippet string")
    pages = spark.createDataFrame([("http://a/x", None, [("paragraph", "words", 0)])], f"url string, problem string, blocks {blocks}")
    got = sorted((r.url, r.text, r.error) for r in ingest.from_results(results, pages, 5).collect())
    assert got == [("http://a/x", "words", None), ("https://c", None, "not fetched")]
    texts = spark.createDataFrame([("a", TEXT), ("a", TEXT), ("b", "no")], "title string, text string")
    page = spark.createDataFrame([("https://d", "D", None, [("heading", "H", 2), ("paragraph", "words", 0)])], f"url string, title string, problem string, blocks {blocks}")
    files = spark.createDataFrame([("/x/n.txt", "text", None, [("paragraph", "file words", 0)]), ("/x/e.pdf", "pdf", "no reader", [])], f"path string, kind string, error string, blocks {blocks}")
    every = {(r.kind, r.title): r.error for r in ingest.dispatch(page, files, texts).collect()}
    assert every == {("website", "D"): None, ("text", "n.txt"): None, ("pdf", "e.pdf"): "no reader", ("text", "a"): None, ("text", "b"): "too short"}
    stored = spark.createDataFrame([("s1", "https://a/x"), ("s2", "http://b/y/")], "id string, url string")
    found = spark.createDataFrame([("http://q/z", "http://a/x"), ("https://b/y", None), ("https://b/y", "https://new"), ("https://n", None)], "url string, canonical string")
    assert sorted((r.url, r.canonical or "", r.known_id or "") for r in ingest.known_source(found, stored).collect()) == [("http://q/z", "http://a/x", "s1"), ("https://b/y", "", "s2"), ("https://b/y", "https://new", "s2"), ("https://n", "", "")]
    old = spark.createDataFrame([("chunk_target_tokens", "320"), ("theme", "a")], "name string, value string")
    assert not ingest.needs_reindex(old, old.replace({"a": "b"})) and ingest.needs_reindex(old, old.replace({"320": "200"}))


def test_payloads(spark):
    r = models.Request("m", (("system", "more"), ("user", "hi")), "rules", 0.5, 100, ("END",))
    assert models.payload("local", r)["options"] == {"temperature": 0.5, "num_predict": 100, "stop": ["END"]} and models.payload("local", r)["messages"][0] == {"role": "system", "content": "rules"}
    assert models.payload("completions", r, True)["stream_options"] == {"include_usage": True} and models.payload("completions", r)["max_tokens"] == 100
    m = models.payload("messages", r)
    assert m["system"] == "rules\n\nmore" and m["messages"] == [{"role": "user", "content": "hi"}] and m["stop_sequences"] == ["END"]
    with pytest.raises(ValueError):
        models.payload("local", models.Request("m", ()))
    df = spark.createDataFrame([('{"message":{"content":"a"},"eval_count":3,"prompt_eval_count":2}', '{"choices":[{"message":{"content":"b"}}],"usage":{"completion_tokens":1}}', '{"content":[{"type":"text","text":"c"},{"type":"x"},{"type":"text","text":"d"}]}')], "l string, c string, m string")
    row = df.select(models.reply_text(F.col("l"), "local"), models.reply_text(F.col("c"), "completions"), models.reply_text(F.col("m"), "messages"), models.usage(F.col("l"), "local")).first()
    assert tuple(row)[:3] == ("a", "b", "cd") and tuple(row[3]) == (2, 3)


def test_listings(spark):
    rows = spark.createDataFrame([(1, "Part 10", 5, 2, 3), (2, "Part 9", 7, 1, 1), (3, "part 9", 7, 9, 2)], "doc_id long, title string, bytes long, chunk_count long, added_at long")
    order = lambda by: [r.doc_id for r in listings.sort_sources(rows, by).collect()]
    assert (order("title"), order("size"), order("passages"), order("added")) == ([2, 3, 1], [2, 3, 1], [3, 1, 2], [1, 3, 2])
    books = spark.createDataFrame([(1, "A", None, True, None, 5), (2, "b", "About a", False, True, 6), (3, "c", None, None, False, 7)], "id long, title string, summary string, is_archived boolean, is_favorite boolean, updated_at long")
    assert [r.id for r in listings.notebooks(books).collect()] == [3, 2] and [r.id for r in listings.notebooks(books, True).collect()] == [3, 2, 1]
    assert {r.id: r.section for r in listings.notebook_sections(books, "A").collect()} == {1: "notebooks", 2: "favourites"}
    notes = spark.createDataFrame([(1, "quiz", "T", "body", False, 3), (2, "summary", "x", "Tea", True, 1), (3, "quiz", "y", "z", False, 9)], "id long, kind string, title string, body string, is_pinned boolean, updated_at long")
    assert [r.id for r in listings.pinned_first(notes).collect()] == [2, 3, 1] and [r.id for r in listings.filter_notes(notes, "quiz", "t").collect()] == [1]
    src = spark.createDataFrame([("a", True, "ready"), ("b", False, "ready"), ("c", None, "ready"), ("d", True, "failed")], "source_id string, included boolean, status string")
    ids = lambda df: sorted(r.source_id for r in df.collect())
    assert ids(listings.eligible(src)) == ["a", "c", "d"] and ids(listings.eligible(src, ["d", "b"])) == ["d"] and ids(listings.eligible(src, [])) == [] and ids(listings.usable(src)) == ["a", "c"] and ids(listings.eligible(src, src.where("status = 'ready'"))) == ["a", "c"]
    said = spark.createDataFrame([(1, 1, "user", "q1", False), (1, 2, "assistant", "a1", False), (1, 3, "user", "q2", False), (1, 4, "assistant", "oops", True)], "conv_id long, turn long, role string, text string, is_error boolean")
    assert tuple(listings.last_said(said).first()) == (1, "q2", "a1")
    who = spark.createDataFrame([("b", False), ("z", True), ("A", False)], "display_name string, is_local boolean")
    assert [r.display_name for r in listings.providers(who).collect()] == ["z", "A", "b"]


def test_records(spark):
    rows = spark.createDataFrame([("1", None, "", "odd", None), ("2", "T", "u", "ready", False)], "id string, title string, url string, status string, included boolean")
    got = sorted(map(tuple, records.with_defaults(rows, "sources").collect()))
    assert got == [("1", "Untitled source", None, "queued", True), ("2", "T", "u", "ready", False)]
    assert records.lookup(rows, "2").title == "T" and records.lookup(rows, "9") is None
    assert records.scalar(rows, F.count("*")) == 2 and records.scalar(rows.where("false"), F.sum(F.length("id"))) == 0
    one = spark.createDataFrame([(["a"], "b", "pdf", "too short", "odd", "webOnly", " x \n\n \n\ny  \n")], "l array<string>, n string, k string, f string, g string, s string, t string")
    c = F.col
    r = one.select(records.approve(c("l"), c("n")), records.approve(c("l"), F.lit("a")), records.revoke(c("l"), F.lit("a")), records.is_approved(c("l"), c("n"), F.lit(True)), records.mime_type(c("k")), records.mime_type(c("n")), records.failure_text(c("f"))["recovery"], records.failure_text(c("g"))["message"], records.uses_sources(c("s")), records.uses_web(c("s")), records.collapse_blank(c("t"))).first()
    assert tuple(r) == (["a", "b"], ["a"], [], False, "application/pdf", None, "Paste more of it.", "odd", False, True, "x\n\ny")


def test_archives_in_parts(spark, tmp_path):
    tables = {
        "sources": spark.createDataFrame([("s1", "T"), ("s2", "U")], "id string, title string"), "chunks": spark.createDataFrame([(f"c{i}", "s1", f"text {i}\u2028more") for i in range(50)] + [("lost", "gone", "x")], "id string, source_id string, text string"),
        "notes": spark.createDataFrame([("n1", "A/b", "body")], "id string, title string, body string"), "messages": spark.createDataFrame([], "id string, session_id string, text string"),
    }
    made = archive.export(tables, "Library", part_bytes=500).collect()
    assert len(made) > 3 and sum(archive.inspect(bytes(r.content))["counts"]["chunks"] for r in made) == 51
    for r in made:
        (tmp_path / f"{r.part}.zip").write_bytes(r.content)
    back = archive.load(archive.read_archives(spark, str(tmp_path)))
    assert {n: sorted(map(tuple, df.collect())) for n, df in back.items()} == {n: sorted(map(tuple, df.collect())) for n, df in tables.items()}
    new = archive.remap(back, "x")
    assert new["chunks"].count() == 50 and new["chunks"].join(new["sources"].withColumnRenamed("id", "source_id"), "source_id").count() == 50
    import io
    import zipfile

    assert any("notes/A-b-n1.md" in zipfile.ZipFile(io.BytesIO(r.content)).namelist() for r in made)


def test_tools_and_picks(spark):
    s = answers.tool_settings("summary", Settings(), 3)
    assert (s.results, s.per_source, s.floor) == (16, 10, 0.0) and answers.tool_settings("comparison", Settings(), 2).per_source == 7
    results = spark.createDataFrame([(1, "http://a/search", "s", None), (2, "http://a/story", "s", None), (3, "http://a/x?q=1", "s", None)], "position int, url string, snippet string, content string")
    assert [r.position for r in answers.pick_results(results, None, 2).collect()] == [2, 1]
    assert {r.position: r.reason for r in answers.pick_results(results, [(3, "why")], 2).collect()} == {3: "why"}
    pages = spark.createDataFrame([("http://a/story", "word " * 100), ("http://a/search", "short")], "url string, text string")
    got = {r.position: r.content for r in answers.enrich(results, pages).collect()}
    assert got[1] == got[3] == "s" and len(got[2]) > 200


def test_lines_cut_anywhere():
    raw = b'data: {"t":"a"}\n\ndata: {"t":"\xc3\xa9"}\ndata: [DONE]\n{"t":"z"}'
    for n in (1, 3, 7, 100):
        pieces = [raw[i : i + n] for i in range(0, len(raw), n)]
        assert list(answers.reply_of_lines(iter(pieces), lambda x: json.loads(x)["t"])) == ["a", "é", "z"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"title": "a", "text": TEXT}) + "\n")
    store = Store(spark, str(tmp_path / "lib"))
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps({"title": name, "text": TEXT + name}) + "\n")
        stream = spark.readStream.schema("title string, text string").json(str(tmp_path / "in"))
        ingest_stream(stream, store, str(tmp_path / "cp"), vectors=False).awaitTermination()
    assert store.read("sources").count() == 2
