import io
import zipfile

from pyspark.sql import functions as F

from tessera.sources import files, html, robots

PAGE = """<html lang="en"><head><title>A long headline here — My Site</title><meta property="og:site_name" content="My Site">
<meta name="author" content="A. Writer"><link rel="canonical" href="http://c.example/x"><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/b">B</a></li></ul></nav>
<article><h1>A long headline here</h1><p>First paragraph with enough words &amp; some marks, to be read as prose. It goes on.</p>
<h2>Part two</h2><p>Second paragraph, which is also long enough to stay in the text of this page.</p>
<ul><li>An item of a list</li></ul><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>
<blockquote>Quoted words.</blockquote><pre>code = 1 + 1</pre><div class="share">Share this</div></article>
<footer>All rights reserved</footer></body></html>"""


def test_extract():
    p = html.extract(PAGE)
    assert (p.meta["title"], p.meta["author"], p.meta["site_name"], p.meta["canonical"], p.meta["language"]) == ("A long headline here", "A. Writer", "My Site", "http://c.example/x", "en")
    kinds = [(b.kind, b.heading_path) for b in p.blocks]
    assert ("table", "A long headline here › Part two") in kinds and ("quote", "A long headline here › Part two") in kinds
    text = "\n".join(b.text for b in p.blocks)
    assert "words & some marks" in text and "Home" not in text and "rights" not in text and "no" not in text.split() and "Share" not in text


def test_broken_pages():
    for bad in ("", "<p", "<div><p>a</div></p></p>", "<a href='x>y", "text only", "<b>" * 5000):
        html.extract(bad)
    assert html.extract("<p>x</p>").problem and not html.extract("<div><p>" + "Words of prose, as they go. " * 9).problem


def test_pages_query(spark, sf):
    rows = html.with_pages(spark.read.parquet(f"{sf}/pages.parquet"))
    assert rows.where("problem is null").count() > 0.9 * rows.count()
    assert rows.where(F.exists("blocks", lambda b: b["text"].contains("track("))).count() == 0


def test_robots(spark):
    text = "User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\n\nUser-agent: other\nDisallow: /\n"
    rules = spark.createDataFrame([("o", r, a, robots.pattern(r)) for r, a in robots.parse(text)], "origin string, rule string, allow boolean, regex string")
    paths = ["/", "", "/private/x", "/private/open/1", "/a.pdf", "/a.pdf?x", "/b"]
    got = {r.id: r.allowed for r in robots.decide(spark.createDataFrame(list(enumerate(paths)), "id long, path string").withColumn("origin", F.lit("o")), rules).collect()}
    assert [got[i] for i in range(7)] == [True, True, False, True, False, True, True]


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), content)
    return out.getvalue()


def test_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda t, style="": f'<w:p><w:pPr>{style}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    doc = f'<w:document {w}><w:body>{para("Top", "<w:pStyle w:val=&quot;Heading1&quot;/>".replace("&quot;", chr(34)))}<w:tbl><w:tr><w:tc>{para("c1")}</w:tc><w:tc>{para("c2")}</w:tc></w:tr></w:tbl>{para("Body text")}{para("Item", "<w:numPr/>")}</w:body></w:document>'
    made = {
        "a.docx": zipped(word__document_DOT_xml=doc),
        "b.rtf": rb"{\rtf1{\fonttbl{\f0 Arial;}}Caf\'e9 \u8364? line\par Second}",
        "sub/c.md": b"# H\nwords",
        "d.epub": zipped(o__p_DOT_opf='<package xmlns="x"><manifest><item id="2" href="b.xhtml"/><item id="1" href="a.xhtml"/></manifest><spine><itemref idref="2"/><itemref idref="1"/></spine></package>', o__a_DOT_xhtml="<p>second</p>", o__b_DOT_xhtml="<p>first</p>"),
        "e.pdf": b"%PDF-1.4",
        "f.docx": b"broken",
        "g.txt": b"",
        "noname": b"{\\rtf1 plain}",
        ".hidden.txt": b"no",
        "h.xyz": b"no",
    }
    for name, raw in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read(files.scan(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.docx", "b.rtf", "c.md", "d.epub", "e.pdf", "f.docx", "noname"}  # Spark lists no empty files
    assert [(b.kind, b.text, b.heading_path) for b in got["a.docx"].blocks] == [("heading", "Top", "Top"), ("paragraph", "Body text", "Top"), ("list_item", "Item", "Top"), ("table", "c1 | c2", "Top")]
    assert [b.text for b in got["b.rtf"].blocks] == ["Café € line", "Second"]
    assert [(b.page, b.text) for b in got["d.epub"].blocks] == [(1, "first"), (2, "second")]
    assert [got[n].error for n in ("e.pdf", "f.docx")] == ["no reader for pdf", "unreadable: BadZipFile"]
    assert got["noname"].kind == "rtf" and got["c.md"].blocks[0].kind == "heading"
    assert files.read(files.scan(spark, str(tmp_path)), {"pdf": lambda raw: [(1, [])]}).where("path like '%e.pdf'").first().error is None
