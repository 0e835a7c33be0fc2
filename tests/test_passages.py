import re
import tracemalloc
from itertools import pairwise

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.lexicon import STOP_WORDS
from tessera.functions.text import stem_word
from tessera.functions.vectors import fnv1a
from tessera.operators import embedding, replies
from tessera.operators import passages as P


def test_sentences():
    text = 'Dr. Smith paid 3.5 of it, e.g. Fig. 2 shows. J. Roe left! "Why?" He asked... No answer came.'
    assert [s for s, _ in P.sentences(text)] == ["Dr. Smith paid 3.5 of it, e.g. Fig. 2 shows.", "J. Roe left!", '"Why?"', "He asked...", "No answer came."]
    assert all(text[at:].startswith(s) for s, at in P.sentences(text))
    assert P.sentences("") == [] and P.sentences("no stop") == [("no stop", 0)]


MD = """# Title
Intro *text* with a [link](http://a.b) here.
second line

## Part
- one thing
2) two things
> quoted words
| a | b |
|---|---|
| 1 | 2 |
```
code line one
```
After."""


def test_blocks():
    got = [(b.kind, b.text, b.heading_path) for b in P.markdown_blocks(MD)]
    assert got == [
        ("heading", "Title", "Title"),
        ("paragraph", "Intro text with a link (http://a.b) here. second line", "Title"),
        ("heading", "Part", "Title › Part"),
        ("list_item", "one thing", "Title › Part"),
        ("list_item", "two things", "Title › Part"),
        ("quote", "quoted words", "Title › Part"),
        ("table", "a | b\n1 | 2", "Title › Part"),
        ("code", "code line one", "Title › Part"),
        ("paragraph", "After.", "Title › Part"),
    ]


def test_chunks_respect_limits_and_overlap():
    text = "# H\n" + " ".join(f"This is sentence number {i} of a long paragraph with words." for i in range(120))
    c = P.Chunking(maximum=100, overlap=20)
    out = P.chunk(P.paginate(text), c)
    assert len(out) > 10 and all(p.heading == "H" and p.text.startswith("H\n") for p in out)
    assert all(P.estimate(p.text) <= 104 for p in out)
    bodies = [p.text[2:] for p in out]
    assert all(b.split(". ")[0].rstrip(".") in a for a, b in zip(bodies, bodies[1:], strict=False))
    pages = P.chunk(P.paginate("## Page 1\n" + "Words of the first page go here now. " * 3 + "\n## Page 2\nOther words stand on the second page, as said."), P.Chunking(overlap=0))
    assert [p.page for p in pages] == [1, 2]
    short = P.chunk(P.paginate("One whole sentence that is long enough to be kept here.\n\n```\n" + "x = 1\n" * 8 + "```\n\nTiny."), P.Chunking(maximum=100))
    assert short[-1].text.endswith("Tiny.") and len(short) == 1


def test_dataframes(spark, sf):
    docs = spark.createDataFrame([(1, MD), (2, None), (3, "")], "doc_id long, text string")
    assert P.with_blocks(docs).count() == 9 and P.with_sentences(docs).where("doc_id <> 1").count() == 0
    made = P.with_passages(spark.read.parquet(f"{sf}/documents.parquet"))
    assert made.select("doc_id").distinct().count() == 200 or made.count() > 200


def test_passages_of_texts_without_units(spark):
    """a text that is null, empty or holds no block gives no passage and doesn't end the query."""
    texts = [None, "", " \n ", "x", "- y", "| a |", "# Title", "## Page 3", "## Page 1\n\n## Page 2\nz", "One sentence stands here."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [(r.doc_id, r.ordinal, r.text) for r in P.with_passages(docs).collect()] == [(9, 0, "One sentence stands here.")]


def test_passages_under_page_numbers_of_any_length(spark):
    """the largest page number is kept; a larger one, which no long holds, is a heading."""
    most, over, zeros = str(2**63 - 1), str(2**63), "0" * 5000 + "7"
    texts = [f"## Page {n}\nOne sentence stands here." for n in (most, over, "9" * 5000, zeros)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = P.with_passages(docs).orderBy("doc_id").collect()
    assert [(r.page, r.heading) for r in made] == [(2**63 - 1, None), (None, f"Page {over}"), (None, "Page " + "9" * 5000), (7, None)]
    mixed = P.chunk(P.paginate(f"Lead that is a sentence.\n## Page 4\nOn page four.\n## Page {over}\nStill on it.\n## Page 5\nOn five."), P.Chunking(overlap=0, min_tokens=0))
    assert [(p.page, p.heading) for p in mixed] == [(0, ""), (4, ""), (4, f"Page {over}"), (5, f"Page {over}")]


def test_passages_of_bytes_that_are_not_utf8(spark):
    """such bytes are replaced, the rest of the text stays."""
    docs = spark.sql("SELECT 1L AS doc_id, cast(X'4F6E65FF20776F72642E20' AS string) AS text")
    assert [r.text for r in P.with_passages(docs).collect()] == ["One\ufffd word."]


def test_embedder():
    v = embedding.embed(["The inspectors inspect inspections", "inspection", "", "...", "museum funding"])
    assert v.shape == (5, 384) and np.allclose(np.linalg.norm(v, axis=1), [1, 1, 0, 0, 1])
    assert v[0] @ v[1] > v[0] @ v[4]


def test_flashcards_and_quiz():
    cards = replies.flashcards("**Q:** What is it?\n- A: A thing [Source 2]\nthat goes on.\nQ: none\n\nQuestion: two?\nAnswer: yes")
    assert [(c.front, c.back, c.marker) for c in cards] == [("What is it?", "A thing [Source 2] that goes on.", "[Source 2]"), ("two?", "yes", None)]
    items = replies.quiz("1. Which one is right?\nA. first\nB) second\nAnswer: B\nWhy: as said [Source 1]\n2. And the next one is?\nA. x\nB. y\nC. z\nAnswer: 3\n3. Broken question here?\nA. only one\nAnswer: A")
    assert [(i.question, i.choices, i.answer, i.marker) for i in items] == [("Which one is right?", ["first", "second"], 1, "[Source 1]"), ("And the next one is?", ["x", "y", "z"], 2, None)]


def test_choices():
    assert replies.choices("3 | a primary source\n5 | …\n27 | no\n3 | again", 20, 4) == [(3, "a primary source"), (5, "…")]
    assert replies.choices("none of them", 5, 3) == [] and replies.choices("hm", 5, 3) is None and replies.choices("2", 5, 3) == [(2, None)]


def test_reply_columns(spark):
    df = spark.createDataFrame([("1: 7\n2: 12\nx\n[3]: 0.5",), ("1: 7",), ("",)], "r string")
    assert [r[0] for r in df.select(replies.rerank_scores(df.r, 4)).collect()] == [[0.7, 1.0, 0.05, 0.0], None, None]
    brave = '{"web":{"results":[{"title":"T","url":"http://a","description":"d"},{"title":"no"},{"title":"U","url":"http://b"}]}}'
    rows = spark.createDataFrame([(brave,)], "p string").select(replies.search_results(F.col("p"), "brave").alias("x")).first().x
    assert [(r.title, r.url, round(r.score, 2)) for r in rows] == [("T", "http://a", 1.0), ("U", "http://b", 0.94)]


def test_sums_of_features_hold_no_vector_for_each_word():
    """F7, F8: memory goes with the words and their features, not with 384 numbers for each distinct word."""
    texts = [" ".join(f"w{i}x{j}q" for j in range(1500)) for i in range(80)]
    tracemalloc.start()
    made = embedding.sums(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.shape == (80, 384) and peak < 150e6


def test_sums_are_those_of_single_hashes():
    texts = ["", "the a", "Ünïcode ΣΑΣ straßen 東京タワー日本語 abcd the inspections", "x yy yy yyy", "policies"]
    for text, row in zip(texts, embedding.sums(texts), strict=True):
        want = np.zeros(384, np.int64)
        kept = [s for w in re.findall(r"[^\W_]+", text.lower()) if w not in STOP_WORDS and len(s := stem_word(w)) >= 2]
        names = [(f"w:{s}", 100) for s in kept] + [(f"c:{s[i : i + 4]}", 28) for s in kept for i in range(len(s) - 3)] + [(f"b:{a}_{b}", 65) for a, b in pairwise(kept)]
        for name, weight in names:
            h = fnv1a(name)
            want[h % 384] += -weight if h >> 63 else weight
        assert (np.rint(row) == want).all()
