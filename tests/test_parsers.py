"""The parsers' queries on whole tables, against plain versions written another way."""

import hashlib
import re

import numpy as np
import pytest

from tessera.functions import lexicon as L
from tessera.functions.text import stem_word
from tessera.functions.vectors import fnv1a
from tessera.operators import passages as P
from tessera.plans import registry
from tessera.sources import html


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def plain_sentences(text):
    """A character at a time."""
    out, start, i = [], 0, 0
    while i < len(text):
        c = text[i]
        if c in ".!?。！？":
            j = i
            while j + 1 < len(text) and text[j + 1] in ".!?。！？":
                j += 1
            ends = True
            if text[j] == ".":
                number = j > 0 and text[j - 1].isnumeric() and j + 1 < len(text) and text[j + 1].isnumeric()
                k = j
                while k > 0 and (text[k - 1].isalnum() or text[k - 1] == "."):
                    k -= 1
                word = text[k:j].lstrip(".").replace(".", "")
                ends = not number and word.lower() not in L.ABBREVIATIONS and not (len(word) == 1 and word.isupper())
            k = j + 1
            while k < len(text) and text[k] in "\"'”’)]】」":
                k += 1
            if ends and (k == len(text) or text[k].isspace()):
                out.append(text[start:k].strip())
                start = k
            i = max(j + 1, k if ends else j + 1)
        else:
            i += 1
    out.append(text[start:].strip())
    return [s for s in out if s]


def test_sentences_by_character(spark, sf, texts):
    got = {r.doc_id: (r.n_sentences, r.longest) for r in registry.queries()["sentences"](spark, sf).collect()}
    want = {i: plain_sentences(t) for i, t in texts.items()}
    assert got == {i: (len(s), max(map(len, s))) for i, s in want.items() if s}


def plain_passages(text, c):
    """Straight from the rules, for a text of paragraphs without headings, tables or page marks."""
    made, open_, lent = [], "", []
    for block in P.markdown_blocks(text):
        for s in plain_sentences(block.text):
            if open_ and P.estimate(open_ + " " + s) > c.maximum:
                made, lent = made + [open_], []
                if len(open_) < c.min_chars:
                    made.pop()
                else:
                    used = 0
                    for x in reversed(plain_sentences(open_)):
                        used += P.estimate(x)
                        if lent and used > c.overlap:
                            break
                        lent.insert(0, x)
                open_ = ""
            open_ = " ".join([*lent, s]) if not open_ else open_ + " " + s
            lent = [] if open_ else lent
    made += [open_] if open_ else []
    out = []
    for m in made:
        if out and P.estimate(m) < c.min_tokens and P.estimate(out[-1]) + P.estimate(m) <= c.maximum:
            out[-1] += "\n" + m
        else:
            out.append(m)
    return out


def test_chunks_of_whole_documents(spark, sf, texts):
    got = {}
    for r in registry.queries()["chunks"](spark, sf).collect():
        got.setdefault(r.doc_id, {})[r.ordinal] = (r.token_count, r.text_sha256)
    prose = {i: t for i, t in texts.items() if all(b.kind in ("paragraph", "list_item", "quote") for b in P.markdown_blocks(t)) and not re.search(r"(?m)^##\s*Page", t)}
    assert len(prose) > 0.8 * len(texts)
    for i, t in prose.items():
        want = plain_passages(t, P.Chunking())
        assert [got.get(i, {})[n] for n in range(len(want))] == [(P.estimate(w), hashlib.sha256(w.encode()).hexdigest()) for w in want], i
        assert len(got.get(i, {})) == len(want)


def test_blocks_keep_every_word(spark, sf, texts):
    """Blocks lose marks and one-character lines, but no word."""
    got = {r.doc_id: r.n_blocks for r in registry.queries()["markdown_blocks"](spark, sf).collect()}
    for i, t in texts.items():
        blocks = P.markdown_blocks(t)
        assert got.get(i, 0) == len(blocks)
        words = lambda x: [w for w in re.findall(r"[^\W_]+", x) if len(w) > 2]
        if "```" not in t and "|" not in t:
            assert words(" ".join(b.text for b in blocks)) == words(re.sub(r"(?m)^\s*(?:[-*+•] |\d{1,3}[.)])", "", t)), i


def plain_vector(text):
    v, kept = np.zeros(384), []
    for w in re.findall(r"[^\W_]+", text.lower()):
        s = "" if w in L.STOP_WORDS else stem_word(w)
        if len(s) >= 2:
            kept.append(s)
    features = [("w:" + s, 1.0) for s in kept] + [("c:" + s[i : i + 4], 0.28) for s in kept for i in range(len(s) - 3)] + [(f"b:{a}_{b}", 0.65) for a, b in zip(kept, kept[1:], strict=False)]
    for name, weight in features:
        h = fnv1a(name)
        v[h % 384] += -weight if h >> 63 else weight
    return v / n if (n := np.linalg.norm(v)) else v


def test_vectors_by_feature(spark, sf, texts):
    from tessera.operators import embedding

    short = {i: t for i, t in texts.items() if len(t) < 3000}
    for (i, t), v in zip(short.items(), embedding.embed(list(short.values())), strict=True):
        assert np.abs(v - plain_vector(t)).max() < 1e-5, i
    got = {r.doc_id: (r.dims, r.square) for r in registry.queries()["builtin_embedding"](spark, sf).collect()}
    assert set(got) == set(texts) and all(d == 384 and (s == 0 or abs(s - 1) < 1e-3) for d, s in got.values())


def test_pages_of_the_table(spark, sf):
    """Every page's blocks hold text of the page, in order; titles and addresses stand in the page."""
    raw = {r.page_id: r.html or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    meta = {r.page_id: r for r in registry.queries()["html_metadata"](spark, sf).collect()}
    made = {r.page_id: r for r in registry.queries()["html_extract"](spark, sf).collect()}
    assert set(meta) == set(made) == set(raw)
    for i, page in raw.items():
        blocks = html.extract(page).blocks
        flat = html.clean(re.sub(r"\s+", " ", html_text(page)))
        squeezed = re.sub(r"\s+", "", flat)
        for b in blocks:
            if b.kind != "table":
                assert re.sub(r"\s+", "", b.text) in squeezed, (i, b.text[:80])
        assert made[i].n_blocks == len(blocks) and made[i].text_md5 == hashlib.md5("\n".join(b.text for b in blocks).encode()).hexdigest()
        assert (made[i].problem is None) == (sum(len(b.text) for b in blocks) >= 80)
        if meta[i].title:
            assert meta[i].title in flat or meta[i].title in page


def html_text(page):
    """All text of a page by the standard parser, scripts and styles left out."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")
            self.out += [v for k, v in attrs if k == "alt" and v]

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    w = Words()
    w.feed(page)
    w.close()
    return " ".join(w.out)


def test_page_head_and_title_rules():
    assert html.headline("A headline of some length | Site", None) == "A headline of some length"
    assert html.headline("Site - A headline of some length", "Site") == "A headline of some length"
    assert html.headline("Short - Site", None) == "Short - Site"
    block = lambda kind, text: P.Block(kind, text)
    body = [block("paragraph", "A sentence of the body goes here. " * 5)] * 4
    assert html.trim_head([block("list_item", "Home"), block("paragraph", "Log in"), *body]) == body
    assert html.trim_head(body) == body
    words = " ".join(f"word{i}" for i in range(30))
    assert html.trim_head([block("paragraph", words), *body]) == body and html.trim_head([block("table", words), *body])[0].kind == "table"
