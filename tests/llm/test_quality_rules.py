import re
from collections import Counter

import duckdb

from tessera.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c = Counter(wins)
    cover = {j for i, x in enumerate(wins) if c[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), failed)


def test_base_counts_and_odd_rows(docs):
    line = "The quick brown fox jumps over the lazy dog and then rests for a very long while."
    texts = [None, "", "\n \n", "a b c", f"{line}\n{line}", "w " * 9, "x y " * 30, "\n".join(f"{line} {i}." for i in range(40)), "é ü\x0bö\x0cß\r\n日本 語" * 10, "word " * 60000, "a b c d e f g h i a b c d e f g h z " * 2]
    got = {r.doc_id: r for r in Q.measure(docs(texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), i
    assert Q.measure(docs(["a"]).where("false")).count() == 0


def test_line_rules(docs):
    good = "This sentence is long enough to be kept by every rule of the set, as it ends with a stop."
    bad = ["Home | About | Contact | Help", "Menu", "TO!! ALL!! OF!! YOU!! WHO!! SHOUT!!", "All rights reserved.", "We use cookies to improve the site.", "%%% $$$ ### noise&&& in%%% words***"]
    text = "\n".join([good, *bad, "", "Short but whole.", good.replace("long", "quite long")])
    r = Q.measure(docs([text])).first()
    assert r.clean_text == "\n".join([good, "Short but whole.", good.replace("long", "quite long")])


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.execute(Q.OP1_SQL)
    names = [d[0] for d in rel.description]
    want = sorted(dict(zip(names, row, strict=True)).items() for row in rel.fetchall())
    got = sorted(r.asDict().items() for r in Q.op1_quality_rules(spark, sf).collect())
    assert got == want


def test_labels_agree(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = Q.op1_quality_rules(spark, sf).join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and r.n_words >= 20]
    bad = [r.kept for r in rows if r.quality == 0]
    print(sum(good) / len(good), sum(bad) / len(bad))
    assert sum(good) / len(good) > 0.9 and sum(bad) / len(bad) < 0.25
