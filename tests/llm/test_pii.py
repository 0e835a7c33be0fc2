import hashlib
import random
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pii as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15

    out = [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if ok(k, m[0])]
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB0123456789.@+-() %é٣\n", max_size=80), st.randoms())
def test_base_patterns(text, rnd):
    card = "4111 1111-1111 1111"
    for t in (text, text + card, text + "+1 (551) 555-0826" + text, "1.2.3.4" + text, text + "a.b@c-d.e.f" + text):
        assert P.base_spans(t) == brute(t)


def test_linear_time():
    start = time.time()
    for t in ("x" * 400_000, "1" * 400_000, "1." * 200_000, "+1" * 200_000, "a@" * 200_000, "1 " * 200_000):
        P.base_spans(t)
        P.added_spans([t], [[]], P.trained())
    assert time.time() - start < 20


def found(text):
    base = P.base_spans(text)
    return [(k, text[s:e]) for k, s, e in P.added_spans([text], [base], P.trained())[0]]


def test_distant_mentions_agree():
    far = " and so on and on" * 40
    text = "Phone +1 (551) 555-0826 was given." + far + " Then 551-555-0826 again." + far + " no 5515550826 more."
    assert [x[1] for x in found(text)] == ["551-555-0826", "5515550826"] and {x[0] for x in found(text)} == {"phone"}
    assert found("An order 5515550826 stands alone.") == []
    assert found("Write to a12.lee (at) mail4.example (dot) com now.") == [("email", "a12.lee (at) mail4.example (dot) com")]


def test_many_distant_repeats_agree():
    far = " and so on and on" * 40
    first, more = "Phone +1 (551) 555-0826 was given.", far + " no 5515550826 more."
    for text in (first + more * 100, more * 100 + far + first, more * 50 + far + first + more * 50):
        assert found(text) == [("phone", "5515550826")] * 100
    both = "".join(far + f" no {'5515550826' if i % 2 else '551-555-0826'} more." for i in range(100))
    assert len(found(first + both)) == 100 and found(more * 100) == []


def test_plain_numbers_stay_clean():
    for t in ("On 2024-01-05 12-30 it rained.", "ISBN 978-3-16-148410-0 costs 12.", "Version 10.2.300.4 came.", 'token = "9c8b45435718dcc700c184a7e303cdc6"', "pi is 3.14159265", "1234567", "words only, no more"):
        assert found(t) == [], t


def test_held_out_accuracy():
    rnd, hit, all_, wrong, clean = random.Random(99), 0, 0, 0, 0
    for _ in range(400):
        label, ways = P._made_number(rnd)
        text = f"of the {ways[0]} and then a lot of words. " + f"It is {rnd.choice(ways)} and so on."
        got = {(s, e) for _, s, e in P.base_spans(text)} | {(s, e) for _, s, e in P.added_spans([text], [P.base_spans(text)], P.trained())[0]}
        if label:
            all_ += 1
            hit += len(got) >= 2
        else:
            clean += 1
            wrong += bool(got)
    print(hit / all_, wrong / clean)
    assert hit / all_ > 0.9 and wrong / clean < 0.1


def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = P.op6_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        b = brute(texts[r.doc_id])
        say = ",".join(f"{k}:{s}:{e}" for k, s, e in b)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in b) for k in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(say.encode()).hexdigest() and set(filter(None, say.split(","))) <= set(r.spans.split(","))


def test_odd_rows(docs):
    texts = [None, "", "é mail a@b.co, 192.168.0.1", "x " * 60000 + "+1 (551) 555-0826"]
    got = {r.doc_id: r for r in P.find(docs(texts)).collect()}
    assert [got[i].spans for i in range(4)] == ["", "", "email:7:13,ip:15:26", "phone:120000:120017"]
    out = [r.text for r in P.redact(docs(texts)).orderBy("doc_id").collect()]
    assert out[:3] == [None, "", "é mail [EMAIL], [IP]"] and out[3].endswith("x [PHONE]")
    assert P.find(docs(["a"]).where("false")).count() == 0 and P.redact(docs(texts)).columns == docs(texts).columns


def test_spans_apart_by_bisection():
    import random

    rnd = random.Random(2)
    for _ in range(200):
        base = sorted((("ip", s, s + rnd.randrange(1, 9)) for s in (rnd.randrange(60) for _ in range(rnd.randrange(6)))), key=lambda x: x[1])
        test = P._apart(base)
        for s in range(60):
            e = s + rnd.randrange(1, 6)
            assert test(s, e) == (not any(s < b and a < e for _, a, b in base))


def test_marginals_of_trees_are_exact():
    """Sum-product on graphs without loops, against the sum over all labellings."""
    from itertools import product

    rng = np.random.default_rng(4)
    for links in ([(0, 1, 0), (1, 2, 2), (1, 3, 1)], [(0, 1, 2)], [(0, 2, 1), (1, 2, 0)]):
        n = 1 + max(max(a, b) for a, b, _ in links)
        field = P.Field(rng.normal(size=(3, P.LABELS)), rng.normal(size=(3, P.LABELS, P.LABELS)))
        x, held = rng.normal(size=(n, 3)), np.array([-1] * (n - 1) + [2])
        got = field.marginals(x, np.array(links), held)
        want, u = np.zeros((n, P.LABELS)), x @ field.unary
        for ys in product(range(P.LABELS), repeat=n):
            if ys[-1] == 2:
                weight = np.exp(sum(u[i, y] for i, y in enumerate(ys[:-1])) + sum(field.pair[k][ys[a], ys[b]] for a, b, k in links))
                for i, y in enumerate(ys):
                    want[i, y] += weight
        assert np.abs(got - want / want.sum(1, keepdims=True)).max() < 2e-3


def test_many_mentions_take_linear_time():
    import time

    def took(n):
        text = " ".join(f"call 555-0{i % 10}{i % 7}-{1000 + i} or +1 555 0{i % 10}{i % 7} {1000 + i}." for i in range(n))
        base = P.base_spans(text)
        began = time.process_time()
        P.added_spans([text], [base], P.trained())
        return time.process_time() - began

    P.trained()
    few, many = took(1000), took(8000)
    assert many < 8 * few * 2.5, (few, many)
