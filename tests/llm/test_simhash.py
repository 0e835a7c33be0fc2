import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import simhash as S
from tessera.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """{id: smallest id reachable}, ids being positions."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=12), st.integers(0, 3), st.randoms())
def test_groups_of_a_block(seeds, radius, rnd):
    values = sorted({s ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(4))) for s in seeds for _ in range(8)})
    got = S.groups(np.array(values, np.uint64), radius)
    root = {v: v for v in values}
    for _ in values:
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= radius:
                    root[a] = root[b] = min(root[a], root[b])
    assert got.tolist() == [root[v] for v in values]


def test_masks_cover_two_flips():
    masks = [m & (2**64 - 1) for m in S.block_masks()]
    assert len(masks) == 28 and all(m.bit_count() == 48 for m in masks)
    assert all(any(not (m >> a & 1) and not (m >> b & 1) for m in masks) for a in range(64) for b in range(64))


def test_odd_rows(docs):
    texts = [None, "", " \n", "one", "One", "a b", "word " * 70000, "word " * 70001, "été ÉTÉ ß", "x\x1cy z", "a b c d"]
    got = {r.doc_id: r for r in S.near_duplicates(docs(texts)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(fps)
    for i, f in enumerate(fps):
        assert got[i].fp & (2**64 - 1) == f and got[i].component_id == want[i], i
    assert S.near_duplicates(docs(["a"]).where("false")).count() == 0


def test_query_against_brute_force(spark, sf):
    rows = sorted(S.op10_simhash(spark, sf).collect())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    fps = [brute_fingerprint(texts[i]) for i in ids]
    assert [(r.doc_id, r.fingerprint) for r in rows] == [(i, f"{f:016x}") for i, f in zip(ids, fps, strict=True)]
    assert [r.component_id for r in rows] == [ids[c] for c in brute_components(fps)]


def test_long_chain_of_links(spark):
    n = 200
    links = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(500, 400), (500, 400)], "u long, v long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 400: 400, 500: 400}
