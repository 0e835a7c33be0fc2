import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tessera.llm import shingles as H
from tessera.llm import near_dedup as N
from tessera.llm import packing, pii, quality_mil, quality_rules
from tessera.llm import simhash as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) >= 0.8 * len(a | b)


def brute_kept(texts):
    """Ids that stay: the least of each component of similar pairs."""
    ids = sorted(texts)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: shingles(texts[i]) for i in ids}
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i for i in ids if find(i) == i}


def test_stages_one_by_one(spark):
    """Each stage on all that its predecessor kept, against its operator or brute force."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = []
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        if name == "packing":
            break
        assert out.columns == columns, name
        after = {r.doc_id: r.text for r in rows}
        assert len(after) == len(rows) and set(after) <= set(texts)
        if name == "quality rules":
            want = {r.doc_id: r.clean_text for r in quality_rules.measure(docs).where("kept").collect()}
            assert after == want and all(r.n_chars == len(r.text) for r in rows)
        elif name == "SimHash near-dedup":
            want = brute_kept(texts)
            print(len(want), len(after), len(want ^ set(after)))
            assert want == set(after)
        elif name == "PII":
            assert set(after) == set(texts) and not any(pii.base_spans(t) for t in after.values() if "[" not in t)
        kept.append((name, len(after)))
        docs, texts = spark.createDataFrame(rows, out.schema), after
    print(kept)
    ids = {r.doc_id: 0 for r in rows}
    for r in rows:
        ids[r.doc_id] += r.length
        assert len(r.ids) == 4 * r.length
    assert set(ids) == set(texts) and all(ids[r.doc_id] == r.doc_tokens for r in rows)


def made(n, seed):
    """Copies of one text with four words changed, and texts of their own."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 7)))
    base = [word() for _ in range(500)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(4):
            w[rnd.randrange(500)] = word()
        out.append(" ".join(w))
    return out + [" ".join(word() for _ in range(120)) for _ in range(40)]


@pytest.mark.parametrize("block", [20_000, 30])
def test_large_groups_and_split_blocks(docs, block):
    texts = [*made(150, 3), *["the same text again and again in full"] * 30, None, "", " "]
    df = docs(texts)
    groups = {r.doc_id: r.group for r in N.near_groups(df, block=block).collect()}
    want = brute_kept(dict(enumerate(texts)))
    got = {i for i in range(len(texts)) if groups.get(i, i) == i}
    assert got == want and len(want) == 43
    if block == 20_000:
        assert {r.doc_id for r in N.deduplicate(df).collect()} == want


def test_distance_follows_similarity():
    """The mean distance is the angle between the sets, and no pair at the similarity lies beyond WIDE."""
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    for changes in (1, 4, 7, 8, 18, 30):
        far, similarity = [], (396 - 5 * changes) / (396 + 5 * changes)
        for k in range(30):
            other = list(base)
            for i in rnd.sample(range(10, 390, 6), changes):
                other[i] = f"x{k}"
            both = H.shingle_sets([" ".join(base), " ".join(other)], 5)
            a, b = (S.bits_of(np.concatenate([S.majority((x := h * m) ^ x >> np.uint64(29), np.array([len(h)])) for m in N.MIX])) for h in both)
            far.append(int((a != b).sum()))
        want = 512 * np.arccos(2 * similarity / (1 + similarity)) / np.pi
        assert abs(np.mean(far) - want) <= 4 * np.sqrt(want / 30) + 2, (changes, np.mean(far), want)
        assert similarity < 0.8 or max(far) <= N.WIDE


@pytest.mark.parametrize("block", [20_000, 30])
def test_pairs_around_the_similarity_are_decided_exactly(docs, block):
    """400 words of which 5 to 13 differ: similarities of 0.72 to 0.88, on either side of 0.8."""
    rnd, texts = random.Random(6), []
    for k in range(90):
        base = [f"w{k}x{i}" for i in range(400)]
        other = list(base)
        for i in rnd.sample(range(10, 390, 6), 5 + k % 9):
            other[i] = f"y{k}"
        texts += [" ".join(base), " ".join(other)]
    texts += [" ".join(f"v{i}" if i != j else f"z{j}" for i in range(400)) for j in range(40)]
    assert {r.doc_id for r in N.deduplicate(docs(texts)).collect()} == brute_kept(dict(enumerate(texts)))
    groups = {r.doc_id: r.group for r in N.near_groups(docs(texts), block=block).collect()}
    assert {i for i in range(len(texts)) if groups.get(i, i) == i} == brute_kept(dict(enumerate(texts)))


def test_near_duplicates_of_a_table_are_exact(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert {r.doc_id for r in N.deduplicate(d).collect()} == brute_kept({r.doc_id: r.text for r in d.collect()})


def test_odd_rows(spark, docs):
    good = "This sentence is long enough to be kept by every rule of the set, as it ends with a stop."
    texts = [None, "", good + "\nMenu\nQuite another one follows here with other words in it, and is whole too.", "x" * 100_000, "a@b.co and 1.2.3.4 " + good]
    d = docs(texts).union(docs(texts))
    r = quality_rules.clean(d)
    assert r.columns == d.columns and sorted(x.doc_id for x in r.collect()) == [2, 2, 4, 4]
    k = N.deduplicate(d)
    assert k.columns == d.columns and sorted(x.doc_id for x in k.collect()) == [0, 2, 3, 4]
    unnamed = d.withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id")))
    assert sorted(x.doc_id or 0 for x in N.deduplicate(unnamed).collect()) == [0] * 6 + [3, 4]
    assert packing.pack(unnamed, __import__("public_tokenizers").path("word_bpe_49k.json")).where("doc_id is null").count() >= 6
    assert pii.redact(unnamed).count() == 10 and S.near_duplicates(unnamed).count() == 10
    empty = d.where("false")
    model = quality_mil.Model(np.zeros(1), np.ones(1), {}, 1.0)
    assert quality_mil.keep(d, model).count() == 10
    for out in (quality_mil.keep(empty, model), quality_rules.clean(empty), N.deduplicate(empty), C.personal_data(spark, empty, ""), C.pack(spark, empty, "")):
        assert out.count() == 0
    assert packing.pack(d, __import__("public_tokenizers").path("word_bpe_49k.json")).count() > 0


def test_shingle_sets_by_words():
    """Equal exactly where the sets of five words are, whatever the pieces."""
    rnd = random.Random(8)
    texts = [None, "", " \t ", "One", "one", "A b c d e", "a  B\nc d\te", "a b c d e f", "é É 日本 x y", "x" * 40_000 + " y", "X" * 40_000 + " Y", "z" * (3 << 20) + " tail of words here now", "w " * 400_000]
    texts += [" ".join(rnd.choice("ab") for _ in range(rnd.randrange(12))) for _ in range(300)]
    got = H.shingle_sets(texts, 5)
    want = [frozenset(shingles(t)) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    alone = [H.shingle_sets([t], 5)[0] for t in texts]
    assert all(np.array_equal(a, g) for a, g in zip(alone, got, strict=True))
    names = {}
    for g, w in zip(got, want, strict=True):
        assert names.setdefault(g.tobytes(), w) == w
    assert len(names) == len(set(want))


def test_majority_in_slices():
    rnd = np.random.default_rng(3)
    counts = np.array([0, 5, S.RUN, 3 * S.RUN + 7, 0, 1, 5 * S.RUN])
    h = rnd.integers(0, 1 << 63, counts.sum(), dtype=np.uint64) * np.uint64(2)
    want = [sum(1 << b for b in range(64) if 2 * int((x >> np.uint64(b) & np.uint64(1)).sum()) > len(x)) for x in np.split(h, np.cumsum(counts)[:-1])]
    assert S.majority(h, counts).tolist() == want


def test_repeated_ids_and_clashing_names(spark):
    rows = [(1, "the first text of one", "a"), (1, "another text of one", "b"), (1, "another text of one", "b"), (2, "words of two go here", "c"), (None, "words of two go here", "d")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"__gone": F.lit(1), "__tessera_key": F.lit("k"), "row": F.lit("r"), "fp": F.lit(2), "label": F.lit("l"), "bound": F.lit(True)})
    runs = [sorted(map(tuple, N.deduplicate(x).collect()), key=str) for x in (d, d.orderBy("source"), d.orderBy(F.desc("source")).repartition(3))]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 3 and all(len(r) == 9 and r[3:5] == (1, "k") for r in runs[0])
    assert N.deduplicate(d).columns == d.columns


def exact_kept(texts):
    """Ids that stay by an exact join: two sets of similarity 0.8 share one of each one's rarest fifth of shingles."""
    from collections import Counter

    sets = {i: {hash(s) for s in shingles(t)} for i, t in texts.items()}
    often = Counter(h for s in sets.values() for h in s)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i] = root[root[i]]
        return i

    def join(a, b):
        x, y = sorted((find(a), find(b)))
        root[y] = x

    first, held, pairs = {}, {}, 0
    for i in sorted(sets):
        s = sets[i]
        same = first.setdefault(frozenset(s), i)
        if same != i:
            join(i, same)
            continue
        for h in sorted(s, key=lambda h: (often[h], h))[: len(s) - -(-4 * len(s) // 5) + 1]:
            for j in held.setdefault(h, []):
                if find(i) != find(j) and len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                    join(i, j)
                    pairs += 1
            held[h].append(i)
    return {i for i in sets if find(i) == i}, pairs


def test_no_group_is_lost_at_a_larger_size(spark):
    """Candidates come from SimHash; on 10,000 documents they lose none of what an exact join finds."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    want, pairs = exact_kept(texts)
    groups = {r.doc_id: r.group for r in N.near_groups(docs).collect()}
    assert {i for i in texts if groups.get(i, i) == i} == want and pairs > 20 and len(want) < len(texts) - 200
