import zlib

import numpy as np
import pytest

from tessera.llm import quality_mil as M


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.1"
    rows = M.op2_quality_mil(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    return rows, labels


def test_held_out_accuracy(scored):
    rows, labels = scored
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    y, s = np.array([labels[r.doc_id] for r in held]), np.array([r.score for r in held])
    order = np.argsort(np.argsort(s))
    auc = (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    accuracy = np.mean([r.predicted == labels[r.doc_id] for r in held])
    print(len(held), auc, accuracy, np.quantile(s[y == 1], [0.01, 0.05, 0.5]), np.quantile(s[y == 0], [0.5, 0.9, 0.95, 0.99]))
    assert auc > 0.95 and accuracy > 0.95


def test_rows(scored):
    for r in scored[0][:500]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_it_learns_from_bag_labels():
    rng = np.random.default_rng(0)
    bags = rng.integers(1, 5, 60)
    x = rng.normal(size=(bags.sum(), M.N_FEATURES)).astype(np.float32)
    y = (np.add.reduceat(x[:, 0], np.cumsum(bags) - bags) > 0).astype(np.float32)
    model = M.fit(x, bags, y)
    assert np.mean((model.score(x, bags) > 0.5) == y) > 0.9


def test_attention_is_per_passage():
    x, bags = M.passage_features([None, "", "a" * 1025, "é" * 600])
    assert bags.tolist() == [1, 1, 3, 3] and len(x) == 8 and not np.isnan(x).any()


def test_odd_rows(spark, docs):
    d = docs([None, "", "abc", "abc", "word " * 50000])
    for labels in ([], [(0, 1), (0, 0), (2, None)]):
        model = M.train(d, spark.createDataFrame(labels, "doc_id long, quality int"))
        rows = M.score(d, model).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert M.score(d.where("false"), model).count() == 0


def plain_loss(w, x, bags, y):
    """The mean log loss and decay, a document and a passage at a time."""
    total, at = 0.0, 0
    for n, label in zip(bags, y, strict=True):
        h = [np.tanh(v @ w["e"] + w["eb"]) for v in x[at : at + n]]
        s = [float((np.tanh(v @ w["v"]) / (1 + np.exp(-(v @ w["u"])))) @ w["a"]) for v in h]
        a = np.exp(s) / np.exp(s).sum()
        z = sum(k * v for k, v in zip(a, h, strict=True))
        p = 1 / (1 + np.exp(-(z @ w["c"] + w["cb"][0])))
        total -= label * np.log(p) + (1 - label) * np.log(1 - p)
        at += n
    return total / len(y) + M.DECAY / 2 * sum((v**2).sum() for v in w.values())


def test_against_a_plain_version_and_its_slopes():
    rng = np.random.default_rng(1)
    bags = np.array([1, 3, 2, 5])
    x, y = rng.normal(size=(bags.sum(), 6)), np.array([1.0, 0, 1, 0])
    w = {"e": rng.normal(size=(6, 5)), "eb": rng.normal(size=5), "v": rng.normal(size=(5, 4)), "u": rng.normal(size=(5, 4)), "a": rng.normal(size=4), "c": rng.normal(size=5), "cb": rng.normal(size=1)}
    start = np.cumsum(bags) - bags
    p = M._forward(w, x, start, bags)["p"]
    loss = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + M.DECAY / 2 * sum((v**2).sum() for v in w.values())
    assert abs(loss - plain_loss(w, x, bags, y)) < 1e-12
    grad = M.gradients(w, x, start, bags, np.repeat(np.arange(4), bags), y)
    for k, v in w.items():
        for i in np.ndindex(v.shape):
            up, down = ({n: m.copy() for n, m in w.items()} for _ in range(2))
            up[k][i] += 1e-5
            down[k][i] -= 1e-5
            assert abs((plain_loss(up, x, bags, y) - plain_loss(down, x, bags, y)) / 2e-5 - grad[k][i]) < 1e-7, (k, i)


def test_long_texts_in_slices():
    import tracemalloc

    text = "Some words of a text, as they go.\n" * 70_000
    x, bags = M.passage_features([text, "short", text[:5000]])
    whole = M._features([text.encode()])
    assert np.array_equal(x[: len(whole)], whole) and bags.tolist() == [len(whole), 1, 10]
    tracemalloc.start()
    M.passage_features(["a b c " * 2_000_000])
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()


def test_texts_of_one_id(spark):
    rows = [(i % 40, f"{'good words here. ' * (i % 7 + 1)}{i}", "x") for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    d = spark.createDataFrame(rows, "doc_id long, text string, x string")
    a, b = (M.train(df, labels).w for df in (d, d.orderBy("text").repartition(5)))
    assert all(np.array_equal(a[k], b[k]) for k in a) and a


def test_whole_documents_within_the_bound_of_passages(spark, monkeypatch):
    """A text's passages are fitted all or not at all, and a long one doesn't keep out those after it."""
    texts = [(i, "word " * (40 + 1000 * (i % 5))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = {}
    monkeypatch.setattr(M, "fit", lambda x, bags, y: seen.update(bags=bags.tolist(), rows=len(x)))
    M.train(docs, labels)
    sizes = {i: -(-len(t) // M.PASSAGE) for i, t in texts}
    assert sorted(seen["bags"]) == sorted(n for i, n in sizes.items() if zlib.crc32(str(i).encode()) % 4 != 2) and seen["rows"] == sum(seen["bags"])
    M.train(docs, labels, passages=100)
    assert 60 < sum(seen["bags"]) <= 100 and max(seen["bags"]) > 5
