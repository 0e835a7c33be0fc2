import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb

from tessera.llm import sentencepiece_scan as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
LATTICE = S.lattice_of(PATH)


@pytest.fixture(scope="module")
def library():
    """The same pieces and scores, read by the library as a unigram model."""
    model = pb.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def best(raw):
    """Brute force in one pass over a whole normalised text: (sum, ids), longest last piece on ties."""
    pieces = {LATTICE.bytes_of[i]: (i, s) for i, s in scores().items()}
    out = [(0.0, [])] + [None] * len(raw)
    for e in range(1, len(raw) + 1):
        for s in range(max(0, e - LATTICE.states), e):
            if out[s] is None or (s < len(raw) and raw[s] & 0xC0 == 0x80):
                continue
            p = pieces.get(raw[s:e])
            if p is None:
                whole = e == len(raw) or raw[e] & 0xC0 != 0x80
                if not whole or any(b & 0xC0 != 0x80 for b in raw[s + 1 : e]):
                    continue
                step = (LATTICE.unknown, LATTICE.byte_id[np.frombuffer(raw[s:e], np.uint8)].tolist())
            else:
                step = (p[1], [p[0]])
            if out[e] is None or out[s][0] + step[0] > out[e][0]:
                out[e] = (out[s][0] + step[0], out[s][1] + step[1])
    return out[-1]


def scores(memo={}):  # noqa: B006
    if not memo:
        model = pb.ModelProto()
        model.ParseFromString(open(PATH, "rb").read())
        memo.update({i: p.score for i, p in enumerate(model.pieces) if p.type == 1})
    return memo


TEXTS = st.text(alphabet=st.sampled_from(list("aeinorst  .,ThéñüßÄ\n日🙂\x01▁")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(5, 30))
def test_scan_of_small_chunks_is_the_best_path(text, chunk):
    raw = LATTICE.normalise(text)
    want = best(raw)[1]
    assert S.scan_encode(LATTICE, raw, chunk) == want if raw else want == []
    words = S.Words(LATTICE)
    assert S.encode_texts(words, [text])[0].tolist() == want
    if raw:
        ids, total = S.scan_text(words, raw, chunk)
        assert ids.tolist() == want and abs(total - best(raw)[0]) < 1e-6


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeinorst日")), min_size=1, max_size=120), st.integers(5, 20))
def test_text_without_spaces(text, chunk):
    raw = text.encode()
    assert S.scan_encode(LATTICE, raw, chunk) == best(raw)[1] == S.scan_text(S.Words(LATTICE), raw, chunk)[0].tolist()


def test_products_associate():
    rng = np.random.default_rng(0)
    ms = [np.where(rng.random((6, 6)) < 0.4, S.LOW, rng.integers(-9, 0, (6, 6)).astype(float)) for _ in range(7)]
    step = ms[0]
    for m in ms[1:]:
        step = S.plus(step, m)
    assert np.array_equal(np.maximum(S.scan(ms)[-1], -1e9), np.maximum(step, -1e9))


def test_library_agrees_by_word(library, spark, sf):
    words = {w for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() for w in r.text.split()}
    words = sorted(words)
    mine = [x.tolist() for x in S.encode_texts(S.Words(LATTICE), words)]
    theirs = library.encode(words, num_threads=1)
    # The library adds 32-bit floats and at times stops short of the best sum by a small difference.
    total = lambda ids: sum(scores().get(i, 0.0) for i in ids)
    assert all(total(a) >= total(b) for a, b in zip(mine, theirs, strict=True))
    assert sum(a == b for a, b in zip(mine, theirs, strict=True)) > 0.99 * len(words)


def test_round_trip_and_odd_rows(docs):
    texts = [None, "", " ", "  two  spaces ", "x" * 9000, "日本語" * 3000, "word " * 9000, "tab\tand\nline\r\n", "🙂 é", "word " * 9000]
    made = S.encode(docs(texts), PATH, giant=4000)
    got = {r.doc_id: r for r in S.decode(made, PATH).collect()}
    assert [got[i].text for i in range(len(texts))] == texts
    for i in (3, 7, 8):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == best(LATTICE.normalise(texts[i]))[1]
    whole = {r.doc_id: r.ids for r in S.encode(docs(texts), PATH, giant=1 << 30).collect()}
    assert all(got[i].ids == whole[i] for i in range(len(texts)))
    assert S.decode(S.encode(docs(["a"]).where("false"), PATH), PATH).count() == 0


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = S.op5_sentencepiece(spark, sf).collect()
    assert len(rows) == len(texts)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
    assert sum(len(t.encode()) > S.CHUNK for t in texts.values()) > 5
    for r in rows:
        ids = whole_path(LATTICE.normalise(texts[r.doc_id]))
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), r.doc_id


def whole_path(raw):
    """The best path of a whole text by one table over its bytes, no cuts and nothing remembered."""
    pieces = {LATTICE.bytes_of[i]: (i, s) for i, s in scores().items()}
    total, via = [0.0] + [None] * len(raw), [None] * (len(raw) + 1)
    for s in range(len(raw)):
        if total[s] is None or raw[s] & 0xC0 == 0x80:
            continue
        width = next(w for w in range(1, 5) if s + w == len(raw) or raw[s + w] & 0xC0 != 0x80)
        for e in range(s + 1, min(len(raw), s + LATTICE.longest) + 1):
            p = pieces.get(raw[s:e])
            if p is None and e - s == width:
                p = (-1, LATTICE.unknown)
            # A later start is a shorter piece, so of equal sums the first stays.
            if p and (total[e] is None or total[s] + p[1] > total[e]):
                total[e], via[e] = total[s] + p[1], (s, p[0])
    out, at = [], len(raw)
    while at:
        s, i = via[at]
        out += [i] if i >= 0 else LATTICE.byte_id[np.frombuffer(raw[s:at], np.uint8)].tolist()[::-1]
        at = s
    return out[::-1]


def test_models_with_spaces_inside_pieces_are_refused(monkeypatch):
    model = S._model(PATH)
    piece = next(p for p in model.pieces if p.type == model.SentencePiece.NORMAL)
    piece.piece = "a\u2581b"
    monkeypatch.setattr(S, "_model", lambda path: model)
    with pytest.raises(ValueError, match="space"):
        S.Lattice(PATH)


def test_long_texts_without_spaces(spark):
    """Random and common ideographs, letters and unknown characters, within a task and as giants: the best path's ids."""
    import random

    rnd = random.Random(8)
    kinds = {1: "的一是不了在人有我他这个们中来上大为和国", 2: "".join(chr(c) for c in range(0x4E00, 0x9FA5, 7)), 3: "abcdefghij/0123456789", 4: "日🙂\x01é長"}
    texts = {i: "".join(rnd.choice(k) for _ in range(n)) for i, (k, n) in enumerate([(kinds[1], 12_000), (kinds[2], 8_000), (kinds[3], 30_000), (kinds[4], 3_000), (kinds[2], 1_500)])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in S.encode(df, PATH, giant=20_000).collect()}
    for i, t in texts.items():
        assert got[i] == best(LATTICE.normalise(t))[1], i
    assert {r.doc_id: r.text for r in S.decode(S.encode(df, PATH), PATH).collect()} == texts


def test_matrix_of_a_segment_is_the_product_of_its_chunks():
    raw = ("中来上大为和国日" * 40 + "abc" * 50).encode()
    segment = S.Segment(LATTICE, raw, 0, True, True, 64)
    parts = segment.matrices()
    assert len(parts) > 10 and np.allclose(segment.matrix(), S.scan(parts)[-1]) and abs(segment.matrix()[0, 0] - best(raw)[0]) < 1e-6
