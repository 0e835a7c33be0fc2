import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.packing import WordIds, binary_pieces, op8_packing, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]


WORDS = WordIds(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aB.c,,' \n\t\r\x1c\xa0éÉ́ẞßΣσİH̱ 中1!%<|endoftxs")), max_size=40), max_size=5))
def test_words_give_the_ids_of_whole_texts(whole_texts):
    t = WORDS.tokenizer
    ids, counts = WORDS.encode(whole_texts)
    assert ids.tolist() == [i for x in whole_texts for i in t.encode(x, add_special_tokens=False).ids + [1]]
    assert counts.sum() == len(ids)


def test_added_tokens_are_those_of_the_library(docs):
    plain = Tokenizer.from_file(PATH)
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|endof text|>"]
    texts = ["end <|endoftext|> go", *marks, *(f"{a}{m}{b}{m}{m}, Next {m}.\nAnd {m}" for m in marks for a, b in (("End", "Go"), (" É.", "x "), ("", "中")))]
    want = [plain.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert want[0] == [806, 49407, 861, 1]
    ids, counts = WordIds(PATH).encode(texts)
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want))
    rows = pack(docs(texts), PATH).orderBy("doc_id", "start").collect()
    assert [[i for r in rows if r.doc_id == k for i in np.frombuffer(r.ids, "<u4").tolist()] for k in range(len(texts))] == want


def test_pieces_are_powers_of_two():
    for n in [1, 2, 3, 2047, 2048, 2049, 5000, 10240]:
        p = binary_pieces(n)
        assert sum(p) == n and all(x & (x - 1) == 0 and x <= 2048 for x in p)
        assert len([x for x in p if x < 2048]) == len({x for x in p if x < 2048})


def test_odd_rows(docs, whole):
    texts = [None, "", "one two", "one two", "word " * 5000, "x" * 30000, "日本 語。", "it's a.b,c ...!"]
    rows = pack(docs(texts), PATH).collect()
    for i, t in enumerate(texts):
        mine = sorted((r.start, r.length, bytes(r.ids), r.doc_tokens) for r in rows if r.doc_id == i)
        ids = whole(t)
        assert np.frombuffer(b"".join(m[2] for m in mine), "<u4").tolist() == ids
        assert all(m[3] == len(ids) for m in mine) and [m[0] for m in mine] == np.cumsum([0] + [m[1] for m in mine[:-1]]).tolist()
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_empty_table(docs):
    assert pack(docs(["a"]).where("false"), PATH).count() == 0


def test_query_against_whole_encoding(spark, sf, whole):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_packing(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = whole(texts[r.doc_id])
        assert r.doc_tokens == len(ids) and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
