import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import flac as A


@settings(max_examples=15, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=6), st.integers(0, 3))
def test_round_trip(raws, kind):
    rnd = random.Random(kind)
    made = [bytes(int(128 + 60 * np.sin(i / (7 + kind))) for i in range(9000)), bytes([rnd.randrange(256) for _ in range(5000)]), b"\x05" * 4096, b"text, as it is written. " * 500]
    payloads = [A.padded(r) for r in raws + made[kind:]]
    files = A.encode(payloads)
    assert [x[0] for x in A.decode(files)] == payloads


def test_kinds_and_sizes():
    wave = bytes(int(128 + 60 * np.sin(i / 9) + 30 * np.sin(i / 23)) for i in range(8192))
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 256, 4096, dtype=np.uint8).tobytes()
    files = A.encode([wave, noise, bytes(4096), b"words of text " * 256 + bytes(64 * 8)])
    figures = [x[2] for x in A.decode(files)]
    assert figures[0]["lpc"] + figures[0]["fixed"] == 8192 // A.BLOCK and len(files[0]) < 0.7 * 8192
    assert figures[1]["verbatim"] == figures[2]["constant"] == 4096 // A.BLOCK and len(files[2]) < 200


def test_any_damage_is_noticed():
    (file,) = A.encode([b"some text that is long enough " * 64])
    for at in range(file.index(b"\xff\xf8"), len(file)):
        bad = bytearray(file)
        bad[at] ^= 1 << at % 8
        with pytest.raises((ValueError, IndexError)):
            A.decode([bytes(bad)])


def test_without_a_seek_table():
    payload = b"blocks found one by one, " * 1024
    (file,) = A.encode([A.padded(payload)])
    size = int.from_bytes(file[43:46], "big")
    bare = file[:4] + b"\x80" + file[5:42] + file[46 + size :]
    got = A.decode([bare, file])
    assert got[0][0] == got[1][0] == A.padded(payload) and got[0][1] == got[1][1]


def test_header_fields():
    assert A._number(0x7F) == b"\x7f" and A._number(0x80).decode() == "\x80" and A._number(0xFFFF).decode() == "￿"
    (file,) = A.encode([bytes(range(256)) * 20])
    assert struct.unpack(">HH", file[8:12]) == (A.BLOCK, A.BLOCK) and file[12 + 14 : 42] == hashlib.md5((np.arange(5120, dtype=np.int64).astype(np.uint8) - np.uint8(128)).tobytes()).digest()


def test_escape_partition_is_read():
    """A hand-written block: fixed order 0, one escaped partition of 8-bit raw values."""
    values = [-128, 127, 0, 5] * 4
    bits = f"{8 << 1:08b}" + "00" + "0000" + "1111" + f"{8:05b}" + "".join(f"{v & 255:08b}" for v in values)
    bits += "0" * (-len(bits) % 8)
    block = A._block_header(0, 16) + bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    check = int(A.crc16(np.frombuffer(block, np.uint8), np.array([0]), np.array([len(block)]))[0])
    about = A.RATE << 44 | 7 << 36 | 16
    info = struct.pack(">HH", 16, 16) + bytes(6) + about.to_bytes(8, "big") + bytes(16)
    (got,) = A.decode([b"fLaC\x80" + len(info).to_bytes(3, "big") + info + block + struct.pack(">H", check)])
    assert got[0] == bytes(v + 128 for v in values)


def test_query_and_odd_rows(spark, sf, docs):
    rows = A.op3_flac(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        p = A.padded(texts[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    odd = [None, "", "a", "x" * 64, "long text " * 30000, "a"]
    media = A.to_media(docs(odd))
    back = {r.doc_id: r for r in A.from_media(media).collect()}
    assert [bytes(back[i].payload) for i in range(6)] == [A.padded((t or "").encode()) for t in odd]
    blocks = A.pcm_blocks(media).where("doc_id = 4").orderBy("block").collect()
    assert b"".join(bytes(b.pcm) for b in blocks) == A.padded(odd[4].encode()) and [b.sample_offset for b in blocks] == list(range(0, 300_032, A.BLOCK))
    assert A.to_media(docs(["a"]).where("false")).count() == 0
