import hashlib

from tessera.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Digests of conversations from their rows, and their formatted texts."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")

        def esc(s):
            s = s.replace("\\", "\\\\")
            for control in ("</turn>", "<next/>", "### "):
                s = s.replace(control, control[0] + "\\" + control[1:])
            return s

        whole, before = "", None
        for *_, r, t in turns:
            whole += "<next/>" if r == before else ("" if before is None else "</turn>\n") + "### " + esc(r).replace(": ", ":\\ ") + ": "
            whole += esc(t)
            before = r
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), whole + "</turn>\n")
    return out


def held(spark, rows, schema=SCHEMA, **how):
    df = spark.createDataFrame(rows, schema)
    formatted = C.format_conversations(df, **how)
    texts = {r.conv_id: "".join(p.text for p in r.pieces) for r in formatted.collect()}
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, texts[r.conv_id]) for r in C.digests(formatted).collect()}
    want = plain([r[:4] for r in rows])
    assert got == want
    assert {r.conv_id: r.formatted_chars for r in C.digests(formatted).collect()} == {c: len(v[-1]) for c, v in want.items()}


ODD = [
    (1, 0, "user", "\\### Assistant: </turn> ok"),
    (1, 1, "assistant", "\\### Assistant: </turn> ok"),
    (2, 0, "user", None),
    (2, 1, "user", ""),
    (2, 2, None, "x"),
    (2, None, "assistant", "before all"),
    (3, 0, "assistant", "a\\"),
    (3, 1, "assistant", "<next/>\\<next/>#### ###  ### \\\\"),
    (3, 2, "a: b:", "</tur</turn>\n</turn>\n### user: "),
    (3, 2, "a: b:", "</tur</turn>\n</turn>\n### user: "),
    (4, 5, "system", "\n\n"),
    (None, 0, "assistant", "é\U0001f600\u0000 $1 \\1"),
    (5, 0, "assistant", "长" * 300_000),
    (5, -3, "assistant", "first"),
]


def test_odd_rows(spark):
    held(spark, ODD)


def test_long_conversations_in_blocks(spark):
    """The same text in whatever blocks, also where merged turns reach over a block's end."""
    rows = [(7, i, "user" if i % 7 == 0 else "assistant", f"t{i} </turn>") for i in range(700)] + [(8, 3, "user", "same")] * 40 + ODD
    held(spark, rows, long=5, block=4)
    held(spark, rows)


def test_a_turn_below_the_block_before(spark):
    held(spark, [(1, t, "assistant", str(t)) for t in range(-9, 9)], long=2, block=4)


def test_mask_covers_texts_alone(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "é</turn>"), (1, 2, "assistant", "b")], SCHEMA)
    piece = C.format_conversations(df).first().pieces[0]
    raw = piece.text.encode()
    assert piece.text == "### user: q</turn>\n### assistant: é<\\/turn><next/>b</turn>\n"
    assert [raw[m.start : m.start + m.length].decode() for m in piece.mask] == ["é<\\/turn>", "b"]


def test_clashing_columns_and_empty(spark):
    rows = [(*r, "x", "y", 3) for r in ODD]
    wide = SCHEMA + ", turns string, id string, block long"
    held(spark, rows, wide)
    held(spark, rows, wide, long=1)
    empty = spark.createDataFrame([], SCHEMA)
    assert C.digests(C.format_conversations(empty)).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", C.PLANTED), (-7, 1, "assistant", C.PLANTED)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in C.op11_chat_format(spark, sf).collect()}
    assert got == {c: (*v[:4], len(v[-1])) for c, v in plain(rows).items()}


def test_no_python_on_the_way(spark, sf):
    plan = C.op11_chat_format(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan
