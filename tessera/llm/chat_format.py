"""Chat formatting by relational expressions alone.

A conversation's turns are collected as structs and sorted, adjacent turns of one
role are merged by an array aggregation, and the text is concatenated:

    ### user: first text<next/>second text</turn>
    ### assistant: an answer</turn>

``<next/>`` stands between the texts of merged turns, so that the rows can be read
back. Inside texts and roles a backslash is doubled and one is put after the first
character of each control string, which therefore occurs nowhere but where the
template puts it; taking a backslash off whatever it precedes restores the text.
The loss mask is a list of byte spans: every text of the role that is learned, and
nothing of the template.

Conversations of over ``LONG`` rows, however many of all rows they hold, are
collected in blocks of ``BLOCK`` turn numbers first, so that no task collects all
of their turns as structs; only the formatted pieces of a conversation meet in one
row (of 2 GB at most, Spark's limit for a string), as a digest of the whole needs.
The others are collected at once. Both ways give the same text.

Cases: rows go by turn, equal turns by role and text, a null turn before all. A
null text or role is empty; empty turns are turns. Repeated rows are turns of
their own. A null conversation is one like any other. Other columns are ignored,
whatever their names. Very long texts are kept whole. An empty table gives no
rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import few, table

HEAD, COLON, CLOSE, NEXT = "### ", ": ", "</turn>\n", "<next/>"
LEARNED = "assistant"
LONG, BLOCK = 512, 64
#: Control strings, as they are and as they stand inside texts.
ESCAPES = (("\\", "\\\\"), ("</turn>", "<\\/turn>"), ("<next/>", "<\\next/>"), ("### ", "#\\## "))
PLANTED = "\\### Assistant: </turn> ok"


def escaped(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _opening(role: Column) -> Column:
    return F.concat(F.lit(HEAD), F.replace(escaped(role), F.lit(COLON), F.lit(":\\ ")), F.lit(COLON))


def _merged(turns: Column) -> Column:
    """Array of (role, texts): adjacent turns of one role as one."""
    empty = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def put(done: Column, turn: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(last["role"].alias("role"), F.array_append(last["texts"], turn["text"]).alias("texts"))
        fresh = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        same = last["role"] == turn["role"]
        return F.when(same, F.array_append(F.slice(done, 1, F.size(done) - 1), joined)).otherwise(F.array_append(done, fresh))

    return F.aggregate(turns, empty, put)


def _parts(merged: Column, learned: str) -> Column:
    """Array of (s, take): what the merged turns are written as, but for the first one's opening and the last one's close."""
    part = lambda s, take: F.struct(s.alias("s"), take.alias("take"))

    def turn(t: Column, j: Column) -> Column:
        before = F.concat(F.lit(CLOSE), _opening(t["role"]))
        lead = lambda k: F.when(k > 0, F.lit(NEXT)).when(j > 0, before).otherwise(F.lit(""))
        return F.flatten(F.transform(t["texts"], lambda x, k: F.array(part(lead(k), F.lit(False)), part(escaped(x), t["role"] == learned))))

    return F.flatten(F.transform(merged, turn))


def _spans(parts: Column) -> Column:
    """Byte spans (start, length) of the parts to take."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def put(done: Column, p: Column) -> Column:
        n = F.octet_length(p["s"])
        return F.struct((done["at"] + n).alias("at"), F.when(p["take"], F.array_append(done["spans"], F.struct(done["at"].alias("start"), n.alias("length")))).otherwise(done["spans"]).alias("spans"))

    return F.aggregate(parts, start, put, lambda done: done["spans"])


def _blocks(turns: DataFrame, keys: list[str], learned: str) -> DataFrame:
    """A block's body, mask and outer roles for each value of ``keys``."""
    collected = turns.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    merged = collected.select(*keys, _merged(F.col("turns")).alias("merged"))
    parts = merged.select(*keys, F.get("merged", F.lit(0))["role"].alias("first"), F.element_at("merged", -1)["role"].alias("last"), _parts(F.col("merged"), learned).alias("parts"))
    return parts.select(*keys, "first", "last", F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("body"), _spans(F.col("parts")).alias("spans"))


def _pieces(blocks: Column) -> Column:
    """Array of (text, mask) of a conversation's sorted blocks: what stands between two blocks goes before the second."""

    def piece(b: Column, i: Column) -> Column:
        before = F.get(blocks, i - 1)["last"]
        lead = F.when(i == 0, _opening(b["first"])).when(before == b["first"], F.lit(NEXT)).otherwise(F.concat(F.lit(CLOSE), _opening(b["first"])))
        end = F.when(i == F.size(blocks) - 1, F.lit(CLOSE)).otherwise(F.lit(""))
        moved = F.transform(b["spans"], lambda s: F.struct((s["start"] + F.octet_length(lead)).alias("start"), s["length"].alias("length")))
        return F.struct(F.concat(lead, b["body"], end).alias("text"), moved.alias("mask"))

    return F.transform(blocks, piece)


def format_conversations(turns: DataFrame, learned: str = LEARNED, long: int = LONG, block: int = BLOCK) -> DataFrame:
    """(conv_id, pieces): an array of (text, mask), one piece but for long conversations; the texts joined are the
    formatted conversation, and a mask's byte spans are counted within its piece."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    # Where there are many rows: counted from the ids alone, added up in each task before they are shuffled.
    ids = rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > long).select(F.col("conv_id").alias("id"))
    ids = few(ids)
    is_long = F.col("conv_id").eqNullSafe(F.col("id"))
    whole = _blocks(rows.join(ids, is_long, "left_anti"), ["conv_id"], learned).select("conv_id", F.array(F.struct("first", "last", "body", "spans")).alias("blocks"))
    number = F.coalesce(F.floor(F.col("turn") / block).cast("long"), F.lit(-(2**63)))
    split = _blocks(rows.join(ids, is_long, "left_semi").withColumn("block", number), ["conv_id", "block"], learned)
    met = split.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "first", "last", "body", "spans"))).alias("all"))
    long_ones = met.select("conv_id", F.transform("all", lambda b: F.struct(*[b[c].alias(c) for c in ("first", "last", "body", "spans")])).alias("blocks"))
    return whole.unionByName(long_ones).select("conv_id", _pieces(F.col("blocks")).alias("pieces"))


def turns_of(text: Column) -> Column:
    """Array of (role, texts): the merged turns read back from a formatted conversation."""
    blocks = F.filter(F.split(text, CLOSE), lambda b: b != "")

    def turn(b: Column) -> Column:
        halves = F.split(b, COLON, 2)
        return F.struct(unescaped(F.substring(F.get(halves, 0), len(HEAD) + 1, 2**31 - 1)).alias("role"), F.transform(F.split(F.get(halves, 1), NEXT), unescaped).alias("texts"))

    return F.transform(blocks, turn)


def learned_text(pieces: Column) -> Column:
    """All text under the masks, unescaped. Spans are cut from bytes, so a span costs its own length."""
    cut = lambda p: F.array_join(F.transform(p["mask"], lambda s: unescaped(p["text"].cast("binary").substr(s["start"] + 1, s["length"]).cast("string"))), "")
    return F.array_join(F.transform(pieces, cut), "")


def digests(formatted: DataFrame) -> DataFrame:
    """Turn counts, digests and lengths read back from formatted conversations."""
    joined = formatted.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"), learned_text(F.col("pieces")).alias("loss"))
    read = joined.select("conv_id", turns_of(F.col("text")).alias("turns"), "loss", F.char_length("text").cast("long").alias("formatted_chars"))
    line = lambda t: F.array_join(F.transform(t["texts"], lambda x: F.concat(t["role"], F.lit("\n"), x, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + F.size(t["texts"])).alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        F.size("turns").cast("long").alias("merged_turns"),
    )


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, formatted and read back."""
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_conversations(turns.unionByName(planted)))


def _sql() -> str:
    text = "text"
    for plain, written in ESCAPES:
        text = f"replace({text}, '{plain}', '{written}')"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{PLANTED}' FROM range(2) t(i)),
t AS (SELECT *, {text} AS esc, replace({text.replace("(text,", "(role,")}, ': ', ':\\ ') AS who, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS begins FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
  sum(length(esc) + CASE WHEN begins THEN {len(HEAD) + len(COLON) + len(CLOSE)} + length(who) ELSE {len(NEXT)} END)::BIGINT AS formatted_chars,
  (count(*) FILTER (begins))::BIGINT AS merged_turns
FROM t GROUP BY conv_id"""


OP11_SQL = _sql()
