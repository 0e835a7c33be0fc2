"""Line-first quality rules, in DataFrame functions alone and without a shuffle.

Lines are judged one by one: a line fails by its punctuation (over 15 % of its
marks, or a fragment of fewer than eight words that doesn't end like a
sentence), as navigation (two or more separators with four words or fewer to
each) or as boilerplate (a short line with a stock phrase). Failing lines are
removed; a document that loses over 40 % of its word characters is rejected,
as is one that the base rules fail (under 20 words, or over 30 % of the words
in eight-word windows that occur twice or more).

Windows are compared by a 64-bit hash of their words' 64-bit hashes.

Cases: a null or empty text has no words and fails the base rule. Lines
without a word are dropped at no loss. Repeated rows are judged once each.
Very long texts are judged whole, all their lines in one row.
Other columns are kept by ``clean`` and ignored by ``measure``; helper columns
exist only inside. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST_PERCENT, MAX_MARK_PERCENT = 20, 30, 40, 15
FRAGMENT_WORDS, BOILERPLATE_CHARS, WINDOW = 8, 200, 8
# Character classes, characters and stock phrases that the rules look for.
BREAKS = " \t\n\x0b\x0c\r"
BREAK, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
SYMBOL, SEPARATOR, MARK = r"[#*$%&|<>]", "[|»›•·>]", r"[!-/:-@\[-`{-~]"
SENTENCE_END = tuple(".!?…。！？:;\"'”’»)]")
PHRASES = (
    "all rights reserved",
    "privacy policy",
    "terms of (use|service)",
    "cookie (policy|settings|preferences)",
    "(use|uses|accept|accepting) (of )?cookies",
    "click here",
    "read more",
    "skip to (main )?content",
    "(sign|log) ?in to",
    "subscribe (to|now)",
    "enable javascript",
    "share (this )?on (facebook|twitter|x)",
    "copyright (©|\\(c\\)|[0-9]{4})",
)
BOILERPLATE = "\\b(" + "|".join(PHRASES) + ")"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def word_chars(text: Column) -> Column:
    return F.length(text) - count(text, BREAK)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BREAK + "+"), "")


def line_fails(line: Column) -> Column:
    """Whether a line with a word fails one of the three kinds of rules."""

    def judged(n_words: Column) -> Column:
        return (
            ((n_words < FRAGMENT_WORDS) & ~F.right(F.rtrim(line, F.lit(BREAKS)), F.lit(1)).isin(*SENTENCE_END))
            | (count(line, MARK) * 100 > word_chars(line) * MAX_MARK_PERCENT)
            | ((F.length(line) <= BOILERPLATE_CHARS) & F.lower(line).rlike(BOILERPLATE))
            | let(count(line, SEPARATOR), lambda n: (n >= 2) & (n * 4 >= n_words))
        )

    return let(count(line, WORD), judged)


def repeat_words(words: Column) -> Column:
    """Words covered by windows of ``WINDOW`` words that occur twice or more."""

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum"))
        step = lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), x - a["last"])).alias("sum"))
        return F.aggregate(starts, zero, step, lambda a: a["sum"])

    def repeated(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            at = lambda j: F.get(s, j)["h"]
            twice = F.filter(s, lambda x, j: F.coalesce(at(j - 1) == x["h"], F.lit(False)) | F.coalesce(at(j + 1) == x["h"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered(let(placed, starts))).otherwise(0)

    def hashed(each: Column) -> Column:
        last = F.size(each) - WINDOW
        window = lambda i: F.xxhash64(*[F.get(each, i + k) for k in range(WINDOW)])
        return F.when(last > 0, let(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window), repeated)).otherwise(0)

    return let(F.transform(words, lambda w: F.xxhash64(w)), hashed)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts and verdict, lost characters, ``kept`` and the cleaned text."""
    counted = _count(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    judged = counted.withColumn("base_failed", _failed()).withColumn("lost_chars", F.col("word_chars") - word_chars(F.col("clean_text")))
    return judged.withColumn("kept", _keeps(F.col("base_failed"), F.col("lost_chars")))


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def _keeps(failed: Column, lost: Column) -> Column:
    return ~failed & (lost * 100 <= F.col("word_chars") * MAX_LOST_PERCENT)


def _count(texts: DataFrame, carried: str) -> DataFrame:
    """Counts and cleaned texts of rows (carried, text)."""
    base = texts.select(carried, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = base.select(carried, "text", words_of(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    return split.select(
        carried,
        F.size("words").cast("long").alias("n_words"),
        word_chars(F.col("text")).cast("long").alias("word_chars"),
        count(F.col("text"), SYMBOL).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.array_join(F.filter("lines", lambda x: ~line_fails(x)), "\n").alias("clean_text"),
    )


def clean(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` that the rules keep, failing lines removed and ``chars_col``, where present, counted anew.

    The columns of ``docs`` stay as they were, but for these two."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    counted = _count(whole, "row")
    lost = lambda t: F.col("word_chars") - word_chars(t)
    text = let(F.col("clean_text"), lambda t: F.when(_keeps(_failed(), lost(t)), F.array(t)))
    # A generator, as a filter would be pushed down and have the counts computed twice.
    kept = counted.select("row", F.explode(text).alias("clean_text"))
    return kept.select(
        *[
            F.col("clean_text").cast(docs.schema[c].dataType).alias(c) if c == text_col else F.length("clean_text").cast(docs.schema[c].dataType).alias(c) if c == chars_col else F.col("row")[c].alias(c)
            for c in docs.columns
        ]
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and line-first verdict for every document."""
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept"]
    return measure(table(spark, sf_dir, "documents")).select(*columns)


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_W, _B = f"'{WORD}'", f"'{BREAK}'"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1_SQL = f"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), {_W}) AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_W})) AS lines
  FROM documents),
windows AS (SELECT rid, unnest(range(1, len(words) - {WINDOW - 2})) AS i, words FROM base),
named AS (SELECT rid, i, array_to_string(words[i:i+{WINDOW - 1}], ' ') AS w FROM windows),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM named) WHERE c > 1),
gaps AS (SELECT rid, least({WINDOW}, i - lag(i, 1, -{WINDOW}) OVER (PARTITION BY rid ORDER BY i)) AS g FROM twice),
repeats AS (SELECT rid, sum(g)::BIGINT AS n FROM gaps GROUP BY rid),
judged AS (SELECT rid, sum(bare) FILTER (fails)::BIGINT AS lost FROM (
  SELECT rid, bare,
         len(regexp_extract_all(line, {_sql_text(MARK)})) * 100 > bare * {MAX_MARK_PERCENT}
         OR (n < {FRAGMENT_WORDS} AND NOT list_contains([{", ".join(map(_sql_text, SENTENCE_END))}], right(rtrim(line, {_SPACES}), 1)))
         OR (bars >= 2 AND bars * 4 >= n)
         OR (length(line) <= {BOILERPLATE_CHARS} AND regexp_matches(lower(line), {_sql_text(BOILERPLATE)})) AS fails
  FROM (SELECT rid, line, length(regexp_replace(line, {_B}, '', 'g')) AS bare,
               len(regexp_extract_all(line, {_W})) AS n, len(regexp_extract_all(line, {_sql_text(SEPARATOR)})) AS bars
        FROM (SELECT rid, unnest(lines) AS line FROM base))) GROUP BY rid),
counts AS (
  SELECT base.rid, doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, {_B}, '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, {_sql_text(SYMBOL)}))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
         coalesce(lost, 0)::BIGINT AS lost_chars
  FROM base LEFT JOIN repeats USING (rid) LEFT JOIN judged USING (rid)),
verdict AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars,
       NOT base_failed AND lost_chars * 100 <= word_chars * {MAX_LOST_PERCENT} AS kept
FROM verdict
"""
