"""Text functions as Column builders; ``sql`` has the same in DuckDB's dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import lexicon as L


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def fold(text: Column) -> Column:
    """Without the accents of western European letters, as the keyword index stores terms."""
    return F.translate(text, L.ACCENTED, L.UNACCENTED)


def content(words: Column) -> Column:
    """Words that aren't stop words, repeats kept."""
    return F.filter(words, lambda w: ~w.isin(*L.STOP_WORDS))


def _stem_once(word: Column) -> Column:
    n = F.length(word)
    return (
        F.when(word.endswith("ies") & (n >= 5), F.concat(F.left(word, n - 3), F.lit("y")))
        .when(word.endswith("sses"), F.left(word, n - 2))
        .otherwise(F.regexp_replace(word, L.STEM_SUFFIX, "$1"))
    )


def stem(word: Column) -> Column:
    """Suffixes stripped in three passes."""
    for _ in range(3):
        word = let(word, _stem_once)
    return word


def stems(words: Column) -> Column:
    return F.transform(words, stem)


def token_estimate(text: Column) -> Column:
    """A token for each CJK character, one for each four others, and one more; 0 for no text."""
    # Most texts have no character from U+1100 on, where CJK begins, and are counted by that.
    n = F.length(text)
    other = F.when((F.octet_length(text) == n) | ~text.rlike("[\\x{1100}-\\x{10FFFF}]"), n).otherwise(F.length(F.regexp_replace(text, L.CJK_CLASS, "")))
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.length(text) - other + F.ceil(other / F.lit(4.0)) + 1).cast("long")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[\\s\\p{Z}]+", " "), "^ | $", "")


def preview(text: Column, limit: int = 220) -> Column:
    """Whitespace collapsed; cut at the last space within ``limit`` characters, with an ellipsis."""

    def cut(flat: Column) -> Column:
        head = F.left(flat, F.lit(limit))
        return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit("…")))

    return let(squeeze(text), cut)


def strip_markup(text: Column) -> Column:
    """Links, emphasis, code ticks and strikes gone, their words kept."""
    text = F.regexp_replace(text, "\\[([^\\]]*)\\]\\(([^)]*)\\)", "$1 ($2)")
    text = F.regexp_replace(text, "[*_]{1,3}([^*_]+)[*_]{1,3}", "$1")
    text = F.regexp_replace(text, "`([^`]+)`", "$1")
    return F.regexp_replace(text, "~~([^~]+)~~", "$1")


def keyword_terms(query: str) -> list[str]:
    """A query's index terms: its content words over two letters, each with its differing stem
    where that is no stop word; repeats count. Failing these, all words over one letter."""
    import re
    import unicodedata

    plain = lambda w: "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
    words = re.findall(r"[^\W_]+", query.lower())
    out = []
    for w in words:
        if len(w) > 2 and w not in L.STOP_WORDS:
            out.append(w)
            s = stem_word(w)
            if s != w and len(s) > 3 and s not in L.STOP_WORDS:
                out.append(s)
    if not out:
        # The joining word becomes a term where only stop words are left.
        rest = [w for w in words if len(w) > 1]
        content_ = [w for w in rest if w not in L.STOP_WORDS]
        out = content_ or [t for i, w in enumerate(rest) for t in (["or", w] if i else [w])]
    return [plain(w) for w in out]


def stem_word(word: str) -> str:
    """``stem`` for a Python string."""
    for _ in range(3):
        before = word
        if word.endswith("ies") and len(word) >= 5:
            word = word[:-3] + "y"
        elif word.endswith("sses"):
            word = word[:-2]
        else:
            word = next((word[: -len(s)] for s in L.SUFFIXES if word.endswith(s) and len(word) - len(s) >= 4), word)
        if word == before:
            break
    return word


def markers(text: Column) -> Column:
    """Citation markers as written."""
    return F.regexp_extract_all(text, F.lit("(?i)" + L.MARKER), F.lit(0))


def normal_marker(marker: Column) -> Column:
    kind = F.when(F.lower(marker).startswith("[web"), F.lit("Web")).otherwise(F.lit("Source"))
    return F.concat(F.lit("["), kind, F.lit(" "), F.regexp_replace(marker, "[^0-9]", ""), F.lit("]"))


def tidy(text: Column) -> Column:
    """Spaces that removed markers leave behind."""
    text = F.regexp_replace(F.regexp_replace(text, " {2,}", " "), " ([.,;])", "$1")
    return F.regexp_replace(F.regexp_replace(text, "\n ", "\n"), "^\\s+|\\s+$", "")


def reports_insufficiency(text: Column) -> Column:
    low = F.lower(text)
    return F.exists(strings(L.INSUFFICIENCY_PHRASES), lambda p: F.contains(low, p))


def session_title(text: Column) -> Column:
    """The first seven words, sixty characters at most."""
    flat = F.array_join(F.slice(F.filter(F.split(text, "\\s+"), lambda w: w != ""), 1, 7), " ")
    return let(flat, lambda t: F.when(F.length(t) > 60, F.concat(F.left(t, F.lit(60)), F.lit("…"))).otherwise(t))


def position_score(position: Column) -> Column:
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(0.06) * position)


def match_score(hay: Column, needle: str, base: int) -> Column:
    """Prefix, word start, substring, or all words present: 60, 40, 25 or 10 above the base; else 0."""
    if not needle:
        return F.lit(base)
    low, pin = F.lower(hay), needle.lower()
    words = pin.split()
    every = F.lit(len(words) > 1)
    for w in words:
        every = every & low.contains(w)
    score = F.when(low.startswith(pin), base + 60).when(low.contains(f" {pin}"), base + 40).when(low.contains(pin), base + 25)
    return score.when(every, base + 10).otherwise(0)
