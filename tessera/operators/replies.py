"""Parsers of model replies and search payloads."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.lexicon import MARKER
from tessera.operators.batches import rows_of_texts

_MARKER = re.compile(MARKER, re.I)
_LEAD = re.compile(r"\A(?:- )?(?:\* )?(?:• )?(?:> )?")
_BOLD = re.compile(r"\A\*\*(.+?)\*\*")


def _lines(text: str) -> list[str]:
    """Lines with content, without leading list marks and bold."""
    found = (_LEAD.sub("", x.strip()) for x in text.splitlines() if x.strip())
    return [_BOLD.sub(r"\1", x).strip() for x in found]


def _neat(text: str) -> str:
    return " ".join(re.sub(r"[*_]{1,3}\Z", "", re.sub(r"\A[*_]{1,3}", "", text)).split())


def _field(line: str, *names: str) -> str | None:
    """What follows one of the names and its colon."""
    head, colon, rest = line.partition(":")
    return (rest or line) if colon and head.lower() in names else None


def _first_marker(text: str) -> str | None:
    m = _MARKER.search(text)
    return m[0] if m else None


@dataclass
class Flashcard:
    front: str
    back: str
    marker: str | None


def flashcards(text: str) -> list[Flashcard]:
    """Cards of ``Q:`` and ``A:`` lines; other lines go on with the answer. Cards lacking either are left out."""
    cards: list[list] = []
    for line in _lines(text):
        if (q := _field(line, "q", "question")) is not None:
            cards.append([q, "", None])
        elif (a := _field(line, "a", "answer")) is not None:
            if cards:
                cards[-1][1:] = [a, _first_marker(a)]
        elif cards:
            cards[-1][1] += f" {line}"
    return [Flashcard(_neat(q), _neat(a), m) for q, a, m in cards if q.strip() and a.strip()]


@dataclass
class QuizItem:
    question: str
    choices: list[str]
    answer: int
    explanation: str
    marker: str | None


_CHOICE = re.compile(r"([A-Ha-h])[.):](.*)")
_NUMBERED = re.compile(r"\d+[.)](.*)")


def _answer_index(value: str, choices: int) -> int | None:
    """A letter's place, or a number counted from one (from zero where that alone fits)."""
    value = value.strip().upper()
    if value and value[0].isascii() and value[0].isalpha():
        return ord(value[0]) - ord("A")
    if m := re.search(r"\d+", value):
        n = int(m[0])
        return n - 1 if 1 <= n <= choices else n if n < choices else None
    return None


def quiz(text: str) -> list[QuizItem]:
    """Numbered questions with lettered choices, an answer and a reason. Incomplete ones are left out."""
    items: list[dict] = []
    for line in _lines(text):
        now = items[-1] if items else None
        if len(line) > 3 and (m := _CHOICE.fullmatch(line)) and m[2].strip():
            if now:
                now["choices"].append(m[2].strip())
        elif (v := _field(line, "answer", "correct")) is not None:
            if now:
                now["answer"] = _answer_index(v, len(now["choices"]))
        elif (v := _field(line, "why", "explanation")) is not None:
            if now:
                now.update(why=v, marker=_first_marker(v))
        elif line.endswith("?") or ((m := _NUMBERED.fullmatch(line)) and len(m[1].strip()) > 10 and not m[1].strip().lower().startswith("answer")):
            m = _NUMBERED.fullmatch(line)
            items.append({"q": (m[1] if m else line).strip(), "choices": [], "answer": None, "why": "", "marker": None})
        elif now and not now["choices"]:
            now["q"] += f" {line}"
    whole = [i for i in items if i["q"] and len(i["choices"]) >= 2 and i["answer"] is not None and 0 <= i["answer"] < len(i["choices"])]
    return [QuizItem(_neat(i["q"]), [_neat(c) for c in i["choices"]], i["answer"], _neat(i["why"]), i["marker"]) for i in whole]


def with_flashcards(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ordinal, front, back, marker): every card of every reply."""
    rows = lambda t: [(n, c.front, c.back, c.marker) for n, c in enumerate(flashcards(t))]
    return rows_of_texts(texts, "ordinal long, front string, back string, marker string", rows, id_col, text_col, id_col)


def with_quiz(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ordinal, question, choices, answer, explanation, marker): every item of every reply."""
    rows = lambda t: [(n, i.question, i.choices, i.answer, i.explanation, i.marker) for n, i in enumerate(quiz(t))]
    return rows_of_texts(texts, "ordinal long, question string, choices array<string>, answer long, explanation string, marker string", rows, id_col, text_col, id_col)


#: Characters of a pick's reason.
MOST_REASON = 140
_PICK = re.compile(r"([^|\-.:—)]*)(?:[|\-.:—)](.*))?", re.S)


def choices(text: str, offered: int, keep: int) -> list[tuple[int, str | None]] | None:
    """(number, reason) of each pick of a reply, numbers beyond what was offered left out; [] for NONE, null for nothing readable."""
    text = text.strip()
    if text.upper().startswith("NONE"):
        return []
    picked: dict[int, str | None] = {}
    for line in filter(None, (x.strip() for x in text.splitlines())):
        m = _PICK.match(line)
        number = m[1].strip()
        if re.fullmatch(r"[+]?\d+", number) and 1 <= int(number) <= offered and len(picked) < keep:
            reason = " ".join((m[2] or "").strip().strip('|"-–—').split())
            picked.setdefault(int(number), (reason if len(reason) <= MOST_REASON else re.sub(" [^ ]*$", "", reason[:MOST_REASON]) + "…") or None)
    return list(picked.items()) or None


def rerank_scores(reply: Column, expected: int) -> Column:
    """Array of scores 0 to 1 from ``1: 7`` lines, or null where fewer than half are given."""
    lines = F.transform(F.split(reply, "\n"), lambda x: F.trim(x))
    rows = F.filter(lines, lambda x: F.contains(x, F.lit(":")))
    pair = lambda x: F.struct(
        F.regexp_replace(F.substring_index(x, ":", 1), "[^0-9]", "").try_cast("int").alias("i"),
        F.regexp_replace(F.regexp_replace(x, "^[^:]*:", ""), "[^0-9.]", "").try_cast("double").alias("v"),
    )
    good = F.filter(F.transform(rows, pair), lambda p: p["i"].between(1, expected) & p["v"].isNotNull())

    def place(found: Column) -> Column:
        at = lambda i: F.coalesce(F.get(F.reverse(F.filter(found, lambda p: p["i"] == i)), F.lit(0))["v"], F.lit(0.0))
        scores = F.transform(F.sequence(F.lit(1), F.lit(expected)), lambda i: F.least(F.lit(10.0), at(i)) / 10.0)
        return F.when(F.size(found) >= max(1, expected // 2), scores)

    return F.get(F.transform(F.array(good), place), F.lit(0))


def search_results(payload: Column, provider: str) -> Column:
    """Array of (title, url, snippet, content, score, published_at) from a provider's JSON, in its order."""
    brave = "web struct<results: array<struct<title: string, url: string, description: string, page_age: string>>>"
    tavily = "results array<struct<title: string, url: string, content: string, raw_content: string, score: double, published_date: string>>"
    if provider == "brave":
        rows = F.from_json(payload, brave)["web"]["results"]
        made = lambda r, i: F.struct(r["title"].alias("title"), r["url"].alias("url"), r["description"].alias("snippet"), F.lit(None).cast("string").alias("content"), F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(0.06) * i).alias("score"), r["page_age"].alias("published_at"))
    elif provider == "tavily":
        rows = F.from_json(payload, tavily)["results"]
        made = lambda r, i: F.struct(r["title"].alias("title"), r["url"].alias("url"), r["content"].alias("snippet"), r["raw_content"].alias("content"), F.coalesce(r["score"], F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(0.06) * i)).alias("score"), r["published_date"].alias("published_at"))
    else:
        raise ValueError(f"no provider {provider}")
    return F.transform(F.filter(rows, lambda r: F.coalesce(r["url"], F.lit("")) != ""), made)
