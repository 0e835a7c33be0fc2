"""What is said to a language model: answers, study tools, selections, rerank, queries and picks.

The wording is this library's own; what replies must look like is what
``replies`` reads."""

from __future__ import annotations

from collections.abc import Sequence

CITING = "Cite what you use right after the statement it supports, with the marker given: [Source n] or [Web n]. Never make up a marker."

#: What each study tool is to write.
CONTRACTS = {
    "summary": "Write an overview of two or three sentences, then four to eight cited points, then what the sources leave open.",
    "keyPoints": "Write eight to twelve specific points with citations, the most important first.",
    "timeline": "Write a line for each event in order of time: **date** — event, with its citation. Without dates in the material, say so.",
    "faq": "Write six to twelve pairs of lines, **Q:** a question and **A:** its cited answer.",
    "quiz": "Write five to ten questions, each as a numbered line, four lines A. to D., a line 'Answer: ' with the letter and a line 'Why: ' with a citation.",
    "flashcards": "Write eight to fifteen cards, each a line 'Q: ' with a term or question and a line 'A: ' with a short cited answer.",
    "studyGuide": "Write what the material is about, its key terms with definitions, how they hang together, and five questions without answers.",
    "outline": "Write an outline: ### for sections, bullets for points, in the material's own order and words.",
    "quotations": "Write five to twelve quotations word for word, each as '> words', its source and marker, and a line on why it matters.",
    "comparison": "Take each source as a position: what each covers, where they agree, where they disagree, what to read next.",
    "briefing": "Write three bullets, two paragraphs of context and a part on what is uncertain, all of it cited.",
    "manual": "Write ordered notes from the material, with citations.",
}


def answer_system(with_sources: bool, with_web: bool, override: str | None = None) -> str:
    """The rules of an answer, by what material there is."""
    if override:
        return override
    lines = ["You answer questions from the material that the user has collected."]
    if with_sources or with_web:
        lines += [CITING, "Where the material does not answer the question, say so and name what is missing. Where two sources disagree, say so and cite both."]
    else:
        lines.append("There is no material for this question: say that nothing was found in the sources, and cite nothing.")
    if with_web:
        lines.append("WEB RESULTS come from a live search and not from the user's sources; keep the two apart, and prefer the sources.")
    return "\n".join([*lines, "Lead with the answer, be brief, and add no list of sources."])


def answer_user(question: str, context: str, history: str | None = None) -> str:
    """The question after its material, and what was said before."""
    before = f"CONVERSATION SO FAR\n{history}\n\n" if history else ""
    return f"{before}MATERIAL\n{context or '(Nothing relevant was found.)'}\n\nQUESTION\n{question.strip()}"


def study_system(tool: str) -> str:
    return "\n".join(["You write one document from the material alone, without a preamble.", CITING, "Where the material does not hold enough, write less and say what is missing.", CONTRACTS.get(tool, CONTRACTS["manual"])])


def selection(text: str, question: str) -> tuple[str, str]:
    """(system, user) of a question about a marked passage."""
    return "You explain the passage that the user marked, in under 200 words. Say so where it does not answer the question.", f"PASSAGE\n{text}\n\nQUESTION\n{question}"


def rerank(question: str, previews: Sequence[str]) -> tuple[str, str]:
    """(system, user) that ask for a line ``n: score`` of 0 to 10 for each passage."""
    passages = "\n\n".join(f"Passage {n}:\n{p}" for n, p in enumerate(previews, 1))
    return "You rate how well passages answer a question.", f"Question: {question}\n\n{passages}\n\nReply with {len(previews)} lines of the form 'n: score', scores from 0 to 10, and nothing else."


def suggest_query(question: str) -> tuple[str, str]:
    """(system, user) that ask for one line to search for."""
    return "You write web search queries.", f"Write one line to search for, and nothing else.\n\n{question}"


def pick(topic: str, results: Sequence[tuple[int, str, str, str]], keep: int) -> tuple[str, str]:
    """(system, user) that ask which results (number, title, url, snippet) to read, as ``n | reason`` lines."""
    listed = "\n".join(f"{n}. {title} — {url}" + (f"\n   {snippet}" if snippet else "") for n, title, url, snippet in results)
    return "You choose sources worth reading.", f"Topic: {topic}\n\n{listed}\n\nReply with at most {keep} lines 'number | reason', or NONE."
