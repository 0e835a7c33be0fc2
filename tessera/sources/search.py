"""Search replies as results: a result page's HTML, an instant answer's JSON tree, model listings."""

from __future__ import annotations

import json
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Result:
    title: str
    url: str
    snippet: str
    score: float
    site: str | None


def _host(url: str) -> str | None:
    try:
        return urlsplit(url).hostname
    except ValueError:
        return None


def unwrapped(href: str) -> str:
    """The target of a redirecting link, else the address with a scheme."""
    whole = f"https:{href}" if href.startswith("//") else href
    target = parse_qs(urlsplit(whole).query).get("uddg") if "uddg=" in href else None
    return target[0] if target else whole


class _Results(HTMLParser):
    """Collects (address, title, snippet) by the classes that result pages give their links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict[str, str]] = []
        self.into: str | None = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").lower()
        if tag == "a" and ("result__a" in classes or "result-link" in classes):
            self.found.append({"url": unwrapped(a.get("href", "")), "title": "", "snippet": ""})
            self.into = "title"
        elif tag in ("a", "div", "td") and self.found and ("result__snippet" in classes or "result-snippet" in classes):
            self.found[-1]["snippet"], self.into = "", "snippet"
        elif "result__url" in classes:
            self.into = None

    def handle_endtag(self, tag):
        if tag in ("a", "div", "td"):
            self.into = None

    def handle_data(self, data):
        if self.into and self.found:
            self.found[-1][self.into] += data


def page_results(html: str, limit: int) -> list[Result]:
    """Results of a search page in its order, the first of each address, up to ``limit``."""
    reader = _Results()
    reader.feed(html)
    reader.close()
    first = {f["url"]: f for f in reversed(reader.found) if f["url"] and f["title"].strip()}
    kept = [f for f in reader.found if first.get(f["url"]) is f][:limit]
    return [Result(f["title"].strip(), f["url"], f["snippet"].strip(), max(0.1, 1.0 - 0.06 * i), _host(f["url"])) for i, f in enumerate(kept)]


def instant_answers(payload: str, query: str, limit: int, engine: str = "duckduckgo.com") -> list[Result]:
    """Results of an instant answer's tree: abstract, definition, results, related topics. What has no
    address, or one on the search engine itself, can't be cited and is left out."""
    data = json.loads(payload)
    out: dict[str, Result] = {}

    def put(title: str, url: str | None, text: str, score: float) -> None:
        url = (url or "").strip()
        host = _host(url)
        if host and host != engine and not host.endswith(f".{engine}"):
            out.setdefault(url, Result(title or url, url, text, score, host))

    if data.get("AbstractText"):
        put(data.get("Heading", query), data.get("AbstractURL"), data["AbstractText"], 1.0)
    if data.get("Definition"):
        put(data.get("DefinitionSource", query), data.get("DefinitionURL"), data["Definition"], 0.9)
    todo = [(data.get("RelatedTopics") or [], 0.8), (data.get("Results") or [], 0.95)]
    while todo:
        entries, base = todo.pop()
        for i, e in enumerate(entries):
            if isinstance(e.get("Topics"), list):
                # The rest of this level follows the group's own topics.
                todo += [([{}] * (i + 1) + entries[i + 1 :], base), (e["Topics"], base - 0.05)]
                break
            if e.get("Text") and e.get("FirstURL"):
                head, dash, _ = e["Text"].partition(" - ")
                put(head if dash else e["Text"][:80], e["FirstURL"], e["Text"], base - 0.01 * i)
    return list(out.values())[:limit]


def model_names(payload: Column, provider: str) -> Column:
    """Sorted model names of a provider's listing, ``{models:[{name}]}`` or ``{data:[{id}]}``."""
    if provider == "tags":
        rows = F.from_json(payload, "models array<struct<name: string>>")["models"]
        return F.array_sort(F.filter(F.transform(rows, lambda r: r["name"]), lambda n: n.isNotNull()))
    rows = F.from_json(payload, "data array<struct<id: string>>")["data"]
    return F.array_sort(F.filter(F.transform(rows, lambda r: r["id"]), lambda n: n.isNotNull()))
