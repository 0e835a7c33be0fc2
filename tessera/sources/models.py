"""Requests to language models and what their replies hold, for the three kinds of service: local chat, chat completions, messages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

KEEP_WARM = "10m"
MOST_TOKENS = 4096


@dataclass(frozen=True)
class Request:
    model: str
    messages: tuple[tuple[str, str], ...]
    system: str = ""
    temperature: float = 0.2
    max_tokens: int | None = None
    stop: tuple[str, ...] = field(default=())


def _turns(pairs) -> list[dict]:
    return [{"role": role, "content": text} for role, text in pairs]


def payload(kind: str, r: Request, stream: bool = False) -> dict:
    """The request's JSON for a kind of service: ``local``, ``completions`` or ``messages``."""
    if kind != "messages" and not r.messages:
        raise ValueError("a request needs a message")
    said = _turns(([("system", r.system)] if r.system else []) + list(r.messages))
    base = {"model": r.model, "stream": stream}
    if kind == "local":
        options = {"temperature": r.temperature, "num_predict": r.max_tokens, "stop": list(r.stop) or None}
        return base | {"messages": said, "keep_alive": KEEP_WARM, "options": {k: v for k, v in options.items() if v is not None}}
    if kind == "completions":
        more = {"max_tokens": r.max_tokens, "stream_options": {"include_usage": True} if stream else None}
        return base | {"messages": said, "temperature": r.temperature} | {k: v for k, v in more.items() if v is not None}
    if kind == "messages":
        system = "\n\n".join(t for t in (r.system, *(t for role, t in r.messages if role == "system")) if t)
        more = {"system": system or None, "stop_sequences": list(r.stop) or None}
        return base | {"messages": _turns(m for m in r.messages if m[0] != "system"), "temperature": r.temperature, "max_tokens": r.max_tokens or MOST_TOKENS} | {k: v for k, v in more.items() if v is not None}
    raise ValueError(f"no kind {kind}")


def reply_text(body: Column, kind: str) -> Column:
    """The text of a reply's JSON."""
    if kind == "local":
        return F.get_json_object(body, "$.message.content")
    if kind == "completions":
        return F.get_json_object(body, "$.choices[0].message.content")
    blocks = F.from_json(F.get_json_object(body, "$.content"), "array<struct<type:string,text:string>>")
    return F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "")


def usage(body: Column, kind: str) -> Column:
    """(asked, said) tokens of a reply's JSON."""
    paths = {"local": ("$.prompt_eval_count", "$.eval_count"), "completions": ("$.usage.prompt_tokens", "$.usage.completion_tokens"), "messages": ("$.usage.input_tokens", "$.usage.output_tokens")}[kind]
    return F.struct(*[F.get_json_object(body, p).try_cast("long").alias(n) for n, p in zip(("asked", "said"), paths, strict=True)])
