"""Rows as they are read back: lookups, single values, defaults, names of kinds, texts of failures, approvals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

# File types by kind of source; other kinds have none.
MIME_TYPES = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "rtf": "application/rtf", "epub": "application/epub+zip",
    "markdown": "text/markdown", "text": "text/plain", "pasted": "text/plain", "html": "text/html",
}
#: What a null or unknown value of a column is read as; other texts become null where they are empty.
DEFAULTS = {
    "notebooks": {"title": "Untitled notebook", "summary": "", "is_favorite": False, "is_archived": False, "default_scope": "notebookSources"},
    "sources": {"title": "Untitled source", "kind": "text", "status": "queued", "checksum": "", "notes": "", "included": True},
    "chunks": {"text": ""},
}
KEPT = {"default_scope": ("notebookSources", "webOnly", "notebookAndWeb"), "status": ("queued", "fetching", "extracting", "chunking", "embedding", "ready", "partial", "failed")}
#: What went wrong, and what to do about it.
FAILURES = {
    "too short": ("The text has fewer than twenty characters.", "Paste more of it."), "too little text": ("The page holds hardly any text.", "Try another address, or paste the text."),
    "not fetched": ("The page could not be fetched.", "Check the address and the connection."), "no text": ("The file holds no text.", "Use a file with a text layer."), "no reader": ("No reader is installed for this kind of file.", "Plug in a reader, or convert the file."),
    "invalid key": ("The service refused the key.", "Enter another key."), "rate limited": ("The service has had too many requests.", "Wait a while."), "context too large": ("The request is too long for the model.", "Lower the budget."),
    "unavailable": ("The service is not available.", "Try again later."), "rejected": ("The service rejected the request.", "Check the model and the settings."),
}


def lookup(rows: DataFrame, value, key: str = "id") -> Row | None:
    """The row of a key, or None; the key reaches the scan as a filter."""
    return rows.where(F.col(key) == value).first()


def scalar(rows: DataFrame, value: Column, default=0):
    """One aggregate over a table; ``default`` where it is null."""
    found = rows.agg(value.alias("value")).first().value
    return default if found is None else found


def with_defaults(rows: DataFrame, table: str) -> DataFrame:
    """Rows as they are read: columns with a default never null, values outside a column's list its default, empty texts null."""
    out = {}
    for field in rows.schema:
        value, default = F.col(field.name), DEFAULTS.get(table, {}).get(field.name)
        if default is not None:
            value = F.when(value.isin(*KEPT[field.name]), value) if field.name in KEPT else value
            out[field.name] = F.coalesce(value, F.lit(default))
        elif field.dataType.typeName() == "string":
            out[field.name] = F.nullif(value, F.lit(""))
    return rows.withColumns(out)


def mime_type(kind: Column) -> Column:
    made = F.lit(None).cast("string")
    for k, v in MIME_TYPES.items():
        made = F.when(kind == k, F.lit(v)).otherwise(made)
    return made


def uses_sources(scope: Column) -> Column:
    return scope != "webOnly"


def uses_web(scope: Column) -> Column:
    return scope != "notebookSources"


def collapse_blank(text: Column) -> Column:
    """Lines without white space at their ends, one blank line for several, none at either end of the text."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "[\\s\\p{Z}]+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", "")


def failure_text(failure: Column) -> Column:
    """(message, recovery) of a failure; an unknown one is its own message."""
    made = F.struct(failure.alias("message"), F.lit(None).cast("string").alias("recovery"))
    for name, (message, recovery) in FAILURES.items():
        made = F.when(failure == name, F.struct(F.lit(message).alias("message"), F.lit(recovery).alias("recovery"))).otherwise(made)
    return made


def approve(approved: Column, notebook: Column) -> Column:
    """The approved notebooks with one more, which stays once where it was there."""
    return F.when(F.array_contains(approved, notebook), approved).otherwise(F.array_append(approved, notebook))


def revoke(approved: Column, notebook: Column) -> Column:
    return F.array_remove(approved, notebook)


def is_approved(approved: Column, notebook: Column, must_ask: Column) -> Column:
    return ~must_ask | F.array_contains(approved, notebook)
