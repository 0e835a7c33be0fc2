"""Names, sizes and states as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import let


def parameter_size(name: Column) -> Column:
    """The first number with b or m in a model's name, as in 120B."""
    found = lambda i: F.regexp_extract(name, "(?i)(\\d+(?:\\.\\d+)?)\\s*([bm])\\b", i)
    return F.nullif(F.concat(found(1), F.upper(found(2))), F.lit(""))


def context_window(size: Column) -> Column:
    """Tokens that a model of a size holds, 8,192 where it isn't known."""
    n = F.regexp_replace(F.lower(size), "[bm ]", "").try_cast("double")
    return let(n, lambda x: F.when(x <= 4, 8_192).when(x <= 9, 32_768).when(x <= 200, 131_072).when(x.isNotNull(), 262_144).otherwise(8_192))


def is_embedding_model(name: Column) -> Column:
    low = F.lower(name)
    return low.contains("embed") | low.contains("bge") | low.contains("minilm") | low.contains("nomic")


def budget_for(window: Column) -> Column:
    """(tokens, results) of a retrieval for a context window."""
    pair = lambda tokens, results: F.struct(F.lit(tokens).alias("tokens"), F.lit(results).alias("results"))
    return F.when(window < 6_000, pair(2_000, 5)).when(window < 16_000, pair(4_000, 8)).when(window < 64_000, pair(10_000, 12)).otherwise(pair(24_000, 18))


def failure_of(status: Column) -> Column:
    """The class of failure that an HTTP status tells, null for success."""
    return (
        F.when(status.between(200, 299), F.lit(None).cast("string"))
        .when(status.isin(401, 403), "invalid key")
        .when(status == 413, "context too large")
        .when(status == 429, "rate limited")
        .when(status.between(500, 599), "unavailable")
        .otherwise("rejected")
    )


def failure_message(body: Column) -> Column:
    """A provider's own words, wherever its JSON keeps them, or the first 400 characters."""
    from_json = F.coalesce(*[F.get_json_object(body, p) for p in ("$.error.message", "$.error.type", "$.error", "$.message")])
    return F.coalesce(from_json, F.left(F.trim(body), F.lit(400)))


def byte_size(n: Column) -> Column:
    """Bytes as people read them, none for less than none."""
    n = F.greatest(n, F.lit(0))
    unit = lambda size, name: F.concat(F.format_number(n / F.lit(float(size)), 1), F.lit(f" {name}"))
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit(" bytes"))).when(n < 10**6, unit(10**3, "kB")).when(n < 10**9, unit(10**6, "MB")).otherwise(unit(10**9, "GB"))


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(" "), F.when(n == 1, one).otherwise(many or f"{one}s"))


def token_count(n: Column) -> Column:
    """Digits in groups of three, a dash where it isn't known."""
    return F.coalesce(F.format_number(n, 0), F.lit("—"))


def duration(ms: Column) -> Column:
    """Milliseconds under a second, else seconds to a tenth (halves up), a dash where it isn't known."""
    seconds = F.concat(F.round(ms / F.lit(1000.0), 1).cast("decimal(20,1)").cast("string"), F.lit(" s"))
    return F.coalesce(F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).otherwise(seconds), F.lit("—"))


def percent(share: Column) -> Column:
    """A share in whole percents, halves to the even one."""
    return F.concat(F.bround(share * 100).cast("long").cast("string"), F.lit("%"))


def follow_ups(short_of_sources: Column, local: Column, cited: Column, truncated: Column) -> Column:
    """Up to three suggestions after an answer."""
    some = F.array_compact(
        F.array(
            F.when(short_of_sources, F.lit("What do my sources cover?")),
            F.when(short_of_sources & local, F.lit("Add a website source")),
            F.when(~short_of_sources & (cited > 0), F.lit("Summarise the sources behind that answer")),
            F.when(~short_of_sources & (cited > 0), F.lit("What do the sources disagree about?")),
            F.when(truncated, F.lit("Continue that answer in more detail")),
        )
    )
    return F.slice(F.when(F.size(some) == 0, F.array(F.lit("What are the key points across my sources?"))).otherwise(some), 1, 3)
