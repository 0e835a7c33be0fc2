"""robots.txt: rules as rows, decisions as a join."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse(text: str, agent: str = "tessera") -> list[tuple[str, bool]]:
    """(path pattern, allowed) of the groups for every agent or ours; the last agent line of a run decides."""
    out, applies = [], False
    for line in text.splitlines():
        key, colon, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            applies = value == "*" or agent in value.lower()
        elif key in ("allow", "disallow") and applies and value:
            out.append((value, key == "allow"))
    return out


def pattern(rule: str) -> str:
    """A rule's path as an anchored regular expression: * is anything, a closing $ the end."""
    body, end = (rule[:-1], "$") if rule.endswith("$") else (rule, "")
    return "^" + ".*".join(map(re.escape, body.split("*"))) + end


def origin(url: Column) -> Column:
    """Scheme, host and port of an address, or null: where its robots.txt lies."""
    found = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)(:[0-9]+)?", 0)
    parts = F.regexp_replace(F.lower(found), "//[^/?#@]*@", "//")
    return F.nullif(parts, F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


#: Characters of a robots.txt that are read.
MOST_TEXT = 512_000


def rule_rows(files: DataFrame, agent: str = "tessera") -> DataFrame:
    """(origin, rule, allow, regex) of fetched files (origin, status, text): a table that decisions of all pages share.

    A file that wasn't there allows everything. The last agent line before a rule says whom it is for."""
    fine = files.where(F.col("status").between(200, 299)).select("origin", F.posexplode(F.split(F.left("text", F.lit(MOST_TEXT)), "\r\n|\r|\n")).alias("at", "line"))
    body = F.regexp_replace("line", "#.*$", "")
    pair = fine.where(body.contains(":")).select("origin", "at", F.lower(F.trim(F.substring_index(body, ":", 1))).alias("key"), F.trim(F.regexp_replace(body, "^[^:]*:", "")).alias("value"))
    mine = F.when(F.col("key") == "user-agent", (F.col("value") == "*") | F.lower("value").contains(agent))
    # A file is one row of bounded length, so its lines are few.
    applies = F.last(mine, ignorenulls=True).over(Window.partitionBy("origin").orderBy("at"))
    rules = pair.withColumn("applies", applies).where("applies and key in ('allow', 'disallow') and value <> ''")
    ends, stem = F.col("value").endswith("$"), F.regexp_replace("value", "\\$$", "")
    quoted = F.array_join(F.transform(F.split(stem, "\\*"), lambda x: F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), ".*")
    return rules.select("origin", F.col("value").alias("rule"), (F.col("key") == "allow").alias("allow"), F.concat(F.lit("^"), quoted, F.when(ends, F.lit("$")).otherwise("")).alias("regex"))


def decide(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, allowed, rule) for (id, origin, path) under (origin, rule, allow, regex).

    The longest matching rule wins, Allow where two are as long. The join is on
    the origin; the best rule is a partial maximum, so no origin's rows meet in
    one task before they are reduced."""
    path = F.when(F.coalesce("path", F.lit("")) == "", F.lit("/")).otherwise(F.col("path"))
    hit = paths.withColumn("path", path).join(rules, "origin").where(F.expr("rlike(path, regex)"))
    best = hit.groupBy("id").agg(F.max(F.struct(F.length("rule").alias("n"), "allow", "rule")).alias("best"))
    return paths.select("id").join(best, "id", "left").select("id", F.coalesce("best.allow", F.lit(True)).alias("allowed"), "best.rule")
