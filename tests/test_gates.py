"""Gates over all combinations, rules by origin, queries over a store, the event log and traces."""

import itertools
import math
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import gates
from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.operators import retrieval as R
from tessera.operators.events import EventLog, StreamEvents
from tessera.operators.store import Store
from tessera.plans import stored_queries
from tessera.sources import robots


def plain(flags):
    if not flags["registered"]:
        return "unknown provider"
    if not flags["is_local"]:
        if flags["local_only"]:
            return "local only"
        if not flags["online"]:
            return "offline"
        if not flags["configured"]:
            return "not configured"
        if not flags["consent"]:
            return "no consent"
    elif not flags["configured"]:
        return "no model"
    return "ready" if flags["reachable"] else "unreachable"


def test_gates_over_all_combinations(spark):
    rows = list(itertools.product((False, True), repeat=len(gates.FLAGS)))
    df = spark.createDataFrame(rows, ", ".join(f"{n} boolean" for n in gates.FLAGS))
    got = df.select("*", gates.decision({n: F.col(n) for n in gates.FLAGS}).alias("d")).collect()
    assert len(got) == 128
    for r in got:
        assert r.d.state == plain(r.asDict()) and (r.d.reason is None) == (r.d.state == "ready")
    by = {r.d.state: r.d for r in got}
    assert "internet connection" in by["offline"].reason and "local sources" in by["offline"].recovery.lower() and "Local-Only Mode" in by["local only"].recovery


def test_an_unknown_flag_stands_in_no_way(spark):
    df = spark.createDataFrame([(None, True)], "consent boolean, is_local boolean")
    assert df.select(gates.decision({"is_local": F.col("is_local"), "consent": F.col("consent")})["state"]).first()[0] == "ready"


def test_two_ports_of_one_host_have_their_own_rules(spark):
    files = spark.createDataFrame([("http://h", 200, "User-agent: *\nDisallow: /a"), ("http://h:8080", 200, "User-agent: x\nDisallow: /\nUser-agent: tessera\nDisallow: /b$\nAllow: /b/ok"), ("http://gone", 404, "User-agent: *\nDisallow: /")], "origin string, status int, text string")
    urls = ["http://H/a/1", "http://h:8080/a/1", "http://h:8080/b", "http://u:p@h:8080/b?x", "http://h:8080/b/ok", "http://gone/a", "https://h/a", "http://h"]
    pages = spark.createDataFrame(list(enumerate(urls)), "id long, url string").select("id", robots.origin(F.col("url")).alias("origin"), robots.path_of(F.col("url")).alias("path"))
    got = {r.id: r.allowed for r in robots.decide(pages, robots.rule_rows(files)).collect()}
    assert got == {0: False, 1: True, 2: False, 3: False, 4: True, 5: True, 6: True, 7: True}
    assert [r[0] for r in spark.createDataFrame([("HTTP://Ex.Org:81/x",), ("nothing",), ("http://[::1]:8/x",)], "u string").select(robots.origin(F.col("u"))).collect()] == ["http://ex.org:81", None, "http://[::1]:8"]


def test_rules_as_rows_are_those_of_the_parser(spark):
    text = "# c\nUser-agent: a\r\nDisallow: /x.y*z$\nUser-Agent: *\nAllow: /q?(r) # why\nDisallow:\nnonsense\nDisallow: /\\E[1]"
    rows = robots.rule_rows(spark.createDataFrame([("o", 200, text)], "origin string, status int, text string")).collect()
    assert sorted((r.rule, r.allow) for r in rows) == sorted(robots.parse(text))
    paths = ["/q?(r)", "/q?(r)/more", "/q", "/\\E[1]", "/\\E1"]
    for p in paths:
        df = spark.createDataFrame([(p,)], "path string")
        for r in rows:
            import re

            assert df.select(F.expr(f"rlike(path, r'{r.regex}')")).first()[0] == bool(re.search(robots.pattern(r.rule), p)), (p, r.rule)


def test_sql_over_a_store_is_queries_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "lib"))
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, v long")
    store.write("t", rows, "id")
    store.upsert("t", spark.createDataFrame([("a", 10)], "id string, v long"))
    assert sorted(map(tuple, store.sql("SELECT id FROM t WHERE v >= :least", {"least": 3}).collect())) == [("a",), ("c",)]
    assert store.sql("SELECT sum(v) AS s FROM t WHERE id <> ?", ["b"]).first().s == 13
    assert store.sql("WITH x AS (SELECT v FROM t) SELECT max(v) AS m FROM x -- why").first().m == 10
    before = spark.catalog.listTables()
    for bad in ("DROP TABLE t", "CREATE TABLE u AS SELECT 1", "SET x = 1", "INSERT INTO t VALUES ('d', 4)", "SELECT 1; SELECT 2", ""):
        with pytest.raises(ValueError, match="not a query"):
            store.sql(bad)
    assert spark.catalog.listTables() == before and store.read("t").count() == 3


def test_the_log_writes_filters_and_rotates(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"), "info")
    log.write(("error", "ingest", "a failure worth recording"), ("info", "chat", "something informational"), ("debug", "chat", "noise"))
    lines = log.lines()
    assert len(lines) == 2 and "[ERROR] ingest: a failure worth recording" in lines[0] and "something informational" in lines[1]
    EventLog(spark, log.path, "debug").write(("debug", "chat", "now it is recorded"))
    assert log.lines(1)[0].endswith("now it is recorded") and len(log.lines()) == 3
    EventLog(spark, log.path, "off").write(("error", "x", "never"))
    assert len(log.lines()) == 3 and log.rotate() == 0
    log.max_bytes = 1
    assert log.rotate() == 1 and [x.split(": ")[1] for x in log.lines()] == ["now it is recorded"]


def test_streams_tell_the_log(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"), "debug")
    heard = StreamEvents(log)
    spark.streams.addListener(heard)
    try:
        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "a.txt").write_text("x\ny\n")
        stream = spark.readStream.text(str(tmp_path / "in")).writeStream.queryName("told").foreachBatch(lambda df, n: None).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        stream.awaitTermination()
        for _ in range(50):
            if (tmp_path / "log").exists() and any("ended" in x for x in log.lines()):
                break
            import time

            time.sleep(0.2)
    finally:
        spark.streams.removeListener(heard)
    assert any("told started" in x for x in log.lines()) and any("ended" in x for x in log.lines())


def test_a_trace_says_where_nothing_matched(spark):
    chunks = spark.createDataFrame([("c1", "s1", "Permits were delayed by the office.", "H", 20), ("c2", "s2", "Museum funding rose.", None, 20)], "chunk_id string, source_id string, text string, heading string, token_count long")
    t = R.trace(R.search(chunks, None, "permits delayed", settings=R.Settings(floor=0.0)), chunks).collect()
    assert [(r.chunk_id, r.preview, r.heading, r.in_context, r.candidates, r.notes) for r in t] == [("c1", "Permits were delayed by the office.", "H", True, 1, "")] and t[0].tokens_used == 44
    t = R.trace(R.search(chunks, None, "zzqq"), chunks).collect()
    assert [(r.chunk_id, r.candidates, r.tokens_used, r.notes) for r in t] == [(None, 0, 0, R.NOTHING_MATCHED)]


def test_a_query_over_the_store_makes_no_index(spark, sf):
    """the query reads passages alone; the index comes with the first question."""
    store = stored_queries.library(spark, sf, "sql only", index=False)
    assert store.has("chunks") and store.has("postings") and not store.has("posting_blocks")
    assert stored_queries.library(spark, sf, "sql only") is store and store.has("posting_blocks")


def test_token_estimates_of_every_script(spark):
    texts = ["", "abc", "äöü ß", "ᄀa", "漢字 kana かな", "😀 ab", "ჿ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = lambda t: None if t is None else 0 if not t else (cjk := len(re.findall(L.CJK_CLASS, t))) + math.ceil((len(t) - cjk) / 4) + 1
    assert [r[0] for r in rows.select(T.token_estimate(F.col("t"))).collect()] == list(map(plain, texts))
