import duckdb
import pytest

from tessera.llm import warc as W


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = sorted(con.execute(W.OP4_SQL).fetchall(), key=str)
    got = sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in W.op4_warc(spark, sf).collect()), key=str)
    assert got == want


def test_odd_rows(spark):
    rows = [(1, "http://a/", None), (2, None, ""), (3, "http://b/\nx", "same"), (9, "u", "same"), (5, "", "same"), (7, "http://c", "é" * 300_000), (9, "u", "same"), (None, "n", "same"), (None, "n", "alone"), (10, "http://[bad", "Content-Length: 7\r\n\r\n\r\n")]
    df = spark.createDataFrame([(*r, "k", "c") for r in rows], "page_id long, url string, html string, sha string, content string")
    got = W.read_packages(W.write_packages(df, package_bytes=200)).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in got) == sorted(
        [(1, 0, "revisit", 2), (2, 0, "response", 0), (3, 4, "revisit", 9), (5, 4, "revisit", 9), (9, 4, "response", 0), (9, 4, "response", 0), (0, 4, "revisit", 9), (0, 5, "response", 0), (7, 600_000, "response", 0), (10, 23 - 0, "response", 0)]
    )
    assert W.write_packages(df.where("false")).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_ranges(zip64):
    p = W.Package()
    for i in range(50):
        p.add(i, f"http://host{i % 3}.example.com/{i}?q=1", b"<p>%d</p>" % i * 100, None, False)
    content, read = p.close(zip64), []

    def take(at, n):
        read.append(n)
        return content[at : at + n]

    a = W.Archive(take, len(content))
    assert set(a.members) == {W.RECORDS, W.INDEX, "datapackage.json"}
    keys = [x["id"] for x in a.index()]
    assert sorted(keys) == list(range(50)) and keys != list(range(50))
    read.clear()
    fields, block = next(a.records())
    assert sum(read) < len(content) and W.read_record(fields, block)["payload"].startswith(b"<p>")


def test_a_true_zip64_directory():
    """More members than the old directory can count."""
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(66_000):
            z.writestr(f"m{i}", b"")
    raw = out.getvalue()
    a = W.Archive(lambda at, n: raw[at : at + n], len(raw))
    assert len(a.members) == 66_000 and a.begin("m65999") > 0


def test_damage_is_noticed():
    p = W.Package()
    p.add(1, "u", b"payload " * 50, None, False)
    raw = p.close()
    with pytest.raises(ValueError):
        W.Archive(lambda at, n: raw[:50][at : at + n], 50)
    fields, block = next(W.Archive(lambda at, n: raw[at : at + n], len(raw)).records())
    with pytest.raises(ValueError):
        W.read_record(fields, block.replace(b"payload", b"PAYLOAD"))
