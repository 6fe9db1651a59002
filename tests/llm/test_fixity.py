import hashlib

from tracewell.llm import fixity


def test_finds_every_difference(spark):
    rows = [(i // 40, (i % 40) * 100, 100, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(200)]
    ddl = "archive long, offset long, length long, digest string"
    other = [r for i, r in enumerate(rows) if i not in (5, 77)]
    other = [(a, o, n, "bad" if (a, o) in ((0, 900), (3, 3900)) else d) for a, o, n, d in other] + [(4, 4050, 10, "new"), (9, 0, 1, "archive")]
    sizes = {"archive_bytes": 8000, "leaf_bytes": 500, "fanout": 2}
    got = fixity.differing_records(spark.createDataFrame(rows, ddl), spark.createDataFrame(other, ddl), **sizes)
    assert sorted(map(tuple, got.collect())) == [(0, 500, "missing"), (0, 900, "corrupt"), (1, 3700, "missing"), (3, 3900, "corrupt"), (4, 4050, "extra"), (9, 0, "extra")]
    same = spark.createDataFrame(rows, ddl)
    assert fixity.differing_records(same, same, **sizes).count() == 0
    tops = [fixity.tree(spark.createDataFrame(x, ddl), **sizes)[-1].where("archive = 2").first() for x in (rows, other)]
    assert tops[0] == tops[1] and tops[0].node == 0


def test_pages_with_odd_rows(spark):
    rows = [(i, f"http://x/{i}", "é" * (i * 50), "k") for i in range(120)] + [(7, None, None, "k"), (None, "u", "h", "k"), (48, "http://x/48", "é" * 2400, "k"), (11, "", "", "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = fixity.audit_of_pages(df).collect()
    assert len(got) == len(rows)
    want = lambda i: "ok" if i is None else "missing" if i % 53 == 11 else "corrupt" if i % 41 == 7 else "ok"
    assert all(r.status == want(r.page_id) for r in got)
    ordered = sorted((r.archive, r.offset, r.length) for r in got)
    at = 0
    for a, o, n in ordered:
        assert a * fixity.ARCHIVE_BYTES + o == at
        at += n
    assert fixity.audit_of_pages(df.limit(0)).count() == 0


def test_clashing_columns(spark):
    rows = [(i, 10, f"d{i}", "mine", 7, "s") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, length long, digest string, status string, archive int, __at0 string")
    placed = fixity.manifest(df, ["page_id"], 64)
    assert sorted((r["archive"], r["offset"], r["__at0"]) for r in placed.collect()) == [(i * 10 // 64, i * 10 % 64, "s") for i in range(20)]
    got = fixity.audited(placed, placed.where("page_id <> 3"), archive_bytes=64, leaf_bytes=16, fanout=2).collect()
    assert sorted((r.page_id, r.status) for r in got) == [(i, "missing" if i == 3 else "ok") for i in range(20)]


def test_records_have_what_every_record_must(spark):
    from pyspark.sql import functions as F

    x = spark.createDataFrame([("http://a/", "hé")], "url string, html string").select(fixity.record(F.col("url"), F.col("html"), fixity.record_id(F.col("url"), F.col("html")))).first()[0]
    head, body = x.split("\r\n\r\n")[:2]
    fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
    m = hashlib.md5("http://a/\nhé".encode()).hexdigest()
    assert fields == {"WARC-Type": "response", "WARC-Record-ID": f"<urn:uuid:{m[:8]}-{m[8:12]}-{m[12:16]}-{m[16:20]}-{m[20:]}>", "WARC-Date": fixity.DATE, "WARC-Target-URI": "http://a/", "Content-Length": "3"}
    assert body == "hé"
