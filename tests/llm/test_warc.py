import hashlib

import pytest
from pyspark.sql import functions as F

from tracefold.llm.q_warc import SQL, op9_warc
from tracefold.llm.warc import Index, archive_round_trip, parse, record, reversed_host_key


def plain(rows, least=1000):
    best = {}
    for i, _, h in rows:
        h = h or ""
        if i is not None:
            best[h] = max(i, best.get(h, i))
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        kept = best.get(h or "")
        again = len(body) >= least and kept is not None and i != kept
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", kept if again else None))
    return sorted(out, key=str)


def test_against_plain_rule(spark, sf001):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf001}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, op9_warc(spark, sf001).collect()), key=str) == plain(rows)


def test_matches_sql(spark, sf001):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf001}/pages.parquet'")
    want = sorted(con.execute(SQL).fetchall(), key=str)
    assert sorted(map(tuple, op9_warc(spark, sf001).collect()), key=str) == want


def test_awkward_rows(spark):
    big, other = "<p>ä</p>" * 200, "x" * 1000
    rows = [(k, f"http://a.org/{k}", big) for k in range(20)] + [(20, None, None), (21, "no url", ""), (None, "http://b.org", big), (None, None, other), (None, "", other)]
    rows += [(30, "http://u:p@WWW.c.org:8080/x\r\ny?q#f", other[:-1]), (31, "http://c.org", other[:-1]), (2**62 + 1, "ftp://d", big + "!"), (2**62 + 3, "ftp://d", big + "!"), (40, "z", "z" * 500_000), (5, "http://a.org/5", big)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, key string, size int")
    for lines in (1, 512):
        got = archive_round_trip(pages, block_lines=lines).collect()
        assert sorted(map(tuple, got), key=str) == plain(rows)
    assert archive_round_trip(pages.where("false")).count() == 0


def test_record_and_damage():
    body = "grün".encode()
    digest = hashlib.sha1(body).hexdigest()
    member = record("http://a\n", 7, body, digest, None, False, "1970-01-01T00:00:00Z")
    assert parse(member) == {"page_id": 7, "payload_bytes": 5, "payload_digest": digest, "record_type": "response", "refers_to": None}
    with pytest.raises(ValueError):
        parse(record("u", 7, body, hashlib.sha1(b"else").hexdigest(), None, False, "d"))


def test_reversed_host_key(spark):
    urls = ["http://www.Example.org:80/a?b#c", "https://u@x.y", "nothing", None, ""]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(reversed_host_key(F.col("u"))).collect()]
    assert got == ["org,example,www:80)/a?b", "y,x)", "nothing", "", ""]


def test_index_finds_equal_keys_over_blocks(tmp_path):
    from tracefold.llm.warc import _put_block
    import json
    import zlib

    keys = [["a", 1, "d"]] * 3 + [["b", 1, "d"]] * 5 + [["c", 1, "d"]]
    upper, files = [], [keys[:4], keys[4:6], keys[6:]]
    for n, part in enumerate(files):
        directory, at = [], 0
        with open(tmp_path / f"{n}.idx", "wb") as out:
            for k in range(0, len(part), 2):
                at = _put_block(out, at, [[*x, "f", 0, 0] for x in part[k : k + 2]], directory)
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail + len(tail).to_bytes(8, "little"))
        upper.append((directory[0][0], f"{n}.idx"))
    index = Index(str(tmp_path), upper)
    assert [len(list(index.captures([k, 1, "d"]))) for k in "abcx"] == [3, 5, 1, 0]
