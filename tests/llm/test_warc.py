import base64
import gzip
import hashlib
from collections import Counter

from gavelspark.llm import warc
from gavelspark.llm.queries import ALL, ORACLE_SQL
from tests.compare import connect, differences

PAGES = "page_id long, url string, html string, payload string, digest int, first long"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def pages(spark):
    texts = [None, "", "", "a", "é" * 9001, "x\r\n\r\nWARC/1.1\r\n" * 3000, "日本" * 40000, "é" * 9001, "plain", "0\r\n\r\n", "y" * 8192, "\U0001f600" * 2049]
    rows = [(k, None if k == 3 else f"http://a.com/{k}\r\n x", t, "other", 1, 2) for k, t in enumerate(texts)]
    rows += [(8, "http://b", "plain", "", 0, 0), (8, "http://b", "plain", "", 0, 0), (None, "u", "plain", "", 0, 0), (None, "u", "no id", "", 0, 0), (10, "u", "y" * 8192, "", 0, 0)]
    return rows, spark.createDataFrame(rows, PAGES)


def expected(rows, least=0):
    out = Counter()
    for page, _, text, *_ in rows:
        data = (text or "").encode()
        same = [p for p, _, t, *_ in rows if (t or "") == (text or "") and p is not None]
        first = min(same, default=None)
        again = len(data) >= least and first is not None and page != first
        out[page, len(data), digest(data), "revisit" if again else "response", first if again else None] += 1
    return out


def test_query_matches_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert differences(spark, connect(folder), folder, ALL["op9_warc"], ORACLE_SQL["op9_warc"]) == []


def test_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    for least, gzipped in ((0, False), (10, True)):
        folder = str(tmp_path / f"w{least}")
        warc.write(df.repartition(3), folder, least, gzipped)
        found = warc.read(spark, folder).collect()
        assert all(r.complete for r in found)
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == expected(rows, least)
        have = {(r.page_id, bytes(r.payload)) for r in found if r.record_type == "response"}
        assert have == {(p, (t or "").encode()) for p, _, t, *_ in rows if (p, len((t or "").encode()), digest((t or "").encode()), "response", None) in expected(rows, least)}
        assert all(r.payload is None for r in found if r.record_type == "revisit")
    warc.write(df.where("false"), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_segments_in_any_order_and_damage(spark, tmp_path):
    made = warc.records(7, 1, "http://a", "long text " * 4000, "D", None)
    assert len(made) > 4
    data = [r.encode() + b"\r\n\r\n" for r in made]
    good = digest(("long text " * 4000).encode())

    def read(name, blobs):
        folder = tmp_path / name
        folder.mkdir()
        for k, blob in enumerate(blobs):
            (folder / f"{k}.warc").write_bytes(blob)
        return warc.read(spark, str(folder)).collect()

    (row,) = read("mixed", [data[3] + data[0], *data[4:], gzip.compress(data[2]) + gzip.compress(data[1])])
    assert (row.payload_digest, row.payload_bytes, row.complete) == (good, 40000, False)  # the digest field is not the payload's
    fixed = [d.replace(b"sha1:D", f"sha1:{good}".encode()) for d in data]
    assert read("fine", fixed[::-1])[0].complete
    assert not read("gap", [fixed[0], fixed[2], *fixed[3:]])[0].complete
    assert not read("end", fixed[:-1])[0].complete
    assert read("foreign", [b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"]) == []


def test_framing():
    for size in (0, 1, 2047, 2048, 2049, 10000):
        data = ("é" * size).encode()
        assert warc.unchunked(warc.chunked(data)) == data
    assert warc.unchunked(b"5;a=b\r\nhello\r\n0\r\nT: x\r\n\r\n") == b"hello"
    assert warc.unchunked(b"5\r\nhel") is None and warc.unchunked(b"") is None and warc.unchunked(b"zz\r\n") is None
    try:
        list(warc.parse(b"nonsense"))
    except ValueError as e:
        assert "byte 0" in str(e)
