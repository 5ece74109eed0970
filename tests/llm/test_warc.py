import base64
import gzip
import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from murkwater.llm import warc

SCHEMA = "page_id long, url string, html string"


def brute(rows, least=0):
    groups = {}
    for i, (page, _, html) in enumerate(rows):
        groups.setdefault(html or "", []).append((page is not None, page or 0, i))
    out = []
    for i, (page, url, html) in enumerate(rows):
        data = (html or "").encode()
        best = max(groups[html or ""])
        revisit = len(data) >= least and i != best[2] and len(groups[html or ""]) > 1
        first = rows[best[2]][0]
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def result(df, least=0):
    return sorted((tuple(r) for r in warc.round_trip(df, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def odd_pages():
    rows = [(1, "http://a.b/c", "x"), (2, None, "x"), (2, "http://a.b/d", "x"), (None, "u", "x"), (3, "a b\r\nWARC-Type: none", ""), (4, "", None), (None, None, None), (None, "v", "lone")]
    rows += [(5, "http://ö.de/", "ü\r\n\r\nWARC/1.1\r\n\r\n" * 3), (6, "http://long", "long \U0001f600 " * 400_000)]
    return rows + [(100 + i, f"http://h/{i}", f"page {i % 300}") for i in range(900)]


def test_round_trip_of_odd_pages(spark):
    rows = odd_pages()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as payload_bytes", "'x' as archive", "2 as revisit", "3 as _m", "4 as sha1")
    assert result(df) == brute(rows)
    assert result(df, least=7) == brute(rows, 7)
    assert result(df.limit(0)) == []


def test_payloads_come_back(spark):
    rows = odd_pages()
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA), with_payload=True).collect()
    texts = {}
    for page, _, html in rows:
        texts.setdefault(page, set()).add((html or "").encode())
    assert all(r.payload in texts[r.page_id] for r in got if r.record_type == "response")
    assert all(r.payload is None for r in got if r.record_type == "revisit")
    assert {r.url for r in got if r.page_id == 3} == {"a%20b%0D%0AWARC-Type:%20none"}


def test_tables(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [tuple(r) for r in df.select("page_id", "url", "html").collect()]
    twice = df.select("page_id", "url", "html").union(df.selectExpr("page_id + 1000000", "url", "html"))
    assert result(df) == brute(rows)
    assert result(twice) == brute(rows + [(p + 1_000_000, u, h) for p, u, h in rows])


def written(tmp_path, records):
    archive = warc.Archive(f"file://{tmp_path}")
    for r in records:
        archive.add(r)
    return f"{tmp_path}/{archive.close()}"


@pytest.mark.parametrize("zip64", [False, True])
def test_ranges_without_extraction(tmp_path, monkeypatch, zip64):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 3000)  # of compressed records
    if zip64:  # so that the writer uses the wide fields from the first byte on
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    records = [warc.record(i, f"http://x/{i}", b"body %d" % i * (i % 40), warc.base32_sha1(b"body %d" % i * (i % 40)), len(b"body %d" % i * (i % 40)), None) for i in range(200)]
    path = written(tmp_path, records)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        want = [(m.filename, m.compress_type, m.file_size, m.header_offset) for m in z.infolist()]
    with pa.OSFile(path) as source:
        members = warc.directory(source)
        assert [(m.name, m.method, m.size, m.header) for m in members] == want
        assert len(members) > 5
        found = [gzip.decompress(warc._range(source, start, length)) for start, length in warc.listed(source)]
    assert found == records
    assert [warc.parsed(x)["page_id"] for x in found] == list(range(200))
    if zip64:
        assert warc.END64 in open(path, "rb").read()


def test_a_comment_that_looks_like_an_end(tmp_path):
    path = written(tmp_path, [warc.record(1, None, b"", warc.base32_sha1(b""), 0, None)])
    with zipfile.ZipFile(path, "a") as z:
        z.comment = b"about " + warc.END + b" records " * 20
    with pa.OSFile(path) as source:
        assert [m.name for m in warc.directory(source)] == ["archive/data-00000.warc.gz", warc.INDEX]


def test_damage_is_noticed(tmp_path):
    good = warc.record(1, "u", b"payload", warc.base32_sha1(b"payload"), 7, None)
    assert warc.parsed(good)["payload"] == b"payload"
    for bad in (good[:-1], good.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"), b"x" + good):
        with pytest.raises(ValueError, match="WARC"):
            warc.parsed(bad)
    squeezed = io.BytesIO()
    with zipfile.ZipFile(squeezed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc", b"x" * 1000)
    source = pa.BufferReader(squeezed.getvalue())
    with pytest.raises(ValueError, match="compressed"):
        warc.data_start(source, warc.directory(source)[0])
    with pytest.raises(ValueError, match="no ZIP"):
        warc.directory(pa.BufferReader(b"nothing"))
