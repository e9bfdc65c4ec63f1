"""WARC packages: round trip against brute force, and the ZIP format against the zipfile module."""

import base64
import gzip
import hashlib
import io
import zipfile

import pyarrow as pa

from ratecard.llm import warc_zip
from ratecard.llm.common import shared_path

ROWS = [(1, "http://a/\r\nX: y", "<p>é</p>", 1), (2, None, "<p>é</p>", 2), (3, "http://c", None, 3), (4, "u v", "", 4),
        (5, "http://e", "x\r\n\r\ny" * 5000, 5), (None, "http://f", "<p>é</p>", 6), (7, "http://g", "x\r\n\r\ny" * 5000, 7),
        (7, "http://g", "x\r\n\r\ny" * 5000, 7)]


def expected(rows, at_least=0):
    out = []
    for i, _, html, _ in rows:
        payload = (html or "").encode()
        same = [j for j, _, h, _ in rows if (h or "") == (html or "") and j is not None]
        owner = max(same) if i is not None and len(payload) >= at_least else None
        revisit = owner is not None and i < owner
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    "revisit" if revisit else "response", owner if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, payload int")
    for at_least in (0, 4):
        got = warc_zip.archive_round_trip(pages, at_least).drop("url").collect()
        assert sorted(map(tuple, got), key=str) == expected(ROWS, at_least)
    assert warc_zip.archive_round_trip(pages.limit(0)).count() == 0


def test_payloads_and_rolling(spark):
    pages = spark.createDataFrame([(i, "u", "".join(map(str, range(i, i + 300)))) for i in range(50)],
                                  "page_id long, url string, html string")
    packages = warc_zip.write_packages(pages, shared_path(spark, "t"), package_bytes=3000)
    assert packages.count() > 10
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc_zip.read_packages(packages, True).collect()}
    assert got == {i: h for i, _, h in map(tuple, pages.collect())}
    for r in packages.collect():
        with zipfile.ZipFile(r["path"].removeprefix("file:")) as z:
            assert z.testzip() is None and len(z.namelist()) == 2
            assert gzip.decompress(z.read(warc_zip.WARC_MEMBER)).count(b"WARC/1.1\r\n") == r["records"]


def test_foreign_directories():
    for names in (["a"], ["a", "b/c.txt"]):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for k in names:
                with z.open(zipfile.ZipInfo(k), "w", force_zip64=True) as f:
                    f.write(k.encode() * 9)
            z.comment = b"said"
        raw = buffer.getvalue()
        file = pa.BufferReader(raw)
        for k, (method, at, n) in warc_zip.central_directory(file, len(raw)).items():
            assert method == 0 and raw[at:at + n] == k.encode() * 9
