"""WARC archives: round trips, broken files, and the query's rows against a plain restatement."""

import base64
import hashlib
import io
import zlib
from collections import defaultdict

import pytest

from clausemill.llm import queries, warc


def plain(pages, least=0):
    groups = defaultdict(list)
    for page_id, html in pages:
        groups[(html or "").encode()].append(page_id)
    out = []
    for body, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        ids.sort(key=lambda i: (i is not None, i or 0))
        for n, i in enumerate(ids, 1):
            last = n == len(ids) or len(body) < least
            out.append((i, len(body), digest, "response" if last else "revisit", None if last else ids[-1]))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_plain(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert rows(queries.QUERIES["op11_warc"](spark, "/root/testdata/sf0.001")) == plain([(r.page_id, r.html) for r in pages.collect()])


def test_odd_pages(spark, tmp_path):
    long = "é<p>" * 900_000
    pages = [(1, "http://a/", "x"), (2, None, "x"), (3, "http://a/ b\r\nc", ""), (4, "u", None), (None, "u", "x"), (5, "u", long), (6, "u", long),
             (6, "u", long), (7, "http://ü/", "\r\n\r\nWARC/1.1\r\n"), (None, None, None)]
    df = spark.createDataFrame([(*p, "kept out") for p in pages], "page_id long, url string, html string, digest string")
    want = [(p, h) for p, _, h in pages]
    assert rows(warc.archive(df, str(tmp_path / "a"))) == plain(want)
    assert rows(warc.archive(df, str(tmp_path / "b"), least_bytes=2)) == plain(want, 2)
    assert rows(warc.archive(df.limit(0), str(tmp_path / "c"))) == []


def test_every_member_stands_alone(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i}", f"page {i % 7} " * i) for i in range(60)], "page_id long, url string, html string")
    assert warc.archive(df, str(tmp_path)).count() == 60
    seen = 0
    for index in (tmp_path / "archive").glob("*.idx"):
        data = index.with_suffix(".warc.gz").read_bytes()
        end = 0
        for line in index.read_text().splitlines():
            offset, length, kind, record, _ = line.split("\t")
            assert int(offset) == end
            end += int(length)
            member = zlib.decompressobj(31)
            text = member.decompress(data[int(offset) : end])
            assert member.eof and not member.unused_data and text.startswith(b"WARC/1.1\r\nWARC-") or text.startswith(b"WARC/1.1\r\nwarc-")
            assert f"{kind}\r\n".encode() in text and record.encode() in text
            seen += kind != "warcinfo"
        assert end == len(data)
    assert seen == 60
    assert not list(tmp_path.rglob(".*-*"))  # no unfinished files


def monolith(bodies):
    out = b"".join(warc.header({"WARC-Type": "resource", "WARC-Record-ID": f"<urn:x:{i}>", "Content-Length": len(b)}) + b + b"\r\n\r\n" for i, b in enumerate(bodies))
    return out


@pytest.mark.parametrize("cut", [1, 7, 1000, 1 << 20])
def test_normaliser_keeps_records(tmp_path, cut):
    bodies = [b"", b"a", b"\r\n\r\n" * 3, bytes(range(256)) * 9000, b"\0" * 3_000_000]
    whole = monolith(bodies)
    zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
    once = zipped.compress(whole) + zipped.flush()
    source = io.BytesIO(once)
    members = warc.Members(str(tmp_path), f"n{cut}")
    warc.normalise(lambda n: source.read(min(n, cut)), members)
    again = (tmp_path / f"n{cut}.warc.gz").read_bytes()
    back = io.BytesIO(again + b"\0\0")
    assert [b"".join(block) for _, _, block in warc.records(back.read)] == bodies
    inflated, rest = b"", again
    while rest:
        z = zlib.decompressobj(31)
        inflated += z.decompress(rest)
        rest = z.unused_data
    assert inflated == whole
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(once[:-20]).read))
