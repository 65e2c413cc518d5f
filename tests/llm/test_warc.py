"""Operator 12: records, framing and segments, there and back, and what damage reads as."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random

import pytest

from tidecast.llm import queries, warc
from tidecast.llm.common import Scratch

PIECES = ["\r\n", "\r", "\n", "a", "é", "WARC/1.1\r\n", "0\r\n\r\n", "\r\n\r\n", "\U0001f600", "Content-Length: 5"]
SCHEMA = "page_id long, url string, html string, digest string, turn int, first_key long"


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain(rows, least=0):
    by, out = {}, []
    for key, _, html in rows:
        by.setdefault((html or "").encode(), []).append(key)
    for payload, keys in by.items():
        first = min((k for k in keys if k is not None), default=None)
        for i, k in enumerate(sorted(keys, key=lambda k: (k is None, k))):
            again = i > 0 and len(payload) >= least
            out.append((k, len(payload), digest(payload), "revisit" if again else "response", first if again else None, None))
    return sorted(out, key=str)


def page_rows():
    rng = random.Random(1)
    rows = [(i, f"http://x/{i}\r\né", "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 5, 300, 3000])))) for i in range(150)]
    rows += [(1000 + i, None, rows[i % 30][2]) for i in range(60)] + [(2000 + i, "http://hot/", "the same page") for i in range(100)]
    rows += [(5, "u", None), (5, "u", None), (None, None, "x y z"), (None, None, "x y z"), (None, "u", "x y z"), (7, "other", rows[7][2]), (8, "long", "ab\r\n" * 200_000)]
    return rows


@pytest.mark.parametrize(("least", "segment"), [(0, 1000), (20, 1 << 20), (0, 100)])
def test_pages_come_back_as_they_were(spark, least, segment):
    rows = page_rows()
    frame = spark.createDataFrame([(*r, "d", 7, 9) for r in rows], SCHEMA).repartition(5)
    got = sorted(map(tuple, warc.round_trip(frame, least=least, segment=segment).collect()), key=str)
    assert got == plain(rows, least)
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_payloads_and_urls_come_back_from_standard_archives(spark):
    rows, scratch = page_rows()[:40], Scratch(spark, "warc")
    warc.write(spark.createDataFrame([(*r, "d", 7, 9) for r in rows], SCHEMA), f"{scratch.root}/a", segment=500)
    back = {r.key: r for r in warc.records(warc.segments(spark, f"{scratch.root}/a"), payload=True).collect()}
    for key, url, html in rows:
        if back[str(key)].type == "response":
            assert bytes(back[str(key)].payload) == html.encode()
        assert back[str(key)].url == url.replace("\r\n", "%0D%0A").replace("é", "%C3%A9") and back[str(key)].problem is None


def test_chunks_of_other_writers_are_decoded():
    payload = bytes(range(256)) * 20
    body = b"A;name=value\r\n" + payload[:10] + b"\r\n" + b"%X\r\n" % (len(payload) - 10) + payload[10:] + b"\r\n000\r\nTrailer: x\r\n\r\n"
    for step in (1, 3, 64, 10_000):
        out, message = warc.Payload(keep=True), b"HTTP/1.1 200 OK\r\ntransfer-encoding:  Chunked\r\n\r\n" + body
        for i in range(0, len(message), step):
            out.feed(message[i : i + step])
        assert out.close() is None and bytes(out.body) == payload and out.n == len(payload)
    plain_ = warc.Payload(keep=True)
    plain_.feed(b"HTTP/1.0 200 OK\r\n\r\n" + payload)
    assert plain_.close() is None and bytes(plain_.body) == payload
    for bad in (b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"3\r\nabc\r\n0\r\n\r\nmore", b"3\r\nab"):
        broken = warc.Payload()
        broken.feed(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + bad)
        assert broken.close() is not None


def test_damage_is_named_and_ends_with_its_record(spark, tmp_path):
    """A lost segment, a wrong total, another payload, garbage, a cut file, a dangling revisit, and an archive that is there twice."""
    records = lambda key, html, **kw: list(warc.page_records(key, "u", html, kw.pop("stated", digest(html)), 0, kw.pop("first", None), 200))
    lost, total, other = records("1", b"x" * 2000), records("2", b"y" * 2000), records("3", b"z" * 2000, stated="A" * 32)
    total[-1] = total[-1].replace(b"Total-Length: 2", b"Total-Length: 9")
    good, loose, cut = records("4", b"fine" * 500), records("5", b"", first=("99", "u")), records("6", b"cut short")
    shuffled = [*lost[:1], *lost[2:], *total, b"no record at all", *other, *good, *loose]
    random.Random(2).shuffle(shuffled)
    for name in ("a", "b"):  # the same records twice
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(b"".join(r + warc.BREAK for r in shuffled)))
    (tmp_path / "c.gz").write_bytes(gzip.compress(cut[0][:-5]))
    got = {}
    for r in warc.read(spark, str(tmp_path)).collect():
        got.setdefault(r.key, set()).add((r.record_type, r.problem))
    assert got["1"] == {("response", "segment 2 is missing")} and got["3"] == {("response", "payload differs from its digest")} and got["4"] == {("response", None)}
    assert {p[:12] for _, p in got["2"]} == {"total length"} and got["5"] == {("revisit", "the record it refers to is missing")} and "6" not in got
    assert {p for _, p in got[None]} == {"not a record", "file ends inside a record"}


def test_the_query_over_its_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, queries.op12_warc_round_trip(spark, data).collect()), key=str) == plain(rows)
