"""Operator 12: WARC archives of pages, written with segments and revisits and put together again.

write() turns each page into an HTTP response with chunked framing inside a `response` record, or, where another page has
the same payload, into a `revisit` of that record. Blocks longer than a segment go on in `continuation` records. Spark's
text writer makes the files: a record ends in an empty line, so the empty line is the line separator, and each gzip file is
read by one task, in order.

read() is a streaming pass: a task feeds the pieces between empty lines to a parser that cuts records by Content-Length,
wherever empty lines fall. Segments are shuffled by the id of the record they continue and sorted by number inside each
partition; then another streaming pass decodes the chunks and digests the payload segment by segment, so no record has
to fit into a task. A revisit gets length and digest from the record it refers to.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, with_ids

BREAK = b"\r\n\r\n"
#: Bytes of a block that one record holds; longer blocks go on in continuation records.
SEGMENT = 1 << 20
CHUNK = 1 << 12
#: Rows of repeated payloads (digest, key, url) that may be broadcast.
BROADCAST_PAYLOADS = 50_000
#: An HTTP head or chunk line longer than this is damage.
HEAD = 1 << 16
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_DATE = "2000-01-01T00:00:00Z"


def record_id(key: str | None, url: str | None, digest: str, turn: int) -> str:
    """The same page gets the same id in every run and retry."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(repr((key, url, digest, turn)).encode()).digest()[:16], version=5)}>"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block


def page_records(key: str | None, url: str | None, payload: bytes, digest: str, turn: int, first: tuple[str | None, str | None] | None, segment: int) -> Iterator[bytes]:
    """The records of one page, without the empty line at their ends; first: key and url of the page that it revisits."""
    mine = record_id(key, url, digest, turn)
    about = [("WARC-Date", _DATE), ("WARC-Target-URI", None if url is None else quote(url, safe="".join(map(chr, range(33, 127))))), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-Key", key), ("Content-Type", "application/http; msgtype=response")]
    if first is not None:
        refers = record_id(*first, digest, 0)
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", mine), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers), *about], _HTTP + b"\r\n")
        return
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", mine), *about], block)
        return
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", mine), ("WARC-Segment-Number", "1"), *about], block[:segment])
    starts = range(segment, len(block), segment)
    for number, i in enumerate(starts, 2):
        last = str(len(block)) if i == starts[-1] else None
        own = record_id(key, url, f"{digest}/{number}", turn)
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", mine), ("WARC-Segment-Number", str(number)), ("WARC-Segment-Total-Length", last)], block[i : i + segment])


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, segment: int = SEGMENT, scratch: Scratch | None = None) -> None:
    """Writes a record a page (and its continuations) to gzip archives below path, which all executors share.

    Of pages with equal payloads (the html in UTF-8; null is empty) of at least `least` bytes the one of smallest key is the
    response, the others revisit it. Rows that repeat a key count each: of those with the same payload the smallest url
    is the response, of wholly equal rows one. Null keys come after all others and are left out of the record. Control
    and other bytes outside printable ASCII in a url are percent-encoded. An empty table makes an archive without records.
    """
    own = scratch or Scratch(pages.sparkSession, "warc")
    text = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), text.alias("html"), F.unhex(F.sha1(text.cast("binary"))).alias("digest"))
    meta = own.save(rows.select("key", "url", "digest", F.octet_length("html").alias("n")), "payloads")
    place = F.struct(F.col("key").isNull().alias("none"), "key", "url")
    firsts = meta.where(F.col("n") >= least).groupBy("digest").agg(F.count("*").alias("k"), F.min(place).alias("first")).where("k > 1")
    firsts = own.save(firsts.select("digest", F.col("first.key").alias("first_key"), F.col("first.url").alias("first_url"), F.lit(True).alias("several")), "firsts")
    again = own.save(meta.groupBy("key").count().where("count > 1 AND key IS NOT NULL").select("key"), "again")
    single = rows.where("key IS NOT NULL").withColumn("turn", F.lit(0))
    if again.limit(1).count() or meta.where("key IS NULL").limit(1).count():
        # wholly equal rows are one row and a count, so they don't meet
        twice = with_ids(rows, again, "key").unionByName(rows.where("key IS NULL")).groupBy("key", "url", "digest").agg(F.first("html").alias("html"), F.count("*").alias("k"))
        twice = twice.withColumn("turn", F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int")))).select(*rows.columns, "turn")
        single = with_ids(single, again, "key", "left_anti").unionByName(twice)
    out = with_ids(single, firsts, "digest", "left", BROADCAST_PAYLOADS)
    response = F.col("key").eqNullSafe(F.col("first_key")) & F.col("url").eqNullSafe(F.col("first_url")) & (F.col("turn") == 0)
    out = out.select(F.col("key").cast("string"), "url", "html", "digest", "turn", F.col("first_key").cast("string"), "first_url", (F.col("several") & ~response).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for k, u, h, d, turn, fk, fu, revisit in zip(*[c if i == 2 else c.to_pylist() for i, c in enumerate(batch.columns)], strict=True):
                for record in page_records(k, u, h.as_buffer().to_pybytes() if h.as_buffer() else b"", base64.b32encode(d).decode(), turn, (fk, fu) if revisit else None, segment):
                    held.append(record)
                    size += len(record)
                    if size >= 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
                        held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])

    out.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", BREAK.decode()).option("compression", "gzip").text(path)
    for t in (meta, firsts, again):
        own.drop(t)


class Records:
    """Cuts a file's records out of pieces that stood between empty lines; head fields are in lower case."""

    def __init__(self):
        self.held, self.head = bytearray(), None

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str] | None, bytes]]:
        """Whole records so far; (None, bytes) for a piece that is no record where one should begin."""
        self.held += piece + BREAK
        while True:
            if self.head is None:
                while self.held.startswith(b"\r\n"):
                    del self.held[:2]
                end = self.held.find(BREAK)
                if end < 0:
                    return
                lines = self.held[:end].decode("utf-8", "replace").split("\r\n")
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                if not lines[0].startswith("WARC/") or not fields.get("content-length", "").isdigit():
                    yield None, bytes(self.held[:end])
                    del self.held[: end + 4]
                    continue
                del self.held[: end + 4]
                self.head = fields
            n = int(self.head["content-length"])
            if len(self.held) < n + 4:
                return
            head, block, self.head = self.head, bytes(self.held[:n]), None
            del self.held[: n + 4]
            yield head, block

    def rest(self) -> bool:
        """Whether the file ended inside a record."""
        return self.head is not None or bool(self.held.strip(b"\r\n"))


class Payload:
    """Decodes an HTTP message fed in parts: head, then chunked or plain body; keeps length and SHA-1, and the bytes if asked."""

    def __init__(self, keep: bool = False):
        self.held, self.state, self.left = bytearray(), "head", 0
        self.n, self.sha, self.body, self.problem = 0, hashlib.sha1(), bytearray() if keep else None, None

    def _take(self, data: bytes) -> None:
        self.n += len(data)
        self.sha.update(data)
        if self.body is not None:
            self.body += data

    def _line(self, end: bytes) -> bytes | None:
        at = self.held.find(end)
        if at < 0:
            if len(self.held) > HEAD:
                self.problem, self.state = "no end of a head or chunk line", "bad"
            return None
        line = bytes(self.held[:at])
        del self.held[: at + len(end)]
        return line

    def feed(self, data: bytes) -> None:
        self.held += data
        while self.state != "bad":
            if self.state == "head":
                if (line := self._line(BREAK)) is None:
                    return
                fields = [x.lower().replace(b" ", b"") for x in line.split(b"\r\n")]
                self.state = "size" if b"transfer-encoding:chunked" in fields else "plain"
            elif self.state == "size":
                if (line := self._line(b"\r\n")) is None:
                    return
                try:
                    self.left = int(line.split(b";")[0], 16)
                except ValueError:
                    self.problem, self.state = "chunk size isn't a number", "bad"
                    return
                self.state = "data" if self.left else "trailer"
            elif self.state == "data":
                part = bytes(self.held[: self.left])
                self._take(part)
                self.left -= len(part)
                del self.held[: len(part)]
                if self.left or len(self.held) < 2:
                    return
                if not self.held.startswith(b"\r\n"):
                    self.problem, self.state = "chunk longer than its size", "bad"
                    return
                del self.held[:2]
                self.state = "size"
            elif self.state == "trailer":
                if (line := self._line(b"\r\n")) is None:
                    return
                if not line:
                    self.state = "end"
            elif self.state == "plain":
                self._take(bytes(self.held))
                self.held.clear()
                return
            else:
                if self.held:
                    self.problem, self.state = "bytes after the last chunk", "bad"
                return

    def close(self) -> str | None:
        if self.problem is None and self.state not in ("plain", "end"):
            return "message ends early"
        return self.problem


SEGMENTS = "origin string, number int, total long, type string, key string, url string, refers string, digest string, block binary, problem string"
_FIELDS = [x.split()[0] for x in SEGMENTS.split(", ")]


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below path as a segment: number 0 for whole records, else its place; a row with a problem for
    each stretch that is no record and each file that ends inside one."""
    pieces = spark.read.option("lineSep", BREAK.decode()).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))

    def row(head: dict[str, str] | None, block: bytes) -> tuple:
        if head is None:
            return (None, 0, None, None, None, None, None, None, None, "not a record")
        number = head.get("warc-segment-number", "0")
        total, digest = head.get("warc-segment-total-length"), head.get("warc-payload-digest", "")
        origin = head.get("warc-segment-origin-id") or head.get("warc-record-id")
        return (origin, int(number) if number.isdigit() else 0, int(total) if total and total.isdigit() else None, head.get("warc-type"), head.get("page-key"), head.get("warc-target-uri"), head.get("warc-refers-to"), digest.rpartition(":")[2] or None, block, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            columns = zip(*rows, strict=True) if rows else [[]] * len(_FIELDS)
            kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 5, pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=_FIELDS)

        file, records = None, Records()
        cut = (None, 0, None, None, None, None, None, None, None, "file ends inside a record")
        for batch in batches:
            rows, size = [], 0
            for piece, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if name != file:
                    rows += [cut] if records.rest() else []
                    file, records = name, Records()
                for head, block in records.feed(piece.as_py()):
                    rows.append(row(head, block))
                    size += len(block)
                if size >= 1 << 22:
                    yield out(rows)
                    rows, size = [], 0
            yield out(rows)
        if records.rest():
            yield out([cut])

    return pieces.mapInArrow(run, SEGMENTS)


RECORDS = "origin string, type string, key string, url string, refers string, digest string, payload_bytes long, payload binary, problem string"


def records(parts: DataFrame, payload: bool = False) -> DataFrame:
    """(origin, type, key, url, refers, digest, payload_bytes, payload, problem): one row a record, its segments put together.

    Segments meet by origin, sorted by number, and are decoded one after another. problem names what is wrong: a number that
    is missing, a total that differs, broken framing, or a digest that isn't the payload's; it is null for sound records. A
    segment number that comes twice is read once. digest is the payload's own, for revisits the one that they state.
    """
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    class Open:
        """The record that is being put together."""

        def __init__(self, row):
            self.row, self.data, self.last, self.size, self.total, self.problem = row, Payload(payload), 0, 0, None, None

        def add(self, number, total, block):
            if number and number == self.last:
                return
            if number > self.last + 1:
                self.problem = f"segment {self.last + 1} is missing"
            self.last, self.size, self.total = number, self.size + len(block), total if total is not None else self.total
            self.data.feed(block)

        def close(self):
            origin, kind, key, url, refers, stated = self.row
            problem = self.problem or (f"total length is {self.total}, not {self.size}" if self.last and self.total != self.size else None)
            if kind == "revisit":
                return (origin, kind, key, url, refers, stated, None, None, problem)
            problem = problem or self.data.close()
            digest = base64.b32encode(self.data.sha.digest()).decode()
            if problem is None and stated and stated != digest:
                problem = "payload differs from its digest"
            return (origin, kind, key, url, refers, digest, self.data.n, bytes(self.data.body) if payload else None, problem)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)
        now = None
        for batch in batches:
            rows, size = [], 0
            for origin, number, total, kind, key, url, refers, stated, block, problem in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if problem is not None:
                    rows.append((origin, kind, key, url, refers, stated, None, None, problem))
                    continue
                if now is None or number == 0 or origin != now.row[0]:
                    if now is not None:
                        rows.append(now.close())
                        size += len(rows[-1][7] or b"")
                    now = Open((origin, kind, key, url, refers, stated))
                now.add(number, total, block)
                if size >= 1 << 22:
                    yield out(rows)
                    rows, size = [], 0
            yield out(rows)
        if now is not None:
            yield out([now.close()])

    return parts.repartition(F.col("origin")).sortWithinPartitions("origin", "number").mapInArrow(run, RECORDS)


def read(spark: SparkSession, path: str, scratch: Scratch | None = None) -> DataFrame:
    """(key, url, record_type, payload_bytes, payload_digest, refers_to, problem) of every record below path, key as a string.

    refers_to is the key of the record that a revisit refers to, from which it has its length. A revisit of a record that the
    archives don't hold, or hold with another digest, has a problem. What is no record has a row with its problem alone.
    """
    own = scratch or Scratch(spark, "warc")
    every = own.save(records(segments(spark, path)).drop("payload"), "records")
    asked = own.save(every.where("type = 'revisit'").select(F.col("refers").alias("origin")).distinct(), "asked")
    # an archive may be there twice: one record of each id answers
    found = with_ids(every.where("type = 'response'"), asked, "origin").groupBy(F.col("origin").alias("refers")).agg(F.min(F.struct("key", "payload_bytes", "digest")).alias("of"))
    found = own.save(found, "found")
    own.drop(asked)
    out = with_ids(every, found, "refers", "left", BROADCAST_PAYLOADS)
    lost = F.when(F.col("type") == "revisit", F.when(F.col("of").isNull(), "the record it refers to is missing").when(F.col("of.digest") != F.col("digest"), "it refers to another payload"))
    return out.select("key", "url", F.col("type").alias("record_type"), F.coalesce("payload_bytes", "of.payload_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("of.key").alias("refers_to"), F.coalesce("problem", lost).alias("problem"))


def round_trip(pages: DataFrame, key: str = "page_id", least: int = 0, segment: int = SEGMENT) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to, problem) of pages that were written and read back."""
    scratch = Scratch(pages.sparkSession, "warc")
    path = f"{scratch.root}/archives"
    write(pages, path, key, least=least, segment=segment, scratch=scratch)
    back = read(pages.sparkSession, path, scratch)
    scratch.drop(path)
    kind = pages.schema[key].dataType
    return back.select(F.col("key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "problem")
