"""WARC archives: a writer with one gzip member a record, and a reader that salvages what follows damage.

Writing.  Records are made in the tasks that hold the pages and written by Spark's text writer, whose line separator is
the zero byte that ends every gzip member of less than 16 MiB of content; longer records are followed by an empty
member, which ends so too.  The files are plain sequences of members, of about PART * PARTS bytes (64 MiB) at most, but for a
larger single record.  Of equal payloads of LEAST bytes or more the smallest page_id is a response, the others are revisits
that refer to it, by page and payload digest.

Reading.  Archives are read by Spark, compressed by member, as a whole or not; a file is one row, so it may have 2 GB.  A record
counts if its version line, headers, length, ending and block digest are right.  After a failed check the reader looks for the
next place at which a gzip member or a version line starts a right record, goes on there, and logs the bytes between as a
gap.  A member is unpacked in steps, and its records are read one at a time, so work grows with the bytes of the archive and
memory with its largest record.  A member of several records that is damaged or cut gives the right records of what can be
unpacked; bytes lost between them are an inner gap (start and size in the unpacked content, ``member`` its place).  A member's
only record needs the member's own check.

Edge cases: a null html is empty; a null url is the page's urn; smaller and empty payloads are always responses;
rows without page_id are not written; repeated rows of a page are a record each, responses if the page is the smallest with
their payload; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, scratch

LEAST, LEVEL = 100, 4
#: Packed bytes of members that are written as one row, about, and how many such rows an archive has at most.
PART, PARTS = 8 << 20, 8
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: A gzip member whose content is empty.
EMPTY = zlib.compressobj(wbits=31).flush()
ENTRIES = "kind string, path string, start long, size long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload binary, member long"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: Packed bytes that a member is unpacked by, at first and at most.
FIRST, STEP = 1 << 12, 1 << 16
#: Unpacked bytes of a member that are held, and the most that a record within a member may have (a row's limit is near).
HELD, LARGEST = 1 << 24, 1 << 30
_ID = re.compile(r"<urn:page:(-?\d+)>")


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, not compressed."""
    block = HTTP + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url) if url else f'urn:page:{page_id}'}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(content: bytes) -> bytes:
    """A gzip member that ends in a zero byte."""
    pack = zlib.compressobj(LEVEL, wbits=31)
    made = pack.compress(content) + pack.flush()
    return made if made[-1] == 0 else made + EMPTY


def write_archives(pages: DataFrame, path: str) -> None:
    """pages: (page_id, url, html)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    sums = rows.where(F.octet_length("payload") >= LEAST).select("page_id", "digest")
    first = sums.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("other"))
    first = first.where("refers_to < other").select("digest", "refers_to")
    repeats = sums.join(first, "digest").where("page_id > refers_to").select("page_id", F.col("digest").alias("same"), "refers_to").distinct()
    repeats = save(repeats, "revisits").withColumnRenamed("page_id", "of")
    rows = rows.join(repeats, (F.col("page_id") == F.col("of")) & (F.col("digest") == F.col("same")), "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches):
        made, held = [], 0
        part = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(made)[:-1]], pa.binary())], names=["members"])
        for b in batches:
            for r in range(b.num_rows):
                made.append(member(record(*(c[r].as_py() for c in b.columns))))
                held += len(made[-1])
                if held >= PART:
                    yield part()
                    made, held = [], 0
        if made:
            yield part()

    members = rows.mapInArrow(run, "members binary").select(F.col("members").cast("string"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", PARTS).text(path)


def parse(data: bytes | bytearray, at: int) -> tuple[dict[str, str], bytes, int] | int | None:
    """Headers, block and end of the right record at ``at``, if there is one; how many bytes to have if ``data`` ends within it.

    Headers are read line by line, up to the first that is none, so that a version line within a text costs little."""
    if data[at : at + 7] != b"WARC/1."[: max(0, len(data) - at)]:
        return None
    headers: dict[str, str] = {}
    line = data.find(b"\r\n", at)
    while True:
        start = line + 2
        line = data.find(b"\r\n", start) if line >= 0 else line
        if line < 0:
            return at + 2 * (len(data) - at) + 10
        if line == start:
            break
        name, colon, value = bytes(data[start:line]).decode("utf-8", "replace").partition(":")
        if not colon:
            return None
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not (length.isdecimal() and len(length) < 19) or "warc-type" not in headers or "warc-record-id" not in headers:
        return None
    start, end = line + 2, line + 2 + int(length)
    if end + 4 > len(data):
        return end + 4
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    block = bytes(data[start:end])
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    if kind in ("sha256", "sha1") and hashlib.new(kind, block).hexdigest() != digest.lower():
        return None
    return headers, block, end + 4


def unpack(data: bytes, at: int):
    """What the gzip member at ``at`` gives up, in pieces: a step of STEP packed bytes has about a thousand times as many at most.

    Returns how the member ends (whole; damaged; or, with the data, cut) and where."""
    pack, packed, step, hurt = zlib.decompressobj(wbits=31), memoryview(data), FIRST, False
    while at < len(packed):
        ahead = pack.copy()
        try:
            piece = ahead.decompress(packed[at : at + step])
        except zlib.error:  # smaller steps up to the byte, then what comes before the damage within it
            hurt = True
            if step > 1:
                step //= 2
                continue
            rest = packed[at : at + 1]
            try:
                while byte := pack.decompress(rest, 1):
                    yield byte
                    rest = pack.unconsumed_tail
            except zlib.error:
                pass
            return "damaged", at
        yield piece
        pack, at = ahead, min(at + step, len(packed))
        if pack.eof:
            return "whole", at - len(pack.unused_data)
        step = step if hurt else min(2 * step, STEP)
    return "cut", at


def records_in(pieces, trusted: bool):
    """("record", headers, block, end) and ("inner gap", start, size) of a member's unpacked pieces, in order.

    One record is held at a time; one of more than LARGEST bytes is passed over.  Records of a member that fails its own
    check, not ``trusted``, count with a digest only."""
    held, base, sure, need = bytearray(), 0, 0, 1  # base: place of held[0] in the content; sure: end of the last right record
    pieces, more = iter(pieces), True
    while True:
        while more and len(held) < need:
            piece = next(pieces, None)
            more = piece is not None
            held += piece or b""
        if not held:
            return
        found = parse(held, 0)
        if isinstance(found, int):
            if more and found <= LARGEST:
                need = found
                continue
            found = None
        if found and (trusted or found[0].get("warc-block-digest", "").startswith(("sha256:", "sha1:"))):
            if base > sure:
                yield "inner gap", sure, base - sure
            base = sure = base + found[2]
            del held[: found[2]]
            yield "record", found[0], found[1], sure
            need = 1
        else:
            following = _VERSION.search(held, 1)
            # a version line may be cut by the end of a piece
            skip = following.start() if following else max(len(held) - 9, 1) if more else len(held)
            del held[:skip]
            base += skip
            need = 1 if following else len(held) + 1


def packed_end(data: bytes, at: int, end: int) -> int:
    """Where the packed bytes of the member at ``at`` end that give its first ``end`` bytes."""
    pack, packed, made, rest = zlib.decompressobj(wbits=31), memoryview(data), 0, b""
    while made < end - 1:  # a byte less, since the damage may follow at once
        if not rest:
            rest = packed[at : at + STEP]
            at += len(rest)
        made += len(pack.decompress(rest, min(STEP, end - 1 - made)))
        rest = pack.unconsumed_tail
    return at - len(rest) - len(pack.unused_data)


def member_at(data: bytes, at: int) -> tuple | None:
    """(entries, end) of the gzip member at ``at``; None if nothing of it can be trusted.

    Its content is held if it has HELD bytes at most, and else unpacked again to be read."""
    run, held, total = unpack(data, at), [], 0
    while True:
        try:
            piece = next(run)
        except StopIteration as stop:
            state, end = stop.value
            break
        total += len(piece)
        held = [*held, piece] if held is not None and total <= HELD else None
    records = lambda: records_in(unpack(data, at) if held is None else held, state != "damaged")
    if state != "whole":
        ends = [e[3] for e in records() if e[0] == "record"]
        if not ends or (len(ends) == 1 and ends[0] == total):  # the only record lacks its member's check
            return None
        end = packed_end(data, at, ends[-1])

    def entries():
        sure = 0
        for e in records():
            if e[0] == "record":
                sure = e[3]
                yield "record", at, end - at, *e[1:3]
            else:
                yield *e, None, at
        if state == "whole" and sure < total:
            yield ("gap", at, end - at, None, None) if not sure else ("inner gap", sure, total - sure, None, at)

    return entries(), end


def salvage(data: bytes):
    """("record", start, size, headers, block) and ("gap", start, size, None, None), in order, covering all bytes.

    Of a member with right records also ("inner gap", start, size, None, place): unpacked bytes that are lost between or after
    them, of the member at ``place``; what follows the last right record of one that fails its check is part of a gap."""
    at, gap = 0, None
    while at < len(data):
        if data[at : at + 3] == b"\x1f\x8b\x08":
            found = member_at(data, at)
        else:
            found = parse(data, at)
            found = None if found is None or isinstance(found, int) else ([("record", at, found[2] - at, *found[:2])], found[2])
        if found is None:
            gap = at if gap is None else gap
            following = _START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        for entry in found[0]:
            if entry[0] == "gap":  # a whole member without a right record
                gap = at if gap is None else gap
            else:
                if gap is not None:
                    yield "gap", gap, at - gap, None, None
                    gap = None
                yield entry
        at = found[1]
    if gap is not None:
        yield "gap", gap, len(data) - gap, None, None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """ENTRIES of all archives under ``path``: records with their payloads, gaps and inner gaps."""

    def run(batches):
        names, types = zip(*(f.split() for f in ENTRIES.split(", ")), strict=True)
        types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t] for t in types]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for b in batches:
            for r in range(b.num_rows):
                rows, held = [], 0
                where, data = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                for kind, start, size, headers, block in salvage(data):
                    if headers is None:
                        rows.append((kind, where, start, size, *[None] * 6, block))  # an inner gap's member
                    else:
                        payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
                        rows.append((kind, where, start, size, headers["warc-type"], headers["warc-record-id"], headers.get("warc-target-uri"), headers.get("warc-refers-to"), headers.get("warc-payload-digest"), payload, None))
                        held += len(payload)
                    if held > 4_000_000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ENTRIES)


def page_of(record_id: str) -> F.Column:
    """The page_id in a record id."""
    return F.regexp_extract(record_id, _ID.pattern, 1).cast("long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages and reads them back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    A gap in what was just written is no result: it raises ValueError."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    return restored(pages.sparkSession, path)


def restored(spark: SparkSession, path: str) -> DataFrame:
    """The pages of the archives under ``path``, which must have no gaps."""
    read = read_archives(spark, path)
    refers = F.when(F.col("record_type") == "revisit", page_of("refers_to"))
    said = F.substring_index("payload_digest", ":", -1)
    read = read.select("kind", F.col("path").alias("archive"), page_of("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("digest"), said.alias("said"), "record_type", refers.alias("refers_to"))
    read = save(read, "read")
    lost = read.where("kind <> 'record'").groupBy("archive").agg(F.count("*").alias("gaps")).orderBy("archive").first()
    if lost:
        raise ValueError(f"{lost.gaps} damaged places in {lost.archive}")
    response = read.where("record_type <> 'revisit'")
    # a revisit's payload is that of the record it refers to, by page and digest; responses take no part in the join
    full = response.groupBy(F.col("page_id").alias("of"), F.col("digest").alias("full")).agg(F.max("n").alias("full_n"))
    revisit = read.where("record_type = 'revisit'").join(full, (F.col("refers_to") == F.col("of")) & (F.col("said") == F.col("full")), "left")
    revisit = revisit.select("page_id", F.col("full_n").alias("n"), F.col("full").alias("digest"), "record_type", "refers_to")
    both = response.select("page_id", "n", "digest", "record_type", "refers_to").unionByName(revisit)
    return both.withColumnsRenamed({"n": "payload_bytes", "digest": "payload_digest"})


ORACLE = f"""
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages where page_id is not null),
f as (select *, min(page_id) over (partition by payload_digest) as first from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= {LEAST} and page_id > first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= {LEAST} and page_id > first then first end as refers_to
from f
"""
