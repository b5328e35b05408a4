"""Legacy archive converter: ARC files in, WARC files out, both through Spark's readers and writers.

An archive file is one row that the text writer puts into one file, record by record
gzipped as the formats ask for; a NUL byte (the writer's line end) pads it, which gzip
readers skip. Archives hold about `segment_bytes` of records, so no row outgrows a task.

The ARC reader tells version 1 (URL IP date type length) from version 2 (five more
fields before the length) by the version block and takes each body by its declared
length. Archives may be gzipped record by record, as a whole, or not at all. Junk between gzip members is
skipped up to the next one that opens; a damaged member gives what can be read of it before the damage. Without a version block the version is
told by the fields of the first header; content types may hold blanks. `arc_losses` counts what is skipped, damaged or cut. A malformed header ends its member; in plain archives reading goes on at
the next line that is a header whose declared length ends where another header or the file's end stands, so
words of a body are never taken for a header. A record cut short is kept and marked as truncated. The converter makes WARC
identifiers (from a digest of what identifies the record), timestamps, types and
digests. Of records with equal payloads of `least` bytes or more the one with the smallest page id
is a response, the others are revisits that refer to it.

Edge cases: very long html is one record of its own; null html is an empty payload; null urls become "about:blank"; white space in
URLs is percent-encoded; null page ids come after all others when the response is
chosen; repeated rows each get a record, all but one of them revisits; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, raw_bytes, scratch_path, table
from ._shards import join_per_key

_ARC1 = b"URL IP-address Archive-date Content-type Archive-length"
_ARC2 = b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
_CRLF = b"\r\n"
_TYPES = {"page_id": pa.int64(), "url": pa.string(), "date": pa.string(), "mime": pa.string(), "http": pa.binary(), "payload": pa.binary(), "digest": pa.string(), "bytes": pa.int64(), "at": pa.int64(), "truncated": pa.bool_()}


def _member(data: bytes) -> bytes:
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


_GZIP = b"\x1f\x8b\x08"


def _salvaged(data: bytes, begun: int, step: int = 256) -> bytes:
    """What a damaged member gives before its damage: inflated in small steps, the last one byte by byte."""
    made, out, at = zlib.decompressobj(31), [], begun
    while at < len(data):
        before = made.copy()
        try:
            out.append(made.decompress(data[at : at + step]))
        except zlib.error:
            if step == 1:
                break
            made, step = before, 1
            continue
        if made.eof:
            break
        at += step
    return b"".join(out)


def members(data: bytes, step: int = 1 << 16, lost: list[dict] | None = None) -> Iterator[bytes]:
    """The gzip members of an archive, one at a time; what is no member between them is skipped, and damaged ones give what they hold.

    `lost` gets a row (at, reason, bytes) for all that is skipped or damaged; NUL bytes between members are padding.
    """
    return (content for content, _ in _members(data, step, [] if lost is None else lost))


def _members(data: bytes, step: int, lost: list[dict]) -> Iterator[tuple[bytes, bool]]:
    """The members, each with whether it is sound."""
    at = data.find(_GZIP)
    _skipped(lost, 0, data[: at if at >= 0 else len(data)])
    while at >= 0:
        made, out, begun = zlib.decompressobj(31), [], at
        try:
            while not made.eof and at < len(data):
                piece = data[at : at + step]
                out.append(made.decompress(piece))
                at += len(piece) - len(made.unused_data)
            content, sound, ended = b"".join(out), made.eof, at
            if not sound:
                lost.append({"at": begun, "reason": "cut gzip member", "bytes": 0})
        except zlib.error:
            content, sound, at, ended = _salvaged(data, begun), False, begun + 1, None
        out, at = None, data.find(_GZIP, at)
        if ended is None:
            lost.append({"at": begun, "reason": "damaged gzip member", "bytes": (at if at >= 0 else len(data)) - begun})
        if sound or content:
            yield content, sound
        if ended is not None:
            _skipped(lost, ended, data[ended : at if at >= 0 else len(data)])


def _skipped(lost: list[dict], at: int, data: bytes) -> None:
    if data.strip(b"\0\r\n"):
        lost.append({"at": at, "reason": "no gzip member", "bytes": len(data)})


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_block(version: int, name: str, date: bytes) -> bytes:
    """The version block that opens an ARC file."""
    fields = _ARC1 if version == 1 else _ARC2
    body = b"%d 0 tarnwell\n%s\n" % (version, fields)
    rest = b"text/plain %d" % len(body) if version == 1 else b"text/plain 200 - - 0 %s %d" % (name.encode(), len(body))
    return b"filedesc://%s 0.0.0.0 %s %s\n%s\n" % (name.encode(), date, rest, body)


def arc_record(version: int, url: bytes, date: bytes, mime: bytes, status: int, body: bytes, offset: int, name: str) -> bytes:
    url = re.sub(rb"[\x00-\x20]", lambda m: b"%%%02X" % m[0][0], url) or b"about:blank"
    if version == 1:
        return b"%s 0.0.0.0 %s %s %d\n%s\n" % (url, date, mime, len(body), body)
    check = base64.b32encode(hashlib.sha1(body).digest())
    return b"%s 0.0.0.0 %s %s %d %s - %d %s %d\n%s\n" % (url, date, mime, status, check, offset, name.encode(), len(body), body)


def http_response(payload: bytes, page_id: int | None) -> bytes:
    named = b"X-Page-Id: %d\r\n" % page_id if page_id is not None else b""
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n%s" % (named, len(payload), payload)


def _write(archives: DataFrame, path: str) -> None:
    """One archive a row, one row a file."""
    archives.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\u0000").option("maxRecordsPerFile", 1).text(path)


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20200101000000", segment_bytes: int = 32 << 20) -> None:
    """Pages as ARC files, in turn in archives of version 1 and 2; size counts payload bytes, and version 2 names each record's offset in the file."""

    def pack(batches):
        # two archives are open at a time, one of each version, and pages go to them in turn
        open_, turn = {1: ([], [0, 0]), 2: ([], [0, 0])}, 0
        for batch in batches:
            ids, urls, bodies = batch.column(0).to_pylist(), raw_bytes(batch.column(1)), raw_bytes(batch.column(2))
            for page, url, html in zip(ids, urls, bodies):
                version, turn = 1 + turn % 2, turn + 1
                held, size = open_[version]
                name = f"part-{version}.arc"
                if not held:
                    held.append(_member(arc_block(version, name, date.encode())))
                    size[1] = len(held[0])
                held.append(_member(arc_record(version, url or b"", date.encode(), b"text/html", 200, http_response(html or b"", page), size[1], name)))
                size[0], size[1] = size[0] + len(html or b""), size[1] + len(held[-1])
                if size[0] >= segment_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])
                    open_[version] = ([], [0, 0])
        for held, _ in open_.values():
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])

    _write(pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), html_col).mapInArrow(pack, "archive binary"), path)


#: Header lines of both versions: URL, address, date, type (which may hold blanks), the five further fields of version 2, length.
_HEADERS = {1: re.compile(rb"(\S+) (\S+) (\d{4,14}) (\S.*?)(?P<v2>) (?P<length>\d+)"), 2: re.compile(rb"(\S+) (\S+) (\d{4,14}) (\S.*?) (?P<v2>\d{1,3}|-) (\S+) (\S+) (\d+) (\S+) (?P<length>\d+)")}


def _header_at(data: bytes, at: int, version: int | None = None) -> tuple[re.Match, int] | None:
    """The header that stands at a place, and where its body begins; of a version, or of either."""
    end = data.find(b"\n", at, at + (1 << 16))
    line = data[at:end].rstrip(b"\r") if end >= 0 else b""
    for v in (version,) if version else (2, 1):
        if m := _HEADERS[v].fullmatch(line):
            return m, end + 1
    return None


def _after(data: bytes, begin: int, length: int) -> int | None:
    """Where the next record begins after a body, if the data ends there or a header follows."""
    end = begin + length
    at = end + len(data[end : end + 2]) - len(data[end : end + 2].lstrip(b"\r\n"))
    return at if end <= len(data) and (at >= len(data) or (at > end and _header_at(data, at))) else None


def _resume(data: bytes, at: int) -> int:
    """Where reading goes on after a malformed header: past its body if it ends with a length that holds, else at the next header whose length does."""
    begin = data.find(b"\n", at) + 1
    length = re.search(rb"(\d{1,15})\r?\n$", data[at:begin])
    after = _after(data, begin, int(length[1])) if length else None
    if after is not None:
        return after
    while 0 < begin < len(data):
        found = _header_at(data, begin)
        if found and _after(data, found[1], int(found[0]["length"])) is not None:
            return begin
        begin = data.find(b"\n", begin) + 1
    return len(data)


def parse_arc(data: bytes, lost: list[dict] | None = None) -> Iterator[dict]:
    """Records of one ARC archive by declared lengths; `truncated` tells that the body is shorter than declared, or comes from a damaged gzip member.

    Without a version block the version is that of the first header's fields. `lost` gets a row (at, reason, bytes) for all that is skipped, damaged or cut;
    places are those in the archive or, for what a gzip member holds, in that member.
    """
    lost = [] if lost is None else lost
    version, n = None, 0
    packed = data.startswith(_GZIP) or (_GZIP in data and b"filedesc://" not in data[:4096] and not _header_at(data, 0))
    for k, (record, sound) in enumerate(_members(data, 1 << 16, lost) if packed else [(data.rstrip(b"\0"), True)]):
        at = 0
        while at < len(record):
            if record[at : at + 1] in (b"\n", b"\r"):  # between records
                at += 1
                continue
            block = record.startswith(b"filedesc://", at)
            found = _header_at(record, at, None if block else version)
            if not found:
                after = len(record) if packed and k and at == 0 else _resume(record, at)
                lost.append({"at": at, "reason": "malformed header", "bytes": after - at})
                at = after
                continue
            m, begin = found
            length = int(m["length"])
            body = record[begin : begin + length]
            at = begin + length
            if len(body) < length:
                lost.append({"at": begin, "reason": "shorter than declared", "bytes": length - len(body)})
            if block:
                version = 2 if body.split(b" ", 1)[0] == b"2" else 1 if body else 2 if m["v2"] else None
                continue
            version = version or (2 if m["v2"] else 1)
            n += 1
            yield {"url": m[1].decode("utf-8", "replace"), "date": m[3].decode(), "mime": m[4].decode("utf-8", "replace"), "body": body, "at": n, "truncated": len(body) < length or not sound}


def _split_http(body: bytes) -> tuple[bytes, bytes]:
    head, cut, payload = body.partition(_CRLF + _CRLF)
    return (head, payload) if cut and head.startswith(b"HTTP/") else (b"", body)


def _header(head: bytes, name: bytes) -> bytes | None:
    m = re.search(rb"(?:^|\r\n)" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head, re.IGNORECASE)
    return m[1] if m else None


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str, batch_bytes: int = 4 << 20, packed: bool = False, payloads: bool = True) -> DataFrame:
    """file, at, page_id, url, date, mime, http, payload (deflated, if packed), digest and bytes of every record of the ARC files."""

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held, size = [], 0
                for r in parse_arc(content):
                    http, payload = _split_http(r.pop("body"))
                    page = _header(http, b"X-Page-Id")
                    held.append(r | {"page_id": int(page) if page else None, "http": http, "payload": None if not payloads else zlib.compress(payload, 1) if packed else payload, "digest": base32_sha1(payload), "bytes": len(payload)})
                    size += len(payload)
                    if size >= batch_bytes:
                        yield _records(name, held)
                        held, size = [], 0
                if held:
                    yield _records(name, held)

    def _records(name, held):
        return pa.RecordBatch.from_arrays([pa.array([name] * len(held)), *[pa.array([r[k] for r in held], t) for k, t in _TYPES.items()]], names=["file", *_TYPES])

    return _files(spark, path).mapInArrow(parse, "file string, page_id bigint, url string, date string, mime string, http binary, payload binary, digest string, bytes bigint, at bigint, truncated boolean")


def arc_losses(spark: SparkSession, path: str) -> DataFrame:
    """file, reason, n and bytes of what the reader could not take from the ARC files: nothing is dropped without a count."""

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lost: list[dict] = []
                for _ in parse_arc(content, lost):
                    pass
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(lost), pa.string()), pa.array([x["reason"] for x in lost], pa.string()), pa.array([x["bytes"] for x in lost], pa.int64())], names=["file", "reason", "bytes"])

    found = _files(spark, path).mapInArrow(parse, "file string, reason string, bytes bigint")
    return found.groupBy("file", "reason").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def record_id(page_id: int | None, url: str, date: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}|{url}|{date}|{digest}'.encode()).digest()[:16], version=5)}>"


def warc_date(date: str) -> str:
    d = (date + "00000000000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, identity: str, date: str, url: str | None, block: bytes, mime: str, more: list[tuple[str, str]]) -> bytes:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", identity), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", url)] if url else []
    fields += [*more, ("WARC-Block-Digest", "sha1:" + base32_sha1(block)), ("Content-Type", mime), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + _CRLF + _CRLF


_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def convert(records: DataFrame, path: str, least: int = 0, segment_bytes: int = 32 << 20, packed: bool = False, keys: DataFrame | None = None) -> None:
    """ARC records (payloads deflated, if packed, which halves the shuffle) as WARC files. The response of each digest is found by an aggregation, which groups of any size pass."""
    place = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "file", "at", "url", "date")
    # only digests of records that are long enough have a response to refer to
    keyed = records.withColumn("key", F.when(F.col("bytes") >= least, F.col("digest")).otherwise(F.concat(F.lit("-"), "file", F.lit(" "), "at")))
    found = records if keys is None else keys  # the same records without payloads, where they can be had
    first = materialize(found.withColumn("key", F.col("digest")).filter(F.col("bytes") >= least).groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("_n")).filter("_n > 1"), "responses")
    marked = join_per_key(keyed, first, "key")
    own = (F.col("first.file") == F.col("file")) & (F.col("first.at") == F.col("at"))
    marked = marked.select("page_id", "url", "date", "mime", "http", "payload", "digest", "bytes", "truncated", F.when(~own, F.col("first")).alias("first"))

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if not held:
                    block = b"software: tarnwell ARC converter\r\nformat: WARC File Format 1.1\r\n"
                    held.append(_member(warc_record("warcinfo", record_id(None, "warcinfo", r["date"], r["digest"]), warc_date(r["date"]), None, block, "application/warc-fields", [])))
                digest = [("WARC-Payload-Digest", "sha1:" + r["digest"])] + ([("WARC-Truncated", "unspecified")] if r["truncated"] else [])
                identity, first = record_id(r["page_id"], r["url"], r["date"], r["digest"]), r["first"]
                mime = "application/http; msgtype=response" if r["http"] else r["mime"]
                if first is None:
                    payload = zlib.decompress(r["payload"]) if packed else r["payload"]
                    head = r["http"] + _CRLF + _CRLF if r["http"] else b""
                    made = warc_record("response" if r["http"] else "resource", identity, warc_date(r["date"]), r["url"], head + payload, mime, digest)
                else:
                    refers = [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(first["page_id"], first["url"], first["date"], r["digest"]))]
                    refers += [("WARC-Refers-To-Target-URI", first["url"]), ("WARC-Refers-To-Date", warc_date(first["date"])), ("X-Payload-Length", str(r["bytes"]))]
                    refers += [("X-Refers-To-Page-Id", str(first["page_id"]))] if first["page_id"] is not None else []
                    made = warc_record("revisit", identity, warc_date(r["date"]), r["url"], r["http"] + _CRLF + _CRLF if r["http"] else b"", mime, refers + digest)
                held.append(_member(made))
                size += len(made)
                if size >= segment_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])

    _write(marked.mapInArrow(pack, "archive binary"), path)


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to (and payload) of the responses and revisits."""

    def parse(batches):
        for batch in batches:
            for content in batch.column(1).to_pylist():
                rows = []
                for record in members(content):
                    head, _, block = record.partition(_CRLF + _CRLF)
                    fields = dict(line.split(b": ", 1) for line in head.split(_CRLF)[1:] if b": " in line)
                    kind = fields.get(b"WARC-Type", b"").decode()
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    http, payload = _split_http(block[: int(fields[b"Content-Length"])])
                    page, refers = _header(http, b"X-Page-Id"), fields.get(b"X-Refers-To-Page-Id")
                    size = int(fields[b"X-Payload-Length"]) if kind == "revisit" else len(payload)
                    digest = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
                    if kind != "revisit" and base32_sha1(payload) != digest:
                        raise ValueError(f"payload digest of {fields[b'WARC-Record-ID'].decode()} does not match")
                    rows.append((int(page) if page else None, fields[b"WARC-Target-URI"].decode(), kind, size, digest, int(refers) if refers else None, payload if payloads and kind != "revisit" else None))
                cols = list(zip(*rows)) or [()] * 7
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    return _files(spark, path).mapInArrow(parse, "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary")


def archive_pages(pages: DataFrame, least: int = 0, segment_bytes: int = 32 << 20, payloads: bool = False) -> DataFrame:
    """Pages through ARC files and the converter into WARC files, read back."""
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc, segment_bytes=segment_bytes)
    convert(read_arc(spark, arc, packed=True), warc, least, segment_bytes, packed=True, keys=read_arc(spark, arc, payloads=False))
    return read_warc(spark, warc, payloads)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
