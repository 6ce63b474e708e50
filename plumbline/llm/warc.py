"""WARC archives as a Python data source, with payload-identical revisits.

Reading plans one partition for each run of files of about ``partitionBytes``.
Predicates on record headers (record_type, record_id, target_uri, content_type,
payload_digest, refers_to, date) are pushed down: a record's header is parsed
first, and one that a predicate refuses is stepped over without inflating the
rest.  With the option ``payload=false`` no payload is decoded at all.

A gzip member may hold any number of records.  The writer gives each record a
member of its own and notes its length in
the gzip header (the extra field ``SL``), which lets the reader seek from record
to record; files without it, and uncompressed ones, are read in sequence.  The
writer's tasks write files under names of their own, and the driver's commit
lists them in a manifest (``_files-*.json``); only listed files are read, so
those of lost or repeated attempts never count.  Appending adds a manifest;
overwriting drops the older ones, and then their files.

A payload is what remains of the HTTP body once its transfer coding (chunked) is
undone, and its digest is held against both.  A record that doesn't fit its
digest, or can't be decoded, is returned with what is wrong in ``fault`` and the
job goes on with the next gzip member or the next line that begins as a record
does; ``sound`` raises on such records.  What is broken before its header can be
read gives one row with nothing but a fault, which predicates on headers leave
out as they do nulls.  What isn't decoded (payloads that are stepped over) isn't
checked.  A file is read by one task.

Defined results: a null payload is empty; a null URL leaves WARC-Target-URI out;
the rows that repeat a payload's smallest page_id are all responses; a null
page_id is never the smallest unless all are null; an empty table writes an
archive without records, which reads as an empty table; extra columns are left out.
"""

from __future__ import annotations

import base64
import fnmatch
import hashlib
import json
import operator
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from .common import checkpointed, scratch

SCHEMA = "record_type string, record_id string, target_uri string, date string, content_type string, content_length long, payload_digest string, refers_to string, payload_bytes long, payload binary, fault string"
_ARROW = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fault", pa.string())])
#: Header fields that predicates may be pushed to, by column.
_HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_ORDER = {GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"
_FIRST, _CHUNK = 1 << 12, 1 << 14
_GZIP = b"\x1f\x8b\x08"
_NEXT = re.compile(rb"(?<=\n)WARC/\d")
_NEXT_PLAIN = re.compile(rb"(?<=\n)WARC/\d|\x1f\x8b\x08")
_MEMBER = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x0c\x00SL\x08\x00"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member that notes its own length and that of ``data`` (both modulo 2**32)."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = len(_MEMBER) + 8 + len(body) + 8
    return b"".join([_MEMBER, (size & 0xFFFFFFFF).to_bytes(4, "little"), (len(data) & 0xFFFFFFFF).to_bytes(4, "little"), body, zlib.crc32(data).to_bytes(4, "little"), (len(data) & 0xFFFFFFFF).to_bytes(4, "little")])


def record(kind: str, record_id: str, uri: str | None, date: str, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record; of a revisit the HTTP header alone, with the length of the payload it stands for."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)


@dataclass
class _Files(InputPartition):
    files: list


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Plain:
    """Bytes of a file as they are, from ``at`` on."""

    noted, broken = None, None

    def __init__(self, file, size: int, at: int):
        self.file, self.size, self.end = file, size, at

    def peek(self, n: int) -> bytes:
        return self.file.read_at(max(0, min(n, self.size - self.end)), self.end)

    def skip(self, n: int) -> int:
        n = min(n, self.size - self.end)
        self.end += n
        return n


class _Member:
    """The inflated bytes of one gzip member, a few at a time; ``broken`` tells why there are no more."""

    def __init__(self, file, size: int, at: int):
        self.file, self.size, self.at, self.took = file, size, at, 0
        self.z, self.buffer, self.broken, self.made = zlib.decompressobj(31), bytearray(), None, 0
        head = file.read_at(min(24, size - at), at)
        #: Lengths of the member and of its content, where the writer noted them.
        self.noted = (int.from_bytes(head[16:20], "little"), int.from_bytes(head[20:24], "little")) if head[:16] == _MEMBER else None

    def _fill(self, n: int) -> None:
        while len(self.buffer) < n and not self.z.eof and not self.broken:
            more = self.z.unconsumed_tail
            if not more:
                step = _FIRST if self.made < _FIRST else _CHUNK if self.made < _CHUNK else 1 << 20
                more = self.file.read_at(min(step, self.size - self.at - self.took), self.at + self.took)
                self.took += len(more)
            if not more:
                self.broken = "the gzip member ends early"
                return
            try:  # in small steps first, since what a failing call has inflated is lost
                got = self.z.decompress(more, 256 if self.made < _FIRST else 1 << 20)
            except zlib.error as e:
                self.broken = f"the gzip member is broken: {e}"
                return
            self.made += len(got)
            self.buffer += got

    def peek(self, n: int) -> bytes:
        self._fill(n)
        return bytes(self.buffer[:n])

    def skip(self, n: int) -> int:
        left = n
        while left:
            self._fill(min(left, 1 << 20))
            step = min(left, len(self.buffer))
            if not step:
                break
            del self.buffer[:step]
            left -= step
        return n - left

    @property
    def end(self) -> int:
        return self.at + self.took - len(self.z.unused_data)


class _Source:
    """The records of a file; what can't be read is a fault, after which reading goes on at the next member or record."""

    def __init__(self, file):
        self.file, self.size, self.jump = file, file.size(), None

    def records(self, wanted) -> Iterator[tuple[dict, bytes, bytes | None, str | None]]:
        """(header, start of the block, the block or None, fault or None) of each record whose header is wanted.

        A fault whose header can't be read has an empty one.
        """
        at, lost = 0, False
        while at < self.size:
            head = self.file.read_at(min(3, self.size - at), at)
            stream = (_Member if head == _GZIP else _Plain)(self.file, self.size, at)
            for header, start, block, fault in self._of(stream, wanted, lost):
                lost = bool(fault) and not header
                # What is wanted of a record with a fault is its header.
                if wanted(header) if fault else start is not None:
                    yield header, start or b"", block, fault
            if isinstance(stream, _Plain):
                at = stream.end
            elif stream.broken:
                at = self._after(stream)
            else:
                at = stream.end if self.jump is None else self.jump

    def _after(self, stream: _Member) -> int:
        """Where reading goes on behind a broken member, or behind what only begins like one."""
        if stream.noted:
            there = stream.at + stream.noted[0]
            if there == self.size or there < self.size and self.file.read_at(min(3, self.size - there), there) == _GZIP:
                return there
        at = stream.at + 3
        while stream.made and at < self.size:
            data = self.file.read_at(min(1 << 20, self.size - at), at)
            if (k := data.find(_GZIP)) >= 0:
                return at + k
            at += max(1, len(data) - 2)
        return min(at, self.size)

    def _of(self, stream, wanted, lost: bool) -> Iterator[tuple]:
        """The records of one stream.  Of what lies between two records one fault comes, however much it is."""
        self.jump, first, plain = None, True, isinstance(stream, _Plain)
        while True:
            while (ends := stream.peek(64)) and ends[0] in b"\r\n":
                stream.skip(len(ends) - len(ends.lstrip(b"\r\n")))
            if plain and (not ends or ends[:3] == _GZIP):
                return
            if not ends:
                if stream.broken and not lost:
                    yield {}, None, None, stream.broken
                return
            header, begin = self._header(stream)
            if header is None:
                if not lost:
                    yield {}, None, None, stream.broken or f"not a WARC record: {ends[:40]!r}"
                lost, first = True, False
                self._resume(stream)
                continue
            stated, lost = header.get("content-length", ""), False
            stream.skip(begin)
            if not re.fullmatch(r"\d{1,18}", stated, re.ASCII):
                yield header, None, None, f"the record's Content-Length is {stated[:40]!r}" if stated else "the record has no Content-Length"
                first = False
                self._resume(stream)
                continue
            n, full = int(stated), wanted(header)
            alone = first and stream.noted and stream.noted[1] == begin + n + 4 & 0xFFFFFFFF
            first, block = False, None
            if full == "block":
                block = stream.peek(n)
                start = block[:_CHUNK]
            else:
                start = self._start(stream, n) if full else None
                if alone and not stream.broken:
                    self.jump = stream.at + stream.noted[0]
                    yield header, start, None, None
                    return
            got = stream.skip(n)
            if full == "block":
                stream.peek(64)  # a wrong checksum shows behind the last byte
            if got < n or stream.broken and alone:
                yield header, None, None, stream.broken or "the record ends early"
                if stream.broken:
                    return
            else:
                yield header, start, block, None

    @staticmethod
    def _start(stream, n: int) -> bytes:
        """The first bytes of a block, as many as hold an HTTP header if there is one."""
        start = stream.peek(min(n, _FIRST // 2))
        return start if b"\r\n\r\n" in start else stream.peek(min(n, _CHUNK))

    @staticmethod
    def _resume(stream) -> None:
        """Goes on to the next line that begins as a record does, or in a plain file to a gzip member."""
        mark = _NEXT_PLAIN if isinstance(stream, _Plain) else _NEXT
        while data := stream.peek(1 << 16):
            if m := mark.search(data, 1):
                stream.skip(m.start())
                return
            stream.skip(len(data) - 8 if len(data) == 1 << 16 else len(data))

    @staticmethod
    def _header(stream) -> tuple[dict | None, int]:
        """The header and its length, or None for what is none within a megabyte."""
        size = 512
        while True:
            data = stream.peek(size)
            end = data.find(b"\r\n\r\n")
            if end >= 0 or len(data) < size or size >= 1 << 20 or not data.startswith(b"WARC/"):
                break
            size *= 4
        if end < 0 or not data.startswith(b"WARC/"):
            return None, 0
        lines = re.sub(r"\r\n[ \t]+", " ", data[:end].decode("utf-8", "replace")).split("\r\n")
        pairs = (x.partition(":") for x in lines[1:])
        return {k.strip().lower(): v.strip() for k, _, v in pairs}, end + 4


def _manifests(names) -> list[str]:
    return [n for n in names if fnmatch.fnmatch(posixpath.basename(n), "_files*.json")]


def _listed(system: fs.FileSystem, manifest: str) -> list[str]:
    with system.open_input_stream(manifest) as f:
        return json.loads(f.read())


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "true").lower() == "true"
        self.bytes = int(options.get("partitionbytes", options.get("partitionBytes", 128 << 20)))
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in _HEADERS and isinstance(f, EqualTo | EqualNullSafe | In | StringStartsWith | IsNotNull | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        system, root = _filesystem(self.path)
        infos = {i.path: i.size for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file} if system.get_file_info(root).type == fs.FileType.Directory else {root: system.get_file_info(root).size}
        listed = _manifests(infos)
        if listed:
            names = sorted(f"{root.rstrip('/')}/{x}" for m in listed for x in _listed(system, m))
        else:
            names = sorted(p for p in infos if fnmatch.fnmatch(posixpath.basename(p), "*.warc*"))
        out, run, size = [], [], 0
        for n in names:
            if run and size + infos[n] > self.bytes:
                out.append(_Files(run))
                run, size = [], 0
            run.append(n)
            size += infos[n]
        return [*out, _Files(run)]

    def _fits(self, header: dict) -> bool:
        for f in self.filters:
            value = _value(f.attribute[0], header)
            if value is None:
                if not (isinstance(f, EqualNullSafe) and f.value is None):
                    return False
            elif isinstance(f, In):
                if value not in f.value:
                    return False
            elif isinstance(f, StringStartsWith):
                if not value.startswith(f.value):
                    return False
            elif isinstance(f, EqualTo | EqualNullSafe):
                if value != f.value:
                    return False
            elif type(f) in _ORDER and not _ORDER[type(f)](value, f.value):
                return False
        return True

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.path)
        rows, size = [], 0
        for name in partition.files:
            with system.open_input_file(name) as file:
                for header, start, block, fault in _Source(file).records(lambda h: self._fits(h) and ("block" if self.payload else "header")):
                    rows.append(_row(header, start, block, self.verify, fault))
                    size += len(rows[-1][-2] or b"") + 200
                    if size > 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _value(column: str, header: dict) -> str | None:
    value = header.get(_HEADERS[column])
    if value is None:
        return None
    if column in ("record_id", "refers_to"):
        return value.strip("<>")
    return value.removeprefix("sha1:") if column == "payload_digest" else value


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        n = int(body[at:end].partition(b";")[0], 16) if end >= 0 else -1
        if n < 0 or end + 2 + n > len(body):
            raise ValueError("broken chunk")
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def _row(header: dict, start: bytes, block: bytes | None, verify: bool, fault: str | None = None) -> tuple:
    if fault:
        stated = header.get("content-length", "")
        n = int(stated) if re.fullmatch(r"\d{1,18}", stated, re.ASCII) else None
        names = (header.get("warc-target-uri"), header.get("warc-date"), header.get("content-type"), n, _value("payload_digest", header), _value("refers_to", header))
        return (header.get("warc-type"), _value("record_id", header), *names, None, None, fault)
    body = header.get("content-type", "").startswith("application/http")
    raw = block if block is not None else start
    end = raw.find(b"\r\n\r\n") if body else -4
    head = raw[: max(0, end)]
    length = re.search(rb"(?im)^content-length:\s*(\d+)", head) if body else None
    payload = block[end + 4 :] if block is not None and (end > -4 or not body) else None
    kind, n = header.get("warc-type"), int(header["content-length"])
    size = int(length[1]) if length else n - (end + 4 if body and end >= 0 else 0)
    digest = _value("payload_digest", header)
    if kind == "revisit":
        payload = None
    elif payload is not None:
        whole = payload
        if re.search(rb"(?im)^transfer-encoding:.*chunked", head):
            try:
                payload = _unchunked(payload)
            except ValueError as e:
                fault = str(e)
        if verify and digest and header["warc-payload-digest"].startswith("sha1:") and digest not in (base32_sha1(x) for x in ((payload,) if payload is whole else (payload, whole))):
            fault = "the payload does not fit its digest"
        size = len(payload)
    return (kind, _value("record_id", header), header.get("warc-target-uri"), header.get("warc-date"), header.get("content-type"), n, digest, _value("refers_to", header), size, payload, fault)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class WarcWriter(DataSourceArrowWriter):
    """Takes record_type, record_id, target_uri, payload and refers_to."""

    def __init__(self, options, overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite
        self.date = options.get("date", "2024-01-01T00:00:00Z")
        self.bytes = int(options.get("filebytes", options.get("fileBytes", 128 << 20)))
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)

    def write(self, iterator) -> WriterCommitMessage:
        system, root = _filesystem(self.path)
        files, out, size = [], None, 0
        for batch in iterator:
            cols = {k: batch.column(k) for k in batch.schema.names}
            for i in range(batch.num_rows):
                kind, rid, uri, payload, refers = (cols[k][i].as_py() if k in cols else None for k in ("record_type", "record_id", "target_uri", "payload", "refers_to"))
                if out is None:
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                data = member(record(kind, rid, uri, self.date, payload.encode() if isinstance(payload, str) else payload or b"", refers))
                out.write(data)
                size += len(data)
                if size >= self.bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages) -> None:
        system, root = _filesystem(self.path)
        root = root.rstrip("/")
        names = sorted(n for m in messages if m for n in m.files)
        old = _manifests(i.path for i in system.get_file_info(fs.FileSelector(root)) if i.is_file) if self.overwrite else []
        gone = [f"{root}/{x}" for m in old for x in _listed(system, m)]
        with system.open_output_stream(f"{root}/_files-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps(names).encode())
        for path in [*old, *gone]:  # lists first: what is no longer listed is no longer read
            system.delete_file(path)

    def abort(self, messages) -> None:
        system, root = _filesystem(self.path)
        for m in messages:
            for n in m.files if m else ():
                system.delete_file(f"{root}/{n}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """A record per row: of equal payloads of ``min_bytes`` or more the smallest page_id is the response.

    Only ids and digests are compared; each payload moves once at most.
    """
    # A payload shorter than min_bytes is told apart by its page_id, so it meets no other.
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", html.alias("payload"), F.sha1(F.encode(html, "UTF-8")).alias("digest"), (F.octet_length(html) >= min_bytes).alias("counts"))
    ids = p.where("counts").select("page_id", "digest")
    first = checkpointed(ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"))
    later = ids.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("again"), F.col("digest").alias("like"), "first").distinct()
    same = F.col("page_id").eqNullSafe(F.col("again")) & (F.col("digest") == F.col("like")) & F.col("counts")
    df = p.join(later, same, "left")
    return df.select(
        F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.concat(F.lit(_URN), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        F.col("url").alias("target_uri"),
        "payload",
        F.concat(F.lit(_URN), F.col("first").cast("string")).alias("refers_to"),
    )


def write(pages: DataFrame, path: str, min_bytes: int = 0, mode: str = "append") -> None:
    register(pages.sparkSession)
    with_revisits(pages, min_bytes).write.format("warc").mode(mode).save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def sound(records: DataFrame) -> DataFrame:
    """The records; one with a fault ends the job."""
    wrong = F.raise_error(F.concat(F.coalesce("record_id", F.lit("a record")), F.lit(": "), "fault"))
    return records.where(F.when(F.col("fault").isNotNull(), wrong.cast("boolean")).otherwise(True))


def page_number(urn: str):
    text = F.regexp_extract(F.col(urn), rf"^{_URN}(-?\d+)$", 1)
    return F.when(text != "", text.cast("long"))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` as an archive in the shared folder and reads it back.

    Responses are read with their payloads, which are held against their digests;
    of revisits only the headers are.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path, min_bytes)
    response = sound(read(spark, path).where("record_type = 'response'")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    revisit = read(spark, path, payload=False).where("record_type = 'revisit'")
    df = response.unionByName(revisit)
    return df.select(page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_number("refers_to").alias("refers_to"))
