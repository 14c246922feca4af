"""Legacy archives to WARC: ARC files of version 1 or 2 are parsed and written as WARC 1.1 records.

Archives are real files of bounded size in a folder that all executors see, written by Spark's
text writer (so retried tasks leave nothing behind) and read whole by its binary reader.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialise, scratch_path, utf8

#: Header fields by version, as the version block of an ARC file states them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
START = datetime(2000, 1, 1, tzinfo=timezone.utc)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _plain(url: str | None) -> str:
    """A URL without the characters that end a header field."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "about:blank")


# ---- legacy archives


def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 tideline\n{ARC_FIELDS[version]}\n".encode()
    middle = "text/plain" if version == 1 else f"text/plain 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} {middle} {len(body)}\n".encode() + body


def arc_record(version: int, name: str, offset: int, url: str, date: str, document: bytes) -> bytes:
    middle = "text/html" if version == 1 else f"text/html 200 {hashlib.md5(document).hexdigest()} - {offset} {name}"
    return f"{url} 0.0.0.0 {date} {middle} {len(document)}\n".encode() + document


def http_response(payload: bytes, page_id: int | None) -> bytes:
    named = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n{named}\r\n".encode() + payload


def _write(rows: DataFrame, path: str, separator: str) -> None:
    """rows: (archive long, seq long, value binary). One folder an archive, records in order, each followed by separator.

    Packing is most of the writing, so it is set to its fastest level.
    """
    text = rows.sortWithinPartitions("archive", "seq").select("archive", F.col("value").cast("string").alias("value"))
    text.write.partitionBy("archive").option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def write_arc(pages: DataFrame, path: str, archive_bytes: int = 16 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Pages as ARC files of about archive_bytes, by turns of version 1 and 2.

    A record's document is an HTTP response that names the page; its date is derived from the
    id. A null html is an empty payload, a null URL about:blank, a null id is left out.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive = TaskContext.get().partitionId() * 1_000_000
        seq = size = 0
        for b in batches:
            out = []
            for i, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if size > archive_bytes:
                    archive, seq, size = archive + 1, 0, 0
                version, name = (archive // 1_000_000 + archive) % 2 + 1, f"tideline-{archive}.arc"
                date = (START + timedelta(seconds=(i or 0) % 1_000_000_000)).strftime("%Y%m%d%H%M%S")
                if not seq:
                    out.append((archive, seq, arc_version_block(name, version, date)))
                    seq, size = 1, len(out[-1][2]) + 1
                out.append((archive, seq, arc_record(version, name, size, _plain(url), date, http_response(html or b"", i))))
                seq, size = seq + 1, size + len(out[-1][2]) + 1
                if len(out) == 256:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col).cast("binary")).mapInArrow(build, "archive long, seq long, value binary")
    _write(rows, path, "\n")


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["archive", "seq", "value"])


class Stream:
    """A file, unpacked as it is read, that knows its position."""

    def __init__(self, content: bytes):
        raw = io.BytesIO(content)
        self.file = gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw
        self.at = 0

    def line(self) -> bytes:
        x = self.file.readline()
        self.at += len(x)
        return x

    def read(self, n: int) -> bytes:
        x = self.file.read(n)
        if len(x) < n:
            raise ValueError(f"a record declares {n} bytes, {len(x)} are left")
        self.at += n
        return x


@dataclass(frozen=True)
class ArcRecord:
    archive: str
    version: int
    offset: int
    fields: dict[str, str]
    document: bytes


def parse_arc(content: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, after its version block; documents are cut by their declared lengths."""
    s = Stream(content)
    head = s.line().decode("utf-8", "replace").rstrip("\n").split(" ")
    if not head[0].startswith("filedesc://"):
        raise ValueError("an ARC file starts with a filedesc record")
    lines = s.read(int(head[-1])).decode("utf-8", "replace").split("\n")
    version, names = int(lines[0].split(" ")[0]), lines[1].split(" ")
    if version not in ARC_FIELDS:
        raise ValueError(f"ARC version {version} is not known")
    while line := s.line():
        if line in (b"\n", b"\r\n"):
            continue
        values = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if len(values) != len(names):
            raise ValueError(f"a version {version} header has {len(names)} fields, not {len(values)}")
        fields = dict(zip(names, values))
        offset = s.at - len(line)
        yield ArcRecord(head[0].removeprefix("filedesc://"), version, offset, fields, s.read(int(fields["Archive-length"])))


# ---- conversion


def warc_date(arc_date: str) -> str:
    """YYYYMMDDhhmmss, or a beginning of it, to ISO 8601 in UTC."""
    d = arc_date + "00000101000000"[len(arc_date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, offset: int, url: str) -> str:
    """The same identifier whenever the same place of an archive is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}#{url}')}>"


def split_http(document: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and payload; no header where there is none."""
    if not document.startswith(b"HTTP/"):
        return b"", document
    head, gap, payload = document.partition(b"\r\n\r\n")
    return (head + gap, payload) if gap else (document, b"")


def http_field(header: bytes, name: str) -> str | None:
    want = name.lower().encode() + b":"
    return next((x[len(want) :].strip().decode("utf-8", "replace") for x in header.split(b"\r\n") if x.lower().startswith(want)), None)


def warc_record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """Header and block; the writer puts the two line ends behind it."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


PLACES = "path string, archive string, offset long, key long, record_id string, url string, date string, payload_bytes long, payload_digest string"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rows = []
            for r in parse_arc(content):
                header, payload = split_http(r.document)
                key = http_field(header, "X-Page-Id")
                rows.append((path, r.archive, r.offset, None if key is None else int(key), record_id(r.archive, r.offset, r.fields["URL"]), r.fields["URL"], warc_date(r.fields["Archive-date"]), len(payload), sha1_base32(payload)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in PLACES.split(", ")])


def _with_lists(spark: SparkSession, arc_path: str, listed: DataFrame, most_broadcast: int, archive_bytes: int) -> DataFrame:
    """(content, refs) of all archives. The lists go to the archives while their size, which is measured, is small.

    Beyond that, archives meet their lists in a shuffle with one part for about four archives'
    bytes, so that no task reads more as the input grows.
    """
    size = listed.agg(F.sum(F.octet_length(F.to_json("refs")).cast("long"))).first()[0] or 0
    files = _files(spark, arc_path)
    if size <= most_broadcast:
        return files.join(F.broadcast(listed), "path", "left").select("content", "refs")
    packed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(arc_path).agg(F.sum("length")).first()[0] or 0
    parts = max(1, -(-packed // (4 * archive_bytes)))
    return files.repartition(parts, "path").join(listed.repartition(parts, "path"), "path", "left").select("content", "refs")


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, min_revisit_bytes: int = 0, archive_bytes: int = 16 << 20, most_broadcast: int = 64 << 20) -> None:
    """Convert all ARC files under arc_path to gzipped WARC files under warc_path.

    Identifiers, dates, types and digests are derived from the ARC headers and documents alone.
    Of records with equal payloads of min_revisit_bytes or more, that of the smallest key (null
    keys last, ties by place) is a response; others become revisits that keep the HTTP header.
    Archives are read twice, for the digests and for the records, and stay where they are while
    the lists of revisits take at most most_broadcast bytes; beyond that they move as packed files.
    """
    places = materialise(_files(spark, arc_path).mapInArrow(_places, PLACES), "warc-places")
    rank = F.struct(F.col("key").isNull().alias("last"), "key", "archive", "offset", "record_id", "url", "date")
    first = places.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min(rank).alias("r"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select("payload_digest", "payload_bytes", F.col("r.archive").alias("_archive"), F.col("r.offset").alias("_offset"), F.col("r.record_id").alias("ref_id"), F.col("r.url").alias("ref_url"), F.col("r.date").alias("ref_date"), F.col("r.key").alias("ref_key"))
    revisit = places.select("path", "archive", "offset", "payload_digest", "payload_bytes").join(first, ["payload_digest", "payload_bytes"]).where("archive != _archive or offset != _offset")
    listed = revisit.groupBy("path").agg(F.collect_list(F.struct("offset", "ref_id", "ref_url", "ref_date", "ref_key")).alias("refs"))
    files = _with_lists(spark, arc_path, materialise(listed, "warc-revisits"), most_broadcast, archive_bytes)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive = TaskContext.get().partitionId() * 1_000_000
        seq = size = held = 0
        out: list[tuple[int, int, bytes]] = []
        for b in batches:
            for content, refs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                known = {x["offset"]: x for x in refs or ()}
                for r in parse_arc(content):
                    if size > archive_bytes:
                        archive, seq, size = archive + 1, 0, 0
                    date = warc_date(r.fields["Archive-date"])
                    if not seq:
                        name = f"tideline-{archive}.warc.gz"
                        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, 0, name)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
                        out.append((archive, 0, warc_record(info, b"software: tideline\r\nformat: WARC File Format 1.1\r\n")))
                        seq = 1
                    out.append((archive, seq, _converted(r, date, known.get(r.offset))))
                    seq, size, held = seq + 1, size + len(out[-1][2]), held + len(out[-1][2])
                    if len(out) >= 256 or held > 4 << 20:
                        yield _batch(out)
                        out, held = [], 0
        if out:
            yield _batch(out)

    _write(files.mapInArrow(build, "archive long, seq long, value binary"), warc_path, "\r\n\r\n")


def _converted(r: ArcRecord, date: str, ref: dict | None) -> bytes:
    """The WARC record of an ARC record; ref: what it is a revisit of, if it is one."""
    header, payload = split_http(r.document)
    block = r.document if ref is None else header
    ip = r.fields["IP-address"]
    fields = [
        ("WARC-Type", "revisit" if ref else "response" if header else "resource"),
        ("WARC-Record-ID", record_id(r.archive, r.offset, r.fields["URL"])),
        ("WARC-Date", date),
        ("WARC-Target-URI", r.fields["URL"]),
        ("WARC-IP-Address", None if ip == "0.0.0.0" else ip),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http; msgtype=response" if header else r.fields["Content-type"]),
    ]
    if ref:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", ref["ref_id"]),
            ("WARC-Refers-To-Target-URI", ref["ref_url"]),
            ("WARC-Refers-To-Date", ref["ref_date"]),
            ("X-Refers-To-Key", ref["ref_key"]),
        ]
    return warc_record(fields, block)


# ---- reading


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record, cut by Content-Length."""
    s = Stream(content)
    while line := s.line():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"a record starts with its WARC version, not {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := s.line()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8", "replace").rstrip("\r\n").partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, s.read(int(fields["content-length"]))


RECORDS = "record_id string, record_type string, url string, date string, key long, payload_bytes long, payload_digest string, refers_to_id string, refers_to_key long, payload binary"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Response, resource and revisit records of all WARC files under path.

    Digests are computed from the payloads that are there and compared with the headers'; a
    revisit's come from its headers. payloads = False leaves the payload column null.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                rows = []
                for f, block in parse_warc(content):
                    if f["warc-type"] == "warcinfo":
                        continue
                    header, payload = split_http(block)
                    key, told, ref = http_field(header, "X-Page-Id"), f.get("warc-payload-digest", "").removeprefix("sha1:"), f.get("x-refers-to-key")
                    if f["warc-type"] == "revisit":
                        n, digest, payload = int(http_field(header, "Content-Length") or 0), told, None
                    else:
                        n, digest = len(payload), sha1_base32(payload)
                        if told and told != digest:
                            raise ValueError(f"payload digest of {f['warc-record-id']} is {digest}, not {told}")
                    rows.append((f["warc-record-id"], f["warc-type"], f.get("warc-target-uri"), f["warc-date"], None if key is None else int(key), n, digest, f.get("warc-refers-to"), None if ref is None else int(ref), payload if payloads else None))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return _files(spark, path).select("content").mapInArrow(scan, RECORDS)


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 0, archive_bytes: int = 16 << 20) -> DataFrame:
    """Write pages as legacy archives, convert them to WARC, and read that back.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to. Repeated
    ids are records of their own; an empty table gives no rows.
    """
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc, archive_bytes)
    if not _any_file(spark, arc):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    convert_arc(spark, arc, warc, min_revisit_bytes, archive_bytes)
    got = read_warc(spark, warc, payloads=False)
    return got.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").alias("refers_to"))


def _any_file(spark: SparkSession, path: str) -> bool:
    return bool(_files(spark, path).limit(1).count())
