"""Legacy ARC archives to WARC.

Reads ARC files of version 1 (URL, IP, date, type, length) and 2 (URL, IP, date, type, result code,
checksum, location, offset, file name, length), steps from record to record by the declared lengths
and writes the equal WARC/1.0 records, with identifiers made from content, so that a repeated
task writes the same bytes. The file's own record becomes a warcinfo record; a revisit names the
record it refers to, its address and its date. A record's key is an extension field, X-Key.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from base64 import b32decode, b32encode
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, rows_of, written

#: The field names of a URL record's header line, by the version that the file's own record declares.
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"),
}
#: Payloads of so many bytes or more are stored once.
LEAST_BYTES = 1000
#: Bytes of payloads that an archive gathers.
ARCHIVE_BYTES = 4 << 20
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the one for URLs
#: Digests with this part of all pages or more are hot: so at most HOT_PARTS of them are broadcast.
HOT_PARTS = 1_000


class ArcError(ValueError):
    """A header line or a length that does not fit its version."""


@dataclass
class ArcRecord:
    fields: dict[str, str]
    body: bytes


def _safe(url: str | None) -> str:
    """The URL as one word of a header line; nothing for null."""
    return re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}" if ord(m[0]) < 128 else "%20", url or "") or "-"


def arc_header(version: int = 1, name: str = "pages.arc") -> bytes:
    kinds = " ".join({"url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "length": "Archive-length", "code": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "filename": "Filename"}[f] for f in FIELDS[version])
    body = f"{version} 0 tessella\n{kinds}\n\n".encode()
    line = f"filedesc://{name} 0.0.0.0 19960101000000 text/plain"
    line += f" {len(body)}\n" if version == 1 else f" 200 - - 0 {name} {len(body)}\n"
    return line.encode() + body + b"\n"


def arc_record(url: str | None, body: bytes, date: str = "20000101000000", ip: str = "0.0.0.0", version: int = 1, name: str = "pages.arc", offset: int = 0) -> bytes:
    line = f"{_safe(url)} {ip} {date} text/html"
    line += f" {len(body)}\n" if version == 1 else f" 200 - - {offset} {name} {len(body)}\n"
    return line.encode() + body + b"\n"


def _arc_records(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Header lines and bodies, by the declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ArcError(f"no line end after byte {at}")
        if end == at:  # between records
            at += 1
            continue
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        try:
            size = int(line.rsplit(" ", 1)[-1])
        except ValueError:
            raise ArcError(f"no length in {line[:200]!r}") from None
        body = data[end + 1 : end + 1 + size]
        if size < 0 or len(body) < size:
            raise ArcError(f"a body of {size} bytes was declared, {len(body)} are there")
        at = end + 1 + size
        yield line, body


def parse_file_record(data: bytes) -> tuple[int, str, str, str]:
    """Version, file name, date and first body line of the file's own record."""
    line, body = next(_arc_records(data), ("", b""))
    if not line.startswith("filedesc://"):
        raise ArcError("the file's own record is missing")
    first = body.split(b"\n", 1)[0].decode("utf-8", "replace").strip()
    version = first.split(" ", 1)[0]
    if not version.isdigit() or int(version) not in FIELDS:
        raise ArcError(f"version {version!r} is unknown")
    words = line.split(" ")
    return int(version), words[0].removeprefix("filedesc://"), words[2] if len(words) > 2 else "", first


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """All URL records; the file's own record comes first and tells the version."""
    names = None
    for line, body in _arc_records(data):
        if names is None:
            names = FIELDS[parse_file_record(data)[0]]
            continue
        parts = line.split(" ")
        extra = len(parts) - len(names)
        if extra < 0:
            raise ArcError(f"{len(parts)} fields in {line[:200]!r}")
        # a URL may hold spaces in old files; the other fields are counted from the end
        values = [" ".join(parts[: extra + 1]), *parts[extra + 1 :]]
        yield ArcRecord(dict(zip(names, values, strict=True)), body)


def warc_date(date: str) -> str:
    """yyyymmddhhmmss, cut short or not, as ISO time; times that ARC can't know are zero."""
    d = (date + "19960101000000"[len(date) :])[:14] if re.fullmatch(r"\d{4,14}", date) else "19960101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _payload(body: bytes) -> tuple[bytes, bytes]:
    """HTTP header block and payload; without a status line all is payload."""
    if body.startswith(b"HTTP/"):
        for gap in (b"\r\n\r\n", b"\n\n"):
            if (cut := body.find(gap)) >= 0:
                return body[: cut + len(gap)], body[cut + len(gap) :]
    return b"", body


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, ' '.join(map(str, parts)))}>"


def _digest(payload: bytes) -> str:
    return "sha1:" + b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(kind: str, date: str, block: bytes, headers: dict[str, str]) -> bytes:
    named = {"WARC-Type": kind, "WARC-Date": date, "WARC-Block-Digest": _digest(block)} | headers | {"Content-Length": str(len(block))}
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def warc_info(data: bytes) -> tuple[str, bytes]:
    """The record of the archive itself, and its identifier."""
    version, name, date, first = parse_file_record(data)
    fields = {"software": "tessella", "format": "WARC File Format 1.0", "description": f"converted from ARC version {version}: {first}"}
    identifier = record_id("warcinfo", name, date, hashlib.sha1(data).hexdigest())
    block = "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode()
    return identifier, warc_record("warcinfo", warc_date(date), block, {"WARC-Record-ID": identifier, "WARC-Filename": name.removesuffix(".arc") + ".warc", "Content-Type": "application/warc-fields"})


def converted(record: ArcRecord, key: object = "", refers_to: object = None, refers_url: str | None = None, info: str = "") -> bytes:
    """The WARC record: a response if the body is an HTTP message, else a resource; a revisit, without payload, where it refers to another record of equal payload and date."""
    f, (head, payload) = record.fields, _payload(record.body)
    kind, date, digest = "response" if head else "resource", warc_date(f["date"]), _digest(payload)
    own = "revisit" if refers_to is not None else kind
    headers = {"WARC-Record-ID": record_id(own, f["url"], date, key, digest), "WARC-Target-URI": f["url"], "WARC-IP-Address": f["ip"], "Content-Type": "application/http; msgtype=response" if head else f["type"], "WARC-Payload-Digest": digest, "X-Key": str(key)}
    if info:
        headers["WARC-Warcinfo-ID"] = info
    if refers_to is None:
        return warc_record(kind, date, record.body, headers)
    target = _safe(refers_url)
    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "WARC-Refers-To": record_id(kind, target, date, refers_to, digest), "WARC-Refers-To-Target-URI": target, "WARC-Refers-To-Date": date, "X-Refers-To-Key": str(refers_to)}
    return warc_record("revisit", date, head, headers)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record."""
    at = 0
    while at < len(data):
        cut = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at) or cut < 0:
            raise ArcError(f"no record at byte {at}")
        lines = data[at:cut].decode("utf-8", "replace").split("\r\n")[1:]
        headers = dict(x.split(": ", 1) for x in lines)
        start, size = cut + 4, int(headers["Content-Length"])
        block = data[start : start + size]
        if len(block) < size or data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ArcError(f"the record at byte {at} is cut off")
        yield headers, block
        at = start + size + 4


def _message(payload: bytes) -> bytes:
    """The payload as an HTTP response, whose length a revisit without payload still tells."""
    return b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def _told_length(head: bytes) -> int | None:
    found = re.search(rb"(?mi)^Content-Length:\s*(\d+)\s*$", head)
    return int(found[1]) if found else None


def pages_to_arc(pages: DataFrame, version: int = 1, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (arc binary, keys array<long>, refers_to array<long>, refers_url array<string>) of rows (page_id, url, html, refers_to, refers_url), several records each."""
    names = ["arc", "keys", "refers_to", "refers_url"]
    lists = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]

    def run(batches):
        held: list = []
        size = 0

        def archive():
            # named after its content, so that a repeated task writes the same bytes
            records = [arc_record(u, _message(body), version=version) for u, body, *_ in held]
            name = hashlib.sha1(b"".join(records)).hexdigest()[:16] + ".arc"
            columns = list(zip(*(x[2:] for x in held), strict=True))
            return pa.record_batch([pa.array([arc_header(version, name) + b"".join(records)], pa.binary()), *(pa.array([c], k) for c, k in zip(columns, lists, strict=True))], names=names)

        for _, rows in rows_of(batches, "page_id", "url", "html", "refers_to", "refers_url"):
            for key, url, html, *ref in zip(*rows, strict=True):
                body = (html or "").encode("utf-8", "surrogatepass")
                held.append((url, body, key, *ref))
                size += len(body)
                if size >= archive_bytes or len(held) >= 5000:
                    yield archive()
                    held.clear()
                    size = 0
        if held:
            yield archive()

    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.col("refers_to").cast("long"), "refers_url")
    return rows.mapInArrow(run, "arc binary, keys array<long>, refers_to array<long>, refers_url array<string>")


def arc_to_warc(archives: DataFrame) -> DataFrame:
    """(warc binary) for each row of archives: arc, and, may be null, keys, refers_to and refers_url of its records in order.

    No archives give no rows, equal ones equal rows; a null archive is an error, as is one whose own
    record is missing. Other columns are not looked at.
    """

    def run(batches):
        for _, (arcs, *about) in rows_of(batches, "arc", "keys", "refers_to", "refers_url"):
            out = []
            for arc, k, r, u in zip(arcs, *about, strict=True):
                if arc is None:
                    raise ArcError("the archive is null")
                info, first = warc_info(arc)
                found = list(parse_arc(arc))
                k, r, u = k or [""] * len(found), r or [None] * len(found), u or [None] * len(found)
                out.append(first + b"".join(converted(x, "" if a is None else a, b, c, info) for x, a, b, c in zip(found, k, r, u, strict=True)))
            yield pa.record_batch([pa.array(out, pa.binary())], names=["warc"])

    return archives.select("arc", "keys", "refers_to", "refers_url").mapInArrow(run, "warc binary")


def warc_rows(warcs: DataFrame) -> DataFrame:
    """A row per record of the archives (warc) but their own: key, url, type, payload digest (hex), length and what it refers to.

    A revisit's length is what its HTTP header block tells. A digest that does not fit is an error.
    """

    def run(batches):
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for _, (archives,) in rows_of(batches, "warc"):
            rows = []
            for data in archives:
                for h, block in parse_warc(data):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    key, ref = h.get("X-Key", ""), h.get("X-Refers-To-Key")
                    if h["WARC-Type"] == "revisit":
                        size = _told_length(block)
                    else:
                        payload = _payload(block)[1] if h["WARC-Type"] == "response" else block
                        size = len(payload)
                        if _digest(payload) != "sha1:" + digest:
                            raise ArcError(f"record {h['WARC-Record-ID']} does not fit its digest")
                    rows.append((int(key) if key else None, h["WARC-Target-URI"], size, b32decode(digest).hex(), h["WARC-Type"], int(ref) if ref else None))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return warcs.select("warc").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def with_references(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The pages plus refers_to and refers_url: of equal payloads of least_bytes or more, the largest page_id and its url, for the others.

    A null html is an empty payload, and a null page_id is nothing to refer to: such rows are
    responses unless another page has their payload. Rows with one page_id and payload are alike; of
    their urls the largest is named. Columns refers_to and refers_url are replaced, others stay
    whatever their names. Smaller payloads are dealt out by their id, and payloads of very many pages
    meet their largest id by a broadcast, so that no digest gathers rows in one task.
    """
    pages = pages.drop("refers_to", "refers_url")
    sha1, key, hot, last = fresh(pages, "sha1", "key", "hot", "last")
    body = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.withColumn(sha1, F.when(F.octet_length(body) >= least_bytes, F.sha1(body)))
    top = F.max(F.struct("page_id", F.coalesce("url", F.lit("")).alias("url"))).alias("top")
    groups = written(keyed.where(F.col(sha1).isNotNull() & F.col("page_id").isNotNull()).groupBy(F.col(sha1).alias("of")).agg(top, F.count("*").alias("n")), "payloads")
    n = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    least = max(2, n // HOT_PARTS)
    # at most HOT_PARTS rows
    hottest = F.broadcast(groups.where(F.col("n") >= least).select(F.col("of").alias(f"{hot}_of"), F.col("top").alias(hot)))
    out = keyed.join(hottest, F.col(sha1) == F.col(f"{hot}_of"), "left").drop(f"{hot}_of")
    own = F.xxhash64("page_id", "url").cast("string")
    out = out.withColumn(key, F.when(F.col(hot).isNull(), F.col(sha1)))
    rest = groups.where(F.col("n") < least).select(F.col("of").alias(f"{last}_of"), F.col("top").alias(last))
    out = out.join(rest, F.coalesce(key, own) == F.col(f"{last}_of"), "left")
    found = F.coalesce(hot, last)
    again = ~F.col("page_id").eqNullSafe(found["page_id"])
    return out.withColumns({"refers_to": F.when(again, found["page_id"]), "refers_url": F.when(again & found["page_id"].isNotNull(), found["url"])}).drop(sha1, key, hot, last, f"{last}_of")


def warc_digest(pages: DataFrame, version: int = 1) -> DataFrame:
    """The query's rows: page_id, payload_bytes, payload_digest (hex), record_type, refers_to.

    Pages become ARC archives, these WARC archives in the shared folder, which are read back.
    """
    arcs = pages_to_arc(with_references(pages.select("page_id", "url", "html")), version)
    found = warc_rows(written(arc_to_warc(arcs), "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
