"""Web archives: a converter from the legacy ARC format, and WARC files written and read back.

Method: ARC files of version 1 (five header fields) and version 2 (ten) are
parsed by their version block and the length that each header line declares.
Identifiers, timestamps, types and digests of WARC records are synthesised
from what ARC has. An HTTP answer becomes a response, split at its first blank
line, with or without carriage returns; what is no HTTP answer (``dns:`` and
others) becomes a resource whose payload is the whole block. Bytes under a
header line that can't be read, and records that are cut short, are kept aside
as resources with the reason, up to the next line that is a header;
``rejected`` gives them.

Of responses with equal payloads of ``LEAST_REVISIT`` bytes or more, that of
the smallest page_id is a response and the others revisit it. A revisit names
its response by record id, and reading back resolves it that way.

Archives are cut by size: a task gathers records up to ``ARCHIVE_BYTES`` into
one archive, Spark writes each as a file of its own into the shared folder,
and reading takes one file at a time. Decisions are made on digests and ids
only and meet their archives file by file, so payloads are never shuffled one by
one: where the decisions are too many to broadcast, compressed files move.

Defined results: null html is an empty payload; a null url is ``about:blank``
and white space in a url is percent-encoded; repeated rows of the smallest
page_id are all responses; rows without page_id revisit if there is one with
it, else all are responses; an empty table gives no rows. A block or payload
that doesn't have its digest ends the reading with an error.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblark.llm.common import Scratch, table

ARCHIVE_BYTES = 8 << 20
LEAST_REVISIT = 100
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
EPOCH = datetime(2005, 1, 1, tzinfo=timezone.utc)
RECORD = "page_id long, kind string, url string, ip string, date string, content_type string, http binary, payload binary, payload_bytes long, payload_digest string, record_id string, rejected string"
READ_BACK = "page_id long, record_id string, record_type string, url string, date string, payload_bytes long, payload_digest string, refers_to_id string, rejected string"
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
SALTS = 16
# A header line by version; urls and content types may hold spaces.
HEADER = {
    1: re.compile(rb"(?P<url>\S.*?) (?P<ip>[0-9a-fA-F.:]+|-) (?P<date>[0-9]{8,17}) (?P<type>.*?) (?P<length>[0-9]+)\r?"),
    2: re.compile(rb"(?P<url>\S.*?) (?P<ip>[0-9a-fA-F.:]+|-) (?P<date>[0-9]{8,17}) (?P<type>.*?) (?P<code>\S+) (?P<checksum>\S+) (?P<location>.*?) (?P<offset>\S+) (?P<file>\S+) (?P<length>[0-9]+)\r?"),
}
LIKE_HEADER = re.compile(rb"(?m)^[A-Za-z][A-Za-z0-9+.-]*:\S* (?:[0-9a-fA-F.:]+|-) [0-9]{8,17} [^\n]*[0-9]\r?$")
BLANK = re.compile(rb"\r?\n\r?\n")


# ---- ARC


def arc_record(version: int, page_id: int | None, url: str | None, html: str | None, offset: int, name: str) -> bytes:
    body = (html or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n\r\n".encode()
    uri = "".join("%%%02X" % ord(c) if c <= " " else c for c in url or "about:blank")
    date = (EPOCH + timedelta(seconds=(page_id or 0) % 600_000_000)).strftime("%Y%m%d%H%M%S")
    length = len(http) + len(body)
    if version == 1:
        line = f"{uri} 192.0.2.1 {date} text/html {length}\n"
    else:
        line = f"{uri} 192.0.2.1 {date} text/html 200 {hashlib.md5(body).hexdigest()} - {offset} {name} {length}\n"
    return line.encode("utf-8", "surrogatepass") + http + body + b"\n"


def arc_opening(version: int, name: str) -> bytes:
    block = f"{version} 0 biblark\n{FIELDS[version]}\n".encode()
    date = EPOCH.strftime("%Y%m%d%H%M%S")
    tail = str(len(block)) if version == 1 else f"200 - - 0 {name} {len(block)}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {tail}\n".encode() + block + b"\n"


def read_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC archive: url, ip, date, type, block, and the archive's name and the place there. What can't
    be read comes as (rejected, block)."""
    at, version, name = 0, 1, hashlib.sha256(data).hexdigest()
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        begin, end = at, data.find(b"\n", at)
        end = len(data) if end < 0 else end
        opening = data.startswith(b"filedesc:", at)
        m = (HEADER[1].fullmatch(data, at, end) or HEADER[2].fullmatch(data, at, end)) if opening else HEADER[version].fullmatch(data, at, end)
        why = "header line" if m is None else "cut short" if end + 1 + int(m["length"]) > len(data) else "date" if not opening and date_of(m["date"]) is None else ""
        if why == "header line":
            following = LIKE_HEADER.search(data, end)
            at = following.start() if following else len(data)
            yield {"rejected": why, "block": data[begin:at], "name": name, "at": begin}
            continue
        at = min(end + 1 + int(m["length"]), len(data))
        if opening and not why:
            version = 2 if data[end + 1 : at].startswith(b"2") else 1
            name = m["url"].decode("utf-8", "surrogateescape")
        elif why:
            yield {"rejected": why, "block": data[begin:at], "name": name, "at": begin}
        else:
            yield {"block": data[end + 1 : at], "name": name, "at": begin} | {k: m[k].decode("utf-8", "surrogateescape") for k in ("url", "ip", "date", "type")}


def date_of(digits: bytes | str) -> str | None:
    """14 digits, of which hours and less may be missing, as an ISO timestamp."""
    digits = digits.decode() if isinstance(digits, bytes) else digits
    try:
        return datetime.strptime(digits[:14].ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return None


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head with its blank line, and payload. Without a blank line all is head."""
    m = BLANK.search(block)
    return (block[: m.end()], block[m.end() :]) if m else (block, b"")


def http_fields(head: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.splitlines()[1:])}


def arc_to_record(arc: dict) -> tuple:
    """What a WARC record needs, synthesised from an ARC record."""
    block, ident = arc["block"], f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, arc['name'] + ':' + str(arc['at']))}>"
    if "rejected" in arc:
        return (None, "resource", f"urn:arc:{arc['at']}", "-", EPOCH.strftime("%Y-%m-%dT%H:%M:%SZ"), "application/octet-stream", b"", block, len(block), hashlib.sha256(block).hexdigest(), ident, arc["rejected"])
    answer = block.startswith(b"HTTP/")
    head, payload = http_parts(block) if answer else (b"", block)
    page = http_fields(head).get(b"x-page-id", b"").decode()
    digest = hashlib.sha256(payload).hexdigest()
    return (int(page) if page.isdigit() or page[:1] == "-" and page[1:].isdigit() else None, "response" if answer else "resource", arc["url"], arc["ip"], date_of(arc["date"]), arc["type"], head, payload, len(payload), digest, ident, None)


# ---- WARC


def warc_record(r: dict) -> bytes:
    revisit = isinstance(r["refers_to_id"], str)
    kind = "revisit" if revisit else r["kind"]
    block = r["http"] if revisit else r["http"] + r["payload"]
    lines = [
        "WARC/1.0",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {r['record_id']}",
        f"WARC-Target-URI: {r['url']}",
        f"WARC-Date: {r['date']}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{r['payload_digest']}",
    ]
    if r["ip"] not in ("-", "0.0.0.0"):
        lines.append(f"WARC-IP-Address: {r['ip']}")
    if kind == "resource":
        lines.append(f"Content-Type: {r['content_type']}")
    else:
        lines += ["Content-Type: application/http; msgtype=response", f"WARC-Identified-Payload-Type: {r['content_type']}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {r['refers_to_id']}"]
    if isinstance(r["rejected"], str):
        lines.append(f"X-Rejected: {r['rejected']}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join([*lines, "", ""]).encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of each record, by declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\r", b"\n"):
            at += 1
            continue
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = int(head["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) < length:
            raise ValueError(f"WARC record at {at} is cut short: {len(block)} of {length} bytes")
        yield head, block
        at = end + 4 + length


def warc_to_row(head: dict[str, str], block: bytes) -> tuple:
    kind, declared = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
    http, payload = (b"", block) if kind == "resource" else http_parts(block)
    fields = http_fields(http)
    size, digest = (int(fields[b"content-length"]), declared) if kind == "revisit" else (len(payload), hashlib.sha256(payload).hexdigest())
    if head["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}" or digest != declared:
        raise ValueError(f"WARC record {head['warc-record-id']} is damaged")
    page = fields.get(b"x-page-id", b"")
    url = head["warc-target-uri"].encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return (int(page) if page else None, head["warc-record-id"], kind, url, head["warc-date"], size, digest, head.get("warc-refers-to"), head.get("x-rejected"))


# ---- Spark


def gathered(records: Iterator, opening, record, limit: int = ARCHIVE_BYTES) -> Iterator[pd.DataFrame]:
    """One row per archive: up to ``limit`` bytes of records, more only where a single record has more."""
    name = f"{uuid.uuid4().hex}"
    parts, size, made = [], 0, 0
    for r in records:
        if not parts:
            parts, size = [opening(f"{name}-{made}")], 0
            made += 1
        parts.append(record(r, size, f"{name}-{made}"))
        size += len(parts[-1])
        if size >= limit:
            yield pd.DataFrame({"archive": [b"".join(parts)]})
            parts = []
    if parts:
        yield pd.DataFrame({"archive": [b"".join(parts)]})


def write_archives(made: DataFrame, path: str) -> None:
    """Every archive becomes a file, compressed. The text writer puts bytes out as they are; the line feed
    that it adds stands between records, where both formats allow it."""
    made.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def write_arc(pages: DataFrame, path: str, version: int = 2) -> None:
    ident = lambda v: None if v is None else int(v)

    def arc(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in zip(batch["page_id"], batch["url"], batch["html"]))
        yield from gathered(rows, lambda name: arc_opening(version, name), lambda row, size, name: arc_record(version, ident(row[0]), row[1], row[2], size, name))

    # As text: pandas has no integer column that holds nulls without rounding the others.
    write_archives(pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), "url", "html").mapInPandas(arc, "archive binary"), path)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def read_archives(files: DataFrame, rows, schema: str) -> DataFrame:
    """``rows`` makes tuples of ``schema`` from a file's path and bytes; one file is unpacked at a time."""
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                found = list(rows(path, gzip.decompress(content)))
                out = pd.DataFrame(found, columns=names, dtype=object)
                out["page_id"] = pd.array([r[0] for r in found], dtype="Int64")
                yield out

    return files.mapInPandas(read, schema)


def read_arc_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of legacy archives, with their file and place in it."""
    return read_archives(archive_files(spark, path), lambda path, data: ((*arc_to_record(r), path, r["at"]) for r in read_arc(data)), RECORD + ", path string, at long")


def revisits(records: DataFrame) -> DataFrame:
    """(path, at, refers_to_id) of the records that revisit another. Digests that occur twice meet their records in
    ``SALTS`` parts, so one that a third of all pages share is no task of its own."""
    seen = records.where((F.col("kind") == "response") & (F.col("payload_bytes") >= LEAST_REVISIT)).select("page_id", "record_id", "payload_digest", "path", "at")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")
    firsts = seen.groupBy("payload_digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1 and not first.none")
    firsts = firsts.select("payload_digest", F.col("first.page_id").alias("first_page"), F.col("first.record_id").alias("refers_to_id"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    salted = seen.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    return salted.join(firsts, ["payload_digest", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("first_page"))).select("path", "at", "refers_to_id")


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Reads legacy archives twice: for the decisions, which are kept, and to write each archive's records anew."""
    scratch = Scratch(spark, "arc")
    meta = read_arc_files(spark, arc_path).select("page_id", "kind", "payload_bytes", "payload_digest", "record_id", "path", "at")
    meta = scratch.keep(meta, "meta")
    decided = revisits(meta).groupBy("path").agg(F.collect_list(F.struct("at", "refers_to_id")).alias("decided"))
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: 2005-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC 1.0\r\n\r\n\r\n"
    names = [f.split(" ")[0] for f in RECORD.split(", ")]

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for batch in batches:
            for content, known in zip(batch["content"], batch["decided"]):
                to = {d["at"]: d["refers_to_id"] for d in known} if known is not None else {}
                for r in read_arc(gzip.decompress(content)):
                    yield dict(zip(names, arc_to_record(r))) | {"refers_to_id": to.get(r["at"])}

    def warc(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from gathered(records(batches), lambda name: info % str(uuid.uuid5(uuid.NAMESPACE_URL, name)).encode(), lambda r, size, name: warc_record(r))

    write_archives(archive_files(spark, arc_path).join(decided, "path", "left").select("content", "decided").mapInPandas(warc, "archive binary"), warc_path)
    scratch.drop(meta)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """All records but warcinfo; refers_to is the page_id of the record that a revisit names, null for others."""
    rows = read_archives(archive_files(spark, path), lambda path, data: (warc_to_row(h, b) for h, b in read_warc(data) if h["warc-type"] != "warcinfo"), READ_BACK)
    rows = Scratch(spark, "warc-read").keep(rows, "rows")  # the archives are unpacked once
    named = rows.where("refers_to_id is not null").select("refers_to_id").distinct()
    targets = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).join(named, "refers_to_id", "left_semi")
    salted = targets.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    revisit = F.col("refers_to_id").isNotNull()
    found = rows.where(revisit).withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int")).join(salted, ["refers_to_id", "salt"], "left").drop("salt")
    return rows.where(~revisit).withColumn("refers_to", F.lit(None).cast("long")).unionByName(found)


def rejected(records: DataFrame) -> DataFrame:
    """(rejected, n, bytes): what could not be read of legacy archives, by reason."""
    return records.where("rejected is not null").groupBy("rejected").agg(F.count("*").alias("n"), F.sum("payload_bytes").alias("bytes"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    arc, warc = scratch.path("arc"), scratch.path("warc")
    write_arc(table(spark, sf_dir, "pages"), arc)
    convert(spark, arc, warc)
    scratch.drop_path(arc)
    read = scratch.keep(read_warc_files(spark, warc), "read")
    scratch.drop_path(warc)
    if lost := rejected(read).collect():
        raise ValueError(f"records of the query's own archives can't be read: {lost}")
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
