"""Operator 6: derivatives of WARC responses: linked metadata and plain-text conversion records, written as WARC members
and read back.

Nulls: a null payload or null headers count as empty, a null id, address or date leaves its field out. Records that are
alike in all they hold are one record and share an id; any difference in payload or address gives another id.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

DATE = "2024-01-01T00:00:00Z"
#: A response as a row: headers are the HTTP status line and headers, body the payload.
RESPONSE = "page_id long, record_id string, target_uri string, date string, headers string, body binary"
DERIVATIVE = (
    "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, refers_to_date string, content_type string, "
    "source_headers string, source_digest string, block_digest string, block_length long, block binary"
)

#: Elements whose content is no text, and elements that end a line. Fixed values.
HIDDEN = frozenset("script style template noscript".split())
BREAKING = frozenset("address article aside blockquote br dd div dl dt footer form h1 h2 h3 h4 h5 h6 head header hr li main nav ol p pre section table td th title tr ul".split())
#: A tag with its attributes: a quote counts after an equals sign alone, and one that is never closed runs to the end of the
#: page, as does a tag. Nothing is tried twice, so a page of any shape takes time in proportion to its length.
_TAG = re.compile(r"""</?([A-Za-z][^\s/>]*+)(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+(?:>|\Z)""")
_OPEN = re.compile(r"<(?=[A-Za-z!?/])").search
_END = {name: re.compile(rf"(?i)</{name}(?=[\s/>])") for name in HIDDEN}
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PAIRS = [a + b for a in _DIGITS for b in _DIGITS]
_CHARSET = re.compile(r"(?i)content-type:[^\r\n]*charset=[\"']?([\w.:-]+)")


def digest(data: bytes) -> str:
    """SHA-1 in base 32, two digits at a time."""
    n = int.from_bytes(hashlib.sha1(data).digest())
    return "sha1:" + "".join([_PAIRS[n >> k & 1023] for k in range(150, -1, -10)])


def record_id(kind: str, *parts: object) -> str:
    """An id made of what a record holds: the same in every run, another for any difference."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([kind, *parts]))}>"


class Instead(dict):
    """What stands for the tags of a name, as it is written: a line end, nothing, or None for a hidden element."""

    def __missing__(self, name: str) -> str | None:
        own = name.lower()
        self[name] = found = None if own in HIDDEN else "\n" if own in BREAKING else ""
        return found


def visible(page: str) -> list[str]:
    """A page's text between tags, in one pass from left to right: comments, declarations and hidden elements are a blank, tags
    of breaking elements a line end, other tags nothing. What is never closed runs to the end of the page. A `<` before
    anything but a letter, a slash, `!` or `?` is text."""
    at, end, out, instead = 0, len(page), [], Instead()
    add, tag_at = out.append, _TAG.match
    while found := _OPEN(page, at):
        start = found.start()
        add(page[at:start])
        if tag := tag_at(page, start):
            at, put = tag.end(), instead[tag[1]]
            if put is None:
                put = " " if page[start + 1] != "/" else ""
                if put:
                    closed = _END[tag[1].lower()].search(page, at)
                    at = closed.start() if closed else end
            add(put)
        else:
            comment = page.startswith("<!--", start)
            closed = page.find("-->", start + 2) if comment else page.find(">", start)
            at = end if closed < 0 else closed + (3 if comment else 1)
            add(" ")
    add(page[at:])
    return out


def plain_text(page: str) -> str:
    """The text of a page: no scripts, styles, comments or tags; block elements end lines; white space is one blank."""
    lines = (" ".join(line.split()) for line in html.unescape("".join(visible(page))).split("\n"))
    return "\n".join(line for line in lines if line)


def decoded(headers: str, body: bytes) -> str:
    """The payload as text, by the charset of its headers (UTF-8 where there is none or it is unknown)."""
    found = _CHARSET.search(headers)
    try:
        return body.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def derivatives_of(page_id: int | None, rid: str | None, uri: str | None, date: str | None, headers: str | None, body: bytes | None) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    headers, body = headers or "", body or b""
    block = headers.encode() + body
    source, payload = digest(block), digest(body)
    facts = [line.split(":", 1) for line in headers.split("\r\n")[1:] if ":" in line]
    fields = [("http-status", (headers.split("\r\n")[0].split(" ") + [""])[1]), ("payload-digest", payload), ("payload-length", str(len(body)))] + [(f"http-{k.strip().lower()}", v.strip()) for k, v in facts]
    metadata = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    text = plain_text(decoded(headers, body)).encode()
    out = []
    for kind, content, own in (("metadata", "application/warc-fields", metadata), ("conversion", "text/plain; charset=utf-8", text)):
        out.append((page_id, kind, record_id(kind, rid, uri, source), rid, uri, date, date, content, headers, source, digest(own), len(own), own))
    return out


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of crawled pages (page_id, url, html); a null html has an empty payload. The payload is part of what
    a record's id is made of. Extra columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, page in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                body = (page or "").encode()
                headers = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
                rows.append((page_id, record_id("response", page_id, url, digest(body)), url, date, headers, body))
            yield _batch(rows, RESPONSE)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, RESPONSE)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.record_batch({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def derive(records: DataFrame) -> DataFrame:
    """Two records, metadata and conversion, of each response; they carry its id, headers and digest. Repeated responses give
    repeated records; a response without an id gives records that refer to none. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows += derivatives_of(*row)
                size += len(row[-1] or b"")
                if size > 1 << 23:
                    yield _batch(rows, DERIVATIVE)
                    rows, size = [], 0
            yield _batch(rows, DERIVATIVE)

    names = [f.split(" ")[0] for f in RESPONSE.split(", ")]
    return records.select(*names).mapInArrow(run, DERIVATIVE)


_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def warc_record(kind: str, rid: str | None, uri: str | None, date: str | None, content: str, block: bytes, more: dict[str, str | None]) -> bytes:
    """A record as it stands in a WARC/1.1 file. Control characters in a field are percent-encoded, empty fields are left out."""
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Target-URI": uri, "WARC-Date": date, "Content-Type": content, "Content-Length": str(len(block)), "WARC-Block-Digest": digest(block)} | more
    lines = "".join(f"{k}: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', v)}\r\n" for k, v in head.items() if v)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def warc_bytes(kind: str, rid: str | None, uri: str | None, date: str | None, content: str, block: bytes, more: dict[str, str | None]) -> bytes:
    """A record, compressed as a gzip member of its own."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(warc_record(kind, rid, uri, date, content, block, more)) + packer.flush()


def as_warc(derived: DataFrame, make: Callable[..., bytes] = warc_bytes) -> DataFrame:
    """(record_id, member): each derivative as a gzip member; members one after another are a WARC file. What WARC has no
    field for stands in extension fields: the page, the source's digest, and its headers as JSON text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                more = {
                    "WARC-Refers-To": r["refers_to"], "WARC-Refers-To-Target-URI": r["target_uri"], "WARC-Refers-To-Date": r["refers_to_date"],
                    "X-Page-ID": None if r["page_id"] is None else str(r["page_id"]), "X-Source-Digest": r["source_digest"], "X-Source-Headers": json.dumps(r["source_headers"] or ""),
                }
                rows.append((r["record_id"], make(r["record_type"], r["record_id"], r["target_uri"], r["date"], r["content_type"], r["block"] or b"", more)))
            yield _batch(rows, "record_id string, member binary")

    return derived.mapInArrow(run, "record_id string, member binary")


def write_warc(derived: DataFrame, path: str) -> int:
    """Write derivatives as WARC files, part-*.warc.gz, a file a partition, each compressed as a whole; how many files there
    are. Spark writes them, so path may be in any store that it reaches; what is there already is an error."""
    spark = derived.sparkSession
    # A record's last line end is the one that the text writer adds.
    lines = as_warc(derived, warc_record).select(F.expr("substring(member, 1, length(member) - 1)").cast("string").alias("value"))
    lines.write.option("compression", "gzip").option("lineSep", "\n").text(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().endswith(".txt.gz")]
    for name in names:
        fs.rename(name, spark._jvm.org.apache.hadoop.fs.Path(at, name.getName().removesuffix(".txt.gz") + ".warc.gz"))
    return len(names)


def read_derivatives(spark: SparkSession, path: str) -> DataFrame:
    """The derivatives in WARC files, as from_warc gives them."""
    return from_warc(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select(F.col("content").alias("member")))


def from_warc(members: DataFrame) -> DataFrame:
    """The derivatives in WARC data (member: a record or several), as derive gives them; block_digest is that of the block
    as read, and intact tells whether it is the one in the record's header."""
    schema = DERIVATIVE + ", intact boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for member in batch.column(0).to_pylist():
                for h, block in records_in(member or b""):
                    if h.get("warc-type") in ("metadata", "conversion"):
                        page, own = h.get("x-page-id"), digest(block)
                        rows.append((
                            None if page is None else int(page), h["warc-type"], h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-refers-to-date"),
                            h.get("content-type"), json.loads(h.get("x-source-headers", '""')), h.get("x-source-digest"), own, len(block), block, own == h.get("warc-block-digest"),
                        ))
            yield _batch(rows, schema)

    return members.select("member").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """The derivatives of crawled pages, written as WARC members to the shared folder and read back: two rows a page. An empty
    table gives no row."""
    return from_warc(written(as_warc(derive(responses(pages))), "warc"))


def records_in(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a WARC file, compressed by record or not at all. Records are
    inflated one after another, so no more than one is held beside the file."""
    f = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        f = gzip.GzipFile(fileobj=f)
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = {}
        while line := f.readline().strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        length = head.get("content-length", "")
        yield head, f.read(int(length) if length.isdecimal() else 0)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of the WARC files at path, through Spark's reader, which takes files of up to 2 GB; a file is one
    task's work, and its rows leave in batches. page_id is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for head, block in records_in(data.as_py() or b""):
                    if head.get("warc-type") == "response":
                        headers, gap, body = block.partition(b"\r\n\r\n")
                        rows.append((None, head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), (headers + gap).decode("utf-8", "replace"), body))
                        size += len(body)
                    if size > 1 << 23:
                        yield _batch(rows, RESPONSE)
                        rows, size = [], 0
                yield _batch(rows, RESPONSE)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RESPONSE)
