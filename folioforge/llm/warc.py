"""WARC 1.1 records, and the derivatives of response records.

A response (HTTP headers and body) gives more records that refer to it: a metadata
record (JSON: status, HTTP headers, title, links, digests of the source) and, if it is
text, a conversion record (plain text). Record ids come from the source's id, so a rerun
gives the same records and a task that runs twice does no harm.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import id_type, table

VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
RECORDS = "type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, headers string, block binary"

_HIDDEN = re.compile(r"<!--|<(script|style|noscript|template|svg)\b[^<>]*>", re.I)
_NESTED = ("svg", "template")
#: What ends an element that is not shown; in those that nest, also what opens another, and comments.
_CLOSING = {n: re.compile(rf"</{n}", re.I) for n in ("script", "style", "noscript", "template", "svg")}
_INNER = {n: re.compile(rf"<!--|</{n}(?=[\s/>])|<{n}\b[^<>]*>", re.I) for n in _NESTED}
_BREAK = re.compile(r"<(?:/?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|thead|tbody|article|section|header|footer|nav|main|aside|blockquote|pre|figure|form|title|head|body|option)(?=[\s/>]))[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<[!?][^<>]*>")
_CELL = re.compile(r"<t[dh](?=[\s/>])[^<>]*>", re.I)
_LINK = re.compile(r"<(a|area|link|img|script|iframe|source|embed|form)\s([^<>]*)>", re.I)
_WHERE = re.compile(r"(?:^|\s)(href|src|action)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TITLE = re.compile(r"<title(?=[\s>])[^<>]*>([^<]*)", re.I)
#: The head of a record, and where the next may begin.
_HEAD = re.compile(rb"WARC/\d[^\r\n]*\r?\n(?:[^\r\n]+\r?\n)*\r?\n")
_NEXT = re.compile(rb"\nWARC/\d")
#: Bytes of blocks that are sent on at once.
PART = 4 << 20
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def http_split(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, body) of an HTTP response; a block without a header part is all body."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        head, gap, body = block.partition(b"\n\n")
    lines = head.decode("latin-1").splitlines()
    return lines[0], [(k.strip(), v.strip()) for k, c, v in (x.partition(":") for x in lines[1:]) if c], body


def decoded(body: bytes, content_type: str) -> str:
    """Text of a body by the charset of its header, else of its first 1,024 bytes, else UTF-8; bad bytes are replaced."""
    found = _CHARSET.search(content_type.encode("latin-1", "replace")) or _CHARSET.search(body[:1024])
    try:
        return body.decode(found[1].decode() if found else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _dechunked(body: bytes) -> bytes | None:
    """A body without the sizes of its chunks; none if they are not right."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0 or end + 2 + size > len(body):
            return None
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def payload(headers: list[tuple[str, str]], body: bytes) -> bytes | None:
    """A body without its transfer and content encodings; none if one is not known or the body is not in it.

    A body that says it is chunked and is not counts as stored without its chunks, as some tools do.
    """
    said = lambda name: [x.strip().lower() for k, v in headers if k.lower() == name for x in v.split(",") if x.strip()]
    for coding in reversed([*said("content-encoding"), *said("transfer-encoding")]):
        if coding == "chunked":
            plain = _dechunked(body)
            body = body if plain is None else plain
        elif coding in ("gzip", "x-gzip", "deflate", "zstd"):
            try:
                if coding == "zstd":
                    body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                elif coding == "deflate" and body[:1] and (body[0] & 15 != 8 or int.from_bytes(body[:2], "big") % 31):
                    body = zlib.decompressobj(-15).decompress(body)
                else:
                    body = zlib.decompressobj(47).decompress(body)
            except (zlib.error, zstandard.ZstdError):
                return None
        elif coding != "identity":
            return None
    return body


#: How a page of HTML begins: a doctype or one of the elements that open it, after space and comments.
_PAGE = re.compile(r"(?is)\ufeff?(?:\s|<!--.*?-->|<\?xml[^>]*>)*<(?:!doctype\s+html|html|head|body|title|meta|div|p|h1|table|a)\b")


def is_text(content_type: str, body: bytes) -> bool:
    """By its media type; without one, by its first bytes."""
    kind = content_type.partition(";")[0].strip().lower()
    if not kind:
        return b"\x00" not in body[:1024]
    return kind.startswith("text/") or kind.endswith(("+xml", "/xml", "+json", "/json", "/javascript"))


def is_html(content_type: str, text: str) -> bool:
    """HTML or XHTML by its media type; without one, by how the text begins."""
    kind = content_type.partition(";")[0].strip().lower()
    return kind in ("text/html", "application/xhtml+xml") or (not kind and bool(_PAGE.match(text)))


def _shown(text: str) -> str:
    """HTML without comments and elements that are not shown. An element that is not closed hides the rest of the text.

    An svg that closes itself is empty, also inside another; svg and template end where as many are closed as opened.
    The others hold text only, and in them a slash before the end of a tag means nothing, as in browsers.
    """
    out, at = [], 0
    for m in iter(lambda: _HIDDEN.search(text, at), None):
        out.append(text[at : m.start()])
        if m[1] is None:
            end = text.find("-->", m.end())
            at = end + 3 if end >= 0 else len(text)
            continue
        name, at = m[1].lower(), m.end()
        if name == "svg" and m[0].endswith("/>"):
            continue
        depth = 1
        while depth:
            tag = (_INNER if name in _NESTED else _CLOSING)[name].search(text, at)
            if not tag:
                at = len(text)
                break
            at = tag.end()
            if tag[0].startswith("<!--"):
                end = text.find("-->", at)
                at = end + 3 if end >= 0 else len(text)
            elif tag[0].startswith("</"):
                depth -= 1
                close = text.find(">", at)
                at = close + 1 if close >= 0 else len(text)
            elif not (name == "svg" and tag[0].endswith("/>")):
                depth += 1
    out.append(text[at:])
    return " ".join(out) if len(out) > 1 else out[0]


def plain_text(page: str) -> str:
    """What a page shows, a block on each line, white space collapsed."""
    text = _TAG.sub("", _CELL.sub(" ", _BREAK.sub("\n", _shown(page))))
    if "&" in text:
        text = html.unescape(text)
    return "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x)


def links(page: str, base: str) -> list[dict[str, str]]:
    """Links of a page in order, made absolute; what is no address is left as it is."""
    out = []
    for m in _LINK.finditer(page):
        w = _WHERE.search(m[2])
        if w:
            url = html.unescape(next(x for x in w.groups()[1:] if x is not None).strip())
            try:
                url = urljoin(base, url)
            except ValueError:
                pass
            out.append({"path": f"{m[1].lower()}@{w[1].lower()}", "url": url})
    return out


def serialized(type_: str, id_: str, uri: str | None, date: str, content_type: str, block: bytes, more: list[tuple[str, str]] = ()) -> bytes:
    """One record as bytes."""
    fields = [("WARC-Type", type_), ("WARC-Record-ID", id_), ("WARC-Date", date), *([("WARC-Target-URI", uri)] if uri else []), *more, ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    head = VERSION + "\r\n" + "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in fields)
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """``(id, record_id, target_uri, date, block)``: a response record for each row of a page table, in SQL functions.

    A null page is an empty body; a null address stays null. The record's id comes from the row's id, address and page,
    so rows that repeat share it.
    """
    body = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    head = F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")), "UTF-8")
    key = F.sha2(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col).cast("string"), F.lit("")), F.coalesce(F.col(html_col).cast("string"), F.lit(""))), 256)
    urn = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.substring(key, 1, 32), "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-5$3-8$4-$5"), F.lit(">"))
    return pages.select(F.col(id_col).alias("id"), urn.alias("record_id"), F.col(url_col).cast("string").alias("target_uri"), F.lit(date).alias("date"), F.concat(head, body).alias("block"))


def derived_records(id_: str, uri: str | None, date: str, block: bytes) -> list[tuple]:
    """The metadata and, for text, the conversion record of one response, as rows of RECORDS.

    Digests are of the bytes as they are stored; text and links are of the body without its encodings. What is no text
    or can't be decoded has metadata only, without title and links. Only HTML is read as such: the conversion of plain
    text, JSON, XML or scripts is all of their text as it is, and they have no title or links.
    """
    status, headers, body = http_split(block)
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    plain = payload(headers, body)
    text = decoded(plain, kind) if plain is not None and is_text(kind, plain) else None
    page = text if text is not None and is_html(kind, text) else ""
    title, source = _TITLE.search(page), (digest(block), digest(body))
    envelope = {
        "http": {"status": status, "headers": [[k, v] for k, v in headers]},
        "source": {"record_id": id_, "block_digest": source[0], "payload_digest": source[1], "payload_length": len(body)},
        "html": {"title": " ".join(html.unescape(title[1]).split()) if title else None, "links": links(page, uri or "")},
    }
    out = []
    made = [("metadata", "application/json", json.dumps(envelope, ensure_ascii=False, separators=(",", ":")).encode())]
    if text is not None:
        made.append(("conversion", "text/plain; charset=utf-8", (plain_text(page) if page else text).encode("utf-8", "replace")))
    for type_, content_type, data in made:
        own = digest(data)
        more = [("WARC-Refers-To", id_), *([("WARC-Refers-To-Target-URI", uri)] if uri else []), ("WARC-Refers-To-Date", date), ("WARC-Block-Digest", own), ("WARC-Source-Payload-Digest", source[1])]
        out.append((type_, record_id(id_, type_), id_, uri, date, content_type, own, source[1], json.dumps(more), data))
    return out


def derive(records: DataFrame) -> DataFrame:
    """``(id, *RECORDS)``: metadata and, for text, conversion, for each row of ``records(id, record_id, target_uri, date, block)``.

    Null blocks are empty ones. headers is the JSON list of further WARC fields.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                of, rows = [], []
                for i, (id_, uri, date, block) in enumerate(zip(*(part.column(k).to_pylist() for k in range(1, 5)), strict=True)):
                    got = derived_records(id_ or "", uri, date or DATE, block or b"")
                    rows += got
                    of += [i] * len(got)
                cols = list(zip(*rows, strict=True))
                yield pa.record_batch([part.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, pa.binary() if n == "block" else pa.string()) for n, c in zip(names, cols, strict=True))], names=["id", *names])

    return records.select("id", "record_id", "target_uri", "date", "block").mapInArrow(run, f"id {id_type(records, 'id')}, {RECORDS}")


def members(records: DataFrame) -> DataFrame:
    """``(record_id, member)``: rows of RECORDS as gzip members; joined in any order they are a .warc.gz file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            body = [gzip.compress(serialized(r["type"], r["record_id"], r["target_uri"], r["date"], r["content_type"], r["block"] or b"", [tuple(x) for x in json.loads(r["headers"] or "[]")]), 6, mtime=0) for r in rows]
            yield pa.record_batch([batch.column(batch.schema.get_field_index("record_id")), pa.array(body, pa.binary())], names=["record_id", "member"])

    return records.select(*(x.split()[0] for x in RECORDS.split(", "))).mapInArrow(run, "record_id string, member binary")


def write_files(records: DataFrame, folder: str) -> None:
    """A .warc.gz file for each partition, by pyarrow's file systems; a rerun of a task writes the same name again."""
    from pyarrow import fs

    def run(rows) -> None:
        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        name = f"{path}/part-{TaskContext.get().partitionId():05d}.warc.gz"
        with where.open_output_stream(f"{name}.{TaskContext.get().taskAttemptId()}.tmp", compression=None) as f:
            for r in rows:
                f.write(bytes(r.member))
        where.move(f"{name}.{TaskContext.get().taskAttemptId()}.tmp", name)

    members(records).foreachPartition(run)


def _member(data: memoryview, at: int) -> tuple[bytes, int]:
    """What the gzip member at a place holds, and where it ends."""
    one, out = zlib.decompressobj(31), []
    while at < len(data):
        some = data[at : at + (1 << 16)]
        out.append(one.decompress(some))
        at += len(some)
        if one.eof:
            return b"".join(out), at - len(one.unused_data)
    raise zlib.error("the member does not end")


def _inflated(data: bytes) -> Iterator[tuple[bool, bytes]]:
    """(readable, bytes) of gzip members in a row; after bytes that are none, reading goes on at the next member."""
    at, good = 0, []
    while at < len(data):
        try:
            piece, at = _member(memoryview(data), at)
            good.append(piece)
        except zlib.error:
            found = data.find(b"\x1f\x8b\x08", at + 1)
            end = found if found >= 0 else len(data)
            if good:
                yield True, b"".join(good)
            good = []
            yield False, data[at:end]
            at = end
    if good:
        yield True, b"".join(good)


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while True:
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if at >= len(data):
            return
        head = _HEAD.match(data, at)
        fields: dict[str, str] = {}
        for line in head[0].splitlines()[1:] if head else ():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        size = fields.get("content-length", "")
        if head and size.isascii() and size.isdigit() and head.end() + int(size) <= len(data):
            at = head.end() + int(size)
            yield fields, data[head.end() : at]
            continue
        found = _NEXT.search(data, at)
        end = found.start() + 1 if found else len(data)
        yield {}, data[at:end]
        at = end


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a .warc or .warc.gz file.

    Bytes that are no whole record come as a block without fields, and reading goes on at the next record or member.
    """
    for readable, piece in _inflated(data) if data[:2] == b"\x1f\x8b" else [(True, data)]:
        if readable:
            yield from _records(piece)
        else:
            yield {}, piece


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(type, record_id, refers_to, target_uri, date, content_type, block_digest, block)`` of all records in WARC files.

    Bytes that are no record are rows with a null type. A file is read as one value, so it must be under 2 GB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "content-type", "warc-block-digest"]
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in parsed(content.as_py() or b""):
                    rows.append((*(fields.get(n) for n in names), block))
                    size += len(block)
                    if size > PART or len(rows) == 1024:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.record_batch([*(pa.array(c, pa.string()) for c in cols[:-1]), pa.array(cols[-1], pa.binary())], names=["type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest", "block"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("content").mapInArrow(run, "type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, block binary")


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """The metadata and conversion record of each page: ids, digests and lengths."""
    out = derive(responses(table(spark, sf_dir, "pages")))
    return out.select(F.col("id").alias("page_id"), F.col("type").alias("record_type"), "record_id", "refers_to", "target_uri", "content_type", "block_digest", "payload_digest", F.octet_length("block").cast("long").alias("content_length"))
