"""WARC derivatives: each response record becomes a linked metadata record and a plain-text conversion record.

A response is a row (source id, record id, target URI, date, HTTP block, source headers). Its conversion record holds the page's
text; its metadata record holds what was learned from the response (status, content type, charset, title, language, outlinks) and
the source's own headers. Both refer to the response (``WARC-Refers-To``, ``-Target-URI``, ``-Date``) and name each other; block
digests are of the new blocks and ``WARC-Source-Payload-Digest`` keeps the source's own payload digest, or, where its headers have none, names that of
the payload as it was sent. Chunked transfers and gzip, deflate and zstd encodings are undone before the text is read. Record ids are hashed from source id and
role, so a task run again makes the same records. Every row is worked alone: no shuffle, memory of one batch.

Cases. Null id: hashed as empty text, kept as null. Null URL: an empty target URI. Null HTML: an empty payload, whose conversion is
empty. A block without an HTTP header end: all header, no payload. Bytes that the charset cannot hold: replaced. An encoding that is broken or not
known: what could be decoded, else the payload as it is. Markup is read in one pass, so the time is linear in a page's length; comments, scripts
and tags without an end are text or tags as far as they go. Repeated rows: the same records each. Very long pages: whole, worked by slices of bounded bytes.
Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as html_entities
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common

CRAWL_DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"
RESPONSE = "source_id {id}, record_id string, target_uri string, date string, source_headers string, block binary"
DERIVED = (
    "source_id {id}, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string,"
    " content_length long, block_digest string, source_payload_digest string, header string, block binary"
)
_BLOCKS = frozenset(
    "p div br hr li ul ol dl dt dd tr table thead tbody section article header footer nav aside main h1 h2 h3 h4 h5 h6 pre blockquote form figure figcaption option title".split()
)
_RAW = frozenset(("script", "style", "noscript", "template"))
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9]*)")
_BREAK = re.compile(r"[\r\n]+")
_SPACE = re.compile(r"[^\S\n]+")
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_META = re.compile(r"<meta\b[^>]*charset\s*=\s*[\"']?([\w-]+)", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NUMERIC = re.compile(r"&#0*([0-9]*);?")
#: Bytes of payloads in a batch that is sent on.
OUT_BYTES = 4 << 20


def digest(data: bytes) -> str:
    """A WARC digest: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uuid(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1('|'.join(parts).encode()).digest()[:16], version=5)}>"


def unescape(text: str) -> str:
    """Entities resolved; numbers beyond any character, however long, are one replacement character."""
    if "&" not in text:
        return text
    return html_entities.unescape(_NUMERIC.sub(lambda m: m.group() if len(m.group()) < 12 else "\ufffd" if len(m.group(1)) > 7 else f"&#{m.group(1) or 0};", text))


class Markup:
    """A page read once from left to right: text, and tags as (name, start, end), names of end tags with ``/``."""

    def __init__(self, markup: str, dropped: frozenset[str]) -> None:
        self.markup, self.lower, self.dropped = markup, markup.lower(), dropped
        if len(self.lower) != len(markup):  # some letters have longer lower-case forms
            self.lower = "".join(c.lower() if c.isascii() else c for c in markup)
        self.last_close, self.last_comment = markup.rfind(">"), markup.rfind("-->")
        self.without_end: set[str] = set()

    def _end_of(self, name: str, at: int) -> int:
        """Past the end tag of an element whose contents are left out, or -1."""
        if name in self.without_end:
            return -1
        while (at := self.lower.find(f"</{name}", at)) >= 0:
            end = at + 2 + len(name)
            while end < len(self.lower) and self.lower[end].isspace():
                end += 1
            if self.lower[end : end + 1] == ">":
                return end + 1
            at = end
        self.without_end.add(name)
        return -1

    def __iter__(self) -> Iterator[tuple[str | None, int, int]]:
        """(None, start, end) of text, ("", start, end) of what is left out, (name, start, end) of tags."""
        markup, text, at = self.markup, 0, self.markup.find("<")
        while 0 <= at <= self.last_close:
            end, name, after = -1, "", markup[at + 1 : at + 2]
            if after == "!" and markup.startswith("!--", at + 1) and at + 4 <= self.last_comment:
                end = markup.find("-->", at + 4) + 3
            elif after.isascii() and (after.isalpha() or after in ("/", "!", "?")):
                end = markup.find(">", at) + 1
                m = _NAME.match(markup, at + 1)
                if m:
                    own = m.group(1).lower()
                    name = "/" + own if after == "/" else own
                    if own in self.dropped and after != "/" and (past := self._end_of(own, end)) >= 0:
                        end, name = past, ""
            if end < 0:
                at = markup.find("<", at + 1)
                continue
            if at > text:
                yield None, text, at
            yield name, at, end
            text, at = end, markup.find("<", end)
        if text < len(markup):
            yield None, text, len(markup)


_NO_TEXT = _RAW | {"head"}


def page_text(markup: str) -> str:
    """The text of a page, a line for each block."""
    out = []
    for name, start, end in Markup(markup, _NO_TEXT):
        if name is None:
            out.append(markup[start:end])
        elif not name:
            out.append(" ")
        elif name.lstrip("/") in _BLOCKS:
            out.append("\n")
    lines = (_SPACE.sub(" ", x).strip() for x in unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x)


def page_facts(markup: str) -> tuple[str, str, list[str]]:
    """Title, language and outlinks."""
    title, open_at, lang, links = None, None, "", []
    for name, start, end in Markup(markup, _RAW):
        if name == "title" and open_at is None:
            open_at = end
        elif name == "/title" and open_at is not None and title is None:
            title = markup[open_at:start]
        elif name == "html" and not lang:
            lang = m.group(1).lower() if (m := _LANG.search(markup, start, end)) else ""
        elif name == "a" and (m := _HREF.search(markup, start, end)):
            links.append(unescape(next(filter(None, m.groups()), "")))
    return _SPACE.sub(" ", unescape(title or "")).strip(), lang, links


def split_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers by lower-case name, payload."""
    head, _, body = block.partition(b"\r\n\r\n")
    first, *rest = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}, body


def _unchunked(body: bytes) -> bytes:
    """The contents of a chunked transfer; a body that is none stays as it is, a broken one ends where it breaks."""
    view, out, at = memoryview(body), [], 0
    while True:
        line = body.find(CRLF, at, at + 1024)
        size = bytes(view[at:line]).split(b";")[0].strip() if line >= 0 else b""
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            return b"".join(out) if out else body
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(view[line + 2 : line + 2 + n])
        at = line + 2 + n
        if body[at : at + 2] == CRLF:
            at += 2


def _inflated(body: bytes, coding: str) -> bytes:
    """The body without its coding; a broken one as far as it goes, one of another coding as it is."""
    if coding == "zstd":
        engines = [zstandard.ZstdDecompressor().decompressobj]
    elif coding in ("gzip", "x-gzip"):
        engines = [lambda: zlib.decompressobj(47)]
    elif coding == "deflate":
        engines = [zlib.decompressobj, lambda: zlib.decompressobj(-15)]
    else:
        return body
    for engine in engines:
        out, rest = [], body
        try:
            while rest:
                one = engine()
                for lo in range(0, len(rest), 1 << 16):
                    out.append(one.decompress(rest[lo : lo + (1 << 16)]))
                    if one.unused_data:
                        rest = one.unused_data + rest[lo + (1 << 16) :]
                        break
                else:
                    break
        except (zlib.error, zstandard.ZstdError):
            pass
        if data := b"".join(out):
            return data
    return body


def decoded_payload(headers: dict[str, str], body: bytes) -> bytes:
    """The payload without transfer and content encodings."""
    if "chunked" in headers.get("transfer-encoding", "").lower():
        body = _unchunked(body)
    for coding in reversed(headers.get("content-encoding", "").lower().split(",")):
        body = _inflated(body, coding.strip())
    return body


def decode_body(body: bytes, content_type: str) -> tuple[str, str]:
    """The payload as text, and the charset used."""
    m = re.search(r"charset=[\"']?([\w-]+)", content_type, re.I) or _META.search(body[:4096].decode("ascii", "replace"))
    name = m.group(1).lower() if m else "utf-8"
    try:
        text = body.decode(name, "replace")
        return (text, name) if isinstance(text, str) else (body.decode("utf-8", "replace"), "utf-8")
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace"), "utf-8"


def warc_header(fields: list[tuple[str, str]]) -> str:
    """Header lines; values lose line breaks, so that none can forge a field."""
    return "WARC/1.1\r\n" + "".join(f"{k}: {_BREAK.sub(' ', v)}\r\n" for k, v in fields)


def derive_one(record_id: str, uri: str, date: str, source_headers: str, block: bytes) -> list[dict]:
    """The metadata and the conversion record of one response."""
    status, headers, body = split_http(block)
    markup, charset = decode_body(decoded_payload(headers, body), headers.get("content-type", ""))
    text = page_text(markup).encode("utf-8", "replace")
    heads = [x for x in source_headers.split("\n") if x]
    own = next((v.strip() for k, _, v in (x.partition(":") for x in heads) if k.strip().lower() == "warc-payload-digest"), "")
    source_digest = own or digest(body)
    ids = {k: record_uuid(record_id, k) for k in ("metadata", "conversion")}
    title, lang, links = page_facts(markup)
    known = [("status", status), ("content-type", headers.get("content-type", "")), ("charset", charset), ("title", title), ("language", lang), ("conversion", ids["conversion"])]
    known += [("source-header", x) for x in heads]
    known += [("outlink", x) for x in links]
    fields = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in known).encode("utf-8", "replace")
    out = []
    for kind, kind_type, data, other in (("metadata", "application/warc-fields", fields, "conversion"), ("conversion", "text/plain; charset=utf-8", text, "metadata")):
        header = warc_header([
            ("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", record_id),
            ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Concurrent-To", ids[other]),
            ("WARC-Source-Payload-Digest", source_digest), ("WARC-Block-Digest", digest(data)), ("Content-Type", kind_type), ("Content-Length", str(len(data))),
        ])
        out.append({
            "record_type": kind, "record_id": ids[kind], "refers_to": record_id, "target_uri": uri, "date": date, "content_type": kind_type, "content_length": len(data),
            "block_digest": digest(data), "source_payload_digest": source_digest, "header": header, "block": data,
        })
    return out


def member(header: str, block: bytes) -> bytes:
    """A record as one gzip member; members one after another are a WARC file."""
    return gzip.compress(header.encode() + CRLF + block + CRLF + CRLF, 6, mtime=0)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file, plain or gzip by member."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data))
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip()] = value.strip()
        size = fields.get("Content-Length", "0")
        yield fields, stream.read(int(size) if size.isascii() and size.isdigit() and len(size) < 16 else 0)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files. A file (of at most 2 GB, as Spark reads it) is one task's, and its records go on by bounded batches."""
    kinds = [pa.string()] * 5 + [pa.binary()]

    def packed(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["source_id", "record_id", "target_uri", "date", "source_headers", "block"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for h, block in parse(data.as_buffer().to_pybytes()):
                    if h.get("WARC-Type") == "response":
                        rows.append([h.get("WARC-Record-ID"), h.get("WARC-Record-ID"), h.get("WARC-Target-URI"), h.get("WARC-Date"), "\n".join(f"{k}: {v}" for k, v in h.items()), block])
                        held += len(block)
                        if held >= OUT_BYTES:
                            yield packed(rows)
                            rows, held = [], 0
                yield packed(rows)

    return spark.read.format("binaryFile").load(path).select("content").transform(common.in_arrow, records, RESPONSE.format(id="string"))


def page_responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = CRAWL_DATE) -> DataFrame:
    """Response records for a table of pages."""
    source = pages.select(F.col(id_col).alias("source_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in common.slices(b, 2)):
            ids, urls, blocks, headers = [], [], [], []
            for i, url, page in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                body = (page or "").encode()
                ids.append(record_uuid("response", "" if i is None else str(i), url or ""))
                urls.append(url or "")
                blocks.append(b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body)
                headers.append(f"WARC-Type: response\nWARC-Record-ID: {ids[-1]}\nWARC-Payload-Digest: {digest(body)}")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.string()), pa.array(urls, pa.string()), pa.array([date] * len(ids), pa.string()), pa.array(headers, pa.string()), pa.array(blocks, pa.binary())],
                ["source_id", "record_id", "target_uri", "date", "source_headers", "block"],
            )

    return source.transform(common.in_arrow, wrap, RESPONSE.format(id=source.schema["source_id"].dataType.simpleString()))


def derive(responses: DataFrame) -> DataFrame:
    """Two rows per response, with the columns of :data:`DERIVED`."""
    source = responses.select("source_id", "record_id", "target_uri", "date", "source_headers", "block")
    schema = DERIVED.format(id=source.schema["source_id"].dataType.simpleString())
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [None, *[pa.string()] * 6, pa.int64(), *[pa.string()] * 3, pa.binary()]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows go out by slices: a batch's pages and their records need not be in memory together.
        for part in (x for b in batches for x in common.slices(b, 5)):
            kinds[0] = part.column(0).type
            rows = []
            for i, rid, uri, date, heads, block in zip(*(part.column(k).to_pylist() for k in range(6)), strict=True):
                rows += [{"source_id": i, **r} for r in derive_one(rid or record_uuid("response", "", uri or ""), uri or "", date or "", heads or "", block or b"")]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    return source.transform(common.in_arrow, build, schema)


def save(records: DataFrame, directory: str) -> DataFrame:
    """Writes a WARC file per partition into a directory that all executors reach; returns path, records and bytes of each.

    A file gets its final name when it is whole, and a task run again replaces it.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(directory)
        store.create_dir(root, recursive=True)
        final = f"{root}/part-{context.partitionId():05d}.warc.gz"
        draft = f"{final}.{context.taskAttemptId()}"
        n = size = 0
        with store.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for header, block in zip(batch.column(0), batch.column(1), strict=True):
                    out.write(data := member(header.as_py(), block.as_py()))
                    n, size = n + 1, size + len(data)
        store.move(draft, final)
        yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

    return records.select("header", "block").transform(common.in_arrow, write, "path string, records long, bytes long")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(page_responses(common.table(spark, sf_dir, "pages")))
