"""Derivatives of web archive responses: metadata and plain-text conversion records, linked to their response.

A response is a row: record_id, target_uri, warc_date, http_headers (text, status line and all) and payload (bytes, or text). Each
gives a record of type metadata (title, links and the source's own headers) and, if its payload is HTML or other text, one of type
conversion (its text). Both carry the response's id, URI and date as what they refer to, the source's header lines in their order,
the digest of the payload that they come from, and digests of their own block.

`read_archives` makes such rows from archive files and `write_archives` makes archive files from records, a file a task.
"""

from __future__ import annotations

import gzip
import hashlib
import html as entities
import json
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from io import BufferedReader

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIDDEN = ("script", "style", "noscript", "template")
BREAKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table td th title tr ul".split())
LINKS = frozenset(("a", "area", "link"))

_START = re.compile(r"<(?:(?P<comment>!--)|[!?]|(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9]*))")
_END = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_CLOSE = {name: re.compile(rf"</{name}\b[^>]*+>", re.I) for name in HIDDEN}
_HREF = re.compile(r"(?:^|[\s\"'/])href\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))", re.I)
_HUGE = re.compile(r"&#[0-9]{9,}+;?")
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*+")
_CHARSET = re.compile(r"charset\s*+=\s*+[\"']?([\w.:-]+)", re.I)
_DECLARED = re.compile(rb"(?:<meta\b[^>]*?\bcharset|<\?xml\b[^>]*?\bencoding)\s*+=\s*+[\"']?\s*+([\w.:-]+)", re.I)
#: Bytes in which a page may declare its charset, and of the largest body that is read decoded.
DECLARED, LARGEST = 2048, 256_000_000

RESPONSE = "record_id string, target_uri string, warc_date string, http_headers string, payload binary, payload_digest string"
RECORD = (
    "record_id string, record_type string, refers_to string, refers_to_target_uri string, refers_to_date string, target_uri string, warc_date string, "
    "content_type string, content_length long, block_digest string, source_payload_digest string, source_headers string, block string"
)


# Pages


def page(html: str) -> tuple[str | None, list[str], str]:
    """(title, links, visible text) in one pass from front to back.

    Scripts, styles and comments are out, block elements stand on lines of their own, entities are resolved. What is never closed
    hides the rest (comments, scripts), or is text (a tag).
    """
    out: list[str] = []
    links: list[str] = []
    title, title_from, at = None, None, 0
    while start := _START.search(html, at):
        out.append(html[at : start.start()])
        if start["comment"]:
            end = html.find("-->", start.end())
            out.append(" ")
            at = end + 3 if end >= 0 else len(html)
            continue
        whole = _END.match(html, start.end())
        end = whole.end() if whole else html.find(">", start.end()) + 1
        if not end:
            at = start.start()
            break
        name, opens, at = (start["name"] or "").lower(), not start["close"], end
        if opens and name in _CLOSE:
            close = _CLOSE[name].search(html, end)
            out.append(" ")
            at = close.end() if close else len(html)
            continue
        if opens and name in LINKS and (href := _HREF.search(html, start.end(), end - 1)):
            links.append(unescaped(href[1] or href[2] or href[3] or ""))
        if name == "title" and title is None:
            if opens:
                title_from = len(out)
            elif title_from is not None:
                title = _BLANKS.sub(" ", unescaped("".join(out[title_from:])).replace("\n", " ")).strip()
        if name in BREAKS:
            out.append("\n")
    return title, links, lines(unescaped("".join([*out, html[at:]])))


def unescaped(text: str) -> str:
    return entities.unescape(_HUGE.sub("�", text)) if "&" in text else text


def lines(text: str) -> str:
    """Single blanks, no blank lines."""
    return _LINES.sub("\n", _BLANKS.sub(" ", text)).strip()


def header_lines(headers: str) -> list[tuple[str, str]]:
    """(name, value) of every line in order: the status line as `:status`, a folded line as part of the one before it, a line without
    a colon as a value without a name."""
    found: list[tuple[str, str]] = []
    for line in headers.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if line[:1] in (" ", "\t") and found:
            name, value = found[-1]
            found[-1] = (name, f"{value} {line.strip()}".strip())
        elif line.strip():
            name, colon, value = line.partition(":")
            found.append((":status", line.strip()) if not found and line.startswith("HTTP/") else (name.strip(), value.strip()) if colon else ("", line.strip()))
    return found


def dechunked(payload: bytes) -> bytes | None:
    """The body of a chunked message, its last chunk and what follows included; None if the payload is no such message, as where it was put together already."""
    out, at = [], 0
    while (end := payload.find(b"\n", at)) >= 0:
        size = payload[at:end].partition(b";")[0].strip()
        if not size or len(size) > 16 or size.strip(b"0123456789abcdefABCDEF"):
            return None
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(payload[end + 1 : end + 1 + n])
        if len(out[-1]) < n:  # cut short: what came is the body
            return b"".join(out)
        at = end + 1 + n
        gap = payload[at : at + 2]
        if gap[:1] not in (b"\r", b"\n", b""):
            return None
        at += 2 if gap == b"\r\n" else 1
    return b"".join(out) if out and at >= len(payload) else None


def inflated(payload: bytes, bits: int) -> bytes | None:
    """What zlib makes of the payload, all members of it, as far as it goes; None if it is not such data at all, or more than LARGEST bytes."""
    out, held, rest = [], 0, payload
    while rest:
        tool = zlib.decompressobj(bits)
        try:
            part = tool.decompress(rest, LARGEST + 1 - held)
        except zlib.error:
            return b"".join(out) if held else None
        out.append(part)
        held += len(part)
        if held > LARGEST or tool.unconsumed_tail:
            return None
        if not tool.eof:
            break
        rest = tool.unused_data
    return b"".join(out)


def body_of(payload: bytes, headers: Sequence[tuple[str, str]]) -> tuple[bytes, str]:
    """(body, coding that is left): the payload without the transfer and content codings that its headers name.

    Chunks are put together, gzip and deflate undone, however many were put on. A payload that does not look as its header says is taken to be decoded already,
    as many crawlers store it. Other codings, such as br, and bodies over LARGEST bytes stay, and are named.
    """
    said = lambda name: [c.strip().lower() for n, v in headers if n.lower() == name for c in v.split(",") if c.strip()]
    if "chunked" in said("transfer-encoding"):
        whole = dechunked(payload)
        payload = payload if whole is None else whole
    for coding in reversed([*said("content-encoding"), *(c for c in said("transfer-encoding") if c != "chunked")]):
        if coding in ("gzip", "x-gzip") and payload[:2] == b"\x1f\x8b":
            plain = inflated(payload, 31)
        elif coding == "deflate":
            plain = next((x for bits in (15, -15) if (x := inflated(payload, bits)) is not None), payload)
        elif coding in ("identity", "gzip", "x-gzip"):
            plain = payload
        else:
            plain = None
        if plain is None:
            return payload, coding
        payload = plain
    return payload, ""


def kind_of(content_type: str) -> str:
    return content_type.partition(";")[0].strip().lower()


def is_page(kind: str) -> bool:
    return not kind or "html" in kind or "xml" in kind


def charset_of(payload: bytes, content_type: str) -> str:
    """The charset that the header names, else a byte order mark, else, in a page, what its first bytes declare, as browsers read them; UTF-8 if none does."""
    if named := _CHARSET.search(content_type):
        return named[1]
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if payload.startswith(mark):
            return name
    found = _DECLARED.search(payload[:DECLARED]) if is_page(kind_of(content_type)) else None
    return found[1].decode() if found else "utf-8"


def text_of(payload: bytes, content_type: str) -> str | None:
    """The payload, without codings, as text; None for types that are not text."""
    kind = kind_of(content_type)
    if kind and not kind.startswith("text/") and "html" not in kind and "xml" not in kind and "json" not in kind:
        return None
    name = charset_of(payload, content_type)
    try:
        # bytes that could be read here declare themselves one byte a letter
        return payload.decode("utf-8" if name.lower().startswith("utf-16") and payload[:2] not in (b"\xff\xfe", b"\xfe\xff") and not _CHARSET.search(content_type) else name, errors="replace")
    except (LookupError, ValueError):
        return payload.decode(errors="replace")


def digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


# Records


def urn(*parts: Column) -> Column:
    """A record id that is the same for the same parts."""
    h = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Crawled pages as response rows: id_col, record_id, target_uri, warc_date, http_headers, payload. Null pages are empty ones.

    For tables of bare pages, which know neither status, headers nor date: these are made up, `date` is the caller's.
    """
    url, body = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return pages.select(F.col(id_col).alias("page_id"), urn(F.lit("response"), key, url, F.lit(date)).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("warc_date"), headers.alias("http_headers"), body.alias("payload"))


def derivatives(record_id: str | None, uri: str | None, date: str | None, headers: str, payload: bytes, known_digest: str | None) -> Iterator[tuple]:
    """The rows of RECORD that one response gives."""
    own = header_lines(headers)
    content = next((v for n, v in own if n.lower() == "content-type"), "")
    source, shown = known_digest or digest(payload), json.dumps(own)
    body, coded = body_of(payload, own)
    text = None if coded else text_of(body, content)
    title, links, visible = page(text) if text is not None and is_page(kind_of(content)) else (None, [], text)
    meta = {"refers-to": record_id, "payload-digest": source, "title": title, "links": links, "http": own} | ({"undecoded": coded} if coded else {})
    blocks = [("metadata", "application/json", json.dumps(meta, ensure_ascii=False, sort_keys=True))]
    if visible is not None:
        blocks.append(("conversion", "text/plain; charset=utf-8", visible))
    for kind, of, block in blocks:
        data = block.encode(errors="replace")
        name = uuid.UUID(hashlib.md5(f"{kind}\n{record_id}".encode()).hexdigest())
        yield f"<urn:uuid:{name}>", kind, record_id, uri, date, uri, date, of, len(data), digest(data), source, shown, data.decode()


def derive(archive: DataFrame, id_col: str = "page_id") -> DataFrame:
    """A metadata record for every response, and a conversion for those of text: id_col and the columns of RECORD.

    Chunked, gzip and deflate bodies are read decoded; those in another coding, which the metadata names, have no conversion.
    A null payload or header is an empty one: its metadata has no title, no links and no headers, its text is empty. Payloads
    without a declared type are read as HTML. A column payload_digest, if there is one, is kept as the source's digest; where it is
    null or missing the digest is computed. Null and repeated ids stay, each with its own records; other columns, whatever their
    names, are left out; very long pages take time in proportion; an empty table gives an empty one. Nothing is shuffled.
    """
    known = F.col("payload_digest") if "payload_digest" in archive.columns else F.lit(None)
    blank = F.lit("").cast("binary")
    base = archive.select(
        F.col(id_col).alias("id"), "record_id", "target_uri", "warc_date", F.coalesce("http_headers", F.lit("")).alias("headers"),
        F.coalesce(F.col("payload").cast("binary"), blank).alias("payload"), known.cast("string").alias("known")
    )
    record = T._parse_datatype_string(RECORD)
    schema = T.StructType([T.StructField("id", base.schema["id"].dataType), *record.fields])
    kinds = [pa.int64() if f.dataType == T.LongType() else pa.string() for f in record.fields]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                of, out = [], []
                for i, row in enumerate(zip(*(b.column(c).to_pylist() for c in ("record_id", "target_uri", "warc_date", "headers", "payload", "known")), strict=True)):
                    made = list(derivatives(*row))
                    of += [i] * len(made)
                    out += made
                ids = b.column("id").take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], schema.fieldNames())

    return base.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def as_warc(records: DataFrame) -> DataFrame:
    """records with warc, each record's own bytes as they stand in an archive file. Control characters in a field are percent-encoded."""
    fields = [
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "refers_to_target_uri"), ("WARC-Refers-To-Date", "refers_to_date"),
        ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "block_digest"), ("X-Source-Payload-Digest", "source_payload_digest"),
        ("X-Source-HTTP-Headers", "source_headers"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    ]
    encoded = lambda c: F.regexp_replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), r"[\x00-\x1f\x7f]", "%20")
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), *[F.concat(F.lit(f"{name}: "), encoded(c)) for name, c in fields])
    return records.withColumn("warc", F.concat(head, F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r\n")).cast("binary"))


# Files


def records_of(stream: BufferedReader, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in small letters, block) of every record. A broken archive is an error that names the file."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: no record where one should begin")
        head = []
        while (line := stream.readline()).strip():
            head.append(line.decode(errors="replace").rstrip("\r\n"))
        fields = {n.lower(): v for n, v in header_lines("\n".join(head))}
        size = int(fields.get("content-length", -1))
        block = stream.read(size) if size >= 0 else b""
        if size < 0 or len(block) < size:
            raise ValueError(f"{name}: a record without its whole block")
        yield fields, block


def response(fields: dict[str, str], block: bytes) -> tuple:
    """A row of RESPONSE: the block parted at its first empty line into headers and payload."""
    gap = re.search(rb"\r?\n\r?\n", block)
    head, payload = (block[: gap.start()], block[gap.end() :]) if gap else (block, b"")
    return (fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), head.decode(errors="replace"), payload, fields.get("warc-payload-digest"))


def read_archives(spark: SparkSession, paths: Sequence[str], batch_bytes: int = 16_000_000) -> DataFrame:
    """The response records of archive files (.warc, .warc.gz), as rows of RESPONSE; other records are passed over.

    A file is read by one task as a stream, in any store that pyarrow can open; at most batch_bytes and one record are in memory.
    """
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
    names = ["record_id", "target_uri", "warc_date", "http_headers", "payload", "payload_digest"]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                with store.open_input_stream(inner, compression=None) as raw:
                    stream = BufferedReader(raw)
                    stream = gzip.GzipFile(fileobj=stream) if stream.peek(2)[:2] == b"\x1f\x8b" else stream
                    rows, held = [], 0
                    for fields, block in records_of(stream, path):
                        if fields.get("warc-type", "").lower() == "response":
                            rows.append(response(fields, block))
                            held += len(block)
                            if held >= batch_bytes:
                                yield table(rows)
                                rows, held = [], 0
                    if rows:
                        yield table(rows)

    return listed.mapInArrow(run, RESPONSE)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """records as .warc.gz files below folder, one for each partition and a member for each record; returns (path, n_records).

    A file is written under another name and moved when it is whole, so a task that is run again replaces its own file.
    """

    def run(batches):
        store, inner = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(inner, recursive=True)
        task = TaskContext.get()
        path = f"{inner}/part-{task.partitionId():05d}.warc.gz"
        part, n = f"{inner}/_part-{task.partitionId():05d}-{task.taskAttemptId()}", 0
        with store.open_output_stream(part, compression=None) as out:
            for b in batches:
                for data in b.column("warc").to_pylist():
                    out.write(gzip.compress(data, mtime=0))
                    n += 1
        store.move(part, path)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_records"])

    return as_warc(records).select("warc").mapInArrow(run, "path string, n_records long")
