"""WARC derivatives: linked metadata and plain-text conversion records made from response records."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"  # pages carry no date
_SPACE = uuid.UUID("7f2c1f1e-5a0b-5d2e-9a3c-0c8a4d1b6e55")
_HIDDEN = ("script", "style", "noscript", "template")
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>", re.IGNORECASE)
_TAG = re.compile(r"</?[A-Za-z][^>]*>|<![^>]*>|<\?[^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>", re.IGNORECASE)
_HTML = re.compile(r"<html\b[^>]*>", re.IGNORECASE)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.IGNORECASE)
_ANCHOR = re.compile(r"<a\b[^>]*>", re.IGNORECASE)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.IGNORECASE)
_SPACES = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n\s*")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record: version line, named fields, block, two line ends. Line ends inside a value become spaces."""
    head = [VERSION] + [f"{k}: {re.sub(r'[\r\n]+', ' ', v)}".encode() for k, v in fields] + [f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields (lower-case names, folded lines joined; of repeated ones the last) and the block of a record.

    Bytes that are no record, and a length that is no number, raise ValueError.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(header_fields(lines[1:]))
    length = fields.get("content-length", str(len(rest)))
    if not (length.isascii() and length.isdigit()):
        raise ValueError("length is no number")
    return fields, rest[: int(length)]


def header_fields(lines: list[bytes]) -> list[tuple[str, str]]:
    """Names and values in the order of the lines, repeated ones included."""
    out: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif ":" in text:
            name, value = text.split(":", 1)
            out.append((name.strip().lower(), value.strip()))
    return out


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body; what does not parse ends it."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if n == 0:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out)


def response(page_id: int | None, url: str | None, page: str | None) -> bytes:
    """A response record of a stored page."""
    payload = (page or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    ident = uuid.uuid5(_SPACE, f"response|{page_id}|{url}|{digest(payload)}")
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{ident}>"), ("WARC-Date", DATE)]
    if url:
        fields.append(("WARC-Target-URI", url))
    fields += [("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return record(fields, block)


def without(page: str, names: tuple[str, ...], comments: bool = False) -> str:
    """The page without the named elements, and without comments if asked for. What is not closed stays.

    One forward scan: an element that is known to have no end is not looked for again.
    """
    opening = re.compile(("<!--|" if comments else "") + rf"<({'|'.join(names)})\b", re.IGNORECASE)
    closing = {n: re.compile(rf"</{n}\s*>", re.IGNORECASE) for n in names}
    endless: set[str] = set()
    out, at, look = [], 0, 0
    while m := opening.search(page, look):
        look = m.end()
        name = (m[1] or "").lower()
        if name in endless:
            continue
        if name:
            start = page.find(">", look)
            if start < 0:
                break  # no tag is complete from here on
            end = closing[name].search(page, start + 1)
            stop = end.end() if end else -1
        else:
            found = page.find("-->", look)
            stop = found + 3 if found >= 0 else -1
        if stop < 0:
            endless.add(name)
            continue
        out.append(page[at : m.start()])
        at = look = stop
    return "".join(out) + page[at:]


def _tagged(page: str) -> tuple[str, str]:
    """The page up to its last tag end, where patterns of tags find their end soon, and the rest, which has no complete tag."""
    k = page.rfind(">") + 1
    return page[:k], page[k:]


def plain_text(page: str) -> str:
    """The text of a page: no head, scripts, styles or comments; block elements end lines; blanks collapse."""
    body, rest = _tagged(without(without(page, _HIDDEN, comments=True), ("head",)))
    text = html.unescape(_TAG.sub("", _BLOCK.sub("\n", body)) + rest)
    return _LINES.sub("\n", _SPACES.sub(" ", text)).strip()


def page_facts(page: str) -> tuple[str | None, str | None, list[str]]:
    """Title, language and the different link targets of a page. A tag ends at its first ``>``."""
    tags, _ = _tagged(page)
    title = None
    if (m := _TITLE.search(tags)) and (end := re.compile(r"</title\s*>", re.IGNORECASE).search(tags, m.end())):
        title = " ".join(html.unescape(tags[m.end() : end.start()]).split())
    lang = next((x[1] for x in (_LANG.search(m[0]) for m in _HTML.finditer(tags)) if x), None)
    found = (_HREF.search(m[0]) for m in _ANCHOR.finditer(tags))
    links = sorted({html.unescape(next(x for x in m.groups() if x)) for m in found if m and any(m.groups())})
    return title, lang, links


def derive(data: bytes) -> list[dict]:
    """The metadata and the conversion record of one response record."""
    fields, block = parse(data)
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.split(b"\r\n")
    headers = header_fields(lines)
    http = dict(headers)
    payload = dechunk(body) if http.get("transfer-encoding", "").lower() == "chunked" else body
    charset = _CHARSET.search(http.get("content-type", ""))
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    source, uri = fields.get("warc-record-id", ""), fields.get("warc-target-uri")
    source_digest = fields.get("warc-payload-digest") or digest(payload)
    title, lang, links = page_facts(page)
    about = [("source-status", status.decode("utf-8", "replace"))] + [(f"source-{k}", v) for k, v in headers]
    about += [("source-payload-digest", source_digest), ("source-block-digest", fields.get("warc-block-digest") or digest(block))]
    about += [("title", title)] if title is not None else []
    about += [("language", lang)] if lang else []
    about += [("outlink", x) for x in links]
    described = b"".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n".encode("utf-8", "replace") for k, v in about)
    text = plain_text(page).encode("utf-8", "replace")
    out = []
    ids = {kind: f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind}|{source}')}>" for kind in ("metadata", "conversion")}
    for kind, content_type, own in (("metadata", "application/warc-fields", described), ("conversion", "text/plain; charset=utf-8", text)):
        other = ids["conversion" if kind == "metadata" else "metadata"]
        named = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", fields.get("warc-date", DATE)), ("WARC-Refers-To", source), ("WARC-Concurrent-To", other)]
        named += [("WARC-Target-URI", uri), ("WARC-Refers-To-Target-URI", uri)] if uri else []
        named += [("WARC-Refers-To-Date", fields.get("warc-date", DATE)), ("WARC-Block-Digest", digest(own)), ("Content-Type", content_type)]
        out.append({
            "kind": kind, "record_id": ids[kind], "refers_to": source, "concurrent_to": other, "target_uri": uri, "source_digest": source_digest,
            "block_digest": digest(own), "content_length": len(own), "record": record(named, own)})
    return out


SCHEMA = "kind string, record_id string, refers_to string, concurrent_to string, target_uri string, source_digest string, block_digest string, content_length long, record binary"
_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])


def responses(pages: DataFrame) -> DataFrame:
    """page_id and its response record. A null page has an empty payload, a null address no target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [response(*r) for r in zip(b["page_id"].to_pylist(), b["url"].to_pylist(), b["html"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["page_id"], pa.array(made, pa.binary())], ["page_id", "record"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, record binary")


def fault(data: bytes) -> str | None:
    """Why bytes are no record; None for a record."""
    try:
        parse(data)
    except ValueError as e:
        return str(e)
    return None


def unreadable(records: DataFrame) -> DataFrame:
    """page_id and reason for the rows whose bytes are no record. Null is no fault."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(p, fault(d)) for p, d in zip(b["page_id"].to_pylist(), b["record"].to_pylist(), strict=True) if d is not None]
            found = [x for x in found if x[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], ["page_id", "reason"])

    return records.select("page_id", "record").mapInArrow(run, "page_id long, reason string")


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows per response record: its metadata and its conversion record, linked to it and to each other.

    ``records`` has page_id and ``record``, the bytes of a WARC record; other kinds than responses, null, and bytes that are no
    record give none (``unreadable`` lists the last).
    Identifiers derive from the response's own, so a rerun gives equal records; repeated responses give repeated rows.
    No row is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), *_ARROW])
        for b in batches:
            out = []
            for page_id, data in zip(b["page_id"].to_pylist(), b["record"].to_pylist(), strict=True):
                if data and not fault(data) and parse(data)[0].get("warc-type") == "response":
                    out += [{"page_id": page_id, **r} for r in derive(data)]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return records.select("page_id", "record").mapInArrow(run, f"page_id long, {SCHEMA}")
