"""WARC derivatives: response records to linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import json
import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "record_id string, type string, target_uri string, date string, content_type string, refers_to string, headers map<string,string>, block binary"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs
_HIDDEN = re.compile(r"(?i)<!--|<(script|style|noscript|template)\b")
_SHUT = {x: re.compile(rf"(?i)</{x}\s*>") for x in ("script", "style", "noscript", "template", "title")}
_BREAK = re.compile(r"(?i)<(?:br|/?(?:p|div|h[1-6]|li|ul|ol|tr|table|article|section|header|footer|nav|title|blockquote|pre))\b[^>]*>")
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>")
_TITLE = re.compile(r"(?i)<title\b")
_LANG = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)")
_LINK = re.compile(r"(?is)<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_CHARSET = re.compile(r"(?i)charset=\"?([\w-]+)")
_BLANKS, _LINES = re.compile(r"[ \t\r\f\v\xa0]+"), re.compile(r" ?\n[ \n]*")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def identifier(*parts: str) -> str:
    """The same urn for the same parts, so that a task that runs again gives the same records."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def _inside(page: str, at: int, name: str) -> tuple[int, int, int] | None:
    """Where the content of the element starts whose name ends at the place, where it ends and where its end tag does."""
    start = page.find(">", at) + 1
    end = _SHUT[name].search(page, start) if start else None
    return (start, end.start(), end.end()) if end else None


def shown(page: str) -> str:
    """The page without comments, scripts, styles and templates. One pass from the left: what is not closed stays, and as
    nothing of its kind is closed after it, its kind is not looked for again."""
    out, at, open_ = [], 0, set()
    for m in _HIDDEN.finditer(page):
        kind = (m[1] or "--").lower()
        if m.start() < at or kind in open_:
            continue
        if kind == "--":
            end = page.find("-->", m.end()) + 3
        else:
            found = _inside(page, m.end(), kind)
            end = found[2] if found else 2
        if end == 2:
            open_.add(kind)
            continue
        out += [page[at : m.start()], " "]
        at = end
    return "".join([*out, page[at:]])


def _text_of(visible: str) -> str:
    whole = visible.rfind(">") + 1  # no tag can end after it
    page = _TAG.sub("", _BREAK.sub("\n", visible[:whole])) + visible[whole:]
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape(page))).strip()


def plain_text(page: str) -> str:
    """Visible text of a page: no comments, scripts or styles, a line for each block, entities resolved."""
    return _text_of(shown(page))


def about_page(page: str, visible: str) -> tuple[str | None, str | None, list[str]]:
    """Title, language and link targets; those of tags in the visible part, read tag by tag."""
    opened = _TITLE.search(page)
    found = _inside(page, opened.end(), "title") if opened else None
    title = _BLANKS.sub(" ", html.unescape(page[found[0] : found[1]])).strip() if found else None
    lang, links = None, []
    for tag in _TAG.finditer(visible, 0, visible.rfind(">") + 1):
        if lang is None and (m := _LANG.match(tag[0])):
            lang = m[1]
        elif m := _LINK.match(visible, tag.start()):
            links.append(html.unescape(m[1] or m[2] or m[3] or ""))
    return title, lang, links


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order and body of an HTTP response; a block without such a head is all body."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        head, _, body = block.partition(b"\n\n")
    status, *lines = head.decode("latin-1").splitlines()
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines if ":" in x)], body


def derive(record_id: str, uri: str, date: str, block: bytes) -> list[dict]:
    """The metadata and the conversion record of a response record. Both refer to it."""
    status, headers, body = split_http(block)
    names = {k.lower(): v for k, v in headers}
    charset = _CHARSET.search(names.get("content-type", ""))
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    visible = shown(page)
    text = _text_of(visible).encode()
    conversion, metadata = identifier("conversion", record_id), identifier("metadata", record_id)
    title, lang, links = about_page(page, visible)
    about = {
        "source-status": status, "source-headers": headers, "source-payload-digest": digest(body), "source-block-digest": digest(block), "conversion": conversion,
        "title": title, "language": lang, "links": links,
    }
    made = []
    for kind, own, content_type, data in (("metadata", metadata, "application/json", json.dumps(about, ensure_ascii=False).encode()), ("conversion", conversion, "text/plain; charset=utf-8", text)):
        fields = {"WARC-Type": kind, "WARC-Record-ID": own, "WARC-Refers-To": record_id, "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Block-Digest": digest(data), "Content-Type": content_type, "Content-Length": str(len(data))}
        made.append({"record_id": own, "type": kind, "target_uri": uri, "date": date, "content_type": content_type, "refers_to": record_id, "headers": fields, "block": data})
    return made


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records (with page_id) of a table of pages; null url or html counts as empty."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, url, page in zip(pdf["id"], pdf["url"], pdf["html"], strict=True):
                url, body = url or "", (page or "").encode()
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                own = identifier("response", "" if pd.isna(i) else str(int(i)), url)
                fields = {"WARC-Type": "response", "WARC-Record-ID": own, "WARC-Target-URI": url, "WARC-Date": date, "WARC-Block-Digest": digest(block), "WARC-Payload-Digest": digest(body), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
                rows.append((i, own, "response", url, date, fields["Content-Type"], None, fields, block))
            yield pd.DataFrame(rows, columns=["page_id", "record_id", "type", "target_uri", "date", "content_type", "refers_to", "headers", "block"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInPandas(run, "page_id long, " + RECORD)


def derivatives(records: DataFrame, id_col: str | None = None) -> DataFrame:
    """A metadata and a conversion record for each response record; records of other types give none.

    The metadata record holds the source's status line, headers (in order, repeats kept), digests, title,
    language, links and the id of the conversion record; both name the source in refers_to. Ids depend on the
    source's id alone. Null fields count as empty; an empty body gives an empty text. Repeated records give
    repeated derivatives. id_col, if given, is a column to carry along. Extra columns are ignored.
    """
    carried = [F.col(id_col).cast("long").alias("_id")] if id_col else [F.lit(None).cast("long").alias("_id")]

    def run(batches):
        for pdf in batches:
            rows = []
            for i, kind, own, uri, date, block in zip(pdf["_id"], pdf["type"], pdf["record_id"], pdf["target_uri"], pdf["date"], pdf["block"], strict=True):
                if kind == "response":
                    rows += [{"_id": i} | x for x in derive(own or "", uri or "", date or "", bytes(block or b""))]
            yield pd.DataFrame(rows, columns=["_id", "record_id", "type", "target_uri", "date", "content_type", "refers_to", "headers", "block"])

    out = records.select(*carried, "type", "record_id", "target_uri", "date", "block").mapInPandas(run, "_id long, " + RECORD)
    return out.withColumnRenamed("_id", id_col) if id_col else out.drop("_id")


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes):
    """(headers, block) of each record of a WARC file, plain or gzipped by record."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip()] = v.strip()
        yield headers, stream.read(int(headers.get("Content-Length") or 0))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (.warc or .warc.gz). A file is one task's work and must fit in its memory, as
    crawlers' files of about 1 GB do; more files are more tasks."""

    def run(batches):
        for pdf in batches:
            for data in pdf["content"]:
                rows = []
                for h, block in parse_records(bytes(data)):
                    rows.append((h.get("WARC-Record-ID"), h.get("WARC-Type"), h.get("WARC-Target-URI"), h.get("WARC-Date"), h.get("Content-Type"), h.get("WARC-Refers-To"), h, block))
                    if len(rows) == 256:
                        yield pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")])
                        rows = []
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RECORD)


def warc_bytes(records: DataFrame) -> DataFrame:
    """One gzip member for each record, in a binary column `member`; members joined in any order are a WARC file."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"record_id": pdf["record_id"], "member": [gzip.compress(record_bytes(dict(h), bytes(b)), mtime=0) for h, b in zip(pdf["headers"], pdf["block"], strict=True)]})

    return records.select("record_id", "headers", "block").mapInPandas(run, "record_id string, member binary")
