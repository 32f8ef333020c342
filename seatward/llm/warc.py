"""WARC derivatives: every response becomes a metadata record and a plain-text conversion record that refer to it.

Records are built and parsed byte by byte as the format has them; a record is one gzip member, so that members can be joined to files and
read one by one. Each has its file, offset and length, an index over the archive: ``archive`` writes responses and what derives from them in one pass, with places
counted as they are written, and ``members`` lays out any members. Digests are SHA-1 in base 32, record identifiers follow from content, so a repeated run
gives equal archives.

Patterns for tags run up to the last ``>`` of a page, so that each that starts also ends, and every pattern goes over a page once: a broken page of any length
takes time in proportion to its length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatward.llm.common import query, stored
from seatward.llm.texts import PIECE

DATE = "2024-01-01T00:00:00Z"
# Bytes of a file of the archive, about.
FILE_BYTES = 256 << 20

_DROP = re.compile(r"<!--.*?(?:(-->)|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:(</\2\s*>)|\Z)", re.I | re.S)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|nav|header|footer|blockquote|pre|hr|title|body|head|main|aside)\b[^>]*>", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*>")
_TITLE, _TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile(r"</title\s*>", re.I)
_ANCHOR, _HTML = re.compile(r"<a\b([^>]*)>", re.I), re.compile(r"<html\b([^>]*)>", re.I)
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|(\S+))""", re.I)
_LANG = re.compile(r"""\blang\s*=\s*["']?([A-Za-z-]+)""", re.I)
_CHARSET = re.compile(r"charset=\"?([A-Za-z0-9_.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(parts))}>"


def _line(value: str) -> str:
    """A header value stays on its line."""
    return re.sub(r"[\r\n]+", " ", value)


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {_line(v)}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block; the declared length decides where the block ends."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip(" \t") for k, _, v in (line.partition(":") for line in lines[1:])}
    length = int(headers["content-length"])
    if len(rest) < length:
        raise ValueError("the record ends before its block does")
    return headers, rest[:length]


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines[1:])]
    return lines[0], headers, payload if gap else b""


def response(page_id: int | None, url: str | None, page: str | None) -> bytes:
    """The response record of a fetched page. A null page has an empty payload, a null address no target."""
    payload = (page or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), url or "", digest(payload))), ("WARC-Date", DATE)]
    headers += [("WARC-Target-URI", url)] if url is not None else []
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(payload))]
    return build(headers, block)


def _tagged(page: str) -> tuple[str, str]:
    """(the page up to its last ``>``, the rest, in which no tag ends)."""
    end = page.rfind(">") + 1
    return page[:end], page[end:]


def visible(page: str) -> tuple[str, str]:
    """The two parts of ``_tagged`` without comments, scripts and styles; one that is never closed takes all the rest with it."""
    head, rest = _tagged(page)
    cut = False

    def gap(m: re.Match) -> str:
        nonlocal cut
        cut = m[1] is None and m[3] is None
        return " "

    head = _DROP.sub(gap, head)
    if cut:
        return head, ""
    comment = rest.find("<!--")
    return head, rest if comment < 0 else rest[:comment] + " "


def title_of(page: str) -> str:
    """The text of the first title that ends; empty where there is none."""
    head, _ = _tagged(page)
    start = _TITLE.search(head)
    end = start and _TITLE_END.search(head, start.end())
    return " ".join(html.unescape(head[start.end() : end.start()]).split()) if end else ""


def links_of(page: str) -> list[str]:
    """Targets of the anchors, comments and scripts aside; the first ``href`` of each tag counts."""
    found = (_HREF.search(tag) for tag in _ANCHOR.findall(visible(page)[0]))
    return [html.unescape(next(g for g in m.groups() if g is not None)) for m in found if m]


def language_of(page: str) -> str | None:
    found = (_LANG.search(tag) for tag in _HTML.findall(_tagged(page)[0]))
    return next((m[1] for m in found if m), None)


def plain_text(page: str) -> str:
    """Visible text: scripts, styles and comments go, block tags end a line, blanks within a line become one."""
    head, rest = visible(page)
    # What was dropped may have held the last tag's end.
    head, more = _tagged(head)
    page = _TAG.sub("", _BREAK.sub("\n", head)) + more + rest
    lines = (" ".join(line.split()) for line in html.unescape(page).split("\n"))
    return "\n".join(line for line in lines if line)


def derivatives(record: bytes) -> list[bytes]:
    """Metadata and conversion record of a response; none for other types. Both name the response, and each other.

    The source's target and date are kept in the same headers, its HTTP headers and both digests in the metadata. A block that does not fit its digest is
    said so there, and converted all the same.
    """
    source, block = parse(record)
    if source.get("warc-type") != "response":
        return []
    status, http, payload = http_parts(block)
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    charset = (m := _CHARSET.search(kind)) and m[1] or "utf-8"
    try:
        page = payload.decode(charset, "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    text = plain_text(page).encode("utf-8", "replace")
    own = source["warc-record-id"]
    ids = {t: record_id(t, own, digest(text)) for t in ("metadata", "conversion")}
    shared = [("WARC-Refers-To", own), ("WARC-Date", source.get("warc-date", DATE))]
    shared += [("WARC-Target-URI", source["warc-target-uri"])] if "warc-target-uri" in source else []
    fields = [("status", status), *((f"http-{k.lower()}", v) for k, v in http), ("title", title_of(page))]
    fields += [("language", language)] if (language := language_of(page)) else []
    fields += [("link", link) for link in links_of(page)]
    fields += [(f"source-{k}", source[f"warc-{k}"]) for k in ("block-digest", "payload-digest") if f"warc-{k}" in source]
    sound = "warc-payload-digest" not in source or source["warc-payload-digest"] == digest(payload)
    fields += [("source-digest-valid", str(sound).lower())]
    about = "".join(f"{k}: {_line(v)}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    make = lambda t, other, mime, body: build(
        [("WARC-Type", t), ("WARC-Record-ID", ids[t]), *shared, ("WARC-Concurrent-To", ids[other]), ("Content-Type", mime), ("WARC-Block-Digest", digest(body))], body
    )
    return [make("metadata", "conversion", "application/warc-fields", about), make("conversion", "metadata", "text/plain; charset=utf-8", text)]


def _mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """``function(row values) -> list of tuples`` over rows, in small Arrow pieces."""
    fields = T.StructType.fromDDL(schema)
    names = fields.names

    def run(batches):
        types = [{"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()] for f in fields]
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                piece = batch.slice(at, PIECE)
                rows = [out for r in zip(*(c.to_pylist() for c in piece.columns), strict=True) for out in function(*r)]
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return df.mapInArrow(run, schema)


def _member(record: bytes) -> bytes:
    # Pages come compressed and leave compressed: the lightest level costs a third of the usual one.
    return gzip.compress(record, 1, mtime=0)


ARCHIVE = "page_id long, warc_type string, file string, offset long, length long, member binary"


def archive(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(page_id, warc_type, file, offset, length, member): each response of (page_id, url, html) followed by its metadata and conversion records.

    A task counts the bytes it writes, so a member's place is known without another pass, and a task that runs again gives the same files. The conversion
    reads the record just built as ``derivatives`` reads any. Null addresses and pages: see ``response``. Repeated rows are records of their own with equal
    identifiers. An empty table gives no rows. Columns besides the three are not looked at. A page is in memory with its records, whatever its length.
    """

    def run(batches):
        names = [f.split()[0] for f in ARCHIVE.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        part, number, offset = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                rows = []
                for page_id, url, page in zip(*(c.to_pylist() for c in batch.slice(at, PIECE).columns), strict=True):
                    first = response(page_id, url, page)
                    for kind, record in zip(("response", "metadata", "conversion"), (first, *derivatives(first)), strict=True):
                        member = _member(record)
                        rows.append((page_id, kind, f"part-{part:05d}-{number:05d}.warc.gz", offset, len(member), member))
                        offset += len(member)
                    if offset >= file_bytes:
                        number, offset = number + 1, 0
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return pages.select("page_id", "url", "html").mapInArrow(run, ARCHIVE)


def response_members(pages: DataFrame) -> DataFrame:
    """(page_id, member): response records of (page_id, url, html).

    Null addresses and pages: see ``response``. Repeated rows give repeated records, an empty table none; other columns are not looked at.
    """
    return _mapped(pages.select("page_id", "url", "html"), lambda i, u, h: [(i, _member(response(i, u, h)))], "page_id long, member binary")


def derive(responses: DataFrame) -> DataFrame:
    """(page_id, member): the derivative records of response members, two each; records of other types have none.

    Repeated members are converted each; an empty table gives no rows; columns besides the two are not looked at. Members must not be null.
    """
    return _mapped(
        responses.select("page_id", "member"), lambda i, m: [(i, _member(d)) for d in derivatives(gzip.decompress(m))], "page_id long, member binary"
    )


def members(records: DataFrame, name: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The archive: members with ``file``, ``offset`` and ``length``. A file is what one task wrote, cut after ``file_bytes``.

    The bytes of a file are its members in the order of their offsets. They are kept as rows, so the writer's commit protocol holds when
    an executor is lost, and readers take members in parallel.
    """
    table = stored(records.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), name)
    # Positions and lengths only: a task's members are one window, its bytes are not in it.
    spans = table.select("pos", "part", F.octet_length("member").cast("long").alias("length"))
    before = F.coalesce(F.sum("length").over(Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.withColumn("before", before).withColumn("cut", F.floor(F.col("before") / F.lit(file_bytes)).cast("long"))
    spans = spans.withColumn("offset", F.col("before") - F.min("before").over(Window.partitionBy("part", "cut")))
    placed = spans.select("pos", F.format_string("part-%05d-%05d.warc.gz", "part", "cut").alias("file"), "offset", "length")
    return table.drop("part").join(placed, "pos").drop("pos")


SCHEMA = (
    "page_id long, warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string,"
    " content_type string, block_digest string, source_payload_digest string, source_block_digest string, block string"
)


def read_derivatives(archive: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Members parsed back, one row a record, repeated ones too; source digests from the metadata's own fields. An empty table gives no rows."""

    def row(page_id, member, *place):
        h, block = parse(gzip.decompress(member))
        text = block.decode("utf-8", "replace")
        fields = dict(line.partition(": ")[::2] for line in text.split("\r\n")) if h["warc-type"] == "metadata" else {}
        names = ("warc-type", "warc-record-id", "warc-refers-to", "warc-concurrent-to", "warc-target-uri", "warc-date", "content-type", "warc-block-digest")
        return [(page_id, *(h.get(n) for n in names), fields.get("source-payload-digest"), fields.get("source-block-digest"), text, *place)]

    more = "".join(f", {c} {t}" for c, t in archive.dtypes if c in carry)
    return _mapped(archive.select("page_id", "member", *(c for c, _ in archive.dtypes if c in carry)), row, SCHEMA + more)


@query("op10_warc_derivatives")
def op10_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder.rstrip('/')}/pages.parquet")
    written = stored(archive(pages), "warc")
    derived = read_derivatives(written.where("warc_type <> 'response'"), ("file", "offset"))
    return derived
