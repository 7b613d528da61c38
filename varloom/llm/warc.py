"""WARC derivatives: metadata and plain-text conversion records linked to their responses."""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import io
import json
import re
import uuid
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import BinaryIO
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

VERSION = "WARC/1.1"
BREAK = "\r\n"
#: Elements whose text is not content, and those that end a line of text.
HIDDEN = {"script", "style", "template", "noscript", "svg", "iframe", "object"}
LINES = set(
    "address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html"
    " legend li main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that have no end tag.
EMPTY = set("area base br col embed hr img input link meta source track wbr".split())
#: Attributes that hold links.
LINKS = {("a", "href"), ("area", "href"), ("link", "href"), ("img", "src"), ("script", "src"), ("iframe", "src"), ("source", "src"), ("form", "action")}
ATTRIBUTES = {"html", "meta", *(tag for tag, _ in LINKS)}
#: Payload bytes of the records that are read together.
READ_BYTES = 16 << 20
RESPONSE = (
    "source_id {id}, record_id string, target_uri string, date string, block_digest string, payload_digest string, warc_headers string, http_headers string, payload binary"
)
DERIVED = (
    "source_id {id}, warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string,"
    " content_length bigint, block_digest string, payload_digest string, refers_to_payload_digest string, block string"
)
READ = (
    "warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string,"
    " payload_digest string, refers_to_payload_digest string, warc_headers string, http_headers string, payload binary, truncated boolean"
)


class Page(HTMLParser):
    """Title, metas, links and lines of visible text of a page.

    The text of a ``HIDDEN`` element is left out if the element is closed.  One that is not (by the end of its parent, or of the
    page) is taken back, as it may hold the rest of the page; that of scripts and styles stays out.

    Markup that is not HTML never fails: declarations such as <![foo[...]]> are comments up to the next >, and
    where the parser gives up all the same, what remains is taken as text without its tags.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.title, self.metas, self.links, self.lang = None, [], [], None
        #: Lines of the page, and of each hidden element that is open, the innermost last.
        self.levels: list[list[list[str]]] = [[[]]]
        self.open: list[str] = []
        self.times: dict[str, int] = {}
        self.in_title = False
        self.at = 0
        try:
            self.feed(html)
            self.at = 0
            self.close()
        except (AssertionError, ValueError, IndexError):
            rest = self.rawdata[self.at :]
            self.in_title = False
            self.shut(0)
            self.handle_data(re.sub(r"<[^>]*>", " ", rest))
        self.shut(0)

    def shut(self, depth: int) -> None:
        """Closes all elements beyond ``depth`` for want of an end tag."""
        while len(self.open) > depth:
            tag = self.open.pop()
            self.times[tag] -= 1
            if tag in HIDDEN:
                taken = self.levels.pop()
                if tag not in self.CDATA_CONTENT_ELEMENTS:
                    self.levels[-1] += [*taken, []]

    def updatepos(self, i: int, j: int) -> int:
        """The place in ``rawdata`` is enough; lines are not counted."""
        self.at = j
        return j

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if attrs and tag in ATTRIBUTES:
            given = dict(attrs)
            self.links += [{"path": f"{tag.upper()}@/{k}", "url": v} for k, v in attrs if v and (tag, k) in LINKS]
            if tag == "meta" and (name := given.get("name") or given.get("property") or given.get("http-equiv")):
                self.metas.append({"name": name, "content": given.get("content") or ""})
            if tag == "html":
                self.lang = given.get("lang") or self.lang
        self.in_title = tag == "title"
        if tag in LINES:
            self.levels[-1].append([])
        if tag not in EMPTY:
            self.open.append(tag)
            self.times[tag] = self.times.get(tag, 0) + 1
            if tag in HIDDEN:
                self.levels.append([[]])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.in_title = False
        if self.times.get(tag):
            if self.open[-1] != tag:
                self.shut(len(self.open) - self.open[::-1].index(tag))
            self.open.pop()
            self.times[tag] -= 1
            if tag in HIDDEN:
                self.levels.pop()
        if tag in LINES:
            self.levels[-1].append([])

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title = (self.title or "") + data
        else:
            self.levels[-1][-1].append(data)

    @property
    def text(self) -> str:
        return "\n".join(x for x in (" ".join("".join(line).split()) for line in self.levels[0]) if x)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(parts, default=str))}>"


def fields(head: str | None) -> dict[str, str]:
    """Header lines as a mapping, without a first line that is none; lines that begin with white space go on, and
    fields that come again, in any case of letters, are joined by commas."""
    out: dict[str, str] = {}
    spelled: dict[str, str] = {}
    for line in re.sub(r"\r?\n[ \t]+", " ", head or "").splitlines():
        name, colon, value = line.partition(":")
        if colon and re.fullmatch(r"[^\s:]+", name):
            name = spelled.setdefault(name.lower(), name)
            out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def lower(names: dict[str, str]) -> dict[str, str]:
    return {k.lower(): v for k, v in names.items()}


def metas(payload: bytes) -> Iterator[bytes]:
    """The meta tags before a page's body, or of all of a page that has no such tag; those in comments do not count."""
    for m in re.finditer(rb"<!--.*?(?:-->|\Z)|<body\b|<meta\b[^>]*", payload, re.IGNORECASE | re.DOTALL):
        if m[0][:5].lower() == b"<body":
            return
        if m[0][:4] != b"<!--":
            yield m[0]


def header_value(value: object) -> str:
    """A value as one line of a header: line breaks are percent-encoded, as in addresses."""
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def decoded(payload: bytes, content_type: str) -> str:
    """The payload's text: by the charset of the content type, else by the first that a meta tag of the page's head names, else UTF-8; bytes that
    are none in it become U+FFFD."""
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type, re.IGNORECASE)
    inside = named or next(filter(None, (re.search(rb"charset\s*=\s*[\"']?([\w.:-]+)", tag, re.IGNORECASE) for tag in metas(payload))), None)
    name = "utf-8" if inside is None else inside[1] if isinstance(inside[1], str) else inside[1].decode("ascii", "replace")
    try:
        codecs.lookup(name)
        return payload.decode(name, "replace")
    except (LookupError, UnicodeError, ValueError):
        return payload.decode("utf-8", "replace")


def responses(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z",
    date_col: str | None = None, http_col: str | None = None,
) -> DataFrame:
    """A response record per row of ``pages``: its id (from the row's id, address and digest), target
    address, date, digests of block and payload, WARC and HTTP headers, and the payload.

    Crawls that kept them give dates in ``date_col`` and the status line and headers in ``http_col``; others, and
    nulls, get ``date`` and a plain head; blank lines within a head are left out, as they would end it.  Null pages have an empty payload; null addresses and ids stay null.  Rows
    that come twice give equal records.  Other columns are not read, whatever their names; an empty table gives an
    empty result.  A task holds a batch of pages (64 MB, or one longer page).
    """

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, url, html, when, head in zip(frame["i"], frame["u"], frame["h"], frame["d"], frame["x"], strict=True):
                body = (html or "").encode("utf-8", "replace")
                head = (head or f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: {len(body)}").rstrip() + BREAK
                head = re.sub(r"(\r?\n)(?:[ \t]*\r?\n)+", r"\1", head)
                block, own = digest(f"{head}{BREAK}".encode("utf-8", "replace") + body), digest(body)
                name, when = record_id("response", None if pd.isna(i) else i, url, block), when or date
                lines = {"WARC-Type": "response", "WARC-Record-ID": name, "WARC-Target-URI": url, "WARC-Date": when, "WARC-Block-Digest": block, "WARC-Payload-Digest": own}
                out.append((i, name, url, when, block, own, "".join(f"{k}: {header_value(v)}{BREAK}" for k, v in lines.items() if v is not None), head, body))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESPONSE.split(", ")])

    text = lambda c: F.lit(None).cast("string") if c is None else pages[c].cast("string")
    read = pages.select(pages[id_col].alias("i"), text(url_col).alias("u"), text(html_col).alias("h"), text(date_col).alias("d"), text(http_col).alias("x"))
    return read.mapInPandas(build, RESPONSE.format(id=dict(read.dtypes)["i"]))


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response record.

    ``records`` are those of ``responses``, or response records of ``read_warc`` with a ``source_id``.  Both
    derivatives refer to the response by its id and keep its address, date and payload digest.  The metadata block is
    JSON: all of the response's WARC header fields and HTTP headers as they came, its status line, the page's title,
    language, metas and links, and the id of the conversion record.  The conversion block is the page's visible text,
    in UTF-8, whatever the page's charset; of text/plain it is the payload, and empty for other types than HTML and
    text.  Each has a digest of its own block.

    Null and repeated ids stay, responses that come twice give equal records twice, an empty or null payload gives an
    empty text, and malformed pages give the text that can be told (see ``Page``).  Only the columns of ``RESPONSE`` are
    read; an empty table gives an empty result.  Needs no shuffle; a task holds a batch of records (64 MB, or one
    longer page and some ten times its bytes while that is read).
    """

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                http = fields(r.http_headers)
                kind = lower(http).get("content-type", "text/html")
                html, plain = re.match(r"\s*(text/html|application/xhtml)", kind, re.IGNORECASE), re.match(r"\s*text/", kind, re.IGNORECASE)
                content = decoded(bytes(r.payload or b""), kind) if html or plain else ""
                page = Page(content if html else "")
                text, own, other = page.text if html else content, record_id("conversion", r.record_id), record_id("metadata", r.record_id)
                head = {"Title": page.title, "Lang": page.lang, "Metas": page.metas, "Links": page.links}
                status = (r.http_headers or "").split("\n", 1)[0].strip()
                meta = {"WARC-Header": fields(r.warc_headers), "HTTP-Status": status, "HTTP-Headers": http, "HTML": head, "Conversion": own, "Text-Digest": digest(text.encode("utf-8", "replace"))}
                for what, name, type_, block in (("metadata", other, "application/json", json.dumps(meta, ensure_ascii=False)), ("conversion", own, "text/plain", text)):
                    data = block.encode("utf-8", "replace")
                    out.append((r.source_id, what, name, r.record_id, r.target_uri, r.date, type_, len(data), digest(data), digest(data), r.payload_digest, data.decode()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in re.split(r",\s*", DERIVED)])

    read = records.select(*(c.split()[0] for c in RESPONSE.split(", ")))
    return read.mapInPandas(build, DERIVED.format(id=dict(read.dtypes)["source_id"]))


#: Fields of a written record and the columns that give them; null ones are left out.
FIELDS = {
    "WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri", "WARC-Date": "date",
    "WARC-Block-Digest": "block_digest", "WARC-Refers-To-Payload-Digest": "refers_to_payload_digest", "Content-Type": "content_type",
}


class Files(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """One file per task, one gzip member per record; files get their names when all tasks are done."""

    def __init__(self, path: str):
        self.path = path

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        system, folder = self._system()
        system.create_dir(folder, recursive=True)
        name, wrote = f"part-{uuid.uuid4().hex}.warc.gz", False
        with system.open_output_stream(f"{folder}/_{name}", compression=None) as out:
            for batch in iterator:
                for r in batch.to_pylist():
                    block = (r["block"] or "").encode("utf-8", "replace")
                    head = "".join(f"{k}: {header_value(r[c])}{BREAK}" for k, c in FIELDS.items() if r[c] is not None)
                    out.write(gzip.compress(f"{VERSION}{BREAK}{head}Content-Length: {len(block)}{BREAK * 2}".encode() + block + (BREAK * 2).encode(), 6, mtime=0))
                    wrote = True
        if not wrote:
            system.delete_file(f"{folder}/_{name}")
        return Files([name] if wrote else [])

    def commit(self, messages: list[Files | None]) -> None:
        system, folder = self._system()
        for m in messages:
            for name in m.names if m else ():
                system.move(f"{folder}/_{name}", f"{folder}/{name}")

    def abort(self, messages: list[Files | None]) -> None:
        system, folder = self._system()
        for m in messages:
            for name in m.names if m else ():
                system.delete_file(f"{folder}/_{name}")


class WarcSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc_records"

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def write_warc(derived: DataFrame, path: str) -> None:
    """Writes derived records as WARC files, one per partition, each record a gzip member of its own.

    Null fields are left out, a null block is empty, line breaks in fields are percent-encoded; an empty table gives no file.

    ``path`` is a folder or address that all executors can write to.  Tasks write files whose names begin with an
    underscore, which readers pass over; the files of the tasks that counted are renamed at the end.
    """
    derived.sparkSession.dataSource.register(WarcSink)
    derived.select(*FIELDS.values(), "block").write.format("warc_records").mode("append").save(path)


def records_of(stream: BinaryIO) -> Iterator[tuple]:
    """The records of a WARC file (not compressed): columns of ``READ``."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue  # breaks between records, or rubbish after one
        lines = []
        while (line := stream.readline()).strip():
            lines.append(line)
        head = b"".join(lines).decode("utf-8", "replace")
        f = lower(fields(head))
        size = int(f["content-length"]) if f.get("content-length", "").isdigit() else 0
        block = stream.read(size)
        http, payload = None, block
        if f.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
            first, gap, rest = block.partition(b"\r\n\r\n")
            http, payload = first.decode("utf-8", "replace") + (BREAK if gap else ""), rest
        get = lambda name: f.get(name.lower())
        yield (
            get("WARC-Type"), get("WARC-Record-ID"), get("WARC-Refers-To"), get("WARC-Target-URI"), get("WARC-Date"), get("Content-Type"), get("WARC-Block-Digest"),
            get("WARC-Payload-Digest"), get("WARC-Refers-To-Payload-Digest"), head, http, payload, len(block) < size,
        )


def read_warc(spark: SparkSession, path: str, whole_bytes: int = 256 << 20) -> DataFrame:
    """All records of WARC files, plain or gzipped (by record or whole), each file by one task; of any other columns there are none.

    A record's block is as long as its Content-Length says, whatever it holds; HTTP messages are split into head and
    payload.  A record that the file ends in comes with what is there and ``truncated``.  Fields that a record lacks are null; empty files
    give no records, and a folder without files gives an empty result.

    Files of up to ``whole_bytes`` bytes are read by Spark, from whatever it can read.  Longer ones, of any size, are opened by the task
    at their address (by Arrow's file systems) and read as a stream.  A task holds records of ``READ_BYTES``, or one longer record.
    """
    names = [c.split()[0] for c in re.split(r",\s*", READ)]

    def records(raw: BinaryIO) -> Iterator[pd.DataFrame]:
        file = io.BufferedReader(raw, 1 << 20)
        stream = io.BufferedReader(gzip.GzipFile(fileobj=file), 1 << 20) if file.peek(2)[:2] == b"\x1f\x8b" else file
        held, size = [], 0
        for record in records_of(stream):
            held.append(record)
            if (size := size + len(record[11])) >= READ_BYTES:
                yield pd.DataFrame(held, columns=names)
                held, size = [], 0
        yield pd.DataFrame(held, columns=names)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                yield from records(io.BytesIO(content))

    def follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            for address in frame["path"]:
                local = re.match("file:/*(/.*)", address, re.DOTALL)
                system, place = (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(quote(address, safe="/:@"))
                with system.open_input_stream(place, compression=None) as stream:
                    yield from records(stream)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.filter(F.col("length") <= whole_bytes).select("content").mapInPandas(parse, READ)
    return small.unionByName(files.filter(F.col("length") > whole_bytes).select("path").mapInPandas(follow, READ))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages (the table has neither dates nor HTTP heads, so all get the plain ones)."""
    return derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))).withColumnRenamed("source_id", "page_id")
