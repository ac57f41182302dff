"""WARC archives: a writer, one gzip member per record, and a sequential
reader.

Writing. Each task writes its own archive files under a shared folder, a new
one every ``ARCHIVE_BYTES``, under names that no other attempt has. The list
of finished archives is an ordinary Spark table, so archives of failed or
repeated attempts are simply not in it.

Of pages with equal payloads the one with the smallest page id is written in
full (``response``), the others as ``revisit`` records: HTTP header only, with
the digest and the page referred to.

Reading. An archive is read front to back with one incremental zlib
decompressor per gzip member. The header block is read to its empty line, the
content block to exactly its Content-Length, then the two closing line ends
and the member's end must follow. Field names count in any letter case, lines
may be folded, and a blank after the colon is optional. Digests that a record
has are verified (block digests of all records, payload digests of full ones;
algorithms that are not known here are passed over); a record without is
taken as it is. Records of all types give a row: the payload of an HTTP
message is its body, that of any other record its whole block. At most one
record is in memory.

Defined results: null html is an empty payload; null and empty ones are equal
payloads; a null url is written as no target; pages that repeat the smallest
page id of their payload are all written in full; a null page id is larger
than any other and refers like them (payloads that only have null ids are all
responses); an empty table gives no archives and an empty result; extra
columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.batches import map_batches
from cartwise.plans.materialize import materialize, scratch_path

ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
#: Tasks that read archives, at most, for each shuffle partition of the session.
READ_WAVES = 4
RECORD_DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


class BadArchive(ValueError):
    """An archive breaks the framing or a digest."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _file(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that Spark and pyarrow both know (local,
    hdfs, s3, gs); their names for it differ a little."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme == "file":
        path = "/" + rest.lstrip("/")
    elif colon and scheme == "s3a":
        path = f"s3:{rest}"
    return pafs.FileSystem.from_uri(path)


# --- writing -------------------------------------------------------------------

def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", RECORD_DATE),
            *fields, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    gz = zlib.compressobj(wbits=31)
    return gz.compress(text.encode() + block + END) + gz.flush()


def page_record(page_id, url: str | None, payload: bytes, refers_to, refers_url: str | None, revisit: bool) -> bytes:
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            b"Content-Length: %d\r\n\r\n" % len(payload))
    fields = [("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
              ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    if not revisit:
        return record("response", fields, http + payload)
    fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", str(refers_to))]
    if refers_url is not None:
        fields.append(("WARC-Refers-To-Target-URI", " ".join(refers_url.split())))
    return record("revisit", fields, http)


def _write_archives(batches, folder: str, archive_bytes: int):
    """Rows to archives; yields (path, records, bytes) per finished one."""
    fs, base = _file(folder)
    out, path, n, size = None, "", 0, 0

    def finished():
        out.close()
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n]), pa.array([size])],
                                          names=["path", "records", "bytes"])
    for b in batches:
        for i in range(b.num_rows):
            page_id, url, html, refers_to, refers_url, revisit = (b.column(c)[i].as_py() for c in range(6))
            if out is None:
                name = f"{uuid.uuid4().hex}.warc.gz"
                fs.create_dir(base, recursive=True)
                out, path, n, size = fs.open_output_stream(f"{base}/{name}", compression=None), \
                    f"{folder}/{name}", 0, 0
            size += out.write(page_record(page_id, url, (html or "").encode(), refers_to, refers_url, revisit))
            n += 1
            if size >= archive_bytes:
                yield finished()
                out = None
    if out is not None:
        yield finished()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archive ``pages`` under ``folder``; returns the table (path, records,
    bytes) of the archives. Payloads under ``min_bytes`` are always full."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"),
                        F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n"))
    # only payloads that occur again: the rest of the table need not meet them
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url"))
    again = materialize(rows.filter(F.col("n") >= min_bytes).groupBy("digest").agg(
        F.count("*").alias("pages"), first.alias("first"))
        .filter("pages > 1 AND NOT first.none")
        .select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")),
        "repeated-payloads")
    joined = rows.join(again, "digest", "left")
    revisit = F.coalesce((F.col("n") >= min_bytes) & F.col("refers_to").isNotNull()
                         & ~F.col("page_id").eqNullSafe(F.col("refers_to")), F.lit(False))
    return materialize(map_batches(
        joined.select("page_id", "url", "html", "refers_to", "refers_url", revisit.alias("revisit")),
        partial(_write_archives, folder=folder, archive_bytes=archive_bytes),
        "path string, records long, bytes long"), "archives")


# --- reading -------------------------------------------------------------------

class Member:
    """The decompressed bytes of one gzip member, read on demand."""

    def __init__(self, source, start: bytes):
        self.source, self.pending = source, start
        self.zip, self.data = zlib.decompressobj(wbits=31), bytearray()

    def _more(self) -> bool:
        """Decompress a further chunk; False at the member's end."""
        if self.zip.eof:
            return False
        raw = self.zip.unconsumed_tail or self.pending or self.source.read(CHUNK)
        if not raw:
            raise BadArchive("an archive ends inside a record")
        self.pending = b""
        self.data += self.zip.decompress(raw, CHUNK)
        return True

    def until(self, mark: bytes) -> bytes:
        at = 0
        while (i := self.data.find(mark, at)) < 0:
            at = max(0, len(self.data) - len(mark) + 1)
            if not self._more():
                raise BadArchive("a record's header has no end")
        out = bytes(self.data[:i])
        del self.data[:i + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.data) < n:
            if not self._more():
                raise BadArchive("a record is shorter than its Content-Length")
        out = bytes(self.data[:n])
        del self.data[:n]
        return out

    def close(self) -> bytes:
        """The member must end here; gives the bytes read beyond it."""
        while self._more():
            pass
        if self.data:
            raise BadArchive("a record is longer than its Content-Length")
        return self.zip.unused_data


def header_fields(lines: list[str]) -> dict[str, str]:
    """Fields by lower-cased name; the first of a repeated one."""
    fields: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in " \t" and name:
            fields[name] = f"{fields[name]} {line.strip()}".strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            if name in fields:
                name = None
            else:
                fields[name] = value.strip()
        elif line:
            raise BadArchive(f"no header field: {line[:40]!r}")
    return fields


def agrees(digest: str | None, data: bytes) -> bool:
    """Whether ``algorithm:value`` (base32 or hex) is the data's digest; one
    that is missing or can't be computed here has nothing against it."""
    algorithm, _, value = (digest or "").partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if algorithm not in ("md5", "sha1", "sha256", "sha512"):
        return True
    own, value = hashlib.new(algorithm, data), value.strip()
    return value.lower() == own.hexdigest() or value.upper().rstrip("=") == \
        base64.b32encode(own.digest()).decode().rstrip("=")


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content block) of every record of an open archive."""
    start = source.read(CHUNK)
    while start:
        member = Member(source, start)
        version, *lines = member.until(END).decode().split("\r\n")
        if not version.startswith("WARC/1."):
            raise BadArchive(f"no WARC record: {version[:40]!r}")
        fields = header_fields(lines)
        if not fields.get("content-length", "").isdecimal():
            raise BadArchive("a record has no Content-Length")
        block = member.exactly(int(fields["content-length"]))
        if member.exactly(len(END)) != END:
            raise BadArchive("a record is not closed by two line ends")
        start = member.close() or source.read(CHUNK)
        if not agrees(fields.get("warc-block-digest"), block):
            raise BadArchive("block digest")
        yield fields, block


def _page_row(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind = fields.get("warc-type", "").lower()
    payload, http = block, {}
    if fields.get("content-type", "").lower().startswith("application/http"):
        head, _, payload = block.partition(END)
        http = header_fields(head.decode("latin-1").split("\r\n")[1:])
    length, full = http.get("content-length", ""), kind != "revisit"
    if "transfer-encoding" in http:         # the digest may be that of the decoded body
        length = ""
    elif full and (length.isdecimal() and len(payload) != int(length)
                   or not agrees(fields.get("warc-payload-digest"), payload)):
        raise BadArchive("payload digest")
    digest = fields.get("warc-payload-digest") or (sha1_base32(payload) if full else None)
    ids = [int(fields[k]) if fields.get(k, "").lstrip("-").isdecimal() else None
           for k in ("x-page-id", "x-refers-to-page-id")]
    return (ids[0], fields.get("warc-target-uri"), int(length) if length.isdecimal() and not full else len(payload),
            digest and digest.removeprefix("sha1:"), kind, ids[1], payload if with_payload and full else None)


READ_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
READ_NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]


def _read_archives(batches, with_payload: bool):
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), READ_TYPES)], names=READ_NAMES)

    for b in batches:
        for path, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            fs, name = _file(path)
            rows, size, n = [], 0, 0
            with fs.open_input_stream(name, compression=None) as source:
                for fields, block in records(source):
                    rows.append(_page_row(fields, block, with_payload))
                    size, n = size + len(block), n + 1
                    if size > (4 << 20) or len(rows) >= 2_000:
                        yield batch(rows)
                        rows, size = [], 0
            if expected is not None and n != expected:
                raise BadArchive(f"{path}: {n} records, {expected} were written")
            if rows:
                yield batch(rows)


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the listed archives (``path`` and, where it is
    known and to be checked, the number of ``records``). ``payload`` (null for
    revisits) is left out of the rows, but verified, without
    ``with_payload``. Archives are dealt out to a bounded number of tasks."""
    most = READ_WAVES * int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(most, archives.count()))
    expected = F.col("records") if "records" in archives.columns else F.lit(None).cast("long")
    return map_batches(archives.select("path", expected.alias("records")).repartition(n),
                       partial(_read_archives, with_payload=with_payload),
                       "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
                       "refers_to long, payload binary")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as archives and read them back."""
    folder = folder or scratch_path(pages.sparkSession, f"warc-{uuid.uuid4().hex}")
    return read(write(pages, folder), with_payload=False).drop("payload")
