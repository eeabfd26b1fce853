"""Legacy ARC archives to WARC, with equal payloads written once.

ARC version 1 and 2 files are read by the header line their version declares
and by the length each record declares. What ARC lacks is synthesised from what
it has: record ids from file, offset, address and date, timestamps from the
14-digit date, record types from the address scheme, digests from the bytes.
Records with equal payloads of at least ``least`` bytes become one response and
revisits of it.

All files lie in the shared folder, one gzip member a record; executors open
them through pyarrow's file systems. A retried task writes files of new names,
and the manifests that Spark commits name those that count.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import importable, new_dir, open_input, open_output, written

#: Fields of a record's header line by ARC version (fixed by the format).
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: Profile of a revisit whose payload equals another record's (fixed by the WARC format).
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Equal payloads under this many bytes are all kept.
LEAST = 100
PIECE = 1 << 20
#: Longer header lines are malformed.
HEADER = 1 << 20
LEVEL = 1


class ArcRecord(NamedTuple):
    version: int
    offset: int
    fields: dict[str, str]
    content: bytes


def member(data: bytes) -> bytes:
    """One gzip member."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class Stream:
    """Bytes of an archive, packed in gzip members or not, a piece in memory at a time."""

    def __init__(self, file):
        self.file, self.raw, self.held = file, b"", b""
        self.member = 0  # where the member of the next byte begins
        self.read_so_far = self.taken = 0
        while len(self.raw) < 2 and self._more_raw():
            pass
        self.packed = self.raw[:2] == b"\x1f\x8b"
        self.unpacker = None

    def _more_raw(self) -> int:
        got = self.file.read(PIECE)
        self.read_so_far += len(got)
        self.raw += got
        return len(got)

    def fill(self, n: int) -> bool:
        """Hold at least ``n`` bytes of one member, or of the whole file if it is not packed."""
        while len(self.held) < n:
            if not self.packed:
                if not self.raw:
                    self._more_raw()
                if not self.raw:
                    return False
                self.held, self.raw = self.held + self.raw, b""
                continue
            if self.unpacker is None:
                if self.held:
                    return False  # a member ends here
                if not self.raw:
                    self._more_raw()
                if not self.raw:
                    return False
                self.member, self.taken, self.unpacker = self.read_so_far - len(self.raw), 0, zlib.decompressobj(31)
            if not self.raw:
                self._more_raw()
                if not self.raw:
                    raise ValueError(f"the archive ends within the member at {self.member}")
            data, self.raw = self.raw, b""
            try:
                self.held += self.unpacker.decompress(data, max(PIECE, n - len(self.held)))
            except zlib.error as broken:
                raise ValueError(f"the member at {self.member} is damaged: {broken}") from None
            self.raw = self.unpacker.unconsumed_tail or self.unpacker.unused_data
            if self.unpacker.eof:
                self.unpacker = None
        return True

    def at(self) -> int:
        """The place of the next byte: of its member in the file, plus its place in the member."""
        return self.member + self.taken

    def take(self, n: int) -> bytes:
        out, self.held = self.held[:n], self.held[n:]
        self.taken += len(out)
        return out

    def through(self, end: bytes, most: int) -> bytes:
        """The bytes to the next ``end`` and with it; ValueError if there is none."""
        looked = 0
        while (k := self.held.find(end, max(0, looked - len(end)))) < 0:
            looked = len(self.held)
            if looked > most or not self.fill(looked + 1):
                raise ValueError(f"no end of a header at {self.at()}")
        return self.take(k + len(end))

    def content(self, n: int) -> bytes:
        if not self.fill(n):
            raise ValueError(f"the record at {self.at()} declares {n} bytes but has {len(self.held)}")
        return self.take(n)

    def skip(self, what: bytes) -> bool:
        """Pass over any of these bytes; False at the end of the file."""
        while self.fill(1):
            if self.held[:1] not in what:
                return True
            self.take(1)
        return False


def _head(line: bytes, fields: tuple[str, ...]) -> dict[str, str]:
    parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(fields) - 1)  # an address may hold spaces
    if len(parts) != len(fields) or not parts[-1].isdecimal():
        raise ValueError(f"a malformed header line: {line[:200]!r}")
    return dict(zip(fields, parts, strict=True))


def arc_records(file) -> Iterator[ArcRecord]:
    """All records of an ARC file but its version block, one in memory at a time; ValueError if it is malformed.

    A record's place is that of its gzip member, or its own in a file without gzip or in a member of many.
    """
    stream = Stream(file)
    if not stream.skip(b"\r\n"):
        return
    line = stream.through(b"\n", HEADER)
    if not line.startswith(b"filedesc://"):
        raise ValueError("an ARC file begins with a filedesc record")
    after = stream.through(b"\n", HEADER)
    number = after.split(b" ", 1)[0].strip()
    version = int(number) if number.isdigit() else 0
    if version not in ARC_FIELDS:
        raise ValueError(f"ARC version {number[:20]!r} is unknown")
    head = _head(line, ARC_FIELDS[version if len(line.split(b" ")) >= len(ARC_FIELDS[version]) else 1])
    stream.content(max(0, int(head["Archive-length"]) - len(after)))
    while stream.skip(b"\r\n"):  # separators between records
        offset = stream.at()
        head = _head(stream.through(b"\n", HEADER), ARC_FIELDS[version])
        yield ArcRecord(version, offset, head, stream.content(int(head["Archive-length"])))


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and the payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    ends = [(k, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (k := content.find(mark)) >= 0]
    if not ends:
        return content, b""
    k, n = min(ends)
    return content[: k + n], content[k + n :]


def head_value(head: bytes, name: bytes) -> str:
    for line in head.split(b"\n"):
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower():
            return value.strip().decode("utf-8")
    return ""


def record_id(path: str, offset: int, url: str, date: str) -> str:
    """The same id whenever the same record is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path.rpartition("/")[2]} {offset} {url} {date}')}>"


def warc_date(arc_date: str) -> str:
    d = (arc_date if arc_date.isdigit() else "").ljust(14, "0")[:14]
    month, day = max(d[4:6], "01"), max(d[6:8], "01")
    return f"{d[:4]}-{month}-{day}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def to_warc(record: ArcRecord, path: str, refers: tuple[str, str] | None = None) -> bytes:
    """The WARC record of an ARC record; ``refers``: record id and page id of the response it repeats."""
    url, date = record.fields["URL"], record.fields["Archive-date"]
    head, payload = split_http(record.content)
    kind = "revisit" if refers else "response" if head or url.startswith(("http://", "https://")) else "resource"
    block = head if refers else record.content
    sha = lambda data: "sha256:" + hashlib.sha256(data).hexdigest()
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(path, record.offset, url, date)), ("WARC-Date", warc_date(date)), ("WARC-Target-URI", url),
        ("WARC-Block-Digest", sha(block)), ("WARC-Payload-Digest", sha(payload)), ("X-Payload-Length", str(len(payload))),
    ]
    if record.fields["IP-address"] not in ("0.0.0.0", "-"):
        fields.append(("WARC-IP-Address", record.fields["IP-address"]))
    if refers:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers[0]), ("X-Refers-To-Page", refers[1])]
    fields += [("Content-Type", "application/http; msgtype=response" if head else record.fields["Content-type"]), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def warc_records(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (lower-case names) and block of each WARC record, one in memory at a time."""
    stream = Stream(file)
    while stream.skip(b"\r\n"):
        first, *lines = stream.through(b"\r\n\r\n", HEADER).decode("utf-8").strip().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record: {first[:100]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        yield fields, stream.content(int(fields["content-length"]))


def write_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ARC files, of version 1 and 2 in turn; returns their manifest: path, n_records."""
    importable(pages.sparkSession)
    folder = new_dir(pages.sparkSession, "arc")

    def write(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"part-{part:06d}-{uuid.uuid4().hex[:8]}.arc.gz"
        out, n, at = None, 0, 0
        tail = {1: "text/html", 2: "text/html 200 - - 0 " + name}[version]
        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = open_output(f"{folder}/{name}")
                    text = f"{version} 0 tessera\n{' '.join(ARC_FIELDS[version])}\n\n"
                    about = {1: "text/plain", 2: "text/plain 200 - - 0 " + name}[version]
                    at += out.write(member(f"filedesc://{name} 0.0.0.0 20000101000000 {about} {len(text)}\n{text}\n".encode()))
                payload = (html or "").encode("utf-8")
                content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\n\r\n".encode() + payload
                where = "".join(url.split("\n")).strip() if url else "about:blank"
                line = f"{where} 0.0.0.0 20000101000000 {tail} {len(content)}\n"
                at += out.write(member(line.encode("utf-8") + content + b"\n"))
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [n]})

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col))
    return written(rows.mapInArrow(write, "path string, n_records long"), "arc-manifest")


def _each_file(manifest: DataFrame, *more: str) -> DataFrame:
    """The files of a manifest, a task each."""
    return manifest.select("path", *more).repartitionByRange(max(1, manifest.count()), "path")


#: Rows of an Arrow batch that a reader returns at once.
ROWS = 5_000


def _batches(rows: Iterable[tuple], schema) -> Iterator:
    """Arrow batches of rows."""
    import pyarrow as pa

    rows = iter(rows)
    while own := list(itertools.islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*own, strict=True), schema, strict=True)], schema=schema)


def read_arc(manifest: DataFrame) -> DataFrame:
    """page_id, path, offset, url, date, payload_bytes and payload_digest of every ARC record."""
    importable(manifest.sparkSession)
    schema = "page_id long, path string, offset long, url string, date string, payload_bytes long, payload_digest string"

    def read(batches: Iterable) -> Iterator:
        import pyarrow as pa

        types = pa.schema([("page_id", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

        def rows(path: str) -> Iterator[tuple]:
            with open_input(path) as file:
                for r in arc_records(file):
                    head, payload = split_http(r.content)
                    page = head_value(head, b"X-Page-Id")
                    yield int(page) if page else None, path, r.offset, r.fields["URL"], r.fields["Archive-date"], len(payload), hashlib.sha256(payload).hexdigest()

        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from _batches(rows(path), types)

    return _each_file(manifest).mapInArrow(read, schema)


def first_of_equals(records: DataFrame, least: int = LEAST) -> DataFrame:
    """Adds ref, the record that is the response of each revisit, else null."""
    place = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "path", "offset", "url", "date")
    groups = records.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.min(place).alias("ref"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = records.join(written(groups, "equal-payloads"), ["payload_digest", "payload_bytes"], "left")  # plain exchanges: a hot payload can be split
    own = (F.col("ref.path") == F.col("path")) & (F.col("ref.offset") == F.col("offset"))
    return joined.select(*records.columns, F.when(~own, F.col("ref")).alias("ref"))


def convert(records: DataFrame, arcs: DataFrame) -> DataFrame:
    """Write a WARC file for each ARC file of the manifest ``arcs``, each by a task of its own; returns their manifest.

    ``records``: path, offset and ref of the ARC records. Only the references of revisits move: a file's are
    dealt to its task in the order of the file and merged with the records as they stream by.
    """
    spark = records.sparkSession
    importable(spark)
    folder = new_dir(spark, "warc")

    def write(batches: Iterable) -> Iterator:
        import pyarrow as pa

        def rows() -> Iterator[dict]:
            for batch in batches:
                yield from batch.to_pylist()

        for path, own in itertools.groupby(rows(), key=lambda r: r["path"]):
            name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            out, n = open_output(name), 0
            text = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
            info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(name, 0, 'warcinfo', '')}\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(text)}\r\n\r\n"
            out.write(member(info.encode() + text + b"\r\n\r\n"))
            ref = next(own)  # the file's own row comes first, without a place
            ref = next(own, None)
            with open_input(path) as file:
                for record in arc_records(file):
                    refers = None
                    if ref is not None and ref["offset"] == record.offset:
                        refers = (record_id(ref["ref_path"], ref["ref_offset"], ref["ref_url"], ref["ref_date"]), ref["ref_page"])
                        ref = next(own, None)
                    out.write(member(to_warc(record, path, refers)))
                    n += 1
            out.close()
            if ref is not None:
                raise ValueError(f"{path} holds no record at {ref['offset']}")
            yield pa.RecordBatch.from_pydict({"path": [name], "n_records": pa.array([n], pa.int64())})

    ref = [F.coalesce(F.col("ref.page_id").cast("string"), F.lit("")).alias("ref_page"), *(F.col(f"ref.{c}").alias(f"ref_{c}") for c in ("path", "offset", "url", "date"))]
    revisits = records.filter("ref IS NOT NULL").select("path", "offset", *ref)
    files = arcs.select("path", F.lit(-1).cast("long").alias("offset"), *[F.lit(None).cast(t).alias(c) for c, t in revisits.dtypes[2:]])
    dealt = files.unionByName(revisits).repartition(max(1, arcs.count()), "path").sortWithinPartitions("path", "offset")
    return written(dealt.mapInArrow(write, "path string, n_records long"), "warc-manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every response and revisit.

    Responses are digested anew; ValueError if a block does not match its header.
    """
    importable(manifest.sparkSession)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def read(batches: Iterable) -> Iterator:
        import pyarrow as pa

        types = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

        def rows(path: str) -> Iterator[tuple]:
            with open_input(path) as file:
                for fields, block in warc_records(file):
                    if (kind := fields["warc-type"]) == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
                    if "sha256:" + hashlib.sha256(block).hexdigest() != fields["warc-block-digest"] or kind != "revisit" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{path}: {fields['warc-record-id']} does not match its digests")
                    page, ref = head_value(head, b"X-Page-Id"), fields.get("x-refers-to-page", "")
                    yield int(page) if page else None, size, digest, kind, int(ref) if ref else None

        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from _batches(rows(path), types)

    return _each_file(manifest).mapInArrow(read, schema)


def archive_digest(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write ``pages`` as ARC files, convert them to WARC, and read the WARC files back.

    One row per row of ``pages``. Null html is an empty payload, a null url is
    about:blank. Of equal payloads the smallest page_id is the response; a null
    page_id only if no other id has the payload (its revisits refer to null),
    and of repeated rows one is the response and the others revisit it. A page of any
    length is one record, held in memory as a whole. An empty table gives no files and
    no rows; further columns are ignored, whatever their names. A malformed archive
    raises ValueError: no record of it is left out silently.
    """
    arcs = write_arc(pages)
    records = written(read_arc(arcs), "arc-records")
    return read_warc(convert(first_of_equals(records, least), arcs))
