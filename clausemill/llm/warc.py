"""WARC archives: monolithic gzip files are inflated once, rewritten with one member per record, and given an offset index."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.functions.scale import spread_out, stored, stored_root

CHUNK = 1 << 20
FILE_BYTES = 64 << 20  # a file ends behind the record that reaches this many payload bytes
FILE_RECORDS = 20_000  # or so many records
LEVEL = 5
GZIP = 31  # window bits of zlib with a gzip wrapper
DATE = "1970-01-01T00:00:00Z"  # pages carry no date
BREAK = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, ordinal long, page_id long, bytes long, digest string"


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an address; Hadoop's short form file:/x is understood."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def header(fields: dict[str, object]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items()) + BREAK


def parsed(head: bytes) -> dict[str, str]:
    """Fields of a header, names in lower case."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def clean(url: str) -> str:
    """One line without blanks: what a header cannot hold is percent-coded."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def name_of(page_id: int | None, file: str, ordinal: int) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{file}:{ordinal}>"


def page_of(name: str) -> int | None:
    number = name.split(":")[2]
    return int(number) if number else None


class Output:
    """A file that appears under its name only when it is whole, so a lost task leaves nothing that looks finished."""

    def __init__(self, folder: str, name: str):
        self.system, root = located(folder)
        self.system.create_dir(root, recursive=True)
        self.path, self.part = f"{root}/{name}", f"{root}/.{name}-{uuid.uuid4().hex}"
        self.stream = self.system.open_output_stream(self.part, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.part, self.path)


class Monolith:
    """A WARC file of response records in a single gzip stream, as simple crawlers write it."""

    def __init__(self, folder: str):
        self.name = f"crawl-{uuid.uuid4().hex}"
        self.out, self.zip = Output(folder, f"{self.name}.warc.gz"), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
        self.records = self.payload = 0
        note = b"software: clausemill\r\nformat: WARC File Format 1.1\r\n"
        self._put(header({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:x-file:{self.name}>", "WARC-Date": DATE,
                          "Content-Type": "application/warc-fields", "Content-Length": len(note)}) + note + BREAK + BREAK)

    def _put(self, data: bytes) -> None:
        self.out.write(self.zip.compress(data))

    def add(self, page_id: int | None, url: str, payload: bytes) -> tuple:
        digest = base32(hashlib.sha1(payload).digest())
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        self._put(header({"WARC-Type": "response", "WARC-Record-ID": name_of(page_id, self.name, self.records), "WARC-Target-URI": clean(url),
                          "WARC-Date": DATE, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response",
                          "Content-Length": len(http) + len(payload)}) + http)
        for at in range(0, len(payload), CHUNK):
            self._put(payload[at : at + CHUNK])
        self._put(BREAK + BREAK)
        row = (self.name, self.records, page_id, len(payload), digest)
        self.records += 1
        self.payload += len(payload)
        return row

    def close(self) -> None:
        self.out.write(self.zip.flush())
        self.out.close()


def write_crawl(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Writes a response record for every row into monolithic archives under `folder`; returns file, ordinal, page_id, bytes, digest.

    Rows go from the reading task straight into its files. The result must be stored before use: it names the files of the
    tasks that ended, and a task that runs again writes new files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file: Monolith | None = None
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                if file is None:
                    file = Monolith(folder)
                body = batch.column(2)[i].as_py() or b""
                rows.append(file.add(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or "", body))
                if file.payload >= FILE_BYTES or file.records >= FILE_RECORDS:
                    file.close()
                    file = None
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "ordinal", "page_id", "bytes", "digest"])
        if file is not None:
            file.close()

    picked = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(body_col).cast("string").cast("binary"))
    return spread_out(picked).mapInArrow(run, MANIFEST)


class Inflated:
    """Bytes of a gzip file, inflated once from its beginning to its end; one member or many."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.zip, self.ended = read, zlib.decompressobj(GZIP), False
        self.held, self.at = b"", 0  # inflated bytes and the place of the first one not yet taken

    def _more(self) -> bool:
        while not self.ended:
            data = self.zip.unconsumed_tail
            if self.zip.eof:
                data = self.zip.unused_data.lstrip(b"\0") or self.read(CHUNK).lstrip(b"\0")
                if not data:
                    self.ended = True
                    break
                self.zip = zlib.decompressobj(GZIP)
            data = data or self.read(CHUNK)
            if not data:
                raise ValueError("the gzip stream ends too early")
            got = self.zip.decompress(data, CHUNK)
            if got:
                self.held, self.at = self.held[self.at :] + got, 0
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """Everything up to and with `mark`; empty at the end of the file."""
        known = 0
        while (found := self.held.find(mark, self.at + known)) < 0:
            known = max(0, len(self.held) - self.at - len(mark) + 1)
            if not self._more():
                if self.at < len(self.held):
                    raise ValueError("the archive ends inside a record's header")
                return b""
        out = self.held[self.at : found + len(mark)]
        self.at = found + len(mark)
        return out

    def take(self, size: int) -> Iterator[bytes]:
        """The next `size` bytes in pieces."""
        while size:
            if self.at == len(self.held) and not self._more():
                raise ValueError("the archive ends inside a record")
            piece = self.held[self.at : self.at + size]
            self.at += len(piece)
            size -= len(piece)
            yield piece


def records(read: Callable[[int], bytes]) -> Iterator[tuple[dict[str, str], bytes, Iterator[bytes]]]:
    """(fields, header, pieces of the block) of every record; a block that is not read to its end is skipped."""
    source = Inflated(read)
    while head := source.until(BREAK + BREAK):
        fields = parsed(head)
        block = source.take(int(fields["content-length"]))
        yield fields, head, block
        for _ in block:
            pass
        if b"".join(source.take(4)) != BREAK + BREAK:
            raise ValueError("a record does not end where its header says")


class Members:
    """A WARC file with one gzip member per record, and its index: offset, length, type, record name, digest in tab-separated lines."""

    def __init__(self, folder: str, name: str):
        self.out, self.index = Output(folder, f"{name}.warc.gz"), Output(folder, f"{name}.idx")
        self.records = 0

    def add(self, fields: dict[str, str], pieces: Iterator[bytes]) -> None:
        start, zip = self.out.size, zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
        for piece in pieces:
            self.out.write(zip.compress(piece))
        self.out.write(zip.flush())
        line = (start, self.out.size - start, fields["warc-type"], fields["warc-record-id"], fields.get("warc-payload-digest", ""))
        self.index.write(("\t".join(map(str, line)) + "\n").encode())
        self.records += 1

    def close(self) -> None:
        self.out.close()
        self.index.close()


def normalise(read: Callable[[int], bytes], target: Members, repeats: dict[int, str] | None = None) -> None:
    """Copies an archive record by record; response number n becomes a revisit of record repeats[n] and loses its payload."""
    number = 0
    for fields, head, block in records(read):
        other = None
        if fields["warc-type"] == "response":
            other = (repeats or {}).get(number)
            number += 1
        if other is None:
            target.add(fields, (p for part in ([head], block, [BREAK + BREAK]) for p in part))
            continue
        http = b""
        while BREAK + BREAK not in http:
            http += next(block)
        http = http[: http.index(BREAK + BREAK) + 4]
        changed = {"WARC-Type": "revisit", "WARC-Record-ID": fields["warc-record-id"], "WARC-Target-URI": fields["warc-target-uri"],
                   "WARC-Date": fields["warc-date"], "WARC-Payload-Digest": fields["warc-payload-digest"], "WARC-Profile": PROFILE,
                   "WARC-Refers-To": other, "Content-Type": fields["content-type"], "Content-Length": len(http)}
        target.add({k.lower(): v for k, v in changed.items()}, iter([header(changed), http, BREAK + BREAK]))
    target.close()


def repeats(manifest: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The manifest with `other`: the name of the record that a response repeats, else null.

    Of records with equal payloads of at least `least_bytes` bytes the one with the largest page_id is kept (nulls smallest; of
    rows that share that page_id the last by file and ordinal).
    """
    long_enough = manifest.filter(F.col("bytes") >= least_bytes)
    kept = long_enough.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "file", "ordinal")).alias("kept"))
    both = manifest.join(kept.filter("n > 1").drop("n"), ["digest", "bytes"], "left")
    name = F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col("kept.page_id").cast("string"), F.lit("")), F.lit(":"), F.col("kept.file"), F.lit(":"), F.col("kept.ordinal").cast("string"), F.lit(">"))
    own = (F.col("kept.file") == F.col("file")) & (F.col("kept.ordinal") == F.col("ordinal"))
    return both.select("file", "ordinal", F.when(F.col("kept").isNotNull() & ~own, name).alias("other"))


def by_file(rows: DataFrame) -> DataFrame:
    """Rows dealt by file to all cores; by their small size alone adaptive execution would put all files into one task."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")


def normalise_crawl(decided: DataFrame, source: str, target: str) -> DataFrame:
    """Normalises every archive named in `decided` (file, ordinal, other), one task a file; returns file, records, bytes."""

    def run(key, table):
        name = key[0].as_py()
        again = {o: n for o, n in zip(table.column("ordinal").to_pylist(), table.column("other").to_pylist()) if n is not None}
        system, root = located(source)
        members = Members(target, name)
        with system.open_input_stream(f"{root}/{name}.warc.gz", compression=None) as stream:
            normalise(stream.read, members, again)
        return pa.table({"file": [name], "records": pa.array([members.records], pa.int64()), "bytes": pa.array([members.out.size], pa.int64())})

    return by_file(decided).groupBy("file").applyInArrow(run, "file string, records long, bytes long")


def read_member(file, offset: int, length: int) -> tuple[dict[str, str], int, str]:
    """Fields, payload bytes and payload digest of the record in one member, found by its place alone."""
    file.seek(offset)
    left = length

    def read(n: int) -> bytes:
        nonlocal left
        data = file.read(min(n, left))
        left -= len(data)
        return data

    for fields, _, block in records(read):
        sha, size, http = hashlib.sha1(), 0, b""
        body = fields["warc-type"] == "warcinfo"
        for piece in block:
            if not body:
                http += piece
                if (at := http.find(BREAK + BREAK)) < 0:
                    continue
                piece, body = http[at + 4 :], True
            sha.update(piece)
            size += len(piece)
        if fields["warc-type"] == "revisit":
            return fields, int(parsed(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
        return fields, size, base32(sha.digest())
    raise ValueError("an empty member")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page's record, read member by member through the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                index = system.open_input_stream(f"{root}/{name}.idx", compression=None).read().decode()
                rows = []
                with system.open_input_file(f"{root}/{name}.warc.gz") as file:
                    for line in index.splitlines():
                        offset, length, kind, record, digest = line.split("\t")
                        fields, size, found = read_member(file, int(offset), int(length))
                        if (fields["warc-type"], fields["warc-record-id"]) != (kind, record):
                            raise ValueError(f"{name}: the index does not fit the record at {offset}")
                        if kind == "warcinfo":
                            continue
                        if digest != f"sha1:{found}":
                            raise ValueError(f"{name}: the payload at {offset} does not have its digest")
                        refers = fields.get("warc-refers-to")
                        rows.append((page_of(record), size, found, kind, page_of(refers) if refers else None))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return files.select("file").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes pages as WARC records, normalises the archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    `folder` (default: this application's part of the shared folder) gets `crawl/` with monolithic files and `archive/` with one
    gzip member per record and an index beside each file. Any address that pyarrow's file systems know will do.

    Payload is the body in UTF-8, null counts as empty; a null url is an empty one. payload_bytes and payload_digest (base32 SHA-1)
    are those of the full payload, for revisits too. Of records with equal payloads of at least `least_bytes` bytes the one with
    the largest page_id is a response and all others revisit it; of repeated rows with that page_id one is the response and the
    others revisit it, so their refers_to is their own page_id. Null page_ids are smallest and stay null. Other columns are
    ignored; an empty table gives no files and no rows.
    """
    folder = folder or f"{stored_root(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    manifest = stored(write_crawl(pages, f"{folder}/crawl", id_col, url_col, body_col), "manifest")
    files = stored(normalise_crawl(repeats(manifest, least_bytes), f"{folder}/crawl", f"{folder}/archive"), "archives")
    return read_archives(by_file(files), f"{folder}/archive")
