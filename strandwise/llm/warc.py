"""WARC archives: one gzip member a record, written to the shared folder and read back in sequence.

Writing: payload digests come first and are small; of equal payloads the largest page_id is the
response and the others revisit it. Each task then writes its pages to archives of bounded size, under a
temporary name and renamed, so a task that runs again leaves the same files. Reading: a
task streams one archive in blocks of 64 kB through an incremental zlib decompressor, takes each
record's block by its Content-Length, and verifies length and digests before it yields the record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path, small_batches

DATE, READ, SALTS = "2024-01-01T00:00:00Z", 1 << 16, 16
MANIFEST = "path string, records long, bytes long"


class WarcError(ValueError):
    pass


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE, place: str = "") -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header, whose Content-Length is that of the full payload. A page
    without an id is named by its ``place`` in the archives."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(place if page_id is None else page_id)}", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    head.append(f"WARC-Block-Digest: sha1:{digest(block)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"X-Page: {page_id}"] if page_id is not None else []
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _fields(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"no colon in header line {line[:80]!r}")
        out[name.strip().decode().lower()] = value.strip().decode()
    return out


class _Member:
    """One gzip member, decompressed as far as is asked for."""

    def __init__(self, stream, left: bytes):
        self.stream, self.raw, self.z, self.out = stream, left, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        if self.z.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(READ)
            if not self.raw:
                raise WarcError("the archive ends inside a record")
        try:
            self.out += self.z.decompress(self.raw, READ)
        except zlib.error as e:
            raise WarcError(f"damaged gzip member: {e}") from None
        self.raw = self.z.unconsumed_tail or (self.z.unused_data if self.z.eof else b"")
        return True

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.out.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.out)
            if not self.more():
                raise WarcError("a record has no end of its header")
        got = bytes(self.out[:at])
        del self.out[: at + len(mark)]
        return got

    def take(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self.more():
                raise WarcError("a record is shorter than its Content-Length")
        got = bytes(self.out[:n])
        del self.out[:n]
        return got


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of a binary stream, in order; raises WarcError at damage."""
    left = stream.read(READ)
    while left:
        m = _Member(stream, left)
        head = m.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/1."):
            raise WarcError("a record doesn't begin with WARC/1.")
        fields = _fields(head)
        block = m.take(int(fields["content-length"]))
        if m.take(4) != b"\r\n\r\n" or m.out:
            raise WarcError("a record is longer than its Content-Length")
        while m.more():
            if m.out:
                raise WarcError("a record is longer than its Content-Length")
        if (want := fields.get("warc-block-digest")) and want != f"sha1:{digest(block)}":
            raise WarcError(f"block digest of {fields.get('warc-record-id')} differs")
        left = m.raw or stream.read(READ)
        yield fields, block


def page_of(fields: dict[str, str], block: bytes) -> dict:
    """The page that a record holds, its payload digest verified where the payload is there."""
    http, mark, payload = block.partition(b"\r\n\r\n")
    if not mark:
        raise WarcError("no end of the HTTP header")
    size, claimed = int(_fields(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != size or digest(payload) != claimed):
        raise WarcError(f"payload of {fields.get('warc-record-id')} differs from its digest or length")
    to, page = fields.get("x-refers-to-page"), fields.get("x-page")
    return {"page_id": None if page is None else int(page), "payload_bytes": size, "payload_digest": claimed, "record_type": fields["warc-type"], "refers_to": None if to is None else int(to), "url": fields.get("warc-target-uri"), "payload": payload if fields["warc-type"] == "response" else None}


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = 32 << 20) -> DataFrame:
    """Write pages(page_id, url, html) to ``path`` (shared by all executors) and return (path, records, bytes) per archive.

    The payload is the html in UTF-8, a null html is empty; other columns are not looked at. Payloads of fewer than
    ``min_bytes`` are never revisited. A page_id that repeats with equal payloads is one response and revisits of it. A page
    without a page_id is a response always, as nothing could refer to it, and is read back without one. A very long payload is
    one record. An empty table gives no archive.
    """
    small_batches(pages.sparkSession)
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    payload = F.col("html").cast("binary")
    prints = src.select("page_id", F.sha1(payload).alias("sha"), F.octet_length("html").cast("long").alias("n"))
    prints = materialize(prints)
    named = prints.where("page_id is not null")
    best = named.where(F.col("n") >= min_bytes).groupBy("sha", "n").agg(F.max("page_id").alias("to"), F.count("*").alias("c")).where("c > 1")
    # a payload that very many pages share, such as the empty one, is dealt over SALTS tasks
    best = best.select(F.col("sha").alias("s2"), F.col("n").alias("n2"), "to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt2"))
    salted = named.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    to = salted.join(best, (F.col("sha") == F.col("s2")) & (F.col("n") == F.col("n2")) & (F.col("salt") == F.col("salt2"))).where("page_id <> to").select(F.col("page_id").alias("p2"), F.col("sha").alias("s3"), "to").distinct()
    # Written first: a small table of revisits is then known to be small, and the pages need not move to meet it.
    to = materialize(to)
    x = src.withColumn("sha", F.sha1(F.col("html").cast("binary"))).join(to, (F.col("page_id") == F.col("p2")) & (F.col("sha") == F.col("s3")), "left").select("page_id", "url", "html", "sha", "to")
    # Rows of one page_id must be together to tell which of them is the response; where ids are unique nothing need move.
    if not named.groupBy("page_id").count().where("count > 1").isEmpty():
        # those without an id spread by their payload
        x = x.repartition(F.coalesce("page_id", F.xxhash64("sha", "url"))).sortWithinPartitions("page_id", "sha")
    x = x.select("page_id", "url", "html", "to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, turn, out, n, size, last, seen = TaskContext.get().partitionId(), 0, None, 0, 0, None, 0
        fs, root = pafs.FileSystem.from_uri(path)
        temporary = f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"

        def close() -> pa.RecordBatch:
            nonlocal turn, out, n, size
            name = f"part-{part:06d}-{turn:04d}.warc.gz"
            out.close()
            fs.move(temporary, f"{root}/{name}")
            done = pa.RecordBatch.from_pydict({"path": [f"{path}/{name}"], "records": [n], "bytes": [size]})
            turn, out, n, size = turn + 1, None, 0, 0
            return done

        for b in batches:
            for p, url, html, to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(temporary)
                data = html.encode()
                if to is None and p is not None:
                    if last == (p, now := digest(data)) and len(data) >= min_bytes:
                        to = p
                    last = (p, now)
                seen += 1
                r = record(p, url, data, to, place=f"{path}/{part}/{seen}")
                out.write(r)
                n, size = n + 1, size + len(r)
                if size >= archive_bytes:
                    yield close()
        if out is not None:
            yield close()

    return materialize(x.mapInArrow(run, MANIFEST))


def read_archives(spark: SparkSession, archives: DataFrame, payloads: bool = True) -> DataFrame:
    """All pages of the archives in archives(path): page_id, payload_bytes, payload_digest, record_type, refers_to, url
    and, if asked for, the payload (null for revisits)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", *(["payload"] if payloads else [])]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for fields, block in read_records(stream):
                        rows.append(page_of(fields, block))
                        held += len(block)
                        if len(rows) >= 512 or held > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=False)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=False)], names=names)

    n = max(1, archives.count())
    return archives.select("path").repartition(min(n, 4096)).mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write archives for pages and read them back."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, path or scratch_path(spark), min_bytes), payloads=False)
