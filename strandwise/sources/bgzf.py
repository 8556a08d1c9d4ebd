"""BAM records from BGZF files, by the public file format."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs

READ, ROWS = 1 << 18, 2048
_OPS, _BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_FORMATS = {"A": "c", "c": "b", "C": "B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


class _Inflated:
    """Bytes of a file of gzip members, inflated as far as is asked for."""

    def __init__(self, stream):
        self.stream, self.z, self.out, self.raw = stream, zlib.decompressobj(31), bytearray(), b""

    def take(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self.raw:
                self.raw = self.stream.read(READ)
                if not self.raw:
                    break
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            self.out += self.z.decompress(self.raw)
            self.raw = self.z.unused_data
        got = bytes(self.out[:n])
        del self.out[:n]
        if got and len(got) < n:
            raise ValueError("the file ends inside a record")
        return got


def _tags(b: bytes) -> list[tuple[str, str]]:
    out, at = [], 0
    while at + 3 <= len(b):
        name, kind = b[at : at + 2].decode(), chr(b[at + 2])
        at += 3
        if kind in "ZH":
            end = b.index(0, at)
            out.append((name, b[at:end].decode()))
            at = end + 1
        elif kind == "B":
            n = struct.unpack_from("<I", b, at + 1)[0]
            at += 5 + n * _SIZES[chr(b[at])]
        else:
            v = struct.unpack_from(_FORMATS[kind], b, at)[0]
            out.append((name, v.decode() if kind == "A" else str(v)))
            at += _SIZES[kind]
    return out


def alignments(path: str) -> Iterator[pa.RecordBatch]:
    """Record batches of the file's alignment records."""
    names = ["query_name", "flag", "reference_name", "reference_start", "mapq", "cigar", "query_sequence", "tags"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(at, compression=None) as stream:
        f = _Inflated(stream)
        if f.take(4) != b"BAM\x01":
            raise ValueError(f"not a BAM file: {path}")
        f.take(struct.unpack("<i", f.take(4))[0])
        refs = []
        for _ in range(struct.unpack("<i", f.take(4))[0]):
            refs.append(f.take(struct.unpack("<i", f.take(4))[0])[:-1].decode())
            f.take(4)
        rows = []
        while size := f.take(4):
            b = f.take(struct.unpack("<i", size)[0])
            ref, pos, name, mapq, _, ops, flag, bases = struct.unpack_from("<iiBBHHHi", b)
            at = 32 + name
            cigar = "".join(f"{v >> 4}{_OPS[v & 15]}" for v in struct.unpack_from(f"<{ops}I", b, at)) or "*"
            at += 4 * ops
            seq = "".join(_BASES[v >> 4] + _BASES[v & 15] for v in b[at : at + (bases + 1) // 2])[:bases] or "*"
            at += (bases + 1) // 2 + bases
            rows.append((b[32 : 31 + name].decode(), flag, refs[ref] if ref >= 0 else "*", pos, mapq, cigar, seq, _tags(b[at:])))
            if len(rows) == ROWS:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)
