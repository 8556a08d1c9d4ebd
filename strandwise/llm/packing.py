"""Packing along a space-filling curve.

A document's hashed word counts are projected to three dimensions, each dimension is cut to 8 bits,
and the cell's place on the Hilbert curve is the sort key. Cut points of (key, row hash), from a
sample, put neighbours on the curve into the same partition; ties of equal texts are split by the
hash of doc_id and text, so a group of copies fills many partitions. Each document moves once, with
its text. Each partition tokenises its documents in order and cuts the stream into sequences of
exactly ``length`` ids; rows that a mix repeats one after the other go along the curve once each
turn, not side by side. What is left at a partition's end is cut into sequences of power-of-two
lengths, the longest first, which need no padding either.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textkernel import utf8_chunks, word_hashes, words

LENGTH, END, DIMS, BITS, SAMPLE = 2048, 1, 3, 8, 20_000
#: The most partitions that cut points are found for; larger tables have larger partitions, which are sorted with spill and
#: streamed, so a task's memory stays the same: 100 TB in 65,536 tasks are 1.5 GB each.
MOST_PARTS = 65_536
#: The text pattern of this byte-level BPE, as its vocabulary's documentation gives it (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokenizer:
    """Ids of a ``tokenizers`` byte-level BPE file, computed by tiktoken where both agree.

    The same merges as a rank table make tiktoken several times faster; it is used if the rank file lies beside the
    vocabulary. A text that holds a special token's string goes through ``tokenizers`` itself, which treats it as such.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Slow

        self.slow, self.fast, self.special = Slow.from_file(path), None, []
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
            self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of rows of ``cells`` (n x dims, each below 2**bits), by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & (q - 1)
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(column: pa.Array, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of texts: each word's hash gives it a +-1 in every dimension; the mean over the words, times the root
    of their number, is near a normal variable for unrelated words and is cut at equal shares of that."""
    out = np.zeros(len(column), np.int64)
    cuts = _normal_cuts(1 << bits)
    for row, data, off in utf8_chunks(column):
        starts, ends, first = words(data, off)
        h = word_hashes(data, starts, ends)
        count = np.diff(first)
        cells = np.empty((len(off) - 1, dims), np.int64)
        root = np.sqrt(np.maximum(count, 1))
        for d in range(0, dims, 2):  # two sums share one running total, each in 32 bits
            pair = ((h >> np.uint64(7 * d + 3)) & np.uint64(1)) | (((h >> np.uint64(7 * d + 10)) & np.uint64(1)) << np.uint64(32))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(pair)])
            ups = total[first[1:]] - total[first[:-1]]
            for e, up in ((d, ups & np.uint64(0xFFFFFFFF)), (d + 1, ups >> np.uint64(32))):
                if e < dims:
                    cells[:, e] = np.searchsorted(cuts, (2 * up.astype(np.int64) - count) / root)
        out[row : row + len(off) - 1] = hilbert_index(cells, bits)
    return out


def _normal_cuts(n: int) -> np.ndarray:
    from statistics import NormalDist

    spread = NormalDist(0, 2.5)  # texts of one language lean to one side
    return np.array([spread.inv_cdf(i / n) for i in range(1, n)])


def _boundaries(src: DataFrame, rows: int, parts: int, sample: int = SAMPLE, seed: int = 3) -> list[tuple[int, int]]:
    """(key, row hash) cut points for about ``parts`` partitions of equal bytes, from about ``sample`` rows drawn one by one, or
    8 a partition if that is more: 524,288 at most.

    They only balance the partitions: every document is placed by its own key.
    """
    if parts <= 1 or not rows:
        return []

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(curve_keys(b.column(0))), b.column(1), b.column(2)], names=["key", "h", "n"])

    drawn = src.sample(min(1.0, max(sample, 8 * parts) / rows), seed).select("text", "h", F.octet_length("text").cast("long").alias("n"))
    found = drawn.mapInArrow(sized, "key long, h long, n long").toPandas().sort_values(["key", "h"])
    keys, hashes, sizes = (found[c].tolist() for c in ("key", "h", "n"))
    each, held, cuts = sum(sizes) / parts, 0, []
    for key, h, n in zip(keys, hashes, sizes, strict=True):
        if held >= each * (len(cuts) + 1) and (not cuts or cuts[-1] < (key, h)):
            cuts.append((key, h))
        held += n
    return cuts


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, partition_bytes: int = 8 << 20) -> DataFrame:
    """The pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of docs(doc_id, text).

    A null text is empty: its document is the end id alone. Repeated rows are packed each; only rows equal in doc_id and text
    can't be parted by a cut point, and are sorted with spill and streamed. A very long text is tokenised whole and cut over
    as many sequences as it fills. Sequence ids are unique, with the partition in the upper 31 bits; pieces fill a sequence
    without gaps. An empty table gives no piece, other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer or default_tokenizer()
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    src = src.withColumn("h", F.xxhash64(F.lit(5), "doc_id", "text"))

    total, rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    parts = min(MOST_PARTS, max(1, -(-(total or 0) // partition_bytes)))
    cuts = _boundaries(src, rows, parts)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, turn = None, 0
        for b in batches:
            keys, h = curve_keys(b.column(1)), b.column(2).to_pylist()
            part = [bisect.bisect_right(cuts, at) for at in zip(keys.tolist(), h, strict=True)]
            turns = []
            for x in h:
                turn = turn + 1 if x == before else 0
                before = x
                turns.append(turn)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys), pa.array(part, pa.int32()), pa.array(turns, pa.int32())], names=["doc_id", "text", "h", "key", "part", "turn"])

    ordered = src.mapInArrow(keyed, "doc_id long, text string, h long, key long, part int, turn int").repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "turn", "key", "h")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tokenizer(path)
        base, sequence, room = 0, 0, length
        tail: list[list] = []  # the pieces of the sequence that is open, with their ids
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        rows: list[tuple] = []

        def close() -> None:
            nonlocal sequence, room, tail
            at = 0
            for doc, start, ids, n in tail:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, base | sequence, at))
                at += len(ids)
            sequence, room, tail = sequence + 1, length, []

        for b in batches:
            if b.num_rows:
                base = b.column(2)[0].as_py() << 32
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(t.ids(text), np.uint32(end)).astype("<u4")
                at = 0
                while at < len(ids):
                    piece = ids[at : at + room]
                    tail.append([doc, at, piece, len(ids)])
                    room -= len(piece)
                    at += len(piece)
                    if room == 0:
                        close()
            if rows:
                yield batch(rows)
                rows = []
        left, held = tail, length - room
        while held:  # powers of two, the longest first
            room, tail = 1 << (held.bit_length() - 1), []
            held -= room
            while room:
                doc, start, ids, n = left.pop(0)
                if len(ids) > room:
                    left.insert(0, [doc, start + room, ids[room:], n])
                    ids = ids[:room]
                tail.append([doc, start, ids, n])
                room -= len(ids)
            close()
        if rows:
            yield batch(rows)

    return ordered.select("doc_id", "text", "part").mapInArrow(cut, SCHEMA)
