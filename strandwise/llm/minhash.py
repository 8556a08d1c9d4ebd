"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star edges.

One pass sketches each document: the sorted set of its word-shingle hashes is split over
``bands * rows`` bins by one permutation, empty bins borrow from a random filled bin (the same
choice in every document), and each band of ``rows`` bins becomes a bucket key. Documents of equal
sets are folded first, so a group of copies counts once. In a bucket each document is paired with
one centre, the smallest; the documents around a centre meet once, however many buckets they share,
in blocks of bounded size. There each is counted against the centre on the full sets, and then
against those that are not yet linked to it through others and whose signature doesn't rule it out, so
that no link between components is lost to the star shape. Only links of a spanning forest leave a
block; a pair of candidates is never a row.

At a similarity of 0.8 and 30 bands of 5 rows a pair shares no bucket with probability 7e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, small_batches, text_or_empty
from .components import connected_components
from .textkernel import mix64, shingle_sets

BANDS, ROWS, SHINGLE, PERCENT, BLOCK = 30, 5, 5, 80, 1024
_PROBES = 1024


def _tables(bins: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(bins))
    return rng.integers(0, bins, (_PROBES, bins)), rng.integers(1, 1 << 63, bins, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(u: np.ndarray, bins: int, probes: np.ndarray) -> np.ndarray:
    """One-permutation minima of the sorted hashes ``u`` (not empty), densified."""
    sig = np.zeros(bins, np.uint64)
    full = np.zeros(bins, bool)
    at = (((u & np.uint64(0xFFFFFFFF)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    sig[at[::-1]] = u[::-1]  # the smallest of a bin is written last
    full[at] = True
    empty = np.flatnonzero(~full)
    if len(u) == 1:
        sig[:] = u[0]
        return sig
    for t in range(_PROBES):
        if not len(empty):
            break
        to = probes[t, empty]
        hit = full[to]
        sig[empty[hit]] = sig[to[hit]]
        empty = empty[~hit]
    if len(empty):
        filled = np.flatnonzero(full)
        sig[empty] = sig[filled[empty % len(filled)]]
    return sig


def _set_hash(u: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes, as two signed numbers; (0, 0) for the empty set."""
    if not len(u):
        return 0, 0
    both = np.array([u.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(u + np.uint64(7)))], np.uint64).view(np.int64)
    return int(both[0]), int(both[1])


def sketches(docs: DataFrame, shingle: int, bands: int, rows: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried long columns, n, h1, h2, keys): set size, a 128-bit hash of the set, and the bucket keys."""
    bins, ids = bands * rows, ("doc_id", *carry)
    schema = T.StructType.fromDDL(", ".join(f"`{c}` long" for c in ids) + ", n long, h1 long, h2 long, keys array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, factors = _tables(bins)
        band = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for b in batches:
            n, prints, keys, lens = [], [], [], []
            for u in shingle_sets(b.column(0), shingle):
                n.append(len(u))
                prints.append(_set_hash(u))
                lens.append(bands if len(u) else 0)
                if len(u):
                    s = (mix64(signature(u, bins, probes)) * factors).reshape(bands, rows).sum(1, dtype=np.uint64)
                    keys.append(mix64(s + band).view(np.int64))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
            h = np.array(prints, np.int64).reshape(-1, 2)
            made = [pa.array(n, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *made], names=[*ids, "n", "h1", "h2", "keys"])

    return docs.select(text_or_empty().alias("text"), *(F.col(c).cast("long").alias(c) for c in ids)).mapInArrow(run, schema)


def full_sets(texts: DataFrame, shingle: int, bins: int) -> DataFrame:
    """(cid, set, sig) of texts(text, cid, n, h1, h2): the sorted distinct shingle hashes as bytes, and one byte of each bin of the
    signature; of the texts under one doc_id only that of the class passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, _ = _tables(bins)
        for b in batches:
            cids, sets, sigs = [], [], []
            for u, cid, n, h1, h2 in zip(shingle_sets(b.column(0), shingle), *(c.to_pylist() for c in b.columns[1:]), strict=True):
                if len(u) == n and _set_hash(u) == (h1, h2):
                    cids.append(cid)
                    sets.append(u.tobytes())
                    sigs.append((mix64(signature(u, bins, probes)) >> np.uint64(56)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())], names=["cid", "set", "sig"])

    return texts.select("text", "cid", "n", "h1", "h2").mapInArrow(run, "cid long, set binary, sig binary").dropDuplicates(["cid"])


def _links_around(bins: int, percent: int):
    """The function that finds a spanning forest of the links among the documents of one block around a centre."""
    p = percent / 100
    enough = max(1.0, bins * p - 6 * (bins * p * (1 - p)) ** 0.5)

    def run(t: pa.Table) -> pa.Table:
        doc, side = np.asarray(t["cid"]), np.asarray(t["s"])
        sets = [np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()]
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(doc), bins)
        n = np.array([len(x) for x in sets])
        label, out = np.arange(len(doc)), []

        def count(i: int, js: np.ndarray) -> np.ndarray:
            """Those of js whose full sets reach the similarity with that of i."""
            flat = np.concatenate([sets[j] for j in js])
            at = np.minimum(np.searchsorted(sets[i], flat), n[i] - 1)
            hit = np.concatenate([[0], np.cumsum(sets[i][at] == flat)])
            ends = np.cumsum(n[js])
            common = hit[ends] - hit[ends - n[js]]
            return js[100 * common >= percent * (n[i] + n[js] - common)]

        def join(i: int, js: np.ndarray) -> None:
            for at in range(0, len(js), 64):
                part = js[at : at + 64]
                part = part[label[part] != label[i]]
                if len(part):
                    for j in count(i, part):
                        if label[j] != label[i]:
                            label[label == label[j]] = label[i]
                            out.append((max(doc[i], doc[j]), min(doc[i], doc[j])))

        def fits(i: int, js: np.ndarray) -> np.ndarray:
            return js[(label[js] != label[i]) & (100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i]))]

        centre = int(np.flatnonzero(side == -1)[0])
        rest = np.flatnonzero(side >= 0)
        join(centre, fits(centre, rest))
        left, right = np.flatnonzero(side == t["lo"][0].as_py()), np.flatnonzero(side == t["hi"][0].as_py())
        for k, i in enumerate(left):
            js = fits(i, right[k + 1 :] if t["lo"][0].as_py() == t["hi"][0].as_py() else right)
            if len(js):
                join(i, js[(sig[js] == sig[i]).sum(1) >= enough])
        u, v = zip(*out, strict=True) if out else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for docs(doc_id, text), and the ``carry`` columns of docs, which are numbers.

    Links documents whose sets of ``shingle``-word shingles have 100 * |both| >= percent * |either|;
    component_id is the smallest doc_id reachable, kept marks that document. Null, empty and
    wordless texts have the empty set and link with nothing. Repeated rows of one doc_id come back
    as often as they came; a doc_id with several texts is several documents, each with its own links.
    A null doc_id is never linked. Texts of any length are taken whole, in pieces of a megabyte. An
    empty table gives an empty one. Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    sk = materialize(sketches(docs, shingle, bands, rows, carry))
    usable = sk.where("n > 0 and doc_id is not null")
    classes = usable.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"))
    # a doc_id may stand for several classes; a class is known by a number that is written once
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    prints = classes.select("rep", "cid", F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("n").alias("gn"))
    same = (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("n") == F.col("gn"))
    member = usable.join(prints, same & (F.col("doc_id") == F.col("rep"))).select(F.explode("keys").alias("key"), "cid")
    shared = member.groupBy("key").agg(F.min("cid").alias("centre"), F.max("cid").alias("other")).where("centre <> other").select(F.col("key").alias("k"), "centre")
    buckets = materialize(member.join(shared, member.key == shared.k).where("cid <> centre").select("centre", "cid").distinct())

    blocks = buckets.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k")).select(F.col("centre").alias("c1"), "k")
    x = buckets.join(blocks, buckets.centre == blocks.c1).withColumn("s", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int"))
    x = x.select("centre", "cid", "s", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    x = x.select("centre", "cid", "s", F.least("s", "j").alias("lo"), F.greatest("s", "j").alias("hi"))
    hubs = blocks.select(F.col("c1").alias("centre"), F.explode(F.expr("flatten(transform(sequence(0, k - 1), a -> transform(sequence(a, k - 1), b -> struct(a AS lo, b AS hi))))")).alias("b"))
    x = materialize(x.unionByName(hubs.select("centre", F.col("centre").alias("cid"), F.lit(-1).alias("s"), "b.lo", "b.hi")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    needed = materialize(classes.join(x.select(F.col("cid").alias("d")).distinct(), F.col("cid") == F.col("d"), "left_semi"))
    # by the ids alone first: they are few bytes, and texts that aren't needed don't move if those can be broadcast
    wanted = materialize(needed.select(F.col("rep").alias("w")).distinct().sort("w"))
    texts = texts.join(wanted, F.col("doc_id") == F.col("w"), "left_semi")
    sets = full_sets(texts.join(needed, F.col("doc_id") == F.col("rep")), shingle, bands * rows)
    placed = x.join(sets, "cid").groupBy("centre", "lo", "hi")
    links = materialize(placed.applyInArrow(_links_around(bands * rows, percent), "u long, v long"))
    comp = connected_components(links)
    discard(buckets, x, needed, wanted, links)

    # Back from classes to documents; a component is named by its smallest doc_id.
    named = comp.join(classes.select("cid", "rep"), comp.node == F.col("cid"))
    lowest = named.groupBy("component").agg(F.min("rep").alias("low")).withColumnRenamed("component", "c2")
    known = prints.join(comp.join(lowest, comp.component == lowest.c2).select("node", "low"), F.col("cid") == F.col("node"), "left").select("g1", "g2", "gn", F.coalesce("low", "rep").alias("component"))
    out = sk.join(known, same, "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", *carry, F.col("n").alias("n_shingles"), component.cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
