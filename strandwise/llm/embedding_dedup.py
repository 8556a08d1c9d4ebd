"""Embedding near-dedup by collision-counting projections.

Unit vectors are projected on many random lines. For two vectors at a given cosine the difference
on a line is normal with a known spread, so a query-centred window of 1.5 spreads holds a pair at
the threshold with probability 0.866; a pair is verified only if it collides in at least ``t`` of
64 windows, ``t`` being the largest count that such a pair misses with probability below 1e-6.

Pairs to count come from projections as well. ``LINES`` lines make a bundle, and a vector falls into
the end of the line on which it lies furthest out; ``g`` bundles together make a cell, and
``tables`` independent sets of bundles are used. g grows with the logarithm of the number of vectors
so that unrelated vectors seldom share a cell; the number of tables follows from the recall asked for
at the threshold and the chance, drawn once by simulation, that a pair shares an end. Rows are sorted
by cell; small cells are counted with shifted comparisons over the whole batch, large ones in
blocks of bounded size, each block pair in a task of its own. No pair is ever a row: a cell sends
on, for each vector, how many others it links to and the smallest linked one along a spanning
forest. A pair that shares several cells is counted in the first table only. Only vectors that share
a cell with another one are moved to it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, gathered, materialize, small_batches
from .components import connected_components
from .textkernel import mix64
from .vectors import matrix, pack, unit, unpack

MISS, BLOCK, COUNTED, SMALL, LINES, UNRELATED = 1e-5, 768, 64, 12, 64, 0.05


def _shared_end(cosine: float, lines: int = LINES, draws: int = 40_000) -> float:
    """Chance that two vectors at this cosine lie furthest out at the same end of a bundle, whatever their width."""
    rng = np.random.Generator(np.random.PCG64(99))
    x = rng.standard_normal((draws, lines))
    y = cosine * x + math.sqrt(max(1 - cosine * cosine, 0)) * rng.standard_normal((draws, lines))
    a, b = np.abs(x).argmax(1), np.abs(y).argmax(1)
    at = np.arange(draws)
    return float(((a == b) & (np.sign(x[at, a]) == np.sign(y[at, b]))).mean())


class Plan:
    """Bundles, windows and the count threshold; a function of the width, the rows and the cosine."""

    def __init__(self, width: int, rows: int, cosine: float, seed: int = 20240607):
        self.width, self.cosine = width, cosine
        gap = math.sqrt(max(2 - 2 * cosine, 1e-12))
        spread = gap / math.sqrt(width)
        near = min(max(_shared_end(cosine) - 0.01, 0.01), 0.99)
        self.g = max(1, math.ceil(math.log(max(rows, 2) / UNRELATED) / math.log(2 * LINES)))
        self.tables = max(1, math.ceil(math.log(MISS) / math.log(1 - near**self.g)))
        rng = np.random.Generator(np.random.PCG64(seed))
        self.lines = rng.standard_normal((width, self.tables * self.g * LINES)).astype("<f4")
        self.factors = rng.integers(1, 1 << 63, self.tables * self.g, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.names = mix64(np.arange(1, self.tables + 1, dtype=np.uint64))
        self.window = 1.5 * spread
        self.counted = rng.standard_normal((width, COUNTED))
        self.counted /= np.sqrt((self.counted**2).sum(0))
        p, tail, t = math.erf(1.5 / math.sqrt(2)), 0.0, 0
        while tail + (q := math.comb(COUNTED, t) * p**t * (1 - p) ** (COUNTED - t)) < 1e-6:
            tail, t = tail + q, t + 1
        self.t = t

    def cells(self, u: np.ndarray) -> np.ndarray:
        """Rows x tables of cell keys."""
        out = np.empty((len(u), self.tables), np.uint64)
        u = u.astype("<f4")
        for t in range(self.tables):
            s = slice(t * self.g, (t + 1) * self.g)
            on = (u @ self.lines[:, s.start * LINES : s.stop * LINES]).reshape(len(u), self.g, LINES)
            far = np.abs(on).argmax(2)
            end = 2 * far + (np.take_along_axis(on, far[:, :, None], 2)[:, :, 0] > 0)
            out[:, t] = mix64((mix64(end.astype(np.uint64) + np.uint64(1)) * self.factors[s]).sum(1, dtype=np.uint64) + self.names[t])
        return out


def _link(plan: Plan, u: np.ndarray, lines: np.ndarray, cells: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the candidate pairs (a, b) of rows, met in table[a], collide often enough, are near and share no earlier table."""
    keep = np.flatnonzero((np.abs(lines[a] - lines[b]) <= plan.window).sum(1) >= plan.t)
    keep = keep[(u[a[keep]] * u[b[keep]]).sum(1) >= plan.cosine]
    return keep[(cells[a[keep]] == cells[b[keep]]).argmax(1) == table[a[keep]]]


def _root(parent: dict[int, int], x: int) -> int:
    while (p := parent.setdefault(x, x)) != x:
        parent[x] = x = parent[p]
    return x


def _found(classes: DataFrame, plan: Plan, dtype: str) -> DataFrame:
    """(cid, near, links): for each class, cell by cell, rows linked to it and the smallest class of its spanning tree there."""
    width = plan.width

    def into_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, 4096):
            keys = plan.cells(unit(unpack(b.column(1), width, dtype)))
            offsets = pa.array(np.arange(b.num_rows + 1) * plan.tables, pa.int32())
            lows = [r.tobytes() for r in keys.astype("<u4")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(lows, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64)))], names=["cid", "v", "copies", "lows", "cells"])

    placed = materialize(classes.select("cid", "v", "copies").mapInArrow(into_cells, "cid long, v binary, copies long, lows binary, cells array<long>"))
    member = placed.select("cid", F.posexplode("cells").alias("t", "cell"))
    shared = member.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cell").alias("c"), F.ceil(F.col("n") / BLOCK).cast("int").alias("k"))
    tasks = member.join(shared, member.cell == shared.c).select("cid", "t", "cell", "k", F.pmod(F.xxhash64("cid", "cell"), F.col("k")).cast("int").alias("s"))
    tasks = tasks.select("cid", "t", "cell", "s", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    tasks = materialize(tasks.select("cid", "t", "cell", "s", F.least("s", "j").alias("lo"), F.greatest("s", "j").alias("hi")))
    full = tasks.join(placed.select("cid", "v", "copies", "lows"), "cid").repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi", "cid")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def handle(t: pa.Table) -> pa.RecordBatch:
            cid, table, cell, s, lo, hi, copies = (np.asarray(t[c]) for c in ("cid", "t", "cell", "s", "lo", "hi", "copies"))
            u = unit(unpack(t["v"].combine_chunks(), width, dtype))
            cells = np.frombuffer(b"".join(t["lows"].to_pylist()), "<u4").reshape(len(cid), plan.tables)
            lines = u @ plan.counted
            change = np.flatnonzero((np.diff(cell) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
            edge = np.concatenate([[0], change, [len(cid)]])
            size, group = np.diff(edge), np.repeat(np.arange(len(edge) - 1), np.diff(edge))
            pairs: list[tuple[np.ndarray, np.ndarray]] = []
            small = size <= SMALL
            for d in range(1, SMALL):
                a = np.flatnonzero((group[d:] == group[:-d]) & small[group[d:]])
                pairs.append((a, a + d))
            for g in np.flatnonzero(~small):
                i = np.arange(edge[g], edge[g + 1])
                a, b = np.nonzero(np.triu(u[i] @ u[i].T >= plan.cosine - 1e-9, 1))
                pairs.append((i[a], i[b]))
            links, parent = np.zeros(len(cid), np.int64), {}
            for a, b in pairs:
                for at in range(0, len(a), 65536):
                    x, y = a[at : at + 65536], b[at : at + 65536]
                    # a pair inside one block belongs to the task of that block alone
                    own = ((s[x] == lo[x]) & (s[y] == hi[y])) | ((s[x] == hi[x]) & (s[y] == lo[y]))
                    x, y = x[own], y[own]
                    if not len(x):
                        continue
                    got = _link(plan, u, lines, cells, table, x, y)
                    x, y = x[got], y[got]
                    np.add.at(links, x, copies[y])
                    np.add.at(links, y, copies[x])
                    for i, j in zip(cid[x].tolist(), cid[y].tolist(), strict=True):
                        i, j = _root(parent, i), _root(parent, j)
                        if i != j:
                            parent[max(i, j)] = min(i, j)
            on = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array(cid[on]), pa.array([_root(parent, i) for i in cid[on].tolist()], pa.int64()), pa.array(links[on])], names=["cid", "near", "links"])

        def key(b: pa.RecordBatch, i: int) -> tuple:
            return tuple(b.column(c)[i].as_py() for c in ("cell", "lo", "hi"))

        for b in batches:
            if not b.num_rows:
                continue
            # cut before the last group, which may go on in the next batch
            last, n = key(b, b.num_rows - 1), b.num_rows
            same = (np.asarray(b.column("cell")) == last[0]) & (np.asarray(b.column("lo")) == last[1]) & (np.asarray(b.column("hi")) == last[2])
            cut = n - int(same.sum())
            if cut or (held and key(held[-1], 0) != last):
                done = [*held, *([b.slice(0, cut)] if cut else [])]
                yield handle(pa.Table.from_batches(done))
                held = []
            held.append(b.slice(cut))
        if held:
            yield handle(pa.Table.from_batches(held))

    out = materialize(full.select("cid", "t", "cell", "s", "lo", "hi", "v", "copies", "lows").mapInArrow(search, "cid long, near long, links long"))
    discard(tasks, placed)
    return out


def near_duplicate_vectors(df: DataFrame, cosine: float = 0.95, seed: int = 20240607) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for df(vec_id, embedding).

    Links all pairs of rows with a cosine of at least ``cosine`` in double precision. Vectors that are null, empty, zero
    or with null or non-finite components link with nothing, as do rows whose vec_id is null; vectors of different widths
    have no cosine and don't link, each width is searched. Equal vectors are folded before the search and count as links of
    each other. A repeated row is one more vector with the same vec_id, and so is another vector under that vec_id: each
    has its own links, and only links join components. An empty table gives an empty result; other columns are not looked at.
    """
    spark = df.sparkSession
    small_batches(spark)
    kind = df.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    dtype = "<f4" if single else "<f8"
    src = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("e"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(b.column(1).value_lengths().fill_null(0)).astype(np.int32)
            v, h = [None] * len(sizes), [None] * len(sizes)
            for w in np.unique(sizes[sizes > 0]).tolist():
                x, ok = matrix(b.column(1), w)
                idx = np.flatnonzero(ok)
                for i, r in zip(idx.tolist(), pack(x[idx] + 0.0, dtype).to_pylist(), strict=True):  # -0.0 is 0.0
                    v[i], h[i] = r, hashlib.blake2b(r, digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(h, pa.binary()), pa.array(v, pa.binary())], names=["vec_id", "w", "h", "v"])

    rows = materialize(src.mapInArrow(packed, "vec_id long, w int, h binary, v binary"))
    classes = rows.where("h is not null and vec_id is not null").groupBy("h", "w", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # vec_ids may repeat with different vectors; a class is known by a number that is written once
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    found = None
    for w, n in sorted((r["w"], r["count"]) for r in classes.groupBy("w").count().collect()):
        one = _found(classes.where(F.col("w") == w), Plan(w, n, cosine, seed), dtype)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "cid long, near long, links long")
    links = found.groupBy("cid").agg(F.sum("links").alias("links")).withColumnRenamed("cid", "c1")
    comp = connected_components(found.select(F.col("cid").alias("u"), F.col("near").alias("v")))
    # components are known by a class number; they are named by their smallest vec_id
    named = comp.join(classes.select("cid", "rep"), comp.node == F.col("cid"))
    lowest = named.groupBy("component").agg(F.min("rep").alias("low")).withColumnRenamed("component", "c2")
    comp = comp.join(lowest, comp.component == lowest.c2).select("node", "low")
    known = classes.select("h", "cid", "rep", "copies").join(links, F.col("cid") == F.col("c1"), "left").join(comp, F.col("cid") == F.col("node"), "left")
    known = known.select(F.col("h").alias("kh"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("low", "rep").alias("component_id"))
    linkable = F.when(F.col("vec_id").isNotNull(), F.col("h"))
    out = rows.select("vec_id", linkable.alias("h0")).join(known, F.col("h0") == F.col("kh"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
