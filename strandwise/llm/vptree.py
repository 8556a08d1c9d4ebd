"""Nearest neighbours by largest inner product with vantage-point trees, one tree per shard.

The largest inner product becomes the smallest Euclidean distance once each row x gets one more
component sqrt(M^2 - |x|^2), M being the largest norm of all rows, and each query a zero. Rows are
dealt to shards by a hash; a shard's distinct vectors are split at the median distance from a
vantage point until a leaf holds few of them, and each child keeps the range of its distances. A
query first searches its most promising leaf; a leaf is then skipped when the triangle inequality
puts it beyond ``factor`` times the distance of the k-th best so far. A second walk then takes every
vector that reaches the k-th best product, however many tie there. Factor 1 is the exact search, a
smaller factor skips more.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, scratch_path, small_batches
from .vectors import matrix, pack, unpack

LEAF, NOBODY = 64, -(1 << 63)


def build(x: np.ndarray, top: float, seed: int = 1, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """A tree over the rows of x, none longer than sqrt(top)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    lift = np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]])
    order = np.arange(len(x))
    vantage, parent, low, high, node, leaves = [], [], [], [], [], []
    # each open part: rows a..b of order, its parent's vantage point and the range of its distances from it
    todo = [(0, len(x), -1, 0.0, np.inf)]
    while todo:
        a, b, up, lo, hi = todo.pop()
        parent.append(up)
        low.append(lo)
        high.append(hi)
        me = len(parent) - 1
        if b - a <= leaf:
            vantage.append(-1)
            leaves.append((me, a, b))
            continue
        v = order[a + int(rng.integers(b - a))]
        vantage.append(v)
        d = np.sqrt(((lift[order[a:b]] - lift[v]) ** 2).sum(1))
        near = np.argsort(d, kind="stable")
        order[a:b], d = order[a:b][near], d[near]
        m = (b - a) // 2
        todo.append((a, a + m, me, d[0], d[m - 1]))
        todo.append((a + m, b, me, d[m], d[-1]))
    return {"x": x, "order": order, "vantage": np.array(vantage), "parent": np.array(parent), "low": np.array(low), "high": np.array(high), "leaves": np.array(leaves).reshape(-1, 3), "top": np.array([top])}


def search(t: dict[str, np.ndarray], q: np.ndarray, best: np.ndarray, me: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs whose inner product is at least the k-th largest so far, less a margin for rounding.

    ``best`` holds the k largest products of each query in the shards before and takes those found here; rows that are the
    query's own (``sole`` equal to ``me``) don't count.
    """
    x, top, k = t["x"], float(t["top"][0]), best.shape[1]
    q2 = (q * q).sum(1)
    inner = t["vantage"] >= 0
    at = np.full(len(inner), -1)
    at[inner] = np.arange(int(inner.sum()))
    dist = np.sqrt(np.maximum(top + q2[:, None] - 2 * (q @ x[t["vantage"][inner]].T), 0))
    bound = np.zeros((len(q), len(inner)))
    for n in range(1, len(inner)):  # parents come before their children
        p = t["parent"][n]
        d = dist[:, at[p]]
        bound[:, n] = np.maximum(bound[:, p], np.maximum(d - t["high"][n], t["low"][n] - d))
    # a distance is the root of a difference, so it may be off by the root of a rounding of the largest term
    reach = bound[:, t["leaves"][:, 0]] - 1e-6 * np.sqrt(top + q2)[:, None]

    def scored(active: np.ndarray, rows: np.ndarray) -> np.ndarray:
        s = q[active] @ x[rows].T
        s[t["sole"][rows][None, :] == me[active][:, None]] = -np.inf
        return s

    def visit(leaf: int, active: np.ndarray) -> None:
        _, a, b = t["leaves"][leaf]
        s = np.hstack([best[active], scored(active, t["order"][a:b])])
        best[active] = -np.partition(-s, k - 1, axis=1)[:, :k]

    def distance(product: np.ndarray) -> np.ndarray:
        known = np.isfinite(product)
        return np.where(known, np.sqrt(np.maximum(top + q2 - 2 * np.where(known, product, 0), 0)), np.inf)

    first = reach.argmin(1)
    for leaf in range(len(t["leaves"])):
        if len(active := np.flatnonzero((first == leaf) & (reach[:, leaf] <= factor * distance(best.min(1))))):
            visit(leaf, active)
    for leaf in np.argsort(reach.mean(0)):
        if len(active := np.flatnonzero((first != leaf) & (reach[:, leaf] <= factor * distance(best.min(1))))):
            visit(leaf, active)
    least = best.min(1) - 4 * x.shape[1] * np.finfo(float).eps * np.sqrt(q2 * top)
    tau, asked, found = distance(least), [np.zeros(0, int)], [np.zeros(0, int)]
    for leaf, (_, a, b) in enumerate(t["leaves"]):
        active = np.flatnonzero(reach[:, leaf] <= np.maximum(factor * tau, np.where(first == leaf, tau, 0)))
        if len(active):
            rows = t["order"][a:b]
            s = scored(active, rows)
            i, j = np.nonzero((s >= least[active][:, None]) & np.isfinite(s))
            asked.append(active[i])
            found.append(rows[j])
    return np.concatenate(asked), np.concatenate(found)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of matching rows, added from left to right."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _write(path: str, name: str, data: bytes) -> str:
    """A file in the shared folder under its final name; a task that runs again leaves the same."""
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    temporary = f"{root}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        out.write(data)
    try:
        fs.move(temporary, f"{root}/{name}")
    except OSError:  # some stores don't move onto a file that is there
        if fs.get_file_info(f"{root}/{name}").type != pafs.FileType.File:
            raise
        fs.delete_file(temporary)
    return f"{path}/{name}"


def _read(path: str) -> bytes:
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(at, compression=None) as f:
        return f.read()


def nearest(df: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, shard_rows: int = 8192, block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product for each query row of df(vec_id, embedding).

    Nearest first, ties to the smaller vec_id, the query's own vec_id left out; fewer rows than k come back whole. Vectors
    that are null, empty, zero or with null or non-finite components take no part, nor do rows without a vec_id; vectors of
    different widths have no product and don't meet. A vec_id that repeats is a candidate as often as it comes, and one
    query: of its several vectors the one whose bytes come first asks. An empty table gives none.

    Each shard's tree is one file in the shared folder. A block of queries reads tree after tree and keeps its k best, so
    what is shuffled are the queries and their results, once for each of the few groups of shards that keep all cores busy.
    """
    spark = df.sparkSession
    small_batches(spark)
    kind = df.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    dtype = "<f4" if single else "<f8"
    src = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("e"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where("vec_id is not null")

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(b.column(1).value_lengths().fill_null(0)).astype(np.int32)
            for w in np.unique(sizes[sizes > 0]).tolist():
                x, ok = matrix(b.column(1), w)
                if ok.any():
                    m = pa.array(ok)
                    x = x[ok]
                    yield pa.RecordBatch.from_arrays([b.column(0).filter(m), b.column(2).filter(m), pa.array(np.full(len(x), w, np.int32)), pack(x, dtype), pa.array((x * x).sum(1))], names=["vec_id", "is_query", "w", "v", "n2"])

    rows = materialize(src.mapInArrow(usable, "vec_id long, is_query boolean, w int, v binary, n2 double"))
    out = None
    for w in sorted(r["w"] for r in rows.select("w").distinct().collect()):
        one = _nearest(rows.where(F.col("w") == w), w, dtype, k, factor, shard_rows, block)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _nearest(rows: DataFrame, width: int, dtype: str, k: int, factor: float, shard_rows: int, block: int) -> DataFrame:
    spark = rows.sparkSession
    n, top, asked = rows.agg(F.count("*"), F.max("n2"), F.count_if("is_query")).first()
    shards, blocks, top = max(1, -(-n // shard_rows)), max(1, -(-asked // block)), float(top or 0) * (1 + 1e-12)
    folder = scratch_path(spark)

    def index(t: pa.Table) -> pa.Table:
        ids, v = np.asarray(t["vec_id"]), t["v"].combine_chunks()
        groups: dict[bytes, list[int]] = {}
        for i, b in zip(ids.tolist(), v.to_pylist(), strict=True):
            groups.setdefault(b, []).append(i)
        keys = sorted(groups, key=lambda b: (min(groups[b]), b))
        x = np.frombuffer(b"".join(keys), dtype).reshape(len(keys), width).astype(float)
        owners = [sorted(groups[b]) for b in keys]
        sole = np.array([o[0] if o[0] == o[-1] else NOBODY for o in owners])
        file, shard = io.BytesIO(), t["shard"][0].as_py()
        np.savez(file, **(build(x, top) | {"x": x.astype(dtype)}), ids=np.concatenate(owners), ends=np.cumsum([len(o) for o in owners]), sole=sole)
        return pa.table({"shard": pa.array([shard], pa.int32()), "path": pa.array([_write(folder, f"shard-{shard:07d}.npz", file.getvalue())])})

    dealt = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"))
    # the paths of n / shard_rows files
    paths = [r["path"] for r in materialize(dealt.groupBy("shard").applyInArrow(index, "shard int, path string")).orderBy("shard").collect()]
    turns = min(len(paths), max(1, -(-3 * spark.sparkContext.defaultParallelism // blocks))) or 1
    queries = rows.where("is_query").groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))

    def ask(qs: pa.Table) -> pa.Table:
        q, me = unpack(qs["v"].combine_chunks(), width, dtype), np.asarray(qs["vec_id"])
        best = np.full((len(q), k), -np.inf)
        found: list[list[tuple[float, int]]] = [[] for _ in me]
        for path in paths[qs["turn"][0].as_py() :: turns]:
            t = dict(np.load(io.BytesIO(_read(path))))
            t["x"] = t["x"].astype(float)
            starts = np.concatenate([[0], t["ends"][:-1]])
            which, at = search(t, q, best, me, factor)
            score = products(q[which], t["x"][at])
            order = np.argsort(which, kind="stable")
            which, at, score = which[order], at[order], score[order]
            cut = np.flatnonzero(np.diff(which)) + 1
            for w, r, s in zip(np.split(which, cut), np.split(at, cut), np.split(score, cut), strict=True):
                if not len(w):
                    continue
                i, mine = int(w[0]), int(me[w[0]])
                near = found[i]
                for row, value in zip(r.tolist(), s.tolist(), strict=True):
                    ids = t["ids"][starts[row] : t["ends"][row]]
                    near.extend((-value, c) for c in ids[ids != mine][:k].tolist())
                found[i] = sorted(near)[:k]
        return pa.table({"query_id": pa.array(me, pa.int64()), "ids": pa.array([[c for _, c in f] for f in found], pa.list_(pa.int64())), "scores": pa.array([[-a for a, _ in f] for f in found], pa.list_(pa.float64()))})

    parts = queries.groupBy("block", "turn").applyInArrow(ask, "query_id long, ids array<long>, scores array<double>")
    pairs = parts.select("query_id", F.transform(F.arrays_zip("scores", "ids"), lambda p: F.struct((-p["scores"]).alias("d"), p["ids"].alias("vec_id"))).alias("p"))
    merged = pairs.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, k).alias("p"))
    return merged.select("query_id", F.posexplode("p").alias("i", "p")).select("query_id", (F.col("i") + 1).alias("rank"), F.col("p.vec_id").alias("vec_id"), (-F.col("p.d")).alias("score"))
