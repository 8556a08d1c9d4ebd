import numpy as np
import pytest
from helpers import DOCS, awkward, components, shingles
from pyspark.sql import functions as F

from strandwise.llm import embedding_dedup, linededup, minhash, vptree
from strandwise.llm.components import connected_components


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_against_all_pairs(spark, k):
    rows = awkward()
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), shingle=k).collect()
    sets = {r[0]: shingles(r[1], k) for r in rows}
    ids = sorted(sets)
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(ids, linked)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicates_of_repeated_ids(spark):
    """doc_id 1 with two texts, each near another document: no link is lost, by brute force over rows."""
    one, two = ([f"{c}{i}" for i in range(60)] for c in "ab")
    rows = [(1, one), (1, two), (2, [*one, "x"]), (3, [*two, "y"]), (4, ["z", *two]), (4, one), (4, one), (0, ["q"] * 9)]
    rows = [(i, " ".join(w)) for i, w in rows]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.tag) for r in minhash.near_duplicates(spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, tag long"), carry=("tag",)).collect())
    sets = [shingles(t, 5) for _, t in rows]
    label = components(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    low = {c: min(i for (i, _), d in zip(rows, label.values(), strict=True) if d == c) for c in label.values()}
    assert got == sorted((i, len(sets[n]), low[label[n]], n) for n, (i, _) in enumerate(rows))


def test_near_duplicates_of_one_large_group(spark):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(2300):  # more than two blocks around one centre
        w = list(base)
        w[i % 190] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("kept").count() == 1


def test_near_duplicates_null_ids_and_empty_table(spark):
    got = minhash.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, None)], "doc_id long, text string")).collect()
    assert [r.kept for r in got] == [True] * 3
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def _vectors(n=150, d=16):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, d))
    for i in range(0, n, 5):  # near copies, exact copies, scaled copies
        x[(i + 1) % n] = x[i] + 0.03 * rng.standard_normal(d)
        x[(i + 2) % n] = x[i]
    rows = [(i, [float(np.float32(v)) for v in r], 0) for i, r in enumerate(x)]
    odd = [None, [], [0.0] * d, [float("nan")] * d, [float("inf")] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), [1.0] * (d - 1)]
    return rows + [(1000 + i, v, None) for i, v in enumerate(odd)], d


def test_embeddings_against_all_pairs(spark):
    rows, d = _vectors()
    got = {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")).collect()}
    good = {i: np.array(v) for i, v, _ in rows if i < 1000}
    u = {i: v / np.linalg.norm(v) for i, v in good.items()}
    linked = [(a, b) for a in u for b in u if a < b and u[a] @ u[b] >= 0.95]
    want, links = components(list(u), linked), {i: 0 for i in u}
    for a, b in linked:
        links[a] += 1
        links[b] += 1
    assert len(got) == len(rows)
    for i, r in got.items():
        assert (r.n_links, r.component_id, r.kept) == ((links[i], want[i], want[i] == i) if i in u else (0, i, True))
    assert embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_of_repeated_ids_and_two_widths(spark):
    """One vec_id with several vectors: each row has its own links, by brute force over rows."""
    rng = np.random.default_rng(8)
    a, c, e = rng.standard_normal((3, 16))
    rows = [(1, a), (1, a + 0.01 * rng.standard_normal(16)), (2, a + 0.01 * rng.standard_normal(16)), (3, c), (3, -c), (4, c), (0, e), (0, e), (5, c[:8]), (6, c[:8] * 2), (7, None)]
    df = spark.createDataFrame([(i, None if v is None else v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicate_vectors(df).collect())
    u = [None if v is None else v / np.linalg.norm(v) for _, v in rows]
    linked = [(x, y) for x in range(len(u)) for y in range(x) if u[x] is not None and u[y] is not None and len(u[x]) == len(u[y]) and u[x] @ u[y] >= 0.95]
    label = components(range(len(u)), linked)
    low = {c: min(i for (i, _), d in zip(rows, label.values(), strict=True) if d == c) for c in label.values()}
    links = [sum(n in p for p in linked) for n in range(len(u))]
    assert got == sorted((i, links[n], low[label[n]]) for n, (i, _) in enumerate(rows))


def test_embeddings_in_blocks(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(16)
    rows = [(i, [float(v) for v in base + 0.02 * rng.standard_normal(16)]) for i in range(1800)]
    got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.agg(F.min("n_links"), F.max("n_links"), F.max("component_id")).first()[:] == (1799, 1799, 0)


def _product(v, w):
    total = 0.0
    for a, b in zip(v.tolist(), w.tolist(), strict=True):  # sum() would correct its roundings
        total += a * b
    return total


@pytest.mark.parametrize("shard_rows", [32, 10_000])
def test_nearest_is_exact_at_factor_one(spark, shard_rows):
    rows, _ = _vectors()
    df = spark.createDataFrame(rows + [rows[3]], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, k=20, shard_rows=shard_rows, block=4).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    x = [(i, np.array(v)) for i, v, _ in rows + [rows[3]] if i < 1000]
    assert set(got) == {i for i, _ in x if i % 20 == 0}
    for q, found in got.items():
        v = dict(x)[q]
        want = sorted((-_product(v, w), i) for i, w in x if i != q)[:20]
        assert [found[k + 1] for k in range(20)] == [(i, -s) for s, i in want]


@pytest.mark.parametrize("shard_rows", [64, 10_000])
def test_nearest_orders_ties_of_many_distinct_vectors(spark, shard_rows):
    """0/1 vectors with many distinct ones at one product, and a query whose vec_id repeats more than k times."""
    rng = np.random.default_rng(3)
    x = [(int(i), v.astype(float)) for i, v in zip(rng.permutation(600), rng.random((600, 24)) < 0.3, strict=True) if v.any()]
    copied = next(p for p in x if p[0] % 20 == 0)
    x += [copied] * 30
    df = spark.createDataFrame([(i, v.tolist()) for i, v in x], "vec_id long, embedding array<float>")
    got = {}
    for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, k=20, shard_rows=shard_rows, block=16).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {i for i, _ in x if i % 20 == 0}
    for q, found in got.items():
        v = dict(x)[q]
        want = sorted((-_product(v, w), i) for i, w in x if i != q)[:20]
        assert [found[k + 1] for k in range(20)] == [(i, -s) for s, i in want]


def test_nearest_of_repeated_query_ids_and_two_widths(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 4.0]), (40, [1.0, 1.0, 1.0]), (3, [2.0, 0.0, 0.0]), (4, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for parts in (1, 3):
        got = sorted(r[:] for r in vptree.nearest(df.repartition(parts), F.col("vec_id") % 20 == 0).collect())
        asks = min([1.0, 0.0], [0.0, 1.0], key=lambda v: np.array(v, "<f8").tobytes())
        want = sorted(((np.dot(asks, v), i) for i, v in ((1, [3.0, 1.0]), (2, [1.0, 4.0]))), reverse=True)
        assert got == [(20, k + 1, i, s) for k, (s, i) in enumerate(want)] + [(40, 1, 3, 2.0)]


def test_nearest_recall_below_one(spark):
    rows, _ = _vectors(400)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, l int")
    exact, relaxed = ({(r.query_id, r.vec_id) for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, factor=f, shard_rows=200).collect()} for f in (1.0, 0.8))
    assert len(exact & relaxed) >= 0.9 * len(exact)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, l int")
    assert vptree.nearest(few, F.col("vec_id") == 0).count() == 2
    assert vptree.nearest(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_lines_against_loop(spark):
    rows = [(i, f"own {i}\nshared\n\nshared" if i % 2 else f"own {i}", "a" if i < 20 else None, {"x": "y"}) for i in range(40)] + [(99, None, "a", None), (100, "", "a", None), (100, "", "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, total map<string,string>")
    got = linededup.drop_boilerplate_lines(df, F.col("source"), ratio=0.3).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r.doc_id
        if i == 99:
            assert (r.text, r._lines, r._dropped) == (None, 0, 0)
        elif i == 100:
            assert (r.text, r._lines, r._dropped) == ("", 1, 0)
        else:
            assert (r.text, r._dropped) == ((f"own {i}\n", 2) if i % 2 else (f"own {i}", 0))
    copies = spark.createDataFrame([(i, "same\npage", "c") for i in range(9)] + [(9, "same\nother", "c")], "doc_id long, text string, source string")
    assert {r._dropped for r in linededup.drop_boilerplate_lines(copies, F.col("source")).collect()} == {0}
    assert linededup.drop_boilerplate_lines(df.limit(0), F.col("source")).count() == 0
