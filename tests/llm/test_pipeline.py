import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import DOCS, WORD, awkward, components, shingles
from pyspark.sql import functions as F

import corpus_pipeline
from strandwise.llm import minhash, packing

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    """Each stage against a plain version of what it should do, on all that the stage before it kept."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append(docs.toPandas())
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    raw = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    labels = pq.read_table(f"{SF}/labels.parquet").to_pandas().set_index("doc_id").quality
    good, lines, near, mixed, packed = seen
    kept = labels.index.isin(good.doc_id)
    assert (kept == (labels == 1)).mean() > 0.97
    # lines
    g = good.set_index("doc_id")
    texts = set(zip(g.source, g.text, strict=True))
    pages, count = {}, {}
    for s, t in texts:
        pages[s] = pages.get(s, 0) + 1
        for x in set(t.split("\n")):
            count[s, x] = count.get((s, x), 0) + 1
    common = {k for k, n in count.items() if k[1].strip() and n >= 3 and n > 0.01 * pages[k[0]]}
    for r in lines.itertuples():
        assert r.text == "\n".join(x for x in g.text[r.doc_id].split("\n") if (r.source, x) not in common)
    # near duplicates
    sets = {r.doc_id: shingles(r.text, 5) for r in lines.itertuples()}
    by: dict = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in by.values() for a in ds for b in ds if a < b}
    want = components(list(sets), [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert set(near.doc_id) == {d for d, c in want.items() if c == d}
    # mixing
    size = near.assign(n=[len(WORD.findall(t)) for t in near.text]).set_index("doc_id")
    copies = mixed.doc_id.value_counts()
    assert copies.max() <= 3 and set(copies.index) <= set(near.doc_id)
    taken = (size.n * copies.reindex(size.index).fillna(0)).groupby(size.source).sum()
    total, weight, full = size.n.groupby(size.source).sum(), {x: (5, 2, 1)[i % 3] for i, x in enumerate(sorted(size.source.unique()))}, set()
    while True:
        level = (total.sum() - sum(3 * total[x] for x in full)) / sum(w for x, w in weight.items() if x not in full)
        over = {x for x, w in weight.items() if x not in full and level * w > 3 * total[x]}
        if not over:
            break
        full |= over
    for x, w in weight.items():
        target = 3 * total[x] if x in full else level * w
        assert abs(taken[x] - target) <= 0.01 * target, x
    # packing
    t = packing.Tokenizer(packing.default_tokenizer())
    want, got = {}, {}
    for d, x in zip(mixed.doc_id, mixed.text, strict=True):
        ids = np.append(t.ids(x), np.uint32(1)).astype("<u4")
        want.setdefault(d, (ids, []))[1].append(len(ids))
    for r in packed.itertuples():
        ids = want[r.doc_id][0]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        got.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
    assert all(sorted(got[d]) == sorted(list(range(len(ids))) * len(n)) for d, (ids, n) in want.items()) and set(got) == set(want)
    assert np.isin(packed.groupby("sequence_id").length.sum(), 2 ** np.arange(12)).all()
    assert raw.index.is_unique


def test_stages_keep_columns_of_clashing_names(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120").select("*", *(F.lit(c).alias(c) for c in ("_score", "_dropped", "_kept", "target", "_copies", "_copy", "_p")))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() > 0
        assert all(r[c] == c for r in docs.collect() for c in docs.columns[5:]) and len(docs.columns) == 12


def test_run_gives_the_last_stage(spark):
    a = corpus_pipeline.run(spark, SF)
    assert a.columns[0] == "doc_id" and a.agg(F.sum("length")).first()[0] > 0


def _odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns; labels for some."""
    rows = awkward()
    rows += [(None, "lone words without an id " * 3, None, None, None, None, None, None)] * 3 + [(7, "another text under a taken id " * 4, "en", "hot", 5, None, None, None)] * 2
    return spark.createDataFrame(rows, DOCS.replace(", _note map<string,string>", ", _note map<string,string>")).drop("_note"), [r[:7] for r in rows]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_odd_rows(spark, name, stage):
    docs, rows = _odd(spark)
    out = stage(spark, docs, "/root/testdata/sf0.001")
    got = out.collect()
    none = stage(spark, docs.limit(0), "/root/testdata/sf0.001")
    assert none.count() == 0 and none.columns == out.columns
    if name == "packing":
        t = packing.Tokenizer(packing.default_tokenizer())
        assert sum(r.length for r in got) == sum(len(t.ids(r[1] or "")) + 1 for r in rows)
        return
    assert out.columns == docs.columns
    if name == "quality":
        assert not [r for r in got if not WORD.findall(r.text or "")] and {tuple(r) for r in got} <= set(rows)
    elif name == "line dedup":
        assert sorted((str(r.doc_id), r.text is None) for r in got) == sorted((str(r[0]), r[1] is None) for r in rows)
    elif name == "mixing":
        assert {tuple(r) for r in got} <= set(rows) and max(got.count(r) for r in got) <= 3 * 3
    else:
        sets = [shingles(r[1], 5) for r in rows]
        near = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        groups: dict = {}
        for n, c in components(range(len(rows)), near).items():
            groups.setdefault(c, []).append((rows[n][0] is None, rows[n][0] or 0, rows[n]))
        # of a group the smallest doc_id, and one row of it
        assert len(got) == len(groups)
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(min((a, b) for a, b, _ in g) for g in groups.values())


def test_stages_leave_other_results_alone(spark, tmp_path):
    """Two pipelines interleaved, and a lazy result made between two stages."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stages, sf = dict(corpus_pipeline.STAGES), "/root/testdata/sf0.001"
    a, b = stages["line dedup"](spark, docs, sf), stages["near dedup"](spark, docs, sf)
    lazy = minhash.near_duplicates(docs)
    c = stages["mixing"](spark, docs, sf)
    a.write.parquet(str(tmp_path / "a"))
    corpus_pipeline.run(spark, sf).count()
    assert b.count() <= docs.count() == lazy.count() and c.count() > 0
