import random

import pytest
from pyspark.sql import functions as F

from strandwise.functions import alignment, columns
from strandwise.operators import community, reports
from strandwise.sources import readers, writers

FLIP = str.maketrans("ACGT", "TGCA")


def _back(s):
    return s[::-1].translate(FLIP)


@pytest.fixture(scope="module")
def genome(spark):
    rng = random.Random(1)
    seqs = {"a": "".join(rng.choices("ACGT", k=900)), "b": "N" * 300 + "".join(rng.choices("ACGT", k=300)), "c": "ACGTA", "d": "", "e": None}
    return seqs, spark.createDataFrame([(k, v, 20) for k, v in seqs.items()], "contig string, seq string, units int")


@pytest.mark.parametrize("circular", [False, True])
def test_fragments_lie_where_they_say(genome, circular):
    seqs, df = genome
    rows = community.sample_fragments(df, 1, 80.0, 10.0, 40, 120, circular=circular).collect()
    assert {r.contig for r in rows} == {"a", "b", "c"} and len(rows) == 60
    for r in rows:
        s = seqs[r.contig]
        want = (s + s)[r.start : r.end] if circular else s[r.start : r.end]
        assert (want if r.strand == "+" else _back(want)) == r.seq and r.wrapped == (r.end > len(s))
        assert r.contig == "c" or 40 <= r.end - r.start <= 120
        assert "N" not in r.seq
    assert {r.strand for r in rows} == {"+", "-"} and len({r.start for r in rows if r.contig == "a"}) > 10
    again = community.sample_fragments(df.repartition(7), 1, 80.0, 10.0, 40, 120, circular=circular).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_mates(genome):
    seqs, df = genome
    rows = community.mates(community.sample_fragments(df, 2, 80.0, 10.0, 40), 30).collect()
    for r in rows:
        want = seqs[r.contig][r.start : r.end]
        assert r.seq == (want if r.strand == "+" else _back(want))
    pairs = {}
    for r in rows:
        pairs.setdefault(r.read_id[:-2], {})[r.mate] = r
    assert all(p[1].strand != p[2].strand for p in pairs.values())
    assert all((p[1].start <= p[2].start) == (p[1].strand == "+") or p[1].start == p[2].start for p in pairs.values())


def test_weights_are_lognormal(spark):
    df = spark.range(4000).select(F.col("id").alias("genome"))
    s = community.abundance_weights(df, "genome", 1, 0.5).select(F.avg(F.log("weight")), F.stddev_pop(F.log("weight"))).first()
    assert abs(s[0]) < 0.05 and abs(s[1] - 0.5) < 0.05
    assert community.abundance_weights(df, "genome", 1).where("weight <> 1").count() == 0


def test_community(spark):
    rng = random.Random(2)
    contigs = [(g, c, "".join(rng.choices("ACGT", k=n))) for g, c, n in [("g_1", "c1", 3000), ("g_1", "c_2", 1000), ("g2", "c1", 2000), ("g3", "c1", 0)]]
    genomes = spark.createDataFrame([("g_1", "B", None), ("g2", "A", 0.25), ("g3", "B", None)], "genome string, domain string, pin double")
    c = community.simulate(genomes, spark.createDataFrame(contigs, "genome string, contig string, seq string"), 1, 1001, 50, ranks=("domain",))
    reads = c.reads.collect()
    assert len({r.read_id for r in reads}) == len(reads) == 1002
    text = {(g, k): s for g, k, s in contigs}
    assert all(r.seq == (w if r.strand == "+" else _back(w)) for r in reads for w in [text[r.genome, r.contig][r.start : r.end]])
    truth = {r.genome: r for r in c.truth.collect()}
    assert truth["g3"].reads == 0 and sum(r.reads for r in truth.values()) == 1002
    assert truth["g3"].rel_abundance is None and truth["g_1"].rel_abundance + truth["g2"].rel_abundance == pytest.approx(1)
    assert {(r.genome, r.domain) for r in c.per_read.collect()} == {("g_1", "B"), ("g2", "A")}


def test_units(spark):
    g = spark.createDataFrame([("a", 0.5, 100, 1.0), ("b", 0.5, 300, 2.0)], "genome string, rel_abundance double, genome_size long, weight double")
    assert {r.genome: r.units for r in community.units_by_share(g, 100).collect()} == {"a": 25, "b": 75}
    r = community.units_by_coverage(g, 3.0, 10).where("genome = 'b'").first()
    assert (r.units, r.planned_coverage) == (180, 6.0)


def test_truth_keeps_genomes_without_reads(spark):
    g = spark.createDataFrame([("a", 10), ("b", 10)], "genome string, genome_size long")
    r = spark.createDataFrame([("a", 0, 5)], "genome string, start long, end long")
    m = spark.createDataFrame([("b", 2, 1)], "genome string, substitutions long, indels long")
    got = {x.genome: (x.reads, x.bases, x.mean_coverage, x.rel_abundance, x.substitutions, x.indels) for x in community.genome_truth(g, r, m).collect()}
    assert got == {"a": (1, 5, 0.5, 1.0, 0, 0), "b": (0, 0, 0.0, 0.0, 2, 1)}


@pytest.mark.parametrize("minus", [False, True])
def test_coding_columns(spark, minus):
    # AAA | ATG GCC | GT..AG | TGG GAA | TAA CC: the aligned part is GCC..TGG of the protein MAWE
    coding = "AAAATGGCCGTCCAGTGGGAATAACC"
    start, end = 6, 18
    seq = _back(coding) if minus else coding
    lo, hi = (len(seq) - end, len(seq) - start) if minus else (start, end)
    ops = alignment.cs_operations(spark.createDataFrame([("q", ":1~gt6ag:1")], "query string, cs string"))
    df = alignment.introns(ops).withColumns({"seq": F.lit(seq), "strand": F.lit("-" if minus else "+"), "lo": F.lit(lo), "hi": F.lit(hi), "aa": F.lit("AW"), "p0": F.lit(1), "p1": F.lit(3), "pn": F.lit(4)})
    r = df.select(*columns.coding_columns("seq", "strand", "lo", "hi", "aa", "p0", "p1", "pn", "introns")).first()
    assert (r.protein, r.coding_sequence) == ("MAWE", "ATGGCCTGGGAATAA")


def test_translation(spark):
    df = spark.createDataFrame([("ATGTTTTAGGANAC",), ("augc",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(columns.translate_codons("s")).collect()] == ["MF*X", "M", "", None]


def test_reports_of_targets(spark):
    t = spark.createDataFrame([("x", "nt"), ("x", "aa"), ("y", "nt"), ("y", "nt")], "target string, type string")
    assert sorted(r.target for r in reports.split_colliding(t).collect()) == ["x__aa", "x__nt", "y", "y"]
    i = spark.createDataFrame([("x", 95.0), ("x", 85.0), ("y", 80.0), ("z", 99.0)], "target string, pid double")
    d = spark.createDataFrame([("x", 1, 0.8), ("x", 2, 0.9), ("y", 1, 0.9), ("z", 1, 0.1), ("total", 1, 1.0)], "target string, depth int, detection double")
    assert [tuple(r) for r in reports.reads_screen(i, d).collect()] == [("x", 0.8, 2, 90.0)]
    s = spark.createDataFrame([("s1", "r2"), ("s1", "r1"), ("s1", "r1"), ("s10", "r3")], "sample string, run string")
    assert {r.sample: r.runs for r in reports.runs_of_samples(s).collect()} == {"s1": ["r1", "r2"], "s10": ["r3"]}


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACDE", "A-DF"), ("b", "", "")], "id string, gapped_ref string, gapped_query string")
    got = {r.id: r.text for r in writers.alignment_blocks(df, 3).collect()}
    assert got["a"] == "ref    ACD  3\n       | |\nquery  A-D  2\n\nref    E  4\n       .\nquery  F  3" and got["b"] == ""
    long = spark.createDataFrame([("f", "s2", 2), ("f", "s1", 1), ("g", "s1", 0)], "feature string, sample string, value long")
    assert [r.value for r in writers.biom_rows(long).collect()] == ['{"id":"f","data":{"s1":1,"s2":2}}']
    for n in "ab":
        (tmp_path / f"{n}.tsv").write_text("s\tmax_rss\n1.5\t20\n")
    assert sorted(r.process for r in readers.benchmarks(spark, str(tmp_path)).collect()) == ["a", "b"]
