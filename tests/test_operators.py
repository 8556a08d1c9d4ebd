import random

import pytest
from pyspark.sql import functions as F

from strandwise.functions import alignment, columns
from strandwise.operators import catalog, intervals, ontology, ordered, reports, sequences, stats
from strandwise.schema import NCBI, RANKS
from strandwise.sources import readers, writers


def test_union_length_against_sets(spark):
    rng = random.Random(3)
    rows = [(c, s, s + rng.randint(0, 9)) for c in "ab" for s in (rng.randint(0, 60) for _ in range(40))]
    got = {r["contig"]: r["covered"] for r in intervals.union_length(spark.createDataFrame(rows, "contig string, start long, end long"), ["contig"]).collect()}
    for c in "ab":
        assert got[c] == len({p for k, s, e in rows if k == c for p in range(s, e)})


def test_overlap_sums_against_loop(spark):
    rng = random.Random(4)
    regions = [("a", s, s + 15) for s in range(0, 90, 15)]
    spans = [("a", s, s + rng.randint(0, 30)) for s in (rng.randint(0, 80) for _ in range(30))]
    got = {r["start"]: r["shared"] for r in intervals.overlap_sums(spark.createDataFrame(regions, "contig string, start long, end long"), spark.createDataFrame(spans, "contig string, start long, end long"), 7).collect()}
    for _, s, e in regions:
        assert got[s] == sum(max(0, min(e, y) - max(s, x)) for _, x, y in spans)


def test_regions_overlap_at_the_threshold(spark):
    rows = [("c", "x", 1, 100, 90.0, 50.0), ("c", "y", 51, 150, 95.0, 60.0), ("c", "z", 151, 250, 99.0, 10.0)]
    df = spark.createDataFrame(rows, "contig string, target string, q_low long, q_high long, pident double, bitscore double")
    got = sorted((r.target, r.members, r.alternates) for r in intervals.resolve_regions(df).collect())
    assert got == [("y", 2, "x"), ("z", 1, None)]


def test_circular_contigs(spark):
    spans = spark.createDataFrame([("c", 90, 105), ("c", 3, 10), ("c", 40, 50)], "contig string, start long, end long")
    contigs = spark.createDataFrame([("c", 100)], "contig string, length long")
    assert sorted(r.name for r in intervals.covered_contigs(spans, contigs, circular=True).collect()) == ["c:40-50", "c:90-110"]
    assert intervals.detection(spans, contigs).first().covered == 30


def test_dereplication_size_matches_rows(spark):
    schema = ", ".join(f"{c} string" for c in (NCBI.accession, "refseq_category", "checkm_completeness", "checkm_contamination", "genome_size_ungapped", "genome_size", "contig_count", "assembly_level", *(f"`{r}`" for r in RANKS)))
    lin = lambda g, s: ("Bacteria", "P", "C", "O", "F", g, s)
    rows = [
        ("GCF_000000001.1", "na", "99", "1", "100", None, "1", "Complete Genome", *lin("G1", "S1")),
        ("GCF_000000002.1", "reference genome", "86", "9", "100", None, "1", "Contig", *lin("G1", "S2")),
        ("GCA_000000003.1", "na", None, "NA", None, "90", "x", "Scaffold", *lin("G2", "NA")),
        ("GCA_000000004.1", "na", "70", "", None, "90", "3", "Scaffold", *lin("G2", "")),
        ("GCA_000000005.1", "na", "70", "5", None, "90", "3", "Scaffold", *lin(None, None)),
    ]
    df = spark.createDataFrame(rows, schema)
    best = {r.genus: r.assembly_accession for r in catalog.dereplicate(df, NCBI, "genus").collect()}
    assert best == {"G1": "GCF_000000002.1", "G2": "GCA_000000004.1"}
    assert catalog.derep_size(df, "genus").first()[0] == 2
    assert catalog.resolve_taxon(df, "g1") == ("G1", "genus")
    with pytest.raises(catalog.TaxonNotFound):
        catalog.resolve_taxon(df, "nothing")
    assert catalog.pool(df, NCBI, prefix="refseq", levels=["contig"]).count() == 1
    with pytest.raises(ValueError):
        catalog.resolve_derep_rank("genus", "phylum")


def test_pushdown(spark, tmp_path):
    spark.createDataFrame([("GCF_1", "g")], "assembly_accession string, genus string").write.parquet(str(tmp_path / "x"))
    plan = catalog.pool(spark.read.parquet(str(tmp_path / "x")), NCBI, "genus", "g", prefix="refseq")._jdf.queryExecution().toString()
    assert "StringStartsWith(assembly_acc" in plan and "EqualTo(genus,g)" in plan


def test_accessions(spark):
    df = spark.createDataFrame([("RS_GCF_000123.2",), ("gb_gca_5.1",), ("XY_1",)], "a string")
    assert [r[0] for r in df.select(columns.accession_core("a")).collect()] == ["000123", "5", ""]


def test_cigar(spark):
    r = spark.createDataFrame([("3H5S10M2I4M1D6M", 4)], "c string, nm int").transform(lambda d: columns.with_cigar(d, "c")).first()
    assert (r.aligned_columns, r.query_aligned, r.gap_events, r.soft_clipped, r.hard_clipped, r.full_length) == (23, 22, 2, 5, 3, 30)
    assert r.pid_gap_aware == pytest.approx(100 * 19 / 23) and r.pid_gap_compressed == pytest.approx(100 * 19 / 22)


def test_forward_fill_report(spark):
    rows = [(0, "U", "unclassified", "0", 5), (1, "R", "root", "1", 0), (2, "D", "Bacteria", "2", 1), (3, "P", "P1", "3", 2), (4, "G", "G1", "4", 3), (5, "-", "strain", "5", 1), (6, "P", "P2", "6", 4)]
    df = spark.createDataFrame(rows, "ordinal long, rank string, name string, taxid string, reads long").withColumn("sample", F.lit("s"))
    got = {r.taxid: r for r in reports.classifier_summary(df, ["sample"]).collect()}
    assert got["0"].domain == "Unclassified" and "1" not in got
    assert (got["5"].phylum, got["5"].genus) == ("P1", "G1") and (got["6"].phylum, got["6"].genus) == ("P2", None)
    assert sum(r.percent for r in got.values()) == pytest.approx(100)


def test_apportionment_adds_up(spark):
    df = spark.createDataFrame([(i, float(i % 7 + 1)) for i in range(25)], "i int, w double")
    for even in (False, True):
        u = [r.units for r in stats.apportion(df, "w", ["i"], 1000, even=even).collect()]
        assert sum(u) == 1000 and (not even or all(x % 2 == 0 for x in u))


def test_closure_survives_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    got = {(r.node, r.ancestor): r.depth for r in ontology.closure(e).collect()}
    assert got == {(a, b): (ord(b) - ord(a)) % 3 for a in "abc" for b in "abc"}


def test_closure_of_a_long_chain(spark):
    e = spark.range(100).select(F.col("id").cast("string").alias("child"), (F.col("id") + 1).cast("string").alias("parent"))
    got = {int(r.ancestor): r.depth for r in ontology.closure(e).where("node = '0'").collect()}
    assert got == {i: i for i in range(101)}
    assert {int(r[0]) for r in ontology.descendants(e, "20").collect()} == set(range(20))


def test_alignment():
    a, b, s = alignment.global_alignment("ACDEFG", "ACFG", alignment.similarity())
    assert (a, b, s) == ("ACDEFG", "AC--FG", 20 - 12)
    assert [o["op"] for o in alignment.parse_cs(":5*gcaK+AB-acg-a~gt12ag")] == ["match", "sub", "del", "ins", "fs", "intron"]
    with pytest.raises(ValueError):
        alignment.parse_cs("?")


def _plain_cs(ops, ref, at):
    """Protein, frameshifts and introns of parsed operations, letter by letter."""
    protein, shifts, gaps, base = "", [], [], 0
    for o in ops:
        op, n = o["op"], o["n"]
        if op == "match":
            protein, at, base = protein + ref[at : at + n], at + n, base + 3 * n
        elif op in ("sub", "tail"):
            protein, at, base = protein + alignment.translate(o["alt"]), at + 1, base + (3 if op == "sub" else n)
        elif op == "del":
            at += n
        elif op == "ins":
            protein, base = protein + alignment.translate(o["alt"]), base + n
        elif op == "fs":
            shifts.append((at + 1, n))
            protein, at, base = (protein + o["ref"], at + 1, base + 3 + n) if n < 0 else (protein, at, base + n)
        else:
            if op == "intron":
                gaps.append((base, n))
            base += n
    return protein, shifts, gaps


@pytest.mark.parametrize(
    "cs, at, protein, shifts, gaps",
    [
        (":5", 0, "MKLVW", [], []),
        (":2*gcaL:2", 0, "MKAVW", [], []),
        (":1+KL:2", 0, "MVW", [], []),
        (":3-gcaaaa:2", 0, "MKLAKVW", [], []),
        (":3-g:2", 0, "MKLVW", [(4, 1)], []),
        (":3-gcacc:2", 0, "MKLAVW", [(4, 2)], []),
        (":3*atV:1", 0, "MKLVW", [(4, -1)], []),
        (":3*aV:1", 0, "MKLVW", [(4, -2)], []),
        (":2~gt70ag:3", 0, "MKLVW", [], [(6, 70)]),
        (":3*gcV~gt70ag-a:1", 0, "MKLAW", [], [(11, 70)]),
        (":3*gV~gt70ag-ca:1", 0, "MKLAW", [], [(10, 70)]),
        (":2", 3, "VW", [], []),
    ],
)
def test_cs_strings(spark, cs, at, protein, shifts, gaps):
    ref = "MKLVW"
    assert _plain_cs(alignment.parse_cs(cs), ref, at) == (protein, shifts, gaps)
    df = spark.createDataFrame([("q", cs, ref, at)], "query string, cs string, seq string, qstart int")
    ops = alignment.cs_operations(df)
    r = alignment.translated(ops, df).join(alignment.introns(ops), "query").first()
    assert (r.protein, r.frameshifts, [tuple(i) for i in r.introns]) == (protein, ";".join(f"fs{p}{n:+d}" for p, n in shifts), gaps)


@pytest.mark.parametrize("cs", [":3ZZ:2", ":", ":3*gc", "*acgtK", "+ab", "~gt5", ":3XY"])
def test_cs_strings_that_are_wrong(cs):
    with pytest.raises(ValueError):
        alignment.parse_cs(cs)


def test_substitution_matrix():
    m = alignment.blosum62()
    assert all(m[a, b] == m[b, a] for a, b in m) and len(m) == 24 * 24
    assert (m["W", "W"], m["A", "R"], m["C", "E"], m["I", "V"], m["*", "*"], m["A", "*"]) == (11, -1, -4, 3, 1, -4)
    again = alignment.read_matrix("# c\n  A R\nA 4 -1\nR -1 5\n")
    assert again == {k: m[k] for k in again}
    # a gap in the middle is worth it only for what the matrix says
    assert alignment.global_alignment("MKWVTFISLL", "MKWVISLL", alignment.similarity(m))[:2] == ("MKWVTFISLL", "MKWV--ISLL")


def test_alignment_against_recursion():
    """The best score by trying every last column; the alignment returned has it and spells both sequences."""
    from functools import cache

    rng = random.Random(8)
    for _ in range(60):
        a, b = ("".join(rng.choices("ACD", k=rng.randint(0, 7))) for _ in range(2))
        opened, extended = rng.choice([(-11.0, -1.0), (-3.0, -1.0), (-2.0, -0.5)])
        score = alignment.similarity()

        @cache
        def best(i, j, state):
            if i == j == 0:
                return 0.0 if state == 0 else float("-inf")
            if state == 0:
                return max(best(i - 1, j - 1, k) for k in range(3)) + score(a[i - 1], b[j - 1]) if i and j else float("-inf")
            p, q = (i - 1, j) if state == 1 else (i, j - 1)
            return max(best(p, q, k) + (extended if k == state else opened) for k in range(3)) if min(p, q) >= 0 else float("-inf")

        x, y, got = alignment.global_alignment(a, b, score, opened, extended)
        assert got == pytest.approx(max(best(len(a), len(b), k) for k in range(3)))
        assert (x.replace("-", ""), y.replace("-", "")) == (a, b) and len(x) == len(y) and ("-", "-") not in zip(x, y, strict=True)
        paid, last = 0.0, None
        for p, q in zip(x, y, strict=True):
            kind = "a" if p == "-" else "b" if q == "-" else None
            paid += score(p, q) if kind is None else extended if kind == last else opened
            last = kind
        assert paid == pytest.approx(got)


def test_primers(spark):
    df = spark.createDataFrame([("a", "TTTACGTACTTTTTTGGCCATTT")], "id string, seq string")
    hits = sequences.primer_hits(df, "ACGTAC", "TGGCC", 0)
    got = {(r.start, r.end, r.type) for r in hits.collect()}
    assert (3, 9, "forward") in got and (14, 19, "reverse") in got
    assert sequences.amplicons(hits).count() >= 1


def test_simulation_ignores_partitions(spark):
    df = spark.createDataFrame([(f"c{i}", "ACGT" * 50, 4) for i in range(6)], "contig string, seq string, units int")
    one = sorted(map(tuple, sequences.sample_reads(df.coalesce(1), 30, 1).collect()))
    assert one == sorted(map(tuple, sequences.sample_reads(df.repartition(5), 30, 1).collect()))
    m = df.select(F.col("contig").alias("id"), "seq")
    assert sorted(map(tuple, sequences.mutate(m.coalesce(1), 0.1, 1).collect())) == sorted(map(tuple, sequences.mutate(m.repartition(5), 0.1, 1).collect()))


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first\nACGT\nAC\n>s2\nGG\n")
    got = sorted((r.id, r.seq) for r in readers.fasta(spark, str(tmp_path / "a.fa")).collect())
    assert got == [("s1", "ACGTAC"), ("s2", "GG")]
    (tmp_path / "a.fq").write_text("@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+\nII\n")
    assert sorted((r.read_id, r.seq, r.qual) for r in readers.fastq(spark, str(tmp_path / "a.fq")).collect()) == [("r1", "ACGT", "IIII"), ("r2", "GG", "II")]
    (tmp_path / "a.sam").write_text("@HD\tVN:1\nr1\t0\tc\t11\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:1\n")
    r = readers.sam(spark, str(tmp_path / "a.sam")).first()
    assert (r.reference_start, r.nm, r.cigar) == (10, 1, "4M")
    (tmp_path / "k.txt").write_text("# x\n*\tg1\tK1\t10\t20\t1e-5\t\"f one\"\n\tg1\tK2\t\t5\t1e-9\t\"f two\"\n\tg2\tK3\t50\t20\t1e-3\t\"f\"\n\tg3\n")
    got = {r.gene: r.ko for r in reports.best_annotations(readers.ko_details(spark, str(tmp_path / "k.txt"))).collect()}
    assert got == {"g1": "K2", "g2": None, "g3": None}
    (tmp_path / "n.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tsuperkingdom\t|\n3\t|\t2\t|\tphylum\t|\n")
    (tmp_path / "m.dmp").write_text("2\t|\tBacteria\t|\t\t|\tscientific name\t|\n2\t|\teubacteria\t|\t\t|\tsynonym\t|\n3\t|\tP\t|\t\t|\tscientific name\t|\n")
    lin = {r.taxid: (r.domain, r.phylum) for r in ontology.lineages(readers.taxdump_nodes(spark, str(tmp_path / "n.dmp")), readers.taxdump_names(spark, str(tmp_path / "m.dmp"))).collect()}
    assert lin["3"] == ("Bacteria", "P") and lin["2"] == ("Bacteria", None)
    (tmp_path / "o.obo").write_text("format-version: 1.2\n\n[Term]\nid: T:1\nname: root\nnamespace: bp\n\n[Term]\nid: T:2\nname: leaf\nnamespace: bp\nis_a: T:1 ! root\n")
    terms, edges = readers.obo(spark, str(tmp_path / "o.obo"))
    assert terms.count() == 2 and edges.collect()[0][:] == ("T:2", "T:1")


def test_genbank(spark, tmp_path):
    (tmp_path / "x.gb").write_text('LOCUS       L1   12 bp DNA\nDEFINITION  d.\nVERSION     L1.1\nFEATURES             Location/Qualifiers\n     CDS             complement(1..6)\n                     /gene="g"\n                     /product="long\n                     name"\n                     /translation="MK"\nORIGIN\n        1 acgtac gtacgt\n//\n')
    r = readers.coding_sequences(readers.genbank(spark, str(tmp_path / "x.gb"))).first()
    assert (r.header, r.nucleotides, r.protein, r.strand) == ("L1|NA|g|long name", "GTACGT", "MK", "-")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", 2.675)], "id string, v double")
    writers.single_file(df.orderBy("id"), str(tmp_path / "t.tsv"))
    assert (tmp_path / "t.tsv").read_text().splitlines()[:2] == ["id\tv", "a\tNA"]
    assert df.select(writers.half_even(F.col("v"), 2)).collect()[1][0] == 2.67
    assert writers.tree_rows(df.select("id"), "binary", "blue").count() == 10


def test_running_sums_and_percentiles(spark):
    rng = random.Random(3)
    v = [rng.choice([None, *range(40)]) for _ in range(500)] + [7] * 300
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(v)], "i int, v int, one int")
    for ranges in (1, 7, 64):
        got = {r.i: r.s for r in ordered.running_sum(df, "v", "one", "s", ["i"], ranges).collect()}
        order = sorted(range(len(v)), key=lambda i: (v[i] is not None, v[i] or 0, i))
        assert got == {i: n + 1 for n, i in enumerate(order)}
    import numpy as np

    ps = (0.0, 0.001, 0.3, 0.5, 0.95, 1.0)
    got = ordered.exact_percentiles(df, "v", ps, [f"p{i}" for i in range(6)]).first()
    assert list(got) == pytest.approx(np.quantile([x for x in v if x is not None], ps).tolist())


def test_primers_against_a_full_table(spark):
    rng = random.Random(5)

    def cost(p, s):
        row = list(range(len(s) + 1))
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(s, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    for _ in range(40):
        text, p, k = "".join(rng.choices("ACGT", k=60)), "".join(rng.choices("ACGT", k=8)), rng.randint(0, 3)
        ends = [min(cost(p, text[a:e]) for a in range(max(0, e - len(p) - k), e + 1)) for e in range(1, 61)]
        best = min(ends)
        want = [e for e, c in enumerate(ends, 1) if c == best and best <= k]
        assert sequences._bits(p, text, k) == want
        for a, e in sequences._starts(p, text, want, k):
            assert cost(p, text[a:e]) == best and all(cost(p, text[b:e]) > best for b in range(a + 1, e))


def test_regions_swept_in_pieces(spark):
    """The sweep over whole contigs, in plain Python."""
    rng = random.Random(6)
    rows = [(f"c{rng.randint(0, 2)}", f"t{i % 9}", (a := rng.randint(1, 400)), a + rng.randint(0, 40), float(rng.randint(70, 100)), float(rng.randint(1, 500))) for i in range(150)]
    got = sorted(tuple(r) for r in intervals.resolve_regions(spark.createDataFrame(rows, "contig string, target string, q_low long, q_high long, pident double, bitscore double")).collect())
    want = []
    for contig in sorted({r[0] for r in rows}):
        clusters = []
        for r in sorted((r for r in rows if r[0] == contig), key=lambda r: (r[2], r[3], r[1])):
            inside = clusters and any(min(r[3], m[3]) - max(r[2], m[2]) + 1 >= 0.5 * min(r[3] - r[2] + 1, m[3] - m[2] + 1) for m in clusters[-1])
            clusters[-1].append(r) if inside else clusters.append([r])
        for c in clusters:
            best = sorted(c, key=lambda r: (-r[5], -r[4] * (r[3] - r[2] + 1), r[1]))
            want.append((contig, min(r[2] for r in c), max(r[3] for r in c), best[0][1], best[0][4], best[0][5], len(c), ";".join(r[1] for r in best[1:]) or None))
    assert [g[:3] + g[5:7] for g in got] == [w[:3] + w[5:7] for w in sorted(want)]


def _bam(path):
    """A two-record file in two compressed blocks."""
    import gzip
    import struct

    def rec(name, flag, ref, pos, cigar, seq, tags):
        ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar)
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + ops + packed + b"\xff" * len(seq) + tags
        return struct.pack("<i", len(body)) + body

    text = b"@HD\tVN:1.6\n"
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 1000)
    data = head + rec("r1", 0x41, 0, 9, [(5, "S"), (20, "M"), (2, "D")], "ACGTN", b"NMC\x03" + b"RGZx\0" + b"XAB" + b"s" + struct.pack("<Ihh", 2, 1, 2)) + rec("r2", 4, -1, -1, [], "AC", b"")
    with open(path, "wb") as f:
        f.write(gzip.compress(data[:70]) + gzip.compress(data[70:]) + gzip.compress(b""))


def test_bam(spark, tmp_path):
    _bam(tmp_path / "x.bam")
    got = readers.bam(spark, f"file://{tmp_path}/x.bam").orderBy("query_name").collect()
    assert [(r.query_name, r.flag, r.reference_name, r.reference_start, r.cigar, r.query_sequence, r.nm) for r in got] == [("r1", 0x41, "c1", 9, "5S20M2D", "ACGTN", 3), ("r2", 4, "*", -1, "*", "AC", None)]
    assert got[0].tags == {"NM": "3", "RG": "x"}


def test_msa_reader(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a\nac-t\n>b\nNCGT\n")
    assert [r.seq for r in readers.msa(spark, str(tmp_path / "a.fa"), "DNA").orderBy("ordinal").collect()] == ["AC-T", "NCGT"]
    for bad in (">a\nACZT\n", ">a\nACG\n>b\nAC\n"):
        (tmp_path / "b.fa").write_text(bad)
        with pytest.raises(Exception, match="not a"):
            readers.msa(spark, str(tmp_path / "b.fa"), "DNA").collect()


def test_names_of_samples_and_insertions(spark):
    assert readers.samples([], ["/a/x-1.tsv", "y.tsv"], ".tsv") == ["x-1", "y"]
    for names, paths in ((["a"], ["x", "y"]), (["a", "a"], ["x", "y"])):
        with pytest.raises(ValueError):
            readers.samples(names, paths, "")
    assert sequences.parse_place("c:1:9") == ("c:1", 9)
    with pytest.raises(ValueError):
        sequences.parse_place("c:-1")
    df = spark.createDataFrame([("c", 100)], "contig string, length long")
    assert len({r.position for r in sequences.insertion_places(df, 4, 1, back_to_back=True).collect()}) == 1
    with pytest.raises(ValueError):
        sequences.insertion_places(df, 1, 1, "c:101")
    assert sequences.one_insertion(spark.createDataFrame([("A",)], "seq string")) == "A"
    with pytest.raises(ValueError):
        sequences.one_insertion(spark.createDataFrame([("A",), ("C",)], "seq string"))
    assert 0 <= sequences.clock_seed() <= 235959


def test_natural_key_of_long_numbers(spark):
    names = ["c" + "9" * 25, "c1" + "0" * 25, "c2", "c10", "c02x"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(columns.natural_key("n"), "n").collect()]
    assert got == ["c2", "c02x", "c10", "c" + "9" * 25, "c1" + "0" * 25]


def test_half_even(spark):
    v = [2.675, 0.125, 15.625, -0.125, 1e9 + 0.005, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "v double").select(writers.half_even(F.col("v"), 2)).collect()]
    assert got == [None if x is None else round(x, 2) for x in v]


def test_row_groups(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    df = spark.range(600_000).select(F.lit("b").alias("domain"), F.col("id").cast("string").alias("accession"))
    writers.catalog(df, str(tmp_path / "c"), "accession", 1)
    m = pq.ParquetFile(glob.glob(str(tmp_path / "c" / "*.parquet"))[0]).metadata
    assert max(m.row_group(i).num_rows for i in range(m.num_row_groups)) <= 256_000 and m.row_group(0).column(0).compression == "ZSTD"
