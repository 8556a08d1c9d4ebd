"""Functions that no query reaches: drivers' checks, files by name, small helpers, and streams."""

import gzip
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from strandwise.functions import columns
from strandwise.operators import catalog, intervals, reports, stats
from strandwise.schema import NCBI, RANKS
from strandwise.sources import readers, writers
from strandwise.streaming import extensions


def test_names_and_labels(spark):
    df = spark.createDataFrame([(1, None, "x")], "a int, b string, c string")
    assert reports.by_column_name(df, ["c", "a"]).columns == ["c", "a"]
    with pytest.raises(ValueError, match="known"):
        reports.by_column_name(df, ["z"])
    assert reports.label_missing(df, {"b": "none"}).first().b == "none"
    assert intervals.assembly_names(["/x/a.fa", "/y/b.fa"]) == ["a", "b"]
    assert intervals.assembly_names(["/x/a.fa", "/y/a.fa"]) == ["/x/a", "/y/a"]
    intervals.require_overlap(df.select("c"), df.select("c"), "c")
    with pytest.raises(ValueError):
        intervals.require_overlap(df.select("c"), df.where("a > 1").select("c"), "c")


def test_taxa_of_one_name_at_two_ranks(spark):
    df = spark.createDataFrame([("Bacteria", "Same", "Same"), ("Bacteria", "same", "NA")], "domain string, phylum string, class string").withColumns({r: F.lit("NA") for r in RANKS[3:]})
    assert columns.normalize_taxon(" eukarya ") == "Eukaryota"
    assert catalog.resolve_taxon(df, "BACTERIA") == ("Bacteria", "domain")
    with pytest.raises(catalog.AmbiguousTaxon):
        catalog.resolve_taxon(df, "same")
    assert catalog.resolve_taxon(df, "same", "class") == ("Same", "class")
    with pytest.raises(catalog.TaxonNotFound):
        catalog.resolve_taxon(df, "other")
    with pytest.raises(ValueError):
        catalog.pool(df, NCBI, levels=["half"])
    with pytest.raises(ValueError):
        catalog.build_gtdb_catalog([df.limit(0)], [])


def test_report_order(spark):
    rows = [("B", "P", "9"), (None, None, "1"), ("Unclassified", None, "0"), ("A", None, "3"), ("B", None, "2")]
    df = spark.createDataFrame(rows, "domain string, phylum string, taxid string").withColumns({r: F.lit(None).cast("string") for r in RANKS[2:]})
    assert [r.taxid for r in reports.report_order(df).collect()] == ["0", "1", "3", "9", "2"]


def test_normalization_dispatch(spark):
    df = spark.createDataFrame([("f", "a", 1.0), ("g", "a", 3.0), ("f", "b", 0.0)], "feature string, sample string, value double")
    assert stats.normalize(df).collect() == df.collect()
    assert {(r.feature, r.sample): r.cpm for r in stats.normalize(df, "cpm").collect()} == {("f", "a"): 250000.0, ("g", "a"): 750000.0, ("f", "b"): 0.0}
    with pytest.raises(ValueError):
        stats.normalize(df, "other")


def test_inserting_and_wrapping(spark):
    r = spark.createDataFrame([("ACGTACGTAC", "tt", 4)], "s string, p string, i int").select(columns.insert_at("s", "p", F.col("i"), 2).alias("x"), columns.wrap_sequence("s", 4).alias("w")).first()
    assert (r.x, r.w) == ("ACGTttttACGTAC", "ACGT\nACGT\nAC")


def test_files_by_name(spark, tmp_path):
    for n in ("s1_R1.fastq.gz", "s1_R2.fastq.gz", "t-2.1.fq.gz", "t-2.2.fq.gz", "alone_R1.fq.gz", "other.txt"):
        (tmp_path / n).write_bytes(gzip.compress(b""))
    pairs, lone = readers.read_files(spark, str(tmp_path))
    assert sorted(r.sample for r in pairs.collect()) == ["s1", "t-2"] and [r.sample for r in lone.collect()] == ["alone"]
    assert readers.sniff_delimiter("a,b\nc,d\n") == "," and readers.sniff_delimiter("a\tb c\nd\te f\n") == "\t"
    (tmp_path / "x-report.txt").write_text("one\ntwo\n")
    x = readers.lines(spark, str(tmp_path / "x-report.txt"))
    assert [r.value for r in readers.first_in_file(x).collect()] == ["one"]
    y = spark.read.text(str(tmp_path / "x-report.txt")).select(readers.sample_of_path("-report.txt").alias("s"))
    assert {r.s for r in y.collect()} == {"x"}


def test_taxdump_archive(tmp_path):
    with tarfile.open(tmp_path / "d.tar.gz", "w:gz") as t:
        for n in ("names.dmp", "nodes.dmp", "other.dmp"):
            info = tarfile.TarInfo(f"./{n}")
            info.size = len(n)
            t.addfile(info, io.BytesIO(n.encode()))
    got = readers.extract_taxdump(str(tmp_path / "d.tar.gz"), str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in got] == ["names.dmp", "nodes.dmp"] and (tmp_path / "names.dmp").read_text() == "names.dmp"


def test_genbank_tables(spark, tmp_path):
    (tmp_path / "x.gb").write_text('LOCUS       L1  9 bp\nVERSION     L1.2\nFEATURES             Location/Qualifiers\n     CDS             1..9\n                     /gene="g"\n                     /translation="MA"\nORIGIN\n        1 atggcttaa\n//\n')
    rec = readers.genbank(spark, str(tmp_path / "x.gb"))
    assert readers.coding_table(rec).first().asDict() == {"locus": "L1", "protein_id": "NA", "gene": "g", "product": "NA", "locus_tag": "NA", "location": "1..9", "translation": "MA"}
    assert tuple(readers.whole_nucleotides(rec).first()) == ("L1.2", "ATGGCTTAA")


def test_sinks_by_name(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "genome string, mean_coverage double")
    writers.coverages(df, str(tmp_path / "cov"))
    assert [r.value for r in spark.read.text(str(tmp_path / "cov")).collect()] == ["a\t1.5"]
    writers.mutations(spark.createDataFrame([("q", "A1C\nD2del")], "id string, value string"), str(tmp_path / "mut"))
    assert [r.value for r in readers.lines(spark, str(tmp_path / "mut")).orderBy("ordinal").collect()] == ["## q", "A1C", "D2del"]
    writers.single_file(df, str(tmp_path / "one.tsv"))
    assert (tmp_path / "one.tsv").read_text() == "genome\tmean_coverage\na\t1.5\nb\tNA\n"
    assert writers.color("red") == "#ff0000"
    with pytest.raises(ValueError):
        writers.color("reddish")


def test_lines_of_split_files(spark, tmp_path):
    """Numbers run on through the pieces of a file, and each file has its own."""
    for n in ("a", "b"):
        (tmp_path / f"{n}.txt").write_text("".join(f"{n} line {i}\n" for i in range(3000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = readers.lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert len(got) == 6000 and all(r.value.endswith(f" line {r.ordinal}") for r in got)


def test_streams(spark, tmp_path):
    """The same windows and sessions from a stream, late rows dropped."""
    rows = [("2024-01-01 00:00:00", "a", 1.0), ("2024-01-01 00:10:00", "a", 2.0), ("2024-01-01 01:30:00", "a", 4.0), ("2024-01-01 00:05:00", "b", 8.0)]
    df = spark.createDataFrame(rows, "ts string, k string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, make in (("w", lambda x: extensions.sliding_counts(x, "ts", "k", "v")), ("s", lambda x: extensions.sessions(x, "ts", "k"))):
        q = make(stream).writeStream.format("memory").queryName(f"out_{name}").outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(f"out_{name}").collect())) == sorted(map(tuple, make(df).collect()))
