"""Queries over files: a driver table is written in one of the field's formats, and read back by its reader."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns
from ..schema import RANKS
from ..shared import shared_folder
from ..sources import readers, writers
from .catalog_queries import query, t

_made: list[tuple[SparkSession, str]] = []


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one, removed when the interpreter ends."""
    path = f"{shared_folder(spark)}/formats-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _remove() -> None:
    for spark, path in _made:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended
            pass


def _text(df: DataFrame, value, path: str, compression: str = "none", head: str | None = None, many: bool = False) -> str:
    """One text file of a line a row, below a header line if there is one; with ``many`` as many files as tasks, which suits
    tables that grow and readers that know a header or comment by its first letter."""
    x = df.select(value.cast("string").alias("value"))
    if head is not None:
        x = df.sparkSession.createDataFrame([(head,)], "value string").unionByName(x)
    (x if many else x.coalesce(1)).write.option("compression", compression).text(path)
    return path


def _tabbed(*cols):
    return F.concat_ws("\t", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))


def _sequences(spark, sf):
    """Texts without line breaks as sequences."""
    return t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.upper(F.regexp_replace("text", r"[^A-Za-z]+", "")).alias("seq")).where("seq <> ''")


_SEQ = "s AS (SELECT CAST(doc_id AS VARCHAR) AS id, upper(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS seq FROM documents WHERE upper(regexp_replace(text, '[^A-Za-z]+', '', 'g')) <> '')"


@query(f"WITH {_SEQ} SELECT id, md5(seq) AS print, length(seq) AS n FROM s")
def fasta_files(spark, sf):
    """Wrapped at 60 columns and gzipped where the records are made: lines read back from several files keep no order."""
    path = _folder(spark)
    writers.fasta(_sequences(spark, sf), path, width=60, compression="gzip")
    x = readers.fasta(spark, path)
    return x.select("id", F.md5("seq").alias("print"), F.length("seq").cast("long").alias("n"))


@query(f"WITH {_SEQ} SELECT 'r' || id AS read_id, seq, CAST(length(seq) AS BIGINT) AS quality FROM s")
def fastq_files(spark, sf):
    path = _folder(spark)
    writers.fastq(_sequences(spark, sf).select(F.concat(F.lit("r"), "id").alias("read_id"), "seq"), path)
    return readers.fastq(spark, path).select("read_id", "seq", F.length(F.regexp_replace("qual", "[^I]", "")).cast("long").alias("quality"))


@query(f"WITH {_SEQ} SELECT id AS locus, md5(seq) AS print FROM s")
def genbank_files(spark, sf):
    path = _folder(spark)
    writers.genbank(_sequences(spark, sf), path)
    return readers.genbank(spark, path).select("locus", F.md5("seq").alias("print"))


@query("SELECT 'c' || doc_id AS locus, 'c' || doc_id || '|p' || doc_id || '|NA|thing' AS header, CAST(4 AS INTEGER) AS start, CAST(12 AS INTEGER) AS \"end\", CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE WHEN doc_id % 2 = 0 THEN 'ATGGCTTAA' ELSE 'TTAAGCCAT' END AS nucleotides, 'MA' AS protein FROM documents")
def genbank_coding(spark, sf):
    """Records with a usable coding feature, one with a broken location and one that is a pseudogene."""
    path = _folder(spark)
    k = F.col("doc_id").cast("string")
    strand = F.when(F.col("doc_id") % 2 == 0, "4..12").otherwise("complement(4..12)")
    feature = "\n     CDS             {}\n                     /protein_id=\"{}\"\n                     /product=\"thing\"\n{}                     /translation=\"MA\""
    one = F.format_string(feature.replace("{}", "%s"), strand, F.concat(F.lit("p"), k), F.lit(""))
    broken = F.lit(feature.format("join(1..3,7..9)", "x", ""))
    pseudo = F.lit(feature.format("1..9", "y", "                     /pseudo\n"))
    rec = F.concat(F.lit("LOCUS       c"), k, F.lit("  15 bp\nACCESSION   c"), k, F.lit("\nFEATURES             Location/Qualifiers"), one, broken, pseudo, F.lit("\nORIGIN\n        1 gggatggctt aaggg\n//"))
    t(spark, sf, "documents").select(rec.alias("value")).write.text(path)
    c = readers.coding_sequences(readers.genbank(spark, path))
    return c.select(F.substring_index("header", "|", 1).alias("locus"), "header", "start", "end", "strand", "nucleotides", "protein")


@query("""SELECT 'q' || l_orderkey AS query_name, CAST(l_linenumber * 16 AS INTEGER) AS flag, 'c' || l_suppkey AS reference_name, l_partkey AS reference_start, CAST(l_quantity AS BIGINT) || 'M' AS cigar, CAST(l_linenumber AS BIGINT) AS nm, count(*) AS n FROM lineitem GROUP BY ALL""")
def sam_files(spark, sf):
    c = F.col
    x = t(spark, sf, "lineitem")
    line = _tabbed(F.concat(F.lit("q"), c("l_orderkey").cast("string")), c("l_linenumber") * 16, F.concat(F.lit("c"), c("l_suppkey").cast("string")), c("l_partkey") + 1, F.lit(60), F.concat(c("l_quantity").cast("long").cast("string"), F.lit("M")), F.lit("*"), F.lit(0), F.lit(0), F.lit("ACGT"), F.lit("IIII"), F.concat(F.lit("NM:i:"), c("l_linenumber").cast("string")), F.lit("AS:i:7"))
    path = _text(x, line, _folder(spark), head="@HD\tVN:1.6", many=True)
    r = readers.sam(spark, path)
    return r.groupBy("query_name", "flag", "reference_name", "reference_start", "cigar", "nm").agg(F.count("*").alias("n"))


@query("SELECT 'c' || l_suppkey AS contig, l_partkey AS start, l_partkey + CAST(l_quantity AS BIGINT) AS \"end\", count(*) AS n FROM lineitem GROUP BY ALL")
def bed_files(spark, sf):
    path = _folder(spark)
    writers.bed(t(spark, sf, "lineitem").select(F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("contig"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end")), path)
    return readers.bed(spark, path).groupBy("contig", "start", "end").agg(F.count("*").alias("n"))


@query("SELECT 's' || (l_suppkey % 9) AS target, CAST(l_linenumber AS BIGINT) AS depth, l_discount AS detection, count(*) AS n FROM lineitem GROUP BY ALL")
def distribution_files(spark, sf):
    x = t(spark, sf, "lineitem")
    path = _text(x, _tabbed(F.concat(F.lit("s"), (F.col("l_suppkey") % 9).cast("string")), F.col("l_linenumber"), F.col("l_discount")), _folder(spark), many=True)
    return readers.depth_distribution(spark, path).groupBy("target", "depth", "detection").agg(F.count("*").alias("n"))


@query("SELECT 'q' || l_orderkey AS qseqid, l_partkey AS slen, l_discount AS pident, 0.0::DOUBLE AS qcovs, l_extendedprice AS bitscore FROM lineitem")
def hit_tables(spark, sf):
    """A table without the query coverages, and comments in between."""
    c = F.col
    x = t(spark, sf, "lineitem")
    line = _tabbed(F.concat(F.lit("q"), c("l_orderkey").cast("string")), F.lit(100), F.lit("s"), c("l_partkey"), F.lit(1), F.lit(9), F.lit(1), F.lit(9), F.lit(9), c("l_discount"), F.lit(1e-9), c("l_extendedprice"))
    path = _text(x, line, _folder(spark), head="# a comment", many=True)
    return readers.hits(spark, path, coverage_columns=False).select("qseqid", "slen", "pident", "qcovs", "bitscore")


@query("SELECT conv_id AS clade_reads, turn AS reads, 'name ' || turn AS name, CAST(2 * (turn % 3) AS INTEGER) AS indent, count(*) AS n FROM conversations GROUP BY ALL")
def report_files(spark, sf):
    c = F.col
    x = t(spark, sf, "conversations")
    name = F.concat(F.repeat(F.lit("  "), (c("turn") % 3).cast("int")), F.lit("name "), c("turn").cast("string"))
    path = _text(x, _tabbed(F.lit(" 12.50"), c("conv_id"), c("turn"), F.lit("G"), F.lit(1), name), _folder(spark), many=True)
    r = readers.classifier_report(spark, path)
    return r.groupBy("clade_reads", "reads", "name", "indent").agg(F.count("*").alias("n"))


@query("SELECT 'g' || l_orderkey AS gene, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'K' || l_partkey END AS ko, CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE l_quantity END AS threshold, l_extendedprice AS score, 'a \"b\" c' AS function FROM lineitem")
def annotation_details(spark, sf):
    c = F.col
    x = t(spark, sf, "lineitem")
    line = F.concat(F.when(c("l_linenumber") % 2 == 0, "*\t").otherwise("\t"), _tabbed(F.concat(F.lit("g"), c("l_orderkey").cast("string")), F.when(c("l_partkey") % 3 > 0, F.concat(F.lit("K"), c("l_partkey").cast("string"))), F.when(c("l_suppkey") % 2 == 0, "-").otherwise(c("l_quantity").cast("string")), c("l_extendedprice"), F.lit("1e-5"), F.lit('"a "b" c"')))
    path = _text(x, line, _folder(spark), head="#\tgene\tKO\tthrshld\tscore\tE-value\tKO definition", many=True)
    return readers.ko_details(spark, path).select("gene", "ko", "threshold", "score", "function")


@query("SELECT 'T:' || n_nationkey AS term, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS namespace, n_nationkey % 5 = 0 AS is_obsolete, CASE WHEN n_nationkey > 0 THEN 'T:' || (n_nationkey // 2) END AS parent FROM nation")
def ontology_files(spark, sf):
    k = F.col("n_nationkey")
    n = t(spark, sf, "nation")
    parent = F.when(k > 0, F.concat(F.lit("\nis_a: T:"), F.expr("cast(n_nationkey div 2 as string)"), F.lit(" ! above"))).otherwise("")
    stanza = F.concat(F.lit("[Term]\nid: T:"), k.cast("string"), F.lit("\nname: "), "n_name", F.lit("\nnamespace: "), F.when(k % 2 == 0, "a").otherwise("b"), parent, F.when(k % 5 == 0, "\nis_obsolete: true").otherwise(""), F.lit("\n"))
    path = _text(n, stanza, _folder(spark), head="format-version: 1.2\n")
    terms, edges = readers.obo(spark, path)
    return terms.join(edges, terms.term == edges.child, "left").select("term", "name", "namespace", "is_obsolete", "parent")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS taxid, CAST(n_regionkey AS VARCHAR) AS parent, 'phylum' AS rank, n_name AS name FROM nation")
def taxdump_files(spark, sf):
    n = t(spark, sf, "nation")
    k = F.col("n_nationkey").cast("string")
    nodes = _text(n, F.concat(F.concat_ws("\t|\t", k, F.col("n_regionkey").cast("string"), F.lit("phylum"), F.lit("x")), F.lit("\t|")), _folder(spark))
    both = F.explode(F.array(F.concat_ws("\t|\t", k, F.col("n_name"), F.lit(""), F.lit("scientific name")), F.concat_ws("\t|\t", k, F.lit("other"), F.lit(""), F.lit("synonym"))))
    names = _text(n.select(both.alias("v")), F.concat("v", F.lit("\t|")), _folder(spark))
    return readers.taxdump_nodes(spark, nodes).join(readers.taxdump_names(spark, names), "taxid").select("taxid", "parent", "rank", "name")


@query("SELECT 'p' || p_partkey AS query, CAST(p_size AS BIGINT) AS qlen, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, ':' || p_size AS cs FROM part")
def alignment_lines(spark, sf):
    c = F.col
    p = t(spark, sf, "part")
    line = _tabbed(F.concat(F.lit("p"), c("p_partkey").cast("string")), c("p_size"), F.lit(0), F.lit(5), F.when(c("p_size") % 2 == 0, "+").otherwise("-"), F.lit("t"), F.lit(100), F.lit(0), F.lit(15), F.lit(15), F.lit(15), F.lit(0), F.lit("AS:i:9"), F.concat(F.lit("cs:Z::"), c("p_size").cast("string")))
    return readers.paf(spark, _text(p, line, _folder(spark), head="##PAF", many=True)).select("query", "qlen", "strand", "cs")


@query("SELECT DISTINCT p_name AS value FROM part")
def value_files(spark, sf):
    path = _text(t(spark, sf, "part"), F.concat(F.lit(">"), "p_name", F.lit(" ")), _folder(spark), many=True)
    return readers.values(spark, path, header_marks=True)


@query("SELECT p_brand AS value, min(p_partkey) AS ordinal FROM part GROUP BY 1")
def ordered_value_files(spark, sf):
    path = _text(t(spark, sf, "part").coalesce(1).orderBy("p_partkey"), F.col("p_brand"), _folder(spark))
    return readers.ordered_values(spark, path)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS name, round(s_acctbal / sum(s_acctbal) OVER (), 9) AS share FROM supplier")
def proportion_files(spark, sf):
    path = _text(t(spark, sf, "supplier"), _tabbed(F.col("s_suppkey"), F.col("s_acctbal")), _folder(spark))
    return readers.proportions(spark, path).select("name", F.round("share", 9).alias("share"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS name, 2.5::DOUBLE AS value FROM supplier UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_acctbal FROM supplier WHERE s_suppkey % 2 = 0")
def coverage_files(spark, sf):
    s = t(spark, sf, "supplier")
    names = s.select(F.col("s_suppkey").cast("string").alias("name"))
    path = _text(s.where("s_suppkey % 2 = 0"), _tabbed(F.col("s_suppkey"), F.col("s_acctbal")), _folder(spark))
    return readers.coverages(spark, 2.5, names).unionByName(readers.coverages(spark, path, names))


@query("SELECT 'GCA_' || s_suppkey AS accession, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS pinned_coverage FROM supplier")
def accession_files(spark, sf):
    c = F.col
    line = _tabbed(F.concat(F.lit("GCA_"), c("s_suppkey").cast("string")), F.when(c("s_suppkey") % 3 == 0, "NA").otherwise(c("s_acctbal").cast("string")))
    path = _text(t(spark, sf, "supplier"), line, _folder(spark), head="Accession\tcoverage")
    return readers.accession_table(spark, path).select("accession", "pinned_coverage")


@query("SELECT 'a' || s_suppkey AS accession, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_nationkey AS VARCHAR) END AS checkm, CAST(NULL AS VARCHAR) AS absent FROM supplier")
def metadata_files(spark, sf):
    c = F.col
    line = _tabbed(F.concat(F.lit("a"), c("s_suppkey").cast("string")), F.when(c("s_suppkey") % 4 > 0, c("s_nationkey")), F.lit("x"))
    path = _text(t(spark, sf, "supplier"), line, _folder(spark), "gzip", "genome\tcheckm\tother")
    return readers.metadata_table(spark, path, ["accession", "checkm", "absent"], ("absent",))


@query("SELECT 'a' || s_suppkey AS assembly_accession, CAST(s_nationkey AS VARCHAR) AS taxid, 'latest' AS version_status FROM supplier WHERE s_suppkey % 5 > 0")
def assembly_summary_files(spark, sf):
    c = F.col
    line = _tabbed(F.concat(F.lit("a"), c("s_suppkey").cast("string")), c("s_nationkey"), F.when(c("s_suppkey") % 5 == 0, "suppressed").otherwise("latest"))
    path = _text(t(spark, sf, "supplier"), line, _folder(spark), head="##  read me\n#assembly_accession\ttaxid\tversion_status")
    return readers.assembly_summary(spark, path, ["assembly_accession", "taxid", "version_status"])


@query("SELECT 'g' || s_suppkey AS accession, CAST(s_nationkey AS VARCHAR) AS checkm_completeness FROM supplier UNION ALL SELECT 'r' || s_suppkey, CAST(s_nationkey AS VARCHAR) FROM supplier WHERE s_suppkey % 2 = 0")
def checkm_files(spark, sf):
    c = F.col
    k = c("s_suppkey").cast("string")
    line = _tabbed(F.concat(F.lit("g"), k), F.when(c("s_suppkey") % 2 == 0, F.concat(F.lit("r"), k)).otherwise("na".upper()), c("s_nationkey"), F.lit(1))
    path = _text(t(spark, sf, "supplier"), line, _folder(spark), head="#GenBank-accession\tRefSeq-accession\tCheckM completeness\tcontamination")
    return readers.checkm_report(spark, path).select("accession", "checkm_completeness")


@query("SELECT 'g' || s_suppkey AS gene, CAST(2 AS BIGINT) AS n, 'T:' || s_nationkey AS first FROM supplier")
def term_annotation_files(spark, sf):
    c = F.col
    line = _tabbed(F.concat(F.lit("g"), c("s_suppkey").cast("string")), F.concat(F.lit("T:"), c("s_nationkey").cast("string"), F.lit("; T:99;")))
    path = _text(t(spark, sf, "supplier"), line, _folder(spark), head="#gene\tterms")
    return readers.term_annotations(spark, path).select("gene", F.size("terms").cast("long").alias("n"), F.col("terms")[0].alias("first"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'NA' ELSE o_orderpriority END AS priority, o_totalprice AS price FROM orders")
def tsv_files(spark, sf):
    path = _folder(spark)
    o = t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("priority"), F.col("o_totalprice").alias("price"))
    writers.tsv(o, path, compression="gzip")
    x = spark.read.option("sep", "\t").option("header", True).csv(path)
    return x.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "priority", F.col("price").cast("double").alias("price"))


@query("SELECT p_partkey, p_type AS domain, p_brand AS phylum FROM part WHERE p_brand = 'Brand#7'")
def catalog_files(spark, sf):
    """Written by lineage; the filter reaches the scan."""
    path = _folder(spark)
    p = t(spark, sf, "part").select(F.col("p_type").alias("domain"), F.col("p_brand").alias("phylum"), "p_partkey", F.col("p_partkey").cast("string").alias("accession"))
    writers.catalog(p, path, "accession")
    return readers.catalog(spark, path, ["p_partkey", "domain", "phylum"]).where("phylum = 'Brand#7'")


@query("SELECT CAST(i AS INTEGER) AS number, n AS name FROM (VALUES (1, 'p_partkey'), (2, 'p_name'), (3, 'p_brand'), (4, 'p_type'), (5, 'p_size'), (6, 'p_retailprice')) v(i, n)")
def column_names(spark, sf):
    return readers.column_names(t(spark, sf, "part"))


@query("SELECT p_name AS value, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1")
def value_lists(spark, sf):
    path = _folder(spark)
    writers.values(t(spark, sf, "part"), path, "p_name")
    return readers.lines(spark, path).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS lines, CAST(count(*) AS BIGINT) AS numbers, CAST(0 AS BIGINT) AS first, CAST(count(*) - 1 AS BIGINT) AS last FROM lineitem")
def split_files_numbered(spark, sf):
    """Files that are read in many pieces: line numbers run through them all."""
    path = _text(t(spark, sf, "lineitem"), _tabbed(F.col("l_orderkey"), F.col("l_comment") if "l_comment" in t(spark, sf, "lineitem").columns else F.col("l_shipdate")), _folder(spark), many=True)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        x = readers.lines(spark, path, through=True)
        x._jdf.queryExecution().executedPlan()  # splits are made with the plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    return x.agg(F.count("*").alias("lines"), F.count_distinct("ordinal").alias("numbers"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


@query("SELECT 'GCA_' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '.2' AS accession, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE '/x/' || CASE WHEN s_suppkey % 3 = 1 THEN 'GCF_' ELSE 'GCA_' END || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '.1_ASM.fna' END AS path FROM supplier")
def files_of_accessions(spark, sf):
    k = F.lpad(F.col("s_suppkey").cast("string"), 9, "0")
    s = t(spark, sf, "supplier")
    files = s.where("s_suppkey % 3 > 0").select(F.concat(F.lit("/x/"), F.when(F.col("s_suppkey") % 3 == 1, "GCF_").otherwise("GCA_"), k, F.lit(".1_ASM.fna")).alias("path"))
    return readers.file_of_accession(s.select(F.concat(F.lit("GCA_"), k, F.lit(".2")).alias("accession")), files)


@query("SELECT 'f' || p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 7 END AS a, p_size % 2 AS b FROM part WHERE (p_size % 3 > 0 AND p_size % 7 > 0) OR p_size % 2 > 0".replace("CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 7 END AS a, p_size % 2 AS b", "CAST(CASE WHEN p_size % 3 > 0 AND p_size % 7 > 0 THEN p_size % 7 END AS DOUBLE) AS a, CAST(CASE WHEN p_size % 2 > 0 THEN 1 END AS DOUBLE) AS b"))
def biom_documents(spark, sf):
    """Written as one document, read by its lines, back to the values that aren't 0."""
    p = t(spark, sf, "part")
    f = F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("feature")
    long = p.select(f, F.lit("a").alias("sample"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") % 7).otherwise(0).alias("value")).unionByName(p.select(f, F.lit("b").alias("sample"), (F.col("p_size") % 2).alias("value")))
    path = _folder(spark)
    writers.biom_document(long, path)
    e = readers.biom_document(spark, path).withColumnRenamed("feature", "id")
    return e.groupBy("id").pivot("sample", ["a", "b"]).agg(F.max("value"))


@query("SELECT CAST(sum(length(text)) AS BIGINT) AS n, count(*) AS k FROM (SELECT p_name || chr(9) || '1' AS text FROM part UNION ALL SELECT p_name || chr(9) || '#0000ff' || chr(9) || 'lab' FROM part UNION ALL SELECT p_name || chr(9) || 'branch' || chr(9) || '#ff0000' || chr(9) || 'normal' || chr(9) || '2.0' FROM part UNION ALL SELECT p_name || chr(9) || 'label' || chr(9) || '#ff0000' || chr(9) || 'bold' || chr(9) || '1' FROM part UNION ALL SELECT p_name || chr(9) || 'lab' || chr(9) || '-1' || chr(9) || '#000000' || chr(9) || 'bold' || chr(9) || '1' || chr(9) || '0' FROM part)")
def tree_annotations(spark, sf):
    """The data rows of all kinds of annotation, without their headers."""
    p = t(spark, sf, "part").select("p_name")
    every = None
    for kind, shade in (("binary", "green"), ("colorstrip", "blue"), ("style", "red"), ("text", "black")):
        x = writers.tree_rows(p, kind, shade, "lab")
        x = x.where(F.contains("value", F.lit("\t"))).where(~F.col("value").rlike("^(DATASET_LABEL|COLOR|FIELD_|SEPARATOR)"))
        every = x if every is None else every.unionByName(x)
    return every.agg(F.sum(F.length("value")).alias("n"), F.count("*").alias("k"))


@query("SELECT count(*) AS n, CAST(7 AS BIGINT) AS ranks FROM part")
def strict_lineages(spark, sf):
    line = F.concat(*(F.concat(F.lit(f"{c}__"), F.col("p_name"), F.lit("" if c == "s" else ";")) for c in "dpcofgs"))
    x = t(spark, sf, "part").select(*columns.lineage_strict(line))
    return x.agg(F.count("*").alias("n"), F.max(sum((F.when(columns.is_assigned(r), 1).otherwise(0) for r in RANKS), F.lit(0))).cast("long").alias("ranks"))
