"""Typed DataFrames from the field's text formats. Line-oriented formats are parsed by built-in functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema
from ..functions.columns import is_assigned, number


def lines(spark: SparkSession, path: str | list[str], through: bool = False) -> DataFrame:
    """(file, ordinal, value): the lines of each file numbered from 0; with ``through`` numbers run on from file to file, by path.

    Files are split and read line by line. Within a block numbers come from the order of reading, and a small table of the
    blocks' line counts gives the lines before each.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"), "value")
    blocks = raw.groupBy("file", "_b").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over((Window.partitionBy(F.lit(0)).orderBy("file", "_b") if through else Window.partitionBy("file").orderBy("_b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "_b", "_first", before.alias("_before"))
    return raw.join(blocks, ["file", "_b"]).select("file", (F.col("_before") + F.col("_m") - F.col("_first")).alias("ordinal"), "value")


def biom_document(spark: SparkSession, path: str) -> DataFrame:
    """(feature, sample, value): the entries of a BIOM 1.0 document (sparse, JSON) that has a line for each row and each entry, as
    writers.biom_document makes it. It is read by lines, whose numbers are those of the rows; another layout is an error."""
    import json

    x = lines(spark, path, through=True)
    marks = x.where((F.col("ordinal") == 0) | F.col("value").startswith("]")).orderBy("ordinal").limit(4).collect()
    try:
        head = json.loads(marks[0]["value"] + "]}")
        n, samples = head["shape"][0], [c["id"] for c in head["columns"]]
        whole = [m["ordinal"] for m in marks[:2]] == [0, n + 1] and [m["value"] for m in marks[1:]] == ['], "data": [', "]}"]
    except (IndexError, KeyError, TypeError, ValueError):
        whole = False
    if not whole:
        raise ValueError("no BIOM document of a row and an entry a line")
    text = F.regexp_replace("value", "^,", "")
    rows = x.where(F.col("ordinal").between(1, n)).select((F.col("ordinal") - 1).alias("i"), F.from_json(text, "id string")["id"].alias("feature"))
    e = x.where((F.col("ordinal") > n + 1) & ~F.col("value").startswith("]")).select(F.from_json(text, "array<double>").alias("e"))
    e = e.select(F.col("e")[0].cast("long").alias("i"), F.get(F.array(*map(F.lit, samples)), F.col("e")[1].cast("int")).alias("sample"), F.col("e")[2].alias("value"))
    return e.join(rows, "i").select("feature", "sample", "value")


def catalog(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def metadata_table(spark: SparkSession, path: str | list[str], columns: list[str], optional: tuple[str, ...] = (), first: str = "accession", sep: str = "\t") -> DataFrame:
    """A headed table by column name; the first header cell counts as ``first``. Blank values are null, as are missing
    optional columns; a missing required one is an error, a short row is left out."""
    df = spark.read.option("sep", sep).option("header", True).option("mode", "DROPMALFORMED").option("quote", "").csv(path)
    df = df.withColumnRenamed(df.columns[0], first)
    missing = [c for c in columns if c not in df.columns and c not in optional]
    if missing:
        raise ValueError(f"columns {missing} are missing")
    return df.select(*(F.when(F.trim(f"`{c}`") != "", F.col(f"`{c}`")).alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def assembly_summary(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """Rows below a # header line found by name; ## lines, short rows, suppressed and replaced versions are left out."""
    x = lines(spark, path).where(~F.col("value").startswith("##"))
    head = x.where(F.col("value").startswith("#")).select("value").first()
    if head is None:
        raise ValueError("no header line")
    names = head[0].lstrip("#").strip().split("\t")
    if missing := [c for c in columns if c not in names]:
        raise ValueError(f"columns {missing} are missing")
    parts = F.split("value", "\t")
    rows = x.where(~F.col("value").startswith("#")).where(F.size(parts) > max(names.index(c) for c in columns))
    out = rows.select(*(parts[names.index(c)].alias(c) for c in columns))
    return out.where(~F.coalesce(F.lower("version_status").isin("suppressed", "replaced"), F.lit(False))) if "version_status" in columns else out


def checkm_report(spark: SparkSession, path: str) -> DataFrame:
    """(accession, completeness, contamination) under tolerant header names; either accession column, the last row wins."""
    x = lines(spark, path)
    head = x.orderBy("ordinal").select("value").first()[0]
    names = [h.lstrip("#").strip().lower().replace("-", "_").replace(" ", "_") for h in head.split("\t")]
    parts = F.split("value", "\t")

    def find(*tails: str) -> list[int]:
        return [i for i, n in enumerate(names) if any(n.endswith(t) for t in tails)]

    acc, comp, cont = find("accession"), find("completeness"), find("contamination")
    if not (acc and comp and cont):
        raise ValueError(f"no accession, completeness or contamination among {names}")
    rows = x.where("ordinal > 0").select("ordinal", F.explode(F.array(*(F.get(parts, F.lit(i)) for i in acc))).alias("accession"), F.get(parts, F.lit(comp[0])).alias("a"), F.get(parts, F.lit(cont[0])).alias("b"))
    best = rows.where(is_assigned("accession")).groupBy("accession").agg(F.max_by(F.struct("a", "b"), "ordinal").alias("r"))
    return best.select("accession", F.col("r.a").alias("checkm_completeness"), F.col("r.b").alias("checkm_contamination"))


def _dump(spark: SparkSession, path: str) -> Column:
    return spark.read.text(path).select(F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t").alias("p"))


def taxdump_nodes(spark: SparkSession, path: str) -> DataFrame:
    return _dump(spark, path).select(*(F.col("p")[i].alias(n) for i, n in enumerate(("taxid", "parent", "rank"))))


def taxdump_names(spark: SparkSession, path: str) -> DataFrame:
    return _dump(spark, path).where(F.col("p")[3] == "scientific name").select(F.col("p")[0].alias("taxid"), F.col("p")[1].alias("name"))


def extract_taxdump(archive: str, folder: str) -> list[str]:
    """names.dmp and nodes.dmp of a tar archive, on the driver."""
    import os
    import tarfile

    out = []
    with tarfile.open(archive) as t:
        for m in t.getmembers():
            if m.isfile() and os.path.basename(m.name) in ("names.dmp", "nodes.dmp"):
                target = os.path.join(folder, os.path.basename(m.name))
                with open(target, "wb") as f:
                    f.write(t.extractfile(m).read())
                out.append(target)
    return sorted(out)


def fasta(spark: SparkSession, path: str | list[str], whole_header: bool = False) -> DataFrame:
    """(id, description, seq, ordinal); the id is the header's first token, or all of it."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.monotonically_increasing_id().alias("ordinal"), F.regexp_replace("value", r"^>|\r", "").alias("v")).where(F.trim("v") != "")
    head = F.substring_index("v", "\n", 1)
    body = F.regexp_replace(F.when(F.contains(F.col("v"), F.lit("\n")), F.expr("substring(v, locate('\n', v) + 1)")).otherwise(""), r"\s+", "")
    return raw.select((head if whole_header else F.split(F.trim(head), r"\s+")[0]).alias("id"), head.alias("description"), body.alias("seq"), "ordinal")


def fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    x = lines(spark, path).withColumn("r", F.expr("ordinal div 4")).groupBy("file", "r").agg(F.map_from_entries(F.collect_list(F.struct(F.expr("ordinal % 4"), "value"))).alias("m"))
    return x.select(F.split(F.regexp_replace(F.col("m")[0], "^@", ""), r"\s+")[0].alias("read_id"), F.col("m")[1].alias("seq"), F.col("m")[3].alias("qual"), F.col("r").alias("ordinal"), "file")


def sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignment records with 0-based start and the NM tag; header lines are skipped."""
    p = F.split("value", "\t")
    x = spark.read.text(path).where(~F.col("value").startswith("@")).where(F.size(p) >= 11)
    tags = F.map_from_entries(F.transform(F.slice(p, 12, 1 << 20), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 6, 1 << 20))))
    return x.select(p[0].alias("query_name"), p[1].cast("int").alias("flag"), p[2].alias("reference_name"), (p[3].cast("long") - 1).alias("reference_start"), p[4].cast("int").alias("mapq"), p[5].alias("cigar"), p[9].alias("query_sequence"), tags.alias("tags")).withColumn("nm", F.col("tags")["NM"].try_cast("long"))


def bam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignment records of BAM files with the columns of ``sam``, block by block: each BGZF block is inflated in turn and records
    are decoded as they come, so a file is one task but never in memory. Tags of the types A, c, C, s, S, i, I, f, Z and H."""
    from .bgzf import alignments

    def run(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                yield from alignments(p)

    files = spark.read.format("binaryFile").load(path).select("path")
    n = max(1, files.count())
    return files.repartition(min(n, 4096)).mapInArrow(run, "query_name string, flag int, reference_name string, reference_start long, mapq int, cigar string, query_sequence string, tags map<string,string>").withColumn("nm", F.col("tags")["NM"].try_cast("long"))


#: Letters of the alphabets; degenerate and gap letters count as gaps.
ALPHABETS = {"DNA": "ACGT", "Protein": "ACDEFGHIKLMNPQRSTVWY", "3Di": "ACDEFGHIKLMNPQRSTVWY"}
_ALSO = {"DNA": "RYSWKMBDHVN-.", "Protein": "BZXJUO*-.", "3Di": "X-."}


def msa(spark: SparkSession, path: str | list[str], kind: str = "DNA") -> DataFrame:
    """Aligned sequences (id, seq, ordinal) in capitals; letters beyond the alphabet and rows of unequal length are errors."""
    x = fasta(spark, path).select("id", F.upper("seq").alias("seq"), "ordinal")
    allowed = "".join("\\" + c if c in "-.*" else c for c in ALPHABETS[kind] + _ALSO[kind])
    bad = F.regexp_extract("seq", f"[^{allowed}]", 0)
    width = x.agg(F.max(F.length("seq")).alias("_w"))
    seq = F.when(bad != "", F.raise_error(F.concat(F.lit(f"not a {kind} letter: "), bad))).when(F.length("seq") != F.col("_w"), F.raise_error(F.concat(F.lit("not as long as the others: "), F.col("id")))).otherwise(F.col("seq"))
    return x.join(F.broadcast(width)).select("id", seq.alias("seq"), "ordinal")


def bed(spark: SparkSession, path: str | list[str], value: str = "value") -> DataFrame:
    return spark.read.option("sep", "\t").schema(schema.BED.replace("value double", f"{value} double")).csv(path)


def depth_distribution(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("target string, depth long, detection double").csv(path)


def hits(spark: SparkSession, path: str | list[str], coverage_columns: bool = True) -> DataFrame:
    """Tabular search hits; a table without the three query coverages gets zeros for them."""
    names = [f for f in schema.HSP.split(", ") if coverage_columns or not f.startswith("qcov")]
    df = spark.read.option("sep", "\t").option("comment", "#").schema(", ".join(names)).csv(path)
    for c in ("qcovs", "qcovhsp", "qcovus"):
        if not coverage_columns:
            df = df.withColumn(c, F.lit(0.0))
    return df


def classifier_report(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """percent, clade_reads, reads, rank, taxid, name, with the line's ordinal and the depth of its indent. Lines come apart at
    tabs, or at white space where there are none."""
    v = lines(spark, path).where(F.trim("value") != "")
    p = F.when(F.contains(F.col("value"), F.lit("\t")), F.split("value", "\t", 6)).otherwise(F.split(F.trim("value"), r"\s+", 6))
    x = v.withColumn("p", p).where(F.size("p") == 6)
    name = F.col("p")[5]
    return x.select("file", "ordinal", F.trim(F.col("p")[0]).try_cast("double").alias("percent"), F.trim(F.col("p")[1]).try_cast("long").alias("clade_reads"), F.trim(F.col("p")[2]).try_cast("long").alias("reads"), F.trim(F.col("p")[3]).alias("rank"), F.trim(F.col("p")[4]).alias("taxid"), F.trim(name).alias("name"), (F.length(name) - F.length(F.ltrim(name))).alias("indent"))


def ko_details(spark: SparkSession, path: str) -> DataFrame:
    """gene, ko, threshold, score, evalue, function, ordinal of a detail table; * marks and comments are dropped."""
    p = F.split(F.regexp_replace("value", r"^[*\t ]+", ""), "\t")
    x = lines(spark, path).where(~F.col("value").startswith("#")).where(F.trim("value") != "").withColumn("p", p)

    def at(i: int) -> Column:
        v = F.trim(F.get("p", F.lit(i)))
        return F.when((v != "") & (v != "-"), v)

    return x.select(at(0).alias("gene"), at(1).alias("ko"), number(at(2)).alias("threshold"), number(at(3)).alias("score"), number(at(4)).alias("evalue"), F.regexp_replace(at(5), '^"|"$', "").alias("function"), "ordinal")


def term_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(gene, terms): the second column is a ;-list; comments and lines of one column are skipped."""
    p = F.split("value", "\t")
    x = spark.read.text(path).where(~F.col("value").startswith("#")).where(F.size(p) > 1)
    return x.select(p[0].alias("gene"), F.filter(F.split(F.regexp_replace(p[1], " ", ""), ";"), lambda t: t != "").alias("terms"))


def obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(terms, edges) of an ontology: stanzas are split by the reader, tags by regular expressions."""
    s = spark.read.option("lineSep", "\n[").text(path).where(F.col("value").startswith("Term]"))

    def tag(name: str) -> Column:
        return F.regexp_extract("value", rf"(?m)^{name}: *(.*?)(?: *!.*)?$", 1)

    terms = s.select(tag("id").alias("term"), F.regexp_extract("value", r"(?m)^name: *(.*)$", 1).alias("name"), tag("namespace").alias("namespace"), (tag("is_obsolete") == "true").alias("is_obsolete"))
    edges = s.select(tag("id").alias("child"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^is_a: *(\S+)"), 1)).alias("parent"))
    return terms, edges


GENBANK = "file string, locus string, accession string, definition string, seq string, features array<struct<type:string,location:string,qualifiers:map<string,string>>>"


def genbank(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of GenBank flat files with their features and qualifiers (repeats joined by ;). Files are split between
    records: a task holds a batch of them and never a file, and results leave Python every few MB."""

    def parse(rec: str, file: str) -> Iterator[tuple]:
        if "LOCUS" not in rec:
            return
        head, _, tail = rec.partition("\nORIGIN")
        seq = "".join(c for line in tail.splitlines()[1:] for c in line if c.isalpha()).upper()
        top, _, table = head.partition("\nFEATURES")
        fields, last = {}, None
        for line in top.strip().splitlines():
            if line[:12].strip():
                last = line[:12].strip()
                fields.setdefault(last, line[12:].strip())
            elif last:
                fields[last] += " " + line.strip()
        feats = []
        for line in table.splitlines()[1:]:
            if line[:5] == "     " and line[5:6].strip():
                feats.append([line[5:21].strip(), line[21:].strip(), []])
            elif feats and line[21:].startswith("/"):
                feats[-1][2].append(line[21:])
            elif feats and line.strip():
                if feats[-1][2]:
                    joint = "" if feats[-1][2][-1].startswith("/translation") else " "
                    feats[-1][2][-1] += joint + line.strip()
                else:
                    feats[-1][1] += line.strip()
        out = []
        for kind, loc, quals in feats:
            q: dict[str, str] = {}
            for raw in quals:
                k, _, v = raw[1:].partition("=")
                v = v.strip().strip('"').replace('""', '"')
                q[k] = f"{q[k]};{v}" if k in q else v
            out.append({"type": kind, "location": loc, "qualifiers": q})
        yield file, fields.get("LOCUS", "").split()[0] if fields.get("LOCUS") else None, (fields.get("VERSION") or fields.get("ACCESSION") or "").split(" ")[0], fields.get("DEFINITION"), seq, out

    def run(batches):
        import pandas as pd

        def frame(rows):
            return pd.DataFrame(rows, columns=["file", "locus", "accession", "definition", "seq", "features"])

        for pdf in batches:
            rows, size = [], 0
            for p, rec in zip(pdf["path"], pdf["value"], strict=True):
                rows += parse(rec, p)
                size += len(rec)
                if size > 1 << 22:
                    yield frame(rows)
                    rows, size = [], 0
            yield frame(rows)

    return spark.read.option("lineSep", "\n//").text(path).select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(run, GENBANK)


def coding_features(records: DataFrame) -> DataFrame:
    """CDS features with a translation and a plain location, without notes of damage."""
    x = records.select("locus", "seq", F.explode("features").alias("f")).where("f.type = 'CDS'")
    q = F.col("f.qualifiers")
    ok = q["translation"].isNotNull() & ~F.col("f.location").rlike("join|<|>") & q["transl_except"].isNull() & q["pseudo"].isNull() & ~F.coalesce(q["note"], F.lit("")).rlike("frameshifted|internal stop|incomplete")
    return x.where(ok).select("locus", "seq", "f.location", *(q[k].alias(k) for k in ("protein_id", "gene", "product", "locus_tag", "translation")))


def coding_sequences(records: DataFrame) -> DataFrame:
    """(header, start, end, strand, nucleotides, protein): header is locus, protein, gene and product joined by pipes."""
    from ..functions.columns import reverse_complement

    c = coding_features(records)
    start, end = F.regexp_extract("location", r"(\d+)\.\.", 1).cast("int"), F.regexp_extract("location", r"\.\.(\d+)", 1).cast("int")
    s = F.substring(F.col("seq"), start, end - start + 1)
    minus = F.col("location").startswith("complement")
    head = F.concat_ws("|", "locus", *(F.coalesce(k, F.lit(schema.MISSING)) for k in ("protein_id", "gene", "product")))
    return c.select(head.alias("header"), start.alias("start"), end.alias("end"), F.when(minus, "-").otherwise("+").alias("strand"), F.when(minus, reverse_complement(s)).otherwise(s).alias("nucleotides"), F.col("translation").alias("protein"))


def coding_table(records: DataFrame) -> DataFrame:
    """(locus, protein_id, gene, product, locus_tag, location, translation) of the coding features, NA where nothing is stated."""
    c = coding_features(records)
    return c.select("locus", *(F.coalesce(k, F.lit(schema.MISSING)).alias(k) for k in ("protein_id", "gene", "product", "locus_tag")), "location", "translation")


def whole_nucleotides(records: DataFrame) -> DataFrame:
    """(id, seq) of all records, by their version or else their locus."""
    return records.select(F.when(is_assigned("accession"), F.col("accession")).otherwise(F.col("locus")).alias("id"), "seq")


def paf(spark: SparkSession, path: str) -> DataFrame:
    """Pairwise alignments with their cs tag."""
    p = F.split("value", "\t")
    x = spark.read.text(path).where(~F.col("value").startswith("#")).where(F.size(p) >= 12)
    names = (("query", "string"), ("qlen", "long"), ("qstart", "long"), ("qend", "long"), ("strand", "string"), ("target", "string"), ("tlen", "long"), ("tstart", "long"), ("tend", "long"), ("matches", "long"), ("block", "long"), ("mapq", "long"))
    return x.select(*(p[i].cast(k).alias(n) for i, (n, k) in enumerate(names)), F.regexp_extract("value", r"\tcs:Z:([^\t]+)", 1).alias("cs"))


def values(spark: SparkSession, path: str, header_marks: bool = False) -> DataFrame:
    v = F.trim("value")
    return spark.read.text(path).select((F.regexp_replace(v, "^>", "") if header_marks else v).alias("value")).where("value <> ''").distinct()


def ordered_values(spark: SparkSession, path: str) -> DataFrame:
    """(value, ordinal) of first occurrences; blanks are dropped."""
    return lines(spark, path).select(F.trim("value").alias("value"), "ordinal").where("value <> ''").groupBy("value").agg(F.min("ordinal").alias("ordinal"))


def coverages(spark: SparkSession, given: str | float, names: DataFrame) -> DataFrame:
    """(name, value) for names(name): one number for all of them, or a table's own; a name that the table lacks is left out."""
    try:
        return names.select("name", F.lit(float(given)).alias("value"))
    except ValueError:
        table = spark.read.option("sep", "\t").schema("name string, value double").csv(given).where("value is not null")
        return names.select("name").join(table, "name")


def proportions(spark: SparkSession, path: str) -> DataFrame:
    """(name, value, share): shares add up to one."""
    x = spark.read.option("sep", "\t").schema("name string, value double").csv(path).where("value is not null")
    return x.join(F.broadcast(x.agg(F.sum("value").alias("_t")))).select("name", "value", F.try_divide("value", "_t").alias("share"))


def accession_table(spark: SparkSession, path: str) -> DataFrame:
    """accession and pins of a list, or of a headed table if its first line names an accession column."""
    x = lines(spark, path).where(F.trim("value") != "")
    head = x.orderBy("ordinal").first()
    if head is None or "accession" not in head["value"].lower():
        return x.select(F.trim("value").alias("accession"), *(F.lit(None).cast("double").alias(c) for c in ("pinned_rel_abundance", "pinned_coverage")))
    names = [h.strip().lower() for h in head["value"].split("\t")]
    p = F.split("value", "\t")
    pick = {c: names.index(c) for c in ("accession", "rel_abundance", "coverage") if c in names}
    pins = [number(F.get(p, F.lit(pick[c]))).alias(f"pinned_{c}") if c in pick else F.lit(None).cast("double").alias(f"pinned_{c}") for c in ("rel_abundance", "coverage")]
    return x.where(F.col("ordinal") > head["ordinal"]).select(F.trim(F.get(p, F.lit(pick["accession"]))).alias("accession"), *pins)


def read_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(sample, R1, R2) of the read files below a folder, and the samples that lack a mate."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.{fq,fastq}.gz").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    x = f.select("path", F.regexp_extract(name, r"^(.*?)[._-]R?([12])(?:_001)?\.(?:fq|fastq)\.gz$", 1).alias("sample"), F.regexp_extract(name, r"^(.*?)[._-]R?([12])(?:_001)?\.(?:fq|fastq)\.gz$", 2).alias("mate")).where("sample <> ''")
    wide = x.groupBy("sample").pivot("mate", ["1", "2"]).agg(F.min("path")).withColumnRenamed("1", "R1").withColumnRenamed("2", "R2")
    return wide.where("R1 is not null and R2 is not null"), wide.where("R1 is null or R2 is null").select("sample")


def sniff_delimiter(sample: str) -> str:
    """The candidate that parts most lines into the same number of fields, more than one."""
    rows = [r for r in sample.splitlines() if r.strip()][:50]

    def score(d: str) -> tuple[float, int]:
        n = [r.count(d) for r in rows]
        top = max(set(n), key=n.count) if n else 0
        return (n.count(top) / len(n) if top else 0.0, top)

    return max(("\t", ",", "|", ";", " "), key=score)


def column_names(df: DataFrame) -> DataFrame:
    """(number from 1, name)."""
    return df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(df.columns, 1)], "number int, name string")


def sample_of_path(suffix: str) -> Column:
    return F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), f"{suffix}$", "")


def samples(names: list[str], paths: list[str], suffix: str) -> list[str]:
    """One name a path: those given, which must be as many and all different, or else file names without the suffix."""
    import os

    if names and len(names) != len(paths):
        raise ValueError(f"{len(names)} sample names for {len(paths)} files")
    out = names or [os.path.basename(p).removesuffix(suffix) for p in paths]
    if len(set(out)) != len(out):
        raise ValueError("sample names must differ")
    return out


def file_of_accession(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(accession, path) of wanted(accession) and files(path): any version and either prefix matches; the file of the same
    prefix and version comes first, then by path. Wanted ones without a file have a null path."""
    from ..functions.columns import accession_core, accession_digits

    name = F.element_at(F.split("path", "/"), -1)
    key = F.regexp_extract(name, r"(GC[AF]_[0-9]+)", 1)
    f = files.select("path", accession_core(key).alias("_d"), name.alias("_name")).where("_d <> ''")
    w = wanted.select("accession", accession_digits("accession").alias("_w"))
    best = F.min_by("path", F.struct((~F.contains("_name", F.col("accession"))).alias("a"), "path"))
    return w.join(f, F.col("_w") == F.col("_d"), "left").groupBy("accession").agg(best.alias("path"))


def first_in_file(df: DataFrame, order: str = "ordinal") -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy(order))).where("_n = 1").drop("_n")


def benchmarks(spark: SparkSession, path: str | list[str], suffix: str = ".tsv") -> DataFrame:
    """The union of a workflow's time and memory tables, ``process`` being the file's name without its suffix."""
    return spark.read.csv(path, sep="\t", header=True).withColumn("process", sample_of_path(suffix.replace(".", r"\.")))
