"""Sinks: nulls become their sentinel and numbers are rounded here and nowhere before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import wrap_sequence
from ..schema import MISSING, RANKS


def rendered(df: DataFrame, missing: str = MISSING) -> DataFrame:
    return df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(missing)).alias(c) for c in df.columns))


def half_even(column: Column, digits: int) -> Column:
    """Rounding as Python does it, half to even on the exact binary value. A cast to decimal would round the shortest text of the
    number (2.675 to 2.68, where its value is below the half), so values go to Python in Arrow batches, at sinks only."""

    @F.pandas_udf("double")
    def r(x):
        return x.map(lambda v: None if v != v else round(v, digits))

    return r(column.cast("double"))


def catalog(df: DataFrame, path: str, accession: str, files: int | None = None) -> None:
    """Parquet ranged and sorted by lineage, zstd at level 9, in row groups of at most 256,000 rows, so that groups can be skipped
    by any rank."""
    keys = [c for c in RANKS if c in df.columns] + [accession]
    x = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    x.sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").option("parquet.block.row.count.limit", "256000").parquet(path)


def tsv(df: DataFrame, path: str, missing: str = MISSING, compression: str = "none") -> None:
    """Unquoted; values that hold a tab, a quote or a line break are quoted."""
    rendered(df, missing).write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", compression).option("emptyValue", "").csv(path)


def single_file(df: DataFrame, path: str, missing: str = MISSING) -> None:
    """One named file for small results: written beside its place by one task and renamed in one step."""
    spark, part = df.sparkSession, f"{path}.parts"
    rendered(df, missing).coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(part)
    jvm = spark.sparkContext._jvm
    src, dst = jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(path)
    fs = src.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    one = [s.getPath() for s in fs.listStatus(src) if s.getPath().getName().startswith("part-")][0]
    fs.delete(dst, False)
    if not fs.rename(one, dst):
        raise OSError(f"can't rename to {path}")
    fs.delete(src, True)


def values(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def fasta(df: DataFrame, path: str, name: str = "id", seq: str = "seq", width: int | None = None, compression: str = "none") -> None:
    """A nameless sequence keeps its record, with an empty name."""
    s = wrap_sequence(seq, width) if width else F.col(seq)
    df.select(F.concat(F.lit(">"), F.coalesce(F.col(name), F.lit("")), F.lit("\n"), s)).write.mode("overwrite").option("compression", compression).text(path)


def fastq(df: DataFrame, path: str, mate: str | None = None, compression: str = "gzip") -> None:
    """Quality I throughout; with ``mate`` one folder for each."""
    rec = F.concat(F.lit("@"), F.col("read_id"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq"))).alias("value")
    x = df.select(rec, *([mate] if mate else []))
    w = x.write.mode("overwrite").option("compression", compression)
    (w.partitionBy(mate) if mate else w).text(path)


def bed(df: DataFrame, path: str) -> None:
    df.select("contig", "start", "end").write.mode("overwrite").option("sep", "\t").csv(path)


def genbank(df: DataFrame, path: str) -> None:
    """Plain records (id, seq) of molecule type DNA, sixty bases a line in groups of ten."""
    n = F.length("seq")
    chunk = F.transform(F.sequence(F.lit(0), F.expr("(length(seq) - 1) div 60")), lambda i: F.concat(F.lpad((i * 60 + 1).cast("string"), 9, " "), F.lit(" "), F.rtrim(F.regexp_replace(F.lower(F.substring(F.col("seq"), i * 60 + 1, F.lit(60))), "(.{10})", "$1 "))))
    body = F.when(n > 0, F.array_join(chunk, "\n")).otherwise("")
    text = F.concat(F.lit("LOCUS       "), F.rpad("id", 16, " "), F.lit(" "), n.cast("string"), F.lit(" bp    DNA\nDEFINITION  ."), F.lit("\nACCESSION   "), F.col("id"), F.lit("\nVERSION     "), F.col("id"), F.lit("\nFEATURES             Location/Qualifiers\nORIGIN\n"), body, F.lit("\n//"))
    df.select(text).write.mode("overwrite").text(path)


#: Colours and shapes of tree annotations (fixed values).
COLORS = {"blue": "#0000ff", "green": "#00ff00", "red": "#ff0000", "purple": "#8000ff", "black": "#000000"}
SHAPES = {"square": 1, "circle": 2, "star": 3, "right-triangle": 4, "left-triangle": 5, "check": 6}


def color(name: str) -> str:
    if name in COLORS:
        return COLORS[name]
    if len(name) == 7 and name[0] == "#" and all(c in "0123456789abcdefABCDEF" for c in name[1:]):
        return name
    raise ValueError(f"unknown colour {name}")


def tree_rows(df: DataFrame, kind: str, shade: str, label: str = "data", shape: str = "square", what: str = "both", width: float = 2.0) -> DataFrame:
    """(value): the header and a row for each target of an annotation of kind binary, colorstrip, style or text."""
    c, spark = color(shade), df.sparkSession
    v = F.col(df.columns[0])
    if kind == "binary":
        head = ["DATASET_BINARY", "SEPARATOR TAB", f"DATASET_LABEL\t{label}", f"COLOR\t{c}", f"FIELD_SHAPES\t{SHAPES[shape]}", f"FIELD_LABELS\t{label}", f"FIELD_COLORS\t{c}", "DATA"]
        rows = F.concat(v, F.lit("\t1"))
    elif kind == "colorstrip":
        head = ["DATASET_COLORSTRIP", "SEPARATOR TAB", f"DATASET_LABEL\t{label}", f"COLOR\t{c}", "DATA"]
        rows = F.concat(v, F.lit(f"\t{c}\t{label}"))
    elif kind == "style":
        head = ["TREE_COLORS", "SEPARATOR TAB", "DATA"]
        parts = {"branches": [f"\tbranch\t{c}\tnormal\t{width}"], "labels": [f"\tlabel\t{c}\tbold\t1"]}
        parts["both"] = parts["branches"] + parts["labels"]
        rows = F.explode(F.array(*(F.concat(v, F.lit(p)) for p in parts[what])))
    elif kind == "text":
        head = ["DATASET_TEXT", "SEPARATOR TAB", f"DATASET_LABEL\t{label}", f"COLOR\t{c}", "DATA"]
        rows = F.concat(v, F.lit(f"\t{label}\t-1\t{c}\tbold\t1\t0"))
    else:
        raise ValueError(f"unknown kind {kind}")
    return spark.createDataFrame([(h,) for h in head], "value string").unionByName(df.select(rows.alias("value")))


def alignment_blocks(aligned: DataFrame, width: int = 60) -> DataFrame:
    """(id, text) of gapped pairs in blocks of ``width`` columns: reference, marks (| equal, . other), query, each with the
    number of its last residue in the block."""
    a, b, n = F.col("gapped_ref"), F.col("gapped_query"), F.length("gapped_ref")

    def block(i: Column) -> Column:
        at = i * width + 1
        x, y = F.substring(a, at, F.lit(width)), F.substring(b, at, F.lit(width))
        k = F.sequence(F.lit(1), F.length(x))
        marks = F.array_join(F.transform(k, lambda j: F.when((F.substring(x, j, F.lit(1)) == "-") | (F.substring(y, j, F.lit(1)) == "-"), " ").when(F.substring(x, j, F.lit(1)) == F.substring(y, j, F.lit(1)), "|").otherwise(".")), "")
        upto = [F.length(F.translate(F.substring(s, F.lit(1), at + width - 1), "-", "")).cast("string") for s in (a, b)]
        return F.concat(F.lit("ref    "), x, F.lit("  "), upto[0], F.lit("\n       "), marks, F.lit("\nquery  "), y, F.lit("  "), upto[1])

    blocks = F.transform(F.sequence(F.lit(0), ((n - 1) / width).cast("int")), block)
    return aligned.select("id", F.when(n > 0, F.array_join(blocks, "\n\n")).otherwise("").alias("text"))


def biom_rows(long: DataFrame, feature: str = "feature", sample: str = "sample", value: str = "value") -> DataFrame:
    """A sparse feature table as JSON lines, one a feature: its id and the non-zero values by sample."""
    kept = long.where(F.col(value) != 0)
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(sample).cast("string"), F.col(value)))))
    return kept.groupBy(feature).agg(m.alias("data")).select(F.to_json(F.struct(F.col(feature).alias("id"), "data")).alias("value"))


READ_COLUMNS = ("contig", "read_ID", "read_length", "read_aligned_bases", "ref_start", "ref_end", "soft_clipped", "hard_clipped", "clipped_percent", "percent_identity_gap_aware", "percent_identity_gap_compressed")


def read_summary(reads: DataFrame) -> DataFrame:
    """The eleven columns of a per-read table from alignment records (reference_name, query_name, flag, reference_start, cigar, nm):
    1-based inclusive positions, percents as text with two decimals."""
    from ..functions.columns import mate_name, with_cigar

    x = with_cigar(reads)
    span = F.aggregate(F.transform(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), 1), lambda n: n.cast("long")), F.lit(0).cast("long"), lambda a, n: a + n)
    clipped = F.col("soft_clipped") + F.col("hard_clipped")
    two = [F.format_string("%.2f", half_even(c, 2)) for c in (F.try_divide(100.0 * clipped, F.col("full_length")), F.col("pid_gap_aware"), F.col("pid_gap_compressed"))]
    cols = [F.col("reference_name"), mate_name("query_name", "flag"), F.col("full_length"), F.col("query_aligned"), F.col("reference_start") + 1, F.col("reference_start") + span, F.col("soft_clipped"), F.col("hard_clipped"), *two]
    return x.select(*(c.alias(n) for c, n in zip(cols, READ_COLUMNS, strict=True)))


def biom_document(long: DataFrame, path: str, feature: str = "feature", sample: str = "sample", value: str = "value", table: str = "table") -> None:
    """A BIOM 1.0 document (sparse, JSON) of a feature table as a folder of text parts, to be read in order, with a line for each row
    and each entry. Features are dealt by a hash of their names and numbered by name within a task; only the sample names, one a
    column, and a row for each task come to the driver. The numbered rows are kept once and then written where they lie."""
    import json

    from ..operators.ordered import dealt
    from ..shared import checkpoint

    spark = long.sparkSession
    samples = sorted(str(r[0]) for r in long.select(sample).distinct().collect())
    number = F.array_position(F.array(*map(F.lit, samples)), F.col(sample).cast("string")) - 1
    entry = F.when(F.col(value) != 0, F.struct(number.alias("j"), F.col(value).cast("double").alias("v")))
    x = dealt(long.select(F.col(feature).cast("string").alias("f"), entry.alias("e")), ["f"])
    x = x.groupBy("f").agg(F.array_sort(F.collect_list("e")).alias("e")).sortWithinPartitions("f").withColumn("m", F.monotonically_increasing_id())
    x = checkpoint(x.select("f", "e", "m", F.shiftright("m", 33).alias("p")))
    tasks = x.groupBy("p").agg(F.count("*").alias("n"), F.min("m").alias("m"), F.min(F.when(F.size("e") > 0, F.col("m"))).alias("e")).orderBy("p").collect()
    n, before = 0, [(-1, 0)]
    for t in tasks:
        before.append((t["p"], n - t["m"]))
        n += t["n"]
    first_row, first_entry = min([t["m"] for t in tasks], default=-1), min([t["e"] for t in tasks if t["e"] is not None], default=-1)
    x = x.join(F.broadcast(spark.createDataFrame(before, "p long, b long")), "p").withColumn("i", (F.col("m") + F.col("b")).cast("string"))  # a row for each task
    head = {"id": table, "format": "Biological Observation Matrix 1.0.0", "type": "OTU table", "matrix_type": "sparse", "matrix_element_type": "float", "shape": [n, len(samples)], "columns": [{"id": x, "metadata": None} for x in samples]}
    start, middle, end = (spark.range(0, 1, 1, 1).select(F.lit(v).alias("value")) for v in (json.dumps(head)[:-1] + ', "rows": [', '], "data": [', "]}"))
    rows = x.select(F.concat(F.when(F.col("m") == first_row, "").otherwise(","), F.to_json(F.struct(F.col("f").alias("id")))).alias("value"))
    e = x.select("m", "i", F.posexplode("e").alias("k", "e"))
    comma = F.when((F.col("m") == first_entry) & (F.col("k") == 0), "").otherwise(",")
    entries = e.select(F.concat(comma, F.lit("["), "i", F.lit(","), F.col("e.j").cast("string"), F.lit(","), F.col("e.v").cast("string"), F.lit("]")).alias("value"))
    # a union keeps its parts' order and that of their tasks, by which files are named
    start.union(rows).union(middle).union(entries).union(end).write.mode("overwrite").text(path)


def mutations(listed: DataFrame, path: str) -> None:
    """(id, value) of alignment.mutations_or_note: a block of lines for each id under its name."""
    listed.select(F.concat(F.lit("## "), "id", F.lit("\n"), "value")).write.mode("overwrite").text(path)


def coverages(truth: DataFrame, path: str, name: str = "genome", value: str = "mean_coverage") -> None:
    """name and value of the genomes that have one, without a header."""
    truth.where(F.col(value).isNotNull()).select(F.col(name).cast("string"), F.col(value).cast("string")).write.mode("overwrite").option("sep", "\t").csv(path)
