"""Ordered reports, annotations and cross-sample tables. Order is a column (``ordinal``), never the order of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import report_rank
from ..schema import RANKS

_CODES = dict(zip("DPCOFGS", RANKS, strict=True))


def forward_fill_lineage(report: DataFrame, keys: list[str], ranks: tuple[str, ...] = RANKS, codes: dict[str, str] | None = None) -> DataFrame:
    """The lineage of each line of a classifier report (keys, ordinal, rank, name).

    A line of a rank sets it and clears all finer ones; other lines inherit. For each rank the last line that set it
    is known from a running maximum, and its name holds unless a coarser rank was set later.
    """
    by_rank = {v: k for k, v in (codes or _CODES).items()}
    w = Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    x, coarser = report, None
    for r in ranks:
        mine = F.max(F.when(F.col("rank") == by_rank[r], F.struct("ordinal", "name"))).over(w)
        x = x.withColumn(f"_{r}", mine)
        at = F.col(f"_{r}.ordinal")
        x = x.withColumn(r, F.when(at > coarser, F.col(f"_{r}.name")) if coarser is not None else F.col(f"_{r}.name"))
        coarser = F.coalesce(F.greatest(at, coarser), at, coarser) if coarser is not None else F.coalesce(at, F.lit(-1))
    return x.drop(*(f"_{r}" for r in ranks))


def classifier_summary(report: DataFrame, keys: list[str]) -> DataFrame:
    """Reads and percent of all reads per taxid and lineage; taxid 0 is Unclassified; rows of no reads go last of all."""
    x = report.withColumn("name", F.trim("name")).withColumn("rank", report_rank("rank", "name"))
    x = forward_fill_lineage(x, keys)
    none = (F.col("rank") == "U") | (F.col("taxid").cast("string") == "0")
    lineage = [F.when(none, F.lit("Unclassified") if r == "domain" else F.lit(None)).otherwise(F.col(r)).alias(r) for r in RANKS]
    s = x.select(*keys, "taxid", *lineage, "reads").groupBy(*keys, "taxid", *RANKS).agg(F.sum("reads").alias("reads"))
    t = s.groupBy(*keys).agg(F.sum("reads").alias("_t"))
    s = s.join(t, keys) if keys else s.join(F.broadcast(t))
    return s.withColumn("percent", F.try_divide(100.0 * F.col("reads"), F.col("_t"))).drop("_t").where("reads > 0")


def report_order(df: DataFrame) -> DataFrame:
    """Unclassified first, then rows without a lineage, then by lineage and taxid."""
    empty = F.coalesce(*map(F.col, RANKS)).isNull()
    return df.orderBy(F.when(F.col("domain") == "Unclassified", 0).when(empty, 1).otherwise(2), *(F.col(r).asc_nulls_last() for r in RANKS), "taxid")


def domain_letters(report: DataFrame, keys: list[str]) -> DataFrame:
    """Names prefixed with the letter of the domain above them, ? before the first; domain rows stay bare."""
    letter = F.when(F.col("rank") == "D", F.when(F.col("name") == "Bacteria", "B").when(F.col("name") == "Archaea", "A").when(F.col("name") == "Eukaryota", "E").when(F.col("name") == "Viruses", "V").otherwise("?"))
    w = Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    x = report.withColumn("_l", F.coalesce(F.last(letter, ignorenulls=True).over(w), F.lit("?")))
    return x.withColumn("name", F.when(F.col("rank") == "D", F.col("name")).otherwise(F.concat(F.lit("("), F.col("_l"), F.lit(") "), F.col("name")))).drop("_l")


def report_totals(report: DataFrame, keys: list[str]) -> DataFrame:
    u, root = F.when(F.col("rank") == "U", F.col("clade_reads")).otherwise(0), F.col("rank") == "R"
    total = F.sum(u) + F.sum(F.when(root, F.col("clade_reads")).otherwise(0))
    return report.groupBy(*keys).agg(total.alias("total_reads"), F.try_divide(100.0 * F.sum(u), total).alias("percent_unclassified"), F.try_divide(100.0 * F.sum(F.when(root, F.col("reads")).otherwise(0)), total).alias("percent_at_root"))


def top_and_other(df: DataFrame, name: str, value: str, keys: list[str] | None = None, n: int = 10, least: float | None = None) -> DataFrame:
    """Sums per name; all but the n largest (or those below ``least``) folded into Other. Ties by name."""
    k = keys or []
    s = df.groupBy(*k, name).agg(F.sum(value).alias(value))
    if least is not None:
        keep = F.col(value) >= least
    elif k:
        s = s.withColumn("_n", F.row_number().over(Window.partitionBy(*k).orderBy(F.desc(value), name)))
        keep = F.col("_n") <= n
    else:
        top = s.orderBy(F.desc(value), name).limit(n).select(F.struct(name).alias("_top"))
        s = s.join(F.broadcast(top), F.struct(name).eqNullSafe(F.col("_top")), "left")
        keep = F.col("_top").isNotNull()
    return s.withColumn(name, F.when(keep, F.col(name)).otherwise(F.lit("Other"))).groupBy(*k, name).agg(F.sum(value).alias(value))


def best_hits(hits: DataFrame, key: str, value: list[str], passes: Column, order: list[Column]) -> DataFrame:
    """The first passing hit of each key by order; keys without one have nulls."""
    best = F.min_by(F.when(passes, F.struct(*value)), F.when(passes, F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))))
    return hits.groupBy(key).agg(best.alias("_b")).select(key, *(F.col(f"_b.{v}").alias(v) for v in value))


def best_annotations(hits: DataFrame) -> DataFrame:
    """KO of each gene with the smallest e-value among those above their threshold or without one."""
    passes = F.col("ko").isNotNull() & (F.col("threshold").isNull() | (F.col("score") > F.col("threshold")))
    return best_hits(hits, "gene", ["ko", "function"], passes, [F.col("evalue"), F.col("ordinal")])


def counted_terms(annotations: DataFrame) -> DataFrame:
    """(term, term_counts) of annotations(terms array)."""
    return annotations.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("term_counts"))


def term_shares(counts: DataFrame, terms: DataFrame, keep_zeros: bool = False) -> DataFrame:
    """Count of each living term, its percent of all and within its namespace."""
    live = terms.where(~F.col("is_obsolete"))
    x = live.join(counts, "term", "left").withColumn("term_counts", F.coalesce("term_counts", F.lit(0)))
    own = x.groupBy("namespace").agg(F.sum("term_counts").alias("_o"))
    every = own.agg(F.sum("_o").alias("_a"))
    x = x.join(own, "namespace").join(F.broadcast(every))
    x = x.withColumn("percent", F.coalesce(F.try_divide(100.0 * F.col("term_counts"), F.col("_a")), F.lit(0.0))).withColumn("percent_in_namespace", F.coalesce(F.try_divide(100.0 * F.col("term_counts"), F.col("_o")), F.lit(0.0))).drop("_a", "_o")
    return x if keep_zeros else x.where("term_counts > 0")


def term_counts(annotations: DataFrame, terms: DataFrame, keep_zeros: bool = False) -> DataFrame:
    """Shares of annotations(gene, terms array) over all living terms; unknown terms don't count (see unknown_terms)."""
    return term_shares(counted_terms(annotations), terms, keep_zeros)


def unknown_terms(annotations: DataFrame, terms: DataFrame) -> DataFrame:
    return annotations.select(F.explode("terms").alias("term")).distinct().join(terms, "term", "left_anti")


def combine_samples(samples: list[tuple[str, DataFrame]], key: str, value: str, meta: list[str] | None = None) -> DataFrame:
    """One row a key and one column a sample, 0 where it is absent; other columns from the first sample that has the key."""
    meta = meta or []
    long = None
    for i, (name, df) in enumerate(samples):
        one = df.select(key, F.lit(name).alias("_s"), F.lit(i).alias("_i"), F.col(value).alias("_v"), *meta)
        long = one if long is None else long.unionByName(one)
    aggs = [F.sum(F.when(F.col("_s") == n, F.col("_v")).otherwise(0)).alias(n) for n, _ in samples]
    firsts = [F.min_by(m, "_i").alias(m) for m in meta]
    return long.groupBy(key).agg(*firsts, *aggs)


def pivot_counts(df: DataFrame, key: str, column: str, names: list[str], value: Column | None = None) -> DataFrame:
    """Counts (or sums) of key x column over the given names, 0 where absent."""
    p = df.groupBy(key).pivot(column, names)
    return (p.count() if value is None else p.agg(F.sum(value))).na.fill(0, names)


def found_targets(counts: DataFrame, target: str = "target", n: str = "n") -> DataFrame:
    """Rows of targets seen in at least one assembly."""
    return counts.join(counts.groupBy(target).agg(F.max(n).alias("_m")).where("_m > 0").select(target), target, "left_semi")


def coverage_with_gate(df: DataFrame, coverage: str, detected: str, least: float) -> DataFrame:
    return df.withColumn(coverage, F.when(F.col(detected) <= least, 0.0).otherwise(F.col(coverage)))


def genome_overview(stats: DataFrame, quality: DataFrame, lineage: DataFrame, key: str = "genome", missing: str = "Not Assigned") -> DataFrame:
    """Statistics, quality and lineage by key; blank ranks read as ``missing``."""
    x = stats.join(quality, key).join(lineage, key)
    return x.select(*(c for c in x.columns if c not in RANKS), *(F.coalesce(F.when(F.trim(r) != "", F.col(r)), F.lit(missing)).alias(r) for r in RANKS))


def by_lineage(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(*(F.col(r).asc_nulls_last() for r in RANKS if r in df.columns), key)


def good_bins(df: DataFrame, completeness: float, redundancy: float, name: str = "bin") -> DataFrame:
    return df.where((F.col("completeness") >= completeness) & (F.col("redundancy") <= redundancy)).withColumn(name, F.regexp_replace(name, "-bin\\.", "-MAG-"))


def bin_annotations(genes: DataFrame, contigs: DataFrame) -> DataFrame:
    """Annotated genes on the contigs of each bin; a gene's contig is its id without the last number."""
    return genes.where(F.col("ko").isNotNull()).withColumn("contig", F.regexp_replace("gene", r"_\d+$", "")).join(contigs, "contig")


def rename_by_map(df: DataFrame, key: str, names: DataFrame) -> DataFrame:
    m = names.select(F.col("old").alias("_o"), F.col("new").alias("_n"))
    return df.join(m, F.col(key) == F.col("_o"), "left").withColumn(key, F.coalesce("_n", key)).drop("_o", "_n")


def label_missing(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    return df.na.fill(labels)


def retained(stages: list[tuple[str, DataFrame]], key: str = "sample", value: str = "reads") -> DataFrame:
    """Reads of a sample at each stage and the percent that is left at the end."""
    out = None
    for name, df in stages:
        one = df.select(key, F.col(value).alias(name))
        out = one if out is None else out.join(one, key, "left")
    first, last = stages[0][0], stages[-1][0]
    return out.withColumn("percent_retained", F.try_divide(100.0 * F.col(last), F.col(first)))


def stage_flags(samples: DataFrame, stages: dict[str, DataFrame], key: str = "sample") -> DataFrame:
    """Yes or No for each stage that lists the sample."""
    for name, df in stages.items():
        samples = samples.join(df.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left").withColumn(name, F.when(F.col("_k").isNotNull(), "Yes").otherwise("No")).drop("_k")
    return samples


def reads_screen(identities: DataFrame, detections: DataFrame, least_detection: float = 80.0, least_identity: float = 90.0) -> DataFrame:
    """Targets that the reads show: detection at depth 1 (percent) and mean identity both reach their thresholds.

    identities(target, pid) has one row a read, detections(target, depth, detection) shares from 0 to 1; the row ``total`` of
    all targets is left out. Targets without reads are left out.
    """
    seen = detections.where((F.col("target") != "total") & (F.col("depth") == 1) & (F.col("detection") * 100 >= least_detection)).select("target", "detection")
    s = identities.groupBy("target").agg(F.count("pid").alias("n_reads"), F.avg("pid").alias("mean_pid"))
    return seen.join(s, "target").where(F.col("mean_pid") >= least_identity)


def split_colliding(targets: DataFrame, name: str = "target", kind: str = "type") -> DataFrame:
    """Names that occur with more than one type get the type as a suffix (``x__nt``, ``x__aa``); others stay."""
    both = targets.groupBy(name).agg((F.min(kind) != F.max(kind)).alias("_both")).where("_both").select(F.col(name).alias("_k"))
    x = targets.join(both, F.col(name) == F.col("_k"), "left")
    return x.withColumn(name, F.when(F.col("_k").isNotNull(), F.concat(name, F.lit("__"), kind)).otherwise(F.col(name))).drop("_k")


def runs_of_samples(runs: DataFrame, sample: str = "sample", run: str = "run") -> DataFrame:
    """The runs that make up each sample, in order, by exact name; a sample's runs are few, repeated rows count once."""
    return runs.groupBy(sample).agg(F.array_sort(F.collect_set(run)).alias("runs")).withColumn("n_runs", F.size("runs"))


#: Rank codes that a plot of a report keeps.
STANDARD_CODES = ("D", "P", "C", "O", "F", "G", "S", "U", "R", "R1")


def standard_ranks(report: DataFrame) -> DataFrame:
    """Lines of the standard ranks; those in between go."""
    return report.where(F.col("rank").isin(*STANDARD_CODES))


def keyed_tables(first: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    """Coverage with annotation and taxonomy of the same genes or contigs, by key and not by place; keys that another table lacks
    keep nulls there."""
    for df in others:
        first = first.join(df, key, "left")
    return first


def function_coverage(genes: DataFrame, key: str = "ko", value: str = "coverage") -> DataFrame:
    """Coverage summed by function; genes without one are one group with a null key."""
    return genes.groupBy(key).agg(F.sum(value).alias(value))


def taxid_coverage(rows: DataFrame, key: str = "taxid", value: str = "coverage", ranks: tuple[str, ...] = RANKS) -> DataFrame:
    """Coverage summed by taxid; rows without a taxid, or whose whole lineage is missing (such as the root), are one group with a
    null taxid. The lineage decides row by row, in whatever order tables come."""
    from ..functions.columns import assigned

    named = F.coalesce(*(assigned(r) for r in ranks)).isNotNull()
    return rows.groupBy(F.when(named, assigned(key)).alias(key)).agg(F.sum(value).alias(value))


def enriched(combined: DataFrame, key: str, facts: DataFrame, columns: list[str], missing: str, none: str | None = None) -> DataFrame:
    """A combined table with the facts of its keys: ``missing`` where there are none, and ``none`` as the key of the null group."""
    f = facts.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(*columns)).alias("_f"))
    x = combined.join(f, F.col(key) == F.col("_k"), "left")
    label = F.coalesce(F.col(key).cast("string"), F.lit(none)) if none is not None else F.col(key)
    rest = [c for c in combined.columns if c != key]
    return x.select(label.alias(key), *(F.coalesce(F.col(f"_f.{c}").cast("string"), F.lit(missing)).alias(c) for c in columns), *rest)


def contig_taxonomy(samples: list[tuple[str, DataFrame]], method: str = "none", value: str = "coverage") -> DataFrame:
    """Contig tables of all samples as one: coverage by taxid with the all-missing fold, normalised, with the lineage of each taxid
    (NA) and Not classified for the rest."""
    from . import stats

    summed = [(name, taxid_coverage(df, value=value)) for name, df in samples]
    long = None
    for name, df in summed:
        one = df.select(F.coalesce("taxid", F.lit("")).alias("feature"), F.lit(name).alias("sample"), F.col(value).alias("value"))
        long = one if long is None else long.unionByName(one)
    done = stats.normalize(long, method)
    shown = {"none": "value", "cpm": "cpm"}.get(method, "normalized")
    wide = done.groupBy("feature").pivot("sample", [n for n, _ in samples]).agg(F.sum(shown)).na.fill(0.0, [n for n, _ in samples])
    facts = None
    for _, df in samples:
        one = df.select("taxid", *RANKS)
        facts = one if facts is None else facts.unionByName(one)
    wide = wide.withColumn("taxid", F.when(F.col("feature") != "", F.col("feature"))).drop("feature").select("taxid", *(n for n, _ in samples))
    return enriched(wide, "taxid", facts, list(RANKS), "NA", "Not classified")


def marker_table(taxonomy: DataFrame, counts: DataFrame, key: str = "ASV_ID") -> DataFrame:
    """Taxonomy and counts of the features that both tables have."""
    return taxonomy.join(counts, key)


def union_of_samples(samples: list[tuple[str, DataFrame | None]], name: str = "sample") -> DataFrame:
    """The rows of all samples with the sample first; samples without a table are left out, all without one is an error."""
    out = None
    for sample, df in samples:
        if df is not None:
            one = df.select(F.lit(sample).alias(name), *df.columns)
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sample has a table")
    return out


#: What each output is sorted by; ties by what follows.
ORDERS = {
    "terms": (("namespace", True), ("depth", True), ("term", True)),
    "percent": (("percent", False), ("name", True)),
    "abundance": (("abundance", False), ("taxon", True)),
    "taxid": (("taxid", True),),
}


def in_order(df: DataFrame, kind: str) -> DataFrame:
    """df in one of the output orders; columns of the order that it lacks are passed over."""
    return df.orderBy(*(F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in ORDERS[kind] if c in df.columns))


def taxonomy_bars(report: DataFrame, code: str, keys: list[str] | None = None, n: int = 10, least: float | None = None) -> DataFrame:
    """(keys, name, percent) of one rank for a bar chart: percents by name, the n largest or those of at least ``least`` percent,
    the rest as Other."""
    x = report.withColumn("name", F.trim("name")).withColumn("rank", report_rank("rank", "name")).where(F.col("rank") == code)
    return top_and_other(x.select(*(keys or []), "name", "percent"), "name", "percent", keys, n, least)


def by_column_name(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns in the order given; unknown names are an error that lists the known ones."""
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"no columns {unknown}; known: {df.columns}")
    return df.select(*(F.col(f"`{n}`") for n in names))


def header_report(wanted: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    """(key, found) for each wanted header."""
    return wanted.select(key).distinct().join(records.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left").select(key, F.col("_k").isNotNull().alias("found"))


def accession_report(found: DataFrame, missing: DataFrame) -> DataFrame:
    """(wanted, status) of both halves of a lookup of wanted accessions."""
    return found.select("wanted", F.lit("found").alias("status")).distinct().unionByName(missing.select("wanted", F.lit("not found").alias("status")).distinct())
