"""Summaries, normalisation, apportionment: mergeable aggregates, joined back where a total is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import exact_percentiles, running_sum

PERCENTS = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
#: Of a coverage overview.
WIDE_PERCENTS = (0.0001, 0.001, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 0.9999)


def percent_name(p: float) -> str:
    """p01, p50, p99_9."""
    t = f"{100 * p:.4f}".rstrip("0").rstrip(".")
    return "p" + (t.zfill(2) if "." not in t else t.replace(".", "_"))


def column_summary(df: DataFrame, value: str, keys: list[str] | None = None, percents: tuple[float, ...] = PERCENTS) -> DataFrame:
    """n, min, max, sum, mean, median, population deviation and percentiles (linear interpolation); non-numbers are left out.

    Without keys the percentiles come from running counts of distinct values over many tasks.
    """
    v = F.col(value).try_cast("double")
    names = [percent_name(p) for p in percents]
    plain = [F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd")]
    if not keys:
        p = exact_percentiles(df.select(v.alias("_v")), "_v", (0.5, *percents), ["median", *names])
        x = df.agg(*plain).join(F.broadcast(p))
    else:
        x = df.groupBy(*keys).agg(*plain, F.percentile(v, [0.5, *percents]).alias("_p")).select("*", *(F.col("_p")[i].alias(n) for i, n in enumerate(["median", *names]))).drop("_p")
    return x.select(*(keys or []), "n", "min", "max", "sum", "mean", "median", "sd", *names)


def overview(df: DataFrame, value: str, key: str, percents: tuple[float, ...] = ()) -> DataFrame:
    """n, mean, median, sample deviation, min, max and percentiles per key and, with a null key and is_total, over all."""
    names = [percent_name(p) for p in percents]
    plain = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max")]
    each = df.groupBy(key).agg(*plain, F.percentile(value, [0.5, *percents]).alias("_p")).select("*", F.lit(0).alias("is_total"), *(F.col("_p")[i].alias(n) for i, n in enumerate(["median", *names])))
    every = df.agg(*plain).join(F.broadcast(exact_percentiles(df, value, (0.5, *percents), ["median", *names])))
    cols = ["is_total", "n", "mean", "median", "sd", "min", "max", *names]
    nobody = F.lit(None).cast(df.schema[key].dataType).alias(key)
    return each.select(F.col(key), *cols).unionByName(every.withColumn("is_total", F.lit(1)).select(nobody, *cols))


def drop_zero_samples(long: DataFrame, sample: str = "sample", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows of samples whose sum isn't 0, names of the others)."""
    sums = long.groupBy(sample).agg(F.sum(value).alias("_t"))
    zero = sums.where(F.col("_t") == 0).select(sample)
    return long.join(zero, sample, "left_anti"), zero


def cpm(long: DataFrame, sample: str = "sample", value: str = "value") -> DataFrame:
    """value / sum of its sample * 1e6; a sample of zeros keeps its zeros."""
    t = long.groupBy(F.col(sample).alias("_s")).agg(F.sum(value).alias("_t"))
    x = long.join(t, F.col(sample) == F.col("_s"))
    return x.withColumn("cpm", F.when(F.col("_t") == 0, 0.0).otherwise(F.col(value) / F.col("_t") * 1e6)).drop("_s", "_t")


def median_ratio(long: DataFrame, feature: str = "feature", sample: str = "sample", value: str = "value") -> DataFrame:
    """Values over their sample's size factor, the median ratio to the geometric means of features positive in every sample."""
    live, _ = drop_zero_samples(long, sample, value)
    n = live.agg(F.countDistinct(sample).alias("_n"))
    v = F.col(value).cast("double")
    pos = live.where(v > 0).groupBy(feature).agg(F.count("*").alias("_c"), F.exp(F.avg(F.log(v))).alias("_g"))
    pos = pos.join(F.broadcast(n), F.col("_c") == F.col("_n")).select(F.col(feature).alias("_f"), "_g")
    factors = live.join(pos, F.col(feature) == F.col("_f")).groupBy(F.col(sample).alias("_s")).agg(F.percentile(v / F.col("_g"), 0.5).alias("size_factor"))
    return long.join(factors, F.col(sample) == F.col("_s"), "left").withColumn("normalized", F.try_divide(v, F.col("size_factor"))).drop("_s")


def normalize(long: DataFrame, method: str = "none", **names) -> DataFrame:
    if method == "none":
        return long
    if method == "cpm":
        return cpm(long, **{k: v for k, v in names.items() if k != "feature"})
    if method in ("mr", "median-ratio"):
        return median_ratio(long, **names)
    raise ValueError(f"unknown normalization {method}")


def depth_statistics(depths: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Detection, detection at 10, mean and median depth from per-base spans (keys, start, end, depth); bases that no span
    covers count as 0. The histogram by depth is small, and the median comes from its running count."""
    h = depths.groupBy(*keys, "depth").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    seen = h.groupBy(*keys).agg(F.sum("n").alias("_seen"))
    missing = lengths.join(seen, keys, "left").select(*keys, F.lit(0).cast("double").alias("depth"), (F.col("length") - F.coalesce("_seen", F.lit(0))).alias("n")).where("n > 0")
    full = h.select(*keys, F.col("depth").cast("double").alias("depth"), "n").unionByName(missing).groupBy(*keys, "depth").agg(F.sum("n").cast("long").alias("n"))
    return full.groupBy(*keys).agg(
        F.sum("n").alias("length"),
        (F.sum(F.when(F.col("depth") > 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("detection"),
        (F.sum(F.when(F.col("depth") >= 10, F.col("n")).otherwise(0)) / F.sum("n")).alias("detection_10x"),
        (F.sum(F.col("depth") * F.col("n")) / F.sum("n")).alias("mean_depth"),
        F.percentile("depth", 0.5, F.col("n")).alias("median_depth"),
    )


def identity_statistics(df: DataFrame, keys: list[str], pid: str = "pid") -> DataFrame:
    """Mean, median of 2-decimal bins, extremes and population deviation."""
    bins = df.where(F.col(pid).isNotNull())
    return bins.groupBy(*keys).agg(F.count("*").alias("n_reads"), F.avg(pid).alias("mean_pid"), F.percentile(F.round(pid, 2), 0.5).alias("median_pid"), F.min(pid).alias("min_pid"), F.max(pid).alias("max_pid"), F.stddev_pop(pid).alias("sd_pid"))


def clip_statistics(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Mean aligned, clipped and total bases of reads with the columns of cigar_columns()."""
    clipped = F.col("soft_clipped") + F.col("hard_clipped")
    return reads.groupBy(*keys).agg(
        F.count("*").alias("n_reads"),
        F.avg("query_aligned").alias("mean_aligned"),
        F.avg("soft_clipped").alias("mean_soft"),
        F.avg("hard_clipped").alias("mean_hard"),
        F.avg(clipped).alias("mean_clipped"),
        F.avg(F.try_divide(clipped, F.col("full_length"))).alias("mean_clipped_fraction"),
        F.avg("full_length").alias("mean_length"),
        F.stddev_pop("full_length").alias("sd_length"),
    )


def length_statistics(df: DataFrame, length: str, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.min(length).alias("min"), F.max(length).alias("max"), F.avg(length).alias("mean"), F.percentile(length, 0.5).alias("median"), F.sum(length).alias("total"))


def assembly_summary(contigs: DataFrame, keys: list[str], thresholds: tuple[int, ...] = (100, 500, 1000, 5000, 10_000, 50_000, 100_000)) -> DataFrame:
    """Counts, totals, N50/75/90 and L50/75/90 and contigs of at least each length; contigs has keys and length.

    Lengths are counted first, so the running sum goes over distinct lengths of an assembly and not over its contigs. Contigs of
    length 0 or null count as contigs and add nothing.
    """
    h = contigs.groupBy(*keys, "length").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    down = w.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("bases", F.sum(F.col("c") * F.col("length")).over(down)).withColumn("upto", F.sum("c").over(down)).withColumn("total", F.sum(F.col("c") * F.col("length")).over(w))
    aggs: list[Column] = [F.sum("c").alias("contigs"), F.max("total").alias("total_length"), F.max("length").alias("max"), F.min("length").alias("min")]
    for p in (50, 75, 90):
        # in integers: the first length at which 100 * bases reach p percent of the total
        reached = F.col("bases") * 100 >= F.col("total") * p
        aggs.append(F.max(F.when(reached, F.col("length"))).alias(f"n{p}"))
        need = F.ceil(F.try_divide(F.col("total") * p - (F.col("bases") - F.col("c") * F.col("length")) * 100, F.col("length") * 100))
        aggs.append(F.min(F.when(reached, F.col("upto") - F.col("c") + F.greatest(need, F.lit(1)))).alias(f"l{p}"))
    aggs += [F.sum(F.when(F.col("length") >= t, F.col("c")).otherwise(0)).alias(f"contigs_{t}") for t in thresholds]
    return h.groupBy(*keys).agg(*aggs)


def assembly_table(seqs: DataFrame, assemblies: DataFrame, key: str = "assembly") -> DataFrame:
    """assembly_summary of seqs(assembly, seq) with ambiguous characters (all but A, C, G, T in any case) and GC content in percent,
    2 decimals; assemblies without a contig stay, with nulls, and sequences without an assembly are one of their own."""
    acgt, gc = F.length(F.regexp_replace("seq", "[^ACGTacgt]", "")), F.length(F.regexp_replace("seq", "[^GCgc]", ""))
    x = seqs.select(key, F.length("seq").cast("long").alias("length"), acgt.cast("long").alias("_acgt"), gc.cast("long").alias("_gc"))
    more = x.groupBy(key).agg(F.sum(F.col("length") - F.col("_acgt")).alias("ambiguous"), F.round(F.try_divide(100.0 * F.sum("_gc"), F.sum("_acgt")), 2).alias("gc_content"))
    out = assemblies.select(key).distinct()
    for y in (assembly_summary(x, [key]), more):
        y = y.withColumnRenamed(key, "_k")
        out = out.join(y, out[key].eqNullSafe(y["_k"]), "left").drop("_k")
    return out


def transposed(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One row a measure and one column for each of the named rows; values as text, NA where missing."""
    measures = [c for c in df.columns if c != key]
    pairs = F.array(*(F.struct(F.lit(i).alias("_i"), F.lit(c).alias("measure"), F.col(c).cast("string").alias("v")) for i, c in enumerate(measures)))
    x = df.select(F.col(key).cast("string").alias("_k"), F.explode(pairs).alias("p")).select("_k", "p.*")
    wide = x.groupBy("_i", "measure").pivot("_k", names).agg(F.min("v"))
    return wide.na.fill("NA", names).orderBy("_i").drop("_i")


def reference_table(depths: DataFrame, contigs: DataFrame, reads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(per reference, per contig) statistics of depths(contig, start, end, depth), contigs(contig, ref, length) and, if given,
    reads(contig, pid): identities of contigs without reads are null and their reads 0. A contig name under several references
    counts for the last of them by name."""
    c = contigs.groupBy("contig").agg(F.max_by(F.struct("ref", "length"), "ref").alias("_r")).select("contig", "_r.ref", "_r.length")
    d = depths.join(c.select("contig", "ref"), "contig")
    out = []
    for keys in (["ref"], ["ref", "contig"]):
        lengths = c.groupBy(*keys).agg(F.sum("length").alias("length"), F.count("*").alias("num_contigs"))
        x = depth_statistics(d, lengths.select(*keys, "length"), keys)
        if keys == ["ref"]:
            x = x.join(lengths.select("ref", "num_contigs"), "ref")
        if reads is not None:
            x = x.join(identity_statistics(reads.join(c.select("contig", "ref"), "contig"), keys).select(*keys, "mean_pid", "median_pid", F.col("n_reads").alias("num_mapped_reads")), keys, "left").na.fill(0, ["num_mapped_reads"])
        out.append(x)
    return out[0], out[1]


def apportion(df: DataFrame, weight: str, order: list[str], total: int, keys: list[str] | None = None, even: bool = False) -> DataFrame:
    """Whole units that add up to ``total`` by largest remainder, ties by ``order``; pairs with ``even``. Without keys rows are
    ranked range by range, so no task sees all."""
    k = keys or []
    unit = 2 if even else 1
    t = df.groupBy(*k).agg(F.sum(weight).alias("_t"))
    x = df.join(t, k) if k else df.join(F.broadcast(t))
    x = x.withColumn("_x", F.col(weight) / F.col("_t") * (total // unit)).withColumn("_f", F.floor("_x").cast("long"))
    left = x.groupBy(*k).agg((F.lit(total // unit) - F.sum("_f")).alias("_left"))
    x = x.join(left, k) if k else x.join(F.broadcast(left))
    if k:
        x = x.withColumn("_rank", F.row_number().over(Window.partitionBy(*k).orderBy(F.desc(F.col("_x") - F.col("_f")), *order)))
    else:
        x = running_sum(x.withColumn("_rest", F.col("_f") - F.col("_x")).withColumn("_one", F.lit(1)), "_rest", "_one", "_rank", order).drop("_rest", "_one")
    x = x.withColumn("units", (F.col("_f") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)) * unit)
    return x.drop("_t", "_x", "_f", "_left", "_rank")


def offsets(df: DataFrame, units: str, order: list[str], keys: list[str]) -> DataFrame:
    """``first``: the units of the rows before."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("first", F.sum(units).over(w) - F.col(units))


def split_by_length(df: DataFrame, total: str, length: str, order: list[str], keys: list[str]) -> DataFrame:
    """``share`` of a group's units for each contig: differences of the rounded running target, so shares add up. Groups without
    length get 0."""
    w = Window.partitionBy(*keys)
    upto = F.sum(length).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    x = df.withColumn("_cum", F.coalesce(F.bround(F.try_divide(F.col(total) * upto, F.sum(length).over(w))), F.lit(0.0)))
    before = F.lag("_cum", 1, 0).over(w.orderBy(*order))
    return x.withColumn("share", (F.col("_cum") - before).cast("long")).drop("_cum")


def relative_abundance(df: DataFrame, weight: str = "weight", pin: str = "pin") -> DataFrame:
    """Pinned shares come off the top, the rest is split by weight; all are scaled if the pins alone exceed one."""
    t = df.agg(F.coalesce(F.sum(pin), F.lit(0.0)).alias("_p"), F.coalesce(F.sum(F.when(F.col(pin).isNull(), F.col(weight))), F.lit(0.0)).alias("_w"))
    x = df.join(F.broadcast(t))
    raw = F.coalesce(F.col(pin), F.coalesce(F.try_divide(F.col(weight), F.col("_w")), F.lit(0.0)) * F.greatest(F.lit(1.0) - F.col("_p"), F.lit(0.0)))
    whole = F.when((F.col("_w") > 0) & (F.col("_p") < 1), F.greatest(F.lit(1.0), F.col("_p"))).otherwise(F.col("_p"))
    return x.withColumn("rel_abundance", F.try_divide(raw, whole)).drop("_p", "_w")


def realized(df: DataFrame, bases: str = "bases", genome: str = "genome_size") -> DataFrame:
    t = df.agg(F.sum(F.try_divide(F.col(bases).cast("double"), F.col(genome))).alias("_t"))
    cov = F.try_divide(F.col(bases).cast("double"), F.col(genome))
    return df.join(F.broadcast(t)).withColumn("mean_coverage", cov).withColumn("rel_abundance", F.try_divide(cov, F.col("_t"))).drop("_t")


def truth_per_rank(df: DataFrame, ranks: list[str], value: str = "rel_abundance") -> DataFrame:
    """(rank, taxon, abundance) for every rank from one pass; unassigned taxa are one group with a null name."""
    from ..functions.columns import assigned

    long = df.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rank"), assigned(r).alias("taxon")) for r in ranks))).alias("x"), value)
    return long.groupBy("x.rank", "x.taxon").agg(F.sum(value).alias("abundance"))
