"""Interval algebra on one primitive: runs of spans that touch, found with a running maximum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import dealt, running_sum, tasks_for


def mark_runs(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: int = 0, closed: bool = False, tie: list[str] | None = None) -> DataFrame:
    """df with ``run``, the number of the run within its keys.

    A new run begins where start > largest end so far + gap. So half-open spans that touch stay together, and inclusive
    (``closed``) ones that are adjacent come apart, which leaves their total as it is. One shuffle on the keys, one sort.
    """
    w = Window.partitionBy(*keys).orderBy(start, end, *(tie or []))
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col(start) > before + gap, 1).otherwise(0)
    return df.withColumn("_opens", opens).withColumn("run", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def merge_runs(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: int = 0, aggs: list[Column] | None = None, closed: bool = False, by: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """One row a run: keys, start, end, spans and further aggregates. Rows are dealt ``by`` the keys, or some of them, over as many
    ``tasks`` as the input needs; rows that lie so already are not dealt again."""
    if "run" in keys:
        raise ValueError("run names the result; rename the key")
    m = mark_runs(dealt(df, by or keys, tasks), keys, start, end, gap, closed)
    return m.groupBy(*keys, "run").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("spans"), *(aggs or []))


def circle_runs(spans: DataFrame, contigs: DataFrame) -> DataFrame:
    """merge_runs of spans on circles, with each contig's ``length``. Spans are dealt once, for the lengths as for the runs, and meet
    the few lengths of their task in a hash map, so they are sorted once."""
    n = tasks_for(spans)
    # grouped where they lie: of two bare shuffles in fewer tasks than the session's, the planner would make others
    lengths = dealt(contigs, ["contig"], n).groupBy("contig").agg(F.max("length").alias("length"))
    x = dealt(spans, ["contig"], n).join(lengths.hint("shuffle_hash"), "contig")
    return merge_runs(split_wrapped(x), ["contig", "length"], by=["contig"], tasks=n)


def union_length(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", closed: bool = False) -> DataFrame:
    """Bases covered by at least one span."""
    extra = 1 if closed else 0
    return merge_runs(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start") + extra).alias("covered"))


def loci(hsps: DataFrame, gap: int = 200, min_coverage: float = 80.0, edge_coverage: float = 50.0, edge: int = 100, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Hits of one target on one contig joined over gaps; coverage is the union of the target's parts over its length.

    hsps has contig, target, clen, slen, q_start, q_end, s_start, s_end, pident, bitscore (1-based, inclusive). A locus
    passes with the full coverage, or with less if it lies near an end of its contig. ``by`` names the columns of a contig.

    One shuffle, a sort by the query's places and one by the target's; a hit adds the bases of the target that none before it
    covers, and a locus is summed as its hits come by.
    """
    x = hsps.withColumn("q_low", F.least("q_start", "q_end")).withColumn("q_high", F.greatest("q_start", "q_end"))
    x = x.withColumn("s_low", F.least("s_start", "s_end")).withColumn("s_high", F.greatest("s_start", "s_end")).drop("q_start", "q_end", "s_start", "s_end")
    x = mark_runs(dealt(x, [*by, "target"]), [*by, "target"], "q_low", "q_high", gap, True, ["s_low", "s_high"]).withColumnRenamed("run", "locus")
    keys = [*by, "target", "locus"]
    before = F.max("s_high").over(Window.partitionBy(*keys).orderBy("s_low", "s_high").rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_b", before)
    new = F.when(F.col("s_low") <= F.col("_b"), F.greatest(F.col("s_high") - F.col("_b"), F.lit(0))).otherwise(F.col("s_high") - F.col("s_low") + 1)
    out = x.groupBy(*keys).agg(
        F.min("q_low").alias("q_low"),
        F.max("q_high").alias("q_high"),
        F.min("clen").alias("clen"),
        F.max(F.struct("slen"))["slen"].alias("slen"),  # groups with a maximum of structs aren't hashed but taken in the order of the sort
        F.max_by(F.struct("pident", "bitscore"), F.struct("bitscore", -F.col("q_low"), -F.col("s_low"))).alias("top"),
        F.sum(new).alias("covered"),
    )
    out = out.withColumn("perc_target_cov", 100.0 * F.col("covered") / F.col("slen"))
    near_end = (F.col("q_low") <= edge) | (F.col("q_high") > F.col("clen") - edge)
    return out.where((F.col("perc_target_cov") >= min_coverage) | ((F.col("perc_target_cov") >= edge_coverage) & near_end)).select(*by, "target", "q_low", "q_high", "clen", "slen", "perc_target_cov", "top.pident", "top.bitscore")


REGION = "contig string, start long, end long, target string, pident double, bitscore double, members long, alternates string"


def resolve_regions(found: DataFrame, least: float = 0.5) -> DataFrame:
    """Best target of each place: loci of a contig are swept by (start, end) and join the current cluster if they overlap any
    of its members by the share of the shorter span; the best has the highest bitscore, then pident * length.

    Membership depends on what the cluster already holds, so it is swept in Python: partitions of whole contigs come sorted and
    are swept as they come, so a worker holds a batch of loci and one cluster, and contigs cost no call of their own.
    """
    order = ["contig", "q_low", "q_high", "target", "pident", "bitscore"]

    def sweep(batches):
        import pandas as pd

        out, cluster, reach = [], [], -1

        def close():
            if cluster:
                best = sorted(cluster, key=lambda r: (-r.bitscore, -r.pident * (r.q_high - r.q_low + 1), r.target))
                out.append((best[0].contig, min(r.q_low for r in cluster), max(r.q_high for r in cluster), best[0].target, best[0].pident, best[0].bitscore, len(cluster), ";".join(r.target for r in best[1:]) or None))

        def frame():
            made = pd.DataFrame(out, columns=["contig", "start", "end", "target", "pident", "bitscore", "members", "alternates"])
            out.clear()
            return made

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                size = r.q_high - r.q_low + 1
                joins = cluster and r.contig == cluster[0].contig and r.q_low <= reach and any(min(r.q_high, m.q_high) - max(r.q_low, m.q_low) + 1 >= least * min(size, m.q_high - m.q_low + 1) for m in reversed(cluster))
                if not joins:
                    close()
                    cluster, reach = [], -1
                cluster.append(r)
                reach = max(reach, r.q_high)
            yield frame()
        close()
        yield frame()

    return found.select(*order).repartition("contig").sortWithinPartitions(*order).mapInPandas(sweep, REGION)


def islands(regions: DataFrame, lengths: DataFrame, gap: int = 5000, buffer: int = 0, min_contig: int = 20_000, times: float = 3.0, min_span: int = 2_000, min_regions: int = 3) -> DataFrame:
    """Chains of regions within a gap that pass the extraction gate, buffered and clamped to the contig, numbered per contig, with
    the chain's own bounds and the contig's length beside."""
    n = tasks_for(regions)
    x = merge_runs(regions, ["contig"], gap=gap, closed=True, tasks=n).join(dealt(lengths, ["contig"], n).hint("shuffle_hash"), "contig")
    span = F.col("end") - F.col("start") + 1
    x = x.where((F.col("length") >= min_contig) & (F.col("length") >= times * span) & (span >= min_span) & (F.col("spans") >= min_regions))
    n = F.row_number().over(Window.partitionBy("contig").orderBy("start"))
    return x.select(
        "contig",
        F.concat_ws("_", F.col("contig"), F.lit("island"), n.cast("string")).alias("island"),
        F.greatest(F.col("start") - buffer, F.lit(1)).alias("start"),
        F.least(F.col("end") + buffer, F.col("length")).alias("end"),
        F.col("spans").alias("regions"),
        F.col("start").alias("island_start"),
        F.col("end").alias("island_end"),
        F.col("length").alias("contig_length"),
    )


def named_islands(found: DataFrame) -> DataFrame:
    """islands() under the ids that files and tables share: safe contig name, _island_, buffered start-end."""
    from ..functions.columns import safe_name

    return found.withColumn("island", F.concat(safe_name(F.col("contig").cast("string")), F.lit("_island_"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))


def island_sequences(found: DataFrame, seqs: DataFrame) -> DataFrame:
    """(island, contig, seq) sliced from seqs(id, seq); bounds are 1-based and inclusive. Islands of one contig meet its text once."""
    cuts = found.groupBy("contig").agg(F.collect_list(F.struct("island", "start", "end")).alias("_i"))
    x = cuts.join(seqs.select(F.col("id").alias("contig"), "seq"), "contig")
    x = x.select("contig", "seq", F.explode("_i").alias("i"))
    return x.select("i.island", "contig", F.substring("seq", F.col("i.start").cast("int"), (F.col("i.end") - F.col("i.start") + 1).cast("int")).alias("seq"))


def region_islands(regions: DataFrame, found: DataFrame) -> DataFrame:
    """regions with the island that each lies in, or null. Regions are dealt by contig and meet the islands of their task in a hash
    map, unsorted."""
    n = tasks_for(regions)
    i = found.select(F.col("contig").alias("_c"), "island", F.col("island_start").alias("_s"), F.col("island_end").alias("_e"))
    return dealt(regions, ["contig"], n).join(dealt(i, ["_c"], n).hint("shuffle_hash"), (F.col("contig") == F.col("_c")) & (F.col("start") >= F.col("_s")) & (F.col("end") <= F.col("_e")), "left").drop("_c", "_s", "_e")


def identity_filter(hsps: DataFrame, nucleotides: float = 80.0, residues: float = 70.0, kind: str = "target_type") -> DataFrame:
    """Hits whose percent identity reaches the threshold of their kind, nt or aa."""
    return hsps.where(F.col("pident") >= F.when(F.col(kind) == "aa", residues).otherwise(nucleotides))


def contig_summary(found: DataFrame, lengths: DataFrame, regions: DataFrame | None = None, islands: DataFrame | None = None) -> DataFrame:
    """Per contig with loci(contig, target, q_low, q_high): length, bases that targets align to (each once), their percent, different
    and total targets, and if given the number of resolved regions and the ids of its islands, joined by ; or none."""
    bases = union_length(found.select("contig", F.col("q_low").alias("start"), F.col("q_high").alias("end")), ["contig"], closed=True)
    hits = found.groupBy("contig").agg(F.countDistinct("target").alias("num_unique_target_hits"), F.count("*").alias("num_total_target_hits"))
    x = bases.withColumnRenamed("covered", "bases_aligned_to_targets").join(hits, "contig").join(lengths, "contig")
    x = x.withColumn("perc_contig_aligned_to_targets", F.try_divide(100.0 * F.col("bases_aligned_to_targets"), F.col("length")))
    if regions is not None:
        x = x.join(regions.groupBy("contig").agg(F.count("*").alias("num_regions")), "contig", "left").na.fill(0, ["num_regions"])
    if islands is not None:
        ids = islands.groupBy("contig").agg(F.array_join(F.array_sort(F.collect_list("island")), ";").alias("island_ids"))
        x = x.join(ids, "contig", "left").withColumn("island_ids", F.coalesce("island_ids", F.lit("none")))
    return x


def screen_assemblies(hits: list[tuple[str, DataFrame]], gap: int = 200, **gates) -> DataFrame:
    """Loci of every assembly in one table with ``assembly`` first: assemblies are a key, not a loop of results."""
    every = None
    for name, df in hits:
        one = df.withColumn("assembly", F.lit(name)).withColumn("contig", F.col("contig").cast("string"))
        every = one if every is None else every.unionByName(one)
    x = loci(every, gap, by=("contig", "assembly"), **gates)
    return x.select("assembly", *(c for c in x.columns if c != "assembly"))


def assembly_names(paths: list[str]) -> list[str]:
    """File names without the suffix, or whole paths without it if two are alike."""
    import os

    short = [os.path.basename(p).rsplit(".", 1)[0] for p in paths]
    return short if len(set(short)) == len(short) else [p.rsplit(".", 1)[0] for p in paths]


def require_overlap(subjects: DataFrame, targets: DataFrame, key: str) -> None:
    """An error if no subject id is among the targets."""
    if subjects.select(key).join(targets.select(key), key, "left_semi").isEmpty():
        raise ValueError("none of the targets is in the search results")


def detection_state(spans: DataFrame, contigs: DataFrame, enough: float = 1.0) -> DataFrame:
    """Per contig of contigs(contig, length): covered bases, covered intervals and whether the share covered reaches ``enough``;
    a contig of length 0 is done."""
    s = circle_runs(spans, contigs).groupBy("contig").agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.count("*").alias("intervals"))
    x = contigs.join(s, "contig", "left").na.fill(0, ["covered", "intervals"])
    return x.withColumn("done", (F.col("length") == 0) | (F.col("covered") >= enough * F.col("length")))


def contig_lengths(seqs: DataFrame) -> DataFrame:
    """(contig, length) of seqs(id, seq); of contigs with one name the longest."""
    return seqs.groupBy(F.col("id").alias("contig")).agg(F.max(F.length("seq").cast("long")).alias("length"))


def sliding_windows(contigs: DataFrame, size: int, step: int) -> DataFrame:
    """(contig, start, end) 0-based half-open; contigs shorter than a window give none."""
    from ..functions.columns import windows_of

    return contigs.select("contig", F.explode(windows_of(F.col("length"), size, step)).alias("start")).withColumn("end", F.col("start") + size)


def window_statistics(windows: DataFrame, value: str = "value", per: list[str] | None = None) -> DataFrame:
    """Fold, signed fold, z-score, log2 fold and average-rank percentile of each window against all or its group.

    Totals come from an aggregate joined back, ranks from running counts of the distinct values, so nothing is ranked row by
    row and without groups no task sees all values.
    """
    keys = per or []
    v = F.col(value)
    one = windows.withColumn("_k", F.lit(1)) if not keys else windows
    k = keys or ["_k"]
    stats = one.groupBy(*k).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"), F.count(value).alias("_n"))
    freq = one.groupBy(*k, v.alias("_v")).agg(F.count("*").alias("_c"))
    if keys:
        freq = freq.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*k).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    else:
        freq = running_sum(freq, "_v", "_c", "_upto")
    ranked = freq.withColumn("_rank", F.col("_upto") - (F.col("_c") - 1) / 2.0).drop("_c", "_upto")
    x = one.join(stats, k)
    x = x.withColumn("_v", v).join(ranked, [*k, "_v"])
    return _against(x, v, F.col("_mean"), F.col("_sd")).withColumn("percentile", 100.0 * F.col("_rank") / F.col("_n")).drop("_mean", "_sd", "_n", "_rank", "_v", "_k")


def _against(x: DataFrame, v: Column, mean: Column, sd: Column) -> DataFrame:
    """x with fold, signed fold (0 where the fold is 0), z-score and log2 fold of a value against a mean and deviation."""
    fold = F.try_divide(v, mean)
    signed = F.when(fold == 0, 0.0).when(fold >= 1, fold).otherwise(F.try_divide(F.lit(-1.0), fold))
    return x.withColumn("fold", fold).withColumn("signed_fold", signed).withColumn("zscore", F.try_divide(v - mean, sd)).withColumn("log2_fold", F.log2((v + 1e-6) / (mean + 1e-6)))


def extreme_windows(stats: DataFrame, metric: str, threshold: float, high: bool, value: str = "value") -> DataFrame:
    return stats.where(F.col(metric) >= threshold) if high else stats.where((F.col(metric) <= threshold) | (F.col(value) == 0))


def away_from_edges(windows: DataFrame, edge: int = 500) -> DataFrame:
    return windows.where((F.col("start") >= edge) & (F.col("end") <= F.col("length") - edge))


def window_regions(windows: DataFrame, gap: int = 1000, min_length: int = 0, exclude: list[str] | None = None) -> DataFrame:
    """Windows merged over a gap; coverage is the plain mean of the member windows."""
    x = windows.where(~F.col("contig").isin(*exclude)) if exclude else windows
    return merge_runs(x, ["contig"], gap=gap, aggs=[F.avg("value").alias("coverage")]).where(F.col("end") - F.col("start") >= min_length)


def region_percentiles(regions: DataFrame, windows: DataFrame) -> DataFrame:
    """Share of all windows whose value is at most the region's mean.

    Both sides are put on one ordered axis and counted with a running sum over distinct values, instead of a comparison of
    every region with every window.
    """
    w = windows.groupBy(F.col("value").alias("v")).agg(F.count("*").alias("n"))
    r = regions.select(F.col("coverage").alias("v")).distinct().withColumn("n", F.lit(0).cast("long"))
    axis = running_sum(w.unionByName(r).groupBy("v").agg(F.sum("n").alias("n")), "v", "n", "upto")
    total = windows.agg(F.count("*").alias("total"))
    return regions.join(axis.select(F.col("v").alias("coverage"), "upto"), "coverage").join(F.broadcast(total)).withColumn("percentile", 100.0 * F.col("upto") / F.col("total")).drop("upto", "total")


def region_metrics(regions: DataFrame, windows: DataFrame, per_contig: bool = False) -> DataFrame:
    """regions(contig, start, end, coverage) with length, fold, signed_fold, zscore, log2_fold against all windows or those of the
    contig, and percentile, the share of those windows that are at most the region's mean."""
    if per_contig:
        base = windows.groupBy("contig").agg(F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_sd"), F.count("value").alias("_n"))
        w = windows.select("contig", F.col("value").alias("coverage"), F.lit(1).cast("long").alias("_w"))
        axis = w.unionByName(regions.select("contig", "coverage", F.lit(0).cast("long").alias("_w"))).groupBy("contig", "coverage").agg(F.sum("_w").alias("_w"))
        upto = F.sum("_w").over(Window.partitionBy("contig").orderBy("coverage").rowsBetween(Window.unboundedPreceding, 0))
        x = regions.join(axis.select("contig", "coverage", upto.alias("_upto")), ["contig", "coverage"]).join(base, "contig")
        x = x.withColumn("percentile", 100.0 * F.col("_upto") / F.col("_n"))
    else:
        base = windows.agg(F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_sd"))
        x = region_percentiles(regions, windows).join(F.broadcast(base))
    x = x.withColumn("length", F.col("end") - F.col("start"))
    x = _against(x, F.col("coverage"), F.col("_mean"), F.col("_sd"))
    return x.select("contig", "start", "end", "length", "coverage", "percentile", "zscore", "signed_fold", "fold", "log2_fold")


def overlap_sums(regions: DataFrame, spans: DataFrame, bin_size: int, where: Column | None = None) -> DataFrame:
    """Per region (contig, start, end) the bases that it shares with spans; both sides meet in equal bins, each pair once."""
    s = spans if where is None else spans.where(where)

    def binned(d: DataFrame, p: str) -> DataFrame:
        d = d.select(F.col("contig").alias("contig"), F.col("start").alias(f"{p}s"), F.col("end").alias(f"{p}e")).where(F.col(f"{p}e") > F.col(f"{p}s"))
        return d.withColumn("bin", F.explode(F.sequence(F.expr(f"{p}s div {bin_size}"), F.expr(f"({p}e - 1) div {bin_size}"))))

    r, t = binned(regions.select("contig", "start", "end").distinct(), "r"), binned(s, "t")
    both = r.join(t, ["contig", "bin"]).where("rs < te and ts < re")
    # a pair counts in the bin where its overlap begins
    both = both.where(F.expr(f"greatest(rs, ts) div {bin_size} = bin"))
    sums = both.groupBy("contig", F.col("rs").alias("start"), F.col("re").alias("end")).agg(F.sum(F.least("re", "te") - F.greatest("rs", "ts")).alias("shared"))
    return regions.join(sums, ["contig", "start", "end"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)).cast("long"))


def split_wrapped(spans: DataFrame) -> DataFrame:
    """Spans (contig, start, end, length) that run past the origin of a circle become two."""
    whole = F.array(F.struct("start", "end"))
    two = F.array(F.struct("start", F.col("length").alias("end")), F.struct(F.lit(0).cast("long").alias("start"), (F.col("end") - F.col("length")).alias("end")))
    x = spans.withColumn("_p", F.explode(F.when(F.col("end") > F.col("length"), two).otherwise(whole)))
    return x.select(*(c for c in spans.columns if c not in ("start", "end")), "_p.start", "_p.end")


def detection(spans: DataFrame, contigs: DataFrame) -> DataFrame:
    """Covered bases and share of each contig; one of length 0 is fully detected."""
    covered = circle_runs(spans, contigs).groupBy("contig").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    c = contigs.join(covered, "contig", "left")
    return c.withColumn("covered", F.coalesce("covered", F.lit(0))).withColumn("detection", F.when(F.col("length") == 0, 1.0).otherwise(F.col("covered") / F.col("length")))


def covered_contigs(spans: DataFrame, contigs: DataFrame, circular: bool = False) -> DataFrame:
    """Maximal covered runs named contig:start-end; on a circle the last and the first are one if both reach the origin."""
    runs = circle_runs(spans, contigs)
    if circular:
        w = Window.partitionBy("contig")
        wraps = (F.min("start").over(w) == 0) & (F.max("end").over(w) == F.col("length")) & (F.count("*").over(w) > 1)
        runs = runs.withColumn("_wraps", wraps).withColumn("_first", F.min(F.when(F.col("start") == 0, F.col("end"))).over(w))
        runs = runs.where(~(F.col("_wraps") & (F.col("start") == 0)))
        runs = runs.withColumn("end", F.when(F.col("_wraps") & (F.col("end") == F.col("length")), F.col("length") + F.col("_first")).otherwise(F.col("end"))).drop("_wraps", "_first")
    return runs.select("contig", "start", "end", F.concat(F.col("contig"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")).alias("name"))
