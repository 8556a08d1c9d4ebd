"""Queries over intervals, statistics, reports and aligned sequences, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alignment, columns
from ..operators import intervals, ontology, reports, sequences, stats
from ..shared import checkpoint
from ..sources import writers
from .catalog_queries import _HOURLY, _LINEAGE, _SPANS, _edges, _hourly, _lineage, _matrix, _MATRIX, _runs, _spans, query, t

# --- intervals ------------------------------------------------------------------------------------------


def _hits(spark, sf):
    c = F.col
    return t(spark, sf, "lineitem").select(c("l_suppkey").alias("contig"), (c("l_partkey") % 11).alias("target"), F.when(c("l_linenumber") % 2 == 0, "aa").otherwise("nt").alias("target_type"), (60 + c("l_discount") * 400).alias("pident"), F.datediff("l_shipdate", F.lit("1992-01-01")).cast("long").alias("q_low"), (F.datediff("l_shipdate", F.lit("1992-01-01")) + c("l_quantity").cast("long")).alias("q_high"))


_HITS = "h AS (SELECT l_suppkey AS contig, l_partkey % 11 AS target, CASE WHEN l_linenumber % 2 = 0 THEN 'aa' ELSE 'nt' END AS target_type, 60 + l_discount * 400 AS pident, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS q_low, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS BIGINT) AS q_high FROM lineitem)"


@query(f"WITH {_HITS} SELECT contig, target_type, count(*) AS n FROM h WHERE pident >= CASE WHEN target_type = 'aa' THEN 70 ELSE 80 END GROUP BY 1, 2")
def identity_filter(spark, sf):
    return intervals.identity_filter(_hits(spark, sf)).groupBy("contig", "target_type").agg(F.count("*").alias("n"))


@query(f"""WITH {_HITS}, b AS (SELECT contig, count(DISTINCT x) AS n FROM (SELECT contig, unnest(range(q_low, q_high + 1)) AS x FROM h) GROUP BY 1)
SELECT h.contig, CAST(9000 + h.contig AS BIGINT) AS length, any_value(b.n) AS bases_aligned_to_targets, round(100.0 * any_value(b.n) / (9000 + h.contig), 6) AS perc_contig_aligned_to_targets, count(DISTINCT target) AS num_unique_target_hits, count(*) AS num_total_target_hits,
 CAST(h.contig % 3 AS BIGINT) AS num_regions, CASE WHEN h.contig % 2 = 0 THEN 'i' || h.contig || 'a;i' || h.contig || 'b' ELSE 'none' END AS island_ids FROM h JOIN b ON b.contig = h.contig GROUP BY h.contig""")
def contig_summary(spark, sf):
    h = _hits(spark, sf)
    s = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("contig"))
    regions = s.withColumn("_", F.explode(F.when(F.col("contig") % 3 > 0, F.sequence(F.lit(1), (F.col("contig") % 3).cast("int"))).otherwise(F.array().cast("array<int>"))))
    found = s.where("contig % 2 = 0").select("contig", F.explode(F.array(*(F.concat(F.lit("i"), F.col("contig").cast("string"), F.lit(x)) for x in "ab"))).alias("island"))
    x = intervals.contig_summary(h, s.withColumn("length", F.col("contig") + 9000), regions, found)
    return x.withColumn("perc_contig_aligned_to_targets", F.round("perc_contig_aligned_to_targets", 6))


@query(f"""WITH {_HOURLY}, a AS (SELECT *, avg(value) OVER (PARTITION BY contig) AS m, stddev_samp(value) OVER (PARTITION BY contig) AS sd FROM w) SELECT contig, start, value FROM a WHERE (value - m) / sd <= -0.8 OR value = 0""")
def low_windows(spark, sf):
    w = intervals.window_statistics(_hourly(spark, sf), per=["contig"])
    return intervals.extreme_windows(w, "zscore", -0.8, False).select("contig", "start", "value")


@query(f"""WITH {_HOURLY}, a AS (SELECT *, 100.0 * (rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0) / count(*) OVER () AS p FROM w) SELECT contig, start, value FROM a WHERE p >= 90""")
def top_percentile_windows(spark, sf):
    return intervals.extreme_windows(intervals.window_statistics(_hourly(spark, sf)), "percentile", 90.0, True).select("contig", "start", "value")


@query(f"WITH {_SPANS} SELECT contig, s AS start, e AS \"end\" FROM s WHERE s >= 500 AND e <= 2500 - 500")
def windows_inside(spark, sf):
    return intervals.away_from_edges(_spans(spark, sf).withColumn("length", F.lit(2500)), 500).select("contig", "start", "end")


@query(f"WITH {_runs(2)} SELECT contig, s AS start, e AS \"end\" FROM u WHERE e - s >= 10 AND contig NOT IN (1, 3)")
def regions_of_kept_contigs(spark, sf):
    return intervals.window_regions(_spans(spark, sf), gap=2, min_length=10, exclude=[1, 3]).select("contig", "start", "end")


# in hundredths, so that sums are whole numbers and means the same in every engine
_REGIONS = f"""{_HOURLY.replace("w AS (", "w0 AS (", 1)}, w AS (SELECT contig, start, round(value * 100) AS value FROM w0), m AS (SELECT *, max(start + 1) OVER (PARTITION BY contig ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM w),
 r AS (SELECT *, sum(CASE WHEN start > b THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM m),
 u AS (SELECT contig, min(start) AS start, max(start) + 1 AS e, round(avg(value), 4) AS c FROM r GROUP BY contig, g)"""
_SHOWN = """round(c / m, 6) AS fold, round(CASE WHEN c / m = 0 THEN 0 WHEN c / m >= 1 THEN c / m ELSE -1 / (c / m) END, 4) AS signed_fold, round((c - m) / sd, 6) AS zscore, round(log2((c + 1e-6) / (m + 1e-6)), 6) AS log2_fold, e - start AS length"""


def _metrics(spark, sf, per_contig):
    w = _hourly(spark, sf).withColumn("value", F.round(F.col("value") * 100))
    r = intervals.window_regions(w, gap=0).withColumn("coverage", F.round("coverage", 4))
    x = intervals.region_metrics(r, w, per_contig)
    return x.select("contig", "start", "length", F.round("percentile", 6).alias("percentile"), F.round("fold", 6).alias("fold"), F.round("signed_fold", 4).alias("signed_fold"), F.round("zscore", 6).alias("zscore"), F.round("log2_fold", 6).alias("log2_fold"))


@query(f"WITH {_REGIONS}, a AS (SELECT avg(value) AS m, stddev_samp(value) AS sd, count(*) AS n FROM w) SELECT contig, start, {_SHOWN}, round(100.0 * (SELECT count(*) FROM w WHERE w.value <= u.c) / n, 6) AS percentile FROM u, a")
def region_metrics(spark, sf):
    return _metrics(spark, sf, False)


@query(f"WITH {_REGIONS}, a AS (SELECT contig AS k, avg(value) AS m, stddev_samp(value) AS sd, count(*) AS n FROM w GROUP BY 1) SELECT contig, start, {_SHOWN}, round(100.0 * (SELECT count(*) FROM w WHERE w.contig = u.contig AND w.value <= u.c) / n, 6) AS percentile FROM u JOIN a ON k = contig")
def region_metrics_per_contig(spark, sf):
    return _metrics(spark, sf, True)


@query("SELECT 'x_island_' || (1 + doc_id % 5) || '-' || (30 + doc_id % 5) || CAST(doc_id AS VARCHAR) AS island, doc_id AS contig, substr(text, CAST(1 + doc_id % 5 AS BIGINT), 30) AS seq FROM documents")
def island_sequences(spark, sf):
    d = t(spark, sf, "documents")
    start = 1 + F.col("doc_id") % 5
    found = d.select(F.col("doc_id").alias("contig"), start.alias("start"), (start + 29).alias("end"))
    found = found.withColumn("island", F.concat(F.lit("x_island_"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.col("contig").cast("string")))
    return intervals.island_sequences(found, d.select(F.col("doc_id").alias("id"), F.col("text").alias("seq")))


@query(f"""WITH {_runs(30)}, i AS (SELECT contig, s AS a, e AS b, contig || '_island_' || greatest(s - 10, 1) || '-' || least(e + 10, 9000) AS island FROM u WHERE e - s + 1 >= 50 AND n >= 3 AND 9000 >= 2.0 * (e - s + 1))
SELECT s.contig, s.s AS start, i.island, count(*) AS n FROM s LEFT JOIN i ON i.contig = s.contig AND s.s >= a AND s.e <= b GROUP BY 1, 2, 3""")
def regions_with_islands(spark, sf):
    s = _spans(spark, sf)
    c = s.select("contig").distinct().withColumn("length", F.lit(9000).cast("long"))
    found = intervals.named_islands(intervals.islands(s, c, gap=30, buffer=10, min_contig=5000, times=2.0, min_span=50))
    return intervals.region_islands(s, found).groupBy("contig", "start", "island").agg(F.count("*").alias("n"))


@query(f"WITH {_runs(0)}, d AS (SELECT contig, sum(e - s) AS c, count(*) AS n FROM u GROUP BY 1) SELECT s_suppkey AS contig, CAST(coalesce(c, 0) AS BIGINT) AS covered, coalesce(n, 0) AS intervals, coalesce(c, 0) >= 0.5 * 4000 AS done FROM supplier LEFT JOIN d ON contig = s_suppkey")
def detection_state(spark, sf):
    c = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("contig"), F.lit(4000).cast("long").alias("length"))
    return intervals.detection_state(_spans(spark, sf), c, 0.5).select("contig", "covered", "intervals", "done")


@query("""WITH p AS (SELECT l_suppkey AS contig, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) % 2000 AS BIGINT) AS s, CAST(l_quantity AS BIGINT) % 4 AS q FROM lineitem),
 c AS (SELECT contig, s, least(s + q, 2000) AS e FROM p UNION ALL SELECT contig, 0, s + q - 2000 FROM p WHERE s + q > 2000), x AS (SELECT DISTINCT contig, unnest(range(s, e)) AS b FROM c), g AS (SELECT contig, b, b - row_number() OVER (PARTITION BY contig ORDER BY b) AS g FROM x),
 r AS (SELECT contig, min(b) AS s, max(b) + 1 AS e, count(*) OVER (PARTITION BY contig) AS n FROM g GROUP BY contig, g.g), f AS (SELECT *, n > 1 AND min(s) OVER w = 0 AND max(e) OVER w = 2000 AS wraps, max(CASE WHEN s = 0 THEN e END) OVER w AS first FROM r WINDOW w AS (PARTITION BY contig))
SELECT contig, s AS start, CASE WHEN wraps AND e = 2000 THEN 2000 + first ELSE e END AS "end" FROM f WHERE NOT (wraps AND s = 0)""")
def covered_contigs(spark, sf):
    s = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("contig"), (F.datediff("l_shipdate", F.lit("1992-01-01")) % 2000).cast("long").alias("start"), F.col("l_quantity").cast("long").alias("q"))
    s = s.select("contig", "start", (F.col("start") + F.col("q") % 4).alias("end")).where("end > start")
    c = s.select("contig").distinct().withColumn("length", F.lit(2000).cast("long"))
    return intervals.covered_contigs(s, c, circular=True).select("contig", "start", "end")


_EDGE = f"""{_SPANS}, h AS (SELECT contig, CAST(floor(v) AS BIGINT) % 29 AS target, s + 1 AS a, e AS b FROM s WHERE e > s), m AS (SELECT *, max(b) OVER (PARTITION BY contig, target ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM h),
 r AS (SELECT *, sum(CASE WHEN a > p + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY contig, target ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM m),
 x AS (SELECT contig, target, g, min(a) AS q_low, max(b) AS q_high, 100.0 * count(DISTINCT y) / 50 AS cov FROM (SELECT *, unnest(range(1, b - a + 2)) AS y FROM r) GROUP BY 1, 2, 3)"""


@query(f"WITH {_EDGE} SELECT contig, target, q_low, q_high, round(cov, 6) AS perc_target_cov FROM x WHERE cov >= 80 OR (cov >= 30 AND (q_low <= 400 OR q_high > 3000 - 400))")
def loci_at_edges(spark, sf):
    """Loci that pass only because they lie near an end of their contig, and others that fail for they don't."""
    s = _spans(spark, sf).where("end > start").withColumn("a", F.col("start") + 1)
    h = s.select("contig", (F.floor("value").cast("long") % 29).alias("target"), F.lit(3000).cast("long").alias("clen"), F.lit(50).cast("long").alias("slen"), F.col("a").alias("q_start"), F.col("end").alias("q_end"), F.lit(1).cast("long").alias("s_start"), (F.col("end") - F.col("a") + 1).alias("s_end"), F.lit(90.0).alias("pident"), F.col("value").alias("bitscore"))
    x = intervals.loci(h, gap=5, min_coverage=80.0, edge_coverage=30.0, edge=400)
    return x.select("contig", "target", "q_low", "q_high", F.round("perc_target_cov", 6).alias("perc_target_cov"))


@query(f"WITH {_EDGE} SELECT CASE WHEN contig % 2 = 0 THEN 'even' ELSE 'odd' END AS assembly, CAST(contig AS VARCHAR) AS contig, target, q_low FROM x WHERE cov >= 80")
def screen_of_assemblies(spark, sf):
    s = _spans(spark, sf).where("end > start").withColumn("a", F.col("start") + 1)
    h = s.select("contig", (F.floor("value").cast("long") % 29).alias("target"), F.lit(3000).cast("long").alias("clen"), F.lit(50).cast("long").alias("slen"), F.col("a").alias("q_start"), F.col("end").alias("q_end"), F.lit(1).cast("long").alias("s_start"), (F.col("end") - F.col("a") + 1).alias("s_end"), F.lit(90.0).alias("pident"), F.col("value").alias("bitscore"))
    x = intervals.screen_assemblies([("even", h.where("contig % 2 = 0")), ("odd", h.where("contig % 2 = 1"))], gap=5, edge_coverage=80.0)
    return x.select("assembly", "contig", "target", "q_low")


@query("SELECT doc_id AS contig, CAST(length(text) AS BIGINT) AS length FROM documents")
def contig_lengths(spark, sf):
    return intervals.contig_lengths(t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seq")))


# --- statistics -----------------------------------------------------------------------------------------


_P = ", ".join(f"round(quantile_cont(value, {p}), 6) AS {stats.percent_name(p)}" for p in stats.WIDE_PERCENTS)


@query(f"SELECT event_type, CAST(grouping(event_type) AS INTEGER) AS is_total, count(value) AS n, round(median(value), 6) AS median, {_P} FROM events GROUP BY GROUPING SETS ((), (event_type))")
def overview_of_percentiles(spark, sf):
    x = stats.overview(t(spark, sf, "events"), "value", "event_type", stats.WIDE_PERCENTS)
    return x.select("event_type", "is_total", "n", *(F.round(c, 6).alias(c) for c in ("median", *map(stats.percent_name, stats.WIDE_PERCENTS))))


@query("""SELECT l_suppkey, count(*) AS n_reads, round(avg(l_quantity), 6) AS mean_aligned, round(avg(l_linenumber), 6) AS mean_soft, round(avg(l_partkey % 3), 6) AS mean_hard, round(avg(l_linenumber + l_partkey % 3), 6) AS mean_clipped, round(avg((l_linenumber + l_partkey % 3) / (l_quantity + 9)), 6) AS mean_clipped_fraction, round(avg(l_quantity + 9), 6) AS mean_length, round(stddev_pop(l_quantity + 9), 6) AS sd_length FROM lineitem GROUP BY 1""")
def clip_statistics(spark, sf):
    x = t(spark, sf, "lineitem").select("l_suppkey", F.col("l_quantity").alias("query_aligned"), F.col("l_linenumber").alias("soft_clipped"), (F.col("l_partkey") % 3).alias("hard_clipped"), (F.col("l_quantity") + 9).alias("full_length"))
    s = stats.clip_statistics(x, ["l_suppkey"])
    return s.select("l_suppkey", "n_reads", *(F.round(c, 6).alias(c) for c in s.columns[2:]))


@query("SELECT source, count(*) AS n, min(n_chars) AS min, max(n_chars) AS max, round(avg(n_chars), 6) AS mean, median(n_chars) AS median, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY 1")
def length_statistics(spark, sf):
    x = stats.length_statistics(t(spark, sf, "documents"), "n_chars", ["source"])
    return x.withColumn("mean", F.round("mean", 6))


@query("""WITH d AS (SELECT source AS assembly, length(text) AS l, length(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS a, length(regexp_replace(text, '[^GCgc]', '', 'g')) AS g FROM documents)
SELECT assembly, count(*) AS contigs, CAST(sum(l) AS BIGINT) AS total_length, CAST(sum(l - a) AS BIGINT) AS ambiguous, round(100.0 * sum(g) / sum(a), 2) AS gc_content, count(*) FILTER (l >= 5000) AS contigs_5000 FROM d GROUP BY 1 UNION ALL SELECT 'empty', NULL, NULL, NULL, NULL, NULL""")
def assembly_table(spark, sf):
    d = t(spark, sf, "documents").select(F.col("source").alias("assembly"), F.col("text").alias("seq"))
    names = d.select("assembly").union(spark.createDataFrame([("empty",)], "assembly string"))
    return stats.assembly_table(d, names).select("assembly", "contigs", "total_length", "ambiguous", "gc_content", "contigs_5000")


@query("SELECT 'n' AS measure, CAST(count(*) FILTER (lang = 'en') AS VARCHAR) AS en, CAST(count(*) FILTER (lang = 'fr') AS VARCHAR) AS fr, 'NA' AS xx FROM documents UNION ALL SELECT 'longest', CAST(max(n_chars) FILTER (lang = 'en') AS VARCHAR), CAST(max(n_chars) FILTER (lang = 'fr') AS VARCHAR), 'NA' FROM documents")
def transposed_table(spark, sf):
    x = t(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))
    return stats.transposed(x, "lang", ["en", "fr", "xx"])


@query(f"WITH {_MATRIX} SELECT feature, CAST(sample AS INTEGER) AS sample, value FROM m WHERE sample <> 1995")
def samples_without_zeros(spark, sf):
    m = _matrix(spark, sf).withColumn("value", F.when(F.col("sample") == 1995, 0.0).otherwise(F.col("value")))
    return stats.drop_zero_samples(m)[0].select("feature", "sample", "value")


@query("""WITH x AS (SELECT p_partkey, p_retailprice / sum(p_retailprice) OVER () * 50000 AS x FROM part), f AS (SELECT p_partkey, floor(x) AS f, floor(x) - x AS d FROM x)
SELECT p_partkey, CAST(2 * (f + CASE WHEN row_number() OVER (ORDER BY d, p_partkey) <= 50000 - sum(f) OVER () THEN 1 ELSE 0 END) AS BIGINT) AS units FROM f""")
def apportion_pairs(spark, sf):
    return stats.apportion(t(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", ["p_partkey"], 100_000, even=True).select("p_partkey", "units")


_SHARE = "round_even(1000 * sum(l_quantity) OVER w / sum(l_quantity) OVER (PARTITION BY l_orderkey), 0)"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, {_SHARE} AS c FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey, l_linenumber, l_partkey, CAST(c - coalesce(lag(c) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity), 0) AS BIGINT) AS share FROM x""")
def contig_split_shares(spark, sf):
    x = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit(1000).alias("total"), F.col("l_quantity").alias("length"))
    return stats.split_by_length(x, "total", "length", ["l_linenumber", "l_partkey", "length"], ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "share")


@query("""WITH c AS (SELECT s_suppkey AS contig, n_name AS ref, CAST(40000 AS BIGINT) AS length FROM supplier JOIN nation ON n_nationkey = s_nationkey), d AS (SELECT ref, l_linenumber AS depth, CAST(l_quantity AS BIGINT) AS n, 100 - l_discount * 100 AS pid FROM lineitem JOIN c ON contig = l_suppkey)
SELECT ref, CAST(sum(length) AS BIGINT) AS length, count(*) AS num_contigs, any_value(round(x.b / l.length, 6)) AS detection, any_value(round(x.s / l.length, 6)) AS mean_depth, any_value(x.k) AS num_mapped_reads, any_value(round(x.p, 6)) AS mean_pid
FROM c JOIN (SELECT ref, sum(length) AS length FROM c GROUP BY 1) l USING (ref) JOIN (SELECT ref, sum(n) AS b, sum(depth * n) AS s, count(*) AS k, avg(pid) AS p FROM d GROUP BY 1) x USING (ref) GROUP BY ref""".replace("sum(length) AS length, count(*) AS num", "sum(c.length) AS length, count(*) AS num").replace("CAST(sum(length)", "CAST(sum(c.length)"))
def reference_table(spark, sf):
    c = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("contig"), F.col("n_name").alias("ref"), F.lit(40000).cast("long").alias("length"))
    x = t(spark, sf, "lineitem")
    d = x.select(F.col("l_suppkey").alias("contig"), F.lit(0).cast("long").alias("start"), F.col("l_quantity").cast("long").alias("end"), F.col("l_linenumber").alias("depth"))
    r = x.select(F.col("l_suppkey").alias("contig"), (100 - F.col("l_discount") * 100).alias("pid"))
    out = stats.reference_table(d, c, r)[0]
    return out.select("ref", "length", "num_contigs", F.round("detection", 6).alias("detection"), F.round("mean_depth", 6).alias("mean_depth"), "num_mapped_reads", F.round("mean_pid", 6).alias("mean_pid"))


# --- reports --------------------------------------------------------------------------------------------


def _report(spark, sf):
    c = t(spark, sf, "conversations")
    turn = F.col("turn")
    rank = F.when(turn == 0, "U").when(turn == 1, "R").when(turn == 2, "D").when(turn == 3, "P").when(turn == 4, "C1").otherwise("G")
    name = F.when(turn == 2, F.when(F.col("conv_id") % 2 == 0, "Bacteria").otherwise("Archaea")).otherwise(F.concat(F.lit("t"), turn.cast("string")))
    return c.groupBy("conv_id", "turn").agg(F.max(F.length("text")).alias("n")).select("conv_id", turn.alias("ordinal"), rank.alias("rank"), F.when(turn == 0, "0").otherwise(turn.cast("string")).alias("taxid"), name.alias("name"), F.col("n").cast("long").alias("reads"), (F.col("n") * 2).cast("long").alias("clade_reads"), (F.col("n") / 10).alias("percent"))


_REPORT = """r AS (SELECT conv_id, turn, CASE turn WHEN 0 THEN 'U' WHEN 1 THEN 'R' WHEN 2 THEN 'D' WHEN 3 THEN 'P' WHEN 4 THEN 'C1' ELSE 'G' END AS rank, CASE turn WHEN 2 THEN CASE WHEN conv_id % 2 = 0 THEN 'Bacteria' ELSE 'Archaea' END ELSE 't' || turn END AS name, CAST(max(length(text)) AS BIGINT) AS n FROM conversations GROUP BY 1, 2)"""


@query(f"""WITH {_REPORT}, s AS (SELECT conv_id, coalesce(sum(n) FILTER (rank = 'U'), 0) AS u, coalesce(sum(n) FILTER (rank = 'R'), 0) AS root FROM r GROUP BY 1)
SELECT conv_id, CAST(2 * u + 2 * root AS BIGINT) AS total_reads, round(100.0 * 2 * u / nullif(2 * u + 2 * root, 0), 9) AS percent_unclassified, round(100.0 * root / nullif(2 * u + 2 * root, 0), 9) AS percent_at_root FROM s""")
def report_totals(spark, sf):
    x = reports.report_totals(_report(spark, sf), ["conv_id"])
    return x.select("conv_id", "total_reads", F.round("percent_unclassified", 9).alias("percent_unclassified"), F.round("percent_at_root", 9).alias("percent_at_root"))


@query(f"""WITH {_REPORT}, f AS (SELECT *, max(CASE WHEN rank = 'D' THEN name END) OVER w AS d, max(CASE WHEN rank = 'P' THEN name END) OVER w AS p, max(CASE WHEN rank = 'G' THEN turn END) OVER w AS g FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, CASE WHEN rank = 'U' THEN '0' ELSE CAST(turn AS VARCHAR) END AS taxid, CASE WHEN rank = 'U' THEN 'Unclassified' ELSE d END AS domain, CASE WHEN rank = 'U' THEN NULL ELSE p END AS phylum, CASE WHEN g IS NULL THEN NULL ELSE 't' || g END AS genus, n AS reads, round(100.0 * n / sum(n) OVER (PARTITION BY conv_id), 9) AS percent FROM f WHERE n > 0""")
def classifier_summary(spark, sf):
    x = reports.classifier_summary(_report(spark, sf), ["conv_id"])
    return x.select("conv_id", "taxid", "domain", "phylum", "genus", "reads", F.round("percent", 9).alias("percent"))


@query(f"WITH {_REPORT} SELECT conv_id, turn AS ordinal, CASE WHEN rank = 'D' THEN name ELSE '(' || CASE WHEN turn < 2 THEN '?' WHEN NOT EXISTS (SELECT 1 FROM r q WHERE q.conv_id = r.conv_id AND q.rank = 'D') THEN '?' WHEN conv_id % 2 = 0 THEN 'B' ELSE 'A' END || ') ' || name END AS name FROM r")
def domain_letters(spark, sf):
    return reports.domain_letters(_report(spark, sf), ["conv_id"]).select("conv_id", "ordinal", "name")


@query(f"WITH {_REPORT} SELECT conv_id, turn AS ordinal FROM r WHERE rank IN ('U', 'R', 'D', 'P', 'G')")
def standard_ranks(spark, sf):
    return reports.standard_ranks(_report(spark, sf)).select("conv_id", "ordinal")


@query(f"""WITH {_REPORT}, s AS (SELECT conv_id, name, sum(n / 10) AS percent FROM r WHERE rank = 'G' GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY percent DESC, name) AS i FROM s)
SELECT conv_id, CASE WHEN i <= 1 THEN name ELSE 'Other' END AS name, round(sum(percent), 6) AS percent FROM k GROUP BY 1, 2""")
def taxonomy_bars(spark, sf):
    return reports.taxonomy_bars(_report(spark, sf), "G", ["conv_id"], n=1).select("conv_id", "name", F.round("percent", 6).alias("percent"))


@query("SELECT p_brand AS term, p_type AS namespace, (SELECT count(*) FROM lineitem JOIN part q ON q.p_partkey = l_partkey WHERE q.p_brand || q.p_type = x.p_brand || x.p_type AND l_quantity > 49) AS term_counts FROM (SELECT DISTINCT p_brand, p_type FROM part WHERE p_brand <> 'Brand#1') x")
def terms_with_zeros(spark, sf):
    p = t(spark, sf, "part")
    key = F.concat("p_brand", F.lit("|"), "p_type")
    a = t(spark, sf, "lineitem").where("l_quantity > 49").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.array(key).alias("terms"))
    terms = p.select(key.alias("term"), F.col("p_type").alias("namespace"), (F.col("p_brand") == "Brand#1").alias("is_obsolete")).distinct()
    x = reports.term_counts(a, terms, keep_zeros=True)
    return x.select(F.substring_index("term", "|", 1).alias("term"), "namespace", "term_counts")


@query("SELECT DISTINCT p_brand AS term FROM part WHERE p_brand LIKE 'Brand#1%'")
def terms_unknown(spark, sf):
    p = t(spark, sf, "part")
    return reports.unknown_terms(p.select(F.array("p_brand").alias("terms")), p.where("p_brand not like 'Brand#1%'").select(F.col("p_brand").alias("term")).distinct())


@query("""WITH h AS (SELECT l_orderkey AS gene, l_partkey AS ko, l_discount AS e, l_linenumber AS o, l_quantity AS score, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 30.0 END AS th FROM lineitem), b AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY e, o, ko) AS n FROM h WHERE th IS NULL OR score > th)
SELECT g.gene, CAST(b.e AS DOUBLE) AS evalue_of_best, b.o AS ordinal_of_best FROM (SELECT DISTINCT gene FROM h) g LEFT JOIN b ON b.gene = g.gene AND n = 1""")
def threshold_annotations(spark, sf):
    h = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("gene"), F.struct("l_discount", "l_linenumber").alias("ko"), F.lit("f").alias("function"), F.col("l_discount").alias("evalue"), F.struct("l_linenumber", "l_partkey").alias("ordinal"), F.col("l_quantity").alias("score"), F.when(F.col("l_suppkey") % 3 != 0, 30.0).alias("threshold"))
    x = reports.best_annotations(h)
    return x.select("gene", F.col("ko.l_discount").alias("evalue_of_best"), F.col("ko.l_linenumber").alias("ordinal_of_best"))


@query("SELECT event_type AS target, user_id AS assembly, count(*) FILTER (value > 30) AS n FROM events WHERE event_type IN (SELECT event_type FROM events WHERE value > 30) GROUP BY 1, 2")
def targets_found(spark, sf):
    x = t(spark, sf, "events").groupBy(F.col("event_type").alias("target"), F.col("user_id").alias("assembly")).agg(F.count_if(F.col("value") > 30).alias("n"))
    return reports.found_targets(x).select("target", "assembly", "n")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 100 / 100.0 <= 0.5 THEN 0.0 ELSE o_totalprice END AS coverage FROM orders")
def gated_coverage(spark, sf):
    x = t(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("coverage"), (F.col("o_orderkey") % 100 / 100.0).alias("detected"))
    return reports.coverage_with_gate(x, "coverage", "detected", 0.5).select("o_orderkey", "coverage")


@query("SELECT 's' || (p_size % 3) || '-MAG-' || p_partkey AS bin FROM part WHERE p_size >= 20 AND p_partkey % 10 <= 5")
def good_bins(spark, sf):
    x = t(spark, sf, "part").select(F.concat(F.lit("s"), (F.col("p_size") % 3).cast("string"), F.lit("-bin."), F.col("p_partkey").cast("string")).alias("bin"), F.col("p_size").alias("completeness"), (F.col("p_partkey") % 10).alias("redundancy"))
    return reports.good_bins(x, 20, 5).select("bin")


@query("SELECT 'c' || l_suppkey || '_' || l_linenumber AS gene, n_name AS bin, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_partkey % 4 > 0 GROUP BY 1, 2")
def bin_annotations(spark, sf):
    c = F.concat(F.lit("c"), F.col("l_suppkey").cast("string"))
    g = t(spark, sf, "lineitem").select(F.concat(c, F.lit("_"), F.col("l_linenumber").cast("string")).alias("gene"), F.when(F.col("l_partkey") % 4 > 0, F.col("l_partkey")).alias("ko"))
    bins = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("contig"), F.col("n_name").alias("bin"))
    return reports.bin_annotations(g, bins).groupBy("gene", "bin").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT o_custkey AS sample, count(*) AS raw FROM orders GROUP BY 1), b AS (SELECT o_custkey AS sample, count(*) AS kept FROM orders WHERE o_totalprice > 200000 GROUP BY 1) SELECT a.sample, raw, kept, round(100.0 * kept / raw, 6) AS percent_retained FROM a LEFT JOIN b ON b.sample = a.sample""")
def reads_retained(spark, sf):
    o = t(spark, sf, "orders")
    one, two = (x.groupBy(F.col("o_custkey").alias("sample")).agg(F.count("*").alias("reads")) for x in (o, o.where("o_totalprice > 200000")))
    return reports.retained([("raw", one), ("kept", two)]).withColumn("percent_retained", F.round("percent_retained", 6))


@query("SELECT c_custkey AS sample, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'Yes' ELSE 'No' END AS assembled, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) THEN 'Yes' ELSE 'No' END AS binned FROM customer")
def stage_flags(spark, sf):
    o = t(spark, sf, "orders").withColumnRenamed("o_custkey", "sample")
    return reports.stage_flags(t(spark, sf, "customer").select(F.col("c_custkey").alias("sample")), {"assembled": o.where("o_orderstatus = 'F'"), "binned": o.where("o_totalprice > 450000")})


@query(f"WITH {_LINEAGE}, y AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN NULL ELSE phylum END AS taxid, c_acctbal FROM x) SELECT taxid, round(sum(c_acctbal), 2) AS coverage FROM y GROUP BY 1")
def taxid_coverage(spark, sf):
    """Every fifth row has no taxid and every third one no lineage: both are in the null group."""
    x = _lineage(spark, sf)
    bare = F.col("c_custkey") % 3 == 0
    x = x.select(F.when(F.col("c_custkey") % 5 == 0, "NA").otherwise(F.col("phylum")).alias("taxid"), F.col("c_acctbal").alias("coverage"), *(F.when(~bare, F.col(c)).otherwise("NA").alias(c) for c in ("domain", "phylum")))
    return reports.taxid_coverage(x, ranks=("domain", "phylum")).withColumn("coverage", F.round("coverage", 2))


@query("SELECT CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_brand END AS ko, round(sum(l_quantity), 2) AS coverage FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def function_coverage(spark, sf):
    x = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = x.select(F.when(F.col("p_size") % 6 != 0, F.col("p_brand")).alias("ko"), F.col("l_quantity").alias("coverage"))
    return reports.function_coverage(g).withColumn("coverage", F.round("coverage", 2))


@query("""WITH s AS (SELECT CASE WHEN p_size % 6 = 0 THEN 'Not annotated' ELSE p_brand END AS ko, round(sum(l_quantity), 2) AS coverage FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), f AS (SELECT p_brand, min(p_type) AS f FROM part WHERE p_size < 3 GROUP BY 1)
SELECT ko, coalesce(f, 'NA') AS function, coverage FROM s LEFT JOIN f ON p_brand = ko""")
def enriched_functions(spark, sf):
    facts = t(spark, sf, "part").where("p_size < 3").select(F.col("p_brand").alias("ko"), F.col("p_type").alias("function"))
    return reports.enriched(function_coverage(spark, sf), "ko", facts, ["function"], "NA", "Not annotated")


_CONTIGS = """s AS (SELECT l_returnflag AS sample, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE n_name END AS taxid, l_quantity AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"""


@query(f"""WITH {_CONTIGS}, k AS (SELECT taxid, sample, sum(v) AS v FROM s GROUP BY 1, 2), n AS (SELECT taxid, sample, v / sum(v) OVER (PARTITION BY sample) * 1e6 AS v FROM k)
SELECT coalesce(taxid, 'Not classified') AS taxid, CASE WHEN taxid IS NULL THEN 'NA' ELSE taxid || '_p' END AS phylum, round(coalesce(sum(v) FILTER (sample = 'A'), 0), 4) AS a, round(coalesce(sum(v) FILTER (sample = 'N'), 0), 4) AS n FROM n GROUP BY taxid""")
def contig_taxonomy(spark, sf):
    x = t(spark, sf, "lineitem").join(t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    named = F.col("l_suppkey") % 5 > 0
    x = x.select("l_returnflag", F.when(named, F.col("n_name")).alias("taxid"), F.col("l_quantity").alias("coverage"), *(F.when(named, F.concat("n_name", F.lit("_p"))).alias(r) if r == "phylum" else F.lit("NA").alias(r) for r in reports.RANKS))
    out = reports.contig_taxonomy([(k.lower(), x.where(F.col("l_returnflag") == k)) for k in "AN"], "cpm")
    return out.select("taxid", "phylum", F.round("a", 4).alias("a"), F.round("n", 4).alias("n"))


@query("SELECT s_suppkey AS contig, s_acctbal AS coverage, n_name AS function, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS taxid FROM supplier LEFT JOIN nation ON n_nationkey = s_suppkey")
def keyed_tables(spark, sf):
    s = t(spark, sf, "supplier")
    cov = s.select(F.col("s_suppkey").alias("contig"), F.col("s_acctbal").alias("coverage"))
    ann = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("contig"), F.col("n_name").alias("function"))
    return reports.keyed_tables(cov, [ann, s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("contig"), F.col("s_nationkey").alias("taxid"))], "contig")


@query("SELECT n_nationkey AS ASV_ID, n_name AS phylum, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey % 2 = 0 GROUP BY 1, 2")
def marker_table(spark, sf):
    tax = t(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("ASV_ID"), F.col("n_name").alias("phylum"))
    return reports.marker_table(tax, t(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("ASV_ID")).agg(F.count("*").alias("n")))


@query("SELECT s_suppkey AS genome, s_acctbal AS size, CASE WHEN s_suppkey % 3 = 0 THEN 'NA' ELSE n_name END AS phylum, s_nationkey AS quality FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def genome_table(spark, sf):
    s = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    lin = s.select(F.col("s_suppkey").alias("genome"), *(F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise(F.col("n_name")).alias(r) if r == "phylum" else F.lit(None).cast("string").alias(r) for r in reports.RANKS))
    x = reports.genome_overview(s.select(F.col("s_suppkey").alias("genome"), F.col("s_acctbal").alias("size")), s.select(F.col("s_suppkey").alias("genome"), F.col("s_nationkey").alias("quality")), lin, missing="NA")
    return reports.by_lineage(x, "genome").select("genome", "size", "phylum", "quality")


@query(f"WITH {_LINEAGE} SELECT coalesce(class, 'none') AS taxon, round(sum(c_acctbal), 2) AS abundance FROM x GROUP BY 1 ORDER BY 2 DESC, 1")
def abundance_order(spark, sf):
    x = _lineage(spark, sf).groupBy(F.coalesce(columns.assigned("class"), F.lit("none")).alias("taxon")).agg(F.round(F.sum("c_acctbal"), 2).alias("abundance"))
    return reports.in_order(x, "abundance")


@query("SELECT o_custkey AS id, o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS found FROM (SELECT DISTINCT o_custkey FROM orders)")
def headers_found(spark, sf):
    w = t(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return reports.header_report(w, t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id")))


@query("SELECT 'GCA_' || (o_orderkey * 2) || '.1' AS wanted, CASE WHEN o_orderkey * 2 IN (SELECT o_orderkey FROM orders) THEN 'found' ELSE 'not found' END AS status FROM orders")
def wanted_report(spark, sf):
    from ..operators import catalog

    o = t(spark, sf, "orders")
    w = o.select(F.concat(F.lit("GCA_"), (F.col("o_orderkey") * 2).cast("string"), F.lit(".1")).alias("accession"))
    return reports.accession_report(*catalog.wanted_lookup(w, o.select(F.concat(F.lit("GCA_"), F.col("o_orderkey").cast("string"), F.lit(".2")).alias("acc")), "acc"))


@query("""WITH a AS (SELECT p_brand AS k, min(p_type) AS m, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' AND p_size < 5 GROUP BY 1), b AS (SELECT p_brand AS k, max(p_type) AS m, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 45 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN b.m ELSE a.m END AS m, coalesce(a.v, 0) AS s1, coalesce(b.v, 0) AS s2 FROM a FULL JOIN b ON a.k = b.k""")
def combine_samples_with_meta(spark, sf):
    x = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    one = x.where("l_returnflag = 'A' and p_size < 5").groupBy(F.col("p_brand").alias("k")).agg(F.min("p_type").alias("m"), F.sum("l_quantity").alias("v"))
    two = x.where("p_size > 45").groupBy(F.col("p_brand").alias("k")).agg(F.max("p_type").alias("m"), F.sum("l_quantity").alias("v"))
    return reports.combine_samples([("s1", one), ("s2", two)], "k", "v", ["m"])


# --- sequences and alignments -----------------------------------------------------------------------------


@query("SELECT doc_id, 'pre_' || source || '_x' AS id FROM documents WHERE length(text) BETWEEN 300 AND 900")
def renamed_records(spark, sf):
    d = sequences.filter_length(t(spark, sf, "documents"), 300, 900, "text")
    return sequences.rename(d.select("doc_id", F.col("source").alias("id")), "pre_", "_x")


@query("SELECT doc_id AS contig, CAST(0 AS BIGINT) AS start, CAST(length(text) - 1 AS BIGINT) AS \"end\" FROM documents")
def records_to_bed(spark, sf):
    return sequences.to_bed(t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seq")))


@query("SELECT doc_id AS contig, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 20) || '<INS><INS>' || substr(text, 21, 30) || '<INS>' || substr(text, 51) ELSE text END AS seq FROM documents")
def inserted_pieces(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("contig"), F.col("text").alias("seq"))
    places = d.where("contig % 3 = 0").select("contig", F.explode(F.array(F.lit(50), F.lit(20), F.lit(20))).alias("position"))
    return sequences.insert_pieces(d, places, "<INS>")


@query("SELECT CAST(5 AS BIGINT) AS n, CAST(5 AS BIGINT) AS numbers, TRUE AS inside, CAST(1 AS BIGINT) AS fixed")
def insertion_places(spark, sf):
    """Random places can't be foretold: their number, that they lie inside, and that the first is the one asked for."""
    c = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("contig"), F.length("text").cast("long").alias("length"))
    first = c.where("length >= 4").agg(F.min("contig")).first()[0]
    p = sequences.insertion_places(c, 5, 11, f"{first}:4").join(c, "contig")
    return p.agg(F.count("*").alias("n"), F.count_distinct("number").alias("numbers"), F.min((F.col("position") >= 0) & (F.col("position") <= F.col("length"))).alias("inside"), F.count_if((F.col("number") == 1) & (F.col("contig") == first) & (F.col("position") == 4)).alias("fixed"))


@query("""SELECT 'c' || l_suppkey AS contig, 'r' || l_orderkey || '/1' AS "read_ID", CAST(CAST(l_quantity AS BIGINT) + 5 + 3 AS BIGINT) AS read_length, CAST(l_quantity AS BIGINT) + 3 AS read_aligned_bases, l_partkey + 1 AS ref_start, l_partkey + CAST(l_quantity AS BIGINT) + l_linenumber AS ref_end, CAST(5 AS BIGINT) AS soft_clipped, CAST(0 AS BIGINT) AS hard_clipped,
 printf('%.2f', 500.0 / (CAST(l_quantity AS BIGINT) + 8)) AS clipped_percent FROM lineitem""")
def read_summary(spark, sf):
    c = F.col
    q = c("l_quantity").cast("long").cast("string")
    x = t(spark, sf, "lineitem").select(F.concat(F.lit("c"), c("l_suppkey").cast("string")).alias("reference_name"), F.concat(F.lit("r"), c("l_orderkey").cast("string")).alias("query_name"), F.lit(0x41).alias("flag"), c("l_partkey").alias("reference_start"), F.concat(F.lit("5S"), q, F.lit("M3I"), c("l_linenumber").cast("string"), F.lit("D")).alias("cigar"), F.lit(0).alias("nm"))
    return writers.read_summary(x).drop("percent_identity_gap_aware", "percent_identity_gap_compressed")


_MSA = """d AS (SELECT translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS s FROM benchmark), p AS (SELECT i AS position, substr(s, CAST(i + 1 AS BIGINT), 1) AS c FROM (SELECT s, unnest(range(0, length(s))) AS i FROM d)),
 f AS (SELECT position, CASE WHEN c IN ('A', 'E', 'I', 'N', 'O', 'T', 'H', 'R', 'S') THEN c ELSE '-' END AS c, count(*) AS n FROM p GROUP BY 1, 2)"""


def _msa(spark, sf, gaps):
    x = sequences.msa_columns(t(spark, sf, "benchmark").select(F.col("text").alias("seq")), "AEINOTHRS", gaps=gaps)
    return x.select("position", "depth", F.round("gap_fraction", 9).alias("gap_fraction"), F.round("conservation", 9).alias("conservation"))


@query(f"WITH {_MSA} SELECT CAST(position AS INTEGER) AS position, CAST(sum(n) AS BIGINT) AS depth, round(coalesce(sum(n) FILTER (c = '-'), 0) / sum(n), 9) AS gap_fraction, round(1 - (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(10), 9) AS conservation FROM f GROUP BY position")
def msa_with_gap_letter(spark, sf):
    return _msa(spark, sf, "include")


@query(f"WITH {_MSA} SELECT CAST(position AS INTEGER) AS position, CAST(sum(n) AS BIGINT) AS depth, round(coalesce(sum(n) FILTER (c = '-'), 0) / sum(n), 9) AS gap_fraction, round(CASE WHEN count(*) FILTER (c = '-') = 0 THEN 1 - (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(9) END, 9) AS conservation FROM f GROUP BY position")
def msa_without_gapped_columns(spark, sf):
    return _msa(spark, sf, "nan")


_PROTEIN = "MKWVTFISLLFLFSSAYSRGVFRRDAHKSEVAHRFKDLGEENFKALVLIAFAQYLQQCPFEDHVKLVNEF"


@query(f"""WITH x AS (SELECT s_suppkey, s_suppkey % 20 + 20 AS place, s_suppkey // 20 % 4 AS cut FROM supplier), y AS (SELECT *, substr('{_PROTEIN}', CAST(place AS BIGINT), 1) AS r FROM x)
SELECT s_suppkey AS id, round(100.0 * (70 - cut - CASE WHEN r = 'W' THEN 0 ELSE 1 END) / 70, 6) AS percent_identity, round(100.0 * (70 - cut) / 70, 6) AS percent_covered, CAST(CASE WHEN r = 'W' THEN 0 ELSE 1 END AS BIGINT) AS substitutions, CAST(cut AS BIGINT) AS deleted, CAST(CASE WHEN cut > 0 THEN 1 ELSE 0 END AS BIGINT) AS deletion_runs, CAST(0 AS BIGINT) AS insertions,
 CASE WHEN r = 'W' AND cut = 0 THEN '# No mutations detected' ELSE concat_ws(chr(10), CASE WHEN r <> 'W' THEN r || place || 'W' END, CASE WHEN cut > 2 THEN 'N68del' END, CASE WHEN cut > 1 THEN 'E69del' END, CASE WHEN cut > 0 THEN 'F70del' END) END AS value FROM y""")
def protein_differences(spark, sf):
    """A protein with one residue changed to W and up to three missing at its end, by BLOSUM62."""
    at, cut = (F.col("s_suppkey") % 20 + 20).cast("int"), (F.floor(F.col("s_suppkey") / 20) % 4).cast("int")
    seq = F.lit(_PROTEIN)
    changed = F.concat(F.substring(seq, F.lit(1), at - 1), F.lit("W"), F.substring(seq, at + 1, 70 - at - cut))
    x = t(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), seq.alias("ref"), changed.alias("query"))
    pos = alignment.positions(checkpoint(alignment.align_pairs(x)))  # six branches use it
    s = alignment.hit_statistics(pos).join(alignment.mutations_or_note(pos), "id")
    return s.select(F.col("id").cast("long").alias("id"), F.round("percent_identity", 6).alias("percent_identity"), F.round("percent_covered", 6).alias("percent_covered"), "substitutions", "deleted", "deletion_runs", "insertions", "value")


@query(f"""SELECT CAST(n_nationkey AS BIGINT) AS id, i AS ref_pos, substr('{_PROTEIN}', i, 1) AS ref_aa, CASE WHEN i > 40 THEN i + 2 ELSE i END AS query_pos, 'match' AS change_type, CASE WHEN i = 40 THEN 'WW' END AS inserted_after FROM nation, (SELECT unnest(range(1, 71)) AS i)""")
def protein_positions(spark, sf):
    """Two residues more after the fortieth."""
    changed = F.lit(_PROTEIN[:40] + "WW" + _PROTEIN[40:])
    x = t(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.lit(_PROTEIN).alias("ref"), changed.alias("query"))
    p = alignment.all_positions(alignment.positions(alignment.align_pairs(x)))
    return p.select(F.col("id").cast("long").alias("id"), "ref_pos", "ref_aa", "query_pos", "change_type", "inserted_after")


@query(f"""WITH x AS (SELECT p_partkey AS query, CAST(p_size % 30 + 5 AS BIGINT) AS n, '{_PROTEIN}' AS p FROM part) SELECT query, substr(p, 1, n) || 'VF' || substr(p, n + 3, 4) || 'M' || substr(p, n + 8, 2) AS protein,
 'fs' || (n + 5) || '-1;fs' || (n + 7) || '+2' AS frameshifts, CAST(3 * n + 12 AS INTEGER) AS first_intron, CAST(3 * n + 70 AS INTEGER) AS second_intron FROM x""")
def coding_differences(spark, sf):
    """cs strings with a match, a substitution, a deletion, an insertion, an intron, both frameshifts and a parted codon."""
    n = F.col("p_size") % 30 + 5
    # n matches, gtt for a residue, one residue missing, ttt more, two matches, an intron, a codon of two bases, one match, two bases too many, atg parted by an intron after its first base, two matches
    cs = F.concat(F.lit(":"), n.cast("string"), F.lit("*gttA+D-ttt:2~gt50ag*at"), F.substring(F.lit(_PROTEIN), n + 5, F.lit(1)), F.lit(":1-gc*aG~gt30ag-tg:2"))
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("query"), cs.alias("cs"), F.lit(_PROTEIN).alias("seq"), F.lit(0).alias("qstart"))
    ops = alignment.cs_operations(p)
    x = alignment.translated(ops, p).join(alignment.introns(ops), "query")
    return x.select("query", "protein", "frameshifts", F.col("introns")[0]["offset"].alias("first_intron"), F.col("introns")[1]["offset"].alias("second_intron"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS INTEGER) AS rank FROM lineitem WHERE l_quantity >= 30 AND l_discount * 1000 >= 25""")
def ranked_hits(spark, sf):
    x = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_quantity").alias("percent_identity"), (F.col("l_discount") * 1000).alias("percent_covered"))
    return alignment.rank_hits(x, "l_extendedprice", ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "rank")


# --- trees ------------------------------------------------------------------------------------------------


_ABOVE = "SELECT 'n' || s_nationkey AS ancestor FROM supplier WHERE s_suppkey = 5 UNION SELECT 'r' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 5 UNION SELECT 'root'"


@query(_ABOVE)
def tree_ancestors(spark, sf):
    return ontology.ancestors(_edges(spark, sf), "s5")


@query("SELECT 'n' || n_nationkey AS descendant FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def tree_descendants(spark, sf):
    return ontology.descendants(_edges(spark, sf), "r1")


@query("SELECT 's' || s_suppkey AS gene, CASE WHEN n_nationkey % 2 = 0 THEN 'n' || n_nationkey ELSE 'r' || n_regionkey END AS term FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def slim_terms(spark, sf):
    """The slim holds every second nation and all regions; a region above a nation of the slim is left out."""
    s = t(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("gene"))
    n = t(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("term"))
    r = t(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("term"))
    return ontology.slim(s.withColumn("term", F.col("gene")), _edges(spark, sf), n.union(r))


@query("SELECT 'x' || s_suppkey AS taxid, 's' || s_suppkey AS species, 'strain ' || s_suppkey AS strain FROM supplier UNION ALL SELECT 's' || s_suppkey, 's' || s_suppkey, NULL FROM supplier")
def tree_strains(spark, sf):
    k = F.col("s_suppkey").cast("string")
    s = t(spark, sf, "supplier")
    nodes = s.select(F.concat(F.lit("s"), k).alias("taxid"), F.lit("1").alias("parent"), F.lit("species").alias("rank")).union(s.select(F.concat(F.lit("x"), k), F.concat(F.lit("s"), k), F.lit("no rank")))
    names = s.select(F.concat(F.lit("s"), k).alias("taxid"), F.concat(F.lit("s"), k).alias("name")).union(s.select(F.concat(F.lit("x"), k), F.concat(F.lit("strain "), k)))
    return ontology.lineages(nodes, names, ("species",), strain=True)
