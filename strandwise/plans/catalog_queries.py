"""The library's queries over the driver's tables, by name, and SQL for them.

The tables stand in for the field's own: parts are genomes, brands taxa, suppliers contigs, line items spans and alignment
records, documents sequences, conversations ordered reports.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import alignment, columns
from ..operators import catalog, community, intervals, ontology, reports, sequences, stats
from ..schema import NCBI
from ..shared import checkpoint
from ..streaming import extensions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- catalog selection ----------------------------------------------------------------------------


@query("""SELECT p_brand, p_partkey, p_retailprice FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size >= 25 THEN 0 ELSE 1 END, CASE WHEN p_retailprice IS NULL THEN 1 ELSE 0 END, coalesce(p_retailprice, 0) DESC, p_partkey) AS n
  FROM part) WHERE n = 1""")
def derep_best(spark, sf):
    p = t(spark, sf, "part")
    key = [F.when(F.col("p_size") >= 25, 0).otherwise(1), F.when(F.col("p_retailprice").isNull(), 1).otherwise(0), -F.coalesce("p_retailprice", F.lit(0.0)), F.col("p_partkey")]
    return catalog.best_per_group(p, ["p_brand"], key, ["p_brand", "p_partkey", "p_retailprice"])


@query("SELECT c_mktsegment, c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer) WHERE n = 1")
def derep_first(spark, sf):
    return catalog.first_per_group(t(spark, sf, "customer").select("c_mktsegment", "c_custkey", "c_name"), ["c_mktsegment"], "c_custkey")


def _lineage(spark, sf):
    n, r, c = t(spark, sf, "nation"), t(spark, sf, "region"), t(spark, sf, "customer")
    x = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return x.select(F.col("r_name").alias("domain"), F.col("n_name").alias("phylum"), F.when(F.col("c_custkey") % 7 == 0, "NA").when(F.col("c_custkey") % 11 == 0, "").otherwise(F.col("c_mktsegment")).alias("class"), "c_custkey", "c_acctbal")


_LINEAGE = """x AS (SELECT r_name AS domain, n_name AS phylum, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS class, c_custkey, c_acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(f"WITH {_LINEAGE} SELECT 'domain' AS rank, count(DISTINCT domain) AS n_taxa FROM x UNION ALL SELECT 'phylum', count(DISTINCT phylum) FROM x UNION ALL SELECT 'class', count(DISTINCT class) FROM x")
def rank_counts(spark, sf):
    return catalog.rank_counts(_lineage(spark, sf), ("domain", "phylum", "class"))


@query(f"WITH {_LINEAGE} SELECT count(*) AS n_selected FROM (SELECT DISTINCT domain, class FROM x WHERE class IS NOT NULL)")
def derep_size(spark, sf):
    return catalog.derep_size(_lineage(spark, sf), "class")


@query(f"WITH {_LINEAGE} SELECT domain, class, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY domain, class ORDER BY c_acctbal DESC, c_custkey) AS n FROM x WHERE class IS NOT NULL) WHERE n = 1")
def derep_across_domains(spark, sf):
    x = _lineage(spark, sf)
    return catalog.dereplicate(x, None, "class", key=[-F.col("c_acctbal"), F.col("c_custkey")]).select("domain", "class", "c_custkey")


def genomes(spark, sf):
    """Parts as rows of a genome catalog, with the columns that selection reads."""
    p = t(spark, sf, "part")
    half = F.when(F.col("p_partkey") % 2 == 0, "GCF_").otherwise("GCA_")
    level = F.element_at(F.array(*map(F.lit, ("Contig", "Scaffold", "Chromosome", "Complete Genome"))), (F.col("p_size") % 4 + 1).cast("int"))
    return p.select(
        F.concat(half, F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit(".1")).alias("assembly_accession"),
        F.when(F.col("p_size") % 10 == 0, "reference genome").otherwise("na").alias("refseq_category"),
        level.alias("assembly_level"),
        F.when(F.col("p_partkey") % 7 == 0, "NA").otherwise((F.col("p_size") * 2).cast("string")).alias("checkm_completeness"),
        F.when(F.col("p_partkey") % 5 == 0, "").otherwise((F.col("p_partkey") % 13).cast("string")).alias("checkm_contamination"),
        F.when(F.col("p_partkey") % 3 == 0, F.lit(None).cast("string")).otherwise((F.col("p_partkey") * 10).cast("string")).alias("genome_size_ungapped"),
        (F.col("p_partkey") * 11).cast("string").alias("genome_size"),
        (F.col("p_partkey") % 6).cast("string").alias("contig_count"),
        F.col("p_partkey").alias("taxid"),
        F.substring_index("p_type", " ", 1).alias("domain"),
        F.when(F.col("p_partkey") % 17 == 0, "NA").otherwise(F.col("p_brand")).alias("phylum"),
        F.col("p_type").alias("class"),
        *(F.lit("NA").alias(r) for r in ("order", "family", "genus")),
        F.col("p_name").alias("species"),
    )


GENOMES = """g AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'GCF_' ELSE 'GCA_' END || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '.1' AS assembly_accession, p_partkey AS k,
  CASE WHEN p_size % 10 = 0 THEN 'reference genome' ELSE 'na' END AS refseq_category, ['Contig', 'Scaffold', 'Chromosome', 'Complete Genome'][p_size % 4 + 1] AS assembly_level, p_size % 4 + 1 AS score,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size * 2 AS DOUBLE) END AS comp, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 13 AS DOUBLE) END AS cont,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey * 11 AS DOUBLE) ELSE CAST(p_partkey * 10 AS DOUBLE) END AS size, p_partkey % 6 AS contigs,
  string_split(p_type, ' ')[1] AS domain, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_brand END AS phylum, p_type AS class, p_name AS species FROM part)"""


@query(f"WITH {GENOMES} SELECT assembly_accession, class FROM g WHERE phylum = 'Brand#13' AND assembly_level IN ('Complete Genome', 'Chromosome') AND assembly_accession LIKE 'GCF%' AND domain IN ('STANDARD', 'ECONOMY')")
def pool_filters(spark, sf):
    g = genomes(spark, sf)
    x = catalog.pool(g, NCBI, "phylum", "Brand#13", levels=["complete", "chromosome"], prefix="refseq", domains=["STANDARD", "ECONOMY"])
    return x.select("assembly_accession", "class")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def liveness_semi(spark, sf):
    return catalog.alive(t(spark, sf, "customer"), F.col("c_custkey"), t(spark, sf, "orders"), F.col("o_custkey")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def dead_anti(spark, sf):
    return catalog.dead(t(spark, sf, "customer"), F.col("c_custkey"), t(spark, sf, "orders"), F.col("o_custkey")).select("c_custkey")


@query("""WITH k AS (SELECT DISTINCT o_custkey AS key FROM orders), a AS (SELECT s_suppkey AS key, s_nationkey AS v FROM supplier), b AS (SELECT c_custkey AS key, c_nationkey AS v FROM customer)
SELECT k.key, coalesce(a.v, b.v) AS nation FROM k LEFT JOIN a ON a.key = k.key LEFT JOIN b ON b.key = k.key""")
def tiered_lookup(spark, sf):
    k = t(spark, sf, "orders").select(F.col("o_custkey").alias("key")).distinct()
    a = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    b = t(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    return catalog.tiered_lookup(k, "key", [a, b], "nation")


def _wanted(spark, sf):
    return t(spark, sf, "orders").select(F.concat(F.lit("GCA_"), (F.col("o_orderkey") * 2).cast("string"), F.lit(".1")).alias("accession"))


_WANTED = "w AS (SELECT o_orderkey * 2 AS k FROM orders)"


@query(f"WITH {_WANTED} SELECT 'GCA_' || k || '.1' AS wanted, o_totalprice AS total FROM w JOIN orders ON o_orderkey = k")
def wanted_lookup(spark, sf):
    c = t(spark, sf, "orders").select(F.concat(F.lit("GCA_"), F.col("o_orderkey").cast("string"), F.lit(".2")).alias("acc"), F.col("o_totalprice").alias("total"))
    return catalog.wanted_lookup(_wanted(spark, sf), c, "acc")[0].select("wanted", "total")


@query(f"WITH {_WANTED} SELECT 'GCA_' || k || '.1' AS wanted FROM w WHERE k NOT IN (SELECT o_orderkey FROM orders)")
def wanted_missing(spark, sf):
    c = t(spark, sf, "orders").select(F.concat(F.lit("GCA_"), F.col("o_orderkey").cast("string"), F.lit(".2")).alias("acc"))
    return catalog.wanted_lookup(_wanted(spark, sf), c, "acc")[1]


@query("""WITH u AS (SELECT p_partkey, p_brand FROM part WHERE p_size > 40), d AS (SELECT p_partkey, upper(p_brand) AS p_brand FROM part)
SELECT p_partkey, p_brand, TRUE AS user_supplied FROM u UNION ALL SELECT p_partkey, p_brand, FALSE FROM d WHERE p_partkey NOT IN (SELECT p_partkey FROM u)""")
def community_merge(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    return catalog.merge_communities(p.where("p_size > 40").drop("p_size"), p.drop("p_size").withColumn("p_brand", F.upper("p_brand")), "p_partkey")


@query()
def random_per_group(spark, sf):
    return catalog.random_per_group(t(spark, sf, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_partkey", 42, 10, F.col("p_size") > 40)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def select_by_taxid(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderstatus").alias("taxid"))
    return catalog.by_lineage_taxid(o, "1-URGENT", ["o_orderpriority"]).select("o_orderkey", "o_custkey")


# --- intervals ------------------------------------------------------------------------------------------


def _spans(spark, sf):
    day = F.datediff("l_shipdate", F.lit("1992-01-01")).cast("long")
    return t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("contig"), day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("end"), F.col("l_extendedprice").alias("value"))


_SPANS = "s AS (SELECT l_suppkey AS contig, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS s, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS BIGINT) AS e, l_extendedprice AS v FROM lineitem)"


def _runs(gap: int) -> str:
    return f"""{_SPANS}, m AS (SELECT *, max(e) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s),
 r AS (SELECT *, sum(CASE WHEN s > b + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM m),
 u AS (SELECT contig, g, min(s) AS s, max(e) AS e, count(*) AS n, avg(v) AS v FROM r GROUP BY contig, g)"""


@query(f"WITH {_runs(0)} SELECT contig, CAST(sum(e - s) AS BIGINT) AS covered FROM u GROUP BY contig")
def interval_union(spark, sf):
    return intervals.union_length(_spans(spark, sf), ["contig"])


@query(f"WITH {_runs(3)} SELECT contig, s AS start, e AS \"end\", n AS spans, round(v, 4) AS coverage FROM u WHERE e - s >= 5")
def gap_join(spark, sf):
    r = intervals.window_regions(_spans(spark, sf), gap=3, min_length=5)
    return r.select("contig", "start", "end", "spans", F.round("coverage", 4).alias("coverage"))


@query("""WITH d AS (SELECT user_id, CAST(epoch(date_trunc('hour', ts)) // 3600 AS BIGINT) AS h FROM events), b AS (SELECT user_id, min(h) AS lo, max(h) AS hi FROM d GROUP BY user_id),
 c AS (SELECT user_id, unnest(range(lo, hi + 1)) AS h FROM b), z AS (SELECT user_id, h FROM c EXCEPT SELECT user_id, h FROM d),
 g AS (SELECT user_id, h, h - row_number() OVER (PARTITION BY user_id ORDER BY h) AS g FROM z)
SELECT user_id, min(h) AS start, max(h) + 1 AS "end" FROM g GROUP BY user_id, g""")
def zero_regions(spark, sf):
    d = t(spark, sf, "events").select("user_id", F.expr("unix_seconds(cast(ts as timestamp)) div 3600").alias("h")).distinct()
    b = d.groupBy("user_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    z = b.select("user_id", F.explode(F.sequence("lo", "hi")).alias("h")).join(d, ["user_id", "h"], "left_anti")
    return intervals.merge_runs(z.select("user_id", F.col("h").alias("start"), (F.col("h") + 1).alias("end")), ["user_id"]).select("user_id", "start", "end")


def _hourly(spark, sf):
    e = t(spark, sf, "events").groupBy(F.col("event_type").alias("contig"), F.expr("unix_seconds(cast(ts as timestamp)) div 3600").alias("start")).agg(F.sum("value").alias("v"))
    return e.select("contig", "start", (F.col("start") + 1).alias("end"), F.round("v", 2).alias("value"))


_HOURLY = "w AS (SELECT event_type AS contig, epoch_us(ts) // 3600000000 AS start, round(sum(value), 2) AS value FROM events GROUP BY 1, 2)"


@query(f"""WITH {_HOURLY}, a AS (SELECT avg(value) AS m, stddev_samp(value) AS sd, count(*) AS n FROM w)
SELECT contig, start, round(value / m, 6) AS fold, round(CASE WHEN value / m >= 1 THEN value / m ELSE -1 / nullif(value / m, 0) END, 4) AS signed_fold, round((value - m) / sd, 6) AS zscore, round(log2((value + 1e-6) / (m + 1e-6)), 6) AS log2_fold,
 round(100.0 * (rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0) / n, 6) AS percentile FROM w, a""")
def window_statistics(spark, sf):
    w = intervals.window_statistics(_hourly(spark, sf))
    return w.select("contig", "start", F.round("fold", 6).alias("fold"), F.round("signed_fold", 4).alias("signed_fold"), F.round("zscore", 6).alias("zscore"), F.round("log2_fold", 6).alias("log2_fold"), F.round("percentile", 6).alias("percentile"))


@query(f"WITH {_HOURLY}, p AS (SELECT contig, start, value, avg(value) OVER (PARTITION BY contig) AS m FROM w) SELECT contig, start, value FROM p WHERE value / m >= 2")
def high_windows(spark, sf):
    w = intervals.window_statistics(_hourly(spark, sf), per=["contig"])
    return intervals.extreme_windows(w, "fold", 2.0, True).select("contig", "start", "value")


@query(f"""WITH {_HOURLY}, m AS (SELECT *, max(start + 1) OVER (PARTITION BY contig ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM w),
 r AS (SELECT *, sum(CASE WHEN start > b THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM m),
 u AS (SELECT contig, min(start) AS start, round(avg(value), 4) AS c FROM r GROUP BY contig, g)
SELECT u.contig, u.start, 100.0 * (SELECT count(*) FROM w WHERE w.value <= u.c) / (SELECT count(*) FROM w) AS percentile FROM u""")
def region_percentile(spark, sf):
    w = _hourly(spark, sf)
    r = intervals.window_regions(w, gap=0).withColumn("coverage", F.round("coverage", 4))
    return intervals.region_percentiles(r, w).select("contig", "start", "percentile")


@query(f"""WITH {_SPANS}, r AS (SELECT DISTINCT contig, (s // 100) * 100 AS rs FROM s)
SELECT r.contig, rs AS start, CAST(coalesce(sum(least(rs + 100, s.e) - greatest(rs, s.s)), 0) AS BIGINT) AS shared FROM r LEFT JOIN s ON s.contig = r.contig AND s.s < rs + 100 AND s.e > rs GROUP BY r.contig, rs""")
def region_overlap(spark, sf):
    s = _spans(spark, sf)
    r = s.select("contig", F.expr("start div 100 * 100").alias("start")).distinct().withColumn("end", F.col("start") + 100)
    return intervals.overlap_sums(r, s, 64).select("contig", "start", "shared")


def _loci(spark, sf):
    s = _spans(spark, sf)
    return s.select("contig", F.concat(F.lit("t"), F.expr("cast(value as long) % 17").cast("string")).alias("target"), F.col("start").alias("q_low"), F.col("end").alias("q_high"), (F.col("value") % 100).alias("pident"), F.round("value", 2).alias("bitscore"))


@query()
def region_resolve(spark, sf):
    return intervals.resolve_regions(_loci(spark, sf).withColumn("contig", F.col("contig").cast("string")))


@query(f"""WITH {_SPANS}, h AS (SELECT contig, CAST(floor(v) AS BIGINT) % 17 AS target, s + 1 AS a, e AS b, v FROM s WHERE e > s),
 m AS (SELECT *, max(b) OVER (PARTITION BY contig, target ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM h),
 r AS (SELECT *, sum(CASE WHEN a > p + 20 THEN 1 ELSE 0 END) OVER (PARTITION BY contig, target ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM m),
 d AS (SELECT contig, target, g, count(DISTINCT x) AS covered FROM (SELECT contig, target, g, unnest(range(a % 60, a % 60 + (b - a) + 1)) AS x FROM r) GROUP BY contig, target, g)
SELECT r.contig, r.target, min(a) AS q_low, max(b) AS q_high, round(100.0 * any_value(d.covered) / 120, 6) AS perc_target_cov FROM r JOIN d ON d.contig = r.contig AND d.target = r.target AND d.g = r.g GROUP BY r.contig, r.target, r.g HAVING 100.0 * any_value(d.covered) / 120 >= 30""")
def hit_loci(spark, sf):
    s = _spans(spark, sf).where("end > start").withColumn("a", F.col("start") + 1)
    h = s.select("contig", (F.floor("value").cast("long") % 17).alias("target"), F.lit(10_000).cast("long").alias("clen"), F.lit(120).cast("long").alias("slen"), F.col("a").alias("q_start"), F.col("end").alias("q_end"), (F.col("a") % 60).alias("s_start"), (F.col("a") % 60 + F.col("end") - F.col("a")).alias("s_end"), F.lit(90.0).alias("pident"), F.col("value").alias("bitscore"))
    return intervals.loci(h, gap=20, min_coverage=30.0, edge_coverage=30.0).select("contig", "target", "q_low", "q_high", F.round("perc_target_cov", 6).alias("perc_target_cov"))


@query(f"""WITH {_SPANS}, p AS (SELECT contig, s % 2000 AS s, s % 2000 + (e - s) AS e FROM s), c AS (SELECT contig, s, least(e, 2000) AS e FROM p UNION ALL SELECT contig, 0, e - 2000 FROM p WHERE e > 2000),
 x AS (SELECT DISTINCT contig, unnest(range(s, e)) AS b FROM c) SELECT contig, count(*) AS covered, count(*) / 2000.0 AS detection FROM x GROUP BY contig""")
def detection(spark, sf):
    s = _spans(spark, sf).select("contig", (F.col("start") % 2000).alias("start"), (F.col("start") % 2000 + F.col("end") - F.col("start")).alias("end"))
    c = s.select("contig").distinct().withColumn("length", F.lit(2000).cast("long"))
    return intervals.detection(s, c).select("contig", "covered", "detection")


@query(f"""WITH {_runs(30)} SELECT contig, contig || '_island_' || row_number() OVER (PARTITION BY contig ORDER BY s) AS island, greatest(s - 10, 1) AS start, least(e + 10, 9000) AS "end", n AS regions FROM u WHERE e - s + 1 >= 50 AND n >= 3 AND 9000 >= 2.0 * (e - s + 1)""")
def islands(spark, sf):
    s = _spans(spark, sf)
    c = s.select("contig").distinct().withColumn("length", F.lit(9000).cast("long"))
    return intervals.islands(s, c, gap=30, buffer=10, min_contig=5000, times=2.0, min_span=50).select("contig", "island", "start", "end", "regions")


@query("SELECT doc_id AS contig, unnest(range(0, n_chars - 200 + 1, 100)) AS start FROM documents WHERE n_chars >= 200")
def sliding_windows(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("contig"), F.col("n_chars").alias("length"))
    return intervals.sliding_windows(d, 200, 100).select("contig", F.col("start").cast("long").alias("start"))


# --- statistics ---------------------------------------------------------------------------------------------


@query("""WITH h AS (SELECT l_suppkey AS contig, CAST(l_linenumber AS DOUBLE) AS depth, CAST(l_quantity AS BIGINT) AS n FROM lineitem), l AS (SELECT s_suppkey AS contig, 40000 AS length FROM supplier),
 z AS (SELECT contig, depth, n FROM h UNION ALL SELECT l.contig, 0, length - coalesce((SELECT sum(n) FROM h WHERE h.contig = l.contig), 0) FROM l),
 p AS (SELECT contig, depth, sum(n) AS n FROM z WHERE n > 0 GROUP BY contig, depth), c AS (SELECT *, sum(n) OVER (PARTITION BY contig ORDER BY depth) AS u, sum(n) OVER (PARTITION BY contig) AS tot FROM p)
SELECT contig, CAST(any_value(tot) AS BIGINT) AS length, round(sum(CASE WHEN depth > 0 THEN n ELSE 0 END) / any_value(tot), 6) AS detection, round(sum(depth * n) / any_value(tot), 6) AS mean_depth,
 (min(depth) FILTER (u >= floor((tot - 1) / 2.0) + 1) + min(depth) FILTER (u >= ceil((tot - 1) / 2.0) + 1)) / 2 AS median_depth FROM c GROUP BY contig""")
def depth_statistics(spark, sf):
    d = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("contig"), F.lit(0).cast("long").alias("start"), F.col("l_quantity").cast("long").alias("end"), F.col("l_linenumber").alias("depth"))
    lengths = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("contig"), F.lit(40000).cast("long").alias("length"))
    s = stats.depth_statistics(d, lengths, ["contig"])
    return s.select("contig", "length", F.round("detection", 6).alias("detection"), F.round("mean_depth", 6).alias("mean_depth"), "median_depth")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n_reads, round(avg(l_discount * 100 + l_tax), 6) AS mean_pid, round(quantile_cont(round(l_discount * 100 + l_tax, 2), 0.5), 6) AS median_pid, min(l_discount * 100 + l_tax) AS min_pid, max(l_discount * 100 + l_tax) AS max_pid, round(stddev_pop(l_discount * 100 + l_tax), 6) AS sd_pid FROM lineitem GROUP BY 1, 2""")
def identity_statistics(spark, sf):
    x = t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_discount") * 100 + F.col("l_tax")).alias("pid"))
    s = stats.identity_statistics(x, ["l_returnflag", "l_linestatus"])
    return s.select("l_returnflag", "l_linestatus", "n_reads", F.round("mean_pid", 6).alias("mean_pid"), F.round("median_pid", 6).alias("median_pid"), "min_pid", "max_pid", F.round("sd_pid", 6).alias("sd_pid"))


_Q = ", ".join(f"quantile_cont(l_extendedprice, {p}) AS p{round(p * 100):02d}" for p in stats.PERCENTS)


@query(f"SELECT count(l_extendedprice) AS n, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(sum(l_extendedprice), 2) AS sum, round(avg(l_extendedprice), 6) AS mean, median(l_extendedprice) AS median, round(stddev_pop(l_extendedprice), 4) AS sd, {_Q} FROM lineitem")
def column_summary(spark, sf):
    s = stats.column_summary(t(spark, sf, "lineitem"), "l_extendedprice")
    return s.withColumn("sum", F.round("sum", 2)).withColumn("mean", F.round("mean", 6)).withColumn("sd", F.round("sd", 4))


@query("SELECT event_type, CAST(grouping(event_type) AS INTEGER) AS is_total, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS sd, min(value) AS min, max(value) AS max FROM events GROUP BY GROUPING SETS ((), (event_type))")
def overview(spark, sf):
    s = stats.overview(t(spark, sf, "events"), "value", "event_type")
    return s.select("event_type", "is_total", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "sd")), "min", "max")


def _matrix(spark, sf):
    x = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy(F.col("p_type").alias("feature"), F.year("l_shipdate").alias("sample")).agg(F.sum("l_quantity").alias("value"))


_MATRIX = "m AS (SELECT p_type AS feature, CAST(year(l_shipdate) AS INTEGER) AS sample, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


@query(f"WITH {_MATRIX} SELECT feature, sample, round(value / sum(value) OVER (PARTITION BY sample) * 1e6, 4) AS cpm FROM m")
def cpm(spark, sf):
    return stats.cpm(_matrix(spark, sf)).select("feature", "sample", F.round("cpm", 4).alias("cpm"))


@query(f"""WITH {_MATRIX}, n AS (SELECT count(DISTINCT sample) AS n FROM m), g AS (SELECT feature, exp(avg(ln(value))) AS g FROM m WHERE value > 0 GROUP BY feature HAVING count(*) = (SELECT n FROM n)),
 f AS (SELECT sample, quantile_cont(value / g, 0.5) AS f FROM m JOIN g USING (feature) GROUP BY sample) SELECT feature, m.sample, round(value / f, 5) AS normalized FROM m JOIN f ON f.sample = m.sample""")
def median_ratio(spark, sf):
    return stats.median_ratio(_matrix(spark, sf)).select("feature", "sample", F.round("normalized", 5).alias("normalized"))


@query("""WITH d AS (SELECT source, n_chars AS l, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC) AS k, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING) AS c, sum(n_chars) OVER (PARTITION BY source) AS tot FROM documents)
SELECT source, count(*) AS contigs, CAST(any_value(tot) AS BIGINT) AS total_length, max(l) AS max, min(l) AS min, max(l) FILTER (c * 100 >= tot * 50) AS n50, min(k) FILTER (c * 100 >= tot * 50) AS l50, max(l) FILTER (c * 100 >= tot * 90) AS n90, min(k) FILTER (c * 100 >= tot * 90) AS l90, count(*) FILTER (l >= 1000) AS contigs_1000 FROM d GROUP BY source""")
def assembly_summary(spark, sf):
    d = t(spark, sf, "documents").select("source", F.col("n_chars").alias("length"))
    return stats.assembly_summary(d, ["source"]).select("source", "contigs", "total_length", "max", "min", "n50", "l50", "n90", "l90", "contigs_1000")


_SEG = "r AS (SELECT c_mktsegment AS segment, round(sum(o_totalprice), 2) AS w FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"


def _segments(spark, sf):
    o = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.round(F.sum("o_totalprice"), 2).alias("w"))


@query(f"""WITH {_SEG}, x AS (SELECT segment, w / sum(w) OVER () * 1000000 AS x FROM r), f AS (SELECT segment, floor(x) AS f, x - floor(x) AS d FROM x)
SELECT segment, CAST(f + CASE WHEN row_number() OVER (ORDER BY d DESC, segment) <= 1000000 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS units FROM f""")
def apportion(spark, sf):
    return stats.apportion(_segments(spark, sf), "w", ["segment"], 1_000_000).select("segment", "units")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity ROWS UNBOUNDED PRECEDING) - CAST(l_quantity AS BIGINT) AS BIGINT) AS first FROM lineitem")
def prefix_offsets(spark, sf):
    x = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("units"))
    return stats.offsets(x, "units", ["l_linenumber", "l_partkey", "units"], ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "first")


@query()
def contig_split(spark, sf):
    x = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit(1000).alias("total"), F.col("l_quantity").alias("length"))
    return stats.split_by_length(x, "total", "length", ["l_linenumber", "l_partkey", "length"], ["l_orderkey"]).select("l_orderkey", "l_linenumber", "share")


@query(f"WITH {_SEG}, p AS (SELECT segment, w, CASE WHEN segment < 'C' THEN 0.1 WHEN segment LIKE 'H%' THEN 0.25 END AS pin FROM r), s AS (SELECT coalesce(sum(pin), 0) AS p, coalesce(sum(w) FILTER (pin IS NULL), 0) AS w FROM p) SELECT segment, round(coalesce(pin, p.w / s.w * (1 - s.p)), 9) AS rel_abundance FROM p, s")
def relative_abundance(spark, sf):
    x = _segments(spark, sf).withColumn("pin", F.when(F.col("segment") < "C", 0.1).when(F.col("segment").startswith("H"), 0.25))
    return stats.relative_abundance(x, "w").select("segment", F.round("rel_abundance", 9).alias("rel_abundance"))


@query(f"WITH {_LINEAGE} SELECT 'domain' AS rank, domain AS taxon, round(sum(c_acctbal), 2) AS abundance FROM x GROUP BY domain UNION ALL SELECT 'class', class, round(sum(c_acctbal), 2) FROM x GROUP BY class")
def truth_per_rank(spark, sf):
    x = stats.truth_per_rank(_lineage(spark, sf), ["domain", "class"], "c_acctbal")
    return x.withColumn("abundance", F.round("abundance", 2))


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def repeated_records(spark, sf):
    return sequences.repeated(t(spark, sf, "documents"), "text")


# --- reports and combination ------------------------------------------------------------------------------------


@query("""SELECT user_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS click, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS error, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS purchase FROM events GROUP BY user_id""")
def pivot_counts(spark, sf):
    return reports.pivot_counts(t(spark, sf, "events"), "user_id", "event_type", ["click", "error", "purchase"])


@query("""WITH a AS (SELECT p_brand AS k, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT p_brand AS k, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_linenumber = 1 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, 0) AS s1, coalesce(b.v, 0) AS s2 FROM a FULL JOIN b ON a.k = b.k""")
def combine_samples(spark, sf):
    x = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    one = x.where("l_returnflag = 'A'").groupBy(F.col("p_brand").alias("k")).agg(F.sum("l_quantity").alias("v"))
    two = x.where("l_returnflag = 'R' and l_linenumber = 1").groupBy(F.col("p_brand").alias("k")).agg(F.sum("l_quantity").alias("v"))
    return reports.combine_samples([("s1", one), ("s2", two)], "k", "v")


@query("""WITH s AS (SELECT p_brand, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY q DESC, p_brand) AS n FROM s)
SELECT CASE WHEN n <= 10 THEN p_brand ELSE 'Other' END AS p_brand, sum(q) AS l_quantity FROM r GROUP BY 1""")
def top_and_other(spark, sf):
    x = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return reports.top_and_other(x, "p_brand", "l_quantity")


@query("""WITH h AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_linenumber, l_partkey) AS n FROM lineitem WHERE l_quantity > 25)
SELECT k.l_orderkey, h.l_partkey, h.l_discount FROM (SELECT DISTINCT l_orderkey FROM lineitem) k LEFT JOIN h ON h.l_orderkey = k.l_orderkey AND h.n = 1""")
def best_hits(spark, sf):
    x = t(spark, sf, "lineitem")
    return reports.best_hits(x, "l_orderkey", ["l_partkey", "l_discount"], F.col("l_quantity") > 25, [F.col("l_discount"), F.col("l_linenumber"), F.col("l_partkey")])


@query(r"""WITH w AS (SELECT lang, unnest(string_split(text, ' ')) AS term FROM documents), c AS (SELECT lang AS namespace, term, count(*) AS n FROM w WHERE term <> '' GROUP BY 1, 2)
SELECT namespace, term, n AS term_counts, round(100.0 * n / sum(n) OVER (), 9) AS percent, round(100.0 * n / sum(n) OVER (PARTITION BY namespace), 9) AS percent_in_namespace FROM c""")
def term_counts(spark, sf):
    w = t(spark, sf, "documents").select("lang", F.filter(F.split("text", " "), lambda x: x != "").alias("w"))
    a = w.select(F.transform("w", lambda x: F.concat_ws("|", "lang", x)).alias("terms"))
    # the terms are those that were counted, so the texts are read once
    c = checkpoint(reports.counted_terms(a))
    terms = c.select("term", F.substring_index("term", "|", 1).alias("namespace"), F.lit(False).alias("is_obsolete"))
    x = reports.term_shares(c, terms)
    return x.select("namespace", F.expr("substring(term, length(namespace) + 2)").alias("term"), "term_counts", F.round("percent", 9).alias("percent"), F.round("percent_in_namespace", 9).alias("percent_in_namespace"))


def _report(spark, sf):
    c = t(spark, sf, "conversations")
    rank = F.when(F.col("turn") % 5 == 0, "D").when(F.col("turn") % 3 == 0, "P").when(F.col("turn") % 2 == 0, "C").otherwise("-")
    return c.select("conv_id", F.col("turn").alias("ordinal"), rank.alias("rank"), F.col("text").alias("name"))


_RANK = "CASE WHEN turn % 5 = 0 THEN 'D' WHEN turn % 3 = 0 THEN 'P' WHEN turn % 2 = 0 THEN 'C' ELSE '-' END"


@query(f"""WITH r AS (SELECT conv_id, turn, {_RANK} AS rank, text AS name FROM conversations), p AS (SELECT *, max(CASE WHEN rank = 'D' THEN turn END) OVER w AS d, max(CASE WHEN rank = 'P' THEN turn END) OVER w AS p, max(CASE WHEN rank = 'C' THEN turn END) OVER w AS c FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT p.conv_id, p.turn AS ordinal, a.name AS domain, b.name AS phylum, e.name AS class FROM p LEFT JOIN r a ON a.conv_id = p.conv_id AND a.turn = p.d LEFT JOIN r b ON b.conv_id = p.conv_id AND b.turn = p.p AND p.p > coalesce(p.d, -1) LEFT JOIN r e ON e.conv_id = p.conv_id AND e.turn = p.c AND p.c > greatest(coalesce(p.d, -1), coalesce(p.p, -1))""")
def forward_fill(spark, sf):
    return reports.forward_fill_lineage(_report(spark, sf), ["conv_id"], ("domain", "phylum", "class")).select("conv_id", "ordinal", "domain", "phylum", "class")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user FROM conversations""")
def last_of_kind(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return t(spark, sf, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("last_user"))


@query("""SELECT s.s_suppkey AS genome, s.s_acctbal AS size, coalesce(nullif(trim(n_name), ''), 'Not Assigned') AS phylum, o.c AS n FROM supplier s JOIN nation ON s_nationkey = n_nationkey JOIN (SELECT l_suppkey, count(*) AS c FROM lineitem GROUP BY 1) o ON o.l_suppkey = s.s_suppkey""")
def genome_overview(spark, sf):
    s, n = t(spark, sf, "supplier"), t(spark, sf, "nation")
    lin = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("genome"), *(F.col("n_name").alias(r) if r == "phylum" else F.lit("").alias(r) for r in reports.RANKS))
    q = t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("genome")).agg(F.count("*").alias("n"))
    return reports.genome_overview(s.select(F.col("s_suppkey").alias("genome"), F.col("s_acctbal").alias("size")), q, lin).select("genome", "size", "phylum", "n")


@query("SELECT o_orderkey, coalesce(c_name, CAST(o_custkey AS VARCHAR)) AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING'")
def rename_by_map(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("name"))
    m = t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("old"), F.col("c_name").alias("new"))
    return reports.rename_by_map(o, "name", m)


# --- sequences ------------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0 ELSE length(regexp_replace(text, '[^GC]', '', 'g')) / length(text) END, 9) AS gc,
 CASE WHEN regexp_matches(upper(regexp_replace(text, '[\s*-]', '', 'g')), '[EFIJLOPQZ]') THEN 'aa' WHEN length(regexp_replace(upper(regexp_replace(text, '[\s*-]', '', 'g')), '[^ACGTUNRYSWKMBDHV]', '', 'g')) / nullif(length(regexp_replace(text, '[\s*-]', '', 'g')), 0) >= 0.9 THEN 'nt' ELSE 'aa' END AS kind,
 CASE WHEN length(text) >= 3 THEN len(list_distinct([substr(text, i, 3) FOR i IN range(1, length(text) - 1)])) / least(length(text) - 2, 64) ELSE 0 END AS complexity FROM documents""")
def sequence_metrics(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", F.round(columns.gc_fraction("text"), 9).alias("gc"), columns.sequence_type("text").alias("kind"), columns.complexity("text").cast("double").alias("complexity"))


@query("SELECT doc_id, reverse(translate(text, 'ACGTacgt', 'TGCAtgca')) AS seq FROM documents")
def reverse_complements(spark, sf):
    return t(spark, sf, "documents").select("doc_id", columns.reverse_complement("text").alias("seq"))


@query("SELECT count(*) AS before, count(*) FILTER (length(text) BETWEEN 500 AND 2000) AS after FROM documents")
def filter_length(spark, sf):
    return sequences.filter_counts(t(spark, sf, "documents"), 500, 2000, "text")


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT DISTINCT source FROM documents WHERE lang = 'en' AND n_chars >= 5000)")
def filter_values(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return sequences.by_values(d, "source", d.where("lang = 'en' and n_chars >= 5000").select("source")).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE n_chars >= 20000)")
def filter_values_inverse(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return sequences.by_values(d, "source", d.where("n_chars >= 20000").select("source"), invert=True).select("doc_id", "source")


@query("SELECT doc_id, CASE WHEN n = 1 THEN source ELSE source || '_' || (n - 1) END AS new_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)")
def suffix_repeats(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.col("source").alias("id"), F.col("doc_id").alias("ordinal"))
    return sequences.suffix_repeats(d).select("doc_id", "new_id")


@query("SELECT doc_id, 's' || row_number() OVER (ORDER BY doc_id) AS id FROM documents")
def number_records(spark, sf):
    return sequences.number_records(t(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("ordinal"))).select("doc_id", "id")


@query("SELECT doc_id, 10 + doc_id % 30 AS start, substr(text, CAST(11 + doc_id % 30 AS BIGINT), 40) AS seq FROM documents")
def extract_coords(spark, sf):
    d = t(spark, sf, "documents")
    spans = d.select(F.col("doc_id").alias("contig"), (10 + F.col("doc_id") % 30).alias("start"), (50 + F.col("doc_id") % 30).alias("end"))
    return sequences.extract(spans, d.select(F.col("doc_id").alias("id"), F.col("text").alias("seq"))).select(F.col("contig").alias("doc_id"), "start", "seq")


@query("SELECT doc_id, i - 1 AS start FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE contains(text, 'tion')) WHERE substr(text, i, 4) = 'tion'")
def primer_exact(spark, sf):
    return sequences.exact_hits(t(spark, sf, "documents"), "doc_id", "text", "tion").select("doc_id", F.col("start").cast("long").alias("start"))


@query("""WITH d AS (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE contains(text, 'thor') AND contains(text, 'ated')), a AS (SELECT doc_id, i - 1 AS s FROM d WHERE substr(text, i, 4) = 'thor'), b AS (SELECT doc_id, i - 1 AS s FROM d WHERE substr(text, i, 4) = 'ated'),
h AS (SELECT doc_id, s, 'forward' AS t FROM a UNION ALL SELECT doc_id, s, 'reverse' FROM b) SELECT l.doc_id, l.s AS left_start, r.s AS right_start FROM h l JOIN h r ON l.doc_id = r.doc_id AND r.s >= l.s + 4 AND l.t <> r.t""")
def amplicons(spark, sf):
    d = t(spark, sf, "documents")
    h = sequences.exact_hits(d, "doc_id", "text", "thor").withColumn("type", F.lit("forward")).unionByName(sequences.exact_hits(d, "doc_id", "text", "ated").withColumn("type", F.lit("reverse")))
    return sequences.amplicons(h, "doc_id").select("doc_id", F.col("left_start").cast("long").alias("left_start"), F.col("right_start").cast("long").alias("right_start"))


@query()
def primer_approximate(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("seq"))
    return sequences.primer_hits(d, "tioned", "ations", 1)


@query("""WITH d AS (SELECT translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS s FROM benchmark), p AS (SELECT i AS position, substr(s, CAST(i + 1 AS BIGINT), 1) AS c FROM (SELECT s, unnest(range(0, length(s))) AS i FROM d)),
f AS (SELECT position, CASE WHEN c IN ('A', 'E', 'I', 'N', 'O', 'T', 'H', 'R', 'S') THEN c ELSE '-' END AS c, count(*) AS n FROM p GROUP BY 1, 2), s AS (SELECT position, sum(n) AS depth, sum(n) FILTER (c = '-') AS g, sum(n) FILTER (c <> '-') AS m, sum(n * ln(n)) FILTER (c <> '-') AS e FROM f GROUP BY position)
SELECT CAST(position AS INTEGER) AS position, CAST(depth AS BIGINT) AS depth, round(coalesce(g, 0) / depth, 9) AS gap_fraction, round(CASE WHEN m > 0 THEN 1 - (ln(m) - e / m) / ln(9) END, 9) AS conservation FROM s""")
def msa_columns(spark, sf):
    x = sequences.msa_columns(t(spark, sf, "benchmark").select(F.col("text").alias("seq")), "AEINOTHRS", gaps="ignore")
    return x.select("position", "depth", F.round("gap_fraction", 9).alias("gap_fraction"), F.round("conservation", 9).alias("conservation"))


@query("""SELECT p_partkey, p_brand AS domain, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'size' || p_size END AS phylum FROM part""")
def lineage_split(spark, sf):
    s = F.concat(F.lit("root;d__"), "p_brand", F.lit(";p__"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("size"), F.col("p_size").cast("string"))))
    d, p = columns.lineage_lenient(s)[:2]
    return t(spark, sf, "part").select("p_partkey", d, p)


@query("""SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) + 3 + l_linenumber AS aligned_columns, CAST(l_quantity AS BIGINT) + 3 AS query_aligned, CAST(2 AS BIGINT) AS gap_events, CAST(5 AS BIGINT) AS soft_clipped,
 round(100.0 * (CAST(l_quantity AS BIGINT) + 3 + l_linenumber - (3 + l_linenumber)) / (CAST(l_quantity AS BIGINT) + 3 + l_linenumber), 6) AS pid_gap_aware, round(100.0 * CAST(l_quantity AS BIGINT) / (CAST(l_quantity AS BIGINT) + 2), 6) AS pid_gap_compressed FROM lineitem""")
def cigar_identity(spark, sf):
    q, n = F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber").cast("string")
    x = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("5S"), q, F.lit("M3I"), n, F.lit("D")).alias("cigar"), (F.col("l_linenumber") + 3).alias("nm"))
    x = columns.with_cigar(x)
    return x.select("l_orderkey", "l_linenumber", "aligned_columns", "query_aligned", "gap_events", "soft_clipped", F.round("pid_gap_aware", 6).alias("pid_gap_aware"), F.round("pid_gap_compressed", 6).alias("pid_gap_compressed"))


@query()
def simulate_reads(spark, sf):
    d = t(spark, sf, "documents")
    return sequences.sample_reads(d.select(F.col("doc_id").cast("string").alias("contig"), F.col("text").alias("seq"), F.lit(3).alias("units")), 100, 7, circular=True)


@query()
def point_mutations(spark, sf):
    return sequences.mutate(t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("seq")), 0.05, 3)


@query("""SELECT CAST(item_id AS VARCHAR) AS id, 100.0 * (length(text) - 3) / length(text) AS percent_identity, 100.0 * (length(text) - 3) / length(text) AS percent_covered, 1 AS deletion_runs, 0 AS substitutions FROM benchmark""")
def alignment_differences(spark, sf):
    """Each passage against itself without its first three letters: one deletion, all else equal."""
    b = t(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("ref"), F.expr("substring(text, 4)").alias("query"))
    return alignment.alignment_summary(alignment.positions(alignment.align_pairs(b, alignment.similarity())))


# --- simulated communities ------------------------------------------------------------------------------------------


@query()
def fragments(spark, sf):
    """Prose is full of the letter n, which in a sequence means an unknown base, so here it reads a."""
    d = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("contig"), F.translate("text", "nN", "aA").alias("seq"), F.lit(3).alias("units"))
    return community.sample_fragments(d, 11, 120.0, 20.0, 60)


@query()
def paired_mates(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("contig"), F.col("text").alias("seq"), F.lit(2).alias("units"))
    return community.mates(community.sample_fragments(d, 5, 200.0, 30.0, 75, circular=True, allow_n=True), 75)


@query()
def lognormal_weights(spark, sf):
    return community.abundance_weights(t(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey", 3, 1.0)


@query("""WITH g AS (SELECT s_suppkey AS genome, 5000 + s_suppkey AS genome_size FROM supplier), r AS (SELECT l_suppkey AS genome, count(*) AS reads, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bases FROM lineitem GROUP BY 1),
 x AS (SELECT g.genome, genome_size, coalesce(reads, 0) AS reads, coalesce(bases, 0) AS bases FROM g LEFT JOIN r ON r.genome = g.genome)
SELECT genome, reads, bases, round(bases / genome_size, 9) AS mean_coverage, round(bases / genome_size / sum(bases / genome_size) OVER (), 9) AS rel_abundance FROM x""")
def genome_truth(spark, sf):
    g = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("genome"), (F.col("s_suppkey") + 5000).alias("genome_size"))
    r = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("genome"), F.lit(0).cast("long").alias("start"), F.col("l_quantity").cast("long").alias("end"))
    return community.genome_truth(g, r).select("genome", "reads", "bases", F.round("mean_coverage", 9).alias("mean_coverage"), F.round("rel_abundance", 9).alias("rel_abundance"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey AS genome, n_name AS phylum FROM lineitem LEFT JOIN (SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) ON s_suppkey = l_suppkey")
def read_truth(spark, sf):
    g = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("genome"), F.col("n_name").alias("phylum"))
    r = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("genome"))
    return community.read_truth(r, g, "genome", ("phylum",))


@query("""WITH d AS (SELECT l_suppkey AS target, avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) AS detection FROM lineitem GROUP BY 1)
SELECT l_suppkey AS target, count(*) AS n_reads, round(avg(100 - l_discount * 100), 9) AS mean_pid FROM lineitem JOIN d ON target = l_suppkey WHERE detection * 100 >= 50 GROUP BY 1 HAVING avg(100 - l_discount * 100) >= 95""")
def reads_screen(spark, sf):
    x = t(spark, sf, "lineitem")
    d = x.groupBy(F.col("l_suppkey").cast("string").alias("target")).agg(F.avg(F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0)).alias("detection")).withColumn("depth", F.lit(1))
    i = x.select(F.col("l_suppkey").cast("string").alias("target"), (100 - F.col("l_discount") * 100).alias("pid"))
    s = reports.reads_screen(i, d, 50.0, 95.0)
    return s.select(F.col("target").cast("long").alias("target"), "n_reads", F.round("mean_pid", 9).alias("mean_pid"))


@query("""WITH b AS (SELECT source FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1) SELECT doc_id, CASE WHEN source IN (SELECT source FROM b) THEN source || '__' || lang ELSE source END AS source FROM documents""")
def split_colliding(spark, sf):
    return reports.split_colliding(t(spark, sf, "documents").select("doc_id", "source", "lang"), "source", "lang").select("doc_id", "source")


@query("SELECT o_custkey AS sample, count(DISTINCT o_orderkey) AS n_runs, min(o_orderkey) AS first FROM orders GROUP BY 1")
def runs_of_samples(spark, sf):
    x = reports.runs_of_samples(t(spark, sf, "orders").select(F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("run")))
    return x.select("sample", F.col("n_runs").cast("long").alias("n_runs"), F.col("runs")[0].alias("first"))


@query("SELECT doc_id, CAST(length(text) // 3 AS INTEGER) AS residues FROM documents")
def codon_lengths(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.length(columns.translate_codons("text")).alias("residues"))


# --- trees, sets, streams -------------------------------------------------------------------------------------------


_EDGES = "e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


def _edges(spark, sf):
    def e(df, c, cp, p, pp):
        return df.select(F.concat(F.lit(cp), F.col(c).cast("string")).alias("child"), (F.concat(F.lit(pp), F.col(p).cast("string")) if p else F.lit(pp)).alias("parent"))

    return e(t(spark, sf, "nation"), "n_nationkey", "n", "n_regionkey", "r").unionByName(e(t(spark, sf, "region"), "r_regionkey", "r", None, "root")).unionByName(e(t(spark, sf, "supplier"), "s_suppkey", "s", "s_nationkey", "n"))


@query(f"WITH RECURSIVE {_EDGES}, u(node, ancestor, depth) AS (SELECT n, n, 0 FROM (SELECT child AS n FROM e UNION SELECT parent FROM e) UNION ALL SELECT u.node, e.parent, u.depth + 1 FROM u JOIN e ON e.child = u.ancestor) SELECT node, ancestor, min(depth) AS depth FROM u GROUP BY node, ancestor")
def tree_closure(spark, sf):
    return ontology.closure(_edges(spark, sf))


@query("SELECT 's' || s_suppkey AS taxid, n_name AS phylum, r_name AS domain FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def tree_lineages(spark, sf):
    rank = F.when(F.col("child").startswith("r"), "superkingdom").when(F.col("child").startswith("n"), "phylum").otherwise("species")
    nodes = _edges(spark, sf).select(F.col("child").alias("taxid"), "parent", rank.alias("rank"))
    names = t(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("taxid"), F.col("n_name").alias("name")).unionByName(t(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("taxid"), F.col("r_name").alias("name")))
    return ontology.lineages(nodes, names).where(F.col("taxid").startswith("s")).select("taxid", "phylum", "domain")


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_intersect(spark, sf):
    o = t(spark, sf, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def set_except(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("k")).exceptAll(t(spark, sf, "orders").where("o_totalprice > 100000").select("o_custkey").distinct())


@query("SELECT k, min(o) AS first FROM (SELECT n_name AS k, n_nationkey AS o FROM nation UNION ALL SELECT r_name, 100 + r_regionkey FROM region) GROUP BY k")
def union_first_seen(spark, sf):
    u = t(spark, sf, "nation").select(F.col("n_name").alias("k"), F.col("n_nationkey").alias("first")).unionByName(t(spark, sf, "region").select(F.col("r_name").alias("k"), (F.col("r_regionkey") + 100).alias("first")))
    return sequences.first_of_each(u, "k", "first")


@query("""WITH w AS (SELECT event_type, value, unnest([epoch_us(ts) // 1800000000 * 1800, epoch_us(ts) // 1800000000 * 1800 - 1800]) AS s FROM events) SELECT s AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""")
def sliding_counts(spark, sf):
    x = extensions.sliding_counts(t(spark, sf, "events"), "ts", "event_type", "value")
    return x.select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, epoch_us(ts) AS u, sum(CASE WHEN epoch_us(ts) - p >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))
SELECT user_id, min(u) AS start, count(*) AS n FROM g GROUP BY user_id, g""")
def sessions(spark, sf):
    x = extensions.sessions(t(spark, sf, "events"), "ts", "user_id")
    return x.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "n")
