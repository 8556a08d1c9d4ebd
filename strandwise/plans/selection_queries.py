"""Queries over selection, lineages, names and alignments, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns
from ..operators import catalog, community, reports
from ..schema import NCBI
from .catalog_queries import GENOMES, genomes, query, t

_KEY = """CASE WHEN refseq_category = 'reference genome' AND (comp IS NULL OR (comp >= 85 AND (cont IS NULL OR cont <= 10))) THEN 0 ELSE 1 END, CASE WHEN comp IS NULL THEN 1 ELSE 0 END, -coalesce(comp, 0),
 CASE WHEN comp IS NULL THEN 0 ELSE coalesce(cont, 1e300) END, -score, -CASE WHEN contigs > 0 AND size > 0 THEN size / contigs ELSE 0 END, assembly_accession"""


@query(f"WITH {GENOMES} SELECT domain, phylum, assembly_accession FROM (SELECT *, row_number() OVER (PARTITION BY domain, phylum ORDER BY {_KEY}) AS n FROM g WHERE phylum IS NOT NULL) WHERE n = 1")
def derep_quality(spark, sf):
    """The whole seven-part quality key."""
    return catalog.dereplicate(genomes(spark, sf), NCBI, "phylum").select("domain", "phylum", "assembly_accession")


@query(f"WITH {GENOMES} SELECT assembly_accession FROM g WHERE refseq_category = 'reference genome' AND domain = 'ECONOMY'")
def pool_representatives(spark, sf):
    return catalog.pool(genomes(spark, sf), NCBI, "domain", "ECONOMY", representatives=True).select("assembly_accession")


@query(f"WITH {GENOMES} SELECT count(*) AS n_genomes, count(*) FILTER (refseq_category = 'reference genome') AS n_representatives FROM g WHERE domain = 'ECONOMY' AND assembly_accession LIKE 'GCA%'")
def genome_counts(spark, sf):
    return catalog.genome_counts(genomes(spark, sf), NCBI, rank="domain", taxon="ECONOMY", prefix="genbank")


@query(f"WITH {GENOMES} SELECT DISTINCT phylum FROM g WHERE phylum IS NOT NULL")
def taxa_list(spark, sf):
    return catalog.taxa(genomes(spark, sf), "phylum")


@query(f"WITH {GENOMES} SELECT count(DISTINCT phylum) AS n_taxa FROM g")
def taxon_count(spark, sf):
    return catalog.taxon_count(genomes(spark, sf), "phylum")


@query(f"WITH {GENOMES} SELECT count(*) AS n_genomes, count(DISTINCT phylum) AS n_phylum, count(DISTINCT class) AS n_class FROM g WHERE k % 9 = 0")
def unassigned_domain(spark, sf):
    g = genomes(spark, sf).withColumn("domain", F.when(F.col("taxid") % 9 == 0, F.when(F.col("taxid") % 2 == 0, "NA").otherwise("")).otherwise(F.col("domain")))
    return catalog.unassigned_domain(g, ("domain", "phylum", "class"))


_RANKS = " UNION ALL ".join(f"SELECT '{r}' AS rank, count(DISTINCT {c}) AS n_taxa, count(DISTINCT {c}) FILTER (refseq_category = 'reference genome') AS n_representative_taxa FROM g" for r, c in (("domain", "domain"), ("phylum", "phylum"), ("class", "class"), ("order", "nullif(1, 1)"), ("family", "nullif(1, 1)"), ("genus", "nullif(1, 1)"), ("species", "species")))


@query(f"WITH {GENOMES} {_RANKS}")
def counts_by_rank(spark, sf):
    return catalog.counts_by_rank(genomes(spark, sf), NCBI)


@query(f"WITH {GENOMES}, d AS (SELECT assembly_accession FROM g WHERE k % 3 = 0), f AS (SELECT DISTINCT phylum FROM g WHERE k % 500 = 1) SELECT assembly_accession FROM g WHERE assembly_accession NOT IN (SELECT assembly_accession FROM d) AND phylum IS NOT NULL AND phylum NOT IN (SELECT phylum FROM f WHERE phylum IS NOT NULL)")
def without_filled(spark, sf):
    g = genomes(spark, sf)
    x = catalog.without_filled(g, g.where("taxid % 3 = 0"), g.where("taxid % 500 = 1"), "assembly_accession", ["phylum"])
    return x.where(columns.is_assigned("phylum")).select("assembly_accession")


@query(f"WITH {GENOMES} SELECT count(*) AS n, count(DISTINCT phylum) AS n_groups, count(*) FILTER (k % 3 = 0) AS n_dead FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY phylum ORDER BY k) AS n FROM g WHERE k % 3 <> 0 AND phylum IS NOT NULL) WHERE n = 1)")
def live_draw(spark, sf):
    """One live genome of each group, whichever is drawn: the count of all, of groups and of dead ones."""
    g = genomes(spark, sf).where(columns.is_assigned("phylum")).select("assembly_accession", "phylum", "taxid")
    x = catalog.draw_live(g, g.where("taxid % 3 = 0").select("assembly_accession"), ["phylum"], "assembly_accession", 7, 1000)
    return x.agg(F.count("*").alias("n"), F.count_distinct("phylum").alias("n_groups"), F.count_if(F.col("taxid") % 3 == 0).alias("n_dead"))


def _assemblies(spark, sf):
    s = t(spark, sf, "supplier")
    status = F.when(F.col("s_suppkey") % 6 == 0, "suppressed").when(F.col("s_suppkey") % 6 == 1, "Replaced").otherwise("latest")
    return s.select(F.concat(F.lit("GCA_"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit(".2")).alias("assembly_accession"), F.col("s_nationkey").alias("taxid"), status.alias("version_status"))


@query("""WITH a AS (SELECT 'GCA_' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '.2' AS assembly_accession, s_suppkey AS k, s_nationkey AS taxid FROM supplier WHERE s_suppkey % 6 > 1),
 b AS (SELECT 'GCF_' || substr(assembly_accession, 5) AS assembly_accession, k, taxid FROM a) SELECT u.assembly_accession, u.taxid, n_name AS phylum, CASE WHEN k % 4 = 0 THEN CAST(k AS DOUBLE) END AS checkm_completeness FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u LEFT JOIN nation ON n_nationkey = u.taxid AND n_nationkey <> 3""")
def ncbi_catalog(spark, sf):
    a = _assemblies(spark, sf)
    both = [a, a.withColumn("assembly_accession", F.concat(F.lit("GCF_"), F.substring("assembly_accession", 5, 20)))]
    lineages = t(spark, sf, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").alias("taxid"), F.col("n_name").alias("phylum"))
    checkm = a.where("int(substring(assembly_accession, 5, 9)) % 4 = 0").select(F.concat(F.lit("RS_"), "assembly_accession").alias("accession"), F.substring("assembly_accession", 5, 9).cast("double").alias("checkm_completeness"))
    return catalog.build_ncbi_catalog(both, lineages, checkm).select("assembly_accession", "taxid", "phylum", "checkm_completeness")


@query("SELECT p_partkey, p_type AS domain, p_brand AS phylum, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END AS species FROM part")
def gtdb_catalog(spark, sf):
    p = t(spark, sf, "part")
    lineage = F.concat(F.lit("d__"), "p_type", F.lit(";p__"), "p_brand", F.lit(";c__;o__;f__;g__;s__"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")))
    x = p.select("p_partkey", lineage.alias("gtdb_taxonomy"))
    return catalog.build_gtdb_catalog([x.where("p_partkey % 2 = 0"), x.where("p_partkey % 2 = 1")], ["p_partkey"]).select("p_partkey", "domain", "phylum", "species")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'own' ELSE CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_brand END END AS phylum FROM supplier LEFT JOIN part ON p_partkey = s_suppkey")
def lineage_by_accession(spark, sf):
    rows = t(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("RS_GCF_"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit(".9")).alias("accession"), F.when(F.col("s_suppkey") % 5 == 0, "own").otherwise("NA").alias("phylum"))
    return catalog.add_lineage_by_accession(rows, genomes(spark, sf), ["assembly_accession"], ("phylum",)).select("s_suppkey", "phylum")


@query("SELECT s_suppkey, phylum FROM supplier LEFT JOIN (SELECT p_size AS size, min(p_brand) FILTER (p_partkey % 17 <> 0) AS phylum FROM part GROUP BY 1) ON size = s_nationkey")
def lineage_by_taxid(spark, sf):
    rows = t(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("taxid"))
    sizes = t(spark, sf, "part").select(F.col("p_partkey").alias("_k"), F.col("p_size").cast("long").alias("size"))
    g = genomes(spark, sf).join(sizes, F.col("taxid") == F.col("_k")).drop("taxid").withColumnRenamed("size", "taxid")
    return catalog.lineage_by_taxid(rows, g, ("phylum",)).select("s_suppkey", "phylum")


@query(f"WITH {GENOMES} SELECT assembly_accession FROM g WHERE comp >= 70 AND cont < 10")
def quality_floor(spark, sf):
    return catalog.quality_floor(genomes(spark, sf), NCBI).select("assembly_accession")


@query("SELECT DISTINCT p_type AS target FROM part UNION ALL SELECT 'Eukaryota'")
def targets_in_full(spark, sf):
    names = catalog.expand_targets(genomes(spark, sf), ["eukarya", "all", "All"])
    return spark.createDataFrame([(n,) for n in names], "target string")


@query(f"WITH {GENOMES} SELECT assembly_accession, class FROM (SELECT *, row_number() OVER (PARTITION BY domain, class ORDER BY {_KEY}) AS n FROM g WHERE domain = 'ECONOMY' AND phylum IS NOT NULL OR domain = 'ECONOMY') WHERE n = 1")
def references_of_taxon(spark, sf):
    """A domain by name in any case; auto is two ranks finer."""
    return catalog.select_references(genomes(spark, sf), NCBI, "economy", "domain").rows.select("assembly_accession", "class")


@query(f"WITH {GENOMES} SELECT assembly_accession FROM g WHERE comp >= 70 AND cont < 10 AND assembly_level = 'Chromosome'")
def references_without_derep(spark, sf):
    return catalog.select_references(genomes(spark, sf), NCBI, "all", derep="none", levels=["chromosome"]).rows.select("assembly_accession")


@query(f"WITH {GENOMES} SELECT assembly_accession, CASE WHEN k % 2 = 0 THEN CAST(50 AS DOUBLE) ELSE comp END AS completeness, cont AS contamination FROM g")
def quality_fallback(spark, sf):
    g = genomes(spark, sf).withColumn("checkm2_completeness", F.when(F.col("taxid") % 2 == 0, "50").otherwise(""))
    return catalog.with_quality(g).select("assembly_accession", "completeness", "contamination")


@query(f"WITH {GENOMES} SELECT assembly_accession AS accession, FALSE AS user_supplied, domain AS ncbi_domain, phylum AS ncbi_phylum, CAST(NULL AS VARCHAR) AS gtdb_domain FROM g")
def community_schema(spark, sf):
    x = catalog.community_rows(genomes(spark, sf), NCBI, False, "ncbi", "gtdb")
    return x.select("accession", "user_supplied", "ncbi_domain", "ncbi_phylum", "gtdb_domain")


@query("SELECT 'GCA_' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '.7' AS wanted, p_partkey AS taxid, p_name AS species FROM supplier JOIN part ON p_partkey = s_suppkey")
def community_catalog_rows(spark, sf):
    rows = t(spark, sf, "supplier").select(F.concat(F.lit("GCA_"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit(".7")).alias("accession"))
    return community.catalog_summary(rows, genomes(spark, sf), "assembly_accession").select("wanted", "taxid", "species")


_TRUTH = "x AS (SELECT s_suppkey AS accession, s_acctbal AS rel_abundance, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE n_name END AS g, r_name AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"


@query(f"WITH {_TRUTH} SELECT 'gtdb' AS taxonomy, g AS taxon, round(sum(rel_abundance), 2) AS abundance FROM x GROUP BY g UNION ALL SELECT 'ncbi', n, round(sum(rel_abundance), 2) FROM x GROUP BY n")
def truth_of_both(spark, sf):
    s = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    x = s.select(F.col("s_suppkey").alias("accession"), F.col("s_acctbal").alias("rel_abundance"), F.when(F.col("s_suppkey") % 4 == 0, "NA").otherwise(F.col("n_name")).alias("gtdb_phylum"), F.col("r_name").alias("ncbi_phylum"))
    both = community.truth_tables(x, ranks=("phylum",))
    out = [both[f"{k}_per_rank"].select(F.lit(k).alias("taxonomy"), "taxon", F.round("abundance", 2).alias("abundance")) for k in ("gtdb", "ncbi")]
    return out[0].unionByName(out[1])


@query("SELECT s_suppkey AS accession, round(s_acctbal / 7, 6) AS rel_abundance FROM supplier")
def reproducibility_rows(spark, sf):
    return community.reproducible(t(spark, sf, "supplier").select(F.col("s_suppkey").alias("accession"), (F.col("s_acctbal") / 7).alias("rel_abundance")))


@query("WITH s AS (SELECT s_suppkey AS k FROM supplier) SELECT k AS accession, k % 3 <> 0 AS came FROM s")
def downloads_reconciled(spark, sf):
    s = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("accession"))
    got, lost = community.reconciled(s, s.where("accession % 3 <> 0"))
    return got.withColumn("came", F.lit(True)).unionByName(lost.withColumn("came", F.lit(False)))


@query("SELECT doc_id AS genome, CAST(sum(length(text)) AS BIGINT) AS genome_size FROM documents GROUP BY 1")
def genome_sizes(spark, sf):
    return community.sizes_of(t(spark, sf, "documents").select(F.col("doc_id").alias("genome"), F.col("text").alias("seq")))


@query("SELECT s_suppkey AS genome, CAST(ceil(2.5 * (1 + s_suppkey % 3) * (100000 + s_suppkey) / 300.0) AS BIGINT) AS units FROM supplier")
def units_for_coverage(spark, sf):
    g = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("genome"), (F.col("s_suppkey") + 100_000).alias("genome_size"), (1.0 + F.col("s_suppkey") % 3).alias("weight"))
    return community.planned_units(g, median=2.5, paired=True, fragment=400).select("genome", "units")


# --- names, lineages ------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS core, CASE WHEN o_orderkey % 3 = 2 THEN 'x' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS digits,
 CASE o_orderkey % 3 WHEN 0 THEN 'RS_GCF_' WHEN 1 THEN 'GCA_' ELSE 'x' END || o_orderkey AS root FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT o_orderkey, '', 'x' || o_orderkey, 'x' || o_orderkey FROM orders WHERE o_orderkey % 3 = 2""")
def accession_keys(spark, sf):
    head = F.element_at(F.array(F.lit("RS_GCF_"), F.lit("GCA_"), F.lit("x")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    a = F.concat(head, F.col("o_orderkey").cast("string"), F.lit("."), (F.col("o_orderkey") % 4).cast("string"))
    return t(spark, sf, "orders").select("o_orderkey", columns.accession_core(a).alias("core"), columns.accession_digits(a).alias("digits"), columns.accession_root(a).alias("root"))


@query(r"""WITH x AS (SELECT p_partkey, p_name || ' (strain #' || p_size || ') / [' || p_brand || ']' AS n FROM part)
SELECT p_partkey, trim(regexp_replace(regexp_replace(n, '[\s/,#()\[\]]+', '_', 'g'), '_+', '_', 'g'), '_') AS safe, trim(regexp_replace(trim(n), '[^A-Za-z0-9.-]+', '-', 'g'), '-') AS stem FROM x""")
def safe_names(spark, sf):
    n = F.concat("p_name", F.lit(" (strain #"), F.col("p_size").cast("string"), F.lit(") / ["), "p_brand", F.lit("]"))
    return t(spark, sf, "part").select("p_partkey", columns.safe_name(n).alias("safe"), columns.taxon_stem(n).alias("stem"))


@query("""WITH x AS (SELECT s_suppkey, lpad(CAST(s_suppkey * 1234567 % 1000000000 AS VARCHAR), 9, '0') AS d FROM supplier)
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'https://h/all/A_' || d || '/A_' || d || '_genomic.fna.gz' WHEN s_suppkey % 3 = 1 THEN 'https://ftp.ncbi.nlm.nih.gov/genomes/all/GCA/' || substr(d, 1, 3) || '/' || substr(d, 4, 3) || '/' || substr(d, 7, 3) || '/GCA_' || d || '.1_ASM_' || s_suppkey || '/GCA_' || d || '.1_ASM_' || s_suppkey || '_genomic.fna.gz' END AS link FROM x""")
def download_links(spark, sf):
    d = F.lpad((F.col("s_suppkey") * 1234567 % 1_000_000_000).cast("string"), 9, "0")
    ftp = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("https://h/all/A_"), d)).otherwise("na")
    name = F.when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("ASM "), F.col("s_suppkey").cast("string")))
    return t(spark, sf, "supplier").select("s_suppkey", columns.download_link(ftp, F.concat(F.lit("GCA_"), d, F.lit(".1")), name).alias("link"))


@query("SELECT n, CAST(row_number() OVER (ORDER BY a, b) AS INTEGER) AS place FROM (SELECT DISTINCT 'contig' || (p_size % 7) || '_' || p_size AS n, p_size % 7 AS a, p_size AS b FROM part)")
def natural_order(spark, sf):
    from pyspark.sql.window import Window

    n = F.concat(F.lit("contig"), (F.col("p_size") % 7).cast("string"), F.lit("_"), F.col("p_size").cast("string"))
    x = t(spark, sf, "part").select(n.alias("n")).distinct()
    return x.select("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(columns.natural_key("n"))).alias("place"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN -1.5 WHEN o_orderkey % 4 = 1 THEN -1.5 ELSE o_totalprice END AS v FROM orders")
def numbers_or_default(spark, sf):
    v = F.when(F.col("o_orderkey") % 4 == 0, "NA").when(F.col("o_orderkey") % 4 == 1, " ").otherwise(F.col("o_totalprice").cast("string"))
    return t(spark, sf, "orders").select("o_orderkey", columns.number(v, -1.5).alias("v"))


@query("""SELECT p_partkey, p_type AS domain, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_brand END AS phylum, p_type || '_' || CASE WHEN p_size % 2 = 0 THEN 'NA' ELSE p_brand END || '_' || replace(p_name, ' ', '_') AS synthetic FROM part""")
def plain_lineages(spark, sf):
    line = F.concat("p_type", F.lit("; "), F.when(F.col("p_size") % 2 == 0, " ").otherwise(F.col("p_brand")), F.lit(";"), "p_name")
    d, p, c = columns.lineage_plain(line, ("domain", "phylum", "class"))
    return t(spark, sf, "part").select("p_partkey", d, p, columns.synthetic_taxid([d, p, c]).alias("synthetic"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 1 THEN NULL WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_partkey AS VARCHAR) END AS taxid, CASE WHEN p_size % 2 = 0 THEN 'domain' ELSE 'phylum' END AS rank FROM part""")
def classified_taxids(spark, sf):
    status = F.when(F.col("p_size") % 3 == 1, "no taxid assigned").otherwise("taxid assigned (1/1)")
    line = F.concat(F.lit("1;131567;"), F.when(F.col("p_size") % 5 == 0, "no support").otherwise(F.concat(F.col("p_partkey").cast("string"), F.lit("*"))))
    rank = F.when(F.col("p_size") % 2 == 0, "superkingdom").otherwise("phylum")
    return t(spark, sf, "part").select("p_partkey", columns.classified_taxid(status, line).alias("taxid"), columns.rank_name(rank).alias("rank"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'Eukarya' END AS domain, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_type END AS kingdom, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS phylum FROM part")
def marker_ranks(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 4 == 0, "unclassified_x").otherwise(F.col("p_type")).alias("kingdom"), F.when(F.col("p_size") % 3 == 0, "Unclassified_Fungi").otherwise(F.col("p_brand")).alias("phylum"))
    return p.select("p_partkey", *columns.marker_ranks("ITS", ["kingdom", "phylum"]))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'D' ELSE 'R1' END AS code FROM part")
def report_ranks(spark, sf):
    name = F.when(F.col("p_size") % 2 == 0, "  Bacteria").otherwise("  cellular organisms")
    return t(spark, sf, "part").select("p_partkey", columns.report_rank(F.lit("R1"), name).alias("code"))


# --- sequences and alignments by columns ------------------------------------------------------------------


_SHAPES = "x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_partkey % 5 AS h, 20 + CAST(l_quantity AS BIGINT) AS m, l_linenumber % 4 AS i, l_partkey % 3 AS d, l_orderkey % 2 AS nn, l_suppkey % 4 AS s FROM lineitem)"


@query(f"""WITH {_SHAPES}, c AS (SELECT *, CASE WHEN h > 0 THEN h || 'H' ELSE '' END || CASE WHEN s > 0 THEN s || 'S' ELSE '' END || m || 'M' || CASE WHEN i > 0 THEN i || 'I' ELSE '' END || '7=2X' || CASE WHEN d > 0 THEN d || 'D' ELSE '' END || CASE WHEN nn > 0 THEN '50N' ELSE '' END || '3M' AS cigar FROM x),
 o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, unnest(regexp_extract_all(cigar, '[0-9]+[A-Z=]')) AS op FROM c), p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(op[:-2] AS BIGINT) AS n, op[-1:] AS k FROM o)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(sum(n) FILTER (k IN ('M', 'I', 'D', '=', 'X')) AS BIGINT) AS aligned_columns, CAST(sum(n) FILTER (k IN ('M', 'I', '=', 'X')) AS BIGINT) AS query_aligned, count(*) FILTER (k IN ('I', 'D')) AS gap_events,
 CAST(coalesce(sum(n) FILTER (k = 'S'), 0) AS BIGINT) AS soft_clipped, CAST(coalesce(sum(n) FILTER (k = 'H'), 0) AS BIGINT) AS hard_clipped, CAST(sum(n) FILTER (k IN ('M', 'I', '=', 'X', 'S', 'H')) AS BIGINT) AS full_length,
 round(100.0 * (sum(n) FILTER (k IN ('M', 'I', 'D', '=', 'X')) - 4) / sum(n) FILTER (k IN ('M', 'I', 'D', '=', 'X')), 6) AS pid_gap_aware, round(100.0 * (sum(n) FILTER (k IN ('M', 'I', 'D', '=', 'X')) - 4) / (sum(n) FILTER (k IN ('M', '=', 'X')) + count(*) FILTER (k IN ('I', 'D'))), 6) AS pid_gap_compressed
FROM p GROUP BY ALL""")
def cigar_shapes(spark, sf):
    """CIGAR strings of many shapes, parsed by SQL too."""

    def part(n, op):
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(op))).otherwise("")

    c = F.col
    cigar = F.concat(part(c("l_partkey") % 5, "H"), part(c("l_suppkey") % 4, "S"), part(20 + c("l_quantity").cast("long"), "M"), part(c("l_linenumber") % 4, "I"), F.lit("7=2X"), part(c("l_partkey") % 3, "D"), F.when(c("l_orderkey") % 2 > 0, "50N").otherwise(""), F.lit("3M"))
    x = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", cigar.alias("cigar"), F.lit(4).alias("nm"))
    y = columns.with_cigar(x).drop("cigar", "nm")
    return y.withColumns({k: F.round(k, 6) for k in ("pid_gap_aware", "pid_gap_compressed")})


@query("""SELECT l_orderkey, l_linenumber, l_partkey, 100.0 * greatest(least(l_linenumber * 10 + 30, 60 + CAST(l_quantity AS BIGINT)) - greatest(l_linenumber * 10, 40) + 1, 0) / least(31, 21 + CAST(l_quantity AS BIGINT)) AS overlap, round(100.0 * l_quantity / 50, 6) AS subject, 'r' || l_orderkey || CASE l_partkey % 3 WHEN 0 THEN '/1' WHEN 1 THEN '/2' ELSE '' END AS name,
 l_partkey % 3 < 2 AND l_suppkey % 2 = 0 AS usable, CASE l_partkey % 4 WHEN 0 THEN 'A' || l_linenumber || 'R' WHEN 1 THEN 'A' || l_linenumber || 'del' WHEN 2 THEN 'ins' || l_linenumber || ':R' ELSE 'fs' || l_linenumber || 'R' END AS mutation FROM lineitem""")
def alignment_scalars(spark, sf):
    c = F.col
    kind = F.element_at(F.array(*map(F.lit, ("sub", "del", "ins", "fs"))), (c("l_partkey") % 4 + 1).cast("int"))
    flag = F.element_at(F.array(F.lit(0x41), F.lit(0x81), F.lit(0x100)), (c("l_partkey") % 3 + 1).cast("int")).bitwiseOR(F.when(c("l_suppkey") % 2 == 0, 0).otherwise(0x4))
    q = c("l_quantity").cast("long")
    over = columns.overlap_of_shorter(c("l_linenumber") * 10, c("l_linenumber") * 10 + 30, F.lit(40), 60 + q)
    return t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        (100.0 * over).alias("overlap"),
        F.round(columns.subject_coverage("l_quantity", F.lit(50)), 6).alias("subject"),
        columns.mate_name(F.concat(F.lit("r"), c("l_orderkey").cast("string")), flag).alias("name"),
        columns.usable_alignment(flag).alias("usable"),
        columns.mutation_text(kind, F.lit("A"), "l_linenumber", F.lit("R")).alias("mutation"),
    )


@query("""SELECT doc_id, round(coalesce(length(regexp_replace(text, '[ACGTacgt]', '', 'g')) / nullif(length(text), 0), 0), 9) AS other, CASE WHEN length(text) >= 400 THEN CAST((length(text) - 400) // 200 + 1 AS INTEGER) ELSE 0 END AS windows,
 CASE WHEN length(text) >= 400 THEN round(length(regexp_replace(substr(text, 1, 400), '[^GC]', '', 'g')) / 400.0, 9) END AS first_gc FROM documents""")
def sequence_windows(spark, sf):
    w = columns.sliding_gc("text", 400, 200)
    x = t(spark, sf, "documents").select("doc_id", F.round(columns.non_acgt_fraction("text"), 9).alias("other"), w.alias("w"))
    return x.select("doc_id", "other", F.size("w").alias("windows"), F.round(F.get("w", F.lit(0))["gc"], 9).alias("first_gc"))


@query("SELECT conv_id, max(turn) AS last_turn, count(*) AS n FROM conversations GROUP BY 1")
def report_lines_per_sample(spark, sf):
    """Reports of many samples as one table by union, the sample first."""
    c = t(spark, sf, "conversations")
    names = ["user", "assistant", "system", "tool"]
    u = reports.union_of_samples([(n, c.where(F.col("role") == n).select("conv_id", "turn")) for n in names] + [("none", None), ("rest", c.where(~F.col("role").isin(*names)).select("conv_id", "turn"))])
    return u.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("n"))

