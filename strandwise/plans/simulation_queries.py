"""Random draws can't be foretold by SQL, but what must hold of them can: counts, bounds, and that sequences come from where they
say. Each query draws over a whole table and checks every draw against its source; the SQL states the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import reverse_complement
from ..operators import catalog, community, intervals, sequences
from ..shared import checkpoint
from .catalog_queries import _loci, query, t


@query("SELECT count(DISTINCT p_brand) AS n, count(DISTINCT p_brand) AS n_groups, count(DISTINCT p_brand) FILTER (p_size > 40) AS n_preferred FROM part")
def groups_drawn(spark, sf):
    """One part a brand, a preferred one wherever there is one."""
    x = catalog.random_per_group(t(spark, sf, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_partkey", 42, None, F.col("p_size") > 40)
    return x.agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("n_groups"), F.count_if(F.col("p_size") > 40).alias("n_preferred"))


def _contigs(spark, sf):
    return t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("contig"), F.translate("text", "nN", "aA").alias("seq"), F.lit(3).alias("units"))


def _from_source(reads, contigs, start="start", end="end"):
    """reads with ``ok``: the sequence is that of its place, over the origin if it runs past the end, on its strand."""
    s = contigs.select(F.col("contig").alias("_c"), F.col("seq").alias("_s"))
    x = reads.join(s, F.col("contig") == F.col("_c"))
    size = (F.col(end) - F.col(start)).cast("int")
    piece = F.substring(F.col("_s"), (F.col(start) + 1).cast("int"), size)
    piece = F.concat(piece, F.substring(F.col("_s"), F.lit(1), size - F.length(piece)))
    return x.withColumn("ok", F.col("seq") == F.when(F.col("strand") == "+", piece).otherwise(reverse_complement(piece)))


@query("SELECT CAST(doc_id AS VARCHAR) AS contig, CAST(3 AS BIGINT) AS n, CAST(3 AS BIGINT) AS n_ids, TRUE AS ok, CAST(100 AS INTEGER) AS shortest, CAST(100 AS INTEGER) AS longest FROM documents WHERE length(text) >= 100")
def reads_from_their_source(spark, sf):
    c = _contigs(spark, sf)
    x = _from_source(sequences.sample_reads(c, 100, 7, circular=True), c)
    n = F.length("seq")
    return x.groupBy("contig").agg(F.count("*").alias("n"), F.count_distinct("read_id").alias("n_ids"), F.min("ok").alias("ok"), F.min(n).alias("shortest"), F.max(n).alias("longest"))


@query("SELECT CAST(doc_id AS VARCHAR) AS contig, CAST(3 AS BIGINT) AS n, TRUE AS ok, TRUE AS inside, TRUE AS long_enough FROM documents WHERE length(text) > 0")
def fragments_from_their_source(spark, sf):
    """Linear contigs: nothing runs past the end, and only the end of a contig makes a fragment shorter than the least."""
    c = _contigs(spark, sf)
    x = _from_source(community.sample_fragments(c, 11, 120.0, 20.0, 60), c)
    inside = (F.col("start") >= 0) & (F.col("end") <= F.length("_s"))
    enough = (F.length("seq") >= 60) | (F.col("end") == F.length("_s"))
    return x.groupBy("contig").agg(F.count("*").alias("n"), F.min("ok").alias("ok"), F.min(inside).alias("inside"), F.min(enough).alias("long_enough"))


@query("SELECT CAST(doc_id AS VARCHAR) AS contig, CAST(4 AS BIGINT) AS n, CAST(2 AS BIGINT) AS n_first, TRUE AS ok, CAST(0 AS BIGINT) AS alike FROM documents WHERE length(text) > 0")
def mates_from_their_source(spark, sf):
    """Two mates of each of two fragments of a circular contig, on opposite strands."""
    c = _contigs(spark, sf).withColumn("units", F.lit(2))
    m = community.mates(community.sample_fragments(c, 5, 200.0, 30.0, 75, circular=True, allow_n=True), 75)
    # a mate of a wrapped fragment may begin beyond the origin
    turned = _from_source(m.join(c.select(F.col("contig").alias("_k"), F.length("seq").alias("_n")), F.col("contig") == F.col("_k")).withColumn("start", F.col("start") % F.col("_n")).withColumn("end", F.col("start") + F.length("seq")), c)
    pair = F.substring_index("read_id", "/", 1)
    alike = turned.groupBy("contig", pair.alias("p")).agg((F.count_distinct("strand") < 2).alias("a")).groupBy(F.col("contig").alias("_q")).agg(F.count_if("a").alias("alike"))
    g = turned.groupBy("contig").agg(F.count("*").alias("n"), F.count_if(F.col("mate") == 1).alias("n_first"), F.min("ok").alias("ok"))
    return g.join(alike, F.col("contig") == F.col("_q")).drop("_q")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, least(CAST(round_even(length(text) * 0.05, 0) AS BIGINT), CAST(length(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS BIGINT)) AS substitutions, least(CAST(round_even(length(text) * 0.05, 0) AS BIGINT), CAST(length(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS BIGINT)) AS changed, CAST(length(text) AS BIGINT) AS n FROM documents")
def mutations_counted(spark, sf):
    """Exactly the rounded share of letters differs, each at a place of its own, and no letter comes or goes."""
    d = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("seq"), F.col("text").alias("was"))
    x = sequences.mutate(d, 0.05, 3)
    pairs = F.arrays_zip(F.split("seq", "").alias("a"), F.split("was", "").alias("b"))
    changed = F.size(F.filter(pairs, lambda p: p["a"] != p["b"])).cast("long")
    return x.select("id", "substitutions", changed.alias("changed"), F.length("seq").cast("long").alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS different, TRUE AS positive, TRUE AS centred FROM part")
def weights_drawn(spark, sf):
    """A lognormal(0, 1) weight each: all different, positive, half of them near enough below one."""
    x = community.abundance_weights(t(spark, sf, "part").select("p_partkey"), "p_partkey", 3, 1.0)
    share = F.avg((F.col("weight") < 1).cast("int"))
    return x.agg(F.count("*").alias("n"), F.count_distinct("weight").alias("different"), (F.min("weight") > 0).alias("positive"), F.abs(share - 0.5).between(0, 0.1).alias("centred"))


@query("WITH d AS (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE contains(text, 'tioned')) SELECT CAST(doc_id AS VARCHAR) AS id, CAST(i - 1 AS INTEGER) AS start FROM d WHERE substr(text, i, 6) = 'tioned'")
def primer_places_without_edits(spark, sf):
    """Of the approximate places those that spell the primer: where a text has such, they are the best, and none is missed."""
    d = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("seq"))
    h = sequences.primer_hits(d, "tioned", "ations", 1)
    s = d.select(F.col("id").alias("_i"), F.col("seq").alias("_s"))
    x = h.join(s, F.col("id") == F.col("_i")).where(F.substring("_s", F.col("start") + 1, F.col("end") - F.col("start")) == "tioned")
    return x.select("id", "start")


@query("SELECT CAST(l_suppkey AS VARCHAR) AS contig, count(*) AS members, min(CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT)) AS first, max(CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) + CAST(l_quantity AS BIGINT)) AS last FROM lineitem GROUP BY 1")
def regions_keep_their_loci(spark, sf):
    """Every locus is in one region, and the regions of a contig span all of its loci."""
    r = intervals.resolve_regions(_loci(spark, sf).withColumn("contig", F.col("contig").cast("string")))
    return r.groupBy("contig").agg(F.sum("members").alias("members"), F.min("start").alias("first"), F.max("end").alias("last"))


@query("SELECT doc_id % 5 AS genome, CAST(2000 AS BIGINT) AS total, TRUE AS same FROM documents GROUP BY 1")
def community_phases(spark, sf):
    """Five genomes of documents, mutated, read and told apart: reads add up to what was asked for, and truth says the same."""
    d = t(spark, sf, "documents")
    k = (F.col("doc_id") % 5).cast("string")
    c = d.select(k.alias("genome"), F.col("doc_id").cast("string").alias("contig"), F.translate("text", "nN", "aA").alias("seq"))
    g = c.select("genome").distinct().withColumn("phylum", F.concat(F.lit("p"), "genome"))
    made, again = community.run_community(g, c, 3, 2000, 0.01, read_length=50, sigma=0.5, paired=True, fragment=120.0, fragment_sd=10.0, ranks=("phylum",))
    n = made.reads.groupBy("genome").agg(F.count("*").alias("_n"))
    x = checkpoint(made.truth).join(n, "genome").join(again.withColumnRenamed("rel_abundance", "_again"), "genome")
    total = x.agg(F.sum("_n").alias("total"))
    x = x.join(F.broadcast(total)).withColumn("same", (F.col("_n") == F.col("reads")) & (F.abs(F.col("_again") - F.col("rel_abundance")) < 1e-6))
    return x.select(F.col("genome").cast("long").alias("genome"), "total", "same")
