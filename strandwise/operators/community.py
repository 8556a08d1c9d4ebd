"""Simulated communities: weights, read counts, fragments and mates, ground truth.

Every random choice is a hash of (seed, keys), so results depend neither on partitions nor on the order of execution.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import coverage_of_units, reverse_complement, units_for_coverage
from ..schema import RANKS
from ..shared import checkpoint
from . import stats
from .sequences import drawn, uniform


def gaussian(seed: int, *cols: Column) -> Column:
    """A standard normal deviate from two hashed uniforms (Box-Muller)."""
    u, v = uniform(seed, *cols), uniform(seed + 1, F.lit("normal"), *cols)
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * math.pi * v)


def abundance_weights(genomes: DataFrame, key: str, seed: int, sigma: float | None = None) -> DataFrame:
    """``weight`` of each genome: 1, or with sigma a lognormal(0, sigma) draw."""
    w = F.lit(1.0) if sigma is None else F.exp(sigma * gaussian(seed, F.col(key)))
    return genomes.withColumn("weight", w)


def units_by_share(genomes: DataFrame, total: int, share: str = "rel_abundance", size: str = "genome_size", key: str = "genome", paired: bool = False) -> DataFrame:
    """``total`` reads dealt by abundance times genome size, by largest remainder; an even count each with ``paired``, where an
    odd total is rounded up."""
    x = genomes.withColumn("_bases", F.col(share) * F.col(size))
    return stats.apportion(x, "_bases", [key], total + total % 2 if paired else total, even=paired).drop("_bases")


def units_by_coverage(genomes: DataFrame, median: float, read_length: int, paired: bool = False, fragment: int | None = None, size: str = "genome_size") -> DataFrame:
    """Reads for a coverage of ``median`` times the weight, and the coverage that they give."""
    x = genomes.withColumn("units", units_for_coverage(F.lit(float(median)) * F.col("weight"), F.col(size), read_length, paired, fragment))
    return x.withColumn("planned_coverage", coverage_of_units(F.col("units"), F.col(size), read_length, paired, fragment))


def sample_fragments(refs: DataFrame, seed: int, mean: float, sd: float = 0.0, least: int = 1, most: int | None = None, circular: bool = False, allow_n: bool = False, tries: int = 100, units: str = "units") -> DataFrame:
    """Fragments of refs(contig, seq, units): a clamped Gaussian length, a uniform place, a strand by coin.

    A linear contig that is shorter than the length gives what follows the place. A place whose bases hold N is drawn again, up
    to ``tries`` times; the last one stays. Fragments of circular contigs run over the origin. Null and empty sequences and counts
    give none. ``start``/``end`` are 0-based, half-open, on the forward strand; ``seq`` is read on ``strand``.
    """
    n = F.length("seq")
    contig, seq = F.col("contig"), F.col("seq")

    def bases(at: Column, size: Column) -> Column:
        piece = F.substring(seq, at + 1, size)
        return F.concat(piece, F.substring(seq, F.lit(1), size - F.length(piece))) if circular else piece

    def one(i: Column) -> Column:
        size = F.greatest(F.round(mean + sd * gaussian(seed, contig, i)).cast("int"), F.lit(least))
        size = size if most is None else F.least(size, F.lit(most))
        size = F.least(size, n) if circular else size
        places = n if circular else F.when(size >= n, n).otherwise(n - size + 1)

        def start(j: Column) -> Column:
            return F.floor(uniform(seed + 2, contig, i, j) * places).cast("int")

        if allow_n:
            at = start(F.lit(0))
        else:
            good = F.aggregate(F.sequence(F.lit(0), F.lit(tries - 1)), F.lit(None).cast("int"), lambda a, j: F.coalesce(a, F.when(~F.contains(F.upper(bases(start(j), size)), F.lit("N")), start(j))))
            at = F.coalesce(good, start(F.lit(tries - 1)))
        strand = F.when(uniform(seed + 3, contig, i) < 0.5, "+").otherwise("-")
        return F.struct(i.alias("number"), at.alias("start"), bases(at, size).alias("_seq"), strand.alias("strand"))

    x = drawn(refs.where((F.col(units) > 0) & (n > 0)), units, one).select("contig", "_n", "r.*")
    x = x.withColumn("end", F.col("start") + F.length("_seq")).withColumn("wrapped", F.col("end") > F.col("_n"))
    name = F.concat_ws("_", F.lit("read"), "contig", F.col("number").cast("string"))
    turned = F.when(F.col("strand") == "+", F.col("_seq")).otherwise(reverse_complement("_seq"))
    return x.select(name.alias("read_id"), "contig", "number", "start", "end", "strand", "wrapped", turned.alias("seq"))


def mates(fragments: DataFrame, read_length: int) -> DataFrame:
    """Both mates of each fragment, ``mate`` 1 and 2, each with its own span on the forward strand.

    Mate 1 reads the fragment from its front, mate 2 the opposite strand from its back; on the minus strand mate 1 so covers the
    high end. A fragment shorter than a read gives shorter mates. ``wrapped`` is the fragment's.
    """
    size = F.col("end") - F.col("start")
    n = F.least(size, F.lit(read_length))
    low = F.struct(F.col("start").alias("start"), (F.col("start") + n).alias("end"))
    high = F.struct((F.col("end") - n).alias("start"), F.col("end").alias("end"))
    plus = F.col("strand") == "+"
    one = F.struct(F.lit(1).alias("mate"), F.when(plus, low).otherwise(high).alias("at"), F.substring("seq", F.lit(1), n).alias("seq"), F.col("strand").alias("strand"))
    two = F.struct(F.lit(2).alias("mate"), F.when(plus, high).otherwise(low).alias("at"), reverse_complement(F.substring("seq", size - n + 1, n)).alias("seq"), F.when(plus, "-").otherwise("+").alias("strand"))
    x = fragments.select("read_id", "contig", "wrapped", F.explode(F.array(one, two)).alias("m"))
    name = F.concat_ws("/", "read_id", F.col("m.mate").cast("string"))
    return x.select(name.alias("read_id"), "contig", F.col("m.mate").alias("mate"), F.col("m.at.start").alias("start"), F.col("m.at.end").alias("end"), F.col("m.strand").alias("strand"), "wrapped", F.col("m.seq").alias("seq"))


def read_truth(reads: DataFrame, genomes: DataFrame, key: str = "genome", ranks: tuple[str, ...] = RANKS) -> DataFrame:
    """Every read with its genome's lineage; reads of unknown genomes stay, with nulls."""
    return reads.join(genomes.select(key, *ranks), key, "left")


def genome_truth(genomes: DataFrame, reads: DataFrame, mutations: DataFrame | None = None, key: str = "genome") -> DataFrame:
    """One row a genome (key, genome_size) with what was really drawn from reads(key, start, end): reads, bases, coverage and
    relative abundance, and the mutations made; genomes without any have 0. Coverage and abundance of an empty genome are null."""
    drawn = reads.groupBy(key).agg(F.count("*").alias("reads"), F.sum((F.col("end") - F.col("start")).cast("long")).alias("bases"))
    x = genomes.join(drawn, key, "left").na.fill(0, ["reads", "bases"])
    if mutations is not None:
        made = mutations.groupBy(key).agg(F.sum("substitutions").alias("substitutions"), F.sum("indels").alias("indels"))
        x = x.join(made, key, "left").na.fill(0, ["substitutions", "indels"])
    return stats.realized(x)


@dataclass(frozen=True)
class Community:
    """The lazy results of one simulation; nothing is computed before a result is written."""

    genomes: DataFrame
    reads: DataFrame
    truth: DataFrame
    per_read: DataFrame


def simulate(genomes: DataFrame, contigs: DataFrame, seed: int, total: int, read_length: int = 150, sigma: float | None = None, paired: bool = True, fragment: float = 500.0, fragment_sd: float = 50.0, circular: bool = False, ranks: tuple[str, ...] = RANKS) -> Community:
    """Reads and ground truth of a community from genomes(genome, ranks, optional pin) and contigs(genome, contig, seq).

    Pinned shares come off the top, the rest is split by weight. A genome's fragments are split over its contigs by length. A
    genome without bases gets no reads.
    """
    lengths = contigs.select("genome", "contig", F.length("seq").cast("long").alias("length"))
    sizes = lengths.groupBy("genome").agg(F.sum("length").alias("genome_size"))
    g = abundance_weights(genomes if "pin" in genomes.columns else genomes.withColumn("pin", F.lit(None).cast("double")), "genome", seed, sigma).join(sizes, "genome")
    g = units_by_share(stats.relative_abundance(g).withColumnRenamed("rel_abundance", "planned_abundance"), total, "planned_abundance", paired=paired)
    g = checkpoint(g)  # a row a genome, which everything below starts from
    each = F.col("units") / 2 if paired else F.col("units")
    per_contig = stats.split_by_length(lengths.join(g.select("genome", each.alias("_u")), "genome"), "_u", "length", ["contig"], ["genome"])
    named = F.struct("genome", "contig")
    refs = contigs.join(per_contig.select("genome", "contig", F.col("share").alias("units")), ["genome", "contig"]).select(F.to_json(named).alias("contig"), "seq", "units")
    got = sample_fragments(refs, seed, fragment if paired else read_length, fragment_sd if paired else 0.0, read_length, None, circular)
    got = mates(got, read_length) if paired else got
    back = F.from_json("contig", "genome string, contig string")
    reads = got.withColumn("_c", back).withColumn("genome", F.col("_c.genome")).withColumn("contig", F.col("_c.contig")).drop("_c")
    reads = reads.withColumn("read_id", F.concat_ws("_", "genome", "contig", F.regexp_extract("read_id", r"_(\d+(?:/[12])?)$", 1)))
    return Community(g, reads, genome_truth(g, reads), read_truth(reads.drop("seq"), g, "genome", ranks))


def planned_units(genomes: DataFrame, total: int | None = None, median: float | None = None, read_length: int = 150, paired: bool = False, fragment: int | None = None) -> DataFrame:
    """Reads of each genome by abundance (``total``) or by coverage (``median``, times the weight); exactly one is to be given."""
    if (total is None) == (median is None):
        raise ValueError("give either a number of reads or a coverage")
    if total is not None:
        return units_by_share(genomes, total, paired=paired)
    return units_by_coverage(genomes, median, read_length, paired, fragment)


def sizes_of(seqs: DataFrame, key: str = "genome") -> DataFrame:
    """(genome, genome_size) of seqs(genome, seq)."""
    return seqs.groupBy(key).agg(F.sum(F.length("seq").cast("long")).alias("genome_size"))


def reconciled(selected: DataFrame, fetched: DataFrame, key: str = "accession") -> tuple[DataFrame, DataFrame]:
    """(selected rows whose file came, accessions whose file didn't)."""
    return selected.join(fetched.select(key), key, "left_semi"), selected.select(key).join(fetched.select(key), key, "left_anti")


def truth_tables(truth: DataFrame, taxonomies: tuple[str, ...] = ("gtdb", "ncbi"), ranks: tuple[str, ...] = RANKS, value: str = "rel_abundance") -> dict[str, DataFrame]:
    """Per taxonomy the truth per genome with that taxonomy's ranks under plain names, and the abundance per rank and taxon."""
    out = {}
    for t in taxonomies:
        others = [f"{o}_{r}" for o in taxonomies for r in ranks]
        plain = truth.select(*(c for c in truth.columns if c not in others), *(F.col(f"{t}_{r}").alias(r) for r in ranks))
        out[t] = plain
        out[f"{t}_per_rank"] = stats.truth_per_rank(plain, list(ranks), value)
    return out


def reproducible(genomes: DataFrame, value: str = "rel_abundance", key: str = "accession") -> DataFrame:
    """(accession, rel_abundance) with six decimals, to be given as pins another time."""
    return genomes.select(key, F.round(value, 6).alias("rel_abundance"))


def catalog_summary(rows: DataFrame, catalog: DataFrame, accession: str) -> DataFrame:
    """The first catalog row, by accession, of each of the community's accession cores."""
    from ..functions.columns import accession_core

    first = catalog.withColumn("_core", accession_core(accession)).where("_core <> ''").groupBy("_core").agg(F.min_by(F.struct(*catalog.columns), accession).alias("_r"))
    wanted = rows.select(F.col("accession").alias("wanted"), accession_core("accession").alias("_w")).distinct()
    return wanted.join(first, F.col("_w") == F.col("_core")).select("wanted", "_r.*")


def run_community(genomes: DataFrame, contigs: DataFrame, seed: int, total: int, mutation_rate: float = 0.0, **reads) -> tuple[Community, DataFrame]:
    """The phases after selection: sequences mutated if asked for, then sizes, abundance, reads and truth (see ``simulate``), and the
    table that reproduces the abundances."""
    from .sequences import mutate

    made = None
    if mutation_rate:
        named = F.to_json(F.struct("genome", "contig"))
        changed = checkpoint(mutate(contigs.select(named.alias("id"), "genome", "contig", "seq"), mutation_rate, seed))
        contigs, made = changed.select("genome", "contig", "seq"), changed.groupBy("genome").agg(F.sum("substitutions").alias("substitutions"), F.sum("indels").alias("indels"))
    c = simulate(genomes, contigs, seed, total, **reads)
    truth = genome_truth(c.genomes, c.reads, made) if made is not None else c.truth
    return Community(c.genomes, c.reads, truth, c.per_read), reproducible(truth, key="genome")
