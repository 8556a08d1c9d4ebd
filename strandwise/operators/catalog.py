"""Selection and dereplication over genome catalogs: one filtered pool feeds counts, lists and picks alike."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import accession_core, accession_root, assigned, col, is_assigned, normalize_taxon, number
from ..schema import RANKS, CatalogSpec

LEVELS = {"complete": "Complete Genome", "chromosome": "Chromosome", "scaffold": "Scaffold", "contig": "Contig"}
LEVEL_SCORE = {"Complete Genome": 4, "Chromosome": 3, "Scaffold": 2, "Contig": 1}


@dataclass(frozen=True)
class Selection:
    """Selected rows, the rank and spelling of their taxon, and what the user should know."""

    rows: DataFrame
    taxon: str
    rank: str | None
    derep_rank: str | None = None
    notes: tuple[str, ...] = ()


class TaxonNotFound(ValueError):
    pass


class AmbiguousTaxon(ValueError):
    pass


def pool(df: DataFrame, spec: CatalogSpec, rank: str | None = None, taxon: str | None = None, representatives: bool = False, levels: list[str] | None = None, prefix: str | None = None, domains: list[str] | None = None) -> DataFrame:
    """Rows of a catalog under all filters; each becomes a pushed Parquet predicate."""
    if rank is not None and rank not in RANKS:
        raise ValueError(f"unknown rank {rank}")
    if rank is not None and taxon is not None:
        df = df.where(F.col(rank) == normalize_taxon(taxon))
    if representatives:
        df = df.where(F.col(spec.representative) == spec.representative_value)
    if levels and spec.level:
        unknown = [x for x in levels if x.lower() not in LEVELS]
        if unknown:
            raise ValueError(f"unknown assembly levels {unknown}; known: {sorted(LEVELS)}")
        df = df.where(F.col(spec.level).isin(*(LEVELS[x.lower()] for x in levels)))
    if prefix and prefix != "both":
        df = df.where(F.col(spec.accession).startswith({"refseq": "GCF_", "genbank": "GCA_"}[prefix.lower()]))
    if domains:
        df = df.where(F.col("domain").isin(*domains))
    return df


def resolve_taxon(df: DataFrame, name: str, rank: str | None = None) -> tuple[str, str]:
    """(canonical spelling, rank) of a taxon named in any case; all ranks are looked up in one scan."""
    want = normalize_taxon(name).lower()
    ranks = (rank,) if rank else RANKS
    hits = df.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rank"), F.col(r).alias("name")) for r in ranks))).alias("x")).where(F.lower("x.name") == want).select("x.*").distinct().collect()
    found = sorted({(h["name"], h["rank"]) for h in hits if h["name"] not in ("NA", "")}, key=lambda x: RANKS.index(x[1]))
    if not found:
        raise TaxonNotFound(name)
    if len({r for _, r in found}) > 1:
        raise AmbiguousTaxon(f"{name} is a taxon at {', '.join(r for _, r in found)}; give a rank")
    return found[0]


def resolve_derep_rank(target: str, derep: str | None) -> str | None:
    """'auto' is two ranks finer, at most species; none if that is the target itself."""
    if derep in (None, "none"):
        return None
    if derep == "auto":
        out = RANKS[min(RANKS.index(target) + 2, len(RANKS) - 1)]
        if out == target:
            warnings.warn("nothing finer to dereplicate at", stacklevel=2)
            return None
        return out
    if derep not in RANKS:
        raise ValueError(f"unknown rank {derep}")
    if RANKS.index(derep) < RANKS.index(target):
        raise ValueError(f"{derep} is coarser than {target}")
    return derep


def quality_key(spec: CatalogSpec) -> list[Column]:
    """Ascending sort key, the best genome first; the accession breaks ties."""
    comp, cont = number(spec.completeness), number(spec.contamination)
    reference = F.coalesce(F.col(spec.reference) == spec.reference_value, F.lit(False))
    trusted = reference & (comp.isNull() | ((comp >= 85) & (cont.isNull() | (cont <= 10))))
    size = number(spec.size)
    if spec.fallback_size:
        size = F.coalesce(size, number(spec.fallback_size))
    contigs = number(spec.contigs)
    level = F.lit(0)
    if spec.level:
        level = -F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LEVEL_SCORE.items() for x in kv)), F.col(spec.level)), F.lit(0))
    return [
        F.when(trusted, 0).otherwise(1),
        F.when(comp.isNotNull(), 0).otherwise(1),
        -F.coalesce(comp, F.lit(0.0)),
        F.when(comp.isNull(), 0.0).otherwise(F.coalesce(cont, F.lit(float("inf")))),
        level,
        -F.when((contigs > 0) & (size > 0), size / contigs).otherwise(0.0),
        F.col(spec.accession),
    ]


def best_per_group(df: DataFrame, group: list[str | Column], key: list[Column], columns: list[str] | None = None) -> DataFrame:
    """The row of each group with the smallest key: one partial aggregate, no sort and no window."""
    columns = columns or df.columns
    names = [f"_g{i}" for i in range(len(group))]
    order = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(key)))
    x = df.groupBy(*(col(g).alias(n) for g, n in zip(group, names, strict=True))).agg(F.min_by(F.struct(*columns), order).alias("r"))
    return x.select("r.*")


def dereplicate(df: DataFrame, spec: CatalogSpec, rank: str, key: list[Column] | None = None) -> DataFrame:
    """Best genome of each taxon at a rank within its domain; rows unassigned there are skipped."""
    group = ["domain", rank] if rank != "domain" else ["domain"]
    return best_per_group(df.where(is_assigned(rank)), group, key or quality_key(spec))


def first_per_group(df: DataFrame, group: list[str], by: str) -> DataFrame:
    return best_per_group(df, group, [F.col(by)])


def taxon_count(df: DataFrame, rank: str) -> DataFrame:
    return df.agg(F.countDistinct(assigned(rank)).alias("n_taxa"))


def taxa(df: DataFrame, rank: str) -> DataFrame:
    return df.where(is_assigned(rank)).select(rank).distinct().orderBy(rank)


def rank_counts(df: DataFrame, ranks: tuple[str, ...] = RANKS) -> DataFrame:
    """(rank, n_taxa) for each rank, from one scan."""
    one = df.agg(*(F.countDistinct(assigned(r)).alias(r) for r in ranks))
    return one.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rank"), F.col(r).alias("n_taxa")) for r in ranks))).alias("x")).select("x.*")


def derep_size(df: DataFrame, rank: str) -> DataFrame:
    """Rows that dereplicate() would return."""
    return df.where(is_assigned(rank)).agg(F.count_distinct(F.struct(F.coalesce(F.col("domain"), F.lit("")), F.col(rank))).alias("n_selected"))


def unassigned_domain(df: DataFrame, ranks: tuple[str, ...] = RANKS) -> DataFrame:
    x = df.where(~is_assigned("domain"))
    return x.agg(F.count("*").alias("n_genomes"), *(F.countDistinct(assigned(r)).alias(f"n_{r}") for r in ranks[1:]))


def random_per_group(df: DataFrame, group: list[str], key: str, seed: int, n: int | None = None, first: Column | None = None) -> DataFrame:
    """One row a group drawn by a seeded hash, rows with ``first`` true preferred; n groups drawn by another hash."""
    h = F.xxhash64(F.lit(seed), key)
    out = best_per_group(df, group, [F.when(first, 0).otherwise(1) if first is not None else F.lit(0), h, F.col(key)])
    return out if n is None else out.orderBy(F.xxhash64(F.lit(seed + 1), key), key).limit(n)


def alive(df: DataFrame, key: Column, known: DataFrame, known_key: Column) -> DataFrame:
    return df.join(known.select(known_key.alias("_k")), key == F.col("_k"), "left_semi")


def dead(df: DataFrame, key: Column, known: DataFrame, known_key: Column) -> DataFrame:
    return df.join(known.select(known_key.alias("_k")), key == F.col("_k"), "left_anti")


def draw_live(df: DataFrame, dead_keys: DataFrame, group: list[str], key: str, seed: int, n: int, first: Column | None = None) -> DataFrame:
    """n live rows, one a group: the dead go before the draw, so no refill is ever needed."""
    return random_per_group(df.join(dead_keys, key, "left_anti"), group, key, seed, n, first)


def wanted_lookup(wanted: DataFrame, catalog: DataFrame, accession: str) -> tuple[DataFrame, DataFrame]:
    """(found, not found) by version-free accession; every wanted version is kept."""
    w = wanted.select(F.col("accession").alias("wanted"), accession_root("accession").alias("_root")).distinct()
    c = catalog.withColumn("_root", accession_root(accession))
    return w.join(c, "_root").drop("_root"), w.join(c.select("_root").distinct(), "_root", "left_anti").select("wanted")


def add_lineage_by_accession(rows: DataFrame, catalog: DataFrame, keys: list[str], ranks: tuple[str, ...] = RANKS) -> DataFrame:
    """Lineage from the catalog by any of its accession columns; values already assigned stay."""
    every = catalog.select(F.explode(F.array(*map(F.col, keys))).alias("_acc"), *ranks).where(is_assigned("_acc"))
    every = every.select(accession_core("_acc").alias("_core"), F.struct(*ranks).alias("_l")).groupBy("_core").agg(F.min("_l").alias("_l"))
    x = rows.withColumn("_mine", accession_core("accession")).join(every, F.col("_mine") == F.col("_core"), "left")
    out = [F.coalesce(assigned(r), assigned(F.col(f"_l.{r}"))).alias(r) if r in rows.columns else assigned(F.col(f"_l.{r}")).alias(r) for r in ranks]
    return x.select(*(c for c in rows.columns if c not in ranks), *out)


def tiered_lookup(rows: DataFrame, key: str, tiers: list[DataFrame], value: str) -> DataFrame:
    """value from the first tier that has the key."""
    for i, t in enumerate(tiers):
        rows = rows.join(t.select(F.col(key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}")), F.col(key) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    return rows.withColumn(value, F.coalesce(*(F.col(f"_v{i}") for i in range(len(tiers))))).drop(*(f"_v{i}" for i in range(len(tiers))))


def merge_communities(user: DataFrame, drawn: DataFrame, key: str) -> DataFrame:
    """Both, one row a key; the user's rows win, and of several the one whose columns come first."""
    both = user.withColumn("user_supplied", F.lit(True)).unionByName(drawn.withColumn("user_supplied", F.lit(False)), allowMissingColumns=True)
    order = [F.when(F.col("user_supplied"), 0).otherwise(1), *(F.col(c) for c, kind in both.dtypes if "map<" not in kind)]
    return best_per_group(both, [key], order, both.columns)


def by_lineage_taxid(df: DataFrame, taxid: str, rank_taxids: list[str], own: str = "taxid") -> DataFrame:
    """Rows whose taxid at the coarsest rank that has any hit is the given one, else rows with it as their own."""
    x = df.withColumn("_at", F.coalesce(*(F.when(F.col(c) == taxid, F.lit(i)) for i, c in enumerate(rank_taxids)), F.when(F.col(own) == taxid, F.lit(len(rank_taxids)))))
    hit = x.where("_at is not null")
    best = hit.agg(F.min("_at").alias("_best"))
    return hit.join(F.broadcast(best), F.col("_at") == F.col("_best")).drop("_at", "_best")


def assembly_union(sections: list[DataFrame]) -> DataFrame:
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out


def build_ncbi_catalog(sections: list[DataFrame], lineages: DataFrame, checkm: DataFrame) -> DataFrame:
    """Assembly rows of all sections but suppressed and replaced ones, with lineage by taxid and CheckM values by accession."""
    x = assembly_union(sections).where(~F.coalesce(F.lower("version_status").isin("suppressed", "replaced"), F.lit(False)))
    x = x.join(lineages, "taxid", "left")
    c = checkm.withColumn("_core", accession_core("accession")).drop("accession")
    return x.withColumn("_core", accession_core("assembly_accession")).join(c, "_core", "left").drop("_core")


def expand_targets(df: DataFrame, targets: list[str]) -> list[str]:
    """Target names with ``all`` put in full: every assigned domain of the table, in order; each name once."""
    out: list[str] = []
    for t in targets:
        out += [r[0] for r in taxa(df, "domain").collect()] if t.strip().lower() == "all" else [normalize_taxon(t)]
    return list(dict.fromkeys(out))


def quality_floor(df: DataFrame, spec: CatalogSpec, least: float = 70.0, below: float = 10.0) -> DataFrame:
    """Genomes complete and clean enough to be taken without dereplication; unknown values don't pass."""
    return df.where((number(spec.completeness) >= least) & (number(spec.contamination) < below))


def without_filled(candidates: DataFrame, dead_keys: DataFrame, filled: DataFrame, key: str, group: list[str]) -> DataFrame:
    """Candidates neither known to be dead nor of a group that has its genome already."""
    x = candidates.join(dead_keys.select(key), key, "left_anti")
    return x.join(filled.select(*group), group, "left_anti")


def lineage_by_taxid(rows: DataFrame, catalog: DataFrame, ranks: tuple[str, ...] = RANKS, key: str = "taxid") -> DataFrame:
    """rows with the lineage of their taxid: of a taxid's catalog rows the least assigned name at each rank."""
    known = catalog.groupBy(F.col(key).alias("_t")).agg(*(F.min(assigned(r)).alias(f"_{r}") for r in ranks))
    x = rows.join(known, F.col(key) == F.col("_t"), "left")
    return x.select(*(c for c in rows.columns if c not in ranks), *(F.col(f"_{r}").alias(r) for r in ranks))


def select_references(df: DataFrame, spec: CatalogSpec, target: str, rank: str | None = None, derep: str | None = "auto", representatives: bool = False, levels: list[str] | None = None) -> Selection:
    """Reference genomes of a taxon: resolved, filtered, and dereplicated at a rank (auto: two finer) or under the quality
    floor if not. ``all`` takes every domain."""
    whole = target.strip().lower() == "all"
    name, at = ("all", "domain") if whole else resolve_taxon(df, target, rank)
    x = pool(df, spec, None if whole else at, None if whole else name, representatives, levels)
    notes = []
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        fine = resolve_derep_rank(at, derep)
    notes += [str(w.message) for w in seen]
    if fine is None:
        return Selection(quality_floor(x, spec), name, at, None, tuple(notes))
    return Selection(dereplicate(x, spec, fine), name, at, fine, tuple(notes))


def counts_by_rank(df: DataFrame, spec: CatalogSpec, rank: str | None = None, taxon: str | None = None) -> DataFrame:
    """(rank, n_taxa, n_representative_taxa) under one scope, from one scan: distinct taxa of all genomes and of the
    representatives alone, from the scope's rank downward."""
    x = pool(df, spec, rank, taxon)
    rep = F.col(spec.representative) == spec.representative_value
    ranks = RANKS[RANKS.index(rank) :] if rank else RANKS
    one = x.agg(*(F.countDistinct(assigned(r)).alias(r) for r in ranks), *(F.countDistinct(F.when(rep, assigned(r))).alias(f"{r}_rep") for r in ranks))
    rows = F.array(*(F.struct(F.lit(r).alias("rank"), F.col(r).alias("n_taxa"), F.col(f"{r}_rep").alias("n_representative_taxa")) for r in ranks))
    return one.select(F.explode(rows).alias("x")).select("x.*")


def genome_counts(df: DataFrame, spec: CatalogSpec, **filters) -> DataFrame:
    """(n_genomes, n_representatives) of a pool."""
    return pool(df, spec, **filters).agg(F.count("*").alias("n_genomes"), F.count_if(F.col(spec.representative) == spec.representative_value).alias("n_representatives"))


def with_quality(df: DataFrame) -> DataFrame:
    """completeness and contamination from the checkm2 columns, or from the checkm ones where those are missing or blank."""

    def first(what: str) -> Column:
        found = [number(c) for c in (f"checkm2_{what}", f"checkm_{what}") if c in df.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("double")

    return df.withColumn("completeness", first("completeness")).withColumn("contamination", first("contamination"))


def community_rows(df: DataFrame, spec: CatalogSpec, user_supplied: bool, own: str, other: str, ranks: tuple[str, ...] = RANKS) -> DataFrame:
    """Catalog rows in the community schema: accession, user_supplied, ranks under the prefix ``own`` and, null until they are
    looked up, under ``other``, and the two pins."""
    mine = [assigned(r).alias(f"{own}_{r}") for r in ranks]
    theirs = [F.lit(None).cast("string").alias(f"{other}_{r}") for r in ranks]
    pins = [(F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")).alias(c) for c in ("pinned_rel_abundance", "pinned_coverage")]
    return df.select(F.col(spec.accession).alias("accession"), F.lit(user_supplied).alias("user_supplied"), *mine, *theirs, *pins)


def build_gtdb_catalog(sections: list[DataFrame], columns: list[str], lineage: str = "gtdb_taxonomy") -> DataFrame:
    """The union of the metadata sections with seven rank columns from the lineage, projected; no row at all is an error."""
    from ..functions.columns import lineage_strict

    x = assembly_union(sections)
    if x.isEmpty():
        raise ValueError("the metadata tables have no rows")
    return x.select(*lineage_strict(lineage), *columns)
