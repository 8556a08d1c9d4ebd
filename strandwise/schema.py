"""Ranks, catalog descriptions and record schemas."""

from __future__ import annotations

from dataclasses import dataclass

RANKS = ("domain", "phylum", "class", "order", "family", "genus", "species")
#: Written at sinks where the engine holds NULL (fixed value).
MISSING = "NA"


@dataclass(frozen=True)
class CatalogSpec:
    """Where a genome catalog keeps what selection needs."""

    accession: str
    representative: str
    representative_value: str
    reference: str
    reference_value: str
    completeness: str
    contamination: str
    contigs: str
    size: str
    fallback_size: str | None = None
    level: str | None = None


GTDB = CatalogSpec("ncbi_genbank_assembly_accession", "gtdb_representative", "t", "ncbi_refseq_category", "reference genome", "checkm2_completeness", "checkm2_contamination", "contig_count", "genome_size")
NCBI = CatalogSpec("assembly_accession", "refseq_category", "reference genome", "refseq_category", "reference genome", "checkm_completeness", "checkm_contamination", "contig_count", "genome_size_ungapped", "genome_size", "assembly_level")

# Record schemas as DDL.
FASTA = "id string, description string, seq string, ordinal long"
FASTQ = "read_id string, seq string, qual string, ordinal long"
BED = "contig string, start long, end long, value double"
HSP = "qseqid string, qlen long, sseqid string, slen long, qstart long, qend long, sstart long, send long, length long, qcovs double, qcovhsp double, qcovus double, pident double, evalue double, bitscore double"
REPORT = "percent double, clade_reads long, reads long, rank string, taxid string, name string"
