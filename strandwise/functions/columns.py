"""Column builders: names, accessions, lineages, sequences, alignments. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import RANKS


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- missing values and numbers -------------------------------------------------------------


def is_assigned(x: Column | str) -> Column:
    """False for null, 'NA' and ''."""
    return F.coalesce(~col(x).isin("NA", ""), F.lit(False))


def assigned(x: Column | str) -> Column:
    """The value, or null if it is unassigned."""
    return F.when(is_assigned(x), col(x))


def number(x: Column | str, default: float | None = None) -> Column:
    """A double from text; null, blank and unparsable values give the default."""
    v = F.expr(f"try_cast({x} as double)") if isinstance(x, str) else x.try_cast("double")
    return v if default is None else F.coalesce(v, F.lit(float(default)))


# --- accessions and names -----------------------------------------------------------------------


def accession_core(x: Column | str) -> Column:
    """Digits of a GCA_/GCF_ accession without RS_/GB_ prefix or version; '' if it isn't one."""
    return F.coalesce(F.regexp_extract(F.trim(col(x)), r"(?i)^(?:RS_|GB_)?GC[AF]_([^.\s]+)", 1), F.lit(""))


def accession_digits(x: Column | str) -> Column:
    """The looser key: any prefix up to an underscore goes, and the version."""
    return F.regexp_replace(F.regexp_replace(F.trim(col(x)), r"^(?:RS_|GB_)?(?:GC[AF]_)?", ""), r"\..*$", "")


def accession_root(x: Column | str) -> Column:
    """The accession without its version, prefix kept."""
    return F.regexp_replace(F.trim(col(x)), r"\..*$", "")


def normalize_taxon(name: str) -> str:
    return {"eukarya": "Eukaryota", "eukaryotes": "Eukaryota", "eukaryote": "Eukaryota"}.get(name.strip().lower(), name.strip())


def safe_name(x: Column | str) -> Column:
    """White space, / , # ( ) [ ] become one underscore a run; none at the ends."""
    return F.regexp_replace(F.regexp_replace(col(x), r"[\s/,#()\[\]]+", "_"), r"_+", "_").transform(lambda v: F.regexp_replace(v, "^_|_$", ""))


#: Suffixes of the public archive's files; its base address is in download_link.
LINK_SUFFIXES = {"fasta": "_genomic.fna.gz", "genbank": "_genomic.gbff.gz", "protein": "_protein.faa.gz", "gff": "_genomic.gff.gz", "nt-cds": "_cds_from_genomic.fna.gz", "feature-tab": "_feature_table.txt.gz", "report": "_assembly_report.txt", "stats": "_assembly_stats.txt"}


def download_link(ftp_path: Column | str, accession: Column | str, asm_name: Column | str, kind: str = "fasta") -> Column:
    """The link from the ftp path, else from the accession's digits and the cleaned assembly name, else null."""
    suffix = F.lit(LINK_SUFFIXES[kind])
    digits = F.regexp_extract(col(accession), r"^GC[AF]_(\d{9})", 1)
    stem = F.concat_ws("_", col(accession), safe_name(asm_name))
    built = F.concat(F.lit("https://ftp.ncbi.nlm.nih.gov/genomes/all/"), F.substring(col(accession), 1, 3), F.lit("/"), F.substring(digits, 1, 3), F.lit("/"), F.substring(digits, 4, 3), F.lit("/"), F.substring(digits, 7, 3), F.lit("/"), stem)
    base = F.when(is_assigned(ftp_path) & (F.lower(col(ftp_path)) != "na"), col(ftp_path)).when((digits != "") & is_assigned(asm_name), built)
    return F.concat(base, F.lit("/"), F.substring_index(base, "/", -1), suffix)


def natural_key(x: Column | str) -> Column:
    """Sorts digit runs by value, of any length: contig_2 before contig_10. A run is preceded by the number of its digits."""

    def part(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=.)", "")
        return F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 9, "0"), digits)).otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(col(x), F.lit(r"(\d+|\D+)"), 1), part), "")


# --- lineages ---------------------------------------------------------------------------------------


def lineage_strict(x: Column | str) -> list[Column]:
    """Seven columns of d__..;p__..;..;s__..; an empty rank is null, another form is an error."""
    parts = F.split(col(x), ";")
    letters = ("d", "p", "c", "o", "f", "g", "s")
    ok = (F.size(parts) == 7) & F.coalesce(col(x).rlike("^" + ";".join(f" ?{c}__[^;]*" for c in letters) + "$"), F.lit(False))
    checked = F.when(ok | col(x).isNull(), parts).otherwise(F.raise_error(F.concat(F.lit("not a seven-rank lineage: "), col(x))))
    return [assigned(F.substring(F.trim(F.element_at(checked, i + 1)), 4, 1 << 20)).alias(r) for i, r in enumerate(RANKS)]


def lineage_lenient(x: Column | str) -> list[Column]:
    """Seven columns of a prefixed lineage that may lack ranks or begin with root; a rank out of order ends it."""
    rest = F.regexp_replace(F.regexp_replace(col(x), r"^\s*root;?", ""), r"\s*;\s*", ";")
    out = []
    for c, r in zip("dpcofgs", RANKS, strict=True):
        v = F.regexp_extract(rest, rf"^{c}__([^;]*)", 1)
        rest = F.regexp_replace(rest, rf"^{c}__[^;]*;?", "")
        out.append(assigned(F.trim(v)).alias(r))
    return out


def lineage_plain(x: Column | str, ranks: tuple[str, ...] = RANKS) -> list[Column]:
    """Columns of a;b;c; blank parts are null."""
    parts = F.split(col(x), ";")
    return [assigned(F.trim(F.get(parts, F.lit(i)))).alias(r) for i, r in enumerate(ranks)]


def last_taxid(x: Column | str) -> Column:
    return F.regexp_replace(F.element_at(F.split(col(x), ";"), -1), r"\*$", "")


def supported(x: Column | str) -> Column:
    """A classifier's value; null where it found no support."""
    return F.when(~F.lower(F.trim(col(x))).isin("no support", "na", ""), col(x))


def classified_taxid(status: Column | str, lineage: Column | str) -> Column:
    """Last taxid of a classifier's lineage; null if no taxid was assigned. Header rows (``classification``) give null too."""
    return F.when(~col(status).isin("no taxid assigned", "classification"), supported(last_taxid(lineage)))


def rank_name(x: Column | str) -> Column:
    """superkingdom reads as domain."""
    return F.when(col(x) == "superkingdom", "domain").otherwise(col(x))


def synthetic_taxid(ranks: list[Column]) -> Column:
    """Rank names joined by underscores, spaces too; a missing one reads NA."""
    return F.regexp_replace(F.concat_ws("_", *(F.coalesce(r, F.lit("NA")) for r in ranks)), " ", "_")


def taxon_stem(x: Column | str) -> Column:
    """A taxon's name as part of a file's: what isn't a letter, a digit, a dot or a dash is one hyphen a run."""
    return F.regexp_replace(F.regexp_replace(F.trim(col(x)), r"[^A-Za-z0-9.-]+", "-"), r"^-+|-+$", "")


def report_rank(code: Column | str, name: Column | str) -> Column:
    """R1 rows named like a domain count as domain."""
    return F.when((col(code) == "R1") & F.trim(col(name)).isin("Bacteria", "Archaea", "Eukaryota", "Viruses"), "D").otherwise(col(code))


def fill_unclassified(x: Column | str) -> Column:
    return F.when(~F.lower(col(x)).startswith("unclassified_"), col(x))


def marker_ranks(region: str, names: list[str]) -> list[Column]:
    """Rank columns of a marker-gene table, unclassified values null. ITS tables get the domain Eukarya wherever a kingdom was
    found; 18S tables call their kingdom domain; others stay."""
    out = [fill_unclassified(n).alias("domain" if region == "18S" and n == "kingdom" else n) for n in names]
    if region == "ITS":
        out.insert(0, F.when(is_assigned(fill_unclassified("kingdom")), "Eukarya").alias("domain"))
    return out


# --- sequences ----------------------------------------------------------------------------------------


def gc_fraction(seq: Column | str, any_case: bool = False) -> Column:
    """Share of G and C; 0 for an empty sequence. Lower case counts only if asked for."""
    s = col(seq)
    return F.when(F.length(s) == 0, 0.0).otherwise(F.length(F.regexp_replace(s, "[^GCgc]" if any_case else "[^GC]", "")) / F.length(s))


def windows_of(length: Column, size: int, step: int) -> Column:
    """0-based window starts; none if the sequence is shorter than a window."""
    return F.when(length >= size, F.sequence(F.lit(0), (length - size).cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))


def sliding_gc(seq: Column | str, size: int, step: int) -> Column:
    return F.transform(windows_of(F.length(col(seq)), size, step), lambda i: F.struct(i.alias("start"), gc_fraction(F.substring(col(seq), i + 1, F.lit(size))).alias("gc")))


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(col(seq), "ACGTacgt", "TGCAtgca"))


def sequence_type(seq: Column | str) -> Column:
    """'aa' if any of EFIJLOPQZ occurs, else 'nt' if nine tenths are nucleotide codes, else 'aa'."""
    s = F.upper(F.regexp_replace(col(seq), r"[\s*-]", ""))
    share = F.try_divide(F.length(F.regexp_replace(s, "[^ACGTUNRYSWKMBDHV]", "")), F.length(s))
    return F.when(s.rlike("[EFIJLOPQZ]"), "aa").when(share >= 0.9, "nt").otherwise("aa")


def complexity(seq: Column | str, k: int = 3) -> Column:
    """Distinct k-mers over the most there could be; 0 if shorter than k."""
    n = F.length(col(seq)) - k + 1
    step = 2048  # k-mers of one piece at a time, so that memory holds the different ones and one piece

    def piece(seen: Column, i: Column) -> Column:
        return F.array_union(seen, F.regexp_extract_all(F.substring(col(seq), i + 1, F.lit(step + k - 1)), F.lit(f"(?s)(?=(.{{{k}}}))"), 1))

    seen = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), F.array().cast("array<string>"), piece)
    return F.when(n >= 1, F.size(seen) / F.least(n, F.lit(4**k))).otherwise(0.0)


def non_acgt_fraction(seq: Column | str) -> Column:
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(col(seq), "[ACGTacgt]", "")), F.length(col(seq))), F.lit(0.0))


def wrap_sequence(seq: Column | str, width: int = 60) -> Column:
    return F.regexp_replace(F.regexp_replace(col(seq), f"(.{{{width}}})", "$1\n"), r"\n$", "")


def insert_at(seq: Column | str, piece: Column | str, position: Column, copies: int = 1) -> Column:
    """``copies`` of a piece put in front of the 0-based position."""
    s = col(seq)
    return F.concat(F.substring(s, F.lit(1), position), F.repeat(col(piece), copies), F.substring(s, position + 1, F.length(s)))


# --- alignments -----------------------------------------------------------------------------------------


def cigar_ops(cigar: Column | str) -> Column:
    """array<struct<n:int,op:string>>."""
    return F.transform(F.regexp_extract_all(col(cigar), F.lit(r"(\d+[MIDNSHP=X])"), 1), lambda p: F.struct(F.regexp_extract(p, r"\d+", 0).cast("int").alias("n"), F.substring(p, -1, 1).alias("op")))


#: Which operations each counter adds up; gap events are counted, not added up.
_COUNTERS = {"aligned_columns": "MID=X", "query_aligned": "MI=X", "gap_events": "ID", "soft_clipped": "S", "hard_clipped": "H", "full_length": "MI=XSH", "matched_columns": "M=X"}


def cigar_totals(cigar: Column | str) -> Column:
    """A struct of all counters of a CIGAR string, in one pass over its operations."""
    zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in _COUNTERS))

    def add(t: Column, x: Column) -> Column:
        return F.struct(*(F.when(x["op"].isin(*ops), t[c] + (F.lit(1) if c == "gap_events" else x["n"])).otherwise(t[c]).alias(c) for c, ops in _COUNTERS.items()))

    return F.aggregate(cigar_ops(cigar), zero, add)


def with_cigar(df: DataFrame, cigar: str = "cigar", nm: str | None = "nm") -> DataFrame:
    """df with aligned_columns, query_aligned, gap_events, soft_clipped, hard_clipped, full_length and, with ``nm``, pid_gap_aware
    (percent identity over all columns) and pid_gap_compressed (each gap counted once). A CIGAR string is parsed once."""
    x = df.withColumn("_cigar", cigar_totals(cigar))
    t = F.col("_cigar")
    out = [t[c].alias(c) for c in _COUNTERS if c != "matched_columns"]
    if nm is not None:
        matches = 100.0 * (t["aligned_columns"] - F.col(nm))
        out += [F.try_divide(matches, t["aligned_columns"]).alias("pid_gap_aware"), F.try_divide(matches, t["matched_columns"] + t["gap_events"]).alias("pid_gap_compressed")]
    return x.select(*(F.col(f"`{c}`") for c in df.columns), *out)


def usable_alignment(flag: Column | str, secondary: bool = False) -> Column:
    """Mapped, and primary unless asked otherwise."""
    f = col(flag)
    ok = f.bitwiseAND(0x4) == 0
    return ok if secondary else ok & (f.bitwiseAND(0x100) == 0) & (f.bitwiseAND(0x800) == 0)


def mate_name(name: Column | str, flag: Column | str) -> Column:
    return F.concat(col(name), F.when(col(flag).bitwiseAND(0x40) != 0, "/1").when(col(flag).bitwiseAND(0x80) != 0, "/2").otherwise(""))


def overlap_of_shorter(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap of 1-based inclusive spans as a share of the shorter."""
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2) + 1, F.lit(0)) / F.least(e1 - s1 + 1, e2 - s2 + 1)


def subject_coverage(length: Column | str, slen: Column | str) -> Column:
    return F.try_divide(100.0 * col(length), col(slen))


def units_for_coverage(coverage: Column, genome: Column, read_length: int, paired: bool, fragment: int | None = None) -> Column:
    """Reads or fragments that give a mean coverage; a fragment adds the shorter of two reads and itself."""
    bases = min(2 * read_length, fragment or 2 * read_length) if paired else read_length
    return F.ceil(coverage * genome / F.lit(bases)).cast("long")


def coverage_of_units(units: Column, genome: Column, read_length: int, paired: bool, fragment: int | None = None) -> Column:
    bases = min(2 * read_length, fragment or 2 * read_length) if paired else read_length
    return F.try_divide(units * F.lit(float(bases)), genome)


def mutation_text(kind: Column | str, ref: Column | str, pos: Column | str, alt: Column | str) -> Column:
    """A210R, A210del, ins210:KL, fs210+1."""
    p = col(pos).cast("string")
    return F.when(col(kind) == "sub", F.concat(col(ref), p, col(alt))).when(col(kind) == "del", F.concat(col(ref), p, F.lit("del"))).when(col(kind) == "ins", F.concat(F.lit("ins"), p, F.lit(":"), col(alt))).when(col(kind) == "fs", F.concat(F.lit("fs"), p, col(alt)))


# --- coding sequences ------------------------------------------------------------------------------------

#: Residues of the standard genetic code, codons in the order of TCAG.
_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def translate_codons(seq: Column | str) -> Column:
    """The protein of whole codons by the standard code, a part of a codon at the end left out; unknown codons read X."""
    s = F.translate(col(seq), "acgtuU", "ACGTTT")
    index = F.lit("TCAG")

    def residue(codon: Column) -> Column:
        a, b, c = (F.instr(index, F.substring(codon, k, 1)) for k in (1, 2, 3))
        return F.when((a > 0) & (b > 0) & (c > 0), F.substring(F.lit(_CODE), (a - 1) * 16 + (b - 1) * 4 + c, F.lit(1))).otherwise("X")

    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit("(?s)(.{3})"), F.lit(1)), residue), "")  # one pass, however long


def without_spans(seq: Column, spans: Column) -> Column:
    """A text without the (offset, length) spans, which are sorted and don't overlap."""
    done = F.aggregate(spans, F.struct(F.lit("").alias("kept"), F.lit(0).alias("at")), lambda t, x: F.struct(F.concat(t["kept"], F.substring(seq, t["at"] + 1, x["offset"] - t["at"])).alias("kept"), (x["offset"] + x["length"]).alias("at")))
    return F.concat(done["kept"], F.substring(seq, done["at"] + 1, F.length(seq)))


def coding_columns(seq: str, strand: str, start: str, end: str, protein: str, protein_start: str, protein_end: str, protein_length: str, introns: str) -> tuple[Column, Column]:
    """(protein, coding sequence) of an alignment of a reference protein to a sequence, whole at both ends.

    Residues of the reference beyond the aligned part are read from the bases beside it, in frame, up to a stop; introns
    (array of offset, length from the start of the aligned part, in coding direction) are cut out; a stop codon that follows at
    once belongs to the coding sequence, not to the protein.
    """
    minus, n = F.col(strand) == "-", F.length(seq)
    coding = F.when(minus, reverse_complement(seq)).otherwise(F.col(seq))
    a = F.when(minus, n - F.col(end)).otherwise(F.col(start)).cast("int")
    b = F.when(minus, n - F.col(start)).otherwise(F.col(end)).cast("int")
    behind = (3 * (F.col(protein_length) - F.col(protein_end))).cast("int")
    after = F.substring_index(translate_codons(F.substring(coding, b + 1, F.greatest(behind, F.lit(0)))), "*", 1)
    room = F.least(a - a % 3, (3 * F.col(protein_start)).cast("int"))
    before = F.substring_index(translate_codons(F.substring(coding, a - room + 1, room)), "*", -1)
    body = without_spans(F.substring(coding, a + 1, b - a), F.coalesce(F.col(introns), F.array().cast("array<struct<offset:int,length:int>>")))
    upto = b + 3 * F.length(after)
    next_codon = F.substring(coding, upto + 1, F.lit(3))
    stop = F.when(translate_codons(next_codon) == "*", next_codon).otherwise("")
    cds = F.concat(F.substring(coding, a - 3 * F.length(before) + 1, 3 * F.length(before)), body, F.substring(coding, b + 1, 3 * F.length(after)), stop)
    return F.concat(before, F.col(protein), after).alias("protein"), cds.alias("coding_sequence")
