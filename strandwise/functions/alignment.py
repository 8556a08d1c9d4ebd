"""Protein alignment by affine-gap dynamic programming, cs strings, and the tables made from them."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .columns import _CODE

OPEN, EXTEND = -11.0, -1.0

# BLOSUM62 over the twenty residues, the lower triangle row by row.
RESIDUES = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""


def blosum62() -> dict[tuple[str, str], float]:
    """The matrix with B, Z and X as the means of the residues that they stand for, and * at 1 with itself, else -4. A published
    file can be read instead, see ``read_matrix``."""
    out = {(RESIDUES[i], RESIDUES[j]): float(v) for i, row in enumerate(BLOSUM62.strip().split("\n")) for j, v in enumerate(row.split())}
    out |= {(b, a): v for (a, b), v in out.items()}
    many = {"B": "ND", "Z": "QE", "X": RESIDUES}
    for k, members in many.items():
        for c in RESIDUES:
            out[k, c] = out[c, k] = float(round(sum(out[m, c] for m in members) / len(members)))
    for k in many:
        for o in many:
            out[k, o] = float(round(sum(out[m, o] for m in many[k]) / len(many[k])))
    for c in [*RESIDUES, *many]:
        out["*", c] = out[c, "*"] = -4.0
    out["*", "*"] = 1.0
    return out


def read_matrix(text: str) -> dict[tuple[str, str], float]:
    """A substitution matrix in the usual file format: # comments, a line of letters, then a letter and its row."""
    rows = [r.split() for r in text.splitlines() if r.strip() and not r.startswith("#")]
    return {(r[0], c): float(v) for r in rows[1:] for c, v in zip(rows[0], r[1:], strict=True)}


def similarity(matrix: dict[tuple[str, str], float] | None = None, match: float = 5.0, mismatch: float = -4.0) -> Callable[[str, str], float]:
    """A substitution score: a published matrix as a dictionary, or match and mismatch."""
    if matrix is None:
        return lambda a, b: match if a == b else mismatch
    return lambda a, b: matrix.get((a, b), matrix.get((b, a), mismatch))


def global_alignment(a: str, b: str, score: Callable[[str, str], float], gap_open: float = OPEN, gap_extend: float = EXTEND) -> tuple[str, str, float]:
    """(gapped a, gapped b, score). A gap of n costs open + (n - 1) * extend. Of equal alignments the one that, from the
    end, prefers a pair to a gap in b and that to a gap in a is taken."""
    n, m = len(a), len(b)
    low = -1e18
    best = np.full((3, n + 1, m + 1), low)  # pair, gap in b, gap in a
    best[0, 0, 0] = 0
    steps = np.arange(m) * gap_extend
    rows = {c: np.array([score(c, d) for d in b]) for c in set(a)}
    for i in range(1, n + 1):
        best[1, i, 0] = gap_open + (i - 1) * gap_extend
    for j in range(1, m + 1):
        best[2, 0, j] = gap_open + (j - 1) * gap_extend
    for i in range(1, n + 1):
        best[0, i, 1:] = best[:, i - 1, :-1].max(0) + rows[a[i - 1]]
        best[1, i, 1:] = np.maximum(np.maximum(best[0, i - 1, 1:], best[2, i - 1, 1:]) + gap_open, best[1, i - 1, 1:] + gap_extend)
        opened = np.maximum(best[0, i, :-1], best[1, i, :-1]) + gap_open - steps  # a gap in a from column k reaches j at the
        best[2, i, 1:] = np.maximum.accumulate(opened) + steps  # cost of opening at k and j - 1 - k extensions
    i, j, k = n, m, int(best[:, n, m].argmax())
    total, x, y = float(best[k, n, m]), [], []
    while i or j:
        here = best[k, i, j]
        if k == 0:
            x.append(a[i - 1])
            y.append(b[j - 1])
            i, j = i - 1, j - 1
            k = int(best[:, i, j].argmax())
        elif k == 1:
            x.append(a[i - 1])
            y.append("-")
            i -= 1
            k = next(p for p in (0, 1, 2) if abs(best[p, i, j] + (gap_extend if p == 1 else gap_open) - here) < 1e-9) if i or j else 0
        else:
            x.append("-")
            y.append(b[j - 1])
            j -= 1
            k = next(p for p in (0, 1, 2) if abs(best[p, i, j] + (gap_extend if p == 2 else gap_open) - here) < 1e-9) if i or j else 0
    return "".join(reversed(x)), "".join(reversed(y)), total


def align_pairs(df: DataFrame, score: Callable[[str, str], float] | None = None) -> DataFrame:
    """df(id, ref, query) with gapped_ref, gapped_query and score, by BLOSUM62 unless another score is given. Equal pairs of a batch
    are aligned once; callers that use the result more than once should checkpoint it."""
    f = score or similarity(blosum62())

    def run(batches):
        for pdf in batches:
            pairs = list(zip(pdf["ref"], pdf["query"], strict=True))
            found = {p: global_alignment(*p, f) for p in set(pairs)}
            r = [found[p] for p in pairs]
            yield pd.DataFrame({"id": pdf["id"], "gapped_ref": [x[0] for x in r], "gapped_query": [x[1] for x in r], "score": [x[2] for x in r]})

    return df.select("id", "ref", "query").mapInPandas(run, "id string, gapped_ref string, gapped_query string, score double")


def positions(aligned: DataFrame) -> DataFrame:
    """(id, column, ref_pos, query_pos, ref, query, kind): counters run along both sequences; built-in functions only."""
    pairs = F.arrays_zip(F.split("gapped_ref", "").alias("r"), F.split("gapped_query", "").alias("q"))
    x = aligned.select("id", F.posexplode(pairs).alias("column", "p")).select("id", "column", F.col("p.r").alias("ref"), F.col("p.q").alias("query")).where("ref <> ''")
    w = Window.partitionBy("id").orderBy("column").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.when(F.col("ref") == "-", "ins").when(F.col("query") == "-", "del").when(F.col("ref") == F.col("query"), "match").otherwise("sub")
    return x.select("id", "column", F.sum(F.when(F.col("ref") != "-", 1).otherwise(0)).over(w).alias("ref_pos"), F.sum(F.when(F.col("query") != "-", 1).otherwise(0)).over(w).alias("query_pos"), "ref", "query", kind.alias("kind"))


def alignment_summary(pos: DataFrame) -> DataFrame:
    """Percent identity and percent of the reference covered, over its length, and runs of deletions."""
    w = Window.partitionBy("id").orderBy("column")
    x = pos.withColumn("_d", (F.col("kind") == "del") & F.coalesce(F.lag("kind").over(w) != "del", F.lit(True)))
    on_ref = F.count_if(F.col("ref") != "-")
    return x.groupBy("id").agg(F.try_divide(100.0 * F.count_if(F.col("kind") == "match"), on_ref).alias("percent_identity"), F.try_divide(100.0 * F.count_if(F.col("kind").isin("match", "sub")), on_ref).alias("percent_covered"), F.count_if("_d").alias("deletion_runs"), F.count_if(F.col("kind") == "sub").alias("substitutions"))


def rank_hits(df: DataFrame, score: str, keys: list[str], least_identity: float = 30.0, least_coverage: float = 25.0) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *(["ordinal"] if "ordinal" in df.columns else []))
    return df.where((F.col("percent_identity") >= least_identity) & (F.col("percent_covered") >= least_coverage)).withColumn("rank", F.row_number().over(w))


_CODONS = dict(zip((a + b + c for a in "tcag" for b in "tcag" for c in "tcag"), _CODE, strict=True))


def translate(bases: str) -> str:
    """Residues of whole codons; an unknown codon reads X."""
    return "".join(_CODONS.get(bases[i : i + 3].lower(), "X") for i in range(0, len(bases) - 2, 3))


def parse_cs(cs: str) -> list[dict]:
    """Operations of a protein-to-genome cs string, each with op, n, ref, alt.

    match: n residues. sub: residue ref is codon alt. del: n residues ref that the sequence lacks. ins: n bases alt, whole
    codons, that the reference lacks. fs: n bases too many (1, 2) or too few (-1, -2, at residue ref). intron: n bases. A
    codon that an intron parts is head (n bases), intron, and tail (n bases; residue ref is codon alt). An unknown token
    is an error.
    """
    out: list[dict] = []

    def add(op: str, n: int, ref: str | None = None, alt: str | None = None) -> None:
        out.append({"op": op, "n": n, "ref": ref, "alt": alt})

    tokens = _TOKEN.findall(cs)
    if "".join(tokens) != cs:
        raise ValueError(f"unknown token in cs: {cs}")
    at = 0
    while at < len(tokens):
        sign, body = tokens[at][0], tokens[at][1:]
        if sign == ":" and body.isdigit():
            add("match", int(body))
        elif sign == "+" and _RESIDUES.fullmatch(body):
            add("del", len(body), ref=body)
        elif sign == "~" and (intron := _INTRON.fullmatch(body)):
            add("intron", int(intron[1]))
        elif sign == "-" and _BASES.fullmatch(body):
            whole = len(body) - len(body) % 3
            if whole:
                add("ins", whole, alt=body[:whole])
            if len(body) > whole:
                add("fs", len(body) - whole, alt=body[whole:])
        elif sign == "*" and _BASES.fullmatch(body[:-1]) and len(body) <= 4 and _RESIDUES.fullmatch(body[-1:]):
            bases, residue = body[:-1], body[-1]
            rest = tokens[at + 1 : at + 3]
            parted = len(bases) < 3 and len(rest) == 2 and rest[0][0] == "~" and rest[1][0] == "-" and len(bases) + len(rest[1]) - 1 == 3
            if len(bases) == 3:
                add("sub", 1, residue, bases)
            elif parted and (intron := _INTRON.fullmatch(rest[0][1:])) and _BASES.fullmatch(rest[1][1:]):
                add("head", len(bases))
                add("intron", int(intron[1]))
                add("tail", 3 - len(bases), residue, bases + rest[1][1:])
                at += 2
            else:
                add("fs", len(bases) - 3, residue, bases)
        else:
            raise ValueError(f"unknown token in cs: {sign}{body}")
        at += 1
    return out


_TOKEN = re.compile(r"[:*+~-][^:*+~-]+")
_BASES, _RESIDUES, _INTRON = re.compile(r"[acgtn]+"), re.compile(r"[A-Z*]+"), re.compile(r"[acgtn]{2}(\d+)[acgtn]{2}")


def cs_operations(df: DataFrame, key: str = "query") -> DataFrame:
    """(key, ordinal, op, n, ref, alt, residues) of each alignment's cs string; residues is what alt reads as."""

    @F.pandas_udf("array<struct<op:string,n:int,ref:string,alt:string,residues:string>>")
    def parse(s: pd.Series) -> pd.Series:
        return s.map(lambda v: [o | {"residues": translate(o["alt"]) if o["op"] in ("sub", "tail", "ins") else None} for o in parse_cs(v or "")])

    return df.select(key, F.posexplode(parse("cs")).alias("ordinal", "o")).select(key, "ordinal", "o.*")


def placed_operations(operations: DataFrame, key: str = "query") -> DataFrame:
    """operations with ref_at and base_at: residues of the reference and bases of the sequence before each."""
    op, n = F.col("op"), F.col("n")
    bases = F.when(op == "match", 3 * n).when(op == "sub", 3).when(op == "del", 0).when((op == "fs") & (n < 0), 3 + n).otherwise(n)
    residues = F.when(op.isin("match", "del"), n).when(op.isin("sub", "tail") | ((op == "fs") & (n < 0)), 1).otherwise(0)
    w = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    x = operations.withColumn("ref_at", F.sum(residues).over(w) - residues).withColumn("base_at", F.sum(bases).over(w) - bases)
    return x.withColumn("ref_at", F.col("ref_at").cast("int")).withColumn("base_at", F.col("base_at").cast("int"))


def translated(operations: DataFrame, refs: DataFrame, key: str = "query") -> DataFrame:
    """(key, protein, frameshifts) of cs_operations and refs(key, seq, qstart): the protein that the sequence codes for, residues of
    shifted codons taken from the reference, and fs<position><shift> of each frameshift, 1-based, joined by ;."""
    x = placed_operations(operations, key).join(refs.select(key, "seq", "qstart"), key)
    at = (F.col("qstart") + F.col("ref_at") + 1).cast("int")
    op, n = F.col("op"), F.col("n")
    piece = F.when(op == "match", F.substring(F.upper("seq"), at, n)).when(op.isin("sub", "tail", "ins"), F.col("residues")).when((op == "fs") & (n < 0), F.col("ref")).otherwise("")
    shift = F.when(op == "fs", F.concat(F.lit("fs"), at.cast("string"), F.when(n > 0, "+").otherwise(""), n.cast("string")))
    g = x.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", piece.alias("piece"), shift.alias("shift")))).alias("p"))
    return g.select(key, F.array_join(F.col("p.piece"), "").alias("protein"), F.array_join(F.col("p.shift"), ";").alias("frameshifts"))


def introns(operations: DataFrame, key: str = "query") -> DataFrame:
    """(key, introns array of offset and length in bases of the sequence, from the start of the aligned part) of cs_operations."""
    found = F.collect_list(F.when(F.col("op") == "intron", F.struct(F.col("base_at").alias("offset"), F.col("n").alias("length"))))
    return placed_operations(operations, key).groupBy(key).agg(F.array_sort(found).alias("introns"))


# --- tables of differences --------------------------------------------------------------------------------


def insertions(pos: DataFrame) -> DataFrame:
    """(id, ref_pos, inserted): runs of query residues that the reference lacks, after the reference position ref_pos."""
    g = pos.where("kind = 'ins'").groupBy("id", "ref_pos").agg(F.array_sort(F.collect_list(F.struct("column", "query"))).alias("c"))
    return g.select("id", "ref_pos", F.array_join(F.col("c.query"), "").alias("inserted"))


def all_positions(pos: DataFrame) -> DataFrame:
    """(id, ref_pos, ref_aa, query_aa, query_pos, change_type, inserted_after): a row for each residue of the reference."""
    names = F.when(F.col("kind") == "sub", "substitution").when(F.col("kind") == "del", "deletion").otherwise("match")
    x = pos.where("kind <> 'ins'").select("id", "ref_pos", F.col("ref").alias("ref_aa"), F.col("query").alias("query_aa"), F.when(F.col("kind") != "del", F.col("query_pos")).alias("query_pos"), names.alias("change_type"))
    return x.join(insertions(pos).withColumnRenamed("inserted", "inserted_after"), ["id", "ref_pos"], "left")


def mutation_list(pos: DataFrame, frameshifts: DataFrame | None = None) -> DataFrame:
    """(id, kind, ref_pos, mutation): substitutions, deletions, insertions and, from (id, ref_pos, shift), frameshifts as text."""
    from .columns import mutation_text

    x = pos.where("kind in ('sub', 'del')").select("id", "kind", "ref_pos", mutation_text("kind", "ref", "ref_pos", "query").alias("mutation"))
    i = insertions(pos).select("id", F.lit("ins").alias("kind"), "ref_pos", mutation_text(F.lit("ins"), F.lit(""), "ref_pos", "inserted").alias("mutation"))
    out = x.unionByName(i)
    if frameshifts is not None:
        out = out.unionByName(frameshifts.select("id", F.lit("fs").alias("kind"), "ref_pos", mutation_text(F.lit("fs"), F.lit(""), "ref_pos", "shift").alias("mutation")))
    return out


def mutations_or_note(pos: DataFrame) -> DataFrame:
    """(id, value): each id's mutations in the order of the reference, or the note that there are none."""
    m = mutation_list(pos).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ref_pos", "kind", "mutation"))).alias("m"))
    x = pos.select("id").distinct().join(m, "id", "left")
    return x.select("id", F.coalesce(F.array_join(F.col("m.mutation"), "\n"), F.lit("# No mutations detected")).alias("value"))


def hit_statistics(pos: DataFrame) -> DataFrame:
    """(id, percent_identity, percent_covered, substitutions, deletion_runs, deleted, insertions, inserted, mutations) of aligned hits."""
    ins = insertions(pos).groupBy("id").agg(F.count("*").alias("insertions"), F.sum(F.length("inserted")).alias("inserted"))
    gone = pos.groupBy("id").agg(F.count_if(F.col("kind") == "del").alias("deleted"))
    x = alignment_summary(pos).join(gone, "id").join(ins, "id", "left").na.fill(0, ["insertions", "inserted"])
    return x.withColumn("mutations", F.col("substitutions") + F.col("deletion_runs") + F.col("insertions"))
