"""Sequence records: filters, renaming, extraction, primers, alignment columns, simulation."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import reverse_complement
from .ordered import running_sum


def filter_length(df: DataFrame, least: int | None = None, most: int | None = None, seq: str = "seq") -> DataFrame:
    n = F.length(seq)
    if least is not None:
        df = df.where(n >= least)
    return df if most is None else df.where(n <= most)


def filter_counts(df: DataFrame, least: int | None, most: int | None, seq: str = "seq") -> DataFrame:
    """Records before and after the length filter, in one aggregate."""
    n = F.length(seq)
    keep = (n >= (least or 0)) & (n <= (most if most is not None else 1 << 40))
    return df.agg(F.count("*").alias("before"), F.count_if(keep).alias("after"))


def by_values(df: DataFrame, key: str, values: DataFrame, invert: bool = False) -> DataFrame:
    return df.join(values.select(F.trim(values.columns[0]).alias(key)).distinct(), key, "left_anti" if invert else "left_semi")


def number_records(df: DataFrame, base: str = "s", order: str = "ordinal") -> DataFrame:
    """Ids base1, base2, .. by order, numbered range by range."""
    x = running_sum(df.withColumn("_one", F.lit(1)), order, "_one", "_n")
    return x.withColumn("id", F.concat(F.lit(base), F.col("_n").cast("string"))).drop("_one", "_n")


def rename(df: DataFrame, prefix: str = "", suffix: str = "", key: str = "id") -> DataFrame:
    """Ids between a prefix and a suffix."""
    return df.withColumn(key, F.concat(F.lit(prefix), F.col(key), F.lit(suffix)))


def suffix_repeats(df: DataFrame, key: str = "id", order: str = "ordinal") -> DataFrame:
    """The second record of an id becomes id_1, the third id_2."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return df.withColumn("_n", n).withColumn("new_id", F.when(F.col("_n") == 0, F.col(key)).otherwise(F.concat(F.col(key), F.lit("_"), F.col("_n").cast("string")))).drop("_n")


def repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(order).alias(order))


def to_bed(df: DataFrame, half_open: bool = False) -> DataFrame:
    """Whole records; the end is the last position, or with half_open one past it."""
    n = F.length("seq").cast("long")
    return df.select(F.col("id").alias("contig"), F.lit(0).cast("long").alias("start"), (n if half_open else n - 1).alias("end"))


def extract(spans: DataFrame, seqs: DataFrame, together: int = 4096) -> DataFrame:
    """Sub-sequences of spans(contig, start, end), 0-based half-open. Spans meet their contig's text in groups of about
    ``together`` and are cut from it there, so the text isn't repeated for each."""
    parts = spans.groupBy(F.col("contig").alias("_c")).agg(F.ceil(F.count("*") / together).alias("_k"))
    part = F.pmod(F.xxhash64(*spans.columns), F.col("_k"))
    cuts = spans.join(parts, F.col("contig") == F.col("_c")).groupBy("contig", part.alias("_part")).agg(F.collect_list(F.struct(*spans.columns)).alias("_s"))
    x = cuts.join(seqs.select(F.col("id").alias("contig"), "seq"), "contig").select("seq", F.explode("_s").alias("s"))
    x = x.select("s.*", "seq")
    return x.select(*spans.columns, F.substring("seq", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("seq"))


def exact_hits(df: DataFrame, key: str, seq: str, probe: str) -> DataFrame:
    """(key, start, end) of all places of a probe, overlapping ones too, by built-in functions."""
    parts = F.split(F.col(seq), f"(?=\\Q{probe}\\E)", -1)  # cut in front of every place, in one pass
    x = df.where(F.contains(F.col(seq), F.lit(probe))).select(key, F.startswith(F.col(seq), F.lit(probe)).alias("_f"), F.transform(parts, lambda p: F.length(p)).alias("_l"))
    later = F.when(F.size("_l") > 1, F.transform(F.sequence(F.lit(1), F.size("_l") - 1), lambda i: F.aggregate(F.slice("_l", 1, i), F.lit(0), lambda t, n: t + n))).otherwise(F.array().cast("array<int>"))
    at = F.concat(F.when(F.col("_f"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), later)
    return x.select(key, F.explode(at).alias("start")).withColumn("end", F.col("start") + len(probe))


def _bits(pattern: str, text: str, k: int) -> list[int]:
    """Ends in text of the places of least edit distance (at most k) of pattern: the columns of the distance table as bit vectors,
    a few integer operations a letter (Myers 1999)."""
    m, masks = len(pattern), {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, cost, best, ends = full, 0, m, k, []
    for j, c in enumerate(text, 1):
        same = masks.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        rise = down | ~(diagonal | up) & full
        fall = up & diagonal
        cost += 1 if rise & top else -1 if fall & top else 0
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up = (fall | ~((same | down) | rise)) & full
        down = rise & (same | down)
        if cost < best:
            best, ends = cost, []
        if cost == best:
            ends.append(j)
    return ends


def _ends(pattern: str, text: str, k: int) -> list[int]:
    """_bits of the whole text, read only where it can matter: of k + 1 pieces of the pattern a place with at most k edits holds
    one unchanged, so only stretches around the pieces' own places are looked through."""
    m = len(pattern)
    if m <= k:
        return _bits(pattern, text, k)
    spans, cuts = [], [m * i // (k + 1) for i in range(k + 2)]
    for a, b in zip(cuts, cuts[1:]):
        at = text.find(pattern[a:b])
        while at >= 0:
            spans.append((max(0, at - a - k), at + m - a + k))
            at = text.find(pattern[a:b], at + 1)
    best, ends, low, high = k, [], -1, -1

    def look():
        nonlocal best, ends
        found = _bits(pattern, text[low:high], best)
        if found:
            cost = _distance(pattern, text[max(low, low + found[0] - m - k) : low + found[0]])
            if cost < best:
                best, ends = cost, []
            ends += [low + e for e in found]

    for a, b in sorted(spans):
        if a > high and high >= 0:
            look()
            low = a
        elif high < 0:
            low = a
        high = max(high, b)
    if high >= 0:
        look()
    return ends


def _distance(pattern: str, text: str) -> int:
    """Least edit distance of the pattern to an end of the text."""
    row = list(range(len(pattern) + 1))
    for c in text:
        new = [0]
        for i, d in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (d != c)))
        row = new
    return row[-1]


def _starts(pattern: str, text: str, ends: list[int], k: int) -> list[tuple[int, int]]:
    """(start, end) of places known by their end: the start that is nearest to it, found in the few letters before."""
    out = []
    for end in ends:
        piece = text[max(0, end - len(pattern) - k) : end][::-1]
        back, row = pattern[::-1], list(range(len(pattern) + 1))
        best = (row[-1], 0)
        for j, c in enumerate(piece, 1):
            new = [j]
            for i, d in enumerate(back, 1):
                new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (d != c)))
            row = new
            best = min(best, (row[-1], j))
        out.append((end - best[1], end))
    return out


def primer_hits(df: DataFrame, forward: str, reverse: str, k: int = 0, key: str = "id", seq: str = "seq") -> DataFrame:
    """(key, start, end, type) of the places of least edit distance, at most k, of both primers in both orientations, each end with
    the start nearest to it; places found twice count once. Texts are searched for pieces of each probe, and read around these as bit vectors;
    a worker holds a batch of texts and 20,000 places, besides those of one text."""
    flip = str.maketrans("ACGTacgt", "TGCAtgca")
    probes = [("forward", forward), ("reverse", reverse), ("forward", forward[::-1].translate(flip)), ("reverse", reverse[::-1].translate(flip))]

    def places(text: str) -> list[tuple]:
        seen: dict[tuple[int, int], str] = {}
        for kind, p in probes:
            for place in _starts(p, text, _ends(p, text, k), k):
                seen.setdefault(place, kind)
        return [(*place, kind) for place, kind in sorted(seen.items())]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            kind, rows = b.schema.field(0).type, []

            def batch():
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                types = (kind, pa.int32(), pa.int32(), pa.string())
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [key, "start", "end", "type"])

            for i in range(b.num_rows):
                name = b.column(0)[i].as_py()
                rows += [(name, *x) for x in places(b.column(1)[i].as_py() or "")]
                if len(rows) >= 20_000:
                    yield batch()
                    rows.clear()
            yield batch()

    return df.select(key, seq).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, start int, end int, type string")


def amplicons(hits: DataFrame, key: str = "id") -> DataFrame:
    """Pairs of a left and a later, not overlapping right hit of different types on one record."""
    r = hits.select(F.col(key).alias("_k"), F.col("start").alias("right_start"), F.col("end").alias("right_end"), F.col("type").alias("_t"))
    return hits.join(r, (F.col(key) == F.col("_k")) & (F.col("right_start") >= F.col("end")) & (F.col("type") != F.col("_t"))).select(key, F.col("start").alias("left_start"), F.col("end").alias("left_end"), "right_start", "right_end")


def msa_columns(msa: DataFrame, alphabet: str = "ACGT", seq: str = "seq", gaps: str = "nan") -> DataFrame:
    """Per alignment column: depth, gap fraction and conservation, 1 - H / log(alphabet size).

    Letters outside the alphabet are gaps. Columns with gaps: 'nan' gives null, 'ignore' counts the rest, 'include' takes the
    gap as one more letter, 'error' raises.
    """
    if gaps not in ("nan", "ignore", "include", "error"):
        raise ValueError(f"unknown gap mode {gaps}")
    letters = F.split(F.translate(seq, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "")
    c = msa.select(F.posexplode(F.filter(letters, lambda x: x != "")).alias("position", "raw"))
    c = c.withColumn("c", F.when(F.col("raw").isin(*alphabet), F.col("raw")).otherwise("-"))
    f = c.groupBy("position", "c").agg(F.count("*").alias("n"))
    f = f.withColumn("m", F.when((F.col("c") == "-") & F.lit(gaps != "include"), None).otherwise(F.col("n")).cast("double"))
    t = f.groupBy("position").agg(F.sum("n").alias("depth"), F.sum(F.when(F.col("c") == "-", F.col("n")).otherwise(0)).alias("gapped"), F.sum("m").alias("_t"), F.sum(F.col("m") * F.log("m")).alias("_s"))
    size = len(alphabet) + (gaps == "include")
    entropy = F.log("_t") - F.col("_s") / F.col("_t")
    cons = F.when(F.col("_t") > 0, 1 - entropy / math.log(size))
    if gaps == "nan":
        cons = F.when(F.col("gapped") == 0, cons)
    if gaps == "error":
        cons = F.when(F.col("gapped") > 0, F.raise_error(F.lit("an alignment column has gaps")).cast("double")).otherwise(cons)
    return t.select("position", "depth", (F.col("gapped") / F.col("depth")).alias("gap_fraction"), cons.alias("conservation"), (1 - cons).alias("variation"))


def uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) from a seeded hash: the same for a row wherever and whenever it is computed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


#: Draws made from one copy of a contig's text.
TOGETHER = 256


def drawn(refs: DataFrame, units: str, one: Callable[[Column], Column]) -> DataFrame:
    """(contig, _n, r) with the struct ``one(number)`` for each number from 1 to the units of refs(contig, seq, units). A contig's
    text goes along once for TOGETHER draws; its length is _n."""
    u = F.col(units).cast("long")
    x = refs.select("contig", "seq", F.length("seq").alias("_n"), u.alias("_u"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(cast({units} as long) - 1) div {TOGETHER}"))).alias("_k"))
    numbers = F.sequence(F.col("_k") * TOGETHER + 1, F.least(F.col("_u"), (F.col("_k") + 1) * TOGETHER))
    return x.select("contig", "_n", F.explode(F.transform(numbers, one)).alias("r"))


def sample_reads(refs: DataFrame, length: int, seed: int, units: str = "units", circular: bool = False) -> DataFrame:
    """Reads of a fixed length from refs(contig, seq, units): place and strand from the hash of (seed, contig, number)."""
    n = F.length("seq")
    places = n if circular else n - length + 1

    def one(i: Column) -> Column:
        start = F.floor(uniform(seed, F.col("contig"), i) * places).cast("int")
        bases = F.substring(F.col("seq"), start + 1, F.lit(length))
        if circular:
            bases = F.concat(bases, F.substring(F.col("seq"), F.lit(1), F.greatest(start + length - n, F.lit(0))))
        strand = F.when(uniform(seed + 1, F.col("contig"), i) < 0.5, "+").otherwise("-")
        return F.struct(i.alias("number"), start.cast("long").alias("start"), strand.alias("strand"), bases.alias("bases"))

    x = drawn(refs.where((F.col(units) > 0) & (n >= length)), units, one)
    x = x.select("contig", "_n", "r.*").withColumn("end", F.col("start") + length).withColumn("wrapped", F.col("end") > F.col("_n"))
    seq = F.when(F.col("strand") == "+", F.col("bases")).otherwise(reverse_complement("bases"))
    return x.select(F.concat_ws("_", F.lit("read"), "contig", F.col("number").cast("string")).alias("read_id"), "contig", "start", "end", "strand", "wrapped", seq.alias("seq"))


def mutate(df: DataFrame, rate: float, seed: int, transition_ratio: float = 2.0, indel_rate: float = 0.0, key: str = "id", seq: str = "seq") -> DataFrame:
    """round(length * rate) point mutations of each record at distinct places; transitions with chance r / (r + 1); then
    indels of one base. The generator is seeded by the record's id, so results don't depend on partitions;
    results leave Python 256 records at a time."""
    import zlib

    import numpy as np

    swaps = {"A": ("G", "CT"), "G": ("A", "CT"), "C": ("T", "AG"), "T": ("C", "AG")}

    def run(batches):
        for pdf in (b.iloc[i : i + 256] for b in batches for i in range(0, len(b), 256)):
            out, subs, indels = [], [], []
            for k, s in zip(pdf[key], pdf[seq], strict=True):
                rng = np.random.default_rng([seed, zlib.crc32(str(k).encode())])
                b = list(s or "")
                n, done = round(len(b) * rate), 0
                for i in rng.permutation(len(b)):
                    if done == n:
                        break
                    if (c := b[i].upper()) in swaps:
                        same, other = swaps[c]
                        b[i] = same if rng.random() < transition_ratio / (transition_ratio + 1) else other[rng.integers(2)]
                        done += 1
                m = round(len(b) * indel_rate)
                for _ in range(m):
                    i = int(rng.integers(len(b) + 1)) if b else 0
                    if rng.random() < 0.5 or not b:
                        b.insert(i, "ACGT"[rng.integers(4)])
                    else:
                        del b[min(i, len(b) - 1)]
                out.append("".join(b))
                subs.append(done)
                indels.append(m)
            yield pdf.assign(**{seq: out, "substitutions": subs, "indels": indels})

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", substitutions long, indels long")


def one_insertion(records: DataFrame) -> str:
    """The sequence of the only record of an insertion file; none or several are an error."""
    got = records.select("seq").limit(2).collect()
    if len(got) != 1:
        raise ValueError("the insertion file must hold exactly one sequence")
    return got[0]["seq"]


def clock_seed() -> int:
    """Hour, minute and second as a number, for runs without a seed of their own; it is printed with the result."""
    import time

    now = time.localtime()
    return now.tm_hour * 10_000 + now.tm_min * 100 + now.tm_sec


def parse_place(place: str) -> tuple[str, int]:
    """contig:position, 0-based; the contig may hold colons."""
    contig, colon, at = place.rpartition(":")
    if not colon or not at.isdigit():
        raise ValueError(f"not a contig:position of a position of 0 or more: {place}")
    return contig, int(at)


def insertion_places(contigs: DataFrame, n: int, seed: int, place: str | None = None, back_to_back: bool = False) -> DataFrame:
    """(number, contig, position) of n insertions into contigs(contig, length).

    The first goes to ``place`` if given; others to a contig drawn by length and a position drawn in it, by hashes of
    (seed, number). ``back_to_back`` puts all where the first goes. Positions are those of the sequence as it came.
    """
    spark = contigs.sparkSession
    first = None
    if place is not None:
        contig, at = parse_place(place)
        room = contigs.where(F.col("contig") == contig).select("length").first()
        if room is None or at > room[0]:
            raise ValueError(f"{place} is not in the input")
        first = (contig, at)
    total = contigs.agg(F.sum("length").alias("_all"))
    upto = running_sum(contigs.withColumn("_o", F.xxhash64("contig").cast("double")), "_o", "length", "_upto", ["contig"]).select("contig", "length", "_upto")
    draws = 1 if back_to_back and first is None else 0 if back_to_back else n - (first is not None)
    drawn = spark.range(1, draws + 1).select(F.col("id").alias("number")).join(F.broadcast(total))
    drawn = drawn.withColumn("_at", F.floor(uniform(seed, F.col("number")) * F.col("_all")).cast("long"))
    x = drawn.join(upto, (F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("length")))
    x = x.select("number", "contig", F.floor(uniform(seed + 1, F.col("number")) * (F.col("length") + 1)).cast("long").alias("position"))
    if first is not None:
        x = x.withColumn("number", F.col("number") + 1).unionByName(spark.createDataFrame([(1, *first)], "number long, contig string, position long"))
    if back_to_back:
        x = x.select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("number"), "contig", "position")
    return x


def insert_pieces(seqs: DataFrame, places: DataFrame, piece: str) -> DataFrame:
    """seqs(contig, seq) with the piece put in at all its places; several at one position follow each other."""
    p = places.groupBy("contig").agg(F.array_sort(F.collect_list(F.col("position").cast("int"))).alias("_p"))
    cuts = F.concat(F.array(F.lit(0)), F.col("_p"), F.array(F.length("seq")))
    parts = F.transform(F.sequence(F.lit(1), F.size("_p") + 1), lambda i: F.substring(F.col("seq"), F.element_at(cuts, i) + 1, F.element_at(cuts, i + 1) - F.element_at(cuts, i)))
    x = seqs.join(p, "contig", "left")
    return x.withColumn("seq", F.when(F.col("_p").isNull(), F.col("seq")).otherwise(F.array_join(parts, piece))).select(*seqs.columns)
