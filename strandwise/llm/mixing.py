"""Mixing sources to target weights by cube-method balanced sampling.

A source whose target is r times its size takes every document floor(r) times and draws the rest
with inclusion probability r - floor(r). The draw is balanced on the sum of sizes and the number of
documents: while a block holds three undecided documents, their probabilities move along the null
space of the two constraints until one of them is 0 or 1 (the flight). Sources are cut into blocks
of bounded size by a seeded hash, so a source with a third of all rows is many small tasks; the at
most two undecided documents of each block meet again in fewer blocks, until one block a source is
left. Its last two and twelve more, held back from the flight, are the landing problem: of their
choices the one nearest to the balance is taken.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, set_apart, small_batches

WEIGHTS, MOST, BLOCK, LANDING = (5, 2, 1), 3, 8192, 12


def with_sizes(docs: DataFrame, column: str = "_size") -> DataFrame:
    """All columns and the number of words of the text (null: 0), in place of an input column of that name."""
    words = F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.drop(column).withColumn(column, F.coalesce(words, F.lit(0)).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, rows, target) from (source, _size): weights go round by code point of the source, null last.

    Together the targets are the sum of all sizes. A target stops at ``most`` times the source's size
    and the excess goes to the others by weight: with level L, target = min(most * size, L * weight).
    Sources by ascending most * size / weight fill up one after the other, so L is the greatest of the
    levels that result when the first i of them are full. One row a source, of two numbers and its name, meets in one task.
    """
    s = sizes.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("rows"))
    n = len(weights)
    named = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(named) - 1, F.lit(n)) + 1).cast("int")).cast("double")
    s = s.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    filled = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, all_rows = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("level", F.max("level").over(all_rows))
    return s.select("source", "source_size", "rows", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def flight(sizes: np.ndarray, pi: np.ndarray, spare: int = 0) -> tuple[np.ndarray, list[int]]:
    """Probabilities moved to 0 or 1 in the given order, balanced on sizes and counts, and the undecided rows: two at
    most besides the last ``spare`` rows, which are left as they are."""
    p, scale = pi.astype(float).tolist(), float(sizes.max()) or 1.0
    x = (sizes / scale).tolist()
    open_rows: list[int] = []
    for i, v in enumerate(p):
        if v <= 1e-12 or v >= 1 - 1e-12:
            p[i] = float(round(v))
            continue
        open_rows.append(i)
        if i >= len(p) - spare:
            continue
        while len(open_rows) == 3:
            a, b, c = open_rows
            u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])  # its sum and its sum with x are 0
            if max(map(abs, u)) < 1e-15:
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[r]) / d if d > 0 else p[r] / -d for r, d in zip(open_rows, u, strict=True) if d)
            down = min(p[r] / d if d > 0 else (1 - p[r]) / -d for r, d in zip(open_rows, u, strict=True) if d)
            # the nearer end by its chance: up with down / (up + down), drawn from the row's own golden-ratio sequence
            step = up if ((i + 1) * 0.6180339887498949) % 1 * (up + down) < down else -down
            for r, d in zip(open_rows, u, strict=True):
                p[r] += step * d
                if p[r] < 1e-9 or p[r] > 1 - 1e-9:
                    p[r] = float(round(p[r]))
            open_rows = [r for r in open_rows if p[r] not in (0.0, 1.0)]
    return np.array(p), open_rows


def landing(sizes: np.ndarray, p: np.ndarray, owed: float) -> np.ndarray:
    """The 0/1 choice for the last documents that comes nearest to the size owed and to the count their p adds up to."""
    picks = (np.arange(1 << len(p))[:, None] >> np.arange(len(p))) & 1
    off = np.abs(picks @ sizes - owed) + 0.5 * np.abs(picks.sum(1) - p.sum())
    return picks[int(off.argmin())]


def mix(docs: DataFrame, size: str = "_size", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """All rows and columns of docs with (source_size, target, _copies): how often the mix takes each row.

    docs has doc_id, source and its sizes in ``size`` (see with_sizes). A null source is a source of its own. Empty
    documents are drawn like others but count nothing; a source without words is not taken. The draw depends on the rows
    alone, not on their order or partitions: it goes by a hash of the whole row (maps aside), so rows that share a null or
    repeated doc_id spread over the blocks, and rows equal in all columns, which meet in one block, are interchangeable. An
    empty table gives an empty one. Very long texts are passed on as they are. Input columns named like the three made here
    give way to them.
    """
    if block < 2 * (LANDING + 2):
        raise ValueError(f"a block must hold at least {2 * (LANDING + 2)} rows, or its leftovers don't get fewer")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("_size").withColumnRenamed(size, "_size") if size != "_size" else docs
    order = F.xxhash64(F.lit(seed), *[f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    docs, columns = set_apart(docs, ("doc_id", "text", "source", "_size"), ("_src", "_blocks", "_base", "_p", "_order", "_owed", "_part", "_left"), ("source_size", "target", "_copies"), order.alias("_order"))
    t = materialize(targets(docs.select("source", "_size"), weights, most))
    facts = t.select(F.col("source").alias("_src"), "source_size", "target", F.ceil(F.col("rows") / block).alias("_blocks"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    x = docs.join(facts, F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    x = x.withColumn("_base", F.floor(ratio)).withColumn("_p", ratio - F.floor(ratio))
    x = x.withColumn("_owed", F.lit(0.0)).withColumn("_part", F.pmod(F.xxhash64(F.lit(seed + 1), "_order"), F.col("_blocks"))).withColumn("_left", F.lit(True))
    schema = x.schema

    def settle(g: pa.Table) -> pa.Table:
        last = g["_blocks"][0].as_py() <= 1
        order = np.lexsort((np.asarray(g["_size"]), np.asarray(g["doc_id"].fill_null(-1)), np.asarray(g["_order"])))
        sizes, pi = np.asarray(g["_size"]).astype(float)[order], np.asarray(g["_p"])[order]
        p, left = flight(sizes, pi, LANDING)
        owed = float((sizes * pi).sum() - (sizes * np.where(np.isin(np.arange(len(p)), left), 0, p)).sum()) + math.fsum(g["_owed"].to_pylist())
        if last and left:
            p[left] = landing(sizes[left], p[left], owed)
            left = []
        on, carry = np.zeros(len(p), bool), np.zeros(len(p))
        if left:
            on[left] = True
            carry[left[0]] = owed - float((sizes[left] * p[left]).sum())
        back = np.empty(len(p), np.int64)
        back[order] = np.arange(len(p))
        for name, v in (("_p", p), ("_left", on), ("_owed", carry)):
            g = g.set_column(g.schema.get_field_index(name), name, pa.array(v[back]))
        return g

    done, open_rows, last = None, x, False
    while not last:
        last = open_rows.select(F.max("_blocks")).first()[0] in (None, 0, 1)
        step = materialize(open_rows.groupBy("source", "_part").applyInArrow(settle, schema))
        settled = step.where("not _left")
        done = settled if done is None else done.unionByName(settled)
        if not last:
            fewer = F.greatest(F.ceil(F.col("_blocks") * (LANDING + 2) / block), F.lit(1)).cast("long")
            open_rows = step.where("_left").withColumn("_blocks", fewer).withColumn("_part", F.pmod(F.xxhash64(F.lit(seed + 1), "_order"), F.col("_blocks")))
    return done.withColumn("_copies", (F.col("_base") + F.col("_p")).cast("long")).select(*columns, "source_size", "target", "_copies")
