"""Trees and term graphs: closures by doubling joins, lineages by the deepest name of each rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RANKS
from ..shared import checkpoint


def _clean(edges: DataFrame, child: str, parent: str) -> DataFrame:
    x = edges.select(F.col(child).alias("child"), F.col(parent).alias("parent"))
    return x.where("child is not null and parent is not null and child <> parent").distinct()


def closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, ancestor, depth): every ancestor at its least distance, the node itself at 0; cycles give no pair twice.

    With all pairs up to a distance known, pairs of just that distance are extended by all known ones, so the reach
    doubles with each round and a chain of n takes log n of them. Rounds are written to the shared folder.
    """
    e = _clean(edges, child, parent)
    nodes = e.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
    pairs = checkpoint(e.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    reach = 1
    while True:
        tips = pairs.where(F.col("depth") == reach).select("node", F.col("ancestor").alias("_at"), "depth")
        more = pairs.select(F.col("node").alias("_at"), F.col("ancestor"), F.col("depth").alias("_d"))
        found = tips.join(more, "_at").where("node <> ancestor").groupBy("node", "ancestor").agg(F.min(F.col("depth") + F.col("_d")).alias("depth"))
        new = checkpoint(found.join(pairs.select("node", "ancestor"), ["node", "ancestor"], "left_anti"))
        if new.isEmpty():
            break
        pairs, reach = checkpoint(pairs.unionByName(new)), 2 * reach
    return pairs.unionByName(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")))


def _reached(edges: DataFrame, start: str, step_from: str, step_to: str) -> DataFrame:
    """Nodes that edges lead to from one node, found step by step from it alone."""
    e = checkpoint(_clean(edges, "child", "parent").select(F.col(step_from).cast("string").alias("a"), F.col(step_to).cast("string").alias("b")))
    seen = edges.sparkSession.createDataFrame([(start,)], "n string")
    tips = seen
    while True:
        tips = checkpoint(e.join(tips, e.a == tips.n, "left_semi").select(F.col("b").alias("n")).distinct().join(seen, "n", "left_anti"))
        if tips.isEmpty():
            return seen.where(F.col("n") != start)
        seen = checkpoint(seen.unionByName(tips))


def ancestors(edges: DataFrame, term: str) -> DataFrame:
    return _reached(edges, term, "child", "parent").withColumnRenamed("n", "ancestor")


def descendants(edges: DataFrame, term: str) -> DataFrame:
    return _reached(edges, term, "parent", "child").withColumnRenamed("n", "descendant")


def lineages(nodes: DataFrame, names: DataFrame, ranks: tuple[str, ...] = RANKS, strain: bool = False) -> DataFrame:
    """(taxid, one column a rank) by walking nodes(taxid, parent, rank); the deepest node of a rank wins.

    superkingdom reads as domain. A parent that isn't there ends the walk; a rank never met is null. With ``strain``, a node
    below a species has its own name there.
    """
    up = closure(nodes.select(F.col("taxid").alias("child"), F.col("parent").alias("parent")))
    alone = nodes.select(F.col("taxid").alias("node"), F.col("taxid").alias("ancestor"), F.lit(0).alias("depth"))
    up = up.where("depth > 0").unionByName(alone)
    known = nodes.select(F.col("taxid").alias("_t"), F.when(F.col("rank") == "superkingdom", "domain").otherwise(F.col("rank")).alias("rank"))
    named = up.join(known, F.col("ancestor") == F.col("_t")).join(names.select(F.col("taxid").alias("_n"), "name"), F.col("ancestor") == F.col("_n"))
    picks = [F.min_by(F.when(F.col("rank") == r, F.col("name")), F.when(F.col("rank") == r, F.col("depth"))).alias(r) for r in ranks]
    if strain:
        below = F.min(F.when(F.col("rank") == "species", F.col("depth"))) > 0
        picks.append(F.when(below, F.min_by("name", "depth")).alias("strain"))
    out = named.groupBy(F.col("node").alias("taxid")).agg(*picks)
    return nodes.select("taxid").distinct().join(out, "taxid", "left")


def slim(annotations: DataFrame, edges: DataFrame, slim_terms: DataFrame, direct: bool = True) -> DataFrame:
    """(gene, term): each annotation's slim ancestors; ``direct`` leaves out those above another one that it has."""
    up = closure(edges)
    hits = annotations.join(up, F.col("term") == F.col("node")).join(slim_terms.select(F.col("term").alias("_s")), F.col("ancestor") == F.col("_s")).select("gene", F.col("term").alias("from"), F.col("ancestor").alias("slim")).distinct()
    if direct:
        over = up.where("depth > 0").select(F.col("node").alias("_low"), F.col("ancestor").alias("_high"))
        covered = hits.join(over, F.col("slim") == F.col("_low")).select("gene", "from", F.col("_high").alias("slim")).distinct()
        hits = hits.join(covered, ["gene", "from", "slim"], "left_anti")
    return hits.select("gene", F.col("slim").alias("term")).distinct()
