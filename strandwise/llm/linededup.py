"""Line dedup by site-relative frequency, with DataFrame functions only.

A line is boilerplate on a site if it stands on at least ``min_pages`` pages and on more than
``ratio`` of the site's pages, pages of one text counting once: copies of a page don't make its lines
boilerplate. Copies are folded by partial aggregates on (site, text hash), counts are partial sums
per (site, line hash) before any shuffle. A page holds few lines, so a site has at most (mean distinct
lines per page) / ratio boilerplate lines: they fit in one row per site, which is joined back to the
pages; text is not exploded again.

The frequencies of repeated lines fall off evenly, without a gap between boilerplate and the rest; a
ratio of 0.01 takes the head that makes up most repeated lines, and three pages at least keep small
sites from losing lines that two pages share by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, set_apart

RATIO, MIN_PAGES = 0.01, 3


def drop_boilerplate_lines(df: DataFrame, site: Column, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """All rows and columns of df with ``text`` cleaned and (_lines, _dropped): lines before and lines dropped.

    Lines end at a line feed; blank lines stay. A line that a page repeats counts once for that page and goes each time.
    A null text stays null with 0 lines and is not a page; null sites form a site of their own. Repeated rows and other pages
    of equal text count as one page and are all cleaned. A page may become empty but no row is dropped; very long pages are
    cleaned whole, an empty table gives an empty one. Input columns named _lines or _dropped give way to those made here.
    """
    pages, columns = set_apart(df, (text,), ("_site", "s", "_common", "_all", "_kept"), ("_lines", "_dropped"), site.cast("string").alias("_site"))
    lines = F.split(F.col(text), "\n")
    distinct = F.array_distinct(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x)))
    prints = (F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    texts = pages.where(F.col(text).isNotNull()).groupBy("_site", *prints).agg(F.first(distinct).alias("l"))
    texts = materialize(texts.select("_site", "l"))
    totals = texts.groupBy("_site").agg(F.count("*").alias("total"))
    counts = texts.select("_site", F.explode("l").alias("h")).groupBy("_site", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = totals.select(F.col("_site").alias("s"), "total")
    common = counts.join(totals, F.col("_site").eqNullSafe(F.col("s"))).where(F.col("n") > F.lit(ratio) * F.col("total"))
    common = materialize(common.groupBy("_site").agg(F.sort_array(F.collect_list("h")).alias("_common")).withColumnRenamed("_site", "s"))
    discard(texts)
    x = pages.join(common, F.col("_site").eqNullSafe(F.col("s")), "left")
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_common"), F.xxhash64(x)))
    x = x.withColumn("_all", F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)))
    x = x.withColumn("_kept", F.when(F.col("_common").isNotNull() & F.col(text).isNotNull(), kept))
    clean = F.when(F.col("_kept").isNotNull(), F.array_join("_kept", "\n")).otherwise(F.col(text))
    dropped = F.when(F.col("_kept").isNotNull(), F.col("_all") - F.size("_kept")).otherwise(F.lit(0))
    x = x.withColumn("_dropped", dropped.cast("long")).withColumn(text, clean)
    return x.select(*columns, F.col("_all").cast("long").alias("_lines"), "_dropped")
