"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters records into buckets that fit in memory by a seeded hash and counts them. Each
bucket then gets a Fisher-Yates permutation of its positions and the number of records in the
buckets before it, so the buckets laid end to end are one random order of the whole table. Pass two
moves each record once, to its bucket, and puts it in the permuted place. Shards are dealt from
that order in turn: counts differ by one at most, and a place within the shard follows without
gathering a shard anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, set_apart

BUCKET_ROWS = 2048
#: Buckets whose permutations one task draws.
TOGETHER = 64
#: Buckets whose sizes are added up in one task; the sums of so many are added up in another.
STRIDE = 8192


def shuffle_into_shards(df: DataFrame, key: str = "doc_id", shards: int = 8, seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All rows and columns of df with (shard int, slot long).

    The order depends on the rows and the seed alone, not on partitions: the bucket and the order within come from a hash of
    the whole row (maps aside), so a key that many rows share, null among them, spreads over the buckets, and each
    permutation is drawn by the task and at the turn that its bucket's number gives; rows equal in all columns may swap, which
    changes nothing. More equal rows than fill ``16 * bucket_rows`` make a bucket that is not permuted but only sorted, with
    spill. Every row is in exactly one place; null and very long texts are rows like others; an empty table gives an empty
    one. Input columns named shard or slot give way to those made here.
    """
    row = F.xxhash64(*[f"`{c}`" for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])
    df, columns = set_apart(df, (key,), ("_row", "_bucket", "_at", "_b", "_perm", "_before"), ("shard", "slot"), row.alias("_row"))
    total = df.count()
    buckets = max(1, -(-total // bucket_rows))
    bucket = F.pmod(F.xxhash64(F.lit(seed), key, "_row"), F.lit(buckets)).cast("int")
    sizes = materialize(df.select(bucket.alias("_b")).groupBy("_b").count().withColumn("_g", F.expr(f"_b div {STRIDE}")))
    over_groups = Window.partitionBy(F.lit(0)).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("_g").agg(F.sum("count").alias("n")).withColumn("_start", F.coalesce(F.sum("n").over(over_groups), F.lit(0)))
    within = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    plan = sizes.withColumn("_before", F.coalesce(F.sum("count").over(within), F.lit(0))).join(groups.select("_g", "_start"), "_g")
    plan = plan.withColumn("_before", F.col("_start") + F.col("_before"))
    # shuffle() draws from the seed and the partition's number, row by row; so both are fixed by the bucket
    perm = F.when(F.col("count") <= 16 * bucket_rows, F.shuffle(F.sequence(F.lit(0).cast("long"), F.col("count") - 1), F.lit(seed)))
    plan = plan.repartitionById(-(-buckets // TOGETHER), F.expr(f"_b div {TOGETHER}").cast("int")).sortWithinPartitions("_b")
    # Written once: a rerun of a lost task reads the same permutations.
    plan = materialize(plan.select("_b", "_before", perm.alias("_perm")))
    inside = Window.partitionBy("_bucket").orderBy(F.xxhash64(F.lit(seed + 1), key), F.col(key), "_row")
    placed = df.withColumn("_bucket", bucket).withColumn("_at", F.row_number().over(inside))
    placed = placed.join(plan, F.col("_bucket") == F.col("_b"))
    pos = F.col("_before") + F.coalesce(F.element_at("_perm", F.col("_at")), F.col("_at") - 1)
    return placed.withColumn("_at", pos).select(*columns, F.pmod(F.col("_at"), F.lit(shards)).cast("int").alias("shard"), F.expr(f"_at div {shards}").alias("slot"))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Write the shards as folders shard=0.. of Parquet files, each file sorted by slot."""
    out = shuffle_into_shards(df, **options)
    out.repartition("shard", F.expr(f"slot div {BUCKET_ROWS * 8}")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
