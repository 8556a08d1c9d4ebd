"""Running sums and exact ranks over a whole table without putting it into one task, and shares that stay as they are while it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


SHARE = 8 << 20  # bytes of the files read


def tasks_for(df: DataFrame) -> int:
    """Tasks that keep each one's share of the files df reads at SHARE, at least one a core. Sizes come from the plan's leaves, for an
    estimate after a join is the product of both sides; where one is no file, at least the session's shuffle partitions."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [leaves.apply(i) for i in range(leaves.size())]
    files = [x for x in leaves if x.getClass().getSimpleName().startswith("LogicalRelation")]
    least = 1 if len(files) == len(leaves) else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, least, -(-sum(int(x.stats().sizeInBytes()) for x in files) // SHARE))


def dealt(df: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """df by the keys over tasks_for(df) tasks, which are not joined into larger ones, so that a task holds no more as tables grow.
    Windows and groups by these and further keys need no other shuffle."""
    return df.repartition(tasks or tasks_for(df), *keys)


def running_sum(df: DataFrame, by: str, amount: str, name: str, tie: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """df with ``name``, the sum of ``amount`` up to and with each row in the order of the number ``by``, then ``tie``.

    Approximate quantiles cut the order into as many ranges as the session has shuffle partitions; a row's sum is that
    within its range and the totals of the ranges before, which are one row each. Rows of equal ``by`` share a range; nulls
    come first.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(by, [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(by))) if cuts else F.lit(0)
    x = df.withColumn("_p", F.coalesce(part, F.lit(0)))
    within = Window.partitionBy("_p").orderBy(F.col(by).asc_nulls_first(), *(tie or [])).rowsBetween(Window.unboundedPreceding, 0)
    totals = x.groupBy("_p").agg(F.sum(amount).alias("_t"))
    before = F.sum("_t").over(Window.partitionBy(F.lit(0)).orderBy("_p")) - F.col("_t")
    before = totals.select(F.col("_p").alias("_q"), before.alias("_before"))  # at most ``ranges`` rows
    x = x.withColumn("_s", F.sum(amount).over(within)).join(F.broadcast(before), F.col("_p") == F.col("_q"))
    return x.withColumn(name, F.col("_s") + F.col("_before")).drop("_p", "_q", "_s", "_before")


def exact_percentiles(df: DataFrame, value: str, percents: tuple[float, ...], names: list[str]) -> DataFrame:
    """One row of linearly interpolated percentiles, as exact as sorting: distinct values are counted, and each percentile lies
    between the two values whose running counts pass its place."""
    freq = df.select(F.col(value).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    total = freq.agg(F.sum("c").alias("_all"))
    x = running_sum(freq, "v", "c", "upto").join(F.broadcast(total))
    place = [(F.col("_all") - 1) * F.lit(float(p)) for p in percents]
    low = [F.min(F.when(F.col("upto") > F.floor(k), F.col("v"))).alias(f"_l{i}") for i, k in enumerate(place)]
    high = [F.min(F.when(F.col("upto") > F.ceil(k), F.col("v"))).alias(f"_h{i}") for i, k in enumerate(place)]
    one = x.agg(F.max("_all").alias("_all"), *low, *high)
    out = []
    for i, n in enumerate(names):
        k = (F.col("_all") - 1) * F.lit(float(percents[i]))
        a, b, f = F.col(f"_l{i}"), F.col(f"_h{i}"), k - F.floor(k)
        out.append(F.when(a == b, a).otherwise((1 - f) * a + f * b).alias(n))
    return one.select(*out)
